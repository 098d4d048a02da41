"""A toxicity classifier with counterfactual regularisation.

Logistic regression over the words that a text holds. Besides the log-loss and a ridge penalty, training penalises the
squared change of the score under swapping identity terms: for each labelled text that mentions a group, the text with
that mention swapped for other groups' terms ought to score the same. Weights that single out a group shrink, so
neutral mentions aren't taken for attacks.

The labelled rows learned from are a bounded sample, the ``most`` rows with the smallest hash of doc_id, one for each
doc_id; what the sample says about words decides the vocabulary, the ``words`` strongest and all identity terms. Both
bounds are parameters, as are the terms. Every text is scored on its whole words.
"""

from __future__ import annotations

import re
from collections.abc import Iterator, Sequence
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lectern.llm.names import free, quoted
from lectern.session import checkpointed

#: Labelled rows to learn from, at most.
SAMPLE = 20_000
WORDS = 5_000
LEAST_DOCS = 4
LEAST_Z = 3.0
RIDGE = 2e-6
#: A toxic row counts as so many others, as most rows aren't toxic.
TOXIC_WEIGHT = 3.0
SWAP = 1.0

# Identity terms by language and kind; terms of a kind are swapped for one another.
IDENTITIES: tuple[tuple[str, ...], ...] = (
    # English
    ("women", "men", "girls", "boys"),
    ("woman", "man", "girl", "boy"),
    ("christian", "muslim", "jewish", "hindu", "buddhist", "atheist"),
    ("christians", "muslims", "jews", "hindus", "buddhists", "atheists"),
    ("black", "white", "asian", "latino", "arab"),
    ("african", "american", "european", "mexican", "chinese", "indian"),
    ("gay", "lesbian", "straight", "bisexual", "transgender"),
    ("disabled", "blind", "deaf"),
    ("immigrants", "refugees", "natives"),
    # German
    ("frauen", "männer", "mädchen", "jungen"),
    ("christen", "muslime", "juden", "hindus", "buddhisten", "atheisten"),
    ("schwarze", "weiße", "asiaten", "araber"),
    ("schwule", "lesben", "heterosexuelle", "bisexuelle", "transgender"),
    ("behinderte", "blinde", "gehörlose"),
    ("einwanderer", "flüchtlinge", "einheimische"),
    # French
    ("femmes", "hommes", "filles", "garçons"),
    ("chrétiens", "musulmans", "juifs", "hindous", "bouddhistes", "athées"),
    ("noirs", "blancs", "asiatiques", "arabes"),
    ("gays", "lesbiennes", "hétérosexuels", "bisexuels", "transgenres"),
    ("handicapés", "aveugles", "sourds"),
    ("immigrés", "réfugiés", "autochtones"),
    # Spanish
    ("mujeres", "hombres", "niñas", "niños"),
    ("cristianos", "musulmanes", "judíos", "hindúes", "budistas", "ateos"),
    ("negros", "blancos", "asiáticos", "árabes"),
    ("gais", "lesbianas", "heterosexuales", "bisexuales", "transexuales"),
    ("discapacitados", "ciegos", "sordos"),
    ("inmigrantes", "refugiados", "nativos"),
)

_TOKEN = re.compile(r"[^\W\d_]+")


def tokens(text: str | None) -> set[str]:
    """The distinct lower-cased letter runs of a text."""
    return set(_TOKEN.findall(text.lower())) if text else set()


def swapped(words: set[str], identities: Sequence[Sequence[str]] = IDENTITIES) -> list[set[str]]:
    """The word set with each identity term replaced by each other one of its kind."""
    out = []
    for kind in identities:
        for term in kind:
            if term in words:
                out += [(words - {term}) | {other} for other in kind if other != term]
    return out


@dataclass
class Model:
    """Weights of words; ``pairs``: how many texts with a swapped term the penalty was taken over."""

    weights: dict[str, float]
    bias: float
    pairs: int = 0

    def score(self, text: str | None) -> float:
        z = self.bias + sum(self.weights[w] for w in sorted(tokens(text) & self.weights.keys()))
        return float(1 / (1 + np.exp(-np.clip(z, -60, 60))))


def strength(n: float, toxic: float, rate: float) -> float:
    """Standard deviations by which a word's toxic rows differ from what the overall rate predicts."""
    return (toxic - n * rate) / (n * rate * (1 - rate) + 1e-9) ** 0.5


def terms(identities: Sequence[Sequence[str]] = IDENTITIES) -> set[str]:
    return {t for kind in identities for t in kind}


def choose(counts: dict[str, tuple[int, int]], rate: float, identities: Sequence[Sequence[str]] = IDENTITIES, most: int = WORDS) -> list[str]:
    """The vocabulary from each word's (rows, toxic rows): the ``most`` strongest words and all identity terms."""
    strong = sorted((-abs(z), w) for w, (n, toxic) in counts.items() if n >= LEAST_DOCS and abs(z := strength(n, toxic, rate)) >= LEAST_Z)
    return [*dict.fromkeys([*(w for _, w in strong[:most]), *sorted(terms(identities) & counts.keys())])]


def fit(rows: Sequence[tuple[set[str], int]], swap: float = SWAP, identities: Sequence[Sequence[str]] = IDENTITIES, vocabulary: Sequence[str] | None = None) -> Model:
    """Learns from (word set, label) pairs, in the order given; the same pairs give the same model.

    Without ``vocabulary`` it is chosen from the pairs; with one, other words aren't looked at.
    """
    if not rows:
        return Model({}, 0.0)
    y = np.array([label for _, label in rows], float)
    rate = (y.sum() + 0.5) / (len(y) + 1)
    if vocabulary is None:
        seen: dict[str, tuple[int, int]] = {}
        for words, label in rows:
            for w in words:
                n, toxic = seen.get(w, (0, 0))
                seen[w] = (n + 1, toxic + label)
        vocabulary = choose(seen, rate, identities)
    vocabulary = {w: i for i, w in enumerate(vocabulary)}
    if not vocabulary:
        return Model({}, float(np.log(rate / (1 - rate))))

    def cells(sets: Sequence[set[str]]) -> tuple[np.ndarray, np.ndarray]:
        at = [(i, vocabulary[w]) for i, s in enumerate(sets) for w in sorted(s & vocabulary.keys())]
        return (np.array([a for a, _ in at], int), np.array([b for _, b in at], int))

    row, col = cells([words for words, _ in rows])
    pairs = [(words, other) for words, _ in rows for other in swapped(words, identities)]
    prow, pcol = cells([a for a, _ in pairs])
    qrow, qcol = cells([b for _, b in pairs])
    weight = np.where(y > 0, TOXIC_WEIGHT, 1.0) / np.where(y > 0, TOXIC_WEIGHT, 1.0).sum()
    w, b, n = np.zeros(len(vocabulary)), float(np.log(rate / (1 - rate))), len(rows)
    m1, m2 = np.zeros(len(w) + 1), np.zeros(len(w) + 1)
    for step in range(1, 601):
        score = 1 / (1 + np.exp(-np.clip(b + np.bincount(row, w[col], n), -60, 60)))
        off = (score - y) * weight
        g = np.bincount(col, off[row], len(w)) + 2 * RIDGE * w
        if pairs:
            gap = np.bincount(prow, w[pcol], len(pairs)) - np.bincount(qrow, w[qcol], len(pairs))
            g += 2 * swap / len(pairs) * (np.bincount(pcol, gap[prow], len(w)) - np.bincount(qcol, gap[qrow], len(w)))
        g = np.append(g, off.sum())
        m1, m2 = 0.9 * m1 + 0.1 * g, 0.99 * m2 + 0.01 * g * g
        move = 0.05 * (m1 / (1 - 0.9**step)) / (np.sqrt(m2 / (1 - 0.99**step)) + 1e-8) * min(1.0, 4 * (1 - step / 601))
        w, b = w - move[:-1], b - float(move[-1])
    return Model({x: float(w[i]) for x, i in vocabulary.items() if abs(w[i]) > 1e-4}, b, len(pairs))


def _worded(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for f in batches:
        made = pa.array([sorted(tokens(t)) for t in f.column("text").to_pylist()], pa.list_(pa.string()))
        yield pa.RecordBatch.from_arrays([f.column("doc_id"), f.column("toxic"), made], ["doc_id", "toxic", "words"])


def learn(docs: DataFrame, labels: DataFrame, learns: Column, most: int = SAMPLE, most_words: int = WORDS, identities: Sequence[Sequence[str]] = IDENTITIES, swap: float = SWAP) -> Model:
    """Fits the classifier on up to ``most`` labelled rows of ``docs`` where ``learns`` (over doc_id) holds.

    A document's label is 1 if any of its labels is; null labels are left out. Of rows with equal doc_ids the least
    text is learned from. Very long and empty texts count like others, by the words they hold. Spark counts the
    sample's words; the driver gets the vocabulary, and of each sampled row the words that belong to it.
    """
    chosen = labels.where(learns & F.col("toxic").isNotNull() & F.col("doc_id").isNotNull()).groupBy("doc_id").agg(F.max("toxic").cast("int").alias("toxic"))
    chosen = chosen.orderBy(F.xxhash64("doc_id"), "doc_id").limit(most)
    # ``most`` ids and labels: 16 bytes each
    texts = docs.select("doc_id", "text").join(F.broadcast(chosen), "doc_id").groupBy("doc_id", "toxic").agg(F.min(F.coalesce("text", F.lit(""))).alias("text"))
    sample = checkpointed(texts.mapInArrow(_worded, "doc_id long, toxic int, words array<string>"))
    n, n1 = sample.agg(F.count("*"), F.count_if(F.col("toxic") > 0)).first()
    rate = (n1 + 0.5) / (n + 1)
    counted = sample.select(F.explode("words").alias("word"), (F.col("toxic") > 0).cast("int").alias("toxic")).groupBy("word").agg(F.count("*").alias("n"), F.sum("toxic").alias("toxic"))
    z = F.abs((F.col("toxic") - F.col("n") * rate) / F.sqrt(F.col("n") * rate * (1 - rate) + 1e-9))
    strong = counted.where((F.col("n") >= LEAST_DOCS) & (z >= LEAST_Z)).orderBy(z.desc(), "word").limit(most_words)
    named = counted.where(F.col("word").isin(sorted(terms(identities)))).orderBy("word")
    vocabulary = [*dict.fromkeys(r["word"] for part in (strong, named) for r in part.collect())]
    wanted = set(vocabulary)

    def known(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for f in batches:
            words = pa.array([[w for w in ws if w in wanted] for ws in f.column("words").to_pylist()], pa.list_(pa.string()))
            yield pa.RecordBatch.from_arrays([f.column("doc_id"), f.column("toxic"), words], ["doc_id", "toxic", "words"])

    got = sample.mapInArrow(known, sample.schema).toArrow()
    rows = sorted(zip(got["doc_id"].to_pylist(), got["toxic"].to_pylist(), got["words"].to_pylist(), strict=True))
    return fit([(set(words), int(toxic > 0)) for _, toxic, words in rows], swap, identities, vocabulary)


def score(docs: DataFrame, model: Model, keep: tuple[str, ...] = ("doc_id",), at: float = 0.7, prefix: str = "") -> DataFrame:
    """Columns ``keep``, then score double (0 to 1) and predicted int (1 if score >= ``at``), named with ``prefix``.

    Null and empty texts score as texts without a known word. Equal texts score alike; repeated rows stay; an empty
    table gives an empty one; a very long text is scored whole; only text is read.
    """
    text = "text" if "text" in keep else free(docs, "whole_text")[0]
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for f in batches:
            made = np.array([shared.value.score(t) for t in f.column(text).to_pylist()], float)
            yield pa.RecordBatch.from_arrays([*[f.column(c) for c in keep], pa.array(made), pa.array((made >= at).astype(np.int32))], [*keep, f"{prefix}score", f"{prefix}predicted"])

    kinds = dict(docs.dtypes)
    schema = ", ".join([*[f"{quoted(c)} {kinds[c]}" for c in keep], f"{prefix}score double, {prefix}predicted int"])
    return docs.select(*map(quoted, keep), *([] if text == "text" else [F.col("text").alias(text)])).mapInArrow(run, schema)
