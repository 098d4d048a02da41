"""Language identification as inference of a mixture of languages.

Every language is a multinomial over hashed letter trigrams, learned from labelled texts. A text's trigrams are drawn
from an unknown mixture of languages; expectation-maximisation finds the proportions. Of the language sets made of the
k most probable languages, k = 1, 2, ..., the one with the highest penalised likelihood is selected: every language
after the first costs ``PENALTY`` nats for each trigram of the text besides log n. The prediction is the set's main
language, the score its proportion in the mixture of all languages.

The model has ``BUCKETS`` numbers for each language whatever the size of the data, half a megabyte; all labelled rows
are counted. Languages are tags: there may be as many as the driver and each worker can hold so.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lectern.llm.names import free, quoted

BUCKETS = 1 << 16
ALPHA = 0.1
STEPS = 12
PENALTY = 0.02
#: Trigrams times languages that are fitted together; a text isn't cut.
HELD = 1 << 19

_LETTER: np.ndarray | None = None


def _letters() -> np.ndarray:
    global _LETTER
    if _LETTER is None:
        _LETTER = np.array([chr(i).isalpha() for i in range(0x110000)])
    return _LETTER


def trigrams(text: str | None) -> np.ndarray:
    """Bucket of each trigram of the lower-cased text, letters only, each run of other characters as one blank."""
    if not text:
        return np.zeros(0, np.int64)
    points = np.frombuffer(text.lower().encode("utf-32-le", "surrogatepass"), np.uint32)
    letter = _letters()[points]
    if not letter.any():
        return np.zeros(0, np.int64)
    kept = letter.copy()
    kept[1:] |= letter[:-1]  # the first other character after a letter
    x = np.zeros(int(kept.sum()) + 2, np.uint64)
    x[1:-1] = np.where(letter, points, 0)[kept]
    mixed = x[:-2] * np.uint64(0x9E3779B97F4A7C15) + x[1:-1] * np.uint64(0xC2B2AE3D27D4EB4F) + x[2:] * np.uint64(0x165667B19E3779F9)
    mixed ^= mixed >> np.uint64(29)
    return ((mixed * np.uint64(0xBF58476D1CE4E5B9)) >> np.uint64(48)).astype(np.int64)


def _counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    totals: dict[str, np.ndarray] = {}
    for f in batches:
        for lang, text in zip(f.column("lang").to_pylist(), f.column("text").to_pylist(), strict=True):
            got = trigrams(text)
            if len(got):
                row = totals.setdefault(lang, np.zeros(BUCKETS, np.int64))
                row += np.bincount(got, minlength=BUCKETS)
    for lang, row in totals.items():
        at = np.flatnonzero(row)
        yield pa.RecordBatch.from_arrays([pa.array([lang] * len(at), pa.string()), pa.array(at.astype(np.int32)), pa.array(row[at])], ["lang", "bucket", "n"])


class Model:
    """Trigram probabilities of each learned language."""

    def __init__(self, counts: dict[str, np.ndarray]) -> None:
        self.languages = sorted(counts)
        table = np.array([counts[x] for x in self.languages], float).reshape(-1, BUCKETS) + ALPHA
        self.p = np.ascontiguousarray((table / table.sum(1, keepdims=True)).T)

    def infer(self, texts: list[np.ndarray]) -> list[tuple[list[tuple[str, float]], float]]:
        """For each text's trigrams the selected languages with their proportions, the main one first; and the main one's
        proportion in the mixture of all languages."""
        out: list[tuple[list[tuple[str, float]], float]] = [([], 0.0) for _ in texts]
        full = [i for i, x in enumerate(texts) if len(x)]
        if not full or not self.languages:
            return out
        n = np.array([len(texts[i]) for i in full], float)
        joined = np.concatenate([texts[i] for i in full]) + np.repeat(np.arange(len(full)), n.astype(int)) * BUCKETS
        cells, count = np.unique(joined, return_counts=True)
        doc, p = cells // BUCKETS, self.p[cells % BUCKETS]
        theta, total = self._fit(doc, p, count, n, np.full((len(full), len(self.languages)), 1.0 / len(self.languages)))
        order = np.argsort(-theta, axis=1, kind="stable")
        begin = np.searchsorted(doc, np.arange(len(full)))
        best = np.add.reduceat(np.log(np.take_along_axis(p, order[doc, :1], 1)[:, 0]) * count, begin)
        chosen = np.zeros_like(theta)
        chosen[np.arange(len(full)), order[:, 0]] = 1
        price = np.log(n + 1) + PENALTY * n
        # the whole mixture bounds every set's likelihood: where it can't pay for one more language, one stays
        open_ = np.flatnonzero(total - best > price)
        for k in range(2, len(self.languages) + 1):
            if not len(open_):
                break
            rows = np.flatnonzero(np.isin(doc, open_))
            sub = np.searchsorted(open_, doc[rows])
            start = np.zeros((len(open_), len(self.languages)))
            np.put_along_axis(start, order[open_, :k], np.take_along_axis(theta[open_], order[open_, :k], 1) + 1e-6, 1)
            fit, reached = self._fit(sub, p[rows], count[rows], n[open_], start / start.sum(1, keepdims=True))
            better = reached - (k - 1) * price[open_] > best[open_]
            chosen[open_[better]] = fit[better]
            best[open_] = np.where(better, reached - (k - 1) * price[open_], best[open_])
            open_ = open_[total[open_] - k * price[open_] > best[open_]]
        for i, row, whole in zip(full, chosen, theta, strict=True):
            at = [j for j in np.argsort(-row, kind="stable") if row[j] > 0]
            out[i] = [(self.languages[j], float(row[j])) for j in at], min(1.0, float(whole[at[0]]))
        return out

    @staticmethod
    def _fit(doc: np.ndarray, p: np.ndarray, count: np.ndarray, n: np.ndarray, theta: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        begin = np.searchsorted(doc, np.arange(len(n)))
        for _ in range(STEPS):
            r = theta[doc] * p
            r *= (count / r.sum(1))[:, None]
            theta = np.add.reduceat(r, begin) / n[:, None]
        return theta, np.add.reduceat(np.log((theta[doc] * p).sum(1)) * count, begin)


def learn(docs: DataFrame, learns: Column) -> Model:
    """Counts trigrams by language over all rows where ``learns`` holds and text and lang aren't null."""
    rows = docs.where(learns & F.col("lang").isNotNull() & F.col("text").isNotNull()).select("lang", "text")
    counted = rows.mapInArrow(_counted, "lang string, bucket int, n long").groupBy("lang", "bucket").agg(F.sum("n").alias("n"))
    counts: dict[str, np.ndarray] = {}
    for lang, at, n in _columns(counted.groupBy("lang").agg(F.collect_list("bucket"), F.collect_list("n"))):
        counts.setdefault(lang, np.zeros(BUCKETS, np.int64))[np.array(at, int)] = n
    return Model(counts)


def _columns(df: DataFrame) -> list[tuple]:
    t = df.toArrow()
    return list(zip(*[c.to_pylist() for c in t.columns], strict=True)) if t.num_rows else []


def identify(docs: DataFrame, model: Model, keep: tuple[str, ...] = ("doc_id",), prefix: str = "") -> DataFrame:
    """Columns ``keep``, then lang_pred string, score double, lang_set array<struct<lang string, share double>>.

    The three names start with ``prefix``. ``score`` is the main language's share of the mixture of all languages, ``lang_set``
    holds the selected languages' shares of theirs.

    ``lang_pred`` is a learned language, or ``und`` (score 0, empty set) where the text is null or has no letter, or
    where nothing was learned. Equal texts get equal predictions; repeated rows stay; an empty table gives an empty
    one; no other column than text is read. A batch of texts is held at once, a very long text alone.
    """
    text = "text" if "text" in keep else free(docs, "whole_text")[0]
    most = HELD // max(1, len(model.languages))
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def predict(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for f in batches:
            found: list[tuple[list[tuple[str, float]], float]] = []
            waiting, held = [], 0
            for one in f.column(text).to_pylist():
                waiting.append(trigrams(one))
                held += len(waiting[-1])
                if held >= most:
                    found += shared.value.infer(waiting)
                    waiting, held = [], 0
            found += shared.value.infer(waiting)
            sets = [s for s, _ in found]
            kind = pa.list_(pa.struct([("lang", pa.string()), ("share", pa.float64())]))
            made = [
                pa.array([s[0][0] if s else "und" for s in sets], pa.string()),
                pa.array([main for _, main in found], pa.float64()),
                pa.array([[{"lang": x, "share": y} for x, y in s] for s in sets], kind),
            ]
            yield pa.RecordBatch.from_arrays([*[f.column(c) for c in keep], *made], [*keep, f"{prefix}lang_pred", f"{prefix}score", f"{prefix}lang_set"])

    kinds = dict(docs.dtypes)
    schema = ", ".join([*[f"{quoted(c)} {kinds[c]}" for c in keep], f"{prefix}lang_pred string, {prefix}score double, {prefix}lang_set array<struct<lang:string,share:double>>"])
    return docs.select(*map(quoted, keep), *([] if text == "text" else [F.col("text").alias(text)])).mapInArrow(predict, schema)
