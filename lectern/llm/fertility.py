"""Quality rules by tokeniser fertility, after plain base rules.

A public vocabulary encodes every word of a text. Three figures follow: characters per token, the share of tokens that
are single bytes of characters the vocabulary lacks, and the entropy of the text's tokens as a share of the most that
so many tokens can have. For each language (the ``lang`` column, else the main script of the letters) the quartiles of
each figure over all texts that pass the base rules give a band; a text outside its language's band is rejected.
Quartiles are exact for figures rounded to three places, from a count of each. A language's quartiles are drawn
towards those of all texts, as if it had ``PRIOR`` more texts of theirs, so rare languages have bands near the common one.

Words are encoded one by one, so a worker may keep what it knows about words; the figures don't depend on that store.
"""

from __future__ import annotations

import unicodedata
from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lectern.llm.text_arrays import chunks, shingles, utf8, word_hashes
from lectern.session import checkpointed

VOCABULARY = "/opt/tokenizers/piece_bpe_32k.model"
#: Quartile distances by which a long text's figure may leave the quartiles.
REACH = 2.75
#: Of short texts, whose figures vary more, the distance grows by this over the root of the number of words.
SHORT = 4.0
#: Texts by whose weight a language's quartiles are drawn towards those of all texts.
PRIOR = 50
#: Languages whose bands are sent to all tasks; those of more are joined by a shuffle.
MOST_BANDS = 10_000
#: Places that figures are rounded to for the quartiles.
_PLACES = 3
#: Words whose pieces a worker remembers.
MOST_WORDS = 1_000_000
WINDOW = 8
# Bands never get narrower than this on either side of the quartiles.
LEAST_MARGIN = {"chars_per_token": 0.1, "byte_share": 0.10, "token_entropy": 0.10}

_SYMBOL = np.zeros(256, np.int64)
_SYMBOL[list(b"#*$%&|<>")] = 1
_POINT = np.ones(256, np.int64)  # first bytes of code points within words
_POINT[0x80:0xC0] = 0
_POINT[[0x20, *range(0x09, 0x0E)]] = 0


class _Pieces:
    """Tokens of words, by one vocabulary; one for each worker and path."""

    _kept: dict[str, _Pieces] = {}

    def __init__(self, path: str) -> None:
        import sentencepiece

        self.model = sentencepiece.SentencePieceProcessor(model_file=path)
        self.byte = np.array([self.model.is_byte(i) for i in range(self.model.get_piece_size())])
        self.clear()

    @classmethod
    def of(cls, path: str) -> _Pieces:
        if path not in cls._kept:
            cls._kept[path] = cls(path)
        return cls._kept[path]

    def clear(self) -> None:
        self.index: dict[bytes, int] = {}
        self.ids, self.used = np.zeros(1 << 16, np.int32), 0
        self.start = np.zeros(1 << 14, np.int64)

    def numbers(self, words: list[bytes]) -> np.ndarray:
        """A number for each word, valid until the next clear()."""
        fresh = [w for w in dict.fromkeys(words) if w not in self.index]
        if len(self.index) + len(fresh) > MOST_WORDS and self.index:
            self.clear()
            fresh = list(dict.fromkeys(words))
        for k in range(0, len(fresh), 4096):
            part = fresh[k : k + 4096]
            for w, ids in zip(part, self.model.encode([w.decode("utf-8", "replace") for w in part], num_threads=1), strict=True):
                n = len(self.index)
                self.index[w] = n
                while n + 1 >= len(self.start):
                    self.start = np.concatenate([self.start, np.zeros_like(self.start)])
                while self.used + len(ids) > len(self.ids):
                    self.ids = np.concatenate([self.ids, np.zeros_like(self.ids)])
                self.ids[self.used : self.used + len(ids)] = ids
                self.used += len(ids)
                self.start[n + 1] = self.used
        index = self.index
        return np.fromiter((index[w] for w in words), np.int64, len(words))

    def tokens(self, numbers: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Token ids of the words in turn, and how many each has."""
        begin = self.start[numbers]
        n = self.start[numbers + 1] - begin
        total = int(n.sum())
        at = np.arange(total) - np.repeat(np.cumsum(n) - n, n) + np.repeat(begin, n)
        return self.ids[at], n


def repeated_words(words: np.ndarray, window: int = WINDOW) -> int:
    """Words that lie in a run of ``window`` words found twice or more; words: hashes in text order."""
    n = len(words) - window + 1
    if n < 2:
        return 0
    _, inverse, count = np.unique(shingles(words, window), return_inverse=True, return_counts=True)
    again = count[inverse] > 1
    if not again.any():
        return 0
    edge = np.zeros(len(words) + 1, np.int64)
    edge[:n] += again
    edge[window : window + n] -= again
    return int((np.cumsum(edge[:-1]) > 0).sum())


def repeated_lines(text: str | None) -> int:
    """Lines with a word that equal an earlier line."""
    if not text or "\n" not in text:
        return 0
    lines = [x for x in text.split("\n") if x.strip(" \t\r\x0b\x0c")]
    return len(lines) - len(set(lines))


def main_script(text: str | None) -> str:
    """The script that most of the text's first distinct letters belong to, by Unicode name; none without letters."""
    count: dict[str, int] = {}
    for c in set(text or ""):
        if c.isalpha():
            name = unicodedata.name(c, "UNKNOWN").split(" ")[0]
            count[name] = count.get(name, 0) + 1
    return min(count, key=lambda k: (-count[k], k)) if count else "none"


_BASE = "n_words long, word_chars long, n_symbols long, n_dup_lines long, n_repeat_words long, n_tokens long, chars_per_token double, byte_share double, token_entropy double, script string"


def _measured(path: str, keep: tuple[str, ...]):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pieces = _Pieces.of(path)
        for f in batches:
            data, offsets = utf8(f.column("__text"))
            n = f.num_rows
            sums = {k: np.zeros(n, np.int64) for k in ("words", "chars", "symbols", "repeats", "tokens")}
            byte, entropy = np.zeros(n), np.zeros(n)
            for a, b in chunks(offsets):
                part, at = data[offsets[a] : offsets[b]], offsets[a : b + 1] - offsets[a]
                for name, table in (("chars", _POINT), ("symbols", _SYMBOL)):
                    run_ = np.concatenate([[0], np.cumsum(table[part])])
                    sums[name][a:b] = run_[at[1:]] - run_[at[:-1]]
                hashes, where = word_hashes(part, at, lower=False)
                sums["words"][a:b] = np.diff(where)
                for i in range(b - a):
                    sums["repeats"][a + i] = repeated_words(hashes[where[i] : where[i + 1]])
                words: list[bytes] = []
                for i in range(b - a):
                    words += part[at[i] : at[i + 1]].tobytes().split()
                ids, count = pieces.tokens(pieces.numbers(words)) if words else (np.zeros(0, np.int32), np.zeros(0, np.int64))
                ends = np.concatenate([[0], np.cumsum(count)])[where]
                sums["tokens"][a:b] = np.diff(ends)
                doc = np.repeat(np.arange(b - a), np.diff(ends))
                total = np.maximum(np.diff(ends), 1)
                byte[a:b] = np.bincount(doc, pieces.byte[ids], b - a) / total
                cells, times = np.unique((doc << 24) | ids, return_counts=True)
                owner = cells >> 24
                share = times / total[owner]
                bits = np.bincount(owner, -share * np.log2(share), b - a)
                entropy[a:b] = np.where(total > 1, bits / np.log2(np.maximum(total, 2)), 0.0)
            texts = f.column("__text").to_pylist()
            made = {
                "n_words": sums["words"], "word_chars": sums["chars"], "n_symbols": sums["symbols"],
                "n_dup_lines": np.array([repeated_lines(t) for t in texts], np.int64), "n_repeat_words": sums["repeats"], "n_tokens": sums["tokens"],
                "chars_per_token": sums["chars"] / np.maximum(sums["tokens"], 1), "byte_share": byte, "token_entropy": entropy,
            }
            arrays = [*[f.column(c) for c in keep], *[pa.array(v) for v in made.values()], pa.array([main_script(t) for t in texts], pa.string())]
            yield pa.RecordBatch.from_arrays(arrays, [*keep, *made, "script"])

    return run


def measure(docs: DataFrame, vocabulary: str = VOCABULARY, keep: tuple[str, ...] = ("doc_id",), lang: Column | None = None) -> DataFrame:
    """Columns ``keep``, the base figures, the three fertility figures, n_tokens, base_failed and the group of the band.

    Null texts have no word. The vocabulary is read by path on every executor, as the installed package lays it down.
    """
    kinds = dict(docs.dtypes)
    schema = ", ".join([*[f"`{c}` {kinds[c]}" for c in keep], "__lang string", _BASE])
    slim = docs.select(*keep, (F.lit(None) if lang is None else lang).cast("string").alias("__lang"), F.col("text").alias("__text"))
    out = slim.mapInArrow(_measured(vocabulary, (*keep, "__lang")), schema)
    failed = (F.col("n_words") < 20) | (100 * F.col("n_repeat_words") > 30 * F.col("n_words"))
    return out.withColumn("base_failed", failed).withColumn("band", F.coalesce("__lang", "script")).drop("__lang", "script")


def quartiles(good: DataFrame, figures: Sequence[str]) -> DataFrame:
    """(band, figure, n, q1, q3): exact quartiles of the rounded figures of each band, and of all rows (band null).

    Counts by value are taken before anything is dealt out; a band has as many values as thousandths that occur.
    """
    cells = F.explode(F.array(*[F.struct(F.lit(c).alias("figure"), F.round(c, _PLACES).alias("value")) for c in figures])).alias("c")
    counted = good.select("band", cells).groupBy("band", "c.figure", "c.value").agg(F.count("*").alias("k"))
    counted = counted.where("value IS NOT NULL")
    every = counted.groupBy("figure", "value").agg(F.sum("k").alias("k")).select(F.lit(None).cast("string").alias("band"), "figure", "value", "k")
    both = counted.where("band IS NOT NULL").select("band", "figure", "value", "k").union(every)
    w = Window.partitionBy("band", "figure")
    ranked = both.withColumn("upto", F.sum("k").over(w.orderBy("value").rowsBetween(Window.unboundedPreceding, 0))).withColumn("n", F.sum("k").over(w))
    at = lambda share: F.min(F.when(F.col("upto") >= F.ceil(F.col("n") * share), F.col("value")))
    return ranked.groupBy("band", "figure").agg(F.first("n").alias("n"), at(0.25).alias("q1"), at(0.75).alias("q3"))


def judge(measured: DataFrame, reach: float = REACH, prior: float = PRIOR) -> DataFrame:
    """``measured`` with kept boolean: false if base_failed, else whether all three figures lie in the band.

    Bands reach ``reach`` quartile distances (more for short texts) beyond the quartiles of the texts that pass the base
    rules, language by language; one row for each language is joined, nothing reaches the driver. Characters per token
    have both ends, the byte share only an upper one, the entropy only a lower one. Texts of a language of which none
    passes are rejected by their base figures; without any text that passes, nothing is kept.
    """
    figures = tuple(LEAST_MARGIN)
    found = checkpointed(quartiles(measured.where(~F.col("base_failed")), figures))
    own, rest = found.where("band IS NOT NULL"), found.where("band IS NULL").select("figure", F.col("q1").alias("r1"), F.col("q3").alias("r3"))
    own = own.join(F.broadcast(rest), "figure")  # as many rows as figures
    weight = F.col("n") / (F.col("n") + F.lit(float(prior)))
    drawn = own.select("band", "figure", *[(weight * F.col(q) + (1 - weight) * F.col(r)).alias(q) for q, r in (("q1", "r1"), ("q3", "r3"))])
    bands = drawn.groupBy("band").agg(*[F.max(F.when(F.col("figure") == c, F.struct("q1", "q3"))).alias(f"of_{c}") for c in figures])
    sent = bands.count() <= MOST_BANDS
    out = measured.join(F.broadcast(bands) if sent else bands, "band", "left")
    short = 1 + F.lit(SHORT) / F.sqrt(F.greatest(F.col("n_words"), F.lit(1)))
    ok = F.lit(True)
    for c in figures:
        q1, q3 = F.col(f"of_{c}.q1"), F.col(f"of_{c}.q3")
        margin = F.greatest(reach * (q3 - q1), F.lit(LEAST_MARGIN[c])) * short
        if c != "token_entropy":
            ok = ok & (F.col(c) <= q3 + margin)
        if c != "byte_share":
            ok = ok & (F.col(c) >= q1 - margin)
    return out.select(*measured.columns, F.coalesce(~F.col("base_failed") & ok, F.lit(False)).alias("kept"))


def quality(docs: DataFrame, vocabulary: str = VOCABULARY, keep: tuple[str, ...] = ("doc_id",), lang: Column | None = None) -> DataFrame:
    """:func:`measure`, written to the checkpoint folder, then :func:`judge`.

    All rows stay, repeated ones too, with null doc_ids or equal ones; an empty table gives an empty one; a very long
    text is measured whole; only text and the language are read. ``vocabulary`` is a path that every executor has.
    """
    return judge(checkpointed(measure(docs, vocabulary, keep, lang)))
