"""Document fingerprints by order MinHash, sensitive to edit distance.

A text's k-mers are its runs of ``K`` code points, each numbered by how often the same run came before. ``SKETCHES``
hash functions each select the ``PICKS`` numbered k-mers with the smallest values, put them back into text order and
hash the tuple of k-mers. Two texts' likeness is the share of equal tuples: it falls when k-mers differ and when they
stand in another order. The fingerprint is the tuples' 32-bit hashes in hexadecimal.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lectern.llm.text_arrays import mix64

K = 8
SKETCHES = 64
PICKS = 2
#: k-mers looked at by all hash functions at once.
_BLOCK = 1 << 14
_GOLD = np.uint64(0x9E3779B97F4A7C15)
_STEP = mix64(np.arange(1, K + 1, dtype=np.uint64) * _GOLD) | np.uint64(1)
_TIMES = (np.random.Generator(np.random.PCG64(4)).integers(0, 1 << 32, (SKETCHES, 1), dtype=np.uint64).astype(np.uint32)) | np.uint32(1)
_PLUS = np.random.Generator(np.random.PCG64(5)).integers(0, 1 << 32, (SKETCHES, 1), dtype=np.uint64).astype(np.uint32)


def kmers(points: np.ndarray) -> np.ndarray:
    """A 64-bit hash for each run of K code points; of a shorter text, one for all of it; of an empty one, none."""
    if not len(points):
        return np.zeros(0, np.uint64)
    width = min(K, len(points))
    n = len(points) - width + 1
    x = points.astype(np.uint64) + np.uint64(1)
    x *= _GOLD
    x ^= x >> np.uint64(32)
    out = np.full(n, np.uint64(width))
    for i in range(width):
        out += x[i : i + n] * _STEP[i]
    return mix64(out)


def numbered(hashes: np.ndarray) -> np.ndarray:
    """How many equal hashes came before each."""
    n = len(hashes)
    at = np.argsort(hashes)
    top = hashes[at]
    first = np.ones(n, bool)
    first[1:] = top[1:] != top[:-1]
    begin = np.flatnonzero(first)
    # runs of equal hashes in order, each run's places in text order
    place = np.sort(((np.cumsum(first) - 1).astype(np.uint64) << np.uint64(32)) | at.astype(np.uint64)) & np.uint64(0xFFFFFFFF)
    out = np.empty(n, np.int64)
    out[place.astype(np.int64)] = np.arange(n) - np.repeat(begin, np.diff(np.append(begin, n)))
    return out


def sketch(text: str) -> np.ndarray:
    """The text's SKETCHES tuple hashes; of an empty text, zeros."""
    points = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32)
    hashes = kmers(points)
    n = len(hashes)
    if not n:
        return np.zeros(SKETCHES, np.uint32)
    x = (mix64(hashes + numbered(hashes).astype(np.uint64) * _GOLD) >> np.uint64(32)).astype(np.uint32)
    rows = np.arange(SKETCHES)
    value = np.full((SKETCHES, PICKS), np.uint64(1) << np.uint64(63))
    place = np.zeros((SKETCHES, PICKS), np.int64)
    for a in range(0, n, _BLOCK):
        z = x[a : a + _BLOCK] * _TIMES
        z += _PLUS
        z ^= z >> np.uint32(15)
        z *= np.uint32(0x2C1B3C6D)
        z ^= z >> np.uint32(13)
        for _ in range(min(PICKS, z.shape[1])):
            at = z.argmin(1)
            got = z[rows, at].astype(np.uint64)
            worst = value.argmax(1)
            better = got < value[rows, worst]
            value[rows[better], worst[better]], place[rows[better], worst[better]] = got[better], a + at[better]
            z[rows, at] = np.uint32(0xFFFFFFFF)
    if n < PICKS:
        place[:] = np.minimum(place, n - 1)
    place.sort(1)
    out = np.full(SKETCHES, np.uint64(7))
    for i in range(PICKS):
        out = mix64(out + hashes[place[:, i]] * _STEP[i])
    return (out >> np.uint64(32)).astype(np.uint32)


def likeness(a: np.ndarray, b: np.ndarray) -> float:
    """Share of equal tuples, 0 to 1."""
    return float((a == b).mean())


def text_of(fingerprint: np.ndarray) -> str:
    return fingerprint.astype(">u4").tobytes().hex()


def edited(text: str, other: str) -> str:
    """``text`` with its last floor(n / 2) code points replaced by the first as many (or all) of ``other``."""
    half = len(text) // 2
    return text[: len(text) - half] + other[:half]


def _paired(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """From rows (block, doc_id, text, tail) sorted block by block: each row that isn't a tail with the row after it."""
    held: tuple[int, int | None, str, np.ndarray] | None = None
    names = ["doc_id", "n_chars", "edited_sha256", "fingerprint", "edited_fingerprint", "near_edited", "near_next"]
    kinds = [pa.int64(), pa.int64(), pa.string(), pa.string(), pa.string(), pa.float64(), pa.float64()]
    for f in batches:
        rows = []
        for block, doc_id, text, tail in zip(*(f.column(c).to_pylist() for c in ("block", "doc_id", "text", "tail")), strict=True):
            if tail and (held is None or held[0] != block):
                continue  # a second tail
            text = text or ""
            own = sketch(text)
            if held is not None:
                _, before, mine, first = held
                new = edited(mine, text)
                second = sketch(new)
                rows.append((before, len(mine), hashlib.sha256(new.encode("utf-8", "surrogatepass")).hexdigest(), text_of(first), text_of(second), likeness(first, second), likeness(first, own)))
            held = None if tail else (block, doc_id, text, own)
        columns = zip(*rows, strict=True) if rows else [[] for _ in names]
        yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds, strict=True)], names)


class _Blocks:
    """Blocks of neighbours: keys between bounds; a key of many rows makes blocks of its own, by ranges of ``spot``."""

    def __init__(self, bounds: np.ndarray, heavy: dict[int, int]) -> None:
        self.bounds, self.heavy = bounds, heavy

    def locate(self, keys: np.ndarray, spots: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Each row's block and, for heavy keys, which of the key's own."""
        block, own = np.searchsorted(self.bounds, keys), np.zeros(len(keys), np.int64)
        if self.heavy:
            for key in set(keys.tolist()) & self.heavy.keys():
                at = np.flatnonzero(keys == key)
                share = (spots[at].astype(float) + 2.0**63) / 2.0**64
                own[at] = np.minimum((share * self.heavy[key]).astype(np.int64), self.heavy[key] - 1)
        return block, own

    def heads(self, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Each block's first row in a batch: the largest key, then the smallest spot."""
        for f in batches:
            keys, spots = f.column("key").to_numpy(), f.column("spot").to_numpy()
            block, own = self.locate(keys, spots)
            order = np.lexsort((spots, ~keys, own, block))
            edge = np.ones(len(order), bool)
            edge[1:] = (block[order][1:] != block[order][:-1]) | (own[order][1:] != own[order][:-1])
            at = order[edge]
            yield pa.RecordBatch.from_arrays([pa.array(x[at]) for x in (block.astype(np.int64), own, ~keys, spots)], ["block", "own", "low", "spot"])


def fingerprints(docs: DataFrame, rows_per_block: int = 256, most_blocks: int = 20_000) -> DataFrame:
    """For each row: doc_id, n_chars long, edited_sha256, fingerprint, edited_fingerprint string, near_edited, near_next double.

    The next document is the one with the next smaller doc_id; after the smallest comes the largest. Null doc_ids
    come last, rows with equal doc_ids follow one another by a hash of the text. Null texts count as empty; an empty
    text's fingerprint is all zeros, and two empty texts have a likeness of 1. A table of one row is its own next.
    An empty table gives an empty one. A very long text is sketched whole. Other columns aren't read.

    Quantiles of doc_id cut the table into blocks of neighbours (about ``most_blocks`` at most, whose bounds the driver
    holds); a doc_id, or null, that many rows share makes blocks by the texts' hashes. Each text goes once to its
    block, and each block's first text also to the block before it. Tasks stream their rows in order.
    """
    spark = docs.sparkSession
    key = F.coalesce(F.col("doc_id").cast("long"), F.lit(-(2**63)))
    slim = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text", key.alias("key"), F.xxhash64("text").alias("spot"))
    rows = slim.count()
    blocks = max(1, min(most_blocks, -(-rows // rows_per_block)))
    each = max(rows_per_block, -(-rows // blocks))
    shares = [i / blocks for i in range(1, blocks + 1)]
    found = slim.select(F.percentile_approx("key", shares, max(10_000, 4 * blocks)), F.max("key")).first()
    heavy = {r["key"]: -(-r["n"] // each) for r in slim.groupBy("key").agg(F.count("*").alias("n")).where(F.col("n") > 2 * each).collect()}
    bounds = {*(found[0] or []), *([] if found[1] is None else [found[1]]), *heavy, *(k - 1 for k in heavy if k > -(2**63))}
    cut = _Blocks(np.array(sorted(bounds), np.int64), heavy)
    first = slim.select("key", "spot").mapInArrow(cut.heads, "block long, own long, low long, spot long")
    first = first.groupBy("block", "own").agg(F.min(F.struct("low", "spot")).alias("m"))
    # in document order: keys fall, a key's own blocks rise
    heads = sorted((-r["block"], r["own"], ~r["m"]["low"], r["m"]["spot"]) for r in first.collect())
    place = {(-b, o): i for i, (b, o, _, _) in enumerate(heads)}
    head_key, head_spot = (np.array([h[i] for h in heads], np.int64) for i in (2, 3))

    def placed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for f in batches:
            keys, spots = f.column("key").to_numpy(), f.column("spot").to_numpy()
            at = np.array([place[p] for p in zip(*(x.tolist() for x in cut.locate(keys, spots)), strict=True)], np.int64)
            head = (head_key[at] == keys) & (head_spot[at] == spots) if len(at) else np.zeros(0, bool)
            # every block's first text also closes the block before it, and the very first one the last block
            rows = np.concatenate([np.arange(len(keys)), np.flatnonzero(head)])
            block = np.concatenate([at, (at[head] - 1) % max(1, len(heads))]).astype(np.int32)
            tail = np.arange(len(rows)) >= len(keys)
            taken = f.take(pa.array(rows))
            yield pa.RecordBatch.from_arrays([pa.array(block), *taken.columns, pa.array(tail)], ["block", *taken.schema.names, "tail"])

    n = int(spark.conf.get("spark.sql.shuffle.partitions"))
    dealt = slim.mapInArrow(placed, "block int, doc_id long, text string, key long, spot long, tail boolean")
    share = F.least(F.floor(F.col("block") * F.lit(n) / F.lit(max(1, len(heads)))), F.lit(n - 1)).cast("int")
    dealt = dealt.repartitionById(n, share)
    dealt = dealt.sortWithinPartitions("block", "tail", F.col("key").desc(), "spot").select("block", "doc_id", "text", "tail")
    return dealt.mapInArrow(_paired, "doc_id long, n_chars long, edited_sha256 string, fingerprint string, edited_fingerprint string, near_edited double, near_next double")
