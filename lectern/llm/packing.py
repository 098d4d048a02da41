"""Packing: length buckets with the least padding, and batches of a token budget inside each bucket.

The histogram of all lengths decides the bucket boundaries: dynamic programming over its bins finds, for up to
``buckets`` buckets, the upper boundaries under which padding every document to its bucket's boundary wastes the
fewest tokens. Inside a bucket documents are ranked by a hash or in a given order, and each batch holds as many as fit the token budget
at the bucket's length.

Bins: lengths up to 512 are exact; longer ones are rounded up to 9 significant binary digits, so there are fewer
than 256 bins for each doubling of the length and under 16,000 in all, whatever the table's size. The boundaries are
those of least padding over rounded lengths; a bucket's own length is the largest real one in it.
"""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lectern.llm.ordering import global_rank
from lectern.session import checkpointed

DIGITS = 9


def binned(length: Column) -> Column:
    """The length rounded up to DIGITS significant binary digits."""
    bits = F.length(F.bin(length))
    step = F.greatest(bits - F.lit(DIGITS), F.lit(0))
    width = F.pow(F.lit(2.0), step).cast("long")
    return (F.ceil(length / width) * width).cast("long")


def boundaries(lengths: Sequence[int], counts: Sequence[int], buckets: int) -> list[int]:
    """Up to ``buckets`` upper boundaries that minimise the padding over a histogram with rising lengths.

    Exact: the recurrence over bins is solved by divide and conquer, as the best split never moves left when the
    last bin moves right.
    """
    n = len(lengths)
    if n <= buckets:
        return [int(x) for x in lengths]
    top = np.array(lengths, float)
    docs = np.concatenate([[0.0], np.cumsum(np.array(counts, float))])
    # padding of bins i..j-1 under boundary top[j-1], without the tokens themselves, which no choice changes
    best = np.concatenate([[0.0], top * docs[1:]])
    cut = np.zeros((buckets + 1, n + 1), np.int64)
    for k in range(2, buckets + 1):
        now = np.full(n + 1, np.inf)
        todo = [(k, n, k - 1, n - 1)]
        while todo:
            a, b, lo, hi = todo.pop()
            if a > b:
                continue
            j = (a + b) // 2
            i = np.arange(lo, min(hi, j - 1) + 1)
            cost = best[i] + top[j - 1] * (docs[j] - docs[i])
            at = int(np.argmin(cost))
            now[j], cut[k, j] = cost[at], i[at]
            todo += [(a, j - 1, lo, int(i[at])), (j + 1, b, int(i[at]), hi)]
        best = now
    out, j = [], n
    for k in range(buckets, 0, -1):
        out.append(int(top[j - 1]))
        j = int(cut[k, j])
    return out[::-1]


def pack(docs: DataFrame, length: Column, buckets: int = 8, budget: int = 16_384, key: str = "doc_id", order: Sequence[Column] | None = None) -> DataFrame:
    """For each document: ``key``, n_tokens, bucket int, bucket_tokens, batch, slot, batch_docs long.

    ``bucket`` counts from 0; ``bucket_tokens`` is the length that its documents are padded to. Batches are
    numbered from 0 inside a bucket, documents inside a batch by ``slot``; ``batch_docs`` is how many a full batch
    of the bucket holds: the budget divided by bucket_tokens, 1 at least, so a document longer than the budget is
    whole in a batch of its own kind. Inside a bucket documents stand in the given order, or by a hash of ``key``.

    Empty or null texts have length 0 and a bucket like all others. Repeated rows are packed each. An empty table
    gives an empty one. Other columns aren't read. Any bucket may hold any share of the rows: ranks come from one
    range sort. Texts are read once: lengths are written, and all later steps read them. The driver gets the
    histogram, under 16,000 rows.
    """
    ranks = [o.alias(f"__o{i}") for i, o in enumerate([F.xxhash64(key), F.col(key)] if order is None else order)]
    sized = checkpointed(docs.select(F.col(key), length.cast("long").alias("n_tokens"), *ranks, F.monotonically_increasing_id().alias("__salt")))
    sized = sized.withColumn("__bin", F.when(F.col("n_tokens") > 0, binned(F.col("n_tokens"))).otherwise(F.lit(0).cast("long")))
    bins = sized.groupBy("__bin").agg(F.count("*"), F.coalesce(F.max("n_tokens"), F.lit(0)))
    histogram = sorted(tuple(r) for r in bins.collect())
    tops = boundaries([b for b, _, _ in histogram], [c for _, c, _ in histogram], buckets) or [0]
    counts = [sum(c for b, c, _ in histogram if b <= t) for t in tops]
    longest = {b: n for b, _, n in histogram}
    tokens = [max(0, longest.get(t, 0)) for t in tops]
    bucket = F.size(F.filter(F.array(*[F.lit(t).cast("long") for t in tops]), lambda t: t < F.col("__bin")))
    placed = sized.withColumn("bucket", bucket).drop("__bin")
    ranked = global_rank(placed, [F.col("bucket"), *[F.col(f"__o{i}") for i in range(len(ranks))], F.col("n_tokens"), F.col("__salt")], "__rank")
    pick = lambda xs: F.get(F.array(*[F.lit(x).cast("long") for x in xs]), F.col("bucket"))
    inside = F.col("__rank") - pick([0, *counts[:-1]])
    return (
        ranked.withColumn("bucket_tokens", pick(tokens))
        .withColumn("batch_docs", pick([max(1, budget // max(1, t)) for t in tokens]))
        .withColumn("batch", F.floor(inside / F.col("batch_docs")).cast("long"))
        .withColumn("slot", F.pmod(inside, F.col("batch_docs")))
        .select(key, "n_tokens", "bucket", "bucket_tokens", "batch", "slot", "batch_docs")
    )
