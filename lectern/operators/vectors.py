"""Vector similarity: pairs against a bounded side, nearest matches, coverage and missing items."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lectern.session import checkpointed

#: Vectors of a block, the part of a side that a task holds; a cell's similarities take 32 MB.
BLOCK = 2_048


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, x: s + x)


def cosine(a: Column, b: Column) -> Column:
    """Cosine in doubles, a zero norm counting as 1."""
    def norm(v: Column) -> Column:
        n = F.sqrt(dot(v, v))
        return F.when(n == 0, 1.0).otherwise(n)

    return dot(a, b) / (norm(a) * norm(b))


def unit(v: Column) -> Column:
    """The vector scaled to length 1 (a zero vector stays), so that a dot product is a cosine."""
    return F.transform(v, lambda x: x.cast("double") / F.when(F.sqrt(dot(v, v)) == 0, 1.0).otherwise(F.sqrt(dot(v, v))))


def _matrix(vectors) -> np.ndarray:
    """Unit vectors as rows; a zero vector stays."""
    m = np.stack([np.asarray(v, float) for v in vectors]) if len(vectors) else np.zeros((0, 1))
    n = np.linalg.norm(m, axis=1, keepdims=True)
    return m / np.where(n == 0, 1, n)


def blocks(rows: DataFrame, key: str, vector: str) -> tuple[DataFrame, int]:
    """(key, v, block, rows' key and vector) dealt by hash into blocks of about BLOCK vectors, and how many there are."""
    n = max(1, -(-rows.count() // BLOCK))
    return rows.select(F.col(key).alias("key"), F.col(vector).cast("array<double>").alias("v"), F.pmod(F.xxhash64(key), F.lit(n)).cast("int").alias("block")), n


def met(rows: DataFrame, key: str, vector: str, side: DataFrame, side_key: str, side_vector: str, made, schema: str) -> DataFrame:
    """``made(keys, similarities, side keys)`` for every block of rows against every block of the side.

    Each cell, a block of either, is one group: no task holds more than two blocks, nothing reaches the driver, and
    rows go to as many cells as the other side has blocks. Similarities are rounded to nine places.
    """
    left, m = blocks(rows, key, vector)
    right, n = blocks(side, side_key, side_vector)
    every = lambda k: F.explode(F.sequence(F.lit(0), F.lit(k - 1)))
    a = left.select("key", "v", F.col("block").alias("i"), every(n).alias("j"))
    b = right.select("key", "v", every(m).alias("i"), F.col("block").alias("j"))

    def run(x: pd.DataFrame, y: pd.DataFrame) -> pd.DataFrame:
        x, y = x.sort_values("key"), y.sort_values("key")
        if not len(x) or not len(y):
            return made(x["key"].to_numpy()[:0], np.zeros((0, 0)), y["key"].to_numpy()[:0])
        return made(x["key"].to_numpy(), np.round(_matrix(x["v"]) @ _matrix(y["v"]).T, 9), y["key"].to_numpy())

    return a.groupBy("i", "j").cogroup(b.groupBy("i", "j")).applyInPandas(run, schema)


def best_match(rows: DataFrame, key: str, vector: str, side: DataFrame, side_key: str, side_vector: str) -> DataFrame:
    """(key, match, similarity): for each row the most similar of a side's vectors, the first key of equals.

    The side may be of any size. A row of an empty side has a null match.
    """
    def best(keys, sim, others) -> pd.DataFrame:
        at = sim.argmax(1) if sim.size else np.zeros(0, int)
        return pd.DataFrame({"key": keys[: len(at)], "match": others[at], "similarity": sim[np.arange(len(at)), at] if len(at) else np.zeros(0)})

    kinds, own = dict(side.dtypes), dict(rows.dtypes)
    part = met(rows, key, vector, side, side_key, side_vector, best, f"key {own[key]}, match {kinds[side_key]}, similarity double")
    top = part.groupBy("key").agg(F.min(F.struct((-F.col("similarity")).alias("s"), "match")).alias("m"))
    found = top.select(F.col("key").alias(key), F.col("m.match").alias("match"), (-F.col("m.s")).alias("similarity"))
    return rows.select(key).join(found, key, "left")


def nearest(queries: DataFrame, rows: DataFrame, key: str, vector: str, k: int) -> DataFrame:
    """(query, key, similarity): the k most similar rows of each query, the first keys of equals; itself counts too."""
    def top(keys, sim, others) -> pd.DataFrame:
        out = []
        for i, q in enumerate(keys):
            at = np.lexsort((others, -sim[i]))[:k]
            out.append(pd.DataFrame({"query": q, "key": others[at], "similarity": sim[i, at]}))
        return pd.concat(out) if out else pd.DataFrame({"query": keys, "key": others, "similarity": np.zeros(0)})

    kind = dict(rows.dtypes)[key]
    part = met(queries, key, vector, rows, key, vector, top, f"query {kind}, key {kind}, similarity double")
    # at most k rows of a query for each block of rows; the best k of them by one array for each query
    best = F.slice(F.array_sort(F.collect_list(F.struct((-F.col("similarity")).alias("s"), "key"))), 1, k)
    flat = part.groupBy("query").agg(best.alias("b")).select("query", F.explode("b").alias("b"))
    return flat.select("query", F.col("b.key").alias(key), (-F.col("b.s")).alias("similarity"))


def similarities(queries: DataFrame, rows: DataFrame, key: str, vector: str) -> DataFrame:
    """(query, key, similarity) of every query and every row: as many rows as the two sides multiply to."""
    def every(keys, sim, others) -> pd.DataFrame:
        return pd.DataFrame({"query": np.repeat(keys, len(others)), "key": np.tile(others, len(keys)), "similarity": sim.reshape(-1)})

    kind = dict(rows.dtypes)[key]
    return met(queries, key, vector, rows, key, vector, every, f"query {kind}, key {kind}, similarity double").withColumnRenamed("key", key)


def count_above(rows: DataFrame, key: str, vector: str, side: DataFrame, threshold: float) -> DataFrame:
    """One row, pairs long: entries of the matrix rows x side above the threshold, self pairs and both orders included."""
    def count(keys, sim, others) -> pd.DataFrame:
        return pd.DataFrame({"n": [int((sim > threshold).sum())]})

    return met(rows, key, vector, side, key, vector, count, "n long").agg(F.coalesce(F.sum("n"), F.lit(0)).alias("pairs"))


def keep_share(rows: DataFrame, group: list[str], score: str, key: str, share: float) -> DataFrame:
    """Of each group the ``ceil(share * n)`` rows with the highest scores (one at least), the first keys of equals.

    A group may have any number of rows: places come from one range sort.
    """
    from lectern.operators.ranks import ranked_in

    n = rows.groupBy(*group).agg(F.greatest(F.lit(1), F.ceil(F.count("*") * F.lit(share))).cast("long").alias("__quota"))
    return ranked_in(rows, group, [F.col(score).desc(), F.col(key)], "__place").join(n, group).where("__place <= __quota").drop("__place", "__quota")


#: Values of a cell that stand for its part of a query's bracket, and rows of a bracket that are sorted at once.
STEPS, FEW = 32, 2_048
#: Similarities in units of their ninth place; above them, the range of places in a block.
_UNITS, _PLACES = 10**9, 1 << 20
_BRACKET = "low long, low_key long, high long, high_key long"


def _ordered(x: pd.DataFrame, y: pd.DataFrame) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Of a cell: its keys in order, each query's codes of all rows (falling similarity, then key) and those of its bracket's ends.

    A code is the negative similarity in units, then the row's place in the cell.
    """
    y = y.sort_values("key")
    keys = y["key"].to_numpy(np.int64)
    sim = np.nan_to_num(np.rint(_matrix(x["v"]) @ _matrix(y["v"]).T * _UNITS), nan=2 * _UNITS)
    codes = -sim.astype(np.int64) * _PLACES + np.arange(len(keys))
    low, high = (x[c].to_numpy(np.int64) * _PLACES + np.searchsorted(keys, x[f"{c}_key"].to_numpy(np.int64), "right") - 1 for c in ("low", "high"))
    return keys, codes, low, high


def _told(x: pd.DataFrame, y: pd.DataFrame) -> pd.DataFrame:
    """For each query how many of the cell's rows come before its bracket and stand in it, and every so many-th of these: value, key, how many it ends."""
    keys, codes, low, high = _ordered(x, y)
    codes.sort(axis=1)
    out = []
    for row, a, b in zip(codes, low, high, strict=True):
        first, last = np.searchsorted(row, [a, b], "right")
        step = max(1, -(-(last - first) // STEPS))
        at = np.unique(np.append(np.arange(first + step - 1, last, step), last - 1)) if last > first else np.zeros(0, int)
        told = np.stack([row[at] // _PLACES, keys[row[at] % _PLACES], np.diff(at, prepend=first - 1)]).astype(np.int64)
        out.append((int(first), int(last - first), int(step - 1), told.tobytes()))
    return pd.DataFrame({"query": x["key"].to_numpy(), **{c: [r[i] for r in out] for i, c in enumerate(("before", "inside", "slack", "told"))}})


def _narrowed(frames):
    """From (query, quota, bracket, cells): the bracket within it that the cells' values allow, and what is known of the old one."""
    for f in frames:
        made = []
        for quota, low, low_key, high, high_key, cells in zip(*(f[c] for c in ("quota", "low", "low_key", "high", "high_key", "cells")), strict=True):
            want = quota - sum(c["before"] for c in cells)
            slack = sum(c["slack"] for c in cells)
            value, key, n = np.concatenate([np.frombuffer(c["told"], np.int64).reshape(3, -1) for c in cells], axis=1)
            order = np.lexsort((key, value))
            value, key, least = value[order], key[order], np.cumsum(n[order])  # as many rows at least come up to each
            at = int(np.searchsorted(least, want))
            high, high_key = int(value[at]), int(key[at])
            at = int(np.searchsorted(least + slack, want)) - 1  # fewer rows than wanted come up to it for certain
            if at >= 0:
                low, low_key = int(value[at]), int(key[at])
            made.append((low, low_key, high, high_key, sum(c["inside"] for c in cells)))
        kept = dict(zip(("low", "low_key", "high", "high_key", "had"), zip(*made, strict=True), strict=True)) if made else {c: [] for c in ("low", "low_key", "high", "high_key", "had")}
        yield pd.DataFrame({"query": f["query"], "quota": f["quota"], **kept})


def _bracketed(x: pd.DataFrame, y: pd.DataFrame) -> pd.DataFrame:
    """For each query how many of the cell's rows come before its bracket (key null), and the rows in it."""
    keys, codes, low, high = _ordered(x, y)
    up = codes <= low[:, None]
    i, j = np.nonzero(~up & (codes <= high[:, None]))
    query = x["key"].to_numpy()
    inside = pd.DataFrame({"query": query[i], "before": 0, "key": pd.array(keys[j], "Int64"), "value": codes[i, j] // _PLACES})
    return pd.concat([pd.DataFrame({"query": query, "before": up.sum(1), "key": pd.array([None] * len(query), "Int64"), "value": 0}), inside])


def _sure(x: pd.DataFrame, y: pd.DataFrame) -> pd.DataFrame:
    """The rows before the brackets."""
    keys, codes, low, _ = _ordered(x, y)
    i, j = np.nonzero(codes <= low[:, None])
    return pd.DataFrame({"query": x["key"].to_numpy()[i], "key": keys[j]})


def nearest_share(queries: DataFrame, rows: DataFrame, key: str, vector: str, share: float) -> DataFrame:
    """(query, key): of each query the ``ceil(share * n)`` most similar of n rows (one at least), the first keys of equals.

    What :func:`keep_share` gives of all :func:`similarities`, of which none are written or dealt out here. Each query
    has a bracket that its last row stands in; a cell tells how many rows come before it and every so many-th of those in it,
    which gives a narrower one. When brackets hold few rows, these are sorted; all before a bracket are kept as they
    are found again. Similarities are made anew in each round. Keys are whole numbers and name one row each.
    """
    left, m = blocks(queries, key, vector)
    right, n = blocks(rows, key, vector)
    kind = dict(rows.dtypes)[key]
    every = lambda k: F.explode(F.sequence(F.lit(0), F.lit(k - 1)))
    dealt = right.select("key", "v", every(m).alias("i"), F.col("block").alias("j")).where(F.col("key").isNotNull())
    quota = F.greatest(F.lit(1), F.ceil(F.lit(rows.count()) * F.lit(share))).cast("long")
    ends = [F.lit(x).cast("long").alias(c) for c, x in (("low", -3 * _UNITS), ("low_key", -(1 << 63)), ("high", 3 * _UNITS), ("high_key", (1 << 63) - 1))]
    brackets = left.select(F.col("key").alias("query"), quota.alias("quota"), *ends)

    def cells(brackets: DataFrame, made, schema: str) -> DataFrame:
        held = left.join(brackets.withColumnRenamed("query", "key"), "key").withColumnRenamed("block", "i").withColumn("j", every(n))
        return held.groupBy("i", "j").cogroup(dealt.groupBy("i", "j")).applyInPandas(lambda x, y: made(x, y) if len(x) and len(y) else pd.DataFrame(), schema)

    had = None
    while True:
        told = cells(brackets, _told, "query long, before long, inside long, slack long, told binary")
        told = told.groupBy("query").agg(F.collect_list(F.struct("before", "inside", "slack", "told")).alias("cells"))
        brackets = checkpointed(brackets.join(told, "query").mapInPandas(_narrowed, f"query long, quota long, {_BRACKET}, had long"))
        most = brackets.agg(F.max("had")).first()[0]
        brackets = brackets.drop("had")
        # a new bracket holds about two in STEPS of what the old one had
        if most is None or most <= FEW * STEPS // 2 or most == had:
            break
        had = most
    part = checkpointed(cells(brackets, _bracketed, "query long, before long, key long, value long"))
    before = part.where("key IS NULL").groupBy("query").agg(F.sum("before").alias("before"))
    first = F.array_sort(F.collect_list(F.struct("value", "key"))).alias("b")
    last = part.where("key IS NOT NULL").groupBy("query").agg(first).join(before, "query").join(brackets.select("query", "quota"), "query")
    last = last.select("query", F.explode(F.slice("b", F.lit(1), (F.col("quota") - F.col("before")).cast("int"))).alias("b")).select("query", "b.key")
    both = cells(brackets, _sure, "query long, key long").union(last)
    return both.select("query", F.col("key").cast(kind).alias(key))


def coverage_status(similarity: Column, weak: float = 0.45, covered: float = 0.55) -> Column:
    """missing below ``weak``, covered above ``covered``, both strict; else weakly covered."""
    return F.when(similarity.isNull() | (similarity < weak), "missing").when(similarity > covered, "covered").otherwise("weakly covered")


def greedy_accept(names: list[str], vectors: np.ndarray, accepted: np.ndarray, below: float = 0.5) -> list[str]:
    """Of clusters in order, those whose similarity to all accepted before stays below a bound; order matters."""
    have, out = [v / (np.linalg.norm(v) or 1) for v in accepted], []
    for name, v in zip(names, vectors, strict=True):
        u = v / (np.linalg.norm(v) or 1)
        if max([0.0, *(float(u @ h) for h in have)]) < below:
            have.append(u)
            out.append(name)
    return out
