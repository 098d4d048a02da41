"""Mixing sources to target weights: a curriculum that changes over training time.

Every source has a schedule, piecewise linear over training time 0 to 1. Its integral is the source's weight; the
weights share out a token budget, and a source's schedule divided by its integral is the density with which its
tokens are wanted over time. A document stands at some depth of its source's supply (documents in the order of a
hash, epoch after epoch); inverting the source's cumulative demand at that depth gives its training position. Sorting
all takes by position gives at every time the mixture that the schedules ask for.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator, Mapping, Sequence
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lectern.llm.names import free, quoted
from lectern.session import checkpointed

Schedule = Sequence[tuple[float, float]]
WORD = r"[^\x20\x09-\x0D]+"


def word_count(text: Column) -> Column:
    """Words of the text; null: 0."""
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def integral(schedule: Schedule) -> float:
    """Area under a piecewise-linear schedule, constant before its first and after its last knot."""
    t, w = _knots(schedule)
    return float(np.sum((w[1:] + w[:-1]) * np.diff(t)) / 2)


def _knots(schedule: Schedule) -> tuple[np.ndarray, np.ndarray]:
    t, w = (np.array(x, float) for x in zip(*sorted(schedule), strict=True))
    if (w < 0).any() or t[0] < 0 or t[-1] > 1:
        raise ValueError("a schedule's times must lie in 0 to 1 and its weights must not be negative")
    return np.concatenate([[0.0], t, [1.0]]), np.concatenate([w[:1], w, w[-1:]])


def invert(schedule: Schedule, share: np.ndarray) -> np.ndarray:
    """Times at which the given shares (0 to 1) of the schedule's area are reached."""
    t, w = _knots(schedule)
    area = np.concatenate([[0.0], np.cumsum((w[1:] + w[:-1]) * np.diff(t) / 2)])
    want = np.clip(np.asarray(share, float), 0, 1) * area[-1]
    i = np.clip(np.searchsorted(area, want, "right") - 1, 0, len(t) - 2)
    left, span = want - area[i], t[i + 1] - t[i]
    slope = np.divide(w[i + 1] - w[i], span, out=np.zeros(len(i)), where=span > 0)
    root = w[i] + np.sqrt(np.maximum(w[i] * w[i] + 2 * slope * left, 0))
    return np.minimum(t[i] + np.divide(2 * left, root, out=np.zeros(len(i)), where=root > 0), 1.0)


def targets(sizes: Mapping[str | None, int], weights: Mapping[str | None, float], budget: float, most: float) -> dict[str | None, float]:
    """Budget shares by weight, none above ``most`` times its source's size; the excess goes to the others by weight."""
    ranked = sorted(sizes, key=lambda s: (most * sizes[s] / weights[s] if weights[s] > 0 else 0.0, s is None, s or ""))
    left, weight, level = budget, sum(weights[s] for s in ranked), 0.0
    out: dict[str | None, float] = {}
    for s in ranked:
        level = left / weight if weight > 0 else 0.0
        if weights[s] > 0 and most * sizes[s] < level * weights[s]:
            out[s] = float(most * sizes[s])
            left, weight = left - most * sizes[s], weight - weights[s]
        else:
            out[s] = level * weights[s]
    return out


@dataclass(frozen=True)
class _Plan:
    starts: dict[tuple[int, str | None], int]
    sizes: dict[str | None, int]
    targets: dict[str | None, float]
    schedules: dict[str | None, Schedule]
    epochs: int

    def __call__(self, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for f in batches:
            n = f.num_rows
            size, before = (f.column(c).to_numpy(zero_copy_only=False) for c in ("size", "before"))
            parts, sources = f.column("part").to_numpy(zero_copy_only=False), np.array(f.column("source").to_pylist(), object)
            positions: list[list[float]] = [[] for _ in range(n)]
            total, target = np.zeros(n, np.int64), np.zeros(n)
            for a, b in _runs(parts, sources):
                s = sources[a]
                total[a:b], target[a:b] = self.sizes[s], self.targets[s]
                if not self.targets[s]:
                    continue
                depth = before[a:b] + self.starts[parts[a], s]
                for e in range(self.epochs):
                    at = depth + e * self.sizes[s]
                    # a take counts if its middle lies within the target: the total is off by half a document at most
                    got = np.flatnonzero((2 * at + size[a:b] <= 2 * self.targets[s]) & (size[a:b] > 0))
                    for i, t in zip(got, invert(self.schedules[s], at[got] / self.targets[s]), strict=True):
                        positions[a + i].append(float(t))
            taken = size * np.array([len(p) for p in positions], np.int64)
            kept = [(f.schema.field(i).name, f.column(i)) for i in range(f.num_columns) if f.schema.field(i).name not in ("before", "part")]
            made = [("source_size", pa.array(total)), ("target", pa.array(target)), ("taken", pa.array(taken)), ("positions", pa.array(positions, pa.list_(pa.float64())))]
            names, columns = zip(*kept, *made, strict=True)
            yield pa.RecordBatch.from_arrays(list(columns), list(names))


def _runs(*keys: np.ndarray) -> list[tuple[int, int]]:
    """Ranges of neighbouring rows with equal keys."""
    n = len(keys[0])
    if not n:
        return []
    edge = np.ones(n, bool)
    edge[1:] = np.logical_or.reduce([k[1:] != k[:-1] for k in keys])
    begin = np.flatnonzero(edge)
    return list(zip(begin, [*begin[1:], n], strict=True))


def _depths(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Fills ``before``: the source's tokens in this partition above each row."""
    last, carried = object(), 0
    for f in batches:
        source, sizes = np.array(f.column("source").to_pylist(), object), f.column("size").to_numpy(zero_copy_only=False)
        before = np.zeros(f.num_rows, np.int64)
        for a, b in _runs(source):
            carried = carried if source[a] == last else 0
            sums = np.cumsum(sizes[a:b])
            before[a:b] = carried + sums - sizes[a:b]
            last, carried = source[a], carried + int(sums[-1])
        yield f.set_column(f.schema.get_field_index("before"), "before", pa.array(before))


def mix(
    docs: DataFrame,
    schedule_of: Callable[[Sequence[str | None]], Mapping[str | None, Schedule]],
    size: Column,
    key: Column | None = None,
    tie: Sequence[Column] = (),
    budget: int | None = None,
    epochs: int = 3,
    keep: Sequence[str] = ("doc_id",),
) -> DataFrame:
    """The columns ``keep``, source, size, source_size long, target double, taken long, positions array<double>.

    ``schedule_of`` gives a schedule for each source; it gets the sources by code point, null last. ``size`` counts
    a document's tokens; ``key`` (md5 of doc_id) orders a source's supply, then ``tie``. ``budget`` defaults to all
    sizes. No source takes more than ``epochs`` times its size, no document more than ``epochs`` times. ``positions``
    holds one training time for each take, rising; documents of size 0 are never taken.

    Null sources are a source of their own. Repeated rows count each. An empty table gives an empty one. Other
    columns of ``docs`` are not read. A very long text is counted like any other. A source may hold any share of the
    rows, and so may a key: a source's supply is summed by a range sort that ends in a row number. Texts are read once:
    what is sorted are written sizes and keys. One total for each source, and one more where it goes on in another
    partition, reaches the driver, about 100 bytes each; there may be any number of sources that it can hold so.
    """
    spark = docs.sparkSession
    key = F.md5(F.coalesce(F.col("doc_id").cast("string"), F.lit(""))) if key is None else key
    ties = [t.alias(f"__t{i}") for i, t in enumerate(tie)]
    slim = docs.select(*keep, F.col("source"), size.alias("size"), key.alias("__key"), *ties, F.monotonically_increasing_id().alias("__salt"))
    order = [F.col("source").asc_nulls_last(), F.col("__key"), F.col("size"), *[F.col(f"__t{i}") for i in range(len(ties))], F.col("__salt")]
    n = int(spark.conf.get("spark.sql.shuffle.partitions"))
    ranged = checkpointed(slim).repartitionByRange(n, *order).sortWithinPartitions(*order).drop("__key", "__salt", *[f"__t{i}" for i in range(len(ties))])
    ranged = ranged.withColumn("part", F.spark_partition_id()).withColumn("before", F.lit(0).cast("long"))

    placed = checkpointed(ranged.mapInArrow(_depths, ranged.schema))
    totals = placed.groupBy("part", "source").agg(F.sum("size").alias("size")).toArrow()
    sizes: dict[str | None, int] = {}
    starts: dict[tuple[int, str | None], int] = {}
    for part, source, total in sorted(zip(*(totals[c].to_pylist() for c in ("part", "source", "size")), strict=True), key=lambda r: r[0]):
        starts[part, source] = sizes.get(source, 0)
        sizes[source] = sizes.get(source, 0) + total
    schedules = dict(schedule_of(sorted(sizes, key=lambda s: (s is None, s or ""))))
    want = targets(sizes, {s: integral(schedules[s]) for s in sizes}, sum(sizes.values()) if budget is None else budget, epochs)
    schema = ", ".join(f"`{c}` {t}" for c, t in placed.drop("before", "part").dtypes) + ", source_size long, target double, taken long, positions array<double>"
    return placed.mapInArrow(_Plan(starts, sizes, want, schedules, epochs), schema)


# Weights 1, 2 and 3 as falling, constant and rising schedules of those areas.
CURRICULUM: tuple[Schedule, ...] = (((0.0, 2.0), (1.0, 0.0)), ((0.0, 2.0), (1.0, 2.0)), ((0.0, 0.0), (1.0, 6.0)))


def in_turn(sources: Sequence[str | None]) -> dict[str | None, Schedule]:
    """Sources in order get weights 1, 2, 3, repeating."""
    return {s: CURRICULUM[i % len(CURRICULUM)] for i, s in enumerate(sources)}


def _plain(df: DataFrame, name: str) -> Column:
    """A column as something that can be hashed."""
    kind = df.schema[name].dataType.simpleString()
    return F.to_json(F.struct(F.col(quoted(name)))) if "map<" in kind or "variant" in kind else F.col(quoted(name))


def mixed_rows(docs: DataFrame, schedule_of: Callable[[Sequence[str | None]], Mapping[str | None, Schedule]], size: Column, budget: int | None = None, epochs: int = 3) -> DataFrame:
    """``docs`` as training takes them: a row for each take, sorted by training position; columns as they were.

    Documents that aren't taken, those of size 0 among them, are left out. Rows that are equal in all columns are
    one row with the takes of all of them, so a row may be repeated any number of times; other names may be any.
    """
    row, at, one = free(docs, "row", "at", "one")
    parts = [x for c in docs.columns for x in (F.col(quoted(c)).isNull(), _plain(docs, c))]
    numbered = docs.withColumn(row, F.xxhash64(*parts))
    takes = mix(numbered, schedule_of, size, tie=[F.col(row)], budget=budget, epochs=epochs, keep=(row,))
    takes = takes.select(row, F.explode("positions").alias(at))
    rows = numbered.groupBy(row).agg(F.any_value(F.struct(*[quoted(c) for c in docs.columns])).alias(one))
    # a key that Spark takes for another one: both sides of the join come from exchanges that it can split
    rows = rows.withColumn(row, F.bitwise_not(F.bitwise_not(F.col(row))))
    return takes.join(rows, row).orderBy(at, row).select(*[F.col(f"{one}.{quoted(c)}") for c in docs.columns])


MIX_SQL = r"""
WITH sized AS (SELECT doc_id, source, len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+'))::BIGINT AS size FROM documents),
src AS (SELECT source, sum(size)::BIGINT AS source_size, 1 + (row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3 AS w FROM sized GROUP BY source),
cap AS (SELECT *, sum(3 * source_size) OVER o AS caps, sum(w) OVER o AS ws, sum(source_size) OVER () AS total, sum(w) OVER () AS weights, row_number() OVER o AS k FROM src WINDOW o AS (ORDER BY 3.0::DOUBLE * source_size / w, source NULLS LAST)),
lev AS (SELECT *, (total - (caps - 3 * source_size))::DOUBLE / (weights - (ws - w))::DOUBLE AS level FROM cap),
free AS (SELECT min(k) AS k FROM lev WHERE NOT (3.0::DOUBLE * source_size < level * w)),
tgt AS (SELECT lev.source, lev.source_size, lev.w, CASE WHEN lev.k < free.k THEN 3.0::DOUBLE * lev.source_size::DOUBLE ELSE (SELECT level FROM lev l2 WHERE l2.k = free.k) * lev.w END AS target FROM lev, free),
run AS (SELECT s.doc_id, s.size, t.source_size, t.target::DOUBLE AS target, t.w,
  (sum(s.size) OVER (PARTITION BY s.source ORDER BY md5(coalesce(s.doc_id::VARCHAR, '')), s.size ROWS UNBOUNDED PRECEDING) - s.size)::BIGINT AS before
  FROM sized s JOIN tgt t ON s.source IS NOT DISTINCT FROM t.source),
took AS (SELECT *, CASE WHEN size = 0 THEN 0 ELSE (2 * before + size <= 2 * target)::INT + (2 * (before + source_size) + size <= 2 * target)::INT + (2 * (before + 2 * source_size) + size <= 2 * target)::INT END AS takes FROM run)
SELECT doc_id, size, source_size, target, (size * takes)::BIGINT AS taken,
  CASE WHEN takes > 0 THEN round(CASE w WHEN 1 THEN 1 - sqrt(1 - before / target) WHEN 2 THEN before / target ELSE sqrt(before / target) END, 6) END AS position
FROM took
"""
