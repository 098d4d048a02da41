"""Places inside groups of any size, without a task that sees a whole group."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lectern.session import checkpointed

_ROWS = (1 << 33) - 1


def ranked_in(df: DataFrame, group: Sequence[str], order: Sequence[Column], name: str) -> DataFrame:
    """``df`` with ``name`` long: each row's place in its group, from 1, in the given order.

    One range sort by group and order, written to the checkpoint folder; then one row for each group and partition
    (its first place there and how many rows before it) is joined back. Groups that end inside a partition have one such row,
    so there are about as many as groups; only a group that goes on through partitions has more. The order should
    tell all rows of a group apart.
    """
    n = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    by = [F.col(g).asc_nulls_first() for g in group]
    ranged = df.repartitionByRange(n, *by, *order).sortWithinPartitions(*by, *order)
    kept = checkpointed(ranged.withColumn("__at", F.monotonically_increasing_id()))
    part = F.shiftright("__at", 33)
    spans = kept.groupBy(*group, part.alias("__part")).agg(F.min("__at").alias("__first"), F.count("*").alias("__n"))
    spans = checkpointed(spans)
    # a group has one span for each partition that it reaches into; spans before each are summed without a window
    pairs = spans.alias("a").join(spans.alias("b"), [F.col(f"a.{g}").eqNullSafe(F.col(f"b.{g}")) for g in group] + [F.col("b.__part") < F.col("a.__part")], "left")
    before = pairs.groupBy(*[F.col(f"a.{g}").alias(f"__g{i}") for i, g in enumerate(group)], F.col("a.__part").alias("__p"), F.col("a.__first").alias("__first")).agg(F.coalesce(F.sum("b.__n"), F.lit(0)).alias("__before"))
    match = [F.col(g).eqNullSafe(F.col(f"__g{i}")) for i, g in enumerate(group)] + [part == F.col("__p")]
    out = kept.join(before, match)
    return out.select(*[F.col(c) for c in df.columns], (F.col("__at") - F.col("__first") + F.col("__before") + 1).alias(name))
