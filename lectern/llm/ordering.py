"""Global ranks of any size without a single task that sees all rows."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lectern.session import checkpointed

_ROWS = (1 << 33) - 1


def global_rank(df: DataFrame, order: Sequence[Column], name: str = "rank") -> DataFrame:
    """``df`` with ``name`` long: 0, 1, ... in the given order; rows that tie get different ranks.

    One range shuffle of ``df`` (keep it narrow), written to the checkpoint folder so that later jobs see the same
    partitions. Only one row count for each partition reaches the driver. ``order`` should end in a key that no
    large group shares: rows with equal keys stay in one partition. An empty table stays empty.
    """
    n = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    ranged = df.repartitionByRange(n, *order).sortWithinPartitions(*order)
    kept = checkpointed(ranged.withColumn("__at", F.monotonically_increasing_id()))
    part = F.shiftright("__at", 33)
    counts = sorted(kept.groupBy(part.alias("part")).count().collect())
    starts, total = {}, 0
    for p, c in counts:
        starts[p] = total
        total += c
    if not starts:
        return kept.withColumn(name, F.col("__at")).drop("__at")
    # a list by partition number: partitions without rows hold a start that nothing reads
    table = F.array(*[F.lit(starts.get(p, 0)).cast("long") for p in range(max(starts) + 1)])
    return kept.withColumn(name, F.get(table, part.cast("int")) + F.col("__at").bitwiseAND(F.lit(_ROWS))).drop("__at")
