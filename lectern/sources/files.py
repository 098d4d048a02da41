"""File sources and sinks: JSON lines, whole JSON documents, keyed maps, resumable outputs."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType


def json_lines(spark: SparkSession, path: str, schema: StructType | str | None = None, strict: bool = True) -> DataFrame:
    """One object a line; blank lines are skipped. A malformed line fails the job if strict, else it is dropped."""
    reader = spark.read.option("mode", "FAILFAST" if strict else "DROPMALFORMED")
    return (reader.schema(schema) if schema is not None else reader).json(path)


def json_document(spark: SparkSession, path: str, schema: StructType | str | None = None) -> DataFrame:
    reader = spark.read.option("multiLine", True)
    return (reader.schema(schema) if schema is not None else reader).json(path)


def whole_files(spark: SparkSession, path: str) -> DataFrame:
    """(path, content binary) of files already landed."""
    return spark.read.format("binaryFile").load(path).select("path", "content")


def numbered_lines(spark: SparkSession, path: str, schema: str, start: int = 0) -> DataFrame:
    """(file, index, columns): lines of each file numbered in file order from 0, blank ones counted but left out, from
    ``start`` on.

    A file may be of any size: it is read in splits, whose lines are counted first; one count for each split reaches
    the driver, and a line's number is its place in its split after the lines of the splits before.
    """
    at = F.col("_metadata.file_block_start")
    lines = spark.read.text(path).select(F.col("_metadata.file_path").alias("file"), at.alias("split"), F.monotonically_increasing_id().alias("row"), "value")
    first = lines.groupBy("file", "split").agg(F.min("row").alias("first"), F.count("*").alias("n"))
    before = {}
    total: dict[str, int] = {}
    for r in sorted(first.collect(), key=lambda r: (r["file"], r["split"])):
        before[r["file"], r["split"]] = (r["first"], total.get(r["file"], 0))
        total[r["file"]] = total.get(r["file"], 0) + r["n"]
    known = spark.createDataFrame([(f, s, x, b) for (f, s), (x, b) in before.items()], "file string, split long, first long, before long")
    rows = lines.join(F.broadcast(known), ["file", "split"]).withColumn("index", F.col("row") - F.col("first") + F.col("before"))
    rows = rows.where((F.trim("value") != "") & (F.col("index") >= start))
    return rows.select("file", "index", F.from_json("value", schema).alias("r")).select("file", "index", "r.*")


def by_key(df: DataFrame, key: Column, order: Column) -> DataFrame:
    """The last row of each key in the given order; rows are compared before they are dealt out, so a key may have any number."""
    return df.groupBy(key.alias("__key")).agg(F.max_by(F.struct(*df.columns), order).alias("__r")).select("__r.*")


def at_index(df: DataFrame, index: str, wanted: object) -> DataFrame:
    return df.where(F.col(index).cast("string") == str(wanted)).limit(1)


def write_lines(df: DataFrame, path: str, append: bool = False) -> None:
    df.write.mode("append" if append else "overwrite").option("ignoreNullFields", False).json(path)


def pending(df: DataFrame, done: DataFrame, keys: list[str]) -> DataFrame:
    """Rows whose keys the finished output lacks."""
    return df.join(done.select(*keys).distinct(), keys, "left_anti")


def write_by_key(df: DataFrame, path: str, key: str, index_path: str | None = None) -> None:
    """A folder for each key value, and a summary of counts beside it."""
    df.write.mode("overwrite").partitionBy(key).json(path)
    if index_path:
        df.groupBy(key).count().write.mode("overwrite").json(index_path)


def merged_state(parts: list[DataFrame], key: str, lists: list[str]) -> DataFrame:
    """Outputs of several critics as one row for each key: list columns joined, other columns the last that isn't null."""
    every = parts[0].withColumn("__i", F.lit(0))
    for i, p in enumerate(parts[1:], 1):
        every = every.unionByName(p.withColumn("__i", F.lit(i)), allowMissingColumns=True)
    rest = [c for c in every.columns if c not in (key, "__i", *lists)]
    last = [F.max(F.when(F.col(c).isNotNull(), F.struct("__i", F.col(c).alias("v"))))["v"].alias(c) for c in rest]
    joined = [F.flatten(F.transform(F.array_sort(F.collect_list(F.struct("__i", F.coalesce(c, F.array().cast(dict(every.dtypes)[c])).alias("v")))), lambda s: s["v"])).alias(c) for c in lists]
    return every.groupBy(key).agg(*last, *joined)
