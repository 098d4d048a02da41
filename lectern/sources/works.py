"""A bibliographic source read through Spark's Python Data Source API, with a paged backend behind an interface.

A backend answers page requests; the stand-in serves a list of records, so everything runs without a network. Filters
on equality and ranges and the columns asked for are pushed into the requests.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence
from typing import Any, Protocol

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, EqualTo, Filter, GreaterThan, GreaterThanOrEqual, InputPartition, LessThan, LessThanOrEqual

WORK = "id string, title string, abstract string, publication_date string, cited_by_count long, referenced_works array<string>"
MOST_PER_PAGE = 200


class Backend(Protocol):
    def count(self, filters: Sequence[tuple[str, str, Any]]) -> int: ...

    def page(self, number: int, size: int, filters: Sequence[tuple[str, str, Any]]) -> list[dict]: ...


_OPS = {"=": lambda a, b: a == b, ">": lambda a, b: a > b, ">=": lambda a, b: a >= b, "<": lambda a, b: a < b, "<=": lambda a, b: a <= b}


class ListBackend:
    """Serves records held in memory."""

    def __init__(self, records: Sequence[dict]) -> None:
        self.records = list(records)

    def _kept(self, filters: Sequence[tuple[str, str, Any]]) -> list[dict]:
        return [r for r in self.records if all(r.get(c) is not None and _OPS[op](r[c], v) for c, op, v in filters)]

    def count(self, filters: Sequence[tuple[str, str, Any]]) -> int:
        return len(self._kept(filters))

    def page(self, number: int, size: int, filters: Sequence[tuple[str, str, Any]]) -> list[dict]:
        return self._kept(filters)[number * size : (number + 1) * size]


class _Page(InputPartition):
    def __init__(self, number: int) -> None:
        self.number = number


class _Reader(DataSourceReader):
    def __init__(self, backend: Backend, names: list[str], size: int) -> None:
        self.backend, self.names, self.size, self.filters = backend, names, size, []

    def pushFilters(self, filters: list[Filter]) -> Iterator[Filter]:
        kinds = {EqualTo: "=", GreaterThan: ">", GreaterThanOrEqual: ">=", LessThan: "<", LessThanOrEqual: "<="}
        for f in filters:
            if type(f) in kinds and len(f.attribute) == 1:
                self.filters.append((f.attribute[0], kinds[type(f)], f.value))
            else:
                yield f

    def partitions(self) -> list[_Page]:
        return [_Page(i) for i in range(max(1, -(-self.backend.count(self.filters) // self.size)))]

    def read(self, partition: _Page) -> Iterator[tuple]:
        for r in self.backend.page(partition.number, self.size, self.filters):
            yield tuple(r.get(c) for c in self.names)


def source(backend: Backend, name: str = "works", schema: str = WORK, size: int = MOST_PER_PAGE) -> type[DataSource]:
    """A data source class over a backend; register it with ``spark.dataSource.register``;
    ``spark.sql.python.filterPushdown.enabled`` must be on."""
    if not 0 < size <= MOST_PER_PAGE:
        raise ValueError(f"pages hold 1 to {MOST_PER_PAGE} rows")
    names = [c.strip().split(" ")[0] for c in schema.split(",")]

    class Works(DataSource):
        @classmethod
        def name(cls) -> str:
            return name

        def schema(self) -> str:
            return schema

        def reader(self, schema) -> DataSourceReader:
            return _Reader(backend, [f.name for f in schema.fields] if hasattr(schema, "fields") else names, size)

    return Works


def normalized_works(raw: DataFrame) -> DataFrame:
    """Raw records as works: ids without their url, titles squeezed, those without a title left out, abstracts from
    inverted indexes, the creation date where there is no publication date."""
    from lectern.functions.scalars import abstract_of
    from lectern.functions.text import squeezed

    bare = lambda c: F.regexp_replace(c, r"^https?://[^/]+/", "")
    return raw.select(
        bare(F.col("id")).alias("id"), squeezed(F.col("title")).alias("title"), abstract_of(F.col("abstract_inverted_index")).alias("abstract"),
        F.coalesce("publication_date", "created_date").alias("publication_date"), F.coalesce("cited_by_count", F.lit(0)).alias("cited_by_count"),
        F.transform("referenced_works", bare).alias("referenced_works"), F.array(bare(F.col("id"))).alias("ids"),
    ).where(F.coalesce("title", F.lit("")) != "")


def autocomplete(records: DataFrame, title: str, prefix: str, weight: str, key: str, most: int = 10) -> DataFrame:
    """The heaviest records whose title starts with the prefix, whatever its case."""
    return records.where(F.startswith(F.lower(title), F.lit(prefix.lower()))).orderBy(F.col(weight).desc(), key).limit(most)


def searched(records: DataFrame, columns: Sequence[str], terms: str) -> DataFrame:
    """Records that hold every word of ``terms`` in one of the columns; further filters and columns reach the scan."""
    text = F.lower(F.concat_ws(" ", *columns))
    out = records
    for term in terms.lower().split():
        out = out.where(F.contains(text, F.lit(term)))
    return out


def first_success(attempts: DataFrame, key: str, order: str, ok: str) -> DataFrame:
    """Of each key's attempts the first that succeeded."""
    good = attempts.where(ok)
    return good.groupBy(key).agg(F.min(F.struct(order, *[c for c in good.columns if c not in (key, order)])).alias("m")).select(key, "m.*")


def cascade(keys: DataFrame, key: str, steps: list[tuple[str, DataFrame]], value: str) -> DataFrame:
    """(key, value, step): each key's value from the first step that has one. steps: (name, DataFrame of key, value)."""
    out = keys.select(key).distinct()
    for i, (_, df) in enumerate(steps):
        out = out.join(df.groupBy(key).agg(F.min(value).alias(f"__v{i}")), key, "left")
    which: Column = F.coalesce(*[F.when(F.col(f"__v{i}").isNotNull(), F.lit(n)) for i, (n, _) in enumerate(steps)])
    return out.select(key, F.coalesce(*[F.col(f"__v{i}") for i in range(len(steps))]).alias(value), which.alias("step"))


def in_memory(spark: SparkSession, records: Sequence[dict]) -> DataFrame:
    """The stand-in source over a list of records."""
    cls = source(ListBackend(records))
    spark.conf.set("spark.sql.python.filterPushdown.enabled", "true")
    spark.dataSource.register(cls)
    return spark.read.format(cls.name()).load()
