"""The registered queries and the SQL that gives the same rows."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

Query = Callable[[SparkSession, str], DataFrame]

#: name -> (query, SQL or None)
_REGISTERED: dict[str, tuple[Query, str | None]] = {}


def register(name: str, sql: str | None = None) -> Callable[[Query], Query]:
    def keep(f: Query) -> Query:
        if name in _REGISTERED:
            raise ValueError(f"two queries are named {name}")
        _REGISTERED[name] = (f, sql)
        return f

    return keep


def _load() -> None:
    from lectern.plans import bibliography, citations, documents, formats, parsing, ranking, records, tasks, vectors  # noqa: F401


def queries() -> dict[str, Query]:
    _load()
    return {k: f for k, (f, _) in _REGISTERED.items()}


def oracle_sql() -> dict[str, str]:
    _load()
    return {k: s for k, (_, s) in _REGISTERED.items() if s}


def flagship(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Near-duplicate texts resolved to clusters, the twenty largest ones first."""
    return queries()["cluster_merge"](spark, sf_dir).orderBy(F.col("size").desc(), "doc_id").limit(20)
