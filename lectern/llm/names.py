"""Column names that no column of the caller's has."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame


def free(df: DataFrame, *wanted: str) -> list[str]:
    """The wanted names, each lengthened by underscores until no column of ``df`` has it in any case."""
    taken, out = {c.lower() for c in df.columns}, []
    for name in wanted:
        while name.lower() in taken:
            name += "_"
        taken.add(name.lower())
        out.append(name)
    return out


def renamed(df: DataFrame, *known: str) -> tuple[DataFrame, Callable[[DataFrame], DataFrame]]:
    """``df`` with plain, unused names for all columns but the known ones, and what gives its names back to a result."""
    columns = df.columns
    return df.toDF(*[c if c in known else f"extra_{i}" for i, c in enumerate(columns)]), lambda out: out.toDF(*columns)


def quoted(name: str) -> str:
    """The name as an SQL identifier, dots and all."""
    return "`" + name.replace("`", "``") + "`"
