"""Entity resolution: MinHash bands, candidate pairs, same-work tests, cluster merges."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lectern.functions import text as X

HASHES, BAND = 24, 4
PRIME = 2_147_483_647


def coefficients(n: int = HASHES) -> list[tuple[int, int]]:
    """Multipliers and addends of n hash functions modulo PRIME, from a fixed recurrence."""
    out, x = [], 12345
    for _ in range(n):
        pair = []
        for _ in range(2):
            x = (x * 1_103_515_245 + 12_345) % PRIME
            pair.append(x or 1)
        out.append((pair[0], pair[1]))
    return out


def token_hash(c: Column) -> Column:
    """28 bits of md5, the same in every engine."""
    return F.conv(F.substring(F.md5(c), 1, 7), 16, 10).cast("long")


def signatures(df: DataFrame, key: str, tokens: Column, n: int = HASHES) -> DataFrame:
    """(key, m0..): the smallest value of each hash function over a row's distinct tokens; rows without tokens drop out.

    Partial minima are taken before the shuffle, which then moves one row for each key and input partition.
    """
    flat = df.select(key, F.explode(F.array_distinct(tokens)).alias("t")).select(key, token_hash(F.col("t")).alias("h"))
    return flat.groupBy(key).agg(*[F.min((F.col("h") * a + b) % PRIME).alias(f"m{i}") for i, (a, b) in enumerate(coefficients(n))])


def bands(signed: DataFrame, key: str, n: int = HASHES, width: int = BAND) -> DataFrame:
    """(key, band, value): runs of ``width`` minima as text."""
    made = F.array(*[F.concat_ws("-", *[F.col(f"m{i}") for i in range(b, b + width)]) for b in range(0, n, width)])
    return signed.select(key, F.posexplode(made).alias("band", "value"))


def band_pairs(signed: DataFrame, key: str, n: int = HASHES, width: int = BAND) -> DataFrame:
    """Distinct pairs a < b that share a band, with the share of equal minima.

    Rows with equal signatures are one class, stood for by its smallest key, so copies don't multiply; every other
    member is paired with that one alone.
    """
    names = [f"m{i}" for i in range(n)]
    classes = signed.groupBy(*names).agg(F.min(key).alias(key))
    copies = signed.join(classes.select(F.col(key).alias("a"), *names), names).where(F.col(key) != F.col("a")).select("a", F.col(key).alias("b"), F.lit(1.0).alias("agreement"))
    cut = bands(classes, key, n, width)
    pairs = cut.select(F.col(key).alias("a"), "band", "value").join(cut.select(F.col(key).alias("b"), "band", "value"), ["band", "value"]).where("a < b").select("a", "b").distinct()
    left, right = (classes.select(F.col(key).alias(k), *[F.col(m).alias(f"{k}_{m}") for m in names]) for k in "ab")
    equal = sum((F.col(f"a_{m}") == F.col(f"b_{m}")).cast("int") for m in names)
    found = pairs.join(left, "a").join(right, "b").select("a", "b", (equal / n).alias("agreement"))
    return found.unionByName(copies)


def same_work(title_a: Column, title_b: Column, authors_a: Column, authors_b: Column, year_a: Column, year_b: Column) -> Column:
    """Titles within a tenth of the longer key (1 at least), authors overlapping by 0.8 of the smaller set where both
    are known, years at most 1 apart where both are known."""
    a, b = X.ascii_key(title_a), X.ascii_key(title_b)
    near = F.levenshtein(a, b) <= F.greatest(F.lit(1), F.floor(F.greatest(F.length(a), F.length(b)) * 0.1))
    known = (F.size(F.coalesce(authors_a, F.array().cast("array<string>"))) > 0) & (F.size(F.coalesce(authors_b, F.array().cast("array<string>"))) > 0)
    overlap = F.size(F.array_intersect(authors_a, authors_b)) / F.least(F.size(F.array_distinct(authors_a)), F.size(F.array_distinct(authors_b)))
    years = F.coalesce(F.abs(year_a - year_b) <= 1, F.lit(True))
    return near & F.when(known, overlap >= 0.8).otherwise(True) & years


def fill_from(first: Column, second: Column) -> Column:
    """``first`` unless it is null or empty."""
    return F.when(F.coalesce(first, F.lit("")) != "", first).otherwise(second)


# Sources from the most to the least telling.
SOURCE_PRIORITY = ("anchor_survey", "high_consensus", "single_anchor", "seed", "neighbor", "new_papers")


def source_rank(c: Column, order: tuple[str, ...] = SOURCE_PRIORITY) -> Column:
    out = F.lit(999)
    for i, s in reversed(list(enumerate(order))):
        out = F.when(c == s, i).otherwise(out)
    return out


def priority_union(rows: DataFrame, key: str, order: tuple[str, ...], text: tuple[str, ...], most: tuple[str, ...]) -> DataFrame:
    """One row for each key: of each text column the first value that isn't empty, sources in order; of each number
    the largest; all sources by priority; the preferred source. rows: key, source, pos and the columns."""
    rank = F.struct(source_rank(F.col("source"), order), F.col("pos"))
    filled = [F.min(F.when(F.coalesce(F.col(c), F.lit("")) != "", F.struct(rank.alias("r"), F.col(c).alias("v"))))["v"].alias(c) for c in text]
    all_sources = F.array_sort(F.collect_set(F.struct(source_rank(F.col("source"), order).alias("r"), F.col("source").alias("s"))))
    out = rows.groupBy(key).agg(*filled, *[F.max(c).alias(c) for c in most], all_sources.alias("__s"))
    return out.withColumn("sources", F.array_join(F.transform("__s", lambda x: x["s"]), "|")).withColumn("source", F.get("__s", F.lit(0))["s"]).drop("__s")


def keep_first(df: DataFrame, keys: list[str], *order: Column) -> DataFrame:
    """The first row of each key in the given order."""
    return df.withColumn("__n", F.row_number().over(Window.partitionBy(*keys).orderBy(*order))).where("__n = 1").drop("__n")


def merge_clusters(rows: DataFrame, cluster: str, key: str, weight: str, joined: tuple[str, ...]) -> DataFrame:
    """One row for each cluster: its first key, the key of its heaviest row (the first of equals), its size and total
    weight, and the distinct values of the given columns in order."""
    heavy = F.max(F.struct(F.col(weight).alias("w"), (-F.col(key)).alias("k")))
    sets = [F.array_join(F.array_sort(F.collect_set(c)), "|").alias(c) for c in joined]
    out = rows.groupBy(cluster).agg(F.min(key).alias(key), heavy.alias("__h"), F.count("*").alias("size"), F.sum(weight).alias(weight), *sets)
    return out.withColumn("base", -F.col("__h.k")).drop("__h", cluster)
