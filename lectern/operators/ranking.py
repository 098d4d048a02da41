"""Learning-to-rank data: samples, splits, recall, pair accuracy, NDCG, quotas, and a pairwise booster stand-in."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lectern.operators.ranks import ranked_in


def labelled(pool: DataFrame, gold: DataFrame, keys: list[str]) -> DataFrame:
    """``pool`` with label 1 where gold has the row's keys, else 0."""
    return pool.join(gold.select(*keys).distinct().withColumn("__hit", F.lit(1)), keys, "left").withColumn("label", F.coalesce("__hit", F.lit(0))).drop("__hit")


def sample_negatives(rows: DataFrame, group: str, key: str, times: int = 7) -> DataFrame:
    """All positives, and of the negatives of each group up to ``times`` as many, in the order of md5(key)."""
    positives = rows.groupBy(F.col(group).alias("__g")).agg(F.sum("label").alias("__p"))
    ranked = ranked_in(rows, [group, "label"], [F.md5(F.col(key).cast("string")), F.col(key)], "__n")
    kept = ranked.join(positives, F.col(group).eqNullSafe(F.col("__g"))).where((F.col("label") == 1) | (F.col("__n") <= times * F.col("__p")))
    return kept.drop("__n", "__p", "__g")


def tail_split(rows: DataFrame, source: str, order: str, ratio: float = 0.1) -> DataFrame:
    """Adds split: the last int(ratio * n) rows of each source are ``valid``; where that is none, none are."""
    n = rows.groupBy(F.col(source).alias("__g")).agg(F.count("*").alias("__n"))
    ranked = ranked_in(rows, [source], [F.col(order)], "__at").join(n, F.col(source).eqNullSafe(F.col("__g")))
    tail = F.col("__at") > F.col("__n") - F.floor(F.col("__n") * F.lit(ratio))
    return ranked.withColumn("split", F.when(tail, "valid").otherwise("train")).drop("__at", "__n", "__g")


def recall(gold: DataFrame, pool: DataFrame, keys: list[str]) -> DataFrame:
    """One row: gold, hits, recall."""
    hit = gold.select(*keys).distinct().join(pool.select(*keys).distinct().withColumn("__h", F.lit(1)), keys, "left")
    return hit.agg(F.count("*").alias("gold"), F.count("__h").alias("hits")).withColumn("recall", F.round(F.col("hits") / F.when(F.col("gold") == 0, 1).otherwise(F.col("gold")), 6))


def pair_accuracy(rows: DataFrame, positive: str, hard: str, easy: str) -> DataFrame:
    """One row: shares of rows in which each score beats the next, and mean scores."""
    def wins(a: str, b: str) -> Column:
        return F.round(F.avg((F.col(a) > F.col(b)).cast("double")), 6)

    return rows.agg(wins(positive, hard).alias("pos_over_hard"), wins(positive, easy).alias("pos_over_easy"), wins(hard, easy).alias("hard_over_easy"), *[F.round(F.avg(c), 6).alias(f"mean_{c}") for c in (positive, hard, easy)])


def preference_mask(positive: Column, hard: Column, easy: Column, margin: float = 0.5) -> Column:
    """1 for positive over easy, 2 for positive over hard, 4 for hard over easy, all by more than the margin; 8 for no
    hard negative. Rows with 7 or 9 are kept."""
    def bit(ok: Column, value: int) -> Column:
        return F.when(ok, value).otherwise(0)

    return bit(positive > easy + margin, 1) + bit(positive > hard + margin, 2) + bit(hard > easy + margin, 4) + bit(hard.isNull(), 8)


def ndcg(rows: DataFrame, group: str, score: str, label: str, key: str, k: int = 10) -> DataFrame:
    """(group, ndcg): discounted gains of the k best-scored rows against the best order; 0 without a gain."""
    gain = F.pow(F.lit(2.0), F.col(label)) - 1
    r = ranked_in(ranked_in(rows, [group], [F.col(score).desc(), F.col(key)], "__s"), [group], [F.col(label).desc(), F.col(key)], "__l")
    part = lambda c: F.sum(F.when(F.col(c) <= k, gain / F.log2(F.col(c) + 1)).otherwise(0.0))
    return r.groupBy(group).agg(part("__s").alias("got"), part("__l").alias("best")).select(group, F.round(F.when(F.col("best") > 0, F.col("got") / F.col("best")).otherwise(0.0), 6).alias("ndcg"))


def boosted_ranker(rows: DataFrame, features: list[str], label: str, rounds: int = 50, depth: int = 5, rate: float = 0.1, seed: int = 42):
    """A gradient-boosted pointwise model over feature columns, standing in for LambdaRank, which Spark lacks."""
    from pyspark.ml import Pipeline
    from pyspark.ml.feature import VectorAssembler
    from pyspark.ml.regression import GBTRegressor

    steps = [VectorAssembler(inputCols=features, outputCol="__x"), GBTRegressor(featuresCol="__x", labelCol=label, predictionCol="rank", maxIter=rounds, maxDepth=depth, stepSize=rate, seed=seed)]
    return Pipeline(stages=steps).fit(rows)


def fill_quotas(rows: DataFrame, size: int) -> DataFrame:
    """Exactly ``size`` rows (or all): those of kind high first, then query and neighbour rows that share what is left
    in half, the odd one to neighbours, shortfalls going to the other side. rows: id, kind, score."""
    ranked = ranked_in(rows, ["kind"], [F.col("score").desc(), F.col("id")], "__n")
    have = {r["kind"]: r["n"] for r in rows.groupBy("kind").agg(F.count("*").alias("n")).collect()}
    high, query, near = (have.get(k, 0) for k in ("high", "query", "neighbour"))
    left = max(0, size - high)
    q = min(query, left // 2 + max(0, left - left // 2 - near))
    n = min(near, left - q)
    quota = F.create_map(*[F.lit(x) for kv in {"high": min(high, size), "query": q, "neighbour": n}.items() for x in kv])
    return ranked.where(F.col("__n") <= F.coalesce(F.try_element_at(quota, F.col("kind")), F.lit(0))).drop("__n")
