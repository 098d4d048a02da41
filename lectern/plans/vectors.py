"""Queries over the embeddings table; a label's centroid stands for a topic."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lectern.operators import vectors as V
from lectern.plans.catalog import register
from lectern.session import table

_NORM = "CASE WHEN sqrt(list_dot_product(v, v)) = 0 THEN 1 ELSE sqrt(list_dot_product(v, v)) END"
_SRC = "e AS (SELECT vec_id, label, embedding::DOUBLE[] AS v FROM embeddings)"
_UNIT = f"u AS (SELECT vec_id, label, [x / ({_NORM}) FOR x IN v] AS v FROM e)"
# Queries: every vector whose id is divisible by 20.
_SIMS = "s AS (SELECT q.vec_id AS query, u.vec_id, round(list_dot_product(u.v, q.v), 9) AS sim FROM u, u q WHERE q.vec_id % 20 = 0)"
_TOPICS = """dims AS (SELECT label, unnest(v) AS x, unnest(range(1, len(v) + 1)) AS i FROM e),
topics AS (SELECT label, array_agg(x ORDER BY i) AS v FROM (SELECT label, i, avg(x) AS x FROM dims GROUP BY label, i) GROUP BY label),
ut AS (SELECT label AS topic, [x / (CASE WHEN sqrt(list_dot_product(v, v)) = 0 THEN 1 ELSE sqrt(list_dot_product(v, v)) END) FOR x IN v] AS tv FROM topics)"""


def _vectors(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "embeddings")


def _topics(e: DataFrame) -> DataFrame:
    flat = e.select("label", F.posexplode("embedding").alias("i", "x"))
    means = flat.groupBy("label", "i").agg(F.avg(F.col("x").cast("double")).alias("x"))
    return means.groupBy("label").agg(F.transform(F.sort_array(F.collect_list(F.struct("i", "x"))), lambda s: s["x"]).alias("v"))


def _queries(e: DataFrame) -> DataFrame:
    return e.where("vec_id % 20 = 0")


@register("cosine_topk", f"WITH {_SRC}, {_UNIT}, {_SIMS} SELECT query, vec_id, round(sim, 6) AS similarity FROM s QUALIFY row_number() OVER (PARTITION BY query ORDER BY sim DESC, vec_id) <= 10")
def cosine_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The ten vectors nearest to each query, itself included."""
    e = _vectors(spark, sf_dir)
    return V.nearest(_queries(e), e, "vec_id", "embedding", 10).select("query", "vec_id", F.round("similarity", 6).alias("similarity"))


@register("query_keep_ratio", f"WITH {_SRC}, {_UNIT}, {_SIMS} SELECT query, vec_id FROM s QUALIFY row_number() OVER (PARTITION BY query ORDER BY sim DESC, vec_id) <= greatest(1, ceil(0.3::DOUBLE * count(*) OVER (PARTITION BY query)))")
def query_keep_ratio(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The 30 % of vectors most similar to each query, at least one."""
    e = _vectors(spark, sf_dir)
    return V.nearest_share(_queries(e), e, "vec_id", "embedding", 0.3)


_BEST = f"WITH {_SRC}, {_UNIT}, {_TOPICS}, s AS (SELECT vec_id, label, topic, round(list_dot_product(v, tv), 9) AS sim FROM u, ut), best AS (SELECT * FROM s QUALIFY row_number() OVER (PARTITION BY vec_id ORDER BY sim DESC, topic) = 1)"


@register(
    "topic_coverage",
    f"WITH {_SRC}, {_UNIT}, {_TOPICS}, s AS (SELECT topic, vec_id, round(list_dot_product(v, tv), 9) AS sim FROM u, ut), b AS (SELECT * FROM s QUALIFY row_number() OVER (PARTITION BY topic ORDER BY sim DESC, vec_id) = 1) SELECT topic, vec_id AS best_match, round(sim, 6) AS similarity, CASE WHEN sim < 0.45 THEN 'missing' WHEN sim > 0.55 THEN 'covered' ELSE 'weakly covered' END AS status FROM b",
)
def topic_coverage(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each topic's nearest vector and whether that covers it."""
    e = _vectors(spark, sf_dir)
    best = V.best_match(_topics(e), "label", "v", e, "vec_id", "embedding")
    return best.select(F.col("label").alias("topic"), F.col("match").alias("best_match"), F.round("similarity", 6).alias("similarity"), V.coverage_status(F.col("similarity")).alias("status"))


def _best(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    e = _vectors(spark, sf_dir)
    return e, V.best_match(e, "vec_id", "embedding", _topics(e), "label", "v")


@register("irrelevant_items", f"{_BEST} SELECT vec_id, topic AS best_topic, round(sim, 6) AS similarity FROM best WHERE sim < 0.45")
def irrelevant_items(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Vectors that no topic is near to."""
    _, best = _best(spark, sf_dir)
    return best.where("similarity < 0.45").select("vec_id", F.col("match").alias("best_topic"), F.round("similarity", 6).alias("similarity"))


@register("topic_assignment", f"{_BEST} SELECT vec_id, topic, topic = label AS own, round(sim, 6) AS similarity FROM best")
def topic_assignment(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each vector's nearest topic, and whether it is the one of its own label."""
    e, best = _best(spark, sf_dir)
    return best.join(e.select("vec_id", "label"), "vec_id").select("vec_id", F.col("match").alias("topic"), (F.col("match") == F.col("label")).alias("own"), F.round("similarity", 6).alias("similarity"))


@register(
    "missing_items",
    f"""{_BEST}, ev AS (SELECT user_id, max(value) / (SELECT max(value) FROM events) AS rank, max(ts)::DATE AS published FROM events GROUP BY user_id),
    c AS (SELECT vec_id, sim, rank, published FROM best JOIN ev ON ev.user_id = best.vec_id),
    k AS (SELECT * FROM c WHERE date_diff('day', published, DATE '2024-06-15') > 90 AND rank IS NOT NULL)
    SELECT vec_id, round(sim, 6) AS topic_similarity FROM k WHERE (SELECT max(rank) FROM k) - rank <= 0.75 AND sim >= 0.3 AND vec_id NOT IN (SELECT doc_id FROM labels)""",
)
def missing_items(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Candidates older than 90 days, ranked near the best, near a topic and not cited yet; bands as these data need them."""
    _, best = _best(spark, sf_dir)
    events = table(spark, sf_dir, "events")
    most = events.agg(F.max("value").alias("most"))
    events = events.groupBy("user_id").agg(F.max("value").alias("rank"), F.max("ts").cast("date").alias("published"))
    events = events.join(F.broadcast(most)).withColumn("rank", F.col("rank") / F.col("most"))
    pool = best.join(events, best["vec_id"] == events["user_id"]).where(F.datediff(F.lit("2024-06-15").cast("date"), "published") > 90).where("rank IS NOT NULL")
    top = pool.agg(F.max("rank").alias("top"))
    near = pool.join(F.broadcast(top)).where("top - rank <= 0.75 AND similarity >= 0.3")
    cited = table(spark, sf_dir, "labels").select(F.col("doc_id").alias("vec_id"))
    return near.join(cited, "vec_id", "left_anti").select("vec_id", F.round("similarity", 6).alias("topic_similarity"))


@register("similar_pair_count", f"WITH {_SRC}, {_UNIT}, {_SIMS} SELECT count(*)::BIGINT AS pairs FROM s WHERE sim > 0.3")
def similar_pair_count(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Entries above a bound of the matrix of queries and all vectors, self pairs included."""
    e = _vectors(spark, sf_dir)
    return V.count_above(_queries(e), "vec_id", "embedding", e, 0.3)


@register("max_similarity", f"WITH {_SRC}, {_UNIT}, {_SIMS} SELECT vec_id, round(max(sim), 6) AS similarity FROM s GROUP BY vec_id")
def max_similarity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Similarity to the nearest of the accepted vectors, those whose id is divisible by 20."""
    e = _vectors(spark, sf_dir)
    best = V.best_match(e, "vec_id", "embedding", _queries(e), "vec_id", "embedding")
    return best.select("vec_id", F.round(F.coalesce("similarity", F.lit(0.0)), 6).alias("similarity"))
