"""Queries over a citation graph: orders cite the parts that their lines name."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lectern.functions import scalars as M
from lectern.operators import citations as C
from lectern.plans.catalog import register
from lectern.session import table


def _edges(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("src"), F.col("l_partkey").alias("dst"))


@register("local_in_degree", "SELECT p_partkey AS node, count(DISTINCT CASE WHEN l_orderkey <> l_partkey THEN l_orderkey END)::BIGINT AS citations FROM part LEFT JOIN lineitem ON l_partkey = p_partkey GROUP BY p_partkey")
def local_in_degree(spark: SparkSession, sf_dir: str) -> DataFrame:
    return C.in_degree(_edges(spark, sf_dir), table(spark, sf_dir, "part").select(F.col("p_partkey").alias("node")))


@register("co_reference", "SELECT l_partkey AS node, count(*)::BIGINT AS times FROM lineitem GROUP BY l_partkey")
def co_reference(spark: SparkSession, sf_dir: str) -> DataFrame:
    return C.co_reference(_edges(spark, sf_dir))


@register("consensus", "SELECT l_partkey AS node, count(DISTINCT l_suppkey)::BIGINT AS anchors, CASE WHEN count(DISTINCT l_suppkey) >= 2 THEN 'high_consensus' ELSE 'single_anchor' END AS label FROM lineitem GROUP BY l_partkey")
def consensus(spark: SparkSession, sf_dir: str) -> DataFrame:
    return C.consensus(table(spark, sf_dir, "lineitem").select(F.col("l_suppkey").alias("src"), F.col("l_partkey").alias("dst")))


_SEEDS = "seeds AS (SELECT o_orderkey AS node FROM orders WHERE o_orderpriority = '1-URGENT')"


@register(
    "neighbour_expand",
    f"WITH {_SEEDS}, h AS (SELECT DISTINCT l_orderkey AS src, l_partkey AS node FROM lineitem JOIN seeds ON node = l_orderkey WHERE l_partkey NOT IN (SELECT node FROM seeds)) SELECT node, count(*)::BIGINT AS support, string_agg(src::VARCHAR, '|' ORDER BY src) AS seeds FROM h GROUP BY node",
)
def neighbour_expand(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Parts that urgent orders cite, by how many and which."""
    seeds = table(spark, sf_dir, "orders").where("o_orderpriority = '1-URGENT'").select(F.col("o_orderkey").alias("node"))
    return C.expand(_edges(spark, sf_dir), seeds)


@register(
    "two_tier_neighbours",
    "WITH m AS (SELECT l_partkey AS node, count(*)::BIGINT AS times, sum(l_quantity) AS weight, avg(l_discount) AS similarity FROM lineitem WHERE l_returnflag = 'R' GROUP BY l_partkey) SELECT node, CASE WHEN times >= 2 THEN 0 ELSE 1 END AS tier, round(CASE WHEN times >= 2 THEN times * 100 + ln(1 + weight) ELSE similarity * 10 + 0.1 * ln(1 + weight) END, 6) AS score FROM m",
)
def two_tier_neighbours(spark: SparkSession, sf_dir: str) -> DataFrame:
    lines = table(spark, sf_dir, "lineitem").where("l_returnflag = 'R'")
    m = lines.groupBy(F.col("l_partkey").alias("node")).agg(F.count("*").alias("times"), F.sum("l_quantity").alias("weight"), F.avg("l_discount").alias("similarity"))
    return C.two_tier(m).select("node", "tier", F.round("score", 6).alias("score"))


@register("adjacency_export", "SELECT l_suppkey AS node, string_agg(DISTINCT l_partkey::VARCHAR, '|' ORDER BY l_partkey::VARCHAR) AS targets FROM lineitem WHERE false GROUP BY l_suppkey UNION ALL SELECT node, string_agg(p::VARCHAR, '|' ORDER BY p) FROM (SELECT DISTINCT l_suppkey AS node, l_partkey AS p FROM lineitem) GROUP BY node")
def adjacency_export(spark: SparkSession, sf_dir: str) -> DataFrame:
    return C.adjacency(table(spark, sf_dir, "lineitem").select(F.col("l_suppkey").alias("src"), F.col("l_partkey").alias("dst")))


def _rank_sql(rounds: int) -> str:
    steps = ["r0 AS (SELECT node, 1.0::DOUBLE / (SELECT count(*) FROM nodes) AS rank FROM nodes)"]
    for k in range(1, rounds + 1):
        steps.append(
            f"r{k} AS MATERIALIZED (SELECT s.node, 0.15::DOUBLE / (SELECT count(*) FROM nodes) + 0.85::DOUBLE * (coalesce(g.got, 0) + (SELECT coalesce(sum(rank), 0) FROM r{k - 1} WHERE node NOT IN (SELECT src FROM deg)) / (SELECT count(*) FROM nodes)) AS rank FROM nodes s LEFT JOIN (SELECT dst, sum(rank / out) AS got FROM r{k - 1} JOIN e ON src = node JOIN deg USING (src) GROUP BY dst) g ON g.dst = s.node)"
        )
    return f"""WITH e AS MATERIALIZED (SELECT DISTINCT 's' || l_suppkey AS src, 'p' || l_partkey AS dst FROM lineitem UNION SELECT DISTINCT 'p' || l_partkey, 'o' || l_orderkey FROM lineitem),
    deg AS MATERIALIZED (SELECT src, count(*) AS out FROM e GROUP BY src), nodes AS MATERIALIZED (SELECT src AS node FROM e UNION SELECT dst FROM e), {', '.join(steps)}
    SELECT node, round(rank, 8) AS rank FROM r{rounds}"""


def _supply_graph(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    """Edges from suppliers to parts and from parts to orders, and their ends."""
    lines = table(spark, sf_dir, "lineitem")
    s, p, o = (F.concat(F.lit(k), F.col(c).cast("string")) for k, c in (("s", "l_suppkey"), ("p", "l_partkey"), ("o", "l_orderkey")))
    edges = lines.select(s.alias("src"), p.alias("dst")).union(lines.select(p, o)).distinct()
    return edges, edges.select(F.col("src").alias("node")).union(edges.select("dst")).distinct()


@register("pagerank_k", _rank_sql(8))
def pagerank_k(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Eight rounds of PageRank over suppliers, parts and orders."""
    edges, nodes = _supply_graph(spark, sf_dir)
    return C.pagerank(edges, nodes, rounds=8, tolerance=0).select("node", F.round("rank", 8).alias("rank"))


_YEARS = "y AS (SELECT o_custkey AS c, year(o_orderdate) AS y, count(*)::BIGINT AS n FROM orders GROUP BY ALL), t AS (SELECT c, sum(n)::BIGINT AS total, (SELECT max(y) - 1 FROM y) AS cutoff, array_agg({'y': y, 'n': n}) AS years FROM y GROUP BY c)"


@register("count_as_of", f"WITH {_YEARS} SELECT c AS o_custkey, (total - coalesce(list_sum([x.n FOR x IN years IF x.y > cutoff]), 0))::BIGINT AS counted FROM t")
def count_as_of(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Orders of each customer up to the year before the last."""
    orders = table(spark, sf_dir, "orders")
    by = orders.groupBy("o_custkey", F.year("o_orderdate").alias("year")).agg(F.count("*").alias("cited_by_count"))
    rows = by.groupBy("o_custkey").agg(F.sum("cited_by_count").alias("total"), F.collect_list(F.struct("year", "cited_by_count")).alias("by"))
    cutoff = by.agg((F.max("year") - 1).alias("cutoff"))
    return rows.join(F.broadcast(cutoff)).select("o_custkey", M.count_as_of(F.col("total"), F.col("by"), F.col("cutoff")).alias("counted"))


@register(
    "letor_features",
    """WITH d AS (SELECT p_partkey, p_retailprice, count(l_orderkey)::BIGINT AS cites, count(DISTINCT l_suppkey)::BIGINT AS local, min(year(l_shipdate)) AS y FROM part LEFT JOIN lineitem ON l_partkey = p_partkey GROUP BY ALL),
    m AS (SELECT max(cites) AS mc, max(local) AS ml, max(y) AS now FROM d)
    SELECT p_partkey, round(p_retailprice / 10000, 6) AS similarity, round(ln(1 + cites) / ln(1 + CASE WHEN mc = 0 THEN 1 ELSE mc END), 6) AS global_prestige, round(ln(1 + local) / ln(1 + CASE WHEN ml = 0 THEN 1 ELSE ml END), 6) AS local_prestige,
      round(ln(1 + cites) / ln(1 + CASE WHEN mc = 0 THEN 1 ELSE mc END) / ln(2 + greatest(1, now - coalesce(y, now) + 1)), 6) AS emergence FROM d, m""",
)
def letor_features(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Ranking features of each part: similarity, global and local prestige, emergence."""
    lines, part = table(spark, sf_dir, "lineitem"), table(spark, sf_dir, "part").select("p_partkey", "p_retailprice")
    d = lines.groupBy(F.col("l_partkey").alias("p_partkey")).agg(F.count("*").alias("cites"), F.countDistinct("l_suppkey").alias("local"), F.min(F.year("l_shipdate")).alias("y"))
    d = part.join(d, "p_partkey", "left").fillna(0, ["cites", "local"])
    m = d.agg(F.max("cites").alias("mc"), F.max("local").alias("ml"), F.max("y").alias("now"))
    x = d.join(F.broadcast(m))
    glob = M.log_share(F.col("cites"), F.col("mc"))
    age = F.greatest(F.lit(1), F.col("now") - F.coalesce("y", "now") + 1)
    cols = {"similarity": F.col("p_retailprice") / 10000, "global_prestige": glob, "local_prestige": M.log_share(F.col("local"), F.col("ml")), "emergence": glob / F.log1p(age + 1)}
    return x.select("p_partkey", *[F.round(c, 6).alias(k) for k, c in cols.items()])


@register("letor_pagerank", _rank_sql(3).replace("SELECT node, round(rank, 8) AS rank FROM r3", "SELECT substr(node, 2)::BIGINT AS p_partkey, round(rank * (SELECT count(*) FROM nodes) / 10, 6) AS pagerank FROM r3 WHERE node LIKE 'p%'"))
def letor_pagerank(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The fifth ranking feature: PageRank (of three rounds here) times a tenth of the pool's size."""
    edges, nodes = _supply_graph(spark, sf_dir)
    ranked = C.pagerank(edges, nodes, rounds=3, tolerance=0)
    pool = F.broadcast(nodes.agg(F.count("*").alias("pool")))  # one number
    parts = ranked.where("node LIKE 'p%'").join(pool)
    return parts.select(F.substring("node", 2, 20).cast("long").alias("p_partkey"), F.round(F.col("rank") * F.col("pool") / 10, 6).alias("pagerank"))
