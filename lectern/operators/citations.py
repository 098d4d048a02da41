"""Citation graphs: in-degree, co-reference, consensus, neighbours, PageRank."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lectern.session import checkpointed


def in_degree(edges: DataFrame, nodes: DataFrame) -> DataFrame:
    """(node, citations): distinct citing nodes of every node, zeros included. edges: src, dst; nodes: node."""
    counts = edges.where("src <> dst").groupBy(F.col("dst").alias("node")).agg(F.countDistinct("src").alias("citations"))
    return nodes.select("node").join(counts, "node", "left").select("node", F.coalesce("citations", F.lit(0)).alias("citations"))


def co_reference(edges: DataFrame) -> DataFrame:
    """(node, times): mentions of each cited node, repeated ones too."""
    return edges.groupBy(F.col("dst").alias("node")).agg(F.count("*").alias("times"))


def consensus(edges: DataFrame, least: int = 2) -> DataFrame:
    """(node, anchors, label): how many distinct sources cite a node; ``least`` or more are a consensus."""
    n = edges.groupBy(F.col("dst").alias("node")).agg(F.countDistinct("src").alias("anchors"))
    return n.withColumn("label", F.when(F.col("anchors") >= least, "high_consensus").otherwise("single_anchor"))


def expand(edges: DataFrame, seeds: DataFrame) -> DataFrame:
    """(node, support, seeds): nodes that seeds cite and that are no seeds, by how many and which, in order."""
    hop = edges.join(seeds.select(F.col("node").alias("src")).distinct(), "src").join(seeds.select(F.col("node").alias("dst")), "dst", "left_anti")
    found = hop.select("src", F.col("dst").alias("node")).distinct().groupBy("node").agg(F.count("*").alias("support"), F.sort_array(F.collect_list("src")).alias("s"))
    return found.select("node", "support", F.array_join(F.transform("s", lambda x: x.cast("string")), "|").alias("seeds"))


def two_tier(multiplicity: DataFrame) -> DataFrame:
    """Adds tier and score: nodes met twice or more score 100 * count + log(1 + weight) and come first; the others
    10 * similarity + 0.1 * log(1 + weight). Columns node, times, weight, similarity."""
    strong = F.col("times") >= 2
    score = F.when(strong, F.col("times") * 100 + F.log1p("weight")).otherwise(F.col("similarity") * 10 + 0.1 * F.log1p("weight"))
    return multiplicity.withColumn("tier", F.when(strong, 0).otherwise(1)).withColumn("score", score)


def pagerank(edges: DataFrame, nodes: DataFrame, rounds: int = 100, damping: float = 0.85, tolerance: float = 1e-6) -> DataFrame:
    """(node, rank): PageRank with uniform teleport, parallel edges collapsed, self loops dropped, isolated nodes kept.

    Ends after ``rounds``, or when all ranks together change by less than ``tolerance`` times the number of nodes.

    What dangling nodes hold is spread over all nodes: as that is the same for each, its sum goes through the driver
    once a round as one number. A round reads the ranks twice, so each is written to the checkpoint folder.
    """
    nodes = nodes.select("node").distinct()
    e = edges.select("src", "dst").where("src <> dst").distinct()
    degree = e.groupBy("src").agg(F.count("*").alias("out"))
    moves = checkpointed(e.join(degree, "src").select(F.col("src").alias("node"), "dst", (F.lit(1.0) / F.col("out")).alias("share")))
    ends = nodes.join(degree.select(F.col("src").alias("node")), "node", "left").join(degree.withColumnRenamed("src", "node"), "node", "left").select("node", F.col("out").isNull().alias("dangles"))
    state = checkpointed(ends.dropDuplicates(["node"]))
    n = state.count() or 1
    now = state.withColumn("rank", F.lit(1.0 / n))
    for _ in range(rounds):
        lost = now.where("dangles").agg(F.sum("rank")).first()[0] or 0.0
        got = now.select("node", "rank").join(moves, "node").groupBy(F.col("dst").alias("node")).agg(F.sum(F.col("rank") * F.col("share")).alias("got"))
        mixed = F.lit((1 - damping) / n) + damping * (F.coalesce("got", F.lit(0.0)) + F.lit(lost / n))
        before, now = now, checkpointed(state.join(got, "node", "left").select("node", "dangles", mixed.alias("rank")))
        if tolerance:
            both = now.join(before.select("node", F.col("rank").alias("was")), "node")
            if (both.agg(F.sum(F.abs(F.col("rank") - F.col("was")))).first()[0] or 0.0) < n * tolerance:
                break
    return now.select("node", "rank")


def adjacency(edges: DataFrame) -> DataFrame:
    """(node, targets): each node's distinct targets in order, joined by ``|``."""
    got = edges.select("src", "dst").distinct().groupBy(F.col("src").alias("node")).agg(F.sort_array(F.collect_list("dst")).alias("t"))
    return got.select("node", F.array_join(F.transform("t", lambda x: x.cast("string")), "|").alias("targets"))


def canonical_ids(clusters: DataFrame) -> DataFrame:
    """(alias, canonical): each alias's first cluster. clusters: canonical, pos, aliases array."""
    flat = clusters.select("canonical", "pos", F.explode("aliases").alias("alias"))
    return flat.groupBy("alias").agg(F.min_by("canonical", F.struct("pos", "canonical")).alias("canonical"))


def resolved_references(refs: DataFrame, clusters: DataFrame) -> DataFrame:
    """(src, dst): distinct references between clusters, both ends resolved, unknown ones and a cluster's own left out."""
    known = canonical_ids(clusters)
    ends = refs.select("src", "dst")
    for end in ("src", "dst"):
        ends = ends.join(known.select(F.col("alias").alias(end), F.col("canonical").alias(f"{end}_to")), end)
    return ends.select(F.col("src_to").alias("src"), F.col("dst_to").alias("dst")).where("src <> dst").distinct()


def grown(edges: DataFrame, seeds: DataFrame, size: int) -> DataFrame:
    """(node, round): nodes reached from the seeds, hop by hop, until there are ``size`` of them or no new one.

    All nodes of the last round stay. Every round is written to the checkpoint folder; the driver gets one count.
    """
    have = checkpointed(seeds.select("node").distinct().withColumn("round", F.lit(0)))
    n, k, new = have.count(), 0, have
    while n < size:
        k += 1
        hop = edges.join(new.select(F.col("node").alias("src")), "src").select(F.col("dst").alias("node")).distinct()
        new = checkpointed(hop.join(have, "node", "left_anti").withColumn("round", F.lit(k)))
        more = new.count()
        if not more:
            break
        n, have = n + more, have.union(new)
    return have
