"""Queries of the parsers, evidence checks and clusters."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lectern.operators import evidence, parsers
from lectern.plans.catalog import register
from lectern.session import table


@register("html_extract")
def html_extract(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Title and main text of each page."""
    return parsers.parsed(table(spark, sf_dir, "pages"), "page_id", "html", lambda h: [parsers.html_main(h)], "title string, text string")


@register(
    "chunk_paragraphs",
    r"""WITH RECURSIVE p AS (SELECT doc_id, [x FOR x IN [regexp_replace(l, '^\s+|\s+$', '', 'g') FOR l IN string_split(coalesce(text, ''), chr(10))] IF x <> ''] AS p FROM documents),
    g(doc_id, i, chunk, n, size) AS (SELECT doc_id, 1, 0, 1, length(p[1]) FROM p WHERE len(p) > 0 UNION ALL
      SELECT g.doc_id, i + 1, CASE WHEN n >= 5 OR size + 2 + length(p[i + 1]) > 10000 THEN chunk + 1 ELSE chunk END, CASE WHEN n >= 5 OR size + 2 + length(p[i + 1]) > 10000 THEN 1 ELSE n + 1 END,
        CASE WHEN n >= 5 OR size + 2 + length(p[i + 1]) > 10000 THEN length(p[i + 1]) ELSE size + 2 + length(p[i + 1]) END FROM g JOIN p ON p.doc_id = g.doc_id WHERE i < len(p))
    SELECT doc_id, chunk::INT AS chunk, max(n)::INT AS paragraphs, max(size)::BIGINT AS chars FROM g GROUP BY doc_id, chunk""",
)
def chunk_paragraphs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return evidence.chunked(table(spark, sf_dir, "documents"), "doc_id", "text")


_TRIMMED = r"[x FOR x IN [regexp_replace(t, '^[^\p{L}\p{N}_]+|[^\p{L}\p{N}_]+$', '', 'g') FOR t IN regexp_split_to_array(lower(text), '[\x09-\x0D ]+')] IF x <> '']"
_RUNS = r"SELECT {key}, unnest(list_distinct([array_to_string(w[i:i + 7], ' ') FOR i IN range(1, len(w)::BIGINT - 6)])) AS run FROM (SELECT {key}, regexp_extract_all(lower(text), '[^\x20\x09-\x0D]+', 0) AS w FROM {table})"


@register(
    "evidence_verify",
    f"""WITH d AS ({_RUNS.format(key='doc_id', table='documents')}), q AS ({_RUNS.format(key='item_id', table='benchmark')}), met AS (SELECT DISTINCT doc_id, item_id FROM d JOIN q USING (run)),
    a AS (SELECT item_id, {_TRIMMED} AS t FROM benchmark), s AS (SELECT doc_id, {_TRIMMED} AS t FROM documents WHERE doc_id IN (SELECT doc_id FROM met)),
    ai AS (SELECT item_id, unnest(t) AS tok, generate_subscripts(t, 1) AS i FROM a), sj AS (SELECT doc_id, unnest(t) AS tok, generate_subscripts(t, 1) AS j FROM s),
    m AS (SELECT doc_id, item_id, i, j - i AS line FROM met JOIN ai USING (item_id) JOIN sj USING (doc_id, tok)),
    r AS (SELECT *, i - row_number() OVER (PARTITION BY doc_id, item_id, line ORDER BY i) AS part FROM m), n AS (SELECT doc_id, item_id, count(*) AS n FROM r GROUP BY doc_id, item_id, line, part),
    best AS (SELECT doc_id, item_id, max(n) AS n FROM n GROUP BY ALL),
    c AS (SELECT met.doc_id, met.item_id, CASE WHEN length(array_to_string(t, '')) >= 20 AND coalesce(n, 0) >= 0.6::DOUBLE * len(t) THEN 0.7::DOUBLE * (n::DOUBLE / len(t)) + (1 - 0.7::DOUBLE) ELSE 0 END AS sure FROM met JOIN a USING (item_id) LEFT JOIN best ON best.doc_id = met.doc_id AND best.item_id = met.item_id)
    SELECT doc_id, item_id, sure > 0.6::DOUBLE AS verified, round(sure, 6) AS confidence FROM c""",
)
def evidence_verify(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Benchmark passages as quotes, checked in every text that holds one of their runs of eight words."""
    def runs(df: DataFrame, key: str) -> DataFrame:
        words = F.regexp_extract_all(F.lower("text"), F.lit(r"[^\x20\x09-\x0D]+"), F.lit(0))
        from lectern.functions.text import ngrams

        return df.select(key, F.explode(F.array_distinct(ngrams(words, 8))).alias("run")).select(key, F.xxhash64("run").alias("run"))

    docs, items = table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark")
    met = runs(docs, "doc_id").join(runs(items, "item_id"), "run").select("doc_id", "item_id").distinct()
    pairs = met.join(items.withColumnRenamed("text", "quote"), "item_id").join(docs.select("doc_id", F.col("text").alias("source")), "doc_id")
    return evidence.verified(pairs, ["doc_id", "item_id"], "quote", "source")


@register("text_clusters")
def text_clusters(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Clusters of texts over hashed word frequencies, weighed by rarity."""
    from pyspark.ml import Pipeline
    from pyspark.ml.clustering import KMeans
    from pyspark.ml.feature import IDF, HashingTF, RegexTokenizer

    docs = table(spark, sf_dir, "documents").select("doc_id", F.coalesce("text", F.lit("")).alias("text"))
    steps = [
        RegexTokenizer(inputCol="text", outputCol="words", pattern=r"\W+"), HashingTF(inputCol="words", outputCol="tf", numFeatures=512),
        IDF(inputCol="tf", outputCol="features", minDocFreq=2), KMeans(featuresCol="features", predictionCol="cluster", k=20, seed=42, maxIter=10),
    ]
    return Pipeline(stages=steps).fit(docs).transform(docs).select("doc_id", "cluster")
