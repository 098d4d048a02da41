"""One query for each operator of this subpackage, over whole tables with production parameters."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from lectern.llm import fertility, langmix, licenses, lshforest, mixing, ordermin, packing, pitman, toxicity, urlgraph
from lectern.session import table

Query = Callable[[SparkSession, str], DataFrame]


def op1_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return licenses.scan(docs).select("doc_id", "n_known", "sentence_ids", "licenses", "verdict")


def op2_mix_sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    mixed = mixing.mix(docs, mixing.in_turn, mixing.word_count(F.col("text")))
    first = F.round(F.get("positions", F.lit(0)), 6).alias("position")
    return mixed.select("doc_id", "size", "source_size", "target", "taken", first).orderBy("position", "doc_id")


def _crc(modulus: int) -> Column:
    """crc32 of the doc_id as text, modulo; null for a null doc_id."""
    return F.pmod(F.crc32(F.col("doc_id").cast("string").cast("binary")), F.lit(modulus))


def op3_order_minhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ordermin.fingerprints(table(spark, sf_dir, "documents"))


def op4_url_graph(spark: SparkSession, sf_dir: str) -> DataFrame:
    return urlgraph.judge(table(spark, sf_dir, "pages"))


def op5_language_mixture(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    model = langmix.learn(docs, _crc(3) != 1)
    out = langmix.identify(docs, model)
    sets = F.array_join(F.transform("lang_set", lambda x: x["lang"]), "|").alias("languages")
    return out.select("doc_id", F.coalesce(_crc(3) == 1, F.lit(False)).alias("held_out"), "lang_pred", "score", sets)


def op6_pitman_yor(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pitman.score(table(spark, sf_dir, "documents"), learns=_crc(10) != 0, held_out=_crc(10) == 0, sample_rare=True)


def op7_tokeniser_fertility(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    out = fertility.quality(docs, lang=F.col("lang"))
    base = ("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept")
    return out.select(*base, "n_tokens", *(F.round(c, 9).alias(c) for c in fertility.LEAST_MARGIN))


def op8_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, labels = table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels")
    model = toxicity.learn(docs, labels, _crc(3) != 1)
    return toxicity.score(docs, model).select("doc_id", F.coalesce(_crc(3) == 1, F.lit(False)).alias("held_out"), "score", "predicted")


def op9_near_duplicates(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lshforest.near_duplicates(table(spark, sf_dir, "documents"), percent=85)


def op10_pack_batches(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return packing.pack(docs, mixing.word_count(F.col("text")))


def queries() -> dict[str, Query]:
    found = (op1_license_scan, op2_mix_sources, op3_order_minhash, op4_url_graph, op5_language_mixture, op6_pitman_yor, op7_tokeniser_fertility, op8_toxicity, op9_near_duplicates, op10_pack_batches)
    return {f.__name__: f for f in found}


def oracle_sql() -> dict[str, str]:
    return {"op1_license_scan": licenses.scan_sql(), "op2_mix_sources": mixing.MIX_SQL, "op4_url_graph": urlgraph.judge_sql(), "op9_near_duplicates": lshforest.NEAR_SQL}
