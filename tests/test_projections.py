"""Small projections."""

from __future__ import annotations

import pytest
from pyspark.sql import functions as F

from lectern.functions import projections as P


def value(spark, column):
    return spark.range(1).select(column.alias("x")).first().x


def arr(*xs):
    return F.array(*map(F.lit, xs)).cast("array<string>")


@pytest.mark.parametrize(
    ("made", "expected"),
    [
        (lambda: P.topic_name(F.lit(" "), F.lit(None).cast("string"), F.lit(" x ")), "x"),
        (lambda: P.seed_tokens(F.lit("A > b/c d"), 3), ["A", "b", "c"]),
        (lambda: P.document_text(F.lit("T"), F.lit(None).cast("string")), "T"),
        (lambda: P.document_text(F.lit("T"), F.lit("a")), "T. a"),
        (lambda: P.citation_keys(F.array(*[F.struct(F.lit(k).alias("key"), F.lit(r).alias("ref_text")) for k, r in (("", "r"), ("k", "s"))])), ["r", "k"]),
        (lambda: P.is_resolved(F.lit(None).cast("int")), False),
        (lambda: P.is_complete(F.lit("a"), arr("r"), arr("s"), F.lit("d"), F.lit("i"), F.lit("en")), True),
        (lambda: P.is_complete(F.lit("a"), arr(), arr("s"), F.lit("d"), F.lit("i"), F.lit("en")), False),
        (lambda: P.venue(F.lit(""), F.lit("V"), arr("cs")), "V"),
        (lambda: P.venue(F.lit("U"), F.lit("V"), arr()), None),
        (lambda: P.contained(arr("a", "b"), arr("a", "b", "c"), arr("b", "a")), True),
        (lambda: P.contained(arr("a", "b"), arr("a", "b", "c"), arr("b")), False),
        (lambda: P.merged(F.create_map(F.lit("a"), F.lit(1), F.lit("b"), F.lit(2)), F.create_map(F.lit("b"), F.lit(3))), {"a": 1, "b": 3}),
        (lambda: P.nested_text(F.array(arr("a", "b"), arr("c"))), "a b\nc"),
        (lambda: F.transform(P.pseudo_paragraphs(F.lit("a\n\n b ")), lambda x: x["text"]), ["a", "b"]),
        (lambda: P.numbered(arr("x", "y")), "1. x\n2. y"),
        (lambda: P.representative(F.array(*[F.struct(F.lit(t).alias("title"), F.lit(d).alias("depth")) for t, d in (("Long one", 1), ("One", 1), ("I", 2))])), "One"),
        (lambda: P.topic_route(F.lit(2)), "medium"),
    ],
)
def test_projection(spark, made, expected):
    assert value(spark, made()) == expected


def test_pages_and_flags(spark):
    df = spark.range(10).withColumn("score", F.col("id") % 4)
    pages = [r.id for k in range(4) for r in P.page(df, k, 3, F.col("score").desc(), F.col("id")).collect()]
    assert pages == [r.id for r in df.orderBy(F.col("score").desc(), "id").collect()]
    flagged = {r.id for r in P.flag_top(df, 4, "score", "id").where("included").collect()}
    assert flagged == set(pages[:4])
    counters = P.heading_counters(spark.createDataFrame([("A",), ("a ",), ("Methods",)], "h string"), "h", F.col("h") == "Methods").first()
    assert tuple(counters) == (3, 1, 1, 1)


def test_settings():
    assert P.Settings.of({"redundancy_ngram": "4"}).redundancy_ngram == 4
    with pytest.raises(ValueError, match="unknown"):
        P.Settings.of({"nope": 1})
