"""Queries of the model tasks, asked of a stand-in that answers by a rule."""

from __future__ import annotations

import json
import re

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lectern.operators import tasks as T
from lectern.operators.completion import EchoCompleter
from lectern.plans.catalog import register
from lectern.plans.records import _T, _stop_sql, _titles
from lectern.session import table


def _inputs(question: str) -> dict[str, str]:
    return dict(re.findall(r"(?m)^([A-Z]+): (.*)$", question))


def _rule(answer) -> EchoCompleter:
    """A client that answers from the inputs of the prompt."""
    return EchoCompleter(lambda q: answer(_inputs(q)))


@register(
    "expanded_queries",
    """SELECT p_partkey, kind, query FROM (SELECT p_partkey, unnest(['core', 'core', 'theory', 'method']) AS kind, unnest([p_name, p_name || ' overview', 'theory of ' || p_name, 'methods for ' || p_name]) AS query FROM part WHERE p_size % 5 <> 0)""",
)
def expanded_queries(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Four queries for each topic; broken answers give none."""
    def answer(x):
        n = x["TOPIC"]
        made = json.dumps({"core": [n, f"{n} overview"], "theory": f"theory of {n}", "method": f"methods for {n}"})
        return f"```json\n{made}\n```" if int(x["SIZE"]) % 5 else "no idea"

    rows = table(spark, sf_dir, "part").select("p_partkey", "p_name", "p_size")
    question = T.prompt("Give two core queries, one on theory and one on methods, as JSON.", ("TOPIC", F.col("p_name")), ("SIZE", F.col("p_size")))
    return T.asked(rows, "p_partkey", question, _rule(answer), parallel=4).select("p_partkey", F.explode(T.expansion(F.col("answer"))).alias("e")).select("p_partkey", "e.kind", "e.query")


@register("named_topics", "SELECT p_partkey, CASE p_size % 3 WHEN 0 THEN 'On ' || p_name ELSE array_to_string([p_name, p_type, p_brand], ', ') END AS name FROM part")
def named_topics(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Topic names, with keywords where the answer has none."""
    answer = lambda x: json.dumps({"topic_name": f" On {x['WORDS']} "}) if int(x["SIZE"]) % 3 == 0 else '{"topic_name": ""}' if int(x["SIZE"]) % 3 == 1 else "{"
    rows = table(spark, sf_dir, "part")
    question = T.prompt("Name the topic.", ("WORDS", F.col("p_name")), ("SIZE", F.col("p_size")))
    words = F.array("p_name", "p_type", "p_brand", F.lit("more"))
    return T.asked(rows, "p_partkey", question, _rule(answer)).select("p_partkey", T.topic_name(F.col("answer"), words).alias("name"))


@register("verifiable_claims", "SELECT event_id, event_id % 4 < 2 AS verifiable FROM events")
def verifiable_claims(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Claims that can be checked; whatever isn't a clear yes is a no."""
    answer = lambda x: ["Yes.", "true", "not sure, yes", ""][int(x["ID"]) % 4]
    rows = table(spark, sf_dir, "events").select("event_id", "props")
    return T.asked(rows, "event_id", T.prompt("Can this be verified?", ("ID", F.col("event_id")), ("CLAIM", F.col("props"))), _rule(answer)).select("event_id", T.is_yes(F.col("answer")).alias("verifiable"))


@register("filtered_candidates", "WITH n AS (SELECT s_nationkey AS k, count(*) AS n FROM supplier GROUP BY 1) SELECT k AS s_nationkey, unnest(CASE k % 3 WHEN 0 THEN CASE WHEN n >= 2 THEN [2, 1] ELSE [1] END ELSE range(1, least(n, 3) + 1) END)::BIGINT AS place FROM n")
def filtered_candidates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Places of the candidates that an answer picks, the first three where it picks none; one that it names is never there."""
    answer = lambda x: [f"[2, 1, 2, {int(x['COUNT']) + 99}]", "none of them", ""][int(x["ID"]) % 3]
    rows = table(spark, sf_dir, "supplier").groupBy("s_nationkey").agg(F.count("*").alias("n"))
    got = T.asked(rows, "s_nationkey", T.prompt("Which of these are papers?", ("ID", F.col("s_nationkey")), ("COUNT", F.col("n"))), _rule(answer))
    return got.select("s_nationkey", F.explode(T.chosen(F.col("answer"), F.col("n"))).alias("place"))


@register("organised_sections", "SELECT p_partkey, CASE WHEN p_size % 4 IN (0, 1) THEN 'timeline' ELSE 'no_clear_structure' END AS kind, CASE p_size % 4 WHEN 0 THEN 3 WHEN 1 THEN 2 WHEN 2 THEN 1 ELSE 0 END::BIGINT AS members FROM (SELECT * FROM part WHERE p_name <> p_type AND p_type <> p_brand AND p_name <> p_brand)")
def organised_sections(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Claimed structures that hold half of the items or more."""
    answer = lambda x: "?" if int(x["SIZE"]) % 4 == 3 else json.dumps({"kind": "timeline", "members": [x["A"], x["B"], x["C"], x["A"]][: 3 - int(x["SIZE"]) % 4] + ["unknown"]})
    rows = table(spark, sf_dir, "part").where("p_name <> p_type AND p_type <> p_brand AND p_name <> p_brand")
    question = T.prompt("How are these organised?", ("A", F.col("p_name")), ("B", F.col("p_type")), ("C", F.col("p_brand")), ("SIZE", F.col("p_size")))
    kind, members = T.organisation(F.col("answer"), F.array("p_name", "p_type", "p_brand"))
    return T.asked(rows, "p_partkey", question, _rule(answer)).select("p_partkey", kind.alias("kind"), F.size(members).cast("long").alias("members"))


@register("missing_topics", "SELECT DISTINCT p_brand AS topic FROM part WHERE p_brand NOT IN (SELECT p_brand FROM part WHERE p_size = 7 AND p_type = 'ECONOMY')")
def missing_topics(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Topics that no block has verified evidence of."""
    part = table(spark, sf_dir, "part")
    blocks = part.select(F.col("p_brand").alias("topic"), ((F.col("p_size") == 7) & (F.col("p_type") == "ECONOMY")).alias("verified"))
    return T.still_missing(part.select(F.col("p_brand").alias("topic")).distinct(), blocks)


@register("verified_arguments", "SELECT p_partkey, 'core' AS part, 'about ' || p_name AS text FROM part WHERE p_size % 3 <> 2 UNION ALL SELECT p_partkey, 'gap', 'none' FROM part WHERE p_size % 3 = 1")
def verified_arguments(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Statements whose evidence stands in the source."""
    def answer(x):
        n = int(x["SIZE"]) % 3
        core = {"part": "core", "text": f"about {x['NAME']}", "evidence": x["NAME"].upper()}
        gap = {"part": "gap", "text": "none", "evidence": x["KIND"] if n == 1 else "never said"}
        return json.dumps({"statements": [core, gap, {"part": "gap", "text": "x", "evidence": ""}]}) if n < 2 else '{"statements": 1}'

    rows = table(spark, sf_dir, "part")
    question = T.prompt("What is argued?", ("NAME", F.col("p_name")), ("KIND", F.col("p_type")), ("SIZE", F.col("p_size")))
    got = T.asked(rows, "p_partkey", question, _rule(answer)).select("p_partkey", F.explode(T.verified_argument(F.col("answer"), F.concat_ws("  ", "p_type", "p_name"))).alias("s"))
    return got.select("p_partkey", "s.part", "s.text")


@register("final_reviews", "SELECT p_partkey, CASE WHEN p_size % 4 = 0 AND p_size BETWEEN 1 AND 10 THEN p_size END::INT AS score, p_size % 4 = 0 AND p_size BETWEEN 1 AND 10 AS valid FROM part")
def final_reviews(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Reviews that have all their parts."""
    def answer(x):
        made = {"score": int(x["SIZE"]), "strengths": ["a"], "weaknesses": []}
        return ["", json.dumps({k: v for k, v in made.items() if k != "score"}), '{"score": "high"}'][int(x["SIZE"]) % 4 - 1] if int(x["SIZE"]) % 4 else json.dumps(made)

    rows = table(spark, sf_dir, "part").select("p_partkey", "p_size")
    got = T.asked(rows, "p_partkey", T.prompt("Review the survey.", ("SIZE", F.col("p_size"))), _rule(answer)).select("p_partkey", T.final_review(F.col("answer")).alias("r"))
    return got.select("p_partkey", F.col("r.score").alias("score"), F.col("r").isNotNull().alias("valid"))


@register("topic_queries", f"WITH {_T} SELECT p_partkey, CASE WHEN p_partkey % 2 = 0 THEN 'query ' || p_partkey WHEN {_stop_sql('title')} <> '' THEN {_stop_sql('title')} ELSE trim(title) END AS query FROM t")
def topic_queries(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A query for each title, its keywords where the answer is empty."""
    answer = lambda x: f" query   {x['ID']} " if int(x["ID"]) % 2 == 0 else " "
    rows = _titles(spark, sf_dir)
    return T.asked(rows, "p_partkey", T.prompt("What is this survey's topic?", ("ID", F.col("p_partkey"))), _rule(answer)).select("p_partkey", T.topic_query(F.col("answer"), F.col("title")).alias("query"))


@register("answered_titles", "SELECT p_partkey, CASE p_size % 3 WHEN 0 THEN p_name END AS title, CASE p_size % 3 WHEN 0 THEN '2301.' || lpad((p_partkey % 100000)::VARCHAR, 5, '0') ELSE '' END AS arxiv_id FROM part")
def answered_titles(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Titles and archive ids from answers about sources."""
    answer = lambda x: json.dumps({"title": f"  {x['NAME']} ", "arxiv_id": f"arXiv:2301.{int(x['ID']) % 100000:05d}v1"}) if int(x["SIZE"]) % 3 == 0 else ["", '{"title": null}'][int(x["SIZE"]) % 2]
    rows = table(spark, sf_dir, "part")
    question = T.prompt("Which paper is this?", ("ID", F.col("p_partkey")), ("NAME", F.col("p_name")), ("SIZE", F.col("p_size")))
    title, archive = T.titled(F.col("answer"))
    return T.asked(rows, "p_partkey", question, _rule(answer)).select("p_partkey", title.alias("title"), F.coalesce(archive, F.lit("")).alias("arxiv_id"))
