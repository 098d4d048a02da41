"""Tasks for a remote model: for each its prompt, and what becomes of an answer; broken answers have a defined result.

A task is asked through :func:`lectern.operators.completion.completed`. Prompts and parsers are Column expressions, so
only the call itself leaves the JVM.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lectern.functions import scalars as M
from lectern.functions import text as X
from lectern.functions.projections import filled, valid_answer
from lectern.operators.completion import Completer, completed


def prompt(task: str, *inputs: tuple[str, Column]) -> Column:
    """The task's instruction, then ``NAME: value`` lines; a null input counts as empty."""
    lines = [F.concat(F.lit(f"{name}: "), F.coalesce(value.cast("string"), F.lit(""))) for name, value in inputs]
    return F.concat_ws("\n", F.lit(task), *lines)


def asked(df: DataFrame, key: str, question: Column, client: Completer, parallel: int = 1) -> DataFrame:
    """``df`` with the client's answer to each row's question as ``answer``."""
    got = completed(df.select(key, question.alias("question")), key, "question", client, parallel=parallel)
    return df.join(got, key)


def expansion(answer: Column) -> Column:
    """The four queries of an expansion as array<struct<kind, query>>; empty where one of them is missing."""
    a = valid_answer(M.json_text(answer), "core array<string>, theory string, method string", ("core", "theory", "method"))
    made = F.array(*[F.struct(F.lit(k).alias("kind"), q.alias("query")) for k, q in (("core", F.get(a["core"], F.lit(0))), ("core", F.get(a["core"], F.lit(1))), ("theory", a["theory"]), ("method", a["method"]))])
    return F.when(a.isNotNull() & (F.size(a["core"]) == 2), made).otherwise(F.array().cast("array<struct<kind:string,query:string>>"))


def topic_name(answer: Column, keywords: Column) -> Column:
    """The name in the answer, else the first three keywords."""
    name = valid_answer(M.json_text(answer), "topic_name string", ("topic_name",))["topic_name"]
    return F.when(filled(name), F.trim(name)).otherwise(F.array_join(F.slice(keywords, 1, 3), ", "))


def is_yes(answer: Column) -> Column:
    """A verdict; anything but a clear yes is a no."""
    return F.coalesce(F.lower(F.trim(answer)).rlike(r"^(yes|true)\b"), F.lit(False))


def chosen(answer: Column, n: Column, fallback: int = 3) -> Column:
    """1-based places that the answer names, in its order, each once and within 1 to n; of none, the first few."""
    named = F.transform(F.regexp_extract_all(F.coalesce(answer, F.lit("")), F.lit(r"\d{1,9}"), F.lit(0)), lambda x: x.cast("long"))
    good = F.array_distinct(F.filter(named, lambda x: (x >= 1) & (x <= n)))
    return F.when(F.size(good) > 0, good).otherwise(F.when(n > 0, F.sequence(F.lit(1).cast("long"), F.least(n.cast("long"), F.lit(fallback).cast("long")))).otherwise(F.array().cast("array<bigint>")))


def organisation(answer: Column, items: Column) -> tuple[Column, Column]:
    """(kind, members): a claimed structure and its distinct members; none where under half of the items are members."""
    a = valid_answer(M.json_text(answer), "kind string, members array<string>", ("kind", "members"))
    members = F.array_distinct(F.filter(a["members"], lambda m: F.array_contains(items, m)))
    clear = F.size(members) >= F.greatest(F.lit(1), F.size(items) / 2)
    return F.when(a.isNotNull() & clear, a["kind"]).otherwise("no_clear_structure"), F.coalesce(members, F.array().cast("array<string>"))


def verified_argument(answer: Column, source: Column) -> Column:
    """Statements of an argument, array<struct<part, text>>, whose evidence stands in the source word for word."""
    schema = "statements array<struct<part:string,text:string,evidence:string>>"
    a = valid_answer(M.json_text(answer), schema, ("statements",))["statements"]
    flat = lambda c: X.squeezed(F.lower(c))
    kept = F.filter(a, lambda s: filled(s["evidence"]) & F.contains(flat(source), flat(s["evidence"])))
    return F.coalesce(F.transform(kept, lambda s: F.struct(s["part"].alias("part"), s["text"].alias("text"))), F.array().cast("array<struct<part:string,text:string>>"))


def still_missing(topics: DataFrame, blocks: DataFrame) -> DataFrame:
    """Topics that no block of text gives verified evidence of. topics: topic; blocks: topic, verified boolean."""
    found = blocks.groupBy("topic").agg(F.bool_or("verified").alias("found"))
    return topics.join(found, "topic", "left").where(~F.coalesce("found", F.lit(False))).drop("found")


def final_review(answer: Column) -> Column:
    """struct<score, strengths, weaknesses> of a review that has all of them and a score of 1 to 10, else null."""
    a = valid_answer(M.json_text(answer), "score int, strengths array<string>, weaknesses array<string>", ("score", "strengths", "weaknesses"))
    return F.when(a["score"].between(1, 10), a)


def topic_query(answer: Column, title: Column) -> Column:
    """The query that the answer gives for a title, else the title's keywords."""
    return F.when(filled(answer), X.squeezed(answer)).otherwise(X.keyword_query(title))


def titled(answer: Column) -> tuple[Column, Column]:
    """(title, archive id) from an answer; null and empty where it has none."""
    a = F.from_json(M.json_text(answer), "title string, arxiv_id string")
    return F.when(filled(a["title"]), X.squeezed(a["title"])), X.arxiv_id(F.coalesce(a["arxiv_id"], F.lit("")))
