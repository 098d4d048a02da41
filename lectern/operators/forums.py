"""Review forums: notes to reviews, quality gates, record ranking."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lectern.functions import text as X

# The order of a review's fields in its text.
REVIEW_FIELDS = ("review", "summary", "strengths", "weaknesses", "questions", "limitations", "soundness", "presentation", "contribution", "comment", "main_review")


def unwrapped(value: Column, plain: Column) -> Column:
    """A value that may sit in a ``{"value": v}`` wrapper."""
    return F.coalesce(value, plain)


def review_text(fields: Column) -> Column:
    """``name: text`` of the preferred fields in order, or of all fields where none of them is there; empty ones out."""
    kept = F.map_filter(fields, lambda k, v: F.trim(F.coalesce(v, F.lit(""))) != "")
    order = F.array(*[F.lit(f) for f in REVIEW_FIELDS])

    def lines(names: Column) -> Column:
        return F.array_join(F.transform(names, lambda n: F.concat(n, F.lit(": "), F.trim(F.try_element_at(kept, n)))), "\n\n")

    preferred = F.filter(order, lambda n: F.map_contains_key(kept, n))
    return F.when(F.size(preferred) > 0, lines(preferred)).otherwise(lines(F.map_keys(kept)))


def is_review(invitations: Column, text: Column) -> Column:
    joined = F.array_join(invitations, " ")
    reply = joined.rlike(X.REPLY_INVITATION) & ~F.contains(joined, F.lit("Official_Review"))
    return joined.rlike(X.REVIEW_INVITATION) & ~reply & (F.length(F.trim(text)) >= 250)


def gate(reviews: DataFrame, forum: str, text: str, least: int = 2, chars: int = 2500, long_chars: int = 700, long_least: int = 2) -> DataFrame:
    """(forum, reviews, chars, long) of forums with enough reviews, text and long reviews."""
    n = F.length(text)
    out = reviews.groupBy(forum).agg(F.count("*").alias("reviews"), F.sum(n).alias("chars"), F.count_if(n >= long_chars).alias("long"))
    return out.where((F.col("reviews") >= least) & (F.col("chars") >= chars) & (F.col("long") >= long_least))


def record_score(title: Column, abstract: Column, reviews: Column, chars: Column) -> Column:
    """Sorts records: surveys of literature, strong titles, not taxonomies alone, up to 6 reviews, characters."""
    strong = title.rlike(X.STRONG_SURVEY)
    taxonomy = F.contains(F.lower(title), F.lit("taxonomy")) & ~strong
    return F.struct(X.is_literature_survey(title, abstract).cast("int"), strong.cast("int"), -taxonomy.cast("int"), F.least(reviews, F.lit(6)), chars)


def submission(notes: DataFrame, forum: str = "forum", root: str = "forum") -> DataFrame:
    """One note of each forum: the earliest submission, else the root note (its id is ``root``'s) that has a title.
    notes: forum, id, invitations, cdate, title."""
    is_sub = F.exists("invitations", lambda i: F.contains(i, F.lit("/-/Submission")))
    is_root = (F.col(root) == F.col("id")) & (F.coalesce("title", F.lit("")) != "")
    ranked = notes.withColumn("__k", F.when(is_sub, 0).when(is_root, 1)).where("__k IS NOT NULL")
    best = ranked.groupBy(forum).agg(F.min(F.struct("__k", F.coalesce("cdate", F.lit(0)).alias("cdate"), "id", "title")).alias("m"))
    return best.select(forum, F.col("m.id").alias("id"), F.col("m.title").alias("title"))


def pdf_url(path: Column, site: str) -> Column:
    return F.when(F.coalesce(path, F.lit("")) == "", "").when(F.startswith(path, F.lit("http")), path).otherwise(F.concat(F.lit(site), path))
