"""Small projections and predicates of bibliographic records."""

from __future__ import annotations

from dataclasses import dataclass, fields

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lectern.functions.text import squeezed


def filled(c: Column) -> Column:
    """Whether a text is neither null nor blank."""
    return F.trim(F.coalesce(c, F.lit(""))) != ""


def topic_name(*aliases: Column) -> Column:
    """The first alias that isn't blank, trimmed; null without one."""
    return F.coalesce(*[F.when(filled(a), F.trim(a)) for a in aliases])


def seed_tokens(name: Column, most: int = 8) -> Column:
    """A topic's first words, cut at ``>``, ``/`` and white space."""
    return F.slice(F.filter(F.split(name, r"[>/\s]+"), lambda t: t != ""), 1, most)


def document_text(title: Column, abstract: Column) -> Column:
    """``title. abstract``; a missing part is left out."""
    return F.concat_ws(". ", F.when(filled(title), title), F.when(filled(abstract), abstract))


def citation_keys(citations: Column) -> Column:
    """Keys of citations array<struct<key, ref_text>>, the reference text where there is no key; blanks out."""
    return F.filter(F.transform(citations, lambda c: F.coalesce(F.when(filled(c["key"]), c["key"]), c["ref_text"])), filled)


def cites_once(keys: Column) -> Column:
    return F.size(keys) == 1


def is_resolved(status: Column) -> Column:
    """Whether a cited work was found, in whatever form."""
    return F.coalesce(status < 3, F.lit(False))


def is_complete(abstract: Column, references: Column, related: Column, doi: Column, key: Column, language: Column) -> Column:
    """Whether a record has all that negative mining needs, in English."""
    has = lambda a: F.size(F.coalesce(a, F.array().cast("array<string>"))) > 0
    return filled(abstract) & has(references) & has(related) & filled(doi) & filled(key) & F.coalesce(language == "en", F.lit(False))


def venue(primary: Column, other: Column, subjects: Column) -> Column:
    """The better of two venues of a record that has subjects, else null."""
    return F.when(F.size(F.coalesce(subjects, F.array().cast("array<string>"))) > 0, topic_name(primary, other))


def contained(claim: Column, paragraph: Column, anchor: Column, share: float = 0.9) -> Column:
    """Whether all of a claim's tokens stand in the paragraph, and so large a share of them around its anchor."""
    near = F.size(F.filter(claim, lambda t: F.array_contains(anchor, t)))
    return F.forall(claim, lambda t: F.array_contains(paragraph, t)) & (near >= share * F.size(claim))


def merged(left: Column, right: Column) -> Column:
    """Both maps' entries, the right one's where both have a key."""
    kept = F.map_filter(left, lambda k, _: ~F.map_contains_key(right, k))
    return F.map_concat(kept, right)


def nested_text(paragraphs: Column) -> Column:
    """array<array<text>> as paragraphs of sentences."""
    return F.array_join(F.transform(paragraphs, lambda p: F.array_join(p, " ")), "\n")


def pseudo_paragraphs(text: Column) -> Column:
    """Non-blank lines as paragraphs without citations: array<struct<text, citations>>."""
    lines = F.filter(F.transform(F.split(F.coalesce(text, F.lit("")), r"\r?\n"), lambda s: F.trim(s)), lambda s: s != "")
    return F.transform(lines, lambda s: F.struct(s.alias("text"), F.array().cast("array<string>").alias("citations")))


def numbered(items: Column) -> Column:
    """``1. a`` and so on, a line each."""
    return F.array_join(F.transform(items, lambda x, i: F.concat((i + 1).cast("string"), F.lit(". "), x)), "\n")


def representative(titles: Column) -> Column:
    """Of headings array<struct<title, depth>> the shallowest, then shortest, then first by letter."""
    ranked = F.transform(titles, lambda t: F.struct(t["depth"], F.length(t["title"]), F.lower(t["title"]), t["title"].alias("title")))
    return F.array_min(ranked)["title"]


def page(df: DataFrame, number: int, size: int, *order: Column) -> DataFrame:
    """One page of a total order, numbered from 0."""
    return df.orderBy(*order).offset(number * size).limit(size)


def flag_top(df: DataFrame, k: int, score: str, key: str) -> DataFrame:
    """Adds included: whether the row is among the k best; the k-th best row's score and key are what is compared."""
    edge = df.orderBy(F.col(score).desc(), key).limit(k).agg(F.min(F.struct(score, (-F.col(key)).alias("low"))).alias("e"))
    mine = F.struct(F.col(score), (-F.col(key)).alias("low"))
    return df.join(F.broadcast(edge)).withColumn("included", F.coalesce(mine >= F.col("e"), F.lit(False))).drop("e")


def preferred_then_rest(df: DataFrame, flag: str, score: str, key: str, most: int = 50) -> DataFrame:
    return df.orderBy(F.col(flag).desc(), F.col(score).desc(), key).limit(most)


def heading_counters(df: DataFrame, heading: str, generic: Column) -> DataFrame:
    """One row: raw, generic, duplicate and kept headings; a heading is kept once, whatever its case and blanks."""
    by = df.groupBy(F.lower(squeezed(F.col(heading)))).agg(F.count("*").alias("n"), F.count_if(generic).alias("g"))
    total = lambda c: F.coalesce(F.sum(c), F.lit(0)).cast("long")
    kept = (F.col("n") > F.col("g")).cast("long")
    return by.agg(total(F.col("n")).alias("raw"), total(F.col("g")).alias("generic"), total(F.col("n") - F.col("g") - kept).alias("duplicates"), total(kept).alias("kept"))


def topic_route(surveys: Column) -> Column:
    """How surely topics are known: from three surveys high, from one medium, else low."""
    return F.when(surveys >= 3, "high").when(surveys >= 1, "medium").otherwise("low")


@dataclass(frozen=True)
class Settings:
    """Thresholds, passed to operators as literals."""

    topic_weak: float = 0.45
    topic_covered: float = 0.55
    sentence_similarity: float = 0.97
    paragraph_similarity: float = 0.92
    redundancy_ngram: int = 5
    confidence: float = 0.6
    candidate_pool: int = 1000

    @classmethod
    def of(cls, values: dict) -> Settings:
        """From a parsed configuration; unknown names are refused, types follow the defaults'."""
        known = {f.name: type(f.default) for f in fields(cls)}
        if extra := set(values) - set(known):
            raise ValueError(f"unknown settings: {', '.join(sorted(extra))}")
        return cls(**{k: known[k](v) for k, v in values.items()})


def critical_columns(df: DataFrame, keep: tuple[str, ...], concepts: str) -> DataFrame:
    """The columns ``keep`` and the names of concepts array<struct<score, name>>, the lowest score first, earlier ones first of equals."""
    ranked = F.array_sort(F.transform(concepts, lambda c, i: F.struct(c["score"].alias("score"), i.alias("i"), c["name"].alias("name"))))
    return df.select(*keep, F.transform(ranked, lambda c: c["name"]).alias(concepts))


def with_defaults(df: DataFrame, defaults: dict[str, Column]) -> DataFrame:
    """A fixed projection: each column, or its default where it is null or not there."""
    return df.select(*[(F.coalesce(F.col(c), d) if c in df.columns else d).alias(c) for c, d in defaults.items()])


def note_title(forum_title: Column, title: Column, invitations: Column) -> Column:
    """A search note's title: its forum's, else its own if it is a submission; null without one."""
    own = F.when(F.exists(invitations, lambda i: F.contains(i, F.lit("Submission"))) & filled(title), title)
    return F.coalesce(F.when(filled(forum_title), forum_title), own)


def topic_row(name: Column, works: Column, evidence: Column) -> Column:
    """A topic as a plain record, empty lists for missing ones."""
    none = F.array().cast("array<string>")
    return F.struct(name.alias("name"), F.coalesce(works, none).alias("works"), F.coalesce(evidence, none).alias("evidence"))


def is_review_concept(concepts: Column, least: float = 0.3) -> Column:
    """Whether the first concept named a review scores over the bound. concepts: array<struct<name, score>>."""
    first = F.get(F.filter(concepts, lambda c: F.contains(F.lower(c["name"]), F.lit("review"))), F.lit(0))
    return F.coalesce(first["score"] > least, F.lit(False))


def valid_answer(answer: Column, schema: str, required: tuple[str, ...]) -> Column:
    """The parsed answer if it has every required field with the right type, else null."""
    parsed = F.from_json(answer, schema)
    ok = F.lit(True)
    for name in required:
        ok = ok & parsed[name].isNotNull()
    return F.when(ok, parsed)


def text_window(abstract: Column, sections: Column, with_end: bool) -> Column:
    """The abstract and the first section; with ``with_end`` also discussions and the last section, each once, in order.

    sections: array<struct<id, text, discussion>> in document order.
    """
    n = F.size(sections)
    wanted = lambda s, i: (i == 0) | (F.lit(with_end) & (s["discussion"] | (i == n - 1)))
    parts = F.transform(F.filter(sections, wanted), lambda s: s["text"])
    return F.array_join(F.concat(F.array(abstract), parts), "\n")
