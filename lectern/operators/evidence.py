"""Evidence and structure: quotes found in sources, chunks for judging, checks of a paper's parts."""

from __future__ import annotations

import re
from collections.abc import Iterator
from difflib import SequenceMatcher

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lectern.functions.text import DISCUSSION_HEADINGS, has_any

# Thresholds of quote checks.
COVERAGE, LEAST_CHARS, WIDEST_GAP, WEIGHT, PENALTY, PASS = 0.6, 20, 300, 0.7, 0.6, 0.6
_EDGE = re.compile(r"^\W+|\W+$")


def tokens(text: str) -> list[str]:
    return [t for t in (_EDGE.sub("", x.lower()) for x in text.split()) if t]


def longest_run(a: list[str], b: list[str]) -> tuple[int, int, int]:
    """(length, start in a, start in b) of the longest run of tokens in both; of equals the first in a, then in b.

    Every token counts, however frequent: runs that end at a's i-th token grow from those that ended at the one before.
    """
    at: dict[str, list[int]] = {}
    for j, t in enumerate(b):
        at.setdefault(t, []).append(j)
    best, ends = (0, 0, 0), {}
    for i, t in enumerate(a):
        ends = {j: ends.get(j - 1, 0) + 1 for j in at.get(t, ())}
        for j, n in ends.items():
            if n > best[0]:
                best = (n, i - n + 1, j - n + 1)
    return best


def verify_quote(quotes: list[str], source: str) -> tuple[bool, float]:
    """Whether quotes stand in a source, and how surely.

    A quote of 20 characters or more counts; the share of it that its longest run in the source covers is its coverage,
    if that is 0.6 or more. Sureness weighs the mean coverage of quotes found and the share of quotes found; it falls
    where two found runs lie over 300 tokens apart.
    """
    wanted = [q for q in map(tokens, quotes) if sum(map(len, q)) >= LEAST_CHARS]
    doc = tokens(source)
    runs = [(longest_run(q, doc), len(q)) for q in wanted]
    found = sorted((start, start + n, n / size) for (n, _, start), size in runs if n >= COVERAGE * size)
    if not found:
        return False, 0.0
    sure = WEIGHT * sum(f[2] for f in found) / len(found) + (1 - WEIGHT) * len(found) / len(wanted)
    if any(later[0] - before[1] > WIDEST_GAP for before, later in zip(found, found[1:], strict=False)):
        sure *= PENALTY
    return sure > PASS, sure


def similar_title(a: str, b: str, least: float = 0.9) -> bool:
    return SequenceMatcher(None, a.lower(), b.lower()).ratio() >= least


def verified(pairs: DataFrame, keys: list[str], quote: str, source: str) -> DataFrame:
    """(keys, verified, confidence) for pairs of a quote and a source."""
    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for f in frames:
            got = [verify_quote([q or ""], s or "") for q, s in zip(f[quote], f[source], strict=True)]
            yield f[keys].assign(verified=[g[0] for g in got], confidence=[round(g[1], 6) for g in got])

    kinds = dict(pairs.dtypes)
    return pairs.select(*keys, quote, source).mapInPandas(run, ", ".join([*[f"{k} {kinds[k]}" for k in keys], "verified boolean, confidence double"]))


def chunks(paragraphs: list[str], most: int = 5, chars: int = 10_000) -> list[str]:
    """Paragraphs grouped in order: five at most and up to 10,000 characters, two for each join; a longer one alone."""
    out: list[list[str]] = []
    size = 0
    for p in paragraphs:
        grown = size + 2 + len(p)
        if not out or len(out[-1]) >= most or grown > chars:
            out.append([])
            grown = len(p)
        out[-1].append(p)
        size = grown
    return ["\n\n".join(c) for c in out]


def chunked(docs: DataFrame, key: str, text: str) -> DataFrame:
    """(key, chunk, paragraphs, chars) over the texts' non-blank lines."""
    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for f in frames:
            rows = [(k, i, c.count("\n\n") + 1, len(c)) for k, t in zip(f[key], f[text], strict=True) for i, c in enumerate(chunks([x.strip() for x in (t or "").split("\n") if x.strip()]))]
            yield pd.DataFrame(rows, columns=[key, "chunk", "paragraphs", "chars"])

    return docs.select(key, text).mapInPandas(run, f"{key} {dict(docs.dtypes)[key]}, chunk int, paragraphs int, chars long")


def discussion_sections(sections: DataFrame) -> DataFrame:
    """Sections whose title speaks of discussion and that lie in no other such section. sections: doc_id, path, title."""
    hits = sections.where(has_any(F.lower("title"), DISCUSSION_HEADINGS))
    above = hits.select("doc_id", F.col("path").alias("up"))
    under = (F.size("up") < F.size("path")) & (F.slice("path", 1, F.size("up")) == F.col("up"))
    inside = hits.join(above, "doc_id").where(under).select("doc_id", "path").distinct()
    return hits.join(inside, ["doc_id", "path"], "left_anti").withColumn("depth", F.size("path"))


def minimum_check(papers: DataFrame) -> Column:
    """pass, or the stage that fails. papers: title, top_titles array<string>, discussions int."""
    marked = has_any(F.lower(F.coalesce("title", F.lit(""))), ("survey", "review", "overview", "taxonomy", "summary", "synthesis"))
    intro = F.exists("top_titles", lambda t: has_any(F.lower(t), ("intro", "background", "overview")))
    return F.when(~(marked | intro), "title_structure").when(F.col("discussions") == 0, "discussion_candidates").otherwise("pass")


def unclear_share(sections: DataFrame, least_works: int = 3, limit: float = 0.8) -> DataFrame:
    """(doc_id, share, ok): the share of unclear sections among those with enough works; 0.8 or more fails."""
    strong = sections.where(F.col("works") >= least_works)
    out = strong.groupBy("doc_id").agg((F.count_if(F.col("kind") == "unclear") / F.count("*")).alias("share"))
    return out.withColumn("ok", F.col("share") < limit)


def clear_kind(kind: Column, members: Column, n: Column) -> Column:
    """A claimed structure is none if its distinct members are under half of the items, one at least."""
    return F.when(F.size(F.array_distinct(members)) < F.greatest(F.lit(1), n / 2), "no_clear_structure").otherwise(kind)
