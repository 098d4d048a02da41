"""Number, date, map and JSON expressions over bibliographic records."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F

from lectern.functions.text import let


def count_as_of(total: Column, by_year: Column, year: Column) -> Column:
    """Citations up to a year: the total without later years' counts or, where the total is 0 or missing, the sum of
    years up to it; 0 at least. by_year: array<struct<year, cited_by_count>>."""
    def summed(keep) -> Column:
        kept = F.filter(F.coalesce(by_year, F.array().cast("array<struct<year:int,cited_by_count:bigint>>")), keep)
        return F.aggregate(kept, F.lit(0).cast("long"), lambda acc, x: acc + x["cited_by_count"])

    has = F.coalesce(total, F.lit(0)) != 0
    return F.greatest(F.lit(0), F.when(has, total - summed(lambda x: x["year"] > year)).otherwise(summed(lambda x: x["year"] <= year)))


def paper_age(year: Column, published: Column) -> Column:
    """Years since publication, the first one counted, 1 at least; without a date: 1."""
    return F.greatest(F.lit(1), year - F.coalesce(F.year(published), year) + 1)


def year_of(text: Column) -> Column:
    """The first four characters where they are digits, else null."""
    return F.when(text.rlike(r"^[0-9]{4}"), F.substring(text, 1, 4).cast("int"))


def log_share(x: Column, most: Column) -> Column:
    """log(1 + x) / log(1 + most), a most of 0 or null counting as 1."""
    return F.log1p(x) / F.log1p(F.when(F.coalesce(most, F.lit(0)) == 0, 1).otherwise(most))


def abstract_of(index: Column) -> Column:
    """Text from an inverted index map<word, array<position>>; gaps as <mask>; null for a null or empty index."""
    at = F.flatten(F.transform(F.map_entries(index), lambda e: F.transform(e["value"], lambda p: F.struct(p.alias("p"), e["key"].alias("w")))))

    def joined(sorted_: Column) -> Column:
        def with_gap(x: Column, i: Column) -> Column:
            before = F.when(i > 0, F.get(sorted_, i - 1)["p"]).otherwise(F.lit(-1))
            return F.concat(F.array_repeat(F.lit("<mask>"), (x["p"] - before - 1).cast("int")), F.array(x["w"]))

        return F.array_join(F.flatten(F.transform(sorted_, with_gap)), " ")

    return F.when(F.size(index) > 0, let(F.array_sort(at), joined))


def inverted_index(tokens: Column) -> Column:
    """map<word, array<position>> of an array of tokens."""
    words = F.array_distinct(tokens)
    spots = F.transform(words, lambda w: F.filter(F.transform(tokens, lambda t, i: F.when(t == w, i)), lambda i: i.isNotNull()))
    return F.map_from_arrays(words, spots)


def filter_string(pairs: Column) -> Column:
    """``k:v,k:v`` of a map, keys in order."""
    return F.array_join(F.transform(F.array_sort(F.map_entries(pairs)), lambda e: F.concat(e["key"], F.lit(":"), e["value"])), ",")


def citation_status(content: Column, abstract: Column, metadata: Column) -> Column:
    """0 full text, 1 abstract only, 2 metadata only, 3 unresolved."""
    def has(c: Column) -> Column:
        return F.coalesce(c, F.lit("")) != ""

    return F.when(has(content), 0).when(has(abstract), 1).when(has(metadata), 2).otherwise(3)


def author_names(names: Column) -> Column:
    """White space collapsed, empty names out, first mentions kept."""
    return F.array_distinct(F.filter(F.transform(names, lambda a: F.trim(F.regexp_replace(a, r"\s+", " "))), lambda a: a != ""))


def evidence_confidence(coverage: Column, hits: Column, compact: Column, weight: float = 0.7, penalty: float = 0.6) -> Column:
    base = weight * coverage + (1 - weight) * hits
    return F.when(compact, base).otherwise(penalty * base)


def json_text(text: Column) -> Column:
    """The JSON in a model's answer: the text itself, else its last fenced block, else from the first to the last brace
    with trailing commas removed; null where none parses."""
    fenced = F.element_at(F.regexp_extract_all(text, F.lit(r"(?s)```(?:json)?\s*(.*?)```"), F.lit(1)), -1)
    braces = F.regexp_extract(text, r"(?s)\{.*\}", 0)
    mended = F.regexp_replace(braces, r",\s*([}\]])", "$1")
    tries = [text, F.when(F.size(F.regexp_extract_all(text, F.lit(r"(?s)```(?:json)?\s*(.*?)```"), F.lit(1))) > 0, fenced), braces, mended]
    bare = [F.regexp_replace(t, r"^\s+|\s+$", "") for t in tries]
    return F.coalesce(*[F.when(F.try_parse_json(t).isNotNull() & (t != ""), t) for t in bare])


def matches_any_of_groups(text: Column, groups: Sequence[Sequence[str]]) -> Column:
    """Whether, for each group, the text holds one of its terms."""
    out = F.lit(True)
    for group in groups:
        one = F.lit(False)
        for term in group:
            one = one | F.contains(text, F.lit(term))
        out = out & one
    return out


def split_outside(text: str, word: str) -> list[str]:
    """Splits at a word that stands outside all parentheses and quotes."""
    out, depth, quoted, begin, i = [], 0, False, 0, 0
    mark = f" {word} "
    while i < len(text):
        c = text[i]
        quoted ^= c == '"'
        depth += (c == "(") - (c == ")") if not quoted else 0
        if depth == 0 and not quoted and text[i : i + len(mark)].upper() == mark:
            out.append(text[begin:i])
            i = begin = i + len(mark)
            continue
        i += 1
    return [p.strip() for p in [*out, text[begin:]] if p.strip()]


def boolean_groups(query: str) -> list[list[str]]:
    """``(a OR b) AND c`` as groups of terms: all groups must match, by any term of theirs."""
    def bare(s: str) -> str:
        s = s.strip()
        while s.startswith("(") and s.endswith(")"):
            depth = 0
            for i, c in enumerate(s):
                depth += (c == "(") - (c == ")")
                if depth == 0 and i < len(s) - 1:
                    return s
            s = s[1:-1].strip()
        return s

    parts = split_outside(bare(query), "AND")
    while any(len(split_outside(bare(p), "AND")) > 1 for p in parts):
        parts = [q for p in parts for q in split_outside(bare(p), "AND")]
    groups = []
    for part in parts:
        terms = [bare(t).strip('" ').lower() for t in split_outside(bare(part), "OR")]
        if any(terms):
            groups.append([t for t in terms if t])
    return groups
