"""Text expressions: normalisation, tokens, sentences, n-grams, readability. All are Column expressions."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

# Words of generic survey headings.
GENERIC_HEADINGS = (
    "introduction", "background", "method", "methods", "methodology", "experiment", "experiments", "evaluation", "result", "results",
    "discussion", "conclusion", "conclusions", "challenge", "challenges", "outlook", "prospect", "prospects", "frontier", "frontiers",
    "unsolved", "future work", "future works", "future direction", "future directions", "limitation", "limitations", "open problem",
    "open problems", "open question", "open questions",
)
# Words of headings that open a discussion.
DISCUSSION_HEADINGS = ("future", "limitation", "open problem", "open question", "challenge", "discussion", "outlook", "conclusion", "prospect", "frontier", "unsolved", "direction")
# Phrases that mark kinds of sentences.
GAP_PHRASES = ("little research", "no study", "has not been", "remains unclear", "lack of", "insufficient", "unexplored", "rarely", "scarcely")
FUTURE_PHRASES = ("future work", "further research", "needs to be investigated", "open question", "we call for", "remains to be determined")
SYNTHESIS_PHRASES = ("taken together", "in summary", "collectively", "overall", "these studies suggest", "the evidence indicates")
CRITIQUE_PHRASES = ("however", "but", "limitation", "drawback", "fails to", "does not consider", "overlooks", "weakness", "bias", "problematic")
# Hosts of academic publishers and archives.
ACADEMIC_HOSTS = (
    "doi.org", "arxiv.org", "openreview.net", "aclanthology.org", "dblp.org", "semanticscholar.org", "springer.com",
    "ieeexplore.ieee.org", "sciencedirect.com", "nature.com", "researchgate.net",
)
# Patterns that tell literature surveys from other uses of the word.
SURVEY_TITLE = r"(?i)\b(survey|taxonomy|tutorial)\b|literature review|systematic review|systematized literature review|scoping review|comprehensive review"
STRONG_SURVEY = r"(?i)\bsurvey\b|\bliterature review\b|\bsystematic review\b|\bsystematized literature review\b|\bscoping review\b"
NOT_A_SURVEY = (
    r"(?i)survey simulations?|survey design|survey responses?|survey questionnaire|questionnaire|polling|census|survey equipment|gnss-low cost survey|"
    r"academic survey tasks?|literature review generation|literature survey automation|catalogue generation for literature review|"
    r"llms for literature review|match the (observations|conclusions) of systematic reviews"
)
REVIEW_INVITATION = r"(?i)Official_Review|Meta_Review|Public_Review|Review$|/-/Review|Review_Form"
REPLY_INVITATION = r"(?i)Rebuttal|Author|Response|Comment|Revision|Camera_Ready|Decision"
# Words that a keyword query leaves out.
QUERY_STOP = (
    r"(?i)\b(survey|review|overview|summary|taxonomy|tutorial|perspective|open problems?|future directions?|challenges?|opportunities|progress|advances?)\b",
    r"(?i)\b(methodologies|methodology|methods?|models?|approaches?|comparison|comparisons|benchmark(?:ing)?|evaluation|applications?|trends|recent advancements?|recent advances?)\b",
    r"(?i)\b(toward|towards|on|for|of|in|with|and|an|a|the|from)\b",
)


def _re(c: Column, pattern: str, by: str) -> Column:
    return F.regexp_replace(c, pattern, by)


def squeezed(c: Column) -> Column:
    """White space runs as one blank, trimmed."""
    return F.trim(_re(c, r"\s+", " "))


def ascii_key(c: Column) -> Column:
    """Lower-cased letters and digits of ASCII, nothing between; the matching key of titles."""
    return _re(F.lower(c), r"[^0-9a-z]", "")


def normalized_title(c: Column) -> Column:
    return F.trim(_re(F.lower(c), r"[^a-z0-9]+", " "))


def punctuation_free(c: Column) -> Column:
    return squeezed(_re(c, r"[:,.!?&]", " "))


def heading_key(c: Column) -> Column:
    """A heading without its number, for keyword matching; a number needs a digit or a separator behind it, so that
    words starting with the letters of Roman numerals stay whole."""
    bare = _re(F.lower(F.trim(F.coalesce(c, F.lit("")))), r"^([0-9][0-9.]*|[ivx]+[.)-])\s*[.)-]?\s*", "")
    return squeezed(_re(F.replace(bare, F.lit("&"), F.lit(" and ")), r"[/-]", " "))


def is_generic_heading(path: Column) -> Column:
    """Of a path of headings joined by ``>``, whether the last is empty or holds a generic word."""
    leaf = heading_key(F.element_at(F.split(F.coalesce(path, F.lit("")), ">"), -1))
    return (leaf == "") | has_any(leaf, GENERIC_HEADINGS)


def has_any(c: Column, phrases: tuple[str, ...]) -> Column:
    out = F.lit(False)
    for p in phrases:
        out = out | F.contains(c, F.lit(p))
    return out


def citation_marks(c: Column) -> Column:
    """How many numbered citations like [12] a sentence holds."""
    return F.size(F.regexp_extract_all(c, F.lit(r"\[[0-9]+\]"), F.lit(0)))


def sums_up(c: Column) -> Column:
    """Whether a lower-cased sentence speaks of several works together: a phrase of synthesis and two citations or more."""
    return has_any(c, SYNTHESIS_PHRASES) & (citation_marks(c) >= 2)


def keeps_structure(title: Column, words: tuple[str, ...] = ("introduction", "conclusion", "background", "related work", "method", "experiment", "result", "discussion"), least: int = 10) -> Column:
    """Whether enough of a heading is left without structural words."""
    out = F.lower(title)
    for w in words:
        out = F.replace(out, F.lit(w), F.lit(""))
    return F.length(F.trim(out)) >= least


def slug(c: Column, most: int = 100) -> Column:
    return F.substring(_re(_re(F.lower(c), r"[^0-9a-z_]+", "_"), r"^_+|_+$", ""), 1, most)


def arxiv_id(c: Column) -> Column:
    """A modern (4.4-5 digits) or legacy (7 digits) archive id in a url or reference; empty without one."""
    modern = F.regexp_extract(c, r"(?:^|[^0-9.])([0-9]{4}\.[0-9]{4,5})(?:v[0-9]+)?(?:[^0-9]|$)", 1)
    legacy = F.regexp_extract(c, r"(?:^|[^0-9a-z])([a-z-]+(?:\.[A-Z]{2})?/[0-9]{7})(?:[^0-9]|$)", 1)
    return F.when(modern != "", modern).otherwise(legacy)


def arxiv_pdf_url(c: Column) -> Column:
    """Archive urls of any kind as the url of the PDF; other urls as they are."""
    inner = F.regexp_extract(c, r"^https?://(?:www\.)?arxiv\.org/(?:abs|html|pdf)/([^?#]+?)/?(?:[?#].*)?$", 1)
    bare = _re(inner, r"\.pdf$", "")
    return F.when(bare != "", F.concat(F.lit("https://arxiv.org/pdf/"), bare, F.lit(".pdf"))).otherwise(c)


def doi(c: Column) -> Column:
    return F.trim(_re(F.lower(F.trim(c)), r"^(https?://(dx\.)?doi\.org/|doi:\s*)", ""))


def truncated_title(c: Column) -> Column:
    """The title up to its first punctuation mark other than - _ / + &."""
    return F.trim(F.regexp_extract(c, r"^[0-9A-Za-z_\s\-/+&]*", 0))


def keyword_query(c: Column) -> Column:
    """The query without survey words, method words, connectives and punctuation; where nothing is left, as it was."""
    out = _re(F.coalesce(c, F.lit("")), r"[\-_:,.;!?(){}\[\]/\\]+", " ")
    for pattern in QUERY_STOP:
        out = _re(out, pattern, " ")
    out = squeezed(out)
    return F.when(out != "", out).otherwise(F.trim(F.coalesce(c, F.lit(""))))


def words(c: Column) -> Column:
    """Runs of letters, digits and underscores, lower-cased."""
    return F.regexp_extract_all(F.lower(c), F.lit(r"[\p{L}\p{N}_]+"), F.lit(0))


def edge_trimmed_words(c: Column) -> Column:
    """White-space tokens, lower-cased, without non-word characters at their ends; empty ones left out."""
    parts = F.transform(F.split(F.lower(c), r"\s+"), lambda t: _re(t, r"^[^\p{L}\p{N}_]+|[^\p{L}\p{N}_]+$", ""))
    return F.filter(parts, lambda t: t != "")


def latin_words(c: Column) -> Column:
    """Runs of A-Z and a-z, hyphenated ones whole."""
    return F.regexp_extract_all(c, F.lit(r"[A-Za-z]+(?:-[A-Za-z]+)*"), F.lit(0))


def sentence_count(c: Column) -> Column:
    """Sentences that end in . ! ? before white space or a capital; blank ones don't count."""
    return F.size(F.filter(F.split(c, r"[.!?]+(?:\s+|[A-Z])"), lambda s: F.trim(_re(s, r"\s+", " ")) != ""))


def let(c: Column, f: Callable[[Column], Column]) -> Column:
    """``f(c)`` with ``c`` evaluated once for each row, however often ``f`` and lambdas in it use it."""
    return F.get(F.transform(F.array(c), f), F.lit(0))


def ngrams(tokens: Column, n: int) -> Column:
    """Runs of n tokens joined by blanks; none of fewer tokens."""
    def runs(t: Column) -> Column:
        made = F.transform(F.sequence(F.lit(1), F.size(t) - (n - 1)), lambda i: F.array_join(F.slice(t, i, F.lit(n)), " "))
        return F.when(F.size(t) >= n, made).otherwise(F.array().cast("array<string>"))

    return let(tokens, runs)


def syllables(word: Column) -> Column:
    """Vowel groups (y among them) after a silent final e is gone; 1 at least."""
    low = F.lower(word)
    bare = F.when(F.length(low) > 2, _re(low, r"([^aeiou])e$", "$1")).otherwise(low)
    return F.greatest(F.lit(1), F.size(F.regexp_extract_all(_re(bare, r"[^a-z]", ""), F.lit(r"[aeiouy]+"), F.lit(0))))


def fuzzy_title(query: Column, target: Column, ratio: float = 0.1) -> Column:
    """Whether ASCII keys hold one another, or differ by up to a share of the query's key, 1 at least."""
    q, t = ascii_key(query), ascii_key(target)
    near = F.levenshtein(q, t) <= F.greatest(F.lit(1), F.floor(F.length(q) * ratio))
    return F.contains(q, t) | F.contains(t, q) | near


def strict_fuzzy_title(query: Column, target: Column, ratio: float = 0.1) -> Column:
    """The same without containment, blanks kept, the bound taken from the raw query."""
    return F.levenshtein(normalized_title(query), normalized_title(target)) <= ratio * F.length(query)


def is_listed_survey(title: Column) -> Column:
    """"survey on", "summary on", "a survey" or "a summary"."""
    return F.lower(title).rlike(r"(survey|summary) on|a (survey|summary)")


def is_literature_survey(title: Column, abstract: Column) -> Column:
    strong, taxonomy = title.rlike(STRONG_SURVEY), F.contains(F.lower(title), F.lit("taxonomy"))
    only_tutorial = title.rlike(r"(?i)\btutorial\b") & ~title.rlike(r"(?i)\bsurvey\b")
    backed = F.coalesce(abstract, F.lit("")).rlike(r"(?i)\b(survey|review|literature|systematic|comprehensive)\b")
    return F.when(title.rlike(NOT_A_SURVEY) | only_tutorial, False).when(strong, True).otherwise(taxonomy & backed)


def looks_like_citation_key(c: Column) -> Column:
    """No leading backslash or section sign, at most 2 blanks and 50 characters, under 30 % odd characters."""
    odd = F.length(_re(c, r"[0-9A-Za-z:_\-.+/ ]", ""))
    blanks = F.length(c) - F.length(F.replace(c, F.lit(" "), F.lit("")))
    return (F.length(c) > 0) & ~c.rlike(r"^[\\§]") & (blanks <= 2) & (F.length(c) <= 50) & (odd < 0.3 * F.length(c))


def is_web_url(c: Column) -> Column:
    return F.coalesce(c, F.lit("")).rlike(r"^https?://[^/?#]+")


def url_host(c: Column) -> Column:
    return F.lower(F.regexp_extract(c, r"^[A-Za-z][A-Za-z0-9+.-]*://([^/?#]*)", 1))


def academic_score(c: Column) -> tuple[Column, Column]:
    """1 or 0 each: an academic host; a path that ends in .pdf."""
    host = F.lit(False)
    for h in ACADEMIC_HOSTS:
        host = host | F.endswith(url_host(c), F.lit(h))
    return host.cast("int"), F.endswith(F.lower(c), F.lit(".pdf")).cast("int")
