"""Queries of small projections, predicates and joins of bibliographic records, over tables that stand for them."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lectern.functions import projections as P
from lectern.functions import scalars as M
from lectern.functions import text as X
from lectern.operators import citations as C
from lectern.operators import evidence, forums
from lectern.plans.catalog import register
from lectern.plans.documents import _READ, _TOK, ngram_redundancy, readability
from lectern.plans.records import _T, _p, _titles
from lectern.session import checkpoint_folder, table
from lectern.sources import files, works


def _part(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "part")


def _talks(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "conversations")


# ---------------------------------------------------------------- projections


@register(
    "topic_labels",
    r"""WITH a AS (SELECT p_partkey, p_size, p_type, CASE WHEN p_size % 3 = 0 THEN '  ' ELSE ' ' || p_name || ' ' END AS alias, p_name || ' > ' || p_type || '/' || p_brand || ' x y z w' AS path, p_name FROM part)
    SELECT p_partkey, trim(CASE WHEN trim(alias) <> '' THEN alias ELSE p_type END) AS name, array_to_string([t FOR t IN regexp_split_to_array(path, '[>/\s]+') IF t <> ''][1:4], '|') AS seeds,
      concat_ws('. ', CASE WHEN p_size % 2 = 0 THEN p_name END, CASE WHEN p_size % 5 <> 0 THEN p_type END) AS text FROM a""",
)
def topic_labels(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Names from aliases, seed words from topic paths, document texts from parts that may be missing."""
    alias = F.when(F.col("p_size") % 3 == 0, "  ").otherwise(F.concat(F.lit(" "), "p_name", F.lit(" ")))
    path = F.concat("p_name", F.lit(" > "), "p_type", F.lit("/"), "p_brand", F.lit(" x y z w"))
    text = P.document_text(F.when(F.col("p_size") % 2 == 0, F.col("p_name")), F.when(F.col("p_size") % 5 != 0, F.col("p_type")))
    return _part(spark, sf_dir).select("p_partkey", P.topic_name(alias, F.col("p_type")).alias("name"), F.array_join(P.seed_tokens(path, 4), "|").alias("seeds"), text.alias("text"))


@register("topic_rows", "WITH n AS (SELECT s_nationkey AS k, string_agg(s_name, '|' ORDER BY s_name) AS s, count(*) AS n FROM supplier GROUP BY 1) SELECT n_nationkey, n_name AS name, coalesce(s, '') AS works, CASE WHEN n > 2 THEN coalesce(s, '') ELSE '' END AS evidence FROM nation LEFT JOIN n ON k = n_nationkey")
def topic_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Topics as plain records; missing lists are empty."""
    own = table(spark, sf_dir, "supplier").groupBy(F.col("s_nationkey").alias("n_nationkey")).agg(F.sort_array(F.collect_list("s_name")).alias("s"))
    rows = table(spark, sf_dir, "nation").join(own, "n_nationkey", "left")
    t = rows.select("n_nationkey", P.topic_row(F.col("n_name"), F.col("s"), F.when(F.size("s") > 2, F.col("s"))).alias("t"))
    return t.select("n_nationkey", F.col("t.name").alias("name"), F.array_join("t.works", "|").alias("works"), F.array_join("t.evidence", "|").alias("evidence"))


@register(
    "work_records",
    r"""WITH w AS (SELECT item_id, regexp_extract_all(text, '[^\x20\x09-\x0D]+', 0) AS w FROM benchmark)
    SELECT 'W' || item_id AS id, trim(regexp_replace('  ' || w[1] || '   ' || w[2] || ' ', '\s+', ' ', 'g')) AS title, md5(array_to_string(w, ' ')) AS abstract,
      CASE WHEN item_id % 2 = 0 THEN '2020-01-01' ELSE '2019-05-05' END AS published, CASE WHEN item_id % 3 = 0 THEN 0 ELSE item_id END AS cited_by_count, 'W1|W' || item_id AS refs, 'W' || item_id AS ids,
      w[1] || '|' || w[2] AS authors FROM w WHERE item_id % 7 <> 0""",
)
def work_records(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Raw records as works: bare ids, squeezed titles, abstracts from inverted indexes, dates with a fallback; and
    authors, each once."""
    w = F.regexp_extract_all("text", F.lit(r"[^\x20\x09-\x0D]+"), F.lit(0))
    i = F.col("item_id")
    url = F.concat(F.lit("https://works.example.org/W"), i.cast("string"))
    a, b = F.get("w", F.lit(0)), F.get("w", F.lit(1))
    raw = table(spark, sf_dir, "benchmark").select("item_id", w.alias("w")).select(
        url.alias("id"), F.when(i % 7 != 0, F.concat(F.lit("  "), a, F.lit("   "), b, F.lit(" "))).alias("title"), M.inverted_index(F.col("w")).alias("abstract_inverted_index"),
        F.when(i % 2 == 0, "2020-01-01").alias("publication_date"), F.lit("2019-05-05").alias("created_date"), F.when(i % 3 != 0, i).alias("cited_by_count"),
        F.array(F.lit("https://works.example.org/W1"), url).alias("referenced_works"), M.author_names(F.array(a, F.lit(" "), F.concat(b, F.lit("  ")), F.concat(F.lit(" "), a))).alias("authors"),
    )
    authors = raw.select(F.regexp_replace("id", r"^https?://[^/]+/", "").alias("id"), F.array_join(F.array_distinct("authors"), "|").alias("authors"))
    out = works.normalized_works(raw).join(authors, "id")
    return out.select("id", "title", F.md5("abstract").alias("abstract"), F.col("publication_date").alias("published"), "cited_by_count", F.array_join("referenced_works", "|").alias("refs"), F.array_join("ids", "|").alias("ids"), "authors")


@register(
    "critical_details",
    "SELECT p_partkey, p_name AS title, array_to_string([x[3] FOR x IN list_sort([[lpad((p_size % 7)::VARCHAR, 2, '0'), '0', p_brand], [lpad((p_size * 3 % 5)::VARCHAR, 2, '0'), '1', p_type], [lpad((p_size % 4)::VARCHAR, 2, '0'), '2', p_name]])], '|') AS concepts FROM part",
)
def critical_details(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The columns that matter, concepts by rising score."""
    size = F.col("p_size")
    concepts = F.array(*[F.struct(s.alias("score"), F.col(c).alias("name")) for s, c in ((size % 7, "p_brand"), (size * 3 % 5, "p_type"), (size % 4, "p_name"))])
    rows = _part(spark, sf_dir).select("p_partkey", F.col("p_name").alias("title"), concepts.alias("concepts"))
    return P.critical_columns(rows, ("p_partkey", "title"), "concepts").withColumn("concepts", F.array_join("concepts", "|"))


@register("metadata_rows", "SELECT p_partkey AS id, p_name AS title, coalesce(nullif(p_type, 'ECONOMY'), '') AS abstract, coalesce(CASE WHEN p_size % 2 = 0 THEN p_size END, 0)::BIGINT AS cited_by_count, 'en' AS language, 0::BIGINT AS year FROM part")
def metadata_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A fixed projection with defaults."""
    rows = _part(spark, sf_dir).select(F.col("p_partkey").alias("id"), F.col("p_name").alias("title"), F.when(F.col("p_type") != "ECONOMY", F.col("p_type")).alias("abstract"), F.when(F.col("p_size") % 2 == 0, F.col("p_size").cast("long")).alias("cited_by_count"))
    zero = F.lit(0).cast("long")
    return P.with_defaults(rows, {"id": zero, "title": F.lit(""), "abstract": F.lit(""), "cited_by_count": zero, "language": F.lit("en"), "year": zero})


@register("note_titles", "SELECT conv_id, turn, role, CASE WHEN turn % 3 = 1 AND trim(text) <> '' THEN md5(text) WHEN role = 'user' AND trim(text) <> '' THEN md5(text || '!') END AS title FROM conversations")
def note_titles(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Titles of search notes, whose values may sit in wrappers: the forum's, else a submission's own."""
    wrapped = F.when(F.col("turn") % 2 == 0, F.struct(F.col("text").alias("value")))
    content = forums.unwrapped(wrapped["value"], F.col("text"))
    invitations = F.when(F.col("role") == "user", F.array(F.lit("x/-/Submission"))).otherwise(F.array(F.lit("x/-/Comment")))
    full = F.trim(F.coalesce("text", F.lit(""))) != ""
    title = P.note_title(F.when(F.col("turn") % 3 == 1, content), F.when(full, F.concat(content, F.lit("!"))), invitations)
    return _talks(spark, sf_dir).select("conv_id", "turn", "role", F.md5(title).alias("title"))


@register(
    "citation_lists",
    """WITH k AS (SELECT l_orderkey, CASE WHEN l_linenumber % 2 = 0 THEN 'k' || l_partkey ELSE 'r' || l_suppkey END AS k, l_linenumber, l_partkey, l_suppkey FROM lineitem WHERE l_quantity > 45 AND l_linenumber % 5 <> 4)
    SELECT l_orderkey, string_agg(k, '|' ORDER BY l_linenumber, l_partkey, l_suppkey) AS keys, count(*) = 1 AS once, count(*) FILTER (l_linenumber % 5 < 3)::BIGINT AS resolved FROM k GROUP BY l_orderkey""",
)
def citation_lists(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Citation keys, reference texts standing in, whether there is one alone, and how many were resolved."""
    n = F.col("l_linenumber")
    key = F.when(n % 2 == 0, F.concat(F.lit("k"), F.col("l_partkey").cast("string"))).otherwise("")
    ref = F.when(n % 5 != 4, F.concat(F.lit("r"), F.col("l_suppkey").cast("string"))).otherwise("")
    lines = table(spark, sf_dir, "lineitem").where("l_quantity > 45 AND l_linenumber % 5 <> 4")
    cited = lines.groupBy("l_orderkey").agg(F.sort_array(F.collect_list(F.struct("l_linenumber", "l_partkey", "l_suppkey", key.alias("key"), ref.alias("ref_text")))).alias("c"), F.count_if(P.is_resolved(n % 5)).alias("resolved"))
    keys = P.citation_keys(F.col("c"))
    return cited.select("l_orderkey", F.array_join(keys, "|").alias("keys"), P.cites_once(keys).alias("once"), "resolved")


@register(
    "map_merges",
    "SELECT p_partkey, 'a:' || p_brand || ',b:' || CASE WHEN p_size % 2 = 0 THEN p_name ELSE p_type END || CASE WHEN p_size % 2 = 0 THEN ',c:' || p_size ELSE '' END AS merged FROM part",
)
def map_merges(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Two maps as one filter string, the right one's entries first."""
    left = F.create_map(F.lit("b"), F.col("p_type"), F.lit("a"), F.col("p_brand"))
    right = F.when(F.col("p_size") % 2 == 0, F.create_map(F.lit("c"), F.col("p_size").cast("string"), F.lit("b"), F.col("p_name"))).otherwise(F.map_from_arrays(F.array().cast("array<string>"), F.array().cast("array<string>")))
    return _part(spark, sf_dir).select("p_partkey", M.filter_string(P.merged(left, right)).alias("merged"))


@register(
    "outline_texts",
    r"""WITH l AS (SELECT doc_id, [trim(x) FOR x IN regexp_split_to_array(coalesce(text, ''), '\r?\n') IF trim(x) <> ''] AS p FROM documents)
    SELECT doc_id, len(p)::BIGINT AS paragraphs, md5(array_to_string([i || '. ' || p[i] FOR i IN range(1, len(p)::BIGINT + 1)], chr(10))) AS numbered, md5(array_to_string([regexp_replace(x, '\s+', ' ', 'g') FOR x IN p], chr(10))) AS nested FROM l""",
)
def outline_texts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Texts as pseudo paragraphs, numbered and nested, and back as text."""
    lines = F.transform(P.pseudo_paragraphs(F.col("text")), lambda p: p["text"])
    docs = table(spark, sf_dir, "documents").select("doc_id", lines.alias("p"))
    nested = F.transform("p", lambda x: F.split(x, r"\s+"))
    return docs.select("doc_id", F.size("p").cast("long").alias("paragraphs"), F.md5(P.numbered(F.col("p"))).alias("numbered"), F.md5(P.nested_text(nested)).alias("nested"))


@register("representatives", "SELECT s_nationkey, (array_agg(s_name ORDER BY s_suppkey % 3, length(s_name), lower(s_name)))[1] AS title FROM supplier GROUP BY s_nationkey")
def representatives(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Of each nation's headings the shallowest, then shortest."""
    rows = table(spark, sf_dir, "supplier").groupBy("s_nationkey").agg(F.collect_list(F.struct(F.col("s_name").alias("title"), (F.col("s_suppkey") % 3).alias("depth"))).alias("t"))
    return rows.select("s_nationkey", P.representative(F.col("t")).alias("title"))


@register("result_page", "SELECT p_partkey, p_retailprice FROM part ORDER BY p_retailprice DESC, p_partkey LIMIT 20 OFFSET 60")
def result_page(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The fourth page of twenty."""
    return P.page(_part(spark, sf_dir).select("p_partkey", "p_retailprice"), 3, 20, F.col("p_retailprice").desc(), F.col("p_partkey"))


@register("included_flags", "SELECT p_partkey, row_number() OVER (ORDER BY p_retailprice DESC, p_partkey) <= 50 AS included FROM part")
def included_flags(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every part, the fifty dearest flagged."""
    return P.flag_top(_part(spark, sf_dir), 50, "p_retailprice", "p_partkey").select("p_partkey", "included")


@register("preferred_parts", "SELECT p_partkey FROM part ORDER BY (p_size > 45) DESC, p_retailprice DESC, p_partkey LIMIT 50")
def preferred_parts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return P.preferred_then_rest(_part(spark, sf_dir).withColumn("flag", F.col("p_size") > 45), "flag", "p_retailprice", "p_partkey").select("p_partkey")


@register("heading_counts", r"WITH h AS (SELECT p_partkey, p_name, lower(trim(regexp_replace(p_name, '\s+', ' ', 'g'))) AS k, p_size < 5 AS g FROM part), f AS (SELECT *, row_number() OVER (PARTITION BY k, g ORDER BY p_name) AS n FROM h) SELECT count(*)::BIGINT AS raw, count(*) FILTER (g)::BIGINT AS generic, count(*) FILTER (NOT g AND n > 1)::BIGINT AS duplicates, count(*) FILTER (NOT g AND n = 1)::BIGINT AS kept FROM f")
def heading_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How many headings are generic, duplicates, kept."""
    return P.heading_counters(_part(spark, sf_dir), "p_name", F.col("p_size") < 5)


@register("topic_routes", "WITH n AS (SELECT c_custkey, count(o_orderkey) AS n FROM customer LEFT JOIN orders ON o_custkey = c_custkey AND o_totalprice > 300000 GROUP BY 1) SELECT CASE WHEN n >= 3 THEN 'high' WHEN n >= 1 THEN 'medium' ELSE 'low' END AS route, count(*)::BIGINT AS n FROM n GROUP BY 1")
def topic_routes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How surely things are known, by number of surveys."""
    n = table(spark, sf_dir, "orders").where("o_totalprice > 300000").groupBy(F.col("o_custkey").alias("c_custkey")).agg(F.count("*").alias("n"))
    rows = table(spark, sf_dir, "customer").select("c_custkey").join(n, "c_custkey", "left")
    return rows.groupBy(P.topic_route(F.coalesce("n", F.lit(0))).alias("route")).agg(F.count("*").alias("n"))


@register("paper_ages", "SELECT o_orderkey, greatest(1, 1997 - year(o_orderdate) + 1)::INT AS age, year(o_orderdate)::INT AS year, NULL::INT AS no_year FROM orders")
def paper_ages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Years since publication, one at least, and years in dates that are texts."""
    text = F.date_format("o_orderdate", "yyyy-MM-dd")
    return table(spark, sf_dir, "orders").select("o_orderkey", M.paper_age(F.lit(1997), F.col("o_orderdate")).alias("age"), M.year_of(text).alias("year"), M.year_of(F.col("o_orderpriority").substr(3, 9)).alias("no_year"))


@register(
    "candidate_urls",
    f"""WITH u AS (SELECT page_id, CASE page_id % 4 WHEN 0 THEN replace(url, 'example.com', 'arxiv.org') WHEN 1 THEN url || '.pdf' WHEN 2 THEN '/pdf?id=' || page_id ELSE url END AS u FROM pages),
    s AS (SELECT page_id, CASE WHEN u LIKE 'http%' THEN u ELSE 'https://forum.example.org' || u END AS u FROM u), h AS (SELECT *, lower(regexp_extract(u, '^[A-Za-z][A-Za-z0-9+.-]*://([^/?#]*)', 1)) AS host FROM s)
    SELECT page_id, u AS url, ({' OR '.join(f"ends_with(host, '{h}')" for h in X.ACADEMIC_HOSTS)})::INT AS academic, ends_with(lower(u), '.pdf')::INT AS pdf FROM h""",
)
def candidate_urls(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Urls made whole, with the marks by which candidates are ranked."""
    i, u = F.col("page_id"), F.col("url")
    raw = F.when(i % 4 == 0, F.replace(u, F.lit("example.com"), F.lit("arxiv.org"))).when(i % 4 == 1, F.concat(u, F.lit(".pdf"))).when(i % 4 == 2, F.concat(F.lit("/pdf?id="), i.cast("string"))).otherwise(u)
    rows = table(spark, sf_dir, "pages").select("page_id", forums.pdf_url(raw, "https://forum.example.org").alias("url"))
    academic, pdf = X.academic_score(F.col("url"))
    return rows.select("page_id", "url", academic.alias("academic"), pdf.alias("pdf"))


# ---------------------------------------------------------------- predicates


@register(
    "complete_records",
    """WITH r AS (SELECT l_partkey AS k, count(*) FILTER (l_discount > 0.05) AS refs, count(*) FILTER (l_tax > 0.05) AS rel FROM lineitem GROUP BY 1)
    SELECT p_partkey, trim(p_name) <> '' AND coalesce(refs, 0) > 0 AND coalesce(rel, 0) > 0 AND p_size % 4 <> 0 AND p_size % 3 = 0 AS complete, CASE WHEN coalesce(refs, 0) > 0 THEN CASE WHEN p_size % 2 = 0 THEN p_brand ELSE p_type END END AS venue FROM part LEFT JOIN r ON k = p_partkey""",
)
def complete_records(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Records with all that negative mining needs; venues of records with subjects."""
    name = F.col("l_suppkey").cast("string")
    r = table(spark, sf_dir, "lineitem").groupBy(F.col("l_partkey").alias("p_partkey")).agg(F.collect_set(F.when(F.col("l_discount") > 0.05, name)).alias("refs"), F.collect_set(F.when(F.col("l_tax") > 0.05, name)).alias("rel"))
    rows = _part(spark, sf_dir).join(r, "p_partkey", "left")
    size = F.col("p_size")
    done = P.is_complete(F.col("p_name"), F.col("refs"), F.col("rel"), F.when(size % 4 != 0, "10.1/x"), F.lit("k"), F.when(size % 3 == 0, "en"))
    return rows.select("p_partkey", done.alias("complete"), P.venue(F.when(size % 2 == 0, F.col("p_brand")), F.col("p_type"), F.col("refs")).alias("venue"))


@register(
    "claims_contained",
    "WITH t AS (SELECT p_partkey, string_split(lower(p_name), ' ') AS c, string_split(lower(p_name || ' ' || p_type), ' ') AS p, string_split(lower(CASE WHEN p_size % 2 = 0 THEN p_name ELSE p_brand END), ' ') AS a FROM part) SELECT p_partkey, len([x FOR x IN c IF NOT list_contains(p, x)]) = 0 AND len([x FOR x IN c IF list_contains(a, x)]) >= 0.9::DOUBLE * len(c) AS contained FROM t",
)
def claims_contained(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Whether claims stand in a paragraph, near their anchor."""
    cut = lambda c: F.split(F.lower(c), " ")
    near = F.when(F.col("p_size") % 2 == 0, F.col("p_name")).otherwise(F.col("p_brand"))
    return _part(spark, sf_dir).select("p_partkey", P.contained(cut("p_name"), cut(F.concat_ws(" ", "p_name", "p_type")), cut(near)).alias("contained"))


_K = "regexp_replace(lower({}), '[^0-9a-z]', '', 'g')"
_N = "trim(regexp_replace(lower({}), '[^a-z0-9]+', ' ', 'g'))"


@register(
    "fuzzy_titles",
    f"""WITH t AS (SELECT p_partkey, p_name AS q, CASE p_size % 4 WHEN 0 THEN 'On ' || p_name WHEN 1 THEN replace(p_name, 'a', 'o') WHEN 2 THEN p_type ELSE upper(p_name) || '!' END AS t FROM part),
    k AS (SELECT *, {_K.format('q')} AS a, {_K.format('t')} AS b FROM t)
    SELECT p_partkey, contains(a, b) OR contains(b, a) OR levenshtein(a, b) <= greatest(1, floor(length(a) * 0.1::DOUBLE)) AS near, levenshtein({_N.format('q')}, {_N.format('t')}) <= 0.1::DOUBLE * length(q) AS strictly FROM k""",
)
def fuzzy_titles(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Both fuzzy title tests."""
    q, n = F.col("p_name"), F.col("p_size") % 4
    t = F.when(n == 0, F.concat(F.lit("On "), q)).when(n == 1, F.replace(q, F.lit("a"), F.lit("o"))).when(n == 2, F.col("p_type")).otherwise(F.concat(F.upper(q), F.lit("!")))
    return _part(spark, sf_dir).select("p_partkey", X.fuzzy_title(q, t).alias("near"), X.strict_fuzzy_title(q, t).alias("strictly"))


_STRUCT = ("introduction", "conclusion", "background", "related work", "method", "experiment", "result", "discussion")


def _without(c: str) -> str:
    for w in _STRUCT:
        c = f"replace({c}, '{w}', '')"
    return c


@register("structural_titles", f"SELECT p_partkey, length(trim({_without(chr(39) + 'introduction ' + chr(39) + ' || lower(p_name)')})) >= 10 AS kept FROM part")
def structural_titles(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Headings of which enough is left without structural words."""
    return _part(spark, sf_dir).select("p_partkey", X.keeps_structure(F.concat(F.lit("Introduction "), "p_name")).alias("kept"))


@register(
    "trimmed_words",
    r"""WITH w AS (SELECT doc_id, [x FOR x IN [regexp_replace(t, '^[^\p{L}\p{N}_]+|[^\p{L}\p{N}_]+$', '', 'g') FOR t IN regexp_split_to_array(lower(coalesce(text, '')), '[\x09-\x0D ]+')] IF x <> ''] AS w FROM documents)
    SELECT doc_id, len(w)::BIGINT AS n, md5(array_to_string(w, ' ')) AS words FROM w""",
)
def trimmed_words(spark: SparkSession, sf_dir: str) -> DataFrame:
    """White-space tokens without marks at their ends."""
    w = X.edge_trimmed_words(F.coalesce("text", F.lit("")))
    return table(spark, sf_dir, "documents").select("doc_id", w.alias("w")).select("doc_id", F.size("w").cast("long").alias("n"), F.md5(F.array_join("w", " ")).alias("words"))


_NOTE = "CASE WHEN role = 'user' THEN 'venue/-/Official_Review' WHEN turn % 4 = 1 THEN 'venue/-/Meta_Review_Comment' ELSE 'venue/-/Comment' END"


@register(
    "review_notes",
    f"""WITH n AS (SELECT conv_id, turn, role, {_NOTE} AS inv, 'summary: ' || trim(text) || CASE WHEN turn % 2 = 0 THEN chr(10) || chr(10) || 'questions: ' || role ELSE '' END AS body FROM conversations WHERE trim(text) <> '')
    SELECT conv_id, turn, role, md5(body) AS text, regexp_matches(inv, '{X.REVIEW_INVITATION}') AND NOT (regexp_matches(inv, '{X.REPLY_INVITATION}') AND NOT contains(inv, 'Official_Review')) AND length(trim(body)) >= 250 AS review FROM n""",
)
def review_notes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Review texts from note fields, and which notes are reviews."""
    q = F.col("turn") % 2 == 0
    fields = F.map_from_arrays(F.array(F.lit("rating"), F.lit("questions"), F.lit("summary")), F.array(F.lit("5"), F.when(q, F.col("role")).otherwise(" "), F.col("text")))
    inv = F.when(F.col("role") == "user", "venue/-/Official_Review").when(F.col("turn") % 4 == 1, "venue/-/Meta_Review_Comment").otherwise("venue/-/Comment")
    body = forums.review_text(fields)
    rows = _talks(spark, sf_dir).where("trim(text) <> ''").select("conv_id", "turn", "role", body.alias("body"), F.array(inv).alias("inv"))
    return rows.select("conv_id", "turn", "role", F.md5("body").alias("text"), forums.is_review(F.col("inv"), F.col("body")).alias("review"))


_LITERATURE = rf"CASE WHEN regexp_matches(title, '{_p(X.NOT_A_SURVEY)}') OR (regexp_matches(title, '(?i)\btutorial\b') AND NOT regexp_matches(title, '(?i)\bsurvey\b')) THEN false WHEN regexp_matches(title, '{_p(X.STRONG_SURVEY)}') THEN true ELSE contains(lower(title), 'taxonomy') AND regexp_matches('a systematic ' || p_type, '(?i)\b(survey|review|literature|systematic|comprehensive)\b') END"


@register(
    "record_scores",
    f"WITH {_T}, s AS (SELECT p_partkey, ({_LITERATURE})::INT AS lit, regexp_matches(title, '{_p(X.STRONG_SURVEY)}') AS strong, contains(lower(title), 'taxonomy') AS tax, length(title) AS chars FROM t) SELECT p_partkey FROM s ORDER BY lit DESC, strong DESC, -((tax AND NOT strong)::INT) DESC, least(p_partkey % 9, 6) DESC, chars DESC, p_partkey LIMIT 100",
)
def record_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The hundred best records by the tuple of marks that sorts them."""
    rows = _titles(spark, sf_dir)
    score = forums.record_score(F.col("title"), F.concat(F.lit("a systematic "), "p_type"), F.col("p_partkey") % 9, F.length("title"))
    return rows.orderBy(score.desc(), "p_partkey").limit(100).select("p_partkey")


@register(
    "forum_submissions",
    """WITH n AS (SELECT conv_id, turn, role, text, CASE WHEN role = 'assistant' AND turn % 2 = 1 THEN 0 WHEN turn = 0 AND coalesce(text, '') <> '' THEN 1 END AS k, 100 - turn AS cdate FROM conversations)
    SELECT conv_id AS forum, (array_agg(turn ORDER BY k, cdate, turn, text))[1] AS id, md5((array_agg(text ORDER BY k, cdate, turn, text))[1]) AS title FROM n WHERE k IS NOT NULL GROUP BY conv_id""",
)
def forum_submissions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One note of each forum: the earliest submission, else the root."""
    inv = F.when((F.col("role") == "assistant") & (F.col("turn") % 2 == 1), F.array(F.lit("v/-/Submission"))).otherwise(F.array(F.lit("v/-/Comment")))
    forum = F.when(F.col("turn") == 0, F.col("turn")).otherwise(F.lit(-1).cast("long"))
    notes = _talks(spark, sf_dir).select("conv_id", forum.alias("root"), F.col("turn").alias("id"), inv.alias("invitations"), (100 - F.col("turn")).alias("cdate"), F.col("text").alias("title"))
    return forums.submission(notes, forum="conv_id", root="root").select(F.col("conv_id").alias("forum"), "id", F.md5("title").alias("title"))


_MARKED = " OR ".join(f"contains(lower(title), '{w}')" for w in ("survey", "review", "overview", "taxonomy", "summary", "synthesis"))
_INTRO = " OR ".join(f"contains(lower(p_type), '{w}')" for w in ("intro", "background", "overview"))


@register("minimum_checks", f"WITH {_T}, s AS (SELECT *, p_partkey % 5 AS d FROM t) SELECT p_partkey, CASE WHEN NOT (({_MARKED}) OR ({_INTRO})) THEN 'title_structure' WHEN d = 0 THEN 'discussion_candidates' ELSE 'pass' END AS stage FROM s")
def minimum_checks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Which papers have the least that a survey needs."""
    rows = _titles(spark, sf_dir).select("p_partkey", "title", F.array("p_type").alias("top_titles"), (F.col("p_partkey") % 5).alias("discussions"))
    return rows.select("p_partkey", evidence.minimum_check(rows).alias("stage"))


@register(
    "json_answers",
    "SELECT event_id, CASE WHEN event_id % 5 <> 4 THEN regexp_extract(props, '\"k\": *([0-9]+)', 1)::BIGINT END AS k, event_id % 5 <> 4 AS valid FROM events",
)
def json_answers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """JSON found in answers of several shapes, and whether it has what the schema requires."""
    i, p = F.col("event_id") % 5, F.col("props")
    answer = F.when(i == 0, p).when(i == 1, F.concat(F.lit("Sure:\n```json\n"), p, F.lit("\n```\nDone."))).when(i == 2, F.concat(F.lit("It is "), p, F.lit(" as asked")))
    answer = answer.when(i == 3, F.concat(F.lit("so "), F.replace(p, F.lit("}"), F.lit(",}")), F.lit(" ok"))).otherwise(F.replace(p, F.lit("k"), F.lit("other")))
    rows = table(spark, sf_dir, "events").select("event_id", P.valid_answer(M.json_text(answer), "k long", ("k",)).alias("a"))
    return rows.select("event_id", F.col("a.k").alias("k"), F.col("a").isNotNull().alias("valid"))


@register("concept_surveys", "SELECT p_partkey, CASE WHEN p_size % 4 = 0 THEN p_size / 50.0::DOUBLE > 0.3 WHEN p_size % 4 = 1 THEN p_size / 100.0::DOUBLE > 0.3 ELSE false END AS survey FROM part")
def concept_surveys(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Surveys by the first concept named a review."""
    n, size = F.col("p_size") % 4, F.col("p_size")
    first = F.struct(F.when(n == 0, "Systematic Review").otherwise(F.col("p_type")).alias("name"), (size / 50.0).alias("score"))
    second = F.struct(F.when(n <= 1, "review").otherwise(F.col("p_brand")).alias("name"), (size / 100.0).alias("score"))
    return _part(spark, sf_dir).select("p_partkey", P.is_review_concept(F.array(first, second)).alias("survey"))


# ---------------------------------------------------------------- joins


_CLUSTERS = "a AS (SELECT n_regionkey AS canonical, n_nationkey AS pos, unnest([n_nationkey, n_nationkey + 1]) AS alias FROM nation), k AS (SELECT alias, (array_agg(canonical ORDER BY pos, canonical))[1] AS canonical FROM a GROUP BY alias)"


@register("canonical_references", f"WITH {_CLUSTERS} SELECT DISTINCT x.canonical AS src, y.canonical AS dst FROM customer JOIN k x ON x.alias = c_nationkey JOIN k y ON y.alias = c_custkey % 40 WHERE x.canonical <> y.canonical")
def canonical_references(spark: SparkSession, sf_dir: str) -> DataFrame:
    """References between clusters; an alias belongs to its first cluster."""
    n = table(spark, sf_dir, "nation")
    clusters = n.select(F.col("n_regionkey").alias("canonical"), F.col("n_nationkey").alias("pos"), F.array(F.col("n_nationkey"), F.col("n_nationkey") + 1).alias("aliases"))
    refs = table(spark, sf_dir, "customer").select(F.col("c_nationkey").alias("src"), (F.col("c_custkey") % 40).cast("int").alias("dst"))
    return C.resolved_references(refs, clusters)


@register("claim_citations", f"WITH k AS (SELECT {_N.format('p_name')} AS t, min(p_partkey) AS id FROM part GROUP BY 1) SELECT l_orderkey, l_linenumber, l_suppkey, id AS citation FROM lineitem JOIN part ON p_partkey = l_partkey JOIN k ON t = {_N.format('p_name')} WHERE l_quantity > 48")
def claim_citations(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Citations of claims translated from titles to ids."""
    part = _part(spark, sf_dir).select("p_partkey", X.normalized_title(F.col("p_name")).alias("t"))
    ids = part.groupBy("t").agg(F.min("p_partkey").alias("citation"))
    claims = table(spark, sf_dir, "lineitem").where("l_quantity > 48").select("l_orderkey", "l_linenumber", "l_suppkey", F.col("l_partkey").alias("p_partkey")).join(part, "p_partkey")
    return claims.join(ids, "t").select("l_orderkey", "l_linenumber", "l_suppkey", "citation")


@register("scores_back", "SELECT conv_id, string_agg((length(text) % 7)::VARCHAR, '|' ORDER BY turn, text) AS scores, count(*)::BIGINT AS n FROM conversations WHERE text IS NOT NULL GROUP BY conv_id")
def scores_back(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Flat predictions, keyed by group and place, back in their groups: the keys stay columns, so nothing is re-joined."""
    flat = _talks(spark, sf_dir).where("text IS NOT NULL").select("conv_id", "turn", "text", (F.length("text") % 7).cast("string").alias("score"))
    back = flat.groupBy("conv_id").agg(F.sort_array(F.collect_list(F.struct("turn", "text", "score"))).alias("s"), F.count("*").alias("n"))
    return back.select("conv_id", F.array_join(F.transform("s", lambda x: x["score"]), "|").alias("scores"), "n")


@register("query_results", "SELECT q.item_id AS query, d.doc_id FROM benchmark q JOIN documents d ON d.doc_id % 40 = q.item_id WHERE q.item_id % 3 <> 0")
def query_results(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Results with their query, groups that failed left out: the query travels with its results, nothing is zipped by place."""
    groups = table(spark, sf_dir, "documents").groupBy((F.col("doc_id") % 40).alias("query")).agg(F.collect_list("doc_id").alias("found"))
    groups = groups.withColumn("found", F.when(F.col("query") % 3 != 0, F.col("found")))
    queries = table(spark, sf_dir, "benchmark").select(F.col("item_id").alias("query"))
    return queries.join(groups, "query").select("query", F.explode("found").alias("doc_id"))


@register("section_lookup", "WITH s AS (SELECT conv_id, turn, text, role FROM conversations WHERE role = 'assistant') SELECT conv_id, min(turn) AS turn, (array_agg(md5(text) ORDER BY turn, text))[1] AS section FROM s GROUP BY conv_id")
def section_lookup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The first section, in document order, with the wanted id; ids are compared as texts."""
    flat = _talks(spark, sf_dir).select("conv_id", F.col("role").alias("section_id"), "turn", "text")
    wanted = _talks(spark, sf_dir).select("conv_id", F.lit("assistant").alias("section_id")).distinct()
    hit = flat.join(wanted, ["conv_id", "section_id"]).groupBy("conv_id").agg(F.min(F.struct("turn", "text")).alias("m"))
    return hit.select("conv_id", F.col("m.turn").alias("turn"), F.md5("m.text").alias("section"))


@register(
    "reference_metrics",
    "WITH c AS (SELECT l_partkey AS k, count(*) FILTER (l_shipdate <= TIMESTAMP '1997-12-31') AS n FROM lineitem GROUP BY 1) SELECT l_orderkey, l_linenumber, l_suppkey, greatest(1, 1997 - year(l_shipdate) + 1)::INT AS age, coalesce(n, 0)::BIGINT AS citations, round(p_retailprice / 10000, 6) AS similarity FROM lineitem JOIN part ON p_partkey = l_partkey LEFT JOIN c ON k = l_partkey WHERE l_quantity > 48",
)
def reference_metrics(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Gold references with metadata, age, similarity and citations as of a date."""
    lines = table(spark, sf_dir, "lineitem")
    n = lines.groupBy(F.col("l_partkey").alias("p_partkey")).agg(F.count_if(F.col("l_shipdate") <= F.lit("1997-12-31").cast("timestamp")).alias("citations"))
    rows = lines.where("l_quantity > 48").withColumnRenamed("l_partkey", "p_partkey").join(_part(spark, sf_dir), "p_partkey").join(n, "p_partkey", "left")
    return rows.select("l_orderkey", "l_linenumber", "l_suppkey", M.paper_age(F.lit(1997), F.col("l_shipdate")).alias("age"), F.coalesce("citations", F.lit(0)).alias("citations"), F.round(F.col("p_retailprice") / 10000, 6).alias("similarity"))


@register("survey_sections", "WITH s AS (SELECT c_custkey FROM customer ORDER BY c_acctbal DESC, c_custkey LIMIT 5) SELECT c_custkey, count(*)::BIGINT AS sections FROM s JOIN orders ON o_custkey = c_custkey WHERE o_orderstatus = 'F' GROUP BY 1")
def survey_sections(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Of the first five selected surveys those with sections."""
    first = table(spark, sf_dir, "customer").orderBy(F.col("c_acctbal").desc(), "c_custkey").limit(5).select("c_custkey")
    sections = table(spark, sf_dir, "orders").where("o_orderstatus = 'F'").select(F.col("o_custkey").alias("c_custkey"))
    return sections.join(F.broadcast(first), "c_custkey").groupBy("c_custkey").agg(F.count("*").alias("sections"))


@register(
    "text_windows",
    """WITH s AS (SELECT conv_id, turn, text, row_number() OVER w AS k, count(*) OVER (PARTITION BY conv_id) AS n, turn % 3 = 1 AS d FROM conversations WHERE text IS NOT NULL WINDOW w AS (PARTITION BY conv_id ORDER BY turn, text))
    SELECT conv_id, md5('abstract ' || conv_id || chr(10) || string_agg(text, chr(10) ORDER BY turn, text) FILTER (k = 1)) AS intro, md5('abstract ' || conv_id || chr(10) || string_agg(text, chr(10) ORDER BY turn, text) FILTER (k = 1 OR k = n OR d)) AS gap FROM s GROUP BY conv_id""",
)
def text_windows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Abstract and first section; and with discussions and the last section."""
    part = F.struct("turn", "text", F.col("turn").alias("id"), (F.col("turn") % 3 == 1).alias("discussion"))
    rows = _talks(spark, sf_dir).where("text IS NOT NULL").groupBy("conv_id").agg(F.sort_array(F.collect_list(part)).alias("s"))
    abstract = F.concat(F.lit("abstract "), F.col("conv_id").cast("string"))
    return rows.select("conv_id", F.md5(P.text_window(abstract, F.col("s"), False)).alias("intro"), F.md5(P.text_window(abstract, F.col("s"), True)).alias("gap"))


@register(
    "grown_pool",
    """WITH RECURSIVE n AS (SELECT count(*) AS n FROM part), g(node, round) AS (SELECT p_partkey, 0 FROM part WHERE p_partkey < 3 UNION SELECT (node * 3 + i) % (SELECT n FROM n), round + 1 FROM g, (VALUES (1), (2)) v(i) WHERE round < 8),
    f AS (SELECT node, min(round) AS round FROM g GROUP BY node), c AS (SELECT round, sum(count(*)) OVER (ORDER BY round) AS have FROM f GROUP BY round)
    SELECT node, round::INT AS round FROM f WHERE round <= (SELECT min(round) FROM c WHERE have >= 60)""",
)
def grown_pool(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A pool grown by its neighbours, hop by hop, until it is large enough."""
    part = _part(spark, sf_dir).select(F.col("p_partkey").alias("src"))
    n = part.count()
    edges = part.select("src", F.explode(F.array(*[F.pmod(F.col("src") * 3 + i, F.lit(n)) for i in (1, 2)])).alias("dst"))
    return C.grown(edges, part.where("src < 3").select(F.col("src").alias("node")), 60)


@register("sorted_topics", "SELECT p_brand AS name, count(*)::BIGINT AS evidence, count(DISTINCT p_type)::BIGINT AS works FROM part GROUP BY 1 ORDER BY evidence DESC, works DESC, name DESC LIMIT 5")
def sorted_topics(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The five topics with the most evidence, then works, then the last name."""
    topics = _part(spark, sf_dir).groupBy(F.col("p_brand").alias("name")).agg(F.count("*").alias("evidence"), F.countDistinct("p_type").alias("works"))
    return topics.orderBy(F.struct("evidence", "works", "name").desc()).limit(5)


@register(
    "cited_synthesis",
    rf"""WITH s AS (SELECT conv_id, turn, lower(text) || CASE turn % 3 WHEN 0 THEN ' overall [1] and [22]' WHEN 1 THEN ' in summary [3]' ELSE ' taken together' END AS x FROM conversations WHERE text IS NOT NULL)
    SELECT conv_id, count(*) FILTER (({' OR '.join(f"contains(x, '{w}')" for w in X.SYNTHESIS_PHRASES)}) AND len(regexp_extract_all(x, '\[[0-9]+\]')) >= 2)::BIGINT AS synthesis, count(*) FILTER (len(regexp_extract_all(x, '\[[0-9]+\]')) = 1)::BIGINT AS cited_once FROM s GROUP BY conv_id""",
)
def cited_synthesis(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Sentences that sum up two works or more, and those that cite one alone."""
    n = F.col("turn") % 3
    x = F.concat(F.lower("text"), F.when(n == 0, " overall [1] and [22]").when(n == 1, " in summary [3]").otherwise(" taken together"))
    rows = _talks(spark, sf_dir).where("text IS NOT NULL").select("conv_id", x.alias("x"))
    return rows.groupBy("conv_id").agg(F.count_if(X.sums_up(F.col("x"))).alias("synthesis"), F.count_if(X.citation_marks(F.col("x")) == 1).alias("cited_once"))


# ---------------------------------------------------------------- scans and sinks


@register("autocomplete", "SELECT p_partkey, p_name FROM part WHERE starts_with(lower(p_name), 'sma') ORDER BY p_retailprice DESC, p_partkey LIMIT 10")
def autocomplete(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The ten best titles with a prefix."""
    return works.autocomplete(_part(spark, sf_dir), "p_name", "sma", "p_retailprice", "p_partkey", 10).select("p_partkey", "p_name")


@register("search_scan", "SELECT p_partkey, p_name FROM part WHERE contains(lower(p_name || ' ' || p_type), 'ring') AND contains(lower(p_name || ' ' || p_type), 'small') AND p_retailprice > 950")
def search_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Records that hold all search terms in title or abstract, with a filter that reaches the scan."""
    return works.searched(_part(spark, sf_dir), ("p_name", "p_type"), "ring small").where("p_retailprice > 950").select("p_partkey", "p_name")


def _own_folder(spark: SparkSession) -> str:
    return f"{checkpoint_folder(spark)}/lectern-{uuid.uuid4().hex}"


@register("json_lines_roundtrip", "SELECT n_nationkey::BIGINT AS n_nationkey, n_name, CASE WHEN n_nationkey % 2 = 0 THEN n_regionkey::BIGINT END AS n_regionkey FROM nation UNION ALL SELECT 100, 'appended', NULL")
def json_lines_roundtrip(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rows written as JSON lines, one appended, read strictly."""
    at = _own_folder(spark)
    n = table(spark, sf_dir, "nation").select(F.col("n_nationkey").cast("long").alias("n_nationkey"), "n_name", F.when(F.col("n_nationkey") % 2 == 0, F.col("n_regionkey").cast("long")).alias("n_regionkey"))
    files.write_lines(n, at)
    files.write_lines(n.limit(1).select(F.lit(100).cast("long").alias("n_nationkey"), F.lit("appended").alias("n_name"), F.lit(None).cast("long").alias("n_regionkey")), at, append=True)
    return files.json_lines(spark, at, n.schema)


@register("numbered_lines", "SELECT n_nationkey::BIGINT AS index, n_name FROM nation WHERE n_nationkey >= 3 AND n_nationkey % 4 <> 0")
def numbered_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Lines with their place in the file, blank ones counted, from the fourth on."""
    at = _own_folder(spark)
    line = F.when(F.col("n_nationkey") % 4 == 0, "").otherwise(F.to_json(F.struct("n_name")))
    rows = table(spark, sf_dir, "nation").coalesce(1).sortWithinPartitions("n_nationkey")
    rows.select(line.alias("value")).write.text(at)
    return files.numbered_lines(spark, at, "n_name string", 3).select("index", "n_name")


@register("point_lookup", "SELECT p_partkey, p_name FROM part WHERE p_partkey = 17")
def point_lookup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return files.at_index(_part(spark, sf_dir), "p_partkey", 17).select("p_partkey", "p_name")


@register("keyed_folders", "SELECT n_regionkey::BIGINT AS n_regionkey, count(*)::BIGINT AS count, string_agg(n_name, '|' ORDER BY n_name) AS names FROM nation GROUP BY 1")
def keyed_folders(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A folder for each key and an index of counts, read back."""
    at, index = _own_folder(spark), _own_folder(spark)
    files.write_by_key(table(spark, sf_dir, "nation"), at, "n_regionkey", index)
    counts = spark.read.schema("n_regionkey long, count long").json(index)
    back = spark.read.schema("n_name string, n_regionkey long").json(at).groupBy("n_regionkey").agg(F.array_join(F.sort_array(F.collect_list("n_name")), "|").alias("names"))
    return counts.join(back, "n_regionkey")


@register("document_scan", "SELECT r_regionkey::BIGINT AS r_regionkey, r_name FROM region")
def document_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One JSON document over several lines, landed as a file, read as rows."""
    at = _own_folder(spark)
    rows = table(spark, sf_dir, "region").select(F.to_json(F.struct(F.col("r_regionkey").cast("long").alias("r_regionkey"), "r_name")).alias("j"))
    rows.coalesce(1).agg(F.concat(F.lit("["), F.array_join(F.collect_list("j"), ",\n"), F.lit("]")).alias("value")).write.text(at)
    read = files.json_document(spark, at, "r_regionkey long, r_name string")
    landed = files.whole_files(spark, f"{at}/part-*").select(F.count("*").alias("n"))
    return read.join(F.broadcast(landed)).where("n > 0").select("r_regionkey", "r_name")


@register(
    "merged_states",
    "SELECT n_nationkey, CASE WHEN n_nationkey % 2 = 0 THEN 'b' ELSE 'a' END AS stage, n_name || CASE WHEN n_nationkey % 2 = 0 THEN '|x|y' ELSE '' END AS notes FROM nation",
)
def merged_states(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Outputs of two critics as one row for each key."""
    n = table(spark, sf_dir, "nation")
    first = n.select("n_nationkey", F.lit("a").alias("stage"), F.array("n_name").alias("notes"))
    second = n.where("n_nationkey % 2 = 0").select("n_nationkey", F.lit("b").alias("stage"), F.array(F.lit("x"), F.lit("y")).alias("notes"))
    return files.merged_state([first, second], "n_nationkey", ["notes"]).select("n_nationkey", "stage", F.array_join("notes", "|").alias("notes"))


# ---------------------------------------------------------------- bundles


_REDUNDANT = rf"t5 AS (SELECT doc_id, {_TOK} AS w FROM documents), g5 AS (SELECT doc_id, [array_to_string(w[i:i + 4], ' ') FOR i IN range(1, len(w)::BIGINT - 3)] AS g FROM t5), red AS (SELECT doc_id, CASE WHEN len(g) = 0 THEN 0.0 ELSE round(1 - len(list_distinct(g))::DOUBLE / len(g), 6) END AS redundancy FROM g5)"
_READING = _READ.replace("206.835 -", "206.835::DOUBLE -").replace("0.39 *", "0.39::DOUBLE *").replace("0.4 *", "0.4::DOUBLE *")


@register("quality_bundle", f"WITH readable AS ({_READING}), {_REDUNDANT} SELECT doc_id, reading_ease, grade, fog, redundancy FROM readable JOIN red USING (doc_id)")
def quality_bundle(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Readability and redundancy of the English texts side by side."""
    return readability(spark, sf_dir).join(ngram_redundancy(spark, sf_dir).select("doc_id", "redundancy"), "doc_id")

