"""Queries of record-level operators: projections, predicates, joins, aggregates and windows over the star schema."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from lectern.functions import scalars as M
from lectern.functions import text as X
from lectern.plans.catalog import register
from lectern.session import table
from lectern.sources import files, works

# Titles as a bibliography would have them, made from part names.
_TITLE_SQL = "CASE p_size % 5 WHEN 0 THEN 'A Survey on ' || p_name WHEN 1 THEN 'Taxonomy of ' || p_name WHEN 2 THEN 'Tutorial: ' || p_name || ' & more' WHEN 3 THEN 'Survey questionnaire, ' || p_name ELSE p_size || '. Methods for ' || p_name || '/' || p_type END"


def _titles(spark: SparkSession, sf_dir: str) -> DataFrame:
    n, kind = F.col("p_name"), F.col("p_size") % 5
    last = F.concat(F.col("p_size").cast("string"), F.lit(". Methods for "), n, F.lit("/"), "p_type")
    title = F.when(kind == 0, F.concat(F.lit("A Survey on "), n)).when(kind == 1, F.concat(F.lit("Taxonomy of "), n)).when(kind == 2, F.concat(F.lit("Tutorial: "), n, F.lit(" & more"))).when(kind == 3, F.concat(F.lit("Survey questionnaire, "), n)).otherwise(last)
    return table(spark, sf_dir, "part").select("p_partkey", "p_type", title.alias("title"))


def _p(pattern: str) -> str:
    return pattern.replace("'", "''")


_T = f"t AS (SELECT p_partkey, p_type, {_TITLE_SQL} AS title FROM part)"


@register(
    "survey_titles",
    rf"""WITH {_T} SELECT p_partkey, regexp_matches(lower(title), '(survey|summary) on|a (survey|summary)') AS listed,
    CASE WHEN regexp_matches(title, '{_p(X.NOT_A_SURVEY)}') OR (regexp_matches(title, '(?i)\btutorial\b') AND NOT regexp_matches(title, '(?i)\bsurvey\b')) THEN false WHEN regexp_matches(title, '{_p(X.STRONG_SURVEY)}') THEN true
      ELSE contains(lower(title), 'taxonomy') AND regexp_matches('a systematic ' || p_type, '(?i)\b(survey|review|literature|systematic|comprehensive)\b') END AS literature FROM t""",
)
def survey_titles(spark: SparkSession, sf_dir: str) -> DataFrame:
    t = F.col("title")
    return _titles(spark, sf_dir).select("p_partkey", X.is_listed_survey(t).alias("listed"), X.is_literature_survey(t, F.concat(F.lit("a systematic "), "p_type")).alias("literature"))


_HEADING = r"trim(regexp_replace(regexp_replace(replace(regexp_replace(lower(trim(title)), '^([0-9][0-9.]*|[ivx]+[.)-])\s*[.)-]?\s*', ''), '&', ' and '), '[/-]', ' ', 'g'), '\s+', ' ', 'g'))"


@register("heading_keys", rf"WITH {_T}, k AS (SELECT p_partkey, {_HEADING} AS heading FROM t) SELECT p_partkey, heading, heading = '' OR {' OR '.join(f'contains(heading, {chr(39)}{w}{chr(39)})' for w in X.GENERIC_HEADINGS)} AS generic FROM k")
def heading_keys(spark: SparkSession, sf_dir: str) -> DataFrame:
    t = F.col("title")
    return _titles(spark, sf_dir).select("p_partkey", X.heading_key(t).alias("heading"), X.is_generic_heading(t).alias("generic"))


def _stop_sql(c: str) -> str:
    out = rf"regexp_replace({c}, '[\-_:,.;!?(){{}}\[\]/\\]+', ' ', 'g')"
    for pattern in X.QUERY_STOP:
        out = f"regexp_replace({out}, '{pattern}', ' ', 'g')"
    return rf"trim(regexp_replace({out}, '\s+', ' ', 'g'))"


@register(
    "title_keys",
    rf"""WITH {_T} SELECT p_partkey, trim(regexp_replace(lower(title), '[^a-z0-9]+', ' ', 'g')) AS plain, trim(regexp_replace(regexp_replace(title, '[:,.!?&]', ' ', 'g'), '\s+', ' ', 'g')) AS unpunctuated,
    trim(regexp_extract(title, '^[0-9A-Za-z_\s\-/+&]*', 0)) AS truncated, CASE WHEN {_stop_sql('title')} <> '' THEN {_stop_sql('title')} ELSE trim(title) END AS keywords,
    regexp_replace(regexp_replace(lower(title), '[^0-9a-z_]+', '_', 'g'), '^_+|_+$', '', 'g')[1:100] AS slug FROM t""",
)
def title_keys(spark: SparkSession, sf_dir: str) -> DataFrame:
    t = F.col("title")
    made = {"plain": X.normalized_title(t), "unpunctuated": X.punctuation_free(t), "truncated": X.truncated_title(t), "keywords": X.keyword_query(t), "slug": X.slug(t)}
    return _titles(spark, sf_dir).select("p_partkey", *[c.alias(k) for k, c in made.items()])


_REF_SQL = "CASE o_orderkey % 4 WHEN 0 THEN 'https://arxiv.org/abs/' || lpad((o_orderkey % 10000)::VARCHAR, 4, '0') || '.' || lpad((o_custkey % 100000)::VARCHAR, 5, '0') || 'v2' WHEN 1 THEN 'http://www.arxiv.org/pdf/hep-th/' || lpad((o_custkey % 10000000)::VARCHAR, 7, '0') || '.pdf' WHEN 2 THEN 'https://doi.org/10.1/' || o_orderstatus || o_custkey ELSE 'doi: 10.2/' || o_orderpriority END"


@register(
    "reference_ids",
    rf"""WITH r AS (SELECT o_orderkey, {_REF_SQL} AS ref FROM orders),
    m AS (SELECT *, regexp_extract(ref, '(?:^|[^0-9.])([0-9]{{4}}\.[0-9]{{4,5}})(?:v[0-9]+)?(?:[^0-9]|$)', 1) AS modern, regexp_extract(ref, '(?:^|[^0-9a-z])([a-z-]+(?:\.[A-Z]{{2}})?/[0-9]{{7}})(?:[^0-9]|$)', 1) AS legacy,
      regexp_replace(regexp_extract(ref, '^https?://(?:www\.)?arxiv\.org/(?:abs|html|pdf)/([^?#]+?)/?(?:[?#].*)?$', 1), '\.pdf$', '') AS inner_id FROM r)
    SELECT o_orderkey, CASE WHEN modern <> '' THEN modern ELSE legacy END AS arxiv_id, CASE WHEN inner_id <> '' THEN 'https://arxiv.org/pdf/' || inner_id || '.pdf' ELSE ref END AS pdf, trim(regexp_replace(lower(trim(ref)), '^(https?://(dx\.)?doi\.org/|doi:\s*)', '')) AS doi FROM m""",
)
def reference_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Archive ids, PDF urls and DOIs in references made from order keys."""
    k, c = F.col("o_orderkey"), F.col("o_custkey")
    pad = lambda x, n: F.lpad((x % 10**n).cast("string"), n, "0")
    ref = F.when(k % 4 == 0, F.concat(F.lit("https://arxiv.org/abs/"), pad(k, 4), F.lit("."), pad(c, 5), F.lit("v2"))).when(k % 4 == 1, F.concat(F.lit("http://www.arxiv.org/pdf/hep-th/"), pad(c, 7), F.lit(".pdf")))
    ref = ref.when(k % 4 == 2, F.concat(F.lit("https://doi.org/10.1/"), "o_orderstatus", c.cast("string"))).otherwise(F.concat(F.lit("doi: 10.2/"), "o_orderpriority"))
    r = F.col("ref")
    return table(spark, sf_dir, "orders").select("o_orderkey", ref.alias("ref")).select("o_orderkey", X.arxiv_id(r).alias("arxiv_id"), X.arxiv_pdf_url(r).alias("pdf"), X.doi(r).alias("doi"))


@register("date_window", "SELECT o_orderkey, date_diff('day', o_orderdate::DATE, DATE '1998-06-01')::INT AS age FROM orders WHERE o_orderdate::DATE BETWEEN DATE '1998-06-01' - 731 AND DATE '1998-06-01' - 90")
def date_window(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Orders 731 to 90 days before an evaluation date; the bounds reach the scan."""
    day, at = F.lit("1998-06-01").cast("date"), F.col("o_orderdate").cast("date")
    return table(spark, sf_dir, "orders").where(at.between(F.date_sub(day, 731), F.date_sub(day, 90))).select("o_orderkey", F.datediff(day, at).alias("age"))


@register("disjoint_negatives", "WITH seeds AS (SELECT list_distinct(array_agg(p_brand)) AS c FROM part WHERE p_size > 45 AND p_type = 'ECONOMY') SELECT p_partkey FROM part, seeds WHERE NOT list_has_any([p_brand, p_type], c)")
def disjoint_negatives(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Parts that share no concept with the seeds'."""
    part = table(spark, sf_dir, "part")
    seeds = part.where("p_size > 45 AND p_type = 'ECONOMY'").select(F.col("p_brand").alias("concept")).distinct()
    concepts = part.select("p_partkey", F.explode(F.array("p_brand", "p_type")).alias("concept"))
    hit = concepts.join(seeds, "concept", "left_semi").select("p_partkey").distinct()
    return part.select("p_partkey").join(hit, "p_partkey", "left_anti")


@register("json_payloads", "SELECT event_type, count(*)::BIGINT AS n, sum(regexp_extract(props, '\"k\": *([0-9]+)', 1)::BIGINT)::BIGINT AS total FROM events GROUP BY event_type")
def json_payloads(spark: SparkSession, sf_dir: str) -> DataFrame:
    parsed = F.from_json("props", "k long")
    return table(spark, sf_dir, "events").groupBy("event_type").agg(F.count("*").alias("n"), F.sum(parsed["k"]).alias("total"))


@register("resolved_bibliographies", "SELECT l_orderkey, count(*)::BIGINT AS entries FROM lineitem LEFT JOIN (SELECT * FROM part WHERE p_size <= 45) ON p_partkey = l_partkey GROUP BY l_orderkey HAVING count(*) = count(p_partkey)")
def resolved_bibliographies(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Orders all of whose lines resolve to a known part."""
    known = table(spark, sf_dir, "part").where("p_size <= 45").select(F.col("p_partkey").alias("l_partkey"), F.lit(1).alias("hit"))
    rows = table(spark, sf_dir, "lineitem").select("l_orderkey", "l_partkey").join(known, "l_partkey", "left")
    return rows.groupBy("l_orderkey").agg(F.count("*").alias("entries"), F.count("hit").alias("hits")).where("entries = hits").select("l_orderkey", "entries")


@register("known_counts", "WITH n AS (SELECT o_custkey, count(*)::BIGINT AS n FROM orders GROUP BY o_custkey) SELECT c_mktsegment, count(*)::BIGINT AS customers, count(*) FILTER (coalesce(n, -1) >= 0)::BIGINT AS known, sum(coalesce(n, -1))::BIGINT AS total FROM customer LEFT JOIN n ON o_custkey = c_custkey GROUP BY c_mktsegment")
def known_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Counts looked up, -1 where there is none, by segment."""
    n = table(spark, sf_dir, "orders").groupBy(F.col("o_custkey").alias("c_custkey")).agg(F.count("*").alias("n"))
    rows = table(spark, sf_dir, "customer").join(n, "c_custkey", "left").withColumn("n", F.coalesce("n", F.lit(-1)))
    return rows.groupBy("c_mktsegment").agg(F.count("*").alias("customers"), F.count_if(F.col("n") >= 0).alias("known"), F.sum("n").alias("total"))


@register("id_enrichment", "SELECT DISTINCT l_orderkey, o_custkey, c_name FROM lineitem JOIN orders ON o_orderkey = l_orderkey JOIN customer ON c_custkey = o_custkey WHERE l_shipdate >= TIMESTAMP '1998-01-01'")
def id_enrichment(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Ids with their metadata, each once; ids without drop out."""
    lines = table(spark, sf_dir, "lineitem").where("l_shipdate >= timestamp'1998-01-01'").select(F.col("l_orderkey").alias("o_orderkey")).distinct()
    orders = table(spark, sf_dir, "orders").select("o_orderkey", F.col("o_custkey").alias("c_custkey"))
    rows = lines.join(orders, "o_orderkey").join(table(spark, sf_dir, "customer").select("c_custkey", "c_name"), "c_custkey")
    return rows.select(F.col("o_orderkey").alias("l_orderkey"), F.col("c_custkey").alias("o_custkey"), "c_name")


@register("pending_work", "SELECT p_partkey FROM part WHERE p_partkey NOT IN (SELECT l_partkey FROM lineitem WHERE l_returnflag = 'R' AND l_quantity > 45)")
def pending_work(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What a finished output lacks."""
    done = table(spark, sf_dir, "lineitem").where("l_returnflag = 'R' AND l_quantity > 45").select(F.col("l_partkey").alias("p_partkey"))
    return files.pending(table(spark, sf_dir, "part").select("p_partkey"), done, ["p_partkey"])


@register("first_mentions", "WITH f AS (SELECT conv_id, role, min(turn) AS t FROM conversations GROUP BY conv_id, role) SELECT conv_id, string_agg(role, '|' ORDER BY t, role) AS roles FROM f GROUP BY conv_id")
def first_mentions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Distinct roles of each conversation in order of appearance."""
    turns = table(spark, sf_dir, "conversations").groupBy("conv_id").agg(F.sort_array(F.collect_list(F.struct("turn", "role"))).alias("t"))
    return turns.select("conv_id", F.array_join(F.array_distinct(F.transform("t", lambda x: x["role"])), "|").alias("roles"))


@register(
    "overlap_ratio",
    "WITH s AS (SELECT DISTINCT l_suppkey AS k, l_partkey AS p FROM lineitem), n AS (SELECT k, count(*) AS n FROM s GROUP BY k), pr AS (SELECT x.s_suppkey AS a, y.s_suppkey AS b FROM supplier x JOIN supplier y ON x.s_nationkey = y.s_nationkey AND x.s_suppkey < y.s_suppkey), i AS (SELECT a, b, count(*) AS shared FROM pr JOIN s u ON u.k = a JOIN s v ON v.k = b AND v.p = u.p GROUP BY a, b) SELECT a, b, round(shared::DOUBLE / least(p.n, q.n), 6) AS overlap FROM i JOIN n p ON p.k = a JOIN n q ON q.k = b",
)
def overlap_ratio(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Parts that suppliers of a nation share, as a share of the smaller one's."""
    sold = table(spark, sf_dir, "lineitem").select(F.col("l_suppkey").alias("k"), F.col("l_partkey").alias("p")).distinct()
    home = table(spark, sf_dir, "supplier").select(F.col("s_suppkey").alias("k"), "s_nationkey")
    sold = sold.join(home, "k")
    sizes = sold.groupBy("k").agg(F.count("*").alias("n"))
    left, right = sold.select(F.col("k").alias("a"), "p", "s_nationkey"), sold.select(F.col("k").alias("b"), "p", "s_nationkey")
    shared = left.join(right, ["p", "s_nationkey"]).where("a < b").groupBy("a", "b").agg(F.count("*").alias("shared"))
    out = shared.join(sizes.select(F.col("k").alias("a"), F.col("n").alias("na")), "a").join(sizes.select(F.col("k").alias("b"), F.col("n").alias("nb")), "b")
    return out.select("a", "b", F.round(F.col("shared") / F.least("na", "nb"), 6).alias("overlap"))


@register("span_gaps", "WITH s AS (SELECT user_id, epoch_us(ts) // 1000000 AS b, epoch_us(ts) // 1000000 + 60 AS e, event_id FROM events), g AS (SELECT user_id, lead(b) OVER (PARTITION BY user_id ORDER BY b, event_id) - e AS gap FROM s) SELECT user_id, coalesce(max(gap), 0)::BIGINT AS gap, coalesce(max(gap), 0) <= 86400 AS compact FROM g GROUP BY user_id")
def span_gaps(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The widest gap between a user's one-minute spans."""
    begin = F.floor(F.unix_micros(F.col("ts").cast("timestamp")) / 1_000_000)
    s = table(spark, sf_dir, "events").select("user_id", "event_id", begin.alias("b"), (begin + 60).alias("e"))
    gap = F.lead("b").over(Window.partitionBy("user_id").orderBy("b", "event_id")) - F.col("e")
    widest = F.coalesce(F.max("gap"), F.lit(0))
    return s.withColumn("gap", gap).groupBy("user_id").agg(widest.alias("gap"), (widest <= 86_400).alias("compact"))


@register("running_mean", "SELECT event_id, floor(avg(value) OVER (PARTITION BY user_id ORDER BY ts, event_id ROWS UNBOUNDED PRECEDING) * 10000 + 0.500001::DOUBLE) / 10000 AS mean FROM events")
def running_mean(spark: SparkSession, sf_dir: str) -> DataFrame:
    w = Window.partitionBy("user_id").orderBy("ts", "event_id").rowsBetween(Window.unboundedPreceding, 0)
    return table(spark, sf_dir, "events").select("event_id", (F.floor(F.avg("value").over(w) * 10_000 + 0.500001) / 10_000).alias("mean"))


@register("judgement_tally", "SELECT event_type AS judgement, count(*)::BIGINT AS n, count(DISTINCT user_id)::BIGINT AS users, string_agg(DISTINCT (user_id % 7)::VARCHAR, '|' ORDER BY (user_id % 7)::VARCHAR) AS reasons FROM events GROUP BY event_type")
def judgement_tally(spark: SparkSession, sf_dir: str) -> DataFrame:
    reasons = F.array_join(F.sort_array(F.collect_set((F.col("user_id") % 7).cast("string"))), "|")
    return table(spark, sf_dir, "events").groupBy(F.col("event_type").alias("judgement")).agg(F.count("*").alias("n"), F.countDistinct("user_id").alias("users"), reasons.alias("reasons"))


@register("structure_shares", "WITH s AS (SELECT conv_id, count(*) AS works, count(DISTINCT role) AS members FROM conversations GROUP BY conv_id), k AS (SELECT conv_id % 10 AS doc, CASE WHEN members < greatest(1, works / 2.0) THEN 'unclear' ELSE 'clear' END AS kind FROM s WHERE works >= 3) SELECT doc, round(count(*) FILTER (kind = 'unclear')::DOUBLE / count(*), 6) AS share, count(*) FILTER (kind = 'unclear')::DOUBLE / count(*) < 0.8 AS ok FROM k GROUP BY doc")
def structure_shares(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Shares of sections without a clear structure among those with three works or more."""
    from lectern.operators.evidence import clear_kind, unclear_share

    s = table(spark, sf_dir, "conversations").groupBy("conv_id").agg(F.count("*").alias("works"), F.collect_set("role").alias("members"))
    kind = F.when(clear_kind(F.lit("clear"), F.col("members"), F.col("works")) == "clear", "clear").otherwise("unclear")
    rows = s.select((F.col("conv_id") % 10).alias("doc_id"), "works", kind.alias("kind"))
    return unclear_share(rows).select(F.col("doc_id").alias("doc"), F.round("share", 6).alias("share"), "ok")


@register("rank_band", "SELECT o_orderkey, round(o_totalprice, 2) AS price FROM orders WHERE (SELECT max(o_totalprice) FROM orders) - o_totalprice <= 15000")
def rank_band(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Orders within a band of the best; the maximum is one number."""
    orders = table(spark, sf_dir, "orders").select("o_orderkey", "o_totalprice")
    top = orders.agg(F.max("o_totalprice").alias("top"))
    return orders.join(F.broadcast(top)).where("top - o_totalprice <= 15000").select("o_orderkey", F.round("o_totalprice", 2).alias("price"))


@register("first_success", "SELECT l_orderkey, min(l_linenumber)::INT AS l_linenumber, (array_agg(l_partkey ORDER BY l_linenumber, l_partkey))[1] AS l_partkey FROM lineitem WHERE l_returnflag = 'A' GROUP BY l_orderkey")
def first_success(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The first line of each order that succeeded."""
    tries = table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", "l_partkey", (F.col("l_returnflag") == "A").alias("ok"))
    return works.first_success(tries, "l_orderkey", "l_linenumber", "ok").select("l_orderkey", "l_linenumber", "l_partkey")


@register("lookup_cascade", "WITH a AS (SELECT l_orderkey AS k, min('part ' || l_partkey) AS v FROM lineitem WHERE l_quantity > 40 GROUP BY 1), b AS (SELECT l_orderkey AS k, min('supplier ' || l_suppkey) AS v FROM lineitem WHERE l_discount > 0.05 GROUP BY 1) SELECT o_orderkey, coalesce(a.v, b.v) AS value, CASE WHEN a.v IS NOT NULL THEN 'part' WHEN b.v IS NOT NULL THEN 'supplier' END AS step FROM orders LEFT JOIN a ON a.k = o_orderkey LEFT JOIN b ON b.k = o_orderkey")
def lookup_cascade(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each order's value from the first lookup that knows it."""
    lines = table(spark, sf_dir, "lineitem")
    step = lambda where, word, c: lines.where(where).select(F.col("l_orderkey").alias("o_orderkey"), F.concat(F.lit(word), F.col(c).cast("string")).alias("value"))
    steps = [("part", step("l_quantity > 40", "part ", "l_partkey")), ("supplier", step("l_discount > 0.05", "supplier ", "l_suppkey"))]
    return works.cascade(table(spark, sf_dir, "orders"), "o_orderkey", steps, "value")


@register("last_wins", "SELECT o_custkey, (array_agg(o_orderkey ORDER BY o_orderdate DESC, o_orderkey DESC))[1] AS o_orderkey FROM orders GROUP BY o_custkey")
def last_wins(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The last order of each customer."""
    orders = table(spark, sf_dir, "orders").select("o_custkey", "o_orderkey", "o_orderdate")
    return files.by_key(orders, F.col("o_custkey"), F.struct("o_orderdate", "o_orderkey")).select("o_custkey", "o_orderkey")


@register("url_buckets", "SELECT CASE WHEN contains(url, 'page=') THEN 'paged' WHEN contains(url, 'utm_') THEN 'tracked' WHEN regexp_matches(url, '\\.html') THEN 'file' ELSE 'plain' END AS bucket, count(*)::BIGINT AS n, min(page_id) AS first FROM pages GROUP BY bucket".replace("\\\\", "\\"))
def url_buckets(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pages by the first pattern that their url has."""
    u = F.col("url")
    bucket = F.when(F.contains(u, F.lit("page=")), "paged").when(F.contains(u, F.lit("utm_")), "tracked").when(u.rlike(r"\.html"), "file").otherwise("plain")
    return table(spark, sf_dir, "pages").groupBy(bucket.alias("bucket")).agg(F.count("*").alias("n"), F.min("page_id").alias("first"))


@register("outlines", "SELECT conv_id, string_agg(turn || '. ' || role || ' ' || length(text), chr(10) ORDER BY turn, role) AS outline FROM conversations WHERE text IS NOT NULL GROUP BY conv_id")
def outlines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each conversation as an outline in order."""
    line = F.concat(F.col("turn").cast("string"), F.lit(". "), "role", F.lit(" "), F.length("text").cast("string"))
    rows = table(spark, sf_dir, "conversations").where("text IS NOT NULL").groupBy("conv_id").agg(F.sort_array(F.collect_list(F.struct("turn", "role", line.alias("line")))).alias("x"))
    return rows.select("conv_id", F.array_join(F.transform("x", lambda s: s["line"]), "\n").alias("outline"))


@register("evidence_confidence", "SELECT l_orderkey, l_linenumber, round((0.7::DOUBLE * (l_quantity / 50) + 0.3::DOUBLE * (1 - l_discount)) * CASE WHEN l_linestatus = 'O' THEN 1 ELSE 0.6::DOUBLE END, 6) AS confidence FROM lineitem")
def evidence_confidence(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = M.evidence_confidence(F.col("l_quantity") / 50, 1 - F.col("l_discount"), F.col("l_linestatus") == "O")
    return table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", F.round(c, 6).alias("confidence"))


@register("citation_keys", r"SELECT p_partkey, length(k) > 0 AND NOT regexp_matches(k, '^[\\§]') AND length(k) - length(replace(k, ' ', '')) <= 2 AND length(k) <= 50 AND length(regexp_replace(k, '[0-9A-Za-z:_\-.+/ ]', '', 'g')) < 0.3 * length(k) AS is_key FROM (SELECT p_partkey, CASE p_size % 3 WHEN 0 THEN p_name WHEN 1 THEN p_brand || '###' ELSE '§' || p_name END AS k FROM part)")
def citation_keys(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = F.when(F.col("p_size") % 3 == 0, F.col("p_name")).when(F.col("p_size") % 3 == 1, F.concat("p_brand", F.lit("###"))).otherwise(F.concat(F.lit("§"), "p_name"))
    return table(spark, sf_dir, "part").select("p_partkey", k.alias("k")).select("p_partkey", X.looks_like_citation_key(F.col("k")).alias("is_key"))


@register("neighbour_multiplicity", "WITH top AS (SELECT o_orderkey AS k FROM orders WHERE o_totalprice > 400000), e AS (SELECT l_partkey AS node FROM lineitem JOIN top ON k = l_orderkey UNION ALL SELECT l_suppkey + 1000000 FROM lineitem JOIN top ON k = l_orderkey) SELECT node, count(*)::BIGINT AS times FROM e GROUP BY node")
def neighbour_multiplicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Neighbours of the top orders in either direction, by number of edges."""
    top = table(spark, sf_dir, "orders").where("o_totalprice > 400000").select(F.col("o_orderkey").alias("l_orderkey"))
    lines = table(spark, sf_dir, "lineitem").select("l_orderkey", "l_partkey", "l_suppkey").join(top, "l_orderkey", "left_semi")
    ends = lines.select(F.explode(F.array("l_partkey", F.col("l_suppkey") + 1_000_000)).alias("node"))
    return ends.groupBy("node").agg(F.count("*").alias("times"))


@register("array_overlap_anti", "WITH bad AS (SELECT l_partkey AS p FROM lineitem WHERE l_discount = 0 GROUP BY 1), own AS (SELECT o_custkey AS c, l_partkey AS p FROM orders JOIN lineitem ON l_orderkey = o_orderkey WHERE o_orderpriority = '1-URGENT' AND l_returnflag = 'R') SELECT c, count(DISTINCT p)::BIGINT AS parts FROM own GROUP BY c HAVING count(*) FILTER (p IN (SELECT p FROM bad)) = 0")
def array_overlap_anti(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Customers none of whose parts are among the excluded ones."""
    lines = table(spark, sf_dir, "lineitem")
    bad = lines.where("l_discount = 0").select(F.col("l_partkey").alias("p")).distinct()
    orders = table(spark, sf_dir, "orders").where("o_orderpriority = '1-URGENT'").select(F.col("o_orderkey").alias("l_orderkey"), F.col("o_custkey").alias("c"))
    own = lines.where("l_returnflag = 'R'").select("l_orderkey", F.col("l_partkey").alias("p")).join(orders, "l_orderkey").select("c", "p")
    out = own.join(own.join(bad, "p", "left_semi").select("c").distinct(), "c", "left_anti")
    return out.groupBy("c").agg(F.countDistinct("p").alias("parts"))
