"""Queries over the documents table."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from lectern.functions import scalars as M
from lectern.functions import text as X
from lectern.operators import dedup
from lectern.operators.graph import connected_components
from lectern.operators.ranks import ranked_in
from lectern.plans.catalog import register
from lectern.session import checkpointed, table


def _docs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "documents")


@register("exact_dedup", "SELECT min(doc_id) AS doc_id, count(*)::BIGINT AS copies FROM documents WHERE text IS NOT NULL GROUP BY md5(text)")
def exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _docs(spark, sf_dir).where(F.col("text").isNotNull())
    return docs.groupBy(F.md5("text")).agg(F.min("doc_id").alias("doc_id"), F.count("*").alias("copies")).select("doc_id", "copies")


@register(
    "normalized_dedup",
    "SELECT min(doc_id) AS doc_id, count(*)::BIGINT AS copies FROM documents WHERE text IS NOT NULL GROUP BY md5(trim(regexp_replace(lower(text), '[^a-z0-9]+', ' ', 'g')))",
)
def normalized_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _docs(spark, sf_dir).where(F.col("text").isNotNull())
    return docs.groupBy(F.md5(X.normalized_title(F.col("text")))).agg(F.min("doc_id").alias("doc_id"), F.count("*").alias("copies")).select("doc_id", "copies")


_SIG = ", ".join(f"min((h * {a} + {b}) % {dedup.PRIME})::BIGINT AS m{i}" for i, (a, b) in enumerate(dedup.coefficients()))
_NAMES = [f"m{i}" for i in range(dedup.HASHES)]
_SIGNED = rf"""tok AS (SELECT DISTINCT doc_id, unnest(regexp_extract_all(lower(text), '[\p{{L}}\p{{N}}_]+', 0)) AS t FROM documents),
sig AS MATERIALIZED (SELECT doc_id, {_SIG} FROM (SELECT doc_id, concat('0x', substr(md5(t), 1, 7))::BIGINT AS h FROM tok) GROUP BY doc_id)"""
_BANDS = " UNION ALL ".join(
    f"SELECT doc_id, {b // dedup.BAND} AS band, concat_ws('-', {', '.join(f'm{i}' for i in range(b, b + dedup.BAND))}) AS value FROM SRC" for b in range(0, dedup.HASHES, dedup.BAND)
)
_EQUAL = " + ".join(f"(x.{m} = y.{m})::INT" for m in _NAMES)
_PAIRS = f"""{_SIGNED},
cls AS MATERIALIZED (SELECT {', '.join(_NAMES)}, min(doc_id) AS doc_id FROM sig GROUP BY {', '.join(_NAMES)}),
cut AS ({_BANDS.replace('SRC', 'cls')}),
cand AS (SELECT DISTINCT p.doc_id AS a, q.doc_id AS b FROM cut p JOIN cut q USING (band, value) WHERE p.doc_id < q.doc_id),
pairs AS MATERIALIZED (SELECT a, b, ({_EQUAL})::DOUBLE / {dedup.HASHES} AS agreement FROM cand JOIN cls x ON x.doc_id = a JOIN cls y ON y.doc_id = b
  UNION ALL SELECT c.doc_id, s.doc_id, 1.0 FROM sig s JOIN cls c ON {' AND '.join(f's.{m} = c.{m}' for m in _NAMES)} WHERE s.doc_id <> c.doc_id)"""


def _signed(spark: SparkSession, sf_dir: str) -> DataFrame:
    return dedup.signatures(_docs(spark, sf_dir), "doc_id", X.words(F.col("text")))


@register("minhash_bands", f"WITH {_SIGNED} SELECT * FROM ({_BANDS.replace('SRC', 'sig')})")
def minhash_bands(spark: SparkSession, sf_dir: str) -> DataFrame:
    return dedup.bands(_signed(spark, sf_dir), "doc_id")


@register("lsh_pairs", f"WITH {_PAIRS} SELECT a, b, round(agreement, 6) AS agreement FROM pairs")
def lsh_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    pairs = dedup.band_pairs(checkpointed(_signed(spark, sf_dir)), "doc_id")
    return pairs.select("a", "b", F.round("agreement", 6).alias("agreement"))


_COMPONENTS = f"""{_PAIRS},
link AS MATERIALIZED (SELECT a, b FROM pairs WHERE agreement >= 0.8 UNION SELECT b, a FROM pairs WHERE agreement >= 0.8),
reach(doc_id, c) AS (SELECT doc_id, doc_id FROM documents UNION SELECT link.b, reach.c FROM reach JOIN link ON link.a = reach.doc_id),
comp AS (SELECT doc_id, min(c) AS component FROM reach GROUP BY doc_id)"""


def _components(spark: SparkSession, sf_dir: str) -> DataFrame:
    pairs = dedup.band_pairs(checkpointed(_signed(spark, sf_dir)), "doc_id").where("agreement >= 0.8")
    found = connected_components(pairs)
    docs = _docs(spark, sf_dir)
    return docs.join(found, docs["doc_id"] == found["node"], "left").withColumn("component", F.coalesce("component", "doc_id"))


@register("near_dup_components", f"WITH RECURSIVE {_COMPONENTS} SELECT doc_id, component FROM comp")
def near_dup_components(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _components(spark, sf_dir).select("doc_id", "component")


@register(
    "cluster_merge",
    f"""WITH RECURSIVE {_COMPONENTS},
    m AS (SELECT d.*, component FROM documents d JOIN comp USING (doc_id))
    SELECT min(doc_id) AS doc_id, (array_agg(doc_id ORDER BY n_chars DESC, doc_id))[1] AS base, count(*)::BIGINT AS size, sum(n_chars)::BIGINT AS n_chars,
      array_to_string(list_sort(list_distinct(array_agg(lang) FILTER (lang IS NOT NULL))), '|') AS lang, array_to_string(list_sort(list_distinct(array_agg(source) FILTER (source IS NOT NULL))), '|') AS source
    FROM m GROUP BY component""",
)
def cluster_merge(spark: SparkSession, sf_dir: str) -> DataFrame:
    return dedup.merge_clusters(_components(spark, sf_dir), "component", "doc_id", "n_chars", ("lang", "source"))


_TOK = r"regexp_extract_all(lower(coalesce(text, '')), '[\p{L}\p{N}_]+', 0)"


@register(
    "ngram_redundancy",
    rf"""WITH t AS (SELECT doc_id, {_TOK} AS w FROM documents),
    g AS (SELECT doc_id, [array_to_string(w[i:i + 4], ' ') FOR i IN range(1, len(w)::BIGINT - 3)] AS g FROM t)
    SELECT doc_id, len(g)::BIGINT AS n_grams, CASE WHEN len(g) = 0 THEN 0.0 ELSE round(1 - len(list_distinct(g))::DOUBLE / len(g), 6) END AS redundancy FROM g""",
)
def ngram_redundancy(spark: SparkSession, sf_dir: str) -> DataFrame:
    grams = _docs(spark, sf_dir).select("doc_id", X.ngrams(X.words(F.coalesce("text", F.lit(""))), 5).alias("g"))
    n = F.size("g")
    share = F.when(n == 0, F.lit(0.0)).otherwise(F.round(1 - F.size(F.array_distinct("g")) / n, 6))
    return grams.select("doc_id", n.cast("long").alias("n_grams"), share.alias("redundancy"))


@register(
    "top_ngram",
    rf"""WITH t AS (SELECT doc_id, {_TOK} AS w FROM documents),
    g AS (SELECT doc_id, unnest([array_to_string(w[i:i + 4], ' ') FOR i IN range(1, len(w)::BIGINT - 3)]) AS gram, unnest(range(0, len(w)::BIGINT - 4)) AS pos FROM t WHERE len(w) >= 5),
    c AS (SELECT doc_id, gram, count(*)::BIGINT AS times, min(pos) AS pos FROM g GROUP BY doc_id, gram)
    SELECT doc_id, gram, times FROM c QUALIFY row_number() OVER (PARTITION BY doc_id ORDER BY times DESC, pos) = 1""",
)
def top_ngram(spark: SparkSession, sf_dir: str) -> DataFrame:
    grams = _docs(spark, sf_dir).select("doc_id", F.posexplode(X.ngrams(X.words("text"), 5)).alias("pos", "gram"))
    counted = grams.groupBy("doc_id", "gram").agg(F.count("*").alias("times"), F.min("pos").alias("pos"))
    best = counted.groupBy("doc_id").agg(F.max(F.struct("times", (-F.col("pos")).alias("p"), "gram")).alias("m"))
    return best.select("doc_id", F.col("m.gram").alias("gram"), F.col("m.times").alias("times"))


_READ = r"""WITH s AS (SELECT doc_id, len([x FOR x IN regexp_split_to_array(coalesce(text, ''), '[.!?]+(?:\s+|[A-Z])') IF trim(regexp_replace(x, '\s+', ' ', 'g')) <> '']) AS sentences,
    regexp_extract_all(coalesce(text, ''), '[A-Za-z]+(?:-[A-Za-z]+)*', 0) AS words FROM documents WHERE lang = 'en'),
  w AS (SELECT doc_id, sentences, len(words) AS n, [greatest(1, len(regexp_extract_all(regexp_replace(CASE WHEN length(x) > 2 THEN regexp_replace(lower(x), '([^aeiou])e$', '\1') ELSE lower(x) END, '[^a-z]', '', 'g'), '[aeiouy]+', 0))) FOR x IN words] AS syl FROM s),
  t AS (SELECT doc_id, sentences::DOUBLE AS s, n::DOUBLE AS n, list_sum(syl)::DOUBLE AS y, len([x FOR x IN syl IF x >= 3])::DOUBLE AS c FROM w)
  SELECT doc_id, CASE WHEN s > 0 AND n > 0 THEN floor((206.835 - 1.015 * (n / s) - 84.6 * (y / n)) * 100 + 0.5) / 100 END AS reading_ease,
    CASE WHEN s > 0 AND n > 0 THEN floor((0.39 * (n / s) + 11.8 * (y / n) - 15.59) * 100 + 0.5) / 100 END AS grade,
    CASE WHEN s > 0 AND n > 0 THEN floor((0.4 * (n / s + 100 * c / n)) * 100 + 0.5) / 100 END AS fog FROM t"""


def _cents(c: Column) -> Column:
    """Two decimals by one rule in every engine."""
    return F.floor(c * 100 + 0.5) / 100


@register("readability", _READ.replace("206.835 -", "206.835::DOUBLE -").replace("0.39 *", "0.39::DOUBLE *").replace("0.4 *", "0.4::DOUBLE *"))
def readability(spark: SparkSession, sf_dir: str) -> DataFrame:
    text = F.coalesce("text", F.lit(""))
    docs = _docs(spark, sf_dir).where("lang = 'en'").select("doc_id", X.sentence_count(text).cast("double").alias("s"), F.transform(X.latin_words(text), X.syllables).alias("y"))
    n, total = F.size("y").cast("double"), F.aggregate("y", F.lit(0), lambda a, x: a + x).cast("double")
    hard = F.size(F.filter("y", lambda x: x >= 3)).cast("double")
    docs = docs.select("doc_id", "s", n.alias("n"), total.alias("t"), hard.alias("c"))
    ok = (F.col("s") > 0) & (F.col("n") > 0)
    per_s, per_w = F.col("n") / F.col("s"), F.col("t") / F.col("n")
    return docs.select(
        "doc_id",
        F.when(ok, _cents(206.835 - 1.015 * per_s - 84.6 * per_w)).alias("reading_ease"),
        F.when(ok, _cents(0.39 * per_s + 11.8 * per_w - 15.59)).alias("grade"),
        F.when(ok, _cents(0.4 * (per_s + 100 * F.col("c") / F.col("n")))).alias("fog"),
    )


@register(
    "inverted_index_roundtrip",
    r"SELECT doc_id, CASE WHEN len(w) > 0 THEN md5(array_to_string(w, ' ')) END AS text_md5, len(list_distinct(w))::BIGINT AS n_entries FROM (SELECT doc_id, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+', 0) AS w FROM documents)",
)
def inverted_index_roundtrip(spark: SparkSession, sf_dir: str) -> DataFrame:
    """An index over each text's words, and the text back from it."""
    words = F.regexp_extract_all(F.coalesce("text", F.lit("")), F.lit(r"[^\x20\x09-\x0D]+"), F.lit(0))
    docs = _docs(spark, sf_dir).select("doc_id", words.alias("w"))
    pairs = docs.select("doc_id", F.posexplode_outer("w").alias("pos", "word"))
    entries = pairs.groupBy("doc_id", "word").agg(F.sort_array(F.collect_list("pos")).alias("at"))
    index = entries.where(F.col("word").isNotNull()).groupBy("doc_id").agg(F.map_from_entries(F.collect_list(F.struct("word", "at"))).alias("index"))
    out = docs.select("doc_id").join(index, "doc_id", "left")
    return out.select("doc_id", F.md5(M.abstract_of(F.col("index"))).alias("text_md5"), F.coalesce(F.size("index"), F.lit(0)).cast("long").alias("n_entries"))


_QUERY = '(trash OR "of the" OR worthless) AND (the OR and)'


@register(
    "boolean_search",
    "SELECT doc_id FROM documents WHERE (contains(lower(text), 'trash') OR contains(lower(text), 'of the') OR contains(lower(text), 'worthless')) AND (contains(lower(text), 'the') OR contains(lower(text), 'and'))",
)
def boolean_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _docs(spark, sf_dir).where(M.matches_any_of_groups(F.lower("text"), M.boolean_groups(_QUERY))).select("doc_id")


def _any(c: str, phrases: tuple[str, ...]) -> str:
    return "(" + " OR ".join(f"contains({c}, '{p}')" for p in phrases) + ")"


@register(
    "lexicon_sentences",
    rf"""WITH s AS (SELECT doc_id, unnest(string_split(text, chr(10))) AS line FROM documents), l AS (SELECT doc_id, lower(line) AS x FROM s)
    SELECT doc_id, count(*) FILTER ({_any('x', X.GAP_PHRASES)})::BIGINT AS gaps, count(*) FILTER ({_any('x', X.FUTURE_PHRASES)})::BIGINT AS future,
      count(*) FILTER ({_any('x', X.SYNTHESIS_PHRASES)})::BIGINT AS synthesis, count(*) FILTER ({_any('x', X.CRITIQUE_PHRASES)})::BIGINT AS critique FROM l GROUP BY doc_id""",
)
def lexicon_sentences(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Lines with phrases that mark research gaps, future work, synthesis and critique."""
    lines = F.split(F.lower("text"), "\n")
    kinds = {"gaps": X.GAP_PHRASES, "future": X.FUTURE_PHRASES, "synthesis": X.SYNTHESIS_PHRASES, "critique": X.CRITIQUE_PHRASES}

    def count(phrases: tuple[str, ...]) -> Column:
        return F.size(F.filter(lines, lambda s: X.has_any(s, phrases))).cast("long")

    counts = [count(p).alias(k) for k, p in kinds.items()]
    return _docs(spark, sf_dir).where(F.col("text").isNotNull()).select("doc_id", *counts)


@register(
    "status_cascade",
    """SELECT status, count(*)::BIGINT AS n, sum(n_chars)::BIGINT AS n_chars FROM (
      SELECT n_chars, CASE WHEN l.quality = 1 THEN 0 WHEN l.quality = 0 THEN 1 WHEN lang = 'en' THEN 2 ELSE 3 END AS status FROM documents d LEFT JOIN labels l USING (doc_id)) GROUP BY status""",
)
def status_cascade(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Resolution status of each text: good ones have content, others an abstract, unlabelled English ones metadata."""
    rows = _docs(spark, sf_dir).join(table(spark, sf_dir, "labels"), "doc_id", "left")
    x = F.lit("x")
    status = M.citation_status(F.when(F.col("quality") == 1, x), F.when(F.col("quality") == 0, x), F.when(F.col("lang") == "en", x))
    return rows.withColumn("status", status).groupBy("status").agg(F.count("*").alias("n"), F.sum("n_chars").alias("n_chars"))


@register(
    "best_query_assignment",
    """WITH q(pos, term) AS (VALUES (0, 'the'), (1, 'de'), (2, 'der'), (3, 'and')),
    r AS (SELECT doc_id, pos, term, (length(lower(text)) - length(replace(lower(text), term, '')))::DOUBLE / length(term) AS relevance FROM documents, q WHERE contains(lower(text), term))
    SELECT doc_id, term, relevance FROM r QUALIFY row_number() OVER (PARTITION BY doc_id ORDER BY relevance DESC, pos) = 1""",
)
def best_query_assignment(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each text goes to the query with the highest relevance, the earlier of equals; queries come as an array."""
    low = F.lower(F.col("text"))
    terms = ("the", "de", "der", "and")
    scored = F.array(*[F.struct(((F.length(low) - F.length(F.replace(low, F.lit(t), F.lit("")))) / F.lit(float(len(t)))).alias("r"), F.lit(-i).alias("p"), F.lit(t).alias("t")) for i, t in enumerate(terms)])
    best = F.array_max(F.filter(scored, lambda s: s["r"] > 0))
    return _docs(spark, sf_dir).select("doc_id", best.alias("b")).where(F.col("b").isNotNull()).select("doc_id", F.col("b.t").alias("term"), F.col("b.r").alias("relevance"))


_QUOTA = 100


@register(
    "quota_select",
    f"""WITH c AS (SELECT source, count(*) AS n FROM documents GROUP BY source), q AS (SELECT source, greatest(1, floor({_QUOTA} * n::DOUBLE / (SELECT sum(n) FROM c)))::BIGINT AS base FROM c),
    f AS (SELECT source, base, row_number() OVER (ORDER BY base DESC, source) AS k, count(*) OVER () AS m, sum(base) OVER () AS got FROM q),
    quota AS (SELECT source, base + CASE WHEN got < {_QUOTA} THEN ({_QUOTA} - got) // m + (k <= ({_QUOTA} - got) % m)::BIGINT ELSE 0 END AS grown, CASE WHEN got > {_QUOTA} THEN (got - {_QUOTA}) // m + (k <= (got - {_QUOTA}) % m)::BIGINT ELSE 0 END AS cut FROM f),
    r AS (SELECT doc_id, source, n_chars, row_number() OVER (PARTITION BY source ORDER BY n_chars DESC, doc_id) AS place FROM documents)
    SELECT doc_id, source, place::BIGINT AS place, round(0.3::DOUBLE * n_chars / max(n_chars) OVER () + 0.7, 6) AS score FROM r JOIN quota USING (source) WHERE place <= greatest(1, grown - cut)""",
)
def quota_select(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Proportional quotas by source, what is missing given out, or what is too much taken back, in turn from the largest, none under one; the longest texts fill them."""
    docs = _docs(spark, sf_dir).select("doc_id", "source", "n_chars")
    counts = docs.groupBy("source").agg(F.count("*").alias("n"))
    total = counts.agg(F.sum("n").alias("total"))
    base = counts.join(F.broadcast(total)).select("source", F.greatest(F.lit(1), F.floor(_QUOTA * F.col("n") / F.col("total"))).alias("base"))
    one = Window.orderBy(F.col("base").desc(), "source")  # a row for each source
    every = Window.partitionBy(F.lit(1))
    ranked = base.withColumn("k", F.row_number().over(one)).withColumn("m", F.count("*").over(every)).withColumn("off", _QUOTA - F.sum("base").over(every))
    turns = F.floor(F.abs("off") / F.col("m")) + (F.col("k") <= F.abs("off") % F.col("m")).cast("long")
    quota = ranked.select("source", F.greatest(F.lit(1), F.col("base") + F.signum("off").cast("long") * turns).alias("quota"))
    kept = ranked_in(docs, ["source"], [F.col("n_chars").desc(), F.col("doc_id")], "place").join(quota, "source").where("place <= quota")
    most = docs.agg(F.max("n_chars").alias("most"))
    return kept.join(F.broadcast(most)).withColumn("score", F.round(0.3 * F.col("n_chars") / F.col("most") + 0.7, 6)).select("doc_id", "source", "place", "score")
