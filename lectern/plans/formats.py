"""Queries of the document parsers: documents are made from columns, and SQL gives the rows that parsing should find."""

from __future__ import annotations

import json

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lectern.operators import completion, evidence, parsers, ranking
from lectern.operators import dedup as D
from lectern.operators import vectors as V
from lectern.plans.catalog import register
from lectern.session import table

_ENTRY = "key string, kind string, title string, author string, year string"


def _made(spark: SparkSession, sf_dir: str, template: str) -> DataFrame:
    """(p_partkey, text): the template with {name}, {type} and {brand} of each part."""
    out = F.lit(template)
    for mark, c in (("{name}", "p_name"), ("{type}", "p_type"), ("{brand}", "p_brand")):
        out = F.replace(out, F.lit(mark), F.col(c))
    return table(spark, sf_dir, "part").select("p_partkey", out.alias("text"))


_TEI = """<TEI xmlns="http://www.tei-c.org/ns/1.0"><text><front><abstract><div><p>We look at {name}.</p></div></abstract></front>
<body><div><head n="1">On {name}</head><p>It is {type} <ref type="bibr" target="#b0">[1]</ref>. They call it {brand}.</p></div>
<div><head n="1.1">Scope</head><p>Small.</p></div><div><head>Open problems</head><p>Many.</p></div></body>
<back><listBibl><biblStruct xml:id="b0"><analytic><title>About {type}</title></analytic></biblStruct></listBibl></back></text></TEI>"""


@register(
    "tei_sentences",
    """SELECT p_partkey, unnest(['0', '1', '1', '1.1', '2']) AS section_id, unnest(['Abstract', 'On ' || p_name, 'On ' || p_name, 'Scope', 'Open problems']) AS title, unnest([0, 0, 1, 0, 0])::INT AS sent,
    unnest(['We look at ' || p_name || '.', 'It is ' || p_type || ' [1].', 'They call it ' || p_brand || '.', 'Small.', 'Many.']) AS text, unnest(['', 'About ' || p_type, '', '', '']) AS citations FROM part""",
)
def tei_sentences(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Sentences of TEI documents with their sections and citations."""
    rows = parsers.parsed(_made(spark, sf_dir, _TEI), "p_partkey", "text", parsers.tei, parsers.SENTENCES)
    return rows.select("p_partkey", "section_id", "title", "sent", "text", F.array_join("citations", "|").alias("citations"))


@register("tei_outline", "SELECT p_partkey, unnest(['0', '1', '2', '3']) AS section_id, unnest(['Abstract', 'On ' || p_name, 'Scope', 'Open problems']) AS title FROM part")
def tei_outline(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Headings of the same documents, read flat."""
    rows = parsers.parsed(_made(spark, sf_dir, _TEI), "p_partkey", "text", lambda x: parsers.tei_headings(x, "casual"), "path array<int>, section_id string, title string")
    return rows.select("p_partkey", "section_id", "title")


_MAIN = r"""\documentclass{a}\title{On \textbf{{name}}}% a note
\begin{document}\section{First} It is {type}~\cite{k1, k2}. They agree.

\input{part}\section{Last} Done.\end{document}"""
_PART = r"\subsection{Inner} About {brand} \citep[see][]{k3}."


def _joined(text: str) -> list[parsers.Row]:
    main, part = text.split("\x00")
    files = {"main.tex": main, "part.tex": part}
    whole = parsers.with_inputs(next(n for n, t in files.items() if parsers.is_main_file(t)), files)
    title = parsers.argument(whole, "title")
    return [(title, r[1], r[2], r[5], r[6]) for r in parsers.latex(whole)]


@register(
    "latex_sentences",
    """SELECT p_partkey, 'On ' || p_name AS document, unnest(['1', '1', '1.1', '2']) AS section_id, unnest(['First', 'First', 'Inner', 'Last']) AS title,
    unnest(['It is ' || p_type || '.', 'They agree.', 'About ' || p_brand || '.', 'Done.']) AS text, unnest(['k1|k2', '', 'k3', '']) AS citations FROM part""",
)
def latex_sentences(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Sentences of LaTeX projects: the main file is told by its parts, inputs are put in, titles taken out."""
    made = _made(spark, sf_dir, _MAIN + "\x00" + _PART)
    rows = parsers.parsed(made, "p_partkey", "text", _joined, "document string, section_id string, title string, text string, citations array<string>")
    text = F.regexp_replace("text", r" (?=\.)", "")
    return rows.select("p_partkey", "document", "section_id", "title", text.alias("text"), F.array_join("citations", "|").alias("citations"))


_BIB = "@article{a1, title={The {B}ook of {name}}, author=\"X and {brand}\", year=2020}\n@comment{no}\n@book{b2, title = \"{type}\"}\n@book{a1, title={Again}}"


@register("bibtex_entries", "SELECT p_partkey, unnest(['a1', 'b2']) AS key, unnest(['article', 'book']) AS kind, unnest(['The Book of ' || p_name, p_type]) AS title, unnest(['X and ' || p_brand, '']) AS author, unnest(['2020', '']) AS year FROM part")
def bibtex_entries(spark: SparkSession, sf_dir: str) -> DataFrame:
    return parsers.parsed(_made(spark, sf_dir, _BIB), "p_partkey", "text", parsers.bibtex, _ENTRY)


@register("compiled_entries", "SELECT p_partkey, unnest(['k', 'l', 'm']) AS key, unnest(['A. ' || p_name || '.', p_type, 'T ' || p_brand]) AS reference FROM part")
def compiled_entries(spark: SparkSession, sf_dir: str) -> DataFrame:
    """References of compiled bibliographies in both forms."""
    def both(text: str) -> list[parsers.Row]:
        return [r for part in text.split("\x00") for r in parsers.compiled_bibliography(part)]

    made = _made(spark, sf_dir, r"\bibitem[A(1)]{k} A. \newblock {name}. \bibitem{l} {type}\end{thebibliography}" + "\x00" + r"\entry{m}{article}\field{title}{T {brand}}\endentry")
    return parsers.parsed(made, "p_partkey", "text", both, "key string, reference string")


@register("listing_rows", "SELECT p_partkey, unnest(['2301.' || p_size, '2302.' || p_size]) AS id, unnest([p_name, 'More on ' || p_type]) AS title FROM part")
def listing_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Ids and titles of an archive's listing pages."""
    page = '<dl><dt><a href="/abs/2301.{size}">x</a></dt><dd><div class="list-title">Title: {name}</div></dd>\n<dt><a href="/abs/2302.{size}">y</a></dt><dd><div class="list-title">\n<span>Title:</span> More on\n {type}</div></dd></dl>'
    rows = _made(spark, sf_dir, page).join(table(spark, sf_dir, "part").select("p_partkey", "p_size"), "p_partkey")
    rows = rows.select("p_partkey", F.replace("text", F.lit("{size}"), F.col("p_size").cast("string")).alias("text"))
    return parsers.parsed(rows, "p_partkey", "text", parsers.listing, "id string, title string")


@register("abstract_pages", "SELECT p_partkey, 'About ' || p_name || ' and ' || p_type AS abstract FROM part")
def abstract_pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Abstracts of abstract pages."""
    made = _made(spark, sf_dir, '<html><h1>x</h1><blockquote class="abstract mathjax">\n<span class="descriptor">Abstract:</span>About {name}\n  and <i>{type}</i> </blockquote><p>z</p></html>')
    return parsers.parsed(made, "p_partkey", "text", parsers.abstract, "abstract string")


@register("any_texts", "SELECT p_partkey, p_name || chr(10) || p_type || chr(10) || p_brand AS flat FROM part")
def any_texts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Text of nested JSON of any depth."""
    made = _made(spark, sf_dir, '{"a": {"value": "{name}"}, "b": ["{type}", {"c": [null, {"d": "{brand}"}]}], "e": {}}')
    return parsers.parsed(made, "p_partkey", "text", lambda t: [(parsers.any_text(json.loads(t)),)], "flat string")


@register("ascii_titles", "SELECT p_partkey, regexp_replace(lower(p_name), '[^0-9a-z]', '', 'g') || 'uberstrasse' || p_size AS flat FROM part")
def ascii_titles(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Titles transliterated to plain letters."""
    rows = table(spark, sf_dir, "part").select("p_partkey", F.concat("p_name", F.lit(" – Über-Straße "), F.col("p_size").cast("string")).alias("text"))
    return parsers.parsed(rows, "p_partkey", "text", lambda t: [(parsers.ascii_letters(t),)], "flat string")


@register("section_numbers", "SELECT p_partkey, CASE p_size % 3 WHEN 0 THEN '1|1.1|1.2|1.3|3.1.2' WHEN 1 THEN '1|2|2.1' ELSE '2|3|4' END AS paths FROM part")
def section_numbers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Numbered and unnumbered heads put in order."""
    heads = F.when(F.col("p_size") % 3 == 0, "1|1.1||1.1|3.1.2").when(F.col("p_size") % 3 == 1, "1|2|2.1").otherwise("2||")
    rows = table(spark, sf_dir, "part").select("p_partkey", heads.alias("text"))
    made = lambda t: [("|".join(".".join(map(str, p)) for p in parsers.renumbered([(x or None, "t") for x in t.split("|")])),)]
    return parsers.parsed(rows, "p_partkey", "text", made, "paths string")


@register("decoded_texts", "SELECT p_partkey, p_name || CASE WHEN p_size % 2 = 0 THEN ' é中' ELSE ' é' END AS content FROM part")
def decoded_texts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Bytes that are UTF-8 or Latin-1."""
    utf, latin = (F.encode(F.concat("p_name", F.lit(x)), k) for x, k in ((" é中", "UTF-8"), (" é", "ISO-8859-1")))
    rows = table(spark, sf_dir, "part").select("p_partkey", F.when(F.col("p_size") % 2 == 0, utf).otherwise(latin).alias("data"))
    return parsers.parsed(rows, "p_partkey", "data", lambda b: [(parsers.decoded(bytes(b)),)], "content string")


@register("method_spans", "SELECT conv_id, CASE WHEN conv_id % 3 = 2 THEN '' ELSE md5((array_agg(text ORDER BY turn, text))[1]) END AS first_span FROM conversations WHERE text IS NOT NULL GROUP BY conv_id")
def method_spans(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Sentences that an answer's spans name; broken answers name none."""
    rows = table(spark, sf_dir, "conversations").where("text IS NOT NULL").groupBy("conv_id").agg(F.sort_array(F.collect_list(F.struct("turn", "text"))).alias("s"))
    sents = F.to_json(F.struct(F.transform("s", lambda x: x["text"]).alias("s"), (F.col("conv_id") % 3).alias("k")))

    def span(text: str) -> list[parsers.Row]:
        x = json.loads(text)
        found = completion.spans("broken" if x["k"] == 2 else "[[1, 1], [9999, 10000]]", x["s"])
        return [(found[0] if found else "",)]

    got = parsers.parsed(rows.select("conv_id", sents.alias("text")), "conv_id", "text", span, "first_span string")
    return got.select("conv_id", F.when(F.col("first_span") == "", "").otherwise(F.md5("first_span")).alias("first_span"))


@register("conclusive_checks", "WITH j AS (SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey, CASE WHEN l_returnflag = 'N' THEN 'NEUTRAL' ELSE l_returnflag END AS v, l_discount AS s FROM lineitem) SELECT l_orderkey, (array_agg(v ORDER BY (v = 'NEUTRAL')::INT, CASE WHEN v = 'NEUTRAL' THEN -s ELSE 0 END, l_linenumber, l_partkey, l_suppkey))[1] AS verdict FROM j GROUP BY l_orderkey")
def conclusive_checks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Of each claim's judgements the one that counts: the first conclusive one, else the best scored neutral one."""
    verdict = F.when(F.col("l_returnflag") == "N", "NEUTRAL").otherwise(F.col("l_returnflag"))
    order = F.struct((verdict == "NEUTRAL").cast("int").alias("n"), F.when(verdict == "NEUTRAL", -F.col("l_discount")).otherwise(F.lit(0.0)).alias("s"), "l_linenumber", "l_partkey", "l_suppkey")
    return table(spark, sf_dir, "lineitem").groupBy("l_orderkey").agg(F.min_by(verdict, order).alias("verdict"))


@register("anchor_surveys", "SELECT DISTINCT p_name FROM part WHERE p_name IN (SELECT p_name FROM part WHERE p_size > 45)")
def anchor_surveys(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Titles that an answer picks, word for word."""
    picked = table(spark, sf_dir, "part").where("p_size > 45").select(F.col("p_name").alias("title")).union(spark.createDataFrame([("not there",)], "title string")).distinct()
    names = table(spark, sf_dir, "part").select("p_name").distinct()
    return names.join(picked, F.col("p_name") == F.col("title"), "left_semi")


@register("discussions", "SELECT p_partkey, unnest(['2', '3.1']) AS section_id, unnest([1, 2])::INT AS depth FROM part")
def discussions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Sections that speak of discussion, none inside another."""
    heads = [([1], "Intro"), ([2], "Future work"), ([2, 1], "Challenges"), ([3], "Models"), ([3, 1], "Limitations")]
    every = F.explode(F.array(*[F.struct(F.array(*map(F.lit, p)).alias("path"), F.lit(t).alias("title")) for p, t in heads])).alias("s")
    rows = table(spark, sf_dir, "part").select(F.col("p_partkey").alias("doc_id"), every).select("doc_id", "s.path", "s.title")
    return evidence.discussion_sections(rows).select(F.col("doc_id").alias("p_partkey"), F.array_join(F.transform("path", lambda x: x.cast("string")), ".").alias("section_id"), "depth")


@register(
    "same_works",
    """WITH p AS (SELECT p_partkey, regexp_replace(lower(p_name), '[^0-9a-z]', '', 'g') AS a, regexp_replace(lower(CASE p_size % 3 WHEN 0 THEN p_name || 's' WHEN 1 THEN upper(p_name) ELSE p_type END), '[^0-9a-z]', '', 'g') AS b, p_size FROM part)
    SELECT p_partkey, levenshtein(a, b) <= greatest(1, floor(greatest(length(a), length(b)) * 0.1::DOUBLE)) AND p_size % 2 = 0 AND (p_size % 5 = 0 OR p_size % 5 <= 1) AS same FROM p""",
)
def same_works(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Whether two records are one work, by title, authors and year."""
    n, size = F.col("p_name"), F.col("p_size")
    other = F.when(size % 3 == 0, F.concat(n, F.lit("s"))).when(size % 3 == 1, F.upper(n)).otherwise(F.col("p_type"))
    authors = F.array(F.lit("a"), F.lit("b"))
    theirs = F.when(size % 2 == 0, F.array(F.lit("b"), F.lit("a"), F.lit("c"))).otherwise(F.array(F.lit("a"), F.lit("x")))
    same = D.same_work(n, other, authors, theirs, F.lit(2000), F.lit(2000) + F.when(size % 5 != 0, size % 5))
    return table(spark, sf_dir, "part").select("p_partkey", same.alias("same"))


@register(
    "filled_quotas",
    """WITH r AS (SELECT p_partkey AS id, CASE WHEN p_size <= 3 THEN 'high' WHEN p_size <= 30 THEN 'query' ELSE 'neighbour' END AS kind, p_retailprice AS score FROM part), k AS (SELECT *, row_number() OVER (PARTITION BY kind ORDER BY score DESC, id) AS n FROM r),
    c AS (SELECT count(*) FILTER (kind = 'high') AS h, count(*) FILTER (kind = 'query') AS q, count(*) FILTER (kind = 'neighbour') AS e, count(*) // 4 AS size FROM r), l AS (SELECT *, greatest(0, size - h) AS rest FROM c),
    m AS (SELECT *, least(q, rest // 2 + greatest(0, rest - rest // 2 - e)) AS nq FROM l)
    SELECT id, kind FROM k, m WHERE n <= CASE kind WHEN 'high' THEN least(h, size) WHEN 'query' THEN nq ELSE least(e, rest - nq) END""",
)
def filled_quotas(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A quarter of the rows by quotas: all of the best kind, the rest shared."""
    kind = F.when(F.col("p_size") <= 3, "high").when(F.col("p_size") <= 30, "query").otherwise("neighbour")
    rows = table(spark, sf_dir, "part").select(F.col("p_partkey").alias("id"), kind.alias("kind"), F.col("p_retailprice").alias("score"))
    return ranking.fill_quotas(rows, rows.count() // 4).select("id", "kind")


@register("embedded_texts", "SELECT doc_id, CASE WHEN regexp_matches(coalesce(text, ''), '[\\p{L}\\p{N}_]') THEN 1.0 ELSE 0.0 END AS norm, 64 AS size FROM documents")
def embedded_texts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Texts as unit vectors of a stand-in embedder; texts without a word as zeros."""
    docs = table(spark, sf_dir, "documents")
    e = completion.embedded(docs, "doc_id", "text", completion.HashEmbedder(64))
    norm = F.round(F.sqrt(V.dot(F.col("embedding"), F.col("embedding"))), 3)
    return e.select("doc_id", norm.alias("norm"), F.size("embedding").alias("size"))
