"""Operators and functions on small hand-made cases, against plain Python."""

from __future__ import annotations

import random

import duckdb
import numpy as np
import pytest
from pyspark.sql import functions as F

from lectern.functions import scalars as M
from lectern.functions import text as X
from lectern.operators import citations, completion, dedup, evidence, forums, graph, parsers, ranking, ranks, vectors
from lectern.plans import catalog
from lectern.plans import ranking as plan_ranking
from lectern.sources import files, works
from lectern.streaming import windows


def value(spark, column):
    return spark.range(1).select(column.alias("x")).first().x


@pytest.mark.parametrize(
    ("made", "expected"),
    [
        (lambda: X.heading_key(F.lit("1.2 Methods & Data")), "methods and data"),
        (lambda: X.heading_key(F.lit("visual tasks")), "visual tasks"),
        (lambda: X.heading_key(F.lit("IV. Results")), "results"),
        (lambda: X.is_generic_heading(F.lit("A > 1 Introduction")), True),
        (lambda: X.is_generic_heading(F.lit("Introduction")), True),
        (lambda: X.is_generic_heading(F.lit("A > Graph models")), False),
        (lambda: X.arxiv_id(F.lit("http://arxiv.org/abs/2301.01234v2")), "2301.01234"),
        (lambda: X.arxiv_id(F.lit("see hep-th/9901001.")), "hep-th/9901001"),
        (lambda: X.arxiv_pdf_url(F.lit("https://www.arxiv.org/html/2301.01234?x")), "https://arxiv.org/pdf/2301.01234.pdf"),
        (lambda: X.arxiv_pdf_url(F.lit("https://x.org/abs/1")), "https://x.org/abs/1"),
        (lambda: X.doi(F.lit("https://doi.org/10.1/AB")), "10.1/ab"),
        (lambda: X.truncated_title(F.lit("Graph-based RAG: a view")), "Graph-based RAG"),
        (lambda: X.keyword_query(F.lit("A Survey of Methods for Graph Learning")), "Graph Learning"),
        (lambda: X.keyword_query(F.lit("survey")), "survey"),
        (lambda: X.syllables(F.lit("table")), 1),
        (lambda: X.syllables(F.lit("reality")), 3),
        (lambda: X.sentence_count(F.lit("One. Two! e.g.x 3.5 is? End")), 4),
        (lambda: X.fuzzy_title(F.lit("Deep Nets"), F.lit("On deep nets!")), True),
        (lambda: X.fuzzy_title(F.lit("Deep Nets"), F.lit("Wide trees")), False),
        (lambda: X.is_listed_survey(F.lit("A Survey on X")), True),
        (lambda: X.is_literature_survey(F.lit("Tutorial on X"), F.lit("")), False),
        (lambda: X.is_literature_survey(F.lit("A taxonomy of X"), F.lit("a systematic view")), True),
        (lambda: X.looks_like_citation_key(F.lit("smith2020:deep")), True),
        (lambda: X.looks_like_citation_key(F.lit("\\foo")), False),
        (lambda: X.ngrams(F.split(F.lit("a b c"), " "), 2), ["a b", "b c"]),
        (lambda: X.ngrams(F.split(F.lit("a"), " "), 2), []),
        (lambda: M.year_of(F.lit("2020-01")), 2020),
        (lambda: M.year_of(F.lit("n.d.")), None),
        (lambda: M.paper_age(F.lit(2024), F.lit("2030-01-01").cast("date")), 1),
        (lambda: M.log_share(F.lit(0), F.lit(0)), 0.0),
        (lambda: M.filter_string(F.create_map(F.lit("b"), F.lit("2"), F.lit("a"), F.lit("1"))), "a:1,b:2"),
        (lambda: M.citation_status(F.lit(""), F.lit("x"), F.lit("")), 1),
        (lambda: M.json_text(F.lit('so: ```json\n{"a": 1}\n``` ok')), '{"a": 1}'),
        (lambda: M.json_text(F.lit('well {"a": [1,2,],} done')), '{"a": [1,2]}'),
        (lambda: M.evidence_confidence(F.lit(1.0), F.lit(0.5), F.lit(False)), pytest.approx(0.51)),
        (lambda: forums.pdf_url(F.lit("/pdf?id=1"), "https://s"), "https://s/pdf?id=1"),
        (lambda: ranking.preference_mask(F.lit(3.0), F.lit(2.0), F.lit(1.0)), 7),
        (lambda: ranking.preference_mask(F.lit(3.0), F.lit(None).cast("double"), F.lit(1.0)), 9),
        (lambda: vectors.coverage_status(F.lit(0.45)), "weakly covered"),
        (lambda: vectors.coverage_status(F.lit(0.551)), "covered"),
    ],
)
def test_expressions(spark, made, expected):
    assert value(spark, made()) == expected


def test_counts_as_of_a_year(spark):
    years = F.array(*[F.struct(F.lit(y).alias("year"), F.lit(n).cast("long").alias("cited_by_count")) for y, n in ((2019, 3), (2022, 50))])
    assert value(spark, M.count_as_of(F.lit(10), years, F.lit(2020))) == 0  # later years exceed the total: clamped
    assert value(spark, M.count_as_of(F.lit(0), years, F.lit(2020))) == 3


def test_abstract_with_gaps(spark):
    index = F.create_map(F.lit("a"), F.array(F.lit(0), F.lit(3)), F.lit("b"), F.array(F.lit(1)))
    assert value(spark, M.abstract_of(index)) == "a b <mask> a"


def test_boolean_queries():
    assert M.boolean_groups('((survey OR "a review") AND (graph OR net))') == [["survey", "a review"], ["graph", "net"]]
    assert M.boolean_groups("one") == [["one"]]


def test_components_match_union_find(spark):
    rng = random.Random(1)
    pairs = [(rng.randrange(60), rng.randrange(60)) for _ in range(45)] + [(i, i + 1) for i in range(100, 130)] + [(200, i) for i in range(201, 260)]
    parent = {x: x for p in pairs for x in p}

    def root(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a, b in pairs:
        a, b = root(a), root(b)
        parent[max(a, b)] = min(a, b)
    got = {r.node: r.component for r in graph.connected_components(spark.createDataFrame([*pairs, (None, 1)], "a long, b long")).collect()}
    linked = {x for a, b in pairs if a != b for x in (a, b)}
    assert got == {x: root(x) for x in linked}
    assert graph.connected_components(spark.createDataFrame([], "a long, b long")).count() == 0


def test_pagerank_sums_to_one(spark):
    edges = [("a", "b"), ("a", "b"), ("b", "c"), ("c", "a"), ("d", "d"), ("a", "e")]
    nodes = spark.createDataFrame([(x,) for x in "abcdef"], "node string")
    got = {r.node: r["rank"] for r in citations.pagerank(spark.createDataFrame(edges, "src string, dst string"), nodes, rounds=30).collect()}
    assert sum(got.values()) == pytest.approx(1) and got["d"] == got["f"] and got["b"] > got["f"]


def test_same_work(spark):
    f = lambda ta, tb, aa, ab, ya, yb: value(spark, dedup.same_work(F.lit(ta), F.lit(tb), F.array(*map(F.lit, aa)).cast("array<string>"), F.array(*map(F.lit, ab)).cast("array<string>"), F.lit(ya), F.lit(yb)))
    assert f("Deep nets", "Deep net", ["x"], ["x"], 2020, 2021)
    assert not f("Deep nets", "Deep nets", ["x"], ["x"], 2020, 2022)
    assert not f("Deep nets", "Deep nets", ["x"], ["y"], 2020, 2020)
    assert f("Deep nets", "Deep nets", [], ["y"], 2020, 2020)


def test_quotas_and_splits(spark):
    rows = spark.createDataFrame([(i, k, float(i)) for k, ids in (("high", range(3)), ("query", range(10, 12)), ("neighbour", range(20, 40))) for i in ids], "id long, kind string, score double")
    for size in (2, 5, 10, 25, 100):
        assert ranking.fill_quotas(rows, size).count() == min(size, 25)
    split = ranking.tail_split(spark.createDataFrame([("a", i) for i in range(9)] + [("b", i) for i in range(20)], "s string, i long"), "s", "i")
    assert split.where("split = 'valid'").count() == 2


def test_vectors(spark):
    rng = np.random.default_rng(0)
    m, side = rng.normal(size=(30, 8)), rng.normal(size=(4, 8))
    rows = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(m)], "k long, v array<double>")
    held = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(side)], "t long, v array<double>")
    got = {r.k: (r.match, r.similarity) for r in vectors.best_match(rows, "k", "v", held, "t", "v").collect()}
    sim = (m / np.linalg.norm(m, axis=1, keepdims=True)) @ (side / np.linalg.norm(side, axis=1, keepdims=True)).T
    assert all(got[i][0] == sim[i].argmax() and got[i][1] == pytest.approx(sim[i].max()) for i in range(30))
    assert vectors.greedy_accept(["a", "b", "c"], np.array([[1, 0], [0.9, 0.1], [0, 1]]), np.zeros((0, 2))) == ["a", "c"]


def test_vectors_in_blocks(spark, monkeypatch):
    """Any number of blocks gives what one matrix gives."""
    monkeypatch.setattr(vectors, "BLOCK", 16)
    rng = np.random.default_rng(4)
    m = rng.normal(size=(90, 6)).round(3)
    m[7] = m[3]
    m[9] = 0
    rows = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(m)], "k long, v array<double>")
    n = np.linalg.norm(m, axis=1, keepdims=True)
    unit = m / np.where(n == 0, 1, n)
    sim = np.round(unit @ unit.T, 9)
    queries = rows.where("k % 20 = 0")
    got = sorted((r.query, r.k) for r in vectors.nearest(queries, rows, "k", "v", 5).collect())
    assert got == sorted((q, int(i)) for q in range(0, 90, 20) for i in np.lexsort((np.arange(90), -sim[q]))[:5])
    assert vectors.count_above(queries, "k", "v", rows, 0.3).first().pairs == int((sim[::20] > 0.3).sum())
    best = {r.k: (r.match, r.similarity) for r in vectors.best_match(rows, "k", "v", queries, "k", "v").collect()}
    assert all(best[i][1] == pytest.approx(sim[i, ::20].max()) for i in range(90)) and best[0][0] == 0
    assert {r.match for r in vectors.best_match(rows, "k", "v", queries.limit(0), "k", "v").collect()} == {None}
    kept = vectors.keep_share(vectors.similarities(queries, rows, "k", "v"), ["query"], "similarity", "k", 0.3)
    assert kept.groupBy("query").count().select("count").distinct().collect()[0][0] == 27


def test_shares_without_a_matrix(spark, monkeypatch):
    """The rows that sorting all similarities keeps, ties and zero vectors too, from far fewer rows written out."""
    for name, n in (("BLOCK", 64), ("STEPS", 4), ("FEW", 8)):
        monkeypatch.setattr(vectors, name, n)
    rng = np.random.default_rng(6)
    m = rng.normal(size=(400, 5)).round(2)
    m[50:200] = m[7]  # ties that the key decides
    m[200:260] = 0
    rows = spark.createDataFrame([(i - 5, v.tolist()) for i, v in enumerate(m)], "k long, v array<double>")
    queries, written, keep = rows.where("k % 20 = 0"), [], vectors.checkpointed
    monkeypatch.setattr(vectors, "checkpointed", lambda df: written.append(keep(df)) or written[-1])
    got = sorted(map(tuple, vectors.nearest_share(queries, rows, "k", "v", 0.3).collect()))
    all_ = vectors.similarities(queries, rows, "k", "v")
    assert got == sorted((r["query"], r["k"]) for r in vectors.keep_share(all_, ["query"], "similarity", "k", 0.3).collect()) and len(got) == 20 * 120
    assert max(x.count() for x in written) < all_.count() / 4
    assert vectors.nearest_share(queries.limit(0), rows, "k", "v", 0.3).count() == 0


def test_places_in_large_groups(spark):
    """Groups that go through many partitions, null ones too."""
    rows = spark.range(0, 1000, 1, 7).select("id", F.when(F.col("id") % 10 < 7, "hot").when(F.col("id") % 10 < 9, F.col("id").cast("string")).alias("g"))
    got = ranks.ranked_in(rows, ["g"], [F.col("id").desc()], "place").collect()
    by: dict = {}
    for r in got:
        by.setdefault(r.g, []).append((r.place, r.id))
    assert len(got) == 1000
    assert all([i for _, i in sorted(v)] == sorted((i for _, i in v), reverse=True) and [p for p, _ in sorted(v)] == list(range(1, len(v) + 1)) for v in by.values())


def test_pagerank_ends_at_its_tolerance(spark):
    edges = spark.createDataFrame([("a", "b"), ("b", "c"), ("c", "a"), ("d", "a"), ("d", "d")], "src string, dst string")
    nodes = spark.createDataFrame([(x,) for x in "abcde"], "node string")
    got = {r.node: r["rank"] for r in citations.pagerank(edges, nodes, tolerance=1e-9).collect()}
    m = np.zeros((5, 5))
    for a, b in ("ab", "bc", "ca", "da"):
        m["abcde".index(b), "abcde".index(a)] = 1
    r = np.full(5, 0.2)
    for _ in range(300):
        r = 0.15 / 5 + 0.85 * (m @ r + r[4] / 5)
    assert all(got[x] == pytest.approx(r[i], abs=1e-6) for i, x in enumerate("abcde"))


def test_boosted_ranker_orders_by_gain(spark):
    rows = spark.createDataFrame([(float(i % 10), float(i % 3), float(i % 10 > 6)) for i in range(200)], "a double, b double, label double")
    out = ranking.boosted_ranker(rows, ["a", "b"], "label", rounds=3, depth=2).transform(rows)
    assert out.where("label = 1").agg(F.min("rank")).first()[0] > out.where("label = 0").agg(F.max("rank")).first()[0]


def test_lines_are_numbered_over_splits(spark, tmp_path):
    with open(f"{tmp_path}/lines.json", "w") as f:
        f.write("\n".join("" if i % 50 == 7 else '{"x": %d}' % i for i in range(20_000)))
    spark.conf.set("spark.sql.files.maxPartitionBytes", "20000")
    try:
        got = files.numbered_lines(spark, str(tmp_path), "x long", 100).collect()
    finally:
        spark.conf.unset("spark.sql.files.maxPartitionBytes")
    assert sorted(r["index"] for r in got) == [i for i in range(100, 20_000) if i % 50 != 7] and all(r["index"] == r.x for r in got)


def test_pool_grows_until_nothing_is_new(spark):
    edges = spark.createDataFrame([(i, i + 1) for i in range(6)], "src long, dst long")
    seeds = spark.createDataFrame([(0,)], "node long")
    assert {(r.node, r.round) for r in citations.grown(edges, seeds, 4).collect()} == {(0, 0), (1, 1), (2, 2), (3, 3)}
    assert citations.grown(edges, seeds, 100).count() == 7


TEI = """<TEI xmlns="http://www.tei-c.org/ns/1.0"><text><front><abstract><div><p>We look at it. It works.</p></div></abstract></front>
<body><div><head n="1">Introduction</head><p>Nets are deep <ref type="bibr" target="#b0">[1]</ref>. They learn.</p></div>
<div><head n="1.1">Scope</head><p>Small.</p></div><div><head>Open problems</head><p>Many.</p></div></body>
<back><listBibl><biblStruct xml:id="b0"><analytic><title>Deep Nets</title></analytic></biblStruct></listBibl></back></text></TEI>"""


def test_tei():
    rows = parsers.tei(TEI)
    assert [(r[1], r[5], r[6]) for r in rows][:4] == [("0", "We look at it.", []), ("0", "It works.", []), ("1", "Nets are deep [1].", ["Deep Nets"]), ("1", "They learn.", [])]
    assert [r[1] for r in parsers.tei_headings(TEI)] == ["0", "1", "1.1", "2"]
    assert parsers.tei("<broken") == []


def test_latex_and_bibliographies():
    tex = r"""\documentclass{a}\begin{document}\title{On \textbf{Nets}}% note
\section{Intro} Nets are deep~\cite{a, b}. They learn.

Next one e.g. This holds. \subsection{Scope} Small \citep[see][]{c}.
\begin{figure}\includegraphics{x}\cite{d}\end{figure}
After. \section{End} Done.\end{document}"""
    rows = parsers.latex(tex)
    assert parsers.argument(tex, "title") == "On Nets" and parsers.is_main_file(tex)
    assert [(r[1], r[6]) for r in rows if r[6]] == [("1", ["a", "b"]), ("1.1", ["c"]), ("1.1", ["d"])]
    assert [r[1] for r in rows if r[5] == "Done."] == ["2"]
    assert parsers.with_inputs("m.tex", {"m.tex": r"a \input{x} b", "x.tex": r"X \input{m}"}) == "a X  b"
    assert parsers.bibtex("@article{k, title={A {B} c}, author=\"X and Y\", year=2020}\n@book{k, title={Z}}") == [("k", "article", "A B c", "X and Y", "2020")]
    assert parsers.compiled_bibliography(r"\bibitem[A(1)]{k} A. \newblock Title. \bibitem{l} B\end{thebibliography}") == [("k", "A. Title."), ("l", "B")]
    assert parsers.compiled_bibliography(r"\entry{k}{article}\field{title}{T t}\endentry") == [("k", "T t")]
    assert parsers.renumbered([("1", "a"), ("1.1", "b"), (None, "c"), ("1.1", "d"), ("3.1.2", "e")]) == [[1], [1, 1], [1, 2], [1, 3], [3, 1, 2]]
    assert parsers.ascii_letters("Müller-Straße 5") == "mullerstrasse5"


def test_html_and_json():
    assert parsers.html_main("<title>T &amp; x</title><nav>no</nav><p>One <b>two</b></p><script>z</script><div class='ad'>ad</div><p>Three</p>") == ("T & x", "One two\nThree")
    assert parsers.any_text({"a": {"value": "x"}, "b": ["y", {"c": None}]}) == "x\ny"


def test_evidence():
    source = "the quick brown fox jumps over the lazy dog " * 3
    assert evidence.verify_quote(["quick brown fox jumps over"], source) == (True, 1.0)
    assert evidence.verify_quote(["quick fox"], source) == (False, 0.0)
    assert evidence.verify_quote(["quick brown fox jumps over", "nothing of this is anywhere to be found"], source)[1] == pytest.approx(0.85)
    assert evidence.chunks(["a"] * 7) == ["\n\n".join("a" * 5), "a\n\na"] and len(evidence.chunks(["x" * 20_000, "y"])) == 2


def test_discussion_sections(spark):
    rows = [("d", [1], "Intro"), ("d", [2], "Future work"), ("d", [2, 1], "Challenges"), ("d", [3], "X"), ("d", [3, 1], "Limitations")]
    got = evidence.discussion_sections(spark.createDataFrame(rows, "doc_id string, path array<int>, title string")).collect()
    assert sorted((tuple(r.path), r.depth) for r in got) == [((2,), 1), ((3, 1), 2)]


def test_sources(spark, tmp_path):
    records = [{"id": f"W{i}", "title": f"t{i}", "cited_by_count": i, "referenced_works": []} for i in range(450)]
    df = works.in_memory(spark, records)
    assert df.count() == 450 and df.where("cited_by_count >= 440").count() == 10
    files.write_lines(spark.range(5), f"{tmp_path}/x")
    with open(f"{tmp_path}/bad.json", "w") as f:
        f.write('{"id": 1}\n\nnot json\n{"id": 2}\n')
    assert files.json_lines(spark, f"{tmp_path}/bad.json", "id long", strict=False).count() == 2
    with pytest.raises(Exception, match="(?i)malformed"):
        files.json_lines(spark, f"{tmp_path}/bad.json", "id long").collect()
    assert files.pending(spark.range(5), spark.range(2), ["id"]).count() == 3
    steps = [("a", spark.createDataFrame([(1, "x")], "k long, v string")), ("b", spark.createDataFrame([(1, "y"), (2, "z")], "k long, v string"))]
    got = {r.k: (r.v, r.step) for r in works.cascade(spark.range(3).withColumnRenamed("id", "k"), "k", steps, "v").collect()}
    assert got == {0: (None, None), 1: ("x", "a"), 2: ("z", "b")}


def test_completion(spark):
    df = spark.createDataFrame([(1, "a\nb"), (2, None)], "k long, p string")
    got = {r.k: r.answer for r in completion.completed(df, "k", "p", completion.EchoCompleter()).collect()}
    assert got == {1: '{"topic_name": "a"}', 2: None}
    v = completion.embedded(df, "k", "p", completion.HashEmbedder(16)).collect()
    assert len(v) == 2 and len(v[0].embedding) == 16
    assert completion.picked("2, 9", 3) == [1] and completion.picked("", 5) == [0, 1, 2]
    assert completion.spans("[[1, 2]]", ["a", "b", "c"]) == ["a b"] and completion.first_conclusive([("NEUTRAL", 0.9), ("REFUTED", 0.1)]) == 1


def test_words_that_cancel_have_a_vector():
    """Two words in one place with opposite signs: the text still has words, so its vector has length 1."""
    e = completion.HashEmbedder(1)
    signs = {w: e.embed([w])[0, 0] for w in "abcdefgh"}
    up, down = (next(w for w in signs if signs[w] == s) for s in (1, -1))
    assert np.linalg.norm(e.embed([f"{up} {down}", f"{down} {up} {up}", "...", ""]), axis=1).tolist() == [1, 1, 0, 0]


def test_answers_name_places_that_are_not_there(spark, tmp_path):
    """However many candidates there are, a place beyond them is never picked."""
    rows = [(i, f"s{i}", i % 4, 0.0) for i in range(520)] + [(520, "s", 5, 0.0), (521, "s", 6, 0.0)]
    spark.createDataFrame(rows, "s_suppkey long, s_name string, s_nationkey int, s_acctbal double").write.parquet(f"{tmp_path}/supplier.parquet")
    got: dict = {}
    for r in catalog.queries()["filtered_candidates"](spark, str(tmp_path)).collect():
        got.setdefault(r.s_nationkey, []).append(r.place)
    assert got == {0: [2, 1], 1: [1, 2, 3], 2: [1, 2, 3], 3: [2, 1], 5: [1], 6: [1]}


def test_copies_of_names_meet_once(spark, tmp_path, monkeypatch):
    """Names meet as classes, copies in packs; names of no, one or two letters too."""
    monkeypatch.setattr(plan_ranking, "PACK", 8)
    names = ["blue ring", "blue rings", "Blue-Ring", "old plate", "a", "b", "ab", "", "-", None, "a very long name of a part", "a very lung name of b part"]
    rows = [(i, names[i // 20 % len(names)] if i % 20 < 10 else names[0]) for i in range(600)]
    spark.createDataFrame(rows, "p_partkey long, p_name string").write.parquet(f"{tmp_path}/part.parquet")
    db = duckdb.connect()
    db.execute(f"CREATE VIEW part AS SELECT * FROM '{tmp_path}/part.parquet/*.parquet'")
    df = catalog.queries()["edit_distance_match"](spark, str(tmp_path))
    assert sorted(map(tuple, df.collect())) == sorted(db.execute(catalog.oracle_sql()["edit_distance_match"]).fetchall())


def test_stream_equals_batch(spark, tmp_path):
    events = spark.createDataFrame([(i, "k", float(i)) for i in range(40)], "event_id long, event_type string, value double").withColumn("ts", F.timestamp_seconds(F.lit(1_700_000_000) + F.col("event_id") * 7200))
    events.write.parquet(f"{tmp_path}/in")
    stream = windows.windowed_counts(windows.file_stream(spark, f"{tmp_path}/in", events.schema))
    windows.to_parquet(stream, f"{tmp_path}/out", f"{tmp_path}/ck").awaitTermination(60)
    done = spark.read.parquet(f"{tmp_path}/out")
    batch = windows.windowed_counts(events)
    closed = done.select("start").distinct()
    assert done.count() > 0 and batch.join(closed, "start", "left_semi").exceptAll(done).count() == 0
