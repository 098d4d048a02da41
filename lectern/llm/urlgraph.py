"""URL filters by rules and, where no rule fits, by trust and distrust over the host graph.

DataFrame functions only. Hosts are joined by the links that their pages hold: absolute urls anywhere in the page, and
those of attributes; a relative link leads to the page's own host and keeps the walk there. Trust is personalised
PageRank from the pages that rules allow; distrust is the same over reversed edges from the pages that rules block, as
what links to bad hosts is suspect. A host is blocked where its distrust exceeds ``RATIO`` times its trust.

With ``ties``, each subdomain and its parent domain point at one another besides (a domain of one label is nobody's
parent); this is off by default.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lectern.session import checkpointed

Rule = tuple[str, str]
DAMPING = 0.85
RATIO = 1.0
#: The walk ends when _CUT rounds add less than this to all ranks together, which sum to 1 for each side at most.
TOLERANCE, MOST_ROUNDS = 1e-7, 250
#: Rounds between two writes to the checkpoint folder.
_CUT = 5
#: Hosts to block that are sent to all tasks; more are joined by a shuffle.
MOST_SENT = 100_000
_URL = r"(?s)^.*?://([^/?#]*)([^?#]*)"
_ABSOLUTE = r"""(?i)\bhttps?://([^/?#"'\s<>]+)"""
_VALUE = r"""(?i)\b(?:href|src|action)\s*=\s*["']?([^"'\s>]+)"""
# values that are no relative links: with a scheme, without a host's scheme, inside the page
_ELSEWHERE = r"(?i)^(?:[a-z][a-z0-9+.-]*:|//|#)"
_SAME_SCHEME = r"^//([^/?#]+)"
_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"

# Fixed values: (verdict, host and path); a rule holds for its host and all subdomains.
RULES: tuple[Rule, ...] = (
    ("allow", "org/"),
    ("block", "example.org/es/"),
    ("block", "example.org/en/1"),
    ("allow", "com/fr/"),
    ("block", "com/de/"),
)


def _split(rule: str) -> tuple[str, str]:
    host, slash, path = rule.partition("/")
    return host, slash + path


def _longest_first(rules: Sequence[Rule]) -> list[Rule]:
    return sorted(rules, key=lambda r: (-len(r[1]), r[1]))


def parsed(url: Column) -> tuple[Column, Column]:
    """Host (A-Z lower-cased) and path of a url; of one without ``://``, or null, both empty."""
    got = [F.coalesce(F.regexp_extract(url, _URL, i), F.lit("")) for i in (1, 2)]
    return F.translate(got[0], _UPPER, _LOWER), got[1]


def matching(host: Column, path: Column, rules: Sequence[Rule]) -> tuple[Column, Column]:
    """The longest fitting rule and its verdict, null where none fits."""
    name, verdict = F.lit(None).cast("string"), F.lit(None).cast("string")
    for kind, rule in reversed(_longest_first(rules)):
        h, p = _split(rule)
        fits = ((host == h) | F.endswith(host, F.lit("." + h))) & F.startswith(path, F.lit(p))
        name, verdict = F.when(fits, F.lit(rule)).otherwise(name), F.when(fits, F.lit(kind)).otherwise(verdict)
    return name, verdict


def host_links(host: Column, html: Column) -> Column:
    """The hosts that a page's links lead to, one entry for each link; relative links lead to its own."""
    lower = lambda x: F.translate(x, _UPPER, _LOWER)
    values = F.coalesce(F.regexp_extract_all(html, F.lit(_VALUE), F.lit(1)), F.array().cast("array<string>"))
    absolute = F.transform(F.coalesce(F.regexp_extract_all(html, F.lit(_ABSOLUTE), F.lit(1)), F.array().cast("array<string>")), lower)
    schemeless = F.transform(F.filter(values, lambda v: v.rlike(_SAME_SCHEME)), lambda v: lower(F.regexp_extract(v, _SAME_SCHEME, 1)))
    relative = F.transform(F.filter(values, lambda v: ~v.rlike(_ELSEWHERE)), lambda v: host)
    return F.concat(absolute, schemeless, relative)


def host_edges(pages: DataFrame, hosts: DataFrame, ties: bool = False) -> DataFrame:
    """(src, dst, weight): links between hosts and inside them, counted; with ``ties``, family ties of weight 1. pages: host, html."""
    links = pages.where("host <> ''").select(F.col("host").alias("src"), F.explode(host_links(F.col("host"), F.col("html"))).alias("dst"))
    links = links.groupBy("src", "dst").agg(F.count("*").cast("double").alias("weight"))
    if not ties:
        return links
    known = hosts.select("host").union(links.select("dst")).distinct()
    parts = known.select(F.split("host", r"\.").alias("p")).where(F.size("p") > 2)
    step = F.explode(F.expr("sequence(1, size(p) - 2)"))
    family = parts.select("p", step.alias("i")).select(F.expr("array_join(slice(p, i, size(p)), '.')").alias("a"), F.expr("array_join(slice(p, i + 1, size(p)), '.')").alias("b")).distinct()
    both = family.select(F.col("a").alias("src"), F.col("b").alias("dst")).union(family.select("b", "a")).withColumn("weight", F.lit(1.0))
    return links.union(both).groupBy("src", "dst").agg(F.sum("weight").alias("weight"))


def _anew(df: DataFrame, key: str) -> DataFrame:
    """``df`` with a text key that Spark takes for another one, so that a join deals both its sides out and can split them."""
    return df.withColumn(key, F.reverse(F.reverse(key)))


def ranks(edges: DataFrame, seeds: DataFrame, damping: float = DAMPING, tolerance: float = TOLERANCE, most_rounds: int = MOST_ROUNDS) -> DataFrame:
    """(side, node, rank): for each side the chance that a walk from its seeds ends at the node.

    edges: side, src, dst, weight; seeds: side, node, share. A walk goes on with probability ``damping``, by an edge
    chosen by weight; where no edge leads on it is lost. A node's stays with itself are summed in closed form. Ranks
    only grow from round to round; the rounds end when they hardly do, or after ``most_rounds``. A node may have any
    number of edges: the joins come from exchanges that Spark can split.
    """
    out = edges.groupBy("side", "src").agg(F.sum("weight").alias("total"), F.sum(F.when(F.col("src") == F.col("dst"), F.col("weight")).otherwise(0.0)).alias("own"))
    held = out.select("side", F.col("src").alias("node"), (1 / (1 - F.col("own") / F.col("total") * damping)).alias("stay"))
    moves = edges.where("src <> dst").join(_anew(out, "src"), ["side", "src"])
    moves = moves.select("side", F.col("src").alias("node"), "dst", (F.col("weight") / F.col("total") * damping).alias("chance"))
    # what arrives at a node is worth all its stays there
    moves = moves.join(held.select("side", F.col("node").alias("dst"), "stay"), ["side", "dst"], "left")
    moves = checkpointed(moves.select("side", "node", "dst", (F.col("chance") * F.coalesce("stay", F.lit(1.0))).alias("chance")))
    start = seeds.join(held, ["side", "node"], "left").select("side", "node", (F.col("share") * (1 - damping) * F.coalesce("stay", F.lit(1.0))).alias("rank"))
    now = start = checkpointed(start)
    total = now.agg(F.sum("rank")).first()[0] or 0.0
    for _ in range(0, most_rounds, _CUT):
        for _ in range(_CUT):
            walked = _anew(now, "node").join(_anew(moves, "node"), ["side", "node"]).select("side", F.col("dst").alias("node"), (F.col("rank") * F.col("chance")).alias("rank"))
            now = walked.union(start).groupBy("side", "node").agg(F.sum("rank").alias("rank"))
        now = checkpointed(now)
        before, total = total, now.agg(F.sum("rank")).first()[0] or 0.0
        if total - before < tolerance:
            break
    return now


def judge(pages: DataFrame, rules: Sequence[Rule] = RULES, ratio: float = RATIO, ties: bool = False) -> DataFrame:
    """For each row of ``pages`` (page_id, url, html): page_id, host, path, rule, verdict.

    ``rule`` is the longest rule that fits, else null; ``verdict`` is the rule's, else the host's: block where its
    distrust exceeds ``ratio`` times its trust, else allow, so hosts that neither reaches are allowed. Null urls and
    urls without ``://`` have an empty host, which no edge reaches. Null html has no links; very long urls and pages
    are read whole. Repeated rows count each; hosts that tie in trust and distrust are allowed at a ratio of 1. An
    empty table gives an empty one; other columns aren't read. The rules are a short list held in the plan. A host may
    hold any share of the pages: pages aren't shuffled, but for a join when more than ``MOST_SENT`` hosts are blocked,
    which Spark can split.
    """
    host, path = parsed(F.col("url"))
    read = pages.select("page_id", host.alias("host"), path.alias("path"), "html")
    name, kind = matching(F.col("host"), F.col("path"), rules)
    ruled = read.withColumn("rule", name).withColumn("kind", kind)
    counts = checkpointed(ruled.where("host <> ''").groupBy("host").agg(F.count_if(F.col("kind") == "allow").alias("allowed"), F.count_if(F.col("kind") == "block").alias("blocked")))
    edges = checkpointed(host_edges(read, counts, ties))
    both = edges.withColumn("side", F.lit("trust")).union(edges.select(F.col("dst").alias("src"), F.col("src").alias("dst"), "weight", F.lit("distrust").alias("side"))).select("side", "src", "dst", "weight")
    total = counts.agg(F.sum("allowed"), F.sum("blocked")).first()
    sides = [counts.where(f"{c} > 0").select(F.lit(s).alias("side"), F.col("host").alias("node"), (F.col(c) / F.lit(float(t or 1))).alias("share")) for s, c, t in (("trust", "allowed", total[0]), ("distrust", "blocked", total[1]))]
    got = ranks(both, sides[0].union(sides[1]))
    weighed = got.groupBy(F.col("node").alias("host")).agg(*[F.round(F.sum(F.when(F.col("side") == s, F.col("rank")).otherwise(0.0)), 9).alias(s) for s in ("trust", "distrust")])
    bad = checkpointed(weighed.where(F.col("distrust") > ratio * F.col("trust")).select("host", F.lit("block").alias("graph")))
    bad = F.broadcast(bad) if bad.count() <= MOST_SENT else _anew(bad, "host")
    out = ruled.drop("html").join(bad, "host", "left")
    return out.select("page_id", "host", "path", "rule", F.coalesce("kind", "graph", F.lit("allow")).alias("verdict"))


def judge_sql(rules: Sequence[Rule] = RULES, ratio: float = RATIO, rounds: int = 60) -> str:
    """DuckDB SQL for :func:`judge` over pages, with a fixed number of rounds."""

    def case(pick) -> str:
        whens = []
        for kind, rule in _longest_first(rules):
            h, p = _split(rule)
            whens.append(f"WHEN (host = '{h}' OR ends_with(host, '.{h}')) AND starts_with(path, '{p}') THEN '{pick(kind, rule)}'")
        return "CASE " + " ".join(whens) + " END"

    quoted = lambda x: "'" + x.replace("'", "''") + "'"
    lower = f"'{_UPPER}', '{_LOWER}'"
    steps = ["r0 AS (SELECT * FROM start)"]
    for k in range(1, rounds + 1):
        steps.append(
            f"r{k} AS MATERIALIZED (SELECT side, node, sum(rank) AS rank FROM (SELECT m.side, m.dst AS node, r.rank * m.chance AS rank FROM r{k - 1} r JOIN moves m ON r.side = m.side AND r.node = m.src UNION ALL SELECT * FROM start) GROUP BY side, node)"
        )
    return f"""
WITH p AS (SELECT page_id, translate(coalesce(regexp_extract(url, '{_URL}', 1), ''), {lower}) AS host, coalesce(regexp_extract(url, '{_URL}', 2), '') AS path, html FROM pages),
ruled AS (SELECT *, {case(lambda k, r: r)} AS rule, {case(lambda k, r: k)} AS kind FROM p),
counts AS (SELECT host, count(*) FILTER (kind = 'allow') AS allowed, count(*) FILTER (kind = 'block') AS blocked FROM ruled WHERE host <> '' GROUP BY host),
attributes AS (SELECT host, unnest(regexp_extract_all(html, {quoted(_VALUE)}, 1)) AS v FROM p WHERE host <> ''),
found AS (SELECT host AS src, translate(unnest(regexp_extract_all(html, {quoted(_ABSOLUTE)}, 1)), {lower}) AS dst FROM p WHERE host <> ''
  UNION ALL SELECT host, translate(regexp_extract(v, {quoted(_SAME_SCHEME)}, 1), {lower}) FROM attributes WHERE regexp_matches(v, {quoted(_SAME_SCHEME)})
  UNION ALL SELECT host, host FROM attributes WHERE NOT regexp_matches(v, {quoted(_ELSEWHERE)})),
edges AS (SELECT src, dst, count(*)::DOUBLE AS weight FROM found GROUP BY src, dst),
sided AS (SELECT 'trust' AS side, src, dst, weight FROM edges UNION ALL SELECT 'distrust', dst, src, weight FROM edges),
shares AS MATERIALIZED (SELECT side, src, dst, weight / sum(weight) OVER (PARTITION BY side, src) * {DAMPING}::DOUBLE AS chance FROM sided),
stays AS MATERIALIZED (SELECT side, src AS node, 1 / (1 - chance) AS stay FROM shares WHERE src = dst),
moves AS MATERIALIZED (SELECT m.side, m.src, m.dst, m.chance * coalesce(s.stay, 1) AS chance FROM shares m LEFT JOIN stays s ON s.side = m.side AND s.node = m.dst WHERE m.src <> m.dst),
seeds AS (SELECT 'trust' AS side, host AS node, allowed / (SELECT sum(allowed) FROM counts)::DOUBLE * (1 - {DAMPING}::DOUBLE) AS rank FROM counts WHERE allowed > 0
  UNION ALL SELECT 'distrust', host, blocked / (SELECT sum(blocked) FROM counts)::DOUBLE * (1 - {DAMPING}::DOUBLE) FROM counts WHERE blocked > 0),
start AS MATERIALIZED (SELECT e.side, e.node, e.rank * coalesce(s.stay, 1) AS rank FROM seeds e LEFT JOIN stays s ON s.side = e.side AND s.node = e.node),
{", ".join(steps)},
weighed AS (SELECT node AS host, round(coalesce(sum(rank) FILTER (side = 'trust'), 0), 9) AS trust, round(coalesce(sum(rank) FILTER (side = 'distrust'), 0), 9) AS distrust FROM r{rounds} GROUP BY node)
SELECT page_id, ruled.host, path, rule, coalesce(kind, CASE WHEN distrust > {ratio} * trust THEN 'block' END, 'allow') AS verdict FROM ruled LEFT JOIN weighed ON ruled.host = weighed.host
"""
