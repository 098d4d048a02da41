"""Near-duplicates by an LSH forest over MinHash signatures, confirmed on full shingle sets.

Each document's set holds its distinct runs of five words. Texts with equal sets become one class first. Each class
has ``TREES`` signature orders of ``DEPTH`` MinHash values. All classes are sorted in every order (one range sort);
a class's neighbours there share the longest prefixes with it. A region is a run of classes that share a prefix of
``LEAST`` values. In a small region all its members become candidates of one another. A larger region is looked at
deeper, one value more at a time, until its parts are small; as long as they aren't, their members become candidates of
their next neighbours. Members of a region that is large at ``LEAST`` or at ``DEPTH`` values also become candidates of
its hub, the member that stands in the fullest leaves over all orders.
Hubs link most of a large group of copies of one text with a number of candidates that grows with its size, not with
its square. What they leave open is made up in full: where the members of a large region of ``LEAST`` values are
still in several components, all its pairs across components are compared, signatures first, in cells of a bounded
size. So two classes that share such a prefix in any order are compared, or are in one component without.

A hub may have any number of candidates: to be confirmed, its text goes once to each of up to ``SALTS`` shares of them.
In the join of pairs with signatures the pairs of a hub are one key.

Candidates whose signatures agree too little are left out (over four standard deviations under the threshold), the
others are confirmed or refused on their full sets. Only the lowest byte of each value is sent for that: values that
agree, agree there too, and one in 256 of the others. Links make components by star rounds in Spark.

Of two linked texts that stand alone at a similarity of 0.85, a share of (1 - 0.85**3)**16 is missed: under one in a
million.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from lectern.llm.names import renamed
from lectern.llm.text_arrays import chunks, mix64, shingles, utf8, word_hashes
from lectern.operators.graph import connected_components
from lectern.session import checkpointed

WORDS = 5
TREES, LEAST, DEPTH = 16, 3, 8
#: Members of a region that are all compared with one another.
SMALL = 5
#: Rows of one region that a task keeps while it reads on.
MOST_HELD = 200_000
#: Shares that a class's candidates are dealt into to be confirmed.
SALTS = 16
#: Members on either side of a cell, the part of a large region that is compared at a time.
CELL = 512
_WIDTH = 4 * DEPTH
_RANDOM = np.random.Generator(np.random.PCG64(77)).integers(1, 1 << 63, (2, TREES * DEPTH), dtype=np.uint64)
_TIMES, _PLUS = _RANDOM[0] * np.uint64(2) + np.uint64(1), _RANDOM[1]


def shingle_sets(column: pa.Array) -> Iterator[np.ndarray]:
    """Each text's sorted distinct shingle hashes."""
    data, offsets = utf8(column)
    for a, b in chunks(offsets):
        words, at = word_hashes(data[offsets[a] : offsets[b]], offsets[a : b + 1] - offsets[a])
        for i in range(b - a):
            yield np.unique(shingles(words[at[i] : at[i + 1]], WORDS))


def _signed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for f in batches:
        sets = list(shingle_sets(f.column("text")))
        sizes = np.array([len(s) for s in sets], np.int64)
        signature = np.zeros((len(sets), TREES * DEPTH), np.uint32)
        full = np.flatnonzero(sizes)
        step = 256
        for k in range(0, len(full), step):
            part = full[k : k + step]
            joined = np.concatenate([sets[i] for i in part])
            begin = np.concatenate([[0], np.cumsum(sizes[part])[:-1]])
            for j in range(TREES * DEPTH):
                signature[part, j] = np.minimum.reduceat((joined * _TIMES[j] + _PLUS[j]) >> np.uint64(32), begin)
        nodes = [_node(s) for s in sets]
        rows = signature.astype(">u4")
        yield pa.RecordBatch.from_arrays(
            [f.column("doc_id"), pa.array(sizes), pa.array(nodes, pa.int64()), pa.array([r.tobytes() if n else None for r, n in zip(rows, sizes, strict=True)], pa.binary())],
            ["doc_id", "n_shingles", "node", "signature"],
        )


def _node(shingle_set: np.ndarray) -> int | None:
    """A number for the set, the same for equal sets; none for the empty set."""
    return int.from_bytes(hashlib.blake2b(shingle_set.tobytes(), digest_size=8).digest(), "big", signed=True) if len(shingle_set) else None


def _common(keys: np.ndarray, w: int) -> np.ndarray:
    """How many values at the front row i shares with row i + w; 0 across orders. keys: one byte of order, then values."""
    same = keys[w:] == keys[:-w]
    values = same[:, 1:].reshape(len(same), DEPTH, 4).all(2)
    return np.where(same[:, 0], np.logical_and.accumulate(values, 1).sum(1), 0)


def _neighbours(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """From classes in sorted order: (region, level null, a, b) for candidates; (region, level, a, leaf size) for members of large regions."""
    held_keys, held_ids = np.zeros((0, 1 + _WIDTH), np.uint8), np.zeros(0, np.int64)
    opens = True

    def find(keys: np.ndarray, ids: np.ndarray, opens: bool, closes: bool) -> pa.RecordBatch:
        n = len(ids)
        shared = np.concatenate([[0], _common(keys, 1), [0]]) if n else np.zeros(2, int)
        leaf = np.ones(n)
        pairs: list[tuple[np.ndarray, np.ndarray]] = []
        members: list[tuple[np.ndarray, np.ndarray, int]] = []
        live = np.ones(n, bool)  # in a region that is large on all levels above
        for level in range(LEAST, DEPTH + 1):
            edge = np.flatnonzero(shared[:n] < level)
            run = np.repeat(np.arange(len(edge)), np.diff([*edge, n]))
            size = np.bincount(run, minlength=len(edge))
            cut = np.zeros(len(edge), bool)  # it may go on in the next partition or the one before
            if len(edge):
                cut[0] |= opens
                cut[-1] |= closes
            large = ((size > SMALL) | cut)[run] & live
            small = ((size > 1) & (size <= SMALL))[run] & live
            if level == DEPTH:
                leaf = size[run].astype(float)
            for w in range(1, SMALL):
                i = np.flatnonzero(small[: n - w] & (run[: n - w] == run[w:])) if n > w else np.zeros(0, int)
                pairs.append((ids[i], ids[i + w]))
            i = np.flatnonzero(large[: n - 1] & (run[: n - 1] == run[1:])) if n > 1 else np.zeros(0, int)
            pairs.append((ids[i], ids[i + 1]))
            i = np.flatnonzero(large)
            if len(i) and level in (LEAST, DEPTH):
                prefix = keys[i, : 1 + 4 * level].astype(np.uint64)
                region = np.full(len(i), np.uint64(level))
                for c in range(prefix.shape[1]):
                    region = (region ^ prefix[:, c]) * np.uint64(0x9E3779B97F4A7C15)
                    region ^= region >> np.uint64(29)
                members.append((mix64(region).astype(np.int64), i, level))
            live = large
        a, b = (np.concatenate([p[k] for p in pairs]) for k in (0, 1)) if pairs else (np.zeros(0, np.int64),) * 2
        low, high = np.minimum(a, b), np.maximum(a, b)
        if len(low):
            low, high = np.unique(np.stack([low, high]), axis=1)
        region = np.concatenate([m[0] for m in members]) if members else np.zeros(0, np.int64)
        who = np.concatenate([m[1] for m in members]) if members else np.zeros(0, np.int64)
        level = np.concatenate([np.full(len(m[1]), m[2], np.int32) for m in members]) if members else np.zeros(0, np.int32)
        return pa.RecordBatch.from_arrays(
            [pa.concat_arrays([pa.nulls(len(low), pa.int64()), pa.array(region)]), pa.concat_arrays([pa.nulls(len(low), pa.int32()), pa.array(level)]), pa.array(np.concatenate([low, ids[who]])), pa.array(np.concatenate([high, leaf[who].astype(np.int64)]))],
            ["region", "level", "a", "b"],
        )

    for f in batches:
        if not f.num_rows:
            continue
        keys = np.frombuffer(b"".join(f.column("place").to_pylist()), np.uint8).reshape(f.num_rows, 1 + _WIDTH)
        keys, ids = np.concatenate([held_keys, keys]), np.concatenate([held_ids, f.column("id").to_numpy()])
        # the last region waits for rows that may belong to it; a very large one is cut, its parts meet at the hub
        change = np.flatnonzero(_common(keys, 1) < LEAST) if len(ids) > 1 else np.zeros(0, int)
        cut = change[-1] + 1 if len(change) else 0
        forced = len(ids) - cut > MOST_HELD
        if forced:
            cut = len(ids)
        if cut:
            yield find(keys[:cut], ids[:cut], opens, forced)
            opens = forced
        held_keys, held_ids = keys[cut:], ids[cut:]
    if len(held_ids):
        yield find(held_keys, held_ids, opens, True)


def _sketched(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for f in batches:
        low = np.frombuffer(b"".join(f.column("signature").to_pylist()), np.uint8).reshape(f.num_rows, -1)[:, 3::4]
        yield pa.RecordBatch.from_arrays([f.column("node"), pa.array([r.tobytes() for r in low], pa.binary())], ["node", "sketch"])


def _agreeing(least: float):
    def keep(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for f in batches:
            if not f.num_rows:
                continue
            x, y = (np.frombuffer(b"".join(f.column(c).to_pylist()), np.uint8).reshape(f.num_rows, -1) for c in ("sig_a", "sig_b"))
            yield f.select(["a", "b"]).filter(pa.array((x == y).mean(1) >= least))

    return keep


def _confirmed(percent: int):
    """From rows (a, share, node, text), in each share a's own first: the links of a."""

    def keep(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        of, first = None, np.zeros(0, np.uint64)
        for f in batches:
            a, b, good = f.column("a").to_pylist(), f.column("node").to_pylist(), []
            for p, q, own in zip(a, b, shingle_sets(f.column("text")), strict=True):
                if p == q:
                    of, first = p, own
                assert p == of, "a's own text comes first"
                both = len(np.intersect1d(first, own, assume_unique=True))
                good.append(p != q and 100 * both >= percent * (len(first) + len(own) - both))
            yield pa.RecordBatch.from_arrays([pa.array(a, pa.int64()), pa.array(b, pa.int64())], ["a", "b"]).filter(pa.array(good, pa.bool_()))

    return keep


def _noded(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for f in batches:
        nodes = [_node(s) for s in shingle_sets(f.column("text"))]
        yield pa.RecordBatch.from_arrays([pa.array(nodes, pa.int64()), f.column("text")], ["node", "text"])


def signatures(docs: DataFrame) -> DataFrame:
    """doc_id, n_shingles long, node long (equal for equal sets; null: no words), signature binary."""
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(_signed, "doc_id long, n_shingles long, node long, signature binary")


def classes(signed: DataFrame) -> DataFrame:
    """Classes of equal sets: node, doc_id (the smallest; null if all are), signature."""
    first = F.struct(F.col("doc_id").isNull().alias("none"), F.col("doc_id"), F.col("signature"))
    got = signed.where("node IS NOT NULL").groupBy("node").agg(F.min(first).alias("m"))
    return got.select("node", F.col("m.doc_id").alias("doc_id"), F.col("m.signature").alias("signature"))


def _least(percent: int) -> float:
    """The share of signature values in which a pair has to agree."""
    share = percent / 100
    return share - 4 * (share * (1 - share) / (TREES * DEPTH)) ** 0.5


def sketches(nodes: DataFrame) -> DataFrame:
    """(node, sketch binary): the lowest byte of each signature value."""
    return nodes.where("signature IS NOT NULL").select("node", "signature").mapInArrow(_sketched, "node long, sketch binary")


def regions(nodes: DataFrame) -> DataFrame:
    """What :func:`_neighbours` finds: candidates, and members of large regions."""
    n = int(nodes.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    tree = F.explode(F.sequence(F.lit(0), F.lit(TREES - 1)))
    place = F.expr(f"concat(unhex(lpad(hex(tree), 2, '0')), substring(signature, 1 + {_WIDTH} * tree, {_WIDTH}))")
    placed = nodes.select(F.col("node").alias("id"), "signature", tree.alias("tree")).select("id", place.alias("place"))
    ordered = placed.repartitionByRange(n, "place", "id").sortWithinPartitions("place", "id")
    return checkpointed(ordered.mapInArrow(_neighbours, "region long, level int, a long, b long"))


def candidates(nodes: DataFrame, near: DataFrame, percent: int) -> DataFrame:
    """Pairs (a, b) of nodes that stand near in some order and whose signatures agree well enough; hubs are on the left."""
    members = near.where("region IS NOT NULL").select("region", F.col("a").alias("id"), F.col("b").alias("leaf"))
    # a member's weight and its regions are brought together once, without a join of memberships
    each = members.groupBy("id").agg(F.sum(F.log("leaf")).alias("weight"), F.collect_list("region").alias("regions"))
    each = each.select("id", "weight", F.explode("regions").alias("region"))
    best = each.groupBy("region").agg(F.max(F.struct("weight", "id")).alias("m"))
    stars = each.select("region", "id").join(best.select("region", F.col("m.id").alias("hub")), "region").where("id <> hub").select(F.col("hub").alias("a"), F.col("id").alias("b"))
    pairs = near.where("region IS NULL").select("a", "b").union(stars).distinct()
    small = sketches(nodes)
    signed = lambda id_, name: small.select(F.col("node").alias(id_), F.col("sketch").alias(name))
    pairs = pairs.join(signed("a", "sig_a"), "a").join(signed("b", "sig_b"), "b").select("a", "b", "sig_a", "sig_b")
    return pairs.mapInArrow(_agreeing(_least(percent)), "a long, b long")


def _meetings(cell: pa.Table, least: float) -> Iterator[tuple[int, np.ndarray]]:
    """For each row of the others: the cell's members of other components whose signatures agree well enough, the best first."""
    ids, kin, other, outside = (cell.column(c).to_numpy() for c in ("id", "component", "other", "outside"))
    sketch = np.frombuffer(b"".join(cell.column("sketch").to_pylist()), np.uint8).reshape(len(ids), -1)
    here = np.flatnonzero(~other)
    for o in np.flatnonzero(other):
        # two members outside the main component meet both ways round; one is enough
        at = here[(kin[here] != kin[o]) & (~outside[here] | (ids[here] > ids[o]))]
        agree = (sketch[at] == sketch[o]).mean(1)
        order = np.argsort(-agree, kind="stable")
        yield o, at[order[agree[order] >= least]]


def _across(least: float):
    def keep(cell: pa.Table) -> pa.Table:
        meets = np.zeros(cell.num_rows, bool)
        for o, at in _meetings(cell, least):
            meets[at] = True
            meets[o] |= len(at) > 0
        return cell.filter(pa.array(meets))

    return keep


def _linking(least: float, percent: int):
    def link(cell: pa.Table) -> pa.Table:
        ids, kin = cell.column("id").to_numpy(), cell.column("component").to_numpy()
        sets = list(shingle_sets(cell.column("text").combine_chunks()))
        found: list[tuple[int, int]] = []
        for o, at in _meetings(cell, least):
            met = set()
            for m in at:
                if kin[m] not in met:
                    both = len(np.intersect1d(sets[o], sets[m], assume_unique=True))
                    if 100 * both >= percent * (len(sets[o]) + len(sets[m]) - both):
                        met.add(kin[m])
                        found.append((kin[o], kin[m]))
        return pa.table({"a": pa.array([f[0] for f in found], pa.int64()), "b": pa.array([f[1] for f in found], pa.int64())})

    return link


def remainder(docs: DataFrame, nodes: DataFrame, near: DataFrame, grouped: DataFrame, percent: int) -> DataFrame:
    """Links a, b between components that have members in one large region, from comparing all of these across components.

    A region's members are dealt into blocks, those outside its largest component also into blocks of others; each
    cell holds a block of either kind, so no task needs a whole region. Pairs live inside a cell only: signatures
    decide which rows' texts are fetched, full sets confirm, and one link is given for each member and component.
    """
    members = near.where(F.col("level") == LEAST).select("region", F.col("a").alias("id")).distinct()
    # sketches join a region's members before these are dealt into cells
    known = grouped.select("node", "component").join(sketches(nodes), "node").withColumnRenamed("node", "id")
    members = checkpointed(members.join(known, "id"))
    sizes = members.groupBy("region", "component").agg(F.count("*").alias("n"))
    sizes = sizes.groupBy("region").agg(F.max(F.struct("n", "component")).alias("m"), F.sum("n").alias("n"), F.count("*").alias("parts")).where("parts > 1")
    blocks = lambda n: F.ceil(n / CELL).cast("long")
    sizes = sizes.select("region", F.col("m.component").alias("main"), blocks(F.col("n")).alias("wide"), blocks(F.col("n") - F.col("m.n")).alias("high"))
    open_ = members.join(sizes, "region").withColumn("outside", F.col("component") != F.col("main"))
    every = lambda n: F.explode(F.sequence(F.lit(0).cast("long"), n - 1))
    mine = lambda n: F.pmod(F.xxhash64("id"), n)
    held = open_.withColumn("i", mine(F.col("wide"))).withColumn("j", every(F.col("high"))).withColumn("other", F.lit(False))
    others = open_.where("outside").withColumn("j", mine(F.col("high"))).withColumn("i", every(F.col("wide"))).withColumn("other", F.lit(True))
    cell, columns = ["region", "i", "j"], ["region", "i", "j", "id", "component", "outside", "other", "sketch"]
    cells = held.unionByName(others).select(*columns)
    schema = "region long, i long, j long, id long, component long, outside boolean, other boolean, sketch binary"
    cells = checkpointed(cells.groupBy(*cell).applyInArrow(_across(_least(percent)), schema))
    texts = _texts(docs, nodes, cells.select(F.col("id").alias("node")).distinct())
    cells = cells.join(texts.select(F.col("node").alias("id"), "text"), "id")
    return cells.groupBy(*cell).applyInArrow(_linking(_least(percent), percent), "a long, b long")


def _texts(docs: DataFrame, nodes: DataFrame, ids: DataFrame) -> DataFrame:
    """(node, text): a text for each node of ``ids``."""
    wanted = nodes.select("node", "doc_id").join(ids, "node").select(F.coalesce("doc_id", F.lit(-1)).alias("id"), F.col("doc_id").isNull().alias("none")).distinct()
    id_ = F.col("doc_id").cast("long")
    texts = docs.select(F.coalesce(id_, F.lit(-1)).alias("id"), F.col("doc_id").isNull().alias("none"), "text").join(wanted, ["id", "none"], "left_semi").select("text")
    return checkpointed(texts.mapInArrow(_noded, "node long, text string").dropDuplicates(["node"]).join(ids, "node", "left_semi"))


def confirmed(docs: DataFrame, nodes: DataFrame, pairs: DataFrame, percent: int) -> DataFrame:
    """The pairs whose full sets are similar enough."""
    texts = _texts(docs, nodes, pairs.select(F.col("a").alias("node")).union(pairs.select("b")).distinct())
    shares = pairs.distinct().select("a", F.pmod(F.xxhash64("b"), F.lit(SALTS)).cast("int").alias("share"), F.col("b").alias("node"))
    rows = shares.union(shares.select("a", "share", F.col("a").alias("node")).distinct())
    rows = rows.join(texts, "node").select("a", "share", "node", "text")
    n = int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    dealt = rows.repartition(n, "a", "share").sortWithinPartitions("a", "share", (F.col("node") != F.col("a")).cast("int"))
    return dealt.mapInArrow(_confirmed(percent), "a long, b long")


def components(docs: DataFrame, signed: DataFrame, percent: int) -> DataFrame:
    """(node, doc_id, component): the classes of equal sets with a number for what they are linked to."""
    nodes = checkpointed(classes(signed))
    near = regions(nodes)
    pairs = checkpointed(candidates(nodes, near, percent))
    found = connected_components(confirmed(docs, nodes, pairs, percent))
    grouped = checkpointed(nodes.select("node", "doc_id").join(found, "node", "left").select("node", "doc_id", F.coalesce("component", "node").alias("component")))
    links = remainder(docs, nodes, near, grouped, percent)
    more = connected_components(links).select(F.col("node").alias("component"), F.col("component").alias("to"))
    return grouped.join(more, "component", "left").select("node", "doc_id", F.coalesce("to", "component").alias("component"))


def near_duplicates(docs: DataFrame, percent: int = 85) -> DataFrame:
    """For each row of ``docs``: doc_id, n_shingles, component_id long, kept boolean.

    Texts are linked if 100 * |intersection| >= ``percent`` * |union| of their sets; ``component_id`` is the smallest
    doc_id that a row reaches, its own included, and ``kept`` holds where that is its own. A text of fewer than five
    words has its whole sequence as its one shingle; one without words, or null, has none and is linked with nothing.

    Rows with equal doc_ids are rows of their own: with equal texts they share a component, and all of them are kept
    or none. A null doc_id is never a component_id unless all rows of the component have none; such rows are kept. An
    empty table gives an empty one. Other columns aren't read. Nothing that grows with the rows reaches the driver.
    """
    signed = checkpointed(signatures(docs))
    grouped = components(docs, signed, percent)
    smallest = grouped.groupBy("component").agg(F.min("doc_id").alias("component_id"))
    labels = grouped.select("node", "component").join(smallest, "component").select("node", "component_id")
    out = signed.select("doc_id", "n_shingles", "node").join(labels, "node", "left")
    component = F.when(F.col("node").isNull(), F.col("doc_id")).otherwise(F.col("component_id"))
    return out.select("doc_id", "n_shingles", component.alias("component_id")).withColumn("kept", F.col("doc_id").eqNullSafe(F.col("component_id")))


def deduplicate(docs: DataFrame, percent: int = 80) -> DataFrame:
    """``docs`` with one row of each component: one that has the smallest doc_id, null last.

    Rows without words stay all. Of rows of a component with equal doc_ids the one with the smallest hash of its text
    stays, any one of equal texts. Columns, whatever their names, are those of ``docs``.
    """
    docs, back = renamed(docs, "doc_id", "text")

    def with_nodes(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for f in batches:
            nodes = pa.array([_node(s) for s in shingle_sets(f.column("text"))], pa.int64())
            yield pa.RecordBatch.from_arrays([*f.columns, nodes], [*f.schema.names, "node"])

    grouped = components(docs, checkpointed(signatures(docs)), percent)
    winners = grouped.groupBy("component").agg(F.min(F.struct(F.col("doc_id").isNull().alias("none"), F.col("doc_id"), F.col("node"))).alias("m"))
    winners = winners.select(F.col("m.node").alias("node"), F.coalesce("m.doc_id", F.lit(-1)).alias("id"), F.col("m.none").alias("none"))
    wordy = F.coalesce(F.col("text").rlike(r"[^\x20\x09-\x0D]"), F.lit(False))
    rows = docs.where(wordy).mapInArrow(with_nodes, T.StructType([*docs.schema.fields, T.StructField("node", T.LongType())]))
    rows = rows.withColumn("id", F.coalesce(F.col("doc_id").cast("long"), F.lit(-1))).withColumn("none", F.col("doc_id").isNull())
    keys = ["node", "id", "none"]
    one = rows.groupBy(*keys).agg(F.min_by(F.struct(*docs.columns), F.xxhash64("text")).alias("row")).join(winners, keys, "left_semi")
    return back(one.select("row.*").union(docs.where(~wordy)))


NEAR_SQL = r"""
WITH RECURSIVE words AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^ 	-
]+') AS w FROM documents),
runs AS (SELECT doc_id, w, unnest(range(1, greatest(len(w) - 4, 1)::BIGINT + 1)) AS i FROM words WHERE len(w) > 0),
sets AS (SELECT DISTINCT doc_id, md5(array_to_string(w[i:i + 4], chr(10))) AS s FROM runs),
sizes AS (SELECT doc_id, count(*)::BIGINT AS n FROM sets GROUP BY doc_id),
pairs AS (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS shared FROM sets a JOIN sets b ON a.s = b.s AND a.doc_id <> b.doc_id GROUP BY ALL),
link AS MATERIALIZED (SELECT a, b FROM pairs JOIN sizes x ON x.doc_id = a JOIN sizes y ON y.doc_id = b WHERE 100 * shared >= 85 * (x.n + y.n - shared)),
reach(doc_id, c) AS (SELECT doc_id, doc_id FROM documents UNION SELECT link.b, reach.c FROM reach JOIN link ON link.a = reach.doc_id),
comp AS (SELECT doc_id, min(c) AS component_id FROM reach GROUP BY doc_id)
SELECT d.doc_id, coalesce(n, 0)::BIGINT AS n_shingles, component_id, d.doc_id = component_id AS kept
FROM documents d JOIN comp USING (doc_id) LEFT JOIN sizes USING (doc_id)
"""
