"""Near-duplicates, fingerprints, language, fertility, toxicity and the language model."""

from __future__ import annotations

import hashlib
import itertools
import math
import random
import re
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest
from helpers import table, words
from pyspark.sql import functions as F

from lectern.llm import fertility, langmix, lshforest, ordermin, pitman, text_arrays, toxicity

WORD = re.compile(r"[^\x20\x09-\x0D]+")
LOWER = {i: i + 32 for i in range(65, 91)}


def low_words(text):
    return WORD.findall((text or "").translate(LOWER))


# ------------------------------------------------------------------ word arrays


def test_word_hashes_follow_words():
    texts = ["The cat\tsat on the mat", None, "", "  ", "the CAT", "中文 x", "a\x1fb"]
    data, offsets = text_arrays.utf8(pa.array(texts))
    hashes, at = text_arrays.word_hashes(data, offsets)
    seen: dict[str, int] = {}
    for i, t in enumerate(texts):
        mine = hashes[at[i] : at[i + 1]]
        expected = low_words(t)
        assert len(mine) == len(expected)
        for w, h in zip(expected, mine, strict=True):
            assert seen.setdefault(w, h) == h
    assert len(set(seen.values())) == len(seen)
    sliced, off = text_arrays.utf8(pa.array(texts).slice(4, 2))
    assert list(text_arrays.word_hashes(sliced, off)[0]) == list(hashes[at[4] : at[6]])


# ------------------------------------------------------------------ near-duplicates


def shingle_set(text):
    w = low_words(text)
    return {tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))} if w else set()


def brute_components(rows, percent):
    sets = [shingle_set(t) for _, t, *_ in rows]
    parent = list(range(len(rows)))

    def root(i):
        while parent[i] != i:
            i = parent[i]
        return i

    for i in range(len(rows)):
        for j in range(i):
            if sets[i] and sets[j] and 100 * len(sets[i] & sets[j]) >= percent * len(sets[i] | sets[j]):
                parent[root(i)] = root(j)
    out = []
    for i, (doc_id, *_) in enumerate(rows):
        ids = [rows[j][0] for j in range(len(rows)) if root(j) == root(i) and rows[j][0] is not None]
        c = doc_id if not sets[i] else min(ids, default=None)
        out.append((doc_id, len(sets[i]), c, doc_id == c))
    return sorted(out, key=repr)


def test_components_match_brute_force(spark, edges):
    got = lshforest.near_duplicates(table(spark, edges), 85).collect()
    assert sorted(map(tuple, got), key=repr) == brute_components(edges, 85)
    assert lshforest.near_duplicates(table(spark, [])).count() == 0


def test_large_group_of_near_copies(spark):
    """Copies with two edits each are linked to the original only: the hub must be found."""
    rng = random.Random(9)
    base = words(rng, 150).split(" ")
    rows = [(1000, " ".join(base), "en", "a")]
    for i in range(300):
        w = list(base)
        for at in rng.sample(range(5, 145), 2):
            w[at] = f"edit{i}x{at}"
        rows.append((i, " ".join(w), "en", "a"))
    rows += [(2000 + i, words(rng, 100), "en", "a") for i in range(50)]
    got = lshforest.near_duplicates(table(spark, rows), 85).collect()
    assert sorted(map(tuple, got), key=repr) == brute_components(rows, 85)


def test_copies_of_copies_in_a_large_group(spark):
    """Pairs linked to one another but to no hub nor crowd: what hubs leave open must be compared."""
    rng = random.Random(5)
    base = words(rng, 1000).split(" ")
    spots = range(5, 995, 10)  # an edit there changes five shingles, none in common with another's

    def edited(i, at):
        w = list(base)
        for x in at:
            w[x] = f"edit{i}x{x}"
        return w

    crowd = [(1000 + i, " ".join(edited(1000 + i, rng.sample(spots, 1))), "en", "a") for i in range(300)]
    rows = []
    for i in range(60):
        at = rng.sample(spots, 25)  # nine edits in common, and eight of each one's own
        first, second = edited(i, at[:17]), edited(i, at[:9])
        for x in at[17:]:
            second[x] = f"own{i}x{x}"
        rows += [(10 + 2 * i, " ".join(first), "en", "a"), (11 + 2 * i, " ".join(second), "en", "a")]
    expected = brute_components([*rows, *crowd[:5]], 85)
    assert {c for _, _, c, _ in expected} == {1000, *range(10, 130, 2)}  # pairs by themselves, and the crowd
    got = lshforest.near_duplicates(table(spark, [*rows, *crowd]), 85).collect()
    assert sorted((tuple(r) for r in got if r.doc_id < 1005), key=repr) == expected
    assert {r.component_id for r in got if r.doc_id >= 1000} == {1000}


def loose_region(rng, pairs):
    """Texts alike at about 0.74 to all others, each with one true partner at 0.86: no hub links anything."""
    base = words(rng, 400).split(" ")
    spots, out = range(6, 392, 10), []
    for i in range(pairs):
        at = rng.sample(spots, 9)
        for k, own in ((0, at[3:6]), (1, at[6:])):
            w = list(base)
            for x in at[:3]:
                w[x] = f"both{i}x{x}"
            for x in own:
                w[x] = f"own{i}x{k}x{x}"
            out.append((10 * i + k, " ".join(w), "en", "a"))
    return out


def test_pairs_in_a_loose_region(spark):
    rows = loose_region(random.Random(2), 150)
    got = {r.doc_id: r.component_id for r in lshforest.near_duplicates(table(spark, rows), 85).collect()}
    assert got == {i: i - i % 10 for i, *_ in rows}
    assert {(i, c) for i, _, c, _ in brute_components(rows[:60], 85)} == {(i, i - i % 10) for i, *_ in rows[:60]}


def test_cells_carry_sketches(spark, monkeypatch):
    """A byte for each value goes into cells and candidates, by one join of memberships; values that agree still do."""
    values = np.random.default_rng(1).integers(0, 1 << 32, (2, lshforest.TREES * lshforest.DEPTH), dtype=np.uint32)
    values[1, ::3] = values[0, ::3]
    nodes = spark.createDataFrame([(i, bytearray(v.astype(">u4").tobytes())) for i, v in enumerate(values)], "node long, signature binary")
    a, b = (np.frombuffer(r.sketch, np.uint8) for r in lshforest.sketches(nodes).orderBy("node").collect())
    assert len(a) == values.shape[1] and (a == b)[values[0] == values[1]].all() and (a == b).mean() < 0.5
    written, keep = [], lshforest.checkpointed
    monkeypatch.setattr(lshforest, "checkpointed", lambda df: written.append(keep(df)) or written[-1])
    lshforest.near_duplicates(table(spark, loose_region(random.Random(2), 10))).count()
    cells = next(x for x in written if "other" in x.columns)
    assert "signature" not in cells.columns and cells.count() and {len(r.sketch) for r in cells.collect()} == {values.shape[1]}


def test_deduplicate_keeps_one_of_each(spark, edges):
    docs = table(spark, edges)
    out = lshforest.deduplicate(docs, 80)
    assert out.columns == docs.columns
    wordless = [r for r in edges if not low_words(r[1])]
    classes = {c for (_, n, c, _), r in zip(brute_components(edges, 80), edges, strict=True) if n}
    full = [r for r in edges if low_words(r[1])]
    groups = {tuple(sorted(map(repr, [s for s in full if 100 * len(shingle_set(s[1]) & shingle_set(r[1])) >= 80 * len(shingle_set(s[1]) | shingle_set(r[1]))]))) for r in full}
    assert out.count() == len(groups) + len(wordless) and classes
    kept = {r.doc_id for r in out.collect()}
    assert {30, 40, 41, 42, 44, 51, 52} <= kept and not kept & {31, 32, 33, 53}
    assert lshforest.deduplicate(table(spark, [])).count() == 0


# ------------------------------------------------------------------ fingerprints


def test_next_and_edited_texts(spark, edges):
    rows = [r for r in edges if r[0] is not None and r[0] != 51] + [(51, "é中文", "zh", "c")]
    got = {r.doc_id: r for r in ordermin.fingerprints(table(spark, rows), rows_per_block=5).collect()}
    order = sorted(rows, key=lambda r: -r[0])
    assert len(got) == len(rows)
    for k, (i, text, *_) in enumerate(order):
        mine, other = text or "", order[(k + 1) % len(order)][1] or ""
        new = mine[: len(mine) - len(mine) // 2] + other[: len(mine) // 2]
        r = got[i]
        assert r.n_chars == len(mine) and r.edited_sha256 == hashlib.sha256(new.encode()).hexdigest()
        assert r.fingerprint == ordermin.text_of(ordermin.sketch(mine)) and r.edited_fingerprint == ordermin.text_of(ordermin.sketch(new))
        assert r.near_next == ordermin.likeness(ordermin.sketch(mine), ordermin.sketch(other))
    assert got[52].fingerprint == got[53].fingerprint
    assert ordermin.fingerprints(table(spark, [])).count() == 0
    assert ordermin.fingerprints(table(spark, [(1, "alone", None, None)])).first().near_next == 1.0
    assert ordermin.fingerprints(table(spark, edges)).count() == len(edges)


def test_many_rows_of_one_id(spark):
    """A doc_id, or null, that many rows share is cut into several blocks; the order is by a hash of the text."""
    rng = random.Random(12)
    rows = [(None if i % 2 else 7, words(rng, 6), None, None) for i in range(120)] + [(i, words(rng, 6), None, None) for i in (1, 2, 9)]
    docs = table(spark, rows)
    spots = {r.text: r.h for r in docs.select("text", F.xxhash64("text").alias("h")).distinct().collect()}
    order = sorted(rows, key=lambda r: (r[0] is None, -(r[0] or 0), spots[r[1]]))
    want = [(i, ordermin.text_of(ordermin.sketch(t)), ordermin.likeness(ordermin.sketch(t), ordermin.sketch(order[(k + 1) % len(order)][1]))) for k, (i, t, *_) in enumerate(order)]
    got = ordermin.fingerprints(docs, rows_per_block=8).collect()
    assert sorted(((r.doc_id, r.fingerprint, r.near_next) for r in got), key=repr) == sorted(want, key=repr)


def slow_sketch(text):
    """The tuples by plain loops."""
    points = np.frombuffer(text.encode("utf-32-le"), np.uint32)
    h = [int(x) for x in ordermin.kmers(points)]
    seen: Counter = Counter()
    x = []
    for v in h:
        x.append(int(ordermin.mix64(np.array([(v + seen[v] * int(ordermin._GOLD)) % 2**64], np.uint64))[0]) >> 32)
        seen[v] += 1
    picks = []
    for j in range(ordermin.SKETCHES):
        z = []
        for v in x:
            y = (v * int(ordermin._TIMES[j, 0]) + int(ordermin._PLUS[j, 0])) % 2**32
            y ^= y >> 15
            y = y * 0x2C1B3C6D % 2**32
            z.append(y ^ (y >> 13))
        best = sorted(sorted(range(len(z)), key=lambda i: z[i])[: ordermin.PICKS])
        picks.append(tuple(h[i] for i in best))
    return picks


def test_order_minhash_against_loops():
    rng = random.Random(2)
    a = words(rng, 40)
    b = " ".join(reversed(a.split(" ")))
    c = a[:100] + "zzz" + a[100:]
    for s, t in ((a, b), (a, c), (a, a), (a, words(rng, 40))):
        slow = np.mean([x == y for x, y in zip(slow_sketch(s), slow_sketch(t), strict=True)])
        assert ordermin.likeness(ordermin.sketch(s), ordermin.sketch(t)) == slow
    assert ordermin.likeness(ordermin.sketch(a), ordermin.sketch(c)) > 0.4 > ordermin.likeness(ordermin.sketch(a), ordermin.sketch(b))
    assert list(ordermin.numbered(np.array([5 << 30, 7 << 30, 5 << 30, 5 << 30], np.uint64))) == [0, 0, 1, 2]


# ------------------------------------------------------------------ languages

SYLLABLES = {"en": ["th", "er", "ing", "on", "the"], "de": ["sch", "ung", "ver", "ein", "ü"], "fr": ["eux", "é", "tion", "le", "ment"]}


def language_text(rng, lang, n):
    return " ".join("".join(rng.choice(SYLLABLES[lang]) for _ in range(rng.randint(1, 3))) for _ in range(n))


def test_languages_and_mixtures(spark):
    rng = random.Random(4)
    rows = [(i, language_text(rng, g, rng.randint(3, 60)), g, "a") for i, g in enumerate(["en", "de", "fr"] * 40)]
    rows += [(500, None, None, None), (501, "", "en", "a"), (502, "123 !!", "en", "a"), (503, language_text(rng, "en", 150) + " " + language_text(rng, "de", 150), None, "a")]
    docs = table(spark, rows)
    model = langmix.learn(docs, F.col("doc_id") % 3 != 5)
    got = {r.doc_id: r for r in langmix.identify(docs, model).collect()}
    assert len(got) == len(rows)
    assert all(got[i].lang_pred == g for i, _, g, _ in rows[:120])
    assert all(got[i].lang_pred == "und" and got[i].score == 0 for i in (500, 501, 502))
    assert sorted(x.lang for x in got[503].lang_set) == ["de", "en"] and 0.4 < got[503].score < 0.6
    empty = langmix.learn(table(spark, []), F.lit(True))
    assert {r.lang_pred for r in langmix.identify(docs, empty).collect()} == {"und"}
    assert langmix.identify(table(spark, []), model).count() == 0


def test_em_reaches_the_best_proportions():
    rng = np.random.default_rng(0)
    counts = {g: np.zeros(langmix.BUCKETS, int) for g in "ab"}
    counts["a"][:40], counts["b"][20:60] = 5, 5
    m = langmix.Model(counts)
    text = np.concatenate([rng.integers(0, 40, 700), rng.integers(20, 60, 300)])
    chosen, main = m.infer([text])[0]
    share = dict(chosen)
    grid = np.linspace(0.001, 0.999, 999)
    likely = [np.log(x * m.p[text, 0] + (1 - x) * m.p[text, 1]).sum() for x in grid]
    assert abs(share["a"] - grid[int(np.argmax(likely))]) < 0.02


def test_selected_sets_against_all_subsets():
    """The languages chosen, among all sets of them, by likelihood less the price of each language after the first."""
    rng = random.Random(17)
    counts = {}
    for g in SYLLABLES:
        counts[g] = np.bincount(langmix.trigrams(language_text(rng, g, 3000)), minlength=langmix.BUCKETS)
    m = langmix.Model(counts)
    for parts in (["en"], ["de"], ["en", "fr"], ["de", "en"], ["de", "en", "fr"]):
        x = langmix.trigrams(" ".join(language_text(rng, g, 120) for g in parts))
        cells, n = np.unique(x, return_counts=True)
        best = None
        for k in range(1, 4):
            for some in itertools.combinations(range(3), k):
                theta = np.full(k, 1 / k)
                p = m.p[cells][:, some]
                for _ in range(200):
                    r = theta * p
                    theta = (r / r.sum(1, keepdims=True) * n[:, None]).sum(0) / n.sum()
                worth = (np.log((theta * p).sum(1)) * n).sum() - (k - 1) * (math.log(n.sum() + 1) + langmix.PENALTY * n.sum())
                best = max(best or (worth, some), (worth, some))
        chosen, main = m.infer([x])[0]
        assert sorted(g for g, _ in chosen) == [m.languages[i] for i in best[1]] == sorted(parts)
        assert chosen[0][1] == max(s for _, s in chosen) and 0 < main <= 1


def test_languages_of_awkward_texts(spark):
    """Very long texts, ties, repeated rows with other texts under one doc_id; more languages than usual."""
    rng = random.Random(6)
    rows = [(i, language_text(rng, g, 40), g, "a") for i, g in enumerate(["en", "de", "fr"] * 10)]
    rows += [(50, language_text(rng, "de", 60_000), None, "a"), (51, rows[0][1], "en", "a"), (51, rows[1][1], "de", "a"), (52, "zz", None, None), (52, "zz", None, None)]
    rows += [(100 + i, f"tag {i} {chr(0x4E00 + i) * 6}", f"l{i}", "a") for i in range(1100)]
    model = langmix.learn(table(spark, rows), F.lit(True))
    assert len(model.languages) == 1103
    got = langmix.identify(table(spark, rows[:35] + rows[-3:]), model).collect()
    assert len(got) == 38 and [r.lang_pred for r in got if r.doc_id == 50] == ["de"]
    assert sorted(r.lang_pred for r in got if r.doc_id == 51) == ["de", "en"]
    assert len({(r.lang_pred, r.score) for r in got if r.doc_id == 52}) == 1
    assert all(r.lang_pred == f"l{r.doc_id - 100}" for r in got if r.doc_id >= 100)


# ------------------------------------------------------------------ fertility


def slow_figures(text, model):
    w = WORD.findall(text or "")
    ids = [i for x in w for i in model.encode(x)]
    c = Counter(ids)
    h = -sum(n / len(ids) * math.log2(n / len(ids)) for n in c.values()) if ids else 0.0
    grams = Counter(tuple(w[k : k + 8]) for k in range(len(w) - 7))
    covered = {j for k in range(len(w) - 7) if grams[tuple(w[k : k + 8])] > 1 for j in range(k, k + 8)}
    lines, dup = set(), 0
    for line in (text or "").split("\n"):
        if WORD.search(line):
            dup += line in lines
            lines.add(line)
    return (len(w), sum(map(len, w)), len(re.findall(r"[#*$%&|<>]", text or "")), dup, len(covered), len(ids)), (
        sum(map(len, w)) / max(1, len(ids)), sum(model.is_byte(i) for i in ids) / max(1, len(ids)), h / math.log2(len(ids)) if len(ids) > 1 else 0.0,
    )


def test_fertility_figures(spark, edges):
    sentencepiece = pytest.importorskip("sentencepiece")
    model = sentencepiece.SentencePieceProcessor(model_file=fertility.VOCABULARY)
    rng = random.Random(8)
    line = words(rng, 9)
    rows = [r for r in edges if r[0] is not None] + [(60, f"{line}\n{line}\n\n{line} #*$\n", "en", "a"), (61, "\U0001f600中 " * 30, "zh", "a")]
    out = fertility.quality(table(spark, rows), lang=F.col("lang")).collect()
    assert len(out) == len(rows)
    by = {r.doc_id: r for r in out}
    for i, text, *_ in rows:
        whole, shares = slow_figures(text, model)
        r = by[i]
        assert (r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words, r.n_tokens) == whole
        assert np.allclose((r.chars_per_token, r.byte_share, r.token_entropy), shares)
        assert r.base_failed == (whole[0] < 20 or 100 * whole[4] > 30 * whole[0])
        assert not (r.base_failed and r.kept)
    assert fertility.quality(table(spark, [])).count() == 0
    assert fertility.quality(table(spark, [(1, None, None, None)])).first().kept is False


def test_bands_reject_outliers(spark):
    rng = random.Random(1)
    rows = [(i, "the cat and the dog of a house in the town " + words(rng, 40), "en", "a") for i in range(80)]
    rows += [(100, "ẞЖ中\U0001f600" * 60 + " x" * 30, "en", "a")]
    kept = {r.doc_id: r.kept for r in fertility.quality(table(spark, rows), lang=F.col("lang")).collect()}
    assert not kept.pop(100) and sum(kept.values()) >= 78


@pytest.mark.parametrize("sent", [10_000, 0])
def test_bands_against_sorted_lists(spark, edges, monkeypatch, sent):
    """kept, from figures sorted language by language."""
    monkeypatch.setattr(fertility, "MOST_BANDS", sent)
    rng = random.Random(31)
    rows = [*edges, *[(200 + i, words(rng, rng.randint(5, 60)) + " x" * (i % 7), ("en", "de", None)[i % 3], "a") for i in range(90)]]
    rows += [(300 + i, "\u4e2d\U0001f600" * (5 + i), "zh", "a") for i in range(30)]
    measured = fertility.measure(table(spark, rows), lang=F.col("lang")).collect()
    out = {tuple(r)[:-1]: r.kept for r in fertility.quality(table(spark, rows), lang=F.col("lang")).collect()}
    good = [r for r in measured if not r.base_failed]

    def quartile(some, name, share):
        x = sorted(math.floor(r[name] * 1000 + 0.5) / 1000 for r in some)
        return x[math.ceil(len(x) * share) - 1]

    kept = {}
    for r in measured:
        own, ok = [g for g in good if g.band == r.band], not r.base_failed
        for name, least in fertility.LEAST_MARGIN.items():
            if not ok:
                break
            k = len(own) / (len(own) + fertility.PRIOR)
            q1, q3 = (k * quartile(own, name, s) + (1 - k) * quartile(good, name, s) for s in (0.25, 0.75))
            margin = max(fertility.REACH * (q3 - q1), least) * (1 + fertility.SHORT / math.sqrt(r.n_words))
            ok &= (name == "token_entropy" or r[name] <= q3 + margin) and (name == "byte_share" or r[name] >= q1 - margin)
        kept[tuple(r)] = ok
    assert {k[0] for k in kept} == {k[0] for k in out}
    assert sorted((k[:2], v) for k, v in kept.items() if k[0] is not None) == sorted((k[:2], v) for k, v in out.items() if k[0] is not None)
    assert len(set(kept.values())) == 2


# ------------------------------------------------------------------ toxicity


def test_toxicity_and_counterfactuals(spark):
    rng = random.Random(6)
    plain = [words(rng, 20).split(" ") for _ in range(400)]
    rows = []
    for i, w in enumerate(plain):
        toxic = i % 4 == 0
        if toxic:
            w = [*w, rng.choice(["scum", "idiot"])]
        if i % 2 == 0:
            w = [*w, "muslim"] if toxic or i % 8 == 2 else w  # the group is mentioned mostly in attacks
        rows.append((set(w), int(toxic)))
    free, held = toxicity.fit(rows, swap=0.0), toxicity.fit(rows, swap=5.0)
    gap = lambda m: abs(m.weights.get("muslim", 0.0) - m.weights.get("christian", 0.0))
    assert gap(free) > 0.5 and gap(held) < 0.2 * gap(free)
    assert held.score("such an idiot") > 0.7 > 0.4 > held.score("a muslim neighbour")

    docs = table(spark, [(i, " ".join(sorted(w)), "en", "a") for i, (w, _) in enumerate(rows)] + [(900, None, None, None), (901, "", "en", "a"), (901, "", "en", "a")])
    labels = spark.createDataFrame([(i, y) for i, (_, y) in enumerate(rows)] + [(0, None), (None, 1)], "doc_id long, toxic int")
    learns = F.pmod(F.crc32(F.col("doc_id").cast("string").cast("binary")), F.lit(3)) != 1
    model = toxicity.learn(docs, labels, learns)
    got = toxicity.score(docs, model).collect()
    assert len(got) == len(rows) + 3
    out = [r for r in got if r.doc_id < 400 and __import__("zlib").crc32(str(r.doc_id).encode()) % 3 == 1]
    assert np.mean([r.predicted == rows[r.doc_id][1] for r in out]) > 0.95
    assert {r.score for r in got if r.doc_id >= 900} == {got[-1].score} and got[-1].predicted == 0
    nothing = toxicity.learn(docs, labels.limit(0), learns)
    assert toxicity.score(docs, nothing).where("score <> 0.5").count() == 0
    assert toxicity.score(table(spark, []), model).count() == 0


def toxicity_loss(weights, bias, rows, swap):
    """The whole loss, term by term."""
    score = lambda ws: 1 / (1 + math.exp(-(bias + sum(weights.get(w, 0.0) for w in ws))))
    share = [toxicity.TOXIC_WEIGHT if y else 1.0 for _, y in rows]
    loss = sum(s * -math.log(score(ws) if y else 1 - score(ws)) for (ws, y), s in zip(rows, share, strict=True)) / sum(share)
    gaps = [sum(weights.get(w, 0.0) for w in ws) - sum(weights.get(w, 0.0) for w in other) for ws, _ in rows for other in toxicity.swapped(ws)]
    return loss + toxicity.RIDGE * sum(w * w for w in weights.values()) + (swap * sum(g * g for g in gaps) / len(gaps) if gaps else 0.0)


def test_fit_reaches_the_optimum():
    rng = random.Random(21)
    rows = []
    for i in range(200):
        toxic = i % 3 == 0
        ws = {rng.choice(["idiot", "scum", "house"]) if toxic else rng.choice(["garden", "house", "idiot"]), rng.choice(["tree", "river"])}
        if i % 5 == 0:
            ws.add("frauen" if toxic else "hommes")
        rows.append((ws, int(toxic)))
    vocabulary = sorted(set.union(*[ws for ws, _ in rows]))
    for swap in (0.0, 1.0):
        model = toxicity.fit(rows, swap, vocabulary=vocabulary)
        weights = {w: model.weights.get(w, 0.0) for w in vocabulary}
        least = toxicity_loss(weights, model.bias, rows, swap)
        for _ in range(300):
            other = {w: x + rng.gauss(0, 0.3) for w, x in weights.items()}
            assert toxicity_loss(other, model.bias + rng.gauss(0, 0.1), rows, swap) > least - 1e-4


def test_neutral_mentions_aren_t_attacks(spark):
    """A group that labelled texts mention in attacks mostly: with the penalty fewer neutral mentions are caught, as many attacks."""
    rng = random.Random(13)
    rows = []
    for i in range(600):
        toxic = i % 3 == 0
        group = {True: "musulmans", False: "chrétiens" if i % 3 == 1 else ""}[toxic and i % 2 == 0 or (not toxic and i % 60 == 1)] if not toxic else ("musulmans" if i % 2 == 0 else "")
        rows.append((i, " ".join([*words(rng, 12).split(" "), *([rng.choice(["crapule", "ordure"])] if toxic and i % 4 else []), group]).strip(), int(toxic)))
    docs = table(spark, [(i, t, "fr", "a") for i, t, _ in rows] + [(3, "x" * 400_000, "fr", "a"), (None, "crapule", None, None)])
    labels = spark.createDataFrame([(i, y) for i, _, y in rows], "doc_id long, toxic int")
    free, held = (toxicity.learn(docs, labels, F.lit(True), swap=s) for s in (0.0, 20.0))
    assert free.pairs == held.pairs > 100
    neutral = [f"les {g} {words(rng, 8)}" for g in ("musulmans", "chrétiens", "juifs") for _ in range(30)]
    attacks = [f"{words(rng, 8)} crapule" for _ in range(50)]
    caught = lambda m, texts: sum(m.score(t) >= 0.5 for t in texts)
    assert caught(held, neutral) < caught(free, neutral) and caught(held, attacks) == caught(free, attacks) == 50
    gap = lambda m: abs(m.weights.get("musulmans", 0.0) - m.weights.get("juifs", 0.0))
    assert gap(held) < 0.5 * gap(free)
    got = toxicity.score(docs, held).collect()
    assert len(got) == len(rows) + 2 and all(0 <= r.score <= 1 for r in got)


# ------------------------------------------------------------------ language model


def test_stirling_numbers_count_seatings():
    d = 0.3
    table_ = np.exp(pitman.stirling(d, 6))
    # of three customers: one table (1 - d)(2 - d); two tables 3 (1 - d); three tables 1
    assert np.allclose(table_[3, 1:4], [(1 - d) * (2 - d), 3 * (1 - d), 1])


def test_tables_follow_their_distribution(monkeypatch):
    price, n = 0.7, 20_000
    got = pitman.draw_tables(np.full(n, 3), np.full(n, price), pitman.DISCOUNT, pitman.keyed(np.arange(n)))
    w = np.exp(pitman.stirling(pitman.DISCOUNT, 3)[3, 1:4]) * price ** np.arange(1, 4)
    assert np.abs(np.bincount(got, minlength=4)[1:] / n - w / w.sum()).max() < 0.02
    # the limit used for many customers against the numbers themselves
    log_s = pitman.stirling(pitman.DISCOUNT, 600)[600, 1:]
    t = np.arange(1, 601)
    for price in (1e-4, 0.1, 1.0, 8.0, 40.0, 300.0, 5_000.0):
        w = np.exp((x := log_s + t * math.log(price)) - x.max())
        mean = (w * t).sum() / w.sum()
        spread = math.sqrt((w * (t - mean) ** 2).sum() / w.sum())
        got = pitman.draw_tables(np.full(n, 600), np.full(n, price), pitman.DISCOUNT, pitman.keyed(np.arange(n), 3))
        assert abs(got.mean() - mean) < 0.02 * mean + 0.02 and abs(got.std() - spread) < 0.05 * spread + 0.02


def test_gamma_variates():
    for shape in (1.3, 6.25, 400.0):
        x = pitman.gamma(np.full(50_000, shape), pitman.keyed(np.arange(50_000), 9))
        assert x.mean() == pytest.approx(shape, rel=0.02) and x.var() == pytest.approx(shape, rel=0.05)


class PlainModel:
    """The same chain over plain dictionaries, one draw at a time; common: words that are sampled across all pairs."""

    D, S, RD, RS = pitman.DISCOUNT, pitman.STRENGTH, pitman.ROOT_DISCOUNT, pitman.ROOT_STRENGTH

    def __init__(self, texts, share):
        self.end, self.start = int(pitman._END), int(pitman._START)
        tokens = [self.tokens(t) for t in texts]
        self.count = Counter(w for ws in tokens for w in ws)
        self.n, self.v = sum(self.count.values()), len(self.count)
        self.pairs = Counter(p for ws in tokens for p in zip([self.start, *ws], ws, strict=False))
        self.followed = Counter()
        for (v, _), c in self.pairs.items():
            self.followed[v] += c
        self.common = {w for w, c in self.count.items() if c * share >= self.n} | {self.start}
        self.samples = []
        self.sample()

    def tokens(self, text):
        data, offsets = text_arrays.utf8(pa.array([text]))
        return [*map(int, text_arrays.word_hashes(data, offsets)[0]), self.end]

    def draw(self, c, price, d, *key):
        return int(pitman.draw_tables(np.array([c]), np.array([price]), d, pitman.keyed(*map(np.uint64, key)))[0])

    def gamma(self, shape, *key):
        return float(pitman.gamma(np.array([shape]), pitman.keyed(*map(np.uint64, key)))[0])

    def parent(self, c, t, tables, customers):
        return (c - self.RD * t + (self.RS + self.RD * tables) / (self.v + 1)) / (self.RS + customers)

    def sample(self):
        base, by_dish, by_context = 1 / (self.v + 1), {}, {}
        for v, w in self.pairs:
            by_dish.setdefault(w, []).append(v)
            by_context.setdefault(v, []).append(w)
        x = {v: self.S / self.D + self.followed[v] ** self.D for v in self.common}
        p = {w: (self.count[w] + 0.1) / (self.n + 0.1 * (self.v + 1)) for w in self.common}
        rx, tables = self.RS / self.RD + self.v, self.v
        customers = sum(self.count[w] ** self.D for w in self.common) + max(0, self.v - len(self.common))
        for r in range(pitman.BURN + pitman.SAMPLES):
            t = {(v, w): 1 for v, w in self.pairs}
            for (v, w), c in self.pairs.items():
                if v in self.common and w in self.common:
                    t[v, w] = self.draw(c, self.D * x[v] * p[w], self.D, v, w, r)
            for v in self.followed.keys() - self.common:
                for j in range(pitman.INNER):
                    own = self.gamma(self.S / self.D + sum(t[v, w] for w in by_context[v]), v, 21, r, j)
                    for w in by_context[v]:
                        if w in self.common:
                            t[v, w] = self.draw(self.pairs[v, w], self.D * own * p[w], self.D, v, w, r, j)
            low = {}
            for w in self.count.keys() - self.common:
                low[w] = 1
                for j in range(pitman.INNER):
                    q = self.parent(sum(t[v, w] for v in by_dish[w]), low[w], tables, customers)
                    for v in by_dish[w]:
                        if v in self.common:
                            t[v, w] = self.draw(self.pairs[v, w], self.D * x[v] * q, self.D, v, w, r, j)
                    low[w] = self.draw(sum(t[v, w] for v in by_dish[w]), self.RD * rx * base, self.RD, w, 22, r, j)
            at = {w: sum(t[v, w] for v in by_dish[w]) for w in self.count}
            for w in self.common & self.count.keys():
                low[w] = self.draw(at[w], self.RD * rx * base, self.RD, w, 11, r)
            tables, customers = sum(low.values()), sum(at.values())
            served = {v: sum(t[v, w] for w in by_context.get(v, [])) for v in self.followed.keys() | self.common}
            x = {v: self.gamma(self.S / self.D + served[v], v, 12, r) for v in self.common}
            rx = self.gamma(self.RS / self.RD + tables, 13, r)
            root = {w: self.parent(at[w], low[w], tables, customers) for w in self.count}
            p = {w: root.get(w, 0.0) for w in self.common}
            if r >= pitman.BURN:
                self.samples.append((t, served, root, self.parent(0, 0, tables, customers)))

    def probability(self, v, w):
        out = 0.0
        for t, served, root, rest in self.samples:
            spare = self.S + self.D * served.get(v, 0)
            out += (self.pairs[v, w] - self.D * t.get((v, w), 0) + spare * root.get(w, rest)) / (self.S + self.followed[v])
        return out / len(self.samples)

    def score(self, text):
        ws = self.tokens(text)
        return sum(math.log10(self.probability(v, w)) for v, w in zip([self.start, *ws], ws, strict=False))


def chains(seed, n, size=60):
    """Texts whose words depend on the word before."""
    rng = random.Random(seed)
    vocabulary = words(rng, size).split(" ")
    follows = {w: rng.sample(vocabulary, 3) for w in vocabulary}

    def chain(k):
        out = [rng.choice(vocabulary)]
        while len(out) < k:
            out.append(rng.choice(follows[out[-1]]))
        return " ".join(out)

    return [(i, chain(rng.randint(1, 60)), "en", "a") for i in range(n)]


@pytest.mark.parametrize("share", [1 << 18, 60, 1])
def test_scores_equal_a_plain_sampler(spark, edges, monkeypatch, share):
    """Whichever words are common; with parts of any size and in any order."""
    monkeypatch.setattr(pitman, "SHARE", share)
    monkeypatch.setattr(pitman, "HOT", 200)
    rows = [r for r in edges if r[0] != 50] + [(100 + i, *rest) for i, *rest in chains(7, 60)] + [(300, "the " * 2000, None, None), (301, None, None, None)]
    learns, held = F.col("doc_id") % 5 != 0, F.col("doc_id") % 5 == 0
    plain = PlainModel([t for i, t, *_ in rows if i is not None and i % 5], share)
    assert sum(plain.probability(plain.start, w) for w in [*plain.count, 1]) == pytest.approx(1)
    docs = table(spark, rows)
    ids = {r[0] for r in rows}
    got = {}
    for parts, blocks, buckets in ((1, 4096, 1 << 20), (5, 7, 300)):
        monkeypatch.setattr(pitman, "BLOCK_TEXTS", blocks)
        monkeypatch.setattr(pitman, "BUCKET_TOKENS", buckets)
        out = pitman.score(docs.repartition(parts), learns, held).collect()
        assert len(out) == len(rows)
        got[parts] = {r.doc_id: r for r in out if r.doc_id is not None}
        assert got[parts].keys() == ids - {None}
    for i, text, *_ in rows:
        if i is not None:
            assert got[1][i].score == pytest.approx(plain.score(text), rel=1e-6)
            assert got[5][i].score == pytest.approx(got[1][i].score, rel=1e-6)
    v = next(w for w, c in plain.followed.most_common() if w != plain.start)
    assert sum(plain.probability(v, w) for w in [*plain.count, 1]) == pytest.approx(1)


class WholeChain(PlainModel):
    """One chain over all words; share: only what draws of pairs of two rare words are known by depends on it."""

    def __init__(self, texts, share):
        self.cut = share
        super().__init__(texts, 1 << 18)

    def draw(self, c, price, d, *key):
        if len(key) == 3 and all(k in self.count and self.count[k] * self.cut < self.n for k in key[:2]):
            key = (key[0] >> 24, key[1] >> 24, key[2])
        return super().draw(c, price, d, *key)


@pytest.mark.parametrize("share", [1 << 18, 60, 1])
def test_pairs_of_rare_words_are_sampled(spark, edges, monkeypatch, share):
    """Whichever words are rare, their pairs are part of the chain; with parts of any size and in any order."""
    monkeypatch.setattr(pitman, "SHARE", share)
    monkeypatch.setattr(pitman, "HOT", 200)
    rows = [r for r in edges if r[0] != 50] + [(100 + i, *rest) for i, *rest in chains(7, 60)] + [(300, "the " * 2000, None, None), (301, None, None, None)]
    plain = WholeChain([t for i, t, *_ in rows if i is not None and i % 5], share)
    rare = [p for p in plain.pairs if all(w in plain.count and plain.count[w] * share < plain.n for w in p)]
    assert share == 1 << 18 or any(t[p] > 1 for t, *_ in plain.samples for p in rare)
    docs = table(spark, rows)
    for parts, blocks, buckets in ((1, 4096, 1 << 20), (5, 7, 300)):
        monkeypatch.setattr(pitman, "BLOCK_TEXTS", blocks)
        monkeypatch.setattr(pitman, "BUCKET_TOKENS", buckets)
        out = pitman.score(docs.repartition(parts), F.col("doc_id") % 5 != 0, F.col("doc_id") % 5 == 0, sample_rare=True).collect()
        got = {r.doc_id: r.score for r in out}
        assert len(out) == len(rows)
        for i, text, *_ in rows:
            if i is not None:
                assert got[i] == pytest.approx(plain.score(text), rel=1e-6)


def test_meetings_agree_where_short_hashes_clash():
    """Both sides list the same pairs, though one side merges words whose 40 bits are equal."""
    v1, v2, w = ((np.uint64(5) << np.uint64(24)) + np.uint64(k) for k in (1, 2, 1 << 30))
    rare = lambda owners, owner, kind, other, n: pitman.Pairs(*[np.zeros(0, np.int64)] * 3, np.array(owners), np.array(owner), np.array([kind] * len(n), np.uint8), np.array(other), np.array(n))
    of = rare([v1, v2], [0, 1], pitman._OF_RARE, [w >> np.uint64(24)] * 2, [1, 1]).meetings(pitman._OF_RARE, 4)
    in_ = rare([w], [0], pitman._IN_RARE, [v1 >> np.uint64(24)], [2]).meetings(pitman._IN_RARE, 4)
    assert len(of.owner) == len(in_.owner) == 1 and list(of.rows) == [0, 1] and list(of.group) == [0, 0]
    assert (of.left[0], of.right[0]) == (in_.left[0], in_.right[0])


def test_base_figures(spark, edges):
    rows = [r for r in edges if r[0] not in (None, 50)] + [(50, " ".join((edges[0][1] + " ") * 3), "en", "a")]
    got = {r.doc_id: r for r in pitman.score(table(spark, rows), F.col("doc_id") % 5 != 0, F.col("doc_id") % 5 == 0).collect()}
    tokens = [(i, [*low_words(t), None]) for i, t, *_ in rows]
    c = Counter(w for i, ws in tokens if i % 5 for w in ws)
    n, v = sum(c.values()), len(c)
    for i, ws in tokens:
        r = got[i]
        assert (r.n_tokens, r.n_known, r.train_tokens, r.held_out) == (len(ws), sum(c[w] > 0 for w in ws), n, i % 5 == 0)
        assert r.base_score == pytest.approx(sum(math.log10((c[w] + 0.1) / (n + 0.1 * (v + 1))) for w in ws), rel=1e-9)
        assert r.score < 0


def test_contexts_tell(spark):
    rows = chains(8, 120)
    out = pitman.score(table(spark, rows), F.col("doc_id") % 5 != 0, F.col("doc_id") % 5 == 0).collect()
    assert np.mean([r.score > r.base_score for r in out if r.held_out]) > 0.9


def test_language_model_without_training_rows(spark):
    docs = table(spark, [(1, "a b", None, None), (2, None, None, None), (None, "a", None, None)])
    out = pitman.score(docs, F.lit(False), F.lit(True)).collect()
    assert len(out) == 3 and all(r.base_score == 0 and r.score == pytest.approx(0) for r in out)
    assert pitman.score(table(spark, []), F.lit(True), F.lit(False)).count() == 0
