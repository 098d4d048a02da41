"""Licence scans, mixing, packing and URL verdicts."""

from __future__ import annotations

import itertools
import random

import numpy as np
import pytest
from helpers import table
from pyspark.sql import functions as F

from lectern.llm import licenses, mixing, packing, urlgraph


def test_license_sequences(spark, edges):
    bsd = "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met:\n" + "* Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer.\n"
    rest = "Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution.\n"
    rows = [
        (1, "Hello. Licensed under the Apache License, Version 2.0.\nbye", None, None),
        (2, bsd + rest, None, None),
        (3, rest + bsd, None, None),
        (4, "Released under the MIT License.\nLicensed under CC BY-NC 4.0.", None, None),
        (5, None, None, None),
        (6, "", None, None),
    ]
    got = {r.doc_id: r for r in licenses.scan(table(spark, rows)).collect()}
    assert (got[1].licenses, got[1].verdict, got[1].n_known) == ("Apache-2.0", "permissive", 1)
    assert (got[2].licenses, got[2].sentence_ids) == ("BSD-2-Clause", "bsd_grant|bsd_source|bsd_binary")
    assert (got[3].licenses, got[3].verdict) == ("", "unclear")  # the same sentences in another order match no rule
    assert (got[4].licenses, got[4].verdict) == ("MIT|CC-BY-NC-4.0", "restricted")
    assert got[5].verdict == got[6].verdict == "none" and got[5].sentence_ids == ""
    docs = table(spark, edges)
    out = licenses.scan(docs)
    assert out.count() == len(edges) and set(docs.columns) < set(out.columns)
    assert out.where("hits <> 'hits' OR ids <> 'ids'").count() == 0
    assert licenses.scan(table(spark, [])).count() == 0


def test_wrapped_notices(spark):
    """Notices as published, wrapped and in comments."""
    gpl = """This program is free software: you can redistribute it and/or modify
it under the terms of the GNU General Public License as published by
the Free Software Foundation, either version 3 of the License, or
(at your option) any later version.

This program is distributed in the hope that it will be useful,
but WITHOUT ANY WARRANTY; without even the implied warranty of
MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE.  See the
GNU General Public License for more details."""
    apache = """Copyright 2020 Someone

Licensed under the Apache License, Version 2.0 (the "License");
you may not use this file except in compliance with the License.
You may obtain a copy of the License at

    http://www.apache.org/licenses/LICENSE-2.0

Unless required by applicable law or agreed to in writing, software
distributed under the License is distributed on an "AS IS" BASIS,
WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied.
See the License for the specific language governing permissions and
limitations under the License."""
    leader = lambda text, mark: "\n".join(mark + line for line in text.split("\n"))
    texts = [gpl, apache, leader(gpl, " * "), leader(apache, "# "), "not " + gpl[:60], "MIT\nLicense", "MIT.\nLicense"]
    rows = [(i, x, None, None) for i, x in enumerate(texts)]
    got = {r.doc_id: (r.licenses, r.sentence_ids) for r in licenses.scan(table(spark, rows)).collect()}
    assert got[0] == got[2] == ("GPL-3.0-or-later", "gpl3_grant|gpl_warranty|gpl_see")
    assert got[1] == got[3] == ("Apache-2.0", "apache_ref|apache_use|apache_copy|apache_warranty|apache_see")
    assert got[4] == ("", "") and got[5] == ("MIT", "mit_title") and got[6] == ("", "")


def test_more_published_notices(spark):
    """Headers of further licences at 72 columns, bare and inside comments."""
    notices = {
        "MPL-2.0": """This Source Code Form is subject to the terms of the Mozilla Public
License, v. 2.0. If a copy of the MPL was not distributed with this
file, You can obtain one at https://mozilla.org/MPL/2.0/.""",
        "ISC": """Permission to use, copy, modify, and/or distribute this software for any
purpose with or without fee is hereby granted, provided that the above
copyright notice and this permission notice appear in all copies.

THE SOFTWARE IS PROVIDED "AS IS" AND THE AUTHOR DISCLAIMS ALL WARRANTIES
WITH REGARD TO THIS SOFTWARE INCLUDING ALL IMPLIED WARRANTIES OF
MERCHANTABILITY AND FITNESS. IN NO EVENT SHALL THE AUTHOR BE LIABLE.""",
        "LGPL-2.1-or-later": """This library is free software; you can redistribute it and/or
modify it under the terms of the GNU Lesser General Public
License as published by the Free Software Foundation; either
version 2.1 of the License, or (at your option) any later version.

This library is distributed in the hope that it will be useful,
but WITHOUT ANY WARRANTY; without even the implied warranty of
MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE.  See the GNU
Lesser General Public License for more details.""",
        "AGPL-3.0-or-later": """This program is free software: you can redistribute it and/or modify
it under the terms of the GNU Affero General Public License as published
by the Free Software Foundation, either version 3 of the License, or
(at your option) any later version.""",
        "Zlib": """This software is provided 'as-is', without any express or implied
warranty. In no event will the authors be held liable for any damages
arising from the use of this software.

Permission is granted to anyone to use this software for any purpose,
including commercial applications, and to alter it and redistribute it
freely, subject to the following restrictions:

1. The origin of this software must not be misrepresented.""",
        "MIT": """MIT License

Copyright (c) 2020 Someone

Permission is hereby granted, free of charge, to any person obtaining a copy
of this software and associated documentation files (the "Software"), to deal
in the Software without restriction, including without limitation the rights
to use, copy, modify, merge, publish, distribute, sublicense, and/or sell
copies of the Software, and to permit persons to whom the Software is
furnished to do so, subject to the following conditions:

The above copyright notice and this permission notice shall be included in all
copies or substantial portions of the Software.

THE SOFTWARE IS PROVIDED "AS IS", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR
IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY,
FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL THE
AUTHORS BE LIABLE.""",
        "BSD-2-Clause": """Redistribution and use in source and binary forms, with or without
modification, are permitted provided that the following conditions are met:

1. Redistributions of source code must retain the above copyright notice, this
   list of conditions and the following disclaimer.

2. Redistributions in binary form must reproduce the above copyright notice,
   this list of conditions and the following disclaimer in the documentation
   and/or other materials provided with the distribution.""",
        "Unlicense": "SPDX-License-Identifier: Unlicense",
    }
    rows = []
    for i, text in enumerate(notices.values()):
        rows += [(10 * i + k, "\n".join(mark + line for line in text.split("\n")), None, None) for k, mark in enumerate(("", "# ", " * ", "// "))]
    got = {r.doc_id: r.licenses for r in licenses.scan(table(spark, rows)).collect()}
    assert got == {10 * i + k: name for i, name in enumerate(notices) for k in range(4)}


def test_very_long_texts(spark):
    text = "word " * 300_000 + "\nLicensed under the MIT License.\n" + "more\n" * 100_000
    r = licenses.scan(table(spark, [(1, text, None, None), (1, text, None, None)])).collect()
    assert [(x.licenses, x.n_known) for x in r] == [("MIT", 1)] * 2


def test_water_filling():
    got = mixing.targets({"a": 10, "b": 100, None: 1000}, {"a": 10.0, "b": 1.0, None: 1.0}, 1110, 3)
    assert got["a"] == 30 and abs(got["b"] - 300) < 1e-9 and abs(got[None] - 780) < 1e-9


@pytest.mark.parametrize("schedule", [*mixing.CURRICULUM, ((0.2, 1.0), (0.5, 3.0), (0.9, 0.0))])
def test_inverting_a_schedule(schedule):
    t, w = mixing._knots(schedule)
    share = np.linspace(0, 1, 101)
    at = mixing.invert(schedule, share)
    grid = np.linspace(0, 1, 200_001)
    area = np.cumsum(np.interp(grid, t, w))
    assert (np.diff(at) >= -1e-12).all()
    assert np.abs(np.interp(at, grid, area / area[-1]) - share).max() < 1e-3


def test_mix_takes_near_targets(spark, edges):
    docs = table(spark, edges)
    rows = mixing.mix(docs, mixing.in_turn, mixing.word_count(F.col("text"))).collect()
    assert len(rows) == len(edges) and sum(r["size"] for r in rows) > 0
    for s in {r.source for r in rows}:
        mine = [r for r in rows if r.source == s]
        assert all(r.taken <= 3 * r["size"] for r in mine) and mine[0].target <= 3 * mine[0].source_size
        assert abs(sum(r.taken for r in mine) - mine[0].target) <= max(r["size"] for r in mine) / 2 + 1e-6
        assert all(r.positions == sorted(r.positions) for r in mine)
    assert sum({r.source: r.target for r in rows}.values()) == pytest.approx(sum(r["size"] for r in rows))
    again = mixing.mix(docs.repartition(3), mixing.in_turn, mixing.word_count(F.col("text"))).collect()
    assert sorted(map(str, rows)) == sorted(map(str, again))
    assert mixing.mix(table(spark, []), mixing.in_turn, mixing.word_count(F.col("text"))).count() == 0


def test_mixed_rows_repeat_documents(spark, edges):
    docs = table(spark, edges)
    takes = mixing.mix(docs, mixing.in_turn, mixing.word_count(F.col("text"))).select(F.sum(F.size("positions"))).first()[0]
    out = mixing.mixed_rows(docs, mixing.in_turn, mixing.word_count(F.col("text")))
    assert out.columns == docs.columns and out.count() == takes
    assert out.where("row <> 'row' OR `at` <> 'at' OR one <> 'one' OR `a.b` <> 'a.b'").count() == 0
    assert mixing.mixed_rows(table(spark, []), mixing.in_turn, mixing.word_count(F.col("text"))).count() == 0


def test_boundaries_are_optimal():
    rng = random.Random(1)
    for _ in range(60):
        lengths = sorted(rng.sample(range(1, 60), rng.randint(1, 9)))
        counts = [rng.randint(1, 20) for _ in lengths]
        k = rng.randint(1, 5)

        def padding(tops):
            return sum(c * (min(t for t in tops if t >= x) - x) for x, c in zip(lengths, counts, strict=True))

        best = min(padding((*some, lengths[-1])) for n in range(k) for some in itertools.combinations(lengths[:-1], n) if n < len(lengths))
        got = packing.boundaries(lengths, counts, k)
        assert len(got) <= k and padding(got) == best


def test_bins_round_up_little(spark):
    rows = spark.createDataFrame([(x,) for x in [1, 511, 512, 513, 1023, 1025, 99_999, 123_456_789]], "x long").select("x", packing.binned(F.col("x")).alias("b")).collect()
    assert all(r.x <= r.b <= r.x * (1 + 1 / 256) for r in rows) and all(r.b == r.x for r in rows if r.x <= 512)


def test_packing_fills_batches(spark, edges):
    docs = table(spark, edges)
    rows = packing.pack(docs, mixing.word_count(F.col("text")), buckets=4, budget=200).collect()
    assert len(rows) == len(edges)
    seen = set()
    for r in rows:
        assert r.n_tokens <= r.bucket_tokens and 0 <= r.slot < r.batch_docs
        assert r.batch_docs == max(1, 200 // max(1, r.bucket_tokens))
        seen.add((r.bucket, r.batch, r.slot))
    assert len(seen) == len(rows)
    for b in {r.bucket for r in rows}:
        mine = sorted((r.batch, r.slot) for r in rows if r.bucket == b)
        full = next(r.batch_docs for r in rows if r.bucket == b)
        assert mine == [(i // full, i % full) for i in range(len(mine))]
    assert packing.pack(table(spark, []), mixing.word_count(F.col("text"))).count() == 0


def _pages(spark, rows):
    return spark.createDataFrame([(i, u, h, "x", 1.0) for i, u, h in rows], "page_id long, url string, html string, host string, rank double")


def test_url_parts_and_rules(spark):
    rows = [
        (1, "HTTP://A.Example.ORG/es/1?x#y", ""), (2, "http://example.org/en/12", None), (3, "https://x.com?u=/fr/", ""), (4, "https://x.com/fr/a", ""),
        (5, None, ""), (6, "no scheme", ""), (7, "x://a://b/c", ""), (7, "x://a://b/c", ""), (8, "http://org", ""), (9, "http://notorg/x", ""),
    ]
    got = {r.page_id: r for r in urlgraph.judge(_pages(spark, rows)).collect()}
    assert (got[1].host, got[1].path, got[1].rule, got[1].verdict) == ("a.example.org", "/es/1", "example.org/es/", "block")
    assert (got[2].rule, got[2].verdict) == ("example.org/en/1", "block")
    assert (got[3].host, got[3].path, got[3].rule) == ("x.com", "", None)
    assert (got[4].rule, got[4].verdict) == ("com/fr/", "allow")
    assert (got[5].host, got[5].path, got[5].verdict) == (got[6].host, got[6].path, got[6].verdict) == ("", "", "allow")
    assert (got[7].host, got[7].path) == ("a:", "//b/c")
    assert got[8].rule is None and got[9].rule is None
    assert urlgraph.judge(_pages(spark, rows)).count() == len(rows)
    assert urlgraph.judge(_pages(spark, [])).count() == 0


def test_distrust_flows_to_linking_hosts(spark):
    link = '<a href="{}">x</a>'.format
    rows = [
        (1, "http://bad.com/de/1", ""), (2, "http://good.org/", link("//ally.net/a")), (3, "http://shady.net/1", link("http://bad.com/de/2") + link("/own")),
        (4, "http://ally.net/1", ""), (5, "http://lone.net/1", "<a href=/x>"),
    ]
    got = {r.page_id: r.verdict for r in urlgraph.judge(_pages(spark, rows)).collect()}
    assert got == {1: "block", 2: "allow", 3: "block", 4: "allow", 5: "allow"}


def dense_ranks(n, edges, seeds):
    """The walk's linear system, solved as a whole."""
    m, v = np.zeros((n, n)), np.zeros(n)
    for a, b, w in edges:
        m[b, a] += w
    total = m.sum(0)
    for node, share in seeds:
        v[node] = share
    return np.linalg.solve(np.eye(n) - 0.85 * m / np.where(total == 0, 1, total), 0.15 * v)


def test_ranks_solve_the_linear_system(spark):
    rng = random.Random(5)
    pairs = {(rng.randrange(9), rng.randrange(9)) for _ in range(30)}
    edges = [(a, b, float(1 + (a * b) % 3)) for a, b in pairs]
    assert any(a == b for a, b, _ in edges)
    rows = spark.createDataFrame([("trust", str(a), str(b), w) for a, b, w in edges], "side string, src string, dst string, weight double")
    seeds = spark.createDataFrame([("trust", "0", 0.75), ("trust", "3", 0.25)], "side string, node string, share double")
    got = {r.node: r["rank"] for r in urlgraph.ranks(rows, seeds).collect()}
    want = dense_ranks(9, edges, [(0, 0.75), (3, 0.25)])
    assert max(abs(got.get(str(i), 0.0) - want[i]) for i in range(9)) < 1e-6


@pytest.mark.parametrize("sent", [100_000, 0])
def test_verdicts_of_a_link_graph(spark, monkeypatch, sent):
    """Whole verdicts against the dense solution; most hosts have no rule and are told by links alone."""
    monkeypatch.setattr(urlgraph, "MOST_SENT", sent)
    rng = random.Random(11)
    hosts = [f"h{i}.{'org' if i < 6 else 'net' if i < 30 else 'com'}" for i in range(36)]
    rows, edges = [], []
    for i, h in enumerate(hosts):
        html = ["<p>text</p>"]
        for _ in range(rng.randint(0, 5)):
            j = rng.randrange(36)
            form = rng.choice(['<a href="http://{}/x">', "<img src='//{}/i.png'>", "<form action=HTTPS://{}?q>", "see http://{}/bare now"])
            html.append(form.format(hosts[j].upper()))
            edges.append((i, j, 1.0))
        for _ in range(rng.randint(0, 2)):
            html.append(rng.choice(['<a href="/own">', "<a href=next.html>", '<img src="pic.png">']))
            edges.append((i, i, 1.0))
        html.append('<a href="#top"><a href="mailto:a@b.c"><a href="javascript:go()">')
        rows.append((i, f"http://{h}/{'de/' if h.endswith('com') else ''}{i}", " ".join(html)))
    kinds = ["allow" if h.endswith("org") else "block" if h.endswith("com") else None for h in hosts]
    seeds = lambda kind: [(i, 1 / kinds.count(kind)) for i in range(36) if kinds[i] == kind]
    trust, distrust = dense_ranks(36, edges, seeds("allow")), dense_ranks(36, [(b, a, w) for a, b, w in edges], seeds("block"))
    want = {i: kinds[i] or ("block" if distrust[i] > trust[i] else "allow") for i in range(36)}
    assert {want[i] for i in range(36) if kinds[i] is None} == {"allow", "block"}
    assert {r.page_id: r.verdict for r in urlgraph.judge(_pages(spark, rows)).collect()} == want


def test_family_ties_are_an_option(spark):
    rows = [(1, "http://bad.com/de/1", ""), (2, "http://sub.bad.com/x", "")]
    verdict = lambda ties: {r.page_id: r.verdict for r in urlgraph.judge(_pages(spark, rows), ties=ties).collect()}
    assert verdict(False) == {1: "block", 2: "allow"} and verdict(True) == {1: "block", 2: "block"}


def test_long_urls_and_pages(spark):
    rows = [(1, "http://a.net/" + "x" * 200_000, "<a href=/b>" * 20_000), (1, "http://a.net/" + "x" * 200_000, "<a href=/b>" * 20_000)]
    got = urlgraph.judge(_pages(spark, rows)).collect()
    assert [(r.host, len(r.path), r.verdict) for r in got] == [("a.net", 200_001, "allow")] * 2


def test_bucket_tokens_are_real_lengths(spark):
    """Above 512 the histogram rounds lengths up, but a bucket is as long as its longest document."""
    rows = [(i, "x" * n, None, None) for i, n in enumerate([513, 1025, 1025, 3001])]
    got = packing.pack(table(spark, rows), F.length("text"), buckets=3, budget=2050).collect()
    assert sorted((r.n_tokens, r.bucket_tokens, r.batch_docs) for r in got) == [(513, 513, 3), (1025, 1025, 2), (1025, 1025, 2), (3001, 3001, 1)]
