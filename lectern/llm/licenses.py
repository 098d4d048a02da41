"""Licence scans: sentences to known identifiers, identifier sequences to licences, in DataFrame functions only.

Every text is cut into sentences at line ends and after ``.``, ``!`` or ``?`` before white space. A sentence is
normalised (A-Z lower-cased, all but a-z and 0-9 to single spaces, trimmed) and looked up among the known
sentences. A sentence may also run over line ends, as in hard-wrapped notices; comment leaders there go with all that
is not a letter or digit. The SQL knows sentences of one line only. What is found, in text order, is the text's
identifier sequence; ordered rules then take their identifiers out of it, each rule what earlier ones left.

All of it is row-local: no shuffle, no join, nothing that grows with the data is broadcast.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lectern.llm.names import free

# Normalised sentences of public licence texts and notices, with this module's identifiers.
SENTENCES: dict[str, str] = {
    "licensed under the apache license version 2 0": "apache_ref",
    "you may not use this file except in compliance with the license": "apache_use",
    "you may obtain a copy of the license at http www apache org licenses license 2 0": "apache_copy",
    "unless required by applicable law or agreed to in writing software distributed under the license is distributed on an as is basis without warranties or conditions of any kind either express or implied": "apache_warranty",
    "see the license for the specific language governing permissions and limitations under the license": "apache_see",
    "spdx license identifier apache 2 0": "apache_spdx",
    "released under the mit license": "mit_ref",
    "licensed under the mit license": "mit_ref",
    "mit license": "mit_title",
    "the mit license mit": "mit_title",
    "spdx license identifier mit": "mit_spdx",
    "permission is hereby granted free of charge to any person obtaining a copy of this software and associated documentation files the software to deal in the software without restriction including without limitation the rights to use copy modify merge publish distribute sublicense and or sell copies of the software and to permit persons to whom the software is furnished to do so subject to the following conditions": "mit_grant",
    "the above copyright notice and this permission notice shall be included in all copies or substantial portions of the software": "mit_notice",
    "the software is provided as is without warranty of any kind express or implied including but not limited to the warranties of merchantability fitness for a particular purpose and noninfringement": "mit_warranty",
    "redistribution and use in source and binary forms with or without modification are permitted provided that the following conditions are met": "bsd_grant",
    "redistributions of source code must retain the above copyright notice this list of conditions and the following disclaimer": "bsd_source",
    "redistributions in binary form must reproduce the above copyright notice this list of conditions and the following disclaimer in the documentation and or other materials provided with the distribution": "bsd_binary",
    "neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission": "bsd_names",
    "this work is licensed under the gnu general public license version 3": "gpl3_ref",
    "licensed under the gnu general public license version 3": "gpl3_ref",
    "this program is free software you can redistribute it and or modify it under the terms of the gnu general public license as published by the free software foundation either version 3 of the license or at your option any later version": "gpl3_grant",
    "this program is free software you can redistribute it and or modify it under the terms of the gnu general public license as published by the free software foundation either version 2 of the license or at your option any later version": "gpl2_grant",
    "this program is distributed in the hope that it will be useful but without any warranty without even the implied warranty of merchantability or fitness for a particular purpose": "gpl_warranty",
    "see the gnu general public license for more details": "gpl_see",
    "spdx license identifier gpl 3 0 or later": "gpl3_spdx",
    "licensed under cc by nc 4 0": "ccbync_ref",
    "licensed under cc by 4 0": "ccby_ref",
    "licensed under cc by sa 4 0": "ccbysa_ref",
    "this work is licensed under a creative commons attribution 4 0 international license": "ccby_ref",
    "this work is licensed under a creative commons attribution sharealike 4 0 international license": "ccbysa_ref",
    "this work is licensed under a creative commons attribution noncommercial 4 0 international license": "ccbync_ref",
    "permission to use copy modify and or distribute this software for any purpose with or without fee is hereby granted provided that the above copyright notice and this permission notice appear in all copies": "isc_grant",
    "the software is provided as is and the author disclaims all warranties with regard to this software including all implied warranties of merchantability and fitness": "isc_warranty",
    "this source code form is subject to the terms of the mozilla public license v": "mpl2_ref",
    "if a copy of the mpl was not distributed with this file you can obtain one at https mozilla org mpl 2 0": "mpl2_copy",
    "if a copy of the mpl was not distributed with this file you can obtain one at http mozilla org mpl 2 0": "mpl2_copy",
    "this program is free software you can redistribute it and or modify it under the terms of the gnu general public license version 2 as published by the free software foundation": "gpl2only_grant",
    "this program is free software you can redistribute it and or modify it under the terms of the gnu general public license version 3 as published by the free software foundation": "gpl3only_grant",
    "this library is free software you can redistribute it and or modify it under the terms of the gnu lesser general public license as published by the free software foundation either version 2 1 of the license or at your option any later version": "lgpl21_grant",
    "this library is free software you can redistribute it and or modify it under the terms of the gnu lesser general public license as published by the free software foundation either version 3 of the license or at your option any later version": "lgpl3_grant",
    "this program is free software you can redistribute it and or modify it under the terms of the gnu lesser general public license as published by the free software foundation either version 3 of the license or at your option any later version": "lgpl3_grant",
    "this library is distributed in the hope that it will be useful but without any warranty without even the implied warranty of merchantability or fitness for a particular purpose": "lgpl_warranty",
    "see the gnu lesser general public license for more details": "lgpl_see",
    "this program is free software you can redistribute it and or modify it under the terms of the gnu affero general public license as published by the free software foundation either version 3 of the license or at your option any later version": "agpl3_grant",
    "see the gnu affero general public license for more details": "agpl_see",
    "this is free and unencumbered software released into the public domain": "unlicense_ref",
    "anyone is free to copy modify publish use compile sell or distribute this software either in source code form or as a compiled binary for any purpose commercial or non commercial and by any means": "unlicense_grant",
    "to the extent possible under law the author s have dedicated all copyright and related and neighboring rights to this software to the public domain worldwide": "cc0_grant",
    "this software is distributed without any warranty": "cc0_warranty",
    "this software is provided as is without any express or implied warranty": "zlib_warranty",
    "in no event will the authors be held liable for any damages arising from the use of this software": "zlib_damages",
    "permission is granted to anyone to use this software for any purpose including commercial applications and to alter it and redistribute it freely subject to the following restrictions": "zlib_grant",
    "distributed under the boost software license version 1 0": "bsl_ref",
    "spdx license identifier bsd 3 clause": "bsd3_spdx",
    "spdx license identifier bsd 2 clause": "bsd2_spdx",
    "spdx license identifier isc": "isc_spdx",
    "spdx license identifier mpl 2 0": "mpl2_spdx",
    "spdx license identifier gpl 2 0 or later": "gpl2_spdx",
    "spdx license identifier gpl 2 0 only": "gpl2only_spdx",
    "spdx license identifier gpl 3 0 only": "gpl3only_spdx",
    "spdx license identifier lgpl 2 1 or later": "lgpl21_spdx",
    "spdx license identifier agpl 3 0 or later": "agpl3_spdx",
    "spdx license identifier unlicense": "unlicense_spdx",
    "spdx license identifier cc0 1 0": "cc0_spdx",
    "spdx license identifier zlib": "zlib_spdx",
    "spdx license identifier bsl 1 0": "bsl_spdx",
    "all rights reserved": "reserved",
}

# Published wordings that hold several known sentences in one, with their identifiers in order.
WORDINGS: dict[str, tuple[str, ...]] = {
    "licensed under the apache license version 2 0 the license you may not use this file except in compliance with the license": ("apache_ref", "apache_use"),
}

# Fixed values: (licence, class, identifiers that follow one another); earlier rules come first.
RULES: list[tuple[str, str, tuple[str, ...]]] = [
    ("Apache-2.0", "permissive", ("apache_ref", "apache_use", "apache_copy", "apache_warranty", "apache_see")),
    ("Apache-2.0", "permissive", ("apache_ref", "apache_use", "apache_copy", "apache_warranty")),
    ("MIT", "permissive", ("mit_title", "mit_grant", "mit_notice", "mit_warranty")),
    ("MIT", "permissive", ("mit_grant", "mit_notice", "mit_warranty")),
    ("BSD-3-Clause", "permissive", ("bsd_grant", "bsd_source", "bsd_binary", "bsd_names")),
    ("BSD-2-Clause", "permissive", ("bsd_grant", "bsd_source", "bsd_binary")),
    ("GPL-3.0-or-later", "copyleft", ("gpl3_grant", "gpl_warranty", "gpl_see")),
    ("GPL-2.0-or-later", "copyleft", ("gpl2_grant", "gpl_warranty", "gpl_see")),
    ("GPL-2.0-only", "copyleft", ("gpl2only_grant", "gpl_warranty", "gpl_see")),
    ("GPL-3.0-only", "copyleft", ("gpl3only_grant", "gpl_warranty", "gpl_see")),
    ("LGPL-2.1-or-later", "copyleft", ("lgpl21_grant", "lgpl_warranty", "lgpl_see")),
    ("LGPL-3.0-or-later", "copyleft", ("lgpl3_grant", "lgpl_warranty", "lgpl_see")),
    ("LGPL-3.0-or-later", "copyleft", ("lgpl3_grant", "gpl_warranty", "lgpl_see")),
    ("AGPL-3.0-or-later", "copyleft", ("agpl3_grant", "gpl_warranty", "agpl_see")),
    ("MPL-2.0", "copyleft", ("mpl2_ref", "mpl2_copy")),
    ("ISC", "permissive", ("isc_grant", "isc_warranty")),
    ("Zlib", "permissive", ("zlib_warranty", "zlib_damages", "zlib_grant")),
    ("Unlicense", "permissive", ("unlicense_ref", "unlicense_grant")),
    ("CC0-1.0", "permissive", ("cc0_grant", "cc0_warranty")),
    ("Apache-2.0", "permissive", ("apache_ref",)),
    ("Apache-2.0", "permissive", ("apache_spdx",)),
    ("MIT", "permissive", ("mit_ref",)),
    ("MIT", "permissive", ("mit_spdx",)),
    ("MIT", "permissive", ("mit_title",)),
    ("GPL-3.0-only", "copyleft", ("gpl3_ref",)),
    ("GPL-3.0-or-later", "copyleft", ("gpl3_spdx",)),
    ("GPL-3.0-or-later", "copyleft", ("gpl3_grant",)),
    ("GPL-2.0-or-later", "copyleft", ("gpl2_grant",)),
    ("GPL-2.0-or-later", "copyleft", ("gpl2_spdx",)),
    ("GPL-2.0-only", "copyleft", ("gpl2only_grant",)),
    ("GPL-2.0-only", "copyleft", ("gpl2only_spdx",)),
    ("GPL-3.0-only", "copyleft", ("gpl3only_grant",)),
    ("GPL-3.0-only", "copyleft", ("gpl3only_spdx",)),
    ("LGPL-2.1-or-later", "copyleft", ("lgpl21_grant",)),
    ("LGPL-2.1-or-later", "copyleft", ("lgpl21_spdx",)),
    ("LGPL-3.0-or-later", "copyleft", ("lgpl3_grant",)),
    ("AGPL-3.0-or-later", "copyleft", ("agpl3_grant",)),
    ("AGPL-3.0-or-later", "copyleft", ("agpl3_spdx",)),
    ("MPL-2.0", "copyleft", ("mpl2_ref",)),
    ("MPL-2.0", "copyleft", ("mpl2_spdx",)),
    ("BSD-3-Clause", "permissive", ("bsd3_spdx",)),
    ("BSD-2-Clause", "permissive", ("bsd2_spdx",)),
    ("ISC", "permissive", ("isc_grant",)),
    ("ISC", "permissive", ("isc_spdx",)),
    ("Zlib", "permissive", ("zlib_grant",)),
    ("Zlib", "permissive", ("zlib_spdx",)),
    ("Unlicense", "permissive", ("unlicense_ref",)),
    ("Unlicense", "permissive", ("unlicense_spdx",)),
    ("CC0-1.0", "permissive", ("cc0_grant",)),
    ("CC0-1.0", "permissive", ("cc0_spdx",)),
    ("BSL-1.0", "permissive", ("bsl_ref",)),
    ("BSL-1.0", "permissive", ("bsl_spdx",)),
    ("CC-BY-NC-4.0", "restricted", ("ccbync_ref",)),
    ("CC-BY-SA-4.0", "copyleft", ("ccbysa_ref",)),
    ("CC-BY-4.0", "permissive", ("ccby_ref",)),
    ("LicenseRef-AllRightsReserved", "restricted", ("reserved",)),
]

# Classes from the most to the least binding.
CLASSES = ("restricted", "copyleft", "permissive")

_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
_STOP = r"[.!?]+[\x09-\x0D\x20]+|[\x0A-\x0D]+"
_END, _LINE = r"[.!?]+[\x09-\x0D\x20]+", r"[\x0A-\x0D]+"
_OTHER = r"[^a-z0-9]+"


def runs_of_lines(text: Column, known: Sequence[str]) -> Column:
    """The known sentences in text order, each a whole run of pieces between stops: one, or several that line ends part."""
    low = F.translate(F.coalesce(text, F.lit("")), _UPPER, _LOWER)
    # stops become S and line ends L, as no upper-case letter is left
    marked = F.regexp_replace(F.regexp_replace(low, _END, "S"), _LINE, "L")
    flat = F.regexp_replace(F.regexp_replace(marked, "[^a-z0-9SL]+", " "), "[ L]*S[ SL]*", "S")
    flat = F.regexp_replace(flat, " *L[ L]*", "L")
    any_of = "|".join(k.replace(" ", "[ L]") for k in sorted(known, key=len, reverse=True))
    found = F.regexp_extract_all(F.trim(flat), F.lit(f"(?<![^SL])(?:{any_of})(?![^SL])"), F.lit(0))
    return F.transform(found, lambda s: F.translate(s, "L", " "))


def scan(
    docs: DataFrame,
    text: str = "text",
    known: Mapping[str, str] = SENTENCES,
    rules: Sequence[tuple[str, str, tuple[str, ...]]] = RULES,
    wordings: Mapping[str, tuple[str, ...]] = WORDINGS,
) -> DataFrame:
    """``docs`` with n_known long, sentence_ids, licenses and verdict string, all rows kept.

    ``sentence_ids``: identifiers of the known sentences in text order, joined by ``|`` (none: empty).
    ``licenses``: licences whose rules matched, distinct, in the order of first rules, joined by ``|`` (none: empty).
    ``verdict``: the most binding class among them; ``unclear`` where sentences were known but no rule matched;
    ``none`` where none was known. Null and empty texts: 0, empty, empty, ``none``. Repeated rows stay repeated.
    A very long text is scanned whole. Columns of ``docs`` with one of the four names are replaced; other columns pass
    unread, whatever their names.
    """
    own, hit = free(docs, "ids", "hits")
    all_known = {k: (v,) for k, v in known.items()} | dict(wordings)
    table = F.create_map(*[x for k, v in all_known.items() for x in (F.lit(k), F.array(*[F.lit(i) for i in v]))])
    ids = F.flatten(F.transform(runs_of_lines(F.col(text), list(all_known)), lambda s: F.try_element_at(table, s)))
    # every identifier stands between bars of its own: |a||b||c|
    left = F.concat(F.lit("|"), F.array_join(F.transform(own, lambda x: F.concat(x, F.lit("|"))), "|"))
    runs = F.array(*[F.struct(F.lit("".join(f"|{x}|" for x in seq)).alias("run"), F.lit(name).alias("name"), F.lit(kind).alias("kind")) for name, kind, seq in rules])
    nothing = F.array().cast("array<struct<name:string,kind:string>>")

    def apply(acc: Column, rule: Column) -> Column:
        found = F.when(F.contains(acc["left"], rule["run"]), F.array(F.struct(rule["name"], rule["kind"]))).otherwise(nothing)
        return F.struct(F.replace(acc["left"], rule["run"], F.lit("|#|")).alias("left"), F.concat(acc["hits"], found).alias("hits"))

    hits = F.aggregate(runs, F.struct(left.alias("left"), nothing.alias("hits")), apply, lambda acc: acc["hits"])
    out = docs.withColumn(own, ids).withColumn(hit, F.when(F.size(own) > 0, hits).otherwise(nothing))
    verdict = F.when(F.size(own) == 0, F.lit("none"))
    for kind in CLASSES:
        verdict = verdict.when(F.array_contains(f"{hit}.kind", kind), F.lit(kind))
    names = dict.fromkeys(name for name, _, _ in rules)
    return (
        out.withColumn("n_known", F.size(own).cast("long"))
        .withColumn("sentence_ids", F.array_join(own, "|"))
        .withColumn("licenses", F.concat_ws("|", *[F.when(F.array_contains(f"{hit}.name", n), F.lit(n)) for n in names]))
        .withColumn("verdict", verdict.otherwise(F.lit("unclear")))
        .drop(own, hit)
    )


def scan_sql(known: Mapping[str, str] = SENTENCES, rules: Sequence[tuple[str, str, tuple[str, ...]]] = RULES) -> str:
    """DuckDB SQL for :func:`scan` over documents: doc_id and the four columns."""
    values = ", ".join(f"('{k}', '{v}')" for k, v in known.items())
    steps, before, cols = [], "seq", []
    for i, (licence, kind, seq) in enumerate(rules):
        run = "".join(f"|{x}|" for x in seq)
        steps.append(f"r{i} AS (SELECT *, CASE WHEN contains(left_{i}, '{run}') THEN '{kind}:{licence}' END AS hit_{i}, replace(left_{i}, '{run}', '|#|') AS left_{i + 1} FROM {before})")
        before = f"r{i}"
        cols.append(f"hit_{i}")
    kinds = " ".join(f"WHEN list_contains(kinds, '{k}') THEN '{k}'" for k in CLASSES)
    names = list(dict.fromkeys(licence for licence, _, _ in rules))
    found = ", ".join("CASE WHEN " + " OR ".join(f"hit_{i} IS NOT NULL" for i, r in enumerate(rules) if r[0] == n) + f" THEN '{n}' END" for n in names)
    return f"""
WITH known(sentence, id) AS (VALUES {values}),
cut AS (SELECT doc_id, string_split(regexp_replace(translate(coalesce(text, ''), '{_UPPER}', '{_LOWER}'), '{_STOP}', chr(10), 'g'), chr(10)) AS parts FROM documents),
flat AS (SELECT doc_id, unnest(parts) AS part, generate_subscripts(parts, 1) AS pos FROM cut),
norm AS (SELECT doc_id, pos, trim(regexp_replace(part, '{_OTHER}', ' ', 'g')) AS sentence FROM flat),
found AS (SELECT doc_id, count(*)::BIGINT AS n_known, string_agg(id, '|' ORDER BY pos) AS sentence_ids, string_agg('|' || id || '|', '' ORDER BY pos) AS seq FROM norm JOIN known USING (sentence) GROUP BY doc_id),
seq AS (SELECT d.doc_id, coalesce(n_known, 0)::BIGINT AS n_known, coalesce(sentence_ids, '') AS sentence_ids, coalesce(seq, '') AS left_0 FROM documents d LEFT JOIN found f ON d.doc_id = f.doc_id),
{", ".join(steps)},
kind AS (SELECT *, [split_part(x, ':', 1) FOR x IN [{", ".join(cols)}] IF x IS NOT NULL] AS kinds, concat_ws('|', {found}) AS licenses FROM {before})
SELECT doc_id, n_known, sentence_ids, licenses, CASE WHEN n_known = 0 THEN 'none' {kinds} ELSE 'unclear' END AS verdict FROM kind
"""
