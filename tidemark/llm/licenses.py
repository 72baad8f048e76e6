"""Licence scans by sentence rules. DataFrame functions only.

A text is cut into sentences and normalised (A-Z to lower case, every run of other characters than a-z and 0-9 to one space). A
sentence ends at a full stop or the like before white space and at a blank line; a line end, with the comment marks (no letters or
digits) around it, may end a sentence or stand inside a wrapped one. Known licence sentences are found between such ends. Sentences
of the table that hold ends of their own ("v. 2.0") go through the same cutter. The identifiers found, in text order, form a sequence; ordered rules consume
their own sequences from it, whole licence texts before notices, and name the licence. Identifiers that no rule consumes are
reported as unmatched. Everything happens within the row: no shuffle, whole texts, repeated rows and extra columns stay as they are.

Null texts count as empty and hold no licence. A sentence given twice is found twice. Licences are named once each, in the order of the rules.
"""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Sentences of licence texts (fixed values), by identifier.
TEXT_SENTENCES = [
    ("mit-grant", 'Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the "Software"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions'),
    ("mit-notice", "The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software"),
    ("mit-as-is", 'THE SOFTWARE IS PROVIDED "AS IS", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT'),
    ("mit-liability", "IN NO EVENT SHALL THE AUTHORS OR COPYRIGHT HOLDERS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE"),
    ("bsd-grant", "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met"),
    ("bsd-source", "Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer"),
    ("bsd-binary", "Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution"),
    ("bsd-endorse", "Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission"),
    ("isc-grant", "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies"),
    ("isc-as-is", 'THE SOFTWARE IS PROVIDED "AS IS" AND THE AUTHOR DISCLAIMS ALL WARRANTIES WITH REGARD TO THIS SOFTWARE INCLUDING ALL IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS'),
    ("apache-licensed", 'Licensed under the Apache License, Version 2.0 (the "License")'),
    ("apache-use", "you may not use this file except in compliance with the License"),
    ("apache-law", 'Unless required by applicable law or agreed to in writing, software distributed under the License is distributed on an "AS IS" BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied'),
    ("apache-see", "See the License for the specific language governing permissions and limitations under the License"),
    ("gpl-free", "This program is free software"),
    ("gpl3-terms", "you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version"),
    ("gpl2-terms", "you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation, either version 2 of the License, or (at your option) any later version"),
    ("gpl-hope", "This program is distributed in the hope that it will be useful, but WITHOUT ANY WARRANTY"),
    ("gpl-details", "See the GNU General Public License for more details"),
    ("mpl-subject", "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0"),
    ("unlicense-public", "This is free and unencumbered software released into the public domain"),
    ("reserved", "All rights reserved"),
]
#: Other forms of text sentences, in the notices as they are published; their words are those of the table.
OTHER_FORMS = ["you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation; either version 2 of the License, or (at your option) any later version"]
#: Names by licence, as they stand in notices; the phrases around them are below.
NAMES = {
    "MIT": ["MIT License", "MIT licence", "Expat License"],
    "Apache-2.0": ["Apache License, Version 2.0", "Apache License 2.0", "Apache 2.0 License"],
    "BSD-3-Clause": ["BSD 3-Clause License", "3-Clause BSD License", "New BSD License"],
    "BSD-2-Clause": ["BSD 2-Clause License", "2-Clause BSD License", "Simplified BSD License"],
    "ISC": ["ISC License"],
    "MPL-2.0": ["Mozilla Public License, version 2.0", "Mozilla Public License 2.0", "MPL 2.0"],
    "GPL-3.0": ["GNU General Public License, version 3", "GNU General Public License v3.0", "GNU GPL v3", "GPLv3"],
    "GPL-2.0": ["GNU General Public License, version 2", "GNU General Public License v2.0", "GNU GPL v2", "GPLv2"],
    "LGPL-3.0": ["GNU Lesser General Public License, version 3", "LGPLv3"],
    "AGPL-3.0": ["GNU Affero General Public License, version 3", "AGPLv3"],
    "CC0-1.0": ["CC0 1.0", "CC0 1.0 Universal"],
}
PHRASES = ["{}", "Licensed under {}", "Licensed under the {}", "Released under {}", "Released under the {}", "This work is licensed under {}", "This work is licensed under the {}", "This project is licensed under the {}", "This software is licensed under the {}", "Distributed under the {}", "Available under the {}"]
CC_PARTS = {"BY": "Attribution", "SA": "ShareAlike", "NC": "NonCommercial", "ND": "NoDerivatives"}
CC_KINDS = ["BY", "BY-SA", "BY-NC", "BY-ND", "BY-NC-SA", "BY-NC-ND"]
CC_VERSIONS = ["3.0", "4.0"]
#: Rules over text sentences, in order.
TEXT_RULES = [
    ("MIT", ["mit-grant", "mit-notice", "mit-as-is", "mit-liability"]),
    ("MIT", ["mit-grant", "mit-notice", "mit-as-is"]),
    ("MIT", ["mit-grant", "mit-notice"]),
    ("BSD-3-Clause", ["bsd-grant", "bsd-source", "bsd-binary", "bsd-endorse"]),
    ("BSD-2-Clause", ["bsd-grant", "bsd-source", "bsd-binary"]),
    ("ISC", ["isc-grant", "isc-as-is"]),
    ("ISC", ["isc-grant"]),
    ("Apache-2.0", ["apache-licensed", "apache-use", "apache-law", "apache-see"]),
    ("Apache-2.0", ["apache-licensed", "apache-use"]),
    ("Apache-2.0", ["apache-licensed"]),
    ("GPL-3.0-or-later", ["gpl-free", "gpl3-terms", "gpl-hope", "gpl-details"]),
    ("GPL-3.0-or-later", ["gpl-free", "gpl3-terms"]),
    ("GPL-2.0-or-later", ["gpl-free", "gpl2-terms", "gpl-hope", "gpl-details"]),
    ("GPL-2.0-or-later", ["gpl-free", "gpl2-terms"]),
    ("MPL-2.0", ["mpl-subject"]),
    ("Unlicense", ["unlicense-public"]),
    ("All-rights-reserved", ["reserved"]),
]
PERMISSIVE = ["MIT", "Apache-2.0", "BSD-3-Clause", "BSD-2-Clause", "ISC", "Unlicense", "CC0-1.0", "CC-BY-3.0", "CC-BY-4.0"]

#: Sentence ends of the SQL twin, which knows no wrapped sentences.
BREAK = r"[.!?;:]+[\x20\x09-\x0D]+|\n"
#: The cutter, in order: comment marks at line starts go, sentence ends to ``|``, other characters to spaces, line ends bare, blank lines and what is around ends to ``|``.
#: A run of end marks is taken whole and from its first mark only, so that one that no white space follows costs its length once.
CUTS = [(r"\n[^a-z0-9\n]+", "\n"), (r"(?<![.!?;:])[.!?;:]++[\x20\x09-\x0D]+", "|"), (r"[^a-z0-9|\n]+", " "), (r" ?\n ?", "\n"), (r"\n\n+|[ \n]*\|[ |\n]*", "|")]
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def normal(sentence: str) -> str:
    return re.sub(r"[^a-z0-9]+", " ", sentence.translate(str.maketrans(UPPER, LOWER))).strip(" ")


def names() -> dict[str, list[str]]:
    """Names of all licences, those of Creative Commons made from their parts."""
    made = {}
    for kind in CC_KINDS:
        for version in CC_VERSIONS:
            long = "-".join(CC_PARTS[p] for p in kind.split("-"))
            made[f"CC-{kind}-{version}"] = [f"CC {kind} {version}", f"CC-{kind}-{version}", f"Creative Commons {long} {version}", f"Creative Commons {long} {version} International License", f"Creative Commons {long} {version} License"]
    return NAMES | made


def sentence_table() -> dict[str, str]:
    """Normalised sentence to identifier."""
    table = {normal(s): i for i, s in TEXT_SENTENCES}
    for licence, known in names().items():
        for name in known:
            for phrase in PHRASES:
                table.setdefault(normal(phrase.format(name)), f"name-{licence}")
    return table


def rules() -> list[tuple[str, str]]:
    """``(licence, sequence)`` in the order of use; identifiers stand in angle brackets."""
    named = [(licence, [f"name-{licence}"]) for licence in names()]
    return [(licence, "".join(f"<{i}>" for i in ids)) for licence, ids in TEXT_RULES + named]


def cut(text: str) -> str:
    """Words of a text: a space, a line end or ``|`` for a sentence end between each two."""
    text = text.translate(str.maketrans(UPPER + "|", LOWER + " "))
    for pattern, mark in CUTS:
        text = re.sub(pattern, mark, text)
    return text.strip(" ")


def sentence_pattern() -> str:
    """Finds the sentences of the table in a cut text, the longest first, as a tree over their words."""
    known = [s for _, s in TEXT_SENTENCES] + OTHER_FORMS + [p.format(n) for names_ in names().values() for n in names_ for p in PHRASES]
    tree: dict = {}
    for sentence in known:
        node = tree
        for mark, word in re.findall(r"(^|[ |])([a-z0-9]+)", cut(sentence)):
            node = node.setdefault({"": "", " ": r"[ \n]", "|": r"[ \n|]"}[mark] + word, {})
        node[""] = {}

    def branches(node: dict) -> str:
        made = [key + branches(below) for key, below in node.items() if key]
        inner = made[0] if len(made) == 1 and "" not in node else f"(?:{'|'.join(made)})" if made else ""
        return f"{inner}?" if inner and "" in node else inner

    return rf"(?<![a-z0-9 ]){branches(tree)}(?![a-z0-9 ])"


def sentence_ids(text: Column) -> Column:
    """Identifiers of the licence sentences of a text, in order, as ``<a><b>``."""
    words = F.translate(F.coalesce(text, F.lit("")), UPPER + "|", LOWER + " ")
    for pattern, mark in CUTS:
        words = F.regexp_replace(words, pattern, mark)
    known = F.regexp_extract_all(F.trim(words), F.lit(sentence_pattern()), F.lit(0))
    lookup = F.create_map(*[F.lit(x) for pair in sentence_table().items() for x in pair])
    return F.array_join(F.transform(known, lambda s: F.concat(F.lit("<"), F.element_at(lookup, F.translate(s, "\n|", "  ")), F.lit(">"))), "")


def scan(docs: DataFrame, *, text: str = "text", prefix: str = "") -> DataFrame:
    """All columns of ``docs`` with ``licenses`` (comma-joined), ``n_sentences``, ``unmatched`` and ``decision``.

    ``decision`` is none, permissive, or restricted as soon as one licence is not permissive or a known sentence is unmatched.
    """
    new = [prefix + n for n in ("licenses", "n_sentences", "unmatched", "decision")]
    base = docs.withColumn("__licence_ids", sentence_ids(F.col(text)))
    table = F.array(*[F.struct(F.lit(licence).alias("licence"), F.lit(seq).alias("seq")) for licence, seq in rules()])

    def use(acc: Column, rule: Column) -> Column:
        left = F.replace(acc["left"], rule["seq"], F.lit(""))
        hit = F.length(left) < F.length(acc["left"])
        return F.struct(left.alias("left"), F.when(hit, F.array_union(acc["found"], F.array(rule["licence"]))).otherwise(acc["found"]).alias("found"))

    start = F.struct(F.col("__licence_ids").alias("left"), F.expr("CAST(array() AS array<string>)").alias("found"))
    # most texts hold no licence sentence and never meet the rules
    out = base.withColumn("__licence_m", F.when(F.col("__licence_ids") == "", start).otherwise(F.aggregate(table, start, use)))
    found = F.col("__licence_m.found")
    restricted = (F.size(F.array_except(found, F.array(*[F.lit(p) for p in PERMISSIVE]))) > 0) | (F.col("__licence_m.left") != "")
    columns = [F.array_join(found, ","), (F.length("__licence_ids") - F.length(F.replace(F.col("__licence_ids"), F.lit("<"), F.lit("")))).cast("long"), F.col("__licence_m.left"), F.when(F.col("__licence_ids") == "", "none").when(restricted, "restricted").otherwise("permissive")]
    return out.select(*[c for c in docs.columns if c not in new], *[c.alias(n) for c, n in zip(columns, new)])


def twin_sql(source: str = "documents") -> str:
    """The scan of ``(doc_id, text)`` rows as SQL: sentences as rows, joined with the table, then the rules one after the other."""
    quote = lambda s: "'" + s.replace("'", "''") + "'"
    values = ", ".join(f"({quote(s)}, {quote(i)})" for s, i in sentence_table().items())
    steps, taken = [], []
    for k, (licence, seq) in enumerate(rules()):
        steps.append(f"replace(s{k}, {quote(seq)}, '') AS s{k + 1}")
        taken.append(f"CASE WHEN length(s{k + 1}) < length(s{k}) THEN {quote(licence)} END")
    last = len(steps)
    allowed = ", ".join(map(quote, PERMISSIVE))
    return f"""WITH known(s, id) AS (VALUES {values}),
d AS (SELECT row_number() OVER () AS r, doc_id, coalesce(text, '') AS text FROM {source}),
cut AS (SELECT r, string_split_regex(translate(text, '{UPPER}', '{LOWER}'), '{BREAK}') AS parts FROM d),
sent AS (SELECT r, unnest(parts) AS part, generate_subscripts(parts, 1) AS k FROM cut),
hit AS (SELECT r, string_agg('<' || id || '>', '' ORDER BY k) AS ids, count(*) AS n FROM sent
 JOIN known ON trim(regexp_replace(part, '[^a-z0-9]+', ' ', 'g')) = s GROUP BY r),
seq AS (SELECT d.doc_id, coalesce(ids, '') AS s0, coalesce(n, 0) AS n FROM d LEFT JOIN hit USING (r)),
used AS (SELECT *, {", ".join(steps)} FROM seq),
named AS (SELECT doc_id, s0, n, s{last} AS unmatched, [x FOR x IN [{", ".join(taken)}] IF x IS NOT NULL] AS raw FROM used),
once AS (SELECT *, [x FOR x, i IN raw IF list_position(raw, x) = i] AS found FROM named)
SELECT doc_id, array_to_string(found, ',') AS licenses, n AS n_sentences, unmatched,
 CASE WHEN s0 = '' THEN 'none' WHEN unmatched <> '' OR len([x FOR x IN found IF x NOT IN ({allowed})]) > 0 THEN 'restricted' ELSE 'permissive' END AS decision FROM once"""
