from tidemark.llm import licenses as L

MIT = ". ".join(s for i, s in L.TEXT_SENTENCES if i.startswith("mit-"))


def test_texts_notices_and_leftovers(spark):
    rows = [(1, "Intro.\nReleased under the MIT License.\nmore"), (2, "Licensed under CC BY-NC 4.0."), (3, MIT), (4, None), (5, ""), (6, "Nothing here. Or there."),
            (7, "Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer."),
            (8, "This work is licensed under the GNU General Public License, version 3.\nAll rights reserved.\nAll rights reserved."), (1, "Released under the MIT License."), (9, "x " * 100_000 + ".\nMIT License")]
    df = spark.createDataFrame([(i, t, "kept", "_ids") for i, t in rows], "doc_id long, text string, licenses_seen string, decision string")
    got = [(r.doc_id, r.licenses, r.n_sentences, r.unmatched, r.decision) for r in L.scan(df).collect()]
    assert sorted(got) == sorted([
        (1, "MIT", 1, "", "permissive"), (2, "CC-BY-NC-4.0", 1, "", "restricted"), (3, "MIT", 4, "", "permissive"), (4, "", 0, "", "none"), (5, "", 0, "", "none"), (6, "", 0, "", "none"),
        (7, "", 1, "<bsd-source>", "restricted"), (8, "All-rights-reserved,GPL-3.0", 3, "", "restricted"), (1, "MIT", 1, "", "permissive"), (9, "MIT", 1, "", "permissive")])
    assert L.scan(df).columns == ["doc_id", "text", "licenses_seen", "licenses", "n_sentences", "unmatched", "decision"]


MIT_TEXT = """MIT License

Copyright (c) 2020 Some One

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
AUTHORS OR COPYRIGHT HOLDERS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER
LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM,
OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE
SOFTWARE."""
BSD_TEXT = """Copyright 2020 Some One

Redistribution and use in source and binary forms, with or without
modification, are permitted provided that the following conditions are met:

1. Redistributions of source code must retain the above copyright notice, this
   list of conditions and the following disclaimer.
2. Redistributions in binary form must reproduce the above copyright notice,
   this list of conditions and the following disclaimer in the documentation
   and/or other materials provided with the distribution.
"""
ISC_TEXT = """Copyright 2020 Some One
Permission to use, copy, modify, and/or distribute this software for any
purpose with or without fee is hereby granted, provided that the above
copyright notice and this permission notice appear in all copies.

THE SOFTWARE IS PROVIDED "AS IS" AND THE AUTHOR DISCLAIMS ALL WARRANTIES WITH
REGARD TO THIS SOFTWARE INCLUDING ALL IMPLIED WARRANTIES OF MERCHANTABILITY
AND FITNESS. IN NO EVENT"""
GPL_TEXT = """This program is free software; you can redistribute it and/or
modify it under the terms of the GNU General Public License
as published by the Free Software Foundation; either version 2
of the License, or (at your option) any later version.

This program is distributed in the hope that it will be useful,
but WITHOUT ANY WARRANTY; without even the implied warranty of
MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE.  See the
GNU General Public License for more details."""
GPL3_TEXT = GPL_TEXT.replace("software; you", "software: you").replace("Foundation; either version 2", "Foundation, either version 3")
MPL_TEXT = """This Source Code Form is subject to the terms of the Mozilla Public
License, v. 2.0. If a copy of the MPL was not distributed with this
file, You can obtain one at"""
APACHE_TEXT = """Copyright 2020 Some One

Licensed under the Apache License, Version 2.0 (the "License");
you may not use this file except in compliance with the License.
You may obtain a copy of the License at

    http://www.apache.org/licenses/LICENSE-2.0

Unless required by applicable law or agreed to in writing, software
distributed under the License is distributed on an "AS IS" BASIS,
WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied.
See the License for the specific language governing permissions and
limitations under the License."""


def test_wrapped_standard_texts(spark):
    texts = {"MIT": (MIT_TEXT, 5), "BSD-2-Clause": (BSD_TEXT, 3), "ISC": (ISC_TEXT, 2), "GPL-2.0-or-later": (GPL_TEXT, 4), "GPL-3.0-or-later": (GPL3_TEXT, 4), "MPL-2.0": (MPL_TEXT, 1), "Apache-2.0": (APACHE_TEXT, 4)}
    rows = []
    for licence, (text, n) in texts.items():
        lines = text.split("\n")
        marked = ["/*\n" + "\n".join(f" * {x}".rstrip() for x in lines) + "\n */\nint main;", *("\n".join(f"{mark} {x}".rstrip() for x in lines) for mark in ("#", "//", "--", ";;"))]
        rows += [(licence, n, t) for t in [text, text.replace("\n", "\r\n"), "code here\n\n" + text + "\n\nmore", *marked]]
    df = spark.createDataFrame(rows, "want string, n long, text string")
    assert [(r.want, r.licenses, r.n_sentences, r.unmatched) for r in L.scan(df).collect() if (r.want, r.n, "") != (r.licenses, r.n_sentences, r.unmatched)] == []


def test_lines_still_end_sentences(spark):
    rows = [("Copyright 2020 X\nAll rights reserved\nMIT License\nmore", 2), ("released under\nthe MIT\nLicense", 1), ("is under\n\nthe MIT License", 0), ("under the MIT\n\nLicense", 0), ("a MIT License", 0), ("MIT License b\nGPLv3 c", 0), ("CC0 1.0\nUniversal", 1), ("MIT|License", 1)]
    got = L.scan(spark.createDataFrame(rows, "text string, n long")).collect()
    assert [(r.text, r.n_sentences) for r in got] == rows


def test_longer_rules_come_before_their_beginnings():
    seqs = [s for _, s in L.rules()]
    assert len(seqs) == len(set(seqs))
    for i, s in enumerate(seqs):
        assert not any(t.startswith(s) for t in seqs[i + 1 :])


def test_long_runs_of_end_marks(spark):
    import time

    n = 1_000_000
    texts = ["." * n, "!?" * n + "x", "All rights reserved" + "." * n, ("." * 1000 + "x") * 500, "x" + ". " * n, ";" * n + " All rights reserved."]
    df = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "doc_id int, text string")
    started = time.perf_counter()
    got = {r.doc_id: r.licenses for r in L.scan(df).collect()}
    assert [i for i in got if got[i]] == [2, 5] and time.perf_counter() - started < 120
