import random
import re
from collections import Counter, defaultdict

import numpy as np

from tidemark.llm import collocations as C


def slow(rows, min_count, percent=100, top=2000):
    """The rule as it is written, over all phrases."""
    f, n = defaultdict(Counter), Counter()
    for lang, text in rows:
        lang, text = "und" if lang is None else lang, re.sub("[A-Z]", lambda m: m[0].lower(), text or "")
        for piece in re.split(r"[.,;:!?\x0A-\x0D]", text):
            w = re.findall(r"[^\x20\x09]+", piece)
            n[lang] += len(w)
            for k in range(1, 6):
                f[lang].update(tuple(w[i : i + k]) for i in range(len(w) - k + 1))
    out = []
    for lang, counts in f.items():
        found = {p: a for p, a in counts.items() if len(p) > 1 and a >= min_count}
        inside = lambda p, q: any(q[i : i + len(p)] == p for i in range(len(q) - len(p) + 1))
        ranked = []
        for p, a in found.items():
            if any(len(q) > len(p) and inside(p, q) and 100 * b >= percent * a for q, b in found.items()):
                continue
            score, k = min((1000 * a * n[lang] // (counts[p[:k]] * counts[p[k:]]), k) for k in range(1, len(p)))
            ranked.append((-score, -a, " ".join(p).encode(), counts[p[:k]], counts[p[k:]]))
        for rank, (score, a, p, left, right) in enumerate(sorted(ranked)[:top], 1):
            out.append((lang, rank, p.decode(), -a, left, right, n[lang], -score))
    return sorted(out)


def texts(seed, n):
    rng = random.Random(seed)
    words = ["New", "york", "CITY", "the", "of", "é", "ÉA", "state", "x\xa0y", "in", "a"]
    rows = [("en", None), (None, "New york"), ("en", ""), ("", " \t "), (None, ""), ("fr", "a\x0bb\rc\nd\x1fe")]
    for _ in range(n):
        said = rng.choices(words, k=rng.randint(0, 30))
        if rng.random() < 0.5:
            said += ["united", "states", "of", "america"] * rng.randint(1, 3)
        rows.append((rng.choice(["en", "en", "fr", None]), "".join(w + rng.choice([" ", " ", " ", "\t", "  ", ". ", ",", "\n"]) for w in said)))
    return rows + rows[:40]


def rows_of(df):
    return sorted(map(tuple, df.collect()))


def test_against_all_phrases(spark):
    rows = texts(1, 150)
    docs = spark.createDataFrame([(i, *r, "c") for i, r in enumerate(rows)], "doc_id int, lang string, text string, phrase string")
    assert rows_of(C.collocations(docs, min_count=5)) == slow(rows, 5)
    assert rows_of(C.collocations(docs, min_count=3, subsumed_percent=70, top=9)) == slow(rows, 3, 70, 9)


def test_small_flushes_split_stripes_and_full_sketches(spark, monkeypatch):
    rows = texts(2, 80)
    docs = spark.createDataFrame(rows, "lang string, text string").repartition(3)
    want = slow(rows, 4)
    monkeypatch.setattr(C, "FLUSH_WORDS", 60)
    monkeypatch.setattr(C, "PART_OCCURRENCES", 8)
    monkeypatch.setattr(C, "BLOCK_WORDS", 3)
    assert rows_of(C.collocations(docs, min_count=4)) == want
    build = C.Sketch.build
    monkeypatch.setattr(C.Sketch, "build", staticmethod(lambda *a: C.Sketch(np.maximum(build(*a).slots, 1))))
    assert rows_of(C.collocations(docs, min_count=4)) == want


def test_many_texts_in_small_batches(spark):
    rows = [("en", "good morning all. good morning")] * 2500
    docs = spark.createDataFrame(rows, "lang string, text string").repartition(2)
    assert rows_of(C.collocations(docs)) == slow(rows, 100)


def test_products_beyond_64_bits(spark):
    """The decimals of the score hold counts of 10^15 words."""
    row = spark.sql("SELECT cast(a as decimal(16,0)) * cast(n as decimal(18,0)) x, a, n, l, r FROM VALUES (900000000000001L, 90000000000000007L, 900000000000003L, 900000000000002L) AS t(a, n, l, r)")
    got = row.selectExpr("(cast(x as decimal(34,0)) * cast(1000 as decimal(4,0))) div (cast(l as decimal(18,0)) * cast(r as decimal(18,0))) AS s").first().s
    assert got == 1000 * 900000000000001 * 90000000000000007 // (900000000000003 * 900000000000002)


def test_no_texts(spark):
    assert C.collocations(spark.createDataFrame([], "lang string, text string")).collect() == []
    assert C.collocations(spark.createDataFrame([(None, None)], "lang string, text string"), min_count=1).collect() == []
