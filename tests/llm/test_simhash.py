import random

import xxhash
from pyspark.sql import functions as F

from tidemark.llm import simhash as S


def slow_fingerprint(text):
    words = S._LOWER and (text or "").encode().translate(S._LOWER).split()
    grams = [b" ".join(words[i : i + 4]) for i in range(max(1, len(words) - 3))] if words else []
    hs = [xxhash.xxh64_intdigest(g, 42) for g in grams]
    return sum(1 << b for b in range(64) if sum(h >> b & 1 for h in hs) * 2 > len(hs))


def by_hand(fps, radius=4):
    """Smallest index reachable over links."""
    comp = list(range(len(fps)))
    changed = True
    while changed:
        changed = False
        for i, a in enumerate(fps):
            for j, b in enumerate(fps):
                if comp[j] < comp[i] and (a ^ b).bit_count() <= radius:
                    comp[i], changed = comp[j], True
    return comp


def test_fingerprint_is_the_vote_of_shingles():
    for t in [None, "", "  \t", "One", "a B c", "É word\x0btwo three FOUR five", "x y z w " * 50, "same " * 9, "a\x1cb c\x85d"]:
        assert S.fingerprint(t) == slow_fingerprint(t)


def test_long_text_in_chunks(monkeypatch):
    text = " ".join(str(i * i % 97) for i in range(5000))
    whole = S.fingerprint(text)
    monkeypatch.setattr(S, "CHUNK", 333)
    assert S.fingerprint(text) == whole == slow_fingerprint(text)


def test_unary_counts_bound_the_distance(spark):
    rng = random.Random(5)
    pairs = [(a := rng.getrandbits(64), a ^ sum(1 << b for b in rng.sample(range(64), rng.randint(0, 6)))) for _ in range(300)]
    signed = lambda x: x - (1 << 64) if x >> 63 else x
    rows = spark.createDataFrame([(signed(a), signed(b)) for a, b in pairs], "a long, b long").withColumn("m", S.manhattan(S.thermometer(F.col("a")), S.thermometer(F.col("b")))).collect()
    for (a, b), r in zip(pairs, rows):
        counts = sum(abs((a >> 2 * s & 3).bit_count() - (b >> 2 * s & 3).bit_count()) for s in range(32))
        assert r.m == counts <= (a ^ b).bit_count()


def test_components_of_crowds_chains_and_strangers(spark):
    rng = random.Random(11)
    fps = []
    for _ in range(6):
        centre = rng.getrandbits(64)
        fps += [centre ^ sum(1 << b for b in rng.sample(range(64), rng.randint(0, 4))) for _ in range(40)]
        for _ in range(12):
            centre ^= sum(1 << b for b in rng.sample(range(64), 4))
            fps.append(centre)
    fps += [rng.getrandbits(64) for _ in range(100)] + [0, 1, 3]
    fps = list(dict.fromkeys(fps))
    signed = lambda x: x - (1 << 64) if x >> 63 else x
    got = {r.fp: r.label for r in S.link_components(spark.createDataFrame([(signed(f),) for f in fps], "fp long")).collect()}
    want = by_hand(fps)
    groups = {}
    for f, c in zip(fps, want):
        groups.setdefault(c, set()).add(got[signed(f)])
    assert all(len(g) == 1 for g in groups.values()) and len({next(iter(g)) for g in groups.values()}) == len(groups)


def test_cells_are_not_broadcast(spark, monkeypatch):
    rng = random.Random(3)
    fps = [rng.getrandbits(63) for _ in range(40)]
    fps += [f ^ 1 for f in fps[:20]]
    plans = []
    keep = S.written
    monkeypatch.setattr(S, "written", lambda df, label: plans.append((label, df._jdf.queryExecution().executedPlan().toString())) or keep(df, label))
    links = []
    merge = S.components
    monkeypatch.setattr(S, "components", lambda df, a, b: links.append(df._jdf.queryExecution().executedPlan().toString()) or merge(df, a, b))
    got = S.link_components(spark.createDataFrame([(f,) for f in fps], "fp long"))
    assert got.select("label").distinct().count() == 40
    laid_out = [p for label, p in plans if label == "cells"] + links
    assert len(laid_out) == 4 and not any("Broadcast" in p for p in laid_out)


def test_documents_with_copies_nulls_and_clashing_columns(spark):
    text = " ".join(f"w{i}" for i in range(80))
    rows = [(5, text), (3, text.upper()), (9, text.replace("w40", "other")), (7, "something else entirely with some words"), (8, None), (2, ""), (None, text), (7, "something else entirely with some words")]
    df = spark.createDataFrame([(i, t, 1, 2) for i, t in rows], "doc_id long, text string, fp int, component_id int")
    got = S.near_duplicates(df).collect()
    assert len(got) == len(rows)
    comp = {r.doc_id: r.component_id for r in got}
    near = (S.fingerprint(rows[0][1]) ^ S.fingerprint(rows[2][1])).bit_count() <= 4
    assert comp[5] == comp[3] == comp[None] == 3 and comp[9] == (3 if near else 9) and comp[8] == comp[2] == 2 and comp[7] == 7
