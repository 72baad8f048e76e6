import hashlib
import random
import zlib
from fractions import Fraction

import numpy as np
import pytest

from tidemark.llm import periodic_runs as R
from tidemark.llm import queries


def slow_runs(ids, power=3, shortest=24):
    """All periods, all starts: extend as far as words q apart agree, keep stretches whose smallest period is q."""
    n, out = len(ids), []
    for q in range(1, n // power + 1):
        i = 0
        while i + q < n:
            j = i
            while j + q < n and ids[j] == ids[j + q]:
                j += 1
            length = j - i + q
            if j > i and length >= max(shortest, power * q) and not any(all(ids[k] == ids[k + d] for k in range(i, i + length - d)) for d in range(1, q)):
                out.append((i, length, q))
            i = max(j, i + 1)
    return sorted(out, key=lambda r: (r[0], r[2]))


def planted(rng, n, words):
    ids = [rng.randrange(words) for _ in range(n)]
    for _ in range(rng.randint(0, 4) if n else 0):
        a, p = rng.randrange(n), rng.choice([1, 2, 3, 5, 7, 8, 20, 60, 95, 96, 97, 150, 191, 192, 200, 300])
        unit = [rng.randrange(words) for _ in range(p)]
        if rng.random() < 0.4:  # a unit that is almost a power of a shorter one
            d = rng.randint(1, p)
            unit = [unit[i % d] for i in range(p)]
            unit[rng.randrange(p)] = words
        for i in range(a, min(n, a + p * rng.randint(2, 9) + rng.randrange(p))):
            ids[i] = unit[(i - a) % p]
    return ids


def test_against_all_periods():
    rng = random.Random(3)
    for _ in range(60):
        ids = planted(rng, rng.randint(0, 1500), rng.choice([2, 3, 5, 50, 1000]))
        assert R.find_runs(np.array(ids, np.int64)) == slow_runs(ids)
        assert R.find_runs(np.array(ids, np.int64), 5, 60) == slow_runs(ids, 5, 60)


def test_long_periods_with_repeats_inside_the_unit():
    rng = random.Random(4)
    for p in (400, 800, 1537, 3100):
        inner = [0] * (p // 3) + [1, 2] * (p // 6) + [rng.randrange(3, 9) for _ in range(p // 10)]
        unit = (inner + [9] * p)[:p]
        ids = [7, 8] + (unit * 4)[: 3 * p + 5] + [11]
        found = R.find_runs(np.array(ids, np.int64))
        assert any(r[2] == p and r[1] >= 3 * p + 5 for r in found)
        assert found == [(a, n, q) for a, n, q in found if n >= 3 * q and all(ids[i] == ids[i + q] for i in range(a, a + n - q))]


def test_random_fibonacci_and_powers():
    a, b = [0], [0, 1]
    while len(b) < 1500:
        a, b = b, b + a
    assert R.find_runs(np.array(b, np.int64)) == slow_runs(b)
    for unit in ([1], [1, 2], list(range(130)), list(range(500))):
        ids = unit * (2000 // len(unit))
        assert R.find_runs(np.array(ids, np.int64)) == [(0, len(ids), len(unit))]


def test_texts_of_a_batch_stay_apart():
    rng = random.Random(5)
    texts = [[b"%d" % i for i in planted(rng, rng.choice([0, 1, 23, 24, 40, 290, 700, 1300]), 4)] for _ in range(40)]
    texts += [[b"a"] * 20, [b"a"] * 20, [b"a"] * 24]
    got = R.runs_of_texts(texts, 3, 24)
    assert got == [slow_runs(t) for t in texts] and got[-1] == [(0, 24, 1)] and got[-2] == []


def test_a_very_long_text():
    ids = np.arange(400_000) % 70_001
    ids[:5] = -5
    assert R.find_runs(ids.astype(np.int64)) == [(5, 399_995, 70_001)]


def slow_row(doc_id, text):
    words = (text or "").encode().split()
    n = len(words)
    if doc_id is not None and n and zlib.crc32(str(doc_id).encode()) % 10 == 0:
        g = zlib.crc32(str(doc_id).encode()) // 10
        a, p = g % n, 1 + (n - g % n) // (3 + g % 8)
        words = [words[i] if i < a else words[a + (i - a) % p] for i in range(n)]
    runs = slow_runs(words)
    best = min(runs, key=lambda r: (-Fraction(r[1], r[2]), r[0], r[2])) if runs else (None, None, None)
    dropped = {i for s, length, q in runs for i in range(s + q, s + length)}
    digest = lambda b: hashlib.sha256(b).hexdigest()
    listed = "".join(f"{s},{length},{q}\n" for s, length, q in runs)
    milli = best[1] * 1000 // best[2] if runs else None
    return (doc_id, len(runs), *best, milli, digest(listed.encode()), digest(b" ".join(w for i, w in enumerate(words) if i not in dropped)))


COLUMNS = ["doc_id", "n_runs", "start", "length", "period", "exponent_milli", "runs_sha256", "collapsed_sha256"]


def test_query_against_all_periods(spark, tmp_path):
    rng = random.Random(6)
    rows = [(None, "a " * 40), (1, None), (2, ""), (3, " \t\n"), (4, "é x " * 30), (4, "é x " * 30), (5, " ".join("ab"[i % 2] for i in range(24)))]
    rows += [(i, " ".join(f"w{w}" for w in planted(rng, rng.randint(0, 500), rng.choice([2, 30])))) for i in range(6, 90)]
    spark.createDataFrame([(i, t, 1, "x") for i, t in rows], "doc_id long, text string, runs int, period string").write.parquet(f"{tmp_path}/documents.parquet")
    got = queries.QUERIES["op11_periodic_runs"](spark, str(tmp_path)).select(*COLUMNS).collect()
    key = lambda r: (r[0] or -1, r[1], r[7])
    assert sorted(map(tuple, got), key=key) == sorted([slow_row(i, t) for i, t in rows], key=key)
    assert any(zlib.crc32(str(i).encode()) % 10 == 0 and t for i, t in rows)


def test_operator_keeps_columns(spark):
    df = spark.createDataFrame([(1, "go " * 30, "c")], "doc_id long, text string, runs string")
    row = R.periodic_runs(df).collect()[0]
    assert (row.text, row.collapsed, tuple(row.strongest)) == ("go " * 30, "go", (0, 30, 1)) and len(row.runs) == 1
    assert R.periodic_runs(df.limit(0)).collect() == []


def test_other_bounds_are_refused():
    with pytest.raises(ValueError):
        R.find_runs(np.zeros(5, np.int64), power=2)
