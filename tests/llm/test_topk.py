import math
import random

import numpy as np
from pyspark.sql import functions as F

from tidemark.llm.topk import block_topk, exact_topk, segment_features

COLUMNS = "vec_id long, embedding array<float>, label int, score int, ids int"


def brute(rows, k):
    good = {}
    for i, v in sorted((r for r in rows if r[0] is not None and r[1] is not None and all(x is not None and math.isfinite(x) for x in r[1])), key=lambda r: r[0]):
        w = [math.floor(64 * float(np.float32(x))) for x in v]
        good[i] = min(good.get(i, w), w)
    out = set()
    for q, v in good.items():
        if q % 20:
            continue
        best = sorted(((-sum(a * b for a, b in zip(v, w)), i) for i, w in good.items() if i != q))[:k]
        out |= {(q, n + 1, i, -s) for n, (s, i) in enumerate(best)}
    return out


def test_matches_brute_force_with_ties_copies_and_bad_rows(spark):
    rng = random.Random(3)
    base = [[rng.choice([-0.5, 0.25, 0.75, rng.random()]) for _ in range(12)] for _ in range(60)]
    rows = [(i, base[i % 60] if i % 3 else base[0]) for i in range(300)]
    rows += [(400, None), (420, [float("nan")] * 12), (440, [None] * 12), (460, [float("inf")] * 12), (None, base[1]), (480, []), (500, base[2][:5]), (20, base[20]), (20, base[20])]
    df = spark.createDataFrame([(i, v, 0, 1, 2) for i, v in rows], COLUMNS)
    for blocks in ((2048, 8192), (7, 40)):
        got = exact_topk(df, F.col("vec_id") % 20 == 0, k=5, query_block=blocks[0], candidate_block=blocks[1]).collect()
        assert {(r.query_id, r.rank, r.vec_id, r.score) for r in got} == brute(rows, 5)


def test_fewer_candidates_than_k(spark):
    df = spark.createDataFrame([(0, [1.0], 0, 0, 0), (1, [2.0], 0, 0, 0)], COLUMNS)
    assert [tuple(r) for r in exact_topk(df, F.col("vec_id") == 0).collect()] == [(0, 1, 1, 64 * 128)]


def test_bounds_hold_and_pruning_is_exact():
    rng = np.random.default_rng(1)
    a, b = rng.integers(-60, 60, (30, 48)), rng.integers(-60, 60, (500, 48)) * (rng.random((500, 1)) < 0.3)
    for s in (4, 8, 16):
        assert (segment_features(a.astype(float), s) @ segment_features(b.astype(float), s).T >= a @ b.T - 1e-6).all()
    for row, (rows, scores) in zip(a @ b.T, block_topk(a, b, 21)):
        bar = np.sort(row)[-21]
        assert set(rows) == set(np.flatnonzero(row >= bar)) and (scores == row[rows]).all()


def test_every_query_prunes_for_itself():
    rng = np.random.default_rng(2)
    # steps over the segments: clusters that segment means tell apart
    centres = np.repeat(rng.integers(-40, 40, (20, 8)), 8, axis=1)
    near = lambda n: centres[rng.integers(0, 20, n)] + rng.integers(-3, 4, (n, 64))
    a, b = near(40), near(4000)
    shares = []
    found = block_topk(a, b, 21, shares)
    for row, (rows, scores) in zip(a @ b.T, found):
        bar = np.sort(row)[-21]
        assert set(rows) == set(np.flatnonzero(row >= bar)) and (scores == row[rows]).all()
    assert all(x < 1 for x in shares) and shares == sorted(shares, reverse=True) and shares[-1] < 0.1


def test_large_components_stay_exact():
    rng = np.random.default_rng(3)
    a, b = rng.integers(-(2**26), 2**26, (5, 16)), rng.integers(-(2**26), 2**26, (300, 16))
    for row, (rows, scores) in zip(a @ b.T, block_topk(a, b, 7)):
        assert set(rows) == set(np.flatnonzero(row >= np.sort(row)[-7])) and (scores == row[rows]).all()
