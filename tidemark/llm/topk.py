"""Exact top-k by inner product with segment statistics.

Vectors are cut into equal segments, at several resolutions. A segment of length L with mean m and deviation s satisfies, for two
vectors, ``inner product <= L * (m1 * m2 + s1 * s2)`` (Cauchy and Schwarz on the parts around the means); with the squared lengths this is the
usual lower bound of the distance. Sums over segments bound the whole product, tighter with more segments. A block of queries meets a
block of candidates from coarse to fine. Every query has survivors of its own: at each level those of highest bound are scored, the
k-th best score so far is the query's bar, and candidates whose bound stays below it leave. Only what survives the finest level is
scored, so pruning never loses a result.

Equal vectors are one candidate that carries its ``k + 1`` smallest ids: no query can use more of them. Equal queries are searched once.
Queries and candidates are dealt into blocks of bounded size; every pair of blocks is one group, so neither side is collected or sent whole.

Components become ``floor(scale * x)``, x as double. Vectors that are null or hold null or non-finite components, and rows without an id,
take no part. Vectors of different length are compared as if the shorter ended in zeros. Ids given more than once stand for one
vector, the smallest of theirs. Scores are exact while they and the sums of magnitudes stay below 2^63. Ties go to the smaller id. Other columns do not matter.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidemark.llm.common import text_batches, written

#: Vectors per block of queries and of candidates.
QUERY_BLOCK = 2_048
CANDIDATE_BLOCK = 8_192
#: Numbers of segments, coarse to fine.
RESOLUTIONS = (4, 8, 16, 32)
#: Candidates of the best bound that are scored at each level to raise the bar.
PROBES = 64
#: Below this share of survivors bounds are computed for these alone, not for the block.
SPARSE = 0.1


def segment_features(vectors: np.ndarray, segments: int) -> np.ndarray:
    """Per vector the scaled means and deviations of its segments; inner products of two rows bound those of the vectors."""
    parts = np.array_split(vectors, min(segments, max(1, vectors.shape[1])), axis=1)
    means = np.column_stack([p.sum(axis=1) / max(1, p.shape[1]) ** 0.5 for p in parts])
    devs = np.column_stack([p.std(axis=1) * p.shape[1] ** 0.5 if p.shape[1] else np.zeros(len(p)) for p in parts])
    return np.concatenate([means, devs], axis=1)


def products(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Exact integer inner products of two blocks."""
    if not a.size or not b.size:
        return np.zeros((len(a), len(b)), np.int64)
    if float(np.abs(a).max()) * float(np.abs(b).max()) * a.shape[1] < 2.0**53:
        return np.rint(a.astype(np.float64) @ b.astype(np.float64).T).astype(np.int64)
    return a @ b.T


def block_topk(queries: np.ndarray, candidates: np.ndarray, k: int, shares: list[float] | None = None) -> list[tuple[np.ndarray, np.ndarray]]:
    """Per query the rows of all candidates that score at least its k-th best (ties whole), and their scores.

    ``shares`` takes the share of (query, candidate) pairs that is left after each level.
    """
    n = len(candidates)
    if n <= max(k, PROBES):
        scores = products(queries, candidates)
        return [_best(row, np.arange(n), k) for row in scores]
    q, c = queries.astype(np.float64), candidates.astype(np.float64)
    most = float(np.abs(q).max(initial=0)) * float(np.abs(c).max(initial=0)) * q.shape[1]
    slack, small = 1e-9 * (1 + most), most < 2.0**53
    score = lambda i, rows: np.rint(c[rows] @ q[i]).astype(np.int64) if small else candidates[rows] @ queries[i]
    alive = np.ones((len(q), n), bool)
    bars = np.full(len(q), -np.inf)
    for segments in RESOLUTIONS:
        if segments >= q.shape[1]:
            break  # segments of one component: the bound is the score itself
        fq, fc = segment_features(q, segments), segment_features(c, segments)
        dense = fq @ fc.T if alive.mean() > SPARSE else None
        for i in range(len(q)):
            rows = np.flatnonzero(alive[i])
            bound = dense[i, rows] if dense is not None else fc[rows] @ fq[i]
            probe = rows[np.argpartition(bound, len(rows) - max(k, PROBES))[len(rows) - max(k, PROBES) :]] if len(rows) > max(k, PROBES) else rows
            if len(probe) >= k:  # the k-th best of any candidates never lies above that of all
                bars[i] = max(bars[i], np.partition(score(i, probe), len(probe) - k)[len(probe) - k])
            alive[i, rows[bound < bars[i] - slack]] = False
        if shares is not None:
            shares.append(float(alive.mean()))
    out = []
    for i in range(len(q)):
        rows = np.flatnonzero(alive[i])
        out.append(_best(score(i, rows), rows, k))
    return out


def _best(scores: np.ndarray, rows: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    if len(scores) > k:
        keep = np.flatnonzero(scores >= np.partition(scores, len(scores) - k)[len(scores) - k])
        scores, rows = scores[keep], rows[keep]
    return rows, scores


def _matrix(column: pd.Series, width: int) -> np.ndarray:
    out = np.zeros((len(column), width), np.int64)
    for i, v in enumerate(column):
        out[i, : len(v)] = v
    return out


def exact_topk(vectors: DataFrame, is_query: Column, *, k: int = 20, scale: float = 64.0, vec_id: str = "vec_id", embedding: str = "embedding", query_block: int = QUERY_BLOCK, candidate_block: int = CANDIDATE_BLOCK) -> DataFrame:
    """``(query_id, rank, vec_id, score)``: the k best other vectors of every row that ``is_query`` selects."""
    spark = text_batches(vectors.sparkSession)
    e = F.col(embedding)
    bad = F.exists(e, lambda x: x.isNull() | F.isnan(x.cast("double")) | (F.abs(x.cast("double")) == float("inf")))
    whole = F.transform(e, lambda x: F.floor(x.cast("double") * scale).cast("long"))
    good = vectors.filter(F.col(vec_id).isNotNull() & e.isNotNull() & ~bad).select(F.col(vec_id).cast("long").alias("id"), F.coalesce(is_query, F.lit(False)).alias("asks"), whole.alias("v"))
    good = written(good.groupBy("id").agg(F.min("v").alias("v"), F.max("asks").alias("asks")), "vectors")

    # equal vectors: map-side combined lists of at most k + 1 ids
    smallest = good.withColumn("_n", F.row_number().over(Window.partitionBy("v", F.pmod(F.xxhash64("id"), F.lit(64))).orderBy("id"))).filter(F.col("_n") <= k + 1)
    pool = smallest.groupBy("v").agg(F.slice(F.sort_array(F.collect_list("id")), 1, k + 1).alias("ids"))
    pool = written(pool.withColumn("key", F.xxhash64("v")), "candidates")
    asked = written(good.filter("asks").select("v").distinct().withColumn("q", F.monotonically_increasing_id()), "queries")
    n_pool, n_asked = pool.count(), asked.count()
    columns, rows_ = max(1, -(-n_pool // candidate_block)), max(1, -(-n_asked // query_block))
    deal = lambda blocks: F.pmod(F.xxhash64("v"), F.lit(blocks)).cast("int")
    cells = lambda n: F.explode(F.sequence(F.lit(0), F.lit(n - 1)))
    left = asked.select("q", "v", deal(rows_).alias("qb")).withColumn("cb", cells(columns))
    right = pool.select("ids", "v", deal(columns).alias("cb")).withColumn("qb", cells(rows_))

    def meet(qs: pd.DataFrame, cs: pd.DataFrame) -> pd.DataFrame:
        if not len(qs) or not len(cs):
            return pd.DataFrame({"q": [], "score": [], "ids": []})
        width = max(qs["v"].map(len).max(), cs["v"].map(len).max(), 1)
        found = block_topk(_matrix(qs["v"], width), _matrix(cs["v"], width), k + 1)
        ids, out = cs["ids"].to_numpy(), ([], [], [])
        for q, (rows, scores) in zip(qs["q"], found):
            # ties whole, then cut to the k + 1 best ids
            each = sorted((-int(s), int(i)) for r, s in zip(rows, scores) for i in ids[r])[: k + 1]
            out[0].extend([q] * len(each))
            out[1].extend(-s for s, _ in each)
            out[2].extend(i for _, i in each)
        return pd.DataFrame({"q": out[0], "score": out[1], "ids": out[2]})

    met = left.groupBy("qb", "cb").cogroup(right.groupBy("qb", "cb")).applyInPandas(meet, "q long, score long, ids long")
    best = Window.partitionBy("q").orderBy(F.col("score").desc(), "ids")
    top = met.withColumn("_k", F.row_number().over(best)).filter(F.col("_k") <= k + 1)
    lists = top.groupBy("q").agg(F.sort_array(F.collect_list(F.struct("_k", "score", "ids"))).alias("_l"))
    lists = lists.join(asked, "q").select("v", "_l")
    # every asking row takes the list of its vector without itself
    own = good.filter("asks").select(F.col("id").alias("query_id"), "v").join(lists, "v")
    own = own.select("query_id", F.slice(F.filter("_l", lambda x: x["ids"] != F.col("query_id")), 1, k).alias("_l"))
    return own.select("query_id", F.posexplode("_l").alias("_p", "_x")).select("query_id", (F.col("_p") + 1).cast("int").alias("rank"), F.col("_x.ids").alias("vec_id"), F.col("_x.score").alias("score"))
