"""Mix sources to target weights along a low-discrepancy schedule. DataFrame functions only.

Targets. The sources, in code point order with null last, weigh 1, 2, 3, 1, ... and share all words. A source is repeated at
most ``max_repeats`` times; what it cannot take is shared again among the others by weight until nobody is above the limit.
The fixed point of that sharing is ``min(limit, level * weight)`` with one level for all; over the sources in the order of
``limit / weight`` it is the largest of the levels that result when the first k are at their limits.

Schedule. Slot i holds the point ``frac(i * golden)``; cumulative shares of the targets map it to a source. A slot's rank within
its source names the block it plays: the source's documents, shuffled by a seeded digest, are one stream of words cut into blocks
of ``block_words``, and ranks run through the blocks again and again. Slots beyond a source's target are void, and its last
slot ends with the word that meets the target, so taken words differ from the target by rounding only. The golden-ratio points
make every stretch of the schedule nearly proportional; the number of slots is what the slowest source needs. A source with a share
below ``1 / GRID`` does not wait for its points: its blocks are dealt evenly over the schedule, from an offset by its rank, and stand
before the block that has the same slot. So slots grow with the words taken, whatever the smallest share.

Null texts have size 0; documents without words take nothing. Repeated rows are rows of their own. Ties in the shuffle are
broken by id and size. The result depends on rows and seed, not on partitions.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidemark.llm.common import written

WEIGHTS = (1.0, 2.0, 3.0)
MAX_REPEATS = 3
BLOCK_WORDS = 1024
SEED = "mix-1"
#: Documents of the largest source per range of the shuffle order.
RANGE_ROWS = 1_000
GOLDEN = (math.sqrt(5) - 1) / 2
#: Cells of the unit interval by which slots find their source; sources smaller than a cell are dealt without points.
GRID = 4_096


def words(text: Column) -> Column:
    """Number of runs of characters outside x20 and x09-x0D; 0 for null."""
    flat = F.trim(F.regexp_replace(F.coalesce(text, F.lit("")), r"[\x20\x09-\x0D]+", " "))
    return F.when(flat == "", 0).otherwise(F.length(flat) - F.length(F.replace(flat, F.lit(" "), F.lit(""))) + 1).cast("long")


def targets(sizes: DataFrame, *, weights: tuple[float, ...] = WEIGHTS, max_repeats: int = MAX_REPEATS) -> DataFrame:
    """``(source, size)`` per source to ``(source, source_size, rows, weight, target, quota)``; ``quota`` is the target in whole words.

    The sources are a list of names with their totals, one row each, and are ranked by one window.
    """
    order = Window.partitionBy(F.lit(0)).orderBy(F.col("source").asc_nulls_last())
    place = (F.row_number().over(order) - 1) % len(weights)
    rows = sizes.groupBy("source").agg(F.sum("size").alias("source_size"), F.count(F.lit(1)).alias("rows"))
    rows = rows.withColumn("weight", F.element_at(F.array(*[F.lit(float(w)) for w in weights]), (place + 1).cast("int")))
    rows = rows.withColumn("_limit", F.col("source_size").cast("double") * max_repeats)
    by_limit = Window.partitionBy(F.lit(0)).orderBy((F.col("_limit") / F.col("weight")), F.col("source").asc_nulls_last())
    everything = Window.partitionBy(F.lit(0))
    before = F.coalesce(F.sum("_limit").over(by_limit.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0.0))
    after = F.sum("weight").over(by_limit.rowsBetween(0, Window.unboundedFollowing))
    total = F.sum("source_size").over(everything).cast("double")
    rows = rows.withColumn("_level", (total - before) / after)
    rows = rows.withColumn("target", F.least("_limit", F.max("_level").over(everything) * F.col("weight")))
    quota = F.least(F.round("target").cast("long"), F.col("source_size") * max_repeats)
    return rows.select("source", "source_size", "rows", "weight", "target", quota.alias("quota"))


def schedule(plan: DataFrame, *, block_words: int = BLOCK_WORDS) -> DataFrame:
    """``(slot, source, rank, block, epoch, words)``: what the mix plays, slot by slot.

    ``plan`` has source, source_size and quota. Slots are numbers made on the executors; each looks its source up in a table of
    shares, one row per source, and ranks are counted in ranges of slots, so no task sees the whole schedule.
    """
    spark = plan.sparkSession
    line = Window.partitionBy(F.lit(0)).orderBy(F.col("source").asc_nulls_last())
    shares = plan.filter("quota > 0").withColumn("_sum", F.sum("quota").over(Window.partitionBy(F.lit(0))).cast("double"))
    shares = shares.withColumn("_hi", F.sum("quota").over(line) / F.col("_sum"))
    shares = shares.withColumn("_lo", F.coalesce(F.lag("_hi").over(line), F.lit(0.0))).withColumn("_key", F.row_number().over(line))
    blocks = F.ceil(F.col("source_size") / block_words)
    # a pass over the source ends with its last words, so blocks are counted in words of the repeated stream
    need = F.expr("quota div source_size") * blocks + F.ceil((F.col("quota") % F.col("source_size")) / block_words)
    shares = written(shares.withColumn("_need", need).withColumn("_large", F.col("quota") * GRID >= F.col("_sum")), "shares")
    # frac(i * golden) puts between n*p - 2*log2(n) - 4 and n*p + 2*log2(n) + 4 of n points into an interval of length p
    row = shares.filter("_large").agg(F.max((F.col("_need") + 4) * F.col("_sum") / F.col("quota")).alias("n"), F.min(F.col("quota") / F.col("_sum")).alias("p")).first()
    if row["n"] is None:
        slots = 0
    else:
        slots = int(row["n"]) + 1
        slots += int((2 * math.log2(slots + 2) + 4) / row["p"]) + 1
    per_range = 65_536
    point = (F.col("slot") + 1).cast("double") * GOLDEN
    rows = spark.range(slots).select(F.col("id").alias("slot")).withColumn("_u", point - F.floor(point))
    # shares holds one row per source; where it is small enough Spark broadcasts it, else it is scanned in blocks of slots
    cut = shares.filter("_large").select("_key", "source", "source_size", "quota", "_lo", "_hi")
    steps = cut.withColumn("_g", F.explode(F.sequence(F.floor(F.col("_lo") * GRID), F.least(F.floor(F.col("_hi") * GRID), F.lit(GRID - 1)))))
    rows = rows.withColumn("_g", F.least(F.floor(F.col("_u") * GRID), F.lit(GRID - 1)))
    rows = rows.join(steps, "_g").filter("_u >= _lo AND (_u < _hi OR (_hi >= 1 AND _u >= 1))").withColumn("_r", F.expr(f"slot div {per_range}"))
    rows = rows.select("slot", "_key", "source", "source_size", "quota", "_r")
    counts = rows.groupBy("_key", "_r").agg(F.count(F.lit(1)).alias("_n"))
    base = F.coalesce(F.sum("_n").over(Window.partitionBy("_key").orderBy("_r").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    counts = counts.select("_key", "_r", base.alias("_base"))
    within = F.row_number().over(Window.partitionBy("_key", "_r").orderBy("slot"))
    rows = rows.withColumn("_w", within).join(counts, ["_key", "_r"]).withColumn("rank", F.col("_base") + F.col("_w"))
    rows = rows.select("slot", "source", "source_size", "quota", "rank")
    # a small source has fewer blocks than the schedule has words over block_words * GRID, and a last short one per pass
    length = F.ceil(F.col("_sum") / block_words)
    offset = F.col("_key") * GOLDEN - F.floor(F.col("_key") * GOLDEN)
    few = shares.filter("NOT _large").withColumn("rank", F.explode(F.sequence(F.lit(1).cast("long"), F.col("_need"))))
    few = few.select(F.floor((F.col("rank") - 1 + offset) * length / F.col("_need")).alias("slot"), "source", "source_size", "quota", "rank")
    rows = rows.unionByName(few)
    rows = rows.withColumn("block", (F.col("rank") - 1) % blocks).withColumn("epoch", F.floor((F.col("rank") - 1) / blocks))
    start = F.col("block") * block_words
    length = F.least(F.lit(block_words), F.col("source_size") - start)
    left = F.col("quota") - F.col("epoch") * F.col("source_size") - start
    return rows.filter(left > 0).select("slot", "source", "rank", "block", "epoch", F.least(length, left).cast("long").alias("words"))


def mix(docs: DataFrame, *, doc_id: str = "doc_id", text: str = "text", source: str = "source", weights: tuple[float, ...] = WEIGHTS, max_repeats: int = MAX_REPEATS, block_words: int = BLOCK_WORDS, seed: str = SEED) -> DataFrame:
    """``(doc_id, source, size, source_size, target, taken)``, one row per row of ``docs``; taken counts words, repeats included."""
    named = docs.select(F.col(doc_id).alias("doc_id"), F.col(source).cast("string").alias("source"), words(F.col(text)).alias("size"))
    sizes = written(named, "sizes")
    plan = written(targets(sizes, weights=weights, max_repeats=max_repeats), "targets")
    most = plan.agg(F.max("rows")).first()[0] or 0
    bits = min(28, max(0, math.ceil(math.log2(max(1, most / RANGE_ROWS)))))
    digest = F.md5(F.concat_ws(":", F.lit(seed), F.col("doc_id").cast("string")))
    rows = sizes.withColumn("_d", digest).withColumn("_r", F.shiftright(F.conv(F.substring("_d", 1, 7), 16, 10).cast("long"), 28 - bits))
    # the stream of a source, by ranges of the digest: totals of the ranges first, then places within each
    totals = rows.groupBy("source", "_r").agg(F.sum("size").alias("_n"))
    base = F.coalesce(F.sum("_n").over(Window.partitionBy("source").orderBy("_r").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    totals = totals.select(F.col("source").alias("_s"), F.col("_r").alias("_q"), base.alias("_base"))
    inside = Window.partitionBy("source", "_r").orderBy("_d", "doc_id", "size").rowsBetween(Window.unboundedPreceding, 0)
    rows = rows.withColumn("_end", F.sum("size").over(inside))
    rows = rows.join(totals, F.col("source").eqNullSafe(F.col("_s")) & (F.col("_r") == F.col("_q")))
    rows = rows.withColumn("_end", F.col("_end") + F.col("_base")).withColumn("_start", F.col("_end") - F.col("size"))
    named_plan = plan.select(F.col("source").alias("_ps"), "source_size", "target")
    rows = rows.join(named_plan, F.col("source").eqNullSafe(F.col("_ps"))).select("doc_id", "source", "size", "source_size", "target", "_start", "_end", "_d")
    rows = written(rows, "streams")
    # whole plays of each block, and how far the last, shorter one reaches
    slots = schedule(plan, block_words=block_words)
    full = F.least(F.lit(block_words), F.col("source_size") - F.col("block") * block_words)
    plays = slots.join(plan.select(F.col("source").alias("_ps"), "source_size"), F.col("source").eqNullSafe(F.col("_ps")))
    plays = plays.groupBy("source", "block").agg(F.count(F.when(F.col("words") == full, 1)).alias("_whole"), F.max(F.when(F.col("words") < full, F.col("words"))).alias("_part"))
    plays = plays.select(F.col("source").alias("_bs"), F.col("block").alias("_bb"), "_whole", F.coalesce("_part", F.lit(0)).alias("_part"))
    first, last = F.expr(f"_start div {block_words}"), F.expr(f"(_end - 1) div {block_words}")
    pieces = rows.filter("size > 0").withColumn("_b", F.explode(F.sequence(first, last)))
    # Spark sizes the pieces as the documents before they are cut, so it is told not to broadcast them
    pieces = pieces.join(plays.hint("merge"), F.col("source").eqNullSafe(F.col("_bs")) & (F.col("_b") == F.col("_bb")))
    lo, hi = F.greatest(F.col("_start"), F.col("_b") * block_words), F.least(F.col("_end"), (F.col("_b") + 1) * block_words)
    part = F.greatest(F.lit(0), F.least(hi, F.col("_b") * block_words + F.col("_part")) - lo)
    taken = pieces.groupBy("source", "_start").agg(F.sum((hi - lo) * F.col("_whole") + part).alias("_taken"))
    taken = taken.select(F.col("source").alias("_ts"), F.col("_start").alias("_at"), "_taken")
    # documents without words share their start with the next document and take nothing
    out = rows.join(taken, F.col("source").eqNullSafe(F.col("_ts")) & (F.col("_start") == F.col("_at")), "left")
    own = F.when(F.col("size") > 0, F.coalesce("_taken", F.lit(0))).otherwise(0).cast("long")
    return out.select("doc_id", "source", "size", "source_size", "target", own.alias("taken"))
