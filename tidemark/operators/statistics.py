"""Distributions, paired comparisons, agreement and resampled intervals."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark.functions.digests import PRIME, draw_index
from tidemark.functions.measures import cohen_kappa, precision_recall_f1, ratio, round_double, wilson_bounds
from tidemark.operators.ordered import Running, ordered_scan
from tidemark.operators.quantiles import LINEAR, NEAREST, exact_quantiles
from tidemark.session import cut_lineage


def median_exact(df: DataFrame, keys: Sequence[str], value: str, out: str = "median") -> DataFrame:
    return exact_quantiles(df, keys, value, {out: 0.5}, method=LINEAR)


def geometric_mean(value: Column) -> Column:
    """Aggregate over the positive values only; NULL when there is none."""
    return F.exp(F.avg(F.when(value > 0, F.ln(value))))


def strict_geometric_mean(value: Column) -> Column:
    """Aggregate that is undefined as soon as one value is not positive."""
    return F.when(F.min(value) > 0, F.exp(F.avg(F.ln(F.when(value > 0, value)))))


def distribution_summary(df: DataFrame, keys: Sequence[str], value: str, *, hot: int | None = None) -> DataFrame:
    """Count, mean, population deviation, nearest-rank tails and their amplification."""
    c, v = F.col("_copies"), F.col(value)
    rows = exact_quantiles(
        df,
        keys,
        value,
        {"p50": 0.50, "p90": 0.90, "p95": 0.95, "p99": 0.99},
        method=NEAREST,
        extra=[F.sum(c).alias("n"), F.sum(v * c).alias("total"), F.sum(v.cast("double") * v * c).alias("_sq"), F.max(v).alias("max_value")],
        hot=hot,
    )
    mean = ratio(F.col("total"), F.col("n"))
    return rows.withColumns(
        {
            "mean": mean,
            "stdev_pop": F.sqrt(F.greatest(F.lit(0.0), F.col("_sq") / F.col("n") - mean * mean)),
            "tail_amplification": ratio(F.col("p99"), F.when(F.col("p50") > 0, F.col("p50"))),
        }
    ).drop("_sq")


def duration_stats(df: DataFrame, keys: Sequence[str], duration_ns: str, *, hot: int | None = None) -> DataFrame:
    """Durations in seconds rounded to nine places."""
    c, v = F.col("_copies"), F.col(duration_ns)
    rows = exact_quantiles(
        df, keys, duration_ns, {"p50_s": 0.5, "p95_s": 0.95, "p99_s": 0.99}, extra=[F.sum(c).alias("n"), F.sum(v * c).alias("total_s"), F.max(v).alias("max_s")], hot=hot
    )
    return rows.withColumns({x: round_double(F.col(x) / 1e9, 9) for x in ("p50_s", "p95_s", "p99_s", "total_s", "max_s")})


def paired_speedups(df: DataFrame, question: str, method: str, metric: str, baseline: str, candidate: str) -> DataFrame:
    """Mean per question of two methods and their ratio, infinite where the candidate took no time."""
    of = lambda m: ratio(F.sum(F.when(F.col(method) == m, F.col(metric))), F.count(F.when(F.col(method) == m, F.col(metric))))
    both = df.filter(F.col(method).isin(baseline, candidate)).groupBy(question).agg(of(baseline).alias("baseline"), of(candidate).alias("candidate"))
    speedup = F.when(F.col("candidate") > 0, F.col("baseline") / F.col("candidate")).otherwise(F.lit(float("inf")))
    return both.filter("baseline IS NOT NULL AND candidate IS NOT NULL").withColumn("speedup", speedup)


def paired_history_summary(df: DataFrame, keys: Sequence[str], value: str) -> DataFrame:
    stats = df.groupBy(*keys).agg(strict_geometric_mean(F.col(value)).alias("geometric_mean"), F.min(value).alias("min_value"), F.max(value).alias("max_value"))
    status = F.when(F.col("geometric_mean").isNotNull(), "DEFINED").otherwise("NOT_DEFINED_NON_POSITIVE_VALUES")
    return stats.withColumn("geometric_mean_status", status).join(median_exact(df, keys, value), list(keys))


def overhead_class(df: DataFrame, keys: Sequence[str], off: str, on: str) -> DataFrame:
    """Median of (on - off) / off per key and its class at two and five percent."""
    rows = df.withColumn("_r", (F.col(on) - F.col(off)) / F.col(off))
    m = F.col("median_overhead")
    label = F.when(m <= 0.02, "clean_pass").when(m <= 0.05, "warning_continue").otherwise("block_and_repair")
    return median_exact(rows, keys, "_r", "median_overhead").withColumn("overhead_class", label)


def confusion_and_kappa(df: DataFrame, keys: Sequence[str], human: str, predicted: str) -> DataFrame:
    h, p = F.col(human), F.col(predicted)
    counts = df.groupBy(*keys).agg(
        F.count_if(h & p).alias("tp"), F.count_if(~h & ~p).alias("tn"), F.count_if(~h & p).alias("fp"), F.count_if(h & ~p).alias("fn")
    )
    cells = [F.col(c) for c in ("tp", "tn", "fp", "fn")]
    return counts.withColumns(
        {"observed_agreement": F.coalesce(ratio(cells[0] + cells[1], sum(cells[1:], cells[0])), F.lit(0.0)), "kappa": cohen_kappa(*cells)}
    )


def judge_agreement(results: DataFrame, labels: DataFrame, keys: Sequence[str], item: str, status: str, human: str, predicted: str) -> DataFrame:
    """Agreement over successful verdicts only; invalid output and service errors are counted, never read as wrong."""
    joined = results.join(labels.select(item, human), item)
    parts = joined.groupBy(*keys).agg(
        F.count(F.lit(1)).alias("terminal_items"),
        F.count_if(F.col(status) == "SUCCESS").alias("eligible_items"),
        F.count_if(F.col(status) == "INVALID_OUTPUT").alias("invalid_output"),
        F.count_if(F.col(status) == "SERVICE_ERROR").alias("service_error"),
    )
    agreed = confusion_and_kappa(joined.filter(F.col(status) == "SUCCESS"), keys, human, predicted)
    return parts.join(agreed, list(keys), "left")


def wilson_interval(df: DataFrame, successes: str, total: str) -> DataFrame:
    low, high = wilson_bounds(F.col(successes), F.col(total))
    return df.withColumns({"wilson_low": low, "wilson_high": high})


def relabel_agreement(df: DataFrame, keys: Sequence[str], valid: str, label: str, original: str) -> DataFrame:
    v = F.col(valid)
    n = F.count_if(v)
    right = F.count_if(v & F.col(label))
    same = F.count_if(v & F.col(label).eqNullSafe(F.col(original)))
    return df.groupBy(*keys).agg(
        F.count(F.lit(1)).alias("question_count"),
        n.alias("valid_count"),
        right.alias("correct_count"),
        ratio(right, n).alias("accuracy"),
        same.alias("agreement_count"),
        ratio(same, n).alias("agreement_rate"),
    )


def prf_sets(left: DataFrame, right: DataFrame, keys: Sequence[str], group: Sequence[str] = ()) -> DataFrame:
    """Precision, recall and F1 of two key sets, per group when given. Repeats within a side count once."""
    cols = [*group, *keys]
    side = lambda df, name: df.select(*cols).withColumn("_side", F.lit(name))
    seen = side(left, "l").unionByName(side(right, "r")).groupBy(*cols).agg(F.count_if(F.col("_side") == "l").alias("_l"), F.count_if(F.col("_side") == "r").alias("_r"))
    sizes = seen.groupBy(*group).agg(
        F.count_if((F.col("_l") > 0) & (F.col("_r") > 0)).alias("matched"), F.count_if(F.col("_l") > 0).alias("left_size"), F.count_if(F.col("_r") > 0).alias("right_size")
    )
    return sizes.withColumns(precision_recall_f1(F.col("matched"), F.col("left_size"), F.col("right_size")))


def _numbered(df: DataFrame, order: Sequence[str], by: Sequence[str] = ()) -> DataFrame:
    """Rows with a 0-based position and the number of rows, per ``by``, written once: Spark then knows their size when they meet the draws."""
    one = F.lit(1)
    return cut_lineage(ordered_scan(df, list(by), list(order), rank="_i", total={"_n": Running("sum", one)}).withColumn("_i", F.col("_i") - 1), "units")


def _replicates(units: DataFrame, seed: int, samples: int, by: Sequence[str] = ()) -> DataFrame:
    """``samples`` times as many draws as there are units: rows ``by, _b, _i`` with the drawn position.

    Only slot numbers are multiplied, and they are dealt out before. Units that Spark finds small enough to send meet the
    draws where these are made, so what is shuffled is one partial sum per replicate and task.
    """
    tasks = 4 * units.sparkSession.sparkContext.defaultParallelism
    slots = units.select(*by, "_i", "_n").repartition(tasks, *by, "_i").select(*by, "_i", "_n", F.explode(F.sequence(F.lit(0), F.lit(samples - 1))).alias("_b"))
    return slots.select(*by, "_b", draw_index(seed, F.col("_n"), F.col("_b"), F.col("_i")).alias("_i"))


#: Logarithms in one row, and positions that a task holds at a time (8 bytes each).
UNITS_PER_ROW, UNITS_PER_CELL = 1024, 1 << 23


def _replicate_logs(units: DataFrame, seed: int, samples: int, cell: int) -> DataFrame:
    """``_b, _s, _k``: sum and number of the logarithms that every replicate draws, in parts per range of ``cell`` positions.

    Draws are numbers made from replicate and slot, so they need no rows: a task gets a range of the logarithms and some of
    the replicates, makes all their draws in numpy and adds those that fall into its range. What is shuffled is the
    logarithms, once per group of replicates.
    """
    groups = min(samples, 2 * units.sparkSession.sparkContext.defaultParallelism)
    row = F.floor(F.col("_i") / UNITS_PER_ROW)
    packed = units.groupBy(row.alias("_row")).agg(F.max("_n").alias("_n"), F.transform(F.array_sort(F.collect_list(F.struct("_i", "_ln"))), lambda u: u["_ln"]).alias("_logs"))
    dealt = packed.select(F.floor(F.col("_row") * UNITS_PER_ROW / cell).alias("_cell"), F.explode(F.sequence(F.lit(0), F.lit(groups - 1))).alias("_g"), "_row", "_n", "_logs")
    dealt = dealt.repartitionByRange(groups, "_g", "_cell").sortWithinPartitions("_g", "_cell", "_row")
    prime, step = PRIME, 1 << 15

    def run(batches):
        import numpy as np
        import pyarrow as pa

        # modulo 2**31 - 1 by folding the high bits, up to a multiple of it
        fold = lambda h: (h & prime) + (h >> 31)

        def summed(group, cell_no, n, parts):
            logs, low = np.concatenate(parts), cell_no * cell
            known = ~np.isnan(logs)
            whole, values = bool(known.all()), np.where(known, logs, 0.0)
            replicates = np.arange(group, samples, groups)
            sums, counts = np.zeros(len(replicates)), np.zeros(len(replicates), np.int64)
            for start in range(0, n, step):
                slot = np.arange(start, min(start + step, n), dtype=np.int64)
                base = slot * 7_919 + seed
                for at, b in enumerate(replicates.tolist()):
                    h = fold(fold(base + b * 1_000_003))
                    h = fold(fold(h * (h + 12_345) + slot))
                    h = fold(fold(h * (h + 67_891) + b))
                    h = fold(fold(h * (h + 424_243) + seed))
                    h -= prime * (h >= prime)
                    h -= h // n * n
                    if len(logs) < n:
                        h = h[(h >= low) & (h < low + len(logs))] - low
                    sums[at] += values[h].sum()
                    counts[at] += len(h) if whole else np.count_nonzero(known[h])
            return pa.RecordBatch.from_arrays([pa.array(replicates, pa.int64()), pa.array(sums), pa.array(counts)], names=["_b", "_s", "_k"])

        key, parts = None, []
        for batch in batches:
            logs = batch.column("_logs")
            for i, found in enumerate(zip(*[batch.column(c).to_pylist() for c in ("_g", "_cell", "_n")])):
                if found != key:
                    if parts:
                        yield summed(*key, parts)
                    key, parts = found, []
                parts.append(logs[i].values.to_numpy(zero_copy_only=False).astype(float))
        if parts:
            yield summed(*key, parts)

    return dealt.mapInArrow(run, "_b bigint, _s double, _k bigint")


def _order_pick(values: DataFrame, value: str, low: float, high: float, samples: int, by: Sequence[str] = ()) -> DataFrame:
    """Order statistics at ``int(q * (B - 1))`` of a sorted list of B estimates, per ``by``."""
    ranked = ordered_scan(values.filter(F.col(value).isNotNull()), list(by), [value, "_b"], rank="_r", total={"_m": Running("sum", F.lit(1))}, hot=samples)
    at = lambda q: F.max(F.when(F.col("_r") - 1 == F.floor(F.lit(q) * (F.col("_m") - 1)), F.col(value)))
    return ranked.groupBy(*by).agg(F.max("_m").alias("estimates"), at(low).alias("ci_low"), at(high).alias("ci_high"))


def bootstrap_ci_geomean(paired: DataFrame, question: str, value: str, *, samples: int, seed: int, alpha: float = 0.05) -> DataFrame:
    """Percentile interval of the geometric mean when whole pairs are drawn again with replacement.

    Only logarithms travel; the draws, ``samples`` times the pairs, are made and added up inside the tasks.
    """
    units = _numbered(paired.select(question, F.when(F.col(value) > 0, F.ln(value)).alias("_ln")), [question])
    sums = _replicate_logs(units, seed, samples, UNITS_PER_CELL).groupBy("_b").agg(F.sum("_s").alias("_s"), F.sum("_k").alias("_k"))
    means = sums.select("_b", F.exp(ratio(F.col("_s"), F.col("_k"))).alias("_g"))
    return _order_pick(means, "_g", alpha / 2, 1 - alpha / 2, samples)


def cluster_bootstrap(rows: DataFrame, cluster: str, sums: Sequence[str], estimate: Column, *, samples: int, seed: int, by: Sequence[str] = ()) -> DataFrame:
    """Interval of a pooled ``estimate`` when whole clusters are drawn again; one per ``by``, from its own clusters.

    Rows are summed per cluster first, so a replicate touches one row per cluster however large the clusters are.
    """
    by = list(by)
    per = rows.groupBy(*by, cluster).agg(*[F.sum(s).alias(s) for s in sums])
    key = F.conv(F.substring(F.md5(F.col(cluster).cast("string")), 1, 12), 16, 10).cast("long")
    units = _numbered(per.withColumn("_o", key), ["_o", cluster], by)
    drawn = _replicates(units, seed, samples, by).join(units.select(*by, "_i", *sums), [*by, "_i"])
    pooled = drawn.groupBy(*by, "_b").agg(*[F.sum(s).alias(s) for s in sums]).select(*by, "_b", estimate.alias("_e"))
    return _order_pick(pooled, "_e", 0.025, 0.975, samples, by)
