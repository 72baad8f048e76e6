"""State of facts and values over time."""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema

from tidemark.functions.matching import ValueFinder
from tidemark.functions.text import collapse_whitespace
from tidemark.session import cut_lineage


def temporal_status(at: Column, valid: Column, invalid: Column, expired: Column, reference: Column) -> Column:
    """``stale`` once invalid or expired, ``future`` while not yet valid (or not yet referenced), else ``active``."""
    over = F.coalesce(invalid <= at, F.lit(False)) | F.coalesce(expired <= at, F.lit(False))
    ahead = F.coalesce(valid > at, F.lit(False)) | (valid.isNull() & F.coalesce(reference > at, F.lit(False)))
    return F.when(over, "stale").when(ahead, "future").otherwise("active")


def fact_key(fact: Column) -> Column:
    return F.lower(collapse_whitespace(fact))


def conflicting_groups(facts: DataFrame, group: Sequence[str], fact: str) -> DataFrame:
    """Groups (such as source, target, relation) that state more than one fact after normalisation."""
    distinct = facts.groupBy(*group, fact_key(F.col(fact)).alias("_f")).agg(F.count(F.lit(1)).alias("_n"))
    return distinct.groupBy(*group).agg(F.count(F.lit(1)).alias("distinct_facts"), F.sum("_n").alias("facts")).filter("distinct_facts > 1")


def latest_valid_fact(facts: DataFrame, group: Sequence[str], fact: str, status: str, rank: str, valid: str, reference: str) -> DataFrame:
    """Per conflicting group the latest active fact (by time, then rank) and how many stale facts rank before it."""
    when = F.coalesce(F.col(valid), F.col(reference), F.lit(-(2**62)))
    # facts come from joins and ranks; they are read twice, so what is needed of them is written once
    rows = cut_lineage(facts.select(*group, fact_key(F.col(fact)).alias("_said"), F.col(status).alias("_status"), F.col(rank).alias("_r"), when.alias("_when")), "facts")
    active = F.col("_status") == "active"
    groups = rows.groupBy(*group).agg((F.min("_said") != F.max("_said")).alias("_c"), F.max_by(F.when(active, F.col("_r")), F.when(active, F.struct("_when", -F.col("_r")))).alias("latest_rank"))
    latest = groups.filter("_c AND latest_rank IS NOT NULL").select(*group, "latest_rank")
    stale = rows.filter("_status = 'stale'").select(*group, "_r")
    return latest.join(stale, list(group), "left").groupBy(*group, "latest_rank").agg(F.count_if(F.col("_r") < F.col("latest_rank")).alias("stale_before_latest"))


def latest_and_stale_values(ops: DataFrame, target: Sequence[str], order: Sequence[str], value: str) -> tuple[DataFrame, DataFrame]:
    """The value each target ends with, and one row per value it had before: ``(latest, stale)``."""
    live = ops.filter(F.col(value).isNotNull())
    latest = live.groupBy(*target).agg(F.max_by(value, F.struct(*order)).alias("latest_value"))
    stale = live.select(*target, F.col(value).alias("stale_value")).distinct().join(latest, list(target)).filter(F.col("stale_value") != F.col("latest_value"))
    return latest, stale.select(*target, "stale_value")


def chain_length_stats(ops: DataFrame, sample: Sequence[str], target: str, chain: str, segment: str, mutated: Column, confirmed: Column) -> DataFrame:
    """Per sample: most mutations of one target, longest confirmed chain, targets, segments that mutate."""
    per_target = ops.groupBy(*sample, target).agg(F.count_if(mutated).alias("_m"))
    per_chain = ops.filter(confirmed).groupBy(*sample, chain).agg(F.count(F.lit(1)).alias("_c"))
    per_segment = ops.filter(mutated).groupBy(*sample, segment).agg(F.count(F.lit(1)).alias("_s"))
    a = per_target.groupBy(*sample).agg(F.count(F.lit(1)).alias("targets"), F.max("_m").alias("max_mutations"), F.sum("_m").alias("mutations"))
    b = per_chain.groupBy(*sample).agg(F.count(F.lit(1)).alias("chains"), F.max("_c").alias("max_chain_length"))
    c = per_segment.groupBy(*sample).agg(F.count(F.lit(1)).alias("mutating_segments"))
    return a.join(b, list(sample), "left").join(c, list(sample), "left").fillna(0, ["chains", "max_chain_length", "mutating_segments"])


def state_pair_matrix(states: DataFrame, sample: str, method: str, status: str, left: str, right: str) -> DataFrame:
    """How many samples show each pair of states across two methods; pairs that differ are marked."""
    of = lambda m: F.max(F.when(F.col(method) == m, F.col(status)))
    pairs = states.filter(F.col(method).isin(left, right)).groupBy(sample).agg(of(left).alias("left_state"), of(right).alias("right_state"))
    whole = pairs.filter("left_state IS NOT NULL AND right_state IS NOT NULL")
    return whole.groupBy("left_state", "right_state").agg(F.count(F.lit(1)).alias("samples"), F.min(sample).alias("first_sample")).withColumn("diverges", F.col("left_state") != F.col("right_state"))


def inspect_current_state(samples: DataFrame, stale: DataFrame, edges: DataFrame, sample: str, at: Column) -> DataFrame:
    """PASS, AMBIGUOUS or FAIL per sample: is the expected value active, is a stale one active in the same group.

    ``samples(sample, expected)``, ``stale(sample, stale_value)``, ``edges(sample, edge_id, source_key, relation, text,
    valid_at, invalid_at, expired_at)``. Within a text the expected value is consumed first, then stale values from the longest
    on, so a value inside a longer one does not count. Each text is walked once by an automaton of all stale values of its
    sample. A sample with many texts is dealt to several tasks, each with its own copy of the values.
    """
    low = lambda c: F.lower(F.col(c))
    active = (
        F.coalesce(F.col("valid_at") <= at, F.lit(True)) & F.coalesce(at < F.col("invalid_at"), F.lit(True)) & F.coalesce(at < F.col("expired_at"), F.lit(True))
    )
    rows = (
        edges.withColumns({"_text": low("text"), "_active": active, "_g": F.concat_ws("|", low("source_key"), low("relation"))})
        .join(samples.select(sample, low("expected").alias("_want")), sample)
        .withColumn("_current", F.contains("_text", F.col("_want")))
        .select(sample, "edge_id", "_text", "_active", "_g", "_want", "_current")
    )
    current = rows.filter("_current AND _active").select(sample, "_g").distinct()
    suspects = rows.filter("_active").join(current, [sample, "_g"], "left_semi").withColumn("_left", F.replace("_text", F.col("_want"), F.lit(" ")))
    old = stale.select(sample, low("stale_value").alias("_v")).filter("_v <> ''").distinct()
    taken = _stale_counts(suspects.select(sample, "edge_id", "_left", "_current"), old, sample)
    conflicts = taken.groupBy(sample).agg(F.sum(F.when(~F.col("_current"), F.col("_n")).otherwise(0)).alias("stale_active"), F.sum(F.when(F.col("_current"), F.col("_n")).otherwise(0)).alias("transition_mentions"))
    seen = rows.groupBy(sample).agg(F.count_if(F.col("_current") & F.col("_active")).alias("current_active"), F.count_if(F.col("_current") & ~F.col("_active")).alias("current_inactive"))
    out = samples.select(sample).join(seen, sample, "left").join(conflicts, sample, "left").fillna(0)
    status = F.when(F.col("current_active") == 0, "FAIL").when(F.col("stale_active") > 0, "AMBIGUOUS").otherwise("PASS")
    return out.withColumn("status", status)


#: Texts of one sample that share a copy of its stale values.
TEXTS_PER_SHARE = 50_000


def _stale_counts(texts: DataFrame, values: DataFrame, sample: str) -> DataFrame:
    """``texts(sample, edge_id, _left, _current)`` that hold some of the sample's ``values(sample, _v)``, with how many count (_n)."""
    shares = F.ceil(F.count(F.lit(1)) / TEXTS_PER_SHARE).cast("int").alias("_shares")
    sized = texts.groupBy(sample).agg(shares)
    share = F.pmod(F.xxhash64("edge_id"), F.col("_shares")).cast("int").alias("_share")
    none = F.lit(None).cast("boolean").alias("_current")
    dealt = texts.join(sized, sample).select(sample, share, F.lit(1).alias("_kind"), F.col("_left").alias("_text"), "_current")
    copies = values.join(sized, sample).select(sample, F.explode(F.expr("sequence(0, _shares - 1)")).alias("_share"), F.lit(0).alias("_kind"), F.col("_v").alias("_text"), none)
    rows = copies.unionByName(dealt).repartition(sample, "_share").sortWithinPartitions(sample, "_share", "_kind")
    out = T.StructType([texts.schema[sample], T.StructField("_current", T.BooleanType()), T.StructField("_n", T.IntegerType())])
    schema = to_arrow_schema(out)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, held, finder = None, [], None
        for batch in batches:
            found: list[tuple] = []
            for name, part, kind, text, current in zip(*[c.to_pylist() for c in batch.columns]):
                if (name, part) != key:
                    key, held, finder = (name, part), [], None
                if kind == 0:
                    held.append(text)
                    continue
                finder = finder or ValueFinder(held)
                if n := finder.consumed(text or ""):
                    found.append((name, current, n))
            yield pa.RecordBatch.from_arrays([pa.array([r[i] for r in found], t) for i, t in enumerate(schema.types)], schema=schema)

    return rows.mapInArrow(run, out)
