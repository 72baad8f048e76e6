"""Canonical graph tables, diffs, integrity and order-free fingerprints of snapshots."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark.functions.digests import framed, multiset_digest, row_hash
from tidemark.functions.measures import precision_recall_f1
from tidemark.functions.text import clean_attributes, collapse_whitespace
from tidemark.operators.ordered import Running, ordered_scan


def _text(c: str) -> Column:
    return collapse_whitespace(F.coalesce(F.col(c).cast("string"), F.lit("")))


def _first_set(*columns: str) -> Column:
    return F.coalesce(*[F.when(F.col(c) != "", F.col(c)) for c in columns], F.lit(""))


def canonicalize_entities(raw: DataFrame) -> DataFrame:
    """Group, lower-cased name, sorted non-blank labels, summary and cleaned attributes; other columns stay."""
    return raw.withColumns(
        {
            "group_id": F.coalesce(F.col("group_id").cast("string"), F.lit("")),
            "name": F.lower(_text("name")),
            "labels": F.array_sort(F.filter(F.coalesce("labels", F.array().cast("array<string>")), lambda l: l != "")),
            "summary": _text("summary"),
            "attributes": clean_attributes(F.col("attributes")),
        }
    )


def canonicalize_edges(raw: DataFrame) -> DataFrame:
    """Endpoint keys by fallback, relation, fact and times; blank counts as missing in a fallback, missing times stay NULL."""
    key = lambda side: F.lower(collapse_whitespace(_first_set(*[c for c in (f"{side}_entity_key", f"{side}_name", f"{side}_entity_name", f"{side}_node_name", side) if c in raw.columns])))
    out = {
        "source_entity_key": key("source"),
        "target_entity_key": key("target"),
        "relation_type": collapse_whitespace(_first_set("relation_type", "name")),
        "fact": collapse_whitespace(_first_set("fact", "summary")),
        "attributes": clean_attributes(F.col("attributes")),
    }
    out |= {t: collapse_whitespace(F.col(t)) for t in ("valid_at", "invalid_at", "expired_at")}
    return raw.withColumns(out)


def _membership(left: DataFrame, right: DataFrame, columns: Sequence[str]) -> DataFrame:
    """Distinct rows of both sides with how often each side has them; combined map-side, so copies never pile up."""
    side = lambda df, n: df.select(*columns).withColumn("_s", F.lit(n))
    return side(left, "l").unionByName(side(right, "r")).groupBy(*columns).agg(F.count_if(F.col("_s") == "l").alias("_l"), F.count_if(F.col("_s") == "r").alias("_r"))


def symmetric_difference(left: DataFrame, right: DataFrame, projection: Sequence[str], group: Sequence[str] = (), out: str = "difference") -> DataFrame:
    """Number of distinct projected rows that only one side has."""
    rows = _membership(left, right, [*group, *projection])
    return rows.groupBy(*group).agg(F.count_if((F.col("_l") > 0) != (F.col("_r") > 0)).alias(out))


def canonical_diff(left: Mapping[str, DataFrame], right: Mapping[str, DataFrame], projections: Mapping[str, tuple[str, Sequence[str]]], group: Sequence[str] = ()) -> DataFrame:
    """Several symmetric differences at once: ``projections`` maps an output name to ``(table, columns)``.

    All are counted in one pass over tagged key hashes, of 32 bytes each. Map both namespaces to one logical name before calling.
    """
    parts, places = None, {n: i for i, n in enumerate(projections)}
    for name, (source, columns) in projections.items():
        for side, tables in (("l", left), ("r", right)):
            key = F.unhex(row_hash(*[F.col(c) for c in columns]))
            part = tables[source].select(*group, F.lit(places[name]).alias("_what"), key.alias("_key"), F.lit(1 if side == "l" else 2).alias("_s"))
            parts = part if parts is None else parts.unionByName(part)
    seen = parts.groupBy(*group, "_what", "_key").agg(F.bit_or("_s").alias("_s"))
    one = F.col("_s") != 3
    counts = seen.groupBy(*group).agg(*[F.count_if(one & (F.col("_what") == i)).alias(n) for n, i in places.items()], F.count_if(one).alias("total_diff"))
    return counts.withColumn("exact_match", F.col("total_diff") == 0)


def graph_compare(left: Mapping[str, DataFrame], right: Mapping[str, DataFrame], columns: Mapping[str, Sequence[str]], group: Sequence[str] = ()) -> DataFrame:
    """Per table (entities, edges, episodes): exact flag, row-count parity and precision, recall, F1 of the row sets."""
    parts = None
    for name, cols in columns.items():
        for side, tables in (("l", left), ("r", right)):
            part = tables[name].select(*group, F.lit(name).alias("part"), row_hash(*[F.col(c) for c in cols]).alias("_key"), F.lit(side).alias("_s"))
            parts = part if parts is None else parts.unionByName(part)
    seen = parts.groupBy(*group, "part", "_key").agg(F.count_if(F.col("_s") == "l").alias("_l"), F.count_if(F.col("_s") == "r").alias("_r"))
    has_l, has_r = F.col("_l") > 0, F.col("_r") > 0
    sizes = seen.groupBy(*group, "part").agg(
        F.count_if(has_l & has_r).alias("matched"),
        F.count_if(has_l).alias("left_size"),
        F.count_if(has_r).alias("right_size"),
        (F.sum("_l") == F.sum("_r")).alias("count_matches"),
        F.bool_and(has_l == has_r).alias("exact_match"),
    )
    return sizes.withColumns(precision_recall_f1(F.col("matched"), F.col("left_size"), F.col("right_size")))


def graph_hash(parts: Mapping[str, DataFrame], columns: Mapping[str, Sequence[str]], group: Sequence[str]) -> DataFrame:
    """Content hash of a snapshot that no row order can change: one digest over all rows tagged with their table."""
    rows = None
    for name, cols in columns.items():
        part = parts[name].select(*group, framed(F.lit(name), *[F.col(c) for c in cols]).alias("_row"))
        rows = part if rows is None else rows.unionByName(part)
    return rows.groupBy(*group).agg(F.count(F.lit(1)).alias("rows"), multiset_digest(F.col("_row")).alias("graph_hash"))


def graph_integrity_counts(expected: DataFrame, episodes: DataFrame, entities: DataFrame, edges: DataFrame, provenance: DataFrame, namespace: str) -> DataFrame:
    """Lost, duplicate and unexpected episodes; rows outside their namespace; endpoints and provenance that resolve to
    nothing or elsewhere; reversed validity. One row per namespace, zero where nothing is wrong.

    ``expected(ns, name)``, ``episodes(ns, name, episode_id)``, ``entities(ns, node)``, ``edges(ns, edge_id, source,
    target, valid_at, invalid_at)``, ``provenance(ns, edge_id, episode_id)``.
    """
    ns = namespace
    side = lambda df, s: df.select(ns, "name").withColumn("_s", F.lit(s))
    names = side(expected, "e").unionByName(side(episodes, "o")).groupBy(ns, "name").agg(F.count_if(F.col("_s") == "e").alias("_e"), F.count_if(F.col("_s") == "o").alias("_o"))
    e, o = F.col("_e"), F.col("_o")
    counts = names.groupBy(ns).agg(
        F.count_if((e > 0) & (o == 0)).alias("lost_episodes"), F.sum(F.when(e > 0, F.greatest(o - 1, F.lit(0))).otherwise(0)).alias("duplicate_episodes"), F.count_if((e == 0) & (o > 0)).alias("unexpected_episodes")
    )
    home = entities.select(F.col("node"), F.col(ns).alias("_home"))
    ends = edges.select(ns, F.explode(F.array("source", "target")).alias("node")).join(home, "node", "left")
    endpoint = ends.groupBy(ns).agg(F.count_if(F.col("_home").isNull()).alias("endpoint_missing"), F.count_if(F.col("_home") != F.col(ns)).alias("endpoint_escape"))
    lived = episodes.select("episode_id", F.col(ns).alias("_ep_ns")).distinct()
    proof = provenance.join(lived, "episode_id", "left").groupBy(ns).agg(
        F.count_if(F.col("_ep_ns").isNull()).alias("provenance_dangling"), F.count_if(F.col("_ep_ns") != F.col(ns)).alias("provenance_cross_namespace")
    )
    reversed_ = edges.groupBy(ns).agg(F.count_if(F.col("invalid_at") < F.col("valid_at")).alias("validity_reversed"))
    rows = counts.join(endpoint, ns, "left").join(proof, ns, "left").join(reversed_, ns, "left")
    return rows.fillna(0)


def semantic_diff(left: DataFrame, right: DataFrame, columns: Sequence[str], order: Sequence[str], examples: int, group: Sequence[str] = ()) -> DataFrame:
    """Added and removed rows: how many, and the first few of each in order. The counts are whole, only examples are few.

    The first ``order`` column is numeric.
    """
    rows = _membership(left, right, [*group, *columns])
    change = F.when(F.col("_l") == 0, "added").when(F.col("_r") == 0, "removed")
    changed = rows.withColumn("change", change).filter(F.col("change").isNotNull())
    by = [*group, "change"]
    ranked = ordered_scan(changed, by, list(order), rank="example", total={"changes": Running("sum", F.lit(1))})
    return ranked.filter(F.col("example") <= examples).select(*by, "changes", "example", *columns)


def fingerprint_records(df: DataFrame, keys: Sequence[str], order: Sequence[str], fields: Sequence[str]) -> DataFrame:
    """Digest of the rows as a set and as a sequence: the second also covers each row's position."""
    ranked = ordered_scan(df, keys, list(order), rank="_at")
    row = row_hash(*[F.col(c) for c in sorted(fields)])
    placed = F.concat_ws("|", F.col("_at").cast("string"), row)
    return ranked.groupBy(*keys).agg(F.count(F.lit(1)).alias("records"), multiset_digest(row).alias("membership_digest"), multiset_digest(placed).alias("ordered_digest"))


def multiset_coverage(published: DataFrame, observed: DataFrame, keys: Sequence[str], item: Sequence[str]) -> DataFrame:
    """Lost, duplicate and unexpected copies when both sides are compared as multisets."""
    rows = _membership(published, observed, [*keys, *item])
    e, o = F.col("_l"), F.col("_r")
    short, over = F.greatest(F.lit(0), e - o), F.greatest(F.lit(0), o - e)
    return rows.groupBy(*keys).agg(
        F.sum(e).alias("expected_copies"),
        F.sum(o).alias("observed_copies"),
        F.sum(short).alias("lost"),
        F.sum(F.when(e > 0, over).otherwise(0)).alias("duplicate"),
        F.sum(F.when(e == 0, over).otherwise(0)).alias("unexpected"),
    )


def run_equivalence(baseline: DataFrame, instrumented: DataFrame, keys: Sequence[str], order: Sequence[str], fields: Sequence[str], forbidden: Sequence[str] = ()) -> DataFrame:
    """Fields whose ordered values differ between two runs, and how often the instrumented run shows a forbidden effect."""
    def digests(df: DataFrame, name: str) -> DataFrame:
        at = ordered_scan(df, keys, list(order), rank="_at")
        pairs = F.explode(F.array(*[F.struct(F.lit(f).alias("field"), framed(F.col("_at"), F.col(f)).alias("v")) for f in fields]))
        return at.select(*keys, pairs.alias("_p")).groupBy(*keys, F.col("_p.field").alias("field")).agg(multiset_digest(F.col("_p.v")).alias(name))

    both = digests(baseline, "_a").join(digests(instrumented, "_b"), [*keys, "field"], "full_outer")
    differing = both.filter(~F.col("_a").eqNullSafe(F.col("_b"))).select(*keys, "field", F.lit("FIELD_DIFFERS").alias("finding"), F.lit(1).cast("long").alias("n"))
    for f in forbidden:
        used = instrumented.groupBy(*keys).agg(F.sum(f).alias("n")).filter("n > 0")
        differing = differing.unionByName(used.select(*keys, F.lit(f).alias("field"), F.lit("FORBIDDEN_EFFECT").alias("finding"), "n"))
    return differing


def candidate_list_diff(requested: DataFrame, expected: DataFrame, keys: Sequence[str], position: str, item: str) -> DataFrame:
    """Two ranked lists: did membership change, did order change, how many positions differ, is the common part in order."""
    a = requested.select(*keys, position, F.col(item).alias("_a"))
    b = expected.select(*keys, position, F.col(item).alias("_b"))
    slots = a.join(b, [*keys, position], "full_outer").groupBy(*keys).agg(
        F.count_if(F.col("_a").isNotNull()).alias("requested_size"), F.count_if(F.col("_b").isNotNull()).alias("expected_size"), F.count_if(~F.col("_a").eqNullSafe(F.col("_b"))).alias("substitutions")
    )
    members = _membership(requested, expected, [*keys, item]).groupBy(*keys).agg(F.bool_or(F.col("_l") != F.col("_r")).alias("membership_changed"), F.count_if((F.col("_l") > 0) & (F.col("_r") > 0)).alias("common"))
    shared = requested.select(*keys, item, F.col(position).alias("_pa")).join(expected.select(*keys, item, F.col(position).alias("_pb")), [*keys, item])
    steps = ordered_scan(shared, keys, ["_pa", "_pb"], lag={"_before": "_pb"}).groupBy(*keys).agg(F.bool_or(F.coalesce(F.col("_before") > F.col("_pb"), F.lit(False))).alias("common_order_changed"))
    rows = slots.join(members, list(keys)).join(steps, list(keys), "left").fillna(False, ["common_order_changed"])
    return rows.withColumn("order_changed", ~F.col("membership_changed") & (F.col("substitutions") > 0))


def union_streams(streams: Sequence[DataFrame], keys: Sequence[str], order: Sequence[str]) -> DataFrame:
    """Several producers' rows on one timeline per key, numbered; columns a producer lacks are NULL."""
    rows = streams[0]
    for s in streams[1:]:
        rows = rows.unionByName(s, allowMissingColumns=True)
    return ordered_scan(rows, keys, list(order), rank="position")
