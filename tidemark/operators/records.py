"""Row validation, normalisation, classification and identity hashing."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidemark.functions.digests import SET_BLOCK, block_digest, blocks_digest, canonical_json, framed, row_hash, sorted_digest
from tidemark.functions.text import collapse_whitespace, is_forbidden_key, json_keys
from tidemark.operators.ordered import largest_group, ordered_scan
from tidemark.session import cut_lineage


def render_bodies(turns: DataFrame, keys: Sequence[str], turn: str, role: Column, content: Column) -> DataFrame:
    """``[ROLE] content`` lines of a session in turn order, contents stripped: one row, one body per session."""
    stripped = F.regexp_replace(content, r"^\s+|\s+$", "")
    line = F.struct(F.col(turn).alias("t"), F.concat(F.lit("["), role, F.lit("] "), stripped).alias("line"))
    rows = turns.groupBy(*keys).agg(F.collect_list(line).alias("_l"), F.count(F.lit(1)).alias("turns"))
    return rows.select(*keys, "turns", F.array_join(F.transform(F.array_sort("_l"), lambda x: x["line"]), "\n").alias("body"))


def build_episodes(histories: DataFrame, history: str, sessions: str, dates: str, ids: str) -> DataFrame:
    """Explode a history into its sessions with position, date and id, and hash each canonical record.

    ``sessions`` is an array of arrays of ``struct(role, content)``; the three arrays run in parallel.
    """
    zipped = F.arrays_zip(F.col(sessions).alias("s"), F.col(dates).alias("d"), F.col(ids).alias("i"))
    rows = histories.select(history, F.posexplode(zipped).alias("source_sequence", "_z"))
    body = F.array_join(F.transform(F.col("_z.s"), lambda t: F.concat(F.lit("["), t["role"], F.lit("] "), t["content"])), "\n")
    return rows.select(history, "source_sequence", F.col("_z.i").alias("session_id"), F.col("_z.d").alias("reference_time"), body.alias("body")).withColumn(
        "source_hash",
        F.sha2(
            canonical_json(
                {
                    "question_id": F.col(history).cast("string"),
                    "session_id": F.col("session_id"),
                    "source_sequence": F.col("source_sequence"),
                    "reference_time": F.col("reference_time"),
                    "body": F.col("body"),
                }
            ),
            256,
        ),
    )


def eligible_records(df: DataFrame, question: str, kind: str, wanted: str) -> DataFrame:
    """Records of one question type that are not abstention items, with the hash they are ordered by."""
    rows = df.filter((F.col(kind) == wanted) & ~F.endswith(F.col(question), F.lit("_abs")))
    return rows.withColumn("order_hash", F.sha2(F.col(question), 256))


def freeze_split(eligible: DataFrame, question: str, calibration: int = 4, evaluation: int = 8) -> DataFrame:
    """First records by hash calibrate, the next ones evaluate. Only that many rows leave the top-k scan."""
    top = eligible.orderBy("order_hash", question).limit(calibration + evaluation)
    place = F.row_number().over(Window.partitionBy(F.lit(0)).orderBy("order_hash", question))
    return top.withColumn("position", place).withColumn("split", F.when(F.col("position") <= calibration, "calibration").otherwise("evaluation"))


def check_content_safe(df: DataFrame, row_id: Sequence[str], doc: str) -> DataFrame:
    """One row per forbidden key found at any depth of a JSON column."""
    return df.select(*row_id, F.explode(F.array_distinct(json_keys(F.col(doc)))).alias("key")).filter(is_forbidden_key(F.col("key")))


def gold_blind_projection(df: DataFrame, public: Sequence[str], private: Sequence[str]) -> DataFrame:
    """Public fields only. A private column among them is refused at plan time, a blank field when the row is read."""
    leaked = set(public) & set(private)
    if leaked:
        raise ValueError(f"private columns requested: {sorted(leaked)}")
    blank = F.lit(False)
    for c in public:
        blank = blank | F.col(c).isNull() | (F.trim(F.col(c).cast("string")) == "")
    first = F.when(blank, F.raise_error(F.lit("blank public field")).cast("string")).otherwise(F.col(public[0]).cast("string"))
    return df.select(first.cast(df.schema[public[0]].dataType).alias(public[0]), *public[1:])


def validate_attempt_outcomes(expected: DataFrame, outcomes: DataFrame, keys: Sequence[str], seq: str, status: str, allowed: Sequence[str]) -> DataFrame:
    """Exactly one terminal outcome per expected sequence: counts per outcome and per kind of defect."""
    by = [*keys, seq]
    seen = expected.select(*by, F.lit(1).alias("_e"), F.lit(None).cast("string").alias("_s")).unionByName(
        outcomes.select(*by, F.lit(0).alias("_e"), F.col(status).alias("_s"))
    )
    per = seen.groupBy(*by).agg(F.max("_e").alias("_e"), F.count_if(F.col("_e") == 0).alias("_n"), F.min("_s").alias("_s"), F.count_if(F.col("_s").isNotNull() & ~F.col("_s").isin(*allowed)).alias("_bad"))
    e, n = F.col("_e") == 1, F.col("_n")
    clean = e & (n == 1) & (F.col("_bad") == 0)
    return per.groupBy(*keys).agg(
        F.count_if(e).alias("expected"),
        *[F.count_if(clean & (F.col("_s") == a)).alias(a) for a in allowed],
        F.count_if(e & (n == 0)).alias("missing"),
        F.count_if(e & (n > 1)).alias("duplicated"),
        F.count_if(~e).alias("unexpected"),
        F.sum("_bad").alias("invalid_status"),
    )


def validate_exactly_once(expected: DataFrame, published: DataFrame, keys: Sequence[str], seq: str, order: Sequence[str], *, hot: int | None = None) -> DataFrame:
    """Loss, duplication, unexpected rows and breaks of first-in-first-out order of a publication log."""
    by = [*keys, seq]
    side = lambda df, n: df.select(*by).withColumn("_s", F.lit(n))
    per = side(expected, "e").unionByName(side(published, "p")).groupBy(*by).agg(F.count_if(F.col("_s") == "e").alias("_e"), F.count_if(F.col("_s") == "p").alias("_p"))
    e, p = F.col("_e") > 0, F.col("_p")
    counts = per.groupBy(*keys).agg(
        F.count_if(e).alias("requested"),
        F.sum(p).alias("published"),
        F.count_if(e & (p == 0)).alias("loss_count"),
        F.sum(F.greatest(p - 1, F.lit(0))).alias("duplicate_count"),
        F.sum(F.when(~e, p).otherwise(0)).alias("unexpected_count"),
    )
    steps = ordered_scan(published.select(*keys, seq, *[o for o in order if o != seq]), keys, list(order), lag={"_prev": seq}, hot=hot)
    breaks = steps.groupBy(*keys).agg(F.count_if(F.col("_prev") > F.col(seq)).alias("order_breaks"))
    return counts.join(breaks, list(keys), "left").fillna(0, ["order_breaks"])


def validate_lifecycle_rows(events: DataFrame, keys: Sequence[str], source: str, event: str, ts: str, required: Sequence[str]) -> DataFrame:
    """Per source: every required event once and in time order. Per key also whether sources run from 0 without a gap."""
    per = events.groupBy(*keys, source).agg(
        *[F.min(F.when(F.col(event) == r, F.col(ts))).alias(f"_t{i}") for i, r in enumerate(required)],
        *[F.count_if(F.col(event) == r).alias(f"_n{i}") for i, r in enumerate(required)],
        F.count_if(~F.col(event).isin(*required)).alias("_other"),
    )
    missing, twice, disorder = F.lit(False), F.lit(False), F.lit(False)
    for i in range(len(required)):
        missing = missing | (F.col(f"_n{i}") == 0)
        twice = twice | (F.col(f"_n{i}") > 1)
        if i:
            disorder = disorder | F.coalesce(F.col(f"_t{i}") < F.col(f"_t{i - 1}"), F.lit(False))
    flags = per.select(*keys, source, missing.alias("_m"), twice.alias("_d"), disorder.alias("_o"), (F.col("_other") > 0).alias("_x"))
    n = F.count(F.lit(1))
    return flags.groupBy(*keys).agg(
        n.alias("sources"),
        F.count_if("_m").alias("incomplete"),
        F.count_if("_d").alias("duplicated"),
        F.count_if("_o").alias("out_of_order"),
        F.count_if("_x").alias("unknown_events"),
        ((F.min(source) == 0) & (F.max(source) == n - 1)).alias("contiguous"),
    )


def coalesce_duplicate_ids(df: DataFrame, row_id: Sequence[str], position: str, payload: Sequence[str]) -> DataFrame:
    """First row per id by position, with the number of copies and whether their payloads conflict."""
    digest = row_hash(*[F.col(c) for c in payload])
    kept = df.groupBy(*row_id).agg(
        F.min_by(F.struct(*payload), F.col(position)).alias("_first"), F.count(F.lit(1)).alias("copies"), (F.min(digest) != F.max(digest)).alias("conflict")
    )
    return kept.select(*row_id, *[F.col(f"_first.{c}").alias(c) for c in payload], "copies", "conflict")


def number_duplicate_ids(df: DataFrame, row_id: str, order: Sequence[str], *, hot: int | None = None) -> DataFrame:
    """``:dupN`` is appended to the second and later rows of an id, in input order."""
    ranked = ordered_scan(df, [row_id], list(order), rank="_r", hot=hot)
    name = F.when(F.col("_r") > 1, F.concat(F.col(row_id).cast("string"), F.lit(":dup"), (F.col("_r") - 1).cast("string"))).otherwise(F.col(row_id).cast("string"))
    return ranked.withColumn("unique_id", name).drop("_r")


def qualify_dataset(df: DataFrame, record: Sequence[str], rules: Mapping[str, Column]) -> tuple[DataFrame, DataFrame]:
    """Judge every record on its own: ``(accepted, defects)``. ``rules`` maps a reason to the condition for a defect."""
    reasons = F.array_compact(F.array(*[F.when(F.coalesce(c, F.lit(True)), F.lit(r)) for r, c in rules.items()]))
    judged = df.withColumn("_reasons", reasons)
    accepted = judged.filter(F.size("_reasons") == 0).drop("_reasons")
    defects = judged.select(*record, F.explode("_reasons").alias("reason"))
    return accepted, defects


def request_size_class(prompt: Column, output: Column, prompt_cutoff: int, decode_cutoff: int) -> Column:
    return F.when(prompt < prompt_cutoff, "SHORT").when(output < decode_cutoff, "LONG_PREFILL").otherwise("MIXED")


def map_labels(df: DataFrame, label: str, lookup: DataFrame, columns: Sequence[str], defaults: Sequence[str]) -> DataFrame:
    """Left join to a label table with fixed defaults; Spark broadcasts it when its measured size allows."""
    return df.join(lookup, label, "left").withColumns({c: F.coalesce(F.col(c), F.lit(d)) for c, d in zip(columns, defaults)})


# Observations that are violations when causal evidence is direct.
DIRECT_OBSERVATIONS = ("future_persistent_state_read", "stale_predecessor_write", "wrong_state_write")
HARNESS_OBSERVATION = "future_source_payload_read"


def observation_class(observation: Column, direct: Column) -> Column:
    violation = observation.isin(*DIRECT_OBSERVATIONS) & direct
    return F.when(observation == HARNESS_OBSERVATION, "HARNESS_VIOLATION").when(violation, "DIRECT_SEMANTIC_VIOLATION").otherwise("ORDERING_OBSERVATION")


def reader_judge_class(human: Column, judge: Column) -> Column:
    return (
        F.when(human & judge, "READER_CORRECT_JUDGE_YES")
        .when(human & ~judge, "READER_CORRECT_JUDGE_FALSE_NEGATIVE")
        .when(~human & judge, "READER_WRONG_JUDGE_FALSE_POSITIVE")
        .when(~human & ~judge, "READER_WRONG_JUDGE_NO")
    )


def semantic_projection_hash(df: DataFrame, declared: Sequence[str], runtime: Sequence[str], out: str = "semantic_hash") -> DataFrame:
    """Hash of the declared fields in name order; declaring a runtime field is refused."""
    refused = set(declared) & set(runtime)
    if refused:
        raise ValueError(f"runtime fields cannot be semantic: {sorted(refused)}")
    return df.withColumn(out, row_hash(*[F.col(c) for c in sorted(declared)]))


def edge_identity_hash(edges: DataFrame, endpoints: DataFrame, *, edge_id: str, source: str, target: str, node: str, projection: Sequence[str], fact: str, relation: str, temporal: Sequence[str], expired: Column, provenance: str) -> DataFrame:
    """Hash of what an edge says: fact, relation, both endpoints' projections, times, expiry and provenance. Ids stay out."""
    side = lambda name, at: endpoints.select(F.col(node).alias(at), row_hash(*[F.col(c) for c in projection]).alias(name))
    joined = edges.join(side("_sh", source), source).join(side("_th", target), target)
    return joined.select(
        edge_id,
        row_hash(row_hash(F.col(fact)), row_hash(F.col(relation)), F.col("_sh"), F.col("_th"), row_hash(*[F.col(t) for t in temporal]), expired, row_hash(F.col(provenance))).alias("identity_hash"),
    )


#: Rows of nodes and edges of a unit whose sets a task may hold.
UNIT_ROWS = 200_000


def conflict_signature(nodes: DataFrame, edges: DataFrame, unit: str, namespace: str, name: str, label: str, node: str, source: str, target: str, *, hot: int | None = None) -> DataFrame:
    """What a unit would touch: distinct canonical names, their types and the names its relations end at.

    Sets are kept as counts and SHA-256 digests of their sorted values. Units of at most ``UNIT_ROWS`` rows take one shuffle by
    ``unit`` and are sorted as arrays; larger ones are ranked and hashed by blocks, so a unit may name any number of entities.
    ``hot`` is a bound of a unit's rows in ``nodes`` and ``edges`` together, where the caller knows one.
    ``reasons`` says why a signature is incomplete; an incomplete one proves nothing.
    """
    if hot is None:
        hot = largest_group(nodes.select(unit).unionByName(edges.select(unit)), [unit])
    canon = F.lower(collapse_whitespace(F.coalesce(F.col(name), F.lit(""))))
    none = lambda df, c: F.lit(None).cast(df.schema[c].dataType)
    # kinds: 0 a node, 1 an edge from a node to itself, 2 any other edge
    named = nodes.select(unit, F.lit(0).cast("byte").alias("_kind"), F.col(node).alias("_n"), none(edges, target).alias("_m"), canon.alias("_name"), F.col(namespace).alias("_ns"), F.col(label).alias("_label"))
    loop = F.col(source).eqNullSafe(F.col(target))
    ends = edges.select(
        unit, F.when(loop, 1).otherwise(2).cast("byte").alias("_kind"), F.col(source).alias("_n"), F.when(~loop, F.col(target)).alias("_m"), F.lit(None).cast("string").alias("_name"), none(nodes, namespace).alias("_ns"), none(nodes, label).alias("_label")
    )
    rows = named.unionByName(ends)
    if hot <= UNIT_ROWS:
        sets = _sets_in_tasks(rows, unit)
    else:
        large = nodes.select(unit).unionByName(edges.select(unit)).groupBy(F.col(unit).alias("_large")).agg(F.count(F.lit(1)).alias("_rows"))
        large = cut_lineage(large.filter(F.col("_rows") > UNIT_ROWS).select("_large"), "units-large")
        same = F.col(unit).eqNullSafe(F.col("_large"))
        sets = _sets_in_tasks(rows.join(large, same, "left_anti"), unit).unionByName(_sets_by_rank(rows.join(large, same, "left_semi"), unit))
    why = {"ENTITY_NAME_INVALID": "_blank", "EXTRACTED_ID_DUPLICATE": "_twice", "MIXED_NAMESPACES": "_mixed", "RELATION_ENDPOINT_UNRESOLVED": "_loose"}
    reasons = F.array_compact(F.array(*[F.when(F.coalesce(F.col(c), F.lit(False)), F.lit(r)) for r, c in why.items()]))
    counts = [F.coalesce(F.col(c), F.lit(0)).cast("long").alias(c) for c in ("n_names", "n_types", "n_endpoints")]
    return sets.select(unit, *counts, "names_digest", "types_digest", "endpoints_digest", F.array_join(reasons, ",").alias("reasons"), (F.size(reasons) == 0).alias("complete"))


def _unit_nodes(rows: DataFrame, unit: str) -> DataFrame:
    """One row per unit and node, however often it was named: what it is called, whether a relation ends there, what is wrong."""
    own = F.col("_kind") == 0
    at = rows.select(unit, F.explode(F.when(F.col("_kind") == 2, F.array("_n", "_m")).otherwise(F.array("_n"))).alias("_n"), "_kind", "_name", "_ns", "_label")
    at = at.groupBy(unit, "_n").agg(F.count_if(own).alias("_own"), F.count_if(~own).alias("_ends"), F.collect_set(F.when(own, F.struct("_name", "_label"))).alias("_all"), F.collect_set("_ns").alias("_in"))
    says, ended = F.filter("_all", lambda x: x["_name"] != ""), F.col("_ends") > 0
    return at.select(
        unit, says.alias("_says"), F.when(ended, says).alias("_ended"), "_in", (F.col("_own") > 0).alias("_there"),
        (F.col("_own") > 1).alias("_twice"), (F.size("_all") > F.size(says)).alias("_blank"), (ended & (F.size(says) == 0)).alias("_loose"),
    )


_FLAGS = ("_there", "_twice", "_blank", "_loose")


def _name_text(x: Column) -> Column:
    return framed(x)


def _type_text(x: Column) -> Column:
    return framed(x["_name"], x["_label"])


def _sets_in_tasks(rows: DataFrame, unit: str) -> DataFrame:
    """Counts, digests and flags of units that each fit a task; both aggregates go by the partitions of the one shuffle."""
    all_of = lambda c: F.flatten(F.collect_list(c))
    units = _unit_nodes(rows.repartition(unit), unit).groupBy(unit).agg(*[all_of(c).alias(c) for c in ("_says", "_ended", "_in")], *[F.bool_or(c).alias(c) for c in _FLAGS]).filter("_there")
    names = lambda c: F.sort_array(F.array_distinct(F.transform(c, lambda x: x["_name"])))
    sets = units.select(unit, names("_says").alias("_names"), F.sort_array(F.array_distinct("_says")).alias("_types"), names("_ended").alias("_endpoints"), (F.size(F.array_distinct("_in")) > 1).alias("_mixed"), *_FLAGS)
    texts = {"names": _name_text, "types": _type_text, "endpoints": _name_text}
    return sets.select(unit, *[F.size(f"_{k}").cast("long").alias(f"n_{k}") for k in texts], *[sorted_digest(F.col(f"_{k}"), t).alias(f"{k}_digest") for k, t in texts.items()], "_mixed", *_FLAGS)


def _sets_by_rank(rows: DataFrame, unit: str) -> DataFrame:
    """:func:`_sets_in_tasks` for units of any size: values are ranked per unit and set, and hashed by blocks of ranks."""
    at = cut_lineage(_unit_nodes(rows, unit), "units")
    flags = at.groupBy(unit).agg(*[F.bool_or(c).alias(c) for c in _FLAGS]).filter("_there")
    spaces = at.select(unit, F.explode("_in").alias("_in")).distinct().groupBy(unit).agg((F.count(F.lit(1)) > 1).alias("_mixed"))
    item = lambda kind, x, tag: F.struct(F.lit(kind).alias("kind"), x["_name"].alias("_name"), tag.alias("_label"))
    blank = F.lit(None).cast(rows.schema["_label"].dataType)
    said = F.concat(
        F.transform("_says", lambda x: item("names", x, blank)), F.transform("_says", lambda x: item("types", x, x["_label"])), F.transform(F.coalesce("_ended", F.array_except("_says", "_says")), lambda x: item("endpoints", x, blank))
    )
    values = at.select(unit, F.explode(said).alias("_f")).select(unit, "_f.*").distinct()
    ranked = ordered_scan(values, [unit, "kind"], ["_name", "_label"], rank="_r").withColumn("_b", F.floor((F.col("_r") - 1) / SET_BLOCK))
    text = lambda x: F.when(x["kind"] == "types", _type_text(x)).otherwise(_name_text(x["_name"]))
    blocks = ranked.groupBy(unit, "kind", "_b").agg(F.count(F.lit(1)).alias("_c"), block_digest(F.sort_array(F.collect_list(F.struct("_r", "kind", "_name", "_label"))), text).alias("_h"))
    sets = blocks.groupBy(unit, "kind").agg(F.sum("_c").alias("_c"), blocks_digest(F.transform(F.sort_array(F.collect_list(F.struct("_b", "_h"))), lambda x: x["_h"])).alias("_h"))
    of = lambda kind, c: F.max(F.when(F.col("kind") == kind, F.col(c)))
    kinds = ("names", "types", "endpoints")
    sets = sets.groupBy(unit).agg(*[of(k, "_c").alias(f"n_{k}") for k in kinds], *[of(k, "_h").alias(f"{k}_digest") for k in kinds])
    for more, at_ in ((spaces, "_u1"), (sets, "_u2")):
        more = more.withColumnRenamed(unit, at_)
        flags = flags.join(more, F.col(unit).eqNullSafe(F.col(at_)), "left").drop(at_)
    return flags.select(unit, *[f"n_{k}" for k in kinds], *[f"{k}_digest" for k in kinds], "_mixed", *_FLAGS)
