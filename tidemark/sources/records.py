"""Readers for JSON, sealed lines, metric text and event logs. Bad rows are returned, not dropped."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tidemark.functions.text import glob_to_regex
from tidemark.operators.ordered import Running, largest_group, ordered_scan
from tidemark.session import cut_lineage

CORRUPT = "_corrupt_record"


_PLACE = ["_b", "_m"]  # block and row: the order of a file's pieces
# Fixed value: how a document that holds its records in ``data`` begins.
_DATA = r'^\s*\{\s*"data"\s*:\s*\['


def _pieces(spark: SparkSession, path: str | list[str], by: str) -> DataFrame:
    """The texts of files cut at ``by``, with the file, its size and the place in it; many tasks cut a file of any size."""
    meta = lambda name: F.col(f"_metadata.{name}")
    return spark.read.option("lineSep", by).text(path).select("value", meta("file_path").alias("_f"), meta("file_size").alias("_size"), meta("file_block_start").alias("_b"), F.monotonically_increasing_id().alias("_m"))


def _whole_files(pieces: DataFrame) -> DataFrame:
    """Files whose records may stretch over lines: the first piece opens an array or a ``data`` array, or goes on after a line feed."""
    heads = pieces.filter((F.col("_b") == 0) & F.col("value").rlike(r"\S")).groupBy("_f").agg(F.min_by("value", F.struct(*_PLACE)).alias("_head"))
    return heads.filter(F.col("_head").rlike(r"^\s*\[") | F.col("_head").rlike(_DATA) | F.col("_head").rlike(r"\S[^\n]*\n\s*\S")).select("_f")


def _with_depth(pieces: DataFrame, hot: int) -> DataFrame:
    """Pieces cut at closing braces with ``_depth``, the depth of brackets after each, and ``_low``, the least on the way.

    Two scans over the order of a file: the parity of quotes says whether a piece begins inside a string, then brackets
    outside strings are counted. ``_cut``: a brace ended the piece; ``_inside``: it ends inside a string.
    """
    plain = F.regexp_replace("value", r"(?s)\\.", "")  # escapes out of the way
    quotes = F.length(plain) - F.length(F.replace(plain, F.lit('"'), F.lit("")))
    rows = pieces.withColumns({"_plain": plain, "_q": quotes})
    rows = ordered_scan(rows, ["_f"], _PLACE, lead={"_next": "_m"}, running={"_quotes": Running("sum", F.col("_q"))}, total={"_bytes": Running("sum", F.octet_length("value") + 1)}, hot=hot)
    inside = (F.col("_quotes") - F.col("_q")) % 2 == 1
    bare = F.regexp_replace(F.concat(F.when(inside, '"').otherwise(""), "_plain"), r'"[^"]*("|$)', "")
    # each piece but the last ended at a brace; the last one did if the sizes say so
    rows = rows.withColumns({"_marks": F.filter(F.split(F.regexp_replace(bare, r"[^\[\]{}]", ""), ""), lambda c: c != ""), "_inside": F.col("_quotes") % 2 == 1, "_cut": F.col("_next").isNotNull() | (F.col("_bytes") == F.col("_size"))})
    step = lambda acc, c: F.struct((acc["at"] + F.when(c.isin("{", "["), 1).otherwise(-1)).alias("at"), F.least(acc["low"], acc["at"] + F.when(c.isin("{", "["), 1).otherwise(-1)).alias("low"))
    rows = rows.withColumn("_walk", F.aggregate("_marks", F.struct(F.lit(0).alias("at"), F.lit(0).alias("low")), step))
    rows = rows.withColumn("_net", F.col("_walk.at") - F.when(F.col("_cut") & ~F.col("_inside"), 1).otherwise(0))
    rows = ordered_scan(rows, ["_f"], _PLACE, running={"_depth": Running("sum", F.col("_net"))}, hot=hot)
    return rows.select("value", "_f", *_PLACE, "_depth", (F.col("_depth") - F.col("_net") + F.col("_walk.low")).alias("_low"), "_cut", "_inside", F.col("_next").isNull().alias("_end"))


def json_texts(spark: SparkSession, path: str | list[str]) -> DataFrame:
    """``value``: the text of every JSON line or document, and of every element of a document that is an array or begins with ``data``.

    Files are told apart by their beginning. Files of lines give their lines. Arrays and documents over several lines are cut
    at the braces that close a record, found from the depth of brackets, so a large file is split over tasks and no file name
    reaches the driver. A file whose brackets do not balance is read by lines.
    """
    pieces = _pieces(spark, path, "}")
    whole = cut_lineage(_whole_files(pieces), "json-files")
    lines = _pieces(spark, path, "\n").select(F.regexp_replace("value", r"\r$", "").alias("value"), "_f")
    if whole.isEmpty():
        return lines.filter(F.col("value").rlike(r"\S")).select("value")
    pieces = cut_lineage(pieces.join(whole, "_f", "left_semi"), "json-pieces")
    hot = largest_group(pieces, ["_f"])
    rows = _with_depth(pieces, hot)
    closes = ~F.col("_inside") & F.col("_cut")
    # a document ends where the depth is back at 0
    rows = ordered_scan(rows, ["_f"], _PLACE, running={"_doc": Running("sum", F.when((F.col("_depth") <= 0) & closes, 1).otherwise(0), False)}, hot=hot)
    rows = cut_lineage(rows.withColumn("_doc", F.coalesce("_doc", F.lit(0))), "json-depths")
    state = rows.groupBy("_f").agg(F.min(F.least("_low", "_depth")).alias("_least"), F.max(F.when(F.col("_end"), F.col("_depth"))).alias("_last"), F.bool_or(F.col("_end") & F.col("_inside")).alias("_string"))
    sound = cut_lineage(state.filter("_least = 0 AND _last = 0 AND NOT _string").select("_f"), "json-sound")

    first = F.min_by("value", F.struct(*_PLACE))
    rows = rows.join(sound, "_f", "left_semi")
    bases = rows.groupBy("_f", "_doc").agg(F.when(first.rlike(r"^\s*\["), 1).when(first.rlike(_DATA), 2).otherwise(0).alias("_base"))
    rows = rows.join(bases, ["_f", "_doc"])
    # once the array of records is closed, the rest of the document is none of them; its first piece comes from below
    rows = ordered_scan(rows, ["_f", "_doc"], _PLACE, rank="_p", hot=hot)
    under = ((F.col("_low") < F.col("_base")) & (F.col("_p") > 1)).cast("int")
    ends = (F.col("_depth") == F.col("_base")) & closes
    rows = ordered_scan(rows, ["_f", "_doc"], _PLACE, running={"_past": Running("max", under), "_rec": Running("sum", F.when(ends, 1).otherwise(0), False)}, hot=hot)
    part = F.struct(*_PLACE, F.concat("value", F.when(F.col("_cut"), "}").otherwise("")).alias("v"))
    texts = rows.groupBy("_f", "_doc", "_base", "_past", F.coalesce("_rec", F.lit(0)).alias("_rec")).agg(F.array_join(F.transform(F.array_sort(F.collect_list(part)), lambda x: x["v"]), "").alias("value"))
    lead = F.when(F.col("_base") == 2, F.regexp_replace("value", _DATA, "")).when(F.col("_base") == 1, F.regexp_replace("value", r"^\s*\[", "")).otherwise(F.col("value"))
    texts = texts.withColumn("value", F.when(F.col("_base") > 0, F.regexp_replace(lead, r"^[\s,]+", "")).otherwise(lead))
    # behind the last record only the end of the array is as it should be
    tail = (F.col("_past") > 0) & F.col("value").rlike(r"^\]")
    texts = texts.filter(F.col("value").rlike(r"[^\s\]}]") & ~tail)
    return texts.select("value").unionByName(lines.filter(F.col("value").rlike(r"\S")).join(sound, "_f", "left_anti").select("value"))


def read_json_records(spark: SparkSession, path: str | list[str], schema: T.StructType) -> tuple[DataFrame, DataFrame]:
    """JSON arrays, JSON lines and documents over several lines: ``(records, texts that could not be read)``; see :func:`json_texts`."""
    full = T.StructType([*schema.fields, T.StructField(CORRUPT, T.StringType())])
    parsed = json_texts(spark, path).withColumn("_r", F.from_json("value", full, {"mode": "PERMISSIVE", "columnNameOfCorruptRecord": CORRUPT}))
    broken = F.col(f"_r.{CORRUPT}").isNotNull()
    return parsed.filter(~broken).select("_r.*").drop(CORRUPT), parsed.filter(broken).select("value")


def read_corpus_records(spark: SparkSession, path: str, record: T.StructType, *, source: str = "*") -> tuple[DataFrame, DataFrame]:
    """Records given one by one, in arrays or as ``{"data": [records]}``: ``(records, texts that could not be read)``.

    Records are kept by source pattern, with an id from the content where none is given. ``record`` has the string fields
    ``source``, ``context_id`` and ``context``.
    """
    both = T.StructType([*record.fields, T.StructField("data", T.ArrayType(record))])
    parsed, bad = read_json_records(spark, path, both)
    own = F.struct(*[F.col(f.name) for f in record.fields])
    rows = parsed.select(F.explode(F.coalesce("data", F.array(own))).alias("x")).select("x.*")
    label = F.coalesce(F.when(F.trim("source") != "", F.trim("source")), F.lit("UNKNOWN"))
    digest = F.substring(F.sha2(F.coalesce("context", F.lit("null")), 256), 1, 16)
    given = F.when(F.trim("context_id") != "", F.trim("context_id"))
    return rows.withColumn("source", label).filter(F.col("source").rlike(glob_to_regex(source))).withColumn("context_id", F.coalesce(given, F.concat_ws(":", "source", digest))), bad


def verify_sealed_lines(lines: DataFrame, schema_version: str, row: T.StructType, producer: str, seq: str, ts: str) -> DataFrame:
    """Parsed rows of ``{"record": ..., "record_sha256": ...}`` lines with a ``seal_status``.

    A line is checked on its own: no other keys in the envelope and record, the version and only known fields in the row,
    and the hash of the record's canonical JSON, however the line orders its keys. The lines that pass are then checked per
    producer for gaps in the sequence and for time running backwards.
    """
    record = F.get_json_object("value", "$.record")
    keys = lambda text: F.array_sort(F.coalesce(F.json_object_keys(text), F.array().cast("array<string>")))
    names = lambda *n: F.array(*[F.lit(x) for x in n])
    rows = lines.select("value", record.alias("_rec"), F.get_json_object("value", "$.record_sha256").alias("_sha"), F.get_json_object("value", "$.record.schema_version").alias("_ver"))
    rows = rows.withColumn("_row", F.get_json_object("_rec", "$.row")).withColumn("_keys", keys(F.col("_row"))).withColumn("r", F.from_json("_row", row))
    # canonical JSON: keys in order, no blanks; absent fields stay absent
    pieces = []
    for f in sorted(row.fieldNames()):
        shown = F.to_json(F.struct(F.col(f"r.{f}").alias(f)), {"ignoreNullFields": "false"})
        pieces.append(F.when(F.array_contains("_keys", f), F.substring(shown, F.lit(2), F.length(shown) - 2)))
    version = F.to_json(F.struct(F.col("_ver").alias("schema_version")), {"ignoreNullFields": "false"})
    canonical = F.concat(F.lit('{"row":{'), F.concat_ws(",", *pieces), F.lit("},"), F.substring(version, F.lit(2), F.length(version) - 1))
    shape = (
        F.when(F.col("_rec").isNull() | F.col("_sha").isNull() | (keys(F.col("value")) != names("record", "record_sha256")) | (keys(F.col("_rec")) != names("row", "schema_version")), "ENVELOPE_INVALID")
        .when(~F.col("_ver").eqNullSafe(F.lit(schema_version)) | (F.size(F.array_except("_keys", names(*row.fieldNames()))) > 0), "SCHEMA_INVALID")
        .when(F.sha2(canonical, 256) != F.col("_sha"), "HASH_MISMATCH")
        .otherwise("OK")
    )
    # the lines are parsed once; what follows reads their fields several times
    parsed = cut_lineage(rows.select(shape.alias("_shape"), "r.*"), "sealed-parsed")
    good = parsed.filter("_shape = 'OK'")
    chained = ordered_scan(good, [producer], [seq], lag={"_ps": seq, "_pt": ts})
    status = (
        F.when(F.col(seq) != F.coalesce(F.col("_ps") + 1, F.lit(0)), "SEQUENCE_GAP").when(F.col(ts) < F.col("_pt"), "TIME_REGRESSION").otherwise("OK")
    )
    fields = [f.name for f in row.fields]
    return chained.select(*fields, status.alias("seal_status")).unionByName(parsed.filter("_shape <> 'OK'").select(*fields, F.col("_shape").alias("seal_status")))


def unwrap_envelope(doc: Column) -> Column:
    """``record.row``, else ``record``, else the document itself, as JSON text."""
    return F.coalesce(F.get_json_object(doc, "$.record.row"), F.get_json_object(doc, "$.record"), doc)


METRIC_LINE = r"^([a-zA-Z_:][a-zA-Z0-9_:]*)(?:\{[^}]*\})?\s+(\S+)(?:\s+(\d+))?\s*$"
METRIC_LABEL = r'^[a-zA-Z_:][a-zA-Z0-9_:]*\{(?:[^}]*,)?\s*%s="([^"]*)"'


def read_metric_text(lines: DataFrame, metrics: Mapping[str, str], source: str | None = None) -> DataFrame:
    """Exposition lines ``name{labels} value time`` to one row per time, one column per known metric.

    Where several sources are scraped, ``source`` names the label that tells them apart: one row per source and time, and
    the label is a column. Scrapes of two sources at one instant stay two rows.

    ``series_status`` is DUPLICATE when a metric has several series at a time, INCOMPLETE when one is missing.
    """
    by = [source] if source else []
    name, value, at = (F.regexp_extract("value", METRIC_LINE, i) for i in (1, 2, 3))
    parsed = lines.filter(~F.col("value").rlike(r"^\s*(#|$)")).select(name.alias("_m"), F.expr(f"try_cast(regexp_extract(value, r'{METRIC_LINE}', 2) AS double)").alias("_v"), at.cast("long").alias("ts"), *[F.regexp_extract("value", METRIC_LABEL % s, 1).alias(s) for s in by])
    known = parsed.filter(F.col("_m").isin(*metrics))
    rows = known.groupBy(*by, "ts").agg(*[F.max(F.when(F.col("_m") == m, F.col("_v"))).alias(c) for m, c in metrics.items()], *[F.count_if(F.col("_m") == m).alias(f"_n_{c}") for m, c in metrics.items()])
    most = F.greatest(*[F.col(f"_n_{c}") for c in metrics.values()], F.lit(0))
    least = F.least(*[F.col(f"_n_{c}") for c in metrics.values()], F.lit(9))
    return rows.select(*by, "ts", *metrics.values(), F.when(most > 1, "DUPLICATE").when(least < 1, "INCOMPLETE").otherwise("OK").alias("series_status"))


def read_event_log(lines: DataFrame, fields: Sequence[str]) -> DataFrame:
    """Log lines whose ``event`` is a name or an object: ``event_type, timestamp_ns`` and the asked fields, as strings.

    A named event's monotonic clock becomes its time; an object replaces the line.
    """
    line = F.col("value")
    event = F.get_json_object(line, "$.event")
    nested = F.coalesce(F.startswith(F.ltrim(event), F.lit("{")), F.lit(False))
    own = F.when(nested, event).otherwise(line)
    kind = F.when(nested | event.isNull(), F.get_json_object(own, "$.event_type")).otherwise(event)
    clock = F.coalesce(F.when(~nested & event.isNotNull(), F.get_json_object(line, "$.monotonic_ns")), F.get_json_object(own, "$.timestamp_ns"))
    return lines.select(kind.alias("event_type"), clock.cast("long").alias("timestamp_ns"), *[F.get_json_object(own, f"$.{f}").alias(f) for f in fields])


# Which phases belong to which view, and which states are not errors.
VIEW_PHASES = {"llm": ("llm", "llm-transport"), "embedding": ("embedding", "candidate-embedding"), "db": ("database", "database-transaction")}
FINE_STATES = ("ok", "success", "completed")


def route_operation_views(spans: DataFrame, phase: str, status: str, views: Mapping[str, Sequence[str]] = VIEW_PHASES, fine: Sequence[str] = FINE_STATES) -> DataFrame:
    """Every span in ``spans``, in its operation view and, when it failed, in ``errors``: one scan, rows tagged ``view``."""
    kind = F.lit(None).cast("string")
    for name, phases in views.items():
        kind = F.when(F.col(phase).isin(*phases), name).otherwise(kind)
    failed = F.col(status).isNotNull() & ~F.col(status).isin(*fine)
    tags = F.array_compact(F.array(F.lit("spans"), F.coalesce(kind, F.lit("events")), F.when(failed, "errors")))
    return spans.withColumn("view", F.explode(tags))
