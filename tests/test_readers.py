"""JSON files of every shape: arrays, documents over many lines, lines, braces in strings, broken files."""

import json
import random

from pyspark.sql import functions as F
from pyspark.sql import types as T

from tidemark.operators.ordered import ROWS_PER_TASK_CONF
from tidemark.sources import records as sources

SCHEMA = T.StructType([T.StructField("a", T.LongType()), T.StructField("s", T.StringType()), T.StructField("n", T.StructType([T.StructField("x", T.LongType())]))])


def read(spark, path):
    good, bad = sources.read_json_records(spark, str(path), SCHEMA)
    return sorted((r.a, r.s, r.n.x if r.n else None) for r in good.collect()), sorted(r.value for r in bad.collect())


def records(rng, first, n):
    odd = ['}', '{"', "a\\", '"', "]}\n[{", "ü}", "", "\\}\\", 'x"}']
    return [{"a": first + i, "s": "".join(rng.choices(odd, k=rng.randint(0, 4))), "n": {"x": i} if i % 3 else None} for i in range(n)]


def test_every_shape_in_one_folder(spark, tmp_path):
    rng, want = random.Random(2), []
    shapes = {
        "array": lambda r: json.dumps(r),
        "pretty": lambda r: json.dumps(r, indent=2, ensure_ascii=False) + "\n\n",
        "data": lambda r: json.dumps({"data": r}),
        "data_first": lambda r: json.dumps({"data": r, "more": {"y": {"z": [1, {"a": 5}]}}}, indent=1),
        "lines": lambda r: "\n".join(map(json.dumps, r)) + "\r\n\n",
        "several": lambda r: "\n".join(json.dumps(x, indent=1) for x in r),
    }
    for k, (name, shape) in enumerate(shapes.items()):
        rows = records(rng, 100 * k, 12)
        want += rows
        (tmp_path / f"{name} {k}.json").write_text(shape(rows), encoding="utf-8")
    (tmp_path / "empty.json").write_text("")
    (tmp_path / "none.json").write_text(" [ ]\n")
    expected = sorted((r["a"], r["s"], r["n"]["x"] if r["n"] else None) for r in want)
    assert read(spark, tmp_path) == (expected, [])
    # a file as the hot key of every scan
    spark.conf.set(ROWS_PER_TASK_CONF, "20")
    try:
        assert read(spark, tmp_path) == (expected, [])
    finally:
        spark.conf.unset(ROWS_PER_TASK_CONF)


def test_bad_texts_come_back(spark, tmp_path):
    (tmp_path / "cut.json").write_text('[{"a": 1}, {"a": 2')
    (tmp_path / "string.json").write_text('[{"a": 1}, {"s": "open}')
    (tmp_path / "lines.json").write_text('{"a": 3}\n{"a": }\n5\n{broken\n')
    (tmp_path / "first.json").write_text('{broken\n{"a": 4}\n')
    (tmp_path / "element.json").write_text('[{"a": 5}, {"a": x}, {"a": 6}, 7]')
    good, bad = read(spark, tmp_path)
    assert [g[0] for g in good] == [3, 4, 5, 6]
    assert bad == sorted(['[{"a": 1}, {"a": 2', '[{"a": 1}, {"s": "open}', '{"a": }', "5", "{broken", "{broken", '{"a": x}', "7]"])


def test_corpus_over_many_lines(spark, tmp_path):
    record = T.StructType([T.StructField(n, T.StringType()) for n in ("source", "context_id", "context")])
    rows = [{"source": "web", "context_id": "c1", "context": "one }"}, {"source": " ", "context_id": None, "context": None}]
    (tmp_path / "a.json").write_text(json.dumps({"about": {"x": [1]}, "data": rows}, indent=4))
    (tmp_path / "b.json").write_text(json.dumps(rows[0]) + "\nbad line\n" + json.dumps({"data": rows}))
    good, bad = sources.read_corpus_records(spark, str(tmp_path), record)
    assert [r.value for r in bad.collect()] == ["bad line"]
    got = sorted((r.source, r.context_id.split(":")[0], r.context) for r in good.collect())
    assert got == sorted([("web", "c1", "one }")] * 3 + [("UNKNOWN", "UNKNOWN", None)] * 2, key=str)


def test_sealed_lines_are_parsed_once(spark):
    seen = spark.sparkContext.accumulator(0)

    @F.udf("string")
    def passed(line):
        seen.add(1)
        return line

    body = F.format_string('{"row":{"n":%d,"p":"a","t":%d},"schema_version":"v"}', "id", "id")
    lines = spark.range(40, numPartitions=2).select(F.concat(F.lit('{"record":'), body, F.lit(',"record_sha256":"'), F.sha2(body, 256), F.lit('"}')).alias("value"))
    before = spark.conf.get("spark.tidemark.rowsPerTask", None)
    spark.conf.set("spark.tidemark.rowsPerTask", "10")
    try:
        out = sources.verify_sealed_lines(lines.select(passed.asNondeterministic()("value").alias("value")), "v", T.StructType([T.StructField("n", T.LongType()), T.StructField("p", T.StringType()), T.StructField("t", T.LongType())]), "p", "n", "t")
        assert [(r.seal_status, r["count"]) for r in out.groupBy("seal_status").count().collect()] == [("OK", 40)]
    finally:
        spark.conf.set("spark.tidemark.rowsPerTask", before) if before else spark.conf.unset("spark.tidemark.rowsPerTask")
    assert seen.value == 40
