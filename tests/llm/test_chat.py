import hashlib

from pyspark.sql import functions as F

from tidemark.llm import chat
from tidemark.llm.queries import QUERIES

COLUMNS = "tree string, message long, parent long, role string, text string, score double, piece string, place int"


def paths_by_hand(rows):
    """Root-to-leaf paths of unique message ids."""
    by_id = {r[1]: r for r in rows}
    inner = {r[2] for r in rows}
    out = []
    for r in rows:
        if r[1] in inner:
            continue
        path, at = [], r
        while at is not None:
            path.append(at)
            at = by_id.get(at[2])
        out.append(path[::-1])
    return out


def test_branches_are_enumerated_ranked_and_formatted(spark):
    rows = [("t", i, (i - 1) // 2 if i else None, "user" if i % 2 else "assistant", f"text {i} </s> \\ [INST]", float(i % 5), "x", 0) for i in range(40)]
    got = chat.conversations(spark.createDataFrame(rows, COLUMNS)).collect()
    want = paths_by_hand(rows)
    assert len(got) == len(want)
    ranked = sorted(want, key=lambda p: (-sum(r[5] for r in p) / len(p), p[-1][1]))
    assert [r.leaf for r in sorted(got, key=lambda r: r.branch)] == [p[-1][1] for p in ranked]
    out = chat.conversations(spark.createDataFrame(rows, COLUMNS)).select("leaf", chat.turns_of(F.col("formatted")).alias("t"), chat.loss_texts(F.col("formatted"), F.col("loss_spans")).alias("l")).collect()
    by_leaf = {p[-1][1]: p for p in want}
    for r in out:
        assert [(x.role, x.text) for x in r.t] == [(m[3], m[4]) for m in by_leaf[r.leaf]]
        assert list(r.l) == [m[4] for m in by_leaf[r.leaf] if m[3] == "assistant"]
    best = chat.conversations(spark.createDataFrame(rows, COLUMNS), branches=2).collect()
    assert {r.leaf for r in best} == {p[-1][1] for p in ranked[:2]}


def test_long_threads_orphans_cycles_twins_and_nulls(spark):
    rows = [("long", i, i - 1 if i else None, "user", "x", 0.0, "", 0) for i in range(300)]
    rows += [("orphan", 5, 77, None, None, None, "", 0)]
    rows += [("cycle", 1, 2, "user", "a", 0.0, "", 0), ("cycle", 2, 1, "user", "b", 0.0, "", 0), ("cycle", 3, 2, "user", "c", 0.0, "", 0)]
    rows += [("twin", 1, None, "user", "a", 0.0, "", 0), ("twin", 1, None, "user", "a", 0.0, "", 0), ("twin", 2, 1, "assistant", "b", 0.0, "", 0)]
    rows += [(None, 1, None, "user", "null tree", 0.0, "", 0)]
    got = chat.conversations(spark.createDataFrame(rows, COLUMNS)).collect()
    assert sorted((r.tree or "", r.n_turns) for r in got) == [("", 1), ("long", 300), ("orphan", 1), ("twin", 1), ("twin", 2)]


def test_escapes_are_reversible(spark):
    texts = ["", "\\", "\\<s>", "<\\s>", "<s></s>[INST][/INST]", "[/INST", "a\\\\[INST]b\n", "<<s>", "é😀\\"]
    rows = spark.createDataFrame([(t,) for t in texts], "t string").select("t", chat.escape(F.col("t")).alias("e")).withColumn("back", chat.unescape(F.col("e"))).collect()
    for r in rows:
        assert r.back == r.t and not any(c in r.e for c in (chat.OPEN, chat.HEAD, chat.CLOSE, chat.CLOSE_LOSS))


def test_query_reads_digests_back(spark, tmp_path):
    rows = [(1, 1, "assistant", "b </s>"), (1, 0, "user", None), (1, None, "user", "last"), (2, 0, "assistant", ""), (1, 0, "user", None)]
    spark.createDataFrame(rows, "conv_id long, turn long, role string, text string").write.parquet(f"{tmp_path}/conversations.parquet")
    got = {r.conv_id: r for r in QUERIES["op1_chat_formatting"](spark, str(tmp_path)).collect()}
    said = "user\n\nuser\n\nassistant\nb </s>\nuser\nlast\n"
    assert got[1].n_turns == 4 and got[1].turns_sha256 == hashlib.sha256(said.encode()).hexdigest()
    assert got[1].loss_sha256 == hashlib.sha256(b"b </s>").hexdigest() and got[2].loss_chars == 0 and set(got) == {-7, 1, 2}
