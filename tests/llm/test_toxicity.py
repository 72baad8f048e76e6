import math
import zlib

from tidemark.llm import toxicity as X
from tidemark.llm.queries import QUERIES

G = X.Grammar({"moron": 1.0, "idiot": 1.0}, {"vequ": 1.0}, -2.0, (2.5, 0.5, 0.3, 0.3, 2.5))


def classes(text):
    return dict(zip(X.CLASSES, X.document_classes(text, G, G.scanner())))


def test_the_machine_tells_clauses_apart():
    assert classes("Nothing to see here.") == dict.fromkeys(X.CLASSES, 0.0)
    assert classes("You are an IDIOT.")["asserted"] > 0 and classes("You are an idiot.")["aimed"] > 0
    assert classes("This is not an idiot.")["asserted"] == 0 < classes("This is not an idiot.")["negated"]
    assert classes("He said moron.")["reported"] > 0 == classes("He said moron.")["asserted"]
    assert classes('"idiot"')["reported"] > 0
    assert classes("I will kill you.")["threat"] > 0 == classes("They kill time.")["threat"]
    assert classes("Not here. An idiot.")["asserted"] > 0
    assert classes("vequille x")["asserted"] > 0 == classes("vequ")["asserted"] and classes("idiotic")["asserted"] == 0


def test_clauses_in_a_row_stand_alone():
    cut = lambda t: list(X.clauses(t, G.scanner()))
    assert cut("he said idiot. you moron. so. idiot; moron") == ["he said idiot.", " you moron.", " idiot;", " moron"]
    one, two, three = classes("An idiot."), classes("An idiot. A moron."), classes("An idiot. A moron! An idiot.")
    assert [round(math.expm1(c["asserted"]), 6) for c in (one, two, three)] == [1, 2, 3]
    reported = classes("He said idiot. You moron.")
    assert reported["reported"] == reported["asserted"] == reported["aimed"] == math.log1p(1)
    denied = classes("An idiot. Not a moron. An idiot.")
    assert denied["negated"] == math.log1p(1) and denied["asserted"] == math.log1p(2)
    assert classes("I will see an idiot. Kill you.")["threat"] == 0


def test_many_clauses_are_walked_once():
    text = "you idiot. " * 20_000
    assert sum(map(len, X.clauses(text, G.scanner()))) == len(text) - 1


def test_rank_of_clauses():
    p = lambda t: X.probability(X.document_classes(t, G, G.scanner()), G)
    assert p("You idiot.") > p("An idiot.") > 0.4 > p("Not an idiot.") and p("") < 0.2


def test_held_out_accuracy_and_contract(spark):
    sf = "/root/testdata/sf0.1"
    got = {r.doc_id: r for r in QUERIES["op9_toxicity"](spark, sf).collect()}
    assert len(got) == 10_000 and all(r.held_out == (zlib.crc32(str(i).encode()) % 5 == 0) and 0 <= r.score <= 1 and r.predicted == (r.score >= 0.5) for i, r in got.items())
    labels = {r.doc_id: r.toxic for r in spark.read.parquet(f"{sf}/labels.parquet").collect()}
    held = [(labels[i], r.predicted) for i, r in got.items() if r.held_out and i in labels]
    hit = sum(p for t, p in held if t) / max(1, sum(t for t, _ in held))
    assert sum(t == p for t, p in held) / len(held) > 0.95 and hit > 0.6 and sum(p for t, p in held if not t) <= 0.01 * len(held)


def test_without_labels_the_seed_words_decide(spark):
    docs = spark.createDataFrame([(1, "you idiot", 9.0), (2, None, 9.0), (2, None, 9.0), (None, "", 9.0)], "doc_id long, text string, score double")
    labels = spark.createDataFrame([(1, None), (None, 1)], "doc_id long, toxic int")
    got = sorted((r.doc_id or 0, r.score >= 0.5) for r in X.score(docs, X.learn(docs, labels)).collect())
    assert [g[0] for g in got] == [0, 1, 2, 2] and not got[0][1] and not got[2][1]
