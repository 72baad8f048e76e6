from collections import Counter

import corpus_pipeline as P
from tidemark.llm import mixing, toxicity
from tidemark.llm.simhash import fingerprint

SF = "/root/testdata/sf0.001"


def test_stages_on_their_own_input(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    clean = P.reject_toxic(spark, docs, SF).cache()
    assert clean.columns == docs.columns
    grammar = toxicity.learn(docs, spark.read.parquet(f"{SF}/labels.parquet"))
    scanner = grammar.scanner()
    bad = {r.doc_id for r in docs.collect() if toxicity.probability(toxicity.document_classes(r.text or "", grammar, scanner), grammar) >= P.REJECT_FROM}
    assert {r.doc_id for r in clean.collect()} == {r.doc_id for r in docs.collect()} - bad and bad

    single = P.drop_near_copies(spark, clean, SF).cache()
    fps = {r.doc_id: fingerprint(r.text) for r in clean.collect()}
    root = {i: i for i in fps}
    for _ in fps:
        before = dict(root)
        for a in fps:
            for b in fps:
                if root[b] < root[a] and (fps[a] ^ fps[b]).bit_count() <= 4:
                    root[a] = root[b]
        if before == root:
            break
    assert sorted(r.doc_id for r in single.collect()) == sorted(i for i in root if root[i] == i)

    mixed = P.mix_sources(spark, single, SF).cache()
    taken = {r.doc_id: r for r in mixing.mix(single).collect()}
    want = {i: int(r.taken / r.size + 0.5) if r.size else 1 for i, r in taken.items()}
    assert Counter(r.doc_id for r in mixed.collect()) == Counter({i: n for i, n in want.items() if n}) and mixed.columns == docs.columns
    assert P.encode(spark, mixed, SF).count() == mixed.count()


def test_run_with_odd_rows(spark, tmp_path):
    rows = [(None, None, None, None, None), (None, "", "en", "a", 0), (1, None, "en", None, 0), (1, None, "en", None, 0), (2, "word " * 50_000, "de", "a", 1), (3, "you idiot, you moron, you scum and trash", "en", "b", 1), (4, "plain little text of some words", "en", "b", 1)]
    spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long").write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([(None, None, None)], "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    got = P.run(spark, str(tmp_path)).collect()
    assert 4 in {r.doc_id for r in got} and 3 not in {r.doc_id for r in got}


def test_one_row_of_each_group_of_near_copies(spark):
    long = " ".join(f"word{i}" for i in range(200))
    rows = [
        (1, long, "en", "a", 1), (1, long, "en", "a", 1), (1, long + " more", "de", "b", 2),  # one id on copies: one row stays
        (2, long, "en", "c", 1), (2, "a text of its own on two rows of an id", "en", "c", 3), (2, "a text of its own on two rows of an id", "en", "c", 3),
        (3, "yet another text that nothing else is like", "en", "a", 4), (None, long, "en", "a", 1), (None, None, "en", "a", 0),
        (5, "first of two texts that have nothing in common but their id", "en", "a", 5), (5, "quite other words stand here on the second row", "en", "a", 5),
    ]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")
    got = P.drop_near_copies(spark, docs, SF)
    key = lambda r: (r[0] or 0, r[1] or "", r[2])
    assert sorted(map(tuple, got.collect()), key=key) == sorted([rows[0], rows[4], rows[6], rows[7], rows[8], rows[9], rows[10]], key=key) and got.columns == docs.columns
