"""A corpus in four stages: reject toxic documents, keep one of each group of near copies, mix the sources, encode.

Every stage takes ``(spark, docs, sf_dir)``; :func:`run` writes what a stage returns as Parquet and reads it back as the next
stage's ``docs``. All stages but the last return the columns of ``documents``.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.llm import bpe, mixing, simhash, toxicity
from tidemark.llm.common import table, written
from tidemark.session import prepare

#: Documents scored this high are rejected.
REJECT_FROM = 0.5


def reject_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drop documents with a toxicity score of ``REJECT_FROM`` or more; all others stay, null texts too."""
    prepare(spark)
    grammar = toxicity.learn(docs, table(spark, sf_dir, "labels"))
    return toxicity.score(docs, grammar, out="_toxicity").filter(F.col("_toxicity") < REJECT_FROM).select(*docs.columns)


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keep one row of each component: a row with its smallest id; a row without an id is no copy of another and stays.

    An id may stand on several rows. Those in a component with a smaller id are copies of its documents and go; of those in a
    component of which the id is the smallest one stays, the first by text and then by the other columns.
    """
    prepare(spark)
    classes = written(simhash.near_duplicates(docs), "classes")
    own = F.col("doc_id") == F.col("component_id")
    kept = classes.filter("doc_id IS NOT NULL").groupBy("doc_id").agg(F.count(F.lit(1)).alias("_rows"), F.bool_or(own).alias("_kept")).filter("_kept")
    kept = written(kept.select("doc_id", "_rows"), "kept")
    once = docs.join(kept.filter("_rows = 1"), "doc_id", "left_semi").select(*docs.columns)
    out = once.unionByName(docs.filter("doc_id IS NULL"))
    many = written(kept.filter("_rows > 1").select("doc_id"), "many")
    if many.isEmpty():
        return out
    rows = simhash.fingerprints(docs.join(many, "doc_id", "left_semi").select(*docs.columns), text="text")
    rows = rows.join(classes.filter(own).select("doc_id", "fp", "label").distinct(), ["doc_id", "fp"])
    order = ["text", *[c for c in docs.columns if c not in ("doc_id", "text")]]
    first = rows.groupBy("doc_id", "label").agg(F.min(F.struct(*order)).alias("_first")).select("doc_id", "_first.*")
    return out.unionByName(first.select(*docs.columns))


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Each document as often as the mix takes it, rounded to whole documents; documents without words stay once."""
    prepare(spark)
    taken = mixing.mix(docs).select("doc_id", F.when(F.col("size") > 0, F.round(F.col("taken") / F.col("size"))).otherwise(1).cast("int").alias("_times"))
    # rows without an id cannot be told apart, so they are matched by nothing and stay once
    named = docs.join(taken.filter("doc_id IS NOT NULL").groupBy("doc_id").agg(F.max("_times").alias("_times")), "doc_id", "left")
    return named.withColumn("_copy", F.explode(F.expr("IF(coalesce(_times, 1) > 0, sequence(1, coalesce(_times, 1)), array())"))).select(*docs.columns)


def encode(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token counts and digests of every document, as often as the mix has it."""
    import public_tokenizers

    prepare(spark)
    return bpe.round_trip_digests(docs, public_tokenizers.path("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN, keep=["doc_id"])


STAGES = [("toxicity", reject_toxic), ("simhash_near_dedup", drop_near_copies), ("source_mix", mix_sources), ("byte_bpe", encode)]

#: Votes over shingle hashes, reachability over links and merges by rank have no SQL form; tests hold the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(prepare(spark), sf_dir, "documents")
    for name, stage in STAGES:
        docs = written(stage(spark, docs, sf_dir), name)
    return docs
