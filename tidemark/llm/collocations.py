"""Phrases that occur as one, mined with stripes: every prefix of words keys a counter of the words that follow it.

A task counts a bounded number of words at a time and makes one stripe per prefix: the following words with their counts.
Stripes are packed by blocks of prefixes; the rows of a block meet in one place and are merged element by element, one block
in memory at a time. There are as many blocks as the number of words asks for, so none grows with the data.
The merged stripes hold everything: the entry of word w under prefix P is the count of the phrase P w, the stripe of the empty
prefix holds the single words, the entry of P under its own prefix is the total of P, and the largest entries over a phrase's
extensions on either side say whether a longer phrase subsumes it.

Four passes over the texts fill the stripes of prefixes of 0, of 1, of 2 and of 3 to 4 words. A phrase is no more frequent than
its parts, so each pass leaves out the words, pairs or triples of the pass before that are surely below ``min_count``. What is
surely below is read from a :class:`Sketch` of fixed size, which also says into how many parts a stripe is split: the stripe of a
frequent prefix goes by the following word to one of several places, each with at most ``PART_OCCURRENCES`` occurrences of the
prefix. Chance hits in the sketch cost rows, never results.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema

from tidemark.llm.common import text_batches, written

LONGEST = 5
#: Words of the prefixes that each pass begins with; the last pass goes on up to ``LONGEST`` - 1.
LEVELS = (0, 1, 2, 3)
#: Words that a task counts before it sends its stripes.
FLUSH_WORDS = 6_000_000
#: Occurrences of a prefix per part of its stripe; parts of the stripe of the empty prefix.
PART_OCCURRENCES, EMPTY_PARTS = 1 << 16, 1024
#: Words of all texts per block, and the least number of blocks.
BLOCK_WORDS, LEAST_BLOCKS = 1 << 20, 256
#: Slots of a sketch, one byte each; a prime.
SKETCH_SLOTS = 8_388_593
#: Copies of a count that many phrases look up, and shares of a language when its best phrases are found.
SALTS = 16

_TABLE = bytes.maketrans(bytes(range(65, 91)) + b".,;:!?\n\x0b\x0c\r\t", bytes(range(97, 123)) + b"\n" * 10 + b" ")
#: Prefixes are joined by line feeds; how many words each has, the words and the counts by spaces.
PACKED = T.StructType([T.StructField(n, T.LongType() if n == "block" else T.StringType()) for n in ("block", "lang", "prefixes", "sizes", "words", "counts")])
ENTRY = T.StructType([T.StructField(n, t) for n, t in (("lang", T.StringType()), ("prefix", T.StringType()), ("word", T.StringType()), ("f", T.LongType()))])


@dataclass(frozen=True)
class Sketch:
    """One byte per slot for the phrases that hash to it: 0 if none is frequent, else 1 + log2 of the parts the largest asks for."""

    slots: np.ndarray

    @staticmethod
    def slot(*words: np.ndarray) -> np.ndarray:
        """Slots by the checksums of a phrase's words, the language's first."""
        out = np.zeros_like(words[0])
        for w in words:
            out = (out * 1_000_003 + w) % SKETCH_SLOTS
        return out

    @staticmethod
    def build(entries: DataFrame) -> Sketch:
        """From frequent phrases (lang, prefix, word, f); at most ``SKETCH_SLOTS`` pairs of small numbers reach the driver."""
        slot = F.lit(0).cast("long")
        phrase = F.split(F.ltrim(F.concat_ws(" ", "prefix", "word")), " ")
        slot = F.aggregate(F.concat(F.array("lang"), phrase), slot, lambda at, w: (at * 1_000_003 + F.crc32(w)) % SKETCH_SLOTS)
        code = 1 + F.greatest(F.lit(0), F.ceil(F.log2(F.col("f") / PART_OCCURRENCES))).cast("int")
        found = entries.groupBy(slot.cast("int").alias("slot")).agg(F.max(code).cast("byte").alias("code")).toArrow()
        slots = np.zeros(SKETCH_SLOTS, np.uint8)
        slots[found["slot"].to_numpy()] = found["code"].to_numpy()
        return Sketch(slots)


class _Numbers(dict):
    """Words to numbers by first use; 0 is the end of a piece and 1 the empty word."""

    def __missing__(self, word: bytes) -> int:
        self[word] = n = len(self)
        return n


class _Counting:
    """The words of some texts by language, and the stripes counted from them."""

    def __init__(self, level: int, sketch: Sketch | None, blocks: int):
        self.level, self.sketch, self.blocks = level, sketch, blocks
        self.clear()

    def clear(self) -> None:
        self.numbers = _Numbers({b"\n": 0, b"": 1})
        self.rows: dict[str, list[np.ndarray]] = {}
        self.held = 0

    def add(self, lang: str, text: str) -> None:
        words = text.encode().translate(_TABLE).replace(b"\n", b" \n ").split(b" ")
        ids = np.fromiter(map(self.numbers.__getitem__, words), np.int64, len(words))
        ids = ids[ids != 1]
        self.rows.setdefault(lang, []).append(np.append(ids, 0))
        self.held += len(ids) + 1

    def stripes(self) -> Iterator[pa.RecordBatch]:
        names = list(self.numbers)
        text = pa.array(names, pa.binary()).cast(pa.string())
        sums = np.fromiter((zlib.crc32(w) for w in names), np.int64, len(names))
        for lang, parts in self.rows.items():
            ids, tongue = np.concatenate(parts), np.full(1, zlib.crc32(lang.encode()), np.int64)
            make = [self._single, self._pairs, self._longer][min(self.level, 2)]
            for prefixes, owner, word, count, splits in make(ids, tongue, names, sums):
                if len(owner):
                    yield self._batch(lang, prefixes, owner, word, count, splits, text, sums)
        self.clear()

    def _single(self, ids, tongue, names, sums):
        count = np.bincount(ids, minlength=len(names))
        count[0] = 0
        count[1] = count.sum()  # the empty word stands for all words
        word = np.flatnonzero(count)
        yield [""], np.zeros(len(word), np.int64), word, count[word], np.full(1, EMPTY_PARTS, np.int64)

    def _pairs(self, ids, tongue, names, sums):
        code = self.sketch.slots[Sketch.slot(np.broadcast_to(tongue, sums.shape), sums)]
        code[0] = 0
        fine = code[ids] > 0
        at = np.flatnonzero(fine[:-1] & fine[1:])
        key, count = np.unique(ids[at] * len(names) + ids[at + 1], return_counts=True)
        prefix, word = np.divmod(key, len(names))
        used, owner = np.unique(prefix, return_inverse=True)
        yield [names[i].decode() for i in used], owner, word, count, np.left_shift(1, code[used].astype(np.int64) - 1)

    def _longer(self, ids, tongue, names, sums):
        """Prefixes of ``level`` words and, at the last level, of one more; all their parts of ``level`` words are known."""
        m, v = self.level, len(names)
        n = max(len(ids) - m + 1, 0)
        grams = [ids[k : k + n] for k in range(m)]
        at = np.flatnonzero(np.logical_and.reduce([g != 0 for g in grams]))
        code = np.zeros(n, np.uint8)
        code[at] = self.sketch.slots[Sketch.slot(np.broadcast_to(tongue, at.shape), *[sums[g[at]] for g in grams])]
        at = np.flatnonzero(code)
        # number of the phrase that starts at each of ``at``, and the log of the parts of its stripe by its rarest part
        phrase, limit = ids[at], code[at]
        for g in grams[1:]:
            phrase = np.unique(phrase, return_inverse=True)[1] * v + g[at]
        for length in range(m, LONGEST if m == LEVELS[-1] else m + 1):
            following = at + length - m + 1
            fits = following < n
            fits[fits] = code[following[fits]] > 0
            at, phrase, limit, following = at[fits], phrase[fits], limit[fits], following[fits]
            used, first, inverse = np.unique(phrase, return_index=True, return_inverse=True)
            prefixes = [b" ".join([names[ids[i + k]] for k in range(length)]).decode() for i in at[first]]
            splits = np.left_shift(1, limit[first].astype(np.int64) - 1)
            phrase = inverse * v + ids[at + length]
            key, count = np.unique(phrase, return_counts=True)
            owner, word = np.divmod(key, v)
            yield prefixes, owner, word, count, splits
            limit = np.minimum(limit, code[following])

    def _batch(self, lang, prefixes, owner, word, count, splits, text, sums) -> pa.RecordBatch:
        """Entries (owner: number of the prefix, word, count), packed by block and prefix."""
        hashes = np.fromiter((zlib.crc32(p.encode()) for p in prefixes), np.int64, len(prefixes))
        part = sums[word] & (splits[owner] - 1)
        block = (hashes[owner] + part * 2_654_435_761) % self.blocks
        order = np.lexsort((owner, block))
        owner, word, count, block = owner[order], word[order], count[order], block[order]
        new_block = np.append(True, np.diff(block) != 0)
        heads = np.flatnonzero(new_block | np.append(True, np.diff(owner) != 0))
        sizes = np.diff(np.append(heads, len(owner)))
        rows = np.flatnonzero(new_block)
        by_entry = pa.array(np.append(rows, len(owner)), pa.int32())
        by_prefix = pa.array(np.append(np.searchsorted(heads, rows), len(heads)), pa.int32())
        joined = lambda offsets, values, by: pc.binary_join(pa.ListArray.from_arrays(offsets, values), by)
        columns = [
            pa.array(block[rows]),
            pa.array([lang] * len(rows), pa.string()),
            joined(by_prefix, pa.array(prefixes, pa.string()).take(pa.array(owner[heads])), "\n"),
            joined(by_prefix, pa.array(sizes).cast(pa.string()), " "),
            joined(by_entry, text.take(pa.array(word)), " "),
            joined(by_entry, pa.array(count).cast(pa.string()), " "),
        ]
        return pa.RecordBatch.from_arrays(columns, names=PACKED.names)


def _stripes(docs: DataFrame, level: int, sketch: Sketch | None, blocks: int) -> DataFrame:
    """The stripes of each task, of prefixes of ``level`` words and, at the last level, more."""
    shared = docs.sparkSession.sparkContext.broadcast(sketch)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counting = _Counting(level, shared.value, blocks)
        for batch in batches:
            for lang, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                counting.add(lang, text)
                if counting.held >= FLUSH_WORDS:
                    yield from counting.stripes()
        yield from counting.stripes()

    return docs.mapInArrow(run, PACKED)


def _merge(batches: Iterator[pa.RecordBatch], min_count: int) -> Iterator[pa.RecordBatch]:
    """Stripes in order of their blocks, added up word by word; the last block of a batch waits for the next one."""
    schema = to_arrow_schema(ENTRY)
    keys = ["block", "lang", "prefix", "word"]
    waiting: pa.Table | None = None

    def done(rows: pa.Table) -> Iterator[pa.RecordBatch]:
        rows = rows.filter(pc.greater_equal(rows["f"], min_count)).select(schema.names).cast(schema)
        yield from rows.to_batches(max_chunksize=50_000)

    for batch in batches:
        if not batch.num_rows:
            continue
        column = lambda name: batch.column(batch.schema.get_field_index(name))
        prefixes = pc.split_pattern(column("prefixes"), "\n")
        row_of = pc.list_parent_indices(prefixes).to_numpy()
        sizes = pc.split_pattern(column("sizes"), " ").flatten().cast(pa.int64()).to_numpy()
        prefix_of = np.repeat(np.arange(len(sizes)), sizes)
        of = pa.array(row_of[prefix_of])
        words, counts = (pc.split_pattern(column(c), " ").flatten() for c in ("words", "counts"))
        rows = pa.table({"block": column("block").take(of), "lang": column("lang").take(of), "prefix": prefixes.flatten().take(pa.array(prefix_of)), "word": words, "f": counts.cast(pa.int64())})
        rows = pa.concat_tables([waiting, rows]) if waiting is not None else rows
        added = rows.group_by(keys).aggregate([("f", "sum")])
        rows = pa.table({c: added["f_sum" if c == "f" else c] for c in [*keys, "f"]})
        last = pc.equal(rows["block"], column("block")[batch.num_rows - 1])
        waiting = rows.filter(last)
        yield from done(rows.filter(pc.invert(last)))
    if waiting is not None:
        yield from done(waiting)


def _merged(stripes: DataFrame, label: str, min_count: int) -> DataFrame:
    dealt = stripes.repartition("block").sortWithinPartitions("block")
    return written(dealt.mapInArrow(lambda batches: _merge(batches, min_count), ENTRY), label)


def phrase_counts(docs: DataFrame, *, text: str = "text", lang: str = "lang", min_count: int = 100) -> tuple[DataFrame, DataFrame]:
    """Frequent phrases (lang, phrase, size, f) of 1 to 5 words, and the number of all words (lang, n), of whole texts.

    A language with fewer words than ``min_count`` has no rows.
    """
    text_batches(docs.sparkSession)
    rows = docs.select(F.coalesce(F.col(lang), F.lit("und")).alias("_l"), F.coalesce(F.col(text), F.lit("")).alias("_t"))
    single = _merged(_stripes(rows, 0, None, EMPTY_PARTS), "words", min_count)
    total, single = single.filter("word = ''"), single.filter("word <> ''")
    blocks = max(LEAST_BLOCKS, (total.agg(F.sum("f")).first()[0] or 0) // BLOCK_WORDS)
    pairs = _merged(_stripes(rows, 1, Sketch.build(single), blocks), "pairs", min_count)
    triples = _merged(_stripes(rows, 2, Sketch.build(pairs), blocks), "triples", min_count)
    longer = _merged(_stripes(rows, 3, Sketch.build(triples), blocks), "phrases", min_count)
    entries = single.unionByName(pairs).unionByName(triples).unionByName(longer)
    phrase = F.ltrim(F.concat_ws(" ", "prefix", "word"))
    counts = entries.select("lang", phrase.alias("phrase"), F.size(F.split(phrase, " ")).alias("size"), "f")
    return counts, total.select("lang", F.col("f").alias("n"))


def collocations(docs: DataFrame, *, text: str = "text", lang: str = "lang", min_count: int = 100, subsumed_percent: int = 100, top: int = 2000) -> DataFrame:
    """Each language's ``top`` phrases: lang, rank, phrase, a, l, r, n, score.

    A-Z are lower-cased, texts are cut at ``[.,;:!?\\x0A-\\x0D]`` and pieces into words ``[^\\x20\\x09]+``. The score of a phrase
    is the least over its cuts of floor(1000 a n / (l r)), ties to the earliest cut. A phrase gives way to any longer one
    that holds it and has ``subsumed_percent`` of its count. Null texts count as empty, a null language is ``und``; repeated
    rows count each time; no text at all gives no row. Other columns are not read.

    Only one-word extensions are compared: of all longer phrases around a phrase, one of these is the most frequent.
    """
    counts, words = phrase_counts(docs, text=text, lang=lang, min_count=min_count)
    found = counts.filter("size > 1").select("lang", "phrase", "size", F.col("f").alias("a"))
    inner = F.split("phrase", " ")
    parts = F.array(F.array_join(F.slice(inner, 1, F.col("size") - 1), " "), F.array_join(F.slice(inner, 2, F.col("size") - 1), " "))
    extended = found.filter("size > 2").select("lang", F.explode(parts).alias("phrase"), "a").groupBy("lang", "phrase").agg(F.max("a").alias("_longer"))
    found = found.join(extended, ["lang", "phrase"], "left").filter(f"_longer IS NULL OR 100 * _longer < {int(subsumed_percent)} * a").drop("_longer")

    # one row per cut; a count that many phrases share stands in SALTS copies
    salted = found.withColumn("_salt", F.pmod(F.xxhash64("phrase"), F.lit(SALTS)).cast("int"))
    cuts = salted.select("*", F.explode(F.sequence(F.lit(1), F.col("size") - 1)).alias("k")).withColumn("_w", F.split("phrase", " "))
    cuts = cuts.withColumn("_first", F.array_join(F.expr("slice(_w, 1, k)"), " ")).withColumn("_rest", F.array_join(F.expr("slice(_w, k + 1, size - k)"), " ")).drop("_w")
    copies = counts.select("lang", "phrase", "f", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))).alias("_salt"))
    copies = written(copies.repartition("lang", "phrase", "_salt"), "counts")
    for name, part in (("l", "_first"), ("r", "_rest")):
        cuts = cuts.join(copies.withColumnsRenamed({"phrase": part, "f": name}), ["lang", part, "_salt"])
    cuts = cuts.join(words, "lang")
    wide = lambda c, digits: F.col(c).cast(f"decimal({digits},0)")
    product = (wide("a", 16) * wide("n", 18)).cast("decimal(34,0)") * F.lit(1000).cast("decimal(4,0)")
    cuts = cuts.withColumn("_u", product).withColumn("_d", wide("l", 18) * wide("r", 18)).withColumn("score", F.expr("_u div _d"))
    cut = F.struct("score", "k", "l", "r")
    best = cuts.groupBy("lang", "phrase", "a", "n", "_salt").agg(F.min(cut).alias("c"))
    best = best.select("lang", "phrase", "a", "c.l", "c.r", "n", "c.score", "_salt")
    order = [F.col("score").desc(), F.col("a").desc(), F.col("phrase")]
    # first the best of each share of a language, then the best of those
    best = best.withColumn("_k", F.row_number().over(Window.partitionBy("lang", "_salt").orderBy(*order))).filter(F.col("_k") <= top)
    best = best.withColumn("rank", F.row_number().over(Window.partitionBy("lang").orderBy(*order)).cast("long")).filter(F.col("rank") <= top)
    return best.select("lang", "rank", "phrase", "a", "l", "r", "n", "score")
