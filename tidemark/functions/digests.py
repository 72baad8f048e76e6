"""Content hashes: canonical JSON of a row and digests of many rows that do not depend on their order."""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Sequence

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, BinaryType


def canonical_json(fields: dict[str, Column]) -> Column:
    """JSON with keys in name order; NULL fields are kept so that missing and absent differ."""
    return F.to_json(F.struct(*[fields[k].alias(k) for k in sorted(fields)]), {"ignoreNullFields": "false"})


def framed(*columns: Column) -> Column:
    """The values one after the other, each behind its length; ``~`` is NULL. Different rows give different texts."""
    texts = [c.cast("string") for c in columns]
    return F.concat(*[F.coalesce(F.concat(F.length(t).cast("string"), F.lit(":"), t), F.lit("~")) for t in texts])


def framed_sql(*expressions: str) -> str:
    text = lambda e: f"CAST({e} AS VARCHAR)"
    return "(" + " || ".join(f"coalesce(length({text(e)}) || ':' || {text(e)}, '~')" for e in expressions) + ")"


def row_hash(*columns: Column) -> Column:
    return F.sha2(framed(*columns), 256)


def row_hash_sql(*expressions: str) -> str:
    return f"sha256({framed_sql(*expressions)})"


# Where the 48-bit pieces of a SHA-256 start; each gives two lanes of 24 bits.
_PIECES = (1, 13, 25)
_LOW = (1 << 24) - 1


def digest_pieces(digest: Column) -> list[Column]:
    """The 48-bit pieces of a SHA-256 that :func:`multiset_digest` sums, as longs."""
    return [F.conv(F.substring(digest, at, 12), 16, 10).cast("long") for at in _PIECES]


def summed_pieces(pieces: Sequence[Column]) -> Column:
    """Aggregate: :func:`multiset_digest` of values whose :func:`digest_pieces` are given; NULL takes no part."""
    lanes = []
    for piece in pieces:
        lanes += [F.sum(piece.bitwiseAND(_LOW)).cast("string"), F.sum(F.shiftright(piece, 24)).cast("string")]
    return F.sha2(F.concat_ws("|", F.count(pieces[0]).cast("string"), *lanes), 256)


def multiset_digest(value: Column) -> Column:
    """Aggregate: a digest of all values that no order of rows can change.

    Six 24-bit lanes of each row's SHA-256 are summed as longs, so partial sums combine map-side and no group is
    collected; 2^39 rows of a group fit a lane. NULL values take no part.
    """
    return summed_pieces(digest_pieces(F.sha2(value.cast("string"), 256)))


def multiset_digest_sql(expression: str) -> str:
    piece = lambda at: f"CAST(('0x' || substr(sha256({expression}),{at},12)) AS BIGINT)"
    lanes = [f"CAST(sum({piece(at)} {cut}) AS VARCHAR)" for at in _PIECES for cut in (f"& {_LOW}", ">> 24")]
    return f"sha256(concat_ws('|', CAST(count(*) AS VARCHAR), {', '.join(lanes)}))"


#: Values of a sorted set that are hashed together; the set's digest is that of its blocks' digests, in order.
SET_BLOCK = 1_000


def block_digest(items: Column, text: Callable[[Column], Column]) -> Column:
    return F.sha2(F.array_join(F.transform(items, text), ""), 256)


def blocks_digest(digests: Column) -> Column:
    return F.sha2(F.array_join(digests, ""), 256)


def sorted_digest(items: Column, text: Callable[[Column], Column]) -> Column:
    """SHA-256 over the texts of a sorted array, by blocks; NULL where it is empty. ``text`` frames a value."""
    last = F.floor((F.size(items) - 1) / SET_BLOCK).cast("int")
    blocks = F.transform(F.sequence(F.lit(0), last), lambda i: block_digest(F.slice(items, i * SET_BLOCK + 1, F.lit(SET_BLOCK)), text))
    return F.when(F.size(items) > 0, blocks_digest(blocks))


def sorted_digest_sql(rows: str, key: str, order: str, text: str, count: str, digest: str) -> str:
    """Per ``key`` the number of ``rows`` (a query for distinct ones) and their :func:`sorted_digest`."""
    ranked = f"SELECT *, (row_number() OVER (PARTITION BY {key} ORDER BY {order}) - 1) // {SET_BLOCK} AS _b FROM ({rows})"
    blocks = f"SELECT {key}, _b, count(*) AS _c, sha256(string_agg({text}, '' ORDER BY {order})) AS _h FROM ({ranked}) GROUP BY ALL"
    return f"SELECT {key}, CAST(sum(_c) AS BIGINT) AS {count}, sha256(string_agg(_h, '' ORDER BY _b)) AS {digest} FROM ({blocks}) GROUP BY ALL"


@F.pandas_udf(ArrayType(BinaryType()))
def prefix_digests(blocks: pd.Series) -> pd.Series:
    """16 bytes for every leading run of blocks: one hash that goes on from block to block, each framed by its length."""

    def chain(row):
        running, out = hashlib.blake2b(digest_size=16), []
        for block in row:
            raw = b"~" if block is None else block.encode()
            running.update(b"~" if block is None else b"%d:%b" % (len(raw), raw))
            out.append(running.copy().digest())
        return out

    return blocks.map(lambda row: None if row is None else chain(row))


#: A prime below 2^31: squares of residues fit a long.
PRIME = 2_147_483_647


def draw_index(seed: int, n: Column, replicate: Column, slot: Column) -> Column:
    """A number in ``[0, n)`` from seed, replicate and slot: three quadratic steps modulo a prime, the same in any engine."""
    b, i = replicate.cast("long"), slot.cast("long")
    h = (b * 1_000_003 + i * 7_919 + seed) % PRIME
    h = (h * h + h * 12_345 + i) % PRIME
    h = (h * h + h * 67_891 + b) % PRIME
    return (h * h + h * 424_243 + seed) % PRIME % n


def draw_index_sql(seed: int, n: str, replicate: str, slot: str) -> str:
    h = f"(({replicate} * 1000003 + {slot} * 7919 + {seed}) % {PRIME})"
    for step in (f"h * h + h * 12345 + {slot}", f"h * h + h * 67891 + {replicate}", f"h * h + h * 424243 + {seed}"):
        h = f"(list_transform([CAST({h} AS BIGINT)], lambda h: ({step}) % {PRIME})[1])"
    return f"({h} % {n})"
