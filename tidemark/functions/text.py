"""String, role, time and key helpers, all column expressions but two Arrow functions."""

from __future__ import annotations

import unicodedata
from collections.abc import Iterable, Sequence

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, StringType

# Role spellings and what they stand for.
ROLE_ALIASES = {"HUMAN": "USER", "CUSTOMER": "USER", "AI": "ASSISTANT", "BOT": "ASSISTANT"}

# Attribute keys that never carry meaning (lower case).
VOLATILE_KEYS = (
    "uuid",
    "id",
    "database_id",
    "db_id",
    "element_id",
    "created_at",
    "updated_at",
    "embedding",
    "name_embedding",
    "fact_embedding",
)

# Keys that hold content and may not appear in evidence rows.
FORBIDDEN_KEYS = (
    "answer",
    "authorization",
    "body",
    "content",
    "cypher",
    "exception_message",
    "messages",
    "parameters",
    "params",
    "prompt",
    "question",
    "query",
    "raw_prompt",
    "raw_response",
    "reference",
    "system_prompt",
    "traceback",
    "user_prompt",
)

# Parts of a key name that mark it as content.
FORBIDDEN_KEY_PARTS = (
    "raw_prompt",
    "user_prompt",
    "system_prompt",
    "prompt_text",
    "prompt_content",
    "raw_response",
    "response_text",
    "answer_text",
    "question_text",
)


def collapse_whitespace(c: Column) -> Column:
    return F.trim(F.regexp_replace(c, r"\s+", " "))


def normalize_role(*candidates: Column) -> Column:
    """Upper-case role from the first candidate that is set; blank means USER, unknown roles stay."""
    role = F.upper(F.trim(F.coalesce(*[F.when(c != "", c) for c in candidates], F.lit(""))))
    out = F.when(role == "", "USER")
    for alias, name in ROLE_ALIASES.items():
        out = out.when(role == alias, name)
    return out.otherwise(role)


def coalesce_content(*candidates: Column, whole: Column) -> Column:
    """First candidate that is set, else the JSON of the whole message."""
    return F.coalesce(*candidates, F.to_json(whole))


@F.pandas_udf(StringType())
def _nfkc_casefold(text: pd.Series) -> pd.Series:
    return text.map(lambda t: None if t is None else unicodedata.normalize("NFKC", t).casefold())


def normalize_display(c: Column) -> Column:
    """NFKC and case folding (no built-in does either), then dash, multiply sign and blanks on the JVM."""
    folded = _nfkc_casefold(F.coalesce(c.cast("string"), F.lit("")))
    return F.trim(F.regexp_replace(F.translate(folded, "×–", "x-"), r"(?U)\s+", " "))


@F.pandas_udf(ArrayType(StringType()))
def numbered(tokens: pd.Series) -> pd.Series:
    """Tokens made distinct by their number of occurrence, so multisets meet as sets. Tokens hold no blank."""

    def mark(row):
        seen, out = {}, []
        for t in row:
            n = seen[t] = seen.get(t, 0) + 1
            out.append(t if n == 1 else f"{t} {n}")
        return out

    return tokens.map(lambda row: None if row is None else mark(row))


def glob_to_regex(pattern: str) -> str:
    """Anchored regular expression for a shell pattern with ``*`` and ``?``."""
    out = []
    for ch in pattern:
        out.append(".*" if ch == "*" else "." if ch == "?" else "\\" + ch if not ch.isalnum() and ch != "_" else ch)
    return "(?s)^" + "".join(out) + "$"


def event_time_us(c: Column) -> Column:
    """Epoch microseconds of ISO times (``Z`` or no zone, read as UTC) and of ``YYYY/MM/DD (Day) HH:MM``; NULL otherwise."""
    bare = F.regexp_replace(c, r" \([A-Za-z]+\)", "")
    formats = ["yyyy-MM-dd'T'HH:mm:ss.SSSSSSX", "yyyy-MM-dd'T'HH:mm:ssX", "yyyy-MM-dd'T'HH:mm:ss.SSSSSS", "yyyy-MM-dd'T'HH:mm:ss"]
    parsed = [F.try_to_timestamp(c, F.lit(f)) for f in formats]
    return F.unix_micros(F.coalesce(*parsed, F.try_to_timestamp(bare, F.lit("yyyy/MM/dd HH:mm"))))


def clean_attributes(attributes: Column, volatile: Sequence[str] = VOLATILE_KEYS) -> Column:
    """Map without volatile keys and ``*_uuid``, blanks collapsed, entries in key order as an array of structs."""
    kept = F.map_filter(attributes, lambda k, v: ~F.lower(k).isin(*volatile) & ~F.endswith(F.lower(k), F.lit("_uuid")))
    return F.array_sort(F.map_entries(F.transform_values(kept, lambda k, v: collapse_whitespace(v))))


def json_keys(doc: Column) -> Column:
    """Every object key of a JSON text at any depth.

    All quoted strings are matched from left to right, so matches never start inside one; those before a colon are keys.
    """
    quoted = F.regexp_extract_all(doc, F.lit(r'"(?:[^"\\]|\\.)*"(?:\s*:)?'), F.lit(0))
    return F.transform(F.filter(quoted, lambda s: F.endswith(s, F.lit(":"))), lambda s: F.regexp_extract(s, r'^"(.*)"\s*:$', 1))


def is_forbidden_key(key: Column, keys: Iterable[str] = FORBIDDEN_KEYS, parts: Iterable[str] = FORBIDDEN_KEY_PARTS) -> Column:
    name = F.lower(key)
    out = name.isin(*keys)
    for part in parts:
        out = out | F.contains(name, F.lit(part))
    return out


def flatten_answers(nested: Column) -> Column:
    """Trimmed, non-blank, distinct answers of a list of lists, in order of first appearance."""
    flat = F.transform(F.flatten(nested), lambda a: F.trim(a))
    return F.array_distinct(F.filter(flat, lambda a: a.isNotNull() & (a != "")))
