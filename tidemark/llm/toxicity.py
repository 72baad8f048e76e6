"""Toxicity by a weighted pattern grammar over clauses.

Four small transducers read the tokens of a clause and are composed into one machine. *Insults* marks words of a lexicon (whole
words or stems) with their weight. *Targets* marks who is spoken to or about. *Threats* goes from an announcement ("will",
"going to") over a verb of harm to a target. *Negation* opens a scope of a few tokens; *reported speech* opens one up to the end
of the clause. The composition is a walk with one state tuple: scopes left, announcement left, target seen. It puts every match
into one of the classes asserted, negated, reported and threat, each with its weight; words are not scored on their own. The
classes of a document are turned into a probability by a logistic model.

What is learned. The lexicon: units (``word`` or ``stem*``) whose share of toxic documents has a high lower confidence bound,
taken greedily by the toxic documents that no earlier unit explains. The model: logistic regression on the classes. Both are
fitted on a sample of at most ``max_toxic`` toxic and ``max_clean`` other labelled documents, the ones with the smallest
digests, near copies counted once. ``lang``, ``source``, ids and labels are never read when scoring.

Null texts count as empty; a text without matches gets the score of the model's bias. Texts are read whole. Repeated rows get
equal scores. Without labels of both kinds the seed words alone decide.
"""

from __future__ import annotations

import math
import re
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tidemark.llm.common import map_column, text_batches, written

MAX_TOXIC = 3_000
MAX_CLEAN = 12_000
FOLDS = 5
#: Units kept: lower bound of the toxic share, toxic documents with it, newly explained documents, units in all.
MIN_SHARE, MIN_DOCS, MIN_NEW, MAX_UNITS = 0.5, 3, 2, 400
STEMS = (4, 5, 6)
Z = 2.0

#: Seed grammar: plain word lists in the languages of the corpus.
SEED_INSULTS = "idiot moron stupid scum loser worthless pathetic disgusting trash clown imbecile vermin filth".split()
TARGETS = set("you your yours u he she him her his they them their this those these du dich dir dein euch ihr sie tu te toi vous ton ta vos ils elles usted tú ti ustedes ellos ellas".split())
NEGATIONS = set("not no never none nobody isn't aren't wasn't don't doesn't won't cannot nicht kein keine nie niemals ne pas jamais aucun nunca jamás ningún".split())
REPORTS = set("said says say called calls wrote writes told reported claimed quoted quote alleged according sagte nannte schrieb dit appelé écrit dijo llamó escribió".split())
ANNOUNCE = set("will shall gonna going i'll we'll must should werde werden vais allons voy vamos".split())
HARM = set("kill hurt destroy beat burn shoot stab murder crush hang attack töten schlagen tuer frapper matar golpear".split())
NEGATION_SCOPE, ANNOUNCE_SCOPE = 3, 4

TOKEN = re.compile(r"[^\W_]+(?:'[^\W_]+)?|[.!?;:\n\"“”«»]")
WORD = re.compile(r"[^\W_]+(?:'[^\W_]+)?")
CLAUSE_END = re.compile(r"[.!?;\n]")
QUOTES = set("\"“”«»")
CLASSES = ("asserted", "aimed", "negated", "reported", "threat")


@dataclass(frozen=True)
class Grammar:
    """Weights of the insult transducer (words, stems) and of the logistic model over the classes."""

    words: dict[str, float]
    stems: dict[str, float] = field(default_factory=dict)
    bias: float = -2.0
    class_weights: tuple[float, ...] = (2.5, 0.5, 0.3, 0.3, 2.5)

    def scanner(self) -> re.Pattern:
        """One pattern that finds the clauses worth walking: any insult or verb of harm."""
        whole = sorted({*self.words, *HARM}, key=len, reverse=True)
        stems = sorted(self.stems, key=len, reverse=True)
        parts = [rf"(?:{'|'.join(map(re.escape, whole))})\b"] + ([rf"(?:{'|'.join(map(re.escape, stems))})"] if stems else [])
        return re.compile(rf"\b(?:{'|'.join(parts)})")

    def insult(self, word: str) -> float:
        found = self.words.get(word, 0.0)
        if not found:
            for size in STEMS:
                found = max(found, self.stems.get(word[:size], 0.0) if len(word) > size else 0.0)
        return found


def walk(tokens: Iterator[str], grammar: Grammar) -> dict[str, float]:
    """The composed machine over the tokens of one clause: total weight by class."""
    out = dict.fromkeys(CLASSES, 0.0)
    denied = announced = 0
    harm = reported = aimed = False
    insults = 0.0
    for token in tokens:
        if token in QUOTES:
            reported = not reported
            continue
        if token in REPORTS:
            reported = True
        if token in NEGATIONS:
            denied = NEGATION_SCOPE + 1
        if token in ANNOUNCE:
            announced = ANNOUNCE_SCOPE + 1
        if token in HARM and announced and not denied:
            harm = True
        if token in TARGETS:
            aimed = True
            if harm:
                out["reported" if reported else "threat"] += 1.0
                harm = False
        weight = grammar.insult(token)
        if weight:
            kind = "negated" if denied else "reported" if reported else "asserted"
            out[kind] += weight
            insults += weight if kind == "asserted" else 0.0
        denied, announced = max(0, denied - 1), max(0, announced - 1)
    if aimed and insults:
        out["aimed"] += insults
    return out


def clauses(text: str, scanner: re.Pattern) -> Iterator[str]:
    """The clauses of a lower-cased text in which the scanner finds something; each part of the text is in one clause at most."""
    done = 0
    for hit in scanner.finditer(text):
        if hit.start() < done:
            continue
        # the clause starts behind the last end before the hit, or where the clause before it ended
        start = done
        for end in CLAUSE_END.finditer(text, done, hit.start()):
            start = end.end()
        end = CLAUSE_END.search(text, hit.start())
        done = end.end() if end else len(text)
        yield text[start:done]


def document_classes(text: str, grammar: Grammar, scanner: re.Pattern) -> list[float]:
    """Damped totals per class over the whole text."""
    total = dict.fromkeys(CLASSES, 0.0)
    for clause in clauses(text.lower(), scanner):
        for kind, weight in walk(TOKEN.findall(clause), grammar).items():
            total[kind] += weight
    return [math.log1p(total[k]) for k in CLASSES]


def probability(classes: list[float], grammar: Grammar) -> float:
    z = grammar.bias + sum(w * x for w, x in zip(grammar.class_weights, classes))
    return 1.0 / (1.0 + math.exp(-max(-30.0, min(30.0, z))))


def units_of(text: str) -> set[str]:
    """Words and word stems of a text."""
    found = set()
    for word in set(WORD.findall(text.lower())):
        found.add(word)
        found.update(word[:k] + "*" for k in STEMS if len(word) > k)
    return found


def sketch(text: str) -> int:
    """Near copies mostly share it: the smallest digest of the word pairs."""
    from xxhash import xxh64_intdigest

    words = text.lower().split()
    pairs = {f"{a} {b}" for a, b in zip(words, words[1:])} or {" ".join(words)}
    return min(xxh64_intdigest(p.encode()) for p in pairs) >> 1


def sample(docs: DataFrame, labels: DataFrame, *, max_toxic: int, max_clean: int) -> DataFrame:
    """At most so many rows ``(doc_id, text, toxic)`` of each kind, by digest of the id, one per sketch.

    The picked ids number ``max_toxic + max_clean`` at most, so they may be sent to every task and no text is shuffled.
    """
    rows = labels.select("doc_id", (F.col("toxic") == 1).alias("toxic")).filter("toxic IS NOT NULL AND doc_id IS NOT NULL").distinct()
    order = F.xxhash64("doc_id")
    picked = [rows.filter(F.col("toxic") == kind).select("doc_id", "toxic", order.alias("_o")).orderBy("_o", "doc_id").limit(n) for kind, n in ((True, max_toxic), (False, max_clean))]
    keys = picked[0].unionByName(picked[1]).select("doc_id", "toxic")
    texts = docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text")).join(F.broadcast(keys), "doc_id")
    made = map_column(texts, "text", [T.StructField("sketch", T.LongType())], lambda: lambda batch: {"sketch": [sketch(t) for t in batch]})
    made = written(made, "toxic-sample")
    first = made.groupBy("toxic", "sketch").agg(F.min("doc_id").alias("doc_id"))
    return made.join(first, ["toxic", "sketch", "doc_id"]).select("doc_id", "text", "toxic")


def _wilson_low(k: float, n: float) -> float:
    p = k / n
    return (p + Z * Z / 2 / n - Z * math.sqrt(p * (1 - p) / n + Z * Z / 4 / n / n)) / (1 + Z * Z / n)


def _units(rows: DataFrame) -> DataFrame:
    """``(unit, pos, neg)``: documents of each kind with the unit; each task sends one row per unit."""

    def count(batches):
        seen: tuple[Counter, Counter] = (Counter(), Counter())
        for batch in batches:
            for text, toxic in zip(batch.column("text").to_pylist(), batch.column("toxic").to_pylist()):
                seen[bool(toxic)].update(units_of(text))
        units = list(seen[0] | seen[1])
        yield pa.RecordBatch.from_pydict({"unit": units, "pos": [seen[1][u] for u in units], "neg": [seen[0][u] for u in units]}, schema=pa.schema([("unit", pa.string()), ("pos", pa.int64()), ("neg", pa.int64())]))

    text_batches(rows.sparkSession)
    return rows.select("text", "toxic").mapInArrow(count, "unit string, pos long, neg long").groupBy("unit").agg(F.sum("pos").alias("pos"), F.sum("neg").alias("neg"))


def choose_units(candidates: dict[str, tuple[int, int]], toxic: list[set[str]]) -> dict[str, float]:
    """Greedy cover of the toxic documents: strongest unit first, until too few documents are newly explained."""
    share = {u: _wilson_low(p, p + n) for u, (p, n) in candidates.items()}
    left = [d & share.keys() for d in toxic]
    chosen: dict[str, float] = {}
    need = max(MIN_NEW, len(toxic) // 200)
    while len(chosen) < MAX_UNITS:
        fresh = Counter(u for d in left for u in d)
        best = max(fresh, key=lambda u: (fresh[u] * share[u], not u.endswith("*"), len(u), u), default=None)
        if best is None or fresh[best] < need:
            break
        chosen[best] = share[best]
        left = [d for d in left if best not in d]
    return chosen


def logistic(x: np.ndarray, y: np.ndarray, start: np.ndarray, ridge: float = 0.05, steps: int = 60) -> np.ndarray:
    """Newton steps for a logistic model drawn towards ``start``; the last weight is the bias."""
    x = np.column_stack([x, np.ones(len(x))])
    w = start.copy()
    pull = np.full(len(w), ridge)
    for _ in range(steps):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        slope = x.T @ (p - y) + pull * (w - start)
        curve = (x * (p * (1 - p))[:, None]).T @ x + np.diag(pull)
        move = np.linalg.solve(curve, slope)
        w -= move
        if np.abs(move).max() < 1e-7:
            break
    return w


def fit(docs: DataFrame, labels: DataFrame, *, max_toxic: int = MAX_TOXIC, max_clean: int = MAX_CLEAN) -> Grammar:
    """The grammar for ``labels`` (doc_id, toxic). Only counts of units and classes of the bounded sample reach the driver."""
    rows = written(sample(docs, labels, max_toxic=max_toxic, max_clean=max_clean), "toxic-sample")
    counted = _units(rows).filter(F.col("pos") >= MIN_DOCS).filter(F.col("pos") * 4 >= F.col("neg")).collect()
    candidates = {r["unit"]: (r["pos"], r["neg"]) for r in counted if _wilson_low(r["pos"], r["pos"] + r["neg"]) >= MIN_SHARE}
    known = set(candidates)
    field_ = [T.StructField("found", T.ArrayType(T.StringType()))]
    hits = map_column(rows.filter("toxic"), "text", field_, lambda: lambda batch: {"found": [sorted(units_of(t) & known) for t in batch]}, keep=["doc_id"])
    chosen = choose_units(candidates, [set(r["found"]) for r in hits.select("found").collect()])
    words = dict.fromkeys(SEED_INSULTS, 0.5) | {u: w for u, w in chosen.items() if not u.endswith("*")}
    stems = {u[:-1]: w for u, w in chosen.items() if u.endswith("*")}
    grammar = Grammar(words, stems)

    def make():
        scanner = grammar.scanner()
        return lambda batch: {"classes": [document_classes(t, grammar, scanner) for t in batch]}

    measured = map_column(rows, "text", [T.StructField("classes", T.ArrayType(T.DoubleType()))], make, keep=["toxic"]).collect()
    if not measured:
        return grammar
    x = np.array([r["classes"] for r in measured], float)
    y = np.array([r["toxic"] for r in measured], float)
    if y.min() == y.max():
        return grammar
    w = logistic(x, y, np.array([*grammar.class_weights, grammar.bias]))
    return Grammar(words, stems, float(w[-1]), tuple(map(float, w[:-1])))


def held_out(doc_id: str = "doc_id"):
    """The fold that is never learned from."""
    return F.crc32(F.col(doc_id).cast("string").cast("binary")) % FOLDS == 0


def learn(docs: DataFrame, labels: DataFrame, **limits: int) -> Grammar:
    """Fit on the labelled rows of ``docs`` outside the held-out fold."""
    return fit(docs, labels.filter(~held_out()), **limits)


def score(docs: DataFrame, grammar: Grammar, *, text: str = "text", out: str = "score", keep: list[str] | None = None) -> DataFrame:
    """``docs`` with the probability of being toxic."""

    def make():
        scanner = grammar.scanner()
        return lambda batch: {out: [probability(document_classes(t or "", grammar, scanner), grammar) for t in batch]}

    return map_column(docs, text, [T.StructField(out, T.DoubleType())], make, keep)
