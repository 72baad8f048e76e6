"""Chat formatting of reply trees. DataFrame functions only.

A forest is a table of messages, each with a tree, an id and the id of the message it answers. Self-joins by pointer doubling
enumerate the paths from root to leaf: after k rounds every message knows its ancestor ``2^k`` steps up, and every leaf has the
``2^k`` nearest messages of its path; a round adds as many again. So a thread of n messages takes log n joins, and the rows made
number the messages of all paths. Branches are ranked by the mean score of their messages, and each chosen path is formatted as
one conversation.

Template. A turn is ``<s>role[INST]text[/INST]``, or ``<s>role[INST]text</s>`` where the loss counts. Backslashes in roles and
texts are doubled and a backslash is put into each control string, so no text can open or close a turn, and dropping the
backslashes gives the text back.

Defined cases. Null texts and roles count as empty; null scores as 0. A message whose parent is unknown is a root. Ids given more than once are
messages of their own; replies to such an id hang on the first of them by role, text and score. Messages on a cycle have no root
and are on no path. Null tree ids form one tree. Other columns do not matter; an empty table gives no conversations.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidemark.llm.common import written, written_counting

#: Control strings of the template (fixed values).
OPEN, HEAD, CLOSE, CLOSE_LOSS = "<s>", "[INST]", "[/INST]", "</s>"


def escape(text: Column) -> Column:
    """Text in which no control string occurs; :func:`unescape` gives it back."""
    doubled = F.replace(F.coalesce(text, F.lit("")), F.lit("\\"), F.lit("\\\\"))
    return F.regexp_replace(doubled, r"([<\[])(/?(?:s>|INST\]))", r"$1\\$2")


def unescape(text: Column) -> Column:
    return F.regexp_replace(text, r"\\([\s\S])", "$1")


def turn(role: Column, text: Column, loss: Column) -> Column:
    return F.concat(F.lit(OPEN), escape(role), F.lit(HEAD), escape(text), F.when(loss, CLOSE_LOSS).otherwise(CLOSE))


def root_to_leaf_paths(messages: DataFrame) -> DataFrame:
    """``(leaf, node, place)`` for every path, place 0 at the root. ``messages`` has unique ``node`` and ``up``, null at roots."""
    up = messages.select("node", F.col("up").alias("jump"))
    inner = up.filter("jump IS NOT NULL").select(F.col("jump").alias("node")).distinct()
    paths = messages.join(inner, "node", "left_anti").select(F.col("node").alias("leaf"), "node", F.lit(0).cast("long").alias("above"))
    jumps, open_jumps = written_counting(up.filter("jump IS NOT NULL"), "jumps")
    limit, step = 1, 1
    nodes = None
    while open_jumps:
        more = paths.join(jumps, "node").select("leaf", F.col("jump").alias("node"), (F.col("above") + step).alias("above"))
        paths = written(paths.unionByName(more), "paths")
        # after log n doublings only messages on or below a cycle still point on
        nodes = messages.count() if nodes is None else nodes
        if limit > 2 * nodes:
            break
        far = jumps.select(F.col("node").alias("jump"), F.col("jump").alias("_far"))
        jumps, open_jumps = written_counting(jumps.join(far, "jump").select("node", F.col("_far").alias("jump")), "jumps")
        limit, step = limit * 2, step * 2
    roots = messages.filter("up IS NULL").select("node")
    top = paths.join(roots, "node").select("leaf", F.col("above").alias("_top"))
    return paths.join(top, "leaf").select("leaf", "node", (F.col("_top") - F.col("above")).alias("place"))


def conversations(messages: DataFrame, *, tree: str = "tree", message: str = "message", parent: str = "parent", role: str = "role", text: str = "text", score: str | None = "score", branches: int | None = None, loss_roles: tuple[str, ...] = ("assistant",)) -> DataFrame:
    """``(tree, branch, leaf, score, n_turns, formatted, loss_spans)``: one row per chosen path.

    ``branch`` ranks the paths of a tree from 1 by score, ties by id of the leaf; ``branches`` keeps the best so many. ``loss_spans`` are the
    ``start`` and ``length`` (code points, from 0) of the escaped texts that the loss counts.
    """
    value = F.coalesce(F.col(score).cast("double"), F.lit(0.0)) if score else F.lit(0.0)
    rows = messages.select(F.col(tree).alias("tree"), F.col(message).alias("message"), F.col(parent).alias("parent"), F.coalesce(F.col(role), F.lit("")).alias("role"), F.coalesce(F.col(text), F.lit("")).alias("text"), value.alias("score"))
    twins = Window.partitionBy("tree", "message").orderBy("role", "text", "score")
    rows = rows.withColumn("twin", F.row_number().over(twins))
    # one value names a message; lengths keep ("1", "23") and ("12", "3") apart
    name = lambda t, m, n: F.concat_ws("|", F.length(F.coalesce(t.cast("string"), F.lit(""))), t.isNull(), t.cast("string"), m.isNull(), m.cast("string"), n)
    rows = written(rows.withColumn("node", name(F.col("tree"), F.col("message"), F.col("twin"))), "messages")
    firsts = rows.filter("twin = 1").select(F.col("tree").alias("_t"), F.col("message").alias("_m"), F.col("node").alias("up"))
    links = rows.join(firsts, F.col("tree").eqNullSafe(F.col("_t")) & (F.col("parent") == F.col("_m")), "left").select("node", "up")
    paths = root_to_leaf_paths(written(links, "replies"))
    piece = turn(F.col("role"), F.col("text"), F.col("role").isin(*loss_roles))
    parts = rows.select("node", "tree", "message", "score", piece.alias("piece"), F.col("role").isin(*loss_roles).alias("loss"), (F.length(escape(F.col("role"))) + len(OPEN) + len(HEAD)).alias("_head"), F.length(escape(F.col("text"))).alias("_body"))
    turns = paths.join(parts, "node")
    whole = turns.groupBy("leaf").agg(
        F.first("tree").alias("tree"),
        F.max_by("message", "place").alias("_leaf"),
        F.avg("score").alias("score"),
        F.count(F.lit(1)).alias("n_turns"),
        F.sort_array(F.collect_list(F.struct("place", "piece", "loss", "_head", "_body"))).alias("_t"),
    )
    # start of each turn = lengths of the turns before it
    spans = F.aggregate(
        "_t",
        F.struct(F.lit(0).alias("at"), F.expr("CAST(array() AS array<struct<start:int,length:int>>)").alias("spans")),
        lambda acc, t: F.struct(
            (acc["at"] + F.length(t["piece"])).alias("at"),
            F.when(t["loss"], F.concat(acc["spans"], F.array(F.struct((acc["at"] + t["_head"]).alias("start"), t["_body"].alias("length"))))).otherwise(acc["spans"]).alias("spans"),
        ),
        lambda acc: acc["spans"],
    )
    out = whole.select("tree", F.col("_leaf").alias("leaf"), "score", "n_turns", F.concat_ws("", F.transform("_t", lambda t: t["piece"])).alias("formatted"), spans.alias("loss_spans"))
    best = Window.partitionBy("tree").orderBy(F.col("score").desc(), F.col("leaf").asc_nulls_last(), "formatted")
    out = out.withColumn("branch", F.row_number().over(best))
    if branches is not None:
        out = out.filter(F.col("branch") <= branches)
    return out.select("tree", "branch", "leaf", "score", "n_turns", "formatted", "loss_spans")


def turns_of(formatted: Column) -> Column:
    """The turns of a formatted conversation: an array of structs role, text, loss."""
    pieces = F.filter(F.split(formatted, r"<s>"), lambda p: p != "")

    def read(piece: Column) -> Column:
        cut = F.instr(piece, HEAD)
        body = F.substring(piece, cut + len(HEAD), F.length(piece))
        loss = F.endswith(body, F.lit(CLOSE_LOSS))
        inner = F.when(loss, F.substring(body, F.lit(1), F.length(body) - len(CLOSE_LOSS))).otherwise(F.substring(body, F.lit(1), F.length(body) - len(CLOSE)))
        return F.struct(unescape(F.substring(piece, F.lit(1), cut - 1)).alias("role"), unescape(inner).alias("text"), loss.alias("loss"))

    return F.transform(pieces, read)


def loss_texts(formatted: Column, spans: Column) -> Column:
    """The texts under the loss mask, unescaped, in order."""
    return F.transform(spans, lambda s: unescape(F.substring(formatted, s["start"] + 1, s["length"])))
