"""URL filters with dated lists.

List entries come as dated events (an entry is added or removed). Per entry they become validity intervals ``[from, until)``. An as-of
join then evaluates every capture against the entries active at its fetch time: a capture's host, the domains above it and the
prefixes of its path are looked up together with the time cell of the fetch, so a key with a long history meets only the
intervals of its cell, and each (entry, capture) pair meets once. The most specific active entry decides: path prefix before host
before domain; at the same kind and value allowing wins.

Equal captures (id, URL, time) are evaluated once and given back as often as they came. A frequent host is a frequent join key on the
capture side only; the side of the intervals is unique per (key, cell) and list, and the join may be split.

Defined cases. Null or unparsable URLs and null fetch times match nothing and are "unlisted". Repeated entry events change nothing; at
one instant a removal comes before an addition. Events with a null in any column are ignored. Schemes and hosts are compared in lower case, paths as they
are. Other columns do not matter.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Seconds per time cell.
CELL = 30 * 86_400
HOST = r"^[A-Za-z][A-Za-z0-9+.-]*://(?:[^/?#@]*@)?([^/?#:@]+)"
PATH = r"^[A-Za-z][A-Za-z0-9+.-]*://[^/?#]*(/[^?#]*)"
KINDS = ("prefix", "host", "domain")


def host_of(url: Column) -> Column:
    return F.lower(F.regexp_extract(F.coalesce(url, F.lit("")), HOST, 1))


def keys_of(url: Column) -> Column:
    """All (kind, value) under which an entry may cover the URL."""
    host, path = host_of(url), F.regexp_extract(F.coalesce(url, F.lit("")), PATH, 1)
    labels = F.split(host, r"\.")
    domains = F.transform(F.sequence(F.lit(1), F.size(labels)), lambda i: F.struct(F.lit("domain").alias("kind"), F.array_join(F.slice(labels, i, F.size(labels)), ".").alias("value")))
    steps = F.filter(F.split(path, "/"), lambda s: s != "")
    prefixes = F.when(F.size(steps) > 0, F.transform(F.sequence(F.lit(1), F.size(steps)), lambda i: F.struct(F.lit("prefix").alias("kind"), F.concat(host, F.lit("/"), F.array_join(F.slice(steps, 1, i), "/")).alias("value"))))
    own = F.array(F.struct(F.lit("host").alias("kind"), host.alias("value")))
    none = F.expr("CAST(array() AS array<struct<kind:string,value:string>>)")
    return F.when(host == "", none).otherwise(F.array_distinct(F.concat(own, domains, F.coalesce(prefixes, none))))


def validity_intervals(entries: DataFrame) -> DataFrame:
    """``(list, kind, value, allow, from, until)`` from dated events ``(list, kind, value, allow, action, at)``; until is null while open.

    ``action`` is add or remove, ``at`` is a time in seconds. The history of one entry is scanned in order.
    """
    key = ["list", "kind", "value", "allow"]
    events = entries.select(*key, F.col("action"), F.col("at").cast("long").alias("at")).dropna().distinct()
    # one state per instant: an addition outlasts a removal at the same time
    states = events.groupBy(*key, "at").agg(F.max((F.col("action") == "add").cast("int")).alias("on"))
    line = Window.partitionBy(*key).orderBy("at")
    states = states.withColumn("_was", F.coalesce(F.lag("on").over(line), F.lit(0))).filter(F.col("on") != F.col("_was"))
    ended = states.withColumn("until", F.lead("at").over(line))
    return ended.filter(F.col("on") == 1).select(*key, F.col("at").alias("from"), "until")


def evaluate(captures: DataFrame, intervals: DataFrame, *, cell: int = CELL) -> DataFrame:
    """``(id, url, at, verdict, n_active, matched)``: one row per row of ``captures`` (id, url, at in seconds).

    ``verdict`` is allowed, blocked or unlisted; ``matched`` lists the active entries, most specific first.
    """
    each = captures.select("id", "url", F.col("at").cast("long").alias("at")).groupBy("id", "url", "at").agg(F.count(F.lit(1)).alias("_times"))
    span = each.agg(F.min("at").alias("lo"), F.max("at").alias("hi")).first()
    lo, hi = span["lo"] or 0, span["hi"] or 0
    slot = lambda t: F.floor(t / cell)
    live = intervals.filter((F.col("from") <= hi) & (F.col("until").isNull() | (F.col("until") > lo)))
    first, last = F.greatest(F.col("from"), F.lit(lo)), F.least(F.coalesce(F.col("until") - 1, F.lit(hi)), F.lit(hi))
    live = live.withColumn("slot", F.explode(F.sequence(slot(first), slot(last))))
    live = live.select("kind", "value", "slot", "list", "allow", "from", "until")
    asked = each.withColumn("_k", F.explode(keys_of(F.col("url")))).select("id", "url", "at", F.col("_k.kind").alias("kind"), F.col("_k.value").alias("value"), slot(F.col("at")).alias("slot"))
    met = asked.join(live, ["kind", "value", "slot"]).filter((F.col("at") >= F.col("from")) & (F.col("until").isNull() | (F.col("at") < F.col("until"))))
    rank = F.when(F.col("kind") == "prefix", 0).when(F.col("kind") == "host", 1).otherwise(2)
    entry = F.struct(rank.alias("rank"), (-F.length("value")).alias("len"), (~F.col("allow")).alias("deny"), "list", "value")
    # the entries active for one URL at one time are bounded by lists times keys of the URL
    found = met.groupBy("id", "url", "at").agg(F.sort_array(F.collect_set(entry)).alias("_e"))
    found = found.select(F.col("id").alias("_i"), F.col("url").alias("_u"), F.col("at").alias("_a"), "_e")
    same = F.col("id").eqNullSafe(F.col("_i")) & F.col("url").eqNullSafe(F.col("_u")) & F.col("at").eqNullSafe(F.col("_a"))
    out = each.join(found, same, "left")
    verdict = F.when(F.col("_e").isNull(), "unlisted").when(F.col("_e")[0]["deny"], "blocked").otherwise("allowed")
    name = lambda e: F.concat_ws(":", e["list"], F.element_at(F.array(*[F.lit(k) for k in KINDS]), e["rank"] + 1), e["value"])
    out = out.select("id", "url", "at", verdict.alias("verdict"), F.coalesce(F.size("_e"), F.lit(0)).cast("long").alias("n_active"), F.coalesce(F.array_join(F.transform("_e", name), " "), F.lit("")).alias("matched"), "_times")
    return out.withColumn("_n", F.explode(F.sequence(F.lit(1).cast("long"), F.col("_times")))).drop("_times", "_n")
