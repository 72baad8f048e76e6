"""Passes over many graphs at once: nodes and edges are tables with a graph key.

Longest paths shrink the graphs in rounds (``contraction.py``). Every round or level is written to the shared folder, so the
plan stays short and lost executors cost one of them.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, Observation
from pyspark.sql import functions as F


from tidemark.operators.contraction import longest_values
from tidemark.operators.intervals import clip, exclusive_duration
from tidemark.operators.ordered import Running, largest_group, ordered_scan
from tidemark.operators.quantiles import LINEAR, exact_quantiles
from tidemark.operators.span_trees import TRACE_ROWS, small_tree_paths
from tidemark.session import cut_counting, cut_lineage, fresh_path


def _weight(nodes: DataFrame, service: str) -> tuple[str, Column]:
    """Values are doubles if the service is one, else longs; a missing service counts as 0."""
    kind = "double" if nodes.schema[service].dataType.typeName() in ("double", "float", "decimal") else "bigint"
    return kind, F.coalesce(F.col(service).cast(kind), F.lit(0).cast(kind))


def longest_paths(nodes: DataFrame, edges: DataFrame, graph: str, node: str, source: str, target: str, service: str, bases: Mapping[str, Column], *, level: str = "level") -> DataFrame:
    """Level of every node and, per entry of ``bases``, ``service + max(base, largest value of a predecessor)``.

    Rows left without a level lie on or behind a cycle. Reverse the edge columns for suffix values. Values are doubles if
    the service is one, else longs; a missing service counts as 0.
    """
    kind, weight = _weight(nodes, service)
    found = longest_values(nodes, edges, [graph], node, source, target, weight, bases, kind, level)
    return nodes.join(found, [graph, node], "left")


def paths_both_ways(nodes: DataFrame, edges: DataFrame, graph: str, node: str, source: str, target: str, service: str, ahead: tuple[str, Column], behind: tuple[str, Column]) -> DataFrame:
    """:func:`longest_paths` along the edges and against them in the same rounds: ``level`` and one value each way."""
    kind, weight = _weight(nodes, service)
    way = F.explode(F.array(F.lit(0), F.lit(1))).alias("_way")
    there = nodes.select(graph, node, service, weight.alias("_w"), ahead[1].cast(kind).alias("_a"), behind[1].cast(kind).alias("_b"), way)
    turn = lambda one, other: F.when(F.col("_way") == 0, F.col(one)).otherwise(F.col(other))
    links = edges.select(graph, F.col(source).alias("_s"), F.col(target).alias("_t"), way).select(graph, "_way", turn("_s", "_t").alias("_from"), turn("_t", "_s").alias("_to"))
    found = longest_values(there, links, [graph, "_way"], node, "_from", "_to", F.col("_w"), {"_v": turn("_a", "_b")}, kind, "level")
    of = lambda column, at: F.max(F.when(F.col("_way") == at, F.col(column)))
    found = found.groupBy(graph, node).agg(of("level", 0).alias("level"), of("_v", 0).alias(ahead[0]), of("_v", 1).alias(behind[0]))
    return nodes.join(found, [graph, node], "left")


def reach(starts: DataFrame, edges: DataFrame, graph: str, start: str, source: str, target: str) -> DataFrame:
    """All ``(graph, start, node, distance)`` reachable from given start nodes; swap the columns for ancestors.

    The shape of the edges decides how, by two counts of degrees. Where every node has one edge out at most (up a forest), the
    ways double in length each round, so there are as many rounds as the depth has bits. Where every node has one edge in at
    most (down a forest), nothing can be reached twice, and a step reads the nodes of the step before. Otherwise a step is
    also one anti-join with what is there already. The output is one row per start and reached node, so pick starts whose
    reaches do not all overlap (roots of a forest, single operators), as a caller of the closure must.
    """
    links = cut_lineage(edges.select(graph, F.col(source).alias("_s"), F.col(target).alias("_t")).filter("_s IS NOT NULL AND _t IS NOT NULL").distinct(), "reach-edges")
    ends = F.explode(F.array(F.struct(F.lit(0).alias("way"), F.col("_s").alias("n")), F.struct(F.lit(1).alias("way"), F.col("_t").alias("n")))).alias("e")
    degrees = links.select(graph, ends).groupBy(graph, "e").agg(F.count(F.lit(1)).alias("_d")).groupBy("e.way").agg(F.max("_d").alias("_d"))
    most = {r["way"]: r["_d"] for r in degrees.collect()}
    begin = starts.select(graph, start, F.col(start).alias("node"), F.lit(0).alias("distance")).distinct()
    return _reach_doubling(begin, links, graph, start) if most.get(0, 0) <= 1 else _reach_steps(begin, links, graph, start, most[1] > 1)


def _reach_doubling(begin: DataFrame, links: DataFrame, graph: str, start: str) -> DataFrame:
    """Where edges lead to one node at most: after round t all ways of up to 2^t edges are known, and where 2^t edges lead."""
    spark, folder = links.sparkSession, fresh_path(links.sparkSession, "reach-rounds")
    jump, schema = links, begin.schema
    there = begin
    found, depth = 1, 0
    while found:
        far = there.withColumnRenamed("node", "_s").join(jump, [graph, "_s"]).select(graph, start, F.col("_t").alias("node"), (F.col("distance") + (1 << max(depth - 1, 0))).alias("distance"))
        # only a way that runs into a cycle comes by a node again
        new = far.filter(F.col("node") != F.col(start)).groupBy(graph, start, "node").agg(F.min("distance").cast("int").alias("distance"))
        if depth:
            new = new.join(there.select(graph, start, "node"), [graph, start, "node"], "left_anti")
        seen = Observation()
        new.observe(seen, F.count(F.lit(1)).alias("n")).write.parquet(f"{folder}/round-{depth}")
        found = int(seen.get["n"] or 0)
        there = spark.read.schema(schema).parquet(f"{folder}/*")
        if depth:
            jump = cut_lineage(jump.join(jump.select(graph, F.col("_s").alias("_t"), F.col("_t").alias("_u")), [graph, "_t"]).select(graph, "_s", F.col("_u").alias("_t")), "reach-jumps")
        depth += 1
    return there


def _reach_steps(begin: DataFrame, links: DataFrame, graph: str, start: str, meet: bool) -> DataFrame:
    """Step by step; ``meet`` says whether ways can come together, so that a node may be there already."""
    spark, folder = links.sparkSession, fresh_path(links.sparkSession, "reach-levels")
    frontier, schema = begin, begin.schema
    found = depth = 1
    while found:
        step = frontier.withColumnRenamed("node", "_s").join(links, [graph, "_s"]).select(graph, start, F.col("_t").alias("node"), F.lit(depth).alias("distance"))
        if meet:
            step = step.distinct()
            if depth > 1:
                step = step.join(spark.read.schema(schema).parquet(f"{folder}/*").select(graph, start, "node"), [graph, start, "node"], "left_anti")
        seen = Observation()
        step.filter(F.col("node") != F.col(start)).observe(seen, F.count(F.lit(1)).alias("n")).write.parquet(f"{folder}/step-{depth}")
        found = int(seen.get["n"] or 0)
        frontier = spark.read.schema(schema).parquet(f"{folder}/step-{depth}")
        depth += 1
    return spark.read.schema(schema).parquet(f"{folder}/*")


def reach_counts(reached: DataFrame, graph: str, start: str, kinds: Mapping[str, Column]) -> DataFrame:
    return reached.groupBy(graph, start).agg(F.count(F.lit(1)).alias("reached"), *[F.count_if(c).alias(n) for n, c in kinds.items()])


def critical_path_slack(nodes: DataFrame, edges: DataFrame, graph: str, node: str, source: str, target: str, service: str, ready: Column, sink: str) -> DataFrame:
    """Earliest start and finish, latest start, slack and path membership of every ancestor of each graph's sink.

    ``sink`` is a boolean column. The latest start follows from the longest way that remains to the sink, so a forward
    and a backward pass are enough; nodes that do not lead to the sink are left out.
    """
    never = F.lit(-(2**61))
    rows = paths_both_ways(nodes, edges, graph, node, source, target, service, ("finish", ready), ("remaining", F.when(F.col(sink), F.lit(0)).otherwise(never)))
    rows = rows.select(graph, node, "level", sink, service, "finish", "remaining").filter("remaining > 0")
    ends = rows.filter(F.col(sink)).groupBy(graph).agg(F.max("finish").alias("sink_finish"))
    out = rows.join(ends, graph)
    latest = F.col("sink_finish") - F.col("remaining")
    earliest = F.col("finish") - F.col(service)
    return out.select(
        graph, node, "level", earliest.alias("earliest_start"), F.col("finish").alias("earliest_finish"), latest.alias("latest_start"), (latest - earliest).alias("slack"), "remaining", (latest == earliest).alias("on_critical_path"), "sink_finish"
    )


def critical_path_members(nodes: DataFrame, edges: DataFrame, graph: str, node: str, source: str, target: str, service: str) -> DataFrame:
    """Whether a node lies on a longest path of its graph: longest way to it plus longest way on, less its own service."""
    zero = F.lit(0)
    rows = paths_both_ways(nodes, edges, graph, node, source, target, service, ("prefix", zero), ("suffix", zero))
    rows = rows.select(graph, node, service, "level", "prefix", "suffix").withColumn("through", F.col("prefix") + F.col("suffix") - F.col(service))
    longest = rows.groupBy(graph).agg(F.max("through").alias("longest"))
    return rows.join(longest, graph).withColumn("member", F.col("through") == F.col("longest"))


def span_tree_critical_path(spans: DataFrame, keys: Sequence[str], span: str, parent: str, start: str, end: str) -> DataFrame:
    """Critical path of every span: its own time plus, per cluster of overlapping children, the longest child path.

    Children are cut to their parent; one starting where the cluster ends opens the next. ``span_status`` is OK, ORPHAN for a
    span whose parent is absent (it is a root of its own), OK below either, and CYCLE, without a path, for spans that no root
    reaches. Traces of at most ``TRACE_ROWS`` spans take one shuffle and are solved inside a task; larger ones, and those
    without all times, go level by level.
    """
    keys = list(keys)
    spans = spans.select(*keys, span, parent, start, end).dropna("any", subset=[*keys, span])
    sizes = spans.groupBy(*keys).agg((F.count(F.lit(1)) * F.when(F.bool_and(F.col(start).isNotNull() & F.col(end).isNotNull()), 1).otherwise(TRACE_ROWS + 1)).alias("_n"))
    integral = all(spans.schema[c].dataType.typeName() in ("long", "integer", "short", "byte") for c in (start, end))
    most = int(sizes.agg(F.max("_n")).first()[0] or 0) if integral else TRACE_ROWS + 1
    if most <= TRACE_ROWS:
        return small_tree_paths(spans, keys, span, parent, start, end)
    if not integral:
        return _tree_by_levels(spans, keys, span, parent, start, end)
    large = cut_lineage(sizes.filter(F.col("_n") > TRACE_ROWS).select(*keys), "tree-large")
    small = small_tree_paths(spans.join(large, keys, "left_anti"), keys, span, parent, start, end)
    return small.unionByName(_tree_by_levels(spans.join(large, keys, "left_semi"), keys, span, parent, start, end))


def _tree_by_levels(spans: DataFrame, keys: list[str], span: str, parent: str, start: str, end: str) -> DataFrame:
    """:func:`span_tree_critical_path` from the deepest spans up, one level after the other."""
    own = exclusive_duration(spans, keys, span, parent, start, end, "_own")
    base = cut_lineage(spans.select(*keys, span, parent, start, end).join(own, [*keys, span]), "tree")
    hot = largest_group(spans.filter(F.col(parent).isNotNull()), [*keys, parent])
    child, there = base.filter(F.col(parent).isNotNull()), base.select(*keys, F.col(span).alias(parent)).distinct()
    ok = F.lit("OK").alias("span_status")
    tops = base.filter(F.col(parent).isNull()).select("*", ok).unionByName(child.join(there, [*keys, parent], "left_anti").select(*base.columns, F.lit("ORPHAN").alias("span_status")))
    level, found_ = cut_counting(tops.withColumn("_d", F.lit(0)), "tree", F.count(F.lit(1)))
    levels = []
    rest = child.join(there, [*keys, parent], "left_semi").select(*base.columns, ok)
    while found_ or not levels:
        levels.append(level)
        up = level.select(*keys, F.col(span).alias(parent), F.col(start).alias("_ps"), F.col(end).alias("_pe"))
        found = rest.join(up.select(*keys, parent).distinct(), [*keys, parent], "left_semi")
        level, found_ = cut_counting(found.withColumn("_d", F.lit(len(levels))), "tree", F.count(F.lit(1)))
    done: DataFrame | None = None
    below: DataFrame | None = None
    for at in reversed(levels):
        if below is None:
            paths = at.withColumn("critical_path", F.col("_own"))
        else:
            frame = at.select(*keys, F.col(span).alias(parent), F.col(start).alias("_ps"), F.col(end).alias("_pe"))
            kids = clip(below.join(frame, [*keys, parent]), start, end, F.col("_ps"), F.col("_pe")).filter(F.col(start) < F.col(end))
            order = [start, end, span]
            seen = ordered_scan(kids, [*keys, parent], order, running={"_seen": Running("max", F.col(end), False)}, hot=hot)
            opens = F.when(F.col("_seen").isNull() | (F.col(start) >= F.col("_seen")), 1).otherwise(0)
            group = ordered_scan(seen.withColumn("_o", opens), [*keys, parent], order, running={"_c": Running("sum", F.col("_o"))}, hot=hot)
            per = group.groupBy(*keys, parent, "_c").agg(F.max("critical_path").alias("_m")).groupBy(*keys, F.col(parent).alias(span)).agg(F.sum("_m").alias("_kids"))
            paths = at.join(per, [*keys, span], "left").withColumn("critical_path", F.col("_own") + F.coalesce("_kids", F.lit(0))).drop("_kids")
        below = cut_lineage(paths, "tree")
        part = below.select(*keys, span, F.col("_d").alias("depth"), F.col("_own").alias("exclusive"), "critical_path", "span_status")
        done = part if done is None else done.unionByName(part)
    lost = base.select(*keys, span, F.col("_own").alias("exclusive")).join(done.select(*keys, span), [*keys, span], "left_anti")
    nothing = F.lit(None).cast("long")
    return done.unionByName(lost.select(*keys, span, F.lit(None).cast("int").alias("depth"), "exclusive", nothing.alias("critical_path"), F.lit("CYCLE").alias("span_status")))


def source_path_bounds(finish: DataFrame, graph: str, service: str, heavy: Column, arrival: str, published: str, workers: int) -> DataFrame:
    """Per source: earliest publication, model work, work bound ``ceil(work / workers)`` and the larger of it and the path."""
    rows = finish.groupBy(graph).agg(
        F.min(arrival).alias("arrival"), F.max("finish").alias("earliest_publication"), F.max(published).alias("observed_publication"), F.count_if(heavy).alias("requests"), F.sum(F.when(heavy, F.col(service)).otherwise(0)).alias("work")
    )
    path, bound = F.greatest(F.lit(0), F.col("earliest_publication") - F.col("arrival")), F.ceil(F.col("work") / workers)
    return rows.withColumns({"critical_path": path, "resource_bound": bound, "combined_bound": F.greatest(path, bound), "latency": F.col("observed_publication") - F.col("arrival")})


def readiness(operators: DataFrame, dependencies: DataFrame, operator: str, available: str, prepared: str, predecessor: str, satisfied: str) -> DataFrame:
    """When each operator could have run: at the latest of its own and its dependencies' times; UNKNOWN if one is missing."""
    deps = dependencies.groupBy(operator).agg(F.max(satisfied).alias("_dep"), F.count_if(F.col(satisfied).isNull()).alias("_open"))
    rows = operators.join(deps, operator, "left")
    known = F.col(available).isNotNull() & F.col(prepared).isNotNull() & F.col(predecessor).isNotNull() & (F.coalesce("_open", F.lit(0)) == 0)
    ready = F.when(known, F.greatest(F.col(available), F.col("_dep")))
    return rows.withColumns({"ready_at": ready, "readiness_status": F.when(known, "LOCALLY_READY").otherwise("UNKNOWN")}).withColumns(
        {"advance": F.col(prepared) - F.col("ready_at"), "before_prepared": F.col("ready_at") < F.col(prepared), "before_predecessor": F.col("ready_at") < F.col(predecessor)}
    ).drop("_dep", "_open")


def readiness_audit(rows: DataFrame, keys: Sequence[str]) -> DataFrame:
    sums = rows.groupBy(*keys).agg(
        F.count(F.lit(1)).alias("operators"),
        F.count_if(F.col("readiness_status") == "LOCALLY_READY").alias("locally_ready"),
        F.count_if(F.col("readiness_status") == "UNKNOWN").alias("unknown"),
        F.count_if(F.coalesce("before_prepared", F.lit(False))).alias("ready_before_prepared"),
        F.count_if(F.coalesce("before_predecessor", F.lit(False))).alias("ready_before_predecessor"),
    )
    gains = rows.filter("advance > 0")
    tails = exact_quantiles(gains, keys, "advance", {"advance_p50": 0.5, "advance_p95": 0.95}, method=LINEAR, extra=[F.max("advance").alias("advance_max")])
    return sums.join(tails, list(keys), "left")
