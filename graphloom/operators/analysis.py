"""Impact, cycles, processes, risk, coverage and quality of a property graph."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from graphloom.operators.algorithms import strong_components
from graphloom.operators.graph_stats import degrees, package
from graphloom.sources.scratch import store


def norm_log(n: Column, most: Column) -> Column:
    """ln(1 + n) / ln(1 + most), 0 where either is 0."""
    return F.when((n > 0) & (most > 0), F.log1p(n) / F.log1p(most)).otherwise(0.0)


def risk_label(direct: Column, total: Column) -> Column:
    """LOW, MEDIUM, HIGH or CRITICAL by direct dependents, and by all of them at twice the number."""
    return (
        F.when((direct >= 10) | (total >= 20), "CRITICAL").when((direct >= 5) | (total >= 10), "HIGH")
        .when((direct >= 2) | (total >= 4), "MEDIUM").otherwise("LOW")
    )


def impact(seeds: DataFrame, edges: DataFrame, weak: Column, depth: int = 3) -> DataFrame:
    """(seed, tier1, tier2, tier3, direct, total, risk): dependents of each seed by least distance. From the
    second tier on weak edges do not count. A seed without dependents has empty tiers. Seeds are numbered in the
    order of their ids; a row (at, word, mask) tells by the bits of mask which of 64 seeds have reached a node, so
    sets are united by `bit_or`, 64 at a time and before they are moved, and the last tier is counted unstored."""
    e = store(edges.select(F.col("dst").alias("at"), F.col("src").alias("next"), weak.alias("weak")).groupBy("at", "next").agg(F.min("weak").alias("weak")), "impact")
    numbered = store(seeds.select(F.col("id").alias("seed")).distinct().orderBy("seed").withColumn("no", F.monotonically_increasing_id()), "impact")
    word, bit = F.shiftright("no", 6), F.expr("shiftleft(1L, cast(no & 63 as int))")
    seen = front = store(numbered.where("seed is not null").groupBy(F.col("seed").alias("at"), word.alias("word")).agg(F.bit_or(bit).alias("mask")), "impact")
    tiers = [f"tier{t}" for t in range(1, depth + 1)]
    counts = None
    for tier, name in enumerate(tiers, 1):
        met = front.join(e if tier == 1 else e.where("not weak"), "at").where("next is not null").groupBy(F.col("next").alias("at"), "word").agg(F.bit_or("mask").alias("mask"))
        old = seen.groupBy("at", "word").agg(F.bit_or("mask").alias("old"))
        front = met.join(old, ["at", "word"], "left").select("at", "word", F.expr("mask & ~coalesce(old, 0L)").alias("mask")).where("mask <> 0")
        if tier < depth:
            front = store(front, "impact")
            seen = seen.unionByName(front)
        bits = front.groupBy("word").agg(F.array(*[F.sum(F.expr(f"shiftrightunsigned(mask, {i}) & 1L")) for i in range(64)]).alias("n"))
        some = bits.select("word", F.lit(name).alias("tier"), "n")
        counts = some if counts is None else counts.unionByName(some)
    by = counts.groupBy("word").agg(*[F.first(F.when(F.col("tier") == x, F.col("n")), ignorenulls=True).alias(x) for x in tiers])
    at = (F.col("no").bitwiseAND(F.lit(63))).cast("int")
    out = numbered.withColumn("word", word).join(by, "word", "left").select("seed", *[F.coalesce(F.get(x, at), F.lit(0).cast("long")).alias(x) for x in tiers])
    total = sum((F.col(x) for x in tiers[1:]), F.col(tiers[0]))
    out = out.withColumn("total", total).withColumn("direct", F.col("tier1"))
    return out.withColumn("risk", risk_label(F.col("direct"), F.col("total")))


def cycles(ids: DataFrame, edges: DataFrame, community: DataFrame, structural: list[str]) -> DataFrame:
    """One row for each strongly connected component of two nodes or more: (component, size, kind, severity).

    import (3) if an edge inside is structural, cross_community (2) if its nodes lie in more than one
    community(id, community), else call (1). Self-loops are no cycles.
    """
    of = store(strong_components(ids, edges), "cycles")
    size = of.groupBy("component").agg(F.count(F.lit(1)).alias("size")).where("size >= 2")
    inner = of.join(size.select("component"), "component", "left_semi")
    spread = inner.join(community, "id").groupBy("component").agg(F.countDistinct("community").alias("spread"))
    a, b = inner.toDF("component", "src"), inner.toDF("other", "dst")
    within = edges.where("src <> dst").join(a, "src").join(b, "dst").where("component = other")
    hard = within.groupBy("component").agg(F.max(F.col("kind").isin(structural)).alias("hard"))
    joined = size.join(spread, "component", "left").join(hard, "component", "left")
    kind = F.when(F.col("hard"), "import").when(F.col("spread") > 1, "cross_community").otherwise("call")
    severity = F.when(F.col("hard"), 3).when(F.col("spread") > 1, 2).otherwise(1)
    return joined.select("component", "size", kind.alias("kind"), severity.alias("severity"))


def cycle_paths(ids: DataFrame, edges: DataFrame, most: int = 64) -> DataFrame:
    """(component, path): a shortest cycle through the least node of each component, the first by path."""
    of = store(strong_components(ids, edges), "cycle-paths")
    big = of.groupBy("component").agg(F.count(F.lit(1)).alias("n")).where("n >= 2").select("component")
    inner = of.join(big, "component", "left_semi")
    e = edges.where("src <> dst").join(inner.toDF("c", "src"), "src").join(inner.toDF("c2", "dst"), "dst").where("c = c2")
    e = store(e.select("c", "src", "dst").distinct(), "cycle-paths")
    front = big.select(F.col("component").alias("c"), F.col("component").alias("at"), F.array("component").alias("path"))
    front, seen, done = store(front, "cycle-paths"), None, None
    for _ in range(most):
        met = front.join(e, (front["at"] == e["src"]) & (front["c"] == e["c"])).select(front["c"], F.col("dst").alias("at"), F.array_append("path", F.col("dst")).alias("path"))
        met = store(met.groupBy("c", "at").agg(F.min("path").alias("path")), "cycle-paths")
        closed = met.where("at = c")
        done = closed if done is None else done.unionByName(closed.join(done.select("c"), "c", "left_anti"))
        seen = met if seen is None else seen.unionByName(met)
        open_ = met.join(done.select("c"), "c", "left_anti")
        front = store(open_, "cycle-paths")
        if front.isEmpty():
            break
    return done.select(F.col("c").alias("component"), F.array_join("path", ">").alias("path"))


# What a name says of an entry point, the first that fits.
NAME_FACTORS = [(r"(?i)^(main|run|serve|customer)", 1.5), (r"(?i)(handler|order)", 1.3), (r"(?i)^(get|set|is|red)", 0.3), (r"(?i)(test|mock|blue)", 0.5)]


def entry_scores(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """callees / (callers + 1), times what the name says, 1.5 if exported (a capital first), 2 without callers
    or 1.3 with two at most; 0 without callees; above .5."""
    d = degrees(nodes, edges).join(nodes.select("id", "name"), "id")
    i, o = F.col("fan_in"), F.col("fan_out")
    name = F.lit(1.0)
    for p, w in reversed(NAME_FACTORS):
        name = F.when(F.col("name").rlike(p), w).otherwise(name)
    score = o / (i + 1) * name * F.when(F.col("name").rlike("^[A-Z]"), 1.5).otherwise(1.0) * F.when(i == 0, 2.0).when(i <= 2, 1.3).otherwise(1.0)
    return d.where("fan_out > 0").select("id", F.round(score, 6).alias("score")).where("score > 0.5")


def processes(entries: DataFrame, edges: DataFrame, depth: int = 15, steps: int = 2048, top: int = 50) -> DataFrame:
    """(entry, node_id, depth): what the `top` entries(id, score) reach, each node once at its least depth; a
    process keeps its first `steps` nodes by (depth, id), which bounds every frontier."""
    some = entries.orderBy(F.desc("score"), "id").limit(top).select(F.col("id").alias("entry"))
    e = edges.select(F.col("src").alias("at"), F.col("dst").alias("next"))  # what parallel edges meet twice is made distinct with each frontier
    seen = front = store(some.select("entry", F.col("entry").alias("node_id"), F.lit(0).alias("depth")), "processes")
    for hop in range(1, depth + 1):
        met = front.join(e, front["node_id"] == e["at"]).select("entry", F.col("next").alias("node_id")).distinct()
        fresh = met.join(seen.select("entry", "node_id"), ["entry", "node_id"], "left_anti")
        held = seen.groupBy("entry").agg(F.count(F.lit(1)).alias("held"))
        w = Window.partitionBy("entry").orderBy("node_id")
        kept = fresh.withColumn("rn", F.row_number().over(w)).where(F.col("rn") <= steps).join(F.broadcast(held), "entry").where(F.col("rn") + F.col("held") <= steps)  # `top` rows
        front = store(kept.select("entry", "node_id", F.lit(hop).alias("depth")), "processes")
        if front.isEmpty():
            break
        seen = seen.unionByName(front)
    return seen


def pr_risk(changes: DataFrame) -> DataFrame:
    """changes(change, flow, callers, security, covered, symbols, communities): axes from 0 to 100, and a level.

    Axes: 10 a flow, 2 a caller, 80 on a security path, the share of symbols without coverage, 20 a further
    community. The score is the mean of the two largest axes; security, or 50 on flow and callers both, is HIGH
    at least.
    """
    cap = lambda x: F.least(x.cast("double"), F.lit(100.0))
    axes = {
        "flow_axis": cap(10 * F.col("flow")), "callers_axis": cap(2 * F.col("callers")), "security_axis": F.when(F.col("security"), 80.0).otherwise(0.0),
        "coverage_axis": F.round(100.0 * (F.col("symbols") - F.col("covered")) / F.greatest(F.col("symbols"), F.lit(1)), 6), "community_axis": cap(20 * (F.col("communities") - 1)),
    }
    out = changes.select("change", *[c.alias(n) for n, c in axes.items()])
    ordered = F.sort_array(F.array(*axes), asc=False)
    score = (F.get(ordered, F.lit(0)) + F.get(ordered, F.lit(1))) / 2
    high = (F.col("security_axis") >= 70) | ((F.col("flow_axis") >= 50) & (F.col("callers_axis") >= 50))
    level = F.when(score >= 85, "CRITICAL").when((score >= 60) | high, "HIGH").when(score >= 30, "MEDIUM").otherwise("LOW")
    return out.withColumns({"score": F.round(score, 6), "level": level})


def symbol_coverage(symbols: DataFrame, hits: DataFrame, bucket: int = 16) -> DataFrame:
    """symbols(file, name, lo, hi) and hits(file, line, statements, hit): statements, covered and percent of each
    symbol. The ranges are cut into buckets of lines, so the join is an equi-join."""
    s = symbols.withColumn("b", F.explode(F.sequence(F.floor(F.col("lo") / bucket), F.floor(F.col("hi") / bucket))))
    lines = hits.groupBy("file", "line").agg(F.sum("statements").alias("statements"), F.max("hit").alias("hit")).withColumn("b", F.floor(F.col("line") / bucket))
    met = s.join(lines, ["file", "b"]).where("line between lo and hi")
    sums = met.groupBy("file", "name").agg(F.sum("statements").alias("statements"), F.sum(F.when(F.col("hit"), F.col("statements")).otherwise(0)).alias("covered"))
    return sums.withColumn("percent", F.round(100.0 * F.col("covered") / F.col("statements"), 6))


def bottlenecks(symbols: DataFrame) -> DataFrame:
    """symbols(id, loops, below, cognitive, cyclomatic, recursion, scans): an additive integer score: loops 4
    each, loops below 5 each, cognitive complexity from 15, half the cyclomatic one from 10, recursion 3 if
    simple and 8 if inside a loop, 6 for a scan."""
    score = (
        4 * F.col("loops") + 5 * F.col("below") + F.when(F.col("cognitive") >= 15, F.col("cognitive")).otherwise(0)
        + F.when(F.col("cyclomatic") >= 10, F.floor(F.col("cyclomatic") / 2)).otherwise(0)
        + F.when(F.col("recursion") & (F.col("loops") > 0), 8).when(F.col("recursion"), 3).otherwise(0) + F.when(F.col("scans"), 6).otherwise(0)
    )
    return symbols.select("id", score.cast("long").alias("score")).where("score > 0")


def health(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """Per package: 100 less 40 times the share of isolated nodes and 30 times that of hubs (20 uses or more) and
    30 times the share of edges that leave it, and a grade."""
    unit = nodes.select("id", package(F.col("file_path")).alias("unit"))
    d = degrees(nodes, edges).join(unit, "id").groupBy("unit").agg(
        F.count(F.lit(1)).alias("members"), F.count_if(F.col("fan_in") + F.col("fan_out") == 0).alias("lone"), F.count_if(F.col("fan_in") >= 20).alias("hubs")
    )
    e = edges.join(unit.toDF("src", "a"), "src").join(unit.toDF("dst", "b"), "dst").groupBy(F.col("a").alias("unit")).agg(F.count(F.lit(1)).alias("out"), F.count_if(F.col("a") != F.col("b")).alias("leaving"))
    leave = F.coalesce(F.col("leaving") / F.col("out"), F.lit(0.0))
    score = F.round(100 - 40 * F.col("lone") / F.col("members") - 30 * F.col("hubs") / F.col("members") - 30 * leave, 6)
    grade = F.when(score >= 90, "A").when(score >= 75, "B").when(score >= 60, "C").when(score >= 40, "D").otherwise("F")
    return d.join(e, "unit", "left").select("unit", "members", score.alias("score"), grade.alias("grade"))


def zero_edges(nodes: DataFrame, edges: DataFrame, covered: Column) -> DataFrame:
    """What a node's missing edges mean: none missing, likely_unused where its kind has edges as a rule (half of
    it at least), possible_extraction_gap where it has not, coverage_incomplete outside what was covered."""
    d = degrees(nodes, edges).join(nodes.select("id", covered.alias("covered")), "id").withColumn("alone", F.col("fan_in") + F.col("fan_out") == 0)
    rule = d.groupBy("kind").agg((2 * F.count_if(~F.col("alone")) >= F.count(F.lit(1))).alias("rule"))
    what = F.when(~F.col("alone"), "none").when(~F.col("covered"), "coverage_incomplete").when(F.col("rule"), "likely_unused").otherwise("possible_extraction_gap")
    return d.join(F.broadcast(rule), "kind").select("id", what.alias("class"))  # one row a kind


def cluster_stats(membership: DataFrame, nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """Per community of membership(id, community): size, files, kinds, edges inside, density and the hub (most
    edges inside, then least id)."""
    n = membership.join(nodes.select("id", "file_path", "kind"), "id")
    base = n.groupBy("community").agg(F.count(F.lit(1)).alias("size"), F.countDistinct("file_path").alias("files"), F.countDistinct("kind").alias("kinds"))
    e = edges.join(membership.toDF("src", "c1"), "src").join(membership.toDF("dst", "c2"), "dst").where("c1 = c2").select("src", "dst", F.col("c1").alias("community"))
    e = store(e, "cluster")
    inside = e.groupBy("community").agg(F.count(F.lit(1)).alias("inside"))
    ends = e.select("community", F.explode(F.array("src", "dst")).alias("id")).groupBy("community", "id").agg(F.count(F.lit(1)).alias("k"))
    hub = ends.groupBy("community").agg(F.min_by("id", F.struct(-F.col("k"), F.col("id"))).alias("hub"))
    density = F.round(F.coalesce("inside", F.lit(0)) / F.greatest(F.col("size") * (F.col("size") - 1), F.lit(1)), 9)
    return base.join(inside, "community", "left").join(hub, "community", "left").select("community", "size", "files", "kinds", F.coalesce("inside", F.lit(0).cast("long")).alias("inside"), density.alias("density"), "hub")


def race_writes(spawned: DataFrame, calls: DataFrame, writes: DataFrame, locked: DataFrame, depth: int = 3) -> DataFrame:
    """writes(writer, field) whose writer is reached from spawned(id) by calls(src, dst) and holds no lock."""
    from graphloom.operators.traverse import bfs

    reached = bfs(spawned, calls.withColumn("kind", F.lit("call")), depth).select(F.col("node_id").alias("writer"))
    return writes.join(reached, "writer", "left_semi").join(locked.select(F.col("id").alias("writer")), "writer", "left_anti").select("field", "writer").distinct()


def unclosed(sends: DataFrame, closes: DataFrame) -> DataFrame:
    """Channels of sends(channel) that closes(channel) does not name, with the number of sends."""
    return sends.groupBy("channel").agg(F.count(F.lit(1)).alias("sends")).join(closes.select("channel").distinct(), "channel", "left_anti")


def _reach(defs: list[list[int]], flow: np.ndarray, n: int) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """For each variable: (variable, defining blocks, blocks reached), of one function with blocks 0 to n - 1.
    The last variable is the unknown one, which nothing redefines."""
    order = np.argsort(flow[:, 0], kind="stable")
    to = flow[order, 1].tolist()
    first = np.searchsorted(flow[order, 0], np.arange(n + 1)).tolist()
    for var, blocks in enumerate(defs):
        kill = bytearray(n)
        for at in blocks if var < len(defs) - 1 else ():
            kill[at] = 1
        source, reached = [], []
        for at in blocks:
            seen, todo = set(), to[first[at] : first[at + 1]]
            while todo:
                x = todo.pop()
                if x not in seen:
                    seen.add(x)
                    if not kill[x]:
                        todo.extend(to[first[x] : first[x + 1]])
            source += [at] * len(seen)
            reached += seen
            if len(source) > 1 << 18:
                yield var, np.array(source), np.array(reached)
                source, reached = [], []
        if source:
            yield var, np.array(source), np.array(reached)


def _reach_function(key: tuple[pa.Scalar, ...], batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    t = pa.Table.from_batches(list(batches))
    edge, a, b, var = (t.column(c).to_numpy() for c in ("edge", "a", "b", "var"))
    edge = edge.astype(bool)
    blocks, code = np.unique(np.concatenate((a, b[edge])).astype(np.int64), return_inverse=True)
    at, to = code[: len(a)], code[len(a) :]
    names = sorted({v for v in var[~edge] if v is not None}) + [None]
    own = [np.unique(at[~edge & (var == v)]).tolist() for v in names]
    for i, source, reached in _reach(own, np.unique(np.stack((at[edge], to), axis=1), axis=0), len(blocks)):
        n = len(source)
        cols = [pa.array([key[0].as_py()] * n, key[0].type), pa.array([names[i]] * n, pa.string()), pa.array(blocks[source]), pa.array(blocks[reached])]
        yield pa.RecordBatch.from_arrays(cols, ["func", "var", "def_block", "block"])


def reaching_definitions(defs: DataFrame, flow: DataFrame) -> DataFrame:
    """defs(func, block, var) and flow(func, a, b): (func, var, def_block, block) where a definition reaches the
    entry of a block. A block that defines the variable itself lets none through. Functions are independent, so
    each is solved in one task by walks from its definitions: a task holds the blocks of one function, and hands
    its results on in pieces."""
    key, none = F.col("func"), F.lit(None)
    d = defs.select(key, F.lit(False).alias("edge"), F.col("block").cast("long").alias("a"), none.cast("long").alias("b"), F.col("var").cast("string").alias("var"))
    f = flow.select(key, F.lit(True).alias("edge"), F.col("a").cast("long").alias("a"), F.col("b").cast("long").alias("b"), none.cast("string").alias("var"))
    every = d.unionByName(f.where("b is not null")).where("func is not null and a is not null")
    return every.groupBy("func").applyInArrow(_reach_function, f"func {dict(every.dtypes)['func']}, var string, def_block long, block long")


def def_use(defs: DataFrame, uses: DataFrame, flow: DataFrame) -> DataFrame:
    """(func, var, def_block, use_block): the definitions that each use(func, block, var) may see."""
    reach = reaching_definitions(defs, flow)
    return uses.select("func", "block", "var").distinct().join(reach, ["func", "block", "var"]).select("func", "var", "def_block", F.col("block").alias("use_block"))


def refine_hops(hops: DataFrame, chains: DataFrame) -> DataFrame:
    """hops(func, var, def_block, use_block, score): confirmed where a def-use chain backs them, else pruned at
    a quarter of the score."""
    key = ["func", "var", "def_block", "use_block"]
    met = hops.join(chains.select(*key).distinct().withColumn("ok", F.lit(True)), key, "left")
    return met.select(*key, F.when(F.col("ok"), "confirmed").otherwise("pruned").alias("state"), (F.col("score") * F.when(F.col("ok"), 1.0).otherwise(0.25)).alias("score"))
