"""Traversals: semi-naive loops of joins over edges(src, dst, kind).

Each hop joins the frontier to the edges, drops what was visited by an anti-join, and writes the new
frontier to the shared scratch folder, so plans stay short and a lost executor costs one hop.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from graphloom.sources.scratch import lean, pieces, small, store

#: Targets in one array of the last hop, and found rows in one task: pairs, or paths, which are longer and sorted.
ARRAY, FOUND, FOUND_PATHS = 1024, 1_000_000, 300_000


def oriented(edges: DataFrame, direction: str = "out") -> DataFrame:
    """Edges as (a, b, kind) in the direction of travel."""
    out = edges.select(F.col("src").alias("a"), F.col("dst").alias("b"), "kind")
    if direction == "out":
        return out
    into = edges.select(F.col("dst").alias("a"), F.col("src").alias("b"), "kind")
    return into if direction == "in" else out.unionByName(into)


def bfs(seeds: DataFrame, edges: DataFrame, depth: int, direction: str = "out", kinds: list[str] | None = None) -> DataFrame:
    """(node_id, depth, parent_id, edge_kind): each node at its least depth, discovered by the
    smallest (parent, kind); seeds at depth 0."""
    e = store(oriented(edges.where(F.col("kind").isin(kinds)) if kinds else edges, direction), "bfs-edges")
    none = F.lit(None).cast("string")
    seen = store(seeds.select(F.col("id").alias("node_id"), F.lit(0).alias("depth"), none.alias("parent_id"), none.alias("edge_kind")).distinct(), "bfs")
    front = seen
    for hop in range(1, depth + 1):
        met = front.select(F.col("node_id").alias("a")).join(e, "a").join(seen.select(F.col("node_id").alias("b")), "b", "left_anti")
        first = met.groupBy("b").agg(F.min(F.struct("a", "kind")).alias("by"))
        front = store(first.select(F.col("b").alias("node_id"), F.lit(hop).alias("depth"), F.col("by.a").alias("parent_id"), F.col("by.kind").alias("edge_kind")), "bfs")
        if front.isEmpty():
            break
        seen = seen.unionByName(front)
    return seen


def reach_tiers(edges: DataFrame, kinds: list[str], depth: int = 3) -> DataFrame:
    """For every node its callers by tier: (node, caller, tier), the tiers disjoint, self left out."""
    e = edges.where(F.col("kind").isin(kinds)).select(F.col("dst").alias("node"), F.col("src").alias("caller")).where("node <> caller").distinct()
    step = e.select(F.col("node").alias("caller"), F.col("caller").alias("next"))
    found = store(e.withColumn("tier", F.lit(1)), "reach")
    front = found
    for tier in range(2, depth + 1):
        met = front.select("node", "caller").join(step, "caller").select("node", F.col("next").alias("caller")).where("node <> caller").distinct()
        front = store(met.join(found.select("node", "caller"), ["node", "caller"], "left_anti").withColumn("tier", F.lit(tier)), "reach")
        found = found.unionByName(front)
    return found


def paths(seeds: DataFrame, edges: DataFrame, depth: int, direction: str = "out", kinds: list[str] | None = None, most: int | None = None) -> DataFrame:
    """Simple paths from the seeds: (start, node_id, depth, path, kinds). most: of the paths of one length
    from a start to a node only so many go on, the first by path; on acyclic edges no shorter or earlier
    path is lost to that."""
    e = oriented(edges.where(F.col("kind").isin(kinds)) if kinds else edges, direction)
    front = seeds.select(F.col("id").alias("start"), F.col("id").alias("node_id"), F.lit(0).alias("depth"), F.array("id").alias("path"), F.array().cast("array<string>").alias("kinds"))
    out = front
    for hop in range(1, depth + 1):
        met = front.join(e, F.col("node_id") == F.col("a")).where(~F.array_contains("path", F.col("b")))
        met = met.select("start", F.col("b").alias("node_id"), F.lit(hop).alias("depth"), F.array_append("path", F.col("b")).alias("path"), F.array_append("kinds", F.col("kind")).alias("kinds"))
        if most:
            met = met.withColumn("rn", F.row_number().over(Window.partitionBy("start", "node_id").orderBy(F.array_join("path", ">")))).where(F.col("rn") <= most).drop("rn")
        front = store(met, "paths")
        out = out.unionByName(front)
    return out


class LastHop:
    """The last hop of a search from many starts for targets(id). A start and a target that meet are a row of the
    result, and there may be far more of these than edges, so they are neither stored nor moved: what moves is each
    node of the frontier with an array of the targets after it, by number, to where its start is dealt; a start's
    rows are first formed there. names: (id, no) of the targets."""

    def __init__(self, edges: DataFrame, targets: DataFrame) -> None:
        spark, rows = edges.sparkSession, edges.count()
        with lean(spark, rows):
            ids = store(targets.select("id").distinct().withColumn("at", F.monotonically_increasing_id()), "targets")
            part = F.shiftright("at", 33)
            sizes = {r.p: r.n for r in ids.groupBy(part.alias("p")).agg(F.count(F.lit(1)).alias("n")).collect()}  # a row a partition
            first, total = [], 0
            for p in sorted(sizes):
                first.append((p, total))
                total += sizes[p]
            starts = F.broadcast(spark.createDataFrame(first, "p long, first long"))
            no = (F.col("first") + F.col("at").bitwiseAND(2**33 - 1)).cast("int" if total < 2**31 else "long")
            self.names = store(ids.join(starts, part == F.col("p")).select("id", no.alias("no")), "targets")
            into = store(edges.select("a", "b").join(small(self.names.withColumnRenamed("id", "b")), "b").select("a", "no"), "into")
            big = into.groupBy("a").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") > ARRAY)
            big = small(store(big.select("a", F.ceil(F.col("n") / ARRAY).alias("arrays")), "into"))
            dealt = into.join(big, "a", "left").withColumn("k", F.coalesce(F.pmod(F.xxhash64("no"), "arrays"), F.lit(0)))
            self.lists = store(dealt.groupBy("a", "k").agg(F.collect_set("no").alias("nos")).select("a", "nos"), "lists")

    def found(self, front: DataFrame, at: str, earlier: DataFrame, by: str, most: int = FOUND) -> DataFrame:
        """front with its node `at` replaced by no, the number of a target one hop after it, and the rows of earlier(..., no),
        dealt out by the column `by` in pieces of about `most` rows."""
        met = front.groupBy(F.col(at).alias("a")).agg(F.count(F.lit(1)).alias("m")).join(self.lists.select("a", F.size("nos").alias("n")), "a")
        n = pieces((met.agg(F.sum(F.col("m") * F.col("n"))).first()[0] or 0) + earlier.count(), most)
        late = front.withColumnRenamed(at, "a").join(self.lists, "a").drop("a")
        moved = late.unionByName(earlier.withColumn("no", F.array("no")).withColumnRenamed("no", "nos")).repartition(n, by)
        return moved.select(*[c for c in moved.columns if c != "nos"], F.explode("nos").alias("no"))

    def named(self, df: DataFrame, name: str) -> DataFrame:
        """df(no, ...) with the target's id as `name`. The names of up to a million targets are broadcast."""
        return df.join(small(self.names.withColumnRenamed("id", name), 1_000_000), "no")


def shortest_paths(seeds: DataFrame, targets: DataFrame, edges: DataFrame, depth: int, k: int = 3, direction: str = "out") -> DataFrame:
    """The k first paths of each (start, target) by length, then by path. The frontier is bounded by k for
    each (start, node), so paths are not enumerated; the paths' last hop is formed start by start (LastHop)."""
    e = oriented(edges, direction).select("a", "b")
    last = LastHop(e, targets)
    front = store(seeds.select(F.col("id").alias("start"), F.col("id").alias("node_id"), F.array("id").alias("path")).distinct(), "paths")
    earlier = front.select("start", "path", F.lit(0).alias("depth")).withColumn("no", F.lit(0)).limit(0)
    for hop in range(1, depth):
        met = front.join(e, F.col("node_id") == F.col("a")).where(~F.array_contains("path", F.col("b")))
        met = met.select("start", F.col("b").alias("node_id"), F.array_append("path", F.col("b")).alias("path")).distinct()
        ranked = met.withColumn("rn", F.row_number().over(Window.partitionBy("start", "node_id").orderBy(F.array_join("path", ">"))))
        front = store(ranked.where(F.col("rn") <= k).drop("rn"), "paths")
        there = front.join(small(last.names.withColumnRenamed("id", "node_id"), 1_000_000), "node_id")
        earlier = earlier.unionByName(there.select("start", F.slice("path", 1, hop).alias("path"), F.lit(hop).alias("depth"), "no"))
    met = last.found(front.withColumn("depth", F.lit(depth)), "node_id", earlier, "start", FOUND_PATHS)
    met = last.named(met, "node_id").where(~F.array_contains("path", F.col("node_id")))
    met = met.select("start", "node_id", "no", "depth", F.concat(F.array_join("path", ">"), F.lit(">"), F.col("node_id")).alias("path"))
    w = Window.partitionBy("start", "no").orderBy("depth", "path")
    return met.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= k).select("start", "node_id", "rank", "depth", "path")


def would_cycle(pairs: DataFrame, edges: DataFrame, depth: int, kinds: list[str] | None = None) -> DataFrame:
    """pairs(src, dst): whether a new edge src -> dst would close a cycle, that is dst reaches src."""
    e = oriented(edges.where(F.col("kind").isin(kinds)) if kinds else edges)
    seen = store(pairs.select("src", "dst", F.col("dst").alias("at")).distinct(), "cycle")
    front = seen
    for _ in range(depth):
        met = front.join(e, F.col("at") == F.col("a")).select("src", "dst", F.col("b").alias("at")).distinct()
        front = store(met.join(seen, ["src", "dst", "at"], "left_anti"), "cycle")
        if front.isEmpty():
            break
        seen = seen.unionByName(front)
    return seen.groupBy("src", "dst").agg(F.max(F.col("at") == F.col("src")).alias("cycle"))


def budgeted_walk(seeds: DataFrame, edges: DataFrame, depth: int, budget_tokens: int, direction: str = "out") -> DataFrame:
    """BFS whose nodes, in order of (depth, id), are kept while they fit a budget of 8 tokens each. Deeper nodes come
    after all nearer ones, so the walk ends at the depth that spends the budget; parents are not looked for."""
    most = budget_tokens // 8
    e = oriented(edges, direction).select("a", "b")
    seen = front = store(seeds.select(F.col("id").alias("node_id"), F.lit(0).alias("depth")).distinct(), "walk")
    for hop in range(1, depth + 1):
        if seen.count() >= most:
            break
        met = front.select(F.col("node_id").alias("a")).join(e, "a").select(F.col("b").alias("node_id")).distinct()
        front = store(met.join(seen.select("node_id"), "node_id", "left_anti").withColumn("depth", F.lit(hop)), "walk")
        if front.isEmpty():
            break
        seen = seen.unionByName(front)
    return seen.orderBy("depth", "node_id").limit(most)


def expand_once(frontier: DataFrame, edges: DataFrame, nodes: DataFrame, direction: str = "out") -> DataFrame:
    """Neighbours of the frontier that exist as nodes."""
    e = oriented(edges, direction)
    return frontier.select(F.col("id").alias("a")).join(e, "a").join(nodes.select(F.col("id").alias("b"), F.col("kind").alias("node_kind")), "b").select(F.col("a").alias("from_id"), F.col("b").alias("to_id"), "kind", "node_kind")
