"""Rule families, audits and risk ladders over nodes and edges."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from graphloom.operators.graph_stats import degrees, package
from graphloom.operators.traverse import LastHop


def boundary_guard(nodes: DataFrame, edges: DataFrame, changed: DataFrame, source: str, target: str) -> DataFrame:
    """Edges from changed nodes under one package into another."""
    a = nodes.where(package(F.col("file_path")) == source).join(changed.select("id"), "id", "left_semi").select(F.col("id").alias("src"))
    b = nodes.where(package(F.col("file_path")) == target).select(F.col("id").alias("dst"))
    return edges.join(a, "src", "left_semi").join(b, "dst", "left_semi").select("src", "dst", "kind")


def co_change_guard(touched: DataFrame, source: str, target: str) -> DataFrame:
    """touched(commit, package): commits that touch source and not target."""
    by = touched.groupBy("commit").agg(F.max(F.col("package") == source).alias("s"), F.max(F.col("package") == target).alias("t"))
    return by.where("s and not t").select("commit")


def dead_code(nodes: DataFrame, edges: DataFrame, exempt: list[str]) -> DataFrame:
    """Nodes without incoming use, outside the exempt kinds."""
    return nodes.where(~F.col("kind").isin(exempt)).join(edges.select(F.col("dst").alias("id")).distinct(), "id", "left_anti").select("id", "kind")


def hotspots(nodes: DataFrame, edges: DataFrame, churn: DataFrame, top: int) -> DataFrame:
    """churn(id, commits): half normalized fan-in, half normalized commits (log1p / log1p of the top)."""
    d = degrees(nodes, edges).join(churn, "id")
    top_in = d.agg(F.max("fan_in").alias("mi"), F.max("commits").alias("mc"))
    part = lambda c, m: F.when(F.col(m) > 0, F.log1p(F.col(c)) / F.log1p(F.col(m))).otherwise(0.0)
    scored = d.crossJoin(F.broadcast(top_in)).select("id", F.round(0.5 * part("fan_in", "mi") + 0.5 * part("commits", "mc"), 6).alias("score"))  # one row
    return scored.orderBy(F.desc("score"), "id").limit(top)


def change_risk(changes: DataFrame) -> DataFrame:
    """changes(change, callers, packages, lines): additive points and a level."""
    points = (
        F.when(F.col("callers") >= 50, 3).when(F.col("callers") >= 10, 2).when(F.col("callers") > 0, 1).otherwise(0)
        + F.when(F.col("packages") >= 4, 3).when(F.col("packages") >= 2, 1).otherwise(0) + F.when(F.col("lines") >= 200, 2).when(F.col("lines") >= 50, 1).otherwise(0)
    )
    level = F.when(points >= 7, "CRITICAL").when(points >= 5, "HIGH").when(points >= 3, "MEDIUM").otherwise("LOW")
    return changes.select("change", points.alias("points"), level.alias("level"))


def resolution_outcomes(uses: DataFrame, names: DataFrame) -> DataFrame:
    """uses(name, lang), names(name, lang): none, cross-language only, one candidate or ambiguous."""
    by = names.groupBy("name", "lang").agg(F.count(F.lit(1)).alias("n"))
    own = by.withColumnRenamed("n", "same")
    other = by.groupBy("name").agg(F.sum("n").alias("all"))
    met = uses.groupBy("name", "lang").agg(F.count(F.lit(1)).alias("uses")).join(own, ["name", "lang"], "left").join(other, "name", "left")
    what = F.when(F.col("same") >= 2, "ambiguous_multi_match").when(F.col("same") == 1, "candidate_out_of_scope").when(F.col("all") > 0, "cross_language_only").otherwise("no_definition")
    return met.groupBy(what.alias("outcome")).agg(F.sum("uses").alias("uses"), F.count(F.lit(1)).alias("names"))


def edge_audit(edges: DataFrame, tiers: dict[str, str]) -> DataFrame:
    """Edges by provenance tier, the tier of a kind given: edges, weight, share of edges."""
    tier = F.lit("unknown")
    for kind, name in tiers.items():
        tier = F.when(F.col("kind") == kind, name).otherwise(tier)
    by = edges.groupBy(tier.alias("tier")).agg(F.count(F.lit(1)).alias("edges"), F.sum("weight").alias("weight"))
    return by.withColumn("share", F.round(F.col("edges") / F.sum("edges").over(Window.partitionBy(F.lit(1))), 6))  # one row a tier


def taint(edges: DataFrame, sources: DataFrame, sinks: DataFrame, depth: int) -> DataFrame:
    """Shortest flow of each (source, sink) within depth hops, a semi-naive join by source. The pairs of the last hop
    are formed source by source, neither stored nor moved (LastHop)."""
    from graphloom.sources.scratch import small, store

    e = edges.select(F.col("src").alias("a"), F.col("dst").alias("b"))
    last = LastHop(e, sinks)
    seen = front = store(sources.select(F.col("id").alias("source"), F.col("id").alias("at"), F.lit(0).alias("hops")).distinct(), "taint")
    for hop in range(1, depth):
        met = front.select("source", F.col("at").alias("a")).join(e, "a").select("source", F.col("b").alias("at")).distinct()
        front = store(met.join(seen.select("source", "at"), ["source", "at"], "left_anti").withColumn("hops", F.lit(hop)), "taint")
        seen = seen.unionByName(front)
    earlier = seen.where("hops > 0").join(small(last.names.withColumnRenamed("id", "at"), 1_000_000), "at").select("source", "hops", "no")
    met = last.found(front.select("source", "at").withColumn("hops", F.lit(depth)), "at", earlier, "source")
    first = met.groupBy("source", "no").agg(F.min("hops").alias("hops"))
    return last.named(first, "sink").where("source <> sink").select("source", "sink", "hops")


def loop_depth(own: DataFrame, calls: DataFrame, most: int = 32) -> DataFrame:
    """own(id, loops), calls(src, dst): loops of a node plus the deepest of what it calls; a cycle
    stops at `most` hops. Longest paths by repeated maximum."""
    from graphloom.sources.scratch import store

    depth = store(own.select("id", F.col("loops").alias("base"), F.col("loops").alias("total")), "loops")
    for _ in range(most):
        below = calls.join(depth.select(F.col("id").alias("dst"), "total"), "dst").groupBy(F.col("src").alias("id")).agg(F.max("total").alias("below"))
        new = store(depth.join(below, "id", "left").select("id", "base", (F.col("base") + F.coalesce("below", F.lit(0))).alias("total"), (F.col("base") + F.coalesce("below", F.lit(0)) != F.col("total")).alias("moved")), "loops")
        depth = new.select("id", "base", "total")
        if new.where("moved").isEmpty():
            break
    return depth.select("id", F.col("total").alias("loop_depth"))


def rank_reset(results: DataFrame) -> DataFrame:
    """results(key, repo, rank): ranks renumbered from 0 in each repository, ties by key."""
    return results.withColumn("repo_rank", F.row_number().over(Window.partitionBy("repo").orderBy("rank", "key")) - 1)


# A path's tier by what it is: test code, compatibility code, examples, type declarations and
# re-exports, module entries.
PENALTIES = [
    (r"(^|/)(test|tests|__tests__|spec)/|(_test\.[a-z]+|\.test\.[a-z]+|(^|/)spec\.[a-z]+)$", 0.3),
    (r"(^|/)(compat|vendor|legacy)(/|$)", 0.5),
    (r"(^|/)(examples?|docs?)(/|$)", 0.5),
    (r"\.d\.ts$|(^|/)reexports(/|$)", 0.7),
    (r"(^|/)(index\.(ts|js)|__init__\.py)$", 0.9),
]


def path_penalty(path):
    """The smallest tier that a path falls under, 1 under none."""
    return F.least(F.lit(1.0), *[F.when(path.rlike(p), w).otherwise(1.0) for p, w in PENALTIES])
