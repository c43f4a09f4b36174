"""One-pass aggregates over nodes(id, kind, file_path, ...) and edges(src, dst, kind, weight)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from graphloom.sources.scratch import lean, pieces, store


def package(path: Column, depth: int = 1) -> Column:
    """First `depth` directories of a path."""
    return F.array_join(F.slice(F.split(path, "/"), 1, depth), "/")


def degrees(nodes: DataFrame, edges: DataFrame, kinds: list[str] | None = None) -> DataFrame:
    """id, kind, fan_in, fan_out; every edge row counts. Both ends are counted in one shuffle, in pieces that do not grow
    with the graph; so are nodes and counts joined."""
    e = edges.where(F.col("kind").isin(kinds)) if kinds else edges
    ends = e.select(F.explode(F.array(F.struct(F.col("src").alias("id"), F.lit(0).alias("i"), F.lit(1).alias("o")), F.struct(F.col("dst").alias("id"), F.lit(1).alias("i"), F.lit(0).alias("o")))).alias("x"))
    rows = 2 * e.count()
    with lean(e.sparkSession, rows):
        counts = store(ends.groupBy("x.id").agg(F.sum("x.i").alias("fan_in"), F.sum("x.o").alias("fan_out")), "degrees")
    zero, n = F.lit(0).cast("long"), pieces(max(rows, nodes.count()))
    return nodes.select("id", "kind").repartition(n, "id").join(counts.repartition(n, "id"), "id", "left").select("id", "kind", F.coalesce("fan_in", zero).alias("fan_in"), F.coalesce("fan_out", zero).alias("fan_out"))


def kind_histogram(edges: DataFrame, rare_percent: float = 5.0) -> DataFrame:
    """kind, edges, share (percent) and whether the kind is rare."""
    by_kind = edges.groupBy("kind").agg(F.count(F.lit(1)).alias("n"))
    share = 100 * F.col("n") / F.sum("n").over(Window.partitionBy(F.lit(1)))  # one row for each kind
    return by_kind.select("kind", "n", F.round(share, 6).alias("share"), (share <= rare_percent).alias("rare"))


def coupling(nodes: DataFrame, edges: DataFrame, depth: int = 1) -> DataFrame:
    """Per unit: members, afferent and efferent distinct units, instability, internal and total edges."""
    unit = nodes.select("id", package(F.col("file_path"), depth).alias("unit"))
    e = edges.join(unit.withColumnsRenamed({"id": "src", "unit": "u"}), "src").join(unit.withColumnsRenamed({"id": "dst", "unit": "v"}), "dst")
    pairs = e.groupBy("u", "v").agg(F.count(F.lit(1)).alias("n"))
    out = pairs.groupBy(F.col("u").alias("unit")).agg(F.count_if(F.col("u") != F.col("v")).alias("ce"), F.sum(F.when(F.col("u") == F.col("v"), F.col("n")).otherwise(0)).alias("internal"), F.sum("n").alias("out_edges"))
    into = pairs.where("u <> v").groupBy(F.col("v").alias("unit")).agg(F.count(F.lit(1)).alias("ca"))
    members = unit.groupBy("unit").agg(F.count(F.lit(1)).alias("members"))
    zero = F.lit(0).cast("long")
    full = members.join(out, "unit", "left").join(into, "unit", "left").fillna(0, ["ce", "internal", "out_edges", "ca"])
    both = F.col("ca") + F.col("ce")
    return full.select("unit", "members", F.coalesce("ca", zero).alias("ca"), F.coalesce("ce", zero).alias("ce"), F.round(F.when(both > 0, F.col("ce") / both).otherwise(0.0), 6).alias("instability"), "internal", "out_edges")


def connectivity(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """Per kind: nodes, isolated, leaves, sources only, sinks only, effective (not isolated)."""
    d = degrees(nodes, edges)
    i, o = F.col("fan_in"), F.col("fan_out")
    return d.groupBy("kind").agg(
        F.count(F.lit(1)).alias("nominal"), F.count_if(i + o == 0).alias("isolated"), F.count_if(i + o == 1).alias("leaf"),
        F.count_if((i == 0) & (o > 0)).alias("source_only"), F.count_if((i > 0) & (o == 0)).alias("sink_only"), F.count_if(i + o > 0).alias("effective"),
    )


def hierarchy(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """Edges rolled up at three levels at once: package (first directory), kind and system."""
    side = nodes.select("id", package(F.col("file_path")).alias("p"), F.col("kind").alias("k"))
    e = edges.select("src", "dst").join(side.select(F.col("id").alias("src"), F.col("p").alias("p1"), F.col("k").alias("k1")), "src").join(side.select(F.col("id").alias("dst"), F.col("p").alias("p2"), F.col("k").alias("k2")), "dst")
    base = e.groupBy("p1", "p2", "k1", "k2").agg(F.count(F.lit(1)).alias("n"))
    level = F.explode(F.array(
        F.struct(F.lit("package").alias("level"), F.col("p1").alias("g1"), F.col("p2").alias("g2")),
        F.struct(F.lit("kind").alias("level"), F.col("k1").alias("g1"), F.col("k2").alias("g2")),
        F.struct(F.lit("system").alias("level"), F.lit("all").alias("g1"), F.lit("all").alias("g2")),
    ))
    return base.select(level.alias("x"), "n").groupBy("x.level", F.col("x.g1").alias("group_from"), F.col("x.g2").alias("group_to")).agg(F.sum("n").alias("edges")).withColumn("self_loop", F.col("group_from") == F.col("group_to"))


def roles(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """The role ladder: dead, entry, leaf, adapter, utility, core, the first that fits."""
    d = degrees(nodes, edges).join(nodes.select("id", "size"), "id")
    i, o = F.col("fan_in"), F.col("fan_out")
    role = (
        F.when((i == 0) & (o == 0), "dead").when(i == 0, "entry").when(o == 0, "leaf").when((i == 1) & (o == 1), "adapter")
        .when((i >= 3) & (o <= 2) & (F.col("size") <= 30), "utility").otherwise("core")
    )
    return d.select("id", "kind", role.alias("role"))


def surprising_edges(nodes: DataFrame, edges: DataFrame, hub: int = 20, min_score: float = 0.3) -> DataFrame:
    """Edges scored .30 across communities (first directory), .20 across languages (kind), .20 from a
    quiet node to a hub, .15 across repositories, .15 for a rare edge kind."""
    n = nodes.select("id", package(F.col("file_path")).alias("c"), F.col("kind").alias("l"), F.col("repo_prefix").alias("r"))
    d = degrees(nodes, edges).select("id", "fan_in")
    side = n.join(d, "id")
    rare = kind_histogram(edges).select("kind", "rare")
    e = edges.select("src", "dst", "kind").join(F.broadcast(rare), "kind")  # one row for each edge kind
    e = e.join(side.select(*[F.col(c).alias(f"{c}1") for c in side.columns]).withColumnRenamed("id1", "src"), "src")
    e = e.join(side.select(*[F.col(c).alias(f"{c}2") for c in side.columns]).withColumnRenamed("id2", "dst"), "dst")
    points = lambda cond, w: F.when(cond, w).otherwise(0)
    score = (
        points(F.col("c1") != F.col("c2"), 30) + points(F.col("l1") != F.col("l2"), 20) + points((F.col("fan_in1") <= 2) & (F.col("fan_in2") >= hub), 20)
        + points(F.col("r1") != F.col("r2"), 15) + points(F.col("rare"), 15)
    )
    return e.select("src", "dst", "kind", (score / 100).alias("score")).where(F.col("score") >= min_score)


def knowledge_gaps(nodes: DataFrame, edges: DataFrame, thin: int = 3) -> DataFrame:
    """disconnected nodes, and thin packages with at most `thin` members."""
    d = degrees(nodes, edges).where("fan_in + fan_out = 0").select(F.lit("disconnected").alias("gap"), F.col("id").alias("subject"), F.lit(1).cast("long").alias("n"))
    small = nodes.groupBy(F.col("file_path").alias("subject")).agg(F.count(F.lit(1)).alias("n")).where(F.col("n") <= thin).select(F.lit("thin").alias("gap"), "subject", "n")
    return d.unionByName(small)


def cross_repo(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """Edges between different, non-empty repositories, by pair and kind."""
    n = nodes.select("id", "repo_prefix")
    e = edges.join(n.select(F.col("id").alias("src"), F.col("repo_prefix").alias("repo_a")), "src").join(n.select(F.col("id").alias("dst"), F.col("repo_prefix").alias("repo_b")), "dst")
    return e.where("repo_a <> repo_b").groupBy("repo_a", "repo_b", "kind").agg(F.count(F.lit(1)).alias("n"))


def bounded_adjacency(edges: DataFrame, most: int) -> DataFrame:
    """At most `most` out-edges of each node in order of dst, and whether more exist."""
    w = Window.partitionBy("src").orderBy("dst", "kind")
    few = edges.withColumn("rn", F.row_number().over(w)).where(F.col("rn") <= most + 1)
    cut = F.max("rn").over(Window.partitionBy("src")) > most
    return few.withColumn("truncated", cut).where(F.col("rn") <= most).select("src", "dst", "kind", "rn", "truncated")


def entry_scores(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """Entry-point score callees / (callers + 1), times 2 without callers and 1.3 with two at most; above .5."""
    d = degrees(nodes, edges)
    i, o = F.col("fan_in"), F.col("fan_out")
    score = o / (i + 1) * F.when(i == 0, 2.0).when(i <= 2, 1.3).otherwise(1.0)
    return d.where("fan_out > 0").select("id", F.round(score, 6).alias("score")).where("score > 0.5")


def layer_violations(nodes: DataFrame, edges: DataFrame, allowed: dict[str, list[str]]) -> DataFrame:
    """Edges whose kinds of ends the allow-list of layers does not have."""
    n = nodes.select("id", "kind")
    e = edges.select("src", "dst", F.col("kind").alias("edge_kind")).join(n.select(F.col("id").alias("src"), F.col("kind").alias("layer_from")), "src").join(n.select(F.col("id").alias("dst"), F.col("kind").alias("layer_to")), "dst")
    ok = F.lit(False)
    for a, bs in allowed.items():
        ok = ok | ((F.col("layer_from") == a) & F.col("layer_to").isin(bs))
    return e.where(~ok & (F.col("layer_from") != F.col("layer_to"))).groupBy("layer_from", "layer_to", "edge_kind").agg(F.count(F.lit(1)).alias("violations"))


def fan_out_cap(edges: DataFrame, kind: str, most: int) -> DataFrame:
    return edges.where(F.col("kind") == kind).groupBy("src").agg(F.countDistinct("dst").alias("targets")).where(F.col("targets") > most)


def modularity(edges: DataFrame, membership: DataFrame, gamma: float = 1.0) -> DataFrame:
    """Q = sum over communities of inside / m - gamma (degree / 2m)**2, of the undirected graph."""
    e = edges.select("src", "dst", F.col("weight").cast("double").alias("w"))
    m1 = membership.select(F.col("id").alias("src"), F.col("community").alias("c1"))
    m2 = membership.select(F.col("id").alias("dst"), F.col("community").alias("c2"))
    j = e.join(m1, "src").join(m2, "dst")
    ends = j.select(F.explode(F.array(F.struct(F.col("c1").alias("c"), F.col("w"), F.when(F.col("c1") == F.col("c2"), F.col("w")).otherwise(0.0).alias("inside")), F.struct(F.col("c2").alias("c"), F.col("w"), F.lit(0.0).alias("inside")))).alias("x"))
    by = store(ends.groupBy("x.c").agg(F.sum("x.w").alias("k"), F.sum("x.inside").alias("inside")), "modularity")
    by = by.crossJoin(F.broadcast(by.agg(F.sum("k").alias("two_m"))))  # one row
    two_m = F.col("two_m")
    return by.select((F.col("inside") / (two_m / 2) - gamma * F.pow(F.col("k") / two_m, 2)).alias("q")).agg(F.round(F.sum("q"), 6).alias("modularity"))
