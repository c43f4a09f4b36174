"""Scans, filters, the pipeline language, exports and set operations over nodes and edges."""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from graphloom.functions.text import under
from graphloom.operators.traverse import oriented

_CLAUSE = re.compile(r"^(kind|path|lang)=(\S+)$|^name~(\S+)$")


def clause(text: str) -> Column:
    """kind= exact, name~ a pattern, path= a prefix, lang= in any case (our kind stands in)."""
    m = _CLAUSE.match(text)
    if not m:
        raise ValueError(f"not a filter: {text!r}")
    if m[3]:
        return F.col("name").rlike(m[3])
    if m[1] == "kind":
        return F.col("kind") == m[2]
    if m[1] == "path":
        return F.col("file_path").startswith(m[2])
    return F.lower("kind") == m[2].lower()


def run_pipeline(nodes: DataFrame, edges: DataFrame, text: str, limit: int = 100) -> DataFrame:
    """`nodes F* | traverse KINDS DIR | filter F+`, five stages at most; the working set is cut to
    `limit` in order of id after each."""
    stages = [x.split() for x in text.split("|")]
    if len(stages) > 5 or not stages[0] or stages[0][0] != "nodes" or any(not s or s[0] == "nodes" for s in stages[1:]):
        raise ValueError("a pipeline is `nodes ...` and at most four of traverse and filter")
    work = nodes
    for c in stages[0][1:]:
        work = work.where(clause(c))
    work = work.orderBy("id").limit(limit)
    for stage in stages[1:]:
        if stage[0] == "traverse":
            e = oriented(edges.where(F.col("kind").isin(stage[1].split(","))), stage[2] if len(stage) > 2 else "out")
            hit = e.join(work.select(F.col("id").alias("a")), "a", "left_semi").select(F.col("b").alias("id")).distinct()
            work = nodes.join(hit, "id", "left_semi")
        elif stage[0] == "filter":
            for c in stage[1:]:
                work = work.where(clause(c))
        else:
            raise ValueError(f"no stage {stage[0]!r}")
        work = work.orderBy("id").limit(limit)
    return work


# Prefixes of a field query.
FIELDS = ("kind", "lang", "language", "path", "repo", "name")


def field_query(nodes: DataFrame, text: str) -> DataFrame:
    """`kind: lang: path: repo: name:` lifted out of a query, the last of each wins; path and name are
    substrings in any case, repo is exact but nodes without one pass, * is no filter."""
    said = {}
    for word in text.split():
        key, _, value = word.partition(":")
        if key in FIELDS and value:
            said["lang" if key == "language" else key] = value
    out = nodes
    for key, value in said.items():
        if value == "*":
            continue
        if key in ("kind", "lang"):
            out = out.where(F.lower("kind") == value.lower())
        elif key == "repo":
            out = out.where((F.col("repo_prefix") == value) | (F.col("repo_prefix") == ""))
        else:
            out = out.where(F.lower("file_path" if key == "path" else "name").contains(value.lower()))
    return out


def winnow(nodes: DataFrame, edges: DataFrame, kinds: list[str], path_prefix: str, min_fan_in: int, min_fan_out: int) -> DataFrame:
    """A chain of constraints, with the degrees joined only for the nodes that the cheap ones leave."""
    some = nodes.where(F.col("kind").isin(kinds) & F.col("file_path").startswith(path_prefix))
    i = edges.groupBy(F.col("dst").alias("id")).agg(F.count(F.lit(1)).alias("fan_in"))
    o = edges.groupBy(F.col("src").alias("id")).agg(F.count(F.lit(1)).alias("fan_out"))
    full = some.join(i, "id", "left").join(o, "id", "left").fillna(0, ["fan_in", "fan_out"])
    return full.where((F.col("fan_in") >= min_fan_in) & (F.col("fan_out") >= min_fan_out)).select("id", "kind", "fan_in", "fan_out")


def anchored(nodes: DataFrame, prefix: str) -> DataFrame:
    return nodes.where(under(F.col("file_path"), prefix)).select("id", "file_path")


def file_subgraph(nodes: DataFrame, edges: DataFrame, path: str) -> DataFrame:
    """Edges with an end in one file, once each."""
    own = nodes.where(F.col("file_path") == path).select("id")
    out = edges.join(own.withColumnRenamed("id", "src"), "src", "left_semi")
    into = edges.join(own.withColumnRenamed("id", "dst"), "dst", "left_semi")
    return out.select("src", "dst", "kind").unionByName(into.select("src", "dst", "kind")).distinct()


def page(rows: DataFrame, order: list[str], offset: int, size: int) -> DataFrame:
    """Rows offset+1 to offset+size of an order, with their place."""
    cut = rows.orderBy(*order).limit(offset + size)
    place = F.row_number().over(Window.orderBy(*order))  # offset + size rows
    return cut.withColumn("place", place).where(F.col("place") > offset)


def export_cypher(nodes: DataFrame, edges: DataFrame, kinds: list[str]) -> DataFrame:
    """Statements for the nodes of some kinds and the edges between them."""
    keep = nodes.where(F.col("kind").isin(kinds))
    quoted = F.concat(F.lit("'"), F.replace(F.replace("name", F.lit("\\"), F.lit("\\\\")), F.lit("'"), F.lit("\\'")), F.lit("'"))
    made = keep.select(F.concat(F.lit("CREATE (:"), "kind", F.lit(" {id: '"), "id", F.lit("', name: "), quoted, F.lit("})")).alias("line"))
    ids = keep.select("id")
    e = edges.join(ids.withColumnRenamed("id", "src"), "src", "left_semi").join(ids.withColumnRenamed("id", "dst"), "dst", "left_semi")
    linked = e.select(F.concat(F.lit("MATCH (a {id: '"), "src", F.lit("'}), (b {id: '"), "dst", F.lit("'}) CREATE (a)-[:"), F.upper("kind"), F.lit("]->(b)")).alias("line"))
    return made.unionByName(linked)


def export_graphml(nodes: DataFrame, edges: DataFrame, kinds: list[str]) -> DataFrame:
    """Elements of a GraphML file, without its frame."""
    escape = lambda c: F.replace(F.replace(F.replace(F.replace(c, F.lit("&"), F.lit("&amp;")), F.lit("<"), F.lit("&lt;")), F.lit(">"), F.lit("&gt;")), F.lit('"'), F.lit("&quot;"))
    keep = nodes.where(F.col("kind").isin(kinds))
    made = keep.select(F.concat(F.lit('<node id="'), escape(F.col("id")), F.lit('"><data key="name">'), escape(F.col("name")), F.lit("</data></node>")).alias("line"))
    ids = keep.select("id")
    e = edges.join(ids.withColumnRenamed("id", "src"), "src", "left_semi").join(ids.withColumnRenamed("id", "dst"), "dst", "left_semi")
    return made.unionByName(e.select(F.concat(F.lit('<edge source="'), escape(F.col("src")), F.lit('" target="'), escape(F.col("dst")), F.lit('" label="'), F.col("kind"), F.lit('"/>')).alias("line")))


def export_mermaid(edges: DataFrame, most: int) -> DataFrame:
    """The heaviest edges as flow-chart lines."""
    top = edges.orderBy(F.desc("weight"), "src", "dst", "kind").limit(most)
    name = lambda c: F.regexp_replace(c, "[^A-Za-z0-9]", "_")
    return top.select(F.concat(name("src"), F.lit(" -->|"), "kind", F.lit("| "), name("dst")).alias("line"))


def overlay(base: DataFrame, changed: DataFrame, key: str) -> DataFrame:
    """The base without the changed keys, and the changed rows."""
    return base.join(changed.select(key).distinct(), key, "left_anti").unionByName(changed)


def missing_fields(fields: DataFrame, used: DataFrame) -> DataFrame:
    """fields(owner, field) that no row of used(owner, field) names, gathered by owner."""
    return fields.join(used, ["owner", "field"], "left_anti").groupBy("owner").agg(F.array_join(F.sort_array(F.collect_set("field")), ",").alias("missing"))


def match_contracts(providers: DataFrame, consumers: DataFrame) -> DataFrame:
    """Providers and consumers of one (workspace, project, contract) pair; the rest are orphans."""
    key = ["workspace", "project", "contract"]
    met = providers.select(*key, F.col("id").alias("provider")).join(consumers.select(*key, F.col("id").alias("consumer")), key, "full_outer")
    role = F.when(F.col("provider").isNull(), "orphan_consumer").when(F.col("consumer").isNull(), "orphan_provider").otherwise("matched")
    return met.groupBy("workspace", role.alias("state")).agg(F.count(F.lit(1)).alias("n"))


def untested(nodes: DataFrame, reached: DataFrame, edges: DataFrame) -> DataFrame:
    """Nodes that no test reaches, by fan-in."""
    i = edges.groupBy(F.col("dst").alias("id")).agg(F.count(F.lit(1)).alias("fan_in"))
    return nodes.join(reached, "id", "left_anti").join(i, "id", "left").select("id", F.coalesce("fan_in", F.lit(0).cast("long")).alias("fan_in"))


def codeowners(files: DataFrame, rules: list[tuple[str, str]]) -> DataFrame:
    """The last rule that matches a file's path wins; a rule without an owner yields none. rules:
    (segment prefix, owner)."""
    owner = F.lit(None).cast("string")
    for prefix, name in rules:
        owner = F.when(under(F.col("file_path"), prefix), F.lit(name or None)).otherwise(owner)
    return files.select("id", owner.alias("owner")).where("owner is not null")
