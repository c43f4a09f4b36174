"""The property graph: two wide tables, nodes and edges, read off the driver tables.

nodes: id, kind, name, file_path, language, repo_prefix, size
edges: src, dst, kind, weight, line

Regions, nations, customers, suppliers, parts and orders are nodes; foreign keys are edges. A path
like `asia/china/customer` gives path and hierarchy operators something to work on. Edges are unique
by (src, dst, kind); weight counts the rows behind one.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from graphloom.sources.scratch import lean, scratch, small

STRUCTURE = ["located_in"]
CALLS = ["placed", "contains", "supplied_by"]


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def _id(kind: str, key: str):
    return F.concat(F.lit(f"{kind}:"), F.col(key).cast("string"))


def _built_nodes(spark: SparkSession, sf_dir: str) -> list[tuple[str, DataFrame]]:
    t = lambda n: table(spark, sf_dir, n)
    region = t("region")
    nation = t("nation").join(F.broadcast(region), F.col("n_regionkey") == F.col("r_regionkey"))  # 25 rows by definition
    place = nation.select(
        "n_nationkey", "r_name", F.concat_ws("/", F.lower("r_name"), F.lower(F.translate("n_name", " ", "_"))).alias("place")
    )
    out = [
        region.select(_id("region", "r_regionkey").alias("id"), F.lit("region").alias("kind"), F.col("r_name").alias("name"), F.lower("r_name").alias("file_path"), F.col("r_name").alias("repo_prefix"), F.lit(0).cast("long").alias("size")),
        nation.join(place.drop("r_name"), "n_nationkey").select(_id("nation", "n_nationkey").alias("id"), F.lit("nation").alias("kind"), F.col("n_name").alias("name"), F.col("place").alias("file_path"), F.col("r_name").alias("repo_prefix"), F.lit(0).cast("long").alias("size")),
    ]
    for kind, key, name, own in (("customer", "c_custkey", "c_name", "c_nationkey"), ("supplier", "s_suppkey", "s_name", "s_nationkey")):
        rows = t(kind).join(small(place), F.col(own) == F.col("n_nationkey"))
        size = F.length(name).cast("long")
        out.append(rows.select(_id(kind, key).alias("id"), F.lit(kind).alias("kind"), F.col(name).alias("name"), F.concat_ws("/", "place", F.lit(kind)).alias("file_path"), F.col("r_name").alias("repo_prefix"), size.alias("size")))
    out.append(t("part").select(_id("part", "p_partkey").alias("id"), F.lit("part").alias("kind"), F.col("p_name").alias("name"), F.concat_ws("/", F.lit("parts"), F.lower(F.translate("p_brand", "# ", "__"))).alias("file_path"), F.lit("").alias("repo_prefix"), F.col("p_size").cast("long").alias("size")))
    out.append(t("orders").select(_id("order", "o_orderkey").alias("id"), F.lit("order").alias("kind"), F.concat(F.lit("Order"), F.col("o_orderkey").cast("string")).alias("name"), F.concat_ws("/", F.lit("orders"), F.lower(F.translate("o_orderpriority", " ", "_"))).alias("file_path"), F.lit("").alias("repo_prefix"), F.lit(0).cast("long").alias("size")))
    return list(zip(("region", "nation", "customer", "supplier", "part", "order"), out, strict=True))


def _built_edges(spark: SparkSession, sf_dir: str) -> list[tuple[str, DataFrame]]:
    t = lambda n: table(spark, sf_dir, n)
    line = t("lineitem")

    def link(df, a, ka, b, kb, kind):
        """Rows are counted by their keys, which are shorter to move than ids."""
        by = df.groupBy(ka, kb).agg(F.count(F.lit(1)).alias("weight"))
        return kind, by.select(_id(a, ka).alias("src"), _id(b, kb).alias("dst"), F.lit(kind).alias("kind"), "weight")

    return [
        link(t("nation"), "nation", "n_nationkey", "region", "n_regionkey", "located_in"),
        link(t("customer"), "customer", "c_custkey", "nation", "c_nationkey", "located_in"),
        link(t("supplier"), "supplier", "s_suppkey", "nation", "s_nationkey", "located_in"),
        link(t("orders"), "customer", "o_custkey", "order", "o_orderkey", "placed"),
        link(line, "order", "l_orderkey", "part", "l_partkey", "contains"),
        link(line, "part", "l_partkey", "supplier", "l_suppkey", "supplied_by"),
    ]


_STORED: dict[tuple[str, str, str], tuple[str, StructType]] = {}


def _stored(spark: SparkSession, sf_dir: str, name: str, build: Callable[[SparkSession, str], list[tuple[str, DataFrame]]]) -> DataFrame:
    """The table built once for an application and folder, in the shared scratch folder, a folder for each
    kind, so that a query reads the kinds and columns it names and no query joins the sources again. Kinds are
    written one by one, so no rows are sorted by kind, in short pieces, for the largest table's rows."""
    key = (spark.sparkContext.applicationId, sf_dir, name)
    if key not in _STORED:
        path, parts = scratch(spark, f"graph-{name}"), build(spark, sf_dir)
        with lean(spark, table(spark, sf_dir, "lineitem").count()):
            for kind, part in parts:
                part.drop("kind").write.mode("append").parquet(f"{path}/kind={kind}")
        _STORED[key] = path, parts[0][1].schema
    path, schema = _STORED[key]
    return spark.read.schema(schema).parquet(path).select(*schema.names)


def nodes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _stored(spark, sf_dir, "nodes", _built_nodes)


def edges(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _stored(spark, sf_dir, "edges", _built_edges)


def forget(spark: SparkSession, sf_dir: str) -> None:
    """Build the graph of a folder anew at its next use, after its tables have changed."""
    for name in ("nodes", "edges"):
        _STORED.pop((spark.sparkContext.applicationId, sf_dir, name), None)


#: The same two tables in SQL, for the oracles.
NODES_SQL = """
nodes AS (
  SELECT 'region:' || r_regionkey AS id, 'region' AS kind, r_name AS name, lower(r_name) AS file_path, r_name AS repo_prefix, 0::BIGINT AS size FROM region
  UNION ALL SELECT 'nation:' || n_nationkey, 'nation', n_name, lower(r_name) || '/' || lower(replace(n_name, ' ', '_')), r_name, 0
    FROM nation JOIN region ON n_regionkey = r_regionkey
  UNION ALL SELECT 'customer:' || c_custkey, 'customer', c_name, lower(r_name) || '/' || lower(replace(n_name, ' ', '_')) || '/customer', r_name, length(c_name)
    FROM customer JOIN nation ON c_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey
  UNION ALL SELECT 'supplier:' || s_suppkey, 'supplier', s_name, lower(r_name) || '/' || lower(replace(n_name, ' ', '_')) || '/supplier', r_name, length(s_name)
    FROM supplier JOIN nation ON s_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey
  UNION ALL SELECT 'part:' || p_partkey, 'part', p_name, 'parts/' || lower(replace(replace(p_brand, '#', '_'), ' ', '_')), '', p_size FROM part
  UNION ALL SELECT 'order:' || o_orderkey, 'order', 'Order' || o_orderkey, 'orders/' || lower(replace(o_orderpriority, ' ', '_')), '', 0 FROM orders
)"""
EDGES_SQL = """
edges AS (
  SELECT src, dst, kind, count(*) AS weight FROM (
    SELECT 'nation:' || n_nationkey AS src, 'region:' || n_regionkey AS dst, 'located_in' AS kind FROM nation
    UNION ALL SELECT 'customer:' || c_custkey, 'nation:' || c_nationkey, 'located_in' FROM customer
    UNION ALL SELECT 'supplier:' || s_suppkey, 'nation:' || s_nationkey, 'located_in' FROM supplier
    UNION ALL SELECT 'customer:' || o_custkey, 'order:' || o_orderkey, 'placed' FROM orders
    UNION ALL SELECT 'order:' || l_orderkey, 'part:' || l_partkey, 'contains' FROM lineitem
    UNION ALL SELECT 'part:' || l_partkey, 'supplier:' || l_suppkey, 'supplied_by' FROM lineitem
  ) GROUP BY ALL
)"""
GRAPH_SQL = f"WITH {NODES_SQL}, {EDGES_SQL}"
