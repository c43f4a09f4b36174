"""Queries: clones, duplicates, packing and the rerank signals."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from graphloom.functions.text import reciprocal_rank
from graphloom.operators import clones as c
from graphloom.operators.graph_stats import degrees
from graphloom.plans.registry import query
from graphloom.sources.model import GRAPH_SQL, edges, nodes, table


@query("minhash_clones", None)
def _(s, d):
    return c.clone_classes(table(s, d, "documents"), "doc_id", "text").withColumnRenamed("key", "doc_id")


@query("clone_clusters", None)
def _(s, d):
    return c.clone_clusters(c.clone_links(table(s, d, "documents"), "doc_id", "text"))


@query("exact_duplicates", "SELECT sha256(text) AS digest, count(*) AS size, min(doc_id) AS first FROM documents GROUP BY 1 HAVING count(*) > 1")
def _(s, d):
    return c.exact_duplicates(table(s, d, "documents"), "doc_id", "text")


@query("rare_shingles", """WITH t AS (SELECT doc_id AS key, regexp_extract_all(lower(text), '[\\p{L}\\p{N}_]+') AS t FROM documents),
s AS (SELECT DISTINCT key, list_slice(t, i, i + 2) AS g FROM (SELECT key, t, unnest(range(1, len(t) - 1)) AS i FROM t WHERE len(t) >= 24)),
f AS (SELECT g FROM s GROUP BY g HAVING count(*) <= 2)
SELECT key, count(*) AS rare FROM s WHERE g IN (SELECT g FROM f) GROUP BY key""")
def _(s, d):
    return c.rare_shingles(table(s, d, "documents"), "doc_id", "text", 2)


def _page(s, d):
    docs = table(s, d, "documents").orderBy(F.desc("n_chars"), "doc_id").limit(200)
    place = F.row_number().over(Window.orderBy(F.desc("n_chars"), "doc_id"))  # a page of 200
    return docs.select(F.col("doc_id").alias("key"), place.alias("place"), (F.col("n_chars") % 97).cast("double").alias("score"), ((F.col("n_chars") + 3) / 4).cast("long").alias("cost"))


_PACK = """WITH RECURSIVE b AS (SELECT doc_id AS key, row_number() OVER (ORDER BY n_chars DESC, doc_id) AS place, (n_chars % 97)::DOUBLE AS score, floor((n_chars + 3) / 4)::BIGINT AS cost FROM documents ORDER BY n_chars DESC, doc_id LIMIT 200),
o AS (SELECT key, cost, row_number() OVER (ORDER BY {order}) AS i FROM b),
w AS (SELECT 0::BIGINT AS i, 0::BIGINT AS used, NULL::BIGINT AS key, false AS took UNION ALL
  SELECT o.i, used + CASE WHEN used + cost <= 20000 THEN cost ELSE 0 END, o.key, used + cost <= 20000 FROM w JOIN o ON o.i = w.i + 1)
SELECT (row_number() OVER (ORDER BY i) - 1)::INT AS nth, key FROM w WHERE took"""


@query("pack_top_k", _PACK.format(order="place"))
def _(s, d):
    return c.pack_by_rank(_page(s, d), 20000)


@query("pack_density", _PACK.format(order="score / greatest(cost, 1) DESC, place"))
def _(s, d):
    return c.pack_by_rank(_page(s, d), 20000, "density")


@query("rerank_signals", GRAPH_SQL + """, g AS (SELECT n.id, coalesce(i.c, 0) AS fi, coalesce(o.c, 0) AS fo FROM nodes n LEFT JOIN (SELECT dst, count(*) AS c FROM edges GROUP BY 1) i ON i.dst = n.id LEFT JOIN (SELECT src, count(*) AS c FROM edges GROUP BY 1) o ON o.src = n.id),
b AS (SELECT id AS key, name, size, row_number() OVER (ORDER BY size DESC, id) - 1 AS rank FROM nodes WHERE kind = 'part' ORDER BY size DESC, id LIMIT 100),
x AS (SELECT b.*, fi, fo, max(fi) OVER () AS mi, max(fo) OVER () AS mo FROM b JOIN g ON g.id = b.key)
SELECT key, rank, round(1.0 * least(61.0 / (60 + rank + 1), 1) + 0.6 * coalesce(ln(1 + fi) / ln(1 + mi), 0) + 0.2 * coalesce(ln(1 + fo) / ln(1 + mo), 0) + 0.6 * CASE WHEN name = 'red widget' THEN 1.0 WHEN contains(name, 'widget') THEN 0.6 WHEN starts_with(name, 'red') THEN 0.4 ELSE 0 END, 6) AS score FROM x""")
def _(s, d):
    n = nodes(s, d)
    some = n.where("kind = 'part'").orderBy(F.desc("size"), "id").limit(100)
    b = some.select(F.col("id").alias("key"), "name", (F.row_number().over(Window.orderBy(F.desc("size"), "id")) - 1).alias("rank"))
    deg = degrees(n, edges(s, d)).select(F.col("id").alias("key"), "fan_in", "fan_out").join(F.broadcast(b.select("key")), "key")  # 100 rows
    every = Window.partitionBy(F.lit(1))
    log = lambda x: F.log1p(F.col(x)) / F.log1p(F.max(x).over(every))
    said = F.when(F.col("name") == "red widget", 1.0).when(F.col("name").contains("widget"), 0.6).when(F.col("name").startswith("red"), 0.4).otherwise(0.0)
    page = b.join(deg, "key").select("key", "rank", reciprocal_rank(F.col("rank")).alias("bm25"), log("fan_in").alias("in"), log("fan_out").alias("out"), said.alias("definition"))
    return c.rerank(page, {"bm25": 1.0, "in": 0.6, "out": 0.2, "definition": 0.6})
