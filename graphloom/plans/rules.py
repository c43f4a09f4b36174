"""Queries: guards, audits, risk ladders and ranking helpers."""

from __future__ import annotations

from pyspark.sql import functions as F

from graphloom.operators import rules as r
from graphloom.plans.registry import query
from graphloom.sources.model import EDGES_SQL, GRAPH_SQL, NODES_SQL, edges, nodes, table


@query("boundary_guard", GRAPH_SQL + """ SELECT src, dst, kind FROM edges WHERE src IN (SELECT id FROM nodes WHERE split_part(file_path, '/', 1) = 'orders') AND dst IN (SELECT id FROM nodes WHERE split_part(file_path, '/', 1) = 'parts')""")
def _(s, d):
    n = nodes(s, d)
    return r.boundary_guard(n, edges(s, d), n, "orders", "parts")


@query("co_change_guard", """WITH t AS (SELECT l_orderkey AS commit, p_brand AS package FROM lineitem JOIN part ON p_partkey = l_partkey)
SELECT commit FROM t GROUP BY commit HAVING max(package = 'Brand#1') AND NOT max(package = 'Brand#2')""")
def _(s, d):
    p = table(s, d, "part").select(F.col("p_partkey").alias("l_partkey"), F.col("p_brand").alias("package"))
    return r.co_change_guard(table(s, d, "lineitem").select(F.col("l_orderkey").alias("commit"), "l_partkey").join(p, "l_partkey"), "Brand#1", "Brand#2")


@query("dead_code", GRAPH_SQL + " SELECT id, kind FROM nodes WHERE kind NOT IN ('customer', 'nation', 'region') AND id NOT IN (SELECT dst FROM edges WHERE weight >= 2 OR kind = 'placed')")
def _(s, d):
    """Uses count from two rows on, placed orders always; entry points are customers, nations and regions."""
    return r.dead_code(nodes(s, d), edges(s, d).where("weight >= 2 or kind = 'placed'"), ["customer", "nation", "region"])


@query("hotspots", GRAPH_SQL + """, c AS (SELECT 'part:' || l_partkey AS id, count(DISTINCT l_orderkey) AS commits FROM lineitem GROUP BY 1), i AS (SELECT dst AS id, count(*) AS fan_in FROM edges GROUP BY 1),
x AS (SELECT id, fan_in, commits, max(fan_in) OVER () AS mi, max(commits) OVER () AS mc FROM c JOIN i USING (id))
SELECT id, round(0.5 * ln(1 + fan_in) / ln(1 + mi) + 0.5 * ln(1 + commits) / ln(1 + mc), 6) AS score FROM x ORDER BY score DESC, id LIMIT 50""")
def _(s, d):
    c = table(s, d, "lineitem").groupBy(F.concat(F.lit("part:"), F.col("l_partkey").cast("string")).alias("id")).agg(F.countDistinct("l_orderkey").alias("commits"))
    return r.hotspots(nodes(s, d), edges(s, d), c, 50)


@query("change_risk", """WITH c AS (SELECT o_orderkey AS change, count(DISTINCT l_partkey) * 4 AS callers, count(DISTINCT l_suppkey % 6) AS packages, sum(l_quantity)::BIGINT AS lines FROM orders JOIN lineitem ON l_orderkey = o_orderkey GROUP BY 1),
p AS (SELECT change, (CASE WHEN callers >= 50 THEN 3 WHEN callers >= 10 THEN 2 WHEN callers > 0 THEN 1 ELSE 0 END + CASE WHEN packages >= 4 THEN 3 WHEN packages >= 2 THEN 1 ELSE 0 END + CASE WHEN lines >= 200 THEN 2 WHEN lines >= 50 THEN 1 ELSE 0 END)::INT AS points FROM c)
SELECT change, points, CASE WHEN points >= 7 THEN 'CRITICAL' WHEN points >= 5 THEN 'HIGH' WHEN points >= 3 THEN 'MEDIUM' ELSE 'LOW' END AS level FROM p""")
def _(s, d):
    o = table(s, d, "orders").select(F.col("o_orderkey").alias("change"))
    line = table(s, d, "lineitem").select(F.col("l_orderkey").alias("change"), "l_partkey", (F.col("l_suppkey") % 6).alias("p"), "l_quantity").join(o, "change", "left_semi")
    return r.change_risk(line.groupBy("change").agg((F.countDistinct("l_partkey") * 4).alias("callers"), F.countDistinct("p").alias("packages"), F.sum("l_quantity").cast("long").alias("lines")))


@query("resolution_outcomes", """WITH u AS (SELECT p_type AS lang, p_name AS name, count(*) AS uses FROM part WHERE p_size < 10 GROUP BY ALL), n AS (SELECT p_type AS lang, p_name AS name, count(*) AS same FROM part WHERE p_size > 45 GROUP BY ALL), a AS (SELECT name, sum(same) AS all_ FROM n GROUP BY 1)
SELECT CASE WHEN same >= 2 THEN 'ambiguous_multi_match' WHEN same = 1 THEN 'candidate_out_of_scope' WHEN all_ > 0 THEN 'cross_language_only' ELSE 'no_definition' END AS outcome, sum(uses)::BIGINT AS uses, count(*) AS names
FROM u LEFT JOIN n USING (lang, name) LEFT JOIN a USING (name) GROUP BY 1""")
def _(s, d):
    p = table(s, d, "part").select(F.col("p_name").alias("name"), F.col("p_type").alias("lang"), "p_size")
    return r.resolution_outcomes(p.where("p_size < 10"), p.where("p_size > 45"))


@query("edge_audit", GRAPH_SQL + """ SELECT tier, count(*) AS edges, sum(weight)::BIGINT AS weight, round(count(*) / sum(count(*)) OVER (), 6) AS share
FROM (SELECT weight, CASE kind WHEN 'located_in' THEN 'ast_resolved' WHEN 'placed' THEN 'lsp_resolved' WHEN 'contains' THEN 'text_matched' ELSE 'unknown' END AS tier FROM edges) GROUP BY tier""")
def _(s, d):
    return r.edge_audit(edges(s, d), {"located_in": "ast_resolved", "placed": "lsp_resolved", "contains": "text_matched"})


@query("taint_paths", f"WITH RECURSIVE {NODES_SQL}, {EDGES_SQL}" + """, w(source, pos, hops) AS (SELECT id, id, 0 FROM nodes WHERE kind = 'customer' UNION SELECT source, dst, hops + 1 FROM w JOIN edges ON src = pos WHERE hops < 3)
SELECT source, pos AS sink, min(hops) AS hops FROM w WHERE pos IN (SELECT id FROM nodes WHERE kind = 'supplier') GROUP BY ALL""")
def _(s, d):
    n = nodes(s, d)
    return r.taint(edges(s, d), n.where("kind = 'customer'"), n.where("kind = 'supplier'"), 3)


@query("loop_depth", GRAPH_SQL + """, own AS (SELECT id, size % 4 AS loops FROM nodes WHERE kind IN ('customer', 'order', 'part', 'supplier')),
p AS (SELECT e.src AS id, max(o.loops) AS m FROM edges e JOIN own o ON o.id = e.dst WHERE e.kind = 'supplied_by' GROUP BY 1), q AS (SELECT own.id, own.loops + coalesce(m, 0) AS t FROM own LEFT JOIN p USING (id)),
o2 AS (SELECT e.src AS id, max(q.t) AS m FROM edges e JOIN q ON q.id = e.dst WHERE e.kind = 'contains' GROUP BY 1), q2 AS (SELECT q.id, q.t + coalesce(m, 0) AS t FROM q LEFT JOIN o2 USING (id)),
o3 AS (SELECT e.src AS id, max(q2.t) AS m FROM edges e JOIN q2 ON q2.id = e.dst WHERE e.kind = 'placed' GROUP BY 1)
SELECT q2.id, q2.t + coalesce(m, 0) AS loop_depth FROM q2 LEFT JOIN o3 USING (id)""")
def _(s, d):
    own = nodes(s, d).where(F.col("kind").isin("customer", "order", "part", "supplier")).select("id", (F.col("size") % 4).alias("loops"))
    return r.loop_depth(own, edges(s, d).where("kind <> 'located_in'"))


@query("repo_rank_reset", GRAPH_SQL + " SELECT id AS key, repo_prefix AS repo, size AS rank, row_number() OVER (PARTITION BY repo_prefix ORDER BY size, id) - 1 AS repo_rank FROM nodes WHERE kind = 'customer'")
def _(s, d):
    return r.rank_reset(nodes(s, d).where("kind = 'customer'").select(F.col("id").alias("key"), F.col("repo_prefix").alias("repo"), F.col("size").alias("rank")))


_DIRS = ["src/test", "lib/__tests__", "compat", "examples/demo", "types", "src", "pkg/reexports", "app"]
_FILES = ["main.go", "util_test.go", "index.ts", "api.d.ts", "__init__.py", "Order.java", "spec.rb"]
_PENALTY_SQL = f"""WITH p AS (SELECT p_partkey, list_extract({_DIRS}, (p_partkey % {len(_DIRS)})::INT + 1) || '/' || lower(replace(p_name, ' ', '_')) || '/' || list_extract({_FILES}, (p_size % {len(_FILES)})::INT + 1) AS path FROM part)
SELECT p_partkey, path, least(1.0, {", ".join(f"CASE WHEN regexp_matches(path, '{p}') THEN {w} ELSE 1.0 END" for p, w in r.PENALTIES)})::DOUBLE AS penalty FROM p"""


@query("path_penalty", _PENALTY_SQL)
def _(s, d):
    pick = lambda names, k: F.get(F.array(*[F.lit(x) for x in names]), (F.col(k) % len(names)).cast("int"))
    path = F.concat_ws("/", pick(_DIRS, "p_partkey"), F.lower(F.translate("p_name", " ", "_")), pick(_FILES, "p_size"))
    return table(s, d, "part").select("p_partkey", path.alias("path")).withColumn("penalty", r.path_penalty(F.col("path")))
