"""Queries: traversals of the graph."""

from __future__ import annotations

from pyspark.sql import functions as F

from graphloom.operators import traverse as t
from graphloom.plans.registry import query
from graphloom.sources.model import EDGES_SQL, GRAPH_SQL, NODES_SQL, edges, nodes

_REC = f"WITH RECURSIVE {NODES_SQL}, {EDGES_SQL}"
_SEEDS = "kind = 'customer' AND repo_prefix = 'ASIA'"


def _seeds(s, d):
    return nodes(s, d).where("kind = 'customer' and repo_prefix = 'ASIA'").select("id")


@query("bfs_hops", _REC + f""", w(node_id, depth) AS (
  SELECT id, 0 FROM nodes WHERE {_SEEDS} UNION SELECT dst, depth + 1 FROM w JOIN edges ON src = node_id WHERE depth < 3),
m AS (SELECT node_id, min(depth) AS depth FROM w GROUP BY 1),
p AS (SELECT m.node_id, m.depth, src AS parent_id, kind AS edge_kind, row_number() OVER (PARTITION BY m.node_id ORDER BY src, kind) AS r
  FROM m JOIN edges ON dst = m.node_id JOIN m q ON q.node_id = src AND q.depth = m.depth - 1)
SELECT node_id, depth, NULL AS parent_id, NULL AS edge_kind FROM m WHERE depth = 0
UNION ALL SELECT node_id, depth, parent_id, edge_kind FROM p WHERE r = 1""")
def _(s, d):
    return t.bfs(_seeds(s, d), edges(s, d), 3)


@query("import_closure", _REC + f""", w(node_id, depth) AS (
  SELECT id, 0 FROM nodes WHERE {_SEEDS} UNION SELECT dst, depth + 1 FROM w JOIN edges ON src = node_id WHERE depth < 6 AND kind IN ('placed', 'contains', 'supplied_by'))
SELECT node_id, min(depth) AS distance FROM w GROUP BY 1""")
def _(s, d):
    return t.bfs(_seeds(s, d), edges(s, d), 6, kinds=["placed", "contains", "supplied_by"]).select("node_id", F.col("depth").alias("distance"))


@query("class_hierarchy", _REC + """, w AS (
  SELECT id AS start, id AS node_id, 0 AS depth, [id] AS path, []::VARCHAR[] AS kinds FROM nodes WHERE kind = 'supplier'
  UNION ALL SELECT start, dst, depth + 1, list_append(path, dst), list_append(kinds, e.kind) FROM w JOIN edges e ON src = node_id WHERE depth < 8 AND e.kind = 'located_in' AND NOT list_contains(path, dst))
SELECT start, node_id, depth, array_to_string(path, '>') AS path, array_to_string(kinds, '>') AS kinds FROM w""")
def _(s, d):
    out = t.paths(nodes(s, d).where("kind = 'supplier'"), edges(s, d), 8, kinds=["located_in"])
    return out.withColumns({"path": F.array_join("path", ">"), "kinds": F.array_join("kinds", ">")})


@query("reach_tiers", GRAPH_SQL + """, e AS (SELECT DISTINCT dst AS node, src AS caller FROM edges WHERE kind IN ('located_in', 'placed') AND src <> dst),
t2 AS (SELECT DISTINCT e.node, f.caller FROM e JOIN e f ON f.node = e.caller WHERE e.node <> f.caller EXCEPT SELECT node, caller FROM e),
t3 AS (SELECT DISTINCT t2.node, f.caller FROM t2 JOIN e f ON f.node = t2.caller WHERE t2.node <> f.caller EXCEPT SELECT node, caller FROM e EXCEPT SELECT node, caller FROM t2)
SELECT node, caller, 1 AS tier FROM e UNION ALL SELECT node, caller, 2 FROM t2 UNION ALL SELECT node, caller, 3 FROM t3""")
def _(s, d):
    return t.reach_tiers(edges(s, d), ["located_in", "placed"])


@query("k_shortest_paths", _REC + """, w AS (
  SELECT id AS start, id AS node_id, 0 AS depth, [id] AS path FROM nodes WHERE kind = 'customer' AND repo_prefix = 'ASIA'
  UNION ALL SELECT start, dst, depth + 1, list_append(path, dst) FROM w JOIN edges ON src = node_id WHERE depth < 3 AND NOT list_contains(path, dst)),
r AS (SELECT *, row_number() OVER (PARTITION BY start, node_id ORDER BY depth, array_to_string(path, '>'))::INT AS rank FROM w WHERE depth > 0 AND node_id LIKE 'supplier:%')
SELECT start, node_id, rank, depth, array_to_string(path, '>') AS path FROM r WHERE rank <= 3""")
def _(s, d):
    return t.shortest_paths(_seeds(s, d), nodes(s, d).where("kind = 'supplier'"), edges(s, d), 3)


@query("would_create_cycle", _REC + """, p AS (SELECT 'region:' || (n_nationkey % 5) AS src, 'nation:' || n_nationkey AS dst FROM nation UNION SELECT 'nation:' || n_nationkey, 'region:' || (n_nationkey % 5) FROM nation),
w AS (SELECT src AS a, dst AS b, dst AS pos FROM p UNION SELECT a, b, dst FROM w JOIN edges ON src = pos WHERE kind = 'located_in')
SELECT a AS src, b AS dst, max(pos = a) AS cycle FROM w GROUP BY ALL""")
def _(s, d):
    n = nodes(s, d).where("kind = 'nation'").select(F.col("id").alias("n"), F.concat(F.lit("region:"), (F.split("id", ":")[1].cast("int") % 5).cast("string")).alias("r"))
    pairs = n.select(F.col("r").alias("src"), F.col("n").alias("dst")).unionByName(n.select(F.col("n").alias("src"), F.col("r").alias("dst")))
    return t.would_cycle(pairs, edges(s, d), 4, ["located_in"])


@query("budgeted_walk", _REC + f""", w(node_id, depth) AS (
  SELECT id, 0 FROM nodes WHERE {_SEEDS} UNION SELECT dst, depth + 1 FROM w JOIN edges ON src = node_id WHERE depth < 8)
SELECT node_id, min(depth) AS depth FROM w GROUP BY 1 ORDER BY depth, node_id LIMIT 250""")
def _(s, d):
    return t.budgeted_walk(_seeds(s, d), edges(s, d), 8, 2000)


@query("one_hop_expand", GRAPH_SQL + """ SELECT src AS from_id, dst AS to_id, edges.kind, n.kind AS node_kind FROM edges JOIN nodes n ON n.id = dst WHERE src IN (SELECT id FROM nodes WHERE kind = 'part' AND size > 40)""")
def _(s, d):
    n = nodes(s, d)
    return t.expand_once(n.where("kind = 'part' and size > 40"), edges(s, d), n)
