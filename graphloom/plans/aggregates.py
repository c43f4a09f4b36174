"""Queries: one-pass aggregates over the graph."""

from __future__ import annotations

from graphloom.operators import graph_stats as g
from graphloom.plans.registry import query
from graphloom.sources.model import GRAPH_SQL, edges, nodes

_DEG = GRAPH_SQL + """, deg AS (
  SELECT n.id, n.kind, n.size, coalesce(i.c, 0)::BIGINT AS fan_in, coalesce(o.c, 0)::BIGINT AS fan_out
  FROM nodes n LEFT JOIN (SELECT dst, count(*) AS c FROM edges GROUP BY dst) i ON i.dst = n.id
  LEFT JOIN (SELECT src, count(*) AS c FROM edges GROUP BY src) o ON o.src = n.id)
"""
_PKG = "split_part(file_path, '/', 1)"


@query("fan_in_out", _DEG + "SELECT id, kind, fan_in, fan_out FROM deg")
def _(s, d):
    return g.degrees(nodes(s, d), edges(s, d))


@query("edge_kind_hist", GRAPH_SQL + """
SELECT kind, n, round(100 * n / t, 6) AS share, 100 * n / t <= 5.0 AS rare
FROM (SELECT kind, count(*) AS n, sum(count(*)) OVER () AS t FROM edges GROUP BY kind)""")
def _(s, d):
    return g.kind_histogram(edges(s, d))


@query("coupling_metrics", GRAPH_SQL + f""", u AS (SELECT id, {_PKG} AS unit FROM nodes),
p AS (SELECT a.unit AS u, b.unit AS v, count(*) AS n FROM edges JOIN u a ON a.id = src JOIN u b ON b.id = dst GROUP BY ALL)
SELECT m.unit, members, coalesce(ca, 0)::BIGINT AS ca, coalesce(ce, 0)::BIGINT AS ce,
  round(CASE WHEN coalesce(ca, 0) + coalesce(ce, 0) > 0 THEN coalesce(ce, 0) / (coalesce(ca, 0) + coalesce(ce, 0)) ELSE 0 END, 6) AS instability,
  coalesce(internal, 0)::BIGINT AS internal, coalesce(out_edges, 0)::BIGINT AS out_edges
FROM (SELECT unit, count(*) AS members FROM u GROUP BY unit) m
LEFT JOIN (SELECT u AS unit, count(*) FILTER (u <> v) AS ce, coalesce(sum(n) FILTER (u = v), 0) AS internal, sum(n) AS out_edges FROM p GROUP BY u) o USING (unit)
LEFT JOIN (SELECT v AS unit, count(*) AS ca FROM p WHERE u <> v GROUP BY v) i USING (unit)""")
def _(s, d):
    return g.coupling(nodes(s, d), edges(s, d))


@query("connectivity_health", _DEG + """
SELECT kind, count(*) AS nominal, count(*) FILTER (fan_in + fan_out = 0) AS isolated, count(*) FILTER (fan_in + fan_out = 1) AS leaf,
  count(*) FILTER (fan_in = 0 AND fan_out > 0) AS source_only, count(*) FILTER (fan_in > 0 AND fan_out = 0) AS sink_only,
  count(*) FILTER (fan_in + fan_out > 0) AS effective FROM deg GROUP BY kind""")
def _(s, d):
    return g.connectivity(nodes(s, d), edges(s, d))


@query("hierarchy_rollup", GRAPH_SQL + f""", e AS (
  SELECT split_part(a.file_path, '/', 1) AS p1, split_part(b.file_path, '/', 1) AS p2, a.kind AS k1, b.kind AS k2
  FROM edges JOIN nodes a ON a.id = src JOIN nodes b ON b.id = dst)
SELECT level, group_from, group_to, count(*) AS edges, group_from = group_to AS self_loop FROM (
  SELECT 'package' AS level, p1 AS group_from, p2 AS group_to FROM e UNION ALL SELECT 'kind', k1, k2 FROM e UNION ALL SELECT 'system', 'all', 'all' FROM e
) GROUP BY ALL""")
def _(s, d):
    return g.hierarchy(nodes(s, d), edges(s, d))


@query("role_classify", _DEG + """
SELECT id, kind, CASE WHEN fan_in = 0 AND fan_out = 0 THEN 'dead' WHEN fan_in = 0 THEN 'entry' WHEN fan_out = 0 THEN 'leaf'
  WHEN fan_in = 1 AND fan_out = 1 THEN 'adapter' WHEN fan_in >= 3 AND fan_out <= 2 AND size <= 30 THEN 'utility' ELSE 'core' END AS role FROM deg""")
def _(s, d):
    return g.roles(nodes(s, d), edges(s, d))


@query("surprising_edges", _DEG + """, side AS (SELECT n.id, split_part(file_path, '/', 1) AS c, n.kind AS l, repo_prefix AS r, fan_in FROM nodes n JOIN deg USING (id)),
h AS (SELECT kind, 100 * count(*) / sum(count(*)) OVER () <= 5.0 AS rare FROM edges GROUP BY kind),
x AS (SELECT src, dst, e.kind, (CASE WHEN a.c <> b.c THEN 30 ELSE 0 END + CASE WHEN a.l <> b.l THEN 20 ELSE 0 END
  + CASE WHEN a.fan_in <= 2 AND b.fan_in >= 20 THEN 20 ELSE 0 END + CASE WHEN a.r <> b.r THEN 15 ELSE 0 END + CASE WHEN rare THEN 15 ELSE 0 END) / 100 AS score
  FROM edges e JOIN side a ON a.id = src JOIN side b ON b.id = dst JOIN h ON h.kind = e.kind)
SELECT * FROM x WHERE score >= 0.3""")
def _(s, d):
    return g.surprising_edges(nodes(s, d), edges(s, d))


@query("knowledge_gaps", _DEG + """
SELECT 'disconnected' AS gap, id AS subject, 1::BIGINT AS n FROM deg WHERE fan_in + fan_out = 0
UNION ALL SELECT 'thin', file_path, count(*) FROM nodes GROUP BY file_path HAVING count(*) <= 3""")
def _(s, d):
    return g.knowledge_gaps(nodes(s, d), edges(s, d))


@query("cross_repo_rollup", GRAPH_SQL + """
SELECT a.repo_prefix AS repo_a, b.repo_prefix AS repo_b, e.kind, count(*) AS n FROM edges e JOIN nodes a ON a.id = src JOIN nodes b ON b.id = dst
WHERE a.repo_prefix <> b.repo_prefix GROUP BY ALL""")
def _(s, d):
    return g.cross_repo(nodes(s, d), edges(s, d))


@query("bounded_adjacency", GRAPH_SQL + """
SELECT src, dst, kind, rn, m > 8 AS truncated FROM (
  SELECT src, dst, kind, row_number() OVER (PARTITION BY src ORDER BY dst, kind)::INT AS rn, count(*) OVER (PARTITION BY src) AS m FROM edges) WHERE rn <= 8""")
def _(s, d):
    return g.bounded_adjacency(edges(s, d), 8)


@query("entry_point_scores", _DEG + """
SELECT id, round(fan_out / (fan_in + 1) * CASE WHEN fan_in = 0 THEN 2.0 WHEN fan_in <= 2 THEN 1.3 ELSE 1.0 END, 6) AS score FROM deg
WHERE fan_out > 0 AND round(fan_out / (fan_in + 1) * CASE WHEN fan_in = 0 THEN 2.0 WHEN fan_in <= 2 THEN 1.3 ELSE 1.0 END, 6) > 0.5""")
def _(s, d):
    return g.entry_scores(nodes(s, d), edges(s, d))


_LAYERS = {"customer": ["order", "nation"], "order": ["part"], "nation": ["region"]}


@query("layer_violations", GRAPH_SQL + """
SELECT a.kind AS layer_from, b.kind AS layer_to, e.kind AS edge_kind, count(*) AS violations FROM edges e JOIN nodes a ON a.id = src JOIN nodes b ON b.id = dst
WHERE a.kind <> b.kind AND (a.kind, b.kind) NOT IN (('customer', 'order'), ('customer', 'nation'), ('order', 'part'), ('nation', 'region')) GROUP BY ALL""")
def _(s, d):
    return g.layer_violations(nodes(s, d), edges(s, d), _LAYERS)


@query("fan_out_cap", GRAPH_SQL + "SELECT src, count(DISTINCT dst) AS targets FROM edges WHERE kind = 'placed' GROUP BY src HAVING count(DISTINCT dst) > 12")
def _(s, d):
    return g.fan_out_cap(edges(s, d), "placed", 12)


@query("modularity", GRAPH_SQL + """, m AS (SELECT id, split_part(file_path, '/', 1) AS c FROM nodes),
j AS (SELECT a.c AS c1, b.c AS c2, weight::DOUBLE AS w FROM edges JOIN m a ON a.id = src JOIN m b ON b.id = dst),
x AS (SELECT c1 AS c, w, CASE WHEN c1 = c2 THEN w ELSE 0 END AS i FROM j UNION ALL SELECT c2, w, 0 FROM j),
y AS (SELECT c, sum(w) AS k, sum(i) AS i FROM x GROUP BY c), t AS (SELECT sum(k) AS t FROM y)
SELECT round(sum(i / (t / 2) - pow(k / t, 2)), 6) AS modularity FROM y, t""")
def _(s, d):
    n = nodes(s, d)
    return g.modularity(edges(s, d), n.select("id", g.package(n["file_path"]).alias("community")))
