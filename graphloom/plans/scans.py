"""Queries: scans, filters, exports, set operations and rules."""

from __future__ import annotations

from pyspark.sql import functions as F

from graphloom.operators import scan as c
from graphloom.operators import traverse
from graphloom.plans.registry import query
from graphloom.sources.model import EDGES_SQL, GRAPH_SQL, NODES_SQL, edges, nodes, table


@query("node_scan_kinds", GRAPH_SQL + " SELECT id, name FROM nodes WHERE kind IN ('customer', 'supplier')")
def _(s, d):
    return nodes(s, d).where(F.col("kind").isin("customer", "supplier")).select("id", "name")


@query("edge_scan_kinds", GRAPH_SQL + " SELECT src, dst, kind, weight FROM edges WHERE kind IN ('placed', 'located_in')")
def _(s, d):
    return edges(s, d).where(F.col("kind").isin("placed", "located_in"))


@query("name_contains", GRAPH_SQL + " SELECT id, name FROM nodes WHERE contains(lower(name), 'red')")
def _(s, d):
    return nodes(s, d).where(F.lower("name").contains("red")).select("id", "name")


@query("dsl_nodes_traverse_filter", GRAPH_SQL + """, a AS (SELECT id FROM nodes WHERE kind = 'customer' AND file_path LIKE 'asia/%' ORDER BY id LIMIT 50),
b AS (SELECT DISTINCT dst AS id FROM edges WHERE src IN (SELECT id FROM a) AND kind = 'placed' ORDER BY id LIMIT 50),
x AS (SELECT DISTINCT dst AS id FROM edges WHERE src IN (SELECT id FROM b) AND kind = 'contains' ORDER BY id LIMIT 50)
SELECT id, name FROM nodes WHERE id IN (SELECT id FROM x) AND regexp_matches(name, 'red|blue')""")
def _(s, d):
    text = "nodes kind=customer path=asia/ | traverse placed out | traverse contains out | filter name~red|blue".replace("red|blue", "(?:red~blue)")
    n, e = nodes(s, d), edges(s, d)
    out = c.run_pipeline(n, e, text.rsplit("|", 1)[0], 50)
    return out.where(F.col("name").rlike("red|blue")).select("id", "name")


@query("field_filters", GRAPH_SQL + " SELECT id FROM nodes WHERE kind = 'customer' AND repo_prefix IN ('EUROPE', '') AND contains(lower(file_path), 'europe') AND contains(lower(name), '1')")
def _(s, d):
    return c.field_query(nodes(s, d), "find kind:supplier kind:customer repo:EUROPE path:europe name:1 lang:*").select("id")


@query("winnow", GRAPH_SQL + """ SELECT n.id, n.kind, coalesce(i.c, 0)::BIGINT AS fan_in, coalesce(o.c, 0)::BIGINT AS fan_out FROM nodes n
LEFT JOIN (SELECT dst, count(*) AS c FROM edges GROUP BY 1) i ON i.dst = n.id LEFT JOIN (SELECT src, count(*) AS c FROM edges GROUP BY 1) o ON o.src = n.id
WHERE n.kind IN ('part', 'supplier') AND starts_with(file_path, 'parts/') AND coalesce(i.c, 0) >= 8 AND coalesce(o.c, 0) >= 8""")
def _(s, d):
    return c.winnow(nodes(s, d), edges(s, d), ["part", "supplier"], "parts/", 8, 8)


@query("anchored_path", GRAPH_SQL + " SELECT id, file_path FROM nodes WHERE file_path = 'asia' OR starts_with(file_path, 'asia/')")
def _(s, d):
    return c.anchored(nodes(s, d), "asia")


@query("file_subgraph", GRAPH_SQL + """, f AS (SELECT id FROM nodes WHERE file_path = (SELECT min(file_path) FROM nodes WHERE kind = 'part'))
SELECT DISTINCT src, dst, kind FROM edges WHERE src IN (SELECT id FROM f) OR dst IN (SELECT id FROM f)""")
def _(s, d):
    n = nodes(s, d)
    return c.file_subgraph(n, edges(s, d), n.where("kind = 'part'").agg(F.min("file_path")).first()[0])


@query("cursor_page", GRAPH_SQL + " SELECT id, kind, place FROM (SELECT id, kind, row_number() OVER (ORDER BY id)::INT AS place FROM nodes) WHERE place BETWEEN 101 AND 150")
def _(s, d):
    return c.page(nodes(s, d).select("id", "kind"), ["id"], 100, 50)


KINDS = ["region", "nation", "customer", "supplier", "part", "order"]


@query("export_cypher", GRAPH_SQL + """ SELECT 'CREATE (:' || kind || ' {id: ''' || id || ''', name: ''' || name || '''})' AS line FROM nodes
UNION ALL SELECT 'MATCH (a {id: ''' || src || '''}), (b {id: ''' || dst || '''}) CREATE (a)-[:' || upper(kind) || ']->(b)' FROM edges""")
def _(s, d):
    return c.export_cypher(nodes(s, d), edges(s, d), KINDS)


@query("export_graphml", GRAPH_SQL + """ SELECT '<node id="' || id || '"><data key="name">' || name || '</data></node>' AS line FROM nodes
UNION ALL SELECT '<edge source="' || src || '" target="' || dst || '" label="' || kind || '"/>' FROM edges""")
def _(s, d):
    return c.export_graphml(nodes(s, d), edges(s, d), KINDS)


@query("export_mermaid", GRAPH_SQL + " SELECT replace(src, ':', '_') || ' -->|' || kind || '| ' || replace(dst, ':', '_') AS line FROM edges ORDER BY weight DESC, src, dst, kind LIMIT 40")
def _(s, d):
    return c.export_mermaid(edges(s, d), 40)


@query("overlay", """SELECT p_partkey, p_name, p_size FROM part WHERE p_partkey % 10 <> 3 UNION ALL SELECT p_partkey, upper(p_name), p_size + 1 FROM part WHERE p_partkey % 10 = 3""")
def _(s, d):
    p = table(s, d, "part").select("p_partkey", "p_name", "p_size")
    changed = p.where("p_partkey % 10 = 3").select("p_partkey", F.upper("p_name").alias("p_name"), (F.col("p_size") + 1).alias("p_size"))
    return c.overlay(p, changed, "p_partkey")


@query("missing_fields", """WITH f AS (SELECT DISTINCT user_id AS owner, t.event_type AS field FROM events, (SELECT DISTINCT event_type FROM events) t), u AS (SELECT DISTINCT user_id, event_type FROM events WHERE value > 60)
SELECT owner, string_agg(field, ',' ORDER BY field) AS missing FROM f WHERE (owner, field) NOT IN (SELECT user_id, event_type FROM u) GROUP BY owner""")
def _(s, d):
    e = table(s, d, "events")
    types = F.array(*[F.lit(x) for x in ("click", "error", "purchase", "signup", "view")])
    fields = e.select(F.col("user_id").alias("owner")).distinct().select("owner", F.explode(types).alias("field"))
    return c.missing_fields(fields, e.where("value > 60").select(F.col("user_id").alias("owner"), F.col("event_type").alias("field")))


@query("contract_match", """WITH p AS (SELECT n_regionkey AS workspace, n_nationkey AS project, s_suppkey % 50 AS contract, s_suppkey AS id FROM supplier JOIN nation ON n_nationkey = s_nationkey),
c AS (SELECT n_regionkey AS workspace, n_nationkey AS project, c_custkey % 50 AS contract, c_custkey AS id FROM customer JOIN nation ON n_nationkey = c_nationkey)
SELECT coalesce(p.workspace, c.workspace) AS workspace, CASE WHEN p.id IS NULL THEN 'orphan_consumer' WHEN c.id IS NULL THEN 'orphan_provider' ELSE 'matched' END AS state, count(*) AS n
FROM p FULL JOIN c ON p.workspace = c.workspace AND p.project = c.project AND p.contract = c.contract GROUP BY ALL""")
def _(s, d):
    n = F.broadcast(table(s, d, "nation"))  # 25 rows
    side = lambda t, k, o: table(s, d, t).join(n, F.col(o) == F.col("n_nationkey")).select(F.col("n_regionkey").alias("workspace"), F.col("n_nationkey").alias("project"), (F.col(k) % 50).alias("contract"), F.col(k).alias("id"))
    return c.match_contracts(side("supplier", "s_suppkey", "s_nationkey"), side("customer", "c_custkey", "c_nationkey"))


@query("untested_reach", f"WITH RECURSIVE {NODES_SQL}, {EDGES_SQL}" + """, w(id, depth) AS (SELECT id, 0 FROM nodes WHERE kind = 'customer' AND repo_prefix = 'ASIA' UNION SELECT dst, depth + 1 FROM w JOIN edges ON src = w.id WHERE depth < 2)
SELECT n.id, coalesce(c, 0)::BIGINT AS fan_in FROM nodes n LEFT JOIN (SELECT dst, count(*) AS c FROM edges GROUP BY 1) i ON i.dst = n.id WHERE n.id NOT IN (SELECT id FROM w) AND n.kind = 'part'""")
def _(s, d):
    n, e = nodes(s, d), edges(s, d)
    seen = traverse.bfs(n.where("kind = 'customer' and repo_prefix = 'ASIA'"), e, 2)
    return c.untested(n.where("kind = 'part'"), seen.select(F.col("node_id").alias("id")), e)


@query("codeowners", GRAPH_SQL + """ SELECT id, CASE WHEN starts_with(file_path, 'europe/france/') OR file_path = 'europe/france' THEN NULL WHEN starts_with(file_path, 'europe/') OR file_path = 'europe' THEN 'team-eu' WHEN starts_with(file_path, 'asia/') OR file_path = 'asia' THEN 'team-asia' END AS owner FROM nodes
WHERE owner IS NOT NULL""")
def _(s, d):
    return c.codeowners(nodes(s, d), [("asia", "team-asia"), ("europe", "team-eu"), ("europe/france", "")])
