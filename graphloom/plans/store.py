"""Queries: projections and mutations of the graph store, side tables and change routing."""

from __future__ import annotations

from pyspark.sql import functions as F

from graphloom.operators.store import GraphStore, SideTable, route, subtrees_changed
from graphloom.plans.registry import query
from graphloom.sources.model import GRAPH_SQL, edges, nodes, table

_LANG = "CASE kind WHEN 'customer' THEN 'go' WHEN 'supplier' THEN 'go' WHEN 'part' THEN 'python' ELSE '' END"
_S = GRAPH_SQL + f", n AS (SELECT *, {_LANG} AS language FROM nodes)"


def _store(s, d) -> GraphStore:
    return GraphStore(nodes(s, d).withColumn("language", F.expr(_LANG)), edges(s, d))


def _big(s, d):
    """Ids of large parts and of all suppliers."""
    return nodes(s, d).where("kind = 'supplier' or (kind = 'part' and size > 45)").select("id")


_BIG = "(SELECT id FROM nodes WHERE kind = 'supplier' OR (kind = 'part' AND size > 45))"


@query("store_point_lookup", _S + f" SELECT id, kind, name, repo_prefix FROM n WHERE id IN {_BIG}")
def _(s, d):
    return _store(s, d).by_ids(_big(s, d)).select("id", "kind", "name", "repo_prefix")


@query("store_by_language", _S + " SELECT id, name FROM n WHERE language = 'go' AND kind = 'customer' AND repo_prefix = 'ASIA'")
def _(s, d):
    return _store(s, d).by_language("go", ["customer"], "ASIA").select("id", "name")


@query("store_has_language", "SELECT 'go' AS language, true AS present UNION ALL SELECT 'cobol', false")
def _(s, d):
    g = _store(s, d)
    return s.createDataFrame([(x, g.has_language(x)) for x in ("go", "cobol")], "language string, present boolean")


@query("store_names_bounded", _S + """, x AS (SELECT id, name, row_number() OVER (PARTITION BY name ORDER BY id) AS rn, count(*) OVER (PARTITION BY name) AS m FROM n WHERE name IN (SELECT name FROM n WHERE kind = 'part' AND size > 40) AND language = 'python')
SELECT id, name, m > 3 AS truncated FROM x WHERE rn <= 3""")
def _(s, d):
    g = _store(s, d)
    return g.by_names(g.nodes.where("kind = 'part' and size > 40"), 3, languages=["python"]).select("id", "name", "truncated")


@query("store_names_in_repo", _S + " SELECT id, name FROM n WHERE repo_prefix = 'EUROPE' AND name IN (SELECT name FROM n WHERE kind = 'supplier')")
def _(s, d):
    g = _store(s, d)
    return g.by_names(g.nodes.where("kind = 'supplier'"), 1000, repo="EUROPE").select("id", "name")


@query("store_file_nodes_bounded", _S + """, x AS (SELECT id, file_path, row_number() OVER (PARTITION BY file_path ORDER BY id) AS rn, count(*) OVER (PARTITION BY file_path) AS m FROM n WHERE file_path IN (SELECT file_path FROM n WHERE kind = 'supplier'))
SELECT id, file_path, m > 2 AS truncated FROM x WHERE rn <= 2""")
def _(s, d):
    g = _store(s, d)
    return g.by_files(g.nodes.where("kind = 'supplier'"), 2).select("id", "file_path", "truncated")


@query("store_scope", _S + " SELECT id, kind FROM n WHERE repo_prefix = 'ASIA' AND (file_path = 'asia' OR starts_with(file_path, 'asia/'))")
def _(s, d):
    return _store(s, d).in_scope("ASIA", "asia").select("id", "kind")


@query("store_scope_edges", _S + ", i AS (SELECT id FROM n WHERE repo_prefix = 'ASIA') SELECT src, dst, kind FROM edges WHERE src IN (SELECT id FROM i) AND dst IN (SELECT id FROM i)")
def _(s, d):
    return _store(s, d).edges_in_scope("ASIA").select("src", "dst", "kind")


@query("store_placements", _S + f" SELECT id, repo_prefix, file_path FROM n WHERE id IN {_BIG}")
def _(s, d):
    return _store(s, d).placements(_big(s, d))


@query("store_search_keys", _S + " SELECT id, name FROM n WHERE id > 'part:2' ORDER BY id LIMIT 100")
def _(s, d):
    return _store(s, d).search_keys("part:2", 100)


@query("store_repo_paths", _S + " SELECT DISTINCT file_path FROM n WHERE repo_prefix = 'AMERICA'")
def _(s, d):
    return _store(s, d).repo_paths("AMERICA")


@query("store_language_counts", _S + " SELECT repo_prefix, language, count(*) AS symbols, count(DISTINCT file_path) AS files FROM n GROUP BY ALL")
def _(s, d):
    return _store(s, d).language_counts()


@query("store_file_counts", _S + " SELECT file_path, count(*) AS nodes FROM n WHERE repo_prefix = 'ASIA' GROUP BY 1")
def _(s, d):
    return _store(s, d).file_counts("ASIA")


@query("store_orphan_prefixes", _S + " SELECT repo_prefix, count(*) AS nodes FROM n WHERE repo_prefix NOT IN ('', 'ASIA', 'EUROPE') GROUP BY 1")
def _(s, d):
    return _store(s, d).orphan_prefixes(s.createDataFrame([("ASIA",), ("EUROPE",)], "repo_prefix string"))


@query("store_prefix_diagnostics", _S + " SELECT kind, count(*) FILTER (repo_prefix = '') AS unprefixed, count(*) FILTER (repo_prefix <> '') AS prefixed FROM n GROUP BY 1")
def _(s, d):
    return _store(s, d).prefix_diagnostics()


@query("store_count_at_least", _S + " SELECT kind, least AS least, (SELECT count(*) FROM n WHERE n.kind = w.kind) >= least AS enough FROM (VALUES ('region', 5), ('region', 6), ('order', 100)) w(kind, least)")
def _(s, d):
    g = _store(s, d)
    return s.createDataFrame([(k, m, g.count_at_least(k, m)) for k, m in (("region", 5), ("region", 6), ("order", 100))], "kind string, least int, enough boolean")


@query("store_edge_page", _S + " SELECT src, dst, kind FROM edges WHERE kind IN ('placed', 'located_in') AND (src, dst, kind) > ('customer:3', 'order:2', 'placed') ORDER BY src, dst, kind LIMIT 200")
def _(s, d):
    return _store(s, d).edge_page(["placed", "located_in"], ("customer:3", "order:2", "placed"), 200)


@query("store_incoming_bounded", _S + f""", x AS (SELECT src, dst, kind, row_number() OVER (PARTITION BY dst ORDER BY src, kind) AS rn, count(*) OVER (PARTITION BY dst) AS m FROM edges WHERE dst IN {_BIG})
SELECT src, dst, kind, m > 4 AS truncated FROM x WHERE rn <= 4""")
def _(s, d):
    return _store(s, d).incoming(_big(s, d), most=4)


@query("store_outgoing_bounded", _S + f""", x AS (SELECT src, dst, kind, row_number() OVER (PARTITION BY src ORDER BY dst, kind) AS rn, count(*) OVER (PARTITION BY src) AS m FROM edges WHERE src IN {_BIG} AND kind = 'supplied_by')
SELECT src, dst, kind, m > 4 AS truncated FROM x WHERE rn <= 4""")
def _(s, d):
    return _store(s, d).outgoing(_big(s, d), ["supplied_by"], 4)


@query("store_incoming_sources", _S + f""", y AS (SELECT DISTINCT src, dst FROM edges WHERE dst IN {_BIG} AND kind IN ('contains', 'supplied_by')), x AS (SELECT *, row_number() OVER (PARTITION BY dst ORDER BY src) AS rn, count(*) OVER (PARTITION BY dst) AS m FROM y)
SELECT src, dst, m > 5 AS truncated FROM x WHERE rn <= 5""")
def _(s, d):
    return _store(s, d).incoming_sources(_big(s, d), ["contains", "supplied_by"], 5)


_PROBE = "SELECT 'customer:' || c_custkey AS src, 'nation:' || (c_custkey % 25) AS dst, 'located_in' AS kind FROM customer"


def _probe(s, d):
    k = F.col("c_custkey")
    return table(s, d, "customer").select(F.concat(F.lit("customer:"), k.cast("string")).alias("src"), F.concat(F.lit("nation:"), (k % 25).cast("string")).alias("dst"), F.lit("located_in").alias("kind"))


@query("store_existing_edges", _S + f", p AS ({_PROBE}) SELECT src, dst, kind, (src, dst, kind) IN (SELECT (src, dst, kind) FROM edges) AS exists FROM p")
def _(s, d):
    return _store(s, d).existing(_probe(s, d))


@query("store_by_identities", _S + f", p AS ({_PROBE}) SELECT e.src, e.dst, e.kind, e.weight FROM edges e JOIN p USING (src, dst, kind)")
def _(s, d):
    return _store(s, d).by_identities(_probe(s, d)).select("src", "dst", "kind", "weight")


@query("store_edges_of_files", _S + " SELECT src, dst, kind FROM edges WHERE kind = 'placed' AND src IN (SELECT id FROM n WHERE file_path IN (SELECT file_path FROM n WHERE repo_prefix = 'ASIA'))")
def _(s, d):
    g = _store(s, d)
    return g.edges_of_files(g.repo_paths("ASIA"), ["placed"]).select("src", "dst", "kind")


@query("store_fan_in", _S + f" SELECT id, (SELECT count(*) FROM edges WHERE dst = b.id) AS fan_in FROM {_BIG} b")
def _(s, d):
    return _store(s, d).fan_in(_big(s, d))


@query("store_file_adjacency", _S + " SELECT a.file_path AS from_file, b.file_path AS to_file, count(*) AS edges FROM edges e JOIN n a ON a.id = e.src JOIN n b ON b.id = e.dst WHERE e.kind <> 'contains' AND a.file_path <> b.file_path GROUP BY ALL")
def _(s, d):
    return _store(s, d).file_adjacency(["placed", "located_in", "supplied_by"])


@query("store_file_context", _S + """, f AS (SELECT DISTINCT file_path FROM n WHERE kind IN ('supplier', 'nation')), e AS (SELECT a.file_path AS a, b.file_path AS b FROM edges JOIN n a ON a.id = src JOIN n b ON b.id = dst)
SELECT file_path, (SELECT count(*) FROM n WHERE n.file_path = f.file_path) AS nodes, (SELECT count(*) FROM e WHERE a = file_path AND b = file_path) AS inside,
  (SELECT count(*) FROM e WHERE a = file_path AND b <> file_path) AS outgoing, (SELECT count(*) FROM e WHERE b = file_path AND a <> file_path) AS incoming FROM f""")
def _(s, d):
    g = _store(s, d)
    return g.file_context(g.nodes_by_kinds(["supplier", "nation"]))


@query("store_cross_repo", _S + " SELECT e.kind, count(*) FILTER (a.repo_prefix <> b.repo_prefix AND a.repo_prefix <> '' AND b.repo_prefix <> '') AS crossing, count(*) AS edges FROM edges e JOIN n a ON a.id = src JOIN n b ON b.id = dst GROUP BY 1")
def _(s, d):
    return _store(s, d).mark_cross_repo().groupBy("kind").agg(F.count_if("cross_repo").alias("crossing"), F.count(F.lit(1)).alias("edges"))


@query("store_upsert_receipt", _S + """, o AS (SELECT id FROM n WHERE kind = 'part' AND size > 45)
SELECT 'node' AS what, 'changed' AS change, 'part' AS kind, (SELECT count(*) FROM o) AS n UNION ALL SELECT 'node', 'added', 'tag', (SELECT count(*) FROM n WHERE kind = 'nation')""")
def _(s, d):
    g = _store(s, d)
    named = lambda df, name, seq: df.withColumn("name", F.lit(name)).withColumn("seq", F.lit(seq))
    parts = g.nodes.where("kind = 'part' and size > 45")
    tags = g.nodes.where("kind = 'nation'").withColumns({"id": F.concat(F.lit("tag:"), F.col("id")), "kind": F.lit("tag")})
    new = g.upsert_nodes(named(parts, "first", 1).unionByName(named(parts, "last", 2)).unionByName(named(tags, "t", 1)))
    return new.receipt(g)


@query("store_evict_receipt", _S + """, f AS (SELECT DISTINCT file_path FROM n WHERE kind = 'supplier' AND repo_prefix = 'ASIA'), g AS (SELECT id, kind FROM n WHERE file_path IN (SELECT file_path FROM f))
SELECT 'node' AS what, 'removed' AS change, kind, count(*) AS n FROM g GROUP BY kind
UNION ALL SELECT 'edge', 'removed', kind, count(*) FROM edges WHERE src IN (SELECT id FROM g) OR dst IN (SELECT id FROM g) GROUP BY kind""")
def _(s, d):
    g = _store(s, d)
    return g.evict_files(g.nodes.where("kind = 'supplier' and repo_prefix = 'ASIA'")).receipt(g)


@query("store_purge_and_rekey", _S + " SELECT CASE repo_prefix WHEN 'EUROPE' THEN 'EU' ELSE repo_prefix END AS repo_prefix, count(*) AS nodes FROM n WHERE repo_prefix <> 'ASIA' GROUP BY 1")
def _(s, d):
    new = _store(s, d).purge_repo("ASIA").rekey_repo("EUROPE", "EU")
    return new.nodes.groupBy("repo_prefix").agg(F.count(F.lit(1)).alias("nodes"))


@query("store_edge_mutations", _S + f""", p AS ({_PROBE}), x AS (SELECT src, dst, kind FROM edges WHERE NOT (kind = 'supplied_by' AND src IN {_BIG}) UNION SELECT * FROM p EXCEPT SELECT src, dst, kind FROM edges WHERE kind = 'placed' AND src = 'customer:1')
SELECT kind, count(*) AS edges FROM x GROUP BY kind""")
def _(s, d):
    g = _store(s, d)
    new = g.evict_edge_kinds(["supplied_by"], _big(s, d)).insert_edges(_probe(s, d).withColumn("weight", F.lit(1).cast("long")))
    new = new.remove_edges(g.edges.where("kind = 'placed' and src = 'customer:1'"))
    assert (new.revision, new.edge_revision) == (3, 3)
    return new.edges.groupBy("kind").agg(F.count(F.lit(1)).alias("edges"))


_TOUCH = "SELECT 'brand/' || p_brand AS file, p_name AS fact, max(p_size) AS value FROM part WHERE {} GROUP BY ALL"


def _facts(s, d, where):
    p = table(s, d, "part").where(where)
    return p.groupBy(F.concat(F.lit("brand/"), F.col("p_brand")).alias("file"), F.col("p_name").alias("fact")).agg(F.max("p_size").alias("value"))


@query("side_table_set", f"WITH a AS ({_TOUCH.format('p_size < 30')}), b AS ({_TOUCH.format('p_size >= 30')}) SELECT * FROM b UNION ALL SELECT * FROM a WHERE (file, fact) NOT IN (SELECT (file, fact) FROM b)")
def _(s, d):
    return SideTable(_facts(s, d, "p_size < 30"), ("file", "fact")).set(_facts(s, d, "p_size >= 30")).rows


@query("side_table_replace", f"WITH a AS ({_TOUCH.format('p_size < 30')}), b AS ({_TOUCH.format('p_size >= 45')}) SELECT * FROM a WHERE file NOT IN (SELECT file FROM b) UNION ALL SELECT * FROM b")
def _(s, d):
    new = _facts(s, d, "p_size >= 45")
    return SideTable(_facts(s, d, "p_size < 30"), ("file", "fact")).replace_owned(new.select("file"), new).rows


@query("side_table_page", f"WITH a AS ({_TOUCH.format('p_size > 0')}) SELECT * FROM a WHERE file > 'brand/Brand#12' ORDER BY file, fact LIMIT 50")
def _(s, d):
    return SideTable(_facts(s, d, "p_size > 0"), ("file", "fact")).page("brand/Brand#12", 50)


@query("side_table_load", f"WITH a AS ({_TOUCH.format('p_size > 0')}) SELECT * FROM a WHERE file IN ('brand/Brand#1', 'brand/Brand#2')")
def _(s, d):
    t = SideTable(_facts(s, d, "p_size > 0"), ("file", "fact"))
    return t.load(s.createDataFrame([("brand/Brand#1",), ("brand/Brand#2",)], "file string"))


_TREE = "SELECT 'r' || (o_custkey % 7) || '/d' || (o_custkey % 50) || '/' || o_orderkey AS path, o_orderpriority || {} AS hash FROM orders WHERE o_orderkey % {} <> 0"


def _tree(s, d, flip, skip):
    o, k = table(s, d, "orders"), F.col("o_custkey")
    path = F.concat(F.lit("r"), (k % 7).cast("string"), F.lit("/d"), (k % 50).cast("string"), F.lit("/"), F.col("o_orderkey").cast("string"))
    mark = F.when(F.col("o_orderkey") % flip == 1, "x").otherwise("") if flip else F.lit("")
    return o.where(F.col("o_orderkey") % skip != 0).select(path.alias("path"), F.concat("o_orderpriority", mark).alias("hash"))


@query("subtrees_changed", f"""WITH a AS ({_TREE.format("''", 90)}), b AS ({_TREE.format("CASE WHEN o_orderkey % 97 = 1 THEN 'x' ELSE '' END", 91)}),
x AS (SELECT regexp_replace(path, '/[^/]*$', '') AS dir, path, hash FROM a UNION ALL SELECT split_part(path, '/', 1), path, hash FROM a),
y AS (SELECT regexp_replace(path, '/[^/]*$', '') AS dir, path, hash FROM b UNION ALL SELECT split_part(path, '/', 1), path, hash FROM b),
u AS (SELECT dir, list_sort(list(path || hash)) AS h FROM x GROUP BY 1), v AS (SELECT dir, list_sort(list(path || hash)) AS h FROM y GROUP BY 1)
SELECT coalesce(u.dir, v.dir) AS dir, CASE WHEN u.dir IS NULL THEN 'added' WHEN v.dir IS NULL THEN 'removed' ELSE 'changed' END AS change FROM u FULL JOIN v ON u.dir = v.dir WHERE u.h IS DISTINCT FROM v.h""")
def _(s, d):
    return subtrees_changed(_tree(s, d, 0, 90), _tree(s, d, 97, 91))


@query("reindex_route", "SELECT 'small' AS batch, 'incremental' AS route UNION ALL SELECT 'medium', 'scoped' UNION ALL SELECT 'large', 'full'")
def _(s, d):
    o = table(s, d, "orders")
    total = o.count()
    shares = {"small": 50, "medium": 5, "large": 2}
    return s.createDataFrame([(k, route(o.where(F.col("o_orderkey") % n == 0).count(), total)) for k, n in shares.items()], "batch string, route string")
