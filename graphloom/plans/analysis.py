"""Queries: impact, cycles, processes, risk, coverage, concurrency and data flow."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from graphloom.operators import analysis as a
from graphloom.operators import traverse
from graphloom.operators.communities import Partition
from graphloom.operators.graph_stats import package
from graphloom.plans.algorithms import _PARTS, _parts
from graphloom.plans.registry import query
from graphloom.sources.model import EDGES_SQL, GRAPH_SQL, NODES_SQL, edges, nodes, table

_REC = f"WITH RECURSIVE {NODES_SQL}, {EDGES_SQL}"
_DEG = GRAPH_SQL + """, deg AS (SELECT n.id, n.kind, n.name, n.file_path, n.repo_prefix, coalesce(i.c, 0)::BIGINT AS fan_in, coalesce(o.c, 0)::BIGINT AS fan_out
  FROM nodes n LEFT JOIN (SELECT dst, count(*) AS c FROM edges GROUP BY dst) i ON i.dst = n.id LEFT JOIN (SELECT src, count(*) AS c FROM edges GROUP BY src) o ON o.src = n.id)"""


@query("change_impact", GRAPH_SQL + """, e AS (SELECT dst AS at, src AS nxt, min((kind = 'contains' AND weight = 1 AND src LIKE '%3')::INT) AS weak FROM edges GROUP BY ALL),
s AS (SELECT id AS seed FROM nodes WHERE kind IN ('supplier', 'region')), t1 AS (SELECT DISTINCT seed, nxt AS at FROM s JOIN e ON e.at = seed),
t2 AS (SELECT DISTINCT t1.seed, nxt AS at FROM t1 JOIN e ON e.at = t1.at WHERE weak = 0 EXCEPT SELECT * FROM t1 EXCEPT SELECT seed, seed FROM s),
t3 AS (SELECT DISTINCT t2.seed, nxt AS at FROM t2 JOIN e ON e.at = t2.at WHERE weak = 0 EXCEPT SELECT * FROM t1 EXCEPT SELECT * FROM t2 EXCEPT SELECT seed, seed FROM s),
x AS (SELECT seed, (SELECT count(*) FROM t1 WHERE t1.seed = s.seed) AS tier1, (SELECT count(*) FROM t2 WHERE t2.seed = s.seed) AS tier2, (SELECT count(*) FROM t3 WHERE t3.seed = s.seed) AS tier3 FROM s)
SELECT *, tier1 + tier2 + tier3 AS total, tier1 AS direct, CASE WHEN tier1 >= 10 OR tier1 + tier2 + tier3 >= 20 THEN 'CRITICAL' WHEN tier1 >= 5 OR tier1 + tier2 + tier3 >= 10 THEN 'HIGH' WHEN tier1 >= 2 OR tier1 + tier2 + tier3 >= 4 THEN 'MEDIUM' ELSE 'LOW' END AS risk FROM x""")
def _(s, d):
    weak = (F.col("kind") == "contains") & (F.col("weight") == 1) & F.col("src").like("%3")
    return a.impact(nodes(s, d).where("kind in ('supplier', 'region')"), edges(s, d), weak)


@query("dependency_cycles", f"""WITH RECURSIVE {_PARTS}, r AS (SELECT src AS a, dst AS b FROM pe UNION SELECT r.a, pe.dst FROM r JOIN pe ON pe.src = r.b),
n AS (SELECT src AS id FROM pe UNION SELECT dst FROM pe), c AS (SELECT n.id, least(n.id, coalesce(min(x.b), n.id)) AS component FROM n LEFT JOIN (SELECT r.a, r.b FROM r JOIN r q ON q.a = r.b AND q.b = r.a) x ON x.a = n.id GROUP BY n.id),
z AS (SELECT component, count(*) AS size, count(DISTINCT p_brand) AS spread FROM c JOIN part ON p_partkey::VARCHAR = id GROUP BY 1 HAVING count(*) >= 2),
h AS (SELECT c1.component, max((pe.weight >= 3)::INT) AS hard FROM pe JOIN c c1 ON c1.id = src JOIN c c2 ON c2.id = dst WHERE c1.component = c2.component GROUP BY 1)
SELECT component, size, CASE WHEN hard = 1 THEN 'import' WHEN spread > 1 THEN 'cross_community' ELSE 'call' END AS kind, CASE WHEN hard = 1 THEN 3 WHEN spread > 1 THEN 2 ELSE 1 END AS severity FROM z JOIN h USING (component)""")
def _(s, d):
    e = _parts(s, d).withColumn("kind", F.when(F.col("weight") >= 3, "import").otherwise("call"))
    ids = e.select(F.explode(F.array("src", "dst")).alias("id")).distinct()
    brand = table(s, d, "part").select(F.col("p_partkey").cast("string").alias("id"), F.col("p_brand").alias("community"))
    return a.cycles(ids, e, brand, ["import"])


def _name_sql():
    return "CASE " + " ".join(f"WHEN regexp_matches(name, '{p}') THEN {w}" for p, w in a.NAME_FACTORS) + " ELSE 1.0 END"


_ENTRY = f"round(fan_out / (fan_in + 1) * {_name_sql()} * CASE WHEN regexp_matches(name, '^[A-Z]') THEN 1.5 ELSE 1.0 END * CASE WHEN fan_in = 0 THEN 2.0 WHEN fan_in <= 2 THEN 1.3 ELSE 1.0 END, 6)"


@query("entry_points", _DEG + f" SELECT id, {_ENTRY} AS score FROM deg WHERE fan_out > 0 AND {_ENTRY} > 0.5")
def _(s, d):
    return a.entry_scores(nodes(s, d), edges(s, d))


@query("process_discovery", _DEG.replace("WITH", "WITH RECURSIVE", 1) + f""", en AS (SELECT id FROM deg WHERE fan_out > 0 AND {_ENTRY} > 0.5 ORDER BY {_ENTRY} DESC, id LIMIT 50),
w(entry, node_id, depth) AS (SELECT id, id, 0 FROM en UNION SELECT entry, dst, depth + 1 FROM w JOIN edges ON src = node_id WHERE depth < 15)
SELECT entry, node_id, min(depth) AS depth FROM w GROUP BY ALL""")
def _(s, d):
    n, e = nodes(s, d), edges(s, d)
    return a.processes(a.entry_scores(n, e), e, steps=100_000)


_CHANGE = """WITH l AS (SELECT l_orderkey AS change, l_partkey, l_returnflag, p_name, p_brand, c.uses FROM lineitem JOIN part ON p_partkey = l_partkey JOIN (SELECT l_partkey AS k, count(*) AS uses FROM lineitem GROUP BY 1) c ON c.k = l_partkey),
c AS (SELECT change, count(DISTINCT l_partkey) AS flow, sum(uses) AS callers, max(p_name LIKE 'red%') AS security, count(*) FILTER (l_returnflag = 'R') AS covered, count(*) AS symbols, count(DISTINCT p_brand) AS communities FROM l GROUP BY 1),
x AS (SELECT change, least(10.0 * flow, 100) AS flow_axis, least(2.0 * callers, 100) AS callers_axis, CASE WHEN security THEN 80.0 ELSE 0.0 END AS security_axis, round(100.0 * (symbols - covered) / symbols, 6) AS coverage_axis, least(20.0 * (communities - 1), 100) AS community_axis FROM c),
y AS (SELECT *, (list_extract(o, 1) + list_extract(o, 2)) / 2 AS sc FROM (SELECT *, list_reverse_sort([flow_axis::DOUBLE, callers_axis::DOUBLE, security_axis::DOUBLE, coverage_axis::DOUBLE, community_axis::DOUBLE]) AS o FROM x))
SELECT change, flow_axis::DOUBLE AS flow_axis, callers_axis::DOUBLE AS callers_axis, security_axis::DOUBLE AS security_axis, coverage_axis::DOUBLE AS coverage_axis, community_axis::DOUBLE AS community_axis, round(sc, 6) AS score,
  CASE WHEN sc >= 85 THEN 'CRITICAL' WHEN sc >= 60 OR security_axis >= 70 OR (flow_axis >= 50 AND callers_axis >= 50) THEN 'HIGH' WHEN sc >= 30 THEN 'MEDIUM' ELSE 'LOW' END AS level FROM y"""


@query("pr_risk", _CHANGE)
def _(s, d):
    line = table(s, d, "lineitem")
    uses = line.groupBy("l_partkey").agg(F.count(F.lit(1)).alias("uses"))
    p = table(s, d, "part").select(F.col("p_partkey").alias("l_partkey"), "p_name", "p_brand").join(uses, "l_partkey")
    l = line.select(F.col("l_orderkey").alias("change"), "l_partkey", "l_returnflag").join(p, "l_partkey")
    c = l.groupBy("change").agg(
        F.countDistinct("l_partkey").alias("flow"), F.sum("uses").alias("callers"), F.max(F.col("p_name").like("red%")).alias("security"),
        F.count_if(F.col("l_returnflag") == "R").alias("covered"), F.count(F.lit(1)).alias("symbols"), F.countDistinct("p_brand").alias("communities"),
    )
    return a.pr_risk(c)


_COVER = """WITH sym AS (SELECT p_brand AS file, p_partkey::VARCHAR AS name, (p_partkey % 100) * 10 AS lo, (p_partkey % 100) * 10 + 3 + p_size % 7 AS hi FROM part),
ln AS (SELECT p_brand AS file, (l_partkey % 100) * 10 + l_linenumber AS line, count(*) AS statements, max(l_returnflag = 'R') AS hit FROM lineitem JOIN part ON p_partkey = l_partkey GROUP BY ALL),
cov AS (SELECT sym.file, name, sum(statements)::BIGINT AS statements, sum(CASE WHEN hit THEN statements ELSE 0 END)::BIGINT AS covered, round(100.0 * sum(CASE WHEN hit THEN statements ELSE 0 END) / sum(statements), 6) AS percent
  FROM sym JOIN ln ON ln.file = sym.file AND line BETWEEN lo AND hi GROUP BY ALL)"""


def _coverage(s, d):
    p = table(s, d, "part")
    lo = (F.col("p_partkey") % 100) * 10
    sym = p.select(F.col("p_brand").alias("file"), F.col("p_partkey").cast("string").alias("name"), lo.alias("lo"), (lo + 3 + F.col("p_size") % 7).alias("hi"))
    line = table(s, d, "lineitem").join(p.select(F.col("p_partkey").alias("l_partkey"), F.col("p_brand").alias("file")), "l_partkey")
    hits = line.select("file", ((F.col("l_partkey") % 100) * 10 + F.col("l_linenumber")).alias("line"), F.lit(1).alias("statements"), (F.col("l_returnflag") == "R").alias("hit"))
    return a.symbol_coverage(sym, hits)


@query("coverage", _COVER + " SELECT * FROM cov")
def _(s, d):
    return _coverage(s, d)


@query("coverage_summary", _COVER + " SELECT file, count(*) AS symbols, round(100.0 * sum(covered) / sum(statements), 6) AS percent FROM cov GROUP BY file")
def _(s, d):
    return _coverage(s, d).groupBy("file").agg(F.count(F.lit(1)).alias("symbols"), F.round(100.0 * F.sum("covered") / F.sum("statements"), 6).alias("percent"))


@query("coverage_gaps", _COVER + " SELECT file, name, percent FROM cov WHERE percent < 60 AND statements >= 10")
def _(s, d):
    return _coverage(s, d).where("percent < 60 and statements >= 10").select("file", "name", "percent")


@query("fix_prone_files", "SELECT user_id AS file, count(*) FILTER (regexp_matches(event_type, '(?i)\\b(fix|bug|error|revert)')) AS fixes, count(*) AS touches FROM events GROUP BY 1 HAVING count(*) FILTER (regexp_matches(event_type, '(?i)\\b(fix|bug|error|revert)')) > 0")
def _(s, d):
    fix = F.col("event_type").rlike(r"(?i)\b(fix|bug|error|revert)")
    return table(s, d, "events").groupBy(F.col("user_id").alias("file")).agg(F.count_if(fix).alias("fixes"), F.count(F.lit(1)).alias("touches")).where("fixes > 0")


_BOTTLE = """4 * (p_size % 4) + 5 * (p_partkey % 3) + CASE WHEN p_size >= 15 THEN p_size ELSE 0 END + CASE WHEN p_partkey % 20 >= 10 THEN (p_partkey % 20) // 2 ELSE 0 END
  + CASE WHEN p_partkey % 11 = 0 AND p_size % 4 > 0 THEN 8 WHEN p_partkey % 11 = 0 THEN 3 ELSE 0 END + CASE WHEN p_type = 'PROMO' THEN 6 ELSE 0 END"""


@query("bottlenecks", f"SELECT p_partkey AS id, ({_BOTTLE})::BIGINT AS score FROM part WHERE ({_BOTTLE}) > 0")
def _(s, d):
    k, z = F.col("p_partkey"), F.col("p_size")
    return a.bottlenecks(table(s, d, "part").select(
        k.alias("id"), (z % 4).alias("loops"), (k % 3).alias("below"), z.alias("cognitive"), (k % 20).alias("cyclomatic"), (k % 11 == 0).alias("recursion"), (F.col("p_type") == "PROMO").alias("scans")
    ))


@query("health_score", _DEG + """, u AS (SELECT id, split_part(file_path, '/', 1) AS unit FROM nodes),
m AS (SELECT unit, count(*) AS members, count(*) FILTER (fan_in + fan_out = 0) AS lone, count(*) FILTER (fan_in >= 20) AS hubs FROM deg JOIN u USING (id) GROUP BY 1),
o AS (SELECT x.unit, count(*) AS out, count(*) FILTER (x.unit <> y.unit) AS leaving FROM edges JOIN u x ON x.id = src JOIN u y ON y.id = dst GROUP BY 1),
h AS (SELECT m.unit, members, round(100 - 40 * lone / members - 30 * hubs / members - 30 * coalesce(leaving / out, 0), 6) AS score FROM m LEFT JOIN o USING (unit))
SELECT unit, members, score, CASE WHEN score >= 90 THEN 'A' WHEN score >= 75 THEN 'B' WHEN score >= 60 THEN 'C' WHEN score >= 40 THEN 'D' ELSE 'F' END AS grade FROM h""")
def _(s, d):
    return a.health(nodes(s, d), edges(s, d))


@query("zero_edge_class", GRAPH_SQL + """, e AS (SELECT src, dst FROM edges WHERE weight >= 2), t AS (SELECT src AS id FROM e UNION SELECT dst FROM e),
x AS (SELECT id, kind, id NOT IN (SELECT id FROM t) AS alone, repo_prefix <> 'ASIA' AS covered FROM nodes), k AS (SELECT kind, 2 * count(*) FILTER (NOT alone) >= count(*) AS rule FROM x GROUP BY 1)
SELECT id, CASE WHEN NOT alone THEN 'none' WHEN NOT covered THEN 'coverage_incomplete' WHEN rule THEN 'likely_unused' ELSE 'possible_extraction_gap' END AS class FROM x JOIN k USING (kind)""")
def _(s, d):
    return a.zero_edges(nodes(s, d), edges(s, d).where("weight >= 2"), F.col("repo_prefix") != "ASIA")


@query("cluster_stats", GRAPH_SQL + """, m AS (SELECT id, split_part(file_path, '/', 1) AS community, file_path, kind FROM nodes),
e AS (SELECT src, dst, x.community FROM edges JOIN m x ON x.id = src JOIN m y ON y.id = dst WHERE x.community = y.community), k AS (SELECT community, id, count(*) AS k FROM (SELECT community, src AS id FROM e UNION ALL SELECT community, dst FROM e) GROUP BY ALL),
h AS (SELECT community, id AS hub FROM k QUALIFY row_number() OVER (PARTITION BY community ORDER BY k DESC, id) = 1), i AS (SELECT community, count(*) AS inside FROM e GROUP BY 1)
SELECT m.community, count(*) AS size, count(DISTINCT file_path) AS files, count(DISTINCT kind) AS kinds, coalesce(any_value(inside), 0)::BIGINT AS inside, round(coalesce(any_value(inside), 0) / greatest(count(*) * (count(*) - 1), 1), 9) AS density, any_value(hub) AS hub
FROM m LEFT JOIN i USING (community) LEFT JOIN h USING (community) GROUP BY m.community""")
def _(s, d):
    n = nodes(s, d)
    return a.cluster_stats(n.select("id", package(F.col("file_path")).alias("community")), n, edges(s, d))


@query("leiden_quality", None)
def _(s, d):
    return Partition(nodes(s, d).select("id"), edges(s, d)).quality()


@query("race_writes", GRAPH_SQL + """, sp AS (SELECT dst AS id FROM edges WHERE kind = 'placed' AND src IN (SELECT id FROM nodes WHERE repo_prefix = 'ASIA')), r AS (SELECT DISTINCT dst AS id FROM edges WHERE kind = 'contains' AND src IN (SELECT id FROM sp))
SELECT DISTINCT dst AS field, src AS writer FROM edges WHERE kind = 'supplied_by' AND src IN (SELECT id FROM r) AND src NOT IN (SELECT id FROM nodes WHERE size % 5 = 0)""")
def _(s, d):
    n, e = nodes(s, d), edges(s, d)
    asia = n.where("repo_prefix = 'ASIA'").select(F.col("id").alias("src"))
    spawned = e.where("kind = 'placed'").join(asia, "src", "left_semi").select(F.col("dst").alias("id"))
    writes = e.where("kind = 'supplied_by'").select(F.col("src").alias("writer"), F.col("dst").alias("field"))
    return a.race_writes(spawned, e.where("kind = 'contains'").select("src", "dst"), writes, n.where("size % 5 = 0").select("id"))


@query("unclosed_channels", "SELECT user_id AS channel, count(*) AS sends FROM events WHERE event_type = 'purchase' AND user_id NOT IN (SELECT user_id FROM events WHERE event_type = 'error' AND value > 100) GROUP BY 1")
def _(s, d):
    e = table(s, d, "events").withColumnRenamed("user_id", "channel")
    return a.unclosed(e.where("event_type = 'purchase'"), e.where("event_type = 'error' and value > 100"))


_FLOW = """b AS (SELECT user_id AS func, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS block, count(*) OVER (PARTITION BY user_id) AS n, event_type AS var, event_id FROM events),
f AS (SELECT func, block AS a, CASE WHEN block = n THEN 1 ELSE block + 1 END AS b FROM b UNION SELECT func, block, block + 2 FROM b WHERE block + 2 <= n AND event_id % 7 = 0),
u AS (SELECT func, block, ['error', 'purchase', 'signup', 'click', 'view'][(event_id % 5)::INT + 1] AS var FROM b),
r AS (SELECT b.func, b.var, b.block AS def_block, f.b AS block FROM b JOIN f ON f.func = b.func AND f.a = b.block
  UNION SELECT r.func, r.var, r.def_block, f.b FROM r JOIN b ON b.func = r.func AND b.block = r.block AND b.var <> r.var JOIN f ON f.func = r.func AND f.a = r.block)"""


def _flow(s, d):
    """Each user's events as the statements of a looping function with some skips: defs, uses, flow."""
    w = Window.partitionBy("user_id").orderBy("ts", "event_id")
    b = table(s, d, "events").select(F.col("user_id").alias("func"), F.row_number().over(w).cast("long").alias("block"), F.count(F.lit(1)).over(Window.partitionBy("user_id")).alias("n"), F.col("event_type").alias("var"), "event_id")
    on = b.select("func", F.col("block").alias("a"), F.when(F.col("block") == F.col("n"), F.lit(1).cast("long")).otherwise(F.col("block") + 1).alias("b"))
    skip = b.where("block + 2 <= n and event_id % 7 = 0").select("func", F.col("block").alias("a"), (F.col("block") + 2).alias("b"))
    used = F.get(F.array(*[F.lit(x) for x in ("error", "purchase", "signup", "click", "view")]), (F.col("event_id") % 5).cast("int"))
    return b.select("func", "block", "var"), b.select("func", "block", used.alias("var")), on.unionByName(skip)


@query("reaching_definitions", f"WITH RECURSIVE {_FLOW} SELECT func, var, def_block, block FROM r")
def _(s, d):
    defs, _, flow = _flow(s, d)
    return a.reaching_definitions(defs, flow)


@query("def_use", f"WITH RECURSIVE {_FLOW} SELECT r.func, r.var, def_block, r.block AS use_block FROM r JOIN u ON u.func = r.func AND u.block = r.block AND u.var = r.var")
def _(s, d):
    return a.def_use(*_flow(s, d))


@query("refined_hops", f"""WITH RECURSIVE {_FLOW}, c AS (SELECT r.func, r.var, def_block, r.block AS use_block FROM r JOIN u ON u.func = r.func AND u.block = r.block AND u.var = r.var),
h AS (SELECT b.func, b.var, b.block AS def_block, u.block AS use_block FROM b JOIN u ON u.func = b.func AND u.var = b.var AND u.block BETWEEN b.block + 1 AND b.block + 6)
SELECT func, var, def_block, use_block, CASE WHEN (func, var, def_block, use_block) IN (SELECT (func, var, def_block, use_block) FROM c) THEN 'confirmed' ELSE 'pruned' END AS state,
  CASE WHEN (func, var, def_block, use_block) IN (SELECT (func, var, def_block, use_block) FROM c) THEN 1.0 ELSE 0.25 END::DOUBLE AS score FROM h""")
def _(s, d):
    defs, uses, flow = _flow(s, d)
    u = uses.withColumnRenamed("block", "use_block").withColumn("def_block", F.explode(F.sequence(F.col("use_block") - 6, F.col("use_block") - 1)))
    hops = u.join(defs.withColumnRenamed("block", "def_block"), ["func", "var", "def_block"]).withColumn("score", F.lit(1.0))
    return a.refine_hops(hops, a.def_use(defs, uses, flow))


@query("paths_to_anchor", _REC + """, w(id, depth) AS (SELECT id, 0 FROM nodes WHERE kind = 'region' UNION SELECT src, depth + 1 FROM w JOIN edges ON dst = w.id WHERE depth < 6)
SELECT id, min(depth) AS distance FROM w GROUP BY 1""")
def _(s, d):
    n = nodes(s, d)
    return traverse.bfs(n.where("kind = 'region'").select("id"), edges(s, d), 6, "in").select(F.col("node_id").alias("id"), F.col("depth").alias("distance"))


@query("closure_ranking", _REC + """, w(id, depth) AS (SELECT id, 0 FROM nodes WHERE kind = 'customer' AND repo_prefix = 'ASIA' UNION SELECT dst, depth + 1 FROM w JOIN edges ON src = w.id WHERE depth < 6),
m AS (SELECT id, min(depth) AS distance FROM w GROUP BY 1), i AS (SELECT dst AS id, count(*) AS c FROM edges GROUP BY 1), x AS (SELECT m.id, distance, coalesce(c, 0) AS c, max(coalesce(c, 0)) OVER () AS top FROM m LEFT JOIN i USING (id))
SELECT id, distance, round(0.6 / (1 + distance) + 0.4 * CASE WHEN c > 0 AND top > 0 THEN ln(1 + c) / ln(1 + top) ELSE 0 END, 6) AS score FROM x""")
def _(s, d):
    from graphloom.sources.scratch import store

    n, e = nodes(s, d), edges(s, d)
    near = traverse.bfs(n.where("kind = 'customer' and repo_prefix = 'ASIA'").select("id"), e, 6).select(F.col("node_id").alias("id"), F.col("depth").alias("distance"))
    fan = e.groupBy(F.col("dst").alias("id")).agg(F.count(F.lit(1)).alias("c"))
    x = store(near.join(fan, "id", "left").fillna(0, ["c"]), "closure")
    x = x.crossJoin(F.broadcast(x.agg(F.max("c").alias("top"))))  # one row
    return x.select("id", "distance", F.round(0.6 / (1 + F.col("distance")) + 0.4 * a.norm_log(F.col("c"), F.col("top")), 6).alias("score"))


@query("boundary_lists", GRAPH_SQL + """, x AS (SELECT DISTINCT split_part(a.file_path, '/', 1) AS package, 'callee' AS side, dst AS id FROM edges JOIN nodes a ON a.id = src JOIN nodes b ON b.id = dst WHERE split_part(a.file_path, '/', 1) <> split_part(b.file_path, '/', 1)
  UNION SELECT split_part(b.file_path, '/', 1), 'caller', src FROM edges JOIN nodes a ON a.id = src JOIN nodes b ON b.id = dst WHERE split_part(a.file_path, '/', 1) <> split_part(b.file_path, '/', 1))
SELECT package, side, id FROM x QUALIFY row_number() OVER (PARTITION BY package, side ORDER BY id) <= 50""")
def _(s, d):
    at = nodes(s, d).select("id", package(F.col("file_path")).alias("p"))
    e = edges(s, d).select("src", "dst").join(at.toDF("src", "a"), "src").join(at.toDF("dst", "b"), "dst").where("a <> b")
    sides = e.select(F.explode(F.array(F.struct(F.col("a").alias("package"), F.lit("callee").alias("side"), F.col("dst").alias("id")), F.struct(F.col("b").alias("package"), F.lit("caller").alias("side"), F.col("src").alias("id")))).alias("x")).select("x.*").distinct()
    w = Window.partitionBy("package", "side").orderBy("id")
    return sides.withColumn("rn", F.row_number().over(w)).where("rn <= 50").drop("rn")
