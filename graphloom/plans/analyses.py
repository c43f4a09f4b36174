"""Queries: the analyses by name, line rules, signature and event boundaries, code functions, the Engine."""

from __future__ import annotations

from pyspark.sql import functions as F

from graphloom.engine import Engine
from graphloom.functions import code
from graphloom.operators import analyses as a
from graphloom.plans.registry import query
from graphloom.sources.model import EDGES_SQL, GRAPH_SQL, NODES_SQL, edges, nodes, table

_KINDS = sorted({k for kinds, _ in a.ROLLUPS.values() for k in kinds})
_E = f"""e AS (SELECT 'f/' || user_id AS src, 't/' || (event_id % 37) AS dst, list_extract({_KINDS}, (event_id % {len(_KINDS)})::INT + 1) AS kind, event_type, ts, value FROM events)"""


def _event_edges(s, d):
    """The event log as a graph: users are files, ids give targets and one of the kinds that the analyses name."""
    e, k = table(s, d, "events"), F.col("event_id")
    kind = F.get(F.array(*[F.lit(x) for x in _KINDS]), (k % len(_KINDS)).cast("int"))
    return e.select(F.concat(F.lit("f/"), F.col("user_id").cast("string")).alias("src"), F.concat(F.lit("t/"), (k % 37).cast("string")).alias("dst"), kind.alias("kind"), "event_type", "ts", "value")


_MAP = ", ".join(f"('{n}', '{k}', {str(side == 'dst').lower()})" for n, (kinds, side) in a.ROLLUPS.items() for k in kinds)


@query("analyze_rollups", f"""WITH {_E}, m(analysis, kind, by_target) AS (VALUES {_MAP})
SELECT analysis, CASE WHEN by_target THEN dst ELSE src END AS subject, count(*) AS uses, count(DISTINCT CASE WHEN by_target THEN src ELSE dst END) AS others FROM e JOIN m USING (kind) GROUP BY ALL""")
def _(s, d):
    return a.rollups(_event_edges(s, d))


@query("channel_ops", f"WITH {_E} SELECT dst, count(*) FILTER (event_type = 'purchase') AS gives, count(*) FILTER (event_type = 'signup' AND value > 90) AS takes, count(*) FILTER (event_type = 'purchase') = 0 OR count(*) FILTER (event_type = 'signup' AND value > 90) = 0 AS mismatch FROM (SELECT src, src || dst AS dst, event_type, value FROM e) WHERE event_type = 'purchase' OR (event_type = 'signup' AND value > 90) GROUP BY dst")
def _(s, d):
    e = _event_edges(s, d).where("event_type = 'purchase' or (event_type = 'signup' and value > 90)")
    return a.two_sided(e.select("src", F.concat("src", "dst").alias("dst"), F.col("event_type").alias("kind")), ["purchase"], ["signup"])


@query("orphan_tables", f"WITH {_E} SELECT dst AS id, count(*) AS uses FROM e WHERE kind IN ('queries', 'models_table') AND dst NOT IN (SELECT 't/' || n_nationkey FROM nation) GROUP BY 1")
def _(s, d):
    provided = table(s, d, "nation").select(F.concat(F.lit("t/"), F.col("n_nationkey").cast("string")).alias("id"))
    return a.dangling(_event_edges(s, d), provided, ["queries", "models_table"])


@query("unreferenced_tables", f"WITH {_E} SELECT DISTINCT 't/' || c_custkey AS id FROM customer WHERE 't/' || c_custkey NOT IN (SELECT dst FROM e WHERE kind = 'queries')")
def _(s, d):
    provided = table(s, d, "customer").select(F.concat(F.lit("t/"), F.col("c_custkey").cast("string")).alias("id"))
    return a.unreferenced(provided, _event_edges(s, d), ["queries"])


@query("stale_flags", "WITH n AS (SELECT max(ts) AS m FROM events) SELECT event_id % 3989 AS flag, count(*) AS n FROM events, n GROUP BY 1 HAVING max(ts) < any_value(m) - INTERVAL 2 DAY")
def _(s, d):
    e = table(s, d, "events").withColumn("flag", F.col("event_id") % 3989)
    last = e.agg(F.max("ts")).first()[0]
    return a.stale(e, "flag", "ts", F.lit(last) - F.expr("INTERVAL 2 DAYS"))


@query("scan_lines", "WITH l AS (SELECT doc_id AS key, unnest(string_split(text, chr(10))) AS t, unnest(range(1, len(string_split(text, chr(10))) + 1)) AS line FROM documents) " + " UNION ALL ".join(f"SELECT key, line, '{r}' AS rule, '{v}' AS severity FROM l WHERE regexp_matches(t, '{p}')" for r, v, p in a.LINE_RULES))
def _(s, d):
    return a.scan_lines(table(s, d, "documents"), "doc_id", "text")


@query("signature_breaks", """WITH c AS (SELECT o_orderpriority || l_linenumber AS caller, l_partkey AS callee, (l_quantity % 4)::INT AS args FROM lineitem JOIN orders ON o_orderkey = l_orderkey), f AS (SELECT p_partkey AS id, p_size % 4 AS was, CASE WHEN p_partkey % 50 = 0 THEN NULL WHEN p_partkey % 7 = 0 THEN (p_size + 1) % 4 ELSE p_size % 4 END AS now FROM part)
SELECT DISTINCT caller, callee, CASE WHEN now IS NULL THEN 'removed' ELSE 'arity' END AS reason FROM c JOIN f ON id = callee WHERE (now IS NULL OR now <> was) AND (now IS NULL OR args <> now)""")
def _(s, d):
    p, k = table(s, d, "part"), F.col("p_partkey")
    params = lambda n: F.when(n > 0, F.sequence(F.lit(1), n)).otherwise(F.array().cast("array<int>"))
    old = p.select(k.alias("id"), params(F.col("p_size") % 4).alias("params"))
    new = p.where("p_partkey % 50 <> 0").select(k.alias("id"), params((F.col("p_size") + F.when(k % 7 == 0, 1).otherwise(0)) % 4).alias("params"))
    o = table(s, d, "orders").select(F.col("o_orderkey").alias("l_orderkey"), "o_orderpriority")
    calls = table(s, d, "lineitem").join(o, "l_orderkey").select(F.concat("o_orderpriority", F.col("l_linenumber").cast("string")).alias("caller"), F.col("l_partkey").alias("callee"), (F.col("l_quantity") % 4).cast("int").alias("args"))
    return a.signature_breaks(old, new, calls)


@query("event_boundary", """WITH p AS (SELECT DISTINCT p_brand AS topic, p_type AS d FROM part WHERE p_size > 25), q AS (SELECT DISTINCT p_brand AS topic, p_type AS d FROM part WHERE p_size <= 25)
SELECT p.d AS from_domain, q.d AS to_domain, count(DISTINCT topic) AS topics FROM p JOIN q USING (topic) WHERE p.d <> q.d GROUP BY ALL""")
def _(s, d):
    p = table(s, d, "part").select(F.col("p_partkey").alias("id"), F.col("p_brand").alias("topic"), "p_type", "p_size")
    return a.event_boundary(p.where("p_size > 25"), p.where("p_size <= 25"), F.col("p_type"))


@query("normal_form", """SELECT p_partkey, 'v ( s , 0 ) { return v += 0 ; }' AS form FROM part""")
def _(s, d):
    text = F.concat(F.translate("p_name", " ", "_"), F.lit("(\"a'b\", "), F.col("p_size").cast("string"), F.lit(") { return x"), F.col("p_partkey").cast("string"), F.lit(" += 3.5; }"))
    return table(s, d, "part").select("p_partkey", F.array_join(code.normal_form(text), " ").alias("form"))


@query("test_stems", """WITH p AS (SELECT p_partkey, ['test_' || replace(p_name, ' ', '_') || '.py', replace(p_name, ' ', '') || 'Test.java', replace(p_name, ' ', '-') || '.spec.ts', p_name][(p_partkey % 4)::INT + 1] AS name FROM part)
SELECT p_partkey, lower(regexp_replace(regexp_replace(name, '\\.[A-Za-z]+$', ''), '(?i)^(test|spec)[_-]?|[_.-]?(test|tests|spec)$', '', 'g')) AS stem FROM p""")
def _(s, d):
    n, k = F.col("p_name"), F.col("p_partkey") % 4
    name = F.when(k == 0, F.concat(F.lit("test_"), F.translate(n, " ", "_"), F.lit(".py"))).when(k == 1, F.concat(F.translate(n, " ", ""), F.lit("Test.java"))).when(k == 2, F.concat(F.translate(n, " ", "-"), F.lit(".spec.ts"))).otherwise(n)
    return table(s, d, "part").select("p_partkey", code.test_stem(name).alias("stem"))


@query("savings_by_day", "SELECT strftime(ts, '%Y-%m-%d') AS day, round(avg(CASE WHEN value > 0 THEN least(greatest(100.0 * (value - 40) / value, 0), 100) ELSE 0 END), 6) AS saved FROM events GROUP BY 1")
def _(s, d):
    e = table(s, d, "events")
    return e.groupBy(F.date_format("ts", "yyyy-MM-dd").alias("day")).agg(F.round(F.avg(code.savings(F.col("value"), F.lit(40.0))), 6).alias("saved"))


@query("plain_types", "SELECT p_partkey, replace(p_name, ' ', '') AS type FROM part")
def _(s, d):
    n, k = F.translate("p_name", " ", ""), F.col("p_partkey") % 4
    name = F.when(k == 0, F.concat(F.lit("const "), n, F.lit(" &"))).when(k == 1, F.concat(F.lit("std::unique_ptr<const "), n, F.lit(">"))).when(k == 2, F.concat(F.lit("struct "), n, F.lit(" **"))).otherwise(F.concat(F.lit("shared_ptr< "), n, F.lit(" >&")))
    return table(s, d, "part").select("p_partkey", code.plain_type(name).alias("type"))


@query("merged_counts", "SELECT day, list_sort(list(event_type || '=' || n)) AS counts FROM (SELECT strftime(ts, '%Y-%m-%d') AS day, event_type, sum(k)::BIGINT AS n FROM (SELECT ts, event_type, json_extract(props, '$.k')::INT AS k FROM events) GROUP BY ALL) GROUP BY day")
def _(s, d):
    e = table(s, d, "events").select(F.date_format("ts", "yyyy-MM-dd").alias("day"), F.create_map("event_type", F.get_json_object("props", "$.k").cast("long")).alias("counts"))
    out = code.merge_counts(e, "day", "counts")
    return out.select("day", F.array_sort(F.transform(F.map_entries("counts"), lambda x: F.concat_ws("=", x["key"], x["value"].cast("string")))).alias("counts"))


_REC = f"WITH RECURSIVE {NODES_SQL}, {EDGES_SQL}"


def _engine(s, d):
    return Engine(nodes(s, d), edges(s, d), calls=["contains"], references=["supplied_by"], imports=["located_in"], implements=["located_in"])


@query("engine_callers", _REC + """, w(id, depth) AS (SELECT 'supplier:3', 0 UNION SELECT src, depth + 1 FROM w JOIN edges ON dst = w.id WHERE depth < 2 AND kind IN ('contains', 'supplied_by'))
SELECT id AS node_id, min(depth) AS depth FROM w GROUP BY 1 HAVING min(depth) > 0""")
def _(s, d):
    return _engine(s, d).callers("supplier:3", depth=2).select("node_id", "depth")


@query("engine_call_chain", _REC + """, w(id, depth) AS (SELECT 'order:7', 0 UNION SELECT dst, depth + 1 FROM w JOIN edges ON src = w.id WHERE depth < 3 AND kind = 'contains')
SELECT id AS node_id, min(depth) AS depth FROM w GROUP BY 1 HAVING min(depth) > 0""")
def _(s, d):
    return _engine(s, d).call_chain("order:7").select("node_id", "depth")


@query("engine_dependents", _REC + """, w(id, depth) AS (SELECT 'part:5', 0 UNION SELECT src, depth + 1 FROM w JOIN edges ON dst = w.id WHERE depth < 2)
SELECT id AS node_id, min(depth) AS depth FROM w GROUP BY 1 HAVING min(depth) > 0""")
def _(s, d):
    return _engine(s, d).dependents("part:5", depth=2).select("node_id", "depth")


@query("engine_usages", GRAPH_SQL + " SELECT src, dst, kind FROM edges WHERE dst = 'part:5' AND kind IN ('contains', 'supplied_by') ORDER BY src, kind LIMIT 30")
def _(s, d):
    return _engine(s, d).usages("part:5", limit=30).select("src", "dst", "kind")


@query("engine_implementations", _REC + """, w(id, depth) AS (SELECT 'region:1', 0 UNION SELECT src, depth + 1 FROM w JOIN edges ON dst = w.id WHERE depth < 8 AND kind = 'located_in')
SELECT id AS node_id, min(depth) AS depth FROM w GROUP BY 1 HAVING min(depth) > 0""")
def _(s, d):
    return _engine(s, d).implementations("region:1").select("node_id", "depth")
