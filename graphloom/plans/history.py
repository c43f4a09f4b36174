"""Queries: change history (orders as commits, parts as files), ownership and the event log."""

from __future__ import annotations

from pyspark.sql import functions as F

from graphloom.operators import history as h
from graphloom.plans.registry import query
from graphloom.sources.model import table
from graphloom.sources.scratch import pieces

_NOW = "TIMESTAMP '2024-01-31 00:00:00'"
_TOUCH = """WITH line AS (
  SELECT l_orderkey AS commit, l_partkey AS file, o_custkey AS author, o_orderdate AS ts FROM lineitem JOIN orders ON l_orderkey = o_orderkey)
"""


def _touches(s, d):
    o = table(s, d, "orders").select(F.col("o_orderkey").alias("commit"), F.col("o_custkey").alias("author"), F.col("o_orderdate").alias("ts"))
    n = pieces(_rows(s, d))
    line = table(s, d, "lineitem").select(F.col("l_orderkey").alias("commit"), F.col("l_partkey").alias("file"))
    return line.repartition(n, "commit").join(o.repartition(n, "commit"), "commit")


def _rows(s, d):
    return table(s, d, "lineitem").count()


def _now():
    return F.expr(_NOW)


@query("co_change", """WITH t AS (SELECT DISTINCT l_orderkey AS c, l_partkey AS f FROM lineitem),
s AS (SELECT c FROM t GROUP BY c HAVING count(*) BETWEEN 2 AND 40), n AS (SELECT f, count(*) AS n FROM t GROUP BY f),
p AS (SELECT a.f AS a, b.f AS b, count(*) AS together FROM t a JOIN t b ON a.c = b.c AND a.f < b.f WHERE a.c IN (SELECT c FROM s) GROUP BY ALL HAVING count(*) >= 2)
SELECT a, b, together, round(least(together / sqrt(x.n::DOUBLE * y.n), 1), 6) AS score FROM p JOIN n x ON x.f = a JOIN n y ON y.f = b""")
def _(s, d):
    return h.co_change(table(s, d, "lineitem").select(F.col("l_orderkey").alias("commit"), F.col("l_partkey").alias("file")))


@query("churn", _TOUCH + """SELECT file, count(DISTINCT commit) AS commits, count(DISTINCT author) AS authors,
  date_diff('day', min(ts)::DATE, DATE '2024-01-31')::INT AS age_days, date_diff('day', max(ts)::DATE, DATE '2024-01-31')::INT AS idle_days,
  round(count(DISTINCT commit) / greatest(date_diff('day', min(ts)::DATE, DATE '2024-01-31'), 1), 6) AS rate FROM line GROUP BY file""")
def _(s, d):
    return h.churn(_touches(s, d), _now())


@query("ownership", _TOUCH + """, c AS (SELECT file, author, count(DISTINCT commit) AS n FROM line GROUP BY ALL),
m AS (SELECT file, author AS owner, n AS owner_commits, row_number() OVER (PARTITION BY file ORDER BY n DESC, author) AS r FROM c),
l AS (SELECT file, author AS last_author, row_number() OVER (PARTITION BY file ORDER BY ts DESC, commit DESC, author DESC) AS r FROM line)
SELECT file, last_author, owner, owner_commits FROM m JOIN l USING (file) WHERE m.r = 1 AND l.r = 1""")
def _(s, d):
    return h.last_owner(_touches(s, d), _rows(s, d))


@query("added_in_release", """WITH f AS (SELECT l_partkey AS file, min(l_shipdate) AS ts FROM lineitem GROUP BY 1),
r AS (SELECT DISTINCT date_trunc('quarter', l_shipdate)::TIMESTAMP AS ts, strftime(date_trunc('quarter', l_shipdate), '%Y-%m-%d') AS tag FROM lineitem)
SELECT file, min_by(tag, r.ts) AS added_in FROM f LEFT JOIN r ON r.ts >= f.ts GROUP BY file""")
def _(s, d):
    line = table(s, d, "lineitem")
    files = line.groupBy(F.col("l_partkey").alias("file")).agg(F.min("l_shipdate").alias("ts"))
    q = F.date_trunc("quarter", "l_shipdate")
    return h.added_in(files, line.select(q.cast(line.schema["l_shipdate"].dataType).alias("ts"), F.date_format(q, "yyyy-MM-dd").alias("tag")).distinct())


@query("reviewer_rank", """WITH owners AS (SELECT DISTINCT l_partkey AS file, l_suppkey AS person FROM lineitem WHERE l_quantity >= 49),
authors AS (SELECT DISTINCT l_partkey AS file, l_suppkey AS person FROM lineitem WHERE l_discount >= 0.09),
partners AS (SELECT DISTINCT l_partkey AS file, l_suppkey AS person FROM lineitem WHERE l_returnflag = 'R')
SELECT file, person, sum(w)::BIGINT AS score FROM (SELECT *, 3 AS w FROM owners UNION ALL SELECT *, 2 FROM authors UNION ALL SELECT *, 1 FROM partners) GROUP BY ALL""")
def _(s, d):
    x = table(s, d, "lineitem").withColumnsRenamed({"l_partkey": "file", "l_suppkey": "person"})
    return h.reviewers(x.where("l_quantity >= 49"), x.where("l_discount >= 0.09"), x.where("l_returnflag = 'R'"))


@query("pr_conflicts", "SELECT l_partkey AS \"group\", count(DISTINCT l_orderkey) AS items FROM lineitem GROUP BY 1 HAVING count(DISTINCT l_orderkey) > 1")
def _(s, d):
    return h.shared_groups(table(s, d, "lineitem").select(F.col("l_orderkey").alias("item"), F.col("l_partkey").alias("group")))


@query("tool_rollup", "SELECT event_type, count(*) AS calls, sum(value::DECIMAL(18,4))::DOUBLE AS total FROM events GROUP BY 1")
def _(s, d):
    return h.rollup(table(s, d, "events"), "event_type")


@query("retrieval_log", """SELECT event_type, count(*)::BIGINT AS calls, count(*) FILTER (value < 1)::BIGINT AS zero, round(count(*) FILTER (value < 1) / count(*), 6) AS zero_rate,
  list_sort(list(value))[1 + floor(0.5 * (count(*) - 1))::INT] AS p50, list_sort(list(value))[1 + floor(0.95 * (count(*) - 1))::INT] AS p95 FROM events GROUP BY 1""")
def _(s, d):
    return h.retrieval_log(table(s, d, "events"))


@query("frecency", f"""WITH r AS (SELECT user_id, ts, row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, event_id) AS rn FROM events),
s AS (SELECT user_id, sum(exp(-0.6931471805599453 / 3.0 * greatest((epoch_us({_NOW}) - epoch_us(ts)) / 86400000000.0, 0))) AS s FROM r WHERE rn <= 16 GROUP BY 1)
SELECT user_id, round(s, 6) AS frecency, round(1 + least(0.5, s / max(s) OVER () * 0.5), 6) AS boost FROM s""")
def _(s, d):
    return h.frecency(table(s, d, "events"), _now().cast("timestamp"))


@query("streaks", """WITH e AS (SELECT *, sum((event_type = 'error')::INT) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS i FROM events),
r AS (SELECT user_id, i, count(*) AS n FROM e WHERE event_type <> 'error' GROUP BY ALL), l AS (SELECT user_id, max(n) AS longest FROM r GROUP BY 1)
SELECT *, CASE WHEN longest >= 10 THEN 'escalate' WHEN longest >= 6 THEN 'note' ELSE 'none' END AS level FROM l""")
def _(s, d):
    return h.streaks(table(s, d, "events"), "error")


@query("event_windows", """SELECT event_type, count(*) FILTER (ts::DATE = DATE '2024-01-30') AS today, count(*) FILTER (ts >= TIMESTAMP '2024-01-30 12:00:00' - INTERVAL 168 HOURS) AS week, count(*) AS ever FROM events GROUP BY 1""")
def _(s, d):
    return h.windows(table(s, d, "events"), F.expr("TIMESTAMP '2024-01-30 12:00:00'"))


@query("daily_rollup", "SELECT strftime(ts, '%Y-%m-%d') AS day, event_type, count(*) AS n FROM events GROUP BY ALL")
def _(s, d):
    return h.daily(table(s, d, "events"))


@query("duration_buckets", """SELECT bucket, count(*) AS n FROM (SELECT CASE WHEN value < 1 THEN '<1ms' WHEN value < 10 THEN '1-10ms' WHEN value < 100 THEN '10-100ms'
  WHEN value < 1000 THEN '100ms-1s' WHEN value < 10000 THEN '1-10s' ELSE '10s+' END AS bucket FROM events) GROUP BY 1""")
def _(s, d):
    return table(s, d, "events").groupBy(h.duration_bucket(F.col("value")).alias("bucket")).agg(F.count(F.lit(1)).alias("n"))


@query("merkle_diff", """WITH o AS (SELECT doc_id AS path, sha256(text) AS h FROM documents WHERE n_chars % 7 <> 0), n AS (SELECT doc_id AS path, sha256(CASE WHEN n_chars % 5 = 0 THEN text || '!' ELSE text END) AS h FROM documents WHERE n_chars % 11 <> 0)
SELECT coalesce(o.path, n.path) AS path, CASE WHEN o.h IS NULL THEN 'added' WHEN n.h IS NULL THEN 'removed' ELSE 'changed' END AS change FROM o FULL JOIN n ON o.path = n.path WHERE o.h IS NULL OR n.h IS NULL OR o.h <> n.h""")
def _(s, d):
    t = table(s, d, "documents")
    old = t.where("n_chars % 7 <> 0").select(F.col("doc_id").alias("path"), F.sha2("text", 256).alias("hash"))
    changed = F.when(F.col("n_chars") % 5 == 0, F.concat("text", F.lit("!"))).otherwise(F.col("text"))
    return h.tree_diff(old, t.where("n_chars % 11 <> 0").select(F.col("doc_id").alias("path"), F.sha2(changed, 256).alias("hash")))


@query("innermost_span", """WITH p AS (SELECT DISTINCT user_id AS file, floor(value * 10)::BIGINT AS line FROM events), s AS (SELECT user_id AS file, event_id AS name, floor(value)::BIGINT AS lo, floor(value)::BIGINT + event_id % 200 AS hi FROM events),
m AS (SELECT p.file, line, name, row_number() OVER (PARTITION BY p.file, line ORDER BY hi - lo, name) AS r FROM p JOIN s ON s.file = p.file AND line BETWEEN lo AND hi)
SELECT file, line, name FROM m WHERE r = 1""")
def _(s, d):
    e = table(s, d, "events").withColumnRenamed("user_id", "file")
    p = e.select("file", F.floor(F.col("value") * 10).alias("line")).distinct()
    lo = F.floor("value")
    return h.innermost(p, e.select("file", F.col("event_id").alias("name"), lo.alias("lo"), (lo + F.col("event_id") % 200).alias("hi")))
