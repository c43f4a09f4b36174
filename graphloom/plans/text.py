"""Queries: retrieval over documents, pages and embeddings, and its evaluation."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from graphloom.functions import text as x
from graphloom.operators import search as r
from graphloom.plans.registry import query
from graphloom.sources.model import GRAPH_SQL, nodes, table

_TERMS = ["license", "version", "the"]
_BM25 = """WITH t AS (SELECT doc_id AS key, regexp_extract_all(lower(text), '[\\p{L}\\p{N}_]+') AS t FROM documents), s AS (SELECT count(*) AS docs, avg(len(t)) AS avg_n FROM t),
h AS (SELECT key, len(t) AS n, token, count(*) AS tf FROM (SELECT key, t, unnest(t) AS token FROM t) WHERE token IN ('license', 'version', 'the') GROUP BY key, len(t), token),
f AS (SELECT token, count(*) AS df FROM h GROUP BY 1),
c AS (SELECT key, round(sum(ln(1 + (docs - df + 0.5) / (df + 0.5)) * tf * 2.2 / (tf + 1.2 * (0.25 + 0.75 * n / avg_n))), 6) AS score FROM h JOIN f USING (token), s GROUP BY key)
"""


@query("bm25_search", _BM25 + "SELECT key, score, row_number() OVER (ORDER BY score DESC, key)::INT AS rank FROM c ORDER BY score DESC, key LIMIT 20")
def _(s, d):
    return r.bm25(table(s, d, "documents"), "doc_id", "text", _TERMS)


@query("postings", "SELECT key, token, count(*) AS tf FROM (SELECT doc_id AS key, unnest(regexp_extract_all(lower(text), '[\\p{L}\\p{N}_]+')) AS token FROM documents) GROUP BY ALL")
def _(s, d):
    return r.postings(table(s, d, "documents"), "doc_id", "text")


@query("trigram_candidates", """SELECT doc_id AS key, contains(lower(text), 'licens') AS contains FROM documents WHERE contains(lower(text), 'lic') AND contains(lower(text), 'ice') AND contains(lower(text), 'cen') AND contains(lower(text), 'ens')""")
def _(s, d):
    return r.trigram_candidates(table(s, d, "documents"), "doc_id", "text", "Licens")


@query("grep_literal", """SELECT key, i AS line_no, line FROM (SELECT doc_id AS key, unnest(string_split(text, chr(10))) AS line, generate_subscripts(string_split(text, chr(10)), 1)::INT AS i FROM documents) WHERE contains(line, 'License')""")
def _(s, d):
    return r.grep(table(s, d, "documents"), "doc_id", "text", "License", "License")


@query("grep_regex", """SELECT key, i AS line_no, line FROM (SELECT doc_id AS key, unnest(string_split(text, chr(10))) AS line, generate_subscripts(string_split(text, chr(10)), 1)::INT AS i FROM documents) WHERE regexp_matches(line, '[0-9]{3}-[0-9]{4}')""")
def _(s, d):
    return r.grep(table(s, d, "documents"), "doc_id", "text", "[0-9]{3}-[0-9]{4}")


_VEC = """WITH q AS (SELECT vec_id AS qid, embedding::DOUBLE[] AS q FROM embeddings WHERE vec_id % 100 = 0), v AS (SELECT vec_id AS vid, embedding::DOUBLE[] AS v, label FROM embeddings),
c AS (SELECT qid, vid, round(list_cosine_similarity(q, v), 6) AS score FROM q, v WHERE qid <> vid),
k AS (SELECT *, row_number() OVER (PARTITION BY qid ORDER BY score DESC, vid)::INT AS rank FROM c)
"""


def _vectors(s, d):
    e = table(s, d, "embeddings")
    q = e.where("vec_id % 100 = 0").select(F.col("vec_id").alias("qid"), F.col("embedding").alias("q"))
    return r.vector_topk(q, e.select(F.col("vec_id").alias("vid"), F.col("embedding").alias("v")), 10)


@query("cosine_topk", _VEC + "SELECT qid, vid, score, rank FROM k WHERE rank <= 10")
def _(s, d):
    return _vectors(s, d)


@query("ndcg_mrr", _VEC + """, g AS (SELECT q.vec_id AS qid, e.vec_id AS key FROM embeddings q JOIN embeddings e ON q.label = e.label AND q.vec_id <> e.vec_id WHERE q.vec_id % 100 = 0),
n AS (SELECT qid, count(*) AS n FROM g GROUP BY 1), h AS (SELECT k.qid, rank, CASE WHEN g.key IS NULL THEN 0 ELSE 1 END AS rel FROM k LEFT JOIN g ON g.qid = k.qid AND g.key = k.vid WHERE rank <= 10)
SELECT h.qid, max(rel) AS recall_any, round(sum(rel) / 10, 6) AS precision, round(max(rel / rank), 6) AS rr, round(sum(rel / log2(rank + 1)) / any_value((SELECT sum(1 / log2(i + 1)) FROM range(1, least(n, 10)::INT + 1) t(i))), 6) AS ndcg
FROM h JOIN n USING (qid) GROUP BY h.qid""")
def _(s, d):
    classes = table(s, d, "embeddings").select(F.col("vec_id").alias("key"), "label")
    return r.evaluate_classes(_vectors(s, d).withColumnRenamed("vid", "key"), classes)


@query("alpha_rrf", _BM25 + """, t2 AS (SELECT key, row_number() OVER (ORDER BY score DESC, key) - 1 AS rt FROM c ORDER BY score DESC, key LIMIT 20),
l AS (SELECT doc_id AS key, row_number() OVER (ORDER BY n_chars DESC, doc_id) - 1 AS rv FROM documents ORDER BY n_chars DESC, doc_id LIMIT 20)
SELECT key, round(coalesce(0.4 / (60 + rt + 1), 0) + coalesce(0.6 / (60 + rv + 1), 0), 9) AS score FROM t2 FULL JOIN l USING (key) ORDER BY score DESC, key LIMIT 20""")
def _(s, d):
    docs = table(s, d, "documents")
    a = r.bm25(docs, "doc_id", "text", _TERMS).select("key", (F.col("rank") - 1).alias("rank"))
    b = docs.orderBy(F.desc("n_chars"), "doc_id").limit(20).select(F.col("doc_id").alias("key"), (F.row_number().over(Window.orderBy(F.desc("n_chars"), "doc_id")) - 1).alias("rank"))
    return r.alpha_fusion(a, b, 0.6)


_TOK = "list_filter(string_split(lower(regexp_replace(regexp_replace(regexp_replace(name, '[_/.:#\\s-]+', ' ', 'g'), '([a-z0-9])([A-Z])', '\\1 \\2', 'g'), '([A-Z]+)([A-Z][a-z])', '\\1 \\2', 'g')), ' '), lambda w: length(w) >= 2)"


@query("identifier_tokens", GRAPH_SQL + f" SELECT id, unnest({_TOK}) AS token FROM nodes WHERE kind <> 'order'")
def _(s, d):
    return nodes(s, d).where("kind <> 'order'").select("id", F.explode(x.identifier_tokens(F.col("name"))).alias("token"))


@query("auto_concepts", f"""WITH t AS (SELECT DISTINCT p_partkey AS id, unnest(list_filter({_TOK.replace('name', 'p_name').replace('regexp_rep_namelace', 'regexp_replace')}, lambda w: length(w) >= 3)) AS token FROM part),
c AS (SELECT a.token, b.token AS sibling, count(*) AS n FROM t a JOIN t b ON a.id = b.id AND a.token <> b.token GROUP BY ALL HAVING count(*) >= 3)
SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY token ORDER BY n DESC, sibling)::INT AS rank FROM c) WHERE rank <= 6""")
def _(s, d):
    return r.auto_concepts(table(s, d, "part").select(F.col("p_partkey").alias("id"), F.col("p_name").alias("name")))


@query("canonical_routes", "SELECT p_partkey, replace(replace('/p/:id/' || p_name || '/<x>/' || p_size, ':id', '{id}'), '<x>', '{id}') AS route FROM part")
def _(s, d):
    p = table(s, d, "part")
    return p.select("p_partkey", x.canonical_route(F.concat(F.lit("/p/:id/"), "p_name", F.lit("/<x>/"), F.col("p_size").cast("string"))).alias("route"))


@query("token_overlap", """WITH t AS (SELECT conv_id, turn, role, list_distinct(regexp_extract_all(lower(text), '[\\p{L}\\p{N}_]+')) AS t FROM conversations),
p AS (SELECT a.conv_id, a.turn, len(list_intersect(a.t, b.t)) AS i, len(a.t) AS n, len(b.t) AS m FROM t a JOIN t b ON a.conv_id = b.conv_id AND b.turn = a.turn + 1)
SELECT conv_id, turn, round(CASE WHEN n > 0 THEN i / n ELSE 0 END, 6) AS overlap, round(CASE WHEN n + m - i > 0 THEN i / (n + m - i) ELSE 0 END, 6) AS jaccard FROM p""")
def _(s, d):
    c = table(s, d, "conversations").select("conv_id", "turn", F.array_distinct(x.query_tokens(F.col("text"))).alias("t"))
    nxt = c.select("conv_id", (F.col("turn") - 1).alias("turn"), F.col("t").alias("u"))
    return c.join(nxt, ["conv_id", "turn"]).select("conv_id", "turn", F.round(x.overlap(F.col("t"), F.col("u")), 6).alias("overlap"), F.round(x.jaccard(F.col("t"), F.col("u")), 6).alias("jaccard"))


@query("file_diversity", """WITH b AS (SELECT doc_id AS key, source AS file, row_number() OVER (ORDER BY n_chars DESC, doc_id) - 1 AS rank FROM documents ORDER BY n_chars DESC, doc_id LIMIT 100),
m AS (SELECT *, row_number() OVER (PARTITION BY file ORDER BY rank) AS nth FROM b), e AS (SELECT key, file, rank, rank + CASE WHEN nth > 2 THEN 3 * (nth - 2) ELSE 0 END AS effective FROM m)
SELECT key, file, rank, effective, row_number() OVER (ORDER BY effective, rank) - 1 AS new_rank FROM e""")
def _(s, d):
    docs = table(s, d, "documents").orderBy(F.desc("n_chars"), "doc_id").limit(100)
    return r.file_diversity(docs.select(F.col("doc_id").alias("key"), F.col("source").alias("file"), (F.row_number().over(Window.orderBy(F.desc("n_chars"), "doc_id")) - 1).alias("rank")))


@query("page_links", """SELECT page_id, unnest(regexp_extract_all(html, 'href="([^"]*)"', 1)) AS target FROM pages""")
def _(s, d):
    return table(s, d, "pages").select("page_id", F.explode(F.regexp_extract_all("html", F.lit('href="([^"]*)"'), F.lit(1))).alias("target"))
