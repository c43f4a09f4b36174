"""Queries: reranking, query classes, hybrid channels and retrieval metrics."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from graphloom.functions.text import cosine
from graphloom.operators import rerank as r
from graphloom.operators import rules
from graphloom.operators.search import vector_topk
from graphloom.plans.registry import query
from graphloom.sources.model import GRAPH_SQL, edges, nodes, table
from graphloom.sources.scratch import store

#: Candidates: the parts of one type, all types, the query being the brand; every column of `signals`.
_CAND = """WITH u AS (SELECT l_partkey AS k, count(*) AS uses, count(DISTINCT l_suppkey) AS sups, count(DISTINCT l_orderkey) AS commits FROM lineitem GROUP BY 1),
c AS (SELECT p_type || p_size % 5 AS qid, p_partkey AS key, CASE p_size % 5 WHEN 0 THEN 'symbol' WHEN 1 THEN 'path' WHEN 2 THEN 'concept' WHEN 3 THEN 'signature' ELSE 'keyword_soup' END AS class,
  CASE WHEN p_partkey % 13 = 0 THEN NULL ELSE row_number() OVER (PARTITION BY p_type, p_size % 5 ORDER BY p_partkey) - 1 END AS text_rank, row_number() OVER (PARTITION BY p_type, p_size % 5 ORDER BY p_size, p_partkey) - 1 AS vector_rank,
  CASE WHEN p_partkey % 7 = 0 THEN NULL ELSE (p_partkey % 100) / 50.0 - 1 END::DOUBLE AS cosine, coalesce(uses, 0) AS fan_in, coalesce(sups, 0) AS fan_out, coalesce(commits, 0) AS commits,
  (p_partkey % 10) / 10.0::DOUBLE AS authority, (p_partkey % 4) / 4.0::DOUBLE AS hub, (p_partkey % 9) / 10.0::DOUBLE AS co_change_mean, (p_partkey % 8) / 10.0::DOUBLE AS similarity_mean, p_brand AS community, p_partkey % 2 = 0 AS same_repo,
  p_size % 2 = 0 AS callable, (p_size % 6) / 5.0::DOUBLE AS overlap, (p_partkey % 365)::DOUBLE AS age_days, (p_partkey % 3) / 4.0::DOUBLE AS feedback, 1 + (p_partkey % 5) / 10.0::DOUBLE AS frecency, 1 + (p_partkey % 6) / 3.0::DOUBLE AS combo,
  p_brand AS file, CASE WHEN p_partkey % 6 = 0 THEN 'tests/x.py' WHEN p_partkey % 6 = 1 THEN 'examples/x.py' ELSE 'src/x.py' END AS path, p_partkey % 6 = 0 AS is_test, p_name AS name, split_part(p_name, ' ', 2) AS stem, 'red widget' AS query, p_partkey % 3 > 0 AS exported,
  (p_size % 10)::DOUBLE AS edge_weight, (p_partkey % 20) / 40.0::DOUBLE AS walk FROM part LEFT JOIN u ON k = p_partkey)"""


def _candidates(s, d):
    line = table(s, d, "lineitem")
    u = line.groupBy(F.col("l_partkey").alias("p_partkey")).agg(F.count(F.lit(1)).alias("uses"), F.countDistinct("l_suppkey").alias("sups"), F.countDistinct("l_orderkey").alias("commits"))
    k, z, zero = F.col("p_partkey"), F.col("p_size"), F.lit(0)
    qid = F.concat("p_type", (z % 5).cast("string"))
    w = Window.partitionBy(qid)
    kinds = F.get(F.array(*[F.lit(x) for x in ("symbol", "path", "concept", "signature", "keyword_soup")]), z % 5)
    paths = F.when(k % 6 == 0, "tests/x.py").when(k % 6 == 1, "examples/x.py").otherwise("src/x.py")
    share = lambda m, of: ((k % m) / of).cast("double")
    return table(s, d, "part").join(u, "p_partkey", "left").select(
        qid.alias("qid"), k.alias("key"), kinds.alias("class"), F.when(k % 13 != 0, F.row_number().over(w.orderBy("p_partkey")) - 1).alias("text_rank"), (F.row_number().over(w.orderBy("p_size", "p_partkey")) - 1).alias("vector_rank"),
        F.when(k % 7 != 0, (k % 100) / 50.0 - 1).alias("cosine"), F.coalesce("uses", zero).alias("fan_in"), F.coalesce("sups", zero).alias("fan_out"), F.coalesce("commits", zero).alias("commits"),
        share(10, 10.0).alias("authority"), share(4, 4.0).alias("hub"), share(9, 10.0).alias("co_change_mean"), share(8, 10.0).alias("similarity_mean"), F.col("p_brand").alias("community"), (k % 2 == 0).alias("same_repo"),
        (z % 2 == 0).alias("callable"), (z % 6 / 5.0).alias("overlap"), (k % 365).cast("double").alias("age_days"), share(3, 4.0).alias("feedback"), (1 + share(5, 10.0)).alias("frecency"), (1 + share(6, 3.0)).alias("combo"),
        F.col("p_brand").alias("file"), paths.alias("path"), (k % 6 == 0).alias("is_test"), F.col("p_name").alias("name"), F.split("p_name", " ")[1].alias("stem"), F.lit("red widget").alias("query"), (k % 3 > 0).alias("exported"),
        (z % 10).cast("double").alias("edge_weight"), share(20, 40.0).alias("walk"),
    )


_PEN = "least(1.0, " + ", ".join(f"CASE WHEN regexp_matches(path, '{p}') THEN {w} ELSE 1.0 END" for p, w in rules.PENALTIES) + ")"
_LOG = "CASE WHEN {0} > 0 THEN ln(1 + {0}) / ln(1 + max({0}) OVER q) ELSE 0 END"
_SIGNALS = f"""{_CAND}, c1 AS (SELECT *, CASE WHEN count(*) OVER (PARTITION BY qid, file) >= 2 THEN sum(1 / (1 + text_rank)) OVER (PARTITION BY qid, file) ELSE 0 END AS _file,
  CASE WHEN count(*) OVER (PARTITION BY qid, community) > 1 THEN count(*) OVER (PARTITION BY qid, community) ELSE 0 END AS _same, count(*) OVER (PARTITION BY qid, name) AS _names, max(CASE WHEN is_test THEN stem END) OVER (PARTITION BY qid, stem) AS _twin FROM c),
s0 AS (SELECT qid, key, class, text_rank, coalesce(61 / (60 + text_rank + 1), 0) AS bm25, 61 / (60 + vector_rank + 1) AS semantic, greatest(0, coalesce(cosine, 0)) AS semantic_cosine, {_LOG.format('fan_in')} AS fan_in, {_LOG.format('fan_out')} AS fan_out, {_LOG.format('commits')} AS churn,
  authority / (1 + hub) AS hits, co_change_mean AS co_change, similarity_mean AS minhash, CASE WHEN _same > 0 THEN _same / max(_same) OVER q WHEN same_repo THEN 1.0 ELSE 0.7 END AS community, CASE WHEN callable THEN overlap ELSE 0 END AS api_signature, CASE WHEN NOT callable THEN overlap ELSE 0 END AS type_signature,
  pow(2.0, -age_days / 30) AS recency, greatest(feedback, (frecency - 1) / 0.5, (combo - 1) / 2) AS feedback, CASE WHEN max(_file) OVER q > 0 THEN coalesce(_file, 0) / max(_file) OVER q ELSE 0 END AS file_coherence, {_PEN} AS path_penalty,
  CASE WHEN name = query THEN 1.0 WHEN stem = query THEN 0.6 WHEN substr(name, 1, 4) = substr(query, 1, 4) THEN 0.4 ELSE 0 END AS definition_bias, CASE WHEN NOT is_test AND _twin IS NOT NULL THEN 1.0 ELSE 0 END AS source_bias,
  CASE WHEN max(edge_weight) OVER q > min(edge_weight) OVER q THEN (edge_weight - min(edge_weight) OVER q) / (max(edge_weight) OVER q - min(edge_weight) OVER q) ELSE 0 END AS provenance, walk AS proximity,
  CASE WHEN _names > 1 THEN 0.5 * exported::INT + 0.3 * (NOT is_test)::INT + 0.2 * callable::INT ELSE 0 END AS overload FROM c1 WINDOW q AS (PARTITION BY qid)),
s AS (SELECT qid, key, class, text_rank, {", ".join(f"least(greatest({n}, 0), 1)::DOUBLE AS {n}" for n in r.WEIGHTS)} FROM s0)"""
_NAMES = list(r.WEIGHTS)


def _factor(name):
    cases = " ".join(f"WHEN class = '{k}' THEN {v[name]}" for k, v in r.CLASS_FACTORS.items() if name in v)
    return f"CASE {cases} ELSE 1.0 END" if cases else "1.0"


_SCORE = f"round({' + '.join(f'{w} * {_factor(n)} * {n}' for n, w in r.WEIGHTS.items())}, 6)"


def _signals(s, d):
    return r.signals(_candidates(s, d))


@query("rerank_all_signals", f"{_SIGNALS} SELECT qid, key, {', '.join(f'round({n}, 6) AS {n}' for n in _NAMES)} FROM s")
def _(s, d):
    return _signals(s, d).select("qid", "key", *[F.round(n, 6).alias(n) for n in _NAMES])


@query("rerank_by_class", f"{_SIGNALS}, x AS (SELECT qid, key, text_rank, {_SCORE}::DOUBLE AS score FROM s) SELECT qid, key, score, row_number() OVER (PARTITION BY qid ORDER BY score DESC, text_rank NULLS LAST, key) AS place FROM x")
def _(s, d):
    return r.rerank(_signals(s, d))


_JUDGED = "SELECT p_type || p_size % 5 AS qid, p_partkey AS key FROM part WHERE p_partkey % 9 = 0 AND p_name LIKE '%widget'"


def _judged(s, d):
    p = table(s, d, "part").where("p_partkey % 9 = 0 and p_name like '%widget'")
    return p.select(F.concat("p_type", (F.col("p_size") % 5).cast("string")).alias("qid"), F.col("p_partkey").alias("key"))


@query("recall_by_tier", f"""{_SIGNALS}, x AS (SELECT qid, key, text_rank, {_SCORE}::DOUBLE AS score FROM s), p AS (SELECT qid, key, row_number() OVER (PARTITION BY qid ORDER BY score DESC, text_rank NULLS LAST, key) AS place FROM x), j AS ({_JUDGED}),
f AS (SELECT j.qid, min(place) AS first FROM j JOIN p USING (qid, key) GROUP BY 1)
SELECT right(qid, 1) AS tier, count(*) AS queries, round(avg((first <= 1)::INT), 6) AS recall_1, round(avg((first <= 5)::INT), 6) AS recall_5, round(avg((first <= 20)::INT), 6) AS recall_20, round(avg(1 / first), 6) AS mrr FROM f GROUP BY 1""")
def _(s, d):
    ranked = r.rerank(_signals(s, d))
    tiers = ranked.select("qid", F.substring("qid", -1, 1).alias("tier")).distinct()
    return r.recall(ranked, _judged(s, d), tiers)


@query("ranking_replay", f"""{_SIGNALS}, x AS (SELECT qid, key, text_rank, {_SCORE}::DOUBLE AS score FROM s), n AS (SELECT qid, key, row_number() OVER (PARTITION BY qid ORDER BY score DESC, text_rank NULLS LAST, key) AS place FROM x QUALIFY place <= 10),
o AS (SELECT qid, key, text_rank + 1 AS place FROM s WHERE text_rank < 10)
SELECT coalesce(o.qid, n.qid) AS qid, count(*) FILTER (o.place IS NULL) AS entered, count(*) FILTER (n.place IS NULL) AS left, count(*) FILTER (n.place < o.place) AS rose, count(*) FILTER (n.place > o.place) AS fell FROM o FULL JOIN n ON o.qid = n.qid AND o.key = n.key GROUP BY 1""")
def _(s, d):
    sig = store(_signals(s, d), "signals")
    old = sig.where("text_rank < 10").select("qid", "key", (F.col("text_rank") + 1).alias("place"))
    return r.replay(old, r.rerank(sig).where("place <= 10"))


@query("weight_suggestions", f"""{_SIGNALS}, j AS ({_JUDGED}), m AS (SELECT s.*, j.key IS NOT NULL AS good FROM s LEFT JOIN j USING (qid, key)),
l AS ({" UNION ALL ".join(f"SELECT '{n}' AS signal, {w}::DOUBLE AS weight, good, {n} AS value FROM m" for n, w in r.WEIGHTS.items())}),
g AS (SELECT signal, weight, coalesce(avg(value) FILTER (good), 0) - coalesce(avg(value) FILTER (NOT good), 0) AS gain FROM l GROUP BY ALL) SELECT signal, weight, round(gain, 6) AS gain, round(weight * (1 + 0.5 * gain), 6) AS suggested FROM g""")
def _(s, d):
    return r.suggest_weights(_signals(s, d), _judged(s, d))


_ASK = "SELECT p_partkey AS qid, CASE p_partkey % 6 WHEN 0 THEN 'validate' || 'Token' WHEN 1 THEN 'pkg/' || replace(p_name, ' ', '_') || '.go' WHEN 2 THEN 'func(ctx) error' WHEN 3 THEN p_name || ' that fits' WHEN 4 THEN '\"a b\" and ' || p_name || ' or widget' ELSE '' END AS text FROM part"
_CLASS = f"""CASE WHEN regexp_matches(trim(text), '{r._PATH}') THEN 'path' WHEN regexp_matches(trim(text), '{r._SIGNATURE}') THEN 'signature'
  WHEN regexp_matches(trim(text), '{r._SYMBOL}') AND regexp_matches(trim(text), '{r._MIXED}') THEN 'symbol' WHEN regexp_matches(trim(text), '{r._SOUP}') THEN 'keyword_soup' ELSE 'concept' END"""


def _asked(s, d):
    k, n = F.col("p_partkey"), F.col("p_name")
    text = F.when(k % 6 == 0, "validateToken").when(k % 6 == 1, F.concat(F.lit("pkg/"), F.translate(n, " ", "_"), F.lit(".go"))).when(k % 6 == 2, "func(ctx) error").when(k % 6 == 3, F.concat(n, F.lit(" that fits")))
    return table(s, d, "part").select(k.alias("qid"), text.when(k % 6 == 4, F.concat(F.lit('"a b" and '), n, F.lit(" or widget"))).otherwise("").alias("text"))


@query("query_classes", f"WITH a AS ({_ASK}), c AS (SELECT qid, {_CLASS} AS class FROM a) SELECT qid, class, CASE class {' '.join(f'''WHEN '{k}' THEN {v}''' for k, v in r.ALPHA.items())} END::DOUBLE AS alpha FROM c")
def _(s, d):
    return _asked(s, d).select("qid", r.query_class(F.col("text")).alias("class")).withColumn("alpha", r.alpha(F.col("class")))


@query("soup_fragments", f"""WITH a AS ({_ASK}), x AS (SELECT qid, text, regexp_extract_all(text, '"([^"]+)"', 1) AS q, regexp_split_to_array(regexp_replace(text, '"[^"]+"', ',', 'g'), '(?i)\\s*(?:,|\\band\\b|\\bor\\b|\\bnot\\b)\\s*') AS p FROM a WHERE qid % 6 = 4)
SELECT DISTINCT qid, unnest(list_concat(q, list_filter(list_transform(p, lambda z: trim(z)), lambda z: z <> ''))) AS fragment FROM x""")
def _(s, d):
    return _asked(s, d).where("qid % 6 = 4").select("qid", F.explode(r.soup_fragments(F.col("text"))).alias("fragment"))


_TOK = "SELECT DISTINCT doc_id AS key, unnest(list_slice(regexp_extract_all(lower(text), '[a-z0-9]+'), 1, 40)) AS token FROM documents"
_HYB = f"""WITH tok AS ({_TOK}), q AS (SELECT key AS qid, token FROM tok WHERE key % 100 = 0), df AS (SELECT token FROM tok GROUP BY token HAVING count(*) <= 50),
t0 AS (SELECT qid, tok.key, count(*) AS n FROM q JOIN df USING (token) JOIN tok USING (token) WHERE tok.key <> qid GROUP BY ALL), t AS (SELECT qid, key, row_number() OVER (PARTITION BY qid ORDER BY n DESC, key) - 1 AS rank FROM t0 QUALIFY rank < 20),
v0 AS (SELECT a.vec_id AS qid, b.vec_id AS key, round(list_dot_product(a.embedding::DOUBLE[], b.embedding::DOUBLE[]) / sqrt(list_dot_product(a.embedding::DOUBLE[], a.embedding::DOUBLE[])) / sqrt(list_dot_product(b.embedding::DOUBLE[], b.embedding::DOUBLE[])), 6) AS cos FROM embeddings a JOIN embeddings b ON a.vec_id <> b.vec_id WHERE a.vec_id % 100 = 0),
v AS (SELECT qid, key, row_number() OVER (PARTITION BY qid ORDER BY cos DESC, key) - 1 AS rank FROM v0 QUALIFY rank < 20), b AS (SELECT coalesce(t.qid, v.qid) AS qid, coalesce(t.key, v.key) AS key, t.rank AS rt, v.rank AS rv FROM t FULL JOIN v ON t.qid = v.qid AND t.key = v.key),
sh AS (SELECT *, CASE WHEN max(rv) OVER (PARTITION BY qid) IS NULL THEN 0.0 WHEN qid % 200 = 0 THEN 0.7 ELSE 0.3 END AS a FROM b), sc AS (SELECT qid, key, round(coalesce((1 - a) / (61 + rt), 0) + coalesce(a / (61 + rv), 0), 9) AS score FROM sh),
h AS (SELECT qid, key, score::DOUBLE AS score, row_number() OVER (PARTITION BY qid ORDER BY score DESC, key) - 1 AS rank FROM sc QUALIFY rank < 10)"""


def _hybrid(s, d):
    docs = table(s, d, "documents")
    tok = store(docs.select(F.col("doc_id").alias("key"), F.explode(F.slice(F.regexp_extract_all(F.lower("text"), F.lit("[a-z0-9]+"), 0), 1, 40)).alias("token")).distinct(), "hybrid")
    df = tok.groupBy("token").agg(F.count(F.lit(1)).alias("n")).where("n <= 50").select("token")
    q = tok.where("key % 100 = 0").select(F.col("key").alias("qid"), "token").join(df, "token")
    t = q.join(tok, "token").where("key <> qid").groupBy("qid", "key").agg(F.count(F.lit(1)).alias("n"))
    place = lambda order: (F.row_number().over(Window.partitionBy("qid").orderBy(F.desc(order), "key")) - 1)
    e = table(s, d, "embeddings")
    v = vector_topk(e.where("vec_id % 100 = 0").select(F.col("vec_id").alias("qid"), F.col("embedding").alias("q")), e.select(F.col("vec_id").alias("vid"), F.col("embedding").alias("v")), 20)
    text = t.withColumn("rank", place("n")).where("rank < 20")
    vector = v.select("qid", F.col("vid").alias("key"), (F.col("rank") - 1).alias("rank"))
    return r.fuse(text, vector, F.when(F.col("qid") % 200 == 0, 0.7).otherwise(0.3), 10)


@query("hybrid_search", f"{_HYB} SELECT * FROM h")
def _(s, d):
    return _hybrid(s, d)


@query("cosine_refine", f"""{_HYB}, x AS (SELECT h.qid, h.key, h.rank, v0.cos, h.rank < 6 AND v0.cos IS NOT NULL AS has FROM h LEFT JOIN v0 USING (qid, key)),
y AS (SELECT *, row_number() OVER (PARTITION BY qid, has ORDER BY rank) AS i, row_number() OVER (PARTITION BY qid, has ORDER BY cos DESC, key) AS j FROM x)
SELECT a.qid, a.key, b.rank FROM y a JOIN y b ON a.qid = b.qid AND b.has AND b.i = a.j WHERE a.has UNION ALL SELECT qid, key, rank FROM y WHERE NOT has""")
def _(s, d):
    e = table(s, d, "embeddings")
    h = _hybrid(s, d).join(e.select(F.col("vec_id").alias("qid"), F.col("embedding").alias("a")), "qid", "left")
    h = h.join(e.select(F.col("vec_id").alias("key"), F.col("embedding").alias("b")), "key", "left")
    met = h.withColumn("cosine", F.when(F.col("qid") != F.col("key"), F.round(cosine(F.col("a"), F.col("b")), 6))).drop("a", "b")
    return r.cosine_refine(met, 6).select("qid", "key", "rank")


@query("equivalence_expansion", """WITH t AS (SELECT DISTINCT p_partkey AS qid, unnest(string_split(p_name, ' ')) AS term FROM part), c(class, term) AS (VALUES ('color', 'red'), ('color', 'blue'), ('color', 'green'), ('thing', 'widget'), ('thing', 'bolt')), l("from", "to") AS (VALUES ('widget', 'device'), ('large', 'big'))
SELECT qid, term, max(weight)::DOUBLE AS weight FROM (SELECT qid, term, 1.0 AS weight FROM t UNION ALL SELECT qid, d.term, 0.6 FROM t JOIN c USING (term) JOIN c d USING (class) UNION ALL SELECT qid, "to", 0.4 FROM t JOIN l ON "from" = term) GROUP BY ALL""")
def _(s, d):
    terms = table(s, d, "part").select(F.col("p_partkey").alias("qid"), F.explode(F.split("p_name", " ")).alias("term")).distinct()
    classes = s.createDataFrame([("color", "red"), ("color", "blue"), ("color", "green"), ("thing", "widget"), ("thing", "bolt")], "class string, term string")
    return r.expand_terms(terms, F.broadcast(classes), F.broadcast(s.createDataFrame([("widget", "device"), ("large", "big")], "term string, to string")))  # literal tables


@query("graph_completion", GRAPH_SQL + """, s AS (SELECT file_path AS qid, id AS key, (size % 10 + 1)::DOUBLE AS score FROM nodes WHERE kind = 'part' AND size > 40), b AS (SELECT src AS key, dst AS near FROM edges UNION ALL SELECT dst, src FROM edges)
SELECT qid, key, max(score) AS score FROM (SELECT * FROM s UNION ALL SELECT qid, near, score * 0.5 FROM s JOIN b USING (key)) GROUP BY ALL""")
def _(s, d):
    seeds = nodes(s, d).where("kind = 'part' and size > 40").select(F.col("file_path").alias("qid"), F.col("id").alias("key"), (F.col("size") % 10 + 1).cast("double").alias("score"))
    return r.complete(seeds, edges(s, d))


@query("chunk_owners", """WITH h AS (SELECT l_returnflag AS qid, l_orderkey * 10 + l_linenumber AS chunk, l_partkey AS owner, l_quantity AS score FROM lineitem), b AS (SELECT qid, owner, score, chunk FROM h QUALIFY row_number() OVER (PARTITION BY qid, owner ORDER BY score DESC, chunk DESC) = 1)
SELECT qid, owner, score, chunk, row_number() OVER (PARTITION BY qid ORDER BY score DESC, owner) AS place FROM b QUALIFY place <= 25""")
def _(s, d):
    h = table(s, d, "lineitem").select(F.col("l_returnflag").alias("qid"), (F.col("l_orderkey") * 10 + F.col("l_linenumber")).alias("chunk"), F.col("l_partkey").alias("owner"), F.col("l_quantity").alias("score"))
    return r.distinct_owners(h, 25)


@query("embedding_drift", """WITH x AS (SELECT a.vec_id, a.embedding::DOUBLE[] AS a, b.embedding::DOUBLE[] AS b FROM embeddings a JOIN embeddings b ON b.vec_id = a.vec_id + (a.vec_id % 3 = 0)::INT), s AS (SELECT list_dot_product(a, b) / sqrt(list_dot_product(a, a)) / sqrt(list_dot_product(b, b)) AS s FROM x)
SELECT count(*) AS pairs, round(avg(s), 6) AS mean, count(*) FILTER (s < 0.9) AS moved FROM s""")
def _(s, d):
    e = table(s, d, "embeddings").select(F.col("vec_id").alias("key"), F.col("embedding").alias("v"))
    moved = e.withColumn("key", F.explode(F.when((F.col("key") - 1) % 3 == 0, F.array(F.col("key") - 1)).otherwise(F.array().cast("array<bigint>"))))
    new = e.where("key % 3 <> 0").unionByName(moved)
    return r.drift(e, new, cosine(F.col("a"), F.col("b")))


@query("find_files", GRAPH_SQL + " SELECT DISTINCT file_path FROM nodes WHERE regexp_matches(file_path, '^[^/]+/[^/]*1[^/]*(/|$)')")
def _(s, d):
    return nodes(s, d).where(F.col("file_path").rlike("^[^/]+/[^/]*1[^/]*(/|$)")).select("file_path").distinct()


@query("repo_outline", GRAPH_SQL + """ SELECT repo_prefix, file_path, count(*) AS symbols, list_sort(list(DISTINCT kind)) AS kinds, max(size) AS largest FROM nodes GROUP BY ALL""")
def _(s, d):
    return nodes(s, d).groupBy("repo_prefix", "file_path").agg(F.count(F.lit(1)).alias("symbols"), F.array_sort(F.collect_set("kind")).alias("kinds"), F.max("size").alias("largest"))


@query("dependency_coverage", GRAPH_SQL + """ SELECT n.kind AS language, count(DISTINCT e.src || e.dst || e.kind) AS dependencies, count(DISTINCT CASE WHEN m.id IS NOT NULL AND e.weight >= 2 THEN e.src || e.dst || e.kind END) AS resolved,
  round(count(DISTINCT CASE WHEN m.id IS NOT NULL AND e.weight >= 2 THEN e.src || e.dst || e.kind END) / count(DISTINCT e.src || e.dst || e.kind), 6) AS share FROM edges e JOIN nodes n ON n.id = e.src LEFT JOIN nodes m ON m.id = e.dst GROUP BY 1""")
def _(s, d):
    n = nodes(s, d)
    e = edges(s, d).join(n.select(F.col("id").alias("src"), F.col("kind").alias("language")), "src").join(n.select(F.col("id").alias("dst"), F.lit(True).alias("known")), "dst", "left")
    ok = F.col("known") & (F.col("weight") >= 2)  # identities are unique, so counts are distinct counts
    return e.groupBy("language").agg(F.count(F.lit(1)).alias("dependencies"), F.count_if(ok).alias("resolved")).withColumn("share", F.round(F.col("resolved") / F.col("dependencies"), 6))
