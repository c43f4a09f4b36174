"""Reranking of candidates by 21 signals, query classes, channel fusion and retrieval metrics.

Candidates are rows (qid, key, ...): all queries at once, each signal a column expression, and what a signal
needs of its whole batch (a maximum, a mean) a window over qid, whose batches are pages of candidates.
"""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from graphloom.operators.analysis import norm_log
from graphloom.operators.rules import path_penalty

# The weights of the signals.
WEIGHTS = {
    "bm25": 1.0, "semantic": 0.8, "semantic_cosine": 2.0, "fan_in": 0.6, "hits": 0.4, "fan_out": 0.2, "churn": 0.3, "co_change": 0.25,
    "community": 0.3, "minhash": 0.3, "api_signature": 0.45, "type_signature": 0.45, "recency": 0.3, "feedback": 0.5, "file_coherence": 0.3,
    "path_penalty": 0.4, "definition_bias": 0.6, "source_bias": 0.25, "provenance": 0.15, "proximity": 0.45, "overload": 0.35,
}
#: What a class of query does to weights; signals that are not named keep theirs. Symbol, path and signature
#: queries trust words over meaning; concepts are the baseline and trust the neighbourhood.
CLASS_FACTORS = {
    "concept": {"proximity": 1.2}, "keyword_soup": {"proximity": 1.1, "bm25": 0.9},
    "symbol": {"bm25": 1.3, "semantic": 0.6, "semantic_cosine": 0.6, "proximity": 0.9},
    "path": {"bm25": 1.5, "semantic": 0.4, "semantic_cosine": 0.4, "proximity": 0.6},
    "signature": {"bm25": 1.2, "semantic": 0.8, "semantic_cosine": 0.8},
}
#: Share of the vector channel by class: path < symbol < signature < concept.
ALPHA = {"path": 0.15, "symbol": 0.3, "signature": 0.45, "keyword_soup": 0.55, "concept": 0.7}

_PATH = r"^[\w.@-]*(/[\w.@-]+)+/?$|^[\w-]+\.(go|py|ts|js|java|rs|c|h|rb)$"
_SIGNATURE = r"\w\s*\([^)]*\)|^func\b|->"
_SYMBOL = r"^[A-Za-z_]\w*([.:#]{1,2}[A-Za-z_]\w*)*$"
_MIXED = r"[a-z][A-Z]|_|[.:#]|\d"
_SOUP = r"(?i)\b(and|or|not)\b.*\b(and|or|not)\b|(\"[^\"]+\".*){3}"


def query_class(text: Column) -> Column:
    """path, signature, symbol, keyword_soup or concept: the first that fits; plain words and nothing at all
    are concepts."""
    t = F.trim(F.coalesce(text, F.lit("")))
    return (
        F.when(t.rlike(_PATH), "path").when(t.rlike(_SIGNATURE), "signature")
        .when(t.rlike(_SYMBOL) & t.rlike(_MIXED), "symbol").when(t.rlike(_SOUP), "keyword_soup").otherwise("concept")
    )


def alpha(kind: Column) -> Column:
    """The vector channel's share for a class; an unknown class is a concept."""
    out = F.lit(ALPHA["concept"])
    for name, a in ALPHA.items():
        out = F.when(kind == name, a).otherwise(out)
    return out


def soup_fragments(text: Column) -> Column:
    """A keyword soup's fragments: quoted phrases whole, the rest cut at operators and commas."""
    quoted = F.regexp_extract_all(text, F.lit('"([^"]+)"'), 1)
    rest = F.split(F.regexp_replace(text, '"[^"]+"', ","), r"(?i)\s*(?:,|\band\b|\bor\b|\bnot\b)\s*")
    return F.array_distinct(F.concat(quoted, F.filter(F.transform(rest, lambda x: F.trim(x)), lambda x: x != "")))


def fuse(text: DataFrame, vector: DataFrame, share: Column, limit: int, k: int = 60, over: int = 2) -> DataFrame:
    """Hybrid search: (qid, key, rank) of a text and of a vector channel, each cut to over * limit, fused as
    (1 - a) / (k + rt + 1) + a / (k + rv + 1); ties by key. share is a's expression over qid. Without vectors the
    text channel stands alone."""
    cut = lambda df, name: df.where(F.col("rank") < over * limit).select("qid", "key", F.col("rank").alias(name))
    both = cut(text, "rt").join(cut(vector, "rv"), ["qid", "key"], "full_outer")
    some = F.max("rv").over(Window.partitionBy("qid")).isNotNull()
    part = lambda r, w: F.coalesce(w / (k + F.col(r) + 1), F.lit(0.0))
    a = F.when(some, share).otherwise(0.0)
    scored = both.select("qid", "key", F.round(part("rt", 1 - a) + part("rv", a), 9).alias("score"))
    place = F.row_number().over(Window.partitionBy("qid").orderBy(F.desc("score"), "key")) - 1
    return scored.withColumn("rank", place).where(F.col("rank") < limit)


def cosine_refine(ranked: DataFrame, head: int = 32) -> DataFrame:
    """ranked(qid, key, rank, cosine): the first `head` places in order of cosine; a row without a vector
    keeps its place, and the others share the places that are left."""
    has = (F.col("rank") < head) & F.col("cosine").isNotNull()
    split = ranked.withColumn("_has", has)
    w = Window.partitionBy("qid", "_has")
    by_rank = split.withColumns({"_i": F.row_number().over(w.orderBy("rank")), "_j": F.row_number().over(w.orderBy(F.desc("cosine"), "key"))})
    places = by_rank.where("_has").select("qid", F.col("_i").alias("_j"), F.col("rank").alias("_new"))
    moved = by_rank.where("_has").select("qid", "key", "cosine", "_j").join(places, ["qid", "_j"]).select("qid", "key", "cosine", F.col("_new").alias("rank"))
    return moved.unionByName(by_rank.where("not _has").select("qid", "key", "cosine", "rank"))


def expand_terms(terms: DataFrame, classes: DataFrame, related: DataFrame) -> DataFrame:
    """terms(qid, term): each term with the others of its class(class, term), at weight .6, and the terms
    that related(term, to) leads to, one way, at .4; the term itself at 1, the largest weight of one term."""
    own = terms.select("qid", "term", F.lit(1.0).alias("weight"))
    mates = terms.join(classes, "term").select("qid", "class").join(classes, "class").select("qid", "term", F.lit(0.6).alias("weight"))
    led = terms.join(related, "term").select("qid", F.col("to").alias("term"), F.lit(0.4).alias("weight"))
    return own.unionByName(mates).unionByName(led).groupBy("qid", "term").agg(F.max("weight").alias("weight"))


def complete(seeds: DataFrame, edges: DataFrame, decay: float = 0.5) -> DataFrame:
    """Graph completion: seeds(qid, key, score) and their neighbours either way at decay times the best seed
    beside them; a seed that is also a neighbour keeps the larger score."""
    both = edges.select(F.col("src").alias("key"), F.col("dst").alias("near")).unionByName(edges.select(F.col("dst").alias("key"), F.col("src").alias("near")))
    near = seeds.join(both, "key").select("qid", F.col("near").alias("key"), (F.col("score") * decay).alias("score"))
    return seeds.select("qid", "key", "score").unionByName(near).groupBy("qid", "key").agg(F.max("score").alias("score"))


def distinct_owners(hits: DataFrame, limit: int) -> DataFrame:
    """hits(qid, chunk, owner, score), over-fetched: each owner once at its best chunk, then the first `limit`."""
    best = hits.groupBy("qid", "owner").agg(F.max(F.struct("score", "chunk")).alias("x")).select("qid", "owner", "x.score", "x.chunk")
    place = F.row_number().over(Window.partitionBy("qid").orderBy(F.desc("score"), "owner"))
    return best.withColumn("place", place).where(F.col("place") <= limit)


def signals(c: DataFrame) -> DataFrame:
    """The 21 signals, each from 0 to 1, of candidates with the columns named below."""
    batch = Window.partitionBy("qid")
    col = F.col
    reciprocal = lambda r: F.coalesce(61 / (60 + col(r) + 1), F.lit(0.0))
    log = lambda x: norm_log(col(x), F.max(x).over(batch))
    coherent = F.sum(1 / (1 + col("text_rank"))).over(Window.partitionBy("qid", "file"))
    several = F.count(F.lit(1)).over(Window.partitionBy("qid", "file")) >= 2
    c = c.withColumn("_file", F.when(several, coherent).otherwise(0.0))
    same = F.count(F.lit(1)).over(Window.partitionBy("qid", "community"))
    c = c.withColumn("_same", F.when(same > 1, same).otherwise(0))
    names = F.count(F.lit(1)).over(Window.partitionBy("qid", "name"))
    low, high = F.min("edge_weight").over(batch), F.max("edge_weight").over(batch)
    twin = F.max(F.when(col("is_test"), col("stem"))).over(Window.partitionBy("qid", "stem"))
    exact = F.when(col("name") == col("query"), 1.0).when(col("stem") == col("query"), 0.6).when(F.substring("name", 1, 4) == F.substring("query", 1, 4), 0.4).otherwise(0.0)
    collide = 0.5 * col("exported").cast("int") + 0.3 * (~col("is_test")).cast("int") + 0.2 * col("callable").cast("int")
    out = {
        "bm25": reciprocal("text_rank"), "semantic": reciprocal("vector_rank"), "semantic_cosine": F.greatest(F.lit(0.0), F.coalesce("cosine", F.lit(0.0))),
        "fan_in": log("fan_in"), "fan_out": log("fan_out"), "churn": log("commits"), "hits": col("authority") / (1 + col("hub")),
        "co_change": F.coalesce("co_change_mean", F.lit(0.0)), "minhash": F.coalesce("similarity_mean", F.lit(0.0)),
        "community": F.when(col("_same") > 0, col("_same") / F.max("_same").over(batch)).otherwise(F.when(col("same_repo"), 1.0).otherwise(0.7)),
        "api_signature": F.when(col("callable"), col("overlap")).otherwise(0.0), "type_signature": F.when(~col("callable"), col("overlap")).otherwise(0.0),
        "recency": F.pow(F.lit(2.0), -col("age_days") / 30), "feedback": F.greatest(col("feedback"), (col("frecency") - 1) / 0.5, (col("combo") - 1) / 2),
        "file_coherence": F.when(F.max("_file").over(batch) > 0, col("_file") / F.max("_file").over(batch)).otherwise(0.0),
        "path_penalty": path_penalty(col("path")), "definition_bias": exact,
        "source_bias": F.when(~col("is_test") & twin.isNotNull(), 1.0).otherwise(0.0),
        "provenance": F.when(high > low, (col("edge_weight") - low) / (high - low)).otherwise(0.0), "proximity": F.coalesce("walk", F.lit(0.0)),
        "overload": F.when(names > 1, collide).otherwise(0.0),
    }
    return c.select("qid", "key", "class", "text_rank", *[F.least(F.greatest(v, F.lit(0.0)), F.lit(1.0)).alias(n) for n, v in out.items()])


def rerank(scored: DataFrame, demote: Column | None = None) -> DataFrame:
    """signals(...) to (qid, key, score, place): the weighted sum with the class's factors, times a factor for
    supporting files; ties by text rank, absent last, then by key."""
    total = F.lit(0.0)
    for name, w in WEIGHTS.items():
        factor = F.lit(1.0)
        for kind, changes in CLASS_FACTORS.items():
            if name in changes:
                factor = F.when(F.col("class") == kind, changes[name]).otherwise(factor)
        total = total + w * factor * F.col(name)
    score = F.round(total * (F.lit(1.0) if demote is None else demote), 6)
    place = F.row_number().over(Window.partitionBy("qid").orderBy(F.desc("score"), F.asc_nulls_last("text_rank"), "key"))
    return scored.select("qid", "key", "text_rank", score.alias("score")).withColumn("place", place).drop("text_rank")


def recall(ranked: DataFrame, judged: DataFrame, tiers: DataFrame, at: tuple[int, ...] = (1, 5, 20)) -> DataFrame:
    """ranked(qid, key, place from 1), judged(qid, key), tiers(qid, tier): per tier the share of judged queries
    with any right answer within each cut, and the mean reciprocal rank of the first."""
    first = judged.select("qid").distinct().join(ranked.join(judged, ["qid", "key"]).groupBy("qid").agg(F.min("place").alias("first")), "qid", "left").join(tiers, "qid")
    shares = [F.round(F.avg((F.coalesce("first", F.lit(1 << 30)) <= k).cast("double")), 6).alias(f"recall_{k}") for k in at]
    return first.groupBy("tier").agg(F.count(F.lit(1)).alias("queries"), *shares, F.round(F.avg(F.coalesce(1 / F.col("first"), F.lit(0.0))), 6).alias("mrr"))


def replay(old: DataFrame, new: DataFrame) -> DataFrame:
    """(qid, key, place) of two rankings: per query how many keys entered, left, rose and fell."""
    met = old.select("qid", "key", F.col("place").alias("p")).join(new.select("qid", "key", F.col("place").alias("q")), ["qid", "key"], "full_outer")
    n = lambda cond, name: F.count_if(cond).alias(name)
    return met.groupBy("qid").agg(n(F.col("p").isNull(), "entered"), n(F.col("q").isNull(), "left"), n(F.col("q") < F.col("p"), "rose"), n(F.col("q") > F.col("p"), "fell"))


def drift(old: DataFrame, new: DataFrame, similarity: Column) -> DataFrame:
    """Two embeddings(key, v) of the same keys: how many pairs, their mean similarity and those below .9."""
    met = old.select("key", F.col("v").alias("a")).join(new.select("key", F.col("v").alias("b")), "key").select(similarity.alias("s"))
    return met.agg(F.count(F.lit(1)).alias("pairs"), F.round(F.avg("s"), 6).alias("mean"), F.count_if(F.col("s") < 0.9).alias("moved"))


def suggest_weights(scored: DataFrame, judged: DataFrame) -> DataFrame:
    """Per signal its mean on right and on wrong candidates, and the weight times 1 plus half their difference."""
    marked = scored.join(judged.select("qid", "key").distinct().withColumn("right", F.lit(True)), ["qid", "key"], "left")
    pairs = F.explode(F.array(*[F.struct(F.lit(n).alias("signal"), F.lit(w).alias("weight"), F.col(n).alias("value")) for n, w in WEIGHTS.items()]))
    rows = marked.select(F.coalesce("right", F.lit(False)).alias("right"), pairs.alias("x")).select("right", "x.*")
    by = rows.groupBy("signal", "weight").agg(F.avg(F.when(F.col("right"), F.col("value"))).alias("yes"), F.avg(F.when(~F.col("right"), F.col("value"))).alias("no"))
    gain = F.coalesce(F.col("yes"), F.lit(0.0)) - F.coalesce(F.col("no"), F.lit(0.0))
    return by.select("signal", "weight", F.round(gain, 6).alias("gain"), F.round(F.col("weight") * (1 + 0.5 * gain), 6).alias("suggested"))


def classify_query(text: str) -> str:
    """`query_class` for one string on the driver."""
    t = (text or "").strip()
    if re.search(_PATH, t):
        return "path"
    if re.search(_SIGNATURE, t):
        return "signature"
    if re.search(_SYMBOL, t) and re.search(_MIXED, t):
        return "symbol"
    return "keyword_soup" if re.search(_SOUP, t) else "concept"
