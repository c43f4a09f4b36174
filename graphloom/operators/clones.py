"""Clone detection by MinHash and banded LSH, with exact answers beside it."""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from graphloom.functions.text import query_tokens
from graphloom.operators.algorithms import components
from graphloom.sources.scratch import store

HASHES, BANDS, ROWS, THRESHOLD, SHINGLE, LEAST_TOKENS = 64, 16, 4, 0.82, 3, 24
#: Longs of a set's bitmap.
WORDS = 32
_BITS = [f"b{i}" for i in range(WORDS)]


def shingle_hashes(text: Column, k: int = SHINGLE) -> Column:
    """Distinct 64-bit hashes of the k-token windows; empty below LEAST_TOKENS tokens."""
    tokens = F.transform(query_tokens(text), lambda w: F.xxhash64(w))
    windows = F.transform(
        F.array(tokens), lambda t: F.when(F.size(t) >= LEAST_TOKENS, F.array_distinct(F.transform(F.sequence(F.lit(0), F.greatest(F.size(t) - k, F.lit(0))), lambda i: F.xxhash64(*[F.get(t, i + j) for j in range(k)])))).otherwise(F.array().cast("array<bigint>"))
    )
    return windows[0]


_P1, _P2, _P3, _P4, _P5 = (np.uint64(x) for x in (0x9E3779B185EBCA87, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0x85EBCA77C2B2AE63, 0x27D4EB2F165667C5))
_SEEDS = np.arange(HASHES, dtype=np.uint64) * _P1
#: Shingles rehashed at once: the few arrays of a step stay in a core's cache.
_BLOCK = 1 << 14


def _turned(x: np.ndarray, by: int, room: np.ndarray) -> None:
    """Turn x to the left in place; room: an array as long."""
    np.left_shift(x, np.uint64(by), out=room)
    x >>= np.uint64(64 - by)
    x |= room


def _ended(x: np.ndarray, room: np.ndarray) -> np.ndarray:
    for by, times in ((33, _P2), (29, _P3), (32, None)):
        np.right_shift(x, np.uint64(by), out=room)
        x ^= room
        if times is not None:
            x *= times
    return x


def _hash_long(x: np.ndarray, seed: np.ndarray | np.uint64) -> np.ndarray:
    """Spark's xxhash64 of longs after what `seed` is the hash of."""
    x, room = x * _P2, np.empty_like(x)
    _turned(x, 31, room)
    x *= _P1
    x ^= seed + (_P5 + np.uint64(8))
    _turned(x, 27, room)
    x *= _P1
    x += _P4
    return _ended(x, room)


def _minima(shingles: np.ndarray, starts: np.ndarray) -> np.ndarray:
    """For each run of shingles the minima of xxhash64(shingle, h), h below HASHES; runs begin at starts, none is empty."""
    out = np.full((HASHES, len(starts)), np.iinfo(np.int64).max)
    for at in range(0, len(shingles), _BLOCK):
        to = min(at + _BLOCK, len(shingles))
        first, last = int(np.searchsorted(starts, at, "right")) - 1, int(np.searchsorted(starts, to, "left"))
        cuts = np.maximum(starts[first:last] - at, 0)
        seed = _hash_long(shingles[at:to], np.uint64(42))
        seed += _P5 + np.uint64(4)
        x, room = np.empty_like(seed), np.empty_like(seed)
        for h in range(HASHES):
            np.bitwise_xor(seed, _SEEDS[h], out=x)
            _turned(x, 23, room)
            x *= _P2
            x += _P3
            least = np.minimum.reduceat(_ended(x, room).view(np.int64), cuts)
            np.minimum(out[h, first:last], least, out=out[h, first:last])
    return out.T


def _signed(tokens: pa.ListArray, k: int = SHINGLE) -> tuple[list[int], list[int], list[int], np.ndarray]:
    """Which lists of token hashes have shingles, the number and the hash of each one's distinct shingles, and their minima."""
    cuts, flat = tokens.offsets.to_numpy(), tokens.values.to_numpy().view(np.uint64)
    met, n, h, sets = [], [], [], []
    for i in range(len(tokens)):
        t = flat[cuts[i] : cuts[i + 1]]
        if len(t) < LEAST_TOKENS:
            continue
        x = np.uint64(42)
        for j in range(k):
            x = _hash_long(t[j : len(t) - k + 1 + j], x)
        x.sort()
        x = x[np.concatenate(([True], x[1:] != x[:-1]))]
        met.append(i)
        n.append(len(x))
        h.append(int.from_bytes(hashlib.blake2b(x.tobytes(), digest_size=8).digest(), "little", signed=True))
        sets.append(x)
    if not met:
        return met, n, h, np.zeros((0, HASHES), np.int64)
    return met, n, h, _minima(np.concatenate(sets), np.cumsum([0, *n[:-1]]))


def signatures(docs: DataFrame, key: str, text: str) -> DataFrame:
    """(key, n, h, signature): number and hash of the distinct shingles, and the minimum of HASHES rehashes of
    the shingles. Spark finds and hashes the tokens; shingles and minima come text by text from arrays in numpy, so
    no shingle is stored or moved. Repeated rows come as often as they are."""
    tokens = docs.select(F.col(key).alias("key"), F.transform(query_tokens(F.col(text)), lambda w: F.xxhash64(w)).alias("tokens")).where("tokens is not null")

    def run(batches):
        for batch in batches:
            met, n, h, signature = _signed(batch.column("tokens"))
            rows = pa.FixedSizeListArray.from_arrays(pa.array(signature.ravel()), HASHES).cast(pa.list_(pa.int64()))
            yield pa.RecordBatch.from_arrays([batch.column("key").take(pa.array(met, pa.int64())), pa.array(n, pa.int32()), pa.array(h, pa.int64()), rows], ["key", "n", "h", "signature"])

    kind = dict(tokens.dtypes)["key"]
    return tokens.mapInArrow(run, f"key {kind}, n int, h long, signature array<long>")


def _verified(pairs: DataFrame, sets: DataFrame, threshold: float) -> DataFrame:
    """(a, b, similarity) of pairs(a, b) whose shingle sets have that exact Jaccard or more."""
    pairs = store(pairs, "clones")
    left = sets.select(F.col("key").alias("a"), F.col("shingles").alias("x")).join(pairs.select("a").distinct(), "a", "left_semi")
    right = sets.select(F.col("key").alias("b"), F.col("shingles").alias("y")).join(pairs.select("b").distinct(), "b", "left_semi")
    both = F.size(F.array_intersect("x", "y"))
    scored = pairs.join(left, "a").join(right, "b").select("a", "b", (both / (F.size("x") + F.size("y") - both)).alias("similarity"))
    return scored.where(F.col("similarity") >= threshold)


def _bitmaps(sets: DataFrame) -> DataFrame:
    """(key, b0, b1, ...): WORDS longs in which each shingle sets one bit. A bit that only one of two sets has stands for
    at least one shingle that only this one has."""

    def run(batches):
        for batch in batches:
            lists = batch.column("shingles")
            cuts, flat = lists.offsets.to_numpy(), lists.values.to_numpy()
            bits = np.zeros((batch.num_rows, WORDS * 64), bool)
            bits[np.repeat(np.arange(batch.num_rows), np.diff(cuts)), flat[cuts[0] : cuts[-1]] & (WORDS * 64 - 1)] = True
            words = np.packbits(bits, axis=1).view(np.int64)
            yield pa.RecordBatch.from_arrays([batch.column("key"), *(pa.array(w) for w in words.T)], ["key", *_BITS])

    shape = f"key {dict(sets.dtypes)['key']}, " + ", ".join(f"{b} long" for b in _BITS)
    return sets.select("key", "shingles").mapInArrow(run, shape)


def _may_reach(threshold: float) -> Column:
    """Whether two sets of n and kn shingles with bitmaps b0, ... and k0, ... can have that Jaccard."""
    only = lambda x, y: sum((F.bit_count(F.col(f"{x}{i}").bitwiseAND(F.bitwise_not(f"{y}{i}"))) for i in range(WORDS)), F.lit(0))
    both = F.least(F.col("n") - only("b", "k"), F.col("kn") - only("k", "b"))
    return both >= threshold * (F.col("n") + F.col("kn") - both) - 1e-6


def clone_links(docs: DataFrame, key: str, text: str, threshold: float = THRESHOLD, rounds: int = 1) -> DataFrame:
    """(a, b, similarity): links that join every class of texts connected by pairs that share a band and
    reach the threshold; similarity is the exact Jaccard of the shingles.

    Not all pairs of a bucket are formed. Round 0 tests each member against its bucket's smallest key, the
    next rounds one member outside the bucket's largest class against those of other classes, and the last
    step all members outside the largest class, whose sets are moved only where bitmaps of theirs leave the
    threshold open (`_may_reach`). Two members of one class are never tested, so no link between classes
    is missed, and a bucket of near copies costs its size. Copies with equal shingles are linked to the smallest
    key among them, which alone enters the buckets. Texts below LEAST_TOKENS tokens have no links."""
    buckets = F.transform(F.sequence(F.lit(0), F.lit(BANDS - 1)), lambda b: F.xxhash64(F.slice("signature", b * ROWS + 1, F.lit(ROWS))))
    sig = store(signatures(docs, key, text).select("key", "n", "h", buckets.alias("buckets")), "clones")
    first = sig.groupBy("h", "n").agg(F.min("key").alias("copy_of"))
    same = store(sig.select("key", "h", "n").join(first, ["h", "n"]).select("key", "copy_of"), "clones")
    copies = same.where("key <> copy_of").select(F.col("copy_of").alias("a"), F.col("key").alias("b"), F.lit(1.0).alias("similarity"))
    alone = sig.join(same.where("key = copy_of").select("key"), "key", "left_semi").dropDuplicates(["key", "n", "h"])
    rows = store(alone.select("key", "n", F.posexplode("buckets").alias("band", "bucket")), "clones")
    at = ["band", "bucket"]
    start = store(rows.groupBy(at).agg(F.min(F.struct("key", "n")).alias("p"), F.count(F.lit(1)).alias("m")).where("m > 1").drop("m"), "clones")
    rows = store(rows.join(start, at).select(*at, "key", "n", "p"), "clones")
    met = docs.select(F.col(key).alias("key"), F.col(text).alias("t")).join(rows.select("key").distinct(), "key", "left_semi")
    sets = store(met.select("key", shingle_hashes(F.col("t")).alias("shingles")), "shingles")
    sizes = lambda x, y: F.least(x, y) >= threshold * F.greatest(x, y)  # noqa: E731, a pair within the threshold is within it by size
    pairs = rows.where((F.col("key") != F.col("p.key")) & sizes(F.col("n"), F.col("p.n"))).select(F.col("p.key").alias("a"), F.col("key").alias("b")).distinct()
    links = store(_verified(pairs, sets, threshold), "clones")
    for turn in range(1, rounds + 2):
        ends = links.select(F.col("a").alias("id")).unionByName(links.select(F.col("b").alias("id"))).distinct()
        c = components(ends, links.select(F.col("a").alias("src"), F.col("b").alias("dst"))).select(F.col("id").alias("key"), "component")
        named = rows.drop("p").join(c, "key", "left").select(*at, "key", "n", F.coalesce("component", "key").alias("c"))
        by = named.groupBy(*at, "c").agg(F.count(F.lit(1)).alias("m"))
        main = by.groupBy(at).agg(F.max(F.struct("m", "c")).alias("main"), F.count(F.lit(1)).alias("classes")).where("classes > 1")
        left = store(named.join(main.select(*at, F.col("main.c").alias("main")), at), "clones")
        minor = left.where("c <> main")
        if minor.isEmpty():
            break
        if turn <= rounds:
            minor = minor.groupBy(at).agg(F.min(F.struct(F.xxhash64("key", F.lit(turn)), "key", "n", "c", "main")).alias("p")).select(*at, "p.key", "p.n", "p.c", "p.main")
        else:
            bits = _bitmaps(sets.join(left.select("key").distinct(), "key", "left_semi"))
            left = store(left.join(bits, "key"), "clones")
            minor = left.where("c <> main")
        one = minor.select(*at, F.col("key").alias("k"), F.col("n").alias("kn"), F.col("c").alias("kc"), *([F.col(b).alias(f"k{i}") for i, b in enumerate(_BITS)] if turn > rounds else []))
        met = left.join(one, at).where((F.col("c") != F.col("kc")) & sizes(F.col("n"), F.col("kn")))
        if turn > rounds:  # two members outside the largest class meet twice
            met = met.where(((F.col("c") == F.col("main")) | (F.col("k") < F.col("key"))) & _may_reach(threshold))
        pairs = met.select(F.least("k", "key").alias("a"), F.greatest("k", "key").alias("b")).distinct()
        links = store(links.unionByName(_verified(pairs, sets, threshold)), "clones")
    return links.unionByName(copies).dropDuplicates(["a", "b"])


def clone_classes(docs: DataFrame, key: str, text: str, threshold: float = THRESHOLD) -> DataFrame:
    """(key, class_id, class_size): every document with the smallest key of its class; texts without a
    clone, empty and short ones are a class of their own."""
    links = store(clone_links(docs, key, text, threshold), "clones")
    e = links.select(F.col("a").alias("src"), F.col("b").alias("dst"))
    ids = e.select(F.col("src").alias("id")).unionByName(e.select(F.col("dst").alias("id"))).distinct()
    c = components(ids, e)
    size = c.groupBy("component").agg(F.count(F.lit(1)).alias("m"))
    found = c.join(size, "component").select(F.col("id").alias("key"), "component", "m")
    out = docs.select(F.col(key).alias("key")).join(found, "key", "left")
    return out.select("key", F.coalesce("component", "key").alias("class_id"), F.coalesce("m", F.lit(1).cast("long")).alias("class_size"))


def clone_clusters(links: DataFrame) -> DataFrame:
    """(cluster, size, similarity): components of the links, with the links' mean similarity."""
    e = links.select(F.col("a").cast("string").alias("src"), F.col("b").cast("string").alias("dst"), "similarity")
    ids = e.select(F.col("src").alias("id")).unionByName(e.select(F.col("dst").alias("id"))).distinct()
    c = components(ids, e)
    size = c.groupBy("component").agg(F.count(F.lit(1)).alias("size"))
    mean = e.join(c.withColumnRenamed("id", "src"), "src").groupBy("component").agg(F.round(F.avg("similarity"), 6).alias("similarity"))
    return size.join(mean, "component").withColumnRenamed("component", "cluster")


def exact_duplicates(docs: DataFrame, key: str, text: str) -> DataFrame:
    """(digest, size, first): groups of equal texts."""
    return docs.groupBy(F.sha2(text, 256).alias("digest")).agg(F.count(F.lit(1)).alias("size"), F.min(key).alias("first")).where("size > 1")


def rare_shingles(docs: DataFrame, key: str, text: str, most: int) -> DataFrame:
    """Shingles per document that at most `most` documents hold (the boilerplate filter)."""
    s = docs.select(F.col(key).alias("key"), F.explode(shingle_hashes(F.col(text))).alias("s"))
    common = s.groupBy("s").agg(F.count(F.lit(1)).alias("df")).where(F.col("df") > most)
    return s.join(common, "s", "left_anti").groupBy("key").agg(F.count(F.lit(1)).alias("rare"))


def pack_by_rank(ranked: DataFrame, budget: int, by: str = "rank") -> DataFrame:
    """Greedy packing of one result page in order: what does not fit is passed over, later rows may
    still fit. ranked(key, score, cost, place); the page is bounded, so one fold does it."""
    order = {"rank": F.struct("place", "key", "cost"), "density": F.struct((-F.col("score") / F.greatest("cost", F.lit(1))).alias("o"), F.col("place"), F.col("key"), F.col("cost"))}[by]
    page = ranked.agg(F.sort_array(F.collect_list(order)).alias("p"))
    empty = F.struct(F.lit(0).cast("long").alias("used"), F.array().cast("array<bigint>").alias("keys"))
    fold = F.aggregate(
        "p", empty,
        lambda t, x: F.when(t["used"] + x["cost"] <= budget, F.struct((t["used"] + x["cost"]).alias("used"), F.array_append(t["keys"], x["key"]).alias("keys"))).otherwise(t),
    )
    return page.select(fold.alias("f")).select(F.posexplode("f.keys").alias("nth", "key"))


def rerank(candidates: DataFrame, weights: dict[str, float]) -> DataFrame:
    """Weighted sum of signals, each cut to 0..1; candidates(key, rank, signal columns). Ties: rank, key."""
    total = F.lit(0.0)
    for name, w in weights.items():
        total = total + w * F.greatest(F.least(F.coalesce(F.col(name).cast("double"), F.lit(0.0)), F.lit(1.0)), F.lit(0.0))
    return candidates.select("key", "rank", F.round(total, 6).alias("score"))
