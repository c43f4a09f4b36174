"""Operator 8, n-gram Jaccard join: a metric-space join over sets of 5-word shingles, exact.

Jaccard distance d(x, y) = 1 - |x & y| / |x | y| is a metric. Two documents link when d <= 1 - t.

1. Equal sets collapse to one row by a 128-bit digest: copies cost one map-side aggregate.
2. First pivots are single shingles. A set that holds shingle s lies at distance 1 - 1/|x| from {s},
   all others at 1. Shingles have one global order (rare first, by a fixed-size count of all
   shingles; then by hash), and a set lies in the cells of its first |x| - ceil(t |x|) + 1
   shingles: sets in no common cell share too few shingles to link, so these windows lose nothing.
   Document pivots alone do not divide such data: a document stays out of a foreign region only
   where it is nearer than 1/2 to its own pivot, and unrelated texts are all at distance 1.
3. Within each cell documents are the pivots, the most central first. Every member's exact distance
   to the pivot is taken; members within 1 - t link to it and form its region. Later pivots meet the
   members of other components, and by the triangle inequality only those whose distance to the
   first pivot differs by at most 1 - t from the later one's: those form its window. Cells whose members
   are all in one component are done; the others recurse while that shrinks them. In the last step
   the few members outside their cell's largest component meet the others through their windows.

Shingles are 64-bit hashes of their words: two different shingles fall together with a chance of 2**-64 a
pair, and a link is decided on the hashes.

Members of a cell's largest component never meet each other, so a group of thousands of near copies
costs a few distances a member. Links inside one component are left untested; they cannot change a
component.

Defined cases: null text, empty text and text without words have an empty set, n_shingles 0 and
themselves as component; fewer than five words make one shingle; repeated rows each get a row and
share a component; a null doc_id takes part and yields to any other as component_id; very long texts
are sets like any other; extra columns are left out, and come back unchanged from `keep_one_of_each`; an
empty table gives no rows.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import BROADCAST_ROWS, boxed, byte_slices, discard, join_dimension, materialize, release, settle, text_buffers, unboxed
from .components import components
from .wordhash import shingle_sets

#: The link rule: 100 * |x & y| >= PERCENT * |x | y|.
PERCENT = 75
#: Counters of the fixed-size table of shingle frequencies: 2**COUNT_BITS, whatever the input.
COUNT_BITS = 18
#: A further round with one pivot for each cell must leave at most this share of the members that
#: are outside their cell's largest component; else the rest are compared through their windows.
SHRINK = 0.85


#: Slices of the hash space whose counts make a set's signature, and those of a second, finer one for
#: sets above LARGE, whose random differences the first does not tell from a link's.
SLICES, FINE, LARGE = 128, 1024, 512


def _key(values: np.ndarray, salt: int) -> int:
    return xxhash.xxh3_64_intdigest(values.tobytes(), salt) - (1 << 63)


def _survey(docs: DataFrame, salt: int) -> DataFrame:
    """Rows (doc_id, tag, n, digest, key, slices) of each document, and rows (bucket, hits) of the shingle
    counts."""
    names = ["doc_id", "tag", "n", "digest", "key", "slices", "fine", "bucket", "hits"]

    def count(s: np.ndarray, size: int) -> np.ndarray:
        return np.minimum(np.bincount((s % np.uint64(size)).astype(np.int64), minlength=size), 127).astype(np.int8)

    def run(batches):
        hits = np.zeros(1 << COUNT_BITS, np.int64)
        for whole in batches:
            for b in byte_slices(whole, "text"):
                sets = shingle_sets(*text_buffers(b.column("text")))
                every = np.concatenate(sets)
                hits += np.bincount((every >> np.uint64(64 - COUNT_BITS)).astype(np.int64), minlength=len(hits))
                none = pa.nulls(len(sets), pa.int64())
                yield pa.record_batch(
                    [
                        b.column("doc_id").cast(pa.int64()),
                        b.column("tag"),
                        pa.array([len(s) for s in sets], pa.int64()),
                        pa.array([xxhash.xxh3_128_digest(s.tobytes()) if len(s) else None for s in sets], pa.binary()),
                        pa.array([_key(s, salt) if len(s) else None for s in sets], pa.int64()),
                        pa.array([count(s, SLICES) if len(s) else None for s in sets], pa.list_(pa.int8())),
                        pa.array([count(s, FINE) if len(s) > LARGE else None for s in sets], pa.list_(pa.int8())),
                        none,
                        none,
                    ],
                    names,
                )
        at = np.flatnonzero(hits)
        none = pa.nulls(len(at), pa.int64())
        empty = [none, none, none, pa.nulls(len(at), pa.binary()), none, *[pa.nulls(len(at), pa.list_(pa.int8()))] * 2]
        yield pa.record_batch([*empty, pa.array(at), pa.array(hits[at])], names)

    shape = "doc_id long, tag long, n long, digest binary, key long, slices array<tinyint>, fine array<tinyint>, bucket long, hits long"
    return docs.select("doc_id", F.xxhash64("text").alias("tag"), "text").mapInArrow(run, shape)


def _levels(survey: DataFrame) -> np.ndarray:
    """Per bucket 0, or how far its count stands out of the mean's noise, as a power of two."""
    rows = survey.where("bucket is not null").groupBy("bucket").agg(F.sum("hits").alias("hits"))
    counts = np.zeros(1 << COUNT_BITS)
    for r in rows.collect():  # 2**COUNT_BITS rows at most
        counts[r["bucket"]] = r["hits"]
    mean = max(1.0, counts.mean())
    over = (counts - mean) / (6 * np.sqrt(mean) + 6)
    return np.where(over > 1, 1 + np.floor(np.log2(np.maximum(over, 1))), 0).astype(np.int8)


def _in_order(values: np.ndarray, levels: np.ndarray) -> np.ndarray:
    """The set in the global order: level, then hash (the set comes sorted by hash)."""
    level = levels[(values >> np.uint64(64 - COUNT_BITS)).astype(np.int64)]
    return values[np.argsort(level, kind="stable")] if level.any() else values


def _cells(docs: DataFrame, levels: np.ndarray, percent: int, salt: int) -> DataFrame:
    """(cell, key, n, at) of each distinct set and each of its first shingles."""

    def run(batches):
        seen: set[int] = set()
        for whole in batches:
            for b in byte_slices(whole, "text"):
                cells, owners, sizes, places = [], [], [], []
                for s in shingle_sets(*text_buffers(b.column("text"))):
                    if not len(s) or (key := _key(s, salt)) in seen:
                        continue
                    seen.add(key)
                    n = len(s)
                    some = n - -(-percent * n // 100) + 1
                    cells.append(_in_order(s, levels)[:some])
                    owners.append(np.full(some, key, np.int64))
                    sizes.append(np.full(some, n, np.int32))
                    places.append(np.arange(some, dtype=np.int32))
                if cells:
                    columns = [np.concatenate(cells).view(np.int64), np.concatenate(owners), np.concatenate(sizes), np.concatenate(places)]
                    yield pa.record_batch([pa.array(c) for c in columns], ["cell", "key", "n", "at"])

    return docs.select("text").mapInArrow(run, "cell long, key long, n int, at int")


def _sets_of(docs: DataFrame, wanted: DataFrame, salt: int) -> DataFrame:
    """(key, shingles) of the wanted representatives(key, doc_id), from their texts."""
    texts = join_dimension(docs.select("doc_id", "text"), wanted.select("doc_id").distinct(), ["doc_id"], "left_semi")

    def run(batches):
        seen: set[int] = set()
        for whole in batches:
            for b in byte_slices(whole, "text"):
                pairs = [(_key(s, salt), s) for s in shingle_sets(*text_buffers(b.column("text"))) if len(s)]
                pairs = [p for p in pairs if not (p[0] in seen or seen.add(p[0]))]
                if pairs:
                    yield pa.record_batch(
                        [pa.array([k for k, _ in pairs], pa.int64()), pa.array([s.view(np.int64) for _, s in pairs], pa.list_(pa.int64()))],
                        ["key", "shingles"],
                    )

    found = texts.mapInArrow(run, "key long, shingles array<long>").dropDuplicates(["key"])
    return found.join(wanted.select("key"), "key", "left_semi")


def _may_link(p: int, n1: str, n2: str, at1: str, at2: str) -> Column:
    """Bounds from the sizes and from the places in the global order: false only where a pair can't
    link, or shares an earlier cell."""
    a, b = F.col(n1).cast("long"), F.col(n2).cast("long")
    most = F.least(a - F.col(at1), b - F.col(at2))
    return (100 * F.least(a, b) >= p * F.greatest(a, b)) & ((100 + p) * most >= p * (a + b))


def _near_enough(pairs: DataFrame, heads: DataFrame, percent: int) -> DataFrame:
    """pairs(a, b) without those that the counts by slice rule out. The counts map a set to a point,
    and the distance of two points (sum of differences) is at most the size of the sets' symmetric
    difference; a link allows (100 - p) / (100 + p) of the sum of the sizes."""

    def close(some: DataFrame, counts: str) -> DataFrame:
        own = heads.where(F.col(counts).isNotNull())
        one = own.select(F.col("key").alias("a"), F.col("n").alias("_n"), F.col(counts).alias("_s"))
        two = own.select(F.col("key").alias("b"), F.col("n").alias("_m"), F.col(counts).alias("_t"))
        apart = F.aggregate(F.zip_with("_s", "_t", lambda x, y: F.abs(x.cast("int") - y.cast("int"))), F.lit(0), lambda t, x: t + x)
        met = some.select("a", "b").join(one, "a").join(two, "b")
        return met.where((100 + percent) * apart <= (100 - percent) * (F.col("_n") + F.col("_m"))).select("a", "b", F.least("_n", "_m").alias("n"))

    first = materialize(close(pairs, "slices"), "jaccard-close")
    return first.where(F.col("n") <= LARGE).select("a", "b").unionByName(close(first.where(F.col("n") > LARGE), "fine").select("a", "b"))


def _distances(pairs: DataFrame, sets: DataFrame) -> DataFrame:
    """pairs(a, b) with the size of the intersection and of the union."""
    left = sets.select(F.col("key").alias("a"), F.col("shingles").alias("_x"))
    right = sets.select(F.col("key").alias("b"), F.col("shingles").alias("_y"))
    both = F.size(F.array_intersect("_x", "_y"))
    joined = pairs.join(left, "a").join(right, "b")
    return joined.select("a", "b", both.alias("inter"), (F.size("_x") + F.size("_y") - both).alias("uni"))


def _grouped(docs: DataFrame, percent: int) -> DataFrame:
    """doc_id, tag (of the text), n_shingles, component_id, group (a number of the component, null for
    texts without words) of each document."""
    spark = docs.sparkSession
    for salt in range(16):  # 64-bit keys are told apart by their 128-bit digests; a clash takes a new salt
        survey = materialize(_survey(docs, salt), "jaccard-survey")
        own = survey.where("bucket is null").select("doc_id", "tag", F.col("n").alias("n_shingles"), "digest", "key")
        heads = survey.where("key is not null").groupBy("digest", "key")
        heads = materialize(heads.agg(F.min("doc_id").alias("doc_id"), F.first("n").alias("n"), F.first("slices").alias("slices"), F.first("fine").alias("fine")), "jaccard-heads")
        if heads.groupBy("key").count().where("count > 1").isEmpty():
            break

    cells = _with_centres(_cells(docs, _levels(survey), percent, salt))
    release(spark)

    labels, sets, minors, last = None, None, None, False
    pairs = _with_pivots(cells, percent)
    while True:
        pairs, told = materialize(_near_enough(pairs, heads, percent), "jaccard-pairs"), None
        if not pairs.isEmpty():
            wanted = pairs.select(F.col("a").alias("key")).unionByName(pairs.select(F.col("b").alias("key"))).distinct()
            if sets is not None:
                wanted = wanted.join(sets.select("key"), "key", "left_anti")
            wanted = materialize(wanted.join(heads.select("key", "doc_id"), "key"), "jaccard-wanted")
            more = materialize(_sets_of(docs, wanted, salt), "jaccard-sets")
            sets = more if sets is None else sets.unionByName(more)
            told = materialize(_distances(pairs, sets), "jaccard-distances")
            release(spark)
            fresh = told.where(100 * F.col("inter") >= percent * F.col("uni")).select("a", "b")
            if labels is not None:
                fresh = fresh.unionByName(labels.select(F.col("key").alias("a"), F.col("component").alias("b")))
            labels = materialize(components(fresh), "jaccard-labels")
        elif labels is None:
            labels = spark.createDataFrame([], "key long, component long")
        if last:
            break
        used, cells = cells, _remaining(cells, told, labels)
        discard(used)
        before, minors = minors, cells.where("not major").count()
        if not minors:
            break
        last = before is not None and minors > SHRINK * before
        pairs = _with_minors(cells, percent) if last else _with_pivots(cells, percent)

    names = labels.join(heads.select("key", "doc_id"), "key").groupBy("component").agg(F.min("doc_id").alias("component_id"))
    named = labels.join(names, "component").select("key", "component_id", F.col("component").alias("group"))
    lone = heads.join(named, "key", "left_anti").select("key", F.col("doc_id").alias("component_id"), F.col("key").alias("group"))
    out = own.join(named.unionByName(lone), "key", "left")
    return out.select("doc_id", "tag", "n_shingles", F.coalesce("component_id", "doc_id").alias("component_id"), "group")


def jaccard_components(docs: DataFrame, percent: int = PERCENT) -> DataFrame:
    """doc_id, n_shingles, component_id of each document."""
    return _grouped(docs, percent).drop("tag", "group")


def keep_one_of_each(docs: DataFrame, percent: int = PERCENT) -> DataFrame:
    """docs with one document of each component, that with the smallest doc_id (a null one comes last); of
    rows that repeat both doc_id and text one stays. Documents without words stay, all of them."""
    found = settle(lambda: _grouped(docs, percent).where("group is not null").select("doc_id", "tag", "group"), "jaccard-components")
    order = F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "tag")
    keepers = materialize(found.groupBy("group").agg(F.min(order).alias("keeper")), "jaccard-keepers")
    told = found.join(keepers, "group").groupBy("doc_id", "tag").agg(
        F.count(F.lit(1)).alias("copies"), F.first(F.col("doc_id").eqNullSafe(F.col("keeper.doc_id")) & (F.col("tag") == F.col("keeper.tag"))).alias("stays")
    )
    told = materialize(told.where("not stays or copies > 1").select(F.col("doc_id").alias("_id"), F.col("tag").alias("_tag"), "stays"), "jaccard-kept")
    rows = boxed(docs, id=F.col("doc_id").cast("long"), tag=F.xxhash64("text"))

    def match(some: DataFrame, how: str) -> DataFrame:
        some = F.broadcast(some) if some.limit(BROADCAST_ROWS + 1).count() <= BROADCAST_ROWS else some
        return rows.join(some, F.col("id").eqNullSafe(F.col("_id")) & (F.col("tag") == F.col("_tag")), how)

    repeated = told.where("stays").drop("stays")
    left = match(told.drop("stays"), "left_anti")
    if not repeated.isEmpty():
        left = left.unionByName(match(repeated, "left_semi").dropDuplicates(["id", "tag"]))
    return unboxed(left)


def _in_window(percent: int) -> Column:
    """What the distances to the cell's earlier pivot leave possible."""
    return F.coalesce(F.abs(F.col("d") - F.col("d2")) <= 1 - percent / 100 + 1e-9, F.lit(True))


def _with_pivots(cells: DataFrame, percent: int) -> DataFrame:
    """Each member with its cell's pivot, where they may link and are in different components."""
    later = "component" in cells.columns
    more = [F.col("component").alias("c2"), F.col("d").alias("d2")] if later else []
    pivot = cells.where("key = pivot").select("cell", F.col("n").alias("n2"), F.col("at").alias("at2"), *more)
    met = cells.where("key <> pivot").join(pivot, "cell").where(_may_link(percent, "n", "n2", "at", "at2"))
    if later:
        met = met.where(_in_window(percent) & (F.col("component") != F.col("c2")))
    return met.select(F.col("pivot").alias("a"), F.col("key").alias("b")).distinct()


def _with_minors(cells: DataFrame, percent: int) -> DataFrame:
    """Members outside their cell's largest component with all members of other components."""
    one = cells.where("not major").select(
        "cell", F.col("key").alias("a"), F.col("n").alias("n1"), F.col("at").alias("at1"), F.col("d"), F.col("component").alias("c1")
    )
    two = cells.select(
        "cell", F.col("key").alias("b"), F.col("n").alias("n2"), F.col("at").alias("at2"), F.col("d").alias("d2"), F.col("component").alias("c2"), "major"
    )
    met = one.join(two, "cell").where((F.col("c1") != F.col("c2")) & (F.col("major") | (F.col("a") < F.col("b"))))
    return met.where(_may_link(percent, "n1", "n2", "at1", "at2") & _in_window(percent)).select("a", "b").distinct()


def _with_centres(cells: DataFrame) -> DataFrame:
    """The cells of two sets at least, each with its most central member as pivot.

    A set is central when its cells are large for its size: of a group of near copies, the text they
    come from has all its shingles in the others' cells, and lies nearest to them. What a cell needs to
    know of all its members comes from map-side aggregates that are joined back, so that a cell with a
    third of all sets is split like any hot join key; no window gathers it.
    """
    sizes = cells.groupBy("cell").agg(F.min("key").alias("low"), F.max("key").alias("high"), F.count(F.lit(1)).alias("m"))
    sizes = materialize(sizes.where("low <> high").select("cell", "m"), "jaccard-sizes")
    release(cells.sparkSession)
    full = materialize(cells.join(sizes, "cell").distinct(), "jaccard-cells")
    discard(sizes)
    release(cells.sparkSession)
    central = full.groupBy("key").agg(F.round(-F.sum(F.log2("m")) / (F.first("n") / 4 + 1), 3).alias("order"))
    ordered = materialize(full.drop("m").join(central, "key"), "jaccard-ordered")
    discard(full)
    out = _with_pivot(ordered, ordered)
    discard(ordered)
    return out


def _with_pivot(cells: DataFrame, among: DataFrame) -> DataFrame:
    """cells with the most central of `among` in each cell as pivot."""
    best = among.groupBy("cell").agg(F.min(F.struct("order", "key")).alias("_best"))
    # stored first: a hot cell is split only where both sides of the join come straight from a shuffle
    best = materialize(best.select("cell", F.col("_best.key").alias("pivot")), "jaccard-pivots")
    out = materialize(cells.join(best, "cell"), "jaccard-cells")
    discard(best)
    return out


def _remaining(cells: DataFrame, told: DataFrame | None, labels: DataFrame) -> DataFrame:
    """Cells with members of two components at least, without their used pivots, which have met all
    members they may link to. major: in the cell's largest component, whose most central member is
    the next pivot; d: the distance to the cell's first pivot, where it was measured."""
    keep = cells.where("key <> pivot").drop("component", "major")
    if "d" not in cells.columns and told is None:
        keep = keep.withColumn("d", F.lit(None).cast("double"))
    elif "d" not in cells.columns:
        d = told.select(F.col("a").alias("pivot"), F.col("b").alias("key"), (1 - F.col("inter") / F.col("uni")).alias("d"))
        keep = keep.join(d, ["pivot", "key"], "left")
    keep = keep.join(labels, "key", "left").withColumn("component", F.coalesce("component", "key"))
    keep = kept = materialize(keep.select("cell", "key", "n", "at", "order", "d", "component"), "jaccard-kept-cells")
    held = keep.groupBy("cell", "component").agg(F.count(F.lit(1)).alias("m"))
    tops = held.groupBy("cell").agg(F.max(F.struct("m", "component")).alias("top"), F.sum("m").alias("all"))
    tops = materialize(tops.where("top.m < all").select("cell", F.col("top.component").alias("_top")), "jaccard-tops")
    keep = keep.join(tops, "cell").withColumn("major", F.col("_top") == F.col("component")).drop("_top")
    split = materialize(keep, "jaccard-split-cells")
    out = _with_pivot(split, split.where("major"))
    discard(kept, tops, split)
    return out
