"""Operator 5, benchmark decontamination: size-partitioned MinHash containment search.

An item is found in a document when at least `percent` of its distinct 5-word shingles are there
(lower-cased words; items with fewer words count as one shingle, and match only as a whole text).

Items are partitioned by size (powers of two). An item's sketch holds its k smallest shingle hashes,
k = n - ceil(percent * n / 100) + 1: if the item is contained, at most k - 1 of its shingles are
missing, so at least one sketch value is in the document. Each partition has a threshold, the largest
value of its own sketches, and a table of its own; a document is searched in a partition with its
hashes up to that threshold. So the search has no false negatives, larger items need a smaller part of
a document's hashes, and small items do not raise the threshold of large ones. Candidates are then
verified by exact containment of the shingles, as words.

Short items lie in long documents, where a signature of fixed length for the whole document would
miss them; a sketch by threshold grows with the document and does not.

The items' sketches are broadcast up to MAX_BROADCAST_ITEMS items, a size that is counted first.
Beyond that, documents' sketches are joined to them by partition and hash; a bitmap of fixed size
(BITMAP_BITS) lets only hashes pass that some sketch may hold. Both ways return the same rows.

Defined cases: null and empty texts have no shingles, contain nothing and are contained in nothing; a
null doc_id or item_id is an id like any other; repeated rows, of documents or items, each count, and
rows that share an id but not the text are told apart; extra columns, whatever their names, are left out
of the report and come back unchanged from `drop_contaminated`; an empty table on either side gives no
rows.
"""

from __future__ import annotations

import re

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import WORD_REGEX, boxed, byte_slices, materialize, text_buffers, unboxed
from .wordhash import shingle_sets

PERCENT = 75
SHINGLE = 5
MAX_BROADCAST_ITEMS = 20_000
#: Bits of the filter before the join, a power of two: 2 MB whatever the input.
BITMAP_BITS = 1 << 24

_WORD = re.compile(WORD_REGEX)
_LOWER = {c: c + 32 for c in range(65, 91)}
_NAMES = ["doc_id", "tag", "item_id", "n_shingles", "n_found"]
_FOUND = "doc_id long, tag long, item_id long, n_shingles long, n_found long"


def word_shingles(text: str | None) -> set[str]:
    """The distinct shingles themselves, words joined by a space."""
    w = _WORD.findall((text or "").translate(_LOWER))
    if not w:
        return set()
    return {" ".join(w[i : i + SHINGLE]) for i in range(max(1, len(w) - SHINGLE + 1))}


def sketch_size(n: int, percent: int = PERCENT) -> int:
    return n - -(-percent * n // 100) + 1 if n else 0


def _tag(text: str = "text") -> Column:
    """Tells rows that share an id apart by their text."""
    return F.xxhash64(text)


def _size_class(n: np.ndarray) -> np.ndarray:
    """The partition of a size: its number of bits."""
    return np.frexp(n.astype(np.float64))[1].astype(np.int32)


def _sketches(batch: pa.RecordBatch, percent: int):
    """(row, size class, value) arrays of the sketches of a batch's texts."""
    sets = shingle_sets(*text_buffers(batch.column("text")))
    size = np.array([len(x) for x in sets], np.int64)
    each = np.array([sketch_size(n, percent) for n in size.tolist()], np.int64)
    values = np.concatenate([x[:k] for x, k in zip(sets, each.tolist(), strict=True)]) if len(sets) else np.zeros(0, np.uint64)
    row = np.repeat(np.arange(len(sets)), each)
    return row, _size_class(size)[row], values


def _cut_sets(sets: list[np.ndarray], top: int) -> tuple[np.ndarray, np.ndarray]:
    """(row, value) of all hashes up to a partition's threshold."""
    some = [x[: np.searchsorted(x, np.uint64(top), "right")] for x in sets]
    return np.repeat(np.arange(len(some)), [len(x) for x in some]), np.concatenate(some)


def _verified(docs: DataFrame, items: DataFrame, percent: int) -> DataFrame:
    """Candidates by sketch and their verification in one pass, with the items in memory."""
    rows = items.select(F.col("item_id").cast("long").alias("item_id"), "text").collect()  # counted: bounded
    batch = pa.record_batch([pa.array([r["text"] for r in rows], pa.string())], ["text"])
    item, size_class, value = _sketches(batch, percent)
    partitions = []  # (threshold, sorted values, the items of each)
    for c in np.unique(size_class):
        mine = np.flatnonzero(size_class == c)
        mine = mine[np.argsort(value[mine], kind="stable")]
        known, at = np.unique(value[mine], return_index=True)
        partitions.append((int(known[-1]), known, np.split(item[mine], at[1:])))
    shared = docs.sparkSession.sparkContext.broadcast(([(r["item_id"], r["text"]) for r in rows], partitions))

    def run(batches):
        items, partitions = shared.value
        shingles: dict[int, set[str]] = {}
        for whole in batches:
            for b in byte_slices(whole, "text"):
                sets = shingle_sets(*text_buffers(b.column("text")))
                if not sets or not partitions:
                    continue
                found: dict[int, set[int]] = {}
                for top, known, owners in partitions:
                    row, flat = _cut_sets(sets, top)
                    at = np.minimum(np.searchsorted(known, flat), len(known) - 1)
                    hit = known[at] == flat
                    for r, k in zip(row[hit].tolist(), at[hit].tolist(), strict=True):
                        found.setdefault(r, set()).update(owners[k].tolist())
                out = []
                ids, tags, bodies = (b.column(c) for c in ("doc_id", "tag", "text"))
                for r, candidates in found.items():
                    have = word_shingles(bodies[r].as_py())
                    for item in sorted(candidates):
                        if item not in shingles:
                            shingles[item] = word_shingles(items[item][1])
                        n, inter = len(shingles[item]), len(shingles[item] & have)
                        if n and 100 * inter >= percent * n:
                            out.append((ids[r].as_py(), tags[r].as_py(), items[item][0], n, inter))
                if out:
                    yield pa.record_batch([pa.array(c, pa.int64()) for c in zip(*out, strict=True)], _NAMES)

    return _tagged(docs, "doc_id").mapInArrow(run, _FOUND)


def _tagged(rows: DataFrame, key: str) -> DataFrame:
    return rows.select(F.col(key).cast("long").alias(key), _tag().alias("tag"), "text")


def _bitmap(sketches: DataFrame) -> np.ndarray:
    """One bit for each sketch value's low bits: BITMAP_BITS at most, set in groups of 32."""
    places = sketches.select((F.col("value").bitwiseAND(F.lit(BITMAP_BITS - 1))).cast("int").alias("place"))
    words = places.groupBy(F.expr("place div 32").alias("word")).agg(F.expr("bit_or(shiftleft(1L, place % 32))").alias("bits"))
    out = np.zeros(BITMAP_BITS // 32, np.uint32)
    for r in words.collect():  # BITMAP_BITS / 32 rows at most
        out[r["word"]] = r["bits"] & 0xFFFFFFFF
    return out


def _joined(docs: DataFrame, items: DataFrame, percent: int) -> DataFrame:
    """The same for item sets too large to broadcast: sketches meet by partition and hash."""
    spark = docs.sparkSession

    def sketch(batches):
        for whole in batches:
            for b in byte_slices(whole, "text"):
                row, size_class, value = _sketches(b, percent)
                own = [b.column(c).take(pa.array(row)) for c in ("item_id", "tag")]
                yield pa.record_batch([*own, pa.array(size_class, pa.int32()), pa.array(value.view(np.int64))], ["item_id", "item_tag", "class", "value"])

    items = _tagged(items, "item_id")
    sketches = materialize(items.mapInArrow(sketch, "item_id long, item_tag long, class int, value long").distinct(), "decontaminate-sketches")
    unsigned = F.max(F.struct((F.col("value") < 0).alias("high"), F.col("value")))
    tops = {r["class"]: r["top"]["value"] % (1 << 64) for r in sketches.groupBy("class").agg(unsigned.alias("top")).collect()}  # 64 at most
    shared = spark.sparkContext.broadcast((tops, _bitmap(sketches)))

    def cut(batches):
        tops, bitmap = shared.value
        for whole in batches:
            for b in byte_slices(whole, "text"):
                sets = shingle_sets(*text_buffers(b.column("text")))
                for c, top in tops.items() if sets else ():
                    row, value = _cut_sets(sets, top)
                    place = value & np.uint64(BITMAP_BITS - 1)
                    may = (bitmap[(place >> np.uint64(5)).astype(np.int64)] >> (place & np.uint64(31)).astype(np.uint32)) & np.uint32(1) > 0
                    own = [b.column(x).take(pa.array(row[may])) for x in ("doc_id", "tag")]
                    yield pa.record_batch([*own, pa.array(np.full(may.sum(), c, np.int32)), pa.array(value[may].view(np.int64))], ["doc_id", "tag", "class", "value"])

    tagged = _tagged(docs, "doc_id")
    values = tagged.mapInArrow(cut, "doc_id long, tag long, class int, value long").distinct()
    pairs = materialize(values.join(sketches, ["class", "value"]).select("doc_id", "tag", "item_id", "item_tag").distinct(), "decontaminate-pairs")

    def verify(batches):
        for b in batches:
            out = []
            for doc, tag, item, t, i in zip(*[b.column(c).to_pylist() for c in ("doc_id", "tag", "item_id", "text", "item_text")], strict=True):
                own = word_shingles(i)
                inter = len(own & word_shingles(t))
                if own and 100 * inter >= percent * len(own):
                    out.append((doc, tag, item, len(own), inter))
            if out:
                yield pa.record_batch([pa.array(c, pa.int64()) for c in zip(*out, strict=True)], _NAMES)

    d = tagged.select(F.col("doc_id").alias("_doc"), F.col("tag").alias("_tag"), "text")
    i = items.select(F.col("item_id").alias("_item"), F.col("tag").alias("_item_tag"), F.col("text").alias("item_text"))
    met = pairs.join(i, F.col("item_id").eqNullSafe(F.col("_item")) & (F.col("item_tag") == F.col("_item_tag")))
    met = met.join(d, F.col("doc_id").eqNullSafe(F.col("_doc")) & (F.col("tag") == F.col("_tag")))
    return met.select("doc_id", "tag", "item_id", "text", "item_text").mapInArrow(verify, _FOUND)


def _found(docs: DataFrame, items: DataFrame, percent: int, max_broadcast: int) -> DataFrame:
    size = items.agg(F.count(F.lit(1)).alias("n"), F.coalesce(F.sum(F.octet_length("text")), F.lit(0)).alias("bytes")).first()
    few = size["n"] <= max_broadcast and size["bytes"] <= max_broadcast * 1000
    return (_verified if few else _joined)(docs, items, percent)


def contained_items(docs: DataFrame, items: DataFrame, percent: int = PERCENT, max_broadcast: int = MAX_BROADCAST_ITEMS) -> DataFrame:
    """doc_id, item_id, n_shingles, n_found of each item found in a document."""
    return _found(docs, items, percent, max_broadcast).drop("tag")


def drop_contaminated(docs: DataFrame, items: DataFrame, percent: int = PERCENT, max_broadcast: int = MAX_BROADCAST_ITEMS) -> DataFrame:
    """The documents in which no item is found, with their columns. A row goes by its own text: one that
    shares its doc_id with a contaminated row stays."""
    hits = _found(docs, items, percent, max_broadcast).select(F.col("doc_id").alias("_id"), F.col("tag").alias("_tag")).distinct()
    hits = materialize(hits, "decontaminate-hits")
    if hits.limit(200_001).count() <= 200_000:
        hits = F.broadcast(hits)
    kept = boxed(docs, id=F.col("doc_id").cast("long"), tag=_tag())
    return unboxed(kept.join(hits, F.col("id").eqNullSafe(F.col("_id")) & (F.col("tag") == F.col("_tag")), "left_anti"))
