"""Operator 7, substring dedup: content-defined chunks find repeated passages of MIN_WORDS words or more.

A passage is a run of whole words with the white space between them, equal byte by byte. Every window
of MIN_WORDS words that occurred before is found:

1. Chunks: a gear hash rolls over the words, and a chunk ends before each place whose hash of the
   next GEAR_WORDS words falls below a threshold (one word in AVERAGE). Places depend on those words
   alone, so an insertion shifts no other boundary, and a copy of a passage has the same chunks as the
   passage but for its ends. A chunk is digested up to the last word its two boundaries depend on.
   Chunks with one digest in two places are shared.
2. Neighbouring shared chunks whose first holders (smallest doc_id, then position) lie in one other text
   at one distance show that the text between them is that text's: such a span is repeated as it stands.
3. Windows: a window that holds a chunk which is not shared cannot be a copy. All other windows of
   MIN_WORDS words are digested, also the few that hold no whole chunk. Of windows with one digest the
   first is kept; the others repeat it. The first copy of a window is never in a span of step 2, so none
   is missed. A window that overlaps its own first occurrence is no repeat of it.
4. Overlapping repeated spans and windows of a document form one run.

Hot digests are pre-aggregated map-side to (digest, first holder); the join back to the chunks is an
equi-join that AQE splits where a digest is hot.

Defined cases: texts of fewer than MIN_WORDS words, null and empty ones have no windows; repeats
inside one text count, the first stays; a null doc_id is an id like any other and sorts first; of rows
with one doc_id, equal texts share positions, so they repeat only other documents, and different texts
are told apart; extra columns are left out; an empty table gives no rows.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import byte_slices, discard, materialize, release, text_buffers
from .wordhash import mix, words

MIN_WORDS = 50
#: Words that a boundary depends on (a power of two), and words a chunk on average.
GEAR_WORDS = 4
AVERAGE = 8

_CHUNKS = "doc_id long, tag int, start int, end int, h1 long, h2 long"
DIGEST = ["h1", "h2"]


def gear(word: np.ndarray, size: int = GEAR_WORDS) -> np.ndarray:
    """h[i] = sum of word[i + j] << j for j < size, modulo 2**64, by doubling; mixed."""
    h = word.copy()
    step = 1
    while step < size:
        h[:-step] += h[step:] << np.uint64(step)
        step *= 2
    return mix(h)


def chunk_words(doc: np.ndarray, word: np.ndarray, average: int = AVERAGE) -> tuple[np.ndarray, np.ndarray]:
    """(first word, word after the last that its boundaries depend on) of each chunk between two
    boundaries of one text."""
    if len(word) <= GEAR_WORDS:
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    at = np.flatnonzero((gear(word) < np.uint64((1 << 64) // average))[: len(word) - GEAR_WORDS + 1])
    at = at[doc[at] == doc[at + GEAR_WORDS - 1]]
    first, after = at[:-1], at[1:]
    same = doc[first] == doc[after]
    return first[same], after[same] + GEAR_WORDS


def _digests(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> list[pa.Array]:
    """128-bit digests as two columns of 64 bits, which rows hold in less room than bytes."""
    view = memoryview(data.tobytes())
    raw = b"".join([xxhash.xxh3_128_digest(view[s:e]) for s, e in zip(starts.tolist(), ends.tolist(), strict=True)])
    both = np.frombuffer(raw, np.int64).reshape(-1, 2)
    return [pa.array(both[:, 0]), pa.array(both[:, 1])]


def _tagged(docs: DataFrame) -> DataFrame:
    return docs.select(F.col("doc_id").cast("long"), F.hash("text").alias("tag"), "text")


def chunks(docs: DataFrame, average: int = AVERAGE) -> DataFrame:
    """doc_id, tag (of the text, for ids that repeat), start, end (bytes of the UTF-8 text), h1 and h2 (the
    digest) of each chunk."""

    def run(batches):
        for whole in batches:
            for b in byte_slices(whole, "text"):
                data, offsets = text_buffers(b.column("text"))
                start, end, doc, word = words(data, offsets, lower=False)
                first, after = chunk_words(doc, word, average)
                if len(first):
                    s, e, row = start[first], end[after - 1], doc[first]
                    own = [b.column(c).take(pa.array(row)) for c in ("doc_id", "tag")]
                    yield pa.record_batch([*own, *[pa.array((x - offsets[row]).astype(np.int32)) for x in (s, e)], *_digests(data, s, e)], ["doc_id", "tag", "start", "end", *DIGEST])

    return _tagged(docs).mapInArrow(run, _CHUNKS)


def _shared(rows: DataFrame, label: str, *columns: str) -> DataFrame:
    """h1, h2, first (holder) of the digests found in two places or more."""
    place = F.struct("doc_id", *columns)
    ends = rows.groupBy(*DIGEST).agg(F.min(place).alias("first"), F.max(place).alias("last"))
    out = materialize(ends.where("first <> last").select(*DIGEST, "first"), label)
    release(rows.sparkSession)
    return out


def _spans(row, own, start, first_id, first_tag, first_start, at, to, min_words: int):
    """Of shared chunks sorted by (row, start), of words `at` to `to`: (first word, word after the last,
    place among the chunks) of each span of min_words words that repeats one other text."""
    known = np.array(first_id.is_valid()) & np.array(own.is_valid())
    keeper, own = np.array(first_id.fill_null(0)), np.array(own.fill_null(0))
    known &= keeper != own
    far = first_start - start
    new = np.ones(len(row), bool)
    new[1:] = ~known[1:] | ~known[:-1] | (at[1:] > to[:-1])
    for x in (row, keeper, first_tag, far):
        new[1:] |= x[1:] != x[:-1]
    lead = np.flatnonzero(new)
    low, high = at[lead], to[np.append(lead[1:], len(row)) - 1] if len(row) else lead
    keep = known[lead] & (high - low >= min_words)
    return low[keep], high[keep], lead[keep]


def windows(docs: DataFrame, min_words: int = MIN_WORDS, average: int = AVERAGE) -> DataFrame:
    """doc_id, tag, nth and last (first words of the first and last window of min_words words), start, end
    (bytes): spans that repeat keeper_id, and single windows without an unshared chunk, with a digest."""
    every = chunks(docs, average).drop("end")
    shared = _shared(every, "substring-chunks", "tag", "start")
    met = every.join(shared, DIGEST)
    hit = F.struct("start", F.col("first.doc_id").alias("id"), F.col("first.tag").alias("tag"), F.col("first.start").alias("at"))
    hits = met.select(F.col("doc_id").alias("hit_id"), F.col("tag").alias("hit_tag"), hit.alias("hit")).groupBy("hit_id", "hit_tag").agg(F.array_sort(F.collect_set("hit")).alias("hits"))
    hits = materialize(hits, "substring-hits")
    discard(shared)
    release(docs.sparkSession)
    names = ["doc_id", "tag", "nth", "last", "start", "end", *DIGEST, "keeper_id"]

    def run(batches):
        for whole in batches:
            for b in byte_slices(whole, "text"):
                data, offsets = text_buffers(b.column("text"))
                start, end, doc, word = words(data, offsets, lower=False)
                n = len(start) - min_words + 1
                if n < 1:
                    continue
                first, after = chunk_words(doc, word, average)
                hits = b.column("hits")
                row = np.repeat(np.arange(b.num_rows), np.array(hits.value_lengths().fill_null(0)))
                byte, first_id, first_tag, first_start = hits.flatten().flatten()
                byte, ids, tags = np.array(byte), b.column("doc_id"), b.column("tag")
                nth = np.searchsorted(start[first], byte + offsets[row])  # the shared ones among all chunks
                alone = np.ones(len(first), bool)
                alone[nth] = False
                low, high, lead = _spans(row, ids.take(pa.array(row)), byte, first_id, np.array(first_tag), np.array(first_start), first[nth], after[nth], min_words)

                def cover(since, to, words_=len(start)):
                    change = np.zeros(words_ + 1, np.int64)
                    np.add.at(change, since, 1)
                    np.add.at(change, np.maximum(since, to), -1)
                    return np.cumsum(change)[: words_ - min_words + 1] > 0

                def places(first, last, row):
                    begin = np.searchsorted(doc, row)
                    numbers = [first - begin, last - begin, start[first] - offsets[row], end[last + min_words - 1] - offsets[row]]
                    return [ids.take(pa.array(row)), tags.take(pa.array(row)), *[pa.array(x.astype(np.int32)) for x in numbers]]

                if len(low):
                    more = [*[pa.nulls(len(low), pa.int64())] * 2, first_id.take(pa.array(lead))]
                    yield pa.record_batch([*places(low, high - min_words, doc[low]), *more], names)
                out = cover(np.maximum(after[alone] - min_words, 0), first[alone] + 1) | cover(low, high - min_words + 1)
                at = np.flatnonzero(~out & (doc[:n] == doc[min_words - 1 :]))
                if len(at):
                    more = [*_digests(data, start[at], end[at + min_words - 1]), pa.nulls(len(at), pa.int64())]
                    own = places(at, at, doc[at])
                    own[3] = pa.nulls(len(at), pa.int32())  # the first window is the last
                    yield pa.record_batch([*own, *more], names)

    mine = F.col("doc_id").eqNullSafe(F.col("hit_id")) & (F.col("tag") == F.col("hit_tag"))
    near = _tagged(docs).join(hits, mine, "left").select("doc_id", "tag", "text", "hits")
    out = materialize(near.mapInArrow(run, "doc_id long, tag int, nth int, last int, start int, end int, h1 long, h2 long, keeper_id long"), "substring-windows")
    discard(hits)
    release(docs.sparkSession)
    return out


def repeated_windows(docs: DataFrame, min_words: int = MIN_WORDS, average: int = AVERAGE) -> DataFrame:
    """doc_id, tag, nth, last, start, end of the spans and windows that repeat an earlier one, with its
    holder: keeper_id."""
    found = windows(docs, min_words, average)
    single = found.where("h1 is not null").drop("keeper_id", "last")
    met = single.join(_shared(single, "substring-shared", "tag", "nth"), DIGEST).withColumn("last", F.col("nth"))
    elsewhere = ~F.col("doc_id").eqNullSafe(F.col("first.doc_id")) | (F.col("tag") != F.col("first.tag"))
    met = met.where(elsewhere | (F.col("nth") >= F.col("first.nth") + min_words))
    columns = ["doc_id", "tag", "nth", "last", "start", "end"]
    return met.select(*columns, F.col("first.doc_id").alias("keeper_id")).unionByName(found.where("h1 is null").select(*columns, "keeper_id"))


def repeated_runs(docs: DataFrame, min_words: int = MIN_WORDS, average: int = AVERAGE) -> DataFrame:
    """doc_id, start, end, n_words, keeper_ids (the distinct holders of the first occurrences)."""
    rows = materialize(repeated_windows(docs, min_words, average), "substring-repeats")
    release(docs.sparkSession)
    by_doc = Window.partitionBy("doc_id", "tag").orderBy("start")
    before = F.max("end").over(by_doc.rowsBetween(Window.unboundedPreceding, -1))
    fresh = F.coalesce(F.col("start") > before, F.lit(True)).cast("int")
    runs = rows.withColumn("_new", fresh).withColumn("_run", F.sum("_new").over(by_doc))
    out = runs.groupBy("doc_id", "tag", "_run").agg(
        F.min("start").cast("long").alias("start"),
        F.max("end").cast("long").alias("end"),
        (F.max("last") - F.min("nth") + min_words).cast("long").alias("n_words"),
        F.array_sort(F.collect_set("keeper_id")).alias("keeper_ids"),
    )
    return out.drop("_run", "tag")
