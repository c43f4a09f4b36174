"""Operator 9, best-fit packing: documents become sequences of at most `room` tokens.

Bulk-synchronous best-fit. Pieces longer than half the room open a sequence each, as they must in any
packing; what is left of the room is a gap. Then rounds follow until every piece has a place:

1. Range-sort: unplaced pieces and gaps are dealt by size into ranges and sorted; ties go by a hash of
   their numbers, so a length that a third of all pieces have is spread over ranges like any other.
2. Successor sweep: each range is swept upwards; a gap takes the largest piece below it that no smaller
   gap has taken. The sweep is a matching of parentheses, so ranges match inside first, and what they
   leave over, pieces at the top and gaps at the bottom, is matched across ranges by rank: of each range
   only two counts reach the driver, and the left-over rows meet by the ranks that follow from them.
3. Conflicts: a gap takes one piece a round, of those that fit the one of highest rank; the others go on.
4. Update: a filled gap is smaller by its piece. A gap that found no piece is too small for all that
   are left and goes.

When no piece fits a gap any more, as many of the largest pieces as the rest fills sequences open new
ones. Only rows that are still in play move; their number shrinks every round.

Only documents longer than `room` are cut; their first piece is the shorter one.

Defined cases: a null or empty text is one piece that holds only the end token; repeated rows are
packed as often as they come; a null doc_id is kept; extra columns are left out; a very long text is cut
into as many pieces as it needs; an empty table gives no rows.
"""

from __future__ import annotations

import zlib

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import byte_slices, discard, materialize, settle
from .tokens import default_vocabulary, encoder

END_TOKEN = 2
ROOM = 1024
#: Rows in play that one range of a sweep should hold.
RANGE_ROWS = 20_000

_PIECES = "doc_id long, piece int, start long, length long, ids_crc32 long, rid long"
_STATE = "kind int, id long, size long, mate long, gap long, part int, idx long"
#: Kinds of rows: an unplaced piece, a gap, a match of the two.
PIECE, GAP, MATCH = 0, 1, 2


def cut(n: int, room: int = ROOM) -> list[tuple[int, int]]:
    """(start, length) of the pieces of a document of n tokens."""
    head = n % room or room
    return [(0, min(head, n))] + [(s, room) for s in range(head, n, room)]


def pieces(docs: DataFrame, vocabulary: str | None = None, room: int = ROOM) -> DataFrame:
    """The pieces of each document, each with a number of its own."""
    path = vocabulary or default_vocabulary()

    def run(batches):
        encode, part = encoder(path), TaskContext.get().partitionId()
        rid = part << 40
        for whole in batches:
            for batch in byte_slices(whole, "text"):
                out: list[tuple] = []
                texts = batch.column("text").to_pylist()
                for doc, ids in zip(batch.column("doc_id").to_pylist(), encode([x or "" for x in texts]), strict=True):
                    ids = np.append(ids, np.uint32(END_TOKEN)).astype("<u4")
                    for k, (s, n) in enumerate(cut(len(ids), room)):
                        out.append((doc, k, s, n, zlib.crc32(ids[s : s + n].tobytes()), rid))
                        rid += 1
                columns = list(zip(*out, strict=True))
                kinds = [pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int64(), pa.int64()]
                names = ["doc_id", "piece", "start", "length", "ids_crc32", "rid"]
                yield pa.record_batch([pa.array(c, t) for c, t in zip(columns, kinds, strict=True)], names)

    return docs.select("doc_id", "text").mapInArrow(run, _PIECES)


def sweep(kind: np.ndarray, size: np.ndarray) -> tuple[list[tuple[int, int]], list[int], list[int]]:
    """One range, sorted by size with pieces before gaps: (piece, gap) places that match, and the places of
    pieces and of gaps that are left over, both upwards."""
    met, stack, gaps = [], [], []
    for at, k in enumerate(kind.tolist()):
        if k == PIECE:
            stack.append(at)
        elif stack:
            met.append((stack.pop(), at))
        else:
            gaps.append(at)
    return met, stack, gaps


def _swept(state: DataFrame, rows: int) -> DataFrame:
    """state(kind, id, size) matched inside its ranges: matches, and what is left over with its rank there."""
    ranges = max(1, -(-rows // RANGE_ROWS))
    dealt = state.withColumn("tie", F.xxhash64("id")).repartitionByRange(ranges, "size", "kind", "tie").sortWithinPartitions("size", "kind", "tie")

    def run(batches):
        table = pa.Table.from_batches(list(batches))  # one range
        if not table.num_rows:
            return
        kind, ids, size = (table.column(c).to_numpy() for c in ("kind", "id", "size"))
        met, pieces, gaps = sweep(kind, size)
        p, g = np.array([x for x, _ in met], np.int64), np.array([y for _, y in met], np.int64)
        left = np.array(pieces + gaps, np.int64)
        n, part = len(met), TaskContext.get().partitionId()
        none = pa.nulls(len(left), pa.int64())
        rank = np.concatenate([np.arange(len(pieces)), np.arange(len(gaps))]).astype(np.int64)
        columns = [
            pa.array(np.concatenate([np.full(n, MATCH), kind[left]]).astype(np.int32)), pa.array(np.concatenate([ids[p], ids[left]])), pa.array(np.concatenate([size[p], size[left]])),
            pa.chunked_array([pa.array(ids[g], pa.int64()), none]).combine_chunks(), pa.chunked_array([pa.array(size[g], pa.int64()), none]).combine_chunks(),
            pa.array(np.full(n + len(left), part, np.int32)), pa.array(np.concatenate([np.zeros(n, np.int64), rank])),
        ]
        yield pa.record_batch(columns, ["kind", "id", "size", "mate", "gap", "part", "idx"])

    return materialize(dealt.drop("tie").mapInArrow(run, _STATE), "packing-swept")


def across(counts: dict[tuple[int, int], int]) -> tuple[list[tuple], list[tuple[int, int, int]]]:
    """counts[(range, kind)] of left-over rows: segments (key, pieces' range, one past its highest rank, gaps'
    range, lowest rank, number) that match, and segments (range, lowest, one past highest) of pieces left."""
    stack: list[tuple[int, int, int]] = []
    out, key = [], 0
    for part in sorted({p for p, _ in counts}):
        at, gaps = 0, counts.get((part, GAP), 0)
        while at < gaps and stack:
            below, low, high = stack.pop()
            n = min(gaps - at, high - low)
            out.append((key, below, high, part, at, n))
            key, at = key + n, at + n
            if high - n > low:
                stack.append((below, low, high - n))
        if counts.get((part, PIECE), 0):
            stack.append((part, 0, counts[part, PIECE]))
    return out, stack


def _top(stack: list[tuple[int, int, int]], n: int) -> tuple[list[tuple[int, int, int]], list[tuple[int, int, int]]]:
    """The n highest pieces of the stack, and the rest."""
    rest, taken = list(stack), []
    while n and rest:
        part, low, high = rest.pop()
        k = min(n, high - low)
        taken.append((part, high - k, high))
        if high - k > low:
            rest.append((part, low, high - k))
        n -= k
    return taken, rest


def _within(rows: DataFrame, segments: list[tuple[int, int, int]]) -> DataFrame:
    """Left-over rows in segments (range, lowest, one past highest); a segment or two for each range."""
    table = F.broadcast(rows.sparkSession.createDataFrame(segments, "part int, low long, high long"))
    return rows.join(table, "part").where("idx >= low and idx < high").drop("low", "high")


def place(items: DataFrame, room: int = ROOM, most: int = 100_000) -> DataFrame:
    """items(rid, length), stored: (rid, sequence_id, offset) of each."""
    spark = items.sparkSession
    alone = items.where(2 * F.col("length") > room).select("rid", F.col("rid").alias("sequence_id"), F.lit(0).cast("long").alias("offset"))
    first = F.when(2 * F.col("length") > room, GAP).otherwise(PIECE)
    size = F.when(2 * F.col("length") > room, room - F.col("length")).otherwise(F.col("length"))
    state = items.select(first.alias("kind"), F.col("rid").alias("id"), size.alias("size")).where("size > 0")
    rows, placed, before = state.count(), [alone], None
    for _ in range(most):
        if not rows:
            break
        swept = _swept(state, rows)
        if before is not None:
            discard(before)  # the next state is written
        before = swept
        counts, hits, rest = {}, 0, 0
        for r in swept.groupBy("part", "kind").agg(F.count(F.lit(1)).alias("n"), F.sum("size").alias("tokens")).collect():  # three rows a range
            if r["kind"] == MATCH:
                hits += r["n"]
            else:
                counts[r["part"], r["kind"]] = r["n"]
                rest += r["tokens"] if r["kind"] == PIECE else 0
        segments, stack = across(counts)
        hits += sum(x[-1] for x in segments)
        left = swept.where(F.col("kind") == PIECE)
        met = swept.where(F.col("kind") == MATCH).select("id", "size", "mate", "gap")
        if segments:
            a = spark.createDataFrame([(p, high - n, high, key) for key, p, high, _, _, n in segments], "part int, low long, high long, key long")
            b = spark.createDataFrame([(g, low, low + n, key) for key, _, _, g, low, n in segments], "part int, low long, high long, key long")
            x = left.join(F.broadcast(a), "part").where("idx >= low and idx < high").select((F.col("key") + F.col("high") - 1 - F.col("idx")).alias("key"), "id", "size")
            y = swept.where(F.col("kind") == GAP).join(F.broadcast(b), "part").where("idx >= low and idx < high").select((F.col("key") + F.col("idx") - F.col("low")).alias("key"), F.col("id").alias("mate"), F.col("size").alias("gap"))
            met = met.unionByName(x.join(y, "key").drop("key"))
        if hits:
            met = materialize(met.coalesce(-(-hits // RANGE_ROWS)), "packing-met")
            placed.append(met.select(F.col("id").alias("rid"), F.col("mate").alias("sequence_id"), (room - F.col("gap")).alias("offset")))
            fresh, opened = met.select(F.lit(GAP).alias("kind"), F.col("mate").alias("id"), (F.col("gap") - F.col("size")).alias("size")).where("size > 0"), []
        else:
            opened, stack = _top(stack, -(-rest // room))
            new = materialize(_within(left, opened), "packing-opened")
            placed.append(new.select(F.col("id").alias("rid"), F.col("id").alias("sequence_id"), F.lit(0).cast("long").alias("offset")))
            fresh = new.select(F.lit(GAP).alias("kind"), "id", (room - F.col("size")).alias("size")).where("size > 0")
        unplaced = sum(high - low for _, low, high in stack)
        if not unplaced:
            break
        state = _within(left, stack).select(F.lit(PIECE).alias("kind"), "id", "size").unionByName(fresh)
        rows = unplaced + hits + sum(high - low for _, low, high in opened)
    else:
        raise RuntimeError(f"unplaced pieces after {most} rounds")
    out = placed[0]
    for x in placed[1:]:
        out = out.unionByName(x)
    return out


def pack(docs: DataFrame, vocabulary: str | None = None, room: int = ROOM) -> DataFrame:
    """doc_id, piece, start, length, ids_crc32, sequence_id, offset of each piece."""
    cut_up = materialize(pieces(docs, vocabulary, room), "packing-pieces")
    found = settle(lambda: place(cut_up.select("rid", "length"), room), "packing-places")
    return cut_up.join(found, "rid").select("doc_id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset")
