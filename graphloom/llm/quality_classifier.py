"""Operator 4, quality classifier: a byte-level convolutional network in numpy.

FILTERS filters of WIDTH bytes slide over the UTF-8 bytes of the whole document in steps of STRIDE.
A filter is a table of weights for each place and byte value. Responses are max-pooled over chunks
of two half-chunks, so neighbouring chunks overlap by half; the chunks' features are combined by
their mean and their maximum, and a logistic layer gives one probability.

Training uses labelled rows with crc32(doc_id as text) mod 4 != 2 only, a sample bounded by
MAX_TRAIN_DOCS and MAX_TRAIN_BYTES in the order of a hash of doc_id; each sampled document is used
whole. Labels, lang, source and doc_id are no inputs. Scoring covers every byte of every document.

Defined cases: null and empty texts are scored as a text of padding; repeated rows each get a row;
without labelled rows, or with one class only, the score is the smoothed share of label 1; an empty
table gives no rows.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import byte_slices, text_buffers

FILTERS, WIDTH, STRIDE, HALF = 16, 8, 2, 256
MAX_TRAIN_DOCS, MAX_TRAIN_BYTES = 2400, 12 << 20
EPOCHS, BATCH, RATE, DECAY, SEED = 10, 48, 0.02, 1e-4, 7
THRESHOLD = 0.7


@dataclass
class Network:
    """table[j, byte] holds the FILTERS weights of place j; w and b weigh mean and maximum."""

    table: np.ndarray
    bias: np.ndarray
    w: np.ndarray
    b: float

    @classmethod
    def fresh(cls, rng: np.random.Generator) -> Network:
        table = rng.normal(0, 0.25, (WIDTH, 256, FILTERS)).astype(np.float32)
        return cls(table, np.zeros(FILTERS, np.float32), rng.normal(0, 0.1, 2 * FILTERS).astype(np.float32), 0.0)


def padded(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The texts with zero bytes after each, up to whole half-chunks (WIDTH zeros at least), and
    the first half-chunk of each text."""
    size = np.diff(offsets)
    halves = (size + WIDTH + HALF - 1) // HALF
    first = np.concatenate([[0], np.cumsum(halves)])
    out = np.zeros(first[-1] * HALF + WIDTH, np.uint8)
    at = np.arange(len(data)) + np.repeat(first[:-1] * HALF - offsets[:-1], size)
    out[at] = data
    return out, first


def _responses(net: Network, text: np.ndarray) -> np.ndarray:
    """Responses of the filters at each place, (places, FILTERS)."""
    n = (len(text) - WIDTH) // STRIDE
    out = np.take(net.table[0], text[: n * STRIDE : STRIDE], axis=0)
    for j in range(1, WIDTH):
        out += np.take(net.table[j], text[j : j + n * STRIDE : STRIDE], axis=0)
    return out


def _chunk_index(first: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(left half, right half) of each chunk, and each document's first chunk."""
    halves = np.diff(first)
    count = np.maximum(halves - 1, 1)
    start = np.concatenate([[0], np.cumsum(count)])
    left = np.arange(start[-1]) + np.repeat(first[:-1] - start[:-1], count)
    last = np.repeat(first[1:] - 1, count)
    return left, np.minimum(left + 1, last), start


def _pooled(net: Network, half: np.ndarray, first: np.ndarray):
    left, right, start = _chunk_index(first)
    feature = np.maximum(np.maximum(half[left], half[right]) + net.bias, 0)
    count = np.diff(start)[:, None]
    mean = np.add.reduceat(feature, start[:-1]) / count
    most = np.maximum.reduceat(feature, start[:-1])
    return left, right, start, feature, mean, most


def score(net: Network, data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """The probability of label 1 of each text."""
    text, first = padded(data, offsets)
    half = _responses(net, text).reshape(-1, HALF // STRIDE, FILTERS).max(axis=1)
    *_, mean, most = _pooled(net, half, first)
    z = np.concatenate([mean, most], axis=1).astype(np.float64) @ net.w + net.b
    return 1 / (1 + np.exp(-np.clip(z, -30, 30)))


def _gradients(net: Network, text: np.ndarray, first: np.ndarray, label: np.ndarray):
    r = _responses(net, text).reshape(-1, HALF // STRIDE, FILTERS)
    best = r.argmax(axis=1)
    half = np.take_along_axis(r, best[:, None], axis=1)[:, 0]
    left, right, start, feature, mean, most = _pooled(net, half, first)
    x = np.concatenate([mean, most], axis=1)
    p = 1 / (1 + np.exp(-np.clip(x @ net.w + net.b, -30, 30)))
    dz = ((p - label) / len(label)).astype(np.float32)
    dw, db = x.T @ dz, dz.sum()
    count = np.diff(start)
    owner = np.repeat(np.arange(len(count)), count)
    dmean = dz[:, None] * net.w[:FILTERS] / count[:, None]
    dmost = dz[:, None] * net.w[FILTERS:]
    is_most = feature == most[owner]
    share = np.add.reduceat(is_most.astype(np.float32), start[:-1])
    df = dmean[owner] + is_most * (dmost / share)[owner]
    df = np.where(feature > 0, df, 0).astype(np.float32)
    dhalf = np.zeros_like(half)
    to_left = half[left] >= half[right]
    np.add.at(dhalf, left, np.where(to_left, df, 0))
    np.add.at(dhalf, right, np.where(to_left, 0, df))
    h, k = np.nonzero(dhalf)
    place = (h * (HALF // STRIDE) + best[h, k]) * STRIDE
    g = dhalf[h, k]
    dtable = np.zeros_like(net.table)
    for j in range(WIDTH):
        flat = text[place + j].astype(np.int64) * FILTERS + k
        dtable[j] = np.bincount(flat, g, 256 * FILTERS).reshape(256, FILTERS)
    return dtable, df.sum(axis=0), dw, db


def fit(texts: list[bytes], labels: np.ndarray, epochs: int = EPOCHS) -> Network:
    """Adam on the mean cross-entropy; the same texts in the same order give the same network."""
    rng = np.random.default_rng(SEED)
    net = Network.fresh(rng)
    labels = labels.astype(np.float32)
    if len(set(labels.tolist())) < 2:
        share = (labels.sum() + 1) / (len(labels) + 2)
        net.w[:] = 0
        net.b = float(np.log(share / (1 - share)))
        return net
    state = [[np.zeros_like(x), np.zeros_like(x)] for x in (net.table, net.bias, net.w, np.zeros(1, np.float32))]
    step, rounds = 0, epochs * -(-len(texts) // BATCH)
    for _ in range(epochs):
        order = rng.permutation(len(texts))
        for at in range(0, len(order), BATCH):
            own = order[at : at + BATCH]
            data = np.frombuffer(b"".join(texts[i] for i in own), np.uint8)
            offsets = np.concatenate([[0], np.cumsum([len(texts[i]) for i in own])])
            grads = _gradients(net, *padded(data, offsets), labels[own])
            step += 1
            rate = RATE * (1 - step / (rounds + 1))
            b = np.array([net.b], np.float32)
            for x, g, s in zip((net.table, net.bias, net.w, b), grads, state, strict=True):
                g = np.asarray(g, np.float32) + DECAY * x
                s[0] += 0.1 * (g - s[0])
                s[1] += 0.01 * (g * g - s[1])
                x -= rate * (s[0] / (1 - 0.9**step)) / (np.sqrt(s[1] / (1 - 0.99**step)) + 1e-8)
            net.b = float(b[0])
    return net


def held_out(doc_id: Column) -> Column:
    return F.crc32(doc_id.cast("string").cast("binary")) % 4 == 2


def train(docs: DataFrame, labels: DataFrame, max_docs: int = MAX_TRAIN_DOCS, max_bytes: int = MAX_TRAIN_BYTES) -> Network:
    """The network fitted to at most max_docs labelled documents of at most max_bytes bytes in all.

    Only ids and lengths are read first; texts that would exceed the bound never reach the driver. Of
    rows that share a doc_id the longest text stands for it.
    """
    known = labels.where(F.col("quality").isin(0, 1) & ~held_out(F.col("doc_id")))
    known = known.groupBy("doc_id").agg(F.min("quality").alias("quality"))
    some = known.orderBy(F.xxhash64("doc_id"), "doc_id").limit(max_docs)
    body = F.coalesce("text", F.lit(""))
    sizes = docs.select("doc_id", F.octet_length(body).alias("n")).join(F.broadcast(some), "doc_id")
    sizes = sizes.groupBy("doc_id").agg(F.max("n").alias("n"), F.first("quality").alias("quality"))
    chosen, total = {}, 0
    for r in sizes.orderBy(F.xxhash64("doc_id"), "doc_id").collect():  # max_docs narrow rows at most
        if total + r["n"] <= max_bytes:
            chosen[r["doc_id"]] = (r["n"], r["quality"])
            total += r["n"]
    wanted = docs.sparkSession.createDataFrame([(k, n) for k, (n, _) in chosen.items()], "doc_id long, n int")
    rows = docs.select("doc_id", body.alias("text")).join(F.broadcast(wanted), "doc_id").where(F.octet_length("text") == F.col("n"))
    rows = rows.groupBy("doc_id").agg(F.min("text").alias("text")).orderBy(F.xxhash64("doc_id"), "doc_id")
    texts, marks = [], []
    for r in rows.toLocalIterator():  # max_bytes at most
        texts.append(r["text"].encode())
        marks.append(chosen[r["doc_id"]][1])
    return fit(texts, np.array(marks))


def classify(docs: DataFrame, net: Network, threshold: float = THRESHOLD) -> DataFrame:
    """doc_id, held_out, score, predicted of each document."""

    def run(batches):
        for whole in batches:
            for b in byte_slices(whole, "text", 1 << 18):
                value = score(net, *text_buffers(b.column("text")))
                yield pa.record_batch([b.column("doc_id"), pa.array(value), pa.array((value >= threshold).astype(np.int32))], ["doc_id", "score", "predicted"])

    scored = docs.select("doc_id", "text").mapInArrow(run, "doc_id long, score double, predicted int")
    return scored.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "score", "predicted")


def quality_scores(docs: DataFrame, labels: DataFrame) -> DataFrame:
    return classify(docs, train(docs, labels))
