"""Operator 6, WARC: a deterministic sharded writer, and its reader.

Records are range-partitioned by page_id and sorted. A shard ends where the payload bytes of all pages
up to it, in order of page_id, reach a multiple of SHARD_BYTES: narrow rows (id, size) are sorted by
range, each range adds up its own bytes, and the ranges' totals place them. The cut points depend on
the pages alone, however ids are spread, so the same pages always give the same files; their number
grows with the bytes (2 million for 100 TB, 16 MB that every task reads). A task writes its shard's
records, rolls to a new file by compressed size, regenerates headers and digests, and gives each
file its final name only when it is whole. The manifest, written last, commits the set: readers open
only the files that it lists, so files of lost or repeated tasks do no harm, and their temporary files
are swept after it.

Of records with equal payloads that with the largest page_id is a response, the others are revisits
that refer to it; payloads below `least_bytes` are all responses. Duplicates are found by a map-side
aggregate on the digest; the few rows that name a copied payload's winner are broadcast while their
count allows it, else they meet the copies by a join whose hot digests AQE splits.

Defined cases: null and empty html are an empty payload; a null url leaves the target out; of
repeated rows (equal page_id and payload) the first is the response; a null page_id sorts first, and any
64-bit id is allowed; one page above the size of a shard is a shard of its own; extra columns are left
out; an empty table writes a manifest without files.
"""

from __future__ import annotations

import base64
import gzip
import hashlib
import re
import uuid
import zlib

import numpy as np
import pandas as pd
import pyarrow as pa
from pyarrow import fs
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import join_dimension, materialize, scratch_path

#: Raw bytes a shard should hold; compressed bytes at which a file is rolled.
SHARD_BYTES = 48 << 20
FILE_BYTES = 8 << 20
#: Pages carry no time of their own; a fixed date keeps the files the same.
DATE = "2000-01-01T00:00:00Z"
LEAST_BYTES = 0

_SPACE = uuid.UUID("6ba7b811-9dad-11d1-80b4-00c04fd430c8")  # the URL name space of RFC 4122
_CONTROL = re.compile(r"[\x00-\x20\x7f]")
_MANIFEST = "shard int, file string, records long, bytes long, sha256 string"
_REVISIT = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"


def digest32(data: bytes) -> str:
    return base64.b32encode(hashlib.sha1(data).digest()).decode()


def record(page_id: int | None, url: str | None, payload: bytes, refers_to: int | None, revisit: bool) -> bytes:
    """One record: headers, block, two line ends."""
    head = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {len(payload)}\r\n\r\n".encode()
    block = head if revisit else head + payload
    lines = ["WARC/1.1", f"WARC-Type: {'revisit' if revisit else 'response'}", f"WARC-Record-ID: <urn:uuid:{uuid.uuid5(_SPACE, f'page:{page_id}')}>", f"WARC-Date: {DATE}"]
    if url is not None:
        lines.append("WARC-Target-URI: " + _CONTROL.sub(lambda m: f"%{ord(m[0]):02X}", url))
    lines += [f"WARC-Payload-Digest: sha1:{digest32(payload)}", f"WARC-Block-Digest: sha1:{digest32(block)}"]
    if revisit:
        lines += [f"WARC-Profile: {_REVISIT}", f"WARC-Refers-To: <urn:uuid:{uuid.uuid5(_SPACE, f'page:{refers_to}')}>"]
        if refers_to is not None:
            lines.append(f"Page-Refers-To: {refers_to}")
    if page_id is not None:
        lines.append(f"Page-ID: {page_id}")
    lines += [f"Page-Payload-Length: {len(payload)}", "Content-Type: application/http; msgtype=response", f"Content-Length: {len(block)}"]
    return "\r\n".join(lines).encode() + b"\r\n\r\n" + block + b"\r\n\r\n"


def _info(name: str) -> bytes:
    block = b"format: WARC File Format 1.1\r\n"
    return (
        f"WARC/1.1\r\nWARC-Type: warcinfo\r\nWARC-Record-ID: <urn:uuid:{uuid.uuid5(_SPACE, name)}>\r\nWARC-Date: {DATE}\r\n"
        f"WARC-Filename: {name}\r\nContent-Type: application/warc-fields\r\nContent-Length: {len(block)}\r\n\r\n"
    ).encode() + block + b"\r\n\r\n"


class _Files:
    """The files of one shard, each under a temporary name until it is whole."""

    def __init__(self, folder: str, shard: int, most: int) -> None:
        self.store, self.folder = fs.FileSystem.from_uri(folder)
        self.shard, self.most, self.nth, self.out, self.done = shard, most, 0, None, []

    def add(self, raw: bytes) -> None:
        packer = zlib.compressobj(6, zlib.DEFLATED, 31)
        member = packer.compress(raw) + packer.flush()
        if self.out is not None and self.size + len(member) > self.most:
            self.close()
        if self.out is None:
            self.name = f"shard-{self.shard:06d}-{self.nth:05d}.warc.gz"
            self.temporary = f"{self.folder}/.{self.name}.{uuid.uuid4().hex}"
            self.out, self.size, self.records, self.sum = self.store.open_output_stream(self.temporary), 0, -1, hashlib.sha256()
            self.nth += 1
            self._write(gzip.compress(_info(self.name), mtime=0))
        self._write(member)

    def _write(self, member: bytes) -> None:
        self.out.write(member)
        self.sum.update(member)
        self.size += len(member)
        self.records += 1

    def close(self) -> None:
        if self.out is not None:
            self.out.close()
            self.store.move(self.temporary, f"{self.folder}/{self.name}")
            self.done.append((self.shard, self.name, self.records, self.size, self.sum.hexdigest()))
            self.out = None


def _cuts(sized: DataFrame, shard_bytes: int) -> np.ndarray:
    """The lowest page_id of each shard but the first, sorted: the ids at which the bytes before them
    pass a multiple of shard_bytes."""
    ranged = sized.select("page_id", (F.col("n") + 512).alias("n")).where("page_id is not null").groupBy("page_id").agg(F.sum("n").alias("n"))
    ranged = materialize(ranged.repartitionByRange("page_id").withColumn("part", F.spark_partition_id()), "warc-sizes")
    before = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    parts = ranged.groupBy("part").agg(F.sum("n").alias("n")).withColumn("since", F.coalesce(F.sum("n").over(before), F.lit(0)))  # a row a partition
    inside = Window.partitionBy("part").orderBy("page_id").rowsBetween(Window.unboundedPreceding, -1)
    placed = ranged.withColumn("inside", F.coalesce(F.sum("n").over(inside), F.lit(0))).join(F.broadcast(parts.select("part", "since")), "part")
    shard = F.floor((F.col("since") + F.col("inside")) / shard_bytes).alias("shard")
    firsts = placed.groupBy(shard).agg(F.min("page_id").alias("page_id")).where("shard > 0")
    return np.sort(np.array([r["page_id"] for r in firsts.select("page_id").collect()], np.int64))  # total bytes / shard_bytes


def _sweep(folder: str) -> None:
    """Remove the temporary files that lost tasks left behind."""
    store, path = fs.FileSystem.from_uri(folder)
    for f in store.get_file_info(fs.FileSelector(path)):
        if f.is_file and f.base_name.startswith(".shard-"):
            store.delete_file(f.path)


def write_warc(pages: DataFrame, folder: str, shard_bytes: int = SHARD_BYTES, file_bytes: int = FILE_BYTES, least_bytes: int = LEAST_BYTES) -> DataFrame:
    """Write the records of pages(page_id, url, html) below folder; the manifest."""
    spark = pages.sparkSession
    body = F.coalesce("html", F.lit(""))
    sized = pages.select("page_id", F.sha1(body.cast("binary")).alias("sha"), F.octet_length(body).cast("long").alias("n"))
    sized = materialize(sized, "warc-sized")
    same = sized.where(F.col("n") >= least_bytes).groupBy("sha").agg(F.max("page_id").alias("winner"), F.count(F.lit(1)).alias("copies"))
    same = materialize(same.where("copies > 1").drop("copies"), "warc-same")
    notes = join_dimension(sized.where(F.col("n") >= least_bytes), same, ["sha"], "inner").where("not (page_id <=> winner)")
    cuts = _cuts(sized, shard_bytes)
    shared = spark.sparkContext.broadcast(cuts)

    @F.pandas_udf("int")
    def shard_of(page_id: pd.Series) -> pd.Series:
        return pd.Series(np.searchsorted(shared.value, page_id.to_numpy(np.int64), "right").astype(np.int32))

    shape = [F.col("page_id"), F.col("url"), body.alias("html"), F.lit(None).cast("string").alias("sha"), F.lit(None).cast("long").alias("winner"), F.lit(1).alias("kind")]
    told = [F.col("page_id"), F.lit(None).cast("string").alias("url"), F.lit("").alias("html"), F.col("sha"), F.col("winner"), F.lit(0).alias("kind")]
    rows = pages.select(*shape).unionByName(notes.select(*told).distinct())
    rows = rows.withColumn("shard", shard_of(F.coalesce("page_id", F.lit(-(1 << 63)))))
    rows = rows.repartitionById(len(cuts) + 1, "shard").sortWithinPartitions("page_id", "kind", "html", "url")
    store, path = fs.FileSystem.from_uri(folder)
    store.create_dir(path, recursive=True)

    def run(batches):
        files, known, at, last = None, {}, object(), None
        for b in batches:
            for page_id, url, text, sha, winner, kind, shard in zip(*[c.to_pylist() for c in b.columns], strict=True):
                if files is None:
                    files = _Files(folder, shard, file_bytes)
                if page_id != at:
                    known, at, last = {}, page_id, set()
                if not kind:
                    known[sha] = winner
                    continue
                payload = text.encode()
                own = hashlib.sha1(payload).hexdigest()
                again = own in last and len(payload) >= least_bytes
                last.add(own)
                if own in known:
                    files.add(record(page_id, url, payload, known[own], True))
                else:
                    files.add(record(page_id, url, payload, page_id if again else None, again))
        if files is not None:
            files.close()
            names = ["shard", "file", "records", "bytes", "sha256"]
            kinds = [pa.int32(), pa.string(), pa.int64(), pa.int64(), pa.string()]
            yield pa.record_batch([pa.array(c, t) for c, t in zip(zip(*files.done, strict=True), kinds, strict=True)], names)

    rows.mapInArrow(run, _MANIFEST).write.mode("overwrite").parquet(f"{folder}/manifest")
    _sweep(folder)
    return spark.read.schema(_MANIFEST).parquet(f"{folder}/manifest")


def _records(stream):
    """(headers, block) of each record of an open archive."""
    with gzip.GzipFile(fileobj=stream) as f:
        while line := f.readline():
            if not line.strip():
                continue
            if not line.startswith(b"WARC/1."):
                raise ValueError(f"not a record: {line[:40]!r}")
            headers = {}
            while (line := f.readline().rstrip(b"\r\n")):
                name, _, value = line.decode().partition(": ")
                headers[name.lower()] = value
            yield headers, f.read(int(headers["content-length"]))


def read_warc(spark: SparkSession, folder: str) -> DataFrame:
    """page_id, url, payload_bytes, payload_digest, record_type, refers_to of each record of the
    committed files. A response's digest is computed from its payload and must equal its header's."""
    manifest = spark.read.schema(_MANIFEST).parquet(f"{folder}/manifest").select("file", "records")
    files = max(1, min(manifest.count(), 100_000))

    def run(batches):
        store, path = fs.FileSystem.from_uri(folder)
        for b in batches:
            for name, records in zip(*[c.to_pylist() for c in b.columns], strict=True):
                out = []
                with store.open_input_stream(f"{path}/{name}", compression=None) as stream:
                    for h, block in _records(stream):
                        kind = h["warc-type"]
                        if kind == "warcinfo":
                            continue
                        digest, length = h["warc-payload-digest"].removeprefix("sha1:"), int(h["page-payload-length"])
                        if kind == "response":
                            payload = block[block.index(b"\r\n\r\n") + 4 :]
                            if digest32(payload) != digest or len(payload) != length:
                                raise ValueError(f"{name}: payload of page {h.get('page-id')} is damaged")
                        ref = h.get("page-refers-to")
                        page = h.get("page-id")
                        out.append((page and int(page), h.get("warc-target-uri"), length, digest, kind, ref and int(ref)))
                if len(out) != records:
                    raise ValueError(f"{name}: {len(out)} records, the manifest has {records}")
                kinds = [pa.int64(), pa.string(), pa.int64(), pa.string(), pa.string(), pa.int64()]
                names = ["page_id", "url", "payload_bytes", "payload_digest", "record_type", "refers_to"]
                yield pa.record_batch([pa.array(c, t) for c, t in zip(zip(*out, strict=True), kinds, strict=True)], names)

    shape = "page_id long, url string, payload_bytes long, payload_digest string, record_type string, refers_to long"
    return manifest.repartition(files).mapInArrow(run, shape)


def round_trip(pages: DataFrame, folder: str | None = None) -> DataFrame:
    """Write the pages, then read the archives back."""
    folder = folder or scratch_path(pages.sparkSession, "warc")
    write_warc(pages, folder)
    return read_warc(pages.sparkSession, folder)
