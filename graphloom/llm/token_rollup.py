"""Operator 1, token counts: delta-maintained rollups by source, language and tokenizer version.

Every change is a signed delta: an insert adds a document's count, a delete takes it away, a revised
count does both. Totals are additive, so a batch is reduced to one row for each (source, lang,
tokenizer_version) map-side before anything is shuffled, and totals are sums over batches.

A batch is written to a folder of its own attempt and counts only once a marker with its batch_id
exists. The marker is written whole under a temporary name and renamed without overwriting, so a
writer that dies leaves no marker, a retry counts, and a repeated or concurrent commit of a batch_id
finds the marker and changes nothing. A commit looks at one path, whatever the number of batches.
`compact` sums committed batches into a base that names them, by the same rule; totals read the newest
base and the batches since.

Defined cases: null text has 0 tokens and still counts as a document; null source and null lang are
groups of their own; repeated rows count as often as they come; extra columns are left out; an empty
batch commits and adds no rows; groups whose documents and tokens are all taken away disappear; a very
long text is counted whole, in one call of the encoder.
"""

from __future__ import annotations

import json
import uuid

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import byte_slices, materialize, scratch_path, text_buffers
from .tokens import default_vocabulary, encoder
from .wordhash import words

KEYS = ["source", "lang", "tokenizer_version"]
#: Bytes of text that a draft count takes for a token.
BYTES_A_TOKEN = 4
_TOTALS = "source string, lang string, tokenizer_version string, n_docs long, n_tokens long"


def versions() -> dict[str, str | None]:
    """Tokenizer versions and their vocabulary files; None is the word rule."""
    return {"byte_bpe_50k@1": default_vocabulary(), "words@1": None}


def count_tokens(docs: DataFrame, tokenizers: dict[str, str | None] | None = None) -> DataFrame:
    """doc_id, source, lang, tokenizer_version, n_tokens and n_bytes of each document and version."""
    tokenizers = tokenizers or versions()

    def run(batches):
        for whole in batches:
            for b in byte_slices(whole, "text"):
                size = pa.array(np.diff(text_buffers(b.column("text"))[1]))
                for name, path in tokenizers.items():
                    if path is None:
                        _, _, doc, _ = words(*text_buffers(b.column("text")))
                        n = np.bincount(doc, minlength=b.num_rows)
                    else:
                        n = np.array([len(x) for x in encoder(path)([t or "" for t in b.column("text").to_pylist()])])
                    own = [b.column(c) for c in ("doc_id", "source", "lang")]
                    yield pa.record_batch([*own, pa.array([name] * b.num_rows), pa.array(n, pa.int64()), size], ["doc_id", *KEYS, "n_tokens", "n_bytes"])

    return docs.select("doc_id", "source", "lang", "text").mapInArrow(run, "doc_id long, source string, lang string, tokenizer_version string, n_tokens long, n_bytes long")


def inserts(counts: DataFrame) -> DataFrame:
    return counts.select(*KEYS, F.lit(1).cast("long").alias("n_docs"), F.col("n_tokens").cast("long"))


def deletes(counts: DataFrame) -> DataFrame:
    return counts.select(*KEYS, F.lit(-1).cast("long").alias("n_docs"), (-F.col("n_tokens").cast("long")).alias("n_tokens"))


def revisions(old: DataFrame, new: DataFrame) -> DataFrame:
    """Deltas that turn the old counts of some documents into the new ones."""
    return deletes(old).unionByName(inserts(new))


def _drafts(counts: DataFrame) -> DataFrame:
    return counts.withColumn("n_tokens", F.ceil(F.col("n_bytes") / BYTES_A_TOKEN).cast("long"))


class TokenRollup:
    """Rollup totals kept in a folder of a store that Spark reads."""

    def __init__(self, spark: SparkSession, root: str) -> None:
        self.spark, self.root = spark, root.rstrip("/")
        self._path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path
        self._fs = self._path(self.root).getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())

    def _mark(self, kind: str, name: str, what: dict) -> bool:
        """Put up a marker whole, by a rename that never overwrites; False where it is there already."""
        jvm, conf = self.spark.sparkContext._jvm, self.spark.sparkContext._jsc.hadoopConfiguration()
        final = self._path(f"{self.root}/{kind}/{name}")
        temporary = self._path(f"{self.root}/tmp/{kind}-{uuid.uuid4().hex}")
        self._fs.mkdirs(final.getParent())
        out = self._fs.create(temporary, False)
        out.write(bytearray(json.dumps(what).encode()))
        out.close()
        options = self.spark.sparkContext._gateway.new_array(jvm.org.apache.hadoop.fs.Options.Rename, 0)
        try:
            jvm.org.apache.hadoop.fs.FileContext.getFileContext(self._fs.getUri(), conf).rename(temporary, final, options)
        except Exception as e:
            self._fs.delete(temporary, False)
            if self._fs.exists(final):
                return False
            raise e
        return True

    def _names(self, kind: str) -> list[str]:
        folder = self._path(f"{self.root}/{kind}")
        return sorted(x.getPath().getName() for x in self._fs.listStatus(folder)) if self._fs.exists(folder) else []

    def _read(self, kind: str, name: str) -> dict:
        stream = self._fs.open(self._path(f"{self.root}/{kind}/{name}"))
        text = bytes(stream.readAllBytes()).decode()
        stream.close()
        return json.loads(text)

    def commit(self, batch_id: str, deltas: DataFrame) -> bool:
        """Add a batch of deltas once; False where batch_id was committed before."""
        if self._fs.exists(self._path(f"{self.root}/batches/{batch_id}")):
            return False
        data = f"{self.root}/data/{batch_id}-{uuid.uuid4().hex}"
        self._sums(deltas).write.parquet(data)
        return self._mark("batches", batch_id, {"data": data})

    def _sums(self, rows: DataFrame) -> DataFrame:
        return rows.groupBy(*KEYS).agg(F.sum("n_docs").alias("n_docs"), F.sum("n_tokens").alias("n_tokens"))

    def _parts(self) -> tuple[list[str], list[str], int]:
        """Folders that make up the totals, the batches they cover, and the number of bases."""
        bases = self._names("bases")
        newest = self._read("bases", bases[-1]) if bases else {"data": None, "batches": []}
        covered = set(newest["batches"])
        fresh = [x for x in self._names("batches") if x not in covered]
        data = [self._read("batches", x)["data"] for x in fresh]
        return [*([newest["data"]] if newest["data"] else []), *data], sorted({*covered, *fresh}), len(bases)

    def totals(self) -> DataFrame:
        """source, lang, tokenizer_version, n_docs, n_tokens."""
        folders, _, _ = self._parts()
        if not folders:
            return self.spark.createDataFrame([], _TOTALS)
        rows = self._sums(self.spark.read.schema(_TOTALS).parquet(*folders))
        return rows.where("n_docs <> 0 or n_tokens <> 0")

    def compact(self) -> None:
        """Sum all committed batches into a new base."""
        folders, covered, bases = self._parts()
        if len(folders) > 1:
            data = f"{self.root}/data/base-{uuid.uuid4().hex}"
            self._sums(self.spark.read.schema(_TOTALS).parquet(*folders)).write.parquet(data)
            self._mark("bases", f"{bases:08d}", {"data": data, "batches": covered})


def rollup_documents(docs: DataFrame, root: str | None = None, tokenizers: dict[str, str | None] | None = None, short: int = 10) -> DataFrame:
    """Totals of a corpus through all kinds of deltas.

    The load inserts every document with a draft count, BYTES_A_TOKEN bytes a token, as a loader knows it
    before a tokenizer has run. Documents of fewer than `short` tokens are then withdrawn (deletes of
    the drafts) and come back with exact counts (inserts); all others are revised from draft to exact. The
    first two batches are compacted, and all commits are repeated, which changes nothing. So the totals are
    those of the exact counts of all documents, and any delta lost or applied twice would show in them.
    """
    rollup = TokenRollup(docs.sparkSession, root or scratch_path(docs.sparkSession, "token-rollup"))
    counts = materialize(count_tokens(docs, tokenizers), "token-counts")
    few = "n_tokens < {}".format(int(short))
    batches = {
        "load": inserts(_drafts(counts)),
        "withdraw": deletes(_drafts(counts.where(few))),
        "return": inserts(counts.where(few)),
        "revise": revisions(_drafts(counts.where(f"not {few}")), counts.where(f"not {few}")),
    }
    for name, deltas in batches.items():
        rollup.commit(name, deltas)
        if name == "withdraw":
            rollup.compact()
    for name, deltas in batches.items():
        rollup.commit(name, deltas)
    return rollup.totals()
