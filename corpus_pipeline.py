"""The corpus pipeline: raw documents to packed training sequences in five stages.

Each stage takes (spark, docs, sf_dir) and returns a table that is written as Parquet and read again
as the next stage's documents. All but the last return the columns of documents, extra ones of any
name unchanged. An empty table passes through all stages as an empty table.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality rules keep. Null and empty texts go; a null source is a host of its own;
    repeated rows stay or go together."""
    from graphloom.llm.quality_rules import keep_quality

    return keep_quality(docs)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near duplicates, that with the smallest doc_id (a null one last); of
    repeated rows one stays. Documents without words all stay."""
    from graphloom.llm.jaccard_join import keep_one_of_each

    return keep_one_of_each(docs)


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that contain no item of the benchmark. A row goes by its own text, whatever rows share its
    doc_id; null and empty texts stay, and null or empty items remove nothing."""
    from graphloom.llm.decontaminate import drop_contaminated

    return drop_contaminated(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def personal_data(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents with each span of personal data replaced by its kind, n_chars following the new text. No row
    goes; null texts stay null."""
    from graphloom.llm.pii import redact

    return redact(docs)


def packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The pieces of all documents with their places in sequences. A null or empty text is one piece with the
    end token; repeated rows are packed as often as they come."""
    from graphloom.llm.packing import pack

    return pack(docs)


STAGES = [
    ("quality_rules", quality_rules),
    ("near_duplicates", near_duplicates),
    ("decontamination", decontamination),
    ("personal_data", personal_data),
    ("packing", packing),
]

#: Token ids are not SQL's to compute; the tests hold the pipeline against a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over the documents of sf_dir."""
    from graphloom.llm.common import scratch_path

    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES:
        path = scratch_path(spark, f"pipeline-{name}")
        stage(spark, docs, sf_dir).write.parquet(path)
        docs = spark.read.parquet(path)
    return docs
