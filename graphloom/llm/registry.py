"""The queries and SQL of this subpackage."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from . import decontaminate as _decontaminate
from . import html_extract as _html
from . import jaccard_join as _jaccard
from . import packing as _packing
from . import pii as _pii
from . import quality_classifier as _classifier
from . import quality_rules as _quality
from . import substring_dedup as _substring
from . import token_rollup as _rollup
from . import warc as _warc


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _rollup.rollup_documents(_table(spark, sf_dir, "documents"))


def token_counts_words(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Operator 1 with the word rule alone, whose counts SQL can state."""
    return _rollup.rollup_documents(_table(spark, sf_dir, "documents"), tokenizers={"words@1": None})


def op2_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = _quality.quality_rules(_table(spark, sf_dir, "documents"))
    return out.select("doc_id", *_quality.MEASURES, "base_failed", "host_rate", "kept")


def op3_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _pii.pii_report(_table(spark, sf_dir, "documents"))


def op4_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _classifier.quality_scores(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "labels"))


def op5_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _decontaminate.contained_items(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "benchmark"))


def op6_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = _warc.round_trip(_table(spark, sf_dir, "pages"))
    return out.select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")


def op7_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _substring.repeated_runs(_table(spark, sf_dir, "documents"))


def op10_html_extract(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _html.extract(_table(spark, sf_dir, "pages"))


def op8_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _jaccard.jaccard_components(_table(spark, sf_dir, "documents"))


def op9_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _packing.pack(_table(spark, sf_dir, "documents"))


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    named = {name: f for name, f in globals().items() if name.startswith("op") and callable(f)}
    return named | {"token_counts_words": token_counts_words}


def oracle_sql() -> dict[str, str]:
    from .sql import ORACLES

    return dict(ORACLES)
