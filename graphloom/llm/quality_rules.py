"""Operator 2, quality rules: rule failures by host, shrunk with an empirical beta prior.

DataFrame functions only. Every document is measured inside its own row with array functions, so
no text is shuffled. Per host the failures are counted, a beta prior is fitted to the rates of all
hosts by the method of moments, and each host gets its posterior mean rate. The verdict of a host
joins back to its documents.

Defined cases: null text counts as empty, fails the base rule and is not kept; a null host is a
host of its own; repeated rows each count and each get a row; an empty table gives no rows; very long texts are measured
in their own row, in time linear in their length up to a sort; extra columns, whatever their names, are
left out of the report and come back unchanged from `keep_quality`.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import WORD_REGEX, WS_CHARS, boxed, join_dimension, materialize, unboxed

#: A document's own rules, beside the base rule: symbols a word and repeated lines a word.
MAX_SYMBOLS_PER_WORD = 0.1
MAX_DUP_LINES_PER_WORD = 0.1
#: Hosts: rejected if the posterior mean of their failure rate exceeds this.
MAX_HOST_RATE = 0.8

MEASURES = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words"]


def _let(value: Column, body) -> Column:
    """body(value) with value computed once for a row: Catalyst inlines plain columns, and a lambda's
    body would compute them for each element."""
    return F.transform(F.array(value), body)[0]


def _repeat_words(words: Column) -> Column:
    """Words in 5-word windows that occur twice or more in the text."""

    def windows(w: Column) -> Column:
        h = F.transform(w, lambda x: F.xxhash64(x))
        return _let(
            h,
            lambda a: F.transform(
                F.sequence(F.lit(1), F.size(a) - 4),
                lambda i: F.xxhash64(*[F.get(a, i + j) for j in range(-1, 4)]),
            ),
        )

    def covered(win: Column) -> Column:
        ranked = F.sort_array(F.transform(win, lambda h, i: F.struct(h.alias("h"), i.alias("i"))))

        def twice(s: Column) -> Column:
            return F.filter(
                s,
                lambda x, k: F.coalesce(F.get(s, k - 1)["h"] == x["h"], F.lit(False))
                | F.coalesce(F.get(s, k + 1)["h"] == x["h"], F.lit(False)),
            )

        positions = F.sort_array(F.transform(_let(ranked, twice), lambda x: x["i"]))
        return _let(
            positions,
            lambda p: F.aggregate(
                p,
                F.struct(F.lit(0).cast("long").alias("n"), F.lit(-5).alias("last")),
                lambda acc, i: F.struct(
                    (acc["n"] + F.least(F.lit(5), i - acc["last"])).alias("n"), i.alias("last")
                ),
                lambda acc: acc["n"],
            ),
        )

    counted = _let(
        windows(words),
        lambda win: F.when(F.size(F.array_distinct(win)) == F.size(win), F.lit(0).cast("long")).otherwise(covered(win)),
    )
    return F.when(F.size(words) < 6, F.lit(0).cast("long")).otherwise(counted)


def measure(docs: DataFrame, text: str = "text") -> DataFrame:
    """Add the five measures (long) and base_failed to the columns of docs."""
    t = F.coalesce(F.col(text), F.lit(""))
    spaced = F.translate(t, WS_CHARS[1:], " " * (len(WS_CHARS) - 1))
    words = F.filter(F.split(spaced, " "), lambda w: w != "")
    lines = F.filter(F.split(t, "\n"), lambda x: x.rlike(WORD_REGEX))
    found = _let(
        words,
        lambda w: F.struct(
            F.size(w).cast("long").alias("n_words"), _repeat_words(w).alias("n_repeat_words")
        ),
    )
    dup = _let(lines, lambda x: (F.size(x) - F.size(F.array_distinct(x))).cast("long"))
    out = docs.withColumns(
        {
            "_found": found,
            "word_chars": F.length(F.translate(t, WS_CHARS, "")).cast("long"),
            "n_symbols": (F.length(t) - F.length(F.translate(t, "#*$%&|<>", ""))).cast("long"),
            "n_dup_lines": dup,
        }
    )
    out = out.withColumns(
        {"n_words": F.col("_found.n_words"), "n_repeat_words": F.col("_found.n_repeat_words")}
    ).drop("_found")
    return out.withColumn("base_failed", base_failed())


def base_failed() -> Column:
    return (F.col("n_words") < 10) | (100 * F.col("n_repeat_words") > 20 * F.col("n_words"))


def own_failed() -> Column:
    """The document rules that a clean document passes."""
    return (F.col("n_symbols") > MAX_SYMBOLS_PER_WORD * F.col("n_words")) | (
        F.col("n_dup_lines") > MAX_DUP_LINES_PER_WORD * F.col("n_words")
    )


def host_verdicts(measured: DataFrame, host: str = "source", max_rate: float = MAX_HOST_RATE) -> DataFrame:
    """Per host: host, n_docs, n_failed, host_rate (posterior mean), host_rejected.

    The prior Beta(a, b) has the mean and variance of the hosts' raw rates, weighted alike; without
    spread, or with one host, its weight is one document.
    """
    by_host = measured.groupBy(F.col(host).alias("host")).agg(
        F.count(F.lit(1)).alias("n_docs"),
        F.sum((F.col("base_failed") | own_failed()).cast("long")).alias("n_failed"),
    )
    raw = F.col("n_failed") / F.col("n_docs")
    moments = by_host.agg(F.avg(raw).alias("m"), F.coalesce(F.var_samp(raw), F.lit(0.0)).alias("v"))
    weight = F.when(
        (F.col("v") > 0) & (F.col("m") * (1 - F.col("m")) > F.col("v")),
        F.col("m") * (1 - F.col("m")) / F.col("v") - 1,
    ).otherwise(F.lit(1.0))
    prior = moments.select((F.col("m") * weight).alias("a"), ((1 - F.col("m")) * weight).alias("b"))
    rate = (F.col("n_failed") + F.col("a")) / (F.col("n_docs") + F.col("a") + F.col("b"))
    joined = by_host.join(F.broadcast(prior), F.lit(True), "inner")  # prior has one row
    return joined.select(
        "host", "n_docs", "n_failed", F.round(rate, 9).alias("host_rate"), (rate > max_rate).alias("host_rejected")
    )


def apply_rules(measured: DataFrame, host: str = "source", max_rate: float = MAX_HOST_RATE) -> DataFrame:
    """Add host_rate and kept to a measured table (a stored one: it is read twice).

    kept is false for a document that fails the base rule or a rule of its own, or whose host is
    rejected.
    """
    verdicts = host_verdicts(measured, host, max_rate).withColumn("_host", F.coalesce("host", F.lit("")))
    verdicts = verdicts.select("_host", F.col("host").isNull().alias("_none"), "host_rate", "host_rejected")
    keyed = measured.withColumns({"_host": F.coalesce(F.col(host), F.lit("")), "_none": F.col(host).isNull()})
    out = join_dimension(keyed, verdicts, ["_host", "_none"])
    kept = ~F.col("base_failed") & ~own_failed() & ~F.col("host_rejected")
    return out.withColumn("kept", kept).drop("_host", "_none", "host_rejected")


def quality_rules(docs: DataFrame) -> DataFrame:
    """doc_id, source, the measures, base_failed, host_rate and kept of each document."""
    narrow = measure(docs.select("doc_id", "source", "text")).drop("text")
    return apply_rules(materialize(narrow, "quality-rules"))


def keep_quality(docs: DataFrame) -> DataFrame:
    """The documents that the rules keep, with their columns.

    Null and empty texts fail the base rule and go; repeated rows stay or go together; extra columns are
    kept as they are, also where they are named like a measure; an empty table stays empty.
    """
    measured = measure(boxed(docs, source=F.col("source"), text=F.col("text"))).drop("text")
    return unboxed(apply_rules(materialize(measured, "quality-kept")).where("kept"))
