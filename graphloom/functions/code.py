"""Functions over code: normal forms, names of tests, commit subjects, types, log lines."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

# Words that a normal form keeps.
KEYWORDS = "if else for while return def class func function import from in not and or try except catch switch case break continue new var let const int float string bool void public private static struct".split()


def normal_form(code: Column) -> Column:
    """Tokens of code with names as v, numbers as 0 and strings as s; keywords, brackets and runs of
    operators stay. Texts that differ only in names and values have one normal form."""
    tokens = F.regexp_extract_all(code, F.lit(r"\"(?:[^\"\\]|\\.)*\"|'(?:[^'\\]|\\.)*'|[A-Za-z_]\w*|\d+(?:\.\d+)?|[()\[\]{}]|[^\w\s()\[\]{}\"']+"), F.lit(0))
    return F.transform(
        tokens,
        lambda t: F.when(t.isin(KEYWORDS), t).when(t.rlike("^[A-Za-z_]"), "v").when(t.rlike("^[0-9]"), "0").when(t.rlike("^[\"']"), "s").otherwise(t),
    )


def test_stem(name: Column) -> Column:
    """What a test's name tests: without test or spec before or behind, and without the ending of a file."""
    out = F.regexp_replace(name, r"\.[A-Za-z]+$", "")
    out = F.regexp_replace(out, r"(?i)^(test|spec)[_-]?|[_.-]?(test|tests|spec)$", "")
    return F.lower(out)


def is_fix(subject: Column) -> Column:
    """Whether a commit's subject tells of a repair."""
    return subject.rlike(r"(?i)\b(fix(e[sd])?|bug(fix)?|hotfix|revert(ed)?|regression|error|crash)\b")


def savings(full: Column, used: Column) -> Column:
    """Share saved, in percent, from 0 to 100; 0 of nothing."""
    return F.when(full > 0, F.least(F.greatest(100.0 * (full - used) / full, F.lit(0.0)), F.lit(100.0))).otherwise(0.0)


def plain_type(name: Column) -> Column:
    """A C++ type without const, references, pointers and smart pointers around it."""
    out = F.regexp_replace(name, r"\b(const|volatile|struct|class|typename)\b", "")
    out = F.regexp_replace(out, r"^\s*(?:std::)?(?:unique_ptr|shared_ptr|weak_ptr)\s*<\s*(.*?)\s*>\s*[&*]*\s*$", "$1")
    return F.trim(F.regexp_replace(F.regexp_replace(out, r"[&*]+", ""), r"\s+", " "))


def merge_counts(rows: DataFrame, key: str, counts: str) -> DataFrame:
    """rows(key, map of counts): the maps of a key added up."""
    each = rows.select(key, F.explode(counts).alias("name", "n")).groupBy(key, "name").agg(F.sum("n").alias("n"))
    return each.groupBy(key).agg(F.map_from_entries(F.array_sort(F.collect_list(F.struct("name", "n")))).alias(counts))  # distinct names of one key


def read_jsonl(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """Rows of a file of JSON lines; malformed lines are skipped."""
    return spark.read.schema(schema).option("mode", "DROPMALFORMED").json(path)
