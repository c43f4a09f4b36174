"""Change history, ownership and event-log analytics."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from graphloom.sources.scratch import pieces, store


#: Releases that one row may hold.
MAX_RELEASES = 10_000


def co_change(touches: DataFrame, max_files: int = 40, min_count: int = 2) -> DataFrame:
    """touches(commit, file): pairs of files changed together, with the cosine of their counts.

    Commits of more than max_files files form no pairs, which bounds the pairs of a commit, but they
    count in the denominators.
    """
    rows = touches.select("commit", "file").distinct()
    size = rows.groupBy("commit").agg(F.count(F.lit(1)).alias("n"))
    total = rows.groupBy("file").agg(F.count(F.lit(1)).alias("total"))
    small = rows.join(size.where(F.col("n").between(2, max_files)), "commit").select("commit", "file")
    packed = small.groupBy("commit").agg(F.sort_array(F.collect_list("file")).alias("files"))  # max_files at most
    pairs = packed.select(F.posexplode("files").alias("i", "a"), "files").select("a", F.explode(F.slice("files", F.col("i") + 2, F.size("files"))).alias("b"))
    counts = pairs.groupBy("a", "b").agg(F.count(F.lit(1)).alias("together")).where(F.col("together") >= min_count)
    out = counts.join(total.withColumnsRenamed({"file": "a", "total": "n_a"}), "a").join(total.withColumnsRenamed({"file": "b", "total": "n_b"}), "b")
    cosine = F.least(F.col("together") / F.sqrt(F.col("n_a").cast("double") * F.col("n_b")), F.lit(1.0))
    return out.select("a", "b", "together", F.round(cosine, 6).alias("score"))


def churn(touches: DataFrame, now: Column) -> DataFrame:
    """touches(file, commit, author, ts): commits, authors, age in days and commits a day of age."""
    out = touches.groupBy("file").agg(F.countDistinct("commit").alias("commits"), F.countDistinct("author").alias("authors"), F.min("ts").alias("first"), F.max("ts").alias("last"))
    age = F.datediff(now, "first")
    return out.select("file", "commits", "authors", age.alias("age_days"), F.datediff(now, "last").alias("idle_days"), F.round(F.col("commits") / F.greatest(age, F.lit(1)), 6).alias("rate"))


def last_owner(touches: DataFrame, rows: int) -> DataFrame:
    """The last author of each file, and the author of most commits (ties: smallest name). rows: about how many
    touches there are. An author's commits of a file are counted in one place, then a file's authors meet; both in
    pieces that do not grow with the rows."""
    n, own = pieces(rows), touches.where("file is not null").repartition(pieces(rows), "file", "author")
    by = own.groupBy("file", "author").agg(F.countDistinct("commit").alias("n"), F.max(F.struct("ts", "commit")).alias("last"))
    return by.repartition(n, "file").groupBy("file").agg(
        F.max_by("author", F.struct("last", "author")).alias("last_author"), F.min_by("author", F.struct(-F.col("n"), F.col("author"))).alias("owner"), F.max("n").alias("owner_commits"),
    )


def added_in(files: DataFrame, releases: DataFrame) -> DataFrame:
    """files(file, ts) and releases(tag, ts): the earliest release at or after each file's start.

    An as-of join without a range join: both sides are one ordered stream of a few releases and all
    files; up to MAX_RELEASES releases each file looks its own up in a sorted array, and more are an error.
    """
    if releases.limit(MAX_RELEASES + 1).count() > MAX_RELEASES:
        raise ValueError(f"more than {MAX_RELEASES} releases")
    order = releases.groupBy().agg(F.sort_array(F.collect_list(F.struct("ts", "tag"))).alias("all"))
    met = files.select("file", F.col("ts").alias("_start")).join(F.broadcast(order))  # one row
    later = F.filter("all", lambda r: r["ts"] >= F.col("_start"))
    return met.select("file", F.get(later, F.lit(0))["tag"].alias("added_in"))


def reviewers(owners: DataFrame, authors: DataFrame, partners: DataFrame) -> DataFrame:
    """3 * codeowner + 2 * author + 1 * co-change, each (file, person)."""
    w = lambda df, k: df.select("file", "person", F.lit(k).alias("w")).distinct()
    return w(owners, 3).unionByName(w(authors, 2)).unionByName(w(partners, 1)).groupBy("file", "person").agg(F.sum("w").alias("score"))


def rollup(events: DataFrame, key: str) -> DataFrame:
    """Calls and sums by a key; an empty key is (unknown)."""
    name = F.when(F.coalesce(F.col(key), F.lit("")) == "", "(unknown)").otherwise(F.col(key))
    return events.groupBy(name.alias(key)).agg(F.count(F.lit(1)).alias("calls"), F.sum(F.col("value").cast("decimal(18,4)")).cast("double").alias("total"))


def retrieval_log(events: DataFrame, zero_below: float = 1.0) -> DataFrame:
    """Per event_type: count, zero results, zero rate, p50 and p95 by the floor index.

    The index needs ranks, not arrays: values are counted by value first, so no group is collected.
    """
    total = Window.partitionBy("event_type")
    running = total.orderBy("value").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    by = events.groupBy("event_type", "value").agg(F.count(F.lit(1)).alias("n"))
    ranked = by.withColumns({"up": F.sum("n").over(running), "all": F.sum("n").over(total)})

    def at(q: float) -> Column:
        place = F.floor(F.lit(q) * (F.col("all") - 1))
        return F.min(F.when(F.col("up") > place, F.col("value")))

    zero = F.sum(F.when(F.col("value") < zero_below, F.col("n")).otherwise(0))
    return ranked.groupBy("event_type").agg(F.sum("n").alias("calls"), zero.alias("zero"), F.round(zero / F.sum("n"), 6).alias("zero_rate"), at(0.5).alias("p50"), at(0.95).alias("p95"))


def frecency(events: DataFrame, now: Column, half_life_days: float = 3.0, history: int = 16) -> DataFrame:
    """Sum over the last `history` accesses of exp(-ln 2 / h * days), and the boost 1 + min(.5, s / max * .5)."""
    w = Window.partitionBy("user_id").orderBy(F.desc("ts"), "event_id")
    recent = events.withColumn("rn", F.row_number().over(w)).where(F.col("rn") <= history)
    days = F.greatest((now.cast("double") - F.col("ts").cast("timestamp").cast("double")) / 86400.0, F.lit(0.0))
    s = recent.groupBy("user_id").agg(F.sum(F.exp(-F.lit(0.6931471805599453) / half_life_days * days)).alias("s"))
    s = store(s, "frecency")
    s = s.crossJoin(F.broadcast(s.agg(F.max("s").alias("top"))))  # one row
    top = F.col("top")
    return s.select("user_id", F.round("s", 6).alias("frecency"), F.round(1 + F.least(F.lit(0.5), F.col("s") / top * 0.5), 6).alias("boost"))


def streaks(events: DataFrame, reset_type: str, note: int = 6, escalate: int = 10) -> DataFrame:
    """Longest run of events without a reset for each user, and what it triggers."""
    w = Window.partitionBy("user_id").orderBy("ts", "event_id")
    island = F.sum((F.col("event_type") == reset_type).cast("int")).over(w)
    runs = events.withColumn("island", island).where(F.col("event_type") != reset_type).groupBy("user_id", "island").agg(F.count(F.lit(1)).alias("n"))
    longest = runs.groupBy("user_id").agg(F.max("n").alias("longest"))
    return longest.withColumn("level", F.when(F.col("longest") >= escalate, "escalate").when(F.col("longest") >= note, "note").otherwise("none"))


def windows(events: DataFrame, now: Column) -> DataFrame:
    """Per event_type: today, last 7 * 24 h, all time."""
    today, week = F.to_date("ts") == F.to_date(now), F.col("ts") >= now - F.expr("INTERVAL 168 HOURS")
    return events.groupBy("event_type").agg(F.count_if(today).alias("today"), F.count_if(week).alias("week"), F.count(F.lit(1)).alias("ever"))


def daily(events: DataFrame) -> DataFrame:
    return events.groupBy(F.to_date("ts").cast("string").alias("day"), "event_type").agg(F.count(F.lit(1)).alias("n"))


def duration_bucket(ms: Column) -> Column:
    return F.when(ms < 1, "<1ms").when(ms < 10, "1-10ms").when(ms < 100, "10-100ms").when(ms < 1000, "100ms-1s").when(ms < 10000, "1-10s").otherwise("10s+")


def shared_groups(members: DataFrame) -> DataFrame:
    """members(item, group): groups that more than one item touches."""
    return members.groupBy("group").agg(F.countDistinct("item").alias("items")).where("items > 1")


def tree_diff(old: DataFrame, new: DataFrame) -> DataFrame:
    """(path, hash) tables: added, removed and changed paths."""
    met = old.select("path", F.col("hash").alias("h1")).join(new.select("path", F.col("hash").alias("h2")), "path", "full_outer")
    what = F.when(F.col("h1").isNull(), "added").when(F.col("h2").isNull(), "removed").when(F.col("h1") != F.col("h2"), "changed")
    return met.select("path", what.alias("change")).where("change is not null")


def innermost(points: DataFrame, spans: DataFrame, bucket: int = 16) -> DataFrame:
    """points(file, line) and spans(file, name, lo, hi): the shortest span around each point.

    Spans are cut into buckets of lines, so the join is an equi-join on (file, bucket).
    """
    s = spans.withColumn("b", F.explode(F.sequence(F.floor(F.col("lo") / bucket), F.floor(F.col("hi") / bucket))))
    p = points.withColumn("b", F.floor(F.col("line") / bucket))
    met = p.join(s, ["file", "b"]).where(F.col("line").between(F.col("lo"), F.col("hi")))
    return met.groupBy("file", "line").agg(F.min_by("name", F.struct(F.col("hi") - F.col("lo"), F.col("name"))).alias("name"))
