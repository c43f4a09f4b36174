"""The analyses by name: rollups of edge kinds, two-sided tallies, dangling ends, stale rows, line rules."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# The edge kinds that an analysis rolls up, and the end it groups by.
ROLLUPS = {
    "annotation_users": (["annotated"], "dst"), "cgo_users": (["uses_cgo"], "src"), "wasm_users": (["uses_wasm_bindgen"], "src"),
    "components": (["renders"], "src"), "config_readers": (["reads_config", "reads_env"], "dst"), "env_var_users": (["reads_env"], "dst"),
    "error_surface": (["throws"], "src"), "event_emitters": (["emits"], "dst"), "external_calls": (["calls_external"], "dst"),
    "field_writers": (["writes"], "dst"), "goroutine_spawns": (["spawns"], "dst"), "images": (["uses_image"], "dst"),
    "indirect_mutations": (["mutates_via"], "dst"), "k8s_resources": (["depends_on", "configures", "mounts", "exposes", "uses_env"], "src"),
    "kustomize": (["overlays"], "src"), "log_events": (["logs"], "dst"), "models": (["models_table"], "dst"), "routes": (["handles_route"], "dst"),
    "route_frameworks": (["routed_by"], "dst"), "sql_call_sites": (["queries"], "src"), "string_emitters": (["emits_string"], "dst"),
    "swiftui_views": (["has_view_role"], "dst"), "uikit_classes": (["has_uikit_role"], "dst"), "drupal_hooks": (["implements_hook"], "dst"),
    "tests_as_edges": (["tests"], "dst"), "synthesizers": (["synthesized_by"], "dst"), "speculative": (["may_call"], "dst"), "dbt_models": (["derives_from"], "src"),
}


def rollups(edges: DataFrame, names: list[str] | None = None) -> DataFrame:
    """(analysis, subject, uses, others): every analysis in one pass: edges that its kinds name, and how many
    distinct other ends the subject has."""
    rows = [(n, k, side == "dst") for n, (kinds, side) in ROLLUPS.items() if names is None or n in names for k in kinds]
    table = edges.sparkSession.createDataFrame(rows, "analysis string, kind string, by_target boolean")
    met = edges.select("src", "dst", "kind").join(F.broadcast(table), "kind")  # a row for each analysis and kind
    subject = F.when(F.col("by_target"), F.col("dst")).otherwise(F.col("src")).alias("subject")
    other = F.when(F.col("by_target"), F.col("src")).otherwise(F.col("dst")).alias("other")
    return met.select("analysis", subject, other).groupBy("analysis", "subject").agg(F.count(F.lit(1)).alias("uses"), F.countDistinct("other").alias("others"))


def two_sided(edges: DataFrame, give: list[str], take: list[str]) -> DataFrame:
    """Per target its givers and takers (channels, topics), and whether one side is missing."""
    some = edges.where(F.col("kind").isin([*give, *take])).groupBy("dst").agg(
        F.count_if(F.col("kind").isin(give)).alias("gives"), F.count_if(F.col("kind").isin(take)).alias("takes")
    )
    return some.select("dst", "gives", "takes", ((F.col("gives") == 0) | (F.col("takes") == 0)).alias("mismatch"))


def dangling(edges: DataFrame, provided: DataFrame, kinds: list[str]) -> DataFrame:
    """Targets of edges of some kinds that provided(id) lacks, with their uses: tables without a migration,
    links of documents that lead nowhere, dispatches without a handler."""
    return edges.where(F.col("kind").isin(kinds)).groupBy(F.col("dst").alias("id")).agg(F.count(F.lit(1)).alias("uses")).join(provided.select("id").distinct(), "id", "left_anti")


def unreferenced(provided: DataFrame, edges: DataFrame, kinds: list[str]) -> DataFrame:
    """provided(id) that no edge of some kinds leads to."""
    return provided.select("id").distinct().join(edges.where(F.col("kind").isin(kinds)).select(F.col("dst").alias("id")).distinct(), "id", "left_anti")


def stale(rows: DataFrame, key: str, ts: str, cutoff: Column) -> DataFrame:
    """Keys all of whose rows are older than the cutoff, with the last of them."""
    return rows.groupBy(key).agg(F.max(ts).alias("last"), F.count(F.lit(1)).alias("n")).where(F.col("last") < cutoff).select(key, "n")


# Line rules: (rule, severity, pattern).
LINE_RULES = [
    ("todo", "info", r"\b(TODO|FIXME|HACK|XXX|NOTE)\b"), ("hardcoded_secret", "high", r"(?i)(password|secret|api_?key|token)\s*[:=]\s*\S{6,}"),
    ("weak_hash", "medium", r"(?i)\b(md5|sha1)\s*\("), ("shell", "high", r"(?i)\b(os\.system|subprocess|eval|exec)\s*\("),
    ("license", "info", r"(?i)\blicen[cs]ed? under\b|SPDX-License-Identifier"), ("sql_concat", "high", r"(?i)\bselect\b.+\bwhere\b.+[+%]"),
    ("unsafe", "medium", r"\b(unsafe|panic!?|unwrap)\b\s*[({]"), ("address", "low", r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+\.[A-Za-z]{2,}"),
]


def scan_lines(docs: DataFrame, key: str, text: str, rules: list[tuple[str, str, str]] = LINE_RULES) -> DataFrame:
    """(key, line, rule, severity) of every line that a rule finds. One split for all rules; a row holds the
    rules that fit it, so no line is multiplied by the rules."""
    lines = docs.select(F.col(key).alias("key"), F.posexplode(F.split(F.col(text), "\n")).alias("i", "line"))
    found = F.filter(F.array(*[F.when(F.col("line").rlike(p), F.struct(F.lit(r).alias("rule"), F.lit(s).alias("severity"))) for r, s, p in rules]), lambda x: x.isNotNull())
    return lines.select("key", (F.col("i") + 1).alias("line"), F.explode(found).alias("x")).select("key", "line", "x.rule", "x.severity")


def signature_breaks(old: DataFrame, new: DataFrame, calls: DataFrame) -> DataFrame:
    """old and new (id, params array) and calls(caller, callee, args): calls that a change of signature breaks:
    the callee is gone, or takes another number of parameters than the call has."""
    changed = old.select("id", F.size("params").alias("was")).join(new.select("id", F.size("params").alias("now")), "id", "left").where("now is null or now <> was")
    met = calls.join(changed.withColumnRenamed("id", "callee"), "callee").where("now is null or args <> now")
    return met.select("caller", "callee", F.when(F.col("now").isNull(), "removed").otherwise("arity").alias("reason")).distinct()


def event_boundary(publishes: DataFrame, subscribes: DataFrame, domain: Column) -> DataFrame:
    """publishes(id, topic) and subscribes(id, topic): pairs of domains that a topic connects, with its topics.
    Ends are reduced to domains first, so a busy topic joins domains, not members."""
    a = publishes.select("topic", domain.alias("from_domain")).distinct()
    b = subscribes.select("topic", domain.alias("to_domain")).distinct()
    return a.join(b, "topic").where("from_domain <> to_domain").groupBy("from_domain", "to_domain").agg(F.countDistinct("topic").alias("topics"))
