"""A property graph as tables: projections that prune, and mutations that give a new snapshot.

Nodes (id, kind, name, file_path, language, repo_prefix, size) and edges (src, dst, kind, weight) are
DataFrames; an edge's identity is (src, dst, kind). Projections are filters and column choices that reach
the scan. Id sets are tables and meet the graph by semi-joins, so they may be of any size. A mutation
returns the next snapshot with its revision and its receipt, the rows that were added, removed or changed;
nothing is changed in place.
"""

from __future__ import annotations

from dataclasses import dataclass, field, replace

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from graphloom.sources.scratch import small, store

IDENTITY = ["src", "dst", "kind"]


@dataclass(frozen=True)
class GraphStore:
    nodes: DataFrame
    edges: DataFrame
    revision: int = 0
    edge_revision: int = 0
    #: The snapshot before an eviction of nodes and their ids, for its receipt.
    evicted: tuple[GraphStore, DataFrame] | None = field(default=None, compare=False, repr=False)

    # -- projections of nodes ------------------------------------------------------------------------
    def nodes_light(self) -> DataFrame:
        return self.nodes.select("id", "kind", "name", "file_path", "repo_prefix")

    def nodes_by_kinds(self, kinds: list[str]) -> DataFrame:
        return self.nodes.where(F.col("kind").isin(kinds))

    def ids_and_names(self, kinds: list[str]) -> DataFrame:
        return self.nodes_by_kinds(kinds).select("id", "name")

    def by_ids(self, ids: DataFrame) -> DataFrame:
        """Point or batch lookup: the nodes of ids(id)."""
        return self.nodes.join(ids.select("id").distinct(), "id", "left_semi")

    def by_language(self, language: str, kinds: list[str] | None = None, repo: str | None = None) -> DataFrame:
        rows = self.nodes.where(F.col("language") == language)
        rows = rows.where(F.col("kind").isin(kinds)) if kinds else rows
        return rows.where(F.col("repo_prefix") == repo) if repo is not None else rows

    def has_language(self, language: str) -> bool:
        return not self.by_language(language).limit(1).isEmpty()

    def by_names(self, names: DataFrame, most: int, repo: str | None = None, languages: list[str] | None = None) -> DataFrame:
        """Nodes of names(name), at most `most` for each name in order of id, and whether more exist."""
        rows = self.nodes.where(F.col("repo_prefix") == repo) if repo is not None else self.nodes
        rows = rows.where(F.col("language").isin(languages)) if languages else rows
        return self._bounded(rows.join(names.select("name").distinct(), "name", "left_semi"), "name", ["id"], most)

    def by_files(self, files: DataFrame, most: int | None = None) -> DataFrame:
        """Nodes of files(file_path); with `most`, so many a file in order of id, and whether more exist."""
        rows = self.nodes.join(files.select("file_path").distinct(), "file_path", "left_semi")
        return self._bounded(rows, "file_path", ["id"], most) if most else rows

    def in_scope(self, repo: str | None = None, path: str | None = None) -> DataFrame:
        """Nodes of a repository and below a path, by whole path segments."""
        rows = self.nodes.where(F.col("repo_prefix") == repo) if repo is not None else self.nodes
        return rows.where((F.col("file_path") == path) | F.col("file_path").startswith(f"{path}/")) if path else rows

    def placements(self, ids: DataFrame) -> DataFrame:
        return self.by_ids(ids).select("id", "repo_prefix", "file_path")

    def search_keys(self, after: str, page: int) -> DataFrame:
        """A page of (id, name) in order of id, after a key: keyset paging without an offset."""
        return self.nodes.where(F.col("id") > after).select("id", "name").orderBy("id").limit(page)

    def repo_paths(self, repo: str) -> DataFrame:
        return self.nodes.where(F.col("repo_prefix") == repo).select("file_path").distinct()

    def language_counts(self) -> DataFrame:
        """Symbols and files of each repository and language."""
        return self.nodes.groupBy("repo_prefix", "language").agg(F.count(F.lit(1)).alias("symbols"), F.countDistinct("file_path").alias("files"))

    def file_counts(self, repo: str) -> DataFrame:
        return self.nodes.where(F.col("repo_prefix") == repo).groupBy("file_path").agg(F.count(F.lit(1)).alias("nodes"))

    def count_at_least(self, kind: str, least: int) -> bool:
        return self.nodes.where(F.col("kind") == kind).limit(least).count() >= least

    def orphan_prefixes(self, repos: DataFrame) -> DataFrame:
        """Prefixes in use that repos(repo_prefix) does not list, with their nodes."""
        rows = self.nodes.where("repo_prefix <> ''").groupBy("repo_prefix").agg(F.count(F.lit(1)).alias("nodes"))
        return rows.join(repos.select("repo_prefix").distinct(), "repo_prefix", "left_anti")

    def prefix_diagnostics(self) -> DataFrame:
        """Nodes with and without a repository prefix, by kind."""
        return self.nodes.groupBy("kind").agg(F.count_if(F.col("repo_prefix") == "").alias("unprefixed"), F.count_if(F.col("repo_prefix") != "").alias("prefixed"))

    # -- projections of edges ------------------------------------------------------------------------
    def edges_light(self, kinds: list[str] | None = None) -> DataFrame:
        rows = self.edges.where(F.col("kind").isin(kinds)) if kinds else self.edges
        return rows.select(*IDENTITY)

    def edge_page(self, kinds: list[str], after: tuple[str, str, str], page: int) -> DataFrame:
        """A page of edges of some kinds in order of identity, after an identity."""
        s, d, k = (F.lit(x) for x in after)
        later = (F.col("src") > s) | ((F.col("src") == s) & ((F.col("dst") > d) | ((F.col("dst") == d) & (F.col("kind") > k))))
        return self.edges_light(kinds).where(later).orderBy(*IDENTITY).limit(page)

    def outgoing(self, ids: DataFrame, kinds: list[str] | None = None, most: int | None = None) -> DataFrame:
        return self._adjacent(ids, "src", "dst", kinds, most)

    def incoming(self, ids: DataFrame, kinds: list[str] | None = None, most: int | None = None) -> DataFrame:
        return self._adjacent(ids, "dst", "src", kinds, most)

    def incoming_sources(self, ids: DataFrame, kinds: list[str], most: int) -> DataFrame:
        """Distinct sources of edges into ids, at most `most` for each in order, and whether more exist."""
        rows = self.incoming(ids, kinds).select("dst", "src").distinct()
        return self._bounded(rows, "dst", ["src"], most)

    def existing(self, identities: DataFrame) -> DataFrame:
        """identities(src, dst, kind) with whether an edge has them."""
        there = self.edges.select(*IDENTITY).distinct().withColumn("there", F.lit(True))
        return identities.select(*IDENTITY).distinct().join(there, IDENTITY, "left").select(*IDENTITY, F.coalesce("there", F.lit(False)).alias("exists"))

    def by_identities(self, identities: DataFrame) -> DataFrame:
        return self.edges.join(identities.select(*IDENTITY).distinct(), IDENTITY, "left_semi")

    def edges_in_scope(self, repo: str | None = None, path: str | None = None) -> DataFrame:
        """Edges both of whose ends lie in the scope."""
        ids = self.in_scope(repo, path).select("id")
        some = self.edges.join(ids.withColumnRenamed("id", "src"), "src", "left_semi")
        return some.join(ids.withColumnRenamed("id", "dst"), "dst", "left_semi")

    def edges_of_files(self, files: DataFrame, kinds: list[str] | None = None) -> DataFrame:
        ids = self.by_files(files).select(F.col("id").alias("src"))
        return self.edges_light(kinds).join(ids, "src", "left_semi")

    def fan_in(self, ids: DataFrame, kinds: list[str] | None = None) -> DataFrame:
        counts = self.incoming(ids, kinds).groupBy(F.col("dst").alias("id")).agg(F.count(F.lit(1)).alias("fan_in"))
        return ids.select("id").distinct().join(counts, "id", "left").select("id", F.coalesce("fan_in", F.lit(0).cast("long")).alias("fan_in"))

    def file_adjacency(self, kinds: list[str] | None = None) -> DataFrame:
        """Edges between files: (from_file, to_file, edges), the file's own left out."""
        at = self.nodes.select("id", "file_path")
        e = self.edges_light(kinds).join(at.toDF("src", "from_file"), "src").join(at.toDF("dst", "to_file"), "dst")
        return e.where("from_file <> to_file").groupBy("from_file", "to_file").agg(F.count(F.lit(1)).alias("edges"))

    def file_context(self, files: DataFrame) -> DataFrame:
        """What an editor of files(file_path) needs: per file its nodes, edges inside, in and out."""
        at = self.nodes.select("id", "file_path")
        wanted = files.select("file_path").distinct()
        n = at.join(wanted, "file_path", "left_semi").groupBy("file_path").agg(F.count(F.lit(1)).alias("nodes"))
        e = self.edges.select("src", "dst").join(at.toDF("src", "a"), "src").join(at.toDF("dst", "b"), "dst")
        ends = e.select(F.explode(F.array(
            F.struct(F.col("a").alias("f"), (F.col("a") == F.col("b")).alias("inside"), F.lit(True).alias("out")),
            F.struct(F.col("b").alias("f"), (F.col("a") == F.col("b")).alias("inside"), F.lit(False).alias("out")),
        )).alias("x")).select("x.*")
        sums = ends.groupBy(F.col("f").alias("file_path")).agg(
            F.count_if(F.col("inside") & F.col("out")).alias("inside"), F.count_if(~F.col("inside") & F.col("out")).alias("outgoing"), F.count_if(~F.col("inside") & ~F.col("out")).alias("incoming")
        )
        return n.join(sums, "file_path", "left").fillna(0, ["inside", "outgoing", "incoming"])

    def _adjacent(self, ids: DataFrame, near: str, far: str, kinds: list[str] | None, most: int | None) -> DataFrame:
        rows = self.edges_light(kinds).join(ids.select(F.col("id").alias(near)).distinct(), near, "left_semi").select(*IDENTITY)
        return self._bounded(rows, near, [far, "kind"], most) if most else rows

    @staticmethod
    def _bounded(rows: DataFrame, key: str, order: list[str], most: int) -> DataFrame:
        """At most `most` rows of each key and whether more exist; the limit of the rank is applied before
        the shuffle as well, so a hub sends most + 1 rows a task at most."""
        ranked = rows.withColumn("_rn", F.row_number().over(Window.partitionBy(key).orderBy(*order))).where(F.col("_rn") <= most + 1)
        cut = F.max("_rn").over(Window.partitionBy(key)) > most
        return ranked.withColumn("truncated", cut).where(F.col("_rn") <= most).drop("_rn")

    # -- mutations -----------------------------------------------------------------------------------
    def upsert_nodes(self, rows: DataFrame) -> GraphStore:
        """rows with the nodes' columns and seq: of one id the row of the largest seq wins, over the old one too."""
        names = self.nodes.columns
        last = rows.groupBy("id").agg(F.max_by(F.struct(*names), "seq").alias("x")).select("x.*")
        return self._next(nodes=self.nodes.join(last.select("id"), "id", "left_anti").select(*names).unionByName(last.select(*names)))

    def insert_edges(self, rows: DataFrame) -> GraphStore:
        """The first of one identity stays; an edge that is there is not changed."""
        names = self.edges.columns
        fresh = rows.dropDuplicates(IDENTITY).join(self.edges.select(*IDENTITY), IDENTITY, "left_anti")
        return self._next(edges=self.edges.unionByName(fresh.select(*names)))

    def remove_edges(self, identities: DataFrame) -> GraphStore:
        return self._next(edges=self.edges.join(identities.select(*IDENTITY).distinct(), IDENTITY, "left_anti").select(*self.edges.columns))

    def evict_edge_kinds(self, kinds: list[str], sources: DataFrame | None = None) -> GraphStore:
        """Without the edges of some kinds, of all sources or of sources(id)."""
        if sources is None:
            return self._next(edges=self.edges.where(~F.col("kind").isin(kinds)))
        gone = self.edges.where(F.col("kind").isin(kinds)).join(sources.select(F.col("id").alias("src")).distinct(), "src", "left_semi")
        return self.remove_edges(gone)

    def evict_nodes(self, ids: DataFrame) -> GraphStore:
        """Without the nodes and all edges that touch them."""
        gone = ids.select("id").distinct()
        left = self.edges.join(gone.withColumnRenamed("id", "src"), "src", "left_anti").join(gone.withColumnRenamed("id", "dst"), "dst", "left_anti")
        new = self._next(nodes=self.nodes.join(gone, "id", "left_anti").select(*self.nodes.columns), edges=left.select(*self.edges.columns))
        return replace(new, evicted=(self, gone))

    def evict_files(self, files: DataFrame) -> GraphStore:
        return self.evict_nodes(self.by_files(files).select("id"))

    def purge_repo(self, repo: str) -> GraphStore:
        return self.evict_nodes(self.nodes.where(F.col("repo_prefix") == repo).select("id"))

    def rekey_repo(self, old: str, new: str) -> GraphStore:
        return self._next(nodes=self.nodes.withColumn("repo_prefix", F.when(F.col("repo_prefix") == old, new).otherwise(F.col("repo_prefix"))))

    def mark_cross_repo(self) -> DataFrame:
        """Edges with whether their ends lie in different, non-empty repositories."""
        at = self.nodes.select("id", "repo_prefix")
        e = self.edges.join(at.toDF("src", "_a"), "src", "left").join(at.toDF("dst", "_b"), "dst", "left")
        cross = F.coalesce((F.col("_a") != F.col("_b")) & (F.col("_a") != "") & (F.col("_b") != ""), F.lit(False))
        return e.select(*self.edges.columns, cross.alias("cross_repo"))

    def receipt(self, before: GraphStore) -> DataFrame:
        """What a mutation did: (what, change, kind, n) of nodes and edges added, removed or changed. Of an eviction
        of nodes just before it is counted from their ids, else the two snapshots are compared."""
        if self.evicted is not None and self.evicted[0] is before:
            gone = small(store(self.evicted[1].where("id is not null"), "evicted"))
            from_, to = gone.withColumnRenamed("id", "src"), gone.withColumnRenamed("id", "dst")
            e = before.edges.select(*IDENTITY)
            touched = e.join(from_, "src", "left_semi").select("kind").unionByName(e.join(from_, "src", "left_anti").join(to, "dst", "left_semi").select("kind"))
            rows = before.nodes.join(gone, "id", "left_semi").select(F.lit("node").alias("what"), "kind").unionByName(touched.select(F.lit("edge").alias("what"), "kind"))
            return rows.groupBy("what", F.lit("removed").alias("change"), "kind").agg(F.count(F.lit(1)).alias("n"))

        def diff(what: str, old: DataFrame, new: DataFrame, key: list[str]) -> DataFrame:
            rest = [c for c in old.columns if c not in key]
            x = old.select(*key, F.xxhash64(*rest).alias("_x"), F.col("kind").alias("_k") if "kind" not in key else F.lit(1).alias("_k"))
            y = new.select(*key, F.xxhash64(*rest).alias("_y"), F.col("kind").alias("_l") if "kind" not in key else F.lit(1).alias("_l"))
            kind = F.col("kind") if "kind" in key else F.coalesce("_l", "_k")
            change = F.when(F.col("_x").isNull(), "added").when(F.col("_y").isNull(), "removed").when(F.col("_x") != F.col("_y"), "changed")
            met = x.join(y, key, "full_outer").select(F.lit(what).alias("what"), change.alias("change"), kind.alias("kind")).where("change is not null")
            return met.groupBy("what", "change", "kind").agg(F.count(F.lit(1)).alias("n"))

        return diff("node", before.nodes, self.nodes, ["id"]).unionByName(diff("edge", before.edges, self.edges, IDENTITY))

    def _next(self, nodes: DataFrame | None = None, edges: DataFrame | None = None) -> GraphStore:
        return replace(
            self, nodes=self.nodes if nodes is None else nodes, edges=self.edges if edges is None else edges,
            revision=self.revision + 1, edge_revision=self.edge_revision + (edges is not None), evicted=None,
        )


@dataclass(frozen=True)
class SideTable:
    """Rows kept beside the graph (blame, churn, coverage, releases, constants, file times, facts,
    embeddings) under a key: set, replace an owner's rows, delete, load."""

    rows: DataFrame
    key: tuple[str, ...]

    def set(self, new: DataFrame) -> SideTable:
        """new rows take the place of those with their keys; of equal new keys any one stays."""
        new = new.select(*self.rows.columns).dropDuplicates(list(self.key))
        return replace(self, rows=self.rows.join(new.select(*self.key), list(self.key), "left_anti").select(*self.rows.columns).unionByName(new))

    def replace_owned(self, owners: DataFrame, new: DataFrame) -> SideTable:
        """All rows of the owners go, the new ones come: owners whose rows have vanished lose them."""
        return replace(self, rows=self.delete(owners).rows.unionByName(new.select(*self.rows.columns)))

    def delete(self, owners: DataFrame) -> SideTable:
        return replace(self, rows=self.rows.join(owners.distinct(), owners.columns, "left_anti").select(*self.rows.columns))

    def load(self, owners: DataFrame) -> DataFrame:
        return self.rows.join(owners.distinct(), owners.columns, "left_semi")

    def page(self, after: str, most: int) -> DataFrame:
        """A page in order of the first key, after a value of it."""
        return self.rows.where(F.col(self.key[0]) > after).orderBy(*self.key).limit(most)


def route(changed: int, total: int, scoped_from: float = 0.1, full_from: float = 0.4) -> str:
    """How to index again: incremental, scoped or full, by the share of files that changed."""
    share = changed / total if total else 1.0
    return "full" if share > full_from else "scoped" if share > scoped_from else "incremental"


def subtree_hashes(files: DataFrame) -> DataFrame:
    """files(path, hash): (dir, hash) of every directory, from the sorted hashes of all files below it."""
    parts = F.split("path", "/")
    dirs = F.transform(F.sequence(F.lit(1), F.size(parts) - 1), lambda n: F.array_join(F.slice(parts, 1, n), "/"))
    below = files.where(F.col("path").contains("/")).select("path", "hash", F.explode(dirs).alias("dir"))
    # a hash of a sum of hashes: commutative, so no directory's files are gathered or sorted
    mixed = F.xxhash64("path", "hash").cast("decimal(38,0)")
    return below.groupBy("dir").agg(F.count(F.lit(1)).alias("files"), F.sum(mixed).alias("mix")).select("dir", "files", F.sha2(F.concat_ws(":", "files", F.col("mix").cast("string")), 256).alias("hash"))


def subtrees_changed(old: DataFrame, new: DataFrame) -> DataFrame:
    """Directories whose files differ, with what happened to them."""
    a, b = (subtree_hashes(x).select("dir", F.col("hash").alias(h)) for x, h in ((old, "h1"), (new, "h2")))
    change = F.when(F.col("h1").isNull(), "added").when(F.col("h2").isNull(), "removed").when(F.col("h1") != F.col("h2"), "changed")
    return a.join(b, "dir", "full_outer").select("dir", change.alias("change")).where("change is not null")
