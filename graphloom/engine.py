"""Engine: the graph's queries by the names users know them by.

Every answer is a DataFrame. Callers also follow references, as uses of a symbol that is passed on.
"""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from graphloom.operators import analysis, scan, traverse
from graphloom.operators.graph_stats import connectivity, kind_histogram


@dataclass(frozen=True)
class Engine:
    nodes: DataFrame
    edges: DataFrame
    calls: list[str] = field(default_factory=lambda: ["calls"])
    references: list[str] = field(default_factory=lambda: ["references"])
    imports: list[str] = field(default_factory=lambda: ["imports"])
    implements: list[str] = field(default_factory=lambda: ["implements", "extends"])

    def _seed(self, *ids: str) -> DataFrame:
        return self.nodes.where(F.col("id").isin(list(ids))).select("id")

    def _walk(self, ids: tuple[str, ...], kinds: list[str] | None, direction: str, depth: int, limit: int | None) -> DataFrame:
        out = traverse.bfs(self._seed(*ids), self.edges, depth, direction, kinds).where("depth > 0")
        return out.orderBy("depth", "node_id").limit(limit) if limit else out

    def symbol(self, name: str) -> DataFrame:
        return self.nodes.where(F.col("name") == name)

    def callers(self, *ids: str, depth: int = 1, limit: int | None = None) -> DataFrame:
        return self._walk(ids, [*self.calls, *self.references], "in", depth, limit)

    def call_chain(self, *ids: str, depth: int = 3, limit: int | None = None) -> DataFrame:
        return self._walk(ids, self.calls, "out", depth, limit)

    def dependencies(self, *ids: str, depth: int = 1, limit: int | None = None) -> DataFrame:
        return self._walk(ids, None, "out", depth, limit)

    def dependents(self, *ids: str, depth: int = 1, limit: int | None = None) -> DataFrame:
        return self._walk(ids, None, "in", depth, limit)

    def usages(self, *ids: str, limit: int | None = None) -> DataFrame:
        out = self.edges.join(self._seed(*ids).withColumnRenamed("id", "dst"), "dst", "left_semi").where(F.col("kind").isin([*self.calls, *self.references]))
        return out.orderBy("src", "kind").limit(limit) if limit else out

    def implementations(self, *ids: str, depth: int = 8) -> DataFrame:
        return self._walk(ids, self.implements, "in", depth, None)

    def import_closure(self, *ids: str, depth: int = 6) -> DataFrame:
        return self._walk(ids, self.imports, "out", depth, None)

    def paths(self, source: str, target: str, depth: int = 6, k: int = 3) -> DataFrame:
        return traverse.shortest_paths(self._seed(source), self._seed(target), self.edges, depth, k)

    def impact(self, *ids: str, depth: int = 3) -> DataFrame:
        return analysis.impact(self._seed(*ids), self.edges, F.lit(False), depth)

    def pipeline(self, text: str, limit: int = 50) -> DataFrame:
        return scan.run_pipeline(self.nodes, self.edges, text, limit)

    def stats(self) -> DataFrame:
        return connectivity(self.nodes, self.edges)

    def edge_kinds(self) -> DataFrame:
        return kind_histogram(self.edges)
