"""One object for what a user asks of the graph: seeds, searches, tags, pages, statistics, import and export."""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass, field

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .functions.settings import DEFAULTS
from .functions.text import fuzzy_top
from .operators.lookup import displayed, emptied, result_titles
from .operators.pages import merge_pages
from .operators.ranking import CategoryFilter, permeability
from .plans.discovery import BUDGET, Step, run_search
from .plans.executor import Executor, Seeds
from .schema import AUTHOR, TAG, WORK, Graph
from .session import materialize
from .sources.graph_json import export_graph, import_graph
from .sources.html import parse_pages
from .sources.stats_csv import StatsImport, import_stats


@dataclass
class Engine:
    """A graph with seeds, suppressed works and settings; `executor` fetches pages where a search may do so."""

    spark: SparkSession
    graph: Graph
    executor: Executor | None = None
    settings: dict = field(default_factory=lambda: dict(DEFAULTS))
    filters: dict[str, CategoryFilter] = field(default_factory=dict)
    policy: str = "topological"
    seeds: Seeds = field(init=False)
    suppressed: set[str] = field(default_factory=set)
    titles: dict[str, str] = field(default_factory=dict)
    cancelled: bool = False

    def __post_init__(self) -> None:
        self.seeds = Seeds(self.settings["maxSeeds"], self.settings["maxNegativeSeeds"])
        self.next_id = self._above()

    def _above(self) -> int:
        top = self.graph.nodes.agg(F.max("id")).first()[0]
        return 0 if top is None else top + 1

    def add_seed(self, kind: int, key: str, positive: bool = True, title: str | None = None) -> bool:
        added = self.seeds.add(kind, key, positive)
        if added and title and kind == WORK:
            self.titles[key] = title
        return added

    def remove_seed(self, kind: int, key: str) -> None:
        for side in (self.seeds.positive, self.seeds.negative):
            if (kind, key) in side:
                side.remove((kind, key))

    def suppress(self, key: str) -> None:
        self.suppressed.add(key)

    def unsuppress(self, key: str) -> None:
        self.suppressed.discard(key)

    def cancel(self) -> None:
        self.cancelled = True

    def search(self, budget: int = BUDGET, force: bool = False, seed: int = 0) -> Iterator[Step]:
        """Steps of a search over the graph, which keeps what is fetched; without an executor it only ranks."""
        self.cancelled = False
        if self.executor is not None:
            self.graph, self.next_id = self.executor.ensure(self.graph, [*self.seeds.positive, *self.seeds.negative], self.next_id)

        def fetch(graph: Graph, plan: dict) -> Graph:
            out = self.executor.run(graph, plan, self.next_id)
            self.graph, self.next_id = out.graph, out.next_id
            return out.graph

        mu: Callable[[Graph], DataFrame] | None = (lambda g: permeability(g.nodes, self.filters)) if self.filters else None
        for step in run_search(self.graph, self.seeds.positive, self.seeds.negative, fetch, self.policy, budget if self.executor is not None else 0, mu=mu, seed=seed, force=force, cancelled=lambda: self.cancelled):
            if step.results is not None:
                step.results = self._shown(step.results)
            yield step

    def _shown(self, results: list[dict]) -> list[dict]:
        rows = [(r["rank"], r["key"], r["title"], float(r["relevance"])) for r in results]
        table = self.spark.createDataFrame(rows, "rank long, key string, title string, relevance double")
        hidden = self.spark.createDataFrame([(k,) for k in sorted(self.suppressed)], "key string")
        titles = self.spark.createDataFrame(sorted(self.titles.items()), "key string, title string")
        return [r.asDict() for r in result_titles(displayed(table, hidden, self.settings["topResults"]), titles).orderBy("rank").collect()]

    def search_tags(self, query: str, most: int = 10) -> list[str]:
        tags = self.graph.nodes.filter(F.col("kind") == TAG).select("key", F.coalesce("calibratedFreq", "estimatedFreq").alias("freq"))
        return [r["key"] for r in fuzzy_top(tags, query, most).collect()] if query.strip() else []

    def add_pages(self, pages: DataFrame, now: int) -> None:
        """Pages (seq, url, html) that a reader has opened, in order of seq."""
        parsed = materialize(parse_pages(pages, "seq").filter("kind is not null"), "parsed")
        self.graph, self.next_id = merge_pages(self.graph, parsed, self.next_id, now)

    def add_stats(self, stats: DataFrame) -> StatsImport:
        out = import_stats(self.graph, stats)
        self.graph = out.graph
        return out

    def stats(self) -> dict[str, int]:
        n = {r["kind"]: r["count"] for r in self.graph.nodes.groupBy("kind").count().collect()}
        return {"works": n.get(WORK, 0), "tags": n.get(TAG, 0), "authors": n.get(AUTHOR, 0), "edges": self.graph.edges.count(), "authorEdges": self.graph.author_edges.count()}

    def export(self, at: str) -> DataFrame:
        return export_graph(self.graph, self.next_id, at)

    def load(self, text: str | DataFrame, mode: str = "merge") -> None:
        out = import_graph(self.spark, self.graph, self.next_id, text, mode)
        self.graph, self.next_id = out.graph, out.next_id

    def clear(self) -> None:
        self.graph, self.next_id = emptied(self.graph), 0
