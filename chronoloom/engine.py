"""The facade: ingest, search, ask, travel in time, detect communities, over frames that the caller brings or a store holds.

Extension points are protocols: an embedder, an extractor, a language model and a strategy are plain callables
or objects with the methods below; none is shipped that needs a network.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass, field
from typing import Protocol

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from chronoloom.functions import text as T
from chronoloom.functions import vectors as V
from chronoloom.operators import graph as G
from chronoloom.operators import ingest as I
from chronoloom.operators import retrieval as R
from chronoloom.operators import routing as Q
from chronoloom.operators import temporal as D


class Embedder(Protocol):
    """Text column to vector column."""

    def __call__(self, text: Column) -> Column: ...


class Extractor(Protocol):
    """Episodes (id, text) to entities (name, entity_type, episode) and edges (source, target, relationship_type, fact, episode)."""

    def __call__(self, episodes: DataFrame) -> tuple[DataFrame, DataFrame]: ...


class LanguageModel(Protocol):
    """A completion and what it costs in dollars."""

    def complete(self, prompt: str) -> str: ...

    def cost(self, tokens_in: int, tokens_out: int) -> float: ...


class Strategy(Protocol):
    """A question to ranked rows."""

    name: str

    def execute(self, engine: "Engine", question: str, k: int) -> DataFrame: ...


class OverBudget(RuntimeError):
    """A call would pass the budget."""


def pattern_extractor(episodes: DataFrame) -> tuple[DataFrame, DataFrame]:
    """The default extractor: relation patterns and the names around them."""
    from chronoloom.operators.extraction import relation_pairs

    r = episodes.where("text IS NOT NULL").select("id", F.explode(relation_pairs(F.col("text"))).alias("r")).select("id", "r.*")
    names = r.select(F.explode(F.array("source", "target")).alias("name"), F.lit("Entity").alias("entity_type"), F.col("id").alias("episode"))
    return names, r.select("source", "target", F.col("relation").alias("relationship_type"), F.concat_ws(" ", "source", "relation", "target").alias("fact"), F.col("id").alias("episode"))


@dataclass
class Router:
    """Chooses a model: an override, else by strategy among the healthy ones within the budget."""

    models: dict[str, LanguageModel] = field(default_factory=dict)
    prices: dict[str, tuple[float, float]] = field(default_factory=dict)
    latency: dict[str, float] = field(default_factory=dict)
    healthy: dict[str, bool] = field(default_factory=dict)
    strategy: str = "cost"
    budget: float | None = None
    spent: float = 0.0

    def route(self, override: str | None = None) -> str:
        if override is not None:
            if override not in self.models:
                raise KeyError(override)
            return override
        ok = [n for n in self.models if self.healthy.get(n, True)]
        if not ok:
            raise LookupError("no healthy model")
        order = {"cost": lambda n: sum(self.prices.get(n, (0.0, 0.0))), "latency": lambda n: self.latency.get(n, 0.0), "fixed": lambda n: list(self.models).index(n)}[self.strategy]
        return min(ok, key=lambda n: (order(n), n))

    def record(self, cost: float) -> None:
        if self.budget is not None and self.spent + cost > self.budget:
            raise OverBudget(f"{self.spent + cost:.6f} of {self.budget:.6f}")
        self.spent += cost


class LocalStrategy:
    """Hybrid search over entities, then the facts at the hits."""

    name = "local"

    def execute(self, engine: "Engine", question: str, k: int) -> DataFrame:
        return engine.search(question, k)


class GlobalStrategy:
    """Community summaries ranked by the question; hybrid search where there is none."""

    name = "global"

    def execute(self, engine: "Engine", question: str, k: int) -> DataFrame:
        found = engine.communities()
        texts = G.summaries(found.where("level = 0"), engine.entities).select(F.col("community").alias("id"), F.col("summary").alias("text"), F.lit(0.5).alias("importance"))
        ranked = R.drift_global(question, texts, k)
        return ranked if ranked.limit(1).count() else engine.search(question, k)


@dataclass
class Engine:
    """Entities (id, name, entity_type, summary, created_at, updated_at, …) and edges (id, source_id, target_id, …)."""

    spark: SparkSession
    entities: DataFrame
    relationships: DataFrame
    embed: Embedder = V.hash_embedding
    extract: Extractor = pattern_extractor
    strategies: dict[str, Strategy] = field(default_factory=lambda: {s.name: s for s in (LocalStrategy(), GlobalStrategy())})

    def add_text(self, texts: DataFrame, at: str, mode: str = "enhanced") -> DataFrame:
        """Ingest texts (id, text) as of a date; gives the conflicts that came up."""
        out = I.ingest(texts, self.extract, {"entities": self.entities, "relationships": self.relationships}, D.ts(at), mode)
        self.entities, self.relationships = out["entities"], out["relationships"]
        return out["conflicts"]

    def search(self, query: str, k: int = 10, seeds: list[str] | None = None) -> DataFrame:
        """id, score, sources: semantic, keyword, PageRank and (from seeds) traversal lists, fused."""
        return self.search_with_stages(query, k, seeds)[0]

    def search_with_stages(self, query: str, k: int = 10, seeds: list[str] | None = None, rerank: bool = False) -> tuple[DataFrame, DataFrame]:
        """The hits and how many each stage gave (stage, n)."""
        rows = self.entities.select("id", F.concat_ws(" ", "name", "summary").alias("text"))
        return R.hybrid(rows, self.relationships, query, k, seeds, rerank, self.embed)

    def facts_of(self, hits: DataFrame) -> DataFrame:
        """id, fact, current of the edges at the hits, each once."""
        r = self.relationships.withColumn("end", F.explode(F.array("source_id", "target_id"))).join(hits.select(F.col("id").alias("end")), "end", "left_semi")
        return r.select("id", "fact", D.valid_now().alias("current")).dropDuplicates(["id"])

    def ask(self, question: str, k: int = 10) -> tuple[str, DataFrame]:
        """The query type and the ranked rows of the strategy that answers it."""
        kind = self.spark.range(1).select(Q.query_type(F.lit(question))).first()[0]
        strategy = self.strategies["global" if kind == "global" and "global" in self.strategies else "local"]
        return kind, strategy.execute(self, question, k)

    def context(self, question: str, tokens: int = 4000, k: int = 10) -> DataFrame:
        """line_no, line: what a language model would be given."""
        hits = self.search(question, k)
        named = self.entities.join(hits.select("id"), "id", "left_semi").select("name", "summary")
        none = self.spark.createDataFrame([], "summary string")
        return Q.assemble_context(named, self.facts_of(hits).select("fact", "current"), none, tokens)

    def at(self, date: str) -> "Engine":
        """The same engine over what was there and valid at a date."""
        t = self.spark.range(1).select(T.parse_date(F.lit(date))).first()[0]
        if t is None:
            raise ValueError(f"no date: {date}")
        moment = F.lit(t)
        return Engine(self.spark, self.entities.where(F.col("created_at") <= moment), self.relationships.where(D.valid_at(moment)), self.embed, self.extract, self.strategies)

    def what_changed(self, start: str, end: str) -> DataFrame:
        return D.what_changed(self.entities, self.relationships, start, end)

    def communities(self, algorithm: str = "louvain") -> DataFrame:
        return G.communities(self.relationships.select("source_id", "target_id", F.lit(1.0).alias("weight")), algorithm)
