"""Four views over memory items (semantic, temporal, causal, entity), their selection and fusion."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from chronoloom.operators import extraction as X
from chronoloom.operators import routing as R

#: How much each view counts for an intent.
VIEW_WEIGHTS = {
    "factual": {"entity": 0.5, "semantic": 0.4, "temporal": 0.1}, "temporal": {"temporal": 0.6, "semantic": 0.2, "entity": 0.2}, "causal": {"causal": 0.5, "entity": 0.3, "temporal": 0.2},
    "hypothetical": {"causal": 0.4, "entity": 0.3, "semantic": 0.2, "temporal": 0.1}, "comparative": {"entity": 0.4, "semantic": 0.4, "temporal": 0.2}, "aggregative": {"entity": 0.5, "semantic": 0.3, "temporal": 0.2},
    "multihop": {"entity": 0.4, "causal": 0.35, "semantic": 0.25}, "exploratory": {"semantic": 0.3, "entity": 0.3, "temporal": 0.2, "causal": 0.2},
}


def view_weight(intent: Column, view: str) -> Column:
    table = F.create_map(*[x for k, v in VIEW_WEIGHTS.items() for x in (F.lit(k), F.lit(v.get(view, 0.0)))])
    return F.element_at(table, intent)


def fuse(lists: dict[str, DataFrame], weights: dict[str, float], k: int = 60) -> DataFrame:
    """id, score, views: sum of weight / (k + rank + 1), times 1.3 for each view beyond the first."""
    parts = None
    for view, df in lists.items():
        ranked = df.select("id", F.lit(view).alias("view"), (F.row_number().over(Window.orderBy(F.desc("score"), "id")) - 1).alias("rank"), F.lit(weights.get(view, 0.1)).alias("w"))  # bounded lists
        parts = ranked if parts is None else parts.unionByName(ranked)
    g = parts.groupBy("id").agg(F.sum(F.col("w") / (F.lit(float(k + 1)) + F.col("rank"))).alias("s"), F.count_distinct("view").alias("views"))
    return g.select("id", (F.col("s") * F.pow(F.lit(1.3), F.col("views") - 1)).alias("score"), "views")


def entity_edges(items: DataFrame) -> DataFrame:
    """a, b, weight: entities named in one item, with the number of items they share x 0.5; every pair counts.

    The pairs of an item come out of its own row, entity by entity, so that an item with many is many small rows.
    """
    e = items.select("id", F.array_sort(F.array_distinct(F.filter("entity_ids", lambda x: x.isNotNull()))).alias("e")).where("size(e) > 1")
    one = e.select("e", F.posexplode("e").alias("i", "a")).where("i + 1 < size(e)")
    rows = one.select("a", F.explode(F.expr("slice(e, i + 2, size(e))")).alias("b"))
    return rows.groupBy("a", "b").agg((F.count(F.lit(1)) * 0.5).alias("weight"))


def causal_edges(items: DataFrame, least: float = 0.6) -> DataFrame:
    """cause, effect, confidence between the first two entities of items whose text states a cause."""
    rows = items.where("size(entity_ids) >= 2").select("entity_ids", F.explode(X.causal_pairs(F.col("content"))).alias("c")).where(F.col("c.confidence") >= least)
    return rows.groupBy(F.element_at("entity_ids", 1).alias("cause"), F.element_at("entity_ids", 2).alias("effect")).agg(F.max("c.confidence").alias("confidence"))


def temporal_view(items: DataFrame, at: Column, k: int) -> DataFrame:
    """id, score: items valid at a time (half-open) by recency 1 / (1 + days / 30)."""
    days = F.floor((F.unix_seconds(at) - F.unix_seconds("valid_from")) / 86400)
    ok = (F.col("valid_from") <= at) & (F.col("valid_until").isNull() | (at < F.col("valid_until")))
    return items.where(ok).select("id", (1.0 / (1.0 + days / 30.0)).alias("score")).orderBy(F.desc("score"), "id").limit(k)


def stats(views: dict[str, DataFrame]) -> DataFrame:
    """view, edges."""
    out = None
    for name, df in views.items():
        part = df.agg(F.count(F.lit(1)).alias("edges")).select(F.lit(name).alias("view"), "edges")
        out = part if out is None else out.unionByName(part)
    return out


def plan(query: Column) -> Column:
    """The views of a query's intent, heaviest first, as text; semantic always takes part."""
    i = R.intent(query)
    table = F.create_map(*[x for k, v in VIEW_WEIGHTS.items() for x in (F.lit(k), F.lit(",".join([*sorted(v, key=lambda n: (-v[n], n)), *([] if "semantic" in v else ["semantic"])])))])
    return F.element_at(table, i)
