"""Upkeep: replacing, removing, caching, eviction, clocks, rules and bounded traversal on odd input."""

from pyspark.sql import functions as F

from chronoloom.operators import retrieval as R
from chronoloom.operators import upkeep as U

DOCS = "id int, text string, dl int, term string"


def test_index_follows_its_documents(spark):
    rows = [(1, "graph memory graph", 9, "x"), (2, "memory", 9, "x"), (3, "", 9, "x"), (4, None, 9, "x"), (None, "graph", 9, "x"), (2, "memory", 9, "x")]
    d = spark.createDataFrame(rows, DOCS)
    index = U.index_add(None, d, "id", "text")
    whole = R.bm25(d.where("id IS NOT NULL").dropDuplicates(), "id", "text", ["graph", "memory"], 10).collect()
    assert [(r["id"], round(r["score"], 9)) for r in U.index_search(index, "id", ["graph", "memory"], 10).collect()] == [(r["id"], round(r["score"], 9)) for r in whole]
    index = U.index_add(index, spark.createDataFrame([(1, "evidence", 0, ""), (2, None, 0, "")], DOCS), "id", "text")
    assert {r["term"]: r["df"] for r in U.index_terms(index, "id").collect()} == {"evidence": 1}
    assert U.index_search(U.index_remove(index, d, "id"), "id", ["evidence"], 5).count() == 0
    assert U.index_search(index, "id", [], 5).count() == 0


def test_embeddings_are_computed_once(spark):
    first = spark.createDataFrame([(1, "a"), (2, "a"), (3, None)], "id int, text string")
    rows, cache = U.embedded(first, "text", None)
    assert cache.count() == 1 and rows.where("vector IS NULL").count() == 1
    marked = lambda c: F.array(F.lit(7.0))
    rows, cache = U.embedded(spark.createDataFrame([(4, "a"), (5, "b")], "id int, text string"), "text", cache, marked)
    assert cache.count() == 2 and {r["id"] for r in rows.where(F.element_at("vector", 1) == 7.0).collect()} == {5}


def test_eviction_clocks_and_rules(spark):
    c = spark.createDataFrame([("a", 1), ("b", 2), ("c", 2), ("d", None)], "id string, s bigint").select("id", F.timestamp_seconds("s").alias("at"))
    assert sorted(r["id"] for r in U.evict(c, "at", F.timestamp_seconds(F.lit(3)), 2).collect()) == ["b", "c"]
    assert U.evict(c, "at", F.timestamp_seconds(F.lit(9000)), 5, F.lit(1)).count() == 0
    x = spark.createDataFrame([(1, 5, 2, 0), (2, 1, 2, 2), (2, 3, 2, 3), (2, None, 2, 4)], "w int, c int, w2 int, c2 int")
    assert [r[0] for r in x.select(U.happened_before(F.col("w"), F.col("c"), F.col("w2"), F.col("c2"))).collect()] == [True, True, False, None]
    rules = spark.createDataFrame([("r", "Always CHECK the office"), ("s", None)], "id string, pattern string")
    assert [r["id"] for r in U.applicable_rules(rules, "fic zzz").collect()] == ["r"] and U.applicable_rules(rules, " ").count() == 0


def test_best_first_is_the_best_of_all(spark):
    edges = [("a", "b", 0.9), ("b", "c", 0.9), ("a", "d", 0.1), ("d", "e", 1.0), ("c", "a", 1.0), ("x", "y", 1.0)]
    df = spark.createDataFrame(edges, "a string, b string, weight double")
    got = {r["id"]: round(r["score"], 9) for r in U.best_first(df, spark.createDataFrame([("a", 1.0)], "id string, score double"), 4).collect()}
    assert got == {"a": 1.0, "b": 0.9, "c": 0.81, "d": 0.1}
    assert U.best_first(df, spark.createDataFrame([], "id string, score double"), 4).count() == 0


def test_recipes_name_what_they_lack(spark):
    import pytest

    rows = spark.createDataFrame([("a", "graph"), ("b", None)], "id string, text string")
    for name, lacks in (("graph_aware_ppr", "relationship"), ("neighborhood_search", "center"), ("entity_hybrid_episode_mentions", "mentions"), ("drift_adaptive", "community")):
        with pytest.raises(ValueError, match=lacks):
            R.run_recipe(R.RECIPES[name], {"entity": rows}, "graph")


def test_pagerank_channel_brings_in_what_text_does_not(spark):
    rows = spark.createDataFrame([("a", "alpha"), ("b", "zzz"), ("c", "yyy")], "id string, text string")
    edges = spark.createDataFrame([("e1", "a", "b", 1.0)], "id string, source_id string, target_id string, weight double")
    found, stages = R.hybrid(rows, edges, "alpha", 2, ["a"], rerank=False)
    assert {r["stage"]: r["n"] for r in stages.collect()} == {"semantic": 3, "keyword": 1, "ppr": 3, "traversal": 1}
    top = {r["id"]: r["sources"] for r in found.collect()}
    assert top == {"a": "keyword,ppr,semantic", "b": "ppr,semantic,traversal"}  # c lacks an edge
    none, stages = R.hybrid(rows, edges.limit(0), "of", 2)
    assert {r["stage"]: r["n"] for r in stages.collect()} == {"semantic": 3, "keyword": 0, "ppr": 0, "traversal": 0}
