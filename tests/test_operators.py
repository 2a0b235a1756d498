"""Reference operators: fixtures by hand and invariants."""

import pytest
from pyspark.sql import functions as F

from chronoloom.functions import text as T
from chronoloom.functions import vectors as V
from chronoloom.operators import branches as B
from chronoloom.operators import extraction as X
from chronoloom.operators import graph as G
from chronoloom.operators import ingest as I
from chronoloom.operators import memory as M
from chronoloom.operators import retrieval as R
from chronoloom.operators import routing as Q
from chronoloom.operators import store as S
from chronoloom.operators import temporal as D
from chronoloom.operators import views


def one(spark, column):
    return spark.range(1).select(column.alias("x")).first()[0]


def test_tokens_and_names(spark):
    assert one(spark, T.bm25_tokens(F.lit("The quick brown fox's den, a B"))) == ["quick", "brown", "fox's", "den"]
    assert one(spark, T.normalize_name(F.lit("  Foo_Bar-Baz  "))) == "foo bar baz"
    assert one(spark, T.jaccard(F.array(), F.array())) == 1.0
    assert one(spark, T.extract_doi(F.lit("see 10.1000/ab.c, p. 3"))) == "10.1000/ab.c"


def test_vectors(spark):
    a = lambda *x: F.array(*[F.lit(float(i)) for i in x])
    assert one(spark, V.cosine(a(1, 0), a(1, 0, 0))) == 0.0
    assert one(spark, V.cosine_or_null(a(1, 0), a(1, 0, 0))) is None
    assert one(spark, V.cosine(a(0, 0), a(1, 0))) == 0.0
    assert one(spark, V.align(a(1, 2, 3), 2)) == [1.0, 2.0]
    assert abs(sum(x * x for x in one(spark, V.hash_embedding_wide(F.lit("x"), 48))) - 1) < 1e-9


def edges(spark, pairs):
    return spark.createDataFrame([(a, b, 1.0) for a, b in pairs], "source_id string, target_id string, weight double")


CLIQUES = [(f"{c}{i}", f"{c}{j}") for c in "ab" for i in range(5) for j in range(i)] + [("a0", "b0")]


@pytest.mark.parametrize("algorithm", ["louvain", "leiden"])
def test_communities_of_cliques(spark, algorithm):
    got = G.communities(edges(spark, CLIQUES), algorithm).where("level = 0").collect()
    by = {}
    for r in got:
        by.setdefault(r["community"], set()).add(r["id"])
    assert sorted(map(sorted, by.values())) == [[f"a{i}" for i in range(5)], [f"b{i}" for i in range(5)]]
    m = spark.createDataFrame([(r["id"], r["community"]) for r in got], "id string, community string")
    assert G.modularity(edges(spark, CLIQUES), m).first()[0] > 0.4


def test_giant_components_take_the_distributed_way(spark):
    got = {r["id"]: r["community"] for r in G.communities(edges(spark, CLIQUES), giant=3).collect()}
    assert len(got) == 10 and len({got[f"a{i}"] for i in range(1, 5)}) == 1


def test_pagerank_sums_to_one_and_prefers_the_seed(spark):
    e = edges(spark, CLIQUES).select(F.col("source_id").alias("a"), F.col("target_id").alias("b"), F.col("weight").alias("w"))
    got = {r["id"]: r["score"] for r in G.pagerank(e, spark.createDataFrame([("a4", 1.0)], "id string, p double"), rounds=30, epsilon=1e-6).collect()}
    assert abs(sum(got.values()) - 1) < 1e-6 and max(got, key=got.get) == "a4"


def test_components_and_paths(spark):
    both = views.both_ways(edges(spark, [("a", "b"), ("b", "c"), ("x", "y"), ("z", "z")]))
    assert {r[0]: r[1] for r in G.components(both).collect()} == {"a": "a", "b": "a", "c": "a", "x": "x", "y": "x"}
    assert G.shortest_path(both, "a", "c").collect()[0]["path"] == "a>b>c"
    assert G.shortest_path(both, "a", "x").count() == 0
    assert {r[0]: r[1] for r in G.hop_distances(both, "a", 1).collect()} == {"a": 0, "b": 1}


def test_mmr_prefers_difference(spark):
    c = spark.createDataFrame([(1, [1.0, 0.0]), (2, [0.999, 0.01]), (3, [0.6, 0.8])], "id int, v array<double>")
    assert [r["id"] for r in R.mmr(c, [1.0, 0.0], 2, 0.3).orderBy("pick").collect()] == [1, 3]


def test_bm25_repeated_terms_and_empty(spark):
    d = spark.createDataFrame([(1, "memory graph"), (2, "graph"), (3, None), (4, "")], "id int, text string")
    once, twice = ({r[0]: r[1] for r in R.bm25(d, "id", "text", q).collect()} for q in (["memory"], ["memory", "memory"]))
    assert set(once) == {1} and abs(twice[1] - 2 * once[1]) < 1e-12
    assert R.bm25(d.where("id > 9"), "id", "text", ["memory"]).count() == 0


def test_neighbours_in_blocks(spark, monkeypatch):
    d = spark.createDataFrame([(i, [1.0, i / 10]) for i in range(12)], "id int, v array<double>")
    whole = sorted(map(tuple, R.neighbours_of(d, d.where("id < 6"), "id", "v", 0.0, 3).select("query", "other").collect()))
    monkeypatch.setattr(R, "BLOCK", 2)
    assert sorted(map(tuple, R.neighbours_of(d, d.where("id < 6"), "id", "v", 0.0, 3).select("query", "other").collect())) == whole
    assert len(whole) == 18


def test_allen_and_validity(spark):
    t = lambda s: D.ts(f"2020-01-{s:02d}")
    rel = lambda *x: one(spark, D.allen(*[F.lit(None).cast("timestamp") if i is None else t(i) for i in x]))
    assert [rel(1, 3, 3, 5), rel(1, 3, 1, 5), rel(2, 5, 1, 5), rel(2, 3, 1, 5), rel(1, 3, 2, 5), rel(1, 2, 3, 5), rel(6, None, 1, 5)] == ["meets", "starts", "finishes", "during", "overlaps", "before", "after"]
    with pytest.raises(ValueError):
        D.what_changed(None, None, "2021-01-01", "2020-01-01")


def test_conflicts_enhanced(spark):
    s = "id string, source_id string, target_id string, relationship_type string, fact_embedding array<double>"
    old = spark.createDataFrame([("o1", "a", "x", "LIVES_IN", [1.0, 0.0]), ("o2", "a", "x", "KNOWS", [1.0, 0.0])], s)
    new = spark.createDataFrame([("n1", "a", "y", "LIVES_IN", [0.8, 0.6]), ("n2", "a", "y", "LIVES_IN", [0.0, 1.0]), ("n3", "a", "x", "LIVES_IN", None), ("n4", "a", "y", "KNOWS", [0.8, 0.6]), ("n5", "a", "y", "KNOWS", None)], s)
    got = {r["new_id"]: r["conflict"] for r in I.detect_conflicts(new, old, "enhanced").collect()}
    assert got == {"n1": "supersession", "n2": "contradiction", "n3": "redundant", "n4": "soft_conflict", "n5": "none"}


def test_branches(spark):
    b = spark.createDataFrame([("main", None, "open"), ("x", "main", "open")], "branch string, parent string, status string")
    log = spark.createDataFrame([("main", 1, "add", "entity", "e1"), ("x", 2, "remove", "entity", "e1"), ("x", 3, "add", "entity", "e2"), ("x", 4, "remove", "entity", "e2"), ("x", 5, "add", "entity", "e3")], "branch string, seq int, op string, kind string, id string")
    base = spark.createDataFrame([("e0",)], "id string")
    assert sorted(r[0] for r in B.visible(log, b, "x", base).collect()) == ["e0", "e3"]
    assert sorted(r[0] for r in B.visible(log, b, "main", base).collect()) == ["e0", "e1"]
    merged = B.merge(log, "x", "main")
    assert sorted(r[0] for r in B.visible(merged, b, "main", base).collect()) == ["e0", "e3"]
    with pytest.raises(ValueError):
        B.create(b, "y", "nowhere")
    with pytest.raises(ValueError):
        B.abandon(b, "main")


def test_store_in_parquet(spark, tmp_path):
    st = S.GraphStore(spark, str(tmp_path / "store"))
    e = spark.createDataFrame([("1", "a", "g"), ("2", "b", "g")], "id string, name string, group_id string")
    st.put("entities", e)
    st.put("entities", spark.createDataFrame([("2", "c", "h")], "id string, name string, group_id string"))
    assert {r["id"]: r["name"] for r in st.table("entities").collect()} == {"1": "a", "2": "c"}
    st.put("relationships", spark.createDataFrame([("r", "1", "2", "g")], "id string, source_id string, target_id string, group_id string"))
    st.delete_entities(spark.createDataFrame([("2",)], "id string"))
    assert {r["kind"]: r["n"] for r in st.stats().collect()} == {"entities": 1, "relationships": 0}
    with pytest.raises(S.NotFound):
        S.get(st.table("entities"), "9")
    st.clear()
    assert st.table("entities") is None


def test_memory(spark):
    q = spark.createDataFrame([("s", 1, True, 1.0), ("s", 2, False, 0.0)], "state string, seq int, keep boolean, reward double")
    r = M.learn(q).first()
    assert abs(r["q_keep"] - 0.595) < 1e-9 and r["q_forget"] < 0.55
    items = spark.createDataFrame([("a", [1.0, 0.0], 0.9, "g"), ("b", [1.0, 0.001], 0.5, "g"), ("c", [0.0, 1.0], 0.1, "g")], "id string, v array<double>, importance double, grp string")
    assert [tuple(x) for x in M.consolidate(items, "grp").collect()] == [("b", "a")]
    k = spark.createDataFrame([("g", 1, 60, 3.0), ("g", 2, 60, 2.0), ("g", 3, 30, 1.0)], "grp string, id int, size int, score double")
    assert sorted(r["id"] for r in M.knapsack(k, "grp", 100).collect()) == [1, 3]


def test_extraction(spark):
    assert X.split_sentences("Dr. Who met Prof. Ann today. Then he left! ok") == ["Dr. Who met Prof. Ann today.", "Then he left!", "ok"]
    names = X.recognise("Alice Smith joined Acme Labs on March 3, 2024.")
    # earlier patterns win, as two capitalised words do over an ending; overlaps of later ones are dropped
    assert sorted((n, t) for n, t, *_ in names) == [("Acme Labs", "Person"), ("Alice Smith", "Person"), ("March 3, 2024", "Date")]
    kinds = {(n, t, c) for n, t, _, _, c in X.recognise("ACME Labs asked OpenAI in Berlin about BERT on 2024-03-01")}
    assert kinds == {("ACME", "Organization", 0.8), ("OpenAI", "Organization", 0.95), ("Berlin", "Location", 0.9), ("BERT", "Technology", 0.9), ("2024-03-01", "Date", 0.85)}
    e, r = X.walk_json('{"name": "Acme", "type": "Company", "boss": "Ann", "staff": [{"name": "Bob"}]}')
    assert ("Acme", "Company") in e and ("Acme", "BOSS", "Ann") in r and ("Acme", "HAS_MEMBER", "Bob") in r
    assert X.walk_json("{broken") == ([], [])
    d = spark.createDataFrame([(1, None), (2, ""), (3, "x" * 20)], "id int, text string")
    assert [r["error"] for r in X.extract_entities(d, "id", "text", 10).collect()] == ["input too large"]


def test_routing(spark):
    assert one(spark, Q.query_type(F.lit("What happened before 2020"))) == "temporal"
    assert one(spark, Q.intent(F.lit("zzz"))) == "exploratory"
    assert one(spark, Q.judge(F.lit("I don't know"), F.lit(""))) is True
    assert len(Q.ABLATIONS) == 9


def test_projection_index(spark):
    import numpy as np

    from chronoloom.operators.ann import ProjectionIndex

    r = np.random.default_rng(0)
    centres = r.standard_normal((20, 16))
    rows = [(i, (centres[i % 20] + 0.2 * r.standard_normal(16)).tolist()) for i in range(600)]
    d = spark.createDataFrame([*rows, (900, None), (901, [1.0]), (902, [0.0] * 16)], "id int, v array<double>")
    index = ProjectionIndex(16)
    table = index.build(d, "id", "v")
    assert table.count() == 600
    x = np.array([v for _, v in rows])
    want = set(np.argsort(-(x @ x[0]) / np.linalg.norm(x, axis=1))[:10].tolist())
    got = {row["id"] for row in index.search(table, rows[0][1], 10).collect()}
    assert len(got & want) >= 9
    smaller = index.remove(table, d.where("id = 0"))
    assert 0 not in {row["id"] for row in index.search(smaller, rows[0][1], 10).collect()}
    assert index.add(smaller, d.where("id IN (0, 1)"), "id", "v").count() == 600


def test_chunkers(spark):
    d = spark.createDataFrame([(1, "Introduction\n" + "One two three four five. " * 60 + "\n\n" + "Six seven eight nine. " * 5), (2, None), (3, "word " * 700), (4, "")], "id int, text string")
    got = X.chunk_sections(d, "id", "text", 100).collect()
    assert all(r["words"] <= 100 for r in got) and {r["id"] for r in got} == {1, 3}
    assert all(r["piece"].startswith("One two three four five.") for r in got if r["id"] == 1 and 0 < r["chunk"] < 3)
    pieces = [r["piece"] for r in X.chunk_sentences(d.where("id = 1"), "id", "text", 16).collect()]
    assert all(len(p.encode()) <= 64 for p in pieces)


def test_agent(spark, tmp_path):
    from chronoloom.operators import agent as A

    A.save_history(spark, [("user", "a"), ("assistant", "b")], str(tmp_path / "h"))
    assert A.load_history(spark, str(tmp_path / "h")) == [("user", "a"), ("assistant", "b")]
    messages = A.prompt("q?", ["c"], [("user", str(i)) for i in range(9)])
    assert len(messages) == 7 and messages[-1]["content"].endswith("q?")
    both = views.both_ways(edges(spark, [("a", "b"), ("b", "c"), ("c", "d"), ("b", "x")]))
    assert {r["id"] for r in A.find_connections(both, "a", "c", 2).collect()} == {"a", "b", "c"}
