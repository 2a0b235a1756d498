"""Whole results: queries and operators against brute force."""

import numpy as np

from chronoloom.operators import memory as M
from chronoloom.plans import all_queries
from chronoloom.tables import load


def greedy(items, threshold):
    """id -> into of (id, v, importance), one after the other."""
    kept, out = [], {}
    for id_, v, _ in sorted(items, key=lambda x: (x[2] is None, -(x[2] or 0), x[0])):
        if v is None or not len(v) or not np.isfinite(np.array(v, float)).all() or not np.any(v):
            continue
        v = np.array(v, float)
        v /= np.linalg.norm(v)
        near = [(round(float(u @ v), 12), k) for k, u in kept if len(u) == len(v) and u @ v > threshold]
        if near:
            best = max(c for c, _ in near)
            out[id_] = next(k for c, k in near if c == best)
        else:
            kept.append((id_, v))
    return out


def test_consolidate(spark):
    rng = np.random.default_rng(5)
    centres = rng.standard_normal((6, 8))
    rows = [(f"i{n:03d}", (centres[n % 6] + 0.35 * rng.standard_normal(8)).tolist(), None if n % 17 == 0 else float(rng.integers(0, 9)) / 8) for n in range(200)]
    rows += [(f"j{n}", rows[n][1], 0.01 * n) for n in range(40)]  # copies
    rows += [("k1", [1.0, 2.0], 0.5), ("k2", [2.0, 4.0], 0.4), ("n0", None, 1.0), ("n1", [0.0] * 8, 1.0), ("n2", [float("nan")] * 8, 1.0), ("n3", [], 1.0)]
    df = spark.createDataFrame(rows, "id string, v array<double>, importance double")
    got = {r["id"]: r["into"] for r in M.consolidate(df, threshold=0.9).collect()}
    assert got == greedy(rows, 0.9) and got["k2"] == "k1" and len(got) > 60
    assert {(r["id"], r["into"]) for r in M.consolidate(df.selectExpr("*", "'g' as g"), "g", 0.9).collect()} == set(got.items())


def test_cosine_consolidate(spark, sf):
    rows = [tuple(r) for r in load(spark, sf, "memory_items").dropDuplicates(["id"]).select("id", "embedding", "importance").collect()]
    got = {r["id"]: r["into"] for r in all_queries()["cosine_consolidate"](spark, sf).collect()}
    assert got == greedy(rows, 0.9)


def test_near_pairs_of_many_blocks(spark):
    x = np.random.default_rng(6).standard_normal((300, 4))
    df = spark.createDataFrame([(n, "", v.tolist()) for n, v in enumerate(x)], "r long, g string, v array<double>")
    u = x / np.linalg.norm(x, axis=1)[:, None]
    want = {(a, b) for a, b in zip(*np.nonzero(u @ u.T > 0.9)) if a < b}
    assert {(r["a"], r["b"]) for r in M.near_pairs(df, 0.9, 32).collect()} == want


def test_ann_search(spark):
    d = "/root/testdata/sf0.1"
    rows = load(spark, d, "embeddings").select("vec_id", "embedding").collect()
    ids, x = np.array([r[0] for r in rows]), np.array([r[1] for r in rows], float)
    x /= np.linalg.norm(x, axis=1)[:, None]
    got = {}
    for r in all_queries()["ann_search"](spark, d).collect():
        got.setdefault(r["query"], set()).add(r["id"])
    asked = sorted(int(i) for i in ids if i % 100 == 0)
    assert sorted(got) == asked
    want = {q: set(ids[np.argsort(-(x @ x[ids == q][0]), kind="stable")[:10]].tolist()) for q in asked}
    recall = sum(len(got[q] & want[q]) for q in asked) / (10 * len(asked))
    print("recall", recall)
    assert recall >= 0.9
