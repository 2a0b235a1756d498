"""Operators that SQL can't follow on whole tables, against brute force on small ones."""

import itertools
import random

import pytest
from pyspark.sql import functions as F

from chronoloom.operators import graph as G
from chronoloom.operators import multigraph as MG
from chronoloom.operators import notes as N
from chronoloom.operators import temporal as D


def test_note_links_are_the_ten_best(spark):
    r = random.Random(1)
    common, rare = ["alpha", "beta", "gamma"], [f"w{i}" for i in range(30)]
    rows = [(f"n{i:03d}", r.sample(common, r.randrange(4)) + r.sample(rare, r.randrange(4)), "x") for i in range(150)]
    rows += [(f"c{i:02d}", ["alpha", "beta", "same"], "x") for i in range(25)] + [("none", None, "x"), ("short", ["alpha"], "x"), (None, ["alpha", "beta"], "x")]
    got = {}
    for x in N.keyword_links(spark.createDataFrame(rows, "id string, keywords array<string>, score string")).collect():
        got.setdefault(x["a"], []).append((x["b"], round(x["score"], 9)))
    for a, ka, _ in rows:
        best = []
        for b, kb, _ in rows:
            if a and b and a != b and ka and kb and len(set(ka) & set(kb)) >= 2:
                best.append((-round(len(set(ka) & set(kb)) / len(set(ka) | set(kb)), 9), b))
        assert sorted((-s, b) for b, s in got.get(a, [])) == sorted(best)[:10]
    assert N.keyword_links(spark.createDataFrame([], "id string, keywords array<string>")).count() == 0


def test_pagerank_with_dangling_nodes(spark):
    edges = [("a", "b", 1.0), ("b", "c", 2.0), ("b", "a", 1.0), ("c", "d", 1.0), ("e", "a", 1.0)]
    p = {"a": 0.5, "c": 0.5}
    ids = sorted({x for e in edges for x in e[:2]})
    out = {i: sum(w for a, _, w in edges if a == i) for i in ids}
    s = {i: p.get(i, 0.0) for i in ids}
    for _ in range(12):
        lost = sum(s[i] for i in ids if not out[i])
        s = {i: 0.85 * sum(w / out[a] * s[a] for a, b, w in edges if b == i) + (0.15 + 0.85 * lost) * p.get(i, 0.0) for i in ids}
    e, seeds = spark.createDataFrame(edges, "a string, b string, w double"), spark.createDataFrame(list(p.items()), "id string, p double")
    got = {r["id"]: r["score"] for r in G.pagerank(e, seeds, rounds=12).collect()}
    assert all(abs(got[i] - s[i]) < 1e-12 for i in ids) and abs(sum(got.values()) - 1) < 1e-12


def _q(rows, home):
    total = sum(w for *_, w in rows)
    k, inside = {}, {}
    for a, b, w in rows:
        for x in (a, b):
            k[home[x]] = k.get(home[x], 0) + w
        if home[a] == home[b]:
            inside[home[a]] = inside.get(home[a], 0) + w
    return sum(inside.get(c, 0) / total - (m / (2 * total)) ** 2 for c, m in k.items())


@pytest.mark.parametrize("algorithm", ["louvain", "leiden"])
def test_giant_components_reach_the_modularity_of_the_kernel(spark, algorithm):
    r = random.Random(7)
    rows = [(f"{g}.{a}", f"{g}.{b}", 1.0) for g in range(5) for a, b in itertools.combinations(range(7), 2) if r.random() < 0.8]
    rows += [(f"{g}.{r.randrange(7)}", f"{(g + 1) % 5}.{r.randrange(7)}", 1.0) for g in range(5) for _ in range(2)]
    df = spark.createDataFrame(rows, "source_id string, target_id string, weight double")
    found = []
    for giant in (200_000, 3):
        got = G.communities(df, algorithm, giant=giant).collect()
        top = {x["id"]: max((y["level"], y["community"]) for y in got if y["id"] == x["id"])[1] for x in got}
        assert all(min(i for i in top if top[i] == c) == c for c in set(top.values()))
        found.append(_q(rows, top))
    assert found[1] > found[0] - 0.01


def test_temporal_edges_look_as_far_as_the_item_is_valid(spark):
    rows = [("a", 0, None), ("b", 5, 90), ("c", 40, None), ("d", 80, None), ("e", -3, 2), ("f", None, 1)]
    day = 86400
    df = spark.createDataFrame([(i, None if s is None else s * day, None if u is None else u * day, n) for n, (i, s, u) in enumerate(rows)], "id string, s bigint, u bigint, seq int")
    df = df.select("id", F.timestamp_seconds("s").alias("at"), F.timestamp_seconds("u").alias("until"), "seq")
    got = {(r["a"], r["b"]) for r in D.temporal_edges(df, 7).collect()}
    assert got == {("b", "a"), ("e", "a")}
    later = {(r["a"], r["b"]) for r in D.temporal_edges(df.withColumn("seq", -F.col("seq")), 7).collect()}
    assert later == {("a", "b"), ("a", "e"), ("b", "c"), ("b", "d")}


def test_every_pair_of_a_long_item(spark):
    df = spark.createDataFrame([("i", [f"e{i:02d}" for i in range(40)] + [None, "e00"]), ("j", ["e00", "e01"]), ("k", None), ("l", [])], "id string, entity_ids array<string>")
    got = {(r["a"], r["b"]): r["weight"] for r in MG.entity_edges(df).collect()}
    assert len(got) == 40 * 39 // 2 and got["e00", "e01"] == 1.0 and got["e01", "e39"] == 0.5
