"""Mixing: shares, caps, order, inversion of schedules, odd input."""

import pytest

from chronoloom.llm.mixing import cumulative, invert, mix, plan_shares, shares, sized
from pyspark.sql import functions as F


def tables(spark):
    docs = [(i, f"text number {i} " * (1 + i % 7), s, 1.0, 1) for i, s in enumerate(["big"] * 300 + ["small"] * 20 + [None] * 5 + ["extra"] * 5)]
    docs += [(900, None, "big", 1.0, 1), (901, "", "small", 1.0, 1)]
    targets = [("big", 0.6, 1), ("small", 0.3, 3), ("absent", 0.1, 2)]
    return spark.createDataFrame(docs, "doc_id bigint, text string, source string, position double, tokens int"), spark.createDataFrame(targets, "source string, target_share double, max_repeats int")


def test_shares_and_caps(spark):
    d, t = tables(spark)
    got = {r["source"]: r for r in shares(d, t).collect()}
    assert abs(got["big"]["actual_share"] - 2 / 3) < 0.02 and abs(got["small"]["actual_share"] - 1 / 3) < 0.02
    assert got["absent"]["tokens"] == 0 and got["small"]["most_repeats"] == 3 and got["big"]["most_repeats"] == 1
    rows = mix(d, t).collect()
    assert [r["position"] for r in rows] == sorted(r["position"] for r in rows)
    uses = {}
    for r in rows:
        uses[r["source"], r["doc_id"]] = uses.get((r["source"], r["doc_id"]), 0) + 1
    assert max(n for (s, _), n in uses.items() if s == "small") <= 3 and max(n for (s, _), n in uses.items() if s == "big") == 1
    assert {s for s, _ in uses} == {"big", "small"}


def test_a_budget_beyond_the_caps_is_spread(spark):
    d, t = tables(spark)
    plan = {p["source"]: p for p in plan_shares(sized(d), t, budget=10**9)}
    assert plan["small"]["demand"] == 3 * plan["small"]["have"] and plan["big"]["demand"] == plan["big"]["have"]


def test_curriculum(spark):
    d, t = tables(spark)
    rows = mix(d, t, {"small": (0.0, 2.0)}).collect()
    early = sum(r["tokens"] for r in rows if r["source"] == "small" and r["position"] < 0.5)
    total = sum(r["tokens"] for r in rows if r["source"] == "small")
    assert abs(early / total - 0.25) < 0.05


@pytest.mark.parametrize("schedule", [(1.0, 1.0), (0.5, 1.5), (2.0, 0.0), (1.0, 0.0, 3.0), (0.0, 1.0, 0.0)])
def test_inverse(spark, schedule):
    at = cumulative(schedule)
    n = len(schedule) - 1
    total = sum((a + b) / 2 for a, b in zip(schedule, schedule[1:]))
    for u, t in spark.range(1, 100).select((F.col("id") / 100.0).alias("u")).select("u", invert(F.col("u"), schedule)).collect():
        i = min(int(t * n), n - 1)
        x = t * n - i
        assert abs(at[i] + (schedule[i] * x + (schedule[i + 1] - schedule[i]) * x * x / 2) / total - u) < 1e-9


def test_empty(spark):
    d, t = tables(spark)
    assert mix(d.where("doc_id < 0"), t).count() == 0 and mix(d, t.where("source = 'q'")).count() == 0
    with pytest.raises(ValueError):
        cumulative((0.0, 0.0))


def test_shares_with_a_binding_cap_and_a_budget(spark, monkeypatch):
    """The capped source gives all it may, the rest of the budget is met to half a document, whatever the buckets."""
    from chronoloom.llm import mixing

    d, t = tables(spark)
    plan = {p["source"]: p for p in plan_shares(sized(d), t)}
    budget = plan["small"]["have"] * 3 + plan["big"]["have"] // 2  # more than the caps allow at exact shares
    seen = []
    for bucket in (100_000, 3):
        monkeypatch.setattr(mixing, "BUCKET", bucket)
        got = {r["source"]: r for r in mixing.shares(d, t, budget=budget).collect()}
        assert got["small"]["most_repeats"] <= 3 and abs(got["small"]["tokens"] - 3 * plan["small"]["have"]) <= 60
        assert abs(sum(r["tokens"] for r in got.values()) - budget) <= 60 * len(got)
        assert abs(sum(r["actual_share"] for r in got.values()) - 1) < 1e-9
        seen.append({k: r["available_tokens"] for k, r in got.items()})
    assert seen[0] == seen[1]
