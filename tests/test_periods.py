"""Intervals and histories against brute force, with nulls, ties, repeats, empty tables and clashing names."""

import random
from datetime import datetime, timedelta, timezone

import pytest
from pyspark.sql import functions as F

from chronoloom.operators.history import ChainStore, reports, state_history
from chronoloom.operators.intervals import OPEN_US, periods_and_gaps
from chronoloom.session import shared_path

T0 = datetime(2020, 1, 1, tzinfo=timezone.utc)
SCHEMA = "relationship_id string, valid_from timestamp, valid_until timestamp, created_at timestamp, version int, fact string, k int, s string, e string, b double, kind string"


def at(seconds):
    return None if seconds is None else T0 + timedelta(seconds=seconds)


def us(x):
    return int(x.timestamp()) * 1_000_000


def frame(spark, rows):
    return spark.createDataFrame([(k, at(a), at(b), at(c), v, f, 1, "x", "y", 0.5, "z") for k, a, b, c, v, f in rows], SCHEMA)


def random_rows(seed, n=400):
    r = random.Random(seed)
    rows = []
    for _ in range(n):
        k = "hot" if r.random() < 0.4 else f"r{r.randrange(12)}"
        a = r.randrange(0, 40_000_000)
        b = None if r.random() < 0.05 else a + r.choice([0, -5, 1, 60, 86400, 5_000_000])
        rows.append((k, a, b, r.randrange(0, 50_000_000), r.randrange(4), r.choice(["up", " up", "up  ", "down", "Down"])))
    rows += rows[:20]
    return rows + [(None, 1, 5, 1, 1, "up"), ("nulls", None, 5, 1, 1, "up"), ("nofact", 1, 5, 1, 1, None), ("norank", 1, 5, None, None, "up")]


def brute_periods(rows, tolerance=1):
    out = []
    for k in {r[0] for r in rows if r[0] is not None}:
        iv = sorted((a, b if b is not None else 10**12) for kk, a, b, *_ in rows if kk == k and a is not None and (b is None or b > a))
        current = None
        for a, b in iv:
            if current is None:
                current = [a, b]
            elif a - current[1] > tolerance:
                out += [(k, "period", *current), (k, "gap", current[1], a)]
                current = [a, b]
            else:
                current[1] = max(current[1], b)
        if current:
            out.append((k, "period", *current))
    return sorted(out)


def found_periods(df):
    base = us(T0)
    return sorted((r[0], r[1], (r[2] - base) // 1_000_000, 10**12 if r[3] is None else (r[3] - base) // 1_000_000) for r in df.collect())


@pytest.mark.parametrize("days", [1, 64])
def test_periods_and_gaps(spark, days):
    rows = random_rows(1)
    got = periods_and_gaps(frame(spark, rows), "relationship_id", "valid_from", "valid_until", bucket_days=days)
    assert found_periods(got) == brute_periods(rows)


def test_touching_and_one_second_holes_close(spark):
    rows = [("a", 0, 10, 0, 1, "f"), ("a", 10, 20, 0, 1, "f"), ("a", 21, 30, 0, 1, "f"), ("a", 32, 40, 0, 1, "f")]
    assert found_periods(periods_and_gaps(frame(spark, rows), "relationship_id", "valid_from", "valid_until")) == [("a", "gap", 30, 32), ("a", "period", 0, 30), ("a", "period", 32, 40)]


def test_empty_tables(spark):
    df = frame(spark, [])
    assert periods_and_gaps(df, "relationship_id", "valid_from", "valid_until").count() == 0
    assert state_history(reports(df, "relationship_id", "valid_from", "valid_until", ["created_at", "version"], "fact")).count() == 0


def brute_history(raw, tolerance=1_000_000):
    out = []
    for k in {r[0] for r in raw}:
        rs = [r for r in raw if r[0] == k]
        points = sorted({x for r in rs for x in (r[1], r[2])})
        current = None
        for p, q in zip(points, points[1:]):
            over = [r for r in rs if r[1] <= p and r[2] >= q]
            if not over:
                continue
            w = max(over, key=lambda r: (r[3], r[4], r[1]))
            if current and current[3] == w[5] and p - current[2] <= tolerance:
                current[2] = q
            else:
                if current:
                    out.append(tuple(current))
                current = [k, p, q, w[5]]
        out.append(tuple(current))
    return sorted((k, a, None if b == OPEN_US else b, v) for k, a, b, v in out)


def key(x):
    return [tuple("" if y is None else str(y) for y in r) for r in x]


@pytest.mark.parametrize("hot", [10**9, 30])
def test_history_and_hot_keys(spark, hot):
    raw = [r for r in random_rows(2) if r[5] is not None]
    unique = {}
    for r in raw:  # one report per rank, as ranks decide
        unique[(r[0], r[3], r[4])] = r
    rows = reports(frame(spark, list(unique.values())), "relationship_id", "valid_from", "valid_until", ["created_at", "version"], "fact")
    got = sorted(map(tuple, state_history(rows, hot=hot).collect()), key=str)
    assert key(got) == key(sorted(brute_history(list(set(map(tuple, rows.collect())))), key=str))


def test_changes_without_an_end(spark):
    rows = [("e", 0, None, 0, 1, "a"), ("e", 10, None, 0, 2, "b"), ("e", 10, None, 0, 3, "c"), ("e", 20, None, 0, 4, " c "), ("e", 30, None, 0, 5, "a")]
    r = reports(frame(spark, rows), "relationship_id", "valid_from", None, ["valid_from", "version"], "fact")
    got = sorted((x[3], (x[1] - us(T0)) // 10**6, x[2] and (x[2] - us(T0)) // 10**6) for x in state_history(r).collect())
    assert got == [("a", 0, 10), ("a", 30, None), ("c", 10, 30)]


def test_chain_store_replaces_touched_chains_only(spark):
    rows = [r for r in random_rows(3, 200) if r[5] is not None]
    all_ = reports(frame(spark, rows), "relationship_id", "valid_from", "valid_until", ["created_at", "version"], "fact")
    path = shared_path(spark, "test-chains")
    store = ChainStore(spark, path, buckets=4)
    first, late = all_.where("p1 % 3 != 0"), all_.where("p1 % 3 = 0")
    store.apply(first)
    before = store._manifest()
    assert sorted(map(str, store.chains().collect())) == sorted(map(str, state_history(first).collect()))
    store.apply(late.where("k = 'r1'"))
    after = ChainStore(spark, path, buckets=4)._manifest()
    assert sum(before["chains"][h] != after["chains"][h] for h in before["chains"]) <= 1
    store.apply(late.where("k != 'r1'"))
    assert sorted(map(str, store.chains().collect())) == sorted(map(str, state_history(all_).collect()))
    store.apply(late)  # a batch applied twice changes nothing
    assert sorted(map(str, store.chains().collect())) == sorted(map(str, state_history(all_).collect()))
    store.apply(late.where(F.lit(False)))
    assert store.chains().count() == state_history(all_).count()


def test_buckets_of_the_store_follow_the_first_batch(spark, tmp_path, monkeypatch):
    from chronoloom.operators import history as H

    monkeypatch.setattr(H, "BUCKET_ROWS", 5)
    rows = [(f"k{i % 40}", i, i + 5, i, 0, str(i % 3)) for i in range(400)]
    df = spark.createDataFrame(rows, H.ChainStore.RAW)
    store = H.ChainStore(spark, f"{tmp_path}/s")
    store.apply(df.where("s < 300"))
    assert store._manifest()["buckets"] == 60
    store.apply(df.where("s >= 300"))
    assert store._manifest()["buckets"] == 60
    whole = sorted(map(tuple, H.state_history(df).collect()))
    assert sorted(map(tuple, store.chains().collect())) == whole
