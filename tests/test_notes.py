"""Links of many notes with frequent words: whole, and without shuffling the pairs."""

import random

import pytest

from chronoloom.operators import notes as N


def brute(rows, least=2, most=10):
    out = set()
    for a, x in rows:
        best = sorted((-len(set(x) & set(y)) / len(set(x) | set(y)), b) for b, y in rows if b != a and len(set(x) & set(y)) >= least)
        out |= {(a, b, -s) for s, b in best[:most]}
    return out


def shuffled(spark, f):
    """f() and the bytes that it shuffled."""
    sc = spark.sparkContext._jsc.sc()
    total = lambda: (sc.listenerBus().waitUntilEmpty(30_000), sum(x.shuffleWriteBytes() for e in spark.sparkContext._jvm.scala.jdk.javaapi.CollectionConverters.asJava(sc.statusStore().executorList(False)) for x in [_Bytes(e)]))[1]
    before = total()
    return f(), total() - before


class _Bytes:
    def __init__(self, executor):
        self.shuffleWriteBytes = executor.totalShuffleWrite


@pytest.mark.parametrize("seed", range(3))
def test_links_of_frequent_words(spark, seed):
    rng = random.Random(seed)
    words = [f"w{n:03d}" for n in range(60)]
    pick = lambda: words[min(int(rng.paretovariate(0.5)) - 1, 59)]
    rows = [(f"n{i:03d}", sorted({pick() for _ in range(rng.randint(1, 12))})) for i in range(250)]
    got = {tuple(r) for r in N.keyword_links(spark.createDataFrame(rows, "id string, keywords array<string>")).collect()}
    assert got == brute(rows)


def test_growth_shuffles_no_pairs(spark):
    rows = [(f"n{i:04d}", ["asked", "review", f"a{i}", f"b{i}", f"c{i // 2}"]) for i in range(1500)]
    df = spark.createDataFrame(rows, "id string, keywords array<string>")
    got, size = shuffled(spark, lambda: {r["id"]: r["keywords"] for r in N.grow(df, N.keyword_links(df)).collect()})
    assert len(got) == 1500 and got["n0000"][-2:] == ["a1", "b1"] and size < 4_000_000, size


def test_search_asks_for_links_only_where_they_count(spark):
    rows = [(f"n{i:02d}", ["review" if i % 10 == 3 else "other", "paper", f"x{i % 7}", f"y{i % 5}"]) for i in range(40)]
    df = spark.createDataFrame(rows, "id string, keywords array<string>")
    asked = []
    links = lambda: asked.append(1) or N.keyword_links(df)
    run = lambda l, k: [tuple(r) for r in N.search(df, l, "review the paper?", k).collect()]
    whole = N.keyword_links(df)
    assert run(links, 4) == run(whole, 4) == [(f"n{i:02d}", 1.0) for i in (3, 13, 23, 33)] and not asked
    assert run(links, 30) == run(whole, 30) and asked == [1]
    assert {s for _, s in run(links, 40)} >= {1.0, 0.5}
