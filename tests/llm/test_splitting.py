"""Splitting: the range index against brute force, limits, overlap, kinds of boundaries, odd input."""

import random

import numpy as np
import pytest

from chronoloom.llm.splitting import NAMES, RangeMaximum, finest, scan, split, split_oversized

SENTENCE = "one two three four five six seven eight nine ten. "


def test_range_maximum():
    r = random.Random(0)
    v = np.array([r.randrange(4) for _ in range(200)])
    table = RangeMaximum(v)
    for _ in range(2000):
        a = r.randrange(200)
        b = r.randrange(a, 200)
        assert table.query(a, b) == max(range(a, b + 1), key=lambda i: (v[i], i))


@pytest.mark.parametrize("text,kind", [((SENTENCE * 20 + "\n \n") * 5, "paragraph"), (SENTENCE * 80, "sentence"), ("word " * 1000, "word"), ("a b e.g. c cf. Fig. d et al. e vs. f " * 100, "word"), ("x y z " * 400, "word")])
def test_kinds_and_limits(text, kind):
    _, strength = scan(text)
    assert NAMES[finest(RangeMaximum(strength), 512)] == kind
    pieces = split(text, 512, 32)
    covered = 0
    for a, b, over, _ in pieces:
        assert b - a <= 512 and a <= covered < b and covered - a == over
        covered = b
    assert covered == len(strength)
    assert all(NAMES[c] == kind or c > 1 for *_, c in pieces[:-1])


def test_overlap_is_the_last_sentence():
    pieces = split(SENTENCE * 80, 512, 32)
    assert all(p[2] == 10 for p in pieces[1:])


def test_operator(spark):
    s = "id string, text string, section string, piece int, words int"
    rows = [("a", "w " * 600, "S", 7, 7), ("a", "w " * 600, "S", 7, 7), ("b", "short text.", None, 1, 1), ("c", None, "S", 1, 1), ("d", "  \n ", "S", 1, 1), (None, "x " * 513, "S", 1, 1), ("e", "z" * 100_000, "S", 1, 1)]
    df = spark.createDataFrame(rows, s)
    got = split_oversized(df, "id", "text", carry=["section", "piece"]).collect()
    by = {}
    for r in got:
        by.setdefault(r["id"], []).append(r)
    assert {k: len(v) for k, v in by.items()} == {"a": 2, "b": 1, None: 2, "e": 1}
    assert all(r["section"] == "S" and r["of_piece"] == 7 for r in by["a"])
    assert by["b"][0]["boundary"] is None and by["a"][0]["boundary"] == "word"
    assert split_oversized(df.where("id = 'q'"), "id", "text").count() == 0


def test_kind_by_the_index_is_that_of_the_run_lengths():
    r = random.Random(5)
    for _ in range(500):
        n, limit = r.randrange(12, 80), r.randrange(3, 11)
        v = np.array([r.choice((1, 1, 1, 2, 2, 3)) for _ in range(n)])
        v[-1] = 0
        runs = lambda level: np.diff(np.r_[np.flatnonzero(v[:-1] >= level) + 1, n], prepend=0).max()
        assert finest(RangeMaximum(v), limit) == next((level for level in (3, 2) if runs(level) <= limit), 1)


def test_pieces_of_the_test_table(spark, sf):
    """Every piece is within the limit, begins with its overlap, and the pieces cover the text without a hole."""
    from pyspark.sql import functions as F

    from chronoloom.llm.queries import QUERIES

    rows = QUERIES["p2_pieces"](spark, sf).orderBy("id", F.xxhash64("total"), "piece").collect()
    assert rows and max(r["words"] for r in rows) <= 512
    for a, b in zip(rows, rows[1:]):
        assert len(a["text"].split()) == a["words"]
        if a["id"] == b["id"] and b["piece"] == a["piece"] + 1 and a["total"] == b["total"]:
            assert 0 < b["overlap"] <= 256 and b["start"] < a["stop"] <= b["stop"]
            assert b["text"].split()[: b["overlap"]] == a["text"].split()[-b["overlap"] :]
        else:
            assert b["piece"] == 0 and b["overlap"] == 0
