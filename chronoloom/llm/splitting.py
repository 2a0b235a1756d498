"""Cutting oversized texts at natural boundaries."""

from __future__ import annotations

import re
from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Abbreviations whose full stop ends no sentence ("et al." takes two words).
ABBREVIATIONS = ("e.g.", "i.e.", "cf.", "Fig.", "approx.", "vs.")
PARAGRAPH, SENTENCE, WORD = 3, 2, 1
NAMES = {PARAGRAPH: "paragraph", SENTENCE: "sentence", WORD: "word"}
_WORDS = re.compile(r"\S+")
PIECES = "id string, piece int, text string, words int, overlap int, start int, stop int, cut string, boundary string, total int"


class RangeMaximum:
    """A sparse table: the position of the largest value in any range, of equal ones the rightmost."""

    def __init__(self, values: np.ndarray):
        self.values = values
        self.levels = [np.arange(len(values))]
        width = 1
        while 2 * width <= len(values):
            below = self.levels[-1]
            left, right = below[:-width], below[width:]
            self.levels.append(np.where(values[right] >= values[left], right, left))
            width *= 2

    def query(self, first: int, last: int) -> int:
        """The rightmost position of the maximum of values[first..last], both included."""
        k = (last - first + 1).bit_length() - 1
        a, b = int(self.levels[k][first]), int(self.levels[k][last - (1 << k) + 1])
        return b if self.values[b] >= self.values[a] else a


def scan(text: str) -> tuple[np.ndarray, np.ndarray]:
    """Character spans of the words, and the strength of a cut after each word (the last has none: 0)."""
    spans = [m.span() for m in _WORDS.finditer(text)]
    strength = np.ones(len(spans), np.int8)
    for i, (a, b) in enumerate(spans):
        after = spans[i + 1][0] if i + 1 < len(spans) else b
        if text.count("\n", b, after) > 1:
            strength[i] = PARAGRAPH
        elif text[b - 1] in ".!?":
            word = text[a:b]
            at = next((j for j, c in enumerate(word) if c.isalnum()), 0)
            bare = word[at:]
            if not (bare in ABBREVIATIONS or (bare == "al." and i and text[spans[i - 1][0] : spans[i - 1][1]].endswith("et"))):
                strength[i] = SENTENCE
    if len(spans):
        strength[-1] = 0
    return np.array(spans, np.int64).reshape(-1, 2), strength


def finest(best: RangeMaximum, limit: int) -> int:
    """The strongest boundary at which alone the text could be cut into parts of at most limit words.

    Each part ends at the strongest cut of its window.  If every window has a cut of some strength, all cuts
    taken are at least as strong; if a stretch longer than the limit has none, the part that begins with it
    takes a weaker one.  So the weakest cut taken is the answer.
    """
    n, start, weakest = len(best.values), 0, PARAGRAPH
    while n - start > limit:
        end = best.query(start, start + limit - 1)
        weakest, start = min(weakest, int(best.values[end])), end + 1
    return weakest


def split(text: str, limit: int, tail: int) -> list[tuple[int, int, int, int]]:
    """Pieces as (first word, word after the last, words of overlap, strength of the cut at its end).

    Each piece takes the strongest cut that its length permits, of equal ones the rightmost.  The next one
    steps back by the last sentence of the piece; where that takes more than half the limit (a sentence too
    long to be kept whole), by its last ``tail`` words.
    """
    _, strength = scan(text)
    return _split(RangeMaximum(strength), limit, tail)


def _split(best: RangeMaximum, limit: int, tail: int) -> list[tuple[int, int, int, int]]:
    strength = best.values
    n, pieces, start, cut = len(strength), [], 0, 0
    if not n:
        return []
    before = np.maximum.accumulate(np.where(strength >= SENTENCE, np.arange(n), -1))
    while n - start > limit:
        end = best.query(cut, start + limit - 1) + 1
        pieces.append((start, end, cut - start, int(strength[end - 1])))
        last = int(before[end - 2]) + 1 if end >= 2 else 0  # where the last sentence of the piece begins
        last = max(last, start)
        start, cut = (last if end - last <= limit // 2 else end - min(tail, limit // 2)), end
    pieces.append((start, n, cut - start, 0))
    return pieces


def _pieces(limit: int, tail: int) -> Callable[[Iterator[pd.DataFrame]], Iterator[pd.DataFrame]]:
    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            out = []
            for key, text in zip(frame["id"], frame["text"]):
                spans, strength = scan(text)
                n = len(spans)
                if not n:
                    continue
                best = RangeMaximum(strength) if n > limit else None
                kind = NAMES[finest(best, limit)] if best else None
                for i, (a, b, over, cut) in enumerate(_split(best, limit, tail) if best else [(0, n, 0, 0)]):
                    lo, hi = int(spans[a][0]), int(spans[b - 1][1])
                    out.append((key, i, text[lo:hi], b - a, over, lo, hi, NAMES.get(cut, "end"), kind, n))
            yield pd.DataFrame(out, columns=[c.split()[0] for c in PIECES.split(", ")])

    return run


def split_oversized(df: DataFrame, key: str, text: str, limit: int = 512, tail: int = 32, carry: list[str] | None = None) -> DataFrame:
    """Pieces of at most ``limit`` words of every text, with the columns of PIECES.

    ``boundary`` is null for a text within the limit (one piece), else the strongest kind of boundary at
    which alone it could be cut.  Null and blank texts have no words and give no piece; null keys are
    kept.  Repeated rows count once.  ``carry`` names columns (such as the section) that are copied to
    each piece under their own names, prefixed with "of_" where they'd clash.

    Plan: one exchange to drop repeated rows, then a map; a text never leaves its row.
    """
    carry = carry or []
    taken = {c.split()[0] for c in PIECES.split(", ")}
    names = {c: f"of_{c}" if c in taken else c for c in carry}
    rows = df.select(F.col(key).cast("string").alias("id"), F.col(text).alias("text"), *[F.col(c).alias(names[c]) for c in carry])
    rows = rows.where("text IS NOT NULL").dropDuplicates()
    if not carry:
        return rows.mapInPandas(_pieces(limit, tail), PIECES)
    schema = ", ".join(f"`{names[c]}` {df.schema[c].dataType.simpleString()}" for c in carry)
    inner = _pieces(limit, tail)

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            got = next(iter(inner(iter([frame.assign(id=range(len(frame)))]))))
            at = got["id"].astype("int64").to_numpy()
            more = frame.iloc[at].reset_index(drop=True)
            got["id"] = more["id"]
            yield pd.concat([got, more[[names[c] for c in carry]]], axis=1)

    return rows.mapInPandas(run, f"{PIECES}, {schema}")
