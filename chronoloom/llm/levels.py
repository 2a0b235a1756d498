"""Reading level of documents by regularised ordinal regression."""

from __future__ import annotations

import math
import re
import zlib
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from chronoloom.session import settle

#: At most this many graded documents are fitted on (those with the smallest hash of their id).
SAMPLE = 20_000
#: Counts of all words are kept in so many rows of so many cells; a word has the least of its cells.  Words that
#: differ by less than one occurrence in CELLS can't be told apart.
ROWS, CELLS = 2, 1 << 19
#: Folds of graded documents: the words of a document are graded by the documents of the other folds.
FOLDS = 5
GRADES = 5
RIDGE = 5.0
#: Words that connect clauses, and those that open a subordinate one.
CONNECTIVES = frozenset("because although though however therefore thus whereas while when if since unless until after before so but and or nor yet hence whence insofar provided notwithstanding moreover furthermore likewise then also".split())
SUBORDINATE = frozenset("that which who whom whose because although when if whereas while since unless until insofar whence wherein thereof provided notwithstanding".split())
_WORD = re.compile(r"[^\W\d_]+(?:['’-][^\W\d_]+)*")
_SENTENCE = re.compile(r"(?<=[.!?])\s+|\n+")
CUTS = (0.0, 2.0, 2.6, 3.2, 3.8, 9.0)
SIZE = 38


def sentences(text: str) -> list[list[str]]:
    found = [_WORD.findall(s) for s in _SENTENCE.split(text.lower())]
    return [s for s in found if s]


def cells(word: str) -> list[int]:
    """The word's cell in each row of the table of counts."""
    w = word.encode("utf-8", "surrogatepass")
    return [row * CELLS + zlib.crc32(w, row * 0x9E3779B1 & 0xFFFFFFFF) % CELLS for row in range(ROWS)]


def quantiles(values: np.ndarray, at: tuple[float, ...]) -> list[float]:
    """Linearly interpolated quantiles of a non-empty array."""
    v = np.sort(values)
    out = []
    for q in at:
        x = q * (len(v) - 1)
        i = int(x)
        out.append(float(v[i] + (v[min(i + 1, len(v) - 1)] - v[i]) * (x - i)))
    return out


@dataclass
class Lexicon:
    """Of every word the log rarity in the corpus, by a count table of fixed size, and the mean grade in graded text.

    ``grade``: word to [sum of grades, weight] over all graded documents; ``folds``: the same per fold, which
    are left out where a document of that fold is looked at to fit on.
    """

    table: np.ndarray
    total: int
    grade: dict[str, tuple[float, float]]
    folds: list[dict[str, tuple[float, float]]]
    mean: float
    rarity: dict[str, float] = field(default_factory=dict)
    level: dict[str, float] = field(default_factory=dict)

    def rare(self, word: str) -> float:
        found = self.rarity.get(word)
        if found is None:
            if len(self.rarity) > 500_000:
                self.rarity.clear()
            n = min(int(self.table[i]) for i in cells(word))
            found = self.rarity[word] = math.log(self.total / max(n, 1))
        return found

    def graded(self, word: str, fold: int | None) -> float:
        if fold is None and word in self.level:
            return self.level[word]
        top, bottom = self.grade.get(word, (0.0, 0.0))
        if fold is not None:
            less = self.folds[fold].get(word, (0.0, 0.0))
            return (top - less[0] + 3 * self.mean) / (bottom - less[1] + 3)
        found = self.level[word] = (top + 3 * self.mean) / (bottom + 3)
        return found

    def features(self, text: str, fold: int | None = None) -> np.ndarray:
        """Diversity, rarity, connectives, clause depth and lengths of the text, and how its sentences' words are graded."""
        ss = sentences(text)
        if not ss:
            return np.zeros(SIZE)
        words = [w for s in ss for w in s]
        n, ns = len(words), len(ss)
        counts = Counter(words)
        known = {w: (self.rare(w), self.graded(w, fold)) for w in counts}
        r, g = np.array([known[w] for w in words]).T
        size = np.array([len(w) for w in words])
        lengths = np.array([len(s) for s in ss], float)
        sub = sum(c for w, c in counts.items() if w in SUBORDINATE)
        joint = sum(c for w, c in counts.items() if w in CONNECTIVES)
        square = r * r
        cut = np.r_[0, np.cumsum(lengths.astype(int))[:-1]]
        level = np.add.reduceat(g * square, cut) / np.maximum(np.add.reduceat(square, cut), 1e-9)
        at = np.searchsorted(CUTS[1:-1], level, side="right")
        share, mass = np.bincount(at, minlength=5) / ns, np.bincount(at, weights=lengths, minlength=5) / n
        sizes = np.bincount(np.minimum(size, 13), minlength=14) / n
        return np.array([
            len(counts) / n, len(counts) / math.sqrt(n), r.sum() / n, *quantiles(r, (0.75, 0.9)), math.sqrt(max(square.sum() / n - (r.sum() / n) ** 2, 0.0)), joint / n, sub / n, sub / ns,
            text.count(",") / ns, n / ns, *quantiles(lengths, (0.5, 1.0)), size.sum() / n, sizes[7:].sum(), sizes[10:].sum(), sizes[13], sizes[:5].sum(), math.log(n),
            np.maximum.reduceat(size, cut).sum() / ns, *quantiles(level, (0.1, 0.25, 0.5, 0.75, 0.9)), level.sum() / ns, (level * lengths).sum() / n, level.std(), *share, *mass,
        ])


class Ordinal:
    """Proportional odds: P(grade <= k) = logistic(cut_k - x b), ridge on b, labels that don't fit count less."""

    def __init__(self, x: np.ndarray, y: np.ndarray, ridge: float = RIDGE, steps: int = 400):
        self.mean, self.spread = x.mean(axis=0), x.std(axis=0) + 1e-9
        z = self._shape(x)
        self.theta = self._fit(z, y, np.ones(len(y)), ridge, steps)
        own = self._probabilities(z)[np.arange(len(y)), y - 1]
        self.theta = self._fit(z, y, np.clip(own / 0.15, 0.05, 1), ridge, steps)

    def _shape(self, x: np.ndarray) -> np.ndarray:
        z = (x - self.mean) / self.spread
        return np.hstack([z, np.clip(z * z - 1, -1, 4)])

    def _cuts(self, theta: np.ndarray) -> np.ndarray:
        tail = theta[-(GRADES - 1) :]
        return np.cumsum(np.r_[tail[0], np.exp(tail[1:])])

    def _below(self, z: np.ndarray, theta: np.ndarray) -> np.ndarray:
        return 1 / (1 + np.exp(-np.clip(self._cuts(theta)[None, :] - (z @ theta[: z.shape[1]])[:, None], -30, 30)))

    def _fit(self, z: np.ndarray, y: np.ndarray, w: np.ndarray, ridge: float, steps: int) -> np.ndarray:
        n, d = z.shape
        theta = np.r_[np.zeros(d), -2.0, np.log(np.full(GRADES - 2, 1.3))]
        m, v = np.zeros_like(theta), np.zeros_like(theta)
        line = np.arange(n)
        zero, one = np.zeros((n, 1)), np.ones((n, 1))
        for i in range(1, steps + 1):
            p = self._below(z, theta)
            whole, slope = np.hstack([zero, p, one]), np.hstack([zero, p * (1 - p), zero])
            chance = np.maximum(whole[line, y] - whole[line, y - 1], 1e-9)
            pull = w * (slope[line, y] - slope[line, y - 1]) / chance
            cut = np.array([-(w * ((y == k + 1) * slope[:, k + 1] - (y == k + 2) * slope[:, k + 1]) / chance).sum() for k in range(GRADES - 1)])
            gaps = np.exp(theta[d + 1 :])
            g = np.r_[z.T @ pull + ridge * theta[:d], cut.sum(), [cut[j:].sum() * gaps[j - 1] for j in range(1, GRADES - 1)]] / n
            m, v = 0.9 * m + 0.1 * g, 0.999 * v + 0.001 * g * g
            theta = theta - 0.05 * (m / (1 - 0.9**i)) / (np.sqrt(v / (1 - 0.999**i)) + 1e-8)
        return theta

    def _probabilities(self, z: np.ndarray) -> np.ndarray:
        p = self._below(z, self.theta)
        return np.diff(np.hstack([np.zeros((len(z), 1)), p, np.ones((len(z), 1))]), axis=1)

    def grades(self, x: np.ndarray) -> np.ndarray:
        return self._probabilities(self._shape(x)).argmax(axis=1) + 1


def _word_counts(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Occurrences per cell of the table of counts; the last cell holds the number of words."""
    total: Counter = Counter()
    for frame in frames:
        for text in frame["text"]:
            total.update(_WORD.findall(text.lower()))
        if len(total) > 200_000:
            yield _by_cell(total)
            total = Counter()
    yield _by_cell(total)


def _by_cell(total: Counter) -> pd.DataFrame:
    n = np.fromiter(total.values(), np.int64, len(total))
    at = np.array([cells(w) for w in total], np.int64).reshape(-1, ROWS)
    one, back = np.unique(at.ravel(), return_inverse=True)
    sums = np.bincount(back, weights=np.repeat(n, ROWS), minlength=len(one)) if len(one) else np.zeros(0)
    return pd.DataFrame({"cell": np.r_[one, ROWS * CELLS].astype(np.int64), "n": np.r_[sums, n.sum()].astype(np.int64)})


def _graded_words(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for frame in frames:
        top, bottom = Counter(), Counter()
        for text, grade, fold in zip(frame["text"], frame["grade"], frame["fold"]):
            for w, k in Counter(_WORD.findall(text.lower())).items():
                k = math.log1p(k)
                top[fold, w] += k * grade
                bottom[fold, w] += k
        yield pd.DataFrame({"fold": [f for f, _ in top], "w": [w for _, w in top], "top": list(top.values()), "bottom": list(bottom.values())})


def fit(documents: DataFrame, labels: DataFrame, sample: int = SAMPLE) -> tuple[Lexicon, Ordinal | None]:
    """Lexicon and model.  ``documents``: doc_id, text (non-null); ``labels``: doc_id, grade.

    Of several grades of a document the median counts; null grades and grades outside 1 to 5 don't.
    With fewer than 10 graded documents or a single grade there is no model (all get the middle grade).
    Words are graded out of fold: what a graded document shows of its words' grades comes from the other folds.
    """
    counts = documents.select("text").mapInPandas(_word_counts, "cell bigint, n bigint").groupBy("cell").agg(F.sum("n").alias("n"))
    known = counts.toPandas()  # ROWS * CELLS rows at most
    table = np.zeros(ROWS * CELLS + 1, np.int64)
    table[known["cell"].to_numpy(np.int64)] = known["n"].to_numpy(np.int64)
    grades = labels.where(F.col("grade").between(1, GRADES)).groupBy("doc_id").agg(F.round(F.median("grade")).cast("int").alias("grade"))
    graded = documents.join(grades, "doc_id").orderBy(F.xxhash64("doc_id"), "doc_id").limit(sample)
    graded = settle(graded.select("doc_id", "text", "grade", F.pmod(F.xxhash64("doc_id", F.lit("fold")), F.lit(FOLDS)).cast("int").alias("fold")))
    mean = graded.agg(F.avg("grade")).first()[0] or (GRADES + 1) / 2
    scores = graded.mapInPandas(_graded_words, "fold int, w string, top double, bottom double").groupBy("fold", "w").agg(F.sum("top").alias("top"), F.sum("bottom").alias("bottom"))
    every: dict[str, tuple[float, float]] = {}
    folds: list[dict[str, tuple[float, float]]] = [{} for _ in range(FOLDS)]
    for fold, w, top, bottom in scores.toPandas().sort_values(["w", "fold"]).itertuples(index=False):  # the words of the sample
        folds[fold][w] = (top, bottom)
        had = every.get(w, (0.0, 0.0))
        every[w] = (had[0] + top, had[1] + bottom)
    lexicon = Lexicon(table[:-1], int(table[-1]) or 1, every, folds, mean)
    shared = documents.sparkSession.sparkContext.broadcast(lexicon)

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            yield pd.DataFrame({"x": [shared.value.features(t, f).tolist() for t, f in zip(frame["text"], frame["fold"])], "y": frame["grade"].to_numpy(), "k": frame["doc_id"].to_numpy()})

    kind = documents.schema["doc_id"].dataType.simpleString()
    known = sorted(graded.mapInPandas(run, f"x array<double>, y int, k {kind}").collect(), key=lambda r: str(r["k"]))
    y = np.array([r["y"] for r in known], int)
    lexicon = Lexicon(table[:-1], lexicon.total, every, [], mean)  # the folds have done their work
    if len(y) < 10 or len(set(y)) < 2:
        return lexicon, None
    return lexicon, Ordinal(np.array([r["x"] for r in known]), y)


def reading_levels(documents: DataFrame, labels: DataFrame, least: int = 40, sample: int = SAMPLE) -> DataFrame:
    """doc_id, grade (1 to 5) of every document with at least ``least`` words.

    ``documents``: doc_id, text; null and short texts come out in no row.  Whole texts are read; corpus
    word counts cover all documents; only the fit is on a bounded sample of labelled documents.

    Plan: word counts are added up in Arrow batches before the shuffle, into a table of ROWS * CELLS counts that
    covers every word; it, the words of the graded sample and the model, all of bounded size, go to the workers
    once; grading is a map.
    """
    spark = documents.sparkSession
    texts = documents.select("doc_id", "text").where("text IS NOT NULL")
    lexicon, model = fit(texts, labels, sample)
    shared = spark.sparkContext.broadcast((lexicon, model))

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        own, ordinal = shared.value
        for frame in frames:
            frame = frame[[len(t.split()) >= least for t in frame["text"]]]
            if not len(frame):
                continue
            if ordinal is None:
                grade = np.full(len(frame), (GRADES + 1) // 2)
            else:
                grade = ordinal.grades(np.array([own.features(t) for t in frame["text"]]))
            yield pd.DataFrame({"doc_id": frame["doc_id"].to_numpy(), "grade": grade.astype("int32")})

    return texts.mapInPandas(run, f"doc_id {documents.schema['doc_id'].dataType.simpleString()}, grade int")
