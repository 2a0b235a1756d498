"""Encoding of whole corpora with the byte-level BPE of a public rank file, in numpy."""

from __future__ import annotations

import base64
import hashlib
import heapq
from collections.abc import Callable, Iterator
from functools import lru_cache
from pathlib import Path

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

VOCABULARY = "/opt/tokenizers/byte_bpe_50k.tiktoken"
#: The split pattern of the rank files, with Unicode White_Space spelled out for \s.
_WS = r"\t-\r \x85\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000"
PATTERN = rf"'s|'t|'re|'ve|'m|'ll|'d| ?\p{{L}}+| ?\p{{N}}+| ?[^{_WS}\p{{L}}\p{{N}}]+|[{_WS}]+(?![^{_WS}])|[{_WS}]+"
#: Pieces of more bytes than this merge by a heap, so that a run of a million letters isn't quadratic.
LONG = 256
#: Pieces remembered by a worker; beyond it the memory starts afresh.
REMEMBER = 400_000
_EMPTY = np.int64(-1)


class Merges:
    """Ranks of byte strings and an open-addressing table from pairs of ids to the id of their union."""

    def __init__(self, file: bytes):
        ranks: dict[bytes, int] = {}
        for line in file.splitlines():
            if line.strip():
                token, rank = line.split()
                ranks[base64.b64decode(token)] = int(rank)
        self.ranks = ranks
        self.byte = np.array([ranks[bytes([i])] for i in range(256)], np.int32)
        self.text = {rank: token for token, rank in ranks.items()}
        pairs = {}
        for token, rank in ranks.items():
            for i in range(1, len(token)):
                left, right = ranks.get(token[:i]), ranks.get(token[i:])
                if left is not None and right is not None:
                    pairs[(left << 20) | right] = rank
        self.bits = max(4, (2 * len(pairs)).bit_length())
        self.keys = np.full(1 << self.bits, _EMPTY)
        self.values = np.zeros(1 << self.bits, np.int32)
        keys, values = np.fromiter(pairs.keys(), np.int64, len(pairs)), np.fromiter(pairs.values(), np.int32, len(pairs))
        at = self._slot(keys)
        while len(keys):
            free = self.keys[at] == _EMPTY
            _, first = np.unique(at[free], return_index=True)
            take = np.flatnonzero(free)[first]
            self.keys[at[take]], self.values[at[take]] = keys[take], values[take]
            rest = np.ones(len(keys), bool)
            rest[take] = False
            keys, values, at = keys[rest], values[rest], (at[rest] + 1) & (len(self.keys) - 1)

    def _slot(self, keys: np.ndarray) -> np.ndarray:
        return ((keys.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(64 - self.bits)).astype(np.int64)

    NONE = np.int32(2**31 - 1)

    def find(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        """The rank of each pair, NONE where the two don't merge."""
        keys = (left.astype(np.int64) << 20) | right
        at = self._slot(keys)
        out = np.full(len(keys), self.NONE, np.int32)
        open_ = np.arange(len(keys))
        while len(open_):
            there = self.keys[at]
            hit = there == keys[open_]
            out[open_[hit]] = self.values[at[hit]]
            go = ~hit & (there != _EMPTY)
            open_, at = open_[go], (at[go] + 1) & (len(self.keys) - 1)
        return out

    def merge_matrix(self, pieces: list[bytes]) -> list[np.ndarray]:
        """Pieces of similar length as one padded matrix; every round each row merges its leftmost pair of least rank."""
        size = np.array([len(p) for p in pieces])
        width = int(size.max())
        ids = np.full((len(pieces), width), -1, np.int32)
        inside = np.arange(width) < size[:, None]
        ids[inside] = self.byte[np.frombuffer(b"".join(pieces), np.uint8)]
        ranks = np.full((len(pieces), width), self.NONE, np.int32)
        pair = inside[:, 1:]
        ranks[:, :-1][pair] = self.find(ids[:, :-1][pair], ids[:, 1:][pair])
        done: list[np.ndarray | None] = [None] * len(pieces)
        rows = np.arange(len(pieces))
        columns = np.arange(width)
        while len(rows):
            at = ranks.argmin(axis=1)
            best = ranks[np.arange(len(rows)), at]
            over = best == self.NONE
            if over.any():
                for r in np.flatnonzero(over):
                    done[rows[r]] = ids[r, : size[r]].copy()
                go = ~over
                rows, ids, ranks, size, at, best = rows[go], ids[go], ranks[go], size[go], at[go], best[go]
                if not len(rows):
                    break
            line = np.arange(len(rows))
            ids[line, at] = best
            # compaction: everything right of the merged pair moves one to the left
            move = columns[: ids.shape[1] - 1] > at[:, None]
            ids[:, :-1] = np.where(move, ids[:, 1:], ids[:, :-1])
            ranks[:, :-1] = np.where(move, ranks[:, 1:], ranks[:, :-1])
            ids[:, -1], ranks[:, -1] = -1, self.NONE
            size = size - 1
            left = at > 0
            ranks[line[left], at[left] - 1] = self.find(ids[line[left], at[left] - 1], ids[line[left], at[left]])
            right = at < size - 1
            ranks[line[right], at[right]] = self.find(ids[line[right], at[right]], ids[line[right], at[right] + 1])
            ranks[line[~right], at[~right]] = self.NONE
            keep = int(size.max())
            if keep < ids.shape[1]:
                ids, ranks = ids[:, :keep], ranks[:, :keep]
        return done  # type: ignore[return-value]

    def merge_long(self, piece: bytes) -> np.ndarray:
        """One long piece by a heap over a linked list: the same merges in n log n."""
        n = len(piece)
        ids = self.byte[np.frombuffer(piece, np.uint8)].tolist()
        after, before = list(range(1, n + 1)), list(range(-1, n - 1))
        ranks = self.ranks
        text = self.text
        heap = []
        for i in range(n - 1):
            if (r := ranks.get(text[ids[i]] + text[ids[i + 1]])) is not None:
                heap.append((r, i, ids[i], ids[i + 1]))
        heapq.heapify(heap)
        while heap:
            r, i, a, b = heapq.heappop(heap)
            j = after[i] if ids[i] == a else n
            if ids[i] != a or j >= n or ids[j] != b:
                continue
            ids[i], ids[j] = r, -1
            after[i] = after[j]
            if after[i] < n:
                before[after[i]] = i
                if (x := ranks.get(text[r] + text[ids[after[i]]])) is not None:
                    heapq.heappush(heap, (x, i, r, ids[after[i]]))
            if before[i] >= 0 and (x := ranks.get(text[ids[before[i]]] + text[r])) is not None:
                heapq.heappush(heap, (x, before[i], ids[before[i]], r))
        return np.array([x for x in ids if x >= 0], np.int32)

    def pieces(self, pieces: list[bytes]) -> list[np.ndarray]:
        """The ids of each piece; pieces are put into matrices by the power of two of their length."""
        out: list[np.ndarray] = [np.zeros(0, np.int32)] * len(pieces)
        buckets: dict[int, list[int]] = {}
        for i, p in enumerate(pieces):
            if (whole := self.ranks.get(p)) is not None:
                out[i] = np.array([whole], np.int32)
            elif len(p) > LONG:
                out[i] = self.merge_long(p)
            elif p:
                buckets.setdefault((len(p) - 1).bit_length(), []).append(i)
        for members in buckets.values():
            for lo in range(0, len(members), 8192):
                part = members[lo : lo + 8192]
                for i, ids in zip(part, self.merge_matrix([pieces[j] for j in part])):
                    out[i] = ids
        return out


@lru_cache(maxsize=2)
def merges(path: str) -> Merges:
    return Merges(Path(path).read_bytes())


class Encoder:
    """Splits texts and encodes each distinct piece once; ids of known pieces lie one after the other in one array."""

    def __init__(self, own: Merges):
        self.merges = own
        self.split = regex.compile(PATTERN).findall
        self.forget()

    def forget(self) -> None:
        self.known: dict[str, int] = {}
        self.values, self.used = np.zeros(1024, np.int32), 0
        self.starts, self.sizes = np.zeros(1024, np.int64), np.zeros(1024, np.int64)

    def _learn(self, fresh: list[str]) -> None:
        new = self.merges.pieces([p.encode("utf-8", "surrogatepass") for p in fresh])
        sizes = np.fromiter(map(len, new), np.int64, len(new))
        first, ends = len(self.known), self.used + np.cumsum(sizes)
        self.known.update(zip(fresh, range(first, first + len(fresh))))
        while len(self.values) < ends[-1]:
            self.values = np.r_[self.values, np.zeros_like(self.values)]
        while len(self.starts) < len(self.known):
            self.starts, self.sizes = np.r_[self.starts, np.zeros_like(self.starts)], np.r_[self.sizes, np.zeros_like(self.sizes)]
        self.values[self.used : ends[-1]] = np.concatenate(new)
        self.starts[first : len(self.known)], self.sizes[first : len(self.known)] = ends - sizes, sizes
        self.used = int(ends[-1])

    def encode(self, texts: list[str | None]) -> tuple[np.ndarray, np.ndarray]:
        """Offsets per text and all ids, one after the other; null and empty texts have none."""
        if len(self.known) > REMEMBER:
            self.forget()
        split = [self.split(t) if t else [] for t in texts]
        fresh = list(dict.fromkeys(p for s in split for p in s if p not in self.known))
        if fresh:
            self._learn(fresh)
        known = self.known
        flat = np.array([known[p] for s in split for p in s], np.int64)
        ends = np.cumsum([0, *map(len, split)])
        length = self.sizes[flat]
        total = np.r_[0, np.cumsum(length)]
        where = np.repeat(self.starts[flat] - total[:-1], length) + np.arange(total[-1])
        return total[ends], self.values[where]


#: Encoders of this process by the digest of their vocabulary.
_ENCODERS: dict[str, Encoder] = {}


def shipped(spark: SparkSession, path: str) -> Callable[[], Encoder]:
    """What gives a worker the encoder of the driver's vocabulary file (a few MB, sent once an executor)."""
    file = Path(path).read_bytes()
    digest, shared = hashlib.sha256(file).hexdigest(), spark.sparkContext.broadcast(file)

    def get() -> Encoder:
        if digest not in _ENCODERS:
            _ENCODERS[digest] = Encoder(Merges(shared.value))
        return _ENCODERS[digest]

    return get


def _column(batch: pa.RecordBatch, name: str) -> list[str | None]:
    return batch.column(batch.schema.get_field_index(name)).to_pylist()


def _slices(batch: pa.RecordBatch, rows: int) -> Iterator[pa.RecordBatch]:
    for at in range(0, batch.num_rows, rows):
        yield batch.slice(at, rows)


def _encode(get: Callable[[], Encoder], name: str) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = get()
        for whole in batches:
            for batch in _slices(whole, 1000):
                offsets, ids = own.encode(_column(batch, "t"))
                yield pa.RecordBatch.from_arrays([batch.column(batch.schema.get_field_index("k")), pa.ListArray.from_arrays(pa.array(offsets, pa.int32()), pa.array(ids, pa.int32()))], names=[name, "ids"])

    return run


def encode(df: DataFrame, key: str, text: str, vocabulary: str = VOCABULARY) -> DataFrame:
    """key and ids of every row: the text by the byte-level BPE of ``vocabulary``, without special tokens.

    Null and empty texts give an empty list; strings that look like special tokens are ordinary text;
    repeated rows come out as often as they are there; keys may be null.  Whole texts, of any length.

    Plan: map only, no shuffle.  Each batch's distinct pieces are encoded once: padded matrices of similar
    length, in which every row merges its leftmost pair of least rank each round, pairs being looked up in
    an open-addressing table.  The worker remembers pieces, so frequent words cost a lookup.
    """
    kind = df.schema[key].dataType.simpleString()
    return df.select(F.col(key).alias("k"), F.col(text).alias("t")).mapInArrow(_encode(shipped(df.sparkSession, vocabulary), key), f"`{key}` {kind}, ids array<int>")


def _count(get: Callable[[], Encoder], name: str) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = get()
        for whole in batches:
            for batch in _slices(whole, 1000):
                offsets, _ = own.encode(_column(batch, "t"))
                yield pa.RecordBatch.from_arrays([*[c for c, f in zip(batch.columns, batch.schema) if f.name != "t"], pa.array(np.diff(offsets), pa.int64())], names=[*[f.name for f in batch.schema if f.name != "t"], name])

    return run


def count_tokens(df: DataFrame, text: str, name: str = "tokens", vocabulary: str = VOCABULARY) -> DataFrame:
    """df without the text column, with its number of tokens (0 for null and empty) as ``name``."""
    rest = [c for c in df.columns if c != text]
    schema = ", ".join(f"`{c}` {df.schema[c].dataType.simpleString()}" for c in rest)
    return df.select(*[F.col(f"`{c}`") for c in rest], F.col(text).alias("t")).mapInArrow(_count(shipped(df.sparkSession, vocabulary), name), f"{schema}, `{name}` bigint")


def decode(ids: list[int], vocabulary: str = VOCABULARY) -> str:
    """The text of ids."""
    own = merges(vocabulary)
    return b"".join(own.text[i] for i in ids).decode("utf-8", "replace")
