"""Approximate search: an index of random projections over the normalised vectors, kept as a table.

The index is data, not a structure in a process: rows are added by union, removed by anti join, and stored in Parquet.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce
from operator import or_

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from chronoloom.functions import vectors as V


class ProjectionIndex:
    """``tables`` hash tables of ``bits`` sign projections; a query looks into ``probes`` buckets of each: its own and
    those behind the planes it is nearest to (least sum of squared margins)."""

    def __init__(self, dim: int, tables: int = 12, bits: int = 8, probes: int = 24, seed: int = 11):
        rng = np.random.default_rng(seed)
        self.dim, self.tables, self.bits, self.probes = dim, tables, bits, probes
        self.planes = rng.standard_normal((tables, bits, dim))

    def buckets(self, q: np.ndarray) -> np.ndarray:
        """tables x probes: the buckets that a vector looks into."""
        planes, at = self.planes @ q, np.arange(self.bits)
        steps = np.arange(1 << self.bits)
        cost = planes**2 @ ((steps[:, None] >> at) & 1).T
        own = ((planes >= 0) * (1 << at)).sum(axis=1)
        return own[:, None] ^ np.argsort(cost, axis=1, kind="stable")[:, : self.probes]

    def build(self, df: DataFrame, key: str, vector: str) -> DataFrame:
        """id, v (normalised) and the bucket of each table; vectors of another length or without direction are left out."""
        planes, dim = self.planes, self.dim
        names = [f"b{t}" for t in range(self.tables)]

        def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            for frame in frames:
                x = np.array(frame["v"].tolist(), float).reshape(-1, dim)
                size = np.linalg.norm(x, axis=1)
                ok = np.isfinite(size) & (size > 0)
                x = x[ok] / size[ok][:, None]
                signs = np.einsum("nd,tbd->ntb", x, planes) >= 0
                buckets = (signs * (1 << np.arange(planes.shape[1]))).sum(axis=2)
                yield pd.DataFrame({"id": frame["id"][ok].to_numpy(), "v": list(x), **{n: buckets[:, i] for i, n in enumerate(names)}})

        rows = df.where(F.col(vector).isNotNull() & (F.size(vector) == dim)).select(F.col(key).alias("id"), F.col(vector).alias("v"))
        return rows.mapInPandas(run, f"id {df.schema[key].dataType.simpleString()}, v array<double>, " + ", ".join(f"{n} int" for n in names))

    def add(self, index: DataFrame, df: DataFrame, key: str, vector: str) -> DataFrame:
        new = self.build(df, key, vector)
        return self.remove(index, new.select("id")).unionByName(new)

    @staticmethod
    def remove(index: DataFrame, gone: DataFrame) -> DataFrame:
        return index.join(gone.select("id"), "id", "left_anti")

    def search(self, index: DataFrame, query: list[float], k: int) -> DataFrame:
        """id, score: the k most similar of the rows in the query's buckets; the buckets are a filter on the scan."""
        q = np.asarray(query, float)
        q = q / max(float(np.linalg.norm(q)), 1e-300)
        hit = [F.col(f"b{t}").isin(near) for t, near in enumerate(self.buckets(q).tolist())]
        score = V.dot(F.col("v"), F.array(*[F.lit(float(x)) for x in q]))
        return index.where(reduce(or_, hit)).select("id", score.alias("score")).orderBy(F.desc("score"), "id").limit(k)

    def search_all(self, index: DataFrame, queries: DataFrame, key: str, vector: str, k: int) -> DataFrame:
        """query, id, score, rank: the k most similar rows of the index for each query vector."""
        kind = queries.schema[key].dataType.simpleString()

        def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            for frame in frames:
                yield pd.DataFrame({"query": frame["id"], "hits": [list(enumerate(self.buckets(v).tolist())) for v in frame["v"]]})

        asked = self.build(queries, key, vector).select("id", "v")
        hits = asked.mapInPandas(run, f"query {kind}, hits array<struct<t: int, near: array<int>>>").select("query", F.explode("hits").alias("h"))
        hits = hits.select("query", F.col("h.t").alias("t"), F.explode("h.near").alias("b"))
        rows = index.select("id", F.posexplode(F.array(*[f"b{t}" for t in range(self.tables)])).alias("t", "b"))
        pairs = rows.join(hits, ["t", "b"]).select("query", "id").distinct()
        scored = pairs.join(index.select("id", "v"), "id").join(asked.select(F.col("id").alias("query"), F.col("v").alias("q")), "query")
        scored = scored.select("query", "id", V.dot(F.col("v"), F.col("q")).alias("score"))
        w = Window.partitionBy("query").orderBy(F.desc(F.round("score", 12)), "id")
        return scored.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= k)
