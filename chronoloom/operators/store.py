"""A keyed store over frames: lookup, scan, upsert, delete with cascade, statistics; on Parquet if given a path."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from chronoloom.operators.views import latest

KINDS = ("entities", "relationships", "episodes", "communities")


class NotFound(KeyError):
    """No row with that id."""


def scan(df: DataFrame, group: str | None = None, limit: int | None = None, order: str = "id") -> DataFrame:
    """Rows of one tenant (all without one), in id order."""
    df = df if group is None else df.where(F.col("group_id") == group)
    return df if limit is None else df.orderBy(order).limit(limit)


def get(df: DataFrame, id_: str) -> DataFrame:
    found = df.where(F.col("id") == id_).limit(1)
    if found.count() == 0:
        raise NotFound(id_)
    return found


def get_many(df: DataFrame, ids: DataFrame) -> DataFrame:
    """Rows whose id is asked for; missing ids are passed over."""
    return df.join(ids.select("id").distinct(), "id", "left_semi")


def adjacent(edges: DataFrame, id_: str) -> DataFrame:
    return edges.where((F.col("source_id") == id_) | (F.col("target_id") == id_))


def upsert(old: DataFrame, new: DataFrame, key: str = "id", *order: str) -> DataFrame:
    """New rows in place of old ones with the same key; of several new ones the last in ``order``."""
    new = latest(new, key, *(order or (key,)))
    return old.join(new.select(key), key, "left_anti").unionByName(new, allowMissingColumns=True)


def delete_with_edges(entities: DataFrame, edges: DataFrame, gone: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Entities and edges without the ids of ``gone`` and every edge at them."""
    ids = gone.select("id").distinct()
    e = edges.join(ids.select(F.col("id").alias("source_id")), "source_id", "left_anti").join(ids.select(F.col("id").alias("target_id")), "target_id", "left_anti")
    return entities.join(ids, "id", "left_anti"), e


def stats(tables: dict[str, DataFrame]) -> DataFrame:
    """kind, n."""
    return reduce(DataFrame.unionByName, [df.agg(F.count(F.lit(1)).alias("n")).select(F.lit(k).alias("kind"), "n") for k, df in tables.items()])


class GraphStore:
    """Frames by kind; with a path they live in Parquet, partitioned by tenant, one folder per generation."""

    def __init__(self, spark: SparkSession, path: str | None = None):
        self.spark, self.path = spark, path.rstrip("/") if path else None
        self.frames: dict[str, DataFrame] = {}

    def _generation(self, kind: str) -> int:
        jvm = self.spark._jvm
        p = jvm.org.apache.hadoop.fs.Path(f"{self.path}/{kind}")
        fs = p.getFileSystem(self.spark._jsc.hadoopConfiguration())
        if not fs.exists(p):
            return -1
        done = [int(s.getPath().getName()) for s in fs.listStatus(p) if fs.exists(jvm.org.apache.hadoop.fs.Path(s.getPath(), "_SUCCESS"))]
        return max(done, default=-1)

    def put(self, kind: str, df: DataFrame) -> None:
        """Upsert rows of a kind."""
        old = self.table(kind)
        new = latest(df, "id", "id") if old is None else upsert(old, df)
        if self.path is None:
            self.frames[kind] = new
            return
        at = f"{self.path}/{kind}/{self._generation(kind) + 1}"
        writer = new.write
        (writer.partitionBy("group_id") if "group_id" in new.columns else writer).parquet(at)

    def table(self, kind: str) -> DataFrame | None:
        if kind not in KINDS:
            raise ValueError(kind)
        if self.path is None:
            return self.frames.get(kind)
        n = self._generation(kind)
        return None if n < 0 else self.spark.read.parquet(f"{self.path}/{kind}/{n}")

    def delete_entities(self, ids: DataFrame) -> None:
        e, r = delete_with_edges(self.table("entities"), self.table("relationships"), ids)
        if self.path is not None:
            e.write.parquet(f"{self.path}/entities/{self._generation('entities') + 1}")
            r.write.parquet(f"{self.path}/relationships/{self._generation('relationships') + 1}")
        else:
            self.frames |= {"entities": e, "relationships": r}

    def stats(self) -> DataFrame:
        return stats({k: t for k in KINDS if (t := self.table(k)) is not None})

    def clear(self) -> None:
        if self.path is None:
            self.frames.clear()
            return
        p = self.spark._jvm.org.apache.hadoop.fs.Path(self.path)
        p.getFileSystem(self.spark._jsc.hadoopConfiguration()).delete(p, True)
