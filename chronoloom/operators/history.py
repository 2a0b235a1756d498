"""Full histories of changing attributes, kept right under late, repeated and corrected reports."""

from __future__ import annotations

import heapq
import json
import os
import uuid
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from chronoloom.operators.intervals import OPEN_US
from chronoloom.tables import SPACE, micros

#: A key with more reports than this is cut into time buckets of about this many.
HOT = 50_000
LEVELS = 40
SEGMENTS = "k string, b bigint, n bigint, s bigint, e bigint, v string, first boolean, last boolean"


def reports(df: DataFrame, key: str, start: str, end: str | None, rank: list[str], value: str) -> DataFrame:
    """Raw reports in the operator's form: k, s, e (microseconds), p1, p2 (the later wins), v (squeezed text).

    Rows with a null key, start or value, or with an end not after the start, report nothing.
    """
    until = F.lit(OPEN_US) if end is None else F.least(F.coalesce(micros(df, end), F.lit(OPEN_US)), F.lit(OPEN_US))
    text = F.trim(F.regexp_replace(F.col(value), SPACE + "+", " "))
    number = lambda c: (micros(df, c) if df.schema[c].dataType.typeName().startswith("timestamp") else F.col(c).cast("bigint"))
    p1, p2 = [F.coalesce(number(c), F.lit(-(2**62))) for c in rank] if len(rank) == 2 else [F.coalesce(number(rank[0]), F.lit(-(2**62))), F.lit(0)]
    rows = df.select(F.col(key).alias("k"), micros(df, start).alias("s"), until.alias("e"), p1.cast("bigint").alias("p1"), p2.cast("bigint").alias("p2"), text.alias("v"))
    return rows.where("k IS NOT NULL AND s IS NOT NULL AND v IS NOT NULL AND e > s")


def _sweep(tolerance: int) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """Reports sorted by (k, b, s) into the stretches of the winning value, each group on its own.

    Memory: the reports that are still in force and not outranked for their whole rest.
    """
    schema = pa.schema([("k", pa.string()), ("b", pa.int64()), ("n", pa.int64()), ("s", pa.int64()), ("e", pa.int64()), ("v", pa.string()), ("first", pa.bool_()), ("last", pa.bool_())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        out: list[tuple] = []
        group: tuple | None = None
        heap: list[tuple] = []
        at = 0
        held: list | None = None  # the stretch that may still grow: s, e, v, first

        def stretch(s: int, e: int, v: str) -> None:
            nonlocal held
            if held is not None and held[2] == v and s - held[1] <= tolerance:
                held[1] = e
                return
            if held is not None:
                out.append((*group, *held[:3], held[3], False))
            held = [s, e, v, held is None]

        def advance(to: int) -> None:
            nonlocal at
            while heap and at < to:
                _, _, e, v = heap[0]
                if e <= at:
                    heapq.heappop(heap)
                    continue
                stop = e if e < to else to
                stretch(at, stop, v)
                at = stop
            at = to

        def close() -> None:
            nonlocal held
            if group is not None:
                advance(OPEN_US)
                if held is not None:
                    out.append((*group, *held[:3], held[3], True))
            held = None
            heap.clear()

        def flush() -> pa.RecordBatch:
            cols = list(zip(*out)) if out else [[] for _ in schema]
            out.clear()
            return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(cols, schema)], schema=schema)

        for batch in batches:
            names = batch.schema.names
            cols = [batch.column(names.index(c)).to_pylist() for c in ("k", "b", "n", "s", "e", "p1", "p2", "v")]
            for k, b, n, s, e, p1, p2, v in zip(*cols):
                if group is None or group[0] != k or group[1] != b:
                    close()
                    group, at = (k, b, n), s
                advance(s)
                at = s
                while heap and heap[0][2] <= e and (heap[0][0], heap[0][1]) >= (-p1, -p2):
                    heapq.heappop(heap)
                heapq.heappush(heap, (-p1, -p2, e, v))
                if len(out) > 20_000:
                    yield flush()
        close()
        yield flush()

    return run


def _bucketed(rows: DataFrame, hot: int) -> DataFrame:
    """Pieces k, b, n (buckets of the key), s, e, p1, p2, v: hot keys cut at bucket edges.

    A report that covers whole buckets becomes at most 2 log2(buckets) dyadic nodes; of each node only the
    highest-ranking report can win, so the nodes are aggregated before they are spread to their buckets.
    """
    size = rows.groupBy("k").agg(F.count(F.lit(1)).alias("c"), F.min("s").alias("lo"), F.max("s").alias("hi")).where(F.col("c") > hot)
    size = size.select("k", F.ceil(F.col("c") / hot).alias("n"), "lo", (F.floor((F.col("hi") - F.col("lo")) / F.ceil(F.col("c") / hot)) + 1).alias("w"))
    rows = rows.join(size, "k", "left")
    cold = rows.where("n IS NULL").select("k", F.lit(0).cast("bigint").alias("b"), F.lit(1).cast("bigint").alias("n"), "s", "e", "p1", "p2", "v")
    busy = (
        rows.where("n IS NOT NULL")
        .withColumn("b1", F.floor((F.col("s") - F.col("lo")) / F.col("w")))
        .withColumn("b2", F.least(F.floor((F.col("e") - 1 - F.col("lo")) / F.col("w")), F.col("n") - 1))
    )
    edge = lambda b: F.when(b >= F.col("n"), F.lit(OPEN_US)).otherwise(F.col("lo") + b * F.col("w"))
    head = F.struct(F.col("b1").alias("b"), F.col("s").alias("s"), F.least(F.col("e"), edge(F.col("b1") + 1)).alias("e"))
    tail = F.struct(F.col("b2").alias("b"), edge(F.col("b2")).alias("s"), F.col("e").alias("e"))
    parts = busy.select("k", "n", "p1", "p2", "v", F.explode(F.when(F.col("b2") > F.col("b1"), F.array(head, tail)).otherwise(F.array(head))).alias("x"))
    parts = parts.select("k", "x.b", "n", "x.s", "x.e", "p1", "p2", "v")
    span = "CASE WHEN b2 - b1 > 1 THEN aggregate(sequence(0, {0}), named_struct('l', b1 + 1, 'r', b2, 'x', cast(array() AS array<struct<h:int,i:bigint>>)), (a, h) -> CASE WHEN a.l >= a.r THEN a ELSE named_struct('l', (a.l + 1) div 2, 'r', a.r div 2, 'x', concat(a.x, CASE WHEN a.l % 2 = 1 THEN array(named_struct('h', h, 'i', a.l)) ELSE cast(array() AS array<struct<h:int,i:bigint>>) END, CASE WHEN a.r % 2 = 1 THEN array(named_struct('h', h, 'i', a.r - 1)) ELSE cast(array() AS array<struct<h:int,i:bigint>>) END)) END).x END".format(LEVELS)
    best = F.max_by(F.struct("p1", "p2", "v"), F.struct("p1", "p2", "v"))
    nodes = busy.select("k", "n", "lo", "w", "p1", "p2", "v", F.explode(F.expr(span)).alias("x")).groupBy("k", "n", "lo", "w", "x").agg(best.alias("y"))
    cover = nodes.select("k", "n", "lo", "w", "y", F.explode(F.expr("sequence(shiftleft(x.i, x.h), shiftleft(x.i + 1, x.h) - 1)")).alias("b"))
    cover = cover.select("k", "b", "n", edge(F.col("b")).alias("s"), edge(F.col("b") + 1).alias("e"), "y.p1", "y.p2", "y.v")
    return cold.unionByName(parts).unionByName(cover)


def state_history(rows: DataFrame, tolerance_us: int = 1_000_000, hot: int = HOT) -> DataFrame:
    """Every state of every key with the period in which it was valid: k, from_us, until_us (null: open), v.

    ``rows`` as from :func:`reports`.  At each instant the covering report with the highest (p1, p2) wins;
    of equal ranks the one that began later, so repeated rows change nothing.  Stretches of one value at
    most ``tolerance_us`` apart, with no other value between, are one period.  An empty table gives none.

    Plan: one shuffle to (key, bucket), a sort, and a streaming sweep over Arrow batches.  Keys with over
    ``hot`` reports are cut into time buckets, so the largest group is bounded; only the first and last
    stretch of a bucket are looked at again to join neighbours.
    """
    pieces = _bucketed(rows, hot)
    swept = pieces.repartition("k", "b").sortWithinPartitions("k", "b", "s", "p1", "p2").mapInArrow(_sweep(tolerance_us), SEGMENTS)
    inner = swept.where("n = 1 OR NOT (first OR last)").select("k", F.col("s").alias("from_us"), F.col("e").alias("until_us"), "v")
    order = Window.partitionBy("k").orderBy("s")
    joins = (F.lag("b").over(order) != F.col("b")) & (F.lag("v").over(order) == F.col("v")) & (F.col("s") - F.lag("e").over(order) <= tolerance_us)
    edges = swept.where("n > 1 AND (first OR last)").withColumn("new", F.when(joins, 0).otherwise(1)).withColumn("run", F.sum("new").over(order))
    edges = edges.groupBy("k", "run").agg(F.min("s").alias("from_us"), F.max("e").alias("until_us"), F.first("v").alias("v")).drop("run")
    whole = inner.unionByName(edges)
    return whole.withColumn("until_us", F.when(F.col("until_us") < OPEN_US, F.col("until_us")))


#: Reports of a bucket of the store, about.
BUCKET_ROWS = 250_000


class ChainStore:
    """Raw reports and the chains built from them, in a folder that all executors share.

    ``apply`` takes a batch of late or corrected reports: it finds the touched keys, reads only their raw
    reports, rebuilds all their intervals and replaces those chains at once.  Data lie in hash buckets, as many as
    the first batch asks for (BUCKET_ROWS reports each, 32 at least; the manifest keeps the number); a
    manifest names the folders that make up each bucket and is replaced by one rename, so a reader sees the
    chains before or after a batch, never between, and a job that dies leaves the old state.
    """

    def __init__(self, spark: SparkSession, path: str, buckets: int | None = None, tolerance_us: int = 1_000_000, hot: int = HOT):
        self.spark, self.path, self.buckets, self.tolerance_us, self.hot = spark, path.rstrip("/"), buckets, tolerance_us, hot

    def _fs(self, name: str):
        jvm = self.spark._jvm
        path = jvm.org.apache.hadoop.fs.Path(f"{self.path}/{name}")
        return path, path.getFileSystem(self.spark._jsc.hadoopConfiguration())

    def _manifest(self) -> dict:
        path, fs = self._fs("MANIFEST")
        if not fs.exists(path):
            return {"raw": {}, "chains": {}}
        stream = fs.open(path)
        try:
            return json.loads(bytes(self.spark._jvm.org.apache.commons.io.IOUtils.toByteArray(stream)).decode())
        finally:
            stream.close()

    def _publish(self, manifest: dict) -> None:
        data = json.dumps(manifest)
        target, fs = self._fs("MANIFEST")
        if fs.getUri().getScheme() == "file":  # the file system that _manifest reads, whatever the path says
            folder = os.path.dirname(fs.makeQualified(target).toUri().getPath())
            temporary = f"{folder}/MANIFEST.{uuid.uuid4().hex}"
            os.makedirs(folder, exist_ok=True)
            with open(temporary, "w") as out:
                out.write(data)
                out.flush()
                os.fsync(out.fileno())
            os.replace(temporary, f"{folder}/MANIFEST")
            return
        temporary, fs = self._fs(f"MANIFEST.{uuid.uuid4().hex}")
        out = fs.create(temporary, True)
        out.write(bytearray(data.encode()))
        out.close()
        jvm = self.spark._jvm
        context = jvm.org.apache.hadoop.fs.FileContext.getFileContext(self.spark._jsc.hadoopConfiguration())
        options = self.spark.sparkContext._gateway.new_array(jvm.org.apache.hadoop.fs.Options.Rename, 1)
        options[0] = jvm.org.apache.hadoop.fs.Options.Rename.OVERWRITE
        context.rename(temporary, self._fs("MANIFEST")[0], options)

    def _write(self, df: DataFrame, name: str, buckets: int) -> dict[str, list[str]]:
        """Folders by bucket.  Rebalancing splits a bucket with a hot key into tasks of the advised size, and joins small ones."""
        at = f"{self.path}/{name}-{uuid.uuid4().hex}"
        df.withColumn("h", F.pmod(F.xxhash64("k"), F.lit(buckets)).cast("int")).hint("rebalance", "h").write.partitionBy("h").parquet(at)
        path, fs = self._fs(at[len(self.path) + 1 :])
        found = [s.getPath().getName() for s in fs.listStatus(path) if s.getPath().getName().startswith("h=")]
        return {x[2:]: [f"{at}/{x}"] for x in found}

    def _read(self, folders: list[str], schema: str) -> DataFrame:
        if not folders:
            return self.spark.createDataFrame([], schema)
        return self.spark.read.schema(schema).parquet(*folders)

    RAW = "k string, s bigint, e bigint, p1 bigint, p2 bigint, v string"
    CHAINS = "k string, from_us bigint, until_us bigint, v string"

    def apply(self, batch: DataFrame) -> None:
        """Add reports and bring the chains of the touched keys up to date."""
        manifest = self._manifest()
        batch = batch.select("k", "s", "e", "p1", "p2", "v")
        buckets = manifest.get("buckets") or self.buckets or max(32, -(-batch.count() // BUCKET_ROWS))
        fresh = self._write(batch, "raw", buckets)
        touched = self._read([x for y in fresh.values() for x in y], self.RAW).select("k").distinct()
        raw = {h: manifest["raw"].get(h, []) + fresh.get(h, []) for h in {*manifest["raw"], *fresh}}
        old = [x for h in fresh for x in manifest["chains"].get(h, [])]
        reached = self._read([x for h in fresh for x in raw[h]], self.RAW)
        if old:
            reached = reached.join(touched, "k", "left_semi")
        rebuilt = state_history(reached, self.tolerance_us, self.hot)
        if old:
            rebuilt = self._read(old, self.CHAINS).join(touched, "k", "left_anti").unionByName(rebuilt)
        chains = {h: x for h, x in manifest["chains"].items() if h not in fresh} | self._write(rebuilt, "chains", buckets)
        self._publish({"buckets": buckets, "raw": raw, "chains": chains})

    def chains(self) -> DataFrame:
        """The chains as of the last batch: k, from_us, until_us (null: open), v."""
        return self._read([x for y in self._manifest()["chains"].values() for x in y], self.CHAINS)
