"""Structured Streaming: windows with late data, stateful access counts, incremental upkeep, stream joins."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from chronoloom.session import shared_path


def read_events(spark: SparkSession, folder: str, name: str = "events.parquet", files_per_batch: int = 8) -> DataFrame:
    """The events table as a stream of files (one file or a folder of files)."""
    schema = spark.read.parquet(f"{folder}/{name}").schema
    stream = spark.readStream.schema(schema).option("maxFilesPerTrigger", files_per_batch).option("recursiveFileLookup", "true")
    return stream.parquet(f"{folder}/{name}*").withColumn("ts", F.col("ts").cast("timestamp"))


def run(stream: DataFrame, mode: str = "append") -> DataFrame:
    """Process what is there, into Parquet in the shared folder, and give that back as a frame."""
    spark = stream.sparkSession
    out = shared_path(spark, "stream")
    query = stream.writeStream.format("parquet").option("path", f"{out}/data").option("checkpointLocation", f"{out}/state").outputMode(mode).trigger(availableNow=True).start()
    query.awaitTermination()
    return spark.read.schema(stream.schema).parquet(f"{out}/data")


def tumbling(events: DataFrame, length: str = "1 day", late: str = "1 hour") -> DataFrame:
    """event_type, start_s, n, total per window; rows later than the watermark are left out in streams."""
    rows = events.withWatermark("ts", late) if events.isStreaming else events
    return rows.groupBy(F.window("ts", length).alias("w"), "event_type").agg(F.count(F.lit(1)).alias("n"), F.sum("value").alias("total")).select("event_type", F.unix_seconds("w.start").alias("start_s"), "n", "total")


def sliding(events: DataFrame, length: str, step: str, late: str = "1 hour") -> DataFrame:
    rows = events.withWatermark("ts", late) if events.isStreaming else events
    return rows.groupBy(F.window("ts", length, step).alias("w"), "event_type").agg(F.count(F.lit(1)).alias("n")).select("event_type", F.unix_seconds("w.start").alias("start_s"), "n")


def sessions(events: DataFrame, gap: str = "30 minutes", late: str = "1 hour") -> DataFrame:
    """user_id, start_us, n per session."""
    rows = events.withWatermark("ts", late) if events.isStreaming else events
    return rows.groupBy("user_id", F.session_window("ts", gap).alias("w")).agg(F.count(F.lit(1)).alias("n")).select("user_id", F.unix_micros("w.start").alias("start_us"), "n")


def access_counts(events: DataFrame, ttl: str | None = None) -> DataFrame:
    """user_id, access_count, tier after each batch: state by key, promoted at 3, 10 and 50 accesses.

    With ``ttl`` (milliseconds as text) the state of a key without events for that long is dropped.
    """

    def step(key: tuple, frames: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        if state.hasTimedOut:
            state.remove()
            return
        n = (state.get[0] if state.exists else 0) + sum(len(f) for f in frames)
        state.update((n,))
        if ttl is not None:
            state.setTimeoutDuration(int(ttl))
        tier = "procedural" if n >= 50 else "semantic" if n >= 10 else "episodic" if n >= 3 else "working"
        yield pd.DataFrame({"user_id": [key[0]], "access_count": [n], "tier": [tier]})

    timeout = GroupStateTimeout.NoTimeout if ttl is None else GroupStateTimeout.ProcessingTimeTimeout
    return events.groupBy("user_id").applyInPandasWithState(step, "user_id bigint, access_count bigint, tier string", "n bigint", "update", timeout)


def keep_up(stream: DataFrame, fold: Callable[[DataFrame, int], None], mode: str = "update") -> None:
    """Run ``fold`` on every batch (an upsert into a store, marking of dirty communities, an index update)."""
    state = shared_path(stream.sparkSession, "keep-up")
    stream.writeStream.foreachBatch(fold).outputMode(mode).option("checkpointLocation", state).trigger(availableNow=True).start().awaitTermination()


def joined(left: DataFrame, right: DataFrame, within: str = "10 minutes", late: str = "1 hour") -> DataFrame:
    """Pairs of events of one user, right after left by at most ``within``: an interval join of two streams."""
    l = left.withWatermark("ts", late).select(F.col("user_id").alias("u"), F.col("event_id").alias("first"), F.col("ts").alias("lt"))
    r = right.withWatermark("ts", late).select("user_id", F.col("event_id").alias("second"), "ts")
    return l.join(r, F.expr(f"u = user_id AND ts > lt AND ts <= lt + INTERVAL {within}")).select("user_id", "first", "second")
