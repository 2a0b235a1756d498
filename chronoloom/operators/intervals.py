"""Continuous periods and gaps of intervals per key."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from chronoloom.tables import micros, scratch

#: 9999-12-31 00:00:00 UTC in microseconds: the end of what is still open.
OPEN_US = 253402214400000000
DAY_US = 86_400_000_000


def periods_and_gaps(df: DataFrame, key: str, start: str, end: str, tolerance_us: int = 1_000_000, bucket_days: int = 64) -> DataFrame:
    """Merge the half-open intervals of each key; list the periods and the holes between them.

    Returns ``key, kind ('period' | 'gap'), from_us, until_us`` (microseconds since 1970 UTC, until_us null
    where a period is open).  A null end is open.  Rows with a null key or start, or whose end isn't after
    the start, cover nothing; a key that has only such rows doesn't come out, nor does anything from an
    empty table.  Repeated rows change nothing.  Holes of at most ``tolerance_us`` are closed.

    Plan: intervals are put into time buckets by their start, so that a key with a third of all rows is
    many groups.  session_window with each row's own duration (plus the tolerance) merges every group,
    partly before the shuffle; after that all work is on merged periods.  Three window passes join the
    buckets: the latest end of earlier buckets is carried into a bucket, a period starts where it isn't
    reached, and the last start of a bucket takes its end from the next bucket that has one.  Only one row
    per key and bucket ever meets in a window over a whole key.
    """
    rows = scratch(df, k=F.col(key), s=micros(df, start), e=F.least(F.coalesce(micros(df, end), F.lit(OPEN_US)), F.lit(OPEN_US)))
    rows = rows.where("k IS NOT NULL AND s IS NOT NULL AND e > s").withColumn("b", F.floor(F.col("s") / F.lit(bucket_days * DAY_US)))
    seconds = ((F.col("e") - F.col("s") + F.lit(tolerance_us)).cast("decimal(20,0)") / F.lit(1_000_000).cast("decimal(7,0)")).cast("decimal(18,6)")
    zero = F.lit(0)
    merged = (
        rows.withColumn("t", F.timestamp_micros("s"))
        .groupBy("k", "b", F.session_window("t", F.make_interval(zero, zero, zero, zero, zero, zero, seconds)).alias("w"))
        .agg(F.max("e").alias("e"))
        .select("k", "b", F.unix_micros("w.start").alias("s"), "e")
    )
    by_key = Window.partitionBy("k").orderBy("b")
    reach = merged.groupBy("k", "b").agg(F.max("e").alias("m"))
    reach = reach.select("k", "b", F.max("m").over(by_key.rowsBetween(Window.unboundedPreceding, -1)).alias("carry"), F.max("m").over(Window.partitionBy("k")).alias("last"))
    here = Window.partitionBy("k", "b").orderBy("s")
    starts = (
        merged.join(reach, ["k", "b"])
        .withColumn("p", F.greatest("carry", F.lag("e").over(here)))
        .where(F.col("p").isNull() | (F.col("s") - F.col("p") > tolerance_us))
        .withColumn("n", F.lead("p").over(here))
        .withColumn("first_p", F.first("p").over(here.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)))
        .select("k", "b", "s", "p", "n", "first_p", "last")
    )
    edge = starts.where("n IS NULL").withColumn("n", F.coalesce(F.lead("first_p").over(by_key), "last"))
    whole = starts.where("n IS NOT NULL").unionByName(edge)
    period = F.struct(F.lit("period").alias("kind"), F.col("s").alias("f"), F.col("n").alias("u"))
    gap = F.struct(F.lit("gap").alias("kind"), F.col("p").alias("f"), F.col("s").alias("u"))
    return (
        whole.select("k", F.explode(F.when(F.col("p").isNull(), F.array(period)).otherwise(F.array(period, gap))).alias("x"))
        .select(F.col("k").alias(key), "x.kind", F.col("x.f").alias("from_us"), F.when(F.col("x.u") < OPEN_US, F.col("x.u")).alias("until_us"))
    )
