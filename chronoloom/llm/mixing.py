"""Mixing sources to target weights along a time-varying curriculum."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from chronoloom.llm.tokens import VOCABULARY, count_tokens
from chronoloom.session import settle

#: Documents of a bucket of the order within a source, about; a running sum is over bucket totals, then within one bucket.
BUCKET = 100_000
#: A schedule: weights at equidistant times from 0 to 1, linear between; only their ratio counts.
FLAT = (1.0, 1.0)


def cumulative(schedule: tuple[float, ...]) -> list[float]:
    """The integral of a schedule up to each of its knots, 1 at the end."""
    steps = [(a + b) / 2 for a, b in zip(schedule, schedule[1:])]
    total = sum(steps)
    if total <= 0 or min(schedule) < 0:
        raise ValueError("a schedule needs weights of at least 0, not all 0")
    out = [0.0]
    for s in steps:
        out.append(out[-1] + s / total)
    out[-1] = 1.0
    return out


def invert(u: Column, schedule: tuple[float, ...]) -> Column:
    """The time at which the schedule's cumulative demand reaches u (0 to 1): a quadratic on each stretch."""
    at, n = cumulative(schedule), len(schedule) - 1
    scale = 1 / sum((a + b) / 2 for a, b in zip(schedule, schedule[1:]))
    found = F.lit(1.0)
    for i in range(n - 1, -1, -1):
        a, slope = schedule[i] * scale, (schedule[i + 1] - schedule[i]) * scale  # demand a + slope x, x from 0 to 1
        v = F.greatest(u - F.lit(at[i]), F.lit(0.0))
        x = v / a if abs(slope) < 1e-12 and a > 0 else (F.sqrt(F.lit(a * a) + 2 * slope * v) - a) / slope if abs(slope) >= 1e-12 else F.lit(0.0)
        t = (F.lit(float(i)) + F.least(F.greatest(x, F.lit(0.0)), F.lit(1.0))) / n
        found = t if i == n - 1 else F.when(u < at[i + 1], t).otherwise(found)
    return found


def sized(documents: DataFrame, vocabulary: str = VOCABULARY) -> DataFrame:
    """doc_id, source, tokens of documents that have any token."""
    rows = documents.select("doc_id", "source", "text").where("text IS NOT NULL AND text != ''")
    return count_tokens(rows, "text", "tokens", vocabulary).where("tokens > 0")


def plan_shares(sizes: DataFrame, targets: DataFrame, budget: int | None = None) -> list[dict]:
    """Per source of the targets: available tokens, demand and repeats.  The targets are a short list, collected.

    Sources without documents have no demand, and their share goes to the others in proportion.  Without a
    ``budget`` the mix is as large as the caps on repeats allow at exact shares; with one, a source that its
    cap keeps below its share gives what it can, and the rest is spread over the others (water filling).
    """
    have = {r["source"]: r["t"] for r in sizes.join(targets.select("source").distinct(), "source", "left_semi").groupBy("source").agg(F.sum("tokens").alias("t")).collect()}
    rows = targets.where("source IS NOT NULL AND target_share > 0").groupBy("source").agg(F.max("target_share").alias("share"), F.max(F.coalesce("max_repeats", F.lit(1))).alias("repeats")).orderBy("source").collect()
    plan = [{"source": r["source"], "share": r["share"], "repeats": max(int(r["repeats"]), 0), "have": int(have.get(r["source"]) or 0), "demand": 0.0} for r in rows]
    open_ = [p for p in plan if p["have"] and p["repeats"]]
    weight = sum(p["share"] for p in open_)
    if not open_:
        return plan
    if budget is None:
        budget = math.floor(min(p["have"] * p["repeats"] * weight / p["share"] for p in open_))
    left = float(budget)
    while open_ and left > 0:
        weight = sum(p["share"] for p in open_)
        full = [p for p in open_ if p["share"] / weight * left > p["have"] * p["repeats"]]
        if not full:
            for p in open_:
                p["demand"] = p["share"] / weight * left
            break
        for p in full:
            p["demand"] = float(p["have"] * p["repeats"])
            left -= p["demand"]
            open_.remove(p)
    return plan


def mix(documents: DataFrame, targets: DataFrame, schedules: dict[str, tuple[float, ...]] | None = None, budget: int | None = None, vocabulary: str = VOCABULARY) -> DataFrame:
    """The mix in training order: position (0 to 1), doc_id, source, repeat (from 1), tokens.

    Each source's documents are laid out in a hashed order, once per repeat, until its demand in tokens is
    met: a document is taken if its middle lies within the demand, so a source misses its share by at most
    half a document.  A document's place in its source's demand, sent through the inverse of the cumulative
    schedule, is its position; the mix is range-sorted by it.  Documents without source, of sources without
    target, and without tokens take no part.  Empty tables give an empty mix.

    Plan: tokens are counted in a map and written once.  Running sums are over bucket totals per source (one row
    for BUCKET documents) and within one bucket, so a source with a third of all rows is many groups; the
    final sort is a range exchange.
    """
    sizes = settle(sized(documents, vocabulary))
    return _lay_out(sizes, plan_shares(sizes, targets, budget), schedules or {})


def _lay_out(sizes: DataFrame, plan: list[dict], schedules: dict[str, tuple[float, ...]]) -> DataFrame:
    spark = sizes.sparkSession
    wanted = [(p["source"], p["demand"], p["have"]) for p in plan if p["demand"] > 0]
    rows = sizes.join(spark.createDataFrame(wanted, "source string, demand double, have bigint"), "source")
    buckets = max(1, math.ceil(sizes.count() / BUCKET))
    # every repeat is a layer of its own with another order; layer r covers [r have, (r + 1) have)
    rows = rows.withColumn("layer", F.explode(F.expr("sequence(0, cast(greatest(ceil(demand / have), 1) as int) - 1)")))
    rows = rows.withColumn("h", F.xxhash64("doc_id", "layer", F.lit("mix"))).withColumn("b", F.pmod("h", F.lit(buckets)))
    totals = rows.groupBy("source", "layer", "b").agg(F.sum("tokens").alias("s"))
    before = Window.partitionBy("source", "layer").orderBy("b").rowsBetween(Window.unboundedPreceding, -1)
    totals = totals.select("source", "layer", "b", F.coalesce(F.sum("s").over(before), F.lit(0)).alias("base"))
    within = Window.partitionBy("source", "layer", "b").orderBy("h", "doc_id").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    rows = rows.join(totals, ["source", "layer", "b"]).withColumn("upto", F.col("base") + F.sum("tokens").over(within))
    middle = F.col("layer") * F.col("have") + F.col("upto") - F.col("tokens") / 2
    rows = rows.withColumn("u", middle / F.col("demand")).where("u < 1")
    position = invert(F.col("u"), FLAT)
    for source, schedule in schedules.items():
        position = F.when(F.col("source") == source, invert(F.col("u"), tuple(schedule))).otherwise(position)
    return rows.select(position.alias("position"), "doc_id", "source", (F.col("layer") + 1).alias("repeat"), "tokens").orderBy("position", "doc_id", "repeat")


def shares(documents: DataFrame, targets: DataFrame, schedules: dict[str, tuple[float, ...]] | None = None, budget: int | None = None, vocabulary: str = VOCABULARY) -> DataFrame:
    """Per target: source, target_share, max_repeats, available_tokens, documents, tokens, actual_share, most_repeats."""
    sizes = settle(sized(documents, vocabulary))
    plan = plan_shares(sizes, targets, budget)
    rows = _lay_out(sizes, plan, schedules or {})
    per_document = rows.groupBy("source", "doc_id").agg(F.sum("tokens").alias("tokens"), F.max("repeat").alias("r"))
    used = per_document.groupBy("source").agg(F.count(F.lit(1)).alias("documents"), F.sum("tokens").alias("tokens"), F.max("r").alias("most_repeats"))
    known = sizes.sparkSession.createDataFrame([(p["source"], p["share"], p["repeats"], p["have"]) for p in plan], "source string, target_share double, max_repeats int, available_tokens bigint")
    out = known.join(used, "source", "left")
    total = F.sum("tokens").over(Window.partitionBy())  # over one row per target
    zero = lambda c, kind: F.coalesce(c, F.lit(0)).cast(kind).alias(c)
    return out.withColumn("actual_share", F.coalesce(F.col("tokens") / total, F.lit(0.0))).select("source", "target_share", "max_repeats", "available_tokens", zero("documents", "bigint"), zero("tokens", "bigint"), "actual_share", zero("most_repeats", "int"))
