"""Validity, snapshots, diffs, chains, interval relations and decay."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from chronoloom.functions import scores


def ts(text: str) -> Column:
    return F.lit(text).cast("timestamp")


def valid_now() -> Column:
    return F.col("expired_at").isNull() & F.col("valid_until").isNull()


def valid_at(at: Column, honour_expired: bool = False) -> Column:
    """Half-open valid time; ``honour_expired`` hides whatever was ever expired."""
    inside = (F.col("valid_from").isNull() | (at >= F.col("valid_from"))) & (F.col("valid_until").isNull() | (at < F.col("valid_until")))
    return inside & F.col("expired_at").isNull() if honour_expired else inside


def known_at(at: Column) -> Column:
    """System time: stored by then, and not yet expired."""
    return (F.col("created_at") <= at) & (F.col("expired_at").isNull() | (at < F.col("expired_at")))


def expired_by_ttl(created: Column, now: Column, days: int | None) -> Column:
    """Strictly older than the time to live; never without one."""
    return F.lit(False) if days is None else now - F.make_dt_interval(F.lit(days)) > created


def snapshot_counts(entities: DataFrame, edges: DataFrame, at: Column) -> DataFrame:
    e = entities.where(F.col("created_at") <= at).agg(F.count(F.lit(1)).alias("n")).select(F.lit("entities").alias("kind"), "n")
    return e.union(edges.where(valid_at(at)).agg(F.count(F.lit(1)).alias("n")).select(F.lit("relationships"), "n"))


def what_changed(entities: DataFrame, edges: DataFrame, start: str, end: str) -> DataFrame:
    """id, change of what was added, modified or invalidated from start to end, both included."""
    if start > end:
        raise ValueError("the range ends before it starts")
    a, b = ts(start), ts(end)
    new, mod = F.col("created_at").between(a, b), F.col("updated_at").between(a, b)
    e = entities.where(new | mod).select("id", F.when(new, "entity_added").otherwise("entity_modified").alias("change"))
    r = edges.where(F.col("created_at").between(a, b)).select("id", F.lit("relationship_added").alias("change"))
    x = edges.where(F.col("expired_at").between(a, b)).select("id", F.lit("relationship_invalidated").alias("change"))
    return e.unionByName(r).unionByName(x)


def timeline(entities: DataFrame) -> DataFrame:
    """Per day of creation: the number of entities and the first three names."""
    # three smallest ids per day: a limit per group, applied before the shuffle
    w = Window.partitionBy("day").orderBy("id")
    rows = entities.select(F.date_format("created_at", "yyyy-MM-dd").alias("day"), "id", "name")
    firsts = rows.withColumn("r", F.row_number().over(w)).where("r <= 3").groupBy("day").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("r", "name"))), lambda z: z["name"]), ", ").alias("names"))
    return rows.groupBy("day").agg(F.count(F.lit(1)).alias("n")).join(firsts, "day")


def version_at(versions: DataFrame, at: Column) -> DataFrame:
    """Per relationship the version valid and not superseded at a time, the latest stored one."""
    inside = (F.col("valid_from") <= at) & (F.col("valid_until").isNull() | (at < F.col("valid_until"))) & (F.col("superseded_at").isNull() | (at < F.col("superseded_at")))
    return versions.where(inside).groupBy("relationship_id").agg(F.max_by(F.struct("version", "fact"), F.struct("created_at", "version")).alias("r")).select("relationship_id", "r.version", "r.fact")


def as_of_join(probes: DataFrame, versions: DataFrame, key: str, at: str, bucket_days: int = 365) -> DataFrame:
    """Per probe (key, at) the latest stored version that is valid then.

    The range is an equi-join on (key, bucket of time): a version is spread over the buckets it covers, so
    a key with many versions is many groups.
    """
    day = lambda c: F.floor(F.unix_seconds(c) / (86400 * bucket_days))
    horizon = F.coalesce(F.col("valid_until"), ts("2100-01-01"))
    spread = versions.where(horizon > F.col("valid_from")).withColumn("_b", F.explode(F.sequence(day(F.col("valid_from")), day(horizon))))
    asked = probes.withColumn("_b", day(F.col(at)))
    hit = asked.join(spread, [key, "_b"]).where((F.col("valid_from") <= F.col(at)) & (F.col(at) < horizon))
    return hit.groupBy(key, at).agg(F.max_by(F.struct("version", "fact"), F.struct("created_at", "version")).alias("r")).select(key, at, "r.version", "r.fact")


def allen(a0: Column, a1: Column, b0: Column, b1: Column) -> Column:
    """Relation of two intervals, an open end being later than all others; the rules in their order."""
    far = ts("9999-12-31")
    a1, b1 = F.coalesce(a1, far), F.coalesce(b1, far)
    return (
        F.when(a1 == b0, "meets").when((a0 == b0) & (a1 < b1), "starts").when((a1 == b1) & (a0 > b0), "finishes").when((a0 >= b0) & (a1 <= b1), "during")
        .when((a0 < b0) & (a1 > b0) & (a1 < b1), "overlaps").when(a1 < b0, "before").otherwise("after")
    )


def temporal_edges(items: DataFrame, window_days: int) -> DataFrame:
    """Neighbours in time: a, b, weight = 1 / (1 + whole hours between the starts / 24).

    ``items``: id, at (start), until, seq (order of arrival, any type that can be ordered).  An item a meets every
    item b that arrived before it and starts from ``window_days`` before a starts to the end of a, or as long
    after its start where a is open.  Items without start meet nobody.

    Plan: a range join as an equi-join on buckets as long as the window; an item looks into all buckets that its
    range touches.  It emits the pairs it is asked for; hot buckets are left to the skew join.
    """
    width = window_days * 86400
    s = lambda c: F.unix_seconds(c)
    rows = items.where("at IS NOT NULL")
    end = F.coalesce(s("until"), s("at") + width)
    x = rows.select(F.col("id").alias("a"), F.col("seq").alias("qa"), s("at").alias("sa"), end.alias("ea")).where(F.col("ea") >= F.col("sa") - width)
    x = x.withColumn("k", F.explode(F.sequence(F.floor((F.col("sa") - width) / width), F.floor(F.col("ea") / width))))
    y = rows.select(F.col("id").alias("b"), F.col("seq").alias("qb"), s("at").alias("sb")).withColumn("k", F.floor(F.col("sb") / width))
    near = x.join(y, "k").where((F.col("qb") < F.col("qa")) & F.col("sb").between(F.col("sa") - width, F.col("ea")))
    return near.select("a", "b", (1.0 / (1.0 + F.floor(F.abs(F.col("sb") - F.col("sa")) / 3600) / 24.0)).alias("weight"))


def decayed(entities: DataFrame, degrees: DataFrame, now: Column, rate: float = 0.001) -> DataFrame:
    """id, importance after decay and boosts; ``degrees``: id, degree."""
    days = F.floor((F.unix_seconds(now) - F.unix_seconds("updated_at")) / 86400)
    e = entities.join(degrees, "id", "left")
    return e.select("id", scores.importance(F.col("importance_score"), days, F.col("access_count"), F.coalesce("degree", F.lit(0)), rate).alias("importance"))
