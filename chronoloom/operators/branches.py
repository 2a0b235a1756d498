"""Branches as a log of operations: diff, merge, visibility.

The log has branch, seq, op ('add' | 'remove'), kind and id; branches have branch, parent, status.  The last
operation on an id within a branch counts.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

MAIN = "main"
MOST_OPEN = 100


def create(branches: DataFrame, name: str, parent: str) -> DataFrame:
    """The branch table with one more open branch; the parent must exist, and at most MOST_OPEN are open."""
    open_, there = branches.agg(F.count_if(F.col("status") == "open"), F.count_if(F.col("branch") == parent)).first()
    if not there:
        raise ValueError(f"no branch {parent}")
    if open_ >= MOST_OPEN:
        raise ValueError("too many open branches")
    return branches.unionByName(branches.sparkSession.createDataFrame([(name, parent, "open")], "branch string, parent string, status string"), allowMissingColumns=True)


def abandon(branches: DataFrame, name: str) -> DataFrame:
    if name == MAIN:
        raise ValueError("the main branch can't be abandoned")
    return branches.withColumn("status", F.when(F.col("branch") == name, "abandoned").otherwise(F.col("status")))


def delta(log: DataFrame) -> DataFrame:
    """branch, kind, id, op: the last operation on each id of a branch."""
    return log.groupBy("branch", "kind", "id").agg(F.max_by("op", "seq").alias("op"))


def diff(log: DataFrame, source: str, target: str) -> DataFrame:
    """kind, id, op of what ``source`` has that ``target`` hasn't done itself."""
    d = delta(log)
    return d.where(F.col("branch") == source).join(d.where(F.col("branch") == target).select("kind", "id", "op"), ["kind", "id", "op"], "left_anti").select("kind", "id", "op")


def conflicts(log: DataFrame, source: str, target: str) -> DataFrame:
    """kind, id, source_op, target_op: ids that one branch adds and the other removes."""
    d = delta(log)
    s = d.where(F.col("branch") == source).select("kind", "id", F.col("op").alias("source_op"))
    return s.join(d.where(F.col("branch") == target).select("kind", "id", F.col("op").alias("target_op")), ["kind", "id"]).where("source_op != target_op")


def merge(log: DataFrame, source: str, target: str) -> DataFrame:
    """The log with the source's deltas played onto the target; the source's operations come last and win."""
    top = log.agg(F.coalesce(F.max("seq"), F.lit(0)).alias("m"))
    more = diff(log, source, target).crossJoin(F.broadcast(top)).select(F.lit(target).alias("branch"), (F.col("m") + 1).alias("seq"), "op", "kind", "id")
    return log.select("branch", "seq", "op", "kind", "id").unionByName(more)


def visible(log: DataFrame, branches: DataFrame, branch: str, base: DataFrame, kind: str = "entity", depth: int = 20) -> DataFrame:
    """ids seen on a branch: added and not removed on the nearest branch up the line; else those of ``base`` (id)."""
    line = branches.where(F.col("branch") == branch).select("branch", "parent", F.lit(0).alias("d"))
    step = line
    for d in range(1, depth):
        step = step.select(F.col("parent").alias("branch")).where("branch IS NOT NULL").join(branches.select("branch", "parent"), "branch").select("branch", "parent", F.lit(d).alias("d"))
        if step.limit(1).count() == 0:
            break
        line = line.unionByName(step)
    near = delta(log).where(F.col("kind") == kind).join(line.select("branch", "d"), "branch").groupBy("id").agg(F.min_by("op", "d").alias("op"))
    return base.select("id").join(near, "id", "full").where("op IS NULL OR op = 'add'").select("id").distinct()
