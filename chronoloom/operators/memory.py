"""Tiers, decay, notes and sagas of an agent's memory."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from chronoloom.functions import scores
from chronoloom.functions import text as T
from chronoloom.session import settle

#: Vectors of a block and of a tile of near_pairs; the largest error of a cosine in single precision, with room.
BLOCK, TILE, UNSURE = 12_288, 2048, 1e-5
#: What a hit in each tier counts in search.
TIER_WEIGHTS = {"working": 4.0, "episodic": 2.0, "semantic": 1.5, "procedural": 1.0}


def next_tier(tier: Column, access: Column, importance: Column, idle_hours: Column) -> Column:
    """One round of upkeep: working to episodic at 3 accesses; episodic to semantic at 10 and importance 0.6, or
    evicted after 168 idle hours below 0.3; semantic to procedural at 50."""
    return (
        F.when((tier == "working") & (access >= 3), "episodic").when((tier == "episodic") & (access >= 10) & (importance >= 0.6), "semantic")
        .when((tier == "episodic") & (idle_hours > 168) & (importance < 0.3), "evicted").when((tier == "semantic") & (access >= 50), "procedural").otherwise(tier)
    )


def keep_best(df: DataFrame, group: str, order: str, n: int) -> DataFrame:
    """The n rows of each group that are first by ``order``; others overflow.  Limited before the shuffle."""
    w = Window.partitionBy(group).orderBy(F.desc(order), "id")
    return df.withColumn("_r", F.row_number().over(w)).where(F.col("_r") <= n).drop("_r")


def overflow(df: DataFrame, n: int) -> DataFrame:
    """working items beyond the n last used ones become episodic."""
    w = Window.partitionBy("tier").orderBy(F.desc("last_accessed"), "id")
    last = df.where("tier = 'working'").withColumn("_r", F.row_number().over(w)).where(F.col("_r") <= n).select("id", F.lit(True).alias("kept"))
    return df.join(last, "id", "left").withColumn("tier", F.when((F.col("tier") == "working") & F.col("kept").isNull(), "episodic").otherwise(F.col("tier"))).drop("kept")


def tier_search(df: DataFrame, query: str, k: int) -> DataFrame:
    """id, tier, score: share of query words found, times the tier's weight."""
    weight = F.coalesce(F.element_at(F.create_map(*[F.lit(x) for kv in TIER_WEIGHTS.items() for x in kv]), F.col("tier")), F.lit(1.0))
    return df.select("id", "tier", (T.text_match(F.col("content"), F.lit(query)) * weight).alias("score")).where("score > 0").orderBy(F.desc("score"), "id").limit(k)


def record_access(df: DataFrame, log: DataFrame) -> DataFrame:
    """Items with the accesses of a log (id, at) added."""
    seen = log.groupBy("id").agg(F.count(F.lit(1)).alias("more"), F.max("at").alias("at"))
    return df.join(seen, "id", "left").withColumns({"access_count": F.col("access_count") + F.coalesce("more", F.lit(0)), "last_accessed": F.greatest("last_accessed", "at")}).drop("more", "at")


def saga_steps(df: DataFrame, saga: str, episode: str, at: str) -> DataFrame:
    """Each episode with its place (from 0) and the next one."""
    w = Window.partitionBy(saga).orderBy(at, episode)
    return df.select(saga, episode, F.lead(episode).over(w).alias("next_id"), (F.row_number().over(w) - 1).alias("position"))


def evolve(df: DataFrame, now: Column, decay: str = "exponential", rate: float = 0.01, forget: float = 0.1, cap: int | None = None) -> DataFrame:
    """id, score, kept: composite score, decayed by age in days, forgotten below ``forget`` or beyond the cap.

    ``df``: id, access_count, last_accessed, degree, content.
    """
    hours = F.floor((F.unix_seconds(now) - F.unix_seconds("last_accessed")) / 3600)
    base = scores.composite(F.col("access_count"), hours, F.col("degree"), F.size(T.words_of(F.col("content"))))
    days = hours / 24.0
    factor = {"exponential": F.exp(-rate * days), "linear": F.greatest(F.lit(0.0), 1 - rate * days), "step": F.when(days < 30, 1.0).when(days < 90, 0.5).otherwise(0.25)}[decay]
    out = df.select("id", (base * factor).alias("score")).withColumn("kept", F.col("score") >= forget)
    if cap is not None:
        top = out.where("kept").orderBy(F.desc("score"), "id").limit(cap).select("id", F.lit(True).alias("top"))
        out = out.join(top, "id", "left").select("id", "score", F.coalesce("top", F.lit(False)).alias("kept"))
    return out


def decide(states: DataFrame, table: DataFrame) -> DataFrame:
    """state, keep: the action with the higher value (0.5 where a state is new); keeping wins ties."""
    return states.join(table, "state", "left").select(states["state"], (F.coalesce("q_keep", F.lit(0.5)) >= F.coalesce("q_forget", F.lit(0.5))).alias("keep"))


def learn(log: DataFrame, alpha: float = 0.1, gamma: float = 0.9) -> DataFrame:
    """state, q_keep, q_forget after a log (state, seq, keep, reward) played in order, state by state."""

    def run(frame: pd.DataFrame) -> pd.DataFrame:
        q = [0.5, 0.5]
        for r in frame.sort_values("seq").itertuples():
            a = 0 if r.keep else 1
            q[a] += alpha * (r.reward + gamma * max(q) - q[a])
        return pd.DataFrame({"state": [frame["state"].iloc[0]], "q_keep": [q[0]], "q_forget": [q[1]]})

    return log.groupBy("state").applyInPandas(run, "state string, q_keep double, q_forget double")


def _near(threshold: float) -> Callable[[pa.Table], pa.Table]:
    """One pair of blocks: a < b with a cosine above the threshold; found in single, settled in double precision."""

    def run(block: pa.Table) -> pa.Table:
        r, blk = block.column("r").to_numpy(), block.column("blk").to_numpy()
        v = block.column("v").combine_chunks()
        x = v.flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(len(r), -1)
        x /= np.abs(x).max(axis=1)[:, None]
        x /= np.linalg.norm(x, axis=1)[:, None]
        i, j = block.column("i")[0].as_py(), block.column("j")[0].as_py()
        left, right = np.flatnonzero(blk == i), np.flatnonzero(blk == j)
        y, a, b, c = x.astype(np.float32), [], [], []
        for at in range(0, len(left), TILE):
            for to in range(0 if i != j else at, len(right), TILE):
                p, q = np.nonzero(y[left[at : at + TILE]] @ y[right[to : to + TILE]].T > threshold - UNSURE)
                p, q = left[at + p], right[to + q]
                if i == j:
                    p, q = p[p < q], q[p < q]
                exact = np.einsum("nd,nd->n", x[p], x[q])
                ok = exact > threshold
                a.append(np.minimum(r[p], r[q])[ok])
                b.append(np.maximum(r[p], r[q])[ok])
                c.append(exact[ok])
        empty = [np.zeros(0, np.int64)]
        return pa.table({"a": np.concatenate(a or empty), "b": np.concatenate(b or empty), "c": np.concatenate(c or empty).astype(np.float64)})

    return run


def near_pairs(vectors: DataFrame, threshold: float, block: int = BLOCK) -> DataFrame:
    """a < b, c: all pairs of vectors (r, g, v) of one g and one length whose cosine is above the threshold.

    Exact: vectors are spread over blocks of about ``block`` by hash, and each pair of blocks is one task of
    matrix products, so time grows with the square of the rows and memory doesn't.
    """
    sized = vectors.withColumn("dim", F.size("v"))
    n = sized.groupBy("g", "dim").agg(F.ceil(F.count(F.lit(1)) / block).cast("int").alias("blocks"))
    spread = sized.join(n, ["g", "dim"]).withColumn("blk", F.pmod(F.xxhash64("r"), F.col("blocks")).cast("int"))
    sent = spread.withColumn("to", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
    sent = sent.select("g", "dim", F.least("blk", "to").alias("i"), F.greatest("blk", "to").alias("j"), "r", "blk", "v")
    return sent.groupBy("g", "dim", "i", "j").applyInArrow(_near(threshold), "a bigint, b bigint, c double")


def consolidate(items: DataFrame, group: str | None = None, threshold: float = 0.95) -> DataFrame:
    """id, into: near copies merge into the more important one (then the smaller id), greedily: in that order an
    item goes to the most similar of the kept ones before it, if any is above the threshold, or else is kept.

    ``items``: id, v, importance and the group column, if only items of one group may merge (such as a
    session).  Items of unknown importance come last.  Only vectors of one length are compared; those that
    are null, empty, zero or not finite take no part.

    Plan: rows are numbered in order; copies are one vector with its first number; all pairs are found block
    by block; each round keeps what has no open neighbour before it and removes what is near that.
    """
    usable = "v IS NOT NULL AND forall(v, x -> x IS NOT NULL AND NOT isnan(x) AND abs(x) < double('inf')) AND exists(v, x -> x != 0)"
    last = F.when(F.col("importance").isNull() | F.isnan(F.col("importance").cast("double")), float("inf")).otherwise(F.lit(0.0) - F.col("importance"))
    rows = items.where(usable).select("id", "v", (F.col(group) if group else F.lit("")).alias("g"), last.alias("o"))
    rows = rows.withColumn("g", F.coalesce(F.col("g").cast("string"), F.lit("")))
    rows = settle(rows.orderBy("o", "id").select("id", "g", "v", F.monotonically_increasing_id().alias("r")))
    vectors = rows.groupBy("g", "v").agg(F.min("r").alias("first"))
    members = settle(rows.join(vectors, ["g", "v"]).select("id", "r", "first"))
    pairs = settle(near_pairs(rows.join(members.where("r = first").select("r"), "r", "left_semi"), threshold))

    open_, gone = pairs.select("a", "b"), None
    while not open_.isEmpty():
        kept = open_.select("a").join(open_.select(F.col("b").alias("a")), "a", "left_anti").distinct()
        new = settle(open_.join(kept, "a", "left_semi").select(F.col("b").alias("x")).distinct())
        gone = new if gone is None else gone.unionByName(new)
        left = open_.join(kept, "a", "left_anti").join(new.select(F.col("x").alias("a")), "a", "left_anti")
        open_ = settle(left.join(new.select(F.col("x").alias("b")), "b", "left_anti").select("a", "b"))

    copies = members.where("r != first")
    if gone is None:
        into = copies.select("r", F.col("first").alias("k"))
    else:
        both = pairs.select(F.col("a").alias("first"), F.col("b").alias("k"), "c").unionByName(pairs.select(F.col("b").alias("first"), F.col("a").alias("k"), "c"))
        both = both.join(gone.select(F.col("x").alias("first")), "first", "left_semi").join(gone.select(F.col("x").alias("k")), "k", "left_anti")
        near = members.join(both, "first").where("k < r").groupBy("r").agg(F.min(F.struct((-F.round("c", 12)).alias("m"), "k")).alias("z")).select("r", "z.k")
        into = near.unionByName(copies.join(gone.select(F.col("x").alias("first")), "first", "left_anti").select("r", F.col("first").alias("k")))
    name = members.select("r", "id")
    return into.join(name, "r").select("id", "k").join(name.select(F.col("r").alias("k"), F.col("id").alias("into")), "k").select("id", "into")


def link_notes(pairs: DataFrame, least: float = 0.7, most: int = 10) -> DataFrame:
    """note, links: the ids linked to each note by similarity (id, other, score), both ways."""
    w = Window.partitionBy("id").orderBy(F.desc("score"), "other")
    best = pairs.where(F.col("score") >= least).withColumn("_r", F.row_number().over(w)).where(F.col("_r") <= most)
    both = best.select("id", "other").union(best.select("other", "id")).distinct()
    return both.groupBy(F.col("id").alias("note")).agg(F.array_sort(F.collect_set("other")).alias("links"))


def forget_notes(notes: DataFrame, least: float = 0.2, cap: int = 50_000) -> DataFrame:
    """Notes (id, retention, links) without those below ``least`` or beyond the cap, and without links to them."""
    kept = notes.where(F.col("retention") >= least).orderBy(F.desc("retention"), "id").limit(cap)
    alive = kept.select(F.col("id").alias("link"))
    links = kept.select("id", F.explode("links").alias("link")).join(alive, "link", "left_semi").groupBy("id").agg(F.array_sort(F.collect_list("link")).alias("alive"))
    return kept.join(links, "id", "left").select("id", "retention", F.coalesce("alive", F.array().cast("array<string>")).alias("links"))


def knapsack(df: DataFrame, group: str, budget: int) -> DataFrame:
    """Greedy: in order of score a chunk that would pass the budget is skipped and later ones tried; streams sorted rows."""

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        at, used = None, 0
        for frame in frames:
            out = []
            for g, i, size in zip(frame["g"], frame["id"], frame["size"]):
                if g != at:
                    at, used = g, 0
                if used + size <= budget:
                    used += size
                    out.append((g, i, used))
            yield pd.DataFrame(out, columns=["g", "id", "used"])

    kind, gk = df.schema["id"].dataType.simpleString(), df.schema[group].dataType.simpleString()
    rows = df.select(F.col(group).alias("g"), "id", F.col("size").cast("bigint").alias("size"), "score").repartition("g").sortWithinPartitions("g", F.desc("score"), "id")
    return rows.mapInPandas(run, f"g {gk}, id {kind}, used bigint").withColumnRenamed("g", group)
