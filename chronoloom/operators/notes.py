"""Notes that link and evolve: keywords, links by similarity, growth, search, forgetting."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from chronoloom.functions import scores
from chronoloom.functions import text as T
from chronoloom.operators import graph as G
from chronoloom.session import settle


def notes(items: DataFrame) -> DataFrame:
    """id, keywords, strength of items (id, content, access_count): strength 1, half a point an access, at most 10."""
    strength = F.least(F.lit(10.0), 1.0 + 0.5 * F.coalesce("access_count", F.lit(0)))
    return items.where("content IS NOT NULL").select("id", T.note_keywords(F.col("content")).alias("keywords"), strength.alias("strength"))


#: A level of words is worth its pass if it leaves so many times the groups of the level above.
FINER = 2


def _levels(sets: DataFrame, vocabulary: DataFrame) -> list[int]:
    """Least word numbers of the levels, the finest (every word) first: words rarer than those are left out of a level."""
    top = vocabulary.agg(F.max("c")).first()[0] or 0
    counts = [top // 2**i for i in range(1, 12) if top // 2**i > 1]
    if not counts:
        return [-1]
    least = vocabulary.agg(*[F.min(F.when(F.col("c") > c, F.col("k"))).alias(f"k{c}") for c in counts]).first()
    least = [least[f"k{c}"] for c in counts]
    groups = sets.agg(*[F.approx_count_distinct(F.xxhash64(_from("sig", k), "z")).alias(f"g{i}") for i, k in enumerate(least)]).first()
    kept, last = [], 0
    for i, k in enumerate(least):
        if groups[i] >= FINER * last:
            kept, last = [k, *kept], groups[i]
    return [-1, *kept]


def _from(sig: str, least: int) -> Column:
    return F.filter(sig, lambda k: k >= least)


def _best(rows: DataFrame, most: int) -> DataFrame:
    """g, best: the ``most`` best notes (s, r) of each group as a list (m = -s, r); a note may come twice, its better score counts."""
    w = Window.partitionBy("g").orderBy(F.desc("s"), "r")
    few = rows.withColumn("n", F.row_number().over(w)).where(F.col("n") <= 2 * most)
    once = few.groupBy("g", "r").agg(F.max("s").alias("s"))
    return once.groupBy("g").agg(F.slice(F.array_sort(F.collect_list(F.struct((-F.col("s")).alias("m"), "r"))), 1, most).alias("best"))


def _level(groups: DataFrame, above: DataFrame | None, band: int | None, least: int, most: int) -> DataFrame:
    """g, best of each group (g, sig, z, ids) of a level: its best notes by the words of the level.

    ``above``: sig, z, best of the next coarser level, whose least word is ``band``.  Two groups without a common word
    below it are as near as the groups above them are, so only those with one are compared, once, at the rarest
    common word; what doesn't come before the last note of the list from above isn't looked at.
    """
    own = groups.select("g", "sig", "z", F.size("sig").alias("n"))
    if above is None:
        own = own.withColumn("best", F.array().cast("array<struct<m:double,r:bigint>>"))
    else:
        up = above.select(F.col("sig").alias("up"), "z", "best")
        own = own.withColumn("up", _from("sig", band)).join(up, ["up", "z"], "left").drop("up")
        own = own.withColumn("best", F.coalesce("best", F.array().cast("array<struct<m:double,r:bigint>>")))
    full, last = F.size("best") >= most, F.element_at("best", -1)
    own = own.withColumn("floor", F.when(full, -last["m"]).otherwise(0.0)).withColumn("edge", F.when(full, last["r"]).otherwise(2**63 - 1))
    need = F.greatest(F.lit(least), F.ceil(F.col("floor") * F.col("z") - 1e-9).cast("int"))
    below = F.lit(True) if band is None else F.col("w") < band
    head = F.when(F.col("n") >= need, F.slice("sig", F.lit(1), F.greatest(F.lit(0), F.col("n") - need + 1)))
    asks = own.select("g", F.col("sig").alias("xs"), F.col("z").alias("xz"), F.col("n").alias("xn"), "floor", "edge", F.posexplode(head).alias("xp", "w")).where(below)
    has = groups.select(F.col("sig").alias("ys"), F.col("z").alias("yz"), F.size("sig").alias("yn"), "ids", F.posexplode("sig").alias("yp", "w")).where(below)
    room = F.least(F.col("xn") - F.col("xp"), F.col("yn") - F.col("yp"))
    score = lambda common: common / (F.col("xz") + F.col("yz") - common)
    ahead = lambda s, r: (s > F.col("floor")) | ((s == F.col("floor")) & (r < F.col("edge")))
    met = asks.join(has, "w").where((room >= least) & ahead(score(room), F.col("ids")[0]))
    # a generator, so that filters don't work the common words out again
    met = met.select("g", "w", "xz", "yz", "floor", "edge", "ids", F.explode(F.array(F.array_intersect("xs", "ys"))).alias("both"))
    met = met.where((F.size("both") >= least) & (F.element_at("both", 1) == F.col("w"))).withColumn("s", score(F.size("both")))
    found = met.where(ahead(F.col("s"), F.col("ids")[0])).select("g", "floor", "edge", "s", F.explode("ids").alias("r")).where(ahead(F.col("s"), F.col("r"))).select("g", "s", "r")
    kept = own.select("g", F.explode("best").alias("b")).select("g", (-F.col("b.m")).alias("s"), "b.r")
    return settle(_best(found.unionByName(kept), most))


def keyword_links(rows: DataFrame, least: int = 2, most: int = 10) -> DataFrame:
    """a, b, score (Jaccard) of notes that share at least ``least`` keywords, the ``most`` best of each, exactly.

    ``rows``: id, keywords.  Of equal scores the smaller id comes first.  Null and short lists link to nobody.

    Plan: notes are numbered in the order of their ids and words by rarity; notes with the same keywords are one set
    with its smallest numbers, so copies pair up nowhere.  Sets with the same number of words and the same frequent
    words are one group, and these form levels, from the few groups of the most frequent words down to the sets:
    sets that share frequent words alone, which are most pairs, are found through their groups' lists, and only
    those with a rarer word in common are compared, in the join at that word.  What is shuffled are groups by their
    words and the best notes of each, never pairs.
    """
    own = rows.where("id IS NOT NULL AND keywords IS NOT NULL").select("id", F.array_sort(F.array_distinct("keywords")).alias("ws")).where(F.size("ws") >= least)
    own = settle(own.orderBy("id").select("id", "ws", F.monotonically_increasing_id().alias("r")))
    first = Window.partitionBy("ws").orderBy("r")
    ranked = own.select("ws", "r").withColumn("n", F.row_number().over(first)).where(F.col("n") <= most + 1)
    named = settle(ranked.groupBy("ws").agg(F.min("r").alias("set"), F.array_sort(F.collect_list("r")).alias("ids")))
    word = named.select("set", F.explode("ws").alias("w"))
    vocabulary = settle(word.groupBy("w").agg(F.count(F.lit(1)).alias("c")).orderBy("c", "w").select("w", "c", F.monotonically_increasing_id().alias("k")))
    coded = word.join(vocabulary.select("w", "k"), "w").groupBy("set").agg(F.array_sort(F.collect_list("k")).alias("sig"))
    sets = settle(named.select("set", "ids").join(coded, "set").select("set", "ids", "sig", F.size("sig").alias("z")))
    levels = _levels(sets, vocabulary)
    groups = [sets.select(F.col("set").alias("g"), "sig", "z", "ids")]
    for k in levels[1:]:
        merged = groups[-1].select("g", _from("sig", k).alias("sig"), "z", "ids").groupBy("sig", "z")
        groups.append(settle(merged.agg(F.min("g").alias("g"), F.slice(F.array_sort(F.flatten(F.collect_list("ids"))), 1, most + 1).alias("ids"))))
    found = None
    for i in reversed(range(len(levels))):
        above = found and groups[i + 1].select("g", "sig", "z").join(found, "g").select("sig", "z", "best")
        found = _level(groups[i], above, levels[i + 1] if found else None, least, most + 1)
    best = found.withColumnRenamed("g", "set")
    members = own.select("ws", "r").join(named.select("ws", "set"), "ws").select("r", "set")
    links = members.withColumnRenamed("r", "x").join(best, "set").select("x", F.slice(F.filter("best", lambda b: b["r"] != F.col("x")), 1, most).alias("best"))
    links = links.select("x", F.explode("best").alias("z")).select("x", F.col("z.r").alias("y"), (-F.col("z.m")).alias("score"))
    links = links.join(own.select(F.col("r").alias("y"), F.col("id").alias("b")), "y").select("x", "b", "score")
    return links.join(own.select(F.col("r").alias("x"), F.col("id").alias("a")), "x").select("a", "b", "score").where("a != b")


def grow(rows: DataFrame, links: DataFrame, most: int = 3) -> DataFrame:
    """id, keywords: each note takes up to ``most`` keywords of its best link that it hasn't got."""
    best = links.groupBy("a").agg(F.max_by("b", F.struct("score", "b")).alias("b"))
    other = rows.select(F.col("id").alias("b"), F.col("keywords").alias("more"))
    new = best.join(other, "b").select(F.col("a").alias("id"), "more")
    return rows.join(new, "id", "left").select("id", F.when(F.col("more").isNull(), F.col("keywords")).otherwise(F.array_union("keywords", F.slice(F.array_except("more", "keywords"), 1, most))).alias("keywords"))


def search(rows: DataFrame, links: DataFrame | Callable[[], DataFrame], query: str, k: int) -> DataFrame:
    """id, score: notes with a query keyword 1, their links 0.5, and those' links 0.25.

    ``links``: a, b, or a function that gives them; where k notes have a keyword, no link can come before one of
    them, and the function isn't called.
    """
    asked = [w for w in query.lower().split() if len(w) > 3 and w not in T.NOTE_STOP_WORDS]
    seeds = (rows.where(F.arrays_overlap("keywords", T.array_of(asked))) if asked else rows.limit(0)).where("id IS NOT NULL").select("id")
    if callable(links):
        first = settle(seeds.distinct().orderBy("id").limit(k))
        if first.count() >= k:
            return first.select("id", F.lit(1.0).alias("score")).orderBy("id")
        links = settle(links())
    both = links.select("a", "b").union(links.select("b", "a"))
    return G.link_search(seeds, both).orderBy(F.desc("score"), "id").limit(k)


def retained(rows: DataFrame, last: DataFrame, now: Column, least: float = 0.2) -> DataFrame:
    """id, retention of notes that aren't forgotten; ``last``: id, at of the last access (one after now counts as now)."""
    hours = F.greatest(F.unix_seconds(now) - F.unix_seconds("at"), F.lit(0)) / 3600.0
    return rows.join(last, "id").select("id", scores.retention(hours, F.col("strength")).alias("retention")).where(F.col("retention") >= least)
