"""Indexes and caches kept up batch by batch: BM25 postings, embeddings, responses; clocks, rules, bounded traversal."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from chronoloom.functions import text as T
from chronoloom.functions import vectors as V
from chronoloom.operators import retrieval as R
from chronoloom.session import settle


def index_add(index: DataFrame | None, docs: DataFrame, key: str, text: str) -> DataFrame:
    """Postings (key, dl, term, tf) after adding documents; a document that is there already is replaced.

    Of repeated keys in the batch the longest text counts.  A null text takes the document out; a text without
    terms keeps one row without term, so that it counts as a document.
    """
    once = docs.where(F.col(key).isNotNull()).groupBy(key).agg(F.max_by(text, F.struct(F.length(text), text)).alias(text))
    rows = once.where(F.col(text).isNotNull()).select(key, T.bm25_tokens(F.col(text)).alias("ws"))
    rows = rows.select(key, F.size("ws").alias("dl"), F.explode_outer("ws").alias("term"))
    fresh = rows.groupBy(key, "dl", "term").agg(F.count("term").alias("tf"))
    return fresh if index is None else index.join(once.select(key), key, "left_anti").unionByName(fresh)


def index_remove(index: DataFrame, keys: DataFrame, key: str) -> DataFrame:
    """Postings without the documents of ``keys``; counts derived from postings fall with them."""
    return index.join(keys.select(key).distinct(), key, "left_anti")


def index_terms(index: DataFrame, key: str) -> DataFrame:
    """term, df, idf of the documents in the index."""
    n = index.select(key).distinct().count()
    df = index.where("term IS NOT NULL").groupBy("term").agg(F.count(F.lit(1)).alias("df"))
    return df.select("term", "df", F.log((n - F.col("df") + 0.5) / (F.col("df") + 0.5) + 1.0).alias("idf"))


def index_search(index: DataFrame, key: str, query: list[str], k: int, k1: float = 1.2, b: float = 0.75) -> DataFrame:
    """key, score: BM25 out of the postings; only those of the query's terms are joined, no text is read."""
    lengths = index.groupBy(key).agg(F.max("dl").alias("dl"))
    stats = lengths.agg(F.count(F.lit(1)).alias("n"), F.avg("dl").alias("a")).first()
    n, avgdl = stats["n"] or 0, max(stats["a"] or 0.0, 1.0)
    times = {t: query.count(t) for t in query}
    hits = index.where(F.col("term").isin(list(times)))
    df = hits.groupBy("term").agg(F.count(F.lit(1)).alias("df"))
    hits = hits.join(df, "term").withColumn("times", F.element_at(F.create_map(*[F.lit(x) for kv in times.items() for x in kv]), F.col("term"))) if times else hits.limit(0).withColumn("df", F.lit(0)).withColumn("times", F.lit(0))
    idf = F.log((n - F.col("df") + 0.5) / (F.col("df") + 0.5) + 1.0)
    score = F.sum(F.col("times") * idf * F.col("tf") * (k1 + 1) / (F.col("tf") + k1 * (1 - b + b * F.col("dl") / F.lit(float(avgdl)))))
    return hits.groupBy(key).agg(score.alias("score")).orderBy(F.desc("score"), key).limit(k)


def embedded(texts: DataFrame, text: str, cache: DataFrame | None, embed: Callable[[Column], Column] = V.hash_embedding) -> tuple[DataFrame, DataFrame]:
    """The rows with ``vector``, and the cache (text, vector) after them: each distinct text is embedded once, known ones never.

    Null texts get a null vector and aren't cached.
    """
    asked = texts.where(F.col(text).isNotNull()).select(F.col(text).alias("text")).distinct()
    new = asked if cache is None else asked.join(cache.select("text"), "text", "left_anti")
    new = settle(new.select("text", embed(F.col("text")).alias("vector")))
    whole = new if cache is None else cache.select("text", "vector").unionByName(new)
    return texts.join(whole.withColumnRenamed("text", text), text, "left"), whole


def evict(cache: DataFrame, at: str, now: Column, capacity: int, hours: Column | None = None) -> DataFrame:
    """What a response cache (id, at, …) of ``capacity`` keeps: nothing older than ``hours``, then the newest (ties: smaller id).

    Rows without a time are the oldest.  A bounded top-k, so no task sorts the whole cache.
    """
    alive = cache if hours is None else cache.where((F.unix_seconds(now) - F.unix_seconds(at)) <= hours * 3600)
    return alive.orderBy(F.desc_nulls_last(at), "id").limit(capacity)


def happened_before(wall: Column, counter: Column, other_wall: Column, other_counter: Column) -> Column:
    """Whether one logical clock is before another: wall time first, then the counter; null where one is missing."""
    return (wall < other_wall) | ((wall == other_wall) & (counter < other_counter))


def applicable_rules(rules: DataFrame, query: str) -> DataFrame:
    """Rules (id, pattern, …) of whose pattern some word of the query is a part, without case; an empty query has none."""
    words = query.lower().split()
    return rules.where(T.count_contained(F.lower("pattern"), words) > 0) if words else rules.limit(0)


def query_context(items: DataFrame, query: str, episodes: int = 10) -> DataFrame:
    """part, id: all working items, the last episodes, and the rules that apply; ``items``: id, tier, content, created_at."""
    working = items.where("tier = 'working'").select(F.lit("working").alias("part"), "id")
    last = items.where("tier = 'episodic'").orderBy(F.desc_nulls_last("created_at"), "id").limit(episodes).select(F.lit("episode").alias("part"), "id")
    rules = applicable_rules(items.where("tier = 'procedural'").select("id", F.col("content").alias("pattern")), query).select(F.lit("rule").alias("part"), "id")
    return working.unionByName(last).unionByName(rules)


def best_first(edges: DataFrame, seeds: DataFrame, most: int, rounds: int = 10) -> DataFrame:
    """id, score: the ``most`` nodes with the highest product of weights on a way from a seed (id, score).

    ``edges``: a, b, weight, weights from 0 to 1, so that a way's score only falls and the best ``most`` of each
    round's frontier are enough: a node outside them has at least ``most`` better ones already.
    """
    top = lambda df: df.groupBy("id").agg(F.max("score").alias("score")).orderBy(F.desc("score"), "id").limit(most)
    best = settle(top(seeds.select("id", F.col("score").cast("double").alias("score"))))
    for _ in range(rounds):
        step = best.join(edges, best["id"] == edges["a"]).select(F.col("b").alias("id"), (F.col("score") * F.col("weight")).alias("score"))
        new = settle(top(best.unionByName(step)))
        if not new.join(best.withColumnRenamed("score", "o"), "id", "left").where("o IS NULL OR o != score").limit(1).count():
            return new
        best = new
    return best


def edge_vectors(edges: DataFrame, text: str, query: str, k: int, embed: Callable[[Column], Column] = V.hash_embedding) -> DataFrame:
    """id, score: the k edges whose fact's embedding has the highest cosine to the query's."""
    return R.semantic_hits(edges.select("id", F.col(text).alias("text")), query, k, embed)


def ablation_report(rows: DataFrame, configs: dict[str, Column]) -> DataFrame:
    """config, n, accuracy, delta to the first: every configuration's verdict (a boolean column) over the same rows.

    One pass: a configuration is one more aggregate.
    """
    got = rows.agg(F.count(F.lit(1)).alias("n"), *[F.avg(F.when(c, 1.0).otherwise(0.0)).alias(f"a{i}") for i, c in enumerate(configs.values())])
    parts = F.array(*[F.struct(F.lit(name).alias("config"), F.col("n"), F.col(f"a{i}").alias("accuracy"), (F.col(f"a{i}") - F.col("a0")).alias("delta")) for i, name in enumerate(configs)])
    return got.select(F.explode(parts).alias("z")).select("z.*")
