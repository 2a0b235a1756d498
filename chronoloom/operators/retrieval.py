"""Keyword, BM25 and vector search, fusion, reranking, MMR and hybrid recipes."""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Observation, Window
from pyspark.sql import functions as F

from chronoloom.functions import text as T
from chronoloom.functions import vectors as V

#: Weights of the four channels and the constant of reciprocal rank fusion.
CHANNELS = {"semantic": 0.40, "keyword": 0.25, "ppr": 0.20, "traversal": 0.15}
RRF_K = 60
#: Query vectors that go to the workers at once; more are taken in blocks of this many.
BLOCK = 4096


def keyword_search(entities: DataFrame, query: str, k: int) -> DataFrame:
    """id, score: matching terms over terms, doubled where the name holds the whole query; substrings match."""
    terms = [w for w in query.lower().split() if w]
    both = F.lower(F.concat_ws(" ", "name", "summary"))
    score = T.count_contained(both, terms) / F.lit(float(max(len(terms), 1))) * F.when(F.lower("name").contains(query.lower()), 2.0).otherwise(1.0)
    return entities.select("id", score.alias("score")).where("score > 0").orderBy(F.desc("score"), "id").limit(k)


def postings(docs: DataFrame, key: str, text: str) -> DataFrame:
    """key, term, tf, dl: term counts of each document and its length in terms."""
    rows = docs.where(F.col(text).isNotNull()).select(F.col(key), T.bm25_tokens(F.col(text)).alias("ws"))
    return rows.select(key, F.size("ws").alias("dl"), F.explode("ws").alias("term")).groupBy(key, "dl", "term").agg(F.count(F.lit(1)).alias("tf"))


def document_frequency(docs: DataFrame, key: str, text: str) -> DataFrame:
    """term, df, idf."""
    n = docs.where(F.col(text).isNotNull()).count()
    df = postings(docs, key, text).groupBy("term").agg(F.count(F.lit(1)).alias("df"))
    return df.select("term", "df", F.log((n - F.col("df") + 0.5) / (F.col("df") + 0.5) + 1.0).alias("idf"))


def _is(term: str):
    return lambda w: w == F.lit(term)


def bm25(docs: DataFrame, key: str, text: str, query: list[str], k: int | None = None, k1: float = 1.2, b: float = 0.75) -> DataFrame:
    """key, score; a term repeated in the query counts as often.

    One scan: tokens are cut once; while the documents with a query term go to the shared folder, the pass
    itself observes the corpus statistics, which then are literals of the score.
    """
    from chronoloom.session import settle

    terms = {t: query.count(t) for t in query}
    rows = docs.where(F.col(text).isNotNull()).select(F.col(key), T.bm25_tokens(F.col(text)).alias("ws"))
    tf = [F.size(F.filter("ws", _is(t))).alias(f"tf{i}") for i, t in enumerate(terms)]
    rows = rows.select(key, F.size("ws").alias("dl"), *tf)
    seen = Observation()
    counts = [F.sum(F.when(F.col(f"tf{i}") > 0, 1).otherwise(0)).alias(f"df{i}") for i in range(len(terms))]
    hit = F.lit(False)
    for i in range(len(terms)):
        hit = hit | (F.col(f"tf{i}") > 0)
    rows = settle(rows.observe(seen, F.count(F.lit(1)).alias("n"), F.avg("dl").alias("avgdl"), *counts).where(hit))
    stats = seen.get
    n, avgdl = stats.get("n") or 0, max(stats.get("avgdl") or 0.0, 1.0)
    score = F.lit(0.0)
    for i, times in enumerate(terms.values()):
        tf_, df_ = F.col(f"tf{i}"), stats.get(f"df{i}") or 0
        idf = math.log((n - df_ + 0.5) / (df_ + 0.5) + 1.0)
        score = score + times * idf * tf_ * (k1 + 1) / (tf_ + k1 * (1 - b + b * F.col("dl") / F.lit(float(avgdl))))
    out = rows.select(key, score.alias("score")).where("score > 0")
    return out if k is None else out.orderBy(F.desc("score"), key).limit(k)


def nearest_to(df: DataFrame, key: str, vector: str, query: list[float], k: int) -> DataFrame:
    """key, score: exact top k by cosine to one vector."""
    q = F.array(*[F.lit(float(x)) for x in query])
    return df.where(F.col(vector).isNotNull()).select(key, V.cosine(F.col(vector), q).alias("score")).orderBy(F.desc("score"), key).limit(k)


def neighbours_of(df: DataFrame, queries: DataFrame, key: str, vector: str, threshold: float, k: int) -> DataFrame:
    """Per query row its k most similar other rows of at least ``threshold``: query, other, score.

    Queries are a stated set; they go to the workers in blocks of at most BLOCK, each a matrix product with
    a partition's rows, and every partition hands on only its own k best per query.
    """
    spark = df.sparkSession
    kind = df.schema[key].dataType.simpleString()
    n = queries.count()
    parts = max(1, -(-n // BLOCK))
    out = None
    for p in range(parts):
        block = queries.where(F.pmod(F.xxhash64(key), F.lit(parts)) == p).select(key, vector).where(F.col(vector).isNotNull()).orderBy(key).collect()  # at most about BLOCK rows
        ids = [r[0] for r in block]
        if not ids:
            continue
        m = np.array([r[1] for r in block], float)
        shared = spark.sparkContext.broadcast((ids, m / np.maximum(np.linalg.norm(m, axis=1)[:, None], 1e-300)))

        def run(frames: Iterator[pd.DataFrame], shared=shared) -> Iterator[pd.DataFrame]:
            names, q = shared.value
            best: list[list[tuple]] = [[] for _ in names]
            for frame in frames:
                frame = frame[[v is not None and len(v) == q.shape[1] for v in frame["v"]]]
                if not len(frame):
                    continue
                x = np.array(frame["v"].tolist(), float)
                s = q @ (x / np.maximum(np.linalg.norm(x, axis=1)[:, None], 1e-300)).T
                keys = frame["k"].tolist()
                for i, row in enumerate(s):
                    hit = np.flatnonzero(row >= threshold)
                    if len(hit) > k + 1:
                        hit = hit[np.argsort(-row[hit], kind="stable")[: k + 8]]
                    best[i] = sorted(best[i] + [(-float(row[j]), keys[j]) for j in hit if keys[j] != names[i]])[:k]
            yield pd.DataFrame([(n_, o, -s_) for n_, b_ in zip(names, best) for s_, o in b_], columns=["query", "other", "score"])

        found = df.select(F.col(key).alias("k"), F.col(vector).alias("v")).mapInPandas(run, f"query {kind}, other {kind}, score double")
        out = found if out is None else out.unionByName(found)
    if out is None:
        return spark.createDataFrame([], f"query {kind}, other {kind}, score double")
    w = Window.partitionBy("query").orderBy(F.desc(F.round("score", 9)), "other")
    return out.withColumn("r", F.row_number().over(w)).where(F.col("r") <= k).drop("r")


def rrf(lists: dict[str, DataFrame], key: str, weights: dict[str, float] | None = None, k: int = RRF_K) -> DataFrame:
    """key, score, sources: sum of weight / (k + rank + 1) over ranked lists (key, score)."""
    weights = weights or {name: 1.0 for name in lists}
    parts = None
    for name, df in lists.items():
        # the lists are results of top-k operators: one task orders each of them
        ranked = df.select(key, F.lit(name).alias("source"), (F.row_number().over(Window.orderBy(F.desc("score"), key)) - 1).alias("rank"), F.lit(weights[name]).alias("w"))
        parts = ranked if parts is None else parts.unionByName(ranked)
    return parts.groupBy(key).agg(F.sum(F.col("w") / (F.lit(float(k + 1)) + F.col("rank"))).alias("score"), F.array_join(F.array_sort(F.collect_set("source")), ",").alias("sources"))


def cross_encode(candidates: DataFrame, query: str, text: str = "text") -> DataFrame:
    """Rule-based cross encoder over candidates (id, text, score): adds ``combined``.

    Shared keywords count 0.4, the whole phrase 0.5 (else each bigram 0.15, at most 0.3), capitals up to 0.1;
    combined = 0.4 score + 0.6 rules.
    """
    words = [w for w in query.lower().split() if len(w) > 2]
    every = query.lower().split()
    low = F.lower(text)
    overlap = F.size(F.array_intersect(T.array_of(words) if words else F.array().cast("array<string>"), T.words_of(low))) / F.lit(float(max(len(words), 1)))
    bigrams = [f"{a} {b}" for a, b in zip(every, every[1:])]
    phrase = F.when(low.contains(query.lower()), 0.5).otherwise(F.least(T.count_contained(low, bigrams) * 0.15, F.lit(0.3)))
    all_words = T.words_of(F.col(text))
    capitals = F.when(F.size(all_words) > 0, F.size(F.filter(all_words, lambda w: w.rlike(r"^[A-Z]"))) / F.size(all_words)).otherwise(0.0)
    rules = overlap * 0.4 + phrase + F.least(capitals, F.lit(0.5)) * 0.2
    return candidates.withColumn("combined", 0.4 * F.col("score") + 0.6 * rules)


def mmr(candidates: DataFrame, query: list[float], k: int, balance: float = 0.7, group: str | None = None) -> DataFrame:
    """Maximal marginal relevance over candidates (id, v): id, pick (from 1), score.

    Greedy over a pool that a top-k operator has bounded; with ``group`` each group is one pool and query
    pools run in parallel.
    """
    q = np.asarray(query, float)

    def run(frame: pd.DataFrame) -> pd.DataFrame:
        frame = frame.sort_values("id").reset_index(drop=True)
        x = np.array(frame["v"].tolist(), float).reshape(len(frame), -1)
        x = x / np.maximum(np.linalg.norm(x, axis=1)[:, None], 1e-300)
        rel = x @ (q / max(np.linalg.norm(q), 1e-300))
        left, picked, out = list(range(len(frame))), [], []
        while left and len(picked) < k:
            scores = [balance * rel[i] - (1 - balance) * (max(x[i] @ x[j] for j in picked) if picked else 0.0) for i in left]
            at = int(np.argmax(np.round(scores, 12)))
            out.append((frame["id"][left[at]], len(picked) + 1, float(scores[at])))
            picked.append(left.pop(at))
        return pd.DataFrame(out, columns=["id", "pick", "score"])

    kind = candidates.schema["id"].dataType.simpleString()
    rows = candidates.select("id", "v", (F.col(group) if group else F.lit(0)).alias("g"))
    return rows.groupBy("g").applyInPandas(lambda f: run(f), f"id {kind}, pick int, score double")


def mention_scores(mentions: DataFrame, key: str) -> DataFrame:
    """key, score: mentions over the most mentions of any key."""
    counts = mentions.groupBy(key).agg(F.count(F.lit(1)).alias("n"))
    return counts.crossJoin(F.broadcast(counts.agg(F.max("n").alias("m")))).select(key, (F.col("n") / F.col("m")).alias("score"))


def parse_llm_scores(answer: Column) -> Column:
    """0 to 10 as 0 to 1 from JSON {"score": x} or the first number; 0.5 where there is none."""
    found = F.coalesce(F.get_json_object(answer, "$.score"), F.nullif(F.regexp_extract(answer, r"(\d+(?:\.\d+)?)", 1), F.lit("")))
    return F.least(F.greatest(F.coalesce(F.try_divide(found.try_cast("double"), F.lit(10.0)), F.lit(0.5)), F.lit(0.0)), F.lit(1.0))


#: Words that make a query broad, and those that make it specific.
BROAD = "overview|summary|summarize|all|general|broad|landscape|trend|theme|pattern|main|key|compare|overall|what are the|tell me about".split("|")
SPECIFIC = "who is|where is|where does|when did|how much|what is the|which|specific|exactly|name".split("|")


def breadth(query: Column) -> Column:
    """0 (specific) to 1 (broad): 0.7 share of broad indicators (0.5 without any) + 0.3 length, full at 15 words."""
    low = F.lower(query)
    b, s = T.count_contained(low, BROAD), T.count_contained(low, SPECIFIC)
    share = F.when(b + s > 0, b / F.greatest(b + s, F.lit(1))).otherwise(0.5)
    return share * 0.7 + F.least(F.size(T.words_of(query)) / 15.0, F.lit(1.0)) * 0.3


def drift_mode(query: Column) -> Column:
    x = breadth(query)
    return F.when(x > 0.5, "global").when(x < 0.5, "local").otherwise("adaptive")


def drift_local(query: str, edges: DataFrame, texts: DataFrame, seeds: int = 10, hops: int = 2, decay: float = 0.7, most: int = 20) -> DataFrame:
    """id, score, depth: seeds by shared query words, then neighbours at weight x decay, the first visit counting.

    ``edges``: a, b, weight; ``texts``: id, text.  Results are ordered by depth, score and id before the cap.
    """
    words = [w for w in query.lower().split() if len(w) > 2]
    share = T.count_contained(F.lower("text"), words) / F.lit(float(max(len(words), 1)))
    front = texts.select("id", share.alias("score")).where("score > 0").orderBy(F.desc("score"), "id").limit(seeds).withColumn("depth", F.lit(0))
    seen = front
    for depth in range(1, hops + 1):
        step = front.join(edges, front["id"] == edges["a"]).groupBy(F.col("b").alias("id")).agg(F.max(F.col("score") * F.col("weight") * decay).alias("score"))
        front = step.join(seen.select("id"), "id", "left_anti").withColumn("depth", F.lit(depth))
        seen = seen.unionByName(front)
    return seen.orderBy("depth", F.desc("score"), "id").limit(most)


def drift_global(query: str, communities: DataFrame, top: int = 5) -> DataFrame:
    """Communities (id, text, importance) by shared words x (0.5 + 0.5 importance)."""
    words = [w for w in query.lower().split() if len(w) > 2]
    share = T.count_contained(F.lower("text"), words) / F.lit(float(max(len(words), 1)))
    return communities.select("id", (share * (0.5 + 0.5 * F.col("importance"))).alias("score")).where("score > 0").orderBy(F.desc("score"), "id").limit(top)


def drift_adaptive(whole: DataFrame, local: DataFrame) -> DataFrame:
    """0.4 global + 0.6 local (0.7 global + 0.3 local where there is no local result)."""
    none = local.limit(1).count() == 0
    g, l = (0.7, 0.3) if none else (0.4, 0.6)
    rows = whole.select("id", (F.col("score") * g).alias("score")).unionByName(local.select("id", (F.col("score") * l).alias("score")))
    return rows.groupBy("id").agg(F.sum("score").alias("score"))


@dataclass(frozen=True)
class Recipe:
    """What a search does per channel; :func:`run_recipe` builds the plan."""

    name: str
    channels: tuple[str, ...]
    methods: tuple[str, ...]
    reranker: str
    limit: int = 10
    min_score: float = 0.0
    options: dict = field(default_factory=dict)


_ALL = ("entity", "relationship", "episode", "community")
RECIPES = {
    r.name: r
    for r in (
        Recipe("combined_hybrid_rrf", _ALL, ("bm25", "cosine"), "rrf"), Recipe("combined_hybrid_mmr", _ALL, ("bm25", "cosine"), "mmr", options={"lambda": 0.7}),
        Recipe("combined_hybrid_cross_encoder", _ALL, ("bm25", "cosine", "bfs"), "cross_encoder"), Recipe("entity_hybrid_rrf", ("entity",), ("bm25", "cosine"), "rrf"),
        Recipe("entity_hybrid_mmr", ("entity",), ("bm25", "cosine"), "mmr", options={"lambda": 0.7}), Recipe("entity_hybrid_episode_mentions", ("entity",), ("bm25", "cosine"), "episode_mentions"),
        Recipe("entity_only_cosine", ("entity",), ("cosine",), "none", 20), Recipe("relationship_hybrid_rrf", ("relationship",), ("bm25", "cosine"), "rrf"),
        Recipe("relationship_hybrid_node_distance", ("relationship",), ("bm25", "cosine"), "node_distance"), Recipe("graph_aware_ppr", ("entity", "relationship"), ("cosine", "ppr"), "rrf"),
        Recipe("drift_adaptive", ("entity", "community"), ("drift",), "mmr", options={"lambda": 0.7}), Recipe("neighborhood_search", ("entity", "relationship"), ("bfs",), "node_distance"),
        Recipe("conversation_replay", ("episode",), ("bm25",), "none", 50), Recipe("community_hybrid_rrf", ("community",), ("bm25", "cosine"), "rrf"), Recipe("community_hybrid_mmr", ("community",), ("bm25", "cosine"), "mmr", options={"lambda": 0.7}),
    )
}


#: Semantic hits that seed the PageRank channel.
PPR_SEEDS = 5


def semantic_hits(rows: DataFrame, query: str, k: int, embed=V.hash_embedding) -> DataFrame:  # noqa: ANN001
    """id, score: the k rows (id, text) with the highest cosine of their embedding to the query's."""
    vector = V.cosine(embed(F.lower("text")), embed(F.lit(query.lower())))
    return rows.where("text IS NOT NULL").select("id", vector.alias("score")).orderBy(F.desc("score"), "id").limit(k)


def ppr_hits(semantic: DataFrame, edges: DataFrame, k: int) -> DataFrame:
    """id, score of Personalised PageRank (0.85, 20 rounds, 1e-8) around the best PPR_SEEDS semantic hits.

    ``edges``: source_id, target_id.  The walk runs over the edges at the seeds, in their direction; seeds
    weigh by their score.  Without positive seeds or edges there are no hits.
    """
    from chronoloom.operators import graph as G
    from chronoloom.session import settle

    seeds = settle(semantic.orderBy(F.desc("score"), "id").limit(PPR_SEEDS).where("score > 0"))
    total = seeds.agg(F.sum("score")).first()[0]
    if not total:
        return seeds.limit(0)
    ids = [r["id"] for r in seeds.select("id").collect()]  # PPR_SEEDS at most
    near = edges.where(F.col("source_id").isin(ids) | F.col("target_id").isin(ids))
    near = settle(near.select(F.col("source_id").alias("a"), F.col("target_id").alias("b"), F.lit(1.0).alias("w")))
    if not near.limit(1).count():
        return seeds.limit(0)
    ranked = G.pagerank(near, seeds.select("id", (F.col("score") / total).alias("p")), 0.85, 20, 1e-8)
    return ranked.where("score > 0").orderBy(F.desc("score"), "id").limit(k)


def hybrid_channels(rows: DataFrame, edges: DataFrame, query: str, k: int, seeds: list[str] | None = None, embed=V.hash_embedding) -> dict[str, DataFrame]:  # noqa: ANN001
    """The ranked lists (id, score) of the four channels, 3 k each: semantic, keyword, ppr, traversal.

    ``rows``: id, text; ``edges``: source_id, target_id.  PageRank starts at the best semantic hits, traversal
    at ``seeds`` (two hops); a channel that has nothing to start from is an empty list.
    """
    from chronoloom.operators import graph as G
    from chronoloom.session import settle

    terms = [t for t in query.lower().split() if t not in T.STOP_WORDS and len(t) > 1]
    semantic = settle(semantic_hits(rows, query, 3 * k, embed))
    keyword = bm25(rows, "id", "text", terms, 3 * k) if terms else semantic.limit(0)
    both = edges.select(F.col("source_id").alias("a"), F.col("target_id").alias("b"))
    both = both.union(both.select("b", "a")).where("a != b").distinct()
    found = None
    for seed in seeds or []:
        hops = G.hop_distances(both, seed, 2)
        found = hops if found is None else found.unionByName(hops)
    if found is None:
        traversal = semantic.limit(0)
    else:
        near = found.groupBy("id").agg(F.min("distance").alias("distance")).where("distance > 0").join(rows.select("id"), "id", "left_semi").orderBy("distance", "id").limit(3 * k)
        rank = F.row_number().over(Window.orderBy("distance", "id")) - 1  # 3 k rows
        traversal = near.select("id", (1.0 / (1.0 + 0.3 * rank)).alias("score"))
    return {"semantic": semantic, "keyword": keyword, "ppr": ppr_hits(semantic, edges, 3 * k).join(rows.select("id"), "id", "left_semi"), "traversal": traversal}


def hybrid(rows: DataFrame, edges: DataFrame, query: str, k: int, seeds: list[str] | None = None, rerank: bool = True, embed=V.hash_embedding) -> tuple[DataFrame, DataFrame]:  # noqa: ANN001
    """Hits (id, score, sources) of the four channels, fused by weighted ranks and reranked by rules, and the stages (stage, n)."""
    from chronoloom.session import settle

    lists = {name: settle(df) for name, df in hybrid_channels(rows, edges, query, k, seeds, embed).items()}
    stages = None
    for name, df in lists.items():
        part = df.agg(F.lit(name).alias("stage"), F.count(F.lit(1)).alias("n"))
        stages = part if stages is None else stages.unionByName(part)
    fused = rrf(lists, "id", CHANNELS)
    if rerank:
        fused = cross_encode(fused.join(rows, "id"), query).select("id", F.col("combined").alias("score"), F.concat_ws(",", "sources", F.lit("reranked")).alias("sources"))
    return fused.orderBy(F.desc("score"), "id").limit(k), stages


def _missing(recipe: Recipe, tables: dict[str, DataFrame], center: str | None, edges: DataFrame | None) -> list[str]:
    """The inputs that a recipe asks for and hasn't got."""
    out = [c for c in recipe.channels if c not in tables]
    if edges is None and ({"bfs", "ppr", "drift"} & set(recipe.methods) or recipe.reranker == "node_distance"):
        out.append("edges")
    if center is None and ("bfs" in recipe.methods or recipe.reranker == "node_distance"):
        out.append("center")
    if recipe.reranker == "episode_mentions" and any("mentions" not in tables[c].columns for c in recipe.channels if c in tables):
        out.append("mentions")
    if "drift" in recipe.methods and "community" in tables and "importance" not in tables["community"].columns:
        out.append("importance")
    return out


def run_recipe(recipe: Recipe, tables: dict[str, DataFrame], query: str, center: str | None = None, edges: DataFrame | None = None) -> DataFrame:
    """channel, id, score of a recipe over tables {channel: (id, text[, mentions][, importance])}.

    ``edges``: source_id, target_id[, weight].  Methods: bm25; cosine of hashed embeddings; bfs, 0.5 a hop from
    the center; ppr, PageRank around the best semantic hits; drift, local search for entities and global search
    for communities, weighted as the adaptive mode does.  rrf fuses the methods; the other rerankers work on
    that fused top 3 x limit.  An input that the recipe needs and hasn't got is an error.
    """
    from chronoloom.operators import graph as G
    from chronoloom.session import settle

    if lacks := _missing(recipe, tables, center, edges):
        raise ValueError(f"{recipe.name} needs {', '.join(lacks)}")
    pool, hops, out = recipe.limit * 3, None, None
    if center is not None and edges is not None and ("bfs" in recipe.methods or recipe.reranker == "node_distance"):
        both = edges.select(F.col("source_id").alias("a"), F.col("target_id").alias("b"))
        hops = G.hop_distances(both.union(both.select("b", "a")).where("a != b").distinct(), center, 3)
        hops = settle(hops.select("id", F.pow(F.lit(0.5), F.col("distance")).alias("near")))
    drift = {}
    if "drift" in recipe.methods:
        weight = F.col("weight") if "weight" in edges.columns else F.lit(1.0)
        local = drift_local(query, edges.select(F.col("source_id").alias("a"), F.col("target_id").alias("b"), weight.alias("weight")), tables["entity"].where("text IS NOT NULL").select("id", "text"))
        local, whole = settle(local.select("id", "score")), drift_global(query, tables["community"])
        share = (0.7, 0.3) if not local.limit(1).count() else (0.4, 0.6)
        drift = {"community": whole.withColumn("score", F.col("score") * share[0]), "entity": local.withColumn("score", F.col("score") * share[1])}
    for channel in recipe.channels:
        df = tables[channel].where("text IS NOT NULL")
        found: dict[str, DataFrame] = {}
        terms = [t for t in query.lower().split() if t not in T.STOP_WORDS and len(t) > 1]
        if "bm25" in recipe.methods:
            found["keyword"] = bm25(df, "id", "text", terms, pool)
        if "cosine" in recipe.methods or "ppr" in recipe.methods:
            found["semantic"] = settle(semantic_hits(df, query, pool))
        if "ppr" in recipe.methods:
            seeds = found["semantic"] if channel == "entity" or "entity" not in tables else semantic_hits(tables["entity"], query, pool)
            walk = ppr_hits(seeds, edges, pool)
            if channel == "relationship":  # an edge is as near as its nearer end
                ends = edges.select("id", F.explode(F.array("source_id", "target_id")).alias("end"))
                walk = ends.join(walk.withColumnRenamed("id", "end"), "end").groupBy("id").agg(F.max("score").alias("score"))
            found["ppr"] = walk.join(df.select("id"), "id", "left_semi")
        if "bfs" in recipe.methods:
            near = hops.withColumnRenamed("near", "score")
            if channel == "relationship":
                ends = edges.select("id", F.explode(F.array("source_id", "target_id")).alias("end"))
                near = ends.join(near.withColumnRenamed("id", "end"), "end").groupBy("id").agg(F.max("score").alias("score"))
            found["traversal"] = near.join(df.select("id"), "id", "left_semi").orderBy(F.desc("score"), "id").limit(pool)
        if channel in drift:
            found["drift"] = drift[channel]
        fused = settle(rrf(found, "id").select("id", "score")) if "drift" not in found else found["drift"]
        if recipe.reranker == "cross_encoder":
            fused = cross_encode(fused.join(df, "id"), query).select("id", F.col("combined").alias("score"))
        elif recipe.reranker == "mmr":
            q = df.sparkSession.range(1).select(V.hash_embedding(F.lit(query.lower())).alias("q")).first()[0]
            rows = fused.orderBy(F.desc("score"), "id").limit(pool).join(df.select("id", V.hash_embedding(F.lower("text")).alias("v")), "id")
            fused = mmr(settle(rows), q, recipe.limit, recipe.options.get("lambda", 0.7)).select("id", F.col("score"))
        elif recipe.reranker == "episode_mentions":
            top = df.agg(F.max("mentions").alias("m"))
            fused = fused.join(df.select("id", "mentions"), "id").crossJoin(F.broadcast(top)).select("id", F.coalesce(F.col("mentions") / F.col("m"), F.lit(0.0)).alias("score"))
        elif recipe.reranker == "node_distance":
            near = hops
            if channel == "relationship":
                ends = edges.select("id", F.explode(F.array("source_id", "target_id")).alias("end"))
                near = ends.join(hops.withColumnRenamed("id", "end"), "end").groupBy("id").agg(F.max("near").alias("near"))
            fused = fused.join(near, "id", "left").select("id", F.coalesce("near", F.lit(0.0)).alias("score"))
        part = fused.where(F.col("score") >= recipe.min_score).orderBy(F.desc("score"), "id").limit(recipe.limit).select(F.lit(channel).alias("channel"), "id", "score")
        out = part if out is None else out.unionByName(part)
    return out


def rag_context(chunks: DataFrame, budget: int, top: int) -> DataFrame:
    """Greedy context per query: chunks (query, id, text, score), a chunk that shares over half its words with a
    kept one is dropped, and one that would pass the budget (four bytes a token) is skipped: query, id, pick."""

    def run(frame: pd.DataFrame) -> pd.DataFrame:
        kept: list[set] = []
        used, out = 0, []
        for r in frame.sort_values(["score", "id"], ascending=[False, True]).head(top).itertuples():
            words = set((r.text or "").lower().split())
            if any(words and w and len(words & w) / min(len(words), len(w)) > 0.5 for w in kept):
                continue
            size = -(-len((r.text or "").encode()) // 4)
            if used + size > budget:
                continue
            kept.append(words)
            used += size
            out.append((r.query, r.id, len(kept)))
        return pd.DataFrame(out, columns=["query", "id", "pick"])

    kind = chunks.schema["id"].dataType.simpleString()
    w = Window.partitionBy("query").orderBy(F.desc("score"), "id")
    best = chunks.withColumn("_r", F.row_number().over(w)).where(F.col("_r") <= top).drop("_r")
    return best.groupBy("query").applyInPandas(run, f"query string, id {kind}, pick int")
