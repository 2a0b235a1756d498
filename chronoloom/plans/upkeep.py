"""Queries: indexes and caches kept up, clocks, rules, bounded traversal."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from chronoloom.operators import temporal as D
from chronoloom.operators import upkeep as U
from chronoloom.operators import views as V
from chronoloom.operators.views import ENT, MEM, REL, SMALL
from chronoloom.plans.search import TOKENS
from chronoloom.tables import load

QUERIES: dict = {}
ORACLE: dict = {}


def query(name: str, sql: str | None = None):
    def keep(f):
        QUERIES[name] = f
        if sql:
            ORACLE[name] = sql
        return f

    return keep


def _index(spark, d):
    """All documents, then those of odd ids again (replaced), then without those divisible by 7."""
    x = load(spark, d, "documents").select("doc_id", "text")
    index = U.index_add(U.index_add(None, x, "doc_id", "text"), x.where("doc_id % 2 = 1"), "doc_id", "text")
    return U.index_remove(index, x.where("doc_id % 7 = 0"), "doc_id")


_LEFT = f"t AS (SELECT doc_id, {TOKENS} AS ws FROM documents WHERE text IS NOT NULL AND doc_id % 7 <> 0)"


@query(
    "index_upkeep",
    f"WITH {_LEFT}, u AS (SELECT DISTINCT doc_id, unnest(ws) AS term FROM t) SELECT term, count(*) AS df, round(ln(((SELECT count(*) FROM t) - count(*) + 0.5e0) / (count(*) + 0.5e0) + 1e0), 6) AS idf FROM u GROUP BY term",
)
def _(spark, d):
    return U.index_terms(_index(spark, d), "doc_id").select("term", "df", F.round("idf", 6).alias("idf"))


@query(
    "index_search",
    f"""WITH {_LEFT}, s AS (SELECT count(*) AS n, avg(len(ws)) AS a FROM t), x AS (SELECT doc_id, len(ws) AS dl, w.term, len(list_filter(ws, lambda z: z = w.term)) AS tf FROM t, (VALUES ('memory'), ('graph'), ('evidence')) w(term)),
f AS (SELECT term, count(*) AS df FROM x WHERE tf > 0 GROUP BY term), r AS (SELECT doc_id, sum(ln((n - df + 0.5e0) / (df + 0.5e0) + 1e0) * tf * 2.2e0 / (tf + 1.2e0 * (0.25e0 + 0.75e0 * dl / a))) AS score FROM x JOIN f USING (term), s WHERE tf > 0 GROUP BY doc_id)
SELECT doc_id, round(score, 6) AS score FROM r ORDER BY r.score DESC, doc_id LIMIT 25""",
)
def _(spark, d):
    return U.index_search(_index(spark, d), "doc_id", ["memory", "graph", "evidence"], 25).select("doc_id", F.round("score", 6).alias("score"))


@query(
    "embedding_cache",
    f"WITH {ENT} SELECT 'first' AS batch, count(DISTINCT name) AS cached, (SELECT count(*) FROM ent) AS vectors FROM ent WHERE entity_type IS NOT NULL UNION ALL SELECT 'all', count(DISTINCT name), (SELECT count(*) FROM ent) FROM ent",
)
def _(spark, d):
    e = V.entities(spark, d).select("id", "name", "entity_type")
    _, first = U.embedded(e.where("entity_type IS NOT NULL"), "name", None)
    rows, cache = U.embedded(e, "name", first)
    n = rows.agg(F.count("vector").alias("vectors"))
    part = lambda df, name: df.agg(F.lit(name).alias("batch"), F.count(F.lit(1)).alias("cached")).crossJoin(F.broadcast(n))
    return part(first, "first").unionByName(part(cache, "all"))


@query("evicted_cache", f"WITH {MEM} SELECT id FROM mem ORDER BY created_at DESC NULLS LAST, id LIMIT 200")
def _(spark, d):
    return U.evict(V.memory(spark, d), "created_at", D.ts("2024-02-01"), 200).select("id")


@query(
    "clock_order",
    "WITH c AS (SELECT event_id, epoch(ts)::BIGINT // 3600 AS wall, event_id AS counter, lead(epoch(ts)::BIGINT // 3600) OVER w AS ow, lead(event_id) OVER w AS oc FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts, event_id)) SELECT event_id, wall < ow OR (wall = ow AND counter < oc) AS before FROM c WHERE ow IS NOT NULL",
)
def _(spark, d):
    e = load(spark, d, "events").withColumn("wall", F.floor(F.unix_seconds("ts") / 3600))
    w = Window.partitionBy("user_id").orderBy("ts", "event_id")
    rows = e.select("event_id", "wall", F.lead("wall").over(w).alias("ow"), F.lead("event_id").over(w).alias("oc")).where("ow IS NOT NULL")
    return rows.select("event_id", U.happened_before(F.col("wall"), F.col("event_id"), F.col("ow"), F.col("oc")).alias("before"))


_RULE = " OR ".join(f"contains(lower(content), '{w}')" for w in ("review", "the", "office"))


@query(
    "query_context",
    f"WITH {MEM} SELECT 'working' AS part, id FROM mem WHERE tier = 'working' UNION ALL SELECT 'episode', id FROM (SELECT id FROM mem WHERE tier = 'episodic' ORDER BY created_at DESC NULLS LAST, id LIMIT 10) UNION ALL SELECT 'rule', id FROM mem WHERE tier = 'procedural' AND ({_RULE})",
)
def _(spark, d):
    return U.query_context(V.memory(spark, d), "Review the office")


@query(
    "note_vectors",
    f"WITH {MEM}, v AS (SELECT id, embedding::DOUBLE[] AS e FROM mem WHERE embedding IS NOT NULL AND len(embedding) = 64 AND len(list_filter(embedding, lambda x: isfinite(x))) = 64 AND len(list_filter(embedding, lambda x: x <> 0)) > 0), q AS (SELECT e AS a FROM v ORDER BY id LIMIT 1) SELECT id, round(list_cosine_similarity(e, a), 6) AS score FROM v, q ORDER BY list_cosine_similarity(e, a) DESC, id LIMIT 20",
)
def _(spark, d):
    from chronoloom.operators import retrieval as R

    fine = "embedding IS NOT NULL AND size(embedding) = 64 AND forall(embedding, x -> x IS NOT NULL AND NOT isnan(x) AND abs(x) < float('inf')) AND exists(embedding, x -> x != 0)"
    m = V.memory(spark, d).where(fine)
    return R.nearest_to(m, "id", "embedding", m.orderBy("id").first()["embedding"], 20).select("id", F.round("score", 6).alias("score"))


@query(
    "edge_vectors",
    f"""WITH {REL}, h AS (SELECT id, sha256(lower(fact)) AS f, sha256('uses the graph index') AS q FROM rel WHERE fact IS NOT NULL),
v AS (SELECT id, list_cosine_similarity(list_transform(range(0, 32), lambda i: ('0x' || f[2 * i + 1:2 * i + 2])::INT / 255.0::DOUBLE), list_transform(range(0, 32), lambda i: ('0x' || q[2 * i + 1:2 * i + 2])::INT / 255.0::DOUBLE)) AS s FROM h)
SELECT id, round(s, 6) AS score FROM v ORDER BY s DESC, id LIMIT 20""",
)
def _(spark, d):
    return U.edge_vectors(V.relationships(spark, d), "fact", "Uses the graph index", 20).select("id", F.round("score", 6).alias("score"))


@query(
    "best_first",
    f"WITH RECURSIVE {SMALL}, g AS (SELECT source_id AS a, target_id AS b FROM small UNION ALL SELECT target_id, source_id FROM small), h(id, d) AS (SELECT 'supplier:1', 0 UNION SELECT g.b, h.d + 1 FROM h JOIN g ON g.a = h.id WHERE h.d < 3), m AS (SELECT id, power(0.5e0, min(d)) AS score FROM h GROUP BY id) SELECT id, score FROM m ORDER BY score DESC, id LIMIT 12",
)
def _(spark, d):
    g = V.small_graph(spark, d)
    e = g.select(F.col("source_id").alias("a"), F.col("target_id").alias("b"), F.lit(0.5).alias("weight"))
    e = e.unionByName(e.select(F.col("b").alias("a"), F.col("a").alias("b"), "weight"))
    return U.best_first(e, spark.createDataFrame([("supplier:1", 1.0)], "id string, score double"), 12)


@query(
    "ablation",
    f"WITH {MEM}, x AS (SELECT lower(content) AS c FROM mem WHERE content IS NOT NULL), a AS (SELECT count(*) AS n, avg(CASE WHEN contains(c, 'review') OR contains(c, 'office') THEN 1e0 ELSE 0e0 END) AS a0, avg(CASE WHEN contains(c, 'review') THEN 1e0 ELSE 0e0 END) AS a1, avg(CASE WHEN contains(c, 'office') THEN 1e0 ELSE 0e0 END) AS a2 FROM x) SELECT config, n, round(acc, 6) AS accuracy, round(acc - a0, 6) AS delta FROM a, LATERAL (VALUES ('full', a0), ('no office', a1), ('no review', a2)) t(config, acc)",
)
def _(spark, d):
    low = F.lower("content")
    x = V.memory(spark, d).where("content IS NOT NULL")
    got = U.ablation_report(x, {"full": low.contains("review") | low.contains("office"), "no office": low.contains("review"), "no review": low.contains("office")})
    return got.select("config", "n", F.round("accuracy", 6).alias("accuracy"), F.round("delta", 6).alias("delta"))
