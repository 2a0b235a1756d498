"""Queries: traversal, PageRank, communities, time, branches, ingestion, memory, views, streams."""

from __future__ import annotations

from pyspark.sql import functions as F

from chronoloom.operators import branches as B
from chronoloom.operators import extraction as X
from chronoloom.operators import graph as G
from chronoloom.operators import ingest as I
from chronoloom.operators import memory as M
from chronoloom.operators import multigraph as MG
from chronoloom.operators import retrieval as R
from chronoloom.operators import routing as Q
from chronoloom.operators import temporal as D
from chronoloom.operators import views as V
from chronoloom.operators.views import ENT, MEM, REL, SMALL, VER
from chronoloom.session import shared_path
from chronoloom.sources import readers
from chronoloom.streaming import live
from chronoloom.tables import load

QUERIES: dict = {}
ORACLE: dict = {}
AT = "2021-01-01 00:00:00"
BOTH = "u AS (SELECT source_id AS a, target_id AS b FROM small UNION SELECT target_id, source_id FROM small)"
RBOTH = "u AS (SELECT source_id AS a, target_id AS b FROM rel WHERE source_id <> target_id UNION SELECT target_id, source_id FROM rel WHERE source_id <> target_id)"


def query(name: str, sql: str | None = None):
    def keep(f):
        QUERIES[name] = f
        if sql:
            ORACLE[name] = sql
        return f

    return keep


def both(g):
    return g.select(F.col("source_id").alias("a"), F.col("target_id").alias("b")).union(g.select(F.col("target_id").alias("a"), F.col("source_id").alias("b"))).distinct()


# --- graph


@query("hop_distance", f"WITH RECURSIVE {SMALL}, {BOTH}, h(id, d) AS (SELECT 'nation:3', 0 UNION SELECT u.b, h.d + 1 FROM h JOIN u ON u.a = h.id WHERE h.d < 3) SELECT id, min(d) AS distance FROM h GROUP BY id")
def _(spark, d):
    return G.hop_distances(both(V.small_graph(spark, d)), "nation:3", 3)


@query("bfs_subgraph", f"WITH RECURSIVE {SMALL}, {BOTH}, h(id, d) AS (SELECT 'nation:3', 0 UNION SELECT u.b, h.d + 1 FROM h JOIN u ON u.a = h.id WHERE h.d < 2), n AS (SELECT DISTINCT id FROM h) SELECT source_id, target_id FROM small WHERE source_id IN (SELECT id FROM n) AND target_id IN (SELECT id FROM n)")
def _(spark, d):
    g = V.small_graph(spark, d)
    return G.subgraph(g, G.hop_distances(both(g), "nation:3", 2)).select("source_id", "target_id")


@query("distance_rerank", f"WITH RECURSIVE {REL}, {RBOTH}, c AS (SELECT min(source_id) AS id FROM rel), h(id, d) AS (SELECT id, 0 FROM c UNION SELECT u.b, h.d + 1 FROM h JOIN u ON u.a = h.id WHERE h.d < 3), m AS (SELECT id, min(d) AS d FROM h GROUP BY id), {ENT} SELECT ent.id, round(CASE WHEN m.d IS NULL THEN 0e0 ELSE power(0.5e0, m.d) END, 6) AS score FROM ent LEFT JOIN m USING (id)")
def _(spark, d):
    r = V.relationships(spark, d)
    center = r.agg(F.min("source_id")).first()[0]
    h = G.hop_distances(V.both_ways(r), center, 3)
    return V.entities(spark, d).select("id").join(h, "id", "left").select("id", F.round(F.when(F.col("distance").isNull(), 0.0).otherwise(F.pow(F.lit(0.5), F.col("distance"))), 6).alias("score"))


def _ppr_sql(rounds: int) -> str:
    e = f"WITH {SMALL}, g AS (SELECT source_id AS a, target_id AS b FROM small UNION ALL SELECT target_id, source_id FROM small), o AS (SELECT a, count(*) AS t FROM g GROUP BY a), n AS (SELECT DISTINCT a AS id, CASE WHEN a = 'nation:3' THEN 1e0 ELSE 0e0 END AS p FROM g), s0 AS (SELECT id, p AS s FROM n)"
    for i in range(rounds):
        e += f", s{i + 1} AS MATERIALIZED (SELECT n.id, 0.85e0 * coalesce(f.x, 0) + 0.15e0 * n.p AS s FROM n LEFT JOIN (SELECT g.b AS id, sum(s.s / o.t) AS x FROM g JOIN o USING (a) JOIN s{i} s ON s.id = g.a GROUP BY g.b) f USING (id))"
    return e + f" SELECT id, round(s, 6) AS score FROM s{rounds}"


@query("ppr_20", _ppr_sql(20))
def _(spark, d):
    g = V.small_graph(spark, d)
    e = g.select(F.col("source_id").alias("a"), F.col("target_id").alias("b"), F.lit(1.0).alias("w"))
    e = e.unionByName(e.select(F.col("b").alias("a"), F.col("a").alias("b"), "w"))
    return G.pagerank(e, spark.createDataFrame([("nation:3", 1.0)], "id string, p double")).select("id", F.round("score", 6).alias("score"))


@query("components", f"WITH RECURSIVE {REL}, {RBOTH}, c(id, m) AS (SELECT DISTINCT a, a FROM u UNION SELECT u.b, c.m FROM c JOIN u ON u.a = c.id) SELECT id, min(m) AS component FROM c GROUP BY id")
def _(spark, d):
    return G.components(V.both_ways(V.relationships(spark, d)))


def _weighted(spark, d):
    return V.relationships(spark, d).select("source_id", "target_id", F.lit(1.0).alias("weight"))


@query("louvain_cover")
def _(spark, d):
    return G.communities(_weighted(spark, d), "louvain")


@query("leiden_cover")
def _(spark, d):
    return G.communities(_weighted(spark, d), "leiden")


@query("shortest_path", f"WITH {SMALL} SELECT 'supplier:1>nation:' || s_nationkey || '>region:' || n_regionkey AS path, 2 AS hops FROM supplier JOIN nation ON n_nationkey = s_nationkey WHERE s_suppkey = 1")
def _(spark, d):
    s = load(spark, d, "supplier").where("s_suppkey = 1").join(load(spark, d, "nation"), F.col("s_nationkey") == F.col("n_nationkey")).first()
    return G.shortest_path(both(V.small_graph(spark, d)), "supplier:1", f"region:{s['n_regionkey']}")


_CAUSE = [("rain", "flood"), ("flood", "outage"), ("storm", "outage"), ("outage", "delay"), ("strike", "delay"), ("delay", "rain")]
_CV = ", ".join(f"('{a}', '{b}')" for a, b in _CAUSE)


@query("cause_paths", f"WITH RECURSIVE e(cause, effect) AS (VALUES {_CV}), p(path, n) AS (SELECT ['delay'], 0 UNION ALL SELECT list_prepend(e.cause, p.path), n + 1 FROM p JOIN e ON e.effect = p.path[1] WHERE n < 5 AND NOT list_contains(p.path, e.cause)) SELECT array_to_string(path, '>') AS path FROM p WHERE n > 0 AND (n = 5 OR NOT EXISTS (SELECT 1 FROM e WHERE e.effect = p.path[1] AND NOT list_contains(p.path, e.cause)))")
def _(spark, d):
    return G.cause_paths(spark.createDataFrame(_CAUSE, "cause string, effect string"), "delay", 5)


@query("link_search", f"WITH {REL}, {RBOTH}, s AS (SELECT DISTINCT source_id AS id FROM rel WHERE relationship_type = 'FUNDED_BY'), o AS (SELECT DISTINCT u.b AS id FROM s JOIN u ON u.a = s.id), t AS (SELECT DISTINCT u.b AS id FROM o JOIN u ON u.a = o.id) SELECT id, max(w) AS score FROM (SELECT id, 1e0 AS w FROM s UNION ALL SELECT id, 0.5e0 FROM o UNION ALL SELECT id, 0.25e0 FROM t) GROUP BY id")
def _(spark, d):
    r = V.relationships(spark, d)
    return G.link_search(r.where("relationship_type = 'FUNDED_BY'").select(F.col("source_id").alias("id")).distinct(), V.both_ways(r))


_DL = f"""WITH {REL}, {ENT}, e AS (SELECT a, b, 1e0 AS weight FROM (SELECT source_id AS a, target_id AS b FROM rel WHERE source_id <> target_id UNION SELECT target_id, source_id FROM rel WHERE source_id <> target_id)),
s0 AS (SELECT id, ((CASE WHEN contains(lower(concat_ws(' ', name, summary)), 'memory') THEN 1 ELSE 0 END) + (CASE WHEN contains(lower(concat_ws(' ', name, summary)), 'index') THEN 1 ELSE 0 END)) / 2e0 AS score, 0 AS depth FROM ent), f0 AS (SELECT * FROM s0 WHERE score > 0 ORDER BY score DESC, id LIMIT 10),
f1 AS (SELECT e.b AS id, max(f0.score * e.weight * 0.7e0) AS score, 1 AS depth FROM f0 JOIN e ON e.a = f0.id WHERE e.b NOT IN (SELECT id FROM f0) GROUP BY e.b), f2 AS (SELECT e.b AS id, max(f1.score * e.weight * 0.7e0) AS score, 2 AS depth FROM f1 JOIN e ON e.a = f1.id WHERE e.b NOT IN (SELECT id FROM f0 UNION SELECT id FROM f1) GROUP BY e.b),
l AS (SELECT * FROM (SELECT * FROM f0 UNION ALL SELECT * FROM f1 UNION ALL SELECT * FROM f2) ORDER BY depth, round(score, 9) DESC, id LIMIT 20)"""


def _local(spark, d):
    e = V.both_ways(V.relationships(spark, d)).withColumn("weight", F.lit(1.0))
    return R.drift_local("memory index", e, V.entities(spark, d).select("id", F.concat_ws(" ", "name", "summary").alias("text")))


@query("drift_local", _DL + " SELECT id, round(score, 6) AS score, depth FROM l")
def _(spark, d):
    return _local(spark, d).select("id", F.round("score", 6).alias("score"), "depth")


_DG = """g AS (SELECT id, ((CASE WHEN contains(lower(concat_ws(' ', name, summary)), 'memory') THEN 1 ELSE 0 END) + (CASE WHEN contains(lower(concat_ws(' ', name, summary)), 'index') THEN 1 ELSE 0 END)) / 2e0 * (0.5e0 + 0.5e0 * importance_score) AS score FROM ent), gt AS (SELECT * FROM g WHERE score > 0 ORDER BY score DESC, id LIMIT 5)"""


@query("drift_adaptive", _DL + ", " + _DG + " SELECT id, round(sum(score), 6) AS score FROM (SELECT id, score * 0.4e0 AS score FROM gt UNION ALL SELECT id, score * 0.6e0 FROM l) GROUP BY id")
def _(spark, d):
    c = V.entities(spark, d).select("id", F.concat_ws(" ", "name", "summary").alias("text"), F.col("importance_score").alias("importance"))
    return R.drift_adaptive(R.drift_global("memory index", c), _local(spark, d)).select("id", F.round("score", 6).alias("score"))


# --- time


@query("snapshot_counts", f"WITH {ENT}, {REL} SELECT 'entities' AS kind, count(*) AS n FROM ent WHERE created_at <= TIMESTAMP '{AT}' UNION ALL SELECT 'relationships', count(*) FROM rel WHERE (valid_from IS NULL OR valid_from <= TIMESTAMP '{AT}') AND (valid_until IS NULL OR TIMESTAMP '{AT}' < valid_until)")
def _(spark, d):
    return D.snapshot_counts(V.entities(spark, d), V.relationships(spark, d), D.ts(AT))


@query("what_changed", f"""WITH {ENT}, {REL}, w AS (SELECT TIMESTAMP '2020-01-01' AS a, TIMESTAMP '2020-12-31' AS b) SELECT id, CASE WHEN created_at BETWEEN a AND b THEN 'entity_added' ELSE 'entity_modified' END AS change FROM ent, w WHERE created_at BETWEEN a AND b OR updated_at BETWEEN a AND b
UNION ALL SELECT id, 'relationship_added' FROM rel, w WHERE created_at BETWEEN a AND b UNION ALL SELECT id, 'relationship_invalidated' FROM rel, w WHERE expired_at BETWEEN a AND b""")
def _(spark, d):
    return D.what_changed(V.entities(spark, d), V.relationships(spark, d), "2020-01-01", "2020-12-31")


@query("version_at", f"WITH {VER} SELECT relationship_id, arg_max(version, (created_at, version)) AS version FROM ver WHERE valid_from <= TIMESTAMP '{AT}' AND (valid_until IS NULL OR TIMESTAMP '{AT}' < valid_until) AND (superseded_at IS NULL OR TIMESTAMP '{AT}' < superseded_at) GROUP BY 1")
def _(spark, d):
    return D.version_at(V.versions(spark, d), D.ts(AT)).select("relationship_id", "version")


@query("allen_relations", f"""WITH {VER}, v AS (SELECT relationship_id, version, valid_from AS a0, valid_until AS a1, lead(version) OVER o AS next_version, lead(valid_from) OVER o AS b0, lead(valid_until) OVER o AS b1 FROM ver WINDOW o AS (PARTITION BY relationship_id ORDER BY created_at, version)),
c AS (SELECT relationship_id, version, next_version, a0, coalesce(a1, TIMESTAMP '9999-12-31') AS a1, b0, coalesce(b1, TIMESTAMP '9999-12-31') AS b1 FROM v WHERE next_version IS NOT NULL)
SELECT relationship_id, version, next_version, CASE WHEN a1 = b0 THEN 'meets' WHEN a0 = b0 AND a1 < b1 THEN 'starts' WHEN a1 = b1 AND a0 > b0 THEN 'finishes' WHEN a0 >= b0 AND a1 <= b1 THEN 'during' WHEN a0 < b0 AND a1 > b0 AND a1 < b1 THEN 'overlaps' WHEN a1 < b0 THEN 'before' ELSE 'after' END AS relation FROM c""")
def _(spark, d):
    from pyspark.sql import Window

    o = Window.partitionBy("relationship_id").orderBy("created_at", "version")
    v = V.versions(spark, d).select("relationship_id", "version", "valid_from", "valid_until", F.lead("version").over(o).alias("next_version"), F.lead("valid_from").over(o).alias("b0"), F.lead("valid_until").over(o).alias("b1")).where("next_version IS NOT NULL")
    return v.select("relationship_id", "version", "next_version", D.allen(F.col("valid_from"), F.col("valid_until"), F.col("b0"), F.col("b1")).alias("relation"))


@query("fact_supersession", f"WITH {VER} SELECT relationship_id, version, lead(version) OVER (PARTITION BY relationship_id ORDER BY created_at, version) AS superseded_by_version, superseded_at IS NULL AS is_current FROM ver")
def _(spark, d):
    from pyspark.sql import Window

    o = Window.partitionBy("relationship_id").orderBy("created_at", "version")
    return V.versions(spark, d).select("relationship_id", "version", F.lead("version").over(o).alias("superseded_by_version"), F.col("superseded_at").isNull().alias("is_current"))


@query("entity_change_log", "WITH h AS (SELECT DISTINCT seq, entity_id, changed_at, new_summary FROM entity_history WHERE new_summary IS NOT NULL), l AS (SELECT *, lag(new_summary) OVER (PARTITION BY entity_id ORDER BY changed_at, seq) AS before FROM h) SELECT seq, entity_id, before IS NULL AS first, coalesce(before, '') <> new_summary AS changed FROM l")
def _(spark, d):
    from pyspark.sql import Window

    h = load(spark, d, "entity_history").where("new_summary IS NOT NULL").select("seq", "entity_id", "changed_at", "new_summary").distinct()
    before = F.lag("new_summary").over(Window.partitionBy("entity_id").orderBy("changed_at", "seq"))
    return h.withColumn("before", before).select("seq", "entity_id", F.col("before").isNull().alias("first"), (F.coalesce("before", F.lit("")) != F.col("new_summary")).alias("changed"))


@query("decay_importance", f"""WITH {ENT}, {REL}, g AS (SELECT id, count(*) AS degree FROM (SELECT source_id AS id FROM rel UNION ALL SELECT target_id FROM rel) GROUP BY id)
SELECT ent.id, round(least(1e0, greatest(0e0, importance_score * exp(-0.001e0 * floor((epoch(TIMESTAMP '2024-06-01')::BIGINT - epoch(updated_at)::BIGINT) / 86400)) + ln(access_count + 1e0) / 10 + ln(coalesce(degree, 0) + 1e0) / 10)), 6) AS importance FROM ent LEFT JOIN g USING (id)""")
def _(spark, d):
    r = V.relationships(spark, d)
    deg = r.select(F.col("source_id").alias("id")).union(r.select("target_id")).groupBy("id").agg(F.count(F.lit(1)).alias("degree"))
    return D.decayed(V.entities(spark, d), deg, D.ts("2024-06-01")).select("id", F.round("importance", 6).alias("importance"))


# --- branches: a log out of line items

_LOG = "log AS (SELECT CASE l_linenumber % 3 WHEN 0 THEN 'main' WHEN 1 THEN 'draft' ELSE 'idea' END AS branch, l_orderkey * 10 + l_linenumber AS seq, CASE WHEN l_returnflag = 'R' THEN 'remove' ELSE 'add' END AS op, 'entity' AS kind, 'part:' || l_partkey AS id FROM lineitem), dl AS (SELECT branch, kind, id, arg_max(op, seq) AS op FROM log GROUP BY ALL)"


def _log(spark, d):
    n = F.col("l_linenumber") % 3
    return load(spark, d, "lineitem").select(F.when(n == 0, "main").when(n == 1, "draft").otherwise("idea").alias("branch"), (F.col("l_orderkey") * 10 + F.col("l_linenumber")).alias("seq"), F.when(F.col("l_returnflag") == "R", "remove").otherwise("add").alias("op"), F.lit("entity").alias("kind"), F.concat(F.lit("part:"), "l_partkey").alias("id"))


def _branches(spark):
    return spark.createDataFrame([("main", None, "open"), ("draft", "main", "open"), ("idea", "draft", "open")], "branch string, parent string, status string")


@query("branch_diff", f"WITH {_LOG} SELECT kind, id, op FROM dl WHERE branch = 'draft' AND NOT EXISTS (SELECT 1 FROM dl m WHERE m.branch = 'main' AND m.id = dl.id AND m.op = dl.op)")
def _(spark, d):
    return B.diff(_log(spark, d), "draft", "main")


@query("branch_merge_conflicts", f"WITH {_LOG} SELECT s.kind, s.id, s.op AS source_op, t.op AS target_op FROM dl s JOIN dl t USING (kind, id) WHERE s.branch = 'draft' AND t.branch = 'main' AND s.op <> t.op")
def _(spark, d):
    return B.conflicts(_log(spark, d), "draft", "main")


@query("branch_merge", f"WITH {_LOG} SELECT op, count(*) AS n FROM (SELECT id, coalesce(s.op, t.op) AS op FROM (SELECT * FROM dl WHERE branch = 'main') t FULL JOIN (SELECT * FROM dl WHERE branch = 'draft') s USING (id)) GROUP BY op")
def _(spark, d):
    return B.delta(B.merge(_log(spark, d), "draft", "main")).where("branch = 'main'").groupBy("op").agg(F.count(F.lit(1)).alias("n"))


@query("branch_visible", f"WITH {_LOG}, r AS (SELECT id, arg_min(op, CASE branch WHEN 'idea' THEN 0 WHEN 'draft' THEN 1 ELSE 2 END) AS op FROM dl GROUP BY id), b AS (SELECT 'part:' || p_partkey AS id FROM part) SELECT id FROM b FULL JOIN r USING (id) WHERE op IS NULL OR op = 'add'")
def _(spark, d):
    base = load(spark, d, "part").select(F.concat(F.lit("part:"), "p_partkey").alias("id"))
    return B.visible(_log(spark, d), _branches(spark), "idea", base)


# --- ingestion

_NORM = "trim(regexp_replace(translate(lower(name), '_-', '  '), '\\s+', ' ', 'g'))"


@query("name_dedup", f"WITH {ENT}, k AS (SELECT id, {_NORM} AS k FROM ent), m AS (SELECT k, min(id) AS into FROM k WHERE k <> '' GROUP BY k) SELECT id, m.into FROM k JOIN m USING (k) WHERE id <> m.into".replace("AS into", 'AS "into"').replace("m.into", 'm."into"'))
def _(spark, d):
    return I.duplicate_names(V.entities(spark, d))


@query("merged_entities", f"WITH {ENT}, k AS (SELECT *, {_NORM} AS k FROM ent) SELECT k, min(id) AS id, count(*) AS merged, arg_max(summary, (length(coalesce(summary, '')), coalesce(summary, ''))) AS summary, sum(access_count)::BIGINT AS access_count FROM k WHERE k <> '' GROUP BY k")
def _(spark, d):
    return I.merge_entities(V.entities(spark, d)).select("k", "id", "merged", "summary", "access_count")


@query("learned_types", f"WITH {ENT} SELECT lower(entity_type) AS entity_type, count(*) AS n FROM ent WHERE lower(entity_type) NOT IN ('person', 'organization', 'location') GROUP BY 1")
def _(spark, d):
    return I.learned_types(V.entities(spark, d), ["Person", "Organization", "Location"])


@query("relation_cardinality", f"WITH {REL} SELECT relationship_type, CASE WHEN relationship_type IN ({', '.join(repr(x) for x in I.EXCLUSIVE)}) THEN 'exclusive' ELSE 'non_exclusive' END AS cardinality, count(*) AS n FROM rel GROUP BY ALL")
def _(spark, d):
    return V.relationships(spark, d).select("relationship_type", I.cardinality(F.col("relationship_type")).alias("cardinality")).groupBy("relationship_type", "cardinality").agg(F.count(F.lit(1)).alias("n"))


@query("resolved_edges", f"""WITH {REL}, n AS (SELECT * FROM rel WHERE created_at >= TIMESTAMP '2020-01-01'), o AS (SELECT * FROM rel WHERE created_at < TIMESTAMP '2020-01-01' AND expired_at IS NULL AND valid_until IS NULL),
x AS (SELECT DISTINCT o.id FROM n JOIN o ON n.source_id = o.source_id AND n.relationship_type = o.relationship_type WHERE n.target_id <> o.target_id) SELECT r.relationship_type, count(*) FILTER (r.valid_until IS NULL AND x.id IS NULL) AS open, count(*) AS n FROM rel r LEFT JOIN x USING (id) GROUP BY 1""")
def _(spark, d):
    r = V.relationships(spark, d)
    c = I.detect_conflicts(r.where(F.col("created_at") >= D.ts("2020-01-01")), r.where((F.col("created_at") < D.ts("2020-01-01")) & D.valid_now()))
    return I.resolve(r, c, D.ts("2024-01-01")).groupBy("relationship_type").agg(F.count_if(F.col("valid_until").isNull()).alias("open"), F.count(F.lit(1)).alias("n"))


@query("paper_dedup")
def _(spark, d):
    return I.duplicate_papers(load(spark, d, "papers").dropDuplicates(["id", "title", "year", "citation_count"]))


@query("ingested_counts")
def _(spark, d):
    def extract(episodes):
        r = episodes.select("id", F.explode(X.relation_pairs(F.col("text"))).alias("r")).select("id", "r.*")
        names = r.select(F.explode(F.array("source", "target")).alias("name"), F.lit("Entity").alias("entity_type"), F.col("id").alias("episode"))
        return names, r.select("source", "target", F.col("relation").alias("relationship_type"), F.concat_ws(" ", "source", "relation", "target").alias("fact"), F.col("id").alias("episode"))

    e = V.memory(spark, d).where("content IS NOT NULL").select("id", F.col("content").alias("text"))
    out = I.ingest(e, extract, {"entities": V.entities(spark, d).select("id", "name", "entity_type", "summary", "created_at", "updated_at"), "relationships": V.relationships(spark, d)}, D.ts("2024-01-01"))
    from chronoloom.operators.store import stats

    return stats(out)


# --- memory

_IDLE = "floor((epoch(TIMESTAMP '2024-02-01')::BIGINT - epoch(last_accessed)::BIGINT) / 3600)"


@query("tier_assignment", f"WITH {MEM} SELECT id, CASE WHEN tier = 'working' AND access_count >= 3 THEN 'episodic' WHEN tier = 'episodic' AND access_count >= 10 AND importance >= 0.6 THEN 'semantic' WHEN tier = 'episodic' AND {_IDLE} > 168 AND importance < 0.3 THEN 'evicted' WHEN tier = 'semantic' AND access_count >= 50 THEN 'procedural' ELSE tier END AS tier FROM mem")
def _(spark, d):
    idle = F.floor((F.unix_seconds(D.ts("2024-02-01")) - F.unix_seconds("last_accessed")) / 3600)
    return V.memory(spark, d).select("id", M.next_tier(F.col("tier"), F.col("access_count"), F.col("importance"), idle).alias("tier"))


@query("tier_stats", f"WITH {MEM} SELECT tier, count(*) AS n, sum(access_count)::BIGINT AS accesses FROM mem GROUP BY tier")
def _(spark, d):
    return V.memory(spark, d).groupBy("tier").agg(F.count(F.lit(1)).alias("n"), F.sum("access_count").alias("accesses"))


@query("tier_overflow", f"WITH {MEM}, r AS (SELECT id, row_number() OVER (ORDER BY last_accessed DESC NULLS LAST, id) AS rn FROM mem WHERE tier = 'working') SELECT tier, count(*) AS n FROM (SELECT CASE WHEN mem.tier = 'working' AND r.rn > 30 THEN 'episodic' ELSE mem.tier END AS tier FROM mem LEFT JOIN r USING (id)) GROUP BY tier")
def _(spark, d):
    return M.overflow(V.memory(spark, d), 30).groupBy("tier").agg(F.count(F.lit(1)).alias("n"))


@query("recorded_access", f"WITH {MEM}, l AS (SELECT source_episode AS id, count(*) AS more FROM mem WHERE source_episode IS NOT NULL GROUP BY 1) SELECT mem.id, access_count + coalesce(more, 0) AS access_count FROM mem LEFT JOIN l USING (id)")
def _(spark, d):
    m = V.memory(spark, d)
    log = m.where("source_episode IS NOT NULL").select(F.col("source_episode").alias("id"), F.col("created_at").alias("at"))
    return M.record_access(m, log).select("id", "access_count")


@query("evolved_memory")
def _(spark, d):
    m = V.memory(spark, d).where("content IS NOT NULL").select("id", "access_count", F.coalesce("last_accessed", "created_at").alias("last_accessed"), F.greatest(F.coalesce(F.size("entity_ids"), F.lit(0)), F.lit(0)).alias("degree"), "content")
    return M.evolve(m, D.ts("2024-02-01"), cap=500)


@query("cosine_consolidate")
def _(spark, d):
    return M.consolidate(V.memory(spark, d).select("id", F.col("embedding").alias("v"), "importance"), threshold=0.9)


@query("memory_by_session", f"WITH {MEM} SELECT metadata['session'] AS session, count(*) AS n FROM mem WHERE metadata['session'] IS NOT NULL GROUP BY 1")
def _(spark, d):
    return V.memory(spark, d).select(F.try_element_at("metadata", F.lit("session")).alias("session")).where("session IS NOT NULL").groupBy("session").agg(F.count(F.lit(1)).alias("n"))


@query("by_label", f"WITH {ENT} SELECT id FROM ent WHERE list_contains(labels, 'Organization')")
def _(spark, d):
    return V.entities(spark, d).where(F.array_contains("labels", "Organization")).select("id")


@query("learned_values")
def _(spark, d):
    e = load(spark, d, "events").select(F.concat_ws(":", "event_type", (F.col("user_id") % 5).cast("string")).alias("state"), F.col("event_id").alias("seq"), (F.col("value") > 5).alias("keep"), (F.col("value") / 20).alias("reward"))
    return M.learn(e)


# --- views


@query("entity_cooccurrence", f"""WITH {MEM}, e AS (SELECT id, list_sort(list_distinct(entity_ids)) AS e FROM mem WHERE len(list_distinct(entity_ids)) > 1), x AS (SELECT id, unnest(e) AS n, generate_subscripts(e, 1) AS i FROM e) SELECT p.n AS a, q.n AS b, count(*) * 0.5e0 AS weight FROM x p JOIN x q ON p.id = q.id AND p.i < q.i GROUP BY ALL""")
def _(spark, d):
    return MG.entity_edges(V.memory(spark, d).where("entity_ids IS NOT NULL"))


@query("temporal_view", f"WITH {MEM}, s AS (SELECT id, 1e0 / (1e0 + floor((epoch(TIMESTAMP '{AT}')::BIGINT - epoch(valid_from)::BIGINT) / 86400) / 30e0) AS score FROM mem WHERE valid_from <= TIMESTAMP '{AT}' AND (valid_until IS NULL OR TIMESTAMP '{AT}' < valid_until)) SELECT id, round(score, 6) AS score FROM s ORDER BY s.score DESC, id LIMIT 40")
def _(spark, d):
    return MG.temporal_view(V.memory(spark, d), D.ts(AT), 40).select("id", F.round("score", 6).alias("score"))


@query("view_fusion", """WITH l(id, score, view, w) AS (SELECT o_custkey, max(o_totalprice), 'entity', 0.5e0 FROM orders WHERE o_orderstatus = 'F' GROUP BY 1 UNION ALL SELECT o_custkey, max(o_totalprice), 'semantic', 0.4e0 FROM orders WHERE o_orderstatus = 'O' GROUP BY 1 UNION ALL SELECT o_custkey, max(o_totalprice), 'temporal', 0.1e0 FROM orders WHERE o_orderstatus = 'P' GROUP BY 1),
r AS (SELECT *, row_number() OVER (PARTITION BY view ORDER BY score DESC, id) - 1 AS rank FROM l) SELECT id, round(sum(w / (61e0 + rank)) * power(1.3e0, count(DISTINCT view) - 1), 6) AS score, count(DISTINCT view) AS views FROM r WHERE rank < 50 GROUP BY id""")
def _(spark, d):
    o = load(spark, d, "orders")
    part = lambda s: o.where(F.col("o_orderstatus") == s).groupBy(F.col("o_custkey").alias("id")).agg(F.max("o_totalprice").alias("score")).orderBy(F.desc("score"), "id").limit(50)
    return MG.fuse({"entity": part("F"), "semantic": part("O"), "temporal": part("P")}, MG.VIEW_WEIGHTS["factual"]).select("id", F.round("score", 6).alias("score"), "views")


@query("causal_view")
def _(spark, d):
    return MG.causal_edges(V.memory(spark, d).where("entity_ids IS NOT NULL"))


@query("multigraph_stats")
def _(spark, d):
    m = V.memory(spark, d)
    e = m.where("entity_ids IS NOT NULL")
    at = m.select("id", F.col("valid_from").alias("at"), F.col("valid_until").alias("until"), F.struct("created_at", "id").alias("seq"))
    return MG.stats({"entity": MG.entity_edges(e), "causal": MG.causal_edges(e), "temporal": D.temporal_edges(at, 7)})


@query("tool_plan")
def _(spark, d):
    q = spark.createDataFrame([("what is a graph",), ("find the paper",), ("snapshot as of May",), ("hello",)], "question string")
    return q.select("question", Q.plan_tools(F.col("question")).alias("tools"), MG.plan(F.col("question")).alias("views"))


@query("assembled_context")
def _(spark, d):
    e = V.entities(spark, d).orderBy(F.desc("importance_score"), "id").limit(10).select("name", "summary")
    f = V.relationships(spark, d).orderBy(F.desc("confidence"), "id").limit(10).select("fact", D.valid_now().alias("current"))
    c = G.summaries(V.entities(spark, d).select("id", F.col("group_id").alias("community")), V.entities(spark, d)).orderBy("community").limit(3).select("summary")
    return Q.assemble_context(e, f, c, 400)


# --- streams and sources


@query("tumbling_counts", "SELECT event_type, floor(epoch(time_bucket(INTERVAL 1 DAY, ts)))::BIGINT AS start_s, count(*) AS n, round(sum(value), 4) AS total FROM events GROUP BY ALL")
def _(spark, d):
    return live.tumbling(load(spark, d, "events")).select("event_type", "start_s", "n", F.round("total", 4).alias("total"))


@query("sliding_counts", "SELECT event_type, s AS start_s, count(*) AS n FROM (SELECT event_type, unnest([floor(epoch(ts) / 43200)::BIGINT * 43200, floor(epoch(ts) / 43200)::BIGINT * 43200 - 43200]) AS s FROM events) GROUP BY ALL")
def _(spark, d):
    return live.sliding(load(spark, d, "events"), "1 day", "12 hours")


@query("session_counts", "WITH l AS (SELECT user_id, ts, event_id, CASE WHEN ts - lag(ts) OVER (PARTITION BY user_id ORDER BY ts, event_id) <= INTERVAL 30 MINUTE THEN 0 ELSE 1 END AS new FROM events), g AS (SELECT *, sum(new) OVER (PARTITION BY user_id ORDER BY ts, event_id ROWS UNBOUNDED PRECEDING) AS s FROM l) SELECT user_id, epoch_us(min(ts)) AS start_us, count(*) AS n FROM g GROUP BY user_id, s")
def _(spark, d):
    return live.sessions(load(spark, d, "events"))


@query("streamed_counts", "SELECT event_type, floor(epoch(time_bucket(INTERVAL 1 DAY, ts)))::BIGINT AS start_s, count(*) AS n FROM events WHERE time_bucket(INTERVAL 1 DAY, ts) + INTERVAL 1 DAY <= (SELECT max(ts) - INTERVAL 1 HOUR FROM events) GROUP BY ALL")
def _(spark, d):
    return live.run(live.tumbling(live.read_events(spark, d, files_per_batch=10_000))).select("event_type", "start_s", "n")


@query("streamed_tiers")
def _(spark, d):
    at = shared_path(spark, "tiers")
    live.keep_up(live.access_counts(live.read_events(spark, d)), lambda batch, n: batch.write.mode("append").parquet(at))
    return spark.read.parquet(at).groupBy("user_id").agg(F.max("access_count").alias("access_count"), F.max_by("tier", "access_count").alias("tier"))


@query("paged_documents")
def _(spark, d):
    return readers.pages(load(spark, d, "documents").where("source = 'manual'"), "doc_id", "text", 1000)


@query("json_episodes", "SELECT CAST(event_id AS VARCHAR) AS id, json_valid(props) AS valid FROM events")
def _(spark, d):
    return readers.json_episodes(load(spark, d, "events"), "props", "event_id").select("id", "valid")


@query("message_episodes", "SELECT CAST(doc_id AS VARCHAR) AS id, strlen(source || ': ' || lang) AS bytes FROM documents WHERE source = 'chat_log' AND lang IS NOT NULL")
def _(spark, d):
    return readers.message_episodes(load(spark, d, "documents").where("source = 'chat_log' AND lang IS NOT NULL"), "source", "lang", "doc_id").select("id", F.octet_length("content").alias("bytes"))


# --- notes and the facade


def _notes(spark, d):
    from chronoloom.operators import notes as N

    return N, N.notes(V.memory(spark, d))


@query("note_strength", f"WITH {MEM} SELECT id, least(10e0, 1e0 + 0.5e0 * coalesce(access_count, 0)) AS strength FROM mem WHERE content IS NOT NULL")
def _(spark, d):
    return _notes(spark, d)[1].select("id", "strength")


@query("note_links")
def _(spark, d):
    N, rows = _notes(spark, d)
    return N.keyword_links(rows).select("a", "b", F.round("score", 6).alias("score"))


@query("note_growth")
def _(spark, d):
    N, rows = _notes(spark, d)
    return N.grow(rows, N.keyword_links(rows)).select("id", F.array_join("keywords", ",").alias("keywords"))


@query("note_search")
def _(spark, d):
    N, rows = _notes(spark, d)
    return N.search(rows, lambda: N.keyword_links(rows), "review the ranking function", 20)


@query("note_retention", f"WITH {MEM} SELECT id, round(exp(-floor(greatest(epoch(TIMESTAMP '2024-02-01')::BIGINT - epoch(last_accessed)::BIGINT, 0) / 3600e0) / (least(10e0, 1e0 + 0.5e0 * coalesce(access_count, 0)) * 24e0)), 6) AS retention FROM mem WHERE content IS NOT NULL AND exp(-floor(greatest(epoch(TIMESTAMP '2024-02-01')::BIGINT - epoch(last_accessed)::BIGINT, 0) / 3600e0) / (least(10e0, 1e0 + 0.5e0 * coalesce(access_count, 0)) * 24e0)) >= 0.000001")
def _(spark, d):
    N, rows = _notes(spark, d)
    last = V.memory(spark, d).select("id", F.col("last_accessed").alias("at"))
    return N.retained(rows, last, D.ts("2024-02-01"), 0.000001).select("id", F.round("retention", 6).alias("retention"))


def _engine(spark, d):
    from chronoloom.engine import Engine

    return Engine(spark, V.entities(spark, d).select("id", "name", "entity_type", "summary", "created_at", "updated_at"), V.relationships(spark, d))


@query("engine_search")
def _(spark, d):
    return _engine(spark, d).search("institute of network science", 15).select("id", F.round("score", 6).alias("score"), "sources")


@query("engine_context")
def _(spark, d):
    return _engine(spark, d).context("institute of network science", 500)


@query("engine_time_travel", f"WITH {ENT}, {REL} SELECT 'entities' AS kind, count(*) AS n FROM ent WHERE created_at <= TIMESTAMP '2019-03-01' UNION ALL SELECT 'relationships', count(*) FROM rel WHERE (valid_from IS NULL OR valid_from <= TIMESTAMP '2019-03-01') AND (valid_until IS NULL OR TIMESTAMP '2019-03-01' < valid_until)")
def _(spark, d):
    from chronoloom.operators.store import stats

    then = _engine(spark, d).at("March 2019")
    return stats({"entities": then.entities, "relationships": then.relationships})


# --- agent steps


@query("traversal_channel", f"WITH RECURSIVE {SMALL}, {BOTH}, h(id, d) AS (SELECT 'nation:3', 0 UNION SELECT u.b, h.d + 1 FROM h JOIN u ON u.a = h.id WHERE h.d < 2), m AS (SELECT id, min(d) AS d FROM h GROUP BY id HAVING min(d) > 0) SELECT id, round(1e0 / (1e0 + 0.3e0 * (row_number() OVER (ORDER BY d, id) - 1)), 6) AS score FROM m ORDER BY d, id LIMIT 25")
def _(spark, d):
    from chronoloom.operators.agent import traversal_hits

    return traversal_hits(both(V.small_graph(spark, d)), "nation:3", 2, 25).select("id", F.round("score", 6).alias("score"))


@query("connections", f"WITH {SMALL} SELECT 'supplier:1' AS id, 2 AS hops UNION ALL SELECT 'nation:' || s_nationkey, 2 FROM supplier WHERE s_suppkey = 1 UNION ALL SELECT 'region:' || n_regionkey, 2 FROM supplier JOIN nation ON n_nationkey = s_nationkey WHERE s_suppkey = 1")
def _(spark, d):
    from chronoloom.operators.agent import find_connections

    s = load(spark, d, "supplier").where("s_suppkey = 1").join(load(spark, d, "nation"), F.col("s_nationkey") == F.col("n_nationkey")).first()
    return find_connections(both(V.small_graph(spark, d)), "supplier:1", f"region:{s['n_regionkey']}", 2)


@query("ann_search")
def _(spark, d):
    from chronoloom.operators.ann import ProjectionIndex

    e = load(spark, d, "embeddings")
    index = ProjectionIndex(64)
    return index.search_all(index.build(e, "vec_id", "embedding"), e.where("vec_id % 100 = 0"), "vec_id", "embedding", 10).select("query", "id", F.round("score", 6).alias("score"), "rank")


@query("answer_report", f"""WITH {ENT}, j AS (SELECT entity_type AS question_type, lower(trim(coalesce(summary, ''))) AS p, lower(trim(name)) AS t FROM ent WHERE entity_type IS NOT NULL) SELECT question_type, count(*) AS n, round(avg(CASE WHEN p = '' THEN 0e0 WHEN contains(p, t) OR contains(t, p) THEN 1e0 ELSE 0e0 END), 6) AS accuracy FROM j GROUP BY ROLLUP (question_type)""")
def _(spark, d):
    from chronoloom.operators.agent import evaluate

    e = V.entities(spark, d).where("entity_type IS NOT NULL").select(F.col("entity_type").alias("question_type"), F.coalesce("summary", F.lit("")).alias("predicted"), F.col("name").alias("truth"), F.lit(0.0).alias("latency"))
    return evaluate(e).select("question_type", "n", F.round("accuracy", 6).alias("accuracy"))
