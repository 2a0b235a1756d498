"""Queries: scans, predicates, joins, aggregates, windows, sorts and set operations over the graph tables."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from chronoloom.functions import text as T
from chronoloom.operators import graph as G
from chronoloom.operators import store as S
from chronoloom.operators import temporal as D
from chronoloom.operators import views as V
from chronoloom.operators.views import ENT, MEM, REL, SMALL, VER
from chronoloom.tables import load

AT = "2021-01-01 00:00:00"
QUERIES: dict = {}
ORACLE: dict = {}


def query(name: str, sql: str | None = None):
    """Register a query and the SQL it is held against."""

    def keep(f):
        QUERIES[name] = f
        if sql:
            ORACLE[name] = sql
        return f

    return keep


@query("tenant_scan_limit", "SELECT c_custkey, c_name, c_mktsegment FROM customer WHERE c_mktsegment = 'BUILDING' ORDER BY c_custkey LIMIT 50")
def _(spark, d):
    df = load(spark, d, "customer").select("c_custkey", "c_name", "c_mktsegment", F.col("c_mktsegment").alias("group_id"))
    return S.scan(df, "BUILDING", 50, "c_custkey").drop("group_id")


@query("group_scan", f"WITH {ENT} SELECT id, name FROM ent WHERE group_id = 'grp-00001' ORDER BY id LIMIT 40")
def _(spark, d):
    return S.scan(V.entities(spark, d), "grp-00001", 40).select("id", "name")


@query("recent_episodes", "SELECT doc_id, group_id FROM documents WHERE group_id = 'grp-00000' ORDER BY created_at DESC, doc_id LIMIT 20")
def _(spark, d):
    return load(spark, d, "documents").where("group_id = 'grp-00000'").orderBy(F.desc("created_at"), "doc_id").limit(20).select("doc_id", "group_id")


@query("point_lookup", f"WITH {ENT} SELECT id, name, entity_type FROM ent WHERE id = (SELECT min(id) FROM ent)")
def _(spark, d):
    e = V.entities(spark, d)
    return S.get(e, e.agg(F.min("id")).first()[0]).select("id", "name", "entity_type")


@query("multi_lookup", f"WITH {ENT}, {REL} SELECT id, name FROM ent WHERE id IN (SELECT source_id FROM rel WHERE relationship_type = 'MANAGES')")
def _(spark, d):
    ids = V.relationships(spark, d).where("relationship_type = 'MANAGES'").select(F.col("source_id").alias("id"))
    return S.get_many(V.entities(spark, d), ids).select("id", "name")


@query("adjacent_edges", f"WITH {SMALL} SELECT source_id, target_id, relationship_type FROM small WHERE source_id = 'nation:3' OR target_id = 'nation:3'")
def _(spark, d):
    return S.adjacent(V.small_graph(spark, d), "nation:3").select("source_id", "target_id", "relationship_type")


@query("upsert_latest", "SELECT o_custkey AS id, o_orderkey, o_orderpriority FROM (SELECT *, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderdate DESC, o_orderkey DESC) AS rn FROM orders) WHERE rn = 1")
def _(spark, d):
    o = load(spark, d, "orders").select(F.col("o_custkey").alias("id"), "o_orderkey", "o_orderpriority", "o_orderdate")
    return S.upsert(o.where("o_orderdate < '1998-01-01'"), o, "id", "o_orderdate", "o_orderkey").select("id", "o_orderkey", "o_orderpriority")


@query("delete_cascade_counts", f"WITH {SMALL} SELECT 'entities' AS kind, (SELECT count(*) FROM nation) - 3 AS n UNION ALL SELECT 'relationships', count(*) FROM small WHERE source_id NOT IN ('nation:1','nation:2','nation:5') AND target_id NOT IN ('nation:1','nation:2','nation:5')")
def _(spark, d):
    nodes = load(spark, d, "nation").select(F.concat(F.lit("nation:"), "n_nationkey").alias("id"))
    e, r = S.delete_with_edges(nodes, V.small_graph(spark, d), nodes.where(F.col("id").isin("nation:1", "nation:2", "nation:5")))
    return S.stats({"entities": e, "relationships": r})


@query("delete_relationship", f"WITH {REL} SELECT relationship_type, count(*) AS n FROM rel WHERE id <> (SELECT min(id) FROM rel) GROUP BY 1")
def _(spark, d):
    r = V.relationships(spark, d)
    return r.join(r.agg(F.min("id").alias("id")), "id", "left_anti").groupBy("relationship_type").agg(F.count(F.lit(1)).alias("n"))


@query("store_stats", f"WITH {ENT}, {REL} SELECT 'entities' AS kind, count(*) AS n FROM ent UNION ALL SELECT 'relationships', count(*) FROM rel UNION ALL SELECT 'episodes', count(*) FROM documents")
def _(spark, d):
    return S.stats({"entities": V.entities(spark, d), "relationships": V.relationships(spark, d), "episodes": load(spark, d, "documents")})


@query("valid_now", f"WITH {REL} SELECT relationship_type, count(*) AS n FROM rel WHERE expired_at IS NULL AND valid_until IS NULL GROUP BY 1")
def _(spark, d):
    return V.relationships(spark, d).where(D.valid_now()).groupBy("relationship_type").agg(F.count(F.lit(1)).alias("n"))


@query("valid_at", f"WITH {REL} SELECT id FROM rel WHERE (valid_from IS NULL OR valid_from <= TIMESTAMP '{AT}') AND (valid_until IS NULL OR TIMESTAMP '{AT}' < valid_until)")
def _(spark, d):
    return V.relationships(spark, d).where(D.valid_at(D.ts(AT))).select("id")


@query("valid_at_strict", f"WITH {REL} SELECT id FROM rel WHERE (valid_from IS NULL OR valid_from <= TIMESTAMP '{AT}') AND (valid_until IS NULL OR TIMESTAMP '{AT}' < valid_until) AND expired_at IS NULL")
def _(spark, d):
    return V.relationships(spark, d).where(D.valid_at(D.ts(AT), honour_expired=True)).select("id")


@query("known_at", f"WITH {REL} SELECT id FROM rel WHERE created_at <= TIMESTAMP '{AT}' AND (expired_at IS NULL OR TIMESTAMP '{AT}' < expired_at)")
def _(spark, d):
    return V.relationships(spark, d).where(D.known_at(D.ts(AT))).select("id")


@query("ttl_expired", f"WITH {ENT} SELECT id FROM ent WHERE TIMESTAMP '{AT}' - INTERVAL 365 DAY > created_at")
def _(spark, d):
    return V.entities(spark, d).where(D.expired_by_ttl(F.col("created_at"), D.ts(AT), 365)).select("id")


@query("prune_candidates", f"WITH {ENT} SELECT id, importance_score FROM ent WHERE importance_score < 0.3 AND access_count < 3 ORDER BY importance_score, id LIMIT 25")
def _(spark, d):
    return V.entities(spark, d).where("importance_score < 0.3 AND access_count < 3").orderBy("importance_score", "id").limit(25).select("id", "importance_score")


@query("changes_between", "SELECT DISTINCT seq, entity_id, change_type FROM entity_history WHERE changed_at BETWEEN TIMESTAMP '2019-01-01' AND TIMESTAMP '2019-12-31'")
def _(spark, d):
    return load(spark, d, "entity_history").where(F.col("changed_at").between(D.ts("2019-01-01"), D.ts("2019-12-31"))).select("seq", "entity_id", "change_type").distinct()


@query("since_year", "SELECT DISTINCT id, year FROM papers WHERE year IS NULL OR year >= 2020")
def _(spark, d):
    return load(spark, d, "papers").where("year IS NULL OR year >= 2020").select("id", "year").distinct()


@query("validate_edges", f"""WITH {REL}, x AS (SELECT id, CASE WHEN id LIKE '0%' THEN '' ELSE fact END AS fact, relationship_type, confidence, source_id, target_id FROM rel)
SELECT id, concat_ws(',', CASE WHEN source_id = '' THEN 'empty source' END, CASE WHEN target_id = '' THEN 'empty target' END, CASE WHEN relationship_type = '' THEN 'empty type' END, CASE WHEN trim(fact) = '' THEN 'empty fact' END) AS errors,
concat_ws(',', CASE WHEN confidence < 0 OR confidence > 1 THEN 'confidence' END, CASE WHEN relationship_type NOT IN ('WORKS_AT','LIVES_IN','MANAGES') THEN 'unknown type' END) AS warnings FROM x""")
def _(spark, d):
    from chronoloom.operators.ingest import validate_edges

    r = V.relationships(spark, d).withColumn("fact", F.when(F.col("id").like("0%"), F.lit("")).otherwise(F.col("fact")))
    return validate_edges(r, ["WORKS_AT", "LIVES_IN", "MANAGES"])


@query("entity_text_search", f"""WITH {ENT}, s AS (SELECT id, ((CASE WHEN contains(lower(name || ' ' || coalesce(summary, '')), 'institute') THEN 1 ELSE 0 END) + (CASE WHEN contains(lower(name || ' ' || coalesce(summary, '')), 'science') THEN 1 ELSE 0 END)) / 2.0::DOUBLE
 * CASE WHEN contains(lower(name), 'institute science') THEN 2.0 ELSE 1.0 END AS score FROM ent) SELECT id, round(score, 6) AS score FROM s WHERE score > 0 ORDER BY score DESC, id LIMIT 20""")
def _(spark, d):
    from chronoloom.operators.retrieval import keyword_search

    return keyword_search(V.entities(spark, d), "institute science", 20).select("id", F.round("score", 6).alias("score"))


@query("flatten_snippets", f"""WITH {ENT}, {REL} SELECT id, name, 'entity' AS channel, coalesce(nullif(trim(summary), ''), entity_type) AS snippet FROM ent WHERE group_id = 'grp-00003'
UNION ALL SELECT id, relationship_type, 'relationship', trim(fact) FROM rel WHERE relationship_type = 'FUNDED_BY' UNION ALL SELECT CAST(doc_id AS VARCHAR), source, 'episode', lang FROM documents WHERE source = 'manual'""")
def _(spark, d):
    e = V.entities(spark, d).where("group_id = 'grp-00003'").select("id", "name", F.lit("entity").alias("channel"), F.coalesce(F.nullif(F.trim("summary"), F.lit("")), "entity_type").alias("snippet"))
    r = V.relationships(spark, d).where("relationship_type = 'FUNDED_BY'").select("id", F.col("relationship_type").alias("name"), F.lit("relationship").alias("channel"), F.trim("fact").alias("snippet"))
    p = load(spark, d, "documents").where("source = 'manual'").select(F.col("doc_id").cast("string").alias("id"), F.col("source").alias("name"), F.lit("episode").alias("channel"), F.col("lang").alias("snippet"))
    return e.unionByName(r).unionByName(p)


@query("reasoning_path", f"""WITH {ENT}, {REL}, a AS (SELECT name, row_number() OVER (ORDER BY id) AS i FROM ent WHERE group_id = 'grp-00002'), b AS (SELECT relationship_type, row_number() OVER (ORDER BY id) AS i FROM rel WHERE relationship_type IN ('USES','MANAGES'))
SELECT a.i, name, relationship_type FROM a LEFT JOIN b USING (i) WHERE a.i <= 30""")
def _(spark, d):
    w = Window.orderBy("id")  # over the few rows of one answer
    a = S.scan(V.entities(spark, d), "grp-00002", 30).select("name", F.row_number().over(w).cast("bigint").alias("i"))
    b = V.relationships(spark, d).where("relationship_type IN ('USES', 'MANAGES')").orderBy("id").limit(30).select("relationship_type", F.row_number().over(w).cast("bigint").alias("i"))
    return a.join(b, "i", "left")


# --- joins


@query("hydrate_edges", f"WITH {REL}, {ENT} SELECT r.id, s.name AS source, r.relationship_type, t.name AS target FROM rel r JOIN ent s ON s.id = r.source_id JOIN ent t ON t.id = r.target_id")
def _(spark, d):
    e = V.entities(spark, d).select("id", "name")
    r = V.relationships(spark, d)
    return r.join(e.select(F.col("id").alias("source_id"), F.col("name").alias("source")), "source_id").join(e.select(F.col("id").alias("target_id"), F.col("name").alias("target")), "target_id").select("id", "source", "relationship_type", "target")


@query("facts_of_hits", f"WITH {REL}, {ENT}, h AS (SELECT id FROM ent WHERE contains(lower(name), 'foundation')) SELECT DISTINCT rel.id, trim(fact) AS fact FROM rel JOIN h ON h.id = source_id OR h.id = target_id")
def _(spark, d):
    h = V.entities(spark, d).where(F.lower("name").contains("foundation")).select("id")
    r = V.relationships(spark, d).select("id", F.trim("fact").alias("fact"), F.explode(F.array("source_id", "target_id")).alias("end"))
    return r.join(h.withColumnRenamed("id", "end"), "end", "left_semi").select("id", "fact").distinct()


@query("internal_facts", f"WITH {REL}, {ENT}, m AS (SELECT id FROM ent WHERE group_id = 'grp-00000') SELECT DISTINCT trim(fact) AS fact FROM rel WHERE source_id IN (SELECT id FROM m) AND target_id IN (SELECT id FROM m) AND expired_at IS NULL AND valid_until IS NULL")
def _(spark, d):
    m = V.entities(spark, d).where("group_id = 'grp-00000'").select("id")
    return G.subgraph(V.relationships(spark, d).where(D.valid_now()), m).select(F.trim("fact").alias("fact")).distinct()


@query("community_membership", f"WITH {ENT}, {REL} SELECT e.group_id AS community, count(DISTINCT r.id) AS edges FROM ent e JOIN rel r ON r.source_id = e.id GROUP BY 1")
def _(spark, d):
    e = V.entities(spark, d).groupBy("group_id").agg(F.collect_list("id").alias("members"))  # communities as stored: lists of members
    m = e.select(F.col("group_id").alias("community"), F.explode("members").alias("source_id"))
    return m.join(V.relationships(spark, d), "source_id").groupBy("community").agg(F.count_distinct("id").alias("edges"))


@query("unassigned_entities", f"WITH {REL}, {ENT} SELECT id FROM ent WHERE id NOT IN (SELECT source_id FROM rel) AND id NOT IN (SELECT target_id FROM rel)")
def _(spark, d):
    r = V.relationships(spark, d)
    ends = r.select(F.col("source_id").alias("id")).union(r.select("target_id"))
    return V.entities(spark, d).join(ends, "id", "left_anti").select("id")


@query("similarity_neighbours", """WITH q AS (SELECT vec_id AS query, embedding AS a FROM embeddings WHERE vec_id % 100 = 0), s AS (SELECT query, vec_id AS other, list_cosine_similarity(a::DOUBLE[], embedding::DOUBLE[]) AS score FROM q JOIN embeddings ON vec_id <> query),
r AS (SELECT *, row_number() OVER (PARTITION BY query ORDER BY round(score, 9) DESC, other) AS rn FROM s WHERE score >= 0.2) SELECT query, other, round(score, 6) AS score FROM r WHERE rn <= 5""")
def _(spark, d):
    from chronoloom.operators.retrieval import neighbours_of

    e = load(spark, d, "embeddings")
    return neighbours_of(e, e.where("vec_id % 100 = 0"), "vec_id", "embedding", 0.2, 5).select("query", "other", F.round("score", 6).alias("score"))


@query("similarity_edges", """WITH q AS (SELECT vec_id AS query, embedding AS a FROM embeddings WHERE vec_id % 100 = 0), s AS (SELECT query, vec_id AS other, round(list_cosine_similarity(a::DOUBLE[], embedding::DOUBLE[]), 9) AS score FROM q JOIN embeddings ON vec_id <> query),
r AS (SELECT *, row_number() OVER (PARTITION BY query ORDER BY score DESC, other) AS rn FROM s WHERE score >= 0.25) SELECT least(query, other) AS a, greatest(query, other) AS b, round(max(score), 4) AS weight FROM r WHERE rn <= 20 GROUP BY 1, 2""")
def _(spark, d):
    from chronoloom.operators.retrieval import neighbours_of

    e = load(spark, d, "embeddings")
    n = neighbours_of(e, e.where("vec_id % 100 = 0"), "vec_id", "embedding", 0.25, 20)
    return n.groupBy(F.least("query", "other").alias("a"), F.greatest("query", "other").alias("b")).agg(F.round(F.max("score"), 4).alias("weight"))


@query(
    "interval_neighbours",
    f"""WITH {MEM}, i AS (SELECT id, epoch(valid_from)::BIGINT AS s, coalesce(epoch(valid_until)::BIGINT, epoch(valid_from)::BIGINT + 30 * 86400) AS e, row_number() OVER (ORDER BY created_at NULLS FIRST, id) AS q FROM mem WHERE valid_from IS NOT NULL)
SELECT a.id AS a, b.id AS b, round(1.0 / (1.0 + floor(abs(b.s - a.s) / 3600) / 24.0), 6) AS weight FROM i a JOIN i b ON b.q < a.q AND b.s BETWEEN a.s - 30 * 86400 AND a.e""",
)
def _(spark, d):
    i = V.memory(spark, d).select("id", F.col("valid_from").alias("at"), F.col("valid_until").alias("until"), F.struct("created_at", "id").alias("seq"))
    return D.temporal_edges(i, 30).select("a", "b", F.round("weight", 6).alias("weight"))


@query("asof_fact", f"""WITH {VER}, p AS (SELECT DISTINCT relationship_id, t.probe FROM fact_versions, (VALUES (TIMESTAMP '2018-06-01'), (TIMESTAMP '2020-06-01'), (TIMESTAMP '2022-06-01')) t(probe)),
j AS (SELECT p.relationship_id, p.probe, arg_max(v.version, (v.created_at, v.version)) AS version FROM p JOIN ver v ON v.relationship_id = p.relationship_id AND v.valid_from <= p.probe AND p.probe < coalesce(v.valid_until, TIMESTAMP '2100-01-01') AND coalesce(v.valid_until, TIMESTAMP '2100-01-01') > v.valid_from GROUP BY ALL)
SELECT relationship_id, epoch(probe)::BIGINT AS at_s, version FROM j""")
def _(spark, d):
    v = V.versions(spark, d)
    times = F.array(*[D.ts(x) for x in ("2018-06-01", "2020-06-01", "2022-06-01")])
    probes = v.select("relationship_id").distinct().withColumn("at", F.explode(times))
    return D.as_of_join(probes, v, "relationship_id", "at").select("relationship_id", F.unix_seconds("at").alias("at_s"), "version")


@query("conflict_scan", f"""WITH {REL}, n AS (SELECT * FROM rel WHERE created_at >= TIMESTAMP '2020-01-01'), o AS (SELECT * FROM rel WHERE created_at < TIMESTAMP '2020-01-01' AND expired_at IS NULL AND valid_until IS NULL)
SELECT n.id AS new_id, o.id AS old_id, CASE WHEN n.target_id = o.target_id THEN 'redundant' ELSE 'contradiction' END AS conflict FROM n JOIN o ON n.source_id = o.source_id AND n.relationship_type = o.relationship_type""")
def _(spark, d):
    from chronoloom.operators.ingest import detect_conflicts

    r = V.relationships(spark, d)
    return detect_conflicts(r.where(F.col("created_at") >= D.ts("2020-01-01")), r.where((F.col("created_at") < D.ts("2020-01-01")) & D.valid_now())).select("new_id", "old_id", "conflict")


@query("conflict_cardinality", f"""WITH {REL}, n AS (SELECT * FROM rel WHERE created_at >= TIMESTAMP '2020-01-01'), o AS (SELECT * FROM rel WHERE created_at < TIMESTAMP '2020-01-01' AND expired_at IS NULL AND valid_until IS NULL)
SELECT n.id AS new_id, o.id AS old_id, CASE WHEN n.target_id = o.target_id THEN 'redundant' WHEN upper(n.relationship_type) IN ('WORKS_AT','LIVES_IN','LOCATED_IN','MANAGES') THEN 'contradiction' ELSE 'none' END AS conflict FROM n JOIN o ON n.source_id = o.source_id AND n.relationship_type = o.relationship_type""")
def _(spark, d):
    from chronoloom.operators.ingest import detect_conflicts

    r = V.relationships(spark, d)
    return detect_conflicts(r.where(F.col("created_at") >= D.ts("2020-01-01")), r.where((F.col("created_at") < D.ts("2020-01-01")) & D.valid_now()), mode="enhanced").select("new_id", "old_id", "conflict")


@query("jaccard_titles", """WITH q AS (SELECT p_partkey AS a, list_distinct(string_split(lower(p_name), ' ')) AS x FROM part WHERE p_partkey % 100 = 0), o AS (SELECT p_partkey AS b, list_distinct(string_split(lower(p_name), ' ')) AS y FROM part),
t AS (SELECT DISTINCT a, b FROM (SELECT a, unnest(x) AS w FROM q) JOIN (SELECT b, unnest(y) AS w FROM o) USING (w) WHERE a <> b)
SELECT t.a, t.b, round(len(list_intersect(x, y)) / len(list_distinct(list_concat(x, y)))::DOUBLE, 6) AS score FROM t JOIN q USING (a) JOIN o USING (b) WHERE len(list_intersect(x, y)) / len(list_distinct(list_concat(x, y)))::DOUBLE >= 0.4""")
def _(spark, d):
    w = lambda k: load(spark, d, "part").select(F.col("p_partkey").alias(k), F.array_distinct(F.split(F.lower("p_name"), " ")).alias(f"w{k}"))
    q, o = w("a").where("a % 100 = 0"), w("b")
    near = q.select("a", F.explode("wa").alias("w")).join(o.select("b", F.explode("wb").alias("w")), "w").where("a != b").select("a", "b").distinct()
    return near.join(q, "a").join(o, "b").select("a", "b", F.round(T.jaccard(F.col("wa"), F.col("wb")), 6).alias("score")).where("score >= 0.4")


@query("outer_join_counts", "SELECT c_mktsegment, count(o_orderkey) AS orders, count(DISTINCT c_custkey) AS customers FROM customer LEFT JOIN orders ON o_custkey = c_custkey GROUP BY 1")
def _(spark, d):
    o = load(spark, d, "orders").groupBy(F.col("o_custkey").alias("c_custkey")).agg(F.count(F.lit(1)).alias("n"))  # aggregated before the join
    return load(spark, d, "customer").join(o, "c_custkey", "left").groupBy("c_mktsegment").agg(F.coalesce(F.sum("n"), F.lit(0)).alias("orders"), F.count_distinct("c_custkey").alias("customers"))


# --- aggregates


@query("type_counts", f"WITH {ENT}, {REL} SELECT 'entity' AS kind, lower(entity_type) AS type, count(*) AS n FROM ent GROUP BY 2 UNION ALL SELECT 'relationship', relationship_type, count(*) FROM rel GROUP BY 2")
def _(spark, d):
    e = V.entities(spark, d).groupBy(F.lower("entity_type").alias("type")).agg(F.count(F.lit(1)).alias("n")).select(F.lit("entity").alias("kind"), "type", "n")
    return e.unionByName(V.relationships(spark, d).groupBy(F.col("relationship_type").alias("type")).agg(F.count(F.lit(1)).alias("n")).select(F.lit("relationship").alias("kind"), "type", "n"))


@query("schema_summary", f"WITH {ENT} SELECT count(*) || ' entities of ' || count(DISTINCT lower(entity_type)) || ' types in ' || count(DISTINCT group_id) || ' groups' AS summary FROM ent")
def _(spark, d):
    return V.entities(spark, d).agg(F.count(F.lit(1)).alias("n"), F.count_distinct(F.lower("entity_type")).alias("t"), F.count_distinct("group_id").alias("g")).select(F.format_string("%d entities of %d types in %d groups", "n", "t", "g").alias("summary"))


@query("timeline_by_day", f"""WITH {ENT}, r AS (SELECT strftime(created_at, '%Y-%m-%d') AS day, name, row_number() OVER (PARTITION BY strftime(created_at, '%Y-%m-%d') ORDER BY id) AS rn FROM ent)
SELECT day, count(*) AS n, string_agg(name, ', ' ORDER BY rn) FILTER (rn <= 3) AS names FROM r GROUP BY day""")
def _(spark, d):
    return D.timeline(V.entities(spark, d))


@query("degree_strength", f"WITH {SMALL}, e AS (SELECT source_id AS id, weight FROM small UNION ALL SELECT target_id, weight FROM small) SELECT id, count(*) AS degree, sum(weight) AS strength FROM e GROUP BY id")
def _(spark, d):
    return G.strength(V.small_graph(spark, d))


@query("modularity_by_nation", f"""WITH {SMALL}, m AS (SELECT DISTINCT id, CASE WHEN id LIKE 'region:%' THEN id WHEN id LIKE 'nation:%' THEN id ELSE c END AS community FROM (SELECT source_id AS id, target_id AS c FROM small UNION SELECT target_id, target_id FROM small WHERE target_id LIKE 'region:%')),
e AS (SELECT s.weight, a.community AS cs, b.community AS ct FROM small s JOIN m a ON a.id = s.source_id JOIN m b ON b.id = s.target_id), k AS (SELECT c, sum(weight) AS k FROM (SELECT cs AS c, weight FROM e UNION ALL SELECT ct, weight FROM e) GROUP BY c),
i AS (SELECT cs AS c, sum(weight) AS i FROM e WHERE cs = ct GROUP BY cs), t AS (SELECT sum(weight) AS w FROM e) SELECT round(sum(coalesce(i.i, 0) / t.w - power(k.k / (2 * t.w), 2)), 6) AS q FROM k LEFT JOIN i USING (c), t""")
def _(spark, d):
    g = V.small_graph(spark, d)
    m = g.select(F.col("source_id").alias("id"), F.when(F.col("source_id").like("nation:%"), F.col("source_id")).otherwise(F.col("target_id")).alias("community")).union(g.where("target_id LIKE 'region:%'").select("target_id", "target_id")).distinct()
    return G.modularity(g, m).select(F.round("q", 6).alias("q"))


@query("community_votes", f"""WITH {ENT}, {REL}, u AS (SELECT source_id AS a, target_id AS b FROM rel WHERE source_id <> target_id UNION SELECT target_id, source_id FROM rel WHERE source_id <> target_id), n AS (SELECT id FROM ent WHERE group_id = 'default'), m AS (SELECT id, group_id AS community FROM ent WHERE group_id <> 'default'),
v AS (SELECT n.id, m.community, count(*) AS c FROM n JOIN u ON u.a = n.id JOIN m ON m.id = u.b GROUP BY ALL), r AS (SELECT *, row_number() OVER (PARTITION BY id ORDER BY c DESC, community) AS rn FROM v)
SELECT n.id, coalesce(r.community, n.id) AS community FROM n LEFT JOIN r ON r.id = n.id AND rn = 1""")
def _(spark, d):
    e = V.entities(spark, d)
    return G.neighbour_votes(e.where("group_id = 'default'").select("id"), V.both_ways(V.relationships(spark, d)), e.where("group_id != 'default'").select("id", F.col("group_id").alias("community")))


@query("dirty_communities", f"WITH {ENT} SELECT DISTINCT group_id AS community FROM ent WHERE updated_at >= TIMESTAMP '2023-01-01'")
def _(spark, d):
    e = V.entities(spark, d)
    return G.dirty_communities(e.where(F.col("updated_at") >= D.ts("2023-01-01")).select("id"), e.select("id", F.col("group_id").alias("community")))


@query("community_rule_summary", f"""WITH {ENT}, r AS (SELECT group_id AS community, lower(entity_type) AS t, name, row_number() OVER (PARTITION BY group_id, lower(entity_type) ORDER BY name, id) AS rn FROM ent),
p AS (SELECT community, t, count(*) AS n, t || ': ' || string_agg(name, ', ' ORDER BY rn) FILTER (rn <= 3) || CASE WHEN count(*) > 3 THEN ' and ' || (count(*) - 3) || ' more' ELSE '' END AS line FROM r GROUP BY community, t)
SELECT community, sum(n)::BIGINT AS n, 'A community of ' || sum(n)::BIGINT || ' entities: ' || string_agg(line, '; ' ORDER BY line) || '.' AS summary FROM p GROUP BY community""")
def _(spark, d):
    e = V.entities(spark, d)
    return G.summaries(e.select("id", F.col("group_id").alias("community")), e)


@query("mention_scores", "WITH c AS (SELECT l_partkey, count(DISTINCT l_orderkey) AS n FROM lineitem GROUP BY 1) SELECT l_partkey, round(n / (SELECT max(n) FROM c)::DOUBLE, 6) AS score FROM c")
def _(spark, d):
    from chronoloom.operators.retrieval import mention_scores

    return mention_scores(load(spark, d, "lineitem").select("l_partkey", "l_orderkey").distinct(), "l_partkey").select("l_partkey", F.round("score", 6).alias("score"))


@query("usage_rollup", "SELECT event_type, strftime(ts, '%Y-%m-%d') AS day, count(*) AS calls, round(sum(value), 4) AS cost FROM events GROUP BY ROLLUP (event_type, strftime(ts, '%Y-%m-%d'))")
def _(spark, d):
    return load(spark, d, "events").withColumn("day", F.date_format("ts", "yyyy-MM-dd")).rollup("event_type", "day").agg(F.count(F.lit(1)).alias("calls"), F.round(F.sum("value"), 4).alias("cost"))


@query("usage_cube", "SELECT event_type, user_id % 10 AS shard, count(*) AS n, approx_count_distinct(user_id) > 0 AS seen FROM events GROUP BY CUBE (event_type, user_id % 10)")
def _(spark, d):
    return load(spark, d, "events").withColumn("shard", F.col("user_id") % 10).cube("event_type", "shard").agg(F.count(F.lit(1)).alias("n"), (F.approx_count_distinct("user_id") > 0).alias("seen"))


@query("running_budget", "WITH r AS (SELECT user_id, event_id, sum(floor(value * 1e6)::BIGINT) OVER (PARTITION BY user_id ORDER BY ts, event_id ROWS UNBOUNDED PRECEDING)::BIGINT AS spent FROM events) SELECT user_id, event_id, spent, spent > 300000000 AS over_budget FROM r")
def _(spark, d):
    from chronoloom.operators.routing import running_cost

    e = load(spark, d, "events").select("user_id", "event_id", "ts", F.col("value").alias("cost"))
    return running_cost(e, "user_id", ["ts", "event_id"], "cost", 300.0).select("user_id", "event_id", "spent", "over_budget")


@query("cache_hit_rate", "SELECT event_type, round(count(*) FILTER (value > 5) / count(*)::DOUBLE, 6) AS hit_rate FROM events GROUP BY 1")
def _(spark, d):
    return load(spark, d, "events").groupBy("event_type").agg(F.round(F.count_if(F.col("value") > 5) / F.count(F.lit(1)), 6).alias("hit_rate"))


@query("eval_report", """WITH j AS (SELECT DISTINCT l.doc_id, l.rater, d.source, l.grade FROM grade_labels l JOIN documents d USING (doc_id) WHERE l.grade IS NOT NULL AND d.source IS NOT NULL)
SELECT source AS question_type, count(*) AS n, round(avg(CASE WHEN grade >= 3 THEN 1.0 ELSE 0.0 END), 6) AS accuracy, round(avg(grade), 6) AS mean_latency FROM j GROUP BY ROLLUP (source)""")
def _(spark, d):
    from chronoloom.operators.routing import eval_report

    j = load(spark, d, "grade_labels").join(load(spark, d, "documents").select("doc_id", "source"), "doc_id").where("grade IS NOT NULL AND source IS NOT NULL").select("doc_id", "rater", "source", "grade").distinct()
    r = eval_report(j.select(F.col("source").alias("question_type"), (F.col("grade") >= 3).alias("correct"), F.col("grade").cast("double").alias("latency")))
    return r.select("question_type", "n", F.round("accuracy", 6).alias("accuracy"), F.round("mean_latency", 6).alias("mean_latency"))


@query("max_and_weighted_merge", """WITH s AS (SELECT o_custkey AS node, o_totalprice / 1e5 AS score, 0.4 AS w FROM orders WHERE o_orderstatus = 'F' UNION ALL SELECT o_custkey, o_totalprice / 1e5, 0.6 FROM orders WHERE o_orderstatus = 'O')
SELECT node, round(max(score), 8) AS best, round(sum(w * score), 4) AS fused, round(least(1.0, avg(score) * 0.5), 6) AS confidence FROM s GROUP BY node""")
def _(spark, d):
    o = load(spark, d, "orders").where("o_orderstatus IN ('F', 'O')").select(F.col("o_custkey").alias("node"), (F.col("o_totalprice") / 1e5).alias("score"), F.when(F.col("o_orderstatus") == "F", 0.4).otherwise(0.6).alias("w"))
    return o.groupBy("node").agg(F.round(F.max("score"), 8).alias("best"), F.round(F.sum(F.col("w") * F.col("score")), 4).alias("fused"), F.round(F.least(F.lit(1.0), F.avg("score") * 0.5), 6).alias("confidence"))


# --- windows


@query("next_episode_pairs", "SELECT group_id, doc_id, lead(doc_id) OVER (PARTITION BY group_id ORDER BY valid_at, doc_id) AS next_id, row_number() OVER (PARTITION BY group_id ORDER BY valid_at, doc_id) - 1 AS position FROM documents WHERE group_id IS NOT NULL AND valid_at IS NOT NULL")
def _(spark, d):
    from chronoloom.operators.memory import saga_steps

    return saga_steps(load(spark, d, "documents").where("group_id IS NOT NULL AND valid_at IS NOT NULL"), "group_id", "doc_id", "valid_at").select("group_id", "doc_id", "next_id", "position")


@query("saga_ends", "WITH r AS (SELECT group_id, doc_id, row_number() OVER (PARTITION BY group_id ORDER BY valid_at, doc_id) AS i, count(*) OVER (PARTITION BY group_id) AS n FROM documents WHERE group_id IS NOT NULL AND valid_at IS NOT NULL) SELECT group_id, max(n) AS episodes, max(CASE WHEN i = 1 THEN doc_id END) AS first_id, max(CASE WHEN i = n THEN doc_id END) AS last_id FROM r GROUP BY 1")
def _(spark, d):
    x = load(spark, d, "documents").where("group_id IS NOT NULL AND valid_at IS NOT NULL")
    o = F.struct("valid_at", "doc_id")
    return x.groupBy("group_id").agg(F.count(F.lit(1)).alias("episodes"), F.min_by("doc_id", o).alias("first_id"), F.max_by("doc_id", o).alias("last_id"))


@query("current_version", f"WITH {VER}, r AS (SELECT *, row_number() OVER (PARTITION BY relationship_id ORDER BY created_at DESC, version DESC) AS rn FROM ver WHERE superseded_at IS NULL) SELECT relationship_id, version, trim(fact) AS fact FROM r WHERE rn = 1")
def _(spark, d):
    v = V.versions(spark, d).where("superseded_at IS NULL")
    return V.latest(v, "relationship_id", "created_at", "version").select("relationship_id", "version", F.trim("fact").alias("fact"))


@query("version_numbers", f"WITH {VER} SELECT relationship_id, version, row_number() OVER (PARTITION BY relationship_id ORDER BY created_at, version) AS number FROM ver")
def _(spark, d):
    return V.versions(spark, d).select("relationship_id", "version", F.row_number().over(Window.partitionBy("relationship_id").orderBy("created_at", "version")).alias("number"))


@query("context_budget", "WITH r AS (SELECT group_id, doc_id, sum(ceil(n_chars / 4.0)) OVER (PARTITION BY group_id ORDER BY doc_id ROWS UNBOUNDED PRECEDING)::BIGINT AS used FROM documents WHERE n_chars IS NOT NULL AND group_id IS NOT NULL) SELECT group_id, doc_id, used FROM r WHERE used <= 4000")
def _(spark, d):
    from chronoloom.operators.routing import context_budget

    x = load(spark, d, "documents").where("n_chars IS NOT NULL AND group_id IS NOT NULL").select("group_id", "doc_id", F.ceil(F.col("n_chars") / 4.0).alias("tokens"))
    return context_budget(x, "group_id", ["doc_id"], "tokens", 4000).select("group_id", "doc_id", "used")


@query("last_n_turns", "WITH r AS (SELECT user_id, event_id, row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, event_id DESC) AS rn FROM events) SELECT user_id, event_id FROM r WHERE rn <= 5")
def _(spark, d):
    w = Window.partitionBy("user_id").orderBy(F.desc("ts"), F.desc("event_id"))
    return load(spark, d, "events").withColumn("rn", F.row_number().over(w)).where("rn <= 5").select("user_id", "event_id")


@query("event_gaps", "SELECT user_id, event_id, epoch(ts)::BIGINT - lag(epoch(ts)::BIGINT) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS gap_s, ntile(4) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS quarter FROM events")
def _(spark, d):
    w = Window.partitionBy("user_id").orderBy("ts", "event_id")
    e = load(spark, d, "events").withColumn("s", F.floor(F.unix_micros("ts") / 1_000_000))
    return e.select("user_id", "event_id", (F.col("s") - F.lag("s").over(w)).alias("gap_s"), F.ntile(4).over(w).cast("bigint").alias("quarter"))


ORACLE["event_gaps"] = ORACLE["event_gaps"].replace("epoch(ts)::BIGINT", "floor(epoch(ts))::BIGINT")


# --- order and limits, sets


@query("chronological_history", f"WITH {REL}, {ENT}, h AS (SELECT id FROM ent WHERE contains(lower(name), 'labs') ORDER BY id LIMIT 1) SELECT rel.id, relationship_type, row_number() OVER (ORDER BY valid_from NULLS FIRST, rel.id) AS step FROM rel, h WHERE source_id = h.id OR target_id = h.id")
def _(spark, d):
    hit = V.entities(spark, d).where(F.lower("name").contains("labs")).orderBy("id").limit(1).select(F.col("id").alias("end"))
    r = V.relationships(spark, d).withColumn("end", F.explode(F.array_distinct(F.array("source_id", "target_id")))).join(hit, "end", "left_semi")
    return r.select("id", "relationship_type", F.row_number().over(Window.orderBy(F.asc_nulls_first("valid_from"), "id")).alias("step"))  # the edges of one entity


@query("paper_order", "WITH p AS (SELECT id, max(citation_count) AS c, max(year) AS y FROM papers GROUP BY id) SELECT id, coalesce(c, 0) AS citations, coalesce(y, 0) AS year FROM p ORDER BY 2 DESC, 3 DESC, id LIMIT 30")
def _(spark, d):
    p = load(spark, d, "papers").groupBy("id").agg(F.max("citation_count").alias("c"), F.max("year").alias("y"))
    return p.select("id", F.coalesce("c", F.lit(0)).alias("citations"), F.coalesce(F.col("y").cast("int"), F.lit(0)).alias("year")).orderBy(F.desc("citations"), F.desc("year"), "id").limit(30)


@query("top_entities", f"WITH {ENT} SELECT id, round(coalesce(nullif(importance_score, 0), access_count / 100.0), 6) AS score FROM ent ORDER BY coalesce(nullif(importance_score, 0), access_count / 100.0) DESC, id LIMIT 15")
def _(spark, d):
    s = F.coalesce(F.nullif(F.col("importance_score"), F.lit(0.0)), F.col("access_count") / 100.0)
    return V.entities(spark, d).orderBy(F.desc(s), "id").limit(15).select("id", F.round(s, 6).alias("score"))


@query("overflow_eviction", f"WITH {MEM}, r AS (SELECT id, tier, row_number() OVER (PARTITION BY tier ORDER BY importance DESC, id) AS rn FROM mem) SELECT id, tier FROM r WHERE rn <= 20")
def _(spark, d):
    from chronoloom.operators.memory import keep_best

    return keep_best(V.memory(spark, d), "tier", "importance", 20).select("id", "tier")


@query("set_operations", """SELECT 'both' AS kind, c FROM (SELECT o_custkey AS c FROM orders WHERE o_orderstatus = 'F' INTERSECT SELECT o_custkey FROM orders WHERE o_orderstatus = 'P') UNION ALL SELECT 'only_f', c FROM (SELECT o_custkey AS c FROM orders WHERE o_orderstatus = 'F' EXCEPT SELECT o_custkey FROM orders WHERE o_orderstatus = 'P')
UNION ALL SELECT 'any', c FROM (SELECT o_custkey AS c FROM orders WHERE o_orderstatus = 'F' UNION SELECT o_custkey FROM orders WHERE o_orderstatus = 'P')""")
def _(spark, d):
    o = load(spark, d, "orders")
    f, p = (o.where(F.col("o_orderstatus") == x).select(F.col("o_custkey").alias("c")) for x in "FP")
    out = [("both", f.intersect(p)), ("only_f", f.subtract(p)), ("any", f.union(p).distinct())]
    return out[0][1].select(F.lit("both").alias("kind"), "c").unionByName(out[1][1].select(F.lit("only_f").alias("kind"), "c")).unionByName(out[2][1].select(F.lit("any").alias("kind"), "c"))


@query("novel_keywords", "WITH k AS (SELECT p_partkey, list_distinct(string_split(lower(p_name), ' ')) AS a, list_distinct(string_split(lower(p_type), ' ')) AS b FROM part), n AS (SELECT p_partkey, list_filter(b, lambda w: NOT list_contains(a, w))[1:3] AS x FROM k) SELECT p_partkey, array_to_string(x, ',') AS novel FROM n")
def _(spark, d):
    p = load(spark, d, "part").select("p_partkey", F.split(F.lower("p_name"), " ").alias("a"), F.array_distinct(F.split(F.lower("p_type"), " ")).alias("b"))
    return p.select("p_partkey", F.array_join(F.slice(F.filter("b", lambda w: ~F.array_contains(F.col("a"), w)), 1, 3), ",").alias("novel"))
