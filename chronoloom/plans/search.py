"""Queries: text and vector functions, retrieval, fusion, reranking, extraction."""

from __future__ import annotations

from pyspark.sql import functions as F

from chronoloom.functions import scores as C
from chronoloom.functions import text as T
from chronoloom.functions import vectors as Ve
from chronoloom.operators import extraction as X
from chronoloom.operators import memory as M
from chronoloom.operators import retrieval as R
from chronoloom.operators import routing as Q
from chronoloom.operators import views as V
from chronoloom.operators.views import ENT, MEM, REL
from chronoloom.tables import load

QUERIES: dict = {}
ORACLE: dict = {}
STOP = "[" + ", ".join(f"'{w}'" for w in T.STOP_WORDS) + "]"
NOTE_STOP = "[" + ", ".join(f"'{w}'" for w in T.NOTE_STOP_WORDS) + "]"
TOKENS = f"list_filter(string_split_regex(lower(text), '[^\\p{{L}}\\p{{N}}'']+'), lambda w: strlen(w) > 1 AND NOT list_contains({STOP}, w))"


def query(name: str, sql: str | None = None):
    def keep(f):
        QUERIES[name] = f
        if sql:
            ORACLE[name] = sql
        return f

    return keep


def docs(spark, d):
    return load(spark, d, "documents")


# --- text and hash functions


@query("normalized_names", f"WITH {ENT} SELECT id, trim(regexp_replace(translate(lower(name), '_-', '  '), '\\s+', ' ', 'g')) AS normal FROM ent")
def _(spark, d):
    return V.entities(spark, d).select("id", T.normalize_name(F.col("name")).alias("normal"))


@query("query_terms", f"WITH {MEM} SELECT id, array_to_string(list_filter(list_transform(list_filter(string_split_regex(lower(content), '\\s+'), lambda w: strlen(w) > 2), lambda w: regexp_replace(w, '^[^\\p{{L}}\\p{{N}}]+|[^\\p{{L}}\\p{{N}}]+$', '', 'g')), lambda w: w <> ''), ' ') AS terms FROM mem WHERE content IS NOT NULL")
def _(spark, d):
    return V.memory(spark, d).where("content IS NOT NULL").select("id", F.array_join(T.extract_terms(F.col("content")), " ").alias("terms"))


@query("token_estimates", "SELECT doc_id, ceil(strlen(text) / 4.0)::BIGINT AS tokens, len(list_filter(string_split_regex(text, '\\s+'), lambda w: w <> '')) AS words FROM documents WHERE text IS NOT NULL")
def _(spark, d):
    x = docs(spark, d).where("text IS NOT NULL")
    return x.select("doc_id", T.estimate_tokens(F.col("text")).alias("tokens"), F.size(T.words_of(F.col("text"))).alias("words"))


@query(
    "truncated_texts",
    """WITH h AS (SELECT doc_id, text, text[1:list_max(list_filter(range(20, 81), lambda n: strlen(text[1:n]) <= 80))] AS h FROM documents WHERE text IS NOT NULL)
SELECT doc_id, CASE WHEN strlen(text) <= 80 THEN text ELSE CASE WHEN contains(h, ' ') THEN regexp_extract(h, '(?s)^(.*) ', 1) ELSE h END || '...' END AS head FROM h""",
)
def _(spark, d):
    return docs(spark, d).where("text IS NOT NULL").select("doc_id", T.truncate_to_tokens(F.col("text"), 20).alias("head"))


@query("content_hash_dups", "WITH h AS (SELECT doc_id, sha256(array_to_string(list_filter(string_split_regex(lower(text), '\\s+'), lambda w: w <> ''), ' ')) AS h FROM documents WHERE text IS NOT NULL) SELECT h AS hash, count(*) AS n, min(doc_id) AS first_id FROM h GROUP BY h HAVING count(*) > 1")
def _(spark, d):
    h = docs(spark, d).where("text IS NOT NULL").select("doc_id", T.content_hash(F.col("text")).alias("hash"))
    return h.groupBy("hash").agg(F.count(F.lit(1)).alias("n"), F.min("doc_id").alias("first_id")).where("n > 1")


@query("dedup_keys", f"WITH {ENT} SELECT id, sha256(array_to_string(list_filter(string_split_regex(lower(lower(trim(name)) || '::' || lower(trim(entity_type))), '\\s+'), lambda w: w <> ''), ' ')) AS key, sha256(name || '|' || 'model') AS cache FROM ent WHERE name IS NOT NULL AND entity_type IS NOT NULL")
def _(spark, d):
    return V.entities(spark, d).where("name IS NOT NULL AND entity_type IS NOT NULL").select("id", T.entity_key(F.col("name"), F.col("entity_type")).alias("key"), T.cache_key(F.col("name"), F.lit("model")).alias("cache"))


@query("note_keywords", f"WITH {MEM}, k AS (SELECT id, list_filter(string_split_regex(lower(content), '[^\\p{{L}}\\p{{N}}]+'), lambda w: strlen(w) > 3 AND NOT list_contains({NOTE_STOP}, w)) AS ws FROM mem WHERE content IS NOT NULL), u AS (SELECT id, unnest(ws) AS w, generate_subscripts(ws, 1) AS i FROM k), f AS (SELECT id, w, min(i) AS i FROM u GROUP BY ALL), r AS (SELECT *, row_number() OVER (PARTITION BY id ORDER BY i) AS rn FROM f) SELECT id, string_agg(w, ',' ORDER BY rn) AS keywords FROM r WHERE rn <= 20 GROUP BY id")
def _(spark, d):
    return V.memory(spark, d).where("content IS NOT NULL").select("id", F.array_join(T.note_keywords(F.col("content")), ",").alias("keywords")).where("keywords != ''")


@query("paper_titles", "SELECT DISTINCT id, trim(regexp_replace(regexp_replace(lower(title), '[^\\p{L}\\p{N}\\s]', '', 'g'), '\\s+', ' ', 'g')) AS normal FROM papers WHERE title IS NOT NULL")
def _(spark, d):
    return load(spark, d, "papers").where("title IS NOT NULL").select("id", T.normalize_title(F.col("title")).alias("normal")).distinct()


@query("paragraph_counts", "SELECT DISTINCT id, len(list_filter(list_transform(string_split(text, chr(10) || chr(10)), lambda p: regexp_replace(p, '^\\s+|\\s+$', '', 'g')), lambda p: p <> '')) AS n FROM chunks WHERE text IS NOT NULL")
def _(spark, d):
    return load(spark, d, "chunks").where("text IS NOT NULL").select("id", F.size(T.paragraphs(F.col("text"))).alias("n")).distinct()


@query("date_parse", "SELECT * FROM (VALUES ('2024-03-05', '2024-03-05'), ('2021', '2021-01-01'), ('March 5, 2024', '2024-03-05'), ('Mar 5, 2024', '2024-03-05'), ('5 March 2024', '2024-03-05'), ('2024/03/05', '2024-03-05'), ('03/05/2024', '2024-03-05'), ('March 2024', '2024-03-01'), ('Mar 2024', '2024-03-01'), ('soon', NULL)) t(text, day)")
def _(spark, d):
    texts = ["2024-03-05", "2021", "March 5, 2024", "Mar 5, 2024", "5 March 2024", "2024/03/05", "03/05/2024", "March 2024", "Mar 2024", "soon"]
    return spark.createDataFrame([(t,) for t in texts], "text string").select("text", F.date_format(T.parse_date(F.col("text")), "yyyy-MM-dd").alias("day"))


REFS = [
    'A. Smith, B. Jones (2019). "Graphs that remember things". Venue. doi 10.1000/xyz.123.', "C. Doe, 2021, arXiv:2101.00001, no title", 'Only "short" text 1850 then 1999', "E. Nobody; F. Else 10.55/a,b year 2031 2024",
]
_REFS = ", ".join("('" + r.replace("'", "''") + "')" for r in REFS)


@query("ref_fields", f"""WITH r(raw) AS (VALUES {_REFS}) SELECT raw, list_filter(list_transform(regexp_extract_all(raw, '(\\d{{4}})', 1), lambda y: y::INT), lambda y: y BETWEEN 1900 AND 2030)[1] AS year,
CASE WHEN contains(regexp_replace(regexp_extract(raw, '(10\\.[^\\s,;)]*)', 1), '\\.+$', ''), '/') THEN regexp_replace(regexp_extract(raw, '(10\\.[^\\s,;)]*)', 1), '\\.+$', '') END AS doi, nullif(regexp_extract(raw, 'arXiv:\\s*([^\\s,;\\]]+)', 1), '') AS arxiv, nullif(regexp_extract(raw, '"([^"]{{6,}})"', 1), '') AS title FROM r""")
def _(spark, d):
    r = F.col("raw")
    return spark.createDataFrame([(x,) for x in REFS], "raw string").select("raw", T.extract_year(r).alias("year"), T.extract_doi(r).alias("doi"), T.extract_arxiv(r).alias("arxiv"), T.reference_title(r).alias("title"))


@query("name_shapes", f"WITH {ENT} SELECT id, name <> '' AND strlen(name) < 100 AND NOT contains(name, chr(10)) AND regexp_matches(name, '^\\p{{Lu}}') AS looks FROM ent")
def _(spark, d):
    return V.entities(spark, d).select("id", T.looks_like_name(F.col("name")).alias("looks"))


@query("key_types", "SELECT * FROM (VALUES ('employer', 'Organization'), ('home_city', 'Location'), ('author', 'Person'), ('size', 'Entity')) t(key, type)")
def _(spark, d):
    return spark.createDataFrame([("employer",), ("home_city",), ("author",), ("size",)], "key string").select("key", T.type_from_key(F.col("key")).alias("type"))


@query("json_fields", "SELECT event_id, json_extract(props, '$.k')::INT AS k, coalesce(json_extract_string(props, '$.name'), json_extract_string(props, '$.k')) AS label FROM events")
def _(spark, d):
    return load(spark, d, "events").select("event_id", F.get_json_object("props", "$.k").cast("int").alias("k"), F.coalesce(F.get_json_object("props", "$.name"), F.get_json_object("props", "$.k")).alias("label"))


@query("attribute_lookup", f"WITH {ENT} SELECT id, attributes['origin'] AS origin, cardinality(attributes) AS n FROM ent")
def _(spark, d):
    return V.entities(spark, d).select("id", F.try_element_at("attributes", F.lit("origin")).alias("origin"), F.size("attributes").alias("n"))


# --- vectors and scores


@query("topk_vectors", "WITH q AS (SELECT embedding AS a FROM embeddings WHERE vec_id = 0) SELECT vec_id, round(list_cosine_similarity(embedding::DOUBLE[], a::DOUBLE[]), 6) AS score FROM embeddings, q ORDER BY list_cosine_similarity(embedding::DOUBLE[], a::DOUBLE[]) DESC, vec_id LIMIT 10")
def _(spark, d):
    e = load(spark, d, "embeddings")
    return R.nearest_to(e, "vec_id", "embedding", e.where("vec_id = 0").first()["embedding"], 10).select("vec_id", F.round("score", 6).alias("score"))


@query("vector_align_norm", "WITH a AS (SELECT vec_id, list_resize(embedding::DOUBLE[], 32, 0.0) AS v FROM embeddings) SELECT vec_id, round(list_sum(list_transform(v, lambda x: x * x)), 6) AS square, round(v[1] / sqrt(list_sum(list_transform(v, lambda x: x * x))), 6) AS first FROM a")
def _(spark, d):
    a = load(spark, d, "embeddings").select("vec_id", Ve.align(F.col("embedding"), 32).alias("v"))
    return a.select("vec_id", F.round(Ve.dot(F.col("v"), F.col("v")), 6).alias("square"), F.round(F.element_at(Ve.normalize(F.col("v")), 1), 6).alias("first"))


@query("hash_embeddings", f"WITH {ENT} SELECT id, round(('0x' || sha256(name)[1:2])::INT / 255.0::DOUBLE, 6) AS first, round(('0x' || sha256(name)[63:64])::INT / 255.0::DOUBLE, 6) AS last FROM ent")
def _(spark, d):
    v = Ve.hash_embedding(F.col("name"))
    return V.entities(spark, d).select("id", F.round(F.element_at(v, 1), 6).alias("first"), F.round(F.element_at(v, 32), 6).alias("last"))


@query("label_similarity", "WITH p AS (SELECT vec_id AS q, embedding AS a, label FROM embeddings WHERE vec_id % 100 = 0) SELECT p.label, round(avg(list_cosine_similarity(a::DOUBLE[], embedding::DOUBLE[])), 6) AS mean FROM p JOIN embeddings e ON e.label = p.label AND e.vec_id <> q GROUP BY 1")
def _(spark, d):
    e = load(spark, d, "embeddings")
    p = e.where("vec_id % 100 = 0").select(F.col("vec_id").alias("q"), F.col("embedding").alias("a"), "label")
    return p.join(e, "label").where("vec_id != q").groupBy("label").agg(F.round(F.avg(Ve.cosine(F.col("a"), F.col("embedding"))), 6).alias("mean"))


@query("ebbinghaus", f"WITH {MEM} SELECT id, round(exp(-floor((epoch(TIMESTAMP '2024-02-01')::BIGINT - epoch(last_accessed)::BIGINT) / 3600.0) / ((1 + access_count) * 24.0 * 365)), 6) AS retention FROM mem")
def _(spark, d):
    hours = (F.unix_seconds(F.lit("2024-02-01").cast("timestamp")) - F.unix_seconds("last_accessed")) / 3600.0
    return V.memory(spark, d).select("id", F.round(C.retention(hours, (F.col("access_count") + 1) * 365), 6).alias("retention"))


@query("composite_score", f"""WITH {MEM}, h AS (SELECT *, floor((epoch(TIMESTAMP '2024-02-01')::BIGINT - epoch(last_accessed)::BIGINT) / 3600) AS hours FROM mem WHERE content IS NOT NULL)
SELECT id, round(0.3::DOUBLE * ln(access_count + 1) / 10 + 0.3::DOUBLE / (1 + hours / 168.0::DOUBLE) + 0.25::DOUBLE * least(coalesce(len(entity_ids), 0), 20) / 20.0::DOUBLE + 0.15::DOUBLE * least(len(list_filter(string_split_regex(content, '\\s+'), lambda w: w <> '')) / 50.0::DOUBLE, 1.0), 6) AS score FROM h""")
def _(spark, d):
    m = V.memory(spark, d).where("content IS NOT NULL")
    hours = F.floor((F.unix_seconds(F.lit("2024-02-01").cast("timestamp")) - F.unix_seconds("last_accessed")) / 3600)
    return m.select("id", F.round(C.composite(F.col("access_count"), hours, F.greatest(F.coalesce(F.size("entity_ids"), F.lit(0)), F.lit(0)), F.size(T.words_of(F.col("content")))), 6).alias("score"))


@query("state_keys", f"WITH {MEM} SELECT id, round(coalesce(importance, 0) * 10)::INT || ':' || round(least(coalesce(access_count, 0) / 20.0::DOUBLE, 1) * 10)::INT AS state FROM mem")
def _(spark, d):
    return V.memory(spark, d).select("id", C.state_key(F.coalesce("importance", F.lit(0.0)), F.least(F.coalesce("access_count", F.lit(0)) / 20.0, F.lit(1))).alias("state"))


@query("usage_cost", "SELECT event_type, round(sum(user_id * 3.0 / 1e6 + event_id * 15.0 / 1e6), 4) AS usd FROM events GROUP BY 1")
def _(spark, d):
    return load(spark, d, "events").groupBy("event_type").agg(F.round(F.sum(C.llm_cost(F.col("user_id"), F.col("event_id"), 3.0, 15.0)), 4).alias("usd"))


@query("circle_layout", "SELECT n_nationkey, round(cos(2 * 3.141592653589793 * n_nationkey / 25), 6) + 0 AS x, round(sin(2 * 3.141592653589793 * n_nationkey / 25), 6) + 0 AS y FROM nation")
def _(spark, d):
    p = C.circle(F.col("n_nationkey"), F.lit(25))
    return load(spark, d, "nation").select("n_nationkey", (F.round(p["x"], 6) + 0).alias("x"), (F.round(p["y"], 6) + 0).alias("y"))


# --- ranked retrieval

_BM25 = f"""t AS (SELECT doc_id, {TOKENS} AS ws FROM documents WHERE text IS NOT NULL), s AS (SELECT count(*) AS n, avg(len(ws)) AS avgdl FROM t),
q AS (SELECT unnest(['memory', 'graph', 'evidence']) AS term), df AS (SELECT term, count(*) AS df FROM q JOIN t ON list_contains(ws, term) GROUP BY term),
m AS (SELECT doc_id, len(ws) AS dl, term, len(list_filter(ws, lambda w: w = term)) AS tf FROM t, q),
bm AS (SELECT doc_id, sum(ln((n - df + 0.5e0) / (df + 0.5e0) + 1e0) * tf * 2.2e0 / (tf + 1.2e0 * (0.25e0 + 0.75e0 * dl / greatest(avgdl, 1e0)))) AS score FROM m JOIN df USING (term), s WHERE tf > 0 GROUP BY doc_id)"""
WORDS = ["memory", "graph", "evidence"]


@query("bm25_df_idf", f"WITH t AS (SELECT doc_id, {TOKENS} AS ws FROM documents WHERE text IS NOT NULL), u AS (SELECT DISTINCT doc_id, unnest(ws) AS term FROM t) SELECT term, count(*) AS df, round(ln(((SELECT count(*) FROM t) - count(*) + 0.5e0) / (count(*) + 0.5e0) + 1e0), 6) AS idf FROM u GROUP BY term")
def _(spark, d):
    return R.document_frequency(docs(spark, d), "doc_id", "text").select("term", "df", F.round("idf", 6).alias("idf"))


@query("average_length", f"WITH t AS (SELECT {TOKENS} AS ws FROM documents WHERE text IS NOT NULL) SELECT round(avg(len(ws)), 6) AS avgdl FROM t")
def _(spark, d):
    return docs(spark, d).where("text IS NOT NULL").agg(F.round(F.avg(F.size(T.bm25_tokens(F.col("text")))), 6).alias("avgdl"))


@query("bm25_search", f"WITH {_BM25} SELECT doc_id, round(score, 6) AS score FROM bm")
def _(spark, d):
    return R.bm25(docs(spark, d), "doc_id", "text", WORDS).select("doc_id", F.round("score", 6).alias("score"))


_KW = "kw AS (SELECT doc_id, ((CASE WHEN contains(lower(text), 'memory') THEN 1 ELSE 0 END) + (CASE WHEN contains(lower(text), 'graph') THEN 1 ELSE 0 END) + (CASE WHEN contains(lower(text), 'evidence') THEN 1 ELSE 0 END)) / 3.0::DOUBLE AS score FROM documents WHERE text IS NOT NULL)"
_RRF = f"""{_BM25}, {_KW}, b AS (SELECT doc_id, row_number() OVER (ORDER BY score DESC, doc_id) - 1 AS r FROM (FROM bm ORDER BY score DESC, doc_id LIMIT 60)), k AS (SELECT doc_id, row_number() OVER (ORDER BY score DESC, doc_id) - 1 AS r FROM (FROM kw WHERE score > 0 ORDER BY score DESC, doc_id LIMIT 60)),
f AS (SELECT doc_id, sum(w / (61e0 + r)) AS score FROM (SELECT doc_id, r, 0.6e0 AS w FROM b UNION ALL SELECT doc_id, r, 0.4e0 FROM k) GROUP BY doc_id)"""


def _lists(spark, d):
    x = docs(spark, d)
    kw = x.where("text IS NOT NULL").select("doc_id", (T.count_contained(F.lower("text"), WORDS) / F.lit(3.0)).alias("score")).where("score > 0").orderBy(F.desc("score"), "doc_id").limit(60)
    return {"semantic": R.bm25(x, "doc_id", "text", WORDS, 60), "keyword": kw}


@query("rrf_two_lists", f"WITH {_RRF} SELECT doc_id, round(score, 6) AS score FROM f")
def _(spark, d):
    return R.rrf(_lists(spark, d), "doc_id", {"semantic": 0.6, "keyword": 0.4}).select("doc_id", F.round("score", 6).alias("score"))


@query("rrf_four_lists", f"""WITH {_RRF}, l AS (SELECT doc_id, row_number() OVER (ORDER BY n_chars DESC, doc_id) - 1 AS r FROM (FROM documents WHERE n_chars IS NOT NULL ORDER BY n_chars DESC, doc_id LIMIT 60)), n AS (SELECT doc_id, row_number() OVER (ORDER BY doc_id DESC) - 1 AS r FROM (FROM documents ORDER BY doc_id DESC LIMIT 60))
SELECT doc_id, round(sum(w / (61e0 + r)), 6) AS score FROM (SELECT doc_id, r, 0.4e0 AS w FROM b UNION ALL SELECT doc_id, r, 0.25e0 FROM k UNION ALL SELECT doc_id, r, 0.2e0 FROM l UNION ALL SELECT doc_id, r, 0.15e0 FROM n) GROUP BY doc_id""")
def _(spark, d):
    x = docs(spark, d)
    long = x.where("n_chars IS NOT NULL").select("doc_id", F.col("n_chars").cast("double").alias("score")).orderBy(F.desc("score"), "doc_id").limit(60)
    late = x.select("doc_id", F.col("doc_id").cast("double").alias("score")).orderBy(F.desc("score"), "doc_id").limit(60)
    return R.rrf(_lists(spark, d) | {"ppr": long, "traversal": late}, "doc_id", R.CHANNELS).select("doc_id", F.round("score", 6).alias("score"))


_CE = """ce AS (SELECT doc_id, score, 0.4e0 * score + 0.6e0 * (0.4e0 * len(list_filter(['memory', 'graph', 'evidence'], lambda w: list_contains(string_split_regex(lower(text), '\\s+'), w))) / 3e0
 + CASE WHEN contains(lower(text), 'memory graph evidence') THEN 0.5e0 ELSE least(0.3e0, 0.15e0 * ((CASE WHEN contains(lower(text), 'memory graph') THEN 1 ELSE 0 END) + (CASE WHEN contains(lower(text), 'graph evidence') THEN 1 ELSE 0 END))) END
 + 0.2e0 * least(0.5e0, len(list_filter(string_split_regex(text, '\\s+'), lambda w: regexp_matches(w, '^[A-Z]'))) / len(list_filter(string_split_regex(text, '\\s+'), lambda w: w <> ''))::DOUBLE)) AS combined
 FROM (FROM f ORDER BY score DESC, doc_id LIMIT 20) JOIN documents USING (doc_id))"""


def _reranked(spark, d):
    top = R.rrf(_lists(spark, d), "doc_id", {"semantic": 0.6, "keyword": 0.4}).orderBy(F.desc("score"), "doc_id").limit(20)
    return R.cross_encode(top.join(docs(spark, d).select("doc_id", "text"), "doc_id"), "memory graph evidence")


@query("cross_encoder_rules", f"WITH {_RRF}, {_CE} SELECT doc_id, round(combined, 6) AS combined FROM ce")
def _(spark, d):
    return _reranked(spark, d).select("doc_id", F.round("combined", 6).alias("combined"))


@query("hybrid_search", f"WITH {_RRF}, {_CE} SELECT doc_id, round(score, 6) AS fused, round(combined, 6) AS score FROM ce ORDER BY combined DESC, doc_id LIMIT 10")
def _(spark, d):
    return _reranked(spark, d).orderBy(F.desc("combined"), "doc_id").limit(10).select("doc_id", F.round("score", 6).alias("fused"), F.round("combined", 6).alias("score"))


def _mmr_sql(k: int, lam: float) -> str:
    """MMR unrolled: each step takes the best of what is left."""
    base = "q AS (SELECT embedding::DOUBLE[] AS a FROM embeddings WHERE vec_id = 0), p AS (SELECT vec_id, embedding::DOUBLE[] AS v, list_cosine_similarity(embedding::DOUBLE[], a) AS rel FROM embeddings, q WHERE vec_id <> 0 ORDER BY 3 DESC, vec_id LIMIT 20)"
    steps = [f"s1 AS (SELECT vec_id, v, 1 AS pick, {lam}e0 * rel AS score FROM p ORDER BY round({lam}e0 * rel, 12) DESC, vec_id LIMIT 1)"]
    for i in range(2, k + 1):
        before = " UNION ALL ".join(f"SELECT vec_id, v FROM s{j}" for j in range(1, i))
        steps.append(f"s{i} AS (SELECT vec_id, v, {i} AS pick, score FROM (SELECT p.vec_id, p.v, {lam}e0 * p.rel - {1 - lam:.1f}e0 * max(list_cosine_similarity(p.v, b.v)) AS score FROM p, ({before}) b WHERE p.vec_id NOT IN (SELECT vec_id FROM ({before})) GROUP BY p.vec_id, p.v, p.rel) ORDER BY round(score, 12) DESC, vec_id LIMIT 1)")
    return f"WITH {base}, {', '.join(steps)} " + " UNION ALL ".join(f"SELECT vec_id, pick, round(score, 6) AS score FROM s{i}" for i in range(1, k + 1))


@query("mmr_topk", _mmr_sql(5, 0.7))
def _(spark, d):
    e = load(spark, d, "embeddings")
    q = e.where("vec_id = 0").first()["embedding"]
    pool = R.nearest_to(e.where("vec_id != 0"), "vec_id", "embedding", q, 20).select("vec_id").join(e, "vec_id").select(F.col("vec_id").alias("id"), F.col("embedding").alias("v"))
    return R.mmr(pool, q, 5).select(F.col("id").alias("vec_id"), "pick", F.round("score", 6).alias("score"))


@query("tier_search", f"""WITH {MEM}, s AS (SELECT id, tier, ((CASE WHEN contains(lower(content), 'review') THEN 1 ELSE 0 END) + (CASE WHEN contains(lower(content), 'office') THEN 1 ELSE 0 END)) / 2e0 * CASE tier WHEN 'working' THEN 4e0 WHEN 'episodic' THEN 2e0 WHEN 'semantic' THEN 1.5e0 ELSE 1e0 END AS score FROM mem)
SELECT id, tier, round(score, 6) AS score FROM s WHERE score > 0 ORDER BY score DESC, id LIMIT 25""")
def _(spark, d):
    return M.tier_search(V.memory(spark, d), "review office", 25).select("id", "tier", F.round("score", 6).alias("score"))


_ASKED = ["Who is the manager of the lab", "What happened before the merger and why", "overview of all main themes", "compare the two schedules", "how many papers were there in 2019", "path from Alice to Bob through the lab", "hello there", "what if the index had not failed", "find the paper on graphs", "snapshot as of May", "is anything wrong?", "filter by group"]
_A = ", ".join("('" + a + "')" for a in _ASKED)


def _asked(spark):
    return spark.createDataFrame([(a,) for a in _ASKED], "question string")


def _any(words, col="q"):
    return "(" + " OR ".join(f"contains({col}, '{w.replace(chr(39), chr(39) * 2)}')" for w in words) + ")"


def _sum(words, col="q"):
    return "(" + " + ".join(f"(CASE WHEN contains({col}, '{w.replace(chr(39), chr(39) * 2)}') THEN 1 ELSE 0 END)" for w in words) + ")"


@query("intent4", f"WITH x(question) AS (VALUES {_A}), y AS (SELECT question, lower(question) AS q FROM x) SELECT question, CASE " + " ".join(f"WHEN {_any(w)} THEN '{n}'" for n, w in Q.QUERY_TYPES) + " ELSE 'local' END AS type FROM y")
def _(spark, d):
    return _asked(spark).select("question", Q.query_type(F.col("question")).alias("type"))


def _intent_sql() -> str:
    s = {n: f"{w}e0 * {_sum(words)}" for n, w, words in Q.INTENTS}
    s["factual"] = " + ".join(f"(CASE WHEN starts_with(q, '{w}') OR contains(q, ' {w} ') THEN 0.5e0 ELSE 0e0 END)" for w in Q.FACTUAL)
    cols = ", ".join(f"{s[n]} AS {n}" for n in Q.ORDER)
    top = ", ".join(Q.ORDER)
    return f"WITH x(question) AS (VALUES {_A}), y AS (SELECT question, lower(question) AS q FROM x), z AS (SELECT question, {cols} FROM y), w AS (SELECT * REPLACE (exploratory + CASE WHEN greatest({top}) < 0.5 THEN 1e0 ELSE 0e0 END AS exploratory) FROM z) SELECT question, CASE " + " ".join(f"WHEN {n} = greatest({top}) THEN '{n}'" for n in Q.ORDER) + " END AS intent FROM w"


@query("intent8", _intent_sql())
def _(spark, d):
    return _asked(spark).select("question", Q.intent(F.col("question")).alias("intent"))


@query("chat_intent", f"WITH x(question) AS (VALUES {_A}), y AS (SELECT question, lower(question) AS q FROM x) SELECT question, CASE " + " ".join(f"WHEN {_any(w.split('|'))} THEN '{n}'" for n, w in Q.CHAT) + " WHEN contains(q, '?') THEN 'explain' ELSE 'general' END AS intent FROM y")
def _(spark, d):
    return _asked(spark).select("question", Q.chat_intent(F.col("question")).alias("intent"))


@query("drift_breadth", f"WITH x(question) AS (VALUES {_A}), y AS (SELECT question, lower(question) AS q FROM x), z AS (SELECT question, {_sum(R.BROAD)} AS b, {_sum(R.SPECIFIC)} AS s, len(string_split(question, ' ')) AS n FROM y), w AS (SELECT question, CASE WHEN b + s > 0 THEN b / (b + s)::DOUBLE ELSE 0.5e0 END * 0.7e0 + least(n / 15e0, 1e0) * 0.3e0 AS breadth FROM z) SELECT question, round(breadth, 6) AS breadth, CASE WHEN breadth > 0.5 THEN 'global' WHEN breadth < 0.5 THEN 'local' ELSE 'adaptive' END AS mode FROM w")
def _(spark, d):
    return _asked(spark).select("question", F.round(R.breadth(F.col("question")), 6).alias("breadth"), R.drift_mode(F.col("question")).alias("mode"))


@query("answer_judge", f"WITH {ENT}, j AS (SELECT id, lower(trim(coalesce(summary, ''))) AS p, lower(trim(name)) AS t FROM ent) SELECT id, CASE WHEN p = '' THEN false ELSE contains(p, t) OR contains(t, p) END AS correct FROM j")
def _(spark, d):
    return V.entities(spark, d).select("id", Q.judge(F.coalesce("summary", F.lit("")), F.col("name")).alias("correct"))


@query("llm_scores", "SELECT * FROM (VALUES ('{\"score\": 7}', 0.7e0), ('I give it 8.5 of 10', 0.85e0), ('no idea', 0.5e0), ('12', 1e0)) t(answer, score)")
def _(spark, d):
    return spark.createDataFrame([('{"score": 7}',), ("I give it 8.5 of 10",), ("no idea",), ("12",)], "answer string").select("answer", F.round(R.parse_llm_scores(F.col("answer")), 6).alias("score"))


# --- extraction

_SENT = ["Alice works at Acme Labs", "Heavy rain caused the flood", "Bob founded Graphworks", "Because the index failed, search slowed", "The lab is located in Bern", "if it rains then we stay", "Nothing here"]
_S = ", ".join("('" + s + "')" for s in _SENT)


@query("relation_pairs", f"WITH x(t) AS (VALUES {_S}) " + " UNION ALL ".join(f"SELECT t AS sentence, trim(regexp_extract(t, '(?i){p}', 1)) AS source, '{n}' AS relation, trim(regexp_extract(t, '(?i){p}', 2)) AS target FROM x WHERE regexp_matches(t, '(?i){p}')" for n, p in X.RELATIONS))
def _(spark, d):
    x = spark.createDataFrame([(s,) for s in _SENT], "sentence string")
    return x.select("sentence", F.explode(X.relation_pairs(F.col("sentence"))).alias("r")).select("sentence", "r.source", "r.relation", "r.target")


@query("causal_pairs", f"WITH x(t) AS (VALUES {_S}) " + " UNION ALL ".join(f"SELECT t AS sentence, trim(regexp_extract(t, '(?i){p}', 1)) AS cause, trim(regexp_extract(t, '(?i){p}', 2)) AS effect, {c}::DOUBLE AS confidence FROM x WHERE regexp_matches(t, '(?i){p}')" for n, p, c in X.CAUSES))
def _(spark, d):
    x = spark.createDataFrame([(s,) for s in _SENT], "sentence string")
    return x.select("sentence", F.explode(X.causal_pairs(F.col("sentence"))).alias("r")).select("sentence", "r.cause", "r.effect", "r.confidence")


#: Fixed values, written for SQL: phrases, acronyms, technical words and the words that are none.  Letters of other
#: scripts are written as underscores first, because word boundaries know ASCII only there.
_CONCEPTS = (
    r"\b([A-Z][a-z]+(?:\s+[A-Z][a-z]+)+)\b", r"\b([A-Z]{2,6})\b", r"\b((?i:[a-z]{3,}(?:tion|sion|ment|ence|ance|ity|ism|ous|ive|ical|graph|net|former)))\b",
)
_NO_CONCEPTS = "abstract introduction conclusion references acknowledgements appendix the and for with this that from which their these those been have will would could should also such"


@query(
    "concepts",
    "WITH a AS (SELECT doc_id, regexp_replace(text, '[^\\x00-\\x7f]', '_', 'g') AS t, text FROM (SELECT doc_id, regexp_replace(text, '[^\\x00-\\x7f\\p{L}\\p{M}\\p{Nd}\\p{Pc}]', '.', 'g') AS text FROM documents)), c AS (SELECT DISTINCT doc_id, lower(unnest(list_concat("
    + ", ".join(f"regexp_extract_all(t, '{p}', 1)" for p in _CONCEPTS)
    + "))) AS concept FROM a) SELECT concept, count(*) AS n FROM c WHERE concept NOT IN ("
    + ", ".join(f"'{w}'" for w in _NO_CONCEPTS.split())
    + ") GROUP BY concept",
)
def _(spark, d):
    x = docs(spark, d).where("text IS NOT NULL")
    return x.select("doc_id", F.explode(X.concepts(F.col("text"))).alias("concept")).groupBy("concept").agg(F.count(F.lit(1)).alias("n"))


@query("window_chunks", "WITH t AS (SELECT doc_id, trim(regexp_replace(text, '\\s+', ' ', 'g')) AS t FROM documents WHERE text IS NOT NULL), c AS (SELECT doc_id, t, unnest(generate_series(1, length(t), 448)) AS start FROM t WHERE t <> '') SELECT doc_id, start, md5(substr(t, start, 512)) AS piece FROM c")
def _(spark, d):
    x = docs(spark, d).where("text IS NOT NULL")
    return X.window_chunks(x, "doc_id", "text").select("doc_id", F.col("start").cast("bigint").alias("start"), F.md5("piece").alias("piece"))


@query("doc_profile", """WITH l AS (SELECT doc_id, text, list_filter(string_split(text, chr(10)), lambda x: trim(x) <> '') AS ls FROM documents WHERE text IS NOT NULL)
SELECT doc_id, strlen(text) > 100 AS extractable, len(ls) AS lines, round(coalesce(list_sum(list_transform(ls, lambda x: strlen(x))), 0) / greatest(len(ls), 1)::DOUBLE, 6) AS mean_line, len(list_filter(ls, lambda x: regexp_matches(x, '^\\d+(\\.\\d+)*\\.?\\s+[A-Z]'))) AS sections FROM l""")
def _(spark, d):
    p = X.profile(F.col("text"))
    return docs(spark, d).where("text IS NOT NULL").select("doc_id", p["extractable"].alias("extractable"), F.size(F.filter(F.split("text", "\n"), lambda x: F.trim(x) != "")).alias("lines"), F.round(p["mean_line"], 6).alias("mean_line"), p["sections"].alias("sections"))


@query("parse_strategy")
def _(spark, d):
    p = X.profile(F.col("text"))
    return docs(spark, d).where("text IS NOT NULL").select(p["strategy"].alias("strategy"), p["columns"].alias("columns")).groupBy("strategy", "columns").agg(F.count(F.lit(1)).alias("n"))


@query("text_entities")
def _(spark, d):
    return X.extract_entities(docs(spark, d), "doc_id", "text")


@query("json_entities")
def _(spark, d):
    return X.extract_json(docs(spark, d).where("source = 'json_event'"), "doc_id", "text")


@query("document_sections")
def _(spark, d):
    return X.sections(docs(spark, d).where("source IN ('wiki_page', 'manual')"), "doc_id", "text")


_ASK = "institute of network science"


def _recipe(name: str):
    """A recipe over the whole graph: entities, facts, documents and the groups of entities as communities."""

    def run(spark, d):
        from chronoloom.operators import graph as G

        e, r = V.entities(spark, d), V.relationships(spark, d)
        seen = r.select(F.explode(F.array("source_id", "target_id")).alias("id")).groupBy("id").agg(F.count(F.lit(1)).alias("mentions"))
        entity = e.select("id", F.concat_ws(" ", "name", "summary").alias("text")).join(seen, "id", "left")
        groups = G.summaries(e.where("group_id IS NOT NULL").select("id", F.col("group_id").alias("community")), e)
        tables = {
            "entity": entity, "relationship": r.select("id", F.col("fact").alias("text")), "episode": docs(spark, d).select(F.col("doc_id").cast("string").alias("id"), "text"),
            "community": groups.select(F.col("community").alias("id"), F.col("summary").alias("text"), F.lit(0.5).alias("importance")),
        }
        center = r.agg(F.min("source_id")).first()[0]
        return R.run_recipe(R.RECIPES[name], tables, _ASK, center, r.select("id", "source_id", "target_id", F.lit(1.0).alias("weight"))).select("channel", "id", F.round("score", 6).alias("score"))

    return run


for _name in R.RECIPES:
    QUERIES[f"recipe_{_name}"] = _recipe(_name)


@query(
    "hybrid_stages",
    f"""WITH {ENT}, {REL}, t AS (SELECT id, list_filter(string_split_regex(lower(concat_ws(' ', name, summary)), '[^\\p{{L}}\\p{{N}}'']+'), lambda w: strlen(w) > 1) AS ws FROM ent)
SELECT 'semantic' AS stage, least(45, (SELECT count(*) FROM ent))::BIGINT AS n UNION ALL SELECT 'keyword', least(45, (SELECT count(*) FROM t WHERE list_has_any(ws, ['institute', 'network', 'science'])))::BIGINT""",
)
def _(spark, d):
    rows = V.entities(spark, d).select("id", F.concat_ws(" ", "name", "summary").alias("text"))
    return R.hybrid(rows, V.relationships(spark, d), _ASK, 15)[1].where("stage IN ('semantic', 'keyword')")


@query("hybrid_graph")
def _(spark, d):
    rows = V.entities(spark, d).select("id", F.concat_ws(" ", "name", "summary").alias("text"))
    r = V.relationships(spark, d)
    start = r.agg(F.min("source_id")).first()[0]
    return R.hybrid(rows, r, _ASK, 15, [start])[0].select("id", F.round("score", 6).alias("score"), "sources")


@query("greedy_context")
def _(spark, d):
    x = docs(spark, d).where("n_chars > 0 AND group_id IS NOT NULL").select("group_id", F.col("doc_id").alias("id"), F.ceil(F.col("n_chars") / 4.0).alias("size"), F.col("n_chars").cast("double").alias("score"))
    return M.knapsack(x, "group_id", 2000)


def _type_sql() -> str:
    any_ = lambda conds: "(" + " OR ".join(conds) + ")"
    near = lambda a: f"contains(c, {a})"
    place = any_([f"n IN ({', '.join(repr(p) for p in T.PLACES)})", *[near(f"n || ' {w}'") for w in T.PLACE_WORDS], *[near(f"n || ' is a {w}'") for w in T.PLACE_WORDS], *[near(f"'{w} ' || n") for w in ("in", "to", "from")]])
    firm = any_([*[f"ends_with(name, '{s}')" for s in T.FIRM_ENDINGS], *[near(f"'{w} ' || n") for w in T.FIRM_LEADS]])
    date = any_([*[f"contains(n, '{m}')" for m in T.MONTHS], "regexp_full_match(name, '[0-9/-]*')"])
    person = any_([x for w in T.PERSON_WORDS for x in (near(f"n || ' {w}'"), near(f"'{w} ' || n"))])
    return f"WITH {ENT}, x AS (SELECT id, name, lower(name) AS n, lower(coalesce(summary, '')) AS c FROM ent WHERE name IS NOT NULL) SELECT id, CASE WHEN {place} THEN 'Location' WHEN {firm} THEN 'Organization' WHEN {date} THEN 'Date' WHEN {person} THEN 'Person' ELSE 'Entity' END AS type FROM x"


@query("inferred_types", _type_sql())
def _(spark, d):
    return V.entities(spark, d).where("name IS NOT NULL").select("id", T.infer_entity_type(F.col("name"), F.coalesce("summary", F.lit(""))).alias("type"))


_QS = "[" + ", ".join(f"'{w}'" for w in T.QUESTION_STOP) + "]"


@query("question_words", f"WITH x(question) AS (VALUES {_A}) SELECT question, array_to_string(list_filter(list_transform(list_filter(string_split_regex(question, '\\s+'), lambda w: w <> ''), lambda w: regexp_replace(w, '^[^\\p{{L}}\\p{{N}}]+|[^\\p{{L}}\\p{{N}}]+$', '', 'g')), lambda w: strlen(w) > 2 AND NOT list_contains({_QS}, w)), ' ') AS words FROM x")
def _(spark, d):
    return _asked(spark).select("question", F.array_join(T.question_words(F.col("question")), " ").alias("words"))


@query("sentence_chunks")
def _(spark, d):
    return X.chunk_sentences(docs(spark, d), "doc_id", "text", 64)


@query("section_chunks")
def _(spark, d):
    return X.chunk_sections(docs(spark, d).where("source IN ('wiki_page', 'manual')"), "doc_id", "text", 120)


@query("packed_context")
def _(spark, d):
    hits = R.bm25(docs(spark, d), "doc_id", "text", WORDS, 40).join(docs(spark, d).select("doc_id", "text"), "doc_id")
    return R.rag_context(hits.select(F.lit("memory graph evidence").alias("query"), F.col("doc_id").alias("id"), "text", "score"), 2000, 40)
