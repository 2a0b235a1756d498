"""Queries over intervals and histories (problems 3 and 4) and the SQL they are held against."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from chronoloom.operators.history import ChainStore, reports
from chronoloom.operators.intervals import periods_and_gaps
from chronoloom.session import shared_path
from chronoloom.tables import SPACE_RE2, load

SECOND = 1_000_000
#: Share of the span of arrivals that the first load takes; what arrived later comes as one batch of updates.
FIRST_LOAD = 0.9


def seconds(name: str):
    return F.floor(F.col(name) / SECOND).cast("bigint")


def p3_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Continuous periods and gaps of each relationship."""
    found = periods_and_gaps(load(spark, sf_dir, "fact_versions"), "relationship_id", "valid_from", "valid_until")
    return found.select("relationship_id", "kind", seconds("from_us").alias("from_s"), F.coalesce(seconds("until_us"), F.lit(-1).cast("bigint")).alias("until_s"))


def _cut(rows: DataFrame, name: str) -> int:
    low, high = rows.agg(F.min(name), F.max(name)).first()
    return 0 if low is None else int(low + FIRST_LOAD * (high - low))


def build_chains(spark: SparkSession, sf_dir: str) -> ChainStore:
    """The store of all histories: first what arrived early, then the later arrivals as a batch of updates."""
    facts = reports(load(spark, sf_dir, "fact_versions"), "relationship_id", "valid_from", "valid_until", ["created_at", "version"], "fact")
    changes = reports(load(spark, sf_dir, "entity_history"), "entity_id", "changed_at", None, ["changed_at", "seq"], "new_summary")
    early, first = F.col("p1") < _cut(facts, "p1"), F.col("p2") < _cut(changes, "p2")
    store = ChainStore(spark, shared_path(spark, "chains"))
    store.apply(facts.where(early).unionByName(changes.where(first)))
    store.apply(facts.where(~early).unionByName(changes.where(~first)))
    return store


def p4_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Periods of the states of relationships and entities."""
    chains = build_chains(spark, sf_dir).chains()
    return chains.select(F.col("k").alias("subject_id"), seconds("from_us").alias("from_s"), F.coalesce(seconds("until_us"), F.lit(-1).cast("bigint")).alias("until_s"))


QUERIES = {"p3_found": p3_found, "p4_found": p4_found}

_OPEN = "TIMESTAMP '9999-12-31'"

ORACLE = {
    "p3_found": f"""
WITH r AS (SELECT relationship_id, epoch(valid_from)::BIGINT AS s, epoch(coalesce(valid_until, {_OPEN}))::BIGINT AS e
           FROM fact_versions WHERE valid_from IS NOT NULL AND relationship_id IS NOT NULL AND (valid_until IS NULL OR valid_until > valid_from)),
m AS (SELECT *, max(e) OVER (PARTITION BY relationship_id ORDER BY s, e ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS p FROM r),
i AS (SELECT *, sum(CASE WHEN p IS NULL OR s - p > 1 THEN 1 ELSE 0 END) OVER (PARTITION BY relationship_id ORDER BY s, e ROWS UNBOUNDED PRECEDING) AS n FROM m),
g AS (SELECT relationship_id, n, min(s) AS f, max(e) AS u FROM i GROUP BY ALL),
h AS (SELECT *, lead(f) OVER (PARTITION BY relationship_id ORDER BY n) AS nf FROM g)
SELECT relationship_id, 'period' AS kind, f AS from_s, CASE WHEN u = epoch({_OPEN})::BIGINT THEN -1 ELSE u END AS until_s FROM h
UNION ALL SELECT relationship_id, 'gap', u, nf FROM h WHERE nf IS NOT NULL""",
    "p4_found": f"""
WITH r AS (
  SELECT DISTINCT relationship_id AS k, epoch(valid_from)::BIGINT AS s, epoch(coalesce(valid_until, {_OPEN}))::BIGINT AS e, epoch_us(created_at) AS p1, version::BIGINT AS p2,
         trim(regexp_replace(fact, '{SPACE_RE2}+', ' ', 'g')) AS v FROM fact_versions WHERE valid_until IS NULL OR valid_until > valid_from
  UNION SELECT entity_id, epoch(changed_at)::BIGINT, epoch({_OPEN})::BIGINT, epoch_us(changed_at), seq, trim(regexp_replace(new_summary, '{SPACE_RE2}+', ' ', 'g'))
         FROM entity_history WHERE new_summary IS NOT NULL),
b AS (SELECT DISTINCT k, s AS t FROM r UNION SELECT DISTINCT k, e FROM r),
g AS (SELECT k, t, lead(t) OVER (PARTITION BY k ORDER BY t) AS n FROM b),
w AS (SELECT g.k, g.t, g.n, arg_max(r.v, (r.p1, r.p2)) AS v FROM g JOIN r ON r.k = g.k AND r.s <= g.t AND r.e >= g.n WHERE g.n IS NOT NULL GROUP BY ALL),
l AS (SELECT *, lag(v) OVER o AS pv, lag(n) OVER o AS pn FROM w WINDOW o AS (PARTITION BY k ORDER BY t)),
i AS (SELECT *, sum(CASE WHEN pv = v AND t - pn <= 1 THEN 0 ELSE 1 END) OVER (PARTITION BY k ORDER BY t) AS x FROM l)
SELECT k AS subject_id, min(t) AS from_s, CASE WHEN max(n) = epoch({_OPEN})::BIGINT THEN -1 ELSE max(n) END AS until_s FROM i GROUP BY k, x""",
}
