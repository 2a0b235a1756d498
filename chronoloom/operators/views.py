"""The graph behind the tables: entities, relationships, episodes and memory as keyed frames."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from chronoloom.tables import load


def entities(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One row per entity id."""
    return load(spark, sf_dir, "entities").dropDuplicates(["id"])


def versions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Distinct versions of facts."""
    return load(spark, sf_dir, "fact_versions").dropDuplicates(["relationship_id", "version", "created_at"])


def relationships(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The last known version of each relationship as an edge; superseded is expired."""
    last = F.max_by(F.struct("source_entity_id", "target_entity_id", "relationship_type", "fact", "confidence", "valid_from", "valid_until", "created_at", "superseded_at"), F.struct("created_at", "version", "valid_from"))
    e = load(spark, sf_dir, "fact_versions").groupBy(F.col("relationship_id").alias("id")).agg(last.alias("r"))
    return e.select("id", F.col("r.source_entity_id").alias("source_id"), F.col("r.target_entity_id").alias("target_id"), "r.relationship_type", "r.fact", "r.confidence", "r.valid_from", "r.valid_until", "r.created_at", F.col("r.superseded_at").alias("expired_at"))


def memory(spark: SparkSession, sf_dir: str) -> DataFrame:
    return load(spark, sf_dir, "memory_items").dropDuplicates(["id"])


def both_ways(edges: DataFrame) -> DataFrame:
    """Undirected form: a, b for each distinct pair of ends, both ways, without loops."""
    ab = edges.select(F.col("source_id").alias("a"), F.col("target_id").alias("b"))
    return ab.union(ab.select("b", "a")).where("a != b").distinct()


def small_graph(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Supplier, customer, nation and region as source_id, target_id, relationship_type, weight."""
    n, s, c = load(spark, sf_dir, "nation"), load(spark, sf_dir, "supplier"), load(spark, sf_dir, "customer")
    part = n.select(F.concat(F.lit("nation:"), "n_nationkey").alias("source_id"), F.concat(F.lit("region:"), "n_regionkey").alias("target_id"), F.lit("PART_OF").alias("relationship_type"))
    at = lambda df, p, k, nk: df.select(F.concat(F.lit(p), k).alias("source_id"), F.concat(F.lit("nation:"), nk).alias("target_id"), F.lit("LOCATED_IN").alias("relationship_type"))
    return part.union(at(s, "supplier:", "s_suppkey", "s_nationkey")).union(at(c, "customer:", "c_custkey", "c_nationkey")).withColumn("weight", F.lit(1.0))


def latest(df: DataFrame, key: str, *order: str) -> DataFrame:
    """Per key the row that is last in the given order (columns, descending)."""
    w = Window.partitionBy(key).orderBy(*[F.desc(o) for o in order])
    return df.withColumn("_r", F.row_number().over(w)).where("_r = 1").drop("_r")


#: The same views for the SQL side.
ENT = "ent AS (SELECT DISTINCT ON (id) * FROM entities)"
VER = "ver AS (SELECT DISTINCT ON (relationship_id, version, created_at) * FROM fact_versions)"
REL = """rel AS (SELECT relationship_id AS id, source_entity_id AS source_id, target_entity_id AS target_id, relationship_type, fact, confidence, valid_from, valid_until, created_at, superseded_at AS expired_at
 FROM (SELECT *, row_number() OVER (PARTITION BY relationship_id ORDER BY created_at DESC, version DESC, valid_from DESC) AS rn FROM fact_versions) WHERE rn = 1)"""
MEM = "mem AS (SELECT DISTINCT ON (id) * FROM memory_items)"
SMALL = """small AS (SELECT 'nation:' || n_nationkey AS source_id, 'region:' || n_regionkey AS target_id, 'PART_OF' AS relationship_type, 1.0::DOUBLE AS weight FROM nation
 UNION ALL SELECT 'supplier:' || s_suppkey, 'nation:' || s_nationkey, 'LOCATED_IN', 1.0 FROM supplier UNION ALL SELECT 'customer:' || c_custkey, 'nation:' || c_nationkey, 'LOCATED_IN', 1.0 FROM customer)"""
