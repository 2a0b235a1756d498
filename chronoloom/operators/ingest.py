"""Ingestion as a batch of frames: validation, deduplication, conflicts, and the pipeline over them."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from chronoloom.functions import text as T
from chronoloom.functions import vectors as V

#: Relation types of which a source has one at a time.
EXCLUSIVE = "WORKS_AT EMPLOYED_BY LIVES_IN RESIDES_IN MARRIED_TO CEO_OF PRESIDENT_OF LOCATED_IN CAPITAL_OF REPORTS_TO MANAGES HEAD_OF STUDIES_AT ENROLLED_IN BORN_IN".split()
SAME, CLOSE = 0.92, 0.75


def _list(*conditions: tuple[Column, str]) -> Column:
    return F.concat_ws(",", *[F.when(c, F.lit(name)) for c, name in conditions])


def validate_entities(df: DataFrame, known: list[str] | None = None, strict: bool = False) -> DataFrame:
    """id, errors, warnings; ``strict`` turns unknown types into errors."""
    odd = ~F.col("entity_type").isin(known) if known else F.lit(False)
    errors = [(F.trim(F.coalesce("name", F.lit(""))) == "", "empty name"), (F.octet_length("name") > 500, "long name")]
    warnings = []
    (errors if strict else warnings).append((odd, "unknown type"))
    return df.select("id", _list(*errors).alias("errors"), _list(*warnings).alias("warnings"))


def validate_edges(df: DataFrame, known: list[str] | None = None, strict: bool = False) -> DataFrame:
    """id, errors, warnings of edges."""
    empty = lambda c: F.trim(F.coalesce(c, F.lit(""))) == ""
    odd = ~F.col("relationship_type").isin(known) if known else F.lit(False)
    errors = [(empty("source_id"), "empty source"), (empty("target_id"), "empty target"), (empty("relationship_type"), "empty type"), (empty("fact"), "empty fact")]
    warnings = [((F.col("confidence") < 0) | (F.col("confidence") > 1), "confidence")]
    (errors if strict else warnings).append((odd, "unknown type"))
    return df.select("id", _list(*errors).alias("errors"), _list(*warnings).alias("warnings"))


def cardinality(kind: Column, exclusive: list[str] | None = None) -> Column:
    return F.when(F.upper(kind).isin(exclusive or EXCLUSIVE), "exclusive").otherwise("non_exclusive")


def detect_conflicts(new: DataFrame, old: DataFrame, mode: str = "basic", exclusive: list[str] | None = None) -> DataFrame:
    """new_id, old_id, conflict of new edges with valid old ones of the same source and type.

    basic: the same target is redundant, another a contradiction.  enhanced: facts with cosine of at least 0.92
    or the same target are redundant; of an exclusive type, 0.75 is a supersession and less a contradiction;
    of others 0.75 is a soft conflict and less none.  Vectors (fact_embedding) may be missing on either side.
    """
    vector = "fact_embedding" in new.columns and "fact_embedding" in old.columns
    v = lambda df: F.col("fact_embedding") if vector else F.lit(None).cast("array<double>")
    side = lambda df, x: df.select(F.col("id").alias(f"{x}_id"), "source_id", "relationship_type", F.col("target_id").alias(f"{x}_target"), v(df).alias(f"{x}_v"))
    both = side(new, "new").join(side(old, "old"), ["source_id", "relationship_type"]).where("new_id != old_id")
    same = F.col("new_target") == F.col("old_target")
    if mode == "basic":
        return both.select("new_id", "old_id", F.when(same, "redundant").otherwise("contradiction").alias("conflict"))
    c = F.coalesce(V.cosine_or_null(F.col("new_v"), F.col("old_v")), F.lit(0.0))
    one = cardinality(F.col("relationship_type"), exclusive) == "exclusive"
    kind = F.when((c >= SAME) | same, "redundant").when(one & (c >= CLOSE), "supersession").when(one, "contradiction").when(c >= CLOSE, "soft_conflict").otherwise("none")
    return both.select("new_id", "old_id", kind.alias("conflict"))


def resolve(edges: DataFrame, conflicts: DataFrame, at: Column) -> DataFrame:
    """Edges with those that a contradiction or supersession ends made invalid at a time."""
    ended = conflicts.where(F.col("conflict").isin("contradiction", "supersession")).select(F.col("old_id").alias("id"), F.lit(True).alias("ended")).distinct()
    done = F.col("ended") & F.col("valid_until").isNull()
    return edges.join(ended, "id", "left").withColumns({"valid_until": F.when(done, at).otherwise(F.col("valid_until")), "expired_at": F.when(done, at).otherwise(F.col("expired_at"))}).drop("ended")


def duplicate_names(entities: DataFrame) -> DataFrame:
    """id, into: entities whose normalised name another one with a smaller id has."""
    rows = entities.select("id", T.normalize_name(F.col("name")).alias("k")).where("k != ''")
    return rows.join(rows.groupBy("k").agg(F.min("id").alias("into")), "k").where("id != into").select("id", "into")


def merge_entities(entities: DataFrame) -> DataFrame:
    """One row per normalised name: the smallest id, the longest summary, the latest update, summed access."""
    rows = entities.withColumn("k", T.normalize_name(F.col("name"))).where("k != ''")
    summary = F.max_by("summary", F.struct(F.length(F.coalesce("summary", F.lit(""))), F.coalesce("summary", F.lit(""))))
    return rows.groupBy("k").agg(F.min("id").alias("id"), F.count(F.lit(1)).alias("merged"), summary.alias("summary"), F.max("updated_at").alias("updated_at"), F.sum("access_count").alias("access_count"))


def learned_types(entities: DataFrame, prescribed: list[str]) -> DataFrame:
    """Types met that aren't prescribed, with their number."""
    return entities.where(~F.lower("entity_type").isin([p.lower() for p in prescribed])).groupBy(F.lower("entity_type").alias("entity_type")).agg(F.count(F.lit(1)).alias("n"))


def duplicate_papers(papers: DataFrame) -> DataFrame:
    """Per DOI (else normalised title) one record: first by id, nulls filled from the others."""
    key = F.coalesce(F.nullif(F.lower(T.extract_doi(F.coalesce("doi", F.lit("")))), F.lit("")), T.normalize_title(F.col("title")))
    rows = papers.select(key.alias("k"), "id", "title", "year", "citation_count").where("k IS NOT NULL AND k != ''")
    first = lambda c: F.min_by(c, F.when(F.col(c).isNotNull(), F.col("id"))).alias(c)
    return rows.groupBy("k").agg(F.min("id").alias("id"), F.count_distinct("id").alias("n"), first("title"), first("year"), F.max("citation_count").alias("citation_count"))


def ingest(episodes: DataFrame, extract, store: dict[str, DataFrame], at: Column, mode: str = "enhanced") -> dict[str, DataFrame]:
    """The whole batch: episodes (id, text) are extracted, validated, deduplicated against ``store`` and merged in.

    ``extract``: frame (id, text) to frames of entities (name, entity_type, episode) and edges (source, target,
    relationship_type, fact, episode).  Ids are hashes of natural keys, so a batch applied twice changes nothing.
    Text and JSON take the same way.  ``at`` dates all new rows.
    """
    found, edges = extract(episodes)
    eid = T.entity_key(F.col("name"), F.lit(""))
    new = found.where(F.trim("name") != "").withColumn("id", eid).groupBy("id").agg(F.min("name").alias("name"), F.min("entity_type").alias("entity_type")).withColumns({"summary": F.lit(""), "created_at": at, "updated_at": at})
    names = store["entities"].select(T.normalize_name(F.col("name")).alias("k"), F.col("id").alias("known")).groupBy("k").agg(F.min("known").alias("known"))
    new = new.withColumn("k", T.normalize_name(F.col("name"))).join(names, "k", "left").withColumn("into", F.coalesce("known", "id"))
    link = new.select("k", "into").groupBy("k").agg(F.min("into").alias("into"))
    end = lambda c: link.select(F.col("k").alias(f"k_{c}"), F.col("into").alias(f"{c}_id"))
    e = edges.withColumns({"k_source": T.normalize_name(F.col("source")), "k_target": T.normalize_name(F.col("target"))}).join(end("source"), "k_source").join(end("target"), "k_target")
    rel = e.withColumn("id", T.relationship_key(F.col("source_id"), F.col("target_id"), F.col("relationship_type"))).groupBy("id").agg(F.first("source_id").alias("source_id"), F.first("target_id").alias("target_id"), F.first("relationship_type").alias("relationship_type"), F.min("fact").alias("fact"), F.lit(0.7).alias("confidence"))
    rel = rel.withColumns({"valid_from": at, "valid_until": F.lit(None).cast("timestamp"), "created_at": at, "expired_at": F.lit(None).cast("timestamp")})
    bad = validate_edges(rel).where("errors != ''").select("id")
    old = store["relationships"]
    rel = rel.join(bad, "id", "left_anti").join(old.select("id"), "id", "left_anti")
    conflicts = detect_conflicts(rel, old.where(F.col("expired_at").isNull() & F.col("valid_until").isNull()), mode)
    keep = rel.join(conflicts.where("conflict = 'redundant'").select(F.col("new_id").alias("id")), "id", "left_anti")
    fresh = new.where("known IS NULL").drop("k", "known", "into")
    return {
        "entities": store["entities"].join(fresh.select("id"), "id", "left_anti").unionByName(fresh, allowMissingColumns=True),
        "relationships": resolve(old, conflicts, at).unionByName(keep, allowMissingColumns=True), "conflicts": conflicts,
    }
