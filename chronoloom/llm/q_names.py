"""Problem 1: spellings of researchers and institutions."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from chronoloom.llm.names import link_names, name_classes, name_pairs
from chronoloom.tables import load

#: Types of names that are neither people nor organisations.
OTHER = ("location", "technology", "product", "place", "date", "event")


#: Types of names that are people or organisations.
OWN = ("person", "organization")


def all_names(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Distinct names of both tables with what their types say, by vote: single types may be wrong.

    A name is left out if more of its mentions are typed as places or products than as people or
    organisations; mentions without type, or with a vague one, don't vote; every author is a vote.
    """
    kind = F.lower(F.trim("entity_type"))
    votes = lambda said: F.sum(F.coalesce(said.cast("int"), F.lit(0)))
    seen = load(spark, sf_dir, "recognized_entities").where("name IS NOT NULL").groupBy("name")
    seen = seen.agg(F.count(F.lit(1)).alias("n"), votes(kind == OWN[1]).alias("o"), votes(kind == OWN[0]).alias("p"), votes(kind.isin(*OTHER)).alias("x"))
    authors = load(spark, sf_dir, "s2_papers").select(F.explode("authors.name").alias("name")).where("name IS NOT NULL").groupBy("name")
    authors = authors.agg(F.count(F.lit(1)).alias("n"), F.lit(0).alias("o"), F.count(F.lit(1)).alias("p"), F.lit(0).alias("x"))
    both = seen.unionByName(authors).groupBy("name").agg(*[F.sum(c).alias(c) for c in ("n", "o", "p", "x")])
    return both.where("x <= o + p").select("name", "n", (F.col("o") > F.col("p")).alias("organisation"))


def p1_links(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every name with its entity, the rule that led there and a confidence."""
    return link_names(all_names(spark, sf_dir))


def p1_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pairs of spellings of one person or organisation."""
    return name_pairs(p1_links(spark, sf_dir))


def p1_classes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every name with its entity and the number of other names that are linked to it."""
    return name_classes(p1_links(spark, sf_dir))


QUERIES = {"p1_found": p1_found, "p1_links": p1_links, "p1_classes": p1_classes}
ORACLE: dict = {}
