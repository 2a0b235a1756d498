"""Problem 10: reading level of English documents."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from chronoloom.llm.levels import reading_levels
from chronoloom.tables import load


def p10_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each English document of at least 40 words with its grade."""
    documents = load(spark, sf_dir, "documents").where("lang = 'en'")
    return reading_levels(documents, load(spark, sf_dir, "grade_labels"))


QUERIES = {"p10_found": p10_found}
ORACLE: dict = {}
