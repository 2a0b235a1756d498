"""Problem 6: noise in scanned pages."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from chronoloom.llm.scans import faulty_lines, paragraphs
from chronoloom.tables import load


def p6_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Faulty lines of scanned pages."""
    return faulty_lines(load(spark, sf_dir, "chunks"))


def p6_paragraphs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Continuous paragraphs of the scanned papers."""
    return paragraphs(load(spark, sf_dir, "chunks"))


QUERIES = {"p6_found": p6_found, "p6_paragraphs": p6_paragraphs}
ORACLE: dict = {}
