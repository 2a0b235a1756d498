"""Problem 8: the whole corpus as ids."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from chronoloom.llm.tokens import encode
from chronoloom.tables import load


def p8_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    """doc_id and ids by byte_bpe_50k."""
    return encode(load(spark, sf_dir, "documents"), "doc_id", "text")


QUERIES = {"p8_ids": p8_ids}
ORACLE: dict = {}
