"""Problem 9: documents mixed to the shares of mix_targets."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from chronoloom.llm.mixing import mix, shares
from chronoloom.tables import load

#: The curriculum of the queries: talk first, papers and manuals later, all else evenly.
CURRICULUM = {"chat_log": (1.5, 1.0, 0.5), "forum_post": (1.5, 1.0, 0.5), "paper_abstract": (0.5, 1.0, 1.5), "manual": (0.4, 1.0, 1.6)}


def p9_mix(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The mix in training order."""
    return mix(load(spark, sf_dir, "documents"), load(spark, sf_dir, "mix_targets"), CURRICULUM)


def p9_shares(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The share that each source really reached."""
    return shares(load(spark, sf_dir, "documents"), load(spark, sf_dir, "mix_targets"), CURRICULUM)


QUERIES = {"p9_mix": p9_mix, "p9_shares": p9_shares}
ORACLE: dict = {}
