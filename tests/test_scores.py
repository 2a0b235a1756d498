"""Scores where their formula divides by zero."""

import math

import duckdb
from pyspark.sql import functions as F

from chronoloom.plans import all_oracles, all_queries


def table(spark, sf, at):
    """memory_items with one item last accessed 168 hours after the query's now, and its id."""
    m = spark.read.parquet(f"{sf}/memory_items.parquet")
    one = m.where("content IS NOT NULL").agg(F.min("id")).first()[0]
    ahead = F.lit("2024-02-08 00:00:00").cast(m.schema["last_accessed"].dataType)
    m.withColumn("last_accessed", F.when(F.col("id") == one, ahead).otherwise(F.col("last_accessed"))).write.parquet(f"{at}/memory_items.parquet")
    return one


def test_composite_score_a_week_ahead(spark, sf, tmp_path):
    one = table(spark, sf, tmp_path)
    got = {r["id"]: r["score"] for r in all_queries()["composite_score"](spark, str(tmp_path)).collect()}
    con = duckdb.connect()
    con.execute("SET TimeZone='UTC'")
    con.execute(f"CREATE VIEW memory_items AS FROM '{tmp_path}/memory_items.parquet/*.parquet'")
    assert got[one] == math.inf and got == dict(con.execute(all_oracles()["composite_score"]).fetchall())


def test_evolved_memory_a_week_ahead(spark, sf, tmp_path):
    one = table(spark, sf, tmp_path)
    rows = {r["id"]: (r["score"], r["kept"]) for r in all_queries()["evolved_memory"](spark, str(tmp_path)).collect()}
    was = {r["id"]: r["score"] for r in all_queries()["evolved_memory"](spark, sf).collect()}
    assert rows[one] == (math.inf, True) and {k: s for k, (s, _) in rows.items() if k != one} == {k: s for k, s in was.items() if k != one}
