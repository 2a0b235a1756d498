"""Problem 2: chunks cut into pieces of at most 512 words."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from chronoloom.llm.splitting import split_oversized
from chronoloom.tables import SPACE_RE2, load


def p2_pieces(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All pieces of all chunks."""
    return split_oversized(load(spark, sf_dir, "chunks"), "id", "text", carry=["section", "paper_id"])


def p2_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Chunks of more than 512 words and the boundary at which they can be cut."""
    pieces = split_oversized(load(spark, sf_dir, "chunks"), "id", "text")
    return pieces.where("boundary IS NOT NULL AND piece = 0").select(F.col("id").alias("chunk_id"), "boundary").distinct()


QUERIES = {"p2_found": p2_found, "p2_pieces": p2_pieces}


def _words(text: str) -> str:
    return f"len(regexp_extract_all({text}, '{SPACE_RE2.replace('[', '[^', 1)}+'))"


ORACLE = {
    "p2_found": f"""
WITH c AS (SELECT DISTINCT id, text FROM chunks WHERE {_words('text')} > 512),
p AS (SELECT id, text, unnest(string_split_regex(text, '\\n{SPACE_RE2}*\\n')) AS para FROM c),
q AS (SELECT id, para, regexp_replace(para, '(^|[^\\p{{L}}\\p{{N}}])(e\\.g|i\\.e|cf|Fig|approx|vs|et{SPACE_RE2}+al)\\.', '\\1\\2#', 'g') AS safe FROM p),
s AS (SELECT id, unnest(string_split_regex(safe, '[.!?]({SPACE_RE2}|$)')) AS sent FROM q),
a AS (SELECT id, max({_words('para')}) AS n FROM p GROUP BY id),
b AS (SELECT id, max({_words('sent')}) AS n FROM s GROUP BY id)
SELECT a.id AS chunk_id, CASE WHEN a.n <= 512 THEN 'paragraph' WHEN b.n <= 512 THEN 'sentence' ELSE 'word' END AS boundary FROM a JOIN b USING (id)""",
}
