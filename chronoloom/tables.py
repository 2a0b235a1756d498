"""Loading of tables and small column helpers that every operator uses."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: The characters that count as white space (Unicode White_Space and the C0 separators).
SPACE = r"[\t-\r\x1c-\x20\x85\u00a0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000]"
#: The same class for engines with RE2 syntax.
SPACE_RE2 = r"[\t-\r\x{1c}-\x{20}\x{85}\x{a0}\x{1680}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}]"


def load(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """One table of a folder of Parquet tables, TIMESTAMP_NTZ columns taken as UTC."""
    df = spark.read.parquet(f"{sf_dir}/{name}.parquet")
    ntz = {f.name: utc(F.col(f"`{f.name}`")) for f in df.schema.fields if isinstance(f.dataType, T.TimestampNTZType)}
    return df.withColumns(ntz) if ntz else df


def utc(col: Column) -> Column:
    """TIMESTAMP_NTZ read as UTC, whatever the session's zone is."""
    epoch = F.to_timestamp_ntz(F.lit("1970-01-01 00:00:00"))
    return F.timestamp_micros(F.timestamp_diff("MICROSECOND", epoch, col))


def micros(df: DataFrame, name: str) -> Column:
    """Microseconds since 1970 UTC of a TIMESTAMP or TIMESTAMP_NTZ column."""
    col = F.col(f"`{name}`")
    if isinstance(df.schema[name].dataType, T.TimestampNTZType):
        return F.timestamp_diff("MICROSECOND", F.to_timestamp_ntz(F.lit("1970-01-01 00:00:00")), col)
    return F.unix_micros(col.cast("timestamp"))


def squeeze(col: Column) -> Column:
    """Trimmed text with each run of white space reduced to one blank."""
    return F.trim(F.regexp_replace(col, SPACE + "+", " "))


def scratch(df: DataFrame, **columns: Column) -> DataFrame:
    """Only the given columns; whatever else df carries can't clash with an operator's own names."""
    return df.select(*[value.alias(name) for name, value in columns.items()])
