"""Vector functions as columns, in double precision."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def dot(a: Column, b: Column) -> Column:
    """Sum of products over the shorter length."""
    n = F.least(F.size(a), F.size(b))
    return F.aggregate(F.zip_with(F.slice(a, 1, n), F.slice(b, 1, n), lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, z: s + z)


def norm(a: Column) -> Column:
    return F.sqrt(F.aggregate(a, F.lit(0.0), lambda s, x: s + x.cast("double") * x.cast("double")))


def cosine(a: Column, b: Column) -> Column:
    """0 for vectors that are empty, of different lengths, or zero."""
    n = norm(a) * norm(b)
    return F.when((F.size(a) != F.size(b)) | (F.size(a) == 0) | (n == 0), 0.0).otherwise(dot(a, b) / n)


def cosine_or_null(a: Column, b: Column) -> Column:
    """Null for vectors of different lengths, 0 for zero vectors."""
    return F.when(F.size(a) == F.size(b), cosine(a, b))


def normalize(a: Column) -> Column:
    n = norm(a)
    return F.when(n > 0, F.transform(a, lambda x: x.cast("double") / n)).otherwise(F.transform(a, lambda x: x.cast("double")))


def align(a: Column, size: int) -> Column:
    """Padded with zeros or cut to ``size``."""
    return F.slice(F.concat(F.transform(a, lambda x: x.cast("double")), F.array_repeat(F.lit(0.0), size)), 1, size)


def hash_bytes(text: Column) -> Column:
    """The 32 bytes of SHA-256."""
    return F.transform(F.sequence(F.lit(0), F.lit(31)), lambda i: F.conv(F.substring(F.sha2(text, 256), i * 2 + 1, F.lit(2)), 16, 10).cast("double"))


def hash_embedding(text: Column) -> Column:
    """32 numbers from 0 to 1."""
    return F.transform(hash_bytes(text), lambda b: b / 255)


def hash_embedding_wide(text: Column, size: int = 384) -> Column:
    """Normalised vector of SHA-256 blocks of the text and a counter."""
    blocks = [hash_bytes(F.concat(text, F.lit(str(i)))) for i in range((size + 31) // 32)]
    return normalize(F.transform(F.slice(F.concat(*blocks), 1, size), lambda b: b / 127.5 - 1))
