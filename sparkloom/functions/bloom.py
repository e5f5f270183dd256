"""Bloom filters: sizing, and an exact semi-join that prunes with one first."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def sizing(n: int, rate: float) -> tuple[int, int]:
    """Bits (64 at least) and probes (1 to 30) for n keys at a false-positive rate. The formula and its bounds are fixed
    values."""
    bits = max(64, math.ceil(-n * math.log(rate) / math.log(2) ** 2))
    return bits, min(30, max(1, round(bits / max(n, 1) * math.log(2))))


def build(df: DataFrame, column: str, n: int, rate: float = 0.01):
    """Spark's own filter over a long or string column, summed up from all partitions; it has mightContain, and can be
    written to bytes."""
    return df._jdf.stat().bloomFilter(column, n, rate)


def to_bytes(bloom) -> bytes:
    from pyspark import SparkContext

    out = SparkContext._jvm.java.io.ByteArrayOutputStream()
    bloom.writeTo(out)
    return bytes(out.toByteArray())


def from_bytes(data: bytes):
    from pyspark import SparkContext

    jvm = SparkContext._jvm
    return jvm.org.apache.spark.util.sketch.BloomFilter.readFrom(jvm.java.io.ByteArrayInputStream(bytearray(data)))


#: Bytes of a filter that is made part of a plan.
MOST = 8 << 20


def may_contain(data: bytes, key: Column) -> Column:
    """Whether a filter of hashes (see hashes_of) may hold a key: Spark's own expression, within generated code."""
    from pyspark import SparkContext
    from pyspark.sql.classic.column import Column as Classic, _to_java_column

    sql = SparkContext._jvm.org.apache.spark.sql
    parts = [sql.classic.ExpressionUtils.expression(_to_java_column(c)) for c in (F.lit(bytearray(data)), F.xxhash64(key))]
    return Classic(sql.classic.ExpressionUtils.column(sql.catalyst.expressions.BloomFilterMightContain(*parts)))


def hashes_of(keys: DataFrame, key: str, n: int, rate: float = 0.01) -> bytes:
    """A filter of the hashes of n keys, as bytes."""
    return to_bytes(build(keys.select(F.xxhash64(key).alias("h")), "h", max(1, n), rate))


def semi_join(df: DataFrame, key: str, keys: DataFrame, other: str, rate: float = 0.01) -> DataFrame:
    """Rows whose key is among other keys. A Bloom filter of these goes through the rows first, so that few that have no
    match are shuffled; the semi-join makes it exact. Where the filter would exceed MOST bytes, the join does it alone."""
    wanted = keys.select(F.col(other).alias("_k")).where("_k is not null")
    n = wanted.agg(F.approx_count_distinct("_k")).first()[0]
    if n and sizing(n, rate)[0] <= 8 * MOST:
        df = df.where(may_contain(hashes_of(wanted, "_k", n, rate), F.col(key)))
    return df.join(wanted, F.col(key) == F.col("_k"), "left_semi")
