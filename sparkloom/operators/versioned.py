"""A versioned key-value table with log-structured merge semantics, on DataFrames.

A run is a DataFrame of (key, value, seq, is_tombstone), key and value binary. Deletes are rows, too. Reads resolve each
key to its newest version over all runs; on equal sequence numbers, which the contract excludes, a tombstone wins, then
the larger value, so that the result is defined all the same.
"""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from sparkloom.operators.relational import key_range

SCHEMA = "key binary, value binary, seq long, is_tombstone boolean"


def puts(df: DataFrame, key: Column, value: Column, seq: Column) -> DataFrame:
    """Versions to write; a null value is an empty one."""
    return df.select(key.cast("binary").alias("key"), F.coalesce(value.cast("binary"), F.lit(b"")).alias("value"), seq.cast("long").alias("seq"), F.lit(False).alias("is_tombstone"))


def deletes(df: DataFrame, key: Column, seq: Column) -> DataFrame:
    """Tombstones to write."""
    return df.select(key.cast("binary").alias("key"), F.lit(b"").alias("value"), seq.cast("long").alias("seq"), F.lit(True).alias("is_tombstone"))


def empty(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame([], SCHEMA)


def merged(runs: Sequence[DataFrame]) -> DataFrame:
    """All versions of several runs."""
    return reduce(DataFrame.unionByName, runs)


def newest(versions: DataFrame, key: str = "key", seq: str = "seq", tombstone: str = "is_tombstone") -> DataFrame:
    """The newest version of each key, tombstones among them: one partial and one final aggregate, no window, so that a
    key with very many versions is reduced before the shuffle."""
    rest = [c for c in versions.columns if c not in (key, seq, tombstone)]
    row = F.struct(seq, tombstone, *rest)
    out = versions.groupBy(key).agg(F.max(row).alias("v"))
    return out.select(key, *[F.col(f"v.{c}").alias(c) for c in versions.columns if c != key]).select(*versions.columns)


def visible(versions: DataFrame, key: str = "key", seq: str = "seq", tombstone: str = "is_tombstone") -> DataFrame:
    """The newest version of each key that is not deleted."""
    return newest(versions, key, seq, tombstone).where(~F.col(tombstone))


def scan(versions: DataFrame, start=None, end=None, key: str = "key", **names: str) -> DataFrame:
    """Visible rows of the half-open range [start, end); the range is applied before the aggregate, at the scan."""
    return visible(key_range(versions, key, start, end), key, **names)


def get(versions: DataFrame, value, key: str = "key", **names: str) -> DataFrame:
    """One row, or none if the key is absent or deleted. An empty value is a row."""
    return visible(versions.where(F.col(key) == F.lit(value)), key, **names)


def ordered(versions: DataFrame) -> DataFrame:
    """Entry order: key ascending as unsigned bytes, newest first."""
    return versions.orderBy(F.asc("key"), F.desc("seq"))


def entry_size() -> Column:
    """Bytes of an entry: key, value, eight of the sequence number and one of the mark."""
    return F.octet_length("key") + F.octet_length("value") + 9


def compacted(versions: DataFrame, drop_tombstones: bool, **names: str) -> DataFrame:
    """What a compaction writes: each key's newest version; tombstones go only if nothing older can lie below."""
    return visible(versions, **names) if drop_tombstones else newest(versions, **names)


def next_seq(versions: DataFrame) -> int:
    """One more than the largest sequence number of all data, so that reopening never goes back."""
    return (versions.agg(F.max("seq")).first()[0] or 0) + 1
