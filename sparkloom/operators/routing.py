"""Which partition a key belongs to: by ranges, by hash, or on a ring of virtual nodes."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import Window

from sparkloom.plans.ordering import numbered

#: Virtual nodes of each node on the ring; bytes at which a range is split. Fixed values.
VIRTUAL_NODES, SPLIT_BYTES = 256, 64 << 20


def by_width(key: Column, width: int) -> Column:
    """The range of equal width that a whole number lies in."""
    return F.floor(key / F.lit(float(width))).cast("long")


def by_range(df: DataFrame, key: str, starts: Sequence) -> DataFrame:
    """Adds partition_id: the number of the range [start, next start) that holds the key; -1 before the first. starts
    are sorted, and the plan's own constant: a table of partitions, not of rows."""
    held = F.array(*[F.lit(s) for s in starts])
    return df.withColumn("partition_id", (F.size(F.filter(held, lambda s: s <= F.col(key))) - 1).cast("long"))


def by_hash(key: Column, partitions: int) -> Column:
    """hash(key) mod partitions."""
    return F.pmod(F.xxhash64(key), F.lit(partitions).cast("long"))


def ring(spark: SparkSession, nodes: Sequence[int], virtual: int = VIRTUAL_NODES) -> DataFrame:
    """(position, node_id): each node at `virtual` places of a 64-bit ring."""
    at = spark.createDataFrame([(int(n),) for n in nodes], "node_id long").select("node_id", F.explode(F.sequence(F.lit(0), F.lit(virtual - 1))).alias("v"))
    return at.select(F.xxhash64(F.lit("ring"), "node_id", "v").alias("position"), "node_id")


def by_ring(df: DataFrame, key: str, nodes: Sequence[int], virtual: int = VIRTUAL_NODES) -> DataFrame:
    """Adds node_id: that of the first place at or after the key's hash, around the end to the first place.

    The ring is a constant of nodes times virtual entries, in order; a key's place is found by its number of places
    before, in slices of the hash space, so that a key looks at few of them.
    """
    rows = sorted((r.position, r.node_id) for r in ring(df.sparkSession, nodes, virtual).collect())
    slices = 1 << max(0, (len(rows) - 1).bit_length() - 2)
    width = (1 << 64) // slices
    parts: list[list[tuple[int, int]]] = [[] for _ in range(slices)]
    for position, node in rows:
        parts[(position + (1 << 63)) // width].append((position, node))
    after, fallback = rows[0][1], [0] * slices
    for i in range(slices - 1, -1, -1):
        fallback[i] = after
        after = parts[i][0][1] if parts[i] else after
    table = df.sparkSession.createDataFrame([(i, p, f) for i, (p, f) in enumerate(zip(parts, fallback, strict=True))], "_slice long, _places array<struct<position:long,node:long>>, _after long")
    h = F.xxhash64(F.col(key))
    shift = 64 - (slices.bit_length() - 1)
    at = F.shiftright(h, shift) + F.lit(slices // 2) if slices > 1 else F.lit(0).cast("long")
    hashed = df.withColumns({"_h": h, "_at": at})
    joined = hashed.join(F.broadcast(table), F.col("_at") == F.col("_slice"), "left")  # nodes times virtual places
    first = F.get(F.filter("_places", lambda p: p.position >= F.col("_h")), 0)
    return joined.withColumn("node_id", F.coalesce(first.node, F.col("_after"))).select(*df.columns, "node_id")


def split_key(df: DataFrame, key: str) -> DataFrame:
    """The lower median of a key, exact, of one row: where a range that has grown too large is split. Ranges are sorted
    in parallel, and only their counts meet."""
    placed, n = numbered(df.select(key), F.col(key))
    return placed.where(F.col("_i") == (n + 1) // 2 - 1).select(key)


def oversized(manifest: DataFrame, limit: int = SPLIT_BYTES) -> DataFrame:
    """Partitions (partition_id, size_bytes) that are to be split."""
    return manifest.where(F.col("size_bytes") > limit)


def disjoint(ranges: DataFrame, low: str = "low", high: str = "high") -> DataFrame:
    """Ranges [low, high) that start before the one before them ends: none, if routing is to one partition."""
    before = F.max(high).over(Window.orderBy(low, high).rowsBetween(Window.unboundedPreceding, -1))  # a table of partitions
    return ranges.withColumn("_b", before).where(F.col(low) < F.col("_b")).drop("_b")
