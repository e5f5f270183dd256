"""Multi-version concurrency control as filters and joins over tables of versions and transactions."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


@dataclass(frozen=True)
class Snapshot:
    """What a statement or a transaction sees: itself, and what was committed up to max_active and was not active."""

    max_active: int
    active: tuple[int, ...] = ()
    own: int | None = None


def with_xmax(versions: DataFrame, key: str, xmin: str = "xmin") -> DataFrame:
    """Adds xmax: the transaction that wrote the key's next version, null for the last one."""
    return versions.withColumn("xmax", F.lead(xmin).over(Window.partitionBy(key).orderBy(xmin)))


def _committed(tx: Column, snapshot: Snapshot, aborted: Column) -> Column:
    seen = (tx <= snapshot.max_active) & ~aborted
    return seen & ~tx.isin(*snapshot.active) if snapshot.active else seen


def visible(versions: DataFrame, snapshot: Snapshot, aborted: DataFrame | None = None, xmin: str = "xmin", xmax: str = "xmax") -> DataFrame:
    """Versions whose writer the snapshot sees and whose deleter it does not.

    A transaction sees its own writes, and not what it deleted itself, whoever wrote it. aborted: one column of
    transactions that rolled back; without it, all that are neither active nor later are taken for committed.
    """
    rows, gone_min, gone_max = versions, F.lit(False), F.lit(False)
    if aborted is not None:
        first = aborted.toDF("_a").distinct()
        rows = rows.join(first, F.col(xmin) == F.col("_a"), "left").join(first.toDF("_b"), F.col(xmax) == F.col("_b"), "left")
        gone_min, gone_max = F.col("_a").isNotNull(), F.col("_b").isNotNull()
    born, died = _committed(F.col(xmin), snapshot, gone_min), _committed(F.col(xmax), snapshot, gone_max)
    if snapshot.own is not None:
        born, died = born | (F.col(xmin) == snapshot.own), died | (F.col(xmax) == snapshot.own)
    return rows.where(born & ~F.coalesce(died, F.lit(False))).select(*versions.columns)


def statement_snapshots(isolation: str, statements: Sequence[Snapshot]) -> list[Snapshot]:
    """The snapshot that each statement of a transaction reads: its own at READ COMMITTED, the first one's otherwise."""
    if isolation not in ("READ COMMITTED", "REPEATABLE READ", "SERIALIZABLE"):
        raise ValueError(isolation)
    return list(statements) if isolation == "READ COMMITTED" else [statements[0]] * len(statements)


def vacuumed(versions: DataFrame, min_active: int, aborted: DataFrame | None = None) -> DataFrame:
    """Versions that any snapshot may still need; one whose deleter rolled back is needed."""
    keep = F.col("xmax").isNull() | (F.col("xmax") >= min_active)
    if aborted is None:
        return versions.where(keep)
    gone = aborted.toDF("_a").distinct()
    return versions.join(gone, F.col("xmax") == F.col("_a"), "left").where(keep | F.col("_a").isNotNull()).drop("_a")


def first_committer_losers(writes: DataFrame, key: str, start: Column, commit: Column, tx: str, width: int = 1024) -> DataFrame:
    """writes: key, tx and the interval in which tx ran, in whole numbers. Each transaction that committed after an
    overlapping one had committed a write of the same key, with the first such one.

    Intervals meet commits in bins of a width, which should be about a transaction's length: so a key that is written
    all the time is spread over its bins.
    """
    a = writes.select(F.col(key).alias("k"), F.col(tx).alias("loser"), start.cast("long").alias("s"), commit.cast("long").alias("c"))
    a = a.withColumn("bin", F.explode(F.sequence(F.floor(F.col("s") / width), F.floor(F.col("c") / width))))
    b = writes.select(F.col(key).alias("k"), F.col(tx).alias("winner"), commit.cast("long").alias("w"))
    both = a.join(b.withColumn("bin", F.floor(F.col("w") / width)), ["k", "bin"]).where((F.col("w") < F.col("c")) & (F.col("w") > F.col("s")))
    return both.groupBy("loser").agg(F.min("winner").alias("winner"))


def dangerous_structures(edges: DataFrame) -> DataFrame:
    """edges: src, dst of rw-antidependencies between concurrent transactions. Pivots with an edge in and an edge out."""
    ins = edges.select(F.col("dst").alias("pivot")).distinct()
    return ins.join(edges.select(F.col("src").alias("pivot")).distinct(), "pivot", "left_semi")


#: What each isolation level still lets happen. Fixed values.
PERMITTED = {
    "READ COMMITTED": ("non-repeatable read", "phantom", "lost update", "write skew"),
    "REPEATABLE READ": ("write skew",),
    "SERIALIZABLE": (),
}


def non_repeatable_reads(reads: DataFrame) -> DataFrame:
    """reads: tx, key, version. (tx, key) pairs that read several versions."""
    return reads.groupBy("tx", "key").agg(F.min("version").alias("lo"), F.max("version").alias("hi")).where("lo <> hi").select("tx", "key")


def write_skews(reads: DataFrame, writes: DataFrame) -> DataFrame:
    """Pairs of transactions each of which read a key that the other wrote."""
    over = reads.alias("r").join(writes.alias("w"), (F.col("r.key") == F.col("w.key")) & (F.col("r.tx") != F.col("w.tx")))
    edges = over.select(F.col("r.tx").alias("a"), F.col("w.tx").alias("b")).distinct()
    back = edges.select(F.col("b").alias("a"), F.col("a").alias("b"))
    return edges.join(back, ["a", "b"], "left_semi").where("a < b")


def phantoms(scans: DataFrame) -> DataFrame:
    """scans: tx, predicate, scan (a number), key. (tx, predicate) pairs whose scans did not all find the same keys."""
    n = scans.groupBy("tx", "predicate").agg(F.count_distinct("scan").alias("scans"))
    found = scans.groupBy("tx", "predicate", "key").agg(F.count_distinct("scan").alias("n"))
    return found.join(n, ["tx", "predicate"]).where("n < scans").select("tx", "predicate").distinct()


def lost_updates(updates: DataFrame) -> DataFrame:
    """updates: tx, key, read_version, version: each transaction's write of a key over the version that it had read.
    (tx, key, lost) where another transaction had meanwhile written `lost` over the same version."""
    first = updates.groupBy("key", "read_version").agg(F.min("version").alias("lost"))
    return updates.join(first, ["key", "read_version"]).where(F.col("version") > F.col("lost")).select("tx", "key", "lost")
