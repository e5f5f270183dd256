"""What the operators share: words, stored tables and size-checked broadcasts."""

from __future__ import annotations

import ctypes
import functools
import gc
import uuid
from contextlib import contextmanager

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from sparkloom.session import shared_dir, ship

#: Fixed by the contracts: words are runs of anything but these ASCII white-space characters.
SPACE = r"[\x20\x09-\x0D]+"

#: Bytes that one broadcast may hold, and what a row takes beside its columns.
BROADCAST_BYTES, ROW_BYTES = 32 << 20, 32


def words(text: Column) -> Column:
    """The words of a text as an array; null and empty texts have none."""
    bare = F.btrim(F.coalesce(text, F.lit("")), F.lit(" \t\n\x0b\x0c\r"))
    return F.when(bare == "", F.array().cast("array<string>")).otherwise(F.split(bare, SPACE))


def n_words(text: Column) -> Column:
    """How many words a text has."""
    return F.size(words(text)).cast("long")


def remainder(key: Column, parts: int) -> Column:
    """crc32 of a key's decimal text modulo parts; a null key counts as an empty text."""
    return F.crc32(F.coalesce(key.cast("string"), F.lit(""))) % parts


def delete(spark: SparkSession, path: str) -> None:
    jvm = spark.sparkContext._jvm
    at = jvm.org.apache.hadoop.fs.Path(path)
    at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(at, True)


#: Of each passing() that is open, the folders made within it.
_passing: list[list[str]] = []


class Scratch:
    """Written tables in the shared folder. Reading them back cuts lineage and survives lost executors."""

    def __init__(self, spark: SparkSession):
        ship(spark)
        self.spark, self.base, self.names = spark, f"{shared_dir(spark)}/tables-{uuid.uuid4().hex}", {}
        if _passing:
            _passing[-1].append(self.base)

    def stored(self, df: DataFrame, name: str) -> DataFrame:
        path = f"{self.base}/{name}"
        df.write.parquet(path)
        return self.spark.read.schema(df.schema).parquet(path)

    def bucketed(self, df: DataFrame, name: str, by: str, buckets: int) -> DataFrame:
        """Stored in buckets, so that work by a key finds its rows together as often as it reads them, without a shuffle.
        Rows are added to those that the name has."""
        table = self.names.setdefault(name, f"bucketed_{uuid.uuid4().hex}")
        df.write.mode("append").bucketBy(buckets, by).option("path", f"{self.base}/{name}").saveAsTable(table)
        return self.spark.table(table)

    def gone(self) -> None:
        for name in self.names.values():
            self.spark.sql(f"drop table if exists {name}")
        delete(self.spark, self.base)

    def settle(self) -> None:
        """Lets Spark delete the shuffle files of plans that nothing refers to any more, as stored tables have replaced
        them; it does so once the driver's garbage is collected."""
        gc.collect()
        self.spark.sparkContext._jvm.System.gc()


@contextmanager
def scratch(spark: SparkSession):
    """A Scratch whose tables go at the end; for those that no returned DataFrame reads."""
    found = Scratch(spark)
    try:
        yield found
    finally:
        found.gone()


@contextmanager
def passing(spark: SparkSession):
    """Deletes, at the end, the tables of every Scratch that is made within: nothing may read them any more."""
    _passing.append([])
    try:
        yield
    finally:
        for base in _passing.pop():
            delete(spark, base)


def small(df: DataFrame, rows: int, most: int = BROADCAST_BYTES) -> DataFrame:
    """Asks for a broadcast only if the counted rows, with their texts, stay within the bound; else Spark shuffles."""
    held = rows * (ROW_BYTES + 8 * len(df.columns))
    texts = [F.coalesce(F.octet_length(f"`{f.name}`"), F.lit(0)) for f in df.schema if f.dataType.typeName() in ("string", "binary")]
    if texts and 0 < held <= most:
        held += df.agg(F.sum(functools.reduce(Column.__add__, texts).cast("long"))).first()[0]
    return F.broadcast(df) if held <= most else df


def spread(df: DataFrame) -> DataFrame:
    """df, a table of files, its rows dealt anew where fewer tasks than there are cores would read them all, as with one
    file of one row group. Tables of as many files as cores are left as they are without a look at the files; of others
    the row groups' footers are read."""
    cores = df.sparkSession.sparkContext.defaultParallelism
    if len(df.inputFiles()) >= cores:
        return df
    tasks = df.select(F.spark_partition_id().alias("task")).distinct().count()
    return df if tasks >= cores else df.repartition(cores)


def give_back() -> None:
    """Returns this process's free memory to the system."""
    pa.default_memory_pool().release_unused()
    libc = ctypes.CDLL(None)
    if hasattr(libc, "malloc_trim"):
        libc.malloc_trim(0)


def tidied(run):
    """A function for mapInPandas that gives memory back to the system at a task's end, as workers wait for the next
    with all that they ever held."""

    @functools.wraps(run)
    def wrapped(batches):
        try:
            yield from run(batches)
        finally:
            give_back()

    return wrapped


def frugal(run):
    """The same for a function of a pandas UDF, after each batch."""

    @functools.wraps(run)
    def wrapped(*batch):
        try:
            return run(*batch)
        finally:
            give_back()

    return wrapped


# --- words of a text as 64-bit hashes, in numpy -------------------------------------------------

_ODD = 0x9E3779B97F4A7C15
_IS_SPACE = np.zeros(256, bool)
_IS_SPACE[[9, 10, 11, 12, 13, 32]] = True

#: Bytes that are hashed at once, so that a very long text needs bounded memory beside its hashes.
BLOCK = 1 << 20


@functools.cache
def _powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """Those of _ODD up to n - 1, and of its inverse."""
    out = []
    for base in (_ODD, pow(_ODD, -1, 1 << 64)):
        steps = np.full(n, base, np.uint64)
        steps[0] = 1
        out.append(np.cumprod(steps, dtype=np.uint64))
    return out[0], out[1]


def mixed(h: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit integers that spreads every bit; works in place. Its numbers are fixed values: those of a
    public finalizer."""
    h ^= h >> np.uint64(33)
    h *= np.uint64(0xFF51AFD7ED558CCD)
    h ^= h >> np.uint64(33)
    h *= np.uint64(0xC4CEB9FE1A85EC53)
    h ^= h >> np.uint64(33)
    return h


def hashed_words(data: bytes) -> tuple[np.ndarray, np.ndarray]:
    """Of each word of UTF-8 bytes, in order, a 64-bit hash and its bytes: a polynomial of them, from prefix sums, then
    mixed. A word over several blocks is put together from its parts."""
    sums_, sizes_, held, size = [], [], 0, 0  # held, size: of the word that is open at a block's end
    for at in range(0, len(data), BLOCK):
        b = np.frombuffer(data, np.uint8, min(BLOCK, len(data) - at), at)
        up, down = _powers(1 << max(16, len(b).bit_length()))
        inside = np.zeros(len(b) + 2, bool)
        np.logical_not(_IS_SPACE[b], out=inside[1:-1])
        edges = np.flatnonzero(inside[1:] != inside[:-1])
        start, end = edges[::2], edges[1::2]
        sums = np.zeros(len(b) + 1, np.uint64)
        np.cumsum((b + np.uint64(1)) * up[: len(b)], out=sums[1:])
        sums, n = (sums[end] - sums[start]) * down[start], (end - start).astype(np.uint64)
        if size and len(start) and start[0] == 0:
            sums[0] = np.uint64((held + pow(_ODD, size, 1 << 64) * int(sums[0])) & (1 << 64) - 1)
            n[0] += np.uint64(size)
        elif size:
            sums, n = np.concatenate([np.array([held], np.uint64), sums]), np.concatenate([np.array([size], np.uint64), n])
        held = size = 0
        if len(end) and end[-1] == len(b) and at + BLOCK < len(data):
            held, size, sums, n = int(sums[-1]), int(n[-1]), sums[:-1], n[:-1]
        sums_.append(sums)
        sizes_.append(n)
    if size:
        sums_.append(np.array([held], np.uint64))
        sizes_.append(np.array([size], np.uint64))
    if not sums_:
        return np.zeros(0, np.uint64), np.zeros(0, np.uint64)
    sizes = np.concatenate(sizes_) if len(sizes_) > 1 else sizes_[0]
    return mixed((np.concatenate(sums_) if len(sums_) > 1 else sums_[0]) + sizes), sizes


def word_hashes(data: bytes) -> np.ndarray:
    return hashed_words(data)[0]


def lowered(text: str | None) -> bytes:
    """UTF-8 with A-Z lower-cased and nothing else; null is empty."""
    return (text or "").encode("utf-8", "surrogatepass").lower()
