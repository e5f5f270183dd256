"""A versioned table on disk: sorted Parquet runs with key blooms and statistics, under a manifest."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import replace

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sparkloom.operators import versioned as V
from sparkloom.sources.manifest import Compaction, FileMeta, Manifest, VersionEdit, leveled


class Store:
    """Writers are single; readers pin the manifest they started with, and old runs stay until vacuum()."""

    def __init__(self, spark: SparkSession, path: str, strategy: Callable[[Manifest], Compaction | None] = leveled):
        self.spark, self.path, self.strategy = spark, path.rstrip("/"), strategy
        self.manifest = Manifest.load(spark, f"{self.path}/MANIFEST")
        self.memory: list[DataFrame] = []
        self.next_seq = self.manifest.next_seq  # goes on where the data ends, so that new versions always win

    # --- writes

    def put(self, df: DataFrame, key: str = "key", value: str = "value") -> None:
        """Buffers versions; all rows of one call are one batch of the same sequence number, so keys must be distinct."""
        self.memory.append(V.puts(df, F.col(key), F.col(value), F.lit(self.next_seq)))
        self.next_seq += 1

    def delete(self, df: DataFrame, key: str = "key") -> None:
        self.memory.append(V.deletes(df, F.col(key), F.lit(self.next_seq)))
        self.next_seq += 1

    def flush(self) -> None:
        """Writes the buffer as a first-level run, one version for each key, then compacts while there is need."""
        if not self.memory:
            return
        added = self._written(V.newest(V.merged(self.memory)), 0)
        self._commit(VersionEdit(added=(added,) if added else ()))
        self.memory = []
        while (task := self.strategy(self.manifest)) is not None:
            self.compact(task)

    def _written(self, versions: DataFrame, level: int) -> FileMeta | None:
        number = self.manifest.next_file
        name = f"{self.path}/run-{number:08d}"
        rows = versions.repartitionByRange("key").sortWithinPartitions("key", F.desc("seq"))
        rows.write.mode("overwrite").option("parquet.bloom.filter.enabled#key", "true").parquet(name)
        seen = self.spark.read.schema(V.SCHEMA).parquet(name).agg(F.count("*"), F.min("key"), F.max("key"), F.sum(V.entry_size())).first()
        return FileMeta(level, number, name, bytes(seen[1]), bytes(seen[2]), seen[3]) if seen[0] else None

    def _commit(self, edit: VersionEdit) -> None:
        self.manifest = replace(self.manifest.applied(edit), next_seq=self.next_seq)
        self.manifest.save(self.spark, f"{self.path}/MANIFEST")

    def compact(self, task: Compaction) -> None:
        merged = V.compacted(self._read([f.file_name for f in task.inputs]), task.drop_tombstones)
        added = self._written(merged, task.target)
        self._commit(VersionEdit(added=(added,) if added else (), deleted=tuple((f.level, f.file_number) for f in task.inputs)))

    def vacuum(self) -> list[str]:
        """Deletes the runs that the manifest no longer names, and returns their paths."""
        jvm = self.spark.sparkContext._jvm
        at = jvm.org.apache.hadoop.fs.Path(self.path)
        fs = at.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration())
        live, gone = {f.file_name.rsplit("/", 1)[-1] for f in self.manifest.files}, []
        for status in fs.listStatus(at):
            name = status.getPath().getName()
            if name.startswith("run-") and name not in live:
                fs.delete(status.getPath(), True)
                gone.append(f"{self.path}/{name}")
        return gone

    # --- reads

    def _read(self, names: list[str]) -> DataFrame:
        return self.spark.read.schema(V.SCHEMA).parquet(*names) if names else V.empty(self.spark)

    def versions(self, low: bytes | None = None, high: bytes | None = None) -> DataFrame:
        """All versions that files overlapping the closed range, and the buffer, hold."""
        return V.merged([self._read([f.file_name for f in self.manifest.overlapping(low, high)]), *self.memory])

    def scan(self, start: bytes | None = None, end: bytes | None = None) -> DataFrame:
        """Visible (key, value) of [start, end), by key; empty bounds are none."""
        start, end = start or None, end or None
        return V.scan(self.versions(start, end), start, end).select("key", "value").orderBy("key")

    def get(self, key: bytes) -> bytes | None:
        """The value, or None if the key is absent or deleted; an empty value is not None."""
        row = V.get(self.versions(key, key), key).select("value").first()
        return None if row is None else bytes(row[0])
