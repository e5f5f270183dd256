"""The write-ahead log as a table, and checkpoints."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

SCHEMA = "lsn long, prev_lsn long, tx_id long, type string, page_id long, slot int, before_image binary, after_image binary, undo_next_lsn long"

TYPES = ("BEGIN", "INSERT", "UPDATE", "COMMIT", "ABORT", "CLR")

CHECKPOINT = "checkpoint_lsn long, ts timestamp_ntz, att map<bigint,bigint>, dpt map<bigint,bigint>"


#: Records in a segment, that is, in one file.
SEGMENT = 100_000


def append(records: DataFrame, path: str) -> None:
    """Appends records as lines of JSON, a checksum before each, in segments that are ranges of the log."""
    body = F.to_json(F.struct(*[F.col(c) for c in records.columns]))
    rows = records.repartitionByRange("lsn").sortWithinPartitions("lsn")
    rows.select(F.concat(F.crc32(body), F.lit(" "), body)).write.mode("append").option("maxRecordsPerFile", SEGMENT).text(path)


def read(spark: SparkSession, path: str, tolerate_tail: bool = False) -> DataFrame:
    """The log's records; each file, a segment of bounded size, is read by one task. A record whose checksum does not fit
    raises. With tolerate_tail, one behind all good records of the log's last segment is taken for a torn end and left
    out, while one anywhere else still raises: the last segment is that with the largest number, or one without any
    good record."""
    files = spark.read.text(path, wholetext=True).select(F.col("_metadata.file_path").alias("file"), F.posexplode(F.split("value", "\n")).alias("at", "value"))
    lines = files.where("value <> ''").select("file", "at", F.regexp_extract("value", r"^(\d+) ", 1).alias("crc"), F.regexp_extract("value", r"^\d+ (.*)$", 1).alias("body"))
    good = (F.col("crc") != "") & (F.crc32("body").cast("string") == F.col("crc"))
    lines = lines.withColumn("good", good)
    if tolerate_tail:
        lsn = F.get_json_object("body", "$.lsn").cast("long")
        ends = lines.groupBy("file").agg(F.max(F.when(F.col("good"), F.col("at"))).alias("last"), F.max(F.when(F.col("good"), lsn)).alias("lsn"))
        none = F.lit((1 << 63) - 1)
        torn = ends.agg(F.max(F.struct(F.coalesce("lsn", none).alias("lsn"), F.coalesce("last", F.lit(-1)).alias("last"), "file")).alias("end"))  # one row
        torn = torn.select(F.col("end.file").alias("_file"), F.col("end.last").alias("_last"))
        lines = lines.join(F.broadcast(torn), F.col("file") == F.col("_file"), "left").where(F.col("good") | F.col("_file").isNull() | (F.col("at") < F.col("_last")))
    checked = F.when(F.col("good"), F.col("body")).otherwise(F.raise_error(F.lit("corrupt log record")).cast("string"))
    return lines.select(F.from_json(checked, SCHEMA).alias("r")).select("r.*")


def save_checkpoint(spark: SparkSession, path: str, lsn: int, ts, att: dict[int, int], dpt: dict[int, int]) -> None:
    """One row; a later checkpoint replaces it."""
    spark.createDataFrame([(lsn, ts, att, dpt)], CHECKPOINT).coalesce(1).write.mode("overwrite").parquet(path)


def load_checkpoint(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema(CHECKPOINT).parquet(path)
