"""SQL text over the tables of a folder."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sparkloom.operators import relational
from sparkloom.sources.tables import register


def sql(spark: SparkSession, sf_dir: str, text: str) -> DataFrame:
    """Runs a statement with the folder's tables as views. Dialect and semantics are Spark's, in ANSI mode: three-valued
    logic for nulls, errors on overflow and on division by zero. UPDATE and DELETE give the table as it is afterwards;
    files are immutable, so that writing it is the caller's."""
    register(spark, sf_dir)
    plan = spark._jsparkSession.sessionState().sqlParser().parsePlan(text)
    kind = plan.getClass().getSimpleName()
    if kind not in ("UpdateTable", "DeleteFromTable"):
        return spark.sql(text)
    rows = spark.table(plan.table().multipartIdentifier().mkString("."))
    if kind == "DeleteFromTable":
        return relational.deleted(rows, F.expr(plan.condition().sql()))
    where = F.expr(plan.condition().get().sql()) if plan.condition().isDefined() else F.lit(True)
    set_ = [plan.assignments().apply(i) for i in range(plan.assignments().size())]
    return relational.updated(rows, where, **{x.key().sql().strip("`"): F.expr(x.value().sql()) for x in set_})


def explained(df: DataFrame, mode: str = "formatted") -> str:
    """The plan as text."""
    return df._jdf.queryExecution().explainString(df.sparkSession._jvm.org.apache.spark.sql.execution.ExplainMode.fromString(mode))


def create_table(spark: SparkSession, name: str, schema: str, key: str | None = None, buckets: int = 16) -> None:
    """CREATE TABLE as Parquet; with a key, bucketed and sorted by it, so that joins on it need no shuffle."""
    clustered = f"clustered by ({key}) sorted by ({key}) into {int(buckets)} buckets" if key else ""
    spark.sql(f"create table {name} ({schema}) using parquet {clustered}")


def drop_table(spark: SparkSession, name: str) -> None:
    spark.sql(f"drop table if exists {name}")


def create_index(df: DataFrame, path: str, key: str) -> DataFrame:
    """What stands for an index: a copy sorted by the key, with a Bloom filter of it in each file, so that point and range
    lookups skip almost all row groups."""
    df.repartitionByRange(key).sortWithinPartitions(key).write.mode("overwrite").option(f"parquet.bloom.filter.enabled#{key}", "true").parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def index_lookup(index: DataFrame, key: str, start, end=None) -> DataFrame:
    """Rows of one key, or of the half-open range [start, end): the bounds reach the index's files, whose statistics and
    Bloom filters leave few row groups to read."""
    return index.where(F.col(key) == F.lit(start)) if end is None else relational.key_range(index, key, start, end)


def drop_index(spark: SparkSession, path: str) -> None:
    """Deletes an index's files; the table that it was made of stays."""
    at = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(at, True)
