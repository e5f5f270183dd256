"""Column statistics, selectivity and cost, for what the optimizer does not show of itself."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sparkloom.plans.ordering import numbered


def column_stats(df: DataFrame, column: str, exact: bool = True) -> DataFrame:
    """Rows, distinct values, least and largest value."""
    ndv = F.count_distinct(column) if exact else F.approx_count_distinct(column)
    return df.agg(F.count("*").alias("n_rows"), ndv.alias("ndv"), F.min(column).alias("mn"), F.max(column).alias("mx"))


def equi_depth(df: DataFrame, column: str, tie: str, buckets: int) -> DataFrame:
    """A histogram of buckets with as many rows each, the first ones with one more where it does not come out even.

    Rows are sorted in ranges by all tasks, so that nothing but the ranges' counts meets in one place.
    """
    placed, total = numbered(df.select(column, tie), F.col(column), F.col(tie))
    base, extra = divmod(total, buckets)
    first = extra * (base + 1)
    late = F.lit(extra) + F.floor((F.col("_i") - first) / max(base, 1))
    bucket = F.when(F.col("_i") < first, F.floor(F.col("_i") / (base + 1))).otherwise(late) + 1
    return placed.groupBy(bucket.cast("long").alias("b")).agg(F.min(column).alias("lo"), F.max(column).alias("hi"), F.count("*").alias("cnt"))


def percentiles(df: DataFrame, by: str, value: str, **shares: float) -> DataFrame:
    """Interpolated percentiles of a value by group."""
    return df.groupBy(by).agg(*[F.percentile(value, p).alias(name) for name, p in shares.items()])


def hit_ratio(df: DataFrame, by: str, hits: str, misses: str) -> DataFrame:
    """Hits over all lookups by group; null without lookups."""
    total = F.sum(hits) + F.sum(misses)
    return df.groupBy(by).agg(F.try_divide(F.sum(hits), total).alias("hit_ratio"))


def analyze(spark: SparkSession, table: str, columns: Sequence[str]) -> None:
    """Collects statistics, with histograms, that Spark's cost-based optimizer then uses."""
    spark.conf.set("spark.sql.cbo.enabled", "true")
    spark.conf.set("spark.sql.statistics.histogram.enabled", "true")
    spark.sql(f"analyze table {table} compute statistics for columns {', '.join(columns)}")


@dataclass(frozen=True)
class Costs:
    """Advice by the textbook formulas: cost of a page read in sequence and at random, and of a row."""

    sequential: float = 1.0
    random: float = 4.0
    row: float = 0.01

    def scan(self, pages: float, rows: float) -> float:
        return pages * self.sequential + rows * self.row

    def index(self, height: float, rows: float, selectivity: float) -> float:
        return (height + rows * selectivity) * self.random + rows * selectivity * self.row


def equal_selectivity(ndv: int) -> float:
    """The share of rows that an equality keeps."""
    return 1 / ndv if ndv else 0.0


def greater_selectivity(value: float, low: float, high: float) -> float:
    """The share of rows above a value, if they are spread evenly."""
    if high <= low:
        return 0.0 if value >= high else 1.0
    return min(1.0, max(0.0, (high - value) / (high - low)))
