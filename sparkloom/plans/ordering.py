"""The place of each row in a global order, without bringing the rows together."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from sparkloom.session import checkpointed


def numbered(df: DataFrame, *order: Column, name: str = "_i") -> tuple[DataFrame, int]:
    """Adds each row's place, from 0, and returns the number of rows. Rows are dealt to ranges once and kept there; a
    place is the range's start, from the ranges' counts, and the place within the range."""
    ranged = checkpointed(df.repartitionByRange(*order).withColumn("_part", F.spark_partition_id()))
    counts = sorted((r["_part"], r["count"]) for r in ranged.groupBy("_part").count().collect())  # a row for each range
    starts, total = [], 0
    for part, n in counts:
        starts.append((part, total))
        total += n
    at = F.broadcast(df.sparkSession.createDataFrame(starts, "_p int, _start long"))
    row = F.row_number().over(Window.partitionBy("_part").orderBy(*order))
    out = ranged.withColumn("_row", row).join(at, F.col("_part") == F.col("_p"))
    return out.withColumn(name, F.col("_start") + F.col("_row") - 1).drop("_part", "_p", "_row", "_start"), total
