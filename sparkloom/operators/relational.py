"""The relational core as DataFrame transformations: what Catalyst needs to see, and nothing that it does better itself."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def project(df: DataFrame, **columns: Column | str) -> DataFrame:
    """Computed columns by name; all others are dropped, down to the scan."""
    return df.select(*[(F.col(c) if isinstance(c, str) else c).alias(name) for name, c in columns.items()])


def key_range(df: DataFrame, key: str, start=None, end=None) -> DataFrame:
    """Rows of the half-open range [start, end); None is unbounded. The bounds reach the scan."""
    if start is not None:
        df = df.where(F.col(key) >= F.lit(start))
    return df if end is None else df.where(F.col(key) < F.lit(end))


def equi_join(left: DataFrame, right: DataFrame, keys: Mapping[str, str], how: str = "inner") -> DataFrame:
    """Inner or left join on equal keys. Spark picks broadcast, shuffled hash or sort-merge from sizes, and adaptive
    execution splits skewed keys."""
    if how not in ("inner", "left"):
        raise ValueError(f"{how} joins are not in the dialect")
    on = [left[a] == right[b] for a, b in keys.items()]
    condition = on[0]
    for c in on[1:]:
        condition = condition & c
    return left.join(right, condition, how)


def theta_join(left: DataFrame, right: DataFrame, condition: Column) -> DataFrame:
    """Join on any predicate: a nested loop. Meant for a side that Spark can broadcast."""
    return left.join(right, condition, "inner")


def exact_sum(value: Column) -> Column:
    """The sum of a money column, exact and so independent of the order of rows."""
    return F.sum(value.cast("decimal(18,2)")).cast("double")


#: The dialect's aggregates.
AGGREGATES = {"count": F.count, "sum": F.sum, "min": F.min, "max": F.max, "avg": F.avg}


def aggregate(df: DataFrame, by: Sequence[str], having: Column | None = None, **aggregates: Column) -> DataFrame:
    """Group, aggregate, and keep the groups for which `having` holds."""
    out = df.groupBy(*by).agg(*[c.alias(name) for name, c in aggregates.items()])
    return out if having is None else out.where(having)


def partial(df: DataFrame, by: Sequence[str], shard: Column, value: str) -> DataFrame:
    """A leaf's part of an aggregate: sum and count by group and shard."""
    return df.groupBy(*by, shard.alias("shard")).agg(F.sum(F.col(value).cast("decimal(18,2)")).alias("ps"), F.count(value).alias("pc"))


def final(parts: DataFrame, by: Sequence[str]) -> DataFrame:
    """The whole from the parts: SUM and COUNT add up, AVG is their quotient."""
    total, n = F.sum("ps").cast("double"), F.sum("pc")
    return parts.groupBy(*by).agg(total.alias("total"), n.alias("n"), F.try_divide(total, n).alias("mean"))


def top(df: DataFrame, order: Sequence[Column], limit: int, offset: int = 0) -> DataFrame:
    """ORDER BY, LIMIT and OFFSET: each task keeps limit + offset rows only."""
    return df.orderBy(*order).offset(offset).limit(limit)


def inserted(df: DataFrame, rows: DataFrame) -> DataFrame:
    """INSERT: the table with more rows."""
    return df.unionByName(rows)


def updated(df: DataFrame, where: Column, **values: Column) -> DataFrame:
    """UPDATE as copy-on-write; rows for which the predicate is null stay as they are."""
    return df.withColumns({name: F.when(where, value).otherwise(F.col(name)) for name, value in values.items()})


def deleted(df: DataFrame, where: Column) -> DataFrame:
    """DELETE as copy-on-write; rows for which the predicate is null stay."""
    return df.where(~F.coalesce(where, F.lit(False)))


def duplicates(df: DataFrame, key: Sequence[str]) -> DataFrame:
    """Keys that break uniqueness, with their counts."""
    return df.groupBy(*key).count().where("count > 1")


def orphans(df: DataFrame, parent: DataFrame, key: str, parent_key: str) -> DataFrame:
    """Rows whose foreign key has no parent; a null key refers to nothing."""
    return df.where(F.col(key).isNotNull()).join(parent, df[key] == parent[parent_key], "left_anti")
