"""Mixing sources to target weights by pivotal dependent rounding.

A source's target over its size is the mean number of copies of each of its documents: a whole number that all get, and
a fraction. Documents with a fraction are paired: one of the two is moved towards a whole copy and the other away from
it, as many words for the one as for the other, in a direction drawn so that each keeps its mean; the pair's whole one
is settled and the other goes on. Each bucket of a source so leaves one open document at most; these are paired again
in buckets of buckets, until each source has one, which is rounded. A source's taken words thus differ from its target
by less than its last open document; as a bucket's documents come by falling size, that is a short one.

Buckets and draws come from hashes of the rows, so that reruns agree however the rows are dealt.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window

from .common import Scratch, n_words, scratch, small, tidied

#: Documents, or open documents of buckets, that are paired in one bucket.
BUCKET = 1024

_MASK = (1 << 64) - 1


def _draw(a: int, b: int, seed: int) -> float:
    """A number in [0, 1) of two rows' hashes and a seed. Its constants are fixed values of public mixing functions."""
    x = (a * 0x9E3779B97F4A7C15 ^ (b * 0xC2B2AE3D27D4EB4F + seed)) & _MASK
    for shift, odd in ((30, 0xBF58476D1CE4E5B9), (27, 0x94D049BB133111EB)):
        x = ((x ^ x >> shift) * odd) & _MASK
    return ((x ^ x >> 31) >> 11) / (1 << 53)


def transfer(x: float, a: int, y: float, b: int, u: float) -> tuple[float, float]:
    """One step for two fractions x and y of documents with a and b words: one becomes 0 or 1, a*x + b*y stays, and over
    u both keep their means."""
    up, down = min(1 - x, y * b / a), min(x, (1 - y) * b / a)
    if u * (up + down) < down:  # x rises
        return (1.0, max(0.0, y - up * a / b)) if 1 - x <= y * b / a else (x + up, 0.0)
    return (0.0, min(1.0, y + down * a / b)) if x <= (1 - y) * b / a else (x - down, 1.0)


def ranked(sources: DataFrame, source: str, tables: Scratch) -> DataFrame:
    """Adds pos: 0, 1, ... by code point, null last; sorted in ranges, each of which starts at the sum of those before."""
    order = F.col(source).asc_nulls_last()
    parts = tables.stored(sources.repartitionByRange(order).withColumn("_part", F.spark_partition_id()), "ranges")
    counts = sorted((r["_part"], r["count"]) for r in parts.groupBy("_part").count().collect())  # a row for each range
    start, starts = 0, []
    for part, n in counts:
        starts.append((part, start))
        start += n
    at = sources.sparkSession.createDataFrame(starts, "_part int, _start long")
    numbered = parts.withColumn("_row", F.row_number().over(Window.partitionBy("_part").orderBy(order)))
    return numbered.join(F.broadcast(at), "_part").withColumn("pos", F.col("_start") + F.col("_row") - 1).drop("_part", "_start", "_row")


def targets(sources: DataFrame, weights: Sequence[float], share: float, most: float) -> DataFrame:
    """sources: pos and source_size; adds target. Sources weigh weights[pos % len(weights)] and share `share` times all
    sizes; a target stops at `most` times its source's size, and the excess is shared again by weight."""
    w = F.get(F.array(*[F.lit(float(x)) for x in weights]), F.pmod("pos", F.lit(len(weights))).cast("int"))
    rows, cap = sources.withColumn("_w", w), F.col("source_size") * float(most)
    total = rows.agg(F.sum("source_size"), F.sum("_w")).first()
    size, weight = float(total[0] or 0), float(total[1] or 0)
    goal = min(share, most) * size
    each, stopped = goal / weight if weight else 0.0, -1
    while True:  # each round stops more sources, and the distinct weights bound the rounds that matter
        above = F.lit(each) * F.col("_w") > cap
        got = rows.agg(F.sum(F.when(above, cap).otherwise(0.0)), F.sum(F.when(above, 0.0).otherwise(F.col("_w"))), F.count(F.when(above, 1))).first()
        if (got[2] or 0) == stopped or not got[1]:
            break
        stopped, each = got[2], (goal - got[0]) / got[1]
    return rows.withColumn("target", F.when(F.lit(each) * F.col("_w") > cap, cap).otherwise(F.lit(each) * F.col("_w"))).drop("_w")


_OPEN = "key string, pos long, size long, h long, base int, bucket long, p double"


def _paired(rows: DataFrame, seed: int) -> DataFrame:
    """One level: rows of _OPEN, by (pos, bucket); all come back, with p 0 or 1 but for one of each bucket at most."""

    @tidied
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        names = [c.split()[0] for c in _OPEN.split(", ")]
        held = None  # the open row of the bucket at hand
        for batch in batches:
            out = []
            for row in batch[names].itertuples(index=False, name=None):
                row = list(row)
                if held is not None and (held[1], held[5]) == (row[1], row[5]):
                    held[6], row[6] = transfer(held[6], held[2], row[6], row[2], _draw(held[3], row[3], seed))
                    out += [r for r in (held, row) if r[6] in (0.0, 1.0)]
                    held = next((r for r in (held, row) if r[6] not in (0.0, 1.0)), None)
                else:
                    if held is not None:
                        out.append(held)
                    held = row
            yield pd.DataFrame(out, columns=names)
        if held is not None:
            yield pd.DataFrame([held], columns=names)

    return rows.repartition("pos", "bucket").sortWithinPartitions("pos", "bucket", F.desc("size"), "h", "key").mapInPandas(run, _OPEN)


def mix(
    docs: DataFrame,
    weights: Sequence[float] = (5, 2, 1),
    share: float = 1.5,
    most: float = 2.0,
    seed: int = 1,
    key: str = "doc_id",
    source: str = "source",
    text: str = "text",
) -> DataFrame:
    """Per row: key, source, size (words), source_size, target, copies and taken (copies times size).

    Null and empty texts have size 0 and are taken 0 words; a null source is a source of its own, the last. A source
    without words has target 0. No document gets more than `most` copies, rounded up. Repeated rows (same key and size)
    are rows each, and alike. An empty table gives no rows. Other columns are left out. Only sizes are shuffled, never
    texts; a large source is dealt to as many buckets as it needs.
    """
    with scratch(docs.sparkSession) as tables:
        out = _mixed(docs.select(F.col(key).alias("key"), F.col(source).alias("source"), n_words(F.col(text)).alias("size")), weights, share, most, seed, tables)
        out = out.withColumn("key", F.col("key").cast(docs.schema[key].dataType))
        return Scratch(docs.sparkSession).stored(out.withColumnsRenamed({"key": key, "source": source}), "mix")


def _mixed(rows: DataFrame, weights: Sequence[float], share: float, most: float, seed: int, tables: Scratch) -> DataFrame:
    """rows: key, source, size."""
    rows = tables.stored(rows.withColumn("h", F.xxhash64("key", "size", F.lit(seed))), "sizes")
    by_source = rows.groupBy("source").agg(F.sum("size").alias("source_size"), F.count("*").alias("n"))
    by_source = tables.stored(targets(tables.stored(ranked(by_source, "source", tables), "ranked"), weights, share, most), "targets")
    seen = by_source.agg(F.count("*"), F.max("n")).first()

    rate = F.coalesce(F.try_divide("target", "source_size"), F.lit(0.0))
    buckets = F.greatest(F.lit(1), F.ceil(F.col("n") / BUCKET))
    joined = rows.join(small(by_source.withColumnRenamed("source", "_s"), seen[0]), F.col("source").eqNullSafe(F.col("_s")))
    planned = joined.select(
        F.col("key").cast("string").alias("key"), "pos", "size", "h", F.floor(rate).cast("int").alias("base"),
        F.pmod("h", buckets).alias("bucket"), (rate - F.floor(rate)).alias("p"),
    )
    planned = tables.stored(planned, "planned")
    names = [c.split()[0] for c in _OPEN.split(", ")]
    is_open = (F.col("size") > 0) & (F.col("p") > 0)
    parts, level, widest = [planned.where(~is_open).withColumn("p", F.lit(0.0))], 0, -(-(seen[1] or 0) // BUCKET)
    open_rows = planned.where(is_open)
    while True:
        done = tables.stored(_paired(open_rows.select(*names), seed + level), f"level{level}")
        parts.append(done.where("p in (0, 1)"))
        open_rows, level = done.where("p not in (0, 1)"), level + 1
        if widest <= 1:
            break
        open_rows, widest = open_rows.withColumn("bucket", F.floor(F.col("bucket") / BUCKET)), -(-widest // BUCKET)
    # one open row for each source, at most
    u = F.pmod(F.xxhash64("h", F.lit(seed + level)), F.lit(1 << 53)) / F.lit(float(1 << 53))
    parts.append(open_rows.withColumn("p", F.when(u < F.col("p"), 1.0).otherwise(0.0)))
    out = parts[0].select(*names)
    for part in parts[1:]:
        out = out.unionByName(part.select(*names))
    copies = F.when(F.col("size") > 0, F.col("base") + F.col("p").cast("int")).otherwise(0)
    out = out.join(small(by_source, seen[0]), "pos").withColumn("copies", copies)
    return out.select("key", "source", "size", "source_size", "target", "copies", (F.col("copies") * F.col("size")).alias("taken"))


def sampled(docs: DataFrame, key: str = "doc_id", text: str = "text", **options) -> DataFrame:
    """The mixed documents with their own columns; one that is taken twice comes twice. Documents without words go.
    Texts are shuffled once, by key, if more documents are taken than a broadcast may hold; else not at all.
    Rows with the same key, or none, are told apart by their sizes, and those of one size numbered: any of them are
    taken, as often as the mix takes rows like them. An empty table gives no rows."""
    spark, tables = docs.sparkSession, Scratch(docs.sparkSession)
    plan = mix(docs, key=key, text=text, **options).select(F.col(key).alias("_k"), "size", "copies").where("copies > 0")
    plan = tables.stored(plan, "plan")
    packed = docs.select(F.struct(*[docs[f"`{c}`"] for c in docs.columns]).alias("row"), F.col(key).alias("key"))
    with scratch(spark) as s:
        many = s.stored(packed.groupBy("key").count().where("count > 1 or key is null"), "many")
        if not many.take(1):
            rows = packed.join(small(plan, plan.count()), F.col("key") == F.col("_k"))
        else:
            many = small(many.select(F.col("key").alias("_m")), many.count())
            apart = packed.join(many, F.col("key").eqNullSafe(F.col("_m")), "left_semi").withColumn("_size", n_words(F.col(f"row.{text}")))
            apart = tables.stored(apart.withColumn("_part", F.spark_partition_id()), "apart")
            once = plan.join(many, F.col("_k").eqNullSafe(F.col("_m")), "left_anti")
            once = tables.stored(once, "once")
            rows = packed.join(small(once, once.count()), F.col("key") == F.col("_k"))
            ranges = plan.join(many, F.col("_k").eqNullSafe(F.col("_m")), "left_semi")
            rows = rows.unionByName(_numbered(apart, tables).join(*_ranges(ranges, tables)), allowMissingColumns=True)
    return rows.select("row", F.explode(F.sequence(F.lit(1), F.col("copies")))).select("row.*")


def _numbered(rows: DataFrame, tables: Scratch) -> DataFrame:
    """rows: key, _size, _part (their partition), stored. Adds _n: 0, 1, ... for those of one key and size; partition by
    partition, so that a key of many rows is numbered by many tasks."""
    counts = rows.groupBy("key", "_size", "_part").agg(F.count("*").alias("_c"))
    before = Window.partitionBy("key", "_size").orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    counts = tables.stored(counts.withColumn("_before", F.coalesce(F.sum("_c").over(before), F.lit(0))), "before")
    counts = counts.select(F.col("key").alias("_key"), F.col("_size").alias("_s"), F.col("_part").alias("_p"), "_before")
    own = rows.withColumn("_row", F.row_number().over(Window.partitionBy("key", "_size", "_part").orderBy(F.xxhash64("row"))))
    same = F.col("key").eqNullSafe(F.col("_key")) & (F.col("_size") == F.col("_s")) & (F.col("_part") == F.col("_p"))
    out = own.join(small(counts, counts.count()), same).withColumn("_n", F.col("_before") + F.col("_row") - 1)
    return out.select("row", "key", "_size", "_n")


def _ranges(plan: DataFrame, tables: Scratch) -> tuple[DataFrame, Column]:
    """plan: _k, size, copies. For each key and size, the range of numbers that get so many copies; and the condition."""
    counts = plan.groupBy("_k", "size", "copies").agg(F.count("*").alias("_c"))
    upto = Window.partitionBy("_k", "size").orderBy(F.desc("copies"))  # a row for each number of copies
    found = tables.stored(counts.withColumn("_hi", F.sum("_c").over(upto)).withColumn("_lo", F.col("_hi") - F.col("_c")).drop("_c"), "ranges_of_copies")
    inside = (F.col("_n") >= F.col("_lo")) & (F.col("_n") < F.col("_hi"))
    return small(found, found.count()), F.col("key").eqNullSafe(F.col("_k")) & (F.col("_size") == F.col("size")) & inside
