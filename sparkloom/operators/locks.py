"""Lock compatibility and deadlocks."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sparkloom.session import checkpointed

#: Modes, and of each the modes it is compatible with. Fixed values.
COMPATIBLE = {
    "IS": ("IS", "IX", "S", "SIX"),
    "IX": ("IS", "IX"),
    "S": ("IS", "S"),
    "SIX": ("IS",),
    "X": (),
}


def matrix(spark: SparkSession) -> DataFrame:
    """(held, req, ok) for each pair of modes."""
    return spark.createDataFrame([(a, b, b in COMPATIBLE[a]) for a in COMPATIBLE for b in COMPATIBLE], "held string, req string, ok boolean")


def conflicts(held: DataFrame, requested: DataFrame) -> DataFrame:
    """held: resource, tx, mode; requested: the same. (waiter, holder, resource) of each request that must wait."""
    m = F.broadcast(matrix(held.sparkSession).where("not ok"))  # 25 rows
    pairs = requested.alias("r").join(held.alias("h"), (F.col("r.resource") == F.col("h.resource")) & (F.col("r.tx") != F.col("h.tx")))
    named = pairs.select(F.col("r.tx").alias("waiter"), F.col("h.tx").alias("holder"), F.col("r.resource").alias("resource"), F.col("h.mode").alias("held"), F.col("r.mode").alias("req"))
    return named.join(m, ["held", "req"], "left_semi").select("waiter", "holder", "resource")


def victims(cyclic: DataFrame, transactions: DataFrame, policy: str = "youngest") -> DataFrame:
    """transactions: tx, started, work. The one of those on cycles to abort: the youngest, or that with least work."""
    on = transactions.join(cyclic.select(F.col("src").alias("tx")).distinct(), "tx", "left_semi")
    order = [F.desc("started"), F.desc("tx")] if policy == "youngest" else [F.asc("work"), F.desc("tx")]
    return on.orderBy(*order).limit(1)


def waiting(edges: DataFrame) -> DataFrame:
    """For large graphs: the edges that remain when those out of nodes that wait for nobody, and into nodes that nobody
    waits on, are taken away until none is left to take; none remain exactly if there is no cycle."""
    left = checkpointed(edges.select("src", "dst").distinct())
    before, n = None, left.count()
    while n not in (0, before):
        waited_on, waits = left.select(F.col("src").alias("dst")).distinct(), left.select(F.col("dst").alias("src")).distinct()
        left = checkpointed(left.join(waited_on, "dst", "left_semi").join(waits, "src", "left_semi").select("src", "dst"))
        before, n = n, left.count()
    return left


def cycles(edges: DataFrame) -> DataFrame:
    """edges: src, dst of a wait-for graph. Each node on a cycle, with the length of its shortest one, however long.

    Who reaches whom, within what `waiting` leaves, a step more each round; each pair is found once, in its first round.
    """
    left = waiting(edges)
    onward = left.select(F.col("src").alias("dst"), F.col("dst").alias("to"))
    front, found, d = left, left.withColumn("cycle_len", F.lit(1)), 1
    while front.take(1):
        d += 1
        # a node whose cycle is known needs no further steps
        open_ = front.join(found.where("src = dst").select("src"), "src", "left_anti")
        step = open_.join(onward, "dst").select("src", F.col("to").alias("dst")).distinct()
        front = checkpointed(step.join(found, ["src", "dst"], "left_anti"))
        found = checkpointed(found.unionByName(front.withColumn("cycle_len", F.lit(d))))
    return found.where("src = dst").select("src", "cycle_len")
