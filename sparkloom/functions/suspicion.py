"""Failure suspicion from heartbeat intervals."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Intervals in the window, the level from which a node is suspected, and the intervals below which there is no verdict.
WINDOW, THRESHOLD, LEAST = 1000, 8.0, 10


def gaps(beats: DataFrame, node: str, at: str) -> DataFrame:
    """Adds gap: from the node's heartbeat before, null for the first."""
    return beats.withColumn("gap", F.col(at) - F.lag(at).over(Window.partitionBy(node).orderBy(at)))


def moments(beats: DataFrame, node: str, at: str, window: int = WINDOW) -> DataFrame:
    """Adds n, mu and sigma of the last `window` gaps up to each heartbeat."""
    last = Window.partitionBy(node).orderBy(at).rowsBetween(1 - window, 0)
    return gaps(beats, node, at).withColumns({"n": F.count("gap").over(last), "mu": F.avg("gap").over(last), "sigma": F.stddev_pop("gap").over(last)})


#: Coefficients, from the constant up, of a fit to the complementary error function whose error is below 1.2e-7 of its
#: value everywhere (a Chebyshev fit from the literature). Fixed values.
ERFC = (-1.26551223, 1.00002368, 0.37409196, 0.09678418, -0.18628806, 0.27886807, -1.13520398, 1.48851587, -0.82215223, 0.17087277)


def phi(elapsed: Column, mu: Column, sigma: Column) -> Column:
    """-log10 of the chance that a gap of a normal distribution is longer than elapsed, to 1e-7; null where an input is.
    Without spread it is 0 up to the mean and infinite beyond. Far tails are worked out as logarithms, so that none
    becomes 0."""
    t, m, s = (c.cast("double") for c in (elapsed, mu, sigma))

    def of(x: Column) -> Column:
        u = F.lit(1.0) / (F.lit(1.0) + F.abs(x) * 0.5)
        fit = F.lit(ERFC[-1])
        for c in ERFC[-2::-1]:
            fit = F.lit(c) + u * fit
        log = F.log(u) - x * x + fit  # of erfc(|x|)
        tail = F.when(x >= 0, log - math.log(2)).otherwise(F.log(F.lit(1.0) - F.exp(log) * 0.5))
        return -tail / math.log(10)

    level = F.transform(F.array((t - m) / (s * math.sqrt(2))), of)[0]
    return F.when(t.isNull() | m.isNull() | s.isNull(), F.lit(None)).when(s > 0, level).when(t > m, F.lit(math.inf)).otherwise(F.lit(0.0))


def suspected(elapsed: Column, n: Column, mu: Column, sigma: Column, fallback: float, least: int = LEAST, threshold: float = THRESHOLD) -> Column:
    """Whether a node is suspected; with fewer than `least` gaps, whether it has been silent for the fallback."""
    return F.when(n < least, elapsed > fallback).otherwise(phi(elapsed, mu, sigma) > threshold)
