"""A quality classifier: random Fourier features, ridge regression by summed normal equations, isotonic calibration.

A text becomes a few statistics; random Fourier features of the standardised statistics approximate a Gaussian kernel;
each partition sums its part of the normal equations, and the sums of all give the ridge weights; the scores of rows
that the weights did not see are calibrated by isotonic regression.
"""

from __future__ import annotations

import io
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import BLOCK, Scratch, frugal, hashed_words, mixed, scratch, small

#: Random features; the kernel's width in standard deviations; the ridge term for each row; bins of the calibration.
FEATURES, WIDTH, RIDGE, BINS, SEED = 192, 3.0, 1e-4, 512, 17

#: Partitions whose sums are added up in one task.
GROUP = 64

STATS = (
    "log_words", "word_len", "long_words", "symbols", "digits", "upper", "punct", "high", "bang", "repeat_words",
    "dup_lines", "line_len", "unique_words", "top_word", "other_space",
)

_KINDS = np.zeros((6, 256), np.float64)
for _i, _chars in enumerate((b"#*$%&|<>", b"0123456789", bytes(range(65, 91)), b".,;:!?'\"()-", bytes(range(128, 256)), b"!")):
    _KINDS[_i, list(_chars)] = 1

_STEP = np.uint64(0x9E3779B97F4A7C15)


def statistics(text: str | None) -> np.ndarray:
    """The statistics of a whole text, as shares of its words or bytes; an empty one has 0 for all. Words and windows of
    three words are counted by 64-bit hashes, so a very long text takes some 30 bytes a word."""
    data = (text or "").encode("utf-8", "surrogatepass")
    out = np.zeros(len(STATS))
    h, sizes = hashed_words(data)
    n_words, total = len(h), len(data)
    if not n_words:
        return out
    uses = np.unique(h, return_counts=True)[1]
    n_repeat = 0
    if n_words > 2:
        windows = np.unique(mixed(mixed(h[:-2] * _STEP + h[1:-1]) * _STEP + h[2:]), return_counts=True)[1]
        n_repeat = int(windows[windows > 1].sum())
    n_chars, bytes_ = int(sizes.sum()), np.zeros(256)
    for at in range(0, total, BLOCK):
        bytes_ += np.bincount(np.frombuffer(data, np.uint8, min(BLOCK, total - at), at), minlength=256)
    n_lines, lines = 0, set()
    for line in io.BytesIO(data):
        if line.strip():
            n_lines += 1
            lines.add(line.removesuffix(b"\n"))
    symbols, digits, upper, punct, high, bang = _KINDS @ bytes_
    out[:] = (
        np.log1p(n_words), n_chars / n_words, (sizes > 20).sum() / n_words, min(symbols / n_words, 4), digits / total, upper / n_chars,
        punct / n_words, high / total, min(bang / n_words, 3), n_repeat / n_words, (n_lines - len(lines)) / n_lines,
        np.log1p(total / n_lines), len(uses) / n_words, uses.max() / n_words, (total - n_chars) / total,
    )
    return out


def stats_of(text: Column) -> Column:
    @F.pandas_udf("array<double>")
    @frugal
    def run(texts: pd.Series) -> pd.Series:
        return pd.Series([statistics(t) for t in texts], dtype=object)

    return run(text)


@dataclass(frozen=True)
class Model:
    """Of fixed size, whatever the rows: FEATURES weights and at most BINS steps."""

    mean: np.ndarray
    scale: np.ndarray
    weights: np.ndarray
    steps: np.ndarray  # raw scores, rising
    levels: np.ndarray  # the share of label 1 at each

    def features(self, x: np.ndarray) -> np.ndarray:
        return _fourier((x - self.mean) / self.scale)

    def score(self, x: np.ndarray) -> np.ndarray:
        """Calibrated scores, 0 to 1, of rows of statistics."""
        if not len(self.steps):
            return np.full(len(x), 0.5)
        return np.interp(self.features(x) @ self.weights, self.steps, self.levels)


def _fourier(z: np.ndarray) -> np.ndarray:
    rng = np.random.default_rng(SEED)
    omega, phase = rng.normal(0, 1 / WIDTH, (len(STATS), FEATURES)), rng.uniform(0, 2 * np.pi, FEATURES)
    return np.concatenate([np.cos(np.clip(z, -8, 8) @ omega + phase) * np.sqrt(2 / FEATURES), np.ones((len(z), 1))], axis=1)


def _matrix(column: pd.Series) -> np.ndarray:
    return np.stack(column.to_numpy()) if len(column) else np.zeros((0, len(STATS)))


def isotonic(x: np.ndarray, y: np.ndarray, w: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The rising step function nearest to weighted points that are sorted by x: x and level of each block's ends."""
    blocks: list[list[float]] = []  # level, weight, first x, last x
    for xi, yi, wi in zip(x, y, w, strict=True):
        blocks.append([yi, wi, xi, xi])
        while len(blocks) > 1 and blocks[-2][0] >= blocks[-1][0]:
            b, a = blocks.pop(), blocks[-1]
            a[0] = (a[0] * a[1] + b[0] * b[1]) / (a[1] + b[1])
            a[1], a[3] = a[1] + b[1], b[3]
    steps = np.array([v for b in blocks for v in (b[2], b[3])])
    return steps, np.repeat([b[0] for b in blocks], 2) if blocks else np.zeros(0)


def fit(rows: DataFrame) -> Model:
    """rows: x array<double> of statistics, y 0 or 1, fold: 0 is calibrated on, the others are fitted. Without rows to
    fit, every score is 0.5.

    Each partition sends its sums of the normal equations, one row for each feature; these are added up by shuffles,
    those of some GROUP partitions first.
    """
    cols = [F.avg(F.get("x", i)).alias(f"m{i}") for i in range(len(STATS))] + [F.stddev_pop(F.get("x", i)).alias(f"s{i}") for i in range(len(STATS))]
    seen = rows.agg(F.count("*").alias("n"), *cols).first()
    none = np.zeros(0)
    if not seen["n"]:
        return Model(np.zeros(len(STATS)), np.ones(len(STATS)), none, none, none)
    mean = np.array([seen[f"m{i}"] for i in range(len(STATS))])
    scale = np.array([seen[f"s{i}"] or 1.0 for i in range(len(STATS))])
    blank = Model(mean, scale, none, none, none)

    def sums(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        total = np.zeros((FEATURES + 1, FEATURES + 2))
        for batch in batches:
            if len(batch):
                f = blank.features(_matrix(batch["x"]))
                total += f.T @ np.concatenate([f, batch["y"].to_numpy(float)[:, None]], axis=1)
        if total[-1, -2]:  # else it had no rows
            yield pd.DataFrame({"i": np.arange(FEATURES + 1), "v": list(total)})

    def added(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        held: dict[int, np.ndarray] = {}
        for batch in batches:
            for i, v in zip(batch["i"], batch["v"], strict=True):
                held[i] = held.get(i, 0) + v
        if held:
            yield pd.DataFrame({"i": list(held), "v": list(held.values())})

    fitted = rows.where("fold <> 0").select("x", "y")
    parts, n_parts = fitted.mapInPandas(sums, "i int, v array<double>"), fitted.rdd.getNumPartitions()
    if n_parts > GROUP:
        parts = parts.repartition(n_parts // GROUP, F.spark_partition_id()).mapInPandas(added, "i int, v array<double>")
    got = parts.repartition(8, "i").mapInPandas(added, "i int, v array<double>").orderBy("i").collect()  # FEATURES + 1 rows
    ata = np.array([r.v for r in got])
    n = ata[-1, -2] if len(ata) else 0  # the constant feature's square
    if not n:
        return blank
    weights = np.linalg.solve(ata[:, :-1] + RIDGE * n * np.eye(FEATURES + 1), ata[:, -1])
    raw = Model(mean, scale, weights, none, none)

    @F.pandas_udf("double")
    def raw_score(x: pd.Series) -> pd.Series:
        return pd.Series(raw.features(_matrix(x)) @ raw.weights)

    # the mass of clean rows lies in a narrow band, so bins are of equal width over the scores' middle and clipped beyond
    scored = rows.where("fold = 0").select(raw_score("x").alias("raw"), "y")
    bins = scored.groupBy(F.greatest(F.lit(0), F.least(F.lit(BINS - 1), F.floor((F.col("raw") + 0.5) * (BINS / 2)))).alias("bin"))
    got = bins.agg(F.avg("raw").alias("x"), F.avg("y").alias("y"), F.count("*").alias("n")).orderBy("x").collect()  # BINS rows at most
    steps, levels = isotonic(np.array([r.x for r in got]), np.array([float(r.y) for r in got]), np.array([float(r.n) for r in got]))
    if not len(steps):
        steps, levels = np.array([0.0, 1.0]), np.array([0.0, 1.0])
    return Model(mean, scale, weights, steps, levels)


def scored(x: Column, model: Model) -> Column:
    @F.pandas_udf("double")
    def run(rows: pd.Series) -> pd.Series:
        return pd.Series(model.score(_matrix(rows)))

    return run(x)


def scored_text(text: Column, model: Model) -> Column:
    @F.pandas_udf("double")
    @frugal
    def run(texts: pd.Series) -> pd.Series:
        return pd.Series(model.score(np.stack([statistics(t) for t in texts])) if len(texts) else [], dtype=float)

    return run(text)


def training_rows(stats: DataFrame, labels: DataFrame, key: str, label: str) -> DataFrame:
    """stats: key, x, of rows to learn from; with their label, and a fold in 0 to 3 by the key. A key with several
    labels counts with each."""
    known = labels.where(F.col(label).isNotNull()).select(F.col(key).alias("_k"), F.col(label).cast("int").alias("y")).distinct()
    both = stats.join(small(known, known.count()), stats[key] == F.col("_k"))
    return both.select("x", "y", F.pmod(F.xxhash64("_k", F.lit(SEED)), F.lit(4)).cast("int").alias("fold"))


def train(docs: DataFrame, labels: DataFrame, learn: Column, key: str = "doc_id", text: str = "text", label: str = "quality") -> Model:
    """Learns from those documents for which learn holds and that have a label. Their statistics are stored on the way."""
    with scratch(docs.sparkSession) as s:
        known = labels.where(F.col(label).isNotNull()).select(F.col(key).alias("_k")).distinct()
        wanted = docs.where(learn).select(F.col(key).alias(key), F.col(text).alias("text"))
        wanted = wanted.join(small(known, known.count()), F.col(key) == F.col("_k"), "left_semi")
        stats = s.stored(wanted.select(key, stats_of(F.col("text")).alias("x")), "stats")
        rows = s.stored(training_rows(stats, labels, key, label), "rows")
        return fit(rows)


def classify(docs: DataFrame, labels: DataFrame, learn: Column, threshold: float = 0.3, key: str = "doc_id", text: str = "text", label: str = "quality") -> DataFrame:
    """Per row: key, held_out (not learn), score, predicted.

    Learns labels only from rows for which learn holds; nothing but the text is an input of a score. Null and empty
    texts have all-zero statistics and a score like any other. Without labels every score is 0.5. Repeated rows are
    scored each; ties get equal scores; empty tables give no rows; other columns are left out. Texts are read once: the
    statistics of all rows are stored, and texts are never shuffled.
    """
    every = docs.select(F.col(key).alias(key), learn.alias("learn"), stats_of(F.col(text)).alias("x"))
    with scratch(docs.sparkSession) as s:
        stats = s.stored(every, "stats")
        model = fit(s.stored(training_rows(stats.where("learn").select(key, "x"), labels, key, label), "rows"))
        out = stats.select(key, (~F.col("learn")).alias("held_out"), scored(F.col("x"), model).alias("score"))
        return Scratch(docs.sparkSession).stored(out.withColumn("predicted", (F.col("score") >= threshold).cast("int")), "scores")


def keep(docs: DataFrame, labels: DataFrame, learn: Column, threshold: float = 0.3, key: str = "doc_id", text: str = "text", label: str = "quality") -> DataFrame:
    """The documents that score the threshold or more, with their own columns. Scores are worked out from the text again
    rather than joined, so that texts are not shuffled. Null and empty texts are scored like any other, rows that repeat
    are kept or go alike, without labels all stay, and an empty table stays empty."""
    model = train(docs, labels, learn, key, text, label)  # on rows with labels only
    return docs.where(scored_text(F.col(text), model) >= threshold)
