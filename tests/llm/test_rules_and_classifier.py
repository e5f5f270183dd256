import math
import random
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from sparkloom.llm import common
from sparkloom.llm import quality_classifier as qc
from sparkloom.llm import quality_rules as qr
from sparkloom.llm.common import remainder
from sparkloom.llm.queries import op1_quality_rules
from sparkloom.sources.tables import table

from .helpers import documents, repeat_words, words

ODD = [
    (1, None, "en", "a"), (2, "", None, "a"), (3, " \t\n\x0b\f\r ", "en", None), (4, "one\u00a0word\u2003 two", None, "b"),
    (5, "a b c a b c", "en", "b"), (5, "a b c a b c", "en", "b"), (None, "x y\nx y\n\n \nx y", "en", None),
    (6, "long " * 40_000, "en", "a"), (7, "### $$ %%% &&& | <b>", "en", "a"), (8, "w\n" * 60, "en", "c"),
]


def measures(text):
    w, lines, dup = words(text), set(), 0
    for line in (text or "").split("\n"):
        if words(line):
            dup += line in lines
            lines.add(line)
    return len(w), sum(map(len, w)), sum(c in "#*$%&|<>" for c in text or ""), dup, repeat_words(w)


def by_rows(rows):
    return sorted((repr(r) for r in rows))


def test_measures_of_odd_texts(spark):
    got = qr.judge(documents(spark, ODD, clashing=True)).collect()
    want = [(k, *measures(t)) for k, t, _, _ in ODD]
    assert by_rows((r.doc_id, r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words) for r in got) == by_rows(want)
    for r in got:
        assert r.base_failed == (r.n_words < 50 or 100 * r.n_repeat_words > 50 * r.n_words)
        assert not (r.base_failed and r.kept)


def test_measures_of_documents(spark, sf):
    docs = {r.doc_id: r.text for r in table(spark, sf, "documents").collect()}
    got = qr.judge(table(spark, sf, "documents")).collect()
    assert len(got) == len(docs)
    assert all((r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words) == measures(docs[r.doc_id]) for r in got)


def good(i):
    rng = random.Random(i)
    return " ".join("".join(rng.choices("abcdefgh", k=5)) for _ in range(80))


def test_hosts_decide(spark):
    junk = [(1000 + i, good(1000 + i) + " ###" * 40, "en", "bad") for i in range(300)]
    clean_there = [(5000, good(5000), "en", "bad")]
    fine = [(i, good(i), "en", f"s{i % 5}") for i in range(200)]
    alone = [(9000, good(9000), "en", None), (9001, good(9001) + " ###" * 40, "en", None)]
    kept = {r.doc_id for r in qr.judge(documents(spark, junk + clean_there + fine + alone)).where("kept").collect()}
    assert kept == {i for i, *_ in fine} | {9000}


def test_shrinking_needs_evidence(spark):
    """One failing document of a small host says less than all of a large one's."""
    rows = [(i, good(i), "en", f"s{i % 20}") for i in range(400)] + [(1000, "short", "en", "tiny")]
    hosts = {r.source: r for r in qr.shrunk(qr.counted(qr.measured(documents(spark, rows)), "source")).collect()}
    assert 0 < hosts["tiny"].rate_any_failed < 1 and hosts["s1"].rate_any_failed < 0.05


def plain_verdicts(rows, min_words=50):
    """rows: (key, text, source). Of each key whether it is kept, and of each source its rates; loops over all documents."""
    failed = {}
    for k, t, _ in rows:
        n, _, symbols, dup, repeat = measures(t)
        base, sym, lines = n < min_words or 100 * repeat > 50 * n, 100 * symbols > 20 * n, 100 * dup > 10 * n
        failed[k] = base, sym, lines, base or sym or lines
    hosts = {}
    for k, _, s in rows:
        if s is not None:
            held = hosts.setdefault(s, [0] * 5)
            for i, x in enumerate((1, *failed[k])):
                held[i] += x
    rates = {s: [] for s in hosts}
    docs = sum(h[0] for h in hosts.values())
    for i in range(1, 5):
        p = sum(h[i] for h in hosts.values()) / docs
        spread = sum(h[0] * (h[i] / h[0] - p) ** 2 for h in hosts.values())
        weight = docs
        if 0 < p < 1:
            likeness = (spread / (p * (1 - p)) - (len(hosts) - 1)) / (docs - sum(h[0] ** 2 for h in hosts.values()) / docs - (len(hosts) - 1))
            weight = max(1, 1 / likeness - 1) if likeness > 0 else docs
        for s, h in hosts.items():
            rates[s].append((h[i] + weight * p) / (h[0] + weight))

    def kept(k, s):
        base, sym, lines, _ = failed[k]
        _, sym_rate, line_rate, any_rate = rates.get(s, (0, 1, 1, 0))
        return not (base or (sym and sym_rate >= qr.SOFT_RATE) or (lines and line_rate >= qr.SOFT_RATE) or any_rate >= qr.HOST_RATE)

    return {k: kept(k, s) for k, _, s in rows}, rates


def test_verdicts_equal_a_plain_version(spark):
    sf = "/root/testdata/sf0.1"
    rows = [tuple(r) for r in table(spark, sf, "documents").select("doc_id", "text", "source").collect()]
    kept, rates = plain_verdicts(rows)
    got = {r.source: [r[f"rate_{x}"] for x in qr.RULES] for r in qr.shrunk(qr.counted(qr.measured(table(spark, sf, "documents")), "source")).collect()}
    assert got.keys() == rates.keys() and all(got[s] == pytest.approx(rates[s]) for s in rates)
    judged = {r.doc_id: r.kept for r in op1_quality_rules(spark, sf).collect()}
    assert judged == kept and 0 < sum(judged.values()) < len(judged)


def test_sampling_variance_is_no_difference(spark):
    """Small hosts that fail at one rate by chance are all shrunk to about that rate."""
    rng = random.Random(2)
    rows = spark.createDataFrame([(f"h{i}", 10, *[sum(rng.random() < 0.3 for _ in range(10))] * 4) for i in range(400)], "host string, n_docs long, " + ", ".join(f"{r} long" for r in qr.RULES))
    got = [r.rate_any_failed for r in qr.shrunk(rows).collect()]
    assert max(got) - min(got) < 0.1 and abs(sum(got) / 400 - 0.3) < 0.03


def test_keep_returns_documents(spark):
    docs = documents(spark, ODD + [(i, good(i), "en", "s") for i in range(100, 120)], clashing=True)
    out = qr.keep(docs)
    assert out.columns == docs.columns and {r.doc_id for r in out.collect()} == set(range(100, 120))


@pytest.mark.parametrize("make", [qr.judge, qr.keep])
def test_empty(spark, make):
    assert make(documents(spark, [])).count() == 0


def test_native(spark, sf):
    from sparkloom.plans.frontdoor import explained

    made = qr.measured(table(spark, sf, "documents")), qr.shrunk(qr.counted(qr.measured(table(spark, sf, "documents")), "source")), qr.keep(table(spark, sf, "documents"))
    assert not any(word in explained(df) for df in made for word in ("Python", "Arrow", "Pandas"))


# --- classifier


def test_statistics_of_odd_texts():
    for _, t, _, _ in ODD:
        assert np.isfinite(qc.statistics(t)).all()
    assert (qc.statistics(None) == 0).all() and (qc.statistics("") == qc.statistics(None)).all()


def plain_statistics(text):
    data = text.encode()
    w, lines = data.split(), [x for x in data.split(b"\n") if x.strip()]
    n, three = len(w), Counter(zip(w, w[1:], w[2:]))
    count = lambda chars: sum(b in chars for b in data)
    chars, upper = sum(map(len, w)), bytes(range(65, 91))
    return [
        math.log1p(n), chars / n, sum(len(x) > 20 for x in w) / n, min(count(b"#*$%&|<>") / n, 4), count(b"0123456789") / len(data), count(upper) / chars,
        count(b".,;:!?'\"()-") / n, sum(b > 127 for b in data) / len(data), min(count(b"!") / n, 3), sum(c for c in three.values() if c > 1) / n,
        (len(lines) - len(set(lines))) / len(lines), math.log1p(len(data) / len(lines)), len(set(w)) / n, max(Counter(w).values()) / n, (len(data) - chars) / len(data),
    ]


@pytest.mark.parametrize("block", [1, 7, 97, 1 << 20])
def test_statistics_do_not_depend_on_blocks(monkeypatch, block):
    """Of whole texts, whatever is worked on at once: repeats across blocks, and words cut by them, count."""
    monkeypatch.setattr(common, "BLOCK", block)
    monkeypatch.setattr(qc, "BLOCK", block)
    passage = "The quick brown fox, jumps over 13 lazy dogs!\n" + good(3) + " été\u00a0là\n"
    for text in (passage * 2, passage + "x" * 300 + " " + passage, "a", " \n a b a b a b \n\n", passage[:-1]):
        assert qc.statistics(text) == pytest.approx(plain_statistics(text))


def test_statistics_of_a_very_long_text(spark):
    text = (good(5) + "\n") * 12_000  # 6 MB
    got = qc.statistics(text)
    assert got == pytest.approx(plain_statistics(text))
    rows = [(1, text, "en", "s"), (2, good(6), "en", "s")]
    labels = spark.createDataFrame([(1, 0), (2, 1)], "doc_id long, quality int")
    assert qc.classify(documents(spark, rows), labels, F.lit(True)).count() == 2


def plain_scores(docs, labels, learn):
    """Of each doc_id, its score by normal equations in one place. labels: quality by doc_id."""
    fold = F.pmod(F.xxhash64("doc_id", F.lit(qc.SEED)), F.lit(4))
    rows = docs.select("doc_id", "text", learn.alias("learn"), fold.alias("fold")).collect()
    x = np.array([qc.statistics(r.text) for r in rows])
    y = np.array([labels.get(r.doc_id, -1) for r in rows])
    known, f = np.array([bool(r.learn) for r in rows]) & (y >= 0), np.array([r.fold for r in rows])
    mean, scale = x[known].mean(0), x[known].std(0)
    scale[scale == 0] = 1
    z = qc._fourier((x - mean) / scale)
    fit, cal = known & (f != 0), known & (f == 0)
    weights = np.linalg.solve(z[fit].T @ z[fit] + qc.RIDGE * fit.sum() * np.eye(z.shape[1]), z[fit].T @ y[fit])
    raw = z @ weights
    bins = np.clip(np.floor((raw[cal] + 0.5) * (qc.BINS / 2)), 0, qc.BINS - 1)
    of = [(raw[cal][bins == b].mean(), y[cal][bins == b].mean(), (bins == b).sum()) for b in np.unique(bins)]
    steps, levels = qc.isotonic(*np.array(sorted(of)).T)
    return dict(zip([r.doc_id for r in rows], np.interp(raw, steps, levels), strict=True))


def test_scores_equal_a_plain_fit(spark, monkeypatch):
    """The query's scores against normal equations in one place."""
    monkeypatch.setattr(qc, "GROUP", 2)
    sf = "/root/testdata/sf0.01"
    docs, labels = table(spark, sf, "documents").repartition(7), {r.doc_id: r.quality for r in table(spark, sf, "labels").collect()}
    learn = remainder(F.col("doc_id"), 5) != 0
    want = plain_scores(docs, labels, learn)
    got = qc.classify(docs, table(spark, sf, "labels"), learn).collect()
    assert len(got) == len(want) and all(r.score == pytest.approx(want[r.doc_id], abs=1e-4) for r in got)


def test_isotonic_is_the_nearest_rising_fit():
    rng = np.random.default_rng(3)
    for _ in range(20):
        y, w = rng.random(12), rng.random(12) + 0.1
        steps, levels = qc.isotonic(np.arange(12.0), y, w)
        fit = np.interp(np.arange(12.0), steps, levels)
        want = [max(min(np.average(y[a : b + 1], weights=w[a : b + 1]) for b in range(i, 12)) for a in range(i + 1)) for i in range(12)]
        assert np.allclose(fit, want)


def test_features_approximate_a_gaussian_kernel():
    rng = np.random.default_rng(1)
    z = rng.normal(size=(40, len(qc.STATS)))
    f = qc._fourier(z)[:, :-1]
    exact = np.exp(-((z[:, None] - z[None]) ** 2).sum(-1) / (2 * qc.WIDTH**2))
    assert np.abs(f @ f.T - exact).mean() < 0.08


def test_held_out_accuracy(spark):
    sf = "/root/testdata/sf0.1"
    docs, labels = table(spark, sf, "documents"), table(spark, sf, "labels")
    got = qc.classify(docs, labels, remainder(F.col("doc_id"), 5) != 0)
    assert got.count() == docs.count()
    rows = got.where("held_out").join(labels, "doc_id").collect()
    assert sum(r.predicted == r.quality for r in rows) / len(rows) > 0.97
    clean = [r for r in rows if r.quality == 1]
    assert sum(r.predicted for r in clean) / len(clean) > 0.99
    assert all(0 <= r.score <= 1 for r in rows)


def test_classifier_learns_from_training_rows_only(spark):
    rows = [(i, good(i) if i % 2 else good(i) + " ###" * 50, "en", "s") for i in range(400)]
    labels = spark.createDataFrame([(i, i % 2) for i in range(400)] + [(None, 1), (3, None)], "doc_id long, quality int")
    learn = F.col("doc_id") < 200
    turned = labels.withColumn("quality", F.when(F.col("doc_id") < 200, F.col("quality")).otherwise(1 - F.col("quality")))
    a = {r.doc_id: (r.score, r.predicted) for r in qc.classify(documents(spark, rows, clashing=True), labels, learn).collect()}
    b = {r.doc_id: (r.score, r.predicted) for r in qc.classify(documents(spark, rows), turned, learn).collect()}
    assert a.keys() == b.keys() and all(a[k] == pytest.approx(b[k]) for k in a)
    assert sum(a[i][1] == i % 2 for i in range(200, 400)) > 190


def test_classifier_without_labels_or_rows(spark):
    labels = spark.createDataFrame([], "doc_id long, quality int")
    got = qc.classify(documents(spark, ODD), labels, F.lit(True)).collect()
    assert len(got) == len(ODD) and all(r.score == 0.5 and r.predicted == 1 for r in got)
    assert qc.classify(documents(spark, []), labels, F.lit(True)).count() == 0
    assert qc.keep(documents(spark, ODD, clashing=True), labels, F.lit(True)).count() == len(ODD)
