"""The registry, and the pipeline against plain versions of its stages."""

import hashlib
import random
from collections import Counter
from pathlib import Path

import numpy as np
import public_tokenizers
import pytest
from pyspark.sql import functions as F
from tokenizers import Tokenizer

import __spark_entry__ as entry
import corpus_pipeline
from sparkloom.llm import queries
from sparkloom.llm.common import remainder, spread
from sparkloom.sources.tables import table

from .helpers import components, documents, shingles, words
from .test_mixing import plain_mix
from .test_rules_and_classifier import good, plain_scores, plain_verdicts


def test_registry():
    found = entry.queries()
    for n in range(1, 11):
        assert sum(name.startswith(f"op{n}_") for name in found) == 1
    assert "pipeline" in found and set(queries.ORACLE) <= set(found)
    assert len(corpus_pipeline.STAGES) == 5 and corpus_pipeline.ORACLE_SQL is None


@pytest.mark.parametrize("name", sorted(queries.QUERIES))
def test_whole_tables(spark, sf, name):
    kind = "pages" if name in ("op4_url_filter", "op5_warc") else "documents"
    key = "page_id" if kind == "pages" else "doc_id"
    got = sorted(r[0] for r in entry.queries()[name](spark, sf).select(key).collect())
    assert got == sorted(r[0] for r in table(spark, sf, kind).select(key).collect())


@pytest.fixture(scope="module")
def folder(spark, tmp_path_factory):
    """Clean documents, junk, copies and near copies, with labels for some."""
    rng = random.Random(6)
    rows = [(i, good(i), "en", f"s{i % 3}") for i in range(300)]
    rows += [(1000 + i, good(1000 + i) + " ###" * 60, "en", f"s{i % 3}") for i in range(60)]
    rows += [(2000 + i, good(i), "en", "s0") for i in range(30)]  # copies
    for i in range(30):  # near copies: a word of 80 differs
        w = good(100 + i).split()
        w[rng.randrange(80)] = "changed"
        rows.append((3000 + i, " ".join(w), "en", "s1"))
    rows += [(4000, "too short", "en", "s0"), (4001, None, None, None)]
    path = str(tmp_path_factory.mktemp("data"))
    documents(spark, rows).write.parquet(f"{path}/documents.parquet")
    labels = [(k, 0 if 1000 <= k < 2000 else 1) for k, *_ in rows if k % 2 and k < 2000]
    spark.createDataFrame(labels, "doc_id long, quality int").write.parquet(f"{path}/labels.parquet")
    return path, rows


def test_stages_take_effect(spark, folder):
    path, rows = folder
    docs, kept = spark.read.parquet(f"{path}/documents.parquet"), []
    for _, stage in corpus_pipeline.STAGES[:-1]:
        docs = stage(spark, docs, path)
        assert docs.columns == ["doc_id", "text", "lang", "source", "n_chars"]
        kept.append(Counter(r.doc_id for r in docs.collect()))
    clean = {k for k, *_ in rows if not 1000 <= k < 2000 and k < 4000}
    assert clean <= set(kept[0]) and not any(1000 <= k < 2000 for k in kept[0])
    assert set(kept[1]) == clean  # without "too short" and the empty one
    texts = {k: t for k, t, _, _ in rows}
    near = lambda a, b: 100 * len(a & b) >= 80 * len(a | b)
    want = set(range(300)) | {k for k in range(3000, 3030) if not near(shingles(texts[k], 5), shingles(texts[100 + k - 3000], 5))}
    assert set(kept[2]) == want
    assert set(kept[3]) <= want and max(kept[3].values()) == 2


def test_run(spark, folder):
    path, rows = folder
    got, again = (Counter(map(tuple, corpus_pipeline.run(spark, path).collect())) for _ in range(2))
    assert got == again and sum(got.values()) > 300
    texts = {k: t for k, t, _, _ in rows}
    size = sum(n * len(words(texts[k])) for (k, *_), n in got.items())
    left = sum(len(words(texts[k])) for k in {k for k, *_ in rows if k < 300})
    assert 1.3 < size / left < 1.7


def test_run_equals_plain_versions(spark, folder, tmp_path):
    """run()'s whole rows against each stage's plain version, one after the other, over all documents."""
    path, rows = folder
    kept = {k: (t, s) for k, t, _, s in rows}
    labels = {r.doc_id: r.quality for r in spark.read.parquet(f"{path}/labels.parquet").collect()}
    scores = plain_scores(spark.read.parquet(f"{path}/documents.parquet"), labels, remainder(F.col("doc_id"), 5) != 0)
    kept = {k: v for k, v in kept.items() if scores[k] >= 0.3}
    verdicts, _ = plain_verdicts([(k, t, s) for k, (t, s) in kept.items()], corpus_pipeline.MIN_WORDS)
    kept = {k: v for k, v in kept.items() if verdicts[k]}
    least = components([(k, t) for k, (t, _) in kept.items()], 5, 80)
    kept = {k: v for k, v in kept.items() if least[k] == k}
    library, want = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json")), Counter()
    for k, copies in plain_mix(spark, documents(spark, [(k, t, "en", s) for k, (t, s) in kept.items()])):
        ids = library.encode(kept[k][0] or "", add_special_tokens=False).ids
        back = library.decode(ids, skip_special_tokens=False)
        if copies:
            want[k, len(ids), hashlib.sha256(np.array(ids, "<u4").tobytes()).hexdigest(), hashlib.sha256(back.encode()).hexdigest()] += copies
    assert Counter(map(tuple, corpus_pipeline.run(spark, path).collect())) == want and len(want) > 200


def test_run_leaves_only_its_result(spark, folder):
    from sparkloom.llm.common import shared_dir

    shared = Path(shared_dir(spark).removeprefix("file:"))
    before = set(shared.iterdir())
    out = corpus_pipeline.run(spark, folder[0])
    made = set(shared.iterdir()) - before
    assert len(made) == 1 and out.count() > 0


def test_run_of_no_documents(spark, tmp_path):
    documents(spark, []).write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([], "doc_id long, quality int").write.parquet(f"{tmp_path}/labels.parquet")
    assert corpus_pipeline.run(spark, str(tmp_path)).count() == 0


def test_held_out_shares(spark, sf):
    for name, parts, at in (("op2_quality_classifier", 5, 0), ("op6_language_id", 4, 2), ("op10_lm_score", 7, 2)):
        rows = entry.queries()[name](spark, sf)
        assert rows.where(F.col("held_out") != (F.crc32(F.col("doc_id").cast("string")) % parts == at)).count() == 0


def test_tables_of_few_files_are_spread(spark, tmp_path):
    cores = spark.sparkContext.defaultParallelism
    rows = [(i, None if i % 5 == 0 else "a b" * (i % 7), None, f"s{i % 3}") for i in range(200)]
    for files in (1, cores):
        documents(spark, rows).repartition(files).write.parquet(f"{tmp_path}/{files}")
    one, many = spark.read.parquet(f"{tmp_path}/1"), spark.read.parquet(f"{tmp_path}/{cores}")
    tasks = [df.select(F.spark_partition_id().alias("t")).distinct().count() for df in (one, spread(one))]
    assert tasks[0] == 1 and tasks[1] >= cores
    assert spread(many) is many
    assert sorted(map(str, spread(one).collect())) == sorted(map(str, one.collect()))
    assert spread(one.where("false")).count() == 0
