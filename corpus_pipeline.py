"""A cleaning pipeline over documents: each stage reads what the one before it kept.

Stages take rows as their operators do: each repeated row is a row, except that deduplication keeps one of a doc_id; of
an empty table nothing is left; columns beyond those of documents stay until the last stage, whatever their names.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sparkloom.llm import bpe, jaccard_join, mixing, quality_classifier, quality_rules
from sparkloom.llm.common import Scratch, passing, remainder
from sparkloom.session import shipped
from sparkloom.sources.tables import table


#: Words that a document needs.
MIN_WORDS = 10


@shipped
def classify(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality classifier rejects go. It learns from the labelled ones among its input; without labels
    all stay."""
    return quality_classifier.keep(docs, table(spark, sf_dir, "labels"), remainder(F.col("doc_id"), 5) != 0)


@shipped
def apply_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality rules or their hosts' verdicts reject go. Short documents are none to reject here, as
    the classifier has kept them for their quality, unless they have hardly a sentence."""
    return quality_rules.keep(docs, min_words=MIN_WORDS)


@shipped
def deduplicate(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of copies and near copies (five-word shingles, 0.8) stays: that with the least doc_id.
    Documents without words or without a doc_id have no copies."""
    return jaccard_join.deduplicated(docs, n=5, percent=80)


@shipped
def mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents as often as the mix takes them; those without words are not taken."""
    return mixing.sampled(docs)


@shipped
def encode(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token counts and digests of each document that is left; a null text is an empty one."""
    return bpe.digests(docs, public_tokenizers.path("byte_bpe_50k.json"))


STAGES = [
    ("quality classifier", classify),
    ("quality rules", apply_rules),
    ("n-gram Jaccard join", deduplicate),
    ("mixing sources to target weights", mix),
    ("BPE encoding and decoding", encode),
]

#: Training and sampling have no SQL. Tests hold each stage's result, and run()'s, against brute-force versions.
ORACLE_SQL = None


@shipped
def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The stages over documents, each written as Parquet in the shared folder and read again. What a stage has read goes
    once its own result is written."""
    docs, before = table(spark, sf_dir, "documents"), None
    for i, (_, stage) in enumerate(STAGES):
        made = Scratch(spark)
        with passing(spark):
            docs = made.stored(stage(spark, docs, sf_dir), f"stage{i}")
        if before is not None:
            before.gone()
        before = made
    return docs
