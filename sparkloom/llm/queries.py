"""One query for each operator, over its whole table, with DuckDB SQL where SQL can express it."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sparkloom.session import shipped
from sparkloom.sources.tables import table

from . import bpe, jaccard_join, language_id, lm_score, media, mixing, oracle, quality_classifier, quality_rules, url_filter, warc
from .common import remainder, spread

#: Fixed by the contract: verdicts by host and path.
URL_RULES = [
    ("block", "com/en/"),
    ("allow", "example.com/en/7"),
    ("block", "net/de/"),
    ("block", "example.net/de/8"),
    ("block", "org/es/"),
]


def _documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    """For queries whose work on a text outweighs dealing it out."""
    return spread(table(spark, sf_dir, "documents"))


def op1_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality_rules.judge(_documents(spark, sf_dir)).drop("source")


def op2_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, labels = table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels")
    return quality_classifier.classify(docs, labels, remainder(F.col("doc_id"), 5) != 0)


def op3_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.mix(table(spark, sf_dir, "documents")).drop("source")


def op4_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = table(spark, sf_dir, "pages")
    return url_filter.judge(pages.select("page_id", "url"), URL_RULES, url_filter.copying(pages)).select("page_id", "host", "path", "rule", "verdict")


def _op4_sql() -> str:
    by_length = sorted(URL_RULES, key=lambda r: -len(r[1]))
    fits = [(f"(host = '{h}' or host like '%.{h}') and starts_with(path, '/{p}')", v, r) for v, r in by_length for h, _, p in [r.partition("/")]]
    return f"""
        with parts as (
            select page_id, html,
                translate(regexp_extract(coalesce(url, ''), '^.*?://([^/?#]*)', 1, 's'), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') as host,
                regexp_extract(coalesce(url, ''), '^.*?://[^/?#]*([^?#]*)', 1, 's') as path
            from pages),
        served as (select html, host || path as k, max(page_id) as n from parts where html <> '' and host <> '' group by 1, 2),
        last as (select html, arg_max(k, n) as k from served group by html),
        listed as (select distinct s.k from served s join last l on s.html = l.html where s.k <> l.k)
        select page_id, host, path,
            case {' '.join(f"when {f} then '{r}'" for f, _, r in fits)} end as rule,
            case {' '.join(f"when {f} then '{v}'" for f, v, _ in fits)}
                when host <> '' and host || path in (select k from listed) then 'block' else 'allow' end as verdict
        from parts"""


def op5_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = table(spark, sf_dir, "pages")
    second = F.pmod(F.coalesce("page_id", F.lit(0)), F.lit(86_400))  # pages have no date and no address, so these are made up
    clock = [F.lpad(F.floor(second / n % m).cast("string"), 2, "0") for n, m in ((3600, 24), (60, 60), (1, 60))]
    ip = F.concat_ws(".", F.lit("10"), *[F.floor(second / n % 256).cast("string") for n in (65_536, 256, 1)])
    return warc.round_trip(pages, date=F.concat(F.lit("20260101"), *clock), ip=ip)


def op6_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    return language_id.identify(_documents(spark, sf_dir), remainder(F.col("doc_id"), 4) != 2)


def op7_media(spark: SparkSession, sf_dir: str) -> DataFrame:
    return media.digests(_documents(spark, sf_dir))


def op8_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bpe.digests(_documents(spark, sf_dir), public_tokenizers.path("byte_bpe_50k.json"))


def op9_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jaccard_join.join(_documents(spark, sf_dir))


def op10_lm_score(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lm_score.score(_documents(spark, sf_dir), remainder(F.col("doc_id"), 7) != 2)


QUERIES = {
    name: shipped(query)
    for name, query in {
        "op1_quality_rules": op1_quality_rules,
        "op2_quality_classifier": op2_quality_classifier,
        "op3_mixing": op3_mixing,
        "op4_url_filter": op4_url_filter,
        "op5_warc": op5_warc,
        "op6_language_id": op6_language_id,
        "op7_media": op7_media,
        "op8_bpe": op8_bpe,
        "op9_jaccard_join": op9_jaccard_join,
        "op10_lm_score": op10_lm_score,
    }.items()
}
ORACLE = {
    "op1_quality_rules": oracle.quality(),
    "op4_url_filter": _op4_sql(),
    "op5_warc": oracle.archives(),
    "op9_jaccard_join": oracle.near_copies(),
}
