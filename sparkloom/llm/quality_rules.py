"""Quality rules with verdicts of hosts: DataFrame operations only.

Each document is held against fixed rules. Failures are summed by host, and each host's failure rates are shrunk towards
all hosts' by a beta prior that is itself fitted to the hosts (by moments). A host's verdicts then go back to its
documents: a soft rule counts where the host's shrunk rate shows that its failures are real, and a host that mostly
fails loses all its documents.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import Scratch, scratch, small, words

#: Fixed by the contract.
MIN_WORDS, MAX_REPEAT_PERCENT, SYMBOLS = 50, 50, "[#*$%&|<>]"

#: Soft rules: symbols over words, repeated lines over words, both in percent.
MAX_SYMBOL_PERCENT, MAX_DUP_LINE_PERCENT = 20, 10

#: Shrunk rates from which a soft rule counts at a host, and from which a host is rejected.
SOFT_RATE, HOST_RATE = 0.005, 0.9

METRICS = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words"]


def _once(value: Column, use) -> Column:
    """use(value), with value worked out once however often use refers to it."""
    return F.transform(F.array(value), use)[0]


def _repeat_words(w: Column) -> Column:
    """Words that lie in a 3-word window found twice or more. Windows are compared by 64-bit hash, which takes two different
    ones of a text of a million words for equal in one text of 30 million; only if some are equal they are sorted with their positions, those with an equal neighbour are taken, and the length of the union of [p, p + 3)
    over their positions is added up."""

    def hashes(n: Column) -> Column:
        two = F.zip_with(F.slice(w, 1, n - 2), F.slice(w, 2, n - 2), lambda a, b: F.xxhash64(a, b))
        return F.zip_with(two, F.slice(w, 3, n - 2), lambda a, b: F.xxhash64(a, b))

    def positions(h: Column) -> Column:
        keyed = F.sort_array(F.transform(h, lambda x, i: F.struct(x.alias("h"), i.alias("p"))))
        return _once(keyed, lambda k: F.zip_with(F.slice(k, 1, F.size(k) - 1), F.slice(k, 2, F.size(k) - 1), lambda a, b: F.when(a.h == b.h, F.array(a.p, b.p))))

    def length(p: Column) -> Column:
        gaps = F.zip_with(F.slice(p, 2, F.size(p) - 1), F.slice(p, 1, F.size(p) - 1), lambda b, a: F.least(b - a, F.lit(3)))
        return F.aggregate(gaps, F.lit(3), lambda x, y: x + y)

    def covered(h: Column) -> Column:
        pairs = F.flatten(F.filter(positions(h), lambda s: s.isNotNull()))
        return F.when(F.size(F.array_distinct(h)) == F.size(h), 0).otherwise(_once(F.sort_array(F.array_distinct(pairs)), length))

    return F.when(F.size(w) < 4, 0).otherwise(_once(_once(F.size(w), hashes), covered)).cast("long")


def metrics(text: Column) -> Column:
    """The five measures of a text as a struct; all 0 of a null or empty one."""
    t = F.coalesce(text, F.lit(""))
    lines = F.filter(F.split(t, "\n"), lambda line: line.rlike(r"[^\x20\x09-\x0D]"))

    def of(w: Column) -> Column:
        return F.struct(
            F.size(w).cast("long").alias("n_words"),
            F.length(F.array_join(w, "")).cast("long").alias("word_chars"),
            F.regexp_count(t, F.lit(SYMBOLS)).cast("long").alias("n_symbols"),
            _once(lines, lambda x: F.size(x) - F.size(F.array_distinct(x))).cast("long").alias("n_dup_lines"),
            _repeat_words(w).alias("n_repeat_words"),
        )

    return _once(words(text), of)


def failures(m: Column, min_words: int = MIN_WORDS) -> dict[str, Column]:
    """The rules that measures break."""
    return {
        "base_failed": (m.n_words < min_words) | (100 * m.n_repeat_words > MAX_REPEAT_PERCENT * m.n_words),
        "fail_symbols": 100 * m.n_symbols > MAX_SYMBOL_PERCENT * m.n_words,
        "fail_lines": 100 * m.n_dup_lines > MAX_DUP_LINE_PERCENT * m.n_words,
    }


def measured(docs: DataFrame, text: str = "text", min_words: int = MIN_WORDS) -> DataFrame:
    """Adds a struct `m` of the measures and the rules' failures."""

    def all_of(m: Column) -> Column:
        return F.struct(*[m[k].alias(k) for k in METRICS], *[c.alias(k) for k, c in failures(m, min_words).items()])

    return docs.withColumn("m", _once(metrics(F.col(text)), all_of))


RULES = ["base_failed", "fail_symbols", "fail_lines", "any_failed"]


def counted(rows: DataFrame, host: str) -> DataFrame:
    """rows: host and m. Documents and failures by rule of each non-null host."""
    any_failed = F.col("m.base_failed") | F.col("m.fail_symbols") | F.col("m.fail_lines")
    failed = [*[F.col(f"m.{r}") for r in RULES[:-1]], any_failed]
    flags = [F.sum(f.cast("long")).alias(r) for r, f in zip(RULES, failed, strict=True)]
    return rows.where(F.col(host).isNotNull()).groupBy(host).agg(F.count("*").alias("n_docs"), *flags)


def shrunk(by_host: DataFrame) -> DataFrame:
    """Adds each rule's shrunk rate to a stored counted().

    The prior of each rule is a beta distribution, fitted to the hosts by moments. Its mean is the share of all documents
    that fail. How far the hosts' rates lie from it is due to their own differences and to sampling; the latter, which
    is known from their sizes, is taken off, and what is left gives the prior's weight in documents. Where nothing is
    left, or there is one host only, hosts do not differ, and the weight is that of all documents; it is 1 at least.
    """
    n = F.col("n_docs").cast("double")
    sums = [F.count("*").alias("hosts"), F.sum(n).alias("docs"), F.sum(n * n).alias("squares")]
    for r in RULES:
        sums += [F.sum(r).alias(f"failed_{r}"), F.sum(F.col(r) * F.col(r) / n).alias(f"spread_{r}")]
    all_ = by_host.agg(*sums).first()  # one row

    def rate(r: str) -> Column:
        docs, hosts, failed = all_["docs"] or 0.0, all_["hosts"], all_[f"failed_{r}"] or 0
        mean = failed / docs if docs else 0.0
        weight = docs
        if 0 < mean < 1 and hosts > 1:
            own = (all_[f"spread_{r}"] - docs * mean * mean) / (mean * (1 - mean)) - (hosts - 1)
            likeness = own / (docs - all_["squares"] / docs - (hosts - 1)) if docs > hosts else 0.0
            if likeness > 0:
                weight = max(1.0, 1 / likeness - 1)
        return (F.col(r) + F.lit(weight * mean)) / (F.col("n_docs") + F.lit(weight))

    return by_host.withColumns({f"rate_{r}": rate(r) for r in RULES})


def _with_verdicts(rows: DataFrame, by_host: DataFrame, host: str) -> DataFrame:
    """Adds the host's verdicts: reject, and whether each soft rule counts. A row without a host has only its own rules:
    any failure rejects it."""
    verdicts = by_host.select(
        F.col(host).alias("_host"),
        (F.col("rate_any_failed") >= HOST_RATE).alias("reject"),
        (F.col("rate_fail_symbols") >= SOFT_RATE).alias("symbols"),
        (F.col("rate_fail_lines") >= SOFT_RATE).alias("lines"),
    )
    out = rows.join(verdicts, F.col(host) == F.col("_host"), "left").drop("_host")
    return out.withColumns({"reject": F.coalesce("reject", F.lit(False)), "symbols": F.coalesce("symbols", F.lit(True)), "lines": F.coalesce("lines", F.lit(True))})


def _kept(m: Column) -> Column:
    soft = (m.fail_symbols & F.col("symbols")) | (m.fail_lines & F.col("lines"))
    return ~m.base_failed & ~soft & ~F.col("reject")


def judge(docs: DataFrame, host: str = "source", text: str = "text", key: str = "doc_id", min_words: int = MIN_WORDS) -> DataFrame:
    """Per row: key, host, the five measures, base_failed, fail_symbols, fail_lines and kept.

    Null and empty texts have no words and fail; words are taken from whole texts, in the row, so a long text costs its
    own length. Rows with a null host are judged by their own rules alone. Repeated rows are judged, and counted, each.
    An empty table gives no rows. Other columns are left out, whatever their names. The measures are stored (without
    texts) between the two passes, in the shared folder; hosts are as many as there are, so they are broadcast only
    where counted to be few.
    """
    keyed = docs.select(F.col(key).alias("key"), F.col(host).alias("host"), F.col(text).alias("text"))
    with scratch(docs.sparkSession) as s:
        rows = s.stored(measured(keyed, min_words=min_words).drop("text"), "measured")
        by_host = s.stored(counted(rows, "host"), "hosts")
        out = _with_verdicts(rows, small(shrunk(by_host), by_host.count()), "host")
        out = out.select(F.col("key").alias("_key"), F.col("host").alias("_host"), "m.*", _kept(F.col("m")).alias("kept"))
        return Scratch(docs.sparkSession).stored(out.withColumnsRenamed({"_key": key, "_host": host}), "judged")


def keep(docs: DataFrame, host: str = "source", text: str = "text", min_words: int = MIN_WORDS) -> DataFrame:
    """The documents that are kept, with their own columns.

    Texts are measured once and stored beside their measures; hosts' verdicts are joined to that. Null and empty texts
    go, rows that repeat are judged each, a null host has no verdict, and an empty table stays empty.
    """
    tables = Scratch(docs.sparkSession)
    packed = docs.select(F.struct(*[docs[f"`{c}`"] for c in docs.columns]).alias("row"), F.col(host).alias("host"), F.col(text).alias("text"))
    rows = tables.stored(measured(packed, min_words=min_words).drop("text"), "measured")
    by_host = tables.stored(counted(rows, "host"), "hosts")
    return _with_verdicts(rows, small(shrunk(by_host), by_host.count()), "host").where(_kept(F.col("m"))).select("row.*")
