"""Plain versions of what the operators return."""

import re
from collections import Counter

WORD = re.compile(r"[^\x20\x09-\x0D]+")
LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"

#: Names that operators use within, or return.
CLASHING = ["key", "host", "kept", "score", "size", "copies", "taken", "row", "_k", "n", "x", "rep", "media", "n_words", "component_id"]


def words(text):
    return WORD.findall(text or "")


def documents(spark, rows, clashing=False):
    """rows: (doc_id, text, lang, source)."""
    df = spark.createDataFrame([(*r, len(r[1] or "")) for r in rows], SCHEMA)
    if clashing:
        from pyspark.sql import functions as F

        df = df.withColumns({c: F.lit("other") for c in CLASHING})
    return df


def repeat_words(w):
    seen = Counter(zip(w, w[1:], w[2:]))
    return len({i + k for i in range(len(w) - 2) if seen[tuple(w[i : i + 3])] > 1 for k in range(3)})


def shingles(text, n):
    w = words((text or "").translate(LOWER))
    return frozenset(tuple(w[i : i + n]) for i in range(max(1, len(w) - n + 1))) if w else frozenset()


def components(rows, n, percent):
    """rows: (key, text). The least key of each key's component."""
    sets = [(k, shingles(t, n)) for k, t in rows]
    root = {k: k for k, _ in sets}

    def find(k):
        while root[k] != k:
            k = root[k]
        return k

    for i, (a, s) in enumerate(sets):
        for b, t in sets[:i]:
            if s and t and 100 * len(s & t) >= percent * len(s | t):
                lo, hi = sorted((find(a), find(b)))
                root[hi] = lo
    return {k: find(k) for k in root}
