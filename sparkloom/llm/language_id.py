"""Language identification with language-bitmask n-gram filters.

For each language, the character n-grams that are common in its training documents go into one bit-sliced Bloom filter:
a slot holds a bit for each language, in as many words of 64 as that takes, so that ANDing an n-gram's slots returns all
the languages that contain it. A text's n-grams are counted by language; the counts are corrected for the filter's false positives, and the language
with the largest corrected share decides.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from functools import cache

import numpy as np
import pandas as pd
from pyspark import Broadcast
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import mixed, scratch, tidied

#: Characters of an n-gram; the share of a language's documents that must hold it; bits a slot's share of set ones
#: aims at 1 in 8; probes. With a share of 1/100, a language has at most 100 times a document's n-grams.
N, SHARE, PROBES = 3, 0.01, 3

#: Characters that are worked on at once, so that a very long text needs bounded memory.
CHUNK = 1 << 20


@cache
def _letters() -> np.ndarray:
    """Per code point, its lower-case letter, or 0 for what is no letter."""
    out = np.zeros(0x110000, np.uint32)
    for c in range(0x110000):
        s = chr(c)
        if s.isalpha():
            low = s.lower()
            out[c] = ord(low) if len(low) == 1 else c
    return out


def grams(text: str | None) -> Iterator[np.ndarray]:
    """A text's n-grams of letters, words bounded by a blank, as integers, in pieces of CHUNK characters; none without letters."""
    text = text or ""
    for at in range(0, len(text), CHUNK):
        part = text[max(0, at - N + 1) : at + CHUNK]
        codes = _letters()[np.frombuffer(part.encode("utf-32-le", "surrogatepass"), np.uint32)].astype(np.uint64)
        if at == 0:
            codes = np.concatenate([np.zeros(1, np.uint64), codes])
        if at + CHUNK >= len(text):
            codes = np.concatenate([codes, np.zeros(1, np.uint64)])
        blank = codes == 0
        codes = codes[~(blank & np.concatenate([[False], blank[:-1]]))]  # runs of blanks are one
        if len(codes) >= N:
            g = codes[: len(codes) - N + 1].copy()
            for i in range(1, N):
                g = g << np.uint64(21) | codes[i : len(codes) - N + 1 + i]
            yield g[codes[1 : len(codes) - N + 2] != 0]  # its middle is a letter


@dataclass(frozen=True)
class Model:
    languages: tuple[str, ...]
    slots: np.ndarray  # uint64: a power of two of slots, words of 64 languages each
    false_rate: np.ndarray  # by language

    def masks(self, g: np.ndarray) -> np.ndarray:
        """Of each n-gram, the languages that hold it: a row of words."""
        first, *more = _slots(g, len(self.slots))
        out = self.slots[first]
        for slot in more:
            out &= self.slots[slot]
        return out

    def predict(self, text: str | None) -> tuple[str, float]:
        """(language, score); ('und', 0) without letters or without learned languages. Of equal shares the first wins."""
        n, hits = 0, np.zeros(len(self.languages))
        for g in grams(text):
            n += len(g)
            if len(hits):
                hits += self.popcounts(self.masks(g))
        if not n or not len(hits):
            return "und", 0.0
        share = np.maximum(0.0, (hits / n - self.false_rate) / (1 - self.false_rate))
        best = int(share.argmax())
        return self.languages[best], float(share[best] / share.sum()) if share.sum() > 0 else 0.0

    def popcounts(self, masks: np.ndarray) -> np.ndarray:
        """How many masks have each language's bit."""
        if len(self.languages) <= 12:
            seen = np.bincount(masks[:, 0].astype(np.int64), minlength=1 << len(self.languages))
            every = np.arange(len(seen))
            return np.array([seen[(every >> i & 1) == 1].sum() for i in range(len(self.languages))])
        return np.array([np.count_nonzero(masks[:, i >> 6] >> np.uint64(i & 63) & np.uint64(1)) for i in range(len(self.languages))])


def _slots(g: np.ndarray, size: int) -> list[np.ndarray]:
    h = mixed(g.copy())
    step = (h >> np.uint64(32)) | np.uint64(1)
    return [((h + np.uint64(i) * step) & np.uint64(size - 1)).astype(np.int64) for i in range(PROBES)]


def fit(docs: DataFrame, text: str = "text", lang: str = "lang", share: float = SHARE) -> Model:
    """Learns from rows with a language; empty without such rows.

    The n-grams' document counts are summed over all rows: per task first, then by a shuffle. What goes to the driver is
    bounded by the languages and the share, not by the rows: of a language, as many n-grams at most as its mean document
    has, divided by the share. A slot's bit of a language is set in one of eight slots at most.
    """

    @tidied
    def counted(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        held: dict[str, list[np.ndarray]] = {}
        size = 0

        def summed() -> pd.DataFrame:
            parts = []
            for name, lists in held.items():
                g, n = np.unique(np.concatenate(lists), return_counts=True)
                parts.append(pd.DataFrame({"lang": name, "gram": g.astype(np.int64), "n": n.astype(np.int64)}))
            held.clear()
            return pd.concat(parts) if parts else pd.DataFrame({"lang": [], "gram": [], "n": []})

        for batch in batches:
            for name, t in zip(batch["lang"], batch["text"], strict=True):
                own = [np.unique(g) for g in grams(t)]
                g = np.unique(np.concatenate([np.zeros(1, np.uint64), *own]))  # 0 counts the document itself
                held.setdefault(name, []).append(g)
                size += len(g)
                if size > 4_000_000:
                    yield summed()
                    size = 0
        if held:
            yield summed()

    rows = docs.select(F.col(lang).alias("lang"), F.col(text).alias("text")).where("lang is not null")
    with scratch(docs.sparkSession) as s:
        counts = rows.mapInPandas(counted, "lang string, gram long, n long").groupBy("lang", "gram").agg(F.sum("n").alias("n"))
        counts = s.stored(counts, "counts")
        total = counts.where("gram = 0").select("lang", F.col("n").alias("docs"))
        names = tuple(sorted(r.lang for r in total.select("lang").collect()))
        common = counts.where("gram <> 0").join(F.broadcast(total), "lang")  # total: a row for each language
        kept = common.where(F.col("n") >= F.lit(share) * F.col("docs")).select("lang", "gram").toPandas()
    own = {name: g.to_numpy(np.int64).view(np.uint64) for name, g in kept.groupby("lang")["gram"]}
    size = 1 << max(10, (max(map(len, own.values()), default=0) * PROBES * 8 - 1).bit_length())
    slots = np.zeros((size, -(-len(names) // 64)), np.uint64)
    for i, name in enumerate(names):
        for at in _slots(own.get(name, np.zeros(0, np.uint64)), size):
            slots[at, i >> 6] |= np.uint64(1 << (i & 63))
    fill = np.array([float((slots[:, i >> 6] >> np.uint64(i & 63) & np.uint64(1)).mean()) for i in range(len(names))])
    return Model(names, slots, fill**PROBES)


def predicted(text: Column, model: Broadcast) -> Column:
    """A struct of lang_pred and score."""

    @F.pandas_udf("lang_pred string, score double")
    def run(texts: pd.Series) -> pd.DataFrame:
        return pd.DataFrame([model.value.predict(t) for t in texts], columns=["lang_pred", "score"])

    return run(text)


def identify(docs: DataFrame, train: Column, key: str = "doc_id", text: str = "text", lang: str = "lang", share: float = SHARE) -> DataFrame:
    """Per row: key, held_out (not train), lang_pred, score.

    Learns from the rows for which train holds and lang is not null. Null texts and those without a letter are 'und';
    so is all where nothing was learned. Texts are taken whole, in pieces of CHUNK characters. Repeated rows count, and
    are judged, each; of languages with equal shares the first by name wins; empty tables give no rows; other columns
    are left out.
    """
    model = docs.sparkSession.sparkContext.broadcast(fit(docs.where(train), text, lang, share))
    rows = docs.select(F.col(key).alias(key), (~train).alias("held_out"), predicted(F.col(text), model).alias("_p"))
    return rows.select(key, "held_out", "_p.*")
