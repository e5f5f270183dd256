"""Language-model scoring with a weighted backoff automaton over exact corpus counts.

Documents are read once, into packs: some megabytes of text become a list of the pack's different words (as 64-bit hashes)
and the documents' tokens as places in that list. Packs are stored in buckets and stay where they are. What is shuffled
are a pack's different words and n-grams with their counts, dealt by ranges of their hashes; each range sums them over
all packs and answers every pack for its own ones, however rare.

The automaton's states are the n-grams seen LEAST times, from words (and the start of a text) up to one word less than
its order; and the root. An arc leads from a state over a token that followed it LEAST times, to the state of the n-gram
that it completes; it weighs (c - DISCOUNT) / c(state) and, beside that, the token's probability behind the failure arc.
The failure arc leads to the state of the n-gram without its first word and weighs what the discounts and the tokens
without an arc leave; the root takes any token with its smoothed share, the same as in the base score. So after any
history the probabilities add up to 1. A text is traversed once from left to right.

LEAST is the same at every size, so states and arcs grow with the corpus; they are nowhere in one place. A range knows
its n-grams' counts, but not their states, as it has hashes only. So of the packs that hold an n-gram one is told to
account for it, and sums such arcs by state; the ranges add these sums up in a second round, in which a state goes by
its number in its range instead of its hash. What is shuffled is in proportion to the input: each different n-gram of
each pack, once, in some four bytes, and its answer.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass, replace

import numpy as np
import pandas as pd
import zstandard
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import Scratch, give_back, lowered, mixed, scratch, tidied, word_hashes

#: The longest n-gram; the least count of a state or an arc; the discount of an arc's count; bytes of text in a pack.
ORDER, LEAST, DISCOUNT, PACK = 3, 2, 0.5, 8 << 20

#: Tokens of all packs for each range of keys; twice as many at most.
RANGE = 2 << 20

#: An n-gram's hash has this many bits more than it takes to count all tokens.
SPARE_BITS = 20

_STEP, _END, _START = np.uint64(0x9E3779B97F4A7C15), np.uint64(0x6A09E667F3BCC909), np.uint64(0xBB67AE8584CAA73B)


def _squeezed(values: np.ndarray) -> bytes:
    """8-byte values, byte plane by byte plane."""
    planes = np.ascontiguousarray(np.ascontiguousarray(values).view(np.uint8).reshape(-1, 8).T)
    return zstandard.ZstdCompressor(1).compress(planes.tobytes())


def _unsqueezed(data: bytes, kind: type = np.int64) -> np.ndarray:
    planes = np.frombuffer(zstandard.ZstdDecompressor().decompress(data), np.uint8)
    return np.ascontiguousarray(planes.reshape(8, -1).T).view(kind).reshape(-1)


def _steps(keys: np.ndarray) -> bytes:
    """Rising keys by their differences."""
    return _squeezed(np.diff(keys, prepend=keys.dtype.type(0)))


def _keys(data: bytes, kind: type) -> np.ndarray:
    return np.cumsum(_unsqueezed(data, kind), dtype=kind)


# --- packs ------------------------------------------------------------------------------------------

_PACK = "pack long, keys array<string>, words binary, uses binary, counts binary, trains binary, lengths binary, tokens binary"


def _made(pack: int, keys: list, trains: list, hashes: list[np.ndarray]) -> pd.DataFrame:
    lengths, trains = np.array([len(h) for h in hashes], np.int64), np.array(trains, bool)
    every = np.concatenate([np.concatenate([h, [_END]]) for h in hashes] + [np.array([_START])])
    words, place, uses = np.unique(every, return_inverse=True, return_counts=True)
    place = place.reshape(-1)[:-1]  # the start is no token
    rank = np.empty(len(words), np.uint32)
    rank[np.argsort(-uses, kind="stable")] = np.arange(len(words), dtype=np.uint32)
    counts = np.bincount(place[np.repeat(trains, lengths + 1)], minlength=len(words))
    counts[np.searchsorted(words, _START)] = trains.sum()
    planes = np.ascontiguousarray(rank[place].view(np.uint8).reshape(-1, 4).T)
    row = {
        "pack": pack, "keys": keys, "words": _steps(words), "uses": _squeezed(uses.astype(np.int64)), "counts": _squeezed(counts.astype(np.int64)),
        "trains": trains.tobytes(), "lengths": _squeezed(lengths + 1), "tokens": zstandard.ZstdCompressor(1).compress(planes.tobytes()),
    }
    return pd.DataFrame({k: [v] for k, v in row.items()})


def _packed(docs: DataFrame) -> DataFrame:
    """docs: key string, train boolean, text. A row for each pack: its number; its documents' keys, whether they train and
    their tokens, an end included; its different words with the end and the start, sorted, their uses in it and of these
    the ones in training; and all tokens, as the places of words by falling use."""

    @tidied
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        pack, size, keys, trains, hashes = TaskContext.get().partitionId() << 24, 0, [], [], []
        for batch in batches:
            for key, train, text in zip(batch["key"], batch["train"], batch["text"], strict=True):
                data = lowered(text)
                if hashes and size + len(data) > PACK:
                    yield _made(pack, keys, trains, hashes)
                    pack, size, keys, trains, hashes = pack + 1, 0, [], [], []
                size += len(data)
                keys.append(key)
                trains.append(bool(train))
                hashes.append(word_hashes(data))
        if hashes:
            yield _made(pack, keys, trains, hashes)

    return docs.mapInPandas(run, _PACK)


class Pack:
    """A pack's row, read."""

    def __init__(self, row):
        self.words = _keys(row.words, np.uint64)
        self.trains = np.frombuffer(row.trains, bool)
        self.lengths = _unsqueezed(row.lengths)
        self.starts = np.cumsum(self.lengths) - self.lengths
        by_use = np.argsort(-_unsqueezed(row.uses), kind="stable").astype(np.int32)
        planes = np.frombuffer(zstandard.ZstdDecompressor().decompress(row.tokens), np.uint8)
        self.word = by_use[np.ascontiguousarray(planes.reshape(4, -1).T).view(np.uint32).reshape(-1)]
        self.start = int(np.searchsorted(self.words, _START))


# --- asking and answering ---------------------------------------------------------------------------

_ASK = "kind string, part int, pack long, keys binary, values array<binary>"
_ANSWER = "kind string, part int, pack long, values array<binary>, types long, total long"
_ASK_NAMES = [c.split()[0] for c in _ASK.split(", ")]


@dataclass(frozen=True)
class Plan:
    """What all packs go by."""

    order: int
    ranges: int  # a power of two
    bits: int  # of an n-gram's hash
    tokens: int = 0  # in training
    types: int = 0

    def asks(self, pack: int, kind: str, keys: np.ndarray, values: np.ndarray, bits: int) -> Iterator[tuple]:
        """A row for each range that has any of a pack's rising keys."""
        part = (keys >> np.uint64(bits - self.ranges.bit_length())) >> np.uint64(1)
        cuts = [0, *(np.flatnonzero(part[1:] != part[:-1]) + 1).tolist(), len(keys)]
        for lo, hi in zip(cuts, cuts[1:], strict=False):
            if lo < hi:
                yield kind, int(part[lo]), pack, _steps(keys[lo:hi]), [_squeezed(values[lo:hi])]


def _answered(rows: pd.DataFrame) -> pd.DataFrame:
    """All packs' rows of one kind and range.

    n1, n2 ...: counts of words and n-grams are summed. Each pack gets, for each of its keys, twice the sum (0 of an n-gram
    that is no arc), and one more in the one pack that accounts for it; and the numbers of those seen LEAST times. The
    first row says how many keys were seen, and how often.
    f1, f2 ...: numbers of arcs and their counts are summed by state; each pack gets those of its states.
    """
    rows = rows.sort_values("pack")
    kind, part = rows["kind"].iloc[0], rows["part"].iloc[0]
    of = np.uint64 if kind[0] == "n" else np.int64
    keys = [_keys(k, of) for k in rows["keys"]]
    ends = np.cumsum([len(k) for k in keys])[:-1]
    values = [np.concatenate([_unsqueezed(v[i]) for v in rows["values"]]) for i in range(len(rows["values"].iloc[0]))]
    seen = total = 0
    if kind[0] == "n":
        _, first, place = np.unique(np.concatenate(keys), return_index=True, return_inverse=True)
        place = place.reshape(-1)
        sums = np.zeros(len(first), np.int64)
        np.add.at(sums, place, values[0])
        seen, total, often = int((sums > 0).sum()), int(sums.sum()), sums >= LEAST
        number = np.cumsum(often) - 1
        answer = 2 * (sums if kind == "n1" else np.where(often, sums, 0))[place]
        answer[first] += 1
        counts = np.split(answer, ends)
        numbers = [number[p[often[p]]] for p in np.split(place, ends)]
        out = [[_squeezed(a), _steps(n)] for a, n in zip(counts, numbers, strict=True)]
    else:
        state = np.concatenate(keys)
        sums = [np.bincount(state, v)[state].astype(np.int64) for v in values]
        out = [[_squeezed(v) for v in parts] for parts in zip(*(np.split(s, ends) for s in sums), strict=True)]
    first_row = np.arange(len(rows)) == 0
    return pd.DataFrame({"kind": kind, "part": part, "pack": rows["pack"].to_numpy(), "values": out, "types": first_row * seen, "total": first_row * total})


class Answers:
    """What a pack has been answered, by kind in the order of ranges."""

    def __init__(self, rows: pd.DataFrame):
        rows = rows.sort_values(["kind", "part"])
        self.of = {k: (list(x["part"]), list(x["values"])) for k, x in rows.groupby("kind")}

    def values(self, kind: str, i: int) -> np.ndarray:
        return np.concatenate([np.zeros(0, np.int64), *(_unsqueezed(v[i]) for v in self.of.get(kind, ((), ()))[1])])

    def numbers(self, kind: str) -> Iterator[tuple[int, np.ndarray]]:
        """(range, numbers of the states in it)."""
        for part, v in zip(*self.of.get(kind, ((), ())), strict=True):
            yield part, _keys(v[1], np.int64)


def _levels(pack: Pack, plan: Plan) -> Iterator[tuple[int, np.ndarray, np.ndarray, np.ndarray]]:
    """For each length from 2 up: (length, the number of the shorter n-gram before each token or -1, the sorted hashes of
    the pack's different n-grams, the number of the one that ends with each token or -1)."""
    keys, at = pack.words, pack.word
    for k in range(2, plan.order + 1):
        before = np.concatenate([np.array([-1], np.int32), at[:-1]])
        before[pack.starts] = pack.start if k == 2 else -1
        there = np.flatnonzero(before >= 0)
        keys, place = np.unique(mixed(keys[before[there]] * _STEP + pack.words[pack.word[there]]) >> np.uint64(64 - plan.bits), return_inverse=True)
        at = np.full(len(before), -1, np.int32)
        at[there] = place.reshape(-1)
        del there, place
        yield k, before, keys, at


def _counts_asked(row, plan: Plan) -> Iterator[tuple]:
    """A pack's words and n-grams with their counts in training."""
    pack = Pack(row)
    yield from plan.asks(row.pack, "n1", pack.words, _unsqueezed(row.counts), 64)
    trained = np.repeat(pack.trains, pack.lengths)
    for k, _, grams, at in _levels(pack, plan):
        counts = np.bincount(at[trained & (at >= 0)], minlength=len(grams)).astype(np.int64)
        yield from plan.asks(row.pack, f"n{k}", grams, counts, plan.bits)


def _counts(got: Answers, kind: str) -> tuple[np.ndarray, np.ndarray]:
    """Of each key, its count and whether this pack accounts for it."""
    n = got.values(kind, 0)
    return n >> 1, (n & 1) == 1


def _arcs_asked(row, got: Answers, plan: Plan) -> Iterator[tuple]:
    """A pack's states, with the number and the counts of those of their arcs that it accounts for."""
    pack = Pack(row)
    held, _ = _counts(got, "n1")
    for k, before, grams, at in _levels(pack, plan):
        n, mine = _counts(got, f"n{k}")
        mine &= n >= LEAST
        there = at >= 0
        behind = np.zeros(len(grams), np.int32)
        behind[at[there]] = before[there]  # the state before an n-gram is the same at all its places
        state = held >= LEAST
        arcs, counts = (np.bincount(behind[mine], w, len(held))[state].astype(np.int64) for w in (None, n[mine]))
        lo = 0
        for part, numbers in got.numbers(f"n{k - 1}"):
            hi = lo + len(numbers)
            if lo < hi:
                yield f"f{k - 1}", part, row.pack, _steps(numbers), [_squeezed(arcs[lo:hi]), _squeezed(counts[lo:hi])]
            lo = hi
        held = n


def _scored(row, got: Answers, plan: Plan) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The traversal, at all places of a pack at once: known tokens, base scores and scores of its documents."""
    pack = Pack(row)
    held, _ = _counts(got, "n1")
    known = np.add.reduceat((held > 0)[pack.word], pack.starts, dtype=np.int64)
    p = ((held + 1) / (plan.tokens + plan.types + 1))[pack.word]
    base = np.add.reduceat(np.log10(p), pack.starts)
    for k, before, _, at in _levels(pack, plan):
        n, _ = _counts(got, f"n{k}")
        state, left = held >= LEAST, np.ones(len(held) + 1)  # the last for no state, as of all that are no states
        left[:-1][state] = (held[state] - got.values(f"f{k - 1}", 1) + DISCOUNT * got.values(f"f{k - 1}", 0)) / held[state]
        p *= left[before]
        there = at >= 0
        there[there] = n[at[there]] >= LEAST
        p[there] += (n[at[there]] - DISCOUNT) / held[before[there]]
        held = n
    return known, base, np.add.reduceat(np.log10(p), pack.starts)


def score(docs: DataFrame, train: Column, key: str = "doc_id", text: str = "text") -> DataFrame:
    """Per row: key, held_out, n_tokens, n_known, train_tokens, base_score, score.

    Learns from the rows for which train holds (null: not). Null and empty texts have one token, the end. Without
    training rows nothing is known and both scores are 0. Repeated rows are learned from, and scored, each; ties score
    alike; an empty table gives no rows; other columns are left out. Texts are read once; they and their tokens are
    never shuffled, their different n-grams are. Words are told apart by hashes of 64 bits, n-grams by as many as make
    one in 2^SPARE_BITS meet another.
    """
    spark, order = docs.sparkSession, ORDER
    rows = docs.select(F.col(key).cast("string").alias("key"), F.coalesce(train, F.lit(False)).alias("train"), F.col(text).alias("text"))
    schema = "key string, held_out boolean, n_tokens long, n_known long, train_tokens long, base_score double, score double"
    names = [c.split()[0] for c in schema.split(", ")]
    buckets = min(100_000, max(int(spark.conf.get("spark.sql.shuffle.partitions")), 2 * rows.rdd.getNumPartitions()))
    with scratch(spark) as s:
        packs = s.bucketed(_packed(rows), "packs", "pack", buckets)

        def sizes(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            for batch in batches:
                for lengths, trains in zip(batch["lengths"], batch["trains"], strict=True):
                    yield pd.DataFrame({"tokens": [int(_unsqueezed(lengths).sum())], "ends": [int(np.frombuffer(trains, bool).sum())]})

        n_all, ends = packs.select("lengths", "trains").mapInPandas(sizes, "tokens long, ends long").agg(F.sum("tokens"), F.sum("ends")).first()
        n_all, ends = n_all or 0, ends or 0
        plan = Plan(order, 1 << max(0, (n_all // RANGE).bit_length() - 1), min(64, max(1, n_all).bit_length() + SPARE_BITS))

        def counts_asked(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            for batch in batches:
                for row in batch.itertuples(index=False):
                    yield pd.DataFrame(list(_counts_asked(row, plan)), columns=_ASK_NAMES)

        def answers_to(asks: DataFrame) -> DataFrame:
            """All answers, with those to more asks."""
            dealt = asks.repartition(max(plan.ranges, int(spark.conf.get("spark.sql.shuffle.partitions"))), "kind", "part")
            answered = dealt.groupBy("kind", "part").applyInPandas(_answered, _ANSWER)
            return s.bucketed(answered.repartition(buckets, "pack"), "answers", "pack", buckets)

        def arcs_asked(mine: pd.DataFrame, theirs: pd.DataFrame) -> pd.DataFrame:
            got = Answers(theirs)
            asks = [ask for row in mine.itertuples(index=False) for ask in _arcs_asked(row, got, plan)]
            give_back()
            return pd.DataFrame(asks, columns=_ASK_NAMES)

        def by_pack(answers: DataFrame, run, kind: str) -> DataFrame:
            held = answers.select("pack", "kind", "part", "values")
            return packs.drop("counts").groupBy("pack").cogroup(held.groupBy("pack")).applyInPandas(run, kind)

        answers = answers_to(packs.mapInPandas(tidied(counts_asked), _ASK))
        types, total = answers.where("kind = 'n1'").agg(F.sum("types"), F.sum("total")).first()
        # the start is no token
        plan = replace(plan, tokens=(total or 0) - ends, types=(types or 0) - (ends > 0))
        s.settle()
        if order > 1:
            answers = answers_to(by_pack(answers, arcs_asked, _ASK))
            s.settle()

        def scored(mine: pd.DataFrame, theirs: pd.DataFrame) -> pd.DataFrame:
            got, parts = Answers(theirs), []
            for row in mine.itertuples(index=False):
                known, base, full = _scored(row, got, plan)
                trains = np.frombuffer(row.trains, bool)
                columns = [list(row.keys), ~trains, _unsqueezed(row.lengths), known, plan.tokens, base, full]
                parts.append(pd.DataFrame(dict(zip(names, columns, strict=True))))
            give_back()
            return pd.concat(parts) if parts else pd.DataFrame(columns=names)

        out = by_pack(answers, scored, schema).withColumnRenamed("key", "_key")
        out = out.select(F.col("_key").cast(docs.schema[key].dataType).alias(key), *names[1:])
        return Scratch(spark).stored(out, "scores")
