"""N-gram Jaccard join: candidates by prefix, then a prefix-tree join of each block of candidates.

A set's tokens are 64-bit hashes of its word n-grams. The global order puts tokens that are known to be common behind
the others; two sets that reach the threshold share a token among the first few of each (the prefix). Every token's sets
are tied to leaders, at most two each by their sizes, so that any two sets that share a prefix token, of sizes that can
reach the threshold, are members of one leader's block. A block's sets are stored in a trie; each set traverses it,
sharing the overlap with a path among all the sets below, and leaves subtrees whose remaining lengths cannot reach the
threshold any more. Only a spanning forest of a block's links is returned, so that a group of near copies gives as many
rows as it has members and not as many as it has pairs. Sets that are equal are one from the start.

A large block is dealt in parts, each with the leader. Sets that are then known to be of one component need no further
look at each other. Only those of other components than the leader's, the strays, are held against the other parts, so
that a large group of near copies ships as many sets as it has members.
"""

from __future__ import annotations

import hashlib
import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import Scratch, frugal, lowered, mixed, scratch, small, tidied, word_hashes

#: Tokens in the lower part of the hash space are counted: this many times a prefix's share of a set, so that the common
#: ones among them can be left out of most prefixes.
COUNTED = 1.35

#: A token of this many sets is common; with more than MAX_COMMON such tokens the bound is doubled.
COMMON, MAX_COMMON = 32, 1 << 18

#: Sets of a block that are joined at once, at least, and their tokens; larger blocks are joined part by part.
PART, TOKENS = 128, 1 << 17

#: Tokens of a trie's edge between two looks at the bound.
EDGE = 64

_STEP = np.uint64(0x9E3779B97F4A7C15)


def shingles(text: str | None, n: int) -> np.ndarray:
    """The sorted distinct hashes of a text's word n-grams, A-Z lower-cased; a shorter text is one n-gram; no words, none."""
    h = word_hashes(lowered(text))
    if not len(h):
        return h
    k = min(n, len(h))
    out = h[: len(h) - k + 1].copy()
    for i in range(1, k):
        out = mixed(out * _STEP + h[i : len(h) - k + 1 + i])
    return np.unique(mixed(out + np.uint64(k)))


def prefix(n: int, percent: int) -> int:
    """How many first tokens of a set of n must hold one of any set that reaches the threshold."""
    return n - -(-percent * n // 100) + 1


def cut(percent: int) -> np.uint64:
    """Tokens below are counted."""
    return np.uint64(min(2**64 - 1, int(COUNTED * (100 - percent) / 100 * 2**64)))


def least(n, m, percent: int):
    """The intersection that sets of n and m need: 100 * i >= percent * (n + m - i)."""
    return -(-percent * (n + m) // (100 + percent))


# --- the trie ---------------------------------------------------------------------------------------


class Trie:
    """Sets of token ranks, sorted, as a compressed prefix tree in arrays; edges are at most EDGE tokens long."""

    def __init__(self, sets: list[np.ndarray]):
        order = sorted(range(len(sets)), key=lambda i: sets[i].astype(">u4").tobytes())
        parent, start, end, depth, leaf = [-1], [0], [0], [0], [-1]
        tokens: list[np.ndarray] = []
        size = 0
        path: list[int] = [0]  # nodes of the last set's path
        last = np.zeros(0, np.uint32)
        for i in order:
            s = sets[i]
            m = min(len(s), len(last))
            differ = np.flatnonzero(s[:m] != last[:m])
            common = int(differ[0]) if len(differ) else m
            while depth[path[-1]] > common:
                node = path.pop()
                above = depth[path[-1]]
                if above < common:  # the edge is split: a new node takes its upper part
                    parent.append(path[-1])
                    start.append(start[node])
                    end.append(start[node] + common - above)
                    depth.append(common)
                    leaf.append(-1)
                    parent[node], start[node] = len(parent) - 1, end[-1]
                    path.append(len(parent) - 1)
            at = common
            while at < len(s) or leaf[path[-1]] >= 0 or path[-1] == 0:
                step = min(EDGE, len(s) - at)
                parent.append(path[-1])
                tokens.append(s[at : at + step])
                start.append(size)
                end.append(size + step)
                size += step
                at += step
                depth.append(at)
                leaf.append(i if at == len(s) else -1)
                path.append(len(parent) - 1)
                if at == len(s):
                    break
            else:
                leaf[path[-1]] = i
            last = s
        self.tokens = np.concatenate(tokens) if tokens else np.zeros(0, np.uint32)
        self.start, self.end, self.depth, self.leaf = map(np.array, (start, end, depth, leaf))
        parent_ = np.array(parent)
        lengths = np.array([len(s) for s in sets])
        # nodes by depth in edges; children as ranges of a list that is sorted by parent
        self.children = np.argsort(parent_, kind="stable")[1:]
        self.first = np.searchsorted(parent_[self.children], np.arange(len(parent) + 1))
        self.shortest, self.longest = np.full(len(parent), 1 << 60), np.zeros(len(parent), np.int64)
        held = np.flatnonzero(self.leaf >= 0)
        self.shortest[held] = self.longest[held] = lengths[self.leaf[held]]
        level, levels = np.array([0]), []
        while len(level):
            levels.append(level)
            level = self._below(level)[0]
        for level in levels[:0:-1]:
            np.minimum.at(self.shortest, parent_[level], self.shortest[level])
            np.maximum.at(self.longest, parent_[level], self.longest[level])

    def _below(self, nodes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The children of nodes, and for each the place of its parent in nodes."""
        n = self.first[nodes + 1] - self.first[nodes]
        owner = np.repeat(np.arange(len(nodes)), n)
        skip = np.repeat(self.first[nodes] - np.concatenate([[0], np.cumsum(n)[:-1]]), n)
        return self.children[np.arange(int(n.sum())) + skip], owner

    def reached(self, probe: np.ndarray, held: np.ndarray, percent: int) -> np.ndarray:
        """The sets that reach the threshold with a probe. held: a zeroed scratch array over all ranks."""
        n = len(probe)
        held[probe] = True
        nodes, overlap, found = np.array([0]), np.array([0]), []
        while True:
            nodes, owner = self._below(nodes)
            if not len(nodes):
                break
            start, size = self.start[nodes], self.end[nodes] - self.start[nodes]
            ends = np.cumsum(size)
            at = np.arange(int(ends[-1])) + np.repeat(start - ends + size, size)
            sums = np.concatenate([[0], np.cumsum(held[self.tokens[at]])])
            overlap = overlap[owner] + sums[ends] - sums[ends - size]
            # what is left of the probe behind a node's last token, and of the sets below it
            rest = n - np.searchsorted(probe, self.tokens[self.end[nodes] - 1], side="right")
            bound = overlap + np.minimum(rest, self.longest[nodes] - self.depth[nodes])
            alive = bound >= least(n, np.maximum(self.shortest[nodes], overlap), percent)
            leaf = self.leaf[nodes]
            whole = alive & (leaf >= 0)
            if whole.any():
                hits = overlap[whole] >= least(n, self.depth[nodes[whole]], percent)
                found.append(leaf[whole][hits])
            nodes, overlap = nodes[alive], overlap[alive]
        held[probe] = False
        return np.concatenate(found) if found else np.zeros(0, np.int64)


def forest(keys: np.ndarray, sets: list[np.ndarray], right: np.ndarray, percent: int) -> list[tuple[int, int]]:
    """Links of a block as a spanning forest of pairs of keys. right: which sets are held against those that are not;
    if all or none, each is held against each."""
    ranks = np.unique(np.concatenate(sets), return_inverse=True)[1].astype(np.uint32)
    cuts = np.cumsum([len(s) for s in sets])[:-1]
    own = np.split(ranks, cuts)
    stored = np.flatnonzero(~right) if right.any() and not right.all() else np.arange(len(sets))
    probes = np.flatnonzero(right) if right.any() and not right.all() else stored
    trie, held = Trie([own[i] for i in stored]), np.zeros(int(ranks.max()) + 1, bool)
    root = list(range(len(sets)))

    def find(i: int) -> int:
        while root[i] != i:
            root[i] = root[root[i]]
            i = root[i]
        return i

    out = []
    for i in probes.tolist():
        for j in stored[trie.reached(own[i], held, percent)].tolist():
            a, b = find(i), find(j)
            if a != b:
                root[a] = b
                if keys[i] != keys[j]:
                    out.append((int(keys[i]), int(keys[j])))
    return out


# --- candidates -------------------------------------------------------------------------------------


def _classes(n: np.ndarray, percent: int) -> np.ndarray:
    """Sizes that can reach the threshold are of the same class or of neighbouring ones."""
    return np.floor(np.log(n) / -math.log((percent - 1) / 100)).astype(np.int64)


def _sets(text, n: int, percent: int):
    """A struct of a text's set: its size, a 128-bit digest, and the tokens that can be in its prefix."""

    @F.pandas_udf("n long, a long, b long, low array<long>")
    @frugal
    def run(texts: pd.Series) -> pd.DataFrame:
        rows = []
        for t in texts:
            s = shingles(t, n)
            d = np.frombuffer(hashlib.blake2b(s.tobytes(), digest_size=16).digest(), np.int64)
            low = s[: max(int(np.searchsorted(s, cut(percent))), prefix(len(s), percent) if len(s) else 0)]
            rows.append((len(s), int(d[0]), int(d[1]), low.view(np.int64)))
        return pd.DataFrame(rows, columns=["n", "a", "b", "low"])

    return run(text)


def _entries(sets: DataFrame, common: np.ndarray, percent: int, of_common: bool) -> DataFrame:
    """sets: key, n, low. A row for each token of each prefix that is common, or that is not: token, key, n, pos, cls, and
    how many of the set's prefix are common."""

    @tidied
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            if not len(batch):
                continue
            tokens, pos, held, sizes = [], [], [], batch["n"].to_numpy(np.int64)
            for n, low in zip(sizes.tolist(), batch["low"], strict=True):
                u = np.asarray(low, np.int64).view(np.uint64)
                at = np.minimum(np.searchsorted(common, u), max(0, len(common) - 1))
                is_common = common[at] == u if len(common) else np.zeros(len(u), bool)
                counted = u < cut(percent)
                order = np.concatenate([np.flatnonzero(counted & ~is_common), np.flatnonzero(counted & is_common), np.flatnonzero(~counted)])[: prefix(n, percent)]
                taken = np.flatnonzero(is_common[order] == of_common)
                tokens.append(u[order[taken]])
                pos.append(taken)
                held.append(int(is_common[order].sum()))
            count = [len(t) for t in tokens]
            n = np.repeat(sizes, count)
            yield pd.DataFrame(
                {
                    "token": np.concatenate(tokens).view(np.int64), "key": np.repeat(batch["key"].to_numpy(np.int64), count), "n": n,
                    "pos": np.concatenate(pos), "cls": _classes(n, percent), "held": np.repeat(held, count),
                }
            )

    return sets.mapInPandas(run, "token long, key long, n long, pos long, cls long, held long")


def _rare_edges(entries: DataFrame, percent: int, raised: bool) -> DataFrame:
    """(leader, member, whole) for tokens that are not common. Of a token with COMMON sets at most, all pairs; of one with
    more (only where the bound was raised), each size class's first set leads it and the next class, and whole is 1.

    A pair stays if some token's positions let it reach the threshold with that as the first common one, and if it has
    enough tokens in common: of two sets that reach it, one's prefix ends first in the order, so lies in the other's
    prefix but for the tokens that the other set lacks. Of those in common, the common tokens are not counted here, so
    as many as both prefixes hold are taken for granted.
    """

    @tidied
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        names, held = ["token", "key", "n", "pos", "cls", "held"], None
        for batch in _with_end(batches):
            rows = held if batch is None else batch[names].to_numpy(np.int64)
            if batch is not None and held is not None:
                rows = np.concatenate([held, rows])
            if rows is None or not len(rows):
                continue
            cut = len(rows) if batch is None else int(np.flatnonzero(rows[:, 0] != rows[-1, 0])[-1]) + 1 if rows[0, 0] != rows[-1, 0] else 0
            held, rows = rows[cut:], rows[:cut]
            if not len(rows):
                continue
            first = np.flatnonzero(np.concatenate([[True], rows[1:, 0] != rows[:-1, 0]]))
            size = np.diff(np.append(first, len(rows)))
            out = [np.zeros((0, 5), np.int64)]
            for n in np.unique(size[(size > 1) & (size <= COMMON)]).tolist():  # all groups of one size together
                group = rows[first[size == n][:, None] + np.arange(n)]
                i, j = np.triu_indices(n, 1)
                x, y = group[:, i].reshape(-1, 6), group[:, j].reshape(-1, 6)
                o, larger = least(x[:, 2], y[:, 2], percent), np.maximum(x[:, 2], y[:, 2])
                spare = o + percent * -larger // 100 + 1  # o - ceil(percent * larger / 100) + 1
                want = np.ones(len(x), np.int64) if raised else np.maximum(1, spare - np.minimum(x[:, 5], y[:, 5]))
                fits = np.minimum(x[:, 2] - x[:, 3], y[:, 2] - y[:, 3]) >= o
                can = (spare >= 1) & (x[:, 1] != y[:, 1])
                out.append(np.stack([np.minimum(x[:, 1], y[:, 1]), np.maximum(x[:, 1], y[:, 1]), want, fits, 0 * want], axis=1)[can])
            for at, n in zip(first[size > COMMON].tolist(), size[size > COMMON].tolist(), strict=True):
                group = rows[at : at + n]
                group = group[np.lexsort((group[:, 1], group[:, 4]))]
                for c in np.unique(group[:, 4]):
                    lo, hi = np.searchsorted(group[:, 4], c), np.searchsorted(group[:, 4], c + 1, side="right")
                    members = group[lo + 1 : hi, 1]
                    members = members[members != group[lo, 1]]
                    one = np.ones(len(members), np.int64)
                    out.append(np.stack([group[lo, 1] * one, members, one, one, one], axis=1))
            edges, count = np.unique(np.concatenate(out), axis=0, return_counts=True)
            yield pd.DataFrame({"leader": edges[:, 0], "member": edges[:, 1], "want": edges[:, 2], "fits": edges[:, 3], "whole": edges[:, 4], "shared": count})

    rows = entries.repartition("token").sortWithinPartitions("token")
    pairs = rows.mapInPandas(run, "leader long, member long, want long, fits long, whole long, shared long")
    summed = pairs.groupBy("leader", "member").agg(F.min("want").alias("want"), F.max("fits").alias("fits"), F.max("whole").alias("whole"), F.sum("shared").alias("shared"))
    return summed.where("fits = 1 and shared >= want").select("leader", "member", "whole")


def _with_end(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame | None]:
    yield from batches
    yield None


def _common_edges(entries: DataFrame, tables: Scratch) -> DataFrame:
    """(leader, member, whole) of each common token: of each size class its least key leads, and also the next class."""
    rows = entries.select("token", "key", "cls")
    leaders = tables.stored(rows.groupBy("token", "cls").agg(F.min("key").alias("leader")), "leaders")
    both = rows.select("token", F.col("key").alias("member"), F.explode(F.array(F.col("cls"), F.col("cls") - 1)).alias("cls"))
    return both.join(small(leaders, leaders.count()), ["token", "cls"]).select("leader", "member", F.lit(1).cast("long").alias("whole")).where("leader <> member")


def _needed(edges: DataFrame, tables: Scratch) -> DataFrame:
    """edges: leader, member, whole. (leader, member) of blocks that still hold every pair of sets which is to be compared.

    Where whole is 0 only the leader and the member are to be compared, else all members of the block. So the former edge
    goes if another block holds its two sets; the latter only with its whole block, if one other block, led by a lesser
    key, holds all of it.
    """
    above = tables.stored(edges.groupBy(F.col("member").alias("_m")).agg(F.min("leader").alias("_a")), "above")
    n_above = above.count()
    of_leader = small(above.select(F.col("_m").alias("_l"), F.col("_a").alias("_b")), n_above)
    both = edges.join(small(above, n_above), F.col("member") == F.col("_m")).join(of_leader, F.col("leader") == F.col("_l"), "left")
    edges = tables.stored(both.where("whole = 1 or _b is null or _a <> _b").select("leader", "member"), "single")
    outer = edges.groupBy(F.col("member").alias("_l")).agg(F.min("leader").alias("_a")).where("_a < _l")
    outer = tables.stored(outer, "outer")
    asked = edges.join(small(outer, outer.count()), F.col("leader") == F.col("_l")).select("_l", "_a", "member")
    held = edges.select(F.col("leader").alias("_a"), "member", F.lit(True).alias("held"))
    inside = asked.join(held, ["_a", "member"], "left").groupBy("_l").agg(F.min((F.col("member") == F.col("_a")) | F.coalesce("held", F.lit(False))).alias("all"))
    inner = tables.stored(inside.where("all").select(F.col("_l").alias("leader")), "inner")
    return edges.join(small(inner, inner.count()), "leader", "left_anti")


def links(docs: DataFrame, sets: DataFrame, tables: Scratch, n: int, percent: int) -> DataFrame:
    """docs: key, text; sets: key, n, low, a row for each different set. Links of the threshold as spanning forests."""
    spark = docs.sparkSession
    counts = sets.select(F.explode("low").alias("token")).groupBy("token").count().where(F.col("count") >= COMMON)
    counts, bound = tables.stored(counts, "counts"), COMMON
    sets = sets.select("key", "n", "low")
    while counts.where(F.col("count") >= bound).count() > MAX_COMMON:
        bound *= 2
    common = counts.where(F.col("count") >= bound).select("token").toPandas()["token"].to_numpy(np.int64)
    common = np.sort(common.view(np.uint64))

    tables.settle()
    edges = _rare_edges(_entries(sets, common, percent, False), percent, bound > COMMON)
    if len(common):
        edges = edges.unionByName(_common_edges(tables.stored(_entries(sets, common, percent, True), "entries"), tables))
    edges = tables.stored(edges.groupBy("leader", "member").agg(F.max("whole").alias("whole")), "all_edges")
    tables.settle()
    edges = tables.stored(_needed(edges, tables), "edges")
    wanted = tables.stored(edges.select(F.explode(F.array("leader", "member")).alias("key")).distinct(), "wanted")

    @F.pandas_udf("array<long>")
    @frugal
    def tokens(texts: pd.Series) -> pd.Series:
        return pd.Series([shingles(t, n).view(np.int64) for t in texts], dtype=object)

    found = docs.join(small(wanted, wanted.count()), "key", "left_semi").select("key", tokens("text").alias("tokens"))

    def verified(dealt: DataFrame, name: str) -> DataFrame:
        """dealt: leader, lo, hi, member, probe. Links among the sets of each (leader, lo, hi): of probes with the others,
        or, if there are none, of each with each."""
        dealt = tables.stored(dealt, f"dealt_{name}")
        joined = found.join(small(dealt, dealt.count()), found["key"] == dealt["member"])
        blocks = joined.select("leader", "lo", "hi", "key", "probe", "tokens").repartition("leader", "lo", "hi").sortWithinPartitions("leader", "lo", "hi")
        return tables.stored(blocks.mapInPandas(run, "u long, v long").distinct(), f"links_{name}")

    @tidied
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        held: list[tuple] = []
        at = None

        def done() -> pd.DataFrame | None:
            if len(held) < 2:
                return None
            keys, right = np.array([h[0] for h in held]), np.array([h[1] for h in held])
            pairs = forest(keys, [h[2] for h in held], right, percent)
            return pd.DataFrame(pairs, columns=["u", "v"], dtype=np.int64) if pairs else None

        for batch in batches:
            for leader, lo, hi, key, probe, t in zip(*(batch[c] for c in ("leader", "lo", "hi", "key", "probe", "tokens")), strict=True):
                if at != (leader, lo, hi):
                    if (made := done()) is not None:
                        yield made
                    held, at = [], (leader, lo, hi)
                held.append((key, bool(probe), np.asarray(t, np.int64).view(np.uint64)))
        if (made := done()) is not None:
            yield made

    none = F.lit(0).cast("long")
    sizes = edges.groupBy(F.col("leader").alias("_l")).agg(F.count("*").alias("c")).where(F.col("c") > PART)
    sizes = tables.stored(sizes, "sizes")
    # all sets of a block are of about the leader's size
    per = F.greatest(F.lit(PART), F.floor(F.lit(TOKENS) / F.col("n")))
    sizes = sets.select("key", "n").join(small(sizes, sizes.count()), F.col("key") == F.col("_l")).select("_l", per.alias("per"), F.ceil(F.col("c") / per).alias("parts"))
    sizes = tables.stored(sizes.where("parts > 1"), "parts")
    large = small(sizes, sizes.count())
    members = edges.join(large, F.col("leader") == F.col("_l"), "left").withColumn("parts", F.coalesce("parts", none + 1))
    members = tables.stored(members.select("leader", "member", "parts", "per", F.pmod(F.xxhash64("member"), F.col("parts")).alias("part")), "members")
    leaders = members.select("leader", "parts").distinct()
    leaders = leaders.select("leader", F.col("leader").alias("member"), F.explode(F.sequence(none, F.col("parts") - 1)).alias("part"))
    first = members.select("leader", "member", "part").unionByName(leaders)
    linked = verified(first.select("leader", none.alias("lo"), F.col("part").alias("hi"), "member", F.lit(False).alias("probe")), "first")

    several = members.where("parts > 1")
    if not several.take(1):
        return linked
    known = tables.stored(components(linked, tables, "known").select(F.col("u").alias("_u"), F.col("v").alias("_v")), "known")
    own = small(known, known.count())
    rooted = several.join(own, F.col("member") == F.col("_u"), "left").withColumn("root", F.coalesce("_v", "member")).drop("_u", "_v")
    rooted = rooted.join(own, F.col("leader") == F.col("_u"), "left").withColumn("top", F.coalesce("_v", "leader")).drop("_u", "_v")
    rooted = tables.stored(rooted, "rooted")
    strays = rooted.where("root <> top")
    chunks = strays.groupBy("leader").agg(F.ceil(F.count("*") / F.max("per")).alias("chunks"))
    chunks = tables.stored(chunks.withColumnRenamed("leader", "_l"), "chunks")
    n_chunks = chunks.count()
    if not n_chunks:
        return linked
    strays, every = (x.join(small(chunks, n_chunks), F.col("leader") == F.col("_l")) for x in (strays, rooted))
    probes = strays.withColumn("lo", F.pmod(F.xxhash64("member", F.lit(1)), F.col("chunks"))).withColumn("hi", F.explode(F.sequence(none, F.col("parts") - 1)))
    others = every.withColumn("lo", F.explode(F.sequence(none, F.col("chunks") - 1))).withColumn("hi", F.col("part"))
    both = [x.select("leader", "lo", "hi", "member", F.lit(probe).alias("probe")) for x, probe in ((probes, True), (others, False))]
    return linked.unionByName(verified(both[0].unionByName(both[1]), "strays"))


def components(edges: DataFrame, tables: Scratch, name: str = "") -> DataFrame:
    """edges: u, v. (u, v) of each node that is not the least of its component, v being that least one.

    Every node's larger neighbours are tied to its least neighbour, then its smaller ones; each round is stored, and the
    rounds end when nothing changes. No group is ever gathered: only minima are taken.
    """
    least_first = edges.where("u <> v").select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct()
    now, before, step = tables.stored(least_first, f"{name}links0"), None, 0
    while True:
        sign = now.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        if sign == before or not sign[0]:
            return now
        before, step = sign, step + 1
        both = now.unionByName(now.select(F.col("v").alias("u"), F.col("u").alias("v")))
        low = both.groupBy("u").agg(F.least(F.col("u"), F.min("v")).alias("m"))
        large = both.where("v > u").join(low, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()
        large = tables.stored(large, f"{name}large{step}")
        low = large.groupBy("u").agg(F.min("v").alias("m"))
        tied = large.join(low, "u")
        tied = tied.select(F.explode(F.array(F.struct("u", F.col("m").alias("v")), F.struct(F.col("v").alias("u"), F.col("m").alias("v")))).alias("e"))
        now = tables.stored(tied.select("e.*").where("u <> v").distinct(), f"{name}links{step}")


def join(docs: DataFrame, n: int = 4, percent: int = 85, key: str = "doc_id", text: str = "text") -> DataFrame:
    """Per row: key, n_shingles, component_id: the least key that links reach.

    Two sets of n-grams are linked when 100 * intersection >= percent * union. Null texts and those without words have
    an empty set and are linked with nothing. Keys are integers; rows of one key are one document, with links from each
    of its texts; a row with a null key links nothing and has a null component. Repeated rows give a row each; an empty
    table gives none; other columns are left out. Texts are read twice and never shuffled unless more than
    common.BROADCAST_BYTES of documents have candidates. Hashes of 64 bits stand for n-grams; of two different n-grams of
    a pair to be taken for the same, the chance is below 1 in 10^12 for a pair of sets of 3,000.
    """
    rows = docs.select(F.col(key).cast("long").alias("key"), F.col(text).alias("text"))
    with scratch(docs.sparkSession) as s:
        sets = s.stored(rows.select("key", _sets(F.col("text"), n, percent).alias("s")).select("key", "s.*"), "sets")
        full = sets.where("n > 0 and key is not null")
        equal = full.select("key", "a", "b").groupBy("a", "b").agg(F.min("key").alias("least"), F.count("*").alias("c")).where("c > 1").drop("c")
        equal = s.stored(equal, "equal")
        n_equal = equal.count()
        classed = sets.select("key", "n", "a", "b").join(small(equal, n_equal), ["a", "b"], "left")
        classed = s.stored(classed.select("key", "n", "a", "b", F.when(F.col("n") > 0, F.coalesce("least", "key")).otherwise(F.col("key")).alias("rep")), "classed")
        copies = s.stored(classed.where("key <> rep").select("key", "a", "b"), "copies")
        different = full.join(small(copies, copies.count()), ["key", "a", "b"], "left_anti").select("key", "n", "low")
        found = links(rows.where("key is not null"), different, s, n, percent)
        held = classed.where("n > 0 and key is not null")
        several = held.groupBy("key").agg(F.min("rep").alias("lo"), F.max("rep").alias("hi")).where("lo <> hi").select("key")
        several = s.stored(several, "several")
        if several.take(1):  # a key with several texts ties their sets
            found = found.unionByName(held.join(several, "key").select(F.col("key").alias("u"), F.col("rep").alias("v")))
        found = components(found, s)
        found = s.stored(found.select(F.col("u").alias("rep"), F.col("v").alias("root")), "found")
        out = classed.join(small(found, found.count()), "rep", "left")
        component = F.when(F.col("key").isNotNull(), F.coalesce("root", "rep"))
        out = out.select(F.col("key").cast(docs.schema[key].dataType).alias("_key"), F.col("n").alias("n_shingles"), component.alias("component_id"))
        return Scratch(docs.sparkSession).stored(out.withColumnRenamed("_key", key), "components")


def deduplicated(docs: DataFrame, n: int = 4, percent: int = 85, key: str = "doc_id", text: str = "text") -> DataFrame:
    """One document of each component, that with the least key, with its own columns; rows without a key all stay.
    Of rows that repeat a key one stays."""
    tables = Scratch(docs.sparkSession)
    rows = join(docs, n, percent, key, text).select(F.col(key).alias("_k"), F.col("component_id").alias("_c")).where("_k is not null")
    rows = tables.stored(rows, "components")
    gone = tables.stored(rows.where("_k <> _c").select("_k").distinct(), "gone")
    packed = docs.select(F.struct(*[docs[f"`{c}`"] for c in docs.columns]).alias("row"), docs[key].alias("key"))
    kept = packed.join(small(gone, gone.count()), F.col("key") == F.col("_k"), "left_anti")
    repeated = tables.stored(rows.groupBy("_k").count().where("count > 1").select("_k"), "repeated")
    if repeated.take(1):
        marked = kept.join(small(repeated, repeated.count()), F.col("key") == F.col("_k"), "left")
        kept = marked.where("_k is null").unionByName(marked.where("_k is not null").dropDuplicates(["key"]))
    return kept.select("row.*")
