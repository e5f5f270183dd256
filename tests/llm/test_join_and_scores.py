import math
import random
import re
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from sparkloom.llm import jaccard_join as jj
from sparkloom.llm import language_id as li
from sparkloom.llm import lm_score as lm
from sparkloom.llm.common import Scratch, remainder, word_hashes
from sparkloom.sources.tables import table

from .helpers import LOWER, components, documents, shingles, words

# --- n-gram Jaccard join


def test_trie_equals_all_pairs():
    rng = random.Random(5)
    for _ in range(150):
        universe = rng.choice([20, 200, 2000])
        base = [rng.sample(range(universe), rng.randint(1, min(universe, rng.choice([5, 40, 300])))) for _ in range(4)]
        sets = []
        for _ in range(rng.randint(1, 25)):
            b = list(rng.choice(base))
            rng.shuffle(b)
            n = max(1, len(b) // 8)
            b = set(b[rng.randint(0, n) :]) | set(rng.sample(range(universe), rng.randint(0, n)))
            sets.append(np.array(sorted(b) or [0], np.uint32))
        percent = rng.choice([50, 80, 85, 100])
        trie, held = jj.Trie(sets), np.zeros(universe + 1, bool)
        for s in sets:
            want = {j for j, t in enumerate(sets) if 100 * len(np.intersect1d(s, t)) >= percent * len(np.union1d(s, t))}
            assert set(trie.reached(s, held, percent).tolist()) == want and not held.any()


def near_copies(seed, n=260):
    rng = random.Random(seed)
    vocabulary = [f"w{i}" for i in range(400)]
    bases = [[rng.choice(vocabulary) for _ in range(rng.randint(3, 120))] for _ in range(25)]
    shared = [rng.choice(vocabulary) for _ in range(30)]
    rows = []
    for i in range(n):
        w = list(rng.choice(bases))
        for _ in range(rng.randint(0, 4)):
            w[rng.randrange(len(w))] = rng.choice(vocabulary)
        if rng.random() < 0.3:
            w = w + shared
        rows.append((i, rng.choice([" ", "\n", "  "]).join(w).upper() if rng.random() < 0.2 else " ".join(w)))
    return rows


@pytest.mark.parametrize(("n", "percent", "most"), [(4, 85, 1 << 18), (5, 80, 1 << 18), (2, 60, 1 << 18), (4, 85, 20), (5, 80, 0)])
def test_join_equals_all_pairs(spark, monkeypatch, n, percent, most):
    monkeypatch.setattr(jj, "COMMON", 8)
    monkeypatch.setattr(jj, "MAX_COMMON", most)
    monkeypatch.setattr(jj, "PART", 16)
    monkeypatch.setattr(jj, "TOKENS", 1)
    rows = near_copies(n)
    got = {r.doc_id: (r.n_shingles, r.component_id) for r in jj.join(documents(spark, [(k, t, "en", "s") for k, t in rows]), n, percent).collect()}
    want = components(rows, n, percent)
    assert got == {k: (len(shingles(t, n)), want[k]) for k, t in rows}
    assert len(set(want.values())) < len(rows) - 20


@pytest.mark.parametrize("tokens", [1, 1 << 17])
def test_one_large_group(spark, monkeypatch, tokens):
    """Of which many do not reach the threshold; in parts, and in one."""
    monkeypatch.setattr(jj, "TOKENS", tokens)
    rng = random.Random(8)
    base = [f"b{i}" for i in range(150)]
    rows = [(i, " ".join([*base[:140], *[f"x{rng.randrange(10**6)}" for _ in range(rng.randint(0, 14))]])) for i in range(600)]
    got = {r.doc_id: r.component_id for r in jj.join(documents(spark, [(k, t, "en", "s") for k, t in rows])).collect()}
    assert got == components(rows, 4, 85)


def test_overlapping_blocks_of_common_tokens(spark, monkeypatch):
    """Token 1 is of sets 0, 1, 2 and token 2 of 1, 2, 3: 0 leads 1 and 2, and 1 leads 2 and 3, so 2 meets 3 only there."""
    monkeypatch.setattr(jj, "COMMON", 2)
    near = [f"n{i}" for i in range(40)]
    texts = [[f"a{i}" for i in range(40)], [f"b{i}" for i in range(40)], near, [*near[:-1], "other"]]
    docs = spark.createDataFrame([(k, " ".join(t)) for k, t in enumerate(texts)], "key long, text string")
    sets = spark.createDataFrame([(0, 37, [1]), (1, 37, [1, 2]), (2, 37, [1, 2]), (3, 37, [2])], "key long, n long, low array<long>")
    got = jj.links(docs, sets, Scratch(spark), 4, 85).collect()
    assert {(min(r.u, r.v), max(r.u, r.v)) for r in got} == {(2, 3)}


def test_blocks_that_are_needed(spark):
    """Whatever blocks are left out, each pair that is to be compared shares one that stays."""
    rng = random.Random(6)
    for _ in range(6):
        edges = {(a, b): rng.random() < 0.5 for a, b in ((rng.randrange(12), rng.randrange(14)) for _ in range(40)) if a != b}
        df = spark.createDataFrame([(a, b, int(w)) for (a, b), w in edges.items()], "leader long, member long, whole long")

        def blocks(pairs):
            out = {}
            for a, b in pairs:
                out.setdefault(a, {a}).add(b)
            return list(out.values())

        want = [set(e) for e in edges]
        want += [{a, b} for block in blocks(e for e, w in edges.items() if w) for a in block for b in block if a < b]
        kept = blocks((r.leader, r.member) for r in jj._needed(df, Scratch(spark)).collect())
        assert all(any(p <= block for block in kept) for p in want)


def test_join_of_odd_rows(spark):
    same = " ".join(f"s{i}" for i in range(50))
    rows = [(9, same), (9, same), (5, same), (None, same), (1, None), (2, ""), (3, " \n\t"), (4, "One"), (7, "one"), (8, "one two"), (6, "One Two"), (10, "one two three"), (11, "Éa"), (12, "éa"), (13, " ".join(f"w{i}" for i in range(60_000))), (14, "a b"), (20, same), (20, "one")]
    docs = documents(spark, [(k, t, "en", "s") for k, t in rows], clashing=True)
    got = Counter((r.doc_id, r.n_shingles, r.component_id) for r in jj.join(docs).collect())
    tied = {5: 4, 9: 4, 20: 4, 4: 4, 7: 4, 8: 6, 6: 6}  # 20 has two texts and so ties both groups
    assert got == Counter((k, len(shingles(t, 4)), None if k is None else tied.get(k, k)) for k, t in rows)
    assert jj.join(documents(spark, [])).count() == 0
    kept = jj.deduplicated(docs)
    assert kept.columns == docs.columns
    assert sorted(map(repr, (r.doc_id for r in kept.collect()))) == sorted(map(repr, [None, 1, 2, 3, 4, 6, 10, 11, 12, 13, 14]))
    assert jj.deduplicated(documents(spark, [])).count() == 0


def test_components(spark):
    rng = random.Random(3)
    edges = [(rng.randrange(300), rng.randrange(300)) for _ in range(220)] + [(i, i + 1) for i in range(1000, 1060)]
    root = {}

    def find(x):
        while root.setdefault(x, x) != x:
            x = root[x]
        return x

    for a, b in edges:
        lo, hi = sorted((find(a), find(b)))
        root[hi] = lo
    got = {r.u: r.v for r in jj.components(spark.createDataFrame(edges, "u long, v long"), Scratch(spark)).collect()}
    assert got == {k: find(k) for k in root if find(k) != k}


# --- language identification


def test_language_of_held_out_documents(spark):
    docs = table(spark, "/root/testdata/sf0.1", "documents")
    got = li.identify(docs, remainder(F.col("doc_id"), 4) != 2).join(docs.select("doc_id", "lang"), "doc_id").collect()
    held = [r for r in got if r.held_out]
    assert len(got) == docs.count() and sum(r.lang == r.lang_pred for r in held) / len(held) > 0.995
    assert all(0 <= r.score <= 1 for r in got)


def test_filter_knows_its_languages():
    rng = np.random.default_rng(2)
    sets = [np.unique(rng.integers(1, 1 << 60, 500).astype(np.uint64)) for _ in range(5)]
    slots = np.zeros((1 << 14, 1), np.uint64)
    for i, g in enumerate(sets):
        for at in li._slots(g, len(slots)):
            slots[at, 0] |= np.uint64(1 << i)
    model = li.Model(tuple("abcde"), slots, np.zeros(5))
    for i, g in enumerate(sets):
        masks = model.masks(g)[:, 0]
        assert ((masks >> np.uint64(i)) & np.uint64(1)).all()
        assert ((masks & ~np.uint64(1 << i)) != 0).mean() < 0.05


def test_grams_do_not_depend_on_pieces(monkeypatch):
    text = "Ab, Été 1x  oİk 漢字 " * 20
    whole = np.concatenate(list(li.grams(text)))
    monkeypatch.setattr(li, "CHUNK", 7)
    pieces = [g for g in li.grams(text)]
    assert len(pieces) > 10 and abs(sum(map(len, pieces)) - len(whole)) <= 2 * len(pieces)
    assert list(li.grams("12 !")) == [] or all(len(g) == 0 for g in li.grams("12 !"))


def test_language_of_odd_rows(spark):
    rows = [(i, t, l, "s") for i, (t, l) in enumerate([("the cat and the hat", "en"), ("le chat et la souris", "fr")] * 20)]
    odd = [(100, None, "en", "s"), (101, "", None, "s"), (102, "123 !!", "en", "s"), (103, "the the", None, "s"), (103, "the the", None, "s"), (None, "le la", None, "s"), (104, "the " * 100_000, None, "s"), (105, "漢", None, "s")]
    got = li.identify(documents(spark, rows + odd, clashing=True), F.coalesce(F.col("doc_id") < 100, F.lit(False))).collect()
    by = {r.doc_id: r for r in got}
    assert len(got) == 48 and by[100].lang_pred == by[101].lang_pred == by[102].lang_pred == "und"
    assert by[103].lang_pred == by[104].lang_pred == "en" and by[None].lang_pred == "fr" and by[105].score == 0
    assert by[0].held_out is False and by[103].held_out is True
    nothing = li.identify(documents(spark, odd), F.lit(False)).collect()
    assert {(r.lang_pred, r.score) for r in nothing} == {("und", 0.0)}
    assert li.identify(documents(spark, []), F.lit(True)).count() == 0


def test_many_languages(spark):
    """More than a word of 64 bits holds; each has its own letters."""
    rows = [(i, " ".join(chr(0x4E00 + 40 * i + j) * 3 for j in range(40)), f"l{i:03}", "s") for i in range(150)]
    model = li.fit(documents(spark, rows))
    assert model.slots.shape[1] == 3 and len(model.languages) == 150
    got = li.identify(documents(spark, rows), F.lit(True)).collect()
    assert {r.doc_id: r.lang_pred for r in got} == {k: x for k, _, x, _ in rows} and min(r.score for r in got) > 0.5


def test_languages_equal_plain_sets(spark):
    """The query's predictions against sets of n-grams, wherever these tell languages apart."""
    from sparkloom.llm.queries import op6_language_id

    sf = "/root/testdata/sf0.01"
    rows = table(spark, sf, "documents").select("doc_id", "text", "lang", (remainder(F.col("doc_id"), 4) != 2).alias("train")).collect()

    def grams(text):
        low = "".join(c.lower() if c.isalpha() and len(c.lower()) == 1 else c if c.isalpha() else " " for c in text or "")
        t = f" {' '.join(low.split(' '))} "
        t = re.sub(" +", " ", t)
        return [t[i : i + 3] for i in range(len(t) - 2) if t[i + 1] != " "]

    docs, counts = Counter(), {}
    for r in rows:
        if r.train and r.lang is not None:
            docs[r.lang] += 1
            counts.setdefault(r.lang, Counter()).update(set(grams(r.text)))
    sets = {x: {g for g, n in c.items() if n >= li.SHARE * docs[x]} for x, c in counts.items()}
    got, sure = {r.doc_id: r for r in op6_language_id(spark, sf).collect()}, 0
    for r in rows:
        own = grams(r.text)
        if not own:
            assert (got[r.doc_id].lang_pred, got[r.doc_id].score) == ("und", 0)
            continue
        shares = sorted(((sum(g in s for g in own) / len(own), x) for x, s in sets.items()), reverse=True)
        if shares[0][0] - shares[1][0] > 0.05:
            sure += 1
            assert got[r.doc_id].lang_pred == shares[0][1]
            assert got[r.doc_id].score == pytest.approx(shares[0][0] / sum(p for p, _ in shares), abs=0.05)
    assert sure > 0.95 * len(rows)


def test_language_of_one_document(spark):
    rows = [(i, f"the cat and the hat {i}", "en", "s") for i in range(5)] + [(9, "le chat et la souris", "fr", "s")]
    got = {r.doc_id: r.lang_pred for r in li.identify(documents(spark, [*rows, (10, "la souris et le chat", None, "s")]), F.col("doc_id") < 10).collect()}
    assert got[9] == got[10] == "fr" and got[0] == "en"


# --- language model


def expected(rows, learn):
    tokens = [(k, [*words((t or "").translate(LOWER)), None]) for k, t in rows]
    c = Counter(w for (k, t) in tokens if learn(k) for w in t)
    n, v = sum(c.values()), len(c)
    return [(k, not learn(k), len(t), sum(c[w] > 0 for w in t), n, round(sum(math.log10((c[w] + 1) / (n + v + 1)) for w in t), 6)) for k, t in tokens]


def check(got, want):
    assert sorted(map(repr, ((r.doc_id, r.held_out, r.n_tokens, r.n_known, r.train_tokens, round(r.base_score, 6) + 0.0) for r in got))) == sorted(map(repr, ((*w[:5], w[5] + 0.0) for w in want)))


def test_scores_of_documents(spark, monkeypatch):
    monkeypatch.setattr(lm, "PACK", 1 << 16)  # many packs
    sf = "/root/testdata/sf0.01"
    docs = table(spark, sf, "documents")
    rows = [(r.doc_id, r.text) for r in docs.collect()]
    held = {r.doc_id for r in docs.where(remainder(F.col("doc_id"), 7) == 2).collect()}
    got = lm.score(docs, remainder(F.col("doc_id"), 7) != 2).collect()
    check(got, expected(rows, lambda k: k not in held))
    out = [r for r in got if r.held_out]
    assert sum(r.score for r in out) > sum(r.base_score for r in out)


def test_scores_of_odd_rows(spark):
    rows = [(1, "A b a b"), (2, "a B"), (2, "a B"), (3, None), (4, ""), (5, " \t"), (6, "z " * 50_000), (7, "a b"), (100, "a b q"), (101, None), (None, "a")]
    docs = documents(spark, [(k, t, "en", "s") for k, t in rows], clashing=True)
    check(lm.score(docs, F.col("doc_id") < 100).collect(), expected(rows, lambda k: k is not None and k < 100))
    none = lm.score(docs, F.lit(False)).collect()
    assert len(none) == len(rows) and all(r.base_score == r.score == 0 and r.n_known == r.train_tokens == 0 for r in none)
    assert lm.score(documents(spark, []), F.lit(True)).count() == 0


class Plain:
    """The automaton in dictionaries: states are n-grams (tuples of words; None ends a text, START starts it)."""

    START = ("start",)

    def __init__(self, texts, order):
        self.order, self.count, self.arcs = order, Counter(), {}
        for t in texts:
            tokens = [self.START, *words(t), None]
            for k in range(1, order + 1):  # an n-gram goes no further back than the start
                self.count.update(tuple(tokens[i : i + k]) for i in range(len(tokens) - k + 1))
        self.tokens = sum(c for g, c in self.count.items() if len(g) == 1 and g != (self.START,))
        self.types = len([g for g in self.count if len(g) == 1 and g != (self.START,)])
        for g, c in self.count.items():
            if len(g) > 1 and c >= lm.LEAST:
                self.arcs.setdefault(g[:-1], {})[g[-1]] = c

    def p(self, state, w):
        """state: an n-gram seen LEAST times, () the root."""
        if not state:
            return (self.count[w,] + 1) / (self.tokens + self.types + 1)
        arcs, n = self.arcs.get(state, {}), self.count[state]
        left = (n - sum(arcs.values()) + lm.DISCOUNT * len(arcs)) / n
        return max(arcs.get(w, 0) - lm.DISCOUNT, 0) / n + left * self.p(state[1:], w)

    def after(self, history):
        """The state of the longest n-gram that ends a history."""
        for k in range(min(self.order - 1, len(history)), 0, -1):
            if self.count[tuple(history[-k:])] >= lm.LEAST:
                return tuple(history[-k:])
        return ()

    def score(self, text):
        total, history = 0.0, [self.START]
        for w in [*words(text), None]:
            total += math.log10(self.p(self.after(history), w))
            history.append(w)
        return total


@pytest.mark.parametrize("order", [1, 2, 3, 4])
def test_automaton_is_a_distribution(spark, monkeypatch, order):
    """A plain traversal with states and failure arcs agrees; after any history the probabilities of all tokens and of an
    unknown one add up to 1."""
    monkeypatch.setattr(lm, "ORDER", order)
    monkeypatch.setattr(lm, "PACK", 1 << 9)
    monkeypatch.setattr(lm, "RANGE", 1 << 7)
    rng = random.Random(4)
    rows = [(i, " ".join(rng.choices("abcdef", weights=[9, 5, 3, 2, 1, 1], k=rng.randint(0, 9)))) for i in range(80)] + [(80, "once")]
    plain = Plain([t for k, t in rows if k % 5], order)
    got = {r.doc_id: r.score for r in lm.score(documents(spark, [(k, t, "en", "s") for k, t in rows]), F.col("doc_id") % 5 != 0).collect()}
    every = [w for g in plain.count if len(g) == 1 for w in g if w != plain.START]
    for k, t in rows:
        assert got[k] == pytest.approx(plain.score(t))
        history = [plain.START, *words(t)]
        for i in range(1, len(history) + 1):
            assert sum(plain.p(plain.after(history[:i]), w) for w in [*every, "unknown"]) == pytest.approx(1)


def test_arcs_do_not_depend_on_the_corpus_size(spark, monkeypatch):
    """What is seen LEAST times is an arc however much else is learned, over several packs and ranges."""
    monkeypatch.setattr(lm, "PACK", 1 << 14)
    monkeypatch.setattr(lm, "RANGE", 1 << 13)
    rng = random.Random(9)
    pairs = [f"p{i} q{i} r{i}" for i in range(40)] * 2  # each seen twice
    rows = [(i, " ".join([rng.choice(pairs), *rng.choices("abcdefgh", k=600)])) for i in range(140)] + [(140 + i, t) for i, t in enumerate(pairs)]
    docs = documents(spark, [(k, t, "en", "s") for k, t in rows])
    got = {r.doc_id: r.score for r in lm.score(docs, F.col("doc_id") >= 0).collect()}
    plain = Plain([t for _, t in rows], lm.ORDER)
    assert all(got[k] == pytest.approx(plain.score(t)) for k, t in rows)


def test_scores_at_shipped_parameters(spark):
    """The query's own scores against the plain automaton, over all documents."""
    from sparkloom.llm.queries import op10_lm_score

    sf = "/root/testdata/sf0.001"
    rows = [(r.doc_id, (r.text or "").translate(LOWER)) for r in table(spark, sf, "documents").collect()]
    got = {r.doc_id: r for r in op10_lm_score(spark, sf).collect()}
    plain = Plain([t for k, t in rows if not got[k].held_out], lm.ORDER)
    assert len(got) == len(rows) and all(got[k].score == pytest.approx(plain.score(t)) for k, t in rows)
