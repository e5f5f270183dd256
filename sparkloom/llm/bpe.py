"""BPE encoding and decoding by tree concatenation.

A long text is cut into halves, and these again, down to blocks. Those of a text of more than DEALT characters are rows of
their own, so that many tasks encode its halves in parallel; then, level by level, two neighbours are joined in one task,
which copies their tokens and works on little text: the tokens nearest to the join are taken back, their text is encoded anew as a window, and the window grows
until its first and last tokens agree with what stands outside it. What "agree" means differs by level:

* Between pieces (the runs into which the pre-tokenizer's pattern splits a text): matching is from left to right and
  without memory, so a window from a piece's start that ends on a boundary which the right side also has, with at
  least one whole piece between it and the window's end, gives the same pieces as the whole text.
* Inside one long piece (text that the pattern does not split): a token sequence is a piece's encoding exactly if each
  token is reachable and each pair of neighbours is what encoding their joint text gives. So the window's tokens are
  right once the pairs at its two edges are. A piece over several blocks is so joined from its parts.
"""

from __future__ import annotations

import hashlib
import json
from codecs import getincrementaldecoder
from collections.abc import Iterable, Iterator
from dataclasses import dataclass
from functools import lru_cache

import numpy as np
import pandas as pd
import regex
import tiktoken
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import Scratch, frugal, scratch, tidied

#: Characters of a block that is encoded at once (longer texts are trees), and of a piece beyond which it is one.
BLOCK, PIECE = 1 << 14, 1 << 10

#: Characters of a text beyond which its blocks are dealt to many tasks; the tree of a shorter one is a single task's.
DEALT = 1 << 16

#: The splitting pattern of the vocabulary's pre-tokenizer. Fixed value.
PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"


def _byte_of_char() -> dict[str, int]:
    """The byte that each character of a byte-level vocabulary stands for: printable ones themselves, the others from 256
    on. Fixed values: these are the file format's ranges."""
    own = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    rest = [b for b in range(256) if b not in own]
    return {chr(b): b for b in own} | {chr(256 + i): b for i, b in enumerate(rest)}


@dataclass(frozen=True)
class Node:
    """A part of a text, encoded: its pieces' characters and numbers of ids, and all ids."""

    text: str
    sizes: np.ndarray
    counts: np.ndarray
    ids: np.ndarray

    @classmethod
    def of(cls, pieces: list[tuple[list[int], str]]) -> Node:
        sizes, counts = (np.array(x, np.int32) for x in ([len(p) for _, p in pieces], [len(i) for i, _ in pieces]))
        return cls("".join(p for _, p in pieces), sizes, counts, np.array([x for i, _ in pieces for x in i], np.int32))

    def pieces(self, lo: int, hi: int) -> list[tuple[list[int], str]]:
        """(ids, text) of some pieces at the start or the end."""
        sizes, counts = self.sizes[lo:hi], self.counts[lo:hi]
        at = 0 if lo == 0 else len(self.text) - int(self.sizes[lo:].sum())
        i = 0 if lo == 0 else len(self.ids) - int(self.counts[lo:].sum())
        out = []
        for size, count in zip(sizes.tolist(), counts.tolist(), strict=True):
            out.append((self.ids[i : i + count].tolist(), self.text[at : at + size]))
            at, i = at + size, i + count
        return out

    @classmethod
    def joined(cls, left: Node, keep: int, new: list[tuple[list[int], str]], right: Node, skip: int) -> Node:
        """The left's first pieces, new ones, and the right's without its first."""
        mid, i, j = cls.of(new), len(left.ids) - int(left.counts[keep:].sum()), int(right.counts[:skip].sum())
        return cls(
            left.text + right.text, np.concatenate([left.sizes[:keep], mid.sizes, right.sizes[skip:]]),
            np.concatenate([left.counts[:keep], mid.counts, right.counts[skip:]]), np.concatenate([left.ids[:i], mid.ids, right.ids[j:]]),
        )


class Codec:
    """A byte-level BPE vocabulary in the tokenizers library's file format, without normalizer or prefix space."""

    def __init__(self, path: str, block: int = BLOCK, piece: int = PIECE):
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        if spec["normalizer"] or spec["pre_tokenizer"] != {"type": "ByteLevel", "add_prefix_space": False, "trim_offsets": True, "use_regex": True}:
            raise ValueError("not a plain byte-level vocabulary")
        as_bytes = _byte_of_char()
        self.special = {x["content"]: x["id"] for x in spec["added_tokens"]}
        vocab = {bytes(as_bytes[c] for c in token): i for token, i in spec["model"]["vocab"].items() if token not in self.special}
        # ranks must follow the merges' order, and ids do so in these vocabularies
        self._bpe = tiktoken.Encoding("own", pat_str=PATTERN, mergeable_ranks=vocab, special_tokens={})
        self.texts = {i: token for token, i in vocab.items()} | {i: s.encode() for s, i in self.special.items()}
        self.block, self.piece = block, piece
        self._split = regex.compile(PATTERN)
        self._stop = regex.compile("(" + "|".join(map(regex.escape, self.special)) + ")") if self.special else None
        self._blank = regex.compile(rf"\s{{{piece},}}")

    # --- encoding

    def encode(self, text: str) -> list[int]:
        """The ids of a whole text, with the special tokens' strings as their ids."""
        out: list[int] = []
        for special, part in self.parts(text):
            out += self._plain(part) if special is None else [special]
        return out

    def _plain(self, text: str) -> list[int]:
        if len(text) <= self.block and (len(text) < self.piece or not self._unsplit(text)):
            return self._bpe.encode_ordinary(text)
        nodes = [self.leaf(part) for part in self.blocks(text)]
        while len(nodes) > 1:
            nodes = [self.joined(*nodes[i : i + 2]) if i + 1 < len(nodes) else nodes[i] for i in range(0, len(nodes), 2)]
        return nodes[0].ids.tolist()

    def _unsplit(self, text: str) -> bool:
        """Whether a piece may be long."""
        return max(map(len, text.split()), default=0) >= self.piece or self._blank.search(text) is not None

    def parts(self, text: str) -> list[tuple[int | None, str]]:
        """A text cut at special tokens: (its id, "") or (None, text between)."""
        if self._stop is None:
            return [(None, text)]
        cut = self._stop.split(text)
        return [(self.special[x], "") if i % 2 else (None, x) for i, x in enumerate(cut) if i % 2 or x]

    def blocks(self, text: str) -> list[str]:
        """The leaves of a text's tree: halves of halves, of about the same length."""
        n = 1 << max(0, -(-len(text) // self.block) - 1).bit_length()
        cuts = [len(text) * i // n for i in range(n + 1)]
        return [text[a:b] for a, b in zip(cuts, cuts[1:], strict=False)]

    def leaf(self, text: str) -> Node:
        return Node.of([(self._one(m), m) for m in self._split.findall(text)])

    def joined(self, left: Node, right: Node) -> Node:
        """Two neighbours as of their joint text. The left's last piece, and the one before it, may change."""
        keep = max(0, len(left.sizes) - 2)
        while keep and int(left.sizes[keep:].sum()) < 2:
            keep -= 1
        tail, take = left.pieces(keep, len(left.sizes)), 4
        while True:
            head = right.pieces(0, take)
            old, starts, at = tail + head, {}, 0
            for k, (_, p) in enumerate(old):
                starts[at] = k
                at += len(p)
            starts[at] = len(old)
            edge, new, pos = sum(len(p) for _, p in tail), [], 0
            window = self._split.findall("".join(p for _, p in old))
            for j, p in enumerate(window):
                if pos >= edge and pos in starts and j + 1 < len(window):  # a boundary of both, and not the window's last piece
                    return Node.joined(left, keep, new, right, starts[pos] - len(tail))
                end = pos + len(p)
                known = old[starts[pos] : starts[end]] if pos in starts and end in starts else []
                new.append((self._from(known) if known else self._one(p), p))
                pos = end
            if take >= len(right.sizes):
                return Node.joined(left, keep, new, right, len(right.sizes))
            take *= 2

    def _from(self, known: list[tuple[list[int], str]]) -> list[int]:
        """The ids of a piece from those of its parts."""
        if sum(len(p) for _, p in known) < self.piece:
            return self._one("".join(p for _, p in known))
        ids = known[0][0]
        for more, _ in known[1:]:
            ids = self._met(ids, more)
        return ids

    def _one(self, piece: str) -> list[int]:
        """The ids of one piece."""
        return self._bpe._encode_single_piece(piece.encode()) if len(piece) < self.piece else self._tree(piece.encode())

    def _tree(self, data: bytes) -> list[int]:
        """The ids of a long piece from those of its halves."""
        if len(data) <= self.piece:
            return self._bpe._encode_single_piece(data)
        mid = len(data) // 2
        return self._met(self._tree(data[:mid]), self._tree(data[mid:]))

    def _met(self, left: list[int], right: list[int]) -> list[int]:
        """The ids of a piece from those of its two parts: the window around the join grows until both sides agree."""
        width = 2
        while True:
            a, b = left[max(0, len(left) - width) :], right[:width]
            new = self._bpe._encode_single_piece(b"".join(self.texts[i] for i in a + b))
            if self._agree(left[: len(left) - len(a)][-1:], new) and self._agree(new, right[len(b) : len(b) + 1]):
                return left[: len(left) - len(a)] + new + right[len(b) :]
            width *= 2

    def _agree(self, before: list[int], after: list[int]) -> bool:
        """Whether the pair where two token sequences meet is what its joint text encodes to."""
        if not before or not after:
            return True
        pair = [before[-1], after[0]]
        return self._bpe._encode_single_piece(self.texts[pair[0]] + self.texts[pair[1]]) == pair

    # --- decoding

    def decode(self, ids) -> str:
        """The text of ids, special tokens included; bytes that are not UTF-8 become U+FFFD. Unknown ids are left out."""
        return self.bytes_of(ids).decode("utf-8", "replace")

    def bytes_of(self, ids) -> bytes:
        texts = self.texts
        return b"".join([texts.get(i, b"") for i in ids])


@lru_cache(4)
def codec(path: str) -> Codec:
    """One per Python worker."""
    return Codec(path)


def encode(text: Column, path: str) -> Column:
    """The ids of a text as array<int>; null is taken as empty."""

    @F.pandas_udf("array<int>")
    def ids(texts: pd.Series) -> pd.Series:
        c = codec(path)
        return pd.Series([np.array(c.encode(t or ""), np.int32) for t in texts], dtype=object)

    return ids(text)


def decode(ids: Column, path: str) -> Column:
    """The text of an array of ids; null and empty arrays give an empty text."""

    @F.pandas_udf("string")
    def text(lists: pd.Series) -> pd.Series:
        c = codec(path)
        return pd.Series([c.decode([] if x is None else x.tolist()) for x in lists], dtype=object)

    return text(ids)


def _digest(c: Codec, lists: Iterable[np.ndarray]) -> tuple[int, str, str]:
    """Of ids, in lists one after the other: how many, and the digests of them and of their text."""
    n, of_ids, of_text, reader = 0, hashlib.sha256(), hashlib.sha256(), getincrementaldecoder("utf-8")("replace")
    for ids in lists:
        n += len(ids)
        of_ids.update(ids.astype("<u4").tobytes())
        for at in range(0, len(ids), 1 << 20):
            of_text.update(reader.decode(c.bytes_of(ids[at : at + (1 << 20)].tolist())).encode())
    of_text.update(reader.decode(b"", True).encode())
    return n, of_ids.hexdigest(), of_text.hexdigest()


_NODE = "id long, part int, at int, nodes int, text string, sizes binary, counts binary, ids binary"


def _row(id_: int, part: int, at: int, nodes: int, node: Node) -> tuple:
    return id_, part, at, nodes, node.text, *(x.astype(np.int32).tobytes() for x in (node.sizes, node.counts, node.ids))


def _node(row) -> Node:
    return Node(row.text, *(np.frombuffer(x, np.int32) for x in (row.sizes, row.counts, row.ids)))


def trees(rows: DataFrame, path: str, tables: Scratch) -> DataFrame:
    """rows: id long, text, stored. (id, n_tokens, ids_sha256, decoded_sha256) of each, every block being encoded, and
    every two neighbours joined, by a task of their own."""
    names = [x.split()[0] for x in _NODE.split(", ")]

    def cut(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        c = codec(path)
        for batch in batches:
            for id_, text in zip(batch["id"], batch["text"], strict=True):
                for part, (special, own) in enumerate(c.parts(text)):
                    found = [own] if special is not None else c.blocks(own)
                    yield pd.DataFrame({"id": id_, "part": part, "at": range(len(found)), "nodes": len(found), "special": -1 if special is None else special, "text": found})

    def leaves(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        c = codec(path)
        for batch in batches:
            out = []
            for row in batch.itertuples(index=False):
                one = c.leaf(row.text) if row.special < 0 else Node("", *(np.array(x, np.int32) for x in ([0], [1], [row.special])))
                out.append(_row(row.id, row.part, row.at, row.nodes, one))
            yield pd.DataFrame(out, columns=names)

    def pair(two: pd.DataFrame) -> pd.DataFrame:
        a, *b = two.sort_values("at").itertuples(index=False)
        node = codec(path).joined(_node(a), _node(b[0])) if b else _node(a)
        return pd.DataFrame([_row(a.id, a.part, a.at // 2, -(-a.nodes // 2), node)], columns=names)

    def whole(parts: pd.DataFrame) -> pd.DataFrame:
        parts = parts.sort_values("part")
        made = _digest(codec(path), (np.frombuffer(x, np.int32) for x in parts["ids"]))
        return pd.DataFrame([(parts["id"].iloc[0], *made)], columns=["id", "n_tokens", "ids_sha256", "decoded_sha256"])

    blocks = rows.select("id", "text").mapInPandas(cut, "id long, part int, at int, nodes int, special int, text string")
    level = tables.stored(blocks.repartition("id", "part", "at").mapInPandas(tidied(leaves), _NODE), "level0")
    depth, ended = 0, []
    while (level.agg(F.max("nodes")).first()[0] or 0) > 1:
        depth += 1
        ended.append(level.where("nodes = 1"))
        level = level.where("nodes > 1").groupBy("id", "part", F.floor(F.col("at") / 2)).applyInPandas(lambda _, two: pair(two), _NODE)
        level = tables.stored(level, f"level{depth}")
    for more in ended:
        level = level.unionByName(more)
    return level.groupBy("id").applyInPandas(whole, "id long, n_tokens long, ids_sha256 string, decoded_sha256 string")


def digests(docs: DataFrame, path: str, key: str = "doc_id", text: str = "text") -> DataFrame:
    """Per row: key, n_tokens, ids_sha256, decoded_sha256.

    Texts of up to DEALT characters are encoded in one pass that keeps no ids, as trees if they exceed a block; of longer
    ones blocks and joins are stored on the way. Null texts are empty: no tokens, and the digests of nothing. Rows are independent, so repeated rows and ties
    repeat their results; empty tables give no rows; other columns are left out.
    """

    @F.pandas_udf("n_tokens long, ids_sha256 string, decoded_sha256 string")
    @frugal
    def run(texts: pd.Series) -> pd.DataFrame:
        c = codec(path)
        return pd.DataFrame([_digest(c, [np.array(c.encode(t or ""), np.int64)]) for t in texts], columns=["n_tokens", "ids_sha256", "decoded_sha256"])

    rows, is_long = docs.select(F.col(key).alias("key"), F.col(text).alias("text")), F.coalesce(F.length("text") > DEALT, F.lit(False))
    out = rows.where(~is_long).select("key", run("text").alias("_r")).select("key", "_r.*")
    with scratch(docs.sparkSession) as s:
        long = s.stored(rows.where(is_long).withColumn("id", F.monotonically_increasing_id()), "long")
        if long.take(1):
            found = trees(long, path, s)
            found = long.select("id", "key").join(found, "id").drop("id")
            out = out.unionByName(Scratch(docs.sparkSession).stored(found, "trees"))
    return out.withColumnRenamed("key", "_key").select(F.col("_key").alias(key), "n_tokens", "ids_sha256", "decoded_sha256")
