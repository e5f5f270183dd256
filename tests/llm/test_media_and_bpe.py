import hashlib
import math
import os
import random
import re
import zlib

import numpy as np
import public_tokenizers
import pytest
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from sparkloom.llm import bpe, jpeg, media
from sparkloom.sources.tables import table

from .helpers import documents

TEXTS = [None, "", "a", "a", "é" * 70, "x" * 64, "\x00\x01", "word " * 30_000, "\U0001f600 z", "tail"]
VOCABULARY = public_tokenizers.path("byte_bpe_50k.json")


# --- progressive JPEG


@pytest.mark.parametrize("n", [0, 1, 62, 63, 64, 126, 383, 384, 385, 4096, 4097, 300_000])
def test_payload_round_trip(n):
    data = os.urandom(n)
    file = jpeg.encode(data)
    image = jpeg.decode(file)
    assert jpeg.payload(image) == data and image.size == len(file)
    assert image.rgb().shape == (image.height, image.width, 3)


def test_payloads_with_many_zeros():
    """Coefficients of 0, 1 and -1: runs, ends of blocks and coefficients that a refinement adds."""
    rng = np.random.default_rng(1)
    payloads = [rng.choice(np.array([128] * 9 + [127, 129, 130, 60], np.uint8), n).tobytes() for n in rng.integers(1, 3000, 60)]
    payloads += [t.encode() for t in ("\U00010000" * 500, "\x7f\u0080\u0100" * 300, "\u0800" * 900)] + [b"\x80" * 5000]
    files = jpeg.encode_many(payloads)
    assert files == [jpeg.encode(p) for p in payloads]
    assert [jpeg.payload(x) for x in jpeg.decode_many(files)] == payloads


def test_parts_of_a_long_payload_fit_together(monkeypatch):
    data = random.Random(1).randbytes(jpeg.WIDE * jpeg.UNIT * 5 + 1000)
    whole = jpeg.encode(data)
    monkeypatch.setattr(jpeg, "BATCH", 2 * jpeg.WIDE * jpeg.UNIT)
    assert jpeg.encode(data) == whole and jpeg.payload(jpeg.decode(whole)) == data
    with pytest.raises(ValueError):
        monkeypatch.setattr(jpeg, "MOST", len(data) - 1)
        jpeg.encode(data)


class Reader:
    """A plain decoder, a bit and a block at a time, for files without runs of blocks."""

    def __init__(self, data):
        self.tables, self.scans, self.shape, self.comment = {}, [], None, b""
        at = 2
        while data[at + 1] != 0xD9:
            kind, size = data[at + 1], int.from_bytes(data[at + 2 : at + 4], "big")
            body, at = data[at + 4 : at + 2 + size], at + 2 + size
            if kind == 0xC4:
                while body:
                    n, code, i, table = sum(body[1:17]), 0, 17, {}
                    for length in range(1, 17):
                        for _ in range(body[length]):
                            table[f"{code:0{length}b}"] = body[i]
                            code, i = code + 1, i + 1
                        code <<= 1
                    self.tables[body[0]], body = table, body[17 + n :]
            elif kind == 0xC2:
                self.shape = int.from_bytes(body[1:3], "big") // 16, int.from_bytes(body[3:5], "big") // 16
            elif kind == 0xDD:
                self.restart = int.from_bytes(body, "big")
            elif kind == 0xFE:
                self.comment = body
            elif kind == 0xDA:
                end = at
                while data[end] != 0xFF or data[end + 1] == 0 or 0xD0 <= data[end + 1] <= 0xD7:
                    end += 1
                self.scans.append((body, re.split(b"\xff[\xd0-\xd7]", data[at:end])))
                at = end

    def units(self):
        rows, cols = self.shape
        planes = {1: np.zeros((2 * rows, 2 * cols, 64), int), 2: np.zeros((rows, cols, 64), int), 3: np.zeros((rows, cols, 64), int)}
        for body, pieces in self.scans:
            ids = [body[1 + 2 * i] for i in range(body[0])]
            use = {i: body[2 + 2 * j] for j, i in enumerate(ids)}
            (ss, se, a), at = body[-3:], 0
            high, low = a >> 4, a & 15
            if len(ids) > 1:
                units = [[(1, 2 * y + i, 2 * x + j) for i in (0, 1) for j in (0, 1)] + [(2, y, x), (3, y, x)] for y in range(rows) for x in range(cols)]
            else:
                h, w = planes[ids[0]].shape[:2]
                units = [[(ids[0], y, x)] for y in range(h) for x in range(w)]
            for piece in pieces:
                self.bits, self.at = "".join(f"{b:08b}" for b in piece.replace(b"\xff\x00", b"\xff")), 0
                last = dict.fromkeys(ids, 0)
                for unit in units[at : at + self.restart]:
                    for i, y, x in unit:
                        block = planes[i][y, x]
                        if ss == 0 and high:
                            block[0] |= self.take(1) << low
                        elif ss == 0:
                            last[i] += self.signed(self.symbol(use[i] >> 4))
                            block[0] = last[i] << low
                        elif high:
                            self.refined(block, 0x10 | use[i] & 15, ss, se)
                        else:
                            self.first(block, 0x10 | use[i] & 15, ss, se, low)
                at += self.restart
        return planes

    def take(self, n):
        self.at += n
        return int(self.bits[self.at - n : self.at] or "0", 2)

    def signed(self, n):
        v = self.take(n)
        return v if not n or v >> (n - 1) else v - (1 << n) + 1

    def symbol(self, table):
        code = ""
        while code not in self.tables[table]:
            code += self.bits[self.at]
            self.at += 1
        return self.tables[table][code]

    def first(self, block, table, ss, se, low):
        k = ss
        while k <= se:
            zeros, n = divmod(self.symbol(table), 16)
            if not n and zeros < 15:
                return
            k += zeros
            if n:
                block[k] = self.signed(n) * (1 << low)
            k += 1

    def refined(self, block, table, ss, se):
        k = ss
        while k <= se:
            zeros, n = divmod(self.symbol(table), 16)
            new = 0 if not n else 1 if self.take(1) else -1
            if not n and zeros < 15:
                zeros = 64
            while k <= se:
                if block[k]:
                    block[k] += self.take(1) * (1 if block[k] > 0 else -1)
                elif zeros:
                    zeros -= 1
                else:
                    block[k] = new
                    k += 1
                    break
                k += 1


def test_own_files_by_a_plain_decoder(spark, sf):
    """What op7 stores is read by a decoder of its own: payload, pixels and feature."""
    texts = ["Grüße, world! " * 40, "x", "漢字 " * 300, *[r.text for r in table(spark, sf, "documents").where("length(text) < 3000").limit(6).collect()]]
    got = {r.doc_id: r for r in media.digests(documents(spark, [(i, t, "en", "s") for i, t in enumerate(texts)])).collect()}
    u = np.arange(8)
    basis = np.where(u == 0, np.sqrt(1 / 8), 0.5)[:, None] * np.cos((2 * u[None] + 1) * u[:, None] * np.pi / 16)
    for i, text in enumerate(texts):
        data = media.padded(text.encode())
        file = media.stored([data])[0]
        reader = Reader(file)
        planes = reader.units()
        assert len(reader.scans) == 7 and reader.tables.keys() == {0, 0x10, 0x11}
        rows, cols = reader.shape
        units = np.concatenate([np.concatenate([planes[1][2 * y + a, 2 * x + b][None] for a in (0, 1) for b in (0, 1)] + [planes[2][y, x][None], planes[3][y, x][None]]) for y in range(rows) for x in range(cols)])
        assert (units + 128).astype(np.uint8).tobytes()[: len(data)] == data and int.from_bytes(reader.comment, "big") == len(data)
        samples = []
        for plane in planes.values():
            f = np.zeros(plane.shape)
            f[..., jpeg.ZIGZAG] = plane
            s = np.clip(np.rint(basis.T @ f.reshape(*plane.shape[:2], 8, 8) @ basis + 128), 0, 255)
            s = s.swapaxes(1, 2).reshape(plane.shape[0] * 8, -1)
            samples.append(s if len(samples) == 0 else s.repeat(2, 0).repeat(2, 1))
        y, cb, cr = samples
        rgb = np.clip(np.rint(np.stack([y + 1.402 * (cr - 128), y - 0.344136 * (cb - 128) - 0.714136 * (cr - 128), y + 1.772 * (cb - 128)], -1)), 0, 255)
        mine = jpeg.decode(file).rgb()
        assert np.abs(rgb - mine).max() <= 2
        assert got[i].rgb_sha256 == hashlib.sha256(mine.tobytes()).hexdigest()
        steps = int(np.abs(np.diff(mine[..., 0].astype(int), axis=1)).sum()) // (rows * cols * 256)
        means = [int(v) // (rows * cols * 256) for v in mine.reshape(-1, 3).sum(0, dtype=int)]
        assert got[i].feature == f"1:{rows * 16}x{cols * 16}:{','.join(map(str, means))}:{steps}"


class Writer:
    """A plain bit writer for hand-made scans."""

    def __init__(self):
        self.bits = ""

    def put(self, value, n):
        self.bits += f"{value:0{n}b}" if n else ""

    def signed(self, v):
        n = abs(v).bit_length()
        self.put(v if v > 0 else v + (1 << n) - 1, n)

    def done(self):
        bits = self.bits + "1" * (-len(self.bits) % 8)
        return bytes(int(bits[i : i + 8], 2) for i in range(0, len(bits), 8)).replace(b"\xff", b"\xff\x00")


def plain_file(planes, quant, width, height, sampling, restart=0):
    """A progressive file of coefficient planes (rows, columns, 64 zigzag): DC with and without its lowest bit, AC in two
    bands, the second by successive approximation with new coefficients, zero runs and end-of-band runs."""
    code = lambda s: (s, 8)  # noqa: E731  a code of 8 bits for each symbol below 255
    table_ = jpeg._table(0x00, 8, bytes(range(16))) + jpeg._table(0x10, 8, bytes(range(255)))
    hm, vm = max(h for h, _ in sampling), max(v for _, v in sampling)
    wide, high = -(-width // (8 * hm)), -(-height // (8 * vm))
    out = b"\xff\xd8" + jpeg._segment(0xDB, b"\x00" + bytes(quant)) + jpeg._segment(0xC4, table_)
    if restart:
        out += jpeg._segment(0xDD, restart.to_bytes(2, "big"))
    parts = b"".join(bytes([i + 1, h << 4 | v, 0]) for i, (h, v) in enumerate(sampling))
    out += jpeg._segment(0xC2, b"\x08" + height.to_bytes(2, "big") + width.to_bytes(2, "big") + bytes([len(planes)]) + parts)
    ids = [bytes([i + 1, 0]) for i in range(len(planes))]

    def scan(head, pieces):
        body = b"".join(p + (bytes([0xFF, 0xD0 + i % 8]) if i + 1 < len(pieces) else b"") for i, p in enumerate(pieces))
        return jpeg._segment(0xDA, head) + body

    def mcus():
        if len(planes) == 1:
            h, v = -(-height // 8), -(-width // 8)
            return [[(0, y, x)] for y in range(h) for x in range(v)]
        return [[(i, my * v + y, mx * h + x) for i, (h, v) in enumerate(sampling) for y in range(v) for x in range(h)] for my in range(high) for mx in range(wide)]

    order, step = mcus(), restart or 10**9
    groups = [order[i : i + step] for i in range(0, len(order), step)]
    first, second = [], []
    for group in groups:
        w, last = Writer(), [0] * len(planes)
        for mcu in group:
            for i, y, x in mcu:
                v = int(planes[i][y, x, 0]) >> 1
                d, last[i] = v - last[i], v
                w.put(*code(abs(d).bit_length()))
                w.signed(d) if d else None
        first.append(w.done())
        w = Writer()
        for mcu in group:
            for i, y, x in mcu:
                w.put(int(planes[i][y, x, 0]) & 1, 1)
        second.append(w.done())
    head = bytes([len(planes)]) + b"".join(ids)
    out += scan(head + b"\x00\x00\x01", first) + scan(head + b"\x00\x00\x10", second)
    for i, plane in enumerate(planes):
        h, v = sampling[i]
        rows, cols = -(-height * v // (8 * vm)), -(-width * h // (8 * hm))
        blocks = plane[:rows, :cols].reshape(-1, 64)
        cut = [blocks[j : j + step] for j in range(0, len(blocks), step)]
        for ss, se, low in ((1, 5, 0), (6, 63, 1)):
            pieces = []
            for part in cut:
                w, run = Writer(), 0

                def flush():
                    nonlocal run
                    if run:
                        e = run.bit_length() - 1
                        w.put(*code(e << 4))
                        w.put(run - (1 << e), e)
                        run = 0

                for block in part:
                    zeros = 0
                    values = [int(math.copysign(abs(int(c)) >> low, int(c))) if abs(int(c)) >> low else 0 for c in block[ss : se + 1]]
                    held = max([k for k, c in enumerate(values) if c], default=-1)
                    for c in values[: held + 1]:
                        if not c:
                            zeros += 1
                            continue
                        flush()
                        while zeros > 15:
                            w.put(*code(0xF0))
                            zeros -= 16
                        w.put(*code(zeros << 4 | abs(c).bit_length()))
                        w.signed(c)
                        zeros = 0
                    if held < len(values) - 1:
                        run += 1
                        if run == 32767:
                            flush()
                    else:
                        flush()
                flush()
                pieces.append(w.done())
            out += scan(bytes([1]) + ids[i] + bytes([ss, se, low]), pieces)
        pieces = []
        for part in cut:  # the refinement of the second band: no runs of blocks here, each ends its own band
            w = Writer()
            for block in part:
                values = [abs(int(c)) for c in block[6:]]
                new = max([k for k, c in enumerate(values) if c == 1], default=-1)
                zeros, waiting = 0, []
                for k, c in enumerate(values):
                    if k > new:
                        break
                    if c > 1:
                        waiting.append(c & 1)
                    elif c == 0:
                        if zeros == 15:
                            w.put(*code(0xF0))
                            for b in waiting:
                                w.put(b, 1)
                            zeros, waiting = 0, []
                            continue
                        zeros += 1
                    else:
                        w.put(*code(zeros << 4 | 1))
                        w.put(int(block[6 + k] > 0), 1)
                        for b in waiting:
                            w.put(b, 1)
                        zeros, waiting = 0, []
                if new < len(values) - 1:
                    w.put(*code(0))
                    for b in waiting + [c & 1 for c in values[new + 1 :] if c > 1]:
                        w.put(b, 1)
            pieces.append(w.done())
        out += scan(bytes([1]) + ids[i] + b"\x06\x3f\x10", pieces)
    return out + b"\xff\xd9"


@pytest.mark.parametrize("sampling", [[(1, 1)], [(2, 2), (1, 1), (1, 1)], [(2, 1), (1, 1), (1, 1)], [(1, 1)] * 3])
@pytest.mark.parametrize("restart", [0, 3])
def test_general_scans(sampling, restart):
    rng = np.random.default_rng(7)
    for width, height, fill in ((37, 21, 0.1), (64, 16, 0.6), (8, 8, 0.0)):
        hm, vm = max(h for h, _ in sampling), max(v for _, v in sampling)
        planes = []
        for h, v in sampling:
            shape = (-(-height // (8 * vm)) * v, -(-width // (8 * hm)) * h, 64)
            p = np.where(rng.random(shape) < fill, rng.integers(-9, 10, shape), 0)
            p[..., 0] = rng.integers(-200, 200, shape[:2])
            rows, cols = -(-height * v // (8 * vm)), -(-width * h // (8 * hm))
            p[rows:, :, 1:], p[:, cols:, 1:] = 0, 0  # padding blocks have no AC
            if len(sampling) == 1:
                p[rows:], p[:, cols:] = 0, 0
            planes.append(p)
        quant = rng.integers(1, 5, 64).tolist()
        image = jpeg.decode(plain_file(planes, quant, width, height, sampling, restart))
        for c, p in zip(image.components.values(), planes, strict=True):
            assert (c.coef == p).all()
        rgb, samples = image.rgb().astype(int), []
        for c, (h, v) in zip(image.components.values(), sampling, strict=True):
            plane = np.zeros((c.coef.shape[0] * 8, c.coef.shape[1] * 8))
            u = np.arange(8)
            basis = np.where(u == 0, np.sqrt(1 / 8), 0.5)[:, None] * np.cos((2 * u[None] + 1) * u[:, None] * np.pi / 16)
            for y in range(c.coef.shape[0]):
                for x in range(c.coef.shape[1]):
                    f = np.zeros(64)
                    f[jpeg.ZIGZAG] = c.coef[y, x] * np.array(quant)
                    plane[8 * y : 8 * y + 8, 8 * x : 8 * x + 8] = basis.T @ f.reshape(8, 8) @ basis + 128
            samples.append(np.clip(plane, 0, 255).repeat(vm // v, 0).repeat(hm // h, 1)[:height, :width])
        y, cb, cr = samples if len(samples) == 3 else (samples[0], 128, 128)
        want = np.stack([y + 1.402 * (cr - 128), y - 0.344136 * (cb - 128) - 0.714136 * (cr - 128), y + 1.772 * (cb - 128)], axis=-1)
        assert np.abs(rgb - np.clip(want, 0, 255)).max() <= 2


def test_other_files_are_refused():
    for bad in (b"", b"GIF89a", jpeg.encode(b"x").replace(b"\xff\xc2", b"\xff\xc0"), b"\xff\xd8\xff\xd9"):
        with pytest.raises(ValueError):
            jpeg.decode(bad)


def test_media_digests(spark):
    got = media.digests(documents(spark, [(i if i else None, t, "en", "s") for i, t in enumerate(TEXTS)], clashing=True)).collect()
    assert len(got) == len(TEXTS)
    by_key = {r.doc_id or 0: r for r in got}
    for i, t in enumerate(TEXTS):
        b = (t or "").encode()
        p = b + bytes(max(64, -(-len(b) // 64) * 64) - len(b))
        r = by_key[i]
        assert (r.n_bytes, r.payload_bytes, r.payload_sha256, r.tail_crc32) == (len(b), len(p), hashlib.sha256(p).hexdigest(), zlib.crc32(p[-64:]))
        file = media.stored([p])[0]
        assert (r.media_bytes, r.media_sha256) == (len(file), hashlib.sha256(file).hexdigest())
    assert by_key[2][1:] == by_key[3][1:] and by_key[2].feature != by_key[7].feature
    assert media.digests(documents(spark, [])).count() == 0


def test_media_in_segments(spark, monkeypatch):
    monkeypatch.setattr(media, "SEGMENT", 256)
    data = os.urandom(1000)
    parts, other = media.images(media.stored([media.padded(data), bytes(64)]))
    assert len(parts) == 4 and b"".join(jpeg.payload(p) for p in parts) == media.padded(data) and len(other) == 1


def test_tensors(spark):
    rows = media.with_media(documents(spark, [(1, "hello " * 100, "en", "s"), (2, None, "en", "s")]))
    got = media.tensors(rows).collect()
    assert len(got) == 2 and all(len(r.rgb) == r.height * r.width * 3 for r in got)
    digest = {r.doc_id: r.rgb_sha256 for r in media.measured(rows).collect()}
    assert all(hashlib.sha256(r.rgb).hexdigest() == digest[r.doc_id] for r in got)
    assert media.measured(rows.withColumn("media", F.lit(None).cast("binary"))).first().feature is None


# --- BPE


@pytest.fixture(scope="module")
def library():
    return Tokenizer.from_file(VOCABULARY)


def pieces(rng):
    parts = ["the", "Anthe", " ", "  ", "\n", "\t", "'s", "'ll", "'", "re", "é", "ß", "12", "345", "###", "<|endoftext|>", "<|endo", "ftext|>", "\U0001f600", "a", "　", "漢字", "\x85", "​", "!", "é", "�", "\x00"]
    kind = rng.random()
    if kind < 0.6:
        return "".join(rng.choices(parts, k=rng.randint(0, 150)))
    if kind < 0.85:
        return "".join(rng.choices("abcdthenr", k=rng.randint(0, 400)))
    return rng.choice([" ", "a", "\n", "1", "é", "ab", "'", "!"]) * rng.randint(0, 400)


@pytest.mark.parametrize(("block", "piece"), [(24, 8), (40, 12), (100, 300), (1 << 16, 1 << 10)])
def test_trees_equal_the_library(library, block, piece):
    codec, rng = bpe.Codec(VOCABULARY, block, piece), random.Random(block)
    for _ in range(400):
        text = pieces(rng)
        ids = library.encode(text, add_special_tokens=False).ids
        assert codec.encode(text) == ids
        assert codec.decode(ids) == library.decode(ids, skip_special_tokens=False)


def test_decoding_of_broken_bytes(library):
    codec, rng = bpe.Codec(VOCABULARY), random.Random(9)
    for _ in range(300):
        ids = rng.choices(range(50_257), k=rng.randint(0, 12))
        assert codec.decode(ids) == library.decode(ids, skip_special_tokens=False)


def test_long_unsplit_text(library):
    text = "".join(random.Random(2).choices("abcdefgh", k=150_000))
    assert bpe.Codec(VOCABULARY).encode(text) == library.encode(text, add_special_tokens=False).ids


def expected(library, text):
    ids = library.encode(text or "", add_special_tokens=False).ids
    back = library.decode(ids, skip_special_tokens=False)
    return len(ids), hashlib.sha256(np.array(ids, "<u4").tobytes()).hexdigest(), hashlib.sha256(back.encode()).hexdigest()


def test_digests(spark, sf, library):
    rows = [(i if i else None, t, "en", "s") for i, t in enumerate(TEXTS + ["<|endoftext|> a<|endoftext|>"])]
    got = {r.doc_id or 0: tuple(r)[1:] for r in bpe.digests(documents(spark, rows, clashing=True), VOCABULARY).collect()}
    assert got == {k or 0: expected(library, t) for k, t, _, _ in rows}
    docs = table(spark, sf, "documents")
    texts = {r.doc_id: r.text for r in docs.collect()}
    assert all(tuple(r)[1:] == expected(library, texts[r.doc_id]) for r in bpe.digests(docs, VOCABULARY).collect())
    assert bpe.digests(documents(spark, []), VOCABULARY).count() == 0


def test_trees_of_long_texts(spark, library, monkeypatch):
    """Texts over a block, of words, of one long piece and with special tokens, through the DataFrame: every block and
    every join is a row's work."""
    monkeypatch.setattr(bpe, "DEALT", bpe.BLOCK)
    rng = random.Random(3)
    texts = [
        "".join(rng.choices("abcdefgh", k=200_000)), " " * 70_000, "word " * 20_000, "a" * 33_000 + "<|endoftext|>" + "b c " * 9000 + "<|endoftext|>",
        "".join(rng.choice(["the ", "é", "\n\n ", "12", "'ll", " \U0001f600"]) for _ in range(40_000)), "x" * bpe.BLOCK, "x" * (bpe.BLOCK + 1),
    ]
    rows = [(i % 6, t, "en", "s") for i, t in enumerate(texts + texts[:1] + ["short", None])]
    got = sorted(tuple(r) for r in bpe.digests(documents(spark, rows, clashing=True), VOCABULARY).collect())
    assert got == sorted((k, *expected(library, t)) for k, t, _, _ in rows)


def test_a_long_piece_is_joined_from_its_parts(library, monkeypatch):
    """Joins re-encode windows, not whole pieces."""
    text, seen = "".join(random.Random(5).choices("abcdefgh", k=60_000)), []
    codec = bpe.Codec(VOCABULARY, 1 << 12)
    nodes, plain = [codec.leaf(b) for b in codec.blocks(text)], codec._bpe

    class Watched:
        def _encode_single_piece(self, data):
            seen.append(len(data))
            return plain._encode_single_piece(data)

    codec._bpe = Watched()
    while len(nodes) > 1:
        nodes = [codec.joined(a, b) for a, b in zip(nodes[::2], nodes[1::2], strict=True)]
    assert nodes[0].ids.tolist() == library.encode(text, add_special_tokens=False).ids
    assert sum(seen) < len(text) / 10


def test_columns(spark, library):
    df = documents(spark, [(1, "The cat's <|endoftext|>", "en", "s"), (2, None, "en", "s")]).withColumn("ids", bpe.encode(F.col("text"), VOCABULARY))
    rows = {r.doc_id: r for r in df.withColumn("back", bpe.decode(F.col("ids"), VOCABULARY)).collect()}
    assert rows[1].ids == library.encode("The cat's <|endoftext|>", add_special_tokens=False).ids and rows[1].back == rows[1].text
    assert rows[2].ids == [] and rows[2].back == ""
