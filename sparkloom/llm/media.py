"""Media columns: texts as progressive JPEG files in a binary column, read back to bytes and RGB tensors."""

from __future__ import annotations

import hashlib
import zlib
from collections.abc import Iterator, Sequence

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import jpeg
from .common import frugal

#: Payloads are padded to a multiple of this. Fixed by the contract.
PAD = 64

#: Bytes of payload in one image; longer payloads are several images, one after the other, which bounds memory.
SEGMENT = 16 << 20


def padded(data: bytes) -> bytes:
    """With zeros up to a positive multiple of PAD."""
    return data + bytes(max(PAD, -(-len(data) // PAD) * PAD) - len(data))


def stored(payloads: Sequence[bytes]) -> list[bytes]:
    """The media of each payload."""
    cuts = [[p[i : i + SEGMENT] for i in range(0, max(1, len(p)), SEGMENT)] for p in payloads]
    files = iter(jpeg.encode_many([part for parts in cuts for part in parts]))
    return [b"".join(next(files) for _ in parts) for parts in cuts]


def images(media: Sequence[bytes]) -> Iterator[list[jpeg.Image]]:
    """The images of each file, in order."""
    for batch in jpeg.batches(media):
        first = jpeg.decode_many(batch)
        for file, image in zip(batch, first, strict=True):
            found, at = [image], image.size
            while at < len(file):
                found.append(jpeg.decode(file[at:]))
                at += found[-1].size
            yield found


def with_media(docs: DataFrame, text: str = "text") -> DataFrame:
    """Replaces the text by n_bytes and media. Null texts are empty; other columns stay, save those two names."""
    kept = [c for c in docs.columns if c not in (text, "n_bytes", "media")]

    @F.pandas_udf("n_bytes long, media binary")
    @frugal
    def made(texts: pd.Series) -> pd.DataFrame:
        data = [(t or "").encode("utf-8", "surrogatepass") for t in texts]
        return pd.DataFrame({"n_bytes": [len(d) for d in data], "media": stored([padded(d) for d in data])})

    return docs.select(*[docs[f"`{c}`"] for c in kept], made(F.col(text)).alias("_m")).select(*[f"`{c}`" for c in kept], "_m.*")


def tensors(rows: DataFrame, media: str = "media") -> DataFrame:
    """Per image of each row's media: its number, height, width and rgb (height x width x 3 bytes), beside the other
    columns. A null media has no image."""
    kept = [c for c in rows.columns if c != media]

    @F.pandas_udf("array<struct<image:int,height:int,width:int,rgb:binary>>")
    def read(files: pd.Series) -> pd.Series:
        found = images([bytes(f) for f in files if f is not None])
        return pd.Series([[] if f is None else [{"image": i, "height": x.height, "width": x.width, "rgb": x.rgb().tobytes()} for i, x in enumerate(next(found))] for f in files])

    return rows.select(*[f"`{c}`" for c in kept], F.explode(read(F.col(media))).alias("_i")).select(*[f"`{c}`" for c in kept], "_i.*")


def _feature(shapes: list[tuple[int, int]], sums: np.ndarray, steps: int) -> str:
    """Images, the first one's size, the mean of each channel and of red neighbours' differences: whole numbers."""
    pixels = sum(h * w for h, w in shapes)
    means = [int(v // pixels) for v in sums]
    return f"{len(shapes)}:{shapes[0][0]}x{shapes[0][1]}:{means[0]},{means[1]},{means[2]}:{steps // pixels}"


def measured(rows: DataFrame, media: str = "media") -> DataFrame:
    """Reads media back: payload_bytes, payload_sha256, tail_crc32, media_bytes, media_sha256, feature and rgb_sha256 (of
    the tensors' bytes), beside the other columns. All are null where the media is null."""
    kept = [c for c in rows.columns if c != media]
    kind = "payload_bytes long, payload_sha256 string, tail_crc32 long, media_bytes long, media_sha256 string, feature string, rgb_sha256 string"

    def one(file: bytes, found: list[jpeg.Image]) -> tuple:
        digest, pixels, size, tail = hashlib.sha256(), hashlib.sha256(), 0, b""
        sums, steps = np.zeros(3, np.int64), 0
        for image in found:
            part = jpeg.payload(image)
            digest.update(part)
            size, tail = size + len(part), (tail + part[-PAD:])[-PAD:]
            for strip in image.strips():
                pixels.update(strip.tobytes())
                sums += strip.reshape(-1, 3).sum(0, dtype=np.int64)
                red = strip[..., 0].astype(np.int16)
                steps += int(np.abs(red[:, 1:] - red[:, :-1]).sum(dtype=np.int64))
        feature = _feature([(x.height, x.width) for x in found], sums, steps)
        return size, digest.hexdigest(), zlib.crc32(tail), len(file), hashlib.sha256(file).hexdigest(), feature, pixels.hexdigest()

    @F.pandas_udf(kind)
    @frugal
    def read(files: pd.Series) -> pd.DataFrame:
        found = images([bytes(f) for f in files if f is not None])
        out = [(None,) * 7 if f is None else one(bytes(f), next(found)) for f in files]
        return pd.DataFrame(out, columns=[c.split()[0] for c in kind.split(", ")])

    return rows.select(*[f"`{c}`" for c in kept], read(F.col(media)).alias("_r")).select(*[f"`{c}`" for c in kept], "_r.*")


def digests(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """Per row: key, n_bytes and what measured() gives.

    The bytes measured are those read back from the stored media. Null and empty texts store 64 zero bytes. Rows are
    independent: repeated rows and ties repeat their results, equal texts give equal values, empty tables no rows, and
    other columns are left out. A text of more than SEGMENT bytes is stored in several images.
    """
    return measured(with_media(docs.select(F.col(key).alias(key), F.col(text).alias("text"))))
