"""CRC-32C, which Spark lacks (its crc32 is that of IEEE 802.3)."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

#: The reflected polynomial of Castagnoli. Fixed value.
POLYNOMIAL = 0x82F63B78


def _table() -> np.ndarray:
    t = np.arange(256, dtype=np.uint32)
    for _ in range(8):
        t = np.where(t & 1, t >> 1 ^ np.uint32(POLYNOMIAL), t >> 1).astype(np.uint32)
    return t


_TABLE = _table()


def crc32c_of(values: list[bytes]) -> np.ndarray:
    """The checksums of many byte strings: longest first, all of those that reach a place take its step together."""
    sizes = np.array([len(v) for v in values])
    order = np.argsort(-sizes, kind="stable")
    crc = np.full(len(values), 0xFFFFFFFF, np.uint32)
    if len(values):
        data = np.frombuffer(b"".join(values[i] for i in order), np.uint8)
        sizes = sizes[order]
        start, left = np.cumsum(sizes) - sizes, np.searchsorted(-sizes, -np.arange(sizes[0]), side="left")
        for place, n in enumerate(left.tolist()):
            crc[:n] = _TABLE[(crc[:n] ^ data[start[:n] + place]) & 0xFF] ^ crc[:n] >> np.uint32(8)
    out = np.empty(len(values), np.uint32)
    out[order] = crc ^ np.uint32(0xFFFFFFFF)
    return out


def crc32c(value: Column) -> Column:
    """CRC-32C of a binary or string column as an unsigned number in a long; null stays null."""

    @F.pandas_udf("long")
    def run(values: pd.Series) -> pd.Series:
        there = values.notna().to_numpy()
        out = pd.Series([None] * len(values), dtype="Int64")
        out[there] = crc32c_of([bytes(v) for v in values[there]]).astype(np.int64)
        return out

    return run(value.cast("binary"))
