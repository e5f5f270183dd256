"""Identifiers of pages, records, log places, transactions, nodes and terms, and how they are shown."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Sentinels of an invalid identifier. Fixed values; they read as null.
INVALID = {"page": (1 << 32) - 1, "lsn": 0, "tx": 0, "node": 0, "partition": 0}


def valid(kind: str, value: Column) -> Column:
    """The identifier as a long, or null if it is the kind's sentinel. A term has none: 0 is valid."""
    value = value.cast("long")
    return F.when(value != INVALID[kind], value) if kind in INVALID else value


def record_id(page: Column, slot: Column) -> Column:
    """A record's place; structs are ordered by page, then slot."""
    return F.struct(valid("page", page).alias("page_id"), slot.cast("int").alias("slot"))


def shown(kind: str, value: Column) -> Column:
    """As text: Page(1), LSN(100), RID(1:0) and the like; null stays null."""
    if kind == "record":
        return F.when(value.isNotNull(), F.concat(F.lit("RID("), value.page_id.cast("string"), F.lit(":"), value.slot.cast("string"), F.lit(")")))
    name = {"page": "Page", "lsn": "LSN", "tx": "Tx", "node": "Node", "partition": "Partition", "term": "Term"}[kind]
    return F.concat(F.lit(f"{name}("), valid(kind, value).cast("string"), F.lit(")"))
