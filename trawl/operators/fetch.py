"""Rows by their keys from tables stored in the order of those keys.

The keys are known on the driver, a bounded number.  They become a few ranges
that the Parquet reader holds against the least and greatest values of row
groups and pages, besides the exact test on what is left: a look-up reads the
pages around its keys, however long the table is.
"""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Ranges of keys in one look-up, at most; ids that are written together.
RANGES, WRITTEN_IDS = 64, 4096


def ranges(keys: Iterable, most: int = RANGES) -> list[tuple]:
    """(first, last) of at most `most` ranges that hold all keys, parted at the widest gaps between numbers, evenly between others."""
    known = sorted(set(keys))
    if len(known) <= 1 or most <= 1:
        return [(known[0], known[-1])] if known else []
    if isinstance(known[0], str):
        size = -(-len(known) // most)
        return [(known[i], known[min(i + size, len(known)) - 1]) for i in range(0, len(known), size)]
    cuts = sorted(sorted(range(1, len(known)), key=lambda i: known[i - 1] - known[i])[: most - 1])
    return [(known[a], known[b - 1]) for a, b in zip([0, *cuts], [*cuts, len(known)], strict=True)]


def near(column: str, keys: Iterable) -> Column:
    """That a column's value lies in one of few ranges that hold all keys, told so that scans can skip: a join with the keys has to follow."""
    found = F.lit(False)
    known = set(keys)
    for first, last in ranges(known, RANGES if not isinstance(next(iter(known), 0), str) else RANGES // 4):
        found = found | F.col(column).between(first, last)
    return found


def in_id_order(table: DataFrame, key: str = "chunk_id") -> DataFrame:
    """table, to be written so that ids near each other are: blocks of WRITTEN_IDS ids stay together, and no sample has to be drawn for it."""
    return table.repartition(F.floor(F.col(key) / WRITTEN_IDS)).sortWithinPartitions(key)
