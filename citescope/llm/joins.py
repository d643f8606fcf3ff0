"""Joins of wide documents with narrow tables."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

BROADCAST_BYTES = 8 << 20


def broadcast_if_small(side: DataFrame, row_bytes: int, limit: int = BROADCAST_BYTES) -> DataFrame:
    """``side`` with a broadcast hint if its measured rows x ``row_bytes`` stay within ``limit``,
    else as it is (a shuffle join with the same result). Wide documents then need no exchange
    while the other side is small; its size is counted, never assumed."""
    return F.broadcast(side) if side.count() * row_bytes <= limit else side


def join_exploded(exploded: DataFrame, side: DataFrame, on: str, row_bytes: int) -> DataFrame:
    """Inner join of rows made by explode with ``side``, which is broadcast if measured small;
    the exploded rows never are (the planner takes them for as few as their source has)."""
    hinted = broadcast_if_small(side, row_bytes)
    return (exploded if hinted is not side else exploded.hint("merge")).join(hinted, on)
