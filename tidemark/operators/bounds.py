"""Broadcasts behind a check of their size."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

BROADCAST_BYTES = 32 << 20


def small(df: DataFrame, rows: int, row_bytes: int) -> DataFrame:
    """df with a broadcast hint if rows of such a size stay below the bound; else a join
    with it is left to the optimizer."""
    return F.broadcast(df) if rows * row_bytes <= BROADCAST_BYTES else df
