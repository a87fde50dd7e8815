"""Running values of ordered rows, for keys of any size.

A window over a key puts all its rows into one task. Here rows are range-partitioned by key
and order, so that a key with half of all rows lies in half of the partitions; values run
inside each piece of a key, and only one row a piece (its count, its last value) meets to
tell the pieces what came before.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidemark.sources.shared import save

_AT, _PIECE = "segment at", "segment piece"


def streamed(df: DataFrame, keys: list[str], *order: Column | str) -> DataFrame:
    """df dealt by keys, each key whole in one part and in order, for a task that carries
    something on from row to row. Rows are dealt by a hash of the keys: a plain repartition
    by the keys of a join below it is left out as done, and the join's parts may then be cut
    or read as they were written, which takes the rows of a key apart."""
    return df.repartition(F.xxhash64(*keys)).sortWithinPartitions(*keys, *order)


def _pieces(df: DataFrame, keys: list[str], order: list[Column | str]) -> DataFrame:
    """df stored in order of keys and order, numbered, with the piece that each row lies in.
    Rows alike in all of these are dealt by their place in the table that is stored first."""
    kept = save(df, "segments").withColumn(_AT, F.monotonically_increasing_id())
    by = [*(F.col(k).asc_nulls_first() for k in keys), *order, F.col(_AT)]
    dealt = kept.repartitionByRange(*by).sortWithinPartitions(*by).withColumn(_AT, F.monotonically_increasing_id())
    return save(dealt.withColumn(_PIECE, F.shiftrightunsigned(_AT, 33)), "segments")


def pieces_of(df: DataFrame, keys: list[str], order: list[Column | str], piece: str, at: str) -> DataFrame:
    """df stored, with the piece of its key that each row lies in and its place: pieces of a key
    follow each other, and so do places."""
    return _pieces(df, keys, order).withColumnsRenamed({_PIECE: piece, _AT: at})


def _with_edges(rows: DataFrame, edges: DataFrame, keys: list[str]) -> DataFrame:
    """rows with the columns of edges, one row for each piece of a key."""
    names = {c: f"edge {c}" for c in (*keys, _PIECE)}
    edges = edges.withColumnsRenamed(names)
    same = reduce(lambda a, b: a & b, (F.col(c).eqNullSafe(F.col(f"`{names[c]}`")) for c in (*keys, _PIECE)))
    return rows.join(edges, same).drop(*names.values())


def running_number(df: DataFrame, keys: list[str], order: list[Column | str], name: str) -> DataFrame:
    """df with a number from 1 in each key, in order: row_number over the key. A null key is a
    key; rows alike in key and order are numbered in any order."""
    rows = _pieces(df, keys, order)
    before = Window.partitionBy(*keys).orderBy(_PIECE).rowsBetween(Window.unboundedPreceding, -1)
    edges = rows.groupBy(*keys, _PIECE).agg(F.count("*").alias("n"), F.min(_AT).alias("first"))
    edges = edges.select(*keys, _PIECE, (F.coalesce(F.sum("n").over(before), F.lit(0)) - F.col("first") + 1).alias("segment shift"))
    # rows of a piece are stored one after the other, so their numbers differ from it by a constant
    return _with_edges(rows, edges, keys).withColumn(name, (F.col(_AT) + F.col("segment shift")).cast("int")).drop(_AT, _PIECE, "segment shift")


def running_last(df: DataFrame, keys: list[str], order: list[Column | str], value: str, name: str) -> DataFrame:
    """df with the last value that is not null up to each row of its key, in order."""
    rows = _pieces(df, keys, order)
    edges = rows.groupBy(*keys, _PIECE).agg(F.max_by(value, F.when(F.col(value).isNotNull(), F.col(_AT))).alias("last"))
    before = Window.partitionBy(*keys).orderBy(_PIECE).rowsBetween(Window.unboundedPreceding, -1)
    edges = edges.select(*keys, _PIECE, F.last("last", ignorenulls=True).over(before).alias("segment last"))
    inside = Window.partitionBy(*keys, _PIECE).orderBy(_AT).rowsBetween(Window.unboundedPreceding, 0)
    found = F.coalesce(F.last(value, ignorenulls=True).over(inside), F.col("segment last"))
    return _with_edges(rows, edges, keys).withColumn(name, found).drop(_AT, _PIECE, "segment last")
