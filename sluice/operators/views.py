"""Side inputs: a whole collection as one value beside every row of another."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Rows that a side input has at most to be broadcast whole, and characters of it as JSON.
BROADCAST_ROWS = 1_000_000
BROADCAST_CHARS = 64 << 20


def as_iterable(df: DataFrame, column: str) -> DataFrame:
    """One row: the values as an array, sorted so that it is the same every time."""
    return df.agg(F.sort_array(F.collect_list(column)).alias("side"))


as_list = as_iterable


def as_map(df: DataFrame, key: str, value: str) -> DataFrame:
    """One row: a map; a key must not repeat."""
    return df.agg(F.map_from_entries(F.collect_list(F.struct(key, value))).alias("side"))


def as_multimap(df: DataFrame, key: str, value: str) -> DataFrame:
    """One row: a map from each key to its sorted values."""
    lists = df.groupBy(key).agg(F.sort_array(F.collect_list(value)).alias("values"))
    return lists.agg(F.map_from_entries(F.collect_list(F.struct(key, "values"))).alias("side"))


def as_singleton(df: DataFrame) -> DataFrame:
    """The one row of *df*; more than one is an error, none is NULL."""
    column = F.col(df.columns[0])
    return df.agg(F.when(F.count(F.lit(1)) <= 1, F.first(column)).otherwise(F.raise_error(F.lit("not a singleton"))).alias("side"))


def with_side_input(df: DataFrame, view: DataFrame) -> DataFrame:
    """Every row of *df* beside the one row of *view* (column ``side``).

    The row is measured first; one too large to be broadcast is read by each task from the shuffle instead.
    """
    size = view.select(F.length(F.to_json(F.struct("side")))).first()
    small = size is not None and size[0] <= BROADCAST_CHARS
    return df.crossJoin(F.broadcast(view) if small else view.hint("shuffle_replicate_nl"))


def lookup(df: DataFrame, side: DataFrame, key: str, side_key: str, how: str = "left") -> DataFrame:
    """The map side input as a join: broadcast if the side is counted to be small, else by a shuffle."""
    small = side.limit(BROADCAST_ROWS + 1).count() <= BROADCAST_ROWS
    return df.join(F.broadcast(side) if small else side, df[key] == side[side_key], how)
