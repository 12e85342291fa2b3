"""Operators on keyed collections (columns ``key`` and ``value``)."""

from __future__ import annotations

from functools import reduce as fold

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sluice.functions.aggregates import Aggregator, aggregate_by_key

#: Merges that Spark folds on the map side within generated code.
BUILT_IN = {"sum": F.sum, "min": F.min, "max": F.max, "count": F.count, "avg": F.avg, "bit_or": F.bit_or, "bit_and": F.bit_and}


def key_by(df: DataFrame, key: Column | None = None, value: Column | None = None) -> DataFrame:
    """Rows as (key, value); a row without a key expression is its own key."""
    whole = F.struct(*df.columns) if len(df.columns) > 1 else F.col(df.columns[0])
    value = whole if value is None else value
    return df.select((whole if key is None else key).alias("key"), value.alias("value"))


def group_by_key(pairs: DataFrame) -> DataFrame:
    """(key, values): all values of each key, in no order; NULL is a key of its own.

    A key's values have to fit one row; to aggregate, use :func:`reduce_by_key` or :func:`combine_per_key`.
    """
    return pairs.groupBy("key").agg(F.collect_list("value").alias("values"))


def reduce_by_key(pairs: DataFrame, how) -> DataFrame:
    """(key, value) folded by a named merge, or by a Python function of two values
    (associative and commutative), of which partial results are shuffled."""
    if isinstance(how, str):
        return pairs.groupBy("key").agg(BUILT_IN[how]("value").alias("value"))
    merge = lambda a, b: b if a is None else a if b is None else how(a, b)
    kind = pairs.schema["value"].dataType.simpleString()
    return aggregate_by_key(pairs, "key", "value", Aggregator(lambda: None, merge, merge, lambda b: b), kind)


def combine_per_key(pairs: DataFrame, aggregator: Aggregator, result: str) -> DataFrame:
    """(key, value) by an accumulator's create, add, merge and extract."""
    return aggregate_by_key(pairs, "key", "value", aggregator, result)


def combine_grouped(grouped: DataFrame, zero: Column, add, finish=None) -> DataFrame:
    """(key, value) from (key, values): a fold over each array, in generated plans, without Python rows."""
    return grouped.select("key", F.aggregate("values", zero, add, finish).alias("value"))


def sum_vectors(pairs: DataFrame, value: str = "value") -> DataFrame:
    """Element-wise sum of array values per key; the result is as long as the shortest array."""
    short = pairs.groupBy("key").agg(F.min(F.size(value)).alias("n"))
    cells = pairs.select("key", F.posexplode(value).alias("pos", "x")).groupBy("key", "pos").agg(F.sum("x").alias("x"))
    rows = cells.groupBy("key").agg(F.array_sort(F.collect_list(F.struct("pos", "x"))).alias("cells"))
    summed = short.join(rows, short["key"].eqNullSafe(rows["key"]), "left").select(short["key"], "n", "cells")
    return summed.select("key", F.coalesce(F.slice(F.transform("cells", lambda c: c["x"]), F.lit(1), F.col("n")), F.array().cast("array<double>")).alias("value"))


def global_reduce(df: DataFrame, how: str, column: str) -> DataFrame:
    """One row with the fold of a column; its value is NULL if there is no row."""
    return df.agg(BUILT_IN[how](column).alias("value"))


def flatten(*collections: DataFrame) -> DataFrame:
    """The bag union of collections with the same columns."""
    return fold(DataFrame.unionByName, collections)


def co_group_by_key(left: DataFrame, right: DataFrame) -> DataFrame:
    """(key, left, right): the values of each key on both sides; empty arrays where a side lacks it."""
    a = left.groupBy("key").agg(F.collect_list("value").alias("left"))
    b = right.groupBy("key").agg(F.collect_list("value").alias("right"))
    both = a.join(b, a["key"].eqNullSafe(b["key"]), "full")
    empty = lambda side, df: F.coalesce(side, F.array().cast(df.schema[side].dataType))
    return both.select(F.coalesce(a["key"], b["key"]).alias("key"), empty("left", a).alias("left"), empty("right", b).alias("right"))
