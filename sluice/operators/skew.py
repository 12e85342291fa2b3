"""Skew: ranges of hash buckets of equal weight, and two-phase aggregation of hot keys."""

from __future__ import annotations

from bisect import bisect_left
from itertools import accumulate

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def bucket_count(reducers: int, multiplier: int = 10) -> int:
    """The least prime that is at least reducers * multiplier."""
    n = max(2, reducers * multiplier)
    while any(n % d == 0 for d in range(2, int(n**0.5) + 1)):
        n += 1
    return n


def key_ranges(sizes: list[list[int]], reducers: int) -> list[tuple[int, int]]:
    """Contiguous bucket ranges [start, end), one a reducer, near the same total size.

    sizes: for each block, the size of each bucket.  Each border is the bucket border whose
    running total lies nearest to the reducer's share; of two as near, the later one.
    """
    totals = list(accumulate((sum(x) for x in zip(*sizes)), initial=0))
    share, borders = totals[-1] // reducers, [0]
    for k in range(1, reducers):
        end = max(1, bisect_left(totals, share * k))
        if totals[end] - share * k > share * k - totals[end - 1]:
            end -= 1
        borders.append(max(end, borders[-1]))
    return list(zip(borders, [*borders[1:], len(totals) - 1]))


def partition_by_ranges(df: DataFrame, bucket: Column, ranges: list[tuple[int, int]]) -> DataFrame:
    """*df* dealt to one partition a range, by the bucket of each row."""
    reducer = F.when(bucket < ranges[0][1], 0)
    for k, (_, stop) in enumerate(ranges[1:], 1):
        reducer = reducer.when(bucket < stop, k)
    return df.repartitionById(len(ranges), reducer.otherwise(len(ranges) - 1))


def salted_sum(df: DataFrame, key: str, value: str, salts: int = 16) -> DataFrame:
    """(key, total): first per (key, salt), then per key, so that no task gets a whole hot key's rows.

    For sums, Spark's own partial aggregation does this already; the salt also helps aggregates without one.
    """
    salted = df.withColumn("salt", F.pmod(F.monotonically_increasing_id(), F.lit(salts)))
    return salted.groupBy(key, "salt").agg(F.sum(value).alias("part")).groupBy(key).agg(F.sum("part").alias("total"))


def salted_lists(df: DataFrame, key: str, value: str, salts: int = 16) -> DataFrame:
    """(key, n, distinct): exact count of distinct values per key, a hot key's rows dealt to *salts* tasks by value first."""
    parts = df.groupBy(key, F.pmod(F.xxhash64(value), F.lit(salts)).alias("salt")).agg(F.count(F.lit(1)).alias("n"), F.size(F.collect_set(value)).alias("kinds"))
    return parts.groupBy(key).agg(F.sum("n").alias("n"), F.sum("kinds").alias("kinds"))


def bucket_sizes(df: DataFrame, key: str | Column, buckets: int) -> DataFrame:
    """(bucket, size): how many rows each hash bucket holds; a Column says the bucket itself."""
    bucket = F.pmod(F.hash(key), F.lit(buckets)) if isinstance(key, str) else key
    return df.groupBy(bucket.alias("bucket")).agg(F.count(F.lit(1)).alias("size"))
