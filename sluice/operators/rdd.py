"""The RDD surface: PySpark's own methods, and those that it lacks."""

from __future__ import annotations

from collections.abc import Callable
from concurrent.futures import Future, ThreadPoolExecutor
from typing import Any

from pyspark import RDD
from pyspark.sql import DataFrame, SparkSession

class _Placed:
    """A value placed by a comparison (functools' own wrapper can't be sent to executors)."""

    def __init__(self, value, compare) -> None:
        self.value, self.compare = value, compare

    def __lt__(self, other) -> bool:
        return self.compare(self.value, other.value) < 0

    def __gt__(self, other) -> bool:
        return self.compare(self.value, other.value) > 0


def _order(compare):
    return lambda value: _Placed(value, compare)


#: Rows that a task sorts, on average: Python holds them all.
SORT_ROWS = 100_000
_POOL = ThreadPoolExecutor(max_workers=4, thread_name_prefix="sluice-async")


class Collection:
    """Wraps an RDD.  What isn't defined here is the RDD's own; results that are RDDs are wrapped again."""

    def __init__(self, rdd: RDD) -> None:
        self.rdd = rdd

    @staticmethod
    def parallelize(spark: SparkSession, values, slices: int | None = None) -> Collection:
        return Collection(spark.sparkContext.parallelize(values, slices))

    @staticmethod
    def of(df: DataFrame) -> Collection:
        return Collection(df.rdd)

    def __getattr__(self, name: str) -> Any:
        found = getattr(self.rdd, name)
        if not callable(found):
            return found

        def call(*args, **kwargs):
            out = found(*(a.rdd if isinstance(a, Collection) else a for a in args), **kwargs)
            if isinstance(out, list) and out and all(isinstance(x, RDD) for x in out):
                return [Collection(x) for x in out]
            return Collection(out) if isinstance(out, RDD) else out

        return call

    def reduce(self, fn: Callable[[Any, Any], Any]) -> Any:
        """Folded on the executors; None for no element."""
        folded = self.rdd.mapPartitions(lambda it: _fold(it, fn))
        out = None
        for k, x in enumerate(folded.collect()):  # one value a partition
            out = x if k == 0 else fn(out, x)
        return out

    def _sort_parts(self, least: int | None) -> int:
        return max(least or 1, -(-self.rdd.count() // SORT_ROWS))

    def sortBy(self, keyfunc, ascending: bool = True, numPartitions: int | None = None) -> Collection:
        """As the RDD's own, into *numPartitions* parts or more: their number grows with that of the rows."""
        return Collection(self.rdd.sortBy(keyfunc, ascending, self._sort_parts(numPartitions)))

    def sortByKey(self, ascending: bool = True, numPartitions: int | None = None, keyfunc=lambda x: x) -> Collection:
        """As the RDD's own, into *numPartitions* parts or more: their number grows with that of the rows."""
        return Collection(self.rdd.sortByKey(ascending, self._sort_parts(numPartitions), keyfunc))

    def map_to_pair(self, fn) -> Collection:
        return Collection(self.rdd.map(fn))

    def flat_map_to_pair(self, fn) -> Collection:
        return Collection(self.rdd.flatMap(fn))

    def map_partitions_to_pair(self, fn, preserves_partitioning: bool = False) -> Collection:
        return Collection(self.rdd.mapPartitions(fn, preserves_partitioning))

    def collect_partitions(self, ids: list[int]) -> list[list]:
        """The elements of some partitions."""
        wanted = set(ids)
        found = dict(self.rdd.mapPartitionsWithIndex(lambda k, it: [(k, list(it))] if k in wanted else []).collect())
        return [found.get(k, []) for k in ids]

    def count_by_value_approx(self, timeout_ms: int, confidence: float = 0.95) -> dict[Any, tuple[float, float, float]]:
        """(estimate, low, high) of each value's count, from the partitions that are counted when the time is up.

        Partitions are counted in an order drawn once; what is missing is scaled up, with bounds for the given
        confidence by the spread between partitions.  With all of them counted the bounds are the counts themselves.
        """
        import math
        import random
        import time
        from statistics import NormalDist

        n, ends = self.rdd.getNumPartitions(), time.monotonic() + timeout_ms / 1000
        order, seen = random.Random(n).sample(range(n), n), []
        step = max(1, self.rdd.context.defaultParallelism)
        for k in range(0, n, step):
            part = set(order[k : k + step])
            counts = self.rdd.mapPartitionsWithIndex(lambda i, it, part=part: [_counts(it)] if i in part else [])
            seen += counts.collect()
            if time.monotonic() >= ends:
                break
        done, z, out = len(seen), NormalDist().inv_cdf((1 + confidence) / 2), {}
        for value in {v for c in seen for v in c}:
            each = [c.get(value, 0) for c in seen]
            mean = sum(each) / done
            spread = math.sqrt(sum((x - mean) ** 2 for x in each) / max(1, done - 1) / done * (1 - done / n)) if done < n else 0.0
            out[value] = (mean * n, max(float(sum(each)), n * (mean - z * spread)), n * (mean + z * spread))
        return out

    def max_by(self, compare) -> Any:
        return self.rdd.max(key=_order(compare))

    def min_by(self, compare) -> Any:
        return self.rdd.min(key=_order(compare))

    def top_by(self, n: int, compare) -> list:
        return self.rdd.top(n, key=_order(compare))

    def take_ordered_by(self, n: int, compare) -> list:
        return self.rdd.takeOrdered(n, key=_order(compare))

    def save_as_object_file(self, path: str) -> None:
        self.rdd.saveAsPickleFile(path)

    def collect_async(self) -> Future:
        return _POOL.submit(self.rdd.collect)

    def count_async(self) -> Future:
        return _POOL.submit(self.rdd.count)

    def take_async(self, n: int) -> Future:
        return _POOL.submit(self.rdd.take, n)

    def foreach_async(self, fn) -> Future:
        return _POOL.submit(self.rdd.foreach, fn)

    def foreach_partition_async(self, fn) -> Future:
        return _POOL.submit(self.rdd.foreachPartition, fn)


def _counts(it) -> dict:
    out: dict = {}
    for x in it:
        out[x] = out.get(x, 0) + 1
    return out


def _fold(it, fn):
    out, any_ = None, False
    for x in it:
        out, any_ = (fn(out, x), True) if any_ else (x, True)
    return [out] if any_ else []
