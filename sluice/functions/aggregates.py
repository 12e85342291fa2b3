"""User-defined aggregates: an aggregate given by zero, reduce, merge and finish."""

from __future__ import annotations

import pickle
from collections.abc import Callable
from dataclasses import dataclass
from typing import Any

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


@dataclass(frozen=True)
class Aggregator:
    """zero() makes a buffer, reduce(buffer, value) and merge(buffer, buffer) return one, finish(buffer) the result.

    merge must be associative and commutative: partial buffers meet in any order.
    """

    zero: Callable[[], Any]
    reduce: Callable[[Any, Any], Any]
    merge: Callable[[Any, Any], Any]
    finish: Callable[[Any], Any]
    #: The same as one of Spark's own aggregates, where there is one: then no Python runs.
    native: Callable[[str], Column] | None = None


#: Average that skips nulls; null for no value.
AVERAGE = Aggregator(
    lambda: (0.0, 0),
    lambda b, x: b if x is None else (b[0] + x, b[1] + 1),
    lambda a, b: (a[0] + b[0], a[1] + b[1]),
    lambda b: b[0] / b[1] if b[1] else None,
    F.avg,
)


def is_null(x: Any) -> bool:
    """Whether a value of a pandas column stands for NULL; arrays and other objects don't."""
    return x is None or x is pd.NA or x is pd.NaT or (isinstance(x, float) and x != x)



#: Distinct keys a task holds before it hands its buffers on.
KEYS_HELD = 200_000


def aggregate_by_key(df: DataFrame, key: str, value: str, aggregator: Aggregator, result: str) -> DataFrame:
    """(key, value) with *aggregator* applied per key.

    Each partition folds its rows first and only buffers are shuffled, so a hot key sends one buffer a task
    (or one per KEYS_HELD other keys), whatever its rows.
    """
    if aggregator.native is not None:
        return df.groupBy(F.col(key).alias("key")).agg(aggregator.native(value).cast(result).alias("value"))
    kind = df.schema[key].dataType.simpleString()

    def fold(batches):
        held: dict = {}

        def flush():
            out = pd.DataFrame({"key": pd.Series(list(held), dtype=object), "buffer": [pickle.dumps(b) for b in held.values()]})
            held.clear()
            return out

        for batch in batches:
            for k, v in zip(batch[key], batch[value]):
                k, v = None if is_null(k) else k, None if is_null(v) else v
                held[k] = aggregator.reduce(held[k] if k in held else aggregator.zero(), v)
                if len(held) >= KEYS_HELD:
                    yield flush()
        yield flush()

    def join(frame: pd.DataFrame) -> pd.DataFrame:
        buffers = [pickle.loads(b) for b in frame["buffer"]]
        total = buffers[0]
        for b in buffers[1:]:
            total = aggregator.merge(total, b)
        return pd.DataFrame({"key": [frame["key"].iloc[0]], "value": [aggregator.finish(total)]})

    partial = df.select(key, value).mapInPandas(fold, f"key {kind}, buffer binary")
    return partial.groupBy("key").applyInPandas(join, f"key {kind}, value {result}")


def average_udaf():
    """A grouped-aggregate function for columns that skips nulls."""

    @F.pandas_udf("double")
    def average(values: pd.Series) -> float:
        return float(values.mean()) if values.notna().any() else None

    return average


def register_average(spark: SparkSession, name: str = "my_average") -> None:
    """Make the average callable from SQL text."""
    spark.udf.register(name, average_udaf())
