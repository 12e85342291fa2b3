"""Relational operators that PySpark's DataFrame lacks or spells another way."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def typed(df: DataFrame, schema: str) -> DataFrame:
    """The columns of *schema*, by name and cast to its types."""
    fields = [x.strip().split(None, 1) for x in schema.split(",")]
    return df.select(*[F.col(n).cast(t).alias(n) for n, t in fields])


def except_distinct(left: DataFrame, right: DataFrame) -> DataFrame:
    """Set difference (EXCEPT DISTINCT)."""
    return left.subtract(right)


def join_with(left: DataFrame, right: DataFrame, on, how: str = "inner") -> DataFrame:
    """(_1, _2): the joined rows as two structs."""
    a, b = left.select(F.struct("*").alias("_1")), right.select(F.struct("*").alias("_2"))
    return a.join(b, on(a, b), how)


def as_of_join(left: DataFrame, right: DataFrame, by: str, left_time: str, right_time: str, value: str) -> DataFrame:
    """Each row of *left* with the last *value* of *right* at or before its time, by one shuffle on *by*.

    Both sides are laid on one time line; ties take the right row first, and of several the largest value.
    """
    kind = right.schema[value].dataType
    whole = F.struct(*[F.col(f"`{c}`") for c in left.columns])
    a = left.select(F.col(by).alias("k"), F.col(left_time).alias("t"), F.lit(1).alias("side"), F.lit(None).cast(kind).alias("v"), whole.alias("row"))
    b = right.select(F.col(by).alias("k"), F.col(right_time).alias("t"), F.lit(0).alias("side"), F.col(value).alias("v"))
    line = a.unionByName(b, allowMissingColumns=True)
    past = Window.partitionBy("k").orderBy("t", "side", F.col("v").asc_nulls_first()).rowsBetween(Window.unboundedPreceding, 0)
    return line.withColumn("last", F.last("v", ignorenulls=True).over(past)).where("side = 1").select("row.*", F.col("last").alias(f"last_{value}"))


def interval_join(left: DataFrame, right: DataFrame, by: str, left_time: str, right_time: str, before: int, after: int) -> DataFrame:
    """(_1, _2): rows of *left* and *right* with the same *by* and times (in seconds) for which
    left - before <= right <= left + after.

    Time is cut into slots of before + after seconds: a left row goes to the two or three that its interval touches, so a
    key with a long history is dealt to many tasks, and rows meet just those of near times.
    """
    width = max(1, before + after)
    seconds = lambda c: F.col(c).cast("timestamp").cast("double")
    slot = lambda t: F.floor(t / width)
    a = left.select(F.struct("*").alias("_1"), F.col(by).alias("k"), seconds(left_time).alias("t"))
    a = a.select("_1", "k", "t", F.explode(F.sequence(slot(F.col("t") - before), slot(F.col("t") + after))).alias("slot"))
    b = right.select(F.struct("*").alias("_2"), F.col(by).alias("k"), seconds(right_time).alias("u")).withColumn("slot", slot(F.col("u")))
    near = (F.col("u") >= F.col("t") - before) & (F.col("u") <= F.col("t") + after)
    return a.join(b, ["k", "slot"]).where(near).select("_1", "_2")
