"""Whole programs: counting words, sums by key, broadcast of a file, pi, alternating least squares, logistic regression."""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sluice.functions.text import java_split, key_value_line
from sluice.operators import loops, views


def word_count(lines: DataFrame, column: str = "value") -> DataFrame:
    """(word, n): words between single spaces, empty ones included but for those at a line's end."""
    words = lines.select(F.explode(java_split(F.col(column))).alias("word"))
    return words.groupBy("word").agg(F.count(F.lit(1)).alias("n"))


def sum_by_two_keys(lines: DataFrame, column: str = "value") -> DataFrame:
    """(key, total) of lines ``first second amount``, key ``first#second``."""
    parts = F.split(F.trim(column), " +")
    pairs = lines.select(F.concat_ws("#", parts[0], parts[1]).alias("key"), parts[2].cast("bigint").alias("amount"))
    return pairs.groupBy("key").agg(F.sum("amount").alias("total"))


def sum_lines(lines: DataFrame, column: str = "value") -> DataFrame:
    """``key: total`` lines."""
    return sum_by_two_keys(lines, column).select(key_value_line(F.col("key"), F.col("total")).alias("value"))


def each_line_with_all(lines: DataFrame, column: str = "value") -> DataFrame:
    """Each line, marked, followed by every line (in sorted order)."""
    whole = views.as_iterable(lines, column)
    return views.with_side_input(lines, whole).select(F.concat(F.lit("line: "), F.col(column), F.lit("\n"), F.array_join("side", "\n")).alias("value"))


def pi(spark: SparkSession, samples: int, seed: int = 42) -> DataFrame:
    """One row: an estimate of pi from random points."""
    points = spark.range(samples).select((F.rand(seed) * 2 - 1).alias("x"), (F.rand(seed + 1) * 2 - 1).alias("y"))
    inside = F.sum(F.when(F.col("x") ** 2 + F.col("y") ** 2 <= 1, 1).otherwise(0))
    return points.agg((inside * 4.0 / samples).alias("pi"))


def parse_ratings(lines: DataFrame, column: str = "value") -> DataFrame:
    """(user_id, item_id, rating) of lines split at white space or colons; blank lines and comments are skipped."""
    kept = lines.select(F.trim(column).alias("line")).where("line <> '' and not startswith(line, '#')")
    parts = F.split("line", r"\s+|:")
    return kept.select(parts[0].cast("int").alias("user_id"), parts[1].cast("int").alias("item_id"), parts[2].cast("double").alias("rating"))


def als_without_gram(ratings: DataFrame, rounds: int = 3, regularization: float = 0.05) -> DataFrame:
    """(item_id, factor): factors of the system whose Gram part is left out.

    Each side's factor is sum(rating * other factor) / (regularization * number of ratings); only
    the first factor is ever other than zero.  Items start at their mean rating.
    """
    ratings = loops.hoist(ratings.select("user_id", "item_id", "rating"))
    items = ratings.groupBy("item_id").agg(F.avg("rating").alias("factor"))

    def side(known: DataFrame, key: str, other: str) -> DataFrame:
        rows = ratings.join(known, key)
        return rows.groupBy(other).agg((F.sum(F.col("rating") * F.col("factor")) / (F.count(F.lit(1)) * regularization)).alias("factor"))

    return loops.iterate(items, lambda x, _: side(side(x, "item_id", "user_id"), "user_id", "item_id"), rounds)


def als(ratings: DataFrame, features: int = 10, rounds: int = 3, regularization: float = 0.05, seed: int = 1) -> DataFrame:
    """(item_id, factors): alternating least squares with the full normal equations.

    A round joins ratings with the known side, sums the equations' upper triangle per row, on the map
    side where that makes less to shuffle, and solves each system by itself; no side is collected to the driver.
    """
    ratings = ratings if ratings.is_cached else loops.hoist(ratings.select("user_id", "item_id", "rating"))
    start = F.array(F.avg("rating"), *[(F.pmod(F.xxhash64("item_id", F.lit(seed + k)), F.lit(10_000)) / 1_000_000.0) for k in range(1, features)])
    items = ratings.groupBy("item_id").agg(start.alias("factors"))
    deal = {c: few_ratings(ratings, c) for c in ("user_id", "item_id")}

    def both(known: DataFrame, _: int) -> DataFrame:
        users = solve_side(ratings, known, "item_id", "user_id", features, regularization, deal["user_id"])
        return solve_side(ratings, users, "user_id", "item_id", features, regularization, deal["item_id"])

    return loops.iterate(items, both, rounds)


def few_ratings(ratings: DataFrame, other: str) -> bool:
    """Whether there are so few ratings for each *other* that a map task has hardly two of the same to sum."""
    spread = int(ratings.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    n, kinds = ratings.agg(F.count(F.lit(1)), F.approx_count_distinct(other)).first()
    return n < 3 * spread * kinds


def solve_side(ratings: DataFrame, known: DataFrame, key: str, other: str, features: int, regularization: float = 0.05, deal: bool = False) -> DataFrame:
    """(*other*, factors): least squares of the ratings against the *known* factors of *key*.

    *deal*: ratings are shuffled, not sums of tasks, which have more columns; all ratings of one *other* come to one task,
    which adds them up as they come.
    """
    upper = [(a, b) for a in range(features) for b in range(a, features)]
    rows = ratings.join(known, key).select(other, "rating", *[F.col("factors")[k].alias(f"f{k}") for k in range(features)])
    rows = rows.repartition(other) if deal else rows
    gram = [F.sum(F.col(f"f{a}") * F.col(f"f{b}")).alias(f"g{a}_{b}") for a, b in upper]
    right = [F.sum(F.col("rating") * F.col(f"f{k}")).alias(f"r{k}") for k in range(features)]
    sums = rows.groupBy(other).agg(F.count(F.lit(1)).alias("n"), *gram, *right)

    def solve(batches):
        import pandas as pd

        for batch in batches:
            n = len(batch)
            g = np.zeros((n, features, features))
            for a, b in upper:
                g[:, a, b] = g[:, b, a] = batch[f"g{a}_{b}"]
            g += (regularization * batch["n"].to_numpy())[:, None, None] * np.eye(features)
            r = np.stack([batch[f"r{k}"].to_numpy(float) for k in range(features)], axis=1)
            x = np.linalg.solve(g, r[..., None])[..., 0] if n else r
            yield pd.DataFrame({other: batch[other], "factors": list(x)})

    kind = ratings.schema[other].dataType.simpleString()
    return sums.mapInPandas(solve, f"{other} {kind}, factors array<double>")


def logistic_gradient(examples: DataFrame, weights: np.ndarray) -> tuple[np.ndarray, float, int]:
    """Sum of the gradients, summed loss and number of (label, features) rows; class 0 is the pivot.

    weights: (classes - 1) x features, sent to every task.  Each task hands back one row of sums.
    """
    sent = examples.sparkSession.sparkContext.broadcast(weights)
    shape = weights.shape

    def run(batches):
        import pyarrow as pa

        total, loss, n = np.zeros(shape), 0.0, 0
        for batch in batches:
            y = np.asarray(batch.column("label")).astype(int)
            x = np.asarray(batch.column("features").flatten(), float).reshape(len(y), -1)
            margin = np.concatenate([np.zeros((len(y), 1)), x @ sent.value.T], axis=1)
            top = margin.max(axis=1, keepdims=True)
            p = np.exp(margin - top)
            z = p.sum(axis=1, keepdims=True)
            loss += float((np.log(z) + top - margin[np.arange(len(y)), y][:, None]).sum())
            p = p / z
            p[np.arange(len(y)), y] -= 1
            total += p[:, 1:].T @ x
            n += len(y)
        yield pa.RecordBatch.from_pydict({"gradient": [total.ravel().tolist()], "loss": [loss], "n": [n]})

    parts = examples.select("label", "features").mapInArrow(run, "gradient array<double>, loss double, n bigint")
    total, loss, n = np.zeros(weights.size), 0.0, 0
    for r in parts.toLocalIterator():  # one row a task, one at a time
        total, loss, n = total + np.array(r["gradient"]), loss + r["loss"], n + r["n"]
    return total.reshape(shape), loss, n


def logistic_regression(examples: DataFrame, classes: int, features: int, rounds: int = 3) -> tuple[np.ndarray, list[float]]:
    """Weights and each round's mean loss; from zero, step 1 / sqrt(round), gradient divided by the number of rows."""
    examples = loops.hoist(examples)
    weights, losses = np.zeros((classes - 1, features)), []
    for k in range(1, rounds + 1):
        gradient, loss, n = logistic_gradient(examples, weights)
        losses.append(loss / max(n, 1))
        weights = weights - gradient / (max(n, 1) * k**0.5)
    examples.unpersist()
    return weights, losses
