"""Loops over DataFrames: bounded lineage, fused bodies, invariants computed once."""

from __future__ import annotations

import tempfile
from collections.abc import Callable

from pyspark import StorageLevel
from pyspark.sql import DataFrame


def cut(df: DataFrame) -> DataFrame:
    """Checkpoint to the shared folder named in spark.checkpoint.dir (a temporary one only if unset)."""
    sc = df.sparkSession.sparkContext
    if sc._jsc.sc().getCheckpointDir().isEmpty():
        sc.setCheckpointDir(df.sparkSession.conf.get("spark.checkpoint.dir", None) or tempfile.mkdtemp(prefix="sluice-"))
    return df.checkpoint()


def iterate(state: DataFrame, body: Callable[[DataFrame, int], DataFrame], times: int,
            until: Callable[[DataFrame, int], bool] | None = None, cut_every: int = 3) -> DataFrame:
    """Apply *body* up to *times* times, or until *until*(state, round) says so; lineage is cut every few rounds,
    and before each look at the state, so that no round is computed twice."""
    for k in range(1, times + 1):
        state = body(state, k)
        if (until is not None or k % cut_every == 0) and k < times:
            state = cut(state)
        if until is not None and until(state, k):
            break
    return state


def iterate_together(states: list[DataFrame], bodies: list[Callable[[DataFrame, int], DataFrame]], times: int) -> list[DataFrame]:
    """Independent loops with the same number of rounds, run as one."""
    for k in range(1, times + 1):
        states = [body(s, k) for body, s in zip(bodies, states)]
    return states


def hoist(df: DataFrame) -> DataFrame:
    """Keep what a loop's rounds all read: computed once, on disk where memory is short."""
    return df.persist(StorageLevel.MEMORY_AND_DISK)
