"""Per-element functions with a bundle's life cycle and tagged outputs."""

from __future__ import annotations

from collections.abc import Iterable, Iterator
from typing import Any

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sluice.operators.loops import hoist

TAG = "tag"


class DoFn:
    """Override what is needed.  One instance serves one partition, which is one bundle."""

    def setup(self) -> None:
        """Before anything else."""

    def start_bundle(self) -> Iterable[dict[str, Any]] | None:
        """Before the first element."""

    def process(self, element: dict[str, Any], side: Any = None) -> Iterable[dict[str, Any]] | None:
        """For each element; rows to put out."""
        raise NotImplementedError

    def finish_bundle(self) -> Iterable[dict[str, Any]] | None:
        """After the last element; rows to put out."""

    def teardown(self) -> None:
        """At the end, also after an error."""


def par_do(df: DataFrame, fn: type[DoFn] | DoFn, schema: str, side: Any = None) -> DataFrame:
    """Apply *fn* to every row; *side* is a value handed to each call (broadcast once)."""
    sent = df.sparkSession.sparkContext.broadcast(side)
    columns = [x.split()[0] for x in schema.split(",")]

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        one = fn() if isinstance(fn, type) else fn
        frame = lambda rows: pd.DataFrame(list(rows or ()), columns=columns)
        one.setup()
        try:
            yield frame(one.start_bundle())
            for batch in batches:
                yield frame(row for x in batch.to_dict("records") for row in one.process(x, sent.value) or ())
            yield frame(one.finish_bundle())
        finally:
            one.teardown()

    return df.mapInPandas(run, schema)


def par_do_tagged(df: DataFrame, fn: type[DoFn] | DoFn, schema: str, tags: Iterable[str], side: Any = None) -> dict[str, DataFrame]:
    """Several outputs: each row says its output in the column ``tag``; one frame a tag comes back.

    The outputs are kept (on disk where memory is short), so that *fn* runs once for all tags; unpersist one to let them go.
    """
    out = hoist(par_do(df, fn, f"{TAG} string, {schema}", side))
    return {t: out.where(F.col(TAG) == t).drop(TAG) for t in tags}
