"""Sessions, execution policies as settings, and executor specifications."""

from __future__ import annotations

import contextlib
import json
from collections.abc import Iterator

from pyspark.sql import SparkSession

_ADAPTIVE = {"spark.sql.adaptive.enabled": "true", "spark.sql.adaptive.coalescePartitions.enabled": "true"}

#: Settings of each policy.  Those outside spark.sql only work when a session is made.
POLICIES: dict[str, dict[str, str]] = {
    "default": _ADAPTIVE,
    "default_separate": {**_ADAPTIVE, "spark.sql.adaptive.coalescePartitions.parallelismFirst": "false"},
    "transient": {**_ADAPTIVE, "spark.decommission.enabled": "true", "spark.storage.decommission.enabled": "true",
                  "spark.storage.decommission.shuffleBlocks.enabled": "true"},
    "disaggregated": {**_ADAPTIVE, "spark.shuffle.sort.io.plugin.class": "org.apache.spark.shuffle.sort.io.LocalDiskShuffleDataIO",
                      "spark.storage.decommission.fallbackStorage.cleanUp": "true"},
    "push_shuffle": {**_ADAPTIVE, "spark.shuffle.push.enabled": "true"},
    "skew": {**_ADAPTIVE, "spark.sql.adaptive.skewJoin.enabled": "true", "spark.sql.adaptive.optimizeSkewsInRebalancePartitions.enabled": "true"},
}


def session(name: str = "sluice", policy: str = "default", master: str | None = None, **settings: str) -> SparkSession:
    """A session under a policy; settings' dots are written as two underscores."""
    builder = SparkSession.builder.appName(name)
    if master:
        builder = builder.master(master)
    for k, v in (POLICIES[policy] | {k.replace("__", "."): v for k, v in settings.items()}).items():
        builder = builder.config(k, v)
    return builder.getOrCreate()


@contextlib.contextmanager
def policy(spark: SparkSession, name: str) -> Iterator[SparkSession]:
    """Run under the policy's spark.sql settings; others are left to the session's start."""
    mine = {k: v for k, v in POLICIES[name].items() if k.startswith("spark.sql.")}
    old = {k: spark.conf.get(k, None) for k in mine}
    for k, v in mine.items():
        spark.conf.set(k, v)
    try:
        yield spark
    finally:
        for k, v in old.items():
            spark.conf.unset(k) if v is None else spark.conf.set(k, v)


def executor_settings(spec: str) -> list[dict[str, str]]:
    """Settings for each entry of an executor specification: JSON list of type, memory_mb, capacity, num (1)."""
    return [
        {"type": x["type"], "spark.executor.memory": f"{x['memory_mb']}m", "spark.executor.cores": str(x["capacity"]), "spark.executor.instances": str(x.get("num", 1))}
        for x in json.loads(spec)
    ]
