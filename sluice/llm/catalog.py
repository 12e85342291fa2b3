"""Queries of this subpackage, each over its whole table, and their SQL where SQL can say the same."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from sluice.llm import ann, exact_dedup, line_dedup, packing, pieces, quality, secret_scan, simhash, sstable, suffix_dedup

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_exact_dedup": exact_dedup.op1_exact_dedup,
    "op2_merge_dropout": pieces.op2_merge_dropout,
    "op3_line_dedup": line_dedup.op3_line_dedup,
    "op4_ann": ann.op4_ann,
    "op5_secret_scan": secret_scan.op5_secret_scan,
    "op6_simhash": simhash.op6_simhash,
    "op7_sstable": sstable.op7_sstable,
    "op8_suffix_dedup": suffix_dedup.op8_suffix_dedup,
    "op9_packing": packing.op9_packing,
    "op10_quality": quality.op10_quality,
}

ORACLE_SQL: dict[str, str] = {
    "op1_exact_dedup": exact_dedup.OP1_SQL,
    "op5_secret_scan": secret_scan.OP5_SQL,
}
