"""The pipeline's stages, and the queries of the subpackage."""

import random
import subprocess
import sys

import corpus_pipeline
import pytest
from oracle import compare

import __spark_entry__
from sluice.llm import common, shingle_sets
from sluice.llm.catalog import ORACLE_SQL, QUERIES


@pytest.mark.parametrize("name", sorted(ORACLE_SQL))
def test_same_as_sql(spark, sf, name):
    compare(QUERIES[name](spark, sf), ORACLE_SQL[name], sf)


def test_stages(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    columns, seen = docs.columns, {r.doc_id for r in docs.collect()}
    for name, stage in corpus_pipeline.STAGES[:-1]:
        docs = common.stage(stage(spark, docs, sf), "test")
        now = docs.collect()
        assert docs.columns == columns and 0 < len(now) <= len(seen), name
        assert {r.doc_id for r in now} <= seen
        assert all(r.n_chars == len(r.text) for r in now)
        seen = {r.doc_id for r in now}
    packed = corpus_pipeline.STAGES[-1][1](spark, docs, sf).collect()
    assert {r.doc_id for r in packed} == seen


def test_near_duplicates_as_brute_force(spark, monkeypatch):
    rng = random.Random(6)
    rows = []
    for g in range(12):
        words = [f"w{rng.randrange(400)}" for _ in range(rng.choice([30, 80, 200]))]
        for _ in range(8):  # copies at similarities around and above 0.8
            new = list(words)
            for _ in range(rng.randint(0, max(1, len(new) // 40))):
                new[rng.randrange(len(new))] = f"x{rng.randrange(10**6)}"
            rows.append((len(rows), " ".join(new)))
    notice = " ".join(f"n{k}" for k in range(12))  # shared by texts that aren't alike
    rows += [(len(rows) + k, notice + " " + " ".join(f"y{rng.randrange(10**6)}" for _ in range(10))) for k in range(30)]
    rows += [(900, ""), (901, None), (902, "two words"), (903, "Two  words"), (None, rows[0][1]), (904, "only this text")]
    sets = []
    for _, t in rows:
        w = (t or "").lower().split()
        sets.append({tuple(w[k : k + 5]) for k in range(max(1, len(w) - 4))} if w else set())
    root, between = list(range(len(rows))), 0
    for i in range(len(rows)):
        for j in range(i):
            both, all_ = len(sets[i] & sets[j]), len(sets[i] | sets[j])
            if sets[i] == sets[j] or (all_ and both / all_ >= 0.8):
                between += both < all_
                a, b = root[i], root[j]
                root = [min(a, b) if r in (a, b) else r for r in root]
    want = {min((d for (d, _), r in zip(rows, root) if r == g and d is not None), default=None) for g in set(root)}
    monkeypatch.setattr(shingle_sets, "HEAVY_SETS", 5)
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    got = {r.doc_id for r in corpus_pipeline.near_duplicate_stage(spark, docs, "").collect()}
    assert between > 50 and got == want


def test_line_stage_drops_lines_of_few_words_that_are_alike(spark):
    docs = spark.createDataFrame([(1, "all rights reserved", 19), (2, "all rights reservd\nsome more here", 33), (3, "la ja", 5), (4, "la ra", 5)], "doc_id long, text string, n_chars int")
    got = corpus_pipeline.line_stage(spark, docs, "").collect()
    assert sorted((r.doc_id, r.text) for r in got) == [(1, "all rights reserved"), (2, "some more here"), (3, "la ja")]


def test_driver_keeps_few_threads(tmp_path):
    """The pools look at their settings once, so in a process of its own."""
    code = """
import sys
from pyspark.sql import SparkSession, functions as F
from sluice.llm import common
spark = SparkSession.builder.master("local[2]").config("spark.ui.enabled", "false").config("spark.sql.shuffle.partitions", "2").config("spark.checkpoint.dir", sys.argv[1]).getOrCreate()
with common.workspace(spark):
    for k in range(12):
        df = spark.range(20).selectExpr("id", "id % 7 as k")
        common.stage(df.groupBy("k").count().join(df, "k").groupBy("id").count(), "t")
names = [t.getThreadName() for t in spark._jvm.java.lang.management.ManagementFactory.getThreadMXBean().dumpAllThreads(False, False)]
print("THREADS", sum(n.startswith(("shuffle-exchange", "broadcast-exchange")) for n in names))
"""
    out = subprocess.run([sys.executable, "-c", code, str(tmp_path)], capture_output=True, text=True, timeout=200, check=True).stdout
    assert 0 < int(out.split("THREADS")[1]) <= 2 * common.POOL_THREADS


def test_driver_gives_free_memory_back(spark, monkeypatch):
    called, real = [], common.return_memory
    monkeypatch.setattr(common, "return_memory", lambda s: called.append(real(s)))
    with common.workspace(spark):
        for _ in range(2 * common.GARBAGE_TABLES):
            common.stage(spark.range(3), "t")
    assert called == [True, True]


def test_registered():
    assert {f"op{n}_" for n in range(1, 11)} == {k.split("_")[0] + "_" for k in QUERIES}
    assert set(QUERIES) | {"pipeline"} <= set(__spark_entry__.queries())


def test_stages_on_odd_rows(spark, sf):
    """Nulls in every column, empty texts, repeats, columns of the stages' own names; then no rows at all."""
    base = " ".join(f"word{k}" for k in range(60))
    rows = [(1, f"{base}\nanother line here", 5), (2, f"{base}\nanother line here", 5), (3, None, None), (4, "", 0), (None, "a line of its own", 3), (5, "token = abcdef123", 1), (5, "token = abcdef123", 1), (None, None, None)]
    extra = ["gone", "row", "text_", "spans", "secret_spans", "line_text", "_old", "component_id", "score", "key"]
    table = spark.createDataFrame([(*r, *(["x", None][k % 2] for k in range(len(extra)))) for r in rows], "doc_id long, text string, n_chars long, " + ", ".join(f"`{c}` string" for c in extra))
    for name, stage in corpus_pipeline.STAGES[1:-1]:
        got = common.stage(stage(spark, table, sf), "test")
        out = got.collect()
        assert got.columns == table.columns and {(r["gone"], r["row"]) for r in out} == {("x", None)}, name
        assert stage(spark, table.where("false"), sf).count() == 0, name
        texts = sorted((str(r.doc_id), str(r.text)) for r in out)
        if name == "line dedup":  # doc 2 has nothing left; equal rows are treated alike
            assert texts == sorted([("1", rows[0][1]), ("3", "None"), ("4", ""), ("None", "a line of its own"), ("5", "token = abcdef123"), ("5", "token = abcdef123"), ("None", "None")])
        elif name == "near-duplicates":  # texts without a word are one group
            assert texts == sorted([("1", rows[0][1]), ("3", "None"), ("None", "a line of its own"), ("None", "None"), ("5", "token = abcdef123"), ("5", "token = abcdef123")])
        else:
            assert [t for d, t in texts if d == "5"] == ["[assign]"] * 2 and len(texts) == len(rows)
    kept = corpus_pipeline.quality_stage(spark, table, sf)
    assert kept.columns == table.columns and kept.count() <= len(rows)
    packed = corpus_pipeline.packing_stage(spark, table, sf).collect()
    assert len(packed) == len(rows) and corpus_pipeline.packing_stage(spark, table.where("false"), sf).count() == 0


def test_run_leaves_only_its_result(spark, sf):
    import os

    root = spark.conf.get("spark.checkpoint.dir") + "/sluice"
    before = set(os.listdir(root)) if os.path.isdir(root) else set()
    assert corpus_pipeline.run(spark, sf).count() > 0
    assert {x.split("-")[0] for x in set(os.listdir(root)) - before} == {"packed"}
