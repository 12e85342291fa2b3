"""Semantics of the dataflow operators on literals."""

from dataclasses import dataclass

import numpy as np
import pytest
from pyspark.sql import functions as F

from sluice.functions import aggregates
from sluice.functions.text import java_split, java_split_local
from sluice.operators import frame, keyed, loops, pardo, rdd, skew, views
from sluice.plans import policies, programs
from sluice.sources import io
from sluice.streaming import windows


def pairs(spark, rows, kind="bigint"):
    return spark.createDataFrame(rows, f"key string, value {kind}")


def test_java_split(spark):
    lines = ["", " ", "a  b ", "a b", "  a", "a   "]
    want = [[""], [], ["a", "", "b"], ["a", "b"], ["", "", "a"], ["a"]]
    assert [java_split_local(x) for x in lines] == want
    df = spark.createDataFrame(list(enumerate(lines)), "k int, value string")
    assert [r.s for r in df.orderBy("k").select(java_split(F.col("value")).alias("s")).collect()] == want


def test_word_count_and_sums(spark):
    lines = spark.createDataFrame([("one two  two",), ("",), ("one ",)], "value string")
    assert {r.word: r.n for r in programs.word_count(lines).collect()} == {"one": 2, "two": 2, "": 2}
    rows = spark.createDataFrame([("ann f 40",), ("bob m 100",), (" ann  f 60 ",)], "value string")
    assert sorted(r.value for r in programs.sum_lines(rows).collect()) == ["ann#f: 100", "bob#m: 100"]


def test_each_line_with_all(spark):
    rows = [(f"line {k}",) for k in range(4)]
    out = programs.each_line_with_all(spark.createDataFrame(rows, "value string")).collect()
    lines = sorted(x for r in out for x in r.value.split("\n"))
    assert lines == sorted([f"line: {r[0]}" for r in rows] + [r[0] for r in rows] * 4)


def test_null_keys_are_a_group(spark):
    df = pairs(spark, [("a", 1), (None, 2), (None, 3), ("a", None)])
    assert {r.key: sorted(r["values"]) for r in keyed.group_by_key(df).collect()} == {"a": [1], None: [2, 3]}
    for how in ("sum", lambda a, b: a + b):
        assert {r.key: r.value for r in keyed.reduce_by_key(df, how).collect()} == {"a": 1, None: 5}
    both = keyed.co_group_by_key(df, pairs(spark, [("b", 7), (None, 8)]))
    assert {r.key: (sorted(r.left), r.right) for r in both.collect()} == {"a": ([1], []), "b": ([], [7]), None: ([2, 3], [8])}


def test_folds_agree_whatever_the_partitioning(spark):
    df = pairs(spark, [("hot", k) for k in range(300)] + [(str(k), k) for k in range(50)])
    want = {r.key: r.value for r in keyed.reduce_by_key(df, "sum").collect()}
    for n in (1, 7):
        assert {r.key: r.value for r in keyed.reduce_by_key(df.repartition(n), lambda a, b: a + b).collect()} == want
    got = {r.key: r.value for r in keyed.combine_per_key(df, aggregates.AVERAGE, "double").collect()}
    assert got["hot"] == 149.5


def test_vectors_are_cut_to_the_shortest(spark):
    df = pairs(spark, [("a", [1.0, 2.0, 3.0]), ("a", [10.0, 20.0]), ("b", [5.0])], "array<double>")
    assert {r.key: r.value for r in keyed.sum_vectors(df).collect()} == {"a": [11.0, 22.0], "b": [5.0]}


def test_views(spark):
    df = pairs(spark, [("a", 1), ("b", 2), ("a", 3)])
    assert views.as_iterable(df, "value").first().side == [1, 2, 3]
    assert views.as_multimap(df, "key", "value").first().side == {"a": [1, 3], "b": [2]}
    assert views.as_map(df.where("value > 1"), "key", "value").first().side == {"a": 3, "b": 2}
    assert views.as_singleton(df.where("value = 2").select("value")).first().side == 2
    assert views.as_singleton(df.where("value = 9").select("value")).first().side is None
    with pytest.raises(Exception, match="not a singleton"):
        views.as_singleton(df.select("value")).collect()


class _Life(pardo.DoFn):
    def setup(self):
        self.n = 0

    def start_bundle(self):
        return [{"event": "start", "n": 0}]

    def process(self, element, side=None):
        self.n += element["value"] * side
        if element["value"] > 1:
            yield {"event": "big", "n": element["value"]}

    def finish_bundle(self):
        return [{"event": "end", "n": self.n}]


def test_bundle_life_cycle(spark):
    out = pardo.par_do(pairs(spark, [("a", 1), ("b", 2), ("c", 3)]).coalesce(1), _Life, "event string, n bigint", side=10)
    assert [(r.event, r.n) for r in out.collect()] == [("start", 0), ("big", 2), ("big", 3), ("end", 60)]


def test_rdd_surface(spark):
    c = rdd.Collection.parallelize(spark, [3, 1, 2, 5, 4], 2)
    assert c.reduce(lambda a, b: a + b) == 15 and rdd.Collection.parallelize(spark, [], 2).reduce(lambda a, b: a) is None
    assert c.map(lambda x: x + 1).filter(lambda x: x > 3).collect() == [4, 6, 5]
    assert sorted(c.map_to_pair(lambda x: (x % 2, x)).reduceByKey(lambda a, b: a + b).collect()) == [(0, 6), (1, 9)]
    assert c.flat_map_to_pair(lambda x: [(x, 1)] * (x == 3)).collect() == [(3, 1)]
    assert c.collect_partitions([1]) == [[2, 5, 4]] and c.map_partitions_to_pair(lambda it: [("n", len(list(it)))]).collect() == [("n", 2), ("n", 3)]
    back = lambda a, b: b - a
    assert c.max_by(back) == 1 and c.min_by(back) == 5 and c.top_by(2, back) == [1, 2] and c.take_ordered_by(2, back) == [5, 4]
    assert c.count_async().result(60) == 5 and sorted(c.collect_async().result(60)) == [1, 2, 3, 4, 5] and len(c.take_async(2).result(60)) == 2
    assert c.count_by_value_approx(60_000) and sum(len(x.collect()) for x in c.randomSplit([0.5, 0.5], 3)) == 5
    assert c.union(c).count() == 10 and c.distinct().getNumPartitions() > 0


def test_loops(spark):
    one = spark.createDataFrame([(1,)], "x long")
    step = lambda d, k: d.select((F.col("x") * 2).alias("x"))
    assert loops.iterate(one, step, 7).first().x == 128
    assert loops.iterate(one, step, 7, until=lambda _, k: k == 3).first().x == 8
    a, b = loops.iterate_together([one, one], [step, lambda d, k: d.select((F.col("x") + k).alias("x"))], 3)
    assert (a.first().x, b.first().x) == (8, 7)


def test_skew_ranges():
    # the published example: five reducers, thirty in each range
    blocks = [[1, 2, 4, 2, 1, 8, 2, 4, 2, 10], [3, 5, 5, 7, 10, 3, 5, 4, 8, 5], [2, 3, 5, 5, 5, 6, 6, 8, 4, 15]]
    assert skew.key_ranges(blocks, 5) == [(0, 3), (3, 5), (5, 7), (7, 9), (9, 10)]
    assert skew.bucket_count(3) == 31 and skew.bucket_count(1, 2) == 2
    for sizes in ([[100] + [0] * 9], [[0] * 9 + [100]], [[1] * 10]):
        got = skew.key_ranges(sizes, 4)
        assert got[0][0] == 0 and got[-1][1] == 10 and all(x[1] == y[0] for x, y in zip(got, got[1:]))


def test_salted_sum_is_the_sum(spark):
    df = pairs(spark, [("hot", 1)] * 100 + [("b", 5), (None, 7)])
    assert {r.key: r.total for r in skew.salted_sum(df, "key", "value").collect()} == {"hot": 100, "b": 5, None: 7}


def test_as_of_join(spark):
    left = spark.createDataFrame([("u", 5), ("u", 1), ("v", 9), (None, 3)], "k string, t int")
    right = spark.createDataFrame([("u", 2, 20), ("u", 5, 50), ("u", 6, 60)], "k string, at int, x int")
    got = {(r.k, r.t): r.last_x for r in frame.as_of_join(left, right, "k", "t", "at", "x").collect()}
    assert got == {("u", 5): 50, ("u", 1): None, ("v", 9): None, (None, 3): None}


def test_ratings_and_factors(spark):
    lines = spark.createDataFrame([("# note",), ("",), ("1 10 4.0",), ("1:20:2.0",), ("2\t10  3.0",)], "value string")
    ratings = programs.parse_ratings(lines)
    rows = [(r.user_id, r.item_id, r.rating) for r in ratings.collect()]
    assert sorted(rows) == [(1, 10, 4.0), (1, 20, 2.0), (2, 10, 3.0)]
    f = {10: 3.5, 20: 2.0}
    for _ in range(3):
        u = {x: sum(r * f[i] for a, i, r in rows if a == x) / (0.05 * sum(a == x for a, _, _ in rows)) for x in (1, 2)}
        f = {x: sum(r * u[a] for a, i, r in rows if i == x) / (0.05 * sum(i == x for _, i, _ in rows)) for x in (10, 20)}
    got = {r.item_id: r.factor for r in programs.als_without_gram(ratings).collect()}
    assert got == pytest.approx(f, rel=1e-8)


def test_exact_als_lowers_the_error(spark):
    rng = np.random.default_rng(1)
    u, v = rng.normal(size=(12, 2)), rng.normal(size=(9, 2))
    rows = [(a, i, float(u[a] @ v[i])) for a in range(12) for i in range(9)]
    out = programs.als(spark.createDataFrame(rows, "user_id int, item_id int, rating double"), features=2, rounds=6, regularization=1e-4)
    x = np.array([r.factors for r in out.orderBy("item_id").collect()])
    r = np.array([z for _, _, z in rows]).reshape(12, 9)
    best = r @ x @ np.linalg.pinv(x.T @ x) @ x.T
    assert np.abs(best - r).max() < 0.05


def test_logistic_regression(spark):
    rng = np.random.default_rng(3)
    y = rng.integers(0, 3, 200)
    x = rng.normal(size=(200, 4)) + np.eye(4)[y] * 3
    df = spark.createDataFrame([(int(a), b.tolist()) for a, b in zip(y, x)], "label int, features array<double>").repartition(3)
    w, losses = programs.logistic_regression(df, 3, 4, rounds=4)
    mine = np.zeros((2, 4))
    for k in range(1, 5):
        p = np.exp(np.concatenate([np.zeros((200, 1)), x @ mine.T], axis=1))
        p /= p.sum(axis=1, keepdims=True)
        mine -= (p - np.eye(3)[y])[:, 1:].T @ x / 200 / k**0.5
    assert np.allclose(w, mine) and losses[-1] < losses[0]


def test_average_skips_nulls(spark):
    df = spark.createDataFrame([("a", 3000.0), ("a", 4500.0), ("a", None), ("b", None)], "name string, salary double")
    assert {r.key: r.value for r in aggregates.aggregate_by_key(df, "name", "salary", aggregates.AVERAGE, "double").collect()} == {"a": 3750.0, "b": None}
    aggregates.register_average(spark)
    df.createOrReplaceTempView("pay")
    assert {r.name: r.m for r in spark.sql("select name, my_average(salary) m from pay group by name").collect()} == {"a": 3750.0, "b": None}


@dataclass
class Person:
    name: str
    age: int


def test_sources(spark, tmp_path):
    df = io.from_objects(spark, [Person("Ann", 32), Person("Bob", None)], Person)
    assert df.dtypes == [("name", "string"), ("age", "bigint")]
    texts = spark.createDataFrame([('{"name":"Cy","age":3}',), ('{"name":"Di"}',)], "value string")
    assert [tuple(r) for r in io.json_lines(spark, texts, "name string, age int").orderBy("name").collect()] == [("Cy", 3), ("Di", None)]
    for kind in ("parquet", "orc", "json", "csv"):
        io.write(df, kind, f"{tmp_path}/{kind}")
        assert io.read(spark, kind, f"{tmp_path}/{kind}", schema="name string, age bigint").count() == 2
    assert io.empty(spark).count() == 0 and io.from_list(spark, [1, 2], "v int", slices=2).count() == 2
    assert frame.typed(df, "age int").dtypes == [("age", "int")]


def test_policies_change_no_result(spark):
    want = None
    for name in policies.POLICIES:
        with policies.policy(spark, name):
            got = sorted((r.key, r.value) for r in keyed.reduce_by_key(pairs(spark, [("a", 1), ("b", 2), ("a", 3)]), "sum").collect())
        assert want in (None, got)
        want = got
    spec = policies.executor_settings('[{"type": "Reserved", "memory_mb": 512, "capacity": 6}]')
    assert spec[0]["spark.executor.memory"] == "512m" and spec[0]["spark.executor.instances"] == "1"


def test_streams_count_as_batches_do(spark, sf, tmp_path):
    path = f"{tmp_path}/events"
    batch = spark.read.parquet(f"{sf}/events.parquet")
    batch.repartition(3).write.parquet(path)
    stream = windows.events_stream(spark, path, batch.schema, files_per_trigger=1)
    out = windows.windowed(stream, "ts", "1 day")
    query = out.writeStream.outputMode("complete").format("memory").queryName("by_day").option("checkpointLocation", f"{tmp_path}/c").trigger(availableNow=True).start()
    query.awaitTermination()
    rows = lambda d: sorted(map(tuple, d.collect()))
    assert rows(spark.table("by_day")) == rows(windows.windowed(batch, "ts", "1 day"))


def test_merges_of_arrays(spark):
    pairs = spark.createDataFrame([("a", [1, 2]), ("a", [3, 4]), ("b", None), ("b", [5, 6]), (None, [7, 8])], "key string, value array<bigint>")
    got = {r.key: list(r.value) for r in keyed.reduce_by_key(pairs, lambda a, b: [x + y for x, y in zip(a, b)]).collect()}
    assert got == {"a": [4, 6], "b": [5, 6], None: [7, 8]}


def test_joins_beside_columns_of_their_own_names(spark):
    left = spark.createDataFrame([(1, 10, "x", "y")], "k int, t int, side string, v string")
    right = spark.createDataFrame([(1, 5, 7), (1, 11, 8)], "k int, t int, x int")
    assert [tuple(r) for r in frame.as_of_join(left, right, "k", "t", "t", "x").collect()] == [(1, 10, "x", "y", 7)]


def test_interval_join_at_its_borders(spark):
    at = spark.createDataFrame([(1, float(t)) for t in (0, 59, 60, 61, 120, 500)] + [(None, 1.0)], "k int, t double")
    got = {(r["_1"].t, r["_2"].t) for r in frame.interval_join(at, at, "k", "t", "t", 1, 60).collect()}
    times = [0, 59, 60, 61, 120, 500]
    assert got == {(a, b) for a in times for b in times if a - 1 <= b <= a + 60}


def test_large_side_input_is_not_broadcast(spark, monkeypatch):
    rows = spark.createDataFrame([(k,) for k in range(5)], "x int")
    view = views.as_iterable(rows, "x")
    want = [(k, [0, 1, 2, 3, 4]) for k in range(5)]
    for chars, node in ((views.BROADCAST_CHARS, "Broadcast"), (3, "CartesianProduct")):
        monkeypatch.setattr(views, "BROADCAST_CHARS", chars)
        out = views.with_side_input(rows, view)
        assert sorted((r.x, list(r.side)) for r in out.collect()) == want
        assert node in out._jdf.queryExecution().toString()


def test_tagged_outputs_run_the_body_once(spark):
    seen = spark.sparkContext.accumulator(0)

    class Count(pardo.DoFn):
        def process(self, element, side=None):
            seen.add(1)
            yield {"tag": "odd" if element["x"] % 2 else "even", "x": element["x"]}

    out = pardo.par_do_tagged(spark.createDataFrame([(k,) for k in range(10)], "x int"), Count(), "x int", ["odd", "even"])
    assert (out["odd"].count(), out["even"].count(), seen.value) == (5, 5, 10)


def test_counts_that_are_not_all_there_have_bounds(spark):
    c = rdd.Collection.parallelize(spark, [k % 3 for k in range(4000)], 40)
    full = c.count_by_value_approx(60_000)
    assert full[0][0] == full[0][1] == full[0][2] == 1334
    some = c.count_by_value_approx(0)
    assert all(low <= n <= high and abs(n - 1333) < 200 for n, low, high in some.values())


def test_slices_are_contiguous_and_csv_texts_read(spark):
    df = io.from_list(spark, range(10), "value bigint", slices=3)
    assert [[r[0] for r in part] for part in df.rdd.glom().collect()] == [[0, 1, 2], [3, 4, 5], [6, 7, 8, 9]]
    lines = spark.createDataFrame([('1,"a, b"',), (None,), ("",)], "value string")
    assert [tuple(r) for r in io.csv_lines(lines, "k int, name string").collect()][0] == (1, "a, b")


def test_jdbc_is_read_in_other_processes(sf, tmp_path):
    """Executors of their own, which see neither the driver's memory nor each other's."""
    import subprocess
    import sys

    code = f"""
from pyspark.sql import SparkSession
from sluice.plans.catalog import QUERIES
spark = SparkSession.builder.master("local-cluster[2,1,1024]").config("spark.executor.memory", "600m").config("spark.ui.enabled", "false").config("spark.local.dir", {str(tmp_path)!r}).getOrCreate()
rows = QUERIES["scan_jdbc"](spark, {sf!r}).collect()
print("rows", len(rows), sorted({{r.way for r in rows}}), sum(r.k for r in rows))
"""
    done = subprocess.run([sys.executable, "-c", code], capture_output=True, text=True, timeout=300, cwd=tmp_path)
    assert "rows 75 ['predicates', 'ranges', 'whole'] 900" in done.stdout, done.stderr[-3000:]


def test_sorts_have_more_parts_for_more_rows(spark, monkeypatch):
    monkeypatch.setattr(rdd, "SORT_ROWS", 10)
    rows = rdd.Collection.parallelize(spark, [(k * 7 % 95, k) for k in range(95)], 4)
    for placed in (rows.sortBy(lambda r: -r[0], numPartitions=3), rows.sortByKey(ascending=False, numPartitions=3)):
        assert placed.getNumPartitions() == 10 and max(map(len, placed.glom().collect())) < 40
        assert [k for k, _ in placed.collect()] == list(range(94, -1, -1))
    assert rows.sortBy(lambda r: r[0], numPartitions=30).getNumPartitions() == 30


def test_als_deals_ratings_where_tasks_have_nothing_to_sum(spark):
    rows = [(u, i, 1.0 + (u * 7 + i * 3) % 5) for u in range(40) for i in range(u % 3, 50, 3)]
    ratings = spark.createDataFrame(rows, "user_id int, item_id int, rating double")
    known = ratings.groupBy("item_id").agg(F.array(F.avg("rating"), F.lit(0.5)).alias("factors"))
    assert programs.few_ratings(spark.range(1000).select(F.col("id").alias("user_id")), "user_id") and not programs.few_ratings(spark.range(1000).select((F.col("id") % 2).alias("user_id")), "user_id")
    one, other = ({r.user_id: r.factors for r in programs.solve_side(ratings, known, "item_id", "user_id", 2, deal=d).collect()} for d in (False, True))
    assert set(one) == set(range(40)) and all(np.allclose(one[u], other[u]) for u in one)
