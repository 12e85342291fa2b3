"""Queries of the dataflow, relational and program operators, and the same in SQL."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from sluice.functions import aggregates
from sluice.functions.text import java_split, key_value_line
from sluice.operators import frame, keyed, loops, pardo, rdd, skew, views
from sluice.plans import programs
from sluice.sources import io
from sluice.streaming import windows

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
ORACLE_SQL: dict[str, str] = {}


def query(sql: str | None = None) -> Callable[[Query], Query]:
    """Register a function under its own name."""

    def add(fn: Query) -> Query:
        QUERIES[fn.__name__] = fn
        if sql is not None:
            ORACLE_SQL[fn.__name__] = sql
        return fn

    return add


def table(spark: SparkSession, sf: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf}/{name}.parquet")


def money(column: str) -> Column:
    """Exact sums of two-digit amounts, whatever the order."""
    return F.sum(F.col(column).cast("decimal(18,2)")).cast("double")


def _scratch(spark: SparkSession) -> str:
    import tempfile
    import uuid

    root = spark.conf.get("spark.checkpoint.dir", None) or tempfile.mkdtemp(prefix="sluice-")
    return f"{root}/sluice/io-{uuid.uuid4().hex}"


# sources and sinks


@query("SELECT r_regionkey, r_name FROM region")
def scan_parquet(spark, sf):
    return table(spark, sf, "region").select("r_regionkey", "r_name")


@query("SELECT lower(lang) || ' ' || CAST(doc_id AS VARCHAR) AS value FROM documents")
def scan_text_roundtrip(spark, sf):
    path = _scratch(spark)
    io.write_text(table(spark, sf, "documents").select(F.concat_ws(" ", F.lower("lang"), F.col("doc_id").cast("string"))), path)
    return io.read(spark, "text", path)


@query("SELECT n_nationkey, n_name, n_regionkey FROM nation")
def scan_csv_roundtrip(spark, sf):
    path = _scratch(spark)
    io.write(table(spark, sf, "nation"), "csv", path, header=True)
    return io.read(spark, "csv", path, schema="n_nationkey int, n_name string, n_regionkey int", header=True)


@query("SELECT c_custkey, c_name, c_acctbal FROM customer")
def scan_json_roundtrip(spark, sf):
    path = _scratch(spark)
    io.write(table(spark, sf, "customer").select("c_custkey", "c_name", "c_acctbal"), "json", path)
    return io.read(spark, "json", path, schema="c_custkey bigint, c_name string, c_acctbal double")


@query("SELECT p_partkey, p_name, p_size FROM part")
def scan_orc_roundtrip(spark, sf):
    path = _scratch(spark)
    io.write(table(spark, sf, "part").select("p_partkey", "p_name", "p_size"), "orc", path)
    return io.read(spark, "orc", path)


@query("SELECT way, n_nationkey AS k, n_name AS name FROM nation, (VALUES ('whole'), ('ranges'), ('predicates')) w(way)")
def scan_jdbc(spark, sf):
    """A table read from an embedded database: whole, by ranges of a column, by predicates."""
    nation = table(spark, sf, "nation").select(F.col("n_nationkey").alias("K"), F.col("n_name").alias("NAME"))
    with io.sent_database(nation, "nation") as (url, driver):
        ways = {
            "whole": io.read_jdbc(spark, url, "nation", properties=driver),
            "ranges": io.read_jdbc(spark, url, "nation", column="K", lower=0, upper=25, partitions=3, properties=driver),
            "predicates": io.read_jdbc(spark, url, "nation", predicates=['"K" < 10', '"K" >= 10'], properties=driver),
        }
    return keyed.flatten(*[df.select(F.lit(way).alias("way"), F.col("K").alias("k"), F.col("NAME").alias("name")) for way, df in ways.items()])


@query("SELECT CAST(range AS BIGINT) AS value FROM range(100)")
def create_from_list(spark, sf):
    return io.from_list(spark, range(100), "value bigint", slices=5)


@query("SELECT o_orderstatus, count(*) AS n FROM orders GROUP BY o_orderstatus")
def scan_table_view(spark, sf):
    table(spark, sf, "orders").createOrReplaceTempView("sluice_orders")
    return spark.table("sluice_orders").groupBy("o_orderstatus").agg(F.count(F.lit(1)).alias("n"))


# projection and filter


@query("SELECT o_orderkey, o_totalprice * 2 AS doubled FROM orders")
def map_project(spark, sf):
    return table(spark, sf, "orders").select("o_orderkey", (F.col("o_totalprice") * 2).alias("doubled"))


@query("SELECT s_suppkey + 1 AS next_key, upper(s_name) AS name FROM supplier")
def select_expr(spark, sf):
    return table(spark, sf, "supplier").selectExpr("s_suppkey + 1 AS next_key", "upper(s_name) AS name")


@query("SELECT p_partkey, p_size, p_size * p_size AS squared FROM part")
def with_column(spark, sf):
    return table(spark, sf, "part").select("p_partkey", "p_size").withColumn("squared", F.col("p_size") * F.col("p_size"))


@query("SELECT n_nationkey AS id, n_name FROM nation")
def rename_drop(spark, sf):
    return table(spark, sf, "nation").withColumnRenamed("n_nationkey", "id").drop("n_regionkey")


@query("SELECT l_orderkey, l_linenumber, l_quantity FROM lineitem WHERE l_quantity > 45 AND l_returnflag = 'R'")
def filter_expr(spark, sf):
    rows = table(spark, sf, "lineitem").filter((F.col("l_quantity") > 45) & (F.col("l_returnflag") == "R"))
    return rows.select("l_orderkey", "l_linenumber", "l_quantity")


@query("SELECT c_custkey, c_mktsegment FROM customer WHERE c_mktsegment LIKE 'B%' AND c_acctbal < 0")
def filter_sql_string(spark, sf):
    return table(spark, sf, "customer").where("c_mktsegment LIKE 'B%' AND c_acctbal < 0").select("c_custkey", "c_mktsegment")


@query("SELECT p_partkey, p_size FROM part WHERE p_size BETWEEN 13 AND 19")
def between_filter(spark, sf):
    return table(spark, sf, "part").where(F.col("p_size").between(13, 19)).select("p_partkey", "p_size")


@query("SELECT c_custkey, CASE WHEN c_acctbal > 0 THEN c_acctbal END AS positive FROM customer WHERE (CASE WHEN c_acctbal > 0 THEN c_acctbal END) > 21")
def null_filter(spark, sf):
    rows = table(spark, sf, "customer").select("c_custkey", F.when(F.col("c_acctbal") > 0, F.col("c_acctbal")).alias("positive"))
    return rows.where(F.col("positive") > 21)


@query("""SELECT '{"r_regionkey":' || r_regionkey || ',"r_name":"' || r_name || '"}' AS json FROM region""")
def to_json(spark, sf):
    return table(spark, sf, "region").select(F.to_json(F.struct("r_regionkey", "r_name")).alias("json"))


# flat and keyed

_WORDS = """
WITH t AS (SELECT rtrim(text, ' ') AS s, text FROM documents WHERE text IS NOT NULL),
w AS (SELECT unnest(CASE WHEN text = '' THEN [''] WHEN s = '' THEN CAST([] AS VARCHAR[]) ELSE string_split(s, ' ') END) AS word FROM t)
SELECT word, count(*) AS n FROM w GROUP BY word
"""


@query(_WORDS)
def word_count(spark, sf):
    return programs.word_count(table(spark, sf, "documents"), "text")


@query("SELECT l_returnflag || '#' || l_linestatus AS key, CAST(sum(CAST(l_quantity AS BIGINT)) AS BIGINT) AS total FROM lineitem GROUP BY ALL")
def mapreduce_sum_by_key(spark, sf):
    lines = table(spark, sf, "lineitem").select(F.concat_ws(" ", "l_returnflag", "l_linestatus", F.col("l_quantity").cast("bigint").cast("string")).alias("value"))
    return programs.sum_by_two_keys(lines)


@query("SELECT n_regionkey AS key, list_sort(list(n_name)) AS names FROM nation GROUP BY n_regionkey")
def group_by_key_list(spark, sf):
    pairs = keyed.key_by(table(spark, sf, "nation"), F.col("n_regionkey"), F.col("n_name"))
    return keyed.group_by_key(pairs).select("key", F.sort_array("values").alias("names"))


@query("SELECT o_custkey AS key, max(o_totalprice) AS value FROM orders GROUP BY o_custkey")
def reduce_by_key_max(spark, sf):
    return keyed.reduce_by_key(keyed.key_by(table(spark, sf, "orders"), F.col("o_custkey"), F.col("o_totalprice")), "max")


@query("SELECT l_shipdate AS key, CAST(max(l_orderkey) AS BIGINT) AS value FROM lineitem GROUP BY l_shipdate")
def reduce_by_key_function(spark, sf):
    rows = table(spark, sf, "lineitem").select(F.col("l_shipdate").cast("string").alias("key"), F.col("l_orderkey").alias("value"))
    out = keyed.reduce_by_key(rows, lambda a, b: a if a > b else b)
    return out.select(F.col("key").cast("timestamp_ntz").alias("key"), F.col("value").cast("bigint").alias("value"))


@query("SELECT p_brand AS key, avg(p_size) AS value FROM part GROUP BY p_brand")
def combine_per_key_avg(spark, sf):
    pairs = keyed.key_by(table(spark, sf, "part"), F.col("p_brand"), F.col("p_size"))
    return keyed.combine_per_key(pairs, aggregates.AVERAGE, "double")


@query("SELECT n_regionkey AS key, CAST(sum(n_nationkey) AS BIGINT) AS value FROM nation GROUP BY n_regionkey")
def combine_grouped_sum(spark, sf):
    grouped = keyed.group_by_key(keyed.key_by(table(spark, sf, "nation"), F.col("n_regionkey"), F.col("n_nationkey").cast("bigint")))
    return keyed.combine_grouped(grouped, F.lit(0).cast("bigint"), lambda a, x: a + x)


@query("SELECT label AS key, round(sum(embedding[1]), 4) AS first, round(sum(embedding[64]), 4) AS last FROM embeddings WHERE embedding IS NOT NULL GROUP BY label")
def combine_vectors(spark, sf):
    rows = table(spark, sf, "embeddings").where("embedding is not null").select(F.col("label").alias("key"), F.col("embedding").cast("array<double>").alias("value"))
    return keyed.sum_vectors(rows).select("key", F.round(F.col("value")[0], 4).alias("first"), F.round(F.col("value")[63], 4).alias("last"))


@query("SELECT CAST(max(l_orderkey) AS BIGINT) AS value FROM lineitem")
def global_reduce(spark, sf):
    return keyed.global_reduce(table(spark, sf, "lineitem"), "max", "l_orderkey")


@query("SELECT CAST(max(l_orderkey) AS BIGINT) AS value FROM lineitem WHERE l_orderkey < 0")
def global_reduce_empty(spark, sf):
    return keyed.global_reduce(table(spark, sf, "lineitem").where("l_orderkey < 0"), "max", "l_orderkey")


@query("SELECT n_name AS name FROM nation UNION ALL SELECT r_name FROM region UNION ALL SELECT n_name FROM nation")
def flatten_union(spark, sf):
    n, r = table(spark, sf, "nation").select(F.col("n_name").alias("name")), table(spark, sf, "region").select(F.col("r_name").alias("name"))
    return keyed.flatten(n, r, n)


@query("""
WITH c AS (SELECT c_nationkey AS key, list_sort(list(c_custkey)) AS l FROM customer GROUP BY 1),
s AS (SELECT s_nationkey AS key, list_sort(list(s_suppkey)) AS r FROM supplier GROUP BY 1)
SELECT coalesce(c.key, s.key) AS key, coalesce(l, []) AS customers, coalesce(r, []) AS suppliers FROM c FULL JOIN s ON c.key = s.key
""")
def co_group_by_key(spark, sf):
    left = keyed.key_by(table(spark, sf, "customer"), F.col("c_nationkey"), F.col("c_custkey"))
    right = keyed.key_by(table(spark, sf, "supplier"), F.col("s_nationkey"), F.col("s_suppkey"))
    both = keyed.co_group_by_key(left, right)
    return both.select("key", F.sort_array("left").alias("customers"), F.sort_array("right").alias("suppliers"))


# side inputs


@query("SELECT r_name, (SELECT list_sort(list(n_name)) FROM nation) AS all_nations FROM region")
def side_input_iterable(spark, sf):
    view = views.as_iterable(table(spark, sf, "nation"), "n_name")
    return views.with_side_input(table(spark, sf, "region"), view).select("r_name", F.col("side").alias("all_nations"))


@query("SELECT c_custkey, n_name FROM customer LEFT JOIN nation ON c_nationkey = n_nationkey")
def side_input_map_lookup(spark, sf):
    return views.lookup(table(spark, sf, "customer"), table(spark, sf, "nation"), "c_nationkey", "n_nationkey").select("c_custkey", "n_name")


@query("SELECT r_regionkey, (SELECT list_sort(list(n_name)) FROM nation WHERE n_regionkey = r_regionkey) AS nations FROM region")
def side_input_multimap(spark, sf):
    view = views.as_multimap(table(spark, sf, "nation"), "n_regionkey", "n_name")
    return views.with_side_input(table(spark, sf, "region"), view).select("r_regionkey", F.col("side")[F.col("r_regionkey")].alias("nations"))


@query("SELECT s_suppkey, s_acctbal > (SELECT max(c_acctbal) / 2 FROM customer) AS rich FROM supplier")
def side_input_singleton(spark, sf):
    view = views.as_singleton(table(spark, sf, "customer").agg((F.max("c_acctbal") / 2).alias("m")))
    return views.with_side_input(table(spark, sf, "supplier"), view).select("s_suppkey", (F.col("s_acctbal") > F.col("side")).alias("rich"))


# joins


@query("SELECT o_orderkey, c_name FROM orders JOIN customer ON o_custkey = c_custkey")
def join_inner(spark, sf):
    o, c = table(spark, sf, "orders"), table(spark, sf, "customer")
    return o.join(c, o.o_custkey == c.c_custkey).select("o_orderkey", "c_name")


@query("SELECT l_orderkey AS k, l_linenumber, o_orderstatus FROM lineitem JOIN orders ON l_orderkey = o_orderkey")
def join_using(spark, sf):
    left = table(spark, sf, "lineitem").select(F.col("l_orderkey").alias("k"), "l_linenumber")
    return left.join(table(spark, sf, "orders").select(F.col("o_orderkey").alias("k"), "o_orderstatus"), "k")


@query("SELECT c_custkey, o_orderkey FROM customer LEFT JOIN orders ON c_custkey = o_custkey")
def join_left(spark, sf):
    c, o = table(spark, sf, "customer"), table(spark, sf, "orders")
    return c.join(o, c.c_custkey == o.o_custkey, "left").select("c_custkey", "o_orderkey")


@query("SELECT s_suppkey, n_name FROM supplier RIGHT JOIN nation ON s_nationkey = n_nationkey")
def join_right(spark, sf):
    s, n = table(spark, sf, "supplier"), table(spark, sf, "nation")
    return s.join(n, s.s_nationkey == n.n_nationkey, "right").select("s_suppkey", "n_name")


@query("SELECT s_suppkey, c_custkey FROM supplier FULL JOIN customer ON s_suppkey = c_custkey")
def join_full(spark, sf):
    s, c = table(spark, sf, "supplier"), table(spark, sf, "customer")
    return s.join(c, s.s_suppkey == c.c_custkey, "full").select("s_suppkey", "c_custkey")


@query("SELECT c_custkey FROM customer WHERE EXISTS (SELECT 1 FROM orders WHERE o_custkey = c_custkey)")
def join_semi(spark, sf):
    c, o = table(spark, sf, "customer"), table(spark, sf, "orders")
    return c.join(o, c.c_custkey == o.o_custkey, "left_semi").select("c_custkey")


@query("SELECT c_custkey FROM customer WHERE NOT EXISTS (SELECT 1 FROM orders WHERE o_custkey = c_custkey AND o_orderstatus = 'P')")
def join_anti(spark, sf):
    c, o = table(spark, sf, "customer"), table(spark, sf, "orders").where("o_orderstatus = 'P'")
    return c.join(o, c.c_custkey == o.o_custkey, "left_anti").select("c_custkey")


@query("SELECT r_name, n_name FROM region CROSS JOIN nation")
def join_cross(spark, sf):
    return table(spark, sf, "region").crossJoin(table(spark, sf, "nation")).select("r_name", "n_name")


@query("SELECT s_suppkey, n_nationkey FROM supplier JOIN nation ON s_nationkey < n_nationkey AND n_nationkey < s_nationkey + 3")
def join_theta(spark, sf):
    s, n = table(spark, sf, "supplier"), table(spark, sf, "nation")
    return s.join(F.broadcast(n), (s.s_nationkey < n.n_nationkey) & (n.n_nationkey < s.s_nationkey + 3)).select("s_suppkey", "n_nationkey")


@query("SELECT c_custkey, n_name FROM customer JOIN nation ON c_nationkey = n_nationkey")
def join_broadcast_hint(spark, sf):
    c, n = table(spark, sf, "customer"), table(spark, sf, "nation")
    return c.join(n.hint("broadcast"), c.c_nationkey == n.n_nationkey).select("c_custkey", "n_name")


@query("SELECT c.c_custkey AS customer, n.n_name AS nation FROM customer c JOIN nation n ON c.c_nationkey = n.n_nationkey")
def join_with_structs(spark, sf):
    both = frame.join_with(table(spark, sf, "customer"), table(spark, sf, "nation"), lambda a, b: a["_1"]["c_nationkey"] == b["_2"]["n_nationkey"])
    return both.select(F.col("_1.c_custkey").alias("customer"), F.col("_2.n_name").alias("nation"))


@query("""
SELECT e.event_id, (SELECT max(p.value) FROM events p WHERE p.user_id = e.user_id AND p.event_type = 'purchase' AND p.ts =
  (SELECT max(q.ts) FROM events q WHERE q.user_id = e.user_id AND q.event_type = 'purchase' AND q.ts <= e.ts)) AS last_value
FROM events e
""")
def join_asof(spark, sf):
    events = table(spark, sf, "events").select("event_id", "user_id", "event_type", "ts", "value")
    bought = events.where("event_type = 'purchase'").select("user_id", F.col("ts").alias("at"), "value")
    return frame.as_of_join(events.select("event_id", "user_id", "ts"), bought, "user_id", "ts", "at", "value").select("event_id", "last_value")


# aggregates


@query("SELECT count(*) AS n, CAST(sum(CAST(l_extendedprice AS DECIMAL(18,2))) AS DOUBLE) AS total, max(l_discount) AS most FROM lineitem")
def agg_global(spark, sf):
    return table(spark, sf, "lineitem").agg(F.count(F.lit(1)).alias("n"), money("l_extendedprice").alias("total"), F.max("l_discount").alias("most"))


@query("SELECT max(p_size) AS largest, count(p_name) AS names FROM part")
def agg_map_spec(spark, sf):
    out = table(spark, sf, "part").agg({"p_size": "max", "p_name": "count"})
    return out.withColumnRenamed("max(p_size)", "largest").withColumnRenamed("count(p_name)", "names")


@query("SELECT o_orderpriority, count(*) AS n FROM orders GROUP BY o_orderpriority")
def group_count(spark, sf):
    return table(spark, sf, "orders").groupBy("o_orderpriority").agg(F.count(F.lit(1)).alias("n"))


@query("SELECT l_returnflag, l_linestatus, CAST(sum(CAST(l_quantity AS DECIMAL(18,2))) AS DOUBLE) AS qty, CAST(sum(CAST(l_extendedprice AS DECIMAL(18,2))) AS DOUBLE) AS price, count(*) AS n FROM lineitem WHERE l_shipdate <= TIMESTAMP '1998-09-02' GROUP BY ALL")
def pricing_summary(spark, sf):
    rows = table(spark, sf, "lineitem").where("l_shipdate <= timestamp_ntz'1998-09-02'")
    return rows.groupBy("l_returnflag", "l_linestatus").agg(money("l_quantity").alias("qty"), money("l_extendedprice").alias("price"), F.count(F.lit(1)).alias("n"))


@query("SELECT DISTINCT p_brand, p_size FROM part")
def agg_distinct(spark, sf):
    return table(spark, sf, "part").select("p_brand", "p_size").distinct()


@query("SELECT DISTINCT c_nationkey, c_mktsegment FROM customer")
def drop_duplicates_subset(spark, sf):
    return table(spark, sf, "customer").dropDuplicates(["c_nationkey", "c_mktsegment"]).select("c_nationkey", "c_mktsegment")


@query("""
SELECT unnest(['count', 'mean', 'stddev', 'min', 'max']) AS summary, round(unnest([count(o_totalprice), avg(o_totalprice), stddev_samp(o_totalprice), min(o_totalprice), max(o_totalprice)]), 3) AS price,
       unnest(['', '', '', min(o_orderstatus), max(o_orderstatus)]) AS status FROM orders
""")
def describe(spark, sf):
    out = table(spark, sf, "orders").describe("o_totalprice", "o_orderstatus")
    text = F.when(F.col("summary").isin("min", "max"), F.col("o_orderstatus")).otherwise(F.lit(""))  # the mean of texts is NULL, their count that of rows
    return out.select("summary", F.round(F.col("o_totalprice").cast("double"), 3).alias("price"), text.alias("status"))


@query("SELECT o_orderstatus, o_orderpriority, count(*) AS n FROM orders GROUP BY ROLLUP (o_orderstatus, o_orderpriority)")
def rollup(spark, sf):
    return table(spark, sf, "orders").rollup("o_orderstatus", "o_orderpriority").agg(F.count(F.lit(1)).alias("n"))


@query("SELECT o_orderstatus, o_orderpriority, count(*) AS n FROM orders GROUP BY CUBE (o_orderstatus, o_orderpriority)")
def cube(spark, sf):
    return table(spark, sf, "orders").cube("o_orderstatus", "o_orderpriority").agg(F.count(F.lit(1)).alias("n"))


@query("SELECT l_returnflag, l_linestatus, count(*) AS n FROM lineitem GROUP BY GROUPING SETS ((l_returnflag), (l_linestatus), ())")
def grouping_sets(spark, sf):
    table(spark, sf, "lineitem").createOrReplaceTempView("sluice_lineitem")
    return spark.sql("SELECT l_returnflag, l_linestatus, count(*) AS n FROM sluice_lineitem GROUP BY GROUPING SETS ((l_returnflag), (l_linestatus), ())")


@query("SELECT o_orderpriority, count(*) FILTER (o_orderstatus = 'F') AS F, count(*) FILTER (o_orderstatus = 'O') AS O, count(*) FILTER (o_orderstatus = 'P') AS P FROM orders GROUP BY o_orderpriority")
def pivot(spark, sf):
    out = table(spark, sf, "orders").groupBy("o_orderpriority").pivot("o_orderstatus", ["F", "O", "P"]).agg(F.count(F.lit(1)))
    return out.na.fill(0)


@query("SELECT true AS orders_near, true AS median_near")
def approx_distinct(spark, sf):
    """Whether the estimates are near: distinct orders within a tenth, half of the rows at most and at least at the median."""
    rows = table(spark, sf, "lineitem")
    found = rows.agg(F.approx_count_distinct("l_orderkey").alias("about"), F.percentile_approx("l_quantity", 0.5).alias("median"))
    exact = rows.crossJoin(F.broadcast(found)).agg(
        F.count_distinct("l_orderkey").alias("orders"), F.first("about").alias("about"),
        F.avg((F.col("l_quantity") <= F.col("median")).cast("int")).alias("low"), F.avg((F.col("l_quantity") >= F.col("median")).cast("int")).alias("high"),
    )
    return exact.select((F.abs(F.col("about") - F.col("orders")) <= 0.1 * F.col("orders")).alias("orders_near"), ((F.col("low") >= 0.49) & (F.col("high") >= 0.49)).alias("median_near"))


# analytic windows


@query("SELECT o_orderkey, CAST(row_number() OVER (PARTITION BY o_custkey ORDER BY o_totalprice DESC, o_orderkey) AS INTEGER) AS rn FROM orders")
def win_row_number(spark, sf):
    w = Window.partitionBy("o_custkey").orderBy(F.desc("o_totalprice"), "o_orderkey")
    return table(spark, sf, "orders").select("o_orderkey", F.row_number().over(w).alias("rn"))


@query("SELECT p_partkey, CAST(rank() OVER w AS INTEGER) AS r, CAST(dense_rank() OVER w AS INTEGER) AS d FROM part WINDOW w AS (PARTITION BY p_brand ORDER BY p_size)")
def win_rank(spark, sf):
    w = Window.partitionBy("p_brand").orderBy("p_size")
    return table(spark, sf, "part").select("p_partkey", F.rank().over(w).alias("r"), F.dense_rank().over(w).alias("d"))


@query("SELECT event_id, lag(event_id) OVER w AS before, lead(event_id) OVER w AS after FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts, event_id)")
def win_lag_lead(spark, sf):
    w = Window.partitionBy("user_id").orderBy("ts", "event_id")
    return table(spark, sf, "events").select("event_id", F.lag("event_id").over(w).alias("before"), F.lead("event_id").over(w).alias("after"))


@query("SELECT l_orderkey, l_linenumber, CAST(sum(CAST(l_quantity AS DECIMAL(18,2))) OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_suppkey, l_quantity ROWS BETWEEN 2 PRECEDING AND CURRENT ROW) AS DOUBLE) AS moving FROM lineitem")
def win_rows_frame(spark, sf):
    w = Window.partitionBy("l_orderkey").orderBy("l_linenumber", "l_partkey", "l_suppkey", "l_quantity").rowsBetween(-2, 0)
    return table(spark, sf, "lineitem").select("l_orderkey", "l_linenumber", F.sum(F.col("l_quantity").cast("decimal(18,2)")).over(w).cast("double").alias("moving"))


@query("SELECT c_custkey, CAST(ntile(4) OVER (PARTITION BY c_nationkey ORDER BY c_acctbal, c_custkey) AS INTEGER) AS quarter FROM customer")
def win_ntile(spark, sf):
    w = Window.partitionBy("c_nationkey").orderBy("c_acctbal", "c_custkey")
    return table(spark, sf, "customer").select("c_custkey", F.ntile(4).over(w).alias("quarter"))


# sort, limit, sets


@query("SELECT o_orderkey, o_totalprice FROM orders ORDER BY o_totalprice DESC, o_orderkey LIMIT 10")
def top_k(spark, sf):
    return table(spark, sf, "orders").orderBy(F.desc("o_totalprice"), "o_orderkey").limit(10).select("o_orderkey", "o_totalprice")


@query("SELECT p_partkey, p_size, true AS in_order FROM part")
def sort_within_partitions(spark, sf):
    """Rows with whether each comes after the one before it in its partition."""
    rows = table(spark, sf, "part").select("p_partkey", "p_size").repartition("p_size").sortWithinPartitions("p_size", "p_partkey")

    def marked(batches):
        import pandas as pd

        last = None
        for batch in batches:
            pairs = list(zip(batch["p_size"], batch["p_partkey"]))
            yield batch.assign(in_order=[x is None or x <= y for x, y in zip([last, *pairs], pairs)])
            last = pairs[-1] if pairs else last

    return rows.mapInPandas(marked, "p_partkey bigint, p_size int, in_order boolean")


@query("SELECT c_custkey FROM customer ORDER BY c_custkey LIMIT 25")
def limit_total_order(spark, sf):
    return table(spark, sf, "customer").select("c_custkey").orderBy("c_custkey").limit(25)


@query("SELECT c_nationkey AS k FROM customer UNION ALL SELECT s_nationkey FROM supplier")
def union_all(spark, sf):
    return table(spark, sf, "customer").select(F.col("c_nationkey").alias("k")).union(table(spark, sf, "supplier").select("s_nationkey"))


@query("SELECT c_nationkey AS k FROM customer INTERSECT SELECT s_nationkey FROM supplier")
def intersect_set(spark, sf):
    return table(spark, sf, "customer").select(F.col("c_nationkey").alias("k")).intersect(table(spark, sf, "supplier").select("s_nationkey"))


@query("SELECT c_custkey AS k FROM customer EXCEPT SELECT o_custkey FROM orders WHERE o_orderstatus = 'P'")
def except_set(spark, sf):
    orders = table(spark, sf, "orders").where("o_orderstatus = 'P'")
    return frame.except_distinct(table(spark, sf, "customer").select(F.col("c_custkey").alias("k")), orders.select("o_custkey"))


# partitioning and caching


@query("SELECT o_custkey, count(*) AS n FROM orders GROUP BY o_custkey")
def repartition_hash(spark, sf):
    return table(spark, sf, "orders").repartition("o_custkey").groupBy("o_custkey").agg(F.count(F.lit(1)).alias("n"))


@query("SELECT n_name FROM nation")
def coalesce(spark, sf):
    return table(spark, sf, "nation").select("n_name").repartition(4).coalesce(2)


@query("SELECT s_nationkey, count(*) AS n, max(s_acctbal) AS most FROM supplier GROUP BY s_nationkey")
def cache_reuse(spark, sf):
    base = loops.hoist(table(spark, sf, "supplier").select("s_nationkey", "s_acctbal"))
    n, most = base.groupBy("s_nationkey").agg(F.count(F.lit(1)).alias("n")), base.groupBy("s_nationkey").agg(F.max("s_acctbal").alias("most"))
    return n.join(most, "s_nationkey")


@query("SELECT p_brand, count(*) AS n FROM part GROUP BY p_brand")
def checkpoint_reuse(spark, sf):
    return loops.cut(table(spark, sf, "part").groupBy("p_brand").agg(F.count(F.lit(1)).alias("n")))


@query("SELECT true AS all_known, true AS once, true AS share_near")
def sample_seeded(spark, sf):
    """Of a tenth: whether its rows are the table's, each once at most, and about as many as asked for."""
    orders = table(spark, sf, "orders").select("o_orderkey")
    part = orders.sample(False, 0.1, 7)
    known = part.join(orders.distinct().withColumn("known", F.lit(1)), "o_orderkey", "left")
    counts = known.agg(F.count(F.lit(1)).alias("n"), F.count("known").alias("known"), F.count_distinct("o_orderkey").alias("kinds")).crossJoin(orders.agg(F.count(F.lit(1)).alias("all")))
    return counts.select((F.col("known") == F.col("n")).alias("all_known"), (F.col("kinds") == F.col("n")).alias("once"), (F.abs(F.col("n") / F.col("all") - 0.1) < 0.05).alias("share_near"))


@query("SELECT o_orderkey, 1 AS parts, true AS share_near FROM orders")
def random_split_partition(spark, sf):
    """Each order is in one part, and the first has about its share."""
    a, b = table(spark, sf, "orders").select("o_orderkey").randomSplit([0.3, 0.7], 5)
    both = a.withColumn("first", F.lit(1)).union(b.withColumn("first", F.lit(0)))
    share = both.agg((F.abs(F.avg("first") - 0.3) < 0.06).alias("share_near"))
    return both.groupBy("o_orderkey").agg(F.count(F.lit(1)).cast("int").alias("parts")).crossJoin(F.broadcast(share))


# user-defined functions


@query("SELECT c_custkey, round(jaccard(c_name, c_mktsegment), 6) AS alike FROM customer")
def udf_scalar(spark, sf):
    """A function that Spark has no expression for: shared characters of two strings."""
    @F.pandas_udf("double")
    def alike(a, b):
        import pandas as pd

        return pd.Series([len(set(x) & set(y)) / max(1, len(set(x) | set(y))) for x, y in zip(a, b)])

    return table(spark, sf, "customer").select("c_custkey", F.round(alike("c_name", "c_mktsegment"), 6).alias("alike"))


class _CountByRegion(pardo.DoFn):
    """Looks each key up in the side input and puts out counts at the end of the bundle."""

    def setup(self):
        self.counts = {}

    def process(self, element, side=None):
        name = side.get(element["n_regionkey"])
        self.counts[name] = self.counts.get(name, 0) + 1

    def finish_bundle(self):
        return [{"region": k, "n": v} for k, v in self.counts.items()]


@query("SELECT r_name AS region, count(*) AS n FROM nation JOIN region ON n_regionkey = r_regionkey GROUP BY r_name")
def map_in_pandas_bundle(spark, sf):
    regions = {r["r_regionkey"]: r["r_name"] for r in table(spark, sf, "region").collect()}  # five rows
    parts = pardo.par_do(table(spark, sf, "nation"), _CountByRegion, "region string, n bigint", regions)
    return parts.groupBy("region").agg(F.sum("n").alias("n"))


class _BySize(pardo.DoFn):
    def process(self, element, side=None):
        yield {"tag": "large" if element["p_size"] > 25 else "small", "part": element["p_partkey"]}


@query("SELECT p_partkey AS part, CASE WHEN p_size > 25 THEN 'large' ELSE 'small' END AS size FROM part")
def pardo_tagged_outputs(spark, sf):
    out = pardo.par_do_tagged(table(spark, sf, "part"), _BySize, "part bigint", ["large", "small"])
    return out["large"].withColumn("size", F.lit("large")).union(out["small"].withColumn("size", F.lit("small")))


@query("SELECT p_partkey, unnest(string_split(p_name, ' ')) AS word FROM part")
def udtf_split(spark, sf):
    return table(spark, sf, "part").select("p_partkey", F.explode(java_split(F.col("p_name"))).alias("word"))


@query("SELECT c_mktsegment, round(avg(c_acctbal), 4) AS value FROM customer GROUP BY c_mktsegment")
def udaf_average_typed(spark, sf):
    out = aggregates.aggregate_by_key(table(spark, sf, "customer"), "c_mktsegment", "c_acctbal", aggregates.AVERAGE, "double")
    return out.select(F.col("key").alias("c_mktsegment"), F.round("value", 4).alias("value"))


@query("SELECT c_nationkey, round(avg(c_acctbal), 4) AS average FROM customer GROUP BY c_nationkey")
def udaf_average_sql(spark, sf):
    aggregates.register_average(spark)
    table(spark, sf, "customer").createOrReplaceTempView("sluice_customer")
    return spark.sql("SELECT c_nationkey, round(my_average(c_acctbal), 4) AS average FROM sluice_customer GROUP BY c_nationkey")


@query("SELECT n_name, length(n_name) AS n FROM nation WHERE length(n_name) > 6")
def df_transform_fn(spark, sf):
    return table(spark, sf, "nation").transform(lambda d: d.select("n_name", F.length("n_name").alias("n"))).transform(lambda d: d.where("n > 6"))


# SQL


@query("SELECT c_mktsegment, count(*) AS n FROM customer WHERE c_acctbal > 0 GROUP BY c_mktsegment")
def sql_temp_view(spark, sf):
    table(spark, sf, "customer").createOrReplaceTempView("sluice_customer")
    return spark.sql("SELECT c_mktsegment, count(*) AS n FROM sluice_customer WHERE c_acctbal > 0 GROUP BY c_mktsegment")


@query("SELECT s_name FROM supplier WHERE s_acctbal < 1000")
def sql_global_temp_view(spark, sf):
    table(spark, sf, "supplier").createOrReplaceGlobalTempView("sluice_supplier")
    return spark.newSession().sql("SELECT s_name FROM global_temp.sluice_supplier WHERE s_acctbal < 1000")


@query("SELECT 'Name: ' || p_name AS line FROM part WHERE p_size BETWEEN 13 AND 19")
def sql_between(spark, sf):
    table(spark, sf, "part").createOrReplaceTempView("sluice_part")
    return spark.sql("SELECT concat('Name: ', p_name) AS line FROM sluice_part WHERE p_size BETWEEN 13 AND 19")


@query("SELECT n_name AS name, CAST(n_nationkey AS VARCHAR) AS age FROM nation")
def programmatic_schema(spark, sf):
    rows = table(spark, sf, "nation").select("n_name", F.col("n_nationkey").cast("string"))
    return rows.to(spark.createDataFrame([], "n_name string, n_nationkey string").schema).toDF("name", "age")


# programs

_ALS = """
WITH RECURSIVE r AS (SELECT l_suppkey AS u, l_partkey AS i, avg(l_quantity) AS q FROM lineitem GROUP BY 1, 2),
i0 AS (SELECT i, avg(q) AS f FROM r GROUP BY i),
u1 AS (SELECT u, sum(q * f) / (0.05 * count(*)) AS f FROM r JOIN i0 USING (i) GROUP BY u),
i1 AS (SELECT i, sum(q * f) / (0.05 * count(*)) AS f FROM r JOIN u1 USING (u) GROUP BY i),
u2 AS (SELECT u, sum(q * f) / (0.05 * count(*)) AS f FROM r JOIN i1 USING (i) GROUP BY u),
i2 AS (SELECT i, sum(q * f) / (0.05 * count(*)) AS f FROM r JOIN u2 USING (u) GROUP BY i)
SELECT i AS item_id, round(log10(f), 6) AS log_factor FROM i2
"""


def _ratings(spark, sf):
    rows = table(spark, sf, "lineitem").groupBy("l_suppkey", "l_partkey").agg(F.avg("l_quantity").alias("rating"))
    return rows.select(F.col("l_suppkey").alias("user_id"), F.col("l_partkey").alias("item_id"), "rating")


@query(_ALS)
def als_golden_formula(spark, sf):
    return programs.als_without_gram(_ratings(spark, sf), rounds=2).select("item_id", F.round(F.log10("factor"), 6).alias("log_factor"))


@query("SELECT true AS fits_better, count(DISTINCT l_partkey) AS items FROM lineitem")
def als_exact(spark, sf):
    """Whether the factors predict ratings better than each item's mean does, and of how many items there are factors."""
    ratings = loops.hoist(_ratings(spark, sf))
    items = loops.hoist(programs.als(ratings, features=4, rounds=2))
    users = programs.solve_side(ratings, items, "item_id", "user_id", 4, deal=programs.few_ratings(ratings, "user_id"))
    mean = ratings.groupBy("item_id").agg(F.avg("rating").alias("mean"))
    users, factors = users.withColumnRenamed("factors", "uf"), items.withColumnRenamed("factors", "vf")
    both = ratings.join(mean, "item_id").join(factors, "item_id").join(users, "user_id")
    guess = F.aggregate(F.zip_with("uf", "vf", lambda a, b: a * b), F.lit(0.0), lambda a, x: a + x)
    error = lambda c: F.sqrt(F.avg((F.col("rating") - c) ** 2))
    return both.agg((error(guess) < error(F.col("mean"))).alias("fits_better"), F.count_distinct("item_id").alias("items"))


@query("""
WITH e AS (SELECT label AS y, unnest(embedding) AS x, generate_subscripts(embedding, 1) - 1 AS d FROM embeddings WHERE embedding IS NOT NULL AND label IS NOT NULL),
c AS (SELECT max(label) + 1 AS k, count(*) AS n FROM embeddings WHERE embedding IS NOT NULL AND label IS NOT NULL),
g AS (SELECT d, sum(x) AS s FROM e GROUP BY d), own AS (SELECT y, d, sum(x) AS s FROM e GROUP BY y, d)
SELECT CAST(t.y AS INTEGER) AS class, CAST(g.d AS INTEGER) AS feature, round((coalesce(own.s, 0) - g.s / c.k) / c.n, 6) AS weight
FROM c, range(1, (SELECT k FROM c)) t(y), g LEFT JOIN own ON own.y = t.y AND own.d = g.d
""")
def mlr_gradient_step(spark, sf):
    rows = table(spark, sf, "embeddings").where("embedding is not null and label is not null").select("label", F.col("embedding").alias("features"))
    shape = rows.agg(F.max("label"), F.max(F.size("features"))).first()
    weights, _ = programs.logistic_regression(rows, shape[0] + 1, shape[1], rounds=1)
    cells = [(k + 1, d, round(float(w), 6)) for k, row in enumerate(weights) for d, w in enumerate(row)]
    return spark.createDataFrame(cells, "class int, feature int, weight double")


@query("SELECT true AS near")
def pi_estimate(spark, sf):
    return programs.pi(spark, 1_000_000).select((F.abs(F.col("pi") - F.pi()) < 0.01).alias("near"))


# skew


@query("SELECT o_custkey % 3 AS k, CAST(sum(CAST(o_totalprice AS DECIMAL(18,2))) AS DOUBLE) AS total FROM orders GROUP BY 1")
def salted_group_sum(spark, sf):
    rows = table(spark, sf, "orders").select((F.col("o_custkey") % 3).alias("k"), F.col("o_totalprice").cast("decimal(18,2)").alias("v"))
    return skew.salted_sum(rows, "k", "v").select("k", F.col("total").cast("double").alias("total"))


_RANGES = """
WITH s AS (SELECT b, count(l_partkey) AS n FROM range(53) r(b) LEFT JOIN lineitem ON l_partkey % 53 = b GROUP BY b),
p AS (SELECT b + 1 AS border, sum(n) OVER (ORDER BY b) AS total FROM s),
k AS (SELECT k, k * ((SELECT max(total) FROM p) // 5) AS want FROM range(1, 5) r(k)),
c AS (SELECT k, border, row_number() OVER (PARTITION BY k ORDER BY abs(total - want), border DESC) AS place FROM k, p),
e AS (SELECT k, border FROM c WHERE place = 1 UNION ALL SELECT 0, 0 UNION ALL SELECT 5, 53)
"""


def _ranges(spark, sf):
    bucket = F.pmod("l_partkey", F.lit(53))
    sizes = {r["bucket"]: r["size"] for r in skew.bucket_sizes(table(spark, sf, "lineitem"), bucket, 53).collect()}  # one row a bucket
    return bucket, skew.key_ranges([[sizes.get(b, 0) for b in range(skew.bucket_count(5))]], 5)


@query(_RANGES + "SELECT CAST(border AS INTEGER) AS first, CAST(lead(border) OVER (ORDER BY k) AS INTEGER) AS stop FROM e QUALIFY stop IS NOT NULL")
def skew_ranges(spark, sf):
    return spark.createDataFrame(_ranges(spark, sf)[1], "first int, stop int")


@query(_RANGES + """, r AS (SELECT k, border AS first, lead(border) OVER (ORDER BY k) AS stop FROM e)
SELECT CAST(k AS INTEGER) AS part, count(*) AS n, count(DISTINCT l_partkey) AS kinds FROM lineitem JOIN r ON l_partkey % 53 >= first AND l_partkey % 53 < stop GROUP BY k""")
def skew_partitions(spark, sf):
    """Rows of each partition that the ranges make."""
    bucket, ranges = _ranges(spark, sf)
    rows = skew.partition_by_ranges(table(spark, sf, "lineitem").select("l_partkey"), bucket, ranges)
    return rows.groupBy(F.spark_partition_id().alias("part")).agg(F.count(F.lit(1)).alias("n"), F.count_distinct("l_partkey").alias("kinds"))


@query("SELECT o_custkey % 3 AS k, count(*) AS n, count(DISTINCT o_totalprice) AS kinds FROM orders GROUP BY 1")
def salted_distinct(spark, sf):
    rows = table(spark, sf, "orders").select((F.col("o_custkey") % 3).alias("k"), "o_totalprice")
    return skew.salted_lists(rows, "k", "o_totalprice").select("k", "n", F.col("kinds").cast("bigint").alias("kinds"))


# loops and side inputs


@query("SELECT p_partkey, CAST(floor(log2(p_size)) AS INTEGER) + 1 AS rounds FROM part WHERE p_size > 0")
def loop_until_stable(spark, sf):
    """Halve until nothing is left: the loop ends by its state."""
    state = table(spark, sf, "part").where("p_size > 0").select("p_partkey", F.col("p_size").alias("left"), F.lit(0).alias("rounds"))
    body = lambda x, _: x.select("p_partkey", F.expr("cast(left div 2 as int)").alias("left"), (F.col("rounds") + (F.col("left") > 0).cast("int")).alias("rounds"))
    return loops.iterate(state, body, 40, until=lambda x, _: x.where("left > 0").isEmpty()).select("p_partkey", "rounds")


@query("SELECT n_nationkey + 3 AS nation, NULL::INTEGER AS region FROM nation UNION ALL SELECT NULL, r_regionkey * 8 FROM region")
def loops_together(spark, sf):
    nations, regions = table(spark, sf, "nation").select(F.col("n_nationkey").alias("x")), table(spark, sf, "region").select(F.col("r_regionkey").alias("x"))
    a, b = loops.iterate_together([nations, regions], [lambda d, _: d.select((F.col("x") + 1).alias("x")), lambda d, _: d.select((F.col("x") * 2).alias("x"))], 3)
    return a.select(F.col("x").alias("nation"), F.lit(None).cast("int").alias("region")).union(b.select(F.lit(None).cast("int"), "x"))


@query("SELECT 'line: ' || r_name || chr(10) || (SELECT string_agg(r_name, chr(10) ORDER BY r_name) FROM region) AS value FROM region")
def broadcast_each_line(spark, sf):
    return programs.each_line_with_all(table(spark, sf, "region").select(F.col("r_name").alias("value")))


@query("SELECT n_name || ': ' || CAST(n_regionkey AS VARCHAR) AS value FROM nation")
def write_key_value_lines(spark, sf):
    path = _scratch(spark)
    io.write_text(table(spark, sf, "nation").select(key_value_line(F.col("n_name"), F.col("n_regionkey"))), path)
    return io.read(spark, "text", path)


@query("SELECT e.event_id AS event, f.event_id AS other FROM events e JOIN events f ON e.user_id = f.user_id AND f.ts > e.ts AND f.ts <= e.ts + INTERVAL 20 MINUTE")
def join_interval(spark, sf):
    events = table(spark, sf, "events").select("event_id", "user_id", "ts")
    pairs = frame.interval_join(events, events, "user_id", "ts", "ts", 0, 1200).where("_2.ts > _1.ts")
    return pairs.select(F.col("_1.event_id").alias("event"), F.col("_2.event_id").alias("other"))


# datasets of objects and texts


@dataclass(frozen=True)
class _Nation:
    name: str
    region: int


@query("SELECT n_name AS name, CAST(n_regionkey AS BIGINT) AS region FROM nation")
def dataset_of_objects(spark, sf):
    made = [_Nation(r["n_name"], r["n_regionkey"]) for r in table(spark, sf, "nation").collect()]  # 25 rows
    return io.from_objects(spark, made, _Nation).unionByName(io.empty(spark, "name string, region bigint"))


@query("SELECT CAST(n_nationkey AS BIGINT) AS k, n_name AS name FROM nation")
def typed_view(spark, sf):
    return frame.typed(table(spark, sf, "nation").select(F.col("n_nationkey").cast("string").alias("k"), F.col("n_name").alias("name")), "k bigint, name string")


@query("SELECT CAST(n_nationkey AS INTEGER) AS k, n_name AS name FROM nation")
def json_from_strings(spark, sf):
    lines = table(spark, sf, "nation").select(F.to_json(F.struct(F.col("n_nationkey").alias("k"), F.col("n_name").alias("name"))).alias("value"))
    return io.json_lines(spark, lines, "k int, name string")


@query("SELECT CAST(n_nationkey AS INTEGER) AS k, n_name AS name FROM nation")
def csv_from_strings(spark, sf):
    lines = table(spark, sf, "nation").select(F.to_csv(F.struct(F.col("n_nationkey").alias("k"), F.col("n_name").alias("name"))).alias("value"))
    return io.csv_lines(lines, "k int, name string")


@query("SELECT s_nationkey, count(*) AS n FROM supplier GROUP BY s_nationkey")
def unpersist_after_use(spark, sf):
    base = loops.hoist(table(spark, sf, "supplier").select("s_nationkey"))
    out = loops.cut(base.groupBy("s_nationkey").agg(F.count(F.lit(1)).alias("n")))
    base.unpersist()
    return out


# time


@query("SELECT time_bucket(INTERVAL 1 HOUR, ts, TIMESTAMP '1970-01-01') AS win_start, time_bucket(INTERVAL 1 HOUR, ts, TIMESTAMP '1970-01-01') + INTERVAL 1 HOUR AS win_end, event_type, count(*) AS n FROM events GROUP BY ALL")
def tumbling_window_events(spark, sf):
    return windows.windowed(table(spark, sf, "events"), "ts", "1 hour", by=("event_type",))


@query("""
WITH w AS (SELECT time_bucket(INTERVAL 30 MINUTE, ts, TIMESTAMP '1970-01-01') - k * INTERVAL 30 MINUTE AS s, ts FROM events, range(2) r(k))
SELECT s AS win_start, s + INTERVAL 1 HOUR AS win_end, count(*) AS n FROM w GROUP BY s
""")
def sliding_window_events(spark, sf):
    return windows.windowed(table(spark, sf, "events"), "ts", "1 hour", "30 minutes")


@query("""
WITH o AS (SELECT user_id, ts, CASE WHEN ts - lag(ts) OVER w < INTERVAL 30 MINUTE THEN 0 ELSE 1 END AS new FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts)),
s AS (SELECT *, sum(new) OVER (PARTITION BY user_id ORDER BY ts ROWS UNBOUNDED PRECEDING) AS k FROM o)
SELECT user_id, min(ts) AS win_start, max(ts) + INTERVAL 30 MINUTE AS win_end, count(*) AS n FROM s GROUP BY user_id, k
""")
def session_window_events(spark, sf):
    return windows.sessions(table(spark, sf, "events"), "ts", "30 minutes", ("user_id",))


# the RDD surface


def _pairs(spark, sf, name, key, value):
    return rdd.Collection.of(table(spark, sf, name).select(key, value)).map_to_pair(lambda r: (r[0], r[1]))


@query("SELECT n_regionkey AS key, CAST(sum(n_nationkey) AS BIGINT) AS total FROM nation GROUP BY n_regionkey")
def rdd_map_to_pair_reduce(spark, sf):
    pairs = _pairs(spark, sf, "nation", "n_regionkey", "n_nationkey").reduceByKey(lambda a, b: a + b)
    return spark.createDataFrame(pairs.rdd, "key int, total bigint")


@query("SELECT r_name AS region, n_name AS nation FROM region JOIN nation ON n_regionkey = r_regionkey")
def rdd_join(spark, sf):
    both = _pairs(spark, sf, "region", "r_regionkey", "r_name").join(_pairs(spark, sf, "nation", "n_regionkey", "n_name"))
    return spark.createDataFrame(both.values().rdd, "region string, nation string")


@query("SELECT n_nationkey AS key, s.n AS suppliers, c.n AS customers FROM nation LEFT JOIN (SELECT s_nationkey, count(*) AS n FROM supplier GROUP BY 1) s ON s_nationkey = n_nationkey LEFT JOIN (SELECT c_nationkey, count(*) AS n FROM customer GROUP BY 1) c ON c_nationkey = n_nationkey WHERE s.n IS NOT NULL OR c.n IS NOT NULL")
def rdd_outer_joins(spark, sf):
    count = lambda name, key: rdd.Collection.of(table(spark, sf, name).select(key)).keyBy(lambda r: r[0]).mapValues(lambda _: 1).reduceByKey(lambda a, b: a + b)
    both = count("supplier", "s_nationkey").fullOuterJoin(count("customer", "c_nationkey"))
    return spark.createDataFrame(both.map(lambda x: (x[0], *x[1])).rdd, "key int, suppliers bigint, customers bigint")


@query("SELECT n_nationkey AS key, (SELECT count(*) FROM supplier WHERE s_nationkey = n_nationkey) AS suppliers, (SELECT count(*) FROM customer WHERE c_nationkey = n_nationkey) AS customers FROM nation")
def rdd_cogroup(spark, sf):
    none = _pairs(spark, sf, "nation", "n_nationkey", "n_name")
    sides = [rdd.Collection.of(table(spark, sf, name).select(key, key)).map_to_pair(lambda r: (r[0], 1)) for name, key in (("supplier", "s_nationkey"), ("customer", "c_nationkey"))]
    grouped = none.groupWith(*(x.rdd for x in sides))
    return spark.createDataFrame(grouped.map(lambda x: (x[0], len(x[1][1]), len(x[1][2]))).rdd, "key int, suppliers bigint, customers bigint")


@query("SELECT p_partkey AS key, row_number() OVER (ORDER BY p_retailprice DESC, p_partkey) - 1 AS place FROM part")
def rdd_sort_with_index(spark, sf):
    rows = rdd.Collection.of(table(spark, sf, "part").select("p_partkey", "p_retailprice"))
    placed = rows.sortBy(lambda r: (-r[1], r[0]), numPartitions=3).zipWithIndex()
    return spark.createDataFrame(placed.map(lambda x: (x[0][0], x[1])).rdd, "key bigint, place bigint")


@query("SELECT c_custkey AS key, c_name AS name FROM customer ORDER BY c_custkey DESC LIMIT 30")
def rdd_sort_by_key(spark, sf):
    pairs = _pairs(spark, sf, "customer", "c_custkey", "c_name").sortByKey(ascending=False)
    return spark.createDataFrame(pairs.take(30), "key bigint, name string")


@query("SELECT sum(n_nationkey) AS total, count(*) AS n, max(n_nationkey) AS most, min(n_nationkey) AS least, sum(n_nationkey) AS folded, sum(n_nationkey) AS tree, count(*) AS tree_n FROM nation")
def rdd_aggregates(spark, sf):
    x = rdd.Collection.of(table(spark, sf, "nation").select("n_nationkey")).map(lambda r: r[0])
    total, n = x.aggregate((0, 0), lambda a, v: (a[0] + v, a[1] + 1), lambda a, b: (a[0] + b[0], a[1] + b[1]))
    found = (total, n, x.max(), x.min(), x.fold(0, lambda a, b: a + b), x.treeReduce(lambda a, b: a + b), x.treeAggregate(0, lambda a, _: a + 1, lambda a, b: a + b))
    return spark.createDataFrame([found], "total bigint, n bigint, most bigint, least bigint, folded bigint, tree bigint, tree_n bigint")


@query("SELECT DISTINCT unnest(string_split(lower(p_name), ' ')) AS word FROM part WHERE p_size > 20")
def rdd_flat_map_distinct(spark, sf):
    rows = rdd.Collection.of(table(spark, sf, "part").select("p_name", "p_size")).filter(lambda r: r[1] > 20)
    words = rows.flatMap(lambda r: r[0].lower().split(" ")).distinct()
    return spark.createDataFrame(words.map(lambda w: (w,)).rdd, "word string")


@query("SELECT p_brand AS brand, count(*) AS n, max(p_size) AS largest FROM part GROUP BY p_brand")
def rdd_group_by(spark, sf):
    grouped = rdd.Collection.of(table(spark, sf, "part").select("p_brand", "p_size")).groupBy(lambda r: r[0])
    return spark.createDataFrame(grouped.mapValues(list).map(lambda x: (x[0], len(x[1]), max(r[1] for r in x[1]))).rdd, "brand string, n bigint, largest int")


@query("SELECT o_orderstatus AS status, count(*) AS n FROM orders GROUP BY o_orderstatus")
def rdd_count_by_value(spark, sf):
    counts = rdd.Collection.of(table(spark, sf, "orders").select("o_orderstatus")).map(lambda r: r[0]).countByValue()
    return spark.createDataFrame(sorted(counts.items()), "status string, n bigint")


@query("SELECT CAST(k // 4 AS INTEGER) AS part, list(k ORDER BY k) AS held, sum(k) AS total FROM range(12) r(k) GROUP BY 1")
def rdd_partitions(spark, sf):
    """Contiguous slices, by glom, by index and by chosen partitions."""
    x = rdd.Collection.parallelize(spark, range(12), 3)
    sums = dict(x.mapPartitionsWithIndex(lambda k, it: [(k, sum(it))]).collect())
    assert x.collect_partitions([2, 0]) == [[8, 9, 10, 11], [0, 1, 2, 3]] and x.getNumPartitions() == 3
    return spark.createDataFrame([(k, held, sums[k]) for k, held in enumerate(x.glom().collect())], "part int, held array<bigint>, total bigint")


@query("SELECT 'least' AS kind, c_custkey AS key FROM (SELECT c_custkey FROM customer ORDER BY 1 LIMIT 5) UNION ALL SELECT 'top', c_custkey FROM (SELECT c_custkey FROM customer ORDER BY 1 DESC LIMIT 5)")
def rdd_take_ordered(spark, sf):
    x = rdd.Collection.of(table(spark, sf, "customer").select("c_custkey")).map(lambda r: r[0])
    return spark.createDataFrame([("least", k) for k in x.takeOrdered(5)] + [("top", k) for k in x.top(5)], "kind string, key bigint")


@query("SELECT n_regionkey AS key, CAST(avg(n_nationkey) AS DOUBLE) AS mean FROM nation WHERE n_regionkey <> 1 GROUP BY n_regionkey")
def rdd_combine_subtract(spark, sf):
    pairs = _pairs(spark, sf, "nation", "n_regionkey", "n_nationkey").subtractByKey(rdd.Collection.parallelize(spark, [(1, None)]))
    sums = pairs.combineByKey(lambda v: (v, 1), lambda a, v: (a[0] + v, a[1] + 1), lambda a, b: (a[0] + b[0], a[1] + b[1]))
    return spark.createDataFrame(sums.mapValues(lambda a: a[0] / a[1]).rdd, "key int, mean double")


@query("SELECT k AS value FROM (SELECT n_nationkey AS k FROM nation UNION ALL SELECT r_regionkey FROM region) WHERE k NOT IN (3, 4)")
def rdd_set_operations(spark, sf):
    a, b = (rdd.Collection.of(table(spark, sf, t).select(c)).map(lambda r: r[0]) for t, c in (("nation", "n_nationkey"), ("region", "r_regionkey")))
    kept = a.union(b).subtract(rdd.Collection.parallelize(spark, [3, 4])).coalesce(2).repartition(3)
    return spark.createDataFrame(kept.map(lambda x: (x,)).rdd, "value int")


@query("SELECT n_name AS line FROM nation")
def rdd_text_and_objects(spark, sf):
    """Lines written as objects and as text, and read again."""
    one, two = _scratch(spark), _scratch(spark)
    rdd.Collection.of(table(spark, sf, "nation").select("n_name")).map(lambda r: r[0]).save_as_object_file(one)
    rdd.Collection(spark.sparkContext.pickleFile(one)).saveAsTextFile(two)
    return spark.createDataFrame(rdd.Collection(spark.sparkContext.textFile(two)).map(lambda x: (x,)).rdd, "line string")


@query("SELECT count(*) AS n, sum(n_nationkey) AS total, 3 AS taken FROM nation")
def rdd_async(spark, sf):
    x = rdd.Collection.of(table(spark, sf, "nation").select("n_nationkey")).map(lambda r: r[0])
    n, all_, few = x.count_async(), x.collect_async(), x.take_async(3)
    return spark.createDataFrame([(n.result(), sum(all_.result()), len(few.result()))], "n bigint, total bigint, taken int")
