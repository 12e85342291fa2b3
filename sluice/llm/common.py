"""Scratch tables on the shared store, session settings, and connected components."""

from __future__ import annotations

import atexit
import contextlib
import itertools
import shutil
import tempfile
import uuid
from collections.abc import Callable, Iterator

from py4j.protocol import Py4JJavaError
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

CHECKPOINT_KEY = "spark.checkpoint.dir"
#: Tables of at most so many narrow rows are broadcast; larger ones are joined by a shuffle.
BROADCAST_ROWS = 1_000_000
#: Threads that each of the driver's pools for exchanges may start; tables after whose writing the driver's free memory is given back.
POOL_THREADS, GARBAGE_TABLES = 16, 8
#: Bytes of code of the largest method that the JVM compiles; Spark generates larger ones for long expressions unless told so, and they are interpreted.
COMPILED_BYTES = 8000


def scratch_path(spark: SparkSession, label: str) -> str:
    """A new path in the folder that the cluster names in ``spark.checkpoint.dir``.

    Only where that is unset (single-machine tests) a temporary folder is made and set.
    """
    root = spark.conf.get(CHECKPOINT_KEY, None) or ""
    if not root:
        root = tempfile.mkdtemp(prefix="sluice-")
        atexit.register(shutil.rmtree, root, True)
        spark.conf.set(CHECKPOINT_KEY, root)
        spark.sparkContext.setCheckpointDir(root)
    return f"{root.rstrip('/')}/sluice/{label}-{uuid.uuid4().hex}"


def delete(spark: SparkSession, path: str) -> None:
    """Remove a table or folder from whichever store it lies in."""
    jvm, conf = spark.sparkContext._jvm, spark.sparkContext._jsc.hadoopConfiguration()
    at = jvm.org.apache.hadoop.fs.Path(path)
    at.getFileSystem(conf).delete(at, True)


def qualified(spark: SparkSession, path: str) -> str:
    """*path* with the scheme of the store it lies in; one without goes by the cluster's default, never by an executor's own disk."""
    jvm, conf = spark.sparkContext._jvm, spark.sparkContext._jsc.hadoopConfiguration()
    at = jvm.org.apache.hadoop.fs.Path(path)
    return at.getFileSystem(conf).makeQualified(at).toString()


def keep_only(spark: SparkSession, folder: str, names: set[str]) -> None:
    """Delete the files of *folder* that aren't among *names* (attempts that didn't count)."""
    jvm, conf = spark.sparkContext._jvm, spark.sparkContext._jsc.hadoopConfiguration()
    at = jvm.org.apache.hadoop.fs.Path(folder)
    store = at.getFileSystem(conf)
    for x in store.listStatus(at) if store.exists(at) else ():
        if x.getPath().getName() not in names:
            store.delete(x.getPath(), True)


def bound_pools(spark: SparkSession) -> None:
    """At most POOL_THREADS threads in each of the driver's pools that start exchanges, unless the session sets their number.

    By default each exchange gets a thread of its own, which lives on for a minute with a stack that planning has grown;
    operators of a hundred exchanges hold hundreds of them.  A pool looks at its setting once, when it is first used.
    """
    conf = spark._jsparkSession.sessionState().conf()  # settings of pools can't be changed by spark.conf
    for pool in ("shuffleExchange", "broadcastExchange", "resultQueryStage"):
        if not conf.contains(key := f"spark.sql.{pool}.maxThreadThreshold"):
            conf.setConfString(key, str(POOL_THREADS))


def return_memory(spark: SparkSession) -> bool:
    """Have the driver's JVM collect garbage, then give what its C allocator holds free back to the system; whether that was done.

    Threads that come and go leave free memory in the allocator's arenas, a few hundred MB after some hundred queries. Only some JVMs
    on Linux have the command.
    """
    jvm, new_array = spark.sparkContext._jvm, spark.sparkContext._gateway.new_array
    jvm.System.gc()
    lang, types = jvm.java.lang, jvm.java.lang.Class.forName
    texts, objects = new_array(lang.String, 0), new_array(lang.Object, 0)
    signature = new_array(lang.Class, 4)
    for k, name in enumerate(("javax.management.ObjectName", "java.lang.String", "[Ljava.lang.Object;", "[Ljava.lang.String;")):
        signature[k] = types(name)
    arguments = new_array(lang.Object, 4)
    arguments[0], arguments[1] = jvm.javax.management.ObjectName("com.sun.management:type=DiagnosticCommand"), "systemTrimNativeHeap"
    arguments[2], arguments[3] = objects, texts
    try:  # by the interface's method: the server's class isn't open to callers
        types("javax.management.MBeanServer").getMethod("invoke", signature).invoke(lang.management.ManagementFactory.getPlatformMBeanServer(), arguments)
    except Py4JJavaError:
        return False
    return True


_written = itertools.count(1)
_open: list[list[str]] = []


@contextlib.contextmanager
def workspace(spark: SparkSession) -> Iterator[None]:
    """Tables that :func:`stage` writes inside are deleted at the end, but for those it was told to keep
    (they belong to the workspace around this one, if there is one, else to the caller)."""
    mine: list[str] = []
    bound_pools(spark)
    _open.append(mine)
    try:
        yield
    finally:
        _open.remove(mine)
        for path in mine:
            delete(spark, path)


def stage(df: DataFrame, label: str, keep: bool = False) -> DataFrame:
    """Write *df* as a Parquet table on the shared store and read it back.

    Cuts lineage in a way that outlives any executor, and makes values that depend on
    the order of a partition's rows (task-local numbers) fixed for all later readers.  Shuffle files of the
    write go when it is done.  *keep*: the table outlives the :func:`workspace` it is written in.
    """
    spark = df.sparkSession
    path = scratch_path(spark, label)
    with settings(spark, spark__sql__classic__shuffleDependency__fileCleanup__enabled="true", spark__sql__codegen__hugeMethodLimit=str(COMPILED_BYTES)):
        df.write.option("compression", "zstd").parquet(path)
    if next(_written) % GARBAGE_TABLES == 0:  # else the heap grows to its bound by plans that nobody needs
        return_memory(spark)
    owners = _open[:-1] if keep else _open
    if owners:
        owners[-1].append(path)
    return spark.read.schema(df.schema).parquet(path)


def small(df: DataFrame, bound: int = BROADCAST_ROWS) -> DataFrame:
    """Marked for broadcast if it is counted to be small (rows of a few numbers each)."""
    return F.broadcast(df) if df.count() <= bound else df


@contextlib.contextmanager
def settings(spark: SparkSession, **conf: str) -> Iterator[None]:
    """Session settings (dots written as two underscores) for the jobs run inside."""
    keys = {k.replace("__", "."): v for k, v in conf.items()}
    old = {k: spark.conf.get(k, None) for k in keys}
    for k, v in keys.items():
        spark.conf.set(k, v)
    try:
        yield
    finally:
        for k, v in old.items():
            spark.conf.unset(k) if v is None else spark.conf.set(k, v)


def let(value: Column, use: Callable[[Column], Column]) -> Column:
    """use(value), with *value* computed once, however often it is used within lambdas."""
    return F.get(F.transform(F.array(value), use), F.lit(0))


def collapse_spaces(text: Column) -> Column:
    """Each run of ``[\\x20\\x09-\\x0D]`` becomes one space; literal replacements first,
    the regular expression only for the few texts that still hold two spaces in a row."""
    for c in "\t\n\x0b\x0c\r":
        text = F.replace(text, F.lit(c), F.lit(" "))
    return F.when(F.contains(text, F.lit("  ")), F.regexp_replace(text, "\\x20+", " ")).otherwise(text)


def connected_components(edges: DataFrame) -> DataFrame:
    """Components of the undirected graph of *edges* (src, dst), as rows (id, root).

    root is the smallest id of the component.  Vertices without an edge are not
    listed; null ends and loops are ignored; an empty graph gives no rows.  Alternates
    large-star and small-star steps, which keep connectivity and end, after a number of
    rounds logarithmic in the longest path, with one star around each root.  Every round
    is a table on the shared store; nothing but two counters reaches the driver.
    """
    links = edges.select(F.greatest("src", "dst").alias("u"), F.least("src", "dst").alias("v"))
    links, mark = stage(links.where("u is not null and v is not null and u <> v").distinct(), "cc"), None
    while True:
        both = links.unionByName(links.select(F.col("v").alias("u"), F.col("u").alias("v")))
        low = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        large = both.join(low, "u").where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v"))
        large = large.where("u <> v").distinct()
        low = large.groupBy("u").agg(F.min("v").alias("m"))
        small_ = large.join(low, "u").select(F.col("v").alias("u"), F.col("m").alias("v"))
        small_ = small_.unionByName(low.select("u", F.col("m").alias("v")))
        links = stage(small_.where("u <> v").distinct(), "cc")
        now = links.agg(F.count(F.lit(1)), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        if tuple(now) == mark:
            return links.select(F.col("u").alias("id"), F.col("v").alias("root")).unionByName(
                links.select(F.col("v").alias("id"), F.col("v").alias("root")).distinct()
            )
        mark = tuple(now)
