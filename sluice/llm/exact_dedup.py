"""Exact deduplication as a streaming job with keyed state on disk."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from sluice.llm import common

ROCKSDB = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"
FILES_PER_TRIGGER = 1000
ROWS_PER_SALT = 1000


def sha256(text: Column) -> Column:
    return F.sha2(text, 256)


def _pattern(path: str) -> str:
    """*path* as a pattern that only it matches: a stream takes a single file only by a pattern."""
    path = path.rstrip("/")
    return f"{path[:-1]}[{path[-1]}]"


def _keyed(raw: DataFrame, id_col: str, text_col: str, digest: Callable[[Column], Column]) -> DataFrame:
    """norm, digest, doc_id, and loc: (id is null, id, file, row), by which the row that stays is least."""
    text = common.collapse_spaces(F.coalesce(F.col(text_col), F.lit("")))
    out = raw.select(F.col(id_col).cast("long").alias("doc_id"), text.alias("norm"), F.col("_metadata.file_path").alias("file"), F.col("_metadata.row_index").alias("row"))
    loc = F.struct(F.isnull("doc_id").alias("no_id"), "doc_id", "file", "row")
    return out.select("doc_id", "norm", digest(F.col("norm")).alias("digest"), loc.alias("loc"))


def exact_dedup(spark: SparkSession, path: str, id_col: str = "doc_id", text_col: str = "text",
                digest: Callable[[Column], Column] = sha256, files_per_trigger: int = FILES_PER_TRIGGER,
                rows_per_salt: int = ROWS_PER_SALT, state_dir: str | None = None) -> DataFrame:
    """Copies among the texts of the Parquet table at *path*, equal up to white space.

    A streaming query reads the files and keeps, for each digest, in RocksDB state that never
    expires: the least identifier, its content locator (file and row), and how often the digest came.  Partial
    aggregation runs before the shuffle, so a hot text is one row a task.  Then each row whose
    digest was seen more than once is a hit: its bytes are compared with those at the locator
    (hot digests salted by how many rows they have).  If texts that differ share a digest,
    their rows are grouped by the texts themselves.

    *state_dir*: a folder for the stream's checkpoint and what it has seen, so that a later call goes on from there and its stream reads
    only new files; without it they go when the call is done.

    One row per row of the table: doc_id, keep_id, group_size, kept, text_sha256.
    Null text counts as empty; a null id is larger than all others and kept rows that have it
    say null as keep_id; of rows that share the smallest id, the first by file and row stays;
    an empty table gives no rows; other columns are not read.
    """
    schema = spark.read.parquet(path).schema
    where = state_dir or common.scratch_path(spark, "exact-dedup")
    with common.settings(spark, spark__sql__streaming__stateStore__providerClass=ROCKSDB,
                         spark__sql__streaming__stateStore__rocksdb__changelogCheckpointing__enabled="true",
                         spark__sql__streaming__stateStore__rocksdb__boundedMemoryUsage="true",
                         spark__sql__streaming__stateStore__rocksdb__maxMemoryUsageMB="200",
                         spark__sql__streaming__stateStore__rocksdb__allowFAllocate="false"):
        stream = spark.readStream.schema(schema).option("maxFilesPerTrigger", files_per_trigger).parquet(_pattern(path))
        state = _keyed(stream, id_col, text_col, digest).groupBy("digest").agg(F.min("loc").alias("keep"), F.count(F.lit(1)).alias("n"))
        query = (
            state.writeStream.outputMode("update").option("checkpointLocation", f"{where}/checkpoint").trigger(availableNow=True)
            .foreachBatch(lambda batch, k: batch.write.mode("overwrite").parquet(f"{where}/seen/batch={k}")).start()
        )
        query.awaitTermination()
    rows = _keyed(spark.read.schema(schema).parquet(path), id_col, text_col, digest)
    if not query.lastProgress and not query.recentProgress:
        spark.createDataFrame([], "digest string, keep struct<no_id:boolean,doc_id:bigint,file:string,row:bigint>, n bigint").write.mode("append").parquet(f"{where}/seen/batch=0")
    seen = spark.read.parquet(f"{where}/seen").groupBy("digest").agg(F.min("keep").alias("keep"), F.max("n").alias("n"))
    with common.workspace(spark):
        seen = common.stage(seen, "seen", keep=True)
        if not state_dir:
            common.delete(spark, where)
        salts = F.floor(F.col("n") / rows_per_salt).cast("int")
        hits = rows.join(seen.where("n > 1"), "digest").withColumn("salt", F.pmod(F.xxhash64("loc"), salts + 1).cast("int"))
        hits = common.stage(hits, "hits")
        held = hits.where("loc = keep").select("digest", F.col("norm").alias("kept_norm"), F.explode(F.sequence(F.lit(0), salts)).alias("salt"))
        unlike = common.stage(hits.join(held, ["digest", "salt"]).where("norm <> kept_norm").select("digest").distinct(), "unlike")
        out = rows.drop("norm").join(seen, "digest").withColumn("text_sha256", F.col("digest"))
        if digest is not sha256:
            out = rows.withColumn("text_sha256", sha256(F.col("norm"))).drop("norm").join(seen, "digest")
        if not unlike.isEmpty():
            hits = hits.join(unlike, "digest").withColumn("text_sha256", sha256(F.col("norm")))
            texts = hits.groupBy("digest", "norm").agg(F.min("loc").alias("keep"), F.count(F.lit(1)).alias("n"))
            again = hits.drop("keep", "n").join(texts, ["digest", "norm"]).select(*out.columns)
            out = common.stage(out.join(unlike, "digest", "left_anti").unionByName(again), "out", keep=True)
    return out.select("doc_id", F.col("keep.doc_id").alias("keep_id"), F.col("n").alias("group_size"), (F.col("loc") == F.col("keep")).alias("kept"), "text_sha256")


def op1_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Copies among all documents."""
    return exact_dedup(spark, f"{sf_dir}/documents.parquet")


OP1_SQL = r"""
WITH t AS (
  SELECT doc_id, regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]+', ' ', 'g') AS norm FROM documents
)
SELECT doc_id, min(doc_id) OVER w AS keep_id, count(*) OVER w AS group_size,
       doc_id = min(doc_id) OVER w AS kept, sha256(norm) AS text_sha256
FROM t WINDOW w AS (PARTITION BY norm)
"""
