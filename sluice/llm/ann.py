"""Approximate nearest neighbours over balanced posting lists."""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from sluice.llm import common

#: Rows that the centroids are fitted on at most (those with the least hash).
SAMPLE_ROWS = 20_000
#: Rows a list should have, and lists at most (so that the graph of centroids fits in memory).
LIST_ROWS = 200
MOST_LISTS = 4096
#: A vector also joins lists whose centroid is at most this much farther than the nearest, up to REPLICAS.
CLOSURE = 0.15
REPLICAS = 4
#: A query reads all lists whose centroid is at most this much farther than the nearest.
PROBE_RATIO = 0.5
DEGREE = 16
BEAM = 80
#: Rows that one task reads: lists are put together up to so many, longer ones are dealt out.
SHARD_ROWS = 20_000


def balanced_centroids(points: np.ndarray, lists: int, seed: int = 3) -> np.ndarray:
    """Centroids of clusters of at most about len(points) / lists points: large clusters are split again."""
    rng = np.random.default_rng(seed)
    most = max(1, int(np.ceil(1.3 * len(points) / max(1, lists))))
    out, todo = [], [points]
    while todo:
        part = todo.pop()
        if len(part) <= most:
            out.append(part.mean(axis=0))
            continue
        k = int(min(8, np.ceil(len(part) / most)))
        centres = part[rng.choice(len(part), k, replace=False)].astype(np.float64)
        for _ in range(8):
            near = _squares(part, centres).argmin(axis=1)
            for c in range(k):
                if (near == c).any():
                    centres[c] = part[near == c].mean(axis=0)
        near = _squares(part, centres).argmin(axis=1)
        parts = [part[near == c] for c in range(k) if (near == c).any()]
        if len(parts) == 1:  # copies of one point can't be split
            out.append(part.mean(axis=0))
        else:
            todo.extend(parts)
    return np.array(out, np.float32)


def _squares(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    return np.maximum(0, (a * a).sum(1)[:, None] - 2 * a @ b.T + (b * b).sum(1)[None])


@dataclass(frozen=True)
class Graph:
    """Centroids and, for each, its nearest centroids and a few far ones."""

    centroids: np.ndarray
    edges: np.ndarray

    @staticmethod
    def build(centroids: np.ndarray, degree: int = DEGREE, seed: int = 5) -> Graph:
        n = len(centroids)
        near = np.argsort(_squares(centroids, centroids), axis=1, kind="stable")[:, 1 : degree + 1]
        far = np.random.default_rng(seed).integers(0, n, (n, max(1, degree // 4)))
        return Graph(centroids, np.concatenate([near, far], axis=1).astype(np.int32))

    def search(self, points: np.ndarray, most: int, beam: int = BEAM) -> tuple[np.ndarray, np.ndarray]:
        """The *most* nearest centroids found for each point and their distances, nearest first.

        Best-first search with a beam, for all points at once: each step opens every point's
        nearest centroid that isn't open yet, until the whole beam is open.
        """
        n, c = len(points), len(self.centroids)
        beam = min(max(beam, most), c)
        seen = np.zeros((n, c), bool)
        rows = np.arange(n)[:, None]
        starts = np.broadcast_to(np.unique(np.linspace(0, c - 1, min(c, 8)).astype(int)), (n, min(c, 8)) if c >= 8 else (n, c))
        ids = np.full((n, beam), -1, np.int32)
        dist = np.full((n, beam), np.inf, np.float32)
        opened = np.ones((n, beam), bool)
        new = starts
        for _ in range(4 * beam):
            d = ((points[:, None] - self.centroids[new]) ** 2).sum(-1)
            again = seen[rows, new]
            same = np.sort(new, axis=1)
            if (same[:, 1:] == same[:, :-1]).any():  # a neighbour listed twice counts once
                order = np.argsort(new, axis=1, kind="stable")
                dup = np.zeros_like(again)
                s = np.take_along_axis(new, order, 1)
                np.put_along_axis(dup, order[:, 1:], s[:, 1:] == s[:, :-1], 1)
                again |= dup
            seen[rows, new] = True
            d = np.where(again, np.inf, d)
            ids, dist, opened = (np.concatenate(x, axis=1) for x in ((ids, new), (dist, d), (opened, again)))
            best = np.argsort(dist, axis=1, kind="stable")[:, :beam]
            ids, dist, opened = (np.take_along_axis(x, best, 1) for x in (ids, dist, opened))
            at = np.argmin(opened, axis=1)  # the nearest that isn't open
            if opened[rows[:, 0], at].all():
                break
            done = opened[rows[:, 0], at]
            opened[rows[:, 0], at] = True
            new = self.edges[np.where(done, 0, np.maximum(ids[rows[:, 0], at], 0))]
        return ids[:, :most], np.sqrt(dist[:, :most])


def usable(vector: Column) -> Column:
    """Not null, some component not zero, none null or without a finite value."""
    fine = F.forall(vector, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    return F.coalesce(fine & F.exists(vector, lambda x: x != 0), F.lit(False))


def _matrix(column) -> np.ndarray:
    flat = column.combine_chunks() if hasattr(column, "combine_chunks") else column
    if hasattr(flat, "num_chunks"):
        flat = flat.chunk(0)
    return np.asarray(flat.flatten()).reshape(len(flat), -1)


def _assigner(sent):
    """Adds ``lists`` to batches whose last column is the vector: the nearest list, and others up to REPLICAS."""

    def run(batches):
        import pyarrow as pa

        for batch in batches:
            points, out = _matrix(batch.column(batch.num_columns - 1)).astype(np.float32), []
            graph = sent.value
            for k in range(0, len(points), 512):
                ids, dist = graph.search(points[k : k + 512], 2 * REPLICAS)
                for i, d in zip(ids, dist):
                    ok = (d <= (1 + CLOSURE) * d[0] + 1e-9) & (i >= 0)
                    chosen: list[int] = []
                    for c, x in zip(i[ok], d[ok]):  # a list beside a nearer chosen one adds nothing
                        if len(chosen) < REPLICAS and all(((graph.centroids[c] - graph.centroids[o]) ** 2).sum() > x * x for o in chosen):
                            chosen.append(int(c))
                    out.append(chosen)
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(out, pa.list_(pa.int32()))], names=[*batch.schema.names, "lists"])

    return run


def _groups(sizes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """For each list its group and the group's shards: neighbours up to SHARD_ROWS rows together, longer lists alone."""
    group, shards = np.zeros(len(sizes), np.int32), np.maximum(1, -(-sizes // SHARD_ROWS)).astype(np.int32)
    at, rows = 0, 0
    for c, m in enumerate(sizes.tolist()):
        if rows and rows + m > SHARD_ROWS:
            at, rows = at + 1, 0
        group[c] = at
        rows += m
    return group, shards


def _prober(sent, ratio: float, least: int):
    """Rows (rep, v, group, lists) of batches (rep, v): the lists that a query reads, by their groups.

    Those are all within *ratio* of the nearest centroid's distance, and further ones until the lists
    are the nearest ones of *least* rows.  The graph finds the nearest BEAM centroids; a query whose lists aren't
    all among these is held against every centroid.
    """

    def run(batches):
        import pyarrow as pa

        graph, group, own = sent.value
        centroids = graph.centroids.astype(np.float64)
        for batch in batches:
            points, at, groups, lists = _matrix(batch.column(1)).astype(np.float64), [], [], []
            for k in range(0, len(points), 512):
                part = points[k : k + 512]
                found, dist = graph.search(part.astype(np.float32), BEAM)
                for i, (order, d) in enumerate(zip(found, dist)):
                    order, d = order[order >= 0], d[order >= 0]
                    if d[-1] <= (1 + ratio) * d[0] + 1e-9 or own[order].sum() < least:
                        d = np.sqrt(((centroids - part[i]) ** 2).sum(1))
                        order = np.argsort(d, kind="stable")
                        d = d[order]
                    n = max(np.searchsorted(d, (1 + ratio) * d[0] + 1e-9, "right"), np.searchsorted(np.cumsum(own[order]), least) + 1)
                    read = np.sort(order[:n])
                    cuts = np.flatnonzero(np.diff(group[read])) + 1
                    for lot in np.split(read, cuts):
                        at.append(k + i)
                        groups.append(int(group[lot[0]]))
                        lists.append(lot.tolist())
            rows = batch.take(pa.array(at, pa.int64()))
            yield pa.RecordBatch.from_arrays([*rows.columns, pa.array(groups, pa.int32()), pa.array(lists, pa.list_(pa.int32()))], names=["rep", "v", "group", "lists"])

    return run


def nearest(vectors: DataFrame, queries: DataFrame, k: int = 10, id_col: str = "vec_id", vector_col: str = "embedding",
            sample_rows: int = SAMPLE_ROWS, list_rows: int = LIST_ROWS, probe_ratio: float = PROBE_RATIO, most_lists: int = MOST_LISTS) -> DataFrame:
    """The *k* nearest found of each query among *vectors*: query_id, rank, vec_id, score (Euclidean).

    Centroids of balanced clusters are fitted on a bounded sample and joined by a graph that every
    task holds (at most *most_lists* centroids, and a quarter of *sample_rows*: raise both for tables of many millions of rows).  Every row goes to the list of its nearest centroid, and a row near
    a border to further ones.  A query finds its nearest centroids by the graph and reads every list within a ratio of the nearest
    one's distance (all centroids are looked at where the graph's beam is too narrow for that), and further lists until they have *k* rows besides its own.  Groups of lists are dealt to
    tasks in shards of bounded size and meet their queries there.
    Copies of a vector beyond the k + 1 with the smallest ids can't be among the k nearest and aren't
    compared; equal queries are searched once.  Rows that are null, zero, not finite, or of another
    length than most take no part; a query's own id never is its neighbour; ties go to the smaller
    id; rows that repeat an id count once; an empty table or query set gives no rows; other columns aren't read.
    """
    spark = vectors.sparkSession
    kind = vectors.schema[vector_col].dataType.elementType.simpleString()
    kind = kind if kind == "float" else "double"  # no rounding before distances
    table = vectors.select(F.col(id_col).cast("long").alias("vec_id"), F.col(vector_col).cast(f"array<{kind}>").alias("v")).where(usable(F.col("v")) & F.col("vec_id").isNotNull())
    asked = queries.select(F.col(id_col).cast("long").alias("query_id"), F.col(vector_col).cast(f"array<{kind}>").alias("v")).where(usable(F.col("v")) & F.col("query_id").isNotNull())
    sizes = table.groupBy(F.size("v").alias("d")).count().orderBy(F.desc("count"), "d").limit(1).collect()
    schema = "query_id long, rank int, vec_id long, score double"
    if not sizes:
        return spark.createDataFrame([], schema)
    width, n = sizes[0]["d"], sizes[0]["count"]
    table, asked = table.where(F.size("v") == width), asked.where(F.size("v") == width).distinct()
    sample = table.select("vec_id", "v").orderBy(F.xxhash64("vec_id"), "vec_id").limit(sample_rows).toArrow()
    points = _matrix(sample.column("v")).astype(np.float32)
    lists = int(min(most_lists, max(1, n // list_rows), max(1, len(points) // 4)))
    with common.workspace(spark):
        return _search(table, asked, Graph.build(balanced_centroids(points, lists)), kind, k, probe_ratio)


def _search(table: DataFrame, asked: DataFrame, graph: Graph, kind: str, k: int, probe_ratio: float) -> DataFrame:
    spark = table.sparkSession
    sent = spark.sparkContext.broadcast(graph)

    postings = table.select("vec_id", "v").mapInArrow(_assigner(sent), f"vec_id long, v array<{kind}>, lists array<int>")
    postings = common.stage(postings.select("vec_id", "v", F.posexplode("lists").alias("place", "list")), "postings")
    copies = Window.partitionBy("list", F.xxhash64("v"), "v").orderBy("vec_id")  # cut to k + 1 before and after the shuffle
    postings = postings.withColumn("copy", F.row_number().over(copies)).where(F.col("copy") <= k + 1).drop("copy")
    postings = common.stage(postings, "searched")
    counts = postings.groupBy("list").agg(F.count(F.lit(1)).alias("rows"), F.count_if(F.col("place") == 0).alias("own")).collect()  # at most one row a centroid
    rows, own = np.zeros(len(graph.centroids), np.int64), np.zeros(len(graph.centroids), np.int64)
    for r in counts:
        rows[r["list"]], own[r["list"]] = r["rows"], r["own"]
    group, shards = _groups(rows)
    dealing = spark.createDataFrame([(c, int(group[c]), int(shards[c])) for c in range(len(rows))], "list int, group int, shards int")

    same = asked.groupBy("v").agg(F.min("query_id").alias("rep"))
    known = spark.sparkContext.broadcast((graph, group, own))
    probing = common.stage(same.select("rep", "v").mapInArrow(_prober(known, probe_ratio, k + 1), f"rep long, v array<{kind}>, group int, lists array<int>"), "probing")
    pieces = dealing.groupBy("group").agg(F.max("shards").alias("shards"))
    probing = probing.join(F.broadcast(pieces), "group").select("rep", "v", "lists", "group", F.explode(F.sequence(F.lit(0), F.col("shards") - 1)).alias("shard"))
    dealt = postings.join(F.broadcast(dealing), "list").select("vec_id", "v", "list", "group", F.pmod(F.xxhash64("vec_id"), "shards").cast("int").alias("shard"))
    most = len(rows)

    def compare(left, right):
        import pyarrow as pa

        reps, ids, dists = [], [], []
        if left.num_rows and right.num_rows:
            names, first, which = np.unique(left.column("vec_id").to_numpy(), return_index=True, return_inverse=True)
            rows, wanted = _matrix(left.column("v")).astype(np.float64)[first], _matrix(right.column("v")).astype(np.float64)
            squares, lists = (rows * rows).sum(axis=1), left.column("list").to_numpy()
            for rep, q, read in zip(right.column("rep").to_pylist(), wanted, right.column("lists").to_pylist()):
                open_ = np.zeros(most, bool)
                open_[read] = True
                here = np.zeros(len(rows), bool)
                here[which[open_[lists]]] = True
                at = np.flatnonzero(here)
                if len(at) > k + 1:  # by products first, with room for their rounding
                    near = (squares - 2 * rows @ q)[at]
                    at = at[near <= np.partition(near, k)[k] + 1e-9 * (squares.max() + q @ q)]
                d = np.sqrt(((rows[at] - q) ** 2).sum(axis=1))
                best = np.lexsort((names[at], d))[: k + 1]
                reps += [rep] * len(best)
                ids += names[at[best]].tolist()
                dists += d[best].tolist()
        return pa.table({"rep": pa.array(reps, pa.int64()), "vec_id": pa.array(ids, pa.int64()), "score": pa.array(dists, pa.float64())})

    found = dealt.groupBy("group", "shard").cogroup(probing.groupBy("group", "shard")).applyInArrow(compare, "rep long, vec_id long, score double")
    found = found.groupBy("rep", "vec_id").agg(F.min("score").alias("score"))
    best = found.withColumn("r", F.row_number().over(Window.partitionBy("rep").orderBy("score", "vec_id"))).where(F.col("r") <= k + 1).drop("r")
    members = asked.join(same.withColumnRenamed("v", "w"), F.col("v") == F.col("w")).select("query_id", "rep")
    own = members.join(best, "rep").where("query_id <> vec_id")
    rank = F.row_number().over(Window.partitionBy("query_id").orderBy("score", "vec_id"))
    return common.stage(own.select("query_id", rank.alias("rank"), "vec_id", "score").where(F.col("rank") <= k), "nearest", keep=True)


def op4_ann(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The ten nearest of every hundredth vector, among all vectors."""
    table = spark.read.parquet(f"{sf_dir}/embeddings.parquet")
    return nearest(table, table.where(F.col("vec_id") % 100 == 0))
