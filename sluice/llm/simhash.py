"""Near-duplicates by SimHash: a binary trie joined with itself under a Hamming error budget."""

from __future__ import annotations

from itertools import combinations

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sluice.llm import common

BITS = 64
#: The fingerprint's blocks; with BUDGET errors at least BLOCKS - BUDGET of them are free of errors.
BLOCKS = 6
BUDGET = 4
#: Fingerprints that one task's trie holds; larger nodes are split into pairs of child nodes.
NODE_ROWS = 32_768
GROUP_ROWS = 60_000
_CHUNK = 1 << 18


def shingle_hashes(text: str | None, shingle: int) -> np.ndarray:
    """xxh64 (seed 42) of each of the text's word shingles, as :func:`fingerprint` makes them; none without a word."""
    import xxhash

    words = (text or "").encode("utf-8", "surrogatepass").lower().split()
    n = max(1, len(words) - shingle + 1) if words else 0
    return np.fromiter((xxhash.xxh64_intdigest(b" ".join(words[k : k + shingle]), 42) for k in range(n)), np.uint64, n)


def majority(hashes: np.ndarray) -> int:
    """SimHash of *hashes*: bit b is one if it is set in over half of them; of none: zero."""
    votes = np.zeros(BITS, np.int64)
    for k in range(0, len(hashes), _CHUNK):  # bounded memory for very long texts
        votes += np.unpackbits(hashes[k : k + _CHUNK].view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return int(np.packbits(votes * 2 > len(hashes), bitorder="little").view(np.uint64)[0])


def fingerprint(text: str | None, shingle: int = 4) -> int:
    """SimHash of word shingles: bit b is one if it is set in over half of their xxh64 (seed 42).

    Words are runs without white space, A to Z in lower case; fewer words than a shingle make
    one shingle; no word at all gives zero.
    """
    import xxhash

    words = (text or "").encode("utf-8", "surrogatepass").lower().split()
    if not words:
        return 0
    joined, digest = b" ".join(words), xxhash.xxh64_intdigest
    ends = np.cumsum(np.fromiter(map(len, words), np.int64, len(words)) + 1)
    starts = np.concatenate(([0], ends[:-1]))
    n = max(1, len(words) - shingle + 1)
    last = ends[min(shingle, len(words)) - 1 :] - 1
    votes = np.zeros(BITS, np.int64)
    for k in range(0, n, _CHUNK):  # bounded memory for very long texts
        a, b = starts[k : min(n, k + _CHUNK)].tolist(), last[k : min(n, k + _CHUNK)].tolist()
        h = np.fromiter([digest(joined[i:j], 42) for i, j in zip(a, b)], np.uint64, len(a))
        votes += np.unpackbits(h.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return int(np.packbits(votes * 2 > n, bitorder="little").view(np.uint64)[0])


def fingerprints(docs: DataFrame, shingle: int, id_col: str, text_col: str) -> DataFrame:
    """doc_id and fp, the fingerprint as a signed long, of every row."""

    def run(batches):
        import pyarrow as pa

        for batch in batches:
            fps = np.array([fingerprint(t, shingle) for t in batch.column("text").to_pylist()], np.uint64).view(np.int64)
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(fps)], names=["doc_id", "fp"])

    table = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))
    return table.mapInArrow(run, "doc_id long, fp long")


def _roots(labels: np.ndarray, i: np.ndarray, j: np.ndarray) -> np.ndarray:
    """Component labels after the links i-j: least label, by repeated minimum and pointer jumping."""
    while True:
        low = np.minimum(labels[i], labels[j])
        before = labels.copy()
        np.minimum.at(labels, labels[i], low)
        np.minimum.at(labels, labels[j], low)
        np.minimum.at(labels, i, low)
        np.minimum.at(labels, j, low)
        labels = labels[labels]
        if np.array_equal(labels, before):
            return labels


def trie_self_join(fps: np.ndarray, groups: np.ndarray, budget: int = BUDGET, sides: np.ndarray | None = None) -> np.ndarray:
    """Labels (place of a component's first row) of the links within each group.

    fps: unsigned, sorted within groups; groups: sorted.  A node of a group's binary trie is a
    range of its sorted rows.  From (root, root) pairs of nodes go down together, bit by bit;
    unlike children add an error, and a pair over *budget* is pruned.  Small pairs are compared
    at once.  sides: if given, only rows on different sides of a group are paired.
    """
    n = len(fps)
    labels = np.arange(n)
    edges = np.flatnonzero(np.diff(groups)) + 1
    lo = np.concatenate(([0], edges))
    hi = np.concatenate((edges, [n]))
    keep = hi - lo > 1
    stack = [(63, lo[keep], hi[keep], lo[keep], hi[keep], np.zeros(keep.sum(), np.int8))]
    while stack:
        bit, al, ah, bl, bh, err = stack.pop()
        if len(al) > _CHUNK:  # a bounded frontier
            for k in range(0, len(al), _CHUNK):
                stack.append((bit, *(x[k : k + _CHUNK] for x in (al, ah, bl, bh, err))))
            continue
        work = (ah - al) * (bh - bl)
        small = (work <= 16) | (bit < 0)
        if small.any():
            a, b, w = al[small], bl[small], (bh - bl)[small]
            sizes = work[small]
            for k in range(0, len(a), 1 << 15):
                part = slice(k, k + (1 << 15))
                s = sizes[part]
                at = np.arange(s.sum()) - np.repeat(np.cumsum(s) - s, s)
                width = np.repeat(w[part], s)
                i, j = np.repeat(a[part], s) + at // width, np.repeat(b[part], s) + at % width
                near = (i < j) & (labels[i] != labels[j]) & (np.bitwise_count(fps[i] ^ fps[j]) <= budget)
                if sides is not None:
                    near &= sides[i] != sides[j]
                if near.any():
                    labels = _roots(labels, i[near], j[near])
        go = ~small
        if not go.any():
            continue
        al, ah, bl, bh, err = al[go], ah[go], bl[go], bh[go], err[go]
        ones = np.concatenate(([0], np.cumsum(fps >> np.uint64(bit) & np.uint64(1)).astype(np.int64)))
        am, bm = ah - (ones[ah] - ones[al]), bh - (ones[bh] - ones[bl])
        same = al == bl
        more = (err + 1).astype(np.int8)
        all_ = np.ones(len(al), bool)
        parts = [(al, am, bl, bm, err, all_), (am, ah, bm, bh, err, all_), (al, am, bm, bh, more, all_), (am, ah, bl, bm, more, ~same)]
        cols = [np.concatenate([p[c][p[5]] for p in parts]) for c in range(5)]
        ok = (cols[0] < cols[1]) & (cols[2] < cols[3]) & (cols[4] <= budget) & ~((cols[0] == cols[2]) & (cols[1] - cols[0] < 2))
        if ok.any():
            stack.append((bit - 1, *(c[ok] for c in cols)))
    return labels


def links(distinct: DataFrame, budget: int = BUDGET, blocks: int = BLOCKS, node_rows: int = NODE_ROWS) -> DataFrame:
    """Links (src, dst) that connect the same fingerprints as all pairs within *budget* bits.

    *distinct*: one row a fingerprint (fp).  Two that differ in at most *budget* bits agree on
    blocks - budget blocks, so for each such choice of blocks a trie that takes them first
    needs no error there: its subtries below them are joined each by itself.  A subtrie with more than
    *node_rows* rows is split at its next node pairs: each fingerprint goes to the pairs of
    its prefix with every prefix within the budget.  Tasks hand back a spanning forest, never pairs.
    """
    cuts = [round(k * BITS / blocks) for k in range(blocks + 1)]
    masks = [((1 << cuts[k + 1]) - (1 << cuts[k])) for k in range(blocks)]
    signed = lambda m: m - (1 << 64) if m >> 63 else m
    choices = [signed(sum(masks[k] for k in c)) for c in combinations(range(blocks), blocks - budget)]
    keys = F.array(*[F.struct(F.lit(c).alias("c"), F.col("fp").bitwiseAND(F.lit(m).cast("long")).alias("v")) for c, m in enumerate(choices)])
    rows = distinct.select("fp", F.explode(keys).alias("k")).select("fp", "k.c", "k.v")
    n = distinct.count()
    heavy = rows.groupBy("c", "v").count().where(F.col("count") > node_rows).select("c", "v", F.lit(True).alias("heavy"))
    rows = rows.join(F.broadcast(heavy) if n * len(choices) // node_rows <= 100_000 else heavy, ["c", "v"], "left")
    prefix = F.lit(0).cast("long")  # one bit of each block, so that any choice leaves some that differ
    for k in range(blocks):
        prefix = prefix + F.shiftrightunsigned("fp", cuts[k]).bitwiseAND(F.lit(1).cast("long")) * (1 << k)
    near = F.filter(F.sequence(F.lit(0), F.lit((1 << blocks) - 1)), lambda q: F.bit_count(q.cast("long").bitwiseXOR(F.col("p"))) <= budget)
    rows = rows.withColumn("p", prefix)
    light = rows.where("heavy is null").select("fp", "c", "v", F.lit(-1).cast("long").alias("a"), F.lit(-1).cast("long").alias("b"), F.lit(0).alias("side"))
    split = rows.where("heavy").select("fp", "c", "v", "p", F.explode(near.cast("array<long>")).alias("q"))
    split = split.select("fp", "c", "v", F.least("p", "q").alias("a"), F.greatest("p", "q").alias("b"), F.when(F.col("p") == F.col("q"), 0).otherwise(F.when(F.col("p") < F.col("q"), 1).otherwise(2)).alias("side"))
    groups = max(1, -(-n * len(choices) // GROUP_ROWS))
    tasks = light.unionByName(split).withColumn("task", F.pmod(F.xxhash64("c", "v", "a", "b"), F.lit(groups)).cast("int"))

    def join(table):
        import pyarrow as pa

        cols = [table.column(c).to_numpy() for c in ("c", "v", "a", "b", "fp", "side")]
        order = np.lexsort((cols[4].view(np.uint64), cols[3], cols[2], cols[1], cols[0]))
        c, v, a, b, fp, side = (x[order] for x in cols)
        change = np.zeros(len(fp), np.int64)
        change[1:] = (c[1:] != c[:-1]) | (v[1:] != v[:-1]) | (a[1:] != a[:-1]) | (b[1:] != b[:-1])
        group, fps = np.cumsum(change), np.ascontiguousarray(fp).view(np.uint64)
        pairs = a != b  # rows of one side meet in the pair of their own prefix
        found = np.concatenate([
            np.stack([at, at[trie_self_join(fps[at], group[at], budget, sides)]])
            for at, sides in ((np.flatnonzero(~pairs), None), (np.flatnonzero(pairs), side[pairs])) if len(at)
        ], axis=1)
        found = found[:, found[0] != found[1]]
        ends = np.unique(np.stack([fp[found[0]], fp[found[1]]], axis=1), axis=0)
        return pa.table({"src": ends[:, 0], "dst": ends[:, 1]})

    return tasks.groupBy("task").applyInArrow(join, "src long, dst long")


def simhash_groups(docs: DataFrame, shingle: int = 5, budget: int = BUDGET, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Fingerprint and group of every document: doc_id, fp, component_id.

    Groups are the components of the graph that links documents whose fingerprints differ in at
    most *budget* bits; component_id is the least doc_id of the group.  Only distinct
    fingerprints are joined, so copies never meet pairwise.  Null and empty texts have
    fingerprint zero and are linked like any other; null ids count as larger than all; repeated rows come
    back as often as they stand; an empty table gives no rows; other columns aren't read.
    """
    with common.workspace(docs.sparkSession):
        rows = common.stage(fingerprints(docs, shingle, id_col, text_col), "fingerprints", keep=True)
        distinct = common.stage(rows.groupBy("fp").agg(F.min("doc_id").alias("least")), "distinct")
        parts = common.connected_components(links(distinct.select("fp"), budget))
        rooted = distinct.join(parts, distinct["fp"] == parts["id"], "left").select("fp", "least", F.coalesce("root", "fp").alias("root"))
        least = rooted.groupBy("root").agg(F.min("least").alias("component_id"))
        labels = common.stage(rooted.join(least, "root").select("fp", "component_id"), "labels", keep=True)
    return rows.join(labels, "fp").select("doc_id", "fp", "component_id")


def op6_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Fingerprints of 4-word shingles and their groups at 4 bits, of all documents."""
    groups = simhash_groups(spark.read.parquet(f"{sf_dir}/documents.parquet"), shingle=4, budget=4)
    return groups.select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")
