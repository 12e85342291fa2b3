"""Packing of token ids into sequences of bounded length."""

from __future__ import annotations

import struct
import zlib
from bisect import bisect_left, insort
from collections.abc import Iterator

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sluice.llm import common, tokens

WINDOW = 1024
OPEN_WINDOWS = 64
#: A window whose free room is above this when it has to be emitted is first filled by cutting the piece.
MAX_WASTE = 8
#: Partitions whose leftovers one task merges in a round.
FAN_IN = 16

_SCHEMA = "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long, leftover binary, part int"

Piece = tuple[int | None, int, int, bytes]  # doc_id, start, doc_tokens, ids


class Packer:
    """Online best-fit packing with a fixed number of open windows.

    A piece goes to the open window that it fits with the least room left.  If it fits none,
    a new window opens, or, when all are open, the fullest is emitted (after the piece is cut
    to fill it, if more than ``max_waste`` places would stay free).
    """

    def __init__(self, window: int = WINDOW, open_windows: int = OPEN_WINDOWS, max_waste: int = MAX_WASTE) -> None:
        self._window, self._most, self._waste = window, open_windows, max_waste
        self._room: list[tuple[int, int]] = []  # (free places, number), ascending
        self._held: dict[int, list[Piece]] = {}
        self._next = 0

    def _put(self, piece: Piece) -> Iterator[list[Piece]]:
        size = len(piece[3]) // 4
        k = bisect_left(self._room, (size, -1))
        if k < len(self._room):
            free, w = self._room.pop(k)
            self._held[w].append(piece)
            if free == size:
                yield self._held.pop(w)
            else:
                insort(self._room, (free - size, w))
            return
        if len(self._room) == self._most:
            free, w = self._room.pop(0)
            if free > self._waste:
                doc, start, total, ids = piece
                self._held[w].append((doc, start, total, ids[: 4 * free]))
                piece = (doc, start + free, total, ids[4 * free :])
                yield self._held.pop(w)
                yield from self._put(piece)
                return
            yield self._held.pop(w)
        self._held[self._next] = [piece]
        insort(self._room, (self._window - size, self._next))
        self._next += 1

    def add(self, doc_id: int | None, ids: bytes) -> Iterator[list[Piece]]:
        """The windows that this document's ids fill or push out."""
        total, step = len(ids) // 4, 4 * self._window
        whole = len(ids) // step * step
        for at in range(0, whole, step):
            yield [(doc_id, at // 4, total, ids[at : at + step])]
        if whole < len(ids):
            yield from self._put((doc_id, whole // 4, total, ids[whole:]))

    def rest(self) -> list[list[Piece]]:
        """The windows still open, the fullest first."""
        return [self._held[w] for _, w in self._room]


def fill(pieces: list[Piece], window: int = WINDOW) -> list[list[Piece]]:
    """Cut and join pieces to full windows; only the last may have room left."""
    out: list[list[Piece]] = []
    free = 0
    for doc, start, total, ids in pieces:
        while ids:
            if not free:
                out.append([])
                free = window
            take = ids[: 4 * free]
            out[-1].append((doc, start, total, take))
            free -= len(take) // 4
            start, ids = start + len(take) // 4, ids[len(take) :]
    return out


def _batch(windows: list[tuple[int, list[Piece]]], keep_ids: bool, part: int):
    import pyarrow as pa

    rows = []
    for seq, pieces in windows:
        at = 0
        for doc, start, total, ids in pieces:
            n = len(ids) // 4
            rows.append((doc, start, n, zlib.crc32(ids), total, seq, at, ids if keep_ids else None, part))
            at += n
    types = [pa.int64()] * 7 + [pa.binary(), pa.int32()]
    names = [x.split()[0] for x in _SCHEMA.split(", ")]
    return pa.RecordBatch.from_arrays([pa.array([r[k] for r in rows], t) for k, t in enumerate(types)], names=names)


def _merge(window: int, level: int, last: bool):
    """One round's task: joins the leftovers of a few partitions."""

    def merge(key, table):
        import pyarrow as pa

        group = key[0].as_py()
        rows = sorted(table.to_pylist(), key=lambda r: (r["sequence_id"], r["offset"]))
        windows = fill([(r["doc_id"], r["start"], r["doc_tokens"], r["leftover"]) for r in rows], window)
        base = level << 56 | group << 32
        numbered = [(base + k, x) for k, x in enumerate(windows)]
        cut = len(numbered) - (not last and sum(len(p[3]) for p in windows[-1]) < 4 * window)
        return pa.Table.from_batches([_batch(numbered[:cut], False, group), _batch(numbered[cut:], True, group)])

    return merge


def pack(docs: DataFrame, vocabulary: str, end_id: int, window: int = WINDOW, open_windows: int = OPEN_WINDOWS,
         max_waste: int = MAX_WASTE, fan_in: int = FAN_IN, id_col: str = "doc_id", text_col: str = "text", cache_words: int = tokens.CACHE_WORDS) -> DataFrame:
    """Pack every document's ids (with *end_id* appended) into sequences of at most *window* ids.

    One row a piece: doc_id, start, length, ids_crc32, doc_tokens, sequence_id, offset.
    Each partition packs its documents as they come, without a shuffle, with *open_windows*
    windows in memory.  Windows left open are merged *fan_in* partitions at a time, round
    after round, until one task holds the last; each round leaves one window a task that
    isn't full.  The packed rows are written once, so numbers stay fixed when tasks repeat.
    Null texts count as empty (one id); null and repeated ids are kept as they are, a row
    being a document of its own; an empty table gives no rows; other columns aren't read.
    *cache_words*: words whose ids a worker keeps (about 200 bytes each); it changes nothing but time and memory.
    """
    table = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))

    def first(batches):
        from pyspark import TaskContext

        part = TaskContext.get().partitionId()
        encode, end, seq = tokens.encoder(vocabulary, cache_words).encode, struct.pack("<I", end_id), part << 32
        packer = Packer(window, open_windows, max_waste)
        for batch in batches:
            for k in range(0, batch.num_rows, 1000):
                rows, full = batch.slice(k, 1000), []
                for doc, x in zip(rows.column("doc_id").to_pylist(), encode(rows.column("text").to_pylist())):
                    for pieces in packer.add(doc, x + end):
                        full.append((seq, pieces))
                        seq += 1
                yield _batch(full, False, part)
        yield _batch([(seq + k, pieces) for k, pieces in enumerate(packer.rest())], True, part)

    spark = docs.sparkSession
    packed = common.stage(table.mapInArrow(first, _SCHEMA), "packed", keep=True)
    done = [packed.where("leftover is null")]
    left = packed.where("leftover is not null")
    parts, level = (packed.agg(F.max("part")).first()[0] or 0) + 1, 0
    while True:
        level += 1
        parts = -(-parts // fan_in)

        grouped = left.withColumn("part", F.floor(F.col("part") / fan_in).cast("int")).groupBy("part")
        merged = common.stage(grouped.applyInArrow(_merge(window, level, parts == 1), _SCHEMA), "packed", keep=True)
        done.append(merged.where("leftover is null"))
        left = merged.where("leftover is not null")
        if parts == 1:
            break
    out = done[0]
    for x in done[1:]:
        out = out.unionByName(x)
    return out.drop("leftover", "part")


def op9_packing(spark: SparkSession, sf_dir: str, vocabulary: str | None = None) -> DataFrame:
    """Pieces of all documents in sequences of at most 1024 ids, end id 0."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    return pack(docs, vocabulary or tokens.vocabulary("byte_bpe_50k.json"), end_id=0)
