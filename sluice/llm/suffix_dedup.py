"""Removal of byte strings that an earlier document already holds.

What is equal is decided by Burrows-Wheeler transforms of bounded size, whose suffix intervals are extended
breadth-first up to LENGTH bytes.  Hashes only bring the bytes together that have to be in one transform:

Every window of LENGTH bytes is led by its anchor, the least-hashed K-gram in it, so equal
windows have equal anchors at equal places.  The windows that one anchor leads are a
segment of at most 2 * LENGTH - K bytes.  Packs of documents send the hashes of their distinct segments
(with the least document) to the anchor's bucket, which tells the packs what their segments may share.
Runs of segments that an earlier document seems to hold, and that document's own, then come together as bytes;
so do the segments that differ but have an anchor in common, once each.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sluice.llm import common

LENGTH = 50
K = 24
#: Bytes of text in a pack, rows in a pack, and distinct segments that one bucket gets on average.
PACK_BYTES = 2 << 20
PACK_ROWS = 20_000
BUCKET_SEGMENTS = 200_000
#: Bytes that one transform takes (one run of an earlier document at least), and bytes of text a bucket of them stands for.
BATCH_BYTES = 1 << 20
BUCKET_BYTES = 8 << 20
#: Packs whose runs meet in one group with an earlier document's; more are dealt to further groups.
PACKS_A_GROUP = 8
#: The windows of an anchor that leads more segments that differ come together each by itself.
HOT_SEGMENTS = 2000
_SLICE = 1 << 17
_U = np.uint64
_BASE = 0x9E3779B97F4A7C15
_LAST_ID = (1 << 63) - 1


@lru_cache
def _byte_values() -> np.ndarray:
    return np.random.default_rng(97).integers(0, 1 << 63, 256, dtype=np.uint64) * _U(2) + _U(1)


@lru_cache(maxsize=1)
def _powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """The first *n* powers of the base and of its inverse, modulo 2**64."""
    up, down = np.full(n, _BASE, np.uint64), np.full(n, pow(_BASE, -1, 1 << 64), np.uint64)
    up[0] = down[0] = 1
    return np.multiply.accumulate(up), np.multiply.accumulate(down)


def _mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ x >> _U(31)) * _U(0xBF58476D1CE4E5B9)
    return x ^ x >> _U(29)


def _kgrams(data: np.ndarray) -> np.ndarray:
    """Hash of the K bytes from each place."""
    part, width, base, out, have = _byte_values()[data], 1, _BASE, None, 0
    while width <= K:  # by doubling: K is the sum of powers of two
        if K & width:
            if out is None:
                out, have = part, width
            else:  # the longer part first, then what is there
                n = len(part) - have
                out, have = part[:n] * _U(pow(_BASE, have, 1 << 64)) + out[width : width + n], have + width
        if len(part) <= width:
            break
        part = part[:-width] * _U(base) + part[width:]
        width, base = 2 * width, base * base & (1 << 64) - 1
    return _mix(out[: max(0, len(data) - K + 1)]) if out is not None and len(data) >= K else np.zeros(0, np.uint64)


def segments(data: np.ndarray, starts: np.ndarray, stops: np.ndarray) -> tuple[np.ndarray, ...]:
    """Runs of windows that one anchor leads: first and last window, document, hashes of anchor and segment; and of all K-grams."""
    none = (np.zeros(0, np.int64),) * 3 + (np.zeros(0, np.uint64),) * 3
    if len(data) < LENGTH:
        return none
    span, n = LENGTH - K + 1, len(data) - LENGTH + 1
    grams = np.empty(n + span - 1, np.uint64)
    anchor = np.empty(n, np.int64)
    for at in range(0, n, _SLICE):  # slices that stay in a core's cache
        size = min(_SLICE, n - at)
        here = grams[at : at + size + span - 1] = _kgrams(data[at : at + size + LENGTH - 1])
        low = here >> _U(22) << _U(22) | np.arange(len(here), dtype=np.uint64)  # ties: the first place
        width = 1
        while 2 * width <= span:
            low = np.minimum(low[:-width], low[width:])
            width *= 2
        low = np.minimum(low[:size], low[span - width : span - width + size])
        anchor[at : at + size] = (low & _U((1 << 22) - 1)).astype(np.int64) + at
    lens = stops - starts
    doc = np.repeat(np.arange(len(starts)), lens)[:n]
    inside = np.arange(n) + LENGTH <= stops[doc]
    first = inside.copy()
    first[1:] &= (anchor[1:] != anchor[:-1]) | (doc[1:] != doc[:-1]) | ~inside[:-1]
    last = inside.copy()
    last[:-1] &= first[1:] | ~inside[1:]
    lo, hi = np.flatnonzero(first), np.flatnonzero(last)
    up, down = _powers(max(PACK_BYTES, 1 << (len(data) - 1).bit_length()))
    total = np.zeros(len(data) + 1, np.uint64)
    np.cumsum(_byte_values()[data] * up[: len(data)], dtype=np.uint64, out=total[1:])
    whole = _mix((total[hi + LENGTH] - total[lo]) * down[lo] + (hi - lo).astype(np.uint64))
    return lo, hi, doc[lo], grams[anchor[lo]], whole, grams


def suffix_order(text: np.ndarray) -> tuple[np.ndarray, int, np.ndarray]:
    """Places of *text* sorted by the bytes from there on, as far as 64 of them tell; 32, and the rank of each place by 32 bytes."""
    n = len(text)
    wide = np.concatenate((text, np.zeros(8, np.uint8))).astype(np.uint64)
    key = np.zeros(n, np.uint64)
    for k in range(8):
        key = key << _U(8) | wide[k : k + n]
    step = 8
    while True:
        order = np.argsort(key)
        if step == 64:
            return order.astype(np.int32), step // 2, rank.astype(np.int32)
        s = key[order]
        rank = np.empty(n, np.uint64)
        rank[order] = np.cumsum(np.concatenate(([1], s[1:] != s[:-1]))).astype(np.uint64)
        key = rank << _U(32)
        key[: max(0, n - step)] |= rank[step:]
        step *= 2


def prefix_groups(text: np.ndarray, length: int = LENGTH) -> tuple[np.ndarray, np.ndarray]:
    """Suffix order, and where in it a new common prefix of *length* bytes (33 to 64) begins.

    Breadth-first backward extension on the Burrows-Wheeler transform: intervals of suffixes
    that share l bytes are extended by the byte before them, all at once.  Two neighbours that
    begin alike share l + 1 bytes unless the suffixes behind their first byte lie in different
    intervals; so each round finds the places whose longest common prefix is l, and the search
    stops at *length*.  Sorting the suffixes tells the intervals of 32 bytes, where the rounds begin.
    """
    order, known, rank = suffix_order(text)
    bwt = text[order - 1]
    source = np.argsort(bwt, kind="stable").astype(np.int32)  # the j-th suffix is its first byte before the source[j]-th
    border = np.ones(len(text), bool)
    at = rank[order]
    border[1:] = at[1:] != at[:-1]
    open_ = np.flatnonzero(~border).astype(np.int32)
    here, before = source[open_], source[open_ - 1]
    for _ in range(known, length):
        if not len(open_):
            break
        interval = np.cumsum(border, dtype=np.int32)
        new = interval[here] != interval[before]
        if new.any():
            border[open_[new]] = True
            open_, here, before = open_[~new], here[~new], before[~new]
    return order, border


def shared_windows(parts: list[bytes], least: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Runs of windows (part, first byte, byte after the last) that a part with a smaller *least* holds too."""
    lens = np.fromiter(map(len, parts), np.int64, len(parts))
    text = np.frombuffer(b"\xff".join(parts) + b"\xff", np.uint8)  # no byte of UTF-8
    begin = np.cumsum(lens + 1) - lens - 1
    order, border = prefix_groups(text)
    part = np.repeat(np.arange(len(parts)), lens + 1)
    place = np.arange(len(text)) - begin[part]
    inside = place + LENGTH <= lens[part]
    value = np.where(inside, least[part], _LAST_ID)
    low = np.empty(len(text), np.int64)
    low[order] = np.minimum.reduceat(value[order], np.flatnonzero(border))[np.cumsum(border) - 1]
    hit = inside & (low < value)
    edge = np.diff(np.concatenate(([False], hit, [False])).astype(np.int8))  # a part's end is never inside, so runs don't cross parts
    first, last = np.flatnonzero(edge == 1), np.flatnonzero(edge == -1) - 1
    return part[first], place[first], place[last] + LENGTH


def _packer(batches) -> Iterator:
    import pyarrow as pa
    import zstandard
    from pyspark import TaskContext

    pack, squeeze = TaskContext.get().partitionId() << 32, zstandard.ZstdCompressor(level=1).compress
    ids: list[int] = []
    texts: list[bytes] = []
    size = 0

    def flush():
        lens = np.fromiter(map(len, texts), np.int64, len(texts))
        nulls = np.array([x is None for x in ids], np.uint8)
        rows = np.array([_LAST_ID if x is None else x for x in ids], np.int64)
        return pa.RecordBatch.from_pydict({
            "pack": [pack], "ids": [rows.tobytes()], "nulls": [nulls.tobytes()], "lens": [lens.tobytes()],
            "text": [squeeze(b"".join(texts))], "size": [int(lens.sum())],
        })

    for batch in batches:
        for doc, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
            raw = (text or "").encode("utf-8", "surrogatepass")
            if ids and (size + len(raw) > PACK_BYTES or len(ids) >= PACK_ROWS):
                yield flush()
                pack += 1
                ids, texts, size = [], [], 0
            ids.append(doc)
            texts.append(raw)
            size += len(raw)
    if ids:
        yield flush()


class _Texts:
    """A pack's texts."""

    def __init__(self, row: dict) -> None:
        import zstandard

        self.pack = row["pack"]
        self.ids = np.frombuffer(row["ids"], np.int64)
        self.nulls = np.frombuffer(row["nulls"], np.uint8)
        lens = np.frombuffer(row["lens"], np.int64)
        self.stops = np.cumsum(lens)
        self.starts = self.stops - lens
        self.data = np.frombuffer(zstandard.ZstdDecompressor().decompress(row["text"], max_output_size=max(1, row["size"])), np.uint8)


class _Pack(_Texts):
    """A pack's texts and its distinct segments."""

    def __init__(self, row: dict) -> None:
        super().__init__(row)
        self.lo, self.hi, self.row, self.anchor, self.whole, self.grams = segments(self.data, self.starts, self.stops)
        self.doc = self.ids[self.row]
        order = np.lexsort((self.doc, self.whole, self.anchor))
        a, w = self.anchor[order], self.whole[order]
        new = np.ones(len(order), bool)
        new[1:] = (a[1:] != a[:-1]) | (w[1:] != w[:-1])
        self.first = order[new]  # of each distinct segment, one with the least document
        self.kind = np.empty(len(order), np.int64)
        self.kind[order] = np.cumsum(new) - 1

    def numbers(self, buckets: int) -> dict[int, np.ndarray]:
        """For each bucket the numbers of the distinct segments that it gets, in the order in which it gets them."""
        return dict(_by_bucket(self.anchor[self.first], buckets))


def _short(hashes: np.ndarray) -> bytes:
    """The low six bytes of each hash (the high ones of an anchor are mostly zero)."""
    return np.ascontiguousarray(hashes).view(np.uint8).reshape(-1, 8)[:, :6].tobytes()


def _long(data: bytes) -> np.ndarray:
    out = np.zeros((len(data) // 6, 8), np.uint8)
    out[:, :6] = np.frombuffer(data, np.uint8).reshape(-1, 6)
    return out.view(np.uint64).ravel()


def _rows(batch) -> Iterator[dict]:
    """The packs of a batch or table, one at a time."""
    for k in range(batch.num_rows):
        yield from batch.slice(k, 1).to_pylist()


def _blobs(names: list[str], rows: list[tuple]):
    import pyarrow as pa

    kinds = {"bucket": pa.int32(), "pack": pa.int64()}
    return [pa.array([r[k] for r in rows], kinds.get(n, pa.binary())) for k, n in enumerate(names)]


_SENT = "bucket int, pack long, anchor binary, whole binary, least binary"
_REPLY = "bucket int, pack long, pos binary, least binary, packs binary, flags binary"
_BYTES = "bucket int, pack long, part binary, start binary, lens binary, least binary, bytes binary, twin binary, again binary"
_GONE = "bucket int, pack long, start binary, stop binary"
#: What a bucket says of a segment: its bytes are to meet those of other segments of its anchor, an anchor with very many
#: of them, or those of copies (with the least document).
_DIFFER, _HOT, _COPIES = 1, 2, 4


def _names(schema: str) -> list[str]:
    return [x.split()[0] for x in schema.split(", ")]


def _by_bucket(anchor: np.ndarray, buckets: int) -> Iterator[tuple[int, np.ndarray]]:
    bucket = (_mix(anchor * _U(_BASE)) >> _U(32)) * _U(buckets) >> _U(32)  # the least of many hashes isn't spread evenly itself
    order = np.argsort(bucket, kind="stable")
    cuts = np.searchsorted(bucket[order], np.arange(buckets + 1, dtype=np.uint64))
    for b in range(buckets):
        if cuts[b] < cuts[b + 1]:
            yield b, order[cuts[b] : cuts[b + 1]]


def _send(buckets: int):
    def run(batches):
        import pyarrow as pa

        for batch in batches:
            for row in _rows(batch):
                p = _Pack(row)
                a, w, d = p.anchor[p.first], p.whole[p.first], p.doc[p.first]
                rows = [(b, p.pack, _short(a[i]), w[i].tobytes(), d[i].tobytes()) for b, i in p.numbers(buckets).items()]
                yield pa.RecordBatch.from_arrays(_blobs(_names(_SENT), rows), names=_names(_SENT))

    return run


def _judge(table):
    """A bucket's reply to the packs: for each segment that may share something what its bytes are to meet, the least document
    that seems to have the whole of it, and how many packs do."""
    import pyarrow as pa

    col = {n: table.column(n).to_pylist() for n in ("pack", "anchor", "whole", "least")}
    a, w = _long(b"".join(col["anchor"])), np.frombuffer(b"".join(col["whole"]), np.uint64)
    d = np.frombuffer(b"".join(col["least"]), np.int64)
    sizes = [len(x) // 8 for x in col["least"]]
    pack = np.repeat(np.array(col["pack"], np.int64), sizes)
    pos = np.concatenate([np.arange(n, dtype=np.uint32) for n in sizes])
    order = np.argsort(a)
    s = a[order]
    twin = np.zeros(len(s), bool)
    twin[1:] = s[1:] == s[:-1]
    twin[:-1] |= twin[1:]
    at = order[twin]  # anchors that come once have nothing to share
    at = at[np.lexsort((d[at], w[at], a[at]))]
    a, w, d, pack, pos = a[at], w[at], d[at], pack[at], pos[at]
    if not len(a):
        return pa.table(_blobs(_names(_REPLY), []), names=_names(_REPLY))
    new_a = np.ones(len(a), bool)
    new_a[1:] = a[1:] != a[:-1]
    new_w = new_a.copy()
    new_w[1:] |= w[1:] != w[:-1]
    seg, anc = np.cumsum(new_w) - 1, np.cumsum(new_a) - 1
    first = np.flatnonzero(new_w)
    least, most, packs = d[first][seg], np.maximum.reduceat(d, first)[seg], np.diff(np.append(first, len(d)))[seg]
    kinds = np.bincount(anc[new_w])[anc]
    differ = (kinds > 1) & (np.minimum.reduceat(d, np.flatnonzero(new_a))[anc] < np.maximum.reduceat(d, np.flatnonzero(new_a))[anc]) & (d == least)
    flags = (differ * np.where(kinds > HOT_SEGMENTS, _HOT, _DIFFER) + (most > least) * _COPIES).astype(np.uint8)
    told = flags > 0
    rows, bucket = [], table.column("bucket")[0].as_py()
    pos, least, packs, flags, pack = pos[told], least[told], packs[told].astype(np.uint32), flags[told], pack[told]
    order = np.lexsort((pos, pack))
    for i in np.split(order, np.flatnonzero(np.diff(pack[order])) + 1) if len(order) else []:
        rows.append((bucket, int(pack[i[0]]), pos[i].tobytes(), least[i].tobytes(), packs[i].tobytes(), flags[i].tobytes()))
    return pa.table(_blobs(_names(_REPLY), rows), names=_names(_REPLY))


def _runs(p: _Pack, at: np.ndarray, group: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """First and last of runs of segments *at* that follow each other in one document and have the same *group*."""
    cut = np.ones(len(at), bool)
    cut[1:] = (at[1:] != at[:-1] + 1) | (p.row[at[1:]] != p.row[at[:-1]]) | (group[1:] != group[:-1])
    return at[cut], at[np.append(cut[1:], True)] if len(at) else at


def _equal(data: np.ndarray, one: np.ndarray, other: np.ndarray, lens: np.ndarray) -> np.ndarray:
    """Whether the *lens* bytes (one at least) from *one* and from *other* are the same."""
    out, step = np.ones(len(lens), bool), max(1, _SLICE // (2 * LENGTH))
    for at in range(0, len(lens), step):
        x, y, n = one[at : at + step], other[at : at + step], lens[at : at + step]
        begin = np.cumsum(n) - n
        place = np.arange(n.sum()) - np.repeat(begin, n)
        out[at : at + step] = np.logical_and.reduceat(data[np.repeat(x, n) + place] == data[np.repeat(y, n) + place], begin)
    return out


def _parts(p: _Pack, replies: list[dict], buckets: int) -> tuple[np.ndarray, ...]:
    """What a pack has to bring: parts' groups, first bytes, bytes behind them, documents.  Even groups are a document's with its copies'.

    Then parts whose bytes their document has again (they are brought once), and where.
    """
    numbers = p.numbers(buckets)
    least, packs, flags = p.doc[p.first].copy(), np.ones(len(p.first), np.int64), np.zeros(len(p.first), np.uint8)
    for r in replies:
        kind = numbers[r["bucket"]][np.frombuffer(r["pos"], np.uint32)]
        least[kind], packs[kind] = np.frombuffer(r["least"], np.int64), np.frombuffer(r["packs"], np.uint32)
        flags[kind] = np.frombuffer(r["flags"], np.uint8)
    salts = -(-packs // PACKS_A_GROUP)
    own = p.doc[p.first] == least  # the least document is here
    copy = p.doc > least[p.kind]
    out = []

    def bring(group: np.ndarray, start: np.ndarray, stop: np.ndarray, doc: np.ndarray) -> None:
        out.append((group, start, stop, doc))

    def group_of(doc: np.ndarray, salts_: np.ndarray, salt: np.ndarray) -> np.ndarray:
        return _mix((doc.astype(np.uint64) * _U(_BASE) + salts_.astype(np.uint64)) * _U(_BASE) + salt.astype(np.uint64)) << _U(1)

    at = np.flatnonzero(copy)
    kind = p.kind[at]
    here, there = _runs(p, at, group_of(least[kind], salts[kind], salts[kind] * 0))
    kind = p.kind[here]
    bring(group_of(least[kind], salts[kind], int(_mix(np.array([p.pack], np.uint64))[0] >> _U(1)) % salts[kind]), p.lo[here], p.hi[there] + LENGTH, p.doc[here])
    lends = own & ((flags & _COPIES > 0) | (np.bincount(p.kind[copy], minlength=len(p.first)) > 0))
    at = np.sort(p.first[lends])
    here, there = _runs(p, at, salts[p.kind[at]])
    many = salts[p.kind[here]]
    salt = np.arange(many.sum()) - np.repeat(np.cumsum(many) - many, many)
    here, there = np.repeat(here, many), np.repeat(there, many)
    bring(group_of(p.doc[here], salts[p.kind[here]], salt), p.lo[here], p.hi[there] + LENGTH, p.doc[here])
    # a document that has a segment more than once is to lose the same bytes of each
    twin = np.flatnonzero((flags[p.kind] & (_DIFFER | _HOT) > 0) & (p.doc == p.doc[p.first][p.kind]) & (p.first[p.kind] != np.arange(len(p.kind))))
    rep = p.first[p.kind[twin]]
    same = p.hi[twin] - p.lo[twin] == p.hi[rep] - p.lo[rep]
    same[same] = _equal(p.data, p.lo[twin[same]], p.lo[rep[same]], p.hi[rep[same]] + LENGTH - p.lo[rep[same]])
    other, twin, rep = twin[~same], twin[same], rep[same]  # hashes that are equal by chance
    at = np.concatenate([p.first[flags & _DIFFER > 0], other[flags[p.kind[other]] & _DIFFER > 0]])
    number = np.zeros(len(p.kind), np.int64)
    number[at] = sum(len(x[0]) for x in out) + np.arange(len(at))
    mine = flags[p.kind[twin]] & _DIFFER > 0
    again, place = [number[rep[mine]]], [p.lo[twin[mine]]]
    bring(p.anchor[at] | _U(1), p.lo[at], p.hi[at] + LENGTH, p.doc[at])
    at = np.concatenate([p.first[flags & _HOT > 0], other[flags[p.kind[other]] & _HOT > 0]])
    count = p.hi[at] - p.lo[at] + 1
    number[at] = sum(len(x[0]) for x in out) + np.cumsum(count) - count
    many = (p.hi[rep] - p.lo[rep] + 1)[~mine]
    step = np.arange(many.sum()) - np.repeat(np.cumsum(many) - many, many)
    again.append(np.repeat(number[rep[~mine]], many) + step)
    place.append(np.repeat(p.lo[twin[~mine]], many) + step)
    at = np.repeat(at, count)
    window = p.lo[at] + np.arange(len(at)) - np.repeat(np.cumsum(count) - count, count)
    whole = _mix(p.grams[window]) + p.grams[window + LENGTH - K] * _U(_BASE) + p.data[window + K].astype(np.uint64) * _U(256) + p.data[window + K + 1]
    bring(_mix(whole) << _U(1), window, window + LENGTH, p.doc[at])
    return *(np.concatenate(x) for x in zip(*out)), np.concatenate(again), np.concatenate(place)


def _bring(buckets: int, groups: int):
    """The bytes that have to meet those of other packs, by buckets of groups."""

    def run(packs, replies):
        import pyarrow as pa

        rows, told = [], replies.to_pylist()
        for row in _rows(packs):
            p = _Pack(row)
            group, start, stop, doc, again, place = _parts(p, told, buckets)
            bucket = (_mix(group >> _U(1)) >> _U(32)) * _U(groups) >> _U(32)
            order = np.lexsort((group, bucket))
            number = np.empty(len(order), np.int64)
            number[order] = np.arange(len(order))
            again = number[again]
            by_number = np.argsort(again, kind="stable")
            again, place, at = again[by_number], place[by_number], 0
            for i in np.split(order, np.flatnonzero(np.diff(bucket[order])) + 1) if len(order) else []:
                raw = b"".join([p.data[x:y].tobytes() for x, y in zip(start[i].tolist(), stop[i].tolist())])
                x, y = np.searchsorted(again, (at, at + len(i)))
                twins = ((again[x:y] - at).astype(np.uint32).tobytes(), place[x:y].tobytes())
                rows.append((int(bucket[i[0]]), p.pack, group[i].tobytes(), start[i].tobytes(), (stop - start)[i].tobytes(), doc[i].tobytes(), raw, *twins))
                at += len(i)
        return pa.table(_blobs(_names(_BYTES), rows), names=_names(_BYTES))

    return run


def _batches(group: np.ndarray, lens: np.ndarray, least: np.ndarray, most: int) -> Iterator[np.ndarray]:
    """Parts that go into one transform: whole groups; of a large group of copies its earliest document with some of the others each time."""
    order = np.argsort(group, kind="stable")
    held: list[np.ndarray] = []
    size = 0
    for i in np.split(order, np.flatnonzero(np.diff(group[order])) + 1) if len(order) else []:
        own = int(lens[i].sum())
        if own > most and not int(group[i[0]]) & 1:
            early = least[i] == least[i].min()
            source, rest = i[early], i[~early]
            step = max(most, int(lens[source].sum()))
            piece = np.cumsum(lens[rest]) // step
            for part in np.split(rest, np.flatnonzero(np.diff(piece)) + 1):
                yield np.concatenate([source, part])
            continue
        if held and size + own > most:
            yield np.concatenate(held)
            held, size = [], 0
        held.append(i)
        size += own
    if held:
        yield np.concatenate(held)


def _compare(table):
    """Bytes of a bucket's parts under windows that a part with a smaller document holds too."""
    import pyarrow as pa

    col = {n: table.column(n).to_pylist() for n in ("pack", "part", "start", "lens", "least", "bytes", "twin", "again")}
    group = np.frombuffer(b"".join(col["part"]), np.uint64)
    start, lens, least = (np.frombuffer(b"".join(col[n]), np.int64) for n in ("start", "lens", "least"))
    counts = [len(x) // 8 for x in col["lens"]]
    row = np.repeat(np.arange(len(counts)), counts)
    begin = np.cumsum(lens) - lens
    begin -= np.repeat(begin[np.cumsum(counts) - counts], counts)
    found = []
    for i in _batches(group, lens, least, BATCH_BYTES):
        parts = [col["bytes"][r][x : x + n] for r, x, n in zip(row[i].tolist(), begin[i].tolist(), lens[i].tolist())]
        part, first, stop = shared_windows(parts, least[i])
        found.append((i[part], first, stop))
    part, first, stop = (np.concatenate(x) for x in zip(*found)) if found else (np.zeros(0, np.int64),) * 3
    # each part's places: its own and where its document has its bytes again
    sizes = [len(x) // 4 for x in col["twin"]]
    twin = np.frombuffer(b"".join(col["twin"]), np.uint32) + np.repeat(np.cumsum(counts) - counts, sizes)
    order = np.argsort(np.concatenate([np.arange(len(lens)), twin]), kind="stable")
    places = np.concatenate([start, np.frombuffer(b"".join(col["again"]), np.int64)])[order]
    many = 1 + np.bincount(twin, minlength=len(lens))
    begin = (np.cumsum(many) - many)[part]
    many = many[part]
    at = np.repeat(begin, many) + np.arange(many.sum()) - np.repeat(np.cumsum(many) - many, many)
    row, first, stop = np.repeat(row[part], many), places[at] + np.repeat(first, many), places[at] + np.repeat(stop, many)
    order, bucket = np.argsort(row, kind="stable"), table.column("bucket")[0].as_py()
    rows = [(bucket, col["pack"][row[i[0]]], first[i].tobytes(), stop[i].tobytes()) for i in np.split(order, np.flatnonzero(np.diff(row[order])) + 1) if len(i)]
    return pa.table(_blobs(_names(_GONE), rows), names=_names(_GONE))


_RESULT = "doc_id long, n_bytes long, n_removed long, n_spans long, kept_sha256 string"


def _apply(with_text: bool):
    def run(packs, gone_):
        import pyarrow as pa

        out = []
        for row in _rows(packs):
            p, n = _Texts(row), row["size"]
            told = gone_.to_pylist()
            lo, hi = (np.frombuffer(b"".join(r[k] for r in told), np.int64) for k in ("start", "stop"))
            depth = np.bincount(lo, minlength=n + 1) - np.bincount(hi, minlength=n + 1)
            gone = np.cumsum(depth)[:n] > 0
            edge = gone.copy()
            edge[1:] &= ~gone[:-1]
            heads = p.starts[p.starts < p.stops]
            edge[heads] = gone[heads]
            removed, spans = (np.concatenate(([0], np.cumsum(x))) for x in (gone, edge))
            kept = p.data[~gone].tobytes()
            place = np.arange(n + 1) - removed
            for k, (x, y) in enumerate(zip(p.starts.tolist(), p.stops.tolist())):
                left = kept[place[x] : place[y]]
                out.append((
                    None if p.nulls[k] else int(p.ids[k]), y - x, int(removed[y] - removed[x]), int(spans[y] - spans[x]), hashlib.sha256(left).hexdigest(),
                    *([left] if with_text else []),
                ))
        kinds = [pa.int64()] * 4 + [pa.string()] + [pa.binary()] * with_text
        names = [x.split()[0] for x in _RESULT.split(", ")] + ["kept"] * with_text
        return pa.Table.from_arrays([pa.array([r[k] for r in out], t) for k, t in enumerate(kinds)], names=names)

    return run


def remove_repeats(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", with_text: bool = False) -> DataFrame:
    """What is left of each text when bytes under LENGTH-byte strings that start in a document with a smaller id go.

    doc_id, n_bytes, n_removed, n_spans, kept_sha256, and with *with_text* kept (binary: cuts may part a character).
    Strings are judged on the input; matches don't cross documents.  Documents are put into packs of
    bounded size, written once; hashes, replies and bytes travel between packs and buckets.  A segment's hash is
    sent once a pack; memory is bounded by the sizes above and the largest document.  Null and empty texts have no bytes; a null id counts as larger than
    all; rows that share an id don't count as earlier than each other; an empty table gives no rows.
    """
    table = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))
    with common.workspace(docs.sparkSession):
        packs = common.stage(table.mapInArrow(_packer, "pack long, ids binary, nulls binary, lens binary, text binary, size long"), "packs")
        size = packs.agg(F.sum("size")).first()[0] or 0
        buckets = int(max(12, -(-2 * size // ((LENGTH - K + 2) * BUCKET_SEGMENTS))))
        groups = int(max(12, -(-size // BUCKET_BYTES)))
        # as many tasks as buckets: adaptive execution would join buckets by their few bytes, not by their work
        sent = packs.mapInArrow(_send(buckets), _SENT).repartition(buckets, "bucket")
        # a row is a pack, or one of the many small messages between a pack and a bucket: bytes bound a batch, not rows
        with common.settings(docs.sparkSession, spark__sql__execution__arrow__maxBytesPerBatch=str(BATCH_BYTES)):
            replies = common.stage(sent.groupBy("bucket").applyInArrow(_judge, _REPLY), "replies")
            brought = packs.groupBy("pack").cogroup(replies.groupBy("pack")).applyInArrow(_bring(buckets, groups), _BYTES).repartition(groups, "bucket")
            gone = common.stage(brought.groupBy("bucket").applyInArrow(_compare, _GONE), "gone")
            done = packs.groupBy("pack").cogroup(gone.groupBy("pack")).applyInArrow(_apply(with_text), _RESULT + ", kept binary" * with_text)
            return common.stage(done, "kept", keep=True)


def op8_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Repeated strings of 50 bytes in all documents."""
    return remove_repeats(spark.read.parquet(f"{sf_dir}/documents.parquet"))
