"""SentencePiece encoding with seeded merge-dropout, and lossless decoding."""

from __future__ import annotations

import re
import zlib
from array import array
from heapq import heapify, heappop, heappush

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sluice.llm import tokens

SPACE = "▁"
DROPOUT = 0.1
SEED = 11
#: Segmented words that a worker keeps before it forgets them.
CACHE_WORDS = 500_000
CACHE_CHARS = 16 << 20
#: Words with more characters are segmented one by one, with a heap: side by side each merge would pass over all of them.
LONG_WORD = 400
_UNIT = re.compile(" *[^ ]+| +")
_LITERAL = "\x00" + SPACE  # the text's own U+2581, which must not be read back as a space
_M64 = (1 << 64) - 1
_LAST = 1 << 30
#: Words segmented side by side, words of texts whose draws are made side by side, and rows encoded together.
_TOGETHER = 20_000
_OCCURRENCES = 200_000
_ROWS = 2000


class Pieces:
    """A merge-type model's pieces: encoding by an agenda of merges, and decoding.

    No piece of such a model holds a space mark after another character, so the agenda of a
    text falls apart into those of its words (each with the spaces before it).  A candidate
    merge is taken from the agenda by score, then place; with dropout it is skipped, for good,
    if a hash keyed by seed, document, the word's place in it and the candidate's three borders falls below the
    rate: every occurrence of a word draws its own merges.  What no piece spells becomes byte pieces, and so does the text's own space mark:
    every segmentation decodes to the text it came from.
    """

    def __init__(self, path: str, dropout: float = DROPOUT, seed: int = SEED, cache_words: int = CACHE_WORDS) -> None:
        import sentencepiece

        model = sentencepiece.SentencePieceProcessor(model_file=path)
        n = model.vocab_size()
        normal = [k for k in range(n) if not (model.is_byte(k) or model.is_control(k) or model.is_unknown(k) or model.is_unused(k))]
        self.ids = {model.id_to_piece(k): k for k in normal}
        if any(SPACE in p.lstrip(SPACE) for p in self.ids):
            raise ValueError("pieces of this model run over word borders")
        self._cost = {model.id_to_piece(k): -model.get_score(k) for k in normal}
        self._byte = {b: model.piece_to_id(f"<0x{b:02X}>") for b in range(256)}
        self._text = {k: p.replace(SPACE, " ").encode() for p, k in self.ids.items()} | {k: bytes([b]) for b, k in self._byte.items()}
        self._limit = cache_words
        self._skip_below, self._seed = int(dropout * (1 << 64)), seed
        self._forget()
        self._tables()

    def _forget(self) -> None:
        """Without words: each known word's number, and by number its ids without dropout and where its merges' borders stand."""
        self._known: dict[str, int] = {}
        self._chars = 0
        self._plain: list[bytes] = []
        self._borders, self._first, self._count = np.zeros(0, np.uint64), np.zeros(0, np.int64), np.zeros(0, np.int64)

    def _learn(self, words: list[str]) -> None:
        merges: list[bytes | None] = []
        ids = self._segment_many(words, None, merges)
        count = np.fromiter((-1 if m is None else len(m) // 8 for m in merges), np.int64, len(merges))  # -1: segmented anew each time
        size = np.maximum(count, 0)
        self._chars += sum(map(len, words))
        self._known.update(zip(words, range(len(self._plain), len(self._plain) + len(words))))
        self._plain += ids
        self._first = np.append(self._first, len(self._borders) + np.cumsum(size) - size)
        self._count = np.append(self._count, count)
        self._borders = np.append(self._borders, np.frombuffer(b"".join(m for m in merges if m), np.uint64))

    def _tables(self) -> None:
        """Arrays for many words at once: characters' ids, and for pairs of ids what they make and at which cost."""
        self._char = np.zeros(0x110000, np.int32)  # 0: no piece
        self._char[:128] = [self._byte[b] for b in range(128)]
        for p, k in self.ids.items():
            if len(p) == 1:
                self._char[ord(p)] = k
        self._char[ord(" ")], self._char[ord(SPACE)] = self.ids[SPACE], 0
        rank = {c: k for k, c in enumerate(sorted({*self._cost.values()}))}
        pairs = [
            (self.ids[a] << 20 | self.ids[b], k, rank[self._cost[p]])
            for p, k in self.ids.items() for cut in range(1, len(p)) if (a := p[:cut]) in self.ids and (b := p[cut:]) in self.ids
        ]
        table = np.array(sorted(pairs), np.int64).reshape(-1, 3)
        self._pair, self._made, self._rank = table[:, 0].copy(), table[:, 1].copy(), table[:, 2].copy()
        # where a pair stands in these arrays: an open hash table, -1 where a slot is free
        self._bits = max(4, 3 + len(table).bit_length())
        self._slot, at, left = np.full((1 << self._bits) + 64, -1, np.int32), self._hash(self._pair), np.arange(len(table))
        while len(left):
            free = self._slot[at[left]] < 0
            first = np.unique(at[left[free]], return_index=True)[1]
            placed = left[free][first]
            self._slot[at[placed]] = placed
            left = np.setdiff1d(left, placed, assume_unique=True)
            at[left] += self._slot[at[left]] >= 0
        self._most = int((at - self._hash(self._pair)).max(initial=0))
        singles = {c for p in self.ids for c in p if c not in self.ids}
        self._odd = [ord(c) for c in singles]  # characters that pieces hold but that are none themselves
        self._char[self._odd] = 0

    def _agenda(self, left: np.ndarray, right: np.ndarray, key: np.ndarray | None, i: np.ndarray, j: np.ndarray, k: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """What each pair makes, and its rank; without a piece, or skipped by its hash: the last rank."""
        want = left.astype(np.int64) << 20 | right
        slot = self._hash(want)
        at = self._slot[slot]
        ok = self._pair[at] == want  # -1: the last pair, which isn't the one wanted, or it stands here
        for far in range(1, self._most + 1):
            rest = np.flatnonzero(~ok & (at >= 0))
            if not len(rest):
                break
            at[rest] = self._slot[slot[rest] + far]
            ok[rest] = self._pair[at[rest]] == want[rest]
        if key is not None:
            ok &= ~self._skips(key, _borders(i, j, k))
        return self._made[at], np.where(ok, self._rank[at], _LAST)

    def _hash(self, pairs: np.ndarray) -> np.ndarray:
        return (pairs.view(np.uint64) * np.uint64(0x9E3779B97F4A7C15) >> np.uint64(64 - self._bits)).astype(np.int64)

    def _skips(self, key: np.ndarray, borders: np.ndarray) -> np.ndarray:
        """Whether the candidates between *borders* are skipped."""
        u = np.uint64
        h = (key ^ borders) * u(0x9E3779B97F4A7C15)
        h = (h ^ h >> u(29)) * u(0xBF58476D1CE4E5B9)
        return h ^ h >> u(32) < u(self._skip_below)

    def _segment_many(self, units: list[str], keys: np.ndarray | int | None, merges: list[bytes | None] | None = None) -> list[bytes]:
        """As :meth:`_segment` for each word by its key (one for all, if a number), all agendas side by side: a
        round takes each word's next merge.  Without keys nothing is skipped.  *merges*, if given, gets each
        word's merges as borders (None of a word that holds characters without a piece)."""
        points = np.frombuffer("".join(units).encode("utf-32-le", "surrogatepass"), np.uint32)
        sizes = np.fromiter(map(len, units), np.int64, len(units))
        word = np.repeat(np.arange(len(units)), sizes)
        sym = self._char[points]
        start = np.arange(len(sym)) - np.repeat(np.cumsum(sizes) - sizes, sizes)
        stop = start + 1
        key = None if keys is None or not self._skip_below else np.broadcast_to(np.asarray(keys, np.uint64), len(units))
        slow = np.union1d(word[sym == 0], np.flatnonzero(sizes > LONG_WORD))
        out: list[bytes] = [b""] * len(units)
        for k in slow.tolist():
            out[k] = array("I", self._segment(units[k], None if key is None else int(key[k]))).tobytes()
        keep = ~np.isin(word, slow)
        word, sym, start, stop = word[keep], sym[keep], start[keep], stop[keep]
        made, rank = np.zeros(len(sym), np.int64), np.full(len(sym), _LAST)
        at = np.flatnonzero(word[:-1] == word[1:])
        done: list[tuple[np.ndarray, np.ndarray]] = []
        taken = [(np.zeros(0, np.int64), np.zeros(0, np.uint64))]
        while len(sym):
            if len(at):
                made[at], rank[at] = self._agenda(sym[at], sym[at + 1], None if key is None else key[word[at]], start[at], start[at + 1], stop[at + 1])
            first = np.flatnonzero(np.concatenate(([True], word[1:] != word[:-1])))
            best = np.minimum.reduceat(rank << 32 | np.arange(len(sym)), first)
            live = best >> 32 != _LAST
            length = np.diff(np.append(first, len(sym)))
            stays = np.repeat(live, length)
            done.append((word[~stays], sym[~stays]))
            m = best[live] & 0xFFFFFFFF
            if merges is not None:
                taken.append((word[m], _borders(start[m], start[m + 1], stop[m + 1])))
            sym[m], stop[m] = made[m], stop[m + 1]
            stays[m + 1] = False
            place = np.cumsum(stays) - 1
            word, sym, start, stop, made, rank = (x[stays] for x in (word, sym, start, stop, made, rank))
            m = place[m]
            rank[m] = _LAST
            at = np.concatenate([m, m[m > 0] - 1])
            at = at[at + 1 < len(sym)]
            at = at[word[at] == word[at + 1]]
        words, ids = (np.concatenate(x) for x in zip(*done)) if done else (np.zeros(0, int), np.zeros(0, int))
        order = np.argsort(words, kind="stable")
        flat, ends = ids[order].astype("<u4").tobytes(), 4 * np.searchsorted(words[order], np.arange(len(units) + 1))
        for k, (a, b) in enumerate(zip(ends[:-1].tolist(), ends[1:].tolist())):
            if b > a:
                out[k] = flat[a:b]
        if merges is not None:
            words, borders = (np.concatenate(x) for x in zip(*taken))
            order = np.argsort(words, kind="stable")
            flat, ends = borders[order].tobytes(), (8 * np.searchsorted(words[order], np.arange(len(units) + 1))).tolist()
            merges += [flat[a:b] for a, b in zip(ends[:-1], ends[1:])]
            for k in slow.tolist():
                merges[k] = None
        return out

    def _segment(self, unit: str, key: int | None) -> list[int]:
        cost, below = self._cost, self._skip_below if key is not None else 0
        parts: list[str | None] = [SPACE if c == " " else _LITERAL if c == SPACE else c for c in unit]
        n = len(parts)
        after, before = list(range(1, n + 1)), list(range(-1, n - 1))
        agenda = [(cost[p], i, i + 1, p) for i in range(n - 1) if (p := parts[i] + parts[i + 1]) in cost]
        heapify(agenda)
        while agenda:
            _, i, j, made = heappop(agenda)
            left, right = parts[i], parts[j] if j < n else None
            if left is None or right is None or after[i] != j or left + right != made:
                continue  # one of the two has been merged since
            if below:
                h = (key ^ (i << 42 | j << 21 | after[j])) * 0x9E3779B97F4A7C15 & _M64
                h = (h ^ h >> 29) * 0xBF58476D1CE4E5B9 & _M64
                if h ^ h >> 32 < below:
                    continue
            parts[i], parts[j] = made, None
            k = after[i] = after[j]
            if k < n:
                before[k] = i
                if (p := made + parts[k]) in cost:
                    heappush(agenda, (cost[p], i, k, p))
            if (k := before[i]) >= 0 and (p := parts[k] + made) in cost:
                heappush(agenda, (cost[p], k, i, p))
        out: list[int] = []
        for p in parts:
            if p is not None:
                k = self.ids.get(p)
                if k is not None:
                    out.append(k)
                else:
                    out += [self._byte[b] for b in p.lstrip("\x00" if p == _LITERAL else "").encode("utf-8", "surrogatepass")]
        return out

    def encode_batch(self, texts: list[str | None], doc_ids: list[int | None]) -> list[bytes]:
        """Ids of whole texts, little-endian unsigned 32-bit; null counts as empty."""
        units = [_UNIT.findall(" " + t) if t else [] for t in texts]
        sizes = np.fromiter(map(len, units), np.int64, len(units))
        flat = [u for us in units for u in us]
        place = np.arange(len(flat)) - np.repeat(np.cumsum(sizes) - sizes, sizes)
        keys = _draws(self._seed, np.repeat(np.array([d or 0 for d in doc_ids], np.int64), sizes), place)
        out: list[bytes] = []
        for k in range(0, len(flat), _OCCURRENCES):
            out += self._occurrences(flat[k : k + _OCCURRENCES], keys[k : k + _OCCURRENCES])
        ends = np.cumsum(sizes).tolist()
        return [b"".join(out[b - n : b]) for b, n in zip(ends, sizes.tolist())]

    def _occurrences(self, units: list[str], keys: np.ndarray) -> list[bytes]:
        """Ids of each word by its own key.  What no draw touches is kept by word: its ids without dropout and the
        merges that lead there; only occurrences that skip one of those are segmented anew."""
        if len(self._known) > self._limit or self._chars > CACHE_CHARS:
            self._forget()
        lack = list(set(units) - self._known.keys())
        for k in range(0, len(lack), _TOGETHER):
            self._learn(lack[k : k + _TOGETHER])
        number = np.fromiter(map(self._known.__getitem__, units), np.int64, len(units))
        out = list(map(self._plain.__getitem__, number.tolist()))
        if self._skip_below:
            count = self._count[number]
            size = np.maximum(count, 0)
            of = np.repeat(np.arange(len(units)), size)
            at = np.arange(len(of)) + np.repeat(self._first[number] - (np.cumsum(size) - size), size)
            anew = count < 0
            anew[of[self._skips(keys[of], self._borders[at])]] = True
            at = np.flatnonzero(anew)
            for k in range(0, len(at), _TOGETHER):
                part = at[k : k + _TOGETHER].tolist()
                for i, ids in zip(part, self._segment_many([units[i] for i in part], keys[part])):
                    out[i] = ids
        return out

    def encode(self, text: str | None, doc_id: int | None = 0) -> bytes:
        return self.encode_batch([text], [doc_id])[0]

    def decode(self, ids: bytes) -> str:
        """The text that *ids* were made from."""
        spelled = b"".join(map(self._text.__getitem__, array("I", ids)))
        return spelled[1:].decode("utf-8", "surrogatepass")


def _borders(i: np.ndarray, j: np.ndarray, k: np.ndarray) -> np.ndarray:
    """The three borders of a candidate as one number."""
    u = np.uint64
    return i.astype(u) << u(42) | j.astype(u) << u(21) | k.astype(u)


def _draws(seed: int, doc_ids: np.ndarray, places: np.ndarray) -> np.ndarray:
    """The key of each word: of the seed, its document and its place in it."""
    u = np.uint64

    def mix(x: np.ndarray) -> np.ndarray:
        x = (x ^ x >> u(30)) * u(0xBF58476D1CE4E5B9)
        x = (x ^ x >> u(27)) * u(0x94D049BB133111EB)
        return x ^ x >> u(31)

    x = mix(doc_ids.astype(np.int64).view(u) + u(seed * 0x9E3779B97F4A7C15 & _M64))
    return mix(x + (places.astype(u) + u(1)) * u(0x9E3779B97F4A7C15))


def kept(model: str, dropout: float = DROPOUT, seed: int = SEED, _made: dict = {}) -> Pieces:  # noqa: B006
    """This worker process's pieces; made once, used by all its tasks."""
    if (model, dropout, seed) not in _made:
        _made[model, dropout, seed] = Pieces(model, dropout, seed)
    return _made[model, dropout, seed]


def encode(docs: DataFrame, model: str, dropout: float = DROPOUT, seed: int = SEED, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id and ids (binary, little-endian unsigned 32-bit) of every row.

    Null and empty texts have no ids; a null id draws as 0; repeated rows give equal rows; the
    same seed always gives the same ids, whatever the partitioning; an empty table gives no rows; other columns aren't read.
    """

    def run(batches):
        import pyarrow as pa

        pieces = kept(model, dropout, seed)
        for batch in batches:
            for k in range(0, batch.num_rows, _ROWS):
                part = batch.slice(k, _ROWS)
                ids = pieces.encode_batch(part.column(1).to_pylist(), part.column(0).to_pylist())
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array(ids, pa.binary())], names=["doc_id", "ids"])

    return docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text")).mapInArrow(run, "doc_id long, ids binary")


def decode(encoded: DataFrame, model: str, id_col: str = "doc_id", ids_col: str = "ids") -> DataFrame:
    """doc_id and text of rows of :func:`encode`; null ids count as none."""

    def run(batches):
        import pyarrow as pa

        pieces = kept(model, 0.0)
        for batch in batches:
            texts = [pieces.decode(x or b"") for x in batch.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(texts, pa.string())], names=["doc_id", "text"])

    return encoded.select(F.col(id_col).alias("doc_id"), F.col(ids_col).alias("ids")).mapInArrow(run, "doc_id long, text string")


def op2_merge_dropout(spark: SparkSession, sf_dir: str, model: str | None = None) -> DataFrame:
    """Every whole text encoded with dropout 0.1 and decoded again: doc_id, n_tokens, ids_crc32,
    decoded_sha256 (of the decoded text), lossless (whether it is the text)."""
    path = model or tokens.vocabulary("piece_bpe_32k.model")
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")

    def run(batches):
        import hashlib

        import pyarrow as pa

        pieces = kept(path)
        for whole in batches:
            for k in range(0, whole.num_rows, _ROWS):
                batch = whole.slice(k, _ROWS)
                docs, texts = batch.column(0).to_pylist(), batch.column(1).to_pylist()
                ids = pieces.encode_batch(texts, docs)
                back = [pieces.decode(x) for x in ids]
                yield pa.RecordBatch.from_arrays(
                    [
                        batch.column(0), pa.array([len(x) // 4 for x in ids], pa.int64()), pa.array([zlib.crc32(x) for x in ids], pa.int64()),
                        pa.array([hashlib.sha256(x.encode("utf-8", "surrogatepass")).hexdigest() for x in back], pa.string()),
                        pa.array([x == (t or "") for x, t in zip(back, texts)], pa.bool_()),
                    ],
                    names=["doc_id", "n_tokens", "ids_crc32", "decoded_sha256", "lossless"],
                )

    return docs.mapInArrow(run, "doc_id long, n_tokens long, ids_crc32 long, decoded_sha256 string, lossless boolean")
