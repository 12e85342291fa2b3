"""Quality classifier: supervised embeddings of hashed words, character n-grams and recencies.

A recency feature says how far back in its document a word last stood, in powers of two: the parts of word n-grams
that don't depend on the vocabulary, learned like every other feature.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from sluice.llm import common

#: Labelled rows that a model is trained on at most; those with the least hash are taken.
TRAINING_ROWS = 4000
BUCKETS = 1 << 18
DIMENSION = 16
NGRAM = (2, 4)
EPOCHS = 6
RATE = 0.5
SEED = 7
THRESHOLD = 0.7
#: Features without a vector that each document has besides its own, so that a few words decide little.
PRIOR = 60
#: Words whose parts a worker keeps before it forgets them.
CACHE_WORDS = 200_000
CACHE_CHARS = 16 << 20
#: Texts scored together.
_ROWS = 500


def held_out(doc_id: Column) -> Column:
    """Rows whose labels are never learned from: crc32 of the id as text leaves 2 when divided by 4."""
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % 4 == 2, F.lit(False))


def features(words: list[str], buckets: int = BUCKETS, ngram: tuple[int, int] = NGRAM) -> tuple[np.ndarray, np.ndarray]:
    """Buckets of each word and of its character n-grams (with marks for its start and end), and whose each is."""
    marked = [f"<{w}>" for w in words]
    sizes = np.fromiter(map(len, marked), np.int64, len(marked))
    points = np.frombuffer("".join(marked).encode("utf-32-le", "surrogatepass"), np.uint32).astype(np.uint64)
    owner = np.repeat(np.arange(len(words)), sizes)
    ends = np.cumsum(sizes)
    ids = [np.fromiter((zlib.crc32(b"w" + w.encode("utf-8", "surrogatepass")) % buckets for w in words), np.int64, len(words))]
    whose, rolled = [np.arange(len(words))], points.copy()
    for n in range(2, ngram[1] + 1):
        if len(rolled) < 2:
            break
        rolled = rolled[:-1] * np.uint64(0x100000001B3) + points[n - 1 :]
        if n >= ngram[0]:
            at = np.flatnonzero(np.arange(len(rolled)) + n <= ends[owner[: len(rolled)]])
            h = (rolled[at] ^ np.uint64(n)) * np.uint64(0x9E3779B97F4A7C15)
            ids.append((h >> np.uint64(32)).astype(np.int64) % buckets)
            whose.append(owner[at])
    return np.concatenate(ids), np.concatenate(whose)


#: Kinds of recency features: a word that is new to its document, or last stood 1, 2 to 3, 4 to 7, ... words before.
RECENCIES = 32


def recency_buckets(buckets: int = BUCKETS) -> np.ndarray:
    return np.array([zlib.crc32(b"d%d" % k) % buckets for k in range(RECENCIES)])


def recencies(words: np.ndarray, texts: np.ndarray, n: int) -> np.ndarray:
    """How often each text (of *n*; *texts* says whose a word is) has each recency feature."""
    order = np.lexsort((words, texts))
    w, t = words[order], texts[order]
    again = (w[1:] == w[:-1]) & (t[1:] == t[:-1])
    gap = np.zeros(len(words), np.int64)
    gap[order[1:][again]] = (order[1:] - order[:-1])[again]  # sorted stably: the word's last place before
    kind = np.where(gap > 0, np.frexp(gap)[1], 0)
    return np.bincount(texts * RECENCIES + kind, minlength=n * RECENCIES).reshape(n, RECENCIES)


def bag(text: str | None, buckets: int = BUCKETS) -> tuple[np.ndarray, np.ndarray]:
    """The distinct buckets of a whole text and their shares (of all features and PRIOR)."""
    words = (text or "").split()
    counts: dict[str, int] = {}
    for w in words:
        counts[w] = counts.get(w, 0) + 1
    found, whose = features(list(counts), buckets)
    times = np.fromiter(counts.values(), np.float64, len(counts))[whose]
    if words:
        number = {w: k for k, w in enumerate(counts)}
        found = np.append(found, recency_buckets(buckets))
        times = np.append(times, recencies(np.fromiter(map(number.__getitem__, words), np.int64, len(words)), np.zeros(len(words), np.int64), 1)[0])
        found, times = found[times > 0], times[times > 0]
    ids, place = np.unique(found, return_inverse=True)
    share = np.bincount(place, weights=times, minlength=len(ids)).astype(np.float32)
    return ids, share / (PRIOR + share.sum())


@dataclass(frozen=True)
class Model:
    """Vectors of the buckets and of the two labels; a document's vector is the mean of its buckets'."""

    vectors: np.ndarray
    output: np.ndarray
    bias: np.ndarray

    def weights(self) -> tuple[np.ndarray, float]:
        """Each bucket's part in the difference of the two labels' scores, and the constant part."""
        return (self.vectors @ (self.output[1] - self.output[0])).astype(np.float32), float(self.bias[1] - self.bias[0])


def train(bags: list[tuple[np.ndarray, np.ndarray]], labels: list[int], buckets: int = BUCKETS, dimension: int = DIMENSION,
          epochs: int = EPOCHS, rate: float = RATE, seed: int = SEED) -> Model:
    """Stochastic gradient descent on the softmax loss, one document at a time, falling rate.

    Rows of the rarer label weigh more, by the root of the labels' ratio.  Without rows of both classes the
    model says the only class known, or 1 if there is none.
    """
    rng = np.random.default_rng(seed)
    vectors = (rng.random((buckets, dimension), dtype=np.float32) * 2 - 1) / np.float32(dimension)
    output, bias = np.zeros((2, dimension), np.float32), np.zeros(2, np.float32)
    counts = np.bincount(np.array(labels, int), minlength=2)
    if counts.min() == 0:
        bias[1 if counts[0] == 0 else 0] = 4.0
        return Model(vectors, output, bias)
    weight = (counts.sum() / (2 * counts)) ** 0.5
    steps, step = epochs * len(bags), 0
    for _ in range(epochs):
        for k in rng.permutation(len(bags)):
            ids, share = bags[k]
            lr = rate * (1 - step / steps)
            step += 1
            hidden = share @ vectors[ids] if len(ids) else np.zeros(dimension, np.float32)
            z = output @ hidden + bias
            p = np.exp(z - z.max())
            p /= p.sum()
            p[labels[k]] -= 1
            p *= min(4.0, weight[labels[k]])
            if len(ids):
                # shares are small: the common scale of a mean's gradient is lifted as the words' number grows
                vectors[ids] -= (lr * len(ids) ** 0.5 * share)[:, None] * (p @ output)
            output -= lr * p[:, None] * hidden
            bias -= 0.1 * lr * p
    return Model(vectors, output, bias)


def fit(docs: DataFrame, labels: DataFrame, most: int = TRAINING_ROWS, id_col: str = "doc_id", text_col: str = "text",
        label_col: str = "quality") -> Model:
    """Train on at most *most* labelled rows that are not held out.

    Bags are made by the executors; only those of the chosen rows come to the driver.
    Rows whose id or label is null teach nothing; an id with both labels counts as good; of rows that
    repeat an id the one whose text has the least hash teaches.
    """
    known = labels.select(F.col(id_col).alias("doc_id"), F.col(label_col).cast("int").alias("y")).where("y in (0, 1)")
    known = known.where(~held_out(F.col("doc_id"))).groupBy("doc_id").agg(F.max("y").alias("y"))
    known = known.orderBy(F.xxhash64("doc_id"), "doc_id").limit(most)  # the sample's bound
    rows = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text")).join(F.broadcast(known), "doc_id")
    rows = rows.groupBy("doc_id", "y").agg(F.min_by("text", F.xxhash64("text")).alias("text"))

    def run(batches):
        import pyarrow as pa

        for batch in batches:
            got = [bag(t) for t in batch.column("text").to_pylist()]
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id"), batch.column("y"), pa.array([x.astype("<i4").tobytes() for x, _ in got], pa.binary()), pa.array([x.astype("<f4").tobytes() for _, x in got], pa.binary())],
                names=["doc_id", "y", "ids", "share"],
            )

    kind = docs.schema[id_col].dataType.simpleString()
    sample = rows.select("doc_id", "y", "text").mapInArrow(run, f"doc_id {kind}, y int, ids binary, share binary")
    got = sorted(((r["doc_id"], r["y"], r["ids"], r["share"]) for r in sample.toLocalIterator()), key=lambda r: r[0])  # one row an id
    return train([(np.frombuffer(i, "<i4"), np.frombuffer(s, "<f4")) for _, _, i, s in got], [y for _, y, _, _ in got])


class Scorer:
    """Scores whole texts; a word's part of the score is computed once and kept."""

    def __init__(self, weights: np.ndarray, bias: float) -> None:
        self._weights, self._bias = weights, bias
        self._recency = weights[recency_buckets(len(weights))].astype(np.float64)
        self._number: dict[str, int] = {}
        self._chars = 0
        self._parts, self._sizes = np.zeros(0), np.zeros(0)

    def _learn(self, words: list[str]) -> None:
        ids, whose = features(words, len(self._weights))
        if self._full(len(words)):
            self._chars, self._number, self._parts, self._sizes = 0, {}, np.zeros(0), np.zeros(0)
        self._chars += sum(map(len, words))
        self._number.update(zip(words, range(len(self._number), len(self._number) + len(words))))
        self._parts = np.append(self._parts, np.bincount(whose, weights=self._weights[ids], minlength=len(words)))
        self._sizes = np.append(self._sizes, np.bincount(whose, minlength=len(words)))

    def _full(self, more: int) -> bool:
        return len(self._number) + more > CACHE_WORDS or self._chars > CACHE_CHARS

    def scores(self, texts: list[str | None]) -> list[float]:
        """Between 0 and 1; for a text without words what the constant part says."""
        out: list[float] = []
        for k in range(0, len(texts), _ROWS):
            split = [(t or "").split() for t in texts[k : k + _ROWS]]
            new = set().union(*split)
            lack = new - self._number.keys()
            if lack and self._full(len(lack)):
                lack = new
            if lack:
                self._learn(list(lack))
            sizes, get = np.fromiter(map(len, split), np.int64, len(split)), self._number.__getitem__
            words = np.fromiter((n for ws in split for n in map(get, ws)), np.int64, int(sizes.sum()))
            of = np.repeat(np.arange(len(split)), sizes)
            total = np.bincount(of, weights=self._parts[words], minlength=len(split)) + recencies(words, of, len(split)) @ self._recency
            z = self._bias + total / (np.bincount(of, weights=self._sizes[words] + 1, minlength=len(split)) + PRIOR)
            out += (1 / (1 + np.exp(-np.clip(z, -60, 60)))).tolist()
        return out


def _slices(batches) -> Iterator:
    """The rows of *batches* in batches of _ROWS."""
    for batch in batches:
        for k in range(0, batch.num_rows, _ROWS):
            yield batch.slice(k, _ROWS)


def _scorer(sent, _kept: dict = {}) -> Scorer:  # noqa: B006
    """This worker process's scorer for a broadcast model; its words serve all the worker's tasks."""
    model = sent.value
    if _kept.get("bias") != model[1] or not np.array_equal(_kept["weights"], model[0]):
        _kept.update(weights=model[0], bias=model[1], scorer=Scorer(*model))
    return _kept["scorer"]


def score(docs: DataFrame, model: Model, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id and score of every row; the folded weights (BUCKETS floats, 1 MB) are broadcast.

    Null and empty texts get the score of the constant part; ids may be null or repeat; an empty
    table gives no rows; other columns are not read.
    """
    weights, bias = model.weights()
    sent = docs.sparkSession.sparkContext.broadcast((weights, bias))

    def run(batches):
        import pyarrow as pa

        scorer = _scorer(sent)
        for batch in _slices(batches):
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(scorer.scores(batch.column(1).to_pylist()), pa.float64())], names=["doc_id", "score"])

    kind = docs.schema[id_col].dataType.simpleString()
    return docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text")).mapInArrow(run, f"doc_id {kind}, score double")


def keep_good(docs: DataFrame, model: Model, threshold: float = THRESHOLD, text_col: str = "text") -> DataFrame:
    """The rows of *docs* whose score reaches *threshold*, with all their columns."""
    weights, bias = model.weights()
    sent = docs.sparkSession.sparkContext.broadcast((weights, bias))
    at = docs.columns.index(text_col)

    def run(batches):
        import pyarrow as pa

        scorer = _scorer(sent)
        for batch in _slices(batches):
            yield batch.filter(pa.array([x >= threshold for x in scorer.scores(batch.column(at).to_pylist())], pa.bool_()))

    return docs.mapInArrow(run, docs.schema)


def op10_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Quality score of every document."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    model = fit(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))
    return score(docs, model).select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "score", (F.col("score") >= THRESHOLD).cast("int").alias("predicted"))
