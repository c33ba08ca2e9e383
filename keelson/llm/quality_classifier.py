"""Quality classifier: supervised subword embeddings (hashed words and n-grams).

A document's features are its words and their character n-grams, hashed into
``BUCKETS`` rows of an embedding table; a word equal to the one before it adds
the feature ``REPEAT``. Their vectors are averaged and a softmax over the two
classes gives the score. Table and output layer are learned by numpy stochastic
gradient descent on a bounded, documented sample of the labelled rows.

Scoring covers every document. As average and softmax's input are linear, each
bucket is folded to one number (class 1 against class 0), and a word's sum over
its features is computed once and reused for all texts in a task.
"""

from __future__ import annotations

import operator
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import WordMemo, arrow_schema, binaries, bucket_of, frugal, small_batches

BUCKETS = 1 << 17
DIMENSIONS = 16
NGRAMS = (3, 4, 5)
#: The classifier is fitted on so many labelled documents at most: those whose ids hash lowest.
SAMPLE = 3000
EPOCHS = 5
RATE = 0.6
SEED = 11
THRESHOLD = 0.3
FOLDS = 5
REPEAT = b"\x00repeat"
_MIX = np.uint64(0x9E3779B97F4A7C15)


def _scrambled(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(31))) * np.uint64(0xBF58476D1CE4E5B9)
    return x ^ (x >> np.uint64(29))


def word_features(words: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """(word number, bucket) of every feature: each word, and its n-grams with ``<`` and ``>`` at its ends."""
    points = np.frombuffer(("\0" + "\0".join(f"<{w.decode('utf-8', 'replace').replace(chr(0), ' ')}>" for w in words) + "\0").encode("utf-32-le", "replace"), np.uint32).astype(np.uint64)
    is_end = points == 0
    which = np.cumsum(is_end) - 1
    owners, buckets = [], []
    since = np.zeros(len(points), np.int64)  # the place of the last end at or before each place
    since[is_end] = np.flatnonzero(is_end)
    since = np.maximum.accumulate(since)
    place = np.arange(len(points))
    for n in NGRAMS:
        gram = np.zeros(max(0, len(points) - n + 1), np.uint64)
        for k in range(n):
            gram = gram * _MIX + points[k : len(points) - n + 1 + k]
        whole = ((place - since >= n) & ~is_end)[n - 1 :]
        owners.append(which[n - 1 :][whole])
        buckets.append(_scrambled(gram[whole] + np.uint64(n)) % np.uint64(BUCKETS))
    starts = np.flatnonzero(is_end)[:-1]
    powers = np.cumprod(np.concatenate([[np.uint64(1)], np.full(int(np.diff(np.flatnonzero(is_end)).max(initial=1)), _MIX)]))
    hashed = np.add.reduceat(np.where(is_end, np.uint64(0), _scrambled(points + np.uint64(7))) * powers[place - since], starts) if len(starts) else np.zeros(0, np.uint64)
    owners.append(np.arange(len(words)))
    buckets.append(_scrambled(hashed) % np.uint64(BUCKETS))
    return np.concatenate(owners).astype(np.int64), np.concatenate(buckets).astype(np.int64)


def document_features(text: bytes | None) -> tuple[list[int], list[int]]:
    """Buckets of a whole text and how often each occurs."""
    words = (text or b"").split()
    if not words:
        return [], []
    same = sum(map(operator.eq, words, words[1:]))
    distinct, times = np.unique(np.array(words, object), return_counts=True) if len(words) > 1 else (np.array(words, object), np.ones(1, int))
    owner, bucket = word_features(list(distinct))
    weight = np.bincount(bucket, times[owner].astype(float), BUCKETS)
    if same:
        weight[word_features([REPEAT])[1][-1]] += same
    at = np.flatnonzero(weight)
    return at.tolist(), weight[at].astype(int).tolist()


class SubwordClassifier:
    """Embeddings, a softmax layer over classes 0 and 1, and their training."""

    def __init__(self, embeddings: np.ndarray, output: np.ndarray, bias: np.ndarray):
        self.embeddings, self.output, self.bias = embeddings, output, bias

    @classmethod
    def fit(cls, features: list[tuple[np.ndarray, np.ndarray]], labels: list[int], epochs: int = EPOCHS, rate: float = RATE) -> SubwordClassifier:
        random = np.random.default_rng(SEED)
        embeddings = random.uniform(-1 / DIMENSIONS, 1 / DIMENSIONS, (BUCKETS, DIMENSIONS)).astype(np.float32)
        output = np.zeros((2, DIMENSIONS), np.float32)
        bias = np.zeros(2, np.float32)
        total, step = max(1, epochs * len(labels)), 0
        for _ in range(epochs):
            for k in random.permutation(len(labels)):
                now = rate * (1 - step / total)
                step += 1
                at, share = features[k]
                if len(at) == 0:
                    continue
                hidden = share @ embeddings[at]
                logits = output @ hidden + bias
                error = np.exp(logits - logits.max())
                error /= error.sum()
                error[labels[k]] -= 1
                back = error @ output
                output -= now * np.outer(error, hidden)
                bias -= now * 0.1 * error
                embeddings[at] -= (now * len(at) ** 0.5) * share[:, None] * back
        return cls(embeddings, output, bias)

    def folded(self) -> tuple[np.ndarray, float]:
        """Per bucket, and of the bias: the logit of class 1 against class 0."""
        return (self.embeddings @ (self.output[1] - self.output[0])).astype(np.float64), float(self.bias[1] - self.bias[0])


def train(docs: DataFrame, labels: DataFrame, label: str = "quality", text: str = "text", sample: int = SAMPLE, folds: int = FOLDS) -> SubwordClassifier:
    """Fit on labelled documents outside the held-out fold, ``sample`` of them at most.

    Rows with a null label or text are left out; of several labels of one id the
    largest counts. Without any row the model answers 0.5.
    """
    chosen = labels.where(F.col(label).isin(0, 1) & F.col("doc_id").isNotNull() & (bucket_of("doc_id", folds) != 0))
    chosen = chosen.groupBy("doc_id").agg(F.max(label).alias("label")).orderBy(F.xxhash64(F.col("doc_id").cast("long")), "doc_id").limit(sample)
    rows = docs.select("doc_id", F.col(text).alias("text")).where(F.col("text").isNotNull()).join(F.broadcast(chosen), "doc_id")  # at most `sample` ids
    rows = rows.groupBy("doc_id", "label").agg(F.min("text").alias("text"))  # of repeated ids, one text
    schema = T.StructType([T.StructField("doc_id", T.LongType()), T.StructField("label", T.IntegerType()), T.StructField("at", T.ArrayType(T.IntegerType())), T.StructField("times", T.ArrayType(T.IntegerType()))])
    wanted = arrow_schema(schema)

    def featurise(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for start in range(0, batch.num_rows, 256):
                part = batch.slice(start, 256)
                found = [document_features(t) for t in binaries(part.column(2))]
                yield pa.RecordBatch.from_arrays([part.column(0).cast(pa.int64()), part.column(1).cast(pa.int32()), pa.array([f[0] for f in found], wanted.field(2).type), pa.array([f[1] for f in found], wanted.field(3).type)], schema=wanted)

    def fitted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """The model of the whole sample, which one task can hold: ``sample`` rows of ``BUCKETS`` features at most."""
        rows = []
        for batch in batches:
            for doc_id, label, at, times in zip(*(batch.column(k) for k in range(4)), strict=True):
                times = np.array(times.values, np.float32)
                rows.append((doc_id.as_py(), label.as_py(), np.array(at.values, np.int32), times / max(times.sum(), 1)))
        rows.sort(key=operator.itemgetter(0))
        model = SubwordClassifier.fit([row[2:] for row in rows], [row[1] for row in rows])
        blobs = [pa.array([part.astype("<f4").tobytes()], pa.binary()) for part in (model.embeddings, model.output, model.bias)]
        yield pa.RecordBatch.from_arrays(blobs, names=["embeddings", "output", "bias"])

    # The features stay on the executors; the driver gets the model alone: 8 MB.
    small_batches(docs.sparkSession)
    features = rows.select("doc_id", "label", "text").mapInArrow(frugal(featurise), schema).repartition(1)
    got = features.mapInArrow(frugal(fitted), "embeddings binary, output binary, bias binary").toArrow().to_pylist()
    if not got:
        return SubwordClassifier.fit([], [])
    embeddings, output, bias = (np.frombuffer(got[0][k], "<f4") for k in ("embeddings", "output", "bias"))
    return SubwordClassifier(embeddings.reshape(BUCKETS, DIMENSIONS), output.reshape(2, DIMENSIONS), bias)


def score(docs: DataFrame, model: SubwordClassifier, text: str = "text", keep: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """``keep`` and ``score``, the probability of class 1, for every row. ``text`` crosses to Python once, be it kept or not."""
    small_batches(docs.sparkSession)
    rows = docs.select(*keep) if text in keep else docs.select(*keep, text)
    text_at = rows.columns.index(text)
    schema = T.StructType([*(rows.schema[k] for k in keep), T.StructField("score", T.DoubleType())])
    wanted = arrow_schema(schema)
    table, bias = model.folded()
    shared = docs.sparkSession.sparkContext.broadcast((table, bias))  # BUCKETS doubles: 1 MB
    repeat = float(table[word_features([REPEAT])[1][-1]])

    def logits_of(words: list[bytes]) -> np.ndarray:
        """Of each word, the sum over its features and their number."""
        owner, bucket = word_features(words)
        return np.stack([np.bincount(owner, shared.value[0][bucket], len(words)), np.bincount(owner, minlength=len(words))], axis=1)

    def scored(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        memo, bias = WordMemo(2, logits_of), shared.value[1]
        for batch in batches:
            out = []
            for one in binaries(batch.column(text_at)):
                words = (one or b"").split()
                z = bias
                if words:
                    same = sum(map(operator.eq, words, words[1:]))
                    total, n = memo.of(words).sum(axis=0)
                    z += (total + same * repeat) / (n + same)
                out.append(1 / (1 + np.exp(-min(max(z, -500.0), 500.0))))
            yield pa.RecordBatch.from_arrays([c.cast(f.type) for c, f in zip([*batch.columns[: len(keep)], pa.array(out, pa.float64())], wanted, strict=True)], schema=wanted)

    return rows.mapInArrow(frugal(scored), schema)


def classify_quality(docs: DataFrame, labels: DataFrame, threshold: float = THRESHOLD, keep: tuple[str, ...] = (), doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """``keep``, ``doc_id``, ``held_out``, ``score`` and ``predicted`` for every row of ``docs``.

    A null or empty text gets the score of no evidence (the bias alone). Repeated
    rows are scored each; an empty table gives no rows; without labels every
    score is 0.5. Columns besides ``doc_id`` and ``text`` are no inputs.
    """
    model = train(docs.select(F.col(doc_id).alias("doc_id"), F.col(text).alias("text")), labels)
    names = dict.fromkeys((*keep, doc_id))
    return score(docs, model, text, tuple(names)).select(
        *names, (bucket_of(doc_id, FOLDS) == 0).alias("held_out"), "score", (F.col("score") >= threshold).cast("int").alias("predicted")
    )
