"""Quality classifier: random-indexing word vectors, pooled per document, and a small network.

A token's vector is the sum, over the whole corpus, of the fixed sparse index vectors of its neighbours. Tokens are
hashed into a bounded number of buckets, so tasks add up a matrix of fixed size and the vectors can be broadcast
whatever the vocabulary. A text is described by the mean, spread and step size of its tokens' vectors. A two-layer
network in NumPy is fitted on a bounded labelled sample; a temperature from a part it hasn't seen calibrates it.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cohortloom.llm.labelled import MOST_LABELS, labelled_sample
from cohortloom.llm.text import ALNUM_BYTES, NONBLANK_BYTES, Chunk, chunks, mix64, prefix_hash, range_hash

BUCKET_BITS, DIMENSIONS, SPARSITY, REACH = 14, 48, 4, 2
BUCKETS = 1 << BUCKET_BITS
PIECE = 1 << 19
FEATURES = 3 * DIMENSIONS + 3
HIDDEN, EPOCHS, BATCH, RATE, DECAY = 32, 40, 128, 3e-3, 1e-4

_CLASS = NONBLANK_BYTES.astype(np.uint8) + ALNUM_BYTES


def tokens(chunk: Chunk) -> tuple[np.ndarray, np.ndarray]:
    """Bucket of every token (runs of letters and digits, runs of signs; case counts), and each row's first token."""
    kind = _CLASS[chunk.data]
    change = np.ones(len(kind), dtype=bool)
    change[1:] = kind[1:] != kind[:-1]
    change[chunk.offsets[:-1][chunk.offsets[:-1] < len(kind)]] = True
    edges = np.flatnonzero(change)
    ends = np.append(edges[1:], len(kind))
    real = kind[edges] > 0
    start, end = edges[real], ends[real]
    hashes = range_hash(prefix_hash(chunk, fold=False), start, end)
    return (hashes >> np.uint64(64 - BUCKET_BITS)).astype(np.int64), np.searchsorted(start, chunk.offsets)


def index_vectors() -> tuple[np.ndarray, np.ndarray]:
    """Places and signs of the few entries of every bucket's index vector."""
    draws = mix64(np.arange(1, BUCKETS * SPARSITY + 1, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15)).reshape(BUCKETS, SPARSITY)
    return (draws % np.uint64(DIMENSIONS)).astype(np.int64), np.where(draws >> np.uint64(63), 1.0, -1.0)


def context_batches(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Context sums of one partition, a row per bucket that occurs."""
    place, sign = index_vectors()
    sums = np.zeros(BUCKETS * DIMENSIONS)
    seen = np.zeros(BUCKETS, dtype=np.int64)
    for batch in batches:
        for chunk in chunks(batch.column(0), PIECE):
            bucket, first = tokens(chunk)
            seen += np.bincount(bucket, minlength=BUCKETS)
            row = np.repeat(np.arange(chunk.rows), np.diff(first))
            for step in range(1, REACH + 1):
                same = row[step:] == row[:-step]
                a, b = bucket[:-step][same], bucket[step:][same]
                for at, near in ((a, b), (b, a)):
                    spots = (at[:, None] * DIMENSIONS + place[near]).ravel()
                    sums += np.bincount(spots, weights=sign[near].ravel(), minlength=len(sums))
    at = np.flatnonzero(seen)
    if len(at):
        flat = pa.array(sums.reshape(BUCKETS, DIMENSIONS)[at].astype(np.float32).ravel())
        vectors = pa.ListArray.from_arrays(pa.array(np.arange(len(at) + 1, dtype=np.int32) * DIMENSIONS), flat)
        yield pa.RecordBatch.from_arrays([pa.array(at.astype(np.int32)), vectors], names=["bucket", "context"])


def word_vectors(docs: DataFrame, text: str) -> np.ndarray:
    """Unit vectors of all buckets from the whole corpus: BUCKETS x DIMENSIONS numbers, whatever its size."""
    rows = docs.select(F.col(text).cast("string").alias("text")).mapInArrow(context_batches, "bucket int, context array<float>")
    sums = [F.sum(F.get("context", F.lit(i))).alias(f"c{i}") for i in range(DIMENSIONS)]
    table = rows.groupBy("bucket").agg(*sums).toArrow().to_pandas()
    vectors = np.zeros((BUCKETS, DIMENSIONS), dtype=np.float32)
    vectors[table["bucket"]] = table.drop(columns="bucket").to_numpy(np.float32)
    return vectors / np.maximum(np.linalg.norm(vectors, axis=1, keepdims=True), 1e-6)


def pooled(chunk: Chunk, vectors: np.ndarray) -> np.ndarray:
    """Features of each row: mean, spread and mean absolute step of its token vectors, rate of repeated neighbours, log
    of the token count, and one. All are zero for a text without tokens."""
    bucket, first = tokens(chunk)
    counts = np.diff(first)
    out = np.zeros((chunk.rows, FEATURES), dtype=np.float32)
    full = np.flatnonzero(counts)
    if not len(full):
        return out
    v = vectors[bucket]
    starts, n = first[:-1][full], counts[full][:, None].astype(np.float32)
    mean = np.add.reduceat(v, starts, axis=0) / n
    spread = np.sqrt(np.maximum(np.add.reduceat(v * v, starts, axis=0) / n - mean * mean, 0))
    step = np.zeros_like(v)
    step[1:] = np.abs(v[1:] - v[:-1])
    repeat = np.zeros(len(bucket), dtype=np.float32)
    repeat[1:] = bucket[1:] == bucket[:-1]
    step[starts] = 0
    repeat[starts] = 0
    inner = np.maximum(n - 1, 1)
    out[full, :DIMENSIONS] = mean
    out[full, DIMENSIONS : 2 * DIMENSIONS] = spread
    out[full, 2 * DIMENSIONS : 3 * DIMENSIONS] = np.add.reduceat(step, starts, axis=0) / inner
    out[full, -3] = np.add.reduceat(repeat, starts) / inner[:, 0]
    out[full, -2] = np.log1p(counts[full])
    out[full, -1] = 1
    return out


@dataclass
class Network:
    """Standardised input, one hidden layer, one output, divided by the temperature."""

    center: np.ndarray
    scale: np.ndarray
    weights: list[np.ndarray]
    temperature: float = 1.0

    def logits(self, x: np.ndarray) -> np.ndarray:
        w1, b1, w2, b2 = self.weights
        z = np.clip((x - self.center) / self.scale, -8, 8)
        return np.tanh(z @ w1 + b1) @ w2 + b2[0]

    def probability(self, x: np.ndarray) -> np.ndarray:
        return 1 / (1 + np.exp(-np.clip(self.logits(x) / self.temperature, -40, 40)))


def fit_network(x: np.ndarray, y: np.ndarray, part: np.ndarray, seed: int = 7) -> Network:
    """Adam on four fifths of the rows, the temperature on the last fifth. One class, or no rows: the smoothed share."""
    rng = np.random.default_rng(seed)
    x = x.astype(np.float64)
    center = x.mean(axis=0) if len(x) else np.zeros(FEATURES)
    scale = (x.std(axis=0) if len(x) else np.ones(FEATURES)) + 1e-3
    share = (y.sum() + 1) / (len(y) + 2)
    w = [rng.normal(0, 1 / np.sqrt(FEATURES), (FEATURES, HIDDEN)), np.zeros(HIDDEN), np.zeros(HIDDEN), np.array([np.log(share / (1 - share))])]
    net = Network(center, scale, w)
    if len(np.unique(y)) < 2:
        return net
    learn = part != 0
    z, t = np.clip((x[learn] - center) / scale, -8, 8), y[learn].astype(np.float64)
    first, second = [np.zeros_like(p) for p in w], [np.zeros_like(p) for p in w]
    turn = 0
    for _ in range(EPOCHS):
        for at in np.array_split(rng.permutation(len(z)), max(1, len(z) // BATCH)):
            h = np.tanh(z[at] @ w[0] + w[1])
            error = (1 / (1 + np.exp(-np.clip(h @ w[2] + w[3][0], -40, 40))) - t[at]) / max(len(at), 1)
            back = np.outer(error, w[2]) * (1 - h * h)
            gradients = [z[at].T @ back + DECAY * w[0], back.sum(axis=0), h.T @ error + DECAY * w[2], np.array([error.sum()])]
            turn += 1
            for i, g in enumerate(gradients):
                first[i] = 0.9 * first[i] + 0.1 * g
                second[i] = 0.999 * second[i] + 0.001 * g * g
                w[i] -= RATE * (first[i] / (1 - 0.9**turn)) / (np.sqrt(second[i] / (1 - 0.999**turn)) + 1e-8)
    held = ~learn
    if held.any():
        logits, t = net.logits(x[held]), y[held]
        loss = lambda temperature: float(np.logaddexp(0, np.where(t == 1, -logits, logits) / temperature).mean())
        net.temperature = min(np.geomspace(0.25, 16, 121), key=loss)
    return net


FEATURE_TYPE = pa.list_(pa.float32())


def fit_quality(docs: DataFrame, labels: DataFrame, label: str, key: str, text: str, mod: int, rest: int, most: int = MOST_LABELS):
    """(vectors, network): vectors from all rows, the network from at most ``most`` labelled ones."""
    spark = docs.sparkSession
    vectors = word_vectors(docs, text)
    shared = spark.sparkContext.broadcast(vectors)
    # At most ``most`` rows.
    sample = F.broadcast(labelled_sample(labels, label, key, mod, rest, most))
    rows = docs.select(F.col(key).alias("__key"), F.col(text).cast("string").alias("text")).join(sample, F.col("__key") == F.col("label_key"))

    def describe(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for chunk in chunks(batch.column("text"), PIECE):
                x = pooled(chunk, shared.value)
                offsets = pa.array(np.arange(chunk.rows + 1, dtype=np.int32) * FEATURES)
                part = batch.slice(chunk.first, chunk.rows)
                yield pa.RecordBatch.from_arrays(
                    [part.column("label"), part.column("part"), part.column("order"), pa.ListArray.from_arrays(offsets, pa.array(x.ravel()))],
                    names=["label", "part", "order", "x"],
                )

    chosen = rows.select("label", "part", F.xxhash64("label_key", "text").alias("order"), "text")
    # Copies of a labelled row count once each, so the table is bounded only after a cut to the sample's size.
    found = chosen.mapInArrow(describe, "label int, part int, order long, x array<float>").orderBy("order").limit(most).toArrow()
    shared.unpersist()
    x = found.column("x").combine_chunks().flatten().to_numpy().reshape(len(found), FEATURES)
    return vectors, fit_network(x, found.column("label").to_numpy().astype(np.float64), found.column("part").to_numpy())


def quality_scores(docs: DataFrame, vectors: np.ndarray, network: Network, keep: list[str], text: str = "text") -> DataFrame:
    """The ``keep`` columns of every row, with ``quality_score`` (0 to 1) in place of a column already called so.

    Null and empty texts are scored as texts without tokens; equal texts get equal scores; an empty table stays empty.
    Texts are read whole, in pieces of about ``PIECE`` bytes or one text."""
    shared = docs.sparkSession.sparkContext.broadcast((vectors, network))
    keep = [c for c in keep if c != "quality_score"]

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        v, net = shared.value
        for batch in batches:
            for chunk in chunks(batch.column("__text"), PIECE):
                part = batch.slice(chunk.first, chunk.rows)
                columns = [part.column(f"k{i}") for i in range(len(keep))]
                p = net.probability(pooled(chunk, v).astype(np.float64))
                yield pa.RecordBatch.from_arrays([*columns, pa.array(p)], names=[*[f"k{i}" for i in range(len(keep))], "quality_score"])

    source = docs.select(*[F.col(f"`{c}`").alias(f"k{i}") for i, c in enumerate(keep)], F.col(text).cast("string").alias("__text"))
    schema = source.drop("__text").schema.add("quality_score", "double")
    out = source.mapInArrow(score, schema)
    return out.select(*[F.col(f"k{i}").alias(c) for i, c in enumerate(keep)], "quality_score")


def score_quality(
    docs: DataFrame,
    labels: DataFrame,
    key: str = "doc_id",
    text: str = "text",
    label: str = "quality",
    mod: int = 3,
    rest: int = 1,
    keep: list[str] | None = None,
) -> DataFrame:
    """Fit on the labelled rows whose crc32 remainder is not ``rest`` and score every row (``keep``: columns returned)."""
    vectors, network = fit_quality(docs, labels, label, key, text, mod, rest)
    return quality_scores(docs, vectors, network, keep or [key], text)
