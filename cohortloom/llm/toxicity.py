"""Toxic passages by maximum-scoring segments.

Every token has a log-odds score from labelled texts under Dirichlet priors: a word's counts are backed by those of its
first five bytes, these by its first four, these by the share of all tokens, and frequent words of the corpus ask for
more evidence. A linear-time scan finds all maximal segments of a text by summed score. Extreme-value statistics of
clean texts turn a segment's score into the number of equally good segments expected by chance in a text of that length.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cohortloom.llm.labelled import MOST_LABELS, fit_logistic, labelled_sample
from cohortloom.llm.text import ALNUM_BYTES, Chunk, chunks, find_words, prefix_hash, range_hash

#: Buckets of words and of word beginnings; they bound the model whatever the vocabulary.
WORD_BITS, STEM_BITS = 18, 16
STEMS = (5, 4)
PRIOR, CORPUS_PRIOR = 1.0, 2000.0
#: A token's score is its log-odds (of the share less one standard error, no lower than LEAST_ODDS) less the drift, so that a
#: clean text sinks on average.
DRIFT, LEAST_ODDS = 0.5, -2.0
SIGNIFICANT = 0.01
#: Bins of the score histogram from which the extreme-value rate is solved.
LOW_SCORE, HIGH_SCORE, SCORE_BINS = -12.0, 12.0, 480


def buckets(chunk: Chunk) -> tuple[np.ndarray, list[np.ndarray]]:
    """First word of each row (and the end), and for each word the buckets of the word and of its beginnings."""
    words = find_words(chunk, ALNUM_BYTES)
    sums = prefix_hash(chunk)
    out = [(range_hash(sums, words.start, words.end) >> np.uint64(64 - WORD_BITS)).astype(np.int32)]
    for n in STEMS:
        out.append((range_hash(sums, words.start, np.minimum(words.end, words.start + n)) >> np.uint64(64 - STEM_BITS)).astype(np.int32))
    return words.row_first, out


def _sizes() -> list[int]:
    return [1 << WORD_BITS, *[1 << STEM_BITS] * len(STEMS)]


COUNTS = "kind int, bucket int, corpus long, toxic long, clean long"


def count_batches(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Counts of a partition of (text, label, part): all tokens, and those of toxic and clean texts to learn from."""
    tables = [np.zeros((3, n), dtype=np.int64) for n in _sizes()]
    seen = False
    for batch in batches:
        label = np.asarray(batch.column("label").fill_null(-1))
        for chunk in chunks(batch.column("text")):
            first, found = buckets(chunk)
            of = np.repeat(label[chunk.first : chunk.first + chunk.rows], np.diff(first))
            seen = seen or len(of) > 0
            for table, bucket in zip(tables, found, strict=True):
                table[0] += np.bincount(bucket, minlength=table.shape[1])
                for row, value in ((1, 1), (2, 0)):
                    if (mask := of == value).any():
                        table[row] += np.bincount(bucket[mask], minlength=table.shape[1])
    if seen:
        for kind, table in enumerate(tables):
            at = np.flatnonzero(table[0])
            columns = [np.full(len(at), kind, np.int32), at.astype(np.int32), *table[:, at]]
            yield pa.RecordBatch.from_arrays([pa.array(c) for c in columns], names=["kind", "bucket", "corpus", "toxic", "clean"])


@dataclass
class Model:
    """Counts by bucket, and the calibration: rate and size of the extreme-value law, slope and intercept of the score."""

    toxic: list[np.ndarray]
    seen: list[np.ndarray]
    prior: np.ndarray
    share: float
    rate: float = 1.0
    log_size: float = 0.0
    slope: float = 0.0
    intercept: float = 0.0

    def token_scores(self, found: list[np.ndarray]) -> np.ndarray:
        share = np.full(len(found[0]), self.share)
        for level in range(len(STEMS), 0, -1):
            b = found[level]
            share = (self.toxic[level][b] + PRIOR * share) / (self.seen[level][b] + PRIOR)
        b = found[0]
        prior = self.prior[b]
        n = self.seen[0][b] + prior
        share = (self.toxic[0][b] + prior * share) / n
        # One standard error less: on the scale of shares, where it is small for words seen in toxic texts alone.
        low = np.clip(share - np.sqrt(share * (1 - share) / n), 1e-3, 1 - 1e-3)
        odds = np.log(low / (1 - low)) - np.log(self.share / (1 - self.share))
        return np.maximum(odds, LEAST_ODDS) - DRIFT

    def log_expected(self, score: np.ndarray, tokens: np.ndarray) -> np.ndarray:
        """Log of the number of segments as good as this that chance gives a text of so many tokens."""
        return self.log_size + np.log(np.maximum(tokens, 1)) - self.rate * score

    def probability(self, score: np.ndarray, tokens: np.ndarray) -> np.ndarray:
        return 1 / (1 + np.exp(np.clip(self.slope * self.log_expected(score, tokens) - self.intercept, -40, 40)))


def best_segment(scores: np.ndarray, first: np.ndarray) -> np.ndarray:
    """Best segment score of each row (0 for none): rise of the running total over its lowest value so far."""
    total = np.concatenate([[0.0], np.cumsum(scores)])
    out = np.zeros(len(first) - 1)
    for i in np.flatnonzero(np.diff(first)):
        t = total[first[i] : first[i + 1] + 1]
        out[i] = max(0.0, float((t[1:] - np.minimum.accumulate(t)[:-1]).max()))
    return out


def maximal_segments(scores: np.ndarray) -> list[tuple[int, int, float]]:
    """All maximal scoring segments (first, last exclusive, score), in order.

    Runs of one sign are merged first. A list of open segments is kept with the totals before and after each; a new
    positive run joins the nearest open segment that starts lower, if that one also ends lower, and so on.
    """
    positive = scores > 0
    if not positive.any():
        return []
    edges = np.flatnonzero(np.diff(positive)) + 1
    starts = np.concatenate([[0], edges])
    ends = np.concatenate([edges, [len(scores)]])
    total = np.concatenate([[0.0], np.cumsum(scores)])
    open_: list[list[float]] = []
    for a, b in zip(starts, ends, strict=True):
        if not positive[a]:
            continue
        segment = [int(a), int(b), total[a], total[b]]
        while True:
            below = next((j for j in range(len(open_) - 1, -1, -1) if open_[j][2] < segment[2]), None)
            if below is None or open_[below][3] >= segment[3]:
                open_.append(segment)
                break
            segment = [open_[below][0], segment[1], open_[below][2], segment[3]]
            del open_[below:]
    return [(int(a), int(b), float(y - x)) for a, b, x, y in open_]


def _fit_rate(histogram: np.ndarray) -> float:
    """The positive root of: mean of exp(rate * score) is 1. Where scores never rise, the largest rate tried."""
    values = LOW_SCORE + (np.arange(SCORE_BINS) + 0.5) * (HIGH_SCORE - LOW_SCORE) / SCORE_BINS
    p = histogram / max(histogram.sum(), 1)
    low, high = 0.0, 8.0
    for _ in range(60):
        middle = (low + high) / 2
        low, high = (middle, high) if float((p * np.exp(middle * values)).sum()) < 1 else (low, middle)
    return max(low, 0.05)


def fit_model(docs: DataFrame, labels: DataFrame, label: str, key: str, text: str, mod: int, rest: int, most: int = MOST_LABELS) -> Model:
    """Counts over the whole table (background) and the labelled sample; one fifth of the sample calibrates."""
    spark = docs.sparkSession
    # At most ``most`` rows.
    sample = F.broadcast(labelled_sample(labels, label, key, mod, rest, most))
    source = docs.select(F.col(key).alias("__key"), F.col(text).cast("string").alias("text"))
    rows = source.join(sample, F.col("__key") == F.col("label_key"), "left")
    learn = rows.select("text", F.when(F.col("part") != 0, F.col("label")).alias("label"))
    counted = learn.mapInArrow(count_batches, COUNTS).groupBy("kind", "bucket").agg(*[F.sum(c).alias(c) for c in ("corpus", "toxic", "clean")])
    # One row per bucket: bounded by WORD_BITS and STEM_BITS.
    table = counted.toArrow().to_pandas()
    toxic, seen, corpus = [], [], []
    for kind, size in enumerate(_sizes()):
        part = table[table["kind"] == kind]
        dense = np.zeros((3, size))
        dense[:, part["bucket"]] = part[["corpus", "toxic", "clean"]].to_numpy(dtype=float).T
        corpus.append(dense[0])
        toxic.append(dense[1])
        seen.append(dense[1] + dense[2])
    share = (toxic[0].sum() + 1) / (seen[0].sum() + 2)
    model = Model(toxic, seen, PRIOR + CORPUS_PRIOR * corpus[0] / max(corpus[0].sum(), 1), float(np.clip(share, 1e-3, 0.5)))

    shared = spark.sparkContext.broadcast(model)

    def calibrate(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            label = np.asarray(batch.column("label"))
            for chunk in chunks(batch.column("text")):
                first, found = buckets(chunk)
                scores = shared.value.token_scores(found)
                bins = np.clip((scores - LOW_SCORE) / (HIGH_SCORE - LOW_SCORE) * SCORE_BINS, 0, SCORE_BINS - 1).astype(np.int64)
                own = label[chunk.first : chunk.first + chunk.rows]
                clean = np.repeat(own == 0, np.diff(first))
                histogram = np.bincount(bins[clean], minlength=SCORE_BINS).tolist()
                n = chunk.rows
                yield pa.RecordBatch.from_pydict(
                    {"label": own, "best": best_segment(scores, first), "tokens": np.diff(first), "bins": [histogram if i == 0 else None for i in range(n)]},
                    schema=pa.schema([("label", pa.int32()), ("best", pa.float64()), ("tokens", pa.int64()), ("bins", pa.list_(pa.int64()))]),
                )

    held = rows.filter("part = 0").select("text", "label").mapInArrow(calibrate, "label int, best double, tokens long, bins array<bigint>").toArrow().to_pandas()
    if len(held):
        histogram = np.sum([np.asarray(b) for b in held["bins"] if b is not None], axis=0)
        y, best, tokens = held["label"].to_numpy(float), held["best"].to_numpy(), held["tokens"].to_numpy()
        model.rate = _fit_rate(np.asarray(histogram, dtype=float))
        clean = (y == 0) & (tokens > 0)
        if clean.any():
            # The mean of a Gumbel variable is Euler's constant.
            model.log_size = float((model.rate * best[clean] - np.log(tokens[clean])).mean() - np.euler_gamma)
        model.slope, model.intercept = fit_logistic(-model.log_expected(best, tokens), y)
    shared.unpersist()
    return model


SCORED = "score double, best double, n_tokens long, passages array<struct<first:int,last:int,score:double,expected:double>>"


def toxic_passages(docs: DataFrame, model: Model, key: str = "doc_id", text: str = "text") -> DataFrame:
    """One row per input row: key, score (0 to 1), best (segment score), n_tokens, passages (words from 0, end exclusive,
    with their expected number by chance, at most ``SIGNIFICANT``). Null and empty texts have no passage and the score of
    a text without any sign. Equal texts get equal scores. Only key and text are read, so other columns may clash."""
    shared = docs.sparkSession.sparkContext.broadcast(model)
    fields = docs.select(F.col(key).alias("__key"))

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = shared.value
        for batch in batches:
            for chunk in chunks(batch.column("text")):
                first, found = buckets(chunk)
                scores = m.token_scores(found)
                best, tokens = best_segment(scores, first), np.diff(first)
                passages: list = [[]] * chunk.rows
                for i in np.flatnonzero((tokens > 0) & (m.log_expected(best, tokens) <= np.log(SIGNIFICANT))):
                    some = [(a, b, s, float(np.exp(m.log_expected(np.array(s), np.array(tokens[i]))))) for a, b, s in maximal_segments(scores[first[i] : first[i + 1]])]
                    passages[i] = [dict(first=a, last=b, score=s, expected=e) for a, b, s, e in some if e <= SIGNIFICANT]
                yield pa.RecordBatch.from_arrays(
                    [
                        batch.column("__key").slice(chunk.first, chunk.rows),
                        pa.array(m.probability(best, tokens)),
                        pa.array(best),
                        pa.array(tokens.astype(np.int64)),
                        pa.array(passages, type=PASSAGES),
                    ],
                    names=["__key", "score", "best", "n_tokens", "passages"],
                )

    source = docs.select(F.col(key).alias("__key"), F.col(text).cast("string").alias("text"))
    out = source.mapInArrow(score, f"__key {fields.schema[0].dataType.simpleString()}, {SCORED}")
    return out.withColumnRenamed("__key", key)


PASSAGES = pa.list_(pa.struct([("first", pa.int32()), ("last", pa.int32()), ("score", pa.float64()), ("expected", pa.float64())]))


def score_toxicity(docs: DataFrame, labels: DataFrame, key: str = "doc_id", text: str = "text", label: str = "toxic", mod: int = 4, rest: int = 2) -> DataFrame:
    """Fit on the labelled rows whose crc32 remainder is not ``rest`` and score every row."""
    return toxic_passages(docs, fit_model(docs, labels, label, key, text, mod, rest), key, text)
