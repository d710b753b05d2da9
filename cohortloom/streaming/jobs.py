"""Incremental jobs on Structured Streaming: ingest with retries, upserts, running statistics, live tables, windows.

Every job stops by itself after the data that is there (``availableNow``), keeps its progress in a checkpoint folder and
gives the same tables when a batch is replayed.
"""

from __future__ import annotations

import time
from collections.abc import Callable, Iterator, Sequence

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from cohortloom.operators.windows import drop_duplicates_keep
from cohortloom.sources.tables import append_delta, compact, read_latest


COMPACT_EVERY = 16


def upsert_latest(batch: DataFrame, path: str, keys: Sequence[str], order: Sequence[str], compact_every: int = COMPACT_EVERY) -> None:
    """Last row per key: the batch is added as a delta, so its cost does not grow with the table; readers merge.

    Every ``compact_every`` deltas the table is rewritten once. A replayed batch changes nothing for readers.
    """
    deltas = append_delta(drop_duplicates_keep(batch, keys, order, "last").select(*batch.columns), path)
    if deltas >= compact_every:
        compact(batch.sparkSession, path, keys, order)


def split_failures(rows: DataFrame, key: str, error: str = "error") -> tuple[DataFrame, DataFrame]:
    """(good rows, (key, error)) of rows whose decoder reports failures in a column."""
    return rows.where(F.col(error).isNull()).drop(error), rows.where(F.col(error).isNotNull()).select(key, error)


#: Order of attempts at a key: the batch, then the retries after it.
ATTEMPT = ["batch", "retry"]


def failure_table(batch_good: DataFrame, batch_bad: DataFrame, path: str, key: str, batch: int, retry: int = 0) -> None:
    """Errors as rows, one per key; a later success clears the key, a later failure replaces the text.

    A batch adds a delta of its own size: its keys with their error, or with none. ``read_failures`` merges in the order of
    the batches, so a batch that is replayed brings back nothing that a later one or a retry has cleared.
    """
    cleared = batch_good.select(key, F.lit(None).cast("string").alias("error"))
    both = cleared.unionByName(batch_bad.select(key, F.col("error").cast("string").alias("error")))
    new = both.groupBy(key).agg(F.max("error").alias("error"))
    new = new.withColumns({"batch": F.lit(batch).cast("bigint"), "retry": F.lit(retry).cast("bigint")})
    if append_delta(new, path) >= COMPACT_EVERY:
        compact(batch_bad.sparkSession, path, [key], ATTEMPT)


def read_failures(spark: SparkSession, path: str, key: str) -> DataFrame | None:
    """(key, error) of the keys whose last attempt failed."""
    rows = read_latest(spark, path, [key], ATTEMPT)
    return None if rows is None else rows.where(F.col("error").isNotNull()).select(key, "error")


def run_available(stream: DataFrame, handle: Callable[[DataFrame, int], None], checkpoint: str, mode: str = "append"):
    """Run a stream over the data that is there and wait; returns the finished query."""
    writer = stream.writeStream.outputMode(mode).option("checkpointLocation", checkpoint).trigger(availableNow=True)
    query = writer.foreachBatch(handle).start()
    query.awaitTermination()
    return query


def ingest_incremental(
    stream: DataFrame, process: Callable[[DataFrame], DataFrame], out: str, failures: str, checkpoint: str, key: str, order: Sequence[str],
):
    """New rows only: ``process`` adds an ``error`` column, good rows are upserted, bad ones kept for a retry.

    Read the stream with ``maxFilesPerTrigger`` to bound a batch; each batch is a commit point.
    """

    def handle(batch: DataFrame, number: int) -> None:
        done = process(batch).persist()
        good, bad = split_failures(done, key)
        upsert_latest(good, out, [key], order)
        failure_table(good, bad, failures, key, number)
        done.unpersist()

    return run_available(stream, handle, checkpoint)


def retry_failures(spark: SparkSession, source: DataFrame, process, out: str, failures: str, key: str, order: Sequence[str]) -> None:
    """Process the rows of ``source`` whose key is in the failure table once more."""
    bad_keys = read_failures(spark, failures, key)
    if bad_keys is None:
        return
    todo = process(source.join(bad_keys.select(key), key, "left_semi")).persist()
    good, bad = split_failures(todo, key)
    upsert_latest(good, out, [key], order)
    last = read_latest(spark, failures, [key], ATTEMPT).agg(F.max(F.struct(*ATTEMPT)).alias("at")).collect()[0]["at"]
    failure_table(good, bad, failures, key, last["batch"], last["retry"] + 1)
    todo.unpersist()


def running_moments(stream: DataFrame, once: Sequence[str], keys: Sequence[str], value: str, time: str, late: str) -> DataFrame:
    """Streaming count, mean and sample variance per key, each record (``once`` columns) counted a single time.

    A repeat is known as one as long as it comes within ``late`` of the newest time seen; older record ids leave the state.
    """
    v = F.col(value)
    told = _timed(stream, time, late).dropDuplicatesWithinWatermark(list(once))
    return told.groupBy(*keys).agg(F.count(v).alias("n"), F.avg(v).alias("mean"), F.var_samp(v).alias("variance"))


def live_leaderboard(stream: DataFrame, keys: Sequence[str], value: str, state: str, states: Sequence[str]) -> DataFrame:
    """Best value and state counts per study over a growing trial log."""
    done = F.when(F.col(state) == "COMPLETE", F.col(value))
    counts = [F.sum((F.col(state) == s).cast("bigint")).alias(f"trials_{s.lower()}") for s in states]
    return stream.groupBy(*keys).agg(F.min(done).alias("best"), F.count(F.lit(1)).alias("trials"), *counts)


def write_updates(stream: DataFrame, path: str, checkpoint: str, keys: Sequence[str]):
    """Keep an aggregating stream as a table with a row per key: a batch adds the rows that it changed, no more."""

    def handle(batch: DataFrame, number: int) -> None:
        upsert_latest(batch.withColumn("_batch", F.lit(number)), path, keys, ["_batch"])

    return run_available(stream, handle, checkpoint, "update")


def read_updates(spark: SparkSession, path: str, keys: Sequence[str]) -> DataFrame:
    """The table of :func:`write_updates`."""
    return read_latest(spark, path, keys, ["_batch"]).drop("_batch")


def write_closed(stream: DataFrame, path: str, checkpoint: str, keys: Sequence[str]):
    """Keep the windows or sessions that the watermark has closed (append mode); a replayed batch changes nothing."""
    return run_available(stream, lambda batch, number: upsert_latest(batch.withColumn("_batch", F.lit(number)), path, keys, ["_batch"]), checkpoint)


def with_heartbeat(handle: Callable[[DataFrame, int], None], path: str) -> Callable[[DataFrame, int], None]:
    """A batch handler that also writes (rows, duration_ms) of every batch; a replayed batch replaces its own row.

    The rows are held while the batch is handled, so that what is counted is what was handled, computed once.
    """

    def run(batch: DataFrame, number: int) -> None:
        start = time.monotonic()
        held = batch.persist()
        handle(held, number)
        took = int((time.monotonic() - start) * 1000)
        row = held.agg(F.count(F.lit(1)).alias("rows")).withColumn("duration_ms", F.lit(took).cast("bigint"))
        row.write.mode("overwrite").parquet(f"{path}/batch={number}")
        held.unpersist()

    return run


def progress_heartbeat(spark: SparkSession, path: str) -> DataFrame:
    """(batch, rows, duration_ms) of all batches since the start."""
    return spark.read.parquet(path).select(F.col("batch").cast("bigint").alias("batch"), "rows", "duration_ms")


def _timed(stream: DataFrame, time: str, late: str) -> DataFrame:
    """A stream gets its watermark, on a timestamp with a time zone."""
    return stream.withColumn(time, F.col(time).cast("timestamp")).withWatermark(time, late) if stream.isStreaming else stream


def event_windows(stream: DataFrame, time: str, size: str, slide: str | None, keys: Sequence[str], late: str = "10 minutes") -> DataFrame:
    """Tumbling or sliding counts and sums under a watermark; works on a batch too."""
    base = _timed(stream, time, late)
    w = F.window(time, size, slide) if slide else F.window(time, size)
    g = base.groupBy(w, *keys).agg(F.count(F.lit(1)).alias("n"), F.sum("value").alias("total"))
    return g.select(F.col("window.start").alias("start"), F.col("window.end").alias("end"), *keys, "n", "total")


def event_sessions(stream: DataFrame, time: str, gap: str, keys: Sequence[str], late: str = "10 minutes") -> DataFrame:
    """Sessions closed by a gap. Spark merges sessions per key from sorted partial sessions."""
    base = _timed(stream, time, late)
    g = base.groupBy(F.session_window(time, gap), *keys).agg(F.count(F.lit(1)).alias("n"), F.sum("value").alias("total"))
    return g.select(F.col("session_window.start").alias("start"), F.col("session_window.end").alias("end"), *keys, "n", "total")


#: Arbitrary state lives in the store that keeps it on disk.
STATE_STORE = ("spark.sql.streaming.stateStore.providerClass", "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")


class _Moments(StatefulProcessor):
    """(n, mean, m2) of a key, merged from the chunks of each batch."""

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.moments = handle.getValueState("moments", "n bigint, mean double, m2 double")

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timers) -> Iterator[pd.DataFrame]:
        n, mean, m2 = self.moments.get() if self.moments.exists() else (0, 0.0, 0.0)
        for chunk in rows:
            x = chunk.iloc[:, -1].dropna().to_numpy()
            if len(x):
                k, m = len(x), float(x.mean())
                gap, total = m - mean, n + k
                m2 += float(((x - m) ** 2).sum()) + gap * gap * n * k / total
                mean, n = mean + gap * k / total, total
        self.moments.update((n, mean, m2))
        yield pd.DataFrame([(*key, n, mean, m2)], columns=["k", "salt", "n", "mean", "m2"])

    def close(self) -> None:
        pass


def welford(stream: DataFrame, key: str, value: str, once: str, salts: int = 64) -> DataFrame:
    """Custom state per (key, salt): (n, mean, m2), merged batch by batch (update mode). The salt is a hash of the column
    ``once``, so that a key with a third of the stream is spread over ``salts`` states; :func:`merged_moments` adds them up.
    """
    stream.sparkSession.conf.set(*STATE_STORE)
    rows = stream.select(F.col(key).cast("string").alias("k"), F.pmod(F.xxhash64(once), F.lit(salts)).cast("int").alias("salt"), F.col(value).cast("double").alias("_v"))
    return rows.groupBy("k", "salt").transformWithStateInPandas(_Moments(), "k string, salt int, n bigint, mean double, m2 double", "update", "none")


def merged_moments(parts: DataFrame) -> DataFrame:
    """(k, n, mean, m2) from the partial states of each key: three sums."""
    total = parts.groupBy("k").agg(F.sum("n").alias("n"), F.sum(F.col("n") * F.col("mean")).alias("s"), F.sum(F.col("m2") + F.col("n") * F.col("mean") * F.col("mean")).alias("q"))
    mean = F.col("s") / F.when(F.col("n") > 0, F.col("n"))
    return total.select("k", "n", F.coalesce(mean, F.lit(0.0)).alias("mean"), F.greatest(F.col("q") - F.coalesce(mean * F.col("s"), F.lit(0.0)), F.lit(0.0)).alias("m2"))
