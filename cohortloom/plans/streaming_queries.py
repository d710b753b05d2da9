"""Incremental queries: streams over the given event, order and embedding tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from cohortloom.plans import fixtures as fx
from cohortloom.registry import query
from cohortloom.session import scratch_path
from cohortloom.sources.tables import read_latest
from cohortloom.streaming import jobs

C = F.col
ANY_AGE = "36500 days"


def stream(spark, sf, name, files_per_batch=20):
    """The table as a file stream; its schema comes from the files."""
    schema = fx.table(spark, sf, name).schema
    reader = spark.readStream.schema(schema).option("maxFilesPerTrigger", files_per_batch)
    return reader.option("pathGlobFilter", f"{name}.parquet").parquet(sf)


def split_stream(spark, sf, name, parts, bucket):
    """The table written as ``parts`` files and read as a stream of one file per batch."""
    path = scratch_path(spark, f"{name}-stream")
    df = fx.table(spark, sf, name)
    df.repartition(parts, bucket).write.parquet(path)
    return spark.readStream.schema(df.schema).option("maxFilesPerTrigger", 1).parquet(path)


def _decode(batch):
    """Keep valid values; negative and missing ones are failures."""
    bad = C("value") < 5
    error = F.when(bad, F.concat(F.lit("ValueError: value "), C("value").cast("string")))
    return batch.select(C("event_id").alias("uid"), "ts", "user_id", "value", error.alias("error"))


@query("r01_ingest_incremental", "uid:i user_id:i value:d", "SELECT event_id AS uid, user_id, value FROM events WHERE value >= 5")
def _(spark, sf):
    out, bad, cp = (scratch_path(spark, n) for n in ("ingest", "failures", "cp"))
    jobs.ingest_incremental(split_stream(spark, sf, "events", 4, "event_id"), _decode, out, bad, cp, "uid", ["ts", "uid"])
    return read_latest(spark, out, ["uid"], ["ts", "uid"])


@query(
    "r02_upsert_latest",
    "user_id:i event_id:i value:d",
    "SELECT user_id, event_id, value FROM (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, event_id DESC) AS rn FROM events) WHERE rn = 1",
)
def _(spark, sf):
    path = scratch_path(spark, "latest")
    e = fx.table(spark, sf, "events").select("user_id", "event_id", "ts", "value")
    late, early = e.where(C("event_id") % 2 == 0), e.where(C("event_id") % 2 == 1)
    for batch in (late, early, late):
        jobs.upsert_latest(batch, path, ["user_id"], ["ts", "event_id"], compact_every=2)
    return read_latest(spark, path, ["user_id"], ["ts", "event_id"])


@query(
    "r03_failure_table",
    "uid:i error:s",
    "SELECT event_id AS uid, concat('ValueError: value ', CAST(value AS VARCHAR)) AS error FROM events WHERE value < 5 AND event_id % 3 <> 0",
)
def _(spark, sf):
    out, bad, cp = (scratch_path(spark, n) for n in ("ingest", "failures", "cp"))
    jobs.ingest_incremental(stream(spark, sf, "events"), _decode, out, bad, cp, "uid", ["ts", "uid"])
    repaired = fx.table(spark, sf, "events").where(C("event_id") % 3 == 0).withColumn("value", C("value") + 5)
    fixed = repaired.select(C("event_id").alias("uid"), "event_id", "ts", "user_id", "value")
    jobs.retry_failures(spark, fixed, _decode, out, bad, "uid", ["ts", "uid"])
    return jobs.read_failures(spark, bad, "uid")


@query(
    "r04_running_moments",
    "event_type:s n:i mean:d variance:d",
    "SELECT event_type, count(value) AS n, avg(value) AS mean, var_samp(value) AS variance FROM events GROUP BY event_type",
)
def _(spark, sf):
    path = scratch_path(spark, "twice")
    e = fx.table(spark, sf, "events")
    e.unionByName(e.where(C("event_id") % 2 == 0)).repartition(3).write.parquet(path)
    s = spark.readStream.schema(e.schema).option("maxFilesPerTrigger", 1).parquet(path)
    out = scratch_path(spark, "moments")
    # The files come in any order, so a repeat may be as old as the table is long.
    moments = jobs.running_moments(s, ["event_id"], ["event_type"], "value", "ts", ANY_AGE)
    jobs.write_updates(moments, out, scratch_path(spark, "cp"), ["event_type"])
    return jobs.read_updates(spark, out, ["event_type"])


@query(
    "r05_live_leaderboard",
    "run_key:s best:d trials:i trials_complete:i trials_running:i",
    """SELECT run_key, min(value) AS best, count(*) AS trials, count(*) FILTER (state = 'COMPLETE') AS trials_complete, count(*) FILTER (state = 'RUNNING') AS trials_running
       FROM fx_trials GROUP BY run_key""",
    "fx_trials",
)
def _(spark, sf):
    s = split_stream(spark, sf, "orders", 3, "o_orderkey").select(
        C("o_orderpriority").alias("run_key"),
        F.when(C("o_orderstatus") == "F", "COMPLETE").when(C("o_orderstatus") == "O", "RUNNING").otherwise("FAIL").alias("state"),
        (C("o_totalprice") / F.lit(1000000.0)).alias("value"),
    )
    out = scratch_path(spark, "board")
    board = jobs.live_leaderboard(s, ["run_key"], "value", "state", ["COMPLETE", "RUNNING", "FAIL"])
    jobs.write_updates(board, out, scratch_path(spark, "cp"), ["run_key"])
    return jobs.read_updates(spark, out, ["run_key"])


@query("r06_progress_heartbeat", "rows:i", "SELECT count(*) AS rows FROM events")
def _(spark, sf):
    s = split_stream(spark, sf, "events", 3, "event_id")
    out = scratch_path(spark, "sink")
    beats = scratch_path(spark, "beats")
    jobs.run_available(s, jobs.with_heartbeat(lambda b, _: b.write.mode("append").parquet(out), beats), scratch_path(spark, "cp"))
    return jobs.progress_heartbeat(spark, beats).agg(F.sum("rows").alias("rows"))


_SLIDE = """SELECT w AS start, w + INTERVAL 2 HOUR AS "end", event_type, count(*) AS n, sum(value) AS total FROM (
  SELECT event_type, value, unnest([time_bucket(INTERVAL 1 HOUR, ts), time_bucket(INTERVAL 1 HOUR, ts) - INTERVAL 1 HOUR]) AS w FROM events) GROUP BY ALL"""


@query(
    "r07_event_windows",
    "start:s event_type:s n:i total:d",
    f"SELECT strftime(start, '%Y-%m-%d %H:%M:%S') AS start, event_type, n, total FROM ({_SLIDE})",
)
def _(spark, sf):
    w = jobs.event_windows(fx.table(spark, sf, "events"), "ts", "2 hours", "1 hour", ["event_type"])
    return w.withColumn("start", F.date_format("start", "yyyy-MM-dd HH:mm:ss"))


@query(
    "r07_event_windows_stream",
    "start:s event_type:s n:i total:d",
    f"SELECT strftime(start, '%Y-%m-%d %H:%M:%S') AS start, event_type, n, total FROM ({_SLIDE})",
)
def _(spark, sf):
    w = jobs.event_windows(stream(spark, sf, "events"), "ts", "2 hours", "1 hour", ["event_type"])
    out = scratch_path(spark, "windows")
    jobs.write_updates(w, out, scratch_path(spark, "cp"), ["start", "end", "event_type"])
    return jobs.read_updates(spark, out, ["start", "end", "event_type"]).withColumn("start", F.date_format("start", "yyyy-MM-dd HH:mm:ss"))


@query(
    "r07_event_sessions",
    "user_id:i start:s n:i total:d",
    """SELECT user_id, strftime(min(ts), '%Y-%m-%d %H:%M:%S') AS start, count(*) AS n, sum(value) AS total FROM (SELECT *, sum(new) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS s FROM (
       SELECT *, CASE WHEN ts - lag(ts) OVER (PARTITION BY user_id ORDER BY ts, event_id) < INTERVAL 30 MINUTE THEN 0 ELSE 1 END AS new FROM events)) GROUP BY user_id, s""",
)
def _(spark, sf):
    s = jobs.event_sessions(fx.table(spark, sf, "events"), "ts", "30 minutes", ["user_id"])
    return s.withColumn("start", F.date_format("start", "yyyy-MM-dd HH:mm:ss"))


_SESSIONS = """SELECT user_id, min(ts) AS start, max(ts) + INTERVAL 30 MINUTE AS "end", count(*) AS n, sum(value) AS total FROM (SELECT *, sum(new) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS s FROM (
  SELECT *, CASE WHEN ts - lag(ts) OVER (PARTITION BY user_id ORDER BY ts, event_id) < INTERVAL 30 MINUTE THEN 0 ELSE 1 END AS new FROM events)) GROUP BY user_id, s"""


@query(
    "r07_event_sessions_stream",
    "user_id:i start:s n:i total:d",
    f"""SELECT user_id, strftime(start, '%Y-%m-%d %H:%M:%S') AS start, n, total FROM ({_SESSIONS})
       WHERE "end" <= (SELECT time_bucket(INTERVAL 1 MILLISECOND, max(ts)) - INTERVAL 10 MINUTE FROM events)""",
)
def _(spark, sf):
    """Sessions that the watermark (ten minutes behind the newest event) has closed."""
    sessions = jobs.event_sessions(stream(spark, sf, "events"), "ts", "30 minutes", ["user_id"])
    out = scratch_path(spark, "sessions")
    jobs.write_closed(sessions, out, scratch_path(spark, "cp"), ["user_id", "start"])
    closed = read_latest(spark, out, ["user_id", "start"], ["_batch"])
    return closed.withColumn("start", F.date_format("start", "yyyy-MM-dd HH:mm:ss"))


@query(
    "x06_stateful_welford",
    "k:s n:i mean:d m2:d4",
    "SELECT event_type AS k, count(value) AS n, avg(value) AS mean, var_pop(value) * count(value) AS m2 FROM events GROUP BY event_type",
)
def _(spark, sf):
    out = scratch_path(spark, "welford")
    w = jobs.welford(split_stream(spark, sf, "events", 3, "event_id"), "event_type", "value", "event_id")
    jobs.write_updates(w, out, scratch_path(spark, "cp"), ["k", "salt"])
    return jobs.merged_moments(jobs.read_updates(spark, out, ["k", "salt"]))
