"""Source and sink queries: tables derived from the given ones are written to the shared folder and read back."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import functions as F

from cohortloom.functions.scalar import json_map
from cohortloom.plans import fixtures as fx
from cohortloom.registry import query
from cohortloom.session import scratch_path
from cohortloom.sources import nifti
from cohortloom.sources import tables as t
from cohortloom.sources import volumes as vol

C = F.col


@query("s01_read_keyed_table", "uid:s y:i f1:d f2:d", "SELECT uid, y, f1, f2 FROM fx_cohort", "fx_cohort")
def _(spark, sf):
    path = scratch_path(spark, "cohort-csv")
    fx.cohort(spark, sf).select("uid", "y", "f1", "f2").write.option("header", "true").csv(path)
    return t.read_keyed_table(spark, path, "uid", "uid string, y int, f1 double, f2 double")


@query(
    "s02_parse_json_map",
    "event_id:i k:s size:i",
    """SELECT event_id, CASE WHEN event_id % 4 < 2 THEN json_extract_string(props, '$.k') END AS k, CASE WHEN event_id % 4 < 2 THEN len(json_keys(props)) ELSE 0 END AS size FROM events""",
)
def _(spark, sf):
    text = F.when(C("event_id") % 4 == 2, "not json").when(C("event_id") % 4 == 3, "[1, 2]").otherwise(C("props"))
    e = fx.table(spark, sf, "events").select("event_id", json_map(text).alias("m"))
    return e.select("event_id", F.try_element_at("m", F.lit("k")).alias("k"), F.size("m").alias("size"))


@query("s03_volume_inventory", "uid:s has_bytes:b")
def _(spark, sf):
    return vol.volume_inventory(spark, sf, "*.parquet").select("uid", (C("length") > 0).alias("has_bytes"))


def _encoded(spark, sf):
    """Every vector as the bytes of a 4 x 4 x 4 NIfTI file; every seventh file is cut short."""

    def run(batches):
        for pdf in batches:
            out = []
            for uid, values in zip(pdf["uid"], pdf["embedding"]):
                content = nifti.encode(np.array(values, dtype=float).reshape(4, 4, 4), (2.5, 2.0, 3.0))
                out.append((uid, content[:400] if int(uid) % 7 == 0 else content))
            yield pd.DataFrame(out, columns=["uid", "content"])

    e = fx.table(spark, sf, "embeddings").select(C("vec_id").cast("string").alias("uid"), "embedding")
    return e.mapInPandas(run, "uid string, content binary")


@query(
    "s04_scan_volumes",
    "uid:s z:i y_:i x:i v:d",
    "SELECT CAST(uid AS VARCHAR) AS uid, z, y_, x, v FROM fx_voxels WHERE uid % 7 <> 0",
    "fx_voxels",
)
def _(spark, sf):
    return vol.explode_slices(vol.decode_volumes(_encoded(spark, sf)))


@query(
    "s04_scan_failures",
    "uid:s error:s",
    "SELECT CAST(vec_id AS VARCHAR) AS uid, 'ValueError: voxel data is truncated' AS error FROM embeddings WHERE vec_id % 7 = 0",
)
def _(spark, sf):
    return vol.failures(vol.decode_volumes(_encoded(spark, sf)))


@query("s05_read_volume_table", "uid:i z:i y_:i x:i v:d m:b grp:i", "SELECT uid, z, y_, x, v, m, grp FROM fx_voxels", "fx_voxels")
def _(spark, sf):
    path = scratch_path(spark, "volumes")
    slices = vol.pack_slices(fx.voxels(spark, sf), ["grp"]).withColumn("run", (C("grp") % 3).cast("string"))
    vol.write_volume_table(slices, path)
    return vol.explode_slices(vol.read_volume_table(spark, path), ["grp"])


@query(
    "s06_write_volume_table",
    "run:s slices:i scans:i voxels:i",
    "SELECT CAST(grp % 3 AS VARCHAR) AS run, count(*) // 16 AS slices, count(DISTINCT uid) AS scans, count(*) AS voxels FROM fx_voxels GROUP BY 1",
    "fx_voxels",
)
def _(spark, sf):
    path = scratch_path(spark, "volumes")
    slices = vol.pack_slices(fx.voxels(spark, sf), ["grp"]).withColumn("run", (C("grp") % 3).cast("string"))
    vol.write_volume_table(slices, path)
    per_scan = vol.read_volume_table(spark, path).groupBy("run", "uid").agg(F.count(F.lit(1)).alias("s"), F.sum(F.size("values")).alias("v"))
    return per_scan.groupBy("run").agg(F.sum("s").alias("slices"), F.count(F.lit(1)).alias("scans"), F.sum("v").alias("voxels"))


@query("s07_discover_runs", "run:s has_files:b has_store:b", "SELECT DISTINCT run_key AS run, true AS has_files, true AS has_store FROM fx_trials", "fx_trials")
def _(spark, sf):
    path = scratch_path(spark, "runs")
    trials = fx.trials(spark, sf).select("run_key", "study", "number", "value")
    trials.repartition("run_key").write.partitionBy("run_key").parquet(path)
    return t.discover_runs(spark, path, r"run_key=([^/]+)/").select("run", (C("files") > 0).alias("has_files"), "has_store")


@query(
    "s08_read_history_logs",
    "phase:s fold:i trajectory:i epoch:i train_loss:d valid_loss:d",
    "SELECT run_key AS phase, trajectory % 5 AS fold, trajectory, epoch, train_loss, valid_loss FROM fx_histories",
    "fx_histories",
)
def _(spark, sf):
    path = scratch_path(spark, "histories")
    h = fx.histories(spark, sf).select(C("run_key").alias("phase"), (C("trajectory") % 5).alias("fold"), "trajectory", "epoch", "train_loss", "valid_loss")
    h.repartition("phase", "fold").write.partitionBy("phase", "fold").option("header", "true").csv(path)
    schema = "trajectory bigint, epoch bigint, train_loss double, valid_loss double"
    return t.read_history_logs(spark, path, schema, {"phase": r"phase=([^/]+)/", "fold": r"fold=([^/]+)/"})


@query(
    "s09_read_trial_log",
    "study:s number:i state:s value:d depth:s",
    "SELECT study, number, state, value, json_extract_string(params_json, '$.depth') AS depth FROM fx_trials",
    "fx_trials",
)
def _(spark, sf):
    x = fx.trials(spark, sf)
    old, new = scratch_path(spark, "trials-old"), scratch_path(spark, "trials-new")
    even = C("number") % 2 == 0
    x.where(even).select(
        C("study").alias("study_name"), C("number").alias("trial"), F.lower("state").alias("state"), C("value").alias("objective_log_loss"), C("params_json").alias("parameters")
    ).write.json(old)
    x.where(~even).select("study", "number", "state", "value", "params_json").write.json(new)
    r = t.read_trial_log(spark, [old, new])
    return r.select("study", "number", "state", "value", F.try_element_at("params", F.lit("depth")).alias("depth"))


def _messy(spark, sf):
    """CSV lines of events in which every tenth line is malformed, plus a file without a line."""
    path = scratch_path(spark, "messy")
    e = fx.table(spark, sf, "events")
    line = F.when(C("event_id") % 10 == 0, F.concat(F.lit("x"), C("event_id").cast("string"))).otherwise(
        F.concat_ws(",", C("event_id").cast("string"), C("value").cast("string"))
    )
    e.select(line.alias("value")).write.text(path)
    return t.read_tolerant(spark, path, "event_id bigint, value double", pathGlobFilter="*.txt")


@query("s10_read_tolerant", "event_id:i value:d", "SELECT event_id, value FROM events WHERE event_id % 10 <> 0")
def _(spark, sf):
    return _messy(spark, sf)[0]


@query("s10_read_warnings", "bad:i", "SELECT count(*) AS bad FROM events WHERE event_id % 10 = 0")
def _(spark, sf):
    w = _messy(spark, sf)[1]
    return w.agg(F.sum(F.regexp_extract("warning", r"^(\d+) malformed", 1).try_cast("bigint")).alias("bad"))


@query("s11_overwrite_table", "doc_id:i n_chars:i", "SELECT doc_id, n_chars + 1 AS n_chars FROM documents")
def _(spark, sf):
    path = scratch_path(spark, "versions")
    d = fx.table(spark, sf, "documents").select("doc_id", "n_chars")
    t.overwrite_table(d, path)
    t.overwrite_table(t.read_current(spark, path).withColumn("n_chars", C("n_chars") + 1), path)
    return t.read_current(spark, path)


@query(
    "s12_export_snapshot",
    "table:s rows:i",
    "SELECT 'trials' AS \"table\", count(*) AS rows FROM fx_trials UNION ALL SELECT 'histories', count(*) FROM fx_histories UNION ALL SELECT 'predictions', count(*) FROM fx_predictions",
    "fx_trials fx_histories fx_predictions",
)
def _(spark, sf):
    named = {"trials": fx.trials(spark, sf), "histories": fx.histories(spark, sf), "predictions": fx.predictions(spark, sf)}
    return t.export_snapshot(named, scratch_path(spark, "snapshot"))


@query(
    "s13_write_predictions",
    "uid:s prob:d",
    "SELECT uid, greatest(least(m_a * 1.2 - 0.1, CAST(0.999999 AS DOUBLE)), CAST(0.000001 AS DOUBLE)) AS prob FROM fx_wide WHERE CAST(uid AS INT) % 2 = 0",
    "fx_wide",
)
def _(spark, sf):
    p = fx.predictions(spark, sf).where(C("model") == "m_a").select("uid", (C("prob") * 1.2 - 0.1).alias("prob"))
    template = fx.table(spark, sf, "labels").where(C("doc_id") % 2 == 0).select(C("doc_id").cast("string").alias("uid"), (-C("doc_id")).alias("pos"))
    path = scratch_path(spark, "submission")
    t.write_predictions(p, template, path, "uid", "prob", "pos")
    return t.read_keyed_table(spark, path, "uid", "uid string, prob double")


@query("s14_read_oof_bundle", "model:s uid:s y:i prob:d", "SELECT model, uid, y, prob FROM fx_predictions", "fx_predictions")
def _(spark, sf):
    p, paths = fx.predictions(spark, sf), {}
    for m in ("m_a", "m_b", "m_c"):
        paths[m] = scratch_path(spark, f"oof-{m}")
        p.where(C("model") == m).select("uid", "y", "prob").write.parquet(paths[m])
    return t.read_oof_bundle(spark, paths, "uid", "y", "prob")


@query("s15_fingerprint_inputs", "n:i fingerprint:s")
def _(spark, sf):
    return t.fingerprint_inputs(spark, sf, "*.parquet")
