"""Joins, sources, sinks, volumes and streams: contracts, broken input, replays."""

import gzip

import numpy as np
import pytest
from pyspark.errors import PySparkException
from pyspark.sql import functions as F

from cohortloom.operators import atlas, joins, voxel
from cohortloom.sources import nifti, tables, volumes
from cohortloom.streaming import jobs


@pytest.fixture(scope="module")
def pair(spark):
    a = spark.createDataFrame([("a", 1), ("b", 0)], "uid string, y int")
    b = spark.createDataFrame([("a", 1), ("b", 0)], "uid string, y int")
    return a, b


def test_repeated_keys_and_missing_rows_raise(spark, pair):
    a, b = pair
    twice = b.unionByName(b.where("uid = 'a'"))
    with pytest.raises(PySparkException):
        joins.join_one_to_one(a, twice.withColumnRenamed("y", "z"), ["uid"]).collect()
    with pytest.raises(PySparkException):
        joins.join_complete(a, b.where("uid = 'a'"), ["uid"], "y").collect()
    with pytest.raises(PySparkException):
        joins.join_complete(a, b.withColumn("y", 1 - F.col("y")), ["uid"], "y").collect()
    assert joins.join_complete(a, b, ["uid"], "y").count() == 2


def test_prediction_sink_contract(spark, tmp_path):
    template = spark.createDataFrame([("b", 0), ("a", 1), ("c", 2)], "uid string, pos int")
    p = spark.createDataFrame([("a", 0.0), ("b", 0.4), ("c", 1.0), ("x", 0.5)], "uid string, p double")
    path = str(tmp_path / "out")
    tables.write_predictions(p, template, path, "uid", "p", "pos")
    lines = [r for f in sorted((tmp_path / "out").glob("part-*")) for r in f.read_text().splitlines()[1:]]
    assert [line.split(",")[0] for line in lines] == ["b", "a", "c"]
    assert 0 < float(lines[1].split(",")[1]) < 1e-5
    for broken in (p.where("uid <> 'a'"), p.unionByName(p.where("uid = 'a'")), p.withColumn("p", F.when(F.col("uid") != "b", F.col("p")).otherwise(float("nan")))):
        with pytest.raises(PySparkException):
            tables.contract_predictions(broken, template, "uid", "p", "pos").collect()


def test_versions_survive_an_unfinished_write(spark, tmp_path):
    path = str(tmp_path / "t")
    tables.overwrite_table(spark.range(3), path)
    (tmp_path / "t" / "v1").mkdir()  # a write that never committed
    assert tables.read_current(spark, path).count() == 3
    tables.overwrite_table(spark.range(5), path)
    assert tables.read_current(spark, path).count() == 5


def test_tolerant_reader_names_broken_files(spark, tmp_path):
    good = tmp_path / "d"
    spark.range(10).write.parquet(str(good))
    (good / "broken.parquet").write_bytes(b"PAR1 not a file")
    rows, warnings = tables.read_tolerant(spark, str(good), "id bigint", "parquet", pathGlobFilter="*.parquet")
    assert rows.count() == 10
    assert "broken.parquet" in {r["file"] for r in warnings.collect()}


def test_nifti_orientation_and_errors(spark, tmp_path):
    v = np.arange(24, dtype="float32").reshape(2, 3, 4)
    raw = nifti.encode(v, (3.0, 2.0, 1.5))
    back, spacing, det = nifti.decode(raw)
    np.testing.assert_array_equal(back, v)
    assert spacing == (3.0, 2.0, 1.5) and det == pytest.approx(9.0)
    flipped = bytearray(raw)
    import struct

    struct.pack_into("<f", flipped, 280, -1.5)  # x runs the other way
    np.testing.assert_array_equal(nifti.decode(gzip.compress(bytes(flipped)))[0], v[:, :, ::-1])
    for bad in (raw[:100], raw[:360], b"\0" * 400):
        with pytest.raises(ValueError):
            nifti.decode(bad)
    (tmp_path / "Scan1.nii").write_bytes(raw)
    (tmp_path / "scan2.nii.gz").write_bytes(gzip.compress(raw))
    (tmp_path / "scan3.nii").write_bytes(raw[:360])
    s = volumes.scan_volumes(spark, str(tmp_path))
    assert {r["uid"] for r in volumes.failures(s).collect()} == {"scan3"}
    assert volumes.explode_slices(s).groupBy("uid").count().collect()[0]["count"] == 24
    assert {r["uid"] for r in volumes.volume_inventory(spark, str(tmp_path)).collect()} == {"Scan1", "scan2", "scan3"}


def _grid(spark, volume, mask=None):
    rows = [(1, int(z), int(y), int(x), float(volume[z, y, x]), bool(mask[z, y, x]) if mask is not None else True) for z, y, x in np.ndindex(volume.shape)]
    return spark.createDataFrame(rows, "uid int, z int, y_ int, x int, v double, m boolean")


def test_morphology_matches_numpy(spark):
    rng = np.random.default_rng(0)
    m = rng.random((5, 6, 7)) < 0.3
    df = _grid(spark, m.astype(float), m)

    def step(a, grow):
        p = np.pad(a, 1, constant_values=False)
        parts = [p[1 + dz : 1 + dz + a.shape[0], 1 + dy : 1 + dy + a.shape[1], 1 + dx : 1 + dx + a.shape[2]]
                 for dz, dy, dx in ((0, 0, 0), (1, 0, 0), (-1, 0, 0), (0, 1, 0), (0, -1, 0), (0, 0, 1), (0, 0, -1))]
        return np.any(parts, axis=0) if grow else np.all(parts, axis=0)

    def read(d, c):
        out = np.zeros(m.shape, bool)
        for r in d.collect():
            out[r["z"], r["y_"], r["x"]] = r[c]
        return out

    np.testing.assert_array_equal(read(voxel.dilate(df, "m", "o", 2), "o"), step(step(m, True), True))
    np.testing.assert_array_equal(read(voxel.erode(df, "m", "o", 1), "o"), step(m, False))
    np.testing.assert_array_equal(read(voxel.closing(df, "m", "o", 1), "o"), step(step(m, True), False))
    shell = np.zeros((5, 5, 5), bool)
    shell[1:4, 1:4, 1:4] = True
    shell[2, 2, 2] = False
    filled = read(atlas.fill_holes(_grid(spark, shell.astype(float), shell), "m", "o"), "o")[: 5, : 5, : 5]
    assert filled[2, 2, 2] and filled.sum() == 27
    two = np.zeros((5, 5, 5), bool)
    two[0, 0, :4], two[4, 4, :2] = True, True
    big = atlas.largest_component(_grid(spark, two.astype(float), two), "m", "o")
    assert sum(r["o"] for r in big.collect()) == 4


def test_self_normalisation_is_scale_free(spark):
    v = np.random.default_rng(1).random((3, 3, 3))
    a = voxel.self_normalize(_grid(spark, v)).orderBy("z", "y_", "x").toPandas()["s"]
    b = voxel.self_normalize(_grid(spark, v * 7)).orderBy("z", "y_", "x").toPandas()["s"]
    np.testing.assert_allclose(a, b, rtol=1e-12)
    assert (a**2).sum() == pytest.approx(27)


def test_graph_adjacency_is_symmetric():
    edges = {(a, b): w for a, b, w in atlas.graph_edge_list()}
    assert all(edges[(b, a)] == w for (a, b), w in edges.items()) and {a for a, _ in edges} == set(range(12))


def test_atlas_without_a_required_region_raises(spark):
    df = spark.createDataFrame([(1, 0, 0, 0, 1)], "uid int, z int, y_ int, x int, label int")
    with pytest.raises(PySparkException):
        atlas.label_masks(df, {1: "right", 2: "left"}, ["right", "left"]).collect()


def test_replayed_batches_change_nothing(spark, tmp_path):
    path = str(tmp_path / "latest")
    batch = spark.createDataFrame([("a", 1, 10), ("b", 1, 20), ("a", 2, 30)], "k string, t int, v int")
    jobs.upsert_latest(batch, path, ["k"], ["t"])
    once = sorted(tables.read_latest(spark, path, ["k"], ["t"]).collect())
    jobs.upsert_latest(batch, path, ["k"], ["t"], compact_every=2)
    assert sorted(tables.read_latest(spark, path, ["k"], ["t"]).collect()) == once == [("a", 2, 30), ("b", 1, 20)]
    assert tables._versions(spark, path) == [0]


def test_two_writers_lose_no_row(spark, tmp_path):
    """Writers that have read the same state of the table commit one after the other, in any order."""
    path = str(tmp_path / "shared")
    rows = lambda *r: spark.createDataFrame(list(r), "k string, t int")
    tables.overwrite_table(rows(("a", 1)), path)
    seen = tables.commits(spark, path)
    tables._commit(rows(("b", 1)), path, "delta", seen)
    tables._commit(rows(("c", 1)), path, "delta", seen)
    both = tables.commits(spark, path)
    merged = tables._rows_of(spark, path, both, ["k"], ["t"])
    tables._commit(rows(("d", 1)), path, "delta", seen)
    tables._commit(merged, path, "compact", both)
    tables._commit(tables._rows_of(spark, path, seen, ["k"], ["t"]), path, "compact", seen)
    keys = lambda: sorted(r["k"] for r in tables.read_latest(spark, path, ["k"], ["t"]).collect())
    assert keys() == ["a", "b", "c", "d"]
    tables.compact(spark, path, ["k"], ["t"])
    assert keys() == ["a", "b", "c", "d"]
    assert tables.drop_old(spark, path) > 0
    assert keys() == ["a", "b", "c", "d"] and len(tables.commits(spark, path)) == 1
    assert tables.drop_old(spark, path) == 0


def test_a_replacement_outlives_a_compaction_of_the_version_before(spark, tmp_path, monkeypatch):
    path = str(tmp_path / "replaced")
    rows = lambda *r: spark.createDataFrame(list(r), "k string, t int")
    tables.overwrite_table(rows(("old", 1)), path)
    tables.append_delta(rows(("old too", 1)), path)
    seen = tables.commits(spark, path)
    tables._enter(spark, path, "zzz", seen[0]["data"], "compact", 1, [e["name"] for e in seen if e["kind"] == "delta"])
    monkeypatch.setattr(tables, "commits", lambda s, p, real=tables.commits, stale=[seen]: stale.pop() if stale else real(s, p))
    tables.overwrite_table(rows(("new", 2)), path)
    assert [r["k"] for r in tables.read_current(spark, path).collect()] == ["new"]
    assert [r["k"] for r in tables.read_latest(spark, path, ["k"], ["t"]).collect()] == ["new"]


def test_replayed_failures_bring_nothing_back(spark, tmp_path):
    path = str(tmp_path / "failures")
    good = spark.createDataFrame([("a",)], "k string")
    bad = spark.createDataFrame([("a", "broken"), ("b", "broken")], "k string, error string")
    none, no_bad = good.limit(0), bad.limit(0)
    jobs.failure_table(none, bad, path, "k", 0)
    jobs.failure_table(good, no_bad, path, "k", 0, 1)
    jobs.failure_table(none, bad, path, "k", 0)
    assert [r["k"] for r in jobs.read_failures(spark, path, "k").collect()] == ["b"]
    jobs.failure_table(none, bad, path, "k", 1)
    assert sorted(r["k"] for r in jobs.read_failures(spark, path, "k").collect()) == ["a", "b"]


def test_late_rows_are_dropped_and_state_shrinks(spark, tmp_path):
    src, out, cp = (str(tmp_path / n) for n in ("in", "out", "cp"))
    schema = "id int, ts timestamp, k string, v double"
    stream = lambda: spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(src)
    moments = lambda: jobs.running_moments(stream(), ["id"], ["k"], "v", "ts", "1 hour")

    def run(*rows):
        rows = [(i, f"2024-01-01 {t}", k, v) for i, t, k, v in rows]
        df = spark.createDataFrame(rows, "id int, ts string, k string, v double").withColumn("ts", F.to_timestamp("ts"))
        df.coalesce(1).write.mode("append").parquet(src)
        query = jobs.write_updates(moments(), out, cp, ["k"])
        held = [s["numRowsTotal"] for s in query.lastProgress["stateOperators"] if "edup" in s["operatorName"]]
        return {r["k"]: (r["n"], r["mean"]) for r in jobs.read_updates(spark, out, ["k"]).collect()}, held[0]

    got, held = run((1, "00:00:00", "a", 1.0), (2, "00:10:00", "a", 3.0), (2, "00:10:00", "a", 3.0), (3, "00:20:00", "b", 5.0))
    assert got == {"a": (2, 2.0), "b": (1, 5.0)} and held == 3
    got, held = run((4, "05:00:00", "b", 7.0))
    assert got == {"a": (2, 2.0), "b": (2, 6.0)}
    assert held == 1
    got, _ = run((5, "00:30:00", "a", 99.0), (6, "05:05:00", "a", 5.0))
    assert got == {"a": (3, 3.0), "b": (2, 6.0)}


def test_ingest_processes_new_files_once_and_clears_failures(spark, tmp_path):
    src, out, bad, cp = (str(tmp_path / n) for n in ("in", "out", "bad", "cp"))
    schema = "uid string, v double"
    process = lambda b: b.withColumn("error", F.when(F.col("v") < 0, F.lit("negative")))
    stream = lambda: spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(src)
    spark.createDataFrame([("a", 1.0), ("b", -1.0)], schema).coalesce(1).write.parquet(src)
    jobs.ingest_incremental(stream(), process, out, bad, cp, "uid", ["v"])
    assert [r["uid"] for r in jobs.read_failures(spark, bad, "uid").collect()] == ["b"]
    before = tables._deltas(spark, out)
    jobs.ingest_incremental(stream(), process, out, bad, cp, "uid", ["v"])
    assert tables._deltas(spark, out) == before
    spark.createDataFrame([("b", 2.0)], schema).coalesce(1).write.mode("append").parquet(src)
    jobs.ingest_incremental(stream(), process, out, bad, cp, "uid", ["v"])
    assert jobs.read_failures(spark, bad, "uid").count() == 0
    assert {r["uid"] for r in tables.read_latest(spark, out, ["uid"], ["v"]).collect()} == {"a", "b"}


def test_equal_file_names_in_two_folders_are_two_files(spark, tmp_path):
    for run, text in (("a", "id\n1\n"), ("b", "id\n")):
        (tmp_path / run).mkdir()
        (tmp_path / run / "history.csv").write_text(text)
    rows, warnings = tables.read_tolerant(spark, str(tmp_path), "id bigint", "csv", header="true")
    assert [r["id"] for r in rows.collect()] == [1]
    assert [(r["file"], r["warning"]) for r in warnings.collect()] == [("b/history.csv", "no readable row")]
    before = tables.fingerprint_inputs(spark, str(tmp_path), "*.csv", content=True).first()["fingerprint"]
    (tmp_path / "b").rename(tmp_path / "c")
    assert tables.fingerprint_inputs(spark, str(tmp_path), "*.csv", content=True).first()["fingerprint"] != before


def test_failed_trials_keep_their_text_and_bugs_end_the_search(spark):
    from cohortloom.operators import models

    df = spark.createDataFrame([(1, 0, 0)], "uid int, y int, fold int")

    def unfit(p, n):
        raise ValueError("no such penalty")

    def bug(p, n):
        raise KeyError("typo")

    row = models.random_search(df, "s", {"c": [1.0]}, unfit, 1, "uid", "y", "fold", [0]).first()
    assert row["state"] == "FAIL" and "no such penalty" in row["params_json"]
    with pytest.raises(KeyError):
        models.random_search(df, "s", {"c": [1.0]}, bug, 1, "uid", "y", "fold", [0])


def test_partition_map_bounds_a_frame_by_bytes(spark):
    import pandas as pd

    from cohortloom.functions import hooks

    texts = spark.range(0, 600, 1, 1).selectExpr("id", "repeat('word ', 10000) AS text")  # 30 MB in one partition

    def sizes(frames):
        for f in frames:
            yield pd.DataFrame({"id": f["id"], "held": len(f)})

    got = hooks.partition_map(texts, sizes, "id long, held long").collect()
    assert sorted(r["id"] for r in got) == list(range(600))
    assert max(r["held"] for r in got) * 50000 <= hooks.BATCH_BYTES
