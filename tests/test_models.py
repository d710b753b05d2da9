"""Calibration, folds, neighbours and models: invariants and brute-force comparisons."""

import numpy as np
import pandas as pd
import pytest
from pyspark.errors import PySparkException
from pyspark.sql import functions as F

from cohortloom.operators import calibrate, folds, metrics, models, neighbors, prep, resample


def _loss(y, z):
    return float(np.mean(np.logaddexp(0, z) - y * z))


@pytest.fixture(scope="module")
def scores(spark):
    rng = np.random.default_rng(3)
    n = 300
    y = rng.integers(0, 2, n)
    p = 1 / (1 + np.exp(-(2.5 * (y - 0.5) + rng.normal(size=n)) * 1.7 - 0.4))
    frame = pd.DataFrame({"uid": np.arange(n), "y": y, "p": np.clip(p, 1e-4, 1 - 1e-4), "fold": np.arange(n) % 3, "m": np.where(np.arange(n) % 2, "a", "b")})
    return frame, spark.createDataFrame(frame)


def test_temperature_is_the_best_on_a_grid(scores):
    frame, df = scores
    got = {r["m"]: r["w0"] for r in calibrate.fit(df, ["m"], "y", "p").collect()}
    for m, part in frame.groupby("m"):
        z, y = np.log(part["p"] / (1 - part["p"])).to_numpy(), part["y"].to_numpy()
        grid = min(_loss(y, b * z) for b in np.linspace(0.05, 20, 8001))
        assert _loss(y, got[m] * z) <= grid + 1e-9
        assert _loss(y, got[m] * z) <= _loss(y, z) + 1e-12


def test_temperature_bounds_and_zero_logits(spark):
    rows = [("zero", 0.0, i % 2) for i in range(20)] + [("sure", 3.0 if i % 2 else -3.0, i % 2) for i in range(20)]
    df = spark.createDataFrame(rows, "m string, z double, y int")
    got = {r["m"]: r["temperature"] for r in calibrate.fit_temperature(df, ["m"], "y", "z").collect()}
    assert got["zero"] == 1.0
    assert got["sure"] == pytest.approx(1 / 20)


@pytest.mark.parametrize("method", ["platt", "beta"])
def test_ridge_maps_are_stationary_or_at_a_bound(scores, method):
    frame, df = scores
    row = calibrate.fit(df, [], "y", "p", method).first()
    w = np.array([row[f"w{i}"] for i in range(len(calibrate.ANCHORS[method]))])
    p, y = frame["p"].to_numpy(), frame["y"].to_numpy()
    x = np.column_stack([np.log(p / (1 - p)), np.ones(len(p))] if method == "platt" else [np.log(p), -np.log1p(-p), np.ones(len(p))])
    s = 1 / (1 + np.exp(-x @ w))
    grad = x.T @ (s - y) / len(y) + 2 * calibrate.RIDGE * (w - np.array(calibrate.ANCHORS[method]))
    for g, v, (lo, hi) in zip(grad, w, calibrate.BOUNDS[method]):
        assert abs(g) < 1e-7 or (v <= lo + 1e-9 and g > 0) or (v >= hi - 1e-9 and g < 0)


def test_crossfit_uses_the_other_folds(scores):
    frame, df = scores
    out = calibrate.crossfit_calibrate(df, [], "y", "p", "fold").toPandas().sort_values("uid")
    held = out["fold"] == 1
    train = df.where("fold <> 1")
    w = calibrate.fit(train, [], "y", "p").first()["w0"]
    z = np.log(out.loc[held, "p"] / (1 - out.loc[held, "p"]))
    np.testing.assert_allclose(out.loc[held, "calibrated"], 1 / (1 + np.exp(-w * z)), rtol=1e-7)


def test_auc_with_ties_and_one_class(spark):
    df = spark.createDataFrame([("a", 1, 0.5), ("a", 0, 0.5), ("a", 1, 0.9), ("b", 1, 0.2)], "g string, y int, p double")
    m = {r["g"]: r for r in metrics.binary_metrics(df, ["g"], "y", "p").collect()}
    assert m["a"]["auc"] == pytest.approx(0.75)
    assert m["b"]["auc"] is None and m["b"]["balanced_accuracy"] == 0.0


def test_bootstrap_interval_covers_the_mean(spark):
    df = spark.range(400).withColumn("v", (F.col("id") % 7).cast("double"))
    r = resample.bootstrap_mean_ci(df, [], "id", "v", 300, 1).first()
    assert r["ci_low"] < r["mean"] < r["ci_high"] and r["ci_high"] - r["ci_low"] < 1.0


def test_folds_balance_and_group_disjointness(spark):
    df = spark.range(101).select(F.col("id").alias("uid"), (F.col("id") % 3 == 0).cast("int").alias("y"), (F.col("id") % 20).alias("g"), (F.col("id") % 5 > 0).alias("ok"))
    s = folds.stratified_folds(df, 5, 1, "uid", "y")
    sizes = [r["count"] for r in s.groupBy("fold").count().collect()]
    assert len(sizes) == 5 and max(sizes) - min(sizes) <= 1
    g = folds.best_fold_assignment(df, 4, 0, "g", "y", "ok", 64)
    assert g.groupBy("g").agg(F.countDistinct("fold").alias("n")).where("n > 1").isEmpty()
    folds.check_folds(g, df, 4, "uid", "y", "g", "fold")
    with pytest.raises(ValueError):
        folds.check_folds(g.withColumn("y", 1 - F.col("y")), df, 4, "uid", "y", "g", "fold")


def test_frozen_folds_are_reused_and_guarded(spark, tmp_path):
    df = spark.range(40).select(F.col("id").cast("string").alias("uid"), (F.col("id") % 2).cast("int").alias("y"))
    build = lambda d: folds.stratified_folds(d, 4, 2, "uid", "y")
    a = folds.freeze_folds(df, str(tmp_path / "f"), build, ["uid", "y"]).collect()
    b = folds.freeze_folds(df.repartition(3), str(tmp_path / "f"), lambda d: 1 / 0, ["uid", "y"]).collect()
    assert sorted(a) == sorted(b)
    with pytest.raises(ValueError):
        folds.freeze_folds(df.where("uid <> '3'"), str(tmp_path / "f"), build, ["uid", "y"])


def _brute(ids, x, k):
    d = np.sqrt(((x[:, None, :] - x[None, :, :]) ** 2).sum(axis=2))
    out = set()
    for i, uid in enumerate(ids):
        others = [j for j in np.lexsort((ids, d[i])) if j != i][:k]
        out |= {(int(uid), r + 1, int(ids[j])) for r, j in enumerate(others)}
    return out


@pytest.mark.parametrize("copies", [False, True])
def test_knn_equals_brute_force_across_many_blocks(spark, monkeypatch, copies):
    monkeypatch.setattr(neighbors, "BLOCK", 16)
    monkeypatch.setattr(neighbors, "VISITORS", 8)
    rng = np.random.default_rng(9)
    x = rng.normal(size=(400, 3))
    if copies:
        x[rng.random(400) < 0.35] = x[0]
        x[100:140] = np.round(x[100:140], 0)
    ids = rng.permutation(1000)[:400]
    df = spark.createDataFrame([(int(i), [float(v) for v in row]) for i, row in zip(ids, x)], "uid long, v array<double>")
    got = {(r["uid"], r["rank"], r["neighbor"]) for r in neighbors.knn(df, "uid", "v", 4).collect()}
    assert got == _brute(ids, x, 4)


def test_isolation_forest_ranks_an_outlier_first(spark):
    rng = np.random.default_rng(2)
    x = rng.normal(size=(300, 3))
    x[7] = [12, -12, 12]
    df = spark.createDataFrame([(i, *map(float, r)) for i, r in enumerate(x)], "uid int, a double, b double, c double")
    s = models.isolation_forest(df, "uid", ["a", "b", "c"], trees=40, sub=64, seed=1)
    top = s.orderBy(F.col("isolation_score").desc()).first()
    assert top["uid"] == 7 and 0.5 < top["isolation_score"] <= 1.0


def test_oof_predictions_resume_and_do_not_leak(spark, tmp_path):
    df = spark.range(60).select(F.col("id").alias("uid"), (F.col("id") % 2).cast("int").alias("y"), ((F.col("id") % 2) + F.rand(1) * 0.5).alias("x"), (F.col("id") % 3).cast("int").alias("fold"))
    path = str(tmp_path / "oof")
    build = lambda n: models.train_logistic(["x"], "y", 1.0, 0.0, n)
    first = models.oof_predict(df, "m", build, "uid", "y", "fold", range(3), path).collect()

    def refuse(n):
        raise AssertionError("a finished fold was fitted again")

    again = models.oof_predict(df, "m", refuse, "uid", "y", "fold", range(3), path).collect()
    assert sorted(first) == sorted(again) and len(first) == 60


def test_diffusion_coordinates_keep_the_order_of_a_chain(spark):
    df = spark.range(80).select(F.col("id").alias("uid"), (F.col("id") / 10.0).alias("a"))
    d = models.diffusion_map(df, "uid", ["a"], 1).orderBy("uid").toPandas()["d1"].to_numpy()
    assert (np.diff(d) > 0).all() or (np.diff(d) < 0).all()


def dense_modes(x, k):
    """(values, coordinates, kernel width) of the neighbour graph by a full eigendecomposition; rows are in key order."""
    d = np.sqrt(((x[:, None] - x[None, :]) ** 2).sum(axis=2))
    near = np.argsort(d + np.eye(len(x)) * 1e9, axis=1, kind="stable")[:, :k]
    width = np.median(np.take_along_axis(d, near, axis=1))
    w = np.zeros_like(d)
    np.put_along_axis(w, near, np.exp(-((np.take_along_axis(d, near, axis=1) / width) ** 2)), axis=1)
    w = np.maximum(w, w.T)
    degree = w.sum(axis=1)
    values, vectors = np.linalg.eigh(w / np.sqrt(degree[:, None] * degree[None, :]))
    flat = np.sqrt(degree / degree.sum())
    return values[::-1], vectors[:, ::-1] / flat[:, None], width


def test_diffusion_map_of_clusters_matches_full_eigendecomposition_and_extends(spark):
    rng = np.random.default_rng(8)
    centers = np.array([[0, 0, 0], [3, 0, 1], [0, 3, -1]])
    x = np.concatenate([c + rng.normal(scale=1.0, size=(40, 3)) for c in centers])
    table = lambda rows, first: spark.createDataFrame([(first + i, *map(float, r)) for i, r in enumerate(rows)], "uid int, a double, b double, c double")
    model = models.DiffusionMap("uid", ["a", "b", "c"], 3, 10, tolerance=1e-7).fit(table(x, 0))
    values, psi, width = dense_modes(x, 10)
    np.testing.assert_allclose(model.values, values[1:4], atol=1e-8)
    assert model.residuals.max() < 1e-7
    got = model.coordinates(1.0).orderBy("uid").toPandas()[["d1", "d2", "d3"]].to_numpy()
    want = psi[:, 1:4] * np.where((psi[:, 1:4] ** 3).sum(axis=0) < 0, -1, 1)
    np.testing.assert_allclose(got, want * values[1:4], atol=1e-4)
    new = np.concatenate([c + rng.normal(scale=1.0, size=(5, 3)) for c in centers])
    d = np.sqrt(((new[:, None] - x[None, :]) ** 2).sum(axis=2))
    near = np.argsort(d, axis=1, kind="stable")[:, :10]
    w = np.exp(-((np.take_along_axis(d, near, axis=1) / width) ** 2))
    extended = (w[:, :, None] * want[near]).sum(axis=1) / w.sum(axis=1, keepdims=True)
    held_out = model.transform(table(new, 1000), 1.0).orderBy("uid").toPandas()[["d1", "d2", "d3"]].to_numpy()
    np.testing.assert_allclose(held_out, extended, atol=1e-4)
    with pytest.raises(RuntimeError, match="converged"):
        models.DiffusionMap("uid", ["a", "b", "c"], 3, 10, tolerance=1e-12, most_rounds=1).fit(table(x, 0))


def test_diffusion_map_over_many_parts_keeps_edges_with_the_rows_that_list_them(spark, monkeypatch):
    from cohortloom.operators import neighbors

    monkeypatch.setattr(models, "PART_ROWS", 25)
    rng = np.random.default_rng(5)
    # Copies in the middle make hubs: most rows list the same smallest keys.
    x = np.concatenate([rng.normal(size=(100, 8)), np.zeros((40, 8))])
    cols = [f"x{i}" for i in range(8)]
    df = spark.createDataFrame([(f"k{i:03d}", *map(float, r)) for i, r in enumerate(x)], "uid string, " + ", ".join(f"{c} double" for c in cols))
    packed, _ = models._neighbour_graph(df.select("uid", F.array(*cols).alias("_x")), "uid", "_x", 6)
    parts = [models._Part(r["graph"]) for r in packed.collect()]
    assert len(parts) > 4 and sum(p.n for p in parts) == 140 and all(p.n <= 50 and np.bincount(p.source).max() <= 6 for p in parts)
    # In 8 dimensions blocks of vectors meet; no vector is sent to each leaf.
    monkeypatch.setattr(neighbors, "_visit", None)
    model = models.DiffusionMap("uid", cols, 2, 6, tolerance=1e-7).fit(df)
    values, psi, _ = dense_modes(x, 6)
    np.testing.assert_allclose(model.values, values[1:3], atol=1e-8)
    got = model.coordinates(0.0).orderBy("uid").toPandas()[["d1", "d2"]].to_numpy()
    np.testing.assert_allclose(got, psi[:, 1:3] * np.where((psi[:, 1:3] ** 3).sum(axis=0) < 0, -1, 1), atol=1e-4)


def test_nearest_of_another_table_matches_brute_force(spark):
    from cohortloom.operators.neighbors import knn, nearest_of

    rng = np.random.default_rng(3)
    x = np.round(rng.normal(size=(900, 2)) * np.repeat([1.0, 0.05, 5.0], 300)[:, None], 2)
    base = spark.createDataFrame([(i, r.tolist()) for i, r in enumerate(x)], "uid int, v array<double>")
    q = np.round(rng.normal(size=(60, 2)) * 3, 2)
    asked = spark.createDataFrame([(5000 + i, r.tolist()) for i, r in enumerate(q)], "uid int, v array<double>")
    got = {(r.uid, r["rank"]): r.neighbor for r in nearest_of(asked, base, "uid", "v", 7).collect()}
    d = np.sqrt(((q[:, None] - x[None, :]) ** 2).sum(axis=2))
    want = {(5000 + i, n + 1): int(j) for i, row in enumerate(d) for n, j in enumerate(np.lexsort((np.arange(900), row))[:7])}
    assert got == want
    own = {(r.uid, r["rank"]): r.neighbor for r in knn(base, "uid", "v", 4).collect()}
    d = np.sqrt(((x[:, None] - x[None, :]) ** 2).sum(axis=2))
    np.fill_diagonal(d, np.inf)
    assert own == {(i, n + 1): int(j) for i, row in enumerate(d) for n, j in enumerate(np.lexsort((np.arange(900), row))[:4])}


def test_pruning_keeps_the_first_of_correlated_columns(spark):
    df = spark.range(100).select("id", F.rand(1).alias("a"), F.rand(2).alias("b")).withColumn("c", F.exp("a")).withColumn("d", -F.col("b"))
    kept, dropped = prep.prune_correlated(df.persist(), ["a", "b", "c", "d"], 0.95, "id")
    assert kept == ["a", "b"] and dropped == ["c", "d"]


def test_reconstruction_error_matches_numpy(spark):
    rng = np.random.default_rng(4)
    x = rng.normal(size=(60, 4)) @ rng.normal(size=(4, 4))
    df = spark.createDataFrame([(i, *map(float, r)) for i, r in enumerate(x)], "uid int, b0 double, b1 double, b2 double, b3 double")
    model = prep.block_pca(df, ["b0", "b1", "b2", "b3"], 4)
    got = model.reconstruction_error(df, 0.8).orderBy("uid").toPandas()["pca_error"].to_numpy()
    c = x - x.mean(axis=0)
    u, s, vt = np.linalg.svd(c, full_matrices=False)
    share = np.cumsum(s**2 / (s**2).sum())
    keep = max(1, min(int(np.searchsorted(share, 0.8) + 1), 3))
    want = ((c - c @ vt[:keep].T @ vt[:keep]) ** 2).mean(axis=1)
    np.testing.assert_allclose(got, want, atol=1e-9)


def test_bad_probability_in_a_bundle_raises(spark):
    from cohortloom.sources.tables import bundle_predictions

    good = spark.createDataFrame([("a", 1, 0.2)], "uid string, y int, p double")
    bad = spark.createDataFrame([("a", 1, 1.5)], "uid string, y int, p double")
    with pytest.raises(PySparkException):
        bundle_predictions({"x": good, "z": bad}, "uid", "y", "p").collect()


def test_median_prune_does_not_split_equal_means_by_rounding(spark):
    values = {1: (0.1, 0.2, 0.3), 2: (0.3, 0.2, 0.1), 3: (0.3, 0.2, 0.1), 4: (0.5, 0.5, 0.5)}
    assert 0.1 + 0.2 + 0.3 > 0.3 + 0.2 + 0.1  # the same mean, added in another order
    rows = [(t, s, v) for t, vs in values.items() for s, v in enumerate(vs)]
    got = prep.median_prune(spark.createDataFrame(rows, "t long, s long, v double"), "t", "s", "v").where("s = 2").collect()
    assert {r["t"]: r["prune"] for r in got} == {1: False, 2: False, 3: False, 4: True}
