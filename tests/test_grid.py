import numpy as np
import pytest
from pyspark.sql import functions as F

from cohortloom.operators import bank, grid
from cohortloom.operators import voxel as vx


def plain_labels(active):
    """Components by flood fill, numbered in raster order."""
    out, n = np.zeros(active.shape, int), 0
    for start in map(tuple, np.argwhere(active)):
        if out[start]:
            continue
        n += 1
        todo = [start]
        out[start] = n
        while todo:
            z, y, x = todo.pop()
            for q in ((z - 1, y, x), (z + 1, y, x), (z, y - 1, x), (z, y + 1, x), (z, y, x - 1), (z, y, x + 1)):
                if all(0 <= a < b for a, b in zip(q, active.shape)) and active[q] and not out[q]:
                    out[q] = n
                    todo.append(q)
    return out


@pytest.mark.parametrize("share", [0.0, 0.2, 0.35, 0.5, 0.7, 1.0])
def test_labels_of_runs_match_flood_fill(share):
    rng = np.random.default_rng(int(share * 100))
    for shape in ((1, 1, 1), (1, 5, 7), (4, 1, 3), (6, 5, 4), (9, 8, 7)):
        active = rng.random(shape) < share
        assert (grid.label(active) == plain_labels(active)).all()


def test_component_tree_matches_labels_at_every_threshold():
    rng = np.random.default_rng(4)
    for _ in range(20):
        level = rng.integers(0, 6, (5, 6, 4)) * (rng.random((5, 6, 4)) < 0.8)
        for k, (components, largest, active) in enumerate(grid.component_tree(level, 5), 1):
            labels = plain_labels(level >= k)
            sizes = np.bincount(labels.ravel())[1:]
            assert (components, largest, active) == (labels.max(), sizes.max(initial=0), sizes.sum())


def test_cooccurrence_matches_pairs():
    rng = np.random.default_rng(5)
    grey = rng.integers(-1, 4, (4, 3, 5))
    counts = np.zeros((4, 4), int)
    for dz, dy, dx in vx.OFFSETS_13:
        for z, y, x in np.ndindex(grey.shape):
            q = (z + dz, y + dy, x + dx)
            if all(0 <= a < b for a, b in zip(q, grey.shape)) and grey[z, y, x] >= 0 and grey[q] >= 0:
                counts[grey[z, y, x], grey[q]] += 1
                counts[grey[q], grey[z, y, x]] += 1
    assert (grid.cooccurrence(grey, 4, vx.OFFSETS_13) == counts).all()


def volume(spark, uid, shape, mask, seed):
    values = np.random.default_rng(seed).random(shape)
    return spark.createDataFrame([(uid, *map(int, p), float(values[p]), bool(mask[p])) for p in np.ndindex(shape)], "uid string, z int, y_ int, x int, v double, m boolean")


def test_bank_has_930_finite_features_and_zeros_for_empty_regions(spark):
    full = np.zeros((6, 8, 8), bool)
    full[1:5, 1:7, 1:7] = True
    right = full & (np.arange(8) < 3)
    df = volume(spark, "a", full.shape, full, 1).unionByName(volume(spark, "b", right.shape, right, 2))
    rows = {r.uid: r.asDict() for r in bank.regional_bank(df).collect()}
    names = bank.bank_names()
    assert len(names) == len(set(names)) == 930
    assert all(set(r) == {"uid", *names} and all(np.isfinite(r[n]) for n in names) for r in rows.values())
    assert all(rows["b"][n] == 0 for n in names if "_left_" in n and n.startswith(("intensity", "morph", "texture")))
    assert any(rows["a"][n] != 0 for n in names if n.startswith("texture_left_caudate"))
    s = vx.self_normalize(df.where("uid = 'a' AND m")).toPandas()
    cut = np.percentile(s["s"], 90)
    active = np.zeros(full.shape, bool)
    hot = s[s["s"] >= cut]
    active[hot["z"], hot["y_"], hot["x"]] = True
    sizes = np.bincount(plain_labels(active).ravel())[1:]
    assert rows["a"]["morph_target_p90_components"] == len(sizes)
    assert rows["a"]["morph_target_p90_largest_fraction"] == pytest.approx(sizes.max() / sizes.sum())


def test_texture_honours_keys_and_small_groups(spark):
    df = spark.createDataFrame([("u", "a", 0, 0, i, float(i % 3), True) for i in range(12)] + [("u", "b", 0, 0, i, 1.0, True) for i in range(12)], "uid string, part string, z int, y_ int, x int, v double, m boolean")
    got = {r.part: r for r in vx.glcm(df, 4, vx.AXES_3, "floor", 8, ["part"], empty=0.0).collect()}
    alone = vx.glcm(df.where(F.col("part") == "a"), 4, vx.AXES_3, "floor", 8).collect()[0]
    assert got["a"].contrast == alone.contrast > 0
    assert got["b"].contrast == 0.0
    assert vx.glcm(df.where(F.col("part") == "b"), 4, vx.AXES_3, "floor", 8).collect()[0].contrast is None


def test_correlations_of_hundreds_of_columns_match_numpy(spark):
    from cohortloom.operators.gram import correlations, covariance

    rng = np.random.default_rng(9)
    p = 930
    x = rng.normal(size=(50, p)) + 1e4
    x[:, 5] = 3.7
    df = spark.createDataFrame([(x[i].tolist(),) for i in range(50)], "v array<double>").repartition(3)
    names = [f"c{i}" for i in range(p)]
    wide = df.select(*[F.col("v")[i].alias(n) for i, n in enumerate(names)])
    rows = correlations(wide, names).collect()
    assert len(rows) == p * (p - 1) // 2
    with np.errstate(all="ignore"):
        want = np.corrcoef(x, rowvar=False)
    for r in rows[::997]:
        i, j = int(r.a[1:]), int(r.b[1:])
        assert (r["corr"] is None) == (5 in (i, j))
        assert r["corr"] is None or r["corr"] == pytest.approx(want[i, j], abs=1e-9)
    mean, cov = covariance(wide.select(*names[:7]), names[:7])
    np.testing.assert_allclose(mean, x[:, :7].mean(axis=0))
    np.testing.assert_allclose(cov, np.cov(x[:, :7], rowvar=False, bias=True), atol=1e-8)


def test_correlations_leave_out_missing_pairs(spark):
    from cohortloom.operators.gram import correlations

    df = spark.createDataFrame([(1.0, 2.0), (2.0, None), (3.0, 7.0), (4.0, 5.0), (float("nan"), 1.0)], "a double, b double")
    assert correlations(df, ["a", "b"]).first()["corr"] == pytest.approx(np.corrcoef([1, 3, 4], [2, 7, 5])[0, 1])


def test_fold_transformer_learns_from_training_rows_only(spark):
    import json

    from cohortloom.operators.transformer import FoldTransformer

    rng = np.random.default_rng(17)
    x = rng.normal(size=(60, 20))
    y = np.tile([0, 1], 30)
    x[:, 3] += 3 * y
    x[:, 7] = x[:, 3] * -2 + 1
    x[:, 9] = 4.0
    x[5, 1] = np.nan
    x[50:] += 100
    names = [f"f{i}" for i in range(20)]
    df = spark.createDataFrame([(i, int(y[i]), *map(float, r)) for i, r in enumerate(x)], ["uid", "y", *names])
    model = FoldTransformer(top_k=6, variance=0.95).fit(df.where("uid < 50"), names, "y")
    train = np.where(np.isnan(x[:50]), np.nanmedian(x[:50], axis=0), x[:50])
    assert model.names[0] == "f3" and "f7" not in model.names and "f9" not in model.names and len(model.names) == 6
    at = [names.index(n) for n in model.names]
    iqr = np.subtract(*np.percentile(train, [75, 25], axis=0))
    scale = lambda v: (v[:, at] - np.median(train, axis=0)[at]) / iqr[at]
    z = scale(train)
    _, s, vt = np.linalg.svd(z - z.mean(axis=0), full_matrices=False)
    share = np.cumsum(s**2) / (s**2).sum()
    keep = int(np.searchsorted(share, 0.95, side="right")) + 1
    assert model.width == min(keep, 6)
    rows = {r.uid: np.array(r.features) for r in model.transform(df, "uid").collect()}
    want = (scale(x[50:]) - z.mean(axis=0)) @ vt[: model.width].T
    got = np.stack([rows[i] for i in range(50, 60)])
    np.testing.assert_allclose(np.abs(got), np.abs(want), atol=1e-8)
    again = FoldTransformer.from_state(json.loads(json.dumps(model.to_state())))
    np.testing.assert_allclose(np.stack([np.array(r.features) for r in again.transform(df.where("uid >= 50"), "uid").orderBy("uid").collect()]), got)


def test_small_scans_share_a_step_and_steps_hold_whole_scans(spark, monkeypatch):
    """Scans of two shapes, cut into steps of a few rows; the same rows as in one step."""
    rows = [(u, z, y, x, float((u * 31 + z * 7 + y * 5 + x * 3) % 11 + 1), (z + y + x) % (2 + u % 2) == 0) for u in range(12) for z in range(3) for y in range(3 + u % 3) for x in range(4)]
    df = spark.createDataFrame(rows, "uid long, z int, y_ int, x int, v double, m boolean")

    def answers():
        found = [vx.region_stats(df), vx.threshold_morphology(df), vx.glcm(df, 4, min_n=2)]
        return [sorted(tuple(map(str, r)) for r in f.collect()) for f in found]

    whole = answers()
    batches = df.where("uid < 6").orderBy("uid", "z", "y_", "x").toArrow().to_batches(max_chunksize=7)
    monkeypatch.setattr(grid, "STEP_ROWS", 20)
    steps = [set(t.column("uid").to_pylist()) for t in grid.steps(iter(batches))]
    assert len(steps) > 3 and sum(map(len, steps)) == len(set().union(*steps)) == 6
    assert answers() == whole


def test_blocks_of_core_features_read_voxels_that_are_normalised_and_closed_once(spark, sf):
    from cohortloom.plans import load_all

    queries = load_all()
    blocks = queries["v33_core_feature_blocks"].run(spark, sf)
    # No window, and so no sort of voxels, is left in the plan that joins the blocks.
    assert "Window" not in blocks._jdf.queryExecution().optimizedPlan().toString()
    rows = {r["uid"]: r for r in blocks.collect()}
    core = {r["uid"]: r["target_mean"] for r in queries["v33_core_features"].run(spark, sf).collect()}
    assert core and {u: r["target_mean"] for u, r in rows.items()} == core
    assert any(r["components"] > 0 and r["high_elongation"] for r in rows.values())
