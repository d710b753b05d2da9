"""Cell-wise scans and exact quantiles against pandas on tables with one dominant group and heavy ties."""

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from cohortloom.operators import order, selection, windows


@pytest.fixture(scope="module")
def skewed(spark):
    rng = np.random.default_rng(5)
    n = 4000
    frame = pd.DataFrame(
        {
            "k": np.arange(n),
            "g": np.where(rng.random(n) < 0.6, "hot", rng.choice(list("abcd"), n)),
            "v": np.where(rng.random(n) < 0.4, 0.5, rng.normal(size=n).round(3)),
            "w": rng.random(n),
        }
    )
    frame.loc[frame["k"] % 29 == 0, "w"] = np.nan
    return frame, spark.createDataFrame(frame).withColumn("w", F.when(~F.isnan("w"), F.col("w")))


def test_running_matches_pandas(skewed):
    frame, df = skewed
    out = order.running(
        df, ["g"], "k",
        {"rn": ("row_number", None), "s": ("sum", F.col("w")), "mn": ("min", F.col("w")), "mx": ("max_before", F.col("w")),
         "p": ("prev", F.col("v")), "t": ("total", F.lit(1)), "b": ("before", F.lit(1))},
    ).toPandas().sort_values("k").reset_index(drop=True)
    g = frame.groupby("g")
    assert (out["rn"] == g.cumcount() + 1).all()
    assert (out["b"] == g.cumcount()).all()
    assert (out["t"] == g["k"].transform("size")).all()
    np.testing.assert_allclose(out["s"].fillna(0), frame["w"].fillna(0).groupby(frame["g"]).cumsum(), rtol=1e-9)
    np.testing.assert_allclose(out["mn"].astype(float), g["w"].cummin().groupby(frame["g"]).ffill(), equal_nan=True)
    np.testing.assert_allclose(out["p"].astype(float), g["v"].shift(1), equal_nan=True)
    expected = g["w"].cummax().groupby(frame["g"]).ffill().groupby(frame["g"]).shift(1)
    np.testing.assert_allclose(out["mx"].astype(float), expected, equal_nan=True)


def test_quantiles_and_ranks_match_pandas(skewed):
    frame, df = skewed
    ps = [0.0, 0.1, 0.25, 0.5, 0.9, 1.0]
    out = order.exact_quantiles(df, ["g"], ["v", "w"], ps).toPandas().set_index(["g", "feature"])
    for (g, c), row in out.iterrows():
        expected = frame.loc[frame["g"] == g, c].quantile(ps).to_numpy()
        np.testing.assert_allclose(row[[f"q{i}" for i in range(len(ps))]].astype(float), expected, atol=1e-12)
    ranked = windows.pct_rank(df, "v", ["g"]).toPandas().sort_values("k")
    np.testing.assert_allclose(ranked["pct"], frame.groupby("g")["v"].rank(pct=True), atol=1e-12)


def test_cells_bound_the_rows_of_a_dominant_group(skewed):
    frame, df = skewed
    cells = order.add_cell(df, "k").groupBy("g", order.BUCKET).count().agg(F.max("count")).first()[0]
    assert cells < len(frame) / 8


def test_constant_and_empty_columns(spark):
    df = spark.createDataFrame([("a", 1.0), ("a", 1.0), ("b", None)], "g string, v double")
    out = {r["g"]: r["q0"] for r in order.exact_quantiles(df, ["g"], ["v"], [0.5]).collect()}
    assert out["a"] == 1.0 and out.get("b") is None
    empty = df.where("false")
    assert order.running(empty, ["g"], "v", {"rn": ("row_number", None)}).count() == 0


def test_pareto_front_matches_brute_force(spark):
    rng = np.random.default_rng(1)
    pts = np.round(rng.random((400, 2)), 2)
    df = spark.createDataFrame([(i, float(a), float(b)) for i, (a, b) in enumerate(pts)], "k int, a double, b double")
    got = {r["k"] for r in selection.pareto_front(df, "a", "b").collect()}
    want = {i for i, p in enumerate(pts) if not any((q >= p).all() and (q > p).any() for q in pts)}
    assert got == want


def test_samples_do_not_depend_on_partitioning(spark):
    df = spark.range(500).withColumn("c", F.col("id") % 3)
    a = {r["id"] for r in selection.sample_stratified(df, 60, "c", "id", 4).collect()}
    b = {r["id"] for r in selection.sample_stratified(df.repartition(13), 60, "c", "id", 4).collect()}
    assert a == b and len(a) == 60


def test_median_gap_of_all_pairs_matches_brute_force(spark):
    from cohortloom.operators.embed import median_pair_gap

    rng = np.random.default_rng(6)
    cases = [rng.integers(0, 13, 101).astype(float), rng.normal(size=80) * 1e4, np.full(30, 2.5), np.array([1.0, 4.0]), np.append(np.zeros(60), rng.random(40)), np.array([7.0])]
    for x in cases:
        df = spark.createDataFrame([(float(v),) for v in x] + [(None,), (float("nan"),)], "v double").repartition(3)
        i, j = np.triu_indices(len(x), 1)
        got = median_pair_gap(df, "v")
        assert (got is None) if len(x) < 2 else got == pytest.approx(np.median(np.abs(x[i] - x[j])), rel=1e-9, abs=1e-12)
