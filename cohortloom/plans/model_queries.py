"""Model queries: every fit stays inside training folds; checks are invariants, so there is no SQL oracle."""

from __future__ import annotations

from pyspark.sql import functions as F

from cohortloom.operators import metrics as e
from cohortloom.operators import models as m
from cohortloom.plans import fixtures as fx
from cohortloom.registry import query
from cohortloom.session import scratch_path

C = F.col
X = [f"x{i}" for i in range(8)]
FOLDS = range(2)


def _data(spark, sf):
    """Features with a label that two of them carry, and two folds."""
    f = fx.features(spark, sf).na.fill(0.0, X)
    signal = C("x0") + F.lit(0.5) * C("x1") + F.lit(0.2) * C("x2")
    return f.withColumn("y", (signal > 0).cast("int")).withColumn("fold", (C("fold") % 2).cast("int"))


def _evaluated(oof):
    return e.binary_metrics(oof, ["model"], "y", "prob")


METRICS = "model:s n:i log_loss:d4 auc:d4"


@query("m10_isolation_forest", "uid:i isolation_score:d4")
def _(spark, sf):
    return m.isolation_forest(_data(spark, sf), "uid", X, trees=50, sub=128, seed=5)


@query("m12_train_logistic", METRICS)
def _(spark, sf):
    b = lambda n: m.train_logistic(X, "y", 1.0, 0.5, n)
    return _evaluated(m.oof_predict(_data(spark, sf), "logistic", b, "uid", "y", "fold", FOLDS))


@query("m13_train_random_forest", METRICS)
def _(spark, sf):
    b = lambda n: m.train_random_forest(X, "y", 20, 5, weight="weight", seed=1)
    return _evaluated(m.oof_predict(m.balanced(_data(spark, sf), "y"), "forest", b, "uid", "y", "fold", FOLDS))


@query("m14_train_gbt", METRICS)
def _(spark, sf):
    b = lambda n: m.train_gbt(X, "y", 8, 3, 0.3, seed=1)
    return _evaluated(m.oof_predict(_data(spark, sf), "gbt", b, "uid", "y", "fold", FOLDS))


@query("m15_train_gbt_early_stop", METRICS)
def _(spark, sf):
    df = _data(spark, sf)
    model, _ = m.train_gbt_early_stop(df.where(C("fold") != 0), X, "y", "uid", max_iter=12, step=0.3)
    scored = m.positive_probability(model.transform(df.where(C("fold") == 0)))
    return _evaluated(scored.withColumn("model", F.lit("gbt_early_stop")))


@query("m16_train_mlp", METRICS)
def _(spark, sf):
    b = lambda n: m.train_mlp(X, "y", (8,), 60, 1)
    return _evaluated(m.oof_predict(_data(spark, sf), "mlp", b, "uid", "y", "fold", FOLDS))


@query("m18_oof_predict", "uid:i y:i fold:i model:s prob:d4")
def _(spark, sf):
    df, path = _data(spark, sf), scratch_path(spark, "oof")
    b = lambda n: m.train_logistic(X, "y", 1.0, 0.0, n)
    m.oof_predict(df, "logistic", b, "uid", "y", "fold", [0], path)
    return m.oof_predict(df, "logistic", b, "uid", "y", "fold", FOLDS, path)


@query("m19_random_search", "study:s number:i state:s value:d4 params_json:s")
def _(spark, sf):
    space = {"c": (0.01, 10.0, "log"), "l1_ratio": [0.0, 0.5, 1.0]}
    build = lambda p, n: m.train_logistic(X, "y", p["c"], p["l1_ratio"], n, max_iter=30)
    return m.random_search(_data(spark, sf), "logistic", space, build, 3, "uid", "y", "fold", FOLDS, seed=2)


@query("m22_stack_logits", METRICS)
def _(spark, sf):
    w = fx.wide_predictions(spark, sf)
    return _evaluated(m.stack_logits(w, ["m_a", "m_b", "m_c"], "uid", "y", "fold", range(5)))


@query("m23_diffusion_map", "uid:i d1:d4 d2:d4")
def _(spark, sf):
    return m.diffusion_map(_data(spark, sf), "uid", X, components=2)


@query("m24_fixed_blend", "model:s n:i log_loss:d brier:d auc:d")
def _(spark, sf):
    b = m.fixed_blend(fx.wide_predictions(spark, sf), "uid", "y", "fold", "m_a", "m_b")
    return e.binary_metrics(b.withColumn("model", F.lit("blend")), ["model"], "y", "calibrated")


@query("e23_block_permutation_importance", "block:s loss:d4")
def _(spark, sf):
    df = _data(spark, sf)
    model = m.train_logistic(X, "y", 1.0, 0.0, df.count()).fit(df)
    return e.block_permutation_importance(model, df, {"signal": ["x0", "x1"], "noise": ["x5", "x6"]}, "uid", "fold", "y", 3)
