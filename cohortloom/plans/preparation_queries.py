"""Feature preparation queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from cohortloom.operators import prep
from cohortloom.operators.joins import join_one_to_one
from cohortloom.operators.profile import corr_matrix
from cohortloom.operators.transformer import FoldTransformer
from cohortloom.plans import fixtures as fx
from cohortloom.registry import query

C = F.col
X = [f"x{i}" for i in range(8)]
X3 = X[:3]


def _stats(where):
    """Median, and quartiles after median fill, of the rows kept by ``where``."""
    parts = ", ".join(
        f"quantile_cont(f{c}, 0.25) AS lo_{c}, quantile_cont(f{c}, 0.75) AS hi_{c}, any_value(m{c}) AS m_{c}" for c in X3
    )
    filled = ", ".join(f"coalesce({c}, median({c}) OVER ()) AS f{c}, median({c}) OVER () AS m{c}" for c in X3)
    return f"SELECT {parts} FROM (SELECT {filled} FROM fx_features WHERE {where})"


_Z = ", ".join(
    f"(coalesce({c}, m_{c}) - m_{c}) / CASE WHEN hi_{c} - lo_{c} > 1e-8 THEN hi_{c} - lo_{c} ELSE 1 END AS z_{c}" for c in X3
)


@query("m01_fold_impute_scale", "uid:i z_x0:d z_x1:d z_x2:d", f"SELECT uid, {_Z} FROM fx_features, ({_stats('fold <> 0')})", "fx_features")
def _(spark, sf):
    df = fx.features(spark, sf)
    return prep.FoldImputeScale(X3).fit(df.where(C("fold") != 0)).transform(df)


@query("m01_fold_impute_scale_pca", "uid:i abs_pc1:d4")
def _(spark, sf):
    df = fx.features(spark, sf)
    out = prep.FoldImputeScale(X, pca_variance=0.8).fit(df.where(C("fold") != 0)).transform(df)
    return out.select("uid", F.abs("pc1").alias("abs_pc1"))


_ZV = ", ".join(f"CASE WHEN valid THEN {z.split(' AS ')[0]} ELSE 0 END AS {z.split(' AS ')[1]}" for z in _Z.split(", (") and [
    f"(coalesce({c}, m_{c}) - m_{c}) / CASE WHEN hi_{c} - lo_{c} > 1e-8 THEN hi_{c} - lo_{c} ELSE 1 END AS z_{c}" for c in X3
])


@query("m02_masked_scale", "uid:i z_x0:d z_x1:d z_x2:d", f"SELECT uid, {_ZV} FROM fx_features, ({_stats('fold <> 0 AND valid')})", "fx_features")
def _(spark, sf):
    df = fx.features(spark, sf)
    return prep.MaskedScale(X3, "valid").fit(df.where(C("fold") != 0)).transform(df)


def _harm(c):
    g = f"(SELECT grp, count(*) AS n, median({c}) AS med, quantile_cont({c}, 0.75) - quantile_cont({c}, 0.25) AS iqr FROM t GROUP BY grp)"
    a = f"(SELECT median({c}) AS med, quantile_cont({c}, 0.75) - quantile_cont({c}, 0.25) AS iqr FROM t)"
    return f"""SELECT uid, greatest(least((coalesce({c}, med) - med) / iqr, CAST(8 AS DOUBLE)), CAST(-8 AS DOUBLE)) AS h_{c} FROM (
      SELECT f.uid, f.{c}, CASE WHEN g.n >= 5 THEN coalesce(g.med, a.med) ELSE a.med END AS med,
        CASE WHEN g.n >= 5 AND g.iqr <> 0 THEN g.iqr WHEN a.iqr = 0 THEN 1 ELSE a.iqr END AS iqr FROM fx_features f LEFT JOIN {g} g ON f.grp = g.grp CROSS JOIN {a} a)"""


@query(
    "m03_harmonize",
    "uid:i h_x0:d h_x1:d",
    f"WITH t AS (SELECT * FROM fx_features WHERE fold <> 1 AND grp <> 3) SELECT a.uid, h_x0, h_x1 FROM ({_harm('x0')}) a JOIN ({_harm('x1')}) b ON a.uid = b.uid",
    "fx_features",
)
def _(spark, sf):
    df = fx.features(spark, sf)
    return prep.harmonize(df, df.where((C("fold") != 1) & (C("grp") != 3)), ["x0", "x1"], "grp")


@query(
    "m04_robust_scale",
    "uid:i r_x0:d r_x1:d",
    """SELECT uid, (x0 - m0) / d0 AS r_x0, (x1 - m1) / d1 AS r_x1 FROM fx_features, (SELECT median(x0) AS m0, quantile_cont(x0, 0.9) - quantile_cont(x0, 0.1) AS d0,
       median(x1) AS m1, quantile_cont(x1, 0.9) - quantile_cont(x1, 0.1) AS d1 FROM fx_features)""",
    "fx_features",
)
def _(spark, sf):
    return prep.robust_scale(fx.features(spark, sf), ["x0", "x1"])


def _wide_copies(spark, sf):
    """Feature table with near copies of some columns, so that pruning has work to do."""
    f = fx.features(spark, sf)
    return f.select("uid", "x0", "x1", "x2", (C("x0") * 2 + C("x1") * F.lit(0.01)).alias("x0b"), (-C("x2") + F.lit(1.0)).alias("x2b"), "x3")


@query("m05_prune_correlated", "a:s b:s corr:d a_kept:b b_kept:b")
def _(spark, sf):
    cols = ["x0", "x1", "x2", "x0b", "x2b", "x3"]
    df = _wide_copies(spark, sf)
    kept, _ = prep.prune_correlated(df, cols, 0.95, "uid")
    c = corr_matrix(df, cols, "uid", "spearman")
    return c.select("a", "b", "corr", C("a").isin(kept).alias("a_kept"), C("b").isin(kept).alias("b_kept"))


_EDGES = ", ".join(f"quantile_cont(v, {i / 10})" for i in range(1, 10))
_MI_LONG = " UNION ALL ".join(f"SELECT y, '{c}' AS feature, {c} AS v FROM fx_features WHERE {c} IS NOT NULL" for c in X)


@query(
    "m06_select_top_mi",
    "feature:s mi:d",
    f"""WITH l AS ({_MI_LONG}), e AS (SELECT feature, [{_EDGES}] AS edges FROM l GROUP BY feature),
        j AS (SELECT l.feature, l.y, len(list_filter(edges, lambda q: q < v)) AS bin, count(*) AS c FROM l JOIN e ON l.feature = e.feature GROUP BY 1, 2, 3),
        p AS (SELECT *, CAST(sum(c) OVER (PARTITION BY feature, bin) AS DOUBLE) AS cb, CAST(sum(c) OVER (PARTITION BY feature, y) AS DOUBLE) AS cy, CAST(sum(c) OVER (PARTITION BY feature) AS DOUBLE) AS n FROM j)
        SELECT feature, sum(c / n * ln(c * n / (cb * cy))) AS mi FROM p GROUP BY feature ORDER BY mi DESC, feature LIMIT 5""",
    "fx_features",
)
def _(spark, sf):
    return prep.select_top_mi(fx.features(spark, sf), X, "y", 5)


def _filled(spark, sf):
    return fx.features(spark, sf).na.fill(0.0, X)


BLOCKS = {"first": X[:4], "second": X[4:6], "third": X[6:]}


def _block_model(spark, sf):
    bal = prep.balance_blocks(_filled(spark, sf), BLOCKS)
    return prep.block_pca(bal, [f"b_{c}" for c in X], 6), bal


@query("m07_block_pca_scores", "uid:i abs_pc1:d4 abs_pc2:d4")
def _(spark, sf):
    model, bal = _block_model(spark, sf)
    return model.scores(bal).select("uid", F.abs("pc1").alias("abs_pc1"), F.abs("pc2").alias("abs_pc2"))


@query("m08_pca_reconstruction_error", "uid:i pca_error:d")
def _(spark, sf):
    model, bal = _block_model(spark, sf)
    return model.reconstruction_error(bal, 0.7)


_D = [f"({a} - m_{a})" for a in ["x0", "x1"]]


@query(
    "m09_mahalanobis_shrunk",
    "uid:i mahalanobis:d",
    """WITH f AS (SELECT uid, coalesce(x0, 0) AS a, coalesce(x1, 0) AS b FROM fx_features), m AS (SELECT avg(a) AS ma, avg(b) AS mb, CAST(count(*) AS DOUBLE) AS n FROM f),
       s AS (SELECT avg((a-ma)*(a-ma)) AS saa, avg((a-ma)*(b-mb)) AS sab, avg((b-mb)*(b-mb)) AS sbb, avg(((a-ma)*(a-ma)+(b-mb)*(b-mb))*((a-ma)*(a-ma)+(b-mb)*(b-mb))) AS q FROM f, m),
       k AS (SELECT *, (saa + sbb) / 2 AS mu, saa*saa + 2*sab*sab + sbb*sbb AS sq FROM s, m),
       g AS (SELECT *, least((q - sq) / (2 * n), (sq - 2*mu*(saa+sbb) + 2*mu*mu) / 2) / ((sq - 2*mu*(saa+sbb) + 2*mu*mu) / 2) AS sh FROM k),
       c AS (SELECT ma, mb, (1-sh)*saa + sh*mu AS ca, (1-sh)*sab AS cc, (1-sh)*sbb + sh*mu AS cb FROM g)
       SELECT uid, (cb*(a-ma)*(a-ma) - 2*cc*(a-ma)*(b-mb) + ca*(b-mb)*(b-mb)) / (ca*cb - cc*cc) AS mahalanobis FROM f, c""",
    "fx_features",
)
def _(spark, sf):
    return prep.mahalanobis_shrunk(_filled(spark, sf), ["x0", "x1"])


@query(
    "m17_class_weights",
    "uid:s y:i weight:d",
    "SELECT uid, y, count(*) OVER () / (2.0 * count(*) OVER (PARTITION BY y)) AS weight FROM fx_wide",
    "fx_wide",
)
def _(spark, sf):
    return prep.class_weights(fx.wide_predictions(spark, sf).select("uid", "y"), "y")


@query(
    "m20_median_prune",
    "trajectory:i step:i running_mean:d median:d prune:b",
    """WITH s AS (SELECT user_id AS trajectory, event_id // 2000 AS step, avg(value) AS v FROM events GROUP BY 1, 2),
       r AS (SELECT *, avg(v) OVER (PARTITION BY trajectory ORDER BY step) AS running_mean FROM s), m AS (SELECT *, median(running_mean) OVER (PARTITION BY step) AS median FROM r)
       SELECT trajectory, step, running_mean, median, step >= 1 AND running_mean > median AS prune FROM m""",
)
def _(spark, sf):
    e = fx.table(spark, sf, "events")
    steps = e.groupBy(C("user_id").alias("trajectory"), F.floor(C("event_id") / 2000).alias("step")).agg(F.avg("value").alias("v"))
    return prep.median_prune(steps, "trajectory", "step", "v")


@query(
    "m21_requeue_failed",
    "study:s number:i params_json:s",
    """SELECT study, min(CASE WHEN state = 'FAIL' THEN number END) AS number, params_json FROM (SELECT *, CASE WHEN number % 3 = 0 AND state <> 'FAIL' THEN 'other' ELSE study END AS s2 FROM fx_trials)
       GROUP BY study, params_json HAVING max(CASE WHEN state <> 'FAIL' THEN 1 ELSE 0 END) = 0""",
    "fx_trials",
)
def _(spark, sf):
    return prep.requeue_failed(fx.trials(spark, sf), "study", "params_json", "state", "number")


_FILL = ", ".join(f"coalesce({c}, (SELECT median({c}) FROM fx_features WHERE fold <> 0)) AS {c}" for c in X)


@query(
    "m25_fold_transformer",
    "uid:i feature:s value:d",
    f"""WITH f AS (SELECT uid, fold, {_FILL} FROM fx_features), t AS (SELECT * FROM f WHERE fold <> 0)
        {' UNION ALL '.join(f"SELECT uid, '{c}' AS feature, ({c} - (SELECT median({c}) FROM t)) / (SELECT quantile_cont({c}, 0.75) - quantile_cont({c}, 0.25) FROM t) AS value FROM f" for c in X)}""",
    "fx_features",
)
def _(spark, sf):
    """All columns of the fixture vary and none correlate, so all are kept; the state is learned from four folds."""
    df = fx.features(spark, sf)
    model = FoldTransformer().fit(df.where(C("fold") != 0), X, "y")
    names = F.array(*[F.lit(n) for n in model.names])
    return model.transform(df, "uid").select("uid", F.explode(F.map_from_arrays(names, C("features"))).alias("feature", "value"))
