"""Aggregation queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from cohortloom.functions.scalar import explode_params, row_log_loss
from cohortloom.operators import profile as p
from cohortloom.plans import fixtures as fx
from cohortloom.registry import query

C = F.col
LOSS = "-(y * ln(prob) + (1 - y) * ln(1 - prob))"


@query(
    "a01_group_profile",
    "shape_x:i n:i n_values:i mean:d median:d total:d n_unique:i",
    """SELECT shape_x, count(*) AS n, count(f2) AS n_values, avg(f2) AS mean, median(f2) AS median, sum(f2) AS total, count(DISTINCT f2) AS n_unique
       FROM fx_cohort GROUP BY shape_x""",
    "fx_cohort",
)
def _(spark, sf):
    return p.group_profile(fx.cohort(spark, sf), ["shape_x"], "f2")


_COVER = """SELECT grp, n, available, valid, n - available AS failures, available / n AS coverage, (n - available) / n AS failure_rate,
  CASE WHEN available > 0 THEN valid / available ELSE 0 END AS valid_fraction FROM (
  SELECT d.source AS grp, CAST(count(*) AS DOUBLE) AS n, CAST(count(l.doc_id) AS DOUBLE) AS available, CAST(sum(CASE WHEN l.toxic = 0 THEN 1 ELSE 0 END) AS DOUBLE) AS valid
  FROM documents d LEFT JOIN labels l ON d.doc_id = l.doc_id GROUP BY d.source)"""


def _coverage(spark, sf):
    d = fx.table(spark, sf, "documents").select("doc_id", C("source").alias("grp"))
    lab = fx.table(spark, sf, "labels").select("doc_id", "toxic")
    joined = d.join(lab, "doc_id", "left")
    return p.coverage_by_group(joined, "grp", C("toxic").isNotNull(), C("toxic") == 0)


@query("a02_coverage_by_group", "grp:s n:i available:i valid:i failures:i coverage:d failure_rate:d valid_fraction:d", _COVER)
def _(spark, sf):
    return _coverage(spark, sf)


@query(
    "a02_coverage_gate",
    "worst_failure_rate:d n:i",
    f"SELECT coalesce(max(CASE WHEN n >= 40 THEN failure_rate END), 0) AS worst_failure_rate, sum(n) AS n FROM ({_COVER})",
)
def _(spark, sf):
    return p.coverage_gate(_coverage(spark, sf), 40)


@query(
    "a03_integrity_report",
    "indicator:s value:i",
    """SELECT 'rows' AS indicator, count(*) AS value FROM fx_cohort
       UNION ALL SELECT 'duplicate_keys', count(*) - count(DISTINCT uid) FROM fx_cohort
       UNION ALL SELECT 'unlabelled', count(*) - count(y) FROM fx_cohort
       UNION ALL SELECT 'not_finite', count(*) - count(f2) FROM fx_cohort
       UNION ALL SELECT 'not_positive', sum(CASE WHEN spacing - 2 <= 0 THEN 1 ELSE 0 END) FROM fx_cohort
       UNION ALL SELECT 'families', count(DISTINCT shape_x * 1000 + shape_z + spacing) FROM fx_cohort
       UNION ALL SELECT 'rare_families', count(*) FROM (SELECT 1 FROM fx_cohort GROUP BY shape_x * 1000 + shape_z + spacing HAVING count(*) < 80)""",
    "fx_cohort",
)
def _(spark, sf):
    c = fx.cohort(spark, sf).select(
        "uid", "y", "f2", (C("spacing") - 2).alias("gap"), (C("shape_x") * 1000 + C("shape_z") + C("spacing")).alias("family")
    )
    return p.integrity_report(c, "uid", "y", ["gap"], ["f2"], "family", 80)


@query(
    "a04_schema_profile",
    "feature:s n_non_null:i n_null:i null_share:d n_distinct:i",
    " UNION ALL ".join(
        f"SELECT '{c}' AS feature, count({c}) AS n_non_null, count(*) - count({c}) AS n_null, (count(*) - count({c})) / CAST(count(*) AS DOUBLE) AS null_share, count(DISTINCT {c}) AS n_distinct FROM fx_cohort"
        for c in ["uid", "shape_x", "shape_y", "shape_z", "spacing", "y", "f1", "f2"]
    ),
    "fx_cohort",
)
def _(spark, sf):
    return p.schema_profile(fx.cohort(spark, sf).drop("f3"))


@query(
    "a04_duplicate_rows",
    "rows:i duplicates:i",
    "SELECT count(*) AS rows, count(*) - count(DISTINCT (l_suppkey, l_linenumber, l_returnflag)) AS duplicates FROM lineitem",
)
def _(spark, sf):
    return p.duplicate_rows(fx.table(spark, sf, "lineitem").select("l_suppkey", "l_linenumber", "l_returnflag"))


_CLASS = "SELECT coalesce(CAST(y AS VARCHAR), '<FALTANTE>') AS class, count(*) AS n FROM fx_cohort GROUP BY 1"


@query("a05_class_counts", "class:s n:i share:d", f"SELECT class, n, n / sum(n) OVER () AS share FROM ({_CLASS})", "fx_cohort")
def _(spark, sf):
    return p.class_counts(fx.cohort(spark, sf), "y")


@query(
    "a05_class_balance",
    "n:i majority:i minority:i classes:i ratio:d baseline:d level:s",
    f"""SELECT n, majority, minority, classes, majority / minority AS ratio, majority / n AS baseline,
        CASE WHEN majority / minority < 1.5 THEN 'Bajo' WHEN majority / minority < 3 THEN 'Moderado' ELSE 'Alto' END AS level FROM (
        SELECT CAST(sum(n) AS DOUBLE) AS n, CAST(max(n) AS DOUBLE) AS majority, CAST(min(n) AS DOUBLE) AS minority, sum(CASE WHEN class <> '<FALTANTE>' THEN 1 ELSE 0 END) AS classes FROM ({_CLASS}))""",
    "fx_cohort",
)
def _(spark, sf):
    return p.class_balance(fx.cohort(spark, sf), "y")


@query(
    "a06_state_counts",
    "run_key:s study:s trials_complete:i trials_running:i trials_pruned:i trials_fail:i trials_waiting:i",
    """SELECT run_key, study, count(*) FILTER (state = 'COMPLETE') AS trials_complete, count(*) FILTER (state = 'RUNNING') AS trials_running,
       count(*) FILTER (state = 'PRUNED') AS trials_pruned, count(*) FILTER (state = 'FAIL') AS trials_fail, count(*) FILTER (state = 'WAITING') AS trials_waiting
       FROM fx_trials GROUP BY run_key, study""",
    "fx_trials",
)
def _(spark, sf):
    return p.state_counts(fx.trials(spark, sf), ["run_key", "study"], "state", ["COMPLETE", "RUNNING", "PRUNED", "FAIL", "WAITING"])


def _z_sql(cols, part=""):
    over = f"OVER ({part})"
    filled = ", ".join(f"coalesce({c}, median({c}) {over}) AS {c}, median({c}) {over} AS med_{c}" for c in cols)
    mads = ", ".join(f"median(abs({c} - med_{c})) {over} AS mad_{c}" for c in cols)
    zs = ", ".join(f"CASE WHEN mad_{c} <> 0 THEN ({c} - med_{c}) / (1.4826 * mad_{c}) ELSE 0 END AS z_{c}" for c in cols)
    return f"SELECT uid, grp, n, {zs} FROM (SELECT *, {mads} FROM (SELECT uid, grp, n, {filled} FROM base))"


_BASE = "WITH base AS (SELECT uid, shape_x * 10 + CAST(floor(spacing * 8) AS INT) AS grp, f1, f2, CAST(shape_y AS DOUBLE) AS f4, count(*) OVER (PARTITION BY shape_x * 10 + CAST(floor(spacing * 8) AS INT)) AS n FROM fx_cohort)"


def _scored(spark, sf):
    return fx.cohort(spark, sf).select(
        "uid", (C("shape_x") * 10 + F.floor(C("spacing") * 8).cast("int")).alias("grp"), "f1", "f2", C("shape_y").cast("double").alias("f4")
    )


@query(
    "a07_robust_z", "uid:s z_f1:d z_f2:d z_f4:d", f"{_BASE} SELECT uid, z_f1, z_f2, z_f4 FROM ({_z_sql(['f1', 'f2', 'f4'])})", "fx_cohort"
)
def _(spark, sf):
    return p.robust_z(_scored(spark, sf), ["f1", "f2", "f4"])


@query(
    "a08_within_group_robust_z",
    "uid:s z_f1:d z_f2:d",
    f"""{_BASE} SELECT g.uid, CASE WHEN g.n >= 160 THEN w.z_f1 ELSE g.z_f1 END AS z_f1, CASE WHEN g.n >= 160 THEN w.z_f2 ELSE g.z_f2 END AS z_f2
        FROM ({_z_sql(['f1', 'f2'])}) g JOIN ({_z_sql(['f1', 'f2'], 'PARTITION BY grp')}) w ON g.uid = w.uid""",
    "fx_cohort",
)
def _(spark, sf):
    return p.within_group_robust_z(_scored(spark, sf), ["f1", "f2"], "grp", 160)


@query(
    "a09_rms_score",
    "uid:s score:d combined:d",
    f"""{_BASE} SELECT uid, sqrt((z_f1 * z_f1 + z_f2 * z_f2) / 2) AS score, sqrt(((z_f1 * z_f1 + z_f2 * z_f2) / 2 + z_f1 * z_f1) / 2) AS combined
        FROM ({_z_sql(['f1', 'f2'])})""",
    "fx_cohort",
)
def _(spark, sf):
    z = p.robust_z(_scored(spark, sf), ["f1", "f2"])
    score = p.rms_score([C("z_f1"), C("z_f2")])
    return z.select("uid", score.alias("score"), p.rms_score([score, C("z_f1")]).alias("combined"))


_IQR = """SELECT b.grp, b.feature, b.n_group, coalesce(CASE WHEN b.n_group >= 160 THEN b.med END, g.med) AS median,
  coalesce(CASE WHEN b.n_group >= 160 AND b.iqr <> 0 THEN b.iqr END, CASE WHEN g.iqr = 0 THEN 1 ELSE g.iqr END) AS iqr FROM
  (SELECT grp, feature, count(*) AS n_group, median(v) AS med, quantile_cont(v, 0.75) - quantile_cont(v, 0.25) AS iqr FROM l GROUP BY grp, feature) b
  JOIN (SELECT feature, median(v) AS med, quantile_cont(v, 0.75) - quantile_cont(v, 0.25) AS iqr FROM l GROUP BY feature) g ON b.feature = g.feature"""
_LONG = ", l AS (" + " UNION ALL ".join(f"SELECT uid, grp, '{c}' AS feature, {c} AS v FROM base" for c in ["f1", "f2", "f4"]) + ") "


@query("a10_group_median_iqr", "grp:i feature:s n_group:i median:d iqr:d", _BASE + _LONG + _IQR, "fx_cohort")
def _(spark, sf):
    return p.group_median_iqr(_scored(spark, sf), ["f1", "f2", "f4"], "grp", 160)


_MOM = "SELECT y, z, y_, x, count(*) AS n, avg(v) AS mean, var_pop(v) * count(*) AS m2 FROM fx_voxels GROUP BY y, z, y_, x"


@query("a11_moment_maps", "y:i z:i y_:i x:i n:i mean:d m2:d", _MOM, "fx_voxels")
def _(spark, sf):
    return p.moment_maps(fx.voxels(spark, sf), ["y", "z", "y_", "x"], "v")


@query(
    "a12_effect_size",
    "z:i y_:i x:i difference:d pooled_sd:d cohen_d:d hedges_g:d",
    f"""SELECT z, y_, x, d AS difference, sd AS pooled_sd, CASE WHEN sd > 1e-6 THEN d / sd ELSE 0 END AS cohen_d,
        CASE WHEN sd > 1e-6 THEN d / sd ELSE 0 END * (1 - 3 / greatest(4 * (n0 + n1 - 2) - 1, CAST(1 AS DOUBLE))) AS hedges_g FROM (
        SELECT z, y_, x, n0, n1, mean1 - mean0 AS d, sqrt((m20 + m21) / (n0 + n1 - 2)) AS sd FROM (
        SELECT z, y_, x, max(CASE WHEN y=0 THEN CAST(n AS DOUBLE) END) AS n0, max(CASE WHEN y=1 THEN CAST(n AS DOUBLE) END) AS n1, max(CASE WHEN y=0 THEN mean END) AS mean0,
        max(CASE WHEN y=1 THEN mean END) AS mean1, max(CASE WHEN y=0 THEN m2 END) AS m20, max(CASE WHEN y=1 THEN m2 END) AS m21 FROM ({_MOM}) GROUP BY z, y_, x))""",
    "fx_voxels",
)
def _(spark, sf):
    m = p.moment_maps(fx.voxels(spark, sf), ["y", "z", "y_", "x"], "v")
    return p.effect_size(m, ["z", "y_", "x"], "y")


@query("a13_pivot_predictions", "uid:s y:i m_a:d m_b:d m_c:d", "SELECT uid, y, m_a, m_b, m_c FROM fx_wide", "fx_wide")
def _(spark, sf):
    return fx.wide_predictions(spark, sf)


@query(
    "a14_ensemble_mean",
    "uid:s p_mean:d disagreement:d",
    """SELECT uid, (m_a * 2 + m_b + m_c) / 4 AS p_mean, sqrt(((m_a - m) * (m_a - m) + (m_b - m) * (m_b - m) + (m_c - m) * (m_c - m)) / 2) AS disagreement
       FROM (SELECT *, (m_a + m_b + m_c) / 3 AS m FROM fx_wide)""",
    "fx_wide",
)
def _(spark, sf):
    return p.ensemble_mean(fx.wide_predictions(spark, sf), ["m_a", "m_b", "m_c"], [2, 1, 1])


_PAIRS = [("m_a", "m_b"), ("m_a", "m_c"), ("m_b", "m_c")]


@query(
    "a15_corr_matrix",
    "a:s b:s corr:d",
    " UNION ALL ".join(f"SELECT '{a}' AS a, '{b}' AS b, corr({a}, {b}) AS corr FROM fx_wide" for a, b in _PAIRS),
    "fx_wide",
)
def _(spark, sf):
    return p.corr_matrix(fx.wide_predictions(spark, sf), ["m_a", "m_b", "m_c"])


@query(
    "a15_residual_corr",
    "a:s b:s corr:d",
    " UNION ALL ".join(f"SELECT '{a}' AS a, '{b}' AS b, corr({a} - y, {b} - y) AS corr FROM fx_wide" for a, b in _PAIRS),
    "fx_wide",
)
def _(spark, sf):
    w = fx.wide_predictions(spark, sf)
    return p.corr_matrix(w.select(*[(C(m) - C("y")).alias(m) for m in ["m_a", "m_b", "m_c"]]), ["m_a", "m_b", "m_c"])


_RANKS = "SELECT " + ", ".join(
    f"rank() OVER (ORDER BY {m}) + (count(*) OVER (PARTITION BY {m}) - 1) / CAST(2 AS DOUBLE) AS {m}" for m in ["m_a", "m_b", "m_c"]
) + " FROM fx_wide"


@query(
    "a15_spearman",
    "a:s b:s corr:d",
    " UNION ALL ".join(f"SELECT '{a}' AS a, '{b}' AS b, corr({a}, {b}) AS corr FROM ({_RANKS})" for a, b in _PAIRS),
    "fx_wide",
)
def _(spark, sf):
    return p.corr_matrix(fx.wide_predictions(spark, sf), ["m_a", "m_b", "m_c"], key="uid", method="spearman")


_FOLDS = """SELECT fold, count(*) AS n, sum(y) AS pathologic, avg(y) AS prevalence, count(DISTINCT grp) AS families,
  avg(CASE WHEN valid THEN 1 ELSE 0 END) AS valid_fraction FROM fx_wide GROUP BY fold"""


@query("a16_fold_summary", "fold:i n:i pathologic:i prevalence:d families:i valid_fraction:d", _FOLDS, "fx_wide")
def _(spark, sf):
    return p.fold_summary(fx.wide_predictions(spark, sf), "fold", "y", "grp", "valid")


_PEN = """SELECT sum(sqrt(total) * dev) / sum(sqrt(total)) AS penalty FROM (SELECT grp, max(total) AS total, sum(abs(c / total - 0.2)) / 5 AS dev FROM (
  SELECT g.grp, f.fold, CAST(g.total AS DOUBLE) AS total, coalesce(c, 0) AS c FROM (SELECT grp, count(*) AS total FROM fx_wide GROUP BY grp) g
  CROSS JOIN (SELECT unnest(range(5)) AS fold) f LEFT JOIN (SELECT grp, fold, count(*) AS c FROM fx_wide GROUP BY grp, fold) k ON k.grp = g.grp AND k.fold = f.fold) GROUP BY grp)"""


@query(
    "a17_fold_balance_score",
    "score:d folds:i",
    f"""SELECT stddev_pop(n) / greatest(avg(n), 1) + 2.5 * stddev_pop(prevalence) + 0.25 * stddev_pop(families) / greatest(avg(families), 1)
        + 0.75 * stddev_pop(valid_fraction) AS score, count(*) AS folds FROM ({_FOLDS})""",
    "fx_wide",
)
def _(spark, sf):
    return p.group_balance_score(p.fold_summary(fx.wide_predictions(spark, sf), "fold", "y", "grp", "valid"))


@query(
    "a17_patient_balance_score",
    "score:d penalty:d",
    f"""SELECT 3 * s.p + 1.5 * s.v + t.penalty AS score, t.penalty FROM (SELECT stddev_pop(prevalence) AS p, stddev_pop(valid_fraction) AS v FROM ({_FOLDS})) s
        CROSS JOIN ({_PEN}) t""",
    "fx_wide",
)
def _(spark, sf):
    return p.patient_balance_score(fx.wide_predictions(spark, sf), "fold", "y", "grp", "valid", 5)


@query("a18_family_penalty", "penalty:d", _PEN, "fx_wide")
def _(spark, sf):
    return p.family_penalty(fx.wide_predictions(spark, sf), "fold", "grp", 5)


@query(
    "a19_histogram_entropy",
    "event_type:s n:i entropy:d",
    """SELECT event_type, sum(c) AS n, greatest(log2(sum(c)) - sum(c * log2(c)) / sum(c), 0) AS entropy FROM (
       SELECT event_type, b, CAST(count(*) AS DOUBLE) AS c FROM (SELECT event_type, coalesce(least(floor((value - lo) / nullif(hi - lo, 0) * 64), 63), 0) AS b FROM (
       SELECT event_type, value, min(value) OVER (PARTITION BY event_type) AS lo, max(value) OVER (PARTITION BY event_type) AS hi FROM events)) GROUP BY event_type, b) GROUP BY event_type""",
)
def _(spark, sf):
    return p.histogram_entropy(fx.table(spark, sf, "events"), ["event_type"], "value", 64)


_PS = [0.01, 0.05, 0.5, 0.9, 0.995]


@query(
    "a20_percentile_profile",
    "l_returnflag:s mean:d std:d energy:d mad:d p0:d p1:d p2:d p3:d p4:d",
    "SELECT l_returnflag, avg(v) AS mean, stddev_pop(v) AS std, avg(v * v) AS energy, median(abs(v - med)) AS mad, "
    + ", ".join(f"quantile_cont(v, {q}) AS p{i}" for i, q in enumerate(_PS))
    + " FROM (SELECT l_returnflag, l_extendedprice / 1000 AS v, median(l_extendedprice / 1000) OVER (PARTITION BY l_returnflag) AS med FROM lineitem) GROUP BY l_returnflag",
)
def _(spark, sf):
    li = fx.table(spark, sf, "lineitem").select("l_returnflag", (C("l_extendedprice") / 1000).alias("v"))
    return p.percentile_profile(li, ["l_returnflag"], "v", _PS)


@query(
    "a21_parameter_centers",
    "run_key:s study:s top:i depth:d rate:s",
    """SELECT run_key, study, count(*) AS top, median(CAST(json_extract_string(params_json, '$.depth') AS DOUBLE)) AS depth,
       (SELECT r FROM (SELECT json_extract_string(u.params_json, '$.rate') AS r, count(*) AS c FROM top u WHERE u.run_key = t.run_key AND u.study = t.study GROUP BY 1) ORDER BY c DESC, r LIMIT 1) AS rate
       FROM top t GROUP BY run_key, study""".join(
        [
            "WITH top AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY run_key, study ORDER BY value, number) AS rn, count(*) OVER (PARTITION BY run_key, study) AS n FROM fx_trials WHERE value IS NOT NULL) WHERE rn <= greatest(2, ceil(n * 0.5))) ",
            "",
        ]
    ),
    "fx_trials",
)
def _(spark, sf):
    keys = ["run_key", "study"]
    top = p.best_half(fx.trials(spark, sf), keys, "value", "number")
    top = explode_params(top, "params_json", ["depth", "rate"])
    n = top.groupBy(*keys).agg(F.count(F.lit(1)).alias("top"))
    numeric = top.select(*keys, C("param__depth").try_cast("double").alias("depth"))
    depth = p.wide_quantiles(numeric, keys, ["depth"], {"med": 0.5}).withColumnRenamed("med_depth", "depth")
    return n.join(depth, keys).join(p.mode_by(top, keys, "param__rate", "rate"), keys)


_BY_GROUP = f"SELECT model, grp, count(*) AS n, avg({LOSS}) AS loss FROM fx_predictions GROUP BY model, grp"


@query(
    "a22_worst_group",
    "model:s worst_loss:d groups:i",
    f"SELECT model, max(loss) AS worst_loss, count(*) AS groups FROM ({_BY_GROUP}) WHERE n >= 10 GROUP BY model",
    "fx_predictions",
)
def _(spark, sf):
    m = fx.predictions(spark, sf).groupBy("model", "grp").agg(
        F.count(F.lit(1)).alias("n"), F.avg(row_log_loss(C("y"), C("prob"))).alias("loss")
    )
    return p.worst_group(m, ["model"], "loss", 10)


@query(
    "a23_error_concentration",
    "model:s fraction:d loss_share:d",
    f"""SELECT model, fraction, sum(CASE WHEN rn <= ceil(n * fraction) THEN loss END) / sum(loss) AS loss_share FROM (
        SELECT model, loss, row_number() OVER (PARTITION BY model ORDER BY loss DESC) AS rn, count(*) OVER (PARTITION BY model) AS n FROM (SELECT model, {LOSS} AS loss FROM fx_predictions))
        CROSS JOIN (SELECT unnest([CAST(0.01 AS DOUBLE), 0.05, 0.1, 0.2]) AS fraction) GROUP BY model, fraction""",
    "fx_predictions",
)
def _(spark, sf):
    return p.error_concentration(fx.predictions(spark, sf), ["model"], "y", "prob", [0.01, 0.05, 0.1, 0.2])


@query(
    "a24_disagreement_groups",
    "disagree:b n:i prevalence:d loss_a:d loss_b:d",
    """SELECT (m_a >= 0.5) <> (m_b >= 0.5) AS disagree, count(*) AS n, avg(y) AS prevalence, avg(-(y * ln(m_a) + (1 - y) * ln(1 - m_a))) AS loss_a,
       avg(-(y * ln(m_b) + (1 - y) * ln(1 - m_b))) AS loss_b FROM fx_wide GROUP BY 1""",
    "fx_wide",
)
def _(spark, sf):
    return p.disagreement_groups(fx.wide_predictions(spark, sf), "y", "m_a", "m_b")


@query(
    "a25_feature_audit",
    "feature:s missing_share:d n_distinct:i std:d kept:b",
    " UNION ALL ".join(
        f"SELECT '{c}' AS feature, (count(*) - count({c})) / CAST(count(*) AS DOUBLE) AS missing_share, count(DISTINCT {c}) AS n_distinct, stddev_samp({c}) AS std, (count(*) - count({c})) / CAST(count(*) AS DOUBLE) <= 0.05 AS kept FROM fx_cohort"
        for c in ["f1", "f2", "f3"]
    ),
    "fx_cohort",
)
def _(spark, sf):
    return p.feature_audit(fx.cohort(spark, sf), ["f1", "f2", "f3"], 0.05)


@query(
    "a26_network_ranking",
    "study:s best:d mean:d std:d n:i",
    "SELECT study, min(value) AS best, avg(value) AS mean, stddev_samp(value) AS std, count(value) AS n FROM fx_trials WHERE value IS NOT NULL GROUP BY study",
    "fx_trials",
)
def _(spark, sf):
    return p.network_ranking(fx.trials(spark, sf), ["study"], "value")


@query(
    "a33_efficiency",
    "study:s n:i minutes:d best:d",
    "SELECT study, count(*) AS n, sum(duration) / 60 AS minutes, min(value) AS best FROM fx_trials WHERE state = 'COMPLETE' AND duration > 0 GROUP BY study",
    "fx_trials",
)
def _(spark, sf):
    return p.efficiency(fx.trials(spark, sf), ["study"], "value", "duration", "state")


@query(
    "a34_histogram",
    "model:s y:i bin:i n:i",
    "SELECT model, y, CAST(least(floor(prob * 20), 19) AS INT) AS bin, count(*) AS n FROM fx_predictions GROUP BY ALL",
    "fx_predictions",
)
def _(spark, sf):
    return p.histogram(fx.predictions(spark, sf), "prob", 20, ["model", "y"], 0.0, 1.0)


@query(
    "a35_progress_matrix",
    "model:s fold_0:d fold_1:d fold_2:d fold_3:d fold_4:d",
    f"SELECT model, {', '.join(f'avg(CASE WHEN fold = {k} THEN {LOSS} END) AS fold_{k}' for k in range(5))} FROM fx_predictions GROUP BY model",
    "fx_predictions",
)
def _(spark, sf):
    x = fx.predictions(spark, sf).withColumn("loss", row_log_loss(C("y"), C("prob")))
    return p.progress_matrix(x, ["model"], "fold", "loss", range(5))


@query(
    "a36_select_epochs",
    "outer_fold:i epochs:i",
    """SELECT outer_fold, greatest(CAST(round_even(median(e), 0) AS INT), 2) AS epochs FROM (SELECT user_id % 5 AS outer_fold, user_id AS u, arg_min(event_id % 40, (value, event_id)) AS e
       FROM events GROUP BY user_id) GROUP BY outer_fold""",
)
def _(spark, sf):
    e = fx.table(spark, sf, "events")
    best = e.groupBy("user_id").agg(F.min_by(C("event_id") % 40, F.struct("value", "event_id")).alias("epoch"))
    return p.select_epochs(best.select((C("user_id") % 5).alias("outer_fold"), "epoch"), "outer_fold", "epoch", 2)
