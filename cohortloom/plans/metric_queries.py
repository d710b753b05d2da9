"""Evaluation queries on prediction tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from cohortloom.functions.keyed import poisson_weight_sql
from cohortloom.functions.scalar import logit, row_log_loss
from cohortloom.operators import metrics as e
from cohortloom.operators import resample as r
from cohortloom.plans import fixtures as fx
from cohortloom.registry import query

C = F.col
MODELS = ["m_a", "m_b", "m_c"]
LOSS = "-(y * ln(prob) + (1 - y) * ln(1 - prob))"


def ece_bin_sql(p):
    return "(" + " + ".join(f"CAST({p} >= CAST({x!r} AS DOUBLE) AS INT)" for x in e.ECE_EDGES) + ")"


def metrics_sql(source, keys, extra=""):
    """Metrics by group in plain SQL: average ranks by window, calibration error by bin."""
    k = ", ".join(keys)
    on = " AND ".join(f"t.{c} = u.{c}" for c in keys)
    return f"""SELECT t.*, u.ece FROM (
      SELECT {k}, count(*) AS n, sum(y) AS pos, avg({LOSS}) AS log_loss, avg((prob - y) * (prob - y)) AS brier,
        CASE WHEN sum(y) > 0 AND sum(1 - y) > 0 THEN (sum(CASE WHEN y = 1 THEN rk END) - sum(y) * (sum(y) + 1) / CAST(2 AS DOUBLE)) / (sum(y) * sum(1 - y)) END AS auc,
        (coalesce(avg(CASE WHEN y = 1 THEN CASE WHEN prob >= 0.5 THEN 1 ELSE 0 END END), 0) + coalesce(avg(CASE WHEN y = 0 THEN CASE WHEN prob < 0.5 THEN 1 ELSE 0 END END), 0))
          / (CASE WHEN sum(y) > 0 THEN 1 ELSE 0 END + CASE WHEN sum(1 - y) > 0 THEN 1 ELSE 0 END) AS balanced_accuracy
      FROM (SELECT *, rank() OVER (PARTITION BY {k} ORDER BY prob) + (count(*) OVER (PARTITION BY {k}, prob) - 1) / CAST(2 AS DOUBLE) AS rk FROM {source}) GROUP BY {k}) t
      JOIN (SELECT {k}, sum(abs(sp - sy)) / sum(c) AS ece FROM (SELECT {k}, {ece_bin_sql('prob')} AS eb, sum(prob) AS sp, sum(y) AS sy, count(*) AS c FROM {source} GROUP BY {k}, eb) GROUP BY {k}) u
      ON {on} {extra}"""


ALL = "n:i pos:i log_loss:d brier:d auc:d balanced_accuracy:d ece:d"


@query("e01_log_loss", "model:s log_loss:d", f"SELECT model, avg({LOSS}) AS log_loss FROM fx_predictions GROUP BY model", "fx_predictions")
def _(spark, sf):
    return e.log_loss(fx.predictions(spark, sf), ["model"], "y", "prob")


@query("e02_brier", "model:s brier:d", "SELECT model, avg((prob - y) * (prob - y)) AS brier FROM fx_predictions GROUP BY model", "fx_predictions")
def _(spark, sf):
    return e.brier(fx.predictions(spark, sf), ["model"], "y", "prob")


@query("e03_auc", "model:s auc:d", metrics_sql("fx_predictions", ["model"]), "fx_predictions")
def _(spark, sf):
    return e.auc(fx.predictions(spark, sf), ["model"], "y", "prob")


@query("e04_balanced_accuracy", "model:s balanced_accuracy:d", metrics_sql("fx_predictions", ["model"]), "fx_predictions")
def _(spark, sf):
    return e.balanced_accuracy(fx.predictions(spark, sf), ["model"], "y", "prob")


@query("e05_ece", "model:s ece:d", metrics_sql("fx_predictions", ["model"]), "fx_predictions")
def _(spark, sf):
    return e.ece(fx.predictions(spark, sf), ["model"], "y", "prob")


@query("e06_binary_metrics", f"model:s {ALL}", metrics_sql("fx_predictions", ["model"]), "fx_predictions")
def _(spark, sf):
    return e.binary_metrics(fx.predictions(spark, sf), ["model"], "y", "prob")


@query("e06_binary_metrics_large", f"model:s {ALL}", metrics_sql("fx_big", ["model"]), "fx_big")
def _(spark, sf):
    return e.binary_metrics(fx.big_predictions(spark, sf), ["model"], "y", "prob")


@query("e07_subgroup_audit", f"model:s grp:s {ALL}", metrics_sql("fx_predictions", ["model", "grp"], "WHERE n >= 10"), "fx_predictions")
def subgroup_audit(spark, sf):
    return e.subgroup_audit(fx.predictions(spark, sf), ["model", "grp"], "y", "prob", 10)


@query(
    "e07_subgroup_audit_large",
    f"model:s grp:i {ALL}",
    metrics_sql("fx_big", ["model", "grp"], "WHERE n >= 10 AND auc IS NOT NULL"),
    "fx_big",
)
def _(spark, sf):
    return e.subgroup_audit(fx.big_predictions(spark, sf), ["model", "grp"], "y", "prob", 10, both_classes=True)


@query(
    "e08_subset_metrics",
    "model:s valid:b n:i log_loss:d brier:d",
    f"SELECT model, valid, n, CASE WHEN auc IS NOT NULL THEN log_loss END AS log_loss, CASE WHEN auc IS NOT NULL THEN brier END AS brier FROM ({metrics_sql('fx_predictions', ['model', 'valid'])})",
    "fx_predictions",
)
def _(spark, sf):
    return e.subset_metrics(fx.predictions(spark, sf), ["model"], "valid", "y", "prob")


@query(
    "e09_reliability_points",
    "model:s bin:i mean_probability:d observed_fraction:d n:i",
    """WITH ed AS (SELECT model, list_distinct(list_filter([q1, q2, q3, q4, q5, q6, q7, q8, q9], lambda v: v > mn)) AS cuts FROM (SELECT model, min(prob) AS mn, """
    + ", ".join(f"quantile_cont(prob, {i} / CAST(10 AS DOUBLE)) AS q{i}" for i in range(1, 10))
    + """ FROM fx_predictions GROUP BY model))
    SELECT p.model, len(list_filter(cuts, lambda c: c < prob)) AS bin, avg(prob) AS mean_probability, avg(y) AS observed_fraction, count(*) AS n
    FROM fx_predictions p JOIN ed ON ed.model = p.model GROUP BY 1, 2""",
    "fx_predictions",
)
def _(spark, sf):
    return e.reliability_points(fx.predictions(spark, sf), ["model"], "y", "prob", 10)


_PAIRS = [("m_a", "m_b"), ("m_a", "m_c"), ("m_b", "m_c")]


@query(
    "e10_pair_complementarity",
    "a:s b:s correlation:d mean_abs_diff:d disagreement:d n:i",
    " UNION ALL ".join(
        f"SELECT '{a}' AS a, '{b}' AS b, corr({a}, {b}) AS correlation, avg(abs({a} - {b})) AS mean_abs_diff, avg(CASE WHEN ({a} >= 0.5) <> ({b} >= 0.5) THEN 1 ELSE 0 END) AS disagreement, count(*) AS n FROM fx_wide"
        for a, b in _PAIRS
    ),
    "fx_wide",
)
def _(spark, sf):
    return e.pair_complementarity(fx.wide_predictions(spark, sf), MODELS)


_PAIR_ROWS = "(" + " UNION ALL ".join(f"SELECT '{a}' AS a, '{b}' AS b, y, ({a} + {b}) / 2 AS prob, {a} - y AS ra, {b} - y AS rb FROM fx_wide" for a, b in _PAIRS) + ")"


@query(
    "e11_pair_ensembles",
    f"a:s b:s {ALL} residual_correlation:d",
    f"SELECT m.*, c.residual_correlation FROM ({metrics_sql(_PAIR_ROWS, ['a', 'b'])}) m JOIN (SELECT a, b, corr(ra, rb) AS residual_correlation FROM {_PAIR_ROWS} GROUP BY a, b) c ON m.a = c.a AND m.b = c.b",
    "fx_wide",
)
def _(spark, sf):
    return e.pair_ensembles(fx.wide_predictions(spark, sf), "y", MODELS)


@query(
    "e12_weight_sweep",
    "weight:d log_loss:d",
    """SELECT i / CAST(100 AS DOUBLE) AS weight, avg(-(y * ln(p) + (1 - y) * ln(1 - p))) AS log_loss FROM (
       SELECT y, i, i / CAST(100 AS DOUBLE) * m_a + (1 - i / CAST(100 AS DOUBLE)) * m_b AS p FROM fx_wide CROSS JOIN (SELECT unnest(range(101)) AS i)) GROUP BY i""",
    "fx_wide",
)
def _(spark, sf):
    return e.weight_sweep(fx.wide_predictions(spark, sf), "y", "m_a", "m_b")


def _boot_sql(source, keys, key, total, count, draws, seed):
    k = "".join(f"{c}, " for c in keys)
    # One MD5 serves four replicates.
    part = f"substr(md5(concat('{seed}|', CAST(draw // 4 AS VARCHAR), '|', CAST({key} AS VARCHAR))), 1 + 8 * (draw % 4), 8)"
    w = poisson_weight_sql(f"(CAST(CAST(concat('0x', {part}) AS BIGINT) AS DOUBLE) / 4294967296)")
    return f"""SELECT {k} quantile_cont(value, 0.025) AS ci_low, quantile_cont(value, 0.975) AS ci_high, avg(CASE WHEN value > 0 THEN 1 ELSE 0 END) AS share_positive, count(value) AS draws
      FROM (SELECT {k} draw, sum(w * t) / nullif(sum(w * c), 0) AS value FROM (SELECT {k} draw, {total} AS t, {count} AS c, {w} AS w FROM {source} CROSS JOIN (SELECT unnest(range({draws})) AS draw)) GROUP BY {k} draw)
      GROUP BY {', '.join(keys) if keys else 'ALL'}"""


_LOSSES = f"(SELECT model, uid, grp, {LOSS} AS loss FROM fx_predictions)"


@query(
    "e13_bootstrap_mean_ci",
    "model:s mean:d n:i ci_low:d ci_high:d draws:i",
    f"SELECT o.model, o.mean, o.n, b.ci_low, b.ci_high, b.draws FROM (SELECT model, avg(loss) AS mean, count(*) AS n FROM {_LOSSES} GROUP BY model) o JOIN ({_boot_sql(_LOSSES, ['model'], 'uid', 'loss', 1, 2000, 11)}) b ON o.model = b.model",
    "fx_predictions",
)
def _(spark, sf):
    x = fx.predictions(spark, sf).withColumn("loss", row_log_loss(C("y"), C("prob")))
    return r.bootstrap_mean_ci(x, ["model"], "uid", "loss", 2000, 11)


_GAIN = "(SELECT uid, grp, -(y * ln(m_a) + (1 - y) * ln(1 - m_a)) - (-(y * ln(m_b) + (1 - y) * ln(1 - m_b))) AS gain FROM fx_wide)"


@query(
    "e14_paired_bootstrap",
    "mean:d n:i ci_low:d ci_high:d share_positive:d draws:i",
    f"SELECT * FROM (SELECT avg(gain) AS mean, count(*) AS n FROM {_GAIN}) CROSS JOIN ({_boot_sql(_GAIN, [], 'uid', 'gain', 1, 2000, 12)})",
    "fx_wide",
)
def _(spark, sf):
    x = fx.wide_predictions(spark, sf)
    x = x.select("uid", row_log_loss(C("y"), C("m_a")).alias("a"), row_log_loss(C("y"), C("m_b")).alias("b"))
    return r.paired_bootstrap(x, [], "uid", "a", "b", 2000, 12)


_CLUSTER = f"(SELECT grp, sum(gain) AS t0, count(*) AS c0 FROM {_GAIN} GROUP BY grp)"


@query(
    "e15_cluster_bootstrap",
    "mean:d n:i clusters:i ci_low:d ci_high:d share_positive:d draws:i",
    f"SELECT * FROM (SELECT sum(t0) / sum(c0) AS mean, sum(c0) AS n, count(*) AS clusters FROM {_CLUSTER}) CROSS JOIN ({_boot_sql(_CLUSTER, [], 'grp', 't0', 'c0', 2000, 13)})",
    "fx_wide",
)
def _(spark, sf):
    x = fx.wide_predictions(spark, sf)
    x = x.withColumn("gain", row_log_loss(C("y"), C("m_a")) - row_log_loss(C("y"), C("m_b")))
    return r.cluster_bootstrap(x, [], "grp", "gain", 2000, 13)


@query(
    "e16_metrics_by_fold",
    "model:s fold:i n:i log_loss:d",
    f"SELECT model, fold, count(*) AS n, avg({LOSS}) AS log_loss FROM fx_predictions GROUP BY model, fold",
    "fx_predictions",
)
def _(spark, sf):
    return e.metrics_by_fold(fx.predictions(spark, sf), ["model", "fold"], "y", "prob")


@query(
    "e17_prior_baseline",
    "fold:i n:i prevalence:d prior_loss:d",
    "SELECT fold, n, p AS prevalence, -(p * ln(p) + (1 - p) * ln(1 - p)) AS prior_loss FROM (SELECT fold, count(*) AS n, avg(y) AS p FROM fx_wide GROUP BY fold)",
    "fx_wide",
)
def _(spark, sf):
    return e.prior_baseline(fx.wide_predictions(spark, sf), ["fold"], "y")


def _pct(c):
    return f"(rank() OVER (ORDER BY {c}) + (count(*) OVER (PARTITION BY {c}) - 1) / CAST(2 AS DOUBLE)) / count({c}) OVER ()"


@query(
    "e18_label_audit",
    "uid:s entropy:d disagreement:d surprise:d priority:d",
    f"""WITH a AS (SELECT uid, m_c AS review, -(p * ln(p) + (1 - p) * ln(1 - p)) AS entropy, sqrt(((m_a - p) * (m_a - p) + (m_b - p) * (m_b - p) + (m_c - p) * (m_c - p)) / 2) AS disagreement,
        -(y * ln(p) + (1 - y) * ln(1 - p)) AS surprise FROM (SELECT *, (m_a + m_b + m_c) / 3 AS p FROM fx_wide))
        SELECT *, ({_pct('surprise')} + {_pct('disagreement')} + {_pct('review')}) / 3 AS priority FROM a""",
    "fx_wide",
)
def _(spark, sf):
    x = fx.wide_predictions(spark, sf)
    x = x.withColumn("p", (C("m_a") + C("m_b") + C("m_c")) / F.lit(3.0)).withColumn("review", C("m_c"))
    return e.label_audit(x, "uid", "y", "p", MODELS, "review")


@query(
    "e19_review_score",
    "uid:s technical_rank:d biological_rank:d registration_risk:d review_score:d",
    f"""SELECT uid, t AS technical_rank, b AS biological_rank, r AS registration_risk, (t + b + r + bg) / 4 AS review_score FROM (
        SELECT uid, {_pct('m_a')} AS t, ({_pct('m_b')} + {_pct('m_c')}) / 2 AS b,
          CASE WHEN reg IS NULL THEN 1 ELSE 1 - (rank() OVER (PARTITION BY reg IS NULL ORDER BY reg) + (count(*) OVER (PARTITION BY reg) - 1) / CAST(2 AS DOUBLE)) / count(reg) OVER () END AS r,
          CASE WHEN valid THEN 0 ELSE 1 END AS bg FROM (SELECT *, CASE WHEN fold <> 2 THEN m_b * m_a END AS reg FROM fx_wide))""",
    "fx_wide",
)
def _(spark, sf):
    x = fx.wide_predictions(spark, sf).select(
        "uid", "m_a", "m_b", "m_c", F.when(C("fold") != 2, C("m_b") * C("m_a")).alias("reg"), (~C("valid")).cast("double").alias("bg")
    )
    return e.review_score(x, "uid", "m_a", ["m_b", "m_c"], "reg", "bg")


@query(
    "e20_case_review",
    "uid:s y:i loss_a:d blend_loss:d both_wrong:b",
    """SELECT uid, y, -(y * ln(m_a) + (1 - y) * ln(1 - m_a)) AS loss_a, -(y * ln(p) + (1 - y) * ln(1 - p)) AS blend_loss,
       (m_a > 0.8 AND m_b > 0.8 AND y = 0) OR (m_a < 0.2 AND m_b < 0.2 AND y = 1) AS both_wrong FROM (SELECT *, (m_a + m_b) / 2 AS p FROM fx_wide) ORDER BY 4 DESC, uid LIMIT 40""",
    "fx_wide",
)
def _(spark, sf):
    return e.case_review(fx.wide_predictions(spark, sf), "uid", "y", "m_a", "m_b", 40)


@query(
    "e21_promotion_rule",
    "candidate:s variant:s architecture:s loss:d valid_loss:d passed:b",
    f"""WITH m AS (SELECT concat(model, '-', CAST(fold AS VARCHAR)) AS candidate, CASE model WHEN 'm_a' THEN 'plain' WHEN 'm_b' THEN 'special' ELSE 'other' END AS variant,
          CASE WHEN fold = 4 AND model <> 'm_b' THEN '3d' WHEN fold = 4 THEN 'graph' WHEN fold < 2 THEN '2.5d' ELSE '3d' END AS architecture, avg({LOSS}) AS loss, avg(CASE WHEN valid THEN {LOSS} END) AS valid_loss FROM fx_predictions GROUP BY model, fold),
        r AS (SELECT *, row_number() OVER (PARTITION BY architecture ORDER BY loss, candidate) AS rn, row_number() OVER (ORDER BY loss, candidate) AS ra FROM m WHERE variant <> 'special')
        SELECT m.*, CASE WHEN m.variant <> 'special' THEN true ELSE coalesce(m.valid_loss < coalesce(b.valid_loss, a.valid_loss) AND m.loss <= coalesce(b.loss, a.loss) + 0.005, false) END AS passed
        FROM m LEFT JOIN r b ON b.architecture = m.architecture AND b.rn = 1 CROSS JOIN (SELECT * FROM r WHERE ra = 1) a""",
    "fx_predictions",
)
def _(spark, sf):
    loss = row_log_loss(C("y"), C("prob"))
    arch = (
        F.when((C("fold") == 4) & (C("model") != "m_b"), "3d").when(C("fold") == 4, "graph").when(C("fold") < 2, "2.5d").otherwise("3d")
    )
    m = fx.predictions(spark, sf).groupBy("model", "fold").agg(
        F.avg(loss).alias("loss"), F.avg(F.when(C("valid"), loss)).alias("valid_loss")
    )
    m = m.select(
        F.concat_ws("-", "model", "fold").alias("candidate"),
        F.when(C("model") == "m_a", "plain").when(C("model") == "m_b", "special").otherwise("other").alias("variant"),
        arch.alias("architecture"), "loss", "valid_loss",
    )
    return e.promotion_rule(m, "candidate", "variant", "special", "architecture", "loss", "valid_loss")


@query(
    "e22_model_inventory",
    f"model:s {ALL} fold_agreement:d confident_wrong:i max_logit_error:d",
    f"""SELECT m.*, x.* EXCLUDE (model) FROM ({metrics_sql('fx_predictions', ['model'])}) m JOIN (
        SELECT model, avg(CASE WHEN fold = CASE WHEN CAST(uid AS INT) % 3 = 0 THEN 0 ELSE fold END THEN 1 ELSE 0 END) AS fold_agreement,
        sum(CASE WHEN (prob > 0.9 AND y = 0) OR (prob < 0.1 AND y = 1) THEN 1 ELSE 0 END) AS confident_wrong,
        max(abs(1 / (1 + exp(-round(ln(prob / (1 - prob)), 3))) - prob)) AS max_logit_error FROM fx_predictions GROUP BY model) x ON x.model = m.model""",
    "fx_predictions",
)
def _(spark, sf):
    x = fx.predictions(spark, sf).withColumn("logit", F.round(logit(C("prob")), 3))
    canon = x.where(C("model") == "m_a").select("uid", F.when(C("uid").cast("int") % 3 == 0, 0).otherwise(C("fold")).alias("fold"))
    return e.model_inventory(x, "model", "uid", "y", "prob", "fold", canon, "logit")


@query(
    "e24_oof_complete",
    "model:s rows:i keys:i complete:b",
    """SELECT model, count(*) AS rows, count(DISTINCT uid) AS keys, count(*) = count(DISTINCT uid) AND count(DISTINCT uid) = (SELECT count(*) FROM labels) AS complete
       FROM (SELECT model, uid FROM fx_predictions WHERE NOT (model = 'm_b' AND fold = 2) UNION ALL SELECT model, uid FROM fx_predictions WHERE model = 'm_c' AND fold = 1) GROUP BY model""",
    "fx_predictions",
)
def _(spark, sf):
    x = fx.predictions(spark, sf)
    damaged = x.where(~((C("model") == "m_b") & (C("fold") == 2))).select("model", "uid")
    damaged = damaged.unionByName(x.where((C("model") == "m_c") & (C("fold") == 1)).select("model", "uid"))
    return e.oof_complete(damaged, "model", "uid", fx.table(spark, sf, "labels").count())


@query(
    "e25_ensemble_predict",
    "uid:s p_mean:d p_std:d p_fold_0:d p_fold_1:d p_fold_2:d",
    """SELECT uid, avg(s) AS p_mean, stddev_pop(s) AS p_std, max(CASE WHEN model = 'm_a' THEN s END) AS p_fold_0, max(CASE WHEN model = 'm_b' THEN s END) AS p_fold_1,
       max(CASE WHEN model = 'm_c' THEN s END) AS p_fold_2 FROM (SELECT uid, model, 1 / (1 + exp(-ln(prob / (1 - prob)) / CAST(1.23449 AS DOUBLE))) AS s FROM fx_predictions) GROUP BY uid""",
    "fx_predictions",
)
def _(spark, sf):
    member = F.when(C("model") == "m_a", 0).when(C("model") == "m_b", 1).otherwise(2)
    x = fx.predictions(spark, sf).select("uid", member.alias("fold"), logit(C("prob")).alias("logit"))
    return e.ensemble_predict(x, "uid", "fold", "logit", 1.23449, range(3))
