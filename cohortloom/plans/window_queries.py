"""Window queries on trial logs, learning histories and predictions."""

from __future__ import annotations

from pyspark.sql import functions as F

from cohortloom.functions.scalar import row_log_loss
from cohortloom.operators import windows as w
from cohortloom.plans import fixtures as fx
from cohortloom.registry import query

C = F.col
LOG = ["run_key", "trajectory"]


@query(
    "w01_best_so_far",
    "run_key:s study:s number:i best_so_far:d",
    """SELECT run_key, study, number, min(CASE WHEN state = 'COMPLETE' THEN value END) OVER (PARTITION BY run_key, study ORDER BY number) AS best_so_far FROM fx_trials""",
    "fx_trials",
)
def _(spark, sf):
    return w.best_so_far(fx.trials(spark, sf), ["run_key", "study"], "number", "state", "value")


@query(
    "w02_running_best",
    "run_key:s trajectory:i epoch:i running_best:d",
    """SELECT run_key, trajectory, epoch, CASE WHEN valid_loss IS NOT NULL THEN min(valid_loss) OVER (PARTITION BY run_key, trajectory ORDER BY epoch) END AS running_best FROM fx_histories""",
    "fx_histories",
)
def _(spark, sf):
    return w.running_best(fx.histories(spark, sf), LOG, "epoch", "valid_loss")


_AVG = "rank() OVER (PARTITION BY {k} ORDER BY {c}) + (count(*) OVER (PARTITION BY {k}, {c}) - 1) / CAST(2 AS DOUBLE)"


@query(
    "w03_pct_rank",
    "model:s uid:s pct:d",
    f"SELECT model, uid, ({_AVG.format(k='model', c='prob')}) / count(prob) OVER (PARTITION BY model) AS pct FROM fx_predictions",
    "fx_predictions",
)
def _(spark, sf):
    return w.pct_rank(fx.predictions(spark, sf), "prob", ["model"])


@query(
    "w04_avg_rank",
    "uid:s label_rank:d structure_rank:d mean_rank:d",
    f"""SELECT uid, a AS label_rank, b AS structure_rank, (a + b) / 2 AS mean_rank FROM (
        SELECT uid, {_AVG.format(k='1', c='-m_a')} AS a, {_AVG.format(k='1', c='-m_c')} AS b FROM fx_wide)""",
    "fx_wide",
)
def _(spark, sf):
    r = w.avg_rank(fx.wide_predictions(spark, sf), "m_a", descending=True, out="label_rank")
    r = w.avg_rank(r, "m_c", descending=True, out="structure_rank")
    return r.withColumn("mean_rank", (C("label_rank") + C("structure_rank")) / F.lit(2.0))


_ENDS = """SELECT run_key, trajectory, count(DISTINCT epoch) AS epochs, count(valid_loss) AS valid_points, max(epoch) AS last_epoch,
  arg_min(train_loss, epoch) AS train_first, arg_max(train_loss, epoch) AS train_last,
  arg_min(valid_loss, epoch) FILTER (valid_loss IS NOT NULL) AS valid_first, arg_max(valid_loss, epoch) FILTER (valid_loss IS NOT NULL) AS valid_last,
  min(valid_loss) AS valid_best, arg_min(epoch, (valid_loss, epoch)) FILTER (valid_loss IS NOT NULL) AS best_epoch FROM fx_histories GROUP BY run_key, trajectory"""


@query(
    "w05_curve_endpoints",
    "run_key:s trajectory:i epochs:i valid_points:i train_first:d train_last:d valid_first:d valid_last:d valid_best:d best_epoch:i train_drop:d improvement:d rebound:d epochs_after_best:i",
    f"""SELECT *, train_first - train_last AS train_drop, valid_first - valid_best AS improvement, valid_last - valid_best AS rebound,
        last_epoch - best_epoch AS epochs_after_best FROM ({_ENDS})""",
    "fx_histories",
)
def _(spark, sf):
    return w.curve_endpoints(fx.histories(spark, sf), LOG, "epoch", "train_loss", "valid_loss")


def _slope(col):
    return f"""SELECT run_key, trajectory, regr_slope({col}, epoch) AS slope FROM (SELECT *, row_number() OVER (PARTITION BY run_key, trajectory ORDER BY epoch DESC) AS rn
        FROM fx_histories WHERE {col} IS NOT NULL) WHERE rn <= 4 GROUP BY run_key, trajectory"""


@query("w06_tail_slope", "run_key:s trajectory:i slope:d", _slope("valid_loss"), "fx_histories")
def _(spark, sf):
    return w.tail_slope(fx.histories(spark, sf), LOG, "epoch", "valid_loss")


_STEP = """SELECT run_key, trajectory, stddev_pop(d) AS step_std FROM (SELECT run_key, trajectory, valid_loss - lag(valid_loss) OVER (PARTITION BY run_key, trajectory ORDER BY epoch) AS d
  FROM fx_histories WHERE valid_loss IS NOT NULL) GROUP BY run_key, trajectory"""


@query("w07_step_std", "run_key:s trajectory:i step_std:d", _STEP, "fx_histories")
def _(spark, sf):
    return w.step_std(fx.histories(spark, sf), LOG, "epoch", "valid_loss")


_DIAG = f"""SELECT *, CASE WHEN valid_points < 4 THEN '{w.FEW_POINTS}' WHEN rebound >= 0.03 AND epochs_after_best >= 2 AND train_slope < -0.001 THEN '{w.OVERFIT}'
  WHEN step_std >= 0.07 THEN '{w.UNSTABLE}' WHEN best_epoch >= last_epoch - 1 AND valid_slope < -0.002 THEN '{w.IMPROVING}'
  WHEN train_drop < 0.03 AND valid_best >= 0.67 THEN '{w.UNDERFIT}' WHEN abs(valid_slope) <= 0.003 AND rebound < 0.02 THEN '{w.PLATEAU}' ELSE '{w.MIXED}' END AS diagnosis
  FROM (SELECT e.*, e.train_first - e.train_last AS train_drop, e.valid_last - e.valid_best AS rebound, e.last_epoch - e.best_epoch AS epochs_after_best,
        t.slope AS train_slope, v.slope AS valid_slope, s.step_std FROM ({_ENDS}) e
        LEFT JOIN ({_slope('train_loss')}) t USING (run_key, trajectory) LEFT JOIN ({_slope('valid_loss')}) v USING (run_key, trajectory)
        LEFT JOIN ({_STEP}) s USING (run_key, trajectory))"""


@query(
    "w08_diagnose_curves", "run_key:s trajectory:i train_slope:d valid_slope:d step_std:d rebound:d diagnosis:s", _DIAG, "fx_histories"
)
def _(spark, sf):
    return w.diagnose_curves(fx.histories(spark, sf), LOG, "epoch", "train_loss", "valid_loss")


@query(
    "a27_trajectory_summary",
    "trajectory:i folds_observed:i mean_best:d std_best:d mean_last:d mean_rebound:d median_best_epoch:d overfit_fraction:d underfit_fraction:d unstable_fraction:d",
    f"""SELECT trajectory, count(DISTINCT run_key) AS folds_observed, avg(valid_best) AS mean_best, stddev_samp(valid_best) AS std_best, avg(valid_last) AS mean_last,
        avg(rebound) AS mean_rebound, median(best_epoch) AS median_best_epoch, avg(CASE WHEN diagnosis = '{w.OVERFIT}' THEN 1 ELSE 0 END) AS overfit_fraction,
        avg(CASE WHEN diagnosis = '{w.UNDERFIT}' THEN 1 ELSE 0 END) AS underfit_fraction, avg(CASE WHEN diagnosis = '{w.UNSTABLE}' THEN 1 ELSE 0 END) AS unstable_fraction
        FROM ({_DIAG}) GROUP BY trajectory""",
    "fx_histories",
)
def _(spark, sf):
    d = w.diagnose_curves(fx.histories(spark, sf), LOG, "epoch", "train_loss", "valid_loss")
    return w.trajectory_summary(d, ["trajectory"], "run_key")


@query(
    "w09_head_per_group",
    "grp:s model:s uid:s loss:d",
    """SELECT grp, model, uid, loss FROM (SELECT *, row_number() OVER (PARTITION BY grp, model ORDER BY loss DESC, uid) AS rn FROM (
       SELECT grp, model, uid, -(y * ln(prob) + (1 - y) * ln(1 - prob)) AS loss FROM fx_predictions)) WHERE rn <= 3""",
    "fx_predictions",
)
def _(spark, sf):
    x = fx.predictions(spark, sf).withColumn("loss", row_log_loss(C("y"), C("prob")))
    return w.head_per_group(x, ["grp", "model"], [C("loss").desc(), C("uid")], 3)


@query(
    "w10_argmin_row",
    "run_key:s study:s number:i value:d params_json:s",
    """SELECT run_key, study, number, value, params_json FROM (SELECT *, row_number() OVER (PARTITION BY run_key, study ORDER BY value, number) AS rn FROM fx_trials WHERE value IS NOT NULL) WHERE rn = 1""",
    "fx_trials",
)
def _(spark, sf):
    return w.argmin_row(fx.trials(spark, sf), ["run_key", "study"], "value", ["number"])


@query(
    "w11_drop_duplicates_keep",
    "user_id:i event_type:s event_id:i value:d",
    """SELECT user_id, event_type, event_id, value FROM (SELECT *, row_number() OVER (PARTITION BY user_id, event_type ORDER BY ts DESC, event_id DESC) AS rn FROM events) WHERE rn = 1""",
)
def _(spark, sf):
    return w.drop_duplicates_keep(fx.table(spark, sf, "events"), ["user_id", "event_type"], ["ts", "event_id"], "last")


@query(
    "w12_ordinal_rank",
    "c_custkey:i rank:i",
    "SELECT c_custkey, row_number() OVER (ORDER BY c_acctbal, c_custkey) AS rank FROM customer",
)
def _(spark, sf):
    return w.ordinal_rank(fx.table(spark, sf, "customer"), "c_acctbal", ["c_custkey"])


@query(
    "w13_rank_within_mask",
    "uid:i z:i y_:i x:i rank:d",
    """SELECT uid, z, y_, x, CASE WHEN m THEN (rank() OVER (PARTITION BY uid, m ORDER BY v) + (count(*) OVER (PARTITION BY uid, m, v) - 1) / CAST(2 AS DOUBLE)) / count(*) OVER (PARTITION BY uid, m) ELSE 0 END AS rank FROM fx_voxels""",
    "fx_voxels",
)
def _(spark, sf):
    return w.rank_within_mask(fx.voxels(spark, sf), "uid", "v", "m")


@query(
    "w14_share_of_total",
    "l_orderkey:i l_linenumber:i share:d",
    "SELECT l_orderkey, l_linenumber, l_extendedprice / sum(l_extendedprice) OVER (PARTITION BY l_orderkey) AS share FROM lineitem",
)
def _(spark, sf):
    li = fx.table(spark, sf, "lineitem").select("l_orderkey", "l_linenumber", "l_extendedprice")
    return w.share_of_total(li, ["l_orderkey"], "l_extendedprice")


@query(
    "w15_family_size",
    "uid:s family_size:i is_rare:b",
    "SELECT uid, count(*) OVER (PARTITION BY shape_x, spacing) AS family_size, count(*) OVER (PARTITION BY shape_x, spacing) < 160 AS is_rare FROM fx_cohort",
    "fx_cohort",
)
def _(spark, sf):
    c = fx.cohort(spark, sf).select("uid", F.concat_ws("|", "shape_x", "spacing").alias("family"))
    return w.family_size(c, "family", 160)


@query(
    "w16_step_number",
    "run_key:s trajectory:i epoch:i step:i",
    "SELECT run_key, trajectory, epoch, row_number() OVER (PARTITION BY run_key, trajectory ORDER BY epoch) AS step FROM fx_histories",
    "fx_histories",
)
def _(spark, sf):
    return w.step_number(fx.histories(spark, sf), LOG, "epoch")


@query(
    "w17_newest_per_group",
    "o_custkey:i o_orderkey:i o_totalprice:d",
    "SELECT o_custkey, o_orderkey, o_totalprice FROM (SELECT *, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderdate DESC, o_orderkey DESC) AS rn FROM orders) WHERE rn = 1",
)
def _(spark, sf):
    return w.newest_per_group(fx.table(spark, sf, "orders"), ["o_custkey"], "o_orderdate", ["o_orderkey"])
