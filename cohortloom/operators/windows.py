"""Ordered queries per group: running bests, ranks, learning-curve summaries, first/last rows.

Group minima, firsts and lasts are aggregates (merged on the map side); bounded heads use ``row_number`` with a literal
limit, which Spark prunes before the shuffle; running values use the cell-wise scan of :mod:`order`.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from cohortloom.operators.order import average_rank, null_safe, running, value_ranks

# Diagnosis names, as the log reports spell them.
FEW_POINTS = "validación insuficiente"
OVERFIT = "posible sobreajuste"
UNSTABLE = "validación inestable"
IMPROVING = "aún estaba mejorando"
UNDERFIT = "posible subajuste u optimización débil"
PLATEAU = "meseta estable"
MIXED = "señal mixta"

PRUNE_LIMIT = 1000


def best_so_far(trials: DataFrame, keys: Sequence[str], number: str, state: str, value: str) -> DataFrame:
    """Running minimum over complete trials, carried over the others."""
    done = F.when(F.col(state) == "COMPLETE", F.col(value))
    return running(trials, list(keys), number, {"best_so_far": ("min", done)})


def running_best(hist: DataFrame, keys: Sequence[str], epoch: str, value: str) -> DataFrame:
    """Running minimum of the validation loss, NULL where the current value is NULL."""
    r = running(hist, list(keys), epoch, {"_best": ("min", F.col(value))})
    return r.withColumn("running_best", F.when(F.col(value).isNotNull(), F.col("_best"))).drop("_best")


def _ranks(df: DataFrame, keys: Sequence[str], col: str, rank: Column, out: str) -> DataFrame:
    table = value_ranks(df, list(keys), col).select(*keys, col, rank.alias(out))
    return null_safe(df, table, [*keys, col], "left")


def avg_rank(df: DataFrame, col: str, keys: Sequence[str] = (), descending: bool = False, out: str = "rank") -> DataFrame:
    """Rank with ties averaged, from the largest when ``descending``; NULL has no rank."""
    up = average_rank()
    return _ranks(df, keys, col, F.col("n") + F.lit(1.0) - up if descending else up, out)


def pct_rank(df: DataFrame, col: str, keys: Sequence[str] = (), out: str = "pct") -> DataFrame:
    """Average rank over the non-null count (not SQL ``percent_rank``)."""
    return _ranks(df, keys, col, average_rank() / F.col("n"), out)


def curve_endpoints(hist: DataFrame, keys: Sequence[str], epoch: str, train: str, valid: str) -> DataFrame:
    """First, last and best losses per log; the best epoch is the first minimum."""
    e, t, v = F.col(epoch), F.col(train), F.col(valid)
    has_t, has_v = t.isNotNull(), v.isNotNull()
    first = lambda c, has: F.min(F.when(has, F.struct(e.alias("e"), c.alias("v"))))["v"]
    last = lambda c, has: F.max(F.when(has, F.struct(e.alias("e"), c.alias("v"))))["v"]
    best = F.min(F.when(has_v, F.struct(v.alias("v"), e.alias("e"))))
    g = hist.groupBy(*keys).agg(
        F.countDistinct(e).alias("epochs"),
        F.count(v).alias("valid_points"),
        F.max(e).alias("last_epoch"),
        first(t, has_t).alias("train_first"),
        last(t, has_t).alias("train_last"),
        first(v, has_v).alias("valid_first"),
        last(v, has_v).alias("valid_last"),
        best["v"].alias("valid_best"),
        best["e"].alias("best_epoch"),
    )
    return g.select(
        "*",
        (F.col("train_first") - F.col("train_last")).alias("train_drop"),
        (F.col("valid_first") - F.col("valid_best")).alias("improvement"),
        (F.col("valid_last") - F.col("valid_best")).alias("rebound"),
        (F.col("last_epoch") - F.col("best_epoch")).alias("epochs_after_best"),
    )


def tail_slope(hist: DataFrame, keys: Sequence[str], epoch: str, value: str, n: int = 4, out: str = "slope") -> DataFrame:
    """OLS slope over the last ``n`` points that have a value; NULL below two points."""
    w = Window.partitionBy(*keys).orderBy(F.col(epoch).desc())
    tail = (
        hist.where(F.col(value).isNotNull()).select(*keys, epoch, value).withColumn("_rn", F.row_number().over(w)).where(F.col("_rn") <= n)
    )
    return tail.groupBy(*keys).agg(F.regr_slope(F.col(value), F.col(epoch).cast("double")).alias(out))


def step_std(hist: DataFrame, keys: Sequence[str], epoch: str, value: str, out: str = "step_std") -> DataFrame:
    """Population SD of the differences between consecutive points."""
    kept = hist.where(F.col(value).isNotNull()).select(*keys, epoch, value)
    steps = running(kept, list(keys), epoch, {"_prev": ("prev", F.col(value))})
    return steps.groupBy(*keys).agg(F.stddev_pop(F.col(value) - F.col("_prev")).alias(out))


def diagnose_curves(hist: DataFrame, keys: Sequence[str], epoch: str, train: str, valid: str) -> DataFrame:
    """Endpoints, slopes and step SD per log with a diagnosis; the rules apply in order."""
    keys = list(keys)
    d = curve_endpoints(hist, keys, epoch, train, valid)
    for part in (
        tail_slope(hist, keys, epoch, train, out="train_slope"),
        tail_slope(hist, keys, epoch, valid, out="valid_slope"),
        step_std(hist, keys, epoch, valid),
    ):
        d = null_safe(d, part, keys, "left")
    c = F.col
    overfit = (c("rebound") >= 0.03) & (c("epochs_after_best") >= 2) & (c("train_slope") < -0.001)
    diagnosis = (
        F.when(c("valid_points") < 4, FEW_POINTS)
        .when(overfit, OVERFIT)
        .when(c("step_std") >= 0.07, UNSTABLE)
        .when((c("best_epoch") >= c("last_epoch") - 1) & (c("valid_slope") < -0.002), IMPROVING)
        .when((c("train_drop") < 0.03) & (c("valid_best") >= 0.67), UNDERFIT)
        .when((F.abs(c("valid_slope")) <= 0.003) & (c("rebound") < 0.02), PLATEAU)
        .otherwise(MIXED)
    )
    return d.withColumn("diagnosis", diagnosis)


def trajectory_summary(diag: DataFrame, keys: Sequence[str], fold: str) -> DataFrame:
    """Per trajectory over its folds: mean, SD and median of the endpoints, share of each diagnosis."""
    from cohortloom.operators.order import wide_quantiles

    share = lambda name: F.avg((F.col("diagnosis") == name).cast("double"))
    g = diag.groupBy(*keys).agg(
        F.countDistinct(fold).alias("folds_observed"),
        F.avg("valid_best").alias("mean_best"),
        F.stddev_samp("valid_best").alias("std_best"),
        F.avg("valid_last").alias("mean_last"),
        F.avg("rebound").alias("mean_rebound"),
        share(OVERFIT).alias("overfit_fraction"),
        share(UNDERFIT).alias("underfit_fraction"),
        share(UNSTABLE).alias("unstable_fraction"),
    )
    med = wide_quantiles(diag, list(keys), ["best_epoch"], {"med": 0.5})
    return null_safe(g, med.withColumnRenamed("med_best_epoch", "median_best_epoch"), list(keys), "left")


def head_per_group(df: DataFrame, keys: Sequence[str], order: Sequence[Column], n: int) -> DataFrame:
    """First ``n`` rows per group in ``order`` (end it with the key). Up to 1,000 rows Spark prunes before the shuffle."""
    w = Window.partitionBy(*keys).orderBy(*order)
    return df.withColumn("_rn", F.row_number().over(w)).where(F.col("_rn") <= n).drop("_rn")


def argmin_row(df: DataFrame, keys: Sequence[str], value: str, tie: Sequence[str]) -> DataFrame:
    """The whole row of the group minimum, as one map-side aggregate."""
    rest = [c for c in df.columns if c not in keys]
    best = F.min_by(F.struct(*rest), F.struct(value, *tie))
    kept = df.where(F.col(value).isNotNull())
    return kept.groupBy(*keys).agg(best.alias("_r")).select(*keys, *[F.col("_r")[c].alias(c) for c in rest])


def drop_duplicates_keep(df: DataFrame, keys: Sequence[str], order: Sequence[str], keep: str = "last") -> DataFrame:
    """One row per key: the first or last in ``order``."""
    rest = [c for c in df.columns if c not in keys]
    pick = F.max_by if keep == "last" else F.min_by
    return (
        df.groupBy(*keys).agg(pick(F.struct(*rest), F.struct(*order)).alias("_r")).select(*keys, *[F.col("_r")[c].alias(c) for c in rest])
    )


def ordinal_rank(df: DataFrame, value: str, tie: Sequence[str], keys: Sequence[str] = (), out: str = "rank") -> DataFrame:
    """1-based position by value, ties by the key columns."""
    return running(df, list(keys), value, {out: ("row_number", None)}, tie=list(tie))


def share_of_total(df: DataFrame, keys: Sequence[str], value: str, out: str = "share") -> DataFrame:
    """Value over its group total; the total is joined back, so a large group is not gathered in one task."""
    total = df.groupBy(*keys).agg(F.sum(value).alias("_total"))
    return null_safe(df, total, list(keys), "left").withColumn(out, F.col(value) / F.col("_total")).drop("_total")


def family_size(df: DataFrame, family: str, min_n: int = 5) -> DataFrame:
    """Group size on each row and whether the group is rare."""
    size = df.groupBy(family).agg(F.count(F.lit(1)).alias("family_size"))
    return null_safe(df, size, [family], "left").withColumn("is_rare", F.col("family_size") < min_n)


def step_number(hist: DataFrame, keys: Sequence[str], order: str, out: str = "step") -> DataFrame:
    return running(hist, list(keys), order, {out: ("row_number", None)})


def newest_per_group(df: DataFrame, keys: Sequence[str], activity: str, tie: Sequence[str]) -> DataFrame:
    """Newest row per group."""
    return drop_duplicates_keep(df, keys, [activity, *tie], "last")


def rank_within_mask(voxels: DataFrame, uid: str, value: str, mask: str, out: str = "rank") -> DataFrame:
    """Average rank over n inside each volume's mask, 0 outside; a volume is bounded by its grid."""
    inside = Window.partitionBy(uid, mask)
    ties = Window.partitionBy(uid, mask, value)
    rank = F.rank().over(inside.orderBy(value)) + (F.count(F.lit(1)).over(ties) - 1) / F.lit(2.0)
    return voxels.withColumn(out, F.when(F.col(mask), rank / F.count(F.lit(1)).over(inside)).otherwise(F.lit(0.0)))
