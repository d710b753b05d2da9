"""Calibration: temperature, Platt and beta maps fitted for many groups at once.

A fit is a convex problem with at most three weights. Rows that agree in group, fold, label and probability are merged with
their count first. Each solver step is one aggregation that gives gradient and Hessian sums of every fit together; the
state of the solver is a table with a row per fit, so neither groups nor folds pass through the driver, which only asks
whether a fit is still open. For cross-fitting, a row joins every fit of its group that holds out another fold.
"""

from __future__ import annotations

import itertools
import math
from collections.abc import Sequence

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from cohortloom.functions.scalar import clip_probability, logit, sigmoid
from cohortloom.session import cut

# Bounds, anchors and ridge weight of the calibration maps.
BETA_LOW, BETA_HIGH = 0.05, 20.0
SHIFT = 3.0
RIDGE = 0.002
ANCHORS = {"platt": (1.0, 0.0), "beta": (1.0, 1.0, 0.0)}
BOUNDS = {
    "platt": ((BETA_LOW, BETA_HIGH), (-SHIFT, SHIFT)),
    "beta": ((BETA_LOW, BETA_HIGH), (BETA_LOW, BETA_HIGH), (-SHIFT, SHIFT)),
}
STEPS = 60
TOLERANCE = 1e-10


def _softplus(z: Column) -> Column:
    return F.greatest(z, F.lit(0.0)) + F.log1p(F.exp(-F.abs(z)))


def _expit(z: Column) -> Column:
    e = F.exp(-F.abs(z))
    return F.when(z >= 0, F.lit(1.0) / (F.lit(1.0) + e)).otherwise(e / (F.lit(1.0) + e))


class _Fits:
    """Training rows of every fit, equal ones merged, and a row per fit: its group and, when cross-fitting, its held-out fold.

    The state of the solver is a table with one row per fit. It joins the rows by their group; Spark ships it where it has
    measured it to be small, and the sums are combined on the map side.
    """

    def __init__(self, rows: DataFrame, keys: Sequence[str], fold: str | None, inputs: int):
        xs = [f"_x{i}" for i in range(inputs)]
        group = F.struct(*(F.col(k) for k in keys)) if keys else F.struct(F.lit(0).alias("_all"))
        held = F.col(fold) if fold else F.lit(0)
        merged = rows.groupBy(group.alias("_g"), held.alias("_f"), "_y", *xs).agg(F.count(F.lit(1)).cast("double").alias("_n"))
        self.rows, self.fold = cut(merged.where(F.col("_f").isNotNull())), fold
        self.ids = self.rows.select(F.col("_g").alias("_to"), F.col("_f").alias("_held")).distinct()

    def sums(self, state: DataFrame, weights: Sequence[str], aggs: dict[str, Column]) -> DataFrame:
        """``state`` with the weighted means of ``aggs`` over the rows that each fit trains on."""
        on = F.col("_g") == F.col("_to")
        if self.fold:
            on = on & (F.col("_f") != F.col("_held"))
        n = F.col("_n")
        means = [(F.max(v) if name == "_m" else F.sum(n * v) / F.sum(n)).alias(name) for name, v in aggs.items()]
        found = self.rows.join(state.select("_to", "_held", *weights), on).groupBy(F.col("_to").alias("_t"), F.col("_held").alias("_h")).agg(*means)
        return state.join(found, (F.col("_to") == F.col("_t")) & (F.col("_held") == F.col("_h"))).drop("_t", "_h")


def _fit_temperature(fits: _Fits) -> DataFrame:
    """Inverse temperature: root of the monotone derivative in the bracket, then the best of four candidates."""
    z, y, b = F.col("_x0"), F.col("_y"), F.col("_b")
    slope = lambda at: z * (_expit(at * z) - y)
    loss = lambda at: _softplus(at * z) - y * at * z
    ends = {"_d0": slope(F.lit(BETA_LOW)), "_d1": slope(F.lit(BETA_HIGH)), "_m": F.abs(z)}
    ends |= {f"_l{i}": loss(F.lit(c)) for i, c in enumerate((BETA_LOW, 1.0, BETA_HIGH))}
    inside = (F.col("_d0") < 0) & (F.col("_d1") > 0)
    state = fits.sums(fits.ids, [], ends).withColumn("_in", inside).drop("_d0", "_d1")
    state = cut(state.select("*", F.lit(1.0).alias("_b"), F.lit(BETA_LOW).alias("_lo"), F.lit(BETA_HIGH).alias("_hi"), (~F.col("_in")).alias("_done")))
    for _ in range(STEPS):
        if state.where("NOT _done").isEmpty():
            break
        curve = {"_d": slope(b), "_c": z * z * _expit(b * z) * (F.lit(1.0) - _expit(b * z))}
        open_ = fits.sums(state.where("NOT _done"), ["_b"], curve)
        rising = F.col("_d") < 0
        open_ = open_.withColumn("_lo", F.when(rising, b).otherwise(F.col("_lo"))).withColumn("_hi", F.when(rising, F.col("_hi")).otherwise(b))
        step, middle = b - F.col("_d") / F.when(F.col("_c") > 0, F.col("_c")), (F.col("_lo") + F.col("_hi")) / F.lit(2.0)
        open_ = open_.withColumn("_new", F.when((step > F.col("_lo")) & (step < F.col("_hi")), step).otherwise(middle))
        # At the root the step may end on the bracket's edge; the middle would lead away from it.
        near = F.lit(1e-12) * F.greatest(F.lit(1.0), b)
        still = F.coalesce(F.abs(step - b) <= near, F.lit(False)) | (F.col("_d") == 0)
        open_ = open_.withColumn("_done", still | (F.abs(F.col("_new") - b) <= near))
        open_ = open_.withColumn("_b", F.when(still, b).otherwise(F.col("_new")))
        state = cut(state.where("_done").unionByName(open_.select(*state.columns)))
    final = fits.sums(state, ["_b"], {"_l3": loss(b)})
    options = [F.struct(F.col(f"_l{i}").alias("l"), F.lit(i).alias("i"), F.lit(c).alias("w")) for i, c in enumerate((BETA_LOW, 1.0, BETA_HIGH))]
    options.append(F.when(F.col("_in"), F.struct(F.col("_l3").alias("l"), F.lit(3).alias("i"), b.alias("w"))))
    best = F.array_min(F.array_compact(F.array(*options)))["w"]
    return final.select("_to", "_held", F.when(F.col("_m") == 0, F.lit(1.0)).otherwise(best).alias("w0"))


def _box_newton_step(w: np.ndarray, grad: np.ndarray, hess: np.ndarray, bounds) -> np.ndarray:
    """Exact minimiser of the quadratic model inside the box: at most 27 active sets for three weights."""
    best, best_value = w, 0.0
    d = len(w)
    for active in itertools.product((None, 0, 1), repeat=d):
        new = w.copy()
        free = [i for i in range(d) if active[i] is None]
        for i in range(d):
            if active[i] is not None:
                new[i] = bounds[i][active[i]]
        if free:
            fixed = [i for i in range(d) if i not in free]
            rhs = -grad[free] - hess[np.ix_(free, fixed)] @ (new - w)[fixed]
            new[free] = w[free] + np.linalg.solve(hess[np.ix_(free, free)], rhs)
            if any(not bounds[i][0] - 1e-12 <= new[i] <= bounds[i][1] + 1e-12 for i in free):
                continue
        delta = new - w
        value = grad @ delta + 0.5 * delta @ hess @ delta
        if value < best_value:
            best, best_value = new, value
    return best


def _fit_ridge(fits: _Fits, method: str) -> DataFrame:
    """Projected Newton on the mean loss plus ``RIDGE |w - anchor|^2``, with step halving; a fit's few numbers are updated in
    its row of the state."""
    anchor, bounds = np.array(ANCHORS[method]), BOUNDS[method]
    d = len(anchor)
    xs, y = [F.col(f"_x{i}") for i in range(d)], F.col("_y")
    z = sum((F.col("trial")[i] * x for i, x in enumerate(xs)), F.lit(0.0))
    s = _expit(z)
    upper = [(i, j) for i in range(d) for j in range(i, d)]
    aggs = {"_loss": _softplus(z) - y * z} | {f"_g{i}": xs[i] * (s - y) for i in range(d)}
    aggs |= {f"_h{i}{j}": xs[i] * xs[j] * s * (F.lit(1.0) - s) for i, j in upper}
    state = fits.ids.select("_to", "_held", *[F.array(*[F.lit(float(a)) for a in anchor]).alias(c) for c in ("w", "trial")])
    state = cut(state.select("*", F.lit(math.inf).alias("loss"), F.array().cast("array<double>").alias("grad"), F.array().cast("array<double>").alias("hess"), F.lit(0.5).alias("scale"), F.lit(False).alias("done")))

    def update(row: pd.Series) -> pd.Series:
        trial, w = np.array(row["trial"]), np.array(row["w"])
        delta = trial - anchor
        loss = row["_loss"] + RIDGE * float(delta @ delta)
        first = math.isinf(row["loss"])
        if loss <= row["loss"] + 1e-15:
            hess = np.zeros((d, d))
            for i, j in upper:
                hess[i, j] = hess[j, i] = row[f"_h{i}{j}"]
            grad = np.array([row[f"_g{i}"] for i in range(d)]) + 2 * RIDGE * delta
            row["w"], row["loss"], row["grad"], row["hess"] = trial, loss, grad, (hess + 2 * RIDGE * np.eye(d)).ravel()
            row["scale"] = min(1.0, row["scale"] * 2)
        else:
            row["scale"] /= 2
        row["done"] = not first and float(np.max(np.abs(trial - w))) < TOLERANCE
        now, grad, hess = np.array(row["w"]), np.array(row["grad"]), np.array(row["hess"]).reshape(d, d)
        row["trial"] = now + row["scale"] * (_box_newton_step(now, grad, hess, bounds) - now)
        return row

    numbers = ["w", "trial", "loss", "grad", "hess", "scale", "done"]
    kinds = "id bigint, w array<double>, trial array<double>, loss double, grad array<double>, hess array<double>, scale double, done boolean"

    def updated(batches):
        for pdf in batches:
            if len(pdf):
                yield pdf.apply(update, axis=1)[["id", *numbers]]

    state = cut(state.withColumn("id", F.monotonically_increasing_id()))
    for _ in range(STEPS):
        if state.where("NOT done").isEmpty():
            break
        found = cut(fits.sums(state.where("NOT done"), ["trial"], aggs))
        new = found.drop("_to", "_held").mapInPandas(updated, kinds).join(found.select("id", "_to", "_held"), "id")
        state = cut(state.where("done").unionByName(new))
    return state.select("_to", "_held", *[F.col("w")[i].alias(f"w{i}") for i in range(d)])


def design(p: Column, method: str) -> list[Column]:
    """Inputs of the calibration map for a probability column."""
    q = clip_probability(p)
    if method == "temperature":
        return [logit(p)]
    if method == "platt":
        return [logit(p), F.lit(1.0)]
    if method == "beta":
        return [F.ln(q), -F.log1p(-q), F.lit(1.0)]
    raise ValueError(f"unknown calibration method {method!r}")


def fit(
    df: DataFrame, keys: Sequence[str], label: str, prob: str, method: str = "temperature", fold: str | None = None
) -> DataFrame:
    """Weights per group: (keys, [held_out], w0, w1, ...). With ``fold`` each fold's weights come from the other folds."""
    keys = list(keys)
    xs = design(F.col(prob), method)
    rows = df.where(F.col(label).isNotNull() & F.col(prob).isNotNull()).select(
        *keys, *([fold] if fold else []), F.col(label).cast("double").alias("_y"), *[x.alias(f"_x{i}") for i, x in enumerate(xs)]
    )
    fits = _Fits(rows, keys, fold, len(xs))
    found = cut(_fit_temperature(fits) if method == "temperature" else _fit_ridge(fits, method))
    named = [F.col("_to")[k].alias(k) for k in keys] + ([F.col("_held").alias("held_out")] if fold else [])
    return found.select(*named, *[f"w{i}" for i in range(len(xs))])


def fit_temperature(df: DataFrame, keys: Sequence[str], label: str, logits: str, fold: str | None = None) -> DataFrame:
    """Temperature per group: 1 / (best inverse temperature in [0.05, 20]); all-zero logits give 1."""
    p = F.lit(1.0) / (F.lit(1.0) + F.exp(-F.col(logits)))
    return fit(df.withColumn("_p", p), keys, label, "_p", "temperature", fold).withColumn(
        "temperature", F.lit(1.0) / F.col("w0")
    )


def apply_temperature(z: Column, temperature: Column) -> Column:
    return sigmoid(z / F.greatest(temperature, F.lit(1e-6)))


def apply_map(p: Column, weights: Sequence[Column], method: str) -> Column:
    z = sum((w * x for w, x in zip(weights, design(p, method))), F.lit(0.0))
    return _expit(z)


def crossfit_calibrate(
    df: DataFrame, keys: Sequence[str], label: str, prob: str, fold: str, method: str = "temperature", out: str = "calibrated"
) -> DataFrame:
    """Each row gets the map fitted on the other folds of its group."""
    keys = list(keys)
    weights = fit(df, keys, label, prob, method, fold)
    ws = [c for c in weights.columns if c.startswith("w")]
    renamed = weights.select(*[F.col(k).alias(f"_g_{k}") for k in keys], "held_out", *[F.col(w).alias(f"_{w}") for w in ws])
    cond = F.col(fold) == F.col("held_out")
    for k in keys:
        cond = cond & F.col(k).eqNullSafe(F.col(f"_g_{k}"))
    joined = df.join(renamed, cond, "left")
    p = apply_map(F.col(prob), [F.col(f"_{w}") for w in ws], method)
    return joined.select(*df.columns, p.alias(out))
