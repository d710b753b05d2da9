"""Bounded samples of labelled rows, and calibration of their scores."""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Labelled rows that a classifier learns from, at most.
MOST_LABELS = 40_000


def remainder(key: Column, mod: int) -> Column:
    return F.crc32(key.cast("string").cast("binary")) % mod


def held_out(key: Column, mod: int, rest: int) -> Column:
    """Whether a row may not be learnt from; a null key is never learnt from, as it has no label, and is not held out."""
    return F.coalesce(remainder(key, mod) == rest, F.lit(False))


def labelled_sample(labels: DataFrame, label: str, key: str, mod: int, rest: int, most: int = MOST_LABELS) -> DataFrame:
    """(label_key, label, part) of at most ``most`` rows: those with the smallest hash of the key, among keys that may be
    learnt from. Several labels of one key are settled by their mean; nulls are left out. part is 0 to 4, for splits."""
    rows = labels.filter(F.col(key).isNotNull() & F.col(label).isNotNull() & ~held_out(F.col(key), mod, rest))
    one = rows.groupBy(F.col(key).alias("label_key")).agg((F.avg(label) >= 0.5).cast("int").alias("label"))
    order = F.xxhash64("label_key", F.lit(11))
    return one.orderBy(order, "label_key").limit(most).select("label_key", "label", F.pmod(F.xxhash64("label_key", F.lit(12)), F.lit(5)).cast("int").alias("part"))


def fit_logistic(x: np.ndarray, y: np.ndarray, ridge: float = 1e-2) -> tuple[float, float]:
    """Slope and intercept of a one-feature logistic curve; the slope is not negative. With one class or no rows the
    curve is flat at the smoothed share."""
    n, positive = len(y), float(y.sum())
    slope, intercept = 0.0, float(np.log((positive + 1) / (n - positive + 1)))
    if positive == 0 or positive == n:
        return slope, intercept
    scale = float(np.std(x)) or 1.0
    center = float(np.mean(x))
    z = (x - center) / scale
    w = np.array([1.0, intercept])
    design = np.stack([z, np.ones(n)], axis=1)
    for _ in range(60):
        p = 1 / (1 + np.exp(-np.clip(design @ w, -40, 40)))
        gradient = design.T @ (p - y) + ridge * np.array([w[0], 0.0])
        hessian = (design * (p * (1 - p))[:, None]).T @ design + ridge * np.eye(2)
        step = np.linalg.solve(hessian, gradient)
        w = w - np.clip(step, -2, 2)
        if np.abs(step).max() < 1e-9:
            break
    slope = max(w[0] / scale, 0.0)
    return float(slope), float(w[1] - slope * center)
