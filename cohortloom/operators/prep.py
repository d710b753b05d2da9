"""Feature preparation fitted on training rows: imputation, scaling, harmonisation, pruning, block PCA, distances.

A fit leaves a few numbers per column (or per group and column); applying it is a projection or one join.
"""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.ml import Pipeline
from pyspark.ml.feature import PCA, StandardScaler, VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from cohortloom.functions.scalar import clip
from cohortloom.operators.order import exact_quantiles, null_safe, wide_quantiles
from cohortloom.operators.gram import covariance
from cohortloom.operators.profile import corr_matrix, group_median_iqr

TINY_SCALE = 1e-8
CLIP = 8.0


def finite(c: str) -> Column:
    """The value, or NULL when it is NaN or infinite."""
    col = F.col(c).cast("double")
    return F.when(~F.isnan(col) & (F.abs(col) != F.lit(float("inf"))), col)


@dataclass
class ImputeScaleModel:
    """Median fill, median centre and IQR scale per column; with ``valid`` the invalid rows become 0."""

    cols: list[str]
    median: dict[str, float]
    scale: dict[str, float]
    valid: str | None = None
    pca: object = None
    components: int = 0

    def transform(self, df: DataFrame) -> DataFrame:
        z = []
        for c in self.cols:
            m = F.lit(self.median[c])
            value = (F.coalesce(finite(c), m) - m) / F.lit(self.scale[c])
            if self.valid:
                value = F.when(F.col(self.valid), value).otherwise(F.lit(0.0))
            z.append(value.alias(f"z_{c}"))
        out = df.select(*df.columns, *z)
        if self.pca is None:
            return out
        scored = self.pca.transform(out)
        array = vector_to_array("_pc")
        return scored.select(*out.columns, *[array[i].alias(f"pc{i + 1}") for i in range(self.components)])


@dataclass
class FoldImputeScale:
    """Fitted on training rows only; ``pca_variance`` keeps the components up to that share of the variance."""

    cols: Sequence[str]
    pca_variance: float | None = None
    valid: str | None = None

    def fit(self, train: DataFrame) -> ImputeScaleModel:
        cols = list(self.cols)
        rows = train.where(F.col(self.valid)) if self.valid else train
        rows = rows.select(*[finite(c).alias(c) for c in cols])
        med = wide_quantiles(rows, [], cols, {"m": 0.5}).first()
        if med is None:
            raise ValueError("no valid training row")
        medians = {c: med[f"m_{c}"] if med[f"m_{c}"] is not None else 0.0 for c in cols}
        filled = rows.na.fill(medians)
        q = wide_quantiles(filled, [], cols, {"lo": 0.25, "hi": 0.75}).first()
        spread = {c: q[f"hi_{c}"] - q[f"lo_{c}"] for c in cols}
        model = ImputeScaleModel(cols, medians, {c: s if s > TINY_SCALE else 1.0 for c, s in spread.items()}, self.valid)
        if self.pca_variance is not None and len(cols) > 1:
            fitted, variance = fit_pca(model.transform(train), [f"z_{c}" for c in cols], len(cols))
            model.components = int(np.searchsorted(np.cumsum(variance), self.pca_variance) + 1)
            model.components = min(model.components, len(cols))
            model.pca = fitted
        return model


def MaskedScale(cols: Sequence[str], valid: str) -> FoldImputeScale:
    """Fitted on valid rows; invalid rows come out as 0."""
    return FoldImputeScale(cols, None, valid)


def fit_pca(df: DataFrame, cols: Sequence[str], k: int, out: str = "_pc"):
    """Centred PCA: (fitted pipeline, explained variance shares). The p x p covariance is the only thing collected."""
    stages = [
        VectorAssembler(inputCols=list(cols), outputCol="_raw"),
        StandardScaler(inputCol="_raw", outputCol="_centred", withMean=True, withStd=False),
        PCA(k=k, inputCol="_centred", outputCol=out),
    ]
    model = Pipeline(stages=stages).fit(df)
    return model, model.stages[-1].explainedVariance.toArray()


def harmonize(df: DataFrame, train: DataFrame, cols: Sequence[str], group: str, min_n: int = 5) -> DataFrame:
    """``h_<c>``: (x - group median) / group IQR from the training rows, missing at the median, clipped to +-8.

    Groups the training rows do not have use the global statistics.
    """
    cols = list(cols)
    clean = train.select(group, *[finite(c).alias(c) for c in cols])
    stats = group_median_iqr(clean, cols, group, min_n)
    picks = [
        F.max(F.when(F.col("feature") == c, F.col(v))).alias(f"_{v}_{c}") for c in cols for v in ("median", "iqr")
    ]
    wide = stats.groupBy(group).agg(*picks)
    g = wide_quantiles(clean, [], cols, {"lo": 0.25, "m": 0.5, "hi": 0.75}).first()
    j = null_safe(df, wide, [group], "left")
    out = []
    for c in cols:
        med = F.coalesce(F.col(f"_median_{c}"), F.lit(g[f"m_{c}"]))
        iqr = F.coalesce(F.col(f"_iqr_{c}"), F.lit((g[f"hi_{c}"] - g[f"lo_{c}"]) or 1.0))
        out.append(clip((F.coalesce(finite(c), med) - med) / iqr, -CLIP, CLIP).alias(f"h_{c}"))
    return j.select(*df.columns, *out)


def robust_scale(df: DataFrame, cols: Sequence[str], lower: float = 0.10, upper: float = 0.90) -> DataFrame:
    """``r_<c>``: centred at the median, divided by the exact quantile range (1 when it is 0)."""
    q = wide_quantiles(df, [], list(cols), {"lo": lower, "m": 0.5, "hi": upper}).first()
    return df.select(
        *df.columns,
        *[
            ((F.col(c) - F.lit(q[f"m_{c}"])) / F.lit((q[f"hi_{c}"] - q[f"lo_{c}"]) or 1.0)).alias(f"r_{c}") for c in cols
        ],
    )


def prune_correlated(
    df: DataFrame, cols: Sequence[str], threshold: float, key: str, method: str = "spearman", inclusive: bool = False
) -> tuple[list[str], list[str]]:
    """Greedy in column order: a column goes when it correlates with a kept one above the threshold.

    The correlations are one aggregation; only the p x p result reaches the driver. ``inclusive`` drops at equality.
    """
    corr = {(r["a"], r["b"]): abs(r["corr"] or 0.0) for r in corr_matrix(df, list(cols), key, method).collect()}
    kept, dropped = [], []
    for c in cols:
        values = [0.0 if np.isnan(v) else v for v in (corr.get((k, c), corr.get((c, k), 0.0)) for k in kept)]
        over = any(v >= threshold if inclusive else v > threshold for v in values)
        (dropped if over else kept).append(c)
    return kept, dropped


def mutual_information(df: DataFrame, cols: Sequence[str], label: str, bins: int = 10) -> DataFrame:
    """(feature, mi): mutual information of the quantile-binned feature with the label, from one contingency table."""
    cells = F.array(*[F.struct(F.lit(c).alias("feature"), F.col(c).cast("double").alias("v")) for c in cols])
    long = df.select(F.col(label).alias("y"), F.explode(cells).alias("e")).select("y", "e.feature", "e.v")
    long = long.where(F.col("v").isNotNull())
    q = exact_quantiles(df, [], list(cols), [i / bins for i in range(1, bins)])
    edges = q.select("feature", F.array(*[f"q{i}" for i in range(bins - 1)]).alias("edges"))
    binned = long.join(edges, "feature").select(
        "feature", "y", F.size(F.filter("edges", lambda e: e < F.col("v"))).alias("bin")
    )
    joint = binned.groupBy("feature", "bin", "y").agg(F.count(F.lit(1)).alias("c"))
    by_bin = joint.groupBy("feature", "bin").agg(F.sum("c").alias("cb"))
    by_y = joint.groupBy("feature", "y").agg(F.sum("c").alias("cy"))
    total = joint.groupBy("feature").agg(F.sum("c").alias("n"))
    j = joint.join(by_bin, ["feature", "bin"]).join(by_y, ["feature", "y"]).join(total, "feature")
    term = F.col("c") / F.col("n") * F.ln(F.col("c") * F.col("n") / (F.col("cb") * F.col("cy")))
    return j.groupBy("feature").agg(F.sum(term).alias("mi"))


def select_top_mi(df: DataFrame, cols: Sequence[str], label: str, k: int, bins: int = 10) -> DataFrame:
    return mutual_information(df, cols, label, bins).orderBy(F.col("mi").desc(), "feature").limit(k)


@dataclass
class BlockPca:
    """Fitted block-balanced PCA: robust 10-90 scale, clip to +-8, divide by sqrt(block width), then PCA."""

    pipeline: object
    cols: list[str]
    variance: np.ndarray
    components: int

    def loadings(self) -> list[tuple[str, list[float]]]:
        pc = self.pipeline.stages[-1].pc.toArray()
        return [(c, pc[i].tolist()) for i, c in enumerate(self.cols)]

    def scores(self, df: DataFrame) -> DataFrame:
        s = self.pipeline.transform(df)
        array = vector_to_array("_pc")
        return s.select(*df.columns, *[array[i].alias(f"pc{i + 1}") for i in range(self.components)])

    def reconstruction_error(self, df: DataFrame, share: float = 0.90, out: str = "pca_error") -> DataFrame:
        """Mean squared error after keeping components up to ``share`` of the variance (at least one is left out).

        Components are orthonormal: the error is the centred norm minus the kept scores, all column arithmetic.
        """
        upto = min(int(np.searchsorted(np.cumsum(self.variance), share) + 1), self.components)
        keep = max(1, min(upto, self.components - 1))
        s = self.pipeline.transform(df)
        x, pc = vector_to_array("_centred"), vector_to_array("_pc")
        norm = F.aggregate(x, F.lit(0.0), lambda a, v: a + v * v)
        kept = F.aggregate(F.slice(pc, 1, keep), F.lit(0.0), lambda a, v: a + v * v)
        return s.select(*df.columns, (F.greatest(norm - kept, F.lit(0.0)) / F.lit(float(len(self.cols)))).alias(out))


def balance_blocks(df: DataFrame, blocks: dict[str, Sequence[str]]) -> DataFrame:
    """``b_<c>`` columns: robust scaled, clipped and divided by the square root of the block width."""
    cols = [c for block in blocks.values() for c in block]
    scaled = robust_scale(df, cols)
    out = [
        (clip(F.coalesce(F.col(f"r_{c}"), F.lit(0.0)), -CLIP, CLIP) / F.lit(float(np.sqrt(max(len(block), 1))))).alias(f"b_{c}")
        for block in blocks.values()
        for c in block
    ]
    return scaled.select(*df.columns, *out)


def block_pca(balanced: DataFrame, cols: Sequence[str], k: int = 12) -> BlockPca:
    cols = list(cols)
    k = min(k, len(cols))
    pipeline, variance = fit_pca(balanced, cols, k)
    return BlockPca(pipeline, cols, variance, k)


def mahalanobis_shrunk(df: DataFrame, cols: Sequence[str], out: str = "mahalanobis") -> DataFrame:
    """Squared Mahalanobis distance under a Ledoit-Wolf shrunk covariance.

    The covariance is added up as outer products of batches; the fourth moment of the norm gives the shrinkage in closed
    form. The inverse is p x p, and each row is one product with it.
    """
    cols = list(cols)
    p = len(cols)
    mean, cov = covariance(df, cols)
    d = [F.col(c) - F.lit(m) for c, m in zip(cols, mean, strict=True)]
    norm = F.aggregate(F.array(*d), F.lit(0.0), lambda total, x: total + x * x)
    row = df.agg(F.avg(norm * norm).alias("q"), F.count(F.lit(1)).alias("n")).first()
    mu = np.trace(cov) / p
    squared = float((cov**2).sum())
    noise = (row["q"] - squared) / (p * row["n"])
    distance = (squared - 2 * mu * np.trace(cov) + p * mu * mu) / p
    shrink = 0.0 if distance <= 0 else min(max(noise, 0.0), distance) / distance
    inverse = np.linalg.inv((1 - shrink) * cov + shrink * mu * np.eye(p))

    @F.pandas_udf("double")
    def length(x: pd.Series) -> pd.Series:
        v = np.array(x.tolist(), dtype=float).reshape(len(x), p)
        found = np.einsum("ij,jk,ik->i", v, inverse, v)
        return pd.Series(found).where(~np.isnan(found), None)

    return df.withColumn(out, length(F.array(*d)))


def class_weights(df: DataFrame, label: str, out: str = "weight") -> DataFrame:
    """n / (classes * class size) on each row; the class table is joined, so no class is gathered in one task."""
    sizes = df.groupBy(label).agg(F.count(F.lit(1)).alias("_c"))
    total = sizes.agg(F.sum("_c").alias("n"), F.count(F.lit(1)).alias("k")).first()
    w = F.lit(float(total["n"] or 0)) / (F.lit(total["k"]) * F.col("_c"))
    return null_safe(df, sizes.select(label, w.alias(out)), [label], "left")


#: Relative gap below which two means differ by the order of their sums alone.
ROUNDING = 1e-12


def median_prune(steps: DataFrame, trial: str, step: str, value: str, warmup: int = 1) -> DataFrame:
    """Trials to stop at each step: the mean so far is worse than the median of all trials at that step, after warm-up.

    (trial, step, running_mean, median, prune). A mean that equals the median but for rounding isn't worse.
    """
    from cohortloom.operators.order import running

    r = running(steps, [trial], step, {"_s": ("sum", F.col(value)), "_n": ("row_number", None)})
    r = r.select(trial, step, (F.col("_s") / F.col("_n")).alias("running_mean"))
    med = wide_quantiles(r, [step], ["running_mean"], {"med": 0.5}).withColumnRenamed("med_running_mean", "median")
    j = null_safe(r, med, [step])
    mean, med = F.col("running_mean"), F.col("median")
    worse = (mean > med) & ~(mean - med <= F.lit(ROUNDING) * F.least(F.abs(mean), F.abs(med)))
    return j.withColumn("prune", (F.col(step) >= warmup) & worse)


def requeue_failed(trials: DataFrame, study: str, params: str, state: str, number: str) -> DataFrame:
    """Failed parameter sets that no other state holds, once each (the smallest number)."""
    usable = trials.where(F.col(params).isNotNull() & (F.col(params) != "") & (F.col(params) != "{}"))
    g = usable.groupBy(study, params).agg(
        F.min(F.when(F.col(state) == "FAIL", F.col(number))).alias(number),
        F.max((F.col(state) != "FAIL").cast("int")).alias("_active"),
    )
    return g.where((F.col("_active") == 0) & F.col(number).isNotNull()).select(study, number, params)
