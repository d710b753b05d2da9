"""Evaluation of prediction tables.

Everything starts from one table of distinct probabilities per group (rows, positives, rows before). Losses, accuracy,
calibration error and the tie-averaged rank AUC are sums over that table, so heavy ties and one dominant model or group
cost nothing extra.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from cohortloom.functions.scalar import (
    clip_probability,
    flag_all_confident_wrong,
    flag_confident_wrong,
    row_log_loss,
    sigmoid,
)
from cohortloom.operators.joins import join_many_to_one
from cohortloom.operators.order import average_rank, null_safe, running, value_ranks
from cohortloom.operators.profile import feature_ranks

# The ten equal-width edges as the reference computes them (multiples of 0.1 in binary floating point).
ECE_EDGES = tuple(i * 0.1 for i in range(1, 10))


def ece_bin(p: Column, edges: Sequence[float] = ECE_EDGES) -> Column:
    """Bin of an equal-width calibration error: half-open, the last one closed."""
    b = F.lit(0)
    for e in edges:
        b = b + (p >= F.lit(e)).cast("int")
    return b


#: Ranges of the probabilities of a large group, and rows that make a group large.
PROBABILITY_CELLS, LARGE_GROUP = 4096, 1 << 18


def probability_table(df: DataFrame, keys: Sequence[str], label: str, prob: str) -> DataFrame:
    """One row per (group, distinct probability): its range ``_cell``, rows, positives and the rows before it in the range.

    A small group is one range. The large ones, one at most for ``LARGE_GROUP`` rows of the table, are told by a count of
    the keys and broadcast, so the predictions are read and merged once.
    """
    keys = list(keys)
    kept = df.where(F.col(label).isNotNull() & F.col(prob).isNotNull()).select(
        *keys, F.col(label).cast("int").alias("_y"), clip_probability(F.col(prob)).alias("_p")
    )
    merged = kept.groupBy(*keys, "_p").agg(F.count(F.lit(1)).alias("cnt"), F.sum("_y").alias("_pos"))
    cell = F.floor(F.col("_p") * PROBABILITY_CELLS)
    if keys:
        large = df.groupBy(*keys).agg(F.count(F.lit(1)).alias("_rows")).where(F.col("_rows") > LARGE_GROUP)
        merged = null_safe(merged, F.broadcast(large), keys, "left")
        cell = F.when(F.col("_rows").isNotNull(), cell).otherwise(F.lit(0))
    merged = merged.select(*keys, "_p", "cnt", "_pos", cell.alias("_cell"))
    before = Window.partitionBy(*keys, "_cell").orderBy("_p").rowsBetween(Window.unboundedPreceding, -1)
    return merged.withColumn("before", F.coalesce(F.sum("cnt").over(before), F.lit(0)))


def binary_metrics(df: DataFrame, keys: Sequence[str], label: str, prob: str, prefix: str = "") -> DataFrame:
    """n, pos, log_loss, brier, auc, balanced_accuracy and ece per group; AUC is NULL with one class."""
    keys = list(keys)
    t = probability_table(df, keys, label, prob)
    p, pos, neg = F.col("_p"), F.col("_pos"), F.col("cnt") - F.col("_pos")
    hit = p >= 0.5
    by_cell = t.groupBy(*keys, "_cell", ece_bin(p).alias("_bin")).agg(
        F.sum("cnt").alias("n"),
        F.sum(pos).alias("pos"),
        F.sum(-(pos * F.ln(p) + neg * F.log1p(-p))).alias("loss"),
        F.sum(pos * (p - 1) * (p - 1) + neg * p * p).alias("sq"),
        F.sum(p * F.col("cnt")).alias("sp"),
        F.sum(F.when(hit, pos).otherwise(0)).alias("tp"),
        F.sum(F.when(~hit, neg).otherwise(0)).alias("tn"),
        F.sum(pos * average_rank()).alias("ranks"),
    )
    # Ranks are within a range so far; the positives of a range lie behind all rows of the ranges before it.
    earlier = Window.partitionBy(*keys).orderBy("_cell").rangeBetween(Window.unboundedPreceding, -1)
    ranks = F.col("ranks") + F.col("pos") * F.coalesce(F.sum("n").over(earlier), F.lit(0))
    by_bin = by_cell.withColumn("ranks", ranks).groupBy(*keys, "_bin").agg(
        *[F.sum(c).alias(c) for c in ("n", "pos", "loss", "sq", "sp", "tp", "tn", "ranks")]
    )
    s = by_bin.groupBy(*keys).agg(
        *[F.sum(c).alias(c) for c in ("n", "pos", "loss", "sq", "tp", "tn", "ranks")],
        F.sum(F.abs(F.col("sp") - F.col("pos"))).alias("gap"),
    )
    n, pos = F.col("n").cast("double"), F.col("pos").cast("double")
    neg = n - pos
    both = (pos > 0) & (neg > 0)
    auc = F.when(both, (F.col("ranks") - pos * (pos + 1) / 2) / F.when(both, pos * neg))
    tpr, tnr = F.col("tp") / F.when(pos > 0, pos), F.col("tn") / F.when(neg > 0, neg)
    present = (pos > 0).cast("int") + (neg > 0).cast("int")
    return s.select(
        *keys,
        F.col("n").alias(f"{prefix}n"),
        F.col("pos").alias(f"{prefix}pos"),
        (F.col("loss") / n).alias(f"{prefix}log_loss"),
        (F.col("sq") / n).alias(f"{prefix}brier"),
        auc.alias(f"{prefix}auc"),
        ((F.coalesce(tpr, F.lit(0.0)) + F.coalesce(tnr, F.lit(0.0))) / present).alias(f"{prefix}balanced_accuracy"),
        (F.col("gap") / n).alias(f"{prefix}ece"),
    )


def log_loss(df: DataFrame, keys: Sequence[str], label: str, prob: str) -> DataFrame:
    return df.groupBy(*keys).agg(F.avg(row_log_loss(F.col(label), F.col(prob))).alias("log_loss"))


def brier(df: DataFrame, keys: Sequence[str], label: str, prob: str) -> DataFrame:
    gap = clip_probability(F.col(prob)) - F.col(label)
    return df.groupBy(*keys).agg(F.avg(gap * gap).alias("brier"))


def auc(df: DataFrame, keys: Sequence[str], label: str, prob: str) -> DataFrame:
    return binary_metrics(df, keys, label, prob).select(*keys, "auc")


def balanced_accuracy(df: DataFrame, keys: Sequence[str], label: str, prob: str, threshold: float = 0.5) -> DataFrame:
    """Mean recall over the classes that occur."""
    hit, y = (F.col(prob) >= threshold).cast("double"), F.col(label)
    recalls = df.groupBy(*keys).agg(F.avg(F.when(y == 1, hit)).alias("_a"), F.avg(F.when(y == 0, 1 - hit)).alias("_b"))
    mean = (F.coalesce("_a", F.lit(0.0)) + F.coalesce("_b", F.lit(0.0))) / (
        F.col("_a").isNotNull().cast("int") + F.col("_b").isNotNull().cast("int")
    )
    return recalls.select(*keys, mean.alias("balanced_accuracy"))


def ece(df: DataFrame, keys: Sequence[str], label: str, prob: str) -> DataFrame:
    """Weighted absolute gap between mean probability and observed share per equal-width bin."""
    p = clip_probability(F.col(prob))
    bins = df.groupBy(*keys, ece_bin(p).alias("_b")).agg(
        F.count(F.lit(1)).alias("n"), F.sum(p).alias("sp"), F.sum(label).alias("sy")
    )
    return bins.groupBy(*keys).agg((F.sum(F.abs(F.col("sp") - F.col("sy"))) / F.sum("n")).alias("ece"))


def subgroup_audit(
    df: DataFrame, keys: Sequence[str], label: str, prob: str, min_n: int = 10, both_classes: bool = False
) -> DataFrame:
    """Metrics by (model, family); small groups (and one-class groups if asked) are left out."""
    m = binary_metrics(df, keys, label, prob).where(F.col("n") >= min_n)
    return m.where(F.col("auc").isNotNull()) if both_classes else m


def subset_metrics(df: DataFrame, keys: Sequence[str], flag: str, label: str, prob: str) -> DataFrame:
    """n, loss and Brier of the valid and the invalid rows; NULL when only one class is left."""
    m = binary_metrics(df, [*keys, flag], label, prob)
    keep = F.col("auc").isNotNull()
    return m.select(
        *keys, flag, "n", F.when(keep, F.col("log_loss")).alias("log_loss"), F.when(keep, F.col("brier")).alias("brier")
    )


def reliability_points(df: DataFrame, keys: Sequence[str], label: str, prob: str, bins: int = 10) -> DataFrame:
    """Quantile bins per group (equal edges merged): mean probability, observed share, rows."""
    keys = list(keys)
    kept = df.where(F.col(prob).isNotNull())
    t = value_ranks(kept, keys, prob, {"pos": F.col(label)})
    q = t.groupBy(*keys).agg(F.least(F.count(F.lit(1)), F.lit(bins)).alias("_q"))
    t = null_safe(t, q, keys)
    p, aggs = F.col(prob), []
    for i in range(1, bins):
        pos = F.lit(float(i)) / F.col("_q") * (F.col("n") - 1)
        for name, at in (("lo", F.floor(pos)), ("hi", F.ceil(pos))):
            hit = (F.col("before") <= at) & (at < F.col("before") + F.col("cnt")) & (F.lit(i) < F.col("_q"))
            aggs.append(F.max(F.when(hit, p)).alias(f"_{name}{i}"))
    edges = t.groupBy(*keys).agg(F.max("n").alias("_n"), F.max("_q").alias("_q2"), F.min(p).alias("_min"), *aggs)
    cuts = []
    for i in range(1, bins):
        pos = F.lit(float(i)) / F.col("_q2") * (F.col("_n") - 1)
        lo, hi = F.col(f"_lo{i}"), F.col(f"_hi{i}")
        cuts.append(lo + (hi - lo) * (pos - F.floor(pos)))
    distinct_cuts = F.array_distinct(F.array_compact(F.array(*cuts)))
    edges = edges.select(*keys, F.filter(distinct_cuts, lambda c: c > F.col("_min")).alias("_cuts"))
    placed = null_safe(t, edges, keys)
    b = F.size(F.filter("_cuts", lambda c: c < p))
    return placed.groupBy(*keys, b.alias("bin")).agg(
        (F.sum(p * F.col("cnt")) / F.sum("cnt")).alias("mean_probability"),
        (F.sum("pos") / F.sum("cnt")).alias("observed_fraction"),
        F.sum("cnt").alias("n"),
    )


def _pairs(models: Sequence[str]) -> list[tuple[str, str]]:
    return [(a, b) for i, a in enumerate(models) for b in models[i + 1 :]]


def pair_complementarity(wide: DataFrame, models: Sequence[str]) -> DataFrame:
    """Correlation, mean absolute difference, decision disagreement and support per model pair, in one aggregation."""
    aggs, items = [], []
    for i, (a, b) in enumerate(_pairs(models)):
        x, y = F.col(a), F.col(b)
        ok = x.isNotNull() & y.isNotNull()
        aggs += [
            F.corr(F.when(ok, x), F.when(ok, y)).alias(f"c{i}"),
            F.avg(F.abs(x - y)).alias(f"d{i}"),
            F.avg(((x >= 0.5) != (y >= 0.5)).cast("double")).alias(f"k{i}"),
            F.count(F.when(ok, 1)).alias(f"n{i}"),
        ]
        items.append(
            F.struct(
                F.lit(a).alias("a"), F.lit(b).alias("b"), F.col(f"c{i}").alias("correlation"),
                F.col(f"d{i}").alias("mean_abs_diff"), F.col(f"k{i}").alias("disagreement"), F.col(f"n{i}").alias("n"),
            )
        )
    return wide.agg(*aggs).select(F.explode(F.array(*items)).alias("e")).select("e.*")


def pair_ensembles(wide: DataFrame, label: str, models: Sequence[str]) -> DataFrame:
    """Metrics of the equal mean of every pair with the residual correlation; pairs are built inside each row."""
    items = [
        F.struct(F.lit(a).alias("a"), F.lit(b).alias("b"), F.col(a).alias("pa"), F.col(b).alias("pb")) for a, b in _pairs(models)
    ]
    long = wide.select(label, F.explode(F.array(*items)).alias("e")).select(label, "e.*")
    long = long.withColumn("_mean", (F.col("pa") + F.col("pb")) / F.lit(2.0))
    m = binary_metrics(long, ["a", "b"], label, "_mean")
    r = long.groupBy("a", "b").agg(
        F.corr(F.col("pa") - F.col(label), F.col("pb") - F.col(label)).alias("residual_correlation")
    )
    return m.join(r, ["a", "b"])


def weight_sweep(wide: DataFrame, label: str, a: str, b: str, steps: int = 101) -> DataFrame:
    """Loss of ``w a + (1 - w) b`` for every weight of the grid; the grid is expanded and summed on the map side."""
    grid = wide.select(label, a, b, F.explode(F.sequence(F.lit(0), F.lit(steps - 1))).alias("_i"))
    w = F.col("_i") / F.lit(float(steps - 1))
    p = w * F.col(a) + (F.lit(1.0) - w) * F.col(b)
    return grid.groupBy("_i").agg(F.avg(row_log_loss(F.col(label), p)).alias("log_loss")).select(
        w.alias("weight"), "log_loss"
    )


def metrics_by_fold(df: DataFrame, keys: Sequence[str], label: str, prob: str) -> DataFrame:
    return df.groupBy(*keys).agg(
        F.count(F.lit(1)).alias("n"), F.avg(row_log_loss(F.col(label), F.col(prob))).alias("log_loss")
    )


def prior_baseline(df: DataFrame, keys: Sequence[str], label: str) -> DataFrame:
    """Prevalence and the loss of predicting it for everyone, in closed form from two sums."""
    g = df.groupBy(*keys).agg(F.count(label).alias("n"), F.avg(label).alias("prevalence"))
    p = clip_probability(F.col("prevalence"))
    q = F.col("prevalence")
    return g.select("*", (-(q * F.ln(p) + (F.lit(1.0) - q) * F.log1p(-p))).alias("prior_loss"))


def label_audit(wide: DataFrame, key: str, label: str, mean: str, models: Sequence[str], review: str) -> DataFrame:
    """Predictive entropy, model SD, label surprise and expert priority (mean of three percentage ranks)."""
    p, y = clip_probability(F.col(mean)), F.col(label)
    k = float(len(models))
    avg = sum((F.col(m) for m in models), F.lit(0.0)) / F.lit(k)
    sd = F.sqrt(sum(((F.col(m) - avg) * (F.col(m) - avg) for m in models), F.lit(0.0)) / F.lit(k - 1))
    a = wide.select(
        key,
        label,
        review,
        (-(p * F.ln(p) + (1 - p) * F.ln(1 - p))).alias("entropy"),
        sd.alias("disagreement"),
        row_log_loss(y, F.col(mean)).alias("surprise"),
    )
    cols = ["surprise", "disagreement", review]
    ranks = feature_ranks(a, key, cols, pct=True).select(key, *[F.col(c).alias(f"_r_{c}") for c in cols])
    priority = sum((F.col(f"_r_{c}") for c in cols), F.lit(0.0)) / F.lit(3.0)
    return a.join(ranks, key).select(*a.columns, priority.alias("priority"))


def review_score(
    df: DataFrame, key: str, technical: str, biological: Sequence[str], registration: str, background: str
) -> DataFrame:
    """Mean of the technical rank, the mean biological rank, registration risk and background risk."""
    cols = [technical, *biological, registration]
    r = feature_ranks(df, key, cols, pct=True).select(key, *[F.col(c).alias(f"_r_{c}") for c in cols])
    j = df.select(key, background).join(r, key)
    bio = sum((F.col(f"_r_{c}") for c in biological), F.lit(0.0)) / F.lit(float(len(biological)))
    risk = F.coalesce(F.lit(1.0) - F.col(f"_r_{registration}"), F.lit(1.0))
    return j.select(
        key,
        F.col(f"_r_{technical}").alias("technical_rank"),
        bio.alias("biological_rank"),
        risk.alias("registration_risk"),
        F.col(background),
        ((F.col(f"_r_{technical}") + bio + risk + F.col(background)) / F.lit(4.0)).alias("review_score"),
    )


def case_review(wide: DataFrame, key: str, label: str, a: str, b: str, k: int) -> DataFrame:
    """The ``k`` hardest rows by the loss of the equal blend, with a flag when both models are sure and wrong."""
    y = F.col(label)
    blend = (F.col(a) + F.col(b)) / F.lit(2.0)
    return (
        wide.select(
            key,
            label,
            row_log_loss(y, F.col(a)).alias("loss_a"),
            row_log_loss(y, blend).alias("blend_loss"),
            flag_all_confident_wrong(y, [F.col(a), F.col(b)]).alias("both_wrong"),
        )
        .orderBy(F.col("blend_loss").desc(), key)
        .limit(k)
    )


def promotion_rule(
    metrics: DataFrame, key: str, variant: str, special: str, architecture: str, loss: str, valid_loss: str, margin: float = 0.005
) -> DataFrame:
    """A special variant passes if it improves the valid subset and is within ``margin`` of the best comparable one.

    Comparable means the same architecture, or any other variant when there is none. Others always pass.
    """
    others = metrics.where(F.col(variant) != special)
    best = F.min(F.struct(loss, key, valid_loss))
    by_arch = others.groupBy(architecture).agg(best.alias("_b"))
    overall = others.agg(best.alias("b")).first()["b"]
    j = metrics.join(by_arch, architecture, "left")
    if overall is None:
        base = F.col("_b")
    else:
        literal = F.struct(*[F.lit(overall[c]).alias(c) for c in (loss, key, valid_loss)])
        base = F.coalesce(F.col("_b"), literal.cast(by_arch.schema["_b"].dataType))
    passed = (
        base.isNotNull()
        & F.coalesce(F.col(valid_loss) < base[valid_loss], F.lit(False))
        & F.coalesce(F.col(loss) <= base[loss] + F.lit(margin), F.lit(False))
    )
    return j.select(*metrics.columns, F.when(F.col(variant) == special, passed).otherwise(F.lit(True)).alias("passed"))


def model_inventory(
    df: DataFrame, model: str, key: str, label: str, prob: str, fold: str, canonical: DataFrame, logit: str
) -> DataFrame:
    """Per model: metrics, fold agreement with a canonical manifest (key, fold), confident errors and logit consistency."""
    m = binary_metrics(df, [model], label, prob)
    c = canonical.select(key, F.col(fold).alias("_fold"))
    j = join_many_to_one(df, c, [key])
    extra = j.groupBy(model).agg(
        F.avg((F.col(fold) == F.col("_fold")).cast("double")).alias("fold_agreement"),
        F.sum(flag_confident_wrong(F.col(label), F.col(prob)).cast("int")).alias("confident_wrong"),
        F.max(F.abs(sigmoid(F.col(logit)) - F.col(prob))).alias("max_logit_error"),
    )
    return m.join(extra, model)


def oof_complete(df: DataFrame, model: str, key: str, expected: int) -> DataFrame:
    """Per model: rows, distinct keys and whether each key occurs exactly once and none is missing."""
    per_key = df.groupBy(model, key).agg(F.count(F.lit(1)).alias("c"))
    g = per_key.groupBy(model).agg(F.sum("c").alias("rows"), F.count(F.lit(1)).alias("keys"), F.max("c").alias("_m"))
    return g.select(model, "rows", "keys", ((F.col("_m") == 1) & (F.col("keys") == expected)).alias("complete"))


def ensemble_predict(df: DataFrame, key: str, fold: str, logit: str, temperature: float, folds: Sequence[int]) -> DataFrame:
    """Mean and population SD over folds of sigmoid(logit / T), with one column per fold."""
    p = sigmoid(F.col(logit) / F.lit(max(temperature, 1e-6)))
    return df.groupBy(key).agg(
        F.avg(p).alias("p_mean"),
        F.stddev_pop(p).alias("p_std"),
        *[F.max(F.when(F.col(fold) == k, p)).alias(f"p_fold_{k}") for k in folds],
    )


def block_permutation_importance(model, df: DataFrame, blocks: dict[str, Sequence[str]], key: str, fold: str, label: str,
                                 seed: int = 0, probability: str = "probability") -> DataFrame:
    """Loss increase after permuting a block of columns among the rows of a fold (``model`` is a fitted transformer).

    The permutation pairs the rows in key order with the rows in draw order through row numbers of two cell-wise
    scans, so a large fold is never gathered in one task.
    """
    from pyspark.ml.functions import vector_to_array

    from cohortloom.operators.selection import draw

    def scored(frame: DataFrame, name: str) -> DataFrame:
        p = F.element_at(vector_to_array(probability), 2)
        out = model.transform(frame)
        return out.agg(F.avg(row_log_loss(F.col(label), p)).alias("loss")).withColumn("block", F.lit(name))

    def numbered(frame: DataFrame, tag: str) -> DataFrame:
        u = frame.withColumn("_u", draw(tag, key))
        cell = F.floor(F.col("_u") * 1024).cast("int")
        return running(u, [fold], "_u", {"_rn": ("row_number", None)}, tie=[key], cell=cell).drop("_u")

    results = scored(df, "none")
    base = numbered(df, f"{seed}-order")
    for name, cols in blocks.items():
        donor = numbered(df, f"{seed}-{name}").select(fold, "_rn", *[F.col(c).alias(f"_d_{c}") for c in cols])
        mixed = base.drop(*cols).join(donor, [fold, "_rn"])
        mixed = mixed.select(
            *[c for c in base.columns if c not in cols and c != "_rn"], *[F.col(f"_d_{c}").alias(c) for c in cols]
        )
        results = results.unionByName(scored(mixed, name))
    return results
