"""Aggregations: profiles, balance, robust scores, correlations, fold and error summaries."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from cohortloom.operators.gram import correlations
from cohortloom.functions.scalar import MISSING_CLASS, row_log_loss
from cohortloom.operators.joins import one_row, require
from cohortloom.operators.order import average_rank, exact_quantiles, null_safe, running, value_ranks, wide_quantiles
from cohortloom.session import cut


def flag_sum(cond: Column) -> Column:
    return F.coalesce(F.sum(cond.cast("bigint")), F.lit(0))


def filter_cohort(df: DataFrame, label: str, finite: Sequence[str], keys: Sequence[str] = (), min_n: int = 0) -> DataFrame:
    """Labelled rows with all ``finite`` columns present, in groups of at least ``min_n`` rows."""
    kept = df.where(F.col(label).isNotNull())
    for c in finite:
        kept = kept.where(F.col(c).isNotNull() & ~F.isnan(c))
    if not keys:
        return kept
    big = kept.groupBy(*keys).agg(F.count(F.lit(1)).alias("_n")).where(F.col("_n") >= min_n).drop("_n")
    return kept.join(big, list(keys), "left_semi")


def group_profile(df: DataFrame, keys: Sequence[str], value: str) -> DataFrame:
    """Rows, non-null rows, mean, median, sum and distinct values per group."""
    ranked = value_ranks(df, list(keys), value)
    v, cnt, n = F.col(value), F.col("cnt"), F.col("n")
    covers = lambda at: (F.col("before") <= at) & (at < F.col("before") + cnt)
    lo, hi = F.floor((n - 1) / 2), F.ceil((n - 1) / 2)
    stats = ranked.groupBy(*keys).agg(
        F.sum(cnt).alias("n_values"),
        (F.sum(v * cnt) / F.sum(cnt)).alias("mean"),
        ((F.max(F.when(covers(lo), v)) + F.max(F.when(covers(hi), v))) / F.lit(2.0)).alias("median"),
        F.sum(v * cnt).alias("total"),
        F.count(F.lit(1)).alias("n_unique"),
    )
    sizes = df.groupBy(*keys).agg(F.count(F.lit(1)).alias("n"))
    joined = null_safe(sizes, stats, list(keys), "left")
    return joined.na.fill(0, ["n_values", "n_unique"])


def coverage_by_group(df: DataFrame, group: str, available: Column, valid: Column) -> DataFrame:
    """Rows, available, valid, failure rate, coverage and valid share of the available rows."""
    g = df.groupBy(group).agg(
        F.count(F.lit(1)).alias("n"), flag_sum(available).alias("available"), flag_sum(valid).alias("valid")
    )
    return g.select(
        "*",
        (F.col("n") - F.col("available")).alias("failures"),
        (F.col("available") / F.col("n")).alias("coverage"),
        ((F.col("n") - F.col("available")) / F.col("n")).alias("failure_rate"),
        F.when(F.col("available") > 0, F.col("valid") / F.when(F.col("available") > 0, F.col("available")))
        .otherwise(F.lit(0.0))
        .alias("valid_fraction"),
    )


def coverage_gate(coverage: DataFrame, min_n: int) -> DataFrame:
    """Worst failure rate among groups of at least ``min_n`` rows (0 when there is none)."""
    worst = F.max(F.when(F.col("n") >= min_n, F.col("failure_rate")))
    return coverage.agg(F.coalesce(worst, F.lit(0.0)).alias("worst_failure_rate"), F.sum("n").alias("n"))


def integrity_report(df: DataFrame, key: str, label: str, positive: Sequence[str], finite: Sequence[str], group: str,
                     min_n: int) -> DataFrame:
    """Named indicators as (indicator, value); duplicates and families come from one grouping each."""
    bad_positive = F.lit(False)
    for c in positive:
        bad_positive = bad_positive | F.coalesce(F.col(c) <= 0, F.lit(False))
    not_finite = F.lit(False)
    for c in finite:
        not_finite = not_finite | F.col(c).isNull()
    per_key = df.groupBy(key).agg(
        F.count(F.lit(1)).alias("n"),
        flag_sum(F.col(label).isNull()).alias("unlabelled"),
        flag_sum(not_finite).alias("not_finite"),
        flag_sum(bad_positive).alias("not_positive"),
    )
    rows = per_key.agg(
        F.sum("n").alias("rows"),
        F.sum(F.col("n") - 1).alias("duplicate_keys"),
        F.sum("unlabelled").alias("unlabelled"),
        F.sum("not_finite").alias("not_finite"),
        F.sum("not_positive").alias("not_positive"),
    )
    families = df.groupBy(group).agg(F.count(F.lit(1)).alias("n")).agg(
        F.count(group).alias("families"), flag_sum((F.col("n") < min_n) & F.col(group).isNotNull()).alias("rare_families")
    )
    long = [t.unpivot([], t.columns, "indicator", "value") for t in (rows, families)]
    return long[0].unionByName(long[1])


def schema_profile(df: DataFrame) -> DataFrame:
    """Per column: type, non-null, null, null share and distinct values."""
    from cohortloom.operators.catalog import distinct_counts

    types = F.create_map(*[F.lit(x) for f in df.schema.fields for x in (f.name, f.dataType.simpleString())])
    d = distinct_counts(df)
    return d.select(
        "feature",
        F.element_at(types, F.col("feature")).alias("type"),
        "n_non_null",
        (F.col("n_rows") - F.col("n_non_null")).alias("n_null"),
        ((F.col("n_rows") - F.col("n_non_null")) / F.col("n_rows")).alias("null_share"),
        "n_distinct",
    )


def duplicate_rows(df: DataFrame) -> DataFrame:
    """Rows that repeat an earlier row in every column."""
    return df.groupBy(*df.columns).agg(F.count(F.lit(1)).alias("_n")).agg(
        F.coalesce(F.sum("_n"), F.lit(0)).alias("rows"), F.coalesce(F.sum(F.col("_n") - 1), F.lit(0)).alias("duplicates")
    )


def class_counts(df: DataFrame, target: str) -> DataFrame:
    from pyspark.sql import Window

    counts = df.groupBy(F.coalesce(F.col(target).cast("string"), F.lit(MISSING_CLASS)).alias("class")).agg(
        F.count(F.lit(1)).alias("n")
    )
    return counts.withColumn("share", F.col("n") / F.sum("n").over(Window.partitionBy()))


def class_balance(df: DataFrame, target: str) -> DataFrame:
    """Majority, minority, ratio, baseline accuracy and imbalance level; missing labels count as a class."""
    from cohortloom.functions.scalar import imbalance_level

    c = class_counts(df, target).agg(
        F.sum("n").alias("n"),
        F.max("n").alias("majority"),
        F.min("n").alias("minority"),
        F.count(F.when(F.col("class") != MISSING_CLASS, 1)).alias("classes"),
    )
    ratio = F.col("majority") / F.col("minority")
    return c.select("*", ratio.alias("ratio"), (F.col("majority") / F.col("n")).alias("baseline"),
                    imbalance_level(ratio).alias("level"))


def state_counts(df: DataFrame, keys: Sequence[str], state: str, states: Sequence[str]) -> DataFrame:
    """Counts by state as columns, 0 where absent."""
    return df.groupBy(*keys).agg(*[flag_sum(F.col(state) == s).alias(f"trials_{s.lower()}") for s in states])


def _named(df: DataFrame, keys: list[str], cols: Sequence[str], names: dict[str, float]) -> DataFrame:
    return wide_quantiles(df, keys, list(cols), names)


def robust_z(df: DataFrame, cols: Sequence[str]) -> DataFrame:
    """``z_<c>``: (x - median) / (1.4826 MAD) after median fill; a MAD of 0 gives 0. Two passes, one row each."""
    med = _named(df, [], cols, {"med": 0.5}).first().asDict()
    filled = df
    for c in cols:
        filled = filled.withColumn(f"_f_{c}", F.coalesce(F.col(c), F.lit(med[f"med_{c}"])))
    dev = filled.select(*[F.abs(F.col(f"_f_{c}") - F.lit(med[f"med_{c}"])).alias(c) for c in cols])
    mad = _named(dev, [], cols, {"mad": 0.5}).first().asDict()
    return filled.select(
        *df.columns,
        *[
            ((F.col(f"_f_{c}") - F.lit(med[f"med_{c}"])) / F.lit(1.4826 * mad[f"mad_{c}"])).alias(f"z_{c}")
            if mad[f"mad_{c}"]
            else F.lit(0.0).alias(f"z_{c}")
            for c in cols
        ],
    )


def within_group_robust_z(df: DataFrame, cols: Sequence[str], group: str, min_n: int) -> DataFrame:
    """``z_<c>`` inside groups of at least ``min_n`` rows, the global score elsewhere."""
    scored = robust_z(df, cols)
    med = _named(df, [group], cols, {"med": 0.5})
    size = df.groupBy(group).agg(F.count(F.lit(1)).alias("_n"))
    base = null_safe(null_safe(scored, size, [group], "left"), med, [group], "left")
    dev = base.select(
        F.col(group), *[F.abs(F.coalesce(F.col(c), F.col(f"med_{c}")) - F.col(f"med_{c}")).alias(c) for c in cols]
    )
    mad = _named(dev, [group], cols, {"mad": 0.5})
    both = null_safe(base, mad, [group], "left")
    out = []
    for c in cols:
        spread = F.col(f"mad_{c}")
        z = (F.coalesce(F.col(c), F.col(f"med_{c}")) - F.col(f"med_{c}")) / (F.lit(1.4826) * F.when(spread != 0, spread))
        out.append(F.when(F.col("_n") >= min_n, F.coalesce(z, F.lit(0.0))).otherwise(F.col(f"z_{c}")).alias(f"z_{c}"))
    return both.select(*df.columns, *out)


def rms_score(cols: Sequence[Column]) -> Column:
    """Root mean square of score columns."""
    return F.sqrt(sum((c * c for c in cols), F.lit(0.0)) / F.lit(float(len(cols))))


def group_median_iqr(df: DataFrame, cols: Sequence[str], group: str, min_n: int = 5) -> DataFrame:
    """Median and IQR per group and column (long form) with the global fallback rules.

    Global IQR 0 becomes 1; a group IQR of 0 becomes the global one; groups below ``min_n`` use global values.
    """
    ps = [0.25, 0.5, 0.75]
    glob = exact_quantiles(df, [], list(cols), ps)
    g_iqr = F.col("q2") - F.col("q0")
    glob = glob.select(
        "feature", F.col("q1").alias("g_med"), F.when(g_iqr == 0, F.lit(1.0)).otherwise(g_iqr).alias("g_iqr")
    )
    sizes = df.groupBy(group).agg(F.count(F.lit(1)).alias("n_group"))
    frame = sizes.select("*", F.explode(F.array(*[F.lit(c) for c in cols])).alias("feature"))
    local = exact_quantiles(df, [group], list(cols), ps).drop("n")
    joined = null_safe(frame, local, [group, "feature"], "left").join(glob, "feature", "left")
    iqr = F.col("q2") - F.col("q0")
    big = F.col("n_group") >= min_n
    return joined.select(
        group,
        "feature",
        "n_group",
        F.coalesce(F.when(big, F.col("q1")), F.col("g_med")).alias("median"),
        F.coalesce(F.when(big & (iqr != 0), iqr), F.col("g_iqr")).alias("iqr"),
    )


def moment_maps(df: DataFrame, keys: Sequence[str], value: str) -> DataFrame:
    """Count, mean and M2 per cell; Spark merges the partial moments on the map side."""
    v = F.col(value)
    return df.groupBy(*keys).agg(F.count(v).alias("n"), F.avg(v).alias("mean"), (F.var_pop(v) * F.count(v)).alias("m2"))


def effect_size(moments: DataFrame, keys: Sequence[str], label: str) -> DataFrame:
    """Difference of class means, pooled SD, Cohen d (0 when the SD is tiny) and Hedges g per cell."""
    def pick(c, y):
        return F.max(F.when(F.col(label) == y, F.col(c)))

    w = moments.groupBy(*keys).agg(
        *[pick(c, y).alias(f"{c}{y}") for c in ("n", "mean", "m2") for y in (0, 1)]
    )
    dof = F.col("n0") + F.col("n1") - 2
    sd = F.sqrt((F.col("m20") + F.col("m21")) / F.greatest(dof, F.lit(1)))
    w = w.withColumn("difference", F.col("mean1") - F.col("mean0")).withColumn("pooled_sd", sd).withColumn("_dof", dof)
    d = F.when(F.col("pooled_sd") > 1e-6, F.col("difference") / F.when(F.col("pooled_sd") > 1e-6, F.col("pooled_sd")))
    w = w.withColumn("cohen_d", F.coalesce(d, F.lit(0.0)))
    correction = F.lit(1.0) - F.lit(3.0) / F.greatest(F.lit(4.0) * F.col("_dof") - F.lit(1.0), F.lit(1.0))
    return w.withColumn("hedges_g", F.col("cohen_d") * correction).drop("_dof")


def pivot_predictions(
    df: DataFrame, keys: Sequence[str], model: str, value: str, models: Sequence[str], strict: bool = True
) -> DataFrame:
    """Long predictions to one column per model; a missing or repeated prediction fails unless ``strict`` is off."""
    picks = [F.max(F.when(F.col(model) == m, F.col(value))).alias(m) for m in models]
    hits = [F.count(F.when(F.col(model) == m, F.col(value))).alias(f"_n_{m}") for m in models]
    wide = df.groupBy(*keys).agg(*picks, *hits)
    if strict:
        for m in models:
            wide = require(wide, F.col(f"_n_{m}") == 1, f"model {m} must predict each record once")
    return wide.select(*keys, *models)


def ensemble_mean(df: DataFrame, cols: Sequence[str], weights: Sequence[float] | None = None) -> DataFrame:
    """Weighted row mean (clipped) and sample deviation across models, without a shuffle."""
    from cohortloom.functions.scalar import clip_probability

    w = list(weights or [1.0] * len(cols))
    mean = sum((F.col(c) * F.lit(float(x)) for c, x in zip(cols, w)), F.lit(0.0)) / F.lit(float(sum(w)))
    plain = sum((F.col(c) for c in cols), F.lit(0.0)) / F.lit(float(len(cols)))
    spread = sum(((F.col(c) - plain) * (F.col(c) - plain) for c in cols), F.lit(0.0)) / F.lit(float(len(cols) - 1))
    return df.select("*", clip_probability(mean).alias("p_mean"), F.sqrt(spread).alias("disagreement"))


def corr_matrix(df: DataFrame, cols: Sequence[str], key: str | None = None, method: str = "pearson") -> DataFrame:
    """Correlation of every column pair as (a, b, corr), for hundreds of columns; Spearman correlates tie-averaged ranks."""
    return correlations(feature_ranks(df, key, cols) if method == "spearman" else df, cols)


def feature_ranks(df: DataFrame, key: str, cols: Sequence[str], pct: bool = False) -> DataFrame:
    """Tie-averaged rank of each column (NULL stays NULL), one row per key; ``pct`` divides by the non-null count."""
    cells = F.array(*[F.struct(F.lit(c).alias("feature"), F.col(c).cast("double").alias("v")) for c in cols])
    long = df.select(key, F.explode(cells).alias("e")).select(key, "e.feature", "e.v")
    rank = average_rank() / F.col("n") if pct else average_rank()
    ranks = value_ranks(long, ["feature"], "v").select("feature", "v", rank.alias("rank"))
    ranked = long.join(ranks, ["feature", "v"], "left")
    wide = ranked.groupBy(key).agg(*[F.max(F.when(F.col("feature") == c, F.col("rank"))).alias(c) for c in cols])
    return wide


def fold_summary(df: DataFrame, fold: str, label: str, group: str, valid: str) -> DataFrame:
    """Rows, positives, prevalence, families and valid share per fold; families come from a pre-aggregation."""
    cells = df.groupBy(fold, group).agg(
        F.count(F.lit(1)).alias("n"), F.sum(label).alias("pos"), flag_sum(F.col(valid)).alias("ok")
    )
    return cells.groupBy(fold).agg(
        F.sum("n").alias("n"),
        F.sum("pos").alias("pathologic"),
        (F.sum("pos") / F.sum("n")).alias("prevalence"),
        F.count(group).alias("families"),
        (F.sum("ok") / F.sum("n")).alias("valid_fraction"),
    )


def group_balance_score(summary: DataFrame, keys: Sequence[str] = ()) -> DataFrame:
    """Size CV + 2.5 prevalence SD + 0.25 family CV + 0.75 valid-share SD over the folds (smaller is better)."""
    cv = lambda c: F.stddev_pop(c) / F.greatest(F.avg(c), F.lit(1.0))
    score = (
        cv("n")
        + F.lit(2.5) * F.stddev_pop("prevalence")
        + F.lit(0.25) * cv("families")
        + F.lit(0.75) * F.stddev_pop("valid_fraction")
    )
    return summary.groupBy(*keys).agg(score.alias("score"), F.count(F.lit(1)).alias("folds"))


def family_penalty(df: DataFrame, fold: str, group: str, k: int, keys: Sequence[str] = ()) -> DataFrame:
    """sqrt(n)-weighted mean absolute deviation of each family's fold shares from 1/k; absent folds count as 0."""
    cells = df.groupBy(*keys, group, fold).agg(F.count(F.lit(1)).alias("c"))
    totals = cells.groupBy(*keys, group).agg(
        F.sum("c").alias("total"), F.count(F.lit(1)).alias("seen"), F.collect_list("c").alias("counts")
    )
    target = F.lit(1.0 / k)
    deviation = F.aggregate(
        "counts", F.lit(0.0), lambda acc, c: acc + F.abs(c / F.col("total") - target)
    ) + (F.lit(k) - F.col("seen")) * target
    weighted = totals.select(*keys, F.sqrt("total").alias("w"), (deviation / F.lit(float(k))).alias("dev"))
    return weighted.groupBy(*keys).agg((F.sum(F.col("w") * F.col("dev")) / F.sum("w")).alias("penalty"))


def patient_balance_score(df: DataFrame, fold: str, label: str, group: str, valid: str, k: int) -> DataFrame:
    """3 prevalence SD + 1.5 valid-share SD + family penalty."""
    s = fold_summary(df, fold, label, group, valid).agg(
        F.stddev_pop("prevalence").alias("p"), F.stddev_pop("valid_fraction").alias("v")
    )
    pen = family_penalty(df, fold, group, k)
    return one_row(s, pen).select((F.lit(3.0) * F.col("p") + F.lit(1.5) * F.col("v") + F.col("penalty")).alias("score"), "penalty")


def equal_width_bin(v: Column, lo: Column, hi: Column, bins: int) -> Column:
    """Equal-width bin number over [lo, hi], last bin closed; 0 for a constant column."""
    width = F.when(hi > lo, hi - lo)
    return F.coalesce(F.least(F.floor((v - lo) / width * bins), F.lit(bins - 1)), F.lit(0)).cast("int")


def histogram(df: DataFrame, value: str, bins: int, by: Sequence[str] = (), lo: float | None = None,
              hi: float | None = None) -> DataFrame:
    """Counts per equal-width bin and group."""
    kept = df.where(F.col(value).isNotNull())
    if lo is None or hi is None:
        ends = kept.agg(F.min(value).alias("lo"), F.max(value).alias("hi")).first()
        lo, hi = ends["lo"], ends["hi"]
    b = equal_width_bin(F.col(value), F.lit(lo), F.lit(hi), bins)
    return kept.groupBy(*by, b.alias("bin")).agg(F.count(F.lit(1)).alias("n"))


def histogram_entropy(df: DataFrame, keys: Sequence[str], value: str, bins: int) -> DataFrame:
    """Shannon entropy in bits of the equal-width histogram of each group; 0 when constant."""
    kept = df.where(F.col(value).isNotNull())
    ends = kept.groupBy(*keys).agg(F.min(value).alias("_lo"), F.max(value).alias("_hi"))
    b = equal_width_bin(F.col(value), F.col("_lo"), F.col("_hi"), bins)
    counts = null_safe(kept, ends, list(keys)).groupBy(*keys, b.alias("_bin")).agg(F.count(F.lit(1)).alias("c"))
    n = F.sum("c")
    entropy = F.log2(n) - F.sum(F.col("c") * F.log2("c")) / n
    return counts.groupBy(*keys).agg(n.alias("n"), F.greatest(entropy, F.lit(0.0)).alias("entropy"))


#: Parts of a group in which its values meet the group's median.
MEDIAN_PARTS = 256


def percentile_profile(df: DataFrame, keys: Sequence[str], value: str, ps: Sequence[float]) -> DataFrame:
    """Exact percentiles, mean, SD, MAD and energy per group; nothing is collected per group.

    Equal values are merged once for both quantile passes. The medians are told once per part of a group, so no task sorts
    a whole group to join its median.
    """
    keys, v = list(keys), F.col(value)
    names = {f"p{i}": p for i, p in enumerate(ps)}
    counts = cut(df.where(v.isNotNull()).groupBy(*keys, value).agg(F.count(F.lit(1)).alias("_rows")))
    counts = counts.withColumn("_part", F.pmod(F.xxhash64(value), F.lit(MEDIAN_PARTS)))
    pct = wide_quantiles(counts, keys, [value], {**names, "med": 0.5}, rows="_rows")
    told = null_safe(counts.select(*keys, "_part").distinct(), pct.select(*keys, f"med_{value}"), keys)
    base = null_safe(counts, told, [*keys, "_part"]).select(*keys, F.abs(v - F.col(f"med_{value}")).alias("dev"), "_rows")
    mad = wide_quantiles(base, keys, ["dev"], {"mad": 0.5}, rows="_rows")
    stats = df.groupBy(*keys).agg(F.avg(v).alias("mean"), F.stddev_pop(v).alias("std"), F.avg(v * v).alias("energy"))
    out = null_safe(null_safe(stats, pct, keys), mad, keys)
    return out.select(*keys, "mean", "std", "energy", F.col("mad_dev").alias("mad"),
                      *[F.col(f"{n}_{value}").alias(n) for n in names])


def best_half(trials: DataFrame, keys: Sequence[str], value: str, number: str) -> DataFrame:
    """The better half (at least two) of the trials with a value, per study."""
    done = trials.where(F.col(value).isNotNull())
    ranked = running(
        done, list(keys), value, {"_rn": ("row_number", None), "_n": ("total", F.lit(1))}, tie=[number]
    )
    return ranked.where(F.col("_rn") <= F.greatest(F.lit(2), F.ceil(F.col("_n") * F.lit(0.5)))).drop("_rn", "_n")


def mode_by(df: DataFrame, keys: Sequence[str], value: str, out: str) -> DataFrame:
    """Most frequent value per group, the smallest on ties."""
    counts = df.where(F.col(value).isNotNull()).groupBy(*keys, value).agg(F.count(F.lit(1)).alias("_c"))
    return counts.groupBy(*keys).agg(F.min(F.struct(-F.col("_c"), F.col(value).alias("v"))).alias("_m")).select(
        *keys, F.col("_m.v").alias(out)
    )


def worst_group(metrics: DataFrame, keys: Sequence[str], loss: str, min_n: int = 10) -> DataFrame:
    """Largest loss over groups with at least ``min_n`` rows, with the group's size."""
    kept = metrics.where(F.col("n") >= min_n)
    return kept.groupBy(*keys).agg(F.max(loss).alias("worst_loss"), F.count(F.lit(1)).alias("groups"))


def error_concentration(df: DataFrame, keys: Sequence[str], label: str, prob: str, fracs: Sequence[float]) -> DataFrame:
    """Share of the total loss held by the worst ``ceil(frac n)`` rows, exact with ties and without a global sort."""
    losses = df.select(*keys, row_log_loss(F.col(label), F.col(prob)).alias("loss"))
    ranked = value_ranks(losses, list(keys), "loss")
    above = F.col("n") - F.col("before") - F.col("cnt")
    rows = ranked.select("*", F.explode(F.array(*[F.lit(float(f)) for f in fracs])).alias("fraction"))
    take = F.greatest(F.lit(0), F.least(F.col("cnt"), F.ceil(F.col("n") * F.col("fraction")) - above))
    return rows.groupBy(*keys, "fraction").agg(
        (F.sum(F.col("loss") * take) / F.sum(F.col("loss") * F.col("cnt"))).alias("loss_share")
    )


def disagreement_groups(df: DataFrame, label: str, a: str, b: str) -> DataFrame:
    """Size, prevalence and losses split by whether two models disagree at 0.5."""
    flag = (F.col(a) >= 0.5) != (F.col(b) >= 0.5)
    y = F.col(label)
    return df.groupBy(flag.alias("disagree")).agg(
        F.count(F.lit(1)).alias("n"),
        F.avg(y).alias("prevalence"),
        F.avg(row_log_loss(y, F.col(a))).alias("loss_a"),
        F.avg(row_log_loss(y, F.col(b))).alias("loss_b"),
    )


def feature_audit(df: DataFrame, cols: Sequence[str], max_missing: float = 0.2) -> DataFrame:
    """Missing share, distinct values and sample SD per feature, and whether the feature is kept."""
    from cohortloom.operators.catalog import distinct_counts

    counts = distinct_counts(df.select(*cols))
    row = df.agg(*[F.stddev_samp(c).alias(c) for c in cols])
    sds = row.unpivot([], list(cols), "feature", "std")
    missing = (F.col("n_rows") - F.col("n_non_null")) / F.col("n_rows")
    return counts.join(sds, "feature").select(
        "feature", missing.alias("missing_share"), "n_distinct", "std", (missing <= max_missing).alias("kept")
    )


def network_ranking(trials: DataFrame, keys: Sequence[str], value: str) -> DataFrame:
    """Best, mean and SD of the objective per network, best first."""
    return (
        trials.where(F.col(value).isNotNull())
        .groupBy(*keys)
        .agg(F.min(value).alias("best"), F.avg(value).alias("mean"), F.stddev_samp(value).alias("std"),
             F.count(value).alias("n"))
        .orderBy("best", *keys)
    )


def efficiency(trials: DataFrame, keys: Sequence[str], value: str, seconds: str, state: str) -> DataFrame:
    """Total minutes and best objective of complete trials with a positive duration."""
    kept = trials.where((F.col(state) == "COMPLETE") & (F.col(seconds) > 0) & F.col(value).isNotNull())
    return kept.groupBy(*keys).agg(
        F.count(F.lit(1)).alias("n"), (F.sum(seconds) / F.lit(60.0)).alias("minutes"), F.min(value).alias("best")
    )


def progress_matrix(df: DataFrame, keys: Sequence[str], fold: str, value: str, folds: Sequence[int]) -> DataFrame:
    """Mean value per candidate and fold as columns ``fold_<k>``."""
    return df.groupBy(*keys).agg(*[F.avg(F.when(F.col(fold) == k, F.col(value))).alias(f"fold_{k}") for k in folds])


def select_epochs(best: DataFrame, outer: str, epoch: str, minimum: int = 1) -> DataFrame:
    """Half-to-even rounded median of the inner best epochs per outer fold, at least ``minimum``."""
    med = exact_quantiles(best, [outer], [epoch], [0.5])
    return med.select(outer, F.greatest(F.bround("q0", 0).cast("int"), F.lit(minimum)).alias("epochs"))
