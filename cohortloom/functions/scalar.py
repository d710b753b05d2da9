"""Column expressions: identifiers, cleaning, probability maths, flags and labels. All stay inside codegen."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Imbalance names, clipping bounds, feature variants, lateral strategies and state order used by the domain.
IMBALANCE_LEVELS = ("Bajo", "Moderado", "Alto", "No calculable")
MISSING_CLASS = "<FALTANTE>"
EPS = 1e-6
LOGIT_CLIP = 40.0
FEATURE_VARIANTS = ("image_radiomics_sbr", "image_radiomics", "image_only")
LATERAL_STRATEGIES = ("random_flip", "canonical")
STATE_PRIORITY = (("COMPLETE", 0), ("RUNNING", 1), ("WAITING", 2), ("PRUNED", 3), ("FAIL", 4))


def normalize_identifier(col: Column) -> Column:
    """Base name, trimmed, lower case, without ``.nii`` or ``.nii.gz``."""
    base = F.regexp_extract(col, r"([^/]*)/*$", 1)
    return F.regexp_replace(F.lower(F.trim(base)), r"\.nii(\.gz)?$", "")


def signature(counts: Sequence[str], sizes: Sequence[str], decimals: int = 3) -> Column:
    """Text such as ``64x64x64|2.460,2.460,2.460``."""
    fmt = "x".join(["%d"] * len(counts)) + "|" + ",".join([f"%.{decimals}f"] * len(sizes))
    return F.format_string(fmt, *[F.col(c) for c in [*counts, *sizes]])


def select_block(df: DataFrame, prefixes: Sequence[str], keep: Sequence[str] = ()) -> DataFrame:
    """Columns that start with one of the prefixes, after the ``keep`` columns."""
    return df.select(*keep, *[c for c in df.columns if c not in keep and c.startswith(tuple(prefixes))])


def clean_numeric(col: Column) -> Column:
    """Number or NULL: bad text, NaN and infinities become NULL."""
    number = col.try_cast("double")
    return F.when(~F.isnan(number) & (F.abs(number) != F.lit(float("inf"))), number)


def signed_log1p(col: Column) -> Column:
    return F.signum(col) * F.log1p(F.abs(col))


def clip(col: Column, lo: float, hi: float) -> Column:
    """Bounds that keep NULL as NULL (``greatest`` alone would skip it)."""
    return F.when(col.isNotNull(), F.greatest(F.least(col, F.lit(hi)), F.lit(lo)))


def safe_ratio(a: Column, b: Column, eps: float = EPS) -> Column:
    return F.when(b.isNotNull(), a / F.greatest(F.abs(b), F.lit(eps)))


def positive_ratio(a: Column, b: Column) -> Column:
    """``a / b`` where ``b`` is positive, otherwise 0."""
    return F.when(b > 0, a / F.when(b > 0, b)).otherwise(F.lit(0.0))


def clip_probability(p: Column) -> Column:
    return clip(p, EPS, 1 - EPS)


def logit(p: Column) -> Column:
    q = clip_probability(p)
    return F.ln(q / (F.lit(1.0) - q))


def sigmoid(z: Column) -> Column:
    return F.lit(1.0) / (F.lit(1.0) + F.exp(-clip(z, -LOGIT_CLIP, LOGIT_CLIP)))


def row_log_loss(y: Column, p: Column) -> Column:
    q = clip_probability(p)
    return -(y * F.ln(q) + (F.lit(1) - y) * F.log1p(-q))


def flag_confident_wrong(y: Column, p: Column, hi: float = 0.9, lo: float = 0.1) -> Column:
    return ((p > hi) & (y == 0)) | ((p < lo) & (y == 1))


def flag_all_confident_wrong(y: Column, ps: Sequence[Column], hi: float = 0.8, lo: float = 0.2) -> Column:
    """Every model is sure and wrong."""
    over, under = y == 0, y == 1
    for p in ps:
        over, under = over & (p > hi), under & (p < lo)
    return over | under


def decision(p: Column, threshold: float = 0.5) -> Column:
    return p >= threshold


def imbalance_level(ratio: Column) -> Column:
    low, moderate, high, unknown = IMBALANCE_LEVELS
    return (
        F.when(ratio.isNull() | (ratio == F.lit(float("inf"))), unknown)
        .when(ratio < 1.5, low)
        .when(ratio < 3.0, moderate)
        .otherwise(high)
    )


def log_rate(col: Column, floor: float = 1e-12) -> Column:
    """log10 scale for named rates such as the learning rate."""
    return F.log10(F.greatest(col, F.lit(floor)))


def json_map(col: Column) -> Column:
    """JSON text as a map; anything that is not an object becomes an empty map."""
    return F.coalesce(F.from_json(col, "map<string,string>"), F.create_map().cast("map<string,string>"))


def explode_params(df: DataFrame, json_col: str, names: Sequence[str]) -> DataFrame:
    """Trial parameters as ``param__*`` columns."""
    params = json_map(F.col(json_col))
    return df.select(*df.columns, *[F.try_element_at(params, F.lit(n)).alias(f"param__{n}") for n in names])


def explode_fold_scores(df: DataFrame, json_col: str) -> DataFrame:
    """One row per (row, fold) of a JSON array of scores; values that are not numbers are dropped."""
    scores = F.from_json(F.col(json_col), "array<string>")
    keep = [c for c in df.columns if c != json_col]
    long = df.select(*keep, F.posexplode(scores).alias("fold", "_text"))
    return long.withColumn("score", clean_numeric(F.col("_text"))).where(F.col("score").isNotNull()).drop("_text")


def study_variant(name: Column) -> Column:
    expr = F.lit("unknown")
    for v in reversed(FEATURE_VARIANTS):
        expr = F.when(name.endswith(v), v).otherwise(expr)
    return expr


def study_lateral(name: Column) -> Column:
    expr = F.lit("unknown")
    for v in reversed(LATERAL_STRATEGIES):
        expr = F.when(name.contains(f"_{v}_"), v).otherwise(expr)
    return expr


def study_architecture(name: Column) -> Column:
    """Architecture from a study name such as ``node07_25d_canonical_image_only``."""
    body = F.regexp_replace(name, r"^(cnn|node\d+)_", "")
    return (
        F.when(body.startswith("slab2d_"), "slab2d")
        .when(body.startswith("25d_"), "2.5d")
        .when(body.startswith("3d_"), "3d")
        .otherwise("unknown")
    )


def stable_hash(cols: Sequence[str], length: int = 64, ignore: Sequence[str] = ()) -> Column:
    """SHA-256 of the JSON object of the columns in name order; ``ignore`` leaves result columns out."""
    ordered = sorted(c for c in cols if c not in ignore)
    text = F.to_json(F.struct(*[F.col(c) for c in ordered]))
    return F.substring(F.sha2(text.cast("binary"), 256), 1, length)


def valid_path_component(col: Column) -> Column:
    return col.rlike(r"^[A-Za-z0-9._-]+$") & ~col.isin(".", "..")


def registration_flag(before: Column, after: Column, low: float = 0.55, drop: float = -0.05) -> Column:
    """Missing, weak or worsened alignment."""
    return after.isNull() | F.coalesce(after < low, F.lit(False)) | F.coalesce((after - before) < drop, F.lit(False))


def fallback_flag(before: Column, after: Column, low: float = 0.35, drop: float = 0.03) -> Column:
    return after.isNull() | (after < low) | F.coalesce(after < before - drop, F.lit(False))


def background_risk(valid: Column, floor_applied: Column) -> Column:
    return (~valid | floor_applied).cast("double")


def progress_status(n_predictions: Column, epochs: Column) -> Column:
    return F.when(n_predictions > 0, "complete").when(epochs > 0, "training").otherwise("pending")


def progress_fraction(done: Column, planned: Column) -> Column:
    return F.when(planned > 0, F.least(F.lit(1.0), done / F.when(planned > 0, planned))).otherwise(F.lit(0.0))


def network_label(node: Column, architecture: Column, variant: Column, lateral: Column) -> Column:
    suffix = F.when(lateral.isin(*LATERAL_STRATEGIES), lateral)
    return F.concat_ws(" · ", F.regexp_replace(node, "node", ""), architecture, variant, suffix)


def structure_score(trust: Column, jaccard: Column, family: Column, spacing: Column) -> Column:
    one = F.lit(1.0)
    return F.lit(0.5) * trust + F.lit(0.3) * jaccard + F.lit(0.1) * (one - family) + F.lit(0.1) * (one - spacing)


def label_score(silhouette: Column, knn_accuracy: Column) -> Column:
    return F.lit(0.5) * clip((silhouette + F.lit(1.0)) / F.lit(2.0), 0.0, 1.0) + F.lit(0.5) * knn_accuracy


def balanced_score(label: Column, structure: Column) -> Column:
    """Harmonic mean of the two scores."""
    return F.lit(2.0) * label * structure / F.greatest(label + structure, F.lit(1e-8))


def state_rank(state: Column) -> Column:
    expr = F.lit(9)
    for name, rank in reversed(STATE_PRIORITY):
        expr = F.when(state == name, rank).otherwise(expr)
    return expr
