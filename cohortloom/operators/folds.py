"""Deterministic folds and leakage checks.

Assignments come from the hash of (seed, key), so they do not depend on partitioning and can be stated in SQL.
Positions in draw order use hash ranges as cells: a global row number without a global sort.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cohortloom.functions.keyed import uniform
from cohortloom.operators.joins import reconcile
from cohortloom.operators.order import running
from cohortloom.operators.profile import flag_sum, group_balance_score
from cohortloom.operators.selection import draw

CELLS = 1024


def stratified_folds(df: DataFrame, k: int, seed: int | str, key: str, label: str, out: str = "fold",
                     keys: Sequence[str] = ()) -> DataFrame:
    """Folds whose sizes differ by at most one, overall and per class (``label`` is 0/1)."""
    drawn = df.withColumn("_s", F.col(label) + draw(seed, key))
    cell = F.floor(F.col("_s") * CELLS).cast("int")
    ranked = running(drawn, list(keys), "_s", {"_rn": ("row_number", None)}, tie=[key], cell=cell)
    return ranked.withColumn(out, ((F.col("_rn") - 1) % k).cast("int")).drop("_rn", "_s")


def group_fold(seed, group, k: int):
    """Fold of a whole group from the hash of (seed, group)."""
    text = F.concat(seed.cast("string"), F.lit("|"), group.cast("string"))
    return F.floor(uniform(text) * k).cast("int")


def group_folds(df: DataFrame, k: int, seed: int, group: str, out: str = "fold") -> DataFrame:
    return df.withColumn(out, group_fold(F.lit(seed), F.col(group), k))


def group_table(df: DataFrame, group: str, label: str, valid: str) -> DataFrame:
    return df.groupBy(group).agg(
        F.count(F.lit(1)).alias("n"), F.sum(label).alias("pos"), flag_sum(F.col(valid)).alias("ok")
    )


def score_candidates(df: DataFrame, k: int, seed: int, group: str, label: str, valid: str, candidates: int) -> DataFrame:
    """Balance score of every candidate seed that fills all folds with both classes, from the group table alone."""
    g = group_table(df, group, label, valid)
    seeds = F.explode(F.sequence(F.lit(seed), F.lit(seed + candidates - 1)))
    placed = g.select("*", seeds.alias("candidate")).withColumn("fold", group_fold(F.col("candidate"), F.col(group), k))
    s = placed.groupBy("candidate", "fold").agg(
        F.sum("n").alias("n"), F.sum("pos").alias("pos"), F.sum("ok").alias("ok"), F.count(F.lit(1)).alias("families")
    )
    s = s.select(
        "candidate",
        "n",
        "families",
        (F.col("pos") / F.col("n")).alias("prevalence"),
        (F.col("ok") / F.col("n")).alias("valid_fraction"),
        ((F.col("pos") > 0) & (F.col("pos") < F.col("n"))).alias("both"),
    )
    usable = s.groupBy("candidate").agg(F.min("both").alias("_both"))
    scores = group_balance_score(s, ["candidate"])
    return scores.join(usable, "candidate").where(F.col("_both") & (F.col("folds") == k)).drop("_both")


def best_fold_assignment(
    df: DataFrame, k: int, seed: int, group: str, label: str, valid: str, candidates: int = 256, out: str = "fold"
) -> DataFrame:
    """Group folds of the candidate seed with the smallest score (smallest seed on ties)."""
    scored = score_candidates(df, k, seed, group, label, valid, candidates)
    best = scored.agg(F.min(F.struct("score", "candidate")).alias("b")).first()["b"]
    if best is None:
        raise ValueError("no candidate gives every fold both classes")
    return group_folds(df, k, best["candidate"], group, out)


def best_patient_folds(
    df: DataFrame, k: int, seed: int, key: str, group: str, label: str, valid: str, candidates: int = 4, out: str = "fold"
) -> DataFrame:
    """Label-stratified folds of the candidate seed with the smallest patient score."""
    from cohortloom.operators.profile import patient_balance_score

    best = None
    for candidate in range(seed, seed + max(1, candidates)):
        folds = stratified_folds(df, k, candidate, key, label, out)
        score = patient_balance_score(folds, out, label, group, valid, k).first()["score"]
        if best is None or score < best[0]:
            best = (score, candidate)
    return stratified_folds(df, k, best[1], key, label, out)


def validate_folds(
    manifest: DataFrame, expected: DataFrame, k: int, key: str, label: str, group: str, fold: str, group_disjoint: bool = True
) -> DataFrame:
    """(rule, n_bad): every rule a fold manifest must keep, each with its number of violations."""
    per_key = manifest.groupBy(key).agg(F.count(F.lit(1)).alias("n"))
    repeated = per_key.agg(flag_sum(F.col("n") > 1).alias("repeated_key"))
    r = reconcile(expected, manifest, [key], [label, group]).agg(
        flag_sum(F.col("side") != "both").alias("cohort_mismatch"),
        flag_sum((F.col("side") == "both") & ~F.col(f"same_{label}")).alias("label_changed"),
        flag_sum((F.col("side") == "both") & ~F.col(f"same_{group}")).alias("group_changed"),
    )
    cells = manifest.groupBy(fold, group).agg(
        F.count(F.lit(1)).alias("n"), F.min(label).alias("lo"), F.max(label).alias("hi")
    )
    by_fold = cells.groupBy(fold).agg(F.sum("n").alias("n"), F.min("lo").alias("lo"), F.max("hi").alias("hi"))
    inside = F.col(fold).between(0, k - 1)
    f = by_fold.agg(
        (flag_sum(~inside) + F.lit(k) - flag_sum(inside)).alias("fold_ids"),
        flag_sum(F.col("lo") == F.col("hi")).alias("one_class_fold"),
        (F.max("n") - F.min("n") > 1).cast("bigint").alias("uneven_sizes"),
    )
    g = cells.groupBy(group).agg(F.count(F.lit(1)).alias("folds")).agg(flag_sum(F.col("folds") > 1).alias("group_in_two_folds"))
    f = f.drop("uneven_sizes") if group_disjoint else f
    parts = [repeated, r, f] + ([g] if group_disjoint else [])
    long = [p.unpivot([], p.columns, "rule", "n_bad") for p in parts]
    out = long[0]
    for p in long[1:]:
        out = out.unionByName(p)
    return out


def check_folds(*args, **kwargs) -> None:
    """Raise when any rule of :func:`validate_folds` is broken."""
    bad = [r.asDict() for r in validate_folds(*args, **kwargs).where(F.col("n_bad") > 0).collect()]
    if bad:
        raise ValueError(f"fold manifest rejected: {bad}")


def cohort_hash(df: DataFrame, cols: Sequence[str]) -> DataFrame:
    """One order-free hash of the rows: SHA-256 over the row count and four 32-bit sums of the rows' MD5.

    Sums merge on the map side, so the rows are never sorted or gathered.
    """
    line = F.concat_ws("|", *[F.col(c).cast("string") for c in cols])
    m = df.select(F.md5(line.cast("binary")).alias("m"))
    parts = [F.conv(F.substring("m", 1 + 8 * i, 8), 16, 10).cast("bigint") for i in range(4)]
    sums = m.agg(F.count(F.lit(1)).alias("n"), *[F.coalesce(F.sum(p), F.lit(0)).alias(f"s{i}") for i, p in enumerate(parts)])
    text = F.concat_ws("|", *[F.col(c).cast("string") for c in ["n", "s0", "s1", "s2", "s3"]])
    return sums.select("n", F.sha2(text.cast("binary"), 256).alias("cohort_hash"))


def freeze_folds(df: DataFrame, path: str, build, cols: Sequence[str]) -> DataFrame:
    """Folds saved under ``path``: reused when the cohort hash matches, refused when it does not, else built by ``build``."""
    spark = df.sparkSession
    now = cohort_hash(df, cols).first()["cohort_hash"]
    try:
        saved = spark.read.parquet(f"{path}/meta").first()["cohort_hash"]
    except AnalysisException:
        saved = None
    if saved is None:
        build(df).write.mode("overwrite").parquet(f"{path}/folds")
        spark.createDataFrame([(now,)], "cohort_hash string").write.mode("overwrite").parquet(f"{path}/meta")
    elif saved != now:
        raise ValueError("the saved folds belong to another cohort")
    return spark.read.parquet(f"{path}/folds")


def inner_folds(df: DataFrame, outer: str, outer_folds: int, k: int, seed: int, key: str, label: str) -> DataFrame:
    """For each outer fold, stratified folds over the rows outside it: (held_out, rows, inner_fold)."""
    held = F.explode(F.sequence(F.lit(0), F.lit(outer_folds - 1)))
    train = df.select("*", held.alias("held_out")).where(F.col(outer) != F.col("held_out"))
    return stratified_folds(train, k, seed, key, label, "inner_fold", ["held_out"])


def group_holdout_stress(df: DataFrame, seed: int, group: str, label: str, valid: str, candidates: int = 64) -> DataFrame:
    """A separate three-fold group-disjoint manifest for stress tests."""
    return best_fold_assignment(df, 3, seed, group, label, valid, candidates, "stress_fold")
