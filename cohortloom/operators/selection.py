"""Top-k, deterministic samples, diverse selections, Pareto front and set operations on keyed tables."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from cohortloom.functions.keyed import uniform
from cohortloom.operators.order import null_safe, running, wide_quantiles
from cohortloom.operators.windows import PRUNE_LIMIT, head_per_group, ordinal_rank


def top_k(df: DataFrame, col: str, k: int, tie: Sequence[str], largest: bool = True) -> DataFrame:
    order = F.col(col).desc_nulls_last() if largest else F.col(col).asc_nulls_last()
    return df.orderBy(order, *tie).limit(k)


def sort_nulls_last(df: DataFrame, keys: Sequence[tuple[str, bool]]) -> DataFrame:
    """Sort by (column, ascending) pairs with nulls at the end."""
    return df.orderBy(*[F.col(c).asc_nulls_last() if up else F.col(c).desc_nulls_last() for c, up in keys])


def draw(seed: int | str, key: str) -> Column:
    return uniform(F.concat(F.lit(f"{seed}|"), F.col(key).cast("string")))


def sample_fixed(df: DataFrame, n: int, key: str, seed: int | str) -> DataFrame:
    """``n`` rows without replacement, the same rows for the same seed whatever the partitioning."""
    return df.withColumn("_u", draw(seed, key)).orderBy("_u", key).limit(n).drop("_u")


def _first_by_draw(df: DataFrame, by: Sequence[str], key: str, n: int) -> DataFrame:
    """First ``n`` rows of each class in draw order, with their position ``_rn``."""
    if n <= PRUNE_LIMIT:
        from pyspark.sql import Window

        w = Window.partitionBy(*by).orderBy("_u", key)
        return df.withColumn("_rn", F.row_number().over(w)).where(F.col("_rn") <= n)
    cells = F.floor(F.col("_u") * 1024).cast("int")
    return running(df, list(by), "_u", {"_rn": ("row_number", None)}, tie=[key], cell=cells).where(F.col("_rn") <= n)


def sample_stratified(
    df: DataFrame, n: int, by: str, key: str, seed: int | str, proportional: bool = False
) -> DataFrame:
    """Equal or proportional quota per class, then filled in draw order up to ``n`` rows.

    Only ``n`` rows per class and ``2 n`` fill candidates leave the map side.
    """
    drawn = df.withColumn("_u", draw(seed, key))
    sizes = df.groupBy(by).agg(F.count(F.lit(1)).alias("_c"))
    totals = sizes.agg(F.sum("_c").alias("rows"), F.count(F.lit(1)).alias("classes")).first()
    if totals["rows"] is None:
        return df.limit(0)
    per_class = F.lit(max(1, n // totals["classes"]))
    quota = F.bround(F.lit(float(n)) * F.col("_c") / F.lit(totals["rows"]), 0) if proportional else per_class
    quotas = sizes.select(by, quota.cast("int").alias("_quota"))
    heads = null_safe(_first_by_draw(drawn, [by], key, n), quotas, [by])
    chosen = heads.where(F.col("_rn") <= F.col("_quota")).drop("_rn", "_quota").withColumn("_p", F.lit(0))
    fill = drawn.orderBy("_u", key).limit(2 * n)
    fill = fill.join(chosen.select(key), key, "left_anti").withColumn("_p", F.lit(1))
    return chosen.unionByName(fill).orderBy("_p", "_u", key).limit(n).drop("_p", "_u")


def sample_hard_typical(df: DataFrame, n: int, strata: Sequence[str], key: str, error: str) -> DataFrame:
    """Per stratum half the quota are the largest errors and half evenly spaced others; filled with the largest."""
    pos = running(
        df, list(strata), error, {"_rn": ("row_number", None), "_m": ("total", F.lit(1))}, tie=[key]
    )
    groups = max(df.select(*strata).distinct().count(), 1)
    quota = max(1, n // groups)
    take = F.least(F.col("_m"), F.lit(quota))
    hard = F.greatest(F.lit(1), F.floor(take / 2))
    rest, more = F.col("_m") - hard, F.greatest(F.lit(0), take - hard)
    step = (rest - 1) / F.when(more > 1, more - 1)
    spaced = F.transform(
        F.sequence(F.lit(0), F.greatest(more - 1, F.lit(0)).cast("int")),
        lambda i: F.when(i == more - 1, F.when(more > 1, rest - 1).otherwise(F.lit(0)))
        .otherwise(F.floor(i * F.coalesce(step, F.lit(0.0))))
        .cast("long"),
    )
    place = (F.col("_rn") - 1).cast("long")
    is_hard = place >= rest
    is_typical = (more > 0) & (place < rest) & F.array_contains(spaced, place)
    chosen = pos.where(is_hard | is_typical).drop("_rn", "_m").withColumn("_p", F.lit(0))
    fill = df.orderBy(F.col(error).desc(), key).limit(2 * n + groups)
    fill = fill.join(chosen.select(key), key, "left_anti").withColumn("_p", F.lit(1))
    return chosen.unionByName(fill).orderBy("_p", F.col(error).desc(), key).limit(n).drop("_p")


def select_diverse(df: DataFrame, k: int, loss: str, key: str, architecture: str, variant: str) -> DataFrame:
    """Best overall, best of another architecture, then other variants, then the rest, in loss order."""
    order = [F.col(loss).asc(), F.col(key).asc()]
    best = df.orderBy(*order).limit(1).select(key, architecture, variant).first()
    if best is None:
        return df.limit(0)
    other = df.where(F.col(architecture) != best[architecture]).orderBy(*order).limit(1).select(key).first()
    if other is None:
        other = df.where(F.col(key) != best[key]).orderBy(*order).limit(1).select(key).first()
    second = F.lit(False) if other is None else F.col(key) == other[key]
    priority = (
        F.when(F.col(key) == best[key], 0).when(second, 1).when(F.col(variant) != best[variant], 2).otherwise(3)
    )
    return df.withColumn("_p", priority).orderBy("_p", *order).limit(k).drop("_p")


def select_top2_plus_best(df: DataFrame, loss: str, key: str, category: str, wanted: str, total: int = 3) -> DataFrame:
    """Top two plus the best of a category (filled in loss order), with rank and roles."""
    ranked = ordinal_rank(df, loss, [key])
    best = ranked.where(F.col(category) == wanted).agg(F.min("rank").alias("r")).first()["r"]
    is_best = F.col("rank") == (best if best is not None else -1)
    roles = F.array_compact(
        F.array(
            F.when(F.col("rank") == 1, "top_1_overall"),
            F.when(F.col("rank") == 2, "top_2_overall"),
            F.when(is_best, f"best_{wanted}"),
        )
    )
    roles = F.when(F.size(roles) == 0, F.array(F.lit("diversity_fill"))).otherwise(roles)
    priority = F.when(F.col("rank") <= 2, 0).when(is_best, 1).otherwise(2)
    return (
        ranked.withColumn("roles", F.concat_ws(",", roles)).withColumn("_p", priority).orderBy("_p", "rank").limit(total).drop("_p")
    )


def representatives(df: DataFrame, n: int, label: str, family: str, score: str, key: str) -> DataFrame:
    """Templates: normals (all rows if there are none), the best ``ceil(n / families)`` per family, then the best ``n``."""
    normal = df.where(F.col(label) == 0)
    pool = df if normal.isEmpty() else normal
    families = max(pool.select(family).distinct().count(), 1)
    order = [F.col(score).asc_nulls_last(), F.col(key).asc()]
    return head_per_group(pool, [family], order, -(-n // families)).orderBy(*order).limit(n)


def reference_row(df: DataFrame, label: str, family: str, geometry: Sequence[str], score: str, key: str) -> DataFrame:
    """Normal row of the largest family nearest to its median geometry, plus 0.2 of its score."""
    largest = df.groupBy(family).agg(F.count(F.lit(1)).alias("n")).orderBy(F.col("n").desc(), family).limit(1).first()
    pool = df.where((F.col(label) == 0) & (F.col(family) == largest[family]))
    if pool.isEmpty():
        pool = df.where(F.col(label) == 0)
    if pool.isEmpty():
        pool = df
    med = wide_quantiles(pool, [], list(geometry), {"med": 0.5}).first()
    sd = pool.agg(*[F.stddev_pop(c).alias(c) for c in geometry]).first()
    parts = [(F.col(c) - F.lit(med[f"med_{c}"])) / F.lit(sd[c] or 1.0) for c in geometry]
    distance = F.sqrt(sum((p * p for p in parts), F.lit(0.0)) / F.lit(float(len(geometry))))
    total = distance + F.lit(0.2) * F.coalesce(F.col(score), F.lit(0.0))
    return pool.withColumn("reference_score", total).orderBy("reference_score", key).limit(1)


def pareto_front(df: DataFrame, first: str, second: str) -> DataFrame:
    """Rows not dominated in two objectives to maximise.

    One row per distinct first objective carries the best second one; a running maximum over larger first objectives
    decides, so there is no dominance self join.
    """
    kept = df.where(F.col(first).isNotNull() & F.col(second).isNotNull())
    steps = kept.groupBy(first).agg(F.max(second).alias("_top")).withColumn("_down", -F.col(first))
    steps = running(steps, [], "_down", {"_beyond": ("max_before", F.col("_top"))})
    front = steps.where(F.col("_beyond").isNull() | (F.col("_beyond") < F.col("_top"))).select(first, "_top")
    joined = kept.join(front, first)
    return joined.where(F.col(second) == F.col("_top")).select(*df.columns)


def union_models(dfs: Sequence[DataFrame]) -> DataFrame:
    """Concatenation by column name; missing columns become NULL."""
    out = dfs[0]
    for d in dfs[1:]:
        out = out.unionByName(d, allowMissingColumns=True)
    return out


def id_sets(a: DataFrame, b: DataFrame, key: str) -> DataFrame:
    """Each distinct key with its side (left, right, both): one grouping instead of two anti joins."""
    tagged = a.select(key, F.lit(1).alias("_l"), F.lit(0).alias("_r")).unionByName(
        b.select(key, F.lit(0).alias("_l"), F.lit(1).alias("_r"))
    )
    g = tagged.groupBy(key).agg(F.max("_l").alias("_l"), F.max("_r").alias("_r"))
    side = F.when(F.col("_r") == 0, "left").when(F.col("_l") == 0, "right").otherwise("both")
    return g.select(key, side.alias("side"))


def append_new(df: DataFrame, extra: DataFrame, on: Sequence[str]) -> DataFrame:
    """Rows of ``extra`` whose key is new are added."""
    return df.unionByName(extra.join(df.select(*on), list(on), "left_anti"), allowMissingColumns=True)


def replace_partition(df: DataFrame, part: DataFrame, on: Sequence[str]) -> DataFrame:
    """Rows of the partitions present in ``part`` are replaced by it."""
    return df.join(part.select(*on).distinct(), list(on), "left_anti").unionByName(part)


def unpivot_report(df: DataFrame, ids: Sequence[str], values: Sequence[str]) -> DataFrame:
    return df.unpivot(list(ids), list(values), "metric", "value")
