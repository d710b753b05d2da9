"""Ordered work over unbounded groups without putting a group into one task.

A plain window sorts a whole group in one task, which fails when one key holds a third of the rows. Here the
ordering column is cut into ranges whose edges come from a quantile sketch, so every (group, range) cell holds at
most about ``rows / ranges`` rows. The window runs inside a cell; what crosses cells (counts, sums, running minima)
is carried by a table with one row per cell. Ties are never split, so callers with heavy ties aggregate them first
(``value_ranks`` does).
"""

from __future__ import annotations

import math

from pyspark.ml.feature import Bucketizer
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from cohortloom.session import cut, partitions

BUCKET = "_cell"


def split_points(df: DataFrame, col: str, parts: int | None = None) -> list[float]:
    """Range edges for ``col``: one sketch pass, ``parts`` numbers on the driver whatever the table size."""
    parts = parts or max(16, 2 * partitions(df.sparkSession))
    numeric = df.select(F.col(col).cast("double").alias("v")).where(F.col("v").isNotNull() & ~F.isnan("v"))
    probs = [i / parts for i in range(1, parts)]
    points = numeric.approxQuantile("v", probs, 1 / (2 * parts))
    return sorted({p for p in points if math.isfinite(p)})


def add_cell(df: DataFrame, col: str, splits: list[float] | None = None) -> DataFrame:
    """Add the range number of ``col`` (null and NaN go to a range of their own, after the others)."""
    splits = split_points(df, col) if splits is None else splits
    if not splits:
        return df.withColumn(BUCKET, F.lit(0))
    edges = [-math.inf, *splits, math.inf]
    keyed = df.withColumn("_order", F.col(col).cast("double"))
    bucketizer = Bucketizer(splits=edges, inputCol="_order", outputCol=BUCKET, handleInvalid="keep")
    return bucketizer.transform(keyed).drop("_order").withColumn(BUCKET, F.col(BUCKET).cast("int"))


def null_safe(left: DataFrame, right: DataFrame, keys: list[str], how: str = "inner") -> DataFrame:
    """Equi join on ``keys`` where null equals null; the right copies of the keys are dropped."""
    renamed = right
    for k in keys:
        renamed = renamed.withColumnRenamed(k, f"_r_{k}")
    cond = None
    for k in keys:
        part = left[k].eqNullSafe(renamed[f"_r_{k}"])
        cond = part if cond is None else cond & part
    return left.join(renamed, cond, how).drop(*[f"_r_{k}" for k in keys])


def running(
    df: DataFrame,
    keys: list[str],
    order: str,
    specs: dict[str, tuple[str, Column | None]],
    tie: list[str] | None = None,
    splits: list[float] | None = None,
    cell: Column | None = None,
) -> DataFrame:
    """Running values per group in ``order``: ``{name: (kind, column)}``.

    kinds: ``row_number``; ``sum``, ``count``, ``min``, ``max`` up to and including the row; ``before``, ``min_before``,
    ``max_before`` (sum, minimum, maximum of the rows strictly before); ``total`` (sum over the group); ``prev`` (value of the row before). ``cell`` overrides the
    sketch with a caller's own order-preserving range number.
    """
    tie = tie or []
    base = df.withColumn(BUCKET, cell) if cell is not None else add_cell(df, order, splits)
    names = list(specs)
    inputs = {n: f"_in_{n}" for n in names}
    for n in names:
        kind, col = specs[n]
        base = base.withColumn(inputs[n], F.lit(1) if kind == "row_number" else col)
    cell_keys = [*keys, BUCKET]
    order_cols = [F.col(order), *[F.col(t) for t in tie]]
    inside = Window.partitionBy(*cell_keys).orderBy(*order_cols)
    upto = inside.rowsBetween(Window.unboundedPreceding, 0)
    prior = inside.rowsBetween(Window.unboundedPreceding, -1)

    partial, carried, local = [], [], {}
    group_all = Window.partitionBy(*keys) if keys else Window.partitionBy(F.lit(0))
    before_cells = group_all.orderBy(BUCKET).rowsBetween(Window.unboundedPreceding, -1)
    last_order = F.struct(*order_cols)
    for n in names:
        kind, v = specs[n][0], F.col(inputs[n])
        p, c = f"_p_{n}", f"_c_{n}"
        if kind in ("row_number", "sum", "before", "total"):
            partial.append(F.sum(v).alias(p))
            scope = group_all if kind == "total" else before_cells
            carried.append(F.sum(p).over(scope).alias(c))
            if kind == "row_number":
                local[n] = F.row_number().over(inside)
            elif kind == "sum":
                local[n] = F.sum(v).over(upto)
            elif kind == "before":
                local[n] = F.sum(v).over(prior)
        elif kind == "count":
            partial.append(F.count(v).alias(p))
            carried.append(F.sum(p).over(before_cells).alias(c))
            local[n] = F.count(v).over(upto)
        elif kind in ("min", "max"):
            fn = F.min if kind == "min" else F.max
            partial.append(fn(v).alias(p))
            carried.append(fn(p).over(before_cells).alias(c))
            local[n] = fn(v).over(upto)
        elif kind in ("min_before", "max_before"):
            fn = F.min if kind == "min_before" else F.max
            partial.append(fn(v).alias(p))
            carried.append(fn(p).over(before_cells).alias(c))
            local[n] = fn(v).over(prior)
        elif kind == "prev":
            partial.append(F.max_by(v, last_order).alias(p))
            carried.append(F.lag(p).over(group_all.orderBy(BUCKET)).alias(c))
            local[n] = F.lag(v).over(inside)
        else:
            raise ValueError(f"unknown running kind {kind!r}")
    carry = base.groupBy(*cell_keys).agg(*partial).select(*cell_keys, *carried)
    rows = base
    first_row = F.row_number().over(inside) == 1
    if any(specs[n][0] == "prev" for n in names):
        rows = rows.withColumn("_first", first_row)
    for n, expr in local.items():
        rows = rows.withColumn(f"_l_{n}", expr)
    joined = null_safe(rows, carry, cell_keys)
    result = []
    for n in names:
        kind, c, loc = specs[n][0], F.col(f"_c_{n}"), F.col(f"_l_{n}") if n in local else None
        if kind == "total":
            value = c
        elif kind in ("row_number", "count"):
            value = F.coalesce(c, F.lit(0)) + loc
        elif kind == "before":
            value = F.coalesce(c, F.lit(0)) + F.coalesce(loc, F.lit(0))
        elif kind == "sum":
            value = F.when(c.isNull(), loc).when(loc.isNull(), c).otherwise(c + loc)
        elif kind in ("min", "min_before"):
            value = F.least(c, loc)
        elif kind in ("max", "max_before"):
            value = F.greatest(c, loc)
        else:
            value = F.when(F.col("_first"), c).otherwise(loc)
        result.append(value.alias(n))
    return joined.select(*[F.col(x) for x in df.columns], *result)


def value_ranks(
    df: DataFrame, keys: list[str], col: str, sums: dict[str, Column] | None = None, cell: Column | None = None, rows: str | None = None
) -> DataFrame:
    """One row per (group, distinct value): ``cnt``, rows ``before`` it, group size ``n``, plus extra ``sums``.

    Equal values are merged on the map side first, so a value held by a third of all rows costs one row. NULL values
    are left out. The merged table is written once to the shared folder: the sketch and both halves of the scan read
    it, and the source is read a single time. With a range number of the caller (``cell``, in the order of the values) no
    sketch is needed and nothing is written: both halves of the scan reuse the exchange of the merged table. ``rows`` names
    the number of rows that a row stands for, if they are merged already.
    """
    count = F.count(F.lit(1)) if rows is None else F.sum(rows)
    extra = [F.sum(c).alias(k) for k, c in (sums or {}).items()]
    ranks = {"before": ("before", F.col("cnt")), "n": ("total", F.col("cnt"))}
    if cell is not None:
        merged = df.where(F.col(col).isNotNull()).groupBy(*keys, col).agg(count.alias("cnt"), *extra)
        return running(merged, keys, col, ranks, cell=cell)
    counts = cut(df.where(F.col(col).isNotNull()).groupBy(*keys, col).agg(count.alias("cnt"), *extra))
    splits = split_points(counts, col)
    return running(counts, keys, col, ranks, splits=splits)


def average_rank() -> Column:
    """Rank with ties averaged, from the columns of :func:`value_ranks`."""
    return F.col("before") + (F.col("cnt") + F.lit(1.0)) / F.lit(2.0)


def exact_quantiles(df: DataFrame, keys: list[str], cols: list[str], ps: list[float], rows: str | None = None) -> DataFrame:
    """Exact linear-interpolated quantiles per group in long form: (keys, feature, n, q0, q1, ...).

    All columns are handled in one pass over the unpivoted table. ``rows`` as in :func:`value_ranks`.
    """
    kept = [*keys, rows] if rows else keys
    long = df.select(
        *kept,
        F.explode(F.array(*[F.struct(F.lit(c).alias("feature"), F.col(c).cast("double").alias("v")) for c in cols])).alias(
            "e"
        ),
    ).select(*kept, "e.feature", "e.v")
    ranked = value_ranks(long, [*keys, "feature"], "v", rows=rows)
    aggs = []
    for i, p in enumerate(ps):
        pos = F.lit(float(p)) * (F.col("n") - F.lit(1.0))
        for name, at in (("lo", F.floor(pos)), ("hi", F.ceil(pos))):
            hit = (F.col("before") <= at) & (at < F.col("before") + F.col("cnt"))
            aggs.append(F.max(F.when(hit, F.col("v"))).alias(f"_{name}{i}"))
    found = ranked.groupBy(*keys, "feature").agg(F.max("n").alias("n"), *aggs)
    values = []
    for i, p in enumerate(ps):
        pos = F.lit(float(p)) * (F.col("n") - F.lit(1.0))
        lo, hi = F.col(f"_lo{i}"), F.col(f"_hi{i}")
        values.append((lo + (hi - lo) * (pos - F.floor(pos))).alias(f"q{i}"))
    return found.select(*keys, "feature", "n", *values)


def wide_quantiles(df: DataFrame, keys: list[str], cols: list[str], names: dict[str, float], rows: str | None = None) -> DataFrame:
    """:func:`exact_quantiles` with one row per group: columns ``{name}_{col}``."""
    long = exact_quantiles(df, keys, cols, list(names.values()), rows)
    aggs = [
        F.max(F.when(F.col("feature") == c, F.col(f"q{i}"))).alias(f"{name}_{c}")
        for c in cols
        for i, name in enumerate(names)
    ]
    return long.groupBy(*keys).agg(*aggs)


def text_cell(df: DataFrame, col: str, parts: int = 64) -> Column:
    """Order-preserving range number for a text column, from the edges of a bounded keyed sample."""
    keyed = df.select(col).where(F.col(col).isNotNull()).distinct()
    sample = keyed.orderBy(F.md5(F.col(col).cast("binary")), col).limit(4096).collect()
    values = sorted(r[0] for r in sample)
    edges = sorted({values[i * len(values) // parts] for i in range(1, parts)}) if values else []
    if not edges:
        return F.lit(0)
    array = F.array(*[F.lit(e) for e in edges])
    return F.size(F.filter(array, lambda e: e <= F.col(col)))
