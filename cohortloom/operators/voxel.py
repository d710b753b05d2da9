"""Statistics on voxel tables ``(uid, z, y_, x, v, m)``: one row per voxel, ``m`` marks the target mask.

A scan is bounded by its grid (the reader refuses larger ones), so work inside a scan may use windows over ``uid``.
``by_scan`` hashes the voxels by scan once; every window and grouping below reuses that partitioning, so one shuffle
serves a whole chain. Nothing compares scans with each other except through joins on voxel position.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator, Sequence
from functools import reduce

import numpy as np
import pyarrow as pa
import pyarrow.compute  # noqa: F401
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from cohortloom.functions.scalar import clip
from cohortloom.operators import grid
from cohortloom.operators.profile import equal_width_bin

POS = ["z", "y_", "x"]


def whole():
    """Window over all voxels of a scan."""
    return Window.partitionBy("uid")


def line(axis: str):
    """Window along one axis of a scan."""
    return Window.partitionBy("uid", *[c for c in POS if c != axis]).orderBy(axis)


# The thirteen half-space directions, region names, percentiles and limits of the feature definitions.
OFFSETS_13 = (
    (1, 0, 0), (0, 1, 0), (0, 0, 1),
    (1, 1, 0), (1, -1, 0), (1, 0, 1), (1, 0, -1), (0, 1, 1), (0, 1, -1),
    (1, 1, 1), (1, 1, -1), (1, -1, 1), (1, -1, -1),
)
AXES_3 = ((1, 0, 0), (0, 1, 0), (0, 0, 1))
SHIFTS = ((0, 0, 0), (0, 0, 1), (0, 0, -1), (0, 1, 0), (0, -1, 0))
QUADRANTS = ("right_caudate", "right_putamen", "left_caudate", "left_putamen")
PROXIES = (
    "right_caudate", "right_putamen_anterior", "right_putamen_posterior",
    "left_caudate", "left_putamen_anterior", "left_putamen_posterior",
)
SUMMARY_PERCENTILES = (1, 5, 10, 25, 50, 75, 90, 95, 99)
THRESHOLD_PERCENTILES = (70, 80, 90, 95)
MIN_BACKGROUND_VOXELS = 64
MIN_BACKGROUND_SUPPORT = 0.20
SCALE_FLOOR = 0.05


def by_scan(voxels: DataFrame) -> DataFrame:
    return voxels.repartition("uid")


def pct(value: Column, p: float) -> Column:
    """Exact linear-interpolated percentile aggregate (0..100)."""
    return F.percentile(value, F.lit(p / 100.0))


def with_shape(voxels: DataFrame) -> DataFrame:
    return voxels.select(
        "*",
        (F.max("z").over(whole()) + 1).alias("nz"),
        (F.max("y_").over(whole()) + 1).alias("ny"),
        (F.max("x").over(whole()) + 1).alias("nx"),
    )


def offset_join(voxels: DataFrame, offsets: Sequence[tuple[int, int, int]], value: str) -> DataFrame:
    """Each voxel with its neighbour at every offset: (uid, z, y_, x, dz, dy, dx, a, b). Filter to the mask first."""
    shifts = F.array(*[F.struct(F.lit(a).alias("dz"), F.lit(b).alias("dy"), F.lit(c).alias("dx")) for a, b, c in offsets])
    left = voxels.select("uid", *POS, F.col(value).alias("a"), F.explode(shifts).alias("o")).select(
        "uid", *POS, "o.*", "a", (F.col("z") + F.col("o.dz")).alias("_z"), (F.col("y_") + F.col("o.dy")).alias("_y"),
        (F.col("x") + F.col("o.dx")).alias("_x"),
    )
    right = voxels.select("uid", F.col("z").alias("_z"), F.col("y_").alias("_y"), F.col("x").alias("_x"), F.col(value).alias("b"))
    return left.join(right, ["uid", "_z", "_y", "_x"]).drop("_z", "_y", "_x")


def offset_join_masked(voxels: DataFrame, offsets: Sequence[tuple[int, int, int]]) -> DataFrame:
    """Values under the mask moved by every offset: mask voxels send their shifted position, the scan answers with ``b``."""
    shifts = F.array(*[F.struct(F.lit(a).alias("dz"), F.lit(b).alias("dy"), F.lit(c).alias("dx")) for a, b, c in offsets])
    mask = voxels.where("m").select("uid", *POS, F.explode(shifts).alias("o")).select(
        "uid", "o.*", (F.col("z") + F.col("o.dz")).alias("_z"), (F.col("y_") + F.col("o.dy")).alias("_y"), (F.col("x") + F.col("o.dx")).alias("_x")
    )
    right = voxels.select("uid", F.col("z").alias("_z"), F.col("y_").alias("_y"), F.col("x").alias("_x"), F.col("v").alias("b"))
    return mask.join(right, ["uid", "_z", "_y", "_x"]).drop("_z", "_y", "_x")


# --- whole-scan quality ----------------------------------------------------------------------------------------------


def reference_flag() -> Column:
    """Positive voxels, or every finite voxel when a scan has none."""
    return F.col("v").isNotNull() & ((F.col("v") > 0) | (F.max(F.col("v")).over(whole()) <= 0))


def scan_entropy(voxels: DataFrame, bins: int = 64, where: Column | None = None, out: str = "entropy") -> DataFrame:
    """Entropy in bits of the equal-width histogram of each scan."""
    kept = voxels.where(where) if where is not None else voxels
    b = equal_width_bin(F.col("v"), F.min("v").over(whole()), F.max("v").over(whole()), bins)
    counts = kept.select("uid", b.alias("_b")).groupBy("uid", "_b").agg(F.count(F.lit(1)).alias("c"))
    n = F.sum("c")
    e = F.greatest(F.log2(n) - F.sum(F.col("c") * F.log2("c")) / n, F.lit(0.0))
    return counts.groupBy("uid").agg(F.when(n < 2, F.lit(0.0)).otherwise(e).alias(out))


def scan_qc(voxels: DataFrame, spacing: tuple[float, float, float]) -> DataFrame:
    """One row per scan: shape, field of view, voxel volume, finite/zero/positive shares, percentiles, entropy."""
    sz, sy, sx = spacing
    base = by_scan(voxels).select("*", reference_flag().alias("_ref"))
    v = F.col("v")
    ref = F.when(F.col("_ref"), v)
    n_finite = F.count(v)
    stats = base.groupBy("uid").agg(
        *[(F.max(c) + 1).alias(n) for c, n in zip(POS, ("nz", "ny", "nx"))],
        (n_finite / F.count(F.lit(1))).alias("finite_fraction"),
        (F.sum((v == 0).cast("int")) / n_finite).alias("zero_fraction"),
        (F.sum((v > 0).cast("int")) / n_finite).alias("positive_fraction"),
        F.min(v).alias("v_min"),
        F.max(v).alias("v_max"),
        *[pct(ref, p).alias(name) for p, name in ((1, "p01"), (5, "p05"), (50, "p50"), (90, "p90"), (95, "p95"), (99.5, "p995"))],
    )
    stats = stats.select(
        "*", (F.col("nz") * sz).alias("fov_z"), (F.col("ny") * sy).alias("fov_y"), (F.col("nx") * sx).alias("fov_x"),
        F.lit(sz * sy * sx).alias("voxel_volume"),
    )
    ent = scan_entropy(base.where(F.col("_ref")).select("uid", "v"), 64)
    return stats.join(ent, "uid")


def normalize_volume(voxels: DataFrame, lo: float = 1.0, hi: float = 99.5) -> DataFrame:
    """``norm``: percentile min-max of the reference voxels, clipped to [0, 1]."""
    base = by_scan(voxels).select("*", F.when(reference_flag(), F.col("v")).alias("_r"))
    base = base.select("*", pct(F.col("_r"), lo).over(whole()).alias("_lo"), pct(F.col("_r"), hi).over(whole()).alias("_hi"))
    scale = F.greatest(F.col("_hi") - F.col("_lo"), F.lit(float(np.finfo(np.float32).eps)))
    norm = clip((F.coalesce(F.col("v"), F.col("_lo")) - F.col("_lo")) / scale, 0.0, 1.0)
    return base.select(*voxels.columns, norm.alias("norm"))


def robust_normalize(voxels: DataFrame, clip_at=(0.5, 99.5), scale_at=(5.0, 95.0), bounds=(-3.0, 3.0), min_n: int = 32) -> DataFrame:
    """``robust``: clipped at outer percentiles, centred at the median, divided by the percentile range; 0 off the positive."""
    pos = F.when(F.col("v") > 0, F.col("v"))
    base = by_scan(voxels).select("*", pos.alias("_p"))
    ps = [clip_at[0], clip_at[1], scale_at[0], 50.0, scale_at[1]]
    base = base.select(
        "*", F.percentile(F.col("_p"), F.array(*[F.lit(p / 100.0) for p in ps])).over(whole()).alias("_q"), F.count("_p").over(whole()).alias("_n")
    )
    q = lambda i: F.element_at("_q", i + 1)
    z = (F.greatest(F.least(F.col("v"), q(1)), q(0)) - q(3)) / F.greatest(q(4) - q(2), F.lit(1e-6))
    value = F.when((F.col("_n") >= min_n) & (F.col("v") > 0), F.greatest(F.least(z, F.lit(bounds[1])), F.lit(bounds[0])))
    return base.select(*voxels.columns, F.coalesce(value, F.lit(0.0)).alias("robust"))


def adjacent_slice_corr(voxels: DataFrame, value: str = "v") -> DataFrame:
    """Median Pearson correlation of neighbouring z slices; constant slices are skipped."""
    nxt = F.when(F.lead("z").over(line("z")) == F.col("z") + 1, F.lead(value).over(line("z")))
    pairs = by_scan(voxels).select("uid", "z", F.col(value).alias("a"), nxt.alias("b")).where(F.col("b").isNotNull())
    c = pairs.groupBy("uid", "z").agg(F.corr("a", "b").alias("c"), F.stddev_pop("a").alias("sa"), F.stddev_pop("b").alias("sb"))
    kept = F.when((F.col("sa") > 1e-6) & (F.col("sb") > 1e-6), F.col("c"))
    return c.groupBy("uid").agg(F.percentile(kept, F.lit(0.5)).alias("slice_corr"))


def gradient_magnitude(voxels: DataFrame, spacing: tuple[float, float, float], value: str, support: Column) -> DataFrame:
    """Mean central-difference gradient per mm over ``support`` (one-sided at the edges)."""
    parts = []
    for axis, h in zip(POS, spacing):
        before, after = F.lag(value).over(line(axis)), F.lead(value).over(line(axis))
        v = F.col(value)
        g = F.when(before.isNull(), (after - v) / h).when(after.isNull(), (v - before) / h).otherwise((after - before) / (2 * h))
        parts.append(F.coalesce(g, F.lit(0.0)).alias(f"_g{axis}"))
    g = by_scan(voxels).select("uid", support.alias("_s"), *parts)
    size = F.sqrt(sum((F.col(f"_g{a}") * F.col(f"_g{a}") for a in POS), F.lit(0.0)))
    return g.groupBy("uid").agg(F.coalesce(F.avg(F.when(F.col("_s"), size)), F.avg(size)).alias("gradient"))


def foreground_weight(voxels: DataFrame) -> DataFrame:
    """``w``: normalised intensity above the median of the reference voxels, else 0."""
    n = normalize_volume(voxels)
    n = n.select("*", reference_flag().alias("_ref"))
    n = n.select("*", pct(F.when(F.col("_ref"), F.col("v")), 50).over(whole()).alias("_p50"))
    return n.select(*voxels.columns, "norm", F.when(F.col("v") > F.col("_p50"), F.col("norm")).otherwise(F.lit(0.0)).alias("w"))


def weighted_centroid(voxels: DataFrame, weight: str, spacing: tuple[float, float, float]) -> DataFrame:
    """Weighted centre in mm; the grid centre when all weights are 0."""
    w = F.col(weight)
    total = F.sum(w)
    cols = [
        (F.coalesce(F.sum(w * F.col(c)) / F.when(total != 0, total), F.max(c) / F.lit(2.0)) * F.lit(h)).alias(f"centroid_{c}")
        for c, h in zip(POS, spacing)
    ]
    return voxels.groupBy("uid").agg(*cols)


def lr_asymmetry(voxels: DataFrame, weight: str) -> DataFrame:
    """Half sums along x with signed and absolute asymmetry."""
    half = F.floor(F.col("nx") / 2)
    w = F.col(weight)
    g = with_shape(by_scan(voxels)).groupBy("uid").agg(
        F.coalesce(F.sum(F.when(F.col("x") < half, w)), F.lit(0.0)).alias("lower"),
        F.coalesce(F.sum(F.when(F.col("x") >= F.col("nx") - half, w)), F.lit(0.0)).alias("upper"),
    )
    signed = (F.col("upper") - F.col("lower")) / F.greatest((F.col("lower") + F.col("upper")) / F.lit(2.0), F.lit(1e-8))
    return g.select("*", signed.alias("asymmetry_signed"), F.abs(signed).alias("asymmetry_abs"))


def label_components(active: DataFrame) -> DataFrame:
    """(uid, z, y_, x, component): 6-neighbour components of the listed voxels, numbered in raster order.

    Runs of voxels are joined where they touch in a slice and across slices; one scan per task, no voxel on its own.
    """

    def run(table: pa.Table) -> pa.Table:
        at, shape = grid.places(table)
        active = np.zeros(shape, dtype=bool)
        active[at] = True
        found = pa.array(grid.label(active)[at], pa.int32())
        return pa.table([table.column("uid"), *[table.column(c) for c in POS], found], names=["uid", *POS, "component"])

    uid_type = active.schema["uid"].dataType.simpleString()
    cols = active.select("uid", *[F.col(c).cast("int").alias(c) for c in POS])
    return cols.groupBy("uid").applyInArrow(run, f"uid {uid_type}, z int, y_ int, x int, component int")


def connected_components(voxels: DataFrame, active: Column) -> DataFrame:
    """Number of components and share of the largest one per scan (0 when nothing is active)."""
    parts = label_components(voxels.where(active)).groupBy("uid", "component").agg(F.count(F.lit(1)).alias("c"))
    g = parts.groupBy("uid").agg(F.count(F.lit(1)).alias("components"), (F.max("c") / F.sum("c")).alias("largest_fraction"))
    return voxels.select("uid").distinct().join(g, "uid", "left").na.fill(0, ["components"]).na.fill(0.0, ["largest_fraction"])


def mip(voxels: DataFrame, axis: str, where: Column | None = None) -> DataFrame:
    """Maximum projection along an axis."""
    keep = [c for c in POS if c != axis]
    kept = voxels.where(where) if where is not None else voxels
    return kept.groupBy("uid", *keep).agg(F.max("v").alias("v"))


def mip_summary(voxels: DataFrame, axis: str, bins: int = 32, where: Column | None = None) -> DataFrame:
    """Mean, population SD and entropy of the projection."""
    p = by_scan(mip(voxels, axis, where))
    s = p.groupBy("uid").agg(F.avg("v").alias("mean"), F.stddev_pop("v").alias("std"))
    return s.join(scan_entropy(p, bins), "uid")


# --- morphology ------------------------------------------------------------------------------------------------------


def l1_distance(voxels: DataFrame, mask: Column, out: str) -> DataFrame:
    """City-block distance to the nearest masked voxel of the scan: three axes of running minima, no neighbour join."""
    far = 1 << 20
    df = by_scan(voxels).withColumn(out, F.when(mask, F.lit(0)).otherwise(F.lit(far)))
    for axis in POS:
        c, w = F.col(axis), line(axis)
        ahead = F.min(F.col(out) - c).over(w.rowsBetween(Window.unboundedPreceding, 0)) + c
        behind = F.min(F.col(out) + c).over(w.rowsBetween(0, Window.unboundedFollowing)) - c
        df = df.withColumn(out, F.least(ahead, behind))
    return df


def dilate(voxels: DataFrame, mask: str, out: str, steps: int = 1) -> DataFrame:
    return l1_distance(voxels, F.col(mask), "_d").withColumn(out, F.col("_d") <= steps).drop("_d")


def erode(voxels: DataFrame, mask: str, out: str, steps: int = 1) -> DataFrame:
    """Erosion with the outside of the grid counted as background."""
    df = l1_distance(voxels, ~F.col(mask), "_d")
    df = with_shape(df.drop("nz", "ny", "nx"))
    border = F.least(*[F.least(F.col(c) + 1, F.col(n) - F.col(c)) for c, n in zip(POS, ("nz", "ny", "nx"))])
    return df.withColumn(out, F.least(F.col("_d"), border) > steps).drop("_d", "nz", "ny", "nx")


def closing(voxels: DataFrame, mask: str, out: str, steps: int = 1) -> DataFrame:
    return erode(dilate(voxels, mask, "_wide", steps), "_wide", out, steps).drop("_wide")


# --- regions ---------------------------------------------------------------------------------------------------------


def core_cut(voxels: DataFrame) -> DataFrame:
    """(uid, z, y_, x, core): mask voxels whose Euclidean distance to the background reaches its 60th percentile.

    The distance is separable: squared distances are minimised axis by axis with NumPy inside the task of a scan.
    """

    def core(at: list[np.ndarray], inside: np.ndarray) -> np.ndarray:
        squares = np.zeros([int(a.max()) + 1 for a in at])
        squares[tuple(at)] = np.where(inside, np.inf, 0.0)
        for axis in range(3):
            size = squares.shape[axis]
            lines = np.moveaxis(squares, axis, 0)
            gap = (np.arange(size)[:, None] - np.arange(size)[None, :]) ** 2
            lines[...] = np.stack([(lines + gap[i].reshape(-1, 1, 1)).min(axis=0) for i in range(size)])
        d = np.sqrt(squares[tuple(at)])
        edge = np.percentile(d[inside], 60) if inside.any() else np.inf
        return inside & (d >= edge)

    def cores(table: pa.Table) -> Iterator[pa.Table]:
        scan, _ = grid.codes(table.column("uid"))
        mask = np.asarray(table.column("m").fill_null(False)).astype(bool)
        where = [np.asarray(table.column(c)).astype(np.int64) for c in POS]
        out = np.zeros(table.num_rows, dtype=bool)
        for at in grid.stacks([scan], [*where, mask]):
            out[at] = core([w[at[0]] for w in where], mask[at[0]])
        yield table.select(["uid", *POS]).append_column("core", pa.array(out))

    uid_type = voxels.schema["uid"].dataType.simpleString()
    cols = voxels.select("uid", *[F.col(c).cast("int").alias(c) for c in POS], "m")
    return by_steps(cols, cores, f"uid {uid_type}, z int, y_ int, x int, core boolean")


def _half(size: str) -> Column:
    return (F.col(size) - F.lit(1.0)) / F.lit(2.0)


def region_masks(voxels: DataFrame, core: bool = True) -> DataFrame:
    """Mask voxels once per region they belong to: (voxel columns, region). Low x is right, low y is anterior."""
    df = with_shape(by_scan(voxels))
    if core:
        df = df.join(core_cut(voxels).where("core"), ["uid", *POS], "left")
    right, anterior = F.col("x") < _half("nx"), F.col("y_") < _half("ny")
    side, depth = F.when(right, "right").otherwise("left"), F.when(anterior, "caudate").otherwise("putamen")
    names = [
        F.lit("target"), side, F.when(anterior, "anterior").otherwise("posterior"), F.concat_ws("_", side, depth),
        *([F.when(F.col("core"), "target_core")] if core else []),
    ]
    return df.where("m").select(*voxels.columns, F.explode(F.array_compact(F.array(*names))).alias("region"))


def proxy_regions(voxels: DataFrame) -> DataFrame:
    """Mask voxels with one of six proxy regions: side x caudate / anterior putamen / posterior putamen."""
    df = with_shape(by_scan(voxels))
    side = F.when(F.col("x") < _half("nx"), "right").otherwise("left")
    part = (
        F.when(F.col("y_") < _half("ny"), "caudate")
        .when(F.col("y_") < _half("ny") + F.col("ny") / F.lit(4.0), "putamen_anterior")
        .otherwise("putamen_posterior")
    )
    return df.where("m").select(*voxels.columns, "nz", "ny", "nx", F.concat_ws("_", side, part).alias("region"))


def in_central_box() -> Column:
    """Inner 60 % of every axis; needs the shape columns."""
    cond = F.lit(True)
    for c, n in zip(POS, ("nz", "ny", "nx")):
        cond = cond & (F.col(c) >= F.floor(F.col(n) * F.lit(0.2))) & (F.col(c) < F.floor(F.col(n) * F.lit(0.8)))
    return cond


def in_central_ellipsoid() -> Column:
    total = F.lit(0.0)
    for c, n in zip(POS, ("nz", "ny", "nx")):
        radius = F.greatest(F.col(n) * F.lit(0.42), F.lit(1.0))
        d = (F.col(c) - _half(n)) / radius
        total = total + d * d
    return total <= 1


def self_normalize(voxels: DataFrame, out: str = "s") -> DataFrame:
    """sqrt(d) x / norm over positive mask voxels, 0 elsewhere; all 0 when the norm vanishes."""
    pos = F.when(F.col("m") & (F.col("v") > 0), F.col("v"))
    df = by_scan(voxels).select("*", pos.alias("_p"))
    df = df.select("*", F.sqrt(F.sum(F.col("_p") * F.col("_p")).over(whole())).alias("_norm"), F.count("_p").over(whole()).alias("_d"))
    value = F.sqrt("_d") * F.col("_p") / F.when(F.col("_norm") > 1e-8, F.col("_norm"))
    return df.select(*voxels.columns, F.coalesce(value, F.lit(0.0)).alias(out))


def channels(voxels: DataFrame) -> DataFrame:
    """Three channels per voxel: selfnorm, robust (median and IQR of the mask), rank; long form (channel, c)."""
    df = self_normalize(voxels, "s")
    inside = F.when(F.col("m"), F.col("s"))
    df = df.select("*", F.percentile(inside, F.array(*[F.lit(p) for p in (0.25, 0.5, 0.75)])).over(whole()).alias("_q"))
    scale = F.greatest(F.col("_q")[2] - F.col("_q")[0], F.lit(1e-6))
    part, ties = Window.partitionBy("uid", "m"), Window.partitionBy("uid", "m", "s")
    rank = F.rank().over(part.orderBy("s")) + (F.count(F.lit(1)).over(ties) - 1) / F.lit(2.0)
    zero = F.lit(0.0)
    df = df.select(
        *voxels.columns,
        "s",
        F.when(F.col("m"), (F.col("s") - F.col("_q")[1]) / scale).otherwise(zero).alias("robust"),
        F.when(F.col("m"), rank / F.count(F.lit(1)).over(part)).otherwise(zero).alias("rank"),
    )
    items = F.array(*[F.struct(F.lit(n).alias("channel"), F.col(c).alias("c")) for n, c in (("selfnorm", "s"), ("robust", "robust"), ("rank", "rank"))])
    return df.select(*voxels.columns, F.explode(items).alias("e")).select(*voxels.columns, "e.channel", "e.c")


def summary_stats(df: DataFrame, keys: Sequence[str], value: str) -> DataFrame:
    """Fifteen intensity summaries per group (mean, SD, min, max, nine percentiles, MAD, energy)."""
    w = Window.partitionBy(*keys)
    base = df.withColumn("_med", F.percentile(F.col(value), F.lit(0.5)).over(w))
    v = F.col(value)
    ps = F.percentile(v, F.array(*[F.lit(p / 100.0) for p in SUMMARY_PERCENTILES]))
    g = base.groupBy(*keys).agg(
        F.avg(v).alias("mean"), F.stddev_pop(v).alias("std"), F.min(v).alias("min"), F.max(v).alias("max"), ps.alias("_p"),
        F.percentile(F.abs(v - F.col("_med")), F.lit(0.5)).alias("mad"), F.avg(v * v).alias("energy"), F.count(v).alias("n"),
    )
    return g.select(*keys, "n", "mean", "std", "min", "max", *[F.col("_p")[i].alias(f"p{p:02d}") for i, p in enumerate(SUMMARY_PERCENTILES)], "mad", "energy")


def _cells(regions: DataFrame) -> DataFrame:
    return regions.select("uid", *[F.col(c).cast("int").alias(c) for c in POS], "region", F.col("s").cast("double").alias("s"))


def by_steps(rows: DataFrame, fn: Callable[[pa.Table], Iterator[pa.Table]], schema: str) -> DataFrame:
    """Apply ``fn`` to tables of whole scans; many small scans share a table."""

    def run(batches):
        for table in grid.steps(batches):
            for found in fn(table):
                yield from found.to_batches()

    return by_scan(rows).sortWithinPartitions("uid").mapInArrow(run, schema)


def _regions(table: pa.Table) -> Iterator[tuple]:
    """Stacks of scans with the same regions: row numbers (scans x cells), names, number of the region, position and place of
    each cell."""
    scan, _ = grid.codes(table.column("uid"))
    region, names = grid.codes(table.column("region"))
    where = [np.asarray(table.column(c)).astype(np.int64) for c in POS]
    for at in grid.stacks([scan], [region, *where]):
        cell = [w[at[0]] - w[at[0]].min() for w in where]
        yield at, names, region[at[0]], cell, np.ravel_multi_index(cell, [int(c.max()) + 1 for c in cell])


def _stack_rows(table: pa.Table, at: np.ndarray, fixed: dict, columns: dict) -> pa.Table:
    """One row per scan of a stack: uid, values that all share, a column for each of ``columns``."""
    same = {k: pa.array([v] * len(at), pa.string() if isinstance(v, str) else pa.int32() if k in ("p", "levels") else pa.int64()) for k, v in fixed.items()}
    return pa.table({"uid": table.column("uid").take(at[:, 0]), **same, **columns})


def region_stats(voxels: DataFrame, core: bool = True, regions: DataFrame | None = None) -> DataFrame:
    """Fifteen summaries x region x channel, long form (uid, region, channel, stats); ``regions``: region rows with
    self-normalised values ``s``, if they are at hand. A scan is laid out once for all of its regions and channels."""
    rows = region_masks(self_normalize(voxels), core) if regions is None else regions

    stats = ["mean", "std", "min", "max", *[f"p{p:02d}" for p in SUMMARY_PERCENTILES], "mad", "energy"]

    def summaries(table: pa.Table) -> Iterator[pa.Table]:
        for at, names, region, _, place in _regions(table):
            s, target = np.asarray(table.column("s"))[at], region == names.index("target")
            values = s[:, target]
            low, middle, high = np.percentile(values, [25, 50, 75], axis=1)[:, :, None]
            parts = {"selfnorm": values, "robust": (values - middle) / np.maximum(high - low, 1e-6), "rank": grid.mean_ranks(values) / values.shape[1]}
            for i in np.unique(region):
                own = np.searchsorted(place[target], place[region == i])
                for channel, whole_scan in parts.items():
                    x = np.ascontiguousarray(whole_scan[:, own])
                    p = np.percentile(x, SUMMARY_PERCENTILES, axis=1)
                    mad = np.median(np.abs(x - np.median(x, axis=1)[:, None]), axis=1)
                    n = x.shape[1]
                    found = [x.mean(axis=1), x.std(axis=1), x.min(axis=1), x.max(axis=1), *p, mad, np.cumsum(np.sort(x * x, axis=1), axis=1)[:, -1] / n]
                    fixed = {"region": names[i], "channel": channel, "n": n}
                    yield _stack_rows(table, at, fixed, dict(zip(stats, found, strict=True)))

    kinds = f"uid {rows.schema['uid'].dataType.simpleString()}, region string, channel string, n bigint, " + ", ".join(f"{c} double" for c in stats)
    return by_steps(_cells(rows), summaries, kinds)


def region_means(regions: DataFrame, value: str, names: Sequence[str]) -> DataFrame:
    """One row per scan with the mean of each region (0 for an empty one)."""
    picks = [F.coalesce(F.avg(F.when(F.col("region") == n, F.col(value))), F.lit(0.0)).alias(n) for n in names]
    return regions.groupBy("uid").agg(*picks)


def region_relations(voxels: DataFrame, core: bool = True, regions: DataFrame | None = None) -> DataFrame:
    """Ten region pairs x difference, absolute difference, ratio, asymmetry on the self-normalised volume."""
    names = ["target", "right", "left", "anterior", "posterior", *QUADRANTS] + (["target_core"] if core else [])
    r = region_means(region_masks(self_normalize(voxels), core) if regions is None else regions, "s", names)
    c = F.col
    lc, rc, lp, rp = c("left_caudate"), c("right_caudate"), c("left_putamen"), c("right_putamen")
    pairs = {
        "caudate_lr": (lc, rc), "putamen_lr": (lp, rp), "right_cp": (rc, rp), "left_cp": (lc, lp),
        "hemisphere_lr": (c("left"), c("right")), "anterior_posterior": (c("anterior"), c("posterior")),
        "minmax_putamen": (F.least(lp, rp), F.greatest(lp, rp)), "minmax_caudate": (F.least(lc, rc), F.greatest(lc, rc)),
        "weak_caudate_putamen": (F.least(lc, rc), F.least(lp, rp)),
    }
    if core:
        pairs["core_target"] = (c("target_core"), c("target"))
    items = F.array(*[F.struct(F.lit(n).alias("pair"), a.alias("a"), b.alias("b")) for n, (a, b) in pairs.items()])
    long = r.select("uid", F.explode(items).alias("e")).select("uid", "e.*")
    a, b = c("a"), c("b")
    return long.select(
        "uid", "pair", (a - b).alias("difference"), F.abs(a - b).alias("absolute_difference"),
        (a / F.greatest(F.abs(b), F.lit(1e-8))).alias("ratio"),
        ((a - b) / F.greatest(F.abs(a) + F.abs(b), F.lit(1e-8))).alias("asymmetry"),
    )


def threshold_morphology(voxels: DataFrame, percentiles: Sequence[int] = THRESHOLD_PERCENTILES, core: bool = True,
                         regions: DataFrame | None = None) -> DataFrame:
    """Active share, count, components, share of the largest one, surface share, extents and centroid distance per region
    and threshold of the mask values. ``regions``: region rows with self-normalised values ``s``, if they are at hand. One
    component tree per scan and region serves all thresholds; scans with the same regions are laid out as one stack."""
    percentiles = sorted(percentiles)
    r = region_masks(self_normalize(voxels), core) if regions is None else regions

    def shapes(table: pa.Table) -> Iterator[pa.Table]:
        for at, names, region, cell, _ in _regions(table):
            s = np.asarray(table.column("s"))[at]
            cuts = grid.quantiles(s[:, region == names.index("target")], [p / 100.0 for p in percentiles])
            for i in np.unique(region):
                own = region == i
                where = [c[own] - c[own].min() for c in cell]
                level = (s[:, own, None] >= cuts[:, None, :]).sum(axis=2)
                volume = np.zeros((len(at), *[int(w.max()) + 3 for w in where]), dtype=np.int64)
                inner = volume[:, 1:-1, 1:-1, 1:-1]
                inner[:, *where] = level
                trees = grid.component_trees(inner, len(percentiles))
                for k, (p, (components, largest, active)) in enumerate(zip(percentiles, trees, strict=True), 1):
                    on, dense = level >= k, volume >= k
                    around = sum(np.roll(dense, step, axis).astype(np.int8) for axis in (1, 2, 3) for step in (1, -1))
                    inside = (dense & (around == 6)).sum(axis=(1, 2, 3))
                    some, found, gap = active > 0, {}, 0.0
                    for c, w in zip(POS, where, strict=True):
                        extent = np.where(on, w, -1).max(axis=1) - np.where(on, w, w.max() + 1).min(axis=1) + 1
                        found[f"extent_{c}"] = np.where(some, extent, 0)
                        shift = (on * w).sum(axis=1) / np.maximum(active, 1) - w.mean()
                        gap = gap + shift * shift
                    yield _stack_rows(table, at, {"region": names[i], "p": p}, {
                        "fraction": active / own.sum(), "voxels": active, **found, "centroid_distance": np.where(some, np.sqrt(gap), 0.0),
                        "components": components, "largest_fraction": largest / np.maximum(active, 1), "surface_fraction": (active - inside) / own.sum(),
                    })

    extents = ", ".join(f"extent_{c} bigint" for c in POS)
    kinds = f"uid {r.schema['uid'].dataType.simpleString()}, region string, p int, fraction double, voxels bigint, {extents}, centroid_distance double"
    return by_steps(_cells(r), shapes, kinds + ", components bigint, largest_fraction double, surface_fraction double")


# --- texture and shape -----------------------------------------------------------------------------------------------


TEXTURE_METRICS = ("contrast", "dissimilarity", "homogeneity", "energy", "entropy", "correlation")


def glcm(voxels: DataFrame, levels: int | Sequence[int] = 32, offsets: Sequence[tuple[int, int, int]] = OFFSETS_13, rounding: str = "rint",
         min_n: int = 30, keys: Sequence[str] = (), eps: float = 1e-8, empty: float | None = None) -> DataFrame:
    """Six texture metrics of the symmetric co-occurrence matrix of the mask voxels per scan and ``keys`` (one matrix each, with
    grey levels of its own); ``empty`` below ``min_n`` voxels, for a constant group and where no two voxels meet.

    Groups with the same voxels are laid out once and counted together. Several numbers of levels give a column
    ``levels`` and one row for each.
    """
    several = [levels] if isinstance(levels, int) else list(levels)
    groups = ["uid", *keys]

    def metrics(table: pa.Table) -> Iterator[pa.Table]:
        known = [grid.codes(table.column(k))[0] for k in groups]
        where = [np.asarray(table.column(c)).astype(np.int64) for c in POS]
        valid = np.asarray(pa.compute.is_valid(table.column("v"))).astype(bool)
        values = np.asarray(table.column("v"))
        for at in grid.stacks(known, [valid, *where]):
            use = valid[at[0]]
            v, cell = values[at[:, use]], [w[at[0, use]] for w in where]
            fit = v.max(axis=1) > v.min(axis=1) if use.sum() >= max(min_n, 1) else np.zeros(len(at), dtype=bool)
            pairs = grid.pairs(cell, offsets) if fit.any() else ()
            for n in several:
                found = np.full((len(at), 6), np.nan)
                if fit.any() and len(pairs[0]):
                    for some in np.array_split(np.flatnonzero(fit), max(1, int(fit.sum()) * n * n // grid.STEP_ROWS)):
                        found[some] = grid.textures(grid.pair_counts(grid.grey_rows(v[some], n, rounding, eps), n, pairs))
                nothing = np.isnan(found).all(axis=1)
                columns = [pa.array(np.where(nothing, 0.0, f), pa.float64(), mask=nothing) for f in found.T]
                columns = [c.fill_null(empty) if empty is not None else c for c in columns]
                yield pa.table([*[table.column(k).take(at[:, 0]) for k in groups], pa.array([n] * len(at), pa.int32()), *columns], names=[*groups, "levels", *TEXTURE_METRICS])

    kinds = ", ".join(f"{k} {voxels.schema[k].dataType.simpleString()}" for k in groups)
    named = ", ".join(f"{m} double" for m in TEXTURE_METRICS)
    cells = voxels.where("m").select(*groups, *[F.col(c).cast("int").alias(c) for c in POS], F.col("v").cast("double").alias("v"))
    found = by_steps(cells, metrics, f"{kinds}, levels int, {named}")
    return found.drop("levels") if isinstance(levels, int) else found


def eigen_extremes(xx: Column, yy: Column, zz: Column, xy: Column, xz: Column, yz: Column) -> tuple[Column, Column]:
    """Largest and smallest eigenvalue of a symmetric 3 x 3 matrix by the trigonometric formula."""
    q = (xx + yy + zz) / F.lit(3.0)
    off = xy * xy + xz * xz + yz * yz
    p2 = (xx - q) * (xx - q) + (yy - q) * (yy - q) + (zz - q) * (zz - q) + F.lit(2.0) * off
    p = F.sqrt(p2 / F.lit(6.0))
    a, b, c = xx - q, yy - q, zz - q
    det = a * (b * c - yz * yz) - xy * (xy * c - yz * xz) + xz * (xy * yz - b * xz)
    r = clip(F.coalesce(det / (F.lit(2.0) * F.when(p > 0, p * p * p)), F.lit(0.0)), -1.0, 1.0)
    phi = F.acos(r) / F.lit(3.0)
    return q + F.lit(2.0) * p * F.cos(phi), q + F.lit(2.0) * p * F.cos(phi + F.lit(2.0 * np.pi / 3.0))


def shape_features(mask: DataFrame, spacing: tuple[float, float, float], min_n: int = 8) -> DataFrame:
    """Volume, face-count surface, sphericity, bounding-box extent and elongation of the listed voxels (NULL below ``min_n``)."""
    sz, sy, sx = spacing
    df = by_scan(mask)
    faces = []
    for axis, area in zip(POS, (sy * sx, sz * sx, sz * sy)):
        w = line(axis)
        inner = F.coalesce((F.lag(axis).over(w) == F.col(axis) - 1).cast("int"), F.lit(0))
        faces.append((F.lit(2.0) - F.lit(2.0) * inner) * F.lit(area))
    df = df.select("uid", *POS, sum(faces, F.lit(0.0)).alias("_faces"))
    zc, yc, xc = (F.col(c) * F.lit(h) for c, h in zip(POS, spacing))
    span = lambda c: F.max(c) - F.min(c) + 1
    vox = sz * sy * sx
    g = df.groupBy("uid").agg(
        F.count(F.lit(1)).alias("n"),
        (F.count(F.lit(1)) * F.lit(vox)).alias("volume_mm3"),
        F.sum("_faces").alias("surface_mm2"),
        (F.count(F.lit(1)) / (span("z") * span("y_") * span("x"))).alias("extent"),
        F.covar_samp(zc, zc).alias("zz"), F.covar_samp(yc, yc).alias("yy"), F.covar_samp(xc, xc).alias("xx"),
        F.covar_samp(zc, yc).alias("zy"), F.covar_samp(zc, xc).alias("zx"), F.covar_samp(yc, xc).alias("yx"),
    )
    c = F.col
    big, small = eigen_extremes(c("zz"), c("yy"), c("xx"), c("zy"), c("zx"), c("yx"))
    tiny = F.lit(1e-8)
    elongation = F.sqrt(F.greatest(big, tiny) / F.greatest(small, tiny))
    # Surface of the ball of equal volume over the own surface.
    ball = F.lit(np.pi ** (1 / 3)) * F.pow(F.lit(6.0) * c("volume_mm3"), F.lit(2.0 / 3.0))
    g = g.withColumn("sphericity", ball / c("surface_mm2"))
    ok = c("n") >= min_n
    names = ("volume_mm3", "surface_mm2", "sphericity", "extent")
    return g.select("uid", "n", *[F.when(ok, c(x)).alias(x) for x in names], F.when(ok, elongation).alias("elongation"))


# --- orientation, slabs, regions of interest ---------------------------------------------------------------------------


def canonical_flip(voxels: DataFrame) -> DataFrame:
    """Mirror x so that the weaker putamen is on the right (low x): new ``x``, ``flipped``, ``affected``."""
    df = with_shape(by_scan(voxels))
    inside = F.col("m") & (F.col("y_") >= _half("ny"))
    right = F.coalesce(F.avg(F.when(inside & (F.col("x") < _half("nx")), F.col("v"))).over(whole()), F.lit(0.0))
    left = F.coalesce(F.avg(F.when(inside & (F.col("x") >= _half("nx")), F.col("v"))).over(whole()), F.lit(0.0))
    df = df.select("*", (right > left).alias("flipped"))
    x = F.when(F.col("flipped"), F.col("nx") - 1 - F.col("x")).otherwise(F.col("x"))
    return df.select(
        *[x.alias("x") if c == "x" else F.col(c) for c in voxels.columns], "flipped",
        F.when(F.col("flipped"), "left").otherwise("right").alias("affected"),
    )


def gaussian_kernel(sigma: float = 1.0, truncate: float = 4.0) -> list[tuple[int, float]]:
    radius = int(truncate * sigma + 0.5)
    w = np.exp(-0.5 * (np.arange(-radius, radius + 1) / sigma) ** 2)
    return [(int(k), float(v)) for k, v in zip(range(-radius, radius + 1), w / w.sum())]


def slab_center(voxels: DataFrame) -> DataFrame:
    """(uid, nz, center): first peak of the Gaussian-smoothed (reflecting) number of mask voxels per slice."""
    profile = voxels.groupBy("uid", "z").agg(F.sum(F.col("m").cast("int")).alias("c"))
    profile = by_scan(profile).withColumn("nz", F.max("z").over(whole()) + 1)
    steps = F.array(*[F.struct(F.lit(k).alias("k"), F.lit(w).alias("w")) for k, w in gaussian_kernel()])
    spread = profile.select("uid", "z", "nz", F.explode(steps).alias("e"))
    r = F.pmod(F.col("z") + F.col("e.k"), F.col("nz") * 2)
    source = F.when(r >= F.col("nz"), F.col("nz") * 2 - 1 - r).otherwise(r)
    spread = spread.select("uid", "z", "nz", F.col("e.w").alias("w"), source.alias("_s"))
    j = spread.join(profile.select("uid", F.col("z").alias("_s"), "c"), ["uid", "_s"])
    smooth = j.groupBy("uid", "z", "nz").agg(F.round(F.sum(F.col("w") * F.col("c")), 9).alias("p"))
    return smooth.groupBy("uid").agg(F.max("nz").alias("nz"), F.min(F.struct(-F.col("p"), F.col("z")))["z"].alias("center"))


def axial_slab(voxels: DataFrame, slices: int) -> DataFrame:
    """Mean of ``slices`` slices around the profile peak (indices clipped to the grid)."""
    c = slab_center(voxels)
    picks = F.explode(F.sequence(F.lit(0), F.lit(slices - 1)))
    want = c.select("uid", "nz", "center", picks.alias("_i"))
    z = F.greatest(F.least(F.col("center") - slices // 2 + F.col("_i"), F.col("nz") - 1), F.lit(0))
    want = want.select("uid", z.alias("z")).groupBy("uid", "z").agg(F.count(F.lit(1)).alias("k"))
    j = voxels.join(want, ["uid", "z"])
    return j.groupBy("uid", "y_", "x").agg((F.sum(F.col("v") * F.col("k")) / F.sum("k")).alias("v"))


def physical_roi(voxels: DataFrame, spacing: float, radii: tuple[float, float, float], hot: float = 85.0, max_shift: float = 10.0) -> DataFrame:
    """``roi``: ellipsoid recentred (within ``max_shift`` mm) on the centroid of the hottest voxels of the central one."""
    df = with_shape(by_scan(voxels))
    r = [x / spacing for x in radii]

    def inside(centers: Sequence[Column]) -> Column:
        total = F.lit(0.0)
        for c, m, rad in zip(POS, centers, r):
            d = (F.col(c) - m) / F.lit(rad)
            total = total + d * d
        return total <= 1

    middle = [_half(n) for n in ("nz", "ny", "nx")]
    df = df.select("*", (inside(middle) & (F.col("v") > 0)).alias("_in"))
    df = df.select("*", pct(F.when(F.col("_in"), F.col("v")), hot).over(whole()).alias("_cut"))
    w = F.when(F.col("_in") & (F.col("v") >= F.col("_cut")), F.col("v"))
    df = df.select("*", w.alias("_w"))
    shift = max_shift / spacing
    moved = []
    for c, m in zip(POS, middle):
        center = F.sum(F.col("_w") * F.col(c)).over(whole()) / F.sum("_w").over(whole())
        delta = F.greatest(F.least(center - m, F.lit(shift)), F.lit(-shift))
        moved.append(F.coalesce(m + delta, m).alias(f"_c{c}"))
    df = df.select("*", *moved)
    return df.select(*voxels.columns, inside([F.col(f"_c{c}") for c in POS]).alias("roi"))


def triplanar(voxels: DataFrame, slices: int) -> DataFrame:
    """The central slices of every axis: (uid, plane, slice, row, col, v)."""
    df = with_shape(by_scan(voxels))
    half = slices // 2
    offsets = list(range(-half, half + 1))[:slices]
    planes = {"axial": ("z", "nz", "y_", "x"), "coronal": ("y_", "ny", "z", "x"), "sagittal": ("x", "nx", "z", "y_")}
    items = []
    for name, (axis, size, row, col) in planes.items():
        for k, off in enumerate(offsets):
            index = F.greatest(F.least(F.floor(F.col(size) / 2) + off, F.col(size) - 1), F.lit(0))
            items.append(
                F.when(
                    F.col(axis) == index,
                    F.struct(F.lit(name).alias("plane"), F.lit(k).alias("slice"), F.col(row).alias("row"), F.col(col).alias("col")),
                )
            )
    return df.select("uid", "v", F.explode(F.array_compact(F.array(*items))).alias("e")).select("uid", "e.*", "v")


def downsample(voxels: DataFrame, max_side: int) -> DataFrame:
    """Every k-th voxel per axis with k = ceil(size / max_side); coordinates are renumbered."""
    df = with_shape(by_scan(voxels))
    step = {c: F.greatest(F.lit(1), F.ceil(F.col(n) / max_side)).cast("int") for c, n in zip(POS, ("nz", "ny", "nx"))}
    keep = reduce(lambda a, b: a & b, [F.col(c) % step[c] == 0 for c in POS])
    return df.where(keep).select(*[(F.col(c) / step[c]).cast("int").alias(c) if c in POS else F.col(c) for c in voxels.columns])


def crop_box(voxels: DataFrame, margin_mm: float, spacing: tuple[float, float, float]) -> DataFrame:
    """Voxels inside the bounding box of the mask plus a physical margin, with the box start."""
    df = with_shape(by_scan(voxels))
    cond, starts = F.lit(True), []
    for c, n, h in zip(POS, ("nz", "ny", "nx"), spacing):
        margin = int(np.ceil(margin_mm / h))
        lo = F.greatest(F.min(F.when(F.col("m"), F.col(c))).over(whole()) - margin, F.lit(0))
        hi = F.least(F.max(F.when(F.col("m"), F.col(c))).over(whole()) + margin + 1, F.col(n))
        df = df.withColumn(f"start_{c}", lo).withColumn(f"_stop_{c}", hi)
        cond = cond & (F.col(c) >= F.col(f"start_{c}")) & (F.col(c) < F.col(f"_stop_{c}"))
        starts.append(f"start_{c}")
    return df.where(cond).select(*voxels.columns, *starts)


def resample_grid(voxels: DataFrame, shape: tuple[int, int, int], spacing: tuple[float, float, float], out_spacing: float, order: int = 1) -> DataFrame:
    """Physical centred grid of ``shape`` at ``out_spacing`` mm: trilinear (``order`` 1) or nearest (0), 0 outside.

    Every source voxel sends its weight to the target voxels it touches; the targets of one axis are a fixed list, so
    the job is an explode and one aggregation, without a join.
    """
    df = with_shape(by_scan(voxels))
    hits = []
    for c, n, size, h in zip(POS, ("nz", "ny", "nx"), shape, spacing):
        center = _half(n)
        steps = F.sequence(F.lit(0), F.lit(size - 1))
        where = lambda t, center=center, size=size, h=h: center + (t - F.lit((size - 1) / 2.0)) * F.lit(out_spacing / h)
        if order == 1:
            weight = lambda t, c=c, where=where: F.greatest(F.lit(1.0) - F.abs(where(t) - F.col(c)), F.lit(0.0))
        else:
            weight = lambda t, c=c, where=where: (F.floor(where(t) + 0.5) == F.col(c)).cast("double")
        # a target outside the source grid takes the constant 0, as a whole
        inside = lambda t, n=n, where=where: (where(t) >= 0) & (where(t) <= F.col(n) - 1)
        pairs = F.filter(
            F.transform(steps, lambda t: F.struct(t.alias("t"), F.when(inside(t), weight(t)).otherwise(F.lit(0.0)).alias("w"))),
            lambda e: e["w"] > 0,
        )
        hits.append(pairs.alias(f"_h{c}"))
    long = df.select("uid", "v", *hits)
    for c in POS:
        long = long.withColumn(f"_e{c}", F.explode(f"_h{c}")).drop(f"_h{c}")
    w = F.col("_ez.w") * F.col("_ey_.w") * F.col("_ex.w")
    touched = long.groupBy("uid", F.col("_ez.t").alias("z"), F.col("_ey_.t").alias("y_"), F.col("_ex.t").alias("x")).agg(
        F.sum(w * F.col("v")).alias("v")
    )
    grid = voxels.select("uid").distinct().select(
        "uid", F.explode(F.sequence(F.lit(0), F.lit(shape[0] * shape[1] * shape[2] - 1))).alias("_i")
    )
    plane = shape[1] * shape[2]
    grid = grid.select(
        "uid", F.floor(F.col("_i") / plane).cast("int").alias("z"), (F.floor(F.col("_i") / shape[2]) % shape[1]).cast("int").alias("y_"),
        (F.col("_i") % shape[2]).cast("int").alias("x"),
    )
    return grid.join(touched, ["uid", *POS], "left").select("uid", *POS, F.coalesce("v", F.lit(0.0)).alias("v"))
