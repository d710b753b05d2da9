"""Background, uptake, templates, alignment and per-scan feature rows built on the voxel operators."""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from cohortloom.functions.scalar import safe_ratio
from cohortloom.operators import voxel as vx
from cohortloom.operators.joins import require
from cohortloom.operators.order import null_safe, wide_quantiles
from cohortloom.session import cut
from cohortloom.operators.voxel import POS, PROXIES, by_scan, pct, whole, with_shape


def nonzero(c: Column) -> Column:
    return F.when(c != 0, c)


# --- background and uptake -------------------------------------------------------------------------------------------


def background_stats(voxels: DataFrame, min_voxels: int = vx.MIN_BACKGROUND_VOXELS, min_support: float = vx.MIN_BACKGROUND_SUPPORT,
                     floor: float = vx.SCALE_FLOOR, exclusion: int = 5, min_trim: int = 10) -> DataFrame:
    """Robust background per scan from masks ``m`` (target), ``brain``, ``background``, with its fallback chain.

    Each level is a window over the scan, so the whole chain costs one shuffle.
    """
    df = with_shape(by_scan(vx.dilate(voxels, "m", "_near", exclusion)))
    v, pos = F.col("v"), F.col("v") > 0
    n = lambda cond: F.sum(cond.cast("int")).over(whole())
    df = df.select("*", (F.col("brain") & pos).alias("_f1"), (vx.in_central_ellipsoid() & pos).alias("_f2"), pos.alias("_f3"))
    df = df.select("*", n(F.col("_f1")).alias("_n1"), n(F.col("_f2")).alias("_n2"))
    fore = F.when(F.col("_n1") >= min_voxels, F.col("_f1")).when(F.col("_n2") >= min_voxels, F.col("_f2")).otherwise(F.col("_f3"))
    df = df.select("*", fore.alias("_fore"), (F.col("background") & pos).alias("_nominal"))
    fv = F.when(F.col("_fore"), v)
    df = df.select(
        "*", F.percentile(fv, F.array(*[F.lit(p) for p in (0.5, 0.9, 0.99)])).over(whole()).alias("_fp"), n(F.col("_nominal")).alias("_nn"),
        n(F.col("background")).alias("_nb"), (F.col("_fore") & ~F.col("_near")).alias("_far"),
    )
    df = df.select("*", pct(F.when(F.col("_far"), v), 70).over(whole()).alias("_far70"))
    support = F.col("_nn") / F.greatest(F.col("_nb"), F.lit(1))
    enough = (F.col("_nn") >= min_voxels) & (support >= min_support)
    second = F.col("_far") & (v <= F.col("_far70"))
    df = df.select("*", enough.alias("_enough"), support.alias("_support"), F.when(enough, F.col("_nominal")).otherwise(second).alias("_cand"))
    df = df.select("*", n(F.col("_cand") & pos).alias("_nc"))
    lower = F.col("_fore") & (v <= F.col("_fp")[0])
    use = F.when(F.col("_nc") >= min_voxels, F.col("_cand") & pos).otherwise(lower)
    source = (
        F.when(F.col("_nc") < min_voxels, "foreground_lower_half_fallback")
        .when(F.col("_enough"), "consensus_brain_background")
        .otherwise("scan_brain_fallback")
    )
    df = df.select("*", use.alias("_use"), source.alias("_source"))
    uv = F.when(F.col("_use"), v)
    df = df.select("*", F.percentile(uv, F.array(F.lit(0.05), F.lit(0.95))).over(whole()).alias("_t"))
    df = df.select("*", (F.col("_use") & (v >= F.col("_t")[0]) & (v <= F.col("_t")[1])).alias("_trim"))
    df = df.select("*", n(F.col("_trim")).alias("_nt"))
    kept = F.when(F.when(F.col("_nt") >= min_trim, F.col("_trim")).otherwise(F.col("_use")), v)
    g = df.groupBy("uid").agg(
        F.first("_source").alias("source"), F.sum(F.col("_use").cast("int")).alias("support_voxels"), F.first("_support").alias("support_fraction"),
        F.avg(kept).alias("mean_raw"), F.coalesce(F.stddev_samp(kept), F.lit(0.0)).alias("std_raw"), F.first("_fp").alias("_fp"),
        F.first("_enough").alias("_enough"),
    )
    scale_floor = F.greatest(F.lit(1e-8), F.lit(floor) * F.col("_fp")[1])
    applied = F.col("mean_raw").isNull() | (F.col("mean_raw") < scale_floor)
    return g.select(
        "uid", "source", "support_voxels", "support_fraction", "mean_raw", "std_raw", scale_floor.alias("scale_floor"),
        F.greatest(F.coalesce("mean_raw", F.lit(0.0)), scale_floor).alias("scale"), applied.alias("floor_applied"),
        (F.col("_enough") & (F.col("source") == "consensus_brain_background") & ~applied).alias("qc_valid"),
        F.col("_fp")[0].alias("p50"), F.col("_fp")[1].alias("p90"), F.col("_fp")[2].alias("p99"),
    )


def binding(target: Column, background: Column) -> Column:
    """(target - background) / background, NULL for a vanishing background."""
    return (target - background) / F.when(background > 1e-8, background)


def uptake_ratio(voxels: DataFrame, background: DataFrame) -> DataFrame:
    """Binding ratio of the target and its sides, weaker side, asymmetry and ratio percentiles (``scale`` per scan)."""
    df = with_shape(by_scan(voxels)).join(background.select("uid", "scale"), "uid").where("m")
    right, anterior = F.col("x") < F.floor(F.col("nx") / 2), F.col("y_") < F.floor(F.col("ny") / 2)
    v, ratio = F.col("v"), F.col("v") / F.col("scale")
    g = df.groupBy("uid").agg(
        F.first("scale").alias("scale"), F.avg(v).alias("t"), F.avg(F.when(right, v)).alias("r"), F.avg(F.when(~right, v)).alias("l"),
        F.avg(F.when(anterior, v)).alias("a"), F.avg(F.when(~anterior, v)).alias("p"), F.avg(ratio).alias("ratio_mean"),
        F.stddev_samp(ratio).alias("ratio_std"), *[pct(ratio, q).alias(f"ratio_p{q}") for q in (10, 50, 90)],
    )
    c = F.col
    side = F.greatest((c("l") + c("r")) / F.lit(2.0), F.lit(1e-8))
    return g.select(
        "uid", binding(c("t"), c("scale")).alias("sbr"), binding(c("r"), c("scale")).alias("right_sbr"), binding(c("l"), c("scale")).alias("left_sbr"),
        F.least(binding(c("r"), c("scale")), binding(c("l"), c("scale"))).alias("min_side_sbr"), (F.abs(c("l") - c("r")) / side).alias("asymmetry_abs"),
        ((c("l") - c("r")) / side).alias("asymmetry_signed"), (c("p") / F.greatest(c("a"), F.lit(1e-8))).alias("posterior_anterior"),
        F.log1p(F.greatest(c("t"), F.lit(0.0)) / c("scale")).alias("log_target"), "ratio_mean", "ratio_std", "ratio_p10", "ratio_p50", "ratio_p90",
    )


def mask_sensitivity(voxels: DataFrame, background: DataFrame, percentiles: Sequence[int] = (70, 80, 90)) -> DataFrame:
    """Range of the binding ratio under thresholds of the target, erosion/dilation by one voxel and one-voxel shifts."""
    df = vx.erode(vx.dilate(voxels, "m", "_wide"), "m", "_thin")
    df = df.select("*", F.percentile(F.when(F.col("m"), F.col("v")), F.array(*[F.lit(p / 100.0) for p in percentiles])).over(whole()).alias("_q"))
    v, m = F.col("v"), F.col("m")
    levels = [F.avg(F.when(m & (v >= F.col("_q")[i]), v)).alias(f"t{i}") for i in range(len(percentiles))]
    shapes = [F.avg(F.when(F.col("_thin"), v)).alias("s0"), F.avg(F.when(m, v)).alias("s1"), F.avg(F.when(F.col("_wide"), v)).alias("s2")]
    means = df.groupBy("uid").agg(*levels, *shapes)
    moved = vx.offset_join_masked(voxels, vx.SHIFTS)
    moves = moved.groupBy("uid", "dz", "dy", "dx").agg(F.avg("b").alias("a"))
    scale = background.select("uid", "scale")
    moves = moves.join(scale, "uid").groupBy("uid").agg(
        (F.max(binding(F.col("a"), F.col("scale"))) - F.min(binding(F.col("a"), F.col("scale")))).alias("translation_span")
    )
    j = means.join(scale, "uid")
    span = lambda names: (
        F.greatest(*[binding(F.col(x), F.col("scale")) for x in names]) - F.least(*[binding(F.col(x), F.col("scale")) for x in names])
    )
    j = j.select("uid", span([f"t{i}" for i in range(len(percentiles))]).alias("threshold_span"), span(["s0", "s1", "s2"]).alias("mask_span"))
    return j.join(moves, "uid")


# --- templates and alignment -----------------------------------------------------------------------------------------


def template_volume(voxels: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Mean, median and majority mask per voxel over the members of a template group.

    The members of a group are unbounded; the median is the exact distributed one (per group and position).
    """
    g = voxels.groupBy(*keys, *POS).agg(F.avg("v").alias("mean"), (F.avg(F.col("m").cast("double")) >= 0.5).alias("mask"), F.count("v").alias("n"))
    med = wide_quantiles(voxels.select(*keys, *POS, "v"), [*keys, *POS], ["v"], {"med": 0.5})
    return g.join(med.withColumnRenamed("med_v", "median"), [*keys, *POS])


def corr_from(a: Column, b: Column, use: Column, min_n: int = 10) -> Column:
    """Pearson correlation over the voxels in ``use``; NULL below ``min_n`` or when one side is constant."""
    x, y = F.when(use, a), F.when(use, b)
    ok = (F.count(x) >= min_n) & (F.stddev_pop(x) > 1e-12) & (F.stddev_pop(y) > 1e-12)
    return F.when(ok, F.corr(x, y))


def volume_correlation(a: DataFrame, b: DataFrame, on: Sequence[str], keys: Sequence[str], min_n: int = 10) -> DataFrame:
    """Correlation over the union of positive voxels per ``keys``; a voxel only one volume has counts as 0 in the other."""
    j = a.withColumnRenamed("v", "_a").join(b.withColumnRenamed("v", "_b"), list(on), "full_outer")
    x, y = F.coalesce("_a", F.lit(0.0)), F.coalesce("_b", F.lit(0.0))
    return j.groupBy(*keys).agg(corr_from(x, y, (x > 0) | (y > 0), min_n).alias("corr"))


def shift_search(voxels: DataFrame, template: DataFrame, offsets: Sequence[tuple[int, int, int]], keys: Sequence[str] = (), min_n: int = 10) -> DataFrame:
    """Best integer shift of every scan onto a template (z, y_, x, t): shift, correlation before, after and gain.

    A shifted voxel reads from the same scan; positions that leave the grid read 0.
    """
    shifts = F.array(*[F.struct(F.lit(a).alias("dz"), F.lit(b).alias("dy"), F.lit(c).alias("dx")) for a, b, c in offsets])
    grid = by_scan(voxels).select("uid", *keys, *POS, F.explode(shifts).alias("o"))
    grid = grid.select("uid", *keys, *POS, "o.*", (F.col("z") - F.col("o.dz")).alias("_z"), (F.col("y_") - F.col("o.dy")).alias("_y"), (F.col("x") - F.col("o.dx")).alias("_x"))
    source = voxels.select("uid", F.col("z").alias("_z"), F.col("y_").alias("_y"), F.col("x").alias("_x"), "v")
    j = grid.join(source, ["uid", "_z", "_y", "_x"], "left").join(template, [*keys, *POS])
    a, b = F.coalesce("v", F.lit(0.0)), F.col("t")
    c = j.groupBy("uid", "dz", "dy", "dx").agg(corr_from(a, b, (a > 0) | (b > 0), min_n).alias("c"))
    still = (F.col("dz") == 0) & (F.col("dy") == 0) & (F.col("dx") == 0)
    size = F.abs("dz") + F.abs("dy") + F.abs("dx")
    best = F.min(F.when(F.col("c").isNotNull(), F.struct((-F.round("c", 12)).alias("k"), size.alias("s"), "dz", "dy", "dx", "c")))
    g = c.groupBy("uid").agg(best.alias("_b"), F.max(F.when(still, F.col("c"))).alias("before"))
    return g.select("uid", "_b.dz", "_b.dy", "_b.dx", "before", F.col("_b.c").alias("after"), (F.col("_b.c") - F.col("before")).alias("gain"))


def template_groups(voxels: DataFrame, members: int) -> DataFrame:
    """(template, rank, uid): prototypes by the quartiles of the weaker/stronger putamen and by their difference."""
    r = vx.region_means(vx.region_masks(voxels, core=False), "v", list(vx.QUADRANTS))
    s = r.select(
        "uid", F.least("right_putamen", "left_putamen").alias("lo"), F.greatest("right_putamen", "left_putamen").alias("hi"),
        (F.col("left_putamen") - F.col("right_putamen")).alias("signed"),
    )
    q = wide_quantiles(s, [], ["lo"], {"q1": 0.25, "q3": 0.75}).first()
    picks = [
        ("normal_like", s.where(F.col("lo") >= q["q3_lo"]), -F.col("lo")), ("bilateral_strong", s.where(F.col("hi") <= q["q1_lo"]), F.col("hi")),
        ("left_reduced", s, -F.col("signed")), ("right_reduced", s, F.col("signed")),
    ]
    out = None
    for name, rows, order in picks:
        part = rows.select(F.lit(name).alias("template"), "uid", order.alias("score")).orderBy("score", "uid").limit(members)
        out = part if out is None else out.unionByName(part)
    w = Window.partitionBy("template").orderBy("score", "uid")
    return out.select("template", F.row_number().over(w).alias("rank"), "uid")


def template_weights(corr: DataFrame, temperature: float = 0.12) -> DataFrame:
    """softmax(corr / temperature) over the few templates of each scan."""
    w = F.exp((F.col("corr") - F.max("corr").over(whole())) / F.lit(temperature))
    e = corr.withColumn("_e", w)
    return e.withColumn("weight", F.col("_e") / F.sum("_e").over(whole())).drop("_e")


def volume_audit(voxels: DataFrame, shape: tuple[int, int, int], tolerance: float = 5e-3) -> DataFrame:
    """Finite, shape, norm error of the self-normalised ``s`` and the laterality rule: pass flag per scan."""
    pos = F.when(F.col("m") & (F.col("s") > 0), F.col("s"))
    df = with_shape(by_scan(voxels))
    back = F.col("m") & (F.col("y_") >= (F.col("ny") - 1) / F.lit(2.0))
    mid = (F.col("nx") - 1) / F.lit(2.0)
    g = df.groupBy("uid").agg(
        (F.count("s") == F.count(F.lit(1))).alias("finite"), F.max("nz").alias("nz"), F.max("ny").alias("ny"), F.max("nx").alias("nx"),
        F.count(F.lit(1)).alias("cells"), F.count(pos).alias("positive"), F.sqrt(F.sum(pos * pos)).alias("_norm"),
        F.coalesce(F.avg(F.when(back & (F.col("x") < mid), F.col("s"))), F.lit(0.0)).alias("_r"),
        F.coalesce(F.avg(F.when(back & (F.col("x") >= mid), F.col("s"))), F.lit(0.0)).alias("_l"),
    )
    fits = (F.col("nz") == shape[0]) & (F.col("ny") == shape[1]) & (F.col("nx") == shape[2]) & (F.col("cells") == shape[0] * shape[1] * shape[2])
    error = F.abs(F.col("_norm") / F.sqrt(nonzero(F.col("positive"))) - F.lit(1.0))
    lateral = F.col("_r") <= F.col("_l") + F.lit(1e-5)
    return g.select(
        "uid", "finite", fits.alias("shape_valid"), "positive", error.alias("norm_error"), lateral.alias("laterality_valid"),
        (F.col("finite") & fits & F.coalesce(error <= tolerance, F.lit(False)) & lateral).alias("passed"),
    )


# --- region graph and training targets ---------------------------------------------------------------------------------


def _eight(value: str, prefix: str) -> list[Column]:
    v = F.col(value)
    p = F.percentile(v, F.array(F.lit(0.1), F.lit(0.5), F.lit(0.9)))
    zero = lambda c: F.coalesce(c, F.lit(0.0))
    return [
        zero(F.avg(v)).alias(f"{prefix}_mean"), zero(F.stddev_pop(v)).alias(f"{prefix}_std"), *[zero(p[i]).alias(f"{prefix}_p{n}") for i, n in enumerate((10, 50, 90))],
        zero(F.max(v)).alias(f"{prefix}_max"), zero(F.avg(v * v)).alias(f"{prefix}_energy"),
        zero(F.percentile(F.abs(v - F.col(f"_med_{value}")), F.lit(0.5))).alias(f"{prefix}_mad"),
    ]


def graph_nodes(voxels: DataFrame, bands: int = 2) -> DataFrame:
    """Twelve nodes (proxy region x axial band) with 21 features each; empty nodes are rows of zeros."""
    s = vx.self_normalize(voxels)
    s = s.withColumn("_hot", pct(F.when(F.col("m"), F.col("v")), 85).over(whole()))
    r = vx.proxy_regions(s).withColumn("band", F.floor(F.col("z") * bands / F.col("nz")).cast("int"))
    w = Window.partitionBy("uid", "region", "band")
    r = r.select("*", *[F.percentile(F.col(c), F.lit(0.5)).over(w).alias(f"_med_{c}") for c in ("v", "s")])
    pos = F.col("v") > 0
    centers = [
        F.coalesce(F.avg(F.when(pos, F.col(c))) / F.greatest(F.max(n) - 1, F.lit(1)), F.lit(0.0)).alias(f"center_{c}") for c, n in zip(POS, ("nz", "ny", "nx"))
    ]
    g = r.groupBy("uid", "region", "band").agg(
        *_eight("v", "raw"), *_eight("s", "norm"), *centers, F.avg(pos.cast("double")).alias("occupancy"),
        F.avg((F.col("v") >= F.col("_hot")).cast("double")).alias("high_fraction"),
    )
    names = F.array(*[F.struct(F.lit(n).alias("region"), F.lit(i).alias("i")) for i, n in enumerate(PROXIES)])
    frame = voxels.select("uid").distinct().select("uid", F.explode(names).alias("e"))
    frame = frame.select("uid", "e.region", F.col("e.i").alias("_i"), F.explode(F.sequence(F.lit(0), F.lit(bands - 1))).alias("band"))
    full = frame.join(g, ["uid", "region", "band"], "left").na.fill(0.0)
    return full.withColumn("node", F.col("_i") * bands + F.col("band")).drop("_i")


def graph_edge_list(bands: int = 2) -> list[tuple[int, int, float]]:
    """Symmetric normalised adjacency of the fixed region graph, self loops included."""
    node = lambda region, band: region * bands + band
    links = {(node(r, b), node(r, b + 1)) for r in range(6) for b in range(bands - 1)}
    links |= {(node(side + i, b), node(side + i + 1, b)) for side in (0, 3) for i in range(2) for b in range(bands)}
    links |= {(node(i, b), node(3 + i, b)) for i in range(3) for b in range(bands)}
    pairs = links | {(b, a) for a, b in links} | {(i, i) for i in range(6 * bands)}
    degree = np.bincount([a for a, _ in pairs], minlength=6 * bands)
    return [(a, b, float(1.0 / np.sqrt(degree[a] * degree[b]))) for a, b in sorted(pairs)]


def graph_edges(nodes: DataFrame, value: str, bands: int = 2) -> DataFrame:
    """Edges of every scan with their weight and the value at both ends: (uid, src, dst, w, src_value, dst_value)."""
    items = F.array(*[F.struct(F.lit(a).alias("src"), F.lit(b).alias("dst"), F.lit(w).alias("w")) for a, b, w in graph_edge_list(bands)])
    packed = nodes.groupBy("uid").agg(F.map_from_entries(F.collect_list(F.struct("node", value))).alias("_v"))
    e = packed.select("uid", "_v", F.explode(items).alias("e"))
    return e.select("uid", "e.src", "e.dst", "e.w", F.col("_v")[F.col("e.src")].alias("src_value"), F.col("_v")[F.col("e.dst")].alias("dst_value"))


def auxiliary_targets(voxels: DataFrame, fragmentation: bool = True) -> DataFrame:
    """Six region means, weaker side, putamen asymmetry and (optionally) fragmentation of the hottest mask voxels."""
    r = vx.region_means(vx.proxy_regions(voxels), "v", list(PROXIES))
    right = (F.col(PROXIES[1]) + F.col(PROXIES[2])) / F.lit(2.0)
    left = (F.col(PROXIES[4]) + F.col(PROXIES[5])) / F.lit(2.0)
    asym = F.abs(left - right) / F.greatest(F.abs(left) + F.abs(right), F.lit(1e-6))
    out = r.select("uid", *PROXIES, (left < right).cast("double").alias("affected_left"), asym.alias("asymmetry"))
    if not fragmentation:
        return out
    hot = by_scan(voxels).withColumn("_cut", pct(F.when(F.col("m"), F.col("v")), 85).over(whole()))
    parts = vx.connected_components(hot, F.col("m") & (F.col("v") >= F.col("_cut")))
    return out.join(parts.select("uid", (F.least(F.col("components"), F.lit(12)) / F.lit(12.0)).alias("fragmentation")), "uid")


def magnitude_summary(voxels: DataFrame) -> DataFrame:
    """L2 norm, mean, 90th percentile and positive count inside the mask."""
    v = F.col("v")
    return voxels.where("m").groupBy("uid").agg(
        F.sqrt(F.sum(v * v)).alias("l2_norm"), F.avg(v).alias("mean"), pct(v, 90).alias("p90"), F.sum((v > 0).cast("int")).alias("positive_voxels")
    )


def core_features(voxels: DataFrame, bins: int = 24, min_n: int = 32, min_positive: int = 32) -> DataFrame:
    """Background-free feature row of the robust-normalised target: percentiles, widths, ratios, entropy, asymmetry, high uptake.

    Texture, projections, components and shape join on the scan key (:func:`core_feature_blocks`).
    """
    return _core_rows(_high_uptake(voxels, min_positive), bins, min_n)


def _high_uptake(voxels: DataFrame, min_positive: int) -> DataFrame:
    """Robust-normalised voxels with their scan's centre (_c), extent (_s) and the closed high-uptake part (_closed)."""
    df = by_scan(vx.robust_normalize(voxels, min_n=min_positive).withColumn("v", F.col("robust")).drop("robust"))
    m = F.col("m")
    inside = F.when(m, F.col("v"))
    df = df.select(
        "*", *[F.avg(F.when(m, F.col(c))).over(whole()).alias(f"_c{c}") for c in POS], pct(inside, 85).over(whole()).alias("_hot"),
        *[F.greatest(F.max(F.when(m, F.col(c))).over(whole()) - F.min(F.when(m, F.col(c))).over(whole()), F.lit(1)).alias(f"_s{c}") for c in POS],
    )
    df = df.withColumn("_high", m & (F.col("v") >= F.col("_hot")))
    return vx.closing(df, "_high", "_closed")


def _core_rows(df: DataFrame, bins: int, min_n: int) -> DataFrame:
    m = F.col("m")
    inside = F.when(m, F.col("v"))
    high = F.col("_closed")
    right, anterior = F.col("x") < F.col("_cx"), F.col("y_") < F.col("_cy_")
    v = F.col("v")
    mean = lambda cond: F.coalesce(F.avg(F.when(m & cond, v)), F.lit(0.0))
    count = lambda cond: F.sum(cond.cast("int"))
    names = (10, 25, 50, 75, 90, 99)
    g = df.groupBy("uid").agg(
        F.count(inside).alias("n"), F.avg(inside).alias("target_mean"), F.stddev_pop(inside).alias("target_std"),
        F.percentile(inside, F.array(*[F.lit(p / 100.0) for p in names])).alias("_p"), mean(right).alias("_r"), mean(~right).alias("_l"),
        mean(anterior).alias("_a"), mean(~anterior).alias("_b"), count(high).alias("_h"), count(m).alias("_m"),
        (count(high & m & right) / F.greatest(count(m & right), F.lit(1))).alias("_hr"), (count(high & m & ~right) / F.greatest(count(m & ~right), F.lit(1))).alias("_hl"),
        *[F.coalesce((F.avg(F.when(high, F.col(c))) - F.first(f"_c{c}")) / F.first(f"_s{c}"), F.lit(0.0)).alias(f"high_center_{c}") for c in POS],
    )
    p = lambda q: F.col("_p")[names.index(q)]
    side = (F.abs("_l") + F.abs("_r")) / F.lit(2.0)
    g = require(g, F.col("n") >= min_n, "target mask has too few voxels")
    g = g.select(
        "uid", "target_mean", "target_std", *[p(q).alias(f"target_p{q}") for q in names], (p(75) - p(25)).alias("target_iqr"), (p(90) - p(10)).alias("target_width"),
        safe_ratio(p(90), p(50)).alias("p90_p50"), safe_ratio(p(99), p(50)).alias("p99_p50"), (F.abs(F.col("_l") - F.col("_r")) / F.greatest(side, F.lit(1e-6))).alias("lr_asymmetry"),
        safe_ratio(F.col("_b"), F.col("_a")).alias("posterior_anterior"), (F.col("_h") / F.greatest(F.col("_m"), F.lit(1))).alias("high_fraction"),
        (F.least("_hl", "_hr") / F.greatest(F.greatest("_hl", "_hr"), F.lit(1e-6))).alias("high_balance"), *[f"high_center_{c}" for c in POS],
    )
    return g.join(vx.scan_entropy(by_scan(df.where("m").select("uid", "v")), bins, out="target_entropy"), "uid")


def core_feature_blocks(voxels: DataFrame, spacing: tuple[float, float, float], levels: int = 24, min_positive: int = 32) -> DataFrame:
    """:func:`core_features` with texture, projections, components and shape of the high-uptake part."""
    # Normalised and closed once: the blocks read the written voxels, and none sorts them beside another in one task.
    r = cut(_high_uptake(voxels, min_positive))
    out = cut(_core_rows(r, levels, 32))
    tex = vx.glcm(r, levels)
    out = out.join(tex.select("uid", *[F.col(c).alias(f"texture_{c}") for c in tex.columns if c != "uid"]), "uid", "left")
    for axis in POS:
        s = cut(vx.mip_summary(r, axis, 32, F.col("m")))
        out = out.join(s.select("uid", *[F.col(c).alias(f"mip_{axis}_{c}") for c in ("mean", "std", "entropy")]), "uid", "left")
    out = out.join(cut(vx.connected_components(r, F.col("_closed"))), "uid", "left")
    shape = cut(vx.shape_features(r.where("_closed").select("uid", *POS), spacing))
    return out.join(shape.select("uid", *[F.col(c).alias(f"high_{c}") for c in shape.columns if c not in ("uid", "n")]), "uid", "left")


# --- consensus masks and atlas labels ----------------------------------------------------------------------------------


def largest_component(voxels: DataFrame, mask: str, out: str, part: Column | None = None) -> DataFrame:
    """``out``: the largest 6-connected part of ``mask`` per scan (and per ``part`` value)."""
    tagged = voxels.withColumn("_part", part if part is not None else F.lit("all"))
    key = F.concat_ws("|", F.col("uid").cast("string"), "_part")
    active = tagged.where(F.col(mask)).select(key.alias("uid"), *POS)
    labels = vx.label_components(active)
    best = labels.groupBy("uid", "component").agg(F.count(F.lit(1)).alias("c"))
    best = best.groupBy("uid").agg(F.min(F.struct((-F.col("c")).alias("k"), "component"))["component"].alias("component"))
    keep = labels.join(best, ["uid", "component"]).select(F.col("uid").alias("_key"), *POS, F.lit(True).alias("_keep"))
    j = tagged.withColumn("_key", key).join(keep, ["_key", *POS], "left")
    return j.withColumn(out, F.coalesce("_keep", F.lit(False))).drop("_key", "_part", "_keep")


def fill_holes(voxels: DataFrame, mask: str, out: str) -> DataFrame:
    """Background parts that do not reach the border of the grid become foreground."""
    df = with_shape(by_scan(voxels))
    labels = vx.label_components(df.where(~F.col(mask)).select("uid", *POS))
    edge = F.lit(False)
    for c, n in zip(POS, ("nz", "ny", "nx")):
        edge = edge | (F.col(c) == 0) | (F.col(c) == F.col(n) - 1)
    j = df.join(labels, ["uid", *POS], "left").withColumn("_edge", edge)
    reach = j.groupBy("uid", "component").agg(F.max("_edge").alias("_open"))
    j = null_safe(j, reach, ["uid", "component"], "left")
    return j.select(*voxels.columns, (F.col(mask) | ~F.coalesce("_open", F.lit(True))).alias(out))


def consensus_masks(template: DataFrame, percentile: float = 90.0, min_brain: int = 100, min_background: int = 20) -> DataFrame:
    """Target, brain and background masks (and the halves of the target) of template volumes (uid, z, y_, x, v).

    The steps read the few template volumes several times, so each component step starts from a written table.
    """
    df = with_shape(by_scan(cut(template)))
    v, pos = F.col("v"), F.col("v") > 0
    df = df.select("*", (vx.in_central_box() & pos).alias("_box"))
    df = df.select("*", pct(F.when(F.col("_box"), v), percentile).over(whole()).alias("_hot"), pct(F.when(pos, v), 10).over(whole()).alias("_low"))
    df = df.withColumn("_raw", F.col("_box") & (v >= F.col("_hot"))).withColumn("_support", pos & (v >= F.col("_low")))
    side = F.when(F.col("x") < F.floor(F.col("nx") / 2), "right").otherwise("left")
    df = cut(largest_component(cut(df), "_raw", "_sides", side))
    df = cut(fill_holes(cut(vx.closing(df, "_sides", "_joined")), "_joined", "target"))
    df = with_shape(by_scan(vx.closing(df.drop("nz", "ny", "nx"), "_support", "_closed", 2)))
    df = df.withColumn("_inner", F.col("_closed") & vx.in_central_ellipsoid())
    df = cut(largest_component(cut(df.drop("nz", "ny", "nx")), "_inner", "_body"))
    df = cut(fill_holes(cut(vx.closing(df, "_body", "_body2", 2)), "_body2", "_brain"))
    df = vx.dilate(df, "target", "_near", 3)
    n = lambda c: F.sum(F.col(c).cast("int")).over(whole())
    df = df.select("*", n("_brain").alias("_nb"), n("target").alias("_nt"))
    small = F.col("_nb") < F.greatest(F.lit(min_brain), F.col("_nt") * 2)
    df = df.withColumn("brain", F.when(small, F.col("_closed") & F.col("_box")).otherwise(F.col("_brain")))
    df = with_shape(df).select("*", pct(F.when(F.col("brain") & pos, v), 70).over(whole()).alias("_cut"))
    band = F.lit(True)
    for c, size, a, b in (("z", "nz", 0.15, 0.85), ("y_", "ny", 0.55, 0.95), ("x", "nx", 0.10, 0.90)):
        band = band & (F.col(c) >= F.floor(F.col(size) * F.lit(a))) & (F.col(c) < F.floor(F.col(size) * F.lit(b)))
    wide = F.col("brain") & ~F.col("_near") & (v <= F.col("_cut"))
    df = df.withColumn("_bg", band & wide).withColumn("_wide", wide)
    df = df.select("*", n("_bg").alias("_nbg"))
    few = F.col("_nbg") < F.greatest(F.lit(min_background), F.floor(F.col("_nt") / 2))
    t = F.col("target")
    mid = lambda c, s: F.col(c) < F.floor(F.col(s) / 2)
    return df.select(
        "uid", *POS, "v", "target", "brain", F.when(few, F.col("_wide")).otherwise(F.col("_bg")).alias("background"), (t & mid("x", "nx")).alias("right"),
        (t & ~mid("x", "nx")).alias("left"), (t & mid("y_", "ny")).alias("anterior"), (t & ~mid("y_", "ny")).alias("posterior"),
    )


def label_masks(atlas: DataFrame, names: dict[int, str], required: Sequence[str], label: str = "label") -> DataFrame:
    """Named masks of an integer label volume as (voxel columns, name); a missing required region raises.

    The name table is the handful of atlas labels, so the lookup is a map literal.
    """
    lookup = F.create_map(*[F.lit(x) for k, n in names.items() for x in (k, n)])
    named = atlas.withColumn("name", lookup[F.col(label)]).where(F.col("name").isNotNull())
    sizes = atlas.select("uid", lookup[F.col(label)].alias("name")).groupBy("uid").agg(F.collect_set("name").alias("_have"))
    wanted = F.array(*[F.lit(n) for n in required])
    checked = require(sizes, F.size(F.array_except(wanted, "_have")) == 0, "the atlas lacks a required region").select("uid")
    return named.join(checked, "uid", "left_semi")


# --- explanation maps --------------------------------------------------------------------------------------------------


def mask_saliency(maps: DataFrame, value: str = "v", mask: str = "m") -> DataFrame:
    """Saliency share inside the mask and its enrichment over the volume share."""
    a, m = F.abs(F.col(value)), F.col(mask)
    g = maps.groupBy("uid").agg(
        (F.coalesce(F.sum(F.when(m, a)), F.lit(0.0)) / F.greatest(F.sum(a), F.lit(1e-8))).alias("saliency_fraction"), F.avg(m.cast("double")).alias("volume_fraction")
    )
    return g.withColumn("enrichment", F.col("saliency_fraction") / F.greatest(F.col("volume_fraction"), F.lit(1e-8)))


def counterfactual_summary(deltas: DataFrame, expected: str, delta: str, invariance: float, direction: float) -> DataFrame:
    """Largest absolute stable delta, directed delta and contradiction flags per scan (``expected``: stable/increase/decrease)."""
    d, kind = F.col(delta), F.col(expected)
    against = ((kind == "increase") & (d < -direction)) | ((kind == "decrease") & (d > direction))
    g = deltas.groupBy("uid").agg(
        F.max(F.when(kind == "stable", F.abs(d))).alias("max_stable_delta"), F.max(F.when(kind != "stable", d)).alias("directed_delta"),
        F.bool_or(against).alias("direction_contradiction"),
    )
    return g.withColumn("invariance_failed", F.coalesce(F.col("max_stable_delta") > invariance, F.lit(False)))


def window_starts(size: Column, patch: int, stride: int) -> Column:
    """Window starts along an axis: every ``stride`` voxels, plus a last window that ends at the border."""
    last = F.greatest(size - F.lit(patch), F.lit(0))
    return F.array_distinct(F.concat(F.sequence(F.lit(0), last, F.lit(stride)), F.array(last)))


def occlusion_map(windows: DataFrame, patch: tuple[int, int, int], shape: tuple[int, int, int]) -> DataFrame:
    """Mean score delta and coverage per voxel from windows (uid, z0, y0, x0, delta); voxels come from the window sizes."""
    df = windows
    for c, p, n in zip(("z", "y", "x"), patch, shape):
        end = F.least(F.col(f"{c}0") + p, F.lit(n)) - 1
        df = df.withColumn(c if c != "y" else "y_", F.explode(F.sequence(F.col(f"{c}0"), end)))
    g = df.groupBy("uid", *POS).agg(F.avg("delta").alias("signed_delta"), F.count(F.lit(1)).alias("coverage"))
    return g.withColumn("importance", F.abs("signed_delta"))


def map_agreement(a: DataFrame, b: DataFrame, random: DataFrame, minimum: float = 0.10, sanity: float = 0.80) -> DataFrame:
    """Correlation of two maps (contradiction below ``minimum``) and of the first with a randomised model's map."""
    j = a.withColumnRenamed("v", "a").join(b.withColumnRenamed("v", "b"), ["uid", *POS]).join(random.withColumnRenamed("v", "r"), ["uid", *POS])
    pair = lambda x, y: F.when((F.stddev_pop(x) > 1e-8) & (F.stddev_pop(y) > 1e-8), F.corr(x, y))
    g = j.groupBy("uid").agg(pair("a", "b").alias("agreement"), pair("a", "r").alias("random_agreement"))
    return g.select(
        "*", F.coalesce(F.col("agreement") < minimum, F.lit(False)).alias("contradiction"),
        F.coalesce(F.abs("random_agreement") < sanity, F.lit(False)).alias("sanity_pass"),
    )
