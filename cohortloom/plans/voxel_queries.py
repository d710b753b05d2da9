"""Voxel queries: whole-scan quality, regions, texture, shape."""

from __future__ import annotations

from pyspark.sql import functions as F

from cohortloom.operators import bank
from cohortloom.operators import voxel as vx
from cohortloom.plans import fixtures as fx
from cohortloom.registry import query

C = F.col
SPACING = (2.5, 2.0, 3.0)
EPS32 = 1.1920928955078125e-07


def vox(spark, sf):
    return fx.voxels(spark, sf).select("uid", "z", "y_", "x", "v", "m")


def offsets_sql(offsets):
    return "(VALUES " + ", ".join(f"({a}, {b}, {c})" for a, b, c in offsets) + ") o(dz, dy, dx)"


@query(
    "j11_offset_join",
    "uid:i z:i y_:i x:i dz:i dy:i dx:i a:d b:d",
    f"""SELECT l.uid, l.z, l.y_, l.x, o.dz, o.dy, o.dx, l.v AS a, r.v AS b FROM fx_voxels l CROSS JOIN {offsets_sql(vx.AXES_3)}
        JOIN fx_voxels r ON r.uid = l.uid AND r.z = l.z + o.dz AND r.y_ = l.y_ + o.dy AND r.x = l.x + o.dx WHERE l.m AND r.m""",
    "fx_voxels",
)
def _(spark, sf):
    return vx.offset_join(vox(spark, sf).where("m"), vx.AXES_3, "v")


_REF = "(SELECT *, v > 0 OR max(v) OVER (PARTITION BY uid) <= 0 AS ref FROM fx_voxels)"
_HIST = """(SELECT uid, CASE WHEN sum(c) < 2 THEN 0 ELSE greatest(log2(sum(c)) - sum(c * log2(c)) / sum(c), 0) END AS entropy FROM (SELECT uid, b, CAST(count(*) AS DOUBLE) AS c FROM (
  SELECT uid, coalesce(least(floor((v - lo) / nullif(hi - lo, 0) * {bins}), {bins} - 1), 0) AS b FROM (SELECT uid, v, min(v) OVER (PARTITION BY uid) AS lo, max(v) OVER (PARTITION BY uid) AS hi FROM {source})) GROUP BY uid, b) GROUP BY uid)"""


@query(
    "v01_scan_qc",
    "uid:i nz:i ny:i nx:i fov_z:d voxel_volume:d finite_fraction:d zero_fraction:d positive_fraction:d v_min:d v_max:d p01:d p05:d p50:d p90:d p995:d entropy:d",
    f"""SELECT s.*, e.entropy FROM (SELECT uid, max(z) + 1 AS nz, max(y_) + 1 AS ny, max(x) + 1 AS nx, (max(z) + 1) * 2.5 AS fov_z, 15.0 AS voxel_volume, 1.0 AS finite_fraction,
        avg(CASE WHEN v = 0 THEN 1 ELSE 0 END) AS zero_fraction, avg(CASE WHEN v > 0 THEN 1 ELSE 0 END) AS positive_fraction, min(v) AS v_min, max(v) AS v_max,
        {', '.join(f"quantile_cont(v, {p / 100}) FILTER (ref) AS {n}" for p, n in ((1, 'p01'), (5, 'p05'), (50, 'p50'), (90, 'p90'), (99.5, 'p995')))}
        FROM {_REF} GROUP BY uid) s JOIN {_HIST.format(bins=64, source=f'(SELECT * FROM {_REF} WHERE ref)')} e ON s.uid = e.uid""",
    "fx_voxels",
)
def _(spark, sf):
    return vx.scan_qc(vox(spark, sf), SPACING)


NORM = f"""(SELECT *, greatest(least((v - lo) / greatest(hi - lo, CAST({EPS32!r} AS DOUBLE)), CAST(1 AS DOUBLE)), CAST(0 AS DOUBLE)) AS norm FROM (
  SELECT *, quantile_cont(CASE WHEN ref THEN v END, 0.01) OVER (PARTITION BY uid) AS lo, quantile_cont(CASE WHEN ref THEN v END, 0.995) OVER (PARTITION BY uid) AS hi,
    quantile_cont(CASE WHEN ref THEN v END, 0.5) OVER (PARTITION BY uid) AS p50, quantile_cont(CASE WHEN ref THEN v END, 0.05) OVER (PARTITION BY uid) AS p05 FROM {_REF}))"""
ROBUST = """(SELECT * EXCLUDE (v), CASE WHEN n >= {n} AND v > 0 THEN greatest(least((greatest(least(v, q1), q0) - q3) / greatest(q4 - q2, CAST(0.000001 AS DOUBLE)), CAST(3 AS DOUBLE)), CAST(-3 AS DOUBLE)) ELSE 0 END AS v FROM (
  SELECT *, count(p) OVER w AS n, quantile_cont(p, 0.005) OVER w AS q0, quantile_cont(p, 0.995) OVER w AS q1, quantile_cont(p, 0.05) OVER w AS q2, quantile_cont(p, 0.5) OVER w AS q3, quantile_cont(p, 0.95) OVER w AS q4
  FROM (SELECT *, CASE WHEN v > 0 THEN v END AS p FROM fx_voxels) WINDOW w AS (PARTITION BY uid)))"""


@query("v02_normalize_volume", "uid:i z:i y_:i x:i norm:d", f"SELECT uid, z, y_, x, norm FROM {NORM}", "fx_voxels")
def _(spark, sf):
    return vx.normalize_volume(vox(spark, sf))


@query("v02_robust_normalize", "uid:i z:i y_:i x:i robust:d", f"SELECT uid, z, y_, x, v AS robust FROM {ROBUST.format(n=32)}", "fx_voxels")
def _(spark, sf):
    return vx.robust_normalize(vox(spark, sf))


@query(
    "v03_adjacent_slice_corr",
    "uid:i slice_corr:d",
    """SELECT uid, median(c) AS slice_corr FROM (SELECT l.uid, l.z, CASE WHEN stddev_pop(l.v) > 1e-6 AND stddev_pop(r.v) > 1e-6 THEN corr(l.v, r.v) END AS c FROM fx_voxels l
       JOIN fx_voxels r ON r.uid = l.uid AND r.z = l.z + 1 AND r.y_ = l.y_ AND r.x = l.x GROUP BY l.uid, l.z) GROUP BY uid""",
    "fx_voxels",
)
def _(spark, sf):
    return vx.adjacent_slice_corr(vox(spark, sf))


def _grad_sql(axis, h):
    others = ", ".join(c for c in vx.POS if c != axis)
    w = f"OVER (PARTITION BY uid, {others} ORDER BY {axis})"
    return f"CASE WHEN lag(norm) {w} IS NULL THEN (lead(norm) {w} - norm) / {h} WHEN lead(norm) {w} IS NULL THEN (norm - lag(norm) {w}) / {h} ELSE (lead(norm) {w} - lag(norm) {w}) / (2 * {h}) END"


@query(
    "v04_gradient_magnitude",
    "uid:i gradient:d",
    f"""SELECT uid, avg(CASE WHEN v > p05 THEN sqrt(gz * gz + gy * gy + gx * gx) END) AS gradient FROM (
        SELECT uid, v, p05, {_grad_sql('z', 2.5)} AS gz, {_grad_sql('y_', 2.0)} AS gy, {_grad_sql('x', 3.0)} AS gx FROM {NORM}) GROUP BY uid""",
    "fx_voxels",
)
def _(spark, sf):
    n = vx.normalize_volume(vox(spark, sf)).select("*", vx.reference_flag().alias("_ref"))
    n = n.select("*", vx.pct(F.when(C("_ref"), C("v")), 5).over(vx.whole()).alias("p05"))
    return vx.gradient_magnitude(n, SPACING, "norm", C("v") > C("p05"))


_W = f"(SELECT *, CASE WHEN v > p50 THEN norm ELSE 0 END AS w FROM {NORM})"


@query(
    "v05_weighted_centroid",
    "uid:i centroid_z:d centroid_y_:d centroid_x:d",
    f"SELECT uid, coalesce(sum(w * z) / nullif(sum(w), 0), max(z) / 2) * 2.5 AS centroid_z, coalesce(sum(w * y_) / nullif(sum(w), 0), max(y_) / 2) * 2.0 AS centroid_y_, coalesce(sum(w * x) / nullif(sum(w), 0), max(x) / 2) * 3.0 AS centroid_x FROM {_W} GROUP BY uid",
    "fx_voxels",
)
def _(spark, sf):
    return vx.weighted_centroid(vx.foreground_weight(vox(spark, sf)), "w", SPACING)


@query(
    "v06_lr_asymmetry",
    "uid:i lower:d upper:d asymmetry_signed:d asymmetry_abs:d",
    f"""SELECT uid, lower, upper, (upper - lower) / greatest((lower + upper) / 2, CAST(1e-8 AS DOUBLE)) AS asymmetry_signed, abs(upper - lower) / greatest((lower + upper) / 2, CAST(1e-8 AS DOUBLE)) AS asymmetry_abs FROM (
        SELECT uid, sum(CASE WHEN x < 2 THEN w ELSE 0 END) AS lower, sum(CASE WHEN x >= 2 THEN w ELSE 0 END) AS upper FROM {_W} GROUP BY uid)""",
    "fx_voxels",
)
def _(spark, sf):
    return vx.lr_asymmetry(vx.foreground_weight(vox(spark, sf)), "w")


@query(
    "v07_connected_components",
    "uid:i components:i largest_fraction:d",
    """WITH RECURSIVE p AS (SELECT uid, quantile_cont(v, 0.8) AS cut FROM fx_voxels GROUP BY uid), a AS (SELECT f.uid, z, y_, x, z * 16 + y_ * 4 + x AS id FROM fx_voxels f JOIN p ON f.uid = p.uid WHERE v > cut),
       e AS (SELECT l.uid, l.id AS s, r.id AS t FROM a l JOIN a r ON l.uid = r.uid AND abs(l.z - r.z) + abs(l.y_ - r.y_) + abs(l.x - r.x) = 1),
       reach AS (SELECT uid, id AS s, id AS t FROM a UNION SELECT r.uid, r.s, e.t FROM reach r JOIN e ON e.uid = r.uid AND e.s = r.t),
       c AS (SELECT uid, s, min(t) AS comp FROM reach GROUP BY uid, s), k AS (SELECT uid, comp, count(*) AS n FROM c GROUP BY uid, comp)
       SELECT uid, count(*) AS components, max(n) / CAST(sum(n) AS DOUBLE) AS largest_fraction FROM k GROUP BY uid""",
    "fx_voxels",
)
def _(spark, sf):
    v = vx.by_scan(vox(spark, sf)).withColumn("cut", vx.pct(C("v"), 80).over(vx.whole()))
    return vx.connected_components(v, C("v") > C("cut"))


_MIP = "(SELECT uid, y_, x, max(v) AS v FROM fx_voxels WHERE m GROUP BY uid, y_, x)"


@query("v08_mip", "uid:i y_:i x:i v:d", f"SELECT * FROM {_MIP}", "fx_voxels")
def _(spark, sf):
    return vx.mip(vox(spark, sf), "z", C("m"))


@query(
    "v08_mip_summary",
    "uid:i mean:d std:d entropy:d",
    f"SELECT a.uid, a.mean, a.std, e.entropy FROM (SELECT uid, avg(v) AS mean, stddev_pop(v) AS std FROM {_MIP} GROUP BY uid) a JOIN {_HIST.format(bins=32, source=_MIP)} e ON a.uid = e.uid",
    "fx_voxels",
)
def _(spark, sf):
    return vx.mip_summary(vox(spark, sf), "z", 32, C("m"))


_QUAD = "concat(CASE WHEN x < 1.5 THEN 'right' ELSE 'left' END, '_', CASE WHEN y_ < 1.5 THEN 'caudate' ELSE 'putamen' END)"


def regions_sql(source="fx_voxels", extra="v"):
    """Nine regions by coordinates and the core by Euclidean distance to the background."""
    return f"""(SELECT uid, z, y_, x, {extra}, unnest(list_filter(['target', CASE WHEN x < 1.5 THEN 'right' ELSE 'left' END, CASE WHEN y_ < 1.5 THEN 'anterior' ELSE 'posterior' END, {_QUAD},
        CASE WHEN dist >= cut THEN 'target_core' END], lambda r: r IS NOT NULL)) AS region FROM (
      SELECT *, quantile_cont(dist, 0.6) OVER (PARTITION BY uid) AS cut FROM (
        SELECT a.*, (SELECT min(sqrt((a.z-b.z)*(a.z-b.z) + (a.y_-b.y_)*(a.y_-b.y_) + (a.x-b.x)*(a.x-b.x))) FROM (SELECT DISTINCT z, y_, x FROM fx_voxels WHERE NOT m) b) AS dist FROM {source} a WHERE m)))"""


@query("v09_region_masks", "uid:i z:i y_:i x:i region:s", f"SELECT * FROM {regions_sql()}", "fx_voxels")
def _(spark, sf):
    return vx.region_masks(vox(spark, sf))


PROXY = """concat(CASE WHEN x < 1.5 THEN 'right' ELSE 'left' END, '_', CASE WHEN y_ < 1.5 THEN 'caudate' WHEN y_ < 2.5 THEN 'putamen_anterior' ELSE 'putamen_posterior' END)"""


@query("v09_proxy_regions", "uid:i z:i y_:i x:i region:s", f"SELECT uid, z, y_, x, {PROXY} AS region FROM fx_voxels WHERE m", "fx_voxels")
def _(spark, sf):
    return vx.proxy_regions(vox(spark, sf))


SELF = """(SELECT *, CASE WHEN m AND v > 0 AND nn > 1e-8 THEN sqrt(d) * v / nn ELSE 0 END AS s FROM (SELECT *, sqrt(sum(CASE WHEN m AND v > 0 THEN v * v END) OVER (PARTITION BY uid)) AS nn,
  CAST(count(CASE WHEN m AND v > 0 THEN 1 END) OVER (PARTITION BY uid) AS DOUBLE) AS d FROM fx_voxels))"""
CHANNELS = f"""(SELECT uid, z, y_, x, c.channel, c.c FROM (SELECT *, [{{'channel': 'selfnorm', 'c': s}}, {{'channel': 'robust', 'c': (s - md) / greatest(q3 - q1, CAST(0.000001 AS DOUBLE))}}, {{'channel': 'rank', 'c': rk / n}}] AS cs FROM (
  SELECT *, median(s) OVER w AS md, quantile_cont(s, 0.25) OVER w AS q1, quantile_cont(s, 0.75) OVER w AS q3, count(*) OVER w AS n,
    rank() OVER (PARTITION BY uid ORDER BY s) + (count(*) OVER (PARTITION BY uid, s) - 1) / CAST(2 AS DOUBLE) AS rk FROM {SELF} WHERE m WINDOW w AS (PARTITION BY uid))), unnest(cs) AS t(c))"""


REGION_STATS = f"""SELECT uid, region, channel, count(*) AS n, avg(c) AS mean, stddev_pop(c) AS std, min(c) AS min, max(c) AS max,
        {', '.join(f'quantile_cont(c, {p / 100}) AS p{p:02d}' for p in vx.SUMMARY_PERCENTILES)}, median(abs(c - med)) AS mad, list_sum(list_sort(list(c * c))) / count(*) AS energy FROM (
        SELECT r.uid, r.region, k.channel, k.c, median(k.c) OVER (PARTITION BY r.uid, r.region, k.channel) AS med FROM {regions_sql()} r JOIN {CHANNELS} k ON k.uid = r.uid AND k.z = r.z AND k.y_ = r.y_ AND k.x = r.x) GROUP BY uid, region, channel"""


@query(
    "v10_region_stats",
    "uid:i region:s channel:s n:i mean:d std:d min:d max:d p01:d p05:d p10:d p25:d p50:d p75:d p90:d p95:d p99:d mad:d energy:d",
    REGION_STATS,
    "fx_voxels",
)
def _(spark, sf):
    return vx.region_stats(vox(spark, sf))


_PAIRS = {
    "caudate_lr": ("left_caudate", "right_caudate"), "putamen_lr": ("left_putamen", "right_putamen"), "right_cp": ("right_caudate", "right_putamen"),
    "left_cp": ("left_caudate", "left_putamen"), "hemisphere_lr": ('"left"', '"right"'), "anterior_posterior": ("anterior", "posterior"),
    "minmax_putamen": ("least(left_putamen, right_putamen)", "greatest(left_putamen, right_putamen)"),
    "minmax_caudate": ("least(left_caudate, right_caudate)", "greatest(left_caudate, right_caudate)"),
    "weak_caudate_putamen": ("least(left_caudate, right_caudate)", "least(left_putamen, right_putamen)"), "core_target": ("target_core", "target"),
}
_REGION_NAMES = ["target", "right", "left", "anterior", "posterior", *vx.QUADRANTS, "target_core"]
_MEANS = ", ".join(f"""coalesce(avg(CASE WHEN region = '{n}' THEN s END), 0) AS "{n}\"""" for n in _REGION_NAMES)


RELATIONS = f"""WITH r AS (SELECT uid, {_MEANS} FROM {regions_sql(SELF, 's')} GROUP BY uid), l AS ({' UNION ALL '.join(f"SELECT uid, '{n}' AS pair, {a} AS a, {b} AS b FROM r" for n, (a, b) in _PAIRS.items())})
        SELECT uid, pair, a - b AS difference, abs(a - b) AS absolute_difference, a / greatest(abs(b), CAST(1e-8 AS DOUBLE)) AS ratio, (a - b) / greatest(abs(a) + abs(b), CAST(1e-8 AS DOUBLE)) AS asymmetry FROM l"""


@query(
    "v11_region_relations",
    "uid:i pair:s difference:d absolute_difference:d ratio:d asymmetry:d",
    RELATIONS,
    "fx_voxels",
)
def _(spark, sf):
    return vx.region_relations(vox(spark, sf))


# Components by reachability inside a scan, region and threshold.
MORPHOLOGY = f"""WITH RECURSIVE q AS (SELECT uid, [quantile_cont(s, 0.7), quantile_cont(s, 0.8), quantile_cont(s, 0.9), quantile_cont(s, 0.95)] AS cuts FROM {SELF} WHERE m GROUP BY uid),
        l AS (SELECT r.*, p, s >= cuts[i] AS act FROM {regions_sql(SELF, 's')} r JOIN q ON q.uid = r.uid CROSS JOIN (VALUES (70, 1), (80, 2), (90, 3), (95, 4)) t(p, i)),
        a AS (SELECT *, z * 16 + y_ * 4 + x AS id FROM l WHERE act),
        e AS (SELECT a.uid, a.region, a.p, a.id AS s, b.id AS t FROM a JOIN a b ON b.uid = a.uid AND b.region = a.region AND b.p = a.p AND abs(a.z-b.z)+abs(a.y_-b.y_)+abs(a.x-b.x) = 1),
        reach AS (SELECT uid, region, p, id AS s, id AS t FROM a UNION SELECT r.uid, r.region, r.p, r.s, e.t FROM reach r JOIN e ON e.uid = r.uid AND e.region = r.region AND e.p = r.p AND e.s = r.t),
        k AS (SELECT uid, region, p, comp, count(*) AS n FROM (SELECT uid, region, p, s, min(t) AS comp FROM reach GROUP BY ALL) GROUP BY ALL),
        parts AS (SELECT uid, region, p, count(*) AS components, max(n) / CAST(sum(n) AS DOUBLE) AS largest_fraction FROM k GROUP BY ALL),
        sf AS (SELECT a.uid, a.region, a.p, sum(CASE WHEN coalesce(nb, 0) < 6 THEN 1 ELSE 0 END) AS sc FROM a LEFT JOIN (SELECT uid, region, p, s, count(*) AS nb FROM e GROUP BY ALL) n ON n.uid = a.uid AND n.region = a.region AND n.p = a.p AND n.s = a.id GROUP BY a.uid, a.region, a.p)
        SELECT g.*, coalesce(components, 0) AS components, coalesce(largest_fraction, 0) AS largest_fraction, coalesce(sc, 0) / CAST(support AS DOUBLE) AS surface_fraction FROM (
          SELECT uid, region, p, avg(CASE WHEN act THEN 1 ELSE 0 END) AS fraction, sum(CASE WHEN act THEN 1 ELSE 0 END) AS voxels, count(*) AS support,
          {', '.join(f'coalesce(max({c}) FILTER (act) - min({c}) FILTER (act) + 1, 0) AS extent_{c}' for c in vx.POS)},
          coalesce(sqrt({' + '.join(f'(avg({c}) FILTER (act) - avg({c})) * (avg({c}) FILTER (act) - avg({c}))' for c in vx.POS)}), 0) AS centroid_distance FROM l GROUP BY uid, region, p) g
        LEFT JOIN sf ON sf.uid = g.uid AND sf.region = g.region AND sf.p = g.p LEFT JOIN parts ON parts.uid = g.uid AND parts.region = g.region AND parts.p = g.p"""


@query(
    "v12_threshold_morphology",
    "uid:i region:s p:i fraction:d voxels:i extent_z:i extent_y_:i extent_x:i centroid_distance:d components:i largest_fraction:d surface_fraction:d",
    MORPHOLOGY,
    "fx_voxels",
)
def _(spark, sf):
    return vx.threshold_morphology(vox(spark, sf))


def _quant(levels, rounding):
    t = "greatest(least((v - lo) / greatest(hi - lo, CAST(1e-8 AS DOUBLE)), CAST(1 AS DOUBLE)), CAST(0 AS DOUBLE))"
    q = f"CAST(round_even({t} * {levels - 1}, 0) AS INT)" if rounding == "rint" else f"CAST(least(floor({t} * {levels}), {levels - 1}) AS INT)"
    return f"(SELECT uid, z, y_, x, {q} AS q FROM (SELECT *, quantile_cont(v, 0.01) OVER (PARTITION BY uid) AS lo, quantile_cont(v, 0.99) OVER (PARTITION BY uid) AS hi FROM fx_voxels WHERE m))"


def glcm_sql(levels, offsets, rounding):
    return f"""WITH q AS {_quant(levels, rounding)}, p AS (SELECT l.uid, l.q AS i, r.q AS j FROM q l CROSS JOIN {offsets_sql(offsets)} JOIN q r ON r.uid = l.uid AND r.z = l.z + o.dz AND r.y_ = l.y_ + o.dy AND r.x = l.x + o.dx),
      c AS (SELECT uid, i, j, CAST(count(*) AS DOUBLE) AS c FROM (SELECT uid, i, j FROM p UNION ALL SELECT uid, j, i FROM p) GROUP BY uid, i, j),
      t AS (SELECT *, c / sum(c) OVER (PARTITION BY uid) AS pr FROM c), mu AS (SELECT uid, sum(pr * i) AS m FROM t GROUP BY uid)
      SELECT t.uid, sum(pr * (i-j)*(i-j)) AS contrast, sum(pr * abs(i-j)) AS dissimilarity, sum(pr / (1 + (i-j)*(i-j))) AS homogeneity, sqrt(sum(pr * pr)) AS energy, -sum(pr * log2(pr)) AS entropy,
        sum(pr * (i - m) * (j - m)) / greatest(sum(pr * (i - m) * (i - m)), CAST(1e-8 AS DOUBLE)) AS correlation FROM t JOIN mu ON mu.uid = t.uid GROUP BY t.uid"""


_TEX = "uid:i contrast:d dissimilarity:d homogeneity:d energy:d entropy:d correlation:d"


@query("v13_glcm", _TEX, glcm_sql(32, vx.OFFSETS_13, "rint"), "fx_voxels")
def _(spark, sf):
    return vx.glcm(vox(spark, sf))


@query("v13_glcm_axes", _TEX, glcm_sql(12, vx.AXES_3, "floor"), "fx_voxels")
def _(spark, sf):
    return vx.glcm(vox(spark, sf), 12, vx.AXES_3, "floor", 8)


def region_glcm_sql(levels):
    """Texture of each quadrant with grey levels of its own; zero below eight voxels, for a constant region and without pairs."""
    t = "greatest(least((v - lo) / greatest(hi - lo, CAST(0.000001 AS DOUBLE)), CAST(1 AS DOUBLE)), CAST(0 AS DOUBLE))"
    names = ("contrast", "dissimilarity", "homogeneity", "energy", "entropy", "correlation")
    return f"""(WITH w AS (SELECT *, quantile_cont(v, 0.01) OVER g AS lo, quantile_cont(v, 0.99) OVER g AS hi, count(*) OVER g AS n, max(v) OVER g > min(v) OVER g AS varies
        FROM (SELECT uid, region, z, y_, x, s AS v FROM {regions_sql(SELF, 's')} WHERE region IN ('right_caudate', 'right_putamen', 'left_caudate', 'left_putamen')) WINDOW g AS (PARTITION BY uid, region)),
      q AS (SELECT w.*, levels, CAST(least(floor({t} * levels), levels - 1) AS INT) AS q FROM w CROSS JOIN (SELECT unnest({list(levels)}) AS levels) WHERE n >= 8 AND varies),
      p AS (SELECT l.uid, l.region, l.levels, l.q AS i, r.q AS j FROM q l CROSS JOIN {offsets_sql(vx.AXES_3)} JOIN q r ON r.uid = l.uid AND r.region = l.region AND r.levels = l.levels AND r.z = l.z + o.dz AND r.y_ = l.y_ + o.dy AND r.x = l.x + o.dx),
      c AS (SELECT uid, region, levels, i, j, CAST(count(*) AS DOUBLE) AS c FROM (SELECT * FROM p UNION ALL SELECT uid, region, levels, j, i FROM p) GROUP BY ALL),
      t AS (SELECT *, c / sum(c) OVER (PARTITION BY uid, region, levels) AS pr FROM c), mu AS (SELECT uid, region, levels, sum(pr * i) AS m FROM t GROUP BY ALL),
      f AS (SELECT t.uid, t.region, t.levels, sum(pr * (i-j)*(i-j)) AS contrast, sum(pr * abs(i-j)) AS dissimilarity, sum(pr / (1 + (i-j)*(i-j))) AS homogeneity, sqrt(sum(pr * pr)) AS energy, -sum(pr * log2(pr)) AS entropy,
        sum(pr * (i - m) * (j - m)) / greatest(sum(pr * (i - m) * (i - m)), CAST(1e-8 AS DOUBLE)) AS correlation FROM t JOIN mu ON mu.uid = t.uid AND mu.region = t.region AND mu.levels = t.levels GROUP BY t.uid, t.region, t.levels)
      SELECT a.uid, a.region, a.levels, {', '.join(f'coalesce({m}, 0) AS {m}' for m in names)} FROM (SELECT DISTINCT uid, region, levels FROM w CROSS JOIN (SELECT unnest({list(levels)}) AS levels)) a
      LEFT JOIN f ON f.uid = a.uid AND f.region = a.region AND f.levels = a.levels)"""


@query("v13_glcm_regions", "uid:i region:s levels:i" + _TEX.removeprefix("uid:i"), f"SELECT * FROM {region_glcm_sql((8, 16))}", "fx_voxels")
def _(spark, sf):
    regions = vx.region_masks(vx.self_normalize(vox(spark, sf)), core=False).where(C("region").isin(*vx.QUADRANTS))
    cells = regions.select("uid", *vx.POS, "region", C("s").alias("v"), F.lit(True).alias("m"))
    return vx.glcm(cells, (8, 16), vx.AXES_3, "floor", 8, ["region"], eps=1e-6, empty=0.0)


def _unpivoted(source, prefix, names):
    rows = ", ".join(f"{{'name': '{n}', 'value': CAST(\"{c}\" AS DOUBLE)}}" for n, c in names)
    return f"SELECT uid, concat({prefix}, '_', e.name) AS feature, e.value FROM (SELECT *, unnest([{rows}]) AS e FROM ({source}))"


_BANK_SQL = " UNION ALL ".join(
    [
        _unpivoted(REGION_STATS, "'intensity_', region, '_', channel", [(n, n) for n in bank.STATS]),
        _unpivoted(MORPHOLOGY, "'morph_', region, '_p', CAST(p AS VARCHAR)", [(n, "extent_y_" if n == "extent_y" else n) for n in bank.SHAPES]),
        _unpivoted(f"SELECT * FROM {region_glcm_sql(bank.LEVELS)}", "'texture_', region, '_l', lpad(CAST(levels AS VARCHAR), 2, '0')", [(n, n) for n in vx.TEXTURE_METRICS]),
        _unpivoted(RELATIONS, "'relation_', pair", [(n, n) for n in bank.CONTRASTS]),
    ]
)


@query(
    "v38_regional_bank",
    "uid:i feature:s value:d",
    f"""WITH b AS ({_BANK_SQL}), n AS (SELECT unnest({bank.bank_names()!r}) AS feature), u AS (SELECT DISTINCT uid FROM fx_voxels WHERE m)
        SELECT u.uid, n.feature, coalesce(b.value, 0) AS value FROM u CROSS JOIN n LEFT JOIN b ON b.uid = u.uid AND b.feature = n.feature""",
    "fx_voxels",
)
def _(spark, sf):
    return bank.bank_long(bank.regional_bank(vox(spark, sf)))


_COV = {"zz": ("z", "z"), "yy": ("y_", "y_"), "xx": ("x", "x"), "zy": ("z", "y_"), "zx": ("z", "x"), "yx": ("y_", "x")}
_H = dict(zip(vx.POS, SPACING))


@query(
    "v14_shape_features",
    "uid:i n:i volume_mm3:d surface_mm2:d sphericity:d extent:d elongation:d4",
    f"""WITH p AS (SELECT uid, quantile_cont(v, 0.7) AS cut FROM fx_voxels GROUP BY uid), a AS (SELECT f.uid, z, y_, x FROM fx_voxels f JOIN p ON p.uid = f.uid WHERE v >= cut),
        f AS (SELECT l.uid, sum(CASE WHEN l.z <> r.z THEN 6.0 WHEN l.y_ <> r.y_ THEN 7.5 ELSE 5.0 END) AS inner_faces FROM a l JOIN a r ON l.uid = r.uid AND abs(l.z-r.z)+abs(l.y_-r.y_)+abs(l.x-r.x) = 1 GROUP BY l.uid),
        g AS (SELECT uid, count(*) AS n, count(*) / CAST((max(z)-min(z)+1)*(max(y_)-min(y_)+1)*(max(x)-min(x)+1) AS DOUBLE) AS extent, {', '.join(f'covar_samp({a} * {_H[a]}, {b} * {_H[b]}) AS {k}' for k, (a, b) in _COV.items())} FROM a GROUP BY uid),
        e AS (SELECT *, (zz+yy+xx)/3 AS q FROM g), h AS (SELECT *, sqrt(((zz-q)*(zz-q)+(yy-q)*(yy-q)+(xx-q)*(xx-q)+2*(zy*zy+zx*zx+yx*yx))/6) AS pp FROM e),
        k AS (SELECT *, acos(greatest(least(((zz-q)*((yy-q)*(xx-q)-yx*yx) - zy*(zy*(xx-q)-yx*zx) + zx*(zy*yx-(yy-q)*zx)) / (2*pp*pp*pp), CAST(1 AS DOUBLE)), CAST(-1 AS DOUBLE)))/3 AS ph FROM h)
        SELECT k.uid, n, n * 15.0 AS volume_mm3, n * 2 * (6.0 + 7.5 + 5.0) - coalesce(inner_faces, 0) AS surface_mm2,
          pow(pi(), CAST(1 AS DOUBLE) / 3) * pow(6 * n * CAST(15 AS DOUBLE), CAST(2 AS DOUBLE) / 3) / (n * 2 * (6.0 + 7.5 + 5.0) - coalesce(inner_faces, 0)) AS sphericity, extent,
          sqrt(greatest(q + 2*pp*cos(ph), CAST(1e-8 AS DOUBLE)) / greatest(q + 2*pp*cos(ph + 2*pi()/3), CAST(1e-8 AS DOUBLE))) AS elongation FROM k LEFT JOIN f ON f.uid = k.uid""",
    "fx_voxels",
)
def _(spark, sf):
    v = vx.by_scan(vox(spark, sf)).withColumn("cut", vx.pct(C("v"), 70).over(vx.whole()))
    return vx.shape_features(v.where(C("v") >= C("cut")), SPACING)


@query("v15_self_normalize", "uid:i z:i y_:i x:i s:d", f"SELECT uid, z, y_, x, s FROM {SELF}", "fx_voxels")
def _(spark, sf):
    return vx.self_normalize(vox(spark, sf))


@query(
    "v16_canonical_flip",
    "uid:i z:i y_:i x:i v:d flipped:b affected:s",
    """SELECT uid, z, y_, CASE WHEN r > l THEN 3 - x ELSE x END AS x, v, r > l AS flipped, CASE WHEN r > l THEN 'left' ELSE 'right' END AS affected FROM (
       SELECT *, avg(CASE WHEN m AND y_ >= 1.5 AND x < 1.5 THEN v END) OVER (PARTITION BY uid) AS r, avg(CASE WHEN m AND y_ >= 1.5 AND x >= 1.5 THEN v END) OVER (PARTITION BY uid) AS l FROM fx_voxels)""",
    "fx_voxels",
)
def _(spark, sf):
    return vx.canonical_flip(vox(spark, sf))


_KERNEL = ", ".join(f"({k}, CAST({w!r} AS DOUBLE))" for k, w in vx.gaussian_kernel())


@query(
    "v17_axial_slab",
    "uid:i y_:i x:i v:d",
    f"""WITH c AS (SELECT uid, z, sum(CASE WHEN m AND v > 0 THEN 1 ELSE 0 END) AS c FROM fx_voxels GROUP BY uid, z), s AS (SELECT a.uid, a.z, round(sum(k.w * b.c), 9) AS p FROM c a CROSS JOIN (VALUES {_KERNEL}) k(k, w)
          JOIN c b ON b.uid = a.uid AND b.z = CASE WHEN (a.z + k.k + 8) % 8 >= 4 THEN 7 - (a.z + k.k + 8) % 8 ELSE (a.z + k.k + 8) % 8 END GROUP BY a.uid, a.z),
        m AS (SELECT uid, z AS center FROM (SELECT *, row_number() OVER (PARTITION BY uid ORDER BY p DESC, z) AS rn FROM s) WHERE rn = 1)
        SELECT f.uid, f.y_, f.x, avg(f.v) AS v FROM m CROSS JOIN (VALUES (0), (1), (2)) i(i) JOIN fx_voxels f ON f.uid = m.uid AND f.z = greatest(least(center - 1 + i, 3), 0) GROUP BY f.uid, f.y_, f.x""",
    "fx_voxels",
)
def _(spark, sf):
    v = vox(spark, sf).withColumn("m", C("m") & (C("v") > 0))
    return vx.axial_slab(v, 3)


_RAD = (5.0, 4.5, 5.5)


def _ell(cz, cy, cx):
    return f"((z-{cz})/{_RAD[0] / 2})*((z-{cz})/{_RAD[0] / 2}) + ((y_-{cy})/{_RAD[1] / 2})*((y_-{cy})/{_RAD[1] / 2}) + ((x-{cx})/{_RAD[2] / 2})*((x-{cx})/{_RAD[2] / 2}) <= 1"


def _center(c):
    return f"1.5 + coalesce(greatest(least(sum(w * {c}) OVER (PARTITION BY uid) / sum(w) OVER (PARTITION BY uid) - 1.5, CAST(0.5 AS DOUBLE)), CAST(-0.5 AS DOUBLE)), 0) AS c{c}"


@query(
    "v31_physical_roi",
    "uid:i z:i y_:i x:i roi:b",
    f"""SELECT uid, z, y_, x, {_ell('cz', 'cy_', 'cx')} AS roi FROM (SELECT *, {', '.join(_center(c) for c in vx.POS)} FROM (SELECT *, CASE WHEN ins AND v >= cut THEN v END AS w FROM (
        SELECT *, quantile_cont(CASE WHEN ins THEN v END, 0.85) OVER (PARTITION BY uid) AS cut FROM (SELECT *, {_ell('CAST(1.5 AS DOUBLE)', 'CAST(1.5 AS DOUBLE)', 'CAST(1.5 AS DOUBLE)')} AND v > 0 AS ins FROM fx_voxels))))""",
    "fx_voxels",
)
def _(spark, sf):
    return vx.physical_roi(vox(spark, sf), 2.0, _RAD, 85.0, 1.0)


@query(
    "v26_triplanar",
    "uid:i plane:s slice:i row:i col:i v:d",
    """SELECT uid, 'axial' AS plane, z - 1 AS slice, y_ AS row, x AS col, v FROM fx_voxels WHERE z BETWEEN 1 AND 3 UNION ALL SELECT uid, 'coronal', y_ - 1, z, x, v FROM fx_voxels WHERE y_ BETWEEN 1 AND 3
       UNION ALL SELECT uid, 'sagittal', x - 1, z, y_, v FROM fx_voxels WHERE x BETWEEN 1 AND 3""",
    "fx_voxels",
)
def _(spark, sf):
    return vx.triplanar(vox(spark, sf), 3)


@query(
    "v27_downsample",
    "uid:i z:i y_:i x:i v:d",
    "SELECT uid, z // 2 AS z, y_ // 2 AS y_, x // 2 AS x, v FROM fx_voxels WHERE z % 2 = 0 AND y_ % 2 = 0 AND x % 2 = 0",
    "fx_voxels",
)
def _(spark, sf):
    return vx.downsample(vox(spark, sf), 3)


@query(
    "v36_crop_box",
    "uid:i z:i y_:i x:i v:d start_z:i start_y_:i start_x:i",
    """SELECT uid, z, y_, x, v, sz AS start_z, sy AS start_y_, sx AS start_x FROM (SELECT *, greatest(min(CASE WHEN t THEN z END) OVER w - 1, 0) AS sz, least(max(CASE WHEN t THEN z END) OVER w + 2, 4) AS ez,
       greatest(min(CASE WHEN t THEN y_ END) OVER w - 2, 0) AS sy, least(max(CASE WHEN t THEN y_ END) OVER w + 3, 4) AS ey, greatest(min(CASE WHEN t THEN x END) OVER w - 1, 0) AS sx, least(max(CASE WHEN t THEN x END) OVER w + 2, 4) AS ex
       FROM (SELECT *, m AND v > 0.25 AS t FROM fx_voxels) WINDOW w AS (PARTITION BY uid)) WHERE z >= sz AND z < ez AND y_ >= sy AND y_ < ey AND x >= sx AND x < ex""",
    "fx_voxels",
)
def _(spark, sf):
    return vx.crop_box(vox(spark, sf).withColumn("m", C("m") & (C("v") > 0.25)), 2.5, SPACING)


def _grid_axis(c, n, h):
    return f"1.5 + (g{c} - ({n} - 1) / CAST(2 AS DOUBLE)) * CAST(2.2 / {h} AS DOUBLE) AS p{c}"


_OUT = (5, 4, 6)
_GRID = f"""(SELECT u.uid, gz, gy, gx, {', '.join(_grid_axis(c, n, h) for c, n, h in zip(('z', 'y', 'x'), _OUT, SPACING))} FROM (SELECT DISTINCT uid FROM fx_voxels) u
  CROSS JOIN (SELECT unnest(range({_OUT[0]})) AS gz) CROSS JOIN (SELECT unnest(range({_OUT[1]})) AS gy) CROSS JOIN (SELECT unnest(range({_OUT[2]})) AS gx))"""
_IN = " AND ".join(f"p{c} >= 0 AND p{c} <= 3" for c in "zyx")


@query(
    "v23_resample_grid",
    "uid:i z:i y_:i x:i v:d",
    f"""SELECT g.uid, gz AS z, gy AS y_, gx AS x, coalesce(sum(CASE WHEN {_IN} THEN greatest(1 - abs(pz - f.z), 0) * greatest(1 - abs(py - f.y_), 0) * greatest(1 - abs(px - f.x), 0) * v END), 0) AS v
        FROM {_GRID} g LEFT JOIN fx_voxels f ON f.uid = g.uid AND abs(pz - f.z) < 1 AND abs(py - f.y_) < 1 AND abs(px - f.x) < 1 GROUP BY g.uid, gz, gy, gx""",
    "fx_voxels",
)
def _(spark, sf):
    return vx.resample_grid(vox(spark, sf), _OUT, SPACING, 2.2)


@query(
    "v23_resample_nearest",
    "uid:i z:i y_:i x:i v:d",
    f"""SELECT g.uid, gz AS z, gy AS y_, gx AS x, coalesce(CASE WHEN {_IN} THEN v END, 0) AS v
        FROM {_GRID} g LEFT JOIN fx_voxels f ON f.uid = g.uid AND floor(pz + 0.5) = f.z AND floor(py + 0.5) = f.y_ AND floor(px + 0.5) = f.x""",
    "fx_voxels",
)
def _(spark, sf):
    return vx.resample_grid(vox(spark, sf), _OUT, SPACING, 2.2, order=0)
