"""Background, uptake, template, graph, feature-row and explanation-map queries on voxel tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from cohortloom.operators import atlas as at
from cohortloom.operators import voxel as vx
from cohortloom.plans import fixtures as fx
from cohortloom.plans.voxel_queries import PROXY, ROBUST, SELF, SPACING, _HIST, vox
from cohortloom.registry import query

C = F.col
MASKED = """(SELECT *, (z-1.5)*(z-1.5) + (y_-1.5)*(y_-1.5) + (x-1.5)*(x-1.5) <= 4.9 AS brain, y_ = 3 AND z IN (1, 2) AS background FROM fx_voxels)"""


def masked(spark, sf):
    """Voxels with a brain and a small nominal background mask; the target is the central 2 x 2 x 2 block."""
    dist = sum(((C(c) - 1.5) * (C(c) - 1.5) for c in vx.POS), F.lit(0.0))
    v = vox(spark, sf).withColumn("brain", dist <= 4.9).withColumn("background", (C("y_") == 3) & C("z").isin(1, 2))
    return v.withColumn("m", dist <= 1.0)


# the central block (distance 0.75 from the centre in squared voxels) is the target; near = city-block distance to it
_NEAR = "greatest(1 - z, z - 2, 0) + greatest(1 - y_, y_ - 2, 0) + greatest(1 - x, x - 2, 0)"
BG = f"""WITH a AS (SELECT uid, z, y_, x, v, (z-1.5)*(z-1.5)+(y_-1.5)*(y_-1.5)+(x-1.5)*(x-1.5) <= 1.0 AS m, brain, background, {_NEAR} <= 1 AS near FROM {MASKED}),
  b AS (SELECT *, brain AND v > 0 AS f1, (((z-1.5)/1.68)*((z-1.5)/1.68)+((y_-1.5)/1.68)*((y_-1.5)/1.68)+((x-1.5)/1.68)*((x-1.5)/1.68) <= 1) AND v > 0 AS f2, v > 0 AS f3 FROM a),
  c AS (SELECT *, sum(CAST(f1 AS INT)) OVER w AS n1, sum(CAST(f2 AS INT)) OVER w AS n2 FROM b WINDOW w AS (PARTITION BY uid)),
  d AS (SELECT *, CASE WHEN n1 >= 4 THEN f1 WHEN n2 >= 4 THEN f2 ELSE f3 END AS fore, background AND v > 0 AS nominal FROM c),
  e AS (SELECT *, quantile_cont(CASE WHEN fore THEN v END, 0.5) OVER w AS p50, quantile_cont(CASE WHEN fore THEN v END, 0.9) OVER w AS p90, quantile_cont(CASE WHEN fore THEN v END, 0.99) OVER w AS p99,
     sum(CAST(nominal AS INT)) OVER w AS nn, sum(CAST(background AS INT)) OVER w AS nb, fore AND NOT near AS far FROM d WINDOW w AS (PARTITION BY uid)),
  f AS (SELECT *, quantile_cont(CASE WHEN far THEN v END, 0.7) OVER (PARTITION BY uid) AS far70, nn >= 4 AND nn / CAST(greatest(nb, 1) AS DOUBLE) >= 0.2 AS enough FROM e),
  g AS (SELECT *, CASE WHEN enough THEN nominal ELSE far AND v <= far70 END AS cand FROM f), h AS (SELECT *, sum(CAST(cand AND v > 0 AS INT)) OVER (PARTITION BY uid) AS nc FROM g),
  i AS (SELECT *, CASE WHEN nc >= 4 THEN cand AND v > 0 ELSE fore AND v <= p50 END AS used, CASE WHEN nc < 4 THEN 'foreground_lower_half_fallback' WHEN enough THEN 'consensus_brain_background' ELSE 'scan_brain_fallback' END AS source FROM h),
  j AS (SELECT *, used AND v >= quantile_cont(CASE WHEN used THEN v END, 0.05) OVER (PARTITION BY uid) AND v <= quantile_cont(CASE WHEN used THEN v END, 0.95) OVER (PARTITION BY uid) AS trim FROM i),
  k AS (SELECT *, CASE WHEN sum(CAST(trim AS INT)) OVER (PARTITION BY uid) >= 3 THEN trim ELSE used END AS kept FROM j),
  bg AS (SELECT *, greatest(coalesce(mean_raw, 0), scale_floor) AS scale, mean_raw < scale_floor AS floor_applied, enough AND source = 'consensus_brain_background' AND NOT mean_raw < scale_floor AS qc_valid FROM (
     SELECT uid, any_value(source) AS source, sum(CAST(used AS INT)) AS support_voxels, any_value(nn / CAST(greatest(nb, 1) AS DOUBLE)) AS support_fraction, avg(v) FILTER (kept) AS mean_raw, coalesce(stddev_samp(v) FILTER (kept), 0) AS std_raw,
       greatest(CAST(1e-8 AS DOUBLE), 0.05 * any_value(p90)) AS scale_floor, any_value(enough) AS enough, any_value(p50) AS p50, any_value(p99) AS p99 FROM k GROUP BY uid))"""


def background(spark, sf):
    return at.background_stats(masked(spark, sf), min_voxels=4, min_support=0.2, exclusion=1, min_trim=3)


@query(
    "v18_background_stats",
    "uid:i source:s support_voxels:i support_fraction:d mean_raw:d std_raw:d scale_floor:d scale:d floor_applied:b qc_valid:b p50:d p99:d",
    f"{BG} SELECT * FROM bg",
    "fx_voxels",
)
def _(spark, sf):
    return background(spark, sf)


def _sbr(c):
    return f"(({c}) - scale) / CASE WHEN scale > 1e-8 THEN scale END"


@query(
    "v19_uptake_ratio",
    "uid:i sbr:d right_sbr:d left_sbr:d min_side_sbr:d asymmetry_abs:d asymmetry_signed:d posterior_anterior:d log_target:d ratio_mean:d ratio_std:d ratio_p10:d ratio_p50:d ratio_p90:d",
    f"""{BG}, t AS (SELECT a.uid, any_value(scale) AS scale, avg(v) AS t, avg(v) FILTER (x < 2) AS r, avg(v) FILTER (x >= 2) AS l, avg(v) FILTER (y_ < 2) AS an, avg(v) FILTER (y_ >= 2) AS po, avg(v / scale) AS ratio_mean, stddev_samp(v / scale) AS ratio_std,
        quantile_cont(v / scale, 0.1) AS ratio_p10, quantile_cont(v / scale, 0.5) AS ratio_p50, quantile_cont(v / scale, 0.9) AS ratio_p90 FROM a JOIN bg ON bg.uid = a.uid WHERE a.m GROUP BY a.uid)
        SELECT *, {_sbr('t')} AS sbr, {_sbr('r')} AS right_sbr, {_sbr('l')} AS left_sbr, least({_sbr('r')}, {_sbr('l')}) AS min_side_sbr, abs(l - r) / greatest((l + r) / 2, CAST(1e-8 AS DOUBLE)) AS asymmetry_abs,
          (l - r) / greatest((l + r) / 2, CAST(1e-8 AS DOUBLE)) AS asymmetry_signed, po / greatest(an, CAST(1e-8 AS DOUBLE)) AS posterior_anterior, ln(1 + greatest(t, 0) / scale) AS log_target FROM t""",
    "fx_voxels",
)
def _(spark, sf):
    return at.uptake_ratio(masked(spark, sf), background(spark, sf))


_SHIFTED = " UNION ALL ".join(
    f"SELECT f.uid, {i} AS k, avg(f.v) AS a FROM a m JOIN a f ON f.uid = m.uid AND f.z = m.z + {dz} AND f.y_ = m.y_ + {dy} AND f.x = m.x + {dx} WHERE m.m GROUP BY f.uid"
    for i, (dz, dy, dx) in enumerate(vx.SHIFTS)
)


@query(
    "v20_mask_sensitivity",
    "uid:i threshold_span:d mask_span:d translation_span:d",
    f"""{BG}, q AS (SELECT uid, quantile_cont(v, 0.7) AS c0, quantile_cont(v, 0.8) AS c1, quantile_cont(v, 0.9) AS c2 FROM a WHERE m GROUP BY uid),
        g2 AS (SELECT a.uid, avg(v) FILTER (m AND v >= c0) AS t0, avg(v) FILTER (m AND v >= c1) AS t1, avg(v) FILTER (m AND v >= c2) AS t2, avg(v) FILTER (m) AS s1, avg(v) FILTER (near) AS s2 FROM a JOIN q ON q.uid = a.uid GROUP BY a.uid),
        sh AS ({_SHIFTED}), sp AS (SELECT sh.uid, max({_sbr('a')}) - min({_sbr('a')}) AS translation_span FROM sh JOIN bg ON bg.uid = sh.uid GROUP BY sh.uid)
        SELECT g2.uid, greatest({_sbr('t0')}, {_sbr('t1')}, {_sbr('t2')}) - least({_sbr('t0')}, {_sbr('t1')}, {_sbr('t2')}) AS threshold_span, greatest({_sbr('s1')}, {_sbr('s2')}) - least({_sbr('s1')}, {_sbr('s2')}) AS mask_span, translation_span
        FROM g2 JOIN bg ON bg.uid = g2.uid JOIN sp ON sp.uid = g2.uid""",
    "fx_voxels",
)
def _(spark, sf):
    return at.mask_sensitivity(masked(spark, sf), background(spark, sf))


_TEMPLATE = "(SELECT grp, z, y_, x, avg(v) AS mean, median(v) AS median, avg(CASE WHEN k THEN 1 ELSE 0 END) >= 0.5 AS mask, count(*) AS n FROM (SELECT *, m AND v > 0 AS k FROM fx_voxels) GROUP BY grp, z, y_, x)"


def grouped(spark, sf):
    return fx.voxels(spark, sf).select("uid", "grp", "z", "y_", "x", "v", "m")


def templates(spark, sf):
    return at.template_volume(grouped(spark, sf).withColumn("m", C("m") & (C("v") > 0)), ["grp"])


@query("a31_template_volume", "grp:i z:i y_:i x:i mean:d median:d mask:b n:i", f"SELECT * FROM {_TEMPLATE}", "fx_voxels")
def _(spark, sf):
    return templates(spark, sf)


_CORR = "CASE WHEN count(*) >= 10 AND stddev_pop({a}) > 1e-12 AND stddev_pop({b}) > 1e-12 THEN corr({a}, {b}) END"


@query(
    "v21_volume_correlation",
    "uid:i corr:d",
    f"SELECT f.uid, {_CORR.format(a='f.v', b='t.mean')} AS corr FROM fx_voxels f JOIN {_TEMPLATE} t ON t.grp = f.grp AND t.z = f.z AND t.y_ = f.y_ AND t.x = f.x WHERE f.v > 0 OR t.mean > 0 GROUP BY f.uid",
    "fx_voxels",
)
def _(spark, sf):
    g = grouped(spark, sf)
    t = templates(spark, sf).select("grp", "z", "y_", "x", C("mean").alias("v"))
    tv = g.select("uid", "grp").distinct().join(t, "grp").drop("grp")
    return at.volume_correlation(g.select("uid", *vx.POS, "v"), tv, ["uid", *vx.POS], ["uid"])


_MOVES = ((0, 0, 0), (0, 0, 1), (0, 0, -1), (0, 1, 0), (0, -1, 0), (1, 0, 0), (-1, 0, 0))


@query(
    "v22_shift_search",
    "uid:i dz:i dy:i dx:i before:d after:d gain:d",
    f"""WITH t AS {_TEMPLATE}, j AS (SELECT g.uid, o.dz, o.dy, o.dx, coalesce(s.v, 0) AS a, t.mean AS b FROM fx_voxels g CROSS JOIN (VALUES {', '.join(map(str, _MOVES))}) o(dz, dy, dx)
          LEFT JOIN fx_voxels s ON s.uid = g.uid AND s.z = g.z - o.dz AND s.y_ = g.y_ - o.dy AND s.x = g.x - o.dx JOIN t ON t.grp = g.grp AND t.z = g.z AND t.y_ = g.y_ AND t.x = g.x),
        c AS (SELECT uid, dz, dy, dx, {_CORR.format(a='a', b='b')} AS c FROM j WHERE a > 0 OR b > 0 GROUP BY uid, dz, dy, dx),
        r AS (SELECT *, row_number() OVER (PARTITION BY uid ORDER BY round(c, 12) DESC, abs(dz) + abs(dy) + abs(dx), dz, dy, dx) AS rn, max(CASE WHEN dz = 0 AND dy = 0 AND dx = 0 THEN c END) OVER (PARTITION BY uid) AS before FROM c WHERE c IS NOT NULL)
        SELECT uid, dz, dy, dx, before, c AS after, c - before AS gain FROM r WHERE rn = 1""",
    "fx_voxels",
)
def _(spark, sf):
    t = templates(spark, sf).select("grp", *vx.POS, C("mean").alias("t"))
    return at.shift_search(grouped(spark, sf), t, _MOVES, ["grp"])


_PUT = """(SELECT uid, coalesce(avg(v) FILTER (x < 1.5), 0) AS r, coalesce(avg(v) FILTER (x >= 1.5), 0) AS l FROM fx_voxels WHERE m AND y_ >= 1.5 GROUP BY uid)"""


@query(
    "v24_template_groups",
    "template:s rank:i uid:i",
    f"""WITH s AS (SELECT uid, least(r, l) AS lo, greatest(r, l) AS hi, l - r AS signed FROM {_PUT}), q AS (SELECT quantile_cont(lo, 0.25) AS q1, quantile_cont(lo, 0.75) AS q3 FROM s),
        a AS (SELECT 'normal_like' AS template, uid, -lo AS score FROM s, q WHERE lo >= q3 UNION ALL SELECT 'bilateral_strong', uid, hi FROM s, q WHERE hi <= q1 UNION ALL SELECT 'left_reduced', uid, -signed FROM s UNION ALL SELECT 'right_reduced', uid, signed FROM s)
        SELECT template, rank, uid FROM (SELECT *, row_number() OVER (PARTITION BY template ORDER BY score, uid) AS rank FROM a) WHERE rank <= 12""",
    "fx_voxels",
)
def _(spark, sf):
    return at.template_groups(vox(spark, sf), 12)


@query(
    "v25_template_weights",
    "uid:i template:i weight:d",
    f"""WITH c AS (SELECT f.uid, t.grp AS template, corr(f.v, t.mean) AS c FROM fx_voxels f JOIN {_TEMPLATE} t ON t.z = f.z AND t.y_ = f.y_ AND t.x = f.x GROUP BY f.uid, t.grp)
        SELECT uid, template, exp(c / CAST(0.12 AS DOUBLE)) / sum(exp(c / CAST(0.12 AS DOUBLE))) OVER (PARTITION BY uid) AS weight FROM c""",
    "fx_voxels",
)
def _(spark, sf):
    t = templates(spark, sf).select(C("grp").alias("template"), *vx.POS, C("mean").alias("t"))
    c = vox(spark, sf).join(t, vx.POS).groupBy("uid", "template").agg(F.corr("v", "t").alias("corr"))
    return at.template_weights(c)


@query(
    "v28_volume_audit",
    "uid:i finite:b shape_valid:b positive:i norm_error:d laterality_valid:b passed:b",
    f"""SELECT *, finite AND shape_valid AND coalesce(norm_error <= 0.005, false) AND laterality_valid AS passed FROM (SELECT uid, count(s2) = count(*) AS finite, max(z) = 3 AND max(y_) = 3 AND max(x) = 3 AND count(*) = 64 AS shape_valid,
        count(*) FILTER (m AND s2 > 0) AS positive, abs(sqrt(sum(s2 * s2) FILTER (m AND s2 > 0)) / sqrt(nullif(count(*) FILTER (m AND s2 > 0), 0)) - 1) AS norm_error,
        coalesce(avg(s2) FILTER (m AND y_ >= 1.5 AND x < CASE WHEN uid % 10 = 2 THEN 1 ELSE 1.5 END), 0) <= coalesce(avg(s2) FILTER (m AND y_ >= 1.5 AND x >= CASE WHEN uid % 10 = 2 THEN 1 ELSE 1.5 END), 0) + 0.00001 AS laterality_valid
        FROM (SELECT *, CASE WHEN uid % 10 = 0 THEN s * 1.01 WHEN uid % 10 = 1 AND z = 0 AND y_ = 0 THEN NULL ELSE s END AS s2 FROM {SELF} WHERE uid % 10 <> 2 OR x < 3) GROUP BY uid)""",
    "fx_voxels",
)
def _(spark, sf):
    s = vx.self_normalize(vox(spark, sf))
    damaged = F.when(C("uid") % 10 == 0, C("s") * 1.01).when(~((C("uid") % 10 == 1) & (C("z") == 0) & (C("y_") == 0)), C("s"))
    s = s.withColumn("s", damaged).where((C("uid") % 10 != 2) | (C("x") < 3))
    return at.volume_audit(s, (4, 4, 4))


def _eight(c, p):
    q = ", ".join(f"coalesce(quantile_cont({c}, {x / 100}), 0) AS {p}_p{x}" for x in (10, 50, 90))
    return f"coalesce(avg({c}), 0) AS {p}_mean, coalesce(stddev_pop({c}), 0) AS {p}_std, {q}, coalesce(max({c}), 0) AS {p}_max, coalesce(avg({c} * {c}), 0) AS {p}_energy, coalesce(median(abs({c} - md_{c})), 0) AS {p}_mad"


_NODE = f"""(WITH r AS (SELECT *, {PROXY} AS region, z // 2 AS band, quantile_cont(v, 0.85) OVER (PARTITION BY uid) AS hot FROM {SELF} WHERE m), k AS (SELECT *, median(v) OVER w AS md_v, median(s) OVER w AS md_s FROM r WINDOW w AS (PARTITION BY uid, region, band)),
  g AS (SELECT uid, region, band, {_eight('v', 'raw')}, {_eight('s', 'norm')}, coalesce(avg(z) FILTER (v > 0) / 3, 0) AS center_z, coalesce(avg(y_) FILTER (v > 0) / 3, 0) AS center_y_, coalesce(avg(x) FILTER (v > 0) / 3, 0) AS center_x,
    avg(CASE WHEN v > 0 THEN 1 ELSE 0 END) AS occupancy, avg(CASE WHEN v >= hot THEN 1 ELSE 0 END) AS high_fraction FROM k GROUP BY uid, region, band),
  f AS (SELECT uid, n.region, b.band, n.i * 2 + b.band AS node FROM (SELECT DISTINCT uid FROM fx_voxels) CROSS JOIN (VALUES {', '.join(f"('{n}', {i})" for i, n in enumerate(vx.PROXIES))}) n(region, i) CROSS JOIN (VALUES (0), (1)) b(band))
  SELECT f.uid, f.node, f.region, f.band, {{cols}} FROM f LEFT JOIN g ON g.uid = f.uid AND g.region = f.region AND g.band = f.band)"""
_NODE_COLS = [f"{p}_{s}" for p in ("raw", "norm") for s in ("mean", "std", "p10", "p50", "p90", "max", "energy", "mad")] + ["center_z", "center_y_", "center_x", "occupancy", "high_fraction"]
_NODES = _NODE.format(cols=", ".join(f"coalesce({c}, 0) AS {c}" for c in _NODE_COLS))


@query("v29_graph_nodes", "uid:i node:i region:s band:i " + " ".join(f"{c}:d" for c in _NODE_COLS), f"SELECT * FROM {_NODES}", "fx_voxels")
def _(spark, sf):
    return at.graph_nodes(vox(spark, sf))


_EDGES = ", ".join(f"({a}, {b}, CAST({w!r} AS DOUBLE))" for a, b, w in at.graph_edge_list())


@query(
    "v29_graph_edges",
    "uid:i src:i dst:i w:d src_value:d dst_value:d",
    f"WITH n AS {_NODES} SELECT a.uid, e.src, e.dst, e.w, a.raw_mean AS src_value, b.raw_mean AS dst_value FROM (VALUES {_EDGES}) e(src, dst, w) JOIN n a ON a.node = e.src JOIN n b ON b.node = e.dst AND b.uid = a.uid",
    "fx_voxels",
)
def _(spark, sf):
    return at.graph_edges(at.graph_nodes(vox(spark, sf)).select("uid", "node", "raw_mean"), "raw_mean")


@query(
    "v30_auxiliary_targets",
    "uid:i " + " ".join(f"{n}:d" for n in vx.PROXIES) + " affected_left:d asymmetry:d",
    f"""SELECT *, CASE WHEN l < r THEN 1 ELSE 0 END AS affected_left, abs(l - r) / greatest(abs(l) + abs(r), CAST(0.000001 AS DOUBLE)) AS asymmetry FROM (SELECT *, (right_putamen_anterior + right_putamen_posterior) / 2 AS r, (left_putamen_anterior + left_putamen_posterior) / 2 AS l FROM (
        SELECT uid, {', '.join(f"coalesce(avg(v) FILTER (region = '{n}'), 0) AS {n}" for n in vx.PROXIES)} FROM (SELECT *, {PROXY} AS region FROM fx_voxels WHERE m) GROUP BY uid))""",
    "fx_voxels",
)
def _(spark, sf):
    return at.auxiliary_targets(vox(spark, sf), fragmentation=False)


@query("v30_fragmentation", "uid:i fragmentation:d")
def _(spark, sf):
    return at.auxiliary_targets(vox(spark, sf))


_MAP = "(SELECT f.uid, f.z, f.y_, f.x, abs(f.v) AS v, f.m, abs(g.v) AS b, abs(h.v) AS r FROM fx_voxels f JOIN fx_voxels g ON g.uid = f.uid AND g.z = f.z AND g.y_ = f.y_ AND g.x = 3 - f.x JOIN fx_voxels h ON h.uid = f.uid AND h.z = 3 - f.z AND h.y_ = f.y_ AND h.x = f.x)"


@query(
    "v32_map_agreement",
    "uid:i agreement:d random_agreement:d contradiction:b sanity_pass:b",
    f"SELECT *, coalesce(agreement < 0.1, false) AS contradiction, coalesce(abs(random_agreement) < 0.8, false) AS sanity_pass FROM (SELECT uid, corr(v, b) AS agreement, corr(v, r) AS random_agreement FROM {_MAP} GROUP BY uid)",
    "fx_voxels",
)
def _(spark, sf):
    a = vox(spark, sf).select("uid", *vx.POS, F.abs("v").alias("v"))
    return at.map_agreement(a, a.withColumn("x", 3 - C("x")), a.withColumn("z", 3 - C("z")))


def _mean(cond):
    return f"coalesce(avg(v) FILTER (m AND {cond}), 0)"


_CORE = f"""WITH r AS (SELECT uid, z, y_, x, v, m FROM {ROBUST.format(n=20)}), c AS (SELECT *, avg(CASE WHEN m THEN z END) OVER w AS cz, avg(CASE WHEN m THEN y_ END) OVER w AS cy, avg(CASE WHEN m THEN x END) OVER w AS cx, quantile_cont(CASE WHEN m THEN v END, 0.85) OVER w AS hot FROM r WINDOW w AS (PARTITION BY uid)),
  h AS (SELECT *, m AND v >= hot AS h0 FROM c), hv AS (SELECT uid, z, y_, x FROM h WHERE h0),
  dl AS (SELECT DISTINCT uid, z + a AS z, y_ + b AS y_, x + d AS x FROM hv CROSS JOIN (VALUES (0,0,0),(1,0,0),(-1,0,0),(0,1,0),(0,-1,0),(0,0,1),(0,0,-1)) t(a, b, d) WHERE z + a BETWEEN 0 AND 3 AND y_ + b BETWEEN 0 AND 3 AND x + d BETWEEN 0 AND 3),
  er AS (SELECT o.uid, o.z, o.y_, o.x FROM dl o JOIN dl n ON n.uid = o.uid AND abs(n.z - o.z) + abs(n.y_ - o.y_) + abs(n.x - o.x) = 1 GROUP BY o.uid, o.z, o.y_, o.x HAVING count(*) = 6),
  k AS (SELECT h.*, er.uid IS NOT NULL AS hi FROM h LEFT JOIN er ON er.uid = h.uid AND er.z = h.z AND er.y_ = h.y_ AND er.x = h.x),
  g AS (SELECT uid, avg(v) FILTER (m) AS target_mean, stddev_pop(v) FILTER (m) AS target_std, {', '.join(f'quantile_cont(v, {p / 100}) FILTER (m) AS target_p{p}' for p in (10, 25, 50, 75, 90, 99))},
    {_mean('x < cx')} AS r_, {_mean('x >= cx')} AS l_, {_mean('y_ < cy')} AS a_, {_mean('y_ >= cy')} AS b_, sum(CAST(hi AS INT)) / CAST(greatest(sum(CAST(m AS INT)), 1) AS DOUBLE) AS high_fraction,
    count(*) FILTER (hi AND m AND x < cx) / CAST(greatest(count(*) FILTER (m AND x < cx), 1) AS DOUBLE) AS hr, count(*) FILTER (hi AND m AND x >= cx) / CAST(greatest(count(*) FILTER (m AND x >= cx), 1) AS DOUBLE) AS hl,
    {', '.join(f'coalesce((avg({c}) FILTER (hi) - any_value(c{c[0]})) / greatest(max({c}) FILTER (m) - min({c}) FILTER (m), 1), 0) AS high_center_{c}' for c in vx.POS)} FROM k GROUP BY uid)"""


@query(
    "v33_core_features",
    "uid:i target_mean:d target_std:d target_p10:d target_p50:d target_p99:d target_iqr:d target_width:d p90_p50:d p99_p50:d target_entropy:d lr_asymmetry:d posterior_anterior:d high_fraction:d high_balance:d high_center_z:d high_center_y_:d high_center_x:d",
    f"""{_CORE} SELECT g.*, target_p75 - target_p25 AS target_iqr, target_p90 - target_p10 AS target_width, target_p90 / greatest(abs(target_p50), CAST(0.000001 AS DOUBLE)) AS p90_p50, target_p99 / greatest(abs(target_p50), CAST(0.000001 AS DOUBLE)) AS p99_p50, e.entropy AS target_entropy,
        abs(l_ - r_) / greatest((abs(l_) + abs(r_)) / 2, CAST(0.000001 AS DOUBLE)) AS lr_asymmetry, b_ / greatest(abs(a_), CAST(0.000001 AS DOUBLE)) AS posterior_anterior, least(hl, hr) / greatest(greatest(hl, hr), CAST(0.000001 AS DOUBLE)) AS high_balance
        FROM g JOIN {_HIST.format(bins=24, source='(SELECT * FROM r WHERE m)')} e ON e.uid = g.uid""",
    "fx_voxels",
)
def _(spark, sf):
    return at.core_features(vox(spark, sf), min_positive=20)


@query("v33_core_feature_blocks", "uid:i target_mean:d texture_contrast:d mip_z_mean:d components:i largest_fraction:d high_elongation:d4")
def _(spark, sf):
    return at.core_feature_blocks(vox(spark, sf), SPACING, min_positive=20)


@query(
    "v34_magnitude_summary",
    "uid:i l2_norm:d mean:d p90:d positive_voxels:i",
    "SELECT uid, sqrt(sum(v * v)) AS l2_norm, avg(v) AS mean, quantile_cont(v, 0.9) AS p90, count(*) FILTER (v > 0) AS positive_voxels FROM fx_voxels WHERE m GROUP BY uid",
    "fx_voxels",
)
def _(spark, sf):
    return at.magnitude_summary(vox(spark, sf))


@query("v35_consensus_masks", "uid:i z:i y_:i x:i target:b brain:b background:b right:b left:b")
def _(spark, sf):
    t = templates(spark, sf).select(C("grp").alias("uid"), *vx.POS, (C("mean") + 0.2).alias("v"))
    return at.consensus_masks(t, 60.0, 20, 4)


@query(
    "v37_label_masks",
    "uid:i z:i y_:i x:i name:s",
    """WITH l AS (SELECT uid, z, y_, x, CASE WHEN v > 0.2 THEN 4 WHEN NOT m THEN 0 WHEN x < 2 THEN 1 WHEN y_ < 2 THEN 2 ELSE 3 END AS label FROM fx_voxels),
       ok AS (SELECT uid FROM l WHERE label IN (1, 2) GROUP BY uid HAVING count(DISTINCT label) = 2)
       SELECT uid, z, y_, x, CASE label WHEN 1 THEN 'right_target' WHEN 2 THEN 'left_target' ELSE 'background' END AS name FROM l WHERE label IN (1, 2, 3) AND uid IN (SELECT uid FROM ok)""",
    "fx_voxels",
)
def _(spark, sf):
    label = F.when(C("v") > 0.2, 4).when(~C("m"), 0).when(C("x") < 2, 1).when(C("y_") < 2, 2).otherwise(3)
    return at.label_masks(
        vox(spark, sf).select("uid", *vx.POS, label.alias("label")), {1: "right_target", 2: "left_target", 3: "background"}, ["right_target", "left_target"]
    )


@query(
    "a28_mask_saliency",
    "uid:i saliency_fraction:d volume_fraction:d enrichment:d",
    "SELECT *, saliency_fraction / volume_fraction AS enrichment FROM (SELECT uid, sum(CASE WHEN m THEN abs(v) ELSE 0 END) / sum(abs(v)) AS saliency_fraction, avg(CASE WHEN m THEN 1 ELSE 0 END) AS volume_fraction FROM fx_voxels GROUP BY uid)",
    "fx_voxels",
)
def _(spark, sf):
    return at.mask_saliency(vox(spark, sf))


@query(
    "a29_counterfactual_summary",
    "uid:i max_stable_delta:d directed_delta:d direction_contradiction:b invariance_failed:b",
    """SELECT user_id AS uid, max(CASE WHEN k = 'stable' THEN abs(d) END) AS max_stable_delta, max(CASE WHEN k <> 'stable' THEN d END) AS directed_delta, bool_or((k = 'increase' AND d < -0.2) OR (k = 'decrease' AND d > 0.2)) AS direction_contradiction,
       coalesce(max(CASE WHEN k = 'stable' THEN abs(d) END) > 0.3, false) AS invariance_failed FROM (SELECT user_id, CASE WHEN event_type IN ('click', 'view') THEN 'stable' WHEN event_id % 2 = 0 THEN 'increase' ELSE 'decrease' END AS k, value / 100 - 0.3 AS d FROM events) GROUP BY user_id""",
)
def _(spark, sf):
    e = fx.table(spark, sf, "events")
    kind = F.when(C("event_type").isin("click", "view"), "stable").when(C("event_id") % 2 == 0, "increase").otherwise("decrease")
    d = e.select(C("user_id").alias("uid"), kind.alias("kind"), (C("value") / 100 - 0.3).alias("delta"))
    return at.counterfactual_summary(d, "kind", "delta", 0.3, 0.2)


@query(
    "a30_occlusion_map",
    "uid:i z:i y_:i x:i signed_delta:d coverage:i importance:d",
    """SELECT f.uid, f.z, f.y_, f.x, avg(w.v) AS signed_delta, count(*) AS coverage, abs(avg(w.v)) AS importance FROM fx_voxels f JOIN fx_voxels w ON w.uid = f.uid AND w.z IN (0, 2) AND w.y_ IN (0, 1) AND w.x IN (0, 1)
       AND f.z >= w.z AND f.z < w.z + 2 AND f.y_ >= w.y_ AND f.y_ < w.y_ + 3 AND f.x >= w.x AND f.x < w.x + 3 GROUP BY f.uid, f.z, f.y_, f.x""",
    "fx_voxels",
)
def _(spark, sf):
    starts = {"z": (2, 2), "y_": (3, 2), "x": (3, 2)}
    v = vox(spark, sf)
    for c, (patch, stride) in starts.items():
        v = v.where(F.array_contains(at.window_starts(F.lit(4), patch, stride), C(c)))
    windows = v.select("uid", C("z").alias("z0"), C("y_").alias("y0"), C("x").alias("x0"), C("v").alias("delta"))
    return at.occlusion_map(windows, (2, 3, 3), (4, 4, 4))
