"""Projection, filter and scalar queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from cohortloom.functions import scalar as s
from cohortloom.operators import catalog
from cohortloom.plans import fixtures as fx
from cohortloom.registry import query

C = F.col


@query(
    "p01_normalize_identifier",
    "page_id:i clean:s",
    """SELECT page_id, regexp_replace(lower(trim(regexp_extract(path, '([^/]*)/*$', 1))), '\\.nii(\\.gz)?$', '') AS clean
       FROM (SELECT page_id, concat(split_part(url, '?', 1), ' Scan_', CAST(page_id AS VARCHAR),
             CASE page_id % 3 WHEN 0 THEN '.nii' WHEN 1 THEN '.NII.GZ' ELSE '' END, CASE WHEN page_id % 2 = 0 THEN ' ' ELSE '' END) AS path
             FROM pages)""",
)
def _(spark, sf):
    suffix = F.when(C("page_id") % 3 == 0, ".nii").when(C("page_id") % 3 == 1, ".NII.GZ").otherwise("")
    path = F.concat(
        F.split_part("url", F.lit("?"), F.lit(1)),
        F.lit(" Scan_"),
        C("page_id").cast("string"),
        suffix,
        F.when(C("page_id") % 2 == 0, " ").otherwise(""),
    )
    return fx.table(spark, sf, "pages").select("page_id", s.normalize_identifier(path).alias("clean"))


_SIG = "printf('%dx%dx%d|%.3f', shape_x, shape_y, shape_z, spacing)"


@query("p02_signature", "uid:s signature:s", f"SELECT uid, {_SIG} AS signature FROM fx_cohort", "fx_cohort")
def _(spark, sf):
    return fx.cohort(spark, sf).select("uid", s.signature(["shape_x", "shape_y", "shape_z"], ["spacing"]).alias("signature"))


@query(
    "p03_family_code",
    "uid:s family:s",
    f"""SELECT uid, concat('AF', lpad(CAST(dense_rank() OVER (ORDER BY sig) AS VARCHAR), 3, '0')) AS family
        FROM (SELECT uid, {_SIG} AS sig FROM fx_cohort)""",
    "fx_cohort",
)
def _(spark, sf):
    df = fx.cohort(spark, sf).select("uid", s.signature(["shape_x", "shape_y", "shape_z"], ["spacing"]).alias("sig"))
    return catalog.family_code(df, "sig", "family")


@query(
    "p04_select_block",
    "uid:s shape_x:i shape_y:i shape_z:i f1:d f2:d f3:d",
    "SELECT uid, shape_x, shape_y, shape_z, f1, f2, f3 FROM fx_cohort",
    "fx_cohort",
)
def _(spark, sf):
    return s.select_block(fx.cohort(spark, sf), ["shape_", "f"], keep=["uid"])


@query(
    "p05_clean_numeric",
    "event_id:i raw:d scaled:d",
    """SELECT event_id, CASE WHEN isfinite(v) THEN v END AS raw, CASE WHEN isfinite(w) THEN w END AS scaled FROM (
         SELECT event_id, TRY_CAST(CASE WHEN event_id % 5 = 0 THEN 'n/a' WHEN event_id % 7 = 0 THEN 'NaN' ELSE CAST(value AS VARCHAR) END AS DOUBLE) AS v,
         CASE WHEN event_id % 3 = 0 THEN CAST('Infinity' AS DOUBLE) WHEN event_id % 11 = 0 THEN CAST('-Infinity' AS DOUBLE) ELSE value / 3 END AS w FROM events)""",
)
def _(spark, sf):
    e = fx.table(spark, sf, "events")
    text = (
        F.when(C("event_id") % 5 == 0, "n/a").when(C("event_id") % 7 == 0, "NaN").otherwise(C("value").cast("string"))
    )
    inf = float("inf")
    scaled = (
        F.when(C("event_id") % 3 == 0, F.lit(inf)).when(C("event_id") % 11 == 0, F.lit(-inf)).otherwise(C("value") / 3)
    )
    return e.select("event_id", s.clean_numeric(text).alias("raw"), s.clean_numeric(scaled).alias("scaled"))


@query(
    "p06_signed_log1p",
    "c_custkey:i v:d",
    "SELECT c_custkey, sign(c_acctbal) * ln(1 + abs(c_acctbal)) AS v FROM customer",
)
def _(spark, sf):
    return fx.table(spark, sf, "customer").select("c_custkey", s.signed_log1p(C("c_acctbal")).alias("v"))


@query(
    "p07_clip_safe_ratio",
    "uid:s clipped:d ratio:d guarded:d",
    """SELECT uid, CASE WHEN f2 IS NOT NULL THEN greatest(least(f2, CAST(40 AS DOUBLE)), CAST(5 AS DOUBLE)) END AS clipped,
       CASE WHEN f2 IS NOT NULL THEN f1 / greatest(abs(f2 - 10), CAST(0.000001 AS DOUBLE)) END AS ratio,
       CASE WHEN f2 - 20 > 0 THEN f1 / (f2 - 20) ELSE 0 END AS guarded FROM fx_cohort""",
    "fx_cohort",
)
def _(spark, sf):
    ratio = s.safe_ratio(C("f1"), C("f2") - 10)
    return fx.cohort(spark, sf).select(
        "uid", s.clip(C("f2"), 5.0, 40.0).alias("clipped"), ratio.alias("ratio"),
        s.positive_ratio(C("f1"), C("f2") - 20).alias("guarded"),
    )


@query(
    "p08_logit_sigmoid",
    "uid:s model:s z:d back:d",
    """SELECT uid, model, z, 1 / (1 + exp(-greatest(least(z * 2, CAST(40 AS DOUBLE)), CAST(-40 AS DOUBLE)))) AS back FROM (
       SELECT uid, model, ln(prob / (1 - prob)) AS z FROM fx_predictions)""",
    "fx_predictions",
)
def _(spark, sf):
    z = s.logit(C("prob"))
    return fx.predictions(spark, sf).select("uid", "model", z.alias("z"), s.sigmoid(z * 2).alias("back"))


LOSS = "-(y * ln(prob) + (1 - y) * ln(1 - prob))"


@query("p09_row_log_loss", "uid:s model:s loss:d", f"SELECT uid, model, {LOSS} AS loss FROM fx_predictions", "fx_predictions")
def _(spark, sf):
    return fx.predictions(spark, sf).select("uid", "model", s.row_log_loss(C("y"), C("prob")).alias("loss"))


@query(
    "p10_explode_params",
    "number:i param__depth:s param__rate:s",
    """SELECT number, json_extract_string(params_json, '$.depth') AS param__depth,
       json_extract_string(params_json, '$.rate') AS param__rate FROM fx_trials""",
    "fx_trials",
)
def _(spark, sf):
    return s.explode_params(fx.trials(spark, sf), "params_json", ["depth", "rate"])


@query(
    "p11_explode_fold_scores",
    "number:i fold:i score:d",
    """SELECT number, i - 1 AS fold, CAST(json_extract_string(fold_scores_json, concat('$[', CAST(i - 1 AS VARCHAR), ']')) AS DOUBLE) AS score
       FROM fx_trials CROSS JOIN (SELECT unnest([1, 2]) AS i)""",
    "fx_trials",
)
def _(spark, sf):
    return s.explode_fold_scores(fx.trials(spark, sf).select("number", "fold_scores_json"), "fold_scores_json")


_NAME = """concat(CASE o_custkey % 3 WHEN 0 THEN 'node07_' WHEN 1 THEN 'node09_' ELSE 'cnn_' END,
  CASE o_orderkey % 4 WHEN 0 THEN 'slab2d_' WHEN 1 THEN '25d_' WHEN 2 THEN '3d_' ELSE 'tab_' END,
  CASE o_custkey % 4 WHEN 0 THEN 'canonical_' WHEN 1 THEN 'random_flip_' ELSE '' END,
  CASE o_orderkey % 5 WHEN 0 THEN 'image_only' WHEN 1 THEN 'image_radiomics' WHEN 2 THEN 'image_radiomics_sbr' ELSE 'other' END)"""


def named_trials(spark, sf):
    """Trials with study names that follow the naming convention."""
    o, cust, key = fx.table(spark, sf, "orders"), C("o_custkey"), C("o_orderkey")

    def pick(expr, names, other):
        out = F.lit(other)
        for i, name in reversed(list(enumerate(names))):
            out = F.when(expr == i, name).otherwise(out)
        return out

    name = F.concat(
        pick(cust % 3, ["node07_", "node09_"], "cnn_"),
        pick(key % 4, ["slab2d_", "25d_", "3d_"], "tab_"),
        pick(cust % 4, ["canonical_", "random_flip_"], ""),
        pick(key % 5, ["image_only", "image_radiomics", "image_radiomics_sbr"], "other"),
    )
    return o.select(key.alias("number"), name.alias("study_name"), (C("o_totalprice") / F.lit(1000000.0)).alias("value"),
                    C("o_orderstatus").alias("status"))


NAMED_SQL = f"SELECT o_orderkey AS number, {_NAME} AS study_name, o_totalprice / CAST(1000000 AS DOUBLE) AS value, o_orderstatus AS status FROM orders"
PARSED_SQL = f"""SELECT number, study_name, value, status,
  CASE WHEN regexp_matches(b, '^slab2d_') THEN 'slab2d' WHEN regexp_matches(b, '^25d_') THEN '2.5d' WHEN regexp_matches(b, '^3d_') THEN '3d' ELSE 'unknown' END AS architecture,
  CASE WHEN study_name LIKE '%image\\_radiomics\\_sbr' ESCAPE '\\' THEN 'image_radiomics_sbr' WHEN study_name LIKE '%image\\_radiomics' ESCAPE '\\' THEN 'image_radiomics'
       WHEN study_name LIKE '%image\\_only' ESCAPE '\\' THEN 'image_only' ELSE 'unknown' END AS variant,
  CASE WHEN contains(study_name, '_random_flip_') THEN 'random_flip' WHEN contains(study_name, '_canonical_') THEN 'canonical' ELSE 'unknown' END AS lateral_strategy
  FROM (SELECT *, regexp_replace(study_name, '^(cnn|node[0-9]+)_', '') AS b FROM ({NAMED_SQL}))"""


def parsed_trials(spark, sf):
    df = named_trials(spark, sf)
    n = C("study_name")
    return df.select(
        "*",
        s.study_architecture(n).alias("architecture"),
        s.study_variant(n).alias("variant"),
        s.study_lateral(n).alias("lateral_strategy"),
    )


@query("p12_parse_study_name", "number:i architecture:s variant:s lateral_strategy:s", PARSED_SQL)
def _(spark, sf):
    return parsed_trials(spark, sf)


@query(
    "p13_stable_hash",
    "number:i full_id:s short_id:s",
    """SELECT number, h AS full_id, substr(h, 1, 16) AS short_id FROM (SELECT o_orderkey AS number,
       sha256(concat('{"cust":', CAST(o_custkey AS VARCHAR), ',"status":"', o_orderstatus, '"}')) AS h FROM orders)""",
)
def _(spark, sf):
    o = fx.table(spark, sf, "orders").select(
        C("o_orderkey").alias("number"), C("o_orderstatus").alias("status"), C("o_custkey").alias("cust"),
        C("o_totalprice").alias("fold_log_loss"),
    )
    cols = ["status", "cust", "fold_log_loss"]
    return o.select(
        "number",
        s.stable_hash(cols, ignore=["fold_log_loss"]).alias("full_id"),
        s.stable_hash(cols, 16, ignore=["fold_log_loss"]).alias("short_id"),
    )


@query(
    "p14_flag_confident_wrong",
    "uid:s wrong_a:b both_wrong:b decided:b",
    """SELECT uid, (m_a > 0.7 AND y = 0) OR (m_a < 0.3 AND y = 1) AS wrong_a,
       (m_a > 0.6 AND m_b > 0.6 AND y = 0) OR (m_a < 0.4 AND m_b < 0.4 AND y = 1) AS both_wrong, m_a >= 0.5 AS decided FROM fx_wide""",
    "fx_wide",
)
def _(spark, sf):
    w = fx.wide_predictions(spark, sf)
    return w.select(
        "uid",
        s.flag_confident_wrong(C("y"), C("m_a"), 0.7, 0.3).alias("wrong_a"),
        s.flag_all_confident_wrong(C("y"), [C("m_a"), C("m_b")], 0.6, 0.4).alias("both_wrong"),
        s.decision(C("m_a")).alias("decided"),
    )


@query(
    "p15_imbalance_level",
    "source:s level:s",
    """SELECT source, CASE WHEN mi = 0 THEN 'No calculable' WHEN ma / mi < 1.5 THEN 'Bajo' WHEN ma / mi < 3 THEN 'Moderado' ELSE 'Alto' END AS level
       FROM (SELECT source, CAST(greatest(p, n) AS DOUBLE) AS ma, CAST(least(p, n) AS DOUBLE) AS mi FROM (
         SELECT source, sum(CASE WHEN lang = 'en' THEN 1 ELSE 0 END) AS p, sum(CASE WHEN lang <> 'en' THEN 1 ELSE 0 END) AS n FROM documents GROUP BY source))""",
)
def _(spark, sf):
    en = (C("lang") == "en").cast("int")
    g = fx.table(spark, sf, "documents").groupBy("source").agg(F.sum(en).alias("p"), F.sum(1 - en).alias("n"))
    big, small = F.greatest("p", "n").cast("double"), F.least("p", "n").cast("double")
    return g.select("source", s.imbalance_level(big / F.when(small > 0, small)).alias("level"))


@query(
    "p16_encode_dimension",
    "number:i arch_code:i rate:d",
    f"""SELECT number, dense_rank() OVER (ORDER BY architecture) - 1 AS arch_code, log10(greatest(value, CAST(1e-12 AS DOUBLE))) AS rate FROM ({PARSED_SQL})""",
)
def _(spark, sf):
    coded = catalog.category_index(parsed_trials(spark, sf), "architecture", "arch_code")
    return coded.select("number", "arch_code", s.log_rate(C("value")).alias("rate"))


@query(
    "p17_guess_column",
    "feature:s n_distinct:i is_target:b",
    """SELECT 'o_orderstatus' AS feature, count(DISTINCT o_orderstatus) AS n_distinct, false AS is_target FROM orders
       UNION ALL SELECT 'o_orderpriority', count(DISTINCT o_orderpriority), true FROM orders
       UNION ALL SELECT 'o_totalprice', count(DISTINCT o_totalprice), false FROM orders""",
)
def _(spark, sf):
    o = fx.table(spark, sf, "orders").select("o_orderstatus", "o_totalprice", "o_orderpriority")
    target = catalog.guess_column(o, ["label", "target", "class"])
    return catalog.distinct_counts(o).select("feature", "n_distinct", (C("feature") == target).alias("is_target"))


@query(
    "p18_valid_path_component",
    "page_id:i ok:b",
    """SELECT page_id, regexp_matches(name, '^[A-Za-z0-9._-]+$') AND name NOT IN ('.', '..') AS ok FROM (
       SELECT page_id, CASE WHEN page_id % 10 = 0 THEN '..' ELSE regexp_extract(url, '([^/]*)$', 1) END AS name FROM pages)""",
)
def _(spark, sf):
    name = F.when(C("page_id") % 10 == 0, "..").otherwise(F.regexp_extract("url", "([^/]*)$", 1))
    return fx.table(spark, sf, "pages").select("page_id", s.valid_path_component(name).alias("ok"))


@query(
    "p19_filter_cohort",
    "uid:s y:i f2:d",
    """SELECT uid, y, f2 FROM (SELECT uid, y, f2, shape_x, count(*) OVER (PARTITION BY shape_x, spacing) AS n FROM fx_cohort WHERE y IS NOT NULL AND f2 IS NOT NULL)
       WHERE n >= 150""",
    "fx_cohort",
)
def _(spark, sf):
    from cohortloom.operators.profile import filter_cohort

    return filter_cohort(fx.cohort(spark, sf), "y", ["f2"], ["shape_x", "spacing"], 150)


@query(
    "p20_qc_flags",
    "uid:s registration:b fallback:b risk:d",
    """SELECT uid, a IS NULL OR a < 0.55 OR coalesce(a - b < -0.05, false) AS registration,
       a IS NULL OR a < 0.35 OR coalesce(a < b - 0.03, false) AS fallback,
       CASE WHEN NOT ok OR fl THEN 1 ELSE 0 END AS risk FROM (
       SELECT CAST(event_id AS VARCHAR) AS uid, CASE WHEN event_id % 9 <> 0 THEN value / 20 END AS a, (event_id % 100) / CAST(150 AS DOUBLE) AS b,
              event_id % 2 = 0 AS ok, event_id % 5 = 0 AS fl FROM events)""",
)
def _(spark, sf):
    e = fx.table(spark, sf, "events").select(
        C("event_id").cast("string").alias("uid"),
        F.when(C("event_id") % 9 != 0, C("value") / 20).alias("a"),
        ((C("event_id") % 100) / F.lit(150.0)).alias("b"),
        (C("event_id") % 2 == 0).alias("ok"),
        (C("event_id") % 5 == 0).alias("fl"),
    )
    return e.select(
        "uid",
        s.registration_flag(C("b"), C("a")).alias("registration"),
        s.fallback_flag(C("b"), C("a")).alias("fallback"),
        s.background_risk(C("ok"), C("fl")).alias("risk"),
    )


@query(
    "p21_progress_status",
    "run_key:s study:s status:s fraction:d",
    """SELECT run_key, study, CASE WHEN done > 60 THEN 'complete' WHEN running > 0 THEN 'training' ELSE 'pending' END AS status,
       least(CAST(1 AS DOUBLE), running / CAST(100 AS DOUBLE)) AS fraction FROM (
       SELECT run_key, study, sum(CASE WHEN state = 'COMPLETE' THEN 1 ELSE 0 END) AS done, sum(CASE WHEN state = 'RUNNING' THEN 1 ELSE 0 END) AS running
       FROM fx_trials GROUP BY run_key, study)""",
    "fx_trials",
)
def _(spark, sf):
    t = fx.trials(spark, sf)
    g = t.groupBy("run_key", "study").agg(
        F.sum((C("state") == "COMPLETE").cast("int")).alias("done"), F.sum((C("state") == "RUNNING").cast("int")).alias("running")
    )
    return g.select(
        "run_key",
        "study",
        s.progress_status(C("done") - 60, C("running")).alias("status"),
        s.progress_fraction(C("running"), F.lit(100)).alias("fraction"),
    )


@query(
    "p22_network_label",
    "number:i network:s",
    f"""SELECT number, concat(regexp_extract(study_name, '^(node)?([^_]*)', 2), ' · ', architecture, ' · ', variant,
        CASE WHEN lateral_strategy IN ('canonical', 'random_flip') THEN concat(' · ', lateral_strategy) ELSE '' END) AS network FROM ({PARSED_SQL})""",
)
def _(spark, sf):
    node = F.regexp_extract("study_name", "^([^_]*)", 1)
    return parsed_trials(spark, sf).select(
        "number", s.network_label(node, C("architecture"), C("variant"), C("lateral_strategy")).alias("network")
    )


@query(
    "p23_smoothed_score",
    "uid:s structure:d balanced:d",
    """SELECT uid, structure, 2 * m_a * structure / greatest(m_a + structure, CAST(1e-8 AS DOUBLE)) AS balanced FROM (
       SELECT uid, m_a, 0.5 * m_a + 0.3 * m_b + 0.1 * (1 - m_c) + 0.1 * (1 - y) AS structure FROM fx_wide)""",
    "fx_wide",
)
def _(spark, sf):
    w = fx.wide_predictions(spark, sf).withColumn("structure", s.structure_score(C("m_a"), C("m_b"), C("m_c"), C("y")))
    return w.select("uid", "structure", s.balanced_score(C("m_a"), C("structure")).alias("balanced"))
