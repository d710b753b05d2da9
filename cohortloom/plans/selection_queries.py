"""Top-k, sampling, selection and set queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from cohortloom.functions.keyed import uniform_sql
from cohortloom.operators import selection as t
from cohortloom.plans import fixtures as fx
from cohortloom.plans.scalar_queries import PARSED_SQL, parsed_trials
from cohortloom.registry import query

C = F.col


@query(
    "t01_top_k",
    "o_orderkey:i o_totalprice:d",
    "SELECT o_orderkey, o_totalprice FROM orders ORDER BY o_totalprice DESC, o_orderkey LIMIT 25",
)
def _(spark, sf):
    return t.top_k(fx.table(spark, sf, "orders"), "o_totalprice", 25, ["o_orderkey"])


@query("t02_sort_nulls_last", "uid:s y:i f2:d", "SELECT uid, y, f2 FROM fx_cohort ORDER BY y NULLS LAST, f2 DESC NULLS LAST, uid", "fx_cohort")
def _(spark, sf):
    return t.sort_nulls_last(fx.cohort(spark, sf), [("y", True), ("f2", False), ("uid", True)])


_U = uniform_sql("concat('7|', CAST(doc_id AS VARCHAR))")


@query("t03_sample_fixed", "doc_id:i source:s", f"SELECT doc_id, source FROM documents ORDER BY {_U}, doc_id LIMIT 120")
def _(spark, sf):
    return t.sample_fixed(fx.table(spark, sf, "documents").select("doc_id", "source"), 120, "doc_id", 7)


def _strat(quota):
    return f"""WITH d AS (SELECT doc_id, source, {_U} AS u FROM documents),
      r AS (SELECT *, row_number() OVER (PARTITION BY source ORDER BY u, doc_id) AS rn, count(*) OVER (PARTITION BY source) AS c FROM d)
      SELECT doc_id, source FROM (SELECT *, CASE WHEN rn <= {quota} THEN 0 ELSE 1 END AS p FROM r) ORDER BY p, u, doc_id LIMIT 130"""


@query("t04_sample_equal", "doc_id:i source:s", _strat("130 // (SELECT count(DISTINCT source) FROM documents)"))
def _(spark, sf):
    return t.sample_stratified(fx.table(spark, sf, "documents").select("doc_id", "source"), 130, "source", "doc_id", 7)


@query("t04_sample_proportional", "doc_id:i source:s", _strat("round_even(CAST(130 AS DOUBLE) * c / (SELECT count(*) FROM documents), 0)"))
def _(spark, sf):
    return t.sample_stratified(
        fx.table(spark, sf, "documents").select("doc_id", "source"), 130, "source", "doc_id", 7, proportional=True
    )


@query(
    "t05_sample_hard_typical",
    "uid:s y:i valid:b err:d",
    """WITH b AS (SELECT uid, y, valid, abs(m_a - y) AS err FROM fx_wide), q AS (SELECT 50 // count(*) AS quota FROM (SELECT DISTINCT y, valid FROM b)),
       r AS (SELECT *, row_number() OVER (PARTITION BY y, valid ORDER BY err, uid) - 1 AS pos, count(*) OVER (PARTITION BY y, valid) AS m FROM b),
       k AS (SELECT *, least(m, quota) AS take, greatest(1, least(m, quota) // 2) AS h FROM r, q),
       s AS (SELECT *, greatest(0, take - h) AS more, m - h AS rest FROM k),
       z AS (SELECT *, pos >= rest OR (more > 0 AND list_contains(list_transform(range(more), lambda i: CASE WHEN i = more - 1 THEN CASE WHEN more > 1 THEN rest - 1 ELSE 0 END
             ELSE CAST(floor(i * ((rest - 1) / CAST(greatest(more - 1, 1) AS DOUBLE))) AS BIGINT) END), pos)) AS chosen FROM s)
       SELECT uid, y, valid, err FROM z ORDER BY CASE WHEN chosen THEN 0 ELSE 1 END, err DESC, uid LIMIT 50""",
    "fx_wide",
)
def _(spark, sf):
    x = fx.wide_predictions(spark, sf).select("uid", "y", "valid", F.abs(C("m_a") - C("y")).alias("err"))
    return t.sample_hard_typical(x, 50, ["y", "valid"], "uid", "err")


@query(
    "t06_select_diverse",
    "number:i value:d architecture:s variant:s",
    f"""WITH c AS ({PARSED_SQL}), b AS (SELECT * FROM c ORDER BY value, number LIMIT 1),
        o AS (SELECT c.number FROM c, b WHERE c.architecture <> b.architecture ORDER BY c.value, c.number LIMIT 1)
        SELECT c.number, c.value, c.architecture, c.variant FROM c, b, o ORDER BY CASE WHEN c.number = b.number THEN 0 WHEN c.number = o.number THEN 1
          WHEN c.variant <> b.variant THEN 2 ELSE 3 END, c.value, c.number LIMIT 6""",
)
def _(spark, sf):
    return t.select_diverse(parsed_trials(spark, sf), 6, "value", "number", "architecture", "variant")


@query(
    "t07_select_top2_plus_best",
    "number:i rank:i roles:s",
    f"""WITH r AS (SELECT *, row_number() OVER (ORDER BY value, number) AS rank FROM ({PARSED_SQL})), b AS (SELECT min(rank) AS br FROM r WHERE architecture = '3d')
        SELECT number, rank, coalesce(nullif(concat_ws(',', CASE WHEN rank = 1 THEN 'top_1_overall' END, CASE WHEN rank = 2 THEN 'top_2_overall' END, CASE WHEN rank = br THEN 'best_3d' END), ''), 'diversity_fill') AS roles
        FROM r, b ORDER BY CASE WHEN rank <= 2 THEN 0 WHEN rank = br THEN 1 ELSE 2 END, rank LIMIT 3""",
)
def _(spark, sf):
    return t.select_top2_plus_best(parsed_trials(spark, sf), "value", "number", "architecture", "3d")


@query(
    "t08_representatives",
    "uid:s fam:i f2:d",
    """WITH n AS (SELECT uid, shape_x AS fam, f2 FROM fx_cohort WHERE y = 0)
       SELECT uid, fam, f2 FROM (SELECT *, row_number() OVER (PARTITION BY fam ORDER BY f2 NULLS LAST, uid) AS rn FROM n)
       WHERE rn <= ceil(20.0 / (SELECT count(DISTINCT fam) FROM n)) ORDER BY f2 NULLS LAST, uid LIMIT 20""",
    "fx_cohort",
)
def _(spark, sf):
    return t.representatives(fx.cohort(spark, sf).select("uid", "y", C("shape_x").alias("fam"), "f2"), 20, "y", "fam", "f2", "uid")


@query(
    "t09_reference_row",
    "uid:s reference_score:d",
    """WITH big AS (SELECT shape_x FROM fx_cohort GROUP BY shape_x ORDER BY count(*) DESC, shape_x LIMIT 1), p AS (SELECT * FROM fx_cohort WHERE y = 0 AND shape_x = (SELECT shape_x FROM big)),
       s AS (SELECT median(spacing) AS m1, coalesce(nullif(stddev_pop(spacing), 0), 1) AS d1, median(f1) AS m2, coalesce(nullif(stddev_pop(f1), 0), 1) AS d2 FROM p)
       SELECT uid, sqrt((((spacing - m1) / d1) * ((spacing - m1) / d1) + ((f1 - m2) / d2) * ((f1 - m2) / d2)) / 2) + 0.2 * coalesce(f2, 0) AS reference_score FROM p, s
       ORDER BY reference_score, uid LIMIT 1""",
    "fx_cohort",
)
def _(spark, sf):
    return t.reference_row(fx.cohort(spark, sf), "y", "shape_x", ["spacing", "f1"], "f2", "uid")


@query(
    "t10_pareto_front",
    "o_orderkey:i o_totalprice:d slack:d",
    """WITH o AS (SELECT o_orderkey, o_totalprice, CAST((o_orderkey * 7919) % 1009 AS DOUBLE) AS slack FROM orders)
       SELECT * FROM o a WHERE NOT EXISTS (SELECT 1 FROM o b WHERE b.o_totalprice >= a.o_totalprice AND b.slack >= a.slack AND (b.o_totalprice > a.o_totalprice OR b.slack > a.slack))""",
)
def _(spark, sf):
    o = fx.table(spark, sf, "orders").select(
        "o_orderkey", "o_totalprice", ((C("o_orderkey") * 7919) % 1009).cast("double").alias("slack")
    )
    return t.pareto_front(o, "o_totalprice", "slack")


@query(
    "u01_union_models",
    "uid:s a:d b:d c:d",
    """SELECT uid, m_a AS a, CAST(NULL AS DOUBLE) AS b, CAST(NULL AS DOUBLE) AS c FROM fx_wide UNION ALL SELECT uid, NULL, m_b, NULL FROM fx_wide
       UNION ALL SELECT uid, NULL, m_b, m_c FROM fx_wide""",
    "fx_wide",
)
def _(spark, sf):
    x = fx.wide_predictions(spark, sf)
    return t.union_models(
        [
            x.select("uid", C("m_a").alias("a")),
            x.select("uid", C("m_b").alias("b")),
            x.select("uid", C("m_b").alias("b"), C("m_c").alias("c")),
        ]
    )


@query(
    "u02_id_sets",
    "doc_id:i side:s",
    """SELECT coalesce(a.doc_id, b.doc_id) AS doc_id, CASE WHEN b.doc_id IS NULL THEN 'left' WHEN a.doc_id IS NULL THEN 'right' ELSE 'both' END AS side
       FROM (SELECT DISTINCT doc_id FROM documents WHERE doc_id % 4 <> 0) a FULL JOIN (SELECT DISTINCT doc_id FROM labels) b ON a.doc_id = b.doc_id""",
)
def _(spark, sf):
    d = fx.table(spark, sf, "documents").where(C("doc_id") % 4 != 0)
    return t.id_sets(d, fx.table(spark, sf, "labels"), "doc_id")


@query(
    "u03_append_new",
    "uid:s model:s prob:d",
    """SELECT uid, model, prob FROM fx_predictions WHERE model <> 'm_c' OR fold < 3
       UNION ALL SELECT uid, model, prob / 2 FROM fx_predictions WHERE NOT (model <> 'm_c' OR fold < 3)""",
    "fx_predictions",
)
def _(spark, sf):
    p = fx.predictions(spark, sf).select("uid", "model", "prob", "fold")
    have = p.where((C("model") != "m_c") | (C("fold") < 3)).drop("fold")
    extra = p.select("uid", "model", (C("prob") / 2).alias("prob"))
    return t.append_new(have, extra, ["uid", "model"])


@query(
    "u04_replace_partition",
    "uid:s model:s fold:i prob:d",
    "SELECT uid, model, fold, CASE WHEN model = 'm_b' AND fold IN (1, 3) THEN 1 - prob ELSE prob END AS prob FROM fx_predictions",
    "fx_predictions",
)
def _(spark, sf):
    p = fx.predictions(spark, sf).select("uid", "model", "fold", "prob")
    part = p.where((C("model") == "m_b") & C("fold").isin(1, 3)).withColumn("prob", 1 - C("prob"))
    return t.replace_partition(p, part, ["model", "fold"])


@query(
    "u05_unpivot_report",
    "uid:s metric:s value:d",
    " UNION ALL ".join(f"SELECT uid, '{m}' AS metric, {m} AS value FROM fx_wide" for m in ["m_a", "m_b", "m_c"]),
    "fx_wide",
)
def _(spark, sf):
    return t.unpivot_report(fx.wide_predictions(spark, sf), ["uid"], ["m_a", "m_b", "m_c"])
