"""Join queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from cohortloom.functions.scalar import explode_fold_scores, row_log_loss
from cohortloom.operators import joins as j
from cohortloom.plans import fixtures as fx
from cohortloom.registry import query

C = F.col


@query(
    "j01_join_one_to_one",
    "c_custkey:i c_acctbal:d spent:d",
    """SELECT c_custkey, c_acctbal, spent FROM customer LEFT JOIN (SELECT o_custkey, sum(o_totalprice) AS spent FROM orders GROUP BY o_custkey)
       ON c_custkey = o_custkey""",
)
def _(spark, sf):
    spent = fx.table(spark, sf, "orders").groupBy(C("o_custkey").alias("c_custkey")).agg(F.sum("o_totalprice").alias("spent"))
    return j.join_one_to_one(fx.table(spark, sf, "customer").select("c_custkey", "c_acctbal"), spent, ["c_custkey"], "left")


@query(
    "j02_join_complete",
    "uid:s model:s y:i prob:d loss:d",
    "SELECT uid, model, y, prob, -(y * ln(prob) + (1 - y) * ln(1 - prob)) AS loss FROM fx_predictions",
    "fx_predictions",
)
def _(spark, sf):
    p = fx.predictions(spark, sf)
    left = p.select("uid", "model", "y", "prob")
    right = p.select("uid", "model", "y", row_log_loss(C("y"), C("prob")).alias("loss"))
    return j.join_complete(left, right, ["uid", "model"], "y")


@query(
    "j03_join_many_to_one",
    "l_orderkey:i l_linenumber:i s_name:s s_acctbal:d",
    "SELECT l_orderkey, l_linenumber, s_name, s_acctbal FROM lineitem LEFT JOIN supplier ON l_suppkey = s_suppkey",
)
def _(spark, sf):
    li = fx.table(spark, sf, "lineitem").select("l_orderkey", "l_linenumber", "l_suppkey")
    sup = fx.table(spark, sf, "supplier").select(C("s_suppkey").alias("l_suppkey"), "s_name", "s_acctbal")
    return j.join_many_to_one(li, sup, ["l_suppkey"])


@query(
    "j04_reconcile",
    "doc_id:i side:s same_flag:b",
    """SELECT coalesce(a.doc_id, b.doc_id) AS doc_id, CASE WHEN b.doc_id IS NULL THEN 'left' WHEN a.doc_id IS NULL THEN 'right' ELSE 'both' END AS side,
       a.flag IS NOT DISTINCT FROM b.flag AS same_flag
       FROM (SELECT doc_id, quality AS flag FROM labels) a FULL JOIN (SELECT doc_id, CASE WHEN n_chars > 300 THEN 1 ELSE 0 END AS flag FROM documents WHERE doc_id % 3 <> 0) b ON a.doc_id = b.doc_id""",
)
def _(spark, sf):
    a = fx.table(spark, sf, "labels").select("doc_id", C("quality").alias("flag"))
    b = fx.table(spark, sf, "documents").where(C("doc_id") % 3 != 0).select("doc_id", (C("n_chars") > 300).cast("int").alias("flag"))
    return j.reconcile(a, b, ["doc_id"], ["flag"])


@query(
    "j05_pending",
    "doc_id:i source:s status:s",
    """SELECT doc_id, source, 'pending' AS status FROM documents WHERE doc_id NOT IN (SELECT doc_id FROM labels)
       UNION ALL SELECT doc_id, source, 'done' FROM documents WHERE doc_id IN (SELECT doc_id FROM labels)""",
)
def _(spark, sf):
    d, lab = fx.table(spark, sf, "documents").select("doc_id", "source"), fx.table(spark, sf, "labels")
    todo = j.pending(d, lab, ["doc_id"]).withColumn("status", F.lit("pending"))
    return todo.unionByName(j.present(d, lab, ["doc_id"]).withColumn("status", F.lit("done")))


_TRIAL_KEYED = "SELECT run_key, study, CAST(regexp_extract(params_json, '[0-9]+') AS BIGINT) AS depth, number, state, value FROM fx_trials"


@query(
    "j06_lookup_best_state",
    "o_orderkey:i state:s number:i value:d",
    f"""SELECT h.number AS o_orderkey, coalesce(t.state, 'UNMAPPED_OR_ACTIVE') AS state, t.number, t.value FROM ({_TRIAL_KEYED}) h
        LEFT JOIN (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY run_key, study, depth ORDER BY
          CASE state WHEN 'COMPLETE' THEN 0 WHEN 'RUNNING' THEN 1 WHEN 'FAIL' THEN 4 ELSE 9 END, number) AS rn FROM ({_TRIAL_KEYED}) WHERE depth <> 4) WHERE rn = 1) t
        ON h.run_key = t.run_key AND h.study = t.study AND h.depth = t.depth""",
    "fx_trials",
)
def _(spark, sf):
    t = fx.trials(spark, sf).withColumn("depth", F.regexp_extract("params_json", "[0-9]+", 0).cast("long"))
    logs = t.select("run_key", "study", "depth", C("number").alias("o_orderkey"))
    return j.lookup_best_state(
        logs, t.where(C("depth") != 4), ["run_key", "study", "depth"], "state", "number", ["value"]
    )


@query(
    "j07_coalesce_join",
    "c_custkey:i c_acctbal:d c_mktsegment:s",
    """SELECT c_custkey, coalesce(b, c_acctbal) AS c_acctbal, coalesce(s, c_mktsegment) AS c_mktsegment FROM customer
       LEFT JOIN (SELECT c_custkey AS k, c_acctbal * 2 AS b, CASE WHEN c_custkey % 4 = 0 THEN 'NEW' END AS s FROM customer WHERE c_custkey % 2 = 0) ON c_custkey = k""",
)
def _(spark, sf):
    c = fx.table(spark, sf, "customer").select("c_custkey", "c_acctbal", "c_mktsegment")
    o = c.where(C("c_custkey") % 2 == 0).select(
        "c_custkey", (C("c_acctbal") * 2).alias("c_acctbal"), F.when(C("c_custkey") % 4 == 0, "NEW").alias("c_mktsegment")
    )
    return j.coalesce_join(c, o, ["c_custkey"], ["c_acctbal", "c_mktsegment"])


@query(
    "j08_pairs_self_join",
    "uid:s a:s b:s pa:d pb:d",
    """SELECT l.uid, l.model AS a, r.model AS b, l.prob AS pa, r.prob AS pb FROM fx_predictions l JOIN fx_predictions r
       ON l.uid = r.uid AND l.model < r.model""",
    "fx_predictions",
)
def _(spark, sf):
    return j.pairs_self_join(fx.predictions(spark, sf), ["uid"], "model", "prob")


_SCORES = """SELECT run_key, study, number, i - 1 AS fold, CAST(json_extract_string(fold_scores_json, concat('$[', CAST(i - 1 AS VARCHAR), ']')) AS DOUBLE) AS score
       FROM fx_trials CROSS JOIN (SELECT unnest([1, 2]) AS i)"""


@query(
    "j09_best_trial_folds",
    "run_key:s study:s number:i value:d fold:i score:d",
    f"""SELECT s.run_key, s.study, s.number, b.value, s.fold, s.score FROM ({_SCORES}) s JOIN (
        SELECT run_key, study, number, value FROM (SELECT *, row_number() OVER (PARTITION BY run_key, study ORDER BY value, number) AS rn
        FROM fx_trials WHERE value IS NOT NULL) WHERE rn = 1) b ON s.run_key = b.run_key AND s.study = b.study AND s.number = b.number""",
    "fx_trials",
)
def _(spark, sf):
    t = fx.trials(spark, sf)
    scores = explode_fold_scores(t.select("run_key", "study", "number", "fold_scores_json"), "fold_scores_json")
    return j.best_trial_folds(t, scores, ["run_key", "study"], "number", "value")


@query(
    "j10_cross_grid",
    "model:s threshold:d3 flagged:i mean_prob:d",
    """SELECT model, t / CAST(20 AS DOUBLE) AS threshold, sum(CASE WHEN prob >= t / CAST(20 AS DOUBLE) THEN 1 ELSE 0 END) AS flagged,
       avg(CASE WHEN prob >= t / CAST(20 AS DOUBLE) THEN prob END) AS mean_prob FROM fx_predictions CROSS JOIN (SELECT unnest(range(21)) AS t) GROUP BY model, t""",
    "fx_predictions",
)
def _(spark, sf):
    p = fx.predictions(spark, sf).select("model", "prob")
    grid = j.cross_grid(p, "threshold", 21).withColumn("threshold", F.round("threshold", 2))
    hit = C("prob") >= C("threshold")
    return grid.groupBy("model", "threshold").agg(F.sum(hit.cast("int")).alias("flagged"), F.avg(F.when(hit, C("prob"))).alias("mean_prob"))


@query(
    "j13_assert_aligned",
    "n_keys:i incomplete:i repeated:i label_conflicts:i",
    """SELECT count(*) AS n_keys, sum(CASE WHEN m <> 3 THEN 1 ELSE 0 END) AS incomplete, sum(CASE WHEN n > m THEN 1 ELSE 0 END) AS repeated,
       sum(CASE WHEN lo <> hi THEN 1 ELSE 0 END) AS label_conflicts FROM (SELECT uid, count(DISTINCT model) AS m, count(*) AS n, min(yy) AS lo, max(yy) AS hi FROM (
         SELECT uid, model, CASE WHEN model = 'm_c' AND fold = 0 THEN 1 - y ELSE y END AS yy FROM fx_predictions WHERE NOT (model = 'm_b' AND fold = 1)
         UNION ALL SELECT uid, model, y FROM fx_predictions WHERE model = 'm_a' AND fold = 2) GROUP BY uid)""",
    "fx_predictions",
)
def _(spark, sf):
    p = fx.predictions(spark, sf)
    y = F.when((C("model") == "m_c") & (C("fold") == 0), 1 - C("y")).otherwise(C("y"))
    damaged = p.where(~((C("model") == "m_b") & (C("fold") == 1))).select("uid", "model", y.alias("y"))
    again = p.where((C("model") == "m_a") & (C("fold") == 2)).select("uid", "model", "y")
    return j.assert_aligned(damaged.unionByName(again), "uid", "model", "y", 3)
