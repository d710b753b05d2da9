"""Fold queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from cohortloom.functions.keyed import uniform_sql
from cohortloom.operators import folds as f
from cohortloom.plans import fixtures as fx
from cohortloom.registry import query
from cohortloom.session import scratch_path

C = F.col


def _strat(seed, source="fx_wide", part="", k=5):
    return f"""SELECT *, (row_number() OVER ({part} ORDER BY y + {uniform_sql(f"concat('{seed}|', uid)")}, uid) - 1) % {k} AS new_fold FROM {source}"""


def _group(seed, k):
    return f"CAST(floor({uniform_sql(f'concat(CAST({seed} AS VARCHAR), {chr(39)}|{chr(39)}, grp)')} * {k}) AS INT)"


@query("f01_stratified_folds", "uid:s y:i new_fold:i", _strat(3), "fx_wide")
def _(spark, sf):
    return f.stratified_folds(fx.wide_predictions(spark, sf).select("uid", "y"), 5, 3, "uid", "y", "new_fold")


@query("f02_group_folds", "uid:s grp:s new_fold:i", f"SELECT uid, grp, {_group(4, 5)} AS new_fold FROM fx_wide", "fx_wide")
def _(spark, sf):
    return f.group_folds(fx.wide_predictions(spark, sf).select("uid", "grp"), 5, 4, "grp", "new_fold")


def _best_sql(first, count, k):
    return f"""SELECT candidate, score FROM (
      SELECT candidate, stddev_pop(n) / greatest(avg(n), 1) + 2.5 * stddev_pop(prevalence) + 0.25 * stddev_pop(families) / greatest(avg(families), 1) + 0.75 * stddev_pop(v) AS score,
             count(*) AS folds, min(CASE WHEN pos > 0 AND pos < n THEN 1 ELSE 0 END) AS ok FROM (
        SELECT candidate, fold, CAST(count(*) AS DOUBLE) AS n, sum(y) AS pos, avg(y) AS prevalence, count(DISTINCT grp) AS families, avg(CASE WHEN valid THEN 1 ELSE 0 END) AS v
        FROM (SELECT grp, y, valid, candidate, {_group('candidate', k)} AS fold FROM fx_wide CROSS JOIN (SELECT unnest(range({first}, {first + count})) AS candidate)) GROUP BY candidate, fold) GROUP BY candidate)
      WHERE folds = {k} AND ok = 1"""


@query("f03_candidate_scores", "candidate:i score:d", _best_sql(100, 256, 5), "fx_wide")
def _(spark, sf):
    return f.score_candidates(fx.wide_predictions(spark, sf), 5, 100, "grp", "y", "valid", 256)


@query(
    "f03_best_fold_assignment",
    "uid:s grp:s new_fold:i",
    f"SELECT uid, grp, {_group('candidate', 5)} AS new_fold FROM fx_wide CROSS JOIN (SELECT candidate FROM ({_best_sql(100, 256, 5)}) ORDER BY score, candidate LIMIT 1)",
    "fx_wide",
)
def _(spark, sf):
    return f.best_fold_assignment(fx.wide_predictions(spark, sf), 5, 100, "grp", "y", "valid", 256, "new_fold")


@query(
    "f04_validate_folds",
    "rule:s n_bad:i",
    f"""WITH x AS ({_strat(3)}), d AS (SELECT uid, CASE WHEN uid = '9' THEN 1 - y ELSE y END AS y, CASE WHEN CAST(uid AS INT) % 50 = 0 THEN 'moved' ELSE grp END AS grp, new_fold FROM x WHERE CAST(uid AS INT) % 40 <> 1
          UNION ALL SELECT uid, y, grp, new_fold FROM x WHERE CAST(uid AS INT) % 60 = 2),
        e AS (SELECT x.uid, d.uid AS duid, x.y = d.y AS sy, x.grp = d.grp AS sg FROM x LEFT JOIN d ON x.uid = d.uid)
        SELECT 'repeated_key' AS rule, count(*) AS n_bad FROM (SELECT uid FROM d GROUP BY uid HAVING count(*) > 1)
        UNION ALL SELECT 'cohort_mismatch', count(*) FROM e WHERE duid IS NULL
        UNION ALL SELECT 'label_changed', count(*) FROM e WHERE NOT sy
        UNION ALL SELECT 'group_changed', count(*) FROM e WHERE NOT sg
        UNION ALL SELECT 'fold_ids', 5 - count(DISTINCT new_fold) FROM d
        UNION ALL SELECT 'one_class_fold', count(*) FROM (SELECT 1 FROM d GROUP BY new_fold HAVING min(y) = max(y))
        UNION ALL SELECT 'group_in_two_folds', count(*) FROM (SELECT 1 FROM d GROUP BY grp HAVING count(DISTINCT new_fold) > 1)""",
    "fx_wide",
)
def _(spark, sf):
    x = f.stratified_folds(fx.wide_predictions(spark, sf).select("uid", "y", "grp"), 5, 3, "uid", "y", "new_fold")
    n = C("uid").cast("int")
    damaged = x.where(n % 40 != 1).select(
        "uid", F.when(C("uid") == "9", 1 - C("y")).otherwise(C("y")).alias("y"), F.when(n % 50 == 0, "moved").otherwise(C("grp")).alias("grp"), "new_fold"
    )
    damaged = damaged.unionByName(x.where(n % 60 == 2).select("uid", "y", "grp", "new_fold"))
    return f.validate_folds(damaged, x, 5, "uid", "y", "grp", "new_fold")


_HASHED = """SELECT count(*) AS n, sum(a) AS a, sum(b) AS b, sum(c) AS c, sum(d) AS d FROM (SELECT {p} FROM (SELECT md5(concat(uid, '|', CAST(y AS VARCHAR), '|', grp)) AS m FROM fx_wide))""".format(
    p=", ".join(f"CAST(concat('0x', substr(m, {1 + 8 * i}, 8)) AS BIGINT) AS {x}" for i, x in enumerate("abcd"))
)


@query(
    "f05_cohort_hash",
    "n:i cohort_hash:s",
    f"SELECT n, sha256(concat_ws('|', CAST(n AS VARCHAR), CAST(a AS VARCHAR), CAST(b AS VARCHAR), CAST(c AS VARCHAR), CAST(d AS VARCHAR))) AS cohort_hash FROM ({_HASHED})",
    "fx_wide",
)
def _(spark, sf):
    return f.cohort_hash(fx.wide_predictions(spark, sf), ["uid", "y", "grp"])


@query("f06_freeze_folds", "uid:s y:i new_fold:i", _strat(3), "fx_wide")
def _(spark, sf):
    base = fx.wide_predictions(spark, sf).select("uid", "y", "grp")
    path = scratch_path(spark, "frozen")
    build = lambda df: f.stratified_folds(df, 5, 3, "uid", "y", "new_fold")
    f.freeze_folds(base, path, build, ["uid", "y", "grp"])
    return f.freeze_folds(base, path, build, ["uid", "y", "grp"])


@query(
    "f07_inner_folds",
    "held_out:i uid:s inner_fold:i",
    f"""SELECT held_out, uid, new_fold AS inner_fold FROM ({_strat(8, '(SELECT w.*, held_out FROM fx_wide w CROSS JOIN (SELECT unnest(range(5)) AS held_out) WHERE fold <> held_out)', 'PARTITION BY held_out', 3)})""",
    "fx_wide",
)
def _(spark, sf):
    return f.inner_folds(fx.wide_predictions(spark, sf).select("uid", "y", "fold"), "fold", 5, 3, 8, "uid", "y")


@query(
    "f08_group_holdout_stress",
    "uid:s grp:s stress_fold:i",
    f"SELECT uid, grp, {_group('candidate', 3)} AS stress_fold FROM fx_wide CROSS JOIN (SELECT candidate FROM ({_best_sql(900, 64, 3)}) ORDER BY score, candidate LIMIT 1)",
    "fx_wide",
)
def _(spark, sf):
    return f.group_holdout_stress(fx.wide_predictions(spark, sf), 900, "grp", "y", "valid")


@query("f03_best_patient_folds", "uid:s y:i new_fold:i")
def _(spark, sf):
    x = fx.wide_predictions(spark, sf).select("uid", "y", "grp", "valid")
    return f.best_patient_folds(x, 5, 20, "uid", "grp", "y", "valid", 3, "new_fold").select("uid", "y", "new_fold")
