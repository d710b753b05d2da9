"""Calibration queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from cohortloom.functions.scalar import EPS, logit
from cohortloom.operators import calibrate as c
from cohortloom.operators.metrics import binary_metrics
from cohortloom.plans import fixtures as fx
from cohortloom.registry import query

C = F.col
_P = "greatest(least(prob, 1 - CAST({eps!r} AS DOUBLE)), CAST({eps!r} AS DOUBLE))".format(eps=EPS)
_DESIGN = {"temperature": [f"ln({_P} / (1 - {_P}))"], "platt": [f"ln({_P} / (1 - {_P}))", "CAST(1 AS DOUBLE)"], "beta": [f"ln({_P})", f"-ln(1 - {_P})", "CAST(1 AS DOUBLE)"]}


def newton_sql(source, keys, method, crossed=False, steps=25):
    """Weights by plain Newton steps from the anchor: the zero of the gradient, for optima inside the bounds."""
    xs, anchor = _DESIGN[method], {"temperature": (1.0,), **c.ANCHORS}[method]
    ridge = 0.0 if method == "temperature" else c.RIDGE
    d = range(len(xs))
    ids = [*keys, *(["held"] if crossed else [])]
    k = "".join(f"t.{i}, " for i in ids)
    h = {(i, j): f"h{min(i, j)}{max(i, j)}" for i in d for j in d}
    if len(xs) == 1:
        moves = ["g0 / h00"]
    elif len(xs) == 2:
        moves = ["(h11 * g0 - h01 * g1) / (h00 * h11 - h01 * h01)", "(h00 * g1 - h01 * g0) / (h00 * h11 - h01 * h01)"]
    else:
        sign = lambda i, j: "" if (i + j) % 2 == 0 else "-"
        det = " + ".join(f"{h[0, j]} * ({sign(0, j)}{_minor(h, d, 0, j)})" for j in d)
        moves = ["(" + " + ".join(f"({sign(i, j)}{_minor(h, d, j, i)}) * g{j}" for j in d) + f") / ({det})" for i in d]
    on = " AND ".join([*[f"t.{x} = d.{x}" for x in keys], *(["t.held <> d.fold"] if crossed else [])]) or "true"
    z = " + ".join(f"t.w{i} * d.x{i}" for i in d)
    s = f"(1 / (1 + exp(-({z}))))"
    ridge_of = lambda i: f" + 2 * CAST({ridge!r} AS DOUBLE) * (t.w{i} - {anchor[i]})" if ridge else ""
    sums = [f"avg(d.x{i} * ({s} - d.y)){ridge_of(i)} AS g{i}" for i in d]
    sums += [f"avg(d.x{i} * d.x{j} * {s} * (1 - {s})){f' + 2 * CAST({ridge!r} AS DOUBLE)' if ridge and i == j else ''} AS h{i}{j}" for i in d for j in d if i <= j]
    names = ", ".join(f"w{i}" for i in d)
    plain = "".join(f"{i}, " for i in ids)
    return f"""(WITH RECURSIVE d AS (SELECT *, {', '.join(f'{x} AS x{i}' for i, x in enumerate(xs))} FROM {source}),
      t AS (SELECT {plain} 0 AS k, {', '.join(f'CAST({a!r} AS DOUBLE) AS w{i}' for i, a in enumerate(anchor))} FROM (SELECT DISTINCT {', '.join([*keys, *(['fold AS held'] if crossed else [])]) or '1 AS one'} FROM {source})
        UNION ALL SELECT {plain} k + 1, {', '.join(f'w{i} - {m}' for i, m in enumerate(moves))} FROM (
          SELECT {k} t.k, {', '.join(f't.w{i}' for i in d)}, {', '.join(sums)} FROM t JOIN d ON {on} WHERE t.k < {steps} GROUP BY {k} t.k, {', '.join(f't.w{i}' for i in d)}))
      SELECT {plain} {names} FROM t WHERE k = {steps})"""


def _minor(h, d, i, j):
    (a, b), (x, y) = [r for r in d if r != i], [r for r in d if r != j]
    return f"({h[a, x]} * {h[b, y]} - {h[a, y]} * {h[b, x]})"


def crossed_sql(source, keys, method):
    """``source`` with the probability of the map fitted on the other folds."""
    weights = newton_sql(source, keys, method, True)
    on = " AND ".join([*[f"w.{x} = p.{x}" for x in keys], "w.held = p.fold"])
    z = " + ".join(f"w.w{i} * p.x{i}" for i in range(len(_DESIGN[method])))
    return f"(SELECT p.*, 1 / (1 + exp(-({z}))) AS calibrated FROM (SELECT *, {', '.join(f'{x} AS x{i}' for i, x in enumerate(_DESIGN[method]))} FROM {source}) p JOIN {weights} w ON {on})"


@query("c01_fit_temperature", "model:s temperature:d", f"SELECT model, 1 / w0 AS temperature FROM {newton_sql('fx_predictions', ['model'], 'temperature')}", "fx_predictions")
def _(spark, sf):
    x = fx.predictions(spark, sf).withColumn("z", logit(C("prob")))
    return c.fit_temperature(x, ["model"], "y", "z")


@query(
    "c02_apply_temperature",
    "uid:s model:s calibrated:d",
    """SELECT uid, model, 1 / (1 + exp(-greatest(least(ln(prob / (1 - prob)) / (1 + fold / CAST(4 AS DOUBLE)), CAST(40 AS DOUBLE)), CAST(-40 AS DOUBLE)))) AS calibrated FROM fx_predictions""",
    "fx_predictions",
)
def _(spark, sf):
    x = fx.predictions(spark, sf)
    temps = x.select("fold").distinct().withColumn("temperature", F.lit(1.0) + C("fold") / F.lit(4.0))
    j = x.join(temps, "fold")
    return j.select("uid", "model", c.apply_temperature(logit(C("prob")), C("temperature")).alias("calibrated"))


@query("c03_fit_platt", "model:s w0:d w1:d", f"SELECT * FROM {newton_sql('fx_predictions', ['model'], 'platt')}", "fx_predictions")
def _(spark, sf):
    return c.fit(fx.predictions(spark, sf), ["model"], "y", "prob", "platt")


@query("c04_fit_beta", "model:s w0:d w1:d w2:d", f"SELECT * FROM {newton_sql('fx_predictions', ['model'], 'beta')}", "fx_predictions")
def _(spark, sf):
    return c.fit(fx.predictions(spark, sf), ["model"], "y", "prob", "beta")


@query("c05_crossfit_temperature", "uid:s model:s fold:i calibrated:d", f"SELECT * FROM {crossed_sql('fx_predictions', ['model'], 'temperature')}", "fx_predictions")
def _(spark, sf):
    return c.crossfit_calibrate(fx.predictions(spark, sf), ["model"], "y", "prob", "fold", "temperature")


@query("c05_crossfit_platt_metrics", "model:s n:i log_loss:d brier:d auc:d ece:d")
def _(spark, sf):
    x = c.crossfit_calibrate(fx.predictions(spark, sf), ["model"], "y", "prob", "fold", "platt")
    return binary_metrics(x, ["model"], "y", "calibrated")
