"""Domain views over the given tables: predictions, trials, histories, cohort, voxels, coordinates.

Each view exists twice: as a DataFrame for the operators and as SQL for the oracle. None of them needs a shuffle
except ``predictions`` (label/document join).
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from cohortloom.functions.keyed import uniform, uniform_sql

MODELS = (("m_a", 0.35, 10000), ("m_b", 0.20, 10000), ("m_c", 0.10, 50))


def table(spark: SparkSession, sf: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf}/{name}.parquet")


def _models() -> F.Column:
    return F.explode(
        F.array(*[F.struct(F.lit(m).alias("model"), F.lit(c).alias("c"), F.lit(q).alias("q")) for m, c, q in MODELS])
    )


def predictions(spark: SparkSession, sf: str) -> DataFrame:
    base = (
        table(spark, sf, "labels")
        .join(table(spark, sf, "documents").select("doc_id", "source"), "doc_id")
        .select(
            F.col("doc_id").cast("string").alias("uid"),
            F.col("quality").alias("y"),
            F.col("source").alias("grp"),
            (F.col("toxic") == 0).alias("valid"),
        )
    )
    noise = (uniform(F.concat("m.model", F.lit("|"), "uid")) - F.lit(0.5)) * F.lit(0.8)
    raw = F.lit(0.5) + (F.col("y") - F.lit(0.5)) * F.col("m.c") + noise
    return base.select("*", _models().alias("m")).select(
        "uid",
        "y",
        "grp",
        "valid",
        F.col("m.model").alias("model"),
        F.floor(uniform(F.concat(F.lit("fold|"), "uid")) * 5).cast("int").alias("fold"),
        F.greatest(F.lit(0.01), F.least(F.lit(0.99), F.floor(raw * F.col("m.q")) / F.col("m.q"))).alias("prob"),
    )


def wide_predictions(spark: SparkSession, sf: str) -> DataFrame:
    from cohortloom.operators.profile import pivot_predictions

    return pivot_predictions(
        predictions(spark, sf), ["uid", "y", "grp", "valid", "fold"], "model", "prob", [m for m, _, _ in MODELS]
    )


def trials(spark: SparkSession, sf: str) -> DataFrame:
    o = table(spark, sf, "orders")
    key, cust = F.col("o_orderkey"), F.col("o_custkey")
    return o.select(
        F.col("o_orderpriority").alias("run_key"),
        F.concat(F.lit("study_"), (cust % 7).cast("string")).alias("study"),
        key.alias("number"),
        F.when(F.col("o_orderstatus") == "F", "COMPLETE")
        .when(F.col("o_orderstatus") == "O", "RUNNING")
        .otherwise("FAIL")
        .alias("state"),
        F.when(F.col("o_orderstatus") == "F", F.col("o_totalprice") / F.lit(1000000.0)).alias("value"),
        ((key % 97) * F.lit(1.5) - 3).cast("double").alias("duration"),
        F.concat(
            F.lit('{"depth":'), (cust % 9).cast("string"), F.lit(',"rate":"'), (cust % 5).cast("string"), F.lit('"}')
        ).alias("params_json"),
        F.concat(
            F.lit("["), (key % 10).cast("string"), F.lit(".5,"), (cust % 10).cast("string"), F.lit(".25]")
        ).alias("fold_scores_json"),
    )


def histories(spark: SparkSession, sf: str) -> DataFrame:
    e = table(spark, sf, "events")
    return e.select(
        F.col("event_type").alias("run_key"),
        F.col("user_id").alias("trajectory"),
        F.col("event_id").alias("epoch"),
        (F.lit(1.0) / (1 + F.col("event_id") % 23)).alias("train_loss"),
        F.when(F.col("event_id") % 4 != 0, F.col("value") / F.lit(500.0)).alias("valid_loss"),
    )


def cohort(spark: SparkSession, sf: str) -> DataFrame:
    p = table(spark, sf, "part")
    key, size, price = F.col("p_partkey"), F.col("p_size"), F.col("p_retailprice")
    return p.select(
        key.cast("string").alias("uid"),
        (32 + 8 * (size % 3)).alias("shape_x"),
        F.lit(32).alias("shape_y"),
        (30 + size % 2).alias("shape_z"),
        (F.lit(2.0) + F.lit(0.125) * (size % 4)).alias("spacing"),
        F.when(key % 11 != 0, size % 2).alias("y"),
        price.alias("f1"),
        F.when(key % 13 != 0, size.cast("double")).alias("f2"),
        F.ln(price).alias("f3"),
    )


def voxels(spark: SparkSession, sf: str) -> DataFrame:
    e = table(spark, sf, "embeddings")
    i = F.col("i")
    x, y_, z = i % 4, F.floor(i / 4).cast("int") % 4, F.floor(i / 16).cast("int")
    dist = sum(((c - F.lit(1.5)) * (c - F.lit(1.5)) for c in (z, y_, x)), F.lit(0.0))
    return e.select("vec_id", "label", F.posexplode("embedding").alias("i", "v")).select(
        F.col("vec_id").alias("uid"),
        (F.col("label") % 2).alias("y"),
        F.col("label").alias("grp"),
        z.alias("z"),
        y_.alias("y_"),
        x.alias("x"),
        F.col("v").cast("double").alias("v"),
        (dist <= 4.5).alias("m"),
    )


def coords(spark: SparkSession, sf: str) -> DataFrame:
    e = table(spark, sf, "embeddings")
    pair = F.explode(
        F.array(
            *[
                F.struct(
                    F.element_at("embedding", 2 * s + 1).cast("double").alias("c1"),
                    F.element_at("embedding", 2 * s + 2).cast("double").alias("c2"),
                    F.lit(s).alias("seed"),
                )
                for s in range(3)
            ]
        )
    )
    return e.select(
        F.col("vec_id").alias("uid"), (F.col("label") % 2).alias("y"), F.col("label").alias("grp"), pair.alias("p")
    ).select("uid", "y", "grp", "p.*")


def features(spark: SparkSession, sf: str) -> DataFrame:
    """One row per vector with eight numeric columns, for preparation and model jobs."""
    e = table(spark, sf, "embeddings")
    return e.select(
        F.col("vec_id").alias("uid"),
        (F.col("label") % 2).alias("y"),
        F.col("label").alias("grp"),
        F.floor(uniform(F.concat(F.lit("fold|"), F.col("vec_id").cast("string"))) * 5).cast("int").alias("fold"),
        (F.col("vec_id") % 5 != 0).alias("valid"),
        *[
            F.when(F.col("vec_id") % 17 != i, F.element_at("embedding", i + 1).cast("double")).alias(f"x{i}")
            for i in range(8)
        ],
    )


def big_predictions(spark: SparkSession, sf: str) -> DataFrame:
    li = table(spark, sf, "lineitem")
    uid = F.concat(F.col("l_orderkey").cast("string"), F.lit("-"), F.col("l_linenumber").cast("string"))
    return (
        li.select(
            uid.alias("uid"),
            F.when(F.col("l_returnflag") == "R", 1).otherwise(0).alias("y"),
            F.col("l_suppkey").alias("grp"),
            _models().alias("m"),
        )
        .select(
            "uid",
            "y",
            "grp",
            F.col("m.model").alias("model"),
            F.floor(uniform(F.concat(F.lit("fold|"), "uid")) * 5).cast("int").alias("fold"),
            uniform(F.concat("m.model", F.lit("|"), "uid")).alias("prob"),
        )
    )


def _d(number: float) -> str:
    return f"CAST({number!r} AS DOUBLE)"


_MODELS_SQL = " UNION ALL ".join(
    f"SELECT '{m}' AS model, {_d(c)} AS c, {q} AS q" for m, c, q in MODELS
)
_VOX = "CAST(floor(i/16) AS INT) AS z, CAST(floor(i/4) AS INT) % 4 AS y_, CAST(i % 4 AS INT) AS x"

VIEWS: dict[str, str] = {
    "fx_predictions": f"""
  SELECT b.uid, b.y, b.grp, b.valid, m.model,
         CAST(floor({uniform_sql("concat('fold|', b.uid)")} * 5) AS INT) AS fold,
         greatest({_d(0.01)}, least({_d(0.99)}, floor(({_d(0.5)} + (b.y - {_d(0.5)}) * m.c
           + ({uniform_sql("concat(m.model, '|', b.uid)")} - {_d(0.5)}) * {_d(0.8)}) * m.q) / m.q)) AS prob
  FROM (SELECT CAST(l.doc_id AS VARCHAR) AS uid, l.quality AS y, d.source AS grp, l.toxic = 0 AS valid
        FROM labels l JOIN documents d ON l.doc_id = d.doc_id) b CROSS JOIN ({_MODELS_SQL}) m""",
    "fx_wide": """
  SELECT uid, y, grp, valid, fold, max(CASE WHEN model='m_a' THEN prob END) AS m_a,
         max(CASE WHEN model='m_b' THEN prob END) AS m_b, max(CASE WHEN model='m_c' THEN prob END) AS m_c
  FROM fx_predictions GROUP BY ALL""",
    "fx_trials": """
  SELECT o_orderpriority AS run_key, concat('study_', CAST(o_custkey % 7 AS VARCHAR)) AS study, o_orderkey AS number,
         CASE o_orderstatus WHEN 'F' THEN 'COMPLETE' WHEN 'O' THEN 'RUNNING' ELSE 'FAIL' END AS state,
         CASE WHEN o_orderstatus = 'F' THEN o_totalprice / CAST(1000000 AS DOUBLE) END AS value,
         CAST((o_orderkey % 97) * CAST(1.5 AS DOUBLE) - 3 AS DOUBLE) AS duration,
         concat('{"depth":', CAST(o_custkey % 9 AS VARCHAR), ',"rate":"', CAST(o_custkey % 5 AS VARCHAR), '"}') AS params_json,
         concat('[', CAST(o_orderkey % 10 AS VARCHAR), '.5,', CAST(o_custkey % 10 AS VARCHAR), '.25]') AS fold_scores_json
  FROM orders""",
    "fx_histories": """
  SELECT event_type AS run_key, user_id AS trajectory, event_id AS epoch,
         CAST(1 AS DOUBLE) / (1 + event_id % 23) AS train_loss,
         CASE WHEN event_id % 4 <> 0 THEN value / CAST(500 AS DOUBLE) END AS valid_loss
  FROM events""",
    "fx_cohort": """
  SELECT CAST(p_partkey AS VARCHAR) AS uid, 32 + 8 * (p_size % 3) AS shape_x, 32 AS shape_y, 30 + (p_size % 2) AS shape_z,
         CAST(2 AS DOUBLE) + CAST(0.125 AS DOUBLE) * (p_size % 4) AS spacing,
         CASE WHEN p_partkey % 11 <> 0 THEN p_size % 2 END AS y, p_retailprice AS f1,
         CASE WHEN p_partkey % 13 <> 0 THEN CAST(p_size AS DOUBLE) END AS f2, ln(p_retailprice) AS f3
  FROM part""",
    "fx_voxels": f"""
  SELECT *, (z-{_d(1.5)})*(z-{_d(1.5)}) + (y_-{_d(1.5)})*(y_-{_d(1.5)}) + (x-{_d(1.5)})*(x-{_d(1.5)}) <= 4.5 AS m
  FROM (SELECT vec_id AS uid, label % 2 AS y, label AS grp, {_VOX}, CAST(v AS DOUBLE) AS v
        FROM (SELECT vec_id, label, unnest(range(len(embedding))) AS i, unnest(embedding) AS v FROM embeddings))""",
    "fx_coords": " UNION ALL ".join(
        f"""
  SELECT vec_id AS uid, label % 2 AS y, label AS grp, CAST(embedding[{2 * s + 1}] AS DOUBLE) AS c1,
         CAST(embedding[{2 * s + 2}] AS DOUBLE) AS c2, {s} AS seed FROM embeddings"""
        for s in range(3)
    ),
    "fx_features": f"""
  SELECT vec_id AS uid, label % 2 AS y, label AS grp,
         CAST(floor({uniform_sql("concat('fold|', CAST(vec_id AS VARCHAR))")} * 5) AS INT) AS fold, vec_id % 5 <> 0 AS valid,
         {", ".join(f"CASE WHEN vec_id % 17 <> {i} THEN CAST(embedding[{i + 1}] AS DOUBLE) END AS x{i}" for i in range(8))}
  FROM embeddings""",
    "fx_big": f"""
  SELECT uid, y, grp, model, CAST(floor({uniform_sql("concat('fold|', uid)")} * 5) AS INT) AS fold,
         {uniform_sql("concat(model, '|', uid)")} AS prob
  FROM (SELECT concat(CAST(l_orderkey AS VARCHAR), '-', CAST(l_linenumber AS VARCHAR)) AS uid,
               CASE WHEN l_returnflag = 'R' THEN 1 ELSE 0 END AS y, l_suppkey AS grp FROM lineitem)
  CROSS JOIN ({_MODELS_SQL}) m""",
}
_NEEDS = {"fx_wide": ["fx_predictions"]}


def view_sql(names: list[str]) -> str:
    """The WITH clause that defines the named views (empty for none)."""
    ordered: list[str] = []
    for name in names:
        for item in [*_NEEDS.get(name, []), name]:
            if item not in ordered:
                ordered.append(item)
    if not ordered:
        return ""
    return "WITH " + ",\n".join(f"{n} AS ({VIEWS[n]})" for n in ordered) + "\n"
