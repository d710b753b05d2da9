"""Queries through the user-code hooks."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import functions as F

from cohortloom.functions import hooks
from cohortloom.plans import fixtures as fx
from cohortloom.registry import query

C = F.col


@query("x01_scalar_hook", "vec_id:i norm:d", "SELECT vec_id, sqrt(list_sum(list_transform(embedding, lambda e: CAST(e AS DOUBLE) * CAST(e AS DOUBLE)))) AS norm FROM embeddings")
def _(spark, sf):
    def norm(v: pd.Series) -> pd.Series:
        x = np.stack(v.to_numpy()).astype("float64") if len(v) else np.zeros((0, 1))
        return pd.Series(np.sqrt((x * x).sum(axis=1)))

    return fx.table(spark, sf, "embeddings").select("vec_id", hooks.scalar(norm)(C("embedding")).alias("norm"))


@query("x02_grouped_map", "uid:i peak:d spread:d", "SELECT uid, max(v) AS peak, max(v) - min(v) AS spread FROM fx_voxels GROUP BY uid", "fx_voxels")
def _(spark, sf):
    def one(pdf: pd.DataFrame) -> pd.DataFrame:
        return pd.DataFrame({"uid": [pdf["uid"].iloc[0]], "peak": [pdf["v"].max()], "spread": [pdf["v"].max() - pdf["v"].min()]})

    v = fx.voxels(spark, sf).select("uid", "v")
    return hooks.grouped_map(v, ["uid"], one, "uid long, peak double, spread double")


@query("x03_partition_map", "doc_id:i words:i", "SELECT doc_id, len(regexp_extract_all(text, '[^ \\t\\n\\r\\x0b\\x0c]+')) AS words FROM documents")
def _(spark, sf):
    def count(batches):
        for pdf in batches:
            yield pd.DataFrame({"doc_id": pdf["doc_id"], "words": pdf["text"].str.count(r"[^ \t\n\r\x0b\x0c]+").astype("int64")})

    return hooks.partition_map(fx.table(spark, sf, "documents").select("doc_id", "text"), count, "doc_id long, words long")


@query(
    "x04_grouped_aggregate",
    "model:s grp:s mae:d sure:d",
    "SELECT model, grp, avg(abs(y - prob)) AS mae, avg(CASE WHEN prob > 0.6 OR prob < 0.4 THEN 1 ELSE 0 END) AS sure FROM fx_predictions GROUP BY model, grp",
    "fx_predictions",
)
def _(spark, sf):
    p = fx.predictions(spark, sf)
    return p.groupBy("model", "grp").agg(
        hooks.mean_abs_error(C("y"), C("prob")).alias("mae"), hooks.share((C("prob") > 0.6) | (C("prob") < 0.4)).alias("sure")
    )


@query(
    "x05_table_function",
    "uid:s start:i stop:i",
    "SELECT uid, s AS start, s + 12 AS stop FROM (SELECT uid, unnest(list_distinct(list_concat(range(0, shape_x - 12 + 1, 8), [shape_x - 12]))) AS s FROM fx_cohort)",
    "fx_cohort",
)
def _(spark, sf):
    sizes = fx.cohort(spark, sf).select("uid", "shape_x")
    return sizes.lateralJoin(hooks.AxisWindows(C("shape_x").outer(), F.lit(12), F.lit(8)))
