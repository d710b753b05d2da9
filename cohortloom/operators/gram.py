"""Sums of products of every pair of columns for hundreds of columns: outer products of batches, added up by rows.

A task multiplies its batches as matrices and gives one row per column with the sums against all others; these are added
up in two steps, so that no task sees more than a bounded number of partial rows. Plans hold no expression per pair.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Rows that are multiplied at once, and partial sums that meet in the first step.
ROWS, FAN = 4096, 64
#: For columns i and j, over rows where both are present: count, products, sums and squares of i and of j.
SUMS = ("n", "c", "s", "t", "q", "r")
_TYPES = "i int, part int, " + ", ".join(f"{s} array<double>" for s in SUMS)


def _rows_of(sums: np.ndarray, part: int) -> pa.RecordBatch:
    p = sums.shape[1]
    offsets = pa.array(np.arange(p + 1, dtype=np.int32) * p)
    lists = [pa.ListArray.from_arrays(offsets, pa.array(block.ravel())) for block in sums]
    return pa.RecordBatch.from_arrays([pa.array(np.arange(p, dtype=np.int32)), pa.array(np.full(p, part, np.int32)), *lists], names=["i", "part", *SUMS])


def _added(table: pa.Table) -> pa.Table:
    arrays = [np.stack([np.asarray(v.values) for v in table.column(s)]).sum(axis=0) for s in SUMS]
    columns = [table.column("i").slice(0, 1), table.column("part").slice(0, 1), *[pa.array([a.tolist()], pa.list_(pa.float64())) for a in arrays]]
    return pa.table(columns, names=["i", "part", *SUMS])


def pair_sums(df: DataFrame, cols: Sequence[str], centers: Sequence[float]) -> DataFrame:
    """(i, n, c, s, t, q, r): one row per column with its sums against every column, of values less their center. NULL and
    NaN count as missing."""
    p, shift = len(cols), np.array(centers, dtype=float)

    def multiply(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums, part = np.zeros((len(SUMS), p, p)), 0
        for batch in batches:
            part = batch.column("_part")[0].as_py() if batch.num_rows else part
            for start in range(0, batch.num_rows, ROWS):
                some = batch.slice(start, ROWS)
                x = np.column_stack([np.asarray(some.column(i).fill_null(np.nan)) for i in range(p)]) - shift
                m = (~np.isnan(x)).astype(float)
                x = np.nan_to_num(x)
                sums += np.stack([m.T @ m, x.T @ x, x.T @ m, m.T @ x, (x * x).T @ m, m.T @ (x * x)])
        yield _rows_of(sums, part)

    values = df.select(*[F.col(c).cast("double").alias(f"x{i}") for i, c in enumerate(cols)], F.spark_partition_id().alias("_part"))
    partial = values.mapInArrow(multiply, _TYPES)
    first = partial.withColumn("part", (F.col("part") / F.lit(FAN)).cast("int")).groupBy("i", "part").applyInArrow(_added, _TYPES)
    return first.groupBy("i").applyInArrow(_added, _TYPES).drop("part")


def means(df: DataFrame, cols: Sequence[str]) -> list[float]:
    """Mean of every column (0 where it has no value): a few numbers on the driver."""
    row = df.agg(*[F.avg(F.when(~F.isnan(F.col(c).cast("double")), F.col(c).cast("double"))).alias(f"x{i}") for i, c in enumerate(cols)]).first()
    return [row[i] or 0.0 for i in range(len(cols))]


def correlations(df: DataFrame, cols: Sequence[str]) -> DataFrame:
    """(a, b, corr) of every column pair in order, over rows where both are present; NULL without spread."""
    names, centers = list(cols), means(df, cols)
    scale = np.abs(np.array(centers))

    def pairs(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in range(batch.num_rows):
                i = batch.column("i")[row].as_py()
                n, c, s, t, q, r = (np.asarray(batch.column(k)[row].values)[i + 1 :] for k in SUMS)
                with np.errstate(all="ignore"):
                    one, two = q - s * s / n, r - t * t / n
                    flat = (one <= n * (1e-14 * scale[i]) ** 2) | (two <= n * (1e-14 * scale[i + 1 :]) ** 2) | (n < 1)
                    found = np.clip((c - s * t / n) / np.sqrt(one * two), -1.0, 1.0)
                arrays = [pa.array([names[i]] * len(n), pa.string()), pa.array(names[i + 1 :], pa.string()), pa.array(found, mask=flat | np.isnan(found))]
                yield pa.RecordBatch.from_arrays(arrays, names=["a", "b", "corr"])

    return pair_sums(df, cols, centers).mapInArrow(pairs, "a string, b string, corr double")


def covariance(df: DataFrame, cols: Sequence[str]) -> tuple[list[float], np.ndarray]:
    """Means and the covariance (divided by the count) over rows where both columns are present: p x p numbers."""
    centers = means(df, cols)
    out = np.zeros((len(cols), len(cols)))
    for row in pair_sums(df, cols, centers).select("i", "n", "c", "s", "t").collect():
        n = np.maximum(np.array(row["n"]), 1.0)
        out[row["i"]] = np.array(row["c"]) / n
    return centers, out
