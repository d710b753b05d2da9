"""Codes, category indexes and column guessing: small dimension tables built from large columns."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cohortloom.operators.order import null_safe, running, text_cell


def category_index(df: DataFrame, col: str, out: str) -> DataFrame:
    """Zero-based index of each value among the sorted distinct values (text order)."""
    distinct = df.select(col).where(F.col(col).isNotNull()).distinct()
    coded = running(distinct, [], col, {"_rn": ("row_number", None)}, cell=text_cell(distinct, col))
    return null_safe(df, coded.select(col, (F.col("_rn") - 1).alias(out)), [col], "left")


def family_code(df: DataFrame, col: str, out: str, prefix: str = "AF", width: int = 3) -> DataFrame:
    """Dense code ``AF001``... over sorted distinct signatures."""
    indexed = category_index(df, col, "_index")
    number = (F.col("_index") + 1).cast("string")
    padded = F.when(F.length(number) >= width, number).otherwise(F.lpad(number, width, "0"))
    return indexed.withColumn(out, F.concat(F.lit(prefix), padded)).drop("_index")


def distinct_counts(df: DataFrame) -> DataFrame:
    """Per column: rows, non-null rows and exact distinct non-null values, in one pass over the unpivoted table."""
    cells = F.explode(
        F.array(
            *[
                F.struct(F.lit(c).alias("feature"), F.col(f"`{c}`").cast("string").alias("value"))
                for c in df.columns
            ]
        )
    )
    counted = df.select(cells.alias("e")).groupBy("e.feature", "e.value").agg(F.count(F.lit(1)).alias("n"))
    return counted.groupBy("feature").agg(
        F.sum("n").alias("n_rows"),
        F.coalesce(F.sum(F.when(F.col("value").isNotNull(), F.col("n"))), F.lit(0)).alias("n_non_null"),
        F.count("value").alias("n_distinct"),
    )


def guess_column(df: DataFrame, keywords: Sequence[str], fallback: bool = True) -> str | None:
    """Column whose name equals, then contains, a keyword; else the last column with 2..20 distinct values."""
    lowered = {c: c.lower() for c in df.columns}
    for match in (lambda name, k: name == k, lambda name, k: k in name):
        for keyword in keywords:
            hits = [c for c, name in lowered.items() if match(name, keyword)]
            if hits:
                return hits[0]
    if not fallback:
        return None
    low = {r["feature"] for r in distinct_counts(df).where(F.col("n_distinct").between(2, 20)).collect()}
    candidates = [c for c in df.columns if c in low]
    return candidates[-1] if candidates else df.columns[-1]
