"""Deterministic pseudo-random numbers from keys: the same value on every run, partitioning and engine."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Cumulative Poisson(1) probabilities for counts 0, 1, 2, ...
POISSON_ONE = (
    0.36787944117144233,
    0.7357588823428847,
    0.9196986029286058,
    0.9810118431238462,
    0.9963401531726563,
    0.9994058151824183,
    0.999916758850712,
    0.9999897508033253,
    0.999998874797402,
    0.9999998885745217,
)


def uniform(text: Column) -> Column:
    """A number in [0, 1) from the first 32 bits of the MD5 of ``text``."""
    return F.conv(F.substring(F.md5(text.cast("binary")), 1, 8), 16, 10).cast("double") / F.lit(4294967296.0)


def uniform_sql(text: str) -> str:
    return f"(CAST(CAST(concat('0x', substr(md5({text}), 1, 8)) AS BIGINT) AS DOUBLE) / 4294967296)"


def poisson_weight(u: Column) -> Column:
    """Inverse-CDF Poisson(1) count: how often a row is drawn in one bootstrap replicate."""
    weight = F.lit(0)
    for edge in POISSON_ONE:
        weight = weight + (u >= F.lit(edge)).cast("int")
    return weight


def poisson_weight_sql(u: str) -> str:
    return "(" + " + ".join(f"CAST({u} >= CAST({e!r} AS DOUBLE) AS INT)" for e in POISSON_ONE) + ")"
