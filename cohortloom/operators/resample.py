"""Bootstrap confidence intervals.

Each row (or cluster) gets a Poisson(1) count per replicate from the hash of (seed, replicate, key) - the same scheme
Spark uses to sample with replacement; one MD5 gives four replicates their 32 bits. A replicate is a weighted sum: tasks
multiply the vector of a row's counts with its values and add the vectors up, and one row per group and task of partial
sums is exchanged. No resampled copy of the table arises, nor a row per row and replicate. The random draws differ from a
NumPy generator; the distribution of the replicates is the contract.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from cohortloom.functions.keyed import POISSON_ONE
from cohortloom.operators.joins import one_row
from cohortloom.session import partitions

#: Rows whose counts are laid out at once; groups whose sums a task holds at once.
ROWS, GROUPS = 512, 1024


def draw_counts(keys: Sequence[str], draws: int, seed: int) -> np.ndarray:
    """Poisson(1) counts, one row per key and one column per replicate."""
    blocks = [f"{seed}|{b}|".encode() for b in range(-(-draws // 4))]
    digests = b"".join(hashlib.md5(b + k).digest() for k in (key.encode() for key in keys) for b in blocks)
    numbers = np.frombuffer(digests, dtype=">u4").reshape(len(keys), -1)[:, :draws]
    return np.searchsorted(np.array(POISSON_ONE), numbers / 4294967296.0, side="right")


def _partial_sums(keys: list[str], draws: int, seed: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[tuple, np.ndarray] = {}
        kinds = None

        def told() -> pa.RecordBatch:
            columns = [pa.array([g[i] for g in held], kinds.field(k).type) for i, k in enumerate(keys)]
            both = [pa.array([v[i].tolist() for v in held.values()], pa.list_(pa.float64())) for i in range(2)]
            return pa.RecordBatch.from_arrays([*columns, *both], names=[*keys, "_t", "_c"])

        for batch in batches:
            kinds = batch.schema
            for start in range(0, batch.num_rows, ROWS):
                part = batch.slice(start, ROWS)
                counts = draw_counts(part.column("_k").to_pylist(), draws, seed)
                sums = np.stack([np.asarray(part.column(c)) for c in ("_t", "_c")])
                owners: dict[tuple, list[int]] = {}
                for i, group in enumerate(zip(*[part.column(k).to_pylist() for k in keys], strict=True) if keys else [()] * part.num_rows):
                    owners.setdefault(group, []).append(i)
                for group, some in owners.items():
                    held[group] = held.get(group, 0.0) + sums[:, some] @ counts[some]
                if len(held) >= GROUPS:
                    yield told()
                    held = {}
        if held:
            yield told()

    return run


def replicates(df: DataFrame, keys: Sequence[str], key: str, total: Column, count: Column, draws: int, seed: int) -> DataFrame:
    """(keys, draw, value) with value = sum(w total) / sum(w count); rows without a total or a key are left out."""
    keys = list(keys)
    rows = df.select(*keys, F.col(key).cast("string").alias("_k"), total.cast("double").alias("_t"), count.cast("double").alias("_c"))
    rows = rows.where(F.col("_k").isNotNull() & F.col("_t").isNotNull())
    kinds = "".join(f"{k} {rows.schema[k].dataType.simpleString()}, " for k in keys)
    # A row costs a few hundred hashes and next to nothing to move.
    partial = rows.repartition(partitions(df.sparkSession)).mapInArrow(_partial_sums(keys, draws, seed), f"{kinds}_t array<double>, _c array<double>")
    each = partial.select(*keys, F.posexplode(F.arrays_zip("_t", "_c")).alias("draw", "e")).select(*keys, "draw", "e._t", "e._c")
    g = each.groupBy(*keys, "draw").agg(F.sum("_t").alias("_t"), F.sum("_c").alias("_c"))
    return g.select(*keys, "draw", (F.col("_t") / F.when(F.col("_c") > 0, F.col("_c"))).alias("value"))


def _interval(reps: DataFrame, observed: DataFrame, keys: Sequence[str]) -> DataFrame:
    ci = reps.groupBy(*keys).agg(
        F.expr("percentile(value, array(0.025D, 0.975D))").alias("_q"),
        F.avg((F.col("value") > 0).cast("double")).alias("share_positive"),
        F.count("value").alias("draws"),
    )
    out = ci.select(
        *keys, F.col("_q")[0].alias("ci_low"), F.col("_q")[1].alias("ci_high"), "share_positive", "draws"
    )
    if keys:
        return observed.join(out, list(keys))
    return one_row(observed, out)


def bootstrap_mean_ci(df: DataFrame, keys: Sequence[str], key: str, value: str, draws: int = 2000, seed: int = 0) -> DataFrame:
    """Mean per group with the 2.5 and 97.5 percentiles of its row bootstrap."""
    observed = df.groupBy(*keys).agg(F.avg(value).alias("mean"), F.count(value).alias("n"))
    return _interval(replicates(df, keys, key, F.col(value), F.lit(1), draws, seed), observed, keys)


def paired_bootstrap(df: DataFrame, keys: Sequence[str], key: str, first: str, second: str, draws: int = 2000,
                     seed: int = 0) -> DataFrame:
    """Interval of the mean gain ``first - second`` (positive: second is better) and the share of replicates above 0."""
    gain = df.select(*keys, key, (F.col(first) - F.col(second)).alias("_gain"))
    return bootstrap_mean_ci(gain, keys, key, "_gain", draws, seed)


def cluster_bootstrap(df: DataFrame, keys: Sequence[str], cluster: str, value: str, draws: int = 2000, seed: int = 0) -> DataFrame:
    """Resamples clusters: ratio of summed value and count. Clusters are pre-aggregated before any replicate."""
    g = df.groupBy(*keys, cluster).agg(F.sum(value).alias("_t"), F.count(value).alias("_c"))
    observed = g.groupBy(*keys).agg(
        (F.sum("_t") / F.sum("_c")).alias("mean"), F.sum("_c").alias("n"), F.count(F.lit(1)).alias("clusters")
    )
    return _interval(replicates(g, keys, cluster, F.col("_t"), F.col("_c"), draws, seed), observed, keys)
