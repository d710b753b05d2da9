"""Regional feature bank: 930 numbers per scan, in long form and as one row.

Ten regions x three channels x fifteen summaries, ten regions x four thresholds x eight shapes of the active part, four
quadrants x five numbers of grey levels x six texture metrics, ten pairs x four contrasts. A region without voxels gives
zeros.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute  # noqa: F401
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cohortloom.operators import grid
from cohortloom.operators import voxel as vx
from cohortloom.session import cut

# Names and levels of the feature definitions, in their order.
REGIONS = ("target", "right", "left", "anterior", "posterior", *vx.QUADRANTS, "target_core")
CHANNELS = ("selfnorm", "robust", "rank")
STATS = ("mean", "std", "min", "max", "p01", "p05", "p10", "p25", "p50", "p75", "p90", "p95", "p99", "mad", "energy")
SHAPES = ("fraction", "voxels", "components", "largest_fraction", "extent_z", "extent_y", "extent_x", "centroid_distance")
LEVELS = (8, 12, 16, 24, 32)
PAIRS = (
    "caudate_lr", "putamen_lr", "right_cp", "left_cp", "hemisphere_lr", "anterior_posterior", "minmax_putamen",
    "minmax_caudate", "weak_caudate_putamen", "core_target",
)
CONTRASTS = ("difference", "absolute_difference", "ratio", "asymmetry")


def bank_names() -> list[str]:
    """Names of the 930 features in order."""
    names = [f"intensity_{r}_{c}_{s}" for r in REGIONS for c in CHANNELS for s in STATS]
    names += [f"morph_{r}_p{p:02d}_{s}" for r in REGIONS for p in vx.THRESHOLD_PERCENTILES for s in SHAPES]
    names += [f"texture_{r}_l{n:02d}_{m}" for r in vx.QUADRANTS for n in LEVELS for m in vx.TEXTURE_METRICS]
    return names + [f"relation_{p}_{c}" for p in PAIRS for c in CONTRASTS]


def _long(df: DataFrame, prefix: list, values: list[str]) -> DataFrame:
    """(uid, feature, value): one row per value column, named by the parts of ``prefix`` and the column."""
    items = F.array(*[F.struct(F.lit(v).alias("name"), F.col(v).cast("double").alias("value")) for v in values])
    rows = df.select("uid", F.concat_ws("_", *prefix).alias("prefix"), F.explode(items).alias("e"))
    return rows.select("uid", F.concat_ws("_", "prefix", "e.name").alias("feature"), "e.value")


def regional_values(voxels: DataFrame) -> DataFrame:
    """(uid, feature, value) of the features of regions that have voxels."""
    regions = cut(vx.region_masks(vx.self_normalize(voxels)).select("uid", *vx.POS, "region", "s"))
    stats = vx.region_stats(voxels, regions=regions)
    shapes = vx.threshold_morphology(voxels, regions=regions).withColumnRenamed("extent_y_", "extent_y")
    quadrants = regions.where(F.col("region").isin(*vx.QUADRANTS)).select("uid", *vx.POS, "region", F.col("s").alias("v"), F.lit(True).alias("m"))
    texture = vx.glcm(quadrants, LEVELS, vx.AXES_3, "floor", 8, ["region"], eps=1e-6, empty=0.0)
    relations = vx.region_relations(voxels, regions=regions)
    two_digits = lambda c: F.lpad(F.col(c).cast("string"), 2, "0")
    return (
        _long(stats, [F.lit("intensity"), "region", "channel"], list(STATS))
        .unionByName(_long(shapes, [F.lit("morph"), "region", F.concat(F.lit("p"), two_digits("p"))], list(SHAPES)))
        .unionByName(_long(texture, [F.lit("texture"), "region", F.concat(F.lit("l"), two_digits("levels"))], list(vx.TEXTURE_METRICS)))
        .unionByName(_long(relations, [F.lit("relation"), "pair"], list(CONTRASTS)))
    )


def regional_bank(voxels: DataFrame) -> DataFrame:
    """One row per scan with any mask voxel: uid and the 930 features, zero where a region has no voxels."""
    names = bank_names()
    values = regional_values(voxels)

    def wide(table: pa.Table) -> Iterator[pa.Table]:
        scan, uids = grid.codes(table.column("uid"))
        place = pa.compute.index_in(table.column("feature"), value_set=pa.array(names)).to_numpy()
        bank = np.zeros((len(uids), len(names)))
        bank[scan, place] = table.column("value").fill_null(0.0).to_numpy()
        uid = pa.array(uids, table.schema.field("uid").type)
        yield pa.table([uid, *bank.T], names=["uid", *names])

    kind = values.schema["uid"].dataType.simpleString()
    return vx.by_steps(values, wide, f"uid {kind}, " + ", ".join(f"{n} double" for n in names))


def bank_long(bank: DataFrame) -> DataFrame:
    """The rows of :func:`regional_bank` as (uid, feature, value)."""
    return bank.select("uid", F.explode(F.map_from_arrays(F.array(*[F.lit(n) for n in bank_names()]), F.array(*bank_names()))).alias("feature", "value"))
