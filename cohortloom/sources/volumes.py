"""Volume files and volume tables: inventory, decoding to slice rows, storage, voxel view."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from cohortloom.sources import nifti

SLICE_SCHEMA = (
    "uid string, error string, z int, nz int, ny int, nx int, sz double, sy double, sx double, determinant double, values array<float>"
)


def uid_from_path(path):
    """Record key of a file: its name without ``.nii`` / ``.nii.gz`` (or another suffix)."""
    return F.regexp_replace(F.regexp_extract(path, r"([^/]+)$", 1), r"(?i)(\.nii(\.gz)?|\.[a-z0-9]+)$", "")


def volume_inventory(spark: SparkSession, directory: str, pattern: str = "*.nii*") -> DataFrame:
    """(uid, path, length, modified) of the volume files under a directory; file contents are not read."""
    files = (
        spark.read.format("binaryFile").option("pathGlobFilter", pattern).option("recursiveFileLookup", "true").load(directory)
    )
    return files.select(uid_from_path(F.col("path")).alias("uid"), "path", "length", F.col("modificationTime").alias("modified"))


def decode_volumes(files: DataFrame) -> DataFrame:
    """Slice rows of (uid, content) files: one row per z slice, or one row with ``error`` for a file that cannot be read."""

    def run(batches):
        for pdf in batches:
            for uid, content in zip(pdf["uid"], pdf["content"]):
                try:
                    volume, spacing, det = nifti.decode(bytes(content))
                except Exception as error:  # a broken file becomes a failure row
                    text = f"{type(error).__name__}: {error}"
                    yield pd.DataFrame([(uid, text, None, None, None, None, None, None, None, None, None)], columns=_COLUMNS)
                    continue
                nz, ny, nx = volume.shape
                rows = [(uid, None, z, nz, ny, nx, *spacing, det, volume[z].ravel().astype("float32")) for z in range(nz)]
                yield pd.DataFrame(rows, columns=_COLUMNS)

    return files.select("uid", "content").mapInPandas(run, SLICE_SCHEMA)


_COLUMNS = [part.split()[0] for part in SLICE_SCHEMA.split(", ")]


def scan_volumes(spark: SparkSession, directory: str, pattern: str = "*.nii*") -> DataFrame:
    """Slices of every volume file under a directory; one task decodes one file at a time."""
    files = spark.read.format("binaryFile").option("pathGlobFilter", pattern).option("recursiveFileLookup", "true").load(directory)
    return decode_volumes(files.select(uid_from_path(F.col("path")).alias("uid"), "content"))


def failures(slices: DataFrame) -> DataFrame:
    """(uid, error) of the files that could not be decoded."""
    return slices.where(F.col("error").isNotNull()).select("uid", "error")


def pack_slices(voxels: DataFrame, keep: list[str] | None = None) -> DataFrame:
    """Voxel rows to slice rows (uid, z, ny, nx, values, mask, keep...); a slice is bounded by its grid."""
    cell = F.array_sort(F.collect_list(F.struct("y_", "x", "v", "m")))
    g = voxels.groupBy("uid", "z", *(keep or [])).agg(
        (F.max("y_") + 1).alias("ny"), (F.max("x") + 1).alias("nx"), cell.alias("_c")
    )
    return g.select(
        "uid", "z", *(keep or []), "ny", "nx", F.transform("_c", lambda c: c["v"].cast("float")).alias("values"),
        F.transform("_c", lambda c: c["m"]).alias("mask"),
    )


def explode_slices(slices: DataFrame, keep: list[str] | None = None) -> DataFrame:
    """Slice rows to voxel rows (uid, z, y_, x, v[, m]); NaN and infinities become NULL."""
    has_mask = "mask" in slices.columns
    value = F.arrays_zip(F.col("values").alias("v"), F.col("mask").alias("m")) if has_mask else F.arrays_zip(F.col("values").alias("v"))
    rows = slices.where(F.col("values").isNotNull()).select("uid", "z", "nx", *(keep or []), F.posexplode(value).alias("i", "e"))
    v = F.col("e.v").cast("double")
    clean = F.when(~F.isnan(v) & (F.abs(v) != F.lit(float("inf"))), v)
    return rows.select(
        "uid", *(keep or []), "z", F.floor(F.col("i") / F.col("nx")).cast("int").alias("y_"), (F.col("i") % F.col("nx")).cast("int").alias("x"),
        clean.alias("v"), *([F.col("e.m").alias("m")] if has_mask else []),
    )


def write_volume_table(slices: DataFrame, path: str, run: str = "run") -> None:
    """Slices as Parquet partitioned by run; values are float32 (Spark has no float16)."""
    slices.write.mode("overwrite").partitionBy(run).parquet(path)


def read_volume_table(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.parquet(path)
