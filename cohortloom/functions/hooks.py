"""Typed hooks for user code: Arrow-batched scalars, grouped maps, partition maps, aggregates and table functions.

Built-in expressions stay the default; these are the escape hatches, in order of preference.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import StructType


#: Bytes of a batch that is handed to user code as a frame; one row is always handed over.
BATCH_BYTES = 4 << 20


def scalar(fn: Callable[..., pd.Series], returns: str = "double"):
    """Vectorised scalar function over Arrow batches."""
    return F.pandas_udf(fn, returns)


def grouped_map(df: DataFrame, keys: list[str], fn: Callable[[pd.DataFrame], pd.DataFrame], schema: str) -> DataFrame:
    """One pandas frame per group; only for groups with a known bound, such as the voxels of one scan."""
    return df.groupBy(*keys).applyInPandas(fn, schema)


def _parts(batch: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
    """The batch in pieces of at most about BATCH_BYTES."""
    if batch.num_rows < 2 or batch.nbytes <= BATCH_BYTES:
        yield batch
        return
    half = batch.num_rows // 2
    yield from _parts(batch.slice(0, half))
    yield from _parts(batch.slice(half))


def partition_map(df: DataFrame, fn: Callable[[Iterator[pd.DataFrame]], Iterator[pd.DataFrame]], schema: str) -> DataFrame:
    """Batches of a partition, for decoding and scoring. Spark bounds a batch by rows; here it is bounded by bytes too, so
    long texts don't add up in a frame."""

    fields = to_arrow_schema(StructType.fromDDL(schema))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for frame in fn(part.to_pandas() for batch in batches for part in _parts(batch)):
            yield pa.RecordBatch.from_pandas(frame, schema=fields, preserve_index=False)

    return df.mapInArrow(run, schema)


def share(condition: Column) -> Column:
    """Share of rows that meet a condition: the built-in form of the usual lambda aggregate."""
    return F.avg(condition.cast("double"))


def mean_abs_error(label: Column, prob: Column) -> Column:
    return F.avg(F.abs(label - prob))


@F.udtf(returnType="start int, stop int")
class AxisWindows:
    """Windows of an occlusion grid along one axis: every stride, plus a last one that ends at the border."""

    def eval(self, size: int, patch: int, stride: int):
        width = min(size, patch)
        last = size - width
        starts = list(range(0, last + 1, stride))
        for start in starts if starts and starts[-1] == last else [*starts, last]:
            yield start, start + width
