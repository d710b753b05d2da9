"""Rows of a group in order, as arrays of bounded size.

A group that fits one array is gathered by an ordinary aggregate. The rows of larger groups are dealt out by ranges of
(group, order), sorted there and cut as they stream by, so that no task needs a group whole. Pieces are numbered in order.
"""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Rows and bytes of a piece, about (a row that is larger makes a piece of its own).
ROWS, BYTES = 1024, 8 << 20
#: Keys of large groups that are broadcast, at most; more are joined by a shuffle.
MOST_KEYS = 10_000


def sizes(df: DataFrame, key: str, weight: Column, rows: int = ROWS, size: int = BYTES) -> DataFrame:
    """(group, large) of every group: whether it takes more than one piece."""
    return df.groupBy(F.col(key).alias("group")).agg(((F.count(F.lit(1)) > rows) | (F.sum(weight) > size)).alias("large"))


def cut_stream(batches: Iterator[pa.RecordBatch], key: str, rows: int, size: int) -> Iterator[pa.RecordBatch]:
    """Pieces (key, piece, rows) of a sorted stream of (key, part, item, weight)."""
    held: list[pa.Array] = []
    count = weight = number = 0
    owner = part = None

    def piece(kinds: pa.Schema) -> pa.RecordBatch:
        items = pa.concat_arrays(held)
        values = pa.ListArray.from_arrays(pa.array([0, len(items)], pa.int32()), items)
        number_in_order = pa.array([(part << 33) + number], pa.int64())
        return pa.RecordBatch.from_arrays([pa.array([owner], kinds.field(key).type), number_in_order, values], names=[key, "piece", "rows"])

    kinds = None
    for batch in batches:
        kinds = batch.schema
        keys, weights = batch.column(key).to_pylist(), batch.column("weight").to_pylist()
        start = 0
        for i, (k, w) in enumerate(zip(keys, weights, strict=True)):
            if count and (k != owner or count >= rows or weight + w > size):
                held.append(batch.column("item").slice(start, i - start))
                yield piece(kinds)
                held, count, weight, number, start = [], 0, 0, number + 1, i
            if not count:
                owner, part = k, batch.column("part")[i].as_py()
            count, weight = count + 1, weight + w
        held.append(batch.column("item").slice(start))
    if count:
        yield piece(kinds)


def large_pieces(df: DataFrame, key: str, order: list[Column], item: Column, weight: Column, rows: int = ROWS, size: int = BYTES) -> DataFrame:
    """(key, piece, rows) where ``rows`` are the ``item`` structs of a group in ``order``; pieces in order of their number.

    ``order`` deals the rows out and sorts them; let it hold short columns only, since Spark samples them on the driver.
    """
    named = df.select(F.col(key).alias("key"), *[c.alias(f"by{i}") for i, c in enumerate(order)], item.alias("item"), weight.cast("bigint").alias("weight"))
    by = ["key", *[f"by{i}" for i in range(len(order))]]
    dealt = named.repartitionByRange(*by).sortWithinPartitions(*by, "item").select("key", F.spark_partition_id().alias("part"), "item", "weight")
    kind, rows_kind = dealt.schema["key"].dataType.simpleString(), dealt.schema["item"].dataType.simpleString()
    cut = dealt.mapInArrow(lambda batches: cut_stream(batches, "key", rows, size), f"key {kind}, piece bigint, rows array<{rows_kind}>")
    return cut.withColumnRenamed("key", key)


# ---- Rows that pass through Python one by one ---------------------------------------------------------------------------


def per_row(types: str, fn):
    """A mapInArrow function that turns every row (a dict) into one row of ``types`` with the same key."""
    names = [t.strip().split(" ")[0] for t in _split(types)]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                out = [fn(r) for r in batch.to_pylist()]
                arrays = [pa.array([r[n] for r in out], _arrow(t)) for n, t in zip(names, _split(types), strict=True)]
                yield pa.RecordBatch.from_arrays([batch.column("key"), *arrays], names=["key", *names])

    return run


def _split(types: str) -> list[str]:
    return types.split(", ")


_ARROW = {
    "bigint": pa.int64(),
    "string": pa.string(),
    "array<bigint>": pa.list_(pa.int64()),
    "array<struct<role:string,text:string>>": pa.list_(pa.struct([("role", pa.string()), ("text", pa.string())])),
}


def _arrow(typed: str) -> pa.DataType:
    return _ARROW[typed.strip().split(" ", 1)[1]]


def scan(types: str, start, step):
    """A mapInArrow function over rows sorted by key: ``step`` takes the state of the key so far and a row, and gives the
    new state and the row to return."""
    names = [t.strip().split(" ")[0] for t in _split(types)]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        first, owner, state = True, None, None
        for batch in batches:
            out = []
            for r in batch.to_pylist():
                if first or r["key"] != owner:
                    first, owner, state = False, r["key"], start
                state, told = step(state, r)
                out.append(told)
            if out:
                arrays = [pa.array([r[n] for r in out], _arrow(t)) for n, t in zip(names, _split(types), strict=True)]
                yield pa.RecordBatch.from_arrays([batch.column("key"), *arrays], names=["key", *names])

    return run


def in_order(df: DataFrame, *by) -> DataFrame:
    return df.repartition("key").sortWithinPartitions("key", *by)
