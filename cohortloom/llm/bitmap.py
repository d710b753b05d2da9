"""Bounded bit maps of hashed values, built on the executors."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

BLOCK_BITS = 15


def bit_map(df: DataFrame, column: str, bits: int) -> np.ndarray:
    """``1 << bits`` bits as bytes: bit ``value mod 2^bits`` is set for every value of a bigint column. Its size doesn't
    depend on the table; equal bits are merged on the map side, and the driver gets blocks of 4 KB."""

    def pack(table: pa.Table) -> pa.Table:
        flags = np.zeros(1 << BLOCK_BITS, dtype=bool)
        flags[np.asarray(table.column("bit")) & ((1 << BLOCK_BITS) - 1)] = True
        packed = np.packbits(flags, bitorder="little").tobytes()
        return pa.table({"block": pa.array([int(table.column("block")[0].as_py())], pa.int32()), "bits": pa.array([packed], pa.binary())})

    values = df.select(F.pmod(F.col(column), F.lit(1 << bits)).alias("bit")).distinct()
    blocks = values.withColumn("block", F.expr(f"cast(shiftright(bit, {BLOCK_BITS}) AS int)")).groupBy("block").applyInArrow(pack, "block int, bits binary")
    out = np.zeros((1 << bits) // 8, dtype=np.uint8)
    for row in blocks.collect():
        start = row["block"] << (BLOCK_BITS - 3)
        out[start : start + (1 << (BLOCK_BITS - 3))] = np.frombuffer(bytes(row["bits"]), np.uint8)
    return out


def has_bit(table: np.ndarray, values: np.ndarray, bits: int) -> np.ndarray:
    """Which unsigned 64-bit values (two's complement of the bigint) have their bit set."""
    at = (values & np.uint64((1 << bits) - 1)).astype(np.int64)
    return (table[at >> 3] >> (at & 7).astype(np.uint8) & np.uint8(1)) > 0
