"""Bit tables as rows of bitmaps: membership tests that cost one bit per cell when broadcast."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

BLOCK = 32_768  # bits of one bitmap of the bitmap functions
FILTER_BYTES = 64 << 20


def cells_for(rows: int, filter_bytes: int = FILTER_BYTES) -> int:
    """Sixteen cells a row, as a power of two, within the byte limit."""
    return max(BLOCK, min(1 << (16 * rows).bit_length(), 8 * filter_bytes))


def cell_of(*key: str, cells: int, seed: int = 1) -> Column:
    return F.pmod(F.xxhash64(*key, F.lit(seed)), F.lit(cells))


def bitmaps(cells: DataFrame) -> DataFrame:
    """(bucket, bits) of a table of distinct cell numbers ``cell``."""
    return cells.groupBy(F.floor(F.col("cell") / BLOCK).alias("bucket")).agg(
        F.call_function("bitmap_construct_agg", F.col("cell") % BLOCK).alias("bits"))


def with_flag(rows: DataFrame, table: DataFrame, cells: list[Column], name: str) -> DataFrame:
    """``rows`` with ``name``: are the bits of all ``cells`` set? ``table`` has at most
    ``cells_for(...) / 8`` bytes and is broadcast."""
    flag, out = F.lit(True), rows
    for i, cell in enumerate(cells):
        side = F.broadcast(table.select(F.col("bucket").alias(f"__bucket{i}"), F.col("bits").alias(f"__bits{i}")))
        out = out.withColumn(f"__cell{i}", cell)
        out = out.join(side, F.floor(F.col(f"__cell{i}") / BLOCK) == F.col(f"__bucket{i}"), "left")
        at = (F.col(f"__cell{i}") % BLOCK).cast("int")
        byte = F.conv(F.hex(F.substring(F.col(f"__bits{i}"), F.floor(at / 8).cast("int") + 1, F.lit(1))), 16, 10).cast("int")
        flag = flag & F.coalesce(F.call_function("bit_get", byte, at % 8) == 1, F.lit(False))
    return out.select(*rows.columns, flag.alias(name))
