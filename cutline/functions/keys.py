"""Joins whose keys may be NULL, and size-checked broadcasts."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F


def null_safe_join(left: DataFrame, right: DataFrame, keys: list[str], how: str) -> DataFrame:
    """Equi-join in which a NULL key matches a NULL key; key columns appear once."""
    renamed = right
    for k in keys:
        renamed = renamed.withColumnRenamed(k, f"__r_{k}")
    condition = None
    for k in keys:
        term = left[k].eqNullSafe(renamed[f"__r_{k}"])
        condition = term if condition is None else condition & term
    joined = left.join(renamed, condition, how)
    if how in ("left_semi", "left_anti"):
        return joined
    if how in ("full", "full_outer", "right", "right_outer"):
        for k in keys:
            joined = joined.withColumn(k, F.coalesce(F.col(k), F.col(f"__r_{k}")))
    return joined.drop(*[f"__r_{k}" for k in keys])


def broadcast_if_small(df: DataFrame, max_rows: int) -> tuple[DataFrame, bool]:
    """Hint a broadcast only when ``df`` was counted and is within ``max_rows``.

    ``df`` should be a stored table or a checkpoint, so that the count reads little.
    """
    small = df.limit(max_rows + 1).count() <= max_rows
    return (F.broadcast(df) if small else df), small
