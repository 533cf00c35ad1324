"""Exact duplicates by two passes of a Bloom filter; only rows that may repeat are shuffled.

Pass 1 maps every row to two cells of a bit table and counts rows per cell (a third of all rows in
one cell is one partial count per task). Cells hit twice become bitmaps. Pass 2 tests both
cells of each row: a row with a cell of its own has no copy and passes straight through; the rest
are shuffled by digest and settled exactly, so false positives cost work but change nothing.

The filter has 16 cells per row and is broadcast, so it is held below ``filter_bytes``. Beyond
that many rows more of them count as possibly repeated and the result stays the same.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from cutline.llm.bitmaps import FILTER_BYTES, bitmaps, cell_of, cells_for, with_flag
from cutline.llm.graph import join_groups
from cutline.session import written

BLANKS = r"[\x20\x09-\x0D]+"


def normalised(text: Column) -> Column:
    """Every run of blanks as one space; null as the empty text."""
    return F.regexp_replace(F.coalesce(text, F.lit("")), BLANKS, " ")


def digest(text: Column) -> Column:
    """Lowercase hexadecimal SHA-256 of the normalised text in UTF-8."""
    return F.sha2(normalised(text).cast("binary"), 256)


def _two_cells(cells: int) -> list[Column]:
    return [cell_of("digest", cells=cells, seed=seed) for seed in (1, 2)]


def repeated_cells(keyed: DataFrame, cells: int) -> DataFrame:
    """Bitmaps of the cells that two rows or more fall into."""
    hit = keyed.select(F.explode(F.array_distinct(F.array(*_two_cells(cells)))).alias("cell"))
    return bitmaps(hit.groupBy("cell").agg(F.count(F.lit(1)).alias("n")).where("n > 1"))


def maybe_repeated(keyed: DataFrame, table: DataFrame, cells: int) -> DataFrame:
    """``keyed`` with ``maybe``: other rows fall into both cells of this one."""
    return with_flag(keyed, table, _two_cells(cells), "maybe")


def _passes(docs: DataFrame, id_column: str, text_column: str, filter_bytes: int) -> tuple[DataFrame, DataFrame, int, DataFrame]:
    """(narrow keys, repeated cells, number of cells, digest groups of the possibly repeated rows)."""
    keyed = written(docs.select(F.col(id_column).alias("id"), digest(F.col(text_column)).alias("digest")), "digests")
    cells = cells_for(keyed.count(), filter_bytes)
    table = written(repeated_cells(keyed, cells), "cells")
    suspects = maybe_repeated(keyed, table, cells).where("maybe")
    groups = written(suspects.groupBy("digest").agg(F.min("id").alias("keep"), F.count(F.lit(1)).alias("n")), "groups")
    return keyed, table, cells, groups


def duplicate_groups(docs: DataFrame, id_column: str = "doc_id", text_column: str = "text", filter_bytes: int = FILTER_BYTES) -> DataFrame:
    """(id, keep_id, group_size, kept, text_sha256) of every row of ``docs``.

    ``keep_id`` is the smallest id among rows of equal normalised text (nulls only if there is nothing
    else); ``kept`` marks the rows with that id, so fully repeated rows stay marked alike. Null texts equal
    empty ones. Texts of any length are digested whole. Other columns are not read; an empty table gives none.

    Rows of groups that would fill a task by themselves meet them by broadcast (``join_groups``).
    """
    keyed, table, cells, groups = _passes(docs, id_column, text_column, filter_bytes)
    tested = maybe_repeated(keyed, table, cells)
    alone = tested.where("not maybe").select("id", F.col("id").alias("keep"), F.lit(1).cast("bigint").alias("n"), "digest")
    settled = join_groups(tested.where("maybe").select("id", "digest"), groups, "digest").select("id", "keep", "n", "digest")
    return alone.unionByName(settled).select(
        F.col("id").alias(id_column), F.col("keep").alias("keep_id"), F.col("n").cast("bigint").alias("group_size"),
        F.col("id").eqNullSafe(F.col("keep")).alias("kept"), F.col("digest").alias("text_sha256"))


def without_duplicates(docs: DataFrame, id_column: str = "doc_id", text_column: str = "text", filter_bytes: int = FILTER_BYTES) -> DataFrame:
    """One row per normalised text, the one of the smallest id, with all columns of ``docs``.

    Of fully repeated ids and texts one row stays. Rows without a copy never move; the rest meet
    their group by (digest, id), a key that no group of copies makes heavy.
    """
    _, table, cells, groups = _passes(docs, id_column, text_column, filter_bytes)
    rows = docs.select(F.struct("*").alias("row"), F.col(id_column).alias("id"), digest(F.col(text_column)).alias("digest"))
    tested = maybe_repeated(rows, table, cells)
    winners = groups.select(F.col("digest").alias("win"), F.col("keep").alias("win_id"))
    ahead = tested.where("not maybe").select("row")
    settled = (
        tested.where("maybe").join(winners, (F.col("digest") == F.col("win")) & F.col("id").eqNullSafe(F.col("win_id")), "left_semi")
        .dropDuplicates(["digest"]).select("row")
    )
    return ahead.unionByName(settled).select("row.*")
