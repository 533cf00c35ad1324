"""The corpus pipeline: five stages, each on what the one before it kept.

``STAGES`` lists (name, function); a function takes (spark, docs, sf_dir) and returns a DataFrame. ``run``
writes each stage as Parquet to the shared folder and reads it back as the next one's documents. All
stages but the last return the columns of their input; the last returns packed pieces.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from cutline.llm.decontamination import contamination
from cutline.llm.exact_dedup import without_duplicates
from cutline.llm.near_dedup import near_duplicates
from cutline.llm.packing import packed_pieces
from cutline.llm.quality import quality_scores
from cutline.llm.queries import quality_labels, table, vocabulary
from cutline.session import importable, written

#: documents whose score for label 1 is below this are rejected, as in the registered quality query
QUALITY = 0.7


def quality_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality vote does not reject. Null and empty texts are judged like others."""
    scored = quality_scores(docs, table(spark, sf_dir, "documents"), quality_labels(spark, sf_dir), name="__quality")
    return scored.where(F.col("__quality") >= QUALITY).drop("__quality")


def exact_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each normalised text, the one with the smallest doc_id."""
    return without_duplicates(docs)


def near_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near duplicates, the one with the smallest doc_id."""
    gone = written(near_duplicates(docs, percent=80).where("not kept").select(F.col("doc_id").alias("__gone")).distinct(), "near_gone")
    return without_ids(docs, gone)


def decontamination_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that are not contaminated by the benchmark."""
    found = contamination(docs, table(spark, sf_dir, "benchmark"))
    gone = written(found.where("contaminated").select(F.col("doc_id").alias("__gone")).distinct(), "contaminated")
    return without_ids(docs, gone)


def packing_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of packed sequences of at most 1024 tokens."""
    return packed_pieces(docs, vocabulary())


def without_ids(docs: DataFrame, gone: DataFrame) -> DataFrame:
    """``docs`` without the rows named in ``gone`` (a stored table of distinct ids, ``__gone``).

    A bitmap of the ids lets nearly all rows that stay pass without a shuffle; the few it
    cannot rule out meet the ids by a join.
    """
    from cutline.llm.bitmaps import bitmaps, cell_of, cells_for, with_flag

    cells = cells_for(gone.count())
    marks = written(bitmaps(gone.select(cell_of("__gone", cells=cells).alias("cell")).distinct()), "gone_bits")
    rows = docs.select(F.struct("*").alias("row"), F.col("doc_id").alias("id"))
    tested = with_flag(rows, marks, [cell_of("id", cells=cells)], "may")
    stay = tested.where("not may").select("row")
    rest = tested.where("may").join(gone, F.col("id") == F.col("__gone"), "left_anti").select("row")
    return stay.unionByName(rest).select("row.*")


def _prepared(stage):
    """The stage on a session set up for long texts."""
    return lambda spark, docs, sf_dir: stage(importable(spark), docs, sf_dir)


STAGES = [(name, _prepared(stage)) for name, stage in (
    ("quality", quality_stage),
    ("exact_dedup", exact_stage),
    ("near_dedup", near_stage),
    ("decontamination", decontamination_stage),
    ("packing", packing_stage),
)]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over the documents of ``sf_dir``."""
    docs = table(importable(spark), sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = written(stage(spark, docs, sf_dir), f"stage_{name}")
    return STAGES[-1][1](spark, docs, sf_dir)


#: the votes of stage 1 and the vocabulary of stage 5 cannot be said in SQL
ORACLE_SQL = None

QUERIES = {"pipeline": run}
ORACLES = {} if ORACLE_SQL is None else {"pipeline": ORACLE_SQL}
