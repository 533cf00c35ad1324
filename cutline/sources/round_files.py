"""Yearly round files: discovery, two header widths, row lineage."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window, functions as F

from cutline.functions.text import null_words_to_null
from cutline.schemas import LEGACY_ROUND_SCHEMA, RAW_ROUND_SCHEMA
from cutline.session import broadcast_if_small
from cutline.sources.file_heads import headers

# year and round live in the file name (or the folder of that name a distributed writer makes)
ROUND_NAME = r"(\d{4})_round_(\d+)\.\w+"
LINEAGE = ["source_file", "source_row_id", "year", "round"]


def _paths(spark: SparkSession, glob: str) -> DataFrame:
    """File names only: the binary reader lists files without opening them for these columns."""
    return spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(glob).select("path", "length")


def discover(spark: SparkSession, folder: str) -> DataFrame:
    """(path, source_file, year, round) of real round files; sidecars and other names are skipped."""
    found = _paths(spark, folder)
    name = F.regexp_extract("path", ROUND_NAME + r"(/part-[^/]+)?$", 0)
    base = F.regexp_extract("path", ROUND_NAME, 0)
    return found.where((name != "") & ~F.col("path").contains("Zone")).select(
        "path", base.alias("source_file"),
        F.regexp_extract("path", ROUND_NAME, 1).cast("bigint").alias("year"),
        F.regexp_extract("path", ROUND_NAME, 2).cast("bigint").alias("round"))


def with_lineage(rows: DataFrame) -> DataFrame:
    """0-based row number within each file, without gathering a file in one task.

    Rows are numbered inside their file split; the table of splits (one row each, stored, and
    broadcast when its measured size allows) gives each its offset.
    """
    columns = rows.columns
    located = rows.select(
        "*", F.col("_metadata.file_path").alias("__f"), F.col("_metadata.file_block_start").alias("__b")
    ).withColumn("__id", F.monotonically_increasing_id())
    splits = located.groupBy("__f", "__b").agg(F.min("__id").alias("__first"), F.count(F.lit(1)).alias("__n"))
    offset = F.sum("__n").over(Window.partitionBy("__f").orderBy("__b")) - F.col("__n")
    splits = splits.withColumn("__offset", offset).drop("__n")
    return located.join(broadcast_if_small(splits, "row offsets"), ["__f", "__b"]).select(
        *columns, F.regexp_extract("__f", ROUND_NAME, 0).alias("source_file"),
        (F.col("__offset") + F.col("__id") - F.col("__first")).alias("source_row_id"),
        F.regexp_extract("__f", ROUND_NAME, 1).cast("bigint").alias("year"),
        F.regexp_extract("__f", ROUND_NAME, 2).cast("bigint").alias("round"))


def _read(spark: SparkSession, paths: list[str], schema) -> DataFrame:
    raw = spark.read.schema(schema).option("header", True).option("enforceSchema", True).csv(paths)
    trimmed = with_lineage(raw)
    return trimmed.select(*[
        null_words_to_null(F.trim(F.col(f"`{f.name}`"))).alias(f.name) for f in schema.fields
    ], *LINEAGE)


def read_rounds(spark: SparkSession, modern: list[str], legacy: list[str] = ()) -> DataFrame:
    """Both header widths as one table; files without a gender column count as neutral."""
    parts = []
    if modern:
        parts.append(_read(spark, list(modern), RAW_ROUND_SCHEMA))
    if legacy:
        parts.append(_read(spark, list(legacy), LEGACY_ROUND_SCHEMA).withColumn("Gender", F.lit("Gender-Neutral")))
    if not parts:
        raise ValueError("no round files given")
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out


def split_by_header(spark: SparkSession, folder: str) -> tuple[list[str], list[str]]:
    """(modern, legacy) paths by width of the header line. The head of each file is read and the
    list of files, not of rows, reaches the driver."""
    width = {r["path"]: r["width"] for r in headers(discover(spark, folder)).collect()}
    modern = sorted(p for p, w in width.items() if w > 6)
    legacy = sorted(p for p, w in width.items() if w <= 6)
    return modern, legacy


def load_rounds(spark: SparkSession, folder: str) -> DataFrame:
    modern, legacy = split_by_header(spark, folder)
    return read_rounds(spark, modern, legacy)
