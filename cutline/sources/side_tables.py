"""Applicant totals per year and the seat matrix, whose headers are matched by name."""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame, SparkSession, functions as F, types as T

from cutline.operators.cleaning import forward_fill, unpivot_seats
from cutline.schemas import SEAT_CATEGORIES


def _rename(df: DataFrame, rules) -> DataFrame:
    """Rename by the first rule whose test holds for the lower-cased, tidied header."""
    names = []
    for c in df.columns:
        tidy = re.sub(r"\s+", " ", c.strip().strip('"'))
        low = tidy.lower()
        names.append(next((new for test, new in rules if test(low)), tidy))
    return df.toDF(*names)


def dynamics_from(raw: DataFrame) -> DataFrame:
    """year, applicants, total_seats as numbers; grouping commas such as 15,38,468 removed."""
    named = _rename(raw, [
        (lambda c: "year" in c, "year"),
        (lambda c: "applicant" in c or "registered" in c, "applicants"),
        (lambda c: "seat" in c, "total_seats"),
    ])
    number = lambda c: F.replace(F.trim(F.col(c)), F.lit(","), F.lit("")).try_cast("bigint").alias(c)
    return named.select(number("year"), number("applicants"), number("total_seats"))


def read_dynamics(spark: SparkSession, path: str) -> DataFrame:
    return dynamics_from(spark.read.option("header", True).csv(path))


def seat_matrix_from(raw: DataFrame, row_id: str, file_column: str) -> DataFrame:
    """Long seat counts; continuation rows inherit institute and programme from above."""
    named = _rename(raw, [
        (lambda c: "institute" in c, "institute"),
        (lambda c: "program" in c and "total" not in c, "program"),
        (lambda c: "seat pool" in c or "seat_pool" in c, "seat_pool"),
        (lambda c: "state" in c and "seat" in c, "quota_type"),
    ])
    ids = [c for c in ("institute", "program", "seat_pool", "quota_type") if c in named.columns]
    filled = forward_fill(named, [c for c in ("institute", "program") if c in ids], row_id, file_column)
    seats = [c for c in filled.columns if c.upper().strip() in SEAT_CATEGORIES]
    return unpivot_seats(filled, ids, seats)


def _n_fields(record: Column) -> Column:
    """Fields of a raw CSV record: commas outside quotes, and one more."""
    bare = F.regexp_replace(record, '"[^"]*"', "")
    return F.length(bare) - F.length(F.replace(bare, F.lit(","), F.lit(""))) + 1


def read_seat_matrix(spark: SparkSession, path: str) -> DataFrame:
    """Seat sheets of one file or folder. Rows with more fields than the header are skipped, shorter
    rows keep what they have. Quoted fields may span lines, so a file (one yearly sheet) is one
    split and row order is file order; files are spread over tasks."""
    reader = (
        spark.read.option("header", True).option("multiLine", True).option("recursiveFileLookup", True)
        .option("columnPruning", False))
    header = reader.csv(path).schema
    raw = reader.schema(T.StructType([*header.fields, T.StructField("__record", T.StringType())])).option(
        "columnNameOfCorruptRecord", "__record").option("enforceSchema", True).csv(path)
    fitting = raw.where(F.coalesce(_n_fields(F.col("__record")) <= len(header), F.lit(True)))
    numbered = fitting.select("*", F.col("_metadata.file_path").alias("__file")).drop("__record")
    numbered = numbered.withColumn("__row", F.monotonically_increasing_id())
    return seat_matrix_from(numbered, "__row", "__file")
