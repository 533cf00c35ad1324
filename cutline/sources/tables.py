"""Table sinks and sources of the pipeline, and the relational (surrogate-key) layout."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window, functions as F, types as T

from cutline.session import broadcast_if_small, durable, scratch_folder, written


_STORED: dict[tuple[str, str], tuple[str, T.StructType]] = {}


def stored(spark: SparkSession, name: str, build, partition_by: str | list[str] | None = None) -> DataFrame:
    """A table written once per application to the shared folder and read back from there.

    Derived tables that many queries start from are computed one time; readers get column and
    partition pruning, and a lost executor costs a re-read instead of a recomputation.
    """
    key = (spark.sparkContext.applicationId, name)
    if key not in _STORED:
        table = build()
        path = scratch_folder(spark, "table")
        writer = table.write.mode("overwrite")
        (writer.partitionBy(partition_by) if partition_by else writer).parquet(path)
        _STORED[key] = (path, table.schema)
    path, schema = _STORED[key]
    return spark.read.schema(schema).parquet(path).select(*schema.names)


def read_master(spark: SparkSession, folder: str, schema: T.StructType) -> DataFrame:
    """Parquet copy when it can be read, else the CSV copy, both under one explicit schema."""
    from pyspark.errors import AnalysisException

    try:
        return spark.read.schema(schema).parquet(f"{folder}/master.parquet")
    except AnalysisException:
        return spark.read.schema(schema).option("header", True).csv(f"{folder}/master.csv")


def write_master(df: DataFrame, folder: str) -> None:
    """Partitioned by year, so year filters prune folders. Rows of one year are spread over
    tasks by the outcome key: a season holding most rows still gives many files."""
    df.write.mode("overwrite").partitionBy("year").parquet(f"{folder}/master.parquet")


def general_number(c: Column, digits: int = 10) -> Column:
    """Text with at most ``digits`` significant digits and no trailing zeros (as %.10g)."""
    exponent = F.floor(F.log10(F.abs(c))).cast("int")
    scientific = F.regexp_replace(F.format_string(f"%.{digits - 1}e", c), r"\.?0+e", "e")
    plain = F.format_string("%.0f", c)
    for places in range(1, digits + 4):
        fixed = F.regexp_replace(F.format_string(f"%.{places}f", c), r"\.?0+$", "")
        plain = F.when(F.lit(digits - 1) - exponent == places, fixed).otherwise(plain)
    return (
        F.when(c.isNull() | F.isnan(c), F.lit(None)).when(c == 0, F.lit("0"))
        .when((exponent < -4) | (exponent >= digits), scientific).otherwise(plain)
    )


def write_csv(df: DataFrame, path: str) -> None:
    """Header, LF ends, fractional numbers in at most ten significant digits."""
    columns = [
        general_number(F.col(f.name)).alias(f.name) if isinstance(f.dataType, (T.DoubleType, T.FloatType))
        else F.col(f.name) for f in df.schema.fields
    ]
    df.select(*columns).write.mode("overwrite").option("header", True).option("lineSep", "\n").csv(path)


def finite_or_null(df: DataFrame) -> DataFrame:
    """NaN and infinities become NULL, so that JSON stays valid."""
    bad = lambda c: F.isnan(c) | (F.abs(c) == float("inf"))
    return df.select(*[
        F.when(~bad(F.col(f.name)), F.col(f.name)).alias(f.name)
        if isinstance(f.dataType, (T.DoubleType, T.FloatType)) else F.col(f.name) for f in df.schema.fields])


def write_json(df: DataFrame, path: str) -> None:
    finite_or_null(df).write.mode("overwrite").json(path)


def dimension(df: DataFrame, column: str, first_code: int = 1000) -> DataFrame:
    """Distinct names with consecutive codes in name order, numbered without a global window.

    Names are range-partitioned and stored (a dimension table is kept anyway); each stored
    partition then gets an offset from the counts of the partitions before it.
    """
    names = df.select(column).where(F.col(column).isNotNull()).distinct()
    n = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    placed = durable(
        names.repartitionByRange(n, column).sortWithinPartitions(column)
        .select(column, F.spark_partition_id().alias("__p"), F.monotonically_increasing_id().alias("__i"))
    )
    parts = placed.groupBy("__p").agg(F.count(F.lit(1)).alias("__n"), F.min("__i").alias("__first"))
    # one row per partition
    offset = F.sum("__n").over(Window.orderBy("__p")) - F.col("__n")
    parts = parts.withColumn("__offset", offset).drop("__n")
    return placed.join(F.broadcast(parts), "__p").select(
        column, (F.col("__offset") + F.col("__i") - F.col("__first") + first_code).alias("code"))


def relational_layout(cutoffs: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(institutes, programs, cutoffs with institute_code and program_code).

    Rows lacking either rank are not loaded. The rest is stored once, since both dimensions and the facts
    read it; a dimension is broadcast when its measured size allows.
    """
    ranked = written(cutoffs.where(F.col("opening_rank").isNotNull() & F.col("closing_rank").isNotNull()), "ranked")
    institutes, programs = (broadcast_if_small(dimension(ranked, c), c) for c in ("institute", "program"))
    facts = (
        ranked.join(institutes.withColumnRenamed("code", "institute_code"), "institute")
        .join(programs.withColumnRenamed("code", "program_code"), "program").drop("institute", "program")
    )
    return institutes, programs, facts


def wide_history(institutes: DataFrame, programs: DataFrame, facts: DataFrame) -> DataFrame:
    """Facts with names again: the three-table join of the store."""
    return (
        facts.join(institutes, facts["institute_code"] == institutes["code"]).drop("code")
        .join(programs, F.col("program_code") == programs["code"]).drop("code")
    )
