"""Row numbers and permutations of whole tables, without a global window."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window, functions as F

from cutline.session import written


def numbered(df: DataFrame, order: list[str], name: str = "position") -> DataFrame:
    """0-based position of every row by ``order``: ranges are sorted side by side and stored, and the counts
    of the ranges before it (one row per range) give each its offset. Rows of equal ``order`` take
    consecutive positions in any order."""
    n_ranges = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    placed = written(
        df.repartitionByRange(n_ranges, *order).sortWithinPartitions(*order)
        .withColumns({"__range": F.spark_partition_id(), "__id": F.monotonically_increasing_id()}), "numbered")
    ranges = placed.groupBy("__range").agg(F.count(F.lit(1)).alias("__n"), F.min("__id").alias("__first"))
    # one row per range
    before = F.sum("__n").over(Window.orderBy("__range")) - F.col("__n")
    ranges = ranges.select("__range", "__first", before.alias("__before"))
    return placed.join(F.broadcast(ranges), "__range").withColumn(
        name, F.col("__before") + F.col("__id") - F.col("__first")).drop("__range", "__id", "__first", "__before")


def permuted(df: DataFrame, columns: list[str], id_columns: list[str], repeats: int) -> DataFrame:
    """Every row ``repeats`` times, each time with the ``columns`` of another row of the whole table.

    Adds ``__rep`` (from 1), ``__donor`` (hash of the donor's id) and ``__d_<column>``. In a repeat every row gives its values
    exactly once: rows in order of their id hash meet rows in order of a hash of id and repeat. Ids
    that occur more than once keep this; only which of their rows gives first is open.
    """
    keyed = df.withColumn("__key", F.xxhash64(*id_columns))
    own = numbered(keyed, ["__key"], "__at")
    total = own.agg(F.count(F.lit(1)).alias("__total"))
    each = F.explode(F.sequence(F.lit(1), F.lit(repeats))).alias("__rep")
    own = own.join(F.broadcast(total), how="inner").select("*", each)
    own = own.withColumn("__at", F.col("__at") + F.col("__total") * (F.col("__rep") - 1)).drop("__total")
    # all repeats are numbered at once: repeat r takes positions from (r - 1) * total on
    donor = keyed.select("__key", *columns, each).withColumn("__draw", F.xxhash64("__key", "__rep"))
    donor = numbered(donor, ["__rep", "__draw", "__key"], "__at").select(
        "__at", F.col("__key").alias("__donor"), *[F.col(f"`{c}`").alias(f"__d_{c}") for c in columns])
    return own.join(donor, "__at").drop("__at")
