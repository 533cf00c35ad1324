"""Raw round rows -> clean observed table."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F, types as T

from cutline.functions import text
from cutline.schemas import NATURAL_KEY
from cutline.session import written


def nulls_from_words(df: DataFrame) -> DataFrame:
    """Every string column: missing-value words become NULL."""
    return df.select(*[
        text.null_words_to_null(F.col(f"`{f.name}`")).alias(f.name)
        if isinstance(f.dataType, T.StringType) else F.col(f"`{f.name}`")
        for f in df.schema.fields
    ])


def parse_ranks(df: DataFrame) -> DataFrame:
    """Rank columns in three narrow steps, so no text expression is repeated in generated code."""
    o, c = F.col("__o"), F.col("__c")
    texts = df.withColumns({
        "__o": text.rank_text(F.col("`Opening Rank`")), "__c": text.rank_text(F.col("`Closing Rank`"))})
    numbers = texts.withColumns({
        "__on": text.rank_number(o), "__cn": text.rank_number(c),
        "is_pwd_rank": text.rank_has_suffix(o) | text.rank_has_suffix(c)})
    return numbers.withColumns({
        "opening_rank": text.cut_to_whole(F.col("__on")), "closing_rank": text.cut_to_whole(F.col("__cn")),
    }).drop("__o", "__c", "__on", "__cn")


def drop_unranked(df: DataFrame) -> DataFrame:
    """Drop rows with neither rank, then rows where a present rank is not positive."""
    # least() skips NULLs and is NULL only when both are: one test covers both rules
    return df.where(F.least("opening_rank", "closing_rank") > 0)


def normalise(df: DataFrame) -> DataFrame:
    """Closed-domain columns from the raw strings."""
    seat = F.col("`Seat Type`")
    trimmed = df.withColumns({
        "institute": F.trim(F.col("Institute")), "__base": text.seat_base(seat),
        "is_pwd": text.seat_is_pwd(seat), "gender": text.gender_label(F.col("Gender")),
        "quota": text.quota_label(F.col("Quota"))})
    return trimmed.withColumns({
        "institute_type": text.institute_type(F.col("institute")),
        **text.program_parts(F.col("`Academic Program Name`")),
        "category": text.seat_category(F.col("__base")),
    }).drop("__base")


def first_by_source(df: DataFrame, keys: list[str], order: list[str]) -> DataFrame:
    """One row per key: the first by ``order``. ``min_by`` combines map-side, so a key with a
    third of all copies costs one row per task, not one huge window. A hash of the key leads
    the grouping, which lets the sorts behind it compare a number instead of wide text."""
    rest = [c for c in df.columns if c not in keys and c not in order]
    packed = F.struct(*[F.col(f"`{c}`") for c in order], F.struct(*[F.col(f"`{c}`") for c in rest]).alias("__rest"))
    best = df.groupBy(F.xxhash64(*[F.col(f"`{k}`") for k in keys]).alias("__key"), *keys).agg(F.min_by(packed, F.struct(*[F.col(f"`{c}`") for c in order])).alias("__first"))
    return best.select(
        *keys, *[F.col(f"__first.`{c}`").alias(c) for c in order],
        *[F.col(f"__first.__rest.`{c}`").alias(c) for c in rest],
    )


def remove_duplicates(df: DataFrame, order=("source_file", "source_row_id")) -> DataFrame:
    return first_by_source(df, NATURAL_KEY, list(order))


def clean_rounds(raw: DataFrame, order=("source_file", "source_row_id")) -> DataFrame:
    """The whole ingest: words to NULL, ranks, drops, normalisation, first copy per key."""
    keep = [
        "year", "round", "institute", "institute_type", "program", "discipline",
        "duration_years", "degree_type", "quota", "category", "is_pwd", "gender",
        "opening_rank", "closing_rank", "is_pwd_rank",
    ]
    ranked = normalise(drop_unranked(parse_ranks(nulls_from_words(raw))))
    return remove_duplicates(ranked.select(*keep, *order), order)


def mapping_pairs(raw: DataFrame) -> DataFrame:
    """Distinct raw -> normalised values of every closed domain, long form."""
    sources = {"category": "Seat Type", "quota": "Quota", "gender": "Gender", "institute_type": "Institute"}
    normal = normalise(raw.withColumnsRenamed({s: f"__raw {d}" for d, s in sources.items()}).withColumns({
        s: F.col(f"`__raw {d}`") for d, s in sources.items()}))
    pairs = F.array(*[
        F.struct(F.lit(d).alias("domain"), F.coalesce(F.trim(F.col(f"`__raw {d}`")), F.lit("(empty)")).alias("raw"),
                 F.col(d).alias("normalised")) for d in sources])
    return normal.select(F.explode(pairs).alias("p")).select("p.*").distinct()


def forward_fill(df: DataFrame, columns: list[str], row_id: str, file_column: str) -> DataFrame:
    """Blank cells take the last non-blank value above, within one file of any length.

    A prefix scan: rows are cut into blocks of consecutive rows by a range partitioning on
    (file, row), each block hands its last non-blank values on, and blocks are then filled side
    by side. Only a file that crosses a border of blocks hands anything on, so what is broadcast
    is at most one row per block. NULL and blank cells count as blank, cells before the first
    value stay NULL, and ``row_id`` must be unique within a file (NULL is a file of its own).
    """
    from pyspark.sql import Window

    spark, names = df.sparkSession, df.columns
    # plain names inside: sheets have headers with dots and line breaks
    plain = df.toDF(*[f"c{i}" for i in range(len(names))])
    at = {n: f"c{i}" for i, n in enumerate(names)}
    file, row, cells = at[file_column], at[row_id], [at[c] for c in columns]
    n_blocks = int(spark.conf.get("spark.sql.shuffle.partitions"))
    blocks = written(
        plain.withColumns({c: F.nullif(F.trim(F.col(c)), F.lit("")) for c in cells})
        .repartitionByRange(n_blocks, file, row).withColumn("block", F.spark_partition_id()), "blocks")
    last = blocks.groupBy(file, "block").agg(*[
        F.max_by(c, F.when(F.col(c).isNotNull(), F.col(row))).alias(c) for c in cells])
    above = Window.partitionBy(file).orderBy("block").rowsBetween(Window.unboundedPreceding, -1)
    handed = last.select(
        F.col(file).alias("to_file"), F.col("block").alias("to_block"),
        *[F.last(c, ignorenulls=True).over(above).alias(f"handed_{c}") for c in cells])
    handed = handed.where(F.coalesce(*[F.col(f"handed_{c}") for c in cells]).isNotNull())
    inside = Window.partitionBy("block", file).orderBy(row).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    filled = blocks.join(
        F.broadcast(handed), (F.col("block") == F.col("to_block")) & F.col(file).eqNullSafe(F.col("to_file")), "left")
    return filled.select(*[
        (F.coalesce(F.last(c, ignorenulls=True).over(inside), F.col(f"handed_{c}")) if c in cells else F.col(c)).alias(n)
        for n, c in at.items()])


def unpivot_seats(df: DataFrame, id_columns: list[str], seat_columns: list[str]) -> DataFrame:
    """Category columns -> (category, seat_count); comma numbers parsed, gaps dropped."""
    long = df.unpivot(id_columns, [F.col(f"`{c}`") for c in seat_columns], "category", "seat_text")
    count = F.replace(F.col("seat_text"), F.lit(","), F.lit("")).try_cast("double")
    return (
        long.withColumn("seat_count", count.cast("bigint")).where(F.col("seat_count").isNotNull())
        .drop("seat_text")
    )


def percentile_columns(df: DataFrame, dynamics: DataFrame) -> DataFrame:
    """Left join of yearly applicants (one row per year, broadcast) and rank percentiles."""
    joined = df.join(F.broadcast(dynamics.select("year", "applicants")), "year", "left")
    share = lambda c: F.try_divide(F.col(c).cast("double"), F.col("applicants").cast("double"))
    return joined.withColumns({
        "opening_percentile": F.bround(share("opening_rank") * 100, 6),
        "closing_percentile": F.bround(share("closing_rank") * 100, 6),
        "competitiveness_ratio": F.bround(share("closing_rank"), 6),
    })
