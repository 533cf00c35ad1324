"""Contracts, checks and data-quality facts as tables (nothing is raised on executors)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F, types as T

from cutline.functions.keys import null_safe_join
from cutline.schemas import (
    CATEGORIES, GENDERS, INSTITUTE_TYPES, NATURAL_KEY, OUTCOME_KEY, QUOTAS, REQUIRED_OBSERVED, TARGET,
    UNIVERSE_FORBIDDEN, check_no_observed_columns, check_required,
)


def _stack(df: DataFrame, parts: list[tuple[Column, ...]], names: list[str]) -> DataFrame:
    return df.select(F.explode(F.array(*[
        F.struct(*[c.alias(n) for c, n in zip(p, names)]) for p in parts])).alias("s")).select("s.*")


def duplicate_keys(df: DataFrame, keys: list[str]) -> DataFrame:
    return df.groupBy(*keys).agg(F.count(F.lit(1)).alias("copies")).where(F.col("copies") > 1)


def observed_contract(df: DataFrame) -> DataFrame:
    """(check, violations): empty table, null year/round/target, repeated outcome keys."""
    check_required(df.columns)
    nulls = df.agg(
        F.count(F.lit(1)).alias("n"), F.count_if(F.col("year").isNull()).alias("y"),
        F.count_if(F.col("round").isNull()).alias("r"), F.count_if(F.col(TARGET).isNull()).alias("t"))
    dup = duplicate_keys(df, ["year", *OUTCOME_KEY]).agg(F.count(F.lit(1)).alias("d"))
    both = nulls.join(F.broadcast(dup), how="inner")
    c = F.col
    return _stack(both, [
        (F.lit("empty_table"), (c("n") == 0).cast("bigint")), (F.lit("null_year"), c("y")),
        (F.lit("null_round"), c("r")), (F.lit("null_target"), c("t")), (F.lit("duplicate_key_groups"), c("d")),
    ], ["check", "violations"])


def past_only_check(history: DataFrame, target_year: int) -> DataFrame:
    """First year not strictly before ``target_year`` and how many such rows; ok when none."""
    late = F.col("year") >= target_year
    return history.agg(
        F.min(F.when(late, F.col("year"))).alias("first_offending_year"), F.count_if(late).alias("offending_rows"),
        (F.count_if(late) == 0).alias("ok"))


def cleaned_checks(df: DataFrame) -> DataFrame:
    """(check, severity, count) over the cleaned table in one pass plus the duplicate count."""
    unknown = lambda c, domain: F.count_if(F.col(c).isNotNull() & ~F.col(c).isin(domain))
    o, c = F.col("opening_rank"), F.col("closing_rank")
    checks = [
        ("null_year", "critical", F.count_if(F.col("year").isNull())),
        ("null_round", "critical", F.count_if(F.col("round").isNull())),
        ("closing_not_positive", "critical", F.count_if(c <= 0)),
        ("year_out_of_range", "warning", F.count_if(~F.col("year").between(2010, 2030))),
        ("round_out_of_range", "warning", F.count_if(~F.col("round").between(1, 10))),
        ("unknown_category", "warning", unknown("category", CATEGORIES)),
        ("unknown_gender", "warning", unknown("gender", GENDERS)),
        ("unknown_quota", "warning", unknown("quota", QUOTAS)),
        ("unknown_institute_type", "warning", unknown("institute_type", INSTITUTE_TYPES)),
        ("opening_after_closing", "warning", F.count_if(o > c)),
    ]
    one = df.agg(*[e.alias(n) for n, _, e in checks])
    dup = df.groupBy(*NATURAL_KEY).agg((F.count(F.lit(1)) - 1).alias("x")).agg(
        F.coalesce(F.sum("x"), F.lit(0)).alias("duplicate_rows"))
    both = one.join(F.broadcast(dup), how="inner")
    rows = [(F.lit(n), F.lit(s), F.col(n)) for n, s, _ in checks]
    rows.append((F.lit("duplicate_rows"), F.lit("warning"), F.col("duplicate_rows")))
    return _stack(both, rows, ["check", "severity", "count"])


def quality_facts(df: DataFrame, cutoff_year: int) -> DataFrame:
    """Long table of quality facts before any year filter."""
    required = [c for c in REQUIRED_OBSERVED if c in df.columns]
    missing = [F.col(c).isNull() for c in required]
    any_missing = missing[0]
    cells = missing[0].cast("int")
    for m in missing[1:]:
        any_missing, cells = any_missing | m, cells + m.cast("int")
    dup = duplicate_keys(df, ["year", *OUTCOME_KEY]).agg(
        F.coalesce(F.sum("copies"), F.lit(0)).alias("duplicate_key_rows"), F.count(F.lit(1)).alias("duplicate_key_groups"))
    years = lambda cond: F.array_join(F.array_sort(F.collect_set(
        F.when(cond, F.col("year")))).cast("array<string>"), ",")
    old = F.col("year") <= cutoff_year
    one = df.agg(
        F.count(F.lit(1)).alias("full_rows"), F.count_if(old).alias("selected_rows"),
        F.count_if(~old).alias("post_cutoff_rows"), F.sum(cells).alias("missing_required_cells"),
        F.count_if(any_missing).alias("rows_missing_required"),
        F.count_if(F.col("opening_rank") > F.col("closing_rank")).alias("opening_after_closing"),
        years(F.lit(True)).alias("full_years"), years(old).alias("selected_years"), years(~old).alias("post_cutoff_years"))
    both = one.join(F.broadcast(dup), how="inner")
    return _stack(both, [(F.lit(n), F.col(n).cast("string")) for n in both.columns], ["fact", "value"])


def round_coverage(df: DataFrame, cutoff_year: int) -> DataFrame:
    """Rows, number of rounds and rows by round per season (seasons and rounds are few)."""
    counts = df.groupBy("year", "round").agg(F.count(F.lit(1)).alias("n"))
    return counts.groupBy("year").agg(
        F.sum("n").alias("rows"), F.count("round").alias("round_count"),
        F.array_join(F.transform(
            F.array_sort(F.collect_list(F.when(F.col("round").isNotNull(), F.struct("round", "n")))),
            lambda s: F.concat(s["round"].cast("string"), F.lit(":"), s["n"].cast("string"))), ",").alias("rows_by_round"),
        F.when(F.first("year") <= cutoff_year, "selected").otherwise("post_cutoff_excluded").alias("experiment_status"))


def column_profile(df: DataFrame, columns: list[str], approximate: bool = False) -> DataFrame:
    """Non-null count, its percent and distinct values per column.

    Exact distinct counts run per (column, value) pre-aggregate instead of one wide
    count-distinct, whose expansion repeats every row once per column with all its payload.
    """
    if approximate:
        one = df.agg(F.count(F.lit(1)).alias("__n"),
                     *[F.count(c).alias(f"{c}|c") for c in columns],
                     *[F.approx_count_distinct(c).alias(f"{c}|d") for c in columns])
        out = _stack(one, [(F.lit(c), F.col(f"`{c}|c`"), F.col("__n"), F.col(f"`{c}|d`")) for c in columns],
                     ["column", "non_null", "rows", "distinct_values"])
    else:
        long = _stack(df, [(F.lit(c), F.col(c).cast("string")) for c in columns], ["column", "value"])
        per = long.groupBy("column", "value").agg(F.count(F.lit(1)).alias("k"))
        out = per.groupBy("column").agg(
            F.coalesce(F.sum(F.when(F.col("value").isNotNull(), F.col("k"))), F.lit(0)).alias("non_null"),
            F.sum("k").alias("rows"), F.count("value").alias("distinct_values"))
    return out.select("column", "non_null", (F.lit(100.0) * F.col("non_null") / F.col("rows")).alias("percent"),
                      "distinct_values")


def missing_by_column(df: DataFrame, columns: list[str]) -> DataFrame:
    one = df.agg(*[F.count_if(F.col(c).isNull()).alias(c) for c in columns])
    return _stack(one, [(F.lit(c), F.col(c)) for c in columns], ["column", "missing"])


def universe_contract(universe: DataFrame, calibration: DataFrame, calibration_years: DataFrame, prediction_year: int) -> DataFrame:
    """Serving checks: one prediction year, sane calibration, earlier calibration years."""
    check_no_observed_columns(universe.columns, UNIVERSE_FORBIDDEN)
    c = F.col
    u = universe.agg(
        (F.count(F.lit(1)) == 0).cast("bigint").alias("empty_universe"),
        F.count_if(c("year").isNull() | (c("year") != prediction_year)).alias("wrong_prediction_year"))
    default = c("institute_type_str") == "__default__"
    k = calibration.agg(
        F.count_if(~F.coalesce((c("abs_residual_quantile") > 0) & (c("abs_residual_quantile") < float("inf")), F.lit(False))).alias("bad_quantile"),
        F.count_if(c("count") < 1).alias("bad_count"),
        F.count_if(~default & ~c("institute_type_str").isin(INSTITUTE_TYPES)).alias("unknown_type"),
        F.count_if(~default & ~c("round").between(1, 7)).alias("unknown_round"),
        (F.count_if(default) != 1).cast("bigint").alias("default_rows_not_one"))
    y = calibration_years.agg(F.count_if(c("year") >= prediction_year).alias("calibration_year_not_past"))
    wide = u.join(F.broadcast(k), how="inner").join(F.broadcast(y), how="inner")
    return _stack(wide, [(F.lit(n), F.col(n)) for n in wide.columns], ["check", "violations"])


def split_integrity(df: DataFrame) -> DataFrame:
    """Year range, row count and null cells per split, and whether splits are in time order."""
    cells = sum((F.col(f"`{c}`").isNull().cast("int") for c in df.columns if c != "split"), F.lit(0))
    per = df.where(F.col("split").isNotNull()).groupBy("split").agg(
        F.min("year").alias("first_year"), F.max("year").alias("last_year"),
        F.count(F.lit(1)).alias("rows"), F.sum(cells).alias("null_cells"))
    # three rows: the order check compares each split with the next
    from pyspark.sql import Window

    position = F.when(F.col("split") == "train", 0).when(F.col("split") == "valid", 1).otherwise(2)
    before = F.lag("last_year").over(Window.orderBy(position))
    return per.withColumn("in_time_order", F.coalesce(F.col("first_year") > before, F.lit(True)))


def cleaning_report(raw: DataFrame, ranked: DataFrame, cleaned: DataFrame) -> DataFrame:
    """Row counts by stage with the share dropped."""
    n = lambda df, name: df.agg(F.count(F.lit(1)).alias(name))
    wide = n(raw, "raw_rows").join(F.broadcast(n(ranked, "ranked_rows")), how="inner").join(
        F.broadcast(n(cleaned, "cleaned_rows")), how="inner")
    c = F.col
    return wide.select(
        "raw_rows", "ranked_rows", "cleaned_rows",
        (c("raw_rows") - c("ranked_rows")).alias("dropped_no_rank"),
        (c("ranked_rows") - c("cleaned_rows")).alias("dropped_duplicates"),
        (F.lit(100.0) * (c("raw_rows") - c("cleaned_rows")) / c("raw_rows")).alias("drop_percent"))
