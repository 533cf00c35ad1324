"""Past-only features, forecast frames, and season-shape columns.

Windows here are partitioned by a key under which (year) or (year, round) is unique, so one
window group holds at most one row per season and round however large the table grows. Counts
by institute or programme, whose groups are not bounded, are aggregated first and joined.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from cutline.functions import scoring
from cutline.functions.keys import null_safe_join
from cutline.operators.cleaning import first_by_source
from cutline.schemas import (
    BRANCH_KEY, CHOICE_KEY, HISTORY_KEY, OUTCOME_KEY, STATIC_COLUMNS, TARGET,
    check_features, check_no_observed_columns, check_required, FEATURES_BY_MODE,
)


def prior_year_statistics(df: DataFrame) -> DataFrame:
    """Per outcome key: count, last, mean, sample deviation over strictly earlier years."""
    by_year = Window.partitionBy(*OUTCOME_KEY).orderBy("year")
    before = by_year.rowsBetween(Window.unboundedPreceding, -1)
    last_year = F.lag("year").over(by_year)
    return df.withColumns({
        "hist_year_count": F.count(F.lit(1)).over(before),
        "last_closing_rank": F.lag(TARGET).over(by_year),
        "last_observed_year": last_year,
        "years_since_observed": F.col("year") - last_year,
        "hist_mean_closing_rank": F.avg(TARGET).over(before),
        "hist_std_closing_rank": F.stddev_samp(TARGET).over(before),
        "years_since_ews": scoring.years_since_ews(F.col("year")),
    })


def past_frequency(df: DataFrame, identity: str, name: str) -> DataFrame:
    """Rows of the same identity in whole earlier years; the row's own year never counts."""
    yearly = df.groupBy(identity, "year").agg(F.count(F.lit(1)).alias("__n"))
    before = Window.partitionBy(identity).orderBy("year").rowsBetween(Window.unboundedPreceding, -1)
    past = yearly.select(identity, "year", F.coalesce(F.sum("__n").over(before), F.lit(0)).alias(name))
    return null_safe_join(df, past, [identity, "year"], "left")


def past_frequencies(df: DataFrame) -> DataFrame:
    return past_frequency(past_frequency(df, "institute", "institute_freq"), "program", "program_freq")


def previous_round(df: DataFrame) -> DataFrame:
    """Cutoff and number of the latest earlier round of the same season and choice."""
    w = Window.partitionBy("year", *CHOICE_KEY).orderBy("round")
    return df.withColumns({
        "prev_round_closing_rank": F.lag(TARGET).over(w),
        "prev_round_number": F.lag("round").over(w),
    })


def rows_until(observed: DataFrame, cutoff_year: int) -> DataFrame:
    """Rows of seasons up to ``cutoff_year``; an error where that season itself has no row, as a cutoff nothing was
    observed at would pass off older data as current."""
    if observed.where(F.col("year") == cutoff_year).isEmpty():
        raise ValueError(f"no rows of the cutoff season {cutoff_year}")
    return observed.where(F.col("year") <= cutoff_year)


def longitudinal_panel(observed: DataFrame, mode: str = "pre_counselling") -> DataFrame:
    check_required(observed.columns)
    check_features(FEATURES_BY_MODE[mode], mode)
    panel = past_frequencies(prior_year_statistics(observed))
    return previous_round(panel) if mode == "in_round_update" else panel


def history_aggregates(history: DataFrame) -> DataFrame:
    return history.groupBy(*OUTCOME_KEY).agg(
        F.avg(TARGET).alias("hist_mean_closing_rank"),
        F.stddev_samp(TARGET).alias("hist_std_closing_rank"),
        F.count(TARGET).alias("hist_year_count"),
        F.max_by(TARGET, "year").alias("last_closing_rank"),
        F.max("year").alias("last_observed_year"),
    )


def latest_completed_round(completed: DataFrame, target_year: int, target_round: int) -> DataFrame:
    """One row per choice: the last round before ``target_round`` of the running season."""
    rows = completed.where((F.col("year") == target_year) & (F.col("round") < target_round))
    latest = F.max_by(F.struct("round", TARGET), "round")
    return rows.groupBy(*CHOICE_KEY).agg(latest.alias("__l")).select(
        *CHOICE_KEY,
        F.col("__l.round").alias("prev_round_number"),
        F.col(f"__l.{TARGET}").alias("prev_round_closing_rank"),
    )


def target_frame(
    observed: DataFrame, target_year: int, *, snapshot_year: int | None = None,
    target_round: int | None = None, completed: DataFrame | None = None,
    extra_columns: tuple[str, ...] = (),
) -> DataFrame:
    """Forecast universe for ``target_year``: last season's rows re-dated, past statistics only.

    Two shuffles on the outcome key become one because snapshot columns ride along in the
    history aggregate as the row of the snapshot year.
    """
    snapshot_year = target_year - 1 if snapshot_year is None else snapshot_year
    if snapshot_year >= target_year:
        raise ValueError("snapshot_year must be before target_year")
    if completed is not None and target_round is None:
        raise ValueError("completed rounds need exactly one target_round")
    check_required(observed.columns)
    history = observed.where(F.col("year") < target_year)
    statics = [*STATIC_COLUMNS, *extra_columns]
    is_snapshot = F.col("year") == snapshot_year
    per_key = history.groupBy(*OUTCOME_KEY).agg(
        F.max(F.when(is_snapshot, F.struct(*statics))).alias("__s"),
        F.avg(TARGET).alias("hist_mean_closing_rank"),
        F.stddev_samp(TARGET).alias("hist_std_closing_rank"),
        F.count(TARGET).alias("hist_year_count"),
        F.max_by(TARGET, "year").alias("last_closing_rank"),
        F.max("year").alias("last_observed_year"),
    )
    frame = per_key.where(F.col("__s").isNotNull()).select(
        F.lit(target_year).cast("bigint").alias("year"),
        F.lit(snapshot_year).cast("bigint").alias("snapshot_year"),
        *OUTCOME_KEY, *[F.col(f"__s.{c}").alias(c) for c in statics],
        "hist_mean_closing_rank", "hist_std_closing_rank", "hist_year_count",
        "last_closing_rank", "last_observed_year",
    )
    if target_round is not None:
        frame = frame.where(F.col("round") == target_round)
    for identity, name in (("institute", "institute_freq"), ("program", "program_freq")):
        counts = history.groupBy(identity).agg(F.count(F.lit(1)).alias(name))
        frame = null_safe_join(frame, counts, [identity], "left").withColumn(
            name, F.coalesce(F.col(name), F.lit(0))
        )
    frame = frame.withColumns({
        "years_since_observed": F.col("year") - F.col("last_observed_year"),
        "years_since_ews": scoring.years_since_ews(F.col("year")),
    })
    if completed is not None:
        latest = latest_completed_round(completed, target_year, target_round)
        frame = null_safe_join(frame, latest, CHOICE_KEY, "left")
    check_no_observed_columns(frame.columns)
    return frame


def match_outcomes(forecast: DataFrame, observed: DataFrame, target_year: int) -> DataFrame:
    actual = observed.where(F.col("year") == target_year).select(
        *OUTCOME_KEY, F.col(TARGET).alias("actual_closing_rank")
    )
    return null_safe_join(forecast, actual, OUTCOME_KEY, "inner")


def match_counts(forecast: DataFrame, observed: DataFrame, target_year: int) -> DataFrame:
    """Both sides' row counts and the matched share in one full outer join."""
    f = forecast.select(*OUTCOME_KEY, F.lit(True).alias("__f"))
    a = observed.where(F.col("year") == target_year).select(*OUTCOME_KEY, F.lit(True).alias("__a"))
    both = null_safe_join(f, a, OUTCOME_KEY, "full")
    n = lambda cond: F.count_if(F.coalesce(cond, F.lit(False)))
    hit = F.col("__f") & F.col("__a")
    return both.agg(
        n(F.col("__f")).alias("forecast_rows"), n(F.col("__a")).alias("observed_rows"),
        n(hit).alias("matched_rows"),
        n(F.col("__f") & F.col("__a").isNull()).alias("forecast_rows_without_observation"),
        n(F.col("__a") & F.col("__f").isNull()).alias("observed_rows_outside_prior_universe"),
    ).withColumn(
        "observed_universe_coverage",
        F.try_divide(F.col("matched_rows").cast("double"), F.col("observed_rows").cast("double")),
    )


def outside_universe(observed: DataFrame, forecast: DataFrame, target_year: int) -> DataFrame:
    """Observed rows the forecast could not have listed (anti join)."""
    return null_safe_join(
        observed.where(F.col("year") == target_year), forecast.select(*OUTCOME_KEY), OUTCOME_KEY, "left_anti"
    )


def without_outcome(forecast: DataFrame, observed: DataFrame, target_year: int) -> DataFrame:
    return null_safe_join(
        forecast, observed.where(F.col("year") == target_year).select(*OUTCOME_KEY), OUTCOME_KEY, "left_anti"
    )


def final_rounds(df: DataFrame, key: list[str], order: list[str]) -> DataFrame:
    """The last-round row of every (year, key); ties go to the first by ``order``."""
    ranked = df.withColumn("__late", -F.col("round"))
    return first_by_source(ranked, ["year", *key], ["__late", *order]).drop("__late")


def season_shape(df: DataFrame) -> DataFrame:
    """rank_spread, final-round flag, change against the previous round and previous year."""
    season = Window.partitionBy("year", *BRANCH_KEY)
    in_season = season.orderBy("round")
    spread = F.col(TARGET) - F.col("opening_rank")
    marked = df.withColumns({
        "rank_spread": spread,
        "final_round": F.max("round").over(season),
        "round_progression": F.col(TARGET) - F.lag(TARGET).over(in_season),
    }).withColumn("is_final_round", (F.col("round") == F.col("final_round")).cast("int"))
    # splitting by the flag keeps lag() among final rounds without a second join
    finals = Window.partitionBy(*BRANCH_KEY, "is_final_round").orderBy("year", "round")
    change = F.when(F.col("is_final_round") == 1, F.col(TARGET) - F.lag(TARGET).over(finals))
    return marked.withColumn("closing_rank_yoy_change", change)


def history_by_branch(df: DataFrame) -> DataFrame:
    """Final-round mean/std/min/max/count of strictly earlier years, joined to every row.

    One row per (year, key): ranks of one final round of that season; key has no PwD flag, so
    of several pools the non-PwD one speaks for the branch.
    """
    finals = final_rounds(df, HISTORY_KEY, ["is_pwd"])
    before = Window.partitionBy(*HISTORY_KEY).orderBy("year").rowsBetween(Window.unboundedPreceding, -1)
    # a key may skip seasons: carry every (year, key) that occurs, then fill its past
    seasons = df.select("year", *HISTORY_KEY).distinct()
    known = null_safe_join(
        seasons, finals.select("year", *HISTORY_KEY, F.col(TARGET).alias("__r")), ["year", *HISTORY_KEY], "left"
    )
    r = F.col("__r")
    past = known.select(
        "year", *HISTORY_KEY,
        F.avg(r).over(before).alias("hist_mean_closing_rank"),
        F.stddev_samp(r).over(before).alias("hist_std_closing_rank"),
        F.min(r).over(before).alias("hist_min_closing_rank"),
        F.max(r).over(before).alias("hist_max_closing_rank"),
        F.nullif(F.count(r).over(before), F.lit(0)).alias("hist_year_count"),
    )
    return null_safe_join(df, past, ["year", *HISTORY_KEY], "left")


def previous_round_by_branch(df: DataFrame, tie: list[str]) -> DataFrame:
    """Previous row's cutoff when pools share a key: ordered by round, then pool, then ``tie``."""
    w = Window.partitionBy("year", *HISTORY_KEY).orderBy("round", "is_pwd", *tie)
    return df.withColumn("prev_round_closing_rank", F.lag(TARGET).over(w))


def branch_by_year(finals: DataFrame, years: list[int]) -> DataFrame:
    """Wide table branch x year; the year list is given, so no extra job finds it."""
    return finals.groupBy(*BRANCH_KEY).pivot("year", years).agg(F.first(TARGET))


def split_by_year(df: DataFrame, train_until: int, valid: list[int], test: list[int]) -> DataFrame:
    overlap = set(valid) & set(test) or {y for y in [*valid, *test] if y <= train_until}
    if overlap:
        raise ValueError(f"years in more than one split: {sorted(overlap)}")
    y = F.col("year")
    return df.withColumn(
        "split",
        F.when(y <= train_until, "train").when(y.isin(valid), "valid").when(y.isin(test), "test"),
    )
