"""Rolling-origin evaluation, error metrics, residual calibration and prediction intervals."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window, functions as F

from cutline.functions import scoring
from cutline.functions.keys import null_safe_join
from cutline.operators.quantiles import exact_median, lifted_quantile
from cutline.schemas import OUTCOME_KEY, STATIC_COLUMNS, TARGET

COVERAGE = 0.90
MIN_GROUP = 100
LAST, MEAN = "naive_last_year", "historical_mean"


def rolling_forecasts(observed: DataFrame) -> DataFrame:
    """Every origin of the last-year and historical-mean forecasters in one pass, no loop.

    The frame of origin t is the snapshot row of t-1, whose past statistics are the expanding
    window up to and including that row; its outcome is the next row of the key if that row is
    one year later. So one window over the outcome key replaces a join per origin.
    Rows without outcome keep a NULL ``actual_closing_rank``.
    """
    by_year = Window.partitionBy(*OUTCOME_KEY).orderBy("year")
    upto = by_year.rowsBetween(Window.unboundedPreceding, Window.currentRow)
    next_year = F.lead("year").over(by_year)
    return observed.select(
        (F.col("year") + 1).alias("origin"), *OUTCOME_KEY, *STATIC_COLUMNS,
        F.col(TARGET).alias("last_closing_rank"),
        F.avg(TARGET).over(upto).alias("hist_mean_closing_rank"),
        F.stddev_samp(TARGET).over(upto).alias("hist_std_closing_rank"),
        F.count(F.lit(1)).over(upto).alias("hist_year_count"),
        F.when(next_year == F.col("year") + 1, F.lead(TARGET).over(by_year)).alias("actual_closing_rank"),
    )


def matched_errors(forecasts: DataFrame, first_origin: int, last_origin: int) -> DataFrame:
    """(origin, model) rows with residuals, long form."""
    rows = forecasts.where(
        F.col("origin").between(first_origin, last_origin) & F.col("actual_closing_rank").isNotNull()
    )
    models = F.explode(F.array(
        F.struct(F.lit(LAST).alias("model"), F.col("last_closing_rank").cast("double").alias("predicted")),
        F.struct(F.lit(MEAN).alias("model"), F.col("hist_mean_closing_rank").alias("predicted")),
    ))
    return with_residuals(
        rows.select("origin", *OUTCOME_KEY, *STATIC_COLUMNS, "actual_closing_rank", models.alias("__m"))
        .select("origin", *OUTCOME_KEY, *STATIC_COLUMNS, "actual_closing_rank",
                F.col("__m.model").alias("model"), F.col("__m.predicted").alias("predicted_closing_rank"))
    )


def with_residuals(df: DataFrame) -> DataFrame:
    residual = F.col("actual_closing_rank") - F.col("predicted_closing_rank")
    return df.withColumns({
        "residual": residual,
        "abs_residual": F.abs(residual),
        "rank_band": scoring.rank_band(F.col("actual_closing_rank")),
    })


def regression_metrics(
    errors: DataFrame, keys: list[str], actual="actual_closing_rank", predicted="predicted_closing_rank",
) -> DataFrame:
    """n, mae, rmse, exact median absolute error, r2 per closed-domain group."""
    finite = lambda c: F.col(c).isNotNull() & ~F.isnan(F.col(c).cast("double")) & (F.abs(F.col(c).cast("double")) < float("inf"))
    e = errors.where(finite(actual) & finite(predicted)).select(
        *keys, F.col(actual).cast("double").alias("__y"), F.col(predicted).cast("double").alias("__p")
    ).withColumn("__e", F.abs(F.col("__y") - F.col("__p")))
    sums = e.groupBy(*keys).agg(
        F.count(F.lit(1)).alias("n"), F.avg("__e").alias("mae"),
        F.sqrt(F.avg(F.col("__e") * F.col("__e"))).alias("rmse"),
        F.sum(F.col("__e") * F.col("__e")).alias("__sse"),
        (F.var_pop("__y") * F.count(F.lit(1))).alias("__sst"),
    )
    medians = exact_median(e, keys, "__e", "median_absolute_error").drop("n")
    joined = (
        null_safe_join(sums, F.broadcast(medians), keys, "left") if keys
        else sums.join(F.broadcast(medians), how="left")
    )
    r2 = F.when(F.col("n") < 2, None).when(
        F.col("__sst") == 0, F.when(F.col("__sse") == 0, 1.0).otherwise(0.0)
    ).otherwise(1 - F.try_divide(F.col("__sse"), F.col("__sst")))
    return joined.withColumn("r2", r2).select(*keys, "n", "mae", "rmse", "median_absolute_error", "r2")


def subgroup_metrics(errors: DataFrame, keys: list[str] = []) -> DataFrame:
    """The same metrics by year, institute type, category and rank band, stacked."""
    dims = F.explode(F.array(*[
        F.struct(F.lit(name).alias("dimension"), F.col(column).cast("string").alias("value"))
        for name, column in (("year", "origin"), ("institute_type", "institute_type"),
                             ("category", "category"), ("rank_band", "rank_band"))
    ]))
    long = errors.select(*keys, "actual_closing_rank", "predicted_closing_rank", dims.alias("__d")).select(
        *keys, "__d.dimension", "__d.value", "actual_closing_rank", "predicted_closing_rank"
    )
    return regression_metrics(long, [*keys, "dimension", "value"])


def pool_by_origin(errors: DataFrame, origins: list[int]) -> DataFrame:
    """Residuals repeated for every later origin, after counting equal values once.

    ``origins`` is a short list of seasons, so the explode is bounded by the number of seasons.
    """
    small = errors.groupBy("model", "origin", "institute_type", "round", "abs_residual").agg(
        F.count(F.lit(1)).alias("copies")
    )
    later = F.filter(F.lit(origins), lambda o: o > F.col("origin"))
    return small.withColumn("for_origin", F.explode(later))


def calibration_tables(errors: DataFrame, keys: list[str] = [], coverage: float = COVERAGE, weight=None):
    """(global radius, radius per institute type and round), both per ``keys``."""
    quantile = lambda by: lifted_quantile(
        errors, by, "abs_residual", coverage, "abs_residual_quantile", weight
    )
    return quantile(keys), quantile([*keys, "institute_type", "round"])


def calibration_long(errors: DataFrame, coverage: float = COVERAGE) -> DataFrame:
    """Global row (type ``__default__``, round -1) and one row per (type, round)."""
    whole, groups = calibration_tables(errors, [], coverage)
    shape = lambda df, kind, rnd: df.select(
        kind.alias("institute_type_str"), rnd.cast("bigint").alias("round"), F.col("n").alias("count"),
        F.col("abs_residual_quantile").cast("double").alias("abs_residual_quantile"),
    )
    return shape(whole, F.lit("__default__"), F.lit(-1)).unionByName(
        shape(groups, F.col("institute_type"), F.col("round"))
    )


def apply_intervals(rows: DataFrame, whole: DataFrame, groups: DataFrame, keys: list[str],
                    min_group: int = MIN_GROUP) -> DataFrame:
    """Group radius where the group has enough residuals, else the global radius.

    Both tables are bounded by seasons x models x types x rounds, hence broadcast.
    """
    g = groups.withColumnsRenamed({"n": "__gn", "abs_residual_quantile": "__gq"})
    w = whole.withColumnsRenamed({"n": "calibration_count", "abs_residual_quantile": "interval_quantile_global"})
    out = null_safe_join(rows, F.broadcast(g), [*keys, "institute_type", "round"], "left")
    out = null_safe_join(out, F.broadcast(w), keys, "left") if keys else out.join(F.broadcast(w), how="left")
    radius = F.when(F.col("__gn") >= min_group, F.col("__gq")).otherwise(F.col("interval_quantile_global"))
    radius = radius.cast("double")
    return out.withColumns({
        "radius": radius,
        "lower": F.col("predicted_closing_rank") - radius,
        "upper": F.col("predicted_closing_rank") + radius,
    }).drop("__gn", "__gq")


def rolling_intervals(errors: DataFrame, origins: list[int]) -> DataFrame:
    """Errors with the interval an origin could have known: residuals of earlier origins only."""
    pool = pool_by_origin(errors, origins).drop("origin").withColumn(
        "origin", F.col("for_origin").cast("bigint")
    )
    whole, groups = calibration_tables(pool, ["model", "origin"], weight="copies")
    return apply_intervals(errors, whole, groups, ["model", "origin"])


def interval_metrics(intervals: DataFrame, keys: list[str]) -> DataFrame:
    known = F.col("radius").isNotNull()
    inside = F.col("actual_closing_rank").between(F.col("lower"), F.col("upper"))
    return intervals.groupBy(*keys).agg(
        F.avg(F.when(known, inside.cast("double"))).alias("prediction_interval_coverage"),
        F.avg(F.when(known, F.col("upper") - F.col("lower"))).alias("prediction_interval_mean_width"),
        F.max(F.coalesce(F.col("calibration_count"), F.lit(0))).alias("calibration_count"),
        F.max("interval_quantile_global").cast("double").alias("interval_quantile_global"),
    )


def fold_metrics(observed: DataFrame, first_origin: int, evaluation_years: list[int]) -> DataFrame:
    """One row per (origin, model): errors, interval quality and universe coverage."""
    last = max(evaluation_years)
    forecasts = rolling_forecasts(observed)
    errors = matched_errors(forecasts, first_origin, last)
    origins = list(range(first_origin, last + 1))
    intervals = rolling_intervals(errors.where(F.col("model") == LAST), origins)
    keys = ["origin", "model"]
    wanted = F.col("origin").isin(evaluation_years)
    metrics = regression_metrics(errors.where(wanted), keys)
    quality = interval_metrics(intervals.where(wanted), keys)
    counts = universe_counts(forecasts, observed).where(wanted)
    return null_safe_join(
        null_safe_join(metrics, F.broadcast(quality), keys, "left"), F.broadcast(counts), ["origin"], "left"
    )


def universe_counts(forecasts: DataFrame, observed: DataFrame) -> DataFrame:
    """Forecast, observed and matched rows per origin (one small row per season)."""
    f = forecasts.groupBy("origin").agg(
        F.count(F.lit(1)).alias("forecast_rows"), F.count("actual_closing_rank").alias("matched_rows")
    )
    o = observed.groupBy(F.col("year").alias("origin")).agg(F.count(F.lit(1)).alias("observed_rows"))
    return f.join(o, "origin").withColumns({
        "forecast_rows_without_observation": F.col("forecast_rows") - F.col("matched_rows"),
        "observed_rows_outside_prior_universe": F.col("observed_rows") - F.col("matched_rows"),
        "observed_universe_coverage": F.try_divide(
            F.col("matched_rows").cast("double"), F.col("observed_rows").cast("double")),
    })


def selection_summary(folds: DataFrame, final_year: int) -> DataFrame:
    """Mean validation errors per model over origins before the final year, with its place."""
    summary = folds.where(F.col("origin") < final_year).groupBy("model").agg(
        F.countDistinct("origin").alias("validation_origin_count"),
        F.avg("mae").alias("validation_mean_mae"),
        F.avg("rmse").alias("validation_mean_rmse"),
        F.avg("median_absolute_error").alias("validation_mean_median_absolute_error"),
    )
    # one row per model: the ordering window is over a handful of rows
    place = F.row_number().over(Window.orderBy("validation_mean_mae", "model"))
    return summary.withColumn("place", place)


def final_holdout(folds: DataFrame, final_year: int) -> DataFrame:
    """The model chosen on earlier origins, with its untouched final-year metrics."""
    chosen = selection_summary(folds, final_year).where(F.col("place") == 1)
    last = folds.where(F.col("origin") == final_year)
    return last.join(F.broadcast(chosen.select("model", "validation_mean_mae")), "model")


def macro_average(folds: DataFrame) -> DataFrame:
    return folds.groupBy("model").agg(
        F.count(F.lit(1)).alias("origins"), F.avg("mae").alias("macro_mae"),
        F.avg("rmse").alias("macro_rmse"), F.avg("median_absolute_error").alias("macro_median_absolute_error"),
        F.avg("r2").alias("macro_r2"),
    )


def residual_spread(errors: DataFrame, floor: float = 100.0) -> DataFrame:
    """Residual deviation per (type, round), never below ``floor``."""
    return errors.groupBy("institute_type", "round").agg(
        F.greatest(F.stddev_samp("residual"), F.lit(floor)).alias("std_dev")
    )
