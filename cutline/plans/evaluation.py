"""Rolling-origin evaluation, calibration and interval queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from cutline.operators import evaluation as ev, panel
from cutline.operators.learning import LastObservationRegressor
from cutline.plans.oracle_tables import METRICS, OUTCOME, lifted
from cutline.plans.registry import as_long, query, rounded
from cutline.schemas import OUTCOME_KEY
from cutline.sources import driver_tables as d


def _forecasts(spark, sf):
    return ev.rolling_forecasts(d.observed(spark, sf))


def _errors(spark, sf, first=d.ORIGIN_START):
    return ev.matched_errors(_forecasts(spark, sf), first, d.FINAL_YEAR)


def _naive(spark, sf):
    return _errors(spark, sf).where(F.col("model") == ev.LAST)


def _folds(spark, sf):
    """Metrics per evaluation origin and model."""
    return ev.regression_metrics(_errors(spark, sf, min(d.EVALUATION_YEARS)), ["origin", "model"])


@query("L1_last_observation", f"""SELECT {OUTCOME}, greatest(1, closing_rank) AS predicted_closing_rank FROM observed WHERE year = 2000""", ("observed",))
def _(spark, sf):
    frame = panel.target_frame(d.observed(spark, sf), 2001)
    return LastObservationRegressor().predict(frame).select(*OUTCOME_KEY, "predicted_closing_rank")


@query("L2_historical_mean", f"""SELECT origin, {OUTCOME}, round(hist_mean_closing_rank, 6) AS predicted_closing_rank FROM forecasts WHERE origin = 2001""", ("forecasts",))
def _(spark, sf):
    return rounded(_forecasts(spark, sf).where(F.col("origin") == 2001).select(
        "origin", *OUTCOME_KEY, F.col("hist_mean_closing_rank").alias("predicted_closing_rank")))


@query("L10_rolling_origins", f"""SELECT origin, {OUTCOME}, last_closing_rank, round(hist_mean_closing_rank, 6) AS hist_mean_closing_rank, hist_year_count, actual_closing_rank
 FROM forecasts WHERE origin BETWEEN 1997 AND 2001""", ("forecasts",))
def _(spark, sf):
    return rounded(_forecasts(spark, sf).where(F.col("origin").between(d.ORIGIN_START, d.FINAL_YEAR)).select(
        "origin", *OUTCOME_KEY, "last_closing_rank", "hist_mean_closing_rank", "hist_year_count", "actual_closing_rank"))


@query("L10_fold_metrics", """SELECT f.*, i.prediction_interval_coverage, i.prediction_interval_mean_width, coalesce(i.calibration_count, 0) AS calibration_count, i.interval_quantile_global,
 c.forecast_rows, c.matched_rows, o.observed_rows, c.forecast_rows - c.matched_rows AS forecast_rows_without_observation, o.observed_rows - c.matched_rows AS observed_rows_outside_prior_universe,
 round(c.matched_rows / CAST(o.observed_rows AS DOUBLE), 6) AS observed_universe_coverage
 FROM folds f LEFT JOIN (SELECT origin, model, round(avg(CASE WHEN actual_closing_rank BETWEEN predicted_closing_rank - radius AND predicted_closing_rank + radius THEN 1e0 ELSE 0e0 END), 6) AS prediction_interval_coverage,
  round(avg(2 * radius), 6) AS prediction_interval_mean_width, max(calibration_count) AS calibration_count, CAST(max(interval_quantile_global) AS DOUBLE) AS interval_quantile_global FROM intervals GROUP BY ALL) i
  ON f.origin = i.origin AND f.model = i.model
 JOIN (SELECT origin, count(*) AS forecast_rows, count(actual_closing_rank) AS matched_rows FROM forecasts GROUP BY 1) c ON f.origin = c.origin
 JOIN (SELECT year, count(*) AS observed_rows FROM observed GROUP BY 1) o ON f.origin = o.year""", ("folds", "intervals", "forecasts"))
def _(spark, sf):
    out = ev.fold_metrics(d.observed(spark, sf), d.ORIGIN_START, d.EVALUATION_YEARS)
    return rounded(out.withColumn("calibration_count", F.coalesce("calibration_count", F.lit(0))))


@query("A2_regression_metrics", f"SELECT model, {METRICS} FROM errors WHERE origin = 2001 GROUP BY model", ("errors",))
def _(spark, sf):
    return rounded(ev.regression_metrics(_errors(spark, sf).where(F.col("origin") == 2001), ["model"]))


@query("A3_subgroup_metrics", " UNION ALL ".join(
    f"SELECT model, '{n}' AS dimension, CAST({c} AS VARCHAR) AS value, {METRICS} FROM errors WHERE origin >= 1999 GROUP BY model, {c}"
    for n, c in (("year", "origin"), ("institute_type", "institute_type"), ("category", "category"), ("rank_band", "rank_band"))), ("errors",))
def _(spark, sf):
    return rounded(ev.subgroup_metrics(_errors(spark, sf, min(d.EVALUATION_YEARS)), ["model"]))


_SELECT = """SELECT *, row_number() OVER (ORDER BY validation_mean_mae, model) AS place FROM (SELECT model, count(DISTINCT origin) AS validation_origin_count, round(avg(mae), 6) AS validation_mean_mae,
 round(avg(rmse), 6) AS validation_mean_rmse, round(avg(median_absolute_error), 6) AS validation_mean_median_absolute_error FROM folds WHERE origin < 2001 GROUP BY model)"""


@query("A4_model_selection", _SELECT.replace("avg(mae), 6", "avg(mae), 4").replace("avg(rmse), 6", "avg(rmse), 4").replace("error), 6", "error), 4"), ("folds",))
def _(spark, sf):
    return rounded(ev.selection_summary(_folds(spark, sf), d.FINAL_YEAR), 4)


@query("L11_A36_final_holdout", f"""SELECT f.model, f.origin, f.n, round(f.mae, 4) AS mae, round(f.rmse, 4) AS rmse, round(f.median_absolute_error, 4) AS median_absolute_error, round(f.r2, 4) AS r2, round(s.validation_mean_mae, 4) AS validation_mean_mae
 FROM folds f JOIN ({_SELECT}) s ON f.model = s.model WHERE s.place = 1 AND f.origin = 2001""", ("folds",))
def _(spark, sf):
    return rounded(ev.final_holdout(_folds(spark, sf), d.FINAL_YEAR), 4)


@query("A5_macro_average", """SELECT model, count(*) AS origins, round(avg(mae), 4) AS macro_mae, round(avg(rmse), 4) AS macro_rmse,
 round(avg(median_absolute_error), 4) AS macro_median_absolute_error, round(avg(r2), 4) AS macro_r2 FROM folds GROUP BY model""", ("folds",))
def _(spark, sf):
    return rounded(ev.macro_average(_folds(spark, sf)), 4)


@query("A6_lifted_quantile", f"SELECT origin, n, CAST(abs_residual_quantile AS DOUBLE) AS abs_residual_quantile FROM ({lifted('(SELECT * FROM errors WHERE model = $$naive_last_year$$)', 'origin')})", ("errors",))
def _(spark, sf):
    from cutline.operators.quantiles import lifted_quantile

    out = lifted_quantile(_naive(spark, sf), ["origin"], "abs_residual", ev.COVERAGE, "abs_residual_quantile")
    return out.withColumn("abs_residual_quantile", F.col("abs_residual_quantile").cast("double"))


_CAL = f"""SELECT '__default__' AS institute_type_str, CAST(-1 AS BIGINT) AS round, n AS count, CAST(abs_residual_quantile AS DOUBLE) AS abs_residual_quantile
 FROM ({lifted('(SELECT * FROM errors WHERE model = $$naive_last_year$$)', '')}) UNION ALL
 SELECT institute_type, round, n, CAST(abs_residual_quantile AS DOUBLE) FROM ({lifted('(SELECT * FROM errors WHERE model = $$naive_last_year$$)', 'institute_type, round')})"""


@query("A7_calibration_table", _CAL, ("errors",))
def _(spark, sf):
    return ev.calibration_long(_naive(spark, sf))


@query("J6_J14_rolling_intervals", f"""SELECT origin, {OUTCOME}, predicted_closing_rank, actual_closing_rank, calibration_count, CAST(interval_quantile_global AS DOUBLE) AS interval_quantile_global, radius,
 predicted_closing_rank - radius AS lower, predicted_closing_rank + radius AS upper FROM intervals""", ("intervals",))
def _(spark, sf):
    out = ev.rolling_intervals(_naive(spark, sf), d.ORIGINS)
    return out.select("origin", *OUTCOME_KEY, "predicted_closing_rank", "actual_closing_rank", "calibration_count",
                      F.col("interval_quantile_global").cast("double").alias("interval_quantile_global"), "radius", "lower", "upper")


@query("A8_interval_quality", """SELECT origin, round(avg(CASE WHEN radius IS NOT NULL THEN CASE WHEN actual_closing_rank BETWEEN predicted_closing_rank - radius AND predicted_closing_rank + radius THEN 1e0 ELSE 0e0 END END), 6) AS prediction_interval_coverage,
 round(avg(2 * radius), 6) AS prediction_interval_mean_width, coalesce(max(calibration_count), 0) AS calibration_count, CAST(max(interval_quantile_global) AS DOUBLE) AS interval_quantile_global FROM intervals GROUP BY origin""", ("intervals",))
def _(spark, sf):
    return rounded(ev.interval_metrics(ev.rolling_intervals(_naive(spark, sf), d.ORIGINS), ["origin"]))


@query("A9_residual_spread", "SELECT institute_type, round, round(greatest(stddev_samp(residual), 100e0), 6) AS std_dev FROM errors WHERE model = 'naive_last_year' GROUP BY ALL", ("errors",))
def _(spark, sf):
    return rounded(ev.residual_spread(_naive(spark, sf)))


@query("M19_rank_bands", "SELECT origin, rank_band, count(*) AS rows FROM errors WHERE model = 'naive_last_year' GROUP BY ALL", ("errors",))
def _(spark, sf):
    return _naive(spark, sf).groupBy("origin", "rank_band").agg(F.count(F.lit(1)).alias("rows"))


@query("X10_origin_model_rows", "SELECT origin, model, count(*) AS rows FROM errors GROUP BY ALL", ("errors",))
def _(spark, sf):
    return _errors(spark, sf).groupBy("origin", "model").agg(F.count(F.lit(1)).alias("rows"))


@query("J14_history_by_origin", """SELECT CAST(o.origin AS BIGINT) AS origin, count(*) AS history_rows, CAST(sum(closing_rank) AS BIGINT) AS closing_sum, max(year) AS newest FROM observed JOIN (SELECT unnest([1999, 2000, 2001]) AS origin) o ON year < o.origin GROUP BY ALL""", ("observed",))
def _(spark, sf):
    # seasons are counted once, then each origin adds up the seasons before it
    per_year = d.observed(spark, sf).groupBy("year").agg(
        F.count(F.lit(1)).alias("n"), F.sum("closing_rank").alias("s"))
    later = F.explode(F.filter(F.lit(d.EVALUATION_YEARS), lambda o: o > F.col("year")))
    return per_year.select("year", "n", "s", later.alias("origin")).groupBy(as_long(F.col("origin")).alias("origin")).agg(
        F.sum("n").alias("history_rows"), F.sum("s").alias("closing_sum"), F.max("year").alias("newest"))
