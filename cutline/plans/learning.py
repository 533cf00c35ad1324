"""Fitted models: figures depend on an optimiser, so SQL checks what must hold whatever it finds
(cohorts, finite errors, exact policies, probability ranges), and tests check the optima.

All fits run on the brand-grain catalogue, whose categories are bounded.
"""

from __future__ import annotations

from pyspark.sql import functions as F

from cutline.functions import scoring
from cutline.functions.keys import null_safe_join
from cutline.operators import diagnostics as dg, evaluation as ev, learning as ml, panel, positions
from cutline.plans.registry import as_long, query, rounded
from cutline.schemas import OUTCOME_KEY, PRE_SEASON_FEATURES
from cutline.session import durable
from cutline.sources import driver_tables as d
from cutline.sources.tables import stored

# fewer and shallower trees than the library defaults keep a registered query short
QUICK_BOOSTING = {"rounds": 10}
QUICK_FOREST = {"numTrees": 10, "maxDepth": 6}


def _table(spark, sf):
    return d.observed(spark, sf, "brand")


def _splits(spark, sf):
    rows = durable(panel.split_by_year(panel.longitudinal_panel(_table(spark, sf)), 1999, [2000], [2001]))
    return [rows.where(F.col("split") == s).drop("split") for s in ("train", "valid", "test")]


def _quick_boost(train, features):
    return ml.fit_boosted(train, features, **QUICK_BOOSTING)


def _quick_forest(train, features):
    return ml.fit_forest(train, features, **QUICK_FOREST)


def _fold_store(spark, sf):
    """Predictions and residuals of all four models, fitted once per application and kept by model and origin: ridge and the
    last year at every origin (their residuals make later intervals), boosted trees at the evaluation seasons."""
    def build():
        table = d.observed(spark, sf)
        learned = ev.with_residuals(ml.fold_predictions(table, d.ORIGINS, d.EVALUATION_YEARS))
        return learned.unionByName(ev.matched_errors(ev.rolling_forecasts(table), d.ORIGIN_START, d.FINAL_YEAR).select(*learned.columns))

    return stored(spark, f"folds {sf}", build, ["model", "origin"])


def _store_metrics(spark, sf):
    return ev.regression_metrics(_fold_store(spark, sf).where(F.col("origin").isin(d.EVALUATION_YEARS)), ["origin", "model"])


@query("L3_L4_learned_folds")
def _(spark, sf):
    """Metrics of four models at every evaluation season, with intervals of the two whose residuals go further back."""
    wanted = F.col("origin").isin(d.EVALUATION_YEARS)
    errors = _fold_store(spark, sf).where(F.col("model").isin("ridge", ev.LAST))
    quality = ev.interval_metrics(ev.rolling_intervals(errors, d.ORIGINS).where(wanted), ["origin", "model"])
    return rounded(null_safe_join(_store_metrics(spark, sf), F.broadcast(quality), ["origin", "model"], "left"), 4)


@query("L10_fold_store_baselines", "SELECT * FROM folds", ("folds",))
def _(spark, sf):
    """The baselines as the store gives them back."""
    return rounded(_store_metrics(spark, sf).where(F.col("model").isin(ev.LAST, ev.MEAN)))


@query("L4_boosted_origins", """SELECT origin, count(*) AS n, true AS better_than_last_year, true AS better_than_mean FROM errors
 WHERE model = 'naive_last_year' AND origin >= 1999 GROUP BY origin""", ("errors",))
def _(spark, sf):
    """Boosted trees see the cohort of the baselines and have the smaller mean absolute error against both."""
    metrics = _store_metrics(spark, sf)
    base = metrics.groupBy("origin").pivot("model", [ev.LAST, ev.MEAN]).agg(F.first("mae"))
    return metrics.where(F.col("model") == "hist_gradient_boosting").join(F.broadcast(base), "origin").select(
        "origin", as_long(F.col("n")).alias("n"), (F.col("mae") < F.col(ev.LAST)).alias("better_than_last_year"),
        (F.col("mae") < F.col(ev.MEAN)).alias("better_than_mean"))


@query("A4_L11_selection_of_four")
def _(spark, sf):
    """Places of the four models on the seasons before the last, and the chosen one's untouched last season."""
    metrics = _store_metrics(spark, sf)
    chosen = ev.final_holdout(metrics, d.FINAL_YEAR).select("model", F.col("mae").alias("final_mae"), F.col("n").alias("final_n"))
    return rounded(ev.selection_summary(metrics, d.FINAL_YEAR).join(F.broadcast(chosen), "model", "left"), 4)


@query("L5_model_comparison")
def _(spark, sf):
    fits = {"ridge": ml.fit_ridge, "random_forest": _quick_forest, "boosted_trees": _quick_boost}
    return rounded(ml.compare_models(*_splits(spark, sf), PRE_SEASON_FEATURES, fits), 4)


@query("L6_random_search")
def _(spark, sf):
    train, valid, _ = _splits(spark, sf)
    grid = {"maxDepth": [3, 5], "minInstancesPerNode": [10, 20, 50], "numTrees": [5, 10]}
    return rounded(ml.random_search(train, valid, PRE_SEASON_FEATURES, ml.fit_forest, grid, n_iter=3), 4)


@query("L7_refit_and_test")
def _(spark, sf):
    return rounded(ml.refit_and_test(*_splits(spark, sf), PRE_SEASON_FEATURES, ml.fit_ridge), 4)


def _labelled(spark, sf):
    train, valid, test = _splits(spark, sf)
    return [ml.with_difficulty(x, train) for x in (train, valid, test)]


@query("L8_classifiers")
def _(spark, sf):
    train, _, test = _labelled(spark, sf)
    out = None
    for kind, options in (("logistic", {}), ("random_forest", {"numTrees": 10, "maxDepth": 6})):
        model = ml.fit_classifier(train, PRE_SEASON_FEATURES, kind, **options)
        rows = ml.classify(model, test).select(F.lit(kind).alias("model"), "cutoff_difficulty", "predicted", "score")
        out = rows if out is None else out.unionByName(rows)
    return rounded(dg.classification_metrics(out, ["model"], "cutoff_difficulty", "predicted", "score"), 4)


@query("L9_feature_importance")
def _(spark, sf):
    train, _, _ = _splits(spark, sf)
    a = ml.importance_table(spark, _quick_forest(train, PRE_SEASON_FEATURES)).withColumn("model", F.lit("random_forest"))
    b = ml.importance_table(spark, ml.fit_ridge(train, PRE_SEASON_FEATURES)).withColumn("model", F.lit("ridge"))
    return rounded(a.unionByName(b), 4)


@query("L12_ablations")
def _(spark, sf):
    return rounded(ml.ablations(_table(spark, sf), d.FINAL_YEAR), 4)


@query("L13_in_round_diagnostic")
def _(spark, sf):
    return rounded(ml.in_round_diagnostic(_table(spark, sf), d.FINAL_YEAR, 3), 4)


@query("A35_permutation_importance")
def _(spark, sf):
    train, valid, _ = _splits(spark, sf)
    model = ml.fit_ridge(train, PRE_SEASON_FEATURES)
    return rounded(ml.permutation_importance(model, valid, ["year", *OUTCOME_KEY]), 4)


@query("A35_permuted_rows", """SELECT rep, count(*) AS rows, count(*) AS donors, CAST(sum(closing_rank) AS BIGINT) AS closing_sum, count(DISTINCT institute) AS institutes, true AS most_moved
 FROM observed_b, (SELECT unnest([1, 2, 3]) AS rep) WHERE year = 2000 GROUP BY rep""", ("observed_b",))
def _(spark, sf):
    """In every repeat each row of the validation season gives its values exactly once."""
    out = positions.permuted(_splits(spark, sf)[1], ["closing_rank", "institute"], ["year", *OUTCOME_KEY], 3)
    return out.groupBy(as_long(F.col("__rep")).alias("rep")).agg(
        F.count(F.lit(1)).alias("rows"), F.countDistinct("__donor").alias("donors"), F.sum("__d_closing_rank").cast("bigint").alias("closing_sum"),
        F.countDistinct("__d_institute").alias("institutes"), (F.count_if(F.col("__donor") != F.col("__key")) * 2 > F.count(F.lit(1))).alias("most_moved"))


@query("L3_L10_ridge_origins", """SELECT origin, count(*) AS n, true AS finite FROM errors_b WHERE model = 'naive_last_year' AND origin >= 1999 GROUP BY origin""", ("errors_b",))
def _(spark, sf):
    """Ridge at every evaluation season: its cohort is that of the baselines."""
    rows = ml.learned_folds(_table(spark, sf), d.EVALUATION_YEARS, {"ridge": ml.fit_ridge})
    metrics = ev.regression_metrics(rows, ["origin"])
    return metrics.select("origin", as_long(F.col("n")).alias("n"), (F.abs("mae") + F.abs("rmse") < float("inf")).alias("finite"))


@query("L7_refit_cohort", "SELECT count(*) AS n, true AS finite FROM observed_b WHERE year = 2001", ("observed_b",))
def _(spark, sf):
    out = ml.refit_and_test(*_splits(spark, sf), PRE_SEASON_FEATURES, ml.fit_ridge)
    return out.select(as_long(F.col("n")).alias("n"), (F.abs("mae") + F.abs("rmse") < float("inf")).alias("finite"))


@query("L8_probability_range", "SELECT count(*) AS n, true AS in_range, true AS agrees FROM observed_b WHERE year = 2001", ("observed_b",))
def _(spark, sf):
    train, _, test = _labelled(spark, sf)
    scored = ml.classify(ml.fit_classifier(train, PRE_SEASON_FEATURES, "logistic"), test)
    return scored.agg(F.count(F.lit(1)).alias("n"), F.bool_and(F.col("score").between(0, 1)).alias("in_range"),
                      F.bool_and((F.col("score") > 0.5) == (F.col("predicted") == 1)).alias("agrees"))


@query("L9_importance_sum", "SELECT 'random_forest' AS model, true AS sums_to_one, true AS non_negative, count(DISTINCT institute) > 0 AS fitted FROM observed_b", ("observed_b",))
def _(spark, sf):
    train, _, _ = _splits(spark, sf)
    table = ml.importance_table(spark, _quick_forest(train, PRE_SEASON_FEATURES))
    return table.agg(F.lit("random_forest").alias("model"), (F.abs(F.sum("value") - 1) < 1e-9).alias("sums_to_one"),
                     (F.min("value") >= 0).alias("non_negative"), (F.count(F.lit(1)) > 0).alias("fitted"))


@query("L12_ablation_policies", """SELECT variant, policy_compliant, copy_of_full, n FROM (VALUES ('ridge_full_pre_counselling', true, true), ('ridge_without_historical_statistics', true, false),
 ('ridge_without_frequency_encodings', true, false), ('legacy_same_round_opening_diagnostic', false, false), ('ridge_without_opening_rank_features', true, true), ('ridge_without_previous_round_features', true, true))
 v(variant, policy_compliant, copy_of_full), LATERAL (SELECT CASE WHEN policy_compliant THEN (SELECT count(*) FROM errors_b WHERE model = 'naive_last_year' AND origin = 2001) ELSE (SELECT count(*) FROM observed_b WHERE year = 2001) END AS n)""", ("errors_b", "observed_b"))
def _(spark, sf):
    """The leaky variant alone breaks the policy and sees every observed row; excluded features change nothing."""
    rows = ml.ablations(_table(spark, sf), d.FINAL_YEAR)
    full = rows.where(F.col("variant") == "ridge_full_pre_counselling").select(F.col("mae").alias("full_mae"), F.col("rmse").alias("full_rmse"))
    return rows.join(F.broadcast(full), how="inner").select(
        "variant", "policy_compliant", ((F.col("mae") == F.col("full_mae")) & (F.col("rmse") == F.col("full_rmse"))).alias("copy_of_full"),
        as_long(F.col("n")).alias("n"))
