"""Spark ML forecasters over the past-only panel, their diagnostics and ablations.

Fits read their rows many times, so panels are stored once (reliable checkpoint) before fitting.
Fitting works on the bounded catalogue of institutes and programmes; only model state (medians,
spreads, level lists, coefficients) reaches the driver.
"""

from __future__ import annotations

import random
from collections.abc import Callable
from concurrent.futures import ThreadPoolExecutor
from dataclasses import dataclass

from pyspark import inheritable_thread_target
from pyspark.ml import Model
from pyspark.ml.classification import LogisticRegression, RandomForestClassifier
from pyspark.ml.feature import OneHotEncoder, StringIndexer, VectorAssembler, VectorSlicer
from pyspark.ml.functions import vector_to_array
from pyspark.ml.regression import LinearRegression, RandomForestRegressor
from pyspark.ml.stat import Summarizer
from pyspark.sql import DataFrame, SparkSession, Window, functions as F

from cutline.functions import scoring
from cutline.operators.boosting import ALONE_ROWS, Boosted, fit_boosting, with_boosted
from cutline.operators.evaluation import regression_metrics
from cutline.operators.panel import longitudinal_panel, match_counts, match_outcomes, target_frame
from cutline.operators.positions import permuted
from cutline.operators.quantiles import exact_median
from cutline.session import durable
from cutline.schemas import (
    CATEGORICAL_FEATURES, FEATURES_BY_MODE, FREQUENCY_FEATURES, HISTORY_FEATURES, OUTCOME_KEY,
    PREVIOUS_ROUND_FEATURES, STATIC_COLUMNS, TARGET, check_features,
)

# --- fixed values -------------------------------------------------------------------------
RIDGE_ALPHA = 10.0
BOOSTING = {"rounds": 120, "rate": 0.06, "leaves": 31, "least": 30, "l2": 1.0}
FOREST = {"numTrees": 200, "maxDepth": 20, "minInstancesPerNode": 5, "seed": 42}
RARE_BELOW = 2
SEED = 42
FITS_AT_ONCE = 4  # small jobs of several fits fill the cores between them; each keeps its training rows cached


def _level(feature: str, mode: str, rare: list[str]):
    """Category text with gaps as the most frequent level and rare levels pooled."""
    c = F.coalesce(F.col(feature), F.lit(mode))
    return F.when(c.isin(rare), "__rare").otherwise(c) if rare else c


def side_by_side(spark: SparkSession, steps: dict[object, Callable]) -> dict:
    """Results of steps (name -> function) whose Spark jobs do not depend on each other, some of them run at a time."""
    with ThreadPoolExecutor(FITS_AT_ONCE) as pool:
        started = {name: pool.submit(inheritable_thread_target(spark)(step)) for name, step in steps.items()}
        return {name: step.result() for name, step in started.items()}


@dataclass
class Design:
    """Fitted preprocessing: medians, spreads and category levels of the training rows."""

    features: list[str]
    medians: dict[str, float]
    spreads: dict[str, float]
    gaps: list[str]
    modes: dict[str, str]
    rare: dict[str, list[str]]
    indexer: Model | None
    encoder: Model | None
    kept: list[int] | None = None

    @property
    def numeric(self) -> list[str]:
        return [f for f in self.features if f not in CATEGORICAL_FEATURES]

    @property
    def categorical(self) -> list[str]:
        return [f for f in self.features if f in CATEGORICAL_FEATURES]

    def width(self) -> int:
        return len(self.column_names())

    def apply(self, df: DataFrame) -> DataFrame:
        """Adds vector column ``x``: numbers, gap indicators, then category columns."""
        columns = {}
        for f in self.numeric:
            c = F.col(f).cast("double")
            columns[f"__n_{f}"] = F.coalesce(c, F.lit(self.medians[f])) / F.lit(self.spreads[f])
            if f in self.gaps:
                columns[f"__g_{f}"] = c.isNull().cast("double") / F.lit(self.spreads[f"gap {f}"])
        for f in self.categorical:
            columns[f"__c_{f}"] = _level(f, self.modes[f], self.rare[f])
        out = df.withColumns(columns)
        names = [f"__n_{f}" for f in self.numeric] + [f"__g_{f}" for f in self.gaps]
        if self.indexer is not None:
            out = self.indexer.transform(out)
        if self.encoder is not None:
            out = self.encoder.transform(out)
            names += [f"__o_{f}" for f in self.categorical]
        else:
            # plain ordinal numbers (unseen: -1) instead of nominal codes, which bound the number of levels
            for f, labels in zip(self.categorical, self.indexer.labelsArray):
                code = F.col(f"__i_{f}").cast("double")
                out = out.withColumn(f"__k_{f}", F.when(code >= len(labels), F.lit(-1.0)).otherwise(code))
            names += [f"__k_{f}" for f in self.categorical]
        if self.kept is None:
            scored = VectorAssembler(inputCols=names, outputCol="x").transform(out)
        else:
            full = VectorAssembler(inputCols=names, outputCol="__full").transform(out)
            scored = VectorSlicer(inputCol="__full", outputCol="x", indices=self.kept).transform(full)
        return scored.select(*df.columns, "x")

    def drop_constant(self, rows: DataFrame) -> bool:
        """Leave out columns without spread in ``rows``: their coefficient is zero anyway, and
        they would make the moment matrix singular. True when something was dropped."""
        spread = rows.select(Summarizer.variance(F.col("x"))).first()[0].toArray()
        kept = [i for i, v in enumerate(spread) if v > 0]
        if len(kept) == len(spread):
            return False
        self.kept = kept
        return True

    def column_names(self) -> list[str]:
        names = [*self.numeric, *[f"gap {f}" for f in self.gaps]]
        if self.encoder is not None:
            for f, labels in zip(self.categorical, self.indexer.labelsArray):
                names += [f"{f}={label}" for label in labels]
        else:
            names += self.categorical
        return names if self.kept is None else [names[i] for i in self.kept]


def fit_design(train: DataFrame, features: list[str], one_hot: bool = True) -> Design:
    numeric = [f for f in features if f not in CATEGORICAL_FEATURES]
    categorical = [f for f in features if f in CATEGORICAL_FEATURES]
    long = train.select(F.explode(F.array(*[
        F.struct(F.lit(f).alias("f"), F.col(f).cast("double").alias("v")) for f in numeric])).alias("s")).select("s.*")
    medians = {r["f"]: r["m"] for r in exact_median(long, ["f"], "v", "m").collect()}
    medians = {f: medians.get(f, 0.0) for f in numeric}
    filled = lambda f: F.coalesce(F.col(f).cast("double"), F.lit(medians[f]))
    facts = train.agg(
        *[F.stddev_pop(filled(f)).alias(f) for f in numeric],
        *[F.stddev_pop(F.col(f).isNull().cast("double")).alias(f"gap {f}") for f in numeric],
        *[F.count_if(F.col(f).isNull()).alias(f"n {f}") for f in numeric],
    ).first().asDict()
    gaps = [f for f in numeric if facts[f"n {f}"] > 0]
    spreads = {k: (v if v else 1.0) for k, v in facts.items() if not k.startswith("n ")}
    modes, rare = {}, {}
    if categorical:
        levels = train.select(F.explode(F.array(*[
            F.struct(F.lit(f).alias("f"), F.col(f).alias("v")) for f in categorical])).alias("s")).select("s.*")
        counts = levels.where(F.col("v").isNotNull()).groupBy("f", "v").agg(F.count(F.lit(1)).alias("n"))
        top = counts.groupBy("f").agg(F.max_by("v", F.struct("n", "v")).alias("mode")).collect()
        modes = {f: "" for f in categorical} | {r["f"]: r["mode"] for r in top}
        few = counts.where(F.col("n") < RARE_BELOW).collect()
        rare = {f: sorted(r["v"] for r in few if r["f"] == f) for f in categorical} if one_hot else {f: [] for f in categorical}
    design = Design(features, medians, spreads if one_hot else {k: 1.0 for k in spreads}, gaps, modes, rare, None, None)
    if categorical:
        ready = train.select(*[_level(f, modes[f], rare[f]).alias(f"__c_{f}") for f in categorical])
        design.indexer = StringIndexer(
            inputCols=[f"__c_{f}" for f in categorical], outputCols=[f"__i_{f}" for f in categorical],
            handleInvalid="keep", stringOrderType="alphabetAsc").fit(ready)
        if one_hot:
            # the extra index of unseen levels comes last and is the dropped one: a zero vector
            design.encoder = OneHotEncoder(
                inputCols=[f"__i_{f}" for f in categorical], outputCols=[f"__o_{f}" for f in categorical],
                dropLast=True).fit(design.indexer.transform(ready))
    return design


@dataclass
class Forecaster:
    design: Design
    model: Model

    def predict(self, df: DataFrame, name: str = "predicted_closing_rank") -> DataFrame:
        return self.model.transform(self.design.apply(df)).drop("x").withColumnRenamed("prediction", name)


def fit_ridge(train: DataFrame, features: list[str], alpha: float = RIDGE_ALPHA) -> Forecaster:
    """L2 linear model with the penalty alpha of the sum-of-squares form.

    The iterative solver is used at every width. Spark averages the loss and divides the penalty
    by the label's sample deviation.
    """
    design = fit_design(train, features)
    design.drop_constant(design.apply(train))
    rows = design.apply(train).select("x", F.col(TARGET).cast("double").alias("label")).persist()
    try:
        n, spread = rows.agg(F.count(F.lit(1)), F.stddev_samp("label")).first()
        model = LinearRegression(
            featuresCol="x", elasticNetParam=0.0, standardization=False, solver="l-bfgs",
            regParam=alpha * spread / n, maxIter=500, tol=1e-9).fit(rows)
    finally:
        rows.unpersist()
    return Forecaster(design, model)


def _fit_tree(estimator, train: DataFrame, features: list[str]) -> Forecaster:
    design = fit_design(train, features, one_hot=False)
    rows = design.apply(train).select("x", F.col(TARGET).cast("double").alias("label")).persist()
    try:
        model = estimator.setFeaturesCol("x").fit(rows)
    finally:
        rows.unpersist()
    return Forecaster(design, model)


@dataclass
class BoostedForecaster:
    design: Design
    model: Boosted

    def predict(self, df: DataFrame, name: str = "predicted_closing_rank") -> DataFrame:
        return with_boosted(self.design.apply(df), self.model, name)


def fit_boosted_sets(trains: dict, features: list[str], **overrides) -> dict:
    """A boosted forecaster per training set (name -> rows); all are grown by the same passes."""
    spark = next(iter(trains.values())).sparkSession if trains else None
    designs = side_by_side(spark, {name: lambda train=train: fit_design(train, features, one_hot=False) for name, train in trains.items()})
    tables = {name: designs[name].apply(train).select(vector_to_array("x").alias("x"), F.col(TARGET).alias("label")) for name, train in trains.items()}
    models = fit_boosting(tables, **{**BOOSTING, "alone_rows": ALONE_ROWS, **overrides})
    return {name: BoostedForecaster(designs[name], model) for name, model in models.items()}


def fit_boosted(train: DataFrame, features: list[str], **overrides) -> BoostedForecaster:
    return fit_boosted_sets({"": train}, features, **overrides)[""]


def fit_forest(train: DataFrame, features: list[str], **overrides) -> Forecaster:
    return _fit_tree(RandomForestRegressor(**{**FOREST, "maxBins": 256, **overrides}), train, features)


def origin_tables(observed: DataFrame, panel: DataFrame, year: int) -> tuple[DataFrame, DataFrame]:
    """(training rows before ``year``, matched forecast rows of ``year``)."""
    frame = target_frame(observed, year)
    return panel.where(F.col("year") < year), durable(match_outcomes(frame, observed, year))


def learned_folds(observed: DataFrame, years: list[int], models: dict) -> DataFrame:
    """Predictions of each named fit at each origin, long form: one fit per origin and model."""
    panel = durable(longitudinal_panel(observed))
    features = check_features(FEATURES_BY_MODE["pre_counselling"], "pre_counselling")
    out = None
    for year in years:
        train, matched = origin_tables(observed, panel, year)
        for name, fit in models.items():
            rows = fit(train, features).predict(matched).select(
                F.lit(year).cast("bigint").alias("origin"), F.lit(name).alias("model"), "institute_type", "category",
                "round", "actual_closing_rank", "predicted_closing_rank")
            out = rows if out is None else out.unionByName(rows)
    return out


def fold_predictions(observed: DataFrame, origins: list[int], boosted_origins: list[int], **boosting) -> DataFrame:
    """(origin, model, outcome key, static columns, actual, predicted) of ridge at ``origins`` and of boosted trees at
    ``boosted_origins``, each fitted on the seasons before its origin; the boosted fits share their passes."""
    panel = durable(longitudinal_panel(observed))
    features = check_features(FEATURES_BY_MODE["pre_counselling"], "pre_counselling")
    spark = observed.sparkSession
    tables = side_by_side(spark, {year: lambda year=year: origin_tables(observed, panel, year) for year in sorted({*origins, *boosted_origins})})
    # the passes of the boosted fits and the iterations of the ridge fits are small jobs that fill each other's gaps
    steps = {"boosted": lambda: fit_boosted_sets({year: tables[year][0] for year in boosted_origins}, features, **boosting)}
    steps |= {year: lambda year=year: fit_ridge(tables[year][0], features) for year in origins}
    fitted = side_by_side(spark, steps)
    models = [(year, "ridge", fitted[year]) for year in origins]
    models += [(year, "hist_gradient_boosting", model) for year, model in fitted["boosted"].items()]
    out = None
    for year, name, model in models:
        rows = model.predict(tables[year][1]).select(
            F.lit(year).cast("bigint").alias("origin"), F.lit(name).alias("model"), *OUTCOME_KEY, *STATIC_COLUMNS,
            "actual_closing_rank", "predicted_closing_rank")
        out = rows if out is None else out.unionByName(rows)
    return out


def ablations(observed: DataFrame, final_year: int) -> DataFrame:
    """Ridge refits without history, without frequencies, and with the forbidden opening rank;
    variants whose features are already excluded repeat the full row."""
    panel = durable(longitudinal_panel(observed))
    full = FEATURES_BY_MODE["pre_counselling"]
    train, matched = origin_tables(observed, panel, final_year)
    variants = {
        "ridge_full_pre_counselling": full,
        "ridge_without_historical_statistics": [f for f in full if f not in HISTORY_FEATURES],
        "ridge_without_frequency_encodings": [f for f in full if f not in FREQUENCY_FEATURES],
    }
    scored = None
    for name, features in variants.items():
        rows = fit_ridge(train, features).predict(matched).select(
            F.lit(name).alias("variant"), F.lit(len(features)).alias("feature_count"), F.lit(True).alias("policy_compliant"),
            "actual_closing_rank", "predicted_closing_rank")
        scored = rows if scored is None else scored.unionByName(rows)
    leaky = lambda df: df.withColumn("log_opening_rank", F.log1p(F.col("opening_rank").cast("double")))
    more = [*full, "opening_rank", "log_opening_rank"]
    peek = fit_ridge(leaky(train), more).predict(leaky(panel.where(F.col("year") == final_year))).select(
        F.lit("legacy_same_round_opening_diagnostic").alias("variant"), F.lit(len(more)).alias("feature_count"),
        F.lit(False).alias("policy_compliant"), F.col(TARGET).alias("actual_closing_rank"), "predicted_closing_rank")
    metrics = regression_metrics(scored.unionByName(peek), ["variant", "feature_count", "policy_compliant"])
    same = ["ridge_without_opening_rank_features", "ridge_without_previous_round_features"]
    copies = metrics.where(F.col("variant") == "ridge_full_pre_counselling").withColumn(
        "variant", F.explode(F.lit(same)))
    return metrics.unionByName(copies)


def in_round_tables(observed: DataFrame, year: int, round_: int) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(training panel, matched rows of one round after its earlier rounds, match counts)."""
    frame = target_frame(observed, year, target_round=round_, completed=observed)
    cohort = observed.where(F.col("round") == round_)
    panel = longitudinal_panel(observed, "in_round_update").where(F.col("year") < year)
    return durable(panel), durable(match_outcomes(frame, cohort, year)), match_counts(frame, cohort, year)


def in_round_diagnostic(observed: DataFrame, year: int, round_: int) -> DataFrame:
    """Ridge with and without the previous round's cutoff on the same round cohort."""
    train, matched, counts = in_round_tables(observed, year, round_)
    full = FEATURES_BY_MODE["in_round_update"]
    variants = {
        "ridge_in_round_with_previous_round": full,
        "ridge_in_round_without_previous_round": [f for f in full if f not in PREVIOUS_ROUND_FEATURES],
    }
    scored = None
    for name, features in variants.items():
        rows = fit_ridge(train, features).predict(matched).select(
            F.lit(name).alias("variant"), "actual_closing_rank", "predicted_closing_rank")
        scored = rows if scored is None else scored.unionByName(rows)
    return regression_metrics(scored, ["variant"]).join(F.broadcast(counts), how="inner")


def compare_models(train: DataFrame, valid: DataFrame, test: DataFrame, features: list[str], fits: dict) -> DataFrame:
    """Metrics on every split per model; ``place`` orders models by validation MAE."""
    parts = None
    for name, fit in fits.items():
        model = fit(train, features)
        for split, df in (("train", train), ("valid", valid), ("test", test)):
            rows = model.predict(df).select(
                F.lit(name).alias("model"), F.lit(split).alias("split"),
                F.col(TARGET).alias("actual_closing_rank"), "predicted_closing_rank")
            parts = rows if parts is None else parts.unionByName(rows)
    metrics = regression_metrics(parts, ["model", "split"])
    by_valid = Window.partitionBy("split").orderBy("mae", "model")
    return metrics.withColumn("place", F.row_number().over(by_valid))


def random_search(train: DataFrame, valid: DataFrame, features: list[str], fit, grid: dict[str, list], n_iter: int, seed: int = SEED) -> DataFrame:
    """Seeded sample of the grid, each fitted on train and scored on the one validation year."""
    names = sorted(grid)
    combos = [{}]
    for name in names:
        combos = [{**c, name: v} for c in combos for v in grid[name]]
    picked = random.Random(seed).sample(combos, min(n_iter, len(combos)))
    scored = None
    for i, params in enumerate(picked):
        rows = fit(train, features, **params).predict(valid).select(
            F.lit(i).alias("candidate"), F.lit(",".join(f"{k}={params[k]}" for k in names)).alias("params"),
            F.col(TARGET).alias("actual_closing_rank"), "predicted_closing_rank")
        scored = rows if scored is None else scored.unionByName(rows)
    metrics = regression_metrics(scored, ["candidate", "params"])
    return metrics.withColumn("place", F.row_number().over(Window.orderBy("mae", "candidate")))


def refit_and_test(train: DataFrame, valid: DataFrame, test: DataFrame, features: list[str], fit) -> DataFrame:
    model = fit(train.unionByName(valid), features)
    rows = model.predict(test).withColumnRenamed(TARGET, "actual_closing_rank")
    return regression_metrics(rows, [])


def with_difficulty(df: DataFrame, train: DataFrame) -> DataFrame:
    """Label 1 where the cutoff is at or below its history, or the train median without one."""
    median = exact_median(train, [], TARGET, "__median").drop("n")
    base = F.coalesce("hist_mean_closing_rank", "__median")
    return df.join(F.broadcast(median), how="inner").withColumn(
        "cutoff_difficulty", F.coalesce((F.col(TARGET) <= base).cast("int"), F.lit(0))).drop("__median")


def fit_classifier(train: DataFrame, features: list[str], kind: str = "logistic", **overrides) -> Forecaster:
    one_hot = kind == "logistic"
    design = fit_design(train, features, one_hot=one_hot)
    rows = design.apply(train).select("x", F.col("cutoff_difficulty").cast("double").alias("label"))
    estimator = (
        LogisticRegression(featuresCol="x", maxIter=100, regParam=overrides.get("regParam", 1e-4)) if one_hot
        else RandomForestClassifier(featuresCol="x", maxBins=256, **{"numTrees": 100, "maxDepth": 10, "seed": SEED, **overrides})
    )
    return Forecaster(design, estimator.fit(rows))


def classify(model: Forecaster, df: DataFrame) -> DataFrame:
    out = model.model.transform(model.design.apply(df))
    return out.select(*df.columns, F.col("prediction").cast("int").alias("predicted"),
                      vector_to_array("probability")[1].alias("score"))


def importance_table(spark, forecaster: Forecaster) -> DataFrame:
    """Impurity importances or coefficients by magnitude, named by vector slot."""
    names, m = forecaster.design.column_names(), forecaster.model
    values = m.featureImportances if hasattr(m, "featureImportances") else m.coefficients
    rows = [(n, float(v), abs(float(v))) for n, v in zip(names, values.toArray())]
    return spark.createDataFrame(rows, "feature string, value double, magnitude double")


def permutation_importance(forecaster: Forecaster, rows: DataFrame, id_columns: list[str], repeats: int = 5) -> DataFrame:
    """Mean and deviation of the MAE increase when one feature's values change rows.

    Values are permuted over the whole table (``positions.permuted``), by one permutation per repeat for
    all features; every (feature, repeat) copy is scored in one pass.
    """
    features = forecaster.design.features
    base = rows.select(*features, F.col(TARGET).cast("double").alias("__y"), *[c for c in id_columns if c not in features])
    paired = permuted(base, features, id_columns, repeats)
    copies = paired.withColumn("__f", F.explode(F.lit(features)))
    swapped = copies.select("__f", "__rep", "__y", *[
        F.when(F.col("__f") == f, F.col(f"__d_{f}")).otherwise(F.col(f)).alias(f) for f in features])
    per = forecaster.predict(swapped, "__p").groupBy("__f", "__rep").agg(F.avg(F.abs(F.col("__y") - F.col("__p"))).alias("mae"))
    plain = forecaster.predict(base, "__p").agg(F.avg(F.abs(F.col("__y") - F.col("__p"))).alias("base"))
    return per.join(F.broadcast(plain), how="inner").groupBy(F.col("__f").alias("feature")).agg(
        F.avg(F.col("mae") - F.col("base")).alias("importance_mean"),
        F.stddev_pop(F.col("mae") - F.col("base")).alias("importance_std"))


class LastObservationRegressor:
    """Forecast = the newest past value; rows without one are an error to be counted."""

    def __init__(self, feature: str = "last_closing_rank"):
        self.feature = feature

    def predict(self, df: DataFrame, name: str = "predicted_closing_rank") -> DataFrame:
        return df.withColumn(name, scoring.predicted_rank(F.col(self.feature)))

    def unusable(self, df: DataFrame) -> DataFrame:
        c = F.col(self.feature).cast("double")
        return df.where(c.isNull() | F.isnan(c) | (F.abs(c) == float("inf")))
