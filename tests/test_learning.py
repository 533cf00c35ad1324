import numpy as np
import pytest
from pyspark.sql import functions as F

from cutline.operators import learning as ml, panel
from cutline.schemas import PRE_SEASON_FEATURES, check_features


@pytest.fixture(scope="module")
def observed(spark):
    rows = spark.range(0, 4000).select(
        (F.col("id") % 5 + 2016).alias("year"), (F.floor(F.col("id") / 5) % 2 + 1).alias("round"),
        F.concat(F.lit("I"), F.floor(F.col("id") / 10) % 20).alias("institute"),
        F.concat(F.lit("P"), F.floor(F.col("id") / 200) % 20).alias("program"),
        F.lit("OPEN").alias("category"), F.lit("AI").alias("quota"), F.lit("Gender-Neutral").alias("gender"),
        F.lit(False).alias("is_pwd"), F.lit("NIT").alias("institute_type"), F.lit(4).cast("bigint").alias("duration_years"),
        F.lit("B").alias("degree_type"),
        (F.lit(1000) + F.col("id") % 997).alias("opening_rank"),
        (F.lit(2000) + F.floor(F.col("id") / 10) % 20 * 100 + F.col("id") * 37 % 301).alias("closing_rank"))
    return rows.cache()


def test_feature_guard():
    check_features(PRE_SEASON_FEATURES, "pre_counselling")
    with pytest.raises(ValueError):
        check_features(["opening_rank"], "pre_counselling")
    with pytest.raises(ValueError):
        check_features(["prev_round_number"], "pre_counselling")
    check_features(["prev_round_number"], "in_round_update")


def test_ridge_equals_closed_form(observed):
    train = panel.longitudinal_panel(observed)
    model = ml.fit_ridge(train, PRE_SEASON_FEATURES)
    rows = model.design.apply(train).select("x", F.col("closing_rank").cast("double").alias("y")).collect()
    x = np.array([r["x"].toArray() for r in rows])
    y = np.array([r["y"] for r in rows])
    xc, yc = x - x.mean(0), y - y.mean()
    coef = np.linalg.solve(xc.T @ xc + ml.RIDGE_ALPHA * np.eye(x.shape[1]), xc.T @ yc)
    want = xc @ coef + y.mean()
    got = np.array([r["p"] for r in model.predict(train, "p").select("p").collect()])
    assert np.abs(np.sort(got) - np.sort(want)).max() < 1e-4
    # gaps of the first seasons became indicator columns
    assert "hist_mean_closing_rank" in model.design.gaps


def test_unseen_level_is_a_zero_vector(observed):
    train = panel.longitudinal_panel(observed)
    model = ml.fit_ridge(train, PRE_SEASON_FEATURES)
    vector = lambda df: dict(zip(model.design.column_names(), model.design.apply(df).first()["x"].toArray()))
    seen = train.limit(1)
    known, odd = vector(seen), vector(seen.withColumn("institute", F.lit("never seen")))
    ones = lambda v, f: sum(x for n, x in v.items() if n.startswith(f + "="))
    assert ones(known, "institute") == 1 and ones(odd, "institute") == 0
    assert ones(known, "program") == 1 and ones(odd, "program") == 1


def test_permutation_importance_ranks_signal_first(observed):
    train = panel.longitudinal_panel(observed)
    model = ml.fit_ridge(train, PRE_SEASON_FEATURES)
    out = {r["feature"]: r["importance_mean"] for r in ml.permutation_importance(
        model, train, ["year", "institute", "program", "round"], repeats=2).collect()}
    assert set(out) == set(PRE_SEASON_FEATURES)
    assert out["institute"] > out["gender"]
    assert abs(out["gender"]) < 1e-9


def test_trees_take_more_levels_than_bins(spark):
    """300 institutes; an institute of the scored row that training never saw is coded apart."""
    rows = spark.range(3000).select(
        F.concat(F.lit("Institute "), (F.col("id") % 300).cast("string")).alias("institute"),
        F.lit("IIT").alias("institute_type"), (F.col("id") % 7 + 1).alias("round"), ((F.col("id") % 300) * 10 + 1).alias(ml.TARGET))
    features = ["institute", "institute_type", "round"]
    for fit in (lambda t: ml.fit_forest(t, features, numTrees=3, maxDepth=6), lambda t: ml.fit_boosted(t, features, rounds=3)):
        model = fit(rows)
        assert "institute" in model.design.column_names()
        scored = model.predict(rows.limit(50).withColumn("institute", F.when(F.col("round") == 1, "new").otherwise(F.col("institute"))))
        assert scored.count() == 50 and scored.where("predicted_closing_rank is null").count() == 0
