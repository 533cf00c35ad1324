import math
import random

import pytest
from pyspark.sql import functions as F

from cutline.operators import diagnostics as dg, evaluation as ev, panel, quality
from cutline.operators.quantiles import exact_percentiles, lifted_quantile
from cutline.schemas import OBSERVED_ONLY_COLUMNS


def test_prior_statistics(panel_rows):
    out = panel.longitudinal_panel(panel_rows).where("institute = 'Institute A' AND round = 1").orderBy("year").collect()
    assert out[0]["hist_year_count"] == 0 and out[0]["last_closing_rank"] is None and out[0]["hist_mean_closing_rank"] is None
    assert out[2]["hist_year_count"] == 2 and out[2]["last_closing_rank"] == 221 and out[2]["hist_mean_closing_rank"] == 211.0
    assert out[1]["hist_std_closing_rank"] is None and out[2]["hist_std_closing_rank"] == pytest.approx(math.sqrt(200))
    assert out[1]["institute_freq"] == 2 and out[1]["program_freq"] == 4


def test_target_frame(panel_rows):
    frame = panel.target_frame(panel_rows, 2022)
    assert not set(frame.columns) & set(OBSERVED_ONLY_COLUMNS)
    rows = frame.collect()
    assert len(rows) == 4
    assert {(r["institute_freq"], r["program_freq"], r["years_since_observed"]) for r in rows} == {(8, 16, 1)}
    with pytest.raises(ValueError):
        panel.target_frame(panel_rows, 2022, snapshot_year=2022)


def test_future_rows_never_change_features(panel_rows):
    frame = lambda df: sorted(map(tuple, panel.target_frame(df, 2021).collect()))
    changed = panel_rows.withColumn("closing_rank", F.when(F.col("year") >= 2021, 9).otherwise(F.col("closing_rank")))
    assert frame(panel_rows) == frame(changed)


def test_in_round_frame(panel_rows):
    rows = panel.target_frame(panel_rows, 2022, target_round=2, completed=panel_rows).collect()
    assert len(rows) == 2 and {r["prev_round_number"] for r in rows} == {1}
    assert {r["prev_round_closing_rank"] for r in rows} == {281, 331}


def test_null_keys_match(panel_rows):
    holes = panel_rows.withColumn("quota", F.lit(None).cast("string"))
    assert panel.match_outcomes(panel.target_frame(holes, 2022), holes, 2022).count() == 4


def test_coverage_identity(panel_rows, spark):
    extra = panel_rows.where("year = 2022 AND round = 1").withColumn("program", F.lit("New"))
    table = panel_rows.unionByName(extra)
    c = panel.match_counts(panel.target_frame(table, 2022), table, 2022).first()
    assert (c["forecast_rows"], c["observed_rows"], c["matched_rows"]) == (4, 6, 4)
    assert c["matched_rows"] + c["observed_rows_outside_prior_universe"] == c["observed_rows"]
    assert c["observed_universe_coverage"] == pytest.approx(4 / 6)


def test_quality_facts(panel_rows):
    facts = {r["fact"]: r["value"] for r in quality.quality_facts(panel_rows, 2021).collect()}
    assert facts["selected_rows"] == "16" and facts["post_cutoff_rows"] == "4" and facts["duplicate_key_rows"] == "0"


def test_contract_sees_duplicates(panel_rows):
    twice = panel_rows.unionByName(panel_rows.limit(1))
    got = {r["check"]: r["violations"] for r in quality.observed_contract(twice).collect()}
    assert got["duplicate_key_groups"] == 1 and got["null_target"] == 0


@pytest.mark.parametrize("n", [1, 2, 4, 10, 99, 100, 1000])
def test_lifted_quantile(spark, n):
    values = [float(v) for v in random.Random(n).sample(range(10 * n), n)]
    df = spark.createDataFrame([(v,) for v in values], "abs_residual double")
    lifted = min(1.0, math.ceil((n + 1) * 0.9) / n)
    want = sorted(values)[math.ceil((n - 1) * lifted)]
    assert lifted_quantile(df, [], "abs_residual", 0.9, "q").first()["q"] == want


def test_percentiles_on_skew_and_ties(spark):
    # one group holds nearly everything, with one value holding a third of it
    rows = [("hot", float(i * i)) for i in range(3000)] + [("hot", 5.0)] * 1500 + [("cold", float(i)) for i in range(7)] + [("hot", None)]
    df = spark.createDataFrame(rows, "g string, v double")
    got = {r["g"]: r for r in exact_percentiles(df, ["g"], "v", {"a": 0.01, "b": 0.5, "c": 0.999}).collect()}
    for g in ("hot", "cold"):
        values = sorted(v for k, v in rows if k == g and v is not None)
        for name, q in (("a", 0.01), ("b", 0.5), ("c", 0.999)):
            at = q * (len(values) - 1)
            lo = values[math.floor(at)]
            want = lo + (values[math.ceil(at)] - lo) * (at - math.floor(at))
            assert got[g][name] == pytest.approx(want), (g, name)
        assert got[g]["n"] == len(values)


def test_calibration_refuses_nothing_and_counts(spark):
    rows = spark.createDataFrame(
        [("NIT", 1, 100.0), ("NIT", 1, 150.0), ("IIT", 2, 200.0), ("IIT", 2, 250.0)], "institute_type string, round bigint, abs_residual double")
    got = {(r["institute_type_str"], r["round"]): (r["count"], r["abs_residual_quantile"]) for r in ev.calibration_long(rows).collect()}
    assert got == {("__default__", -1): (4, 250.0), ("NIT", 1): (2, 150.0), ("IIT", 2): (2, 250.0)}


def test_selection_ignores_final_year(spark):
    rows = [(2020, "a", 1.0), (2021, "a", 3.0), (2022, "a", 99.0), (2020, "b", 3.0), (2021, "b", 3.0), (2022, "b", 0.0)]
    folds = spark.createDataFrame([(y, m, e, e, e, 0.5) for y, m, e in rows], "origin int, model string, mae double, rmse double, median_absolute_error double, r2 double")
    assert ev.selection_summary(folds, 2022).where("place = 1").first()["model"] == "a"
    assert ev.final_holdout(folds, 2022).first()["mae"] == 99.0


def test_value_ranks_match_sorting(spark):
    r = random.Random(3)
    values = [float(r.choice([1, 1, 2, 5, r.random() * 100])) for _ in range(4000)]
    df = spark.createDataFrame([("g", v) for v in values], "g string, v double")
    got = {x["v"]: x["p"] for x in dg.add_average_rank(df, ["g"], "v", "p", descending=False).collect()}
    ordered = sorted(values)
    for v in list(got)[:200]:
        first = ordered.index(v)
        assert got[v] == first + (ordered.count(v) + 1) / 2


def test_kendall_against_pairs(spark):
    r = random.Random(5)
    pts = [(r.randint(0, 9), r.randint(0, 9)) for _ in range(60)]
    c = d = tx = ty = 0
    for i in range(60):
        for j in range(i):
            a, b = pts[i][0] - pts[j][0], pts[i][1] - pts[j][1]
            c, d, tx, ty = c + (a * b > 0), d + (a * b < 0), tx + (a == 0), ty + (b == 0)
    n = 60 * 59 // 2
    df = spark.createDataFrame([("k", float(a), float(b)) for a, b in pts], "k string, a double, b double")
    assert dg.kendall(df, ["k"], "a", "b").first()["kendall"] == pytest.approx((c - d) / math.sqrt((n - tx) * (n - ty)))
