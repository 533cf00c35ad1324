"""Rounding by plain arithmetic gives what ``round`` and ``bround`` give."""

import random

from pyspark.sql import functions as F

from cutline.functions import scoring
from cutline.plans.registry import rounded


def _values(spark):
    rng = random.Random(3)
    xs = [rng.choice((1, -1)) * rng.random() * 10 ** rng.randint(-9, 9) for _ in range(4000)]
    xs += [s * (k + 0.5) / 10 ** e for k in range(300) for e in (0, 1, 4, 6) for s in (1, -1)]  # ties, and doubles next to them
    xs += [0.0, -0.0, -1e-9, 5e-324, 999_999.9999995, 1e12, 1e300, float("nan"), float("inf"), float("-inf"), None]
    return spark.createDataFrame([(x,) for x in xs], "x double")


def test_same_doubles_as_the_functions(spark):
    values = _values(spark)
    for digits in (0, 1, 4, 6):
        for even, function in ((False, F.round), (True, F.bround)):
            both = values.select("x", function("x", digits).alias("a"), scoring.decimals(F.col("x"), digits, even).alias("b"))
            # as text, so that a negative zero counts
            assert both.where("NOT (string(a) <=> string(b))").collect() == []


def test_scores_are_rounded_without_decimal_text(spark):
    """The function stays for ties only: it stands in the last branch, behind the arithmetic."""
    values = _values(spark)
    for df in (rounded(values), values.select(scoring.recommendation_score(F.col("x"), F.col("x"), F.col("x")))):
        plan = df._jdf.queryExecution().optimizedPlan().toString().lower()
        assert "floor(" in plan and plan.index("floor(") < plan.index("else " + ("bround(" if "bround(" in plan else "round("))


def test_other_types_stay(spark):
    row = rounded(spark.sql("SELECT 1.23456789e0 AS d, float(1.2345678) AS f, 7L AS n, 'a' AS s")).first()
    assert row["d"] == 1.234568 and row["n"] == 7 and row["s"] == "a"
    assert rounded(spark.sql("SELECT 1e0 AS d, float(1) AS f")).dtypes == [("d", "double"), ("f", "float")]
