from pyspark.sql import functions as F

from cutline.operators.positions import numbered, permuted


def test_positions_are_dense_and_in_order(spark):
    df = spark.range(5000).select((F.col("id") * 7919 % 5003).alias("k"), F.lit("x").alias("range"))
    got = sorted((r["position"], r["k"]) for r in numbered(df, ["k"]).collect())
    assert [p for p, _ in got] == list(range(5000))
    assert [k for _, k in got] == sorted(k for _, k in got)
    assert numbered(df.limit(0), ["k"]).count() == 0


def test_every_value_is_given_once_per_repeat(spark):
    # repeated ids, NULLs and a value that most rows share
    df = spark.range(3000).select(F.floor(F.col("id") / 2).alias("i"), F.when(F.col("id") % 3 > 0, F.lit(5)).otherwise(F.col("id")).alias("v"),
                                  F.when(F.col("id") % 4 == 0, F.lit("w")).alias("n"))
    rows = permuted(df, ["v", "n"], ["i"], 2).collect()
    want = sorted((r["v"], r["n"] or "") for r in df.collect())
    for rep in (1, 2):
        one = [r for r in rows if r["__rep"] == rep]
        assert sorted((r["v"], r["n"] or "") for r in one) == want
        assert sorted((r["__d_v"], r["__d_n"] or "") for r in one) == want
        assert sum(r["__donor"] == r["__key"] for r in one) < 30
    draws = lambda rep: [r["__donor"] for r in sorted(rows, key=lambda r: (r["__key"], r["v"])) if r["__rep"] == rep]
    assert draws(1) != draws(2)
