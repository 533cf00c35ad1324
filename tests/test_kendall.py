"""Exact rank correlation over many ranges, ties, heavy values and odd groups against all pairs."""

from __future__ import annotations

import numpy as np
import pytest

from cutline.operators import diagnostics as dg


def all_pairs(x, y):
    sx, sy = np.sign(x[:, None] - x[None, :]), np.sign(y[:, None] - y[None, :])
    upper = np.triu_indices(len(x), 1)
    sx, sy = sx[upper], sy[upper]
    bottom = float((sx != 0).sum()) * float((sy != 0).sum())
    return float((sx * sy).sum()) / bottom**0.5 if bottom else None


def test_inversions_with_weights():
    rng = np.random.default_rng(1)
    for _ in range(200):
        n = int(rng.integers(1, 40))
        x, y, w = rng.integers(0, 8, n), rng.integers(-5, 9, n).astype(float), rng.integers(1, 5, n)
        want = sum(int(w[i] * w[j]) for i in range(n) for j in range(n) if x[i] < x[j] and y[i] > y[j])
        assert dg._inversions(x, y, w) == want


def test_groups_against_all_pairs(spark):
    rng = np.random.default_rng(2)
    groups = {
        "smooth": (x := rng.normal(size=2500), x + rng.normal(size=2500)),
        "ties": (rng.integers(0, 12, 2500).astype(float), rng.integers(0, 7, 2500).astype(float)),
        "heavy": (np.where(rng.random(2500) < 0.6, 3.0, rng.normal(size=2500)), np.where(rng.random(2500) < 0.4, 0.0, rng.normal(size=2500))),
        "falling": (np.arange(1500.0), -np.arange(1500.0)),
        "constant": (np.ones(50), np.arange(50.0)),
        "one": (np.ones(1), np.ones(1)),
    }
    rows = [(k, float(a), float(b)) for k, (x, y) in groups.items() for a, b in zip(x, y)] + [("ties", None, 1.0), ("ties", 1.0, None), ("gone", None, 1.0)]
    rows += [(None, float(i), float(i * 7 % 5)) for i in range(30)]
    groups[None] = np.arange(30.0), np.arange(30) * 7 % 5.0
    df = spark.createDataFrame(rows, "k string, a double, b double")
    got = {r["k"]: r["kendall"] for r in dg.kendall(df, ["k"], "a", "b").collect()}
    assert set(got) == set(groups)
    for k, (x, y) in groups.items():
        want = all_pairs(np.asarray(x), np.asarray(y))
        assert got[k] == (None if want is None else pytest.approx(want, abs=1e-12)), k
    assert dg.kendall(df.where("k = 'smooth'"), [], "a", "b").first()["kendall"] == pytest.approx(got["smooth"])
    assert dg.kendall(df.limit(0), ["k"], "a", "b").count() == 0


def test_threshold_sample_is_exact_with_equal_hashes(spark):
    from pyspark.sql import functions as F

    rows = spark.range(500).select("id", (F.col("id") % 40).alias("k"), F.lit(1).alias("__h"))  # equal keys hash alike
    got = [r.k for r in dg.threshold_sample(rows, ["k"], 101).collect()]
    assert len(got) == 101 and len(set(got)) in (8, 9)
    assert sorted(got) == sorted(r.k for r in dg.threshold_sample(rows.repartition(7), ["k"], 101).collect())
    assert dg.threshold_sample(rows, ["k"], 600).count() == 500 and dg.threshold_sample(rows.limit(0), ["k"], 5).count() == 0
    assert {r.k for r in dg.threshold_sample(rows, ["k"], 40, seed=1).collect()} != {r.k for r in dg.threshold_sample(rows, ["k"], 40).collect()}
