import copy
import os

import pytest
from pyspark.sql import functions as F

from cutline.sources import bundle

FACTS = dict(training_years=[2019, 2020], calibration_years=[2020], data_cutoff_year=2020, prediction_year=2021,
             features=["last_closing_rank"], seed=1)


def digest(df):
    return tuple(bundle.table_digest(df).first())


def test_digest_sees_rows_as_a_multiset(spark):
    df = spark.createDataFrame([("a", 1, [1, 2]), ("b", None, None), (None, 2, []), ("a", 1, [1, 2])], "x string, y int, z array<int>")
    assert digest(df) == digest(df.repartition(3).orderBy(F.desc("x")).select("z", "x", "y"))
    assert digest(df) != digest(df.distinct()) and digest(df) != digest(df.fillna({"y": 0}))
    assert digest(df.limit(0))[0] == 0
    # cells do not run into each other, NULL is no text
    pair = lambda *rows: digest(spark.createDataFrame(rows, "a string, b string"))
    assert pair(("1:x", "y")) != pair(("1", ":xy")) and pair((None, "")) != pair(("null", ""))
    assert pair(("p", "q"), ("r", "s")) != pair(("p", "s"), ("r", "q"))


@pytest.fixture(scope="module")
def parts(spark):
    universe = spark.createDataFrame(
        [(2021, r, "I", "IIT", "P", "OPEN", "Gender-Neutral", "AI", 10 * r) for r in (1, 2)],
        "year bigint, round bigint, institute string, institute_type string, program string, category string, gender string, quota string, last_closing_rank bigint")
    calibration = spark.createDataFrame(
        [("__default__", -1, 5, 3.0), ("IIT", 1, 5, 2.0)], "institute_type_str string, round bigint, count bigint, abs_residual_quantile double")
    return universe, calibration, spark.range(9)


def test_publish_load_and_refuse(spark, parts, tmp_path):
    universe, calibration, observed = parts
    path = bundle.publish(universe, calibration, observed, str(tmp_path), **FACTS)
    assert bundle.publish(universe.repartition(2), calibration, observed, str(tmp_path), **FACTS) == path
    assert sorted(n for n in os.listdir(tmp_path) if n.startswith(".unpublished")) == []
    u, k, manifest = bundle.load(spark, path)
    assert u.count() == 2 and k.count() == 2 and manifest["dataset_rows"] == 9
    other = bundle.publish(universe.withColumn("last_closing_rank", F.lit(1)), calibration, observed, str(tmp_path), **FACTS)
    assert other != path
    with pytest.raises(bundle.BundleRefused, match="no manifest"):
        bundle.load(spark, str(tmp_path / "nowhere"))
    bundle.write_tables(other, universe=u)
    with pytest.raises(bundle.BundleRefused, match="universe is not the one of the manifest"):
        bundle.load(spark, other)


def test_publish_refuses_wrong_facts(parts, tmp_path):
    for wrong in ({"prediction_year": 2020}, {"features": ["opening_rank"]}):
        with pytest.raises(ValueError):
            bundle.publish(*parts, str(tmp_path), **{**FACTS, **wrong})


def test_empty_universe_is_refused(spark, parts, tmp_path):
    path = bundle.publish(parts[0].limit(0), parts[1], parts[2], str(tmp_path), **FACTS)
    assert bundle.examine(spark, path)[0] == ["empty_universe"]


@pytest.mark.parametrize("change,reason", [
    ({"schema_version": 2}, "unknown schema version"), ({"feature_mode": "in_round_update"}, "wrong feature mode"),
    ({"training_years": [2019, 2021]}, "training years beyond the cutoff"), ({"snapshot_year": 2021}, "prediction year not after the cutoff"),
    ({"dataset_sha256": "xyz"}, "dataset digest malformed"), ({"seed": True}, "seed is not a whole number"), ({"features": []}, "no features"),
    ({"model_version": " "}, "no model version"), ({"training_years": []}, "years are not whole numbers"), ({"prediction_year": "2021"}, "years are not whole numbers"),
    ({"calibration": {"calibration_years": []}}, "calibration years missing"), ({"calibration": {"source_split": "test"}}, "unknown calibration method"),
    ({"calibration": {"prediction_year": 2022}}, "calibration of another prediction year"), ({"calibration": {"calibration_years": [2021]}}, "calibration years not past"),
    ({"calibration": {"training_years": [2021]}}, "calibration trained on the prediction year"), ({"calibration": {"seed": 2}}, "calibration of another seed"),
    ({"calibration": {"dataset_sha256": "0" * 64}}, "calibration of another dataset"), ({"calibration": {"target_coverage": 0.8}}, "wrong target coverage"),
])
def test_manifest_rules(manifest, change, reason):
    m = copy.deepcopy(manifest)
    for key, value in change.items():
        if isinstance(value, dict):
            m[key].update(value)
        else:
            m[key] = value
    assert reason in bundle.manifest_faults(m)
    del m["seed"]
    assert bundle.manifest_faults(m) == ["manifest lacks seed"]


@pytest.fixture(scope="module")
def manifest(spark, parts, tmp_path_factory):
    path = bundle.publish(*parts, str(tmp_path_factory.mktemp("bundle")), **FACTS)
    m = bundle.read_manifest(spark, path)
    assert bundle.manifest_faults(m) == []
    return m
