"""The serving bundle: candidate universe, calibration and manifest, published and admitted as one.

A bundle is a folder with the tables ``universe`` and ``calibration`` and a one-row JSON table
``manifest``. It is written under a hidden name and appears by one rename, so a reader meets a
whole bundle or none; where a store copies instead of renaming, the digests in the manifest
refuse what is not whole. Only counts, digests and facts reach the driver, never rows.
"""

from __future__ import annotations

import json
import uuid

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession, functions as F, types as T

from cutline.operators import quality
from cutline.schemas import UNIVERSE_FORBIDDEN, check_features

# --- fixed values: what a manifest must state ----------------------------------------------
SCHEMA_VERSION = 1
FEATURE_MODE = "pre_counselling"
CALIBRATION_METHOD = "rolling_origin_oof_absolute_residual"
CALIBRATION_SPLIT = "rolling_origin_oof"
TARGET_COVERAGE = 0.9
MANIFEST_FIELDS = [
    "schema_version", "model_version", "feature_mode", "data_cutoff_year", "prediction_year",
    "snapshot_year", "dataset_sha256", "training_years", "seed", "features",
]
UNIVERSE_REQUIRED = ["year", "round", "institute", "institute_type", "program", "category", "gender", "quota"]
CALIBRATION_COLUMNS = ["institute_type_str", "round", "count", "abs_residual_quantile"]

TABLES = ("universe", "calibration")
# hex digits of a row's SHA-256 that are summed, 60 bits at a time
_SLICES = (1, 16, 31, 46)


class BundleRefused(ValueError):
    def __init__(self, path: str, reasons: list[str]):
        super().__init__(f"{path}: {'; '.join(reasons)}")
        self.reasons = reasons


def _cell(field: T.StructField) -> Column:
    c = F.col(f"`{field.name}`")
    nested = isinstance(field.dataType, (T.ArrayType, T.MapType, T.StructType))
    value = F.to_json(F.struct(c)) if nested else c.cast("string")
    return F.coalesce(F.concat(F.octet_length(value).cast("string"), F.lit(":"), value), F.lit("null"))


def with_row_sums(df: DataFrame) -> DataFrame:
    """(rows, s1..s4): a digest of the rows as a multiset that adds up, so partial sums combine map-side
    and neither order nor partitioning matters. Columns are taken in name order; cells carry
    their length, so no two different rows have one text. It finds mistakes, not forgeries."""
    fields = sorted(df.schema.fields, key=lambda f: f.name)
    hashed = df.select(F.sha2(F.concat(*[_cell(f) for f in fields]), 256).alias("h"))
    return hashed.agg(F.count(F.lit(1)).alias("rows"), *[
        F.coalesce(F.sum(F.conv(F.substring("h", at, 15), 16, 10).cast("decimal(20,0)")), F.lit(0)).cast("decimal(38,0)").alias(f"s{i}")
        for i, at in enumerate(_SLICES, 1)])


def table_digest(df: DataFrame) -> DataFrame:
    """(rows, digest) of a table; an empty table has 0 rows and a digest like any other."""
    sums = [F.col(f"s{i}").cast("string") for i in range(1, len(_SLICES) + 1)]
    return with_row_sums(df).select("rows", F.sha2(F.concat_ws(":", F.col("rows").cast("string"), *sums), 256).alias("digest"))


def _measured(df: DataFrame) -> dict:
    return table_digest(df).first().asDict()


def _path(spark: SparkSession, name: str):
    path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(name)
    return path, path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())


def write_manifest(spark: SparkSession, folder: str, manifest: dict) -> None:
    spark.createDataFrame([(json.dumps(manifest, sort_keys=True),)], "value string").coalesce(1).write.mode("overwrite").text(f"{folder}/manifest")


def write_tables(folder: str, **tables: DataFrame) -> None:
    for name, table in tables.items():
        table.write.mode("overwrite").parquet(f"{folder}/{name}")


def make_manifest(
    spark: SparkSession, folder: str, *, dataset: dict, training_years: list[int], calibration_years: list[int],
    data_cutoff_year: int, prediction_year: int, features: list[str], seed: int,
) -> dict:
    """The manifest of tables that already lie in ``folder``: what was written is measured, not what was meant."""
    if prediction_year <= data_cutoff_year:
        raise ValueError("the prediction year must follow the data cutoff")
    check_features(features, FEATURE_MODE)
    tables = {name: _measured(spark.read.parquet(f"{folder}/{name}")) for name in TABLES}
    shared = {"prediction_year": prediction_year, "dataset_sha256": dataset["digest"], "seed": seed, "training_years": sorted(training_years)}
    return {
        **shared, "schema_version": SCHEMA_VERSION, "feature_mode": FEATURE_MODE, "data_cutoff_year": data_cutoff_year,
        "snapshot_year": data_cutoff_year, "features": list(features), "dataset_rows": dataset["rows"], "tables": tables,
        "model_version": f"last-observation-cutoff{data_cutoff_year}-seed{seed}-{tables['universe']['digest'][:12]}",
        "calibration": {
            **shared, "schema_version": SCHEMA_VERSION, "method": CALIBRATION_METHOD, "source_split": CALIBRATION_SPLIT,
            "target_coverage": TARGET_COVERAGE, "calibration_years": sorted(calibration_years)},
    }


def publish(universe: DataFrame, calibration: DataFrame, observed: DataFrame, folder: str, **facts) -> str:
    """Write, measure, then rename into place; returns the path of the bundle.

    ``facts`` are those of ``make_manifest``. A bundle of the same version is the same bundle and stays as it is.
    """
    spark = universe.sparkSession
    hidden = f"{folder}/.unpublished-{uuid.uuid4().hex}"
    write_tables(hidden, universe=universe, calibration=calibration)
    manifest = make_manifest(spark, hidden, dataset=_measured(observed), **facts)
    write_manifest(spark, hidden, manifest)
    target = f"{folder}/{manifest['model_version']}-{manifest['tables']['calibration']['digest'][:12]}-{manifest['dataset_sha256'][:12]}"
    source, files = _path(spark, hidden)
    if not files.exists(_path(spark, target)[0]) and not files.rename(source, _path(spark, target)[0]):
        raise OSError(f"could not publish {target}")
    if files.exists(source):
        files.delete(source, True)
    return target


def read_manifest(spark: SparkSession, path: str) -> dict | None:
    try:
        found = spark.read.text(f"{path}/manifest").first()
        manifest = json.loads(found[0]) if found else None
    except (AnalysisException, json.JSONDecodeError):
        return None
    return manifest if isinstance(manifest, dict) else None


def _whole(value) -> bool:
    return isinstance(value, int) and not isinstance(value, bool)


def _years(value) -> bool:
    return isinstance(value, list) and bool(value) and all(_whole(y) for y in value)


def manifest_faults(m: dict) -> list[str]:
    """Rules that the manifest alone can break, in a fixed order."""
    missing = sorted(set(MANIFEST_FIELDS + ["tables", "calibration"]) - set(m))
    if missing:
        return [f"manifest lacks {', '.join(missing)}"]
    k = m["calibration"]
    if not (_years(m["training_years"]) and all(_whole(m[y]) for y in ("data_cutoff_year", "prediction_year", "snapshot_year"))):
        return ["years are not whole numbers"]
    calibrated = isinstance(k, dict) and _years(k.get("calibration_years")) and _years(k.get("training_years"))
    digest = str(m["dataset_sha256"]).lower()
    rules = [
        ("unknown schema version", m["schema_version"] == SCHEMA_VERSION),
        ("wrong feature mode", m["feature_mode"] == FEATURE_MODE),
        ("training years beyond the cutoff", max(m["training_years"]) <= m["data_cutoff_year"]),
        ("prediction year not after the cutoff", m["prediction_year"] > m["data_cutoff_year"] >= m["snapshot_year"]),
        ("dataset digest malformed", len(digest) == 64 and set(digest) <= set("0123456789abcdef")),
        ("seed is not a whole number", _whole(m["seed"])),
        ("no model version", bool(str(m["model_version"]).strip())),
        ("no features", isinstance(m["features"], list) and bool(m["features"])),
        ("calibration years missing", calibrated),
    ]
    if calibrated:
        rules += [
            ("unknown calibration method", (k.get("schema_version"), k.get("method"), k.get("source_split")) == (
                SCHEMA_VERSION, CALIBRATION_METHOD, CALIBRATION_SPLIT)),
            ("calibration of another prediction year", k.get("prediction_year") == m["prediction_year"]),
            ("calibration years not past", max(k["calibration_years"]) < m["prediction_year"]),
            ("calibration trained on the prediction year", max(k["training_years"]) < m["prediction_year"]),
            ("calibration of another dataset", str(k.get("dataset_sha256")).lower() == digest),
            ("calibration of another seed", k.get("seed") == m["seed"]),
            ("wrong target coverage", k.get("target_coverage") == TARGET_COVERAGE),
        ]
    return [text for text, holds in rules if not holds]


def examine(spark: SparkSession, path: str) -> tuple[list[str], dict | None, dict[str, DataFrame]]:
    """(reasons to refuse, manifest, tables). Every rule is tried, so all faults of a bundle are named at once."""
    manifest = read_manifest(spark, path)
    if manifest is None:
        return ["no manifest"], None, {}
    reasons, tables = manifest_faults(manifest), {}
    for name in TABLES:
        try:
            tables[name] = spark.read.parquet(f"{path}/{name}")
        except AnalysisException:
            reasons.append(f"no {name}")
            continue
        stated = manifest.get("tables")
        if not isinstance(stated, dict) or stated.get(name) != _measured(tables[name]):
            reasons.append(f"{name} is not the one of the manifest")
    for name, needed in (("universe", UNIVERSE_REQUIRED), ("calibration", CALIBRATION_COLUMNS)):
        absent = sorted(set(needed) - set(tables[name].columns)) if name in tables else []
        if absent:
            reasons.append(f"{name} lacks {', '.join(absent)}")
    known = sorted(set(UNIVERSE_FORBIDDEN) & set(tables["universe"].columns)) if "universe" in tables else []
    if known:
        reasons.append(f"universe carries {', '.join(known)}")
    if len(tables) == len(TABLES) and not reasons:
        years = spark.createDataFrame([(y,) for y in manifest["calibration"]["calibration_years"]], "year bigint")
        checks = quality.universe_contract(tables["universe"], tables["calibration"], years, manifest["prediction_year"])
        reasons += [r["check"] for r in checks.where(F.col("violations") > 0).collect()]
    return reasons, manifest, tables


def load(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame, dict]:
    """(universe, calibration, manifest) of an admissible bundle; any other raises ``BundleRefused``."""
    reasons, manifest, tables = examine(spark, path)
    if reasons:
        raise BundleRefused(path, reasons)
    return tables["universe"], tables["calibration"], manifest
