"""Recency-weighted percentile model per quota asset, proxies for new assets, eligibility routing."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from cutline.functions import scoring
from cutline.functions.keys import broadcast_if_small, null_safe_join
from cutline.operators.profiles import SALTS, UNIVERSE_BROADCAST_ROWS, spread

# --- fixed values -------------------------------------------------------------------------
DECAY = 0.6
PROXY_STD_SCALE = 1.15
PROXY_OFFSET = 0.15
UPGRADE_SHARE = 0.33

# the seat-pool flags belong to the key: pools of different eligibility must not share a history
ASSET_KEY = ["institute", "program", "quota_pool", "category", "gender", "is_pwd"]


def latest_round_history(cutoffs: DataFrame) -> DataFrame:
    """Last round of every (asset, year); ``max_by`` combines map-side."""
    pool = F.when(F.col("quota").isin("HS", "HomeState"), "HS").otherwise("AI")
    keyed = cutoffs.withColumn("quota_pool", pool)
    last = F.max_by(F.struct("round", "closing_rank", "institute_type", "institute_state"),
                    F.struct("round", -F.col("closing_rank")))
    return keyed.groupBy(*ASSET_KEY, "year").agg(last.alias("__l")).select(*ASSET_KEY, "year", "__l.*")


def assets(history: DataFrame) -> DataFrame:
    """One row per asset with its yearly series (one entry per season) in year order."""
    return history.groupBy(*ASSET_KEY).agg(
        F.max("institute_type").alias("institute_type"), F.max("institute_state").alias("institute_state"),
        F.array_sort(F.collect_list(F.struct("year", "closing_rank"))).alias("yearly_cutoffs"),
    )


def fit_percentiles(history: DataFrame, cohorts: DataFrame, known_years: Column | None = None) -> DataFrame:
    """Mean and reliability-weighted deviation of yearly percentiles, newest season heaviest.

    The series of an asset has one entry per season, so it is folded inside its row: one
    shuffle, and the second pass around the mean costs nothing. ``status`` tells which assets
    cannot be used: a season without cohort size, or no spread over two or more seasons.
    """
    sized = history.join(F.broadcast(cohorts.select("year", "total_candidates")), "year", "left")
    pct = scoring.percentile_of(F.col("closing_rank"), F.col("total_candidates"))
    grouped = sized.groupBy(*ASSET_KEY).agg(
        F.array_sort(F.collect_list(F.struct(
            F.col("year").alias("y"), F.when(F.col("total_candidates").isNotNull(), pct).alias("x")))).alias("s"),
        F.max("year").alias("newest"), F.count(F.lit(1)).alias("n"),
        F.count_if(F.col("total_candidates").isNull()).alias("n_unsized"),
    )
    weight = lambda e: F.pow(F.lit(DECAY), F.col("newest") - e["y"])
    fold = lambda f: F.aggregate("s", F.lit(0.0), lambda acc, e: acc + f(e))
    first = grouped.withColumns({
        "v1": fold(weight), "v2": fold(lambda e: weight(e) * weight(e)),
        "wx": fold(lambda e: weight(e) * e["x"]),
    }).withColumn("mean", F.col("wx") / F.col("v1"))
    spread = fold(lambda e: weight(e) * (e["x"] - F.col("mean")) * (e["x"] - F.col("mean")))
    room = F.col("v1") * F.col("v1") - F.col("v2")
    variance = F.when(room > 0, F.col("v1") / room * spread).otherwise(0.0)
    fitted = first.withColumn("std_dev", F.when(F.col("n") < 2, 0.0).otherwise(F.sqrt(variance)))
    status = (
        F.when(F.col("n_unsized") > 0, "missing_cohort")
        .when((F.col("n") >= 2) & (F.col("std_dev") <= 0), "invalid_std").otherwise("ok")
    )
    return fitted.select(*ASSET_KEY, "n", "mean", "std_dev", status.alias("status"))


def fit_plain(history: DataFrame, value: str = "closing_rank") -> DataFrame:
    """Unweighted mean and sample deviation per asset; one season gives deviation 0."""
    return history.groupBy(*ASSET_KEY).agg(
        F.count(value).alias("n"), F.avg(value).alias("mean"),
        F.coalesce(F.stddev_samp(value), F.lit(0.0)).alias("std_dev"),
    )


def competitive_proxy_terms(weight_toward_upper: float) -> tuple[float, float]:
    w = min(1.0, max(0.0, weight_toward_upper))
    return (1.0 - w) * PROXY_OFFSET, PROXY_STD_SCALE


def resolve_distributions(all_assets: DataFrame, fits: DataFrame, proxies: DataFrame) -> DataFrame:
    """Own fit where there is history; else the proxy's fit shifted and widened; else a status.

    ``proxies``: asset key, ``proxy_<key>`` columns, mean_offset, std_scale.
    """
    own = fits.select(*ASSET_KEY, F.col("mean").alias("__m"), F.col("std_dev").alias("__s"), F.col("status").alias("__st"))
    base = null_safe_join(all_assets, own, ASSET_KEY, "left")
    base = null_safe_join(base, proxies, ASSET_KEY, "left")
    # the proxy side lists every known asset, with its fit when it has history
    target = null_safe_join(all_assets.select(*ASSET_KEY), own, ASSET_KEY, "left").select(
        *[F.col(k).alias(f"proxy_{k}") for k in ASSET_KEY],
        F.col("__m").alias("__pm"), F.col("__s").alias("__ps"), F.col("__st").alias("__pst"),
        F.lit(True).alias("__known"),
    )
    joined = null_safe_join(base, target, [f"proxy_{k}" for k in ASSET_KEY], "left")
    has_own, has_proxy = F.col("__st").isNotNull(), F.col("mean_offset").isNotNull()
    status = (
        F.when(has_own, F.col("__st")).when(~has_proxy, "no_history_or_proxy")
        .when(F.col("__known").isNull(), "proxy_not_found")
        .when(F.col("__pst").isNull(), "proxy_has_no_history").otherwise(F.col("__pst"))
    )
    return joined.select(
        *all_assets.columns,
        F.when(has_own, F.col("__m")).otherwise(F.col("__pm") + F.col("mean_offset")).alias("mean"),
        F.when(has_own, F.col("__s")).otherwise(F.col("__ps") * F.col("std_scale")).alias("std_dev"),
        (~has_own & has_proxy).alias("uses_cold_start_proxy"), status.alias("status"),
    )


def seat_shift(fits: DataFrame, shift: float | Column) -> DataFrame:
    return fits.withColumn("mean", F.col("mean") + shift)


def eligible_assets(users: DataFrame, asset_rows: DataFrame) -> DataFrame:
    """(user, asset) pairs the user may claim.

    Users carry category, quota_pool, home_state and flags is_female / has_pwd; a flag an
    asset requires must be present, home-state assets need the same state. Few distinct
    equi-keys: see ``match_candidates`` for why the asset side is broadcast or salted.
    """
    equi = ["category", "quota_pool"]
    assets_, small = broadcast_if_small(asset_rows, UNIVERSE_BROADCAST_ROWS)
    if small:
        pairs = spread(users).join(assets_, equi)
    else:
        salted = users.withColumn("__salt", F.pmod(F.xxhash64("profile_id"), F.lit(SALTS)).cast("int"))
        copies = asset_rows.withColumn("__salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
        pairs = salted.join(copies, [*equi, "__salt"]).drop("__salt")
    needs_female = F.lower("gender").contains("female")
    return pairs.where(
        (~needs_female | F.col("is_female")) & (~F.col("is_pwd") | F.col("has_pwd"))
        & ((F.col("quota_pool") != "HS")
           | F.coalesce(F.col("institute_state") == F.col("home_state"), F.lit(False)))
    )


def predict_pairs(pairs: DataFrame, target_total: int) -> DataFrame:
    total = F.lit(target_total)
    user = scoring.percentile_of(F.col("rank_used"), total)
    return pairs.where(F.col("status") == "ok").withColumns({
        "user_percentile": user,
        "probability_percent": F.round(
            scoring.percentile_exceedance(F.col("mean"), F.col("std_dev"), user), 1),
        "projected_closing_rank": scoring.rank_of(F.col("mean"), total),
    })


def first_run_wins(results: DataFrame) -> DataFrame:
    """One row per (profile, institute, programme, quota, gender tag): the earliest run."""
    key = ["profile_id", "institute", "program", "quota_pool", "gender_tag"]
    rest = [c for c in results.columns if c not in key]
    best = results.groupBy(*key).agg(
        F.min_by(F.struct(*rest), F.struct("run", "gender", "is_pwd")).alias("__b"))
    return best.select(*key, "__b.*")


def simulation_summary(results: DataFrame) -> DataFrame:
    """Per profile: option count, most likely institute, and the one a third down the list."""
    w = Window.partitionBy("profile_id").orderBy(
        F.col("probability_percent").desc(), "institute", "program", "quota_pool", "gender_tag")
    placed = results.withColumns({
        "__r": F.row_number().over(w) - 1, "__n": F.count(F.lit(1)).over(Window.partitionBy("profile_id")),
    })
    up = F.col("__r") == F.floor(F.col("__n") * F.lit(UPGRADE_SHARE))
    return placed.groupBy("profile_id").agg(
        F.count(F.lit(1)).alias("total_options"),
        F.max(F.when(F.col("__r") == 0, F.col("institute"))).alias("safest_choice"),
        F.max(F.when(up, F.col("institute"))).alias("top_upgrade"),
    )
