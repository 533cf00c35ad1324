"""Applicant profiles: request validation, candidate matching and rank routing for whole tables."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from cutline.functions import text
from cutline.functions.keys import broadcast_if_small
from cutline.schemas import CATEGORIES, GENDERS, INSTITUTE_TYPES, QUOTAS, SORT_MODES

# --- fixed values: accepted request domain ------------------------------------------------
MAIN_RANK_MAX = 1_200_000
ADVANCED_RANK_MAX = 50_000
ROUND_MAX = 6
TOP_N_MAX = 200
KEYWORDS_MAX, KEYWORD_LENGTH_MAX = 20, 100
STATE_LENGTH_MAX = 100
LIST_LENGTH_MAX = 4

UNIVERSE_BROADCAST_ROWS = 500_000
SALTS = 32
PROFILES_A_TASK = 2_000


def rejection_reasons() -> Column:
    """Array of the rules a request breaks; empty when it is valid."""
    bad = lambda cond, name: F.when(F.coalesce(cond, F.lit(False)), F.lit(name))
    unknown = lambda c, domain: F.exists(c, lambda x: ~x.isin(domain))
    main, adv = F.col("main_rank"), F.col("advanced_rank")
    words = F.col("pref_branch_keywords")
    return F.array_compact(F.array(
        bad(main.isNull() | ~main.between(1, MAIN_RANK_MAX), "main_rank"),
        bad(~adv.between(1, ADVANCED_RANK_MAX), "advanced_rank"),
        bad(F.col("category").isNull() | ~F.col("category").isin(CATEGORIES), "category"),
        bad(F.col("gender").isNull() | ~F.col("gender").isin(GENDERS), "gender"),
        bad(unknown(F.col("pref_inst_types"), INSTITUTE_TYPES)
            | (F.size("pref_inst_types") > LIST_LENGTH_MAX), "pref_inst_types"),
        bad(unknown(F.col("pref_quotas"), QUOTAS) | (F.size("pref_quotas") > LIST_LENGTH_MAX), "pref_quotas"),
        bad(F.col("round").isNull() | ~F.col("round").between(1, ROUND_MAX), "round"),
        bad(F.col("top_n").isNull() | ~F.col("top_n").between(1, TOP_N_MAX), "top_n"),
        bad(F.col("sort_mode").isNull() | ~F.col("sort_mode").isin(SORT_MODES), "sort_mode"),
        bad((F.size(words) > KEYWORDS_MAX) | F.exists(
            words, lambda w: ~F.length(F.trim(w)).between(1, KEYWORD_LENGTH_MAX)), "pref_branch_keywords"),
        bad(~F.length(F.trim("home_state")).between(1, STATE_LENGTH_MAX), "home_state"),
    ))


def validate_profiles(requests: DataFrame) -> DataFrame:
    reasons = requests.withColumn("reasons", rejection_reasons())
    return reasons.withColumn("is_valid", F.size("reasons") == 0)


def eligible(universe_columns: list[str]) -> Column:
    """Row predicate of a (profile, universe row) pair beyond the equi-keys."""
    quota = F.upper(F.col("quota"))
    if "institute_state" in universe_columns:
        at_home = F.coalesce(
            F.lower(F.trim("institute_state")) == F.lower(F.trim("home_state")), F.lit(False)
        )
    else:
        at_home = F.lit(False)
    wants = lambda pref, test: F.col(pref).isNull() | (F.size(pref) == 0) | test
    return (
        ((quota != "HS") | at_home)
        & wants("pref_quotas", F.array_contains("pref_quotas", quota))
        & (F.col("advanced_rank").isNotNull() | (F.col("institute_type") != "IIT"))
        & wants("pref_inst_types", F.array_contains("pref_inst_types", F.col("institute_type")))
        & wants("pref_branch_keywords", F.exists(
            "pref_branch_keywords", lambda k: text.contains_ignoring_case(F.col("program"), F.trim(k))))
    )


def spread(rows: DataFrame) -> DataFrame:
    """``rows`` spread over tasks by profile, a bounded number of them to each.

    A profile becomes hundreds of pairs with a broadcast table, in the task that reads it, and a small
    file is read by one task. Pairs also stay with their profile, so no window or grouping by
    ``profile_id`` moves them again. The number of tasks is explicit: adaptive execution would size them by the narrow rows.
    """
    parallel = rows.sparkSession.sparkContext.defaultParallelism
    return rows.repartition(max(parallel, -(-rows.count() // PROFILES_A_TASK)), "profile_id")


def match_candidates(profiles: DataFrame, universe: DataFrame, checked_small: bool | None = None) -> DataFrame:
    """(profile, candidate) pairs: category, gender, round and PwD pool equal, then ``eligible``.

    The equi-keys have few values, so a shuffle join would pile a large share of both sides on
    a few tasks. A counted, small universe is broadcast to profiles that are spread over tasks. A larger
    one is spread itself: each profile takes one of SALTS slices of tasks, the universe is copied to
    each slice, so the heaviest key is divided by SALTS.
    """
    if "is_pwd" not in universe.columns:
        # a universe without the pool column cannot prove PwD seats: such profiles match nothing
        universe = universe.withColumn("is_pwd", F.lit(False))
    equi = ["category", "gender", "round", "is_pwd"]
    if checked_small is None:
        universe, small = broadcast_if_small(universe, UNIVERSE_BROADCAST_ROWS)
    else:
        small = checked_small
        universe = F.broadcast(universe) if small else universe
    if small:
        pairs = spread(profiles).join(universe, equi)
    else:
        salted = profiles.withColumn("__salt", F.pmod(F.xxhash64("profile_id"), F.lit(SALTS)).cast("int"))
        copies = universe.withColumn("__salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
        pairs = salted.join(copies, [*equi, "__salt"]).drop("__salt")
    return pairs.where(eligible(universe.columns))


def route_ranks(pairs: DataFrame) -> DataFrame:
    """Rank and exam per row; IIT rows without an advanced rank drop out."""
    is_iit = F.upper("institute_type") == "IIT"
    return pairs.where(~is_iit | F.col("advanced_rank").isNotNull()).withColumns({
        "rank_used": F.when(is_iit, F.col("advanced_rank")).otherwise(F.col("main_rank")),
        "rank_type_used": F.when(is_iit, "JEE_ADVANCED").otherwise("JEE_MAIN"),
    })


def unroutable(pairs: DataFrame) -> DataFrame:
    """Rows that need a main rank the profile does not have."""
    return pairs.where((F.upper("institute_type") != "IIT") & F.col("main_rank").isNull())


def candidate_counts(profiles: DataFrame, pairs: DataFrame, scored: DataFrame) -> DataFrame:
    """Rows per profile after filters, routing and the reach filter, zero-filled."""
    a = pairs.groupBy("profile_id").agg(F.count(F.lit(1)).alias("after_profile_filters"))
    b = scored.groupBy("profile_id").agg(
        F.count(F.lit(1)).alias("scored"),
        F.count_if(F.col("recommendation_bucket") != "unlikely_reach").alias("eligible_after_reach_filter"),
    )
    out = profiles.select("profile_id").join(a, "profile_id", "left").join(b, "profile_id", "left")
    return out.na.fill(0)
