"""Profiles are spread over tasks before they become pairs, and pairs stay with their profile."""

from cutline.operators import percentile_model as pm, profiles, recommend

PROFILE = """profile_id bigint, category string, gender string, round bigint, is_pwd boolean, home_state string, main_rank bigint,
 advanced_rank bigint, pref_inst_types array<string>, pref_branch_keywords array<string>, pref_quotas array<string>, sort_mode string, top_n int"""


def _profiles(spark, n):
    rows = [(i if i % 50 else None, "OPEN", "Gender-Neutral", 1, False, None, 100 + i, None, None, None, None, None, 10) for i in range(n)]
    return spark.createDataFrame(rows, PROFILE).coalesce(1)


def _universe(spark):
    rows = [("OPEN", "Gender-Neutral", 1, False, "AI", "NIT", f"Institute {i}", "Chemistry", f"c{i}", 100 + 10 * i) for i in range(20)]
    return spark.createDataFrame(rows, """category string, gender string, round bigint, is_pwd boolean, quota string, institute_type string,
     institute string, program string, choice_id string, predicted_closing_rank bigint""")


def _shuffles(df):
    """Why each hash shuffle of a plan is there."""
    lines = df._jdf.queryExecution().executedPlan().toString().splitlines()
    return [reason for line in lines if "hashpartitioning" in line for reason in ("REPARTITION_BY_NUM", "ENSURE_REQUIREMENTS") if reason in line]


def test_pairs_of_a_small_file_are_made_by_many_tasks(spark):
    pairs = profiles.match_candidates(_profiles(spark, 1000), _universe(spark))
    assert pairs.rdd.getNumPartitions() >= spark.sparkContext.defaultParallelism > 1
    assert pairs.count() == 20_000 and pairs.where("profile_id IS NULL").count() == 400


def test_tasks_grow_with_the_profiles(spark, monkeypatch):
    monkeypatch.setattr(profiles, "PROFILES_A_TASK", 10)
    assert profiles.spread(_profiles(spark, 1000)).rdd.getNumPartitions() == 100


def test_windows_by_profile_do_not_move_pairs(spark):
    pairs = recommend.order_candidates(recommend.score_candidates(profiles.route_ranks(
        profiles.match_candidates(_profiles(spark, 100), _universe(spark))).selectExpr("*", "10e0 AS std_dev", "16e0 AS uncertainty_radius")))
    assert _shuffles(pairs) == ["REPARTITION_BY_NUM"]


def test_assets_of_a_small_file_are_matched_by_many_tasks(spark):
    users = spark.createDataFrame([(i, "OPEN", "AI", False, False, "X") for i in range(500)],
                                  "profile_id bigint, category string, quota_pool string, is_female boolean, has_pwd boolean, home_state string").coalesce(1)
    assets = spark.createDataFrame([("OPEN", "AI", "Gender-Neutral", False, "X", i) for i in range(7)],
                                   "category string, quota_pool string, gender string, is_pwd boolean, institute_state string, asset int")
    pairs = pm.eligible_assets(users, assets)
    assert pairs.rdd.getNumPartitions() >= spark.sparkContext.defaultParallelism > 1 and pairs.count() == 3500


def _ordered(spark):
    """Long slices of three profiles; one class of each kind is only found far down, one list wants no balance."""
    rows = []
    for who, mode in ((1, "best_fit"), (2, "safest_backup"), (None, "best_fit")):
        for at in range(1, 301):
            bucket = "ambitious_reach" if at == 290 else "best_realistic" if at > 200 else "safe_backup"
            rows.append((who, mode, 10, f"c{at}", at, bucket, "JEE_ADVANCED" if at == 280 else "JEE_MAIN"))
    return spark.createDataFrame(rows, "profile_id bigint, sort_mode string, top_n int, choice_id string, sort_position int, recommendation_bucket string, rank_type_used string")


def test_a_slice_is_sorted_once_for_quotas_and_swaps(spark):
    sorts = lambda df: df._jdf.queryExecution().executedPlan().toString().count("Sort [")
    assert sorts(recommend.quota_and_backfill(_ordered(spark))) == 1
    assert sorts(recommend.balanced_selection(_ordered(spark))) == 1


def test_rows_far_down_a_slice_still_come_in(spark):
    got = {}
    for r in recommend.balanced_selection(_ordered(spark)).collect():
        got.setdefault(r["profile_id"], []).append(r["sort_position"])
    # heads 1-3 safe, 201-205 realistic, 290 reach, fill 4; the one JEE_ADVANCED row takes the place of the last pick
    assert sorted(got[1]) == sorted(got[None]) == [1, 2, 3, 201, 202, 203, 204, 205, 280, 290]
    assert sorted(got[2]) == list(range(1, 11))
