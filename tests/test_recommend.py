import random

import pytest
from pyspark.sql import functions as F

from cutline.functions import scoring, text
from cutline.operators import percentile_model as pm, profiles, recommend
from cutline.operators.allotment import capacity_cut

PROFILE = ("profile_id bigint, main_rank bigint, advanced_rank bigint, category string, gender string, home_state string, is_pwd boolean, "
           "pref_inst_types array<string>, pref_branch_keywords array<string>, pref_quotas array<string>, round bigint, top_n int, sort_mode string")


def universe(spark, **extra):
    rows = [(f"{t} one", t, "Computer Science", "OPEN", "Gender-Neutral", q, 5, s) for t, q, s in (
        ("IIT", "AI", "X"), ("NIT", "HS", "Goa"), ("IIIT", "AI", "X"), ("GFTI", "OS", "X"))]
    return spark.createDataFrame(rows, "institute string, institute_type string, program string, category string, gender string, quota string, round bigint, institute_state string")


def profile(spark, **changes):
    base = dict(profile_id=1, main_rank=5000, advanced_rank=900, category="OPEN", gender="Gender-Neutral", home_state=" goa", is_pwd=False,
                pref_inst_types=None, pref_branch_keywords=None, pref_quotas=None, round=5, top_n=100, sort_mode="best_fit")
    base.update(changes)
    return spark.createDataFrame([tuple(base.values())], PROFILE)


@pytest.mark.parametrize("changes,kinds", [
    ({}, {"IIT", "NIT", "IIIT", "GFTI"}), ({"advanced_rank": None}, {"NIT", "IIIT", "GFTI"}), ({"home_state": None}, {"IIT", "IIIT", "GFTI"}),
    ({"home_state": "Kerala"}, {"IIT", "IIIT", "GFTI"}), ({"pref_branch_keywords": ["["]}, set()), ({"is_pwd": True}, set()),
    ({"round": 4}, set()), ({"pref_quotas": ["OS"]}, {"GFTI"}), ({"pref_inst_types": ["NIT", "IIT"]}, {"IIT", "NIT"}),
    ({"pref_branch_keywords": ["zzz", "COMPUTER"]}, {"IIT", "NIT", "IIIT", "GFTI"}),
])
@pytest.mark.parametrize("small", [True, False])
def test_profile_filter(spark, changes, kinds, small):
    got = profiles.match_candidates(profile(spark, **changes), universe(spark), checked_small=small)
    assert {r["institute_type"] for r in got.collect()} == kinds


def test_rank_routing(spark):
    rows = profiles.route_ranks(profiles.match_candidates(profile(spark), universe(spark))).collect()
    assert {(r["institute_type"], r["rank_used"], r["rank_type_used"]) for r in rows} == {
        ("IIT", 900, "JEE_ADVANCED"), ("NIT", 5000, "JEE_MAIN"), ("IIIT", 5000, "JEE_MAIN"), ("GFTI", 5000, "JEE_MAIN")}


def test_likelihood_is_an_exact_count(spark):
    r = random.Random(1)
    draws = scoring.standard_draws()
    rows = [(r.randint(1, 50000), float(r.choice([0.5, 10.0, 150.0, 4000.0])), r.randint(1, 60000)) for _ in range(300)]
    rows += [(100, 25.0, 1), (100, 25.0, 100), (1, 1e-9, 2), (10, 1e6, 9)]
    # break-even points that fall exactly on a draw
    rows += [(1000, 64.0, round(1000 + z * 64.0)) for z in draws[::50]]
    df = spark.createDataFrame(rows, "c bigint, s double, r bigint")
    got = df.select("c", "s", "r", scoring.exceedance(F.col("c"), F.col("s"), F.col("r")).alias("p")).collect()
    for x in got:
        want = sum(x["r"] <= max(1.0, x["c"] + z * x["s"]) for z in draws) / len(draws)
        assert x["p"] == want, x


def test_likelihood_is_monotone(spark):
    df = spark.range(1, 4000, 37).select(F.col("id").alias("c"))
    p = [r[0] for r in df.select(scoring.exceedance(F.col("c"), F.lit(300.0), F.lit(2000)).alias("p"), "c").orderBy("c").collect()]
    assert p == sorted(p)


def test_interval_and_buckets(spark):
    df = spark.createDataFrame([(10000, 2000.0, 8000), (10000, 2000.0, 10501), (10000, 2000.0, 14000), (10000, 2000.0, 14001)], "p bigint, r double, k bigint")
    low, mid, high = scoring.interval(F.col("p"), F.col("r"))
    rows = df.select(low, mid, high, scoring.ratio_bucket(F.col("k"), F.col("p"))).collect()
    assert tuple(rows[0])[:3] == (8000, 10000, 12000)
    assert [r[3] for r in rows] == ["safe_backup", "ambitious_reach", "ambitious_reach", "unlikely_reach"]


@pytest.mark.parametrize("label,margin", [("Safe", 500), ("Moderate", 5), ("Moderate", -5), ("Ambitious", -12345)])
def test_explanations_quote_both_numbers(spark, label, margin):
    df = spark.createDataFrame([("I", "P", 20000, 20000 - margin, 0.6125, label)], "i string, p string, c bigint, r bigint, q double, l string")
    got = df.select(text.explanation(*[F.col(c) for c in "iprcql"[:2]], F.col("c"), F.col("r"), F.col("q"), F.col("l"))).first()[0]
    assert "20,000" in got and f"{abs(margin):,}" in got and label in got


def pool(spark, rows):
    schema = "profile_id bigint, choice_id string, recommendation_bucket string, rank_type_used string, sort_position int, top_n int, sort_mode string"
    return spark.createDataFrame(rows, schema)


def reference_selection(rows, top_n):
    """Straight-line restatement of the selection rules on one small list."""
    quota = {"safe_backup": 30, "best_realistic": 50, "ambitious_reach": 20}
    share = {b: top_n * q // 100 for b, q in quota.items()}
    spare = top_n - sum(share.values())
    for b in sorted(quota, key=lambda b: -(top_n * quota[b] % 100)):
        if spare > 0:
            share[b], spare = share[b] + 1, spare - 1
    picked = []
    for b in quota:
        picked += [r for r in rows if r["b"] == b][:share[b]]
    picked += [r for r in rows if r not in picked][:top_n - len(picked)]
    count = lambda f, v: sum(p[f] == v for p in picked)
    for field, values in (("t", ["JEE_ADVANCED", "JEE_MAIN"]), ("b", list(quota))):
        absent = [v for v in values if count(field, v) == 0]
        for v in values:
            if len(picked) < top_n or (field == "t" and v not in absent) or count(field, v):
                continue
            best = next((r for r in rows if r[field] == v and r not in picked), None)
            out = next((p for p in reversed(picked) if count(field, p[field]) > 1), None)
            if best and out:
                picked = [p for p in picked if p is not out] + [best]
    return sorted(p["pos"] for p in picked)


def test_full_list_is_split_30_50_20(spark):
    sizes = {"safe_backup": 40, "best_realistic": 50, "ambitious_reach": 30}
    rows, pos = [], 0
    for b, n in sizes.items():
        for _ in range(n):
            pos += 1
            rows.append((1, f"c{pos}", b, "JEE_MAIN", pos, 100, "best_fit"))
    got = recommend.balanced_selection(pool(spark, rows)).groupBy("recommendation_bucket").count().collect()
    assert {r[0]: r[1] for r in got} == {"safe_backup": 30, "best_realistic": 50, "ambitious_reach": 20}


def test_balanced_selection_against_brute_force(spark):
    r = random.Random(11)
    rows, want = [], {}
    for pid in range(120):
        n, top_n = r.randint(1, 40), r.randint(1, 15)
        weights = [r.choice([0, 1, 8]) + 0.01 for _ in range(3)]
        items = []
        for pos in range(1, n + 1):
            b = r.choices(["safe_backup", "best_realistic", "ambitious_reach"], weights)[0]
            t = "JEE_ADVANCED" if r.random() < r.choice([0.05, 0.5]) else "JEE_MAIN"
            items.append({"pos": pos, "b": b, "t": t})
            rows.append((pid, f"{pid}-{pos}", b, t, pos, top_n, "best_fit"))
        want[pid] = reference_selection(items, top_n)
    got = {}
    for x in recommend.balanced_selection(pool(spark, rows)).collect():
        got.setdefault(x["profile_id"], []).append(x["sort_position"])
    assert {k: sorted(v) for k, v in got.items()} == want


def test_request_validation(spark):
    ok = profiles.validate_profiles(profile(spark)).first()
    assert ok["is_valid"]
    bad = profiles.validate_profiles(profile(spark, main_rank=1_200_001, category="GEN", round=7, top_n=0, pref_quotas=["XX"], pref_branch_keywords=[" "])).first()
    assert set(bad["reasons"]) == {"main_rank", "category", "round", "top_n", "pref_quotas", "pref_branch_keywords"}


def test_weighted_fit_and_percentiles(spark):
    rows = [(2022, 4800), (2023, 5100), (2024, 4950), (2025, 5300)]
    hist = spark.createDataFrame([("D", "CSE", "AI", "OPEN", "Gender-Neutral", False, y, c) for y, c in rows],
                                 "institute string, program string, quota_pool string, category string, gender string, is_pwd boolean, year bigint, closing_rank bigint")
    plain = pm.fit_plain(hist).first()
    assert plain["mean"] == 5037.5 and plain["std_dev"] == pytest.approx(213.6, abs=0.5)
    sizes = {2022: 900_000, 2023: 950_000, 2024: 1_000_000, 2025: 1_050_000}
    cohorts = spark.createDataFrame(list(sizes.items()), "year bigint, total_candidates bigint")
    got = pm.fit_percentiles(hist, cohorts).first()
    w = [0.6 ** (2025 - y) for y, _ in rows]
    x = [100 * c / sizes[y] for y, c in rows]
    mean = sum(a * b for a, b in zip(w, x)) / sum(w)
    v1, v2 = sum(w), sum(a * a for a in w)
    sd = (v1 / (v1 * v1 - v2) * sum(a * (b - mean) ** 2 for a, b in zip(w, x))) ** 0.5
    assert got["mean"] == pytest.approx(mean) and got["std_dev"] == pytest.approx(sd) and got["status"] == "ok"
    missing = pm.fit_percentiles(hist, cohorts.where("year <> 2023")).first()
    assert missing["status"] == "missing_cohort"
    flat = hist.where("year <= 2023").withColumn("closing_rank", F.lit(450_000))  # exactly 50 percent
    equal = cohorts.withColumn("total_candidates", F.lit(900_000))
    assert pm.fit_percentiles(flat, equal).first()["status"] == "invalid_std"


def test_capacity_cut_on_a_hot_seat(spark):
    rows = [("hot", i, (i * 7919) % 5000, 3) for i in range(3000)] + [("cold", 1, 5, 2)]
    apps = spark.createDataFrame(rows, "seat_id string, candidate_id bigint, rank bigint, capacity int")
    got = sorted((r["seat_id"], r["place"], r["candidate_id"]) for r in capacity_cut(apps).collect())
    best = sorted(rows[:-1], key=lambda r: (r[2], r[1]))[:3]
    assert got == [("cold", 1, 1)] + [("hot", i + 1, b[1]) for i, b in enumerate(best)]
