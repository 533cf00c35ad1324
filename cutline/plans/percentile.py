"""Recency-weighted percentile model, eligibility routing and allotment-join queries."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from cutline.functions import scoring
from cutline.operators import allotment, percentile_model as pm
from cutline.plans.oracle_tables import PROGRAM_CASE, QUOTA_CASE, TYPE_CASE, same
from cutline.plans.registry import cte, query, rounded
from cutline.session import durable
from cutline.sources import driver_tables as d

AK = "institute, program, quota_pool, category, gender, is_pwd"
TARGET_TOTAL = 1_002_000
OFFSET, SCALE = pm.competitive_proxy_terms(0.5)

cte("hist", f"""SELECT {AK}, year, round, closing_rank, institute_type, institute_state FROM (SELECT *, CASE WHEN quota = 'HS' THEN 'HS' ELSE 'AI' END AS quota_pool,
 row_number() OVER (PARTITION BY institute, program, CASE WHEN quota = 'HS' THEN 'HS' ELSE 'AI' END, category, gender, is_pwd, year ORDER BY round DESC, closing_rank) AS rn FROM observed) WHERE rn = 1""", ("observed",))
cte("pct", """SELECT h.*, closing_rank / CAST(total_candidates AS DOUBLE) * 100 AS x, max(year) OVER (PARTITION BY institute, program, quota_pool, category, gender, is_pwd) AS newest,
 total_candidates FROM hist h LEFT JOIN (SELECT * FROM cohorts WHERE year <> 1996) USING (year) WHERE year < 2001""", ("hist", "cohorts"))
cte("fit1", f"""SELECT {AK}, count(*) AS n, count(*) - count(total_candidates) AS unsized, sum(power(0.6e0, newest - year)) AS v1, sum(power(0.6e0, newest - year) * power(0.6e0, newest - year)) AS v2,
 sum(power(0.6e0, newest - year) * x) / sum(power(0.6e0, newest - year)) AS mean FROM pct GROUP BY ALL""", ("pct",))
cte("fit2", f"""SELECT {", ".join("f." + c.strip() for c in AK.split(","))}, n, CASE WHEN unsized = 0 THEN mean END AS mean, CASE WHEN unsized > 0 THEN CASE WHEN n < 2 THEN 0e0 END WHEN n < 2 THEN 0e0 WHEN v1 * v1 - v2 > 0 THEN sqrt(v1 / (v1 * v1 - v2) * q) ELSE 0e0 END AS std_dev, unsized
 FROM fit1 f JOIN (SELECT {", ".join("p." + c.strip() for c in AK.split(","))}, sum(power(0.6e0, p.newest - p.year) * (p.x - f.mean) * (p.x - f.mean)) AS q FROM pct p JOIN fit1 f ON {same('p', 'f', AK)} GROUP BY ALL) s ON {same('f', 's', AK)}""", ("fit1", "pct"))
cte("fit", """SELECT * EXCLUDE (unsized), CASE WHEN unsized > 0 THEN 'missing_cohort' WHEN n >= 2 AND std_dev <= 0 THEN 'invalid_std' ELSE 'ok' END AS status FROM fit2""", ("fit2",))
cte("asset", f"SELECT {AK}, max(institute_type) AS institute_type, max(institute_state) AS institute_state FROM hist GROUP BY ALL", ("hist",))
cte("resolved", f"""SELECT {", ".join("a." + c.strip() for c in AK.split(","))}, a.institute_type, a.institute_state, CASE WHEN o.status IS NOT NULL THEN o.mean ELSE p.mean + {OFFSET}e0 END AS mean,
 CASE WHEN o.status IS NOT NULL THEN o.std_dev ELSE p.std_dev * {SCALE}e0 END AS std_dev, o.status IS NULL AND a.program <> 'Chemistry' AS uses_cold_start_proxy,
 CASE WHEN o.status IS NOT NULL THEN o.status WHEN a.program = 'Chemistry' THEN 'no_history_or_proxy' WHEN k.institute IS NULL THEN 'proxy_not_found' WHEN p.status IS NULL THEN 'proxy_has_no_history' ELSE p.status END AS status
 FROM asset a LEFT JOIN fit o ON {same('a', 'o', AK)} LEFT JOIN (SELECT *, institute AS ki FROM asset) k ON a.program <> 'Chemistry' AND k.institute = a.institute AND k.program = 'Chemistry' AND k.quota_pool = a.quota_pool AND k.category = a.category AND k.gender = a.gender AND k.is_pwd = a.is_pwd
 LEFT JOIN fit p ON a.program <> 'Chemistry' AND p.institute = a.institute AND p.program = 'Chemistry' AND p.quota_pool = a.quota_pool AND p.category = a.category AND p.gender = a.gender AND p.is_pwd = a.is_pwd""", ("asset", "fit"))


def history(spark: SparkSession, sf: str, grain: str = "supplier") -> DataFrame:
    return pm.latest_round_history(d.observed(spark, sf, grain))


def _past(spark, sf, grain="supplier"):
    return history(spark, sf, grain).where(F.col("year") < d.FINAL_YEAR)


def _some_cohorts(spark, sf):
    """One season without cohort size, so that the error status occurs."""
    return d.cohorts(spark, sf).where(F.col("year") != 1996)


def _proxies(assets: DataFrame) -> DataFrame:
    """Every programme but one leans on that one at the same institute and seat pool."""
    return assets.where(F.col("program") != "Chemistry").select(
        *pm.ASSET_KEY, *[(F.lit("Chemistry") if k == "program" else F.col(k)).alias(f"proxy_{k}") for k in pm.ASSET_KEY],
        F.lit(OFFSET).alias("mean_offset"), F.lit(SCALE).alias("std_scale"))


def resolved(spark, sf, grain="supplier", cohorts=None):
    rows = history(spark, sf, grain)
    fits = pm.fit_percentiles(rows.where(F.col("year") < d.FINAL_YEAR), cohorts if cohorts is not None else _some_cohorts(spark, sf))
    assets = pm.assets(rows).drop("yearly_cutoffs")
    return pm.resolve_distributions(assets, fits, _proxies(assets))


@query("K2_J8_S12_latest_round_history", f"SELECT {AK}, year, round, closing_rank FROM hist", ("hist",))
def _(spark, sf):
    return history(spark, sf).select(*pm.ASSET_KEY, "year", "round", "closing_rank")


@query("A30_asset_series", f"""SELECT {AK}, institute_type, institute_state, string_agg(year || ':' || closing_rank, ',' ORDER BY year) AS series FROM hist GROUP BY ALL""", ("hist",))
def _(spark, sf):
    text = F.array_join(F.transform("yearly_cutoffs", lambda s: F.concat(s["year"].cast("string"), F.lit(":"), s["closing_rank"].cast("string"))), ",")
    return pm.assets(history(spark, sf)).select(*pm.ASSET_KEY, "institute_type", "institute_state", text.alias("series"))


@query("A28_weighted_fit", f"SELECT {AK}, n, CASE WHEN status <> 'missing_cohort' THEN round(mean, 8) END AS mean, CASE WHEN status <> 'missing_cohort' THEN round(std_dev, 8) END AS std_dev, status FROM fit", ("fit",))
def _(spark, sf):
    out = pm.fit_percentiles(_past(spark, sf), _some_cohorts(spark, sf))
    known = lambda c: F.when(F.col("status") != "missing_cohort", F.col(c)).alias(c)
    return rounded(out.select(*pm.ASSET_KEY, "n", known("mean"), known("std_dev"), "status"), 8)


@query("A29_plain_fit", f"SELECT {AK}, count(*) AS n, round(avg(closing_rank), 6) AS mean, round(coalesce(stddev_samp(closing_rank), 0e0), 6) AS std_dev FROM hist WHERE year < 2001 GROUP BY ALL", ("hist",))
def _(spark, sf):
    return rounded(pm.fit_plain(_past(spark, sf)))


@query("M7_W12_rank_percentile", f"""SELECT {AK}, year, round(closing_rank / CAST(total_candidates AS DOUBLE) * 100, 8) AS percentile,
 CAST(least(greatest(round(closing_rank / CAST(total_candidates AS DOUBLE) * 100 / 100 * {TARGET_TOTAL}), 1), {TARGET_TOTAL}) AS BIGINT) AS rank_in_target FROM hist JOIN cohorts USING (year)""", ("hist", "cohorts"))
def _(spark, sf):
    rows = history(spark, sf).join(F.broadcast(d.cohorts(spark, sf)), "year")
    p = scoring.percentile_of(F.col("closing_rank"), F.col("total_candidates"))
    return rounded(rows.select(*pm.ASSET_KEY, "year", p.alias("percentile"), scoring.rank_of(p, F.lit(TARGET_TOTAL)).alias("rank_in_target")), 8)


@query("M8_seat_shift", f"SELECT {AK}, round(mean + 0.25e0, 8) AS mean, round(std_dev, 8) AS std_dev FROM fit WHERE status = 'ok'", ("fit",))
def _(spark, sf):
    fits = pm.fit_percentiles(_past(spark, sf), _some_cohorts(spark, sf)).where(F.col("status") == "ok")
    return rounded(pm.seat_shift(fits, 0.25).select(*pm.ASSET_KEY, "mean", "std_dev"), 8)


@query("J15_cold_start_proxy", f"""SELECT {AK}, CASE WHEN status = 'ok' THEN round(mean, 8) END AS mean, CASE WHEN status = 'ok' THEN round(std_dev, 8) END AS std_dev, uses_cold_start_proxy, status FROM resolved""", ("resolved",))
def _(spark, sf):
    ok = lambda c: F.when(F.col("status") == "ok", F.col(c)).alias(c)
    return rounded(resolved(spark, sf).select(*pm.ASSET_KEY, ok("mean"), ok("std_dev"), "uses_cold_start_proxy", "status"), 8)


# --- simulation over all profiles, on the bounded brand catalogue -------------------------
cte("hist_b", f"""SELECT {AK}, year, closing_rank, institute_type, institute_state FROM (SELECT *, CASE WHEN quota = 'HS' THEN 'HS' ELSE 'AI' END AS quota_pool,
 row_number() OVER (PARTITION BY institute, program, CASE WHEN quota = 'HS' THEN 'HS' ELSE 'AI' END, category, gender, is_pwd, year ORDER BY round DESC, closing_rank) AS rn FROM observed_b) WHERE rn = 1""", ("observed_b",))
cte("pct_b", """SELECT h.*, closing_rank / CAST(total_candidates AS DOUBLE) * 100 AS x, max(year) OVER (PARTITION BY institute, program, quota_pool, category, gender, is_pwd) AS newest
 FROM hist_b h JOIN cohorts USING (year)""", ("hist_b", "cohorts"))
cte("fit_b", f"""SELECT {", ".join("f." + c.strip() for c in AK.split(","))}, any_value(f.institute_type) AS institute_type, any_value(f.institute_state) AS institute_state, any_value(f.mean) AS mean,
 CASE WHEN count(*) < 2 THEN 0e0 ELSE sqrt(any_value(v1 / nullif(v1 * v1 - v2, 0)) * sum(power(0.6e0, p.newest - p.year) * (p.x - f.mean) * (p.x - f.mean))) END AS std_dev, count(*) AS n
 FROM pct_b p JOIN (SELECT {AK}, max(institute_type) AS institute_type, max(institute_state) AS institute_state, sum(power(0.6e0, newest - year)) AS v1, sum(power(0.6e0, 2 * (newest - year))) AS v2,
 sum(power(0.6e0, newest - year) * x) / sum(power(0.6e0, newest - year)) AS mean FROM pct_b GROUP BY ALL) f ON {same('p', 'f', AK)} GROUP BY ALL""", ("pct_b",))
cte("users", """SELECT profile_id, category, lower(gender) LIKE '%female%' AS is_female, is_pwd AS has_pwd, upper(home_state) AS home_state, q.run, q.pool, CASE WHEN q.run = 3 THEN advanced_rank ELSE main_rank END AS rank_used
 FROM profiles CROSS JOIN (SELECT unnest([1, 2, 3]) AS run, unnest(['HS', 'AI', 'AI']) AS pool) q WHERE q.run < 3 OR advanced_rank IS NOT NULL""", ("profiles",))
cte("routes", """SELECT u.profile_id, u.run, u.rank_used, u.is_female, a.* FROM users u JOIN fit_b a ON u.category = a.category AND u.pool = a.quota_pool
 WHERE (NOT lower(a.gender) LIKE '%female%' OR u.is_female) AND (NOT a.is_pwd OR u.has_pwd) AND (a.quota_pool <> 'HS' OR coalesce(a.institute_state = u.home_state, false)) AND (u.run = 3) = (a.institute_type = 'IIT')""", ("users", "fit_b"))
# 10,000 draws in 100 rising chunks: chunks whose least draw passes pass whole, the one before is looked at draw by draw
cte("many_draws", """SELECT list(c ORDER BY k) AS chunks, list(c[1] ORDER BY k) AS lows FROM (SELECT k, list(z ORDER BY z) AS c FROM (SELECT z, (row_number() OVER (ORDER BY z) - 1) // 100 AS k FROM (
 SELECT sqrt(-2e0 * ln((i + 0.5e0) / 10000e0)) * cos(2e0 * pi() * (i * 0.6180339887498949e0 - floor(i * 0.6180339887498949e0))) AS z FROM range(10000) t(i))) GROUP BY k)""")
cte("simulated", f"""SELECT *, CASE WHEN is_female THEN 'F' ELSE 'N' END AS gender_tag, round(CASE WHEN std_dev <= 0 THEN CASE WHEN u <= mean THEN 100e0 ELSE 0e0 END ELSE 0e0 END, 1) AS certain, CASE WHEN std_dev <= 0 THEN certain ELSE (100 * above + CASE WHEN above < 100 THEN len(list_filter(chunks[100 - above], lambda z: mean + z * std_dev >= u)) ELSE 0 END + 5) // 10 / 10e0 END AS probability_percent,
 CAST(least(greatest(round(mean / 100 * {TARGET_TOTAL}), 1), {TARGET_TOTAL}) AS BIGINT) AS projected_closing_rank FROM (SELECT *, len(list_filter(lows, lambda z: mean + z * std_dev >= u)) AS above
 FROM (SELECT *, rank_used / CAST({TARGET_TOTAL} AS DOUBLE) * 100 AS u FROM routes WHERE n < 2 OR std_dev > 0) CROSS JOIN many_draws)""", ("routes", "many_draws"))
cte("first_run", """SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY profile_id, institute, program, quota_pool, gender_tag ORDER BY run, gender, is_pwd) AS rn FROM simulated) WHERE rn = 1""", ("simulated",))

_FITS: dict[tuple[str, str], DataFrame] = {}


def fitted_assets(spark: SparkSession, sf: str) -> DataFrame:
    """Fitted brand-grain assets, stored once per session like the universe they belong to."""
    key = (spark.sparkContext.applicationId, sf)
    if key not in _FITS:
        rows = history(spark, sf, "brand")
        fits = pm.fit_percentiles(rows, d.cohorts(spark, sf))
        names = rows.groupBy(*pm.ASSET_KEY).agg(F.max("institute_type").alias("institute_type"), F.max("institute_state").alias("institute_state"))
        _FITS[key] = durable(fits.join(names, pm.ASSET_KEY))
    return _FITS[key]


def users(spark, sf):
    """Each profile tries home-state seats, all-India seats, and with an advanced rank IIT seats."""
    runs = F.explode(F.array(*[F.struct(F.lit(r).alias("run"), F.lit(q).alias("quota_pool")) for r, q in ((1, "HS"), (2, "AI"), (3, "AI"))]))
    p = d.profiles(spark, sf).select(
        "profile_id", "category", F.lower("gender").contains("female").alias("is_female"), F.col("is_pwd").alias("has_pwd"),
        F.upper("home_state").alias("home_state"), "main_rank", "advanced_rank", runs.alias("__r"))
    out = p.select("*", "__r.run", "__r.quota_pool").drop("__r").where((F.col("run") < 3) | F.col("advanced_rank").isNotNull())
    return out.withColumn("rank_used", F.when(F.col("run") == 3, F.col("advanced_rank")).otherwise(F.col("main_rank"))).drop("main_rank", "advanced_rank")


def routed(spark, sf):
    pairs = pm.eligible_assets(users(spark, sf), fitted_assets(spark, sf))
    return pairs.where((F.col("run") == 3) == (F.col("institute_type") == "IIT"))


def simulated(spark, sf):
    out = pm.predict_pairs(routed(spark, sf), TARGET_TOTAL)
    return out.withColumn("gender_tag", F.when(F.col("is_female"), "F").otherwise("N"))


def first_runs(spark, sf):
    """Each profile's first run per choice; only what later steps read is carried along."""
    return pm.first_run_wins(simulated(spark, sf).select(
        "profile_id", "institute", "program", "quota_pool", "gender_tag", "run", "gender", "is_pwd", "probability_percent"))


@query("J9_eligible_assets", f"SELECT profile_id, run, {AK} FROM routes", ("routes",))
def _(spark, sf):
    return routed(spark, sf).select("profile_id", "run", *pm.ASSET_KEY)


@query("M6_percentile_simulation", f"SELECT profile_id, run, {AK}, probability_percent, projected_closing_rank FROM simulated", ("simulated",))
def _(spark, sf):
    return simulated(spark, sf).select("profile_id", "run", *pm.ASSET_KEY, "probability_percent", "projected_closing_rank")


@query("X7_first_run_wins", "SELECT profile_id, institute, program, quota_pool, gender_tag, run, probability_percent FROM first_run", ("first_run",))
def _(spark, sf):
    return first_runs(spark, sf).select("profile_id", "institute", "program", "quota_pool", "gender_tag", "run", "probability_percent")


@query("A27_simulation_summary", """SELECT profile_id, count(*) AS total_options, max(institute) FILTER (i = 0) AS safest_choice, max(institute) FILTER (i = CAST(floor(options * 0.33e0) AS BIGINT)) AS top_upgrade FROM (
 SELECT *, row_number() OVER (PARTITION BY profile_id ORDER BY probability_percent DESC, institute, program, quota_pool, gender_tag) - 1 AS i, count(*) OVER (PARTITION BY profile_id) AS options FROM first_run) GROUP BY profile_id""", ("first_run",))
def _(spark, sf):
    return pm.simulation_summary(first_runs(spark, sf))


# --- preference expansion and capacity cut ------------------------------------------------
cte("wishes", f"""SELECT candidate_id, rank, category, institute, branch, row_number() OVER (PARTITION BY candidate_id ORDER BY first_order, institute, branch) - 1 AS wish FROM (
 SELECT o_custkey AS candidate_id, 'Institute ' || CAST(substring(p_brand, 7, 4) AS BIGINT) AS institute, {PROGRAM_CASE} AS branch, min(o_orderkey) AS first_order FROM lp JOIN orders ON l_orderkey = o_orderkey GROUP BY ALL)
 JOIN (SELECT profile_id, main_rank AS rank, category FROM profiles) ON candidate_id = profile_id""", ("lp", "profiles"))
cte("seats", f"""SELECT k || '-' || p_type || '-' || category AS seat_id, 'Institute ' || k AS institute, upper({PROGRAM_CASE}) AS branch, category, CASE WHEN k % 3 = 0 THEN 'STATE_BOARD' ELSE 'CENTRAL' END AS counselling, k % 3 + 1 AS capacity
 FROM (SELECT DISTINCT CAST(substring(p_brand, 7, 4) AS BIGINT) AS k, p_type FROM part) CROSS JOIN (SELECT unnest(['OPEN','OBC-NCL','SC']) AS category)""")
cte("applied", """SELECT w.candidate_id, w.rank, w.wish, s.seat_id, s.capacity, row_number() OVER (PARTITION BY w.candidate_id ORDER BY w.wish, s.seat_id) AS proposal FROM wishes w JOIN seats s ON w.institute = s.institute AND lower(w.branch) = lower(s.branch) AND w.category = s.category
 WHERE s.counselling = 'CENTRAL'""", ("wishes", "seats"))


def _applications(spark, sf):
    return allotment.expand_preferences(d.preferences(spark, sf), d.seats(spark, sf), ["CENTRAL"])


@query("J10_preference_expansion", "SELECT candidate_id, rank, CAST(wish AS INTEGER) AS wish, seat_id, proposal FROM applied", ("applied",))
def _(spark, sf):
    return _applications(spark, sf).select("candidate_id", "rank", "wish", "seat_id", "proposal")


@query("K6_capacity_cut", """SELECT seat_id, candidate_id, rank, place FROM (SELECT *, row_number() OVER (PARTITION BY seat_id ORDER BY rank, candidate_id) AS place FROM applied) WHERE place <= capacity""", ("applied",))
def _(spark, sf):
    return allotment.capacity_cut(_applications(spark, sf)).select("seat_id", "candidate_id", "rank", "place")
