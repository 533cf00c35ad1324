"""Profile scoring, ranking and selection queries."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window, functions as F

from cutline.functions import scoring, text
from cutline.operators import evaluation as ev, panel, profiles, quality, recommend
from cutline.plans.oracle_tables import OUTCOME
from cutline.plans.registry import as_long, query, rounded
from cutline.session import durable
from cutline.sources import driver_tables as d

_BUNDLES: dict[tuple[str, str], tuple[DataFrame, DataFrame]] = {}


def build_universe(spark: SparkSession, sf: str) -> DataFrame:
    """Candidates of the prediction year with their forecast (last observation)."""
    frame = panel.target_frame(d.observed(spark, sf, "brand"), d.PREDICTION_YEAR, extra_columns=("institute_state",))
    return frame.withColumn("predicted_closing_rank", scoring.predicted_rank(F.col("last_closing_rank"))).withColumn(
        "choice_id", text.stable_choice_id())


def build_calibration(spark: SparkSession, sf: str) -> DataFrame:
    forecasts = ev.rolling_forecasts(d.observed(spark, sf, "brand"))
    errors = ev.matched_errors(forecasts, d.ORIGIN_START, d.FINAL_YEAR).where(F.col("model") == ev.LAST)
    return ev.calibration_long(errors)


def serving_bundle(spark: SparkSession, sf: str) -> tuple[DataFrame, DataFrame]:
    """(universe, calibration), stored once per session as a service loads them at start."""
    key = (spark.sparkContext.applicationId, sf)
    if key not in _BUNDLES:
        _BUNDLES[key] = (durable(build_universe(spark, sf)), durable(build_calibration(spark, sf)))
    return _BUNDLES[key]


def _pairs(spark, sf):
    return profiles.match_candidates(d.profiles(spark, sf), serving_bundle(spark, sf)[0])


def _routed(spark, sf):
    return profiles.route_ranks(_pairs(spark, sf))


def _uncertain(spark, sf):
    return recommend.attach_uncertainty(_routed(spark, sf), serving_bundle(spark, sf)[1])


def scored(spark, sf):
    return recommend.score_candidates(_uncertain(spark, sf))


def chosen(spark, sf):
    return recommend.recommend(scored(spark, sf))


_PER = ["profile_id", "choice_id"]


@query("L15_serving_universe", f"""SELECT year, {OUTCOME}, institute_type, institute_state, duration_years, degree_type, last_closing_rank, greatest(1, last_closing_rank) AS predicted_closing_rank FROM frame_b""", ("frame_b",))
def _(spark, sf):
    from cutline.schemas import OUTCOME_KEY

    return build_universe(spark, sf).select(
        "year", *OUTCOME_KEY, "institute_type", "institute_state", "duration_years", "degree_type", "last_closing_rank", "predicted_closing_rank")


@query("L15_serving_calibration", "SELECT * FROM calibration", ("calibration",))
def _(spark, sf):
    return build_calibration(spark, sf)


@query("V4_serving_contract", """SELECT unnest(['empty_universe','wrong_prediction_year','bad_quantile','bad_count','unknown_type','unknown_round','default_rows_not_one','calibration_year_not_past']) AS "check",
 unnest([(SELECT CAST(count(*) = 0 AS BIGINT) FROM frame_b), (SELECT count(*) FROM frame_b WHERE year <> 2002), (SELECT count(*) FROM calibration WHERE NOT abs_residual_quantile > 0),
 (SELECT count(*) FROM calibration WHERE count < 1), (SELECT count(*) FROM calibration WHERE institute_type_str NOT IN ('__default__','IIT','NIT','IIIT','GFTI')),
 (SELECT count(*) FROM calibration WHERE institute_type_str <> '__default__' AND round NOT BETWEEN 1 AND 7), (SELECT CAST(count(*) <> 1 AS BIGINT) FROM calibration WHERE institute_type_str = '__default__'),
 (SELECT count(*) FROM (SELECT DISTINCT origin FROM errors_b) WHERE origin >= 2002)]) AS violations""", ("frame_b", "calibration", "errors_b"))
def _(spark, sf):
    universe, calibration = serving_bundle(spark, sf)
    errors = ev.matched_errors(ev.rolling_forecasts(d.observed(spark, sf, "brand")), d.ORIGIN_START, d.FINAL_YEAR)
    years = errors.select(F.col("origin").alias("year")).distinct()
    return quality.universe_contract(universe, calibration, years, d.PREDICTION_YEAR)


@query("L15_dataset_digest", """SELECT year, count(*) AS rows, """ + ", ".join(
    f"CAST(sum(CAST('0x' || substr(h, {at}, 15) AS BIGINT)) AS VARCHAR) AS s{i}" for i, at in enumerate((1, 16, 31, 46), 1)) + """ FROM (
 SELECT year, sha256(""" + " || ".join(f"strlen(CAST({c} AS VARCHAR)) || ':' || {c}" for c in (
    "category", "closing_rank", "gender", "institute", "is_pwd", "opening_rank", "program", "quota", "round")) + """) AS h FROM observed) GROUP BY year""", ("observed",))
def _(spark, sf):
    from cutline.sources import bundle

    observed = d.observed(spark, sf).select(
        "year", "category", "closing_rank", "gender", "institute", "is_pwd", "opening_rank", "program", "quota", "round")
    # seasons are few; each is a folder of the stored table, so a season's scan reads that folder alone
    parts = [bundle.with_row_sums(observed.where(F.col("year") == y).drop("year")).withColumn("year", F.lit(y).cast("bigint"))
             for y in d.YEARS]
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out.where(F.col("rows") > 0).select("year", "rows", *[F.col(f"s{i}").cast("string").alias(f"s{i}") for i in range(1, 5)])


@query("L15_V4_bundle_admission", """SELECT bundle, reasons, CASE WHEN reasons = '' THEN (SELECT count(*) FROM frame_b) END AS universe_rows,
 CASE WHEN reasons = '' THEN (SELECT count(*) FROM calibration) END AS calibration_rows, CASE WHEN reasons = '' THEN (SELECT count(*) FROM observed_b) END AS dataset_rows
 FROM (VALUES ('published', ''), ('torn', 'no manifest'), ('no_calibration', 'no calibration'), ('edited_universe', 'universe is not the one of the manifest'),
 ('mixed', 'calibration is not the one of the manifest'), ('later_calibration', 'calibration years not past'), ('other_dataset', 'calibration of another dataset'),
 ('leaking', 'universe carries closing_rank'), ('other_year', 'wrong_prediction_year'), ('two_defaults', 'default_rows_not_one')) v(bundle, reasons)""", ("frame_b", "calibration", "observed_b"))
def _(spark, sf):
    """One published bundle and nine that are torn, mixed, edited or inconsistent: what the loader says to each."""
    from cutline.sources import bundle
    from cutline.sources.tables import scratch_folder

    universe, calibration = serving_bundle(spark, sf)
    observed, folder = d.observed(spark, sf, "brand"), scratch_folder(spark, "bundles")
    facts = dict(training_years=d.YEARS, calibration_years=d.ORIGINS, data_cutoff_year=d.FINAL_YEAR, prediction_year=d.PREDICTION_YEAR,
                 features=["last_closing_rank"], seed=7)
    paths = {"published": bundle.publish(universe, calibration, observed, folder, **facts)}
    u, k, manifest = bundle.load(spark, paths["published"])
    dataset = {"rows": manifest["dataset_rows"], "digest": manifest["dataset_sha256"]}

    def variant(name, stated=None, **tables):
        """Tables under a manifest: the published one, or one made to fit them with some facts changed."""
        at = paths[name] = f"{folder}/{name}"
        bundle.write_tables(at, **tables)
        if stated is not None:
            made = manifest if stated == "published" else bundle.make_manifest(spark, at, dataset=dataset, **facts)
            if isinstance(stated, dict):
                made["calibration"].update(stated)
            bundle.write_manifest(spark, at, made)

    variant("torn", None, universe=u, calibration=k)
    variant("no_calibration", "published", universe=u)
    first = u.agg(F.min("choice_id")).first()[0]
    rank = F.col("predicted_closing_rank")
    variant("edited_universe", "published", calibration=k, universe=u.withColumn(
        "predicted_closing_rank", F.when(F.col("choice_id") == first, rank + 1).otherwise(rank)))
    variant("mixed", "published", universe=u, calibration=k.withColumn("abs_residual_quantile", F.col("abs_residual_quantile") + 1))
    variant("later_calibration", {"calibration_years": [*d.ORIGINS, d.PREDICTION_YEAR]}, universe=u, calibration=k)
    variant("other_dataset", {"dataset_sha256": "0" * 64}, universe=u, calibration=k)
    variant("leaking", "made", universe=u.withColumn("closing_rank", rank), calibration=k)
    variant("other_year", "made", universe=u.withColumn("year", F.when(F.col("choice_id") == first, F.col("year") - 1).otherwise(F.col("year"))), calibration=k)
    variant("two_defaults", "made", universe=u, calibration=k.unionByName(k.where(F.col("institute_type_str") == "__default__")))
    rows = []
    for name, path in paths.items():
        reasons, found, tables = bundle.examine(spark, path)
        counts = [None] * 3 if reasons else [*(found["tables"][t]["rows"] for t in bundle.TABLES), found["dataset_rows"]]
        rows.append((name, "; ".join(reasons), *counts))
    return spark.createDataFrame(rows, "bundle string, reasons string, universe_rows bigint, calibration_rows bigint, dataset_rows bigint")


_BAD = """SELECT profile_id, main_rank IS NULL OR main_rank NOT BETWEEN 1 AND 1200000 AS r1, coalesce(advanced_rank NOT BETWEEN 1 AND 50000, false) AS r2,
 category NOT IN ('OPEN','OBC-NCL','SC','ST','EWS') AS r3, gender NOT IN ('Gender-Neutral','Female-only') AS r4, profile_id % 37 = 0 AS r5, profile_id % 43 = 0 AS r6,
 round NOT BETWEEN 1 AND 6 AS r7, top_n NOT BETWEEN 1 AND 200 AS r8, profile_id % 47 = 0 AS r9, profile_id % 41 = 0 AS r10, profile_id % 31 = 0 AS r11 FROM (
 SELECT profile_id, CASE WHEN profile_id % 17 = 0 THEN 0 WHEN profile_id % 19 = 0 THEN 1200001 WHEN profile_id % 23 <> 0 THEN main_rank END AS main_rank,
 CASE WHEN profile_id % 13 = 0 THEN 50001 ELSE advanced_rank END AS advanced_rank, CASE WHEN profile_id % 11 = 0 THEN 'GENERAL' ELSE category END AS category,
 CASE WHEN profile_id % 29 = 0 THEN 'Any' ELSE gender END AS gender, profile_id % 8 AS round, profile_id % 205 AS top_n FROM profiles)"""


@query("P7_request_validation", f"""SELECT profile_id, concat_ws(',', CASE WHEN r1 THEN 'main_rank' END, CASE WHEN r2 THEN 'advanced_rank' END, CASE WHEN r3 THEN 'category' END, CASE WHEN r4 THEN 'gender' END,
 CASE WHEN r5 THEN 'pref_inst_types' END, CASE WHEN r6 THEN 'pref_quotas' END, CASE WHEN r7 THEN 'round' END, CASE WHEN r8 THEN 'top_n' END, CASE WHEN r9 THEN 'sort_mode' END,
 CASE WHEN r10 THEN 'pref_branch_keywords' END, CASE WHEN r11 THEN 'home_state' END) AS reasons,
 NOT (r1 OR r2 OR r3 OR r4 OR r5 OR r6 OR r7 OR r8 OR r9 OR r10 OR r11) AS is_valid FROM ({_BAD})""", ("profiles",))
def _(spark, sf):
    return profiles.validate_profiles(d.requests(spark, sf)).select(
        "profile_id", F.array_join("reasons", ",").alias("reasons"), "is_valid")


@query("P6_profile_candidates", f"SELECT profile_id, {OUTCOME} FROM pairs", ("pairs",))
def _(spark, sf):
    from cutline.schemas import OUTCOME_KEY

    return _pairs(spark, sf).select("profile_id", *OUTCOME_KEY)


@query("P6_profile_candidates_salted", f"SELECT profile_id, {OUTCOME} FROM pairs", ("pairs",))
def _(spark, sf):
    from cutline.schemas import OUTCOME_KEY

    # the path taken when the universe is too large to broadcast
    return profiles.match_candidates(d.profiles(spark, sf), serving_bundle(spark, sf)[0], checked_small=False).select("profile_id", *OUTCOME_KEY)


@query("P8_rank_routing", "SELECT profile_id, choice_id, rank_used, rank_type_used FROM routed", ("routed",))
def _(spark, sf):
    return _routed(spark, sf).select(*_PER, "rank_used", "rank_type_used")


@query("F9_choice_ids", f"SELECT DISTINCT {OUTCOME}, choice_id FROM routed", ("routed",))
def _(spark, sf):
    from cutline.schemas import OUTCOME_KEY

    return _routed(spark, sf).select(*OUTCOME_KEY, "choice_id").distinct()


@query("J7_uncertainty_cascade", "SELECT profile_id, choice_id, round(uncertainty_radius, 6) AS uncertainty_radius, round(uncertainty_radius / 1.6448536269514722e0, 6) AS std_dev FROM uncertain", ("uncertain",))
def _(spark, sf):
    return rounded(_uncertain(spark, sf).select(*_PER, "uncertainty_radius", "std_dev"))


@query("M3_exceedance_likelihood", "SELECT profile_id, choice_id, admission_probability FROM likely", ("likely",))
def _(spark, sf):
    p = scoring.exceedance(F.col("predicted_closing_rank"), F.col("std_dev"), F.col("rank_used"))
    return _uncertain(spark, sf).select(*_PER, p.alias("admission_probability"))


_PCT = lambda q: f"round(list_aggregate(list_transform(zs, lambda z: greatest(1e0, predicted_closing_rank + z * (uncertainty_radius / 1.6448536269514722e0))), 'quantile_cont', {q}), 5)"


@query("M3_draw_percentiles", f"SELECT profile_id, choice_id, {_PCT(0.05)} AS p05, {_PCT(0.5)} AS p50, {_PCT(0.95)} AS p95 FROM uncertain CROSS JOIN draws", ("uncertain", "draws"))
def _(spark, sf):
    at = lambda q, n: scoring.draw_percentile(F.col("predicted_closing_rank"), F.col("std_dev"), q).alias(n)
    return rounded(_uncertain(spark, sf).select(*_PER, at(0.05, "p05"), at(0.5, "p50"), at(0.95, "p95")), 5)


@query("M4_point_likelihood", "SELECT profile_id, choice_id, CASE WHEN rank_used <= predicted_closing_rank THEN 1e0 ELSE 0e0 END AS admission_probability, predicted_closing_rank AS ci_lower_5, predicted_closing_rank AS ci_upper_95 FROM routed", ("routed",))
def _(spark, sf):
    rows = _routed(spark, sf)
    low, _, high = scoring.interval(F.col("predicted_closing_rank"), F.lit(0.0))
    return rows.select(*_PER, scoring.point_likelihood(F.col("predicted_closing_rank"), F.col("rank_used")).alias("admission_probability"),
                       low.alias("ci_lower_5"), high.alias("ci_upper_95"))


@query("M5_empirical_interval", """SELECT profile_id, choice_id, CAST(greatest(1, floor(predicted_closing_rank - uncertainty_radius)) AS BIGINT) AS ci_lower_5, predicted_closing_rank AS expected_cutoff_50,
 CAST(greatest(1, ceil(predicted_closing_rank + uncertainty_radius)) AS BIGINT) AS ci_upper_95 FROM uncertain""", ("uncertain",))
def _(spark, sf):
    low, mid, high = scoring.interval(F.col("predicted_closing_rank"), F.col("uncertainty_radius"))
    return _uncertain(spark, sf).select(*_PER, low.alias("ci_lower_5"), mid.alias("expected_cutoff_50"), high.alias("ci_upper_95"))


@query("M9_M10_M11_margin_bucket_label", """SELECT profile_id, choice_id, margin, round(margin_score, 6) AS margin_score, round(rank_used / CAST(predicted_closing_rank AS DOUBLE), 6) AS rank_ratio, recommendation_bucket, confidence_label FROM parts_""", ("parts_",))
def _(spark, sf):
    return rounded(scored(spark, sf).select(*_PER, "margin", "margin_score", "rank_ratio", "recommendation_bucket", "confidence_label"))


@query("M12_M13_F8_W11_desirability", """SELECT profile_id, choice_id, institute_score, branch_score, round(competitiveness_score, 6) AS competitiveness_score, round(desirability_score, 6) AS desirability_score FROM scored""", ("scored",))
def _(spark, sf):
    return rounded(scored(spark, sf).select(*_PER, "institute_score", "branch_score", "competitiveness_score", "desirability_score"))


@query("M14_M15_M16_M17_scores", """SELECT profile_id, choice_id, round(admissibility_score, 6) AS admissibility_score, round(fit_score, 6) AS fit_score, round(safety_score, 6) AS safety_score, recommendation_score FROM scored""", ("scored",))
def _(spark, sf):
    return rounded(scored(spark, sf).select(*_PER, "admissibility_score", "fit_score", "safety_score", "recommendation_score"))


@query("M18_legacy_score", """SELECT profile_id, choice_id, round(admission_probability * 100 + margin / CAST(predicted_closing_rank AS DOUBLE) * 20, 6) AS legacy_score, confidence_label FROM parts_""", ("parts_",))
def _(spark, sf):
    s = scoring.legacy_score(F.col("admission_probability"), F.col("predicted_closing_rank"), F.col("rank_used"))
    return rounded(scored(spark, sf).select(*_PER, s.alias("legacy_score"), "confidence_label"))


@query("M22_reach_windows", """SELECT profile_id, CAST(round_even(main_rank * 0.60e0, 0) AS BIGINT) AS main_low, CAST(round_even(main_rank * 1.05e0, 0) AS BIGINT) AS main_high,
 CAST(round_even(advanced_rank * 0.60e0, 0) AS BIGINT) AS advanced_low, CAST(round_even(advanced_rank * 1.05e0, 0) AS BIGINT) AS advanced_high FROM profiles""", ("profiles",))
def _(spark, sf):
    a, b = scoring.reach_window(F.col("main_rank"))
    c, e = scoring.reach_window(F.col("advanced_rank"))
    return d.profiles(spark, sf).select("profile_id", a.alias("main_low"), b.alias("main_high"), c.alias("advanced_low"), e.alias("advanced_high"))


@query("M21_M23_whole_ranks", f"""SELECT origin, {OUTCOME}, CAST(greatest(1, round_even(hist_mean_closing_rank, 0)) AS BIGINT) AS predicted, last_closing_rank - last_closing_rank // 5 AS approximate_opening FROM forecasts_b WHERE origin >= 2001""", ("forecasts_b",))
def _(spark, sf):
    from cutline.schemas import OUTCOME_KEY

    rows = ev.rolling_forecasts(d.observed(spark, sf, "brand")).where(F.col("origin") >= 2001)
    return rows.select("origin", *OUTCOME_KEY, scoring.predicted_rank(F.col("hist_mean_closing_rank")).alias("predicted"),
                       scoring.approximate_opening(F.col("last_closing_rank")).alias("approximate_opening"))


@query("A25_bucket_counts", """SELECT profile_id, count(*) FILTER (recommendation_bucket = 'safe_backup') AS safe_backup, count(*) FILTER (recommendation_bucket = 'best_realistic') AS best_realistic,
 count(*) FILTER (recommendation_bucket = 'ambitious_reach') AS ambitious_reach, count(*) FILTER (recommendation_bucket = 'unlikely_reach') AS unlikely_reach,
 count(*) FILTER (institute_type = 'IIT') AS "IIT", count(*) FILTER (institute_type = 'NIT') AS "NIT", count(*) FILTER (institute_type = 'IIIT') AS "IIIT", count(*) FILTER (institute_type = 'GFTI') AS "GFTI" FROM parts_ GROUP BY profile_id""", ("parts_",))
def _(spark, sf):
    return recommend.bucket_counts(scored(spark, sf))


@query("A25_candidate_counts", """SELECT p.profile_id, coalesce(a, 0) AS after_profile_filters, coalesce(s, 0) AS scored, coalesce(e, 0) AS eligible_after_reach_filter FROM profiles p
 LEFT JOIN (SELECT profile_id, count(*) AS a FROM pairs GROUP BY 1) x ON p.profile_id = x.profile_id
 LEFT JOIN (SELECT profile_id, count(*) AS s, count(*) FILTER (recommendation_bucket <> 'unlikely_reach') AS e FROM parts_ GROUP BY 1) y ON p.profile_id = y.profile_id""", ("profiles", "pairs", "parts_"))
def _(spark, sf):
    return profiles.candidate_counts(d.profiles(spark, sf), _pairs(spark, sf), scored(spark, sf))


@query("P9_K7_sorted_candidates", "SELECT profile_id, choice_id, sort_mode, sort_position FROM ordered", ("ordered",))
def _(spark, sf):
    return recommend.order_candidates(scored(spark, sf)).select(*_PER, "sort_mode", "sort_position")


_QUOTA = lambda i: f"""(top_n * {(30, 50, 20)[i]} // 100 + CASE WHEN ({' + '.join(
    f"CASE WHEN top_n * {q} % 100 {'>=' if j < i else '>'} top_n * {(30, 50, 20)[i]} % 100 THEN 1 ELSE 0 END" for j, q in enumerate((30, 50, 20)) if j != i)})
 < top_n - top_n * 30 // 100 - top_n * 50 // 100 - top_n * 20 // 100 THEN 1 ELSE 0 END)"""
_MARKED = f"""SELECT *, sum(CASE WHEN head THEN 1 ELSE 0 END) OVER (PARTITION BY profile_id) AS n_head, sum(CASE WHEN head THEN 0 ELSE 1 END) OVER (PARTITION BY profile_id ORDER BY sort_position) AS fill FROM (
 SELECT *, row_number() OVER (PARTITION BY profile_id, recommendation_bucket ORDER BY sort_position) <= CASE recommendation_bucket WHEN 'safe_backup' THEN {_QUOTA(0)} WHEN 'best_realistic' THEN {_QUOTA(1)} ELSE {_QUOTA(2)} END AS head FROM ordered)"""
_FILLED = f"SELECT * FROM ({_MARKED}) WHERE sort_mode = 'best_fit' AND (head OR fill <= top_n - n_head)"


@query("K5_J11_quota_and_backfill", f"SELECT profile_id, choice_id, recommendation_bucket, sort_position FROM ({_FILLED})", ("ordered",))
def _(spark, sf):
    rows = recommend.quota_and_backfill(recommend.order_candidates(scored(spark, sf)))
    return rows.where(recommend.is_balanced() & F.col("selected")).select(*_PER, "recommendation_bucket", "sort_position")


def _swap_sql(src: str, column: str, value: str, step: int, wanted: str) -> str:
    """One swap in SQL: marks, then the new selected flag and pick order."""
    swap = f"({wanted} AND sort_mode = 'best_fit' AND have = 0 AND best IS NOT NULL AND final IS NOT NULL AND n_sel >= top_n)"
    return f"""SELECT * EXCLUDE (have, best, n_sel, peers, final, sel, ord), CASE WHEN {swap} AND sort_position = best AND NOT sel THEN true WHEN {swap} AND sel AND ord = final THEN false ELSE sel END AS sel,
 CASE WHEN {swap} AND sort_position = best AND NOT sel THEN {10_000_000 + step} ELSE ord END AS ord FROM (
 SELECT *, max(CASE WHEN sel AND peers > 1 THEN ord END) OVER (PARTITION BY profile_id) AS final FROM (
 SELECT *, max(CASE WHEN sel AND {column} = '{value}' THEN 1 ELSE 0 END) OVER (PARTITION BY profile_id) AS have, min(CASE WHEN NOT sel AND {column} = '{value}' THEN sort_position END) OVER (PARTITION BY profile_id) AS best,
 sum(CASE WHEN sel THEN 1 ELSE 0 END) OVER (PARTITION BY profile_id) AS n_sel, sum(CASE WHEN sel THEN 1 ELSE 0 END) OVER (PARTITION BY profile_id, {column}) AS peers FROM ({src})))"""


def _balanced_sql() -> str:
    sql = f"""SELECT *, max(CASE WHEN sel AND rank_type_used = 'JEE_ADVANCED' THEN 1 ELSE 0 END) OVER (PARTITION BY profile_id) = 0 AS miss0,
 max(CASE WHEN sel AND rank_type_used = 'JEE_MAIN' THEN 1 ELSE 0 END) OVER (PARTITION BY profile_id) = 0 AS miss1 FROM (
 SELECT *, CASE WHEN sort_mode <> 'best_fit' THEN sort_position <= top_n ELSE head OR fill <= top_n - n_head END AS sel,
 CASE WHEN head THEN CASE recommendation_bucket WHEN 'safe_backup' THEN 0 WHEN 'best_realistic' THEN 1 ELSE 2 END ELSE 3 END * 1000000 + sort_position AS ord FROM ({_MARKED}))"""
    for step, (column, value, wanted) in enumerate((("rank_type_used", "JEE_ADVANCED", "miss0"), ("rank_type_used", "JEE_MAIN", "miss1"),
                                                     ("recommendation_bucket", "safe_backup", "true"), ("recommendation_bucket", "best_realistic", "true"), ("recommendation_bucket", "ambitious_reach", "true"))):
        sql = _swap_sql(sql, column, value, step, wanted)
    return f"SELECT *, row_number() OVER (PARTITION BY profile_id ORDER BY sort_position) AS position FROM ({sql}) WHERE sel"


@query("K5_balanced_selection", f"SELECT profile_id, choice_id, position, sort_mode, recommendation_bucket, rank_type_used, recommendation_score FROM ({_balanced_sql()})", ("ordered",))
def _(spark, sf):
    return chosen(spark, sf).select(*_PER, "position", "sort_mode", "recommendation_bucket", "rank_type_used", "recommendation_score")


@query("K5_scaled_quotas", f"SELECT top_n, {_QUOTA(0)} AS safe_backup, {_QUOTA(1)} AS best_realistic, {_QUOTA(2)} AS ambitious_reach FROM (SELECT CAST(c_custkey % 201 AS INTEGER) AS top_n FROM customer)")
def _(spark, sf):
    n = (F.col("c_custkey") % 201).cast("int")
    return d.read(spark, sf, "customer").select(n.alias("top_n")).select(
        "top_n", *[as_long(recommend.scaled_quota(b, F.col("top_n"))).alias(b) for b in recommend.BUCKET_QUOTAS])


_PLAIN = "SELECT *, row_number() OVER (PARTITION BY profile_id ORDER BY sort_position) AS position FROM ordered WHERE sort_mode <> 'best_fit' AND sort_position <= top_n"


@query("K7_mode_heads", f"SELECT profile_id, choice_id, position FROM ({_PLAIN})", ("ordered",))
def _(spark, sf):
    return chosen(spark, sf).where(F.col("sort_mode") != "best_fit").select(*_PER, "position")


_HEADS = _balanced_sql()
_NAME = "institute || ' — ' || program"
_SUMMARY = f"""SELECT p.profile_id, coalesce(n, 0) AS total_options, coalesce(s, 0) AS safe_count, coalesce(t, 0) AS moderate_count, coalesce(a, 0) AS ambitious_count,
 coalesce(fs, fany, '—') AS safest_choice, coalesce(fr, 'No realistic reach found') AS top_upgrade, fr AS most_ambitious,
 CAST(round_even(main_rank * 0.60e0, 0) AS BIGINT) AS main_reach_low, CAST(round_even(main_rank * 1.05e0, 0) AS BIGINT) AS main_reach_high,
 CAST(round_even(advanced_rank * 0.60e0, 0) AS BIGINT) AS advanced_reach_low, CAST(round_even(advanced_rank * 1.05e0, 0) AS BIGINT) AS advanced_reach_high
 FROM profiles p LEFT JOIN (SELECT profile_id, count(*) AS n, count(*) FILTER (recommendation_bucket = 'safe_backup') AS s, count(*) FILTER (recommendation_bucket = 'best_realistic') AS t,
 count(*) FILTER (recommendation_bucket = 'ambitious_reach') AS a, arg_min({_NAME}, position) FILTER (recommendation_bucket = 'safe_backup') AS fs, arg_min({_NAME}, position) FILTER (recommendation_bucket = 'ambitious_reach') AS fr,
 arg_min({_NAME}, position) AS fany FROM ({_HEADS}) GROUP BY profile_id) c ON p.profile_id = c.profile_id"""


@query("A26_response_summary", _SUMMARY, ("profiles", "ordered"))
def _(spark, sf):
    return recommend.response_summary(d.profiles(spark, sf), chosen(spark, sf))


_TH = lambda x: f"format('{{:,}}', {x})"
_PCT1 = "printf('%.1f', round_even(admission_probability * 100, 1))"
_SENTENCE = f"""CASE WHEN confidence_label = 'Safe' THEN {_NAME} || ' is a Safe choice. The predicted closing rank (' || {_TH('predicted_closing_rank')} || ') is ' || {_TH('abs(margin)')} || ' places beyond your rank; the model''s uncalibrated admission-likelihood estimate is ' || {_PCT1} || '% based on simulated closing cutoffs, not individual outcomes.'
 WHEN confidence_label = 'Moderate' AND margin > 0 THEN {_NAME} || ' is a Moderate choice. Your rank is within ' || {_TH('abs(margin)')} || ' ranks of the predicted cutoff (' || {_TH('predicted_closing_rank')} || '), and the model''s uncalibrated admission-likelihood estimate is ' || {_PCT1} || '% from simulated closing cutoffs; the actual cutoff remains uncertain.'
 WHEN confidence_label = 'Moderate' THEN {_NAME} || ' is a Moderate choice. Your rank is ' || {_TH('abs(margin)')} || ' places outside the predicted cutoff (' || {_TH('predicted_closing_rank')} || '); the model''s uncalibrated admission-likelihood estimate is ' || {_PCT1} || '% from simulated closing cutoffs, not individual outcomes.'
 ELSE {_NAME} || ' is an Ambitious reach. The predicted cutoff (' || {_TH('predicted_closing_rank')} || ') is ' || {_TH('abs(margin)')} || ' ranks tighter than your rank; the model''s uncalibrated admission-likelihood estimate is ' || {_PCT1} || '% from simulated closing cutoffs, not an individual admission probability.' END"""


def _explained(rows):
    return rows.withColumn("explanation", text.explanation(
        F.col("institute"), F.col("program"), F.col("predicted_closing_rank"), F.col("rank_used"), F.col("admission_probability"), F.col("confidence_label")))


@query("F12_explanations", f"SELECT profile_id, choice_id, {_SENTENCE} AS explanation FROM parts_", ("parts_",))
def _(spark, sf):
    return _explained(scored(spark, sf)).select(*_PER, "explanation")


@query("V6_grounding_check", "SELECT true AS margin_ok, true AS rank_ok, true AS text_ok, count(*) AS rows FROM ordered", ("ordered",))
def _(spark, sf):
    rows = recommend.order_candidates(scored(spark, sf))
    return recommend.grounding_check(_explained(rows)).groupBy("margin_ok", "rank_ok", "text_ok").agg(F.count(F.lit(1)).alias("rows"))


@query("K9_best_per_bucket", """SELECT profile_id, recommendation_bucket, choice_id, recommendation_score FROM (SELECT *, row_number() OVER (PARTITION BY profile_id, recommendation_bucket ORDER BY recommendation_score DESC, choice_id) AS rn FROM scored) WHERE rn = 1""", ("scored",))
def _(spark, sf):
    return recommend.best_per_bucket(scored(spark, sf)).select("profile_id", "recommendation_bucket", "choice_id", "recommendation_score")


def _view(spark, sf):
    return scored(spark, sf).withColumn("probability_percent", scoring.decimals(F.col("admission_probability") * 100, 1, even=True))


@query("P12_F14_view_filter", """SELECT profile_id, choice_id FROM parts_ WHERE institute_type = 'NIT' AND recommendation_bucket = 'best_realistic' AND (contains(lower(institute), 'engineering') OR contains(lower(program), 'engineering'))""", ("parts_",))
def _(spark, sf):
    return recommend.view_filter(_view(spark, sf), kind="NIT", bucket="best_realistic", query=" Engineering ").select(*_PER)


@query("P12_literal_keyword", "SELECT profile_id, choice_id FROM parts_ WHERE contains(institute, '[') OR contains(program, '[')", ("parts_",))
def _(spark, sf):
    return recommend.view_filter(_view(spark, sf), query="[").select(*_PER)


_VIEW_SQL = {
    "best_fit": "coalesce(recommendation_score, pp, 0) DESC, predicted_closing_rank, pp DESC", "highest_probability": "pp DESC", "most_competitive": "predicted_closing_rank",
    "safest_backup": "coalesce(safety_score, pp) DESC, pp DESC, predicted_closing_rank DESC", "institute_name": "institute, program", "branch_name": "program, institute"}


def _register_view(mode: str) -> None:
    @query(f"K8_view_{mode}", f"""SELECT profile_id, choice_id, row_number() OVER (PARTITION BY profile_id ORDER BY {_VIEW_SQL[mode]}, choice_id) AS place FROM (
     SELECT *, round_even(admission_probability * 100, 1) AS pp FROM scored)""", ("scored",))
    def _(spark, sf):
        w = Window.partitionBy("profile_id").orderBy(*recommend.view_order(mode))
        return _view(spark, sf).select(*_PER, F.row_number().over(w).alias("place"))


for _mode in _VIEW_SQL:
    _register_view(_mode)


@query("M11_A37_view_tiers", """SELECT profile_id, CASE recommendation_bucket WHEN 'safe_backup' THEN 'safe' WHEN 'best_realistic' THEN 'target' WHEN 'ambitious_reach' THEN 'reach'
 ELSE CASE WHEN pp >= 70 THEN 'safe' WHEN pp >= 35 THEN 'target' ELSE 'reach' END END AS tier, count(*) AS rows FROM (SELECT *, round_even(admission_probability * 100, 1) AS pp FROM parts_) GROUP BY ALL""", ("parts_",))
def _(spark, sf):
    tier = scoring.view_tier(F.col("recommendation_bucket"), F.col("confidence_label"), F.col("probability_percent"))
    return _view(spark, sf).select("profile_id", tier.alias("tier")).groupBy("profile_id", "tier").agg(F.count(F.lit(1)).alias("rows"))


@query("M11_view_fallbacks", """SELECT DISTINCT c_custkey % 101 AS percent, CASE WHEN c_custkey % 2 = 0 THEN 'Safe' END AS label, CASE WHEN c_custkey % 2 = 0 THEN 'safe_backup' WHEN c_custkey % 101 >= 70 THEN 'safe_backup' WHEN c_custkey % 101 >= 35 THEN 'best_realistic' ELSE 'ambitious_reach' END AS bucket FROM customer""")
def _(spark, sf):
    k = F.col("c_custkey")
    label = F.when(k % 2 == 0, "Safe")
    return d.read(spark, sf, "customer").select(
        (k % 101).alias("percent"), label.alias("label"), scoring.view_bucket(F.lit(""), label, k % 101).alias("bucket")).distinct()


@query("F13_display_names", "SELECT DISTINCT institute || ' — ' || program AS name FROM observed_b", ("observed_b",))
def _(spark, sf):
    return d.observed(spark, sf, "brand").select(text.display_name(F.col("institute"), F.col("program")).alias("name")).distinct()


@query("J13_saved_choices", """SELECT s.profile_id, s.choice_id, s.pos AS saved_position, r.recommendation_bucket FROM (
 SELECT profile_id, unnest(ids) AS choice_id, CAST(unnest(range(len(ids))) AS INTEGER) AS pos FROM (SELECT profile_id, list_append(list(choice_id ORDER BY sort_position DESC), 'gone') AS ids FROM ordered WHERE sort_position <= 3 GROUP BY 1)) s
 JOIN ordered r ON s.profile_id = r.profile_id AND s.choice_id = r.choice_id""", ("ordered",))
def _(spark, sf):
    ordered = recommend.order_candidates(scored(spark, sf))
    ids = F.transform(F.sort_array(F.collect_list(F.struct("sort_position", "choice_id")), asc=False), lambda s: s["choice_id"])
    saved = ordered.where(F.col("sort_position") <= 3).groupBy("profile_id").agg(F.concat(ids, F.array(F.lit("gone"))).alias("saved_ids"))
    return recommend.saved_in_order(saved, ordered.select(*_PER, "recommendation_bucket"))


_NC = lambda x: f"trim(regexp_replace({x}, '\\s+', ' ', 'g'))"
_LINE = f"""position || '. **' || institute || '** - ' || program || ' [' || confidence_label || '] | ' || printf('%.1f', round_even(admission_probability * 100, 1)) || '% uncalibrated admission-likelihood estimate | Predicted cutoff: ' || {_TH('predicted_closing_rank')}
 || ' | 90% prediction interval: [' || {_TH('CAST(greatest(1, floor(predicted_closing_rank - uncertainty_radius)) AS BIGINT)')} || '-' || {_TH('CAST(greatest(1, ceil(predicted_closing_rank + uncertainty_radius)) AS BIGINT)')} || ']'
 || ' | Safety margin: ' || CASE WHEN margin >= 0 THEN '+' ELSE '' END || {_TH('margin')} || ' | Rank used: ' || {_TH('rank_used')} || ' (' || rank_type_used || ')' || ' | Heuristic recommendation score: ' || printf('%.1f', round_even(recommendation_score, 1)) || ' | Quota: ' || quota"""


@query("R7_context_block", f"""SELECT s.profile_id, '## Student Recommendation Context' || chr(10) || '- **Total returned options:** ' || total_options || chr(10) || '- **Safe choices:** ' || safe_count || chr(10) || '- **Target choices:** ' || moderate_count || chr(10) || '- **Reach choices:** ' || ambitious_count || chr(10)
 || '- **Top safe pick:** ' || safest_choice || chr(10) || '- **Best upgrade pick:** ' || CASE WHEN ambitious_count > 0 THEN top_upgrade ELSE 'No realistic reach found' END || chr(10) || '- **Most ambitious pick:** ' || CASE WHEN ambitious_count > 0 THEN most_ambitious ELSE 'No realistic reach found' END || chr(10)
 || '### Top Recommendations' || coalesce(chr(10) || lines, '') AS context FROM ({_SUMMARY}) s LEFT JOIN (SELECT profile_id, string_agg({_LINE}, chr(10) ORDER BY position) AS lines FROM ({_HEADS}) WHERE position <= 10 GROUP BY 1) l ON s.profile_id = l.profile_id""", ("profiles", "ordered"))
def _(spark, sf):
    return recommend.context_block(d.profiles(spark, sf), chosen(spark, sf))
