"""Distribution, error-analysis and agreement queries."""

from __future__ import annotations

from pyspark.sql import Window, functions as F

from cutline.functions import scoring
from cutline.operators import diagnostics as dg, evaluation as ev, panel
from cutline.operators.quantiles import exact_median, exact_percentiles
from cutline.plans.oracle_tables import BRANCH, OUTCOME
from cutline.plans.registry import as_long, cte, query, rounded
from cutline.schemas import BRANCH_KEY, OUTCOME_KEY
from cutline.sources import driver_tables as d


def _table(spark, sf):
    return d.observed(spark, sf)


def _naive(spark, sf):
    errors = ev.matched_errors(ev.rolling_forecasts(_table(spark, sf)), d.ORIGIN_START, d.FINAL_YEAR)
    return errors.where(F.col("model") == ev.LAST)


cte("naive", "SELECT * FROM errors WHERE model = 'naive_last_year'", ("errors",))
cte("trimmed", """SELECT residual FROM naive WHERE residual BETWEEN (SELECT quantile_cont(residual, 0.01) FROM naive) AND (SELECT quantile_cont(residual, 0.99) FROM naive)""", ("naive",))
cte("worst", f"SELECT * FROM naive ORDER BY abs_residual DESC, origin, {OUTCOME} LIMIT 100", ("naive",))


@query("A12_numeric_summary", " UNION ALL ".join(f"""SELECT '{c}' AS "column", count(v) AS n, round(avg(v), 6) AS mean, round(stddev_samp(v), 6) AS std, CAST(min(v) AS DOUBLE) AS low, CAST(max(v) AS DOUBLE) AS high,
 round(quantile_cont(v, 0.25), 6) AS q25, round(median(v), 6) AS median, round(quantile_cont(v, 0.75), 6) AS q75 FROM (SELECT {e} AS v FROM observed)""" for c, e in
 (("closing_rank", "closing_rank"), ("opening_rank", "opening_rank"), ("rank_spread", "closing_rank - opening_rank"))), ("observed",))
def _(spark, sf):
    wide = _table(spark, sf).withColumn("rank_spread", F.col("closing_rank") - F.col("opening_rank"))
    long = wide.select(F.explode(F.array(*[
        F.struct(F.lit(c).alias("column"), F.col(c).cast("double").alias("v")) for c in ("closing_rank", "opening_rank", "rank_spread")])).alias("s")).select("s.*")
    quart = exact_percentiles(long, ["column"], "v", {"q25": 0.25, "median": 0.5, "q75": 0.75})
    rest = long.groupBy("column").agg(F.avg("v").alias("mean"), F.stddev_samp("v").alias("std"), F.min("v").alias("low"), F.max("v").alias("high"))
    return rounded(quart.join(F.broadcast(rest), "column"))


@query("A12_distinct_counts", " UNION ALL ".join(
    f"SELECT '{c}' AS \"column\", count(DISTINCT {c}) AS distinct_values FROM observed" for c in ("institute", "program", "category", "institute_type", "quota", "gender", "year", "round")), ("observed",))
def _(spark, sf):
    from cutline.operators.quality import column_profile

    return column_profile(_table(spark, sf), ["institute", "program", "category", "institute_type", "quota", "gender", "year", "round"]).select("column", "distinct_values")


@query("A13_value_distribution", " UNION ALL ".join(
    f"SELECT '{c}' AS \"column\", CAST({c} AS VARCHAR) AS value, count(*) AS rows, round(100e0 * count(*) / sum(count(*)) OVER (), 6) AS percent FROM observed GROUP BY {c}" for c in ("category", "institute_type", "year")), ("observed",))
def _(spark, sf):
    return rounded(dg.distribution(_table(spark, sf), ["category", "institute_type", "year"]))


_VOL = f"""SELECT {BRANCH}, avg(closing_rank) AS mean_rank, stddev_samp(closing_rank) AS std_rank, count(closing_rank) AS n_years, stddev_samp(closing_rank) / avg(closing_rank) AS cv FROM (
 SELECT *, row_number() OVER (PARTITION BY year, {BRANCH} ORDER BY round DESC) AS rn FROM observed) WHERE rn = 1 GROUP BY {BRANCH} HAVING count(closing_rank) >= 3"""


def _volatility(spark, sf):
    return dg.volatility(panel.final_rounds(_table(spark, sf), BRANCH_KEY, ["opening_rank"]), BRANCH_KEY)


@query("A14_volatility", f"SELECT {BRANCH}, round(mean_rank, 6) AS mean_rank, round(std_rank, 6) AS std_rank, n_years, round(cv, 6) AS cv FROM ({_VOL})", ("observed",))
def _(spark, sf):
    return rounded(_volatility(spark, sf))


@query("K4_most_volatile", f"SELECT institute, program, category, gender, quota, is_pwd, round(cv, 6) AS cv FROM ({_VOL}) ORDER BY cv DESC, institute, program, category, gender, quota, is_pwd LIMIT 10", ("observed",))
def _(spark, sf):
    top = _volatility(spark, sf).orderBy(F.col("cv").desc(), "institute", "program", "category", "gender", "quota", "is_pwd").limit(10)
    return rounded(top.select("institute", "program", "category", "gender", "quota", "is_pwd", "cv"))


@query("K4_most_stable", f"SELECT institute, program, category, gender, quota, is_pwd, round(cv, 6) AS cv FROM ({_VOL}) ORDER BY cv, institute, program, category, gender, quota, is_pwd LIMIT 10", ("observed",))
def _(spark, sf):
    top = _volatility(spark, sf).orderBy("cv", "institute", "program", "category", "gender", "quota", "is_pwd").limit(10)
    return rounded(top.select("institute", "program", "category", "gender", "quota", "is_pwd", "cv"))


@query("K4_top_institutes", "SELECT institute, count(*) AS rows FROM observed GROUP BY 1 ORDER BY rows DESC, institute LIMIT 15", ("observed",))
def _(spark, sf):
    return dg.top_values(_table(spark, sf), "institute", 15)


@query("P11_A18_mainstream_box_by_year", """SELECT year, count(*) AS n, round(quantile_cont(closing_rank, 0.25), 6) AS q25, round(median(closing_rank), 6) AS median, round(quantile_cont(closing_rank, 0.75), 6) AS q75,
 min(closing_rank) AS low, max(closing_rank) AS high, round(avg(closing_rank), 6) AS mean FROM observed WHERE NOT is_pwd AND gender = 'Gender-Neutral' AND quota = 'AI' GROUP BY year""", ("observed",))
def _(spark, sf):
    rows = _table(spark, sf).where(~F.col("is_pwd") & (F.col("gender") == "Gender-Neutral") & (F.col("quota") == "AI"))
    return rounded(dg.box_statistics(rows, ["year"], "closing_rank"))


def _register_box(column: str) -> None:
    @query(f"A18_box_by_{column}", f"""SELECT {column}, count(*) AS n, round(quantile_cont(closing_rank, 0.25), 6) AS q25, round(median(closing_rank), 6) AS median, round(quantile_cont(closing_rank, 0.75), 6) AS q75,
     min(closing_rank) AS low, max(closing_rank) AS high, round(avg(closing_rank), 6) AS mean FROM observed GROUP BY {column}""", ("observed",))
    def _(spark, sf):
        return rounded(dg.box_statistics(_table(spark, sf), [column], "closing_rank"))


for _c in ("round", "category", "institute_type"):
    _register_box(_c)


@query("A15_round_heatmap", """SELECT year, """ + ", ".join(f'round(median(closing_rank) FILTER (round = {r}), 6) AS round_{r}' for r in (1, 2, 3, 4)) + " FROM observed GROUP BY year", ("observed",))
def _(spark, sf):
    med = exact_median(_table(spark, sf), ["year", "round"], "closing_rank", "m")
    return rounded(med.groupBy("year").agg(*[F.max(F.when(F.col("round") == r, F.col("m"))).alias(f"round_{r}") for r in (1, 2, 3, 4)]))


_NUMERIC = ["year", "round", "duration_years", "opening_rank", "closing_rank", "prev_round_closing_rank"]


cte("shaped", """SELECT *, lag(closing_rank) OVER (PARTITION BY year, institute, program, category, quota, gender, is_pwd ORDER BY round) AS prev_round_closing_rank FROM observed""", ("observed",))


@query("A16_correlation_matrix", " UNION ALL ".join(
    f"SELECT '{a}' AS a, '{b}' AS b, round(corr({a}, {b}), 6) AS r FROM shaped" for i, a in enumerate(_NUMERIC) for b in _NUMERIC[i + 1:]), ("shaped",))
def _(spark, sf):
    return rounded(dg.correlation_pairs(panel.previous_round(_table(spark, sf)), _NUMERIC))


@query("A17_histogram", """SELECT least(CAST(floor((closing_rank - lo) / CAST(hi - lo AS DOUBLE) * 100) AS BIGINT), 99) AS bin, count(*) AS rows, CAST(lo AS DOUBLE) AS range_low, CAST(hi AS DOUBLE) AS range_high
 FROM observed CROSS JOIN (SELECT min(closing_rank) AS lo, max(closing_rank) AS hi FROM observed) GROUP BY ALL""", ("observed",))
def _(spark, sf):
    return dg.histogram(_table(spark, sf), [], "closing_rank", 100)


@query("P14_trimmed_residuals", """SELECT least(CAST(floor((residual - lo) / (hi - lo) * 60) AS BIGINT), 59) AS bin, count(*) AS rows FROM trimmed CROSS JOIN (SELECT min(residual) AS lo, max(residual) AS hi FROM trimmed) GROUP BY ALL""", ("trimmed",))
def _(spark, sf):
    return dg.histogram(dg.trim_central(_naive(spark, sf), "residual"), [], "residual", 60).select("bin", "rows")




@query("P14_clipped_residuals", f"""SELECT origin, {OUTCOME}, round(greatest(lo, least(hi, residual)), 6) AS clipped FROM naive CROSS JOIN (SELECT quantile_cont(residual, 0.01) AS lo, quantile_cont(residual, 0.99) AS hi FROM naive)""", ("naive",))
def _(spark, sf):
    return rounded(dg.clip_central(_naive(spark, sf), "residual", "clipped").select("origin", *OUTCOME_KEY, "clipped"))


_BY = lambda keys: f"""SELECT {keys}, round(avg(abs_residual), 6) AS mae, count(*) AS count, round(avg(actual_closing_rank), 6) AS mean_rank, round(sqrt(avg(residual * residual)), 6) AS rmse, round(median(abs_residual), 6) AS medae FROM naive GROUP BY {keys}"""


@query("A19_error_by_category", _BY("category"), ("naive",))
def _(spark, sf):
    return rounded(dg.group_errors(_naive(spark, sf), ["category"]))


@query("A19_error_by_type_and_round", _BY("institute_type, round"), ("naive",))
def _(spark, sf):
    return rounded(dg.group_errors(_naive(spark, sf), ["institute_type", "round"]))


@query("A20_M24_percent_error", """SELECT origin, round(avg(CASE WHEN actual_closing_rank > 0 THEN abs_residual / actual_closing_rank * 100 END), 6) AS mape, round(max(abs_residual / actual_closing_rank * 100), 6) AS worst FROM naive GROUP BY origin""", ("naive",))
def _(spark, sf):
    return rounded(dg.absolute_percent_error(_naive(spark, sf)).groupBy("origin").agg(
        F.avg("percent_error").alias("mape"), F.max("percent_error").alias("worst")))


cte("spread_", "SELECT n.*, coalesce(s.sd, 150e0) AS std_dev FROM naive n LEFT JOIN (SELECT institute_type, round, greatest(stddev_samp(residual), 100e0) AS sd FROM naive GROUP BY ALL) s ON n.institute_type = s.institute_type AND n.round = s.round", ("naive",))


def _with_spread(spark, sf):
    errors = _naive(spark, sf)
    spread = ev.residual_spread(errors)
    return errors.join(F.broadcast(spread), ["institute_type", "round"], "left").withColumn("std_dev", F.coalesce("std_dev", F.lit(scoring.DEFAULT_STD)))


@query("A22_group_fairness", """SELECT category, count(*) AS count, round(avg(abs_residual), 6) AS mae, round(sqrt(avg(residual * residual)), 6) AS rmse, round(avg(std_dev) * 2 * 1.645e0, 6) AS mean_width FROM spread_ GROUP BY category""", ("spread_",))
def _(spark, sf):
    return rounded(_with_spread(spark, sf).groupBy("category").agg(
        F.count(F.lit(1)).alias("count"), F.avg("abs_residual").alias("mae"), F.sqrt(F.avg(F.col("residual") * F.col("residual"))).alias("rmse"),
        (F.avg("std_dev") * 2 * 1.645).alias("mean_width")))


@query("A23_failure_concentration", " UNION ALL ".join(f"""SELECT * FROM (SELECT '{c}' AS dimension, CAST({c} AS VARCHAR) AS value, count(*) AS rows, row_number() OVER (ORDER BY count(*) DESC, CAST({c} AS VARCHAR)) AS place FROM worst GROUP BY {c}) WHERE place <= 5"""
    for c in ("institute_type", "category", "round")), ("worst",))
def _(spark, sf):
    return dg.failure_concentration(_naive(spark, sf), ["institute_type", "category", "round"], ["origin", *OUTCOME_KEY])




@query("K4_largest_errors", f"SELECT origin, {OUTCOME}, abs_residual FROM worst", ("worst",))
def _(spark, sf):
    return _naive(spark, sf).orderBy(F.col("abs_residual").desc(), "origin", *OUTCOME_KEY).limit(100).select("origin", *OUTCOME_KEY, "abs_residual")


@query("A24_width_error_correlation", "SELECT round(corr(std_dev * 2 * 1.96e0, abs_residual), 6) AS r, count(*) AS n FROM spread_", ("spread_",))
def _(spark, sf):
    return rounded(_with_spread(spark, sf).agg(F.corr(F.col("std_dev") * 2 * 1.96, F.col("abs_residual")).alias("r"), F.count(F.lit(1)).alias("n")))


_AVG_RANK = "rank() OVER (PARTITION BY {k} ORDER BY {v} DESC) + (count(*) OVER (PARTITION BY {k}, {v}) - 1) / 2e0"


@query("W7_average_rank", f"""SELECT origin, {OUTCOME}, {_AVG_RANK.format(k='origin', v='last_closing_rank')} AS place FROM forecasts WHERE actual_closing_rank IS NOT NULL""", ("forecasts",))
def _(spark, sf):
    rows = ev.rolling_forecasts(_table(spark, sf)).where(F.col("actual_closing_rank").isNotNull())
    return dg.add_average_rank(rows, ["origin"], "last_closing_rank", "place").select("origin", *OUTCOME_KEY, "place")


@query("M26_spearman", f"""SELECT origin, count(*) AS n, round(corr(a, b), 6) AS spearman FROM (SELECT origin, {_AVG_RANK.format(k='origin', v='last_closing_rank')} AS a, {_AVG_RANK.format(k='origin', v='actual_closing_rank')} AS b
 FROM forecasts WHERE actual_closing_rank IS NOT NULL) GROUP BY origin""", ("forecasts",))
def _(spark, sf):
    rows = ev.rolling_forecasts(_table(spark, sf)).where(F.col("actual_closing_rank").isNotNull())
    return rounded(dg.spearman(rows, ["origin"], "last_closing_rank", "actual_closing_rank"))


cte("paired_rows", "SELECT origin, last_closing_rank AS a, actual_closing_rank AS b, row_number() OVER () AS i FROM forecasts WHERE actual_closing_rank IS NOT NULL", ("forecasts",))


@query("M26_kendall_season", """SELECT origin, round((c - dd) / (sqrt(CAST(n AS DOUBLE) - tx) * sqrt(CAST(n AS DOUBLE) - ty)), 6) AS kendall FROM (
 SELECT x.origin, count(*) AS n, count(*) FILTER (sign(x.a - y.a) * sign(x.b - y.b) > 0) AS c, count(*) FILTER (sign(x.a - y.a) * sign(x.b - y.b) < 0) AS dd, count(*) FILTER (x.a = y.a) AS tx, count(*) FILTER (x.b = y.b) AS ty
 FROM paired_rows x JOIN paired_rows y ON x.origin = y.origin AND x.i < y.i GROUP BY x.origin)""", ("paired_rows",))
def _(spark, sf):
    """Whole seasons, each one group."""
    rows = ev.rolling_forecasts(_table(spark, sf)).where(F.col("actual_closing_rank").isNotNull())
    return rounded(dg.kendall(rows, ["origin"], "last_closing_rank", "actual_closing_rank"))


@query("M26_wilcoxon", """SELECT origin, count(*) AS n_pairs, sum(CASE WHEN d > 0 THEN r ELSE 0e0 END) AS w_plus, sum(CASE WHEN d < 0 THEN r ELSE 0e0 END) AS w_minus, least(sum(CASE WHEN d > 0 THEN r ELSE 0e0 END), sum(CASE WHEN d < 0 THEN r ELSE 0e0 END)) AS statistic FROM (
 SELECT origin, d, rank() OVER (PARTITION BY origin ORDER BY abs(d)) + (count(*) OVER (PARTITION BY origin, abs(d)) - 1) / 2e0 AS r FROM (SELECT origin, last_closing_rank - actual_closing_rank AS d FROM forecasts) WHERE d <> 0) GROUP BY origin""", ("forecasts",))
def _(spark, sf):
    rows = ev.rolling_forecasts(_table(spark, sf)).where(F.col("actual_closing_rank").isNotNull())
    return dg.wilcoxon(rows, ["origin"], "last_closing_rank", "actual_closing_rank")


@query("A21_classification_metrics", """SELECT origin, n, tp, fp, fn, tn, round((tp + tn) / CAST(n AS DOUBLE), 6) AS accuracy, round(coalesce(p, 0e0), 6) AS precision, round(coalesce(r, 0e0), 6) AS recall, round(coalesce(2 * p * r / nullif(p + r, 0), 0e0), 6) AS f1,
 round((s - (tp + fn) * (tp + fn + 1) / 2e0) / nullif(CAST(tp + fn AS DOUBLE) * (fp + tn), 0), 6) AS roc_auc FROM (SELECT *, tp / nullif(CAST(tp + fp AS DOUBLE), 0) AS p, tp / nullif(CAST(tp + fn AS DOUBLE), 0) AS r FROM (
 SELECT origin, count(*) AS n, count(*) FILTER (y AND q) AS tp, count(*) FILTER (NOT y AND q) AS fp, count(*) FILTER (y AND NOT q) AS fn, count(*) FILTER (NOT y AND NOT q) AS tn, sum(CASE WHEN y THEN k ELSE 0e0 END) AS s FROM (
 SELECT origin, actual_closing_rank <= hist_mean_closing_rank AS y, last_closing_rank > hist_mean_closing_rank AS q, rank() OVER (PARTITION BY origin ORDER BY last_closing_rank) + (count(*) OVER (PARTITION BY origin, last_closing_rank) - 1) / 2e0 AS k
 FROM forecasts WHERE actual_closing_rank IS NOT NULL) GROUP BY origin))""", ("forecasts",))
def _(spark, sf):
    rows = ev.rolling_forecasts(_table(spark, sf)).where(F.col("actual_closing_rank").isNotNull()).select(
        "origin", "last_closing_rank", (F.col("actual_closing_rank") <= F.col("hist_mean_closing_rank")).cast("int").alias("y"),
        (F.col("last_closing_rank") > F.col("hist_mean_closing_rank")).cast("int").alias("q"))
    return rounded(dg.classification_metrics(rows, ["origin"], "y", "q", "last_closing_rank"))


@query("M20_difficulty_label", f"""SELECT o.year, {", ".join("o." + c.strip() for c in OUTCOME.split(","))}, CASE WHEN o.closing_rank <= coalesce(h, m) THEN 1 ELSE 0 END AS cutoff_difficulty FROM (
 SELECT *, avg(closing_rank) OVER (PARTITION BY {OUTCOME} ORDER BY year ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS h FROM observed) o CROSS JOIN (SELECT median(closing_rank) AS m FROM observed WHERE year <= 1999)""", ("observed",))
def _(spark, sf):
    from cutline.operators.learning import with_difficulty

    rows = panel.prior_year_statistics(_table(spark, sf))
    return with_difficulty(rows, rows.where(F.col("year") <= 1999)).select("year", *OUTCOME_KEY, "cutoff_difficulty")


_TOP = lambda order: f"(SELECT category, program || '|' || institute AS item FROM (SELECT *, row_number() OVER (PARTITION BY category ORDER BY {order}, {OUTCOME}) AS rn FROM observed_b WHERE year = 2001) WHERE rn <= 50)"


@query("X9_jaccard_overlap", f"""SELECT category, count(*) FILTER (a AND b) AS shared, count(*) AS "all", round(count(*) FILTER (a AND b) / CAST(count(*) AS DOUBLE), 6) AS jaccard FROM (SELECT DISTINCT category, item, true AS a FROM {_TOP('closing_rank DESC')})
 FULL JOIN (SELECT DISTINCT category, item, true AS b FROM {_TOP('opening_rank DESC')}) USING (category, item) GROUP BY category""", ("observed_b",))
def _(spark, sf):
    rows = d.observed(spark, sf, "brand").where(F.col("year") == 2001)
    item = F.concat_ws("|", "program", "institute").alias("item")
    top = lambda c: rows.withColumn("rn", F.row_number().over(Window.partitionBy("category").orderBy(F.col(c).desc(), *OUTCOME_KEY))).where(
        "rn <= 50").select("category", item)
    return rounded(dg.jaccard(top("closing_rank"), top("opening_rank"), ["category"], "item"))


@query("P13_deterministic_sample", f"""SELECT year, {OUTCOME}, closing_rank FROM observed
 ORDER BY CAST('0x' || substr(md5(concat_ws('|', year, {OUTCOME}, '42')), 1, 15) AS BIGINT), year, {OUTCOME} LIMIT 20000""", ("observed",))
def _(spark, sf):
    # the sample size is the operator's argument: plots take at most that many rows
    return dg.threshold_sample(_table(spark, sf), ["year", *OUTCOME_KEY], 20_000).select("year", *OUTCOME_KEY, "closing_rank")


# --- rank perturbation: slices of the bounded brand catalogue, base rank 10,000 -----------
_SLICE = ["category", "gender", "round"]
_BASE, _OFFSETS = 10_000, [-500, -250, 0, 250, 500]
_SD = 4000.0


def _perturbed(spark, sf):
    rows = d.observed(spark, sf, "brand").where((F.col("year") == 2001) & ~F.col("is_pwd")).select(
        *OUTCOME_KEY, F.col("closing_rank").alias("predicted"), F.explode(F.lit(_OFFSETS)).alias("offset"))
    rank = F.lit(_BASE) + F.col("offset")
    p = scoring.exceedance(F.col("predicted"), F.lit(_SD), rank)
    return rows.withColumn("score", F.round(scoring.legacy_score(p, F.col("predicted"), rank), 6))


def _against_base(spark, sf):
    scored = _perturbed(spark, sf)
    base = scored.where(F.col("offset") == 0).select(*OUTCOME_KEY, F.col("score").alias("base_score"))
    return scored.where(F.col("offset") != 0).join(base, OUTCOME_KEY)


cte("perturbed", f"""SELECT *, round(prob * 100 + (predicted - rnk) / CAST(predicted AS DOUBLE) * 20, 6) AS score FROM (SELECT {OUTCOME}, predicted, "offset", rnk, len(list_filter(zs, lambda z: predicted + z * {_SD}e0 >= rnk)) / 1000e0 AS prob FROM (
 SELECT *, closing_rank AS predicted, {_BASE} + "offset" AS rnk FROM observed_b CROSS JOIN (SELECT unnest({_OFFSETS}) AS "offset") WHERE year = 2001 AND NOT is_pwd) CROSS JOIN draws)""", ("observed_b", "draws"))
cte("against", f"""SELECT s.*, b.score AS base_score FROM perturbed s JOIN (SELECT * FROM perturbed WHERE "offset" = 0) b USING ({OUTCOME}) WHERE s."offset" <> 0""", ("perturbed",))


@query("M25_perturbation_spearman", f"""SELECT category, gender, round, "offset", count(*) AS n, round(corr(a, b), 6) AS spearman FROM (SELECT *, {_AVG_RANK.format(k='category, gender, round, "offset"', v='score')} AS a,
 {_AVG_RANK.format(k='category, gender, round, "offset"', v='base_score')} AS b FROM against) GROUP BY ALL""", ("against",))
def _(spark, sf):
    return rounded(dg.spearman(_against_base(spark, sf), [*_SLICE, "offset"], "score", "base_score"))


@query("M25_M26_perturbation_kendall", """SELECT category, gender, round, "offset", round((c - dd) / sqrt((CAST(n AS DOUBLE) - tx) * (CAST(n AS DOUBLE) - ty)), 6) AS kendall FROM (
 SELECT x.category, x.gender, x.round, x."offset", count(*) AS n, count(*) FILTER (sign(x.score - y.score) * sign(x.base_score - y.base_score) > 0) AS c, count(*) FILTER (sign(x.score - y.score) * sign(x.base_score - y.base_score) < 0) AS dd,
 count(*) FILTER (x.score = y.score) AS tx, count(*) FILTER (x.base_score = y.base_score) AS ty FROM (SELECT *, row_number() OVER () AS i FROM against) x JOIN (SELECT *, row_number() OVER () AS i FROM against) y
 ON x.category = y.category AND x.gender = y.gender AND x.round = y.round AND x."offset" = y."offset" AND (x.institute, x.program, x.quota) < (y.institute, y.program, y.quota) GROUP BY ALL)""", ("against",))
def _(spark, sf):
    return rounded(dg.kendall(_against_base(spark, sf), [*_SLICE, "offset"], "score", "base_score"))
