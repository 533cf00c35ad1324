"""Past-only panel, forecast frames, season shape and reshaping queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from cutline.functions.keys import null_safe_join
from cutline.operators import cleaning, panel, quality
from cutline.plans.oracle_tables import BRANCH, CHOICE, HISTORY, OUTCOME, same
from cutline.plans.registry import as_long, query, rounded
from cutline.schemas import BRANCH_KEY, CHOICE_KEY, HISTORY_KEY, OUTCOME_KEY
from cutline.sources import driver_tables as d

_PRIOR = f"""SELECT year, {OUTCOME}, count(*) OVER b AS hist_year_count, lag(closing_rank) OVER o AS last_closing_rank, lag(year) OVER o AS last_observed_year,
 year - lag(year) OVER o AS years_since_observed, round(avg(closing_rank) OVER b, 6) AS hist_mean_closing_rank, round(stddev_samp(closing_rank) OVER b, 6) AS hist_std_closing_rank
 FROM observed WINDOW o AS (PARTITION BY {OUTCOME} ORDER BY year), b AS (PARTITION BY {OUTCOME} ORDER BY year ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)"""
_PRIOR_COLUMNS = ["year", *OUTCOME_KEY, "hist_year_count", "last_closing_rank", "last_observed_year", "years_since_observed",
                  "hist_mean_closing_rank", "hist_std_closing_rank"]


@query("W1_prior_year_statistics", _PRIOR, ("observed",))
def _(spark, sf):
    return rounded(panel.prior_year_statistics(d.observed(spark, sf)).select(*_PRIOR_COLUMNS))


_EARLIER = lambda c: f"""(SELECT a.{c}, a.year, CAST(coalesce(sum(b.n), 0) AS BIGINT) AS n FROM (SELECT {c}, year FROM observed GROUP BY ALL) a
 LEFT JOIN (SELECT {c}, year, count(*) AS n FROM observed GROUP BY ALL) b ON a.{c} = b.{c} AND b.year < a.year GROUP BY ALL)"""


# plain counts of earlier years: a RANGE frame over tied years gave varying sums from run to run
# in the checking engine
@query("W2_J5_past_frequency", f"""SELECT o.year, {", ".join("o." + c.strip() for c in OUTCOME.split(","))}, i.n AS institute_freq, p.n AS program_freq FROM observed o
 JOIN {_EARLIER('institute')} i ON o.institute = i.institute AND o.year = i.year JOIN {_EARLIER('program')} p ON o.program = p.program AND o.year = p.year""", ("observed",))
def _(spark, sf):
    return panel.past_frequencies(d.observed(spark, sf)).select("year", *OUTCOME_KEY, "institute_freq", "program_freq")


@query("W3_previous_round", f"""SELECT year, {OUTCOME}, lag(closing_rank) OVER w AS prev_round_closing_rank, lag(round) OVER w AS prev_round_number
 FROM observed WINDOW w AS (PARTITION BY year, {CHOICE} ORDER BY round)""", ("observed",))
def _(spark, sf):
    return panel.previous_round(d.observed(spark, sf)).select("year", *OUTCOME_KEY, "prev_round_closing_rank", "prev_round_number")


_SHAPE = f"""SELECT year, {OUTCOME}, f AS final_round, CASE WHEN round = f THEN 1 ELSE 0 END AS is_final_round, rank_spread, round_progression,
 CASE WHEN round = f THEN closing_rank - lag(closing_rank) OVER (PARTITION BY {BRANCH}, round = f ORDER BY year) END AS closing_rank_yoy_change FROM (
 SELECT *, closing_rank - opening_rank AS rank_spread, max(round) OVER (PARTITION BY year, {BRANCH}) AS f,
 closing_rank - lag(closing_rank) OVER (PARTITION BY year, {BRANCH} ORDER BY round) AS round_progression FROM observed)"""


@query("W4_W5_W6_season_shape", _SHAPE, ("observed",))
def _(spark, sf):
    return panel.season_shape(d.observed(spark, sf)).select(
        "year", *OUTCOME_KEY, "final_round", "is_final_round", "rank_spread", "round_progression", "closing_rank_yoy_change")


_FINAL_H = f"""SELECT year, {HISTORY}, closing_rank AS r FROM (SELECT *, row_number() OVER (PARTITION BY year, {HISTORY} ORDER BY round DESC, is_pwd) AS rn FROM observed) WHERE rn = 1"""


@query("W8_history_by_branch", f"""SELECT o.year, {", ".join("o." + c.strip() for c in OUTCOME.split(","))}, m AS hist_mean_closing_rank, s AS hist_std_closing_rank, lo AS hist_min_closing_rank, hi AS hist_max_closing_rank, nullif(n, 0) AS hist_year_count
 FROM observed o JOIN (SELECT year, {HISTORY}, round(avg(r) OVER b, 6) AS m, round(stddev_samp(r) OVER b, 6) AS s, min(r) OVER b AS lo, max(r) OVER b AS hi, count(r) OVER b AS n FROM ({_FINAL_H})
 WINDOW b AS (PARTITION BY {HISTORY} ORDER BY year ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)) h ON o.year = h.year AND {same('o', 'h', HISTORY)}""", ("observed",))
def _(spark, sf):
    return rounded(panel.history_by_branch(d.observed(spark, sf)).select(
        "year", *OUTCOME_KEY, "hist_mean_closing_rank", "hist_std_closing_rank", "hist_min_closing_rank", "hist_max_closing_rank", "hist_year_count"))


@query("W8_static_history", f"""SELECT o.year, {", ".join("o." + c.strip() for c in OUTCOME.split(","))}, m AS hist_mean_closing_rank, n AS hist_year_count FROM observed o
 LEFT JOIN (SELECT {HISTORY}, round(avg(r), 6) AS m, count(r) AS n FROM ({_FINAL_H}) WHERE year < 2000 GROUP BY ALL) h ON {same('o', 'h', HISTORY)} WHERE o.year >= 2000""", ("observed",))
def _(spark, sf):
    table = d.observed(spark, sf)
    finals = panel.final_rounds(table.where(F.col("year") < 2000), HISTORY_KEY, ["is_pwd"])
    stats = finals.groupBy(*HISTORY_KEY).agg(
        F.avg("closing_rank").alias("hist_mean_closing_rank"), F.count("closing_rank").alias("hist_year_count"))
    out = null_safe_join(table.where(F.col("year") >= 2000), stats, HISTORY_KEY, "left")
    return rounded(out.select("year", *OUTCOME_KEY, "hist_mean_closing_rank", "hist_year_count"))


@query("W9_previous_round_by_branch", f"""SELECT year, {OUTCOME}, lag(closing_rank) OVER (PARTITION BY year, {HISTORY} ORDER BY round, is_pwd) AS prev_round_closing_rank FROM observed""", ("observed",))
def _(spark, sf):
    return panel.previous_round_by_branch(d.observed(spark, sf), []).select("year", *OUTCOME_KEY, "prev_round_closing_rank")


@query("A1_history_aggregates", f"""SELECT {OUTCOME}, round(avg(closing_rank), 6) AS hist_mean_closing_rank, round(stddev_samp(closing_rank), 6) AS hist_std_closing_rank,
 count(closing_rank) AS hist_year_count, arg_max(closing_rank, year) AS last_closing_rank, max(year) AS last_observed_year FROM observed WHERE year < 2001 GROUP BY ALL""", ("observed",))
def _(spark, sf):
    return rounded(panel.history_aggregates(d.observed(spark, sf).where(F.col("year") < 2001)))


_FRAME = f"""SELECT CAST(2001 AS BIGINT) AS year, CAST(2000 AS BIGINT) AS snapshot_year, {", ".join("s." + c.strip() for c in OUTCOME.split(","))}, s.institute_type, s.duration_years, s.degree_type,
 hist_mean_closing_rank, hist_std_closing_rank, hist_year_count, last_closing_rank, last_observed_year, i.n AS institute_freq, p.n AS program_freq,
 2001 - last_observed_year AS years_since_observed, 0 AS years_since_ews
 FROM (SELECT * FROM observed WHERE year = 2000) s JOIN (SELECT {OUTCOME}, round(avg(closing_rank), 6) AS hist_mean_closing_rank, round(stddev_samp(closing_rank), 6) AS hist_std_closing_rank,
  count(*) AS hist_year_count, arg_max(closing_rank, year) AS last_closing_rank, max(year) AS last_observed_year FROM observed WHERE year < 2001 GROUP BY ALL) h ON {same('s', 'h', OUTCOME)}
 JOIN (SELECT institute, count(*) AS n FROM observed WHERE year < 2001 GROUP BY 1) i ON s.institute = i.institute
 JOIN (SELECT program, count(*) AS n FROM observed WHERE year < 2001 GROUP BY 1) p ON s.program = p.program"""


@query("L14_J4_target_frame", _FRAME, ("observed",))
def _(spark, sf):
    return rounded(panel.target_frame(d.observed(spark, sf), 2001))


@query("J3_K3_in_round_frame", f"""SELECT f.institute, f.program, f.category, f.quota, f.gender, f.is_pwd, f.last_closing_rank, c.round AS prev_round_number, c.closing_rank AS prev_round_closing_rank
 FROM (SELECT * FROM ({_FRAME}) WHERE round = 3) f LEFT JOIN (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY {CHOICE} ORDER BY round DESC) AS rn FROM observed WHERE year = 2001 AND round < 3) WHERE rn = 1) c
 ON {same('f', 'c', CHOICE)}""", ("observed",))
def _(spark, sf):
    table = d.observed(spark, sf)
    return panel.target_frame(table, 2001, target_round=3, completed=table).select(
        *CHOICE_KEY, "last_closing_rank", "prev_round_number", "prev_round_closing_rank")


_COUNTS = f"""SELECT count(*) FILTER (f) AS forecast_rows, count(*) FILTER (a) AS observed_rows, count(*) FILTER (f AND a) AS matched_rows,
 count(*) FILTER (f AND a IS NULL) AS forecast_rows_without_observation, count(*) FILTER (a AND f IS NULL) AS observed_rows_outside_prior_universe,
 round(count(*) FILTER (f AND a) / CAST(count(*) FILTER (a) AS DOUBLE), 6) AS observed_universe_coverage
 FROM (SELECT {OUTCOME}, true AS f FROM observed WHERE year = 2000) x FULL JOIN (SELECT {OUTCOME}, true AS a FROM observed WHERE year = 2001) y USING ({OUTCOME})"""


@query("J2_match_counts", _COUNTS, ("observed",))
def _(spark, sf):
    table = d.observed(spark, sf)
    return rounded(panel.match_counts(panel.target_frame(table, 2001), table, 2001))


@query("J2_matched_outcomes", f"""SELECT {", ".join("x." + c.strip() for c in OUTCOME.split(","))}, x.closing_rank AS last_closing_rank, y.closing_rank AS actual_closing_rank
 FROM observed x JOIN observed y ON {same('x', 'y', OUTCOME)} WHERE x.year = 2000 AND y.year = 2001""", ("observed",))
def _(spark, sf):
    table = d.observed(spark, sf)
    return panel.match_outcomes(panel.target_frame(table, 2001), table, 2001).select(*OUTCOME_KEY, "last_closing_rank", "actual_closing_rank")


@query("J12_outside_universe", f"""SELECT {OUTCOME}, 'observed_outside_universe' AS side FROM (SELECT {OUTCOME} FROM observed WHERE year = 2001 EXCEPT SELECT {OUTCOME} FROM observed WHERE year = 2000)
 UNION ALL SELECT {OUTCOME}, 'forecast_without_outcome' FROM (SELECT {OUTCOME} FROM observed WHERE year = 2000 EXCEPT SELECT {OUTCOME} FROM observed WHERE year = 2001)""", ("observed",))
def _(spark, sf):
    table = d.observed(spark, sf)
    frame = panel.target_frame(table, 2001)
    a = panel.outside_universe(table, frame, 2001).select(*OUTCOME_KEY, F.lit("observed_outside_universe").alias("side"))
    b = panel.without_outcome(frame, table, 2001).select(*OUTCOME_KEY, F.lit("forecast_without_outcome").alias("side"))
    return a.unionByName(b)


@query("L13_in_round_counts", _COUNTS.replace("year = 2000", "year = 2000 AND round = 3").replace("year = 2001", "year = 2001 AND round = 3"), ("observed",))
def _(spark, sf):
    table = d.observed(spark, sf)
    frame = panel.target_frame(table, 2001, target_round=3, completed=table)
    return rounded(panel.match_counts(frame, table.where(F.col("round") == 3), 2001))


@query("K1_final_rounds", f"""SELECT year, {BRANCH}, round, closing_rank FROM (SELECT *, row_number() OVER (PARTITION BY year, {BRANCH} ORDER BY round DESC) AS rn FROM observed) WHERE rn = 1""", ("observed",))
def _(spark, sf):
    return panel.final_rounds(d.observed(spark, sf), BRANCH_KEY, ["opening_rank"]).select("year", *BRANCH_KEY, "round", "closing_rank")


@query("X3_branch_by_year", f"""SELECT {BRANCH}, {", ".join(f'max(closing_rank) FILTER (year = {y}) AS "{y}"' for y in d.YEARS)} FROM
 (SELECT *, row_number() OVER (PARTITION BY year, {BRANCH} ORDER BY round DESC) AS rn FROM observed) WHERE rn = 1 GROUP BY {BRANCH}""", ("observed",))
def _(spark, sf):
    finals = panel.final_rounds(d.observed(spark, sf), BRANCH_KEY, ["opening_rank"])
    return panel.branch_by_year(finals, d.YEARS)


@query("P4_past_filter", """SELECT cutoff, year, count(*) AS rows, max(closing_rank) AS highest FROM observed JOIN (SELECT unnest([1996, 1999, 2001]) AS cutoff) ON year <= cutoff GROUP BY cutoff, year
 UNION ALL SELECT 1990, NULL, NULL, NULL UNION ALL SELECT 2050, NULL, NULL, NULL""", ("observed",))
def _(spark, sf):
    """Seasons up to three cutoffs; a cutoff without a season of its own is refused and stands for one empty row."""
    table, out = d.observed(spark, sf), None
    for cutoff in (1990, 1996, 1999, 2001, 2050):
        try:
            kept = panel.rows_until(table, cutoff).groupBy("year").agg(F.count(F.lit(1)).alias("rows"), F.max("closing_rank").alias("highest"))
        except ValueError:
            kept = spark.range(1).select(*(F.lit(None).cast("bigint").alias(c) for c in ("year", "rows", "highest")))
        part = kept.select(F.lit(cutoff).alias("cutoff"), "year", "rows", "highest")
        out = part if out is None else out.unionByName(part)
    return out


_SPLIT = "CASE WHEN year <= 1999 THEN 'train' WHEN year = 2000 THEN 'valid' WHEN year = 2001 THEN 'test' END"


@query("P5_temporal_split", f"SELECT {_SPLIT} AS split, year, count(*) AS rows, CAST(sum(closing_rank) AS BIGINT) AS closing_sum FROM observed GROUP BY ALL", ("observed",))
def _(spark, sf):
    return panel.split_by_year(d.observed(spark, sf), 1999, [2000], [2001]).groupBy("split", "year").agg(
        F.count(F.lit(1)).alias("rows"), F.sum("closing_rank").alias("closing_sum"))


@query("V5_split_integrity", f"""SELECT split, min(year) AS first_year, max(year) AS last_year, count(*) AS rows, CAST(sum(CASE WHEN p IS NULL THEN 1 ELSE 0 END) AS BIGINT) AS null_cells, true AS in_time_order
 FROM (SELECT {_SPLIT} AS split, year, closing_rank, lag(closing_rank) OVER (PARTITION BY year, {CHOICE} ORDER BY round) AS p FROM observed) GROUP BY split""", ("observed",))
def _(spark, sf):
    table = panel.previous_round(d.observed(spark, sf)).select("year", "closing_rank", "prev_round_closing_rank")
    out = quality.split_integrity(panel.split_by_year(table, 1999, [2000], [2001]))
    return out.withColumn("null_cells", as_long(F.col("null_cells")))


@query("X1_union_rounds", """SELECT round, count(*) AS rows, count(DISTINCT institute) AS institutes FROM observed GROUP BY round""", ("observed",))
def _(spark, sf):
    table = d.observed(spark, sf)
    early, late = table.where(F.col("round") <= 2), table.where(F.col("round") > 2)
    return early.unionByName(late).groupBy("round").agg(
        F.count(F.lit(1)).alias("rows"), F.countDistinct("institute").alias("institutes"))


@query("X5_snapshot_last_copy", f"""SELECT {OUTCOME}, closing_rank FROM observed WHERE year = 2000""", ("observed",))
def _(spark, sf):
    snap = d.observed(spark, sf).where(F.col("year") == 2000).select(*OUTCOME_KEY, "closing_rank", "opening_rank")
    return cleaning.first_by_source(snap.withColumn("late", -F.col("opening_rank")), OUTCOME_KEY, ["late"]).select(*OUTCOME_KEY, "closing_rank")


@query("X6_universe_distinct", f"""SELECT {OUTCOME}, institute_type FROM observed WHERE year = 2001""", ("observed",))
def _(spark, sf):
    snap = d.observed(spark, sf).where(F.col("year") == 2001).select(*OUTCOME_KEY, "institute_type")
    return snap.dropDuplicates(OUTCOME_KEY)


@query("X8_set_operations", """SELECT 'only_1996' AS side, institute, program FROM (SELECT institute, program FROM observed WHERE year = 1996 AND is_pwd EXCEPT SELECT institute, program FROM observed WHERE year = 2001 AND is_pwd)
 UNION ALL SELECT 'both', institute, program FROM (SELECT institute, program FROM observed WHERE year = 1996 AND is_pwd INTERSECT SELECT institute, program FROM observed WHERE year = 2001 AND is_pwd)""", ("observed",))
def _(spark, sf):
    pick = lambda y: d.observed(spark, sf).where((F.col("year") == y) & F.col("is_pwd")).select("institute", "program")
    a, b = pick(1996), pick(2001)
    tag = lambda df, s: df.select(F.lit(s).alias("side"), "institute", "program")
    # subtract/intersect are planned as semi/anti joins on pre-aggregated distinct rows
    return tag(a.subtract(b), "only_1996").unionByName(tag(a.intersect(b), "both"))


@query("J16_label_codes", """SELECT category, program, institute_type, coalesce(code, -1) AS code, count(*) AS rows FROM observed o LEFT JOIN (
 SELECT program AS p, row_number() OVER (ORDER BY program) - 1 AS code FROM (SELECT DISTINCT program FROM observed WHERE year < 2000 AND program <> 'Chemistry')) c ON o.program = c.p
 WHERE year >= 2000 GROUP BY ALL""", ("observed",))
def _(spark, sf):
    from cutline.sources.tables import dimension

    table = d.observed(spark, sf)
    known = dimension(table.where((F.col("year") < 2000) & (F.col("program") != "Chemistry")), "program", 0)
    coded = table.where(F.col("year") >= 2000).join(known, "program", "left")
    return coded.select("category", "program", "institute_type", F.coalesce("code", F.lit(-1)).alias("code")).groupBy(
        "category", "program", "institute_type", "code").agg(F.count(F.lit(1)).alias("rows"))
