"""Ingest queries: raw text rows to the clean observed table, checks and reports."""

from __future__ import annotations

from pyspark.sql import functions as F

from cutline.functions import scoring, text
from cutline.operators import cleaning, quality
from cutline.plans.oracle_tables import OUTCOME
from cutline.plans.registry import as_long, query, rounded
from cutline.sources import driver_tables as d, file_audit, file_heads, round_files, side_tables, tables


def _ranked(spark, sf):
    return cleaning.parse_ranks(cleaning.nulls_from_words(d.raw_rounds(spark, sf)))


def _kept(spark, sf):
    return cleaning.drop_unranked(_ranked(spark, sf))


def _cleaned(spark, sf):
    return cleaning.clean_rounds(d.raw_rounds(spark, sf), d.RAW_ORDER)


@query("P1_null_words", """SELECT source_file, count(*) AS rows, count(*) - count(raw_quota) AS null_quota, count(*) - count(raw_gender) AS null_gender,
 count(*) - count(raw_opening) AS null_opening, count(*) - count(raw_closing) AS null_closing FROM raw_nulls GROUP BY source_file""", ("raw_nulls",))
def _(spark, sf):
    nulls = lambda c, n: F.count_if(F.col(f"`{c}`").isNull()).alias(n)
    return cleaning.nulls_from_words(d.raw_rounds(spark, sf)).groupBy("source_file").agg(
        F.count(F.lit(1)).alias("rows"), nulls("Quota", "null_quota"), nulls("Gender", "null_gender"),
        nulls("Opening Rank", "null_opening"), nulls("Closing Rank", "null_closing"))


@query("P2_drop_unranked", """SELECT year, round, count(*) AS rows, count(opening_rank) AS with_opening, count(closing_rank) AS with_closing,
 CAST(sum(opening_rank) AS BIGINT) AS opening_sum, CAST(sum(closing_rank) AS BIGINT) AS closing_sum FROM kept GROUP BY year, round""", ("kept",))
def _(spark, sf):
    return _kept(spark, sf).groupBy("year", "round").agg(
        F.count(F.lit(1)).alias("rows"), F.count("opening_rank").alias("with_opening"), F.count("closing_rank").alias("with_closing"),
        F.sum("opening_rank").alias("opening_sum"), F.sum("closing_rank").alias("closing_sum"))


@query("P3_master_columns", f"SELECT year, {OUTCOME}, institute_type, duration_years, degree_type, closing_rank FROM observed", ("observed",))
def _(spark, sf):
    from cutline.schemas import REQUIRED_OBSERVED

    return d.build_observed(spark, sf).select(*REQUIRED_OBSERVED)


@query("F1_parse_rank", "SELECT source_file, source_row_id, source_seq, opening_rank, closing_rank, is_pwd_rank FROM ranked", ("ranked",))
def _(spark, sf):
    return _ranked(spark, sf).select("source_file", "source_row_id", "source_seq", "opening_rank", "closing_rank", "is_pwd_rank")


@query("F2_institute_type", "SELECT institute, institute_type, count(*) AS rows FROM normalised GROUP BY ALL", ("normalised",))
def _(spark, sf):
    return cleaning.normalise(_kept(spark, sf)).groupBy("institute", "institute_type").agg(F.count(F.lit(1)).alias("rows"))


@query("F3_seat_category", "SELECT raw_seat, category, is_pwd, count(*) AS rows FROM normalised GROUP BY ALL", ("normalised",))
def _(spark, sf):
    return cleaning.normalise(_kept(spark, sf)).groupBy(
        F.col("`Seat Type`").alias("raw_seat"), "category", "is_pwd").agg(F.count(F.lit(1)).alias("rows"))


@query("F4_gender_label", "SELECT raw_gender, gender, count(*) AS rows FROM normalised GROUP BY ALL", ("normalised",))
def _(spark, sf):
    return _kept(spark, sf).select(
        F.col("Gender").alias("raw_gender"), text.gender_label(F.col("Gender")).alias("gender")
    ).groupBy("raw_gender", "gender").agg(F.count(F.lit(1)).alias("rows"))


@query("F5_quota_label", """SELECT raw_quota, quota, CASE WHEN raw_quota = 'HS' THEN 'HS' ELSE 'AI' END AS quota_pool, count(*) AS rows FROM normalised GROUP BY ALL""", ("normalised",))
def _(spark, sf):
    raw = F.col("Quota")
    return _kept(spark, sf).select(
        raw.alias("raw_quota"), text.quota_label(raw).alias("quota"), text.quota_home_or_all_india(raw).alias("quota_pool")
    ).groupBy("raw_quota", "quota", "quota_pool").agg(F.count(F.lit(1)).alias("rows"))


@query("F6_program_parts", "SELECT raw_program, program, duration_years, degree_type, count(*) AS rows FROM normalised GROUP BY ALL", ("normalised",))
def _(spark, sf):
    raw = F.col("`Academic Program Name`")
    p = text.program_parts(raw)
    return _kept(spark, sf).select(
        raw.alias("raw_program"), p["program"].alias("program"), p["duration_years"].alias("duration_years"), p["degree_type"].alias("degree_type")
    ).groupBy("raw_program", "program", "duration_years", "degree_type").agg(F.count(F.lit(1)).alias("rows"))


@query("F7_defence_flag", """SELECT c_mktsegment AS segment, contains(upper(c_mktsegment), 'DEFENCE') OR contains(upper(c_mktsegment), 'DS') AS is_defence,
 contains(upper(c_name || ' ds'), 'DS') AS tagged, count(*) AS rows FROM customer GROUP BY ALL""")
def _(spark, sf):
    return d.read(spark, sf, "customer").select(
        F.col("c_mktsegment").alias("segment"), text.seat_is_defence(F.col("c_mktsegment")).alias("is_defence"),
        text.seat_is_defence(F.concat(F.col("c_name"), F.lit(" ds"))).alias("tagged"),
    ).groupBy("segment", "is_defence", "tagged").agg(F.count(F.lit(1)).alias("rows"))


@query("X4_first_copy_per_key", """SELECT year, round, institute, program, quota, category, is_pwd, gender, opening_rank, closing_rank, is_pwd_rank, source_file, source_row_id, source_seq FROM cleaned""", ("cleaned",))
def _(spark, sf):
    return _cleaned(spark, sf).select(
        "year", "round", "institute", "program", "quota", "category", "is_pwd", "gender", "opening_rank", "closing_rank",
        "is_pwd_rank", *d.RAW_ORDER)


@query("A31_mapping_pairs", """SELECT DISTINCT domain, raw, normalised FROM (
 SELECT 'category' AS domain, coalesce(trim(raw_seat), '(empty)') AS raw, category AS normalised FROM normalised
 UNION ALL SELECT 'quota', coalesce(trim(raw_quota), '(empty)'), quota FROM normalised
 UNION ALL SELECT 'gender', coalesce(trim(raw_gender), '(empty)'), gender FROM normalised
 UNION ALL SELECT 'institute_type', coalesce(trim(raw_institute), '(empty)'), institute_type FROM normalised)""", ("normalised",))
def _(spark, sf):
    return cleaning.mapping_pairs(_kept(spark, sf))


@query("A33_cleaning_report", """SELECT a AS raw_rows, b AS ranked_rows, c AS cleaned_rows, a - b AS dropped_no_rank, b - c AS dropped_duplicates, round(100e0 * (a - c) / a, 6) AS drop_percent
 FROM (SELECT (SELECT count(*) FROM raw) AS a, (SELECT count(*) FROM kept) AS b, (SELECT count(*) FROM cleaned) AS c)""", ("raw", "kept", "cleaned"))
def _(spark, sf):
    return rounded(quality.cleaning_report(d.raw_rounds(spark, sf), _kept(spark, sf), _cleaned(spark, sf)))


_CHECKS = """SELECT 'null_year' AS "check", 'critical' AS severity, count(*) FILTER (year IS NULL) AS count FROM t
 UNION ALL SELECT 'null_round', 'critical', count(*) FILTER (round IS NULL) FROM t
 UNION ALL SELECT 'closing_not_positive', 'critical', count(*) FILTER (closing_rank <= 0) FROM t
 UNION ALL SELECT 'year_out_of_range', 'warning', count(*) FILTER (year NOT BETWEEN 2010 AND 2030) FROM t
 UNION ALL SELECT 'round_out_of_range', 'warning', count(*) FILTER (round NOT BETWEEN 1 AND 10) FROM t
 UNION ALL SELECT 'unknown_category', 'warning', count(*) FILTER (category NOT IN ('OPEN','OBC-NCL','SC','ST','EWS')) FROM t
 UNION ALL SELECT 'unknown_gender', 'warning', count(*) FILTER (gender NOT IN ('Gender-Neutral','Female-only')) FROM t
 UNION ALL SELECT 'unknown_quota', 'warning', count(*) FILTER (quota NOT IN ('AI','HS','OS','STATE')) FROM t
 UNION ALL SELECT 'unknown_institute_type', 'warning', count(*) FILTER (institute_type NOT IN ('IIT','NIT','IIIT','GFTI')) FROM t
 UNION ALL SELECT 'opening_after_closing', 'warning', count(*) FILTER (opening_rank > closing_rank) FROM t
 UNION ALL SELECT 'duplicate_rows', 'warning', CAST(coalesce(sum(c - 1), 0) AS BIGINT) FROM (SELECT count(*) AS c FROM t GROUP BY year, round, institute, program, quota, category, is_pwd, gender)"""


@query("V3_cleaned_checks", _CHECKS.replace("FROM t", "FROM normalised"), ("normalised",))
def _(spark, sf):
    return quality.cleaned_checks(cleaning.normalise(_kept(spark, sf)).select(
        "year", "round", "institute", "program", "quota", "category", "is_pwd", F.col("gender"), "institute_type", "opening_rank", "closing_rank"))


@query("V1_observed_contract", """SELECT 'empty_table' AS "check", CAST(CASE WHEN count(*) = 0 THEN 1 ELSE 0 END AS BIGINT) AS violations FROM observed
 UNION ALL SELECT 'null_year', count(*) FILTER (year IS NULL) FROM observed UNION ALL SELECT 'null_round', count(*) FILTER (round IS NULL) FROM observed
 UNION ALL SELECT 'null_target', count(*) FILTER (closing_rank IS NULL) FROM observed
 UNION ALL SELECT 'duplicate_key_groups', count(*) FROM (SELECT 1 FROM observed GROUP BY year, """ + OUTCOME + """ HAVING count(*) > 1)""", ("observed",))
def _(spark, sf):
    return quality.observed_contract(d.observed(spark, sf))


@query("V1_duplicate_keys", """SELECT year, round, institute, program, quota, category, is_pwd, gender, count(*) AS copies FROM normalised
 GROUP BY ALL HAVING count(*) > 1""", ("normalised",))
def _(spark, sf):
    from cutline.schemas import NATURAL_KEY

    return quality.duplicate_keys(cleaning.normalise(_kept(spark, sf)).select(*[F.col(c) for c in NATURAL_KEY]), NATURAL_KEY)


@query("V2_past_only", """SELECT min(year) FILTER (year >= 2000) AS first_offending_year, count(*) FILTER (year >= 2000) AS offending_rows,
 count(*) FILTER (year >= 2000) = 0 AS ok FROM observed""", ("observed",))
def _(spark, sf):
    return quality.past_only_check(d.observed(spark, sf), 2000)


@query("A10_quality_facts", """SELECT fact, value FROM (UNPIVOT (SELECT CAST(count(*) AS VARCHAR) AS full_rows, CAST(count(*) FILTER (year <= 2000) AS VARCHAR) AS selected_rows,
 CAST(count(*) FILTER (year > 2000) AS VARCHAR) AS post_cutoff_rows, '0' AS missing_required_cells, '0' AS rows_missing_required,
 CAST(count(*) FILTER (opening_rank > closing_rank) AS VARCHAR) AS opening_after_closing,
 string_agg(DISTINCT CAST(year AS VARCHAR), ',' ORDER BY CAST(year AS VARCHAR)) AS full_years,
 string_agg(DISTINCT CAST(year AS VARCHAR), ',' ORDER BY CAST(year AS VARCHAR)) FILTER (year <= 2000) AS selected_years,
 string_agg(DISTINCT CAST(year AS VARCHAR), ',' ORDER BY CAST(year AS VARCHAR)) FILTER (year > 2000) AS post_cutoff_years,
 '0' AS duplicate_key_rows, '0' AS duplicate_key_groups FROM observed) ON COLUMNS(*) INTO NAME fact VALUE value)""", ("observed",))
def _(spark, sf):
    return quality.quality_facts(d.observed(spark, sf), 2000)


@query("A11_round_coverage", """SELECT year, CAST(sum(n) AS BIGINT) AS rows, count(round) AS round_count, string_agg(round || ':' || n, ',' ORDER BY round) AS rows_by_round,
 CASE WHEN year <= 2000 THEN 'selected' ELSE 'post_cutoff_excluded' END AS experiment_status FROM (SELECT year, round, count(*) AS n FROM observed GROUP BY ALL) GROUP BY year""", ("observed",))
def _(spark, sf):
    return quality.round_coverage(d.observed(spark, sf), 2000)


_PROFILED = ["year", "round", "institute", "institute_type", "program", "duration_years", "degree_type", "quota", "category", "is_pwd", "gender", "opening_rank", "closing_rank"]


@query("A32_column_profile", " UNION ALL ".join(
    f"SELECT '{c}' AS \"column\", count({c}) AS non_null, round(100e0 * count({c}) / count(*), 6) AS percent, count(DISTINCT {c}) AS distinct_values FROM cleaned" for c in _PROFILED), ("cleaned",))
def _(spark, sf):
    return rounded(quality.column_profile(_cleaned(spark, sf), _PROFILED))


@query("A12_missing_by_column", " UNION ALL ".join(
    f"SELECT '{c}' AS \"column\", count(*) - count({c}) AS missing FROM cleaned" for c in _PROFILED), ("cleaned",))
def _(spark, sf):
    return quality.missing_by_column(_cleaned(spark, sf), _PROFILED)


@query("S4_exam_dynamics", """SELECT year, applicants, applicants // 10 AS total_seats FROM dynamics""", ("dynamics",))
def _(spark, sf):
    raw = d.dynamics(spark, sf).select(
        F.col("year").cast("string").alias(" Exam Year "), F.format_number("applicants", 0).alias("Registered candidates"),
        F.format_number(F.floor(F.col("applicants") / 10), 0).alias("Total Seats"))
    return side_tables.dynamics_from(raw)


@query("M1_J1_percentiles", """SELECT o.year, institute, program, category, quota, gender, is_pwd, o.round, applicants, round_even(opening_rank / CAST(applicants AS DOUBLE) * 100, 6) AS opening_percentile,
 round_even(closing_rank / CAST(applicants AS DOUBLE) * 100, 6) AS closing_percentile, round_even(closing_rank / CAST(applicants AS DOUBLE), 6) AS competitiveness_ratio
 FROM observed o LEFT JOIN (SELECT * FROM dynamics WHERE year > 1995) y ON o.year = y.year""", ("observed", "dynamics"))
def _(spark, sf):
    years = d.dynamics(spark, sf).where(F.col("year") > 1995)
    return cleaning.percentile_columns(d.observed(spark, sf), years).select(
        "year", "institute", "program", "category", "quota", "gender", "is_pwd", "round", "applicants",
        "opening_percentile", "closing_percentile", "competitiveness_ratio")


def _seat_sheet(spark, sf):
    """A seat sheet as published: one wide row per institute, programme and pool; rows of the
    second pool leave institute and programme blank."""
    k = F.substring("p_brand", 7, 4).cast("bigint")
    base = d.read(spark, sf, "part").groupBy(k.alias("k"), "p_type").agg(F.count(F.lit(1)).alias("n"), F.sum("p_size").alias("size"))
    both = base.select("k", "p_type", "n", "size", F.explode(F.array(F.lit(0), F.lit(1))).alias("pool"))
    blank = lambda c: F.when(F.col("pool") == 0, c).otherwise("")
    return both.select(
        F.concat(F.lit("sheet_"), F.col("k").cast("string"), F.lit("_"), "p_type").alias("file"), F.col("pool").alias("line"),
        blank(F.concat(F.lit("Institute "), F.col("k").cast("string"))).alias("Institute Name"),
        blank(F.col("p_type")).alias("Program\n Name"),
        F.when(F.col("pool") == 0, "Gender-Neutral").otherwise("Female-only").alias("Seat Pool"),
        F.format_number(F.col("size") * 10 + F.col("pool"), 0).alias("OPEN"),
        F.when(F.col("n") % 2 == 0, F.col("n").cast("string")).alias("SC"), F.lit("n/a").alias("ST"))


_SEAT_SQL = """SELECT 'Institute ' || k AS institute, p_type AS program, CASE pool WHEN 0 THEN 'Gender-Neutral' ELSE 'Female-only' END AS seat_pool, category, CAST(seat_count AS BIGINT) AS seat_count FROM (
 SELECT k, p_type, pool, 'OPEN' AS category, size * 10 + pool AS seat_count FROM s UNION ALL SELECT k, p_type, pool, 'SC', n FROM s WHERE n % 2 = 0)"""


@query("X2_W10_seat_matrix", """WITH s AS (SELECT *, unnest([0, 1]) AS pool FROM (SELECT CAST(substring(p_brand, 7, 4) AS BIGINT) AS k, p_type, count(*) AS n, sum(p_size) AS size FROM part GROUP BY ALL)) """ + _SEAT_SQL)
def _(spark, sf):
    return side_tables.seat_matrix_from(_seat_sheet(spark, sf), "line", "file").drop("file", "line")


@query("W10_forward_fill_one_file", """SELECT row_id, last_value(i IGNORE NULLS) OVER w AS institute, last_value(p IGNORE NULLS) OVER w AS program FROM (
 SELECT l_orderkey * 8 + l_linenumber AS row_id, CASE WHEN l_linenumber = 1 AND l_orderkey % 5 = 0 THEN 'Institute ' || min(l_suppkey) END AS i,
 CASE WHEN l_linenumber % 3 = 0 THEN min(l_returnflag) END AS p FROM lineitem GROUP BY l_orderkey, l_linenumber) WINDOW w AS (ORDER BY row_id ROWS UNBOUNDED PRECEDING)""")
def _(spark, sf):
    # every line number of every order is a row of one sheet, so no task may hold the file
    n = F.col("l_linenumber")
    lines = d.read(spark, sf, "lineitem").groupBy("l_orderkey", "l_linenumber").agg(
        F.min("l_suppkey").alias("k"), F.min("l_returnflag").alias("flag"))
    sheet = lines.select(
        F.lit("sheet").alias("file"), (F.col("l_orderkey") * 8 + n).alias("row_id"),
        F.when((n == 1) & (F.col("l_orderkey") % 5 == 0), F.concat(F.lit("Institute "), F.col("k").cast("string"))).otherwise(" ").alias("institute"),
        F.when(n % 3 == 0, F.col("flag")).alias("program"))
    return cleaning.forward_fill(sheet, ["institute", "program"], "row_id", "file").drop("file")


@query("S5_seat_matrix_files", """WITH s AS (SELECT *, unnest([0, 1]) AS pool FROM (SELECT CAST(substring(p_brand, 7, 4) AS BIGINT) AS k, p_type, count(*) AS n, sum(p_size) AS size FROM part GROUP BY ALL)) """ + _SEAT_SQL)
def _(spark, sf):
    """One sheet per institute as a CSV file: a header over two lines, grouped numbers in quotes,
    rows that end early and rows with a field too many."""
    name, kind = F.concat(F.lit("Institute "), F.col("k").cast("string")), F.col("p_type")
    first = F.concat_ws(",", name, kind, F.lit("Gender-Neutral"), F.concat(F.lit('"'), F.format_number(F.col("size") * 10, 0), F.lit('"')))
    second = F.concat_ws(",", F.lit(""), F.lit(""), F.lit("Female-only"), F.concat(F.lit('"'), F.format_number(F.col("size") * 10 + 1, 0), F.lit('"')))
    seats = F.when(F.col("n") % 2 == 0, F.concat(F.lit(","), F.col("n").cast("string"))).otherwise("")
    rows = d.read(spark, sf, "part").groupBy(F.substring("p_brand", 7, 4).cast("bigint").alias("k"), "p_type").agg(
        F.count(F.lit(1)).alias("n"), F.sum("p_size").alias("size")).select("k", "p_type", F.posexplode(F.array(
            F.concat(first, seats), F.lit(",,Gender-Neutral,1,2,n/a,4"), F.concat(second, seats))).alias("line", "value"))
    header = rows.select("k", F.lit("").alias("p_type"), F.lit(0).alias("line"), F.lit(
        '"Institute\n Name",Program Name,Seat Pool,OPEN,SC,ST').alias("value")).distinct()
    folder = tables.scratch_folder(spark, "sheets")
    rows.unionByName(header).repartition("k").sortWithinPartitions("k", "p_type", "line").select("k", "value").write.partitionBy("k").text(folder)
    return side_tables.read_seat_matrix(spark, folder)


@query("S1_S2_header_widths", """SELECT source_file, CAST(CASE WHEN source_file < '1997' THEN 6 ELSE 7 END AS BIGINT) AS header_width, true AS head_only, count(*) AS rows,
 count(*) FILTER (source_file < '1997' OR raw_gender = 'Gender-Neutral') AS neutral_rows, count(raw_closing) AS with_closing FROM raw_nulls GROUP BY source_file""", ("raw_nulls",))
def _(spark, sf):
    """Files of the first two seasons have no gender column; widths come from the heads of the files."""
    from cutline.schemas import LEGACY_ROUND_SCHEMA, RAW_ROUND_SCHEMA

    folder, raw = tables.scratch_folder(spark, "widths"), d.raw_rounds(spark, sf)
    is_legacy = F.col("source_file") < "1997"
    for schema, rows in ((RAW_ROUND_SCHEMA, raw.where(~is_legacy)), (LEGACY_ROUND_SCHEMA, raw.where(is_legacy))):
        rows.select(*[F.col(f"`{f.name}`") for f in schema.fields], "source_file").repartition(
            "source_file", F.pmod(F.xxhash64("Institute"), F.lit(8))).write.mode("append").option("header", True).option(
            "maxRecordsPerFile", 5_000_000).partitionBy("source_file").csv(folder)
    found = round_files.discover(spark, folder)
    widths = round_files.headers(found).join(found, "path").groupBy("source_file").agg(
        F.max("width").alias("header_width"), (F.max("bytes_read") <= file_heads.HEAD_BYTES).alias("head_only"))
    rows = round_files.load_rounds(spark, folder).groupBy("source_file").agg(
        F.count(F.lit(1)).alias("rows"), F.count_if(F.col("Gender") == "Gender-Neutral").alias("neutral_rows"),
        F.count(F.col("`Closing Rank`")).alias("with_closing"))
    return widths.join(rows, "source_file")


@query("S11_relational_load", """SELECT institute, program, 999 + dense_rank() OVER (ORDER BY institute) AS institute_code, 999 + dense_rank() OVER (ORDER BY program) AS program_code,
 year, round, quota, category, gender, is_pwd, closing_rank FROM cleaned WHERE opening_rank IS NOT NULL AND closing_rank IS NOT NULL""", ("cleaned",))
def _(spark, sf):
    institutes, programs, facts = tables.relational_layout(_cleaned(spark, sf))
    return tables.wide_history(institutes, programs, facts).select(
        "institute", "program", "institute_code", "program_code", "year", "round", "quota", "category", "gender", "is_pwd", "closing_rank")


@query("S1_S2_S3_round_files", """SELECT source_file, count(*) AS rows, count(*) AS distinct_ids, CAST(0 AS BIGINT) AS first_id,
 count(raw_gender) AS with_gender, count(raw_opening) AS with_opening FROM raw_nulls GROUP BY source_file""", ("raw_nulls",))
def _(spark, sf):
    folder = tables.scratch_folder(spark, "rounds")
    from cutline.schemas import RAW_ROUND_SCHEMA

    raw = d.raw_rounds(spark, sf).select(*[F.col(f"`{f.name}`") for f in RAW_ROUND_SCHEMA.fields], "source_file")
    # files are split by row count, so none grows with the season it belongs to
    raw.repartition("source_file").write.option("header", True).option("maxRecordsPerFile", 5_000_000).option(
        "ignoreLeadingWhiteSpace", False).option("ignoreTrailingWhiteSpace", False).partitionBy("source_file").csv(folder)
    rows = round_files.load_rounds(spark, folder)
    return rows.groupBy("source_file").agg(
        F.count(F.lit(1)).alias("rows"), F.countDistinct("source_row_id").alias("distinct_ids"), F.min("source_row_id").alias("first_id"),
        F.count("Gender").alias("with_gender"), F.count(F.col("`Opening Rank`")).alias("with_opening"))


@query("S6_S7_S10_master_round_trip", """SELECT year, count(*) AS rows, CAST(sum(closing_rank) AS BIGINT) AS closing_sum FROM cleaned WHERE year >= 1998 GROUP BY year""", ("cleaned",))
def _(spark, sf):
    folder = tables.scratch_folder(spark, "master")
    cleaned = _cleaned(spark, sf)
    tables.write_master(cleaned, folder)
    back = tables.read_master(spark, folder, cleaned.schema)
    return back.where(F.col("year") >= 1998).groupBy("year").agg(
        F.count(F.lit(1)).alias("rows"), F.sum("closing_rank").alias("closing_sum"))


@query("S8_general_numbers", """SELECT year, round, round(avg(closing_rank), 4) AS mean_closing FROM observed GROUP BY ALL""", ("observed",))
def _(spark, sf):
    mean = d.observed(spark, sf).groupBy("year", "round").agg(F.avg("closing_rank").alias("m"))
    return mean.select("year", "round", F.round(tables.general_number(F.col("m")).cast("double"), 4).alias("mean_closing"))


@query("S8_csv_round_trip", """SELECT year, round, count(*) AS rows, CAST(sum(closing_rank) AS BIGINT) AS closing_sum FROM observed GROUP BY ALL""", ("observed",))
def _(spark, sf):
    folder = tables.scratch_folder(spark, "csv")
    table = d.observed(spark, sf).select("year", "round", "institute", "closing_rank", (F.col("closing_rank") / 7).alias("share"))
    tables.write_csv(table, folder)
    return spark.read.schema("year bigint, round bigint, institute string, closing_rank bigint, share double").option(
        "header", True).csv(folder).groupBy("year", "round").agg(F.count("share").alias("rows"), F.sum("closing_rank").alias("closing_sum"))


@query("S9_json_round_trip", """SELECT year, round, round(CASE WHEN count(*) > 40 THEN stddev_samp(closing_rank) END, 4) AS spread FROM observed GROUP BY ALL""", ("observed",))
def _(spark, sf):
    folder = tables.scratch_folder(spark, "json")
    spread = d.observed(spark, sf).groupBy("year", "round").agg(
        F.when(F.count(F.lit(1)) > 40, F.stddev_samp("closing_rank")).otherwise(F.lit(float("nan"))).alias("spread"))
    tables.write_json(spread, folder)
    return rounded(spark.read.schema("year bigint, round bigint, spread double").json(folder), 4)


_MAGIC = {0: ("pdf", "application/pdf", "255044462D"), 1: ("png", "image/png", "89504E470D0A1A0A"), 2: ("jpeg", "image/jpeg; q=1", "FFD8FF"),
          3: ("webp", "image/webp", "524946460000000057454250"), 4: ("txt", "text/plain", "00")}


def _uploads(spark, sf):
    k = F.col("doc_id")
    head = mime = ext = None
    for i, (e, m, h) in _MAGIC.items():
        head = F.when(k % 5 == i, h) if head is None else head.when(k % 5 == i, h)
        mime = F.when(k % 5 == i, m) if mime is None else mime.when(k % 5 == i, m)
        ext = F.when(k % 5 == i, e) if ext is None else ext.when(k % 5 == i, e)
    body = F.concat(F.unhex(F.when(k % 7 == 6, "0102").otherwise(head)), F.encode("text", "UTF-8"))
    return d.documents(spark, sf).select(
        k.alias("doc_id"), F.concat(F.lit("in\\box/"), "source", F.lit("_"), k.cast("string"), F.lit("."), ext).alias("name"),
        F.when(k % 11 == 10, F.lit("").cast("binary")).otherwise(body).alias("content"),
        F.when(k % 13 == 12, "image/png").otherwise(mime).alias("declared_type"))


_UPLOAD_SQL = """SELECT doc_id, CASE WHEN reason IS NULL THEN 'accepted' ELSE 'rejected' END AS status, reason, source || '_' || doc_id || '.' || ext AS safe_name FROM (
 SELECT *, CASE WHEN size = 0 THEN 'empty' WHEN size > 6000 THEN 'too_large' WHEN ext = 'txt' THEN 'unsupported_extension'
  WHEN declared <> mime THEN 'declared_type_mismatch' WHEN doc_id % 7 = 6 THEN 'signature_mismatch' END AS reason FROM (
 SELECT doc_id, source, ext, mime, CASE WHEN doc_id % 13 = 12 THEN 'image/png' ELSE mime END AS declared,
  CASE WHEN doc_id % 11 = 10 THEN 0 ELSE strlen(text) + CASE WHEN doc_id % 7 = 6 THEN 2 ELSE lead END END AS size FROM (
 SELECT *, CASE doc_id % 5 WHEN 0 THEN 'pdf' WHEN 1 THEN 'png' WHEN 2 THEN 'jpeg' WHEN 3 THEN 'webp' ELSE 'txt' END AS ext,
  CASE doc_id % 5 WHEN 0 THEN 'application/pdf' WHEN 1 THEN 'image/png' WHEN 2 THEN 'image/jpeg' WHEN 3 THEN 'image/webp' END AS mime,
  CASE doc_id % 5 WHEN 0 THEN 5 WHEN 1 THEN 8 WHEN 2 THEN 3 WHEN 3 THEN 12 ELSE 1 END AS lead FROM documents)))"""


@query("S13_upload_audit", _UPLOAD_SQL)
def _(spark, sf):
    return file_audit.audit_uploads(_uploads(spark, sf), 6000).select("doc_id", "status", "reason", "safe_name")


@query("S14_integrity_audit", """SELECT status, count(*) AS files FROM (SELECT CASE WHEN m.path IS NULL THEN 'unlisted' WHEN a.path IS NULL THEN 'missing'
 WHEN sha256(a.text) = m.sha THEN 'ok' ELSE 'mismatch' END AS status FROM (SELECT doc_id AS path, text FROM documents WHERE doc_id % 9 <> 1) a
 FULL JOIN (SELECT doc_id AS path, CASE WHEN doc_id % 8 = 3 THEN 'ff' ELSE sha256(text) END AS sha FROM documents WHERE doc_id % 10 <> 4) m ON a.path = m.path) GROUP BY status""")
def _(spark, sf):
    docs, k = d.documents(spark, sf), F.col("doc_id")
    files = docs.where(k % 9 != 1).select(k.alias("path"), F.encode("text", "UTF-8").alias("content"))
    digest = F.sha2(F.encode("text", "UTF-8"), 256)
    manifest = docs.where(k % 10 != 4).select(k.alias("path"), F.when(k % 8 == 3, "FF").otherwise(F.upper(digest)).alias("sha256"))
    return file_audit.audit_integrity(files, manifest).groupBy("status").agg(F.count(F.lit(1)).alias("files"))


@query("S13_S14_real_files", """SELECT doc_id, status, CASE WHEN status <> 'missing' THEN CASE WHEN size = 0 THEN 'empty' WHEN size > 6000 THEN 'too_large' WHEN ext = 'txt' THEN 'unsupported_extension'
  WHEN declared <> mime THEN 'declared_type_mismatch' WHEN doc_id % 7 = 6 OR doc_id % 11 = 10 THEN 'signature_mismatch' END END AS reason, CASE WHEN status <> 'missing' THEN CAST(size AS BIGINT) END AS size FROM (
 SELECT doc_id, ext, mime, CASE WHEN doc_id % 13 = 12 THEN 'image/png' ELSE mime END AS declared,
  CASE WHEN doc_id % 11 = 10 THEN 0 ELSE strlen(text) + CASE WHEN doc_id % 7 = 6 THEN 2 ELSE lead END END + CASE WHEN doc_id % 8 = 3 THEN 1 ELSE 0 END AS size,
  CASE WHEN doc_id % 9 = 1 THEN 'missing' WHEN doc_id % 10 = 4 THEN 'unlisted' WHEN doc_id % 8 = 3 THEN 'mismatch' ELSE 'ok' END AS status FROM (
 SELECT *, CASE doc_id % 5 WHEN 0 THEN 'pdf' WHEN 1 THEN 'png' WHEN 2 THEN 'jpeg' WHEN 3 THEN 'webp' ELSE 'txt' END AS ext,
  CASE doc_id % 5 WHEN 0 THEN 'application/pdf' WHEN 1 THEN 'image/png' WHEN 2 THEN 'image/jpeg' WHEN 3 THEN 'image/webp' END AS mime,
  CASE doc_id % 5 WHEN 0 THEN 5 WHEN 1 THEN 8 WHEN 2 THEN 3 WHEN 3 THEN 12 ELSE 1 END AS lead FROM documents))
 WHERE NOT (doc_id % 9 = 1 AND doc_id % 10 = 4) AND NOT (status = 'unlisted' AND size = 0)""")
def _(spark, sf):
    """Real files in the shared folder: some never arrive, some have a byte more than the manifest knows, some are in no manifest."""
    k, folder = F.col("doc_id"), tables.scratch_folder(spark, "uploads")
    sent = _uploads(spark, sf).withColumn("name", F.regexp_extract("name", r"([^/]+)$", 1))
    extra = F.when(k % 8 == 3, F.encode(F.lit("!"), "UTF-8")).otherwise(F.lit("").cast("binary"))
    file_audit.write_files(sent.where(k % 9 != 1).withColumn("content", F.concat("content", extra)), folder)
    manifest = sent.where(k % 10 != 4).select("name", F.sha2("content", 256).alias("sha256"))
    found = file_audit.audit_manifest(spark, folder, manifest).withColumnRenamed("status", "integrity")
    audited = file_audit.audit_files(found.join(sent.select("doc_id", "name", "declared_type"), "name"), 6000)
    arrived = F.col("integrity") != "missing"
    return audited.select("doc_id", F.col("integrity").alias("status"), F.when(arrived, F.col("reason")).alias("reason"), F.col("length").alias("size"))


@query("P15_feature_guard", """SELECT year, round, count(*) AS rows FROM observed WHERE year >= 2000 GROUP BY ALL""", ("observed",))
def _(spark, sf):
    from cutline.schemas import PRE_SEASON_FEATURES, check_features

    check_features(PRE_SEASON_FEATURES, "pre_counselling")
    try:
        check_features(["opening_rank"], "pre_counselling")
    except ValueError:
        return d.observed(spark, sf).where(F.col("year") >= 2000).groupBy("year", "round").agg(F.count(F.lit(1)).alias("rows"))
    raise AssertionError("an unavailable feature passed the guard")


@query("F15_fingerprint", "SELECT s_suppkey, left(sha256(concat_ws('|', s_suppkey, s_name, s_nationkey)), 16) AS fingerprint FROM supplier")
def _(spark, sf):
    return d.read(spark, sf, "supplier").select(
        "s_suppkey", text.fingerprint(F.col("s_suppkey"), F.col("s_name"), F.col("s_nationkey")).alias("fingerprint"))


@query("M2_rank_shape", f"""SELECT year, {OUTCOME}, closing_rank - opening_rank AS rank_spread, round(ln(1e0 + opening_rank), 6) AS log_opening_rank,
 round(ln(1e0 + closing_rank), 6) AS log_closing_rank, greatest(year + 22 - 2019, 0) AS years_since_ews FROM observed""", ("observed",))
def _(spark, sf):
    from cutline.schemas import OUTCOME_KEY

    return rounded(d.observed(spark, sf).select(
        "year", *OUTCOME_KEY, (F.col("closing_rank") - F.col("opening_rank")).alias("rank_spread"),
        F.log1p(F.col("opening_rank").cast("double")).alias("log_opening_rank"), F.log1p(F.col("closing_rank").cast("double")).alias("log_closing_rank"),
        as_long(scoring.years_since_ews(F.col("year") + 22)).alias("years_since_ews")))
