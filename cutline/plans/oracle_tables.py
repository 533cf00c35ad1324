"""Shared CTEs of the checking SQL: the same derived tables, written for a second engine."""

from cutline.plans.registry import cte

PROGRAM_CASE = """CASE p_type WHEN 'ECONOMY' THEN 'Computer Science and Engineering'
 WHEN 'LARGE' THEN 'Electronics and Communication Engineering' WHEN 'MEDIUM' THEN 'Electrical Engineering'
 WHEN 'PROMO' THEN 'Mechanical Engineering' WHEN 'SMALL' THEN 'Civil Engineering'
 WHEN 'STANDARD' THEN 'Chemistry' END"""
TYPE_CASE = "CASE k % 4 WHEN 0 THEN 'IIT' WHEN 1 THEN 'NIT' WHEN 2 THEN 'IIIT' ELSE 'GFTI' END"
QUOTA_CASE = "CASE k % 5 WHEN 0 THEN 'HS' WHEN 1 THEN 'OS' WHEN 2 THEN 'STATE' ELSE 'AI' END"
OUTCOME = "institute, program, category, quota, gender, is_pwd, round"
CHOICE = "institute, program, category, quota, gender, is_pwd"
BRANCH = "institute, program, category, is_pwd, gender, quota"
HISTORY = "institute, program, category, quota, gender"


def same(a: str, b: str, columns: str) -> str:
    return " AND ".join(f"{a}.{c.strip()} = {b}.{c.strip()}" for c in columns.split(","))


cte("lp", "SELECT * FROM lineitem JOIN part ON l_partkey = p_partkey")


def _cube(k: str) -> str:
    return f"""SELECT year, round, 'Institute ' || k AS institute, {TYPE_CASE} AS institute_type,
 'NATION_' || (k % 25) AS institute_state, {QUOTA_CASE} AS quota, {PROGRAM_CASE} AS program,
 CASE l_returnflag WHEN 'R' THEN 'OPEN' WHEN 'A' THEN 'OBC-NCL' ELSE 'SC' END AS category,
 CASE l_linestatus WHEN 'O' THEN 'Gender-Neutral' ELSE 'Female-only' END AS gender, is_pwd,
 CAST(CASE WHEN p_type = 'LARGE' THEN 5 ELSE 4 END AS BIGINT) AS duration_years,
 CASE WHEN p_type = 'LARGE' THEN 'Integrated Master' ELSE 'Bachelor of Technology' END AS degree_type,
 CAST(floor(min(l_extendedprice)) AS BIGINT) AS opening_rank, CAST(floor(max(l_extendedprice)) AS BIGINT) AS closing_rank
 FROM (SELECT *, CAST(year(l_shipdate) AS BIGINT) AS year, CAST(quarter(l_shipdate) AS BIGINT) AS round, {k} AS k, p_size > 45 AS is_pwd FROM lp)
 GROUP BY year, round, k, p_type, l_returnflag, l_linestatus, is_pwd"""


cte("observed", _cube("l_suppkey"), ("lp",))
cte("observed_b", _cube("CAST(substring(p_brand, 7, 4) AS BIGINT)"), ("lp",))

cte("raw", f"""SELECT CAST(year(l_shipdate) AS BIGINT) AS year, CAST(quarter(l_shipdate) AS BIGINT) AS round,
 (CASE l_suppkey % 4 WHEN 0 THEN 'Indian Institute of Technology ' WHEN 1 THEN 'National Institute of Technology '
  WHEN 2 THEN 'IIIT ' ELSE 'University of Technology ' END) || l_suppkey || (CASE WHEN l_linenumber = 2 THEN '  ' ELSE '' END) AS raw_institute,
 ({PROGRAM_CASE}) || CASE WHEN l_linenumber = 5 THEN '' WHEN p_type = 'LARGE' THEN ' (5 Years, Integrated Master)' ELSE ' (4 Years, Bachelor of Technology)' END AS raw_program,
 CASE (l_linenumber + l_suppkey) % 6 WHEN 0 THEN 'AI' WHEN 1 THEN 'HS' WHEN 2 THEN 'OS' WHEN 3 THEN 'JK' WHEN 4 THEN '' ELSE 'n/a' END AS raw_quota,
 (CASE l_returnflag WHEN 'R' THEN 'OPEN' WHEN 'A' THEN 'OBC-NCL' ELSE 'SC' END) || (CASE WHEN p_size > 45 THEN ' (PwD)' ELSE '' END) AS raw_seat,
 CASE WHEN l_linenumber = 6 THEN '' WHEN l_linestatus = 'F' THEN 'Female-only (including Supernumerary)' ELSE 'Gender-Neutral' END AS raw_gender,
 CASE l_linenumber % 7 WHEN 0 THEN CAST(price AS VARCHAR) WHEN 1 THEN price || '.0' WHEN 2 THEN format('{{:,}}', price) WHEN 3 THEN price || 'P'
  WHEN 4 THEN ' ' || price || ' ' WHEN 5 THEN '--' ELSE '0.01' END AS raw_opening,
 CASE (l_linenumber + 3) % 7 WHEN 0 THEN CAST(price AS VARCHAR) WHEN 1 THEN price || '.0' WHEN 2 THEN format('{{:,}}', price) WHEN 3 THEN price || 'P'
  WHEN 4 THEN ' ' || price || ' ' WHEN 5 THEN '--' ELSE '0.01' END AS raw_closing,
 year(l_shipdate) || '_round_' || quarter(l_shipdate) || '.csv' AS source_file, l_orderkey * 8 + l_linenumber AS source_row_id, l_partkey AS source_seq
 FROM (SELECT *, CAST(floor(l_extendedprice) AS BIGINT) AS price FROM lp)""", ("lp",))


def _null(c: str) -> str:
    return f"CASE WHEN lower(trim({c})) IN ('','na','n/a','null','none','-','--','---','nan') THEN NULL ELSE {c} END"


cte("raw_nulls", "SELECT year, round, source_file, source_row_id, source_seq, " + ", ".join(
    f"{_null(c)} AS {c}" for c in ("raw_institute", "raw_program", "raw_quota", "raw_seat", "raw_gender", "raw_opening", "raw_closing"))
    + " FROM raw", ("raw",))


def _rank(c: str) -> str:
    t = f"replace(trim({c}), ',', '')"
    return (f"CASE WHEN regexp_full_match({t}, '[0-9]+[Pp]') THEN CAST(regexp_extract({t}, '^([0-9]+)', 1) AS BIGINT) "
            f"WHEN regexp_full_match({t}, '[+-]?([0-9]+[.]?[0-9]*|[.][0-9]+)([eE][+-]?[0-9]+)?') THEN CAST(trunc(CAST({t} AS DOUBLE)) AS BIGINT) END")


def _flag(c: str) -> str:
    return f"coalesce(regexp_full_match(replace(trim({c}), ',', ''), '[0-9]+[Pp]'), false)"


cte("ranked", f"""SELECT *, {_rank('raw_opening')} AS opening_rank, {_rank('raw_closing')} AS closing_rank,
 {_flag('raw_opening')} OR {_flag('raw_closing')} AS is_pwd_rank FROM raw_nulls""", ("raw_nulls",))
cte("kept", """SELECT * FROM ranked WHERE (opening_rank IS NOT NULL OR closing_rank IS NOT NULL)
 AND NOT coalesce(opening_rank <= 0, false) AND NOT coalesce(closing_rank <= 0, false)""", ("ranked",))

PROGRAM_RE = "^(.+?)\\s*\\(([0-9]+)\\s*Years?,\\s*(.+?)\\)$"
TYPE_FROM_NAME = """CASE WHEN upper({n}) LIKE '%INDIAN INSTITUTE OF TECHNOLOGY%' THEN 'IIT'
 WHEN upper({n}) LIKE '%NATIONAL INSTITUTE OF TECHNOLOGY%' THEN 'NIT'
 WHEN upper({n}) LIKE '%INDIAN INSTITUTE OF INFORMATION TECHNOLOGY%' OR upper({n}) LIKE '%IIIT%' THEN 'IIIT' ELSE 'GFTI' END"""
BASE = "trim(regexp_replace(upper(trim(raw_seat)), '\\s*\\(?\\s*PWD\\s*\\)?\\s*', '', 'g'))"
CATEGORY = f"""CASE WHEN {BASE} LIKE 'OPEN%' OR {BASE} LIKE 'GEN%' THEN 'OPEN' WHEN {BASE} LIKE 'OBC%' THEN 'OBC-NCL'
 WHEN {BASE} LIKE 'SC%' THEN 'SC' WHEN {BASE} LIKE 'ST%' THEN 'ST' WHEN {BASE} LIKE 'EWS%' THEN 'EWS' ELSE 'OPEN' END"""
QUOTA = """CASE WHEN raw_quota IS NULL OR trim(raw_quota) = '' THEN 'AI'
 WHEN upper(trim(raw_quota)) IN ('AI','HS','OS') THEN upper(trim(raw_quota)) ELSE 'STATE' END"""
GENDER = "CASE WHEN lower(raw_gender) LIKE '%female%' THEN 'Female-only' ELSE 'Gender-Neutral' END"

cte("normalised", f"""SELECT *, trim(raw_institute) AS institute, {TYPE_FROM_NAME.format(n='raw_institute')} AS institute_type,
 CASE WHEN regexp_matches(trim(raw_program), '{PROGRAM_RE}') THEN trim(regexp_extract(trim(raw_program), '{PROGRAM_RE}', 1)) ELSE trim(raw_program) END AS program,
 CASE WHEN regexp_matches(trim(raw_program), '{PROGRAM_RE}') THEN CAST(regexp_extract(trim(raw_program), '{PROGRAM_RE}', 2) AS BIGINT) END AS duration_years,
 CASE WHEN regexp_matches(trim(raw_program), '{PROGRAM_RE}') THEN trim(regexp_extract(trim(raw_program), '{PROGRAM_RE}', 3)) END AS degree_type,
 {CATEGORY} AS category, upper(raw_seat) LIKE '%(PWD)%' AS is_pwd, {GENDER} AS gender, {QUOTA} AS quota FROM kept""", ("kept",))
cte("cleaned", """SELECT * EXCLUDE (rn) FROM (SELECT *, row_number() OVER (PARTITION BY year, round, institute, program, quota, category, is_pwd, gender
 ORDER BY source_file, source_row_id, source_seq) AS rn FROM normalised) WHERE rn = 1""", ("normalised",))

cte("dynamics", "SELECT CAST(year(l_shipdate) AS BIGINT) AS year, count(*) * 1000 AS applicants FROM lineitem GROUP BY ALL")
cte("cohorts", "SELECT CAST(year(o_orderdate) AS BIGINT) AS year, count(*) + 1000000 AS total_candidates FROM orders GROUP BY ALL")


def _forecasts(src: str) -> str:
    return f"""SELECT year + 1 AS origin, {OUTCOME}, institute_type, duration_years, degree_type,
 closing_rank AS last_closing_rank, avg(closing_rank) OVER w AS hist_mean_closing_rank, stddev_samp(closing_rank) OVER w AS hist_std_closing_rank,
 count(*) OVER w AS hist_year_count,
 CASE WHEN lead(year) OVER o = year + 1 THEN lead(closing_rank) OVER o END AS actual_closing_rank
 FROM {src} WINDOW o AS (PARTITION BY {OUTCOME} ORDER BY year),
 w AS (PARTITION BY {OUTCOME} ORDER BY year ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW)"""


def _errors(src: str) -> str:
    return f"""SELECT *, actual_closing_rank - predicted_closing_rank AS residual, abs(actual_closing_rank - predicted_closing_rank) AS abs_residual,
 CASE WHEN actual_closing_rank <= 5000 THEN '1-5k' WHEN actual_closing_rank <= 15000 THEN '5k-15k' WHEN actual_closing_rank <= 50000 THEN '15k-50k'
  WHEN actual_closing_rank <= 100000 THEN '50k-100k' ELSE '100k+' END AS rank_band FROM (
 SELECT *, 'naive_last_year' AS model, CAST(last_closing_rank AS DOUBLE) AS predicted_closing_rank FROM {src}
 UNION ALL BY NAME SELECT *, 'historical_mean' AS model, hist_mean_closing_rank AS predicted_closing_rank FROM {src})
 WHERE actual_closing_rank IS NOT NULL AND origin BETWEEN 1997 AND 2001"""


for suffix in ("", "_b"):
    cte(f"forecasts{suffix}", _forecasts(f"observed{suffix}"), (f"observed{suffix}",))
    cte(f"errors{suffix}", _errors(f"forecasts{suffix}"), (f"forecasts{suffix}",))

LIFTED = "CAST(ceil((n - 1) * least(1e0, ceil((n + 1) * 0.9e0) / n)) AS BIGINT)"


def lifted(src: str, keys: str, value: str = "abs_residual") -> str:
    part = f"PARTITION BY {keys} " if keys else ""
    out = f"{keys}, " if keys else ""
    return f"""SELECT {out}n, {value} AS abs_residual_quantile FROM (SELECT *, row_number() OVER ({part}ORDER BY {value}) - 1 AS i,
 count(*) OVER ({part.strip()}) AS n FROM {src}) WHERE i = {LIFTED}"""


METRICS = """count(*) AS n, round(avg(abs(residual)), 6) AS mae, round(sqrt(avg(residual * residual)), 6) AS rmse,
 round(median(abs(residual)), 6) AS median_absolute_error,
 round(CASE WHEN count(*) < 2 THEN NULL WHEN var_pop(actual_closing_rank) = 0 THEN CASE WHEN sum(residual * residual) = 0 THEN 1e0 ELSE 0e0 END
  ELSE 1e0 - sum(residual * residual) / (var_pop(actual_closing_rank) * count(*)) END, 6) AS r2"""

cte("pool", """SELECT e.model, o.origin AS for_origin, e.institute_type, e.round, e.abs_residual
 FROM errors e JOIN (SELECT unnest([1997,1998,1999,2000,2001]) AS origin) o ON e.origin < o.origin WHERE e.model = 'naive_last_year'""", ("errors",))
cte("pool_whole", lifted("pool", "model, for_origin"), ("pool",))
cte("pool_groups", lifted("pool", "model, for_origin, institute_type, round"), ("pool",))
cte("intervals", """SELECT e.*, w.n AS calibration_count, w.abs_residual_quantile AS interval_quantile_global,
 CAST(CASE WHEN g.n >= 100 THEN g.abs_residual_quantile ELSE w.abs_residual_quantile END AS DOUBLE) AS radius
 FROM errors e LEFT JOIN pool_groups g ON e.model = g.model AND e.origin = g.for_origin AND e.institute_type = g.institute_type AND e.round = g.round
 LEFT JOIN pool_whole w ON e.model = w.model AND e.origin = w.for_origin WHERE e.model = 'naive_last_year'""", ("errors", "pool_groups", "pool_whole"))
cte("folds", f"SELECT origin, model, {METRICS} FROM errors WHERE origin >= 1999 GROUP BY ALL", ("errors",))

cte("naive_b", "SELECT * FROM errors_b WHERE model = 'naive_last_year'", ("errors_b",))
cte("calibration", f"""SELECT '__default__' AS institute_type_str, CAST(-1 AS BIGINT) AS round, n AS count, CAST(abs_residual_quantile AS DOUBLE) AS abs_residual_quantile
 FROM ({lifted('naive_b', '')}) UNION ALL
 SELECT institute_type, round, n, CAST(abs_residual_quantile AS DOUBLE) FROM ({lifted('naive_b', 'institute_type, round')})""", ("naive_b",))

cte("frame_b", f"""SELECT CAST(2002 AS BIGINT) AS year, {OUTCOME}, institute_type, institute_state, duration_years, degree_type, closing_rank AS last_closing_rank
 FROM observed_b WHERE year = 2001""", ("observed_b",))
cte("profiles", """SELECT c_custkey AS profile_id, CAST(greatest(1, floor(abs(c_acctbal) * 10)) AS BIGINT) AS main_rank,
 CASE WHEN c_custkey % 3 <> 0 THEN CAST(greatest(1, floor(abs(c_acctbal) * 5)) AS BIGINT) END AS advanced_rank,
 CASE c_custkey % 3 WHEN 0 THEN 'OPEN' WHEN 1 THEN 'OBC-NCL' ELSE 'SC' END AS category,
 CASE WHEN (c_custkey // 3) % 2 = 0 THEN 'Gender-Neutral' ELSE 'Female-only' END AS gender,
 CASE WHEN c_custkey % 10 <> 7 THEN 'nation_' || c_nationkey END AS home_state, c_custkey % 20 = 0 AS is_pwd,
 CASE WHEN c_custkey % 4 = 1 THEN ['NIT','IIIT'] END AS pref_inst_types,
 CASE WHEN c_custkey % 5 = 2 THEN ['computer','Electr'] END AS pref_branch_keywords,
 CASE WHEN c_custkey % 7 = 3 THEN ['AI','OS'] END AS pref_quotas,
 c_custkey % 4 + 1 AS round, CASE c_custkey % 3 WHEN 0 THEN 10 WHEN 1 THEN 20 ELSE 30 END AS top_n,
 CASE (c_custkey // 2) % 4 WHEN 1 THEN 'highest_probability' WHEN 2 THEN 'most_competitive' WHEN 3 THEN 'safest_backup' ELSE 'best_fit' END AS sort_mode
 FROM customer""")
cte("pairs", """SELECT p.profile_id, p.main_rank, p.advanced_rank, p.top_n, p.sort_mode, p.home_state, u.*
 FROM profiles p JOIN frame_b u ON p.category = u.category AND p.gender = u.gender AND p.round = u.round AND p.is_pwd = u.is_pwd
 WHERE (u.quota <> 'HS' OR coalesce(lower(u.institute_state) = lower(p.home_state), false))
 AND (p.pref_quotas IS NULL OR list_contains(p.pref_quotas, u.quota))
 AND (p.advanced_rank IS NOT NULL OR u.institute_type <> 'IIT')
 AND (p.pref_inst_types IS NULL OR list_contains(p.pref_inst_types, u.institute_type))
 AND (p.pref_branch_keywords IS NULL OR contains(lower(u.program), lower(p.pref_branch_keywords[1])) OR contains(lower(u.program), lower(p.pref_branch_keywords[2])))""",
    ("profiles", "frame_b"))
cte("routed", """SELECT *, CASE WHEN institute_type = 'IIT' THEN advanced_rank ELSE main_rank END AS rank_used,
 CASE WHEN institute_type = 'IIT' THEN 'JEE_ADVANCED' ELSE 'JEE_MAIN' END AS rank_type_used,
 greatest(1, last_closing_rank) AS predicted_closing_rank,
 'choice-' || left(sha256(concat_ws(chr(31), lower(institute), lower(institute_type), lower(program), lower(quota), lower(category), lower(gender), CAST(is_pwd AS VARCHAR), CAST(round AS VARCHAR))), 24) AS choice_id
 FROM pairs""", ("pairs",))
cte("usable", "SELECT * FROM calibration WHERE institute_type_str = '__default__' OR count >= 100", ("calibration",))
cte("uncertain", """SELECT r.*, CASE WHEN q > 0 THEN q ELSE 150e0 * 1.6448536269514722e0 END AS uncertainty_radius FROM (
 SELECT r.*, coalesce(e.abs_residual_quantile, t.q, d.q) AS q FROM routed r
 LEFT JOIN usable e ON r.institute_type = e.institute_type_str AND r.round = e.round
 LEFT JOIN (SELECT institute_type_str, arg_min(abs_residual_quantile, round) AS q FROM usable GROUP BY 1) t ON r.institute_type = t.institute_type_str
 CROSS JOIN (SELECT max(abs_residual_quantile) AS q FROM usable WHERE institute_type_str = '__default__') d) r""", ("routed", "usable"))
cte("draws", """SELECT list(z ORDER BY z) AS zs FROM (SELECT sqrt(-2e0 * ln((i + 0.5e0) / 1000e0)) * cos(2e0 * pi() * (i * 0.6180339887498949e0 - floor(i * 0.6180339887498949e0))) AS z
 FROM range(1000) t(i))""")
cte("likely", """SELECT u.*, uncertainty_radius / 1.6448536269514722e0 AS std_dev, predicted_closing_rank - rank_used AS margin,
 CASE WHEN rank_used <= 1 THEN 1e0 ELSE len(list_filter(zs, lambda z: predicted_closing_rank + z * (uncertainty_radius / 1.6448536269514722e0) >= rank_used)) / 1000e0 END AS admission_probability,
 greatest(rank_used, 1) / CAST(greatest(predicted_closing_rank, 1) AS DOUBLE) AS rank_ratio
 FROM uncertain u CROSS JOIN draws""", ("uncertain", "draws"))
cte("parts_", """SELECT *, CASE WHEN rank_ratio <= 0.80e0 THEN 'safe_backup' WHEN rank_ratio <= 1.05e0 THEN 'best_realistic' WHEN rank_ratio <= 1.40e0 THEN 'ambitious_reach' ELSE 'unlikely_reach' END AS recommendation_bucket,
 CASE WHEN admission_probability >= 0.80e0 THEN 'Safe' WHEN admission_probability >= 0.40e0 THEN 'Moderate' ELSE 'Ambitious' END AS confidence_label,
 CASE institute_type WHEN 'IIT' THEN 1e0 WHEN 'NIT' THEN 0.78e0 WHEN 'IIIT' THEN 0.72e0 WHEN 'GFTI' THEN 0.48e0 ELSE 0.5e0 END AS institute_score,
 CASE WHEN contains(lower(program), 'computer science') THEN 1e0 WHEN contains(lower(program), 'electronics and communication') THEN 0.88e0
  WHEN contains(lower(program), 'electronics') THEN 0.84e0 WHEN contains(lower(program), 'electrical') THEN 0.78e0 WHEN contains(lower(program), 'mechanical') THEN 0.64e0
  WHEN contains(lower(program), 'civil') THEN 0.52e0 ELSE 0.55e0 END AS branch_score,
 margin / CAST(greatest(predicted_closing_rank, 1) AS DOUBLE) AS margin_score,
 ln(1e0 + greatest(predicted_closing_rank, 1)) AS lp_, min(ln(1e0 + greatest(predicted_closing_rank, 1))) OVER (PARTITION BY profile_id) AS lo_, max(ln(1e0 + greatest(predicted_closing_rank, 1))) OVER (PARTITION BY profile_id) AS hi_
 FROM likely""", ("likely",))
cte("parts2_", """SELECT *, CASE WHEN hi_ - lo_ <= 0 THEN 1e0 ELSE least(1e0, greatest(0e0, 1e0 - (lp_ - lo_) / (hi_ - lo_))) END AS competitiveness_score,
 least(1e0, greatest(0e0, CASE WHEN admission_probability > 0.85e0 THEN 1e0 - 0.18e0 * least(1e0, greatest(0e0, (admission_probability - 0.85e0) / 0.15e0)) ELSE least(admission_probability / 0.75e0, 1e0) END)) AS admissibility_score,
 least(1e0, greatest(0e0, exp(-power(ln(greatest(predicted_closing_rank, 1) / CAST(greatest(rank_used, 1) AS DOUBLE)) - ln(1.18e0), 2) / 1.125e0) * least(admission_probability / 0.35e0, 1e0))) AS fit_score,
 admission_probability * least(1e0, greatest(0e0, margin_score)) AS safety_score FROM parts_""", ("parts_",))
cte("scored", """SELECT *, round_even(100e0 * (0.45e0 * desirability_score * greatest(admissibility_score, fit_score) + 0.30e0 * fit_score + 0.25e0 * admissibility_score), 4) AS recommendation_score
 FROM (SELECT *, 0.45e0 * competitiveness_score + 0.25e0 * institute_score + 0.30e0 * branch_score AS desirability_score FROM parts2_)""", ("parts2_",))
cte("ordered", """SELECT *, row_number() OVER (PARTITION BY profile_id ORDER BY
 CASE sort_mode WHEN 'highest_probability' THEN admission_probability WHEN 'most_competitive' THEN -predicted_closing_rank WHEN 'safest_backup' THEN safety_score ELSE recommendation_score END DESC,
 CASE sort_mode WHEN 'safest_backup' THEN admission_probability ELSE recommendation_score END DESC, choice_id) AS sort_position
 FROM scored WHERE recommendation_bucket <> 'unlikely_reach'""", ("scored",))
