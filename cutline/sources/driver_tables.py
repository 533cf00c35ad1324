"""The star-schema test tables read as cutoff tables, profiles, raw rows, seats and files.

Everything here is row-wise derivation plus the one aggregate that makes the cutoff cube, so
work grows with lineitem, part, customer, documents and embeddings.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from cutline.sources.tables import stored

FIRST_YEAR, FINAL_YEAR = 1995, 2001
YEARS = list(range(FIRST_YEAR, FINAL_YEAR + 1))
PREDICTION_YEAR = FINAL_YEAR + 1
EVALUATION_YEARS = [1999, 2000, 2001]
ORIGIN_START = 1997
ORIGINS = list(range(ORIGIN_START, FINAL_YEAR + 1))

PROGRAMS = {
    "ECONOMY": "Computer Science and Engineering",
    "LARGE": "Electronics and Communication Engineering",
    "MEDIUM": "Electrical Engineering",
    "PROMO": "Mechanical Engineering",
    "SMALL": "Civil Engineering",
    "STANDARD": "Chemistry",
}


def read(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{table}.parquet")


def _pick(c: Column, pairs: dict, default=None) -> Column:
    chain = None
    for k, v in pairs.items():
        chain = F.when(c == k, v) if chain is None else chain.when(c == k, v)
    return chain.otherwise(default) if default is not None else chain


def _at(index: Column, values: list) -> Column:
    """values[index] from a constant array: short generated code, unlike a CASE chain."""
    return F.element_at(F.lit(values), (index + 1).cast("int"))


def program_name(p_type: Column) -> Column:
    return F.try_element_at(F.create_map(*[F.lit(x) for kv in PROGRAMS.items() for x in kv]), p_type)


def institute_columns(k: Column) -> dict[str, Column]:
    return {
        "institute": F.concat(F.lit("Institute "), k.cast("string")),
        "institute_type": _at(k % 4, ["IIT", "NIT", "IIIT", "GFTI"]),
        "institute_state": F.concat(F.lit("NATION_"), (k % 25).cast("string")),
        "quota": _at(k % 5, ["HS", "OS", "STATE", "AI", "AI"]),
    }


def _lines_with_parts(spark: SparkSession, sf_dir: str) -> DataFrame:
    lines = read(spark, sf_dir, "lineitem")
    parts = read(spark, sf_dir, "part").select("p_partkey", "p_brand", "p_type", "p_size")
    return lines.join(parts, lines["l_partkey"] == parts["p_partkey"])


def observed(spark: SparkSession, sf_dir: str, grain: str = "supplier") -> DataFrame:
    """The observed table as its readers see it: stored once, partitioned by season."""
    return stored(spark, f"observed {grain} {sf_dir}", lambda: build_observed(spark, sf_dir, grain), "year")


def build_observed(spark: SparkSession, sf_dir: str, grain: str = "supplier") -> DataFrame:
    """Observed cutoffs: one row per (year, outcome key). ``supplier`` grain grows with the
    number of suppliers; ``brand`` grain is a fixed catalogue of 25 institutes."""
    number = F.col("l_suppkey") if grain == "supplier" else F.substring("p_brand", 7, 4).cast("bigint")
    rows = _lines_with_parts(spark, sf_dir).select(
        F.year("l_shipdate").cast("bigint").alias("year"), F.quarter("l_shipdate").cast("bigint").alias("round"),
        number.alias("k"), "p_type", "l_returnflag", "l_linestatus", (F.col("p_size") > 45).alias("is_pwd"),
        "l_extendedprice",
    )
    cube = rows.groupBy("year", "round", "k", "p_type", "l_returnflag", "l_linestatus", "is_pwd").agg(
        F.floor(F.min("l_extendedprice")).cast("bigint").alias("opening_rank"),
        F.floor(F.max("l_extendedprice")).cast("bigint").alias("closing_rank"),
    )
    who = institute_columns(F.col("k"))
    return cube.select(
        "year", "round", *[c.alias(n) for n, c in who.items()], program_name(F.col("p_type")).alias("program"),
        _pick(F.col("l_returnflag"), {"R": "OPEN", "A": "OBC-NCL"}, "SC").alias("category"),
        _pick(F.col("l_linestatus"), {"O": "Gender-Neutral"}, "Female-only").alias("gender"), "is_pwd",
        F.when(F.col("p_type") == "LARGE", 5).otherwise(4).cast("bigint").alias("duration_years"),
        F.when(F.col("p_type") == "LARGE", "Integrated Master").otherwise("Bachelor of Technology").alias("degree_type"),
        "opening_rank", "closing_rank",
    )


def raw_rounds(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Untidy text rows as a published round file has them, one per lineitem row."""
    n, k = F.col("l_linenumber"), F.col("l_suppkey")
    digits, grouped = F.col("digits"), F.col("grouped")

    def rank(shift: int) -> Column:
        """One of seven spellings: plain, .0, grouped, P suffix, padded, dashes, 0.01."""
        style = (n + shift) % 7
        body = F.when(style == 2, grouped).when(style < 5, digits).otherwise("")
        return F.concat(_at(style, ["", "", "", "", " ", "", ""]), body, _at(style, ["", ".0", "", "P", " ", "--", "0.01"]))

    price = F.floor("l_extendedprice").cast("bigint")
    rows = _lines_with_parts(spark, sf_dir).select(
        "*", price.cast("string").alias("digits"), F.format_number(price, 0).alias("grouped"), program_name(F.col("p_type")).alias("program"))
    is_long = (F.col("p_type") == "LARGE").cast("int")
    return rows.select(
        F.year("l_shipdate").cast("bigint").alias("year"), F.quarter("l_shipdate").cast("bigint").alias("round"),
        F.concat(_at(k % 4, ["Indian Institute of Technology ", "National Institute of Technology ", "IIIT ", "University of Technology "]),
                 k.cast("string"), _at(n, ["", "", "  ", "", "", "", "", ""])).alias("Institute"),
        F.concat("program", _at((n != 5).cast("int") * (is_long + 1), [
            "", " (4 Years, Bachelor of Technology)", " (5 Years, Integrated Master)"])).alias("Academic Program Name"),
        _at((n + k) % 6, ["AI", "HS", "OS", "JK", "", "n/a"]).alias("Quota"),
        F.concat(_pick(F.col("l_returnflag"), {"R": "OPEN", "A": "OBC-NCL"}, "SC"),
                 _at((F.col("p_size") > 45).cast("int"), ["", " (PwD)"])).alias("Seat Type"),
        F.when(n == 6, "").when(F.col("l_linestatus") == "F", "Female-only (including Supernumerary)")
        .otherwise("Gender-Neutral").alias("Gender"),
        rank(0).alias("Opening Rank"), rank(3).alias("Closing Rank"),
        F.concat(F.year("l_shipdate"), F.lit("_round_"), F.quarter("l_shipdate"), F.lit(".csv")).alias("source_file"),
        (F.col("l_orderkey") * 8 + n).alias("source_row_id"), F.col("l_partkey").alias("source_seq"),
    )


RAW_ORDER = ("source_file", "source_row_id", "source_seq")


def dynamics(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Applicants per year: a thousand per line shipped that year."""
    return read(spark, sf_dir, "lineitem").groupBy(F.year("l_shipdate").cast("bigint").alias("year")).agg(
        (F.count(F.lit(1)) * 1000).alias("applicants"))


def cohorts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Cohort size per season: a base plus the orders of that year."""
    return read(spark, sf_dir, "orders").groupBy(F.year("o_orderdate").cast("bigint").alias("year")).agg(
        (F.count(F.lit(1)) + 1_000_000).alias("total_candidates"))


def profiles(spark: SparkSession, sf_dir: str) -> DataFrame:
    k, bal = F.col("c_custkey"), F.abs("c_acctbal")
    some = lambda cond, values: F.when(cond, F.array(*[F.lit(v) for v in values]))
    return read(spark, sf_dir, "customer").select(
        k.alias("profile_id"),
        F.greatest(F.lit(1), F.floor(bal * 10)).cast("bigint").alias("main_rank"),
        F.when(k % 3 != 0, F.greatest(F.lit(1), F.floor(bal * 5)).cast("bigint")).alias("advanced_rank"),
        _pick(k % 3, {0: "OPEN", 1: "OBC-NCL"}, "SC").alias("category"),
        F.when(F.floor(k / 3) % 2 == 0, "Gender-Neutral").otherwise("Female-only").alias("gender"),
        F.when(k % 10 != 7, F.concat(F.lit("nation_"), F.col("c_nationkey").cast("string"))).alias("home_state"),
        (k % 20 == 0).alias("is_pwd"),
        some(k % 4 == 1, ["NIT", "IIIT"]).alias("pref_inst_types"),
        some(k % 5 == 2, ["computer", "Electr"]).alias("pref_branch_keywords"),
        some(k % 7 == 3, ["AI", "OS"]).alias("pref_quotas"),
        (k % 4 + 1).cast("bigint").alias("round"), _pick(k % 3, {0: 10, 1: 20}, 30).cast("int").alias("top_n"),
        _pick(F.floor(k / 2) % 4, {1: "highest_probability", 2: "most_competitive", 3: "safest_backup"}, "best_fit").alias("sort_mode"),
    )


def requests(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Profiles as sent, many of them out of the accepted domain."""
    k = F.col("profile_id")
    return profiles(spark, sf_dir).select(
        k, F.when(k % 17 == 0, 0).when(k % 19 == 0, 1_200_001).when(k % 23 != 0, F.col("main_rank")).cast("bigint").alias("main_rank"),
        F.when(k % 13 == 0, 50_001).otherwise(F.col("advanced_rank")).cast("bigint").alias("advanced_rank"),
        F.when(k % 11 == 0, "GENERAL").otherwise(F.col("category")).alias("category"),
        F.when(k % 29 == 0, "Any").otherwise(F.col("gender")).alias("gender"),
        F.when(k % 31 == 0, "").otherwise(F.col("home_state")).alias("home_state"),
        F.when(k % 37 == 0, F.array(F.lit("NIT"), F.lit("ABC"))).otherwise(F.col("pref_inst_types")).alias("pref_inst_types"),
        F.when(k % 41 == 0, F.array(F.lit(" "))).otherwise(F.col("pref_branch_keywords")).alias("pref_branch_keywords"),
        F.when(k % 43 == 0, F.array(F.lit("XX"))).otherwise(F.col("pref_quotas")).alias("pref_quotas"),
        (k % 8).cast("bigint").alias("round"), (k % 205).cast("int").alias("top_n"),
        F.when(k % 47 == 0, "random").otherwise(F.col("sort_mode")).alias("sort_mode"),
    )


def seats(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One seat pool per (brand, part type, category): a bounded catalogue."""
    k = F.substring("p_brand", 7, 4).cast("bigint")
    pools = read(spark, sf_dir, "part").select(k.alias("k"), "p_type").distinct()
    category = F.explode(F.array(F.lit("OPEN"), F.lit("OBC-NCL"), F.lit("SC"))).alias("category")
    return pools.select("k", "p_type", category).select(
        F.concat_ws("-", F.col("k").cast("string"), "p_type", "category").alias("seat_id"),
        institute_columns(F.col("k"))["institute"].alias("institute"),
        F.upper(program_name(F.col("p_type"))).alias("branch"), "category",
        F.when(F.col("k") % 3 == 0, "STATE_BOARD").otherwise("CENTRAL").alias("counselling"),
        (F.col("k") % 3 + 1).cast("int").alias("capacity"),
    )


def preferences(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Customers' wish lists: the (institute, branch) pools of their orders, first bought first.

    Wishes are reduced to distinct pools before the list is built, so a list never exceeds the
    catalogue (25 x 6) however many orders one customer has.
    """
    orders = read(spark, sf_dir, "orders").select("o_orderkey", "o_custkey")
    lines = _lines_with_parts(spark, sf_dir)
    k = F.substring("p_brand", 7, 4).cast("bigint")
    wishes = lines.join(orders, lines["l_orderkey"] == orders["o_orderkey"]).groupBy(
        "o_custkey", institute_columns(k)["institute"].alias("institute"), program_name(F.col("p_type")).alias("branch")
    ).agg(F.min("o_orderkey").alias("first_order"))
    lists = wishes.groupBy("o_custkey").agg(F.array_sort(F.collect_list(
        F.struct("first_order", "institute", "branch"))).alias("__w"))
    p = profiles(spark, sf_dir)
    return lists.join(p, lists["o_custkey"] == p["profile_id"]).select(
        F.col("profile_id").alias("candidate_id"), F.col("main_rank").alias("rank"), "category",
        F.transform("__w", lambda w: F.struct(
            w["institute"].alias("institute"), w["branch"].alias("branch"))).alias("preferences"))


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return read(spark, sf_dir, "documents").select("doc_id", "text", "lang", "source")


def vector_queries(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One query per label: the mean vector of all its members (labels are few)."""
    parts = read(spark, sf_dir, "embeddings").select("label", F.posexplode("embedding").alias("i", "x"))
    mean = parts.groupBy("label", "i").agg(F.avg(F.col("x").cast("double")).alias("m"))
    return mean.groupBy(F.col("label").cast("bigint").alias("query_id")).agg(
        F.transform(F.array_sort(F.collect_list(F.struct("i", "m"))), lambda s: s["m"]).alias("query_vector"))
