"""Scoring of (profile, candidate) rows and quota-balanced selection per profile.

All windows are per ``profile_id``: one group is the slice of the universe one applicant can
see, so its size does not depend on the number of applicants.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from cutline.functions import scoring, text
from cutline.schemas import BUCKETS, INSTITUTE_TYPES

# --- fixed values: share of each bucket in a full list of 100 -----------------------------
EXAMS = ["JEE_ADVANCED", "JEE_MAIN"]
CLASSES = {"rank_type_used": EXAMS, "recommendation_bucket": BUCKETS}
BUCKET_QUOTAS = {"safe_backup": 30, "best_realistic": 50, "ambitious_reach": 20}


def attach_uncertainty(rows: DataFrame, calibration: DataFrame, min_group: int = 100) -> DataFrame:
    """Radius by a cascade: exact (type, round), first round of the type, default, constant.

    ``calibration`` has (institute_type_str, round, count, abs_residual_quantile), one row per
    type and round plus ``__default__``: at most a few dozen rows, hence broadcast.
    """
    usable = calibration.where(
        (F.col("institute_type_str") == "__default__") | (F.col("count") >= min_group)
    )
    exact = usable.select(
        F.col("institute_type_str").alias("__t"), F.col("round").alias("__r"),
        F.col("abs_residual_quantile").alias("__exact"),
    )
    by_type = usable.groupBy(F.col("institute_type_str").alias("__t2")).agg(
        F.min_by("abs_residual_quantile", "round").alias("__type")
    )
    default = usable.where(F.col("institute_type_str") == "__default__").agg(
        F.max("abs_residual_quantile").alias("__default")
    )
    out = (
        rows.join(F.broadcast(exact), (F.col("institute_type") == F.col("__t")) & (F.col("round") == F.col("__r")), "left")
        .join(F.broadcast(by_type), F.col("institute_type") == F.col("__t2"), "left")
        .join(F.broadcast(default), how="left")
    )
    found = F.coalesce(F.col("__exact"), F.col("__type"), F.col("__default"))
    radius = F.when(found > 0, found.cast("double")).otherwise(scoring.DEFAULT_STD * scoring.Z_90)
    return out.withColumns({
        "uncertainty_radius": radius, "std_dev": radius / F.lit(scoring.Z_90),
    }).drop("__t", "__r", "__exact", "__t2", "__type", "__default")


def score_candidates(rows: DataFrame, simulate: bool = True) -> DataFrame:
    """All per-row scores. Input: predicted_closing_rank, rank_used, std_dev, uncertainty_radius."""
    predicted, rank = F.col("predicted_closing_rank"), F.col("rank_used")
    p = (
        scoring.exceedance(predicted, F.col("std_dev"), rank) if simulate
        else scoring.point_likelihood(predicted, rank)
    )
    radius = F.col("uncertainty_radius") if simulate else F.lit(0.0)
    low, mid, high = scoring.interval(predicted, radius)
    step1 = rows.withColumns({
        "admission_probability": p,
        "ci_lower_5": low, "expected_cutoff_50": mid, "ci_upper_95": high,
        "margin": predicted - rank,
        "margin_score": scoring.margin_score(rank, predicted),
        "rank_ratio": rank / F.greatest(predicted.cast("double"), F.lit(1.0)),
        "recommendation_bucket": scoring.ratio_bucket(rank, predicted),
        "institute_score": scoring.institute_score(F.col("institute_type")),
        "branch_score": text.branch_score(F.col("program")),
        "__log": F.log1p(F.greatest(predicted.cast("double"), F.lit(1.0))),
    })
    mine = Window.partitionBy("profile_id")
    step2 = step1.withColumn(
        "competitiveness_score",
        scoring.competitiveness(F.col("__log"), F.min("__log").over(mine), F.max("__log").over(mine)),
    ).drop("__log")
    prob = F.col("admission_probability")
    step3 = step2.withColumns({
        "model_probability_percent": scoring.decimals(prob * 100, 1, even=True),
        "confidence_label": scoring.confidence_label(prob),
        "desirability_score": scoring.desirability(
            F.col("competitiveness_score"), F.col("institute_score"), F.col("branch_score")),
        "admissibility_score": scoring.admissibility(prob),
        "fit_score": scoring.fit(predicted, rank, prob),
        "safety_score": scoring.safety(prob, predicted, rank),
    })
    return step3.withColumn("recommendation_score", scoring.recommendation_score(
        F.col("desirability_score"), F.col("admissibility_score"), F.col("fit_score")))


def bucket_counts(scored: DataFrame) -> DataFrame:
    """Counts per profile by bucket and by institute type, absent classes as 0."""
    return scored.groupBy("profile_id").agg(
        *[F.count_if(F.col("recommendation_bucket") == b).alias(b) for b in BUCKETS],
        *[F.count_if(F.col("institute_type") == t).alias(t) for t in INSTITUTE_TYPES],
    )


def sort_keys(mode: str, tie: Column) -> list[Column]:
    desc = lambda c: F.col(c).desc()
    return {
        "best_fit": [desc("recommendation_score")],
        "highest_probability": [desc("admission_probability"), desc("recommendation_score")],
        "most_competitive": [F.col("predicted_closing_rank").asc(), desc("recommendation_score")],
        "safest_backup": [desc("safety_score"), desc("admission_probability")],
    }[mode] + [tie]


def order_candidates(scored: DataFrame) -> DataFrame:
    """Drop far reaches and number the rest per profile by the profile's own sort mode.

    The three leading sort columns depend on the mode of the row's profile, so one window
    serves every mode; choice_id makes the order total.
    """
    mode = F.coalesce(F.col("sort_mode"), F.lit("best_fit"))
    score, prob = F.col("recommendation_score"), F.col("admission_probability")
    first = (
        F.when(mode == "highest_probability", prob)
        .when(mode == "most_competitive", -F.col("predicted_closing_rank").cast("double"))
        .when(mode == "safest_backup", F.col("safety_score")).otherwise(score)
    )
    second = F.when(mode == "safest_backup", prob).otherwise(score)
    w = Window.partitionBy("profile_id").orderBy(first.desc(), second.desc(), F.col("choice_id"))
    return scored.where(F.col("recommendation_bucket") != "unlikely_reach").withColumn(
        "sort_position", F.row_number().over(w)
    )


def scaled_quota(bucket: str, top_n: Column) -> Column:
    """Largest-remainder share of ``top_n``; equal remainders favour the earlier bucket."""
    total = sum(BUCKET_QUOTAS.values())
    names = list(BUCKET_QUOTAS)
    share = {b: F.floor(top_n * q / F.lit(total)).cast("int") for b, q in BUCKET_QUOTAS.items()}
    # remainders over integers, so ties are exact
    rest = {b: F.pmod(top_n * F.lit(q), F.lit(total)) for b, q in BUCKET_QUOTAS.items()}
    left = top_n - sum(share.values(), F.lit(0))
    ahead = F.lit(0)
    for i, other in enumerate(names):
        if other == bucket:
            continue
        earlier = i < names.index(bucket)
        wins = (rest[other] >= rest[bucket]) if earlier else (rest[other] > rest[bucket])
        ahead = ahead + wins.cast("int")
    return F.greatest(F.lit(0), share[bucket] + (ahead < left).cast("int")).cast("int")


def is_balanced() -> Column:
    return F.coalesce(F.col("sort_mode"), F.lit("best_fit")) == "best_fit"


def whole_slice(window):
    """All rows of an ordered window: shares its sort with running counts."""
    return window.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)


def quota_and_backfill(ordered: DataFrame) -> DataFrame:
    """Heads of each bucket up to its quota, then the best of the rest up to top_n.

    Adds ``selected`` and ``pick_order`` (bucket heads in bucket order, then backfill). Lists
    sorted by another mode than best_fit take the plain first ``top_n``.
    """
    top_n = F.col("top_n")
    # one order serves all windows, so a slice is sorted once
    mine = Window.partitionBy("profile_id").orderBy("sort_position")
    head = group = None
    for i, b in enumerate(BUCKET_QUOTAS):
        hit = F.col("recommendation_bucket") == b
        enough = F.sum(hit.cast("int")).over(mine) <= scaled_quota(b, top_n)
        head = F.when(hit, enough) if head is None else head.when(hit, enough)
        group = F.when(hit, i) if group is None else group.when(hit, i)
    marked = ordered.withColumn("__head", F.when(is_balanced(), head).otherwise(F.col("sort_position") <= top_n))
    counted = marked.withColumns({
        "__n_head": F.sum(F.col("__head").cast("int")).over(whole_slice(mine)),
        "__fill": F.sum((~F.col("__head")).cast("int")).over(mine),
    })
    filled = ~F.col("__head") & (F.col("__fill") <= top_n - F.col("__n_head"))
    return counted.withColumns({
        "selected": F.col("__head") | filled,
        "pick_order": F.struct(
            F.when(F.col("__head"), group).otherwise(F.lit(len(BUCKET_QUOTAS))).cast("int").alias("group"),
            F.col("sort_position").cast("bigint").alias("at")),
    }).drop("__head", "__n_head", "__fill")


def _swap_in(pool: DataFrame, column: str, value: str, step: int, wanted: Column) -> DataFrame:
    """Give class ``value`` of ``column`` a place: its best unpicked row replaces the last
    picked row whose own class is picked more than once. At most one swap per profile."""
    mine = Window.partitionBy("profile_id")
    picked, has = F.col("selected"), F.col(column) == value
    of = {c: picked & (F.col(column) == c) for c in CLASSES[column]}
    # the last picked row of each class and the class's number, so one window finds both sides of a swap
    marked = pool.withColumns({
        "__have": F.max((picked & has).cast("int")).over(mine),
        "__best": F.min(F.when(~picked & has, F.col("sort_position"))).over(mine),
        "__n": F.sum(picked.cast("int")).over(mine),
        **{f"__n_{c}": F.sum(cond.cast("int")).over(mine) for c, cond in of.items()},
        **{f"__last_{c}": F.max(F.when(cond, F.col("pick_order"))).over(mine) for c, cond in of.items()},
    }).withColumn("__last", F.greatest(*[F.when(F.col(f"__n_{c}") > 1, F.col(f"__last_{c}")) for c in of]))
    swap = F.coalesce(
        wanted & (F.col("__have") == 0) & F.col("__best").isNotNull() & F.col("__last").isNotNull()
        & (F.col("__n") >= F.col("top_n")), F.lit(False),
    )
    comes = swap & (F.col("sort_position") == F.col("__best")) & ~picked
    goes = swap & picked & (F.col("pick_order") == F.col("__last"))
    return marked.withColumns({
        "selected": F.when(comes, True).when(goes, False).otherwise(picked),
        "pick_order": F.when(comes, F.struct(
            F.lit(len(BUCKET_QUOTAS) + 1).alias("group"), F.lit(step).cast("bigint").alias("at"))).otherwise(F.col("pick_order")),
    }).drop("__have", "__best", "__n", "__last", *[f"__{x}_{c}" for x in ("n", "last") for c in of])


def _within_reach(ordered: DataFrame, spares: dict) -> DataFrame:
    """Rows that a list can take: the first ``top_n``, and of a class as many as a list can hold and spare.

    Without the others the same rows are picked: heads and fill lie among those kept, and so do the first
    unpicked rows of each class. Profiles that share an id but not their wishes can pick up to three lists together.
    """
    mine = Window.partitionBy("profile_id").orderBy("sort_position")
    everything, top_n = whole_slice(mine), F.col("top_n")
    alike = (F.min(top_n).over(everything) == F.max(top_n).over(everything)) & (
        F.min(is_balanced()).over(everything) == F.max(is_balanced()).over(everything))
    marked = ordered.withColumns({
        "__top": F.max(top_n).over(everything), "__alike": alike, "__any": F.max(is_balanced()).over(everything),
        "__at": F.row_number().over(mine),
        **{f"__in_{c}": F.sum((F.col(column) == c).cast("int")).over(mine) for column, (classes, _) in spares.items() for c in classes},
    })
    held = F.when(F.col("__alike"), F.col("__top")).otherwise(4 * F.col("__top"))
    keep = F.col("__at") <= F.col("__top")
    for column, (classes, depth) in spares.items():
        for c in classes:
            keep = keep | (F.col("__any") & (F.col(column) == c) & (F.col(f"__in_{c}") <= held + depth))
    return marked.where(keep).drop(
        "__top", "__alike", "__any", "__at", *[f"__in_{c}" for classes, _ in spares.values() for c in classes])


def balanced_selection(ordered: DataFrame) -> DataFrame:
    """Quotas, backfill, then every exam type and every bucket keeps at least one place."""
    # A step takes the best unpicked row of its class or none. Only the two exam steps can take rows of a bucket
    # before its own step, and nothing takes rows of an exam before its own. Other lists than balanced ones swap nothing.
    spares = {"rank_type_used": (EXAMS, 1), "recommendation_bucket": (list(BUCKET_QUOTAS), 3)}
    first = quota_and_backfill(_within_reach(ordered, spares))
    mine = Window.partitionBy("profile_id").orderBy("sort_position")
    everything, unpicked = whole_slice(mine), ~F.col("selected")
    spare = F.lit(False)
    for column, (classes, depth) in spares.items():
        for value in classes:
            mark = unpicked & (F.col(column) == value)
            spare = spare | (mark & (F.sum(mark.cast("int")).over(mine) <= depth))
    pool = first.withColumns({
        "__spare": spare & F.max(is_balanced()).over(everything),
        **{f"__miss_{t}": F.max((F.col("selected") & (F.col("rank_type_used") == t)).cast("int")).over(everything) == 0 for t in EXAMS},
    }).where(F.col("selected") | F.col("__spare")).drop("__spare")
    for step, t in enumerate(EXAMS):
        pool = _swap_in(pool, "rank_type_used", t, step, is_balanced() & F.col(f"__miss_{t}"))
    for step, b in enumerate(BUCKET_QUOTAS, start=len(EXAMS)):
        pool = _swap_in(pool, "recommendation_bucket", b, step, is_balanced())
    return pool.where("selected").drop("selected", "pick_order", *[f"__miss_{t}" for t in EXAMS])


def recommend(scored: DataFrame) -> DataFrame:
    """Final list per profile: balanced for best_fit, plain head for the other sort modes."""
    chosen = balanced_selection(order_candidates(scored))
    place = F.row_number().over(Window.partitionBy("profile_id").orderBy("sort_position"))
    return chosen.withColumn("position", place)


def response_summary(profiles: DataFrame, chosen: DataFrame, extra: dict[str, Column] = {}) -> DataFrame:
    """One row per profile: list totals, safest and reach headline choices with fallbacks.

    ``extra`` aggregates ride along in the same grouping.
    """
    name = text.display_name(F.col("institute"), F.col("program"))
    in_bucket = lambda b: F.col("recommendation_bucket") == b
    first = lambda cond: F.min_by(F.when(cond, name), F.when(cond, F.col("position")))
    per = chosen.groupBy("profile_id").agg(
        F.count(F.lit(1)).alias("total_options"),
        F.count_if(in_bucket("safe_backup")).alias("safe_count"),
        F.count_if(in_bucket("best_realistic")).alias("moderate_count"),
        F.count_if(in_bucket("ambitious_reach")).alias("ambitious_count"),
        first(in_bucket("safe_backup")).alias("__safe"),
        first(in_bucket("ambitious_reach")).alias("__reach"),
        first(F.lit(True)).alias("__any"),
        *[c.alias(n) for n, c in extra.items()],
    )
    out = profiles.select("profile_id", "main_rank", "advanced_rank").join(per, "profile_id", "left")
    main_low, main_high = scoring.reach_window(F.col("main_rank"))
    adv_low, adv_high = scoring.reach_window(F.col("advanced_rank"))
    counts = ["total_options", "safe_count", "moderate_count", "ambitious_count"]
    return out.na.fill(0, counts).select(
        "profile_id", *counts,
        F.coalesce("__safe", "__any", F.lit("—")).alias("safest_choice"),
        F.coalesce("__reach", F.lit("No realistic reach found")).alias("top_upgrade"),
        F.col("__reach").alias("most_ambitious"),
        main_low.alias("main_reach_low"), main_high.alias("main_reach_high"),
        adv_low.alias("advanced_reach_low"), adv_high.alias("advanced_reach_high"), *extra,
    )


def view_order(mode: str) -> list[Column]:
    """Sort columns of the result views; the choice id makes each order total."""
    score = F.coalesce(F.col("recommendation_score"), F.col("probability_percent"), F.lit(0.0))
    percent, cutoff = F.col("probability_percent"), F.col("predicted_closing_rank")
    safe = F.coalesce(F.col("safety_score"), percent)
    keys = {
        "best_fit": [score.desc(), cutoff.asc(), percent.desc()],
        "highest_probability": [percent.desc()],
        "most_competitive": [cutoff.asc()],
        "safest_backup": [safe.desc(), percent.desc(), cutoff.desc()],
        "institute_name": [F.col("institute").asc(), F.col("program").asc()],
        "branch_name": [F.col("program").asc(), F.col("institute").asc()],
    }
    return keys[mode] + [F.col("choice_id").asc()]


def view_filter(rows: DataFrame, *, kind: str | None = None, bucket: str | None = None, query: str = "") -> DataFrame:
    shown = scoring.view_bucket(
        F.col("recommendation_bucket"), F.col("confidence_label"), F.col("probability_percent"))
    out = rows
    if kind:
        out = out.where(F.col("institute_type") == kind)
    if bucket:
        out = out.where(shown == bucket)
    if query.strip():
        q = F.lit(query.strip())
        out = out.where(
            text.contains_ignoring_case(F.col("institute"), q) | text.contains_ignoring_case(F.col("program"), q)
        )
    return out


def best_per_bucket(chosen: DataFrame) -> DataFrame:
    """Highest-scored row of every (profile, bucket)."""
    w = Window.partitionBy("profile_id", "recommendation_bucket").orderBy(
        F.col("recommendation_score").desc(), F.col("choice_id"))
    return chosen.withColumn("__r", F.row_number().over(w)).where("__r = 1").drop("__r")


def saved_in_order(saved: DataFrame, rows: DataFrame, id_column: str = "choice_id") -> DataFrame:
    """Rows of each saved list in saved order; ids no longer present are skipped."""
    wanted = saved.select("profile_id", F.posexplode("saved_ids").alias("saved_position", id_column))
    return wanted.join(rows, ["profile_id", id_column])


def grounding_check(rows: DataFrame) -> DataFrame:
    """Per row: margin, routed rank and the two numbers quoted in the explanation agree."""
    expected = F.col("predicted_closing_rank") - F.col("rank_used")
    routed = F.when(F.col("institute_type") == "IIT", F.col("advanced_rank")).otherwise(F.col("main_rank"))
    says = lambda c: F.contains(F.col("explanation"), text.thousands(c))
    return rows.withColumns({
        "margin_ok": F.col("margin") == expected,
        "rank_ok": F.col("rank_used") == routed,
        "text_ok": says(F.col("predicted_closing_rank")) & says(F.abs(expected)),
    })


def context_block(profiles: DataFrame, chosen: DataFrame, limit: int = 10) -> DataFrame:
    """Text block per profile: totals, headline picks and up to ten numbered choices."""
    c = lambda n: F.col(n)
    number = lambda col: text.thousands(col)
    signed = F.concat(F.when(c("margin") >= 0, "+").otherwise(""), number(c("margin")))
    line = F.concat(
        c("position").cast("string"), F.lit(". **"), text.clean_text(c("institute"), 200), F.lit("** - "),
        text.clean_text(c("program"), 200), F.lit(" ["), text.clean_text(c("confidence_label"), 30), F.lit("] | "),
        F.format_string("%.1f", c("model_probability_percent")),
        F.lit("% uncalibrated admission-likelihood estimate | Predicted cutoff: "), number(c("predicted_closing_rank")),
        F.coalesce(F.concat(F.lit(" | 90% prediction interval: ["), number(c("ci_lower_5")), F.lit("-"),
                            number(c("ci_upper_95")), F.lit("]")), F.lit("")),
        F.coalesce(F.concat(F.lit(" | Safety margin: "), signed), F.lit("")),
        F.coalesce(F.concat(F.lit(" | Rank used: "), number(c("rank_used")), F.lit(" ("), c("rank_type_used"), F.lit(")")), F.lit("")),
        F.coalesce(F.concat(F.lit(" | Heuristic recommendation score: "),
                            F.format_string("%.1f", F.bround("recommendation_score", 1))), F.lit("")),
        F.lit(" | Quota: "), c("quota"),
    )
    # at most ``limit`` short lines per profile are collected
    top = F.collect_list(F.when(c("position") <= limit, F.struct("position", line.alias("line"))))
    lines = F.nullif(F.array_join(F.transform(F.array_sort(top), lambda s: s["line"]), "\n"), F.lit(""))
    summary = response_summary(profiles, chosen, {"__lines": lines})
    reach = F.col("ambitious_count") > 0
    gone = F.lit("No realistic reach found")
    head = F.concat_ws(
        "\n",
        F.lit("## Student Recommendation Context"),
        F.concat(F.lit("- **Total returned options:** "), c("total_options")),
        F.concat(F.lit("- **Safe choices:** "), c("safe_count")),
        F.concat(F.lit("- **Target choices:** "), c("moderate_count")),
        F.concat(F.lit("- **Reach choices:** "), c("ambitious_count")),
        F.concat(F.lit("- **Top safe pick:** "), text.clean_text(c("safest_choice"))),
        F.concat(F.lit("- **Best upgrade pick:** "), text.clean_text(F.when(reach, c("top_upgrade")).otherwise(gone))),
        F.concat(F.lit("- **Most ambitious pick:** "), text.clean_text(
            F.when(reach, F.coalesce(c("most_ambitious"), F.lit("not reported"))).otherwise(gone))),
        F.lit("### Top Recommendations"),
        c("__lines"),
    )
    return summary.select("profile_id", head.alias("context"))
