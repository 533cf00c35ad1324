"""Table joins around seat allotment: preference expansion and capacity cut."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window, functions as F

SALTS = 64


def expand_preferences(candidates: DataFrame, seats: DataFrame, counsellings: list[str] | None = None) -> DataFrame:
    """Each (institute, branch) wish becomes the eligible seats, in wish order then seat id."""
    open_seats = seats.where(F.col("counselling").isin(counsellings)) if counsellings else seats
    wishes = candidates.select(
        "candidate_id", "rank", "category", F.posexplode("preferences").alias("wish", "__p")
    ).select("candidate_id", "rank", "category", "wish",
             F.col("__p.institute").alias("institute"), F.lower("__p.branch").alias("__b"))
    pairs = wishes.join(
        open_seats.withColumn("__b", F.lower("branch")), ["institute", "__b", "category"]
    ).drop("__b")
    place = F.row_number().over(Window.partitionBy("candidate_id").orderBy("wish", "seat_id"))
    return pairs.withColumn("proposal", place)


def capacity_cut(applications: DataFrame) -> DataFrame:
    """Best ``capacity`` applicants per seat by rank, then id.

    A popular seat can hold a third of all applications, so the cut is taken twice: first in
    each of SALTS slices of a seat (nobody outside a slice's best ``capacity`` can be in the
    seat's), then over the few survivors.
    """
    order = ["rank", "candidate_id"]
    salted = applications.withColumn("__salt", F.pmod(F.xxhash64("candidate_id"), F.lit(SALTS)))
    slice_place = F.row_number().over(Window.partitionBy("seat_id", "__salt").orderBy(*order))
    survivors = salted.withColumn("__r", slice_place).where(F.col("__r") <= F.col("capacity")).drop("__r", "__salt")
    seat_place = F.row_number().over(Window.partitionBy("seat_id").orderBy(*order))
    return survivors.withColumn("place", seat_place).where(F.col("place") <= F.col("capacity"))
