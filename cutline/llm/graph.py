"""Distributed union-find, and joins that a hot key does not overload."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from cutline.session import written


BROADCAST_ROWS = 200_000  # narrow rows, some tens of bytes each


def components(edges: DataFrame) -> DataFrame:
    """(node, component): the smallest node reachable, for every node of ``edges`` (a, b).

    Alternates the large-star and small-star steps, which hang every node below the smallest one it
    knows of. Each step is a grouped minimum and a join; tables are written between rounds.
    """
    edges = written(edges.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).where("a <> b").distinct(), "edges")
    known = None
    while True:
        both = edges.unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
        low = written(both.groupBy("a").agg(F.least(F.min("b"), F.col("a")).alias("low")), "large")
        large = both.where("b > a").join(low, "a").select(F.col("b").alias("a"), F.col("low").alias("b")).distinct()
        large = written(large, "star")
        low = written(large.groupBy("a").agg(F.min("b").alias("low")), "small")
        small = large.join(low, "a").where("b <> low").select(F.col("b").alias("a"), F.col("low").alias("b"))
        edges = written(small.unionByName(low.select("a", F.col("low").alias("b"))).distinct(), "edges")
        state = tuple(edges.agg(F.count(F.lit(1)), F.sum(F.xxhash64("a", "b").cast("decimal(20,0)"))).first())
        if state == known:
            break
        known = state
    pairs = edges.groupBy("a").agg(F.min("b").alias("b"))
    roots = edges.select("b").distinct().select(F.col("b").alias("node"), F.col("b").alias("component"))
    return written(pairs.select(F.col("a").alias("node"), F.col("b").alias("component")).unionByName(roots), "components")


def join_groups(rows: DataFrame, groups: DataFrame, key: str, count: str = "n") -> DataFrame:
    """Inner join of ``rows`` with ``groups`` (one row per ``key``, with its number of rows in ``count``).

    Up to ``BROADCAST_ROWS`` groups, all are broadcast. Beyond, groups with more rows than an even share of
    a task are fewer than there are shuffle partitions; they are broadcast and their rows stay where they
    are, and the rest is shuffled by key. ``groups`` should be a stored table: it is read more than once.
    """
    tasks = int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    number, total = groups.agg(F.count(F.lit(1)), F.sum(count)).first()
    if number <= BROADCAST_ROWS:
        return rows.join(F.broadcast(groups), key)
    share = total // tasks
    extra = [c for c in groups.columns if c != key]
    heavy = F.broadcast(groups.where(F.col(count) > share).select(F.col(key).alias("__heavy"), F.struct(*extra).alias("__found")))
    placed = rows.join(heavy, F.col(key) == F.col("__heavy"), "left")
    own = [F.col(c) for c in rows.columns]
    now = placed.where("__heavy is not null").select(*own, "__found.*")
    rest = placed.where("__heavy is null").select(*own).join(groups.where(F.col(count) <= share), key).select(*rows.columns, *extra)
    return now.unionByName(rest)
