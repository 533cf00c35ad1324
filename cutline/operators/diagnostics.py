"""Distributions, ranks and agreement measures that stay distributed on one huge group."""

from __future__ import annotations

import functools
import math

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window, functions as F

from cutline.functions.keys import null_safe_join
from cutline.operators.quantiles import counted_values, exact_percentiles, order_statistics, with_range
from cutline.session import durable


def value_ranks(df: DataFrame, keys: list[str], value: str) -> DataFrame:
    """keys, value, ``n_equal``, ``n_below``, ``n``: global ranks without a global window.

    Values are counted first; a sketch proposes value ranges; exact counts per range give each
    range its offset, and the running count is taken inside one range at a time.
    """
    group = keys or ["__all"]
    data = df if keys else df.withColumn("__all", F.lit(1))
    counted = counted_values(data, group, value)
    ranges = (
        with_range(counted, group).groupBy(*group, "__b").agg(
            F.sum("__c").alias("__in"), F.min("__v").alias("__lo"), F.max("__v").alias("__hi"))
        .withColumns({
            "__before": F.sum("__in").over(Window.partitionBy(*group).orderBy("__b")) - F.col("__in"),
            "n": F.sum("__in").over(Window.partitionBy(*group)),
        }).drop("__in", "__b")
    )
    placed = null_safe_join(counted, F.broadcast(ranges), group, "inner").where(
        F.col("__v").between(F.col("__lo"), F.col("__hi")))
    return placed.withColumnRenamed("__c", "n_equal").withColumn(
        "n_below", F.col("__before") + F.sum("n_equal").over(
            Window.partitionBy(*group, "__lo").orderBy("__v")) - F.col("n_equal")).select(
        *keys, F.col("__v").alias(value), "n_equal", "n_below", "n")


def average_rank(ranks: DataFrame, descending: bool = True) -> Column:
    """Tie-averaged 1-based rank from the columns of ``value_ranks``."""
    below = F.col("n") - F.col("n_below") - F.col("n_equal") if descending else F.col("n_below")
    return below + (F.col("n_equal") + 1) / 2.0


def add_average_rank(df: DataFrame, keys: list[str], value: str, name: str, descending: bool = True) -> DataFrame:
    ranks = value_ranks(df, keys, value)
    ranks = ranks.withColumn(name, average_rank(ranks, descending)).select(*keys, value, name)
    return null_safe_join(df, ranks, [*keys, value], "left")


def spearman(df: DataFrame, keys: list[str], a: str, b: str) -> DataFrame:
    """Pearson correlation of tie-averaged ranks, per closed-domain group."""
    ranked = add_average_rank(add_average_rank(df, keys, a, "__ra"), keys, b, "__rb")
    return ranked.groupBy(*keys).agg(F.corr("__ra", "__rb").alias("spearman"), F.count(F.lit(1)).alias("n"))


def _inversions(x: np.ndarray, y: np.ndarray, weight: np.ndarray) -> int:
    """Weighted pairs with x rising and y falling, bit by bit of y's rank from the top: of two values that part at a bit,
    the larger one stands first."""
    order = np.lexsort((y, x))
    rank, w, found = np.unique(y, return_inverse=True)[1][order], weight[order].astype(np.int64), 0
    for bit in range(int(rank.max(initial=0)).bit_length() - 1, -1, -1):
        one = (rank >> bit) & 1
        high = np.cumsum(w * one)
        prefix = rank >> (bit + 1)
        start = np.flatnonzero(np.diff(prefix, prepend=-1))
        before = np.repeat((high - w * one)[start], np.diff(np.append(start, len(rank))))
        found += int((w * (1 - one) * (high - before)).sum())
        sort = np.argsort(rank >> bit, kind="stable")
        rank, w = rank[sort], w[sort]
    return found


def _with_range(points: DataFrame, group: list[str], value: str, ranges: int, name: str) -> DataFrame:
    """``points`` with the number of a value's range: even between two borders, odd on a border. Borders are quantiles of a
    mergeable sketch, so a range between borders has about an equal share of the rows and a frequent value one of its own."""
    step = max(1, int(ranges**0.5))
    sketch = points.groupBy(*group).agg(F.array_sort(F.array_distinct(F.percentile_approx(
        value, [i / ranges for i in range(1, ranges)] or [0.5], 10 * ranges + 100))).alias("__fine"))
    borders = sketch.withColumn("__coarse", F.filter(
        F.transform("__fine", lambda v, i: F.when((i + 1) % step == 0, v)), lambda v: v.isNotNull()))
    out = null_safe_join(points, F.broadcast(borders), group, "inner")  # groups are of closed domains, arrays of ``ranges``
    below = lambda array: F.size(F.filter(array, lambda s: s < F.col(value)))
    out = out.withColumn("__at", below(F.col("__coarse")) * step)
    out = out.withColumn("__at", F.col("__at") + below(F.slice("__fine", F.col("__at") + 1, F.lit(step))))
    on_border = F.coalesce(F.get("__fine", F.col("__at")) == F.col(value), F.lit(False))
    return out.withColumn(name, 2 * F.col("__at") + on_border.cast("int")).drop("__fine", "__coarse", "__at")


def _inside_ranges(points: DataFrame, group: list[str], by: str, x: str) -> DataFrame:
    """(group, d): weighted inversions of ``x`` and ``__y`` inside each range of ``by``; a range of one value has none."""
    schema = ", ".join(f"{k} {t}" for k, t in points.select(*group).dtypes) + ", d bigint"

    def count(frame: pd.DataFrame) -> pd.DataFrame:
        head = frame[group].iloc[:1].copy()
        head["d"] = _inversions(frame[x].to_numpy(), frame["__y"].to_numpy(), frame["__c"].to_numpy())
        return head

    rows = points.where(F.col(by) % 2 == 0).select(*group, by, F.col(x).alias(x), "__y", "__c")
    return rows.groupBy(*group, by).applyInPandas(count, schema)


def kendall(df: DataFrame, keys: list[str], a: str, b: str) -> DataFrame:
    """Kendall's tau-b per group of closed-domain ``keys``, exact for groups of any size; null without two different values
    of both columns. Rows with a null in either column do not count.

    Both columns are cut into about sqrt(n) / 8 ranges. A discordant pair lies in one range of ``a``, or else in one range of ``b``,
    or apart in both. The first two kinds are counted inside ranges, which hold some 8 sqrt(n) rows; the third from
    the grid of range counts (n / 16 cells at most) by two running sums.
    """
    group = keys or ["__all"]
    data = df if keys else df.withColumn("__all", F.lit(1))
    points = durable(data.where(F.col(a).isNotNull() & F.col(b).isNotNull()).groupBy(
        *group, F.col(a).cast("double").alias("__x"), F.col(b).cast("double").alias("__y")).agg(F.count(F.lit(1)).alias("__c")))
    largest = points.groupBy(*group).agg(F.sum("__c").alias("n")).agg(F.max("n")).first()[0] or 1
    ranges = math.ceil(largest**0.5 / 8)
    placed = durable(_with_range(_with_range(points, group, "__x", ranges, "__bx"), group, "__y", ranges, "__by"))

    exact = lambda c: c.cast("decimal(38,0)")
    pairs = lambda c: exact(c) * exact(c - 1) / 2
    def ties(*by):
        return points.groupBy(*group, *by).agg(F.sum("__c").alias("c")).groupBy(*group).agg(F.sum(pairs(F.col("c"))).cast("decimal(38,0)").alias("t"))

    grid = placed.groupBy(*group, "__by", "__bx").agg(F.sum("__c").alias("c"))
    whole = grid.select(*group, "__by").distinct().withColumn("__bx", F.explode(F.sequence(F.lit(0), F.lit(2 * ranges))))
    cells = null_safe_join(whole, grid, [*group, "__by", "__bx"], "left").withColumn("c", F.coalesce("c", F.lit(0)))
    before = Window.unboundedPreceding, -1
    above = F.sum("c").over(Window.partitionBy(*group, "__bx").orderBy(F.desc("__by")).rowsBetween(*before))
    cells = cells.withColumn("above", F.coalesce(above, F.lit(0)))
    reach = F.sum("above").over(Window.partitionBy(*group, "__by").orderBy("__bx").rowsBetween(*before))
    apart = cells.withColumn("reach", reach).groupBy(*group).agg(F.sum(exact(F.col("c")) * exact(F.coalesce("reach", F.lit(0)))).alias("d"))
    parts = [_inside_ranges(placed, group, "__bx", "__x"), _inside_ranges(placed, group, "__by", "__bx"), apart]
    counts = [p.select(*group, F.lit(kind).alias("kind"), exact(F.col("d")).alias("v")) for kind, p in zip(("d", "d", "d"), parts)]
    counts += [ties(*by).select(*group, F.lit(kind).alias("kind"), F.col("t").alias("v"))
               for kind, by in (("all", ()), ("x", ("__x",)), ("y", ("__y",)), ("xy", ("__x", "__y")))]
    sums = functools.reduce(DataFrame.unionByName, counts).groupBy(*group).pivot("kind", ["all", "x", "y", "xy", "d"]).agg(F.sum("v"))
    of = lambda c: F.coalesce(F.col(c), F.lit(0).cast("decimal(38,0)"))
    top = of("all") - of("x") - of("y") + of("xy") - 2 * of("d")
    bottom = F.sqrt((of("all") - of("x")).cast("double")) * F.sqrt((of("all") - of("y")).cast("double"))
    return sums.select(*keys, F.try_divide(top.cast("double"), bottom).alias("kendall"))


def wilcoxon(df: DataFrame, keys: list[str], a: str, b: str) -> DataFrame:
    """Signed-rank sums of paired differences (zeros dropped) and their smaller one."""
    d = df.withColumn("__d", F.col(a) - F.col(b)).where(F.col("__d") != 0).withColumn("__m", F.abs("__d"))
    ranked = add_average_rank(d, keys, "__m", "__r", descending=False)
    plus = F.coalesce(F.sum(F.when(F.col("__d") > 0, F.col("__r"))), F.lit(0.0))
    minus = F.coalesce(F.sum(F.when(F.col("__d") < 0, F.col("__r"))), F.lit(0.0))
    return ranked.groupBy(*keys).agg(
        F.count(F.lit(1)).alias("n_pairs"), plus.alias("w_plus"), minus.alias("w_minus"),
        F.least(plus, minus).alias("statistic"))


def classification_metrics(df: DataFrame, keys: list[str], label: str, predicted: str, score: str) -> DataFrame:
    """Accuracy, precision, recall, F1 (empty denominators give 0) and exact rank-sum ROC-AUC."""
    y, p = F.col(label) == 1, F.col(predicted) == 1
    counts = df.groupBy(*keys).agg(
        F.count(F.lit(1)).alias("n"), F.count_if(y & p).alias("tp"), F.count_if(~y & p).alias("fp"),
        F.count_if(y & ~p).alias("fn"), F.count_if(~y & ~p).alias("tn"))
    per_score = df.groupBy(*keys, score).agg(F.sum(F.col(label).cast("bigint")).alias("__pos"))
    ranks = value_ranks(df, keys, score)
    ranks = ranks.withColumn("__rank", average_rank(ranks, descending=False)).select(*keys, score, "__rank")
    sums = null_safe_join(per_score, ranks, [*keys, score], "inner").groupBy(*keys).agg(
        F.sum(F.col("__pos") * F.col("__rank")).alias("__ranksum"))
    out = (
        null_safe_join(counts, F.broadcast(sums), keys, "left") if keys
        else counts.join(F.broadcast(sums), how="left")
    )
    c = F.col
    pos, neg = c("tp") + c("fn"), c("fp") + c("tn")
    safe = lambda a, b: F.coalesce(F.try_divide(a.cast("double"), b.cast("double")), F.lit(0.0))
    precision, recall = safe(c("tp"), c("tp") + c("fp")), safe(c("tp"), pos)
    auc = F.when((pos > 0) & (neg > 0), F.try_divide(
        c("__ranksum") - pos * (pos + 1) / 2.0, pos.cast("double") * neg))
    return out.select(
        *keys, "n", "tp", "fp", "fn", "tn", safe(c("tp") + c("tn"), c("n")).alias("accuracy"),
        precision.alias("precision"), recall.alias("recall"),
        safe(2 * precision * recall, precision + recall).alias("f1"), auc.alias("roc_auc"))


def histogram(df: DataFrame, keys: list[str], value: str, bins: int) -> DataFrame:
    """Equal-width bins over each group's own range; the top edge belongs to the last bin."""
    ends = df.groupBy(*keys).agg(F.min(value).alias("__lo"), F.max(value).alias("__hi"))
    joined = (
        null_safe_join(df, F.broadcast(ends), keys, "inner") if keys else df.join(F.broadcast(ends), how="inner")
    )
    width = (F.col("__hi") - F.col("__lo")).cast("double")
    at = F.floor(F.try_divide((F.col(value) - F.col("__lo")).cast("double"), width) * bins)
    bin_ = F.least(F.coalesce(at, F.lit(0)), F.lit(bins - 1)).cast("bigint")
    return joined.where(F.col(value).isNotNull()).groupBy(*keys, bin_.alias("bin")).agg(
        F.count(F.lit(1)).alias("rows"), F.first("__lo").cast("double").alias("range_low"),
        F.first("__hi").cast("double").alias("range_high"))


def trim_central(df: DataFrame, value: str, low: float = 0.01, high: float = 0.99) -> DataFrame:
    """Rows between two exact percentiles of ``value``."""
    ends = exact_percentiles(df, [], value, {"__low": low, "__high": high}).drop("n")
    return df.join(F.broadcast(ends), how="inner").where(
        F.col(value).between(F.col("__low"), F.col("__high"))).drop("__low", "__high")


def clip_central(df: DataFrame, value: str, name: str, low: float = 0.01, high: float = 0.99) -> DataFrame:
    ends = exact_percentiles(df, [], value, {"__low": low, "__high": high}).drop("n")
    clipped = F.greatest(F.col("__low"), F.least(F.col("__high"), F.col(value).cast("double")))
    return df.join(F.broadcast(ends), how="inner").withColumn(name, clipped).drop("__low", "__high")


def box_statistics(df: DataFrame, keys: list[str], value: str) -> DataFrame:
    quart = exact_percentiles(df, keys, value, {"q25": 0.25, "median": 0.5, "q75": 0.75})
    ends = df.where(F.col(value).isNotNull()).groupBy(*keys).agg(
        F.min(value).alias("low"), F.max(value).alias("high"), F.avg(value).alias("mean"))
    return null_safe_join(quart, ends, keys, "inner")


def correlation_pairs(df: DataFrame, columns: list[str]) -> DataFrame:
    """Pairwise-complete Pearson correlations, one aggregate, long form."""
    both = lambda a, b: F.corr(
        F.when(F.col(b).isNotNull(), F.col(a).cast("double")),
        F.when(F.col(a).isNotNull(), F.col(b).cast("double")))
    pairs = [(a, b) for i, a in enumerate(columns) for b in columns[i + 1:]]
    wide = df.agg(*[both(a, b).alias(f"{a}|{b}") for a, b in pairs])
    long = F.explode(F.array(*[
        F.struct(F.lit(a).alias("a"), F.lit(b).alias("b"), F.col(f"`{a}|{b}`").alias("r")) for a, b in pairs]))
    return wide.select(long.alias("p")).select("p.*")


def distribution(df: DataFrame, columns: list[str]) -> DataFrame:
    """Value counts with their percent of all rows, for several columns at once."""
    long = df.select(F.explode(F.array(*[
        F.struct(F.lit(c).alias("column"), F.col(c).cast("string").alias("value")) for c in columns])).alias("p"))
    counts = long.select("p.*").groupBy("column", "value").agg(F.count(F.lit(1)).alias("rows"))
    # one row per distinct value by now
    total = F.sum("rows").over(Window.partitionBy("column"))
    return counts.withColumn("percent", F.lit(100.0) * F.col("rows") / total)


def top_values(df: DataFrame, column: str, n: int) -> DataFrame:
    return df.groupBy(column).agg(F.count(F.lit(1)).alias("rows")).orderBy(F.col("rows").desc(), column).limit(n)


def volatility(finals: DataFrame, key: list[str], min_years: int = 3) -> DataFrame:
    """Spread of final-round cutoffs over the seasons of a branch."""
    return finals.groupBy(*key).agg(
        F.avg("closing_rank").alias("mean_rank"), F.stddev_samp("closing_rank").alias("std_rank"),
        F.count("closing_rank").alias("n_years"),
    ).where((F.col("n_years") >= min_years) & F.col("std_rank").isNotNull()).withColumn(
        "cv", F.try_divide(F.col("std_rank"), F.col("mean_rank")))


def jaccard(left: DataFrame, right: DataFrame, keys: list[str], item: str) -> DataFrame:
    """Overlap of two item sets per group: shared / all; an empty side gives 0."""
    a = left.select(*keys, item).distinct().withColumn("__a", F.lit(1))
    b = right.select(*keys, item).distinct().withColumn("__b", F.lit(1))
    both = null_safe_join(a, b, [*keys, item], "full")
    n_a, n_b = F.count("__a"), F.count("__b")
    shared = F.count(F.when(F.col("__a").isNotNull() & F.col("__b").isNotNull(), 1))
    share = F.when((n_a == 0) | (n_b == 0), 0.0).otherwise(
        F.try_divide(shared.cast("double"), F.count(F.lit(1)).cast("double")))
    return both.groupBy(*keys).agg(shared.alias("shared"), F.count(F.lit(1)).alias("all"), share.alias("jaccard"))


def group_errors(errors: DataFrame, keys: list[str]) -> DataFrame:
    """MAE, exact median error, count and mean actual per closed-domain group."""
    from cutline.operators.quantiles import exact_median

    sums = errors.groupBy(*keys).agg(
        F.avg("abs_residual").alias("mae"), F.count(F.lit(1)).alias("count"),
        F.avg("actual_closing_rank").alias("mean_rank"),
        F.sqrt(F.avg(F.col("residual").cast("double") * F.col("residual"))).alias("rmse"))
    med = exact_median(errors, keys, "abs_residual", "medae").drop("n")
    return null_safe_join(sums, F.broadcast(med), keys, "left")


def absolute_percent_error(errors: DataFrame) -> DataFrame:
    y = F.col("actual_closing_rank")
    return errors.withColumn("percent_error", F.when(y > 0, F.abs(F.col("residual")) / y * 100))


def failure_concentration(errors: DataFrame, columns: list[str], order: list[str], worst: int = 100, top: int = 5) -> DataFrame:
    """Which values dominate among the ``worst`` largest errors, ``top`` per column."""
    head = errors.orderBy(F.col("abs_residual").desc(), *order).limit(worst)
    counts = head.select(F.explode(F.array(*[
        F.struct(F.lit(c).alias("dimension"), F.col(c).cast("string").alias("value")) for c in columns])).alias("p")
    ).select("p.*").groupBy("dimension", "value").agg(F.count(F.lit(1)).alias("rows"))
    place = F.row_number().over(Window.partitionBy("dimension").orderBy(F.col("rows").desc(), "value"))
    return counts.withColumn("place", place).where(F.col("place") <= top)


def threshold_sample(df: DataFrame, keys: list[str], n: int, seed: int = 42) -> DataFrame:
    """The ``n`` rows (all, if fewer) whose hash of ``keys`` and ``seed`` is smallest; rows of equal hash by their keys.

    The n-th smallest hash is a counted order statistic, so the sample is a filter and no table is sorted. Only rows
    of just that hash are ordered, to fill up the sample.
    """
    text = F.concat_ws("|", *[F.col(k).cast("string") for k in keys], F.lit(str(seed)))
    hashed = durable(df.withColumn("__h", F.conv(F.substring(F.md5(text), 1, 15), 16, 10).cast("bigint")))
    if hashed.count() <= n:
        return hashed.drop("__h")
    at = order_statistics(hashed, [], "__h", {"h": lambda c: F.lit(n - 1)}).first()["h"]
    below = hashed.where(F.col("__h") < at)
    ties = hashed.where(F.col("__h") == at).orderBy(*keys).limit(n - below.count())
    return below.unionByName(ties).drop("__h")
