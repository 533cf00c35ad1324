"""Exact order statistics that never gather one group in one task.

``median``/``percentile`` keep every distinct value of a group in the memory of one task, and a
row_number window sorts a whole group in one task. With a third of all rows in one group neither
holds up. Here the values are counted first (map-side combine on group + value), a mergeable
sketch only proposes bucket borders, exact counts per bucket say which bucket holds the wanted
position, and only that bucket is ordered. The sketch affects balance, never the result.

Group keys must come from closed domains (year, round, type, category, band ...): the border
table has one short array per group and is broadcast.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window, functions as F

from cutline.functions.keys import null_safe_join

BLOCK = 14
N_BORDERS = BLOCK * BLOCK


def counted_values(df: DataFrame, group: list[str], value: str, weight: str | None = None) -> DataFrame:
    """(group, __v, __c): how often each value occurs, combined map-side."""
    return df.where(F.col(value).isNotNull()).groupBy(*group, F.col(value).alias("__v")).agg(
        (F.sum(weight) if weight else F.count(F.lit(1))).alias("__c"))


def with_range(counted: DataFrame, group: list[str]) -> DataFrame:
    """Adds ``__b``, the number of the value range a value falls in (about equally many distinct
    values each). Borders come from a mergeable sketch; they are searched in two short steps."""
    steps = [i / N_BORDERS for i in range(1, N_BORDERS)]
    # naming __c keeps this side's shuffle identical to the other uses of ``counted``: one exchange
    value = F.when(F.col("__c") > 0, F.col("__v"))
    sketch = counted.groupBy(*group).agg(F.percentile_approx(value, steps, 4 * N_BORDERS).alias("__s"))
    borders = sketch.select(
        *group,
        F.transform(F.sequence(F.lit(1), F.lit(BLOCK - 1)), lambda i: F.element_at("__s", i * BLOCK)).alias("__coarse"),
        F.transform(F.sequence(F.lit(0), F.lit(BLOCK - 1)), lambda i: F.slice(
            "__s", i * BLOCK + 1, F.lit(BLOCK - 1))).alias("__fine"))
    joined = null_safe_join(counted, F.broadcast(borders), group, "inner")
    below = lambda array: F.size(F.filter(array, lambda s: s < F.col("__v")))
    stepped = joined.withColumn("__k", below(F.col("__coarse")))
    return stepped.withColumn("__b", F.col("__k") * BLOCK + below(F.get("__fine", F.col("__k")))).drop(
        "__coarse", "__fine", "__k")


def order_statistics(
    df: DataFrame, keys: list[str], value: str, positions: dict[str, Callable[[Column], Column]],
    weight: str | None = None,
) -> DataFrame:
    """keys + ``n`` + one column per entry of ``positions``: the value at that 0-based position.

    Each entry maps the group's row count (a Column) to the position wanted. NULL values are
    not counted; groups without any value do not appear. ``weight`` names a column that says
    how many times a row counts.
    """
    group = keys or ["__all"]
    data = df if keys else df.withColumn("__all", F.lit(1))
    counted = counted_values(data, group, value, weight)
    bucketed = with_range(counted, group)
    per_bucket = bucketed.groupBy(*group, "__b").agg(
        F.sum("__c").alias("__in"), F.min("__v").alias("__lo"), F.max("__v").alias("__hi")
    )
    ordered = Window.partitionBy(*group).orderBy("__b")
    whole = Window.partitionBy(*group)
    wanted = F.explode(F.array(*[
        F.struct(F.lit(name).alias("name"), at(F.col("n")).cast("bigint").alias("at"))
        for name, at in positions.items()
    ]))
    located = (
        per_bucket
        .withColumn("__before", F.sum("__in").over(ordered) - F.col("__in"))
        .withColumn("n", F.sum("__in").over(whole))
        .select(*group, "n", "__before", "__in", "__lo", "__hi", wanted.alias("__w"))
        .where((F.col("__w.at") >= F.col("__before")) & (F.col("__w.at") < F.col("__before") + F.col("__in")))
        .select(*group, "n", "__before", "__lo", "__hi",
                F.col("__w.name").alias("__name"), F.col("__w.at").alias("__at"))
    )
    inside = null_safe_join(counted, F.broadcast(located), group, "inner").where(
        F.col("__v").between(F.col("__lo"), F.col("__hi"))
    )
    upto = F.col("__before") + F.sum("__c").over(
        Window.partitionBy(*group, "__name").orderBy("__v")
    )
    hits = inside.withColumn("__upto", upto).where(
        (F.col("__at") < F.col("__upto")) & (F.col("__at") >= F.col("__upto") - F.col("__c"))
    )
    result = hits.groupBy(*group).agg(
        F.first("n").alias("n"),
        *[F.max(F.when(F.col("__name") == name, F.col("__v"))).alias(name) for name in positions],
    )
    return result.select(*keys, "n", *positions)


def exact_percentiles(
    df: DataFrame, keys: list[str], value: str, quantiles: dict[str, float],
) -> DataFrame:
    """Linear-interpolation percentiles (the usual dataframe-library definition)."""
    positions = {}
    for name, q in quantiles.items():
        positions[f"__{name}_a"] = lambda n, q=q: F.floor(F.lit(q) * (n - 1))
        positions[f"__{name}_b"] = lambda n, q=q: F.ceil(F.lit(q) * (n - 1))
    found = order_statistics(df, keys, value, positions)
    out = []
    for name, q in quantiles.items():
        at = F.lit(q) * (F.col("n") - 1)
        low, high = F.col(f"__{name}_a").cast("double"), F.col(f"__{name}_b").cast("double")
        out.append((low + (high - low) * (at - F.floor(at))).alias(name))
    return found.select(*keys, "n", *out)


def exact_median(df: DataFrame, keys: list[str], value: str, name: str) -> DataFrame:
    return exact_percentiles(df, keys, value, {name: 0.5})


def lifted_position(n: Column, coverage: float) -> Column:
    """0-based position of the finite-sample lifted "higher" quantile."""
    lifted = F.least(F.lit(1.0), F.ceil((n + 1) * F.lit(coverage)) / n)
    return F.ceil((n - 1) * lifted)


def lifted_quantile(
    df: DataFrame, keys: list[str], value: str, coverage: float, name: str, weight: str | None = None,
) -> DataFrame:
    """Upper order statistic used as interval radius: keys, n, value."""
    return order_statistics(df, keys, value, {name: lambda n: lifted_position(n, coverage)}, weight)
