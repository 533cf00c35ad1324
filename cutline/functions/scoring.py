"""Arithmetic, banding and scoring expressions."""

from __future__ import annotations

import bisect
import json
import math

from pyspark.sql import Column, functions as F

from cutline.schemas import FIRST_EWS_YEAR, RANK_BAND_EDGES, RANK_BANDS

# --- fixed values -------------------------------------------------------------------------
SAFE_RATIO, REALISTIC_RATIO, REACH_RATIO = 0.80, 1.05, 1.40
SAFE_PROBABILITY, MODERATE_PROBABILITY = 0.80, 0.40
VIEW_SAFE_PERCENT, VIEW_TARGET_PERCENT = 70, 35
DEFAULT_STD = 150.0
Z_90 = 1.6448536269514722
INSTITUTE_SCORE = {"IIT": 1.00, "NIT": 0.78, "IIIT": 0.72, "GFTI": 0.48}
INSTITUTE_SCORE_DEFAULT = 0.50
GOLDEN = 0.6180339887498949
N_DRAWS = 1000
PERCENTILE_DRAWS = 10_000
DRAW_CELLS = 2048


def decimals(c: Column, digits: int, even: bool = False) -> Column:
    """``round`` (``bround`` where ``even``) of a double to ``digits`` places, at the price of a division.

    Both functions go through decimal text for every row. Away from a tie the nearest whole number of
    steps is the same by plain arithmetic, and dividing two whole doubles gives the double nearest to
    the decimal; ties, huge and missing values still take the function.
    """
    scale = F.lit(float(10 ** digits))
    steps = c * scale
    whole = F.floor(steps + F.lit(0.5))
    # the product is off by less than 2e-4 below 1e12, so 0.499 leaves no doubt about the side of a tie
    clear = (F.abs(steps) < F.lit(1e12)) & (F.abs(steps - whole) < F.lit(0.499))
    return F.when(clear, whole / scale).otherwise(F.bround(c, digits) if even else F.round(c, digits))


def standard_draws(n: int = N_DRAWS) -> list[float]:
    """Fixed low-discrepancy Box-Muller normals, sorted; the same set serves every row, so
    equal spread always gives a likelihood monotone in the cutoff."""
    out = []
    for i in range(n):
        turn = i * GOLDEN
        out.append(
            math.sqrt(-2.0 * math.log((i + 0.5) / n)) * math.cos(2.0 * math.pi * (turn - math.floor(turn)))
        )
    return sorted(out)


def _failing_draws(cutoff: Column, std: Column, value: Column, n: int = N_DRAWS) -> Column:
    """Number of the ``n`` shared draws z with cutoff + z * std < value, for std > 0.

    A grid over z knows how many draws lie below each cell; only draws in the cell of the
    break-even point and its two neighbours are compared one by one (a handful instead of a
    thousand). The neighbours absorb the rounding of the division, so the count is exact.
    """
    draws = standard_draws(n)
    low, width = draws[0], (draws[-1] - draws[0]) / DRAW_CELLS
    at = [min(DRAW_CELLS - 1, int((z - low) / width)) for z in draws]
    near = [[z for z, c in zip(draws, at) if abs(c - cell) <= 1] for cell in range(DRAW_CELLS)]
    below = [bisect.bisect_left(at, cell - 1) for cell in range(DRAW_CELLS)]
    even = F.try_divide(value - cutoff, std)
    cell = F.least(F.lit(DRAW_CELLS - 1), F.greatest(F.lit(0), F.floor((even - F.lit(low)) / F.lit(width)))).cast("int")
    close = F.get(F.from_json(F.lit(json.dumps(near)), "array<array<double>>"), cell)
    start = F.get(F.from_json(F.lit(json.dumps(below)), "array<int>"), cell)
    return start + F.size(F.filter(close, lambda z: (cutoff + z * std) < value))


def exceedance(cutoff: Column, std: Column, rank: Column) -> Column:
    """Share of the shared draws z for which rank <= max(1, cutoff + z * std)."""
    base, spread, r = cutoff.cast("double"), std.cast("double"), rank.cast("double")
    share = (F.lit(N_DRAWS) - _failing_draws(base, spread, r)).cast("double") / F.lit(float(N_DRAWS))
    return F.when(rank <= 1, F.lit(1.0)).when(
        std > 0, share).otherwise(F.when(base >= r, 1.0).otherwise(0.0))


def draw_percentile(cutoff: Column, std: Column, q: float, n: int = N_DRAWS) -> Column:
    """Linear-interpolation percentile of max(1, cutoff + z * std) over the shared draws."""
    draws = standard_draws(n)
    at = q * (n - 1)
    lo = int(math.floor(at))
    hi = min(lo + 1, n - 1)
    low = F.greatest(F.lit(1.0), cutoff + F.lit(draws[lo]) * std)
    high = F.greatest(F.lit(1.0), cutoff + F.lit(draws[hi]) * std)
    return low + (high - low) * F.lit(at - lo)


def percentile_exceedance(cutoff: Column, std: Column, value: Column) -> Column:
    """As ``exceedance`` on any scale and with 10,000 draws, in percent; without spread it is a plain comparison."""
    passing = F.lit(PERCENTILE_DRAWS) - _failing_draws(cutoff, std, value, PERCENTILE_DRAWS)
    return F.when(std <= 0, F.when(value <= cutoff, 100.0).otherwise(0.0)).otherwise(
        passing.cast("double") / F.lit(PERCENTILE_DRAWS / 100.0))


def point_likelihood(cutoff: Column, rank: Column) -> Column:
    return F.when(rank <= cutoff, 1.0).otherwise(0.0)


def interval(predicted: Column, radius: Column) -> tuple[Column, Column, Column]:
    low = F.greatest(F.lit(1), F.floor(predicted - radius)).cast("bigint")
    mid = F.bround(predicted.cast("double"), 0).cast("bigint")
    high = F.greatest(F.lit(1), F.ceil(predicted + radius)).cast("bigint")
    return low, mid, high


def rank_ratio(rank: Column, predicted: Column) -> Column:
    return F.greatest(rank.cast("double"), F.lit(1.0)) / F.greatest(predicted.cast("double"), F.lit(1.0))


def margin_score(rank: Column, predicted: Column) -> Column:
    return (predicted - rank) / F.greatest(predicted.cast("double"), F.lit(1.0))


def ratio_bucket(rank: Column, predicted: Column) -> Column:
    r = rank_ratio(rank, predicted)
    return (
        F.when(r <= SAFE_RATIO, "safe_backup").when(r <= REALISTIC_RATIO, "best_realistic")
        .when(r <= REACH_RATIO, "ambitious_reach").otherwise("unlikely_reach")
    )


def confidence_label(p: Column) -> Column:
    return F.when(p >= SAFE_PROBABILITY, "Safe").when(p >= MODERATE_PROBABILITY, "Moderate").otherwise("Ambitious")


def view_bucket(bucket: Column, label: Column, percent: Column) -> Column:
    """Bucket shown in lists: the stored one, else from the label, else from the percent."""
    by_label = (
        F.when(label == "Safe", "safe_backup").when(label == "Moderate", "best_realistic")
        .when(label == "Ambitious", "ambitious_reach")
    )
    by_percent = (
        F.when(percent >= VIEW_SAFE_PERCENT, "safe_backup")
        .when(percent >= VIEW_TARGET_PERCENT, "best_realistic").otherwise("ambitious_reach")
    )
    return F.coalesce(F.nullif(bucket, F.lit("")), by_label, by_percent)


def view_tier(bucket: Column, label: Column, percent: Column) -> Column:
    b = view_bucket(bucket, label, percent)
    by_percent = (
        F.when(percent >= VIEW_SAFE_PERCENT, "safe")
        .when(percent >= VIEW_TARGET_PERCENT, "target").otherwise("reach")
    )
    return (
        F.when(b == "safe_backup", "safe").when(b == "best_realistic", "target")
        .when(b == "ambitious_reach", "reach").otherwise(by_percent)
    )


def institute_score(kind: Column) -> Column:
    k = F.upper(kind)
    chain = None
    for name, value in INSTITUTE_SCORE.items():
        chain = F.when(k == name, value) if chain is None else chain.when(k == name, value)
    return chain.otherwise(INSTITUTE_SCORE_DEFAULT)


def _unit(c: Column) -> Column:
    return F.least(F.lit(1.0), F.greatest(F.lit(0.0), c))


def competitiveness(log_predicted: Column, low: Column, high: Column) -> Column:
    span = high - low
    return F.when(span <= 0, 1.0).otherwise(_unit(1.0 - F.try_divide(log_predicted - low, span)))


def desirability(competitive: Column, institute: Column, branch: Column) -> Column:
    return 0.45 * competitive + 0.25 * institute + 0.30 * branch


def admissibility(p: Column) -> Column:
    flattened = 1.0 - 0.18 * _unit((p - 0.85) / 0.15)
    return _unit(F.when(p > 0.85, flattened).otherwise(F.least(p / 0.75, F.lit(1.0))))


def fit(predicted: Column, rank: Column, p: Column) -> Column:
    ratio = F.greatest(predicted.cast("double"), F.lit(1.0)) / F.greatest(rank.cast("double"), F.lit(1.0))
    off = F.ln(ratio) - F.lit(math.log(1.18))
    return _unit(F.exp(-(off * off) / F.lit(2 * 0.75 ** 2)) * F.least(p / 0.35, F.lit(1.0)))


def safety(p: Column, predicted: Column, rank: Column) -> Column:
    return p * _unit(margin_score(rank, predicted))


def recommendation_score(desirable: Column, admissible: Column, fitting: Column) -> Column:
    viable = desirable * F.greatest(admissible, fitting)
    return decimals(100.0 * (0.45 * viable + 0.30 * fitting + 0.25 * admissible), 4, even=True)


def legacy_score(p: Column, predicted: Column, rank: Column) -> Column:
    return p * 100 + ((predicted - rank) / predicted.cast("double")) * 20


def rank_band(rank: Column) -> Column:
    chain = None
    for edge, label in zip(RANK_BAND_EDGES, RANK_BANDS):
        chain = F.when(rank <= edge, label) if chain is None else chain.when(rank <= edge, label)
    return F.when(rank >= 0, chain.otherwise(RANK_BANDS[-1]))


def years_since_ews(year: Column) -> Column:
    return F.greatest(year - F.lit(FIRST_EWS_YEAR), F.lit(0))


def percentile_of(rank: Column, total: Column) -> Column:
    return F.when(total == 0, 0.0).otherwise(F.try_divide(rank.cast("double"), total.cast("double")) * 100.0)


def rank_of(percentile: Column, total: Column) -> Column:
    """Inverse of ``percentile_of``: rounded half away from zero, kept in [1, total]."""
    raw = F.round(percentile / 100.0 * total.cast("double"), 0)
    return F.when(total == 0, F.lit(1)).otherwise(
        F.least(F.greatest(raw, F.lit(1.0)), total.cast("double"))
    ).cast("bigint")


def predicted_rank(raw: Column) -> Column:
    return F.greatest(F.lit(1), F.bround(raw.cast("double"), 0)).cast("bigint")


def reach_window(rank: Column) -> tuple[Column, Column]:
    r = rank.cast("double")
    return F.bround(r * 0.60, 0).cast("bigint"), F.bround(r * 1.05, 0).cast("bigint")


def approximate_opening(closing: Column) -> Column:
    return closing - F.floor(closing / 5).cast("bigint")
