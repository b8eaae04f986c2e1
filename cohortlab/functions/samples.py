"""Sample sizes, as Columns over columns of parameters; null where the parameters make no sense. Shares are 0 to 1, but for
the survey's frequency and margin, which are percentages."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: A published approximation of the normal distribution (Abramowitz and Stegun 26.2.19), in the digits that these
#: sizes are defined with. The share beyond z on both sides is the polynomial's value to the power of -16.
TAIL = (1.0, 0.04986735, 0.02114101, 0.00327763, 0.0000380036, 0.0000488906, 0.000005383)


def two_sided_z(level: float) -> float:
    """The deviate that leaves 1 - level on both sides together, by that approximation."""
    wanted = (1 - level) ** (-1 / 16)
    low, high = 0.0, 40.0
    while high - low > 1e-12:
        z = (low + high) / 2
        value = 0.0
        for factor in reversed(TAIL):
            value = value * z + factor
        low, high = (z, high) if value < wanted else (low, z)
    return (low + high) / 2


def power_z(power: float) -> float:
    """The deviate below which the share ``power`` lies."""
    return two_sided_z(2 * power - 1) if power >= 0.5 else -two_sided_z(1 - 2 * power)


def survey_size(population: Column, frequency: Column, margin: Column, effect: Column, clusters: Column, level: float) -> Column:
    """Records per cluster: the size for a proportion with a finite population, rounded half to even, times the design
    effect, shared among the clusters and rounded up."""
    free = two_sided_z(level) ** 2 * frequency * (100 - frequency) / (margin * margin)
    whole = F.bround(free / (1 + free / population), 0)
    able = (population > 0) & (frequency > 0) & (frequency < 100) & (margin > 0) & (effect > 0) & (clusters >= 1)
    return F.when(able, F.ceil(effect * whole / clusters).cast("long"))


def share_from_odds(unexposed: Column, odds: Column) -> Column:
    """The exposed share that an odds ratio gives."""
    return F.when((unexposed > 0) & (unexposed < 1) & (odds > 0), unexposed * odds / (1 + unexposed * (odds - 1)))


def odds_from_shares(unexposed: Column, exposed: Column) -> Column:
    able = (unexposed > 0) & (unexposed < 1) & (exposed > 0) & (exposed < 1)
    return F.when(able, exposed * (1 - unexposed) / (unexposed * (1 - exposed)))


def odds_from_risk(unexposed: Column, risk_ratio: Column) -> Column:
    return odds_from_shares(unexposed, unexposed * risk_ratio)


def comparison_sizes(unexposed: Column, odds: Column, ratio: Column, level: float, power: float) -> dict[str, Column]:
    """Sizes of both groups by three published methods (Kelsey; Fleiss; Fleiss with continuity correction). ``ratio``: members
    of the second group for each of the first. The groups are exposed and unexposed in a cohort or cross-sectional study,
    cases and controls (with ``unexposed`` the controls' exposure) in an unmatched case-control study."""
    za, zb = two_sided_z(level), power_z(power)
    p0, p1 = unexposed, share_from_odds(unexposed, odds)
    mean = (p1 + ratio * p0) / (1 + ratio)
    spread, gap = mean * (1 - mean) * (ratio + 1), F.abs(p1 - p0)
    kelsey = (za + zb) ** 2 * spread / (gap * gap * ratio)
    root = za * F.sqrt(spread) + zb * F.sqrt(ratio * p1 * (1 - p1) + p0 * (1 - p0))
    fleiss = root * root / (ratio * gap * gap)
    correction = 1 + F.sqrt(1 + 2 * (ratio + 1) / (fleiss * ratio * gap))
    sizes = {"kelsey": kelsey, "fleiss": fleiss, "fleiss_cc": fleiss * correction * correction / 4}
    able = (odds != 1) & (ratio > 0)
    return {f"{name}_{k}": F.when(able, F.ceil(x * by).cast("long")) for name, x in sizes.items() for k, by in (("first", F.lit(1)), ("second", ratio))}
