"""Coupon-collector arithmetic as column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from ..schema import SAFETY_FACTOR


def harmonic(k: Column) -> Column:
    return F.aggregate(F.sequence(F.lit(1), k), F.lit(0.0), lambda a, i: a + F.lit(1.0) / i)


def expected_uniform(k: Column) -> Column:
    return k * harmonic(k)


def required(k: Column, factor: float = SAFETY_FACTOR) -> Column:
    """Observations that k equally likely tiers need: ceil(factor * k * H(k))."""
    return F.ceil(F.round(expected_uniform(k) * factor, 9)).cast("long")


def _subsets(shares: Column, start: Column, of) -> Column:
    """Sum over the subsets of shares of sign * of(sum of the subset)."""
    k = F.size(shares)
    masks = F.sequence(F.lit(0), F.call_function("shiftleft", F.lit(1), k) - 1)

    def term(acc, mask):
        inside = F.aggregate(F.sequence(F.lit(0), k - 1), F.lit(0.0), lambda s, i: s + F.when(F.call_function("getbit", mask, i) == 1, F.get(shares, i)).otherwise(F.lit(0.0)))
        return acc + F.when(F.bit_count(mask) % 2 == 0, 1.0).otherwise(-1.0) * of(mask, inside)

    return F.aggregate(masks, start, term)


def all_seen(shares: Column, n: Column, most: int = 20) -> Column:
    """P(every one of the tiers with these shares turns up in n draws), by inclusion and exclusion."""
    p = _subsets(shares, F.lit(0.0), lambda _, inside: F.pow(F.greatest(F.lit(0.0), 1 - inside), n))
    return F.when((F.size(shares) >= 1) & (F.size(shares) <= most) & (n >= 0), F.greatest(F.lit(0.0), F.least(F.lit(1.0), p)))


def expected_draws(shares: Column, times: int = 1) -> Column:
    """Expected draws until every tier is seen (times = 1), for unequal shares."""
    total = _subsets(shares, F.lit(0.0), lambda mask, inside: F.when(mask == 0, 0.0).otherwise(-1 / F.when(inside > 0, inside)))
    return total * times


def floor_ladder(k: int, floor: float) -> list[float]:
    """The lowest tier at share `floor`, the rest equal."""
    return [floor] + [(1 - floor) / (k - 1)] * (k - 1) if k > 1 else [1.0]
