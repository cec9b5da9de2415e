"""Numeric rules that decide equality of scores."""

from pyspark.sql import Column, functions as F


def half_up(c: Column) -> Column:
    """Round half towards +infinity to a whole number (2.5 -> 3, -2.5 -> -2)."""
    return F.floor(c + F.lit(0.5)).cast("bigint")


def clamp01(c: Column) -> Column:
    return F.greatest(F.lit(0.0), F.least(F.lit(1.0), c.cast("double")))


def share(part: Column, whole: Column) -> Column:
    """part / whole, 0 when there is nothing to divide by."""
    return F.when(whole > 0, part.cast("double") / whole).otherwise(F.lit(0.0))


def toward(value: Column, target) -> Column:
    """Progress towards a target, limited to [0, 1]."""
    t = target if isinstance(target, Column) else F.lit(target)
    return F.when(t <= 0, F.lit(0.0)).otherwise(clamp01(value.cast("double") / t))


def steps(value: Column, cuts, otherwise) -> Column:
    """First cut from the top that ``value`` reaches: cuts = [(800, 1.0), (500, 0.8), ...]."""
    out = None
    for at, result in cuts:
        r = F.lit(result)
        out = F.when(value >= at, r) if out is None else out.when(value >= at, r)
    return out.otherwise(F.lit(otherwise))


def ladder(value: Column, cuts, otherwise) -> Column:
    """First cut from the bottom that ``value`` does not exceed."""
    out = None
    for upto, result in cuts:
        r = F.lit(result)
        out = F.when(value <= upto, r) if out is None else out.when(value <= upto, r)
    return out.otherwise(F.lit(otherwise))


def cents(amount: Column) -> Column:
    """Decimal amount held as a double -> whole cents."""
    return F.floor(amount * 100 + 0.5).cast("bigint")
