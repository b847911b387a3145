"""Effective numbers of types, as columns."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Orders this close to 1 are the limit q = 1.
NEAR_ONE = 1e-9


def is_one(q: float) -> bool:
    return abs(q - 1.0) < NEAR_ONE


def term(x: Column, q: float) -> Column:
    """What a positive share adds to the sum of order q: x ln x, or x^q."""
    if is_one(q):
        return x * F.ln(x)
    return F.lit(1.0) if q == 0 else F.pow(x, F.lit(float(q)))


def from_sum(total: Column, q: float, root: float = 1.0) -> Column:
    """The number of types from its sum; ``root`` 2 for sums over pairs."""
    if is_one(q):
        return F.exp(-total / F.lit(root))
    return F.pow(total, F.lit(1.0 / (root * (1.0 - q))))


def hill(p: Column, q: float) -> Column:
    """Aggregate: the Hill number of positive shares p."""
    return from_sum(F.sum(term(p, q)), q)


def dissimilarity(beta: Column, q: float, n: Column | float = 2.0, div_type: str = "naive", viewpoint: str = "local") -> Column:
    """A beta diversity between 1 and n as a distance between 0 and 1. Values
    that are not positive stay as they are; undefined ones are null."""
    n = n if isinstance(n, Column) else F.lit(float(n))
    twice = 2.0 if div_type == "func" else 1.0
    if is_one(q):
        out = F.try_divide(F.ln(beta), F.ln(n) * F.lit(twice))
    else:
        top = F.pow(n, F.lit(twice * (1.0 - q)))
        if viewpoint == "local":
            out = F.lit(1.0) - F.try_divide(top - F.pow(beta, F.lit(1.0 - q)), top - 1)
        elif viewpoint == "regional":
            low = F.pow(n, F.lit(-twice * (1.0 - q)))
            out = F.lit(1.0) - F.try_divide(F.pow(beta, F.lit(-(1.0 - q))) - low, F.lit(1.0) - low)
        else:
            raise ValueError("viewpoint is 'local' or 'regional'")
    return F.when(beta <= 0, beta).otherwise(out)


def evenness(d: Column, s: Column, q: float, index: str = "CR1") -> Column:
    """Evenness of d effective among s types; null where it is undefined."""
    if index in ("CR1", "regional", "CR2", "local"):
        if is_one(q):
            return F.when((d > 0) & (s > 0), F.try_divide(F.ln(d), F.ln(s)))
        power = F.lit(1.0 - q if index in ("CR1", "regional") else q - 1.0)
        return F.when((d > 0) & (s > 0), F.try_divide(1 - F.pow(d, power), 1 - F.pow(s, power)))
    if index == "CR3":
        return F.try_divide(d - 1, s - 1)
    if index == "CR4":
        return F.try_divide(1 - F.try_divide(F.lit(1.0), d), 1 - F.try_divide(F.lit(1.0), s))
    if index == "CR5" or index == "pielou" and is_one(q):
        return F.try_divide(F.ln(d), F.ln(s))
    raise ValueError("index is one of CR1 to CR5, local, regional, or pielou with q = 1")
