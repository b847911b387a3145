"""Random numbers that are functions of their keys.

A draw depends on what it is for, never on partitions or order, so reruns and
other engines give the same numbers.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def key(*parts: Column | str | int) -> Column:
    """md5 of the parts joined by colons; strings are column names."""
    cols = [F.col(p) if isinstance(p, str) else p if isinstance(p, Column) else F.lit(p) for p in parts]
    return F.md5(F.concat_ws(":", *[c.cast("string") for c in cols]).cast("binary"))


def uniform(*parts: Column | str | int) -> Column:
    """In (0, 1), with 48 random bits."""
    return (F.conv(F.substring(key(*parts), 1, 12), 16, 10).cast("long") + F.lit(0.5).cast("double")) / F.lit(281474976710656.0)


def exponential(weight: Column, *parts: Column | str | int) -> Column:
    """Key whose ascending order draws without replacement by weight."""
    return -F.ln(uniform(*parts)) / weight


def normal(*parts: Column | str | int) -> Column:
    """Standard normal, by Box and Muller."""
    return F.sqrt(F.lit(-2.0) * F.ln(uniform(*parts, F.lit("r")))) * F.cos(F.lit(6.283185307179586) * uniform(*parts, F.lit("a")))
