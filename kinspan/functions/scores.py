"""Similarity of spans as column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def ratio(part: Column, whole: Column) -> Column:
    """part / whole as a double, 0 where the denominator is 0."""
    return F.when(whole != 0, part / whole).otherwise(F.lit(0.0))


def checked(value: Column, what: str) -> Column:
    """The value, or an error where it is outside [0, 1]."""
    bad = (value < 0) | (value > 1)
    return F.when(bad, F.raise_error(F.lit(f"{what} is outside [0, 1]")).cast("double")).otherwise(value)


def jaccard(inter: Column, a: Column, b: Column) -> Column:
    return checked(inter / (a + b - inter), "a Jaccard coefficient")


def containment(inter: Column, a: Column, b: Column) -> Column:
    return checked(inter / F.least(a, b), "a containment")


def vote(strand: Column) -> Column:
    """The majority of +1 and -1; ``+`` on a tie or without a vote."""
    return F.when(F.count_if(strand < 0) > F.count_if(strand > 0), F.lit("-")).otherwise(F.lit("+"))
