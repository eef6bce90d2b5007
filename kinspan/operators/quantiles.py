"""Exact quantiles by group without a group's values in one place."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .intervals import running


def value_bin(column: str) -> Column:
    """A number that never falls as the value grows; values of one bin differ by less than a thousandth."""
    v = F.col(column).cast("double")
    return F.floor(F.signum(v) * F.log2(F.abs(v) + 1) * 1024).cast("bigint")


def quantiles(rows: DataFrame, keys: list[str], column: str, fractions: dict[str, float], weight: str | None = None) -> DataFrame:
    """``keys`` and, under the names of ``fractions``, the quantiles of ``column`` with linear interpolation between neighbours.

    Equal values are counted first (``weight``: they are counted already), counts are added up by bins of values
    and within a bin, and the values at the wanted places are picked: so a group of any size is spread, and no buffer holds it.
    Nulls are left out; groups without a value have no row.
    """
    one = F.col(weight) if weight else F.lit(1)
    counts = rows.where(F.col(column).isNotNull()).groupBy(*keys, F.col(column).cast("double").alias("__v")).agg(F.sum(one).alias("__c"))
    counts = counts.withColumn("__bin", value_bin("__v"))
    counts = running(counts, keys, "__bin", {"__n": F.sum("__c")}, {"__before": F.sum("__n")}, {"__all": F.sum("__n")})
    within = F.sum("__c").over(Window.partitionBy(*keys, "__bin").orderBy("__v").rowsBetween(Window.unboundedPreceding, 0))
    counts = counts.withColumn("__to", F.coalesce("__before", F.lit(0)) + within).withColumn("__from", F.col("__to") - F.col("__c"))
    place = lambda p: (F.col("__all") - 1) * F.lit(float(p))
    at = lambda k: F.max(F.when((F.col("__from") <= k) & (k < F.col("__to")), F.col("__v")))
    picked = counts.groupBy(*keys).agg(
        F.max("__all").alias("__all"), *(at(f(place(p))).alias(f"__{side}_{n}") for n, p in fractions.items() for side, f in (("low", F.floor), ("high", F.ceil)))
    )
    value = lambda n, p: F.col(f"__low_{n}") + (place(p) - F.floor(place(p))) * (F.col(f"__high_{n}") - F.col(f"__low_{n}"))
    return picked.select(*keys, *(value(n, p).alias(n) for n, p in fractions.items()))
