"""Running counts of query spans over a stream of hits."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators.intervals import normalise_hits


def running_spans(raw: DataFrame) -> DataFrame:
    """Multiplicities of distinct spans over all hits so far, for ``complete`` or ``update`` output.

    ``raw`` is a stream of BLAST-TAB columns; normalising keeps no state, the counts are Spark's own.
    """
    return normalise_hits(raw).groupBy("q_seq", "q_start", "q_end").agg(F.count("*").alias("w"))
