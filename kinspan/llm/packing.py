"""Packing: length buckets that minimise padding, and token-budget batches inside them."""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..plans.shared import cut


def word_count(text: Column) -> Column:
    """Words ``[^\\x20\\x09-\\x0D]+`` of a text; null counts as empty."""
    text = F.coalesce(text, F.lit(""))
    return F.regexp_count(text, F.lit(r"[^\x20\x09-\x0D]+"))


def _step(length: Column, resolution: int | None) -> Column:
    """The histogram bin of a length: its number up to twice the resolution, as many bins for each doubling beyond."""
    if resolution is None:
        return length.cast("long")
    doubling = F.floor(F.log2(F.greatest(length, F.lit(1)).cast("double")))
    width = F.when(length <= 2 * resolution, F.lit(1.0)).otherwise(F.pow(F.lit(2.0), doubling) / resolution)
    return (F.ceil(length / width) * width).cast("long")


def length_histogram(lengths: DataFrame, length: str = "n_tokens", resolution: int | None = None) -> DataFrame:
    """``bin, longest, n, total`` for each bin of lengths that occurs."""
    return (
        lengths.groupBy(_step(F.col(length), resolution).alias("bin"))
        .agg(F.max(length).alias("longest"), F.count("*").alias("n"), F.sum(length).alias("total"))
        .orderBy("bin")
    )


def optimal_boundaries(longest: np.ndarray, n: np.ndarray, total: np.ndarray, buckets: int) -> list[int]:
    """Upper lengths of at most ``buckets`` buckets that minimise ``sum(boundary - length)``.

    Exact dynamic programming over the ascending bins: ``best[j]`` is the least padding of the bins before j with
    the buckets used so far.  The best cut does not fall as j grows, so that each layer is divided and
    conquered: half of what is left is looked at for each bin, on the average of the halvings.
    """
    bins = len(longest)
    if not bins:
        return []
    count = np.concatenate([[0], np.cumsum(n, dtype=np.float64)])
    mass = np.concatenate([[0], np.cumsum(total, dtype=np.float64)])
    best = np.concatenate([[0.0], longest * count[1:] - mass[1:]])
    cuts = [np.zeros(bins + 1, np.int64)]
    for _ in range(min(buckets, bins) - 1):
        better, at = np.zeros(bins + 1), np.zeros(bins + 1, np.int64)
        todo = [(1, bins, 0, bins - 1)]
        while todo:
            first, last, low, high = todo.pop()
            j = (first + last) // 2
            stop = min(j - 1, high) + 1
            padding = best[low:stop] + longest[j - 1] * (count[j] - count[low:stop]) - (mass[j] - mass[low:stop])
            at[j] = low + int(np.argmin(padding))
            better[j] = padding[at[j] - low]
            if first < j:
                todo.append((first, j - 1, low, int(at[j])))
            if j < last:
                todo.append((j + 1, last, int(at[j]), high))
        cuts.append(at)
        best = better
    bounds, j = [], bins
    for at in reversed(cuts):
        if j:
            bounds.append(int(longest[j - 1]))
            j = int(at[j])
    return bounds[::-1]


def pack(
    docs: DataFrame,
    length: Column | None = None,
    *,
    id_col: str = "doc_id",
    text_col: str = "text",
    budget: int = 16_384,
    buckets: int = 8,
    group_rows: int = 2048,
    resolution: int | None = None,
) -> DataFrame:
    """Batches of documents of like length, each within a budget of padded tokens.

    The histogram of all lengths is one aggregation with a row for each length that occurs, however many
    rows there are; the dynamic programme over it gives the boundaries with the least padding.  Where
    lengths may be too many for the driver, a ``resolution`` counts those beyond twice it in that many bins a
    doubling: boundaries are then at bins' longest lengths, and the padding is more than the least by 1 /
    ``resolution`` of the tokens at most.  Rows of a
    bucket are dealt by hash into groups of about ``group_rows`` and numbered there, longest
    first, so that no task sees a whole bucket; each group leaves at most one batch that is
    not full.  A batch has ``max(1, budget // boundary)`` slots: a document longer than the
    budget is a batch by itself, and nothing is cut or dropped.

    ``length`` defaults to the word count of the text.  Result, one row per input row:
    the id, ``n_tokens, bucket, boundary, batch_id, slot, padding``.  Null and empty texts
    have length 0 and are packed like others; null lengths count as 0 and negative ones are
    an error.  Rows with equal ids are packed separately; further columns are left out.  An
    empty table gives an empty result.
    """
    rows = docs.select(
        F.col(id_col).alias("id"),
        # rows without an id may be many alike: they are dealt apart by the partition that they come from
        F.xxhash64(F.col(id_col), F.col(text_col), F.when(F.col(id_col).isNull(), F.spark_partition_id())).alias("deal"),
        F.coalesce(length if length is not None else word_count(F.col(text_col)), F.lit(0)).cast("long").alias("n_tokens"),
    )
    rows = cut(rows)  # texts are read once, for both uses of their lengths
    histogram = length_histogram(rows, resolution=resolution).toPandas()
    if len(histogram) and histogram["longest"].min() < 0:
        raise ValueError("lengths must not be negative")
    bounds = optimal_boundaries(
        histogram["longest"].to_numpy(np.int64), histogram["n"].to_numpy(np.int64), histogram["total"].to_numpy(np.int64), buckets
    )
    sizes = np.zeros(len(bounds), np.int64)
    np.add.at(sizes, np.searchsorted(bounds, histogram["longest"].to_numpy(np.int64)), histogram["n"].to_numpy(np.int64))
    table = docs.sparkSession.createDataFrame(
        [
            (i, int(b), int(bounds[i - 1]) if i else -1, int(-(-int(s) // group_rows)) or 1, max(1, budget // max(1, int(b))))
            for i, (b, s) in enumerate(zip(bounds, sizes, strict=True))
        ],
        "bucket int, boundary long, above long, groups long, slots long",
    )
    placed = rows.join(F.broadcast(table), (F.col("n_tokens") > F.col("above")) & (F.col("n_tokens") <= F.col("boundary")))
    placed = placed.withColumn("part", F.pmod("deal", "groups"))
    # the number of a row within its group, longest first
    window = "OVER (PARTITION BY bucket, part ORDER BY n_tokens DESC, id, deal) - 1"
    return placed.withColumn("at", F.expr(f"row_number() {window}")).select(
        F.col("id").alias(id_col),
        "n_tokens",
        "bucket",
        "boundary",
        F.format_string("%d-%d-%d", "bucket", "part", F.floor(F.col("at") / F.col("slots"))).alias("batch_id"),
        (F.col("at") % F.col("slots")).cast(T.IntegerType()).alias("slot"),
        (F.col("boundary") - F.col("n_tokens")).alias("padding"),
    )
