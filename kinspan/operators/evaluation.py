"""Predicted labels of sequences against reference labels.

Positions are never spelled out: every sequence is cut into segments at the ends of its features, and
counts are sums of segment lengths.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.scores import ratio
from .intervals import stabbed
from .quantiles import quantiles


def segments(features: DataFrame, lengths: DataFrame) -> DataFrame:
    """``seq_id, start, end, ref, pred``: stretches on which both labels are constant (null: unlabelled).

    ``features``: ``seq_id, start, end`` (zero-based, half-open), ``label_type`` (ref or pred), ``label``
    and ``ord``; of overlapping features of a type the one with the largest ``ord`` labels.  Ends
    beyond the sequence are cut off at it.  ``lengths``: ``seq_id, length``.
    """
    inside = features.join(lengths, "seq_id").withColumn("start", F.greatest("start", F.lit(0))).withColumn("end", F.least("end", "length"))
    inside = inside.where("start < end")
    # one pass over sequences with their features, if any: a union of both would lose the buckets of ``dealt``
    ends = F.array(*(F.col(c).cast("bigint") for c in ("start", "end")))
    whole = F.array(F.lit(0).cast("bigint"), F.col("length").cast("bigint"))
    cuts = lengths.join(inside.select("seq_id", "start", "end"), "seq_id", "left")
    cuts = cuts.select("seq_id", F.explode(F.when(F.col("start").isNull(), whole).otherwise(F.concat(ends, whole))).alias("at")).distinct()
    pieces = cuts.select("seq_id", F.col("at").alias("a"), F.lead("at").over(Window.partitionBy("seq_id").orderBy("at")).alias("b")).where("b IS NOT NULL")
    # no feature begins or ends within a piece, so a piece is in the features that hold its start
    over = stabbed(pieces, inside, key="seq_id", at="a", start="start", end="end")
    named = over.groupBy("seq_id", "a", "b").agg(
        *(F.max_by(F.when(F.col("label_type") == t, F.col("label")), F.when(F.col("label_type") == t, F.col("ord"))).alias(t) for t in ("ref", "pred"))
    )
    return pieces.join(named, ["seq_id", "a", "b"], "left").select("seq_id", F.col("a").alias("start"), F.col("b").alias("end"), "ref", "pred")


def unlabelled_regions(parts: DataFrame, label_type: str) -> DataFrame:
    """``seq_id, start, end``: maximal stretches without a label of the type."""
    order = Window.partitionBy("seq_id").orderBy("start")
    rows = parts.withColumn("bare", F.col(label_type).isNull())
    rows = rows.withColumn("opens", (F.col("bare") & ~F.coalesce(F.lag("bare").over(order), F.lit(False))).cast("int"))
    rows = rows.withColumn("region", F.sum("opens").over(order)).where("bare")
    return rows.groupBy("seq_id", "region").agg(F.min("start").alias("start"), F.max("end").alias("end")).drop("region")


def with_unlabelled(parts: DataFrame) -> DataFrame:
    """Segments where each unlabelled region has a label of its own, ``UNL_<type>_<seq>_<start>``.

    Segments follow one another, so a region begins at the last segment before which there was a label.
    """
    order = Window.partitionBy("seq_id").orderBy("start")
    for t in ("ref", "pred"):
        bare = F.col(t).isNull()
        opens = bare & F.coalesce(F.lag(~bare).over(order), F.lit(True))
        parts = parts.withColumn("__from", F.last(F.when(opens, F.col("start")), ignorenulls=True).over(order))
        parts = parts.withColumn(t, F.when(bare, F.concat_ws("_", F.lit("UNL"), F.lit(t), "seq_id", "__from")).otherwise(F.col(t)))
    return parts.drop("__from")


def contingency(labelled: DataFrame) -> DataFrame:
    """``ref, pred, nt, seqs``: positions and sequences of each pair of labels, from ``ref, pred, seq_id, len``."""
    return labelled.groupBy("ref", "pred").agg(F.sum("len").alias("nt"), F.count_distinct("seq_id").alias("seqs"))


def _margins(table: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame]:
    d = table.select("ref", "pred", F.col("nt").cast("double").alias("n"))
    return d, d.groupBy("ref").agg(F.sum("n").alias("a")), d.groupBy("pred").agg(F.sum("n").alias("b"))


def adjusted_rand(table: DataFrame) -> DataFrame:
    """``adjusted_rand`` of a contingency table; 1 where its denominator is 0."""
    d, rows, cols = _margins(table)
    pairs = lambda c: F.sum(F.col(c) * (F.col(c) - 1) / 2)
    # three one-row tables
    one = d.agg(pairs("n").alias("i"), F.sum("n").alias("t")).crossJoin(rows.agg(pairs("a").alias("x"))).crossJoin(cols.agg(pairs("b").alias("y")))
    expected = ratio(F.col("x") * F.col("y"), F.col("t") * (F.col("t") - 1) / 2)
    bottom = (F.col("x") + F.col("y")) / 2 - expected
    return one.select(F.when(bottom == 0, 1.0).otherwise((F.col("i") - expected) / F.nullif(bottom, F.lit(0.0))).alias("adjusted_rand"))


def normalised_mutual_information(table: DataFrame) -> DataFrame:
    """``normalised_mutual_information`` with the arithmetic mean of the entropies; 1 if both sides have one class."""
    d, rows, cols = _margins(table)
    total = d.agg(F.sum("n").alias("t"))
    term = F.col("n") / F.col("t") * F.log(F.col("n") * F.col("t") / (F.col("a") * F.col("b")))
    mi = d.join(rows, "ref").join(cols, "pred").crossJoin(F.broadcast(total)).agg(F.sum(term).alias("mi"))
    h = lambda frame, c, out: frame.crossJoin(F.broadcast(total)).agg(
        F.sum(-F.col(c) / F.col("t") * F.log(F.col(c) / F.col("t"))).alias(out), F.count("*").alias(f"n_{out}")
    )
    one = mi.crossJoin(h(rows, "a", "hr")).crossJoin(h(cols, "b", "hp"))
    value = F.when((F.col("n_hr") <= 1) & (F.col("n_hp") <= 1), 1.0).otherwise(ratio(F.col("mi"), (F.col("hr") + F.col("hp")) / 2))
    return one.select(value.alias("normalised_mutual_information"))


def majority_partners(features: DataFrame, parts: DataFrame, percents: tuple[int, ...] = (50, 75, 90), whole: str | None = None) -> DataFrame:
    """Features with ``partner`` and its ``share``, and a ``partner_<percent>`` for each of ``percents``.

    The partner is the label of the other type on most positions, of equal ones the leftmost; where
    unlabelled positions are the most there is none.  Shares are of the feature's length, or of the column ``whole`` (of a feature
    that was cut off at its sequence's end); they reach a cutoff by whole numbers, so that no rounding decides.
    """
    other = F.when(F.col("label_type") == "ref", F.col("p_pred")).otherwise(F.col("p_ref"))
    p = parts.select("seq_id", F.col("start").alias("a"), F.col("end").alias("b"), F.col("ref").alias("p_ref"), F.col("pred").alias("p_pred"))
    over = stabbed(p, features, key="seq_id", at="a", start="start", end="end").withColumn("other", other)
    keys = ["seq_id", "label_type", "ord"]  # a feature is of one sequence, by which all this may be dealt
    counts = over.groupBy(*keys, "other").agg(F.sum(F.col("b") - F.col("a")).alias("n"), F.min("a").alias("left"))
    best = counts.groupBy(*keys).agg(F.max_by("other", F.struct("n", -F.col("left"))).alias("partner"), F.max("n").alias("__n"))
    size = F.col(whole) if whole else F.col("end") - F.col("start")
    rows = features.join(best, keys, "left").withColumn("share", F.col("__n") / size)
    rows = rows.withColumns({f"partner_{c}": F.when(100 * F.col("__n") >= c * size, F.col("partner")) for c in percents})
    return rows.drop("__n")


def pair_statistics(rows: DataFrame) -> DataFrame:
    """``good, bad, missing, total`` pairs and their percentages, from ``label, partner`` (null: without one).

    Pairs of one label with the same partner are good, with different ones bad, others missing.
    """
    pairs = lambda n: F.col(n) * (F.col(n) - 1) / 2
    counts = rows.groupBy("label", "partner").agg(F.count("*").alias("n"))
    paired = F.when(F.col("partner").isNotNull(), F.col("n")).otherwise(F.lit(0))
    by_label = counts.withColumn("m", paired).groupBy("label").agg(
        F.sum("n").alias("size"), F.sum(pairs("m")).alias("good"), ((F.sum("m") * F.sum("m") - F.sum(F.col("m") * F.col("m"))) / 2).alias("bad")
    )
    s = by_label.agg(F.sum("good").alias("good"), F.sum("bad").alias("bad"), F.sum(pairs("size")).alias("total"))
    s = s.withColumn("missing", F.col("total") - F.col("good") - F.col("bad"))
    return s.select("good", "bad", "missing", "total", *((100 * ratio(F.col(c), F.col("total"))).alias(f"{c}_percent") for c in ("good", "bad", "missing")))


def label_counts(features: DataFrame) -> DataFrame:
    """``label_type, label, domains, nucleotides, seqs``."""
    return features.groupBy("label_type", "label").agg(
        F.count("*").alias("domains"), F.sum(F.col("end") - F.col("start")).alias("nucleotides"), F.count_distinct("seq_id").alias("seqs")
    )


def label_quartiles(counts: DataFrame, column: str = "domains") -> DataFrame:
    """Exact quartiles, mean and maximum of the labels' counts by type."""
    parts = quantiles(counts, ["label_type"], column, {"q1": 0.25, "median": 0.5, "q3": 0.75})
    whole = counts.groupBy("label_type").agg(F.count("*").alias("cluster_number"), F.max(column).alias("largest"), F.avg(column).alias("mean"))
    return whole.join(parts, "label_type").select("label_type", "cluster_number", "largest", "q1", "median", "mean", "q3")


def coverage(parts: DataFrame, label_type: str) -> DataFrame:
    """Counts of fully, partially and not labelled sequences, of unlabelled regions and of their positions."""
    size = F.col("end") - F.col("start")
    per = parts.groupBy("seq_id").agg(F.sum(size).alias("n"), F.sum(F.when(F.col(label_type).isNull(), size).otherwise(0)).alias("bare"))
    seqs = per.agg(
        F.count_if(F.col("bare") == 0).alias("fully_labeled_seqs"),
        F.count_if((F.col("bare") > 0) & (F.col("bare") < F.col("n"))).alias("partially_labeled_seqs"),
        F.count_if(F.col("bare") == F.col("n")).alias("fully_unlabeled_seqs"), F.coalesce(F.sum("bare"), F.lit(0)).alias("unlabeled_nucleotides"),
    )
    return seqs.crossJoin(unlabelled_regions(parts, label_type).agg(F.count("*").alias("unlabeled_regions")))  # two one-row tables


def real_pairs(table: DataFrame) -> DataFrame:
    """Contingency of labelled stretches only."""
    return table.where("ref IS NOT NULL AND pred IS NOT NULL AND NOT startswith(ref, 'UNL_') AND NOT startswith(pred, 'UNL_')")


def mixed(table: DataFrame, by: str, least: int = 2) -> DataFrame:
    """Labels of one side with ``least`` or more of the other: their lists, counts and sums, in the order of the labels.

    ``by='pred'`` gives glued references, ``by='ref'`` split ones (``least=1`` lists all references).
    """
    other = "ref" if by == "pred" else "pred"
    listed = F.array_sort(F.collect_list(F.struct(other, "nt", "seqs"))).alias("x")
    rows = real_pairs(table).groupBy(by).agg(listed, F.sum("nt").alias("nt_sum"), F.sum("seqs").alias("seq_sum"), F.count("*").alias("n"))
    text = lambda c: F.array_join(F.col(f"x.{c}").cast("array<string>"), "; ")
    return rows.where(F.col("n") >= least).select(
        by, text(other).alias(f"{other}_ids"), text("nt").alias("nt_counts"), "nt_sum", text("seqs").alias("seq_counts"), "seq_sum"
    )


def error_edges(table: DataFrame) -> DataFrame:
    """``source, target, nt, seqs``: pairs of labels of which one is glued, and all pairs of references."""
    return real_pairs(table).select(F.col("ref").alias("source"), F.col("pred").alias("target"), "nt", "seqs")
