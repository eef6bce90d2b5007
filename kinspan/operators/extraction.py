"""Sub-sequences of features, and secondary features in their coordinates."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.sequences import closed_slice, iupac_density, reverse_complement
from ..plans.shared import cut
from .intervals import touching


def extract(
    features: DataFrame,
    sequences: DataFrame,
    *,
    flank: int = 0,
    max_density: float = 0.05,
    preserve_case: bool = True,
) -> DataFrame:
    """Sequences of features, extended by ``flank`` within their sequence and read along their strand.

    ``features``: ``seqid, start, end, strand, ID`` (one-based, closed) and optionally ``row``, which names
    features without an ID; ``sequences``: ``seqid, sequence``.  Features of unknown sequences, and
    sequences with more than ``max_density`` degenerate codes, are left out.
    Result: ``header, seqid, fid, ext_start, ext_end, strand, sequence``.
    """
    # a sequence is measured once, not with each of its features
    rows = features.join(sequences.withColumn("__len", F.length("sequence")), "seqid")
    fid = F.when(F.coalesce("ID", F.lit("")) != "", F.col("ID"))
    if "row" in features.columns:
        fid = F.coalesce(fid, F.concat(F.lit("feature_"), F.col("row").cast("string")))
    rows = rows.select(
        "seqid", fid.alias("fid"), "strand", "sequence",
        F.greatest(F.lit(1), F.col("start") - flank).alias("ext_start"),
        F.least("__len", F.col("end") + flank).alias("ext_end"),
    )
    # a filter within a list of one, as a plain one would cut the part out anew for each time that it names it; a complement is as degenerate
    part = F.filter(F.array(closed_slice(F.col("sequence"), F.col("ext_start"), F.col("ext_end"))), lambda s: iupac_density(s) <= max_density)
    rows = rows.withColumn("sequence", F.explode(part))
    rows = rows.withColumn("sequence", F.when(F.col("strand") == "-", reverse_complement(F.col("sequence"), preserve_case)).otherwise(F.col("sequence")))
    header = F.concat_ws("::", "fid", "seqid", F.concat(F.col("ext_start"), F.lit("_"), F.col("ext_end"), F.lit(f"_flank{flank}")))
    return rows.select(
        header.alias("header"), "seqid", "fid", "ext_start", "ext_end", "strand", "sequence"
    )


def remap(extracted: DataFrame, secondary: DataFrame) -> DataFrame:
    """Secondary features that touch an extracted one, in its coordinates and along its strand.

    ``secondary``: ``seqid, start, end, strand`` and what else a GFF has.
    """
    other = secondary.withColumnsRenamed({"start": "s_start", "end": "s_end", "strand": "s_strand"})
    # extracts are looked at three times, so they are made once, without their sequences
    own = cut(extracted.select("header", "seqid", "fid", "ext_start", "ext_end", F.col("strand").alias("p_strand"), F.length("sequence").alias("n")))
    # one-based closed positions as half-open ones; an empty extract, whose end lies before its start, is touched by what holds both
    def span(frame: DataFrame, low: str, high: str) -> DataFrame:
        return frame.withColumns({f"__{low}": F.least(low, high).cast("bigint"), f"__{high}": F.greatest(low, high).cast("bigint") + 1})

    rows = touching(span(own, "ext_start", "ext_end"), span(other, "s_start", "s_end"), key="seqid", left_span=("__ext_start", "__ext_end"), right_span=("__s_start", "__s_end"))
    rows = rows.where("s_start <= ext_end AND s_end >= ext_start")
    low, high = F.greatest("s_start", "ext_start"), F.least("s_end", "ext_end")
    minus = F.col("p_strand") == "-"
    clamp = lambda x: F.greatest(F.lit(1), F.least(x, F.col("n")))
    flipped = F.when(F.col("s_strand") == "+", "-").when(F.col("s_strand") == "-", "+").otherwise(F.col("s_strand"))
    kept = [c for c in ("source", "type", "score", "phase", "ID") if c in secondary.columns]
    if "attributes" in secondary.columns:
        tail = F.concat(F.lit("PrimaryFeatureID="), F.col("fid"))
        kept.append(F.when(F.coalesce("attributes", F.lit("")) != "", F.concat_ws(";", "attributes", tail)).otherwise(tail).alias("attributes"))
    return rows.select(
        F.col("header").alias("seqid"),
        F.when(minus, clamp(F.col("ext_end") - high + 1)).otherwise(clamp(low - F.col("ext_start") + 1)).alias("start"),
        F.when(minus, clamp(F.col("ext_end") - low + 1)).otherwise(clamp(high - F.col("ext_start") + 1)).alias("end"),
        F.when(minus, flipped).otherwise(F.col("s_strand")).alias("strand"),
        *kept,
        F.col("fid").alias("parent_feature_id"),
    )
