"""Nucleotide sequences as column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: The IUPAC codes and their complements, and the degenerate ones among them.
CODES = "ACGTUNRYSWKMBDHVacgtunryswkmbdhv"
COMPLEMENTS = "TGCAANYRSWMKVHDBtgcaanyrswmkvhdb"
DEGENERATE = "[RYSWKMBDHVNryswkmbdhvn]"


def reverse_complement(seq: Column, preserve_case: bool = True) -> Column:
    """The reversed complement; U and T both pair with A, which pairs with T."""
    return F.reverse(F.translate(seq if preserve_case else F.upper(seq), CODES, COMPLEMENTS))


def ungapped(seq: Column) -> Column:
    return F.regexp_replace(seq, "[-.]", "")


def iupac_density(seq: Column) -> Column:
    """The share of degenerate codes among the characters that are no gaps; 0 for an empty sequence."""
    size = F.length(ungapped(seq))
    return F.when(size > 0, F.regexp_count(seq, F.lit(DEGENERATE)) / size).otherwise(F.lit(0.0))


def standardise(seq: Column, to_rna: bool = True, keep_case: bool = True) -> Column:
    """Without white space, as RNA (T to U) or as DNA (U to T)."""
    bare = F.regexp_replace(seq, r"\s", "")
    bare = bare if keep_case else F.upper(bare)
    return F.translate(bare, "Tt", "Uu") if to_rna else F.translate(bare, "Uu", "Tt")


def closed_slice(seq: Column, start: Column, end: Column) -> Column:
    """The part from start to end, counted from 1, both included."""
    return F.substring(seq, start.cast("int"), (end - start + 1).cast("int"))


def gff_id(attributes: Column) -> Column:
    """The ``ID`` of a GFF3 attribute string; empty without one."""
    return F.coalesce(F.regexp_extract(attributes, "(?:^|;)ID=([^;]+)", 1), F.lit(""))
