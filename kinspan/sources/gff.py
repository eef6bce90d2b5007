"""GFF3 files and annotation tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.sequences import gff_id

SCHEMA = "seqid string, source string, type string, start int, end int, score string, strand string, phase string, attributes string"


def read_gff(spark: SparkSession, path: str) -> DataFrame:
    """The nine columns and ``ID``; comments are skipped."""
    return spark.read.csv(path, schema=SCHEMA, sep="\t", comment="#", quote="").withColumn("ID", gff_id(F.col("attributes")))


def labelled_features(spark: SparkSession, path: str, label_type: str, lengths: DataFrame, annotation: DataFrame | None = None) -> DataFrame:
    """Features of the types source and Domain for the evaluation: ``label_type, seq_id, start, end, label, ord, desc``.

    Starts become zero-based; ``ord`` is the order in the file.  A feature of an unknown sequence is a
    ``KeyError``, no feature at all a ``ValueError``.  ``annotation``: ``acc, desc``.
    """
    rows = read_gff(spark, path).withColumn("ord", F.monotonically_increasing_id()).where(F.col("type").isin("source", "Domain"))
    label = F.regexp_extract("attributes", "ID=([^;]*)", 1)
    rows = rows.select(
        F.lit(label_type).alias("label_type"), F.col("seqid").alias("seq_id"), (F.col("start") - 1).cast("bigint").alias("start"),
        F.col("end").cast("bigint").alias("end"), label.alias("label"), "ord",
    )
    if not rows.limit(1).count():
        raise ValueError(f"{path} has no feature of the types source and Domain")
    unknown = rows.join(lengths, "seq_id", "left_anti").head(1)
    if unknown:
        raise KeyError(unknown[0]["seq_id"])
    if annotation is None:
        return rows.withColumn("desc", F.lit(None).cast("string"))
    return rows.join(annotation.select(F.col("acc").alias("label"), "desc"), "label", "left")


def read_annotation(spark: SparkSession, path: str) -> DataFrame:
    """``acc, desc`` of a table with a header."""
    return spark.read.csv(path, sep="\t", header=True).select("acc", "desc")
