"""FASTA and Stockholm files."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions.sequences import iupac_density, standardise
from .hits import lines


def records(spark: SparkSession, path: str) -> DataFrame:
    """``ordinal, seq_name, sequence``: records in file order; the name is the header's first token.

    A file is split at ``\\n>``, so that a record is one row however its lines are wrapped.
    """
    raw = spark.read.option("lineSep", "\n>").text(path).select(F.monotonically_increasing_id().alias("ordinal"), F.regexp_replace("value", "^>", "").alias("value"))
    head = F.substring_index("value", "\n", 1)
    body = F.when(F.instr("value", "\n") > 0, F.expr("substring(value, instr(value, '\n') + 1)")).otherwise(F.lit(""))
    return raw.select("ordinal", F.regexp_extract(head, r"^\s*(\S+)", 1).alias("seq_name"), F.regexp_replace(body, r"\s", "").alias("sequence")).where("seq_name <> ''")


def registry(spark: SparkSession, path: str) -> DataFrame:
    """``seq_id, seq_name``: names numbered from 0 in file order.

    Names are counted within file splits and the splits' totals added up, so that no window spans all names.
    """
    names = records(spark, path).groupBy("seq_name").agg(F.min("ordinal").alias("ordinal")).withColumn("split", F.shiftright("ordinal", 33))
    totals = names.groupBy("split").agg(F.count("*").alias("n"))
    base = totals.select("split", (F.sum("n").over(Window.orderBy("split")) - F.col("n")).alias("base"))  # one row a split
    local = F.row_number().over(Window.partitionBy("split").orderBy("ordinal")) - 1
    return names.withColumn("local", local).join(base, "split").select((F.col("base") + F.col("local")).alias("seq_id"), "seq_name")


def count(spark: SparkSession, path: str) -> int:
    """The number of records; 0 for a missing file."""
    try:
        return lines(spark, path).where("startswith(value, '>')").count()
    except FileNotFoundError:
        return 0


def sequences(spark: SparkSession, path: str, upper: bool = False) -> DataFrame:
    """``seqid, sequence``; of records with one name the last."""
    last = records(spark, path).groupBy("seq_name").agg(F.max_by("sequence", "ordinal").alias("sequence"))
    return last.select(F.col("seq_name").alias("seqid"), (F.upper("sequence") if upper else F.col("sequence")).alias("sequence"))


def rna_dataset(spark: SparkSession, path: str, dataset: str, *, max_density: float = 0.05, preserve_case: bool = True) -> DataFrame:
    """``dataset, header, sequence`` as RNA, without empty sequences and those with too many degenerate codes."""
    rows = sequences(spark, path).select(F.lit(dataset).alias("dataset"), F.col("seqid").alias("header"), standardise(F.col("sequence"), keep_case=preserve_case).alias("sequence"))
    return rows.where((F.length("sequence") > 0) & (iupac_density(F.col("sequence")) <= max_density))


def lengths(spark: SparkSession, path: str) -> DataFrame:
    """``seq_id, length`` of each sequence."""
    return sequences(spark, path).select(F.col("seqid").alias("seq_id"), F.length("sequence").cast("bigint").alias("length"))


def stockholm(spark: SparkSession, path: str, dataset: str) -> DataFrame:
    """``dataset, header, sequence`` of a Stockholm file; the blocks of interleaved sequences are joined."""
    rows = lines(spark, path).where(r"value RLIKE '^[^#/\\s]\\S*\\s+\\S'")
    parts = rows.select("line_no", F.split(F.trim("value"), r"\s+").alias("f")).select("line_no", F.col("f")[0].alias("header"), F.col("f")[1].alias("part"))
    ordered = F.array_sort(F.collect_list(F.struct("line_no", "part")))
    return parts.groupBy("header").agg(ordered.alias("x")).select(F.lit(dataset).alias("dataset"), "header", F.array_join("x.part", "").alias("sequence"))
