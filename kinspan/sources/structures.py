"""Printed output of structure tools, one file a dataset: consensus structures, energies and scores."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: An energy in brackets, alone or before the terms that it is the sum of, and the total of a score file.
ENERGY = r"\(\s*(-?\d+\.\d+)\s*[=)]"
SCORE = r"SCORE\s*=\s*(\d+)"


def consensus_structure(printed: str) -> str:
    """The structure of a folded alignment: the first word of the second line that is printed."""
    lines = printed.splitlines()
    words = lines[1].split() if len(lines) > 1 else []
    return words[0] if words else ""


def _files(spark: SparkSession, path: str) -> DataFrame:
    """``dataset, text``: whole files, named by their dataset (without what follows the first dot)."""
    name = F.regexp_extract(F.input_file_name(), r"([^/.]+)[^/]*$", 1)
    return spark.read.text(path, wholetext=True).select(F.url_decode(name).alias("dataset"), F.col("value").alias("text"))


def _number(text: Column, pattern: str) -> Column:
    found = F.regexp_extract(text, pattern, 1)
    return F.when(found != "", found.cast("double"))


def read_consensus(spark: SparkSession, path: str) -> DataFrame:
    """``dataset, dbn, consensus_mfe`` of folded alignments; null where a file does not say."""
    line = F.get(F.split(F.get(F.split("text", "\r?\n"), F.lit(1)), r"\s+"), F.lit(0))
    return _files(spark, path).select("dataset", F.nullif(line, F.lit("")).alias("dbn"), _number(F.col("text"), ENERGY).alias("consensus_mfe"))


def read_single_energies(spark: SparkSession, path: str) -> DataFrame:
    """``dataset, mean_single_mfe`` over the sequences folded by themselves; null where none has an energy."""
    found = F.regexp_extract_all("text", F.lit(ENERGY), F.lit(1))
    rows = _files(spark, path).select("dataset", F.explode_outer(found).alias("mfe"))
    return rows.groupBy("dataset").agg(F.avg(F.col("mfe").cast("double")).alias("mean_single_mfe"))


def read_scores(spark: SparkSession, path: str) -> DataFrame:
    """``dataset, score``: the total of each score file."""
    return _files(spark, path).select("dataset", _number(F.col("text"), SCORE).alias("score"))
