"""From raw documents to packed batches: five stages, each over all that the one before kept.

All stages but the last return the columns of ``docs``, whatever their names; an empty table gives an empty
result; rows with equal ids are documents of their own but for what a stage says of them.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from kinspan.llm.near import keep_one
from kinspan.llm.packing import pack
from kinspan.llm.pii import replace_entities
from kinspan.llm.quality import held_out, score_quality
from kinspan.llm.queries import DEMONSTRATION_KEY
from kinspan.llm.repeats import drop_repeats
from kinspan.plans.shared import fresh_folder


def _keeping(docs: DataFrame, made: tuple[str, ...], apply: Callable[[DataFrame], DataFrame]) -> DataFrame:
    """``apply(docs)`` with the columns of ``docs``, also where an operator makes columns of the same names."""
    aside = {c: f"__own_{i}" for i, c in enumerate(docs.columns) if c in made}
    out = apply(docs.withColumnsRenamed(aside))
    if "n_chars" in docs.columns:
        length = F.char_length(F.coalesce("text", F.lit(""))).cast(docs.schema["n_chars"].dataType)
        out = out.withColumn("n_chars", length)
    return out.select(*(F.col(f"`{aside.get(c, c)}`").alias(c) for c in docs.columns))


def quality_classifier(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the classifier rejects go; null and empty texts are judged as texts without passages."""
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet")
    made = ("score", "predicted", "attention")
    return _keeping(docs, made, lambda x: score_quality(x, labels, usable=~held_out()).where("predicted = 1"))


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near duplicates stays: five-word shingles, Jaccard from 0.8.

    Null and empty texts and rows without an id are linked with nothing and stay; rows with equal ids stay or go together.
    """
    return keep_one(docs)


def substring_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Runs of 50 words that an earlier document has are cut out; documents left without a word go.

    A null text becomes an empty one; documents that had no word stay.
    """
    made = ("n_words", "n_removed", "removed")
    return _keeping(docs, made, lambda x: drop_repeats(x).where("n_words = 0 OR n_removed < n_words"))


def pii(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Personal data is replaced by surrogates; null and empty texts stay as they are."""
    return _keeping(docs, ("n_entities",), lambda x: replace_entities(x, DEMONSTRATION_KEY))


def packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Batches of documents of like length; null and empty texts have length 0 and are packed like others."""
    return pack(docs)


STAGES: list[tuple[str, Callable[[SparkSession, DataFrame, str], DataFrame]]] = [
    ("quality classifier", quality_classifier),
    ("MinHash near-dedup", near_dedup),
    ("substring dedup", substring_dedup),
    ("PII", pii),
    ("packing", packing),
]

#: The classifier is fitted, the surrogates are keyed and the buckets are optimised: none of it is SQL.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The stages over ``documents``, each one's result written to the shared folder and read again."""
    folder = fresh_folder(spark, "pipeline")
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for number, (_, stage) in enumerate(STAGES):
        stage(spark, docs, sf_dir).write.parquet(f"{folder}/{number}")
        docs = spark.read.parquet(f"{folder}/{number}")
    return docs
