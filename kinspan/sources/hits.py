"""Alignment hits from BLAST-TAB files."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..operators.intervals import encode, normalise_hits
from ..plans.shared import cut

#: The standard twelve columns; the first ten must be there.
COLUMNS = ["query", "target", "pident", "alnlen", "mismatch", "gapopen", "qstart", "qend", "tstart", "tend", "evalue", "bits"]
TIMED_OUT = "_TimeoutError_"


def lines(spark: SparkSession, path: str) -> DataFrame:
    """``line_no, value`` of text files; line numbers ascend within a file and files follow by partition."""
    jvm_path = spark._jvm.org.apache.hadoop.fs.Path(path)
    if not jvm_path.getFileSystem(spark._jsc.hadoopConfiguration()).exists(jvm_path):
        raise FileNotFoundError(path)
    return spark.read.text(path).select(F.monotonically_increasing_id().alias("line_no"), "value")


def read_blast_tab(spark: SparkSession, path: str, registry: DataFrame | None = None, *, check_blocks: bool = True) -> DataFrame:
    """Normalised hits of a BLAST-TAB file, with ``line_no``.

    Blank lines and lines with ``#`` are skipped; hits of a sequence on itself are dropped before their
    coordinates are read.  Errors: a missing file (``FileNotFoundError``), a search that had timed out
    (``TimeoutError``), and as ``ValueError`` fewer than ten fields, coordinates that are no positive
    numbers, a query that comes back after another one, and no hit at all.  With a ``registry``
    (``seq_id, seq_name``) names become ids, and an unknown name is a ``KeyError``.
    """
    raw = lines(spark, path)
    first = raw.head(1)
    if first and first[0]["value"].strip() == TIMED_OUT:
        raise TimeoutError("the search behind this file had timed out")
    body = raw.where("trim(value) <> '' AND NOT startswith(value, '#')").select("line_no", F.split("value", "\t").alias("f"))
    rows = body.select("line_no", F.size("f").alias("n"), *(F.get("f", F.lit(COLUMNS.index(c))).alias(c) for c in ("query", "target", "qstart", "qend", "tstart", "tend")))
    numbers = {c: F.col(c).try_cast("int") for c in ("qstart", "qend", "tstart", "tend")}
    kept = rows.where("n < 10 OR query <> target").withColumns(numbers)
    low = F.least("qstart", "qend", "tstart", "tend")
    missing = F.col("qstart").isNull() | F.col("qend").isNull() | F.col("tstart").isNull() | F.col("tend").isNull()
    # one pass: what each part of the file has of each query, with its faults
    short, bad = F.col("n") < 10, (F.col("n") >= 10) & (missing | (low < 1))
    blocks = kept.groupBy(F.shiftright("line_no", 33).alias("part"), "query").agg(
        F.count("*").alias("n"), F.count_if(short).alias("short"), F.count_if(bad).alias("bad"), F.min("line_no").alias("first"), F.max("line_no").alias("last")
    )
    blocks = cut(blocks)
    faults = blocks.agg(F.sum("n").alias("n"), F.sum("short").alias("short"), F.sum("bad").alias("bad")).first()
    if faults["short"]:
        raise ValueError(f"{faults['short']} lines have fewer than ten fields")
    if faults["bad"]:
        raise ValueError(f"{faults['bad']} lines have coordinates that are no positive numbers")
    if not faults["n"]:
        raise ValueError("no hit is left after hits on the query itself are dropped")
    if check_blocks and _interrupted(blocks):
        raise ValueError("a query comes back after another one")
    hits = normalise_hits(kept.drop("n"))
    return encode(hits, registry, "q_seq", "t_seq") if registry is not None else hits


def _interrupted(blocks: DataFrame) -> bool:
    """Whether a query comes back after another one, from its first and last line in each part of the file.

    Within a part two queries' ranges of lines must not overlap.  A query of several parts must be the last of the first one, the
    first of the last one and alone in those between, which are all that have lines.
    """
    order = Window.partitionBy("part").orderBy("first")
    placed = blocks.select(
        "part", "query", F.lag("last").over(order).alias("before"), "first", F.row_number().over(order).alias("place"), F.count("*").over(Window.partitionBy("part")).alias("queries")
    )
    parts = blocks.groupBy("part").agg(F.lit(1).alias("one")).select("part", F.row_number().over(Window.orderBy("part")).alias("number"))  # one row a part of the file
    placed = placed.join(parts, "part")
    of_query = Window.partitionBy("query").orderBy("number")
    step = placed.select("*", F.lag("number").over(of_query).alias("number_before"), F.lag(F.col("place") == F.col("queries")).over(of_query).alias("was_last"))
    inner = F.col("before") > F.col("first")
    across = F.col("number_before").isNotNull() & ((F.col("number_before") != F.col("number") - 1) | ~F.col("was_last") | (F.col("place") != 1))
    return not step.where(inner | across).isEmpty()


def query_order(hits: DataFrame) -> DataFrame:
    """``q_seq, place``: queries by their first line, which numbers domains as the file lists them."""
    return hits.groupBy("q_seq").agg(F.min("line_no").alias("place"))
