"""Folders that all executors share, and the cutting of long lineages there."""

from __future__ import annotations

import math
import tempfile
import uuid
from collections.abc import Callable, Iterator
from contextlib import contextmanager
from contextvars import ContextVar

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def shared_dir(spark: SparkSession) -> str:
    """The folder named by ``spark.checkpoint.dir``; one is set only where none is (as in local tests)."""
    where = spark.conf.get("spark.checkpoint.dir", None)
    if where is None:
        held = spark.sparkContext._jsc.sc().getCheckpointDir()
        where = held.get() if held.isDefined() else None
    if where is None:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
        where = tempfile.mkdtemp(prefix="kinspan-")
    if not spark.sparkContext._jsc.sc().getCheckpointDir().isDefined():
        spark.sparkContext.setCheckpointDir(where)
    return where


def fresh_folder(spark: SparkSession, label: str) -> str:
    """A new path below the shared folder."""
    return f"{shared_dir(spark).rstrip('/')}/{label}-{uuid.uuid4().hex}"


def drop_folder(spark: SparkSession, path: str) -> None:
    """Remove a folder through Hadoop's file system, wherever it is."""
    jvm = spark._jvm
    place = jvm.org.apache.hadoop.fs.Path(path)
    place.getFileSystem(spark._jsc.hadoopConfiguration()).delete(place, True)


#: The column by which tables are dealt now, and into how many buckets.
_DEALT: ContextVar[tuple[str, int] | None] = ContextVar("dealt", default=None)
#: Rows of a bucket, about; a key with more rows than ``HEAVY`` is not dealt whole to one.
BUCKET_ROWS, HEAVY = 300_000, 200_000
#: Whether both sides of a join must be dealt by all of its keys.
ALL_KEYS = "spark.sql.requireAllClusterKeysForCoPartition"
#: Bytes up to which a side of a join is sent to all tasks, through the driver.
SENT = "spark.sql.autoBroadcastJoinThreshold"


def cut(df: DataFrame) -> DataFrame:
    """Cut the lineage: the table is written in the shared folder, once, and read again.

    Unlike a checkpoint this computes the last stage a single time, and the planner knows the table's size.
    Within ``dealt`` tables with its column are bucketed by it.
    """
    spark = df.sparkSession
    path, to = fresh_folder(spark, "table"), _DEALT.get()
    if to is None or to[0] not in df.columns:
        df.write.parquet(path)
        return spark.read.schema(df.schema).parquet(path)
    name = f"kinspan_{uuid.uuid4().hex}"
    df.write.format("parquet").bucketBy(to[1], to[0]).option("path", path).saveAsTable(name)
    return spark.table(name)


def is_dealt(key: str) -> bool:
    """Whether rows of one ``key`` are in one bucket now, so that what is done by key needs no shuffle."""
    to = _DEALT.get()
    return to is not None and to[0] == key


@contextmanager
def unsent(spark: SparkSession) -> Iterator[None]:
    """No side of a join is sent to all tasks for being small, as a table of a few bytes a row on disk may have millions of rows."""
    before = spark.conf.get(SENT)
    spark.conf.set(SENT, "-1")
    try:
        yield
    finally:
        spark.conf.set(SENT, before)


@contextmanager
def dealt(spark: SparkSession, key: str, rows: int, lasting: bool = False) -> Iterator[None]:
    """Tables cut in here are bucketed by ``key``, and joins and groupings by it and more columns take its buckets as they are.

    ``lasting`` leaves the session's setting for this as it is in here, for plans that are made later; it changes no result.
    """
    buckets = max(int(spark.conf.get("spark.sql.shuffle.partitions")), math.ceil(rows / BUCKET_ROWS))
    token, before = _DEALT.set((key, buckets)), spark.conf.get(ALL_KEYS)
    spark.conf.set(ALL_KEYS, "false")
    try:
        yield
    finally:
        if not lasting:
            spark.conf.set(ALL_KEYS, before)
        _DEALT.reset(token)


def by_key(
    rows: DataFrame, key: str, work: Callable[[DataFrame], tuple[DataFrame, ...]], *, lazy: bool = False, counted: DataFrame | None = None
) -> tuple[DataFrame, ...]:
    """The tables that ``work`` makes of ``rows``, where keys have nothing to do with one another.

    Rows are shuffled once, into buckets of ``key``, and ``work`` runs on these without further shuffles.  Keys with more than
    ``HEAVY`` rows are worked on apart, where each step deals its rows by all of its columns; these are few, so their list is broadcast.
    Tables are cut, or, if they are many times the rows, left as ``lazy`` plans.  ``counted`` has as many rows a key as ``rows``.
    Rows of a key are in one place, so that no join has to send a table to all; only the list of heavy keys is.
    """
    with unsent(rows.sparkSession):
        return _by_key(rows, key, work, lazy, counted)


def _by_key(rows: DataFrame, key: str, work: Callable[[DataFrame], tuple[DataFrame, ...]], lazy: bool, counted: DataFrame | None) -> tuple[DataFrame, ...]:
    spark = rows.sparkSession
    counts = (rows if counted is None else counted).groupBy(key).agg(F.count("*").alias("n"))
    total, most = counts.agg(F.sum("n"), F.max("n")).first()
    big = None
    if (most or 0) > HEAVY:
        big = F.broadcast(cut(counts.where(F.col("n") > HEAVY).select(key)))
    with dealt(spark, key, total or 0, lasting=lazy):
        light = rows if big is None else rows.join(big, key, "left_anti")
        out = work(cut(light.repartition(_DEALT.get()[1], key)))
        out = out if lazy else tuple(cut(t) for t in out)
    if big is None:
        return out
    return tuple(x.unionByName(y) for x, y in zip(out, work(cut(rows.join(big, key, "left_semi"))), strict=True))
