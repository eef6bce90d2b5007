"""Trees and connected components of tables of any size, without collecting links.

A star sends all its leaves to look up one row, its hub.  ``looked_up`` deals them to several copies of that row.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .shared import cut, is_dealt

#: Copies of a row that is looked up by many; rows that count as many; rows of the list of those, at most.
COPIES, MANY, LISTED = 64, 200_000, 100_000


def looked_up(rows: DataFrame, table: DataFrame, keys: list[str], spread: str, many: int = MANY) -> DataFrame:
    """``rows`` joined with ``table``, which has one row a key; keys that many rows have are dealt out by a hash of ``spread``.

    More than ``many`` rows, or than a 100,000th of all, share a listed key.  So the list has 100,000 keys at most, and is
    broadcast; where no key has as many, the join is a plain one.
    """
    rows_there = rows.count()
    if rows_there <= many:
        return rows.join(table, keys)
    hot = cut(rows.groupBy(*keys).agg(F.count("*").alias("__n")).where(F.col("__n") > max(many, rows_there // LISTED)).select(*keys, F.lit(True).alias("__hot")))
    if hot.isEmpty():
        return rows.join(table, keys)
    salt = F.when(F.col("__hot"), F.pmod(F.xxhash64(spread), F.lit(COPIES)).cast("int")).otherwise(F.lit(0))
    salted = rows.join(F.broadcast(hot), keys, "left").withColumn("__salt", salt).drop("__hot")
    copies = F.explode(F.when(F.col("__hot"), F.sequence(F.lit(0), F.lit(COPIES - 1))).otherwise(F.array(F.lit(0))))
    return salted.join(table.join(F.broadcast(hot), keys, "left").withColumn("__salt", copies).drop("__hot"), [*keys, "__salt"]).drop("__salt")


def roots(parents: DataFrame, by: list[str], many: int = MANY) -> DataFrame:
    """``id, root`` of a forest given by ``id, parent`` (a root is its own parent), by pointer doubling.

    Rows that have come to a root are done with and leave the table, so that it shrinks from round to round, and a star is
    over after one.  Only the number of rows left reaches the driver.  Few rows, and those dealt to buckets, are doubled three times a round.
    """
    now = parents.select(*by, "id", "parent")
    done: DataFrame | None = None
    local = any(map(is_dealt, by))
    few = local or now.count() <= many

    def above(rows: DataFrame) -> DataFrame:
        up = rows.select(*by, F.col("id").alias("parent"), F.col("parent").alias("above"))
        if done is not None:
            up = up.unionByName(done.select(*by, F.col("id").alias("parent"), F.col("root").alias("above")))
        found = rows.join(up, [*by, "parent"]) if few else looked_up(rows, up, [*by, "parent"], "id", many)
        return found.select(*by, "id", "parent", "above")

    while True:
        for _ in range(2 if few else 0):
            now = above(now).select(*by, "id", F.col("above").alias("parent"))
        step = cut(above(now))
        if local:  # rows stay in one table, as a union is in no buckets
            now = step.select(*by, "id", F.col("above").alias("parent"))
            if step.where("parent <> above").isEmpty():
                return now.withColumnRenamed("parent", "root")
            continue
        at_root = step.where("parent = above").select(*by, "id", F.col("parent").alias("root"))
        done = at_root if done is None else done.unionByName(at_root)
        now = step.where("parent <> above").select(*by, "id", F.col("above").alias("parent"))
        if now.isEmpty():
            return done


def components(links: DataFrame, a: str = "a", b: str = "b", many: int = MANY) -> DataFrame:
    """``node, component`` for every node of ``links``; component is the smallest node reachable.

    Each round hangs every node under its smallest neighbour, where that is smaller, follows these
    trees to their roots by pointer doubling, and replaces the links by those between different
    roots, so that links shrink from round to round.  Tables are written in the shared folder;
    only whether anything is left reaches the driver.
    """
    low, high = F.least(a, b).alias("low"), F.greatest(a, b).alias("high")
    edges = cut(links.where(F.col(a).isNotNull() & F.col(b).isNotNull() & (F.col(a) != F.col(b))).select(low, high).distinct())
    labels = None
    while labels is None or not edges.isEmpty():
        # the smaller end of a link is a node as well, though it may hang under none
        hung = edges.select(F.col("high").alias("id"), F.col("low").alias("parent"))
        hung = hung.unionByName(edges.select(F.col("low").alias("id"), F.col("low").alias("parent")))
        found = cut(roots(cut(hung.groupBy("id").agg(F.min("parent").alias("parent"))), [], many))
        if labels is None:
            labels = found.select(F.col("id").alias("node"), F.col("root").alias("component"))
        else:
            named = found.withColumnRenamed("id", "component")
            labels = cut(labels.join(named, "component", "left").select("node", F.coalesce("root", "component").alias("component")))
        ends = looked_up(edges, found.select(F.col("id").alias("low"), F.col("root").alias("x")), ["low"], "high", many)
        ends = looked_up(cut(ends), found.select(F.col("id").alias("high"), F.col("root").alias("y")), ["high"], "low", many)
        edges = cut(ends.where("x <> y").select(F.least("x", "y").alias("low"), F.greatest("x", "y").alias("high")).distinct())
    return labels
