"""Intervals: normalised hits, distinct spans, overlaps within a sequence, unions.

Coordinates are zero-based and half-open.  Every operator works on the rows of one key at a time
by joins and windows on that key; abutting intervals do not overlap, but they do merge.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..plans.shared import is_dealt


def normalise_hits(raw: DataFrame) -> DataFrame:
    """Hits in internal form from BLAST-TAB columns ``query, target, qstart, qend, tstart, tend``.

    Hits of a sequence on itself are dropped first.  Starts become ``least - 1``, ends the greater;
    the strand is -1 where exactly one side is inverted.  Coordinates that are not positive are an error.
    """
    inverted = (F.col("qstart") > F.col("qend")) != (F.col("tstart") > F.col("tend"))
    lows = {"q_start": F.least("qstart", "qend") - 1, "t_start": F.least("tstart", "tend") - 1}
    rows = raw.where("query <> target")
    bad = (lows["q_start"] < 0) | (lows["t_start"] < 0)
    start = F.when(bad, F.raise_error(F.lit("a hit has coordinates below 1")).cast("int")).otherwise(lows["q_start"])
    keep = [c for c in ("line_no",) if c in raw.columns]
    return rows.select(
        F.col("query").alias("q_seq"),
        start.alias("q_start"),
        F.greatest("qstart", "qend").alias("q_end"),
        F.col("target").alias("t_seq"),
        lows["t_start"].alias("t_start"),
        F.greatest("tstart", "tend").alias("t_end"),
        F.when(inverted, -1).otherwise(1).alias("t_strand"),
        *keep,
    )


def encode(rows: DataFrame, registry: DataFrame, *columns: str) -> DataFrame:
    """Names in ``columns`` replaced by the registry's ``seq_id``; unknown names are a ``KeyError``.

    The registry is joined without a hint, so that Spark broadcasts it only below its own threshold.
    """
    for c in columns:
        known = registry.select(F.col("seq_name").alias(c), F.col("seq_id").alias("__id"))
        missing = rows.select(c).distinct().join(known, c, "left_anti").head(1)
        if missing:
            raise KeyError(f"{missing[0][0]!r} is not in the sequence registry")
        rows = rows.join(known, c).withColumn(c, F.col("__id")).drop("__id")
    return rows


#: Starts are dealt to bins of 2**16 positions: a bin has at most as many different ones, however many rows a key has.
BIN = 16


def running(rows: DataFrame, keys: list[str], bin_: str, totals: dict[str, Column], carried: dict[str, Column], whole: dict[str, Column] | None = None) -> DataFrame:
    """``rows`` with what the earlier bins of their key add up to, so that no window spans a whole key.

    ``totals`` are aggregates of one bin; ``carried`` are expressions over these, for windows over the earlier bins of a key, and
    ``whole`` for windows over all of them; there is one row a bin.  A later one may use the ones before it.
    """
    bins = rows.groupBy(*keys, bin_).agg(*(c.alias(n) for n, c in totals.items()))
    order = Window.partitionBy(*keys).orderBy(bin_)
    for name, column in carried.items():
        bins = bins.withColumn(name, column.over(order.rowsBetween(Window.unboundedPreceding, -1)))
    for name, column in (whole or {}).items():
        bins = bins.withColumn(name, column.over(Window.partitionBy(*keys)))
    return rows.join(bins.drop(*totals), [*keys, bin_])


def unique_spans(hits: DataFrame) -> DataFrame:
    """Distinct query spans with their multiplicity ``w`` and their place ``ord`` by (start, end).

    Spans are numbered within bins of their query, and bins are counted before; a query with most of the spans is spread over them.
    """
    spans = hits.groupBy("q_seq", "q_start", "q_end").agg(F.count("*").alias("w")).withColumn("__bin", F.shiftright("q_start", 10))
    spans = running(spans, ["q_seq"], "__bin", {"__n": F.count("*")}, {"__before": F.sum("__n")})
    place = F.row_number().over(Window.partitionBy("q_seq", "__bin").orderBy("q_start", "q_end")) - 1
    return spans.select("q_seq", "q_start", "q_end", "w", (F.coalesce("__before", F.lit(0)) + place).cast("int").alias("ord"))


def overlaps(
    spans: DataFrame,
    *,
    key: str,
    start: str,
    end: str,
    label: str,
    carry: tuple[str, ...] = (),
    differ: str | None = None,
) -> DataFrame:
    """Pairs a < b (by ``label``) of overlapping intervals of one key, with ``inter``, the overlap's length.

    ``differ`` names a column that must differ between the two and orders the pair instead of ``label``.
    An interval belongs to the level of the least power of two that is no shorter, and is at home in the one or
    two bins of that width that it touches; it visits the bins of the wider levels that occur.  A pair is
    found where the wider one is at home, in the bin of the overlap's start alone.  So a row has two copies a
    level at most, however long it is, and what is compared grows with the pairs found, not with a key's rows squared.
    """
    by = differ or label
    columns = list(dict.fromkeys((label, by, start, end, *carry)))
    rows = spans.select(key, F.length(F.bin(F.col(end) - F.col(start) - 1)).alias("__level"), *columns)
    levels = sorted(r[0] for r in rows.select("__level").distinct().collect())  # 64 at most
    named = lambda side: [F.col(c).alias(f"{side}_{c}") for c in columns]
    bins = lambda level: F.explode(F.expr(f"sequence(shiftright({start}, {level}), shiftright({end} - 1, {level}))")).alias("__bin")
    home = rows.select(key, F.col("__level").alias("__at"), *named("y"), bins("__level"))
    wider = F.filter(F.array(*map(F.lit, levels)).cast("array<int>"), lambda at: at >= F.col("__level"))
    guest = rows.select("*", F.explode(wider).alias("__at")).select(key, "__level", "__at", *named("x"), bins("__at"))
    # a few input rows make many pairs, so they are spread before the join, however it is done; dealt ones are there, and none are sent
    if is_dealt(key):
        home = home.hint("merge")
    else:
        guest = guest.repartition(key, "__at", "__bin")
    x, y = (lambda c: F.col(f"x_{c}")), (lambda c: F.col(f"y_{c}"))
    low = F.greatest(x(start), y(start))
    meet = (x(start) < y(end)) & (y(start) < x(end)) & (x(by) != y(by)) & ((F.col("__level") < F.col("__at")) | (x(by) < y(by)))
    both = guest.join(home, [key, "__at", "__bin"]).where(meet & (F.col("__bin") == F.expr(f"shiftright(greatest(x_{start}, y_{start}), __at)")))
    pick = lambda c, this, that: F.when(x(by) < y(by), this(c)).otherwise(that(c))
    return both.select(
        key,
        *(pick(c, x, y).alias(f"{c}_a") for c in columns),
        *(pick(c, y, x).alias(f"{c}_b") for c in columns),
        (F.least(x(end), y(end)) - low).alias("inter"),
    )


def stabbed(points: DataFrame, spans: DataFrame, *, key: str, at: str, start: str, end: str) -> DataFrame:
    """Points (``key, at``) with the spans of their key that hold them; other columns of both stay.

    A span is at home in the one or two bins of its power-of-two level, and a point looks into its own bin of
    every level that occurs, so that no key's points are compared with all of its spans.
    """
    spans = spans.where(F.col(start) < F.col(end)).withColumn("__level", F.length(F.bin(F.col(end) - F.col(start) - 1)))
    levels = sorted(r[0] for r in spans.select("__level").distinct().collect())  # 64 at most
    home = spans.withColumn("__bin", F.explode(F.expr(f"sequence(shiftright({start}, __level), shiftright({end} - 1, __level))")))
    guest = points.withColumn("__level", F.explode(F.array(*map(F.lit, levels)).cast("array<int>"))).withColumn("__bin", F.expr(f"shiftright({at}, __level)"))
    both = guest.join(home, [key, "__level", "__bin"]).where((F.col(start) <= F.col(at)) & (F.col(at) < F.col(end)))
    return both.drop("__level", "__bin")


def touching(left: DataFrame, right: DataFrame, *, key: str, left_span: tuple[str, str], right_span: tuple[str, str]) -> DataFrame:
    """Rows of two tables whose half-open intervals overlap within a key, with the columns of both (named apart but for the key).

    As in ``overlaps``, an interval is at home in the one or two bins of its power-of-two level, and visits its bins of the
    wider levels; a pair is found where the wider of the two is at home, the right one where both are of a level.  Empty intervals
    overlap nothing.  What is compared grows with the pairs found, not with the product of a key's rows.
    """
    def side(frame: DataFrame, span: tuple[str, str], name: str) -> DataFrame:
        start, end = span
        rows = frame.where(F.col(start) < F.col(end))
        return rows.select(key, F.struct(*(c for c in frame.columns if c != key)).alias(name), F.col(start).alias(f"{name}_s"), F.col(end).alias(f"{name}_e"), F.length(F.bin(F.col(end) - F.col(start) - 1)).alias("__own"))

    x, y = side(left, left_span, "x"), side(right, right_span, "y")
    levels = sorted(r[0] for r in x.select("__own").union(y.select("__own")).distinct().collect())  # 64 at most
    bins = lambda n, level: F.explode(F.expr(f"sequence(shiftright({n}_s, {level}), shiftright({n}_e - 1, {level}))")).alias("__bin")
    wider = lambda least: F.explode(F.filter(F.array(*map(F.lit, levels)).cast("array<int>"), lambda at: at >= least)).alias("__at")
    home = lambda frame, n: frame.select(key, n, f"{n}_s", f"{n}_e", F.col("__own").alias("__at"), bins(n, "__own"))
    guest = lambda frame, n, least: frame.select("*", wider(least)).select(key, n, f"{n}_s", f"{n}_e", "__at", bins(n, "__at"))
    there = lambda frame: frame.hint("merge") if is_dealt(key) else frame
    meet = F.expr("x_s < y_e AND y_s < x_e AND __bin = shiftright(greatest(x_s, y_s), __at)")
    on = [key, "__at", "__bin"]
    found = guest(x, "x", F.col("__own")).join(there(home(y, "y")), on).where(meet).select(key, "x", "y")
    found = found.unionByName(guest(y, "y", F.col("__own") + 1).join(there(home(x, "x")), on).where(meet).select(key, "x", "y"))
    return found.select(key, "x.*", "y.*")


def merged(spans: DataFrame, *, keys: list[str], start: str, end: str) -> DataFrame:
    """Unions of overlapping or touching intervals by key.

    Of equal starts the greatest end counts.  Within a bin of starts the islands are found by a running maximum of ends;
    from bin to bin the maximum and the start of the last island are carried, so that a key's spans are dealt to all tasks.
    """
    rows = spans.groupBy(*keys, start).agg(F.max(end).alias(end)).withColumn("__bin", F.shiftright(start, BIN))
    order = Window.partitionBy(*keys, "__bin").orderBy(start)
    reach = F.max(end).over(order.rowsBetween(Window.unboundedPreceding, -1))
    rows = rows.withColumn("__opens", reach.isNull() | (F.col(start) > reach))
    # the last island that a bin opens by itself is open as well beside the earlier bins, or none of its islands is
    rows = running(
        rows, keys, "__bin", {"__top": F.max(end), "__last": F.max(F.when(F.col("__opens"), F.col(start)))},
        {"__reach": F.max("__top"), "__island": F.max(F.when(F.col("__reach").isNull() | (F.col("__last") > F.col("__reach")), F.col("__last")))},
    )
    opens = F.col("__opens") & (F.col("__reach").isNull() | (F.col(start) > F.col("__reach")))
    own = F.max(F.when(opens, F.col(start))).over(order.rowsBetween(Window.unboundedPreceding, 0))
    rows = rows.select(*keys, F.coalesce(own, "__island").alias("__start"), F.col(end))
    return rows.groupBy(*keys, "__start").agg(F.max(end).alias(end)).select(*keys, F.col("__start").alias(start), end)


def span_length(start: str, end: str) -> Column:
    return F.col(end) - F.col(start)
