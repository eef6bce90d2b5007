"""Meetings of domains on targets, and the graph that they make, without a row for each pair but where pairs are the result.

Spans of a target come to one task, sorted by start, and whole targets are compared as arrays: a span meets those
that start before it ends, which follow it.  So what is compared is what is found, and a chunk of pairs is held at a time.  Targets with more
than ``HEAVY`` spans are compared by Spark's joins instead, which spread one target over all tasks.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.scores import jaccard
from ..plans import shared
from ..plans.shared import cut
from .intervals import overlaps

#: Pairs that are held at once, about.
PAIRS = 1 << 16
Batches = Iterator[pa.RecordBatch]


class Targets:
    """Rows of whole targets as arrays; domains are numbered by ``rank`` among themselves, in the order of their ids."""

    def __init__(self, table: pa.Table) -> None:
        self.table, self.n = table, len(table)
        self.start, self.end = self["t_start"], self["t_end"]
        self.names, self.rank = np.unique(self["dom_id"], return_inverse=True)
        self.rank = self.rank.astype(np.int32)
        target = table["t_seq"].combine_chunks()
        self.first = np.concatenate([[0], np.cumsum(pc.not_equal(target[1:], target[:-1]).to_numpy(zero_copy_only=False))]) if self.n else np.zeros(0, np.int64)

    def __getitem__(self, column: str) -> np.ndarray:
        return self.table[column].to_numpy()

    def lists(self, column: str) -> tuple[np.ndarray, np.ndarray]:
        """The values of a column of lists, and the row of each."""
        lists = self.table[column].combine_chunks()
        lists = lists.chunk(0) if isinstance(lists, pa.ChunkedArray) else lists
        sizes = pc.fill_null(pc.list_value_length(lists), 0).to_numpy(zero_copy_only=False)
        return lists.flatten().to_numpy(zero_copy_only=False), np.repeat(np.arange(self.n), sizes)

    def pairs(self) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        """Places ``a, b`` of overlapping spans of one target and two domains, the smaller id first."""
        if not self.n:
            return
        least = self.start.min()
        width = int(self.end.max() - least) + 1
        at, to = self.first * width + (self.start - least), self.first * width + (self.end - least)
        after = np.arange(1, self.n + 1)
        counts = np.maximum(np.searchsorted(at, to) - after, 0)
        upto, low = np.cumsum(counts), 0
        while low < self.n:
            before = upto[low] - counts[low]
            high = max(low + 1, int(np.searchsorted(upto, before + PAIRS, "right")))
            c = counts[low:high]
            if total := int(c.sum()):
                i = np.repeat(np.arange(low, high, dtype=np.int32), c)
                j = (np.arange(total) + np.repeat(after[low:high] - (upto[low:high] - c - before), c)).astype(np.int32)
                ri, rj = self.rank[i], self.rank[j]
                swap = ri > rj
                a, b = np.where(swap, j, i), np.where(swap, i, j)
                if (same := ri == rj).any():
                    a, b = a[~same], b[~same]
                if len(a):
                    yield a, b
            low = high

    def inter(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        return np.minimum(self.end[a], self.end[b]) - np.maximum(self.start[a], self.start[b])

    def keys(self, rows: np.ndarray, low: np.ndarray) -> np.ndarray:
        """The domain of ``rows`` and a number of 16 bits as one that can be sorted."""
        kind = np.uint32 if len(self.names) <= 1 << 16 else np.uint64
        return (self.rank[rows].astype(kind) << kind(16)) | low.astype(kind)


class Again:
    """Which pairs may meet more than once: those whose mark is listed at their smaller domain, or all of a domain's."""

    def __init__(self, of: Targets) -> None:
        self.of, self.mark = of, of["mark"].view(np.uint16)
        marks, rows = of.lists("marks")
        self.every = of["every"]
        self.listed = np.unique(of.keys(rows, marks.astype(np.int16).view(np.uint16)).astype(np.uint64))
        self.bits = max(16, int(len(self.listed)).bit_length() + 4)
        self.table = np.zeros(1 << self.bits, bool)
        self.table[self._slots(self.listed)] = True
        self.any = bool(len(self.listed) or self.every.any())

    def _slots(self, keys: np.ndarray) -> np.ndarray:
        return (keys * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(64 - self.bits)

    def __call__(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        if not self.any:
            return np.zeros(len(a), bool)
        out = self.every[a]
        keys = self.of.keys(a, self.mark[b]).astype(np.uint64)
        maybe = np.flatnonzero(self.table[self._slots(keys)])
        out[maybe] |= np.isin(keys[maybe], self.listed)
        return out


def whole_targets(batches: Batches) -> Iterator[Targets]:
    """Whole targets of batches that are sorted by target; the last one of a batch waits for its rows in the next."""
    rest: list[pa.RecordBatch] = []
    for batch in batches:
        if not batch.num_rows:
            continue
        target = batch.column("t_seq")
        last = target[-1]
        earlier = pc.index(pc.equal(target, last), pa.scalar(True)).as_py()
        if rest and (earlier or rest[-1].column("t_seq")[-1] != last):
            yield Targets(pa.Table.from_batches([*rest, batch.slice(0, earlier)]))
            rest = []
        elif earlier:
            yield Targets(pa.Table.from_batches([batch.slice(0, earlier)]))
        rest.append(batch.slice(earlier))
    if rest:
        yield Targets(pa.Table.from_batches(rest))


def _listed(names: np.ndarray, keys: np.ndarray, kind: type = np.int16) -> tuple[np.ndarray, pa.ListArray]:
    """Sorted keys as lists: a domain's id, and its numbers of 16 bits."""
    rank = keys >> keys.dtype.type(16)
    opens = np.flatnonzero(np.concatenate([[True], rank[1:] != rank[:-1]]))
    offsets = np.append(opens, len(keys)).astype(np.int32)
    return names[rank[opens].astype(np.int64)], pa.ListArray.from_arrays(pa.array(offsets), pa.array((keys & keys.dtype.type(0xFFFF)).astype(np.uint16).view(kind)))


def marked(batches: Batches) -> Batches:
    """``dom_id, marks``: of the neighbours of the smaller domain, as often as they are met."""
    for of in whole_targets(batches):
        mark = of["mark"].view(np.uint16)
        for a, b in of.pairs():
            keys = of.keys(a, mark[b])
            keys.sort()
            yield pa.RecordBatch.from_arrays(list(_listed(of.names, keys)), ["dom_id", "marks"])


def repeated(most: int) -> Callable[[Batches], Batches]:
    """From ``dom_id, marks``, sorted by domain: the marks that come more than once; more than ``most`` are all, ``every``."""

    def told(names: np.ndarray, keys: np.ndarray) -> Iterator[pa.RecordBatch]:
        if len(keys):
            ids, marks = _listed(names, keys)
            every = np.diff(marks.offsets.to_numpy()) > most
            short = np.repeat(every, np.diff(marks.offsets.to_numpy()))
            sizes = np.where(every, 0, np.diff(marks.offsets.to_numpy()))
            marks = pa.ListArray.from_arrays(pa.array(np.append(0, np.cumsum(sizes)).astype(np.int32)), pa.array(marks.values.to_numpy()[~short]))
            yield pa.RecordBatch.from_arrays([pa.array(ids), marks, pa.array(every)], ["dom_id", "marks", "every"])

    def find(batches: Batches) -> Batches:
        held, held_marks = None, np.zeros(0, np.uint16)  # the last domain, of whose marks two of a kind are enough
        for batch in batches:
            if not batch.num_rows:
                continue
            ids, lists = batch.column("dom_id").to_numpy(), batch.column("marks")
            sizes = pc.list_value_length(lists).to_numpy(zero_copy_only=False)
            ids, marks = np.repeat(ids, sizes), lists.flatten().to_numpy(zero_copy_only=False).view(np.uint16)
            if held is not None:
                ids, marks = np.concatenate([np.full(len(held_marks), held), ids]), np.concatenate([held_marks, marks])
            names, rank = np.unique(ids, return_inverse=True)
            keys = np.sort((rank.astype(np.uint64) << np.uint64(16)) | marks)
            keys, counts = np.unique(keys, return_counts=True)
            done = (keys >> np.uint64(16)) < len(names) - 1
            yield from told(names, keys[done & (counts > 1)])
            held, held_marks = names[-1], np.repeat((keys[~done] & np.uint64(0xFFFF)).astype(np.uint16), np.minimum(counts[~done], 2))
        if held is not None:
            marks, counts = np.unique(held_marks, return_counts=True)
            yield from told(np.array([held]), marks[counts > 1].astype(np.uint64))

    return find


def _similar(of: Targets, a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    inter, size = of.inter(a, b), of["len"]
    sim = inter / (size[a] + size[b] - inter)
    if (sim > 1).any():
        raise ValueError("a Jaccard coefficient is outside [0, 1]")
    return inter, sim


def plain_pairs(batches: Batches) -> Batches:
    """``a, b, inter`` of all meetings."""
    for of in whole_targets(batches):
        for a, b in of.pairs():
            yield pa.RecordBatch.from_arrays([pa.array(x) for x in (of.names[of.rank[a]], of.names[of.rank[b]], of.inter(a, b))], ["a", "b", "inter"])


def pairs_again(batches: Batches) -> Batches:
    """``a, b, inter, len_a, len_b`` of the meetings of pairs that may meet more than once."""
    for of in whole_targets(batches):
        again, size = Again(of), of["len"]
        for a, b in of.pairs() if again.any else ():
            which = again(a, b)
            a, b = a[which], b[which]
            yield pa.RecordBatch.from_arrays([pa.array(x) for x in (of.names[of.rank[a]], of.names[of.rank[b]], of.inter(a, b), size[a], size[b])], ["a", "b", "inter", "len_a", "len_b"])


def _once(of: Targets) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    again = Again(of)
    for a, b in of.pairs():
        if again.any:
            stays = ~again(a, b)
            a, b = a[stays], b[stays]
        if len(a):
            yield a, b


def pairs_once(with_rho: bool) -> Callable[[Batches], Batches]:
    """``a, b, inter, sim`` of pairs that meet once, and their densities."""

    def find(batches: Batches) -> Batches:
        for of in whole_targets(batches):
            rho = of["rho"] if with_rho else None
            for a, b in _once(of):
                inter, sim = _similar(of, a, b)
                columns = {"a": of.names[of.rank[a]], "b": of.names[of.rank[b]], "inter": inter.astype(np.int64), "sim": sim}
                columns |= {"rho_a": rho[a], "rho_b": rho[b]} if with_rho else {}
                yield pa.RecordBatch.from_arrays([pa.array(x) for x in columns.values()], list(columns))

    return find


def near_once(batches: Batches) -> Batches:
    """``id, near``: what the similarities of pairs that meet once add up to at a domain, by parts."""
    for of in whole_targets(batches):
        near = np.zeros(len(of.names))
        for a, b in _once(of):
            sim = _similar(of, a, b)[1]
            for side in (a, b):
                near += np.bincount(of.rank[side], sim, len(near))
        some = np.flatnonzero(near)
        yield pa.RecordBatch.from_arrays([pa.array(of.names[some]), pa.array(near[some])], ["id", "near"])


def best_once(batches: Batches) -> Batches:
    """``id, sim, rho_up, up``: of the denser neighbours that a domain meets once the most similar one, by parts."""
    for of in whole_targets(batches):
        rho, best, parts = of["rho"], np.full(len(of.names), -1.0), []
        for a, b in _once(of):
            sim = _similar(of, a, b)[1]
            b_higher = rho[b] > rho[a]
            low, up = np.where(b_higher, a, b), np.where(b_higher, b, a)
            rank = of.rank[low]
            np.maximum.at(best, rank, sim)
            top = np.flatnonzero(sim == best[rank])
            parts.append((rank[top], sim[top], up[top]))
        if parts:
            rank, sim, up = (np.concatenate(x) for x in zip(*parts))
            order = np.lexsort((of.rank[up], -rho[up], -sim, rank))
            rank, sim, up = rank[order], sim[order], up[order]
            one = np.concatenate([[True], rank[1:] != rank[:-1]])
            rank, sim, up = rank[one], sim[one], up[one]
            yield pa.RecordBatch.from_arrays([pa.array(x) for x in (of.names[rank], sim, rho[up], of.names[of.rank[up]])], ["id", "sim", "rho_up", "up"])


def _code(sim: np.ndarray) -> np.ndarray:
    """The upper half of a similarity as a float: it never falls as the similarity grows."""
    return (sim.astype(np.float32).view(np.uint32) >> np.uint32(16)).astype(np.uint16)


def top_codes(k: int) -> Callable[[Batches], Batches]:
    """``dom_id, codes`` of the ``k`` most similar pairs of each ``point``, by parts."""

    def find(batches: Batches) -> Batches:
        for of in whole_targets(batches):
            point = of["wanted"]
            for a, b in _once(of) if point.any() else ():
                code = np.uint16(0xFFFF) - _code(_similar(of, a, b)[1])
                keys = np.concatenate([of.keys(side[point[side]], code[point[side]]) for side in (a, b)])
                if len(keys):
                    keys.sort()
                    rank = keys >> keys.dtype.type(16)
                    opens = np.concatenate([[True], rank[1:] != rank[:-1]])
                    place = np.arange(len(keys)) - np.maximum.accumulate(np.where(opens, np.arange(len(keys)), 0))
                    yield pa.RecordBatch.from_arrays(list(_listed(of.names, keys[place < k])), ["dom_id", "codes"])

    return find


def top_pairs(batches: Batches) -> Batches:
    """``src, dst, sim`` of the pairs of each ``point`` whose code reaches its least one."""
    for of in whole_targets(batches):
        point, least = of["wanted"], of["least"]
        for a, b in _once(of) if point.any() else ():
            sim = _similar(of, a, b)[1]
            code = _code(sim).astype(np.int32)
            for src, dst in ((a, b), (b, a)):
                which = np.flatnonzero(point[src] & (code >= least[src]))
                yield pa.RecordBatch.from_arrays([pa.array(of.names[of.rank[src[which]]]), pa.array(of.names[of.rank[dst[which]]]), pa.array(sim[which])], ["src", "dst", "sim"])


def mark(domain: str) -> Column:
    return (F.pmod(F.xxhash64(domain), F.lit(1 << 16)) - (1 << 15)).cast("short")


def joined(spans: DataFrame, carry: tuple[str, ...] = ()) -> DataFrame:
    """The meetings of ``spans`` by Spark's joins, with ``carry`` of both."""
    both = overlaps(spans, key="t_seq", start="t_start", end="t_end", label="dom_id", differ="dom_id", carry=carry)
    return both.select("t_seq", F.col("dom_id_a").alias("a"), F.col("dom_id_b").alias("b"), "inter", *(f"{c}_{s}" for c in carry for s in "ab"))


class Split:
    """Spans of light targets, which are compared as arrays, and of heavy ones, if there are any."""

    def __init__(self, spans: DataFrame) -> None:
        counts = spans.groupBy("t_seq").agg(F.count("*").alias("n"))
        rows, most = counts.agg(F.sum("n"), F.max("n")).first()
        spark = spans.sparkSession
        self.parts = max(int(spark.conf.get("spark.sql.shuffle.partitions")), math.ceil((rows or 0) / shared.BUCKET_ROWS))
        self.big = cut(counts.where(F.col("n") > shared.HEAVY).select("t_seq")) if (most or 0) > shared.HEAVY else None

    def swept(self, rows: DataFrame, find: Callable[[Batches], Batches], schema: str) -> DataFrame:
        """What ``find`` makes of the spans of light targets."""
        light = rows if self.big is None else rows.join(F.broadcast(self.big), "t_seq", "left_anti")
        light = light.where("t_seq IS NOT NULL AND dom_id IS NOT NULL")
        # by a hash: dealing by the target itself is left out over tables in its buckets, which then are read in other parts
        return light.repartition(self.parts, F.xxhash64("t_seq")).sortWithinPartitions("t_seq", "t_start").mapInArrow(find, schema)

    def heavy(self, rows: DataFrame, carry: tuple[str, ...] = ()) -> DataFrame | None:
        return None if self.big is None else joined(rows.join(F.broadcast(self.big), "t_seq", "left_semi"), carry)

    def all(self, rows: DataFrame, find: Callable[[Batches], Batches], schema: str, of_pairs: Callable[[DataFrame], DataFrame], carry: tuple[str, ...] = ()) -> DataFrame:
        light, pairs = self.swept(rows, find, schema), self.heavy(rows, carry)
        return light if pairs is None else light.unionByName(of_pairs(pairs).select(light.columns))


def meetings(spans: DataFrame) -> DataFrame:
    """``a < b, inter``: a row for each overlapping pair of spans of different domains on one target."""
    kind = spans.schema["t_end"].dataType.simpleString()
    return Split(spans).all(spans, plain_pairs, f"a long, b long, inter {kind}", lambda pairs: pairs)


class Graph:
    """The graph of domains that meet, ``a, b, inter, sim``; called with a table ``id, rho`` it gives ``rho_a`` and ``rho_b`` as well.

    Pairs are many times the spans, and most meet once, so that they need no sum.  Each domain's neighbours are sent to one
    place as marks of two bytes first; those whose mark comes once there meet it once, and are edges where they are
    found.  Only the rest is shuffled and summed.  What clustering asks of a domain's neighbours (``near``, ``best``, ``top``) is
    worked out where pairs are found, so that they are no rows at all.
    """

    def __init__(self, spans: DataFrame, lengths: DataFrame, repeats: int) -> None:
        self.split = split = Split(spans)
        self.kind = spans.schema["t_end"].dataType.simpleString()
        some = F.pmod(F.xxhash64("b"), F.lit(1024))  # a list is short also where a target is heavy
        of_pairs = lambda pairs: pairs.groupBy("t_seq", F.col("a").alias("dom_id"), some).agg(F.collect_list(mark("b")).alias("marks"))
        met = split.all(spans.withColumn("mark", mark("dom_id")), marked, "dom_id long, marks array<short>", of_pairs)
        twice = met.repartition(split.parts, "dom_id").sortWithinPartitions("dom_id").mapInArrow(repeated(repeats), "dom_id long, marks array<short>, every boolean")
        none = F.array().cast("array<short>")
        known = lengths.join(twice, "dom_id", "left").select("dom_id", "len", F.coalesce("marks", none).alias("marks"), F.coalesce("every", F.lit(False)).alias("every"))
        self.rows = cut(spans.join(cut(known), "dom_id").withColumn("mark", mark("dom_id")))
        added = split.all(self.rows, pairs_again, f"a long, b long, inter {self.kind}, len_a long, len_b long", lambda p: p.where(self._again()), self.carry)
        added = added.groupBy("a", "b").agg(F.sum("inter").cast("bigint").alias("inter"), F.max("len_a").alias("len_a"), F.max("len_b").alias("len_b"))
        self.summed = cut(added.select("a", "b", "inter", self._sim()))

    carry = ("len", "marks", "every")

    @staticmethod
    def _again() -> Column:
        return F.col("every_a") | F.array_contains("marks_a", mark("b"))

    @staticmethod
    def _sim() -> Column:
        # a condition on it may be asked before the one that spans overlap
        return jaccard(F.greatest("inter", F.lit(0)), F.col("len_a"), F.col("len_b")).alias("sim")

    def _pairs(self, pairs: DataFrame, *more: str) -> DataFrame:
        return pairs.where(~self._again()).select("a", "b", F.col("inter").cast("bigint").alias("inter"), self._sim(), *more)

    def _ways(self, pairs: DataFrame) -> DataFrame:
        return pairs.select(F.explode(F.array(F.struct(F.col("a").alias("src"), F.col("b").alias("dst")), F.struct(F.col("b").alias("src"), F.col("a").alias("dst")))).alias("e"), "sim").select("e.*", "sim")

    def edges(self) -> DataFrame:
        return self.split.all(self.rows, pairs_once(False), "a long, b long, inter long, sim double", self._pairs, self.carry).unionByName(self.summed)

    def _dense(self, dense: DataFrame) -> DataFrame:
        return self.rows.join(dense.select(F.col("id").alias("dom_id"), "rho"), "dom_id")

    def _summed(self, dense: DataFrame) -> DataFrame:
        ends = [dense.select(F.col("id").alias(e), F.col("rho").alias(f"rho_{e}")) for e in "ab"]
        return self.summed.join(ends[0], "a").join(ends[1], "b")

    def __call__(self, dense: DataFrame) -> DataFrame:
        once = self.split.all(
            self._dense(dense), pairs_once(True), "a long, b long, inter long, sim double, rho_a double, rho_b double",
            lambda p: self._pairs(p, "rho_a", "rho_b"), (*self.carry, "rho"),
        )
        return once.unionByName(self._summed(dense).select(once.columns))

    def near(self) -> DataFrame:
        """``id, near``: the sum of the similarities of a domain's neighbours."""
        of_pairs = lambda pairs: self._ways(pairs).select(F.col("src").alias("id"), F.col("sim").alias("near"))
        parts = self.split.all(self.rows, near_once, "id long, near double", lambda p: of_pairs(self._pairs(p)), self.carry).unionByName(of_pairs(self.summed))
        return parts.groupBy("id").agg(F.sum("near").alias("near"))

    def best(self, dense: DataFrame) -> DataFrame:
        """``id, sim, rho_up, up``: the most similar one of a domain's denser neighbours is among them."""
        b_higher = F.col("rho_b") > F.col("rho_a")
        pick = lambda x, y: F.when(b_higher, F.col(x)).otherwise(F.col(y))
        of_pairs = lambda pairs: pairs.select(pick("a", "b").alias("id"), "sim", pick("rho_b", "rho_a").alias("rho_up"), pick("b", "a").alias("up"))
        parts = self.split.all(
            self._dense(dense), best_once, "id long, sim double, rho_up double, up long",
            lambda p: of_pairs(self._pairs(p, "rho_a", "rho_b")), (*self.carry, "rho"),
        )
        return parts.unionByName(of_pairs(self._summed(dense)))

    def top(self, points: DataFrame, k: int) -> DataFrame:
        """``src, dst, sim``: the ``k`` most similar neighbours of each of ``points`` are among them."""
        wanted = self.rows.join(points.select(F.col("id").alias("dom_id"), F.lit(True).alias("wanted")), "dom_id", "left").withColumn("wanted", F.col("wanted").isNotNull())
        codes = self.split.swept(wanted, top_codes(k), "dom_id long, codes array<short>")
        # a domain's k-th greatest code so far: its nearest neighbours are not below it
        kth = F.get(F.array_sort(F.flatten(F.collect_list("codes"))), k - 1)
        codes = cut(codes.groupBy("dom_id").agg(kth.alias("code")).select("dom_id", (F.lit(0xFFFF) - F.pmod(F.col("code").cast("int"), F.lit(1 << 16))).alias("least")))
        rows = wanted.join(codes, "dom_id", "left").withColumn("least", F.coalesce("least", F.lit(0)))
        light = self.split.swept(rows, top_pairs, "src long, dst long, sim double")
        pairs = self.split.heavy(self.rows, self.carry)
        others = self._ways(self.summed if pairs is None else self.summed.unionByName(self._pairs(pairs)))
        return light.unionByName(others.join(points.select(F.col("id").alias("src")), "src", "left_semi"))
