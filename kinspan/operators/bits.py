"""Pairs of aligned rows, compared as arrays of bits: only how many pairs have which counts leaves a task."""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Rows of a tile on either side: what is held at once, small enough to stay in a cache.
TILE = (64, 1024)
#: Counts of so many kinds are added up in one array, more are sorted by tile; pairs of a partition, about.
KINDS, PAIRS = 1 << 22, 1 << 30


def masks(rows: pa.Array) -> list[np.ndarray]:
    """The residues of rows of ASCII as bits, by row and word of 64 columns: a mask of them, and a mask for each bit of their number among those that occur.

    Rows that end early have gaps there.
    """
    rows = rows.cast(pa.large_binary())
    ends = np.frombuffer(rows.buffers()[1], np.int64)[rows.offset : rows.offset + len(rows) + 1]
    flat = np.frombuffer(rows.buffers()[2], np.uint8)[ends[0] : ends[-1]] if ends[-1] > ends[0] else np.zeros(0, np.uint8)
    if len(flat) and flat.max() > 127:
        raise ValueError("a character beyond the planes: alignments are ASCII")
    size = np.diff(ends)
    words = max(1, -(-int(size.max()) // 64))
    codes = np.full((len(size), 64 * words), ord("-"), np.uint8)
    codes[np.arange(64 * words) < size[:, None]] = flat
    number = np.zeros(128, np.uint8)
    found = [c for c in np.flatnonzero(np.bincount(flat, minlength=128)) if chr(c) not in "-."]
    number[found] = np.arange(len(found))
    known = np.zeros(128, bool)
    known[found] = True
    packed = lambda bits: np.packbits(bits, axis=1, bitorder="little").view(np.uint64)
    return [packed(known[codes]), *(packed((number >> p & 1).astype(bool)[codes]) for p in range(max(0, len(found) - 1).bit_length()))]


def counted(x: list[np.ndarray], y: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    """``same, either`` of all rows of ``x`` with all of ``y``; each is masks of residues and planes, by row and word."""
    same = either = None
    equal, bits = (np.empty((len(x[0]), len(y[0])), np.uint64) for _ in range(2))
    for w in range(x[0].shape[1]):
        one, other = (lambda k: x[k][:, w, None]), (lambda k: y[k][None, :, w])
        for k in range(1, len(x)):
            np.bitwise_xor(one(k), other(k), out=bits if k > 1 else equal)
            if k > 1:
                equal |= bits
        np.bitwise_and(one(0), other(0), out=bits)
        if len(x) > 1:
            np.invert(equal, out=equal)
            equal &= bits
        else:
            equal[:] = bits
        s = np.bitwise_count(equal)
        e = np.bitwise_count(np.bitwise_or(one(0), other(0), out=bits))
        wide = np.uint8 if x[0].shape[1] == 1 else np.uint32
        same, either = (s.astype(wide, copy=False), e.astype(wide, copy=False)) if same is None else (same + s, either + e)
    return same, either


class Tally:
    """Pairs by ``same`` and ``either``."""

    def __init__(self, words: int) -> None:
        self.base = 64 * words + 1
        self.sums = np.zeros(self.base**2, np.int64) if self.base**2 <= KINDS else None
        self.parts: list[tuple[np.ndarray, np.ndarray]] = []

    def add(self, x: list[np.ndarray], y: list[np.ndarray], times: np.ndarray | None, sign: int = 1) -> None:
        same, either = counted(x, y)
        kind = np.uint16 if self.base**2 <= 1 << 16 else np.int64
        code = (same.astype(kind) * kind(self.base) + either).ravel()
        if self.sums is None:
            keys, place = np.unique(code, return_inverse=True)
            n = np.bincount(place, None if times is None else times.ravel(), len(keys))
            self.parts.append((keys, sign * n.astype(np.int64)))
        else:
            self.sums += sign * np.bincount(code, None if times is None else times.ravel(), len(self.sums)).astype(np.int64)

    def half(self) -> Tally:
        """Pairs that were counted from both sides."""
        if self.sums is not None:
            self.sums //= 2
        elif self.parts:
            keys, place = np.unique(np.concatenate([k for k, _ in self.parts]), return_inverse=True)
            self.parts = [(keys, np.bincount(place, np.concatenate([n for _, n in self.parts])).astype(np.int64) // 2)]
        return self

    def rows(self) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
        for keys, n in [(np.flatnonzero(self.sums), self.sums[self.sums != 0])] if self.sums is not None else self.parts:
            some = n != 0
            yield keys[some] // self.base, keys[some] % self.base, n[some]


def _compared(table: pa.Table) -> pa.Table:
    """The pairs of two blocks of rows of an alignment, or of one block."""
    one = table["p"][0].as_py() == table["q"][0].as_py()
    own, times = table["own"].to_numpy() == table["p"][0].as_py(), table["times"].to_numpy()
    order = np.argsort(times > 1, kind="stable")  # rows without copies first: their pairs need no weights
    rows = table["sequence"].combine_chunks()
    bits = [m[order] for m in masks(rows.chunk(0) if isinstance(rows, pa.ChunkedArray) else rows)]
    own, times, words = own[order], times[order], bits[0].shape[1]
    tally, twice = Tally(words), Tally(words)
    x, tx = [m[own] for m in bits], times[own]
    y, ty = (x, tx) if one else ([m[~own] for m in bits], times[~own])
    plain = int((ty == 1).sum())
    for i in range(0, len(tx), TILE[0]):
        to = min(i + TILE[0], len(tx))
        a, ta = [m[i:to] for m in x], tx[i:to]
        single = bool((ta == 1).all())
        weights = lambda low, high: None if single and high <= plain else ta[:, None].astype(float) * ty[low:high]  # noqa: B023, E731
        if one:
            twice.add(a, a, weights(i, to))
        j = to if one else 0
        while j < len(ty):
            high = min(j + TILE[1], len(ty), *([plain] if j < plain else []))
            tally.add(a, [m[j:high] for m in y], weights(j, high))
            j = high
    if one:  # a row is no pair with itself
        n = np.bitwise_count(x[0]).sum(axis=1).astype(np.int64)
        if twice.sums is not None:
            np.subtract.at(twice.sums, n * twice.base + n, tx**2)
        else:
            twice.parts.append((n * twice.base + n, -(tx**2)))
    made = [*tally.rows(), *twice.half().rows()]
    same, either, n = (np.concatenate(c) for c in zip(*made)) if made else (np.zeros(0, np.int64),) * 3
    of = pa.array([table["dataset"][0].as_py()] * len(n), table["dataset"].type)
    return pa.table([of, *(pa.array(c.astype(np.int64)) for c in (same, either, n))], ["dataset", "same", "either", "n"])


def pair_tallies(packed: DataFrame, block: int) -> DataFrame:
    """``dataset, same, either, n``: how many pairs of ``packed`` rows have so many columns with equal residues, and with one in either; by parts.

    Rows have ``dataset, sequence``, different ones, and ``times``, the copies that they stand for.  They are dealt to blocks, and two blocks are compared in one place.
    """
    sizes = packed.groupBy("dataset").agg(F.count("*").alias("n"))
    pairs = sizes.agg(F.sum(F.col("n").cast("double") * F.col("n") / 2)).first()[0] or 0
    parts = max(int(packed.sparkSession.conf.get("spark.sql.shuffle.partitions")), min(100_000, math.ceil(pairs / PAIRS)))
    sizes = sizes.select("dataset", F.ceil(F.col("n") / F.lit(block)).cast("int").alias("blocks"))
    dealt = packed.join(sizes, "dataset").withColumn("own", F.pmod(F.xxhash64("sequence"), F.col("blocks")).cast("int"))
    kind = packed.schema["dataset"].dataType.simpleString()
    cell = lambda other: F.struct(F.least("own", other).alias("p"), F.greatest("own", other).alias("q"))
    cells = F.explode(F.transform(F.sequence(F.lit(0), F.col("blocks") - 1), cell)).alias("cell")
    dealt = dealt.select("dataset", "sequence", "times", "own", cells).select("dataset", "cell.p", "cell.q", "own", "sequence", "times")
    return dealt.repartition(parts, "dataset", "p", "q").groupBy("dataset", "p", "q").applyInArrow(_compared, f"dataset {kind}, same long, either long, n long")
