"""Substring dedup: runs of words that an earlier document has too are cut out.

Fixed-block anchors: every document is an index of its non-overlapping blocks of ``window / 2``
words, and probes the others' blocks with each of its rolling windows of that length.  A run of
``window`` words holds a whole block wherever it begins, so no repeat is missed.  Hits are extended by
the runs of ``window`` words around them, which are compared by 128 bits of two independent hashes (a block hash is 64
bits, and a false hit only costs a comparison); those that an earlier document has overlap into the maximal
repeats, which are what is removed.

Both rounds are dealt alike.  Texts are dealt once into batches of a few MB; a batch writes to
each bucket of hashes one row, holding each of its distinct hashes once, so that copies and common
passages are merged before the shuffle and no key has more entries than there are batches.
Buckets answer batches with the hashes that matter to them.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .words import Chunk, chunk_of, covered, mix, span_hashes, window_hashes

ALIGNED, MANY = 1, 2
LOW = np.uint64((1 << 30) - 1)
SECOND = np.uint64(0x5851F42D4C957F2D)
LETTER = "bucket int, batch long, blob binary"


def bucket_of(hashes: np.ndarray, buckets: int) -> np.ndarray:
    return ((hashes >> np.uint64(32)) * np.uint64(buckets)) >> np.uint64(32)


def letters(keys: list[int], batch: list[int], blobs: list[bytes]) -> pa.Table:
    return pa.table({"bucket": pa.array(keys, pa.int32()), "batch": pa.array(batch, pa.int64()), "blob": pa.array(blobs, pa.binary())})


def runs(sorted_values: np.ndarray) -> np.ndarray:
    """Where each run of equal values begins."""
    return np.flatnonzero(np.concatenate([[True], sorted_values[1:] != sorted_values[:-1]])) if len(sorted_values) else np.zeros(0, np.int64)


def member(values: np.ndarray, among: np.ndarray) -> np.ndarray:
    """Which values are in a sorted array."""
    if not len(among):
        return np.zeros(len(values), bool)
    at = np.minimum(np.searchsorted(among, values), len(among) - 1)
    return among[at] == values


def ids_of(table: pa.Table) -> tuple[np.ndarray, np.ndarray]:
    column = table.column("id").combine_chunks()
    return column.fill_null(0).to_numpy(zero_copy_only=False), column.is_null().to_numpy(zero_copy_only=False)


def windows_of(chunk: Chunk, hashes: np.ndarray, null: np.ndarray, size: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """First words, hashes and texts of the windows of the texts that have an id."""
    first, window = window_hashes(hashes, chunk.ptr, size)
    doc = chunk.doc[first]
    real = ~null[doc]
    return first[real], window[real], doc[real]


def joined(chunk: Chunk, keep: np.ndarray) -> pa.Array:
    """Each text's kept words joined by one space."""
    n = len(chunk.off) - 1
    start, end, doc = chunk.start[keep], chunk.end[keep], chunk.doc[keep]
    later = np.concatenate([[False], doc[1:] == doc[:-1]]) if len(doc) else np.zeros(0, bool)
    mark = np.zeros(len(chunk.buf) + 1, np.int8)
    mark[start] += 1
    mark[end] -= 1
    take = np.cumsum(mark[:-1]) > 0
    buf = chunk.buf.copy()
    buf[start[later] - 1] = 32
    take[start[later] - 1] = True
    size = np.bincount(doc, (end - start) + later, minlength=n)
    offsets = np.concatenate([[0], np.cumsum(size)]).astype(np.int64)
    return pa.LargeStringArray.from_buffers(n, pa.py_buffer(offsets), pa.py_buffer(buf[take])).cast(pa.string())


def anchors(table: pa.Table, block: int, buckets: int) -> pa.Table:
    """A batch's distinct rolling block hashes: by bucket, 30 bits of each and two flags."""
    chunk = chunk_of(table.column("text"))
    _, null = ids_of(table)
    first, window, doc = windows_of(chunk, span_hashes(chunk.buf, chunk.start, chunk.end), null, block)
    aligned = (first - chunk.ptr[doc]) % block == 0
    order = np.argsort(window, kind="stable")
    window, doc, aligned = window[order], doc[order], aligned[order]
    at = runs(window)
    if not len(at):
        return letters([], [], [])
    flags = np.logical_or.reduceat(aligned, at) * ALIGNED + (np.minimum.reduceat(doc, at) != np.maximum.reduceat(doc, at)) * MANY
    window = window[at]
    low = (((window & LOW) << np.uint64(2)) | flags.astype(np.uint64)).astype(np.uint32)
    bucket = bucket_of(window, buckets)
    cut = runs(bucket)
    blobs = [x.tobytes() for x in np.split(low, cut[1:])]
    return letters(bucket[cut].astype(int).tolist(), [table.column("batch")[0].as_py()] * len(cut), blobs)


def shared_anchors(table: pa.Table) -> pa.Table:
    """For each batch, its hashes of this bucket that are a block somewhere and in two texts or more."""
    parts = [np.frombuffer(x, np.uint32) for x in table.column("blob").to_pylist()]
    both = np.concatenate(parts)
    source = np.repeat(np.arange(len(parts)), [len(x) for x in parts])
    order = np.argsort(both >> 2, kind="stable")
    both, source = both[order], source[order]
    low, flags = both >> 2, both & 3
    at = runs(low)
    size = np.diff(np.append(at, len(low)))
    good = (np.bitwise_or.reduceat(flags & ALIGNED, at) > 0) & ((size > 1) | (np.bitwise_or.reduceat(flags & MANY, at) > 0))
    keep = np.repeat(good, size)
    return answers(table, low[keep], source[keep])


def answers(table: pa.Table, values: np.ndarray, source: np.ndarray) -> pa.Table:
    """The values as one letter to each of the batches that they came from."""
    order = np.argsort(source, kind="stable")
    values, source = values[order], source[order]
    at = runs(source)
    batch = table.column("batch").to_numpy()
    bucket = table.column("bucket")[0].as_py()
    return letters([bucket] * len(at), batch[source[at]].tolist(), [x.tobytes() for x in np.split(values, at[1:])] if len(at) else [])


def near_windows(texts: pa.Table, hits: pa.Table, block: int, window: int, buckets: int) -> pa.Table:
    """The windows around a batch's hits: by bucket, their hashes and the smallest id that has each."""
    if not texts.num_rows or not hits.num_rows:
        return letters([], [], [])
    chunk = chunk_of(texts.column("text"))
    ids, null = ids_of(texts)
    hashes = span_hashes(chunk.buf, chunk.start, chunk.end)
    first, anchor, doc = windows_of(chunk, hashes, null, block)
    known = [
        (np.uint64(b) << np.uint64(30)) | np.frombuffer(x, np.uint32).astype(np.uint64)
        for b, x in zip(hits.column("bucket").to_pylist(), hits.column("blob").to_pylist(), strict=True)
    ]
    hit = member((bucket_of(anchor, buckets) << np.uint64(30)) | (anchor & LOW), np.sort(np.concatenate(known)))
    first, doc = first[hit], doc[hit]
    begin = np.maximum(first - (window - block), chunk.ptr[doc])
    stop = np.minimum(first, chunk.ptr[doc + 1] - window) + 1
    real = stop > begin
    step = np.zeros(len(hashes) + 1, np.int64)
    np.add.at(step, begin[real], 1)
    np.subtract.at(step, stop[real], 1)
    near = np.cumsum(step[:-1]) > 0
    first, value, doc = windows_of(chunk, hashes, null, window)
    _, second, _ = windows_of(chunk, mix(hashes + SECOND), null, window)
    picked = near[first]
    value, second, owner = value[picked], second[picked], ids[doc[picked]]
    order = np.argsort(value, kind="stable")
    value, second, owner = value[order], second[order], owner[order]
    at = runs(value)
    if not len(at):
        return letters([], [], [])
    value, second, owner = value[at], second[at], np.minimum.reduceat(owner, at)
    bucket = bucket_of(value, buckets)
    cut = runs(bucket)
    blobs = [pack_owners(*x) for x in zip(*(np.split(y, cut[1:]) for y in (value, second, owner)), strict=True)]
    return letters(bucket[cut].astype(int).tolist(), [texts.column("batch")[0].as_py()] * len(cut), blobs)


def pack_owners(value: np.ndarray, second: np.ndarray, owner: np.ndarray) -> bytes:
    """Hashes and ids as bytes; ids as differences from the least, in as few bytes as hold them."""
    least = int(owner.min())
    off = (owner.astype(np.int64) - np.int64(least)).view(np.uint64)
    kind = next(k for k in (np.uint16, np.uint32, np.uint64) if int(off.max()) <= np.iinfo(k).max)
    head = np.array([least, len(value), np.dtype(kind).itemsize], np.int64).tobytes()
    return head + value.tobytes() + second.tobytes() + off.astype(kind).tobytes()


def unpack_owners(blob: bytes) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    least, n, width = np.frombuffer(blob, np.int64, 3)
    value, second = np.frombuffer(blob, np.uint64, 2 * n, 24).reshape(2, n)
    off = np.frombuffer(blob, np.dtype(f"u{width}"), n, 24 + 16 * n)
    return value, second, (off.astype(np.uint64).view(np.int64) + least).astype(np.int64)


def later_windows(table: pa.Table) -> pa.Table:
    """For each batch, its windows of this bucket of which another batch has an earlier owner."""
    parts = [unpack_owners(x) for x in table.column("blob").to_pylist()]
    value, second, owner = (np.concatenate(x) for x in zip(*parts, strict=True))
    source = np.repeat(np.arange(len(parts)), [len(v) for v, _, _ in parts])
    order = np.lexsort((second, value))
    value, second, owner, source = value[order], second[order], owner[order], source[order]
    at = np.union1d(runs(value), runs(second))  # both are equal in a run
    least = np.repeat(np.minimum.reduceat(owner, at), np.diff(np.append(at, len(value))))
    later = owner > least
    return answers(table, value[later], source[later])


def cut_repeats(texts: pa.Table, later: pa.Table, window: int) -> pa.Table:
    """A batch's rows with the words that repeat an earlier document taken out."""
    chunk = chunk_of(texts.column("text"))
    ids, null = ids_of(texts)
    n = len(chunk.off) - 1
    first, value, doc = windows_of(chunk, span_hashes(chunk.buf, chunk.start, chunk.end), null, window)
    owner = ids[doc]
    order = np.argsort(value, kind="stable")
    at = runs(value[order])
    gone = np.zeros(len(value), bool)
    if len(at):
        least = np.repeat(np.minimum.reduceat(owner[order], at), np.diff(np.append(at, len(value))))
        gone[order] = owner[order] > least
    known = [np.frombuffer(x, np.uint64) for x in later.column("blob").to_pylist()] if later.num_rows else []
    if known:
        gone |= member(value, np.sort(np.concatenate(known)))
    out = covered(len(chunk.start), first[gone], window)
    of = chunk.doc
    edge = np.concatenate([[True], (out[1:] != out[:-1]) | (of[1:] != of[:-1])]) if len(out) else out
    begin = np.flatnonzero(edge)
    end = np.append(begin[1:], len(out))
    begin, end = begin[out[begin]], end[out[begin]]
    spans = pa.StructArray.from_arrays(
        [pa.array(begin - chunk.ptr[of[begin]]), pa.array(end - chunk.ptr[of[begin]])], ["first", "after"]
    )
    cut = pa.array(np.searchsorted(of[begin], np.arange(n + 1)).astype(np.int32))
    return pa.table(
        {
            "row": texts.column("row"),
            "kept": joined(chunk, ~out),
            "n_words": pa.array(np.diff(chunk.ptr).astype(np.int64)),
            "n_removed": pa.array(np.bincount(of[out], minlength=n).astype(np.int64)),
            "removed": pa.ListArray.from_arrays(cut, spans),
        }
    )


def drop_repeats(
    docs: DataFrame,
    *,
    id_col: str = "doc_id",
    text_col: str = "text",
    window: int = 50,
    batch_bytes: int = 2 << 20,
    bucket_bytes: int = 8 << 20,
) -> DataFrame:
    """Documents without the words covered by a run of ``window`` words that a document with a smaller id has.

    Words are runs of bytes other than ASCII blanks, compared unchanged; runs are judged on the
    input.  Result: the input's columns, with the text made of the kept words joined by one space,
    and ``n_words, n_removed, removed`` (first word, and the word after the last, of each cut), which
    replace input columns of these names.  A null text is an empty one.  A document with a null id
    is no reference and loses nothing; rows with equal ids keep their common runs.  An empty table
    gives an empty result.
    """
    block = window // 2
    total = docs.agg(F.sum(F.octet_length(text_col))).first()[0] or 0
    batches, buckets = max(1, math.ceil(total / batch_bytes)), max(1, math.ceil(total / bucket_bytes))
    rest = [c for c in docs.columns if c != text_col]  # the text itself travels once
    dealt = docs.select(
        # repeated rows are dealt apart by the partition that they come from
        F.pmod(F.xxhash64(F.col(id_col), F.col(text_col), F.spark_partition_id()), F.lit(batches)).alias("batch"),
        F.col(id_col).cast("long").alias("id"),
        F.col(text_col).alias("text"),
        F.struct(*(F.col(f"`{c}`") for c in rest)).alias("row"),
    )
    by_batch = dealt.groupBy("batch")
    answered = by_batch.applyInArrow(lambda t: anchors(t, block, buckets), LETTER).groupBy("bucket").applyInArrow(shared_anchors, LETTER)
    near = by_batch.cogroup(answered.groupBy("batch")).applyInArrow(
        lambda t, hits: near_windows(t, hits, block, window, buckets), LETTER
    )
    later = near.groupBy("bucket").applyInArrow(later_windows, LETTER)
    result = T.StructType(
        [
            dealt.schema["row"],
            T.StructField("kept", T.StringType()),
            T.StructField("n_words", T.LongType()),
            T.StructField("n_removed", T.LongType()),
            T.StructField("removed", T.ArrayType(T.StructType([T.StructField("first", T.LongType()), T.StructField("after", T.LongType())]))),
        ]
    )
    out = by_batch.cogroup(later.groupBy("batch")).applyInArrow(lambda t, x: cut_repeats(t, x, window), result)
    made = ["n_words", "n_removed", "removed"]
    return out.select(
        *(F.col("kept").alias(c) if c == text_col else F.col(f"row.`{c}`").alias(c) for c in docs.columns if c not in made), *made
    )
