"""Byte-level BPE by the ranks of a public vocabulary: each distinct word is encoded once.

Texts are split into pre-tokens; a slice of texts keeps its pre-tokens' positions as numbers in
its own list of distinct words, and sends to each bucket of words those of its list that belong
there, in one parcel.  A bucket encodes each of its distinct words once and sends the ids back in the order of
the request; slices put their texts together by position, and join the ids with the table of token
bytes, whose size is that of the vocabulary.  Parcels are compressed, as a row for each word of a slice takes more
than twice the disk that there is; they are never more than the words asked for, so they grow with the input.

Slices are cut from rows sorted within their partition and named by what they hold, so that a task that runs again
makes the same ones; if its input had other rows by then, the run fails rather than mix ids up.
"""

from __future__ import annotations

import base64
import hashlib
import math
from collections.abc import Iterable, Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..plans.shared import cut
from .repeats import bucket_of, runs
from .words import slices, span_hashes

PARCEL = "batch long, bucket int, ids binary, body binary"


def read_ranks(path: str) -> dict[bytes, int]:
    """The vocabulary: a line for each token, its bytes in base 64 and its rank."""
    with open(path, "rb") as lines:
        return {base64.b64decode(token): int(rank) for token, rank in (x.split() for x in lines if x.strip())}


def token_table(spark: SparkSession, ranks: dict[bytes, int]) -> DataFrame:
    """``token, bytes``: the vocabulary as a table, whose size is the vocabulary's."""
    return spark.createDataFrame([(rank, bytearray(token)) for token, rank in ranks.items()], "token int, bytes binary")


def squeeze(data: bytes) -> bytes:
    return len(data).to_bytes(8, "little") + pa.compress(data, "zstd", asbytes=True)


def unsqueeze(data: bytes) -> bytes:
    return pa.decompress(data[8:], int.from_bytes(data[:8], "little"), "zstd", asbytes=True)


def pack_arrays(*arrays: np.ndarray) -> bytes:
    """Integer arrays one after another, each in its own type and with its bytes by significance, compressed."""
    head = np.array([x for a in arrays for x in (len(a), a.dtype.itemsize)], np.int64)
    return squeeze(len(arrays).to_bytes(8, "little") + head.tobytes() + b"".join(a.view(np.uint8).reshape(len(a), -1).T.tobytes() for a in arrays if len(a)))


def unpack_arrays(blob: bytes) -> list[np.ndarray]:
    data = unsqueeze(blob)
    n = int.from_bytes(data[:8], "little")
    head = np.frombuffer(data, np.int64, 2 * n, 8)
    out, at = [], 8 + 16 * n
    for size, width in head.reshape(n, 2).tolist():
        planes = np.frombuffer(data, np.uint8, size * width, at).reshape(width, size)
        out.append(np.ascontiguousarray(planes.T).view(np.dtype(f"u{width}")).reshape(size))
        at += size * width
    return out


def narrow(values: np.ndarray) -> np.ndarray:
    """The values in the fewest bytes that hold them."""
    top = int(values.max()) if len(values) else 0
    return values.astype(next(k for k in (np.uint8, np.uint16, np.uint32, np.uint64) if top <= np.iinfo(k).max))


def merge_word(word: bytes, ranks: dict[bytes, int]) -> list[int]:
    """Ids of one pre-token: the pair of neighbours with the lowest rank is merged, leftmost first."""
    whole = ranks.get(word)
    if whole is not None:
        return [whole]
    parts = [word[i : i + 1] for i in range(len(word))]
    if len(parts) > 64:
        return _merge_long(parts, ranks)
    while len(parts) > 1:
        best, at = None, -1
        for i in range(len(parts) - 1):
            rank = ranks.get(parts[i] + parts[i + 1])
            if rank is not None and (best is None or rank < best):
                best, at = rank, i
        if best is None:
            break
        parts[at : at + 2] = [parts[at] + parts[at + 1]]
    return [ranks[p] for p in parts]


def _merge_long(parts: list[bytes], ranks: dict[bytes, int]) -> list[int]:
    """The same for long words, with a heap of pairs instead of a scan for each merge."""
    import heapq

    n = len(parts)
    ahead, behind = list(range(1, n + 1)), list(range(-1, n - 1))
    held: list[bytes | None] = list(parts)
    heap: list[tuple[int, int, bytes]] = []

    def offer(i: int) -> None:
        if i >= 0 and ahead[i] < n:
            pair = held[i] + held[ahead[i]]
            if (rank := ranks.get(pair)) is not None:
                heapq.heappush(heap, (rank, i, pair))

    for i in range(n):
        offer(i)
    while heap:
        _, i, pair = heapq.heappop(heap)
        if held[i] is None or ahead[i] >= n or held[i] + held[ahead[i]] != pair:
            continue
        gone = ahead[i]
        held[i], held[gone] = pair, None
        ahead[i] = ahead[gone]
        if ahead[i] < n:
            behind[ahead[i]] = i
        offer(i)
        offer(behind[i])
    return [ranks[p] for p in held if p is not None]


@lru_cache(maxsize=2)
def _tools(pattern: str):
    import regex

    return regex.compile(pattern)


def numbering(sizes: np.ndarray) -> np.ndarray:
    """The order in which words asked for bucket by bucket are numbered: the first of each bucket, the
    second of each, and so on, so that frequent words have small numbers."""
    bucket = np.repeat(np.arange(len(sizes)), sizes)
    rank = np.arange(len(bucket)) - np.repeat(np.cumsum(sizes) - sizes, sizes)
    return np.lexsort((bucket, rank))


def parcels(part: pa.RecordBatch, place_of: tuple[int, int], buckets: int, pattern: str) -> Iterator[tuple]:
    """A slice's own parcel (bucket -1), and one for each bucket with the words asked of it.

    The slice is named by its place (partition and number) and its content.
    """
    find = _tools(pattern).findall
    number: dict[str, int] = {}
    at: list[int] = []
    counts = []
    for text in part.column(1).to_pylist():
        words = find(text) if text else []
        counts.append(len(words))
        at.extend([number.setdefault(w, len(number)) for w in words])
    data = [w.encode() for w in number]
    size = np.fromiter(map(len, data), np.int64, len(data))
    end = np.cumsum(size)
    buf = np.frombuffer(b"".join(data), np.uint8)
    bucket = bucket_of(span_hashes(buf, end - size, end), buckets).astype(np.int64) if len(data) else np.zeros(0, np.int64)
    at = np.array(at, np.int64)
    often = np.bincount(at, minlength=len(data))
    order = np.lexsort((-often, bucket))  # as they are asked for: bucket by bucket, frequent words first
    place = np.empty(len(order), np.int64)
    place[order[numbering(np.bincount(bucket, minlength=buckets))]] = np.arange(len(order))
    at = place[at]
    sink = pa.BufferOutputStream()
    ids = pa.RecordBatch.from_arrays([part.column(0)], ["id"])
    with pa.ipc.new_stream(sink, ids.schema) as stream:
        stream.write_batch(ids)
    own = sink.getvalue().to_pybytes()
    content = hashlib.blake2b(repr((place_of, counts)).encode() + own + at.tobytes() + buf.tobytes(), digest_size=8)
    batch = int.from_bytes(content.digest(), "little", signed=True)
    yield batch, -1, own, pack_arrays(narrow(np.array(counts, np.int64)), narrow(at), np.array([len(data)], np.uint64))
    cut = runs(bucket[order])
    for rows in np.split(order, cut[1:]) if len(cut) else []:
        asked = b"".join(data[i] for i in rows.tolist())
        yield batch, int(bucket[rows[0]]), b"", pack_arrays(narrow(size[rows]), np.frombuffer(asked, np.uint8))


def tables(rows: list[tuple]) -> pa.RecordBatch:
    kinds = [pa.int64(), pa.int32(), pa.binary(), pa.binary()]
    return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows, strict=True), kinds, strict=True)], ["batch", "bucket", "ids", "body"])


def answer(table: pa.Table, ranks: dict[bytes, int]) -> pa.Table:
    """For each batch, the ids of the words that it asked for; a word is encoded once."""
    known: dict[bytes, list[int]] = {}
    rows = []
    for batch, bucket, body in zip(*(table.column(c).to_pylist() for c in ("batch", "bucket", "body")), strict=True):
        size, asked = unpack_arrays(body)
        end = np.cumsum(size, dtype=np.int64)
        data = asked.tobytes()
        got = []
        for a, b in zip((end - size).tolist(), end.tolist(), strict=True):
            word = data[a:b]
            ids = known.get(word)
            if ids is None:
                ids = known[word] = merge_word(word, ranks)
            got.append(ids)
        n = np.fromiter(map(len, got), np.int64, len(got))
        flat = np.fromiter((i for ids in got for i in ids), np.int64, int(n.sum()))
        rows.append((batch, bucket, b"", pack_arrays(narrow(n), narrow(flat))))
    return pa.Table.from_batches([tables(rows)])


def assemble(own: pa.Table, replies: pa.Table, tokens: list[bytes]) -> pa.Table:
    """A batch's texts as ids, by position, and the bytes that these decode to."""
    slots = [i for i, b in enumerate(own.column("bucket").to_pylist()) if b == -1]
    ids = pa.ipc.open_stream(own.column("ids")[slots[0]].as_py()).read_all().column(0)
    counts, at, asked = unpack_arrays(own.column("body")[slots[0]].as_py())
    answers = sorted(zip(replies.column("bucket").to_pylist(), replies.column("body").to_pylist(), strict=True))
    parts = [unpack_arrays(body) for _, body in answers]
    empty = np.zeros(0, np.int64)
    size = np.concatenate([p[0] for p in parts]).astype(np.int64) if parts else empty
    flat = np.concatenate([p[1] for p in parts]).astype(np.int32) if parts else empty.astype(np.int32)
    if len(slots) != 1 or len(size) != int(asked[0]):
        raise ValueError("a slice changed while it was encoded: the rows of the input are not fixed")
    begin = np.cumsum(size) - size
    at = numbering(np.array([len(p[0]) for p in parts], np.int64))[at.astype(np.int64)] if parts else empty
    n = size[at]
    done = np.cumsum(n)
    out = flat[np.repeat(begin[at] - (done - n), n) + np.arange(int(n.sum()))]
    words = np.concatenate([[0], np.cumsum(counts, dtype=np.int64)])
    bound = np.concatenate([[0], done])[words]
    if len(out):  # the ids are joined with the bytes of the tokens
        spelled = pa.array(tokens, pa.large_binary()).take(pa.array(out))
        ends, data = np.frombuffer(spelled.buffers()[1], np.int64)[: len(out) + 1], spelled.buffers()[2]
    else:
        ends, data = np.zeros(1, np.int64), pa.py_buffer(b"")
    decoded = pa.LargeBinaryArray.from_buffers(pa.large_binary(), len(counts), [None, pa.py_buffer(np.ascontiguousarray(ends[bound])), data])
    return pa.table(
        {
            "id": ids,
            "n_tokens": pa.array(np.diff(bound)),
            "ids": pa.ListArray.from_arrays(pa.array(bound.astype(np.int32)), pa.array(out)),
            "decoded": decoded.cast(pa.binary()),
        }
    )


def encode(
    docs: DataFrame,
    ranks: dict[bytes, int],
    pattern: str,
    *,
    id_col: str = "doc_id",
    text_col: str = "text",
    slice_bytes: int = 4 << 20,
    bucket_bytes: int = 32 << 20,
) -> DataFrame:
    """Token ids of every text and the bytes they decode to, without special tokens.

    ``ranks`` maps the bytes of each token to its id; pre-tokens are the matches of ``pattern``.
    Result, a row per input row: the id, ``n_tokens, ids, decoded``.  Null texts count as empty and
    have no tokens; rows with equal ids are encoded each; further columns are left out; an empty
    table gives an empty result.  The ranks go to the executors once, as a broadcast whose size is
    the vocabulary's; a token must be known for each single byte that occurs.
    """
    spark = docs.sparkSession
    sent = spark.sparkContext.broadcast(ranks)
    bytes_of = [b""] * (max(ranks.values(), default=-1) + 1)
    for token, rank in ranks.items():
        bytes_of[rank] = token
    tokens = spark.sparkContext.broadcast(bytes_of)
    total = docs.agg(F.sum(F.octet_length(text_col))).first()[0] or 0
    buckets = max(1, math.ceil(total / bucket_bytes))
    kind = docs.schema[id_col].dataType

    def split(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        for number, part in enumerate(slices(batches, "text", slice_bytes)):
            yield tables(list(parcels(part, (TaskContext.get().partitionId(), number), buckets, pattern)))

    def requests(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield batch.filter(pa.compute.greater_equal(batch.column(1), 0))

    rows = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text")).sortWithinPartitions("id", F.xxhash64("text"))
    # one shuffle of all parcels, which both sides below read
    dealt = rows.mapInArrow(split, PARCEL).repartition("batch")
    replies = dealt.mapInArrow(requests, PARCEL).groupBy("bucket").applyInArrow(lambda t: answer(t, sent.value), PARCEL)
    result = T.StructType(
        [
            T.StructField("id", kind),
            T.StructField("n_tokens", T.LongType()),
            T.StructField("ids", T.ArrayType(T.IntegerType())),
            T.StructField("decoded", T.BinaryType()),
        ]
    )
    out = dealt.groupBy("batch").cogroup(replies.groupBy("batch")).applyInArrow(
        lambda mine, theirs: assemble(mine, theirs, tokens.value), result
    )
    return out.withColumnRenamed("id", id_col)


def decode(tokens: DataFrame, ranks: dict[bytes, int], *, id_col: str = "doc_id", ids_col: str = "ids") -> DataFrame:
    """The bytes of lists of ids: ``id, decoded``, a row per input row.

    Ids are exploded with their positions, joined with the table of token bytes and put together by position.
    A null or empty list decodes to nothing, an unknown id is an error; further columns are left out.
    """
    rows = cut(tokens.select(F.col(id_col).alias("id"), F.col(ids_col).alias("ids")).withColumn("row", F.expr("uuid()")))
    units = rows.select("row", F.posexplode("ids").alias("at", "token"))
    found = units.join(F.broadcast(token_table(tokens.sparkSession, ranks)), "token", "left")
    piece = F.when(F.col("bytes").isNull(), F.raise_error(F.concat(F.lit("no such token: "), F.coalesce(F.col("token").cast("string"), F.lit("null"))))).otherwise(F.hex("bytes"))
    joined = found.groupBy("row").agg(F.sort_array(F.collect_list(F.struct("at", piece.alias("x")))).alias("parts"))
    text = F.unhex(F.array_join(F.transform("parts", lambda p: p["x"]), ""))
    return rows.join(joined.select("row", text.alias("decoded")), "row", "left").select(
        F.col("id").alias(id_col), F.coalesce("decoded", F.lit(bytearray())).alias("decoded")
    )
