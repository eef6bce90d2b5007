"""Words and rolling hashes of a chunk of texts, on the bytes of an Arrow column.

A word is a run of bytes other than space, tab, line feed, vertical tab, form feed and
carriage return.  Nothing here makes a Python string of a word: texts stay in one byte
buffer, and words, windows and hashes are NumPy arrays over it.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

SPACE = np.zeros(256, bool)
SPACE[[9, 10, 11, 12, 13, 32]] = True
LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32
def mix(x: np.ndarray) -> np.ndarray:
    """A bijective scrambling of 64-bit values."""
    x = x ^ (x >> np.uint64(33))
    x = x * np.uint64(0xFF51AFD7ED558CCD)
    x ^= x >> np.uint64(33)
    x *= np.uint64(0xC4CEB9FE1A85EC53)
    return x ^ (x >> np.uint64(33))


@dataclass
class Chunk:
    """Texts as bytes: text i is ``buf[off[i]:off[i + 1]]``; word j is ``buf[start[j]:end[j]]``."""

    buf: np.ndarray
    off: np.ndarray
    start: np.ndarray
    end: np.ndarray
    ptr: np.ndarray  # the words of text i are ptr[i]:ptr[i + 1]

    @property
    def doc(self) -> np.ndarray:
        return np.repeat(np.arange(len(self.off) - 1), np.diff(self.ptr))

    def lower(self) -> Chunk:
        return Chunk(LOWER[self.buf], self.off, self.start, self.end, self.ptr)


def text_bytes(texts: pa.Array | pa.ChunkedArray) -> tuple[np.ndarray, np.ndarray]:
    """The UTF-8 bytes of a string column and the offsets of its texts; null counts as empty."""
    if isinstance(texts, pa.ChunkedArray):
        texts = texts.combine_chunks()
        texts = pa.concat_arrays(texts.chunks) if isinstance(texts, pa.ChunkedArray) else texts
    texts = pc.fill_null(texts.cast(pa.large_string()), "")
    if not len(texts):
        return np.zeros(0, np.uint8), np.zeros(1, np.int64)
    _, offsets, data = texts.buffers()
    off = np.frombuffer(offsets, np.int64)[texts.offset : texts.offset + len(texts) + 1]
    buf = np.frombuffer(data, np.uint8)[off[0] : off[-1]] if data is not None and off[-1] > off[0] else np.zeros(0, np.uint8)
    return buf, off - off[0]


def chunk_of(texts: pa.Array | pa.ChunkedArray) -> Chunk:
    buf, off = text_bytes(texts)
    n = len(buf)
    blank = SPACE[buf]
    edge = np.ones(n + 1, bool)  # edge[i]: a text or a blank ends just before byte i
    edge[1:] = np.append(blank[: n - 1], True) if n else edge[1:]
    inside = off[off < n]
    edge[inside] = True
    solid = ~blank
    start = np.flatnonzero(solid & edge[:n])
    after = np.ones(n, bool)
    if n:
        after[:-1] = blank[1:] | False
        ends = off[1:][off[1:] > off[:-1]] - 1
        after[ends] = True
    end = np.flatnonzero(solid & after) + 1
    return Chunk(buf, off, start, end, np.searchsorted(start, off))


def sequence_hashes(values: np.ndarray, start: np.ndarray, count: np.ndarray) -> np.ndarray:
    """A 64-bit hash of each run ``values[start:start + count]``, which may be empty.

    Every value is scrambled together with its place, so that no two runs collide by their structure, as they do
    under a polynomial modulo a power of two.
    """
    out = np.zeros(len(count), np.uint64)
    full = np.flatnonzero(count)
    begin = np.cumsum(count[full]) - count[full]
    place = np.arange(int(count.sum())) - np.repeat(begin, count[full])
    picked = values[np.repeat(start[full], count[full]) + place]
    if len(full):
        out[full] = np.add.reduceat(mix(picked ^ mix(place.astype(np.uint64) + np.uint64(1))), begin)
    return mix(out + count.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15))


def span_hashes(buf: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    """A 64-bit hash of each ``buf[start:end]``, made of its blocks of 8 bytes; equal spans have equal hashes."""
    size = (end - start).astype(np.int64)
    blocks = -(-size // 8)
    begin = np.cumsum(blocks) - blocks
    place = np.arange(int(blocks.sum())) - np.repeat(begin, blocks)
    at = np.repeat(start, blocks) + 8 * place
    padded = np.concatenate([buf, np.zeros(8, np.uint8)])
    word = np.lib.stride_tricks.sliding_window_view(padded, 8)[at]
    value = np.ascontiguousarray(word).view("<u8").reshape(-1)
    inside = np.minimum(np.repeat(size, blocks) - 8 * place, 8).astype(np.uint64)
    value = value & (np.uint64(0xFFFFFFFFFFFFFFFF) >> ((np.uint64(8) - inside) * np.uint64(8)))
    return mix(sequence_hashes(value, begin, blocks) + size.astype(np.uint64))


def window_hashes(hashes: np.ndarray, ptr: np.ndarray, size: int) -> tuple[np.ndarray, np.ndarray]:
    """First words and hashes of all runs of ``size`` consecutive words within one text.

    Runs of 1, 2, 4, ... words are joined pairwise, each time scrambled, and those of the powers of two that
    ``size`` is the sum of are joined in turn.
    """
    n = len(hashes)
    if n < size:
        return np.zeros(0, np.int64), np.zeros(0, np.uint64)
    join = lambda a, b: mix(a * np.uint64(0x9E3779B97F4A7C15) + (b ^ np.uint64(0xD6E8FEB86659FD93)))
    double, length = hashes, 1  # double[i] is of the words i to i + length
    run, taken = None, 0
    while True:
        if size & length:
            run = double if run is None else join(run[: n - taken - length + 1], double[taken : n - length + 1])
            taken += length
        if 2 * length > size:
            break
        double = join(double[: n - 2 * length + 1], double[length : n - length + 1])
        length *= 2
    room = np.repeat(ptr[1:], np.diff(ptr))[: n - size + 1]
    first = np.flatnonzero(np.arange(n - size + 1) + size <= room)
    return first, run[first]


def covered(n: int, first: np.ndarray, size: int) -> np.ndarray:
    """Which of n words are in a run of ``size`` words that begins at one of ``first``."""
    step = np.zeros(n + 1, np.int64)
    np.add.at(step, first, 1)
    np.subtract.at(step, first + size, 1)
    return np.cumsum(step[:n]) > 0


def slices(batches: Iterable[pa.RecordBatch], column: str, most: int = 2 << 20) -> Iterator[pa.RecordBatch]:
    """The rows of the batches in order, in slices of about ``most`` bytes of text (one text at least)."""
    for batch in batches:
        size = pc.fill_null(pc.binary_length(batch.column(batch.schema.get_field_index(column))), 0).to_numpy(zero_copy_only=False)
        total = np.cumsum(size)
        at = 0
        while at < batch.num_rows:
            to = int(np.searchsorted(total, (total[at - 1] if at else 0) + most, "right"))
            to = max(to, at + 1)
            yield batch.slice(at, to - at)
            at = to
