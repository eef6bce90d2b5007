"""Fill-in-the-middle: texts cut at two places and put together in another order.

Cuts are counted in code points, texts lie in UTF-8.  While the code points of a text are counted, the byte of every
``stride``-th one is noted.  A cut is found by a binary search in these checkpoints and a rescan of less than
``stride`` code points behind the one found, so nothing but the checkpoints is kept of a text, however long it is, and
a text is never decoded.

The choice of cuts and form depends on a row's id alone, so that a task that runs again makes the same rows.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .words import slices, text_bytes

#: Before the prefix, before the suffix, before the middle.
SENTINELS = ("<P>", "<S>", "<M>")
STRIDE = 512
#: Bytes looked at at once while code points are counted.
WINDOW = 1 << 20


def starts(data: np.ndarray) -> np.ndarray:
    """Which bytes of UTF-8 text begin a code point."""
    return (data & 0xC0) != 0x80


class Checkpoints:
    """A text's number of code points ``n``, and the byte at which every ``stride``-th of them begins."""

    def __init__(self, data: np.ndarray, stride: int = STRIDE):
        self.data, self.units, self.bytes, self.n = data, [], [], 0
        for at in range(0, len(data), WINDOW):
            begin = np.flatnonzero(starts(data[at : at + WINDOW]))
            picked = np.arange(-self.n % stride, len(begin), stride)
            self.units.extend((self.n + picked).tolist())
            self.bytes.extend((at + begin[picked]).tolist())
            self.n += len(begin)
        self.units, self.bytes = np.array(self.units), np.array(self.bytes)

    def byte_of(self, unit: int) -> int:
        """Where code point ``unit`` begins; the text's end for ``n``."""
        if unit >= self.n:
            return len(self.data)
        last = int(np.searchsorted(self.units, unit, "right")) - 1
        at, left = int(self.bytes[last]), unit - int(self.units[last])
        # a code point has four bytes at most
        return at + int(np.flatnonzero(starts(self.data[at : at + 4 * left + 1]))[left])


def draws(seed: int, id_: object) -> list[int]:
    """Four numbers below 2**32 that depend on the seed and the id alone; a null id is an empty one."""
    digest = hashlib.sha256(f"{seed}:{'' if id_ is None else id_}".encode()).hexdigest()
    return [int(digest[8 * i : 8 * i + 8], 16) for i in range(4)]


def transform(data: np.ndarray, id_: object, *, seed: int, percent: int, spm_percent: int, sentinels: tuple[str, str, str], stride: int) -> tuple:
    """``n, form, prefix_chars, middle_chars, output`` of one text."""
    whole = data.tobytes()
    points = Checkpoints(data, stride)
    h1, h2, h3, h4 = draws(seed, id_)
    marks = [m.encode() for m in sentinels]
    if not points.n or h3 % 100 >= percent or any(m in whole for m in marks):
        return points.n, "plain", None, None, whole
    low, high = sorted((h1 % (points.n + 1), h2 % (points.n + 1)))
    a, b = points.byte_of(low), points.byte_of(high)
    prefix, middle, suffix = marks[0] + whole[:a], marks[2] + whole[a:b], marks[1] + whole[b:]
    form = "spm" if h4 % 100 < spm_percent else "psm"
    return points.n, form, low, high - low, (suffix + prefix if form == "spm" else prefix + suffix) + middle


def fill_in_middle(
    docs: DataFrame,
    *,
    id_column: str = "doc_id",
    text_column: str = "text",
    seed: int = 1,
    percent: int = 90,
    spm_percent: int = 20,
    sentinels: tuple[str, str, str] = SENTINELS,
    stride: int = STRIDE,
) -> DataFrame:
    """``docs`` with ``n`` (code points), ``form``, ``prefix_chars``, ``middle_chars`` and ``output``; own columns of these names are replaced.

    ``percent`` of the texts are cut in three; of these ``spm_percent`` have the suffix first (``spm``), others the
    prefix first (``psm``).  The rest, empty texts and texts that contain a sentinel are ``plain``: they stay as they are and
    have null counts.  A null text is an empty one, a null id counts as an empty id; rows with equal ids and texts get
    equal outputs, an empty table gives an empty result.  Cuts may fall together or on an end, which leaves a part empty.
    """
    made = T.StructType.fromDDL("n long, form string, prefix_chars long, middle_chars long, output string")
    if len(set(sentinels)) < 3 or any(not m or m[0] in other[1:] for m in sentinels for other in sentinels):
        raise ValueError("three different sentinels are needed, whose first characters come nowhere within them again")
    kept = [c for c in docs.columns if c not in made.names]
    id_, text = (next(x for x in (f"__{name}{'_' * i}" for i in range(len(docs.columns) + 1)) if x not in docs.columns) for name in ("id", "text"))
    options = {"seed": seed, "percent": percent, "spm_percent": spm_percent, "sentinels": sentinels, "stride": stride}

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, text):
            buf, off = text_bytes(batch.column(batch.schema.get_field_index(text)))
            ids = batch.column(batch.schema.get_field_index(id_)).to_pylist()
            rows = [transform(buf[off[i] : off[i + 1]], x, **options) for i, x in enumerate(ids)]
            n, form, low, size, output = zip(*rows)
            columns = [batch.column(batch.schema.get_field_index(c)) for c in kept]
            new = [pa.array(n, pa.int64()), pa.array(form), pa.array(low, pa.int64()), pa.array(size, pa.int64()), pa.array(output, pa.binary()).cast(pa.string())]
            yield pa.RecordBatch.from_arrays(columns + new, [*kept, *made.names])

    schema = T.StructType([*(docs.schema[c] for c in kept), *made.fields])
    read = docs.select(*(F.col(f"`{c}`") for c in kept), F.col(f"`{id_column}`").alias(id_), F.col(f"`{text_column}`").alias(text))
    return read.mapInArrow(run, schema)


def restored(output: str = "output", form: str = "form", sentinels: tuple[str, str, str] = SENTINELS) -> Column:
    """The text that an output was made of, from the output and its form alone.

    A sentinel stands in a cut output once, as the text had none and none arises where parts meet: the first character of a
    sentinel must not come again within it.
    """
    prefix, suffix, middle = sentinels
    parts = F.split(F.col(output), "|".join(f"\\Q{m}\\E" for m in sentinels), -1)
    order = {"psm": (1, 3, 2), "spm": (2, 3, 1)}
    joined = {k: F.concat(*(F.get(parts, F.lit(i)) for i in v)) for k, v in order.items()}
    return F.when(F.col(form) == "psm", joined["psm"]).when(F.col(form) == "spm", joined["spm"]).otherwise(F.col(output))
