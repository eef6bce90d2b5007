"""Quality classifier: gated attention over the passages of a document.

Every passage of a text is encoded; a small network learns from document labels alone how much
each passage counts, and scores the weighted mean of the passages' representations (attention
based multiple-instance learning).  Spark computes the passages' features and the scores over
whole texts; the network, some thousand weights, is fitted on a bounded sample of labelled rows.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .perplexity import line_spans
from .words import LOWER, Chunk, chunk_of, mix, slices, span_hashes, window_hashes

PASSAGE = 64
CLASSES = {
    "upper": [range(65, 91)],
    "lower": [range(97, 123)],
    "digit": [range(48, 58)],
    "high": [range(128, 256)],
    "symbol": [b"#*$%&<>"],
    "bar": [b"|"],
    "bang": [b"!?"],
    "stop": [b".,;:"],
    "other": [b"\"'()[]{}=+-_/\\@^~`"],
}
FEATURES = [*CLASSES, "word_length", "long_words", "distinct", "repeats", "same_next", "line_repeats", "breaks", "share", "size"]


def _rates(chunk: Chunk) -> np.ndarray:
    """Counts of byte classes in each word."""
    out = []
    for kinds in CLASSES.values():
        at = np.zeros(256, np.int64)
        for kind in kinds:
            at[list(kind)] = 1
        run = np.concatenate([[0], np.cumsum(at[chunk.buf])])
        out.append(run[chunk.end] - run[chunk.start])
    return np.array(out)


def passages(chunk: Chunk) -> tuple[np.ndarray, np.ndarray]:
    """Features of the passages (of ``PASSAGE`` words, the last one shorter) and their texts.

    Every text has one passage at least; one without words has the features of nothing.
    """
    n = len(chunk.off) - 1
    words = np.diff(chunk.ptr)
    count = np.maximum(1, -(-words // PASSAGE))
    doc = np.repeat(np.arange(n), count)
    number = np.arange(len(doc)) - np.repeat(np.cumsum(count) - count, count)
    begin = chunk.ptr[doc] + number * PASSAGE
    end = np.minimum(begin + PASSAGE, chunk.ptr[doc + 1])
    size = np.maximum(end - begin, 1).astype(np.float64)

    def mean(of_word: np.ndarray) -> np.ndarray:
        run = np.concatenate([[0.0], np.cumsum(of_word, dtype=np.float64)])
        return (run[end] - run[begin]) / size

    length = chunk.end - chunk.start
    lowered = span_hashes(LOWER[chunk.buf], chunk.start, chunk.end)
    of = chunk.doc
    passage = np.searchsorted(begin, np.arange(len(lowered)), "right") - 1 if len(lowered) else of
    # an empty text's passage begins where the next one does: the last of equal begins holds the words
    first, window = window_hashes(lowered, chunk.ptr, 3)
    _, back, times = np.unique(mix(window ^ mix(of[first].astype(np.uint64))), return_inverse=True, return_counts=True)
    repeats = np.zeros(len(lowered))
    repeats[first] = times[back] > 1
    _, one = np.unique(mix(lowered ^ mix(passage.astype(np.uint64) + np.uint64(7))), return_index=True)
    new = np.zeros(len(lowered))
    new[one] = 1
    same = np.zeros(len(lowered))
    same[1:] = (lowered[1:] == lowered[:-1]) & (of[1:] == of[:-1])
    start, stop, line_doc = line_spans(chunk)
    holds = np.searchsorted(chunk.start, stop) > np.searchsorted(chunk.start, start)
    start, stop, line_doc = start[holds], stop[holds], line_doc[holds]
    _, back, times = np.unique(mix(span_hashes(chunk.buf, start, stop) ^ mix(line_doc.astype(np.uint64))), return_inverse=True, return_counts=True)
    line = np.searchsorted(start, chunk.start, "right") - 1
    in_repeat = times[back][line] > 1 if len(start) else np.zeros(0)
    opens = np.zeros(len(lowered))
    opens[1:] = line[1:] != line[:-1]
    rates = _rates(chunk)
    chars = np.maximum(mean(length), 1e-9)
    rows = [mean(r) / chars for r in rates]
    rows += [np.log1p(mean(length)), mean(length > 12), mean(new), mean(repeats), mean(same), mean(in_repeat), mean(opens)]
    rows += [size / np.maximum(words[doc], 1), np.log1p(end - begin)]
    return np.array(rows).T, doc


@dataclass
class Network:
    """Weights of the encoder, the gated attention and the classifier, and the features' scale."""

    shift: np.ndarray
    scale: np.ndarray
    weights: dict[str, np.ndarray]


def _sigmoid(x: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(x, -30, 30)))


def forward(net: dict[str, np.ndarray], x: np.ndarray, bag: np.ndarray, n: int) -> dict[str, np.ndarray]:
    """Scores of n bags whose passages x lie one after another."""
    h = np.tanh(x @ net["enc"] + net["enc0"])
    t, g = np.tanh(h @ net["v"]), _sigmoid(h @ net["u"])
    logit = (t * g) @ net["w"]
    start = np.searchsorted(bag, np.arange(n))
    top = np.maximum.reduceat(logit, start)
    e = np.exp(logit - top[bag])
    a = e / np.add.reduceat(e, start)[bag]
    z = np.add.reduceat(a[:, None] * h, start, axis=0)
    return {"h": h, "t": t, "g": g, "a": a, "z": z, "p": _sigmoid(z @ net["c"] + net["c0"])}


def fit(x: np.ndarray, bag: np.ndarray, y: np.ndarray, *, width: int = 24, gate: int = 12, rounds: int = 300, rate: float = 0.01, decay: float = 1e-4, seed: int = 7) -> Network:
    """Gated attention by Adam on all bags at once; the same rows give the same network."""
    shift, scale = x.mean(0), x.std(0) + 1e-6
    x = np.clip((x - shift) / scale, -8, 8)
    rng = np.random.default_rng(seed)
    d, n = x.shape[1], len(y)
    net = {
        "enc": rng.normal(0, d**-0.5, (d, width)), "enc0": np.zeros(width), "v": rng.normal(0, width**-0.5, (width, gate)),
        "u": rng.normal(0, width**-0.5, (width, gate)), "w": rng.normal(0, gate**-0.5, gate), "c": np.zeros(width), "c0": np.zeros(1),
    }
    first = {k: np.zeros_like(v) for k, v in net.items()}
    second = {k: np.zeros_like(v) for k, v in net.items()}
    for step in range(1, rounds + 1):
        f = forward(net, x, bag, n)
        dz = (f["p"] - y) / n
        grad = {"c": f["z"].T @ dz, "c0": np.array([dz.sum()])}
        dpool = dz[:, None] * net["c"]
        da = (dpool[bag] * f["h"]).sum(1)
        start = np.searchsorted(bag, np.arange(n))
        dlogit = f["a"] * (da - np.add.reduceat(f["a"] * da, start)[bag])
        grad["w"] = (f["t"] * f["g"]).T @ dlogit
        dt = dlogit[:, None] * net["w"] * f["g"] * (1 - f["t"] ** 2)
        dg = dlogit[:, None] * net["w"] * f["t"] * f["g"] * (1 - f["g"])
        grad["v"], grad["u"] = f["h"].T @ dt, f["h"].T @ dg
        dh = f["a"][:, None] * dpool[bag] + dt @ net["v"].T + dg @ net["u"].T
        dpre = dh * (1 - f["h"] ** 2)
        grad["enc"], grad["enc0"] = x.T @ dpre, dpre.sum(0)
        for k, v in net.items():
            g = grad[k] + decay * v
            first[k] = 0.9 * first[k] + 0.1 * g
            second[k] = 0.999 * second[k] + 0.001 * g * g
            v -= rate * (first[k] / (1 - 0.9**step)) / (np.sqrt(second[k] / (1 - 0.999**step)) + 1e-8)
    return Network(shift, scale, net)


def score_rows(net: Network, chunk: Chunk) -> tuple[np.ndarray, np.ndarray]:
    x, doc = passages(chunk)
    n = len(chunk.off) - 1
    f = forward(net.weights, np.clip((x - net.shift) / net.scale, -8, 8), doc, n)
    start = np.searchsorted(doc, np.arange(n))
    return f["p"], np.maximum.reduceat(f["a"], start)


def training_sample(docs: DataFrame, labels: DataFrame, usable: Column, *, id_col: str, text_col: str, label_col: str, sample: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Passages, bags and labels of at most ``sample`` labelled documents, chosen by hash of the id.

    Ids with several labels count with the mean of these.
    """
    chosen = (
        labels.where(usable & F.col(id_col).isNotNull() & F.col(label_col).isNotNull())
        .groupBy(F.col(id_col).alias("id"))
        .agg(F.avg(label_col).alias("y"))
        .orderBy(F.xxhash64("id"), "id")
        .limit(sample)
    )
    texts = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"))

    def encode(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in slices(batches, "text"):
            x, doc = passages(chunk_of(part.column(2)))
            cut = pa.array((np.searchsorted(doc, np.arange(part.num_rows + 1)) * x.shape[1]).astype(np.int32))
            yield pa.RecordBatch.from_arrays([part.column(0), part.column(1), pa.ListArray.from_arrays(cut, pa.array(x.ravel()))], ["id", "y", "x"])

    kind = docs.schema[id_col].dataType.simpleString()
    # the sample is bounded by its parameter, and so is what is broadcast here
    rows = texts.join(F.broadcast(chosen), "id").select("id", "y", "text")
    got = rows.mapInArrow(encode, f"id {kind}, y double, x array<double>").toArrow()
    if not got.num_rows:
        return np.zeros((0, len(FEATURES))), np.zeros(0, np.int64), np.zeros(0)
    got = got.sort_by([("id", "ascending"), ("y", "ascending")])
    flat = [np.asarray(v).reshape(-1, len(FEATURES)) for v in got.column("x").to_pylist()]
    return np.concatenate(flat), np.repeat(np.arange(len(flat)), [len(v) for v in flat]), got.column("y").to_numpy()


def score_quality(
    docs: DataFrame,
    labels: DataFrame,
    *,
    usable: Column,
    id_col: str = "doc_id",
    text_col: str = "text",
    label_col: str = "quality",
    sample: int = 2000,
) -> DataFrame:
    """All columns of ``docs``, with ``score`` (how likely label 1 is), ``predicted`` (1 from 0.5) and
    ``attention`` (the largest weight of a passage), which replace input columns of these names.

    ``usable`` says of a row of ``labels`` whether it may be learnt from.  At most ``sample``
    documents are, the ones with the least hashes of their ids; every document is scored, over its
    whole text.  Nothing but the text goes into a score.  Null and empty texts are scored as a bag
    of one empty passage; rows with equal ids are scored each.  Without usable labels every score
    is 0.5.  An empty table gives an empty result.
    """
    x, bag, y = training_sample(docs, labels, usable, id_col=id_col, text_col=text_col, label_col=label_col, sample=sample)
    net = fit(x, bag, y) if len(y) else None
    made = ["score", "predicted", "attention"]

    def score(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in slices(batches, "text"):
            if net is None:
                p, top = np.full(part.num_rows, 0.5), np.ones(part.num_rows)
            else:
                p, top = score_rows(net, chunk_of(part.column(1)))
            made_ = [pa.array(p), pa.array((p >= 0.5).astype(np.int32)), pa.array(top)]
            yield pa.RecordBatch.from_arrays([part.column(0), *made_], ["row", *made])

    rows = docs.select(F.struct(*(F.col(f"`{c}`") for c in docs.columns)).alias("row"), F.col(text_col).alias("text"))
    result = T.StructType([rows.schema["row"]]).add("score", "double").add("predicted", "integer").add("attention", "double")
    out = rows.mapInArrow(score, result)
    return out.select(*(F.col(f"row.`{c}`") for c in docs.columns if c not in made), *made)


def held_out(id_col: str = "doc_id") -> Column:
    """Whether crc32 of the id as text leaves 1 on division by 3."""
    return F.crc32(F.col(id_col).cast("string").cast("binary")) % 3 == 1
