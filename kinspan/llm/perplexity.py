"""Quality rules: counts over words and lines, and bands of n-gram perplexity by language.

The n-grams are of five bytes, over a text's words joined by single spaces, so that a gram is
an exact 40-bit key and a language's inventory grows slowly.  Spark counts them over every
text; the modified Kneser-Ney estimate is made of joins and groupings of the counts; tasks
score with sorted key arrays, or with a join where the model is over the size for arrays.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..plans.shared import fresh_folder
from .words import Chunk, chunk_of, covered, mix, slices, span_hashes, window_hashes

ORDER = 5
GRAM = np.uint64((1 << 40) - 1)
SYMBOL = np.zeros(256, bool)
SYMBOL[list(b"#*$%&|<>")] = True


def per_text(chunk: Chunk, at: np.ndarray, weight: np.ndarray | None = None) -> np.ndarray:
    """Sums of weights (or counts) of byte positions, by text."""
    run = np.concatenate([[0], np.cumsum(np.ones(len(at), np.int64) if weight is None else weight)])
    return np.diff(run[np.searchsorted(at, chunk.off)])


def line_spans(chunk: Chunk) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Starts, ends and texts of the \\n-split lines."""
    breaks = np.flatnonzero(chunk.buf == 10)
    start = np.sort(np.concatenate([chunk.off[:-1], breaks + 1]))
    end = np.sort(np.concatenate([chunk.off[1:], breaks]))
    return start, end, np.repeat(np.arange(len(chunk.off) - 1), 1 + per_text(chunk, breaks))


def base_counts(chunk: Chunk) -> dict[str, np.ndarray]:
    """The counts of the base rules for each text."""
    n = len(chunk.off) - 1
    lead = (chunk.buf & 0xC0) != 0x80
    inside = np.zeros(len(chunk.buf) + 1, np.int8)
    inside[chunk.start] += 1
    inside[chunk.end] -= 1
    chars = np.flatnonzero((np.cumsum(inside[:-1]) > 0) & lead)
    start, end, doc = line_spans(chunk)
    worded = np.searchsorted(chunk.start, end) > np.searchsorted(chunk.start, start)
    start, end, doc = start[worded], end[worded], doc[worded]
    order = np.lexsort((line := span_hashes(chunk.buf, start, end), doc))
    again = (np.diff(line[order]) == 0) & (np.diff(doc[order]) == 0)
    dup_lines = np.bincount(doc[order][1:][again], minlength=n)
    words = span_hashes(chunk.buf, chunk.start, chunk.end)
    first, window = window_hashes(words, chunk.ptr, 3)
    of = chunk.doc
    _, back, times = np.unique(mix(window ^ mix(of[first].astype(np.uint64) + np.uint64(1))), return_inverse=True, return_counts=True)
    hit = covered(len(words), first[times[back] > 1], 3) if len(first) else np.zeros(len(words), bool)
    return {
        "n_words": np.diff(chunk.ptr),
        "word_chars": per_text(chunk, chars),
        "n_symbols": per_text(chunk, np.flatnonzero(SYMBOL[chunk.buf])),
        "n_dup_lines": dup_lines,
        "n_repeat_words": np.bincount(of[hit], minlength=n),
    }


def grams(chunk: Chunk) -> tuple[np.ndarray, np.ndarray]:
    """Keys of all five-byte grams and the texts they end in: the words joined by one space,
    after four spaces and before one."""
    size = chunk.end - chunk.start
    n = len(chunk.off) - 1
    doc = chunk.doc
    length = np.bincount(doc, size + 1, minlength=n).astype(np.int64)
    stream = np.full(int(length.sum()) + 4 * n, 32, np.uint8)
    before = np.cumsum(size) - size
    to = 4 * (doc + 1) + before + np.arange(len(size))
    at = np.arange(int(size.sum())) + np.repeat(chunk.start - before, size)
    stream[np.arange(len(at)) + np.repeat(to - before, size)] = chunk.buf[at]
    if len(stream) < ORDER:
        return np.zeros(0, np.uint64), np.zeros(0, np.int64)
    key = np.zeros(len(stream) - 4, np.uint64)
    for i in range(ORDER):
        key = (key << np.uint64(8)) | stream[i : len(stream) - 4 + i]
    real = np.ones(len(stream), bool)
    pads = np.cumsum(length + 4) - (length + 4)
    real[(pads[:, None] + np.arange(4)).ravel()] = False
    return key[real[4:]], np.repeat(np.arange(n), length)


def counted(key: np.ndarray, group: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Group, gram and count of the distinct grams of each group (under 2**23 groups)."""
    both, count = np.unique((group.astype(np.uint64) << np.uint64(40)) | key, return_counts=True)
    return (both >> np.uint64(40)).astype(np.int64), (both & GRAM).astype(np.int64), count


def count_grams(docs: DataFrame, lang_col: str, text_col: str) -> DataFrame:
    """``lang, gram, c``: tasks count within slices of text, Spark adds up."""

    def count(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in slices(batches, "text", 1 << 20):
            key, doc = grams(chunk_of(part.column(1)))
            named = part.column(0).dictionary_encode()
            group, gram, c = counted(key, named.indices.to_numpy()[doc])
            langs = named.dictionary.take(pa.array(group))
            yield pa.RecordBatch.from_arrays([langs.cast(pa.string()), pa.array(gram), pa.array(c)], ["lang", "gram", "c"])

    rows = docs.select(F.coalesce(F.col(lang_col).cast("string"), F.lit("")).alias("lang"), F.col(text_col).alias("text"))
    return rows.mapInArrow(count, "lang string, gram long, c long").groupBy("lang", "gram").agg(F.sum("c").alias("c"))


def small(df: DataFrame, rows: int = 10_000) -> DataFrame:
    """The table marked for a broadcast if it has at most so many rows, as it is otherwise."""
    return F.broadcast(df) if df.limit(rows + 1).count() <= rows else df


def kneser_ney(counts: DataFrame, folder: str) -> DataFrame:
    """``lang, gram, logp`` of the modified Kneser-Ney estimate for every counted gram.

    Below the highest order the count of a gram is the number of distinct bytes before it;
    the three discounts of each order and language come of its counts of counts, and are
    held to [0, k] where those are too few; the lowest order falls back on 1/256.  Each order's
    counts and estimates are written below ``folder``, so that no plan holds more than one order.
    """

    def kept(df: DataFrame, name: str) -> DataFrame:
        df.write.parquet(f"{folder}/{name}")
        return df.sparkSession.read.schema(df.schema).parquet(f"{folder}/{name}")

    orders = {ORDER: counts}
    for n in range(ORDER - 1, 0, -1):
        gram = F.expr(f"gram & {(1 << 8 * n) - 1}").alias("gram")
        orders[n] = kept(orders[n + 1].groupBy("lang", gram).agg(F.count("*").alias("c")), f"counts-{n}")
    lower = None
    for n in range(1, ORDER + 1):
        own = orders[n]
        n1, n2, n3, n4 = (F.count_if(F.col("c") == i).cast("double") for i in range(1, 5))
        y = n1 / F.nullif(n1 + 2 * n2, F.lit(0.0))
        discount = lambda k, a, b, y=y: F.least(F.greatest(F.coalesce(k - (k + 1) * y * b / F.nullif(a, F.lit(0.0)), F.lit(k / 2)), F.lit(0.0)), F.lit(float(k)))
        of_lang = own.groupBy("lang").agg(discount(1, n1, n2).alias("d1"), discount(2, n2, n3).alias("d2"), discount(3, n3, n4).alias("d3"))
        context = ["lang", "context"]
        own = own.withColumn("context", F.shiftright("gram", 8) if n > 1 else F.lit(0).cast("long"))
        ones, twos = F.count_if(F.col("c") == 1), F.count_if(F.col("c") == 2)
        of_context = own.groupBy(context).agg(
            F.sum("c").alias("total"), ones.alias("ones"), twos.alias("twos"), (F.count("*") - ones - twos).alias("more")
        )
        joined = own.join(of_context, context).join(small(of_lang), "lang")
        if lower is None:
            joined = joined.withColumn("below", F.lit(1 / 256))
        else:
            joined = joined.withColumn("tail", F.expr(f"gram & {(1 << 8 * (n - 1)) - 1}")).join(lower, ["lang", "tail"])
        taken = F.when(F.col("c") == 1, F.col("d1")).when(F.col("c") == 2, F.col("d2")).otherwise(F.col("d3"))
        spread = F.col("d1") * F.col("ones") + F.col("d2") * F.col("twos") + F.col("d3") * F.col("more")
        p = (F.greatest(F.col("c") - taken, F.lit(0.0)) + spread * F.col("below")) / F.col("total")
        p = kept(joined.select("lang", "gram", p.alias("p")), f"estimates-{n}")
        lower = p.select("lang", F.col("gram").alias("tail"), F.col("p").alias("below"))
    return p.select("lang", "gram", F.log("p").alias("logp"))


STATS = "n_words long, word_chars long, n_symbols long, n_dup_lines long, n_repeat_words long"


def _named(docs: DataFrame, id_col: str, lang_col: str, text_col: str) -> DataFrame:
    return docs.select(
        F.col(id_col).alias("id"), F.coalesce(F.col(lang_col).cast("string"), F.lit("")).alias("lang"), F.col(text_col).alias("text")
    )


def score_with_arrays(rows: DataFrame, model: DataFrame) -> DataFrame:
    """Counts, grams and log probabilities of each text, by sorted arrays sent to all executors."""
    held = model.select("lang", "gram", "logp").orderBy("lang", "gram").toArrow()
    names = held.column("lang").combine_chunks().dictionary_encode()
    names = names.combine_chunks() if isinstance(names, pa.ChunkedArray) else names
    cut = np.flatnonzero(np.diff(names.indices.to_numpy(), prepend=-1)).tolist() + [held.num_rows]
    gram, logp = held.column("gram").to_numpy(), held.column("logp").to_numpy()
    arrays = {str(names.dictionary[i]): (gram[a:b].copy(), logp[a:b].copy()) for i, (a, b) in enumerate(zip(cut, cut[1:], strict=False))}
    sent = rows.sparkSession.sparkContext.broadcast(arrays)

    def score(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in slices(batches, "text", 1 << 20):
            chunk = chunk_of(part.column(2))
            base = base_counts(chunk)
            key, doc = grams(chunk)
            doc_of, gram, count = counted(key, doc)
            total = np.zeros(part.num_rows)
            named = part.column(1).dictionary_encode()
            lang_of = named.indices.to_numpy()[doc_of]
            for i, lang in enumerate(named.dictionary.to_pylist()):
                mine = lang_of == i
                keys, logs = sent.value[lang] if mine.any() else (gram[:0], total[:0])
                if len(keys):
                    total += np.bincount(doc_of[mine], count[mine] * logs[np.searchsorted(keys, gram[mine])], minlength=part.num_rows)
            n = np.bincount(doc, minlength=part.num_rows)
            yield pa.RecordBatch.from_arrays(
                [part.column(0), part.column(1), *(pa.array(x.astype(np.int64)) for x in base.values()), pa.array(n.astype(np.int64)), pa.array(total)],
                ["id", "lang", *base, "n_grams", "logp"],
            )

    return rows.mapInArrow(score, f"id {rows.schema['id'].dataType.simpleString()}, lang string, {STATS}, n_grams long, logp double")


def score_with_join(rows: DataFrame, model: DataFrame, folder: str) -> DataFrame:
    """The same by a join of each text's distinct grams with the model, whatever its size."""

    def count(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        task, done = TaskContext.get().partitionId(), 0
        for part in slices(batches, "text", 1 << 20):
            chunk = chunk_of(part.column(2))
            base = base_counts(chunk)
            key, doc = grams(chunk)
            doc_of, gram, c = counted(key, doc)
            cut = pa.array(np.searchsorted(doc_of, np.arange(part.num_rows + 1)).astype(np.int32))
            row = pa.array((task << 40) + done + np.arange(part.num_rows))
            done += part.num_rows
            n = np.bincount(doc, minlength=part.num_rows)
            yield pa.RecordBatch.from_arrays(
                [row, part.column(0), part.column(1), *(pa.array(x.astype(np.int64)) for x in base.values()), pa.array(n.astype(np.int64)),
                 pa.ListArray.from_arrays(cut, pa.array(gram)), pa.ListArray.from_arrays(cut, pa.array(c.astype(np.int64)))],
                ["row", "id", "lang", *base, "n_grams", "gram", "c"],
            )

    kind = rows.schema["id"].dataType.simpleString()
    rows.mapInArrow(
        count, f"row long, id {kind}, lang string, {STATS}, n_grams long, gram array<long>, c array<long>"
    ).write.parquet(f"{folder}/grams")
    held = rows.sparkSession.read.parquet(f"{folder}/grams")
    pairs = held.select("row", "lang", F.explode(F.arrays_zip("gram", "c")).alias("x")).select("row", "lang", "x.gram", "x.c")
    sums = pairs.join(model, ["lang", "gram"]).groupBy("row").agg(F.sum(F.col("c") * F.col("logp")).alias("logp"))
    return held.drop("gram", "c").join(sums, "row", "left").drop("row").withColumn("logp", F.coalesce("logp", F.lit(0.0)))


def bands(scored: DataFrame, *, low: float, high: float, spread: float) -> DataFrame:
    """``lang, lower, upper`` of log perplexity over the texts that pass the base rules.

    Quantiles are exact at a resolution of 1/1000, from a histogram by language: ``lower`` lies
    ``spread`` quartile distances below the first quartile (``low``), ``upper`` as far above the third.
    """
    hist = (
        scored.where("NOT base_failed AND log_perplexity IS NOT NULL")
        .groupBy("lang", F.round(F.col("log_perplexity") * 1000).cast("long").alias("x"))
        .agg(F.count("*").alias("n"))
    )
    run = hist.selectExpr("lang", "x", "sum(n) OVER (PARTITION BY lang ORDER BY x) AS up_to", "sum(n) OVER (PARTITION BY lang) AS total")
    at = lambda q: F.min(F.when(F.col("up_to") >= F.lit(q) * F.col("total"), F.col("x"))) / 1000
    q = run.groupBy("lang").agg(at(low).alias("a"), at(high).alias("b"))
    width = F.greatest(F.col("b") - F.col("a"), F.lit(0.01)) * spread
    return q.select("lang", (F.col("a") - width).alias("lower"), (F.col("b") + width).alias("upper"))


def judge(
    docs: DataFrame,
    *,
    id_col: str = "doc_id",
    lang_col: str = "lang",
    text_col: str = "text",
    low: float = 0.25,
    high: float = 0.75,
    spread: float = 1.5,
    array_rows: int = 8_000_000,
) -> DataFrame:
    """Base rules and perplexity bands for every document.

    Result, a row per input row: the id, ``lang``, ``n_words, word_chars, n_symbols, n_dup_lines,
    n_repeat_words, base_failed, perplexity, lower, upper, kept``.  A model of up to
    ``array_rows`` grams is sent to the executors as sorted arrays (16 bytes a gram); a larger one
    is joined.  Both have the same double logarithms, and a text's mean is rounded to 9 decimals, as
    the order of a sum is not fixed: results do not depend on the way taken.  Null texts count as empty: they have no perplexity and fail the base rules.  A
    null language is a language of its own, named by the empty string.  Rows with equal ids are
    judged each; further columns are left out; an empty table gives an empty result.  The default
    ``spread`` is chosen on labelled junk caught against clean documents lost (see the README).
    """
    folder = fresh_folder(docs.sparkSession, "perplexity")
    read = docs.sparkSession.read.parquet
    count_grams(docs, lang_col, text_col).write.parquet(f"{folder}/counts")
    model = kneser_ney(read(f"{folder}/counts"), folder)
    rows = _named(docs, id_col, lang_col, text_col)
    n = model.count()
    scored = score_with_arrays(rows, model) if 0 < n <= array_rows else score_with_join(rows, model, folder)
    failed = (F.col("n_words") < 50) | (100 * F.col("n_repeat_words") > 50 * F.col("n_words"))
    scored.withColumn("base_failed", failed).withColumn(
        "log_perplexity", F.when(F.col("n_grams") > 0, F.round(-F.col("logp") / F.col("n_grams"), 9))
    ).write.parquet(f"{folder}/scored")
    scored = read(f"{folder}/scored")
    bounds = small(bands(scored, low=low, high=high, spread=spread))
    inside = F.col("log_perplexity").between(F.col("lower"), F.col("upper"))
    return scored.join(bounds, "lang", "left").select(
        F.col("id").alias(id_col), "lang", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed",
        F.exp("log_perplexity").alias("perplexity"), F.exp("lower").alias("lower"), F.exp("upper").alias("upper"),
        F.when(F.col("base_failed"), F.lit(False)).otherwise(F.coalesce(inside, F.lit(False))).alias("kept"),
    )
