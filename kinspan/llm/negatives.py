"""Hard negatives by a two-dimensional block matrix product.

Anchors and rows are dealt to blocks, and vectors are cut into chunks of dimensions.  A task multiplies one block of
anchors by one block of rows over one chunk; Spark adds the partial 64-bit tiles of all chunks by shuffle, and the sum
of a tile is at once reduced to the few rows that can still be among the best of an anchor.  So a task holds one tile,
whose size is a parameter, and what is reduced grows with anchors times blocks.

Two products share the work, so that no pair is multiplied twice but for those of one label: positives need the anchors of a
label against that label's rows alone, negatives need all rows.  Blocks are dealt by a hash of the whole row,
and a label of any size is cut into as many blocks as it fills.
"""

from __future__ import annotations

import math
from collections.abc import Callable

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..plans.shared import cut

TILE = "part string, i long, j long, k int, anchor_id array<long>, anchor_key array<long>, anchor_label array<long>, wanted array<array<struct<id:long,score:long,place:long>>>, row_id array<long>, row_label array<long>, scores binary"
WANTED = "array<struct<id:bigint,score:bigint,place:bigint>>"
FOUND = "anchor_id long, anchor_key long, anchor_label long, positive_id long, positive_score long, place long, id long, score long"


def quantised(vector: str = "embedding", scale: int = 256) -> Column:
    """The vector as integers ``floor(scale * x)``; null where it or a component is null or not finite.

    Components beyond 2**55 or so leave the range of 64 bits, in which scores are added; ordinary embeddings are far from it.
    """
    v = F.col(vector)
    fine = F.forall(v, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < F.lit(float("inf"))))
    return F.when(fine, F.transform(v, lambda x: F.floor(F.lit(scale) * x.cast("double"))))


def _matrix(column: pa.ChunkedArray, width: int) -> np.ndarray:
    """Chunks of vectors as rows; those that end early are filled up with 0."""
    lists = column.combine_chunks()
    lists = lists.chunk(0) if isinstance(lists, pa.ChunkedArray) else lists
    flat, size = lists.flatten().to_numpy(zero_copy_only=False), np.diff(lists.offsets.to_numpy())
    out = np.zeros((len(size), width), np.int64)
    out[np.arange(width) < size[:, None]] = flat
    return out


def product(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """``a @ b.T`` of integers, exactly: as doubles where no sum can pass 2**53, else as integers modulo 2**64."""
    if not a.size or not b.size:
        return np.zeros((len(a), len(b)), np.int64)
    most = max(abs(int(a.min())), abs(int(a.max()))) * max(abs(int(b.min())), abs(int(b.max()))) * a.shape[1]
    return (a.astype(float) @ b.T.astype(float)).astype(np.int64) if most < 1 << 53 else a @ b.T


def _partial(width: int) -> Callable[[pa.Table], pa.Table]:
    """One block of anchors times one block of rows over one chunk of dimensions."""
    schema_of = [("part", pa.string()), ("i", pa.int64()), ("j", pa.int64()), ("k", pa.int32())]
    longs, wanted = pa.list_(pa.int64()), pa.list_(pa.list_(pa.struct([("id", pa.int64()), ("score", pa.int64()), ("place", pa.int64())])))
    lists = [("anchor_id", longs), ("anchor_key", longs), ("anchor_label", longs), ("wanted", wanted), ("row_id", longs), ("row_label", longs)]
    schema = pa.schema([*schema_of, *lists, ("scores", pa.binary())])

    def run(group: pa.Table) -> pa.Table:
        # the same order in every chunk: rows differ in id, label or key
        group = group.sort_by([("id", "ascending"), ("label", "ascending"), ("key", "ascending")])
        anchors, rows = group.filter(pc.field("anchor")), group.filter(~pc.field("anchor"))
        if not anchors.num_rows or not rows.num_rows:
            return schema.empty_table()
        scores = product(_matrix(anchors["v"], width), _matrix(rows["v"], width))
        names = {"anchor_id": anchors["id"], "anchor_key": anchors["key"], "anchor_label": anchors["label"], "wanted": anchors["wanted"], "row_id": rows["id"], "row_label": rows["label"]}
        one = {c: [group[c][0].as_py()] for c, _ in schema_of} | {c: [x.to_pylist()] for c, x in names.items()} | {"scores": [scores.tobytes()]}
        return pa.table(one, schema=schema)

    return run


def _reduce(most: int, low: int, high: int, positives: bool) -> Callable[[pa.Table], pa.Table]:
    """The tiles of all chunks added, and of the sum the ``most`` best rows of each anchor, or of each of its positives."""
    names = ["anchor_id", "anchor_key", "anchor_label", "positive_id", "positive_score", "place", "id", "score"]

    def run(group: pa.Table) -> pa.Table:
        one = {c: group[c][0].as_py() for c in ("anchor_id", "anchor_key", "anchor_label", "wanted", "row_id", "row_label")}
        ids, labels = np.array(one["row_id"], np.int64), np.array(one["row_label"], np.int64)
        total = np.zeros((len(one["anchor_id"]), len(ids)), np.int64)
        for tile in group["scores"]:
            total += np.frombuffer(tile.as_buffer(), np.int64).reshape(total.shape)
        found: list[list[np.ndarray]] = []
        for at, (a, key, label) in enumerate(zip(one["anchor_id"], one["anchor_key"], one["anchor_label"])):
            fits = (labels == label) & (ids != a) if positives else labels != label
            # rows stand by id, so that a stable sort leaves ties in their order
            pick = np.flatnonzero(fits)
            pick = pick[np.argsort(-total[at, pick], kind="stable")]
            score = total[at, pick]
            if positives:
                found.append([np.full(len(pick[:most]), x) for x in (a, key, label, 0, 0, 0)] + [ids[pick[:most]], score[:most]])
                continue
            for p in one["wanted"][at]:
                # scores fall, so those within the window stand together
                first, last = np.searchsorted(-100 * score, -high * p["score"], "left"), np.searchsorted(-100 * score, -low * p["score"], "right")
                take = slice(int(first), int(min(max(first, last), first + most)))
                found.append([np.full(len(pick[take]), x) for x in (a, key, label, p["id"], p["score"], p["place"])] + [ids[pick[take]], score[take]])
        columns = [np.concatenate(x).astype(np.int64) for x in zip(*found)] if found else [np.zeros(0, np.int64)] * len(names)
        return pa.table(columns, names=names)

    return run


def _tiles(rows: DataFrame, width: int, chunks: int, reduce_: Callable[[pa.Table], pa.Table]) -> DataFrame:
    """Blocks cut into chunks, multiplied, added and reduced."""
    pieces = F.transform(F.sequence(F.lit(0), F.lit(chunks - 1)), lambda k: F.slice("v", k * width + 1, F.lit(width)))
    cells = rows.select("part", "i", "j", "anchor", "id", "key", "label", "wanted", F.posexplode(pieces).alias("k", "v"))
    partial = cells.groupBy("part", "i", "j", "k").applyInArrow(_partial(width), TILE)
    return partial.groupBy("part", "i", "j").applyInArrow(reduce_, FOUND)


def mine_hard_negatives(
    rows: DataFrame,
    is_anchor: Column,
    *,
    positives: int = 5,
    negatives: int = 5,
    low: int = 80,
    high: int = 100,
    anchor_rows: int = 512,
    block_rows: int = 2048,
    chunk: int = 32,
) -> DataFrame:
    """``anchor_id, positive_id, rank, negative_id, positive_score, negative_score`` from ``id, label, v`` (arrays of integers).

    A score is the inner product with the anchor.  An anchor's positives are the ``positives`` best other rows of its
    label; for each of them, its negatives are the ``negatives`` best rows of other labels with
    ``low * positive_score <= 100 * negative_score <= high * positive_score``.  Ties go by smaller id.  Fewer are
    returned where there are fewer: an anchor without positives, and a positive without negatives, have no row.

    Rows with a null id, label, vector or component take no part.  Rows that repeat another in id, label and vector count
    once; rows of one id with other labels or vectors are rows of their own, but none is a positive of an anchor of
    its id.  Shorter vectors are filled up with 0.  Other columns are ignored; an empty table gives an empty result.

    Tiles have ``anchor_rows`` times ``block_rows`` scores, of ``chunk`` dimensions each before they are added.
    """
    fine = F.col("id").isNotNull() & F.col("label").isNotNull() & F.coalesce(F.forall("v", lambda x: x.isNotNull()), F.lit(False))
    clean = rows.where(fine).select(F.col("id").cast("long").alias("id"), F.col("label").cast("long").alias("label"), F.col("v").cast("array<long>").alias("v"), F.coalesce(is_anchor, F.lit(False)).alias("a"))
    clean = cut(clean.distinct().withColumn("key", F.xxhash64("label", "v")))
    counts = clean.groupBy("label").agg(F.count("*").alias("n"), F.count_if("a").alias("n_a"), F.max(F.size("v")).alias("d"))
    counts = cut(counts)
    whole = counts.agg(F.sum("n").alias("n"), F.sum("n_a").alias("n_a"), F.max("d").alias("d")).first()
    chunks = max(1, math.ceil((whole["d"] or 0) / chunk))
    blocks = lambda n, size: F.greatest(F.ceil(n / F.lit(size)), F.lit(1)).cast("long")
    none = F.lit(None).cast(WANTED)
    deal = F.xxhash64("key", "id")

    def dealt(frame: DataFrame, anchors: DataFrame, part: Column, i: Column, j: Column) -> DataFrame:
        """Anchors, copied to each block of rows, and rows, copied to each block of anchors, of their part."""
        each = lambda n: F.explode(F.sequence(F.lit(0).cast("long"), n - 1))
        common = [part.alias("part"), "id", "key", "label", "v"]
        a = anchors.select(*common, F.lit(True).alias("anchor"), "wanted", F.pmod(deal, i).alias("i"), each(j).alias("j"))
        b = frame.select(*common, F.lit(False).alias("anchor"), none.alias("wanted"), F.pmod(deal, j).alias("j"), each(i).alias("i"))
        return a.unionByName(b)

    sized = clean.join(counts.where("n_a > 0").drop("d"), "label")
    same = dealt(sized, sized.where("a").withColumn("wanted", none), F.col("label").cast("string"), blocks(F.col("n_a"), anchor_rows), blocks(F.col("n"), block_rows))
    best = _tiles(same, chunk, chunks, _reduce(positives, low, high, True))
    order = Window.partitionBy("anchor_id", "anchor_key").orderBy(F.desc("score"), "id")
    best = best.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= positives)
    of_anchor = best.groupBy(F.col("anchor_id").alias("__a"), F.col("anchor_key").alias("key"))
    wanted = of_anchor.agg(F.collect_list(F.struct("id", "score", F.col("rank").cast("long").alias("place"))).alias("wanted"))  # few an anchor
    wanted = wanted.withColumnRenamed("__a", "id")
    anchors = clean.where("a").join(wanted, ["id", "key"])
    all_i, all_j = (F.lit(max(1, math.ceil((n or 0) / size))).cast("long") for n, size in ((whole["n_a"], anchor_rows), (whole["n"], block_rows)))
    found = _tiles(dealt(clean, anchors, F.lit(""), all_i, all_j), chunk, chunks, _reduce(negatives, low, high, False))
    order = Window.partitionBy("anchor_id", "anchor_key", "place").orderBy(F.desc("score"), "id")
    ranked = found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= negatives)
    return ranked.select("anchor_id", "positive_id", "rank", F.col("id").alias("negative_id"), "positive_score", F.col("score").alias("negative_score"))
