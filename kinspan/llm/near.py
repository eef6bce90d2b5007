"""Near-duplicate groups by HyperMinHash registers, confirmed on full shingle sets.

A text's set of word shingles is hashed by m functions; register j keeps, of the least value of
the j-th function, the count of leading zeros (6 bits) and the 10 bits after the first one.  (Each
register has a function of its own rather than a share of one function's values, so that sets
smaller than the number of registers fill them all and lose no link.)  Bands of r registers put
sets into buckets; within a bucket the share of equal registers, corrected for registers that
agree by chance, estimates the Jaccard coefficient and drops pairs that cannot be links.  What is
left joins into clusters, inside which full sets decide.

No stage makes all pairs of a group.  Copies are one class from the start.  Buckets give spanning
forests of likely pairs; a large one is dealt into blocks, each with the bucket's first member.  The
likely pairs are confirmed on full sets, which leaves most clusters connected.  Only where a cluster
is left with several trees are its members compared again: those outside its largest tree with all.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..plans.components import components
from ..plans.shared import fresh_folder
from .repeats import runs
from .words import Chunk, chunk_of, mix, sequence_hashes, slices, span_hashes, window_hashes

MANTISSA = 10
SMALL_RUN = 8


def banding(threshold: float, miss: float = 1e-6, most: int = 256) -> tuple[int, int]:
    """Bands and rows: the longest rows at which a pair at the threshold is missed with probability
    ``miss`` at most, within ``most`` registers."""
    best = (1, 1)
    for rows in range(1, 17):
        share = threshold**rows
        bands = 1 if share >= 1 else math.ceil(math.log(miss) / math.log1p(-share))
        if bands * rows <= most:
            best = (bands, rows)
    return best


def shingle_sets(chunk: Chunk, size: int) -> tuple[np.ndarray, np.ndarray]:
    """Sorted distinct shingle hashes of each text, and where each text's begin (n + 1 places)."""
    low = chunk.lower()
    words = span_hashes(low.buf, low.start, low.end)
    first, window = window_hashes(words, low.ptr, size)
    n = len(low.off) - 1
    count = np.diff(low.ptr)
    cut = np.searchsorted(first, low.ptr)
    short = np.flatnonzero((count > 0) & (count < size))
    whole = sequence_hashes(words, low.ptr[short], count[short])
    at = dict(zip(short.tolist(), whole, strict=True))
    sets = [np.array([at[i]], np.uint64) if i in at else np.unique(window[cut[i] : cut[i + 1]]) for i in range(n)]
    size_ = np.fromiter(map(len, sets), np.int64, n)
    return np.concatenate(sets) if n else window, np.concatenate([[0], np.cumsum(size_)])


def registers(values: np.ndarray, start: np.ndarray, m: int, seed: int = 11) -> np.ndarray:
    """The HyperMinHash registers (rows of m) of the non-empty sets that begin at ``start``."""
    rng = np.random.RandomState(seed)
    a = rng.randint(0, 2**62, m, dtype=np.int64).astype(np.uint64) * np.uint64(2) + np.uint64(1)
    b = rng.randint(0, 2**62, m, dtype=np.int64).astype(np.uint64) * np.uint64(4)
    least = np.empty((m, len(start)), np.uint64)
    for j in range(m):
        least[j] = np.minimum.reduceat(values * a[j] + b[j], start)
    top = (least >> np.uint64(11)).astype(np.float64)
    zeros = np.where(top > 0, 53 - np.frexp(top)[1], 53).astype(np.uint64)
    after = (least << (zeros + np.uint64(1))) >> np.uint64(64 - MANTISSA)
    return ((zeros << np.uint64(MANTISSA)) | after).astype(np.uint16).T


def chance(n: np.ndarray, k: np.ndarray) -> np.ndarray:
    """How often registers of disjoint sets of n and k elements agree: the sum over the leading-zero
    counts of (cell width) x the density with which both minima fall there."""
    total = (n + k).astype(np.float64)
    out = np.zeros(len(total))
    for zeros in range(54):
        lower, upper = 2.0 ** -(zeros + 1), 2.0**-zeros
        out += lower * 2.0**-MANTISSA * (np.exp(-total * lower) - np.exp(-total * upper))
    return out * n * k / total


def estimate(equal: np.ndarray, n: np.ndarray, k: np.ndarray) -> np.ndarray:
    """Jaccard coefficient from the share of equal registers, corrected for chance."""
    by_chance = chance(n, k)
    return (equal - by_chance) / (1 - by_chance)


def forest(root: np.ndarray, near: Callable[[int], np.ndarray], ask: list[int], main: int) -> tuple[np.ndarray, np.ndarray]:
    """Edges that join the trees ``root`` along the neighbours ``near(i)`` of those asked, and the trees then.

    One that has by then joined the tree of ``main`` is not asked again: a pair of trees that are both apart
    from that one has been looked at from one side, if all outside it are asked.
    """
    root = root.copy()
    edges = []
    for turn, i in enumerate(ask):
        if turn and main >= 0 and root[i] == root[main]:
            continue
        for j in near(i).tolist():
            if root[i] != root[j]:
                edges.append((i, j))
                root[root == root[j]] = root[i]
    return np.array(edges, np.int64).reshape(-1, 2), root


def band_rows(batches: Iterable[pa.RecordBatch], bands: int, rows: int) -> Iterator[pa.RecordBatch]:
    """A row for each band of each class: the band's key and the class."""
    factors = mix(np.arange(1, bands * rows + 1, dtype=np.uint64)).reshape(bands, rows)
    for batch in batches:
        for at in range(0, batch.num_rows, 4096):
            part = batch.slice(at, 4096)
            regs = np.frombuffer(b"".join(part.column(1).to_pylist()), np.uint16).reshape(-1, bands, rows)
            key = mix((mix(regs.astype(np.uint64) + np.uint64(1)) * factors).sum(axis=2, dtype=np.uint64) + np.arange(bands, dtype=np.uint64))
            rep = np.repeat(part.column(0).to_numpy(), bands)
            yield pa.RecordBatch.from_arrays([pa.array(key.ravel().view(np.int64)), pa.array(rep)], ["key", "rep"])


EDGES = "a long, b long, weak boolean"


def likely_edges(table: pa.Table, cut: float) -> pa.Table:
    """Of each block of a bucket, a forest of the pairs whose estimate reaches ``cut``.

    Where a bucket has several blocks, trees without its first member (``hub``) get a weak edge to it,
    which puts them into one cluster but says nothing of likeness.
    """
    table = table.sort_by([("key", "ascending"), ("block", "ascending"), ("rep", "ascending")])
    key, block = table.column("key").to_numpy(), table.column("block").to_numpy()
    rep, n, hub = (table.column(c).to_numpy() for c in ("rep", "n", "hub"))
    split = table.column("blocks").to_numpy() > 1
    regs = np.frombuffer(b"".join(table.column("regs").to_pylist()), np.uint16).reshape(len(rep), -1)
    at = np.flatnonzero(np.concatenate([[True], (key[1:] != key[:-1]) | (block[1:] != block[:-1])]))
    size = np.diff(np.append(at, len(key)))
    small = (size <= SMALL_RUN) & ~split[at]
    a, b, weak = [], [], []
    for k in np.unique(size[(size > 1) & small]).tolist():
        i, j = np.triu_indices(k, 1)
        begin = at[small & (size == k)]
        for some in np.array_split(begin, max(1, len(begin) * len(i) // 20_000)):
            x, y = (some[:, None] + i).ravel(), (some[:, None] + j).ravel()
            good = estimate((regs[x] == regs[y]).mean(1), n[x], n[y]) >= cut
            a.append(rep[x[good]])
            b.append(rep[y[good]])
            weak.append(np.zeros(int(good.sum()), bool))
    for begin, k in zip(at[~small].tolist(), size[~small].tolist(), strict=True):
        r, m, reps = regs[begin : begin + k], n[begin : begin + k], rep[begin : begin + k]
        typical = np.array([np.bincount(c).argmax() for c in r.T], np.uint16)
        first = int((r == typical).sum(1).argmax())
        near = lambda i, r=r, m=m: np.flatnonzero(estimate((r == r[i]).mean(1), m, np.full(len(m), m[i])) >= cut)
        edges, root = forest(np.arange(k), near, [first, *range(k)], first)
        a.append(reps[edges[:, 0]])
        b.append(reps[edges[:, 1]])
        weak.append(np.zeros(len(edges), bool))
        if split[begin]:
            center = int(np.searchsorted(reps, hub[begin]))
            loose = np.unique(root[root != root[center]], return_index=True)[0]
            a.append(np.full(len(loose), hub[begin]))
            b.append(reps[loose])
            weak.append(np.ones(len(loose), bool))
    none = np.zeros(0, np.int64)
    a, b, weak = np.concatenate([none, *a]), np.concatenate([none, *b]), np.concatenate([none.astype(bool), *weak])
    return pa.table({"a": pa.array(a, pa.int64()), "b": pa.array(b, pa.int64()), "weak": pa.array(weak, pa.bool_())})


def confirmed(batches: Iterable[pa.RecordBatch], percent: int) -> Iterator[pa.RecordBatch]:
    """The pairs whose full sets (sorted hashes) are linked: 100 * intersection >= percent * union."""
    for batch in batches:
        a, b, one, two = (batch.column(i) for i in range(4))
        keep = np.zeros(batch.num_rows, bool)
        for i, (x, y) in enumerate(zip(one.to_pylist(), two.to_pylist(), strict=True)):
            x, y = np.frombuffer(x, np.uint64), np.frombuffer(y, np.uint64)
            if 100 * min(len(x), len(y)) >= percent * max(len(x), len(y)):
                both = len(np.intersect1d(x, y, assume_unique=True))
                keep[i] = 100 * both >= percent * (len(x) + len(y) - both)
        keep = pa.array(keep)
        yield pa.RecordBatch.from_arrays([a.filter(keep), b.filter(keep)], ["a", "b"])


def exact_edges(table: pa.Table, percent: int) -> pa.Table:
    """Links between different trees among the sets of one task; ``asked`` sets are compared with all."""
    found: dict[tuple[int, bytes], list] = {}
    for rep, tree, main, asked, x in zip(*(table.column(c).to_pylist() for c in ("rep", "tree", "main", "asked", "shingles")), strict=True):
        held = found.setdefault((rep, x), [tree, main, False])
        held[2] |= asked
    rows = sorted(found.items())
    rep = np.array([r for (r, _), _ in rows], np.int64)
    sets = [np.frombuffer(x, np.uint64) for (_, x), _ in rows]
    _, tree = np.unique(np.array([t for _, (t, _, _) in rows]), return_inverse=True)
    main = np.array([m for _, (_, m, _) in rows])
    asked = np.flatnonzero([q for _, (_, _, q) in rows])
    k = len(sets)
    n = np.fromiter(map(len, sets), np.int64, k)
    owner = np.repeat(np.arange(k), n)
    _, code = np.unique(np.concatenate(sets), return_inverse=True)
    order = np.argsort(code, kind="stable")
    holders = owner[order]  # of each shingle in turn, the sets that have it
    begin = np.concatenate([[0], np.cumsum(np.bincount(code))])
    place = np.concatenate([[0], np.cumsum(n)])

    def near(i: int) -> np.ndarray:
        mine = code[place[i] : place[i + 1]]
        both = np.bincount(np.concatenate([holders[begin[c] : begin[c + 1]] for c in mine.tolist()]), minlength=k)
        good = 100 * both >= percent * (n + n[i] - both)
        good[i] = False
        return np.flatnonzero(good)

    edges, _ = forest(tree, near, asked.tolist(), int(main.argmax()) if main.any() else -1)
    return pa.table({"a": pa.array(rep[edges[:, 0]], pa.int64()), "b": pa.array(rep[edges[:, 1]], pa.int64())})


def near_duplicates(
    docs: DataFrame,
    *,
    id_col: str = "doc_id",
    text_col: str = "text",
    shingle: int = 5,
    percent: int = 80,
    block_members: int = 2048,
    block_shingles: int = 50_000,
) -> DataFrame:
    """Groups of documents linked by ``100 * intersection >= percent * union`` of their shingle sets.

    A set holds the distinct runs of ``shingle`` words, A-Z lower-cased; a text with fewer words has
    one, of all its words; one without words or a null text has none and is linked with nothing.
    Result, a row per input row: the id, ``n_shingles, component_id`` (the smallest id reachable
    over links), ``kept`` (whether that is its own).  Ids must be integers.  Rows with equal ids are
    one document with several texts: all are linked to each other's groups.  A null id is linked with
    nothing and kept, with a null component.  Further columns are left out; an empty table gives
    an empty result.  A pair exactly at the threshold escapes the bands with probability 1e-6.
    """
    spark = docs.sparkSession
    bands, rows = banding(percent / 100)
    m = bands * rows
    cut = percent / 100 - 6 * math.sqrt(percent / 100 * (1 - percent / 100) / m)
    folder = fresh_folder(spark, "near")

    def kept(df: DataFrame, name: str) -> DataFrame:
        df.write.parquet(f"{folder}/{name}")
        return spark.read.schema(df.schema).parquet(f"{folder}/{name}")

    def sketch(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in slices(batches, "text", 1 << 20):
            values, place = shingle_sets(chunk_of(part.column(1)), shingle)
            n = np.diff(place)
            full = np.flatnonzero(n)
            regs = [b""] * len(n)
            one, two = np.zeros(len(n), np.uint64), np.zeros(len(n), np.uint64)
            if len(full):
                for i, row in zip(full.tolist(), registers(values, place[full], m), strict=True):
                    regs[i] = row.tobytes()
                one[full] = np.add.reduceat(mix(values), place[full])
                two[full] = np.bitwise_xor.reduceat(mix(values + np.uint64(0x5851F42D4C957F2D)), place[full])
            yield pa.RecordBatch.from_arrays(
                [part.column(0), pa.array(n), pa.array(one.view(np.int64)), pa.array(two.view(np.int64)), pa.array(regs, pa.binary())],
                ["id", "n", "one", "two", "regs"],
            )

    texts = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).alias("text"))
    texts.mapInArrow(sketch, "id long, n long, one long, two long, regs binary").write.parquet(f"{folder}/sketches")
    sketches = spark.read.parquet(f"{folder}/sketches")
    # documents with the same set are one class, named by the smallest id
    same = ["n", "one", "two"]
    real = sketches.where("n > 0 AND id IS NOT NULL")
    real.groupBy(same).agg(F.min("id").alias("rep"), F.min_by("regs", "id").alias("regs")).write.parquet(f"{folder}/classes")
    classes = spark.read.parquet(f"{folder}/classes")

    banded = classes.select("rep", "regs").mapInArrow(lambda b: band_rows(b, bands, rows), "key long, rep long")
    # a bucket's first member goes to each of its blocks, every other one to its own
    members = banded.selectExpr("key", "rep", "count(*) OVER (PARTITION BY key) AS members", "min(rep) OVER (PARTITION BY key) AS hub").where("members > 1")
    blocks = F.ceil(F.col("members") / F.lit(block_members)).cast("int")
    own = F.array(F.pmod(F.xxhash64("rep"), blocks).cast("int"))
    members = members.withColumn("blocks", blocks).select(
        "key", "rep", "hub", "blocks", F.explode(F.when(F.col("rep") == F.col("hub"), F.sequence(F.lit(0), F.col("blocks") - 1)).otherwise(own)).alias("block")
    )
    shares = max(1, math.ceil(classes.count() / 4096))
    dealt = members.join(classes.select("rep", "n", "regs"), "rep").withColumn("share", F.pmod(F.xxhash64("key", "block"), F.lit(shares)))
    likely = dealt.groupBy("share").applyInArrow(lambda t: likely_edges(t, cut), EDGES).groupBy("a", "b").agg(F.min("weak").alias("weak"))
    likely = kept(likely, "likely")
    clusters = kept(components(likely).select("node", "component"), "clusters")

    def full_sets(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in slices(batches, "text", 1 << 20):
            values, place = shingle_sets(chunk_of(part.column(1)), shingle)
            sets = [values[a:b].tobytes() for a, b in zip(place, place[1:], strict=False)]
            yield pa.RecordBatch.from_arrays([part.column(0), pa.array(sets, pa.binary())], ["rep", "shingles"])

    # an id may have several texts; equal ones are looked at once
    wanted = texts.join(clusters.select(F.col("node").alias("id")), "id").select("id", "text", F.xxhash64("text").alias("h"), F.hash("text").alias("g"))
    wanted = wanted.dropDuplicates(["id", "h", "g"]).select("id", "text")
    sets = kept(wanted.mapInArrow(full_sets, "rep long, shingles binary").where("length(shingles) > 0"), "sets")
    # pairs are confirmed; the set of one that has many is sent once for each thousand of them
    degree = likely.where("NOT weak").groupBy("a").agg(F.ceil(F.count("*") / 1000).cast("int").alias("salts"))
    pairs = likely.where("NOT weak").join(degree, "a").selectExpr("a", "b", "CAST(pmod(xxhash64(b), salts) AS INT) AS salt")
    salted = sets.withColumnRenamed("rep", "a").join(degree, "a").select("a", F.explode(F.sequence(F.lit(0), F.col("salts") - 1)).alias("salt"), F.col("shingles").alias("one"))
    pairs = pairs.join(salted, ["a", "salt"]).join(sets.select(F.col("rep").alias("b"), F.col("shingles").alias("two")), "b")
    links = kept(pairs.select("a", "b", "one", "two").mapInArrow(lambda x: confirmed(x, percent), "a long, b long"), "confirmed")
    # clusters that are left with several trees
    trees = components(links).select(F.col("node"), F.col("component").alias("tree"))
    placed = clusters.join(trees, "node", "left").join(classes.select(F.col("rep").alias("node"), "n"), "node")
    placed = kept(placed.select(F.col("node").alias("rep"), F.col("component").alias("cluster"), F.coalesce("tree", "node").alias("tree"), "n"), "placed")
    weights = placed.groupBy("cluster", "tree").agg(F.sum("n").alias("n"))
    weights = weights.groupBy("cluster").agg(F.count("*").alias("trees"), F.sum("n").alias("weight"), F.max(F.struct("n", "tree")).alias("top"))
    open_ = weights.where("trees > 1").selectExpr(
        "cluster", "top.tree AS main", f"CAST(ceil(weight / {block_shingles}) AS INT) AS rows_", f"CAST(ceil((weight - top.n) / {block_shingles}) AS INT) AS columns_"
    )
    open_ = placed.join(open_, "cluster").selectExpr("cluster", "rep", "tree", "tree = main AS main", "rows_", "columns_")
    own = lambda of: F.array(F.pmod(F.xxhash64("rep"), F.col(of)).cast("int"))
    each = lambda of: F.sequence(F.lit(0), F.col(of) - 1)
    at = ["cluster", "rep", "tree", "main"]
    told = open_.select(*at, F.lit(False).alias("asked"), F.explode(own("rows_")).alias("x"), "columns_").withColumn("y", F.explode(each("columns_"))).drop("columns_")
    asked = open_.where("NOT main").select(*at, F.lit(True).alias("asked"), F.explode(each("rows_")).alias("x"), "columns_").withColumn("y", F.explode(own("columns_"))).drop("columns_")
    blocks = told.unionByName(asked).join(sets, "rep").groupBy("cluster", "x", "y").applyInArrow(lambda t: exact_edges(t, percent), "a long, b long")
    links = links.unionByName(kept(blocks, "links"))
    # an id with several sets links their classes
    several = real.join(classes.select(*same, "rep"), same).where("id <> rep").select(F.col("id").alias("a"), F.col("rep").alias("b"))
    several = several.join(classes.select(F.col("rep").alias("a")), "a")
    found = components(links.unionByName(several))
    named = classes.join(found.withColumnRenamed("node", "rep"), "rep", "left").select(
        *same, F.coalesce("component", "rep").alias("component_id")
    )
    linked = sketches.where("n > 0").join(named, same, "left")
    alone = sketches.where("n = 0").withColumn("component_id", F.col("id"))
    keep = [F.col("id").alias(id_col), F.col("n").alias("n_shingles"), F.when(F.col("id").isNotNull(), F.col("component_id")).alias("component_id")]
    out = linked.select(*keep).unionByName(alone.select(*keep))
    return out.withColumn("kept", F.coalesce(F.col(id_col) == F.col("component_id"), F.lit(True)))


def keep_one(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", shingle: int = 5, percent: int = 80) -> DataFrame:
    """The documents with the smallest id of their group of near duplicates, with all their columns.

    Rows with a null id are kept; of rows with equal ids all are kept or none.
    """
    groups = near_duplicates(docs, id_col=id_col, text_col=text_col, shingle=shingle, percent=percent)
    gone = groups.where("NOT kept").select(id_col).distinct()
    return docs.join(gone, id_col, "left_anti").select(docs.columns)
