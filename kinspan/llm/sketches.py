"""Document fingerprints: invertible Bloom lookup sketches of a text's paragraphs.

Only DataFrame functions are used.  A paragraph is a line, cut after the first sentence end beyond
each 100 characters, or where none comes within 800 at the next blank, at 900 at most; its digest is 48 bits of a hash and a 16-bit check of these.  A sketch is three
rows of 8 cells, each with the count and the exclusive or of the digests that fall there, one
in each row.  Two sketches subtract cell by cell; peeling then takes digests out of cells that
hold a single one until nothing is left.  Where something is left the pair is tried again with more
rows of cells, dealt over segments, until every pair is recovered.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..plans.shared import fresh_folder

PIECE = r"[^\n]{1,100}+[^.!?。！？\n]{0,700}+[^.!?。！？\s]{0,100}+[.!?。！？]*+"
CELLS = "array<struct<c:int,n:int,x:bigint>>"
#: Paragraphs of both texts for each segment of a larger sketch, and how many times more segments each further try has.
LOAD, MORE = 6, 4


def check_of(digest: str) -> str:
    return f"(xxhash64(shiftrightunsigned({digest}, 16)) & 65535)"


def digests(text: Column) -> Column:
    """The distinct paragraph digests of a text."""
    hashes = F.transform(F.regexp_extract_all(text, F.lit(PIECE), F.lit(0)), lambda p: F.shiftleft(F.shiftrightunsigned(F.xxhash64(p), 16), 16))
    return F.array_distinct(F.transform(hashes, lambda h: h.bitwiseOR(F.xxhash64(F.shiftrightunsigned(h, 16)).bitwiseAND(65535))))


def small_sketch(column: str) -> str:
    """SQL for the 24 cells of an array of digests."""
    hashed = f"transform({column}, e -> named_struct('e', e, 'g', xxhash64(e, 0)))"
    rows = [
        f"transform(sequence(0, 7), c -> named_struct('c', {8 * j} + c, 'f', filter(u, y -> (shiftrightunsigned(y.g, {3 * j}) & 7) = c)))"
        for j in range(3)
    ]
    cells = f"transform(concat({', '.join(rows)}), k -> named_struct('c', k.c, 'n', size(k.f), 'x', aggregate(k.f, 0L, (a, y) -> a ^ y.e)))"
    # the hashes are computed once, as the only element of an array
    return f"transform(array({hashed}), u -> CAST({cells} AS {CELLS}))[0]"


def subtract(a: str, b: str) -> str:
    return f"zip_with({a}, {b}, (p, q) -> named_struct('c', p.c, 'n', p.n - q.n, 'x', p.x ^ q.x))"


def peeled(cells: str, level: int) -> str:
    """SQL for what peeling leaves: the cells, and how many digests were only in the first text (plus)
    and only in the second (minus)."""
    state = f"struct<cells:{CELLS},plus:int,minus:int>"
    pure = f"filter(s.cells, k -> abs(k.n) = 1 AND (k.x & 65535) = {check_of('k.x')})"
    taken = (
        "transform(s.cells, k -> IF(k.c < 8 AND k.c = (q.g & 7) OR k.c BETWEEN 8 AND 15 AND k.c - 8 = (shiftrightunsigned(q.g, 3) & 7)"
        " OR k.c >= 16 AND k.c - 16 = (shiftrightunsigned(q.g, 6) & 7), named_struct('c', k.c, 'n', k.n - q.n, 'x', k.x ^ q.x), k))"
    )
    next_ = (
        f"transform(slice(transform(p, k -> named_struct('n', k.n, 'x', k.x, 'g', xxhash64(k.x, {level}))), 1, 1), q ->"
        f" named_struct('cells', {taken}, 'plus', s.plus + IF(q.n = 1, 1, 0), 'minus', s.minus + IF(q.n = 1, 0, 1)))"
    )
    step = f"transform(array({pure}), p -> CAST(IF(size(p) = 0, s, {next_}[0]) AS {state}))[0]"
    start = f"CAST(named_struct('cells', {cells}, 'plus', 0, 'minus', 0) AS {state})"
    # no more than a digest a cell can be taken; a peel that is stuck passes the rest unchanged
    return f"aggregate(sequence(1, size({cells}) + 1), {start}, (s, i) -> {step})"


def is_empty(cells: str) -> str:
    return f"NOT exists({cells}, k -> k.n <> 0 OR k.x <> 0)"


def likeness(n: str, plus: str, minus: str) -> str:
    """The Jaccard coefficient of two sets, of which the first has n elements."""
    return f"IF({n} + {minus} = 0, 1D, ({n} - {plus}) / CAST({n} + {minus} AS DOUBLE))"


def recover(pairs: DataFrame, level: int) -> DataFrame:
    """``row, kind, likeness`` of pairs of digest arrays a and b; null where peeling leaves something.

    The cells of both sketches are made, subtracted and peeled where the pair's row is.
    """
    segments = f"ceil((size(a) + size(b)) / {LOAD}) * {MORE ** (level - 1)}"
    units = pairs.repartition("row").selectExpr(
        "row", "kind", "size(a) AS n", f"greatest(CAST({segments} AS INT), 1) AS segments",
        "explode(concat(transform(a, e -> named_struct('sign', 1, 'e', e)), transform(b, e -> named_struct('sign', -1, 'e', e)))) AS u",
    )
    units = units.selectExpr("row", "kind", "n", "segments", "u.sign", "u.e", f"xxhash64(u.e, {level}) AS g")
    cells = units.selectExpr(
        "row", "kind", "n", "pmod(shiftrightunsigned(g, 9), segments) AS segment", "sign", "e",
        "explode(array(CAST(g & 7 AS INT), CAST(8 + (shiftrightunsigned(g, 3) & 7) AS INT), CAST(16 + (shiftrightunsigned(g, 6) & 7) AS INT))) AS c",
    )
    difference = cells.groupBy("row", "kind", "n", "segment", "c").agg(F.sum("sign").cast("int").alias("d"), F.bit_xor("e").alias("x"))
    held = difference.where("d <> 0 OR x <> 0").groupBy("row", "kind", "n", "segment").agg(F.expr("collect_list(named_struct('c', c, 'n', d, 'x', x)) AS cells"))
    left = held.selectExpr("row", "kind", "n", f"{peeled('cells', level)} AS s")
    return (
        left.groupBy("row", "kind", "n")
        .agg(F.expr(f"bool_and({is_empty('s.cells')})").alias("done"), F.sum("s.plus").alias("plus"), F.sum("s.minus").alias("minus"))
        .selectExpr("row", "kind", f"IF(done, {likeness('n', 'plus', 'minus')}, NULL) AS likeness")
    )


def with_next(docs: DataFrame, id_col: str, text_col: str, bucket_bytes: int, most_bounds: int) -> DataFrame:
    """``row, id, text, next``: each document with the text of the next one by descending id.

    Ranges of ids with about ``bucket_bytes`` of text each are sorted by themselves; the first
    document of the range below is sent along with each, so that texts are shuffled once.  Equal ids
    follow one another by a hash of their texts; null ids come last; after the last comes the first.
    """
    texts = docs.select(F.col(id_col).alias("id"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    total, any_null, low, high = texts.agg(F.sum(F.octet_length("text")), F.bool_or(F.col("id").isNull()), F.min("id"), F.max("id")).first()
    ranges = max(1, math.ceil((total or 0) / bucket_bytes))
    levels = max(0, math.ceil(math.log2(min(most_bounds, ranges))))
    n = 1 << levels
    bounds: list[int] = []
    if n > 1:
        cuts = [i / n for i in range(1, n)]
        bounds = texts.agg(F.percentile_approx("id", cuts, 100 * n)).first()[0] or []
    bucket = F.lit(0).cast("long")
    if bounds:
        bucket = _search(F.array(*map(F.lit, bounds)), levels).cast("long")
    # beyond as many quantiles as the driver should hold, each range is divided evenly
    parts = math.ceil(ranges / n)
    if bounds and parts > 1:
        edges = F.array(*map(F.lit, [low, *bounds, high]))
        begin, end = F.element_at(edges, bucket.cast("int") + 1), F.element_at(edges, bucket.cast("int") + 2)
        share = (F.col("id") - begin).cast("double") / F.greatest((end - begin).cast("double"), F.lit(1.0))
        bucket = bucket * parts + F.least(F.greatest(F.floor(share * parts), F.lit(0)), F.lit(parts - 1))
    placed = texts.withColumn("bucket", F.when(F.col("id").isNull(), F.lit(0)).otherwise(bucket).cast("long"))
    # one row a range: its first document goes to the range above; the last range's goes to the lowest
    tops = placed.where("id IS NOT NULL").groupBy("bucket").agg(F.max("id").alias("id"))
    lowest = "0" if any_null else "min(bucket) OVER ()"
    halo = tops.selectExpr("id", f"coalesce(lead(bucket) OVER (ORDER BY bucket), {lowest}) AS bucket")
    sent = texts.join(halo, "id").select("id", "text", "bucket", F.lit(1).alias("halo"))
    both = placed.select("id", "text", "bucket", F.lit(0).alias("halo")).unionByName(sent)
    order = "OVER (PARTITION BY bucket ORDER BY halo, id DESC NULLS LAST, xxhash64(text), text)"
    out = both.selectExpr("bucket", "halo", "id", "text", f"lead(text) {order} AS following", f"row_number() {order} AS number",
                          f"first(text) {order} AS first_text")
    return out.where("halo = 0").selectExpr(
        "shiftleft(bucket, 36) + number AS row", "id", "text", "coalesce(following, first_text) AS next"
    )


def _search(bounds: Column, levels: int) -> Column:
    """How many of the ascending bounds (one less than a power of 2) are not above the id."""

    def step(p: Column, k: Column) -> Column:
        half = F.element_at(F.array(*(F.lit(1 << i) for i in range(levels))), k + 1)
        return F.when(F.element_at(bounds, p + half) <= F.col("id"), p + half).otherwise(p)

    return F.aggregate(F.sequence(F.lit(levels - 1), F.lit(0)), F.lit(0), step)


def edited(text: Column, following: Column) -> Column:
    """The text with its last third replaced by the first as many characters (or all) of the following text."""
    n = F.char_length(text)
    third = F.floor(n / 3).cast("int")
    return F.concat(F.substring(text, F.lit(1), n - third), F.substring(following, F.lit(1), third))


#: The digests of an edited text: as many of its text's as they begin with alike, and the rest.
EDITED = "concat(slice(a, 1, alike), rest)"


def packed(rows: DataFrame) -> DataFrame:
    """``rows`` with ``alike`` and ``rest`` for the digests ``e``: an edited text begins as its text does, and this part is neither written nor shuffled twice."""
    rows = rows.withColumn("differ", F.expr("array_position(zip_with(a, e, (x, y) -> x <=> y), false)"))
    rows = rows.withColumn("alike", F.expr("IF(differ = 0, size(a), CAST(differ - 1 AS INT))"))
    return rows.withColumn("rest", F.expr("slice(e, alike + 1, size(e))")).drop("differ", "e")


def fingerprints(
    docs: DataFrame,
    *,
    id_col: str = "doc_id",
    text_col: str = "text",
    bucket_bytes: int = 8 << 20,
    most_bounds: int = 1 << 14,
) -> DataFrame:
    """Fingerprints of every text and of its edited version, and what they say of likeness.

    Result, a row per input row: the id, ``n_chars, edited_sha256, fingerprint, edited_fingerprint``
    (24 cells in hexadecimal: 4 digits of count, 16 of digests) and ``near_edited, near_next``, the Jaccard
    coefficients of the paragraph sets as the sketches' differences give them.  Equal texts have
    equal fingerprints; two texts without paragraphs have likeness 1.  Null texts count as empty.
    Further columns are left out; an empty table gives an empty result.
    """
    spark = docs.sparkSession
    folder = fresh_folder(spark, "sketches")
    rows = with_next(docs, id_col, text_col, bucket_bytes, most_bounds)
    rows = rows.withColumn("edited", edited(F.col("text"), F.col("next")))
    rows = rows.select(
        "row", "id", F.char_length("text").cast("long").alias("n_chars"), F.unhex(F.sha2("edited", 256)).alias("sha"),
        digests(F.col("text")).alias("a"), digests(F.col("edited")).alias("e"), digests(F.col("next")).alias("f"),
    )
    packed(rows).write.parquet(f"{folder}/digests")
    held = spark.read.parquet(f"{folder}/digests")
    sketched = held.selectExpr("row", "size(a) AS n", f"{small_sketch('a')} AS sa", f"{small_sketch(EDITED)} AS se", f"{small_sketch('f')} AS sf")
    tried = sketched.selectExpr("row", "n", f"explode(array(named_struct('kind', 0, 'd', {subtract('sa', 'se')}), named_struct('kind', 1, 'd', {subtract('sa', 'sf')}))) AS p")
    tried = tried.selectExpr("row", "n", "p.kind", f"{peeled('p.d', 0)} AS s")
    tried = tried.selectExpr("row", "kind", f"IF({is_empty('s.cells')}, {likeness('n', 's.plus', 's.minus')}, NULL) AS likeness")
    tried.write.parquet(f"{folder}/level-0")
    results = [spark.read.parquet(f"{folder}/level-0")]
    level = 0
    while results[-1].where("likeness IS NULL").limit(1).count():
        level += 1
        failed = results[-1].where("likeness IS NULL").select("row", "kind")
        pairs = held.join(failed, "row").selectExpr("row", "kind", "a", f"IF(kind = 0, {EDITED}, f) AS b")
        recover(pairs, level).write.parquet(f"{folder}/level-{level}")
        results.append(spark.read.parquet(f"{folder}/level-{level}"))
    found = results[0].where("likeness IS NOT NULL")
    for more in results[1:]:
        found = found.unionByName(more.where("likeness IS NOT NULL"))
    found = found.groupBy("row").agg(F.max(F.expr("IF(kind = 0, likeness, NULL)")).alias("near_edited"), F.max(F.expr("IF(kind = 1, likeness, NULL)")).alias("near_next"))
    text = lambda c: f"array_join(transform({small_sketch(c)}, k -> concat(lpad(lower(hex(k.n)), 4, '0'), lpad(lower(hex(k.x)), 16, '0'))), '')"
    return held.join(found, "row").selectExpr(
        f"id AS {id_col}", "n_chars", "lower(hex(sha)) AS edited_sha256", f"{text('a')} AS fingerprint", f"{text(EDITED)} AS edited_fingerprint", "near_edited", "near_next"
    )
