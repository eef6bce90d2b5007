"""Pairs of aligned rows as arrays: the counts of brute force, whatever the blocks, tiles and copies."""

import random
from collections import Counter

import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from kinspan.operators import alignment as A
from kinspan.operators import bits


def test_only_bits_that_tell_residues_apart():
    assert len(bits.masks(pa.array(["ACGUN-.", "A", ""]))) == 4 and len(bits.masks(pa.array(["AA-", ""]))) == 1
    with pytest.raises(ValueError):
        bits.masks(pa.array(["A\u00c9"]))


@pytest.mark.parametrize(("width", "block", "tile", "kinds"), [(40, 1000, (256, 4096), 1 << 22), (40, 7, (3, 4), 1 << 22), (150, 7, (3, 4), 1), (150, 1000, (5, 100), 1 << 22)])
def test_tallies_of_pairs(spark, monkeypatch, width, block, tile, kinds):
    monkeypatch.setattr(bits, "TILE", tile)
    monkeypatch.setattr(bits, "KINDS", kinds)
    rng = random.Random(width + block)
    rows = [("a", "".join(rng.choice("ACGUNacgun-.XYZ" if i % 3 else "AC-.") for _ in range(width))) for i in range(33)]
    rows += [rows[i] for i in (0, 0, 0, 5, 7, 7)] + [("b", "-" * width), ("b", "A" * width), ("c", "." * width)]
    aligned = spark.createDataFrame([(d, i, s) for i, (d, s) in enumerate(rows)], "dataset string, header long, sequence string")
    classes = aligned.groupBy("dataset", "sequence").agg(F.count("*").alias("times"))
    out = bits.pair_tallies(classes, block).groupBy("dataset", "same", "either").agg(F.sum("n").alias("n")).where("n <> 0")
    want, distinct, times = Counter(), sorted(set(rows)), Counter(rows)
    for i, x in enumerate(distinct):
        for y in distinct[:i]:
            if x[0] == y[0]:
                both = [(c, e) for c, e in zip(x[1], y[1]) if not (c in "-." and e in "-.")]
                want[x[0], sum(c == e for c, e in both), len(both)] += times[x] * times[y]
    assert {(r.dataset, r.same, r.either): r.n for r in out.collect()} == dict(want)


def test_pairs_of_rows_are_no_rows(spark):
    aligned = spark.createDataFrame([("a", i, f"{i:08b}".replace("0", "A").replace("1", "C")) for i in range(200)], "dataset string, header long, sequence string")
    made, real = [], A.cut
    try:
        A.cut = lambda df: (made.append(df._jdf.queryExecution().optimizedPlan().toString()), real(df))[1]
        found = A.identity(aligned).collect()
    finally:
        A.cut = real
    assert len(found) == 1 and any("FlatMapGroupsInArrow" in p for p in made) and not any("times_x" in p for p in made)


def test_cells_count_where_they_are(spark):
    rows = spark.createDataFrame([("a", 0, "AC-GU"), ("a", 1, "ACCG-"), ("a", 2, "-CCGA")], "dataset string, header long, sequence string")
    cells = A.cells(rows).where("ch <> '-'")
    assert [tuple(r) for r in A.identity(cells).collect()] == [tuple(r) for r in A.identity(rows).collect()]
