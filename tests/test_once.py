"""Whole queries come of one shuffle of their rows by key, and give the same where a key is heavy."""

import random

from pyspark.sql import functions as F

from kinspan.functions import sequences as S
from kinspan.operators import alignment as A
from kinspan.operators import extraction as X
from kinspan.plans import shared
from kinspan.plans.shared import by_key
from tests.test_dealt import plans  # noqa: F401


def test_covariation_comes_of_one_shuffle(spark, plans, monkeypatch):  # noqa: F811
    rng = random.Random(4)
    rows = [(d, i if i else None, "".join(rng.choice("ACGUN-") for _ in range(70))) for d, n in (("x", 150), ("y", 5), ("z", 1)) for i in range(n)] + [("z", 7, "")]
    aligned = spark.createDataFrame(rows, "dataset string, header long, sequence string")
    with_pairs = lambda own: (A.base_pairs(own, A.bracket_pairs(own.select("dataset").distinct().withColumn("dbn", F.lit("((..[[.))]]")))),)
    tidy = lambda df: sorted((r[0], *(round(v, 9) for v in r[1:])) for r in df.collect())
    cells = A.cells(aligned).cache()
    wanted = tidy(with_pairs(cells)[0]), tidy(A.mean_covariation(cells))
    del plans[:]
    for work, same in zip((with_pairs, lambda own: (A.mean_covariation(own),)), wanted):
        assert tidy(by_key(aligned, "dataset", work)[0]) == same
        assert len(plans) > 3 and [p.count("Exchange") for p in plans] == [1] + [0] * (len(plans) - 1)
        del plans[:]
    monkeypatch.setattr(shared, "HEAVY", 60)
    assert tidy(by_key(aligned, "dataset", with_pairs)[0]) == wanted[0]


def test_extracts_are_made_once_for_remapping(spark, tmp_path):
    rng = random.Random(9)
    texts = {f"s{k}": "".join(rng.choice("ACGURYN-.acgun") for _ in range(60)) for k in range(5)} | {"none": None, "empty": ""}
    spark.createDataFrame(list(texts.items()), "seqid string, sequence string").write.parquet(f"{tmp_path}/sequences")
    rows = [(s, a := rng.randint(1, 70), a + rng.randint(0, 20), rng.choice("+-"), f"f{i}") for s in texts for i in range(20)]
    features = spark.createDataFrame(rows, "seqid string, start long, end long, strand string, ID string")
    found = X.extract(features, spark.read.parquet(f"{tmp_path}/sequences"), flank=2, max_density=0.5)
    wanted = set()
    for s, a, b, strand, name in rows:
        low, high = max(1, a - 2), b + 2 if texts[s] is None else min(len(texts[s]), b + 2)
        part = None if texts[s] is None else texts[s][low - 1 : max(high, low - 1)]
        bare = (part or "").replace("-", "").replace(".", "")
        if not bare or sum(c in "RYSWKMBDHVNryswkmbdhvn" for c in bare) / len(bare) <= 0.5:
            wanted.add((name, s, low, high, part if strand == "+" or part is None else part.translate(str.maketrans(S.CODES, S.COMPLEMENTS))[::-1]))
    assert 50 < len(wanted) < len(rows)
    assert {(r.fid, r.seqid, r.ext_start, r.ext_end, r.sequence) for r in found.collect()} == wanted
    moved = X.remap(found, features.where("ID = 'f3'").drop("ID"))
    assert moved.count() > 0 and not any("/sequences/" in f for f in moved.inputFiles())
