import random

from pyspark.sql import functions as F

from kinspan.llm.repeats import drop_repeats
from .conftest import rows_of


def brute(rows, window):
    docs = [(i, [w.decode() for w in (t or "").encode().split()]) for i, t in rows]
    least = {}
    for i, ws in docs:
        if i is not None:
            for p in range(len(ws) - window + 1):
                key = tuple(ws[p : p + window])
                least[key] = min(i, least.get(key, i))
    out = []
    for i, ws in docs:
        gone = set()
        for p in range(len(ws) - window + 1):
            if i is not None and least[tuple(ws[p : p + window])] < i:
                gone |= set(range(p, p + window))
        out.append((i, len(ws), len(gone), " ".join(w for k, w in enumerate(ws) if k not in gone)))
    return sorted(out, key=str)


def test_agrees_with_brute_force(spark):
    rng = random.Random(5)
    words = ["a", "b", "é", "中", "dd"]
    passage = [rng.choice(words) + str(k) for k in range(30)]
    rows = []
    for i in range(60):
        text = [rng.choice(words) for _ in range(rng.randint(0, 40))]
        if i % 3 == 0:
            a = rng.randint(0, 10)
            text[5:5] = passage[a : a + rng.randint(5, 20)]
        rows.append((i, rng.choice(["\n", " ", "\t "]).join(text)))
    rows += [(60, None), (61, ""), (62, rows[0][1]), (62, rows[0][1]), (None, rows[0][1]), (63, "x " * 5000), (64, "x " * 5000)]
    rng.shuffle(rows)
    df = spark.createDataFrame(rows, "doc_id long, text string").withColumn("n_words", F.lit("clash")).withColumn("row", F.lit(1)).withColumn("batch", F.lit("b"))
    for sizes in ({}, {"batch_bytes": 200, "bucket_bytes": 300}):
        got = drop_repeats(df, window=8, **sizes)
        assert got.columns == ["doc_id", "text", "row", "batch", "n_words", "n_removed", "removed"]
        found = got.collect()
        assert sorted(((r["doc_id"], r["n_words"], r["n_removed"], r["text"]) for r in found), key=str) == brute(rows, 8)
        assert all(sum(x["after"] - x["first"] for x in r["removed"]) == r["n_removed"] for r in found)


def test_empty_table(spark):
    assert drop_repeats(rows_of(spark, [])).count() == 0
