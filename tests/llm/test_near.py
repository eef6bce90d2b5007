import random

import numpy as np
from pyspark.sql import functions as F

from kinspan.llm.near import banding, estimate, keep_one, near_duplicates, registers


def brute(rows, k, percent):
    def shingles(t):
        w = [x.decode().translate({i: i + 32 for i in range(65, 91)}) for x in (t or "").encode().split()]
        return {tuple(w[i : i + k]) for i in range(len(w) - k + 1)} if len(w) >= k else ({tuple(w)} if w else set())

    sets = [(i, shingles(t)) for i, t in rows]
    up = {i: i for i, _ in sets}

    def find(x):
        while up[x] != x:
            x = up[x]
        return x

    for n, (i, a) in enumerate(sets):
        for j, b in sets[:n]:
            if a and b and i is not None and j is not None and 100 * len(a & b) >= percent * len(a | b):
                x, y = sorted((find(i), find(j)))
                up[y] = x
    return sorted(((i, len(s), None if i is None else find(i)) for i, s in sets), key=str)


def family(rng, n, length=60):
    base = [f"w{rng.randint(0, 400)}" for _ in range(length)]
    out = []
    for _ in range(n):
        w = list(base)
        for _ in range(rng.randint(0, 4)):
            w[rng.randrange(length)] = f"x{rng.randint(0, 10**6)}"
        out.append(" ".join(w))
    return out


def test_agrees_with_brute_force(spark):
    rng = random.Random(9)
    texts = [t for _ in range(12) for t in family(rng, rng.randint(1, 9))] + family(rng, 120) + ["One", "one", "two words", "TWO  words", "", None, "a b c", "a b c d"]
    texts += [" ".join(f"q{i}" for i in range(9000))] * 2
    rng.shuffle(texts)
    rows = [(i, t) for i, t in enumerate(texts)] + [(None, texts[0])]
    df = spark.createDataFrame(rows, "doc_id long, text string").withColumn("component_id", F.lit("clash"))
    for options in ({}, {"block_members": 16, "block_shingles": 500}):
        got = near_duplicates(df, shingle=3, percent=85, **options).collect()
        assert sorted(((r["doc_id"], r["n_shingles"], r["component_id"]) for r in got), key=str) == brute(rows, 3, 85)
        assert all(r["kept"] == (r["doc_id"] is None or r["doc_id"] == r["component_id"]) for r in got)
    kept = keep_one(df, shingle=3, percent=85)
    assert kept.columns == df.columns
    assert kept.count() == sum(i is None or i == c for i, _, c in brute(rows, 3, 85))


def test_equal_ids_are_one_document(spark):
    df = spark.createDataFrame([(1, "a b c d e"), (1, "v w x y z"), (2, "v w x y z"), (3, "a b c d e")], "doc_id long, text string")
    assert {r["component_id"] for r in near_duplicates(df).collect()} == {1}


def test_empty_table(spark):
    assert near_duplicates(spark.createDataFrame([], "doc_id long, text string")).count() == 0


def test_registers_estimate_jaccard():
    bands, rows = banding(0.85)
    assert (1 - 0.85**rows) ** bands <= 1e-6
    rng = np.random.default_rng(3)
    x = rng.integers(0, 2**63, 1500).astype(np.uint64)
    a, b = x[:1000], x[250:1250]  # 750 of 1250
    regs = registers(np.concatenate([np.sort(a), np.sort(b)]), np.array([0, 1000]), 1024)
    got = estimate(np.array([(regs[0] == regs[1]).mean()]), np.array([1000]), np.array([1000]))[0]
    assert abs(got - 0.6) < 0.08
