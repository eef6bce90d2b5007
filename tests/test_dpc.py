import math
import random
import statistics

import pytest
from pyspark.sql import functions as F

from kinspan.operators.domains import spurious_parents
from kinspan.operators.dpc import HALO_METHODS, dpc


def reference_dpc(n, w, edges, min_sim, min_dens, method, tau, point):
    """Quadratic density-peak clustering of one graph."""
    sim = {}
    for a, b, s in edges:
        if a != b and s > 0:
            sim[a, b] = sim[b, a] = max(s, sim.get((a, b), 0))
    near = {i: {j: sim[i, j] for j in range(n) if (i, j) in sim} for i in range(n)}
    rho = [round(w[i] + sum(w[j] * s for j, s in near[i].items()), 9) for i in range(n)]
    parent, peak = {}, {}
    for i in range(n):
        up = [(s, rho[j], -j) for j, s in near[i].items() if (rho[j], -j) > (rho[i], -i)]
        best = max(up, default=None)
        peak[i] = rho[i] >= min_dens and (best is None or best[0] < min_sim)
        parent[i] = i if peak[i] or best is None else -best[2]
    label = {}
    for i in range(n):
        r = i
        while parent[r] != r:
            r = parent[r]
        label[i] = r if peak[r] else None
    found = {c for c in label.values() if c is not None}
    if method is None or tau >= 1 or len(found) <= 1:
        return label
    members = {c: [i for i in label if label[i] == c] for c in found}
    border = set()
    for i, c in label.items():
        if c is None or len(members[c]) < 3:
            continue
        top = sorted(near[i].items(), key=lambda x: (-x[1], x[0]))
        if method != "traditional":
            top = top[:20]
        foreign = [label[j] != c for j, _ in top]
        if method == "traditional":
            score = max((s for j, s in top if s >= tau and label[j] != c), default=0)
        elif not top:
            score = 0
        elif method == "similarity_weighted":
            score = sum(s for (_, s), f in zip(top, foreign) if f) / sum(s for _, s in top)
        elif method == "knn":
            score = sum(foreign) / len(top)
        else:
            gain = sum(1 / math.log2(r + 2) for r, f in enumerate(foreign) if f)
            ideal = sum(1 / math.log2(r + 2) for r in range(sum(foreign)))
            score = gain / ideal if ideal else 0
        if round(score, 9) >= tau and score > 0:
            border.add(i)
    out = dict(label)
    for c, m in members.items():
        if point:
            mid = statistics.median(rho[i] for i in m)
            gone = [i for i in m if i in border and rho[i] < mid]
        else:
            edge = max((rho[i] for i in m if i in border), default=None)
            gone = [i for i in m if edge is not None and rho[i] < edge]
        for i in gone:
            out[i] = None
    return out


def graphs(seed, count):
    rng = random.Random(seed)
    for _ in range(count):
        n = rng.randint(1, 14)
        w = [rng.randint(1, 4) for _ in range(n)]
        edges = [(i, j, rng.randint(1, 20) / 20) for i in range(n) for j in range(i + 1, n) if rng.random() < 0.35]
        yield n, w, edges


@pytest.mark.parametrize("method", [None, *HALO_METHODS])
@pytest.mark.parametrize("point", [False, True])
def test_agrees_with_quadratic(spark, method, point):
    if method is None and point:
        pytest.skip("no halo, no mode of it")
    many = list(graphs(17, 125))
    nodes = spark.createDataFrame([(g, i, w[i]) for g, (n, w, _) in enumerate(many) for i in range(n)], "g int, id int, w int")
    edges = spark.createDataFrame([(g, *e) for g, (_, _, es) in enumerate(many) for e in es], "g int, a int, b int, sim double")
    got = dpc(nodes, edges, by=["g"], min_sim=0.5, min_dens=2, halo_method=method, halo_tau=0.4, point_specific=point)
    labels = {(r["g"], r["id"]): r["label"] for r in got.collect()}
    for g, (n, w, es) in enumerate(many):
        want = reference_dpc(n, w, es, 0.5, 2, method, 0.4, point)
        assert {i: labels[g, i] for i in range(n)} == want, (g, es)


def test_low_density_is_noise(spark):
    nodes = spark.createDataFrame([(0, 1), (1, 1)], "id int, w int")
    edges = spark.createDataFrame([(0, 1, 0.1)], "a int, b int, sim double")
    assert {r["label"] for r in dpc(nodes, edges, min_sim=0.5, min_dens=5).collect()} == {None}


def test_arguments_are_checked(spark):
    with pytest.raises(ValueError):
        dpc(None, None, min_sim=0, min_dens=1)
    with pytest.raises(ValueError):
        dpc(None, None, min_sim=0.5, min_dens=1, halo_method="other")


def test_spurious_priority(spark):
    peaks = spark.createDataFrame([(9, 0, 5, 50), (9, 1, 5, 160)], "q_seq int, id int, support int, len int")
    edges = spark.createDataFrame([(9, 0, 1, 50, 50, 160)], "q_seq int, a int, b int, inter int, len_a int, len_b int")
    assert {r["id"]: r["parent"] for r in spurious_parents(peaks, edges, 0.5).collect()} == {0: 0, 1: 0}
    assert spurious_parents(peaks, edges.where(F.lit(False)), 0.5).where("id <> parent").count() == 0
