"""Meetings of domains as arrays: the same graph as by brute force, and no row for each pair where sums are asked for."""

import random

import pytest
from pyspark.sql import functions as F

from kinspan.operators import domains, dpc, meetings
from kinspan.plans import shared
from kinspan.queries import rounded, rounded_share


@pytest.fixture
def targets(spark):
    rng = random.Random(21)
    rows = [(t := rng.randint(0, 9) ** 2 // 9, s := rng.randint(0, 90), s + rng.randint(1, 30), rng.randint(0, 60) * 70_001 - 9) for _ in range(700)]
    return spark.createDataFrame(rows, "t_seq long, t_start int, t_end int, dom_id long")


def tidy(df):
    return sorted(tuple(round(x, 9) if isinstance(x, float) else x for x in r) for r in df.collect())


@pytest.mark.parametrize(("heavy", "pairs", "repeats"), [(200_000, 1 << 18, 256), (200_000, 7, 3), (60, 50, 256)])
def test_what_is_asked_of_the_graph_is_that_of_its_edges(spark, targets, monkeypatch, heavy, pairs, repeats):
    monkeypatch.setattr(shared, "HEAVY", heavy)
    monkeypatch.setattr(meetings, "PAIRS", pairs)
    monkeypatch.setattr(domains, "REPEATS", repeats)
    at = {}
    for r in targets.collect():
        at.setdefault(r.dom_id, set()).update((r.t_seq, x) for x in range(r.t_start, r.t_end))
    lengths, edges, graph = domains.family_graph(targets)
    found = edges.localCheckpoint()
    inter = {(a, b): len(at[a] & at[b]) for a in at for b in at if a < b and at[a] & at[b]}
    assert tidy(found) == sorted((a, b, n, round(n / (len(at[a]) + len(at[b]) - n), 9)) for (a, b), n in inter.items())
    assert graph.summed.count() and graph.summed.count() <= len(inter)
    ways = dpc.directed(found, [])
    assert tidy(graph.near()) == tidy(ways.groupBy(F.col("src").alias("id")).agg(F.sum("sim").alias("near")))
    dense = lengths.selectExpr("dom_id AS id", "1 AS w", "round(dom_id % 5 / 4D, 9) AS rho")
    assert tidy(dpc.nearest_higher(dense, found, [], graph.best(dense))) == tidy(dpc.nearest_higher(dense, found, []))
    points = dense.where("id % 2 = 0")
    mine = ways.join(points.select(F.col("id").alias("src")), "src", "left_semi")
    for k in (3, 20):
        assert tidy(dpc.top_neighbours(graph.top(points, k), [], k)) == tidy(dpc.top_neighbours(mine, [], k))
    same = domains.target_overlaps(targets)[1]
    assert tidy(same.groupBy("a", "b").agg(F.sum("inter"))) == sorted((a, b, n) for (a, b), n in inter.items())
    for method in ("similarity_weighted", "traditional"):
        plain = domains.families(lengths, found, halo_method=method, halo_tau=0.2)
        assert tidy(domains.families(lengths, edges, with_densities=graph, halo_method=method, halo_tau=0.2)) == tidy(plain)


def test_pairs_are_no_rows_of_joins(targets):
    lengths, edges, graph = domains.family_graph(targets)
    for plan in (edges, graph.near(), graph.best(lengths.selectExpr("dom_id AS id", "0.5D AS rho"))):
        text = plan._jdf.queryExecution().optimizedPlan().toString()
        assert "MapInArrow" in text and "__bin" not in text


def test_whole_targets_come_to_one_task(spark, targets):
    # also from a table in buckets by target, whose files are read in parts
    met = domains.target_overlaps(targets)[1]
    assert met._jdf.queryExecution().executedPlan().toString().count("Exchange hashpartitioning(xxhash64(t_seq") == 1


def test_shares_are_rounded_as_before(spark):
    rng = random.Random(2)
    values = [0.0, 1.0, 0.5, 0.4999995, 0.0000005, 4.9999999999999994e-07, *(rng.random() for _ in range(500)), *(k / (k + 7) for k in range(300)), *((2 * k + 1) / 2e6 for k in range(0, 999_999, 7919))]
    rows = spark.createDataFrame([(v,) for v in values], "x double")
    assert [r[0] for r in rounded_share(rows, "x").collect()] == [r[0] for r in rounded(rows, "x").collect()]
