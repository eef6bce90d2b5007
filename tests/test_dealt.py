"""Work within keys: one shuffle of the rows, none of what is made of them, and the same results where a key is heavy."""

import random

import pytest
from pyspark.sql import DataFrameWriter

from kinspan.operators import domains
from kinspan.operators import evaluation as E
from kinspan.operators.domains import domain_instances, target_overlaps
from kinspan.operators.dpc import HALO_METHODS
from kinspan.operators.intervals import overlaps
from kinspan.plans import shared
from kinspan.plans.shared import cut


@pytest.fixture
def hits(spark):
    rng = random.Random(11)
    rows = [(q, s := rng.randint(0, 60), s + rng.randint(1, 30), 50 + rng.randint(0, 9), t := rng.randint(0, 90), t + rng.randint(1, 30), rng.choice((-1, 1))) for q in range(12) for _ in range(10 * q)]
    return spark.createDataFrame(rows, "q_seq long, q_start int, q_end int, t_seq long, t_start int, t_end int, t_strand int")


@pytest.fixture
def plans(spark, monkeypatch):
    """The plans of the bucketed tables as they are written; no join is a broadcast for being small."""
    seen, write = [], DataFrameWriter.saveAsTable

    def noted(self, *args, **options):
        seen.append(self._df._jdf.queryExecution().executedPlan().toString())
        return write(self, *args, **options)

    monkeypatch.setattr(DataFrameWriter, "saveAsTable", noted)
    before = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    yield seen
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", before)


@pytest.mark.parametrize("method", [None, *HALO_METHODS])
def test_domains_come_of_one_shuffle(hits, plans, method):
    domain_instances(hits, halo_method=method)
    assert len(plans) > 8
    assert [p.count("Exchange") for p in plans] == [1] + [0] * (len(plans) - 1)


def test_heavy_queries_give_the_same_domains(spark, hits, monkeypatch):
    both = lambda: [sorted(map(tuple, t.collect())) for t in domain_instances(hits)]
    before, plain = spark.conf.get(shared.ALL_KEYS), both()
    monkeypatch.setattr(shared, "HEAVY", 60)
    assert both() == plain and plain[0] and spark.conf.get(shared.ALL_KEYS) == before


def test_partners_come_of_one_shuffle(spark, plans):
    rng = random.Random(3)
    rows = [(s, a := rng.randint(0, 80), a + rng.randint(1, 40), rng.choice(("ref", "pred")), f"f{rng.randint(0, 4)}", 1000 * s + i, None) for s in range(8) for i in range(12)]
    rows += [(s, None, None, None, None, None, 60 + 5 * s) for s in range(9)]
    placed = spark.createDataFrame(rows, "seq_id long, start long, end long, label_type string, label string, ord long, length long")

    def partners(own):
        features, lengths = cut(own.where("length IS NULL").drop("length")), own.where("length IS NOT NULL").select("seq_id", "length")
        parts = cut(E.segments(features, lengths))
        return parts, E.majority_partners(features, parts)

    parts, out = shared.by_key(placed, "seq_id", partners)
    assert [p.count("Exchange") for p in plans] == [1, 0, 0, 0, 0]
    plain_parts, plain = partners(placed)
    assert sorted(map(tuple, parts.collect())) == sorted(map(tuple, plain_parts.collect()))
    by_name = lambda df: sorted(map(repr, df.select(sorted(df.columns)).collect()))
    assert by_name(out) == by_name(plain)


@pytest.mark.parametrize("repeats", [256, 0])
def test_edges_of_families_are_summed_where_they_repeat(spark, monkeypatch, repeats):
    rng = random.Random(8)
    rows = [(rng.randint(0, 6), s := rng.randint(0, 200), s + rng.randint(1, 25), rng.randint(0, 40)) for _ in range(300)]
    targets = spark.createDataFrame(rows, "t_seq long, t_start int, t_end int, dom_id long")
    monkeypatch.setattr(domains, "REPEATS", repeats)
    at = {}
    for t, s, e, d in rows:
        at.setdefault(d, set()).update((t, x) for x in range(s, e))
    want = {(a, b): len(at[a] & at[b]) for a in at for b in at if a < b and at[a] & at[b]}
    lengths, edges, with_densities = domains.family_graph(targets)
    assert dict(lengths.collect()) == {d: len(x) for d, x in at.items()}
    assert {(r.a, r.b): r.inter for r in edges.collect()} == want and edges.count() == len(want)
    assert any(row[0] > 1 for row in target_overlaps(targets)[1].groupBy("a", "b").count().select("count").collect())
    out = with_densities(lengths.selectExpr("dom_id AS id", "dom_id / 4 AS rho")).collect()
    assert {(r.a, r.b): (r.rho_a, r.rho_b) for r in out} == {(a, b): (a / 4, b / 4) for a, b in want}


def test_pairs_that_meet_once_are_not_shuffled(spark):
    # 300 domains on one target, each pair of which meets there alone
    targets = spark.range(300).selectExpr("1L AS t_seq", "CAST(id AS INT) AS t_start", "CAST(id + 400 AS INT) AS t_end", "id AS dom_id")
    edges = domains.family_graph(targets)[1]
    assert edges.count() == 300 * 299 // 2
    plan = edges._jdf.queryExecution().optimizedPlan().toString()
    assert "Union" in plan and "Aggregate" not in plan


def test_no_table_is_sent_for_its_few_bytes_on_disk(spark, monkeypatch):
    seen, write = [], DataFrameWriter.saveAsTable

    def noted(self, *args, **options):
        seen.append(self._df._jdf.queryExecution().executedPlan().toString())
        return write(self, *args, **options)

    monkeypatch.setattr(DataFrameWriter, "saveAsTable", noted)
    before = spark.conf.get(shared.SENT)
    rows = spark.range(400).selectExpr("id % 3 AS k", "id AS v")
    joined = lambda own: (cut(own).join(cut(own).selectExpr("k", "v", "v + 1 AS x"), ["k", "v"]),)
    assert shared.by_key(rows, "k", joined)[0].count() == 400
    assert sum("Join" in p for p in seen) == 1 and not any("Broadcast" in p for p in seen)
    assert before != "-1" and spark.conf.get(shared.SENT) == before
    spans = spark.range(40).selectExpr("id % 3 AS k", "CAST(id AS INT) AS s", "CAST(id + 9 AS INT) AS e", "id AS v")
    later = shared.by_key(spans, "k", lambda own: (overlaps(own, key="k", start="s", end="e", label="v"),), lazy=True)[0]
    assert later.count() and "Broadcast" not in later._jdf.queryExecution().executedPlan().toString()
