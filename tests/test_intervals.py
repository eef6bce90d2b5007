import random

import numpy as np
import pytest
from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from kinspan.operators import intervals
from kinspan.operators.domains import find_domains, number_domains, span_graph, target_overlaps
from kinspan.operators.intervals import encode, merged, normalise_hits, overlaps, stabbed, touching, unique_spans
from kinspan.operators.quantiles import quantiles
from kinspan.functions.scores import vote

RAW = "query string, target string, qstart int, qend int, tstart int, tend int"


def test_strands_and_coordinates(spark):
    raw = spark.createDataFrame([("a", "b", 100, 10, 10, 100), ("a", "c", 20, 80, 80, 20), ("a", "d", 90, 30, 90, 30), ("a", "a", -5, 0, 0, 0)], RAW)
    rows = {r["t_seq"]: r for r in normalise_hits(raw).collect()}
    assert {k: v["t_strand"] for k, v in rows.items()} == {"b": -1, "c": -1, "d": 1}
    assert (rows["b"]["q_start"], rows["b"]["q_end"]) == (9, 100)


def test_bad_coordinates_are_an_error(spark):
    with pytest.raises(Exception, match="below 1"):
        normalise_hits(spark.createDataFrame([("a", "b", 0, 10, 1, 5)], RAW)).collect()


def test_unknown_name_is_a_key_error(spark):
    registry = spark.createDataFrame([(0, "a")], "seq_id long, seq_name string")
    with pytest.raises(KeyError):
        encode(spark.createDataFrame([("a",), ("x",)], "q_seq string"), registry, "q_seq")


@pytest.mark.parametrize(
    ("spans", "expected"),
    [
        ([(10, 50), (50, 90)], [(10, 90)]),
        ([(10, 50), (51, 90)], [(10, 50), (51, 90)]),
        ([(10, 50), (30, 80), (100, 150)], [(10, 80), (100, 150)]),
        ([(10, 100), (20, 50), (120, 150)], [(10, 100), (120, 150)]),
    ],
)
def test_merge(spark, spans, expected):
    df = spark.createDataFrame([(1, *s) for s in spans], "k int, s int, e int")
    assert sorted((r["s"], r["e"]) for r in merged(df, keys=["k"], start="s", end="e").collect()) == expected


def plain_union(spans):
    out = []
    for s, e in sorted(spans):
        if out and s <= out[-1][1]:
            out[-1][1] = max(out[-1][1], e)
        else:
            out.append([s, e])
    return [tuple(x) for x in out]


@pytest.mark.parametrize("seed", range(4))
def test_unions_and_places_of_one_key_across_bins(spark, seed, monkeypatch):
    monkeypatch.setattr(intervals, "BIN", 4)
    rnd = random.Random(seed)
    # all spans on one key; some reach over many bins
    spans = [(s := rnd.randint(0, 3000), s + rnd.choice((1, 3, 9, 40, 600 if rnd.random() < 0.1 else 5))) for _ in range(150)]
    df = spark.createDataFrame([(1, 2, *s) for s in spans], "k int, m int, s int, e int")
    out = merged(df, keys=["k", "m"], start="s", end="e")
    assert sorted((r.s, r.e) for r in out.collect()) == plain_union(spans)
    hits = spark.createDataFrame([(7, *s) for s in spans], "q_seq long, q_start int, q_end int")
    placed = {(r.q_start, r.q_end): r.ord for r in unique_spans(hits).collect()}
    assert placed == {s: i for i, s in enumerate(sorted(set(spans)))}


def test_one_key_with_all_spans_is_spread_over_tasks(spark):
    df = spark.range(400_000).selectExpr("1 AS k", "CAST(id * 5 AS INT) AS s", "CAST(id * 5 + 3 AS INT) AS e")
    out = merged(df, keys=["k"], start="s", end="e")
    assert out.count() == 400_000
    windows = [x for x in out._jdf.queryExecution().optimizedPlan().toString().splitlines() if "Window" in x]
    assert windows and all("__bin" in x for x in windows)  # none spans the key's rows


@pytest.mark.parametrize("longest", [12, 900])
def test_overlaps_of_two_tables_agree_with_all_pairs(spark, longest):
    rnd = random.Random(longest)
    span = lambda: (s := rnd.randint(0, 60), s + rnd.choice((0, 1, rnd.randint(1, 9), rnd.randint(1, longest))))
    x, y = ([(rnd.choice("ab"), i, *span()) for i in range(60)] for _ in range(2))
    left, right = spark.createDataFrame(x, "k string, i int, s long, e long"), spark.createDataFrame(y, "k string, j int, t long, u long")
    out = touching(left, right, key="k", left_span=("s", "e"), right_span=("t", "u"))
    assert out.columns == ["k", "i", "s", "e", "j", "t", "u"]
    wanted = [(a[1], b[1]) for a in x for b in y if a[0] == b[0] and a[2] < a[3] and b[2] < b[3] and a[2] < b[3] and b[2] < a[3]]
    assert sorted((r.i, r.j) for r in out.collect()) == sorted(wanted) and wanted
    assert touching(left.limit(0), right, key="k", left_span=("s", "e"), right_span=("t", "u")).count() == 0


@pytest.mark.parametrize("weighted", [False, True])
def test_quantiles_are_exact(spark, weighted):
    rnd = random.Random(4)
    rows = [(g, rnd.choice((rnd.randint(-3, 3) / 2, rnd.uniform(-1e6, 1e6), 1e-9 * rnd.randint(0, 9))), rnd.randint(1, 4)) for g in (1, 1, 1, 2, 3) for _ in range(40)] + [(4, 7.5, 3), (5, None, 2)]
    frame = spark.createDataFrame(rows, "g int, v double, c int")
    out = {r.g: (r.low, r.mid, r.high) for r in quantiles(frame, ["g"], "v", {"low": 0.1, "mid": 0.5, "high": 0.75}, "c" if weighted else None).collect()}
    for g in (1, 2, 3, 4):
        values = [v for k, v, c in rows if k == g for _ in range(c if weighted else 1)]
        assert out[g] == pytest.approx([np.quantile(values, p) for p in (0.1, 0.5, 0.75)], rel=1e-12)
    assert set(out) == {1, 2, 3, 4}


@pytest.mark.parametrize("longest", [30, 3000])
def test_overlaps_agree_with_all_pairs(spark, longest):
    @settings(max_examples=8, deadline=None, suppress_health_check=[HealthCheck.function_scoped_fixture])
    @given(st.lists(st.tuples(st.integers(0, 2), st.integers(0, 40), st.integers(1, longest)), min_size=1, max_size=25))
    def check(rows):
        spans = [(k, i, s, s + n) for i, (k, s, n) in enumerate(rows)]
        df = spark.createDataFrame(spans, "k int, id int, s int, e int")
        got = {(r["id_a"], r["id_b"], r["inter"]) for r in overlaps(df, key="k", start="s", end="e", label="id").collect()}
        assert got == {
            (a[1], b[1], min(a[3], b[3]) - max(a[2], b[2]))
            for a in spans for b in spans
            if a[0] == b[0] and a[1] < b[1] and min(a[3], b[3]) > max(a[2], b[2])
        }

    check()


def test_votes(spark):
    df = spark.createDataFrame([("a", -1), ("a", -1), ("a", 1), ("b", 1), ("b", -1)], "k string, s int")
    assert dict(df.groupBy("k").agg(vote(F.col("s"))).collect()) == {"a": "-", "b": "+"}


def test_target_overlap(spark):
    df = spark.createDataFrame([(5, 10, 50, 0), (5, 30, 70, 0), (5, 20, 60, 1)], "t_seq int, t_start int, t_end int, dom_id long")
    lengths, pairs = target_overlaps(df)
    assert dict(lengths.collect()) == {0: 60, 1: 40}
    assert [tuple(r) for r in pairs.collect()] == [(0, 1, 40)]


def test_small_run(spark):
    raw = spark.createDataFrame([(0, 1, 10, 60, 20, 70), (0, 2, 15, 65, 30, 80), (1, 2, 25, 75, 35, 85)], "query long, target long, qstart int, qend int, tstart int, tend int")
    hits = normalise_hits(raw)
    sim = span_graph(unique_spans(hits)).collect()
    assert [(r["inter"], round(r["sim"], 4)) for r in sim] == [(46, 0.8214)]
    for parts in (1, 5):
        out = find_domains(hits.repartition(parts), min_dom_sim=0.2, min_fam_sim=0.1, min_dom_dens=0, min_fam_dens=0, halo_method=None, min_containment=0.5)
        assert sorted(map(tuple, out.collect())) == [(0, 10, 60, "+", 0), (1, 25, 75, "+", 0)]


def test_stabbed_agrees_with_all_pairs(spark):
    rng = random.Random(5)
    spans = [(rng.randint(0, 2), i, s, s + rng.choice([0, 1, 2, 7, 64, 900])) for i in range(60) for s in [rng.randint(0, 900)]]
    points = [(rng.randint(0, 2), rng.randint(0, 1000)) for _ in range(80)]
    df = spark.createDataFrame(spans, "k int, id int, s int, e int")
    got = stabbed(spark.createDataFrame(points, "k int, p int"), df, key="k", at="p", start="s", end="e").select("k", "p", "id").collect()
    assert sorted(map(tuple, got)) == sorted((k, p, i) for k, p in points for q, i, s, e in spans if k == q and s <= p < e)
    assert stabbed(spark.createDataFrame(points, "k int, p int"), df.where("false"), key="k", at="p", start="s", end="e").count() == 0


def test_domains_are_numbered_over_ranges(spark):
    rng = random.Random(6)
    rows = sorted({(rng.randint(0, 40), rng.randint(0, 99)) for _ in range(200)})
    df = spark.createDataFrame(rows, "q_seq long, peak long")
    for size in (3, 500_000):
        got = sorted((r["q_seq"], r["peak"], r["dom_id"]) for r in number_domains(df, range_rows=size).collect())
        assert got == [(q, p, i) for i, (q, p) in enumerate(rows)]
    order = spark.createDataFrame([(q, -q) for q in range(41)], "q_seq long, place long")
    got = sorted((r["dom_id"], r["q_seq"], r["peak"]) for r in number_domains(df, order, range_rows=3).collect())
    assert [x[1:] for x in got] == sorted(rows, key=lambda x: (-x[0], x[1])) and [x[0] for x in got] == list(range(len(rows)))
