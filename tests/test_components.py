import random

import pytest
from pyspark.sql import functions as F

from kinspan.plans.components import components, looked_up, roots


def plain_components(links):
    least = {}
    for a, b in links:
        least.setdefault(a, a), least.setdefault(b, b)
    changed = True
    while changed:
        changed = False
        for a, b in links:
            low = min(least[a], least[b])
            if least[a] != low or least[b] != low:
                least[a] = least[b] = low
                changed = True
    return least


@pytest.mark.parametrize("many", [3, 1000])
def test_components_agree_with_a_plain_search(spark, many):
    rnd = random.Random(many)
    star = [(0, i) for i in range(1, 40)]
    chain = [(i, i + 1) for i in range(100, 130)]
    links = star + chain + [(rnd.randint(200, 260), rnd.randint(200, 260)) for _ in range(50)]
    frame = spark.createDataFrame([*links, (5, 5), (None, 3)], "a long, b long")
    found = {r.node: r.component for r in components(frame, many=many).collect()}
    assert found == plain_components([x for x in links if x[0] != x[1]])


@pytest.mark.parametrize("many", [3, 1000])
def test_roots_of_stars_chains_and_groups(spark, many):
    rows = [(g, i, parent) for g in (1, 2) for i, parent in [(0, 0), *((i, 0) for i in range(1, 30)), *((i, i - 1) for i in range(30, 70))]]
    out = roots(spark.createDataFrame(rows, "g int, id long, parent long"), ["g"], many).collect()
    assert sorted((r.g, r.id, r.root) for r in out) == sorted((g, i, 0) for g, i, _ in rows)


def test_a_hub_of_a_million_leaves_is_dealt_to_all_tasks(spark):
    spark.conf.set("spark.sql.adaptive.enabled", "false")  # else Spark puts small parts together
    try:
        rows = spark.range(1_000_000).selectExpr("id", "0L AS parent")
        table = spark.createDataFrame([(0, 0)], "parent long, above long").join(spark.range(1), how="left").select("parent", "above").hint("merge")
        joined = looked_up(rows, table, ["parent"], "id")
        sizes = [r["count"] for r in joined.groupBy(F.spark_partition_id()).count().collect()]
        assert sum(sizes) == 1_000_000 and len(sizes) == int(spark.conf.get("spark.sql.shuffle.partitions"))
        assert max(sizes) < 3 * sorted(sizes)[len(sizes) // 2]
    finally:
        spark.conf.set("spark.sql.adaptive.enabled", "true")
    out = roots(rows, [])
    assert out.agg(F.count("*"), F.max("root")).first()[:] == (1_000_000, 0)
