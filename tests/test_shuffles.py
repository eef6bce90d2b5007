"""Registered queries on spans shuffle their hits once, whatever is made of them."""

import random

import pytest
from pyspark.sql import DataFrameWriter

from kinspan.queries import QUERIES


@pytest.fixture
def written(spark, monkeypatch):
    """The plans of all tables that are written; no join is a broadcast for being small."""
    seen = []

    def noted(write):
        def wrapped(self, *args, **options):
            seen.append(self._df._jdf.queryExecution().executedPlan().toString())
            return write(self, *args, **options)

        return wrapped

    for name in ("parquet", "saveAsTable"):
        monkeypatch.setattr(DataFrameWriter, name, noted(getattr(DataFrameWriter, name)))
    before = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    yield seen
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", before)


@pytest.mark.parametrize("name", ["spurious_parent", "halo_similarity_weighted", "halo_ndcg"])
def test_hits_are_shuffled_once(spark, tmp_path, written, name):
    rng = random.Random(5)
    rows = [(o, rng.randint(0, 8), 100 + rng.randint(0, 5), n, float(rng.randint(1, 50)), rng.choice("RAN")) for o in range(60) for n in range(1, 5)]
    spark.createDataFrame(rows, "l_orderkey long, l_partkey long, l_suppkey long, l_linenumber int, l_quantity double, l_returnflag string").write.parquet(f"{tmp_path}/lineitem.parquet")
    written.clear()
    out = QUERIES[name](spark, str(tmp_path))
    assert out.count() and len(written) > 5
    plans = [*written, out._jdf.queryExecution().executedPlan().toString()]
    assert sum(line.lstrip(" :+-*()0123456789").startswith("Exchange") for p in plans for line in p.splitlines()) == 1
