"""Digests of edited texts are held without the part that they share with their text."""

from pyspark.sql import functions as F

from kinspan.llm import sketches as K


def test_edited_digests_come_back(spark):
    pairs = [([1, 2, 3, 4], [1, 2, 9]), ([], []), ([1], []), ([], [1]), ([1, 2], [1, 2]), ([1, 2], [1, 2, 3]), ([1, 2, 3], [1, 2]), ([5, 1], [1, 5])]
    rows = spark.createDataFrame([(i, a, e) for i, (a, e) in enumerate(pairs)], "row long, a array<long>, e array<long>")
    held = K.packed(rows)
    assert "e" not in held.columns
    got = {r["row"]: (r["e"], r["rest"]) for r in held.select("row", F.expr(K.EDITED).alias("e"), "rest").collect()}
    assert [got[i][0] for i in range(len(pairs))] == [e for _, e in pairs]
    assert [got[i][1] for i in range(len(pairs))] == [[9], [], [], [1], [], [3], [], [1, 5]]
