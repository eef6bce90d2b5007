"""The stand-ins for biological inputs hold every row and every character of their tables."""

from collections import defaultdict

from kinspan.plans import views as V


def test_views_are_whole(spark, tmp_path):
    texts = {0: ("en", "short"), 1: ("de", "ab" * 50), 2: ("ru", "абв é" * 33), 3: ("en", "x" * 81), 4: ("en", ""), 5: ("en", None)}
    spark.createDataFrame([(i, t, g, "src", len(t or "")) for i, (g, t) in texts.items()], "doc_id long, text string, lang string, source string, n_chars long").write.parquet(f"{tmp_path}/documents.parquet")
    items = [(o, o % 7, o % 3, n, float(n), "R") for o in range(1, 400) for n in (1, 2)]
    spark.createDataFrame(items, "l_orderkey long, l_partkey long, l_suppkey long, l_linenumber int, l_quantity double, l_returnflag string").write.parquet(f"{tmp_path}/lineitem.parquet")

    cells = defaultdict(dict)
    for r in V.view(spark, str(tmp_path), V.CELLS).collect():
        cells[r["header"], int(r["dataset"].split("-")[1])][r["col"]] = r["ch"]
    for i, (_, t) in texts.items():
        whole = "".join("ACGUN-"[ord(c) % 6] for c in t or "")
        blocks = -(-len(whole) // 40)
        assert "".join(cells[i, b][c] for b in range(blocks) for c in range(40)) == whole.ljust(40 * blocks, "-")
    assert len(cells) == sum(-(-len(t or "") // 40) for _, t in texts.values())

    sequences = {r["seq_id"]: r["sequence"] for r in V.view(spark, str(tmp_path), V.SEQUENCES).collect()}
    assert {i: s and len(s) for i, s in sequences.items()} == {i: t and len(t) for i, (_, t) in texts.items()}

    features = V.view(spark, str(tmp_path), V.FEATURES).collect()
    assert len(features) == len(items) and {r["seq_id"] for r in features} == set(texts)
