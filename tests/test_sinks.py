from pathlib import Path

from kinspan.sources.sinks import write_gml


def test_gml_in_parts(spark, tmp_path):
    spark.conf.set("spark.sql.adaptive.enabled", "false")
    try:
        nodes = spark.range(500).selectExpr("concat('n', id) AS id")
        edges = spark.range(500).selectExpr("concat('n', id) AS source", "concat('n', (id + 1) % 500) AS target", "id AS nt", "id AS seqs")
        write_gml(edges, nodes, f"{tmp_path}/gml")
    finally:
        spark.conf.unset("spark.sql.adaptive.enabled")
    parts = sorted(Path(f"{tmp_path}/gml").glob("part-*"))
    assert len(parts) > 1
    lines = "".join(p.read_text() for p in parts).splitlines()
    assert lines[0] == "graph [" and lines[-1] == "]"
    opened = [x for x in lines if x in ("  node [", "  edge [")]
    assert opened == ["  node ["] * 500 + ["  edge ["] * 500
