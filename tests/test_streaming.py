from kinspan.operators.intervals import normalise_hits, unique_spans
from kinspan.streaming.spans import running_spans

SCHEMA = "query string, target string, qstart int, qend int, tstart int, tend int"


def test_counts_over_a_stream_are_those_of_the_whole(spark, tmp_path):
    source = tmp_path / "hits"
    source.mkdir()
    (source / "a.csv").write_text("a,b,1,9,1,9\na,c,9,1,1,9\na,a,1,5,1,5\n")
    (source / "b.csv").write_text("a,d,1,9,4,9\nb,a,3,7,1,9\n")
    raw = spark.readStream.schema(SCHEMA).option("maxFilesPerTrigger", 1).csv(f"file://{source}")
    query = running_spans(raw).writeStream.format("memory").queryName("running").outputMode("complete").option("checkpointLocation", f"file://{tmp_path}/state").trigger(availableNow=True).start()
    assert query.awaitTermination(120)
    whole = unique_spans(normalise_hits(spark.read.schema(SCHEMA).csv(f"file://{source}"))).drop("ord")
    assert sorted(map(tuple, spark.table("running").collect())) == sorted(map(tuple, whole.collect())) == [("a", 0, 9, 3), ("b", 2, 7, 1)]
