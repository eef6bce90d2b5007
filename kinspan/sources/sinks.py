"""Writers: text formats through Spark's text sink, reports as CSV."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.sequences import standardise


def _write(values: DataFrame, path: str, order: list[str | Column], one_file: bool) -> None:
    """Lines in order; in one file only where the caller says that they are few."""
    rows = values.orderBy(*order)
    (rows.coalesce(1) if one_file else rows).select("value").write.mode("overwrite").text(path)


def write_gff(features: DataFrame, path: str, *, source: str = "mmseqs2", one_file: bool = False) -> None:
    """Family features ``seqid, start, end, strand, family`` as GFF3, by family, sequence and start."""
    line = F.concat_ws("\t", "seqid", F.lit(source), F.lit("Domain"), "start", "end", F.lit("."), "strand", F.lit("."), F.concat(F.lit("ID="), "family"))
    rows = features.select("family", "seqid", "start", line.alias("value"))
    head = features.sparkSession.range(1).select(F.lit(None).cast("long").alias("family"), F.lit("").alias("seqid"), F.lit(0).alias("start"), F.lit("##gff-version 3").alias("value"))
    rows = rows.select(F.col("family").cast("long"), F.col("seqid").cast("string"), "start", "value")
    _write(head.unionByName(rows), path, [F.col("family").asc_nulls_first(), "seqid", "start"], one_file)


def write_fasta(sequences: DataFrame, path: str, *, to_dna: bool = False, one_file: bool = False) -> None:
    """Sequences ``header, sequence`` on single lines."""
    seq = standardise(F.col("sequence"), to_rna=False) if to_dna else F.col("sequence")
    _write(sequences.select("header", F.concat(F.lit(">"), "header", F.lit("\n"), seq).alias("value")), path, ["header"], one_file)


def export_by_feature(sequences: DataFrame, remapped: DataFrame | None, path: str) -> None:
    """A folder of FASTA (and of GFF3) for each feature, named by what stands before ``::`` in the header, else before ``_``."""
    fid = F.when(F.instr("header", "::") > 0, F.substring_index("header", "::", 1)).otherwise(F.substring_index("header", "_", 1))
    rows = sequences.select(fid.alias("feature_id"), "header", F.concat(F.lit(">"), "header", F.lit("\n"), "sequence").alias("value"))
    ordered = rows.repartition("feature_id").sortWithinPartitions("feature_id", "header")
    ordered.select("feature_id", "value").write.mode("overwrite").partitionBy("feature_id").text(f"{path}/fasta")
    if remapped is not None:
        columns = ["seqid", "source", "type", "start", "end", "score", "strand", "phase", "attributes"]
        have = [F.coalesce(F.col(c).cast("string"), F.lit(".")) if c in remapped.columns else F.lit(".") for c in columns]
        lines = remapped.select(F.col("parent_feature_id").alias("feature_id"), "seqid", "start", F.concat_ws("\t", *have).alias("value"))
        ordered = lines.repartition("feature_id").sortWithinPartitions("feature_id", "seqid", "start")
        ordered.select("feature_id", "value").write.mode("overwrite").partitionBy("feature_id").text(f"{path}/gff")


def write_stockholm(aligned: DataFrame, path: str, structure: str | None = None) -> None:
    """Aligned sequences ``header, sequence`` as one Stockholm file (an alignment is small), with a consensus structure where given."""
    spark = aligned.sparkSession
    body = aligned.select(F.lit(1).alias("k"), "header", F.format_string("%-30s %s", "header", "sequence").alias("value"))
    ends = [(0, "", "# STOCKHOLM 1.0\n"), (3, "", "//")]
    if structure is not None:
        ends.append((2, "", f"{'#=GC SS_cons':<30} {structure}"))
    _write(body.unionByName(spark.createDataFrame(ends, "k int, header string, value string")), path, ["k", "header"], True)


def write_reports(tables: dict[str, DataFrame], path: str) -> None:
    """Each table as CSV with a header below ``path``, in place of a workbook's sheets."""
    for name, table in tables.items():
        table.write.mode("overwrite").csv(f"{path}/{name}", header=True)


def write_gml(edges: DataFrame, nodes: DataFrame, path: str, *, one_file: bool = False) -> None:
    """Error graph in GML: ``nodes`` have ``id`` (the label) and attributes, ``edges`` ``source, target, nt, seqs``.

    Nodes are named by their labels, so that they need no numbers.  The part files in order are the graph.
    """
    spark = edges.sparkSession
    quoted = lambda c: F.concat(F.lit('"'), F.regexp_replace(F.col(c).cast("string"), '"', "&quot;"), F.lit('"'))
    extra = [c for c in nodes.columns if c != "id"]
    attributes = [F.concat(F.lit(f"    {c} "), quoted(c)) for c in extra]
    node = F.concat_ws("\n", F.lit("  node ["), F.concat(F.lit("    id "), F.abs(F.xxhash64("id")).cast("string")), F.concat(F.lit("    label "), quoted("id")), *attributes, F.lit("  ]"))
    edge = F.concat_ws(
        "\n", F.lit("  edge ["), F.concat(F.lit("    source "), F.abs(F.xxhash64("source")).cast("string")), F.concat(F.lit("    target "), F.abs(F.xxhash64("target")).cast("string")),
        F.concat(F.lit("    nt "), F.col("nt")), F.concat(F.lit("    seqs "), F.col("seqs")), F.lit("  ]"),
    )
    rows = nodes.select(F.lit(1).alias("k"), F.col("id").alias("s"), node.alias("value"))
    rows = rows.unionByName(edges.select(F.lit(2).alias("k"), F.concat_ws("\t", "source", "target").alias("s"), edge.alias("value")))
    ends = spark.createDataFrame([(0, "", "graph ["), (3, "", "]")], "k int, s string, value string")
    _write(rows.unionByName(ends), path, ["k", "s"], one_file)
