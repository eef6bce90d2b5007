"""Whole runs over files: hits to families, features to sequences, labels to an evaluation."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .operators import domains as D
from .operators import evaluation as E
from .operators import extraction as X
from .plans.shared import cut
from .sources import fasta, gff, hits, sinks


def find_domains(spark: SparkSession, tsv_path: str, fasta_path: str, output_gff: str | None = None, **options: object) -> DataFrame:
    """Families of domains from a BLAST-TAB file: ``seqid, start, end, strand, family``; optionally written as GFF3.

    Options are those of ``operators.domains.find_domains``.  Domains are numbered as the file lists their queries.
    """
    registry = cut(fasta.registry(spark, fasta_path))
    found = cut(hits.read_blast_tab(spark, tsv_path, registry))
    out = D.find_domains(found, query_order=cut(hits.query_order(found)), **options)
    named = out.withColumnRenamed("seqid", "seq_id").join(registry, "seq_id").select(F.col("seq_name").alias("seqid"), "start", "end", "strand", "family")
    if output_gff is not None:
        named = cut(named)
        sinks.write_gff(named, output_gff)
    return named


def extract_sequences(
    spark: SparkSession, fasta_path: str, gff_path: str, secondary_gff: str | None = None, *, flank: int = 0, max_density: float = 0.05, preserve_case: bool = True
) -> tuple[DataFrame, DataFrame | None]:
    """Sequences of the features of a GFF3 file, and a second file's features in their coordinates."""
    features = gff.read_gff(spark, gff_path).withColumn("row", F.monotonically_increasing_id())
    found = X.extract(features, fasta.sequences(spark, fasta_path, upper=not preserve_case), flank=flank, max_density=max_density, preserve_case=preserve_case)
    return found, X.remap(found, gff.read_gff(spark, secondary_gff)) if secondary_gff else None


def evaluate_clustering(spark: SparkSession, fasta_path: str, reference_gff: str, predicted_gff: str, annotation_tsv: str | None = None, report: str | None = None) -> dict[str, DataFrame]:
    """Predicted against reference labels: a table for each part of the report.

    ``scores``: adjusted Rand index, normalised mutual information, sequences and positions; ``pairs``: pair
    statistics by label type and cutoff; ``clusters``: quartiles by type; ``coverage`` by type;
    ``glued_refs``, ``split_refs`` (with more than one prediction) and ``all_refs``; ``error_nodes`` and
    ``error_edges``.
    """
    lengths = cut(fasta.lengths(spark, fasta_path))
    annotation = gff.read_annotation(spark, annotation_tsv) if annotation_tsv else None
    both = gff.labelled_features(spark, reference_gff, "ref", lengths, annotation).unionByName(gff.labelled_features(spark, predicted_gff, "pred", lengths))
    features = cut(both)
    parts = cut(E.segments(features, lengths))
    spoken = E.with_unlabelled(parts).select("ref", "pred", "seq_id", (F.col("end") - F.col("start")).alias("len"))
    table = cut(E.contingency(spoken))
    totals = lengths.agg(F.count("*").alias("total_seqs"), F.sum("length").alias("total_nt"))
    clipped = features.join(lengths, "seq_id").withColumn("end", F.least("end", "length")).drop("length")
    partners = cut(E.majority_partners(clipped, parts))
    pairs = None
    for kind in ("ref", "pred"):
        for percent in (50, 75, 90):
            one = partners.where(F.col("label_type") == kind).select("label", F.col(f"partner_{percent}").alias("partner"))
            row = E.pair_statistics(one).select(F.lit(kind).alias("label_type"), F.lit(percent).alias("cutoff"), "*")
            pairs = row if pairs is None else pairs.unionByName(row)
    counts = cut(E.label_counts(features))
    cover = E.coverage(parts, "ref").withColumn("label_type", F.lit("ref")).unionByName(E.coverage(parts, "pred").withColumn("label_type", F.lit("pred")))
    edges = cut(E.error_edges(table))
    names = features.groupBy(F.col("label").alias("id")).agg(F.max("desc").alias("description"))
    numbers = counts.groupBy(F.col("label").alias("id")).agg(F.sum("domains").alias("domain_count"), F.sum("seqs").alias("seq_count"), F.sum("nucleotides").alias("nt_count"))
    out = {
        "scores": E.adjusted_rand(table).crossJoin(E.normalised_mutual_information(table)).crossJoin(totals),  # one row each
        "pairs": pairs,
        "clusters": E.label_quartiles(counts),
        "coverage": cover,
        "glued_refs": E.mixed(table, "pred"),
        "split_refs": E.mixed(table, "ref"),
        "all_refs": E.mixed(table, "ref", least=1),
        "error_edges": edges,
        "error_nodes": names.join(numbers, "id"),
    }
    if report is not None:
        sinks.write_reports(out, report)
        sinks.write_gml(edges, out["error_nodes"].where(F.col("id").isNotNull()), f"{report}/error_network")
    return out
