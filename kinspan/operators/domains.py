"""Domains of single queries and families of domains, from alignment hits to GFF features."""

from __future__ import annotations

import math
from collections.abc import Callable

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.scores import containment, jaccard, vote
from ..plans.components import roots
from ..plans.shared import by_key, cut
from .dpc import dpc
from .intervals import merged, overlaps, span_length, touching, unique_spans
from .meetings import Graph, meetings


def span_graph(spans: DataFrame) -> DataFrame:
    """Overlapping spans ``a < b`` of each query with ``inter``, the lengths, the Jaccard coefficient ``sim`` and the weights, if there are any."""
    both = overlaps(spans, key="q_seq", start="q_start", end="q_end", label="ord", carry=("w",) if "w" in spans.columns else ())
    length = lambda s: span_length(f"q_start_{s}", f"q_end_{s}")
    return both.select(
        "q_seq", F.col("ord_a").alias("a"), F.col("ord_b").alias("b"), "inter", length("a").alias("len_a"), length("b").alias("len_b"),
        jaccard(F.col("inter"), length("a"), length("b")).alias("sim"), *(c for c in ("w_a", "w_b") if c in both.columns),
    )


def spurious_parents(candidates: DataFrame, edges: DataFrame, min_containment: float) -> DataFrame:
    """``q_seq, id, parent``: a candidate that overlaps a better one goes to the best of these, else it stays.

    ``candidates`` has ``q_seq, id, support, len``: more support is better, then the shorter, then the smaller id.
    Edges have ``q_seq, a, b, inter, len_a, len_b``; those from ``min_containment`` on count.
    """
    if not 0 <= min_containment <= 1:
        raise ValueError("min_containment must lie between 0 and 1")
    order = Window.partitionBy("q_seq").orderBy(F.desc("support"), "len", "id")
    ranked = candidates.withColumn("rank", F.row_number().over(order)).select("q_seq", "id", "rank")
    close = edges.where(containment(F.col("inter"), F.col("len_a"), F.col("len_b")) >= min_containment)
    way = lambda x, y: F.struct(F.col(x).alias("id"), F.col(y).alias("peer"))
    both = close.select("q_seq", F.explode(F.array(way("a", "b"), way("b", "a"))).alias("e")).select("q_seq", "e.*")
    peers = ranked.select("q_seq", F.col("id").alias("peer"), F.col("rank").alias("peer_rank"))
    better = both.join(ranked, ["q_seq", "id"]).join(peers, ["q_seq", "peer"]).where("peer_rank < rank")
    best = better.groupBy("q_seq", "id").agg(F.min_by("peer", "peer_rank").alias("parent"))
    return ranked.join(best, ["q_seq", "id"], "left").select("q_seq", "id", F.coalesce("parent", "id").alias("parent"))


def domain_instances(
    hits: DataFrame,
    *,
    min_sim: float = 0.35,
    min_dens: float = 1,
    halo_method: str | None = "similarity_weighted",
    halo_tau: float = 0.5,
    point_specific: bool = False,
    reassign: bool = True,
    min_containment: float = 0.6,
) -> tuple[DataFrame, DataFrame]:
    """Domains of every query, and the spans of targets that they have.

    Domains: ``q_seq, peak, start, end, strand``; targets: ``q_seq, peak, t_seq, t_start, t_end``,
    among them each domain's own span on its query.
    """
    def of_queries(hits: DataFrame) -> tuple[DataFrame, DataFrame]:
        spans = cut(unique_spans(hits))
        graph = cut(span_graph(spans))
        # places of spans go with the nodes, so that the spans are not looked up again; a peak keeps its own label
        clusters = cut(
            dpc(
                spans.select("q_seq", F.col("ord").alias("id"), "w", "q_start", "q_end"), graph, by=["q_seq"], min_sim=min_sim, min_dens=min_dens,
                halo_method=halo_method, halo_tau=halo_tau, point_specific=point_specific, unique=True,
            ).where("label IS NOT NULL").select("q_seq", "id", "w", "q_start", "q_end", "label")
        )
        at_peak = lambda c: F.max(F.when(F.col("id") == F.col("label"), F.col(c)))
        peaks = clusters.groupBy("q_seq", "label").agg(F.sum("w").alias("support"), at_peak("q_start").alias("start"), at_peak("q_end").alias("end"))
        peaks = cut(peaks.withColumnRenamed("label", "id").withColumn("len", F.col("end") - F.col("start")))
        parents = cut(spurious_parents(peaks, graph, min_containment))
        if reassign:
            final = roots(parents, ["q_seq"]).select("q_seq", F.col("id").alias("label"), F.col("root").alias("peak"))
        else:
            final = parents.where("id = parent").select("q_seq", F.col("id").alias("label"), F.col("id").alias("peak"))
        of_span = clusters.join(final, ["q_seq", "label"]).select("q_seq", "q_start", "q_end", "peak")
        assigned = cut(hits.join(of_span, ["q_seq", "q_start", "q_end"]).select("q_seq", "peak", "t_seq", "t_start", "t_end", "t_strand"))
        voted = assigned.groupBy("q_seq", "peak").agg(vote(F.col("t_strand")).alias("strand"))
        at = peaks.select("q_seq", F.col("id").alias("peak"), "start", "end")
        domains = voted.join(at, ["q_seq", "peak"]).select("q_seq", "peak", "start", "end", "strand")
        return domains, assigned.drop("t_strand")

    domains, assigned = by_key(hits, "q_seq", of_queries)
    own = domains.select("q_seq", "peak", F.col("q_seq").alias("t_seq"), F.col("start").alias("t_start"), F.col("end").alias("t_end"))
    return domains, assigned.unionByName(own)


def number_domains(domains: DataFrame, query_order: DataFrame | None = None, range_rows: int = 500_000) -> DataFrame:
    """Domains with ``dom_id``, counted from 0 by the order of queries (``q_seq, place``; default: by q_seq), then by span.

    Counts of domains by query are summed up over the queries; domains themselves are numbered within
    their query, so that no window spans all of them.
    """
    per = cut(domains.groupBy("q_seq").agg(F.count("*").alias("n")))
    per = per.join(query_order, "q_seq") if query_order is not None else per.withColumn("place", F.col("q_seq"))
    # sorted ranges of a bounded number of queries are summed first; only their totals, one row a range, in one place
    ranges = max(1, math.ceil(per.count() / range_rows))
    per = cut(per.repartitionByRange(ranges, "place").withColumn("range", F.spark_partition_id()))
    totals = per.groupBy("range").agg(F.sum("n").alias("total"))
    before = totals.withColumn("base", F.sum("total").over(Window.orderBy("range")) - F.col("total")).select("range", "base")
    within = F.sum("n").over(Window.partitionBy("range").orderBy("place")) - F.col("n")
    offsets = per.withColumn("within", within).join(before, "range").select("q_seq", (F.col("base") + F.col("within")).alias("offset"))
    local = F.row_number().over(Window.partitionBy("q_seq").orderBy("peak")) - 1
    return domains.withColumn("local", local).join(offsets, "q_seq").withColumn("dom_id", (F.col("offset") + F.col("local")).cast("bigint")).drop("local", "offset")


#: Neighbours that a domain may meet on several spans, at most, by which its meetings are told apart; with more, all are summed up.
REPEATS = 256


def merged_targets(targets: DataFrame) -> DataFrame:
    """Unions of each domain's spans on each target."""
    return by_key(targets, "t_seq", lambda own: (merged(own, keys=["t_seq", "dom_id"], start="t_start", end="t_end"),))[0]


def target_lengths(spans: DataFrame) -> DataFrame:
    """``dom_id, len``: positions that each domain has on its targets."""
    return cut(spans.groupBy("dom_id").agg(F.sum(span_length("t_start", "t_end")).alias("len")))


def target_overlaps(targets: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Lengths of domains over their targets, and overlaps of different domains on one target.

    Spans of one domain on one target are merged first.  Lengths: ``dom_id, len``; overlaps:
    ``a < b`` and ``inter``, one row for each overlapping pair of merged spans.
    """
    spans = merged_targets(targets)
    return target_lengths(spans), meetings(spans)


def family_graph(targets: DataFrame) -> tuple[DataFrame, DataFrame, Graph]:
    """Lengths of domains, and ``a, b, inter, sim``: summed overlaps of two domains and their Jaccard coefficient.

    Third, the graph of these edges, a function that gives them with ``rho_a`` and ``rho_b`` of a table ``id, rho``, and what
    clustering asks of them without spelling them out.
    """
    spans = merged_targets(targets)
    lengths = target_lengths(spans)
    graph = Graph(spans, lengths, REPEATS)
    return lengths, graph.edges(), graph


def families(
    lengths: DataFrame,
    edges: DataFrame,
    *,
    with_densities: Callable[[DataFrame], DataFrame] | Graph | None = None,
    min_sim: float = 0.25,
    min_dens: float = 1,
    halo_method: str | None = "similarity_weighted",
    halo_tau: float = 0.5,
    point_specific: bool = False,
) -> DataFrame:
    """``dom_id, family, gamma``: the clusters of the global graph; domains that are noise have none."""
    nodes = lengths.select(F.col("dom_id").alias("id"), F.lit(1).alias("w"))
    out = dpc(
        nodes, edges.withColumns({"w_a": F.lit(1), "w_b": F.lit(1)}), min_sim=min_sim, min_dens=min_dens, halo_method=halo_method, halo_tau=halo_tau, point_specific=point_specific, unique=True,
        with_densities=with_densities,
    )
    return out.where("label IS NOT NULL").select(F.col("id").alias("dom_id"), F.col("label").alias("family"), "gamma")


def family_features(domains: DataFrame, member: DataFrame) -> DataFrame:
    """``family, q_seq, start, end, strand``: merged domains of a family on each sequence.

    A merged feature has the majority strand of the domains that it strictly overlaps.
    """
    own = cut(domains.join(member.select("dom_id", "family"), "dom_id").select("family", "q_seq", "start", "end", "strand"))
    whole = merged(own, keys=["family", "q_seq"], start="start", end="end")
    key = F.struct("family", "q_seq").alias("of")
    part = own.select(key, F.col("start").alias("s"), F.col("end").alias("e"), "strand")
    sign = F.when(F.col("strand") == "-", -1).otherwise(1)
    both = touching(whole.select(key, "start", "end"), part, key="of", left_span=("start", "end"), right_span=("s", "e"))
    voted = both.groupBy("of", "start", "end").agg(vote(sign).alias("strand"))
    return voted.select("of.family", "of.q_seq", "start", "end", "strand")


def find_domains(
    hits: DataFrame,
    *,
    min_dom_sim: float = 0.35,
    dom_halo: float = 0.5,
    min_dom_dens: float = 1,
    min_fam_sim: float = 0.25,
    fam_halo: float = 0.5,
    min_fam_dens: float = 1,
    halo_method: str | None = "similarity_weighted",
    reassign_targets: bool = True,
    min_containment: float = 0.6,
    point_specific: bool = False,
    query_order: DataFrame | None = None,
) -> DataFrame:
    """Family features of all hits, one-based and closed: ``seqid, start, end, strand, family``.

    The whole course: distinct spans, domains of each query, overlaps on targets, families, features.
    Hits are normalised ones (see ``normalise_hits``).
    """
    domains, targets = domain_instances(
        hits, min_sim=min_dom_sim, min_dens=min_dom_dens, halo_method=halo_method, halo_tau=dom_halo,
        point_specific=point_specific, reassign=reassign_targets, min_containment=min_containment,
    )
    numbered = cut(number_domains(domains, query_order))
    known = numbered.select("q_seq", "peak", "dom_id")
    lengths, edges, with_densities = family_graph(cut(targets.join(known, ["q_seq", "peak"]).select("t_seq", "t_start", "t_end", "dom_id")))
    member = families(
        lengths, edges, with_densities=with_densities, min_sim=min_fam_sim, min_dens=min_fam_dens, halo_method=halo_method, halo_tau=fam_halo, point_specific=point_specific
    )
    out = family_features(numbered, cut(member))
    return out.select(F.col("q_seq").alias("seqid"), (F.col("start") + 1).alias("start"), "end", "strand", "family")
