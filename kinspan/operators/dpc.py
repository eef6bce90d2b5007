"""Density-peak clustering of a sparse similarity graph, as joins, groupings and windows.

``nodes`` has the group columns ``by`` (none for one global graph), ``id`` and the weight ``w``;
``edges`` has ``by``, ``a``, ``b`` and ``sim`` in [0, 1].  Densities are rounded to 9 decimals before
they are compared, as the order of a sum of doubles is not fixed; equal ones are ordered by id.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.scores import ratio
from ..plans.components import roots
from ..plans.shared import cut
from .meetings import Graph
from .quantiles import quantiles

HALO_METHODS = ("traditional", "similarity_weighted", "knn", "ndcg")


def unique_edges(edges: DataFrame, by: list[str]) -> DataFrame:
    """Edges ``a < b`` without self edges; of repeated ones, in either direction, the largest similarity."""
    ends = (F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b"))
    return edges.where("a <> b AND sim > 0").groupBy(*by, *ends).agg(F.max("sim").alias("sim"))


def directed(edges: DataFrame, by: list[str]) -> DataFrame:
    """Unique edges in both directions, ``src, dst, sim``: two rows an edge, without a shuffle.

    Edges with the weights ``w_a`` and ``w_b`` of their ends give ``w_dst``.
    """
    weighted = {"w_a", "w_b"} <= set(edges.columns)

    def way(x: str, y: str) -> Column:
        return F.struct(F.col(x).alias("src"), F.col(y).alias("dst"), *([F.col(f"w_{y}").alias("w_dst")] if weighted else []))

    return edges.select(*by, F.explode(F.array(way("a", "b"), way("b", "a"))).alias("e"), "sim").select(*by, "e.*", "sim")


def symmetric(edges: DataFrame, by: list[str]) -> DataFrame:
    """Both directions of each edge, without self edges; of repeated edges the largest similarity."""
    return directed(unique_edges(edges, by), by)


def densities(nodes: DataFrame, sym: DataFrame, by: list[str], near: DataFrame | None = None) -> DataFrame:
    """``rho``: a node's own weight and its neighbours' weights times similarity, or ``near``, where these are added up already.

    Weights that the edges have with them (``w_dst``) need no join with the nodes.
    """
    if near is None:
        if "w_dst" not in sym.columns:
            sym = sym.join(nodes.select(*by, F.col("id").alias("dst"), F.col("w").alias("w_dst")), [*by, "dst"])
        near = sym.groupBy(*by, F.col("src").alias("id")).agg(F.sum(F.col("w_dst") * F.col("sim")).alias("near"))
    rows = nodes.join(near, [*by, "id"], "left")
    return rows.withColumn("rho", F.round(F.col("w") + F.coalesce("near", F.lit(0.0)), 9)).drop("near")


def nearest_higher(dense: DataFrame, edges: DataFrame, by: list[str], likely: DataFrame | None = None) -> DataFrame:
    """``nh``, the most similar neighbour of higher density, its similarity ``smax`` (0 without one) and ``gamma``.

    Of the two ends of an edge one is the denser, so each unique edge is looked at once, from its other end.
    Edges that have ``rho_a`` and ``rho_b`` need no join with the nodes.  ``likely`` (``id, sim, rho_up, up``), where
    neighbours are picked already, has the one among them.
    """
    if likely is None:
        likely = _denser(dense, edges, by)
    best = likely.groupBy(*by, "id").agg(F.max(F.struct("sim", "rho_up", (-F.col("up")).alias("last"), F.col("up").alias("nh"))).alias("best"))
    rows = dense.join(best, [*by, "id"], "left").select(*dense.columns, F.col("best.nh").alias("nh"), F.coalesce("best.sim", F.lit(0.0)).alias("smax"))
    return rows.withColumn("gamma", F.col("rho") * (1 - F.col("smax")))


def _denser(dense: DataFrame, edges: DataFrame, by: list[str]) -> DataFrame:
    """Of each edge the less dense end ``id``, the other one ``up`` and its density."""
    end = lambda e: dense.select(*by, F.col("id").alias(e), F.col("rho").alias(f"rho_{e}"))
    if "rho_a" in edges.columns:
        ends = edges
    else:
        ends = edges.select(*by, "a", "b", "sim").join(end("a"), [*by, "a"]).join(end("b"), [*by, "b"])
    b_higher = F.col("rho_b") > F.col("rho_a")  # a < b, so that a goes first among equals
    pick = lambda x, y: F.when(b_higher, F.col(x)).otherwise(F.col(y))
    return ends.select(*by, pick("a", "b").alias("id"), pick("b", "a").alias("up"), pick("rho_b", "rho_a").alias("rho_up"), "sim")


def top_neighbours(sym: DataFrame, by: list[str], k: int = 20) -> DataFrame:
    """The k most similar neighbours of each node and their ``rank``; equal similarities by id."""
    order = Window.partitionBy(*by, "src").orderBy(F.desc("sim"), "dst")
    return sym.select(*by, "src", "dst", "sim").withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)


def border_scores(points: DataFrame, labelled: DataFrame, sym: DataFrame, by: list[str], method: str, tau: float, k: int = 20, graph: Graph | None = None) -> DataFrame:
    """``score``: how foreign the neighbours of each of the labelled ``points`` are; unlabelled ones count as foreign.

    Only neighbours of these points are ranked, so that the rest of the graph is not sorted; ``graph`` picks them where it finds them.
    """
    own = points.select(*by, F.col("id").alias("src"), F.col("label").alias("own"))
    other = labelled.select(*by, F.col("id").alias("dst"), F.col("label").alias("theirs"))
    if graph is not None and method != "traditional":
        sym = graph.top(points, k)
    else:
        sym = sym.select(*by, "src", "dst", "sim").join(own.select(*by, "src"), [*by, "src"], "left_semi")
    near = sym.where(F.col("sim") >= tau) if method == "traditional" else top_neighbours(sym, by, k)
    rows = near.join(own, [*by, "src"]).join(other, [*by, "dst"])
    foreign = ~F.col("own").eqNullSafe(F.col("theirs"))
    groups = rows.groupBy(*by, F.col("src").alias("id"))
    if method == "traditional":
        return groups.agg(F.coalesce(F.max(F.when(foreign, F.col("sim"))), F.lit(0.0)).alias("score"))
    if method == "similarity_weighted":
        mass = groups.agg(F.sum(F.when(foreign, F.col("sim")).otherwise(0.0)).alias("x"), F.sum("sim").alias("y"))
    elif method == "knn":
        mass = groups.agg(F.count_if(foreign).alias("x"), F.count("*").alias("y"))
    else:
        gain = 1 / F.log2(F.col("rank") + 1)
        mass = groups.agg(F.sum(F.when(foreign, gain).otherwise(0.0)).alias("x"), F.count_if(foreign).cast("int").alias("n"))
        ideal = F.expr("IF(n = 0, 0D, aggregate(sequence(1, n), 0D, (s, r) -> s + 1 / log2(r + 1)))")
        mass = mass.withColumn("y", ideal)
    return mass.select(*by, "id", F.round(ratio(F.col("x"), F.col("y")), 9).alias("score"))


def halo(labelled: DataFrame, sym: DataFrame, by: list[str], *, method: str, tau: float, min_size: int = 3, k: int = 20, point_specific: bool = False, graph: Graph | None = None) -> DataFrame:
    """``labelled`` with the labels of halo points set to null.

    Clusters of fewer than ``min_size`` points, and groups with a single cluster, are left as they are.
    By cluster, points less dense than its densest border point go; point by point, border points
    less dense than their cluster's median.
    """
    named = labelled.where("label IS NOT NULL")
    sizes = named.groupBy(*by, "label").agg(F.count("*").alias("size"))
    many = sizes.groupBy(*by).agg(F.count("*").alias("n_clusters")).where("n_clusters > 1")
    open_ = sizes.where(F.col("size") >= min_size)
    open_ = open_.join(many, by, "left_semi") if by else open_.crossJoin(F.broadcast(many)).drop("n_clusters")  # one row or none
    if point_specific:
        open_ = open_.join(quantiles(named, [*by, "label"], "rho", {"mid": 0.5}), [*by, "label"])
    points = cut(named.select(*by, "id", "label", "rho").join(open_.drop("size"), [*by, "label"]))
    scores = border_scores(points, labelled, sym, by, method, tau, k, graph).where((F.col("score") >= tau) & (F.col("score") > 0))
    border = points.join(scores, [*by, "id"])
    if point_specific:
        gone = border.where("rho < mid").select(*by, "id", F.lit(True).alias("__gone"))
        rows = labelled.join(gone, [*by, "id"], "left")
        stays = F.col("__gone").isNull()
    else:
        edge = border.groupBy(*by, "label").agg(F.max("rho").alias("__edge"))
        rows = labelled.join(edge, [*by, "label"], "left")
        stays = F.col("__edge").isNull() | (F.col("rho") >= F.col("__edge"))
    return rows.withColumn("label", F.when(stays, F.col("label"))).select(labelled.columns)


def dpc(
    nodes: DataFrame,
    edges: DataFrame,
    *,
    by: list[str] | None = None,
    min_sim: float,
    min_dens: float,
    halo_method: str | None = "similarity_weighted",
    halo_tau: float = 0.5,
    halo_min_size: int = 3,
    halo_k: int = 20,
    point_specific: bool = False,
    unique: bool = False,
    with_densities: Callable[[DataFrame], DataFrame] | Graph | None = None,
) -> DataFrame:
    """Nodes with ``rho, smax, nh, gamma`` and ``label``, the id of their cluster's peak (null: noise).

    A peak is at least ``min_dens`` dense and less than ``min_sim`` similar to its nearest denser
    neighbour; other points follow theirs, and are noise where this ends at no peak.  ``unique`` says that
    the edges are pairs ``a < b``, each there once and more than 0 similar, which saves a shuffle of them.
    ``with_densities`` gives the same edges with ``rho_a`` and ``rho_b``, where that takes less than to join them with the nodes;
    a ``Graph`` of nodes of weight 1 says what is asked of them without spelling them out.
    """
    by = by or []
    if not 0 < min_sim < 1:
        raise ValueError("min_sim must lie between 0 and 1")
    if halo_method not in (None, "none", *HALO_METHODS):
        raise ValueError(f"unknown halo method {halo_method!r}")
    if halo_tau < 0 or min_dens < 0:
        raise ValueError("halo_tau and min_dens must not be negative")
    fits = (F.col("sim") >= 0) & (F.col("sim") <= 1)
    edges = edges.withColumn("sim", F.when(fits, F.col("sim")).otherwise(F.raise_error(F.lit("similarities must lie between 0 and 1")).cast("double")))
    edges = edges.select(*by, "a", "b", "sim", *(c for c in ("w_a", "w_b") if c in edges.columns)) if unique else cut(unique_edges(edges, by))
    sym = directed(edges, by)
    graph = with_densities if isinstance(with_densities, Graph) else None
    dense = cut(densities(nodes, sym, by, graph.near() if graph else None))
    if graph:
        state = nearest_higher(dense, edges, by, graph.best(dense))
    else:
        state = nearest_higher(dense, with_densities(dense) if with_densities else edges, by)
    state = cut(state.withColumn("peak", (F.col("rho") >= min_dens) & (F.col("nh").isNull() | (F.col("smax") < min_sim))))
    forest = state.withColumn("parent", F.when(F.col("peak"), F.col("id")).otherwise(F.coalesce("nh", "id")))
    found = roots(forest, by)
    peaks = state.where("peak").select(*by, F.col("id").alias("root"), F.col("id").alias("label"))
    labelled = state.drop("peak").join(found.join(peaks, [*by, "root"], "left").drop("root"), [*by, "id"])
    if halo_method in (None, "none") or halo_tau >= 1:
        return labelled
    return halo(cut(labelled), sym, by, method=halo_method, tau=halo_tau, min_size=halo_min_size, k=halo_k, point_specific=point_specific, graph=graph)
