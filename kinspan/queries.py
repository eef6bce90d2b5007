"""The registered queries on the test tables, and the same results in SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .functions import sequences as S
from .operators import alignment as A
from .operators import domains as D
from .operators import dpc as P
from .operators import evaluation as E
from .operators import extraction as X
from .operators import intervals as I
from .plans import views as V
from .plans.shared import by_key, cut

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
ORACLE: dict[str, str] = {}
MIN_SIM, MIN_DENS, TAU, CONTAINED = 0.35, 1, 0.5, 0.6


def query(sql: str | None = None) -> Callable[[Query], Query]:
    """Register a query under its name, with its SQL where there is one."""

    def add(f: Query) -> Query:
        QUERIES[f.__name__] = f
        if sql:
            ORACLE[f.__name__] = sql
        return f

    return add


def hits(spark: SparkSession, d: str) -> DataFrame:
    return V.view(spark, d, V.HITS)


def features(spark: SparkSession, d: str) -> DataFrame:
    return V.view(spark, d, V.FEATURES)


def aligned(spark: SparkSession, d: str) -> DataFrame:
    return V.view(spark, d, V.CELLS)


def aligned_rows(spark: SparkSession, d: str, *keys: str) -> DataFrame:
    return V.aligned_rows(spark, d, *keys)


def labels(spark: SparkSession, d: str) -> DataFrame:
    return V.view(spark, d, V.LABELS)


def rounded(df: DataFrame, *columns: str) -> DataFrame:
    """Six decimals, rounded as a binary number, which is how DuckDB does it."""
    return df.withColumns({c: F.round(F.col(c) * 1e6) / 1e6 for c in columns})


def rounded_share(df: DataFrame, column: str) -> DataFrame:
    """The same of a number from 0 to 1, without its decimal form, for results of very many rows."""
    x = F.col(column) * 1e6
    return df.withColumn(column, (F.floor(x) + F.when(x - F.floor(x) >= 0.5, 1).otherwise(0)) / 1e6)


# ---- hits, spans and local densities

HITS = f"hits AS MATERIALIZED ({V.plain(V.HITS)})"
SPANS = f"""{HITS}, spans AS MATERIALIZED (
    SELECT q_seq, q_start, q_end, count(*) AS w, row_number() OVER (PARTITION BY q_seq ORDER BY q_start, q_end) - 1 AS ord
    FROM hits GROUP BY q_seq, q_start, q_end)"""
GRAPH = f"""{SPANS}, graph AS MATERIALIZED (
    SELECT q_seq, a, b, inter, len_a, len_b, inter / CAST(len_a + len_b - inter AS DOUBLE) AS sim
    FROM (SELECT x.q_seq, x.ord AS a, y.ord AS b, least(x.q_end, y.q_end) - greatest(x.q_start, y.q_start) AS inter,
                 x.q_end - x.q_start AS len_a, y.q_end - y.q_start AS len_b
          FROM spans x JOIN spans y ON x.q_seq = y.q_seq AND x.ord < y.ord AND x.q_start < y.q_end AND y.q_start < x.q_end))"""
DENSE = f"""{GRAPH}, sym AS MATERIALIZED (
    SELECT q_seq, a AS src, b AS dst, sim FROM graph UNION ALL SELECT q_seq, b, a, sim FROM graph
), dense AS MATERIALIZED (
    SELECT s.q_seq, s.ord AS id, s.w, round(s.w + coalesce(sum(o.w * y.sim), 0), 9) AS rho
    FROM spans s LEFT JOIN sym y ON y.q_seq = s.q_seq AND y.src = s.ord LEFT JOIN spans o ON o.q_seq = y.q_seq AND o.ord = y.dst
    GROUP BY s.q_seq, s.ord, s.w)"""
STATE = f"""{DENSE}, higher AS MATERIALIZED (
    SELECT * FROM (
        SELECT y.q_seq, y.src AS id, y.dst AS nh, y.sim AS smax,
               row_number() OVER (PARTITION BY y.q_seq, y.src ORDER BY y.sim DESC, b.rho DESC, y.dst) AS n
        FROM sym y JOIN dense a ON a.q_seq = y.q_seq AND a.id = y.src JOIN dense b ON b.q_seq = y.q_seq AND b.id = y.dst
        WHERE b.rho > a.rho OR (b.rho = a.rho AND y.dst < y.src)) WHERE n = 1
), state AS MATERIALIZED (
    SELECT q_seq, id, w, rho, nh, coalesce(smax, 0) AS smax, rho * (1 - coalesce(smax, 0)) AS gamma,
           rho >= {MIN_DENS} AND (nh IS NULL OR smax < {MIN_SIM}) AS peak,
           CASE WHEN rho >= {MIN_DENS} AND (nh IS NULL OR smax < {MIN_SIM}) THEN id ELSE coalesce(nh, id) END AS parent
    FROM dense LEFT JOIN higher USING (q_seq, id))"""
LABELLED = f"""{STATE}, up AS (
    SELECT q_seq, id, parent AS at FROM state
    UNION ALL
    SELECT u.q_seq, u.id, s.parent FROM up u JOIN state s ON s.q_seq = u.q_seq AND s.id = u.at WHERE s.parent <> s.id
), labelled AS MATERIALIZED (
    SELECT s.q_seq, s.id, s.w, s.rho, s.gamma, CASE WHEN r.peak THEN r.id END AS label
    FROM up u JOIN state r ON r.q_seq = u.q_seq AND r.id = u.at AND r.parent = r.id JOIN state s ON s.q_seq = u.q_seq AND s.id = u.id)"""


@query(f"WITH {HITS} SELECT * FROM hits")
def hits_normalize(spark: SparkSession, d: str) -> DataFrame:
    raw = spark.read.parquet(f"{d}/lineitem.parquet").select(
        F.col("l_partkey").cast("long").alias("query"), F.col("l_suppkey").cast("long").alias("target"),
        ((F.col("l_orderkey") % 6) * 150 + F.col("l_linenumber") * 4).alias("q0"),
        ((F.col("l_orderkey") % 5) * 180 + F.col("l_linenumber") * 3).alias("t0"), F.col("l_quantity").cast("long").alias("n"), "l_returnflag",
    )
    back = F.col("l_returnflag") == "R"
    one, other = F.col("q0") + 1, F.col("q0") + 20 + F.col("n")
    raw = raw.select(
        "query", "target", F.when(back, other).otherwise(one).alias("qstart"), F.when(back, one).otherwise(other).alias("qend"),
        (F.col("t0") + 1).alias("tstart"), (F.col("t0") + 20 + F.col("n")).alias("tend"),
    )
    return I.normalise_hits(raw)


@query(f"""WITH {HITS}, names AS (SELECT p_partkey AS k FROM part)
SELECT 'q' || q_seq AS q_name, count(*) AS n FROM hits JOIN names ON k = q_seq GROUP BY 1""")
def registry_encode(spark: SparkSession, d: str) -> DataFrame:
    registry = spark.read.parquet(f"{d}/part.parquet").select(F.col("p_partkey").alias("seq_id"), F.concat(F.lit("q"), "p_partkey").alias("seq_name"))
    named = hits(spark, d).select(F.concat(F.lit("q"), "q_seq").alias("q_seq"))
    known = I.encode(named.join(registry.select(F.col("seq_name").alias("q_seq")), "q_seq", "left_semi"), registry, "q_seq")
    return known.groupBy(F.concat(F.lit("q"), "q_seq").alias("q_name")).agg(F.count("*").alias("n"))


@query(f"WITH {SPANS} SELECT * FROM spans")
def unique_spans(spark: SparkSession, d: str) -> DataFrame:
    return I.unique_spans(hits(spark, d)).withColumn("ord", F.col("ord").cast("bigint"))


def span_graph(spark: SparkSession, d: str) -> DataFrame:
    spans = I.unique_spans(hits(spark, d)).withColumn("ord", F.col("ord").cast("bigint"))
    return D.span_graph(cut(spans))


@query(f"WITH {GRAPH} SELECT q_seq, a, b, inter, round(sim, 6) AS sim FROM graph")
def span_overlap_jaccard(spark: SparkSession, d: str) -> DataFrame:
    return rounded(span_graph(spark, d).select("q_seq", "a", "b", "inter", "sim"), "sim")


@query(f"""WITH {GRAPH} SELECT q_seq, a, b, round(inter / CAST(least(len_a, len_b) AS DOUBLE), 6) AS contained FROM graph
WHERE inter / CAST(least(len_a, len_b) AS DOUBLE) >= {CONTAINED}""")
def span_containment(spark: SparkSession, d: str) -> DataFrame:
    share = D.containment(F.col("inter"), F.col("len_a"), F.col("len_b"))
    return rounded(span_graph(spark, d).select("q_seq", "a", "b", share.alias("contained")).where(F.col("contained") >= CONTAINED), "contained")


@query(f"WITH {GRAPH} SELECT q_seq, a, b, inter FROM graph")
def span_overlap_binned(spark: SparkSession, d: str) -> DataFrame:
    spans = I.unique_spans(hits(spark, d)).withColumn("ord", F.col("ord").cast("bigint"))
    both = I.overlaps(spans, key="q_seq", start="q_start", end="q_end", label="ord")
    return both.select("q_seq", F.col("ord_a").alias("a"), F.col("ord_b").alias("b"), "inter")


def nodes_and_edges(spark: SparkSession, d: str) -> tuple[DataFrame, DataFrame]:
    spans = cut(I.unique_spans(hits(spark, d)).withColumn("ord", F.col("ord").cast("bigint")))
    nodes = spans.select("q_seq", F.col("ord").alias("id"), "w")
    return nodes, cut(D.span_graph(spans))


@query(f"WITH {DENSE} SELECT q_seq, id, w, round(rho, 6) AS rho FROM dense")
def local_density(spark: SparkSession, d: str) -> DataFrame:
    nodes, edges = nodes_and_edges(spark, d)
    return rounded(P.densities(nodes, P.directed(edges, ["q_seq"]), ["q_seq"]), "rho")


@query(f"WITH {DENSE} SELECT q_seq, id, row_number() OVER (PARTITION BY q_seq ORDER BY rho DESC, id) - 1 AS rank FROM dense")
def density_rank(spark: SparkSession, d: str) -> DataFrame:
    nodes, edges = nodes_and_edges(spark, d)
    dense = P.densities(nodes, P.directed(edges, ["q_seq"]), ["q_seq"])
    order = Window.partitionBy("q_seq").orderBy(F.desc("rho"), "id")
    return dense.select("q_seq", "id", (F.row_number().over(order) - 1).cast("bigint").alias("rank"))


@query(f"WITH {STATE} SELECT q_seq, id, nh, round(smax, 6) AS smax FROM state")
def nearest_higher(spark: SparkSession, d: str) -> DataFrame:
    nodes, edges = nodes_and_edges(spark, d)
    dense = cut(P.densities(nodes, P.directed(edges, ["q_seq"]), ["q_seq"]))
    return rounded(P.nearest_higher(dense, edges, ["q_seq"]).select("q_seq", "id", "nh", "smax"), "smax")


@query(f"WITH {STATE} SELECT q_seq, id, round(rho, 6) AS rho, round(gamma, 6) AS gamma FROM state WHERE peak")
def candidate_peaks(spark: SparkSession, d: str) -> DataFrame:
    nodes, edges = nodes_and_edges(spark, d)
    state = P.nearest_higher(cut(P.densities(nodes, P.directed(edges, ["q_seq"]), ["q_seq"])), edges, ["q_seq"])
    peaks = state.where((F.col("rho") >= MIN_DENS) & (F.col("nh").isNull() | (F.col("smax") < MIN_SIM)))
    return rounded(peaks.select("q_seq", "id", "rho", "gamma"), "rho", "gamma")


def clusters(spark: SparkSession, d: str, **options: object) -> DataFrame:
    def of_queries(own: DataFrame) -> tuple[DataFrame]:
        spans = cut(I.unique_spans(own).withColumn("ord", F.col("ord").cast("bigint")))
        nodes = spans.select("q_seq", F.col("ord").alias("id"), "w")
        return (P.dpc(nodes, cut(D.span_graph(spans)), by=["q_seq"], min_sim=MIN_SIM, min_dens=MIN_DENS, unique=True, **options).select("q_seq", "id", "label"),)

    return by_key(hits(spark, d).select("q_seq", "q_start", "q_end"), "q_seq", of_queries)[0]


@query(f"WITH RECURSIVE {LABELLED} SELECT q_seq, id, label FROM labelled")
def dpc_labels(spark: SparkSession, d: str) -> DataFrame:
    return clusters(spark, d, halo_method=None).select("q_seq", "id", "label")


TOP = """top AS MATERIALIZED (
    SELECT * FROM (SELECT q_seq, src, dst, sim, row_number() OVER (PARTITION BY q_seq, src ORDER BY sim DESC, dst) AS rank FROM sym) WHERE rank <= 20)"""


@query(f"WITH {DENSE}, {TOP} SELECT q_seq, src, dst, round(sim, 6) AS sim, rank FROM top")
def topk_neighbours(spark: SparkSession, d: str) -> DataFrame:
    _, edges = nodes_and_edges(spark, d)
    return rounded(P.top_neighbours(P.directed(edges, ["q_seq"]), ["q_seq"]).withColumn("rank", F.col("rank").cast("bigint")), "sim")


def _halo_sql(method: str, point_specific: bool = False) -> str:
    foreign = "(b.label IS DISTINCT FROM a.label)"
    source = "sym" if method == "traditional" else "top"
    where = f"AND y.sim >= {TAU}" if method == "traditional" else ""
    score = {
        "traditional": f"coalesce(max(CASE WHEN {foreign} THEN y.sim END), 0)",
        "similarity_weighted": f"sum(CASE WHEN {foreign} THEN y.sim ELSE 0 END) / sum(y.sim)",
        "knn": f"count(*) FILTER (WHERE {foreign}) / CAST(count(*) AS DOUBLE)",
        "ndcg": f"""coalesce(sum(CASE WHEN {foreign} THEN 1 / log2(y.rank + 1) ELSE 0 END)
                    / nullif(list_sum(list_transform(range(1, 1 + count(*) FILTER (WHERE {foreign})), lambda r: 1 / log2(r + 1))), 0), 0)""",
    }[method]
    gone = (
        "border AND rho < mid"
        if point_specific
        else "rho < (SELECT max(rho) FROM scored e WHERE e.border AND e.q_seq = s.q_seq AND e.label = s.label)"
    )
    return f"""WITH RECURSIVE {LABELLED}, {TOP}, scores AS MATERIALIZED (
        SELECT y.q_seq, y.src AS id, round({score}, 9) AS score
        FROM {source} y JOIN labelled a ON a.q_seq = y.q_seq AND a.id = y.src JOIN labelled b ON b.q_seq = y.q_seq AND b.id = y.dst
        WHERE a.label IS NOT NULL {where} GROUP BY y.q_seq, y.src
    ), sizes AS MATERIALIZED (
        SELECT q_seq, label, count(*) AS size, median(rho) AS mid FROM labelled WHERE label IS NOT NULL GROUP BY q_seq, label
    ), many AS MATERIALIZED (SELECT q_seq, count(DISTINCT label) AS n FROM labelled GROUP BY q_seq
    ), scored AS MATERIALIZED (
        SELECT l.q_seq, l.id, l.label, l.rho, mid, coalesce(size >= 3 AND n > 1 AND score >= {TAU} AND score > 0, false) AS border
        FROM labelled l LEFT JOIN scores USING (q_seq, id) LEFT JOIN sizes USING (q_seq, label) JOIN many USING (q_seq)
    )
    SELECT q_seq, id, CASE WHEN NOT coalesce({gone}, false) THEN label END AS label FROM scored s"""


@query(_halo_sql("similarity_weighted"))
def halo_similarity_weighted(spark: SparkSession, d: str) -> DataFrame:
    return clusters(spark, d, halo_method="similarity_weighted", halo_tau=TAU).select("q_seq", "id", "label")


@query(_halo_sql("knn"))
def halo_knn(spark: SparkSession, d: str) -> DataFrame:
    return clusters(spark, d, halo_method="knn", halo_tau=TAU).select("q_seq", "id", "label")


@query(_halo_sql("ndcg"))
def halo_ndcg(spark: SparkSession, d: str) -> DataFrame:
    return clusters(spark, d, halo_method="ndcg", halo_tau=TAU).select("q_seq", "id", "label")


@query(_halo_sql("traditional"))
def halo_traditional(spark: SparkSession, d: str) -> DataFrame:
    return clusters(spark, d, halo_method="traditional", halo_tau=TAU).select("q_seq", "id", "label")


@query(_halo_sql("similarity_weighted", point_specific=True))
def halo_point_specific(spark: SparkSession, d: str) -> DataFrame:
    return clusters(spark, d, halo_method="similarity_weighted", halo_tau=TAU, point_specific=True).select("q_seq", "id", "label")


# ---- domains and families

PARENTS = f"""{LABELLED}, support AS MATERIALIZED (
    SELECT l.q_seq, l.label AS id, sum(l.w) AS support FROM labelled l WHERE label IS NOT NULL GROUP BY l.q_seq, l.label
), ranked AS MATERIALIZED (
    SELECT p.q_seq, p.id, s.q_start, s.q_end, row_number() OVER (PARTITION BY p.q_seq ORDER BY support DESC, s.q_end - s.q_start, p.id) AS rank
    FROM support p JOIN spans s ON s.q_seq = p.q_seq AND s.ord = p.id
), close AS (SELECT q_seq, a, b FROM graph WHERE inter / CAST(least(len_a, len_b) AS DOUBLE) >= {CONTAINED}
), better AS (
    SELECT x.q_seq, x.id, y.id AS peer, y.rank FROM (SELECT q_seq, a, b FROM close UNION ALL SELECT q_seq, b, a FROM close) e
    JOIN ranked x ON x.q_seq = e.q_seq AND x.id = e.a JOIN ranked y ON y.q_seq = e.q_seq AND y.id = e.b WHERE y.rank < x.rank
), parents AS MATERIALIZED (
    SELECT r.q_seq, r.id, coalesce(arg_min(b.peer, b.rank), r.id) AS parent
    FROM ranked r LEFT JOIN better b USING (q_seq, id) GROUP BY r.q_seq, r.id)"""
DOMAINS = f"""{PARENTS}, climb AS (
    SELECT q_seq, id, parent AS at FROM parents
    UNION ALL
    SELECT c.q_seq, c.id, p.parent FROM climb c JOIN parents p ON p.q_seq = c.q_seq AND p.id = c.at WHERE p.parent <> p.id
), final AS MATERIALIZED (
    SELECT c.q_seq, c.id AS label, c.at AS peak FROM climb c JOIN parents p ON p.q_seq = c.q_seq AND p.id = c.at AND p.parent = p.id
), assigned AS MATERIALIZED (
    SELECT h.q_seq, f.peak, h.t_seq, h.t_start, h.t_end, h.t_strand
    FROM hits h JOIN spans s USING (q_seq, q_start, q_end) JOIN labelled l ON l.q_seq = s.q_seq AND l.id = s.ord
    JOIN final f ON f.q_seq = l.q_seq AND f.label = l.label
), domains AS MATERIALIZED (
    SELECT a.q_seq, a.peak, s.q_start AS start, s.q_end AS "end",
           CASE WHEN count(*) FILTER (WHERE t_strand < 0) > count(*) FILTER (WHERE t_strand > 0) THEN '-' ELSE '+' END AS strand
    FROM assigned a JOIN spans s ON s.q_seq = a.q_seq AND s.ord = a.peak GROUP BY 1, 2, 3, 4
), numbered AS MATERIALIZED (
    SELECT *, row_number() OVER (ORDER BY q_seq, peak) - 1 AS dom_id FROM domains
), targets AS MATERIALIZED (
    SELECT t.t_seq, t.t_start, t.t_end, n.dom_id FROM (
        SELECT q_seq, peak, t_seq, t_start, t_end FROM assigned UNION ALL SELECT q_seq, peak, q_seq, start, "end" FROM domains
    ) t JOIN numbered n USING (q_seq, peak))"""
MERGED = f"""{DOMAINS}, islands AS (
    SELECT *, sum(opens) OVER (PARTITION BY t_seq, dom_id ORDER BY t_start, t_end ROWS UNBOUNDED PRECEDING) AS island FROM (
        SELECT *, CASE WHEN t_start <= max(t_end) OVER (PARTITION BY t_seq, dom_id ORDER BY t_start, t_end
                                                        ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) THEN 0 ELSE 1 END AS opens FROM targets)
), whole AS MATERIALIZED (
    SELECT t_seq, dom_id, min(t_start) AS t_start, max(t_end) AS t_end FROM islands GROUP BY t_seq, dom_id, island
), lengths AS MATERIALIZED (SELECT dom_id, CAST(sum(t_end - t_start) AS BIGINT) AS len FROM whole GROUP BY dom_id)"""
EDGES = f"""{MERGED}, pairs AS MATERIALIZED (
    SELECT x.dom_id AS a, y.dom_id AS b, least(x.t_end, y.t_end) - greatest(x.t_start, y.t_start) AS inter
    FROM whole x JOIN whole y ON x.t_seq = y.t_seq AND x.dom_id < y.dom_id AND x.t_start < y.t_end AND y.t_start < x.t_end
), edges AS MATERIALIZED (
    SELECT a, b, CAST(inter AS BIGINT) AS inter, inter / CAST(x.len + y.len - inter AS DOUBLE) AS sim
    FROM (SELECT a, b, sum(inter) AS inter FROM pairs GROUP BY a, b) JOIN lengths x ON x.dom_id = a JOIN lengths y ON y.dom_id = b)"""
FAMILIES = f"""{EDGES}, fsym AS MATERIALIZED (SELECT a AS src, b AS dst, sim FROM edges UNION ALL SELECT b, a, sim FROM edges
), fdense AS MATERIALIZED (
    SELECT l.dom_id AS id, round(1 + coalesce(sum(y.sim), 0), 9) AS rho FROM lengths l LEFT JOIN fsym y ON y.src = l.dom_id GROUP BY l.dom_id
), fhigher AS MATERIALIZED (
    SELECT src AS id, max(struct_pack(s := y.sim, r := b.rho, d := -y.dst)) AS top
    FROM fsym y JOIN fdense a ON a.id = y.src JOIN fdense b ON b.id = y.dst WHERE b.rho > a.rho OR (b.rho = a.rho AND y.dst < y.src) GROUP BY src
), fstate AS MATERIALIZED (
    SELECT id, rho >= 1 AND (top IS NULL OR top.s < 0.25) AS peak,
           CASE WHEN rho >= 1 AND (top IS NULL OR top.s < 0.25) THEN id ELSE coalesce(-top.d, id) END AS parent
    FROM fdense LEFT JOIN fhigher USING (id)
), fclimb AS (
    SELECT id, parent AS at FROM fstate UNION ALL
    SELECT c.id, s.parent FROM fclimb c JOIN fstate s ON s.id = c.at WHERE s.parent <> s.id
), member AS MATERIALIZED (
    SELECT c.id AS dom_id, r.id AS family FROM fclimb c JOIN fstate r ON r.id = c.at AND r.parent = r.id WHERE r.peak)"""


def instances(spark: SparkSession, d: str) -> tuple[DataFrame, DataFrame]:
    return D.domain_instances(hits(spark, d), min_sim=MIN_SIM, min_dens=MIN_DENS, halo_method=None, min_containment=CONTAINED)


def numbered(spark: SparkSession, d: str) -> tuple[DataFrame, DataFrame]:
    found, targets = instances(spark, d)
    known = cut(D.number_domains(found))
    return known, cut(targets.join(known.select("q_seq", "peak", "dom_id"), ["q_seq", "peak"]).select("t_seq", "t_start", "t_end", "dom_id"))


@query(f"WITH RECURSIVE {PARENTS} SELECT q_seq, id, parent FROM parents")
def spurious_parent(spark: SparkSession, d: str) -> DataFrame:
    def of_queries(own: DataFrame) -> tuple[DataFrame]:
        spans = cut(I.unique_spans(own).withColumn("ord", F.col("ord").cast("bigint")))
        graph = cut(D.span_graph(spans))
        nodes = spans.select("q_seq", F.col("ord").alias("id"), "w")
        found = P.dpc(nodes, graph, by=["q_seq"], min_sim=MIN_SIM, min_dens=MIN_DENS, halo_method=None, unique=True)
        support = found.where("label IS NOT NULL").groupBy("q_seq", F.col("label").alias("id")).agg(F.sum("w").alias("support"))
        peaks = support.join(spans.select("q_seq", F.col("ord").alias("id"), (F.col("q_end") - F.col("q_start")).alias("len")), ["q_seq", "id"])
        return (D.spurious_parents(peaks, graph, CONTAINED),)

    return by_key(hits(spark, d).select("q_seq", "q_start", "q_end"), "q_seq", of_queries)[0]


@query(f'WITH RECURSIVE {DOMAINS} SELECT q_seq, start, "end", strand FROM domains')
def domain_instances(spark: SparkSession, d: str) -> DataFrame:
    return instances(spark, d)[0].select("q_seq", "start", "end", "strand")


@query(f"WITH RECURSIVE {DOMAINS} SELECT strand, count(*) AS n FROM domains GROUP BY strand")
def domain_strand(spark: SparkSession, d: str) -> DataFrame:
    return instances(spark, d)[0].groupBy("strand").agg(F.count("*").alias("n"))


@query(f"WITH RECURSIVE {MERGED} SELECT * FROM whole")
def merge_spans(spark: SparkSession, d: str) -> DataFrame:
    return D.merged_targets(numbered(spark, d)[1])


@query(f"WITH RECURSIVE {MERGED} SELECT * FROM lengths")
def domain_target_length(spark: SparkSession, d: str) -> DataFrame:
    return D.target_lengths(D.merged_targets(numbered(spark, d)[1]))


@query(f"WITH RECURSIVE {EDGES} SELECT * FROM pairs")
def target_overlap(spark: SparkSession, d: str) -> DataFrame:
    return D.target_overlaps(numbered(spark, d)[1])[1]


@query(f"WITH RECURSIVE {EDGES} SELECT a, b, inter, round(sim, 6) AS sim FROM edges")
def family_edges(spark: SparkSession, d: str) -> DataFrame:
    return rounded_share(D.family_graph(numbered(spark, d)[1])[1], "sim")


@query(f"WITH RECURSIVE {FAMILIES} SELECT * FROM member")
def domain_families(spark: SparkSession, d: str) -> DataFrame:
    lengths, edges, with_densities = D.family_graph(numbered(spark, d)[1])
    return D.families(lengths, edges, with_densities=with_densities, halo_method=None).select("dom_id", "family")


def _features_sql(families: str) -> str:
    return f"""WITH RECURSIVE {families}, own AS (SELECT family, q_seq, start AS s, "end" AS e, strand FROM numbered JOIN member USING (dom_id)
), marks AS (
    SELECT *, CASE WHEN s <= max(e) OVER (PARTITION BY family, q_seq ORDER BY s, e ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) THEN 0 ELSE 1 END AS opens FROM own
), runs AS (SELECT *, sum(opens) OVER (PARTITION BY family, q_seq ORDER BY s, e ROWS UNBOUNDED PRECEDING) AS run FROM marks)
SELECT q_seq AS seqid, min(s) + 1 AS start, max(e) AS "end",
       CASE WHEN count(*) FILTER (WHERE strand = '-') > count(*) FILTER (WHERE strand = '+') THEN '-' ELSE '+' END AS strand, family
FROM runs GROUP BY family, q_seq, run"""


def _without_halo(name: str, plain: str, sym: str, by: list[str]) -> str:
    """The table ``name``: the labels of ``plain`` (``by, id, rho, label``) but for the halo by weighted similarity."""
    keys = "".join(f"{k}, " for k in by)
    same = lambda x, y: "".join(f" AND {x}.{k} = {y}.{k}" for k in by)
    return f"""{name}_top AS MATERIALIZED (
    SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY {keys}src ORDER BY sim DESC, dst) AS rank FROM {sym}) WHERE rank <= 20
), {name}_scores AS MATERIALIZED (
    SELECT {"".join(f"y.{k}, " for k in by)}y.src AS id, round(sum(CASE WHEN b.label IS DISTINCT FROM a.label THEN y.sim ELSE 0 END) / sum(y.sim), 9) AS score
    FROM {name}_top y JOIN {plain} a ON a.id = y.src{same("a", "y")} JOIN {plain} b ON b.id = y.dst{same("b", "y")}
    WHERE a.label IS NOT NULL GROUP BY {"".join(f"y.{k}, " for k in by)}y.src
), {name}_sizes AS MATERIALIZED (
    SELECT {keys}label, count(*) AS size, count(label) OVER ({"PARTITION BY " + ", ".join(by) if by else ""}) AS n FROM {plain} WHERE label IS NOT NULL GROUP BY {keys}label
), {name}_scored AS MATERIALIZED (
    SELECT l.*, coalesce(size >= 3 AND n > 1 AND score >= 0.5 AND score > 0, false) AS border
    FROM {plain} l LEFT JOIN {name}_scores USING ({keys}id) LEFT JOIN {name}_sizes USING ({keys}label)
), {name}_edge AS MATERIALIZED (
    SELECT {keys}label, max(rho) AS rho_b FROM {name}_scored WHERE border GROUP BY {keys}label
), {name} AS MATERIALIZED (
    SELECT s.* EXCLUDE (label, border), CASE WHEN NOT coalesce(s.rho < e.rho_b, false) THEN s.label END AS label
    FROM {name}_scored s LEFT JOIN {name}_edge e ON e.label = s.label{same("e", "s")})"""


@query(_features_sql(FAMILIES))
def gff_features(spark: SparkSession, d: str) -> DataFrame:
    return D.find_domains(hits(spark, d), halo_method=None)


WITH_HALO = FAMILIES.replace(
    LABELLED, LABELLED.replace("labelled AS MATERIALIZED", "plain AS MATERIALIZED") + ", " + _without_halo("labelled", "plain", "sym", ["q_seq"])
).replace("), member AS MATERIALIZED (", "), fplain AS MATERIALIZED (").replace(
    "SELECT c.id AS dom_id, r.id AS family FROM fclimb c JOIN fstate r ON r.id = c.at AND r.parent = r.id WHERE r.peak)",
    "SELECT c.id, d.rho, CASE WHEN r.peak THEN r.id END AS label FROM fclimb c JOIN fstate r ON r.id = c.at AND r.parent = r.id JOIN fdense d ON d.id = c.id)",
) + ", " + _without_halo("flabelled", "fplain", "fsym", []) + ", member AS MATERIALIZED (SELECT id AS dom_id, label AS family FROM flabelled WHERE label IS NOT NULL)"


@query(_features_sql(WITH_HALO))
def gff_features_default(spark: SparkSession, d: str) -> DataFrame:
    """The whole course with its defaults, the halo taken off domains and families."""
    return D.find_domains(hits(spark, d))


# ---- sequences and features

SEQUENCES = V.plain(V.SEQUENCES)
COMPLEMENT = f"reverse(translate({{}}, '{S.CODES}', '{S.COMPLEMENTS}'))"
DENSITY = f"""CASE WHEN length(regexp_replace({{0}}, '[-.]', '', 'g')) > 0
    THEN length(regexp_replace({{0}}, '[^RYSWKMBDHVNryswkmbdhvn]', '', 'g')) / CAST(length(regexp_replace({{0}}, '[-.]', '', 'g')) AS DOUBLE) ELSE 0 END"""


@query(f"SELECT seq_id, {COMPLEMENT.format('sequence')} AS sequence FROM ({SEQUENCES})")
def reverse_complement(spark: SparkSession, d: str) -> DataFrame:
    return V.view(spark, d, V.SEQUENCES).select("seq_id", S.reverse_complement(F.col("sequence")).alias("sequence"))


@query(f"SELECT seq_id, round({DENSITY.format('sequence')}, 6) AS density FROM ({SEQUENCES})")
def iupac_density(spark: SparkSession, d: str) -> DataFrame:
    return V.view(spark, d, V.SEQUENCES).select("seq_id", F.round(S.iupac_density(F.col("sequence")), 6).alias("density"))


@query(f"SELECT seq_id, translate(regexp_replace(sequence, '\\s', '', 'g'), 'Tt', 'Uu') AS sequence FROM ({SEQUENCES})")
def rna_standardize(spark: SparkSession, d: str) -> DataFrame:
    return V.view(spark, d, V.SEQUENCES).select("seq_id", S.standardise(F.col("sequence")).alias("sequence"))


EXTRACTED = f"""f AS ({V.plain(V.FEATURES)}), s AS ({SEQUENCES}), e AS (
    SELECT 'fam' || fam_id AS fid, f.seq_id, strand, greatest(1, f_start - 5) AS x, least(length(sequence), f_end + 5) AS y, sequence
    FROM f JOIN s USING (seq_id)
), g AS (
    SELECT fid || '::' || seq_id || '::' || x || '_' || y || '_flank5' AS header, fid, seq_id, strand, x, y,
           CASE WHEN strand = '-' THEN {COMPLEMENT.format('substr(sequence, x, y - x + 1)')} ELSE substr(sequence, x, y - x + 1) END AS sequence
    FROM e
), x AS (SELECT * FROM g WHERE {DENSITY.format('sequence')} <= 0.7)"""


def _extracted(spark: SparkSession, d: str, of: DataFrame) -> DataFrame:
    own = of.select(
        F.col("seq_id").alias("seqid"), F.col("f_start").alias("start"), F.col("f_end").alias("end"), "strand", F.concat(F.lit("fam"), "fam_id").alias("ID")
    )
    return X.extract(own, V.view(spark, d, V.SEQUENCES).withColumnRenamed("seq_id", "seqid"), flank=5, max_density=0.7)


@query(f"WITH {EXTRACTED} SELECT header, sequence FROM x")
def extract_sequences(spark: SparkSession, d: str) -> DataFrame:
    return _extracted(spark, d, features(spark, d)).select("header", "sequence")


@query(f"""WITH {EXTRACTED}, o AS (SELECT seq_id, f_start AS a, f_end AS b, strand AS t FROM f WHERE fam_id = 3
), j AS (SELECT x.*, o.t, greatest(a, x.x) AS lo, least(b, x.y) AS hi, length(x.sequence) AS n FROM x JOIN o ON o.seq_id = x.seq_id AND a <= x.y AND b >= x.x)
SELECT header AS seqid, greatest(1, least(n, CASE WHEN strand = '-' THEN y - hi + 1 ELSE lo - x + 1 END)) AS start,
       greatest(1, least(n, CASE WHEN strand = '-' THEN y - lo + 1 ELSE hi - x + 1 END)) AS "end",
       CASE WHEN strand <> '-' THEN t WHEN t = '+' THEN '-' WHEN t = '-' THEN '+' ELSE t END AS strand, fid AS parent_feature_id FROM j""")
def secondary_remap(spark: SparkSession, d: str) -> DataFrame:
    def of_sequences(own: DataFrame) -> tuple[DataFrame]:
        own = own.withColumnRenamed("seqid", "seq_id")
        other = own.where("fam_id = 3").select(F.col("seq_id").alias("seqid"), F.col("f_start").alias("start"), F.col("f_end").alias("end"), "strand")
        return (X.remap(_extracted(spark, d, own), other),)

    # remapped features are many times the rows
    return by_key(features(spark, d).withColumnRenamed("seq_id", "seqid"), "seqid", of_sequences, lazy=True)[0]


# ---- alignments

CELLS = f"cells AS MATERIALIZED ({V.plain(V.CELLS)})"
GAPS = f"""{CELLS}, gaps AS (
    SELECT dataset, col, avg(CASE WHEN ch IN ('-', '.') THEN 1.0::DOUBLE ELSE 0 END) AS gap_fraction FROM cells GROUP BY dataset, col)"""


@query(f"WITH {GAPS} SELECT dataset, col, round(gap_fraction, 6) AS gap_fraction FROM gaps")
def column_gap_fraction(spark: SparkSession, d: str) -> DataFrame:
    return rounded(A.column_gaps(aligned_rows(spark, d)), "gap_fraction")


@query(f"""WITH {GAPS}, bounds AS (SELECT dataset, min(col) AS lo, max(col) AS hi FROM gaps WHERE gap_fraction <= 0.8 GROUP BY dataset)
SELECT dataset, header, col - CASE WHEN lo < hi THEN lo ELSE 0 END AS col, ch FROM cells LEFT JOIN bounds USING (dataset)
WHERE lo IS NULL OR lo >= hi OR col BETWEEN lo AND hi""")
def crop_from_ends(spark: SparkSession, d: str) -> DataFrame:
    return A.crop_from_ends(aligned_rows(spark, d))


@query(f"""WITH {GAPS}, kept AS (SELECT dataset, col, row_number() OVER (PARTITION BY dataset ORDER BY col) - 1 AS new FROM gaps WHERE gap_fraction < 0.9)
SELECT dataset, header, CAST(new AS INTEGER) AS col, ch FROM cells JOIN kept USING (dataset, col)
UNION ALL SELECT dataset, header, col, ch FROM cells WHERE dataset NOT IN (SELECT dataset FROM kept)""")
def gappyout(spark: SparkSession, d: str) -> DataFrame:
    return A.gappyout(aligned_rows(spark, d))


#: A structure of 40 columns for every second alignment: five unpaired ones, four pairs around twenty, seven unpaired.
MASK_DBN = "concat(repeat('.', 5), repeat('(', 4), repeat('.', 20), repeat(')', 4), repeat('.', 7))"


@query(f"""WITH {GAPS}, bounds AS (SELECT dataset, min(col) AS lo, max(col) AS hi FROM gaps WHERE gap_fraction <= 0.8 GROUP BY dataset)
, chosen AS (
    SELECT dataset, ch, CASE WHEN length(dataset) % 2 = 0 THEN 3 WHEN lo < hi THEN lo ELSE 0 END AS low,
           CASE WHEN length(dataset) % 2 = 0 THEN 34 WHEN lo < hi THEN hi ELSE 39 END AS high, col
    FROM cells LEFT JOIN bounds USING (dataset))
SELECT dataset, col - low AS col, ch, count(*) AS n FROM chosen WHERE col BETWEEN low AND high GROUP BY ALL""")
def structure_mask(spark: SparkSession, d: str) -> DataFrame:
    rows = aligned_rows(spark, d)
    folded = rows.select("dataset").distinct().where("length(dataset) % 2 = 0").selectExpr("dataset", f"{MASK_DBN} AS dbn")
    masked = A.trim(rows, "structural_encoding", folded)
    return masked.groupBy("dataset", "col", "ch").agg(F.count("*").alias("n"))


@query("""WITH e AS (SELECT o_orderkey, CAST(-(o_custkey % 7) AS DOUBLE) / 2 AS c, CAST(-(o_orderkey % 5) AS DOUBLE) AS m FROM orders)
SELECT o_orderkey, round(CASE WHEN m < 0 THEN c / m WHEN c < 0 THEN 1 ELSE 0 END, 6) AS sci FROM e""")
def structure_conservation(spark: SparkSession, d: str) -> DataFrame:
    e = spark.read.parquet(f"{d}/orders.parquet").selectExpr("o_orderkey", "CAST(-(o_custkey % 7) AS DOUBLE) / 2 AS c", "CAST(-(o_orderkey % 5) AS DOUBLE) AS m")
    return rounded(e.select("o_orderkey", A.conservation_index(F.col("c"), F.col("m")).alias("sci")), "sci")


@query(f"""WITH {CELLS}, c AS (SELECT dataset, col, ch, count(*) AS n FROM cells WHERE ch IN ('A','C','G','U','N') GROUP BY ALL
), h AS (SELECT dataset, col, (log2(sum(n)) - sum(n * log2(n)) / sum(n)) / log2(15) AS h FROM c GROUP BY dataset, col
), e AS (SELECT dataset, coalesce(avg(h), 1) AS entropy FROM (SELECT DISTINCT dataset FROM cells) LEFT JOIN h USING (dataset) GROUP BY dataset)
SELECT dataset, 'muscle5' AS pipeline, length(dataset) % 3 <> 0 AS is_successful,
       round(CASE WHEN length(dataset) % 3 <> 0 THEN entropy ELSE 1 END, 6) AS entropy, CASE WHEN length(dataset) % 3 <> 0 THEN 50.0::DOUBLE ELSE 0 END AS tcs FROM e""")
def penalised_metrics(spark: SparkSession, d: str) -> DataFrame:
    scores = cut(A.entropy(aligned_rows(spark, d)).selectExpr("dataset", "'muscle5' AS pipeline", "entropy", "50D AS tcs"))
    runs = scores.selectExpr("dataset", "pipeline", "length(dataset) % 3 <> 0 AS is_successful")
    return rounded(A.penalised(runs, scores.where("length(dataset) % 3 <> 0")), "entropy")


@query(f"""WITH {CELLS}, c AS (SELECT dataset, col, ch, count(*) AS n FROM cells WHERE ch IN ('A','C','G','U','N') GROUP BY ALL
), h AS (SELECT dataset, col, (log2(sum(n)) - sum(n * log2(n)) / sum(n)) / log2(15) AS h FROM c GROUP BY dataset, col)
SELECT dataset, round(coalesce(avg(h), 1), 6) AS entropy FROM (SELECT DISTINCT dataset FROM cells) LEFT JOIN h USING (dataset) GROUP BY dataset""")
def column_entropy(spark: SparkSession, d: str) -> DataFrame:
    return rounded(A.entropy(aligned_rows(spark, d)), "entropy")


@query(f"""WITH {CELLS}, c AS (SELECT dataset, col, ch, count(*) AS n FROM cells WHERE ch NOT IN ('-', '.') GROUP BY ALL
), k AS (SELECT dataset, col, sum(n) AS t, sum(n * (n - 1) / 2.0::DOUBLE) AS s FROM c GROUP BY dataset, col
), w AS (SELECT dataset, sum(s) AS s, sum(t * (t - 1) / 2.0::DOUBLE) AS a FROM k GROUP BY dataset
), r AS (SELECT dataset, count(DISTINCT header) AS n FROM cells GROUP BY dataset)
SELECT dataset, round(CASE WHEN n < 2 THEN 100 WHEN coalesce(a, 0) = 0 THEN 0 ELSE 100 * s / a END, 6) AS tcs FROM r LEFT JOIN w USING (dataset)""")
def tcs_score(spark: SparkSession, d: str) -> DataFrame:
    return rounded(A.column_consistency(aligned_rows(spark, d)), "tcs")


@query(f"""WITH {CELLS}, p AS (
    SELECT x.dataset, x.header AS a, y.header AS b, 100 * avg(CASE WHEN x.ch = y.ch THEN 1.0::DOUBLE ELSE 0 END) AS i
    FROM cells x JOIN cells y ON x.dataset = y.dataset AND x.col = y.col AND x.header < y.header
    WHERE NOT (x.ch IN ('-', '.') AND y.ch IN ('-', '.')) GROUP BY 1, 2, 3)
SELECT dataset, round(coalesce(avg(i), 100), 6) AS mean_identity, round(coalesce(median(i), 100), 6) AS median_identity,
       round(coalesce(min(i), 100), 6) AS min_identity, round(coalesce(max(i), 100), 6) AS max_identity
FROM (SELECT DISTINCT dataset FROM cells) LEFT JOIN p USING (dataset) GROUP BY dataset""")
def pairwise_identity(spark: SparkSession, d: str) -> DataFrame:
    out = A.identity(aligned_rows(spark, d, "dataset", "header"))
    return rounded(out, *out.columns[1:])


MI = f"""{CELLS}, k AS MATERIALIZED (SELECT * FROM cells WHERE ch IN ('A','C','G','U')
), j AS (SELECT x.dataset, x.col AS i, y.col AS j, x.ch AS x, y.ch AS y, count(*) AS n
    FROM k x JOIN k y ON x.dataset = y.dataset AND x.header = y.header AND x.col < y.col GROUP BY ALL
), t AS (SELECT *, sum(n) OVER (PARTITION BY dataset, i, j) AS a, sum(n) OVER (PARTITION BY dataset, i, j, x) AS nx,
           sum(n) OVER (PARTITION BY dataset, i, j, y) AS ny FROM j
), mi AS MATERIALIZED (SELECT dataset, i, j, round(sum(CAST(n AS DOUBLE) / a * log2(CAST(n AS DOUBLE) * a / (CAST(nx AS DOUBLE) * ny))), 12) AS mi FROM t WHERE a >= 3 GROUP BY ALL
), s AS MATERIALIZED (SELECT dataset, col, sum(mi) AS s FROM (SELECT dataset, i AS col, mi FROM mi UNION ALL SELECT dataset, j, mi FROM mi) GROUP BY ALL
), o AS (SELECT dataset, sum(s) AS t FROM s GROUP BY dataset
), apc AS MATERIALIZED (SELECT mi.dataset, i, j, mi, CASE WHEN t > 0 THEN greatest(0, mi - x.s * y.s / t) ELSE 0 END AS apc
    FROM mi JOIN s x ON x.dataset = mi.dataset AND x.col = i JOIN s y ON y.dataset = mi.dataset AND y.col = j JOIN o ON o.dataset = mi.dataset
), l AS (SELECT dataset, max(col) + 1 AS n FROM cells GROUP BY dataset
), mean AS MATERIALIZED (SELECT l.dataset, coalesce(sum(apc), 0) / (n * (n - 1) / 2.0::DOUBLE) AS mean_apc FROM l LEFT JOIN apc USING (dataset) GROUP BY l.dataset, n)"""


@query(f"WITH {MI} SELECT dataset, round(mean_apc, 6) AS mean_apc FROM mean")
def mi_apc(spark: SparkSession, d: str) -> DataFrame:
    out = by_key(V.aligned_rows(spark, d, spread=False), "dataset", lambda own: (A.mean_covariation(own),))[0]
    return rounded(out, "mean_apc")


#: A structure for the derived alignments: columns 4 + i and 35 - i pair.
DBN = "...." + "((((((((((((" + "........" + "))))))))))))" + "...."


@query(f"""WITH {MI}, p AS (SELECT DISTINCT dataset, 4 + x AS i, 35 - x AS j FROM cells, range(12) r(x)
), v AS (SELECT p.dataset, p.i, p.j, coalesce(apc, 0) AS apc FROM p LEFT JOIN apc USING (dataset, i, j)
), q AS (SELECT p.dataset, p.i, p.j, count(DISTINCT x.ch || y.ch) AS kinds FROM p JOIN cells x ON x.dataset = p.dataset AND x.col = p.i
    JOIN cells y ON y.dataset = p.dataset AND y.header = x.header AND y.col = p.j WHERE x.ch || y.ch IN ('AU','UA','GC','CG','GU','UG') GROUP BY ALL)
SELECT v.dataset, round(avg(apc), 6) AS bp_covariation, count(*) FILTER (WHERE kinds >= 2 AND apc > 0.01) AS compensatory
FROM v LEFT JOIN q USING (dataset, i, j) GROUP BY v.dataset""")
def compensatory_mutations(spark: SparkSession, d: str) -> DataFrame:
    def of_alignments(own: DataFrame) -> tuple[DataFrame]:
        pairs = A.bracket_pairs(own.select("dataset").distinct().withColumn("dbn", F.lit(DBN)))
        return (A.base_pairs(own, pairs),)

    return rounded(by_key(V.aligned_rows(spark, d, spread=False), "dataset", of_alignments)[0], "bp_covariation")


@query(f"""WITH {CELLS} SELECT DISTINCT dataset, 4 + x AS i, 35 - x AS j FROM cells, range(12) r(x)""")
def bracket_pairs(spark: SparkSession, d: str) -> DataFrame:
    pairs = A.bracket_pairs(aligned(spark, d).select("dataset").distinct().withColumn("dbn", F.lit(DBN)))
    return pairs.select("dataset", F.col("i").cast("bigint").alias("i"), F.col("j").cast("bigint").alias("j"))


@query(f"""WITH {CELLS}, m AS (SELECT dataset, header, CASE WHEN header % 2 = 0 THEN 39 - col ELSE col END AS col, ch FROM cells
), a AS (SELECT dataset, header, row_number() OVER (PARTITION BY dataset, header ORDER BY col) - 1 AS r, col FROM cells WHERE ch NOT IN ('-', '.')
), b AS (SELECT dataset, header, row_number() OVER (PARTITION BY dataset, header ORDER BY col) - 1 AS r, col FROM m WHERE ch NOT IN ('-', '.')
), f AS (SELECT coalesce(a.dataset, b.dataset) AS dataset, a.r IS NOT NULL AS x, b.r IS NOT NULL AS y FROM a FULL JOIN b ON a.dataset = b.dataset AND a.header = b.header AND a.r = b.r AND a.col = b.col)
SELECT dataset, round(count(*) FILTER (WHERE x AND y) / CAST(count(*) AS DOUBLE), 6) AS mos FROM f GROUP BY dataset""")
def mean_overlap_score(spark: SparkSession, d: str) -> DataFrame:
    rows = aligned_rows(spark, d, "dataset", "header")
    mirrored = rows.withColumn("sequence", F.when(F.col("header") % 2 == 0, F.reverse("sequence")).otherwise(F.col("sequence")))
    return rounded(A.overlap_score({"as it is": rows, "mirrored": mirrored}), "mos")


# ---- evaluation

TABLE = f"""lab AS ({V.plain(V.LABELS)}), tab AS MATERIALIZED (
    SELECT ref, pred, CAST(sum(len) AS BIGINT) AS nt, count(DISTINCT seq_id) AS seqs FROM lab GROUP BY ref, pred)"""


@query(f"WITH {TABLE} SELECT * FROM tab")
def contingency(spark: SparkSession, d: str) -> DataFrame:
    return E.contingency(labels(spark, d))


@query(f"""WITH {TABLE}, n AS (SELECT CAST(nt AS DOUBLE) AS n FROM tab), a AS (SELECT sum(CAST(nt AS DOUBLE)) AS a FROM tab GROUP BY ref
), b AS (SELECT sum(CAST(nt AS DOUBLE)) AS b FROM tab GROUP BY pred
), v AS (SELECT (SELECT sum(n * (n - 1) / 2) FROM n) AS i, (SELECT sum(a * (a - 1) / 2) FROM a) AS x, (SELECT sum(b * (b - 1) / 2) FROM b) AS y, (SELECT sum(n) FROM n) AS t)
SELECT round((i - x * y / (t * (t - 1) / 2)) / ((x + y) / 2 - x * y / (t * (t - 1) / 2)), 6) AS adjusted_rand FROM v""")
def adjusted_rand(spark: SparkSession, d: str) -> DataFrame:
    return rounded(E.adjusted_rand(E.contingency(labels(spark, d))), "adjusted_rand")


@query(f"""WITH {TABLE}, n AS (SELECT ref, pred, CAST(nt AS DOUBLE) AS n FROM tab), a AS (SELECT ref, sum(n) AS a FROM n GROUP BY ref
), b AS (SELECT pred, sum(n) AS b FROM n GROUP BY pred), t AS (SELECT sum(n) AS t FROM n
), v AS (SELECT (SELECT sum(n / t * ln(n * t / (a * b))) FROM n JOIN a USING (ref) JOIN b USING (pred), t) AS mi,
               (SELECT sum(-a / t * ln(a / t)) FROM a, t) AS x, (SELECT sum(-b / t * ln(b / t)) FROM b, t) AS y)
SELECT round(mi / ((x + y) / 2), 6) AS normalised_mutual_information FROM v""")
def normalized_mutual_info(spark: SparkSession, d: str) -> DataFrame:
    return rounded(E.normalised_mutual_information(E.contingency(labels(spark, d))), "normalised_mutual_information")


@query("""WITH c AS (SELECT event_type AS label, CASE WHEN user_id % 5 <> 0 THEN user_id % 7 END AS partner, count(*) AS n FROM events GROUP BY ALL
), l AS (SELECT label, sum(n) AS size, sum(CASE WHEN partner IS NOT NULL THEN n ELSE 0 END) AS m,
           sum(CASE WHEN partner IS NOT NULL THEN n * n ELSE 0 END) AS q, sum(CASE WHEN partner IS NOT NULL THEN n * (n - 1) / 2.0::DOUBLE ELSE 0 END) AS good FROM c GROUP BY label
), s AS (SELECT CAST(sum(good) AS DOUBLE) AS good, CAST(sum(m * m - q) AS DOUBLE) / 2 AS bad, CAST(sum(size * (size - 1)) AS DOUBLE) / 2 AS total FROM l)
SELECT good, bad, total - good - bad AS missing, total, round(100 * good / total, 6) AS good_percent, round(100 * bad / total, 6) AS bad_percent,
       round(100 * (total - good - bad) / total, 6) AS missing_percent FROM s""")
def pair_statistics(spark: SparkSession, d: str) -> DataFrame:
    rows = spark.read.parquet(f"{d}/events.parquet").select(
        F.col("event_type").alias("label"), F.when(F.col("user_id") % 5 != 0, F.col("user_id") % 7).alias("partner")
    )
    return rounded(E.pair_statistics(rows), "good_percent", "bad_percent", "missing_percent")


def _typed_features(spark: SparkSession, d: str) -> tuple[DataFrame, DataFrame]:
    """Distinct features as reference (even families) and predicted labels (odd ones) of the documents, and the documents' lengths."""
    docs = spark.read.parquet(f"{d}/documents.parquet")
    return _typed(_placed(spark, d)), docs.select(F.col("doc_id").alias("seq_id"), F.coalesce(F.length("text"), F.lit(0)).cast("bigint").alias("length"))


def _placed(spark: SparkSession, d: str) -> DataFrame:
    return features(spark, d).select("seq_id", (F.col("f_start") - 1).alias("start"), F.col("f_end").alias("end"), "fam_id")


def _typed(placed: DataFrame) -> DataFrame:
    rows = placed.distinct()
    order = Window.partitionBy("seq_id").orderBy("start", "end", "fam_id")
    rows = rows.withColumn("ord", F.col("seq_id") * 1_000_000 + F.row_number().over(order))
    rows = rows.withColumn("label_type", F.when(F.col("fam_id") % 2 == 0, "ref").otherwise("pred")).withColumn("label", F.concat(F.lit("f"), "fam_id"))
    return cut(rows.drop("fam_id"))


def _of_sequences(spark: SparkSession, d: str, work: Callable[[DataFrame, DataFrame], DataFrame]) -> DataFrame:
    """What ``work`` makes of features and lengths, which come to their sequence in one shuffle; a length is a row without a feature."""
    docs = spark.read.parquet(f"{d}/documents.parquet")
    lengths = docs.select(F.col("doc_id").alias("seq_id"), F.coalesce(F.length("text"), F.lit(0)).cast("bigint").alias("length"))
    placed = _placed(spark, d).unionByName(lengths, allowMissingColumns=True)

    def of_sequences(own: DataFrame) -> tuple[DataFrame]:
        return (work(_typed(own.where("length IS NULL").drop("length")), own.where("length IS NOT NULL").select("seq_id", "length")),)

    return by_key(placed, "seq_id", of_sequences)[0]


#: The same: stretches between the ends of features and of the sequence, with the labels of the last features over them.
TYPED = f"""feat AS ({V.plain(V.FEATURES)}), typed AS MATERIALIZED (
    SELECT seq_id, s, e AS whole, least(e, length) AS e, length, CASE WHEN fam_id % 2 = 0 THEN 'ref' ELSE 'pred' END AS label_type, 'f' || fam_id AS label,
           seq_id * 1000000 + row_number() OVER (PARTITION BY seq_id ORDER BY s, whole, fam_id) AS ord
    FROM (SELECT DISTINCT seq_id, f_start - 1 AS s, f_end AS whole, f_end AS e, fam_id FROM feat)
    JOIN (SELECT doc_id AS seq_id, coalesce(length(text), 0) AS length FROM documents) USING (seq_id)
), cuts AS (
    SELECT seq_id, s AS x FROM typed WHERE s < e UNION SELECT seq_id, e FROM typed WHERE s < e
    UNION SELECT doc_id, 0 FROM documents UNION SELECT doc_id, coalesce(length(text), 0) FROM documents
), seg AS MATERIALIZED (
    SELECT seq_id, a, b, (SELECT arg_max(label, ord) FROM typed t WHERE t.seq_id = c.seq_id AND label_type = 'ref' AND s <= a AND a < e) AS ref,
           (SELECT arg_max(label, ord) FROM typed t WHERE t.seq_id = c.seq_id AND label_type = 'pred' AND s <= a AND a < e) AS pred
    FROM (SELECT seq_id, x AS a, lead(x) OVER (PARTITION BY seq_id ORDER BY x) AS b FROM cuts) c WHERE b IS NOT NULL)"""


@query(f"""WITH {TYPED} SELECT coalesce(ref, '') AS ref, coalesce(pred, '') AS pred, CAST(sum(b - a) AS BIGINT) AS nt FROM seg GROUP BY 1, 2""")
def label_segments(spark: SparkSession, d: str) -> DataFrame:
    parts = _of_sequences(spark, d, E.segments)
    none = lambda c: F.coalesce(c, F.lit("")).alias(c)
    return parts.groupBy(none("ref"), none("pred")).agg(F.sum(F.col("end") - F.col("start")).alias("nt"))


@query(f"""WITH {TYPED}, c AS (
    SELECT t.ord, t.label_type, CASE WHEN label_type = 'ref' THEN pred ELSE ref END AS o, CAST(sum(b - a) AS BIGINT) AS n, min(a) AS l
    FROM typed t JOIN seg ON seg.seq_id = t.seq_id AND a >= s AND a < e GROUP BY ALL
), m AS (SELECT *, row_number() OVER (PARTITION BY ord ORDER BY n DESC, l) AS k FROM c)
SELECT t.ord, t.label, round(n / CAST(whole - s AS DOUBLE), 6) AS share, CASE WHEN 2 * n >= whole - s THEN o END AS partner_50,
       CASE WHEN 4 * n >= 3 * (whole - s) THEN o END AS partner_75, CASE WHEN 10 * n >= 9 * (whole - s) THEN o END AS partner_90
FROM typed t LEFT JOIN m ON m.ord = t.ord AND k = 1""")
def majority_partner(spark: SparkSession, d: str) -> DataFrame:
    def partners(rows: DataFrame, lengths: DataFrame) -> DataFrame:
        clipped = rows.withColumn("whole", F.col("end") - F.col("start")).join(lengths, "seq_id").withColumn("end", F.least("end", "length")).drop("length")
        return E.majority_partners(clipped, cut(E.segments(rows, lengths)), whole="whole").drop("seq_id")

    out = _of_sequences(spark, d, partners)
    return out.select("ord", "label", F.round("share", 6).alias("share"), *(f"partner_{c}" for c in (50, 75, 90)))


#: Runs of bare stretches: a stretch opens one where the one before has a label.
RUNS = "SELECT *, sum(opens) OVER (PARTITION BY seq_id ORDER BY a) AS g FROM (SELECT *, CASE WHEN {0} IS NULL AND (a = 0 OR lag({0}) OVER (PARTITION BY seq_id ORDER BY a) IS NOT NULL) THEN 1 ELSE 0 END AS opens FROM seg)"


@query(f"""WITH {TYPED}, m AS ({RUNS.format("ref")})
SELECT seq_id, min(a) AS start, max(b) AS "end" FROM m WHERE ref IS NULL GROUP BY seq_id, g""")
def unlabeled_regions(spark: SparkSession, d: str) -> DataFrame:
    return _of_sequences(spark, d, lambda *own: E.unlabelled_regions(E.segments(*own), "ref"))


@query(f"""WITH {TYPED}, q AS (SELECT seq_id, sum(b - a) AS n, coalesce(sum(b - a) FILTER (WHERE pred IS NULL), 0) AS bare FROM seg GROUP BY seq_id
), m AS ({RUNS.format("pred")})
SELECT count(*) FILTER (WHERE bare = 0) AS fully_labeled_seqs, count(*) FILTER (WHERE bare > 0 AND bare < n) AS partially_labeled_seqs,
       count(*) FILTER (WHERE bare = n) AS fully_unlabeled_seqs, CAST(sum(bare) AS BIGINT) AS unlabeled_nucleotides,
       (SELECT count(*) FROM (SELECT DISTINCT seq_id, g FROM m WHERE pred IS NULL)) AS unlabeled_regions FROM q""")
def label_coverage(spark: SparkSession, d: str) -> DataFrame:
    return E.coverage(_of_sequences(spark, d, E.segments), "pred")


@query(f"""WITH {TYPED} SELECT label_type, label, count(*) AS domains, CAST(sum(whole - s) AS BIGINT) AS nucleotides, count(DISTINCT seq_id) AS seqs
FROM typed GROUP BY 1, 2""")
def label_counts(spark: SparkSession, d: str) -> DataFrame:
    return E.label_counts(_typed_features(spark, d)[0])


@query(f"""WITH {TYPED}, c AS (SELECT label_type, label, count(*) AS n FROM typed GROUP BY 1, 2)
SELECT label_type, count(*) AS cluster_number, max(n) AS largest, quantile_cont(n, 0.25) AS q1, quantile_cont(n, 0.5) AS median,
       round(avg(n), 6) AS mean, quantile_cont(n, 0.75) AS q3 FROM c GROUP BY label_type""")
def label_quartiles(spark: SparkSession, d: str) -> DataFrame:
    return rounded(E.label_quartiles(E.label_counts(_typed_features(spark, d)[0])), "mean")


@query(f"""WITH {TABLE} SELECT pred, string_agg(ref, '; ' ORDER BY ref) AS ref_ids, string_agg(CAST(nt AS VARCHAR), '; ' ORDER BY ref) AS nt_counts,
    CAST(sum(nt) AS BIGINT) AS nt_sum, string_agg(CAST(seqs AS VARCHAR), '; ' ORDER BY ref) AS seq_counts, CAST(sum(seqs) AS BIGINT) AS seq_sum
FROM tab GROUP BY pred HAVING count(*) > 1""")
def glued_refs(spark: SparkSession, d: str) -> DataFrame:
    return E.mixed(E.contingency(labels(spark, d)), "pred")


@query(f"""WITH {TABLE} SELECT ref, string_agg(pred, '; ' ORDER BY pred) AS pred_ids, string_agg(CAST(nt AS VARCHAR), '; ' ORDER BY pred) AS nt_counts,
    CAST(sum(nt) AS BIGINT) AS nt_sum, string_agg(CAST(seqs AS VARCHAR), '; ' ORDER BY pred) AS seq_counts, CAST(sum(seqs) AS BIGINT) AS seq_sum
FROM tab GROUP BY ref HAVING count(*) > 1""")
def split_refs(spark: SparkSession, d: str) -> DataFrame:
    return E.mixed(E.contingency(labels(spark, d)), "ref")


@query(f"WITH {TABLE} SELECT ref AS source, pred AS target, nt, seqs FROM tab")
def error_edges(spark: SparkSession, d: str) -> DataFrame:
    return E.error_edges(E.contingency(labels(spark, d)))


@query("""SELECT o_orderstatus, o_orderpriority, round(avg(o_orderkey), 4) AS mean_key, round(avg(o_totalprice), 4) AS mean_price
FROM orders GROUP BY 1, 2""")
def pipeline_means(spark: SparkSession, d: str) -> DataFrame:
    rows = spark.read.parquet(f"{d}/orders.parquet").select("o_orderstatus", "o_orderpriority", "o_orderkey", "o_totalprice")
    out = A.pipeline_means(rows, ["o_orderstatus", "o_orderpriority"])
    return out.select("o_orderstatus", "o_orderpriority", F.round("avg(o_orderkey)", 4).alias("mean_key"), F.round("avg(o_totalprice)", 4).alias("mean_price"))
