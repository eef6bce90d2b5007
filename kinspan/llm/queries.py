"""The queries of this subpackage, each over its whole table, and their SQL where SQL can say it."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .repeats import drop_repeats

    out = drop_repeats(table(spark, sf_dir, "documents"))
    return out.select("doc_id", "n_words", "n_removed", F.sha2("text", 256).alias("kept_sha256"))


def op2_licence_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .licences import scan_licences

    out = scan_licences(table(spark, sf_dir, "documents"))
    return out.withColumn("dice", F.round("dice", 6))


def op3_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .packing import pack

    return pack(table(spark, sf_dir, "documents"))


def op4_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .sketches import fingerprints

    return fingerprints(table(spark, sf_dir, "documents"))


def op5_near_duplicates(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .near import near_duplicates

    return near_duplicates(table(spark, sf_dir, "documents"), shingle=3, percent=85)


def op6_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .quality import held_out, score_quality

    labels = table(spark, sf_dir, "labels")
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    out = score_quality(docs, labels, usable=~held_out())
    return out.select("doc_id", held_out().alias("held_out"), "score", "predicted", "attention")


def op7_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .archives import archive_pages

    rows = archive_pages(table(spark, sf_dir, "pages"))
    return rows.select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")


def op8_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    from .bpe import encode, read_ranks

    ranks = read_ranks(public_tokenizers.path("byte_bpe_50k.tiktoken"))
    out = encode(table(spark, sf_dir, "documents"), ranks, public_tokenizers.PATTERN)
    ids = F.array_join(F.col("ids").cast("array<string>"), " ")
    return out.select("doc_id", "n_tokens", F.sha2(ids, 256).alias("ids_sha256"), F.sha2("decoded", 256).alias("decoded_sha256"))


#: The key of the surrogates in the registered queries; a user gives one of their own.
DEMONSTRATION_KEY = "kinspan demonstration key"


def op9_pii_surrogates(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .pii import replace_entities

    out = replace_entities(table(spark, sf_dir, "documents"), DEMONSTRATION_KEY)
    return out.select("doc_id", "text", "n_entities")


def op10_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .perplexity import judge

    return judge(table(spark, sf_dir, "documents"))


def op11_sentencepiece(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    from .pieces import decode_pieces, encode_pieces, read_model

    model = read_model(public_tokenizers.path("piece_bpe_32k.model"))
    listed = lambda c: F.sha2(F.array_join(F.col(c).cast("array<string>"), " "), 256)
    out = encode_pieces(table(spark, sf_dir, "documents").select("doc_id", "text"), model)
    out = decode_pieces(out.select("doc_id", "n_tokens", "ids", listed("ends").alias("ends_sha256")), model)
    return out.select("doc_id", "n_tokens", listed("ids").alias("ids_sha256"), F.sha2("decoded", 256).alias("decoded_sha256"), "ends_sha256")


def op12_fill_in_middle(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .middle import fill_in_middle, restored

    out = fill_in_middle(table(spark, sf_dir, "documents").select("doc_id", "text"))
    shas = [F.sha2("output", 256).alias("output_sha256"), F.sha2(restored(), 256).alias("restored_sha256")]
    return out.select("doc_id", "n", "form", "prefix_chars", "middle_chars", *shas)


def op13_hard_negatives(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .negatives import mine_hard_negatives, quantised

    label = F.when(F.col("vec_id") % 7 == 0, (F.col("label") + 1) % 10).otherwise(F.col("label"))
    rows = table(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("id"), label.alias("label"), quantised().alias("v"))
    return mine_hard_negatives(rows, F.col("id") % 100 == 0)


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_substring_dedup": op1_substring_dedup,
    "op2_licence_scan": op2_licence_scan,
    "op3_packing": op3_packing,
    "op4_fingerprints": op4_fingerprints,
    "op5_near_duplicates": op5_near_duplicates,
    "op6_quality_classifier": op6_quality_classifier,
    "op7_warc": op7_warc,
    "op8_bpe": op8_bpe,
    "op9_pii_surrogates": op9_pii_surrogates,
    "op10_quality_rules": op10_quality_rules,
    "op11_sentencepiece": op11_sentencepiece,
    "op12_fill_in_middle": op12_fill_in_middle,
    "op13_hard_negatives": op13_hard_negatives,
}

def _licence_sql() -> str:
    from .licences import TEMPLATES

    values = ", ".join("('{}', '{}')".format(name, body.replace("'", "''")) for name, body in TEMPLATES.items())
    words = "list_filter(string_split(regexp_replace(lower({}), '[^\\p{{L}}\\p{{N}}]+', ' ', 'g'), ' '), lambda w: w <> '')"
    grams = "[ws[i] || ' ' || ws[i + 1] FOR i IN range(1, len(ws))]"
    return f"""
        WITH t AS (
            SELECT licence, list_distinct(g) AS own, CAST(floor(len(g) * 1.5 + 1e-9) AS BIGINT) AS bound,
                   CAST(ceil(len(list_distinct(g)) * 0.8 / 1.2 - 1e-9) AS BIGINT) AS need
            FROM (SELECT licence, {grams} AS g FROM (SELECT licence, {words.format("body")} AS ws FROM (VALUES {values}) v(licence, body)))
        ), d AS (
            SELECT row_number() OVER () AS r, doc_id, {grams} AS g FROM (SELECT doc_id, {words.format("text")} AS ws FROM documents WHERE text IS NOT NULL)
        ), places AS MATERIALIZED (
            SELECT *, coalesce(lag(i) OVER (PARTITION BY r, x ORDER BY i), -1) AS earlier FROM (SELECT r, unnest(g) AS x, unnest(range(0, len(g))) AS i FROM d)
        ), shared AS MATERIALIZED (
            SELECT r, licence, i FROM places JOIN (SELECT licence, unnest(own) AS x FROM t) USING (x)
        ), begins AS (
            SELECT s.r, s.licence, s.i, t.bound, len(t.own) AS n
            FROM (SELECT *, lead(i, need - 1) OVER (PARTITION BY r, licence ORDER BY i) AS enough FROM shared JOIN t USING (licence)) s JOIN t USING (licence)
            WHERE s.enough - s.i < t.bound
        ), walked AS (
            SELECT b.r, b.licence, b.i, p.i AS last, b.n, s.i IS NOT NULL AS mine,
                   count(*) FILTER (WHERE p.earlier < b.i) OVER w AS every, count(*) FILTER (WHERE p.earlier < b.i AND s.i IS NOT NULL) OVER w AS common
            FROM begins b JOIN places p ON p.r = b.r AND p.i >= b.i AND p.i < b.i + b.bound
                 LEFT JOIN shared s ON s.r = p.r AND s.licence = b.licence AND s.i = p.i
            WINDOW w AS (PARTITION BY b.r, b.licence, b.i ORDER BY p.i ROWS UNBOUNDED PRECEDING)
        ), best AS (
            SELECT r, licence, i, last, 2.0::DOUBLE * common / (every + n) AS dice FROM walked WHERE mine
            QUALIFY row_number() OVER (PARTITION BY r, licence ORDER BY 2.0::DOUBLE * common / (every + n) DESC, i, last) = 1
        )
        SELECT doc_id, licence, CAST(i AS INTEGER) AS first_word, CAST(last - i + 2 AS INTEGER) AS n_words, round(dice, 6) AS dice
        FROM best JOIN d USING (r) WHERE dice >= 0.8
    """


ORACLE: dict[str, str] = {
    "op2_licence_scan": _licence_sql(),
    "op1_substring_dedup": r"""
        WITH w AS (
            SELECT doc_id, list_filter(string_split_regex(coalesce(text, ''), '[\x20\x09-\x0D]+'), lambda x: x <> '') AS ws FROM documents
        ), runs AS (
            SELECT doc_id, i, md5(array_to_string(ws[i:i + 49], ' ')) AS run
            FROM (SELECT doc_id, ws, unnest(range(1, len(ws) - 48)) AS i FROM w WHERE len(ws) >= 50)
        ), least_doc AS (
            SELECT run, min(doc_id) AS least_id FROM runs GROUP BY run
        ), gone AS (
            SELECT DISTINCT doc_id, unnest(range(i, i + 50)) AS i FROM runs JOIN least_doc USING (run) WHERE least_id < doc_id
        ), cut AS (
            SELECT doc_id, list(i) AS gone FROM gone GROUP BY doc_id
        ), kept AS (
            SELECT doc_id, ws, coalesce(len(gone), 0) AS n_removed,
                   CASE WHEN gone IS NULL THEN ws
                        ELSE [x.w FOR x IN [{'w': ws[j], 'j': j} FOR j IN range(1, len(ws) + 1)] IF NOT list_contains(gone, x.j)] END AS k
            FROM w LEFT JOIN cut USING (doc_id)
        )
        SELECT doc_id, CAST(len(ws) AS BIGINT) AS n_words, CAST(n_removed AS BIGINT) AS n_removed,
               sha256(array_to_string(k, ' ')) AS kept_sha256
        FROM kept
    """,
    "op5_near_duplicates": r"""
        WITH RECURSIVE w AS (
            SELECT doc_id, list_filter(string_split_regex(
                       translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
                       '[\x20\x09-\x0D]+'), lambda x: x <> '') AS ws
            FROM documents
        ), s AS (
            SELECT DISTINCT doc_id, array_to_string(ws[i:i + 2], ' ') AS sh
            FROM (SELECT doc_id, ws, unnest(range(1, greatest(len(ws) - 1, 2))) AS i FROM w WHERE len(ws) > 0)
        ), n AS (
            SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id
        ), pairs AS (
            SELECT x.doc_id AS a, y.doc_id AS b, count(*) AS c
            FROM s x JOIN s y ON x.sh = y.sh AND x.doc_id < y.doc_id GROUP BY 1, 2
        ), links AS (
            SELECT a, b FROM pairs JOIN n na ON na.doc_id = a JOIN n nb ON nb.doc_id = b WHERE 100 * c >= 85 * (na.n + nb.n - c)
        ), edges AS (
            SELECT a, b FROM links UNION ALL SELECT b, a FROM links
        ), reach AS (
            SELECT doc_id, doc_id AS r FROM documents
            UNION
            SELECT reach.doc_id, edges.b FROM reach JOIN edges ON edges.a = reach.r
        )
        SELECT w.doc_id, CAST(coalesce(n.n, 0) AS BIGINT) AS n_shingles, c.component_id, c.component_id = w.doc_id AS kept
        FROM w LEFT JOIN n USING (doc_id)
        JOIN (SELECT doc_id, min(r) AS component_id FROM reach GROUP BY doc_id) c USING (doc_id)
    """,
    "op7_warc": """
        WITH p AS (
            SELECT page_id, url, CAST(octet_length(encode(coalesce(html, ''))) AS BIGINT) AS payload_bytes,
                   sha1(coalesce(html, '')) AS payload_digest
            FROM pages
        ), t AS (
            SELECT payload_digest AS d, max(page_id) AS top FROM p WHERE payload_bytes >= 1000 GROUP BY 1
        )
        SELECT page_id, payload_bytes, payload_digest,
               CASE WHEN top <> page_id THEN 'revisit' ELSE 'response' END AS record_type,
               CASE WHEN top <> page_id THEN top END AS refers_to
        FROM p LEFT JOIN t ON d = payload_digest
    """,
    "op12_fill_in_middle": """
        WITH h AS (
            SELECT doc_id, coalesce(text, '') AS t, CAST(length(coalesce(text, '')) AS BIGINT) AS n, sha256('1:' || coalesce(CAST(doc_id AS VARCHAR), '')) AS h
            FROM documents
        ), d AS (
            SELECT doc_id, t, n, CAST('0x' || h[1:8] AS BIGINT) AS h1, CAST('0x' || h[9:16] AS BIGINT) AS h2,
                   CAST('0x' || h[17:24] AS BIGINT) AS h3, CAST('0x' || h[25:32] AS BIGINT) AS h4
            FROM h
        ), c AS (
            SELECT doc_id, t, n, least(h1 % (n + 1), h2 % (n + 1)) AS a, greatest(h1 % (n + 1), h2 % (n + 1)) AS b,
                   CASE WHEN t = '' OR h3 % 100 >= 90 OR contains(t, '<P>') OR contains(t, '<S>') OR contains(t, '<M>') THEN 'plain'
                        WHEN h4 % 100 < 20 THEN 'spm' ELSE 'psm' END AS form
            FROM d
        ), p AS (
            SELECT *, '<P>' || substring(t, 1, a) AS prefix, '<M>' || substring(t, a + 1, b - a) AS middle, '<S>' || substring(t, b + 1) AS suffix FROM c
        )
        SELECT doc_id, n, form, CASE WHEN form <> 'plain' THEN a END AS prefix_chars, CASE WHEN form <> 'plain' THEN b - a END AS middle_chars,
               sha256(CASE form WHEN 'psm' THEN prefix || suffix || middle WHEN 'spm' THEN suffix || prefix || middle ELSE t END) AS output_sha256,
               sha256(t) AS restored_sha256
        FROM p
    """,
    "op13_hard_negatives": """
        WITH e AS (
            SELECT DISTINCT vec_id, CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END AS label,
                   list_transform(embedding, lambda x: floor(256 * CAST(x AS DOUBLE))) AS v
            FROM embeddings
            WHERE vec_id IS NOT NULL AND label IS NOT NULL AND embedding IS NOT NULL
              AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
        ), s AS MATERIALIZED (
            SELECT a.vec_id AS a, a.label AS al, b.vec_id AS b, b.label AS bl, CAST(list_inner_product(a.v, b.v) AS BIGINT) AS score
            FROM e a JOIN e b ON a.vec_id % 100 = 0 AND b.vec_id <> a.vec_id
        ), p AS (
            SELECT a, b, score FROM s WHERE al = bl QUALIFY row_number() OVER (PARTITION BY a ORDER BY score DESC, b) <= 5
        )
        SELECT p.a AS anchor_id, p.b AS positive_id, CAST(row_number() OVER (PARTITION BY p.a, p.b ORDER BY s.score DESC, s.b) AS INTEGER) AS rank,
               s.b AS negative_id, p.score AS positive_score, s.score AS negative_score
        FROM p JOIN s ON s.a = p.a AND s.al <> s.bl AND 80 * p.score <= 100 * s.score AND 100 * s.score <= 100 * p.score
        QUALIFY row_number() OVER (PARTITION BY p.a, p.b ORDER BY s.score DESC, s.b) <= 5
    """,
}
