"""Stand-ins for biological inputs, derived from the test tables in SQL that Spark and DuckDB share."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Alignment hits in internal coordinates; self hits are left out.
HITS = """
    SELECT CAST(l_partkey AS BIGINT) AS q_seq,
           (l_orderkey % 6) * 150 + l_linenumber * 4 AS q_start,
           (l_orderkey % 6) * 150 + l_linenumber * 4 + 20 + CAST(l_quantity AS BIGINT) AS q_end,
           CAST(l_suppkey AS BIGINT) AS t_seq,
           (l_orderkey % 5) * 180 + l_linenumber * 3 AS t_start,
           (l_orderkey % 5) * 180 + l_linenumber * 3 + 20 + CAST(l_quantity AS BIGINT) AS t_end,
           CASE WHEN l_returnflag = 'R' THEN -1 ELSE 1 END AS t_strand
    FROM {lineitem} WHERE l_partkey <> l_suppkey
"""
#: Stretches of 40 characters of every document's whole text; an alignment is a source and the number of a stretch.
PIECES = """
    SELECT concat(b.source, '-', b.block) AS dataset, b.doc_id AS header, substr(b.text, b.block * 40 + 1, 40) AS piece
    FROM (SELECT source, doc_id, text, explode(sequence(0, CAST(floor((length(text) - 1) / 40.0) AS INT))) AS block
          FROM {documents} WHERE length(text) > 0) b
"""
#: The characters of aligned sequences: alignments of 40 columns; a text's last stretch is filled up with gaps.
CELLS = """
    SELECT p.dataset, p.header, n.col,
           CASE WHEN n.col >= length(p.piece) THEN '-'
                ELSE CASE ascii(substr(p.piece, n.col + 1, 1)) % 6 WHEN 0 THEN 'A' WHEN 1 THEN 'C'
                     WHEN 2 THEN 'G' WHEN 3 THEN 'U' WHEN 4 THEN 'N' ELSE '-' END END AS ch
    FROM ({pieces}) p CROSS JOIN (SELECT explode(sequence(0, 39)) AS col) n
"""
#: Reference and predicted labels of stretches of sequences.
LABELS = """
    SELECT event_type AS ref, CAST(user_id % 7 AS VARCHAR(8)) AS pred, CAST(user_id AS BIGINT) AS seq_id, CAST(1 AS BIGINT) AS len
    FROM {events}
"""
#: Features in one-based closed coordinates: every line item, on the documents in turn.
FEATURES = """
    SELECT CAST(l_orderkey % (SELECT count(*) FROM {documents}) AS BIGINT) AS seq_id, CAST(1 + l_partkey % 40 AS BIGINT) AS f_start,
           1 + l_partkey % 40 + CAST(l_quantity AS BIGINT) AS f_end,
           CASE WHEN l_returnflag = 'R' THEN '-' ELSE '+' END AS strand, CAST(l_suppkey % 20 AS BIGINT) AS fam_id
    FROM {lineitem}
"""
#: Nucleotide sequences: the whole texts of all documents, spelled in an IUPAC alphabet.
SEQUENCES = """
    SELECT doc_id AS seq_id,
           translate(lower(text), 'abcdefghijklmnopqrstuvwxyz .,', 'ACGTUNRYSWKMBDHVacgtunryswACG') AS sequence
    FROM {documents}
"""
TABLES = ("lineitem", "documents", "events", "orders")


def view(spark: SparkSession, sf_dir: str, sql: str) -> DataFrame:
    """A view over the parquet tables that its text names."""
    used = {t: spark.read.parquet(f"{sf_dir}/{t}.parquet") for t in TABLES if f"{{{t}}}" in sql}
    if "{pieces}" in sql:
        # a stretch makes 40 cells: stretches are spread before, as groupings by sequence want them
        used["pieces"] = view(spark, sf_dir, PIECES).repartition("dataset", "header")
    return spark.sql(sql, **used)


#: Rows of a dataset are dealt to as many slots: a slot's columns are counted in one task, and no dataset is in one.
SLOTS = 16


def aligned_rows(spark: SparkSession, sf_dir: str, *keys: str, spread: bool = True) -> DataFrame:
    """The alignments of ``CELLS`` as rows ``dataset, header, sequence``, dealt by ``keys`` (default: dataset and slot), or not (``spread``).

    A text is cut up in one pass, and a stretch is spelled out at once: ASCII by one table, others character by character.
    """
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").where("length(text) > 0")
    pieces = docs.select("source", F.col("doc_id").alias("header"), F.posexplode(F.expr("regexp_extract_all(text, '(?s).{1,40}', 0)")).alias("block", "piece"))
    rows = pieces.select(F.concat("source", F.lit("-"), "block").alias("dataset"), "header", "piece")
    if spread:
        rows = rows.repartition(*(keys or ("dataset", F.pmod(F.xxhash64("header"), F.lit(SLOTS)))))
    table = F.translate("piece", "".join(map(chr, range(1, 128))), "".join("ACGUN-"[c % 6] for c in range(1, 128)))
    chars = F.transform(F.split("piece", ""), lambda c: F.substring(F.lit("ACGUN-"), F.ascii(c) % 6 + 1, F.lit(1)))
    known = (F.octet_length("piece") == F.length("piece")) & ~F.contains("piece", F.lit("\0"))
    return rows.select("dataset", "header", F.rpad(F.when(known, table).otherwise(F.array_join(chars, "")), 40, "-").alias("sequence"))


def plain(sql: str) -> str:
    """The same text over tables of those names, with DuckDB's names for numbers in a row."""
    sql = sql.replace("{pieces}", PIECES).replace("explode(sequence(", "unnest(generate_series(")
    return sql.format(**{t: t for t in TABLES})
