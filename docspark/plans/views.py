"""Shaped views over the tables: the document, chunk, contents, activity and file shapes that operators read.

`VIEWS` is SQL that Spark and DuckDB both run; `view` gives it as a DataFrame, `oracle` as the WITH clause of an oracle.
"""

from __future__ import annotations

import re

from pyspark.sql import DataFrame, SparkSession

from docspark.sources.shared import dealt

VIEWS = {
    "v_docs": """
SELECT CAST(doc_id AS STRING) AS doc_id, substr(split_part(text, chr(10), 1), 1, 80) AS map_title,
       source AS map_organization, lang AS map_language,
       CASE WHEN doc_id % 11 = 0 THEN NULL ELSE CAST(2015 + doc_id % 10 AS STRING) END AS map_published_year,
       CASE doc_id % 3 WHEN 0 THEN 'Evaluation' WHEN 1 THEN 'Brief' ELSE 'Study' END AS map_document_type,
       CASE doc_id % 6 WHEN 0 THEN 'Nepal' WHEN 1 THEN 'Nepal; India' WHEN 2 THEN 'Egypt, Arab Rep.'
            WHEN 3 THEN 'BangladeshCambodiaIndia' WHEN 4 THEN 'Kenya | Chad' ELSE NULL END AS map_country,
       CASE doc_id % 16 WHEN 0 THEN 'downloaded' WHEN 1 THEN 'download_error' WHEN 2 THEN 'parsing'
            WHEN 3 THEN 'parsed' WHEN 4 THEN 'parse_failed' WHEN 5 THEN 'summarizing' WHEN 6 THEN 'summarized'
            WHEN 7 THEN 'summarize_failed' WHEN 8 THEN 'tagging' WHEN 9 THEN 'tagged' WHEN 10 THEN 'indexing'
            WHEN 11 THEN 'index_failed' WHEN 12 THEN 'stopped' WHEN 13 THEN NULL ELSE 'indexed' END AS sys_status,
       concat('data/', source, '/pdfs/', lang, '/', CAST(doc_id AS STRING), '.pdf') AS sys_filepath,
       md5(text) AS sys_file_checksum, CAST(floor(n_chars / 1800.0) AS INT) + 1 AS sys_page_count, text AS sys_full_summary
FROM documents""",
    "v_stage_events": """
SELECT event_id, CAST(user_id AS STRING) AS doc_id,
       CASE event_type WHEN 'signup' THEN 'download' WHEN 'view' THEN 'parse' WHEN 'click' THEN 'summarize'
            WHEN 'purchase' THEN 'tag' ELSE 'index' END AS stage,
       ts AS at, value AS elapsed_seconds, event_id % 13 <> 0 AS success
FROM events""",
    "v_toc": """
SELECT CAST(l_orderkey AS STRING) AS doc_id,
       CAST(row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_suppkey, l_extendedprice) - 1 AS INT) AS idx,
       CAST(1 + l_partkey % 3 AS INT) AS level,
       CASE l_suppkey % 12 WHEN 0 THEN 'Executive Summary' WHEN 1 THEN 'Introduction' WHEN 2 THEN 'Methodology'
            WHEN 3 THEN 'Findings' WHEN 4 THEN 'Conclusions' WHEN 5 THEN 'Recommendations' WHEN 6 THEN 'Annex A'
            WHEN 7 THEN 'Bibliography' WHEN 8 THEN 'Acronyms' WHEN 9 THEN 'Table of Contents'
            WHEN 10 THEN 'Theory of change' ELSE 'Regional office' END AS title,
       CAST(row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_suppkey, l_extendedprice) * 2 - 1 AS INT) AS page,
       CASE WHEN l_quantity < 10 THEN true ELSE false END AS fm
FROM lineitem""",
    "v_activity": """
SELECT event_id AS id, CASE WHEN event_id % 4 = 0 THEN NULL ELSE user_id END AS user_id,
       CASE WHEN event_id % 4 = 0 THEN concat('s', CAST(user_id AS STRING)) ELSE NULL END AS session_id,
       CAST(event_id AS STRING) AS search_id, event_type AS query,
       CASE WHEN event_id % 5 = 0 THEN NULL ELSE value END AS search_duration_ms, ts AS created_at
FROM events""",
    "v_ratings": """
SELECT doc_id AS id, CASE WHEN doc_id % 9 = 0 THEN NULL ELSE doc_id % 50 END AS user_id,
       CASE doc_id % 3 WHEN 0 THEN 'search_result' WHEN 1 THEN 'ai_summary' ELSE 'taxonomy' END AS rating_type,
       CAST(doc_id % 97 AS STRING) AS reference_id, CASE WHEN doc_id % 2 = 0 THEN NULL ELSE 'item' END AS item_id,
       CAST(1 + quality * 3 + toxic AS INT) AS score
FROM labels""",
    "v_users": """
SELECT c_custkey AS user_id, concat(lower(c_name), '@example.org') AS email, c_nationkey % 7 AS group_id FROM customer""",
    "v_messages": """
SELECT CAST(conv_id AS STRING) AS thread_id, turn, role, text AS content FROM conversations""",
    "v_files_old": """
SELECT CAST(doc_id AS STRING) AS node_id, source AS agency, CAST(2015 + doc_id % 10 AS STRING) AS year,
       CASE WHEN doc_id % 8 = 0 THEN NULL ELSE md5(text) END AS md5, doc_id % 8 = 0 AS has_error, lang AS meta_language
FROM documents WHERE doc_id % 7 <> 0""",
    "v_files_new": """
SELECT CAST(doc_id AS STRING) AS node_id, source AS agency, CAST(2015 + doc_id % 10 AS STRING) AS year,
       CASE WHEN doc_id % 12 = 0 THEN NULL WHEN doc_id % 9 = 0 THEN md5(concat(text, 'x')) ELSE md5(text) END AS md5,
       doc_id % 12 = 0 AS has_error, CASE WHEN doc_id % 10 = 0 THEN '' ELSE lang END AS meta_language
FROM documents WHERE doc_id % 5 <> 0""",
}
_CHUNK_TAIL = """
SELECT CAST(doc_id AS STRING) AS doc_id, CAST(pos AS INT) AS pos,
       concat(CAST(doc_id AS STRING), '_', CAST(pos AS STRING)) AS chunk_id,
       line AS text, CAST(floor(pos / 3.0) AS INT) + 1 AS page_num
FROM ({lines}) x WHERE trim(line) <> ''"""
SPARK_VIEWS = {
    "v_chunks": _CHUNK_TAIL.format(lines=r"SELECT doc_id, pos, line FROM documents LATERAL VIEW posexplode(split(text, '\\n')) t AS pos, line"),
    "v_hits": """
WITH q AS (SELECT label AS query_id, embedding AS qv FROM (SELECT *, row_number() OVER (PARTITION BY label ORDER BY vec_id) AS rn FROM embeddings) z WHERE rn = 1),
h AS (SELECT q.query_id, e.vec_id,
  aggregate(zip_with(e.embedding, q.qv, (u, v) -> CAST(u AS DOUBLE) * CAST(v AS DOUBLE)), CAST(0 AS DOUBLE), (acc, w) -> acc + w)
  / (sqrt(aggregate(e.embedding, CAST(0 AS DOUBLE), (acc, w) -> acc + CAST(w AS DOUBLE) * CAST(w AS DOUBLE))) * sqrt(aggregate(q.qv, CAST(0 AS DOUBLE), (acc, w) -> acc + CAST(w AS DOUBLE) * CAST(w AS DOUBLE)))) AS score
  FROM embeddings e CROSS JOIN q)
SELECT query_id, vec_id, round(score, 6) AS score, row_number() OVER (PARTITION BY query_id ORDER BY round(score, 6) DESC, vec_id) AS ord FROM h""",
}
DUCK_VIEWS = {
    "v_chunks": _CHUNK_TAIL.format(lines="SELECT doc_id, i - 1 AS pos, a[i] AS line FROM (SELECT doc_id, a, unnest(range(1, len(a) + 1)) AS i FROM (SELECT doc_id, string_split(text, chr(10)) AS a FROM documents) l) q"),
    "v_hits": """
WITH q AS (SELECT label AS query_id, embedding AS qv FROM (SELECT *, row_number() OVER (PARTITION BY label ORDER BY vec_id) AS rn FROM embeddings) z WHERE rn = 1),
h AS (SELECT q.query_id, e.vec_id, list_cosine_similarity(CAST(e.embedding AS DOUBLE[]), CAST(q.qv AS DOUBLE[])) AS score FROM q CROSS JOIN embeddings e)
SELECT query_id, vec_id, round(score, 6) AS score, row_number() OVER (PARTITION BY query_id ORDER BY round(score, 6) DESC, vec_id) AS ord FROM h""",
}
_TABLES = ("documents", "events", "lineitem", "labels", "customer", "conversations", "embeddings", "pages", "orders", "part", "supplier", "nation", "region", "benchmark")


def spread(table: DataFrame) -> DataFrame:
    """A table whose files make fewer partitions than there are cores, dealt over them: what is done with its texts costs
    more than sending them. Larger ones stay as they are."""
    cores = table.sparkSession.sparkContext.defaultParallelism
    return table.repartition(cores) if table.rdd.getNumPartitions() < cores else table


def view(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    sql = (VIEWS | SPARK_VIEWS)[name]
    used = {t: spark.read.parquet(f"{sf_dir}/{t}.parquet") for t in _TABLES if re.search(rf"\b{t}\b", sql)}
    if name == "v_chunks":
        used["documents"] = spread(used["documents"].select("doc_id", "text"))
    if name == "v_toc":
        used["lineitem"] = dealt(used["lineitem"], "l_orderkey")
    for t in used:
        sql = re.sub(rf"\b(FROM|JOIN) {t}\b", rf"\1 {{{t}}}", sql)
    return spark.sql(sql, **used)


def oracle(sql: str) -> str:
    """`sql` with the views it names put before it."""
    views = VIEWS | DUCK_VIEWS
    used = [v for v in views if re.search(rf"\b{v}\b", sql)]
    head = ", ".join(f"{v} AS ({views[v]})" for v in used)
    if not head:
        return sql
    body = sql.strip()
    if body.upper().startswith("WITH RECURSIVE"):
        return f"WITH RECURSIVE {head}, {body[14:]}"
    return f"WITH {head}, {body[4:]}" if body.upper().startswith("WITH") else f"WITH {head} {body}"
