"""Registered queries over pages and exports, and the model surface."""

from __future__ import annotations

from pyspark.sql import functions as F

from docspark.functions import models
from docspark.plans.registry import query
from docspark.plans.views import view
from docspark.sources import files


@query("a15_extract_blocks")
def a15(spark, sf):
    return files.extract_blocks(spark.read.parquet(f"{sf}/pages.parquet"))


@query("a12_export_backup")
def a12(spark, sf):
    return files.export_backup(view(spark, sf, "v_chunks"), view(spark, sf, "v_docs").select("doc_id", "map_title"))


@query("a14_scan_logs", """SELECT CAST(user_id AS STRING) AS doc_id, count(*) AS events FROM events WHERE user_id % 7 <> 0 GROUP BY 1""")
def a14(spark, sf):
    e = spark.read.parquet(f"{sf}/events.parquet")
    doc = F.when(F.col("user_id") % 7 == 0, "N/A").otherwise(F.col("user_id").cast("string"))
    line = F.concat(F.date_format("ts", "yyyy-MM-dd HH:mm:ss"), F.lit(" - [worker:12:"), doc, F.lit("] - INFO - "), "event_type")
    return files.log_timeline(files.scan_logs(e.select(line.alias("value")))).select("doc_id", "events")


@query("a04_resolve_content", """SELECT 'm/' || doc_id || '.json' AS path, CASE CAST(doc_id AS INT) % 4 WHEN 0 THEN 'm/' || doc_id || '.pdf' WHEN 1 THEN 'm/' || doc_id || '.DOC' WHEN 2 THEN 'm/other' || doc_id || '.pdf' END AS content FROM v_docs""")
def a04(spark, sf):
    """All files in one flat folder."""
    d = view(spark, sf, "v_docs")
    k = F.col("doc_id").cast("int") % 4
    meta = d.select(F.concat(F.lit("m/"), "doc_id", F.lit(".json")).alias("path"), F.when(k == 2, F.concat(F.lit("other"), "doc_id", F.lit(".pdf"))).alias("filename"))
    name = F.when(k == 0, F.concat("doc_id", F.lit(".pdf"))).when(k == 1, F.concat("doc_id", F.lit(".DOC"))).when(k == 2, F.concat(F.lit("other"), "doc_id", F.lit(".pdf"))).otherwise(F.concat("doc_id", F.lit(".txt")))
    return files.resolve_content(meta, d.select(F.concat(F.lit("m/"), name).alias("path")))


@query("a05_file_status", """SELECT doc_id, CASE WHEN CAST(doc_id AS INT) % 3 = 0 THEN 'downloaded' ELSE 'download_error' END AS status FROM v_docs WHERE CAST(doc_id AS INT) % 3 < 2""")
def a05(spark, sf):
    k = F.col("doc_id").cast("int") % 3
    return files.file_status(view(spark, sf, "v_docs").select("doc_id", F.when(k == 0, "c").alias("content"), F.when(k == 1, "e").alias("error"))).select("doc_id", "status")


@query("j01_embed")
def j01(spark, sf):
    return models.apply(view(spark, sf, "v_chunks").select("chunk_id", "text"), "embedder", "text", "vector array<float>")


@query("j03_summarise")
def j03(spark, sf):
    return models.apply(view(spark, sf, "v_docs").select("doc_id", F.col("sys_full_summary").alias("text")), "summariser", "text", "summary string").drop("text")


@query("j04_label")
def j04(spark, sf):
    return models.apply(view(spark, sf, "v_toc").select("doc_id", "idx", "title"), "labeller", "title", "label string")
