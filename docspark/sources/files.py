"""Scans of document folders and pages, and exports."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from docspark.functions.unicode import normalized

SKIPPED = r"/(parsed|cache)/"


def scan_metadata(spark: SparkSession, path: str) -> DataFrame:
    """Every *.json below the folder but in parsed or cache ones: path, its fields as a map, and whether it is broken."""
    raw = spark.read.text(path, wholetext=True, recursiveFileLookup=True, pathGlobFilter="*.json").select(F.col("_metadata.file_path").alias("path"), "value")
    fields = F.from_json("value", "map<string,string>")
    return raw.where(~F.col("path").rlike(SKIPPED)).select("path", fields.alias("fields"), F.try_parse_json("value").isNull().alias("broken"))


def scan_content(spark: SparkSession, path: str) -> DataFrame:
    """(path, size, sha256) of every file but metadata and errors."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", True).load(path)
    return files.where(~F.col("path").rlike(r"\.(json|error)$")).select("path", F.col("length").alias("size"), F.sha2("content", 256).alias("sha256"))


def scan_errors(spark: SparkSession, path: str) -> DataFrame:
    """(path, message, checksum) of error markers: a field of JSON, else the text."""
    raw = spark.read.text(path, wholetext=True, recursiveFileLookup=True, pathGlobFilter="*.error").select(F.col("_metadata.file_path").alias("path"), "value")
    field = lambda k: F.try_variant_get(F.try_parse_json("value"), f"$.{k}", "string")
    message = F.trim(F.coalesce(field("error_message"), field("download_error"), F.col("value")))
    return raw.select("path", message.alias("message"), F.sha2(message, 256).alias("checksum"))


def _parts(df: DataFrame, col: str) -> DataFrame:
    return df.withColumns({"dir": F.regexp_extract(col, r"^(.*)/[^/]*$", 1), "stem": F.regexp_extract(col, r"([^/]*?)(\.[^./]*)?$", 1), "ext": F.lower(F.regexp_extract(col, r"(\.[^./]*)$", 1))})


def resolve_content(meta: DataFrame, files: DataFrame) -> DataFrame:
    """The content file of each metadata row: the declared name, else the same stem as .pdf, .docx or .doc, accents written
    either way. A metadata row goes to its four candidate names, so the join's key is folder and name."""
    m = _parts(meta, "path").select("path", "dir", "stem", "filename")
    names = F.array(F.col("filename"), *(F.concat("stem", F.lit(x)) for x in (".pdf", ".docx", ".doc")))
    wanted = m.select("path", "dir", F.posexplode(names).alias("rank", "name")).where("name is not null")
    f = _parts(files.select(F.col("path").alias("file")), "file")
    there = f.select("file", "dir", F.regexp_extract("file", r"([^/]*)$", 1).alias("name"), "stem", "ext")
    exact = there.select("file", "dir", "name", F.lit(True).alias("whole"))
    folded = there.where("ext in ('.pdf', '.docx', '.doc')").select("file", "dir", F.concat("stem", "ext").alias("name"), F.lit(False).alias("whole"))
    found = normalized(wanted, "name").join(normalized(exact.unionByName(folded), "name"), ["dir", "name"]).where("whole OR rank > 0")
    best = found.groupBy("path").agg(F.min_by("file", F.struct("rank", "file")).alias("content"))
    return meta.select("path").join(best, "path", "left")


def file_status(df: DataFrame) -> DataFrame:
    """downloaded with content, download_error with a marker; others drop."""
    status = F.when(F.col("content").isNotNull(), "downloaded").when(F.col("error").isNotNull(), "download_error")
    return df.withColumn("status", status).where("status is not null")


LOG_LINE = r"^(\S+ \S+) - \[([^:\]]+):(\d+):([^\]]+)\] - (\w+) - (.*)$"


def scan_logs(lines: DataFrame, col: str = "value") -> DataFrame:
    """Fields of log lines; lines of no document drop."""
    part = lambda k: F.regexp_extract(col, LOG_LINE, k)
    rows = lines.where(F.col(col).rlike(LOG_LINE)).select(part(1).alias("at"), part(2).alias("process"), part(3).cast("int").alias("pid"), part(4).alias("doc_id"), part(5).alias("level"), part(6).alias("message"))
    return rows.where("doc_id <> 'N/A'")


def log_timeline(logs: DataFrame) -> DataFrame:
    return logs.groupBy("doc_id").agg(F.min("at").alias("first_at"), F.max("at").alias("last_at"), F.count("*").alias("events"))


def export_backup(chunks: DataFrame, docs: DataFrame) -> DataFrame:
    """(doc_id, json): the document and its chunks in order."""
    rows = F.array_sort(F.collect_list(F.struct("pos", "chunk_id", "text")))  # one document
    points = chunks.groupBy("doc_id").agg(rows.alias("chunks"))
    return docs.join(points, "doc_id", "left").select("doc_id", F.to_json(F.struct(F.struct(*docs.columns).alias("document"), "chunks")).alias("json"))


def extract_blocks(pages: DataFrame) -> DataFrame:
    """(page_id, block_idx, label, level, text) of headings, paragraphs, list items and cells, in order."""
    body = F.regexp_replace("html", r"(?is)<!--.*?-->|<(script|style|nav|footer)\b.*?</\1>", " ")
    opened = r"(?i)<(?=(?:h[1-6]|p|li|td|th|figcaption)\b)"
    parts = pages.select("page_id", F.posexplode(F.split(body, opened)).alias("pos", "part")).where("pos > 0")
    tag = F.lower(F.regexp_extract("part", r"^(\w+)", 1))
    inner = F.regexp_replace(F.regexp_replace("part", r"(?is)^\w+[^>]*>", ""), r"(?s)<[^>]*>?", " ")
    text = F.trim(F.regexp_replace(inner, r"\s+", " "))
    label = F.when(tag.rlike("^h"), "section_header").when(tag == "li", "list_item").when(tag == "figcaption", "caption").when(tag.isin("td", "th"), "table").otherwise("text")
    marked = F.when((tag == "li") & ~text.rlike(r"^([-•*]|\d+[.)])\s"), F.concat(F.lit("- "), text)).otherwise(text)
    rows = parts.select("page_id", "pos", label.alias("label"), F.when(tag.rlike("^h"), F.substring(tag, 2, 1).cast("int")).alias("level"), text.alias("plain"), marked.alias("text")).where("plain <> ''")
    idx = F.row_number().over(Window.partitionBy("page_id").orderBy("pos")) - 1
    return rows.select("page_id", idx.alias("block_idx"), "label", "level", "text")
