"""Elements of parsed pages: references, footnotes, captions, tables, images; and answers' references."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

FOOTNOTE = r"^(?:\[\^|\[|\^|<sup>)*(\d{1,3})(?:\]|</sup>|:)*\s"


def footnote_number(col: Column) -> Column:
    """The number of a footnote definition at the start of a text, else null."""
    return F.regexp_extract(col, FOOTNOTE, 1).try_cast("int")


def normalize_footnote(col: Column) -> Column:
    """`[^n] ` before a definition's text."""
    return F.when(footnote_number(col).isNotNull(), F.regexp_replace(col, r"^(?:\[\^|\[|\^|<sup>)*(\d{1,3})(?:\]|</sup>|:)*\s+", "[^$1] ")).otherwise(col)


def resolve_footnotes(elements: DataFrame) -> DataFrame:
    """(doc_id, chunk_id, number, text): the first definition in the document of each number that a chunk refers to.
    elements: doc_id, chunk_id, page, pos, text, is_reference, refs."""
    defs = elements.where("is_reference").select("doc_id", footnote_number(F.col("text")).alias("number"), "page", "pos", normalize_footnote(F.col("text")).alias("note")).where("number is not null")
    first = defs.groupBy("doc_id", "number").agg(F.min_by("note", F.struct("page", "pos")).alias("text"))
    asked = elements.where("NOT is_reference").select("doc_id", "chunk_id", F.explode("refs").alias("number")).distinct()
    return asked.join(first, ["doc_id", "number"]).select("doc_id", "chunk_id", "number", "text")


def fix_captions(pictures: DataFrame, texts: DataFrame) -> DataFrame:
    """Section headers below a picture that begin like a numbered figure become captions."""
    named = F.upper("text").rlike(r"^\s*(GRAPH|FIGURE|TABLE|CHART|BOX|MAP)\s*\d")
    below = pictures.select(F.explode("children").alias("text_id"), F.lit(True).alias("child")).distinct()
    j = texts.join(below, "text_id", "left")
    return j.withColumn("label", F.when((F.col("label") == "section_header") & F.col("child") & named, "caption").otherwise(F.col("label"))).drop("child")


def attach_images(elements: DataFrame, images: DataFrame, reach: float = 250.0) -> DataFrame:
    """(chunk_id, image_id): images on a page whose height range meets the chunk's, by up to `reach` more if one of its
    texts begins like a figure. The page is the join's key; a page holds few of either."""
    wide = F.max(F.lower("text").rlike(r"^(figure|table|diagram)").cast("int"))
    spans = elements.groupBy("doc_id", "chunk_id", "page").agg(F.min("low").alias("a"), F.max("high").alias("b"), (wide * reach).alias("more"))
    j = spans.join(images.select("doc_id", "page", "image_id", F.col("low").alias("c"), F.col("high").alias("d")), ["doc_id", "page"])
    return j.where("c <= b + more AND d >= a - more").select("chunk_id", "image_id")


def recover_tables(chunks: DataFrame, cells: DataFrame) -> DataFrame:
    """(chunk_id, table_idx): the first table of the document with two of its first 5 x 3 cells in the chunk's text."""
    first = cells.where("row < 5 AND col < 3 AND length(trim(text)) > 3").select("doc_id", "table_idx", F.trim("text").alias("cell")).distinct()
    held = chunks.join(first, "doc_id").where(F.col("text").contains(F.col("cell"))).groupBy("chunk_id", "table_idx").agg(F.count("*").alias("n"))
    return held.where("n >= 2").groupBy("chunk_id").agg(F.min("table_idx").alias("table_idx"))


def table_rows(cells: DataFrame, most: int = 50) -> DataFrame:
    """Distinct texts of each row, in order, of a table's first rows: (table_id, row, cells)."""
    turn = F.row_number().over(Window.partitionBy("table_id", "row", "text").orderBy("col"))
    kept = cells.where(F.col("row") < most).withColumn("turn", turn).where("turn = 1")
    return kept.groupBy("table_id", "row").agg(F.transform(F.array_sort(F.collect_list(F.struct("col", "text"))), lambda x: x["text"]).alias("cells"))


def chunk_text(elements: DataFrame) -> DataFrame:
    """(chunk_id, text): texts in page and position order, joined by blank lines."""
    rows = F.array_sort(F.collect_list(F.struct("page", "pos", "text")))
    return elements.where("trim(text) <> ''").groupBy("chunk_id").agg(F.array_join(F.transform(rows, lambda r: r["text"]), "\n\n").alias("text"))


def toc_from_blocks(blocks: DataFrame) -> DataFrame:
    """Headings as a table of contents: titles of 80 characters, without single numbers of 50 or more."""
    big = F.regexp_extract("text", r"^\s*(\d{2,})\.\s", 1).try_cast("int") >= 50
    heads = blocks.where("label = 'section_header'").where(~F.coalesce(big, F.lit(False)))
    return heads.select("doc_id", "pos", F.concat(F.lit("[H"), F.coalesce((F.col("level") + 1).cast("string"), F.lit("?")), F.lit("] "), F.substring("text", 1, 80), F.lit(" | page "), F.coalesce(F.col("page").cast("string"), F.lit("?"))).alias("line"))


def body_size(spans: DataFrame) -> DataFrame:
    """The most frequent rounded text size of each document, ties to the smaller."""
    n = spans.groupBy("doc_id", F.round("size").cast("int").alias("size")).agg(F.count("*").alias("n"))
    return n.groupBy("doc_id").agg(F.max_by("size", F.struct("n", (-F.col("size")).alias("s"))).alias("body_size"))


def front_run_end(labels: DataFrame) -> DataFrame:
    """(doc_id, last_page): where the last run of three or more non-decreasing roman numbers ends. labels: page, roman (int)."""
    w = Window.partitionBy("doc_id").orderBy("page")
    new = F.when(F.coalesce((F.col("roman") >= F.lag("roman").over(w)) & (F.lag("page").over(w) == F.col("page") - 1), F.lit(False)), 0).otherwise(1)
    runs = labels.where("roman is not null").withColumn("new", new).withColumn("run", F.sum("new").over(w))
    long = runs.groupBy("doc_id", "run").agg(F.count("*").alias("n"), F.max("page").alias("end")).where("n >= 3")
    return long.groupBy("doc_id").agg(F.max("end").alias("last_page"))


def grouped_references(citations: DataFrame, hits: DataFrame) -> DataFrame:
    """(answer_id, title, seq, numbers): an answer's references by document, in the order of their first citation."""
    j = citations.join(hits.select("answer_id", F.col("ord").alias("citation"), "title"), ["answer_id", "citation"])
    return j.groupBy("answer_id", "title").agg(F.min("number").alias("seq"), F.array_join(F.array_sort(F.collect_list("number")), ",").alias("numbers"))


def key_facts(answers: DataFrame) -> DataFrame:
    """(answer_id, pos, fact, cited): bullets below a `key facts` heading, without citations, with how many they had."""
    lines = answers.select("answer_id", F.posexplode(F.split("text", "\n")).alias("pos", "line"))
    heading = F.when(F.col("line").rlike(r"^\s*#+ "), F.lower(F.regexp_replace("line", r"^\s*#+\s*", "")))
    under = F.last(heading, True).over(Window.partitionBy("answer_id").orderBy("pos"))
    bullets = lines.withColumn("under", under).where(F.col("under").contains("key facts") & F.col("line").rlike(r"^\s*[-*] "))
    plain = F.trim(F.regexp_replace(F.regexp_replace("line", r"^\s*[-*]\s+", ""), r"\s*\[[\d,\s]+\]", ""))
    return bullets.select("answer_id", "pos", plain.alias("fact"), F.regexp_count("line", F.lit(r"\[[\d,\s]+\]")).alias("cited"))


def split_by_doc(df: DataFrame, ratio: float, seed: int) -> DataFrame:
    """A flag that never cuts a document: by a hash of the document and the seed."""
    return df.withColumn("train", F.pmod(F.crc32(F.concat_ws("|", F.lit(str(seed)), "doc_id")), F.lit(1000)) < int(ratio * 1000))


def sample_docs(df: DataFrame, n: int, seed: int) -> DataFrame:
    """n documents in the order of a seeded hash."""
    return df.orderBy(F.sha2(F.concat_ws("|", F.lit(str(seed)), "doc_id"), 256)).limit(n)


def merge_label_batches(rows: DataFrame, locked: DataFrame) -> DataFrame:
    """The label of the last batch; locked labels always win."""
    last = rows.groupBy("doc_id", "idx").agg(F.max_by("label", "batch").alias("label"))
    return last.join(locked.select("doc_id", "idx", F.col("label").alias("lock")), ["doc_id", "idx"], "left").select("doc_id", "idx", F.coalesce("lock", "label").alias("label"))


def apply_corrections(toc: DataFrame, edits: DataFrame) -> DataFrame:
    """User labels replace computed ones and set the edited flag."""
    j = toc.join(edits.select("doc_id", "idx", F.col("label").alias("edit")), ["doc_id", "idx"], "left")
    return j.withColumn("edited", F.col("edit").isNotNull()).withColumn("label", F.coalesce("edit", "label")).drop("edit")
