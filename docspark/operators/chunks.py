"""Chunks of documents: deduplication, assembly, windows over text."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StructField, StructType, _parse_datatype_string
from pyspark.sql.window import Window

from docspark.functions import strings


def dedupe_chunks(chunks: DataFrame) -> DataFrame:
    """Of equal texts on a page of a document, the smallest chunk id."""
    turn = F.row_number().over(Window.partitionBy("doc_id", "page_num", F.md5("text")).orderBy("chunk_id"))
    return chunks.withColumn("turn", turn).where("turn = 1").drop("turn")


def dedupe_built(chunks: DataFrame) -> DataFrame:
    """Of equal texts on a page of a document, the first in order."""
    turn = F.row_number().over(Window.partitionBy("doc_id", "page_num", "text").orderBy("pos"))
    return chunks.withColumn("turn", turn).where("turn = 1").drop("turn")


def number_chunks(chunks: DataFrame) -> DataFrame:
    n = F.row_number().over(Window.partitionBy("doc_id").orderBy("pos")) - 1
    return chunks.withColumn("idx", n).withColumn("uuid", strings.uuid5(F.concat_ws("_", "doc_id", "idx"), strings.NAMESPACE_DNS))


def build_chunks(blocks: DataFrame, max_tokens: int) -> DataFrame:
    """Greedy packing of a document's blocks, in order, up to a token budget: (doc_id, chunk, text, tokens, page_num)."""
    one = F.struct("pos", "text", "page_num", F.size(F.split(F.trim("text"), r"\s+")).alias("n"))
    per_doc = blocks.groupBy("doc_id").agg(F.array_sort(F.collect_list(one)).alias("blocks"))  # one document
    start = F.struct(F.array().cast("array<int>").alias("ids"), F.lit(0).alias("id"), F.lit(0).alias("used"))

    def add(s: Column, b: Column) -> Column:
        full = (s["used"] > 0) & (s["used"] + b["n"] > max_tokens)
        id_ = F.when(full, s["id"] + 1).otherwise(s["id"])
        return F.struct(F.concat(s["ids"], F.array(id_)).alias("ids"), id_.alias("id"), F.when(full, b["n"]).otherwise(s["used"] + b["n"]).alias("used"))

    ids = F.aggregate("blocks", start, add, lambda s: s["ids"])
    rows = per_doc.withColumn("ids", ids).select("doc_id", F.inline(F.arrays_zip(F.col("blocks"), F.col("ids")))).select("doc_id", F.col("ids").alias("chunk"), "blocks.*")
    text = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("pos", "text"))), lambda x: x["text"]), "\n\n")
    return rows.groupBy("doc_id", "chunk").agg(text.alias("text"), F.sum("n").alias("tokens"), F.min("page_num").alias("page_num"))


KEPT_ITEMS = ("list_item", "section_header", "caption", "table_caption")


def drop_small(chunks: DataFrame, n: int = 100, items: str | None = None) -> DataFrame:
    keep = F.length(F.trim("text")) >= n
    return chunks.where(keep | F.arrays_overlap(items, F.array(*map(F.lit, KEPT_ITEMS))) if items else keep)


def limit_tokens(chunks: DataFrame, n: int, mode: str = "truncate", words: bool = True) -> DataFrame:
    """Blank chunks dropped, others cut after n tokens; in the mode `stop` an error names the first ten that are longer. A token
    is a word, or, where there is no tokenizer, four characters."""
    if mode not in ("truncate", "stop"):
        raise ValueError(f"no such mode: {mode}")
    rows, toks = chunks.where(F.trim("text") != ""), F.split(F.trim("text"), r"\s+")
    count = F.size(toks) if words else F.floor(F.length("text") / 4)
    if mode == "stop":
        long_ = [r["chunk_id"] for r in rows.where(count > n).select("chunk_id").orderBy("chunk_id").limit(10).collect()]
        if long_:
            raise ValueError(f"chunks of more than {n} tokens: {', '.join(map(str, long_))}")
        return rows
    cut = F.array_join(F.slice(toks, 1, n), " ") if words else F.substring("text", 1, 4 * n)
    return rows.withColumn("text", F.when(count > n, cut).otherwise(F.col("text")))


def hierarchy_prefix(headings: Column) -> Column:
    """`-- a > b > c --` and a blank line, of the last three headings."""
    last = F.transform(F.slice(headings, F.greatest(F.size(headings) - 2, F.lit(1)), 3), lambda h: F.translate(h, "<>", ""))
    return F.when(F.size(headings) > 0, F.concat(F.lit("-- "), F.array_join(last, " > "), F.lit(" --\n\n"))).otherwise("")


def strip_heading(text: Column, heading: Column) -> Column:
    """Without a first line that repeats the headings or is a `-- … --` line, and without one blank line after it."""
    first, rest = F.substring_index(text, "\n", 1), F.expr("1")
    rest = F.substring(text, F.length(first) + 2, F.length(text))
    same = (F.lower(F.trim(first)) == F.lower(heading)) | F.trim(first).rlike("^--.*>.*--$")
    return F.when(same, F.regexp_replace(rest, r"^\n", "")).otherwise(text)


def sentences(docs: DataFrame, col: str) -> DataFrame:
    """(doc_id, pos, sentence): sentences of more than five words without table marks."""
    parts = F.split(F.regexp_replace(col, r"\s+", " "), r"(?<=[.!?]) ")
    rows = docs.select("doc_id", F.posexplode(parts).alias("pos", "sentence"))
    return rows.where((F.size(F.split(F.trim("sentence"), " ")) > 5) & ~F.col("sentence").contains("|") & ~F.col("sentence").contains("---"))


def split_overlap(docs: DataFrame, col: str, size: int, overlap: int) -> DataFrame:
    """Windows of `size` characters, each starting `size - overlap` after the one before, until the end is reached."""
    step = size - overlap
    starts = F.sequence(F.lit(0), F.greatest(F.ceil((F.length(col) - overlap) / step) - 1, F.lit(0)).cast("int"))
    rows = docs.where(F.length(col) > 0).select("doc_id", F.col(col).alias("t"), F.explode(starts).alias("part"))
    return rows.select("doc_id", "part", F.substring("t", F.col("part") * step + 1, F.lit(size)).alias("text"))


def _summed(batches):
    """Of rows (doc_id, vector), for each stretch of one id in a batch: sums and counts of the vectors' places."""
    for batch in batches:
        ids, vectors = batch["doc_id"], batch["vector"]
        if not len(batch):
            continue
        fresh = pc.fill_null(pc.not_equal(ids.slice(1), ids.slice(0, len(ids) - 1)), True).to_numpy(zero_copy_only=False)
        first = np.flatnonzero(np.append(True, fresh))
        sizes = pc.fill_null(pc.list_value_length(vectors), 0).to_numpy(zero_copy_only=False).astype(np.int64)
        values, widths = vectors.flatten(), np.maximum.reduceat(sizes, first)
        starts = np.cumsum(widths) - widths  # of each stretch's places
        own = np.repeat(np.cumsum(np.append(0, fresh)), sizes)
        at = starts[own] + np.arange(len(own)) - np.repeat(np.cumsum(sizes) - sizes, sizes)
        there = values.is_valid().to_numpy(zero_copy_only=False)
        full = pc.fill_null(values, 0.0).to_numpy(zero_copy_only=False)
        n = int(widths.sum())
        offsets = pa.array(np.append(starts, n), pa.int32())
        sums, counts = np.bincount(at, full, n), np.bincount(at[there], minlength=n)
        yield pa.RecordBatch.from_arrays([ids.take(pa.array(first)), *[pa.ListArray.from_arrays(offsets, pa.array(x)) for x in (sums, counts)]], names=["doc_id", "sums", "counts"])


def centroid_summary(rows: DataFrame, k: int = 30) -> DataFrame:
    """Per document the k sentences nearest to the mean vector, in their order. rows: doc_id, pos, sentence, vector."""
    from docspark.functions import vectors

    kind = rows.schema["doc_id"].dataType
    part = StructType([StructField("doc_id", kind), *_parse_datatype_string("sums array<double>, counts array<long>")])
    sums = rows.select("doc_id", F.col("vector").cast("array<double>").alias("vector")).mapInArrow(_summed, part)
    parts = sums.select("doc_id", F.posexplode(F.arrays_zip("sums", "counts")).alias("i", "x"))
    mean = parts.groupBy("doc_id", "i").agg((F.sum("x.sums") / F.nullif(F.sum("x.counts"), F.lit(0))).alias("x"))
    mean = mean.groupBy("doc_id").agg(F.transform(F.array_sort(F.collect_list(F.struct("i", "x"))), lambda s: s["x"]).alias("mean"))
    near = rows.join(mean, "doc_id").withColumn("near", F.round(vectors.cosine(F.col("vector"), F.col("mean")), 6))
    turn = F.row_number().over(Window.partitionBy("doc_id").orderBy(F.desc("near"), "pos"))
    best = near.withColumn("turn", turn).where(F.col("turn") <= k)
    return best.groupBy("doc_id").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("pos", "sentence"))), lambda s: s["sentence"]), "\n---\n").alias("summary"))


def drop_repeats(messages: DataFrame) -> DataFrame:
    """Without messages equal to, or contained in, the one before in their thread, white space aside."""
    plain = F.trim(F.regexp_replace("content", r"\s+", " "))
    before = F.lag(plain).over(Window.partitionBy("thread_id").orderBy("turn"))
    return messages.withColumn("before", before).where(F.col("before").isNull() | ~F.col("before").contains(plain)).drop("before")


def redundant_with_table(text: Column, table: Column, share: float = 0.8) -> Column:
    """More than the share of the words over three characters stand in the table's text."""
    words = F.filter(F.regexp_extract_all(F.lower(text), F.lit(r"\w+"), F.lit(0)), lambda w: F.length(w) > 3)
    held = lambda low, words: F.size(F.filter(words, lambda w: low.contains(w))) / F.nullif(F.size(words), F.lit(0))
    part = strings.let(F.lower(table), lambda low: strings.let(words, lambda found: held(low, found)))
    return F.coalesce(part > share, F.lit(False))


def citations(answers: DataFrame, limit: str = "n_hits") -> DataFrame:
    """(answer_id, citation, number): distinct cited numbers within range, ascending, renumbered from 1."""
    groups = F.explode(F.regexp_extract_all("text", F.lit(r"\[(\d+(?:\s*,\s*\d+)*)\]"), F.lit(1)))
    rows = answers.select("answer_id", limit, groups.alias("g")).select("answer_id", limit, F.explode(F.split("g", r"\s*,\s*")).alias("c"))
    kept = rows.select("answer_id", F.col("c").try_cast("int").alias("citation"), limit).where(f"citation between 1 and {limit}").select("answer_id", "citation").distinct()
    return kept.withColumn("number", F.dense_rank().over(Window.partitionBy("answer_id").orderBy("citation")))


def image_mentions(chunks: DataFrame, images: DataFrame) -> DataFrame:
    """Images whose number stands after figure, table, graph or map in the text."""
    found = F.explode(F.regexp_extract_all(F.lower("text"), F.lit(r"\b(?:figure|table|graph|map)\s+(\d+(?:\.\d+)?)"), F.lit(1)))
    return chunks.select("chunk_id", "doc_id", found.alias("number")).distinct().join(images, ["doc_id", "number"])
