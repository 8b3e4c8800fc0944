"""Benchmark decontamination: MinHash containment search, partitioned by size, then exact shingle containment.

An item's sketch is the bottom of one random order of its shingles. Items are partitioned by size class
[2^c, 2^(c+1)), and a class takes floor((1 - t) * upper size) + 1 values: a document that holds the share t of an
item's shingles misses at most floor((1 - t) * size) of them, so it holds at least one value of the sketch and no
match is lost. Items alone are sketched, one bottom sketch each; of a long document every shingle is probed, as its
own sketch would hold few of a short item's. Only documents with enough words for t are probed. Candidates are verified on their full shingle
sets, as strings.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from docspark.llm.staging import stage, table, without

WIDTH = 5
THRESHOLD = 80  # percent
BROADCAST_ROWS = 1_000_000  # sketch values, item shingles or candidates sent to every executor at most
WHITE = " \t\n\x0b\f\r"
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def words(text: Column) -> Column:
    return F.split(F.btrim(F.translate(text, UPPER, LOWER), F.lit(WHITE)), r"[ \t\n\x0B\f\r]+")


def _tokenised(df: DataFrame, id_col: str, text_col: str, name: str) -> DataFrame:
    df = df.select(F.col(id_col).alias(name), words(F.col(text_col)).alias("w"))
    return df.where(F.element_at("w", 1) != "")


def _shingles(df: DataFrame, width: int) -> DataFrame:
    """A row per position; a text with fewer words than `width` is one shingle."""
    last = F.greatest(F.size("w") - width, F.lit(0))
    return df.withColumn("i", F.explode(F.sequence(F.lit(0), last)))


def _key(width: int) -> Column:
    return F.xxhash64(*(F.get("w", F.col("i") + k) for k in range(width)))


def _shingle(width: int) -> Column:
    return F.array_join(F.slice("w", F.col("i") + 1, width), " ")


def _small(df: DataFrame) -> DataFrame:
    """Broadcast if its counted rows are few, else left to a shuffled join."""
    return F.broadcast(df) if df.count() <= BROADCAST_ROWS else df


def contaminated(docs: DataFrame, items: DataFrame, doc_id: str = "doc_id", doc_text: str = "text", item_id: str = "item_id", item_text: str = "text", width: int = WIDTH, threshold: int = THRESHOLD) -> DataFrame:
    """One row per document and item it contains: doc_id, item_id, item_shingles, matched.

    A document contains an item when it holds `threshold` percent or more of the item's distinct shingles of `width`
    lower-cased words. A text of fewer words is one shingle, equal only to another text of just these words. Null and
    empty texts hold nothing and are held by nothing; long texts are read whole; repeated rows count once; other columns
    are ignored.
    """
    parts = stage(
        _shingles(_tokenised(items, item_id, item_text, "item_id"), width)
        .select("item_id", _shingle(width).alias("shingle"), _key(width).alias("key"))
        .distinct()
    )
    sizes = parts.groupBy("item_id").agg(F.count("*").alias("item_shingles"))
    ranked = parts.join(sizes, "item_id").withColumn("rank", F.row_number().over(Window.partitionBy("item_id").orderBy(F.xxhash64("key"), "shingle")))
    upper = F.pow(F.lit(2), F.floor(F.log2("item_shingles")) + 1).cast("long") - 1
    need = F.ceil(F.col("item_shingles") * threshold / 100)
    sketch = stage(ranked.where(F.col("rank") <= F.floor(upper * (100 - threshold) / 100) + 1).select("item_id", "key", need.alias("need")))
    read = _tokenised(docs, doc_id, doc_text, "doc_id")
    probe = _shingles(read, width).select("doc_id", F.greatest(F.size("w") - width + 1, F.lit(1)).alias("room"), _key(width).alias("key"))
    candidates = stage(probe.join(_small(sketch), "key").where(F.col("room") >= F.col("need")).select("doc_id", "item_id").distinct())
    held = (
        _shingles(read.join(_small(candidates), "doc_id"), width)
        .select("doc_id", "item_id", _shingle(width).alias("shingle"))
        .join(_small(parts.select("item_id", "shingle")), ["item_id", "shingle"])
        .distinct()
        .groupBy("doc_id", "item_id")
        .agg(F.count("*").alias("matched"))
    )
    return (
        held.join(_small(sizes), "item_id")
        .where(F.col("matched") * 100 >= F.col("item_shingles") * threshold)
        .select("doc_id", "item_id", "item_shingles", "matched")
    )


def drop_contaminated(docs: DataFrame, items: DataFrame, doc_id: str = "doc_id", doc_text: str = "text") -> DataFrame:
    """The documents that contain no item, with their own columns."""
    return without(docs, contaminated(docs, items, doc_id, doc_text).select("doc_id"), doc_id)


def op5_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return contaminated(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


OP5_SQL = r"""
WITH d AS (
  SELECT doc_id, regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS w FROM documents
), b AS (
  SELECT item_id, regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS w FROM benchmark
), ds AS (
  SELECT DISTINCT doc_id, array_to_string(w[i:i + 4], ' ') AS s, len(w) < 5 AS short
  FROM (SELECT doc_id, w, unnest(range(1, greatest(len(w) - 4, 1) + 1)) AS i FROM d WHERE len(w) > 0) q
), bs AS (
  SELECT DISTINCT item_id, array_to_string(w[i:i + 4], ' ') AS s, len(w) < 5 AS short
  FROM (SELECT item_id, w, unnest(range(1, greatest(len(w) - 4, 1) + 1)) AS i FROM b WHERE len(w) > 0) q
), n AS (SELECT item_id, count(*) AS item_shingles FROM bs GROUP BY item_id),
m AS (SELECT doc_id, item_id, count(*) AS matched FROM ds JOIN bs USING (s) GROUP BY doc_id, item_id)
SELECT doc_id, item_id, item_shingles, matched FROM m JOIN n USING (item_id) WHERE matched * 100 >= item_shingles * 80
"""
