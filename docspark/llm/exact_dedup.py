"""Exact deduplication with skew-safe combining.

Every map task first deduplicates its own rows (partial aggregation), the salted groups of a digest are merged next,
and the salts' winners are combined last. The grouping key holds the full content beside its digest at each stage, so
two different contents never merge even where their digests agree. A group of copies sends at most one row per map
task and salt, whatever its size. On the way back, winners of large groups are broadcast, which bounds their number, and
their rows stay where they are; the rest meets its winners by digest.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from docspark.llm.staging import stage, table, without

WHITE = " \t\n\x0b\f\r"
LARGE = 10_000  # so many groups at most can hold a LARGE-th of all rows each; these are broadcast


def sha256(content: Column) -> Column:
    return F.sha2(content, 256)


def exact_groups(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", salts: int = 8, digest=sha256) -> DataFrame:
    """One row per input row: doc_id, keep_id, group_size, kept, text_sha256.

    Texts are equal when identical without the white space in `WHITE`. The row with the most code points in the
    original text stays, then the one with the smallest id; a null id loses to any other. A null text is empty, and
    empty texts form one group. Long texts are read whole. Repeated rows count each in group_size and share their
    decision. Other columns are ignored whatever their names.
    """
    text = F.coalesce(F.col(text_col), F.lit(""))
    rows = docs.select(F.col(id_col).alias("doc_id"), F.length(text).alias("chars"), F.translate(text, WHITE, "").alias("content")).withColumn("digest", digest(F.col("content")))
    salted = (
        rows.withColumn("salt", F.pmod(F.xxhash64("doc_id"), F.lit(salts)))
        .groupBy("digest", "content", "salt")
        .agg(F.max(F.struct("chars", F.bitwise_not("doc_id").alias("inverse"))).alias("best"), F.count("*").alias("n"))
    )
    merged = salted.repartition("digest").groupBy("digest", "content").agg(F.max("best").alias("best"), F.sum("n").alias("n"))
    alone = F.count("*") == 1
    winners = stage(
        merged.groupBy("digest").agg(
            F.when(alone, F.bitwise_not(F.first("best.inverse"))).alias("keep_id"),
            F.when(alone, F.first("n")).alias("group_size"),
            F.when(~alone, F.collect_list(F.struct("content", F.bitwise_not("best.inverse").alias("keep_id"), "n"))).alias("clash"),
        )
    )
    total = winners.agg(F.sum("group_size")).first()[0] or 0
    plain = winners.where("clash is null").drop("clash")
    large = plain.where((F.col("group_size") > 1) & (F.col("group_size") * LARGE >= total))
    small = plain.join(F.broadcast(large), "digest", "left_anti").withColumnRenamed("digest", "key")
    known = F.broadcast(large.select("digest", F.col("keep_id").alias("large_id"), F.col("group_size").alias("large_size")))
    told = rows.select("doc_id", "digest", F.sha2("content", 256).alias("text_sha256")).join(known, "digest", "left")
    apart = F.when(F.col("large_size").isNull(), F.col("digest")).otherwise(F.concat(F.lit("-"), F.xxhash64("doc_id").cast("string")))
    met = told.withColumn("key", apart).join(small, "key", "left").where("coalesce(large_size, group_size) is not null")
    shape = ["doc_id", "digest", "text_sha256", "keep_id", "group_size"]
    found = met.select("doc_id", "digest", "text_sha256", F.when(F.col("large_size").isNull(), F.col("keep_id")).otherwise(F.col("large_id")).alias("keep_id"), F.coalesce("large_size", "group_size").alias("group_size"))
    if not winners.where("clash is not null").isEmpty():
        found = found.unionByName(_told_apart(rows, winners).select(*shape))
    return found.select("doc_id", "keep_id", "group_size", F.col("doc_id").eqNullSafe(F.col("keep_id")).alias("kept"), "text_sha256")


def _told_apart(rows: DataFrame, winners: DataFrame) -> DataFrame:
    """Rows whose digest different contents share: the contents themselves are compared."""
    clash = winners.where("clash is not null").select("digest", F.explode("clash").alias("g")).select("digest", "g.*")
    told = rows.join(clash, ["digest", "content"])
    return told.select("doc_id", "digest", F.sha2("content", 256).alias("text_sha256"), "keep_id", F.col("n").alias("group_size"))


def drop_exact_copies(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The rows of `docs` that stay, with their own columns."""
    return without(docs, exact_groups(docs, id_col, text_col).where(~F.col("kept")).select("doc_id"), id_col)


def op6_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact_groups(table(spark, sf_dir, "documents"))


OP6_SQL = r"""
WITH t AS (
  SELECT doc_id, coalesce(text, '') AS body, regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]', '', 'g') AS content
  FROM documents
), g AS (
  SELECT doc_id, content, sha256(content) AS text_sha256,
         first_value(doc_id) OVER (PARTITION BY content ORDER BY length(body) DESC, doc_id) AS keep_id,
         count(*) OVER (PARTITION BY content) AS group_size
  FROM t
)
SELECT doc_id, keep_id, group_size, doc_id = keep_id AS kept, text_sha256 FROM g
"""
