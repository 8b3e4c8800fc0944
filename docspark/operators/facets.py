"""Facets and cross-tab heatmaps."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from docspark.functions import strings


def facets(df: DataFrame, fields: list[str]) -> DataFrame:
    """(field, value, n) over all fields in one pass; cells are split, concatenated values dropped."""
    cells = F.array(*(F.struct(F.lit(f).alias("field"), F.col(f).alias("cell")) for f in fields))
    parts = df.select(F.inline(cells)).where("cell <> ''").select("field", F.explode(strings.split_multivalue(F.col("cell"))).alias("value"))
    return parts.where(~strings.looks_concatenated(F.col("value"))).groupBy("field", "value").agg(F.count("*").alias("n"))


def year_facets(df: DataFrame, col: str = "map_published_year") -> DataFrame:
    return df.where(F.col(col).isNotNull()).groupBy(F.col(col).alias("year")).agg(F.count("*").alias("n"))


def range_facets(df: DataFrame, fields: list[str], most: int = 1000) -> DataFrame:
    """Per field: whether all values are numbers, their range then, and whether it has too many values to list."""
    cells = F.array(*(F.struct(F.lit(f).alias("field"), F.col(f).cast("string").alias("value")) for f in fields))
    n = F.col("value").try_cast("double")
    rows = df.select(F.inline(cells)).where("value <> ''").groupBy("field").agg(F.bool_and(n.isNotNull()).alias("numeric"), F.min(n).alias("lo"), F.max(n).alias("hi"), F.count_distinct("value").alias("values"))
    return rows.select("field", "numeric", F.when(F.col("numeric"), F.col("lo")).alias("lo"), F.when(F.col("numeric"), F.col("hi")).alias("hi"), (~F.col("numeric") & (F.col("values") > most)).alias("too_many"))


def search_facets(hits: DataFrame, docs: DataFrame, field: str, top: int = 500) -> DataFrame:
    """Documents, not chunks, among each query's best hits, by facet value."""
    best = hits.where(F.col("ord") <= top).select("query_id", "doc_id").distinct().join(docs.select("doc_id", field), "doc_id").where(F.col(field) != "")
    parts = best.select("query_id", F.explode(strings.split_multivalue(F.col(field))).alias("value")).where(~strings.looks_concatenated(F.col("value")))
    return parts.groupBy("query_id", "value").agg(F.count("*").alias("n"))


def facet_values(df: DataFrame, field: str, text: str, k: int) -> DataFrame:
    return df.where(F.col(field).ilike(f"%{text}%")).groupBy(F.col(field).alias("value")).agg(F.count("*").alias("n")).orderBy(F.desc("n"), "value").limit(k)


def heatmap_docs(docs: DataFrame, row: str, col: str) -> DataFrame:
    parts = lambda c: F.explode(strings.split_multivalue(F.col(c)))
    cells = docs.where(f"{row} <> '' AND {col} <> ''").withColumn("row_label", parts(row)).withColumn("col_label", parts(col))
    return cells.groupBy("row_label", "col_label").agg(F.count("*").alias("n"))


def heatmap_query(hits: DataFrame, row: str, col: str, cutoff: float, cap: int = 1000) -> DataFrame:
    """Per cell: documents by title, year and organisation, and hits, of those at score 0 or over the cutoff, the best
    `cap` of each cell."""
    kept = hits.where((F.col("score") == 0) | (F.col("score") >= cutoff)).withColumnsRenamed({row: "row_label", col: "col_label"})
    turn = F.row_number().over(Window.partitionBy("row_label", "col_label").orderBy(F.desc("score"), "doc_id"))
    key = F.concat_ws("|", *(F.coalesce(c, F.lit("")) for c in ("map_title", "map_published_year", "map_organization")))
    return kept.withColumn("turn", turn).where(F.col("turn") <= cap).groupBy("row_label", "col_label").agg(F.count_distinct(F.when(key != "||", key)).alias("documents"), F.count("*").alias("chunks"))


def score_cutoff(hits: DataFrame) -> DataFrame:
    """Bounds of the non-zero scores, padded where equal, and the default cutoff: a fifth below the top."""
    bounds = hits.where("score <> 0").agg(F.greatest(F.min("score"), F.lit(0.0)).alias("lo"), F.max("score").alias("hi"))
    pad = F.when(F.col("lo") == F.col("hi"), F.greatest(F.lit(0.01), F.col("hi") * 0.05)).otherwise(0.0)
    padded = bounds.select((F.col("lo") - pad).alias("lo"), (F.col("hi") + pad).alias("hi"))
    return padded.select(F.round("lo", 6).alias("lo"), F.round("hi", 6).alias("hi"), F.round(F.col("hi") - (F.col("hi") - F.col("lo")) * 0.2, 6).alias("cutoff"))


def heatmap_intensity(cells: DataFrame) -> DataFrame:
    top = cells.agg(F.max("n").alias("top"))
    return cells.join(F.broadcast(top)).select("row_label", "col_label", F.round(F.col("n") / F.col("top"), 6).alias("intensity"))  # one row


def cell_documents(hits: DataFrame) -> DataFrame:
    """The distinct documents behind hits, by how many hits they have."""
    return hits.groupBy("query_id", "map_title", "map_published_year", "map_organization").agg(F.count("*").alias("hits"), F.max("score").alias("best"))
