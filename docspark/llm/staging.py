"""Cutting lineage through tables in the cluster's shared folder."""

from __future__ import annotations

import re
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def shared_dir(spark: SparkSession) -> str:
    """The folder in spark.checkpoint.dir. Where it is unset, a local session, as in tests, gets a temporary one; a
    cluster is refused, as its executors would write to folders that others can't see."""
    where = spark.sparkContext.getConf().get("spark.checkpoint.dir", None) or spark.conf.get("spark.checkpoint.dir", None)
    if not where:
        if not re.match(r"local($|\[)", spark.sparkContext.master):
            raise ValueError("spark.checkpoint.dir must name a folder that driver and executors share")
        where = tempfile.mkdtemp(prefix="spark-checkpoint-")
        spark.conf.set("spark.checkpoint.dir", where)
        spark.sparkContext.setCheckpointDir(where)
    return where


ARROW_ROWS = "spark.sql.execution.arrow.maxRecordsPerBatch"


def stage(df: DataFrame, batch_rows: int | None = None) -> DataFrame:
    """Write `df` to the shared folder and read it back: later jobs neither recompute it nor need the executors
    that made it. `batch_rows` bounds the rows that Python workers get at once, for rows that are large."""
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/stage-{uuid.uuid4().hex}"
    before = spark.conf.get(ARROW_ROWS)
    if batch_rows:
        spark.conf.set(ARROW_ROWS, str(batch_rows))
    try:
        df.write.parquet(path)
    finally:
        spark.conf.set(ARROW_ROWS, before)
    made = spark.read.schema(df.schema).parquet(path)
    made.staged_at = path
    return made


def drop_stage(*made: DataFrame | None) -> None:
    """Delete the files of staged tables that no later plan reads."""
    for df in made:
        if df is not None:
            where = df.sparkSession.sparkContext._jvm.org.apache.hadoop.fs.Path(df.staged_at)
            where.getFileSystem(df.sparkSession.sparkContext._jsc.hadoopConfiguration()).delete(where, True)


BROADCAST_ROWS = 1_000_000


def without(docs: DataFrame, drop: DataFrame, id_col: str) -> DataFrame:
    """The rows of `docs` whose id is not in the one column of `drop`; null ids stay. The ids are staged and counted: up
    to BROADCAST_ROWS go to every executor, more are joined by a shuffle."""
    name = f"__{uuid.uuid4().hex}"  # clashes with no column
    ids = stage(drop.toDF(name).distinct())
    if ids.count() <= BROADCAST_ROWS:
        ids = F.broadcast(ids)
    return docs.join(ids, docs[id_col] == F.col(name), "left_anti")


def one_row_per_id(docs: DataFrame) -> DataFrame:
    """`docs` (doc_id, text) with one row for each id: of several, the one whose text has the least SHA-256, null texts
    counting as empty. Only ids are counted, and only texts of repeated ids compared."""
    repeated = stage(docs.groupBy("doc_id").count().where("count > 1").select("doc_id"))
    if repeated.isEmpty():
        return docs
    named = docs.join(repeated, "doc_id").select("doc_id", "text", F.sha2(F.coalesce("text", F.lit("")), 256).alias("sha"))
    return docs.join(repeated, "doc_id", "left_anti").unionByName(named.groupBy("doc_id").agg(F.min_by("text", "sha").alias("text")).select("doc_id", "text"))


def for_each_row(rows: DataFrame, single: DataFrame, found: DataFrame) -> DataFrame:
    """`found`, a row for each id of `single` = one_row_per_id(rows), with a row for each of `rows`."""
    return found if single is rows else rows.select("doc_id").join(found, "doc_id")


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")
