"""The folder that driver and executors share, for tables that outlive a query."""

from __future__ import annotations

import re
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def shared_folder(spark: SparkSession) -> str:
    """The folder in spark.checkpoint.dir. Where it is unset, a local session, as in tests, gets a temporary one for as long
    as it lives; a cluster is refused, as its executors would write to folders that others can't see."""
    where = spark.sparkContext.getConf().get("spark.checkpoint.dir", None) or spark.conf.get("spark.checkpoint.dir", None)
    if not where:
        if not re.match(r"local($|\[)", spark.sparkContext.master):
            raise ValueError("spark.checkpoint.dir must name a folder that driver and executors share")
        where = tempfile.mkdtemp(prefix="spark-shared-")
        spark.conf.set("spark.checkpoint.dir", where)
    return where


def fingerprint(table: DataFrame) -> str:
    """What names the state of a table that is read from files: their paths, sizes and times, added up by Spark."""
    files = table.select("_metadata.file_path", "_metadata.file_size", "_metadata.file_modification_time").distinct()
    both = files.agg(F.count("*").alias("n"), F.bit_xor(F.xxhash64("*")).alias("x")).first()
    return f"{both['n']}-{(both['x'] or 0) & (1 << 64) - 1:016x}"


def staged(df: DataFrame) -> DataFrame:
    """`df`, written to the shared folder and read back: what follows neither computes it again nor needs the executors
    that made it."""
    spark = df.sparkSession
    path = f"{shared_folder(spark)}/table-{uuid.uuid4().hex}"
    df.write.parquet(path)
    made = spark.read.schema(df.schema).parquet(path)
    made.staged_at = path
    return made


def dropped(made: DataFrame) -> None:
    """Delete the files of a staged table that no later plan reads."""
    where = made.sparkSession.sparkContext._jvm.org.apache.hadoop.fs.Path(made.staged_at)
    where.getFileSystem(made.sparkSession.sparkContext._jsc.hadoopConfiguration()).delete(where, True)


ROWS_A_TASK = 1_000_000


def dealt(table: DataFrame, *keys: str) -> DataFrame:
    """A table that is too large for Spark's number of shuffle partitions, dealt by its keys into more, of about ROWS_A_TASK
    rows each: what a task sorts doesn't grow with the table. Others stay as they are."""
    own = int(table.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    parts = -(-table.count() // ROWS_A_TASK)
    return table.repartition(parts, *keys) if parts > own else table


def once(df: DataFrame, *names: str) -> DataFrame:
    """`df` with columns that are computed once a row, however often later plans name them: Catalyst would put a column's
    expression wherever it is used, but doesn't look through a generator."""
    row = F.explode(F.array(F.struct(*names))).alias("__once")
    return df.select(*[c for c in df.columns if c not in names], row).select(*[F.col(f"__once.{c}") if c in names else F.col(c) for c in df.columns])
