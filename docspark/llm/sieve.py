"""A bounded Bloom filter of ids that thins a scan before a join; it only ever lets too much through.

Its size follows the number of ids up to MAX_BITS (16 MB), whatever the input. Beyond that the thinning gets weaker
and the join after it does the rest.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from docspark.llm.bytewise import mix64

MAX_BITS = 1 << 27


def _bits(ids: np.ndarray, size: int) -> list[np.ndarray]:
    a = mix64(ids.astype(np.int64).view(np.uint64))
    return [(a >> np.uint64(8)) & np.uint64(size - 1), (mix64(a + np.uint64(1)) >> np.uint64(8)) & np.uint64(size - 1)]


class Sieve:
    """Made by `sieve`; `keeps(ids)` is true for every id put in and for few others."""

    def __init__(self, words: np.ndarray):
        self.words = words

    def keeps(self, ids: np.ndarray) -> np.ndarray:
        found = np.ones(len(ids), bool)
        for b in _bits(ids, len(self.words) * 64):
            found &= (self.words[b >> np.uint64(6)] >> (b & np.uint64(63))) & np.uint64(1) == 1
        return found


def sieve(ids: DataFrame):
    """A broadcast Sieve of the one long column of `ids`."""
    spark, name = ids.sparkSession, ids.columns[0]
    ids = ids.where(F.col(name).isNotNull()).distinct()
    n = ids.agg(F.approx_count_distinct(name)).first()[0]
    size = min(MAX_BITS, max(1 << 16, 1 << int(10 * n).bit_length()))

    def pack(batches):
        for batch in batches:
            b = np.unique(np.concatenate(_bits(batch.column(0).to_numpy(zero_copy_only=False), size)))
            at, first = np.unique(b >> np.uint64(6), return_index=True)
            ones = np.uint64(1) << (b & np.uint64(63))
            masks = np.bitwise_or.reduceat(ones, first) if len(first) else ones
            yield pa.RecordBatch.from_arrays([pa.array(at.astype(np.int64)), pa.array(masks.view(np.int64))], names=["at", "mask"])

    got = ids.select(name).mapInArrow(pack, "at long, mask long").groupBy("at").agg(F.bit_or("mask").alias("mask")).toArrow()
    words = np.zeros(size // 64, np.uint64)
    words[got["at"].to_numpy()] = got["mask"].to_numpy().view(np.uint64)
    return spark.sparkContext.broadcast(Sieve(words))


def holding(batch: pa.RecordBatch, kept: Sieve, id_col: str) -> pa.RecordBatch:
    """The rows of `batch` whose id may be in `kept`."""
    ids = batch.column(batch.schema.get_field_index(id_col))
    mask = kept.keeps(ids.fill_null(0).to_numpy(zero_copy_only=False)) if len(batch) else np.zeros(0, bool)
    return batch.filter(pa.array(mask))


def thin(docs: DataFrame, kept, id_col: str) -> DataFrame:
    """The rows of `docs` whose id may be in the sieve `kept`."""

    def run(batches):
        for batch in batches:
            yield holding(batch, kept.value, id_col)

    return docs.mapInArrow(run, docs.schema)
