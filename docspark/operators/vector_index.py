"""A stored index for approximate search: inverted lists of coarse codes, and exact scores of what they find.

`build` fits the centres of the lists on a bounded sample and writes two tables: `codes`, with every vector's list, id and
code, sorted by list, so that a scan skips the row groups of lists that nobody asks for; and `centres`, which is written
last and so marks the index as complete. A code has four bits for each dimension of the unit vector, an eighth of its
floats. Lists grow in number with the root of the corpus. `VectorIndex.search` compares codes in the lists nearest to a
query, keeps the best of each task, and scores the best `rescore` times k of all exactly.
"""

from __future__ import annotations

from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.ml.clustering import KMeans
from pyspark.ml.functions import array_to_vector
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.utils import AnalysisException

from docspark.functions import vectors
from docspark.operators.search import QUERY_ROWS, top_k

SAMPLE = 20_000  # vectors, or 32 for each list if that is more
SPREAD = 2.5  # standard deviations of a dimension that codes reach to


def lists_for(n: int) -> int:
    return max(1, round(n**0.5 / 2))


def encoded(x: np.ndarray) -> np.ndarray:
    """Unit vectors as bytes, two dimensions each; an odd last one has a byte of its own."""
    step = 2 * SPREAD / x.shape[1] ** 0.5 / 15
    q = np.clip(np.rint(x / step + 7.5), 0, 15).astype(np.uint8)
    q = np.pad(q, ((0, 0), (0, q.shape[1] % 2)))
    return q[:, ::2] << 4 | q[:, 1::2]


def decoded(code: np.ndarray, dims: int) -> np.ndarray:
    step = 2 * SPREAD / dims**0.5 / 15
    both = np.stack([code >> 4, code & 15], 2).reshape(len(code), -1)[:, :dims]
    return ((both - np.float32(7.5)) * np.float32(step)).astype(np.float32)


def _units(column: pa.Array, n: int) -> np.ndarray:
    x = column.flatten().to_numpy(zero_copy_only=False).astype(float).reshape(n, -1)
    return x / np.maximum(np.sqrt((x * x).sum(1)), vectors.TINY)[:, None]


def build(embeddings: DataFrame, path: str, lists: int | None = None, sample: int = SAMPLE) -> VectorIndex:
    """Index the vectors (vec_id long, embedding) below `path`. Null ids and null or empty vectors are left out; vectors of
    zeros are indexed and score 0."""
    spark = embeddings.sparkSession
    rows = embeddings.where(F.col("vec_id").isNotNull() & (F.size("embedding") > 0)).select(F.col("vec_id").cast("long").alias("vec_id"), "embedding")
    n = rows.count()
    lists = max(1, min(lists or lists_for(n), n))
    share = min(1.0, max(sample, 32 * lists) / max(n, 1))
    some = rows.where(F.pmod(F.xxhash64("vec_id"), F.lit(1 << 30)) < int(share * (1 << 30))) if share < 1 else rows
    unit = some.select(array_to_vector(vectors.l2_normalize(F.col("embedding"))).alias("features"))
    if lists > 1:
        centres = np.array(KMeans(k=lists, seed=7, maxIter=10).fit(unit).clusterCenters())
    else:  # one list of all, wherever its centre is
        centres = np.zeros((min(lists, n), len(rows.first()["embedding"]) if n else 1))
    sent = spark.sparkContext.broadcast(centres)

    def run(batches):
        c = sent.value
        for batch in batches:
            if len(batch):
                x = _units(batch["embedding"], len(batch))
                near = (x @ c.T - (c * c).sum(1) / 2).argmax(1)
                yield pa.RecordBatch.from_arrays([pa.array(near, pa.int32()), batch["vec_id"], pa.array([r.tobytes() for r in encoded(x)], pa.binary())], names=["list", "vec_id", "code"])

    coded = rows.mapInArrow(run, "list int, vec_id long, code binary")
    coded.repartitionByRange("list", "vec_id").sortWithinPartitions("list", "vec_id").write.mode("overwrite").parquet(f"{path}/codes")
    table = spark.createDataFrame([(i, c.tolist()) for i, c in enumerate(centres)], "list int, centre array<double>")
    table.write.mode("overwrite").parquet(f"{path}/centres")  # a row a list
    return VectorIndex(spark, path)


def built(embeddings: DataFrame, path: str, lists: int | None = None) -> VectorIndex:
    """The index below `path`, made only where there is none."""
    try:
        return VectorIndex(embeddings.sparkSession, path)
    except AnalysisException:
        return build(embeddings, path, lists)


class VectorIndex:
    def __init__(self, spark: SparkSession, path: str):
        rows = spark.read.parquet(f"{path}/centres").orderBy("list").collect()  # `lists_for` the corpus
        self.centres, self.codes = np.array([r["centre"] for r in rows], float), spark.read.parquet(f"{path}/codes")

    def search(self, embeddings: DataFrame, queries: DataFrame, k: int, probes: int | None = None, rescore: int = 8) -> DataFrame:
        """(query_id, vec_id, score, ord): the k vectors of the highest cosine among the best `rescore` times k codes of a
        query's `probes` nearest lists, four fifths of all if not given. Queries are sent to every task, QUERY_ROWS at
        a time; only ids that are found meet the exact vectors of `embeddings`."""
        n = queries.count()
        if n > QUERY_ROWS:
            parts = -(-n // QUERY_ROWS)
            turns = [queries.where(F.pmod(F.xxhash64("query_id"), F.lit(parts)) == i) for i in range(parts)]
            return reduce(DataFrame.unionByName, (self.search(embeddings, t, k, probes, rescore) for t in turns))
        found = self.candidates(queries, k * rescore, probes)
        exact = found.join(F.broadcast(queries.select("query_id", "qv")), "query_id").join(embeddings.select("vec_id", "embedding"), "vec_id")
        scored = exact.select("query_id", "vec_id", F.round(F.coalesce(vectors.cosine(F.col("embedding"), F.col("qv")), F.lit(0.0)), 6).alias("score"))
        return top_k(scored, k, "vec_id")

    def candidates(self, queries: DataFrame, most: int, probes: int | None = None) -> DataFrame:
        """(query_id, vec_id): the `most` best codes of each query."""
        key, rows = queries.schema["query_id"], queries.select("query_id", "qv").toArrow()
        if not len(rows) or not len(self.centres):
            return queries.select("query_id", F.lit(0).cast("long").alias("vec_id")).limit(0)
        probes = probes or -(-4 * len(self.centres) // 5)
        q, ids = _units(rows["qv"].combine_chunks(), len(rows)), rows["query_id"].combine_chunks()
        near = np.argsort(-(q @ self.centres.T - (self.centres * self.centres).sum(1) / 2), axis=1, kind="stable")[:, :probes]
        order = np.argsort(near.ravel(), kind="stable")  # askers of each list
        lists, heads = np.unique(near.ravel()[order], return_index=True)
        askers = dict(zip(lists.tolist(), np.split(order // near.shape[1], heads[1:]), strict=True))
        sent = queries.sparkSession.sparkContext.broadcast((q.astype(np.float32), askers))
        codes = self.codes if len(lists) == len(self.centres) else self.codes.where(F.col("list").isin(lists.tolist()))

        def run(batches):
            q, askers = sent.value
            best, who = np.full((len(q), most), -np.inf, np.float32), np.zeros((len(q), most), np.int64)
            for batch in batches:
                if not len(batch):
                    continue
                list_, vec = batch["list"].to_numpy(), batch["vec_id"].to_numpy()
                x = decoded(np.frombuffer(b"".join(batch["code"].to_pylist()), np.uint8).reshape(len(batch), -1), q.shape[1])
                heads = np.flatnonzero(np.append(True, list_[1:] != list_[:-1]))
                for a, b in zip(heads, np.append(heads[1:], len(batch)), strict=True):
                    own = askers.get(int(list_[a]))
                    if own is None:
                        continue
                    score = np.hstack([best[own], q[own] @ x[a:b].T])
                    pick = np.argpartition(-score, most - 1, axis=1)[:, :most]
                    who[own] = np.take_along_axis(np.hstack([who[own], np.broadcast_to(vec[a:b], (len(own), b - a))]), pick, 1)
                    best[own] = np.take_along_axis(score, pick, 1)
            asked, place = np.nonzero(best > -np.inf)
            yield pa.RecordBatch.from_arrays([pa.array(asked), pa.array(who[asked, place]), pa.array(best[asked, place].astype(float))], names=["asked", "vec_id", "score"])

        found = top_k(codes.mapInArrow(run, "asked long, vec_id long, score double"), most, "vec_id", "asked")
        names = queries.sparkSession.createDataFrame(pa.table({"asked": np.arange(len(ids)), "query_id": ids})).select("asked", F.col("query_id").cast(key.dataType))
        return found.join(F.broadcast(names), "asked").select("query_id", "vec_id")
