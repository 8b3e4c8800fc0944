"""Target-distribution importance resampling: draws the documents whose n-grams look most like a target's.

Features are runs of words, hashed into buckets. In lower case and with every stretch of separators collapsed to one
space, a text's runs of n words are the overlapped matches of one regular expression, bounded by lookarounds: each match
is the n-gram as it is hashed, so no words are cut out or joined again. The scan writes a text's bucket numbers; counts of
buckets, weights of documents and the draw are made from these, so texts are read once. A bucket's gain is the log ratio
of its smoothed shares in target and documents. The draw adds Gumbel noise from a hash of the id to the weights and takes
the highest scores: a sample without replacement, the same on every run. Ranks come from a range-partitioned sort.
"""

from __future__ import annotations

import math
from hashlib import sha256
from zlib import crc32

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from docspark.llm.bytewise import forget, release
from docspark.llm.staging import stage, table

BUCKETS = 10_000  # at most 65,536
PERCENT = 10
LEAST_WORDS = 20
SEED = "2024"
SLICE_ROWS = 256
_WORD_BYTES = [*range(0x30, 0x3A), *range(0x61, 0x7B), *range(0x80, 0x100)]
_SPACED = bytes(b if b in _WORD_BYTES else b + 32 if 0x41 <= b <= 0x5A else 0x20 for b in range(256))  # lower case, separators to spaces
_SPACES = regex.compile(rb" {2,}")


def _grams(n: int) -> regex.Pattern:
    return regex.compile(rb"(?<![^ ])[^ ]+(?: [^ ]+){%d}(?![^ ])" % (n - 1))


class Scanner:
    """Bucket numbers of all runs of `low` to `high` words of a text, in UTF-8, and how many words it has."""

    def __init__(self, low: int = 1, high: int = 1, buckets: int = BUCKETS):
        self.patterns, self.words, self.buckets = [(n, _grams(n)) for n in range(low, high + 1)], _grams(1), buckets

    def __call__(self, text: bytes) -> tuple[np.ndarray, int]:
        spaced = _SPACES.sub(b" ", text.translate(_SPACED))
        found, words = [], None
        for n, pattern in self.patterns:
            found.append(np.fromiter((crc32(m[0]) for m in pattern.finditer(spaced, overlapped=True)), np.uint32) % self.buckets)
            if n == 1:
                words = len(found[-1])
        if words is None:
            words = sum(1 for _ in self.words.finditer(spaced))
        return np.concatenate(found).astype("<u2"), words


def _texts(batch: pa.RecordBatch):
    """Ids and UTF-8 texts of some rows at a time; null texts are empty."""
    for at in range(0, len(batch), SLICE_ROWS):
        part = batch.slice(at, SLICE_ROWS)
        yield part["doc_id"], [t or b"" for t in part["text"].cast(pa.large_binary()).to_pylist()]


def featured(docs: DataFrame, low: int = 1, high: int = 1, buckets: int = BUCKETS) -> DataFrame:
    """doc_id, n_words, features: the bucket numbers of a text's runs, two bytes each."""

    def run(batches):
        forget()
        scan = Scanner(low, high, buckets)
        for batch in batches:
            for ids, texts in _texts(batch):
                got = [scan(t) for t in texts]
                cols = [ids, pa.array([n for _, n in got], pa.int64()), pa.array([f.tobytes() for f, _ in got], pa.binary())]
                yield pa.RecordBatch.from_arrays(cols, names=["doc_id", "n_words", "features"])
        release()

    return docs.mapInArrow(run, "doc_id long, n_words long, features binary")


def bucket_counts(features: DataFrame, buckets: int = BUCKETS) -> np.ndarray:
    """How often each bucket occurs; a task adds up what it reads, so `buckets` rows a task are shuffled at most."""

    def run(batches):
        total = np.zeros(buckets, np.int64)
        for batch in batches:
            for f in batch["features"]:
                total += np.bincount(np.frombuffer(f.as_buffer(), "<u2"), minlength=buckets)
        seen = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(seen, pa.int64()), pa.array(total[seen])], names=["bucket", "n"])

    counts = np.zeros(buckets, np.int64)
    for r in features.select("features").mapInArrow(run, "bucket long, n long").groupBy("bucket").agg(F.sum("n").alias("n")).toLocalIterator():
        counts[r["bucket"]] = r["n"]
    return counts


def gains(source: np.ndarray, target: np.ndarray) -> np.ndarray:
    """For each bucket, floor(1000 * log ratio) of its share in the target to that in the source, one added to each count."""
    n, s_all, t_all = len(source), float(source.sum()), float(target.sum())
    return np.array([math.floor(1000 * math.log((t + 1) * (s_all + n) / ((s + 1) * (t_all + n)))) for s, t in zip(source.astype(float).tolist(), target.astype(float).tolist(), strict=True)], np.int64)


def noise(doc_id: int, seed: str = SEED) -> int:
    """A document's Gumbel noise in thousandths."""
    h = int(sha256(f"{seed}:{doc_id}".encode()).hexdigest()[:8], 16)
    return math.floor(-1000 * math.log(-math.log((h + 0.5) / 4294967296)))


def weighted(features: DataFrame, gain: np.ndarray, seed: str = SEED) -> DataFrame:
    """doc_id, n_words, n_features, weight, score."""
    sent = features.sparkSession.sparkContext.broadcast(gain)  # a number a bucket

    def run(batches):
        for batch in batches:
            found = [np.frombuffer(f.as_buffer(), "<u2") for f in batch["features"]]
            ids, weights = batch["doc_id"].to_pylist(), [int(sent.value[f].sum()) for f in found]
            scores = [None if i is None else w + noise(i, seed) for i, w in zip(ids, weights, strict=True)]
            cols = [batch["doc_id"], batch["n_words"], pa.array([len(f) for f in found], pa.int64()), pa.array(weights, pa.int64()), pa.array(scores, pa.int64())]
            yield pa.RecordBatch.from_arrays(cols, names=["doc_id", "n_words", "n_features", "weight", "score"])

    return features.mapInArrow(run, "doc_id long, n_words long, n_features long, weight long, score long")


def drawn(scored: DataFrame, percent: int = PERCENT, least_words: int = LEAST_WORDS) -> DataFrame:
    """`scored` with rank: 1, 2, 3 ... for the floor(percent * N / 100) highest scores of the N documents with enough words
    and an id, ties to the smaller id, null for others. Rows are range-partitioned and sorted; a row's place is its place
    in its partition after the sizes of those before, of which there is a number each."""
    spark = scored.sparkSession
    open_ = (F.col("n_words") >= least_words) & F.col("score").isNotNull()
    scored = scored.withColumn("open", open_)
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    order = [F.desc("open"), F.desc("score"), F.asc("doc_id")]
    # the id of a row is its partition and, below 33 bits, its place there, in sorted order
    placed = stage(scored.repartitionByRange(parts, *order).sortWithinPartitions(*order).withColumn("at", F.monotonically_increasing_id()))
    part = F.shiftright("at", 33)
    sizes = sorted((r["part"], r["n"]) for r in placed.where("open").groupBy(part.alias("part")).agg(F.count("*").alias("n")).collect())  # one row a partition
    total, before, bases = 0, {}, []
    for p, n in sizes:
        before[p] = total
        total += n
    bases = [(p, n) for p, n in before.items()] or [(0, 0)]
    bases = F.broadcast(spark.createDataFrame(bases, "part long, base long"))
    rank = F.col("base") + F.col("at").bitwiseAND((1 << 33) - 1) + 1
    ranked = placed.withColumn("part", part).join(bases, "part", "left")
    return ranked.withColumn("rank", F.when(F.col("open") & (rank <= percent * total // 100), rank)).drop("part", "base", "at", "open")


def resample(docs: DataFrame, target: DataFrame, id_col: str = "doc_id", text_col: str = "text", target_col: str = "text", low: int = 1, high: int = 1, buckets: int = BUCKETS, percent: int = PERCENT, least_words: int = LEAST_WORDS, seed: str = SEED) -> DataFrame:
    """One row per row of `docs`: doc_id, n_words, n_features, weight, score, rank.

    Null and empty texts have no features and weight 0, and are never drawn, as are rows without an id, whose score is
    null. Repeated rows count and are ranked each; rows equal in score and id are alike, so either may come first. Texts
    are read whole. With an empty target or an empty table the smoothed shares stay defined. Other columns are ignored."""
    own = stage(featured(docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text")), low, high, buckets))
    like = featured(target.select(F.lit(None).cast("long").alias("doc_id"), F.col(target_col).alias("text")), low, high, buckets)
    return drawn(weighted(own, gains(bucket_counts(own, buckets), bucket_counts(like, buckets)), seed), percent, least_words)


def op13_resampling(spark: SparkSession, sf_dir: str) -> DataFrame:
    got = resample(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))
    return got.select("doc_id", "n_features", "weight", "score", "rank")
