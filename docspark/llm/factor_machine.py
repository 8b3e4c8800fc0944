"""Quality by a factorisation machine over hashed words, structure statistics and metadata.

A text becomes its words, hashed into DIMS buckets with damped counts of length one, and some statistics of its structure:
shares of symbols, capitals and digits, how often words and lines repeat, lengths. Numeric metadata columns join them on a
log scale, a missing value as its own feature. The model holds a weight and a vector of RANK numbers for each feature; the
score is the logistic of all weights plus, for every pair of features, their vectors' product. By the identity
sum of pairs = (square of the sum - sum of the squares) / 2, in each of the RANK numbers, all pairs take linear time.

Training reads a sample of at most SAMPLE_ROWS labelled documents, chosen by a hash of the id, as bucket numbers and
counts, four bytes for each of at most DIMS buckets, so at most 200 MB; everything is scored.
"""

from __future__ import annotations

from collections import Counter
from dataclasses import dataclass
from itertools import islice
from operator import eq
from zlib import crc32

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from docspark.llm.bytewise import forget, release
from docspark.llm.staging import one_row_per_id, stage, table

SAMPLE_ROWS = 12_000
DIMS = 4096
RANK = 8
EPOCHS, BATCH, RATE, RIDGE = 10, 256, 0.02, 1e-4
CACHE_WORDS = 60_000  # of which a task keeps the buckets, if no longer than 64 bytes
SLICE_ROWS = 256
CUT = 0.3

_CLASS = np.zeros((256, 6))  # of bytes: capitals, small letters, digits, sentence marks, other symbols, beyond ASCII
for _k, _bytes in enumerate((range(65, 91), range(97, 123), range(48, 58), b".,;:'\"?!-()", b"#$%&*+/<=>@[\\]^_`{|}~", range(128, 256))):
    _CLASS[list(_bytes), _k] = 1
STATS = ("capitals", "digits", "sentence marks", "symbols", "beyond ASCII", "words", "word length", "different words", "top word", "different lines", "line length", "words without letters", "words that end in symbols", "short words", "exclamation marks", "words after themselves", "empty")


class Texts:
    """Bucket numbers with counts, and statistics, of texts in UTF-8."""

    def __init__(self):
        self.known: dict[bytes, int] = {}

    def _bucket(self, word: bytes) -> int:
        got = crc32(word) % DIMS
        if len(word) <= 64:
            if len(self.known) >= CACHE_WORDS:
                self.known.clear()
            self.known[word] = got
        return got

    def __call__(self, text: bytes) -> tuple[np.ndarray, np.ndarray, list[float]]:
        words = text.lower().split()
        counts = Counter(words)
        get, miss = self.known.get, self._bucket
        buckets = [get(w, -1) for w in counts]
        buckets = np.array([miss(w) if b < 0 else b for w, b in zip(counts, buckets, strict=True)], np.int64)
        n = np.fromiter(counts.values(), np.int64, len(counts))
        full = np.bincount(buckets, n, DIMS)
        at = np.flatnonzero(full)
        return at, full[at], self._stats(text, counts, n, sum(map(eq, words, islice(words, 1, None))))

    def _stats(self, text: bytes, counts: Counter, n: np.ndarray, doubled: int) -> list[float]:
        hist = np.bincount(np.frombuffer(text, np.uint8), minlength=256)
        upper, lower, digit, mark, symbol, far = (hist @ _CLASS).tolist()
        words, lines = int(n.sum()), text.split(b"\n")
        solid = upper + lower + digit + mark + symbol + far
        share = lambda a, b: a / b if b else 0.0
        bare = sum(k for w, k in counts.items() if not w.isalpha() and not any(c > 127 or 97 <= c <= 122 for c in w))
        ends = sum(k for w, k in counts.items() if w[-1] in b"#$%&*+/<=>@|~^_!")
        short = sum(k for w, k in counts.items() if len(w) <= 3)
        return [
            share(upper, upper + lower), share(digit, solid), share(mark, solid), share(symbol, solid), share(far, solid),
            np.log1p(words), np.log1p(share(solid, words)), share(len(counts), words), share(int(n.max()), words) if words else 0.0, len(set(lines)) / len(lines),
            np.log1p(len(text) / len(lines)), share(bare, words), share(ends, words), share(short, words), share(int(hist[33]), words), share(doubled, words), float(not words),
        ]


@dataclass
class Rows:
    """Texts as a sparse matrix of hashed words, rows one after the other, and a dense one of statistics and metadata."""

    at: np.ndarray
    x: np.ndarray
    first: np.ndarray  # where rows begin, one more at the end
    dense: np.ndarray

    def __len__(self) -> int:
        return len(self.dense)

    def take(self, rows: np.ndarray) -> Rows:
        size = np.diff(self.first)[rows]
        first = np.append(0, np.cumsum(size))
        i = np.repeat(self.first[rows] - first[:-1], size) + np.arange(first[-1])
        return Rows(self.at[i], self.x[i], first, self.dense[rows])

    def sums(self, values: np.ndarray) -> np.ndarray:
        """Of values of the entries, by row."""
        total = np.vstack([np.zeros((1, values.shape[1])), np.cumsum(values, axis=0)])
        return total[self.first[1:]] - total[self.first[:-1]]


def sparse_rows(at: list[np.ndarray], counts: list[np.ndarray], dense: np.ndarray) -> Rows:
    x = [np.log1p(c) for c in counts]
    x = [v / np.sqrt((v * v).sum()) if len(v) else v for v in x]
    first = np.append(0, np.cumsum([len(v) for v in x])).astype(np.int64)
    return Rows(np.concatenate([np.zeros(0, np.int64), *at]).astype(np.int64), np.concatenate([np.zeros(0), *x]), first, dense)


@dataclass
class Machine:
    """w0, weights and vectors of words, weights and vectors of dense features, and how those are scaled."""

    w0: float
    w: np.ndarray
    v: np.ndarray
    wd: np.ndarray
    vd: np.ndarray
    mean: np.ndarray
    scale: np.ndarray

    def scaled(self, dense: np.ndarray) -> np.ndarray:
        return np.clip((dense - self.mean) / self.scale, -4, 4)

    def margins(self, rows: Rows) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """Margins by row; the sums of vectors, by row; the vectors times values, by entry; and the scaled dense part."""
        d = self.scaled(rows.dense)
        vx = self.v[rows.at] * rows.x[:, None]
        total = rows.sums(vx) + d @ self.vd
        squares = rows.sums(vx * vx) + (d * d) @ (self.vd * self.vd)
        linear = rows.sums((self.w[rows.at] * rows.x)[:, None])[:, 0] + d @ self.wd
        return self.w0 + linear + 0.5 * (total * total - squares).sum(1), total, vx, d

    def scores(self, rows: Rows) -> np.ndarray:
        return 1 / (1 + np.exp(-np.clip(self.margins(rows)[0], -30, 30)))


def fit(rows: Rows, y: np.ndarray, rank: int = RANK, epochs: int = EPOCHS, seed: int = 11) -> Machine:
    """Adam on the log loss, in batches whose order depends on the seed alone. With rows of one label or none, every score
    is that label, or 1."""
    width, rng = rows.dense.shape[1], np.random.default_rng(seed)
    zero = lambda: Machine(0.0, np.zeros(DIMS), np.zeros((DIMS, rank)), np.zeros(width), np.zeros((width, rank)), np.zeros(width), np.ones(width))
    model = zero()
    if not len(y) or y.min() == y.max():
        model.w0 = 30.0 if not len(y) or y[0] else -30.0
        return model
    share = y.mean()
    model.w0, model.mean, model.scale = float(np.log(share / (1 - share))), rows.dense.mean(0), rows.dense.std(0) + 1e-3
    model.v, model.vd = rng.normal(0, 0.05, (DIMS, rank)), rng.normal(0, 0.05, (width, rank))
    names = ("w0", "w", "v", "wd", "vd")
    m, s, turn = zero(), zero(), 0
    for _ in range(epochs):
        order = rng.permutation(len(y))
        for a in range(0, len(y), BATCH):
            part, turn = rows.take(order[a : a + BATCH]), turn + 1
            margin, total, vx, d = model.margins(part)
            g = (1 / (1 + np.exp(-np.clip(margin, -30, 30))) - y[order[a : a + BATCH]]) / len(part)
            by_entry = np.repeat(g, np.diff(part.first)) * part.x
            gv = by_entry[:, None] * (np.repeat(total, np.diff(part.first), axis=0) - vx)
            grads = {
                "w0": g.sum(), "w": np.bincount(part.at, by_entry, DIMS) + RIDGE * model.w, "v": np.stack([np.bincount(part.at, gv[:, k], DIMS) for k in range(rank)], 1) + RIDGE * model.v,
                "wd": d.T @ g + RIDGE * model.wd, "vd": d.T @ (g[:, None] * total) - ((d * d).T @ g)[:, None] * model.vd + RIDGE * model.vd,
            }
            for k in names:
                setattr(m, k, 0.9 * getattr(m, k) + 0.1 * grads[k])
                setattr(s, k, 0.999 * getattr(s, k) + 0.001 * grads[k] ** 2)
                step = getattr(m, k) / (1 - 0.9**turn) / (np.sqrt(getattr(s, k) / (1 - 0.999**turn)) + 1e-8)
                setattr(model, k, getattr(model, k) - RATE * step)
    return model


def _fold_of(ids: Column) -> Column:
    return F.crc32(ids.cast("string")) % 5


def _sample(labels: DataFrame, rows: int) -> DataFrame:
    """Labelled ids outside the held-out fold, at most about `rows` of them, by a hash of the id."""
    known = labels.select("doc_id", F.col("quality").cast("int").alias("quality")).where("doc_id is not null and quality is not null")
    known = known.where(_fold_of(F.col("doc_id")) != 0).groupBy("doc_id").agg(F.max("quality").alias("quality"))
    n = known.count()
    share = min(1.0, rows / n) if n else 0.0
    return known.where(F.pmod(F.xxhash64(F.col("doc_id"), F.lit(29)), F.lit(1 << 30)) < int(share * (1 << 30)))


def _measured(part: pa.RecordBatch, texts: Texts, metadata: tuple[str, ...]) -> tuple[list[np.ndarray], list[np.ndarray], np.ndarray]:
    got = [texts(t or b"") for t in part["text"].cast(pa.large_binary()).to_pylist()]
    dense = np.array([g[2] for g in got], float).reshape(len(got), len(STATS))
    for name in metadata:
        x = part[name].cast(pa.float64()).to_numpy(zero_copy_only=False)
        lost = ~np.isfinite(x)
        x = np.where(lost, 0.0, x)
        dense = np.hstack([dense, (np.sign(x) * np.log1p(np.abs(x)))[:, None], lost[:, None]])
    return [g[0] for g in got], [g[1] for g in got], dense


def _slices(batches):
    forget()
    for batch in batches:
        for at in range(0, len(batch), SLICE_ROWS):
            yield batch.slice(at, SLICE_ROWS)


def train(docs: DataFrame, labels: DataFrame, metadata: tuple[str, ...] = (), rows: int = SAMPLE_ROWS) -> Machine:
    """`docs`: doc_id, text and the metadata columns. Of rows that share an id, one with the least text digest teaches."""
    sample = F.broadcast(stage(_sample(labels, rows)))  # `rows` rows at most
    joined = docs.join(sample, "doc_id")
    single = one_row_per_id(stage(joined.select("doc_id", "text")))
    extra = stage(joined.groupBy("doc_id").agg(F.max("quality").alias("quality"), *[F.max(c).alias(c) for c in metadata]))

    def run(batches):
        texts = Texts()
        for part in _slices(batches):
            at, counts, dense = _measured(part, texts, metadata)
            small = lambda xs, top: pa.array([np.minimum(x, top).astype("<u2").tobytes() for x in xs], pa.binary())
            yield pa.RecordBatch.from_arrays([part["quality"], small(at, DIMS), small(counts, 65535), pa.array(dense.tolist(), pa.list_(pa.float64()))], names=["quality", "at", "counts", "dense"])
        release()

    got = single.join(F.broadcast(extra), "doc_id").orderBy("doc_id").mapInArrow(run, "quality int, at binary, counts binary, dense array<double>").toArrow()
    numbers = lambda name: [np.frombuffer(x.as_buffer(), "<u2") for x in got[name]]
    dense = np.array(got["dense"].to_pylist(), float).reshape(len(got), len(STATS) + 2 * len(metadata))
    return fit(sparse_rows(numbers("at"), numbers("counts"), dense), got["quality"].to_numpy().astype(float))


def quality(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", metadata: tuple[str, ...] = (), rows: int = SAMPLE_ROWS, cut: float = CUT) -> DataFrame:
    """One row per row of `docs`: doc_id, held_out, score, predicted.

    held_out tells whether crc32 of the id, as text, is divisible by 5; such rows teach nothing. Scores depend on the text,
    all of it however long, and on the numeric columns that `metadata` names, where a null is a feature of its own. Null
    texts are empty ones, which are scored by their statistics. Rows without an id are scored with a null held_out;
    repeated rows are scored each. Labels may be missing or null; a document with several is good if one says so. Other
    columns are ignored; without labels every score is close to 1."""
    docs = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"), *[F.col(c).cast("double").alias(f"meta_{k}") for k, c in enumerate(metadata)])
    names = tuple(docs.columns[2:])
    model = docs.sparkSession.sparkContext.broadcast(train(docs, labels, names, rows))

    def score(batches):
        texts = Texts()
        for part in _slices(batches):
            got = model.value.scores(sparse_rows(*_measured(part, texts, names)))
            yield pa.RecordBatch.from_arrays([part["doc_id"], pa.array(got)], names=["doc_id", "score"])
        release()

    scored = docs.mapInArrow(score, "doc_id long, score double")
    return scored.select("doc_id", (_fold_of(F.col("doc_id")) == 0).alias("held_out"), "score", (F.col("score") >= cut).cast("int").alias("predicted"))


def op11_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"), metadata=("n_chars",))
