"""A bigram language model in a log-frequency Bloom filter.

Map tasks combine the n-grams of up to FLUSH_TOKENS tokens, a piece, and send them in hash buckets, sorted and packed,
with their training counts. A count is quantised to the level j of the largest step LEVELS[j] below or equal to it, and
the n-gram goes into the filter once for each of the levels 1..j; a reader probes level after level until one is
missing, so the filter answers with quantised counts. Each bucket owns a segment of the filter, of BITS_EACH bits an
entry: one task merges the bucket's counts, fills the segment and answers every piece's n-grams from it, and the answers
return to the pieces' tokens by a second shuffle. Buckets grow in number with the corpus and nothing is pruned; no task
holds more than a segment or a piece.

P(w | v) = max(c(vw) - D, 0) / c(v) + A P(w), P(w) = (1 - u) c(w) / N for known words and u for an unknown one, with
D = n1 / (n1 + 2 n2) from the counts of counts of pairs, A = D * distinct pairs / pairs, u the share of words seen once.
"""

from __future__ import annotations

import zlib
from math import log10

import numpy as np
import pyarrow as pa
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from docspark.llm.bytewise import Digests, Piece, mix64, pieces, seeded
from docspark.llm.staging import for_each_row, one_row_per_id, stage, table

BITS_EACH = 10
PROBES = 4
HEAD_SHARE = 5e-7  # of no effect: all exact counts come from the buckets; tests set it
BUCKET_TOKENS = 1_500_000
FLUSH_TOKENS = 3_000_000
BOUNDARY = seeded(11, 1)[0]


def _levels() -> np.ndarray:
    """Every count up to 16, then steps of a seventh."""
    steps = list(range(1, 17))
    while steps[-1] < 1 << 50:
        steps.append(steps[-1] * 8 // 7)
    return np.array(steps, np.int64)


LEVELS = _levels()


def held_out(ids: np.ndarray, parts: int = 7, part: int = 2) -> np.ndarray:
    return np.array([zlib.crc32(str(int(i)).encode()) % parts == part for i in ids], bool)


def _tokens(p: Piece, digests: Digests) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Token fingerprints with an end after each document, those of the token before each (the boundary first), and
    where documents begin (one more at the end)."""
    h, first = digests.of(p)
    h = h[:, 0]
    offs = first + np.arange(len(first))
    got = np.empty(offs[-1], np.uint64)
    word = np.ones(offs[-1], bool)
    word[offs[1:] - 1] = False
    got[word], got[~word] = h, BOUNDARY
    before = np.empty_like(got)
    before[1:] = got[:-1]
    before[offs[:-1]] = BOUNDARY
    return got, before, offs


def _pair(before: np.ndarray, h: np.ndarray) -> np.ndarray:
    return mix64(before * np.uint64(0x9E3779B97F4A7C15) + h)


def _planes(z, x: np.ndarray) -> bytes:
    """Numbers byte by byte of their places, which packs tighter: upper bytes are mostly alike."""
    return z.compress(np.ascontiguousarray(x.view(np.uint8).reshape(len(x), x.itemsize).T).tobytes())


def _whole(raw: bytes, kind) -> np.ndarray:
    size = np.dtype(kind).itemsize
    return np.ascontiguousarray(np.frombuffer(raw, np.uint8).reshape(size, -1).T).reshape(-1).view(kind)


def _packed(z, h: np.ndarray, n: np.ndarray) -> bytes:
    return _planes(z, np.concatenate([np.diff(h, prepend=np.uint64(0)), n.astype(np.int64).view(np.uint64)]))


def _unpacked(packed: bytes) -> tuple[np.ndarray, np.ndarray]:
    x = _whole(zstandard.ZstdDecompressor().decompress(packed), np.uint64)
    return np.cumsum(x[: len(x) // 2], dtype=np.uint64), x[len(x) // 2 :].view(np.int64)


def _merged(parts: list[tuple[np.ndarray, np.ndarray]]) -> tuple[np.ndarray, np.ndarray]:
    h, n = (np.concatenate(x) for x in zip(*parts, strict=True))
    order = np.argsort(h)
    h, n = h[order], n[order]
    heads = np.flatnonzero(np.append(True, h[1:] != h[:-1])) if len(h) else np.zeros(0, np.int64)
    return h[heads], np.add.reduceat(n, heads) if len(heads) else n


NGRAMS = "bucket long, piece long, words binary, pairs binary, tokens binary"


def _rows(bucket, piece, words, pairs, tokens=None) -> pa.RecordBatch:
    n = len(bucket)
    kinds = (pa.int64(), pa.int64(), pa.binary(), pa.binary(), pa.binary())
    cols = (bucket, np.full(n, piece) if np.isscalar(piece) else piece, words, pairs, tokens or [None] * n)
    return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, kinds, strict=True)], names=["bucket", "piece", "words", "pairs", "tokens"])


def _gather(buckets: int):
    """For every piece, a row per bucket with its n-grams and their training counts (0 if only held-out documents have
    them), and a row of its own, in bucket -1 - piece, with its documents and tokens."""

    edges = _edges(buckets)

    def rows(piece: int, held: list):
        z = zstandard.ZstdCompressor(level=1)
        ids, sizes, h, before = (np.concatenate(x) for x in zip(*held, strict=True))
        use = np.repeat(~held_out(ids), sizes)
        names, at = np.unique(h, return_inverse=True)
        found = []
        for k in ("words", "pairs"):
            g, i = (names, at) if k == "words" else np.unique(_pair(before, h), return_inverse=True)
            n = np.bincount(i, use, len(g)).astype(np.int64)
            cut = np.searchsorted(g, edges)
            found.append([_packed(z, a, b) for a, b in zip(np.split(g, cut), np.split(n, cut), strict=True)])
        yield _rows(np.arange(buckets), piece, *found)
        documents = np.concatenate([ids.astype(np.int64), sizes.astype(np.int64)])
        yield _rows([-1 - piece], piece, [_planes(z, np.diff(names, prepend=np.uint64(0)))], [_planes(z, documents)], [_planes(z, at.astype(np.uint32))])

    def run(batches):
        digests = Digests(folded=True)
        held, size, piece = [], 0, TaskContext.get().partitionId() << 32
        for batch in batches:
            for p in pieces(batch, "doc_id", "text"):
                h, before, offs = _tokens(p, digests)
                held.append((p.ids, np.diff(offs), h, before))
                size += len(h)
                if size >= FLUSH_TOKENS:
                    yield from rows(piece, held)
                    held, size, piece = [], 0, piece + 1
        if size:
            yield from rows(piece, held)

    return run


def _training(parts: list[tuple[np.ndarray, np.ndarray]]) -> tuple[np.ndarray, np.ndarray]:
    h, n = _merged(parts)
    return h[n > 0], n[n > 0]


def _combine(t: pa.Table) -> pa.Table:
    z = zstandard.ZstdCompressor(level=1)
    packed = [_packed(z, *_training([_unpacked(x) for x in t[c].to_pylist()])) for c in ("words", "pairs")]
    return pa.table({"bucket": pa.array(t["bucket"].to_numpy()[:1]), "words": pa.array(packed[:1], pa.binary()), "pairs": pa.array(packed[1:], pa.binary())})


def _histogram(n: np.ndarray) -> bytes:
    """By level: n-grams and their tokens. There are few levels, whatever the corpus."""
    level = np.searchsorted(LEVELS, n, "right")
    return np.concatenate([np.bincount(level, None, len(LEVELS) + 1), np.bincount(level, n, len(LEVELS) + 1).astype(np.int64)]).tobytes()


def _answer(t: pa.Table) -> pa.Table:
    """Of a bucket: its histograms in piece -1, and for each piece its words' exact counts and the levels its words and
    pairs have in the filter, in the order of the hashes. A piece's own row stays as it is."""
    bucket = t["bucket"][0].as_py()
    if bucket < 0:
        return t
    z = zstandard.ZstdCompressor(level=1)
    asked = [[_unpacked(x) for x in t[c].to_pylist()] for c in ("words", "pairs")]
    (w, nw), (p, np_) = (_training(x) for x in asked)
    filled = Segment((w, nw), (p, np_))
    exact, words, pairs = [], [], []
    for (a, _), (b, _) in zip(*asked, strict=True):
        at = np.minimum(np.searchsorted(w, a), max(len(w) - 1, 0))
        exact.append(_planes(z, np.where(w[at] == a, nw[at], 0).astype(np.int64) if len(w) else np.zeros(len(a), np.int64)))
        words.append(z.compress(filled.levels(a).astype(np.uint8).tobytes()))
        pairs.append(z.compress(filled.levels(b).astype(np.uint8).tobytes()))
    answers = _rows(np.full(len(t), bucket), t["piece"].to_numpy(), words, pairs, exact)
    return pa.Table.from_batches([_rows([bucket], -1, [_histogram(nw)], [_histogram(np_)]), answers])


def _edges(buckets: int) -> np.ndarray:
    """The first hash of every bucket but the first; a hash's bucket is its upper half times the buckets, shifted."""
    return np.array([-(-(i << 32) // buckets) << 32 for i in range(1, buckets)], np.uint64)


def _mixed(h: np.ndarray, level: int) -> np.ndarray:
    return mix64(h ^ np.uint64(level * 0xD1B54A32D192ED03 & (1 << 64) - 1))


def _place(a: np.ndarray, i: int, size: int) -> np.ndarray:
    """The i-th bit of an n-gram at a level, within its bucket's segment of `size` bits (below 2^32)."""
    at = ((a & np.uint64(0xFFFFFFFF)) + np.uint64(i) * ((a >> np.uint64(32)) | np.uint64(1))) & np.uint64(0xFFFFFFFF)
    return (at * np.uint64(size)) >> np.uint64(32)


class Segment:
    """A bucket's part of the filter."""

    def __init__(self, *counted: tuple[np.ndarray, np.ndarray]):
        levels = [np.searchsorted(LEVELS, n, "right") for _, n in counted]
        self.size = -(-int(sum(x.sum() for x in levels)) * BITS_EACH // 64) * 64 + 64
        on = np.zeros(self.size, bool)
        for (h, _), level in zip(counted, levels, strict=True):
            for j in range(1, int(level.max(initial=0)) + 1):
                h, level = h[level >= j], level[level >= j]
                a = _mixed(h, j)
                for i in range(PROBES):
                    on[_place(a, i, self.size)] = True
        self.bits = np.packbits(on, bitorder="little")

    def levels(self, h: np.ndarray, low: int = 1) -> np.ndarray:
        """The levels of distinct n-grams, 0 where not even the lowest one is set."""
        got = np.zeros(len(h), np.int64)
        live, j = np.arange(len(h)), low
        while len(live) and j <= len(LEVELS):
            a = _mixed(h[live], j)
            for i in range(PROBES):  # most absences show at the first probe
                at = _place(a, i, self.size)
                hit = (self.bits[at >> np.uint64(3)] >> (at & np.uint64(7)).astype(np.uint8)) & 1 == 1
                live, a = live[hit], a[hit]
            got[live] = j
            j += 1
        return got


STEPS = np.append(0, LEVELS)  # the count that a level stands for


class Model:
    """The few numbers beside the filter, sent to the workers, and, if made by `train`, the filter's segments."""

    lows = (1, 1)

    def __init__(self, words: dict[int, tuple[int, int]], pairs: dict[int, tuple[int, int]], segments: list[Segment] | None = None):
        self.segments = segments
        self.tokens, self.types = sum(t for _, t in words.values()), sum(n for n, _ in words.values())
        n1, n2, tokens = pairs.get(1, (0, 0))[0], pairs.get(2, (0, 0))[0], self.tokens
        self.discount = n1 / (n1 + 2 * n2) if n1 else 0.5
        self.unseen = min(0.5, max(words.get(1, (0, 0))[0] / tokens, 1 / (tokens + 1))) if tokens else 1.0
        self.backoff = min(1.0, max(self.discount * sum(n for n, _ in pairs.values()) / tokens, 1e-3)) if tokens else 1.0

    def counts(self, h: np.ndarray, low: int) -> np.ndarray:
        """Quantised counts of distinct n-grams, from the segments of `train`."""
        got, bucket = np.zeros(len(h), np.int64), ((h >> np.uint64(32)) * np.uint64(len(self.segments))) >> np.uint64(32)
        for b in np.unique(bucket):
            got[bucket == b] = STEPS[self.segments[int(b)].levels(h[bucket == b], low)]
        return got

    def log_probabilities(self, one: np.ndarray, two: np.ndarray, context: np.ndarray) -> np.ndarray:
        """log10 P of tokens after those before them, by the quantised counts of token, pair and token before."""
        if not self.tokens:
            return np.zeros(len(one))
        two = np.minimum(two, one)
        single = np.where(one > 0, (1 - self.unseen) * one / self.tokens, self.unseen)
        p = np.where(context > 0, np.maximum(two - self.discount, 0) / np.maximum(context, np.maximum(two, 1)) + self.backoff * single, single)
        return np.log10(np.minimum(p, 1.0))


def gather(docs: DataFrame) -> tuple[DataFrame, int]:
    """The n-grams of pieces by bucket, not staged, and the number of buckets."""
    size = docs.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    buckets = max(int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions")), size // 6 // BUCKET_TOKENS)
    return docs.mapInArrow(_gather(buckets), NGRAMS), buckets


def count_ngrams(docs: DataFrame) -> tuple[DataFrame, int]:
    """The staged counts of training n-grams, a row per bucket, and the number of buckets."""
    rows, buckets = gather(docs)
    return stage(rows.where("bucket >= 0").groupBy("bucket").applyInArrow(_combine, "bucket long, words binary, pairs binary")), buckets


def train(counted: DataFrame, buckets: int) -> Model:
    """The model with all its segments in one place, for a corpus of a few buckets; scoring leaves them apart."""
    segments, sums = [Segment() for _ in range(buckets)], np.zeros((2, 2, len(LEVELS) + 1), np.int64)
    for r in counted.toLocalIterator():
        both = [_unpacked(r[c]) for c in ("words", "pairs")]
        segments[r["bucket"]] = Segment(*both)
        sums += np.array([np.frombuffer(_histogram(n), np.int64).reshape(2, -1) for _, n in both])
    return Model(*({k: (int(n), int(t)) for k, (n, t) in enumerate(x.T) if n} for x in sums), segments)


def _model(answers: DataFrame) -> Model:
    def run(batches):
        for batch in batches:
            for c in ("words", "pairs"):
                for x in batch[c].to_pylist():
                    types, tokens = np.frombuffer(x, np.int64).reshape(2, -1)
                    yield pa.RecordBatch.from_arrays([pa.array([c] * len(types)), pa.array(np.arange(len(types))), pa.array(types), pa.array(tokens)], names=["name", "level", "types", "tokens"])

    got = answers.where("piece = -1").select("words", "pairs").mapInArrow(run, "name string, level long, types long, tokens long").where("types > 0").groupBy("name", "level").agg(F.sum("types").alias("types"), F.sum("tokens").alias("tokens")).collect()
    return Model(*({r["level"]: (r["types"], r["tokens"]) for r in got if r["name"] == c} for c in ("words", "pairs")))


def _score(model: Model):
    """Of a piece's own row and the answers to it: a row per document."""

    def run(t: pa.Table) -> pa.Table:
        z = zstandard.ZstdDecompressor()
        t = t.sort_by("bucket")  # the piece's own row is first
        own = lambda c, kind: _whole(z.decompress(t[c][0].as_py()), kind)
        joined = lambda c, kind: np.concatenate([_whole(z.decompress(x), kind) for x in t[c][1:].to_pylist()])
        names, at = np.cumsum(own("words", np.uint64), dtype=np.uint64), own("tokens", np.uint32)
        ids, sizes = own("pairs", np.int64).reshape(2, -1)
        first = np.cumsum(sizes) - sizes
        exact, words = joined("tokens", np.int64), STEPS[joined("words", np.uint8)]
        end = np.searchsorted(names, BOUNDARY)  # every document has one
        before = np.empty_like(at)
        before[1:] = at[:-1]
        before[first] = end
        _, pair = np.unique(_pair(names[before], names[at]), return_inverse=True)
        two = STEPS[joined("pairs", np.uint8)][pair]
        c = exact[at]
        sums = [np.add.reduceat(x, first) for x in ((c > 0).astype(np.int64), np.log10(c + 1.0), model.log_probabilities(words[at], two, words[before]))]
        base = sums[1] - sizes * log10(model.tokens + model.types + 1)
        cols = (ids, held_out(ids), sizes, sums[0], np.full(len(ids), model.tokens), base, sums[2])
        return pa.table([pa.array(x) for x in cols], names=["doc_id", "held_out", "n_tokens", "n_known", "train_tokens", "base_score", "score"])

    return run


def language_scores(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per document: doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score.

    Tokens are lower-cased words and one end; a null or empty text is the end alone. Documents whose crc32(id) mod 7 is 2
    are held out, the others teach. base_score adds one to exact counts. With nothing to learn from, scores are those of
    an empty model (0). Long texts are read whole. Rows without an id are left out; of rows that share an id,
    `one_row_per_id` names one for all. Other columns are ignored."""
    docs = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.coalesce(F.col(text_col), F.lit("")).alias("text")).where("doc_id is not null")
    all_, docs = docs, one_row_per_id(docs)
    rows, _ = gather(docs)
    answers = stage(rows.groupBy("bucket").applyInArrow(_answer, NGRAMS))
    model = _model(answers)
    schema = "doc_id long, held_out boolean, n_tokens long, n_known long, train_tokens long, base_score double, score double"
    return for_each_row(all_, docs, answers.where("piece >= 0").groupBy("piece").applyInArrow(_score(model), schema))


def op7_lm_scoring(spark: SparkSession, sf_dir: str) -> DataFrame:
    return language_scores(table(spark, sf_dir, "documents"))
