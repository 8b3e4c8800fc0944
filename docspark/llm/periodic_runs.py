"""Runs: stretches of words that repeat with a period at least four times, found by internal pattern matching.

The words of a document are ranked by prefix doubling, which names every block of 2^k words and ends in a suffix array. In
it, the occurrences of a block are a range; a wavelet tree over the array answers which of a range's positions comes next
after a given one. A run of period q holds, with B the power of two in (q/2, q], one of the aligned blocks of B words among
its first B places, and that block occurs again q words on. So each aligned block asks for its occurrences that begin
between B and 2B words on. One or two are candidate periods. More of them form an arithmetic progression whose difference
p is the block's own period; then the stretch with period p that holds the block, and the one that holds the progression,
end q words apart in any run of period q, which leaves one candidate. Names of blocks tell how far a candidate extends.

Documents are taken together in pieces and never cut, and words of different documents never get the same rank. Beside a
piece of PIECE_WORDS words, memory follows the longest document, at about 200 bytes a word.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from zlib import crc32

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from docspark.llm.bytewise import forget, release
from docspark.llm.staging import table

PIECE_WORDS = 150_000
LEAST_LENGTH, TIMES = 6, 4
SLICE_ROWS = 256

Rewrite = Callable[[int | None, list[bytes]], list[bytes]]


class WaveletTree:
    """Numbers by their bits from the highest on, each level as packed bits with counts of ones before each 64."""

    def __init__(self, values: np.ndarray):
        self.bits, self.levels = max(1, int(values.max(initial=0)).bit_length()), []
        for bit in range(self.bits - 1, -1, -1):
            one = (values >> bit & 1).astype(bool)
            packed = np.packbits(one, bitorder="little")
            words = np.zeros(len(values) // 64 + 1, np.uint64)
            words.view(np.uint8)[: len(packed)] = packed
            before = np.append(0, np.cumsum(np.bitwise_count(words), dtype=np.int64)[:-1])
            self.levels.append((words, before, len(values) - int(one.sum())))
            values = np.concatenate([values[~one], values[one]])

    @staticmethod
    def _ones(level: tuple[np.ndarray, np.ndarray, int], at: np.ndarray) -> np.ndarray:
        words, before, _ = level
        k = at >> 6
        return before[k] + np.bitwise_count(words[k] & ((np.uint64(1) << (at & 63).astype(np.uint64)) - np.uint64(1)))

    def below(self, low: np.ndarray, high: np.ndarray, value: np.ndarray) -> np.ndarray:
        """How many values in each range low .. high are below `value`."""
        count = np.where(value >= 1 << self.bits, high - low, 0)
        asked = np.flatnonzero(value < 1 << self.bits)
        low, high, value = low[asked], high[asked], value[asked]
        less = np.zeros(len(asked), np.int64)
        for level, bit in zip(self.levels, range(self.bits - 1, -1, -1), strict=True):
            ones_low, ones_high, up = self._ones(level, low), self._ones(level, high), (value >> bit & 1).astype(bool)
            less += np.where(up, (high - ones_high) - (low - ones_low), 0)
            low, high = np.where(up, level[2] + ones_low, low - ones_low), np.where(up, level[2] + ones_high, high - ones_high)
        count[asked] = less
        return count

    def smallest(self, low: np.ndarray, high: np.ndarray, k: np.ndarray) -> np.ndarray:
        """The value that `k` others in each range low .. high come before; with k = below(..., v) the successor of v - 1."""
        value = np.zeros(len(low), np.int64)
        for level, bit in zip(self.levels, range(self.bits - 1, -1, -1), strict=True):
            ones_low, ones_high = self._ones(level, low), self._ones(level, high)
            zeros = (high - ones_high) - (low - ones_low)
            up = k >= zeros
            value |= up.astype(np.int64) << bit
            k = np.where(up, k - zeros, k)
            low, high = np.where(up, level[2] + ones_low, low - ones_low), np.where(up, level[2] + ones_high, high - ones_high)
        return value


class Names:
    """Documents' suffixes in order, and for each k the names of blocks of 2^k words: equal for equal blocks of a document,
    and the place in the suffix array where their range begins."""

    def __init__(self, words: np.ndarray, first: np.ndarray):
        self.first, n = first, len(words)
        self.start = np.repeat(first[:-1], np.diff(first))
        self.end = np.repeat(first[1:], np.diff(first))
        key = self.start * (int(words.max(initial=0)) + 1) + words
        self.order = np.argsort(key, kind="stable")
        self.of: list[np.ndarray] = []
        rank, slots = self._ranks(np.zeros(n, np.int32), key[self.order], np.arange(n))
        self.of.append(rank)
        span = 1
        while len(slots):
            at = self.order[slots]
            after = np.where(at + span < self.end[at], self.of[-1][np.minimum(at + span, n - 1)], -1)
            key = self.of[-1][at].astype(np.int64) * (n + 1) + after + 1
            by = np.argsort(key, kind="stable")
            self.order[slots] = at[by]
            rank, slots = self._ranks(self.of[-1].copy(), key[by], slots)
            self.of.append(rank)
            span *= 2

    def _ranks(self, rank: np.ndarray, key: np.ndarray, slots: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """New ranks for the sorted keys at `slots` of the order, and the slots whose keys aren't alone."""
        if not len(slots):
            return rank, slots
        new = np.append(True, key[1:] != key[:-1])
        rank[self.order[slots]] = slots[np.maximum.accumulate(np.where(new, np.arange(len(new)), 0))]
        return rank, slots[~(new & np.append(new[1:], True))]

    def ahead(self, i: np.ndarray, j: np.ndarray) -> np.ndarray:
        """How many words from i and from j > i on are equal, in one document."""
        same, last = np.zeros(len(i), np.int64), len(self.start) - 1
        for k in range(len(self.of) - 1, -1, -1):
            a, b = i + same, j + same
            same += ((b <= last) & (self.of[k][np.minimum(a, last)] == self.of[k][np.minimum(b, last)])).astype(np.int64) << k
        return same

    def behind(self, i: np.ndarray, j: np.ndarray) -> np.ndarray:
        """How many words before i and before j > i are equal, in one document."""
        same = np.zeros(len(i), np.int64)
        for k in range(len(self.of) - 1, -1, -1):
            a, b = i - same - (1 << k), j - same - (1 << k)
            same += ((a >= self.start[i]) & (self.of[k][np.maximum(a, 0)] == self.of[k][np.maximum(b, 0)])).astype(np.int64) << k
        return same


def candidate_periods(names: Names, tree: WaveletTree, k: int) -> tuple[np.ndarray, np.ndarray]:
    """Aligned blocks of 2^k words, and distances at which they may begin a run of that period; of a run's blocks the first
    is among them."""
    size, name, n = 1 << k, names.of[k], len(names.start)
    at = np.flatnonzero((np.arange(n) - names.start & size - 1) == 0)
    at = at[at + 3 * size <= names.end[at]]
    low = name[at].astype(np.int64)
    high = low + np.bincount(name, minlength=n)[low]
    often = high - low >= TIMES - 1
    at, low, high = at[often], low[often], high[often]
    local = at - names.start[at]
    before = tree.below(low, high, local + size)
    found = tree.below(low, high, local + 2 * size) - before
    some = found > 0
    at, low, high, local, before, found = (x[some] for x in (at, low, high, local, before, found))
    one = tree.smallest(low, high, before) - local
    several = np.flatnonzero(found > 1)
    two = one.copy()
    two[several] = tree.smallest(low[several], high[several], before[several] + 1) - local[several]
    many = np.flatnonzero(found > 2)  # a progression: how far apart the stretches of its difference end
    i, j, p = at[many], at[many] + one[many], two[many] - one[many]
    one[many] = two[many] = (j + names.ahead(j, j + p)) - (i + names.ahead(i, i + p))
    pair = np.flatnonzero(found == 2)
    at, q = np.concatenate([at, at[pair]]), np.concatenate([one, two[pair]])
    fits = (q >= size) & (q < 2 * size) & (at + 2 * q + size <= names.end[at])
    at, q = at[fits], q[fits]
    again = (name[at] == name[at + q]) & (name[at] == name[at + 2 * q])
    back = at - size
    inside = (back >= names.start[at]) & (name[np.maximum(back, 0)] == name[np.maximum(back, 0) + q])  # not the run's first
    return at[again & ~inside], q[again & ~inside]


def find_runs(words: np.ndarray, first: np.ndarray, least: int = LEAST_LENGTH, times: int = TIMES) -> np.ndarray:
    """Runs of documents whose words, as numbers, begin at `first` (one more at the end): rows of (start, length, period),
    by start, counted from the first word of all, by start and period. `times` is 4 or more."""
    if times < TIMES:
        raise ValueError(f"blocks find runs of at least {TIMES} periods")
    longest = int(np.diff(first).max(initial=0))
    if longest < least:
        return np.zeros((0, 3), np.int64)
    names = Names(words, first)
    tree = WaveletTree(names.order - names.start[names.order])
    found = [np.zeros((0, 3), np.int64)]
    for k in range(len(names.of)):
        if times << k > longest:
            break
        at, q = candidate_periods(names, tree, k)
        start = at - names.behind(at, at + q)
        length = at + q + names.ahead(at, at + q) - start
        long_ = length >= np.maximum(least, times * q)
        found.append(np.stack([start, length, q], 1)[long_])
    found = np.concatenate(found)
    found = found[np.lexsort((found[:, 2], found[:, 1], found[:, 0]))]
    new = np.ones(len(found), bool)  # of one stretch the smallest period, which divides the others
    new[1:] = (found[1:, :2] != found[:-1, :2]).any(1)
    found = found[new]
    return found[np.lexsort((found[:, 2], found[:, 0]))]


def dropped(runs: np.ndarray, n: int) -> np.ndarray:
    """Which of n words a run holds after its first period."""
    edge = np.zeros(n + 1, np.int64)
    np.add.at(edge, runs[:, 0] + runs[:, 2], 1)
    np.add.at(edge, runs[:, 0] + runs[:, 1], -1)
    return np.cumsum(edge[:-1]) > 0


def _pieces(batches, rewrite: Rewrite | None) -> Iterator[tuple[list[int | None], list[list[bytes]]]]:
    """Ids and words of documents, about PIECE_WORDS words at a time."""
    ids, texts, size = [], [], 0
    for batch in batches:
        for at in range(0, len(batch), SLICE_ROWS):
            part = batch.slice(at, SLICE_ROWS)
            for i, text in zip(part["doc_id"].to_pylist(), part["text"].cast(pa.large_binary()), strict=True):
                words = (text.as_py() or b"").split()
                if size and size + len(words) > PIECE_WORDS:
                    yield ids, texts
                    ids, texts, size = [], [], 0
                ids.append(i)
                texts.append(rewrite(i, words) if rewrite else words)
                size += len(words)
    if ids:
        yield ids, texts


RUNS = "array<struct<start:long,length:long,period:long>>"


def collapse_runs(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", rewrite: Rewrite | None = None, least: int = LEAST_LENGTH, times: int = TIMES) -> DataFrame:
    """One row per row of `docs`: doc_id, n_words, runs (start, length, period, by start and period) and collapsed, the
    text without what runs hold after their first period, its words joined by one space.

    Words are `[^\\x20\\x09-\\x0D]+`. A null or empty text has no words, no runs and an empty collapsed text. Texts are
    read whole, repeated rows are rows of their own, an id may be null, and other columns are ignored. `rewrite`, if given,
    changes a document's words before they are read."""

    def run(batches):
        forget()
        for ids, texts in _pieces(batches, rewrite):
            known: dict[bytes, int] = {}
            first = np.append(0, np.cumsum([len(t) for t in texts])).astype(np.int64)
            words = np.fromiter((known.setdefault(w, len(known)) for t in texts for w in t), np.int64, int(first[-1]))
            found = find_runs(words, first, least, times)
            keep = ~dropped(found, len(words))
            whole = np.logical_and.reduceat(np.append(keep, True), first)[:-1] | (np.diff(first) == 0)
            kept = [b" ".join(t if all_ else [w for w, k in zip(t, keep[a:b].tolist(), strict=True) if k]) for t, all_, a, b in zip(texts, whole.tolist(), first[:-1].tolist(), first[1:].tolist(), strict=True)]
            doc = np.searchsorted(first, found[:, 0], "right") - 1
            offsets = np.searchsorted(doc, np.arange(len(texts) + 1)).astype(np.int32)
            fields = [pa.array(found[:, 0] - first[doc]), pa.array(found[:, 1]), pa.array(found[:, 2])]
            runs = pa.ListArray.from_arrays(pa.array(offsets), pa.StructArray.from_arrays(fields, names=["start", "length", "period"]))
            yield pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), pa.array(np.diff(first)), runs, pa.array(kept, pa.binary()).cast(pa.string())], names=["doc_id", "n_words", "runs", "collapsed"])
            del texts, known, kept
            release()

    return docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text")).mapInArrow(run, f"doc_id long, n_words long, runs {RUNS}, collapsed string")


def planted(doc_id: int | None, words: list[bytes]) -> list[bytes]:
    """The query's rule: of every tenth document, by the CRC-32 of its id, the words from some place on repeat."""
    if doc_id is None or not words:
        return words
    h, n = crc32(str(doc_id).encode()), len(words)
    g = h // 10
    if h % 10:
        return words
    a = g % n
    p = 1 + (n - a) // (3 + g % 8)
    return words[:a] + (words[a : a + p] * (-(-(n - a) // p)))[: n - a]


def op12_periodic_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    got = collapse_runs(table(spark, sf_dir, "documents"), rewrite=planted)
    line = lambda r: F.concat_ws(",", r["start"], r["length"], F.concat(r["period"], F.lit("\n")))
    best = F.array_max(F.transform("runs", lambda r: F.struct(r["length"].alias("length"), (-r["start"]).alias("start"), (-r["period"]).alias("period"))))
    got = got.withColumn("best", best)
    length, period = F.col("best.length"), -F.col("best.period")
    return got.select(
        "doc_id", F.size("runs").cast("long").alias("n_runs"), (-F.col("best.start")).alias("start"), length.alias("length"), period.alias("period"),
        F.floor(F.lit(1000) * length / period).alias("exponent_milli"), F.sha2(F.array_join(F.transform("runs", line), ""), 256).alias("runs_sha256"), F.sha2("collapsed", 256).alias("collapsed_sha256"),
    )
