"""Words, digests and byte strings over Arrow string columns.

A batch is cut into pieces of a few MB so that a worker's arrays stay small whatever the batch size is; a document
is never cut. Words are maximal runs of bytes other than space and \\t \\n \\v \\f \\r; equality of words is equality
of 128-bit BLAKE2b digests.
"""

from __future__ import annotations

import ctypes
from collections.abc import Callable, Iterator
from hashlib import blake2b

import numpy as np
import pyarrow as pa

PIECE_BYTES = 2 << 20
SLICE_ROWS = 1024
KNOWN_BYTES = 8 << 20  # of words whose digests a task keeps
WHITE = np.zeros(256, bool)
WHITE[[0x20, 9, 10, 11, 12, 13]] = True

_BASE = 0x9E3779B97F4A7C15 | 1


def mix64(x: np.ndarray) -> np.ndarray:
    """The finaliser of splitmix64, a bijection of 64-bit values."""
    x = x.astype(np.uint64, copy=True)
    x ^= x >> np.uint64(30)
    x *= np.uint64(0xBF58476D1CE4E5B9)
    x ^= x >> np.uint64(27)
    x *= np.uint64(0x94D049BB133111EB)
    x ^= x >> np.uint64(31)
    return x


def seeded(seed: int, n: int) -> np.ndarray:
    """n pseudo-random 64-bit values, the same in every process."""
    return mix64((np.arange(1, n + 1, dtype=np.uint64) + np.uint64(seed << 20)) * np.uint64(_BASE))


STEP = np.uint64(0x9E3779B97F4A7C15)


def chained(parts: list[np.ndarray], seed: int) -> np.ndarray:
    """A fingerprint of equally long columns of 64-bit values, by row; mixing after every value keeps it non-linear."""
    got = np.full(len(parts[0]), seed, np.uint64)
    for x in parts:
        got = mix64(got * STEP + x)
    return got


def runs(h: np.ndarray, size: int, seed: int) -> np.ndarray:
    """Fingerprints of every run of `size` values, by doubling."""
    if len(h) < size:
        return np.zeros(0, np.uint64)
    x, span = mix64(h + np.uint64(seed)), 1
    while span < size:
        off = min(span, size - span)
        x = mix64(x[:-off] * STEP + x[off:])
        span += off
    return x


def sliding_min(x: np.ndarray, size: int) -> np.ndarray:
    span = 1
    while span * 2 <= size:
        x = np.minimum(x[:-span], x[span:])
        span *= 2
    return np.minimum(x[: len(x) - (size - span)], x[size - span :]) if size > span else x


def joined(words: np.ndarray, at: np.ndarray) -> pa.LargeBinaryArray:
    """Byte strings that follow each other in `words`, each beginning where `at` says and ending where the next does."""
    return pa.Array.from_buffers(pa.large_binary(), len(at) - 1, [None, pa.py_buffer(at.astype(np.int64)), pa.py_buffer(np.ascontiguousarray(words))])


def parts(words: pa.LargeBinaryArray) -> tuple[np.ndarray, np.ndarray]:
    """The bytes of an array, and where each of its strings begins (one more at the end)."""
    at = np.frombuffer(words.buffers()[1], np.int64)[words.offset : words.offset + len(words) + 1]
    return np.frombuffer(words.buffers()[2] or b"", np.uint8)[at[0] : at[-1]], at - at[0]


_BACK = pow(_BASE, -1, 1 << 64)


def fingerprints(words: pa.LargeBinaryArray) -> np.ndarray:
    """64 bits of each byte string, the same in every process: a polynomial of its bytes, mixed. Equal strings have equal
    ones; others nearly always differ, so they deal strings out but don't prove them equal."""
    value, out, low = seeded(11, 256), [], 0
    buf, at = parts(words)
    while low < len(words):
        to = max(low + 1, int(np.searchsorted(at, at[low] + (1 << 20), "right")) - 1)
        own, ends = buf[at[low] : at[to]], at[low : to + 1] - at[low]
        n = len(own) + 1
        sums, power = np.zeros(n, np.uint64), np.full(n, _BASE, np.uint64)
        power[0] = 1
        np.cumsum(value[own] * np.cumprod(power)[:-1], out=sums[1:])
        power[1:] = _BACK
        out.append(mix64(np.diff(sums[ends]) * np.cumprod(power)[ends[:-1]] + np.diff(ends).astype(np.uint64) * STEP))
        low = to
    return np.concatenate(out) if out else np.zeros(0, np.uint64)


class Digests:
    """Digests of the words of pieces, as two columns of 64 bits. Those seen are kept in bounded memory for as long as
    the object lives, which is a task."""

    def __init__(self, folded: bool = False):
        self.folded, self.known, self.size = folded, {}, 0

    def _miss(self, word: bytes) -> bytes:
        got = blake2b(word, digest_size=16).digest()
        if len(word) <= 64:
            self.size += len(word) + 160
            if self.size > KNOWN_BYTES:
                self.known.clear()
                self.size = len(word) + 160
            self.known[word] = got
        return got

    def of(self, p: Piece) -> tuple[np.ndarray, np.ndarray]:
        """Digests of all words in order, shape (words, 2), and where each document's begin (one more at the end)."""
        data, joined, first = p.buf.tobytes(), [], [0]
        if self.folded:
            data = data.lower()  # A-Z alone, as these are bytes
        for a, b in zip(p.offs[:-1].tolist(), p.offs[1:].tolist(), strict=True):
            words = data[a:b].split()
            get, miss = self.known.get, self._miss
            joined.append(b"".join([get(w) or miss(w) for w in words]))
            first.append(first[-1] + len(words))
        return np.frombuffer(b"".join(joined), np.uint64).reshape(-1, 2), np.array(first, np.int64)


class Piece:
    """Some documents of a batch: `ids`, their bytes joined in `buf`, and `offs`, where each begins (one more at the end)."""

    def __init__(self, ids: np.ndarray, buf: np.ndarray, offs: np.ndarray, first: int):
        self.ids, self.buf, self.offs, self.first = ids, buf, offs, first

    def __len__(self) -> int:
        return len(self.offs) - 1

    def words(self) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Starts and ends of all words, and for each document where its words begin (one more at the end)."""
        n = len(self.buf)
        inside = np.zeros(n + 2, bool)
        inside[1:-1] = ~WHITE[self.buf]
        cut = np.zeros(n + 1, bool)
        cut[self.offs] = True
        edge = (inside[1:] != inside[:-1]) | cut
        begin = np.flatnonzero(edge & inside[1:])
        close = np.flatnonzero(edge & inside[:-1])
        return begin, close, np.searchsorted(begin, self.offs)

    def different(self, begin: np.ndarray, close: np.ndarray) -> pa.DictionaryArray:
        """All words in order, given their bounds: the different ones, and which of them each word is."""
        return joined(self.buf[~WHITE[self.buf]], np.concatenate([[0], np.cumsum(close - begin)])).dictionary_encode()

    def doc_of(self, at: np.ndarray) -> np.ndarray:
        return np.searchsorted(self.offs, at, "right") - 1


def release() -> None:
    """Give freed memory back to the system: workers stay alive between tasks and would keep their largest size."""
    pa.default_memory_pool().release_unused()
    if _trim is not None:
        _trim(0)


_kept: dict[str, object] = {}


def kept(owner: str, make: Callable[[], object]) -> object:
    """What `make` gives, kept by a worker from task to task for one owner at a time: another one's work lets it go."""
    if owner not in _kept:
        forget()
        _kept[owner] = make()
    return _kept[owner]


def forget() -> None:
    if _kept:
        _kept.clear()
        release()


try:
    _trim = ctypes.CDLL(None).malloc_trim
except (AttributeError, OSError):  # another C library
    _trim = None


def stretches(batch: pa.RecordBatch, id_col: str, text_col: str, limit: int = PIECE_BYTES, rows: int = SLICE_ROWS) -> Iterator[tuple[pa.Array, pa.LargeBinaryArray]]:
    """Ids and texts of a batch, at most `limit` bytes and `rows` rows at a time but never less than one; null texts are empty."""
    ids = batch.column(id_col)
    for low in range(0, len(batch), rows):
        texts = batch.column(text_col).slice(low, rows)
        texts = (texts.fill_null("") if texts.null_count else texts).cast(pa.large_binary())
        n, at = len(texts), 0
        offs = np.frombuffer(texts.buffers()[1], np.int64)[texts.offset : texts.offset + n + 1]
        while at < n:
            to = max(at + 1, int(np.searchsorted(offs, offs[at] + limit, "right")) - 1)
            yield ids.slice(low + at, to - at), texts.slice(at, to - at)
            at = to


def pieces(batch: pa.RecordBatch, id_col: str, text_col: str, limit: int = PIECE_BYTES, rows: int = SLICE_ROWS) -> Iterator[Piece]:
    """Documents of a batch, at most `limit` bytes and `rows` rows at a time but never less than one; null texts are empty."""
    forget()
    ids = batch.column(id_col)
    for low in range(0, len(batch), rows):
        texts = batch.column(text_col).slice(low, rows)
        texts = (texts.fill_null("") if texts.null_count else texts).cast(pa.large_binary())
        n = len(texts)
        offs = np.frombuffer(texts.buffers()[1], np.int64)[texts.offset : texts.offset + n + 1]
        data = texts.buffers()[2]
        buf = np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8)
        own = np.asarray(ids.slice(low, rows).to_numpy(zero_copy_only=False))
        at = 0
        while at < n:
            to = max(at + 1, int(np.searchsorted(offs, offs[at] + limit, "right")) - 1)
            yield Piece(own[at:to], buf[offs[at] : offs[to]], offs[at : to + 1] - offs[at], low + at)
            at = to
        release()
