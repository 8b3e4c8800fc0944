"""Super-k-mers, and the intervals that windows cover.

A super-k-mer is a run of consecutive windows with one minimiser; it travels to the minimiser's bucket as one packed
string. Rows without a string are intervals that were found on the way.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa

from docspark.llm.bytewise import Piece, mix64

CUT_SCHEMA = "minimiser long, doc_id long, first long, last long, packed binary"
SPANS = "doc_id long, first long, last long"
_NAMES = [x.split()[0] for x in CUT_SCHEMA.split(", ")]


def cover(docs: np.ndarray, at: np.ndarray, base: np.ndarray, window: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Intervals covered by windows `at` (ascending), per document, relative to `base`."""
    if not len(at):
        return docs, at, at
    new = np.ones(len(at), bool)
    new[1:] = (at[1:] > at[:-1] + window) | (docs[1:] != docs[:-1])
    heads = np.flatnonzero(new)
    tails = np.append(heads[1:], len(at)) - 1
    return docs[heads], at[heads] - base[docs[heads]], at[tails] + window - base[docs[heads]]


def told(ids: np.ndarray, docs: np.ndarray, first: np.ndarray, last: np.ndarray):
    """Intervals of documents as rows, spread over the buckets."""
    if len(docs):
        ids = ids[docs].astype(np.int64)
        yield pa.RecordBatch.from_arrays([pa.array(mix64(ids.view(np.uint64)).view(np.int64)), *map(pa.array, (ids, first, last)), pa.nulls(len(ids), pa.binary())], names=_NAMES)


def super_kmers(p: Piece, least: np.ndarray, at: np.ndarray, doc: np.ndarray, first: np.ndarray, begin: np.ndarray, close: np.ndarray, window: int) -> pa.RecordBatch:
    """Runs of windows `at` of documents `doc` with the minimisers `least`; units lie in begin .. close, those of a
    document from `first` on."""
    new = np.ones(len(at), bool)
    new[1:] = (least[1:] != least[:-1]) | (at[1:] != at[:-1] + 1) | (doc[1:] != doc[:-1])
    heads = np.flatnonzero(new)
    tails = at[np.append(heads[1:], len(at)) - 1] + window - 1
    data, base = p.buf.tobytes(), first[doc[heads]]
    packed = [data[x:y] for x, y in zip(begin[at[heads]].tolist(), close[tails].tolist(), strict=True)]
    numbers = (least[heads].view(np.int64), p.ids[doc[heads]], at[heads] - base, tails + 1 - base)
    return pa.RecordBatch.from_arrays([*map(pa.array, numbers), pa.array(packed, pa.binary())], names=_NAMES)


def blocks(batches, limit: int, settle):
    """Reads rows sorted by minimiser, settles `limit` bytes of them at a time and yields the results.

    `settle(rows)` gives intervals and says which rows hold a first occurrence. Of a bucket that goes on, just these stay
    for the next block, which is then as large again at least: memory follows a bucket's different windows, not its rows."""
    held, size, enough = [], 0, limit
    for batch in batches:
        known = batch.filter(batch["packed"].is_null())
        if len(known):
            yield known.select(["doc_id", "first", "last"])
        batch = batch.filter(batch["packed"].is_valid())
        if not len(batch):
            continue
        held.append(batch)
        size += batch.nbytes
        if size < enough:
            continue
        t = pa.Table.from_batches(held)
        found, first = settle(t)
        yield from found
        m = t["minimiser"].to_numpy()
        rest = t.filter(pa.array(first & (m == m[-1]))).combine_chunks()
        held, size, enough = rest.to_batches(), 0, max(limit, rest.nbytes)
    if held:
        yield from settle(pa.Table.from_batches(held))[0]
