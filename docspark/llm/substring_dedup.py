"""Substring deduplication over windows of words, by super-k-mer partitioning.

A window's minimiser is the least hash among its grams of four words. Consecutive windows that share it form a
super-k-mer and travel as one packed string to the minimiser's bucket, about three times the text in all instead of
fifty. Equal windows have equal minimisers, so each bucket is sorted and counted on its own, and it is exact. Words are
compared as bytes within a piece or block, and buckets of one document, most of them, are passed over.

Map tasks first deduplicate what they read: of equal windows in a piece only those of the smallest document go on, so a
passage in a third of all documents sends a row per piece and not per document.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from docspark.llm.bytewise import Piece, fingerprints, pieces, runs, seeded, sliding_min
from docspark.llm.sieve import sieve, thin
from docspark.llm.spans import CUT_SCHEMA, SPANS, blocks, cover, super_kmers, told
from docspark.llm.staging import for_each_row, one_row_per_id, stage, table

WINDOW, GRAM = 50, 4
BLOCK_BYTES = 4 << 20  # of super-k-mers, counted at once
CUT_BYTES = 2 << 20  # of documents


def _windows(p: Piece, window: int) -> tuple:
    """Bounds of words, where documents' words begin, the words told apart, and where all windows start with their document."""
    begin, close, first = p.words()
    room = np.maximum(np.diff(first) - window + 1, 0)
    at = np.repeat(first[:-1] - np.concatenate([[0], np.cumsum(room)[:-1]]), room) + np.arange(room.sum())
    return begin, close, first, p.different(begin, close), at, np.repeat(np.arange(len(p)), room)


def _late(words: pa.DictionaryArray, at: np.ndarray, ids: np.ndarray, window: int) -> np.ndarray:
    """Windows whose words, by 128 bits of their numbers, also start in a smaller id."""
    late = np.zeros(len(at), bool)
    if not len(at):
        return late
    which, n = words.indices.to_numpy(), len(words.dictionary)
    key = runs(seeded(0, n)[which], window, 0)[at]
    order = np.argsort(key)
    twin = key[order][1:] == key[order][:-1]
    some = order[np.append(twin, False) | np.append(False, twin)]  # others have no equal
    if not len(some):
        return late
    second = runs(seeded(1 << 30, n)[which], window, 1)[at[some]]
    key, ids = key[some], ids[some]
    order = np.lexsort((ids, second, key))
    same = np.zeros(len(key), bool)
    same[1:] = (key[order][1:] == key[order][:-1]) & (second[order][1:] == second[order][:-1])
    late[some[order]] = ids[order] > ids[order][np.maximum.accumulate(np.where(same, 0, np.arange(len(key))))]
    return late


def cut(window: int, gram: int):
    """Super-k-mers of each piece, and at once the intervals that the piece itself shows to be repeated."""

    def run(batches):
        for batch in batches:
            for p in pieces(batch, "doc_id", "text", CUT_BYTES):
                begin, close, first, words, at, doc = _windows(p, window)
                late = _late(words, at, p.ids[doc], window)
                yield from told(p.ids, *cover(doc[late], at[late], first, window))
                at, doc = at[~late], doc[~late]
                if len(at):
                    h = fingerprints(words.dictionary)[words.indices.to_numpy()]
                    least = sliding_min(runs(h, gram, 3), window - gram + 1)[at]
                    yield super_kmers(p, least, at, doc, first, begin, close, window)

    return run


def _shared(minimisers: np.ndarray, ids: np.ndarray) -> np.ndarray:
    """Rows, sorted by minimiser, whose bucket has several documents, or may have as it is the last: in others no window
    starts in a smaller id."""
    heads = np.flatnonzero(np.append(True, minimisers[1:] != minimisers[:-1]))
    several = np.minimum.reduceat(ids, heads) < np.maximum.reduceat(ids, heads)
    several[-1] = True
    return np.repeat(several, np.diff(np.append(heads, len(ids))))


def _count(window: int):
    def run(batches):
        def settle(t: pa.Table):
            found, alive = [], np.zeros(len(t), bool)
            rows = np.flatnonzero(_shared(t["minimiser"].to_numpy(), t["doc_id"].to_numpy()))
            t = t.take(pa.array(rows))
            ids, start = t["doc_id"].to_numpy(), t["first"].to_numpy()
            for p in pieces(pa.record_batch([pa.array(ids), t["packed"].combine_chunks()], names=["doc_id", "text"]), "doc_id", "text", 1 << 62, len(t)):
                _, _, first, words, at, row = _windows(p, window)
                late = _late(words, at, ids[row], window)
                alive[rows[row[~late]]] = True
                r, a, b = cover(row[late], at[late], first, window)
                found.append(pa.RecordBatch.from_arrays([pa.array(ids[r]), pa.array(start[r] + a), pa.array(start[r] + b)], names=["doc_id", "first", "last"]))
            return found, alive

        yield from blocks(batches, BLOCK_BYTES, settle)

    return run


def count(cut_rows: DataFrame, window: int) -> DataFrame:
    """(doc_id, first, last): the repeated intervals that the buckets of `cut_rows` show."""
    return cut_rows.repartition("minimiser").sortWithinPartitions("minimiser").mapInArrow(_count(window), SPANS)


def _remove(batches):
    """Per document with covered intervals: word counts and the digest of the words kept."""
    for batch in batches:
        out = {"doc_id": [], "n_removed": [], "kept_sha256": [], "kept_text": []}
        for i, text, spans in zip(batch["doc_id"].to_pylist(), batch["text"].cast(pa.large_binary()).to_pylist(), batch["spans"].to_pylist(), strict=True):
            w = (text or b"").split()
            keep = np.ones(len(w), bool)
            for s in spans:
                keep[s["first"] : s["last"]] = False
            rest = b" ".join(x for x, k in zip(w, keep, strict=True) if k)
            out["doc_id"].append(i)
            out["n_removed"].append(int((~keep).sum()))
            out["kept_sha256"].append(hashlib.sha256(rest).hexdigest())
            out["kept_text"].append(rest.decode("utf-8", "replace"))
        yield pa.RecordBatch.from_pydict(out, schema=pa.schema([("doc_id", pa.int64()), ("n_removed", pa.int64()), ("kept_sha256", pa.string()), ("kept_text", pa.string())]))


def _whole(batches):
    for batch in batches:
        words = [(x or b"").split() for x in batch["text"].cast(pa.large_binary()).to_pylist()]
        yield pa.RecordBatch.from_arrays(
            [batch["doc_id"], pa.array([len(w) for w in words], pa.int64()), pa.array([hashlib.sha256(b" ".join(w)).hexdigest() for w in words])], names=["doc_id", "n_words", "sha"]
        )


def _rows(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    return docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text")).where("doc_id is not null")


def repeated_spans(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", window: int = WINDOW) -> DataFrame:
    """(doc_id, first, last): intervals of words covered by a window that also starts in a document with a smaller id.
    Intervals may overlap. Rows without an id are left out; of rows that share an id, `one_row_per_id` names one."""
    docs = one_row_per_id(_rows(docs, id_col, text_col))
    return count(docs.mapInArrow(cut(window, min(GRAM, window)), CUT_SCHEMA), window)


def _removed(docs: DataFrame, window: int) -> DataFrame:
    spans = stage(count(docs.mapInArrow(cut(window, min(GRAM, window)), CUT_SCHEMA), window))
    hit = thin(docs, sieve(spans.select("doc_id")), "doc_id")
    per_doc = spans.groupBy("doc_id").agg(F.collect_list(F.struct("first", "last")).alias("spans"))
    return hit.join(per_doc, "doc_id").mapInArrow(_remove, "doc_id long, n_removed long, kept_sha256 string, kept_text string")


def substring_digest(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", window: int = WINDOW) -> DataFrame:
    """Per document: doc_id, n_words, n_removed, kept_sha256 of the kept words joined by one space.

    Words are compared unchanged. A null, empty or short text (fewer words than `window`) loses nothing, nor does the
    smallest id of each repeated window. Very long texts are never cut. Rows without an id are left out; of rows that
    share an id, `one_row_per_id` names one for all. Other columns are ignored."""
    rows = _rows(docs, id_col, text_col)
    docs = one_row_per_id(rows)
    gone = _removed(docs, window).drop("kept_text")
    full = docs.mapInArrow(_whole, "doc_id long, n_words long, sha string")
    found = full.join(gone, "doc_id", "left").select("doc_id", "n_words", F.coalesce("n_removed", F.lit(0)).alias("n_removed"), F.coalesce("kept_sha256", "sha").alias("kept_sha256"))
    return for_each_row(rows, docs, found)


def remove_repeated(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", window: int = WINDOW) -> DataFrame:
    """(doc_id, text) of every document that loses words, with the words it keeps."""
    return _removed(one_row_per_id(_rows(docs, id_col, text_col)), window).select("doc_id", F.col("kept_text").alias("text"))


def op10_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return substring_digest(table(spark, sf_dir, "documents"))


OP10_SQL = r"""
WITH d AS (SELECT doc_id, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w FROM documents),
p AS (SELECT doc_id, w, unnest(range(1, len(w) - 48)) AS i FROM d WHERE len(w) >= 50),
x AS (SELECT doc_id, i, md5(array_to_string(w[i:i + 49], ' ')) AS h FROM p),
m AS (SELECT h, min(doc_id) AS lead FROM x GROUP BY h),
f AS (SELECT doc_id, i FROM x JOIN m USING (h) WHERE doc_id > lead),
c AS (SELECT DISTINCT doc_id, unnest(range(i, i + 50)) AS k FROM f),
g AS (SELECT doc_id, list(k) AS gone FROM c GROUP BY doc_id),
r AS (SELECT d.doc_id, w, coalesce(gone, []) AS gone FROM d LEFT JOIN g USING (doc_id)),
u AS (SELECT doc_id, w, unnest(range(1, len(w) + 1)) AS k FROM r),
t AS (SELECT u.doc_id, string_agg(u.w[u.k], ' ' ORDER BY u.k) AS kept FROM u ANTI JOIN c ON u.doc_id = c.doc_id AND u.k = c.k GROUP BY u.doc_id)
SELECT r.doc_id, len(w) AS n_words, len(gone) AS n_removed, sha256(coalesce(kept, '')) AS kept_sha256 FROM r LEFT JOIN t USING (doc_id)
"""
