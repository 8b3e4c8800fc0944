"""Removal of repeated byte strings by sorting suffixes, with difference-cover samples, block by block.

Every string of WINDOW bytes holds, at one of its first PERIOD offsets, a position of the difference cover that is
also one in any equal string, whatever the two alignments are. So suffixes at cover positions are ranked first, by their
next WINDOW - PERIOD + 1 bytes and one bucket at a time: a string can be repeated only if one of its samples shares its
rank with another.

The suffixes that are left, and only these, are sorted by content. A suffix's bucket is its minimiser, the least hashed
gram of its first WINDOW bytes, so equal strings meet and consecutive suffixes mostly travel as one packed string. In a
block of buckets suffixes are sorted by their first 21 bytes; longer ties are resolved by ranks of the block's own cover
samples, which are sorted before: two suffixes are compared by the ranks at the first offset where both have a sample.
Equal strings are then neighbours, and neighbours are compared byte by byte. Memory is bounded by the block.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from docspark.llm.bytewise import chained, pieces, release, sliding_min
from docspark.llm.sieve import sieve, thin
from docspark.llm.spans import CUT_SCHEMA, SPANS, blocks, cover, super_kmers, told
from docspark.llm.staging import for_each_row, one_row_per_id, stage, table

WINDOW = 100
PERIOD = 57
COVER = (0, 1, 3, 13, 32, 36, 43, 52)  # every difference modulo 57 occurs
TIES = 21  # bytes sorted before ranks decide
TIE_COVER = (0, 1, 4, 14, 16)  # every difference modulo 21 occurs
GRAM = 20
BUCKET_SAMPLES = 3_000_000  # ranked at once
BLOCK_BYTES = 256 << 10  # of packed strings sorted at once
CUT_BYTES = 512 << 10  # of documents
PIECE = 1 << 20


def _meeting() -> np.ndarray:
    """For two residues modulo TIES, the first offset at which both have a cover sample."""
    has = np.isin(np.arange(TIES), TIE_COVER)
    k = (np.arange(TIES)[:, None] + np.arange(TIES)) % TIES  # residue, offset
    return np.argmax(has[k][:, None, :] & has[k][None, :, :], axis=2)


MEETING = _meeting()


def _eights(buf: np.ndarray) -> np.ndarray:
    """The eight bytes from every place on; zeros follow the end."""
    return np.ndarray((len(buf) + WINDOW,), np.uint64, np.concatenate([buf, np.zeros(WINDOW + 8, np.uint8)]), strides=(1,))


def _steps(start: int, end: int) -> list[int]:
    """Offsets of eight bytes each that cover start .. end."""
    return [*range(start, end - 8, 8), max(end - 8, 0)]


def _cover(piece, depth: int) -> np.ndarray:
    is_in = np.zeros(PERIOD, bool)
    is_in[list(COVER)] = True
    size = np.diff(piece.offs)
    place = np.arange(len(piece.buf)) - np.repeat(piece.offs[:-1], size)
    return np.flatnonzero(is_in[place % PERIOD] & (place + depth <= np.repeat(size, size)))


class Order:
    """Suffixes `at` of a text in sorted order, refined step by step; `live` are the places still shared by a tie, `tie`
    the first place of each one's tie."""

    def __init__(self, eights: np.ndarray, at: np.ndarray):
        self.eights, self.at = eights, at
        self.order, self.live, self.tie = np.arange(len(at)), np.arange(len(at)), np.zeros(len(at), np.int64)

    def _split(self, key: np.ndarray) -> np.ndarray:
        """Sort each tie by `key` and split it; gives the keys in the new order."""
        o = np.argsort(key) if self.tie[0] == self.tie[-1] else np.lexsort((key, self.tie))
        self.order[self.live], key, g = self.order[self.live][o], key[o], self.tie[o]
        new = np.ones(len(key), bool)
        new[1:] = (g[1:] != g[:-1]) | (key[1:] != key[:-1])
        self.tie = self.live[np.maximum.accumulate(np.where(new, np.arange(len(key)), 0))]
        return key

    def _shared(self, keep: np.ndarray) -> None:
        self.live, self.tie = self.live[keep], self.tie[keep]
        alone = np.ones(len(self.tie), bool)
        alone[1:] &= self.tie[1:] != self.tie[:-1]
        alone[:-1] &= self.tie[1:] != self.tie[:-1]
        self.live, self.tie = self.live[~alone], self.tie[~alone]

    def by_bytes(self, offsets: list[int]) -> None:
        for k in offsets:
            if not len(self.live):
                return
            self._split(self.eights[self.at[self.order[self.live]] + k].byteswap())
            self.ranks[self.order[self.live]] = self.tie
            self._shared(np.ones(len(self.live), bool))

    @property
    def ranks(self) -> np.ndarray:
        """Of every suffix, the first place of its tie."""
        if not hasattr(self, "_ranks"):
            self._ranks = np.zeros(len(self.at), np.int64)
        return self._ranks

    def by_samples(self, rank: np.ndarray) -> None:
        """Ties are split around a pivot each, by the ranks where both have a sample, until no tie has an unequal pair."""
        while len(self.live):
            heads = np.flatnonzero(np.append(True, self.tie[1:] != self.tie[:-1]))
            sizes = np.diff(np.append(heads, len(self.tie)))
            x = self.at[self.order[self.live]]
            pivot = np.repeat(x[heads + sizes // 2], sizes)
            k = MEETING[x % TIES, pivot % TIES]
            side = self._split(np.sign(rank[x + k] - rank[pivot + k]))
            self._shared(side != 0)


def repeated(buf: np.ndarray, at: np.ndarray, window: int) -> np.ndarray:
    """Which of the strings of `window` bytes at the ascending places `at` also start at an earlier one of them."""
    late = np.zeros(len(at), bool)
    eights = _eights(buf)
    sorted_ = Order(eights, at)
    sorted_.by_bytes(_steps(0, min(TIES, window)))
    tied = sorted_.live.copy()
    if not len(tied):
        return late
    x = at[sorted_.order[tied]]
    if window > TIES:
        near = np.zeros(len(buf) + TIES + 1, np.int32)
        np.add.at(near, x, 1)
        np.add.at(near, x + TIES, -1)
        samples = np.flatnonzero(np.cumsum(near) > 0)
        samples = samples[np.isin(samples % TIES, TIE_COVER)]
        ranked = Order(eights, samples)
        ranked.by_bytes(_steps(0, window))
        rank = np.zeros(len(buf) + TIES + 1, np.int64)
        rank[samples] = ranked.ranks
        sorted_.by_samples(rank)
        x = at[sorted_.order[tied]]
    equal = np.ones(len(x) - 1, bool)
    for k in _steps(0, window):  # neighbours, byte by byte
        i = np.flatnonzero(equal)
        equal[i] = eights[x[i] + k] == eights[x[i + 1] + k]
    heads = np.flatnonzero(np.append(True, ~equal))
    first = np.repeat(np.minimum.reduceat(x, heads), np.diff(np.append(heads, len(x))))
    late[sorted_.order[tied]] = x > first
    return late


def _grouped(doc: np.ndarray, place: np.ndarray) -> tuple[np.ndarray, pa.Array]:
    """Documents and the list of places of each, both ascending."""
    heads = np.flatnonzero(np.append(True, doc[1:] != doc[:-1])) if len(doc) else np.zeros(0, np.int64)
    return doc[heads], pa.ListArray.from_arrays(pa.array(np.append(heads, len(doc)).astype(np.int32)), pa.array(place.astype(np.int32)))


def _planes(x: np.ndarray) -> bytes:
    """Numbers byte by byte of their places, which packs tighter: upper bytes are mostly alike."""
    return np.ascontiguousarray(x.view(np.uint8).reshape(len(x), x.itemsize).T).tobytes()


def _whole(raw: bytes, kind) -> np.ndarray:
    return np.ascontiguousarray(np.frombuffer(raw, np.uint8).reshape(np.dtype(kind).itemsize, -1).T).reshape(-1).view(kind)


SAMPLE_BYTES = 16  # a rank, a document and a place
SAMPLE_SCHEMA = "bucket int, samples binary, doc_id long, flags array<int>"
_SAMPLES = pa.schema([("bucket", pa.int32()), ("samples", pa.binary()), ("doc_id", pa.int64()), ("flags", pa.list_(pa.int32()))])


def _samples(buckets: int, depth: int, skip=None):
    """Cover samples of each piece: per bucket, packed ranks, documents and places, so what is sent follows the samples,
    whatever the number of buckets. Of equal ones in a piece one goes on, and all
    are flagged at once. Documents that the sieve `skip` may hold are left to another reader."""

    def run(batches):
        z = zstandard.ZstdCompressor(level=1)
        for batch in batches:
            if skip is not None:
                batch = batch.filter(pa.array(~skip.value.keeps(batch["doc_id"].to_numpy(zero_copy_only=False))))
            for p in pieces(batch, "doc_id", "text", PIECE):
                at = _cover(p, depth)
                if not len(at):
                    continue
                eights = _eights(p.buf)
                h = chained([eights[at + k] for k in _steps(0, depth)], 5)
                order = np.argsort(h, kind="stable")
                same = h[order][1:] == h[order][:-1]
                flagged, later = np.zeros(len(at), bool), np.zeros(len(at), bool)
                flagged[order[1:][same]] = flagged[order[:-1][same]] = later[order[1:][same]] = True
                doc = p.doc_of(at[flagged])
                d, flags = _grouped(doc, at[flagged] - p.offs[doc])
                if len(d):
                    own = (d % buckets).astype(np.int32)
                    yield pa.RecordBatch.from_arrays([pa.array(own), pa.nulls(len(d), pa.binary()), pa.array(p.ids[d]), flags], schema=_SAMPLES)
                at, h = at[~later], h[~later]
                bucket = ((h & np.uint64(0xFFFFFFFF)) % np.uint64(buckets)).astype(np.int32)
                order = np.argsort(bucket, kind="stable")
                at, rank, bucket = at[order], (h[order] >> np.uint64(32)).astype(np.uint32), bucket[order]
                heads = np.flatnonzero(np.append(True, bucket[1:] != bucket[:-1]))
                ends, doc = np.append(heads[1:], len(at)), p.doc_of(at)
                ids, place = p.ids[doc].astype(np.int64), (at - p.offs[doc]).astype(np.uint32)
                packed = [z.compress(b"".join([rank[a:b].tobytes(), _planes(np.diff(ids[a:b], prepend=0)), _planes(np.diff(place[a:b], prepend=np.uint32(0)))])) for a, b in zip(heads, ends, strict=True)]
                n = len(heads)
                yield pa.RecordBatch.from_arrays([pa.array(bucket[heads]), pa.array(packed, pa.binary()), pa.nulls(n, pa.int64()), pa.nulls(n, pa.list_(pa.int32()))], schema=_SAMPLES)

    return run


def _sort_bucket(t: pa.Table) -> pa.Table:
    """Places of the samples of one bucket that share their rank with another."""
    z = zstandard.ZstdDecompressor()
    told = t.filter(t["samples"].is_null()).select(["doc_id", "flags"])
    t = t.filter(t["samples"].is_valid())

    def of(raw: bytes) -> np.ndarray:
        return np.frombuffer(raw, np.uint32, len(raw) // SAMPLE_BYTES).copy()

    ranks = [of(z.decompress(x)) for x in t["samples"].to_pylist()]
    if not ranks:
        return told
    sizes = np.array([len(r) for r in ranks])
    keys = np.concatenate(ranks).astype(np.uint64)
    del ranks
    keys <<= np.uint64(32)
    keys |= np.arange(len(keys), dtype=np.uint64)
    keys.sort()  # a rank and its place in the bucket
    same = np.flatnonzero((keys[1:] >> np.uint64(32)) == (keys[:-1] >> np.uint64(32)))
    flagged = np.zeros(len(keys), bool)
    for at in (same, same + 1):
        flagged[(keys[at] & np.uint64(0xFFFFFFFF)).astype(np.int64)] = True
    del keys, same
    out, begin = [told], 0
    for samples, n in zip(t["samples"], sizes, strict=True):
        mark = flagged[begin : begin + n]
        begin += n
        if mark.any():
            raw = z.decompress(samples.as_py())
            ids, place = np.cumsum(_whole(raw[4 * n : 12 * n], np.int64)), np.cumsum(_whole(raw[12 * n :], np.uint32), dtype=np.uint32)
            doc, place = ids[mark], place[mark].astype(np.int64)
            order = np.lexsort((place, doc))
            d, flags = _grouped(doc[order], place[order])
            out.append(pa.table([pa.array(d), flags], schema=told.schema))
    release()
    return pa.concat_tables(out)


def _near_samples(batch, piece, window: int) -> tuple[np.ndarray, np.ndarray]:
    """Strings with a flagged sample among their first PERIOD bytes: their places and documents."""
    marks = np.zeros(len(piece.buf) + 1, np.int32)
    for i in range(len(piece)):
        q = np.unique(batch["flags"][piece.first + i].values.to_numpy()) + piece.offs[i]
        np.add.at(marks, np.maximum(q - PERIOD + 1, piece.offs[i]), 1)
        np.add.at(marks, q + 1, -1)
    at = np.flatnonzero(np.cumsum(marks)[:-1] > 0)
    doc = piece.doc_of(at)
    fits = at + window <= piece.offs[doc + 1]
    return at[fits], doc[fits]


def cut(window: int):
    """The suffixes that can be repeated, packed for their buckets, and at once the intervals that a piece itself shows
    to be repeated."""

    def run(batches):
        for batch in batches:
            batch = batch.take(pa.array(np.argsort(batch["doc_id"].to_numpy(), kind="stable")))  # the corpus's order
            for p in pieces(batch, "doc_id", "text", CUT_BYTES):
                at, doc = _near_samples(batch, p, window)
                late = repeated(p.buf, at, window)
                yield from told(p.ids, *cover(doc[late], at[late], p.offs, window))
                at, doc = at[~late], doc[~late]
                if len(at):
                    eights, place = _eights(p.buf), np.arange(len(p.buf) - GRAM + 1)
                    grams = chained([eights[place + k] for k in _steps(0, GRAM)], 3)
                    every = np.arange(len(p.buf))
                    yield super_kmers(p, sliding_min(grams, window - GRAM + 1)[at], at, doc, p.offs, every, every + 1, window)

    return run


def _count(window: int):
    def settle(t: pa.Table):
        # a string's place in the corpus is its document and start: rows are put in that order first
        order = np.lexsort((t["first"].to_numpy(), t["doc_id"].to_numpy()))
        t = t.take(pa.array(order))
        ids, start = t["doc_id"].to_numpy(), t["first"].to_numpy()
        packed = t["packed"].combine_chunks().cast(pa.large_binary())
        offs = np.frombuffer(packed.buffers()[1], np.int64)[packed.offset : packed.offset + len(t) + 1]
        buf = np.frombuffer(packed.buffers()[2], np.uint8)[offs[0] : offs[-1]]
        offs = offs - offs[0]
        room = np.diff(offs) - window + 1
        row = np.repeat(np.arange(len(t)), room)
        at = np.arange(len(row)) + np.repeat(offs[:-1] - (np.cumsum(room) - room), room)
        late = repeated(buf, at, window)
        first = np.zeros(len(t), bool)
        first[order[row[~late]]] = True
        r, a, b = cover(row[late], at[late], offs, window)
        return [pa.RecordBatch.from_arrays([pa.array(ids[r]), pa.array(start[r] + a), pa.array(start[r] + b)], names=["doc_id", "first", "last"])], first

    def run(batches):
        yield from blocks(batches, BLOCK_BYTES, settle)
        release()

    return run


def _remove(batches):
    for batch in batches:
        rows = []
        for i, text, spans in zip(batch["doc_id"].to_pylist(), batch["text"].cast(pa.large_binary()).to_pylist(), batch["spans"].to_pylist(), strict=True):
            mark = np.zeros(len(text) + 1, np.int32)
            for s in spans:
                mark[s["first"]] += 1
                mark[s["last"]] -= 1
            gone = np.cumsum(mark)[:-1] > 0
            rest = np.frombuffer(text, np.uint8)[~gone].tobytes()
            rows.append((i, int(gone.sum()), int((gone & ~np.append(False, gone[:-1])).sum()), hashlib.sha256(rest).hexdigest(), rest))
        cols = list(zip(*rows, strict=True)) or [[]] * 5
        yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, (pa.int64(), pa.int64(), pa.int64(), pa.string(), pa.binary()), strict=True)], names=["doc_id", "n_removed", "n_spans", "kept_sha256", "kept"])


def _copies(docs: DataFrame) -> DataFrame:
    """Ids of documents whose whole text an earlier one has."""
    named = docs.select("doc_id", F.octet_length("text").alias("n"), F.sha2("text", 256).alias("sha"))
    first = named.groupBy("sha", "n").agg(F.min("doc_id").alias("head"), F.count("*").alias("rows")).where("rows > 1")
    return named.join(first, ["sha", "n"]).where("doc_id > head").select("doc_id")


def _rows(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    return docs.select(F.col(id_col).cast("long").alias("doc_id"), F.coalesce(F.col(text_col), F.lit("")).alias("text")).where("doc_id is not null")


def _removals(docs: DataFrame, copies: DataFrame, window: int) -> DataFrame:
    spark, depth = docs.sparkSession, window - PERIOD + 1
    total = docs.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    buckets = max(2 * spark.sparkContext.defaultParallelism, int(total * len(COVER) / PERIOD / BUCKET_SAMPLES))
    kept = sieve(copies)  # all but later copies of whole texts; only rows that may be one are joined
    samples = docs.mapInArrow(_samples(buckets, depth, kept), SAMPLE_SCHEMA)
    samples = samples.unionByName(thin(docs, kept, "doc_id").join(copies, "doc_id", "left_anti").mapInArrow(_samples(buckets, depth), SAMPLE_SCHEMA))
    flagged = stage(samples.groupBy("bucket").applyInArrow(_sort_bucket, "doc_id long, flags array<int>"))
    flags = flagged.groupBy("doc_id").agg(F.flatten(F.collect_list("flags")).alias("flags"))
    near = thin(docs, sieve(flagged.select("doc_id")), "doc_id").join(copies, "doc_id", "left_anti").join(flags, "doc_id")
    packed = near.mapInArrow(cut(window), CUT_SCHEMA).repartition("minimiser").sortWithinPartitions("minimiser")
    spans = stage(packed.mapInArrow(_count(window), SPANS))
    per_doc = spans.groupBy("doc_id").agg(F.collect_list(F.struct("first", "last")).alias("spans"))
    hit = thin(docs, sieve(spans.select("doc_id")), "doc_id").join(per_doc, "doc_id")
    return hit.mapInArrow(_remove, "doc_id long, n_removed long, n_spans long, kept_sha256 string, kept binary")


def suffix_digest(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", window: int = WINDOW) -> DataFrame:
    """Per document: doc_id, n_bytes, n_removed, n_spans, kept_sha256 after removing each byte covered by a string of
    `window` bytes (over PERIOD) that also starts earlier, in a smaller id or before in the same document.

    Strings are judged on the input. A null or empty text, and any shorter than `window`, keeps everything. A later copy
    of a whole text loses it all, in one span, if it has `window` bytes. Rows without an id are left out; of rows that share
    an id, `one_row_per_id` names one for all. Other columns are ignored."""
    rows = _rows(docs, id_col, text_col)
    docs = one_row_per_id(rows)
    copies = stage(_copies(docs))
    gone = _removals(docs, copies, window).drop("kept")
    full = docs.select("doc_id", F.octet_length("text").cast("long").alias("n_bytes"), F.sha2("text", 256).alias("sha"))
    found = full.join(copies.select("doc_id", F.lit(True).alias("copy")), "doc_id", "left").join(gone, "doc_id", "left")
    whole = F.col("copy") & (F.col("n_bytes") >= window)
    found = found.select(
        "doc_id",
        "n_bytes",
        F.when(whole, F.col("n_bytes")).otherwise(F.coalesce("n_removed", F.lit(0))).alias("n_removed"),
        F.when(whole, F.lit(1)).otherwise(F.coalesce("n_spans", F.lit(0))).cast("long").alias("n_spans"),
        F.when(whole, F.sha2(F.lit(""), 256)).otherwise(F.coalesce("kept_sha256", "sha")).alias("kept_sha256"),
    )
    return for_each_row(rows, docs, found)


def remove_repeated(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", window: int = WINDOW) -> DataFrame:
    """(doc_id, kept): the remaining bytes of every document that loses some; later copies of whole texts keep none."""
    docs = one_row_per_id(_rows(docs, id_col, text_col))
    copies = stage(_copies(docs))
    long_copies = docs.select("doc_id", F.octet_length("text").alias("n")).where(F.col("n") >= window).join(copies, "doc_id", "left_semi")
    return _removals(docs, copies, window).select("doc_id", "kept").unionByName(long_copies.select("doc_id", F.lit(b"").alias("kept")))


def op8_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return suffix_digest(table(spark, sf_dir, "documents"))
