"""Pairs of chunks with similar texts: a verified set-similarity self-join by prefix filter.

A text's set holds its distinct shingles of lower-cased words. Chunks with equal sets are one class, and only the class's
smallest id, its head, takes part further. Any order of all shingles finds the same pairs; here those in slots that hold many
come last, which takes a table of fixed size and no join. Of two sets with a Jaccard similarity of t percent, the first
n - ceil(t n / 100) + 1 shingles of each share one, so only these prefixes are sent and indexed; sizes, what can still
follow the shared place, and 128 marks of the sets rule out most pairs that meet. Pairs that are left are confirmed on their
full sets, in which the shingles of heads that meet another stand as numbers. Texts are cut into shingles once for the search
and, of heads that meet another, once more for the numbers. Staged tables are deleted when no later step reads them.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from docspark.sources.shared import dropped, once, staged

BLOCK = 1000  # heads under one value that one task compares
SLOT_BITS = 18
SLOTS = 1 << SLOT_BITS  # that shingles are counted in
SLOTS_A_ROW = 4096
PICKED = ("chunk_id", "key", "n", "low", "high", "prefix")
MARK_BITS = 1 << 27  # of the table that finds texts by id


def with_shingles(df: DataFrame, width: int, col: str = "text", made: str = "set") -> DataFrame:
    """`df` with the distinct runs of `width` lower-cased words of a text, in order of their letters; a shorter text is one
    run, and a text without words has none. Words are split once a row, as a function over runs would do it for each."""
    text = F.regexp_replace(F.lower(F.coalesce(F.col(col), F.lit(""))), r"\s+", " ")
    rows = once(df.withColumn("__words", F.split(F.trim(text), " ")), "__words")
    starts = F.sequence(F.lit(0), F.greatest(F.size("__words") - width, F.lit(0)))
    runs = F.transform(starts, lambda i: F.concat_ws(" ", *[F.get("__words", i + k) for k in range(width)]))  # no word is null
    found = F.when(F.get("__words", 0) != "", F.sort_array(F.array_distinct(runs))).otherwise(F.array().cast("array<string>"))
    return once(rows.withColumn(made, found), made).drop("__words")


def _digest(col: str) -> Column:
    return F.sha2(F.array_join(col, "\n"), 256)


def _short(digest: Column | str) -> Column:
    """128 bits of a digest in hex."""
    return F.substring(F.unhex(digest), 1, 16)


def _keyed(chunks: DataFrame, width: int) -> DataFrame:
    """(chunk_id, n, key, hashes): the number of a chunk's shingles, a digest of them all and a hash of each."""
    sets = with_shingles(chunks.select("chunk_id", "text"), width)
    return sets.select("chunk_id", F.size("set").alias("n"), _digest("set").alias("key"), F.transform("set", lambda x: F.xxhash64(x)).alias("hashes"))


def _with_class(keyed: DataFrame) -> DataFrame:
    """`keyed` with the least id of those with the same digest as class_id; a chunk without words has none."""
    heads = keyed.where("n > 0").groupBy("key").agg(F.min("chunk_id").alias("class_id"))
    return keyed.join(heads, "key", "left")


def equal_sets(chunks: DataFrame, width: int = 5) -> DataFrame:
    """(chunk_id, class_id, n): for each chunk the smallest id among those with the same shingles, and their number. A chunk
    without words is a class of its own. Digests are staged, as texts would be cut into shingles for either side of the
    join."""
    keyed = staged(_keyed(chunks, width).drop("hashes"))
    return _with_class(keyed).select("chunk_id", F.coalesce("class_id", "chunk_id").alias("class_id"), "n")


def _hashes(batch: pa.RecordBatch) -> np.ndarray:
    return batch.column("hashes").flatten().to_numpy(zero_copy_only=False).view(np.uint64)


def _counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    held = np.zeros(SLOTS, dtype="<u4")
    for batch in batches:
        held += np.bincount((_hashes(batch) >> np.uint64(64 - SLOT_BITS)).astype(np.int64), minlength=SLOTS).astype("<u4")
    parts = np.flatnonzero(held.reshape(-1, SLOTS_A_ROW).any(1))
    yield pa.RecordBatch.from_arrays([pa.array(parts, pa.int32()), pa.array([held[x * SLOTS_A_ROW : (x + 1) * SLOTS_A_ROW].tobytes() for x in parts], pa.binary())], ["part", "held"])


def _summed(rows: pa.Table) -> pa.Table:
    held = sum(np.frombuffer(x.as_py(), dtype="<u4").astype("<i8") for x in rows.column("held"))
    return pa.table({"part": rows.column("part").slice(0, 1), "held": pa.array([held.tobytes()], pa.binary())})


def _ranks(keyed: DataFrame) -> np.ndarray:
    """A rank for each of SLOTS slots that hashes fall into by their first bits: 0, or more the further the shingles in it
    stand out from the mean of all slots. What hashes are counted in is of a fixed size, however many there are."""
    each = keyed.select("hashes").mapInArrow(_counted, "part int, held binary")
    held = np.zeros(SLOTS, dtype=np.int64)
    for r in each.groupBy("part").applyInArrow(_summed, "part int, held binary").collect():
        held[r.part * SLOTS_A_ROW : (r.part + 1) * SLOTS_A_ROW] = np.frombuffer(r.held, dtype="<i8")
    over = held - held.mean()
    over[over <= 64 + 8 * held.mean() ** 0.5] = 0
    return np.minimum(np.ceil(np.log2(over + 1)), 31).astype(np.uint64)


def _picker(ranks: np.ndarray, percent: int) -> Callable:
    """For mapInArrow: hashes become the ordered values of a set's prefix, and 128 marks that tell whether the hashes with the
    same last bits are odd in number. A value begins with its slot's rank, so shingles that many texts hold come last in all
    of them."""

    def picked(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in (b.slice(at, 2000) for b in batches for at in range(0, b.num_rows, 2000)):
            x, n = _hashes(batch), batch.column("n").to_numpy(zero_copy_only=False).astype(np.int64)
            row = np.repeat(np.arange(len(n)), n)
            odd = np.bincount(row * 128 + (x & np.uint64(127)).astype(np.int64), minlength=len(n) * 128) % 2
            marks = np.packbits(odd.reshape(-1, 128), axis=1).view(np.int64)
            values = ranks[x >> np.uint64(64 - SLOT_BITS)] << np.uint64(58) | x >> np.uint64(6)
            values = values[np.lexsort((values, row))].view(np.int64)
            most = n - -(-n * percent // 100) + 1
            place = np.arange(len(values)) - np.repeat(np.cumsum(n) - n, n)
            prefix = pa.ListArray.from_arrays(np.concatenate([[0], np.cumsum(most)]).astype(np.int32), values[place < np.repeat(most, n)])
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in ("chunk_id", "key", "n")), pa.array(marks[:, 0]), pa.array(marks[:, 1]), prefix], [*PICKED])

    return picked


def _heads(chunks: DataFrame, width: int, percent: int) -> DataFrame:
    """(head, chunk_id, key, n, low, high, prefix): the heads with a number each. Hashes are kept only until prefixes are picked, and only
    prefixes are sent."""
    found = _keyed(chunks.where(F.col("chunk_id").isNotNull()), width).where("n > 0")
    keyed = staged(found.withColumn("key", _short("key")))
    prefixes = staged(keyed.mapInArrow(_picker(_ranks(keyed), percent), f"chunk_id {dict(keyed.dtypes)['chunk_id']}, key binary, n int, low bigint, high bigint, prefix array<bigint>"))
    dropped(keyed)
    least = prefixes.groupBy("key").agg(F.min(F.struct(*[c for c in PICKED if c != "key"])).alias("least"))
    heads = staged(least.select(F.monotonically_increasing_id().alias("head"), "key", "least.*"))
    dropped(prefixes)
    return heads


def _index(heads: DataFrame) -> DataFrame:
    """(head, n, value, place, heads): each head's values within its prefix that other heads have there too, and how many."""
    each = heads.select("head", "n", F.posexplode("prefix").alias("place", "value")).withColumn("place", F.col("place") + 1)
    return each.withColumn("heads", F.count("*").over(Window.partitionBy("value"))).where("heads > 1")


def _meeting(index: DataFrame, heads: DataFrame, percent: int, block: int) -> DataFrame:
    """(u, v): pairs that share a value of both prefixes and can reach the similarity by sizes, places and marks. Each
    shingle that only one of two sets holds changes one mark, so as many as differ are not common. The heads under a value are dealt
    into blocks of about `block`; two blocks meet in a cell of their own, so no task compares more than two of them."""
    blocks = F.greatest(F.ceil(F.col("heads") / block), F.lit(1)).cast("int")
    dealt = index.withColumn("blocks", blocks).withColumn("block", F.pmod(F.xxhash64("head"), F.col("blocks")).cast("int")).drop("heads")
    cells = dealt.select("*", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)).alias("with")).withColumn("low", F.least("block", "with")).withColumn("high", F.greatest("block", "with")).drop("blocks", "with")
    a, b = (cells.select("value", "low", "high", F.col("head").alias(x), F.col("n").alias(f"{x}_n"), F.col("place").alias(f"{x}_place"), F.col("block").alias(f"{x}_block")) for x in "uv")
    met = a.join(b, ["value", "low", "high"]).where((F.col("u") < F.col("v")) & ((F.col("low") == F.col("high")) | (F.col("u_block") != F.col("v_block"))))
    fits = (F.col("u_n") * 100 >= F.col("v_n") * percent) & (F.col("v_n") * 100 >= F.col("u_n") * percent)
    most = 1 + F.least(F.col("u_n") - F.col("u_place"), F.col("v_n") - F.col("v_place"))
    met = met.where(fits & (most * (100 + percent) >= (F.col("u_n") + F.col("v_n")) * percent)).select("u", "v").repartition("u").distinct()
    u, v = (heads.select(F.col("head").alias(x), *[F.col(c).alias(f"{x}_{c}") for c in ("n", "low", "high")]) for x in "uv")
    apart = F.bit_count(F.col("u_low").bitwiseXOR(F.col("v_low"))) + F.bit_count(F.col("u_high").bitwiseXOR(F.col("v_high")))
    return met.join(u, "u").join(v, "v").where(apart * (100 + percent) <= (F.col("u_n") + F.col("v_n")) * (100 - percent)).select("u", "v")


def _only(chunks: DataFrame, ids: DataFrame) -> DataFrame:
    """The rows of `chunks` whose id is one of `ids`, and a few others: ids set bits of a table of at most MARK_BITS, so no
    text is sent to find them."""
    bits = max(1 << 16, min(MARK_BITS, 1 << (16 * ids.count()).bit_length()))
    place = F.pmod(F.xxhash64("chunk_id"), F.lit(bits)) + 1
    rows = ids.groupBy(F.bitmap_bucket_number(place).alias("part")).agg(F.bitmap_construct_agg(F.bitmap_bit_position(place)).alias("bits")).collect()
    marks = np.zeros(bits // 8, dtype=np.uint8)
    for r in rows:
        marks[(r.part - 1) * 4096 : r.part * 4096] = np.frombuffer(r.bits, dtype=np.uint8)

    @F.arrow_udf("boolean")
    def marked(at: pa.Array) -> pa.Array:
        x = at.to_numpy(zero_copy_only=False)
        return pa.array((marks[x >> 3] >> (x & 7) & 1).astype(bool))

    return chunks.where(F.col("chunk_id").isNotNull()).where(marked(place - 1))


def _numbered(rows: DataFrame) -> DataFrame:
    """(head, set): the shingles of `rows` (head, set) as numbers, equal ones for equal shingles; those of one head alone are
    left out."""
    each = rows.select("head", F.explode("set").alias("shingle"))
    often = each.groupBy("shingle").agg(F.count("*").alias("df")).where("df > 1")
    numbers = staged(often.select("shingle", F.monotonically_increasing_id().alias("number")))
    return each.join(numbers, "shingle").groupBy("head").agg(F.collect_set("number").alias("set"))


def near_duplicate_chunks(chunks: DataFrame, width: int = 5, percent: int = 80, block: int = BLOCK) -> DataFrame:
    """(u, v, shared, total): pairs of heads, u < v, whose sets have at least `percent` of all their shingles in common,
    with the numbers of common ones and of all. With `equal_sets`, every pair of chunks follows. Rows that come more than
    once have their pairs as often."""
    heads = _heads(chunks, width, percent)
    index = staged(_index(heads))
    pairs = staged(_meeting(index, heads, percent, block))
    dropped(index)
    ends = staged(heads.select("head", "chunk_id", "key", "n").join(pairs.select(F.explode(F.array("u", "v")).alias("head")).distinct(), "head"))
    dropped(heads)
    texts = _only(chunks.select("chunk_id", "text"), ends).join(ends.select("head", "chunk_id", F.col("key").alias("of")), "chunk_id")
    rows = staged(with_shingles(texts, width).where(_short(_digest("set")) == F.col("of")).select("head", "set"))
    times = rows.groupBy("head").agg(F.count("*").cast("int").alias("times"))
    sets = staged(_numbered(rows).join(ends.select("head", "chunk_id", "n"), "head").join(times, "head"))
    dropped(rows)
    a, b = (sets.select(F.col("head").alias(x), *[F.col(c).alias(f"{x}_{c}") for c in ("chunk_id", "n", "times", "set")]) for x in "uv")
    both = once(pairs.join(a, "u").join(b, "v").withColumn("shared", F.size(F.array_intersect("u_set", "v_set"))), "shared")
    total = F.col("u_n") + F.col("v_n") - F.col("shared")
    found = both.withColumn("total", total).where((F.col("shared") * 100 >= F.col("total") * percent) & (F.col("u_chunk_id") != F.col("v_chunk_id")))
    for x in "uv":  # one after the other, as their product may be large
        found = found.withColumn(f"{x}_copy", F.explode(F.array_repeat(F.lit(0), F.col(f"{x}_times"))))
    return found.select(F.least("u_chunk_id", "v_chunk_id").alias("u"), F.greatest("u_chunk_id", "v_chunk_id").alias("v"), "shared", "total")
