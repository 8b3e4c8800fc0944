"""Packing of tokenised documents into fixed sequences by a configuration linear program.

Only the histogram of piece lengths goes to the driver, at most `limit` numbers whatever the corpus. A configuration is
a multiset of lengths that fits a sequence; the program covers all pieces by the least mass of configurations.
Multiplicative weights price the lengths: each round solves the knapsack over the prices by dynamic programming, covers the
demand by the configurations that the knapsack finds best around each length, and makes lengths dearer by a factor that
ended in poor ones. Where lengths are few, the configurations of all rounds are also averaged by weights of their own, and
priced again. The demand's price over that of the dearest configuration is a lower bound, which the log tells. The cover
of the least mass is rounded to whole sequences within the demand: each configuration is used as often as its mass says,
rounded down, then once more as long as its lengths are left. What is left is priced and covered again in this way, until
fewer pieces than lengths remain; these go best-fit decreasing. Where best fit alone needs fewer sequences, its plan is
taken. The plan, intervals of ranks per length, is broadcast; it and the driver's work depend on the lengths and rounds and
not on the number of pieces. The pieces of a length are ranked in salted slices, so a length shared by a third of all rows
spreads over the cluster.
"""

from __future__ import annotations

import itertools
import logging
import math
import re
import string
import zlib

import numpy as np
import public_tokenizers
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import LongType, StructField, StructType
from pyspark.sql.window import Window

from docspark.llm.bytewise import WHITE, joined, kept, parts, release, stretches
from docspark.llm.staging import stage, table

LIMIT = 4096
END_ID = 1
ROUNDS = 8
FEW = 48  # lengths whose configurations are averaged over rounds
TURNS, RATES, GAP = 6000, (0.3, 0.1, 0.03, 0.01), 1e-4  # of an average; of its weights; between mass and bound, where rounds end
CACHE_BYTES = 6 << 20  # of words and their ids that a worker keeps
SLICE_ROWS = 512  # texts that a worker gets at once
SLICE_BYTES = 1 << 20  # of them whose words are told apart at once
TOKENIZER = "word_bpe_49k.json"
LOG = logging.getLogger(__name__)


def _byte_letters() -> list[str]:
    """The letter that stands for each byte in a byte-level vocabulary: printable bytes themselves, others from U+0100 on."""
    plain = [b for b in range(256) if 33 <= b <= 126 or 161 <= b <= 172 or 174 <= b <= 255]
    rest = iter(range(256, 512))
    return [chr(b) if b in plain else chr(next(rest)) for b in range(256)]


def _encoder(path: str):
    """Bytes of a text -> its ids as little-endian unsigned 32-bit numbers; `each` of it takes an array of texts. The
    tokenizer and the words that it has encoded live as long as the function.

    The tokenizer never joins ids over white space, nor a Latin letter that stays one in lower case with a mark after it
    but an apostrophe, so texts are cut there, and each different word of an array is looked up once among the known ones.
    A word of plain Latin letters is one pre-token and goes straight to the merges; any other takes the tokenizer's whole
    way. Words are kept as Arrow arrays; when they are too many, those that did not occur since the last time go."""
    from tokenizers import Tokenizer

    tok = Tokenizer.from_file(path)
    merge, letters, plain = tok.model.tokenize, _byte_letters(), re.compile("[A-Za-zªµºÀ-ÖØ-öø-\u012f]+").fullmatch
    special = "".join(t.content for t in tok.get_added_tokens_decoder().values())
    letter, mark = np.zeros((2, 256), bool)
    letter[list(string.ascii_letters.encode())] = True
    mark[[ord(x) for x in string.punctuation if x != "'" and x not in special]] = True
    lower = np.frombuffer(bytes(range(256)).lower(), np.uint8)
    none = pa.array([], pa.large_binary())
    known, ids_of, used = none, none, np.zeros(0, bool)

    def one(word: str) -> list[int]:
        if plain(word):
            word = word.lower()
            return [t.id for t in merge(word if word.isascii() else "".join([letters[b] for b in word.encode()]))]
        return tok.encode(word, add_special_tokens=False).ids

    def folded(words: pa.LargeBinaryArray) -> pa.LargeBinaryArray:
        """Words of A-Z and a-z alone in lower case, as the tokenizer has them."""
        buf, at = parts(words)
        low = np.logical_and.reduceat(letter[buf], at[:-1])
        return joined(np.where(np.repeat(low, np.diff(at)), lower[buf], buf), at)

    def looked_up(words: pa.LargeBinaryArray) -> pa.LargeBinaryArray:
        """The ids of different words."""
        nonlocal known, ids_of, used
        at = pc.index_in(words, known).fill_null(-1).to_numpy()
        new = at < 0
        used[at[~new]] = True
        if new.any():
            more = words.filter(pa.array(new))
            ids = [one(w) for w in b" ".join(more.to_pylist()).decode("utf-8", "replace").split(" ")]
            ends = np.cumsum([0, *map(len, ids)]) * 4
            more_ids = joined(np.fromiter(itertools.chain.from_iterable(ids), "<u4", ends[-1] // 4).view(np.uint8), ends)
            if known.nbytes + ids_of.nbytes + more.nbytes + more_ids.nbytes > CACHE_BYTES:
                at = np.where(new, -1, (np.cumsum(used) - 1)[at] if len(used) else at)
                known, ids_of = known.filter(pa.array(used)), ids_of.filter(pa.array(used))
                used = np.zeros(len(known), bool)
            at = np.where(new, len(known) + np.cumsum(new) - 1, at)
            known, ids_of, used = pa.concat_arrays([known, more]), pa.concat_arrays([ids_of, more_ids]), np.append(used, np.ones(len(more), bool))
        got = ids_of.take(pa.array(at))
        if known.nbytes + ids_of.nbytes > CACHE_BYTES:  # all of them occurred since
            known, ids_of, used = none, none, np.zeros(0, bool)
        return got

    def each(texts: pa.LargeBinaryArray) -> list[bytes]:
        buf, offs = parts(texts)
        inside = ~WHITE[buf]
        start = inside.copy()
        start[1:] &= ~inside[:-1] | letter[buf[:-1]] & mark[buf[1:]]
        edge = offs[:-1][offs[:-1] < len(buf)]
        start[edge] = inside[edge]
        begin = np.flatnonzero(start)
        if not len(begin):
            return [b""] * len(texts)
        first = np.searchsorted(begin, offs)
        ends = np.cumsum(inside, dtype=np.int32)  # of words without the space between
        words = joined(buf[inside], np.append(ends[begin] - 1, ends[-1])).dictionary_encode()
        del inside, start, begin, ends
        names = folded(words.dictionary).dictionary_encode()
        ids = looked_up(names.dictionary).take(names.indices).take(words.indices)
        data, at = parts(ids)
        to = at[first].tolist()
        return [data[x:y].tobytes() for x, y in zip(to[:-1], to[1:], strict=True)]

    def encode(text: bytes) -> bytes:
        return each(pa.array([text], pa.large_binary()))[0]

    encode.each = each
    return encode


def tokenised(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", limit: int = LIMIT, tokenizer: str | None = None, with_ids: bool = False) -> DataFrame:
    """A row per piece of at most `limit` ids: doc_id, piece, start, length, ids_crc32 and, if asked for, ids."""
    path = tokenizer or public_tokenizers.path(TOKENIZER)

    def run(batches):
        encode = kept(f"ids by {path}", lambda: _encoder(path))
        end = np.array([END_ID], "<u4").tobytes()
        for batch in batches:
            out = []
            for own, texts in stretches(batch, "doc_id", "text", SLICE_BYTES, SLICE_ROWS):
                for i, ids in zip(own.to_pylist(), encode.each(texts), strict=True):
                    ids += end
                    for k, a in enumerate(range(0, len(ids), 4 * limit)):
                        piece = ids[a : a + 4 * limit]
                        out.append((i, k, a // 4, len(piece) // 4, zlib.crc32(piece), piece if with_ids else None))
            cols = list(zip(*out, strict=True)) or [[]] * 6
            kinds = [pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int64(), pa.binary()]
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in list(zip(cols, kinds, strict=True))[: 6 if with_ids else 5]], names=["doc_id", "piece", "start", "length", "ids_crc32", "ids"][: 6 if with_ids else 5])
            del out, cols
        release()

    schema = "doc_id long, piece int, start long, length long, ids_crc32 long" + ", ids binary" * with_ids
    return docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text")).mapInArrow(run, schema)


def knapsack(lens: np.ndarray, price: np.ndarray, limit: int) -> np.ndarray:
    """For each room 0..limit, the highest price of lengths that fit it, each as often as one likes. A length is added to
    all rooms at once: in steps of its own size, the best so far or a copy more than at the step before."""
    best = np.zeros(limit + 1)
    for size, worth in zip(lens.tolist(), price.tolist(), strict=True):
        steps = -(-(limit + 1) // size)
        at = np.full(steps * size, -np.inf)
        at[: limit + 1] = best
        ladder = np.arange(steps)[:, None] * worth
        best = (np.maximum.accumulate(at.reshape(steps, size) - ladder, axis=0) + ladder).ravel()[: limit + 1]
    return best


def _configuration(lens: np.ndarray, price: np.ndarray, best: np.ndarray, limit: int, first: int, lack: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """A filling around a length, each step the best one by the knapsack among lengths that still lack as many pieces:
    lengths (as indices) and copies."""
    copies, room, k = {first: 1}, limit - int(lens[first]), first
    live = np.flatnonzero(lack > 1e-9)
    while True:
        live = live[: np.searchsorted(lens[live], room, "right")]
        if copies[k] + 1 > max(lack[k], 1):
            live = live[live != k]
        if not len(live):
            return np.array(list(copies)), np.array(list(copies.values()))
        worth = best[room - lens[live]] + price[live]
        k = int(live[len(live) - 1 - int(worth[::-1].argmax())])  # of equal ones the longest
        copies[k] = copies.get(k, 0) + 1
        room -= int(lens[k])


Mass = dict[tuple[tuple[int, int], ...], float]  # configurations, as (index, copies) pairs, and how often each is used


def _averaged(share: np.ndarray, turns: int) -> tuple[np.ndarray, np.ndarray]:
    """Masses of configurations that cover each length's demand once, and the lengths' weights. `share` is the part of a
    length's demand (row) that a configuration (column) covers. Each turn takes the configuration of the highest weight, as
    much of it as covers its tightest length, and lengths lose weight by what is covered; the masses are the average."""
    weight, columns, most = np.ones(len(share)), np.ascontiguousarray(share.T), share.max(0)
    best = (np.inf, np.zeros(share.shape[1]), weight)
    for rate in RATES:  # ever smaller steps, and averages that forget the larger ones
        x, covered = np.zeros(share.shape[1]), np.zeros(len(share))
        for _ in range(turns // len(RATES)):
            j = int((columns @ weight).argmax())
            part = columns[j] / most[j]
            x[j] += 1 / most[j]
            covered += part
            weight = weight * np.exp(-rate * part)
        weight /= weight.max()
        if (least := covered.min()) > 0:
            best = min(best, (x.sum() / least, x / least, weight), key=lambda k: k[0])
    return best[1], best[2]


def _basic(a: np.ndarray, x: np.ndarray) -> np.ndarray:
    """The same cover from no more columns than rows: while there are more, a change that covers the same and adds no mass
    is followed until a column is empty."""
    x = np.where(x > 1e-9 * x.sum(), x, 0.0)
    while len(live := np.flatnonzero(x)) > len(a):
        live = live[np.argsort(x[live])][: len(a) + 1]
        move = np.linalg.svd(a[:, live])[2][-1]
        move = move if move.sum() < 0 else -move
        if move.min() > -1e-9:
            break
        steps = np.where(move < -1e-12, x[live] / np.maximum(-move, 1e-12), np.inf)
        x[live] = np.maximum(x[live] + steps.min() * move, 0)
        x[live[steps.argmin()]] = 0
    return x


def fractional(lens: np.ndarray, demand: np.ndarray, limit: int, rounds: int = ROUNDS, price: np.ndarray | None = None) -> tuple[Mass, np.ndarray, float]:
    """Configurations with masses that cover the demand, the prices of the lengths, and a lower bound of the mass: the
    demand's price over the dearest configuration's, which no cover can be below.

    Each round covers the whole demand at its prices, and lengths that ended in poor configurations get dearer by a factor
    in the next. Where lengths are few, all configurations so far are averaged by their weights every few rounds, and these
    weights are the next prices. Of all covers the one with the least mass counts."""
    price = lens / limit if price is None else price
    kept, bound, pool = (np.inf, {}, price), 0.0, {}

    def cover(price: np.ndarray) -> np.ndarray:
        nonlocal kept, bound
        best, lack, poor, mass = knapsack(lens, price, limit), demand.copy(), np.zeros(len(lens)), {}
        bound = max(bound, float(demand @ price / best[limit]))
        for i in range(len(lens) - 1, -1, -1):
            while lack[i] > 1e-9:
                kinds, n = _configuration(lens, price, best, limit, i, lack)
                x = float((lack[kinds] / n).min())
                c = tuple(sorted(zip(kinds.tolist(), n.tolist(), strict=True)))
                mass[c] = mass.get(c, 0.0) + x
                lack[kinds] -= x * n
                poor[kinds] += x * n * (1 - (price[kinds] * n).sum() / best[limit])
        kept = min(kept, (sum(mass.values()), mass, price), key=lambda x: x[0])
        pool.update(dict.fromkeys(mass))
        return poor / demand

    def average() -> np.ndarray:
        nonlocal kept
        counts = np.zeros((len(lens), len(pool)))
        for j, c in enumerate(pool):
            counts[[i for i, _ in c], j] = [n for _, n in c]
        x, weight = _averaged(counts / demand[:, None], TURNS)
        x = _basic(counts, x)
        kept = min(kept, (float(x.sum()), {c: float(v) for c, v in zip(pool, x, strict=True) if v}, weight / demand), key=lambda x: x[0])
        best = knapsack(lens, weight / demand, limit)
        for i in range(len(lens)):
            kinds, n = _configuration(lens, weight / demand, best, limit, i, demand)
            pool[tuple(sorted(zip(kinds.tolist(), n.tolist(), strict=True)))] = None
        return weight / demand

    for turn in range(rounds):
        loss = cover(price)
        price = price * np.exp((loss - loss.mean()) / (2 * np.sqrt(turn + 1)))
        price *= (demand * lens).sum() / limit / (demand * price).sum()
        if len(lens) <= FEW and turn % 8 == 7:
            cover(average())
        if kept[0] <= bound * (1 + GAP):
            break
    if len(lens) <= FEW and kept[0] > bound * (1 + GAP):
        average()
    return kept[1], kept[2], bound


Uses = list[tuple[list[tuple[int, int]], int]]  # whole configurations ((length, copies) pairs, longest first) and how often each is used


def _rounded(lens: np.ndarray, left: np.ndarray, limit: int, rounds: int, bounds: list[float] | None = None) -> Uses:
    """Whole configurations, until fewer pieces than lengths are left; what they hold is taken from `left`. A turn that
    takes away little lets the next one use emptier configurations. Each turn's dual bound goes to `bounds`."""
    used, room, price, bounds = [], limit / 1024, lens / limit, [] if bounds is None else bounds
    while (rest := int(left.sum())) > max(64, len(lens) // 8):
        live = np.flatnonzero(left)
        mass, price[live], low = fractional(lens[live], left[live].astype(float), limit, max(2, rounds // 3) if used else rounds, price[live])
        bounds.append(low)
        free = {c: limit - sum(int(lens[live[k]]) * n for k, n in c) for c in mass}
        for up in (1e-6, 1 - 1e-6):  # rounded down, then what is left of each
            for c in sorted((c for c in mass if free[c] <= room or len(live) <= FEW and up < 0.5), key=lambda c: (free[c], -mass[c], c)):
                kinds, copies = live[[k for k, _ in c]], np.array([n for _, n in c])
                times = min(int(mass[c] + up), int((left[kinds] // copies).min()))
                if times > 0:
                    used.append(([(int(lens[k]), int(n)) for k, n in zip(kinds[::-1], copies[::-1], strict=True)], times))
                    left[kinds] -= times * copies
                    mass[c] -= times
        if rest - int(left.sum()) < rest // 32 + 1:
            room *= 2
            if room > 2 * limit:
                break
    return used


def best_fit(lens: np.ndarray, left: np.ndarray, limit: int) -> Uses:
    """Best fit by decreasing length. Sequences that are alike are one entry, (room, what they hold) and how many, and a
    length fills the tightest entries first, each of their sequences as far as it goes, so work follows the lengths and not the pieces."""
    held: dict[tuple[int, tuple[tuple[int, int], ...]], int] = {}

    def put(room: int, what: tuple[tuple[int, int], ...], times: int) -> None:
        if times:
            held[room, what] = held.get((room, what), 0) + times

    for k in range(len(lens) - 1, -1, -1):
        size, n = int(lens[k]), int(left[k])
        for key in sorted(x for x in held if x[0] >= size):
            if not n:
                break
            (room, what), times = key, held.pop(key)
            each = room // size
            full = min(times, n // each)
            put(room - each * size, (*what, (size, each)), full)
            n -= full * each
            if full < times and 0 < n < each:
                put(room - n * size, (*what, (size, n)), 1)
                full, n = full + 1, 0
            put(room, what, times - full)
        each = limit // size
        put(limit - each * size, ((size, each),), n // each)
        if n % each:
            put(limit - n % each * size, ((size, n % each),), 1)
    return [(list(what), times) for (_, what), times in held.items()]


def plan(histogram: dict[int, int], limit: int = LIMIT, rounds: int = ROUNDS) -> tuple[np.ndarray, int]:
    """Intervals (length, first rank, end rank, copies in a sequence, first sequence, offset) that place every piece,
    sorted by length and rank, and the number of sequences."""
    used = [([(limit, 1)], histogram[limit])] if limit in histogram else []
    lens = np.array(sorted(x for x in histogram if x < limit), np.int64)
    if len(lens):
        demand = np.array([histogram[int(x)] for x in lens], np.int64)
        plain, left, bounds = best_fit(lens, demand, limit), demand.copy(), [0.0]
        program = _rounded(lens, left, limit, max(rounds, min(32, 3000 // len(lens))), bounds) + best_fit(lens, left, limit)
        whole = max(-(-int(demand @ lens) // limit), math.ceil(bounds[min(1, len(bounds) - 1)] - 1e-6))
        count = lambda uses: sum(times for _, times in uses)
        LOG.info("%d pieces of %d lengths: %d sequences by the program, %d by best fit, at least %d", demand.sum(), len(lens), count(program), count(plain), whole)
        used += min(program, plain, key=count)
    rows, rank, sequences = [], dict.fromkeys(histogram, 0), 0
    for config, times in used:
        at = 0
        for size, copies in config:
            rows.append((size, rank[size], rank[size] + copies * times, copies, sequences, at))
            rank[size] += copies * times
            at += size * copies
        sequences += times
    return np.array(sorted(rows), np.int64).reshape(-1, 6), sequences


def pack(pieces: DataFrame, limit: int = LIMIT, rounds: int = ROUNDS) -> DataFrame:
    """`pieces` (of `tokenised`, staged) with sequence_id and offset."""
    spark = pieces.sparkSession
    histogram = {r["length"]: r["count"] for r in pieces.groupBy("length").count().toLocalIterator()}
    total, parts = sum(histogram.values()), int(spark.conf.get("spark.sql.shuffle.partitions"))
    intervals, _ = plan(histogram, limit, rounds)
    sent = spark.sparkContext.broadcast(intervals)
    unit = max(1, -(-total // (4 * parts)))  # rows of a slice
    slices = F.greatest(F.lit(1), F.ceil(F.col("rows") / unit)).cast("long")
    rows = pa.table({"length": pa.array(histogram.keys(), pa.int64()), "rows": pa.array(histogram.values(), pa.int64())})  # a list would start Python workers of another kind
    sizes = F.broadcast(spark.createDataFrame(rows).withColumn("slices", slices).drop("rows"))  # `limit` rows at most
    salted = pieces.join(sizes, "length").withColumn("slice", F.pmod(F.xxhash64("doc_id", "piece"), F.col("slices"))).drop("slices")
    counts = salted.groupBy("length", "slice").agg(F.count("*").alias("n"))
    before = Window.partitionBy("length").orderBy("slice").rowsBetween(Window.unboundedPreceding, -1)
    bases = counts.select("length", "slice", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("base"))
    within = Window.partitionBy("length", "slice").orderBy("doc_id", "piece")
    ranked = salted.withColumn("row", F.row_number().over(within) - 1).join(bases, ["length", "slice"])
    ranked = ranked.withColumn("rank", F.col("base") + F.col("row")).select(*pieces.columns, "rank")

    names = pieces.columns

    def place(batches):
        size, first, _, copies, sequence, at = sent.value.T
        key = size * (1 << 48) + first
        for batch in batches:
            length, rank = (batch[c].to_numpy(zero_copy_only=False) for c in ("length", "rank"))
            i = np.searchsorted(key, length * (1 << 48) + rank, "right") - 1
            turn = rank - first[i]
            cols = [batch[c] for c in names] + [pa.array(sequence[i] + turn // copies[i]), pa.array(at[i] + turn % copies[i] * length)]
            yield pa.RecordBatch.from_arrays(cols, names=[*names, "sequence_id", "offset"])

    schema = StructType([*pieces.schema, StructField("sequence_id", LongType()), StructField("offset", LongType())])
    return ranked.mapInArrow(place, schema)


def pack_documents(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", limit: int = LIMIT, tokenizer: str | None = None, with_ids: bool = False) -> DataFrame:
    """One row per piece: doc_id, piece, start, length, ids_crc32, (ids,) sequence_id, offset.

    A document is its ids and the end id 1; a null or empty text is the end id alone. Only documents over `limit` are
    cut. Repeated rows are packed each; other columns are ignored; an empty table gives an empty result."""
    return pack(stage(tokenised(docs, id_col, text_col, limit, tokenizer, with_ids), SLICE_ROWS), limit)


def sequences(packed: DataFrame) -> DataFrame:
    """(sequence_id, ids): the ids of whole sequences, of pieces packed with their ids."""
    joined = F.array_sort(F.collect_list(F.struct("offset", "ids")))

    def run(batches):
        for batch in batches:
            ids = [np.frombuffer(b"".join(x["ids"] for x in row), "<u4") for row in batch["parts"].to_pylist()]
            yield pa.RecordBatch.from_arrays([batch["sequence_id"], pa.array(ids, pa.list_(pa.int32()))], names=["sequence_id", "ids"])

    return packed.groupBy("sequence_id").agg(joined.alias("parts")).mapInArrow(run, "sequence_id long, ids array<int>")


def op1_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pack_documents(table(spark, sf_dir, "documents"))
