"""Near-duplicate detection with min-max hashing.

Each permutation of the shingles keeps its minimum and its maximum, so a signature of 240 values costs 120 hash
evaluations; minimum and maximum agree for two sets with the probability of their Jaccard similarity each. Bands of six
values find pairs of similarity 0.8 with probability 1 - (1 - 0.8^6)^40, over 0.999994.

Documents with equal sets are one class and go on as their smallest id. In a bucket, members are compared with one
pivot, the one that shares most places in buckets, then with another of the farthest component; components follow, and
only buckets that still hold more than one component are left. Their members are compared with a third pivot P, the
best linked document of the bucket's largest component, which gives what each lacks of P and what it has besides. If x
is not similar to P, then x and y can be similar only if they share more of these differences than
(100 d + t a) / (100 + t), where y lacks d shingles of P, has a others, and t is the threshold in percent; so y is
indexed by that many fewer of its differences, x looks all of its own up, and only documents with a difference in common
meet. A group of copies costs its size and not its square, and no link between different components is lost. All links
are confirmed on the full sets, of 128-bit fingerprints.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from docspark.llm.bytewise import STEP, Digests, mix64, pieces, release, seeded
from docspark.llm.components import components
from docspark.llm.sieve import holding, sieve
from docspark.llm.staging import drop_stage, for_each_row, one_row_per_id, stage, table, without

BANDS, ROWS = 40, 3  # rows are permutations: two values each
THRESHOLD = 80  # percent
SET_ROWS = 128  # pairs of sets in a Python worker at once
COMMON, RARE = 8, 16  # a difference is common if one of COMMON of a pivot's documents has it, RARE documents at least


def _shingles(h: np.ndarray, first: np.ndarray, width: int) -> tuple[np.ndarray, np.ndarray]:
    """Fingerprints of all word shingles, in two columns, and where each document's begin (one more at the end)."""
    n = np.diff(first)
    count = np.where(n >= width, n - width + 1, np.minimum(n, 1))
    offs = np.concatenate([[0], np.cumsum(count)])
    at = np.repeat(first[:-1] - offs[:-1], count) + np.arange(offs[-1])
    size = np.repeat(np.minimum(n, width), count)
    got = np.zeros((2, offs[-1]), np.uint64)
    for k in range(width):
        has = size > k
        for lane in range(2):
            got[lane, has] = mix64(got[lane, has] * STEP + h[at[has] + k, lane] + np.uint64(k + 1))
    return got, offs


def _sets(docs: DataFrame, width: int, made, schema: str, only=None) -> DataFrame:
    """Rows that `made(ids, sets, offs)` gives for the documents of a piece, whose distinct shingles are sorted; with a
    sieve `only`, of those that it lets through."""

    def run(batches):
        digests = Digests(folded=True)
        for batch in batches:
            if only is not None:  # here and not by `thin`, whose own Python workers would stay beside these
                batch = holding(batch, only.value, "doc_id")
            for p in pieces(batch, "doc_id", "text"):
                got, offs = _shingles(*digests.of(p), width)
                at = [a + np.unique(got[0, a:b], return_index=True)[1] for a, b in zip(offs[:-1], offs[1:], strict=True)]
                offs = np.concatenate([[0], np.cumsum([len(x) for x in at])]).astype(np.int64)
                yield made(p.ids, got[:, np.concatenate(at)], offs)
        del digests
        release()

    return docs.mapInArrow(run, schema)


def _per_doc(f, values: np.ndarray, offs: np.ndarray) -> np.ndarray:
    """f.reduceat over documents; empty ones give 0."""
    out = np.zeros(len(offs) - 1, values.dtype)
    full = np.flatnonzero(np.diff(offs))
    if len(full):
        out[full] = f.reduceat(values, offs[full])
    return out


def _bands(x: np.ndarray, offs: np.ndarray) -> np.ndarray:
    x = (x >> np.uint64(32)).astype(np.uint32)
    flips = seeded(7, BANDS * ROWS).astype(np.uint32)
    odd = seeded(8, BANDS * ROWS).astype(np.uint32) | np.uint32(1)
    keys = np.zeros((len(offs) - 1, BANDS), np.uint64)
    for band in range(BANDS):
        k = np.full(len(offs) - 1, band + 1, np.uint64)
        for p in range(band * ROWS, band * ROWS + ROWS):
            y = (x ^ flips[p]) * odd[p]
            for v in (_per_doc(np.minimum, y, offs), _per_doc(np.maximum, y, offs)):
                k = mix64(k * STEP + v.astype(np.uint64))
        keys[:, band] = k
    return keys


def signatures(docs: DataFrame, width: int) -> DataFrame:
    """Per document: its set's size, a 128-bit fingerprint of the set, and its band keys."""

    def made(ids, got, offs):
        sums = [_per_doc(np.add, mix64(lane), offs).view(np.int64) for lane in got]
        keys = pa.ListArray.from_arrays(np.arange(len(ids) + 1, dtype=np.int32) * BANDS, pa.array(_bands(got[0], offs).ravel().view(np.int64)))
        return pa.RecordBatch.from_arrays([pa.array(ids), pa.array(np.diff(offs)), *map(pa.array, sums), keys], names=["doc_id", "n", "f1", "f2", "bands"])

    return _sets(docs, width, made, "doc_id long, n long, f1 long, f2 long, bands array<long>")


def _packed(docs: DataFrame, width: int, only=None) -> DataFrame:
    """Per document its full set, sorted and packed; with a sieve `only`, for those that it lets through."""

    def made(ids, got, offs):
        return pa.RecordBatch.from_arrays([pa.array(ids), pa.array([got[:, a:b].tobytes() for a, b in zip(offs[:-1], offs[1:], strict=True)], pa.binary())], names=["id", "packed"])

    return _sets(docs, width, made, "id long, packed binary", only)


def _compared(pairs: DataFrame, sets: DataFrame, made, schema: str) -> DataFrame:
    """Rows that `made(batch, compared)` gives for pairs (u, v), where `compared` yields of each pair both sets' first
    columns and the places of what they share."""

    def run(batches):
        def compared(batch):
            for x, y in zip(batch["a"], batch["b"], strict=True):
                x, y = (np.frombuffer(z.as_buffer(), np.uint64).reshape(2, -1) for z in (x, y))
                _, i, j = np.intersect1d(x[0], y[0], assume_unique=True, return_indices=True)
                same = x[1][i] == y[1][j]
                yield x[0], y[0], i[same], j[same]

        for batch in batches:
            yield made(batch, compared(batch))
            release()

    left = pairs.join(sets.select(F.col("id").alias("u"), F.col("packed").alias("a")), "u")
    return left.join(sets.select(F.col("id").alias("v"), F.col("packed").alias("b")), "v").mapInArrow(run, schema)


def _confirm(pairs: DataFrame, sets: DataFrame, threshold: int) -> DataFrame:
    """Those of `pairs` (u, v) whose full sets are similar enough."""

    def made(batch, compared):
        keep = [len(i) * (100 + threshold) >= threshold * (len(x) + len(y)) for x, y, i, _ in compared]
        return batch.select(["u", "v"]).filter(pa.array(keep, pa.bool_()))

    return _compared(pairs, sets, made, "u long, v long")


def _differences(pairs: DataFrame, sets: DataFrame, threshold: int) -> DataFrame:
    """Of documents u and pivots v: whether they are similar; how many shingles v has, u lacks of them and has besides;
    and these, first those that u has."""

    def made(batch, compared):
        out = []
        for x, y, i, j in compared:
            more, less = np.delete(x, i), np.delete(y, j)
            out.append((len(i) * (100 + threshold) >= threshold * (len(x) + len(y)), len(y), len(less), len(more), np.concatenate([more, less]).view(np.int64)))
        cols = list(zip(*out, strict=True)) or [[]] * 5
        made = [pa.array(c, t) for c, t in zip(cols, (pa.bool_(), pa.int64(), pa.int64(), pa.int64(), pa.list_(pa.int64())), strict=True)]
        return pa.RecordBatch.from_arrays([*(batch[k] for k in "uvce"), *made], names=[*"uvce", "similar", "m", "d", "a", "parts"])

    return _compared(pairs, sets, made, "u long, v long, c long, e long, similar boolean, m long, d long, a long, parts array<long>")


def _common(against: DataFrame) -> DataFrame:
    """Per pivot v the differences that many of its documents have, the most frequent last; at most COMMON times as many
    as a document has on average. They only set the order in which differences are looked up."""

    def run(batches):
        for batch in batches:
            v = batch["v"].to_numpy()
            size = np.diff(batch["parts"].offsets.to_numpy())
            part, owner = batch["parts"].flatten().to_numpy(), np.repeat(v, size)
            order = np.lexsort((part, owner))
            part, owner = part[order], owner[order]
            heads = np.flatnonzero(np.append(True, (part[1:] != part[:-1]) | (owner[1:] != owner[:-1]))) if len(part) else np.zeros(0, np.int64)
            n = np.diff(np.append(heads, len(part)))
            pivots, rows = np.unique(v, return_counts=True)
            often = (n > 1) & (n * COMMON >= rows[np.searchsorted(pivots, owner[heads])])
            yield pa.RecordBatch.from_arrays([pa.array(x[often]) for x in (owner[heads], part[heads], n)], names=["v", "part", "n"])

    found = against.mapInArrow(run, "v long, part long, n long").groupBy("v", "part").agg(F.sum("n").alias("n"))
    sizes = against.groupBy("v").agg(F.count("*").alias("rows"))
    often = found.join(sizes, "v").where((F.col("n") >= RARE) & (F.col("n") * COMMON >= F.col("rows")))
    return often.groupBy("v").agg(F.sort_array(F.collect_list(F.struct("n", "part")))["part"].alias("common"))


def _looked_up(rows: DataFrame, first: str, names: str) -> DataFrame:
    """(pivot, part, and `names` for the document, its component, d, a and the part's place): the first differences of
    documents, as many as the expression `first` says: rare ones that the document has, rare ones that it lacks, and
    common ones."""
    own = names.split()

    def run(batches):
        for batch in batches:
            row, part, place = [], [], []
            for k, (x, common, a, n) in enumerate(zip(batch["parts"], batch["common"], batch["a"].to_pylist(), batch["first"].to_pylist(), strict=True)):
                x, common = x.values.to_numpy(), common.values.to_numpy() if common.is_valid else np.zeros(0, np.int64)
                rare = ~np.isin(x, common)
                x = np.concatenate([np.sort(x[:a][rare[:a]]), np.sort(x[a:][rare[a:]]), common[np.isin(common, x)]])[: max(n, 0)]
                row.append(np.full(len(x), k))
                part.append(x)
                place.append(np.arange(len(x)))
            row, part, place = (np.concatenate(x) if x else np.zeros(0, np.int64) for x in (row, part, place))
            kept = batch.select([*"vucda"]).take(pa.array(row.astype(np.int64)))
            yield pa.RecordBatch.from_arrays([kept["v"], pa.array(part), *(kept[c] for c in "ucda"), pa.array(place)], names=["pivot", "part", *own])

    schema = "pivot long, part long, " + ", ".join(f"{x} long" for x in own)
    return rows.withColumn("first", F.expr(first).cast("long")).mapInArrow(run, schema)


def _sharing(against: DataFrame, threshold: int) -> DataFrame:
    """Pairs (u, v) of documents in different components that share enough differences from a pivot to be similar, of
    which at least one is not similar to the pivot. `against` has _differences and the components c, e of u and v."""
    t = threshold
    rows = stage(against.join(stage(_common(against), SET_ROWS), "v", "left"))
    index = _looked_up(rows, f"d + a - floor((100 * d + {t} * a) / {100 + t})", "doc_id c d a at")
    index = stage(index, SET_ROWS)
    fewest = f"ceil(({t} * (2 * m - d + a) - {100 + t} * (m - d)) / 100)"  # differences that a document far from the pivot must share
    asked = _looked_up(rows.where("NOT similar AND c <> e"), f"d + a - greatest({fewest}, 1) + 1", "other f k b place")
    asked = stage(asked, SET_ROWS)
    sizes = against.select(F.col("v").alias("pivot"), "m").distinct()
    need = (2 * F.col("m") - F.col("d") - F.col("k") + F.col("a") + F.col("b")) * t - (F.col("m") - F.col("d") - F.col("k")) * (100 + t)
    most = F.least(F.least("d", "k") + F.least("a", "b"), F.col("d") + F.col("a") - F.col("at"), F.col("k") + F.col("b") - F.col("place"))
    met = index.join(asked.join(sizes, "pivot"), ["pivot", "part"]).where((F.col("doc_id") != F.col("other")) & (F.col("c") != F.col("f")) & (most * (100 + t) >= need))
    return met.select(F.least("doc_id", "other").alias("u"), F.greatest("doc_id", "other").alias("v")).distinct()


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", width: int = 5, threshold: int = THRESHOLD) -> DataFrame:
    """One row per document: doc_id, n_shingles, component_id, kept.

    Sets hold the distinct shingles of `width` lower-cased words, or the whole sequence where it is shorter; documents
    with a Jaccard similarity of `threshold` percent or more are linked, and component_id is the smallest id reachable.
    A null or empty text has an empty set and is linked with nothing; long texts are read whole. Rows without an id are
    left out; rows that share an id are one document, the one that `one_row_per_id` names, and
    are returned once each. Ids are long integers; other
    columns are ignored.
    """
    docs = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text")).where("doc_id is not null")
    rows, docs = docs, one_row_per_id(docs)
    signed = stage(signatures(docs, width), 8 * SET_ROWS)
    classes = stage(signed.where("n > 0").groupBy("n", "f1", "f2").agg(F.min("doc_id").alias("class_id")))
    own = stage(signed.select("doc_id", "n", "f1", "f2").join(classes, ["n", "f1", "f2"], "left").select("doc_id", "n", F.coalesce("class_id", "doc_id").alias("class_id")))
    heads = signed.where("n > 0").join(classes.select(F.col("class_id").alias("doc_id")), "doc_id", "left_semi")
    keys = heads.select(F.explode("bands").alias("key"), "doc_id", "n")
    shared = keys.groupBy("key").agg(F.count("*").alias("members")).where("members > 1")
    met = stage(keys.join(shared, "key"))
    drawn = met.groupBy("doc_id").agg(F.sum("members").alias("pull"))
    buckets = stage(met.drop("members").join(drawn, "doc_id"))
    sets = stage(_packed(docs, width, sieve(buckets.select("doc_id").distinct())), 4 * SET_ROWS)
    similar = (F.col("n") * 100 >= F.col("m") * threshold) & (F.col("m") * 100 >= F.col("n") * threshold)
    pair = [F.least("doc_id", "other").alias("u"), F.greatest("doc_id", "other").alias("v")]
    tested, links, of, done = None, None, None, [signed, classes, met, buckets, sets]

    def kept_for_now(df: DataFrame, batch_rows: int | None = None) -> DataFrame:
        done.append(stage(df, batch_rows))
        return done[-1]

    def apart() -> DataFrame:
        """Members of the buckets that hold more than one component, with their component c and the bucket's extremes."""
        known = buckets.withColumn("c", F.col("doc_id"))
        if of is not None:
            known = buckets.join(of.select(F.col("u").alias("doc_id"), "component"), "doc_id", "left")
            known = known.withColumn("c", F.coalesce("component", "doc_id")).drop("component")
        return kept_for_now(known.join(known.groupBy("key").agg(F.min("c").alias("lo"), F.max("c").alias("hi")).where("lo <> hi"), "key"))

    def add(pairs: DataFrame, found: DataFrame | None = None) -> None:
        """Confirm pairs not yet tested; their links, and those already found, join components."""
        nonlocal tested, links, of
        pairs = kept_for_now(pairs if tested is None else pairs.join(tested, ["u", "v"], "left_anti"))
        made = [x for x in (found, None if pairs.isEmpty() else kept_for_now(_confirm(pairs, sets, threshold), SET_ROWS)) if x is not None]
        tested = pairs if tested is None else tested.unionByName(pairs)
        for x in made:
            links = x if links is None else links.unionByName(x)
        if made:
            of = stage(components(links))

    for whose in (None, "hi"):
        left = apart()
        own_part = left if whose is None else left.where(F.col("c") == F.col(whose))
        best = own_part.groupBy("key").agg(F.max_by(F.struct("doc_id", "n", "c"), F.struct("pull", F.bitwise_not("doc_id"))).alias("best"))
        found = left.join(best, "key").select("doc_id", "n", "c", F.col("best.doc_id").alias("other"), F.col("best.n").alias("m"), F.col("best.c").alias("d"))
        add(found.where(similar & (F.col("c") != F.col("d"))).select(*pair).distinct())
    left = apart()
    pivots = left.groupBy("key", "c").agg(F.count("*").alias("size")).groupBy("key").agg(F.max_by("c", F.struct("size", F.bitwise_not("c"))).alias("e"))
    if links is None:
        pivots = pivots.withColumn("pivot", F.col("e"))
    else:
        ends = links.select(F.explode(F.array("u", "v")).alias("doc_id")).groupBy("doc_id").agg(F.count("*").alias("links"))
        centres = ends.join(of.select(F.col("u").alias("doc_id"), F.col("component").alias("e")), "doc_id").groupBy("e").agg(F.max_by("doc_id", F.struct("links", F.bitwise_not("doc_id"))).alias("pivot"))
        pivots = pivots.join(centres, "e", "left").select("key", "e", F.coalesce("pivot", "e").alias("pivot"))
    asked = kept_for_now(left.join(pivots, "key").where("doc_id <> pivot").select(F.col("doc_id").alias("u"), F.col("pivot").alias("v"), "c", "e").distinct())
    if not asked.isEmpty():
        against = kept_for_now(_differences(asked, sets, threshold), SET_ROWS)
        straight = against.where("similar").select(F.least("u", "v").alias("u"), F.greatest("u", "v").alias("v"))
        add(_sharing(against, threshold), straight)
    if of is None:
        of = own.limit(0).select(F.col("doc_id").alias("u"), F.col("doc_id").alias("component"))
    drop_stage(*done)
    found = own.join(of.withColumnRenamed("u", "class_id"), "class_id", "left")
    root = F.coalesce("component", "class_id")
    return for_each_row(rows, docs, found.select("doc_id", F.col("n").alias("n_shingles"), root.alias("component_id"), (F.col("doc_id") == root).alias("kept")))


def drop_near_copies(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", width: int = 5, threshold: int = THRESHOLD) -> DataFrame:
    """One document of each group stays, with its own columns."""
    return without(docs, near_duplicates(docs, id_col, text_col, width, threshold).where(~F.col("kept")).select("doc_id"), id_col)


def op4_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(table(spark, sf_dir, "documents"), width=2)


OP4_SQL = r"""
WITH RECURSIVE d AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS w FROM documents
), s AS (
  SELECT DISTINCT doc_id, array_to_string(w[i:i + 1], ' ') AS s
  FROM (SELECT doc_id, w, unnest(range(1, greatest(len(w) - 1, 1) + 1)) AS i FROM d WHERE len(w) > 0) q
), n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id),
p AS (
  SELECT a.doc_id AS u, b.doc_id AS v, count(*) AS c FROM s a JOIN s b ON a.s = b.s AND a.doc_id <> b.doc_id GROUP BY a.doc_id, b.doc_id
), e AS (
  SELECT u, v FROM p JOIN n a ON u = a.doc_id JOIN n b ON v = b.doc_id WHERE 100 * c >= 80 * (a.n + b.n - c)
), r(doc_id, root) AS (
  SELECT doc_id, doc_id FROM d
  UNION
  SELECT e.v, r.root FROM r JOIN e ON e.u = r.doc_id
), k AS (SELECT doc_id, min(root) AS component_id FROM r GROUP BY doc_id)
SELECT doc_id, coalesce(n.n, 0) AS n_shingles, component_id, doc_id = component_id AS kept FROM k LEFT JOIN n USING (doc_id)
"""
