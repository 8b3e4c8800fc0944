"""Quality, periodic runs and importance resampling against plain loops."""

from __future__ import annotations

import hashlib
import math
import random
import re
from zlib import crc32

import numpy as np
import pytest

from docspark.llm import factor_machine, periodic_runs, resampling

DOCS = "doc_id long, text string, lang string, n_chars long, score double, at string, rank int"


def docs_of(spark, texts):
    return spark.createDataFrame([(i, t, None, None if t is None else len(t), 0.5, "x", 1) for i, t in texts], DOCS)


# periodic runs


def plain_runs(words):
    found = {}
    for q in range(1, len(words) // 4 + 1):
        i = 0
        while i + q < len(words):
            start = i
            while i + q < len(words) and words[i] == words[i + q]:
                i += 1
            if i > start and i + q - start >= max(6, 4 * q):
                found.setdefault((start, i + q), q)
            i += i == start
    return sorted((s, e - s, q) for (s, e), q in found.items())


def some_words(rng):
    kind, k = rng.randrange(4), rng.choice([1, 2, 3])
    if kind == 0:
        return [rng.randrange(k) for _ in range(rng.randrange(90))]
    if kind == 1:
        return [x for _ in range(rng.randrange(8)) for x in [rng.randrange(k) for _ in range(rng.randrange(1, 9))] * rng.randrange(1, 7)]
    if kind == 2:
        return (([rng.randrange(k) for _ in range(rng.randrange(1, 6))] * rng.randrange(1, 5) + [rng.randrange(3)] * rng.randrange(8)) * 6)[rng.randrange(5) :]
    inner = [0] * rng.randrange(1, 12) + [1] + [0] * rng.randrange(7)
    return ((inner * rng.randrange(1, 3) + [2]) * rng.randrange(3, 7))[rng.randrange(3) :]


@pytest.mark.parametrize("seed", range(4))
def test_runs_equal_a_plain_search(seed):
    rng = random.Random(seed)
    for _ in range(150):
        docs = [some_words(rng) for _ in range(rng.randrange(1, 7))]
        first = np.append(0, np.cumsum([len(d) for d in docs])).astype(np.int64)
        got = periodic_runs.find_runs(np.array([x for d in docs for x in d], np.int64), first)
        want = [(s + int(f), n, q) for d, f in zip(docs, first, strict=False) for s, n, q in plain_runs(d)]
        assert [tuple(r) for r in got.tolist()] == want


def test_a_long_nested_repeat():
    words = np.array(([0] * 300 + [1]) * 400, np.int64)
    got = periodic_runs.find_runs(words, np.array([0, len(words)]))
    assert len(got) == 401 and [0, len(words), 301] in got.tolist()


def test_successors_in_ranges():
    rng = np.random.default_rng(3)
    values = rng.permutation(1000)
    tree = periodic_runs.WaveletTree(values)
    low, value = rng.integers(0, 900, 300), rng.integers(0, 1300, 300)
    high = low + rng.integers(0, 100, 300)
    less = tree.below(low, high, value)
    for i in range(300):
        part = sorted(values[low[i] : high[i]])
        assert less[i] == sum(x < value[i] for x in part)
        if less[i] < len(part):
            assert tree.smallest(low[i : i + 1], high[i : i + 1], less[i : i + 1])[0] == part[less[i]]


def plain_digest(doc_id, text):
    words = re.findall(r"[^\x20\x09-\x0D]+", text or "")
    h, n = crc32(str(doc_id).encode()), len(words)
    g = h // 10
    if doc_id is not None and h % 10 == 0 and n:
        a = g % n
        p = 1 + (n - a) // (3 + g % 8)
        words = [words[i] if i < a else words[a + (i - a) % p] for i in range(n)]
    runs = plain_runs(words)
    out = {i for s, k, q in runs for i in range(s + q, s + k)}
    s, k, q = min(runs, key=lambda r: (-r[1], r[0], r[2]), default=(None, None, None))
    sha = lambda x: hashlib.sha256(x.encode()).hexdigest()
    return doc_id, len(runs), s, k, q, k if k is None else 1000 * k // q, sha("".join(f"{a},{b},{c}\n" for a, b, c in runs)), sha(" ".join(w for i, w in enumerate(words) if i not in out))


def test_digests_of_runs(spark, sf, tmp_path):
    rng = random.Random(9)
    texts = [(i, " ".join("ab cé d".split(" ")[x % 3] for x in some_words(rng))) for i in range(150)]
    texts += [(200, None), (201, ""), (202, " \n\t "), (203, "x " * 5), (204, "x " * 6), (204, "x " * 6), (None, "y z " * 9), (205, "long\x0bword word " * 40)]
    docs_of(spark, texts).write.parquet(str(tmp_path / "documents.parquet"))
    got = periodic_runs.op12_periodic_runs(spark, str(tmp_path)).collect()
    assert sorted(map(str, (tuple(r) for r in got))) == sorted(str(plain_digest(*t)) for t in texts)
    whole = spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "text").limit(25).collect()
    got = periodic_runs.op12_periodic_runs(spark, sf).where(f"doc_id in ({','.join(str(r.doc_id) for r in whole)})").collect()
    assert sorted(map(tuple, got)) == sorted(plain_digest(r.doc_id, r.text) for r in whole)


def test_runs_of_an_empty_table(spark):
    assert periodic_runs.collapse_runs(docs_of(spark, [])).collect() == []
    with pytest.raises(ValueError):
        periodic_runs.find_runs(np.zeros(9, np.int64), np.array([0, 9]), times=2)


# resampling

WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")


def plain_features(text, low, high, buckets):
    words = WORD.findall("".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or ""))
    return [crc32(" ".join(words[i : i + n]).encode()) % buckets for n in range(low, high + 1) for i in range(len(words) - n + 1)], len(words)


def plain_draw(docs, target, low=1, high=1, buckets=10000):
    own = [(i, *plain_features(t, low, high, buckets)) for i, t in docs]
    like = [b for t in target for b in plain_features(t, low, high, buckets)[0]]
    s, t = [0] * buckets, [0] * buckets
    for _, f, _ in own:
        for b in f:
            s[b] += 1
    for b in like:
        t[b] += 1
    gain = [math.floor(1000 * math.log((y + 1) * (sum(s) + buckets) / ((x + 1) * (len(like) + buckets)))) for x, y in zip(s, t, strict=True)]
    rows = []
    for i, f, n in own:
        weight, score = sum(gain[b] for b in f), None
        if i is not None:
            h = int(hashlib.sha256(f"2024:{i}".encode()).hexdigest()[:8], 16)
            score = weight + math.floor(-1000 * math.log(-math.log((h + 0.5) / 4294967296)))
        rows.append([i, len(f), weight, score, n])
    can = sorted((r for r in rows if r[4] >= 20 and r[0] is not None), key=lambda r: (-r[3], r[0]))
    for r in rows:
        r.append(None)
    for k, r in enumerate(can[: 10 * len(can) // 100], 1):
        r[5] = k
    return sorted(str(r[:4] + r[5:]) for r in rows)


def drawn_rows(got):
    return sorted(str([r.doc_id, r.n_features, r.weight, r.score, r["rank"]]) for r in got.collect())


def test_draw_equals_a_plain_one(spark, sf):
    read = lambda name: [tuple(r) for r in spark.read.parquet(f"{sf}/{name}.parquet").selectExpr("doc_id" if name == "documents" else "1", "text").collect()]
    want = plain_draw(read("documents"), [t for _, t in read("benchmark")])
    assert drawn_rows(resampling.op13_resampling(spark, sf)) == want
    assert sum("None" not in r for r in want) > 10


@pytest.mark.parametrize("grams", [(1, 1), (1, 3), (2, 2)])
def test_draw_of_odd_rows(spark, grams):
    texts = [(i, f"word{i % 7} CafÉé {'a-b ' * (i % 25)} x{i}") for i in range(90)]
    texts += [(100, None), (101, ""), (102, "--- \x00!"), (None, "no id " * 30), (103, "same " * 25), (103, "same " * 25), (104, "z " * 3000 + "q")]
    target = spark.createDataFrame([("word3 café a b",), (None,), ("",)], "text string")
    got = resampling.resample(docs_of(spark, texts), target, low=grams[0], high=grams[1])
    assert drawn_rows(got) == plain_draw(texts, ["word3 café a b"], *grams)


def test_draw_of_empty_tables(spark):
    none = spark.createDataFrame([], "text string")
    assert resampling.resample(docs_of(spark, []), none).collect() == []
    assert drawn_rows(resampling.resample(docs_of(spark, [(1, "a b")]), none)) == plain_draw([(1, "a b")], [])


# quality


def test_pairs_by_sums_of_squares():
    rng = np.random.default_rng(1)
    rows = factor_machine.sparse_rows([np.array([3, 5, 9]), np.array([], np.int64), np.array([5])], [np.array([1, 4, 2]), np.array([], np.int64), np.array([7])], rng.normal(size=(3, 2)))
    m = factor_machine.Machine(0.3, rng.normal(size=factor_machine.DIMS), rng.normal(size=(factor_machine.DIMS, 4)), rng.normal(size=2), rng.normal(size=(2, 4)), np.zeros(2), np.ones(2))
    got = m.margins(rows)[0]
    for r in range(3):
        a, b = rows.first[r : r + 2]
        x = [(rows.x[i], m.w[rows.at[i]], m.v[rows.at[i]]) for i in range(a, b)] + [(rows.dense[r, k], m.wd[k], m.vd[k]) for k in range(2)]
        want = m.w0 + sum(v * w for v, w, _ in x) + sum(x[i][0] * x[j][0] * (x[i][2] @ x[j][2]) for i in range(len(x)) for j in range(i))
        assert got[r] == pytest.approx(want)


def test_pairs_are_learned():
    """Good when exactly one of two words occurs: no sum of single weights tells."""
    rng = np.random.default_rng(2)
    at = [np.flatnonzero(rng.random(6) < 0.5) for _ in range(2000)]
    y = np.array([(0 in a) != (1 in a) for a in at], float)
    rows = factor_machine.sparse_rows(at, [np.ones(len(a)) for a in at], np.zeros((2000, 1)))
    m = factor_machine.fit(rows.take(np.arange(1500)), y[:1500], epochs=60)
    assert ((m.scores(rows.take(np.arange(1500, 2000))) > 0.5) == y[1500:]).mean() > 0.9


def test_quality_of_held_out_documents(spark):
    sf = "/root/testdata/sf0.01"
    got = factor_machine.op11_quality(spark, sf).join(spark.read.parquet(f"{sf}/labels.parquet"), "doc_id").collect()
    held = [r for r in got if r.held_out]
    assert all(r.held_out == (crc32(str(r.doc_id).encode()) % 5 == 0) and r.predicted == (r.score >= 0.3) for r in got)
    assert sum(r.predicted == r.quality for r in held) >= 0.95 * len(held) and len(held) > 50
    bad = [r.score for r in held if not r.quality]
    good = [r.score for r in held if r.quality]
    assert sum(b < g for b in bad for g in good) > 0.98 * len(bad) * len(good)


def test_quality_of_odd_rows(spark):
    texts = [(i, "The cat sat on the mat, and so it was." if i % 3 else "#### $$$$ !!!! ####") for i in range(1, 120)]
    texts += [(200, None), (201, ""), (None, "x"), (5, "second row of an id"), (202, "word " * 300_000)]
    labels = spark.createDataFrame([(i, int(i % 3 > 0), 0) for i in range(1, 100)] + [(None, 1, 0), (7, None, 1), (9, 1, 1)], "doc_id long, quality int, toxic int")
    got = factor_machine.quality(docs_of(spark, texts), labels, metadata=("n_chars",)).collect()
    assert len(got) == len(texts) and all(0 <= r.score <= 1 for r in got)
    assert all(r.predicted == int(r.doc_id % 3 > 0) for r in got if r.doc_id and 100 < r.doc_id < 120)
    assert [r.held_out for r in got if r.doc_id is None] == [None]


def test_quality_without_labels_or_rows(spark):
    none = spark.createDataFrame([], "doc_id long, quality int")
    assert [r.predicted for r in factor_machine.quality(docs_of(spark, [(1, "a"), (2, None)]), none).collect()] == [1, 1]
    assert factor_machine.quality(docs_of(spark, []), none).collect() == []
