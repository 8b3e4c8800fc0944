"""Deduplication operators against brute force on small, awkward tables."""

from __future__ import annotations

import hashlib
import random
import re
from collections import defaultdict

import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from docspark.llm import decontaminate, exact_dedup, near_dedup, queries, substring_dedup, suffix_dedup
from docspark.llm.bytewise import fingerprints
from docspark.llm.components import components
from tests.comparing import database, same

SCHEMA = "doc_id long, text string, lang string, id int, n long"
WS = r"[^\x20\x09-\x0D]+"


def fold(text):
    return re.sub("[A-Z]", lambda m: m[0].lower(), text or "")


def table(spark, texts):
    return spark.createDataFrame([(i, t, None, 1, 2) for i, t in texts], SCHEMA)


def prose(n, words=40, seed=0, vocabulary=500):
    r = random.Random(seed)
    return [" ".join(f"w{r.randrange(vocabulary)}" for _ in range(words)) for _ in range(n)]


def awkward(seed=1):
    """Nulls, blanks, copies, near copies, shared passages, a long text, other white space, capitals."""
    r = random.Random(seed)
    base = prose(12, 120, seed)
    texts = [None, "", " \t\n", "one", "One", "é ü", base[0], base[0], base[0].replace(" ", "  "), base[0].upper()]
    for k in range(10):
        w = base[1].split()
        for _ in range(k):
            w[r.randrange(len(w))] = f"x{r.randrange(99)}"
        texts.append(" ".join(w))
    passage = " ".join(prose(1, 60, 99)[0].split())
    texts += [base[i] + "\n" + passage + " " + base[i + 1][:50] for i in range(2, 6)]
    texts += [" ".join(base) + " " + " ".join(base[:2]), "a b " * 60, base[7]]
    r.shuffle(texts)
    return list(enumerate(texts, 5))


@pytest.fixture(scope="module")
def con(sf):
    return database(sf)


@pytest.mark.parametrize("name", sorted(queries.SQL))
def test_query_equals_oracle(spark, sf, con, name):
    same(queries.QUERIES[name](spark, sf), con, queries.SQL[name])


def brute_exact(texts):
    groups = defaultdict(list)
    for i, t in texts:
        groups[re.sub(r"[\x20\x09-\x0D]", "", t or "")].append((-len(t or ""), i))
    out = {}
    for content, rows in groups.items():
        for _, i in rows:
            out[i] = (min(rows)[1], len(rows), i == min(rows)[1], hashlib.sha256(content.encode()).hexdigest())
    return out


@pytest.mark.parametrize("digest", [exact_dedup.sha256, lambda c: F.substring(F.sha2(c, 256), 1, 1)], ids=["sha256", "clashing"])
def test_exact_groups(spark, digest):
    texts = awkward()
    got = {r.doc_id: (r.keep_id, r.group_size, r.kept, r.text_sha256) for r in exact_dedup.exact_groups(table(spark, texts), digest=digest).collect()}
    assert got == brute_exact(texts)


def test_exact_copies_leave_with_their_columns(spark):
    docs = table(spark, [(1, "a b"), (2, "ab"), (None, "c"), (3, "c"), (4, None)])
    kept = exact_dedup.drop_exact_copies(docs)
    assert kept.columns == docs.columns
    assert sorted(r.doc_id or -1 for r in kept.collect()) == [-1, 1, 3, 4]  # a row without an id is never matched


def brute_near(texts, width, threshold=80):
    sets = {}
    for i, t in texts:
        w = re.findall(WS, fold(t))
        sets[i] = {tuple(w[k : k + width]) for k in range(max(len(w) - width + 1, 1))} if w else set()
    root = {i: i for i in sets}

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    ids = sorted(sets)
    for a in ids:
        for b in ids:
            if a < b and sets[a] and 100 * len(sets[a] & sets[b]) >= threshold * len(sets[a] | sets[b]):
                x, y = sorted((find(a), find(b)))
                root[y] = x
    return {i: (len(sets[i]), find(i), find(i) == i) for i in sets}


@pytest.mark.parametrize("width", [2, 5])
def test_near_duplicates(spark, width):
    texts = awkward(3)
    got = {r.doc_id: (r.n_shingles, r.component_id, r.kept) for r in near_dedup.near_duplicates(table(spark, texts), width=width).collect()}
    assert got == brute_near(texts, width)


def test_near_duplicates_join_through_others(spark):
    """A chain: neighbours are similar, the ends are not, and the smallest id is at neither the start nor a hub."""
    w = prose(1, 200, 5, 10**6)[0].split()
    texts = []
    for k in range(12):
        texts.append((100 - 7 * k if k % 2 else 3 + k, " ".join(w)))
        w = w[8:] + prose(1, 8, 50 + k, 10**6)[0].split()
    got = {r.doc_id: (r.n_shingles, r.component_id, r.kept) for r in near_dedup.near_duplicates(table(spark, texts), width=2).collect()}
    assert got == brute_near(texts, 2)


def test_near_duplicates_of_an_empty_table_and_rows_without_ids(spark):
    assert near_dedup.near_duplicates(table(spark, [(None, "a b c")]).limit(0)).count() == 0
    got = near_dedup.near_duplicates(table(spark, [(None, "a b c"), (2, "a b c"), (2, "a b c")])).collect()
    assert [(r.doc_id, r.component_id) for r in got] == [(2, 2), (2, 2)]


def test_words_that_fool_polynomial_sums_are_told_apart(spark):
    """A Thue-Morse word and its complement have equal sums of letters times powers modulo 2^64."""
    bits = [bin(i).count("1") % 2 for i in range(1024)]
    one, two = ("".join("ab"[b ^ flip] for b in bits) for flip in (0, 1))
    texts = [(1, f"{one} {one}x {one}y"), (2, f"{two} {two}x {two}y")]
    got = {r.doc_id: r.component_id for r in near_dedup.near_duplicates(table(spark, texts), width=2).collect()}
    assert got == {1: 1, 2: 2}


def test_a_large_group_around_a_base_is_compared_by_differences(spark):
    """Members lie around the threshold from their base and below it from each other; some are linked by shared changes
    alone, which only the last stage can find."""
    r = random.Random(21)
    base = [f"b{i}" for i in range(80)]
    texts = [(500, " ".join(base))]
    for k in range(150):
        w = list(base)
        for i in r.sample(range(80), r.choice([3, 5, 8, 9, 10])):
            w[i] = f"v{k}_{i}"
        texts.append((k, " ".join(w)))
    far = list(base)
    for i in r.sample(range(80), 12):
        far[i] = f"far{i}"
    for k in range(6):
        w = list(far)
        w[k] = f"own{k}"
        texts.append((200 + k, " ".join(w)))
    got = {x.doc_id: (x.n_shingles, x.component_id, x.kept) for x in near_dedup.near_duplicates(table(spark, texts), width=2).collect()}
    assert got == brute_near(texts, 2)


def test_large_groups_of_copies_meet_broadcast_winners(spark, monkeypatch):
    texts = [(i, "hot copy") for i in range(60)] + [(100 + i, f"text {i // 2}") for i in range(20)]
    for large in (10_000, 2):
        monkeypatch.setattr(exact_dedup, "LARGE", large)
        got = {r.doc_id: (r.keep_id, r.group_size, r.kept, r.text_sha256) for r in exact_dedup.exact_groups(table(spark, texts)).collect()}
        assert got == brute_exact(texts)


def test_rows_that_share_an_id_are_one_document(spark):
    texts = [(1, "zz " * 60), (1, "aa " * 60), (2, "aa " * 60), (3, "zz " * 60)]
    first = min(("zz " * 60, "aa " * 60), key=lambda t: hashlib.sha256(t.encode()).hexdigest())
    single = [(1, first), *texts[2:]]
    for f, brute in ((lambda t: near_dedup.near_duplicates(t, width=2), lambda x: brute_near(x, 2)), (suffix_dedup.suffix_digest, lambda x: brute_bytes(x, 100)), (substring_dedup.substring_digest, brute_words)):
        got = [(r.doc_id, tuple(r)[1:]) for r in f(table(spark, texts)).collect()]
        want = brute(single)
        assert sorted(got) == sorted([(i, want[i]) for i in (1, 1, 2, 3)])


def test_staging_refuses_local_folders_on_a_cluster(spark, monkeypatch):
    from docspark.llm import staging

    class Context:
        master = "spark://host:7077"

        def getConf(self):
            return {}

    class Session:
        sparkContext = Context()
        conf = {}

    with pytest.raises(ValueError, match="checkpoint"):
        staging.shared_dir(Session())


def test_suffixes_are_sorted_by_content():
    import numpy as np

    r = random.Random(1)
    for _ in range(60):
        window, letters = r.choice([24, 57, 100]), r.choice([b"ab", b"abcdefgh", b"a"])
        base = bytes(r.choice(letters) for _ in range(r.randrange(window, 300)))
        data = base + b"".join(base[i : i + r.randrange(1, 150)] for i in (r.randrange(len(base)) for _ in range(5))) + base
        at = np.arange(len(data) - window + 1)
        seen, want = set(), []
        for i in at:
            want.append(data[i : i + window] in seen)
            seen.add(data[i : i + window])
        assert suffix_dedup.repeated(np.frombuffer(data, np.uint8), at, window).tolist() == want
    assert {(a - b) % suffix_dedup.TIES for a in suffix_dedup.TIE_COVER for b in suffix_dedup.TIE_COVER} == set(range(suffix_dedup.TIES))


def test_components_of_paths_and_stars(spark):
    r = random.Random(4)
    edges = [(r.randrange(60), r.randrange(60)) for _ in range(45)] + [(7, 7)]
    root = {x: x for e in edges for x in e}

    def find(i):
        return i if root[i] == i else find(root[i])

    for a, b in edges:
        x, y = sorted((find(a), find(b)))
        root[y] = x
    got = {r.u: r.component for r in components(spark.createDataFrame(edges, "u long, v long")).collect()}
    assert all(got.get(i, i) == find(i) for i in root)


def brute_contained(docs, items, width=5, threshold=80):
    def parts(t):
        w = re.findall(WS, fold(t))
        return {tuple(w[k : k + width]) for k in range(max(len(w) - width + 1, 1))} if w else set()

    have, want = {i: parts(t) for i, t in docs}, {i: parts(t) for i, t in items}
    return {(d, i, len(q), len(q & h)) for d, h in have.items() for i, q in want.items() if q and 100 * len(q & h) >= threshold * len(q)}


def test_items_are_found_inside_long_documents(spark):
    items = list(enumerate([*prose(6, 30, 8), "two words", "TWO words", "", None, *prose(2, 6, 9)]))
    docs = awkward(2)
    for k, (_, text) in enumerate(items[:6]):
        w = text.split()
        w[3 * k % len(w)] = "changed"
        docs.append((900 + k, prose(1, 300, 70 + k)[0] + " " + " ".join(w).upper() + "\n" + prose(1, 200, 80 + k)[0]))
    docs += [(990, "two  words"), (991, "two words more")]
    it = spark.createDataFrame(items, "item_id int, text string")
    got = {tuple(r) for r in decontaminate.contaminated(table(spark, docs), it).collect()}
    assert got == brute_contained(docs, items)
    assert got
    dropped = {d for d, *_ in got}
    assert {r.doc_id for r in decontaminate.drop_contaminated(table(spark, docs), it).collect()} == {i for i, _ in docs} - dropped


def test_containment_without_broadcasts(spark, monkeypatch):
    items = list(enumerate(prose(5, 30, 8)))
    docs = [(k, prose(1, 100, k)[0] + " " + t) for k, t in items]
    it = spark.createDataFrame(items, "item_id int, text string")
    monkeypatch.setattr(decontaminate, "BROADCAST_ROWS", -1)
    assert {tuple(r) for r in decontaminate.contaminated(table(spark, docs), it).collect()} == brute_contained(docs, items)


def brute_bytes(texts, window):
    seen, out = set(), {}
    for i, t in sorted(texts):
        b = (t or "").encode()
        gone = bytearray(len(b))
        for s in range(len(b) - window + 1):
            w = b[s : s + window]
            if w in seen:
                gone[s : s + window] = b"\1" * window
            seen.add(w)
        spans = sum(1 for j in range(len(b)) if gone[j] and (j == 0 or not gone[j - 1]))
        out[i] = (len(b), sum(gone), spans, hashlib.sha256(bytes(x for x, g in zip(b, gone, strict=True) if not g)).hexdigest())
    return out


@pytest.mark.parametrize("piece", [1 << 20, 700], ids=["whole", "small pieces"])
def test_repeated_bytes(spark, piece, monkeypatch):
    texts = awkward(6) + [(80, "é" * 300), (81, "zé" * 200 + "q"), (82, "x" * 99), (83, "x" * 100)]
    if piece < 1000:
        for name in ("PIECE", "CUT_BYTES", "BLOCK_BYTES"):
            monkeypatch.setattr(suffix_dedup, name, piece)
    got = {r.doc_id: tuple(r)[1:] for r in suffix_dedup.suffix_digest(table(spark, texts).repartition(3)).collect()}
    assert got == brute_bytes(texts, 100)


def test_repeated_bytes_of_the_documents(spark, sf):
    rows = spark.read.parquet(f"{sf}/documents.parquet").collect()
    got = {r.doc_id: tuple(r)[1:] for r in suffix_dedup.op8_suffix_dedup(spark, sf).collect()}
    assert got == brute_bytes([(r.doc_id, r.text) for r in rows], 100)


def test_difference_cover_is_one():
    assert {(a - b) % suffix_dedup.PERIOD for a in suffix_dedup.COVER for b in suffix_dedup.COVER} == set(range(suffix_dedup.PERIOD))


def brute_words(texts, window=50):
    first = {}
    split = {i: (t or "").encode().split() for i, t in texts}
    for i, w in split.items():
        for s in range(len(w) - window + 1):
            k = tuple(w[s : s + window])
            first[k] = min(first.get(k, i), i)
    out = {}
    for i, w in split.items():
        gone = [False] * len(w)
        for s in range(len(w) - window + 1):
            if first[tuple(w[s : s + window])] < i:
                gone[s : s + window] = [True] * window
        out[i] = (len(w), sum(gone), hashlib.sha256(b" ".join(x for x, g in zip(w, gone, strict=True) if not g)).hexdigest())
    return out


@pytest.mark.parametrize("piece", [2 << 20, 700], ids=["whole", "small pieces"])
def test_repeated_words(spark, piece, monkeypatch):
    texts = awkward(7)
    monkeypatch.setattr(substring_dedup, "CUT_BYTES", piece)
    monkeypatch.setattr(substring_dedup, "BLOCK_BYTES", piece)
    got = {r.doc_id: tuple(r)[1:] for r in substring_dedup.substring_digest(table(spark, texts).repartition(3)).collect()}
    assert got == brute_words(texts)


def covered(texts, window=50):
    """Words covered by repeated windows, by document, of the operator's own functions in one process."""
    batch = pa.record_batch([pa.array([i for i, _ in texts], pa.int64()), pa.array([t for _, t in texts])], names=["doc_id", "text"])
    rows = pa.Table.from_batches(list(substring_dedup.cut(window, 4)([batch]))).sort_by("minimiser")
    out = defaultdict(set)
    for found in substring_dedup._count(window)(rows.to_batches(max_chunksize=7)):
        for i, a, b in zip(*(found[c].to_pylist() for c in ("doc_id", "first", "last")), strict=True):
            out[i].update(range(a, b))
    return {i: len(x) for i, x in out.items() if x}


def test_buckets_of_one_document_are_not_compared(monkeypatch):
    """Before, the words of all super-k-mers were told apart, though most buckets hold one document alone."""
    r, seen, windows = random.Random(3), [], substring_dedup._windows
    texts = [(i, " ".join(f"w{r.randrange(10**6)}" for _ in range(300))) for i in range(20)]
    passage = " ".join(texts[4][1].split()[100:180])
    texts.append((50, f"before it {passage} and after"))
    monkeypatch.setattr(substring_dedup, "CUT_BYTES", 3000)
    monkeypatch.setattr(substring_dedup, "_windows", lambda p, *a: seen.append(len(p)) or windows(p, *a))
    assert covered(texts) == {50: 80}
    counted = sum(seen) - len(texts)
    assert counted < 40


@pytest.mark.parametrize("block", [1, 500, 4 << 20])
def test_repeated_words_in_blocks_of_any_size(monkeypatch, block):
    r = random.Random(block)
    monkeypatch.setattr(substring_dedup, "CUT_BYTES", 400)
    monkeypatch.setattr(substring_dedup, "BLOCK_BYTES", block)
    for _ in range(25):
        base = [r.choice("abcd") for _ in range(60)]
        texts = [(i, r.choice([" ", "\n "]).join(base[r.randrange(20) : r.randrange(40, 60)] + [r.choice("abé") for _ in range(r.randrange(9))])) for i in range(14)]
        want = {i: n for i, (_, n, _) in brute_words(texts, 8).items() if n}
        assert covered(texts, 8) == want


def test_fingerprints_of_words_follow_their_bytes_alone():
    words = [f"{k}".encode() * (1 + k % 3) for k in range(30000)] + [b"a", b"aa", b"x" * (3 << 20), b"\0", b"\0\0", b""]
    got = fingerprints(pa.array(words, pa.large_binary()))
    assert (got[5:] == fingerprints(pa.array(words[5:], pa.large_binary()))).all()
    assert (got[::-1] == fingerprints(pa.array(words[::-1], pa.large_binary()))).all() and len(set(got.tolist())) == len(set(words))


def test_empty_tables(spark):
    none = table(spark, [(1, "a")]).limit(0)
    for f in (exact_dedup.exact_groups, suffix_dedup.suffix_digest, substring_dedup.substring_digest):
        assert f(none).count() == 0
