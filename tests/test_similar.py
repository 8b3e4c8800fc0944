"""Similar chunks against all pairs."""

from __future__ import annotations

import random
from pathlib import Path

import pytest

from docspark.operators import similar
from docspark.sources import shared


def plain_set(text, width):
    words = (text or "").lower().split()
    return frozenset(" ".join(words[i : i + width]) for i in range(max(1, len(words) - width + 1))) if words else frozenset()


def plain_pairs(rows, width, percent):
    sets = {i: plain_set(t, width) for i, t in rows}
    head = {}
    for i in sorted(sets):
        head.setdefault(sets[i], i)
    heads = sorted(i for s, i in head.items() if s)
    pairs = []
    for a, u in enumerate(heads):
        for v in heads[a + 1 :]:
            shared, total = len(sets[u] & sets[v]), len(sets[u] | sets[v])
            if shared * 100 >= total * percent:
                pairs.append((u, v, shared, total))
    return sorted(pairs), sorted((i, head[s] if s else i, len(s)) for i, s in sets.items())


def edited(rng, words):
    words = list(words)
    for _ in range(rng.randrange(3)):
        words[rng.randrange(len(words))] = rng.choice("abcdefgh")
    return words


@pytest.mark.parametrize(("width", "percent", "block"), [(5, 80, 1000), (5, 80, 3), (2, 50, 4), (1, 90, 2)])
def test_pairs_equal_all_pairs(spark, width, percent, block):
    rng = random.Random(width + percent)
    rows, base = [], [[rng.choice("abcdefgh") + str(rng.randrange(9)) for _ in range(rng.randrange(3, 60))] for _ in range(6)]
    for i in range(160):
        rows.append((f"c{i}", " ".join(edited(rng, rng.choice(base)))))
    rows += [("x1", None), ("x2", ""), ("x3", " \t "), ("x4", "one two"), ("x5", "One  TWO"), ("x6", "one"), ("x7", "one two three")]
    df = spark.createDataFrame(rows, "chunk_id string, text string")
    pairs, classes = plain_pairs(rows, width, percent)
    assert sorted(map(tuple, similar.near_duplicate_chunks(df, width, percent, block).collect())) == pairs and len(pairs) > 20
    assert sorted(map(tuple, similar.equal_sets(df, width).collect())) == classes


def test_an_empty_table_has_no_pairs(spark):
    df = spark.createDataFrame([], "chunk_id string, text string")
    assert similar.near_duplicate_chunks(df).collect() == [] and similar.equal_sets(df).collect() == []


def test_texts_are_cut_into_shingles_once(spark):
    """Once for the classes, and in the search once more for heads that meet another."""
    read = spark.sparkContext.accumulator(0)

    def seen(batches):
        for batch in batches:
            read.add(len(batch))
            yield batch

    rows = [(f"c{i:02}", f"w{i} x{i} y{i} z{i} a{i} b{i} c{i}") for i in range(30)] + [("d1", "a b c d e f g h i j k l"), ("d2", "a b c d e f g h i j k l m")]
    df = spark.createDataFrame(rows, "chunk_id string, text string").mapInArrow(seen, "chunk_id string, text string")
    assert len(similar.equal_sets(df).collect()) == 32 and read.value == 32
    read.value = 0
    assert [tuple(r) for r in similar.near_duplicate_chunks(df).collect()] == [("d1", "d2", 8, 9)]
    assert read.value <= 2 * 32


def test_shingles_of_many_texts_come_last(spark):
    """Enough texts share a phrase for its slots to stand out, and some are near copies within it."""
    rng = random.Random(5)
    phrase = [f"s{i}" for i in range(24)]
    rows = [(f"h{i}", " ".join(edited(rng, phrase) + [f"u{i}"] * (i % 2) + [f"w{i}x{k}" for k in range(i % 9)])) for i in range(240)]
    df = spark.createDataFrame(rows, "chunk_id string, text string")
    assert similar._ranks(similar._keyed(df, 5)).any()
    pairs, _ = plain_pairs(rows, 5, 80)
    assert sorted(map(tuple, similar.near_duplicate_chunks(df, block=20).collect())) == pairs and len(pairs) > 400


def test_repeated_ids(spark):
    """A row that comes twice has its pairs twice; of two texts under one id each is a set of its own."""
    words = [f"w{i}" for i in range(30)]
    other = [f"o{i}" for i in range(40)]
    rows = [("a", " ".join(words)), ("a", " ".join(words)), ("a", " ".join(other)), ("b", " ".join(words[:-1])), ("c", " ".join(other[1:])), (None, " ".join(words[1:])), (None, " ".join(words))]
    df = spark.createDataFrame(rows, "chunk_id string, text string")
    assert sorted(map(tuple, similar.near_duplicate_chunks(df).collect())) == [("a", "b", 25, 26)] * 2 + [("a", "c", 35, 36)]


def test_disk_follows_prefixes_not_shingles(spark, tmp_path, monkeypatch):
    """Staged tables and shuffle files at each step, against the number of shingles: all of them are staged once, and deleted;
    only a fifth is sent."""
    local = [str(x) for x in spark.sparkContext._jvm.org.apache.spark.SparkEnv.get().blockManager().diskBlockManager().localDirs()]
    files = lambda *tops: {p: p.stat().st_size for top in tops for p in Path(top).rglob("*") if p.is_file()}
    used = lambda: sum(files(tmp_path).values()) + sum(size for p, size in files(*local).items() if p.suffix == ".data" and p not in before)
    took, staged = [], similar.staged
    monkeypatch.setattr(shared, "shared_folder", lambda spark: str(tmp_path))
    monkeypatch.setattr(similar, "staged", lambda df: (staged(df), took.append(used()))[0])
    rng = random.Random(1)
    rows = [(f"c{i}", " ".join(f"{rng.randrange(10**9):x}" for _ in range(104))) for i in range(4000)]
    rows += [(f"d{i}", rows[i][1] + " more") for i in range(20)]
    before, shingles = files(*local), 100 * 4020
    got = similar.near_duplicate_chunks(spark.createDataFrame(rows, "chunk_id string, text string")).collect()
    assert sorted(map(tuple, got)) == sorted((f"c{i}", f"d{i}", 100, 101) for i in range(20))
    assert max(took) < 20 * shingles and used() < 10 * shingles
