"""The chunker's plan and its table function on random blocks."""

from __future__ import annotations

import random

import pytest
from pyspark.sql import functions as F

from docspark.operators import chunker, chunks

BLOCK = "pos int, text string, label string, level int, page_num int, box string"


def some_blocks(rng, n):
    rows = []
    for pos in range(n):
        kind = rng.random()
        words = " ".join(rng.choice("abcdef") * rng.randrange(1, 5) for _ in range(rng.choice([0, 1, 3, 8, 20, 45])))
        label = "section_header" if kind < 0.25 else rng.choice(["text", "text", "list_item", "caption", "footnote"])
        rows.append((pos, rng.choice(["A", "B"]) if label == "section_header" else rng.choice([words, words, f" {words} "]), label, rng.randrange(1, 4) if label == "section_header" else None, rng.choice([None, 1, 2, 3]), rng.choice([None, f"[{pos}]"])))
    return rows


def rows_of(df):
    return sorted((r.doc_id, r.chunk, list(r.headings), r.text, r.tokens, r.page_num, list(r.item_types), list(r.boxes)) for r in df.collect())


@pytest.mark.parametrize(("most", "least"), [(20, 0), (20, 40), (1, 5)])
def test_plan_and_table_function_agree(spark, most, least):
    rng = random.Random(most + least)
    docs = [(f"d{k}", some_blocks(rng, rng.randrange(0, 30))) for k in range(25)] + [("none", None), ("blank", [(0, None, "text", None, 1, None), (1, " ", "text", None, 1, None)])]
    df = spark.createDataFrame(docs, f"doc_id string, blocks array<struct<{BLOCK.replace(' ', ':', 1).replace(', ', ',').replace(' ', ':')}>>")
    blocks = df.select("doc_id", F.inline("blocks"))
    plan, function = rows_of(chunker.chunk_blocks(blocks.repartition(5), most, least)), rows_of(chunker.chunk_documents(df, most, least))
    assert plan == function and len(plan) > 50
    assert all(tokens <= most for _, _, _, _, tokens, *_ in plan)
    if not least:  # nothing is lost
        want = sorted(w for _, bs in docs for b in bs or [] if b[2] != "section_header" for w in (b[1] or "").split())
        assert sorted(w for row in plan for w in row[3].split()) == want


def test_headings_close_deeper_ones(spark):
    h = lambda pos, level, text: ("d", pos, text, "section_header", level, 1, None)
    rows = [("d", 0, "before", "text", None, 1, None), h(1, 1, "A"), h(2, 2, "B"), ("d", 3, "in b", "text", None, 2, "x"), h(4, 3, "C"), ("d", 5, "in c", "text", None, 2, None), h(6, 2, "D"), ("d", 7, "in d", "text", None, 3, None), h(8, 1, "E"), ("d", 9, "in e", "text", None, 4, None)]
    df = spark.createDataFrame(rows, f"doc_id string, {BLOCK}")
    got = chunker.chunk_blocks(df, 50, 0).orderBy("chunk").collect()
    assert [(r.headings, r.text) for r in got] == [([], "before"), (["A", "B"], "in b"), (["A", "B", "C"], "in c"), (["A", "D"], "in d"), (["E"], "in e")]
    assert chunker.chunk_blocks(df.limit(0), 50).count() == 0


def test_long_chunks_are_cut_or_stop(spark):
    df = spark.createDataFrame([("a", "one two three"), ("b", " "), ("c", None), ("d", "x" * 13), ("e", "one  two")], "chunk_id string, text string")
    texts = lambda got: {r.chunk_id: r.text for r in got.collect()}
    assert texts(chunks.limit_tokens(df, 2)) == {"a": "one two", "d": "x" * 13, "e": "one  two"}
    assert texts(chunks.limit_tokens(df, 2, words=False)) == {"a": "one two ", "d": "x" * 8, "e": "one  two"}
    with pytest.raises(ValueError, match="2 tokens: a$"):
        chunks.limit_tokens(df, 2, "stop")
    assert chunks.limit_tokens(df, 3, "stop").count() == 3
    with pytest.raises(ValueError, match="2 tokens: a, d$"):
        chunks.limit_tokens(df, 2, "stop", words=False)
