"""Map-reduce summaries and taxonomy tags against plain loops."""

from __future__ import annotations

import json
import random

import pytest
from pyspark.sql import functions as F

from docspark.functions import models
from docspark.operators import summaries, texts


def sentences_of(rng, n):
    return " ".join(" ".join(rng.choice("abcde") * rng.randrange(1, 7) for _ in range(rng.randrange(6, 12))) + "." for _ in range(n))


def plain_parts(text, size, overlap):
    out, at = [], 0
    while True:
        out.append(text[at : at + size])
        if at + size >= len(text):
            return out
        at += size - overlap


def plain_summary(text, most, size, overlap, tell, many=200):
    """(summary, turns), or None where the parts are too many."""
    if len(text) <= size:
        return tell(text), 0
    for turn in range(4):
        parts = plain_parts(text, size, overlap)
        if len(parts) > many:
            return None
        text = "\n\n".join(tell(p) for p in parts)
        if len(text) <= most:
            return tell(text), turn
    return text, 4


@pytest.fixture
def half():
    """A model that leaves every second character."""
    models.register("half", lambda xs: [x[::2] for x in xs])
    yield lambda x: x[::2]
    del models.MODELS["half"]


def test_long_texts_are_reduced_in_turns(spark, half):
    rng = random.Random(3)
    texts = [sentences_of(rng, n) for n in (1, 3, 4, 12, 30, 60, 120, 400)]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id int, text string")
    got = {r.doc_id: r for r in summaries.summarise(df, window=700, reserve=100, overlap=80, model="half", final="half").collect()}
    seen = set()
    for i, text in enumerate(texts):
        summary, turns = plain_summary(text, 600, 500, 80, half)
        assert (got[i].summary, got[i].turns, got[i].method, got[i].status) == (summary, turns, "llm_summary", "summarized") or len(summary) < 50 and got[i].status == "summarize_failed"
        seen.add(turns)
    assert seen >= {0, 1, 2, 4}


def test_texts_of_too_many_parts_are_extracted_first(spark, half, monkeypatch):
    monkeypatch.setattr(summaries, "MOST_PARTS", 8)
    rng = random.Random(4)
    texts = [sentences_of(rng, 3), sentences_of(rng, 200), "word " * 3000, sentences_of(rng, 45), " ".join(sentences_of(rng, 1)[:-1] + " " + "x" * 900 + "." for _ in range(40))]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id int, text string")
    got = {r.doc_id: r for r in summaries.summarise(df, window=700, reserve=100, overlap=80, model="half", final="half").collect()}
    central = {r.doc_id: r.summary for r in summaries.extract(df).collect()}
    assert got[0].method == got[3].method == "llm_summary"
    assert got[1].method == "llm_on_centroid" and (got[1].summary, got[1].turns) == plain_summary(central[1], 600, 500, 80, half, 8)
    assert got[2].summary == plain_summary(central[2], 600, 500, 80, half, 8) if 2 in central and len(central[2]) < 3000 else True
    assert got[4].method == "centroid_only" and got[4].summary == central[4] and got[4].status == "summarized"
    assert len(got) == 5


def test_errors_and_odd_texts(spark):
    rows = [(1, None), (2, " \n "), (3, "Short."), (4, "<!-- gone\nall -->![x](y)```code\n```"), (5, "A sentence that is long enough to be kept as a summary."), (6, "|" * 4000)]
    df = spark.createDataFrame(rows, "doc_id int, text string")
    got = {r.doc_id: r for r in summaries.summarise(df, window=1100, reserve=100).collect()}
    assert [got[i].error for i in (1, 2, 4)] == ["no text"] * 3 and got[3].error == "response too short: 6 characters" and got[5].error is None
    assert got[5].summary == rows[4][1] and got[6].error == "no sentences" and {r.status for i, r in got.items() if i < 5} == {"summarize_failed"}
    assert summaries.summarise(df.limit(0)).count() == 0
    with pytest.raises(ValueError):
        summaries.summarise(df, window=900, reserve=100)


TAXONOMY = [("sdg", "document", 1, "s1", "No Poverty"), ("sdg", "document", 2, "s2", "Hunger"), ("sdg", "document", 3, "s3", None), ("area", "document", 1, "a", "Water"), ("part", "chunk", 1, "p", "water")]


def test_tags_are_the_ordered_union_of_parts(spark):
    tax = spark.createDataFrame(TAXONOMY, "taxonomy string, level string, ord int, code string, name string")
    text = "x" * 380 + " hunger\n\n" + "y" * 330 + " no poverty and hunger\n\n" + "z" * 350 + " water"
    docs = spark.createDataFrame([(1, text), (2, "Water"), (3, None), (4, ""), (5, "nothing")], "doc_id int, summary string")
    got = {(r.doc_id, r.taxonomy): r for r in summaries.tag_taxonomies(docs, tax, window=560, reserve=100, overhead=520).collect()}
    assert set(got) == {(1, "sdg"), (1, "area"), (2, "area")}
    assert got[1, "sdg"].tags == ["s2 - Hunger", "s1 - No Poverty"] and got[1, "area"].tags == ["a - Water"]
    assert [c.reason for c in got[1, "sdg"].codes] == ["the text names Hunger", "the text names No Poverty"]


def test_answers_of_a_model_are_read_with_care(spark):
    said = ['Sure:\n[{"code": "s3", "reason": null}, {"code": "zz"}, {"reason": "none"}, {"code": "s1", "reason": "b"}, {"code": "s1", "reason": "c"}]\nBye', "sorry", None, "[]", "[1, 2]"]
    models.register("fixed", lambda prompts: [said[json.loads(p)["text"].count("i") - 1] for p in prompts])
    try:
        tax = spark.createDataFrame(TAXONOMY[:3], "taxonomy string, level string, ord int, code string, name string")
        docs = spark.createDataFrame([(i, "i" * (i + 1)) for i in range(5)], "doc_id int, summary string")
        got = summaries.tag_taxonomies(docs, tax, model="fixed").collect()
        assert [(r.doc_id, r.tags) for r in got] == [(0, ["s3", "s1 - No Poverty"])]
        assert [c.reason for c in got[0].codes] == ["No reason provided", "b"]
    finally:
        del models.MODELS["fixed"]
    many = spark.range(summaries.TAXONOMY_ROWS + 1).selectExpr("'t' AS taxonomy", "'document' AS level", "CAST(id AS INT) AS ord", "CAST(id AS STRING) AS code", "'n' AS name")
    with pytest.raises(ValueError):
        summaries.tag_taxonomies(docs, many)


def test_selected_documents_are_renewed(spark):
    long_ = "This sentence has quite a few words in it. " * 6
    rows = [(1, long_, "x" * 400, "indexed"), (2, long_, "short", "parsed"), (3, long_, None, "indexed"), (4, "tiny", "y" * 400, "indexed"), (5, long_, "z" * 400, "stopped")]
    df = spark.createDataFrame(rows, "doc_id int, text string, summary string, sys_status string")
    got = {r.doc_id: r for r in summaries.renew_summaries(df, df["doc_id"] < 5).collect()}
    new = " ".join(["This sentence has quite a few words in it."] * 3)
    assert [(got[i].summary, got[i].renewed) for i in (1, 2, 3, 4, 5)] == [(new, True), ("short", False), (new, True), ("y" * 400, False), ("z" * 400, False)]
    assert [got[i].sys_status for i in (1, 2, 3, 4, 5)] == [r[3] for r in rows]


def test_tags_of_selected_documents_are_replaced(spark):
    tax = spark.createDataFrame(TAXONOMY, "taxonomy string, level string, ord int, code string, name string")
    docs = spark.createDataFrame([(1, "water"), (2, "hunger"), (3, None), (4, "hunger")], "doc_id int, summary string")
    old = summaries.tag_taxonomies(spark.createDataFrame([(i, "hunger and water") for i in (1, 2, 3)], "doc_id int, summary string"), tax)
    got = summaries.renew_tags(docs, old, tax, docs["doc_id"] != 2).collect()
    assert sorted((r.doc_id, r.tags[0]) for r in got) == [(1, "a - Water"), (2, "a - Water"), (2, "s2 - Hunger"), (3, "a - Water"), (3, "s2 - Hunger"), (4, "s2 - Hunger")]


def test_prompts_that_begin_alike_and_lengths_are_read_once(spark, monkeypatch):
    """Before, the model read the values of each prompt, and a text's length was counted wherever its parts name it."""
    values = [{"code": f"c{i}", "name": n} for i, n in enumerate(["Water", 'a"],"text":', "hunger"])]
    asked = [{"taxonomy": t, "values": values, "text": x} for x in ("WATER and hunger", 'a"],"text":', "") for t in ("p", 'q],"text":')]
    prompts = [json.dumps(a, separators=s) for a in asked for s in ((",", ":"), None)] + [json.dumps({"text": "x] water", "values": values[:1]})]
    want = [[v["code"] for v in json.loads(p)["values"] if v["name"].lower() in json.loads(p)["text"].lower()] for p in prompts]
    assert [[c["code"] for c in json.loads(x)] for x in models.named_values(prompts)] == want
    seen, loads = [], json.loads
    monkeypatch.setattr(models.json, "loads", lambda x: seen.append(x) or loads(x))
    models.named_values([json.dumps({"values": values, "text": str(i)}, separators=(",", ":")) for i in range(50)])
    assert sum('"values"' in x for x in seen) == 1
    df = spark.createDataFrame([("ab\n\ncd" * 30,), ("",), (None,)], "t string")
    plan = df.select(texts.split_balanced(F.col("t"), 50, 20).alias("parts"))._jdf.queryExecution().analyzed().toString()
    assert plan.upper().count("CEIL(") == 1
