"""Highlighting and fuzzy phrases against plain loops."""

from __future__ import annotations

import random
import re
from difflib import SequenceMatcher

import pytest
from pyspark.sql import functions as F

from docspark.operators import highlights, layout
from docspark.plans import registry

registry.load()


def bare_of(text):
    """The text without tags, and where each of its characters stood."""
    kept, at, i = [], [], 0
    while i < len(text):
        close = text.find(">", i) if text[i] == "<" else -1
        if close >= 0:
            i = close + 1
            continue
        kept.append(text[i])
        at.append(i)
        i += 1
    return "".join(kept), at


def plain_matches(text, query):
    bare, at = bare_of(text)
    low, q = bare.lower(), query.strip().lower()
    places = lambda x: [i for i in range(len(low) - len(x) + 1) if low[i : i + len(x)] == x]
    if not q:
        return []
    found = [(i, len(q), "exact_phrase") for i in places(q)]
    if not found:
        taken = set()
        for w in q.split():
            if len(w) > 2 and w not in highlights.STOP_WORDS:
                for i in places(w):
                    beside = low[max(0, i - 1) : i] + low[i + len(w) : i + len(w) + 1]
                    if not re.search(r"\w", beside) and i not in taken:
                        taken.add(i)
                        found.append((i, len(w), "word"))
    return sorted((at[i], at[i + n - 1] + 1, kind) for i, n, kind in found)


def plain_highlight(text, matches):
    covered = [any(s <= j < e for s, e, _ in matches) for j in range(len(text))]
    out = ""
    for j, c in enumerate(text):
        out += "<em>" if covered[j] and not (j and covered[j - 1]) else ""
        out += c
        out += "</em>" if covered[j] and not (j + 1 < len(text) and covered[j + 1]) else ""
    return out


SAMPLE = "The Council of Elders opened the well. Later councils thanked the elders for it."
CASES = [
    (SAMPLE, "council of elders"), (SAMPLE, "elders councils"), (SAMPLE, "the"), (SAMPLE, "about it"), (SAMPLE, "  "), ("", "x"), (None, "x"), (SAMPLE, None), ("aaaa aaa", "aa"),
    ("In the U.S. it costs $5 (sat) a.b [x] a+b \\E done", "u.s."), ("it costs $5 (sat)", "$5 (SAT)"), ("axb a.b", "a.b"), ("back\\slash \\E end", "\\e"), ("<b>bo</b>ld te<i>xt bold</i> text", "bold text"),
    ("<p class='x'>Water and <em>sanitation</em> in water</p> < 3 unclosed", "water sanitation"), ("5 < 6 and 7 > 3 yes", "7"), ("<a><b></b></a>", "a"), ("foo-bar foo foo_bar", "bar foo-bar foo"), ("Émile émile ÉMILE émiles", "émile x"), ("abab abab", "abab"),
]


def test_keyword_matches_and_highlights(spark, sf):
    cases = list(CASES)
    rng = random.Random(4)
    for r in spark.read.parquet(f"{sf}/pages.parquet").limit(25).collect():  # texts full of tags
        html = r.html[:1500]
        words = bare_of(html)[0].split() or ["x"]
        cases += [(html, rng.choice(words) + " " + rng.choice(words)), (html, rng.choice(words)[:3]), (html, " ".join(words[3:5]))]
    df = spark.createDataFrame([(i, t, q) for i, (t, q) in enumerate(cases)], "chunk_id long, text string, query string")
    for r in highlights.highlight(df, F.col("query")).collect():
        text, query = r.text or "", r.query or ""
        want = plain_matches(text, query)
        assert sorted((m.start, m.end, m.match_type) for m in r.matches) == want, (text, query)
        assert all(m.text == text[m.start : m.end] for m in r.matches)
        assert r.highlighted == plain_highlight(text, want), (text, query)


def plain_window(text, phrase):
    best = None
    for i in range(len(text) - len(phrase) + 1):
        for size in (len(phrase), len(phrase) + 20):
            if text[i] == phrase[0] and i + size <= len(text):
                ratio = SequenceMatcher(None, phrase, text[i : i + size]).ratio()
                if ratio > (best[2] if best else 0.75):
                    best = (i, i + size, ratio)
    return best


def test_fuzzy_places_equal_a_plain_search(spark, sf):
    got = registry.QUERIES["t35_locate_phrases"](spark, sf).where("crc32(chunk_id) % 9 = 0").collect()
    texts = {r.chunk_id: r.text for r in spark.createDataFrame([(r.chunk_id,) for r in got], "chunk_id string").distinct().join(registry.QUERIES["t35_locate_phrases"].__globals__["chunks"](spark, sf), "chunk_id").collect()}
    assert len(got) > 200 and sum(r.similarity < 1 for r in got) > 80
    for r in random.Random(1).sample(got, 60):
        at, to, ratio = plain_window(texts[r.chunk_id].lower(), r.phrase.strip().lower())
        assert (r.start, r.end, r.similarity, r.text) == (at, to, pytest.approx(ratio), texts[r.chunk_id][at:to])


def test_fuzzy_places_of_odd_texts(spark):
    texts = [(1, "The <b>quick</b> brown fox jumps over the lazy dog, and then rests for a while."), (2, ""), (3, None), (4, "ab"), (5, "x" * 300 + " needle in hay " + "y" * 300), (6, "unlike")]
    phrases = [(1, "quick brown"), (1, "quikc brwn fox"), (1, "lazy dgo and then"), (1, "zz"), (1, "Zebra crossing"), (1, "x" * 200), (2, "abc"), (3, "abc"), (4, "abc"), (5, "needel in hay"), (1, None), (9, "gone")]
    c = spark.createDataFrame(texts, "chunk_id int, text string")
    got = {(r.chunk_id, r.phrase): r for r in highlights.locate_phrases(c, spark.createDataFrame(phrases, "chunk_id int, phrase string")).collect()}
    for i, phrase in phrases:
        text = dict(texts).get(i)
        bare, at = bare_of(text or "")
        want = plain_window(bare.lower(), phrase.lower()) if text and phrase and len(phrase) > 2 else None
        assert ((i, phrase) in got) == (want is not None), phrase
        if want:
            r = got[i, phrase]
            assert (r.start, r.end) == (at[want[0]], at[want[1] - 1] + 1) and r.text == text[r.start : r.end] and r.similarity == pytest.approx(want[2])
    both = highlights.highlight(c, F.lit("dog"), phrases=spark.createDataFrame(phrases, "chunk_id int, phrase string")).where("chunk_id = 1").first()
    assert [m.match_type for m in both.matches] == ["word"] * 0 + ["exact_phrase"] + ["semantic"] * 3
    assert "<em>quick</b> brown fo</em>x" in both.highlighted
    assert spark.range(1).select(highlights.parse_phrases(F.lit('{"phrases": ["a", "b c"]}'))).first()[0] == ["a", "b c"]
    assert spark.range(1).select(highlights.parse_phrases(F.lit("sorry"))).first()[0] == []


def plain_grown(text, start, end):
    while start > 0 and text[start - 1] not in ".!?;:\n" and not (text[start - 1] == " " and start > 1 and text[start - 2] == " "):
        start -= 1
    return start


def test_phrases_stop_after_double_spaces(spark):
    cases = [("abc  def ghi", 6, 7), ("abc   def ghi", 7, 8), ("  x y", 4, 5), ("one. two\n three", 12, 13), ("a\n", 1, 2), ("x  ", 2, 3), (" . a  b. c  ", 6, 7), ("tail  two  gap", 7, 8)]
    df = spark.createDataFrame([(i, *c) for i, c in enumerate(cases)], "chunk_id int, text string, start int, end int")
    got = {r.chunk_id: r for r in layout.expand_phrases(df).collect()}
    assert got[0].phrase == "def ghi" and got[1].phrase == "def ghi"
    for i, (text, start, end) in enumerate(cases):
        a, z = plain_grown(text, start, end), end
        while z < len(text) and text[z] not in ".!?;:\n" and text[z : z + 2] != "  ":
            z += 1
        z += z < len(text) and text[z] in ".!?;:\n"
        while a < start and text[a].isspace():
            a += 1
        while z > end and text[z - 1].isspace():
            z -= 1
        assert (got[i].start, got[i].end, got[i].phrase) == (a, z, text[a:z]), text


def test_parts_of_an_expression_are_computed_once(spark):
    """However often a function over an array names them; before, once for each element."""
    from pyspark.sql import functions as F

    from docspark.functions import strings

    df = spark.createDataFrame([("a b c d e f g h",)], "t string")
    drawn = lambda words: F.transform(words, lambda w, i: F.concat(F.get(words, i), F.lit("")))
    assert strings.let and df.select(F.array_join(strings.let(F.split("t", " "), drawn), "").alias("x")).first().x == "abcdefgh"
    once = df.select(strings.let(F.rand(), lambda r: F.size(F.array_distinct(F.transform(F.sequence(F.lit(1), F.lit(50)), lambda i: r + i * 0)))).alias("n"))
    assert once.first().n == 1


def test_long_texts_without_ends_grow_in_one_pass(spark):
    """Phrases beside a hundred thousand characters without an end: the patterns before tried every place."""
    text = "word " * 20000
    df = spark.createDataFrame([("a", text, 50000, 50004), ("b", "x. yy  zz aa. b", 7, 9)], "chunk_id string, text string, start int, end int")
    got = {r.chunk_id: (r.start, r.end, len(r.phrase)) for r in layout.expand_phrases(df).collect()}
    assert got == {"a": (0, 99999, 99999), "b": (7, 13, 6)}


def test_unlike_phrases_are_not_compared_at_every_place(spark):
    """Words the wrong way round share their characters with every place: before, the sequence matcher read each."""
    rng = random.Random(5)
    cases = [("".join(rng.choice(a) for _ in range(rng.randint(0, 130))), "".join(rng.choice(a) for _ in range(n))) for a in ("ab", "abc ", "abcdéfg😀 ") for n in (1, 3, 9, 40, 63, 64, 65, 80) for _ in range(12)]
    assert highlights.best_windows(*zip(*cases, strict=True)) == [plain_window(t, p) for t, p in cases]
    for text, phrase in cases:
        assert highlights._alike(phrase, text) == SequenceMatcher(None, phrase, text).ratio()
    words = [rng.choice("alpha brook cedar delta ember frost grove haven".split()) for _ in range(300)]
    text, phrase = " ".join(words), " ".join(words[40:47][::-1])
    read, alike = [], highlights._alike
    highlights._alike = lambda p, w: read.append(w) or alike(p, w)
    try:
        assert highlights.best_windows([text], [phrase]) == [plain_window(text, phrase)]
    finally:
        highlights._alike = alike
    assert len(read) < 10 < sum(c == phrase[0] for c in text)
