"""Packing, toxicity, WARC derivatives, language-model scores, pseudonyms and the pipeline on small tables."""

from __future__ import annotations

import base64
import gzip
import hashlib
import json
import math
import random
import re
import time
import uuid
import zlib
from collections import Counter
from html.parser import HTMLParser
from urllib.parse import urljoin

import numpy as np
import public_tokenizers
import pyarrow as pa
import pytest
from pyspark.sql import functions as F
from tokenizers import Tokenizer

import corpus_pipeline
from docspark.llm import bloom_lm, packing, pii, toxicity, warc
from docspark.llm.bytewise import mix64

DOCS = "doc_id long, text string, lang string, length int"


def docs_of(spark, texts):
    return spark.createDataFrame([(i, t, None, 3) for i, t in texts], DOCS)


# packing


def test_ids_equal_the_tokenizer(spark, sf):
    tok = Tokenizer.from_file(public_tokenizers.path(packing.TOKENIZER))
    encode = packing._encoder(public_tokenizers.path(packing.TOKENIZER))
    texts = [r.text for r in spark.read.parquet(f"{sf}/documents.parquet").limit(60).collect()]
    texts += ["don't. x,y .. A.B, É́ İstanbul ÑANDÚ ß", "<|endoftext|> a", "\x1c\x85a\xa0b 12.5", "é. 中文,字"]
    for t in texts:
        assert np.frombuffer(encode(t.encode()), "<u4").tolist() == tok.encode(t, add_special_tokens=False).ids


def check_packed(rows, limit):
    by = {}
    for r in rows:
        by.setdefault(r.sequence_id, []).append((r.offset, r.length))
    for parts in by.values():
        at = 0
        for offset, length in sorted(parts):
            assert offset == at
            at += length
        assert at <= limit
    return len(by)


def test_every_piece_is_placed_once(spark):
    r = random.Random(1)
    texts = [(i, " ".join("ab" for _ in range(r.randrange(0, 200)))) for i in range(300)] + [(900, None), (901, ""), (902, "ab " * 500), (902, "ab " * 500)]
    rows = packing.pack_documents(docs_of(spark, texts), limit=128, with_ids=True).collect()
    used = check_packed(rows, 128)
    total = sum(x.length for x in rows)
    assert used <= math.ceil(total / 128) * 1.03 + 1
    encode = packing._encoder(public_tokenizers.path(packing.TOKENIZER))
    whole = {i: encode((t or "").encode()) + b"\1\0\0\0" for i, t in texts}
    found = {}
    for x in rows:
        assert x.ids_crc32 == zlib.crc32(bytes(x.ids)) and x.start == 128 * x.piece
        found.setdefault((x.doc_id, x.piece), bytes(x.ids))
    for i, ids in whole.items():
        assert b"".join(found[i, k] for k in range(-(-len(ids) // 512))) == ids


def test_sequences_hold_the_ids(spark):
    packed = packing.pack_documents(docs_of(spark, [(1, "a b"), (2, None)]), limit=64, with_ids=True)
    assert sorted(packing.sequences(packed).first().ids, key=lambda x: x != 1)[:2] == [1, 1]


def test_plan_fills_and_covers():
    r = random.Random(2)
    lens = Counter(r.randrange(1, 1000) for _ in range(3000))
    rows, used = packing.plan(dict(lens), 1000)
    assert used <= math.ceil(sum(k * n for k, n in lens.items()) / 1000) * 1.02 + 1
    for k, n in lens.items():
        mine = rows[rows[:, 0] == k]
        assert mine[0, 1] == 0 and mine[-1, 2] == n and (mine[1:, 1] == mine[:-1, 2]).all()


def test_short_sequences_are_filled_too():
    r = random.Random(2)
    lens = Counter(r.randrange(1, 64) for _ in range(3000))
    assert packing.plan(dict(lens), 64)[1] <= math.ceil(sum(k * n for k, n in lens.items()) / 64) * 1.01 + 1


@pytest.mark.parametrize("times", [1, 10, 50])
def test_sequences_come_from_configurations(times):
    """What the rounding leaves to best fit is at most one piece for each length, however many there are."""
    r = random.Random(8)
    lens = Counter(min(999, int(r.lognormvariate(5, 1)) + 1) for _ in range(4000))
    sizes, left = np.array(sorted(lens)), np.array([lens[k] * times for k in sorted(lens)])
    pieces, total = int(left.sum()), int((left * sizes).sum())
    used = packing._rounded(sizes, left, 1000, packing.ROUNDS)
    assert left.min() >= 0 and left.sum() <= len(lens)
    assert sum(n * t for c, t in used for _, n in c) + left.sum() == pieces
    assert all(sum(k * n for k, n in c) <= 1000 for c, _ in used)
    assert packing.plan({k: n * times for k, n in lens.items()}, 1000)[1] <= math.ceil(total / 1000) * 1.01 + 1


def plain_best_fit(lens, limit):
    free = []
    for size in sorted(lens, reverse=True):
        fits = [r for r in free if r >= size]
        room = min(fits) if fits else limit
        if fits:
            free.remove(room)
        free.append(room - size)
    return len(free)


@pytest.mark.parametrize(
    ("lens", "most"),
    [
        ({2048: 100, 1024: 333, 512: 77}, 143), ({2000: 1000, 1500: 1000, 900: 777, 333: 500}, 1104), ({700: 1000, 1300: 500}, 350), ({2500: 300, 1500: 300, 800: 900}, 480),
        ({3000: 500, 1000: 600, 100: 700}, 543), ({1366: 999}, 500), ({1365: 999, 1366: 5}, 335), ({4090: 777, 5: 1000, 3: 22}, 779), ({4000: 1, 96: 1}, 1), ({1: 5}, 1),
    ],
)
def test_few_lengths_are_packed_as_well_as_best_fit_and_better(lens, most):
    began = time.process_time()
    plan, used = packing.plan(lens)
    assert time.process_time() - began < 3
    assert used <= most and used <= plain_best_fit([k for k, n in lens.items() for _ in range(n)], 4096)
    placed = Counter()
    for size, first, end, *_ in plan.tolist():
        placed[size] += end - first
    assert placed == Counter(lens)


@pytest.mark.parametrize("seed", range(6))
def test_plans_of_two_to_ten_lengths(seed):
    r = random.Random(seed)
    lens = {r.randrange(40, 2100): r.randrange(1, 120) for _ in range(r.randrange(2, 11))}
    sizes, n = np.array(sorted(lens)), np.array([lens[k] for k in sorted(lens)])
    mass, _, bound = packing.fractional(sizes, n.astype(float), 4096, 16)
    covered = np.zeros(len(n))
    for config, x in mass.items():
        assert sum(sizes[k] * c for k, c in config) <= 4096
        for k, c in config:
            covered[k] += c * x
    assert (covered >= n - 1e-6).all() and bound <= sum(mass.values()) + 1e-6 <= 1.03 * bound + 1
    used = packing.plan(lens)[1]
    assert bound - 1e-6 <= used <= plain_best_fit([k for k, m in lens.items() for _ in range(m)], 4096)
    by_counts = packing.best_fit(sizes, n, 4096)
    assert sum(t for _, t in by_counts) == plain_best_fit([k for k, m in lens.items() for _ in range(m)], 4096)


def test_the_knapsack_is_exact():
    r = random.Random(5)
    for _ in range(20):
        lens = np.array(sorted(r.sample(range(1, 60), r.randrange(1, 7))))
        price, want = np.array([r.random() for _ in lens]), np.zeros(101)
        for room in range(1, 101):
            want[room] = max([want[room - 1]] + [want[room - s] + p for s, p in zip(lens, price, strict=True) if s <= room])
        assert packing.knapsack(lens, price, 100) == pytest.approx(want)


def test_words_with_odd_stops_get_the_tokenizers_ids():
    path = public_tokenizers.path(packing.TOKENIZER)
    tok, encode, r = Tokenizer.from_file(path), packing._encoder(path), random.Random(6)
    letters = "aBzéÉßİıĀŀǅª\u0307\u0301ſKΣς中ا9'.,-’\u200d"
    for t in ["İ.", "İ,", "aİ. İ., b"] + ["".join(r.choice(letters) for _ in range(r.randrange(1, 7))) + r.choice(["", ".", ","]) for _ in range(4000)]:
        assert np.frombuffer(encode(t.encode()), "<u4").tolist() == tok.encode(t, add_special_tokens=False).ids, t


def test_a_word_is_merged_once_whatever_its_case_and_marks(monkeypatch):
    """Before, each notation of a word was a word of its own, and one with other marks than a stop or comma took the whole way."""
    import tokenizers

    asked = []

    class Told:
        def __init__(self, of):
            self.of = of

        def __getattr__(self, name):
            got = getattr(self.of, name)
            return Told(got) if name == "model" else got if name not in ("tokenize", "encode") else lambda x, *a, **b: asked.append(x) or got(x, *a, **b)

    path = public_tokenizers.path(packing.TOKENIZER)
    monkeypatch.setattr(tokenizers, "Tokenizer", type("T", (), {"from_file": staticmethod(lambda p: Told(Tokenizer.from_file(p)))}))
    text = "Word word WORD word; wOrd: word. word... word"
    assert np.frombuffer(packing._encoder(path)(text.encode()), "<u4").tolist() == Tokenizer.from_file(path).encode(text, add_special_tokens=False).ids
    assert sorted(asked) == [".", "...", ":", ";", "word"]


@pytest.mark.parametrize("room", [1, 3000, 12 << 20])
def test_texts_in_slices_get_the_tokenizers_ids_whatever_words_are_kept(monkeypatch, room):
    monkeypatch.setattr(packing, "CACHE_BYTES", room)
    path, r = public_tokenizers.path(packing.TOKENIZER), random.Random(8)
    tok, encode = Tokenizer.from_file(path), packing._encoder(path)
    words = ["".join(r.choice("aBzéÉßİıΣς.,'*|<>\u0331H") for _ in range(r.randrange(1, 7))) for _ in range(120)] + ["<|ENDOFTEXT|>", "a<|endoftext|>b"]
    for _ in range(30):
        texts = ["".join(r.choice(words) + r.choice(["", " ", "\n", "  "]) for _ in range(r.randrange(8))) for _ in range(20)] + ["", " ", ".a"]
        got = encode.each(pa.array([t.encode() for t in ["x", *texts]], pa.large_binary())[1:])
        for t, ids in zip(texts, got, strict=True):
            assert np.frombuffer(ids, "<u4").tolist() == tok.encode(t, add_special_tokens=False).ids, t


def test_a_plan_does_not_grow_with_the_pieces():
    r = random.Random(4)
    lens = {k: r.randrange(1, 40) for k in range(1, 600, 7)}
    sizes = []
    for times in (1_000, 100_000):
        many = {k: n * times + r.randrange(50) for k, n in lens.items()}
        rows, used = packing.plan(many, 1000)
        sizes.append(len(rows))
        assert used <= math.ceil(sum(k * n for k, n in many.items()) / 1000) * 1.02 + 1
        for k, n in many.items():
            mine = rows[rows[:, 0] == k]
            assert mine[0, 1] == 0 and mine[-1, 2] == n and (mine[1:, 1] == mine[:-1, 2]).all()
    assert sizes[1] <= 2 * sizes[0]


def test_plan_of_nothing(spark):
    assert packing.pack_documents(docs_of(spark, [(1, "a")]).limit(0)).count() == 0


# toxicity


def test_transducers_tell_kinds_apart():
    g = toxicity.Grammar({"scum$": 4.0, "idio": 3.0})
    assert g.matches("Scum. fine words") == [(0, 4.0)]
    assert g.matches("you are an idiotic one") == [(1, 3.0)]
    assert g.matches("he is not an idiot") == [(2, 3.0)]
    assert g.matches("she said: x. he said idiot") == [(3, 3.0)]
    assert g.matches("I will kill you") == [(4, 1.0)]
    assert g.matches("kill time") == [] and g.matches("") == []


@pytest.mark.parametrize(
    ("text", "kind"),
    [
        ("she said you are an idiot", "reported"), ("she said: you are an idiot", "reported"), ('he said: "you are an idiot"', "reported"), ("he said to me again: you idiot", "reported"),
        ("you are an idiot, he said", "reported"), ('"you are an idiot" he said', "reported"), ("“you idiot”, wrote the man", "reported"), ("listen: you are an idiot", "targeted"),
        ("he said it. listen: you are an idiot", "targeted"), ("you are an idiot. he said", "targeted"), ("you are an idiot and said so", "targeted"), ("you, idiot, never came", "targeted"), ("you are no, idiot", "negated"),
    ],
)
def test_reported_speech_with_colons_and_behind(text, kind):
    assert [toxicity.KINDS[k] for k, _ in toxicity.Grammar({"idio": 3.0}).matches(text)] == [kind]


def test_toxicity_learns_and_ignores_held_out_labels(spark):
    r = random.Random(3)
    rows, labels = [], []
    for i in range(400):
        bad = i % 4 == 0
        w = [f"word{r.randrange(300)}" for _ in range(30)]
        if bad:
            w[r.randrange(30)] = f"grumf{r.choice(['el', 'a', 'ing', 'ox'])}"
        rows.append((i, " ".join(w)))
        held = zlib.crc32(str(i).encode()) % 5 == 0
        labels.append((i, int(bad) if not held else int(not bad)))  # wrong where they must not be read
    rows += [(900, None), (901, ""), (902, "grumfel"), (None, "grumfa now")]
    lab = spark.createDataFrame([*labels, (1, None), (None, 1), (2, 0)], "doc_id long, toxic int")
    got = {x.doc_id: x for x in toxicity.toxicity(docs_of(spark, rows), lab).collect()}
    assert all(got[i].held_out == (zlib.crc32(str(i).encode()) % 5 == 0) for i, _ in rows if i is not None)
    assert all(0 <= x.score <= 1 and x.predicted == int(x.score >= 0.5) for x in got.values())
    assert sum(got[i].predicted == int(i % 4 == 0) for i in range(400)) >= 396
    assert got[902].predicted == 1 and got[901].predicted == got[900].predicted == 0 and got[None].predicted == 1
    kept = toxicity.drop_toxic(docs_of(spark, rows), lab)
    assert {x.doc_id for x in kept.collect()} == {i for i, x in got.items() if not x.predicted} and kept.columns == ["doc_id", "text", "lang", "length"]


def test_the_composed_table_equals_the_cascade():
    """Every clause of three words and random longer ones, transducer after transducer, against the one table."""
    r, weights = random.Random(7), (0.5, 1.0, -2.0, -1.0, 2.0)
    steps = [toxicity.target, toxicity.negation, toxicity.reported, toxicity.insult(weights), toxicity.threat(weights)]
    arcs = toxicity.compose(steps, range(16))
    clauses = [[a, b, c] for a in range(6) for b in range(6) for c in range(6)] + [[r.randrange(6) for _ in range(r.randrange(4, 12))] for _ in range(300)]
    for clause in clauses:
        symbols, total = clause, [1.0] * len(clause)
        for step in steps:
            state, read = 0, []
            for k, x in enumerate(symbols):
                state, x, w = step(state, x)
                read.append(x)
                total[k] += w
            symbols = read
        assert toxicity.run(arcs, clause, [1.0] * len(clause)) == (symbols, total)


def brute_kinds(words, lexicon):
    """Kinds of the insults and threats of one clause, by looking at the clause as a whole."""
    found = []
    for i, w in enumerate(words):
        addressed = any(x in toxicity.TARGETS for x in words[:i] + words[i + 1 :])
        negated = any(x in toxicity.NEGATIONS for x in words[max(0, i - 3) : i])
        quoted = any(x in toxicity.REPORTED for x in words[:i])
        if w in lexicon:
            found.append(3 if quoted else 2 if negated else 1 if addressed else 0)
        elif w in toxicity.THREATS and addressed and not negated and not quoted:
            found.append(4)
    return found


def test_matches_equal_brute_force():
    r = random.Random(12)
    lexicon = {"scum": 3.0, "twit": 4.0}
    g = toxicity.Grammar({f"{w}$": x for w, x in lexicon.items()})
    for _ in range(2000):
        words = [r.choice(["scum", "twit", "kill", "you", "dich", "not", "nie", "said", "dijo", "one", "two", "three"]) for _ in range(r.randrange(1, 14))]
        assert [k for k, _ in g.matches(" ".join(words))] == brute_kinds(words, lexicon), words


def test_scores_equal_a_loop_over_all_texts(spark):
    """The model's score of every row, text by text in one place, and nulls as empty texts."""
    rows = [(i, " ".join(f"w{(i * 7 + k) % 50}" for k in range(20)) + (" grumf you" if i % 3 == 0 else "")) for i in range(120)] + [(500, None), (501, "grumf " * 3000)]
    lab = spark.createDataFrame([(i, int(i % 3 == 0)) for i in range(120)], "doc_id long, toxic int")
    grammar, w = toxicity.train(docs_of(spark, rows).select("doc_id", "text"), lab)
    want = {i: 1 / (1 + math.exp(-max(-30, min(30, float(np.dot(grammar.features(t or ""), w[:-1]) + w[-1]))))) for i, t in rows}
    assert {x.doc_id: pytest.approx(x.score) for x in toxicity.toxicity(docs_of(spark, rows), lab).collect()} == want


def test_several_labels_of_a_document(spark):
    lab = spark.createDataFrame([(1, 0), (1, 1), (2, 0), (3, None)], "doc_id long, toxic int")
    got = {r.doc_id: r.toxic for r in toxicity._sample(lab, 100).collect()}
    assert got == {i: t for i, t in ((1, 1), (2, 0)) if zlib.crc32(str(i).encode()) % 5}


def test_toxicity_without_labels(spark):
    none = spark.createDataFrame([(1, 0)], "doc_id long, toxic int").limit(0)
    assert [x.predicted for x in toxicity.toxicity(docs_of(spark, [(1, "a")]), none).collect()] == [0]


# WARC


PAGE = '<html><head><title>A &amp; B</title><script>var x="<p>no</p>"</script></head><body><!-- no --><p>One<br>two</p><ul><li>Three &lt;3</li></ul><a href="/x?a=1&amp;b=2">go</a><a href=\'http://[bad\'>no</a></body>'


def test_derived_records_are_linked(spark):
    pages = spark.createDataFrame([(1, "http://h.example/d/", PAGE, 5), (2, None, None, 5), (1, "http://h.example/d/", PAGE, 5)], "page_id long, url string, html string, record_id int")
    source = warc.responses(pages)
    rows = warc.derive(source).collect()
    assert len(rows) == 6
    ids = {r.record_id: r for r in source.collect()}
    for r in rows:
        assert r.refers_to in ids and r.source_payload_digest == ids[r.refers_to].payload_digest and r.source_headers == ids[r.refers_to].http_headers
        assert r.content_length == len(r.block.encode()) and r.block_digest == warc.digest(r.block.encode())
    text = next(r for r in rows if r.record_type == "conversion" and r.page_id == 1)
    assert text.block == "A & B\nOne\ntwo\nThree <3\ngono"
    meta = next(r for r in rows if r.record_type == "metadata" and r.page_id == 1)
    assert '"http://h.example/x?a=1&b=2"' in meta.block and '"title": "A & B"' in meta.block
    assert next(r for r in rows if r.record_type == "conversion" and r.page_id == 2).block == ""
    assert warc.derive(source.limit(0)).count() == 0


def test_records_round_trip_through_files(spark, tmp_path):
    pages = spark.createDataFrame([(1, "http://h.example/", "<p>é</p>")], "page_id long, url string, html string")
    r = warc.responses(pages).first()
    block = r.http_headers.encode() + bytes(r.payload)
    member = warc._member([("WARC-Type", "response"), ("WARC-Record-ID", r.record_id), ("WARC-Target-URI", r.target_uri), ("WARC-Date", r.date), ("WARC-Payload-Digest", r.payload_digest), ("WARC-Block-Digest", r.block_digest), ("Content-Length", str(len(block)))], block)
    other = warc._member([("WARC-Type", "warcinfo"), ("Content-Length", "2")], b"hi")
    (tmp_path / "a.warc.gz").write_bytes(other + member)
    back = warc.read_responses(spark, str(tmp_path))
    assert back.first().asDict() == {**r.asDict(), "page_id": None}
    out = warc.serialise(warc.derive(back)).collect()
    head, body = next(warc.parse(bytes(out[1].member)))
    assert head["warc-refers-to"] == r.record_id and body.decode() == "é" and gzip.decompress(bytes(out[1].member)).startswith(b"WARC/1.0")


def test_blocks_that_hold_a_version_line(spark, tmp_path):
    blocks = [b"HTTP/1.1 200 OK\r\nX: 1\r\n\r\nWARC/1.0\r\nWARC-Type: response\r\n\r\n\xff\xfe\x00", b"HTTP/1.1 200 OK\r\n\r\n", b"HTTP/1.1 200 OK\r\n\r\nend"]
    (tmp_path / "b.warc.gz").write_bytes(b"".join(warc._member([("WARC-Type", "response"), ("WARC-Record-ID", f"<{k}>"), ("Content-Length", str(len(x)))], x) for k, x in enumerate(blocks)))
    got = {r.record_id: r.http_headers.encode() + bytes(r.payload) for r in warc.read_responses(spark, str(tmp_path)).collect()}
    assert got == {f"<{k}>": x for k, x in enumerate(blocks)}
    assert [b for _, b in warc.parse((tmp_path / "b.warc.gz").read_bytes())] == blocks


class Visible(HTMLParser):
    """Title, links and lines of visible text, by the standard library's parser."""

    BLOCKS = set("p div li ul ol h1 h2 h3 h4 h5 h6 br tr table article section nav footer header main aside blockquote pre title body html head hr dd dt dl form figure figcaption".split())

    def __init__(self, markup):
        super().__init__(convert_charrefs=True)
        self.hidden, self.text, self.links = 0, "", []
        self.feed(markup)
        self.close()
        lines = [" ".join(x.split()) for x in self.text.split("\n")]
        self.lines = [x for x in lines if x]

    def handle_starttag(self, tag, attrs):
        self.hidden += tag in ("script", "style", "noscript", "template")
        self.text += "\n" if tag in self.BLOCKS else ""
        if tag == "a" and dict(attrs).get("href") is not None:
            self.links.append(dict(attrs)["href"].strip())

    def handle_endtag(self, tag):
        self.hidden -= tag in ("script", "style", "noscript", "template")
        self.text += "\n" if tag in self.BLOCKS else ""

    def handle_data(self, data):
        self.text += "" if self.hidden else data.replace("\n", " ")


def a_record(version, i, kind="response", block=b"HTTP/1.1 200 OK\r\n\r\nbody"):
    own = f"WARC-Record-ID: <{i}>\r\n" if i is not None else ""
    return f"WARC/{version}\r\nWARC-Type: {kind}\r\n{own}Content-Length: {len(block)}\r\n\r\n".encode() + block + b"\r\n\r\n"


def test_files_of_both_versions_are_read_and_others_refused(spark, tmp_path):
    good, bad = tmp_path / "good", tmp_path / "bad"
    good.mkdir(), bad.mkdir()
    (good / "a.warc").write_bytes(b"".join(a_record("1.1", i) for i in range(5)))
    (good / "b.warc.gz").write_bytes(b"".join(gzip.compress(a_record("1.0", i)) for i in range(5, 8)))
    (good / "c.warc").write_bytes(a_record("1.1", 8, "request") + a_record("1.0", None) + a_record("1.1", 9, block=b"HTTP/1.1 200 OK\r\n\r\nx\r\n\r\nWARC/1.0\r\nWARC-Type: response\r\n\r\n"))
    got = warc.read_responses(spark, str(good)).collect()
    assert sorted(str(r.record_id) for r in got) == sorted([*(f"<{i}>" for i in range(8)), "None", "<9>"])
    assert {bytes(r.payload) for r in got if r.record_id != "<9>"} == {b"body"}
    (bad / "d.warc").write_bytes(a_record("1.0", 1) + a_record("2.0", 2))
    (bad / "e.warc").write_bytes(a_record("2.0", 3))
    for name in ("d.warc", "e.warc"):
        with pytest.raises(Exception, match="not a record of WARC"):
            warc.read_responses(spark, str(bad / name)).collect()


def test_records_of_the_pages_equal_a_plain_loop(spark, sf):
    pages = {r.page_id: r for r in spark.read.parquet(f"{sf}/pages.parquet").collect()}
    rows = warc.op3_warc(spark, sf).collect()
    assert Counter((r.page_id, r.record_type) for r in rows) == Counter((i, k) for i in pages for k in ("metadata", "conversion"))
    for r in rows:
        page = pages[r.page_id].html or ""
        seen, payload = Visible(page), page.encode()
        head = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {len(payload)}\r\n\r\n"
        sha1 = lambda x: "sha1:" + base64.b32encode(hashlib.sha1(x).digest()).decode()
        source = f"<urn:uuid:{uuid.uuid5(uuid.NAMESPACE_URL, chr(10).join(('response', pages[r.page_id].url or '', str(r.page_id), sha1(payload))))}>"
        assert (r.refers_to, r.source_headers, r.source_payload_digest, r.source_block_digest) == (source, head, sha1(payload), sha1(head.encode() + payload))
        assert (r.target_uri, r.content_length, r.block_digest) == (pages[r.page_id].url, len(r.block.encode()), sha1(r.block.encode()))
        if r.record_type == "conversion":
            assert r.block.split() == " ".join(seen.lines).split()
        else:
            known = json.loads(r.block)
            assert known["links"] == [urljoin(pages[r.page_id].url, x) for x in seen.links] and known["headers"]["Content-Length"] == str(len(payload))


# language model


def brute_base(texts):
    tokens = {i: [w.lower() for w in (t or "").encode().split()] + [None] for i, t in texts}
    train = [i for i in tokens if zlib.crc32(str(i).encode()) % 7 != 2]
    c = Counter(w for i in train for w in tokens[i])
    n, v = sum(c.values()), len(c)
    return {i: (len(t), sum(c[w] > 0 for w in t), n, sum(math.log10((c[w] + 1) / (n + v + 1)) for w in t)) for i, t in tokens.items()}


@pytest.mark.parametrize("share", [5e-7, 0.01], ids=["broadcast", "joined"])
def test_base_scores_and_repeated_rows(spark, share, monkeypatch):
    monkeypatch.setattr(bloom_lm, "HEAD_SHARE", share)
    r = random.Random(5)
    texts = [(i, " ".join(f"W{int(r.expovariate(0.05))}" for _ in range(r.randrange(0, 60)))) for i in range(120)] + [(500, None), (501, ""), (502, "unseen words é\tW1")]
    got = bloom_lm.language_scores(docs_of(spark, [*texts, texts[3]])).collect()
    want = brute_base(texts + [])
    again = brute_base([*texts[:3], *texts[4:]])
    assert len(got) == len(texts) + 1 and again
    counts = Counter(x.doc_id for x in got)
    assert counts[3] == 2 and len({(x.n_known, round(x.base_score, 6)) for x in got if x.doc_id == 3}) == 1
    single = {x.doc_id: x for x in bloom_lm.language_scores(docs_of(spark, texts)).collect()}
    for i, (n, known, total, base) in want.items():
        x = single[i]
        assert (x.n_tokens, x.n_known, x.train_tokens) == (n, known, total) and x.base_score == pytest.approx(base)
        assert x.held_out == (zlib.crc32(str(i).encode()) % 7 == 2) and x.score < 0


def test_filter_answers_with_quantised_counts(spark):
    texts = [(i, "a b " * 5 + "c") for i in range(40)]
    counted, buckets = bloom_lm.count_ngrams(docs_of(spark, texts).select("doc_id", "text"))
    model = bloom_lm.train(counted, buckets)
    h, n = (np.concatenate(x) for x in zip(*(bloom_lm._unpacked(r.words) for r in counted.collect()), strict=True))
    got = model.counts(h, model.lows[0])
    assert (got == bloom_lm.LEVELS[np.searchsorted(bloom_lm.LEVELS, n, "right") - 1]).all()
    absent = model.counts(mix64(np.arange(5000, dtype=np.uint64)), 1)
    assert (absent > 0).mean() < 0.05


def test_no_ngram_is_pruned_however_many_there_are(spark, monkeypatch):
    monkeypatch.setattr(bloom_lm, "MAX_BITS", 1 << 14, raising=False)  # the bound that the filter once had
    r = random.Random(11)
    texts = [(i, " ".join(f"w{int(r.expovariate(0.01))}" for _ in range(120))) for i in range(100)]
    tokens = {i: [None, *t.split(), None] for i, t in texts}
    train = [t for i, t in tokens.items() if zlib.crc32(str(i).encode()) % 7 != 2]
    one, two = Counter(w for t in train for w in t[1:]), Counter(p for t in train for p in zip(t, t[1:], strict=False))
    step = lambda n: bloom_lm.LEVELS[bloom_lm.LEVELS <= n][-1] if n else 0
    total, n = sum(one.values()), Counter(two.values())
    d, u = n[1] / (n[1] + 2 * n[2]), sum(c == 1 for c in one.values()) / total

    def p(v, w):
        single = (1 - u) * step(one[w]) / total if one[w] else u
        return max(step(two[v, w]) - d, 0) / step(one[v]) + d * len(two) / total * single if one[v] else single

    for x in bloom_lm.language_scores(docs_of(spark, texts)).collect():
        t = tokens[x.doc_id]
        assert x.score == pytest.approx(sum(math.log10(min(1, p(v, w))) for v, w in zip(t, t[1:], strict=False)), rel=0.04)


def test_scores_beat_the_base_on_held_out_documents(spark, sf):
    x = bloom_lm.op7_lm_scoring(spark, sf).where("held_out").agg(F.sum("score"), F.sum("base_score"), F.count("*")).first()
    assert x[2] > 0 and x[0] > x[1]


def test_nothing_to_learn_from(spark):
    assert bloom_lm.language_scores(docs_of(spark, [(1, "a")]).limit(0)).count() == 0


# pseudonyms


def luhn(s):
    d = [int(x) for x in s if x.isdigit()][::-1]
    return (sum(d[0::2]) + sum(sum(divmod(2 * x, 10)) for x in d[1::2])) % 10 == 0


def pseudonyms(spark, values):
    return [r.text for r in pii.pseudonymise(docs_of(spark, list(enumerate(values)))).orderBy("doc_id").collect()]


def test_formats_stay_valid_and_equal_values_linked(spark):
    texts = ["a 4041894974608795 b", "4041894974608795", "4041 8949-7460 8795", "+1 (988) 555-2485", "x@y.example bosbt.42@mail8.example.com.", "42.144.35.254", "123-45-6789", "GB82WEST12345698765432", "1985-03-09 31.12.1999 12/31/1999"]
    got = pseudonyms(spark, texts)
    card = re.search(r"\d{16}", got[0])[0]
    assert luhn(card) and card != "4041894974608795" and got[1] == card and card[0] == "4"
    assert luhn(got[2]) and re.fullmatch(r"\d{4} \d{4}-\d{4} \d{4}", got[2])
    assert re.fullmatch(r"\+1 \(\d{3}\) \d{3}-\d{4}", got[3]) and got[3] != texts[3]
    assert re.fullmatch(r"[a-z]@y\.example [a-z]{5}\.\d\d@mail8\.example\.com\.", got[4])
    assert all(int(o) < 256 for o in got[5].split("."))
    assert re.fullmatch(r"(?!000|666|9)\d{3}-(?!00)\d\d-(?!0000)\d{4}", got[6])
    moved = got[7][4:] + got[7][:4]
    assert got[7][:2] == "GB" and int("".join(str(int(c, 36)) for c in moved)) % 97 == 1
    iso, dotted, slashed = got[8].split()
    assert re.fullmatch(r"\d{4}-\d\d-\d\d", iso) and re.fullmatch(r"\d\d\.\d\d\.\d{4}", dotted) and slashed[:2] == dotted[3:5] and slashed[3:5] == dotted[:2]


def test_values_are_linked_across_separators(spark):
    cards = ["4111111111111111", "4111 1111 1111 1111", "4111-1111-1111-1111", "4111-1111 11111111"]
    phones = ["+1 988 555 2485", "+1-988-555-2485", "+1 (988) 555-2485", "(988) 555-2485", "+1.988.555.2485"]
    ibans = ["DE89370400440532013000", "DE89 3704 0044 0532 0130 00", "DE89 3704 0044 0532 0130 00 EUR", "BE68 5390 0754 7034 THIS", "BE68539007547034"]
    got = pseudonyms(spark, cards + phones + ibans)
    digits = [re.sub(r"\D", "", x) for x in got]
    assert len(set(digits[:4])) == 1 and luhn(digits[0]) and digits[0] != cards[0]
    assert len({x[-10:] for x in digits[4:9]}) == 1 and digits[4][-10:] != "9885552485"
    assert [re.sub(r"\d", "0", x) for x in got[:9]] == [re.sub(r"\d", "0", x) for x in cards + phones]
    iban = got[9]
    assert iban != ibans[0] and got[10].replace(" ", "") == iban and got[11] == got[10] + " EUR"
    assert got[12] == " ".join(re.findall(".{1,4}", got[13])) + " THIS" and got[13] != ibans[4]


def brute_permuted(text, key, rounds=4):
    """The character Feistel network in plain Python."""
    left, right = text[: len(text) // 2], text[len(text) // 2 :]
    for k in range(1, rounds + 1):
        digest = hashlib.sha256(f"{key}|{k}|{right}".encode()).hexdigest()
        turn = lambda c, j: next((chr(b + (ord(c) - b + int(digest[2 * (j % 32) : 2 * (j % 32) + 2], 16)) % n) for b, n, e in ((48, 10, "9"), (97, 26, "z"), (65, 26, "Z")) if chr(b) <= c <= e), c)  # noqa: E731, B023
        left, right = right, "".join(turn(c, j) for j, c in enumerate(left))
    return left + right


def test_pseudonyms_equal_a_plain_network(spark):
    r = random.Random(3)
    texts = ["".join(r.choice("abcXYZ0123456789._") for _ in range(r.randrange(1, 20))) for _ in range(300)]
    got = spark.createDataFrame(list(enumerate(texts)), "i int, t string").select("i", pii.permute_characters(F.col("t"), "k").alias("p")).collect()
    assert {x.i: x.p for x in got} == {i: brute_permuted(t, "k") for i, t in enumerate(texts)}
    card = "4111 1111 1111 1111"
    body = "4" + brute_permuted("11111111111111", f"{pii.KEY}|card")
    check = next(d for d in "0123456789" if luhn(body + d))
    assert pseudonyms(spark, [card]) == [" ".join(re.findall("....", body + check))]
    spark.conf.set(pii.KEY_SETTING, "another")
    try:
        assert pseudonyms(spark, [card]) != [" ".join(re.findall("....", body + check))]
    finally:
        spark.conf.unset(pii.KEY_SETTING)


def test_invalid_and_odd_texts_stay(spark):
    texts = ["4041894974608796", "999.1.1.1", "1985-02-30", "000-12-3456", "", None, "v1.2.3", "no 12 numbers @ all"]
    assert pseudonyms(spark, texts) == texts
    assert pii.pseudonymise(docs_of(spark, [(1, "a")]).limit(0)).count() == 0


def test_values_without_two_digits_in_a_row_are_found_alone(spark):
    got = pii.pseudonymise(docs_of(spark, [(0, "8.8.8.8"), (1, "8.8.8.8 of 1999"), (2, "4 0 4 1 8 9 4 9 7 4 6 0 8 7 9 5")])).orderBy("doc_id").collect()
    assert (got[0].n_ip, got[1].n_ip, got[2].n_card) == (1, 1, 1)
    assert got[0].text != "8.8.8.8" and got[1].text == f"{got[0].text} of 1999" and luhn(got[2].text)


def test_national_phones_are_linked_in_all_notations(spark):
    got = pseudonyms(spark, ["988-555-2485", "988.555.2485", "(988) 555-2485", "+1 988 555 2485", "1-988-555-2485-1", "123-45-6789"])
    digits = [re.sub(r"\D", "", x) for x in got]
    assert digits[0] == digits[1] == digits[2] == digits[3][1:] != "9885552485" and got[4] == "1-988-555-2485-1"
    assert re.fullmatch(r"\d{3}-\d{3}-\d{4}", got[0]) and re.fullmatch(r"\d{3}\.\d{3}\.\d{4}", got[1])


def test_permutations_are_one_to_one(spark):
    n = spark.range(189 * 773).select(pii.permute_number(F.col("id"), 189, 773, "k").alias("p"))
    x = n.agg(F.count_distinct("p"), F.min("p"), F.max("p")).first()
    assert tuple(x) == (189 * 773, 0, 189 * 773 - 1)
    c = spark.range(1000).select(pii.permute_characters(F.lpad(F.col("id").cast("string"), 3, "0"), "k").alias("p"))
    assert c.distinct().count() == 1000
    other = spark.range(100).select(pii.permute_number(F.col("id"), 189, 773, "k").alias("a"), pii.permute_number(F.col("id"), 189, 773, "l").alias("b")).where("a = b").count()
    assert other < 5


def test_pii_plan_is_native(spark, sf):
    plan = pii.op9_pii(spark, sf)._jdf.queryExecution().executedPlan().toString()
    assert not any(x in plan for x in ("Python", "Arrow", "Exchange"))


# pipeline


def test_pipeline_drops_what_each_stage_should(spark, tmp_path):
    r = random.Random(9)
    word = lambda: "".join(r.choice("abcdefghij") for _ in range(6))
    text = lambda n: " ".join(word() for _ in range(n))
    leak, base = text(40), text(300)
    docs = [(i, text(80) + (" grumfox" if i % 5 == 0 else ""), "en", "s", 1) for i in range(150)]
    near = base.split()
    near[100] = "changed"
    docs += [(500, base, "en", "s", 1), (501, base.replace(" ", "\n"), "en", "s", 1), (502, " ".join(near), "en", "s", 1), (503, text(200) + " " + leak + " " + text(50), "en", "s", 1), (504, None, "en", "s", 1)]
    for name, rows, schema in (
        ("documents", docs, "doc_id long, text string, lang string, source string, n_chars long"),
        ("labels", [(i, 1, int(i % 5 == 0)) for i in range(150)], "doc_id long, quality int, toxic int"),
        ("benchmark", [(1, leak)], "item_id long, text string"),
    ):
        spark.createDataFrame(rows, schema).write.parquet(f"{tmp_path}/{name}.parquet")
    rows = corpus_pipeline.run(spark, str(tmp_path)).collect()
    assert {x.doc_id for x in rows} == {i for i in range(150) if i % 5} | {500, 504}
    check_packed(rows, 4096)
    assert [n for n, _ in corpus_pipeline.STAGES] == ["toxicity", "exact dedup", "near dedup", "decontamination", "packing"]


def test_packing_hands_texts_to_workers_in_small_batches(spark, monkeypatch):
    """Before, a worker got ten thousand texts at once."""
    from docspark.llm import packing

    seen, stage = [], packing.stage
    monkeypatch.setattr(packing, "stage", lambda df, rows=None: seen.append(rows) or stage(df, rows))
    docs = spark.createDataFrame([(i, "a few words") for i in range(1200)], "doc_id long, text string")
    assert packing.pack_documents(docs).count() == 1200 and seen == [packing.SLICE_ROWS]


def chained_python(plan):
    """The most Python operators on a way through `plan` without an exchange between them: tasks of that stage need as many workers each."""
    most, above = 0, []
    for line in plan.split("\n"):
        depth = len(line) - len(line.lstrip(" :+-"))
        above = [x for x in above if x[0] < depth]
        name = re.sub(r"^\W*(\*\s*)?(\(\d+\)\s*)?", "", line)
        n = above[-1][1] if above else 0
        n = 0 if re.match(r"\w*Exchange", name) else n + bool(re.match("MapInArrow|MapInPandas|ArrowEvalPython|BatchEvalPython", name))
        above.append((depth, n))
        most = max(most, n)
    return most


def test_stages_of_the_pipeline_need_one_python_worker_a_task(spark, monkeypatch):
    """Before, near dedup chained two, which stayed when packing made them all hold words; and the list of lengths started
    workers of RDDs beside those."""
    from docspark.llm import near_dedup

    plans, lists = [], []
    for module in (near_dedup, packing):
        monkeypatch.setattr(module, "stage", lambda df, rows=None, f=module.stage: plans.append(df._jdf.queryExecution().executedPlan().toString()) or f(df, rows))
    r = random.Random(5)
    docs = [(i, " ".join(r.choice("abcdefgh") for _ in range(60))) for i in range(40)]
    docs = spark.createDataFrame(docs + [(i + 100, t + " end") for i, t in docs[:20]], "doc_id long, text string")
    make = type(spark).createDataFrame
    monkeypatch.setattr(type(spark), "createDataFrame", lambda self, data, *a, **b: lists.append(type(data)) or make(self, data, *a, **b))
    kept = near_dedup.drop_near_copies(docs)
    packed = packing.pack_documents(kept)
    assert {x.doc_id for x in packed.collect()} == set(range(40))
    assert sum("MapInArrow" in x for x in plans) >= 3 and max(map(chained_python, plans)) == 1
    assert list not in lists
