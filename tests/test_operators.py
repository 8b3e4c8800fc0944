"""Golden rows for what the tables do not hold: ties, nulls, odd text, files and streams."""

from __future__ import annotations

import json
import uuid

import pytest
from pyspark.sql import functions as F

from docspark.functions import models, strings
from docspark.operators import chunks, facets, filters, quality, search, sections, stats, usage
from docspark.sources import files
from docspark.streaming import jobs


def one(spark, col):
    return spark.range(1).select(col.alias("x")).first()[0]


def test_uuid5_equals_the_standard_library(spark):
    rows = spark.createDataFrame([("https://a.example/1",), ("é",), ("",)], "n string").select("n", strings.uuid5(F.col("n")).alias("u")).collect()
    assert all(r.u == str(uuid.uuid5(uuid.NAMESPACE_URL, r.n)) for r in rows)


@pytest.mark.parametrize("text,value", [("iv", 4), ("XII", 12), ("xlix", 49), ("iiiix", None), ("", None), ("m", None), ("cd", 400)])
def test_roman_numerals(spark, text, value):
    assert one(spark, strings.roman_to_int(F.lit(text))) == value


def test_titles_and_paths(spark):
    assert one(spark, strings.clean_title(F.lit("A report - https://x.example/a"))) == "A report"
    assert one(spark, strings.sanitize_filename(F.lit("Évaluation  Finale!.PDF"))) == "evaluation_finale.pdf"
    assert one(spark, strings.sanitize_filename(F.lit("!!!"))) == "untitled"
    assert one(spark, strings.relative_path(F.lit("/x/data/data/un/pdfs/a.pdf"), F.lit("un"))) == "data/un/pdfs/a.pdf"
    assert one(spark, strings.node_id_from_name(F.lit("a_b_123.pdf"))) == "123"


def test_multi_values(spark):
    assert one(spark, strings.split_multi(F.lit(" a ;; b;"))) == ["a", "b"]
    assert one(spark, strings.split_multivalue(F.lit("0 | b"))) == ["0", "b"]
    assert one(spark, strings.split_multivalue(F.lit("Egypt, Arab Rep."))) == ["Egypt, Arab Rep."]
    assert one(spark, strings.looks_concatenated(F.lit("BangladeshCambodiaIndia")))


def test_mojibake_needs_two_marks(spark):
    assert one(spark, strings.fix_mojibake(F.lit("lÕŽtŽ Õ"))) == "l’été Õ"
    assert one(spark, strings.fix_mojibake(F.lit("lÕŽt"))) == "lÕŽt"


def test_facets_skip_blank_null_and_run_together(spark):
    df = spark.createDataFrame([("a; b",), ("a",), ("",), (None,), ("BangladeshCambodiaIndia",)], "c string")
    assert {(r.value, r.n) for r in facets.facets(df, ["c"]).collect()} == {("a", 2), ("b", 1)}


def test_range_facets(spark):
    df = spark.createDataFrame([("1", "x"), ("2.5", "y"), ("", None)], "n string, t string")
    rows = {r.field: r for r in facets.range_facets(df, ["n", "t"], 1).collect()}
    assert (rows["n"].lo, rows["n"].hi, rows["t"].too_many) == (1.0, 2.5, True)


def test_filters_accept_lists_commas_and_ranges(spark):
    df = spark.createDataFrame([("a", "2019"), ("b", "bad"), ("c", "2021")], "k string, y string")
    assert [r.k for r in df.where(filters.compile_filters({"k": "a, c", "y_min": 2020})).collect()] == ["c"]
    assert filters.filter_min_chars(df, 0, "k").count() == 3


def test_results_keep_the_newest_copy_at_the_first_place(spark):
    rows = [(1, "x ", "2019", 0.9, 1), (1, "x", "2021", 0.1, 2), (1, "y", "bad", 0.5, 3)]
    got = search.dedupe_results(spark.createDataFrame(rows, "query_id int, text string, year string, score double, ord int")).collect()
    assert {(r.year, r.place) for r in got} == {("2021", 1), ("bad", 3)}


def test_minimum_score_index_rule(spark):
    rows = [(1, i, float(i), 10 - i) for i in range(10)]
    got = search.auto_min_score(spark.createDataFrame(rows, "query_id int, doc_id int, score double, ord int"))
    assert sorted(r.score for r in got.collect()) == [3.0, 4.0, 5.0, 6.0, 7.0, 8.0, 9.0]


def test_hybrid_is_symmetric_at_half(spark):
    d = spark.createDataFrame([(1, "a", 1), (1, "b", 2)], "query_id int, doc_id string, ord int")
    s = spark.createDataFrame([(1, "b", 1), (1, "a", 2)], "query_id int, doc_id string, ord int")
    a, b = (search.hybrid_search(x, y, 0.5, 5).collect() for x, y in ((d, s), (s, d)))
    assert sorted((r.doc_id, r.score) for r in a) == sorted((r.doc_id, r.score) for r in b)
    assert a[0].doc_id == "a"


def test_exclusive_boost_drops_the_rest(spark):
    h = spark.createDataFrame([(1, "d1", -1.0, "Nepal, India"), (1, "d2", 2.0, "Chad")], "query_id int, doc_id string, score double, country string")
    known = spark.createDataFrame([("Nepal",), ("Chad",), ("a",)], "value string")
    q = spark.createDataFrame([(1, "floods in nepal a")], "query_id int, query string")
    assert [(r.doc_id, r.score) for r in search.field_boost(h, known, q, "country", 0.5).collect() if r.doc_id == "d1"] == [("d1", -0.5)]
    assert [r.doc_id for r in search.field_boost(h, known, q, "country", 1.0).collect()] == ["d1"]


def test_upsert_and_merge(spark):
    t = spark.createDataFrame([("a", 1), ("b", 2)], "k string, v int")
    u = spark.createDataFrame([("b", 3, 1), ("b", 4, 2), ("c", None, 1)], "k string, v int, o int")
    assert {tuple(r) for r in quality.upsert(t, u, "k", "o").collect()} == {("a", 1), ("b", 4), ("c", None)}
    assert {tuple(r) for r in quality.merge_fields(t, u.select("k", "v").limit(1), "k").collect()} == {("a", 1), ("b", 3)}


def test_repairs(spark):
    assert one(spark, quality.split_sdgs(F.lit("SDG 1 - No Poverty SDG 2 - Zero"))) == "SDG 1 - No Poverty; SDG 2 - Zero"
    assert one(spark, quality.heading_pattern(F.lit("```md\n# A\n```"))) == "code_fence"
    assert one(spark, quality.fix_headings(F.lit("- **Key**\ntext\n### A:"))) == "## Key\ntext\n### A"
    assert one(spark, quality.glyph_ratio(F.lit("GLYPH<1>" * 10 + "x" * 220))) == pytest.approx(80 / 300, abs=1e-6)


def test_toc_round_trip_and_odd_lines(spark):
    text = "[H1] Intro ....... one | page 1\nnoise\n[H2] Part | page ? (iv) [Front]"
    rows = sections.parse_toc(spark.createDataFrame([("d", text)], "doc_id string, toc string")).orderBy("idx").collect()
    assert [(r.level, r.title, r.page, r.roman, r.fm) for r in rows] == [(1, "Intro one", 1, None, False), (2, "Part", None, "iv", True)]


def test_labels_follow_their_parents(spark):
    rows = [("d", 0, 1, "Findings"), ("d", 1, 2, "Finance"), ("d", 2, 2, "Conclusions"), ("d", 3, 3, "More"), ("d", 4, 1, "Else")]
    toc = sections.lock_labels(spark.createDataFrame(rows, "doc_id string, idx int, level int, title string"))
    got = [r.label for r in sections.propagate_labels(toc).orderBy("idx").collect()]
    assert got == ["findings", "findings", "conclusions", "conclusions", "other"]


def test_chunks_keep_order_and_budget(spark):
    rows = [("d", i, "w " * n, 1) for i, n in enumerate((3, 3, 5, 1))]
    got = chunks.build_chunks(spark.createDataFrame(rows, "doc_id string, pos int, text string, page_num int"), 6).orderBy("chunk").collect()
    assert [r.tokens for r in got] == [6, 6]


def test_windows_over_text(spark):
    got = chunks.split_overlap(spark.createDataFrame([("d", "0123456789"), ("e", ""), ("f", None)], "doc_id string, t string"), "t", 4, 1).orderBy("part").collect()
    assert [r.text for r in got] == ["0123", "3456", "6789"]


def test_lockouts_restart_after_success(spark):
    rows = [(i, 1, f"2024-01-01 00:00:{i:02d}", i != 3) for i in range(12)]
    e = spark.createDataFrame(rows, "event_id int, user_id int, ts string, failed boolean")
    assert [r.event_id for r in usage.lockouts(e).collect()] == [8]


def test_settings_of_the_first_group_even_null(spark):
    g = spark.createDataFrame([("b", {"x": "1"}), ("a", {"x": None, "y": "2"})], "name string, settings map<string,string>")
    assert {tuple(r) for r in stats.effective_settings(g).collect()} == {("x", None), ("y", "2")}


def test_files_are_scanned_and_resolved(spark, tmp_path):
    for name, body in {"a/r1.json": json.dumps({"title": "T", "filename": "other.pdf"}), "a/bad.json": "{", "a/parsed/x.json": "{}", "a/r1.pdf": "x", "a/other.pdf": "y", "a/e.error": json.dumps({"error_message": "gone"}), "a/f.error": "plain"}.items():
        (tmp_path / name).parent.mkdir(parents=True, exist_ok=True)
        (tmp_path / name).write_text(body)
    meta = files.scan_metadata(spark, str(tmp_path))
    assert {(r.path.rsplit("/", 1)[1], r.broken) for r in meta.collect()} == {("r1.json", False), ("bad.json", True)}
    assert {r.message for r in files.scan_errors(spark, str(tmp_path)).collect()} == {"gone", "plain"}
    content = files.scan_content(spark, str(tmp_path))
    found = files.resolve_content(meta.select("path", F.try_element_at("fields", F.lit("filename")).alias("filename")), content.select("path"))
    assert {r.content and r.content.rsplit("/", 1)[1] for r in found.collect() if r.path.endswith("r1.json")} == {"other.pdf"}


def test_models_are_pluggable(spark):
    models.register("shout", lambda texts: [(t or "").upper() for t in texts])
    assert models.apply(spark.createDataFrame([("a",), (None,)], "t string"), "shout", "t", "loud string").collect()[0].loud == "A"


def events_stream(spark, tmp_path, rows, schema):
    spark.createDataFrame(rows, schema).withColumn("ts", F.col("ts").cast("timestamp")).write.parquet(str(tmp_path / "in"))
    return spark.readStream.schema(spark.read.parquet(str(tmp_path / "in")).schema).parquet(str(tmp_path / "in"))


def test_streamed_hours_equal_the_batch(spark, sf, tmp_path):
    e = spark.read.parquet(f"{sf}/events.parquet").select("event_id", "event_type", F.col("ts").cast("timestamp").alias("ts"))
    e.write.parquet(str(tmp_path / "in"))
    s = spark.readStream.schema(e.schema).parquet(str(tmp_path / "in"))
    jobs.run_once(jobs.hourly_counts(s), "hours", "complete")
    want = e.groupBy(F.date_trunc("hour", "ts").alias("hour"), "event_type").agg(F.count("*").alias("n"))
    assert {tuple(r) for r in spark.table("hours").collect()} == {tuple(r) for r in want.collect()}


def test_streamed_lockouts(spark, tmp_path):
    rows = [(i, 1, f"2024-01-01 00:00:{i:02d}", i != 3) for i in range(12)]
    s = events_stream(spark, tmp_path, rows, "event_id int, user_id long, ts string, failed boolean")
    jobs.run_once(jobs.lockouts(s), "locks")
    assert [tuple(r) for r in spark.table("locks").collect()] == [(1, 1)]


def test_streamed_upsert_keeps_the_last_row(spark, tmp_path):
    rows = [(1, "a", f"2024-01-01 00:00:0{i}", i) for i in range(4)]
    s = events_stream(spark, tmp_path, rows, "user_id long, item string, ts string, score int")
    jobs.upsert_stream(s, str(tmp_path / "out"), ["user_id", "item"], "ts", str(tmp_path / "cp")).awaitTermination()
    assert [r.score for r in spark.read.parquet(str(tmp_path / "out" / "v=0")).collect()] == [3]


def stages_stream(spark, tmp_path, rows):
    return events_stream(spark, tmp_path, rows, "doc_id string, ts string, finished boolean")


def test_only_open_stages_time_out(spark, tmp_path):
    """One document never ends, one ends, one ends and opens another stage; the clock goes on with a fourth."""
    for k, (rows) in enumerate(([("a", "2024-01-01 00:00:00", False), ("b", "2024-01-01 00:00:00", False), ("c", "2024-01-01 00:00:00", False)], [("b", "2024-01-01 00:10:00", True), ("c", "2024-01-01 00:10:00", True)], [("c", "2024-01-01 00:20:00", False)], [("z", "2024-01-01 09:00:00", True)], [("z", "2024-01-01 09:00:01", True)])):
        spark.createDataFrame(rows, "doc_id string, ts string, finished boolean").withColumn("ts", F.col("ts").cast("timestamp")).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
    s = spark.readStream.schema("doc_id string, ts timestamp, finished boolean").option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in"))
    q = jobs.stage_timeouts(s).writeStream.format("memory").queryName("timeouts").outputMode("append").trigger(availableNow=True).option("checkpointLocation", str(tmp_path / "cp")).start()
    q.awaitTermination()
    assert sorted(tuple(r) for r in spark.table("timeouts").collect()) == [("a", "stopped"), ("c", "stopped")]


def test_streamed_duplicates_rates_and_sessions_equal_the_batch(spark, tmp_path):
    rows = [(i, i % 2, f"2024-01-01 0{i // 20}:{i % 20:02d}:00", str(i % 7)) for i in range(60)] + [(100 + i, 9, f"2024-01-02 00:00:{i:02d}", f"u{i}") for i in range(14)]
    s = events_stream(spark, tmp_path, rows, "event_id int, user_id long, ts string, sys_file_checksum string")
    e = spark.read.parquet(str(tmp_path / "in"))
    jobs.run_once(jobs.mark_duplicates(s, "2 days"), "firsts")
    assert spark.table("firsts").count() == e.select("sys_file_checksum").distinct().count()
    jobs.run_once(jobs.rate_breaches(s), "breaches", "complete")
    got = {(r.user_id, r.attempts) for r in spark.table("breaches").collect()}
    want = {(r.user_id, r.attempts) for r in usage.rate_breaches(e).collect()}
    assert want and {u for u, _ in got} == {u for u, _ in want} and max(n for _, n in got) == max(n for _, n in want)
    jobs.run_once(jobs.sessions(s), "visits", "complete")
    assert {tuple(r) for r in spark.table("visits").collect()} == {(r.user_id, r.start_at, r.events) for r in usage.sessions(e).collect()}


def test_ingest_follows_scans(spark, tmp_path):
    shape = "doc_id string, sys_status string, sys_file_checksum string, sys_metadata_checksum string, sys_error_checksum string, ts string"
    for rows in ([("a", "downloaded", "1", "m", None, "2024-01-01 00:00:00"), ("b", "download_error", None, "m", "e", "2024-01-01 00:00:00")], [("a", "downloaded", "2", "m", None, "2024-01-01 00:01:00"), ("b", "downloaded", "9", "m", None, "2024-01-01 00:01:00"), ("c", "downloaded", "3", "m", None, "2024-01-01 00:01:00")]):
        spark.createDataFrame(rows, shape).withColumn("ts", F.col("ts").cast("timestamp")).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
    s = spark.readStream.schema(shape.replace("ts string", "ts timestamp")).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in"))
    jobs.ingest(s, str(tmp_path / "out"), str(tmp_path / "cp")).awaitTermination()
    got = {(r.doc_id, r.sys_status, r.sys_file_checksum, r.change) for r in spark.read.parquet(str(tmp_path / "out" / "v=1")).collect()}
    assert got == {("a", "downloaded", "2", "file"), ("b", "downloaded", "9", "status_change"), ("c", "downloaded", "3", "new")}


def test_texts_are_repaired(spark):
    from docspark.operators import texts

    given = ["Mee\ufffdng D\ufffdmo cr\ufffdque \uf0b7", "[3] note\n[^4]: kept ^5", "D a t a   s o u r c e s of a b", "plain"]
    want = ["Meeting Démo cratique •", "[[^3]] note\n[[^4]]: kept [^5]", "Data sources of a b", "plain"]
    rows = spark.createDataFrame(list(enumerate(given)), "i int, t string").select("i", texts.repair_chunk_text(F.col("t")).alias("t")).orderBy("i").collect()
    assert [r.t for r in rows] == want


def test_balanced_parts_end_at_blank_lines(spark):
    from docspark.operators import texts

    text = "a" * 950 + "\n\n" + "b" * 1000 + "c" * 100
    got = spark.createDataFrame([(text,)], "t string").select(texts.split_balanced(F.col("t"), 1100).alias("p")).first().p
    assert "".join(got) == text and got[0] == "a" * 950 + "\n\n"


def test_flat_folders_and_accents_are_resolved(spark):
    from docspark.sources import files

    meta = spark.createDataFrame([("d/e\u0301.json", None), ("d/x.json", "gone.pdf"), ("d/y.json", "named.docx")], "path string, filename string")
    there = spark.createDataFrame([("d/\u00e9.pdf",), ("d/x.doc",), ("d/named.docx",), ("d/y.pdf",), ("e/x.pdf",)], "path string")
    assert {(r.path, r.content) for r in files.resolve_content(meta, there).collect()} == {("d/e\u0301.json", "d/\u00e9.pdf"), ("d/x.json", "d/x.doc"), ("d/y.json", "d/named.docx")}


def test_results_are_shaped_in_order(spark):
    """Size, re-ranking, recency, limit, boost and duplicates, one after the other."""
    from docspark.operators import search

    hits = [(1, f"c{i}", "d", 1.0 - i / 10, i + 1, "x" * (5 if i == 0 else 50) + (" match" if i == 3 else ""), "2024", "unit") for i in range(6)]
    h = spark.createDataFrame(hits, "query_id int, chunk_id string, doc_id string, score double, ord int, text string, year string, org string")
    queries = spark.createDataFrame([(1, "match")], "query_id int, query string")
    got = search.post_search(h, queries, min_chars=10, scorer="scorer", rerank_first=4, limit=4, deduplicate=True).orderBy("ord").collect()
    assert [r.chunk_id for r in got] == ["c3", "c1"]  # the scorer likes the word; the others have one text


def test_levels_equal_a_stack(spark):
    import random
    import re as regex

    from docspark.operators import layout

    r, rows, want = random.Random(5), [], {}
    for d in range(60):
        entries = [(f"d{d}", i, r.randrange(2, 6), r.choice(["", "", f"{r.randrange(1, 5)}. ", f"{r.randrange(1, 5)}.{r.randrange(1, 4)} ", f"{r.randrange(1, 4)}.1.2 "]) + r.choice(["Text", "Text", "Text", "Annex"] if i > 6 else ["Text"]), r.random() < 0.1) for i in range(12)]
        rows += entries
        base, stack, last, back, levels = min(e[2] for e in entries), [], None, False, []
        for _, _, level, title, front in entries:
            while stack and level <= stack[-1][0]:
                stack.pop()
            back = back or "Annex" in title
            number = regex.match(r"[\d.]*\d", title)
            depth = number[0].count(".") + 1 if number else 0
            if depth and (front or back):
                levels.append(level)
                continue
            if depth and (last is None or int(number[0].split(".")[0]) >= last):
                last = int(number[0].split(".")[0])
                levels.append(base + depth - 1)
                stack.append((level, levels[-1] - level))
            else:
                levels.append(max(1, level + stack[-1][1]) if stack else level)
        want |= {(f"d{d}", i): max(1, x - min(levels) + 1) for i, x in enumerate(levels)}
    got = layout.normalize_levels(spark.createDataFrame(rows, "doc_id string, idx int, level int, title string, fm boolean"))
    assert {(x.doc_id, x.idx): x.level for x in got.collect()} == want


def test_languages_are_voted(spark):
    from docspark.operators import layout

    en, fr = "the cat and the dog of this house is in " * 8, "le chat et les chiens dans une maison que pour la " * 8
    rows = [("a", p, fr if p < 1 else en) for p in range(30)] + [("b", 0, fr), ("b", 1, fr), ("c", 0, "the")]
    got = layout.vote_language(spark.createDataFrame(rows, "doc_id string, page int, text string"))
    assert {r.doc_id: r.language for r in got.collect()} == {"a": "en", "b": "fr", "c": "Unknown"}
    noted = spark.createDataFrame([("a", "en"), ("b", "de"), ("c", "en")], "doc_id string, map_language string")
    assert [tuple(r) for r in layout.changed_languages(noted, got).collect()] == [("b", "de", "fr")]


def test_paragraphs_follow_large_gaps(spark):
    from docspark.operators import layout

    text = "A a. b. Bb. c. Cc. d. Dd. e. Ee. f. Ff. g."
    boxes = [[0.0, 10.0 * k, 9.0, 10.0 * k + 9] for k in range(5)] + [[0.0, 200.0, 9.0, 209.0]]
    got = spark.createDataFrame([(text, boxes), (text, boxes[:2])], "t string, b array<array<double>>").select(layout.infer_paragraphs(F.col("t"), F.col("b")).alias("p")).collect()
    assert got[1].p == text and got[0].p.replace("\n\n", "") == text


def test_plans_of_relational_operators_stay_native(spark, sf):
    from docspark.plans import registry

    registry.load()
    for name in ("d03_breakdown", "e08_propagate_labels", "f02_bm25_search", "c03_asof_section", "d06_org_flows"):
        plan = registry.QUERIES[name](spark, sf)._jdf.queryExecution().executedPlan().toString()
        assert not any(x in plan for x in ("Python", "Arrow", "CartesianProduct")), name


def test_contaminated_documents_are_reset_whatever_their_length(spark):
    rows = [("a", "GLYPH<1>" * 1000 + "x" * 2000, "indexed"), ("b", "/gid00001" * 10 + "x" * 811, "indexed"), ("c", "/gid00001" * 10 + "x" * 810, "parsed"), ("d", "GLYPH<1>" * 24, "parsed"), ("e", None, "parsed")]
    got = quality.reset_contaminated(spark.createDataFrame(rows, "doc_id string, text string, sys_status string"), "text").collect()
    assert {(r.doc_id, r.sys_status, r.sys_error_message) for r in got} == {(k, "downloaded", "Reset: glyph contamination in parsed output") for k in "ac"}


def test_large_tables_are_dealt_into_more_partitions(spark, monkeypatch):
    from docspark.sources import shared

    monkeypatch.setattr(shared, "ROWS_A_TASK", 10)
    df = spark.range(100).select(F.col("id").alias("doc_id"))
    assert shared.dealt(df, "doc_id").rdd.getNumPartitions() == 10 and shared.dealt(df, "doc_id").count() == 100
    assert shared.dealt(df.where("doc_id < 30"), "doc_id").rdd.getNumPartitions() == df.rdd.getNumPartitions()


def test_a_mean_vector_goes_through_sums_of_stretches(spark):
    """Before, a row for each place of each vector was counted; ids come in any order, and places may be missing."""
    from docspark.operators import chunks

    rows = [("a", [1.0, 2.0]), ("a", [3.0, None]), ("b", None), ("b", []), ("c", [1.0]), (None, [5.0]), (None, [7.0]), ("a", [5.0, 6.0, 7.0]), ("c", [2.0, 4.0])]
    df = spark.createDataFrame(rows, "doc_id string, vector array<double>").coalesce(1)
    got = df.mapInArrow(chunks._summed, "doc_id string, sums array<double>, counts array<long>").collect()
    assert sorted(map(tuple, (r for r in got if r.doc_id == "a"))) == [("a", [4.0, 2.0], [2, 1]), ("a", [5.0, 6.0, 7.0], [1, 1, 1])]
    assert [tuple(r) for r in got if r.doc_id == "b"] == [("b", [], [])]
    assert [tuple(r) for r in got if r.doc_id == "c"] == [("c", [1.0], [1]), ("c", [2.0, 4.0], [1, 1])]
    assert len([r for r in got if r.doc_id is None]) == 2
    s = spark.createDataFrame([(d, i, f"s{i}", v) for i, (d, v) in enumerate([("x", [1.0, 0.0]), ("x", [0.0, 1.0]), ("x", [1.0, 0.1]), ("y", None)])], "doc_id string, pos int, sentence string, vector array<float>")
    assert [tuple(r) for r in chunks.centroid_summary(s, 2).collect()] == [("x", "s0\n---\ns2")]
