"""Registered queries over chunk texts, elements, repairs and incremental upkeep."""

from __future__ import annotations

from pyspark.sql import functions as F

from docspark.functions import models, strings
from docspark.operators import chunks as ch
from docspark.operators import elements as el
from docspark.operators import layout, repairs, texts
from docspark.plans.registry import query
from docspark.plans.views import view


def chunks(spark, sf):
    return view(spark, sf, "v_chunks")


def docs(spark, sf):
    return view(spark, sf, "v_docs")


K = "CAST(doc_id AS INT)"
DOCS = "docs AS (SELECT doc_id, sys_status, sys_file_checksum, map_title, map_language FROM v_docs)"


@query("h10_change_type", f"""WITH {DOCS}, o AS (SELECT doc_id, sys_status AS s, CASE WHEN {K} % 4 = 0 THEN NULL WHEN {K} % 4 = 1 THEN sys_file_checksum ELSE 'old' END AS f, CASE WHEN {K} % 3 = 0 THEN map_title ELSE 'x' END AS m FROM docs WHERE {K} % 9 <> 0),
n AS (SELECT doc_id, CASE WHEN {K} % 5 = 0 THEN 'download_error' ELSE 'downloaded' END AS s, sys_file_checksum AS f, coalesce(map_title, '') AS m FROM docs)
SELECT n.doc_id, CASE WHEN o.doc_id IS NULL THEN 'new' WHEN n.s = 'downloaded' AND coalesce(o.s NOT IN ('downloaded', 'parsing', 'parsed', 'summarizing', 'summarized', 'tagging', 'tagged', 'indexing', 'indexed'), true) THEN 'status_change' WHEN n.s <> 'downloaded' AND o.s IS DISTINCT FROM n.s THEN 'status_change'
WHEN n.s = 'downloaded' AND o.f <> n.f AND o.m <> n.m AND o.m <> '' THEN 'both' WHEN n.s = 'downloaded' AND o.f <> n.f THEN 'file' WHEN n.s = 'downloaded' AND o.m <> n.m AND o.m <> '' THEN 'metadata' WHEN n.s <> 'downloaded' AND o.m <> n.m AND o.m <> '' THEN 'download_error' ELSE 'unchanged' END AS change,
CASE WHEN n.s = 'downloaded' AND o.s <> 'download_error' THEN o.s ELSE n.s END AS effective_status FROM n LEFT JOIN o ON n.doc_id = o.doc_id""")
def h10(spark, sf):
    d, k = docs(spark, sf), F.col("doc_id").cast("int")
    none = F.lit(None).cast("string")
    old = d.where(k % 9 != 0).select("doc_id", "sys_status", F.when(k % 4 == 1, F.col("sys_file_checksum")).when(k % 4 > 1, "old").alias("sys_file_checksum"), F.when(k % 3 == 0, F.col("map_title")).otherwise("x").alias("sys_metadata_checksum"), none.alias("sys_error_checksum"))
    new = d.select("doc_id", F.when(k % 5 == 0, "download_error").otherwise("downloaded").alias("sys_status"), "sys_file_checksum", F.coalesce("map_title", F.lit("")).alias("sys_metadata_checksum"), none.alias("sys_error_checksum"))
    return repairs.change_type(new, old).select("doc_id", "change", "effective_status")


@query("t09_clean_elements", r"""WITH e AS (SELECT doc_id, pos, CASE WHEN pos % 3 = 0 AND CAST(doc_id AS INT) % 2 = 0 THEN 'image' WHEN pos % 7 = 6 THEN 'table' WHEN pos % 5 = 4 THEN 'image' ELSE 'text' END AS kind, CASE WHEN pos % 4 = 1 THEN 'prov_' || text ELSE text END AS text FROM v_chunks),
f AS (SELECT doc_id, min(pos) AS p, arg_min(regexp_matches(lower(trim(text)), '^(figure|table|diagram)'), pos) AS c FROM e WHERE kind = 'text' GROUP BY 1)
SELECT e.doc_id AS chunk_id, pos FROM e LEFT JOIN f ON e.doc_id = f.doc_id WHERE NOT coalesce(kind = 'image' AND NOT c AND pos < p, false) AND NOT (kind = 'text' AND length(trim(text)) < 100 AND regexp_matches(lower(trim(text)), 'best\s+match.*score.*\d+|\[sheet:.*\]|sheet:.*score|^prov[_\s]|^otsl[_\s]'))""")
def t09(spark, sf):
    kind = F.when((F.col("pos") % 3 == 0) & (F.col("doc_id").cast("int") % 2 == 0), "image").when(F.col("pos") % 7 == 6, "table").when(F.col("pos") % 5 == 4, "image").otherwise("text")
    text = F.when(F.col("pos") % 4 == 1, F.concat(F.lit("prov_"), "text")).otherwise(F.col("text"))
    rows = chunks(spark, sf).select(F.col("doc_id").alias("chunk_id"), "pos", kind.alias("element_type"), F.lit("").alias("label"), text.alias("text"))
    return texts.clean_elements(rows).select("chunk_id", "pos")


@query("t04_inline_refs", """SELECT chunk_id, n AS number, CAST(length(text) + CASE k WHEN 1 THEN 2 WHEN 2 THEN 8 ELSE 18 END AS INT) AS position, CASE k WHEN 1 THEN 'geometric_caret' WHEN 2 THEN 'geometric_caret' ELSE 'html_tag' END AS pattern
FROM (SELECT chunk_id, text, 100 + pos % 50 AS n, unnest([1, 2, 3]) AS k FROM v_chunks) q""")
def t04(spark, sf):
    n = (F.col("pos") % 50 + 100).cast("string")
    c = chunks(spark, sf).select("chunk_id", F.concat("text", F.lit(" ^"), n, F.lit(" [^"), n, F.lit("] <sup>"), n, F.lit("</sup> ^999")).alias("text"), F.array(F.col("pos") % 50 + 100).alias("notes"))
    return texts.inline_refs(c)


@query("t32_parse_labels", """SELECT doc_id, idx, label FROM (SELECT doc_id, idx, CASE idx % 3 WHEN 0 THEN 'findings' WHEN 1 THEN 'other' END AS label FROM v_toc) q WHERE label IS NOT NULL""")
def t32(spark, sf):
    label = F.when(F.col("idx") % 3 == 0, "findings").when(F.col("idx") % 3 == 1, " other ").otherwise("nonsense")
    items = F.array_sort(F.collect_list(F.struct(F.col("idx").alias("idx"), label.alias("label"))))
    twice = F.concat(items, F.array(F.struct(F.lit(0).alias("idx"), F.lit("annexes").alias("label"))))
    out = view(spark, sf, "v_toc").groupBy("doc_id").agg(twice.alias("items"))
    return texts.parse_labels(out.select("doc_id", F.concat(F.lit("Here you are:\n"), F.to_json("items"), F.lit("\nDone.")).alias("output")))


@query("t14_toc_from_text", r"""WITH l AS (SELECT doc_id, pos, trim(text) AS line, page_num FROM v_chunks)
SELECT doc_id, title, level, page FROM (SELECT *, row_number() OVER (PARTITION BY doc_id, lower(title) ORDER BY pos) AS k FROM (
SELECT doc_id, pos, page_num AS page, CASE WHEN pos % 6 = 5 THEN 'Methodology' ELSE CAST(pos AS STRING) || '.2. ' || regexp_extract(line, '^([A-ZÀÁÂÃÄÅÆÇÈÉÊËÌÍÎÏÐÑÒÓÔÕÖØÙÚÛÜÝÞ][^\n]{3,80})$', 1) END AS title, CASE WHEN pos % 6 = 5 THEN 2 ELSE 3 END AS level
FROM l WHERE pos % 6 = 5 OR regexp_matches(line, '^[A-ZÀÁÂÃÄÅÆÇÈÉÊËÌÍÎÏÐÑÒÓÔÕÖØÙÚÛÜÝÞ][^\n]{3,80}$')) q) r WHERE k = 1 AND length(title) < 80""")
def t14(spark, sf):
    c = chunks(spark, sf)
    line = F.concat(F.lit("------- Page "), F.col("page_num").cast("string"), F.lit(" -------\n"), F.when(F.col("pos") % 6 == 5, "Methodology").otherwise(F.concat(F.col("pos").cast("string"), F.lit(".2 "), F.trim("text"))))
    whole = c.groupBy("doc_id").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("pos", line.alias("line")))), lambda x: x["line"]), "\n").alias("text"))
    return texts.toc_from_text(whole).where("length(title) < 80 OR title = 'Methodology'").select("doc_id", "title", "level", "page")


@query("k03_fix_taxonomy_labels", """SELECT doc_id, CASE CAST(doc_id AS INT) % 3 WHEN 0 THEN 'sdg1 - No Poverty' WHEN 1 THEN 'sdg2 - Zero Hunger' ELSE 'sdg99 - ' || map_language END AS tag FROM v_docs""")
def k03(spark, sf):
    k = F.col("doc_id").cast("int") % 3
    tag = F.when(k == 0, "sdg1").when(k == 1, F.concat(F.lit("sdg2 - "), "map_language")).otherwise(F.concat(F.lit("sdg99 - "), "map_language"))
    return docs(spark, sf).select("doc_id", F.explode(repairs.fix_taxonomy_labels(F.array(tag), {"sdg1": "No Poverty", "sdg2": "Zero Hunger"})).alias("tag"))


@query("k09_flat_tags", """SELECT doc_id, 'tag_sdg' AS field, CASE WHEN CAST(doc_id AS INT) % 2 = 0 THEN 'c' || map_language ELSE 'c' || map_language || ' - ' || map_document_type END AS tag FROM v_docs WHERE map_language IS NOT NULL""")
def k09(spark, sf):
    name = F.when(F.col("doc_id").cast("int") % 2 == 1, F.col("map_document_type"))
    one = F.array(F.struct(F.concat(F.lit("c"), "map_language").alias("code"), name.alias("name")))
    flat = repairs.flat_tags(F.create_map(F.lit("sdg"), one, F.lit("none"), F.filter(one, lambda x: x["code"].isNull())))
    return docs(spark, sf).select("doc_id", F.explode(flat).alias("field", "tags")).select("doc_id", "field", F.explode("tags").alias("tag"))


@query("k15_flatten_nested", """SELECT doc_id, map_language AS lang FROM v_docs WHERE map_language IS NOT NULL""")
def k15(spark, sf):
    own = F.to_json(F.struct("map_language"))
    record = F.when(F.col("doc_id").cast("int") % 2 == 0, F.concat(F.lit('{"sys_data": '), own, F.lit("}"))).otherwise(own)
    return docs(spark, sf).where("map_language is not null").select("doc_id", F.get_json_object(repairs.flatten_nested(record), "$.map_language").alias("lang"))


@query("h11_make_stage", """SELECT event_id, '{"success":' || CAST(success AS STRING) || ',"at":"' || strftime("at", '%Y-%m-%dT%H:%M:%SZ') || '"' || CASE WHEN success THEN '' ELSE ',"error":"bad ' || stage || '"' END || ',"stage":"' || stage || '"}' AS entry FROM v_stage_events""")
def h11(spark, sf):
    e = view(spark, sf, "v_stage_events")
    return e.select("event_id", repairs.make_stage(F.col("success"), F.col("at"), F.when(~F.col("success"), F.concat(F.lit("bad "), "stage")), stage=F.col("stage")).alias("entry"))


@query("h24_bbox", """SELECT chunk_id, CASE WHEN pos % 4 = 0 THEN pos + 7 WHEN pos % 4 < 3 THEN page_num END AS page, CASE WHEN pos % 4 < 3 THEN CAST(pos AS DOUBLE) END AS l, CASE WHEN pos % 4 < 3 THEN 2.5 END::DOUBLE AS t FROM v_chunks""")
def h24(spark, sf):
    p = F.col("pos").cast("string")
    box = F.concat(F.lit("["), p, F.lit(", 1, 3, 2.5]"))
    k = F.col("pos") % 4
    record = F.when(k == 0, F.concat(F.lit("["), (F.col("pos") + 7).cast("string"), F.lit(", "), box, F.lit("]"))).when(k == 1, box).when(k == 2, F.concat(F.lit('{"l": '), p, F.lit(', "b": 1, "r": 3, "t": 2.5}'))).otherwise("[1, 2]")
    b = chunks(spark, sf).select("chunk_id", repairs.bbox(record, F.col("page_num")).alias("b"))
    return b.select("chunk_id", "b.page", "b.l", "b.t")


@query("d11_build_facets", """SELECT 'map_language' AS field, CASE map_language WHEN 'en' THEN 'English' WHEN 'de' THEN 'German' WHEN 'fr' THEN 'French' WHEN 'es' THEN 'Spanish' ELSE map_language END AS value, count(*) AS n FROM v_docs WHERE map_language <> '' GROUP BY 2
UNION ALL SELECT 'map_published_year', map_published_year, count(*) FROM v_docs WHERE map_published_year <> '' GROUP BY 2 UNION ALL SELECT 'map_document_type', map_document_type, count(*) FROM v_docs GROUP BY 2 UNION ALL SELECT 'tag_page', 'p' || CAST(page_num % 3 AS STRING), count(*) FROM v_chunks GROUP BY 2""")
def d11(spark, sf):
    c = chunks(spark, sf).withColumn("tag_page", F.concat(F.lit("p"), (F.col("page_num") % 3).cast("string")))
    return repairs.build_facets(docs(spark, sf), c, ["title", "map_language", "map_published_year", "map_document_type", "tag_page"])


@query("j06_translate", """SELECT chunk_id, CASE WHEN map_language = 'en' THEN text ELSE '[en] ' || text END AS translated FROM v_chunks c JOIN v_docs d ON c.doc_id = d.doc_id""")
def j06(spark, sf):
    models.register("translator", lambda values: [f"[en] {x or ''}" for x in values])
    c = chunks(spark, sf).join(docs(spark, sf).select("doc_id", "map_language"), "doc_id")
    return repairs.translate(c, "en").select("chunk_id", "translated")


@query("j05_run_taggers", """SELECT doc_id, CASE WHEN map_language = 'en' THEN 'English' ELSE map_language END AS map_language, CASE WHEN length(sys_full_summary) > 2000 THEN 'long' END AS size, map_language = 'en' OR length(sys_full_summary) > 2000 AS changed FROM v_docs""")
def j05(spark, sf):
    named = lambda d: d.withColumn("map_language", F.when(F.col("map_language") == "en", "English").otherwise(F.col("map_language")))
    sized = lambda d: d.withColumn("size", F.when(F.length("sys_full_summary") > 2000, "long"))
    return repairs.run_taggers(docs(spark, sf), {"language": named, "size": sized}).select("doc_id", "map_language", "size", "changed")


@query("a06_read_docs", """SELECT doc_id, map_title FROM v_docs WHERE CAST(doc_id AS INT) % 5 = 0""")
def a06(spark, sf):
    wanted = docs(spark, sf).where(F.col("doc_id").cast("int") % 5 == 0).select("doc_id")
    return repairs.read_rows(docs(spark, sf), ["doc_id", "map_title"], wanted)


@query("c06_recover_tables", """WITH t AS (SELECT doc_id, page_num AS table_idx, pos % 3 AS "row", trim(text) AS cell FROM v_chunks WHERE page_num <= 3 AND length(trim(text)) BETWEEN 4 AND 60)
SELECT chunk_id, min(table_idx) AS table_idx FROM (SELECT c.chunk_id, table_idx, count(DISTINCT cell) AS n FROM (SELECT doc_id, doc_id AS chunk_id, string_agg(text, ' ') AS text FROM v_chunks WHERE page_num <= 2 GROUP BY 1) c JOIN t ON t.doc_id = c.doc_id AND contains(c.text, t.cell) GROUP BY 1, 2) q WHERE n >= 2 GROUP BY 1""")
def c06(spark, sf):
    c = chunks(spark, sf)
    cells = c.where("page_num <= 3 AND length(trim(text)) BETWEEN 4 AND 60").select("doc_id", F.col("page_num").alias("table_idx"), (F.col("pos") % 3).alias("row"), F.lit(0).alias("col"), "text")
    whole = c.where("page_num <= 2").groupBy("doc_id").agg(F.array_join(F.collect_list("text"), " ").alias("text")).withColumn("chunk_id", F.col("doc_id"))
    return el.recover_tables(whole, cells)


@query("f16_centroid_summary")
def f16(spark, sf):
    c = chunks(spark, sf).select("doc_id", "pos", F.col("text").alias("sentence"))
    return ch.centroid_summary(models.apply(c, "embedder", "sentence", "vector array<float>"))


@query("e18_normalize_levels")
def e18(spark, sf):
    t = view(spark, sf, "v_toc")
    number = F.when(F.col("idx") % 2 == 0, F.concat(F.floor(F.col("idx") / 2 + 1).cast("string"), F.when(F.col("level") > 1, ".1 ").otherwise(". "))).otherwise("")
    return layout.normalize_levels(t.withColumn("title", F.concat(number, "title"))).select("doc_id", "idx", "level")


@query("t17_annotate_front", """WITH l AS (SELECT DISTINCT doc_id, page FROM v_toc WHERE page <= 5), e AS (SELECT doc_id, max(page) AS p FROM (SELECT doc_id, page, page - row_number() OVER (PARTITION BY doc_id ORDER BY page) * 2 AS g FROM l) q GROUP BY 1)
SELECT t.doc_id, idx, CASE t.page WHEN 1 THEN 'i' WHEN 3 THEN 'iii' WHEN 5 THEN 'v' END AS roman, t.page <= 5 AS fm FROM v_toc t""")
def t17(spark, sf):
    t = view(spark, sf, "v_toc")
    ids = t.select("doc_id").distinct()
    labels = ids.select("doc_id", F.explode(F.array(*(F.struct(F.lit(i + 1).alias("page"), F.lit(r).alias("label")) for i, r in enumerate(("i", "ii", "iii", "iv", "v"))))).alias("l")).select("doc_id", "l.*")
    return layout.annotate_front(t, labels, ids.withColumn("total_pages", F.lit(60))).select("doc_id", "idx", "roman", "fm")


@query("t24_superscripts", """SELECT chunk_id AS line_id, 2 AS pos, CAST(pos % 1000 AS STRING) AS token FROM v_chunks WHERE pos % 3 = 0""")
def t24(spark, sf):
    """Three spans a line, of which the last is a small number, raised in every third."""
    c = chunks(spark, sf)
    raised = F.when(F.col("pos") % 3 == 0, 90.0).when(F.col("pos") % 3 == 1, 99.5).otherwise(100.0)
    number = F.struct(F.lit(2).alias("pos"), (F.col("pos") % 1000).cast("string").alias("text"), F.when(F.col("pos") % 3 == 2, 10.0).otherwise(6.0).alias("size"), raised.alias("origin"))
    body = [F.struct(F.lit(i).alias("pos"), F.col("text").alias("text"), F.lit(10.0).alias("size"), F.lit(100.0).alias("origin")) for i in range(2)]
    spans = c.select(F.col("chunk_id").alias("line_id"), F.explode(F.array(*body, number)).alias("s")).select("line_id", "s.*").withColumns({"top": F.col("origin") - F.col("size"), "bottom": F.col("origin")})
    return layout.superscripts(spans)


@query("e19_infer_paragraphs")
def e19(spark, sf):
    boxes = F.array(*(F.array(*map(F.lit, b)) for b in ([0.0, 0.0, 9.0, 10.0], [0.0, 11.0, 9.0, 20.0], [0.0, 21.0, 9.0, 30.0], [0.0, 31.0, 9.0, 40.0], [0.0, 41.0, 9.0, 50.0], [0.0, 90.0, 9.0, 99.0])))
    return chunks(spark, sf).select("chunk_id", layout.infer_paragraphs(F.col("text"), boxes).alias("text"))


@query("t25_vote_language")
def t25(spark, sf):
    return layout.vote_language(chunks(spark, sf).groupBy("doc_id", (F.col("page_num") - 1).alias("page")).agg(F.array_join(F.collect_list("text"), " ").alias("text")))


@query("k07_changed_languages")
def k07(spark, sf):
    noted = docs(spark, sf).withColumn("map_language", F.when(F.col("doc_id").cast("int") % 3 == 0, "xx").otherwise(F.col("map_language")))
    return layout.changed_languages(noted, t25(spark, sf))


@query("k04_repair_elements", """SELECT chunk_id, CASE WHEN pos % 2 = 0 THEN 'é' || doc_id || ' l’ö' ELSE 'plain' END AS text FROM v_chunks WHERE pos % 2 = 0 OR regexp_matches(text, '[{marks}]')""".format(marks="".join(strings.MOJIBAKE)))
def k04(spark, sf):
    """Chunks with a mark of the old encoding in their own text come out too."""
    marked = F.when(F.col("pos") % 2 == 0, F.concat(F.lit("Ž"), "doc_id", F.lit(" lÕš"))).otherwise("plain")
    return layout.repair_elements(chunks(spark, sf).select("chunk_id", "text", F.array(F.struct(F.lit("text").alias("label"), marked.alias("text"))).alias("elements"))).select("chunk_id", F.col("elements")[0]["text"].alias("text"))


@query("h06_clean_text", r"""SELECT chunk_id, text || ' National ' || doc_id || ' multiple evaluation fi section' AS text FROM v_chunks WHERE NOT regexp_matches(text, '(?i)[^\x00-\x7f]|naonal|formave|evaluaon|situaon|organizaon|bullen|funcon|acon|populaon|idenfy|nofy|effecve|descripon|pracce|parcipant|mul\b|addional|operaonal|nutrion|educaon|locaon|protecon|secon|soluon|informon|communicaon')""")
def h06(spark, sf):
    plain = r"(?i)[^\x00-\x7f]|naonal|formave|evaluaon|situaon|organizaon|bullen|funcon|acon|populaon|idenfy|nofy|effecve|descripon|pracce|parcipant|mul\b|addional|operaonal|nutrion|educaon|locaon|protecon|secon|soluon|informon|communicaon"
    c = chunks(spark, sf).where(~F.col("text").rlike(plain))
    return texts.clean_text(c.select("chunk_id", F.concat("text", F.lit(" Na\ufffdonal "), "doc_id", F.lit(" mul\ufffdple evaluaon \ufb01 secon")).alias("text")), "text")


@query("c08_fix_captions", """SELECT chunk_id AS text_id, CASE WHEN pos % 3 = 0 AND pos % 2 = 0 AND CAST(doc_id AS INT) % 2 = 0 THEN 'caption' WHEN pos % 3 < 2 THEN 'section_header' ELSE 'text' END AS label FROM v_chunks""")
def c08(spark, sf):
    """Every second text is below a picture, every third begins like a figure in even documents."""
    c = chunks(spark, sf)
    text = F.when((F.col("pos") % 3 == 0) & (F.col("doc_id").cast("int") % 2 == 0), F.concat(F.lit("Figure 2: "), "text")).otherwise(F.concat(F.lit("On "), "text"))
    texts_ = c.select(F.col("chunk_id").alias("text_id"), F.when(F.col("pos") % 3 < 2, "section_header").otherwise("text").alias("label"), text.alias("text"))
    pictures = c.where("pos % 2 = 0").groupBy("doc_id").agg(F.collect_list("chunk_id").alias("children"))
    return el.fix_captions(pictures, texts_).select("text_id", "label")
