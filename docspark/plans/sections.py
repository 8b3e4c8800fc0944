"""Registered queries over tables of contents."""

from __future__ import annotations

from pyspark.sql import functions as F

from docspark.operators import elements as el
from docspark.operators import sections as se
from docspark.plans.registry import query
from docspark.plans.views import view


def toc(spark, sf):
    return view(spark, sf, "v_toc")


LABELS = "CASE title WHEN 'Executive Summary' THEN 'executive_summary' WHEN 'Introduction' THEN 'introduction' WHEN 'Methodology' THEN 'methodology' WHEN 'Findings' THEN 'findings' WHEN 'Conclusions' THEN 'conclusions' WHEN 'Recommendations' THEN 'recommendations' WHEN 'Annex A' THEN 'annexes' WHEN 'Bibliography' THEN 'bibliography' WHEN 'Acronyms' THEN 'acronyms' WHEN 'Table of Contents' THEN 'front_matter' WHEN 'Theory of change' THEN 'context' ELSE 'other' END"
PARENT = "CASE WHEN level > 1 THEN greatest(max(CASE WHEN level = 1 THEN idx END) OVER w, CASE WHEN level > 2 THEN max(CASE WHEN level = 2 THEN idx END) OVER w END) END"
PARENTS = f"t AS (SELECT *, {LABELS} AS label, {PARENT} AS parent_idx FROM v_toc WINDOW w AS (PARTITION BY doc_id ORDER BY idx ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING))"


@query("e07_parent_of", f"WITH {PARENTS} SELECT doc_id, idx, parent_idx FROM t")
def e07(spark, sf):
    return se.parent_of(toc(spark, sf), 4).select("doc_id", "idx", "parent_idx")


_STRONG = ", ".join(map(repr, se.STRONG))
_MAY = " OR ".join(f"(p.label = '{p}' AND t.label IN ({', '.join(map(repr, x))}))" for p, x in se.OVERRIDES.items())
_RULE = f"CASE WHEN p.label IN ({_STRONG}) THEN CASE WHEN {_MAY} THEN t.label ELSE p.label END WHEN t.label = 'other' AND p.label IS NOT NULL THEN p.label ELSE t.label END"


@query("e08_propagate_labels", f"""WITH {PARENTS}, l1 AS (SELECT doc_id, idx, label FROM t WHERE level = 1),
l2 AS (SELECT t.doc_id, t.idx, {_RULE} AS label FROM t LEFT JOIN l1 p ON p.doc_id = t.doc_id AND p.idx = t.parent_idx WHERE level = 2), l12 AS (SELECT * FROM l1 UNION ALL SELECT * FROM l2)
SELECT * FROM l12 UNION ALL SELECT t.doc_id, t.idx, {_RULE} AS label FROM t LEFT JOIN l12 p ON p.doc_id = t.doc_id AND p.idx = t.parent_idx WHERE level = 3""")
def e08(spark, sf):
    return se.propagate_labels(se.lock_labels(toc(spark, sf))).select("doc_id", "idx", "label")


TOTAL = f"(SELECT *, {LABELS} AS label, CAST(doc_id AS INT) % 12 AS total_pages FROM v_toc)"


def labelled(spark, sf):
    return se.lock_labels(toc(spark, sf)).withColumn("total_pages", F.col("doc_id").cast("int") % 12)


@query("e09_rule_short_doc", f"SELECT doc_id, idx, CASE WHEN total_pages BETWEEN 1 AND 3 THEN 'executive_summary' ELSE label END AS label FROM {TOTAL} q")
def e09(spark, sf):
    return se.rule_short_doc(labelled(spark, sf)).select("doc_id", "idx", "label")


FRONT = f"(SELECT * REPLACE (CASE WHEN total_pages > 0 AND page > total_pages / 3 AND label = 'front_matter' THEN 'other' WHEN total_pages > 0 AND page <= total_pages / 3 AND title = 'Annex A' THEN 'front_matter' ELSE label END AS label) FROM {TOTAL} q)"


@query("e10_rule_front", f"SELECT doc_id, idx, label FROM {FRONT} f")
def e10(spark, sf):
    return se.rule_front(labelled(spark, sf)).select("doc_id", "idx", "label")


def _annex(source):
    before = ", ".join(map(repr, se.BEFORE_ANNEX))
    return f"(SELECT * EXCLUDE (start) REPLACE (CASE WHEN idx > start AND label IN ({before}) THEN 'annexes' ELSE label END AS label) FROM (SELECT *, min(CASE WHEN label = 'annexes' THEN idx END) OVER (PARTITION BY doc_id) AS start FROM (SELECT * REPLACE (CASE WHEN title = 'Annex A' AND label <> 'front_matter' THEN 'annexes' ELSE label END AS label) FROM {source} a) b) c)"


def _unique(source):
    return f"(SELECT * EXCLUDE (s) REPLACE (CASE WHEN label = 'executive_summary' AND sum(s) OVER (PARTITION BY doc_id ORDER BY idx) > 1 THEN 'findings' ELSE label END AS label) FROM (SELECT *, CASE WHEN label = 'executive_summary' AND coalesce(lag(label) OVER (PARTITION BY doc_id ORDER BY idx), '') <> 'executive_summary' THEN 1 ELSE 0 END AS s FROM {source} u) v)"


@query("e13_rule_annex", f"SELECT doc_id, idx, label FROM {_annex(TOTAL)} z")
def e13(spark, sf):
    return se.rule_annex(labelled(spark, sf)).select("doc_id", "idx", "label")


@query("e14_rule_exec_unique", f"SELECT doc_id, idx, label FROM {_unique(TOTAL)} z")
def e14(spark, sf):
    return se.rule_exec_unique(labelled(spark, sf)).select("doc_id", "idx", "label")


ROMAN = ", ".join(map(repr, ("front_matter", "executive_summary", "acronyms")))


def _pages(source):
    return f"(SELECT *, min(page) FILTER (WHERE fm) OVER d AS p0, max(page) FILTER (WHERE fm) OVER d AS p1 FROM {source} r WINDOW d AS (PARTITION BY doc_id))"


def _roman(source):
    return f"(SELECT * EXCLUDE (p0, p1) REPLACE (CASE WHEN page <= p1 AND label NOT IN ({ROMAN}) THEN 'front_matter' ELSE label END AS label) FROM {_pages(source)} y)"


def _reset(source):
    own = f"CASE WHEN title = 'Executive Summary' THEN 'executive_summary' WHEN title = 'Acronyms' THEN 'acronyms' WHEN label IN ({ROMAN}) THEN 'other' ELSE label END"
    before = "(PARTITION BY doc_id ORDER BY idx ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)"
    below = lambda p: f"CASE WHEN NOT late THEN label WHEN {p} = 'executive_summary' THEN {p} ELSE own END"
    first = f"(SELECT *, CASE WHEN late THEN own ELSE label END AS f1 FROM (SELECT *, coalesce(page > p1, false) AS late, {own} AS own FROM {_pages(source)} o) o1)"
    second = f"(SELECT *, {below('up2')} AS f2 FROM (SELECT *, last_value(CASE WHEN level = 1 THEN f1 END IGNORE NULLS) OVER {before} AS up2 FROM {first} s1) s2)"
    third = f"(SELECT *, {below('up3')} AS f3 FROM (SELECT *, last_value(CASE level WHEN 1 THEN f1 WHEN 2 THEN f2 END IGNORE NULLS) OVER {before} AS up3 FROM {second} s3) s4)"
    return f"(SELECT * EXCLUDE (p0, p1, late, own, f1, f2, f3, up2, up3) REPLACE (CASE level WHEN 1 THEN f1 WHEN 2 THEN f2 ELSE f3 END AS label) FROM {third} s5)"


def _dominance(source):
    block = "CASE title WHEN 'Table of Contents' THEN 'front_matter' WHEN 'Acronyms' THEN 'acronyms' ELSE 'executive_summary' END"
    first = f"(SELECT *, min(CASE WHEN page BETWEEN p0 AND p1 AND (label = 'executive_summary' OR title = 'Executive Summary') THEN idx END) OVER (PARTITION BY doc_id) AS i0 FROM {_pages(source)} k)"
    return f"(SELECT * EXCLUDE (p0, p1, i0) REPLACE (CASE WHEN idx = i0 THEN 'executive_summary' WHEN page BETWEEN p0 AND p1 AND idx > i0 THEN {block} ELSE label END AS label) FROM {first} k2)"


def _front_pages(source):
    return f"(SELECT * REPLACE (CASE WHEN label = 'front_matter' AND NOT fm AND NOT coalesce(total_pages > 0 AND page <= total_pages / 3 AND title = 'Table of Contents', false) THEN 'other' ELSE label END AS label) FROM {source} fp)"


@query("e10b_rule_front_pages", f"SELECT doc_id, idx, label FROM {_front_pages(FRONT)} z")
def e10b(spark, sf):
    return se.rule_front_pages(se.rule_front(labelled(spark, sf))).select("doc_id", "idx", "label")


@query("e11_rule_roman", f"SELECT doc_id, idx, label FROM {_reset(_roman(TOTAL))} z")
def e11(spark, sf):
    return se.rule_roman_reset(se.rule_roman(labelled(spark, sf))).select("doc_id", "idx", "label")


@query("e12_rule_exec_dominance", f"SELECT doc_id, idx, label FROM {_dominance(TOTAL)} z")
def e12(spark, sf):
    return se.rule_exec_dominance(labelled(spark, sf)).select("doc_id", "idx", "label")


def _rules(source):
    """The whole order, for documents of more than three pages or of an unknown number."""
    front = FRONT.replace(TOTAL, source)
    rest = _front_pages(_unique(_annex(_roman(_dominance(_reset(_roman(front)))))))
    return f"(SELECT doc_id, idx, page, title, 'executive_summary' AS label FROM {source} q WHERE total_pages BETWEEN 1 AND 3 UNION ALL SELECT doc_id, idx, page, title, label FROM {rest} z WHERE total_pages NOT BETWEEN 1 AND 3)"


@query("e15_sequence_rules", f"SELECT doc_id, idx, label FROM {_rules(TOTAL)} z")
def e15(spark, sf):
    return se.sequence_rules(labelled(spark, sf)).select("doc_id", "idx", "label")


FINAL = f"""{PARENTS}, l1 AS (SELECT doc_id, idx, label FROM t WHERE level = 1),
l2 AS (SELECT t.doc_id, t.idx, {_RULE} AS label FROM t LEFT JOIN l1 p ON p.doc_id = t.doc_id AND p.idx = t.parent_idx WHERE level = 2), l12 AS (SELECT * FROM l1 UNION ALL SELECT * FROM l2),
l123 AS (SELECT * FROM l12 UNION ALL SELECT t.doc_id, t.idx, {_RULE} AS label FROM t LEFT JOIN l12 p ON p.doc_id = t.doc_id AND p.idx = t.parent_idx WHERE level = 3),
given AS (SELECT t.* EXCLUDE (label, parent_idx), l123.label, CAST(t.doc_id AS INT) % 12 AS total_pages FROM t JOIN l123 USING (doc_id, idx)), final AS (SELECT * FROM {_rules('given')} g)"""


@query("t20_label_sections", f"WITH {FINAL} SELECT doc_id, idx, label FROM final")
def t20(spark, sf):
    return se.label_sections(toc(spark, sf).withColumn("total_pages", F.col("doc_id").cast("int") % 12)).select("doc_id", "idx", "label")


@query("t20b_tag_sections", f"""WITH {FINAL} SELECT chunk_id, coalesce(CASE WHEN pos % 4 > 0 THEN (SELECT label FROM final f WHERE f.doc_id = c.doc_id AND f.page <= c.page_num ORDER BY page DESC, idx DESC LIMIT 1) END,
(SELECT label FROM final f WHERE f.doc_id = c.doc_id AND f.title = CASE c.pos % 3 WHEN 0 THEN 'Findings' WHEN 1 THEN 'Methodology' ELSE 'None' END ORDER BY CASE WHEN pos % 4 > 0 AND page <= c.page_num THEN page ELSE -1 END DESC, idx DESC LIMIT 1), 'other') AS section FROM v_chunks c""")
def t20b(spark, sf):
    h = F.when(F.col("pos") % 3 == 0, "FINDINGS ").when(F.col("pos") % 3 == 1, " Methodology").otherwise("None")
    c = view(spark, sf, "v_chunks").withColumn("headings", F.array(h)).withColumn("page_num", F.when(F.col("pos") % 4 > 0, F.col("page_num")))
    return se.tag_sections(c, toc(spark, sf).withColumn("total_pages", F.col("doc_id").cast("int") % 12))


# titles whose labels were read off the rules by hand; the order of the rules decides where several fit
GOLDEN = (
    ("Annex 3: methodology", "methodology"), ("Context and findings", "context"), ("Appendix B. Results", "appendix"), ("Annexe 2", "annexes"),
    ("References", "bibliography"), ("Terms of Reference", "annexes"), ("Introduction and recommendations", "recommendations"), ("3.2 Effectiveness", "findings"),
    ("Summary", "executive_summary"), ("Summary of findings", "findings"), ("Scope of work", "introduction"), ("Limitations", "methodology"),
    ("Management response", "recommendations"), ("Выводы", "conclusions"), ("LISTE DES TABLEAUX", "front_matter"), ("Índice", "front_matter"),
    ("Conclusions and way forward", "recommendations"), ("Overview", "context"), ("Storage of records", "other"), ("Torque", "other"),
)
_GOLD = " ".join(f"WHEN {k} THEN '{label}'" for k, (_, label) in enumerate(GOLDEN))


@query("t19b_lock_golden", f"SELECT doc_id, idx, CASE (CAST(doc_id AS INT) + idx) % {len(GOLDEN)} {_GOLD} END AS label FROM v_toc")
def t19b(spark, sf):
    title = F.array(*(F.lit(t) for t, _ in GOLDEN))[(F.col("doc_id").cast("int") + F.col("idx")) % len(GOLDEN)]
    return se.lock_labels(toc(spark, sf).withColumn("title", title)).select("doc_id", "idx", "label")


@query("e17_drop_majors", """WITH RECURSIVE n AS (SELECT doc_id, idx, 1 + page % 5 AS n FROM v_toc), r AS (SELECT doc_id, -1 AS idx, 0 AS last, false AS ok FROM (SELECT DISTINCT doc_id FROM n) q UNION ALL
SELECT n.doc_id, n.idx, CASE WHEN n <= last + 1 THEN n ELSE last END, n <= last + 1 FROM r JOIN n ON n.doc_id = r.doc_id AND n.idx = r.idx + 1) SELECT doc_id, idx FROM r WHERE ok""")
def e17(spark, sf):
    t = toc(spark, sf).withColumn("title", F.concat((F.col("page") % 5 + 1).cast("string"), F.lit(". "), "title"))
    return se.drop_majors(t).select("doc_id", "idx")


@query("e23_toc_features", """SELECT doc_id, idx, round(CASE WHEN count(*) OVER d > 1 THEN idx / (count(*) OVER d - 1) ELSE 0 END, 6) AS "position", round(page / max(page) OVER d, 6) AS page_norm, round(level / 6, 6) AS level_norm, page IS NOT NULL AS has_page FROM v_toc WINDOW d AS (PARTITION BY doc_id)""")
def e23(spark, sf):
    return se.toc_features(toc(spark, sf))


LINE = "'[H' || level || '] ' || title || ' | page ' || page || CASE WHEN fm THEN ' [Front]' ELSE '' END"


@query("t12_render_toc", f"SELECT doc_id, string_agg({LINE}, chr(10) ORDER BY idx) AS toc FROM v_toc GROUP BY 1")
def t12(spark, sf):
    return se.render_toc(toc(spark, sf))


@query("t11_parse_toc", """SELECT doc_id, idx, level, title, lower(title) AS normalized_title, page, fm FROM v_toc""")
def t11(spark, sf):
    return se.parse_toc(se.render_toc(toc(spark, sf))).drop("roman")


@query("t15_choose_toc", """SELECT doc_id, count(*) AS entries, round(avg((title = 'Table of Contents')::INT), 6) AS figures, 0.0 AS unknown, count(*) < 5 AS low_quality, false AS unusable FROM v_toc GROUP BY 1""")
def t15(spark, sf):
    return se.choose_toc(toc(spark, sf))


@query("t16_validate_toc", """SELECT doc_id, count(*) >= 2 AS ok, CASE WHEN count(*) >= 2 THEN 'ok' ELSE 'too short' END AS reason FROM v_toc GROUP BY 1""")
def t16(spark, sf):
    return se.validate_toc(toc(spark, sf))


@query("t19_lock_labels", f"SELECT doc_id, idx, {LABELS} AS label FROM v_toc")
def t19(spark, sf):
    return se.lock_labels(toc(spark, sf)).select("doc_id", "idx", "label")


@query("t21_restore_labels", f"SELECT doc_id, idx, {LABELS} AS label FROM v_toc WHERE CAST(doc_id AS INT) % 3 <> 0")
def t21(spark, sf):
    new = toc(spark, sf)
    old = se.lock_labels(new).withColumn("label", F.when((F.col("doc_id").cast("int") % 3 == 0) & (F.col("idx") == 0), "wrong").otherwise(F.col("label")))
    return se.restore_labels(old, new)


@query("t22_infer_level", f"SELECT doc_id, idx, CASE idx % 3 WHEN 0 THEN 2 WHEN 1 THEN CASE WHEN {LABELS} <> 'other' THEN 1 END ELSE 3 END AS level FROM v_toc")
def t22(spark, sf):
    k = F.col("idx") % 3
    title = F.when(k == 0, F.concat(F.lit("2.1 "), "title")).when(k == 1, F.col("title")).otherwise(F.concat(F.lit("Figure 3 "), "title"))
    return toc(spark, sf).select("doc_id", "idx", se.infer_level(title).alias("level"))


@query("c03_asof_section", f"""WITH t AS (SELECT *, {LABELS} AS label FROM v_toc) SELECT chunk_id, c.doc_id, coalesce((SELECT label FROM t WHERE t.doc_id = c.doc_id AND t.page <= c.page_num ORDER BY page DESC, idx DESC LIMIT 1), 'other') AS section FROM v_chunks c""")
def c03(spark, sf):
    return se.asof_section(view(spark, sf, "v_chunks"), se.lock_labels(toc(spark, sf)))


@query("c04_heading_section", f"""WITH t AS (SELECT *, {LABELS} AS label FROM v_toc) SELECT chunk_id, coalesce((SELECT label FROM t WHERE t.doc_id = c.doc_id AND t.title = CASE c.pos % 3 WHEN 0 THEN 'Findings' WHEN 1 THEN 'Methodology' ELSE 'None' END ORDER BY CASE WHEN page <= c.page_num THEN page ELSE -1 END DESC, idx DESC LIMIT 1), 'other') AS section FROM v_chunks c""")
def c04(spark, sf):
    h = F.when(F.col("pos") % 3 == 0, "FINDINGS ").when(F.col("pos") % 3 == 1, " Methodology").otherwise("None")
    return se.heading_section(view(spark, sf, "v_chunks").withColumn("headings", F.array(F.lit("No such title"), h)), se.lock_labels(toc(spark, sf)))


@query("g05_merge_label_batches", f"""SELECT doc_id, idx, CASE WHEN idx = 0 THEN 'front_matter' ELSE 'batch' || CAST(2 + page % 2 AS STRING) END AS label FROM v_toc""")
def g05(spark, sf):
    t = toc(spark, sf)
    rows = t.select("doc_id", "idx", F.explode(F.array(F.lit(1), F.col("page") % 2 + 2)).alias("batch"))
    rows = rows.withColumn("label", F.concat(F.lit("batch"), F.col("batch").cast("string")))
    return el.merge_label_batches(rows, t.where("idx = 0").select("doc_id", "idx", F.lit("front_matter").alias("label")))


@query("k17_apply_corrections", f"""SELECT doc_id, idx, CASE WHEN idx % 4 = 1 THEN 'edited' ELSE {LABELS} END AS label, idx % 4 = 1 AS edited FROM v_toc""")
def k17(spark, sf):
    t = se.lock_labels(toc(spark, sf))
    return el.apply_corrections(t, t.where("idx % 4 = 1").select("doc_id", "idx", F.lit("edited").alias("label"))).select("doc_id", "idx", "label", "edited")


@query("e16_front_run_end", """WITH p AS (SELECT doc_id, idx + 1 AS page, 1 + idx % 5 AS roman FROM v_toc), b AS (SELECT *, (page - 1) // 5 AS run FROM p), l AS (SELECT doc_id, run, count(*) AS n, max(page) AS e FROM b GROUP BY 1, 2) SELECT doc_id, max(e) AS last_page FROM l WHERE n >= 3 GROUP BY 1""")
def e16(spark, sf):
    return el.front_run_end(toc(spark, sf).select("doc_id", (F.col("idx") + 1).alias("page"), (F.col("idx") % 5 + 1).alias("roman")))


@query("t13_toc_from_blocks", """SELECT doc_id, idx AS pos, '[H' || CAST(level + 1 AS STRING) || '] ' || title || ' | page ' || CAST(page AS STRING) AS line FROM v_toc WHERE level < 3""")
def t13(spark, sf):
    t = toc(spark, sf)
    blocks = t.select("doc_id", F.col("idx").alias("pos"), F.when(F.col("level") < 3, "section_header").otherwise("text").alias("label"), "level", "page", F.col("title").alias("text"))
    return el.toc_from_blocks(blocks.unionByName(blocks.withColumn("text", F.concat(F.lit("77. "), "text"))))


@query("t23_body_size", """WITH n AS (SELECT doc_id, CAST(8 + page % 4 AS INT) AS size, count(*) AS n FROM v_toc GROUP BY 1, 2) SELECT doc_id, size AS body_size FROM (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY n DESC, size) AS k FROM n) q WHERE k = 1""")
def t23(spark, sf):
    return el.body_size(toc(spark, sf).select("doc_id", (F.col("page") % 4 + 8.2).alias("size")))


@query("f18_split_by_doc", """SELECT doc_id, count(*) AS n FROM v_toc GROUP BY 1""")
def f18(spark, sf):
    parts = el.split_by_doc(toc(spark, sf), 0.7, 5)
    return parts.groupBy("doc_id").agg(F.count("*").alias("n"), F.count_distinct("train").alias("sides")).where("sides = 1").select("doc_id", "n")
