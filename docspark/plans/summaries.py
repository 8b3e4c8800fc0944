"""Registered queries that summarise and tag whole documents with the offline models."""

from __future__ import annotations

from pyspark.sql import functions as F

from docspark.operators import summaries, texts
from docspark.plans.registry import query
from docspark.plans.views import spread, view

# (doc_id, tax, part, text): a text `t` cut into k near-equal parts, each after the last blank line within 200 of its end
SPLIT = """s AS (SELECT *, length(t) AS n, CAST(ceil(length(t) / most) AS INT) AS k FROM whole WHERE length(t) > 0),
cut AS (SELECT doc_id, tax, t, n, k, 0 AS i, 0 AS a, 0 AS b FROM s UNION ALL
  SELECT doc_id, tax, t, n, k, i + 1, b, CASE WHEN i + 1 = k THEN n WHEN contains(w, chr(10) || chr(10)) THEN low + length(w) - strpos(reverse(w), chr(10) || chr(10)) + 1 ELSE b + n // k END
  FROM (SELECT *, greatest(b, b + n // k - 200) AS low, substr(t, greatest(b, b + n // k - 200) + 1, least(n, b + n // k + 200) - greatest(b, b + n // k - 200)) AS w FROM cut WHERE i < k) z),
parts AS (SELECT doc_id, tax, i - 1 AS part, substr(t, a + 1, greatest(b - a, 0)) AS text FROM cut WHERE i > 0)"""
BLANK_LINES = "CASE WHEN CAST(doc_id AS INT) % 2 = 0 THEN sys_full_summary ELSE replace(sys_full_summary, concat('.', chr(10)), concat('.', chr(10), chr(10))) END"


@query("t29_split_balanced", f"""WITH RECURSIVE whole AS (SELECT doc_id, '' AS tax, {BLANK_LINES} AS t, 3000.0 AS most FROM v_docs), {SPLIT} SELECT doc_id, part, md5(text) AS text_md5 FROM parts""")
def t29(spark, sf):
    d = view(spark, sf, "v_docs").select("doc_id", F.expr(BLANK_LINES).alias("t")).where("length(t) > 0")
    return d.select("doc_id", F.posexplode(texts.split_balanced(F.col("t"), 3000)).alias("part", "text")).select("doc_id", "part", F.md5("text").alias("text_md5"))


def _lead(t: str) -> str:
    """The offline summariser: three sentences."""
    return rf"array_to_string(string_split(regexp_replace(regexp_replace({t}, '^\s+|\s+$', '', 'g'), '([.!?])\s+', '\1' || chr(1), 'g'), chr(1))[1:3], ' ')"


def _turn(before: str, after: str, size: int, step: int, most: int) -> str:
    return f"""{after}p AS (SELECT doc_id, t, unnest(range(0, greatest(ceil((length(t) - 800) / {step}.0), 1)::INT)) AS part FROM {before} WHERE length(t) > {most}),
{after} AS (SELECT doc_id, string_agg({_lead(f"substr(t, CAST(part AS INT) * {step} + 1, {size})")}, chr(10) || chr(10) ORDER BY part) AS t FROM {after}p GROUP BY 1)"""


_CLEAN = "sys_full_summary"
for _pattern, _by in summaries.CLEANED:
    _CLEAN = f"regexp_replace({_CLEAN}, '{_pattern}', '{_by}', 'g')".replace("\n", "' || chr(10) || '") if "\n" in _by else f"regexp_replace({_CLEAN}, '{_pattern}', '{_by}', 'g')"
_TURNS = ", ".join([_turn("c", "j0", 3100, 2300, 3100), *(_turn(f"j{i}", f"j{i + 1}", 3100, 2300, 3200) for i in range(3))])


SUMMARIES = rf"""c AS (SELECT doc_id, regexp_replace({_CLEAN}, '^\s+|\s+$', '', 'g') AS t FROM v_docs), {_TURNS},
r AS (SELECT doc_id, CASE WHEN t <> '' THEN {_lead('t')} END AS summary, 0 AS turns, true AS once FROM c WHERE length(t) <= 3100 {' '.join(f"UNION ALL SELECT doc_id, {_lead('t')}, {i}, false FROM j{i} WHERE length(t) <= 3200" for i in range(4))} UNION ALL SELECT doc_id, t, 4, false FROM j3 WHERE length(t) > 3200),
made AS (SELECT doc_id, CASE WHEN NOT once OR length(summary) >= 50 THEN summary END AS summary, 'llm_summary' AS method, CAST(turns AS INT) AS turns, CASE WHEN once AND coalesce(length(summary), 0) < 50 THEN 'summarize_failed' ELSE 'summarized' END AS status FROM r)"""  # fmt: skip


@query("t30_summarise", f"""WITH {SUMMARIES} SELECT * FROM made""")
def t30(spark, sf):
    d = view(spark, sf, "v_docs").select("doc_id", F.col("sys_full_summary").alias("text"))
    return summaries.summarise(d, window=4000, reserve=800).select("doc_id", "summary", "method", "turns", "status")


# two taxonomies from the benchmark's items, named by their third words; some are for chunks
TAXONOMY = "SELECT CASE item_id % 2 WHEN 0 THEN 'even' ELSE 'odd' END AS taxonomy, CASE WHEN item_id % 5 = 0 THEN 'chunk' ELSE 'document' END AS level, item_id AS ord, concat('c', CAST(item_id AS STRING)) AS code, CASE WHEN item_id % 7 = 3 THEN NULL ELSE lower(split_part(text, ' ', 3)) END AS name FROM {benchmark}"


@query("t31_tag_taxonomies", f"""WITH RECURSIVE x AS ({TAXONOMY.format(benchmark='benchmark')}), v AS (SELECT * FROM x WHERE level = 'document'),
whole AS (SELECT doc_id, tax, sys_full_summary AS t, CAST((2500 - 500) * 2 - 500 - chars AS DOUBLE) AS most FROM v_docs, (SELECT taxonomy AS tax, CAST(sum(length(code) + coalesce(length(name), 0)) AS INT) AS chars FROM v GROUP BY 1) y), {SPLIT},
f AS (SELECT doc_id, tax, ord, code, name, min(part) AS part FROM parts JOIN v ON tax = v.taxonomy WHERE name <> '' AND contains(lower(text), name) GROUP BY ALL)
SELECT doc_id, tax AS taxonomy, string_agg(code || ' - ' || name, '; ' ORDER BY part, ord) AS tags, string_agg('the text names ' || name, '; ' ORDER BY part, ord) AS reasons FROM f GROUP BY 1, 2""")  # fmt: skip
def t31(spark, sf):
    values = spark.sql(TAXONOMY, benchmark=spark.read.parquet(f"{sf}/benchmark.parquet"))
    d = spread(view(spark, sf, "v_docs").select("doc_id", F.col("sys_full_summary").alias("summary")))
    got = summaries.tag_taxonomies(d, values, window=2500, reserve=500)
    return got.select("doc_id", "taxonomy", F.array_join("tags", "; ").alias("tags"), F.array_join(F.transform("codes", lambda c: c["reason"]), "; ").alias("reasons"))


# what documents have for a summary: a part of their text, or none
OLD_SUMMARY = "CASE WHEN CAST(doc_id AS INT) % 6 <> 5 THEN substr(sys_full_summary, 1, 100 + CAST(doc_id AS INT) % 5 * 90) END"


@query("k10_renew_summaries", f"""WITH {SUMMARIES}, o AS (SELECT doc_id, sys_status, {OLD_SUMMARY} AS old FROM v_docs), n AS (SELECT o.doc_id, sys_status, old, CASE WHEN (old IS NULL OR length(old) > 250) AND status = 'summarized' THEN summary END AS new FROM o JOIN made USING (doc_id))
SELECT doc_id, sys_status, new IS NOT NULL AND coalesce(length(new) < length(old), true) AS renewed, CASE WHEN new IS NOT NULL AND coalesce(length(new) < length(old), true) THEN new ELSE old END AS summary FROM n""")
def k10(spark, sf):
    """Documents without a summary and with one of over 250 characters."""
    d = view(spark, sf, "v_docs").select("doc_id", "sys_status", F.col("sys_full_summary").alias("text"), F.expr(OLD_SUMMARY).alias("summary"))
    return summaries.renew_summaries(d, F.col("summary").isNull() | (F.length("summary") > 250), window=4000, reserve=800)
