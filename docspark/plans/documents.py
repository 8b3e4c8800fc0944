"""Registered queries over document tables: filters, statistics, facets, repairs and column functions."""

from __future__ import annotations

from pyspark.sql import functions as F

from docspark.functions import strings
from docspark.operators import facets, filters, quality, stats
from docspark.plans.registry import query
from docspark.plans.views import view


def docs(spark, sf):
    return view(spark, sf, "v_docs")


SPLIT = """CASE WHEN contains({c}, '; ') THEN string_split({c}, '; ') WHEN contains({c}, ' | ') THEN string_split({c}, ' | ') ELSE [{c}] END"""
COUNTRIES = SPLIT.format(c="map_country")


@query("b01_apply_mapping", """SELECT doc_id, 'Corpus' AS map_collection, map_organization AS map_agency, map_published_year AS map_year FROM v_docs""")
def b01(spark, sf):
    raw = docs(spark, sf).withColumn("date", F.concat(F.col("map_published_year"), F.lit("-05-01")))
    return filters.apply_mapping(raw, {"collection": "fixed_value:Corpus", "agency": "map_organization", "year": "YEAR(date)"}).select("doc_id", "map_collection", "map_agency", "map_year")


@query("b02_source_columns", """SELECT doc_id, map_organization AS src_lead_agency, map_language AS src_lang FROM v_docs""")
def b02(spark, sf):
    raw = docs(spark, sf).withColumn("raw", F.create_map(F.lit(" Lead Agency "), "map_organization", F.lit("Lang!"), "map_language", F.lit("id"), "doc_id"))
    got = filters.source_columns(raw, "raw", ("id",))
    return got.select("doc_id", F.try_element_at("raw", F.lit("src_lead_agency")).alias("src_lead_agency"), F.try_element_at("raw", F.lit("src_lang")).alias("src_lang"))


@query("b03_split_multi", """SELECT doc_id, array_to_string(list_filter(list_transform(string_split(map_country, ';'), lambda x: trim(x)), lambda x: x <> ''), '#') AS countries FROM v_docs WHERE map_country IS NOT NULL""")
def b03(spark, sf):
    return docs(spark, sf).where("map_country is not null").select("doc_id", F.array_join(strings.split_multi(F.col("map_country")), "#").alias("countries"))


@query("b04_normalize_docs", """SELECT doc_id, map_title AS title, sys_status AS status, map_organization AS organization FROM v_docs""")
def b04(spark, sf):
    return filters.normalize_docs(docs(spark, sf)).select("doc_id", "title", "status", "organization")


@query("b05_compile_filters", """SELECT doc_id FROM v_docs WHERE map_organization IN ('src0', 'src3', 'src15') AND TRY_CAST(map_published_year AS DOUBLE) >= 2018 AND sys_status IN ('indexed', 'parsed')""")
def b05(spark, sf):
    return docs(spark, sf).where(filters.compile_filters({"map_organization": "src0, src3,src15", "map_published_year_min": 2018, "sys_status": ["indexed", "parsed"], "map_title": ""})).select("doc_id")


@query("b06_filter_docs", """SELECT doc_id, map_title FROM v_docs WHERE map_title ILIKE '%an%' AND (map_title ILIKE '%th%' OR sys_full_summary ILIKE '%th%') AND map_document_type IN ('Brief', 'Study')""")
def b06(spark, sf):
    return filters.filter_docs(docs(spark, sf), {"title": "an", "search": "th", "map_document_type": ["Brief", "Study"]}).select("doc_id", "map_title")


@query("b07_filter_docs_loose", """SELECT doc_id FROM v_docs WHERE contains(lower(concat_ws(' ', map_title, sys_full_summary)), 'en') AND list_has_any(string_split_regex(map_country, ',\\s*'), ['Nepal', 'Egypt'])""")
def b07(spark, sf):
    return filters.filter_docs_loose(docs(spark, sf), "EN", "map_country", ["Nepal", "Egypt"]).select("doc_id")


@query("b08_filter_language", """SELECT chunk_id FROM v_chunks WHERE doc_id IN (SELECT doc_id FROM v_docs WHERE map_language IN ('fr', 'de'))""")
def b08(spark, sf):
    return filters.filter_language(view(spark, sf, "v_chunks"), docs(spark, sf), ["French", "German"]).select("chunk_id")


@query("b09_expand_filter", f"""SELECT doc_id, map_country FROM v_docs WHERE list_has_any({COUNTRIES}, ['Nepal', 'Chad'])""")
def b09(spark, sf):
    return filters.expand_filter(docs(spark, sf), "map_country", ["Nepal", "Chad"]).select("doc_id", "map_country")


@query("b10_filter_sections", """SELECT doc_id, idx FROM v_toc WHERE lower(trim(title)) IN ('findings', 'annex a')""")
def b10(spark, sf):
    return filters.filter_sections(view(spark, sf, "v_toc"), [" Findings", "ANNEX A"], "title").select("doc_id", "idx")


@query("b11_filter_min_chars", """SELECT chunk_id, length(text) AS chars FROM v_chunks WHERE length(text) >= 120""")
def b11(spark, sf):
    return filters.filter_min_chars(view(spark, sf, "v_chunks"), 120).select("chunk_id", F.length("text").alias("chars"))


@query("b12_doc_search", """SELECT doc_id, map_title, 0.0::DOUBLE AS score, substr(sys_full_summary, 1, 500) AS text FROM v_docs WHERE sys_status = 'indexed' AND (contains(lower(map_title), 'tion') OR contains(lower(sys_full_summary), 'tion')) AND map_language = 'en'""")
def b12(spark, sf):
    return filters.doc_search(docs(spark, sf), "TION", {"map_language": "en"})


@query("b13_scroll", """SELECT chunk_id, 0.0::DOUBLE AS score FROM v_chunks WHERE page_num = 1 ORDER BY chunk_id LIMIT 50""")
def b13(spark, sf):
    return filters.scroll(view(spark, sf, "v_chunks"), F.col("page_num") == 1, 50).select("chunk_id", "score")


@query("b14_permit", """SELECT doc_id FROM v_docs WHERE map_organization IN (SELECT concat('src', CAST(group_id AS STRING)) FROM v_users WHERE user_id = 7)""")
def b14(spark, sf):
    users = view(spark, sf, "v_users")
    grants = users.select("group_id", F.concat(F.lit("src"), F.col("group_id").cast("string")).alias("source")).distinct()
    return filters.permit(docs(spark, sf), grants, users, 7, "map_organization").select("doc_id")


@query("b15_since", """SELECT event_id FROM v_stage_events WHERE "at" >= TIMESTAMP '2024-01-20 00:00:00' - INTERVAL 48 HOURS""")
def b15(spark, sf):
    return filters.since(view(spark, sf, "v_stage_events"), "at", "2024-01-20 00:00:00", 48).select("event_id")


@query("b16_select_for_stage", """SELECT doc_id, sys_status FROM v_docs WHERE sys_status IN ('downloaded', 'parsed', 'tagged') AND map_organization = 'src3' AND contains(sys_filepath, '/en/')""")
def b16(spark, sf):
    return filters.select_for_stage(docs(spark, sf), {"tag"}, "src3", "/en/").select("doc_id", "sys_status")


@query("b17_find_stuck", """SELECT doc_id, sys_status FROM v_docs WHERE sys_status IN ('indexing', 'summarizing', 'pending')""")
def b17(spark, sf):
    return filters.find_stuck(docs(spark, sf)).select("doc_id", "sys_status")


@query("d01_status_counts", """SELECT sys_status, count(*) AS n FROM v_docs WHERE trim(sys_status) <> '' GROUP BY 1""")
def d01(spark, sf):
    return stats.status_counts(docs(spark, sf))


@query("d02_field_counts", """SELECT map_published_year AS value, count(*) AS n FROM v_docs WHERE map_published_year IS NOT NULL GROUP BY 1""")
def d02(spark, sf):
    return stats.field_counts(docs(spark, sf), "map_published_year")


BREAKDOWN = " UNION ALL ".join(f"SELECT '{f}' AS field, {f} AS value, sys_status AS status, count(*) AS n FROM v_docs WHERE {f} IS NOT NULL AND trim(sys_status) <> '' GROUP BY 2, 3" for f in ("map_organization", "map_document_type", "map_published_year", "map_language"))


@query("d03_breakdown", BREAKDOWN)
def d03(spark, sf):
    return stats.breakdown(docs(spark, sf), ["map_organization", "map_document_type", "map_published_year", "map_language"])


@query("d04_breakdown_multi", """SELECT value, sys_status AS status, count(*) AS n FROM (SELECT sys_status, trim(unnest(string_split(map_country, '; '))) AS value FROM v_docs WHERE trim(sys_status) <> '') q WHERE value <> '' GROUP BY 1, 2""")
def d04(spark, sf):
    return stats.breakdown_multi(docs(spark, sf), "map_country")


@query("d05_corpus_stats", """SELECT count(*) AS total, count(*) FILTER (sys_status = 'indexed') AS indexed, count(DISTINCT map_organization) AS agencies,
count(DISTINCT map_organization) FILTER (sys_status = 'indexed') AS indexed_agencies, count(DISTINCT map_language) FILTER (sys_status = 'indexed') AS indexed_languages FROM v_docs""")
def d05(spark, sf):
    return stats.corpus_stats(docs(spark, sf))


FLOW = """f AS (SELECT map_organization AS org, count(*) AS total, {counts} FROM v_docs WHERE coalesce(map_organization, 'Unknown') <> 'Unknown' GROUP BY 1),
g AS (SELECT *, n_tagged + n_indexed + n_index_failed + n_indexing AS flow_tagged FROM f),
h AS (SELECT *, n_summarized + flow_tagged + n_tagging AS flow_summarized FROM g),
i AS (SELECT *, n_parsed + flow_summarized + n_summarizing + n_summarize_failed AS flow_parsed FROM h),
flows AS (SELECT org, total, n_downloaded + flow_parsed + n_parse_failed + n_parsing + n_stopped AS flow_downloaded, flow_parsed, flow_summarized, flow_tagged, n_indexed AS flow_indexed,
 n_download_error AS download_error, n_parse_failed AS parse_failed, n_summarize_failed AS summarize_failed, n_index_failed AS index_failed, n_stopped AS stopped,
 n_tagged + n_indexing AS waiting_index, n_summarized + n_tagging AS waiting_tag, n_parsed + n_summarizing AS waiting_summary FROM i)""".format(
    counts=", ".join(f"count(*) FILTER (sys_status = '{s}') AS n_{s}" for s in stats.STATUSES)
)


@query("d06_org_flows", f"WITH {FLOW} SELECT * FROM flows")
def d06(spark, sf):
    return stats.org_flows(docs(spark, sf))


@query("d07_flow_links", f"WITH {FLOW} " + " UNION ALL ".join(f"SELECT org, {'org' if a == 'org' else repr(a)} AS source, '{b}' AS target, {v} AS value FROM flows WHERE {v} > 0" for a, b, v in stats.LINKS))
def d07(spark, sf):
    return stats.flow_links(stats.org_flows(docs(spark, sf)))


_FIXED = [n for n in dict.fromkeys(x for a, b, _ in stats.LINKS for x in (a, b)) if n != "org"]


@query("d07_flow_nodes", f"WITH {FLOW} SELECT row_number() OVER (ORDER BY tier, place, node) - 1 AS node_index, node FROM (SELECT DISTINCT org AS node, 0 AS tier, 0 AS place FROM flows UNION ALL SELECT * FROM (VALUES {', '.join(f'({n!r}, 1, {i})' for i, n in enumerate(_FIXED))}) v(node, tier, place)) q")
def d07_nodes(spark, sf):
    return stats.flow_nodes(stats.org_flows(docs(spark, sf)))


def _facet(f):
    return f"SELECT '{f}' AS field, unnest({SPLIT.format(c=f)}) AS value FROM v_docs WHERE {f} <> ''"


@query("d08_facets", f"""WITH p AS ({" UNION ALL ".join(_facet(f) for f in ("map_country", "map_organization", "map_document_type"))}), t AS (SELECT field, trim(value) AS value FROM p)
SELECT field, value, count(*) AS n FROM t WHERE value <> '' AND len(regexp_extract_all(value, '[a-z][A-Z]')) < 2 GROUP BY 1, 2""")
def d08(spark, sf):
    return facets.facets(docs(spark, sf), ["map_country", "map_organization", "map_document_type"])


@query("d09_year_facets", """SELECT map_published_year AS year, count(*) AS n FROM v_docs WHERE map_published_year IS NOT NULL GROUP BY 1""")
def d09(spark, sf):
    return facets.year_facets(docs(spark, sf))


@query("d10_range_facets", """WITH c AS (SELECT 'map_published_year' AS field, map_published_year AS value FROM v_docs UNION ALL SELECT 'map_title', map_title FROM v_docs UNION ALL SELECT 'map_language', map_language FROM v_docs),
r AS (SELECT field, bool_and(TRY_CAST(value AS DOUBLE) IS NOT NULL) AS numeric, min(TRY_CAST(value AS DOUBLE)) AS lo, max(TRY_CAST(value AS DOUBLE)) AS hi, count(DISTINCT value) AS k FROM c WHERE value <> '' GROUP BY 1)
SELECT field, "numeric", CASE WHEN "numeric" THEN lo END AS lo, CASE WHEN "numeric" THEN hi END AS hi, NOT "numeric" AND k > 400 AS too_many FROM r""")
def d10(spark, sf):
    return facets.range_facets(docs(spark, sf), ["map_published_year", "map_title", "map_language"], 400)


@query("d13_facet_values", """SELECT map_organization AS value, count(*) AS n FROM v_docs WHERE map_organization ILIKE '%RC1%' GROUP BY 1 ORDER BY n DESC, value LIMIT 5""")
def d13(spark, sf):
    return facets.facet_values(docs(spark, sf), "map_organization", "RC1", 5)


@query("d14_years_for_status", """SELECT DISTINCT map_published_year AS year FROM v_docs WHERE sys_status = 'indexed' AND regexp_full_match(map_published_year, '[0-9]+')""")
def d14(spark, sf):
    return stats.years_for_status(docs(spark, sf), "indexed")


HEAT = f"""SELECT trim(r) AS row_label, col_label, count(*) AS n FROM (SELECT unnest({COUNTRIES}) AS r, map_document_type AS col_label FROM v_docs WHERE map_country <> '') q GROUP BY 1, 2"""


@query("d15_heatmap_docs", HEAT)
def d15(spark, sf):
    return facets.heatmap_docs(docs(spark, sf), "map_country", "map_document_type")


@query("d18_heatmap_intensity", f"""WITH h AS ({HEAT}) SELECT row_label, col_label, round(n / (SELECT max(n) FROM h), 6) AS intensity FROM h""")
def d18(spark, sf):
    return facets.heatmap_intensity(facets.heatmap_docs(docs(spark, sf), "map_country", "map_document_type"))


@query("d39_success_rate", """SELECT round(count(*) FILTER (sys_status = 'indexed') * 100.0 / count(*), 6)::DOUBLE AS success_rate FROM v_docs""")
def d39(spark, sf):
    return stats.success_rate(docs(spark, sf))


@query("d40_chart_series", f"""WITH b AS ({BREAKDOWN}), t AS (SELECT *, sum(n) OVER (PARTITION BY field, value)::BIGINT AS total FROM b),
r AS (SELECT *, dense_rank() OVER (PARTITION BY field ORDER BY total DESC, value) AS k FROM t)
SELECT field, value, status, n, total, CASE WHEN status = 'indexed' THEN 0 WHEN suffix(status, 'error') THEN 2 ELSE 1 END AS place FROM r WHERE k <= 10""")
def d40(spark, sf):
    return stats.chart_series(stats.breakdown(docs(spark, sf), ["map_organization", "map_document_type", "map_published_year", "map_language"]))


@query("d27_error_breakdown", """WITH o AS (SELECT agency, year, node_id, bool_or(md5 IS NOT NULL) AS d, bool_or(has_error) AS e FROM v_files_old GROUP BY 1, 2, 3),
w AS (SELECT agency, year, node_id, bool_or(md5 IS NOT NULL) AS d, bool_or(has_error) AS e FROM v_files_new GROUP BY 1, 2, 3),
a AS (SELECT agency, year, count(*) AS old_n, count(*) FILTER (e AND NOT d) AS old_errors FROM o GROUP BY 1, 2), b AS (SELECT agency, year, count(*) AS new_n, count(*) FILTER (e AND NOT d) AS new_errors FROM w GROUP BY 1, 2),
j AS (SELECT agency, year, coalesce(old_n, 0) AS old_n, coalesce(old_errors, 0) AS old_errors, coalesce(new_n, 0) AS new_n, coalesce(new_errors, 0) AS new_errors FROM a FULL JOIN b USING (agency, year))
SELECT *, round((CASE WHEN new_n > 0 THEN new_errors * 100.0 / new_n ELSE 0 END)::DOUBLE - (CASE WHEN old_n > 0 THEN old_errors * 100.0 / old_n ELSE 0 END)::DOUBLE, 6) AS delta FROM j""")
def d27(spark, sf):
    return stats.error_breakdown(view(spark, sf, "v_files_old"), view(spark, sf, "v_files_new"))


@query("d29_cross_year", """SELECT agency, node_id, count(DISTINCT year) AS years FROM (SELECT meta_language AS agency, CAST(CAST(node_id AS INT) % 7 AS STRING) AS node_id, year FROM v_files_old) q GROUP BY 1, 2 HAVING count(DISTINCT year) > 1""")
def d29(spark, sf):
    return stats.cross_year(view(spark, sf, "v_files_old").withColumns({"agency": F.col("meta_language"), "node_id": (F.col("node_id").cast("int") % 7).cast("string")}))


@query("d28_report_variants", """SELECT variant, count(*) AS n FROM (SELECT CASE CAST(doc_id AS INT) % 4 WHEN 0 THEN 'Main Report' WHEN 1 THEN 'Report 2' WHEN 2 THEN 'Report 13' END AS variant FROM v_docs) q WHERE variant IS NOT NULL GROUP BY 1""")
def d28(spark, sf):
    k = F.col("doc_id").cast("int") % 4
    end = F.when(k == 0, "_-_Main_Report.pdf").when(k == 1, "_-_report 2.pdf").when(k == 2, "_-_Report13.pdf").otherwise(".pdf")
    named = docs(spark, sf).select(F.concat("doc_id", end).alias("name"))
    return stats.report_variants(named).withColumn("variant", F.when(F.col("variant") == "Report13", "Report 13").otherwise(F.col("variant")))


@query("d30_profile_fields", " UNION ALL ".join(f"SELECT '{f}' AS field, count(*) AS present, count(DISTINCT {f}) AS values, substr(min({f}), 1, 100) AS first_sample, round(count(*) * 100.0 / (SELECT count(*) FROM v_docs), 4)::DOUBLE AS percent FROM v_docs WHERE {f} <> ''" for f in ("map_language", "map_country", "map_published_year")))
def d30(spark, sf):
    return stats.profile_fields(docs(spark, sf).select("map_language", "map_country", "map_published_year")).withColumn("percent", F.col("percent").cast("double"))


@query("d31_language_transitions", """SELECT a.meta_language || ' -> ' || b.meta_language AS transition, count(*) AS n FROM v_files_old a JOIN (SELECT node_id, CASE WHEN CAST(node_id AS INT) % 9 = 0 THEN 'en' ELSE meta_language END AS meta_language FROM v_files_new) b USING (node_id) WHERE a.meta_language <> b.meta_language AND b.meta_language <> '' GROUP BY 1""")
def d31(spark, sf):
    new = view(spark, sf, "v_files_new").withColumn("meta_language", F.when(F.col("node_id").cast("int") % 9 == 0, "en").otherwise(F.col("meta_language")))
    return stats.language_transitions(view(spark, sf, "v_files_old"), new)


@query("d37_text_stats", r"""SELECT doc_id, len(regexp_extract_all(sys_full_summary, '[^\s]+')) AS words FROM v_docs""")
def d37(spark, sf):
    return stats.text_stats(docs(spark, sf), "sys_full_summary").select("doc_id", F.col("words").cast("long").alias("words"))


@query("d35_effective_settings", """SELECT key, arg_min(value, name) AS value FROM (SELECT CAST(group_id AS STRING) AS name, 'k' || CAST(user_id % 5 AS STRING) AS key, min(email) AS value FROM v_users GROUP BY 1, 2) q GROUP BY 1""")
def d35(spark, sf):
    cells = view(spark, sf, "v_users").groupBy(F.col("group_id").cast("string").alias("name"), F.concat(F.lit("k"), (F.col("user_id") % 5).cast("string")).alias("key")).agg(F.min("email").alias("value"))
    return stats.effective_settings(cells.groupBy("name").agg(F.map_from_entries(F.collect_list(F.struct("key", "value"))).alias("settings")))


@query("d41_crosstab_from_counts", f"""SELECT row_label, col_label, n FROM ({HEAT}) q""")
def d41(spark, sf):
    cells = facets.heatmap_docs(docs(spark, sf), "map_country", "map_document_type")
    packed = cells.groupBy("row_label").agg(F.map_from_entries(F.collect_list(F.struct(F.concat_ws("::", "row_label", "col_label"), "n"))).alias("counts"))
    return stats.crosstab_from_counts(packed)


@query("e03_mark_duplicates", """SELECT doc_id, row_number() OVER (PARTITION BY sys_file_checksum ORDER BY sys_filepath, doc_id) > 1 AS is_duplicate FROM v_docs WHERE sys_status = 'downloaded' AND sys_file_checksum IS NOT NULL""")
def e03(spark, sf):
    return quality.mark_duplicates(docs(spark, sf))


@query("e04_dedupe_last", """SELECT sys_file_checksum, arg_max(map_title, CAST(doc_id AS INT)) AS map_title, min(CAST(doc_id AS INT)) AS ord FROM v_docs GROUP BY 1""")
def e04(spark, sf):
    rows = docs(spark, sf).select("sys_file_checksum", "map_title", F.col("doc_id").cast("int").alias("ord"))
    return quality.dedupe_last(rows, "sys_file_checksum", "ord")


@query("e05_partition_slice", """SELECT doc_id, ntile(7) OVER (PARTITION BY map_organization ORDER BY CAST(doc_id AS INT)) AS slice FROM v_docs""")
def e05(spark, sf):
    return quality.partition_slice(docs(spark, sf), 7, "doc_id", "map_organization").select("doc_id", F.col("slice").cast("long").alias("slice"))


@query("e06_recent_first", """SELECT doc_id, coalesce(TRY_CAST(map_published_year AS INT), 0) AS sort_year, row_number() OVER (PARTITION BY map_organization ORDER BY coalesce(TRY_CAST(map_published_year AS INT), 0) DESC, doc_id) AS place FROM v_docs""")
def e06(spark, sf):
    from pyspark.sql.window import Window

    got = quality.recent_first(docs(spark, sf))
    return got.select("doc_id", "sort_year", F.row_number().over(Window.partitionBy("map_organization").orderBy(F.desc("sort_year"), "doc_id")).cast("long").alias("place"))


@query("f13_page_of_documents", """SELECT doc_id, map_title, count(*) OVER () AS total FROM v_docs ORDER BY map_title, doc_id LIMIT 20 OFFSET 40""")
def f13(spark, sf):
    d = docs(spark, sf)
    total = d.agg(F.count("*").alias("total"))
    return quality.field_page(d.select("doc_id", "map_title"), ["map_title", "doc_id"], 20, 3).join(F.broadcast(total))  # one row


@query("a07_lookup", """SELECT d.doc_id, d.sys_filepath FROM v_docs d JOIN (SELECT DISTINCT sys_file_checksum AS c FROM v_docs WHERE map_organization = 'src2') q ON d.sys_file_checksum = q.c""")
def a07(spark, sf):
    d = docs(spark, sf)
    return quality.lookup(d, d.where("map_organization = 'src2'"), "sys_file_checksum").select("doc_id", "sys_filepath")


@query("a08_upsert", """WITH u AS (SELECT node_id, arg_max(agency, CAST(node_id AS INT)) AS agency, arg_max(md5, CAST(node_id AS INT)) AS md5 FROM v_files_new GROUP BY 1)
SELECT node_id, agency, md5 FROM v_files_old WHERE node_id NOT IN (SELECT node_id FROM u) UNION ALL SELECT node_id, agency, md5 FROM u""")
def a08(spark, sf):
    new = view(spark, sf, "v_files_new").select("node_id", "agency", "md5", F.col("node_id").cast("int").alias("ord"))
    return quality.upsert(view(spark, sf, "v_files_old").select("node_id", "agency", "md5"), new, "node_id", "ord")


@query("a09_merge_fields", """SELECT o.node_id, o.agency, coalesce(n.md5, o.md5) AS md5, coalesce(n.meta_language, o.meta_language) AS meta_language FROM v_files_old o LEFT JOIN v_files_new n USING (node_id)""")
def a09(spark, sf):
    return quality.merge_fields(view(spark, sf, "v_files_old").select("node_id", "agency", "md5", "meta_language"), view(spark, sf, "v_files_new").select("node_id", "md5", "meta_language"), "node_id")


@query("a10_delete_docs", """SELECT chunk_id FROM v_chunks WHERE doc_id NOT IN (SELECT doc_id FROM v_docs WHERE sys_status = 'stopped')""")
def a10(spark, sf):
    return quality.delete_docs(view(spark, sf, "v_chunks"), docs(spark, sf).where("sys_status = 'stopped'")).select("chunk_id")


@query("a11_prune_orphans", """SELECT doc_id, sys_filepath, coalesce(map_title ILIKE '%report 2%', false) AS second_report FROM v_docs WHERE sys_filepath NOT IN (SELECT sys_filepath FROM v_docs WHERE CAST(doc_id AS INT) % 4 <> 1)""")
def a11(spark, sf):
    d = docs(spark, sf)
    return quality.prune_orphans(d, d.where(F.col("doc_id").cast("int") % 4 != 1).select(F.col("sys_filepath").alias("path")))


@query("c09_reconcile_counts", """WITH a AS (SELECT doc_id, count(*) AS left_n FROM v_chunks GROUP BY 1), b AS (SELECT doc_id, count(*) AS right_n FROM v_chunks WHERE pos % 5 <> 4 GROUP BY 1),
j AS (SELECT doc_id, coalesce(left_n, 0) AS left_n, coalesce(right_n, 0) AS right_n FROM a FULL JOIN b USING (doc_id)) SELECT *, abs(left_n - right_n) AS difference FROM j WHERE left_n <> right_n""")
def c09(spark, sf):
    c = view(spark, sf, "v_chunks")
    return quality.reconcile_counts(c, c.where("pos % 5 <> 4"))


SNAPSHOT = """c AS (SELECT node_id, CASE WHEN n.md5w IS NULL THEN 'only_old' WHEN o.md5o IS NULL THEN 'only_new' ELSE 'both' END AS side, o.md5 AS a, n.md5 AS b, o.has_error AS ae, n.has_error AS be, coalesce(o.meta_language, '') AS al, coalesce(n.meta_language, '') AS bl
FROM (SELECT *, 1 AS md5o FROM v_files_old) o FULL JOIN (SELECT *, 1 AS md5w FROM v_files_new) n USING (node_id)),
s AS (SELECT node_id, side, a, b, CASE WHEN side <> 'both' THEN NULL WHEN a IS NULL AND b IS NULL THEN 'none' WHEN a IS NOT DISTINCT FROM b THEN 'identical' ELSE 'different' END AS file,
CASE WHEN side <> 'both' THEN NULL WHEN ae AND NOT be THEN 'resolved' WHEN NOT ae AND be THEN 'new' WHEN ae THEN 'kept' ELSE 'none' END AS error,
CASE WHEN side <> 'both' THEN NULL WHEN al = '' AND bl <> '' THEN 'richer' WHEN al <> '' AND bl = '' THEN 'lost' WHEN al <> bl THEN 'changed' ELSE 'same' END AS language FROM c)"""


@query("c10_compare_snapshots", f"WITH {SNAPSHOT} SELECT node_id, side, file, error, language FROM s")
def c10(spark, sf):
    return quality.compare_snapshots(view(spark, sf, "v_files_old"), view(spark, sf, "v_files_new"))


@query("g02_plan_update", f"""WITH {SNAPSHOT} SELECT node_id, CASE WHEN side = 'only_old' THEN 'keep' WHEN side = 'only_new' THEN CASE WHEN b IS NULL THEN 'error_only' ELSE 'add' END WHEN a IS NOT NULL AND b IS NULL THEN 'regression' WHEN a IS NULL AND b IS NOT NULL THEN 'newly_available'
WHEN file = 'different' THEN 'replace' WHEN language <> 'same' THEN 'metadata' ELSE 'keep' END AS action FROM s""")
def g02(spark, sf):
    return quality.plan_update(view(spark, sf, "v_files_old"), view(spark, sf, "v_files_new"))


@query("g01_shared_nodes", """SELECT node_id, 'only_old' AS side FROM v_files_old WHERE node_id NOT IN (SELECT node_id FROM v_files_new) UNION ALL SELECT node_id, 'only_new' FROM v_files_new WHERE node_id NOT IN (SELECT node_id FROM v_files_old) UNION ALL SELECT node_id, 'shared' FROM v_files_old WHERE node_id IN (SELECT node_id FROM v_files_new)""")
def g01(spark, sf):
    o, n = (view(spark, sf, v).select("node_id") for v in ("v_files_old", "v_files_new"))
    return quality.compare_keys(o, n, "node_id")


@query("c11_compare_checksums", """SELECT o.node_id, CASE WHEN n.node_id IS NULL THEN 'missing' WHEN o.md5 IS NOT DISTINCT FROM n.md5 THEN 'ok' ELSE 'mismatch' END AS status FROM v_files_old o LEFT JOIN v_files_new n ON o.node_id = n.node_id""")
def c11(spark, sf):
    return quality.compare_checksums(view(spark, sf, "v_files_old"), view(spark, sf, "v_files_new"))


@query("c16_scan_diff", """SELECT n.node_id, CASE WHEN o.node_id IS NULL THEN 'new' WHEN n.has_error AND NOT o.has_error THEN 'download_error' WHEN o.has_error <> n.has_error THEN 'status_change' WHEN coalesce(o.md5 <> n.md5, false) AND coalesce(o.meta_language <> n.meta_language, false) THEN 'both'
WHEN coalesce(o.md5 <> n.md5, false) THEN 'file' WHEN coalesce(o.meta_language <> n.meta_language, false) THEN 'metadata' ELSE 'unchanged' END AS change FROM v_files_new n LEFT JOIN v_files_old o ON o.node_id = n.node_id""")
def c16(spark, sf):
    return quality.scan_diff(view(spark, sf, "v_files_new"), view(spark, sf, "v_files_old"))


@query("k01_split_countries", """SELECT DISTINCT map_country AS old_value, new_value FROM (SELECT map_country, regexp_replace(regexp_replace(map_country, '([a-z.)])([A-Z])', '\\1; \\2', 'g'), '\\s*;\\s*', '; ', 'g') AS new_value FROM v_docs WHERE map_country IS NOT NULL AND NOT contains(map_country, '; ')) q WHERE map_country <> new_value""")
def k01(spark, sf):
    return quality.split_countries(docs(spark, sf))


@query("k05_glyph_contamination", r"""WITH t AS (SELECT doc_id, sys_status, sys_full_summary || CASE CAST(doc_id AS INT) % 7 WHEN 3 THEN repeat('GLYPH<23>.', 40) ELSE '' END AS text FROM v_docs)
SELECT doc_id, sys_status FROM t WHERE (9 * len(regexp_extract_all(text, '/gid\d{5}')) + length(array_to_string(regexp_extract_all(text, 'GLYPH<[^>]*>'), ''))) / nullif(length(text), 0) >= 0.10""")
def k05(spark, sf):
    """Every document's whole text; what counts is the share of its characters that are marks."""
    marks = F.when(F.col("doc_id").cast("int") % 7 == 3, F.repeat(F.lit("GLYPH<23>."), 40)).otherwise("")
    d = docs(spark, sf).withColumn("text", F.concat("sys_full_summary", marks))
    return d.where(quality.glyph_ratio(F.col("text")) >= 0.10).select("doc_id", "sys_status")


@query("k05b_glyph_reset", r"""WITH t AS (SELECT doc_id, sys_full_summary || CASE CAST(doc_id AS INT) % 7 WHEN 3 THEN repeat('GLYPH<23>.', 40) WHEN 5 THEN repeat('/gid00023 ', 40) ELSE '' END AS text FROM v_docs)
SELECT doc_id, 'downloaded' AS sys_status, 'Reset: glyph contamination in parsed output' AS sys_error_message FROM t WHERE length(text) >= 200 AND
(9 * len(regexp_extract_all(text, '/gid\d{5}')) + length(array_to_string(regexp_extract_all(text, 'GLYPH<[^>]*>'), ''))) / length(text) >= 0.10""")
def k05b(spark, sf):
    """The new status and message of such documents."""
    k = F.col("doc_id").cast("int") % 7
    marks = F.when(k == 3, F.repeat(F.lit("GLYPH<23>."), 40)).when(k == 5, F.repeat(F.lit("/gid00023 "), 40)).otherwise("")
    d = docs(spark, sf).withColumn("text", F.concat("sys_full_summary", marks))
    return quality.reset_contaminated(d, "text").select("doc_id", "sys_status", "sys_error_message")


@query("k08_backfill", """SELECT doc_id, coalesce(map_country, map_organization) AS map_country FROM v_docs""")
def k08(spark, sf):
    return quality.backfill(docs(spark, sf), {"map_country": "map_organization"}).select("doc_id", "map_country")


@query("k11_reset_failed", """SELECT doc_id, CASE WHEN sys_status IN ('parse_failed', 'summarize_failed', 'index_failed', 'stopped') THEN 'downloaded' ELSE sys_status END AS sys_status FROM v_docs""")
def k11(spark, sf):
    return quality.reset_failed(docs(spark, sf)).select("doc_id", "sys_status")


@query("k12_reset_status", """SELECT doc_id, sys_status AS old_status, 'downloaded' AS new_status FROM v_docs WHERE sys_status NOT IN ('download_error', 'downloaded')""")
def k12(spark, sf):
    return quality.reset_status(docs(spark, sf), True)


@query("k14_error_paths", """SELECT doc_id, sys_status AS old_status, 'download_error' AS new_status FROM v_docs WHERE CAST(doc_id AS INT) % 5 = 0 AND sys_status IN ('downloaded', 'parsed', 'summarized', 'tagged', 'indexed')""")
def k14(spark, sf):
    path = F.when(F.col("doc_id").cast("int") % 5 == 0, F.concat("sys_filepath", F.lit(".error"))).otherwise(F.col("sys_filepath"))
    return quality.error_path_consistency(docs(spark, sf).withColumn("sys_filepath", path))


@query("k18_fix_extensions", """SELECT doc_id, replace(sys_filepath, '.pdf', CASE WHEN CAST(doc_id AS INT) % 6 = 1 THEN '.docx' ELSE '.doc' END) AS sys_filepath, 'downloaded' AS sys_status FROM v_docs WHERE CAST(doc_id AS INT) % 3 = 1""")
def k18(spark, sf):
    d = docs(spark, sf)
    k = F.col("doc_id").cast("int")
    files = d.select(F.when(k % 6 == 1, F.regexp_replace("sys_filepath", r"\.pdf$", ".docx")).when(k % 3 == 1, F.regexp_replace("sys_filepath", r"\.pdf$", ".doc")).otherwise(F.col("sys_filepath")).alias("path"))
    return quality.fix_extensions(d, files)


@query("h01_uuid5")
def h01(spark, sf):
    return docs(spark, sf).select("doc_id", strings.uuid5(F.concat(F.lit("https://docs.example/"), F.col("doc_id"))).alias("uuid"))


@query("h02_canonical_sha", """SELECT doc_id, sha256('lang=' || map_language || chr(10) || 'org=' || map_organization) AS sha FROM v_docs""")
def h02(spark, sf):
    return docs(spark, sf).select("doc_id", strings.canonical_sha(F.create_map(F.lit("org"), "map_organization", F.lit("lang"), "map_language")).alias("sha"))


@query("h03_clean_title", """SELECT doc_id, trim(map_title) AS title FROM v_docs""")
def h03(spark, sf):
    return docs(spark, sf).select("doc_id", strings.clean_title(F.concat("map_title", F.lit(" - https://x.example/a"))).alias("title"))


@query("h04_relative_path", """SELECT doc_id, sys_filepath AS path FROM v_docs""")
def h04(spark, sf):
    return docs(spark, sf).select("doc_id", strings.relative_path(F.concat(F.lit("/mnt/data/"), "sys_filepath"), F.col("map_organization")).alias("path"))


@query("h05_sanitize_filename", r"""SELECT doc_id, coalesce(nullif(regexp_replace(regexp_replace(regexp_replace(regexp_replace(translate(lower(substr(map_title, 1, 20)), 'áàâäãåçéèêëíìîïñóòôöõúùûüýÿ', 'aaaaaaceeeeiiiinooooouuuuyy'), ' ', '_', 'g'), '[^a-z0-9_.-]', '', 'g'), '_+', '_', 'g'), '^[_.-]+|[_.-]+$', '', 'g'), ''), 'untitled') AS name FROM v_docs""")
def h05(spark, sf):
    return docs(spark, sf).select("doc_id", strings.sanitize_filename(F.substring("map_title", 1, 20)).alias("name"))


@query("h13_year_to_unix", """SELECT doc_id, epoch(make_date(CAST(map_published_year AS INT), 1, 1))::BIGINT AS unix FROM v_docs""")
def h13(spark, sf):
    return docs(spark, sf).select("doc_id", strings.year_to_unix(F.col("map_published_year")).alias("unix"))


@query("h14_normalize_title", r"""SELECT doc_id, regexp_replace(lower(trim(map_title)), '\s+', ' ', 'g') AS title FROM v_docs""")
def h14(spark, sf):
    return docs(spark, sf).select("doc_id", strings.normalize_title(F.col("map_title")).alias("title"))


@query("h15_taxonomy_name", """SELECT doc_id, map_language AS code, map_organization || ' - x' AS name FROM v_docs""")
def h15(spark, sf):
    label = F.concat("map_language", F.lit(" - "), "map_organization", F.lit(" - x"))
    return docs(spark, sf).select("doc_id", strings.extract_code(label).alias("code"), strings.taxonomy_name(label).alias("name"))


@query("h16_split_multivalue", f"""SELECT doc_id, array_to_string({COUNTRIES}, '#') AS parts, len(regexp_extract_all(map_country, '[a-z][A-Z]')) >= 2 AS concatenated FROM v_docs WHERE map_country IS NOT NULL""")
def h16(spark, sf):
    return docs(spark, sf).where("map_country is not null").select("doc_id", F.array_join(strings.split_multivalue(F.col("map_country")), "#").alias("parts"), strings.looks_concatenated(F.col("map_country")).alias("concatenated"))


@query("h19_node_id", """SELECT doc_id, doc_id AS node_id FROM v_docs""")
def h19(spark, sf):
    return docs(spark, sf).select("doc_id", strings.node_id_from_name(F.concat(F.lit("report_2_"), "doc_id", F.lit(".pdf"))).alias("node_id"))


@query("h22_excel_truncate", """SELECT doc_id, CASE WHEN length(sys_full_summary) > 1000 THEN substr(sys_full_summary, 1, 997) || '...' ELSE sys_full_summary END AS text FROM v_docs""")
def h22(spark, sf):
    return docs(spark, sf).select("doc_id", strings.excel_truncate(F.col("sys_full_summary"), 1000).alias("text"))


@query("h23_language_name", """SELECT doc_id, CASE map_language WHEN 'en' THEN 'English' WHEN 'fr' THEN 'French' WHEN 'es' THEN 'Spanish' WHEN 'de' THEN 'German' ELSE map_language END AS language FROM v_docs""")
def h23(spark, sf):
    return docs(spark, sf).select("doc_id", strings.language_name(F.col("map_language")).alias("language"))


@query("h07_fix_mojibake", """SELECT doc_id, CASE CAST(doc_id AS INT) % 3 WHEN 0 THEN 'é' || map_organization || 'à l’ö' WHEN 1 THEN 'Ž' || map_organization || ' lÕo' ELSE map_organization END AS text FROM v_docs""")
def h07(spark, sf):
    return docs(spark, sf).select("doc_id", strings.fix_mojibake(F.when(F.col("doc_id").cast("int") % 3 == 0, F.concat(F.lit("Ž"), "map_organization", F.lit("ˆ lÕš"))).when(F.col("doc_id").cast("int") % 3 == 1, F.concat(F.lit("Ž"), "map_organization", F.lit(" lÕo"))).otherwise(F.col("map_organization"))).alias("text"))


@query("h20_boost_fields", """SELECT doc_id, 0.25::DOUBLE AS a, 0.5::DOUBLE AS b, 0.5::DOUBLE AS c FROM v_docs""")
def h20(spark, sf):
    m = strings.parse_boost_fields(F.concat(F.lit("a:0.25, b,c:"), "map_language"))
    return docs(spark, sf).select("doc_id", *(F.try_element_at(m, F.lit(k)).alias(k) for k in "abc"))


@query("t18_roman_to_int", """SELECT doc_id, CASE CAST(doc_id AS INT) % 4 WHEN 0 THEN 4 WHEN 1 THEN 12 WHEN 2 THEN 49 END AS value FROM v_docs""")
def t18(spark, sf):
    k = F.col("doc_id").cast("int") % 4
    return docs(spark, sf).select("doc_id", strings.roman_to_int(F.when(k == 0, "iv").when(k == 1, "XII").when(k == 2, "xlix").otherwise("iiiix")).alias("value"))


@query("k02_split_sdgs", """SELECT doc_id, 'SDG 1 - No Poverty; SDG ' || doc_id || ' - Other' AS sdgs FROM v_docs""")
def k02(spark, sf):
    return docs(spark, sf).select("doc_id", quality.split_sdgs(F.concat(F.lit("SDG 1 - No Poverty SDG "), "doc_id", F.lit(" - Other"))).alias("sdgs"))


@query("k06_summary_headings", """SELECT CASE CAST(doc_id AS INT) % 4 WHEN 0 THEN 'h1' WHEN 1 THEN 'bullet_bold' WHEN 2 THEN 'ok' ELSE 'unknown' END AS pattern, count(*) AS n FROM v_docs GROUP BY 1""")
def k06(spark, sf):
    k = F.col("doc_id").cast("int") % 4
    text = F.when(k == 0, "# A\ntext").when(k == 1, "- **A**\ntext").when(k == 2, "## A\ntext").otherwise("text")
    return docs(spark, sf).groupBy(quality.heading_pattern(text).alias("pattern")).agg(F.count("*").alias("n"))


@query("k13_clear_taxonomies", """SELECT doc_id, CAST(NULL AS STRING) AS map_country FROM v_docs""")
def k13(spark, sf):
    return quality.clear_fields(docs(spark, sf), "map_country").select("doc_id", "map_country")


@query("k16_taxonomy_storage", """SELECT count(*) FILTER (map_country IS NOT NULL) AS with_tags, count(*) FILTER (map_country IS NULL) AS without_tags FROM v_docs""")
def k16(spark, sf):
    return quality.taxonomy_storage(docs(spark, sf), "map_country")


@query("g04_merge_codes", """SELECT doc_id, 'c' || CAST(CAST(doc_id AS INT) % 3 AS STRING) AS code, 'first' AS reason, 'name' || CAST(CAST(doc_id AS INT) % 3 AS STRING) AS name FROM v_docs""")
def g04(spark, sf):
    code = F.concat(F.lit("c"), (F.col("doc_id").cast("int") % 3).cast("string"))
    rows = docs(spark, sf).select("doc_id", F.explode(F.array(*(F.concat(c, F.lit(x)) for c, x in ((code, "/later/2"), (code, "/first/1"), (F.lit("zz"), "/unknown/0"))))).alias("r"))
    part = lambda k: F.element_at(F.split("r", "/"), k)
    rows = rows.select("doc_id", part(1).alias("code"), part(2).alias("reason"), part(3).cast("int").alias("ord"))
    names = spark.createDataFrame([(f"c{i}", f"name{i}") for i in range(3)], "code string, name string")
    return quality.merge_codes(rows, names)


@query("h18_model_prefix", """SELECT doc_id, 'query: ' || map_language AS text FROM v_docs""")
def h18(spark, sf):
    return docs(spark, sf).select("doc_id", strings.model_prefix(F.col("map_language"), F.lit("multilingual-E5"), "query").alias("text"))


@query("h25_position_hint", """SELECT doc_id, round((842 - CAST(doc_id AS INT) % 842) / 842.0, 3)::DOUBLE AS hint FROM v_docs""")
def h25(spark, sf):
    return docs(spark, sf).select("doc_id", strings.position_hint((F.col("doc_id").cast("int") % 842).cast("double")).alias("hint"))


@query("h21_strip_markdown", """SELECT doc_id, 'Head' || chr(10) || 'a b ' || doc_id AS text FROM v_docs""")
def h21(spark, sf):
    md = F.concat(F.lit("![x](y.png)<!-- c -->**Head**\na \t b "), "doc_id", F.lit("```"))
    return docs(spark, sf).select("doc_id", strings.strip_markdown(md).alias("text"))


@query("g03_union_stage_docs", """SELECT doc_id, CASE sys_status WHEN 'tagged' THEN 1 WHEN 'summarized' THEN 2 ELSE 3 END AS ord FROM v_docs WHERE sys_status IN ('tagged', 'summarized', 'parsed')""")
def g03(spark, sf):
    return quality.union_stages(docs(spark, sf), ["tagged", "summarized", "parsed"]).select("doc_id", "ord")
