"""Registered queries over chunks, vectors and ranked hits."""

from __future__ import annotations

from pyspark.sql import functions as F

from docspark.operators import chunker
from docspark.operators import chunks as ch
from docspark.operators import elements as el
from docspark.operators import facets, filters, search, similar, stats, vector_index
from docspark.plans.registry import query
from docspark.plans.views import spread, view
from docspark.sources.shared import fingerprint, shared_folder


def chunks(spark, sf):
    return view(spark, sf, "v_chunks")


def hits(spark, sf):
    return view(spark, sf, "v_hits").withColumn("doc_id", F.col("vec_id").cast("string"))


def embeddings(spark, sf):
    return spark.read.parquet(f"{sf}/embeddings.parquet")


def query_vectors(spark, sf):
    """The first vector of each class."""
    e = embeddings(spark, sf)
    first = e.groupBy("label").agg(F.min_by("embedding", "vec_id").alias("qv"))
    return first.withColumnRenamed("label", "query_id")


HITS = "(SELECT query_id, vec_id, CAST(vec_id AS STRING) AS doc_id, score, ord FROM v_hits)"


@query("e01_dedupe_chunks", """SELECT doc_id, page_num, chunk_id FROM (SELECT *, row_number() OVER (PARTITION BY doc_id, page_num, md5(text) ORDER BY chunk_id) AS t FROM v_chunks) q WHERE t = 1""")
def e01(spark, sf):
    return ch.dedupe_chunks(chunks(spark, sf)).select("doc_id", "page_num", "chunk_id")


@query("e02_dedupe_built", """SELECT doc_id, page_num, min(pos) AS pos FROM v_chunks GROUP BY doc_id, page_num, text""")
def e02(spark, sf):
    return ch.dedupe_built(chunks(spark, sf)).select("doc_id", "page_num", "pos")


@query("e22_number_chunks", """SELECT chunk_id, row_number() OVER (PARTITION BY doc_id ORDER BY pos) - 1 AS idx FROM v_chunks""")
def e22(spark, sf):
    return ch.number_chunks(chunks(spark, sf)).select("chunk_id", F.col("idx").cast("long").alias("idx"))


@query("d25_duplicate_groups", """SELECT doc_id, md5(text) AS text_md5, count(*) AS n, min(chunk_id) AS keep_id FROM v_chunks GROUP BY 1, 2 HAVING count(*) > 1""")
def d25(spark, sf):
    return stats.duplicate_groups(chunks(spark, sf))


SETS = r"""w AS (SELECT chunk_id, list_filter(string_split_regex(lower(text), '\s+'), lambda x: x <> '') AS w FROM v_chunks),
s AS (SELECT chunk_id, list_sort(list_distinct(list_transform(range(1, greatest(len(w) - 4, 1) + 1), lambda i: array_to_string(w[i:i + 4], ' ')))) AS s FROM w WHERE len(w) > 0),
c AS (SELECT chunk_id, s, min(chunk_id) OVER (PARTITION BY s) AS class_id FROM s)"""


@query("c17_near_duplicate_pairs", f"""WITH {SETS}, h AS (SELECT chunk_id, len(s) AS n, unnest(s) AS x FROM c WHERE chunk_id = class_id), p AS (SELECT a.chunk_id AS u, b.chunk_id AS v, a.n AS un, b.n AS vn, count(*) AS shared FROM h a JOIN h b ON a.x = b.x AND a.chunk_id < b.chunk_id GROUP BY ALL)
SELECT u, v, shared, un + vn - shared AS total FROM p WHERE shared * 100 >= (un + vn - shared) * 80""")
def c17(spark, sf):
    return similar.near_duplicate_chunks(chunks(spark, sf)).select("u", "v", F.col("shared").cast("long").alias("shared"), F.col("total").cast("long").alias("total"))


@query("c17b_equal_sets", f"""WITH {SETS} SELECT v.chunk_id, coalesce(class_id, v.chunk_id) AS class_id, coalesce(len(s), 0) AS n FROM v_chunks v LEFT JOIN c ON v.chunk_id = c.chunk_id""")
def c17b(spark, sf):
    return similar.equal_sets(chunks(spark, sf)).withColumn("n", F.col("n").cast("long"))


@query("d26_top_duplicated", """WITH g AS (SELECT doc_id, count(*) - 1 AS e FROM v_chunks GROUP BY doc_id, md5(text) HAVING count(*) > 1), t AS (SELECT doc_id, sum(e)::BIGINT AS extras FROM g GROUP BY 1 ORDER BY extras DESC, doc_id LIMIT 10) SELECT t.doc_id, extras, map_title FROM t LEFT JOIN v_docs d ON t.doc_id = d.doc_id""")
def d26(spark, sf):
    return stats.top_duplicated_docs(chunks(spark, sf), view(spark, sf, "v_docs"))


# lines as blocks: short ones are headers of three levels, some are list items, and some have no box
BLOCKS = "SELECT doc_id, pos, text, page_num, CASE WHEN length(text) <= 90 AND pos % 4 = 0 THEN 'section_header' WHEN pos % 7 = 3 THEN 'list_item' WHEN pos % 11 = 6 THEN 'caption' ELSE 'text' END AS label, CASE WHEN length(text) <= 90 AND pos % 4 = 0 THEN 1 + length(text) % 3 END AS level, CASE WHEN pos % 5 <> 2 THEN concat('[', CAST(pos AS STRING), ', ', CAST(length(text) AS STRING), ']') END AS box FROM {v_chunks}"
_OPEN = ", ".join(f"last_value(CASE WHEN level = {k} THEN {c} END IGNORE NULLS) OVER w AS {c[0]}{k}" for k in (1, 2, 3) for c in ("pos", "text"))
CHUNKS = rf"""b AS ({BLOCKS.format(v_chunks="v_chunks")}), h AS (SELECT *, {_OPEN} FROM b WINDOW w AS (PARTITION BY doc_id ORDER BY pos ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW)),
a AS (SELECT *, list_filter([t1, CASE WHEN p2 > coalesce(p1, -1) THEN t2 END, CASE WHEN p3 > greatest(coalesce(p1, -1), coalesce(p2, -1)) THEN t3 END], lambda x: x IS NOT NULL) AS path FROM h),
x AS (SELECT *, string_split_regex(trim(text), '\s+') AS w, CASE WHEN path IS NOT DISTINCT FROM lag(path) OVER (PARTITION BY doc_id ORDER BY pos) AND row_number() OVER (PARTITION BY doc_id ORDER BY pos) > 1 THEN 0 ELSE 1 END AS fresh FROM a WHERE label <> 'section_header'),
r AS (SELECT *, sum(fresh) OVER (PARTITION BY doc_id ORDER BY pos) AS run FROM x),
p AS (SELECT doc_id, run, path, pos, label, page_num, box, unnest(range(0, CAST(ceil(len(w) / 80.0) AS BIGINT))) AS part, w, text FROM r),
o AS (SELECT doc_id, run, path, pos, part, label, page_num, box, CASE WHEN len(w) > 80 THEN array_to_string(w[part * 80 + 1:part * 80 + 80], ' ') ELSE text END AS piece, CAST(least(80, len(w) - part * 80) AS INT) AS n, row_number() OVER (PARTITION BY doc_id, run ORDER BY pos, part) AS k FROM p),
z AS (SELECT doc_id, run, k, n AS used, 0 AS id FROM o WHERE k = 1 UNION ALL SELECT o.doc_id, o.run, o.k, CASE WHEN used + n > 80 THEN n ELSE used + n END, CASE WHEN used + n > 80 THEN id + 1 ELSE id END FROM z JOIN o ON o.doc_id = z.doc_id AND o.run = z.run AND o.k = z.k + 1),
g AS (SELECT o.doc_id, o.run, id, any_value(path) AS path, string_agg(piece, chr(10) || chr(10) ORDER BY o.k) AS text, CAST(sum(n) AS INT) AS tokens, min(page_num) AS page_num, list_sort(list(DISTINCT label)) AS types, string_agg(box, ';' ORDER BY o.k) FILTER (WHERE NOT again) AS boxes FROM (SELECT o.*, id, lag(pos) OVER (PARTITION BY o.doc_id, o.run, id ORDER BY o.k) IS NOT DISTINCT FROM pos AS again FROM o JOIN z USING (doc_id, run, k)) o GROUP BY o.doc_id, o.run, id)
SELECT doc_id, CAST(row_number() OVER (PARTITION BY doc_id ORDER BY run, id) - 1 AS INT) AS chunk, array_to_string(path, ' > ') AS headings, text, tokens, page_num, array_to_string(types, ',') AS item_types, coalesce(boxes, '') AS boxes FROM g WHERE length(trim(text)) >= 100 OR list_has_any(types, ['list_item', 'section_header', 'caption', 'table_caption'])"""


def _told(made):
    joined = lambda c, by: F.array_join(c, by).alias(c)
    return made.select("doc_id", "chunk", joined("headings", " > "), "text", "tokens", "page_num", joined("item_types", ","), joined("boxes", ";"))


@query("t01_build_chunks", f"""WITH RECURSIVE {CHUNKS}""")
def t01(spark, sf):
    return _told(chunker.chunk_blocks(spark.sql(BLOCKS, v_chunks=chunks(spark, sf)), 80))


@query("j08_chunk_function", f"""WITH RECURSIVE {CHUNKS}""")
def j08(spark, sf):
    """The same by the table function, of one array of blocks a document."""
    blocks = spark.sql(BLOCKS, v_chunks=chunks(spark, sf))
    docs = blocks.groupBy("doc_id").agg(F.collect_list(F.struct("pos", "text", "label", "level", "page_num", "box")).alias("blocks"))
    return _told(chunker.chunk_documents(docs, 80))


@query("t02_drop_small", """SELECT chunk_id FROM v_chunks WHERE length(trim(text)) >= 100""")
def t02(spark, sf):
    return ch.drop_small(chunks(spark, sf)).select("chunk_id")


@query("t03_limit_tokens", r"""SELECT chunk_id, CASE WHEN len(w) > 20 THEN array_to_string(w[1:20], ' ') ELSE text END AS text FROM (SELECT chunk_id, text, string_split_regex(trim(text), '\s+') AS w FROM v_chunks WHERE trim(text) <> '') q""")
def t03(spark, sf):
    return ch.limit_tokens(chunks(spark, sf), 20).select("chunk_id", "text")


@query("t06_hierarchy_prefix", """SELECT chunk_id, '-- b > c > ' || doc_id || ' --' || chr(10) || chr(10) AS prefix FROM v_chunks""")
def t06(spark, sf):
    return chunks(spark, sf).select("chunk_id", ch.hierarchy_prefix(F.array(F.lit("a"), F.lit("<b>"), F.lit("c"), F.col("doc_id"))).alias("prefix"))


@query("t08_strip_heading", """SELECT chunk_id, text FROM v_chunks""")
def t08(spark, sf):
    return chunks(spark, sf).select("chunk_id", ch.strip_heading(F.concat(F.lit("-- a > b --\n\n"), "text"), F.lit("x")).alias("text"))


@query("t27_sentences")
def t27(spark, sf):
    return ch.sentences(view(spark, sf, "v_docs"), "sys_full_summary")


@query("t28_split_overlap", """SELECT doc_id, part, substr(t, CAST(part AS INT) * 700 + 1, 1500) AS text FROM (SELECT doc_id, sys_full_summary AS t, unnest(range(0, greatest(ceil((length(sys_full_summary) - 800) / 700.0), 1)::INT)) AS part FROM v_docs WHERE length(sys_full_summary) > 0) q""")
def t28(spark, sf):
    return ch.split_overlap(view(spark, sf, "v_docs"), "sys_full_summary", 1500, 800).withColumn("part", F.col("part").cast("long"))


@query("t40_drop_repeats", r"""SELECT thread_id, turn FROM (SELECT thread_id, turn, trim(regexp_replace(content, '\s+', ' ', 'g')) AS p, lag(trim(regexp_replace(content, '\s+', ' ', 'g'))) OVER (PARTITION BY thread_id ORDER BY turn) AS b FROM v_messages) q WHERE b IS NULL OR NOT contains(b, p)""")
def t40(spark, sf):
    return ch.drop_repeats(view(spark, sf, "v_messages")).select("thread_id", "turn")


@query("t41_citations", """SELECT doc_id AS answer_id, citation, row_number() OVER (PARTITION BY doc_id ORDER BY citation) AS number FROM (SELECT DISTINCT doc_id, unnest([2, 1 + CAST(doc_id AS INT) % 5, 3]) AS citation FROM v_docs) q""")
def t41(spark, sf):
    text = F.concat(F.lit("As shown [2, "), (F.col("doc_id").cast("int") % 5 + 1).cast("string"), F.lit("] and [3][99]"))
    return ch.citations(view(spark, sf, "v_docs").select(F.col("doc_id").alias("answer_id"), text.alias("text"), F.lit(9).alias("n_hits"))).withColumn("number", F.col("number").cast("long"))


@query("t44_redundant_with_table", r"""WITH t AS (SELECT doc_id, string_agg(text, ' ' ORDER BY pos) AS tab FROM v_chunks WHERE pos < 3 GROUP BY 1), w AS (SELECT chunk_id, lower(tab) AS tab, list_filter(regexp_extract_all(lower(text), '\w+'), lambda x: length(x) > 3) AS w FROM v_chunks c JOIN t ON c.doc_id = t.doc_id)
SELECT chunk_id, coalesce(len(list_filter(w, lambda x: contains(tab, x))) / nullif(len(w), 0) > 0.8, false) AS redundant FROM w""")
def t44(spark, sf):
    """Every chunk against the first lines of its document."""
    c = chunks(spark, sf)
    table = c.where("pos < 3").groupBy("doc_id").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("pos", "text"))), lambda x: x["text"]), " ").alias("tab"))
    return c.join(table, "doc_id").select("chunk_id", ch.redundant_with_table(F.col("text"), F.col("tab")).alias("redundant"))


@query("t45_image_mentions", r"""WITH m AS (SELECT chunk_id, doc_id, 'see Figure ' || CAST(pos % 4 AS STRING) || '.1, TABLE  ' || CAST(pos % 3 AS STRING) || ', ' || text AS t, pos FROM v_chunks)
SELECT DISTINCT chunk_id, m.doc_id, number, 'image_' || number || '.png' AS file FROM (SELECT chunk_id, doc_id, unnest(regexp_extract_all(lower(t), '\b(?:figure|table|graph|map)\s+(\d+(?:\.\d+)?)', 1)) AS number FROM m) m WHERE number IN ('1.1', '2', CAST(CAST(m.doc_id AS INT) % 4 AS STRING) || '.1')""")
def t45(spark, sf):
    c = chunks(spark, sf)
    text = F.concat(F.lit("see Figure "), (F.col("pos") % 4).cast("string"), F.lit(".1, TABLE  "), (F.col("pos") % 3).cast("string"), F.lit(", "), "text")
    own = F.concat((F.col("doc_id").cast("int") % 4).cast("string"), F.lit(".1"))
    images = c.select("doc_id", F.explode(F.array(F.lit("1.1"), F.lit("2"), own)).alias("number")).distinct()
    return ch.image_mentions(c.withColumn("text", text), images.withColumn("file", F.concat(F.lit("image_"), "number", F.lit(".png"))))


@query("f01_dense_search", """SELECT query_id, vec_id, score, ord FROM v_hits WHERE ord <= 10""")
def f01(spark, sf):
    return search.dense_search(embeddings(spark, sf), query_vectors(spark, sf), 10)


QUERIES = ("the of and", "en de la", "tion the the")
_Q = ", ".join(f"({i}, {q!r})" for i, q in enumerate(QUERIES))


def text_queries(spark):
    return spark.createDataFrame(list(enumerate(QUERIES)), "query_id int, query string")


@query("f02_bm25_search", rf"""WITH q AS (SELECT query_id, term, count(*) AS times FROM (SELECT query_id, unnest(string_split(query, ' ')) AS term FROM (VALUES {_Q}) v(query_id, query)) z GROUP BY 1, 2),
w AS (SELECT chunk_id, list_filter(string_split_regex(regexp_replace(lower(text), '[^\p{{L}}\p{{N}}_\s]', '', 'g'), '\s+'), lambda x: x <> '') AS w FROM v_chunks), l AS (SELECT chunk_id, len(w) AS n FROM w WHERE len(w) > 0),
s AS (SELECT count(*) AS docs, avg(n) AS avg_len FROM l), p AS (SELECT chunk_id, term, count(*) AS tf FROM (SELECT chunk_id, unnest(w) AS term FROM w) u WHERE term IN (SELECT term FROM q) GROUP BY 1, 2),
d AS (SELECT term, count(*) AS df FROM p GROUP BY 1),
r AS (SELECT query_id, chunk_id, round(sum(ln((docs - df + 0.5) / (df + 0.5) + 1) * tf * 2.5 / (tf + 1.5 * (0.25 + 0.75 * n / avg_len)) * times), 6) AS score FROM p JOIN d USING (term) JOIN q USING (term) JOIN l USING (chunk_id), s GROUP BY 1, 2)
SELECT query_id, chunk_id, score, ord FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, chunk_id) AS ord FROM r WHERE score > 0) z WHERE ord <= 20""")
def f02(spark, sf):
    # \w without the Unicode flag would drop accented letters
    c = chunks(spark, sf).withColumn("text", F.regexp_replace(F.lower("text"), r"[^\p{L}\p{N}_\s]", ""))
    return search.bm25_search(c.select("chunk_id", F.filter(F.split("text", r"\s+"), lambda x: x != "").alias("tokens")), text_queries(spark), 20)


BM25_DOCS = r"""w AS (SELECT doc_id, list_filter(string_split_regex(regexp_replace(lower(sys_full_summary), '[^\p{L}\p{N}_\s]', '', 'g'), '\s+'), lambda x: x <> '') AS w FROM v_docs), l AS (SELECT doc_id, len(w) AS n FROM w WHERE len(w) > 0),
s AS (SELECT count(*) AS docs, avg(n) AS avg_len FROM l), p AS (SELECT doc_id, term, count(*) AS tf FROM (SELECT doc_id, unnest(w) AS term FROM w) u WHERE term IN ('the', 'et', 'der') GROUP BY 1, 2),
c AS (SELECT term, count(*) AS df FROM p GROUP BY 1),
q AS (SELECT label AS query_id, CASE label % 3 WHEN 0 THEN 'the' WHEN 1 THEN 'et' ELSE 'der' END AS term FROM (SELECT DISTINCT label FROM embeddings) e),
b AS (SELECT query_id, doc_id, round(ln((docs - df + 0.5) / (df + 0.5) + 1) * tf * 2.5 / (tf + 1.5 * (0.25 + 0.75 * n / avg_len)), 6) AS score FROM p JOIN c USING (term) JOIN q USING (term) JOIN l USING (doc_id), s)"""


@query("f03_hybrid_search", f"""WITH {BM25_DOCS}, s2 AS (SELECT query_id, doc_id, ord FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, doc_id) AS ord FROM b WHERE score > 0) z WHERE ord <= 30), d AS (SELECT query_id, doc_id, ord FROM {HITS} z WHERE ord <= 30),
j AS (SELECT query_id, doc_id, d.ord AS a, s2.ord AS b, round(coalesce(0.7 / (d.ord + 60), 0) + coalesce(0.3 / (s2.ord + 60), 0), 9) AS score FROM d FULL JOIN s2 USING (query_id, doc_id))
SELECT query_id, doc_id, score::DOUBLE AS score, ord FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, a NULLS LAST, b) AS ord FROM j) z WHERE ord <= 20""")
def f03(spark, sf):
    plain = F.regexp_replace(F.lower("sys_full_summary"), r"[^\p{L}\p{N}_\s]", "")
    tokens = spread(view(spark, sf, "v_docs").select("doc_id", "sys_full_summary")).select("doc_id", F.filter(F.split(plain, r"\s+"), lambda x: x != "").alias("tokens"))
    k = F.col("query_id") % 3
    queries = query_vectors(spark, sf).withColumn("query", F.when(k == 0, "the").when(k == 1, "et").otherwise("der"))
    return search.hybrid(embeddings(spark, sf), tokens, queries, 0.7, 20, 30)


@query("f01b_dense_search_all", """WITH q AS (SELECT vec_id AS query_id, CAST(embedding AS DOUBLE[]) AS qv FROM embeddings WHERE vec_id % 50 = 0), h AS (SELECT query_id, vec_id, round(list_cosine_similarity(CAST(embedding AS DOUBLE[]), qv), 6) AS score FROM embeddings, q)
SELECT query_id, vec_id, score, ord FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS ord FROM h) z WHERE ord <= 10""")
def f01b(spark, sf):
    """Every vector whose id is divisible by 50 asks all."""
    e = embeddings(spark, sf)
    return search.dense_search(e, e.where("vec_id % 50 = 0").select(F.col("vec_id").alias("query_id"), F.col("embedding").alias("qv")), 10)


@query("t37_batch_research", """WITH q AS (SELECT vec_id AS query_id, CAST(embedding AS DOUBLE[]) AS qv, vec_id // 250 AS run_id, row_number() OVER (PARTITION BY vec_id // 250 ORDER BY vec_id) AS turn FROM embeddings WHERE vec_id % 50 = 0),
h AS (SELECT run_id, query_id, turn, vec_id, round(list_cosine_similarity(CAST(embedding AS DOUBLE[]), qv), 6) AS score FROM embeddings, q WHERE turn <= 4),
o AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS ord FROM h) z WHERE ord <= 20),
f AS (SELECT run_id, vec_id, row_number() OVER (PARTITION BY run_id ORDER BY min(turn * 100 + ord)) AS number FROM o GROUP BY 1, 2)
SELECT run_id, query_id, count(*) AS n_hits, string_agg(number || ':' || vec_id, ' ' ORDER BY ord) FILTER (WHERE ord <= 10) AS cards FROM o JOIN f USING (run_id, vec_id) GROUP BY 1, 2""")
def t37(spark, sf):
    """Vectors whose id is divisible by 50 ask, five a run, of which four count."""
    e = embeddings(spark, sf)
    asking = e.where("vec_id % 50 = 0").select(F.expr("vec_id div 250").alias("run_id"), F.col("vec_id").alias("query_id"), F.col("vec_id").alias("turn"), F.col("embedding").alias("qv"))
    got = search.batch_research(asking, search.dense_search(e, asking, 20))
    return got.select("run_id", "query_id", "n_hits", F.array_join(F.transform("cards", lambda c: F.concat(c["number"], F.lit(":"), c["vec_id"])), " ").alias("cards"))


@query("f17_ann_search")
def f17(spark, sf):
    """Every vector whose id is divisible by 50 asks the index of all, which is made once for each state of the table."""
    e = embeddings(spark, sf)
    index = vector_index.built(e, f"{shared_folder(spark)}/vector-index-{fingerprint(e)}")
    return index.search(e, e.where("vec_id % 50 = 0").select(F.col("vec_id").alias("query_id"), F.col("embedding").alias("qv")), 10)


@query("f06_rerank", f"""WITH h AS (SELECT query_id, doc_id, ord, len(list_intersect(list_distinct(regexp_extract_all(lower(map_title), '[\\p{{L}}\\p{{N}}_]+')), ['the', 'et'])) / 2.0 AS s FROM {HITS} h JOIN v_docs d USING (doc_id)),
r AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY CASE WHEN ord <= 60 THEN 0 ELSE 1 END, CASE WHEN ord <= 60 THEN s END DESC, ord) AS place FROM h) SELECT query_id, doc_id, place AS ord FROM r WHERE place <= 50""")
def f06(spark, sf):
    """The first sixty hits by the share of the query's words in their titles."""
    h = hits(spark, sf).join(view(spark, sf, "v_docs").select("doc_id", F.col("map_title").alias("text")), "doc_id")
    queries = h.select("query_id").distinct().withColumn("query", F.lit("the et"))
    return search.rerank(h, search.score_hits(h, queries, 60, "scorer", "doc_id"), 60, 50, "doc_id").select("query_id", "doc_id", "ord")


@query("f11_post_search", f"""WITH h AS (SELECT query_id, h.doc_id, score, ord, map_title AS text, coalesce(map_published_year, '') AS year, row_number() OVER (PARTITION BY query_id ORDER BY ord) AS o2 FROM {HITS} h JOIN v_docs d USING (doc_id) WHERE length(trim(map_title)) >= 20),
r AS (SELECT *, round(score * 0.7 + 0.3 * coalesce(exp(-0.5 * pow(greatest(DATE '2024-06-30' - make_date(TRY_CAST(year AS INT), 12, 31), 0) / 365.0, 2)), 0.5), 9) AS s FROM h),
l AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY s DESC, o2) AS o3 FROM r) z WHERE o3 <= 40),
t AS (SELECT *, row_number() OVER (PARTITION BY query_id, trim(text) ORDER BY coalesce(TRY_CAST(year AS INT), 0) DESC, s DESC, o3) AS turn, min(o3) OVER (PARTITION BY query_id, trim(text)) AS place FROM l)
SELECT query_id, doc_id, s AS score, row_number() OVER (PARTITION BY query_id ORDER BY place) AS ord FROM t WHERE turn = 1""")
def f11(spark, sf):
    h = hits(spark, sf).join(view(spark, sf, "v_docs").select("doc_id", F.col("map_title").alias("text"), F.coalesce("map_published_year", F.lit("")).alias("year")), "doc_id")
    queries = h.select("query_id").distinct().withColumn("query", F.lit("any"))
    return search.post_search(h, queries, min_chars=20, recency=(0.3, 365.0, "2024-06-30"), limit=40, deduplicate=True, id_col="doc_id").select("query_id", "doc_id", "score", "ord")


@query("f04_resolve_weight", """SELECT event_id, CASE WHEN w >= 0.99 THEN 1.0 WHEN w <= 0.01 THEN 0.0 WHEN event_id % 3 < 2 THEN 0.25 ELSE w END::DOUBLE AS weight FROM (SELECT event_id, (event_id % 101) / 100.0 AS w FROM events) q""")
def f04(spark, sf):
    e = spark.read.parquet(f"{sf}/events.parquet")
    q = F.when(F.col("event_id") % 3 < 2, " one two ").otherwise("one two three")
    return e.select("event_id", search.resolve_weight(q, (F.col("event_id") % 101) / 100.0).alias("weight"))


@query("f07_recency_boost", f"""SELECT query_id, h.doc_id, round(score * 0.7 + 0.3 * coalesce(exp(-0.5 * pow(greatest(DATE '2024-06-30' - make_date(CAST(map_published_year AS INT), 12, 31), 0) / 365.0, 2)), 0.5), 9) AS score FROM {HITS} h JOIN v_docs d USING (doc_id)""")
def f07(spark, sf):
    h = hits(spark, sf).join(view(spark, sf, "v_docs").select("doc_id", "map_published_year"), "doc_id")
    return search.recency_boost(h, 0.3, 365.0, "2024-06-30").select("query_id", "doc_id", "score")


@query("f08_field_boost", f"""SELECT query_id, h.doc_id, round(CASE WHEN query_id % 2 = 0 AND map_organization = 'src' || CAST(query_id AS STRING) THEN CASE WHEN score < 0 THEN score + abs(score) * 0.5 ELSE score * 1.5 END ELSE score END, 9) AS score FROM {HITS} h JOIN v_docs d USING (doc_id)""")
def f08(spark, sf):
    h = hits(spark, sf).join(view(spark, sf, "v_docs").select("doc_id", "map_organization"), "doc_id")
    known = view(spark, sf, "v_docs").select(F.col("map_organization").alias("value")).distinct()
    queries = h.select("query_id").distinct().withColumn("query", F.when(F.col("query_id") % 2 == 0, F.concat(F.lit("reports of SRC"), F.col("query_id").cast("string"), F.lit(" now"))).otherwise("nothing known"))
    return search.field_boost(h, known, queries, "map_organization", 0.5).select("query_id", "doc_id", "score")


@query("f09_dedupe_results", f"""WITH h AS (SELECT query_id, doc_id, score, ord, map_published_year AS year, trim(map_language || map_document_type) AS t FROM {HITS} z JOIN v_docs USING (doc_id) WHERE ord <= 50)
SELECT query_id, doc_id, place FROM (SELECT *, row_number() OVER (PARTITION BY query_id, t ORDER BY coalesce(TRY_CAST(year AS INT), 0) DESC, score DESC, ord) AS k, min(ord) OVER (PARTITION BY query_id, t) AS place FROM h) q WHERE k = 1""")
def f09(spark, sf):
    d = view(spark, sf, "v_docs").select("doc_id", F.col("map_published_year").alias("year"), F.concat("map_language", "map_document_type", F.lit(" ")).alias("text"))
    return search.dedupe_results(hits(spark, sf).where("ord <= 50").join(d, "doc_id")).select("query_id", "doc_id", F.col("place").cast("long").alias("place"))


@query("f10_auto_min_score", """WITH r AS (SELECT *, count(*) OVER (PARTITION BY query_id) AS n, row_number() OVER (PARTITION BY query_id ORDER BY score, ord DESC) - 1 AS i FROM v_hits WHERE ord <= 77), m AS (SELECT query_id, max(score) AS least FROM r WHERE i = floor(n * 0.3) GROUP BY 1) SELECT query_id, vec_id, score FROM r JOIN m USING (query_id) WHERE score >= least""")
def f10(spark, sf):
    return search.auto_min_score(hits(spark, sf).where("ord <= 77")).select("query_id", "vec_id", "score")


@query("f12_title_search", """WITH t AS (SELECT * FROM (VALUES (0, ['an', 'the']), (1, ['de'])) v(query_id, tokens)), j AS (SELECT query_id, doc_id, len(tokens) AS score FROM v_docs, t WHERE len(list_filter(tokens, lambda x: contains(lower(map_title), x))) = len(tokens))
SELECT query_id, doc_id, score, ord FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, doc_id) AS ord FROM j) q WHERE ord <= 15""")
def f12(spark, sf):
    q = spark.createDataFrame([(0, "The an, the"), (1, "DE")], "query_id int, query string")
    return search.title_search(view(spark, sf, "v_docs"), q, 15).withColumns({"score": F.col("score").cast("long"), "ord": F.col("ord").cast("long")})


@query("f15_predict_centroid", """WITH u AS (SELECT vec_id, label, unnest(range(1, 65)) AS pos, CAST(embedding AS DOUBLE[]) AS e FROM embeddings), x AS (SELECT vec_id, label, pos, e[pos] / greatest(sqrt(list_dot_product(e, e)), 1e-8) AS x FROM u),
m AS (SELECT label, pos, avg(x) AS x FROM x GROUP BY 1, 2), n AS (SELECT label, greatest(sqrt(sum(x * x)), 1e-8) AS s FROM m GROUP BY 1), c AS (SELECT m.label AS predicted, list(x / s ORDER BY pos) AS c FROM m JOIN n USING (label) GROUP BY 1),
s AS (SELECT vec_id, label, predicted, round(list_dot_product(CAST(embedding AS DOUBLE[]), c), 6) AS score FROM embeddings, c)
SELECT vec_id, label, predicted, score FROM (SELECT *, row_number() OVER (PARTITION BY vec_id ORDER BY score DESC, predicted) AS k FROM s) q WHERE k = 1""")
def f15(spark, sf):
    e = embeddings(spark, sf)
    return search.predict_centroid(e, search.class_centroids(e))


@query("d32_classification_metrics", """WITH p AS (SELECT label AS a, CASE WHEN vec_id % 5 = 0 THEN (label + 1) % 10 ELSE label END AS p FROM embeddings), l AS (SELECT DISTINCT a AS label FROM p UNION SELECT DISTINCT p FROM p),
k AS (SELECT label, (SELECT count(*) FROM p WHERE a = label) AS support, (SELECT count(*) FROM p WHERE p = label) AS called, (SELECT count(*) FROM p WHERE a = label AND p = label) AS hit FROM l),
m AS (SELECT *, CASE WHEN called > 0 THEN hit / called ELSE 0 END AS "precision", CASE WHEN support > 0 THEN hit / support ELSE 0 END AS recall, CASE WHEN called + support > 0 THEN 2.0 * hit / (called + support) ELSE 0 END::DOUBLE AS f1 FROM k)
SELECT label, support, round("precision", 6) AS "precision", round(recall, 6) AS recall, round(f1, 6) AS f1, round(sum(hit) OVER () / sum(support) OVER (), 6) AS accuracy, round(avg(f1) OVER (), 6) AS macro_f1, round(sum(f1 * support) OVER () / sum(support) OVER (), 6) AS weighted_f1 FROM m""")
def d32(spark, sf):
    e = embeddings(spark, sf).select("label", F.when(F.col("vec_id") % 5 == 0, (F.col("label") + 1) % 10).otherwise(F.col("label")).alias("predicted"))
    return stats.classification_metrics(e, "label", "predicted")


@query("d33_class_centroids", """WITH u AS (SELECT label, unnest(range(1, 65)) AS pos, CAST(embedding AS DOUBLE[]) AS e FROM embeddings), x AS (SELECT label, pos, avg(e[pos] / greatest(sqrt(list_dot_product(e, e)), 1e-8)) AS x FROM u GROUP BY 1, 2), n AS (SELECT label, greatest(sqrt(sum(x * x)), 1e-8) AS s FROM x GROUP BY 1)
SELECT label, pos - 1 AS pos, round(x / s, 6) AS x FROM x JOIN n USING (label)""")
def d33(spark, sf):
    return search.class_centroids(embeddings(spark, sf)).select("label", F.col("pos").cast("long").alias("pos"), F.round("x", 6).alias("x"))


@query("d12_search_facets", f"""WITH b AS (SELECT DISTINCT query_id, doc_id FROM {HITS} z WHERE ord <= 500), p AS (SELECT query_id, trim(unnest(CASE WHEN contains(map_country, '; ') THEN string_split(map_country, '; ') WHEN contains(map_country, ' | ') THEN string_split(map_country, ' | ') ELSE [map_country] END)) AS value FROM b JOIN v_docs USING (doc_id) WHERE map_country <> '')
SELECT query_id, value, count(*) AS n FROM p WHERE len(regexp_extract_all(value, '[a-z][A-Z]')) < 2 GROUP BY 1, 2""")
def d12(spark, sf):
    return facets.search_facets(hits(spark, sf), view(spark, sf, "v_docs"), "map_country")


JOINED = f"(SELECT query_id, doc_id, score, map_title, map_published_year, map_organization, map_language FROM {HITS} z JOIN v_docs USING (doc_id))"


def joined(spark, sf):
    return hits(spark, sf).join(view(spark, sf, "v_docs").select("doc_id", "map_title", "map_published_year", "map_organization", "map_language"), "doc_id")


@query("d16_heatmap_query", f"""SELECT query_id AS row_label, map_language AS col_label, count(DISTINCT nullif(coalesce(map_title, '') || '|' || coalesce(map_published_year, '') || '|' || coalesce(map_organization, ''), '||')) AS documents, count(*) AS chunks
FROM (SELECT *, row_number() OVER (PARTITION BY query_id, map_language ORDER BY score DESC, doc_id) AS k FROM {JOINED} j WHERE score = 0 OR score >= 0.05) q WHERE k <= 1000 GROUP BY 1, 2""")
def d16(spark, sf):
    return facets.heatmap_query(joined(spark, sf), "query_id", "map_language", 0.05)


@query("d17_score_cutoff", """SELECT round(lo, 6) AS lo, round(hi, 6) AS hi, round(hi - (hi - lo) * 0.2, 6) AS cutoff FROM (SELECT greatest(min(score), 0) AS lo, max(score) AS hi FROM v_hits WHERE score <> 0) q""")
def d17(spark, sf):
    return facets.score_cutoff(hits(spark, sf))


@query("d19_cell_documents", f"""SELECT query_id, map_title, map_published_year, map_organization, count(*) AS hits, max(score) AS best FROM {JOINED} j GROUP BY 1, 2, 3, 4""")
def d19(spark, sf):
    return facets.cell_documents(joined(spark, sf))


@query("e20_citation_index", f"""SELECT doc_id, row_number() OVER (ORDER BY query_id, ord) AS number FROM (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY query_id, ord) AS k FROM {HITS} z WHERE ord <= 25) q WHERE k = 1""")
def e20(spark, sf):
    return search.citation_index(hits(spark, sf).where("ord <= 25"))


@query("c01_enrich_hits", f"""SELECT query_id, doc_id, map_title, page_num, place FROM (SELECT query_id, h.doc_id, map_title, coalesce(c.page_num, 0) AS page_num, row_number() OVER (PARTITION BY query_id ORDER BY ord) AS place FROM {HITS} h JOIN v_docs d ON h.doc_id = d.doc_id LEFT JOIN v_chunks c ON c.chunk_id = h.doc_id || '_1') q WHERE place <= 10""")
def c01(spark, sf):
    h = hits(spark, sf).withColumn("chunk_id", F.concat("doc_id", F.lit("_1")))
    got = search.enrich_hits(h, view(spark, sf, "v_docs").select("doc_id", "map_title"), chunks(spark, sf), 10)
    return got.select("query_id", "doc_id", "map_title", "page_num", F.col("place").cast("long").alias("place"))


@query("c02_denormalize", """SELECT chunk_id, map_organization, map_language FROM v_chunks c JOIN v_docs d ON c.doc_id = d.doc_id""")
def c02(spark, sf):
    return search.denormalize(chunks(spark, sf), view(spark, sf, "v_docs").select("doc_id", "map_organization", "map_language")).select("chunk_id", "map_organization", "map_language")


@query("c14_restrict_by_title", """SELECT chunk_id FROM v_chunks WHERE doc_id IN (SELECT doc_id FROM v_docs WHERE map_title ILIKE '%the%')""")
def c14(spark, sf):
    return filters.restrict_by_title(chunks(spark, sf), view(spark, sf, "v_docs"), "the").select("chunk_id")


@query("c15_indexed_only", """SELECT chunk_id FROM v_chunks WHERE doc_id IN (SELECT doc_id FROM v_docs WHERE sys_status = 'indexed')""")
def c15(spark, sf):
    return filters.indexed_only(chunks(spark, sf), view(spark, sf, "v_docs")).select("chunk_id")


@query("t39_answer_context", f"""SELECT query_id, string_agg('[' || CAST(ord AS STRING) || '] ' || map_title, chr(10) ORDER BY ord) AS context FROM {HITS} z JOIN v_docs USING (doc_id) WHERE ord <= 20 GROUP BY 1""")
def t39(spark, sf):
    return search.answer_context(hits(spark, sf).join(view(spark, sf, "v_docs").select("doc_id", F.col("map_title").alias("text")), "doc_id"))


@query("f19_more_like_this", """WITH q AS (SELECT vec_id AS query_id, CAST(embedding AS DOUBLE[]) AS qv FROM embeddings WHERE vec_id % 50 = 7), h AS (SELECT query_id, vec_id, round(list_cosine_similarity(CAST(embedding AS DOUBLE[]), qv), 6) AS score FROM embeddings, q)
SELECT query_id, vec_id, score FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS ord FROM h) z WHERE ord <= 6""")
def f19(spark, sf):
    e = embeddings(spark, sf)
    return search.more_like_this(e, e.where("vec_id % 50 = 7"), 6).select("query_id", "vec_id", "score")


@query("h17_vectors", """SELECT vec_id, round(list_dot_product(e, e), 6) AS dot, round(list_dot_product(e, e) / greatest(sqrt(list_dot_product(e, e)), 1e-8) / greatest(sqrt(list_dot_product(e, e)), 1e-8), 6) AS unit FROM (SELECT vec_id, CAST(embedding AS DOUBLE[]) AS e FROM embeddings) q""")
def h17(spark, sf):
    from docspark.functions import vectors

    n = vectors.l2_normalize(F.col("embedding"))
    return embeddings(spark, sf).select("vec_id", F.round(vectors.dot(F.col("embedding"), F.col("embedding")), 6).alias("dot"), F.round(vectors.dot(n, n), 6).alias("unit"))


@query("t07_chunk_text", """SELECT doc_id || '/' || CAST(page_num AS STRING) AS chunk_id, string_agg(text, chr(10) || chr(10) ORDER BY pos) AS text FROM v_chunks GROUP BY 1""")
def t07(spark, sf):
    c = chunks(spark, sf)
    return el.chunk_text(c.select(F.concat_ws("/", "doc_id", F.col("page_num").cast("string")).alias("chunk_id"), F.col("page_num").alias("page"), "pos", "text"))


@query("t05_footnotes", """SELECT chunk_id, CAST(pos % 100 AS INT) AS number, '[^' || CAST(pos % 100 AS STRING) || '] note' AS text FROM v_chunks""")
def t05(spark, sf):
    note = F.concat(F.lit("[^"), (F.col("pos") % 100).cast("string"), F.lit("]:  note"))
    return chunks(spark, sf).select("chunk_id", el.footnote_number(note).alias("number"), el.normalize_footnote(note).alias("text"))


@query("c07_resolve_footnotes", """SELECT doc_id, chunk_id, 3 AS number, '[^3] ' || f AS text FROM v_chunks JOIN (SELECT doc_id, arg_min(chunk_id, pos) AS f FROM v_chunks WHERE pos % 2 = 1 GROUP BY 1) d USING (doc_id) WHERE pos % 2 = 0""")
def c07(spark, sf):
    c = chunks(spark, sf)
    odd = F.col("pos") % 2 == 1
    text = F.when(odd, F.concat(F.lit("3: "), "chunk_id")).otherwise(F.col("text"))
    rows = c.select("doc_id", "chunk_id", F.col("page_num").alias("page"), "pos", text.alias("text"), odd.alias("is_reference"), F.array(F.lit(3), F.lit(99)).alias("refs"))
    return el.resolve_footnotes(rows)


@query("c05_attach_images", """SELECT chunk_id, 'i' || doc_id AS image_id FROM v_chunks WHERE page_num = 1 AND (pos * 100 <= 130 AND pos * 100 + 90 >= 120)""")
def c05(spark, sf):
    c = chunks(spark, sf)
    rows = c.select("doc_id", "chunk_id", F.col("page_num").alias("page"), F.lit("x").alias("text"), (F.col("pos") * 100.0).alias("low"), (F.col("pos") * 100.0 + 90).alias("high"))
    images = c.select("doc_id").distinct().select("doc_id", F.lit(1).alias("page"), F.concat(F.lit("i"), "doc_id").alias("image_id"), F.lit(120.0).alias("low"), F.lit(130.0).alias("high"))
    return el.attach_images(rows, images)


@query("t10_table_rows", """SELECT table_id, row, array_to_string(list(text ORDER BY col), '#') AS cells FROM (SELECT doc_id AS table_id, page_num AS row, text, min(pos) AS col FROM v_chunks WHERE page_num < 50 GROUP BY 1, 2, 3) q GROUP BY 1, 2""")
def t10(spark, sf):
    cells = chunks(spark, sf).select(F.col("doc_id").alias("table_id"), F.col("page_num").alias("row"), F.col("pos").alias("col"), "text")
    return el.table_rows(cells).select("table_id", "row", F.array_join("cells", "#").alias("cells"))


@query("t42_grouped_references", f"""SELECT query_id AS answer_id, map_language AS title, min(ord) AS seq, string_agg(CAST(ord AS STRING), ',' ORDER BY ord) AS numbers FROM {HITS} z JOIN v_docs USING (doc_id) WHERE ord <= 12 GROUP BY 1, 2""")
def t42(spark, sf):
    h = hits(spark, sf).where("ord <= 12").join(view(spark, sf, "v_docs").select("doc_id", F.col("map_language").alias("title")), "doc_id").withColumnRenamed("query_id", "answer_id")
    return el.grouped_references(h.select("answer_id", F.col("ord").alias("citation"), F.col("ord").alias("number")), h)


@query("t43_key_facts", """SELECT doc_id AS answer_id, 2 AS pos, 'fact ' || doc_id AS fact, 2 AS cited FROM v_docs""")
def t43(spark, sf):
    text = F.concat(F.lit("# Intro\n## Key Facts\n- fact "), "doc_id", F.lit(" [1, 2] [3]\n## Else\n- not a fact [1]"))
    return el.key_facts(view(spark, sf, "v_docs").select(F.col("doc_id").alias("answer_id"), text.alias("text")))
