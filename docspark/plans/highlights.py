"""Registered queries over matches in chunk texts: highlighting, phrases, fuzzy places, boxes."""

from __future__ import annotations

from pyspark.sql import functions as F

from docspark.operators import highlights, layout
from docspark.plans.registry import query
from docspark.plans.views import view

STOP = ", ".join(f"'{w}'" for w in highlights.STOP_WORDS)


def chunks(spark, sf):
    return view(spark, sf, "v_chunks")


# every chunk asks for a part of itself, cut anywhere, for two of its words the wrong way round, or for a word in small letters among stop words
QUERY_OF_CHUNK = "CASE pos % 3 WHEN 0 THEN substr(text, 1 + pos % 11, 2 + length(text) % 9) WHEN 1 THEN concat(split_part(text, ' ', 3), ' ', split_part(text, ' ', 1)) ELSE concat(lower(split_part(text, ' ', 2)), ' about THE') END"


@query("t33_highlight", rf"""WITH c AS (SELECT chunk_id, text, lower(text) AS low, lower(regexp_replace({QUERY_OF_CHUNK}, '^\s+|\s+$', '', 'g')) AS q FROM v_chunks),
w AS (SELECT *, list_filter(string_split_regex(q, '\s+'), lambda x: length(x) > 2 AND x NOT IN ({STOP})) AS words, CASE WHEN q = '' THEN [] ELSE list_filter(range(1, length(low) - length(q) + 2), lambda i: substr(low, i, length(q)) = q) END AS phrases FROM c),
h AS (SELECT *, list_transform(range(1, length(low) + 1), lambda i: list_filter(words, lambda x: substr(low, i, length(x)) = x AND NOT regexp_matches(substr(low, i - 1, CASE WHEN i > 1 THEN 1 ELSE 0 END) || substr(low, i + length(x), 1), '[\p{{L}}\p{{N}}_]'))[1]) AS hit FROM w),
m AS (SELECT *, CASE WHEN len(phrases) > 0 THEN list_transform(phrases, lambda i: [i, length(q)]) ELSE list_transform(list_filter(range(1, length(low) + 1), lambda i: hit[i] IS NOT NULL), lambda i: [i, length(hit[i])]) END AS spans FROM h),
k AS (SELECT *, list_transform(range(0, length(text) + 2), lambda j: len(list_filter(spans, lambda s: s[1] <= j AND j < s[1] + s[2])) > 0) AS cover FROM m)
SELECT chunk_id, CAST(len(spans) AS INT) AS total, coalesce(list_aggregate(list_transform(range(1, length(text) + 1), lambda j: CASE WHEN cover[j + 1] AND NOT cover[j] THEN '<em>' ELSE '' END || substr(text, j, 1) || CASE WHEN cover[j + 1] AND NOT cover[j + 2] THEN '</em>' ELSE '' END), 'string_agg', ''), '') AS highlighted FROM k""")  # fmt: skip
def t33(spark, sf):
    found = highlights.highlight(chunks(spark, sf), F.expr(QUERY_OF_CHUNK))
    return found.select("chunk_id", F.size("matches").alias("total"), "highlighted")


BREAKS = "('.', '!', '?', ';', ':', chr(10))"


@query("t34_expand_phrases", rf"""WITH c AS (SELECT chunk_id, replace(text, ', ', ',  ') AS text, pos FROM v_chunks), s AS (SELECT chunk_id, text, unnest([pos * 7 % length(text), (pos * 13 + length(text) // 2) % length(text), length(text) - 1]) AS spot FROM c),
p AS (SELECT *, least(spot + 3, length(text)) AS till FROM s),
b AS (SELECT *, coalesce(list_max(list_filter(range(1, spot + 1), lambda i: substr(text, i, 1) IN {BREAKS} OR (i > 1 AND substr(text, i - 1, 2) = '  '))), 0) AS low,
  coalesce(list_min(list_transform(list_filter(range(till, length(text)), lambda i: substr(text, i + 1, 1) IN {BREAKS} OR substr(text, i + 1, 2) = '  '), lambda i: CASE WHEN substr(text, i + 1, 1) IN {BREAKS} THEN i + 1 ELSE i END)), length(text)) AS high FROM p),
g AS (SELECT chunk_id, text, coalesce(list_min(list_filter(range(low, spot), lambda i: NOT regexp_matches(substr(text, i + 1, 1), '\s'))), spot) AS a, coalesce(list_max(list_filter(range(till + 1, high + 1), lambda i: NOT regexp_matches(substr(text, i, 1), '\s'))), till) AS z FROM b),
n AS (SELECT *, CASE WHEN a <= max(z) OVER (PARTITION BY chunk_id ORDER BY a, z ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) + 2 THEN 0 ELSE 1 END AS fresh FROM g WHERE a < z),
r AS (SELECT *, sum(fresh) OVER (PARTITION BY chunk_id ORDER BY a, z ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS run FROM n)
SELECT chunk_id, CAST(min(a) AS INT) AS start, CAST(max(z) AS INT) AS "end", substr(any_value(text), min(a) + 1, max(z) - min(a)) AS phrase FROM r GROUP BY chunk_id, run""")  # fmt: skip
def t34(spark, sf):
    c = chunks(spark, sf).select("chunk_id", F.replace("text", F.lit(", "), F.lit(",  ")).alias("text"), "pos")
    n, p = F.length("text"), F.col("pos")
    at = F.array((p * 7) % n, (p * 13 + F.floor(n / 2).cast("int")) % n, n - 1)
    s = c.select("chunk_id", "text", F.explode(at).alias("start"))
    return layout.expand_phrases(s.withColumn("end", F.least(F.col("start") + 3, F.length("text"))))


@query("t35_locate_phrases")
def t35(spark, sf):
    """Of every chunk over 40 characters, a part of 12 to 51 characters as it is, with every tenth character lost, with
    every seventh another one, and with its words the wrong way round."""
    part = F.expr("substr(text, 1 + length(text) * 3 div 7, 12 + pos % 40)")
    lost, other = F.regexp_replace(part, "(.{9}).", "$1"), F.regexp_replace(part, "(.{6}).", "$1~")
    turned = F.array_join(F.reverse(F.split(part, " ")), " ")
    c = chunks(spark, sf).where("length(text) > 40")
    phrases = c.select("chunk_id", F.explode(F.array_distinct(F.array(part, lost, other, turned))).alias("phrase"))
    return highlights.locate_phrases(c.select("chunk_id", "text"), phrases)


@query("t36_highlight_boxes", r"""WITH c AS (SELECT *, length(text) AS n, CASE WHEN pos % 2 = 0 THEN page_num WHEN pos % 5 = 0 THEN NULL ELSE 2 END AS asked, CASE WHEN length(text) % 3 = 0 THEN lower(split_part(text, ' ', 2)) WHEN length(text) % 3 = 1 THEN 'th' END AS word FROM v_chunks),
b AS (SELECT *, page_num + n % 2 AS page, pos * 1.5 AS l, n / 8 AS t, 300.25 AS r, n % 70 AS b FROM c UNION ALL SELECT *, page_num, 1, 2, pos, n FROM c UNION ALL SELECT *, page_num, n, CASE WHEN n % 4 > 0 THEN pos END, 7, 8 FROM c)
SELECT chunk_id, CAST(page AS INT) AS page, CAST(l AS DOUBLE) AS l, CAST(t AS DOUBLE) AS t, CAST(r AS DOUBLE) AS r, CAST(b AS DOUBLE) AS b, substr(text, 1, 100) AS text FROM b WHERE t IS NOT NULL AND (asked IS NULL OR page = asked) AND (word IS NULL OR word = '' OR contains(lower(text), lower(word)))""")  # fmt: skip
def t36(spark, sf):
    c = chunks(spark, sf).withColumn("n", F.length("text"))
    json = lambda x: F.to_json(x)
    four = F.concat(F.lit("["), F.concat_ws(", ", F.col("pos") * 1.5, F.col("n") % 70, F.lit(300.25), F.col("n") / 8), F.lit("]"))
    pair = F.concat(F.lit("["), F.col("page_num") + F.col("n") % 2, F.lit(", "), four, F.lit("]"))
    plain = json(F.array(F.lit(1), F.col("n"), F.col("pos"), F.lit(2)))
    named = json(F.struct(F.col("n").alias("l"), F.when(F.col("n") % 4 > 0, F.col("pos")).alias("t"), F.lit(7).alias("r"), F.lit(8).alias("b")))
    asked = F.when(F.col("pos") % 2 == 0, F.col("page_num")).when(F.col("pos") % 5 != 0, 2)
    word = F.when(F.col("n") % 3 == 0, F.lower(F.split_part("text", F.lit(" "), F.lit(2)))).when(F.col("n") % 3 == 1, "th")
    return highlights.highlight_boxes(c.withColumn("boxes", F.array(pair, plain, named)), asked, word)
