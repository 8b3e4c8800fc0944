"""What a page's layout tells: levels of contents, roman front pages, superscripts, paragraphs, phrases and languages."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from docspark.functions import models, strings
from docspark.operators.elements import front_run_end
from docspark.sources.shared import dealt, once

LEVELS = 9
# fixed values: titles after which numbers no longer set levels
BACK_MATTER = r"\b(annex|annexe|annexes|appendix|appendices|references|bibliography)\b"
# fixed values: superscripts that are no digits
MARKS = ("*", "†", "‡", "§")


def normalize_levels(toc: DataFrame) -> DataFrame:
    """Levels by numbering: `2.1` stands one below the least level, what follows below a numbered entry moves with it, and
    the least level becomes 1. Numbers count neither in front matter nor after an annex, nor where the major number falls.
    The open numbered entry of each level is looked up by windows over one sort."""
    toc = dealt(toc, "doc_id")
    doc = Window.partitionBy("doc_id")
    before = doc.orderBy("idx").rowsBetween(Window.unboundedPreceding, -1)
    number = F.regexp_extract("title", r"^\s*(\d+(?:\.\d+)*)", 1)
    depth = F.when(number != "", F.regexp_count(number, F.lit(r"\.")) + 1).otherwise(0)
    back = F.max(F.lower("title").rlike(BACK_MATTER)).over(doc.orderBy("idx").rowsBetween(Window.unboundedPreceding, 0))
    got = toc.withColumns({"__depth": depth, "__major": F.substring_index(number, ".", 1).try_cast("long"), "__base": F.min("level").over(doc), "__out": back | F.coalesce("fm", F.lit(False))})
    got = got.withColumn("__most", F.max(F.when((F.col("__depth") > 0) & ~F.col("__out"), F.col("__major"))).over(before))
    counts = (F.col("__depth") > 0) & ~F.col("__out") & ~F.coalesce(F.col("__major") < F.col("__most"), F.lit(False))
    wanted = F.col("__base") + F.col("__depth") - 1
    got = got.withColumn("__own", F.struct("level", F.when(counts, wanted - F.col("level")).alias("delta")))
    for k in range(1, LEVELS):
        got = got.withColumn(f"__at{k}", F.last(F.when(F.col("level") <= k, F.col("__own")), True).over(before))
    above = F.coalesce(*(F.when((F.col("level") > k) & (F.col(f"__at{k}.level") == k), F.col(f"__at{k}.delta")) for k in reversed(range(1, LEVELS))), F.lit(0))
    level = F.when(counts, F.greatest(F.lit(1), wanted)).when((F.col("__depth") > 0) & F.col("__out"), F.col("level")).otherwise(F.greatest(F.lit(1), F.col("level") + above))
    got = got.withColumn("__new", level)
    got = got.withColumn("level", F.greatest(F.lit(1), F.col("__new") - F.min("__new").over(doc) + 1).cast("int"))
    return got.select(*toc.columns)


def annotate_front(toc: DataFrame, labels: DataFrame, pages: DataFrame) -> DataFrame:
    """Contents with the roman label of each entry's page, and `fm` up to the end of the last long run of roman pages in a
    document's first third. labels: doc_id, page, label; pages: doc_id, total_pages."""
    roman = labels.join(pages, "doc_id", "left").withColumn("roman", strings.roman_to_int(F.col("label")))
    early = ~F.coalesce((F.col("total_pages") > 0) & (F.col("page") > F.col("total_pages") / 3), F.lit(False))
    end = front_run_end(roman.where(early).select("doc_id", "page", "roman"))
    named = labels.select("doc_id", "page", F.col("label").alias("roman"))
    got = toc.drop("roman", "fm").join(named, ["doc_id", "page"], "left").join(end, "doc_id", "left")
    return got.withColumn("fm", F.coalesce(F.col("page") <= F.col("last_page"), F.lit(False))).drop("last_page")


def superscripts(spans: DataFrame) -> DataFrame:
    """(line_id, pos, token) of spans with up to three digits or a mark that are smaller and higher than their line.

    spans: line_id, pos, text, size, top, bottom and, where known, the baseline `origin`. A line's size is that of its
    middle span, its height that of spans of about this size; the first span is never one."""
    line = Window.partitionBy("line_id")
    token = F.trim("text")
    sizes = F.sort_array(F.collect_list(F.when(token != "", F.col("size"))).over(line))
    got = spans.withColumn("__size", F.get(sizes, F.floor(F.size(sizes) / 2).cast("int")))
    middle = (F.col("top") + F.col("bottom")) / 2
    normal = F.col("size").between(F.col("__size") * 0.9, F.col("__size") * 1.1)
    has_origin = F.min_by(F.when(normal, F.col("origin").isNotNull()), F.when(normal, F.col("pos"))).over(line)
    height = F.coalesce(F.when(has_origin, F.avg(F.when(normal, F.col("origin"))).over(line)), F.avg(F.when(normal, middle)).over(line), F.avg(middle).over(line))
    got = got.withColumns({"__line": height, "__base": F.coalesce(has_origin, F.lit(False)) & F.col("origin").isNotNull(), "__first": F.min("pos").over(line)})
    raised = F.when(F.col("__base"), F.col("__line") - F.col("origin") >= F.col("__size") * 0.15).otherwise(F.col("__line") - middle >= F.col("__size") * 0.2)
    small = (F.col("size") < F.col("__size") * 0.85) & (F.col("pos") > F.col("__first"))
    return got.where((token.rlike(r"^\d{1,3}$") | token.isin(*MARKS)) & small & raised).select("line_id", "pos", token.alias("token"))


def infer_paragraphs(text: Column, boxes: Column) -> Column:
    """Blank lines after every so many sentences, as often as the gaps between boxes (arrays of four numbers) are over two
    and a half times the gap at three quarters; fewer than three boxes change nothing."""
    let = strings.let
    ordered = F.transform(F.sort_array(F.transform(boxes, lambda b, i: F.struct(F.get(b, 1).alias("y"), i.alias("i"), b.alias("b")))), lambda s: s["b"])
    gaps = let(ordered, lambda o: F.transform(F.slice(o, 1, F.size(o) - 1), lambda b, i: F.abs(F.get(b, 3) - F.get(F.get(o, i + 1), 1))))
    over = lambda g: let(F.get(F.sort_array(g), F.floor(F.size(g) * 0.75).cast("int")), lambda base: F.size(F.filter(g, lambda x: x > base * 2.5)))
    end = r"\.\s+(?=[A-ZÁÉÍÓÚÑ])"
    parts = F.struct(F.split(text, end, -1).alias("sentences"), F.regexp_extract_all(text, F.lit(end), F.lit(0)).alias("marks"))

    def made(large: Column, p: Column) -> Column:
        every = F.greatest(F.lit(2), F.floor((2 * F.size(p["sentences"]) - 1) / (large + 1)).cast("int"))
        broken = lambda n: F.transform(p["sentences"], lambda s, j: F.concat(s, F.when((j > 0) & (j % n == 0) & s.contains(". "), "\n\n").otherwise(""), F.coalesce(F.get(p["marks"], j), F.lit(""))))
        return F.when(F.size(p["sentences"]) > 1, F.array_join(let(every, broken), "")).otherwise(text)

    found = F.when(F.size(boxes) >= 3, let(gaps, over))
    return let(found, lambda large: F.when(large > 0, let(parts, lambda p: made(large, p))).otherwise(text))


def expand_phrases(spans: DataFrame) -> DataFrame:
    """(chunk_id, start, end, phrase): spans of a text grown to the sentence, clause or double space around them, and joined
    where they come within two characters. spans: chunk_id, text, start, end, counted from 0, the end behind."""
    head, tail = F.substring(F.col("text"), F.lit(1), F.col("start")), F.substring(F.col("text"), F.col("end") + 1, F.length("text"))
    ends = lambda x: F.translate(x, ".!?;:\n", "\n" * 6)
    left = F.substring_index(F.substring_index(ends(head), "\n", -1), "  ", -1)  # what follows the last end or two spaces
    left = F.regexp_replace(left, f"^{strings.WHITE}+", "")
    stop = lambda x: F.struct(x.alias("x"), F.locate("\n", ends(x)).alias("end"), F.locate("  ", x).alias("gap"))
    upto = lambda s: F.when((s["end"] > 0) & ((s["gap"] == 0) | (s["end"] < s["gap"])), s["end"]).when(s["gap"] > 0, s["gap"] - 1).otherwise(F.length(s["x"]))
    right = strings.let(tail, lambda x: strings.let(stop(x), lambda s: F.substring(s["x"], F.lit(1), upto(s))))
    right = F.regexp_replace(right, f"{strings.WHITE}+\\z", "")
    grown = once(spans.select("chunk_id", "text", (F.col("start") - F.length(left)).alias("start"), (F.col("end") + F.length(right)).alias("end")), "start", "end").where("start < end")
    w = Window.partitionBy("chunk_id").orderBy("start", "end")
    reach = F.max("end").over(w.rowsBetween(Window.unboundedPreceding, -1))
    new = F.when(F.coalesce(F.col("start") <= reach + 2, F.lit(False)), 0).otherwise(1)
    runs = grown.withColumn("__new", new).withColumn("__run", F.sum("__new").over(w))
    joined = runs.groupBy("chunk_id", "__run").agg(F.min("start").alias("start"), F.max("end").alias("end"), F.first("text").alias("text"))
    return joined.select("chunk_id", "start", "end", F.substring(F.col("text"), F.col("start") + 1, F.col("end") - F.col("start")).alias("phrase"))


def vote_language(pages: DataFrame, model: str = "language", least: float = 0.4) -> DataFrame:
    """(doc_id, language): the language most often found in a document's start, middle and end, each by its own; `Unknown`
    without any. pages: doc_id, page (from 0), text; up to six pages are one part. A part counts from 200 characters on and
    up to about 5000; the model gives `code probability`."""
    n = F.max("page").over(Window.partitionBy("doc_id")) + 1
    rows = pages.withColumn("n", n)
    p, n = F.col("page"), F.col("n")
    first = F.least(F.lit(3), n - 1)
    first_end = F.least(first + 10, n)
    middle = F.greatest(F.floor(n / 2) - 4, first_end)
    middle_end = F.least(F.floor(n / 2) + 4, n)
    after = F.when(middle < middle_end, middle_end).otherwise(first_end)
    last = F.greatest(n - 10, after)
    part = F.when(n <= 6, 0).when((p >= first) & (p < first_end), 0).when((p >= middle) & (p < middle_end), 1).when((p >= last) & (p < F.greatest(n - 2, last + 1)), 2)
    parts = rows.withColumn("part", part).where("part is not null AND text <> ''")
    before = F.coalesce(F.sum(F.length("text")).over(Window.partitionBy("doc_id", "part").orderBy("page").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    kept = parts.withColumn("__before", before).where("__before <= 5000")
    whole = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("page", "text"))), lambda x: x["text"]), " ")
    texts = kept.groupBy("doc_id", "part").agg(F.trim(F.regexp_replace(whole, r"\s+", " ")).alias("text")).where("length(text) >= 200")
    voted = models.apply(texts, model, "text", "guess string")
    code, sure = F.substring_index("guess", " ", 1), F.substring_index("guess", " ", -1).try_cast("double")
    votes = voted.where(sure >= least).groupBy("doc_id", code.alias("language")).agg(F.count("*").alias("n"), F.min("part").alias("part"))
    best = votes.groupBy("doc_id").agg(F.max_by("language", F.struct("n", -F.col("part"))).alias("language"))
    return pages.select("doc_id").distinct().join(best, "doc_id", "left").select("doc_id", F.coalesce("language", F.lit("Unknown")).alias("language"))


def changed_languages(docs: DataFrame, voted: DataFrame) -> DataFrame:
    """(doc_id, old_value, new_value) of documents whose language is known and another than the one noted."""
    j = docs.select("doc_id", F.col("map_language").alias("old_value")).join(voted.where("language <> 'Unknown'").select("doc_id", F.col("language").alias("new_value")), "doc_id")
    return j.where(~F.col("old_value").eqNullSafe(F.col("new_value")))


def repair_elements(chunks: DataFrame) -> DataFrame:
    """Chunks with repaired text and element texts, those alone that hold a mark of the old encoding; the scan drops others."""
    marks = f"[{''.join(strings.MOJIBAKE)}]"
    held = chunks.where(F.col("text").rlike(marks) | F.exists("elements", lambda e: e["text"].rlike(marks)))
    fixed = F.transform("elements", lambda e: e.withField("text", strings.fix_mojibake(e["text"])))
    return held.withColumn("text", strings.fix_mojibake(F.col("text"))).withColumn("elements", fixed)
