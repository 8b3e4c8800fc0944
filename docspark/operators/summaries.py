"""Summaries of texts of any length by a model with a window, and taxonomy tags by a model that answers in JSON.

A text that fits the window is summarised at once. A longer one is cut into overlapping parts, the model reads each, and
what it says is joined in order and read again; if that doesn't fit either, it is cut once more, up to three times. Each
turn is one plan over all documents that are still too long, and its result is staged, so models are called once.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from docspark.functions import models, strings
from docspark.operators import chunks, texts
from docspark.sources.shared import staged

MOST_PARTS, MOST_TURNS, SHORTEST = 200, 3, 50
OVERHEAD = 100  # characters of the instructions around a text
# fixed values: what is taken out of texts before a model reads them, in this order
CLEANED = ((r"!\[.*?\]\(.*?\)", ""), (r"(?s)<!--.*?-->", ""), (r"------- Page \d+ -------", ""), (r"(?s)```.*?```", ""), (r"\n\s*\n\s*\n+", "\n\n"), (r" +", " "))


def cleaned(text: Column) -> Column:
    for pattern, by in CLEANED:
        text = F.regexp_replace(text, pattern, by)
    return F.regexp_replace(text, r"^\s+|\s+\z", "")


def extract(docs: DataFrame, k: int = 30, model: str = "embedder") -> DataFrame:
    """(doc_id, summary): the k sentences of each text nearest to the mean of all its sentences' vectors, in their order.
    Texts without a sentence of over five words have no row."""
    found = models.apply(chunks.sentences(docs, "text"), model, "sentence", "vector array<double>")
    return chunks.centroid_summary(staged(found), k)


def _parts(rows: DataFrame, size: int, overlap: int, model: str) -> DataFrame:
    """(doc_id, text): the model's answers to a text's parts, joined by blank lines in their order."""
    said = models.apply(chunks.split_overlap(rows, "text", size, overlap), model, "text", "said string")
    in_order = F.array_sort(F.collect_list(F.struct("part", "said")))
    return said.groupBy("doc_id").agg(F.array_join(F.transform(in_order, lambda s: F.coalesce(s["said"], F.lit(""))), "\n\n").alias("text"))


def _reduced(rows: DataFrame, most: int, size: int, overlap: int, model: str, final: str) -> tuple[DataFrame, DataFrame]:
    """(doc_id, summary, turns) of texts over `size`, and the (doc_id) of those of too many parts, which wait for less text."""
    done, too_many, turn = [], [], 0
    many = F.ceil((F.length("text") - overlap) / (size - overlap)) > MOST_PARTS
    while True:
        too_many.append(rows.where(many).select("doc_id"))
        joined = staged(_parts(rows.where(~many), size, overlap, model))
        fits = joined.where(F.length("text") <= most)
        done.append(models.apply(fits, final, "text", "summary string").select("doc_id", "summary", F.lit(turn).alias("turns")))
        rows, turn = joined.where(F.length("text") > most), turn + 1
        if turn > MOST_TURNS or rows.isEmpty():
            done.append(rows.select("doc_id", F.col("text").alias("summary"), F.lit(turn).alias("turns")))
            return reduce(DataFrame.unionByName, done), reduce(DataFrame.unionByName, too_many)


def summarise(docs: DataFrame, window: int = 29_000, reserve: int = 2_000, overlap: int = 800, model: str = "summariser", final: str = "summariser", overhead: int = OVERHEAD) -> DataFrame:
    """(doc_id, summary, method, turns, status, error) of texts (doc_id, text).

    A character counts as a token, so a text may have `window - reserve` characters, less `overhead` if it is cut. `turns`
    counts how often a combined summary was cut again; after three it is taken as it is. A text of over 200 parts is first
    replaced by its 30 most central sentences (`llm_on_centroid`), and if these are too many as well, they are its summary
    (`centroid_only`). A blank text, one without sentences where those are needed, and an answer at once of fewer than 50
    characters are errors. Ids are taken to be different; null texts are blank."""
    most, size = window - reserve, window - reserve - overhead
    if size <= overlap:
        raise ValueError("a part must be longer than the overlap")
    rows = staged(docs.select("doc_id", cleaned(F.coalesce("text", F.lit(""))).alias("text")))
    blank = rows.where("text = ''").select("doc_id", F.lit(None).cast("string").alias("summary"), F.lit("llm_summary").alias("method"), F.lit(0).alias("turns"), F.lit("no text").alias("error"))

    def answered(rows: DataFrame, method: str) -> tuple[DataFrame, DataFrame]:
        fits = rows.where(F.length("text") <= size)
        once = models.apply(fits, model, "text", "summary string").select("doc_id", "summary", F.lit(0).alias("turns"), F.lit(True).alias("once"))
        cut, left = _reduced(rows.where(F.length("text") > size), most, size, overlap, model, final)
        both = once.unionByName(cut.withColumn("once", F.lit(False)))
        short = F.col("once") & (F.length(F.coalesce("summary", F.lit(""))) < SHORTEST)
        error = F.when(short, F.concat(F.lit("response too short: "), F.length(F.coalesce("summary", F.lit(""))), F.lit(" characters")))
        return both.select("doc_id", F.when(~short, F.col("summary")).alias("summary"), F.lit(method).alias("method"), "turns", error.alias("error")), left

    first, large = answered(rows.where("text <> ''"), "llm_summary")
    central = staged(rows.join(large, "doc_id", "left_semi").join(extract(rows.join(large, "doc_id", "left_semi")), "doc_id", "left").select("doc_id", F.col("summary").alias("text")))
    lost = central.where("text is null").select("doc_id", F.lit(None).cast("string").alias("summary"), F.lit("centroid_only").alias("method"), F.lit(0).alias("turns"), F.lit("no sentences").alias("error"))
    second, still = answered(central.where("text is not null"), "llm_on_centroid")
    only = central.join(still, "doc_id", "left_semi").select("doc_id", F.col("text").alias("summary"), F.lit("centroid_only").alias("method"), F.lit(0).alias("turns"), F.lit(None).cast("string").alias("error"))
    all_ = reduce(DataFrame.unionByName, (blank, first, lost, second, only))
    return all_.withColumn("status", F.when(F.col("error").isNull(), "summarized").otherwise("summarize_failed"))


TAXONOMY_ROWS = 10_000  # values of all taxonomies that prompts may hold
CODES = "array<struct<code:string,reason:string>>"


def parse_codes(answer: Column) -> Column:
    """The items of a JSON array, or of the outermost brackets in a text, that have a code; a missing reason gets a
    sentence of its own. Anything else holds none."""
    items = F.from_json(F.regexp_extract(F.coalesce(answer, F.lit("")), r"(?s)(\[.*\])", 1), CODES)
    given = F.filter(F.coalesce(items, F.array().cast(CODES)), lambda x: F.coalesce(x["code"] != "", F.lit(False)))
    return F.transform(given, lambda x: F.struct(x["code"].alias("code"), F.coalesce(x["reason"], F.lit("No reason provided")).alias("reason")))


def _first_of_code(items: Column) -> Column:
    """Of items by code and place, the first of each code."""
    return F.filter(items, lambda x, i: (i == 0) | (F.get(items, i - 1)["code"] != x["code"]))


def tag_taxonomies(docs: DataFrame, taxonomies: DataFrame, model: str = "classifier", window: int = 29_000, reserve: int = 2_000, chars_per_token: int = 2, overhead: int = 500) -> DataFrame:
    """(doc_id, taxonomy, codes, tags) of documents (doc_id, summary): for each taxonomy the values that the model finds.

    taxonomies: taxonomy, level, ord, code, name, by `ord` within one; only those of the level `document` are asked for, and
    there may be TAXONOMY_ROWS rows. A summary that doesn't fit the window, less what the values take, is cut into near-equal
    parts at blank lines. The model reads JSON {taxonomy, values: [{code, name}], text} and answers with a JSON array of
    {code, reason}. Of several parts' answers the first for a code counts, unknown codes go, and names come from the
    taxonomy. `codes` has code, name and reason, `tags` "code - name". Without a summary or a code there is no row."""
    values = taxonomies.where("level = 'document'").groupBy("taxonomy").agg(F.array_sort(F.collect_list(F.struct("ord", "code", "name"))).alias("found"))
    if taxonomies.limit(TAXONOMY_ROWS + 1).count() > TAXONOMY_ROWS:
        raise ValueError(f"more than {TAXONOMY_ROWS} taxonomy values don't fit a prompt")
    values = values.select("taxonomy", F.transform("found", lambda v: F.struct(v["code"].alias("code"), v["name"].alias("name"))).alias("values"))
    room = (window - reserve) * chars_per_token - overhead - F.aggregate("values", F.lit(0), lambda s, v: s + F.length(v["code"]) + F.length(F.coalesce(v["name"], F.lit(""))))
    values = values.select("taxonomy", F.greatest(room, F.lit(1)).alias("room"), F.to_json(F.struct("taxonomy", "values")).alias("head"))
    asked = docs.where("summary <> ''").select("doc_id", "summary").join(F.broadcast(values))
    parts = asked.select("doc_id", "taxonomy", "head", F.posexplode(texts.split_balanced(F.col("summary"), F.col("room"))).alias("part", "text"))
    prompt = F.concat(F.expr("substr(head, 1, length(head) - 1)"), F.lit(","), F.expr("substr(to_json(struct(text)), 2)"))
    prompts = parts.select("doc_id", "taxonomy", "part", prompt.alias("prompt"))
    said = models.apply(prompts, model, "prompt", "answer string").select("doc_id", "taxonomy", "part", parse_codes(F.col("answer")).alias("items"))
    answers = said.groupBy("doc_id", "taxonomy").agg(F.array_sort(F.collect_list(F.struct("part", "items"))).alias("answers"))
    in_order = F.transform(F.flatten(F.col("answers.items")), lambda x, i: F.struct(x["code"].alias("code"), i.alias("place"), x["reason"].alias("reason")))
    first = answers.select("doc_id", "taxonomy", F.explode(strings.let(F.array_sort(in_order), _first_of_code)).alias("item")).select("doc_id", "taxonomy", "item.*")
    names = taxonomies.where("level = 'document'").select("taxonomy", "code", "name")
    known = first.join(F.broadcast(names), ["taxonomy", "code"])
    listed = known.groupBy("doc_id", "taxonomy").agg(F.array_sort(F.collect_list(F.struct("place", "code", "name", "reason"))).alias("rows"))
    codes = F.transform("rows", lambda r: F.struct(r["code"].alias("code"), r["name"].alias("name"), r["reason"].alias("reason")))
    tags = F.transform("rows", lambda r: F.when(F.coalesce(r["name"], F.lit("")) != "", F.concat(r["code"], F.lit(" - "), r["name"])).otherwise(r["code"]))
    return listed.select("doc_id", "taxonomy", codes.alias("codes"), tags.alias("tags"))


def renew_summaries(docs: DataFrame, wanted: Column, **settings) -> DataFrame:
    """(doc_id, summary, sys_status, renewed) of all documents (doc_id, text, summary, sys_status): those that are wanted are
    summarised again, and the new summary replaces the old one if there is no error and it is shorter, or if there was none.
    The status stays what it was. `settings` go to `summarise`."""
    new = summarise(docs.where(F.coalesce(wanted, F.lit(False))).select("doc_id", "text"), **settings).where("status = 'summarized'").select("doc_id", F.col("summary").alias("__new"))
    better = F.col("__new").isNotNull() & F.coalesce(F.length("__new") < F.length("summary"), F.lit(True))
    rows = docs.join(new, "doc_id", "left").withColumn("renewed", better)
    return rows.select("doc_id", F.when(F.col("renewed"), F.col("__new")).otherwise(F.col("summary")).alias("summary"), "sys_status", "renewed")


def renew_tags(docs: DataFrame, tags: DataFrame, taxonomies: DataFrame, wanted: Column, **settings) -> DataFrame:
    """(doc_id, taxonomy, codes, tags): of documents (doc_id, summary) that are wanted and have a summary, new tags in place of
    all old ones; of others the old ones."""
    again = docs.where(F.coalesce(wanted, F.lit(False)) & (F.coalesce("summary", F.lit("")) != "")).select("doc_id", "summary")
    return tags.join(again.select("doc_id"), "doc_id", "left_anti").unionByName(tag_taxonomies(again, taxonomies, **settings))
