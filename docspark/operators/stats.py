"""Corpus statistics: counts, breakdowns, the pipeline flow and hourly processing."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

STATUSES = (
    "downloaded", "download_error", "parsing", "parsed", "parse_failed", "summarizing", "summarized", "summarize_failed",
    "tagging", "tagged", "indexing", "indexed", "index_failed", "stopped",
)


def filled(col: str) -> Column:
    return F.coalesce(F.trim(F.col(col)) != "", F.lit(False))


def status_counts(docs: DataFrame) -> DataFrame:
    return docs.where(filled("sys_status")).groupBy("sys_status").agg(F.count("*").alias("n"))


def field_counts(docs: DataFrame, field: str) -> DataFrame:
    return docs.where(F.col(field).isNotNull()).groupBy(F.col(field).alias("value")).agg(F.count("*").alias("n"))


def breakdown(docs: DataFrame, fields: list[str]) -> DataFrame:
    """(field, value, status, n) for all fields in one pass: each row is expanded to its fields once."""
    cells = F.array(*(F.struct(F.lit(f).alias("field"), F.col(f).alias("value")) for f in fields))
    rows = docs.where(filled("sys_status")).select("sys_status", F.inline(cells)).where("value is not null")
    return rows.groupBy("field", "value", F.col("sys_status").alias("status")).agg(F.count("*").alias("n"))


def breakdown_multi(docs: DataFrame, field: str) -> DataFrame:
    values = F.explode(F.filter(F.transform(F.split(field, "; "), lambda x: F.trim(x)), lambda x: x != ""))
    return docs.where(filled("sys_status")).select(values.alias("value"), F.col("sys_status").alias("status")).groupBy("value", "status").agg(F.count("*").alias("n"))


def corpus_stats(docs: DataFrame) -> DataFrame:
    indexed = F.col("sys_status") == "indexed"
    return docs.agg(
        F.count("*").alias("total"), F.count_if(indexed).alias("indexed"), F.count_distinct("map_organization").alias("agencies"),
        F.count_distinct(F.when(indexed, F.col("map_organization"))).alias("indexed_agencies"), F.count_distinct(F.when(indexed, F.col("map_language"))).alias("indexed_languages"),
    )


def org_flows(docs: DataFrame) -> DataFrame:
    """Per organisation, how many documents reached each stage: later states count for the stages before them."""
    counts = docs.where(F.coalesce(F.col("map_organization"), F.lit("Unknown")) != "Unknown").groupBy(F.col("map_organization").alias("org"))
    wide = counts.agg(F.count("*").alias("total"), *(F.count_if(F.col("sys_status") == s).alias(s) for s in STATUSES))
    c = F.col
    tagged = c("tagged") + c("indexed") + c("index_failed") + c("indexing")
    summarized = c("summarized") + tagged + c("tagging")
    parsed = c("parsed") + summarized + c("summarizing") + c("summarize_failed")
    downloaded = c("downloaded") + parsed + c("parse_failed") + c("parsing") + c("stopped")
    return wide.select(
        "org", "total", downloaded.alias("flow_downloaded"), parsed.alias("flow_parsed"), summarized.alias("flow_summarized"), tagged.alias("flow_tagged"), c("indexed").alias("flow_indexed"),
        "download_error", "parse_failed", "summarize_failed", "index_failed", "stopped", (c("tagged") + c("indexing")).alias("waiting_index"), (c("summarized") + c("tagging")).alias("waiting_tag"), (c("parsed") + c("summarizing")).alias("waiting_summary"),
    )


LINKS = (
    ("org", "downloaded", "flow_downloaded"), ("org", "download_error", "download_error"), ("downloaded", "parsed", "flow_parsed"), ("downloaded", "parse_failed", "parse_failed"),
    ("downloaded", "stopped", "stopped"), ("parsed", "summarized", "flow_summarized"), ("parsed", "summarize_failed", "summarize_failed"), ("parsed", "waiting_summary", "waiting_summary"),
    ("summarized", "tagged", "flow_tagged"), ("summarized", "waiting_tag", "waiting_tag"), ("tagged", "indexed", "flow_indexed"), ("tagged", "index_failed", "index_failed"), ("tagged", "waiting_index", "waiting_index"),
)


def flow_links(flows: DataFrame) -> DataFrame:
    """(org, source, target, value) for each of the flow's links with a value."""
    cells = F.array(*(F.struct(F.lit(a).alias("source"), F.lit(b).alias("target"), F.col(v).alias("value")) for a, b, v in LINKS))
    return flows.select("org", F.inline(cells)).where("value > 0").withColumn("source", F.when(F.col("source") == "org", F.col("org")).otherwise(F.col("source")))


def flow_nodes(flows: DataFrame) -> DataFrame:
    """(node_index, node): organisations in order, then the fixed nodes."""
    fixed = [n for n in dict.fromkeys(x for a, b, _ in LINKS for x in (a, b)) if n != "org"]
    orgs = flows.groupBy("org").agg(F.lit(0).alias("tier"), F.lit(0).alias("place")).select(F.col("org").alias("node"), "tier", "place")
    rest = flows.sparkSession.createDataFrame([(n, 1, i) for i, n in enumerate(fixed)], "node string, tier int, place int")
    return orgs.unionByName(rest).select((F.row_number().over(Window.orderBy("tier", "place", "node")) - 1).alias("node_index"), "node")  # as many rows as organisations


def success_rate(docs: DataFrame) -> DataFrame:
    return docs.agg(F.coalesce(F.round(F.try_divide(F.count_if(F.col("sys_status") == "indexed") * 100.0, F.count("*")), 6), F.lit(0.0)).alias("success_rate"))


def years_for_status(docs: DataFrame, status: str) -> DataFrame:
    return docs.where((F.col("sys_status") == status) & F.col("map_published_year").rlike(r"^\d+$")).select(F.col("map_published_year").alias("year")).distinct()


def chart_series(counts: DataFrame, keep_all: bool = False, top: int = 10) -> DataFrame:
    """Breakdown rows of the categories with the largest totals, with the total and the status's place."""
    total = F.sum("n").over(Window.partitionBy("field", "value")).alias("total")
    place = F.when(F.col("status") == "indexed", 0).when(F.col("status").endswith("error"), 2).otherwise(1)
    rows = counts.select("*", total).withColumn("place", place)
    ranked = rows.withColumn("rank", F.dense_rank().over(Window.partitionBy("field").orderBy(F.desc("total"), "value")))
    return (ranked if keep_all else ranked.where(F.col("rank") <= top)).drop("rank")


def throughput(events: DataFrame, pages: DataFrame) -> DataFrame:
    """Documents and pages by the hour in which indexing finished."""
    done = events.where("stage = 'index' AND success").groupBy("doc_id").agg(F.max("at").alias("at"))
    return done.join(pages, "doc_id", "left").groupBy(F.date_trunc("hour", "at").alias("hour")).agg(F.count("*").alias("documents"), F.sum(F.coalesce("page_count", F.lit(0))).alias("pages"))


def phase_distribution(events: DataFrame) -> DataFrame:
    """Each stage's share of the hour's seconds; an hour without any has zeros."""
    hourly = events.groupBy(F.date_trunc("hour", "at").alias("hour"), "stage").agg(F.sum("elapsed_seconds").alias("seconds"))
    total = F.sum("seconds").over(Window.partitionBy("hour"))
    return hourly.select("hour", "stage", F.round(F.coalesce(F.try_divide(F.col("seconds"), total), F.lit(0.0)), 6).alias("share"))


def error_histogram(events: DataFrame) -> DataFrame:
    """Documents and those whose last event failed, by hour of that event; hours without errors stay."""
    last = events.groupBy("doc_id").agg(F.max(F.struct("at", "event_id", "success")).alias("e")).select("e.*")
    return last.groupBy(F.date_trunc("hour", "at").alias("hour")).agg(F.count("*").alias("documents"), F.count_if(~F.col("success")).alias("errors"))


def phase_intervals(events: DataFrame) -> DataFrame:
    """Start and end of each event: the start is the end less the elapsed time, else the event before it."""
    before = F.lag("at").over(Window.partitionBy("doc_id").orderBy("at", "event_id"))
    start = F.coalesce(F.timestamp_micros(F.unix_micros(F.col("at").cast("timestamp")) - F.round(F.col("elapsed_seconds") * 1000000).cast("long")).cast("timestamp_ntz"), before)
    return events.select("event_id", "doc_id", "stage", start.alias("start_at"), F.col("at").alias("end_at"))


def thread_counts(messages: DataFrame) -> DataFrame:
    return messages.groupBy("thread_id").agg(F.count("*").alias("messages"), F.max("turn").alias("last_turn"))


def duplicate_groups(chunks: DataFrame) -> DataFrame:
    """(doc_id, text_md5) with more than one chunk."""
    return chunks.groupBy("doc_id", F.md5("text").alias("text_md5")).agg(F.count("*").alias("n"), F.min("chunk_id").alias("keep_id")).where("n > 1")


def top_duplicated_docs(chunks: DataFrame, docs: DataFrame, k: int = 10) -> DataFrame:
    extra = duplicate_groups(chunks).groupBy("doc_id").agg(F.sum(F.col("n") - 1).alias("extras"))
    return extra.orderBy(F.desc("extras"), "doc_id").limit(k).join(docs.select("doc_id", "map_title"), "doc_id", "left")


def error_breakdown(old: DataFrame, new: DataFrame) -> DataFrame:
    """Error share per (agency, year) in both snapshots and its change in percentage points."""

    def rates(df: DataFrame, tag: str) -> DataFrame:
        node = df.groupBy("agency", "year", "node_id").agg(F.bool_or(F.col("md5").isNotNull()).alias("doc"), F.bool_or("has_error").alias("err"))
        return node.groupBy("agency", "year").agg(F.count("*").alias(f"{tag}_n"), F.count_if(F.col("err") & ~F.col("doc")).alias(f"{tag}_errors"))

    both = rates(old, "old").join(rates(new, "new"), ["agency", "year"], "full_outer").na.fill(0)
    pct = lambda tag: F.coalesce(F.try_divide(F.col(f"{tag}_errors") * 100.0, F.col(f"{tag}_n")), F.lit(0.0))
    return both.withColumn("delta", F.round(pct("new") - pct("old"), 6))


def cross_year(files: DataFrame) -> DataFrame:
    return files.groupBy("agency", "node_id").agg(F.count_distinct("year").alias("years")).where("years > 1")


def report_variants(files: DataFrame, name: str = "name") -> DataFrame:
    """How many files follow each `_-_main report` or `_-_report n` pattern."""
    found = F.regexp_extract(F.lower(F.col(name)), r"_-_(main[_ ]?report|report[_ ]?\d+)", 1)
    return files.select(F.initcap(F.translate(found, "_", " ")).alias("variant")).where("variant <> ''").groupBy("variant").agg(F.count("*").alias("n"))


def profile_fields(df: DataFrame) -> DataFrame:
    """Per column: filled rows, their percentage, distinct values and three samples of 100 characters."""
    cells = F.array(*(F.struct(F.lit(c).alias("field"), F.col(c).cast("string").alias("value")) for c in df.columns))
    total = df.count()
    values = df.select(F.inline(cells)).where("value <> ''").groupBy("field", "value").agg(F.count("*").alias("n"))
    return values.groupBy("field").agg(F.sum("n").alias("present"), F.count("*").alias("values"), F.min(F.substring("value", 1, 100)).alias("first_sample")).withColumn("percent", F.round(F.col("present") * 100.0 / F.lit(max(total, 1)), 4))


def language_transitions(old: DataFrame, new: DataFrame) -> DataFrame:
    """`old -> new` counts of documents whose language changed to a known one."""
    joined = old.select("node_id", F.col("meta_language").alias("a")).join(new.select("node_id", F.col("meta_language").alias("b")), "node_id")
    return joined.where("a <> b AND b <> ''").groupBy(F.concat_ws(" -> ", "a", "b").alias("transition")).agg(F.count("*").alias("n"))


def classification_metrics(df: DataFrame, actual: str, predicted: str) -> DataFrame:
    """Per label: precision, recall, F1 and support, with accuracy, macro and weighted F1 beside them; zero where undefined."""
    cells = df.groupBy(F.col(actual).alias("a"), F.col(predicted).alias("p")).agg(F.count("*").alias("n"))
    asked = cells.groupBy(F.col("a").alias("label")).agg(F.sum("n").alias("support"), F.sum(F.when(F.col("a") == F.col("p"), F.col("n")).otherwise(0)).alias("hit"), F.lit(0).cast("long").alias("called"))
    told = cells.groupBy(F.col("p").alias("label")).agg(F.lit(0).cast("long").alias("support"), F.lit(0).cast("long").alias("hit"), F.sum("n").alias("called"))
    per = asked.unionByName(told).groupBy("label").agg(F.sum("support").alias("support"), F.sum("called").alias("called"), F.sum("hit").alias("hit"))
    part = lambda a, b: F.coalesce(F.try_divide(F.col(a).cast("double"), F.col(b)), F.lit(0.0))
    per = per.withColumns({"precision": part("hit", "called"), "recall": part("hit", "support"), "f1": F.coalesce(F.try_divide(F.col("hit") * 2.0, F.col("called") + F.col("support")), F.lit(0.0))})
    whole = per.agg((F.sum("hit") / F.sum("support")).alias("accuracy"), F.avg("f1").alias("macro_f1"), (F.sum(F.col("f1") * F.col("support")) / F.sum("support")).alias("weighted_f1"))
    return per.join(F.broadcast(whole)).select("label", "support", *(F.round(c, 6).alias(c) for c in ("precision", "recall", "f1", "accuracy", "macro_f1", "weighted_f1")))  # a row beside the labels


def latency_summary(df: DataFrame, key: str, col: str) -> DataFrame:
    """min, mean, p50, p90 and max by nearest rank, per key."""
    p = lambda q: F.percentile_disc(F.lit(q), F.col(col)) if hasattr(F, "percentile_disc") else F.expr(f"percentile_disc({q}) WITHIN GROUP (ORDER BY {col})")
    return df.where(F.col(col).isNotNull()).groupBy(key).agg(F.min(col).alias("low"), F.round(F.avg(col), 6).alias("mean"), p(0.5).alias("p50"), p(0.9).alias("p90"), F.max(col).alias("high"))


def effective_settings(groups: DataFrame) -> DataFrame:
    """Per key the value of the first group by name that has the key, even a null one."""
    first = F.row_number().over(Window.partitionBy("key").orderBy("name"))
    return groups.select("name", F.explode("settings")).withColumn("turn", first).where("turn = 1").select("key", "value")


def text_stats(df: DataFrame, col: str = "text") -> DataFrame:
    return df.withColumn("words", F.when(F.trim(F.regexp_replace(col, r"\s+", " ")) == "", 0).otherwise(F.size(F.split(F.trim(F.regexp_replace(col, r"\s+", " ")), " "))))


def mean_relevance(scores: DataFrame) -> DataFrame:
    """Mean per query, then the mean of these per configuration."""
    return scores.groupBy("config", "query_id").agg(F.avg("score").alias("m")).groupBy("config").agg(F.round(F.avg("m"), 6).alias("relevance"))


def crosstab_from_counts(df: DataFrame, col: str = "counts") -> DataFrame:
    """(row_label, col_label, n) from a map of `row::col`, split at the first `::`; a key without one has no column."""
    at = F.instr("key", "::")
    cells = df.select(F.explode(col).alias("key", "n"))
    return cells.select(F.when(at > 0, F.substring("key", F.lit(1), at - 1)).otherwise(F.col("key")).alias("row_label"), F.when(at > 0, F.substring("key", at + 2, F.length("key"))).alias("col_label"), "n")


def tree_nodes(df: DataFrame, col: str) -> DataFrame:
    """One and the descendants of a tree kept as JSON: nodes are objects with an id. String values are blanked first, so
    what they quote counts for nothing."""
    keys = F.regexp_replace(col, r'([:,\[]\s*)"(?:[^"\\]|\\.)*"(?=\s*[,\]}])', "$10")
    return df.withColumn("nodes", F.regexp_count(keys, F.lit(r'"id"\s*:')))
