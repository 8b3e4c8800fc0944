"""Repairs, upserts and reconciliation of document tables."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from docspark.functions import strings


def upsert(target: DataFrame, updates: DataFrame, key: str, order: str | None = None) -> DataFrame:
    """Insert or replace by key; of several updates the last one counts."""
    if order:
        last = F.row_number().over(Window.partitionBy(key).orderBy(F.desc(order)))
        updates = updates.withColumn("__turn", last).where("__turn = 1").drop("__turn", order)
    return target.join(updates, key, "left_anti").unionByName(updates, allowMissingColumns=True)


def merge_fields(target: DataFrame, patch: DataFrame, key: str) -> DataFrame:
    """Shallow merge: a field of the patch wins where it is set."""
    fields = [c for c in patch.columns if c != key]
    renamed = patch.select(key, *(F.col(c).alias(f"__{c}") for c in fields))
    joined = target.join(renamed, key, "left")
    return joined.select(key, *(F.coalesce(f"__{c}", c).alias(c) if c in fields else c for c in target.columns if c != key))


def delete_docs(df: DataFrame, ids: DataFrame, key: str = "doc_id") -> DataFrame:
    """What deleting the documents leaves, in the document table or any table with their key."""
    return df.join(ids.select(key), key, "left_anti")


def prune_orphans(docs: DataFrame, files: DataFrame) -> DataFrame:
    """Documents whose path is null or absent from the inventory, and whether the title says `report 2`."""
    gone = docs.join(files.select(F.col("path").alias("sys_filepath")), "sys_filepath", "left_anti")
    return gone.select("doc_id", "sys_filepath", F.coalesce(F.col("map_title").ilike("%report 2%"), F.lit(False)).alias("second_report"))


def split_countries(df: DataFrame, col: str = "map_country") -> DataFrame:
    """Distinct (old_value, new_value) of cells where country names run together; cells with "; " stay."""
    old = F.col(col)
    new = F.regexp_replace(F.regexp_replace(old, r"([a-z.)])([A-Z])", "$1; $2"), r"\s*;\s*", "; ")
    return df.where(old.isNotNull() & ~old.contains("; ")).select(old.alias("old_value"), new.alias("new_value")).where("old_value <> new_value").distinct()


def split_sdgs(col):
    """A separator before each later `SDG` where there is none."""
    return F.when(col.contains(";"), col).otherwise(F.regexp_replace(col, r"\s*,?\s+(?=SDG)|(?<=[^\s;])(?=SDG)", "; "))


def reset_failed(docs: DataFrame) -> DataFrame:
    failed = F.col("sys_status").isin("parse_failed", "summarize_failed", "index_failed", "stopped")
    return docs.withColumn("sys_status", F.when(failed, "downloaded").otherwise(F.col("sys_status")))


def reset_status(docs: DataFrame, smart: bool) -> DataFrame:
    """All but download errors back to downloaded; the smart form lists only those that change."""
    kept = docs.where(F.col("sys_status").isNotNull() & (F.col("sys_status") != "download_error") & ~F.col("sys_filepath").endswith(".error"))
    kept = kept.where("sys_status <> 'downloaded'") if smart else kept
    return kept.select("doc_id", F.col("sys_status").alias("old_status"), F.lit("downloaded").alias("new_status"))


def error_path_consistency(docs: DataFrame) -> DataFrame:
    wrong = F.col("sys_filepath").endswith(".error") & F.col("sys_status").isin("downloaded", "parsed", "summarized", "tagged", "indexed")
    return docs.where(wrong).select("doc_id", F.col("sys_status").alias("old_status"), F.lit("download_error").alias("new_status"))


def backfill(df: DataFrame, pairs: dict[str, str]) -> DataFrame:
    """Missing target columns filled from their sources."""
    return df.withColumns({target: F.coalesce(F.when(F.trim(target) != "", F.col(target)), F.col(source)) for target, source in pairs.items()})


def fix_extensions(docs: DataFrame, files: DataFrame) -> DataFrame:
    """`.pdf` paths without a file but with a `.docx`, else a `.doc`: the new path and status."""
    stem = F.regexp_replace("path", r"\.[^.]*$", "")
    kinds = files.withColumn("stem", stem).groupBy("stem").agg(*(F.bool_or(F.col("path").endswith(x)).alias(x[1:]) for x in (".pdf", ".docx", ".doc")))
    found = docs.where(F.col("sys_filepath").endswith(".pdf")).withColumn("stem", F.regexp_replace("sys_filepath", r"\.[^.]*$", "")).join(kinds, "stem")
    new = F.when(F.col("docx"), F.concat("stem", F.lit(".docx"))).when(F.col("doc"), F.concat("stem", F.lit(".doc")))
    return found.where(~F.col("pdf")).select("doc_id", new.alias("sys_filepath"), F.lit("downloaded").alias("sys_status")).where("sys_filepath is not null")


def heading_pattern(col):
    """What kind of headings a summary has."""
    return (
        F.when(col.rlike(r"^\s*```"), "code_fence").when(col.rlike(r"(?m)^\s*[-*] \*\*[^*]+\*\*\s*$"), "bullet_bold").when(col.rlike(r"(?m)^# "), "h1")
        .when(col.rlike(r"(?m)^### [^\n]*:\s*$"), "h3_colon").when(col.rlike(r"(?m)^##+ "), "ok").otherwise("unknown")
    )


def fix_headings(col):
    """Headings rewritten to `##`."""
    for pattern, by in ((r"^\s*```[a-z]*\n|\n```\s*$", ""), (r"(?m)^\s*[-*] \*\*([^*\n]+)\*\*\s*$", "## $1"), (r"(?m)^# ", "## "), (r"(?m)^### ([^\n]*?):\s*$", "### $1")):
        col = F.regexp_replace(col, pattern, by)
    return col


def glyph_ratio(col):
    """The share of a text that is unresolved glyph names; 0 below 200 characters."""
    gids = F.regexp_count(col, F.lit(r"/gid\d{5}")) * 9
    marks = F.aggregate(F.regexp_extract_all(col, F.lit(r"GLYPH<[^>]*>"), F.lit(0)), F.lit(0), lambda s, x: s + F.length(x))
    return F.when(F.length(col) < 200, 0.0).otherwise((gids + marks) / F.length(col))


def reset_contaminated(docs: DataFrame, text: str, threshold: float = 0.10) -> DataFrame:
    """Documents whose text is glyph names by `threshold` or more, set back to be parsed again, with the reason."""
    bad = docs.where(glyph_ratio(F.col(text)) >= threshold)
    return bad.withColumn("sys_status", F.lit("downloaded")).withColumn("sys_error_message", F.lit("Reset: glyph contamination in parsed output"))


def reconcile_counts(a: DataFrame, b: DataFrame, key: str = "doc_id") -> DataFrame:
    """Keys whose row counts differ between two stores."""
    x, y = (df.groupBy(key).agg(F.count("*").alias(n)) for df, n in ((a, "left_n"), (b, "right_n")))
    both = x.join(y, key, "full_outer").na.fill(0, ["left_n", "right_n"])
    return both.where("left_n <> right_n").withColumn("difference", F.abs(F.col("left_n") - F.col("right_n")))


def compare_snapshots(old: DataFrame, new: DataFrame) -> DataFrame:
    """Per node: where it is, whether its file is the same, what became of its error, and of its language field."""
    o = old.select("node_id", F.col("md5").alias("a"), F.col("has_error").alias("ae"), F.trim(F.regexp_replace("meta_language", r"\s+", " ")).alias("al"), F.lit(1).alias("o"))
    n = new.select("node_id", F.col("md5").alias("b"), F.col("has_error").alias("be"), F.trim(F.regexp_replace("meta_language", r"\s+", " ")).alias("bl"), F.lit(1).alias("w"))
    j = o.join(n, "node_id", "full_outer")
    side = F.when(F.col("w").isNull(), "only_old").when(F.col("o").isNull(), "only_new").otherwise("both")
    both = F.col("o").isNotNull() & F.col("w").isNotNull()
    file = F.when(~both, None).when(F.col("a").isNull() & F.col("b").isNull(), "none").when(F.col("a").eqNullSafe(F.col("b")), "identical").otherwise("different")
    error = F.when(~both, None).when(F.col("ae") & ~F.col("be"), "resolved").when(~F.col("ae") & F.col("be"), "new").when(F.col("ae"), "kept").otherwise("none")
    blank = lambda c: F.coalesce(F.col(c), F.lit("")) == ""
    field = F.when(~both, None).when(blank("al") & ~blank("bl"), "richer").when(~blank("al") & blank("bl"), "lost").when(F.col("al") != F.col("bl"), "changed").otherwise("same")
    return j.select("node_id", side.alias("side"), file.alias("file"), error.alias("error"), field.alias("language"))


def plan_update(old: DataFrame, new: DataFrame) -> DataFrame:
    """One action per node: keep, regression, metadata, replace, add or newly available."""
    c = compare_snapshots(old, new).join(new.select("node_id", "md5"), "node_id", "left")
    was = old.select("node_id", F.col("md5").alias("old_md5"))
    c = c.join(was, "node_id", "left")
    action = (
        F.when(F.col("side") == "only_old", "keep").when(F.col("side") == "only_new", F.when(F.col("md5").isNull(), "error_only").otherwise("add"))
        .when(F.col("old_md5").isNotNull() & F.col("md5").isNull(), "regression").when(F.col("old_md5").isNull() & F.col("md5").isNotNull(), "newly_available")
        .when(F.col("file") == "different", "replace").when(F.col("language") != "same", "metadata").otherwise("keep")
    )
    return c.select("node_id", action.alias("action"))


def compare_checksums(local: DataFrame, remote: DataFrame, key: str = "node_id") -> DataFrame:
    j = local.select(key, F.col("md5").alias("a")).join(remote.select(key, F.col("md5").alias("b"), F.lit(1).alias("there")), key, "left")
    return j.select(key, F.when(F.col("there").isNull(), "missing").when(F.col("a").eqNullSafe(F.col("b")), "ok").otherwise("mismatch").alias("status"))


def scan_diff(found: DataFrame, existing: DataFrame) -> DataFrame:
    """Change class of each scanned node against the stored one; a missing old checksum is no change."""
    j = found.select("node_id", F.col("md5").alias("b"), F.col("has_error").alias("be"), F.col("meta_language").alias("bm")).join(
        existing.select("node_id", F.col("md5").alias("a"), F.col("has_error").alias("ae"), F.col("meta_language").alias("am"), F.lit(1).alias("old")), "node_id", "left"
    )
    file, meta = F.coalesce(F.col("a") != F.col("b"), F.lit(False)), F.coalesce(F.col("am") != F.col("bm"), F.lit(False))
    kind = F.when(F.col("old").isNull(), "new").when(F.col("be") & ~F.col("ae"), "download_error").when(F.col("ae") != F.col("be"), "status_change").when(file & meta, "both").when(file, "file").when(meta, "metadata").otherwise("unchanged")
    return j.select("node_id", kind.alias("change"))


def mark_duplicates(docs: DataFrame) -> DataFrame:
    """Downloaded documents by checksum: all but the first path are duplicates."""
    turn = F.row_number().over(Window.partitionBy("sys_file_checksum").orderBy("sys_filepath", "doc_id"))
    return docs.where("sys_status = 'downloaded' AND sys_file_checksum IS NOT NULL").select("doc_id", (turn > 1).alias("is_duplicate"))


def dedupe_last(df: DataFrame, key: str, order: str) -> DataFrame:
    """The last row of each key, at the place of the first."""
    rest = [c for c in df.columns if c != key]
    got = df.groupBy(key).agg(F.max_by(F.struct(*rest), order).alias("last"), F.min(order).alias("place"))
    return got.select(key, *(F.col(f"last.{c}").alias(c) for c in rest if c != order), F.col("place").alias(order))


def recent_first(docs: DataFrame) -> DataFrame:
    """With the key that orders recent documents first: year, bad ones last, then the id as text."""
    return docs.withColumn("sort_year", F.coalesce(F.col("map_published_year").try_cast("int"), F.lit(0)))


def merge_codes(rows: DataFrame, names: DataFrame) -> DataFrame:
    """The first row of each (doc, code) with the code's name; unknown codes drop."""
    return rows.groupBy("doc_id", "code").agg(F.min_by("reason", "ord").alias("reason")).join(names, "code")


def field_page(df: DataFrame, keys: list, size: int, page: int) -> DataFrame:
    return df.orderBy(*keys).offset(size * (page - 1)).limit(size)


def countries_fixed(df: DataFrame) -> DataFrame:
    return df.withColumn("concatenated", strings.looks_concatenated(F.col("map_country")))


def lookup(table: DataFrame, wanted: DataFrame, key: str) -> DataFrame:
    """Rows whose key (id, checksum, path or source id) is among the wanted ones."""
    return table.join(wanted.select(key).where(F.col(key).isNotNull()).distinct(), key, "left_semi")


def partition_slice(df: DataFrame, workers: int, order: str, within: str) -> DataFrame:
    """Column `slice`: contiguous, near-equal slices of each group's rows in order, one for a worker."""
    return df.withColumn("slice", F.ntile(workers).over(Window.partitionBy(within).orderBy(F.col(order).cast("long"))))


def compare_keys(old: DataFrame, new: DataFrame, key: str) -> DataFrame:
    """(key, side): whether a key is in the old snapshot alone, the new one alone, or both."""
    marks = old.select(key, F.lit(1).alias("old"), F.lit(0).alias("new")).unionByName(new.select(key, F.lit(0).alias("old"), F.lit(1).alias("new")))
    both = marks.groupBy(key).agg(F.max("old").alias("old"), F.max("new").alias("new"))
    return both.select(key, F.when(F.col("new") == 0, "only_old").when(F.col("old") == 0, "only_new").otherwise("shared").alias("side"))


def union_stages(docs: DataFrame, stages: list[str]) -> DataFrame:
    """Documents in any of the stages, with the stage's place; one pass."""
    place = F.array_position(F.array(*map(F.lit, stages)), F.col("sys_status")).cast("int")
    return docs.where(F.col("sys_status").isin(*stages)).withColumn("ord", place)


def clear_fields(df: DataFrame, prefix: str) -> DataFrame:
    """All columns that begin with the prefix set to null, their types kept."""
    return df.withColumns({c: F.lit(None).cast(df.schema[c].dataType) for c in df.columns if c.startswith(prefix)})


def taxonomy_storage(df: DataFrame, field: str) -> DataFrame:
    """One row: how many rows have a value and how many have none."""
    return df.agg(F.count_if(F.col(field).isNotNull()).alias("with_tags"), F.count_if(F.col(field).isNull()).alias("without_tags"))
