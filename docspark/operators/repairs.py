"""Repairs and incremental upkeep: change kinds, taxonomy labels and tags, nested records, stages, boxes, translation."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from docspark.functions import models, strings

# fixed values: states of a document whose file is there
IN_PROGRESS = ("downloaded", "parsing", "parsed", "summarizing", "summarized", "tagging", "tagged", "indexing", "indexed")


def change_type(scanned: DataFrame, known: DataFrame, id_col: str = "doc_id") -> DataFrame:
    """Scanned documents with their `change` against the known ones, and the status that they go on with.

    Both have sys_status and the checksums of file, metadata and error. A missing old checksum is no change; any state in
    progress counts as downloaded and is kept."""
    sums = ("sys_file_checksum", "sys_metadata_checksum", "sys_error_checksum")
    old = known.select(id_col, F.lit(True).alias("old"), F.col("sys_status").alias("old_status"), *(F.col(c).alias(f"old_{c}") for c in sums))
    j = scanned.join(old, id_col, "left")
    differs = {c: F.coalesce(F.nullif(F.col(f"old_{c}"), F.lit("")) != F.coalesce(c, F.lit("")), F.lit(False)) for c in sums}
    file, meta, error = (differs[c] for c in sums)
    downloaded = F.col("sys_status") == "downloaded"
    moved = F.when(downloaded, ~F.coalesce(F.col("old_status").isin(*IN_PROGRESS), F.lit(False))).otherwise(~F.col("sys_status").eqNullSafe(F.col("old_status")))
    change = (
        F.when(F.col("old").isNull(), "new").when(moved, "status_change").when(downloaded & file & meta, "both").when(downloaded & file, "file")
        .when(downloaded & meta, "metadata").when(~downloaded & (meta | error), "download_error").otherwise("unchanged")
    )
    effective = F.when(downloaded & F.col("old_status").isNotNull() & (F.col("old_status") != "download_error"), F.col("old_status")).otherwise(F.col("sys_status"))
    return j.withColumn("change", change).withColumn("effective_status", effective).drop("old", "old_status", *(f"old_{c}" for c in sums))


def fix_taxonomy_labels(tags: Column, names: DataFrame | dict[str, str]) -> Column:
    """An array of `code - name` tags with the names that belong to the codes; unknown codes stay as they are."""
    known = F.create_map(*(F.lit(x) for pair in names.items() for x in pair))

    def fix(tag: Column) -> Column:
        code = F.when(F.instr(tag, " - ") > 0, F.substring_index(tag, " - ", 1)).otherwise(tag)
        name = F.try_element_at(known, code)
        return F.when(name.isNull(), tag).when(name == "", code).otherwise(F.concat_ws(" - ", code, name))

    return F.transform(tags, fix)


def flat_tags(taxonomies: Column) -> Column:
    """Map of kind to structs (code, name) -> map of `tag_` and kind to `code - name`, or the code alone; empty kinds drop."""
    label = lambda x: F.when(F.coalesce(x["name"], F.lit("")) != "", F.concat_ws(" - ", x["code"], x["name"])).otherwise(x["code"])
    flat = F.transform_values(taxonomies, lambda k, v: F.transform(F.filter(v, lambda x: x["code"].isNotNull()), label))
    return F.transform_keys(F.map_filter(flat, lambda k, v: F.size(v) > 0), lambda k, v: F.concat(F.lit("tag_"), k))


def flatten_nested(record: Column, field: str = "sys_data") -> Column:
    """A JSON record, or the object that it holds under its own name, if there is one."""
    inner = F.get_json_object(record, f"$.{field}")
    return F.when(inner.startswith("{"), inner).otherwise(record)


def make_stage(success: Column, at: Column, error: Column | None = None, **more: Column) -> Column:
    """A stage's entry as JSON: success, its time, and an error or other fields where they are not null."""
    shown = F.date_format(at, "yyyy-MM-dd'T'HH:mm:ssXXX")
    return F.to_json(F.struct(success.alias("success"), shown.alias("at"), (F.lit(None).cast("string") if error is None else F.nullif(error, F.lit(""))).alias("error"), *(v.alias(k) for k, v in more.items())))


def bbox(record: Column, page: Column) -> Column:
    """struct(page, l, b, r, t) of a box as JSON: `[page, [l, b, r, t]]`, `[l, b, r, t]` on the chunk's page, or an object
    with these names; null for anything else."""
    number = lambda path: F.get_json_object(record, path).try_cast("double")
    pair = (F.json_array_length(record) == 2) & (F.json_array_length(F.get_json_object(record, "$[1]")) >= 4)
    four, named = F.json_array_length(record) >= 4, F.trim(record).startswith("{")
    form = F.when(pair, 1).when(four, 2).when(named, 3)
    side = lambda f, i, name: F.when(f == 1, number(f"$[1][{i}]")).when(f == 2, number(f"$[{i}]")).when(f == 3, number(f"$.{name}")).alias(name)
    made = lambda f: F.struct(F.when(f == 1, number("$[0]").cast("int")).otherwise(page).alias("page"), side(f, 0, "l"), side(f, 1, "b"), side(f, 2, "r"), side(f, 3, "t"))
    return strings.let(form, lambda f: F.when(f.isNotNull(), made(f)))


def translate(df: DataFrame, target: str, text: str = "text", language: str = "map_language", model: str = "translator") -> DataFrame:
    """Column `translated`: the model's text, or the text itself where the document's language is the target already."""
    same = F.coalesce(F.lower(F.col(language)).startswith(target.lower()), F.lit(False))
    stay = df.where(same).withColumn("translated", F.col(text))
    return models.apply(df.where(~same), model, text, "translated string").unionByName(stay)


def run_taggers(df: DataFrame, taggers: dict[str, Callable[[DataFrame], DataFrame]]) -> DataFrame:
    """Taggers in turn, each a function that adds or replaces columns, and `changed`: whether any column of a row differs
    from before, so that only such rows need writing."""
    before = F.struct(*df.columns)
    got = df.withColumn("__before", before)
    for tag in taggers.values():
        got = tag(got)
    own = [c for c in got.columns if c not in ("__before", *df.columns)]
    moved = F.lit(False)
    for c in df.columns:
        moved = moved | ~F.col(c).eqNullSafe(F.col(f"__before.{c}"))
    for c in own:
        moved = moved | F.col(c).isNotNull()
    return got.withColumn("changed", moved).drop("__before")


def build_facets(docs: DataFrame, chunks: DataFrame, fields: list[str], language: str = "map_language", year: str = "map_published_year") -> DataFrame:
    """(field, value, n): `title` has none, `tag_` fields are counted on chunks, the others on documents; language codes
    become names, years are taken as they are. One pass over each table."""

    def counted(df: DataFrame, own: list[str]) -> DataFrame:
        cells = F.array(*(F.struct(F.lit(f).alias("field"), F.col(f).cast("string").alias("cell")) for f in own))
        rows = df.select(F.inline(cells)).where("cell <> ''")
        parts = F.when(F.col("field").isin(language, year), F.array("cell")).otherwise(strings.split_multivalue(F.col("cell")))
        value = F.when(F.col("field") == language, strings.language_name(F.col("value"))).otherwise(F.col("value"))
        kept = rows.select("field", F.explode(parts).alias("value")).where(F.col("field").isin(language, year) | ~strings.looks_concatenated(F.col("value")))
        return kept.select("field", value.alias("value")).groupBy("field", "value").agg(F.count("*").alias("n"))

    tags, rest = [f for f in fields if f.startswith("tag_")], [f for f in fields if not f.startswith("tag_") and f != "title"]
    made = [counted(df, own) for df, own in ((chunks, tags), (docs, rest)) if own]
    return made[0] if len(made) == 1 else made[0].unionByName(made[1])


def read_rows(table: DataFrame, columns: list[str], ids: DataFrame | None = None, key: str = "doc_id") -> DataFrame:
    """Chosen columns of a table, all rows or those with the given ids; both reach the scan."""
    rows = table if ids is None else table.join(ids.select(key).distinct(), key, "left_semi")
    return rows.select(*columns)
