"""Projections, filters and predicates over document and chunk tables."""

from __future__ import annotations

from functools import reduce
from operator import and_

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from docspark.functions import strings


def apply_mapping(df: DataFrame, mapping: dict[str, str], prefix: str = "map_") -> DataFrame:
    """Core columns from a mapping of core field to source field, `fixed_value:X` or `YEAR(field)`; blanks are null."""
    made = {}
    for core, source in mapping.items():
        if source.startswith("fixed_value:"):
            value = F.lit(source.split(":", 1)[1])
        elif source.startswith("YEAR("):
            value = strings.year_of(F.col(source[5:-1]).cast("string")).cast("string")
        else:
            value = F.col(source).cast("string")
        made[prefix + core] = F.when(F.trim(value) != "", value)
    return df.withColumns(made)


def source_columns(df: DataFrame, raw: str, reserved: tuple[str, ...] = ()) -> DataFrame:
    """The map column `raw` with keys made column-safe, reserved keys dropped."""
    kept = F.map_filter(raw, lambda k, v: ~k.isin(*reserved)) if reserved else F.col(raw)
    return df.withColumn(raw, F.transform_keys(kept, lambda k, v: strings.source_key(k)))


def normalize_docs(df: DataFrame) -> DataFrame:
    """Bare names beside `map_*` and `sys_*`; a system language overrides the mapped one."""
    bare = {}
    for c in df.columns:
        if c.startswith(("map_", "sys_")):
            bare.setdefault(c[4:], []).append(c)
    return df.withColumns({k: F.coalesce(*sorted(v, key=lambda c: not (c.startswith("sys_") and k == "language"))) for k, v in bare.items() if k not in df.columns})


def compile_filters(filters: dict) -> Column:
    """One condition: equality, comma text or list as IN, `title` by words, `x_min` and `x_max` as numbers."""
    parts = [F.lit(True)]
    for key, value in filters.items():
        if value in (None, "", []):
            continue
        if key.endswith("_min"):
            parts.append(F.col(key[:-4]).try_cast("double") >= float(value))
        elif key.endswith("_max"):
            parts.append(F.col(key[:-4]).try_cast("double") <= float(value))
        elif key.endswith("title"):
            parts += [F.lower(F.col(key)).contains(w) for w in str(value).lower().split()]
        else:
            values = value if isinstance(value, list) else [x.strip() for x in str(value).split(",") if x.strip()]
            parts.append(F.col(key).isin(*values))
    return reduce(and_, parts)


def filter_docs(df: DataFrame, filters: dict) -> DataFrame:
    """`title` and `search` match anywhere without case; others by equality or IN."""
    rest = dict(filters)
    title, search = rest.pop("title", None), rest.pop("search", None)
    if title:
        df = df.where(F.col("map_title").ilike(f"%{title}%"))
    if search:
        df = df.where(F.col("map_title").ilike(f"%{search}%") | F.col("sys_full_summary").ilike(f"%{search}%"))
    return df.where(compile_filters(rest))


def filter_docs_loose(df: DataFrame, search: str, field: str, values: list[str]) -> DataFrame:
    """The search text in title and summary together; a stored value matches by any of its comma-separated parts."""
    hay = F.lower(F.concat_ws(" ", "map_title", "sys_full_summary"))
    return df.where(hay.contains(search.lower()) & F.arrays_overlap(F.split(field, r",\s*"), F.array(*map(F.lit, values))))


def filter_language(chunks: DataFrame, docs: DataFrame, names: list[str]) -> DataFrame:
    codes = docs.where(F.col("map_language").isin(*[c for c, n in strings.LANGUAGES.items() if n in names or c in names]))
    return chunks.join(codes.select("doc_id"), "doc_id", "left_semi")


def expand_filter(df: DataFrame, col: str, values: list[str]) -> DataFrame:
    """A selected value also matches cells that hold it among others."""
    return df.where(F.arrays_overlap(strings.split_multivalue(F.col(col)), F.array(*map(F.lit, values))))


def filter_sections(df: DataFrame, types: list[str], col: str = "section_type") -> DataFrame:
    return df.where(F.lower(F.trim(col)).isin(*[t.strip().lower() for t in types]))


def filter_min_chars(df: DataFrame, n: int, col: str = "text") -> DataFrame:
    return df.where(F.length(col) >= n) if n > 0 else df


def doc_search(docs: DataFrame, q: str, filters: dict) -> DataFrame:
    """Indexed documents whose title or summary holds the text: score 0 and the first 500 characters."""
    hit = F.lower("map_title").contains(q.lower()) | F.lower("sys_full_summary").contains(q.lower())
    kept = docs.where((F.col("sys_status") == "indexed") & hit & compile_filters(filters))
    return kept.select("doc_id", "map_title", F.lit(0.0).alias("score"), F.substring("sys_full_summary", 1, 500).alias("text"))


def scroll(chunks: DataFrame, condition: Column, limit: int) -> DataFrame:
    return chunks.where(condition).withColumn("score", F.lit(0.0)).orderBy("chunk_id").limit(limit)


def permit(df: DataFrame, grants: DataFrame, members: DataFrame, user: int | None, col: str) -> DataFrame:
    """Rows of the sources granted to any of the user's groups; no user, no filtering."""
    if user is None:
        return df
    allowed = grants.join(members.where(F.col("user_id") == user), "group_id").select(F.col("source").alias(col)).distinct()
    return df.join(allowed, col, "left_semi")


def since(df: DataFrame, col: str, now: str, hours: int) -> DataFrame:
    return df.where(F.col(col) >= F.lit(now).cast("timestamp") - F.expr(f"INTERVAL {hours} HOURS"))


STAGE_INPUT = {"parse": "downloaded", "summarize": "parsed", "tag": "summarized", "index": "tagged"}


def select_for_stage(docs: DataFrame, skips: set[str], agency: str | None = None, report: str | None = None) -> DataFrame:
    """Documents ready for the enabled stages, latest stage first."""
    wanted = [status for stage, status in reversed(STAGE_INPUT.items()) if stage not in skips]
    kept = docs.where(F.col("sys_status").isin(*wanted))
    if agency:
        kept = kept.where(F.col("map_organization") == agency)
    return kept.where(F.col("sys_filepath").contains(report)) if report else kept


def find_stuck(docs: DataFrame) -> DataFrame:
    return docs.where(F.col("sys_status").isin("indexing", "summarizing", "pending"))


def restrict_by_title(chunks: DataFrame, docs: DataFrame, text: str) -> DataFrame:
    """Chunks of documents whose title holds the text, in any case."""
    return chunks.join(docs.where(F.col("map_title").ilike(f"%{text}%")).select("doc_id"), "doc_id", "left_semi")


def indexed_only(chunks: DataFrame, docs: DataFrame) -> DataFrame:
    """Chunks of documents that are indexed."""
    return chunks.join(docs.where("sys_status = 'indexed'").select("doc_id"), "doc_id", "left_semi")
