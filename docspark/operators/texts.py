"""Chunk texts and elements: repairs, references, splits, fallback contents and validation of model output."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from docspark.functions import strings
from docspark.functions.unicode import normalized
from docspark.operators.sections import KEYWORDS

# fixed values: what stands for a lost character, longer ones first, and a bullet of a symbol font
LOST = (("D�mo", "Démo"), ("R�publique", "République"), ("cr�que", "cratique"), ("�", "ti"), ("", "•"))
SPACED = r"\b(?:[a-zA-Z]\s+){3,}[a-zA-Z]\b"
# fixed values: marks of table extraction in short texts
TABLE_MARKS = (r"best\s+match.*score.*\d+", r"\[sheet:.*\]", r"sheet:.*score", r"^prov[_\s]", r"^otsl[_\s]")
# fixed values: where a footnote's number may stand, in the order in which they are tried
REFERENCES = (
    ("period_space", r"\.\s+(\d{1,3})\s+"), ("start_of_text", r"^(\d{1,3})\s+"), ("comma_space", r",\s+(\d{1,3})\s+"), ("period_newline", r"\.\s+(\d{1,3})\n"),
    ("geometric_caret", r"\^(\d{1,3})"), ("bracket_caret", r"\[\^(\d{1,3})\]"), ("html_tag", r"<sup>(\d{1,3})</sup>"),
)
# fixed values: headings that stand alone on a line, English, French and Spanish
ALONE = """
Introduction Conclusion Recommendations Methodology Results Discussion Summary Abstract Background Appendix Annex Bibliography References Acknowledgements
Introduction Conclusion Recommandations Méthodologie Résultats Résumé Contexte Appendice Annexe Bibliographie Références Remerciements
Introducción Conclusión Recomendaciones Metodología Resultados Resumen Contexto Apéndice Anexo Bibliografía Referencias Agradecimientos
""".split()
CAPITALS = "A-ZÀÁÂÃÄÅÆÇÈÉÊËÌÍÎÏÐÑÒÓÔÕÖØÙÚÛÜÝÞ"
NUMBERED = rf"^(\d+(?:\.\d+)*)\s*\.?\s+([{CAPITALS}][^\n]{{3,80}})$"


# fixed values: words with a lost ligature and what they were, tried in this order in any case
LIGATURES = r"""
Na�onal National
na�onal national
Informa�on Information
informa�on information
Organiza�on Organization
organiza�on organization
Evalua�on Evaluation
evalua�on evaluation
Situa�on Situation
situa�on situation
Funcon Function
Func�on Function
funcon function
func�on function
Forma�ve Formative
forma�ve formative
Acon Action
Ac�on Action
acon action
ac�on action
Popula�on Population
popula�on population
Idenfy Identify
Iden�fy Identify
iden�fy identify
Nofy Notify
No�fy Notify
no�fy notify
Effecve Effective
Effec�ve Effective
effec�ve effective
Opera�on Operational
opera�on operational
Nutri�on Nutrition
nutri�on nutrition
Educa�on Education
educa�on education
Loca�on Location
loca�on location
Protec�on Protection
protec�on protection
Sec�on Section
sec�on section
Communica�on Communication
communica�on communication
Descrip�on Description
descrip�on description
Bulle�n Bulletin
bulle�n bulletin
Solu�on Solution
�on\b tion
�ve\b tive
"""
# fixed values: words whose ligature is gone altogether, tried in this order in any case
DROPPED = r"""
Naonal National
Formave Formative
evaluaon evaluation
situaon situation
Organizaon Organization
Bullen Bulletin
funcon function
acon action
populaon population
idenfy identify
nofy notify
effecve effective
Descripon Description
descripon description
pracce practice
parcipant participant
mul\b multi
addional additional
operaonal operational
nutrion nutrition
educaon education
locaon location
protecon protection
secon section
Soluon Solution
informon information
communicaon communication
"""


def _folded(col: Column) -> Column:
    """Equal for letters that a pattern takes as equal in any case, over ASCII too."""
    return F.lower(F.upper(F.translate(col, "\u0130", "i")))


def _replaced(col: Column, table: str) -> Column:
    """Rules in turn. A pattern is only tried where its letters stand in the folded text as it is by then."""
    rules = []
    for pattern, by in (line.split(" ") for line in table.split("\n") if line):
        held = pattern.removesuffix(r"\b")
        edged = held + r"(?![\p{L}\p{N}_])" if pattern.endswith(r"\b") else pattern
        rules.append(F.struct(F.lit(held.lower()).alias("held"), F.lit(f"(?iu){edged}").alias("pattern"), F.lit(by).alias("by")))
    both = lambda text: F.struct(text.alias("text"), _folded(text).alias("low"))
    step = lambda s, r: F.when(F.contains(s["low"], r["held"]), strings.let(F.regexp_replace(s["text"], r["pattern"], r["by"]), both)).otherwise(s)
    return F.aggregate(F.array(*rules), strings.let(col, both), step, lambda s: s["text"])


def clean_text(df: DataFrame, col: str, dropped: bool = True) -> DataFrame:
    """With a text column repaired: old encodings, then Unicode's compatible form, then lost ligatures; where `dropped`, words
    that lost them without a trace, too, which also changes words that hold such letters (`bacon`)."""
    df = normalized(df.withColumn(col, strings.fix_mojibake(F.col(col))), col, "NFKC")
    lost = F.regexp_replace(_replaced(F.col(col), LIGATURES), r"(?i)([a-z])�([a-z])", "$1ti$2")
    df = df.withColumn(col, F.when(F.contains(F.col(col), F.lit("�")), lost).otherwise(F.col(col)))
    return df.withColumn(col, _replaced(F.col(col), DROPPED)) if dropped else df


def repair_chunk_text(col: Column) -> Column:
    """Lost characters back, footnote marks as `[^n]` and at a line's start `[^n]:`, letter-spaced words closed up."""
    col = strings.fix_mojibake(col)
    for old, new in LOST:
        col = F.replace(col, F.lit(old), F.lit(new))
    for pattern, by in ((r"\[(\d{1,3})\]", "[^$1]"), (r"\^(\d{1,3})", "[^$1]"), (r"(^|\n)\[\^(\d{1,3})\](?!:)", "$1[^$2]:")):
        col = F.regexp_replace(col, pattern, by)
    close = lambda run: F.when(run.contains("   "), F.array_join(F.transform(F.split(run, "   "), lambda x: F.replace(x, F.lit(" "), F.lit(""))), " ")).otherwise(F.replace(run, F.lit(" "), F.lit("")))
    found, gaps = F.regexp_extract_all(col, F.lit(SPACED), F.lit(0)), F.split(col, SPACED, -1)
    closed = F.array_join(F.transform(gaps, lambda g, i: F.concat(g, F.coalesce(close(F.get(found, i)), F.lit("")))), "")
    return F.when(col.rlike(SPACED), closed).otherwise(col)


def clean_elements(elements: DataFrame) -> DataFrame:
    """Elements of chunks without images before the first text, unless it begins like a caption, and without short texts of
    table extraction. Rows are (chunk_id, pos, element_type, label, text); one pass over a chunk's order."""
    w = Window.partitionBy("chunk_id")
    is_text = F.col("element_type") == "text"
    first = F.min(F.when(is_text, F.col("pos"))).over(w)
    caption = (F.col("label") == "caption") | F.lower(F.trim("text")).rlike(r"^(figure|table|diagram)")
    captioned = F.max_by(F.coalesce(caption, F.lit(False)), F.when(is_text, -F.col("pos"))).over(w)
    kept = elements.withColumn("__first", first).withColumn("__captioned", captioned)
    early = (F.col("element_type") == "image") & ~F.col("__captioned") & (F.col("pos") < F.col("__first"))
    text = F.lower(F.trim("text"))
    marks = is_text & (F.length(text) < 100) & text.rlike("(?s)" + "|".join(TABLE_MARKS))
    return kept.where(~F.coalesce(early, F.lit(False)) & ~F.coalesce(marks, F.lit(False))).drop("__first", "__captioned")


def inline_refs(elements: DataFrame, id_col: str = "chunk_id") -> DataFrame:
    """(id, number, position, pattern): numbers of the column `notes` where they stand like references in `text`; a number
    at a place counts once, by the first pattern that finds it there. Positions count from 0."""
    every = "array<struct<turn:int,pattern:string,number:int,position:int>>"

    def places(p: Column, turn: int, name: str) -> Column:
        step = lambda s, i: F.struct((s["p"] + F.length(F.get(p["cut"], i)) + F.length(F.get(p["whole"], i))).alias("p"), F.concat(s["at"], F.array(s["p"] + F.length(F.get(p["cut"], i)) + F.length(F.get(p["head"], i)))).alias("at"))
        start = F.struct(F.lit(0).alias("p"), F.array().cast("array<int>").alias("at"))
        at = F.aggregate(F.sequence(F.lit(0), F.size(p["number"]) - 1), start, step, lambda s: s["at"])
        return F.zip_with(p["number"], at, lambda n, x: F.struct(F.lit(turn).alias("turn"), F.lit(name).alias("pattern"), n.cast("int").alias("number"), x.alias("position")))

    found = []
    for turn, (name, pattern) in enumerate(REFERENCES):
        head, tail = pattern.split(r"(\d{1,3})")
        all_ = lambda p, k: F.regexp_extract_all("text", F.lit(p), F.lit(k))
        parts = F.struct(F.split("text", pattern, -1).alias("cut"), all_(f"({head})" + r"\d{1,3}" + tail, 1).alias("head"), all_(pattern, 0).alias("whole"), all_(pattern, 1).alias("number"))
        own = strings.let(parts, lambda p: places(p, turn, name))  # noqa: B023
        found.append(F.when(F.col("text").rlike(pattern), own.cast(every)).otherwise(F.array().cast(every)))
    rows = elements.select(id_col, "notes", F.explode(F.concat(*found)).alias("r")).select(id_col, "notes", "r.*")
    known = rows.where(F.array_contains("notes", F.col("number")))
    return known.groupBy(id_col, "number", "position").agg(F.min_by("pattern", "turn").alias("pattern"))


def split_balanced(text: Column, most: int | Column, reach: int = 200) -> Column:
    """Near-equal parts of at most about `most` characters, each cut after the last blank line within `reach` of its end."""
    let = strings.let

    def step(s: Column, last: Column, t: Column, n: Column, size: Column) -> Column:
        end = s["at"] + size
        took = lambda cut: F.struct(cut.alias("at"), F.concat(s["done"], F.array(F.substring(t, s["at"] + 1, F.when(last, n).otherwise(cut - s["at"])))).alias("done"))
        cut = lambda low, window, back: F.when(back > 0, low + F.length(window) - back + 1).otherwise(end).cast("int")
        within = lambda low, window: let(F.locate("\n\n", F.reverse(window)), lambda back: let(cut(low, window, back), took))  # noqa: E731  the last blank line, from the end
        return let(F.greatest(s["at"], end - reach), lambda low: let(F.substring(t, low + 1, F.least(n, end + reach) - low), lambda window: within(low, window)))

    def cut_up(t: Column, n: Column, parts: Column, size: Column) -> Column:
        start = F.struct(F.lit(0).alias("at"), F.array().cast("array<string>").alias("done"))
        return F.aggregate(F.sequence(F.lit(1), parts), start, lambda s, i: step(s, i == parts, t, n, size), lambda s: s["done"])

    sized = lambda t, n: let(F.ceil(n / most).cast("int"), lambda parts: let(F.floor(n / parts).cast("int"), lambda size: cut_up(t, n, parts, size)))
    return let(text, lambda t: let(F.length(t), lambda n: F.when(n <= most, F.array(t)).otherwise(sized(t, n))))


def parse_labels(outputs: DataFrame, col: str = "output") -> DataFrame:
    """(doc_id, idx, label) of model output: a JSON array, or the outermost brackets in a text. Items need a whole `idx`
    and a known `label`; of several for an index the first counts. Other columns of `outputs` than doc_id are ignored."""
    inner = F.regexp_extract(col, r"(?s)(\[.*\])", 1)
    items = F.from_json(inner, "array<struct<idx:string,label:string>>", {"mode": "PERMISSIVE"})
    rows = outputs.select("doc_id", F.posexplode(items).alias("turn", "item"))
    idx, label = F.col("item.idx").try_cast("int"), F.trim("item.label")
    known = rows.select("doc_id", "turn", idx.alias("idx"), label.alias("label")).where(F.col("idx").isNotNull() & F.col("label").isin(*KEYWORDS, "other"))
    return known.groupBy("doc_id", "idx").agg(F.min_by("label", "turn").alias("label"))


def toc_from_text(docs: DataFrame, col: str = "text") -> DataFrame:
    """(doc_id, pos, level, title, page): numbered lines with a capital, and headings that stand alone, of plain text with
    `------- Page n -------` marks. A title counts once."""
    lines = docs.select("doc_id", F.posexplode(F.split(col, "\n")).alias("pos", "line")).withColumn("line", F.trim("line"))
    mark = F.regexp_extract("line", r"------- Page (\d+) -------", 1).try_cast("int")
    before = Window.partitionBy("doc_id").orderBy("pos").rowsBetween(Window.unboundedPreceding, 0)
    paged = lines.withColumn("page", F.coalesce(F.last(mark, True).over(before), F.lit(1)))
    number, alone = F.regexp_extract("line", NUMBERED, 1), F.lower("line").isin(*{x.lower() for x in ALONE})
    title = F.when(number != "", F.concat(number, F.lit(". "), F.trim(F.regexp_extract("line", NUMBERED, 2)))).when(alone, F.col("line"))
    level = F.when(number != "", F.least(F.regexp_count(number, F.lit(r"\.")) + 2, F.lit(5))).otherwise(2)
    fits = paged.where(mark.isNull() & ~F.col("line").rlike(r"^(\||!\[)") & (F.length("line") >= 5)).select("doc_id", "pos", "page", level.cast("int").alias("level"), title.alias("title")).where("title is not null")
    turn = F.row_number().over(Window.partitionBy("doc_id", F.lower("title")).orderBy("pos"))
    return fits.withColumn("turn", turn).where("turn = 1").select("doc_id", "pos", "level", F.substring("title", 1, 80).alias("title"), "page")

