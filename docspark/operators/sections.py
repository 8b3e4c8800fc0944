"""Tables of contents and section labels. A row of a toc is (doc_id, idx, level, title, page, …); idx orders a document."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from docspark.functions import models, strings
from docspark.sources.shared import once, staged

# fixed values: section labels in the order in which they are tried, with the phrases that give them, a pattern a line
KEYWORDS = {
    "front_matter": r"""
table\s+of\s+contents
^\s*contents\s*$
sommaire
table\s+des\s+mati[eè]res
[ií]ndice
lista\s+de\s+figuras
lista\s+de\s+tablas
lista\s+de\s+gr[aá]ficos
lista\s+de\s+mapas
lista\s+de\s+cuadros
list\s+of\s+figures
list\s+of\s+tables
liste\s+des\s+figures
liste\s+des\s+tableaux
acknowledg(e)?ments
remerciements
agradecimientos
foreword
avant[-\s]?propos
preface
disclaimer
descargo\s+de\s+responsabilidad
exenci[oó]n\s+de\s+responsabilidad
personal\s+clave
cr[eé]ditos?\s+fotogr[aá]ficos
copyright
""",
    "acronyms": r"""
acronyms
abbreviations
glossary
glossaire
glosario
sigles
abr[eé]viations
""",
    "executive_summary": r"""
executive\s+summary
evaluation\s+brief
^\s*summary\s*$
r[eé]sum[eé]\s+ex[eé]cutif
note\s+d['’]?évaluation
note\s+d['’]?evaluation
resumen\s+ejecutivo
nota\s+de\s+evaluaci[oó]n
исполнительное\s+резюме
कार्यकारी\s+सारांश
ملخص\s+تنفيذي
resumo\s+executivo
nota\s+de\s+avalia[çc][aã]o
exekutive\s+zusammenfassung
riassunto\s+esecutivo
""",
    "recommendations": r"""
recommendations?
management\s+response
way\s+forward
next\s+steps
considerations?
action\s+plan
priority\s+actions?
recommandations?
recomendaciones?
рекомендации
सिफारिशें
التوصيات
recomenda[çc][oõ]es
empfehlungen
raccomandazioni
""",
    "conclusions": r"""
conclusions?
conclusiones?
выводы
заключение
निष्कर्ष
الاستنتاجات
الخلاصة
conclus[oõ]es
schlussfolgerungen
conclusioni
""",
    "methodology": r"""
methodology
methods?
approach
data\s+collection
limitations?
evaluation\s+design
research\s+design
m[eé]thodologie
m[eé]thodes
metodolog[ií]a
m[eé]todos
методология
методы
कार्यप्रणाली
विधि
منهجية
طرق
methodik
methoden
metodi
""",
    "introduction": r"""
introduction
purpose
scope
object\s+of\s+evaluation
objectives?\s+of\s+the\s+evaluation
evaluation\s+objectives?
evaluation\s+aims?
evaluation\s+questions?
evaluation\s+features
evaluation\s+strategy
objectifs?\s+de\s+l'?évaluation
port[ée]e
objet\s+de\s+l'?évaluation
introducci[oó]n
objetivos?\s+de\s+la\s+evaluaci[oó]n
alcance
objeto\s+de\s+la\s+evaluaci[oó]n
введение
цели\s+оценки
задачи
объект\s+оценки
परिचय
मूल्यांकन\s+के\s+उद्देश्य
परिधि
مقدمة
أهداف\s+التقييم
نطاق
introdu[çc][aã]o
objetivos?\s+da\s+avalia[çc][aã]o
escopo
einf[üu]hrung
ziele\s+der\s+bewertung
umfang
introduzione
obiettivi\s+della\s+valutazione
ambito
""",
    "context": r"""
overview
background
context
project\s+description
theory\s+of\s+change
intervention
strategic\s+plan
contexte
vue\s+d'ensemble
description\s+du\s+projet
contexto
descripci[oó]n\s+del\s+proyecto
обзор
контекст
описание\s+проекта
पृष्ठभूमि
प्रसंग
خلفية
سياق
descri[çc][aã]o\s+do\s+projeto
kontext
projektbeschreibung
contesto
descrizione\s+del\s+progetto
""",
    "appendix": r"""
appendix
appendices
appendice
ap[eé]ndice
ap[eé]ndices
приложение
приложения
परिशिष्ट
ملحق
ملاحق
ap[eê]ndice
ap[eê]ndices
anhang
anh[aä]nge
appendici
""",
    "findings": r"""
findings?
results?
observations?
analysis
hallazgos
r[eé]sultats?
constatations?
выводы
результаты
наблюдения
निष्कर्ष
परिणाम
النتائج
الاستنتاجات
resultados
observa[çc][oõ]es
ergebnisse
beobachtungen
risultati
osservazioni
relevance
effectiveness
efficiency
impact
sustainability
coherence
pertinence
efficacit[eé]
efficience
durabilit[eé]
coh[eé]rence
""",
    "bibliography": r"""
bibliography
works\s+cited
references
bibliographie
r[eé]f[eé]rences
bibliograf[ií]a
referencias
библиография
ссылки
литература
ग्रंथ\s+सूची
संदर्भ
المراجع
قائمة\s+المراجع
refer[eê]ncias
referenzen
referenze
""",
    "annexes": r"""
annex(es)?
annexure(s)?
appendix
appendices
attachments?
annexe(s)?
appendice(s)?
termes\s+de\s+r[eé]f[eé]rence
tdr
anexo(s)?
ap[eé]ndice(s)?
adjuntos?
приложение
приложения
अनुलग्नक
ملحق
ملاحق
ap[eê]ndice(s)?
termos\s+de\s+refer[eê]ncia
anhang
anh[aä]nge
allegato(s)?
附录
附件
terms\s+of\s+reference
tor
anex
apend
""",
}
# fixed values: what makes a title an annex after all other rules
ANNEX_TITLE = r"annex(es)?|annexe(s)?|anexo(s)?|annexure(s)?|appendix|appendices|attachment(s)?"
# fixed values: the only labels on roman pages
ROMAN_LABELS = ("front_matter", "executive_summary", "acronyms")
_WORD = r"[\p{L}\p{N}_]"
_EDGE = rf"(?:(?<={_WORD})(?!{_WORD})|(?<!{_WORD})(?={_WORD}))"  # between a letter, digit or underscore and anything else


def phrases(label: str, edge: str = _EDGE) -> str:
    """One pattern for the phrases of a label; they stand between word edges, which are looked for once for all of them,
    but for anchored and Chinese ones."""
    every = [x for x in KEYWORDS[label].split("\n") if x]
    loose = [x for x in every if x.startswith(("^", "附"))]
    between = f"{edge}(?:{'|'.join(x for x in every if x not in loose)}){edge}"
    return "|".join([between, *loose])


def _names(title: Column, label: str) -> Column:
    return F.coalesce(title.rlike(f"(?iu){phrases(label)}"), F.lit(False))


# fixed values: labels that their parts inherit, the labels that may stand below one, and those that none follows an annex
LEVELS = 6
STRONG = ("executive_summary", "findings", "methodology", "recommendations", "introduction", "context", "annexes", "appendix", "bibliography", "acronyms")
OVERRIDES = {
    "findings": ("recommendations", "conclusions", "annexes", "appendix", "bibliography"),
    "recommendations": ("conclusions", "annexes", "appendix", "bibliography"),
    "conclusions": ("recommendations", "annexes", "appendix", "bibliography"),
}
BEFORE_ANNEX = ("front_matter", "executive_summary", "acronyms", "introduction", "context", "methodology", "findings", "recommendations", "conclusions")


def parse_toc(docs: DataFrame, col: str = "toc") -> DataFrame:
    """Rows of `[Hn] title | page p (roman) [Front]` lines; others are skipped, dotted leaders become a space."""
    pattern = r"^\s*\[H(\d)\]\s*(.*?)\s*(?:\|\s*page\s+(\d+|\?)\s*)?(?:\(([ivxlcdm]+)\)\s*)?(\[Front\])?\s*$"
    lines = docs.select("doc_id", F.posexplode(F.split(col, "\n")).alias("pos", "line")).where(F.col("line").rlike(pattern))
    part = lambda k: F.regexp_extract("line", pattern, k)
    title = F.trim(F.regexp_replace(part(2), r"\s*\.{3,}\s*", " "))
    idx = F.row_number().over(Window.partitionBy("doc_id").orderBy("pos")) - 1
    return lines.select("doc_id", idx.alias("idx"), part(1).cast("int").alias("level"), title.alias("title"), strings.normalize_title(title).alias("normalized_title"), part(3).try_cast("int").alias("page"), F.nullif(part(4), F.lit("")).alias("roman"), (part(5) != "").alias("fm"))


def render_toc(toc: DataFrame, label: str | None = None) -> DataFrame:
    """(doc_id, toc): one line per entry, with its label if asked."""
    middle = F.concat(F.lit(" | "), F.col(label)) if label else F.lit("")
    line = F.concat(F.lit("[H"), F.col("level").cast("string"), F.lit("] "), F.col("title"), middle, F.lit(" | page "), F.coalesce(F.col("page").cast("string"), F.lit("?")), F.when(F.col("fm"), " [Front]").otherwise(""))
    rows = F.array_sort(F.collect_list(F.struct("idx", line.alias("line"))))
    return toc.groupBy("doc_id").agg(F.array_join(F.transform(rows, lambda r: r["line"]), "\n").alias("toc"))


def lock_label(title: Column) -> Column:
    """The first label with a phrase in the title, else null; one chain of patterns."""
    t = strings.normalize_title(title)
    out = F.lit(None).cast("string")
    for label in reversed(KEYWORDS):
        out = F.when(_names(t, label), label).otherwise(out)
    return out


TITLES = 100_000  # different ones that are labelled apart and sent to every task


def _by_title(toc: DataFrame, made: dict[str, Column]) -> DataFrame:
    """With columns that follow from `title` alone. Where no more than TITLES differ, they are computed once a title."""
    titles = staged(toc.select("title").distinct().limit(TITLES + 1))
    if titles.count() > TITLES:
        return once(toc.withColumns(made), *made)
    known = titles.select(F.col("title").alias("__title"), *(c.alias(name) for name, c in made.items()))
    return toc.drop(*made).join(F.broadcast(known), F.col("title").eqNullSafe(F.col("__title")), "left").drop("__title")


def lock_labels(toc: DataFrame) -> DataFrame:
    """`label` by the title's phrases, `other` without any. Where no more than TITLES differ, each is labelled once."""
    return _by_title(toc, {"label": F.coalesce(lock_label(F.col("title")), F.lit("other"))})


def _title_rules() -> dict[str, Column]:
    """What the rules ask of titles, by the name of the column that holds it where it was computed before."""
    plain = F.lower(F.trim("title"))
    labels = ("executive_summary", "acronyms", "front_matter", *sorted({x for own in OVERRIDES.values() for x in own}))
    annex = F.coalesce(F.col("title").rlike(f"(?iu){_EDGE}(?:{ANNEX_TITLE}){_EDGE}"), F.lit(False))
    return {f"__is_{x}": _names(plain, x) for x in labels} | {"__front_annex": _names(strings.normalize_title(F.col("title")), "annexes"), "__annex": annex}


def _title(toc: DataFrame, name: str) -> Column:
    return F.col(name) if name in toc.columns else _title_rules()[name]


def parent_of(toc: DataFrame, levels: int = 6) -> DataFrame:
    """With the nearest earlier entry of a smaller level."""
    before = Window.partitionBy("doc_id").orderBy("idx").rowsBetween(Window.unboundedPreceding, -1)
    last = {k: F.max(F.when(F.col("level") == k, F.col("idx"))).over(before) for k in range(1, levels)}
    got = toc.withColumns({f"__l{k}": v for k, v in last.items()})
    parent = F.lit(None).cast("int")
    for k in range(1, levels):
        parent = F.greatest(parent, F.when(F.col("level") > k, F.col(f"__l{k}")))
    return got.withColumn("parent_idx", parent).drop(*(f"__l{k}" for k in last))


def _level_by_level(toc: DataFrame, first: Column, rule: Callable[[Column], Column], name: str) -> DataFrame:
    """Column `name`: `first` at the top level, below it rule(the parent's value), where the parent is the nearest earlier
    entry of a smaller level. A window a level, all over one sort."""
    before = Window.partitionBy("doc_id").orderBy("idx").rowsBetween(Window.unboundedPreceding, -1)
    level = F.least(F.col("level"), F.lit(LEVELS))
    got = toc.withColumn(name, F.when(level == 1, first))
    for k in range(2, LEVELS + 1):
        got = got.withColumn("__parent", F.last(F.when(level < k, F.col(name)), True).over(before))
        got = got.withColumn(name, F.when(level == k, rule(F.col("__parent"))).otherwise(F.col(name)))
    return got.drop("__parent")


def propagate_labels(toc: DataFrame) -> DataFrame:
    """(doc_id, idx, label, and the other columns): labels follow the parent's final label, always below strong sections,
    but for overrides that the title itself asks for; elsewhere `other` takes the parent's."""
    named = F.lit(False)
    for label in sorted({x for labels in OVERRIDES.values() for x in labels}):
        named = named | ((F.col("label") == label) & _title(toc, f"__is_{label}"))

    def rule(parent: Column) -> Column:
        may = F.lit(False)
        for p, labels in OVERRIDES.items():
            may = may | ((parent == p) & F.col("label").isin(*labels))
        strong = F.coalesce(parent.isin(*STRONG), F.lit(False))
        return F.when(strong, F.when(may & F.col("__named"), F.col("label")).otherwise(parent)).when((F.col("label") == "other") & parent.isNotNull(), parent).otherwise(F.col("label"))

    done = _level_by_level(toc.withColumn("__named", named), F.col("label"), rule, "__final")
    return done.withColumn("label", F.col("__final")).drop("__final", "__named")


def rule_short_doc(toc: DataFrame) -> DataFrame:
    """Documents of at most three pages are summaries throughout."""
    return toc.withColumn("label", F.when(F.col("total_pages").between(1, 3), "executive_summary").otherwise(F.col("label")))


def rule_front(toc: DataFrame) -> DataFrame:
    """Front matter only in the first third; an annex title there belongs to it."""
    late = F.col("page") > F.col("total_pages") / 3
    label = F.when(late & (F.col("label") == "front_matter"), "other").when(~late & _title(toc, "__front_annex"), "front_matter").otherwise(F.col("label"))
    return toc.withColumn("label", F.when(F.col("total_pages") > 0, label).otherwise(F.col("label")))


def rule_front_pages(toc: DataFrame) -> DataFrame:
    """In the end front matter must be marked as such, or be named so in the first third; else it is `other`."""
    early = (F.col("page") <= F.col("total_pages") / 3) & (F.col("total_pages") > 0) & _title(toc, "__is_front_matter")
    keeps = F.coalesce("fm", F.lit(False)) | F.coalesce(early, F.lit(False))
    return toc.withColumn("label", F.when((F.col("label") == "front_matter") & ~keeps, "other").otherwise(F.col("label")))


def _roman_pages(toc: DataFrame) -> DataFrame:
    """With the first and last page of entries marked as front matter, as __start and __end."""
    page, doc = F.when(F.col("fm") & (F.col("page") != 0), F.col("page")), Window.partitionBy("doc_id")
    return toc.withColumns({"__start": F.min(page).over(doc), "__end": F.max(page).over(doc)})


def rule_roman(toc: DataFrame) -> DataFrame:
    """Up to the last roman page only ROMAN_LABELS stand; anything else is front matter."""
    inside = (F.col("page") <= F.col("__end")) & ~F.col("label").isin(*ROMAN_LABELS)
    return _roman_pages(toc).withColumn("label", F.when(inside, "front_matter").otherwise(F.col("label"))).drop("__start", "__end")


def rule_roman_reset(toc: DataFrame) -> DataFrame:
    """After the last roman page, summaries are what stands below one or is named so, acronyms what is named so, and other
    ROMAN_LABELS become `other`. Documents without roman pages stay as they are."""
    after = F.coalesce(F.col("page") > F.col("__end"), F.lit(False))
    own = F.when(_title(toc, "__is_executive_summary"), "executive_summary").when(_title(toc, "__is_acronyms"), "acronyms").when(F.col("label").isin(*ROMAN_LABELS), "other").otherwise(F.col("label"))
    rule = lambda parent: F.when(~after, F.col("label")).when(parent == "executive_summary", parent).otherwise(own)
    done = _level_by_level(_roman_pages(toc), F.when(after, own).otherwise(F.col("label")), rule, "__final")
    return done.withColumn("label", F.col("__final")).drop("__final", "__start", "__end")


def rule_exec_dominance(toc: DataFrame) -> DataFrame:
    """From the first summary on roman pages on, entries on these pages are part of it, but for those named as front matter
    or acronyms."""
    inside = F.col("page").between(F.col("__start"), F.col("__end"))
    is_exec = (F.col("label") == "executive_summary") | _title(toc, "__is_executive_summary")
    first = F.min(F.when(inside & is_exec, F.col("idx"))).over(Window.partitionBy("doc_id"))
    found = _roman_pages(toc).withColumn("__first", first)
    block = F.when(_title(toc, "__is_front_matter"), "front_matter").when(_title(toc, "__is_acronyms"), "acronyms").otherwise("executive_summary")
    label = F.when(F.col("idx") == F.col("__first"), "executive_summary").when(inside & (F.col("idx") > F.col("__first")), block).otherwise(F.col("label"))
    return found.withColumn("label", label).drop("__first", "__start", "__end")


def rule_annex(toc: DataFrame) -> DataFrame:
    """Annex titles are annexes unless front matter; after the first annex the earlier kinds are too."""
    first = toc.withColumn("label", F.when(_title(toc, "__annex") & (F.col("label") != "front_matter"), "annexes").otherwise(F.col("label")))
    start = F.min(F.when(F.col("label") == "annexes", F.col("idx"))).over(Window.partitionBy("doc_id"))
    return first.withColumn("__start", start).withColumn("label", F.when((F.col("idx") > F.col("__start")) & F.col("label").isin(*BEFORE_ANNEX), "annexes").otherwise(F.col("label"))).drop("__start")


def rule_exec_unique(toc: DataFrame) -> DataFrame:
    """Only the first run of summary entries keeps its label."""
    w = Window.partitionBy("doc_id").orderBy("idx")
    is_exec = F.col("label") == "executive_summary"
    starts = F.when(is_exec & ~F.coalesce(F.lag(is_exec).over(w), F.lit(False)), 1).otherwise(0)
    return toc.withColumn("__s", starts).withColumn("__run", F.sum("__s").over(w)).withColumn("label", F.when(is_exec & (F.col("__run") > 1), "findings").otherwise(F.col("label"))).drop("__s", "__run")


def sequence_rules(toc: DataFrame) -> DataFrame:
    """The rules in their order; short documents stop at the first, so it is put over the others in the end. Needs label,
    title, page, fm and total_pages."""
    for rule in (rule_front, rule_roman, rule_roman_reset, rule_exec_dominance, rule_roman, rule_annex, rule_exec_unique, rule_front_pages):
        toc = rule(toc)
    return rule_short_doc(toc)


def label_sections(toc: DataFrame, model: str = "labeller") -> DataFrame:
    """Labels of contents from end to end: phrases, the model for titles without any, unknown labels as `other`, then
    inheritance and the sequence rules. Patterns and model read each different title once."""
    asked = _title_rules()
    locked = _by_title(toc, {"label": lock_label(F.col("title")), **asked})
    titles = models.apply(locked.where("label is null").select("title").distinct(), model, "title", "guess string")
    guess = F.when(F.col("guess").isin(*KEYWORDS), F.col("guess")).otherwise("other")
    guessed = staged(titles.select(F.col("title").alias("__title"), guess.alias("__guess")))
    few = F.broadcast(guessed) if guessed.limit(TITLES + 1).count() <= TITLES else guessed
    merged = locked.join(few, F.col("title").eqNullSafe(F.col("__title")), "left").withColumn("label", F.coalesce("label", "__guess")).drop("__title", "__guess")
    return sequence_rules(propagate_labels(merged)).drop(*asked)


def tag_sections(chunks: DataFrame, toc: DataFrame, model: str = "labeller") -> DataFrame:
    """(chunk_id, section): by the chunk's page if it has one and an entry starts at or before it, else by its headings,
    else `other`. `chunks` has chunk_id, doc_id, page_num and headings."""
    labels = staged(label_sections(toc, model).select("doc_id", "idx", "page", "title", "label"))
    by_page = asof_section(chunks.where("page_num is not null"), labels, None).select("chunk_id", F.col("section").alias("by_page"))
    by_heading = heading_section(chunks, labels, None).select("chunk_id", F.col("section").alias("by_heading"))
    found = chunks.select("chunk_id").join(by_page, "chunk_id", "left").join(by_heading, "chunk_id", "left")
    return found.select("chunk_id", F.coalesce("by_page", "by_heading", F.lit("other")).alias("section"))


def drop_majors(toc: DataFrame) -> DataFrame:
    """Without `n.` headings that jump past the last accepted number by more than one; a fold per document."""
    major = F.regexp_extract("title", r"^\s*(\d{1,3})\.\s", 1).try_cast("int")
    rows = F.array_sort(F.collect_list(F.struct("idx", major.alias("n"))))
    start = F.struct(F.lit(0).alias("last"), F.array().cast("array<int>").alias("kept"))

    def step(s: Column, e: Column) -> Column:
        ok = e["n"].isNull() | (e["n"] <= s["last"] + 1)
        return F.struct(F.when(e["n"].isNotNull() & ok, e["n"]).otherwise(s["last"]).alias("last"), F.when(ok, F.concat(s["kept"], F.array(e["idx"]))).otherwise(s["kept"]).alias("kept"))

    kept = toc.groupBy("doc_id").agg(F.aggregate(rows, start, step, lambda s: s["kept"]).alias("kept")).select("doc_id", F.explode("kept").alias("idx"))
    return toc.join(kept, ["doc_id", "idx"], "left_semi")


def toc_features(toc: DataFrame) -> DataFrame:
    n = F.count("*").over(Window.partitionBy("doc_id"))
    pages = F.max("page").over(Window.partitionBy("doc_id"))
    return toc.select("doc_id", "idx", F.round(F.coalesce(F.try_divide(F.col("idx"), n - 1), F.lit(0.0)), 6).alias("position"), F.round(F.coalesce(F.try_divide(F.col("page"), pages), F.lit(0.0)), 6).alias("page_norm"), F.round(F.col("level") / 6, 6).alias("level_norm"), F.col("page").isNotNull().alias("has_page"))


def asof_section(chunks: DataFrame, toc: DataFrame, missing: str | None = "other") -> DataFrame:
    """The label of the last entry at or before each chunk's page, ties to the larger idx: one ordered pass over both
    tables, instead of a range join that grows with the table of contents."""
    entries = toc.where("page is not null").select("doc_id", F.col("page").alias("p"), F.lit(0).alias("side"), "idx", "label", F.lit(None).cast("string").alias("chunk_id"))
    rows = chunks.select("doc_id", F.col("page_num").alias("p"), F.lit(1).alias("side"), F.lit(None).cast("int").alias("idx"), F.lit(None).cast("string").alias("label"), "chunk_id")
    w = Window.partitionBy("doc_id").orderBy("p", "side", "idx").rowsBetween(Window.unboundedPreceding, 0)
    return entries.unionByName(rows).withColumn("section", F.last("label", True).over(w)).where("side = 1").select("chunk_id", "doc_id", F.coalesce("section", F.lit(missing)).alias("section"))


def heading_section(chunks: DataFrame, toc: DataFrame, missing: str | None = "other") -> DataFrame:
    """The label of the last heading that matches a title; of several entries the best page at or before the chunk's,
    else the largest idx; `other` without a match."""
    heads = chunks.select("chunk_id", "doc_id", "page_num", F.posexplode("headings").alias("h", "heading"))
    j = heads.withColumn("t", strings.normalize_title(F.col("heading"))).join(toc.select("doc_id", F.lower("title").alias("t"), "page", "idx", "label"), ["doc_id", "t"])
    before = F.when(F.col("page") <= F.col("page_num"), F.col("page")).otherwise(-1)
    best = j.groupBy("chunk_id").agg(F.max_by("label", F.struct("h", before.alias("b"), "idx")).alias("section"))
    return chunks.select("chunk_id").join(best, "chunk_id", "left").select("chunk_id", F.coalesce("section", F.lit(missing)).alias("section"))


def choose_toc(toc: DataFrame) -> DataFrame:
    """Per document: entries, shares of figure or table titles and of unknown pages, and whether it is of low quality."""
    bad = F.lower("title").rlike(r"^(figure|table|box|graph)\b")
    agg = toc.groupBy("doc_id").agg(F.count("*").alias("entries"), F.round(F.avg(bad.cast("int")), 6).alias("figures"), F.round(F.avg(F.col("page").isNull().cast("int")), 6).alias("unknown"))
    low = (F.col("entries") < 5) | ((F.col("entries") >= 40) & ((F.col("figures") >= 0.2) | (F.col("unknown") >= 0.3)))
    return agg.withColumn("low_quality", low).withColumn("unusable", F.col("unknown") > 0.6)


def validate_toc(toc: DataFrame) -> DataFrame:
    """(doc_id, ok, reason): pages may not fall back by more than five, and most titles have four characters."""
    w = Window.partitionBy("doc_id").orderBy("idx")
    fall = F.coalesce(F.lag("page").over(w) - F.col("page") > 5, F.lit(False))
    agg = toc.withColumn("fall", fall).groupBy("doc_id").agg(F.bool_or("fall").alias("falls"), F.avg((F.length(F.trim("title")) >= 4).cast("int")).alias("named"), F.count("*").alias("n"))
    reason = F.when(F.col("n") < 2, "too short").when(F.col("falls"), "pages fall").when(F.col("named") < 0.6, "short titles")
    return agg.select("doc_id", reason.isNull().alias("ok"), F.coalesce(reason, F.lit("ok")).alias("reason"))


def infer_level(title: Column) -> Column:
    """From numbering (a single number of 50 or more ignored), figure-like names and known sections."""
    number = F.regexp_extract(title, r"^\s*(\d+(?:\.\d+)*)\.?\s", 1)
    dots = F.regexp_count(number, F.lit(r"\.")) + 1
    alone = (dots == 1) & (number.try_cast("int") >= 50)
    return F.when((number != "") & ~alone, F.least(dots, F.lit(6))).when(F.lower(title).rlike(r"^(eq|figure|table|box)\b.*\d"), 3).when(lock_label(title).isNotNull(), 1)


def restore_labels(old: DataFrame, new: DataFrame) -> DataFrame:
    """(doc_id, idx, label) from a classified table of contents, where it has as many entries and only known labels."""
    n = new.groupBy("doc_id").agg(F.count("*").alias("n"))
    o = old.groupBy("doc_id").agg(F.count("*").alias("m"), F.bool_and(F.col("label").isin(*KEYWORDS, "other")).alias("valid"))
    fits = n.join(o, "doc_id").where("n = m AND valid").select("doc_id")
    return old.join(fits, "doc_id", "left_semi").select("doc_id", "idx", "label")
