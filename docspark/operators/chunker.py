"""Chunks of documents from their blocks: packed up to a token budget, never across headings.

`chunk_blocks` is a plan of windows and one fold over the blocks below a heading; `chunk_document` is the same rule as a
table function for a document's array of blocks, in plain Python, for a lateral join. Blocks are (doc_id, pos, text, label,
level, page_num, box): a `section_header` has a level from 1 to LEVELS, any other label is content.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.functions import udtf
from pyspark.sql.window import Window

from docspark.operators.chunks import KEPT_ITEMS

HEADER = "section_header"
LEVELS = 6
SMALLEST = 100  # characters of a chunk without items that are kept at any size
CHUNK = "chunk int, headings array<string>, text string, tokens int, page_num int, item_types array<string>, boxes array<string>"


def headings_above(blocks: DataFrame) -> DataFrame:
    """`blocks` with `headings`: of each level the last header so far, if no header of a lower number came after it."""
    before = Window.partitionBy("doc_id").orderBy("pos").rowsBetween(Window.unboundedPreceding, 0)
    is_header = F.col("label") == HEADER
    last = [F.last(F.when(is_header & (F.col("level") == k), F.struct("pos", "text")), True).over(before) for k in range(1, LEVELS + 1)]
    rows = blocks.withColumns({f"__h{k}": h for k, h in enumerate(last, 1)})
    for k in range(1, LEVELS + 1):
        above = F.array_max(F.array(F.lit(-1), *[F.coalesce(F.col(f"__h{j}.pos"), F.lit(-1)) for j in range(1, k)]))
        rows = rows.withColumn(f"__t{k}", F.when(F.col(f"__h{k}.pos") > above, F.col(f"__h{k}.text")))
    path = F.filter(F.array(*[F.col(f"__t{k}") for k in range(1, LEVELS + 1)]), lambda t: t.isNotNull())
    return rows.withColumn("headings", path).drop(*[f"__{x}{k}" for x in "ht" for k in range(1, LEVELS + 1)])


def _pieces(text: Column, most: int) -> Column:
    """array<struct<piece, n>>: the text and its number of tokens, in parts of `most` where it has more."""
    words = F.split(F.trim(text), r"\s+")
    starts = F.sequence(F.lit(0), F.ceil(F.size(words) / most).cast("int") - 1)
    cut = F.transform(starts, lambda i: F.slice(words, i * most + 1, most))
    many = F.transform(cut, lambda w: F.struct(F.array_join(w, " ").alias("piece"), F.size(w).alias("n")))
    return F.when(F.size(words) > most, many).otherwise(F.array(F.struct(text.alias("piece"), F.size(words).alias("n"))))


def chunk_blocks(blocks: DataFrame, max_tokens: int, smallest: int = SMALLEST) -> DataFrame:
    """(doc_id, chunk, headings, text, tokens, page_num, item_types, boxes): consecutive blocks with equal headings, as many as
    have `max_tokens` tokens together, their texts parted by blank lines.

    A block with more is cut, and its last part is packed with what follows. Headers give no text of their own. page_num is
    the smallest, item_types are the distinct labels in order, boxes those of the blocks, without nulls and repeats in a row.
    Chunks of fewer than `smallest` characters go, unless they hold list items, captions or the like; those that stay are
    numbered. Blank blocks are left out, and documents without others have no row."""
    doc = Window.partitionBy("doc_id").orderBy("pos")
    content = headings_above(blocks).where((F.col("label") != HEADER) & (F.trim(F.coalesce("text", F.lit(""))) != ""))
    new = F.when(F.col("headings").eqNullSafe(F.lag("headings").over(doc)), 0).otherwise(1)
    runs = content.withColumn("__new", new).withColumn("run", F.sum("__new").over(doc)).drop("__new")
    pieces = runs.select("doc_id", "run", "headings", "pos", "label", "page_num", "box", F.posexplode(_pieces(F.col("text"), max_tokens)).alias("part", "p")).select("*", "p.piece", "p.n").drop("p")
    one = F.struct("pos", "part", "piece", "n", "label", "page_num", "box")
    per_run = pieces.groupBy("doc_id", "run", "headings").agg(F.array_sort(F.collect_list(one)).alias("rows"))  # what stands below one heading
    start = F.struct(F.array().cast("array<int>").alias("ids"), F.lit(0).alias("id"), F.lit(0).alias("used"))

    def add(s: Column, n: Column) -> Column:
        full = (s["used"] > 0) & (s["used"] + n > max_tokens)
        id_ = F.when(full, s["id"] + 1).otherwise(s["id"])
        return F.struct(F.concat(s["ids"], F.array(id_)).alias("ids"), id_.alias("id"), F.when(full, n).otherwise(s["used"] + n).alias("used"))

    ids = F.aggregate(F.transform("rows", lambda r: r["n"]), start, add, lambda s: s["ids"])
    dealt = per_run.withColumn("ids", ids).select("doc_id", "run", "headings", F.inline(F.arrays_zip("rows", "ids"))).select("doc_id", "run", "headings", F.col("ids").alias("id"), "rows.*")
    made = dealt.groupBy("doc_id", "run", "headings", "id").agg(F.array_sort(F.collect_list(one)).alias("rows"))
    boxes = F.filter(F.transform("rows", lambda r: F.when(r["part"] == F.element_at(F.filter("rows", lambda x: x["pos"] == r["pos"]), 1)["part"], r["box"])), lambda b: b.isNotNull())
    made = made.select(
        "doc_id", "run", "id", "headings", F.array_join(F.transform("rows", lambda r: r["piece"]), "\n\n").alias("text"),
        F.aggregate("rows", F.lit(0), lambda s, r: s + r["n"]).alias("tokens"), F.array_min(F.transform("rows", lambda r: r["page_num"])).alias("page_num"),
        F.array_sort(F.array_distinct(F.transform("rows", lambda r: r["label"]))).alias("item_types"), boxes.alias("boxes"),
    )
    kept = made.where((F.length(F.trim("text")) >= smallest) | F.arrays_overlap("item_types", F.array(*map(F.lit, KEPT_ITEMS))))
    number = F.row_number().over(Window.partitionBy("doc_id").orderBy("run", "id")) - 1
    return kept.select("doc_id", number.alias("chunk"), "headings", "text", "tokens", "page_num", "item_types", "boxes")


@udtf(returnType=CHUNK)
class ChunkDocument:
    """chunk_document(blocks, max_tokens, smallest): the chunks of one document, whose blocks may be in any order."""

    def eval(self, blocks: list, max_tokens: int, smallest: int):
        path: dict[int, str] = {}
        groups: list[dict] = []
        for b in sorted(blocks or [], key=lambda b: b["pos"]):
            if b["label"] == HEADER:
                path = {k: t for k, t in path.items() if k < b["level"]} | {b["level"]: b["text"]}
                continue
            words = (b["text"] or "").split()
            headings = [path[k] for k in sorted(path)]
            for a in range(0, len(words), max_tokens):
                some = words[a : a + max_tokens]
                g = groups[-1] if groups else None
                if g is None or g["headings"] != headings or g["tokens"] + len(some) > max_tokens:
                    g = {"headings": headings, "texts": [], "tokens": 0, "pages": [], "labels": set(), "boxes": {}}
                    groups.append(g)
                g["texts"].append(b["text"] if len(words) <= max_tokens else " ".join(some))
                g["tokens"] += len(some)
                g["pages"].append(b["page_num"])
                g["labels"].add(b["label"])
                g["boxes"][b["pos"]] = b["box"]
        number = 0
        for g in groups:
            text = "\n\n".join(g["texts"])
            if len(text.strip(" ")) >= smallest or g["labels"] & set(KEPT_ITEMS):
                yield number, g["headings"], text, g["tokens"], min((p for p in g["pages"] if p is not None), default=None), sorted(g["labels"]), [x for x in g["boxes"].values() if x is not None]
                number += 1


def register(spark: SparkSession) -> None:
    """Make `chunk_document` known to SQL."""
    spark.udtf.register("chunk_document", ChunkDocument)


def chunk_documents(docs: DataFrame, max_tokens: int, smallest: int = SMALLEST) -> DataFrame:
    """The rows of `chunk_blocks`, by the table function: docs are (doc_id, blocks), an array of structs each."""
    register(docs.sparkSession)
    return docs.sparkSession.sql(f"SELECT d.doc_id, c.* FROM {{docs}} d, LATERAL chunk_document(d.blocks, {int(max_tokens)}, {int(smallest)}) c", docs=docs)
