"""Ranking over many queries at once: dense, BM25 and hybrid retrieval, boosts and result shaping.

Hits are rows (query_id, doc_id or chunk_id, score, ord). The queries are the small side of every join; the corpus is
never broadcast. Scores are rounded to six digits so that ties do not hang on the order of a sum.
"""

from __future__ import annotations

from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_type
from pyspark.sql.types import DoubleType, StructField, StructType
from pyspark.sql.window import Window

from docspark.functions import models, vectors
from docspark.sources.shared import once, staged

QUERY_ROWS = 100_000  # queries sent to every task at most


def _few(queries: DataFrame) -> DataFrame:
    return F.broadcast(queries) if queries.limit(QUERY_ROWS + 1).count() <= QUERY_ROWS else queries


def top_k(scored: DataFrame, k: int, tie: str, key: str = "query_id") -> DataFrame:
    place = F.row_number().over(Window.partitionBy(key).orderBy(F.desc("score"), tie))
    return scored.withColumn("ord", place).where(F.col("ord") <= k)


METRICS = ("cosine", "dot", "euclid")


def _scores(x: np.ndarray, q: np.ndarray, metric: str) -> np.ndarray:
    dots = x @ q.T
    if metric == "dot":
        return dots
    a, b = (x * x).sum(1)[:, None], (q * q).sum(1)
    return dots / np.sqrt(a * b) if metric == "cosine" else -np.sqrt(np.maximum(a + b - 2 * dots, 0))


VECTORS, ASKING = 2048, 1024  # that one product of matrices takes
NONE = np.iinfo(np.int64).max  # stands where a query has found fewer


def _keep_best(best: np.ndarray, held: np.ndarray, score: np.ndarray, vec: np.ndarray) -> None:
    """Put what is better than the last of a query's `best` scores (`held`: of which vectors), a row a query, in its place.
    Of equal scores the smaller id is better."""
    k, n = best.shape[1], score.shape[1]
    last = best[:, -1:]
    better = (score > last) | ((score == last) & (vec < held[:, -1:]))
    if n > k and not np.isfinite(last).all():
        better &= score >= np.partition(score, n - k, axis=1)[:, n - k, None]
    row, col = np.nonzero(better)
    if not len(row):
        return
    some = np.unique(row)
    at = np.concatenate([np.repeat(some, k), row])
    both, ids = np.concatenate([best[some].ravel(), score[row, col]]), np.concatenate([held[some].ravel(), vec[col]])
    order = np.lexsort((ids, -both, at))
    at = at[order]
    order = order[np.arange(len(at)) - np.searchsorted(at, at) < k]
    best[some], held[some] = both[order].reshape(-1, k), ids[order].reshape(-1, k)


def dense_search(embeddings: DataFrame, queries: DataFrame, k: int, metric: str = "cosine") -> DataFrame:
    """The k nearest vectors of each query by cosine, dot product or (negative) Euclidean distance.

    Vectors meet the matrix of the queries, which is sent to every task up to QUERY_ROWS rows, in blocks of VECTORS by
    ASKING scores, and a task holds and gives its k best of a query alone. More queries are joined in blocks of as many."""
    n = queries.count()
    if n > QUERY_ROWS:
        parts = -(-n // QUERY_ROWS)
        turns = [queries.where(F.pmod(F.xxhash64("query_id"), F.lit(parts)) == i) for i in range(parts)]
        return reduce(DataFrame.unionByName, (dense_search(embeddings, t, k, metric) for t in turns))
    rows = queries.select("query_id", "qv").toArrow().combine_chunks()
    key = queries.schema["query_id"]
    kind, vec_kind = to_arrow_type(key.dataType), to_arrow_type(embeddings.schema["vec_id"].dataType)
    matrix = lambda col, n: col.flatten().to_numpy(zero_copy_only=False).astype(float).reshape(n, -1)
    asked = pa.concat_arrays([pa.array([], rows["qv"].type), *rows["qv"].chunks])
    sent = embeddings.sparkSession.sparkContext.broadcast((rows["query_id"].to_pylist(), matrix(asked, len(asked)) if len(asked) else None))

    def run(batches):
        ids, q = sent.value
        if not len(ids):
            return
        best, held = np.full((len(ids), k), -np.inf), np.full((len(ids), k), NONE)
        for batch in batches:
            if not len(batch):
                continue
            whole, vec = matrix(batch["embedding"], len(batch)), batch["vec_id"].to_numpy()
            for low in range(0, len(batch), VECTORS):
                x = whole[low : low + VECTORS]
                for at in range(0, len(ids), ASKING):
                    score = np.round(_scores(q[at : at + ASKING], x, metric), 6)
                    score[np.isnan(score)] = -np.inf
                    _keep_best(best[at : at + ASKING], held[at : at + ASKING], score, vec[low : low + VECTORS])
        for at in range(0, len(ids), ASKING):
            query, place = np.nonzero(held[at : at + ASKING] != NONE)
            score = best[at : at + ASKING][query, place]
            found = [pa.array([ids[at + j] for j in query.tolist()], kind), pa.array(held[at : at + ASKING][query, place]).cast(vec_kind), pa.array(np.where(np.isneginf(score), np.nan, score))]
            yield pa.RecordBatch.from_arrays(found, names=["query_id", "vec_id", "score"])

    schema = StructType([key, embeddings.schema["vec_id"], StructField("score", DoubleType())])
    return top_k(embeddings.select("vec_id", "embedding").mapInArrow(run, schema), k, "vec_id")


def more_like_this(embeddings: DataFrame, wanted: DataFrame, k: int) -> DataFrame:
    """The k vectors nearest to each of the wanted ones (vec_id), itself among them."""
    own = embeddings.join(wanted.select("vec_id").distinct(), "vec_id", "left_semi").select(F.col("vec_id").alias("query_id"), F.col("embedding").alias("qv"))
    return dense_search(embeddings, own, k)


def bm25_tokens(col: Column) -> Column:
    plain = F.regexp_replace(F.lower(col), r"[^\w\s]", "")
    return F.filter(F.split(plain, r"\s+"), lambda x: x != "")


def postings(chunks: DataFrame, id_col: str = "chunk_id") -> DataFrame:
    """(id, term, tf, len) of all chunks."""
    toks = chunks.select(F.col(id_col), bm25_tokens(F.col("text")).alias("tokens")).where(F.size("tokens") > 0)
    terms = toks.select(id_col, F.size("tokens").alias("len"), F.explode("tokens").alias("term"))
    return terms.groupBy(id_col, "term", "len").agg(F.count("*").alias("tf"))


def bm25_search(tokens: DataFrame, queries: DataFrame, k: int, id_col: str = "chunk_id", k1: float = 1.5, b: float = 0.75) -> DataFrame:
    """Scores over 0, best k per query; a term that stands twice in a query counts twice.

    tokens: the id and its `tokens`. Texts are read once: of each one its length and the queries' terms that it holds are
    staged, and counts of documents and terms are made from these."""
    terms = queries.select("query_id", F.explode(bm25_tokens(F.col("query"))).alias("term")).groupBy("query_id", "term").agg(F.count("*").alias("times"))
    known = terms.select("term").distinct()
    few = known.limit(QUERY_ROWS + 1).count() <= QUERY_ROWS
    sent = lambda df: F.broadcast(df) if few else df  # noqa: E731  a row a term at most
    own = F.concat(F.array(F.lit(None).cast("string")), F.col("tokens"))  # a text's own row has no term
    read = once(tokens.select(id_col, "tokens"), "tokens").where(F.size("tokens") > 0).select(id_col, F.size("tokens").alias("len"), F.explode(own).alias("term"))
    asked = read.join(sent(known.withColumn("asked", F.lit(True))), "term", "left").where("asked OR term IS NULL")
    counted = staged(asked.groupBy(id_col, "len", "term").agg(F.count("*").alias("tf")))
    sizes = counted.where("term IS NULL").agg(F.sum("tf").alias("docs"), (F.sum(F.col("len") * F.col("tf")) / F.sum("tf")).alias("avg_len"))
    kept = counted.where("term IS NOT NULL")
    df = kept.groupBy("term").agg(F.count("*").alias("df"))
    hit = kept.join(sent(df), "term").join(_few(terms), "term").join(F.broadcast(sizes))  # the last is one row
    idf = F.ln((F.col("docs") - F.col("df") + 0.5) / (F.col("df") + 0.5) + 1)
    part = idf * F.col("tf") * (k1 + 1) / (F.col("tf") + k1 * (1 - b + b * F.col("len") / F.col("avg_len"))) * F.col("times")
    return top_k(hit.groupBy("query_id", id_col).agg(F.round(F.sum(part), 6).alias("score")).where("score > 0"), k, id_col)


def hybrid(embeddings: DataFrame, tokens: DataFrame, queries: DataFrame, weight: float, k: int, fetch: int, id_col: str = "doc_id") -> DataFrame:
    """Dense and BM25 lists of `fetch` hits each, fused. `queries` has query_id, qv and query; `embeddings` has the id as
    vec_id; a weight of 1 or 0 asks one side alone."""
    dense = dense_search(embeddings, queries, fetch).withColumnRenamed("vec_id", id_col).withColumn(id_col, F.col(id_col).cast("string"))
    sparse = bm25_search(tokens, queries, fetch, id_col)
    if weight in (0.0, 1.0):
        return (dense if weight else sparse).where(F.col("ord") <= k)
    return hybrid_search(dense, sparse, weight, k, id_col)


def hybrid_search(dense: DataFrame, sparse: DataFrame, weight: float, k: int, id_col: str = "doc_id") -> DataFrame:
    """Reciprocal rank fusion of two ranked lists; ties keep the dense order first."""
    a = dense.select("query_id", id_col, F.col("ord").alias("dense_ord"))
    b = sparse.select("query_id", id_col, F.col("ord").alias("sparse_ord"))
    j = a.join(b, ["query_id", id_col], "full_outer")
    part = lambda w, c: F.coalesce(F.lit(w) / (F.col(c) + 60), F.lit(0.0))
    j = j.withColumn("score", F.round(part(weight, "dense_ord") + part(1 - weight, "sparse_ord"), 9))
    place = F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("score"), F.asc_nulls_last("dense_ord"), "sparse_ord"))
    return j.withColumn("ord", place).where(F.col("ord") <= k).select("query_id", id_col, "score", "ord")


def resolve_weight(query: Column, weight: Column, boost_short: bool = True) -> Column:
    """1 or 0 near the ends; a quarter for queries of one or two words."""
    words = F.size(F.filter(F.split(F.trim(query), r"\s+"), lambda x: x != ""))
    return F.when(weight >= 0.99, 1.0).when(weight <= 0.01, 0.0).when(F.lit(boost_short) & (words <= 2), 0.25).otherwise(weight)


def fetch_limit(limit: int, min_chars: int, constant: int | None = 50) -> int:
    """How many hits to fetch: the configured number, else twice the limit when hits are filtered by size."""
    return constant or limit * (2 if min_chars > 0 else 1)


def rerank(hits: DataFrame, scored: DataFrame, m: int, k: int, id_col: str) -> DataFrame:
    """The first m by a new score, the rest after them in their order."""
    j = hits.join(scored.withColumnRenamed("score", "new_score"), ["query_id", id_col], "left")
    first = (F.col("ord") <= m) & F.col("new_score").isNotNull()
    place = F.row_number().over(Window.partitionBy("query_id").orderBy(F.when(first, 0).otherwise(1), F.desc(F.when(first, F.col("new_score"))), "ord"))
    return j.withColumn("ord", place).where(F.col("ord") <= k)


def score_hits(hits: DataFrame, queries: DataFrame, m: int, model: str, id_col: str) -> DataFrame:
    """(query_id, id, score) of the first m hits of each query, by a model that reads pairs of query and text."""
    asked = hits.where(F.col("ord") <= m).join(_few(queries.select("query_id", "query")), "query_id").select("query_id", id_col, F.struct("query", "text").alias("pair"))
    return models.apply(asked, model, "pair", "score double").drop("pair")


def post_search(hits: DataFrame, queries: DataFrame, sections: list[str] | None = None, min_chars: int = 0, scorer: str | None = None, rerank_first: int = 0, recency: tuple[float, float, str] | None = None, limit: int = 50, boost: tuple[str, DataFrame, float] | None = None, auto_min: bool = False, deduplicate: bool = False, id_col: str = "chunk_id") -> DataFrame:
    """Hits (query_id, id, score, ord, text, year, ...) through what follows a search, in its order: sections, size,
    re-ranking, recency, limit, field boost, least score, duplicates; `ord` is the place in the end."""
    w = Window.partitionBy("query_id")
    again = lambda df, *order: df.withColumn("ord", F.row_number().over(w.orderBy(*order)))
    if sections:
        hits = again(hits.where(F.col("section").isin(*sections)), "ord")
    if min_chars:
        hits = again(hits.where(F.length(F.trim("text")) >= min_chars), "ord")
    if scorer:
        m = rerank_first or 1 << 30
        ranked = rerank(hits, score_hits(hits, queries, m, scorer, id_col), m, limit, id_col)
        hits = ranked.withColumn("score", F.coalesce("new_score", "score")).drop("new_score")
    if recency:
        hits = again(recency_boost(hits, *recency, year="year"), F.desc("score"), "ord")
    hits = hits.where(F.col("ord") <= limit)
    if boost:
        field, known, weight = boost
        hits = again(field_boost(hits, known, queries, field, weight), F.desc("score"), "ord")
    if auto_min:
        hits = auto_min_score(hits)
    if deduplicate:
        hits = again(dedupe_results(hits), "place").drop("place")
    return hits


def recency_boost(hits: DataFrame, weight: float, scale_days: float, today: str, year: str = "map_published_year") -> DataFrame:
    """A Gaussian of the age from the year's end is mixed in; half of it without a year."""
    end = F.make_date(F.col(year).try_cast("int"), F.lit(12), F.lit(31))
    age = F.greatest(F.datediff(F.lit(today).cast("date"), end), F.lit(0)).cast("double")
    factor = F.coalesce(F.exp(F.lit(-0.5) * F.pow(age / scale_days, F.lit(2))), F.lit(0.5))
    return hits.withColumn("original_score", F.col("score")).withColumn("score", F.round(F.col("score") * (1 - weight) + factor * weight, 9))


def field_boost(hits: DataFrame, known: DataFrame, queries: DataFrame, field: str, weight: float) -> DataFrame:
    """Scores rise by the weight where the hit's field has a value that the query names; a weight of 1 drops the rest.

    Values of three characters or more are found as whole words. A negative score moves up by as much."""
    named = queries.join(_few(known.where(F.length("value") >= 3)), F.expr(r"lower(query) rlike concat('(^|[^a-z0-9])', lower(value), '($|[^a-z0-9])')")).select("query_id", "value")
    found = named.groupBy("query_id").agg(F.collect_set(F.lower("value")).alias("named"))
    j = hits.join(_few(found), "query_id", "left")
    match = F.arrays_overlap(F.transform(F.split(F.col(field), ","), lambda x: F.lower(F.trim(x))), "named")
    if weight >= 1:
        return j.where(F.col("named").isNull() | F.coalesce(match, F.lit(False))).drop("named")
    m = F.when(F.coalesce(match, F.lit(False)), 1 + weight).otherwise(1.0)
    up = F.when(F.col("score") < 0, F.col("score") + F.abs("score") * (m - 1)).otherwise(F.col("score") * m)
    return j.withColumn("score", F.round(up, 9)).drop("named")


def dedupe_results(hits: DataFrame, text: str = "text", year: str = "year") -> DataFrame:
    """Of hits with equal trimmed text: the higher year, then score, then the first, at the place of the first."""
    w = Window.partitionBy("query_id", F.trim(text))
    turn = F.row_number().over(w.orderBy(F.desc(F.coalesce(F.col(year).try_cast("int"), F.lit(0))), F.desc("score"), "ord"))
    return hits.withColumn("turn", turn).withColumn("place", F.min("ord").over(w)).where("turn = 1").drop("turn")


def auto_min_score(hits: DataFrame) -> DataFrame:
    """Per query, hits at or over the score at index int(0.3 n) of the ascending ones."""
    w = Window.partitionBy("query_id")
    ranked = hits.withColumn("n", F.count("*").over(w)).withColumn("i", F.row_number().over(w.orderBy("score", F.desc("ord"))) - 1)
    least = F.max(F.when(F.col("i") == F.floor(F.col("n") * 0.3), F.col("score"))).over(w)
    return ranked.withColumn("least", least).where("score >= least").drop("n", "i", "least")


def title_search(docs: DataFrame, queries: DataFrame, k: int) -> DataFrame:
    """Titles that hold all distinct word tokens of a query, by how many they hold."""
    toks = queries.select("query_id", F.array_distinct(F.regexp_extract_all(F.lower("query"), F.lit("[a-z0-9]+"), F.lit(0))).alias("tokens"))
    j = docs.select("doc_id", F.lower("map_title").alias("t")).join(_few(toks), F.expr("size(tokens) > 0 AND forall(tokens, x -> contains(t, x))"))
    return top_k(j.select("query_id", "doc_id", F.size("tokens").alias("score")), k, "doc_id")


def enrich_hits(hits: DataFrame, docs: DataFrame, chunks: DataFrame, limit: int) -> DataFrame:
    """Hits with their documents (none, dropped) and chunks (none, page 0), the first `limit` of each query."""
    j = hits.join(docs, "doc_id").join(chunks.select("chunk_id", "page_num"), "chunk_id", "left").withColumn("page_num", F.coalesce("page_num", F.lit(0)))
    place = F.row_number().over(Window.partitionBy("query_id").orderBy("ord"))
    return j.withColumn("place", place).where(F.col("place") <= limit)


def denormalize(chunks: DataFrame, docs: DataFrame) -> DataFrame:
    return chunks.join(docs, "doc_id")


def citation_index(hits: DataFrame) -> DataFrame:
    """Numbers by first appearance over all queries, in (query, order): positions are found per bucket of first places,
    so no task orders every row."""
    first = hits.groupBy("doc_id").agg(F.min(F.struct("query_id", "ord")).alias("first"))
    sizes = first.groupBy("first.query_id").agg(F.count("*").alias("n"))
    before = sizes.withColumn("base", F.coalesce(F.sum("n").over(Window.orderBy("query_id").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)))  # a row per query
    own = F.row_number().over(Window.partitionBy("first.query_id").orderBy("first.ord"))
    return first.withColumn("own", own).withColumn("query_id", F.col("first.query_id")).join(before, "query_id").select("doc_id", (F.col("base") + F.col("own")).alias("number"))


def answer_context(hits: DataFrame, n: int = 20) -> DataFrame:
    """One numbered prompt per query of its first n hits."""
    lines = hits.where(F.col("ord") <= n).select("query_id", "ord", F.concat(F.lit("["), F.col("ord").cast("string"), F.lit("] "), "text").alias("line"))
    return lines.groupBy("query_id").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("ord", "line"))), lambda x: x["line"]), "\n").alias("context"))


def class_centroids(df: DataFrame) -> DataFrame:
    """Mean of the unit vectors of each class, made a unit vector again: (label, pos, x)."""
    unit = df.select("label", F.posexplode(vectors.l2_normalize(F.col("embedding"))).alias("pos", "x"))
    mean = unit.groupBy("label", "pos").agg(F.avg("x").alias("x"))
    size = mean.groupBy("label").agg(F.greatest(F.sqrt(F.sum(F.col("x") * F.col("x"))), F.lit(vectors.TINY)).alias("size"))
    return mean.join(size, "label").select("label", "pos", (F.col("x") / F.col("size")).alias("x"))


def predict_centroid(df: DataFrame, centroids: DataFrame) -> DataFrame:
    """The class with the largest dot product, ties to the smaller label; classes are few."""
    vec = centroids.groupBy("label").agg(F.transform(F.array_sort(F.collect_list(F.struct("pos", "x"))), lambda s: s["x"]).alias("c")).withColumnRenamed("label", "predicted")
    scored = df.select("vec_id", "label", "embedding").join(_few(vec)).select("vec_id", "label", "predicted", F.round(vectors.dot(F.col("embedding"), F.col("c")), 6).alias("score"))
    best = scored.groupBy("vec_id", "label").agg(F.max(F.struct("score", (-F.col("predicted")).alias("p"))).alias("b"))
    return best.select("vec_id", "label", (-F.col("b.p")).alias("predicted"), F.col("b.score").alias("score"))


def batch_research(runs: DataFrame, hits: DataFrame, queries: int = 4, fetch: int = 20, cards: int = 10, id_col: str = "vec_id") -> DataFrame:
    """(run_id, query_id, n_hits, cards): what each query of a run found, for all runs in one plan.

    runs: run_id, query_id, turn; only the first `queries` of a run count. hits: query_id, id, score, ord, of which `fetch` a
    query count. A card is (number, id, score), at most `cards` a query, best first; numbers are those of the run's list of
    different results, by the query and the place where each came first. A query without hits has none and no cards."""
    turn = F.row_number().over(Window.partitionBy("run_id").orderBy("turn", "query_id"))
    asked = runs.select("run_id", "query_id", "turn").withColumn("turn", turn).where(F.col("turn") <= queries)
    found = asked.join(hits.where(F.col("ord") <= fetch).select("query_id", id_col, "score", "ord"), "query_id")
    first = found.groupBy("run_id", id_col).agg(F.min(F.struct("turn", "ord")).alias("first"))
    number = F.row_number().over(Window.partitionBy("run_id").orderBy("first"))  # at most queries * fetch rows
    numbered = found.join(first.select("run_id", id_col, number.alias("number")), ["run_id", id_col])
    card = F.struct("ord", "number", F.col(id_col), "score")
    listed = numbered.groupBy("run_id", "query_id").agg(F.count("*").alias("n_hits"), F.array_sort(F.collect_list(F.when(F.col("ord") <= cards, card))).alias("cards"))
    rows = asked.join(listed, ["run_id", "query_id"], "left")
    plain = F.transform(F.coalesce("cards", F.array().cast(listed.schema["cards"].dataType)), lambda c: F.struct(c["number"].alias("number"), c[id_col].alias(id_col), c["score"].alias("score")))
    return rows.select("run_id", "query_id", F.coalesce("n_hits", F.lit(0)).alias("n_hits"), plain.alias("cards"))
