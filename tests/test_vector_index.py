"""The stored index against brute force."""

from __future__ import annotations

import numpy as np
import pytest
from pyspark.sql import functions as F

from docspark.operators import search, vector_index
from docspark.sources.shared import fingerprint


def asked(e):
    return e.where("vec_id % 50 = 0").select(F.col("vec_id").alias("query_id"), F.col("embedding").alias("qv"))


def recall(found, exact):
    return found.join(exact, ["query_id", "vec_id"], "left_semi").count() / exact.count()


@pytest.mark.parametrize(("sf", "most"), [("sf0.001", 0.4), ("sf0.1", 0.04)])
def test_recall_on_vectors_without_structure(spark, tmp_path, sf, most):
    """At 10, with four fifths of the lists' codes and few exact vectors."""
    e = spark.read.parquet(f"/root/testdata/{sf}/embeddings.parquet")
    index = vector_index.build(e, str(tmp_path / "index"))
    n, q = e.count(), asked(e)
    found, exact = index.search(e, q, 10).cache(), search.dense_search(e, q, 10)
    assert recall(found.select("query_id", "vec_id"), exact.select("query_id", "vec_id")) >= 0.9
    assert found.join(exact, ["query_id", "vec_id"]).where(found["score"] != exact["score"]).count() == 0
    assert index.candidates(q, 80).groupBy("query_id").count().agg(F.max("count")).first()[0] <= max(most * n, 80)


def test_a_tenth_is_read_where_there_is_structure(spark, tmp_path):
    rng = np.random.default_rng(5)
    x = rng.normal(size=(60, 32))[np.arange(3000) % 60] + 0.25 * rng.normal(size=(3000, 32))
    e = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "vec_id long, embedding array<double>")
    index = vector_index.build(e, str(tmp_path / "index"), lists=40)
    q = asked(e)
    found = index.search(e, q, 10, probes=3)
    assert recall(found.select("query_id", "vec_id"), search.dense_search(e, q, 10).select("query_id", "vec_id")) >= 0.9
    sizes = [r["count"] for r in index.codes.groupBy("list").count().collect()]
    assert sum(sorted(sizes)[-3:]) < 0.25 * 3000 and sum(sizes) == 3000 and 3 * np.mean(sizes) <= 300


def test_an_index_is_made_once_for_each_state(spark, tmp_path):
    e = spark.read.parquet("/root/testdata/sf0.001/embeddings.parquet")
    path = str(tmp_path / fingerprint(e))
    first = vector_index.built(e, path)
    assert vector_index.built(e.limit(0), path).codes.count() == first.codes.count() == e.count()
    assert fingerprint(e) == fingerprint(spark.read.parquet("/root/testdata/sf0.001/embeddings.parquet")) != fingerprint(spark.read.parquet("/root/testdata/sf0.01/embeddings.parquet"))


def test_codes_are_close_and_odd_rows_harmless(spark, tmp_path):
    x = np.random.default_rng(1).normal(size=(50, 7))
    x /= np.sqrt((x * x).sum(1))[:, None]
    assert np.abs(vector_index.decoded(vector_index.encoded(x), 7) - np.clip(x, -2.5 / 7**0.5, 2.5 / 7**0.5)).max() < 0.07
    e = spark.createDataFrame([(1, [1.0, 0.0]), (2, [0.0, 0.0]), (3, None), (None, [1.0, 1.0]), (4, []), (5, [1.0, 0.1])], "vec_id long, embedding array<double>")
    q = spark.createDataFrame([("a", [1.0, 0.0]), ("b", [0.0, 0.0])], "query_id string, qv array<double>")
    got = vector_index.build(e, str(tmp_path / "odd")).search(e, q, 2, probes=9).collect()
    assert [r.vec_id for r in sorted(got, key=lambda r: r.ord) if r.query_id == "a"] == [1, 5] and {r.score for r in got if r.query_id == "b"} == {0.0}
    none = vector_index.build(e.limit(0), str(tmp_path / "none"))
    assert none.search(e.limit(0), q, 2).count() == 0
    assert none.search(e, q.limit(0), 2).count() == 0


def test_runs_of_queries_share_their_numbers(spark):
    hits = [(q, d, 1.0 - o / 100, o) for q, found in {1: "abc", 2: "cda", 3: "x", 5: "zz"}.items() for o, d in enumerate(found, 1)]
    h = spark.createDataFrame(hits, "query_id int, vec_id string, score double, ord int")
    runs = spark.createDataFrame([("r", 2, 1), ("r", 1, 0), ("r", 4, 2), ("s", 3, 0), ("r", 5, 9), ("r", 6, 3)], "run_id string, query_id int, turn int")
    got = {(r.run_id, r.query_id): r for r in search.batch_research(runs, h, fetch=3, cards=2).collect()}
    cards = lambda k: [(c.number, c.vec_id) for c in got[k].cards]
    assert set(got) == {("r", 1), ("r", 2), ("r", 4), ("r", 6), ("s", 3)}
    assert cards(("r", 1)) == [(1, "a"), (2, "b")] and cards(("r", 2)) == [(3, "c"), (4, "d")] and cards(("s", 3)) == [(1, "x")]
    assert (got["r", 2].n_hits, got["r", 4].n_hits, cards(("r", 4))) == (3, 0, [])


def test_blocks_keep_the_best_of_all():
    """Blocks in any order give what a sort of all gives, with ties, fewer vectors than asked for and infinite scores."""
    rng = np.random.default_rng(3)
    for n in (3, 40, 400):
        score = rng.integers(-3, 4, (7, n)).astype(float)
        score[rng.random((7, n)) < 0.1] = -np.inf
        vec = rng.permutation(n)
        best, held = np.full((7, 5), -np.inf), np.full((7, 5), search.NONE)
        for at in range(0, n, 16):
            search._keep_best(best, held, score[:, at : at + 16], vec[at : at + 16])
        order = [sorted(zip(-s, vec, strict=True))[:5] for s in score]
        assert [[v for v in h if v != search.NONE] for h in held.tolist()] == [[int(v) for _, v in o] for o in order]


def test_scores_are_made_in_blocks(spark, monkeypatch):
    """No matrix is larger than a block, whatever the numbers of vectors and queries; results are those of all at once."""
    e = spark.read.parquet("/root/testdata/sf0.1/embeddings.parquet").coalesce(1)
    q = e.where("vec_id % 5 = 0").select(F.col("vec_id").alias("query_id"), F.col("embedding").alias("qv"))
    whole = sorted(map(tuple, search.dense_search(e, q, 7).collect()))
    monkeypatch.setattr(search, "VECTORS", 96)
    monkeypatch.setattr(search, "ASKING", 64)
    scores = search._scores

    def bounded(x, y, metric):
        assert x.shape[0] * y.shape[0] <= 96 * 64
        return scores(x, y, metric)

    monkeypatch.setattr(search, "_scores", bounded)
    assert sorted(map(tuple, search.dense_search(e, q, 7).collect())) == whole and len(whole) == 7 * 400
