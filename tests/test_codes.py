"""Product-quantised codes: bounds hold, the exact search is exact, the approximate one finds nearly all."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from vecfold.operators import codes
from vecfold.operators.search import BadRequest, search_rows
from vecfold.schemas import Metric

ROW = "collection_id long, embedding_id string, embedding array<float>, authz string, metadata string"
ALLOWED = ["a", "b"]


def vectors(n, seed=1, clusters=40, dimensions=16):
    rng = np.random.default_rng(seed)
    middles = np.random.default_rng(0).normal(size=(clusters, dimensions)) * 2
    return (middles[rng.integers(0, clusters, n)] + rng.normal(scale=0.5, size=(n, dimensions))).astype(np.float32)


def table(spark, matrix):
    rows = [(1, f"e{i:06d}", v.tolist(), "abc"[i % 3], f'{{"half":"{i % 2}"}}') for i, v in enumerate(matrix)]
    return spark.createDataFrame(rows, ROW).repartition(4, "embedding_id")


def plain(rows, query, **options):
    return found(search_rows(rows, query, allowed=ALLOWED, metric=Metric.l2_distance, **options))


def found(hits):
    return [(r.embedding_id, round(r.value, 9)) for r in hits.collect()]


@pytest.fixture(scope="module")
def built(spark, tmp_path_factory):
    rows = table(spark, np.concatenate([vectors(6000), vectors(3, seed=5).repeat(20, axis=0)]))
    return rows, codes.build_codes(rows, 4, str(tmp_path_factory.mktemp("codes") / "table"), codes=64)


def test_the_bounds_hold(spark, built):
    _, index = built
    query = vectors(1, seed=3)[0].astype(float).tolist()
    rows = index.rows(spark).select("embedding", "code", "error", codes.estimate_to(index.books, query)("code").alias("estimate")).collect()
    assert {len(r.code) for r in rows} == {4}
    for r in rows:
        true = np.linalg.norm(np.array(r.embedding, np.float64) - np.array(query))
        assert abs(true - r.estimate) <= r.error + 1e-9
        stands_for = np.concatenate([index.books[p, c] for p, c in enumerate(r.code)])
        assert np.isclose(np.linalg.norm(np.array(r.embedding) - stands_for), r.error)


def test_exact_search_equals_the_plain_one(spark, built, monkeypatch):
    rows, index = built
    queries = [*vectors(2, seed=9), vectors(3, seed=5)[0]]
    for q in queries:
        q = q.astype(float).tolist()
        for options in ({}, {"top_k": 25, "filters": {"half": "1"}}, {"top_k": 0}, {"top_k": 10_000}, {"max_value": 3.0}):
            assert found(codes.search_codes_exact(spark, index, q, allowed=ALLOWED, **options)) == plain(rows, q, **options)
    monkeypatch.setattr(codes, "PICKED_ROWS", 5)
    q = queries[0].astype(float).tolist()
    assert found(codes.search_codes_exact(spark, index, q, allowed=ALLOWED)) == plain(rows, q)


def test_recall_of_few_reranked_rows(spark, built, monkeypatch):
    rows, index = built
    hits = total = 0
    for q in vectors(10, seed=21):
        q = q.astype(float).tolist()
        want = {i for i, _ in plain(rows, q)}
        hits += len(want & {i for i, _ in found(codes.search_codes(spark, index, q, allowed=ALLOWED, rerank=100))})
        total += len(want)
    assert hits / total >= 0.9
    named = found(codes.search_codes(spark, index, q, allowed=ALLOWED, rerank=100))
    monkeypatch.setattr(codes, "PICKED_ROWS", 10)
    assert found(codes.search_codes(spark, index, q, allowed=ALLOWED, rerank=100)) == named
    assert found(codes.search_codes(spark, index, q, allowed=ALLOWED, rerank=None)) == plain(rows, q)


def test_picked_rows_reach_the_reader(spark, built):
    _, index = built
    query = vectors(1, seed=3)[0].astype(float).tolist()
    scan = index.rows(spark).select("place", codes.estimate_to(index.books, query)("code"))._jdf.queryExecution().toString()
    assert "embedding:array" not in scan.split("Physical Plan")[1]
    picked = codes.search_codes(spark, index, query, allowed=ALLOWED, rerank=3)._jdf.queryExecution().toString()
    assert "EqualTo(place," in picked.split("PushedFilters: ")[1]


def test_odd_input(spark, tmp_path):
    rows = table(spark, vectors(5))
    index = codes.build_codes(rows, 8, str(tmp_path / "few"))
    q = vectors(1, seed=2)[0].astype(float).tolist()
    assert found(codes.search_codes_exact(spark, index, q, allowed=ALLOWED)) == plain(rows, q)
    # Fewer rows than codes: every row is its own code.
    assert index.rows(spark).agg(F.max("error")).first()[0] < 1e-6
    with pytest.raises(BadRequest):
        codes.search_codes(spark, index, q[:-1], allowed=ALLOWED, rerank=5)
    with pytest.raises(ValueError):
        codes.train_books(rows.where("false"), 4)
    with pytest.raises(ValueError):
        codes.train_books(rows, 4, codes=257)
