import math
import re
import tracemalloc

import numpy as np
import pytest
from pyspark.sql import functions as F

from vecfold.operators import cells, knn, search
from vecfold.operators.knn import BestPerQuery, knn_batch
from vecfold.schemas import Metric
from vecfold.session import scratch_path


@pytest.fixture(scope="module")
def points():
    rng = np.random.default_rng(3)
    vectors = rng.normal(size=(120, 6)).astype(np.float32)
    vectors[10] = vectors[20] = vectors[30]
    vectors[40] = 0
    return vectors


@pytest.fixture(scope="module")
def rows(spark, points):
    data = [(1, f"v{i:03d}", p.tolist(), "/p", "{}") for i, p in enumerate(points)]
    return spark.createDataFrame(
        data, "collection_id long, embedding_id string, embedding array<float>, authz string, metadata string"
    ).repartition(3)


@pytest.fixture(scope="module")
def queries(spark, points):
    data = [(i, p.tolist()) for i, p in enumerate(points[10:35])] + [(99, [0.0] * 6)]
    return spark.createDataFrame(data, "query_id long, embedding array<float>")


def lists(frame):
    found = {}
    for r in frame.orderBy("query_id", "rank").collect():
        found.setdefault(r.query_id, []).append((r.embedding_id, None if math.isnan(r.value) else round(r.value, 9)))
    return found


def one_by_one(rows, queries, metric, k, **bounds):
    found = {}
    for q in queries.collect():
        hits = search.search_rows(rows, list(q.embedding), allowed=["/p"], metric=metric, top_k=k, **bounds).collect()
        if hits:
            found[q.query_id] = [
                (h.embedding_id, None if math.isnan(h.value) else round(h.value, 9)) for h in hits
            ]
    return found


GRID = {"max_broadcast_bytes": 0, "vector_block_bytes": 1500, "query_block_bytes": 500}


@pytest.mark.parametrize("metric", list(Metric))
def test_batch_is_one_search_per_query(rows, queries, metric):
    few = queries.where("query_id in (0, 3, 20, 99)")
    expected = one_by_one(rows, few, metric, 7)
    assert lists(knn_batch(rows, few, metric=metric, top_k=7)) == expected
    assert lists(knn_batch(rows, few, metric=metric, top_k=7, **GRID)) == expected


@pytest.mark.parametrize("metric", list(Metric))
def test_seeds_change_nothing(rows, queries, metric, monkeypatch):
    monkeypatch.setattr(knn, "SEEDED_FROM", 1)
    plain = lists(knn_batch(rows, queries, metric=metric, top_k=3))
    assert lists(knn_batch(rows, queries, metric=metric, top_k=3, seed_rows=5)) == plain
    assert lists(knn_batch(rows, queries, metric=metric, top_k=3, seed_rows=2)) == plain


@pytest.mark.parametrize("bounds", [{"min_value": 1.0}, {"max_value": 1.5}, {"min_value": 2.0, "max_value": 2.5}])
def test_bounds_apply_before_the_cut(rows, queries, bounds, monkeypatch):
    monkeypatch.setattr(knn, "SEEDED_FROM", 1)
    few = queries.where("query_id in (0, 5, 99)")
    expected = one_by_one(rows, few, Metric.l2_distance, 4, **bounds)
    assert lists(knn_batch(rows, few, metric="l2_distance", top_k=4, **bounds)) == expected
    assert lists(knn_batch(rows, few, metric="l2_distance", top_k=4, seed_rows=5, **bounds)) == expected
    assert lists(knn_batch(rows, few, metric="l2_distance", top_k=4, **bounds, **GRID)) == expected


def test_threshold_on_similarity(rows, queries):
    expected = one_by_one(rows, queries, Metric.cosine_similarity, 4, min_value=0.5)
    assert lists(knn_batch(rows, queries, top_k=4, min_value=0.5)) == expected


def test_many_copies_keep_the_smallest_ids():
    """A block of equal vectors: every pair survives preselection, ties still go by id."""
    best = BestPerQuery(Metric.l2_distance, 3, np.array([7]), np.ones((1, 4)), None, None)
    ids = np.array([f"v{i:04d}" for i in range(2000)], dtype=object)
    for part in np.array_split(np.random.default_rng(4).permutation(2000), 5):
        best.add(ids[part], np.full((len(part), 4), 2.0))
    assert list(best.ids) == ["v0000", "v0001", "v0002"]
    assert list(best.values) == [2.0, 2.0, 2.0]


def test_pairs_that_tie_do_not_pile_up():
    """All pairs of equal vectors pass the preselection; what waits to be merged is bounded all the same."""
    best = BestPerQuery(Metric.l2_distance, 3, np.arange(1000), np.ones((1000, 4)), None, None)
    ids = np.array([f"v{i:04d}" for i in np.random.default_rng(4).permutation(3000)], dtype=object)
    tracemalloc.start()
    best.add(ids, np.full((3000, 4), 2.0))
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert list(best.ids) == ["v0000", "v0001", "v0002"] * 1000
    assert peak < 100e6


def test_some_queries_only(points):
    """A comparison with some of the queries leaves the lists of the others as they are."""
    ids = np.array([f"v{i:03d}" for i in range(120)], dtype=object)
    one, every = (BestPerQuery(Metric.l2_distance, 4, np.arange(40), points[:40], None, None) for _ in range(2))
    one.add(ids[:60], points[:60].astype(float))
    few = np.array([3, 4, 17, 39])
    one.meet(ids[60:], points[60:].astype(float), few)
    every.add(ids, points.astype(float))
    half = BestPerQuery(Metric.l2_distance, 4, np.arange(40), points[:40], None, None)
    half.add(ids[:60], points[:60].astype(float))
    lists = [{i: list(best.ids[best.which == i]) for i in range(40)} for best in (one, every, half) if best.batch()]
    assert all(lists[0][i] == (lists[1] if i in few else lists[2])[i] for i in range(40))


@pytest.mark.parametrize("metric", list(Metric))
@pytest.mark.parametrize("scale", [1e-22, 1.0, 1e20])
def test_kernel_against_brute_force(metric, scale):
    """Batches, near ties and extreme lengths: always the k best of all pairs."""
    from vecfold.functions.vectors import row_distances

    rng = np.random.default_rng(5)
    vectors = np.round(rng.normal(size=(900, 5)), 1) * scale
    vectors[::50] = 0
    queries = np.vstack([vectors[:20] + scale * 1e-9, np.zeros((1, 5))])
    ids = np.array([f"v{i:04d}" for i in range(900)], dtype=object)
    best = BestPerQuery(metric, 6, np.arange(21), queries, None, None)
    for part in np.array_split(rng.permutation(900), 7):
        best.add(ids[part], vectors[part])
    for i, q in enumerate(queries):
        values = row_distances(metric, vectors, q)
        keys = np.where(np.isnan(values), np.inf, values)
        order = np.lexsort((ids.astype(str), keys if metric.ascending else -keys))[:6]
        assert list(best.ids[best.which == i]) == list(ids[order])


def test_vectors_of_other_lengths_fail(spark):
    vectors = spark.createDataFrame([("a", [1.0, 2.0, 3.0]), ("b", [1.0])], "embedding_id string, embedding array<float>").coalesce(1)
    queries = spark.createDataFrame([(1, [1.0, 2.0])], "query_id long, embedding array<float>")
    for options in ({}, GRID):
        with pytest.raises(Exception, match="one length|mismatch|shapes|align"):
            knn_batch(vectors, queries, **options).collect()


def test_plan_has_no_cross_join(rows, queries):
    for options in ({}, GRID):
        text = knn_batch(rows, queries, **options)._jdf.queryExecution().executedPlan().toString()
        assert "WindowGroupLimit" in text
        assert "Cartesian" not in text and "NestedLoop" not in text


def test_cells(spark, rows, points):
    built = cells.build_cells(rows, 6, scratch_path(spark, "cells"), seed=1)
    assert built.rows(spark).count() == rows.count()
    options = {"allowed": ["/p"], "top_k": 8}
    recalls = []
    for i in range(0, 30, 5):
        query = points[i].tolist()
        exact = [r.embedding_id for r in search.search_rows(rows, query, metric="l2_distance", **options).collect()]
        pruned = cells.search_cells_exact(spark, built, query, **options).collect()
        assert [r.embedding_id for r in pruned] == exact
        every = cells.search_cells(spark, built, query, probes=6, **options).collect()
        assert [r.embedding_id for r in every] == exact
        some = {r.embedding_id for r in cells.search_cells(spark, built, query, probes=2, **options).collect()}
        recalls.append(len(some & set(exact)) / len(exact))
    assert np.mean(recalls) > 0.4


def test_cells_with_a_filter_that_leaves_fewer_than_k(spark, rows, points):
    built = cells.build_cells(rows, 4, scratch_path(spark, "cells"), seed=1)
    query = points[0].tolist()
    options = {"allowed": ["/p"], "top_k": 200}
    assert cells.search_cells_exact(spark, built, query, **options).count() == rows.count()
    text = cells.search_cells(spark, built, query, allowed=["/p"], probes=1)._jdf.queryExecution().executedPlan().toString()
    assert re.search(r"PartitionFilters: \[[^\]]*cell#", text)


def test_many_queries_are_merged_block_by_block(monkeypatch):
    """Lists of many queries: those of one merge, and memory that does not hold all of them in a merge."""
    rng = np.random.default_rng(8)
    queries = rng.normal(size=(12_000, 4)).astype(np.float32)
    parts = [(np.array([f"{i:036d}" for i in range(at, at + 500)], dtype=object), rng.normal(size=(500, 4))) for at in (0, 500)]
    peaks, found = [], []
    monkeypatch.setattr(knn, "QUERIES_AT_ONCE", 1_000)
    for kind in (knn.BestPerQuery, knn.BestInBlocks):
        best = kind(Metric.cosine_similarity, 10, np.arange(12_000), queries, None, None)
        tracemalloc.start()
        for ids, vectors in parts:
            best.add(ids, vectors)
        peaks.append(tracemalloc.get_traced_memory()[1])
        tracemalloc.stop()
        batches = [best.batch()] if kind is knn.BestPerQuery else list(best.batches())
        found.append([tuple(r.values()) for b in batches for r in b.to_pylist()])
    assert found[0] == found[1] and len(found[0]) == 120_000
    assert peaks[1] < peaks[0] / 4


@pytest.mark.parametrize("grid", [False, True])
def test_lists_of_blocks_equal_one_by_one(rows, queries, monkeypatch, grid):
    monkeypatch.setattr(knn, "QUERIES_AT_ONCE", 3)
    monkeypatch.setattr(knn, "ROWS_AT_ONCE", 50)
    expected = one_by_one(rows, queries, Metric.cosine_similarity, 4)
    assert lists(knn_batch(rows, queries, top_k=4, **(GRID if grid else {}))) == expected
