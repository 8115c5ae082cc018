"""Cell-pruned neighbours equal those of all pairs, and skip most pairs of clustered vectors."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from vecfold.operators import knn, pruned, spaces
from vecfold.operators.spaces import Space
from vecfold.schemas import Metric


def clustered(spark, n, clusters=40, dimensions=16, spread=0.15, seed=4):
    """Vectors around few middles, made in tasks from their number."""
    middles = np.random.default_rng(seed).normal(size=(clusters, dimensions)).tolist()
    table = F.array(*[F.array(*[F.lit(x) for x in m]) for m in middles])
    noise = F.transform(F.sequence(F.lit(0), F.lit(dimensions - 1)), lambda i: (F.pmod(F.xxhash64("id", i), F.lit(2001)) / 1000 - 1) * spread)
    vector = F.zip_with(F.get(table, (F.col("id") % clusters).cast("int")), noise, lambda a, b: (a + b).cast("float"))
    return spark.range(n).select(F.format_string("%08d", "id").alias("embedding_id"), vector.alias("embedding"))


def same(a, b):
    key = lambda r: (r.query_id, r["rank"], r.embedding_id, "nan" if r.value != r.value else round(r.value, 9))
    return sorted(map(key, a.collect())) == sorted(map(key, b.collect()))


@pytest.fixture(scope="module")
def tables(spark):
    rows = clustered(spark, 1200)
    odd = spark.createDataFrame([("z1", [0.0] * 16), ("z0", [0.0] * 16), ("big", [30.0] * 16)], "embedding_id string, embedding array<float>")
    copies = rows.limit(1).select(F.explode(F.array(*[F.lit(f"copy{i}") for i in range(30)])).alias("embedding_id"), "embedding")
    queries = rows.where("int(embedding_id) % 60 = 0").select(F.col("embedding_id").cast("long").alias("query_id"), "embedding")
    queries = queries.union(spark.createDataFrame([(-1, [0.0] * 16), (-2, [5.0] * 16)], "query_id long, embedding array<float>"))
    return rows.union(odd).union(copies).repartition(4).cache(), queries.cache()


@pytest.mark.parametrize("metric", list(Metric))
def test_pruned_equals_all_pairs(tables, metric, monkeypatch):
    monkeypatch.setattr(pruned, "PART_ROWS", 25)
    monkeypatch.setattr(pruned, "QUERY_ROWS", 2)
    vectors, queries = tables
    assert same(pruned.knn_pruned(vectors, queries, metric=metric, top_k=5, cell_rows=40), knn.knn_batch(vectors, queries, metric=metric, top_k=5))


@pytest.mark.parametrize("metric,low,high", [(Metric.cosine_similarity, 0.9, None), (Metric.l2_distance, None, 0.8), (Metric.inner_product, -20.0, -5.0)])
def test_pruned_with_bounds(tables, metric, low, high):
    vectors, queries = tables
    options = {"metric": metric, "top_k": 4, "min_value": low, "max_value": high}
    assert same(pruned.knn_pruned(vectors, queries, cell_rows=40, **options), knn.knn_batch(vectors, queries, **options))


def test_most_pairs_are_never_compared(spark):
    vectors = clustered(spark, 20_000, clusters=100).cache()
    queries = vectors.where("int(embedding_id) % 100 < 2").select(F.col("embedding_id").cast("long").alias("query_id"), "embedding")
    for metric in (Metric.l2_distance, Metric.cosine_similarity):
        found, pairs, all_pairs = pruned.knn_counted(vectors, queries, metric=metric, cell_rows=200)
        assert all_pairs == 20_000 * 400 and pairs < 0.2 * all_pairs
        assert found.count() == 4_000


def test_no_row_for_a_query_and_a_cell(spark, monkeypatch):
    """Where nothing can be skipped, each query meets all of 100 cells; its vector is stored once and not once a cell."""
    points = np.random.default_rng(6).normal(size=(300, 16))
    vectors = spark.createDataFrame([(f"v{i:03d}", p.tolist()) for i, p in enumerate(points)], "embedding_id string, embedding array<float>")
    queries = vectors.select(F.substring("embedding_id", 2, 3).cast("long").alias("query_id"), "embedding")
    stored, moved, materialize, meet = [], [], pruned.materialize, pruned._meet
    monkeypatch.setattr(pruned, "materialize", lambda frame, name: stored.append(materialize(frame, name)) or stored[-1])
    monkeypatch.setattr(pruned, "_meet", lambda placed, requests, *rest, **more: moved.append(requests) or meet(placed, requests, *rest, **more))
    found, pairs, all_pairs = pruned.knn_counted(vectors, queries, metric=Metric.l2_distance, top_k=5, cell_rows=3)
    assert same(found, knn.knn_batch(vectors, queries, metric=Metric.l2_distance, top_k=5))
    assert pairs > 0.9 * all_pairs
    assert [f.count() for f in [*stored, *moved] if "embedding" in f.columns] == [300] * 5


def test_blocks_are_bounded_and_hold_cells_that_lie_together():
    rng = np.random.default_rng(2)
    middles = np.repeat(rng.normal(size=(8, 3)) * 50, 25, axis=0)[rng.permutation(200)]
    space = Space(Metric.l2_distance, 1.0)
    cells = pruned.Cells(space, middles + rng.normal(size=(200, 3)), *(np.zeros(200) for _ in range(3)), (None, None))
    asked = dict.fromkeys(range(200), 10) | {7: 2_600}
    dealt = pruned._query_blocks(asked, cells, 250)
    assert {cell: n for cell, _, n in dealt if n > 1} == {7: 11}
    held = {}
    for cell, first, n in dealt:
        for block in range(first, first + n):
            held.setdefault(block, []).append(cell)
    assert sorted(held) == list(range(len(held))) and len(held) < 11 + 2 * 8 and held[dict((c, b) for c, b, _ in dealt)[7]] == [7]
    assert all(sum(asked[c] for c in some) <= 250 for some in held.values() if some != [7])
    wide = lambda some: float(np.ptp(cells.centroids[some], axis=0).max())
    assert np.mean([wide(some) for some in held.values()]) < 0.7 * wide(list(range(200)))


def test_no_vectors_or_queries(spark, tables):
    vectors, queries = tables
    assert pruned.knn_pruned(vectors.where("false"), queries).count() == 0
    assert pruned.knn_pruned(vectors, queries.where("false")).count() == 0


@pytest.mark.parametrize("metric", list(Metric))
def test_reach_holds_every_better_vector(metric):
    rng = np.random.default_rng(8)
    x, q = rng.normal(size=(300, 6)) * rng.uniform(0.1, 5, (300, 1)), rng.normal(size=(20, 6))
    space = Space(metric, float(np.sqrt((x * x).sum(axis=1)).max()))
    points, asked = space.vectors(x), space.queries(q)
    for i in range(len(q)):
        values = knn.row_distances(metric, x, q[i])
        far = np.sqrt(((points - asked[i]) ** 2).sum(axis=1))
        for worst in np.quantile(values, [0.05, 0.5, 0.95]):
            better = values <= worst if metric.ascending else values >= worst
            assert (far[better] <= space.reach(np.array([worst]), q[i : i + 1])[0]).all()


def test_many_centroids_cost_the_driver_a_row_each(spark):
    """No round sends the driver all pairs of centroids (a task a centroid); each centroid is near its points' mean."""
    rng = np.random.default_rng(3)
    points = rng.normal(size=(900, 4)).round(6)
    rows = spark.createDataFrame([(f"v{i}", p.tolist()) for i, p in enumerate(points)], "embedding_id string, embedding array<double>").repartition(3)
    spark.sparkContext.setJobGroup("many-centroids", "")
    space = spaces.Space(Metric.l2_distance, 1.0)
    centroids = spaces.trained_centroids(rows, space, 150, 900)
    status = spark.sparkContext.statusTracker()
    stages = [status.getStageInfo(s) for j in status.getJobIdsForGroup("many-centroids") for s in status.getJobInfo(j).stageIds]
    assert centroids.shape == (150, 4) and max(s.numTasks for s in stages if s) < 150
    spread = spaces.distances(points, centroids).min(axis=1).mean()
    assert spread < 0.9 * spaces.distances(points, points[:150]).min(axis=1)[150:].mean()
    again = spaces.trained_centroids(rows, space, 150, 900)
    assert np.allclose(np.sort(centroids[:, 0]), np.sort(again[:, 0]))
