"""Indexed collections: puts place rows, cells split, readers keep their generation; JSON keeps digits; deep pages."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from vecfold.functions.content import field_texts, json_with
from vecfold.operators import index, reads
from vecfold.operators.search import BadRequest
from vecfold.plans.store import VectorStore
from vecfold.session import scratch_path

ALLOWED = ["/vectorstore/collections/one"]


def vectors(n, seed=1, clusters=12, dimensions=8):
    rng = np.random.default_rng(seed)
    middles = np.random.default_rng(0).normal(size=(clusters, dimensions)) * 3
    return (middles[rng.integers(0, clusters, n)] + rng.normal(scale=0.4, size=(n, dimensions))).round(4)


def batch(spark, matrix, ids=None):
    rows = [(i, 1, v.tolist(), None, f'{{"i":{i}}}', None if ids is None else ids[i]) for i, v in enumerate(matrix)]
    return spark.createDataFrame(rows, "pos long, collection_id long, embedding array<double>, authz string, metadata string, embedding_id string")


@pytest.fixture()
def store(spark):
    store = VectorStore(spark, scratch_path(spark, "index"))
    kinds = "pos long, requested_name string, description string, ai_model_name string, dimensions int, vector_type string"
    store.create_collections(spark.createDataFrame([(0, "one", None, None, 8, "vector")], kinds), ALLOWED)
    return store


def found(hits):
    return [(r.embedding_id, round(r.value, 6)) for r in hits.collect()]


def near(store, query, **options):
    return found(store.search_index("one", list(map(float, query)), ALLOWED, **options))


def exact(store, query, metric):
    return found(store.search("one", list(map(float, query)), ALLOWED, metric=metric))


def test_cosine_cells_are_exact(spark, store):
    rows = np.concatenate([vectors(300), np.zeros((2, 8))])
    store.insert(batch(spark, rows), ALLOWED, "b0")
    assert store.index_collection("one", ALLOWED, "cosine_similarity", cell_rows=30) > 5
    for q in vectors(2, seed=9):
        assert near(store, q, probes=None)[2:] == exact(store, q, "cosine_similarity")[2:]


def test_puts_keep_the_index(spark, store, monkeypatch):
    metric, rows = "l2_distance", vectors(600)
    store.insert(batch(spark, rows), ALLOWED, "b0")
    with pytest.raises(BadRequest):
        store.search_index("one", [1.0] * 8, ALLOWED)
    assert store.index_collection("one", ALLOWED, metric, cell_rows=50) == 12
    queries = vectors(15, seed=9)
    hits = [set(near(store, q, probes=3)) & set(exact(store, q, metric)) for q in queries[:4]]
    assert sum(map(len, hits)) / (10 * len(hits)) >= 0.9
    # A new row is found in its cell at once, and not by readers of the generation before.
    generation = store.tables.generation()
    monkeypatch.setattr(index, "SPLIT_ROWS", 55)
    new = vectors(40, seed=5)
    ids = {r.input_index: r.embedding_id for r in store.put(batch(spark, new), ALLOWED, "b1").collect()}
    assert near(store, new[3], probes=1)[0][0] == ids[3]
    assert ids[3] not in {i for i, _ in near(store, new[3], probes=None, generation=generation)}
    # Full cells were split: more cells, the same rows.
    assert store.tables.cells([1]).count() > 12 and store.tables.embeddings().count() == 640
    # An updated row moves to its new cell, a deleted one is gone.
    store.put(batch(spark, -new[:1], [ids[0]]), ALLOWED, "b2")
    assert near(store, -new[0], probes=1)[0][0] == ids[0]
    store.delete_embeddings(spark.createDataFrame([(1, ids[3])], "collection_id long, embedding_id string"), ALLOWED)
    for q in (new[3], -new[0]):
        assert near(store, q, probes=None) == exact(store, q, metric)
    # Every row lies within its cell's radius of the centroid.
    known = index.read_cells(store.tables.cells([1]))[1]
    for r in store.tables.bucketed().collect():
        at = int(np.flatnonzero(known.numbers == r.bucket)[0])
        assert np.linalg.norm(np.array(r.embedding, np.float64) - known.centroids[at]) <= known.radii[at] + 1e-9


def test_values_are_cut_out_of_documents():
    text = '[{"metadata": {"a": 1.10, "b": "}\\\\\\"metadata\\":2"}, "x": [1, {"metadata": 3}]}, {"y":1} ,{"metadata" :1e5,"metadata": [ 2.0 ]}, {"metadata": null}, {}]'
    assert field_texts(text, "metadata") == ['{"a": 1.10, "b": "}\\\\\\"metadata\\":2"}', None, "[ 2.0 ]", "null", None]
    assert field_texts(' {"k": 1, "metadata": "te,xt"}', "metadata") == ['"te,xt"']
    assert field_texts(None, "metadata") == [] and field_texts("", "metadata") == [] and field_texts('[{"metadata": {', "metadata") == [None]


def test_json_is_put_in_unparsed(spark):
    row = spark.range(1).select(
        json_with(F.struct(F.lit("x").alias("a")), "m", F.lit('{"n":1.10}')).alias("both"),
        json_with(F.struct(F.lit(None).cast("string").alias("a")), "m", F.lit("{}")).alias("only"),
        json_with(F.struct(F.lit("x").alias("a")), "m", F.lit(None).cast("string")).alias("none"),
    ).first()
    assert tuple(row) == ('{"a":"x","m":{"n":1.10}}', '{"m":{}}', '{"a":"x"}')


def test_pages_by_counted_ranges(spark, monkeypatch):
    keys = [f"{h:04x}" for h in range(0, 60000, 97)] + ["same"] * 300 + ["a", "ab", "", "z"]
    rows = spark.createDataFrame([(k, i) for i, k in enumerate(keys)], "key string, n long").repartition(5)
    ordered = sorted(keys)
    for offset in (0, 1, 250, 600, 700, 915, 920, 922, 5000):
        part, before = reads.page_ranges(rows, "key", offset, 20, range_rows=40)
        got = [r["key"] for r in part.orderBy("key").offset(offset - before).limit(20).collect()]
        assert got == ordered[offset : offset + 20]
        assert offset >= len(keys) or part.count() <= 300 + 4 * 40 + 20
    monkeypatch.setattr(reads, "RANGE_ROWS", 30)
    page = reads.page_of(rows, "key", 9, 40).collect()
    assert [r["key"] for r in page] == ordered[320:360] and {(r.page, r.next_page, r.prev_page) for r in page} == {(9, 10, 8)}
