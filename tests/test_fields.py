"""Metadata fields as columns: the same rows as by the text, fewer read; old and new files side by side."""

import json

import pytest
from pyspark.sql import functions as F

from vecfold.operators import fields
from vecfold.plans.store import VectorStore
from vecfold.session import scratch_path
from vecfold.sources import tables

ALLOWED = ["/vectorstore/collections/one"]
KIND = "pos long, collection_id long, embedding array<double>, authz string, metadata string, embedding_id string"
# Every form a field can have, and what looks like the stored form of another.
FORMS = [{"source": "a"}, {"source": "=a"}, {"source": ""}, {"source": None}, {}, {"source": 1}, {"source": {"a": 1}}, {"Source": "a"}, {"source": "é", "page": "2"}]
ASKED = ["a", "=a", "", "=", "1", '{"a":1}', "é", "none"]


def batch(spark, metadata, start=0, ids=None):
    rows = [(i, 1, [float(start + i), 1.0, 2.0, float(i % 3)], None, json.dumps(m, ensure_ascii=False), None if ids is None else ids[i]) for i, m in enumerate(metadata)]
    return spark.createDataFrame(rows, KIND)


@pytest.fixture()
def store(spark):
    store = VectorStore(spark, scratch_path(spark, "fields"))
    kinds = "pos long, requested_name string, description string, ai_model_name string, dimensions int, vector_type string"
    store.create_collections(spark.createDataFrame([(0, "one", None, None, 4, "vector")], kinds), ALLOWED)
    return store


def found(store, **filters):
    hits = store.search("one", [1.0, 2.0, 3.0, 4.0], ALLOWED, filters=filters, top_k=1_000, metric="l2_distance")
    return [(r.embedding_id, r.value) for r in hits.collect()]


def answers(store):
    by_one = [found(store, source=wanted) for wanted in ASKED] + [found(store, Source="a")]
    return [*by_one, found(store, source="é", page="2"), found(store, source="é", page="3"), found(store, other="1")]


def test_columns_give_what_the_text_gives(spark, store):
    store.insert(batch(spark, FORMS), ALLOWED, "b0")
    before = answers(store)
    assert [len(a) for a in before] == [1, 1, 1, 0, 1, 1, 1, 0, 1, 1, 0, 0]
    assert store.store_fields(["one"], ALLOWED, ["source", "page"]) == ["source", "page"]
    assert answers(store) == before
    rows = store.tables.embeddings(fields=["source"])
    assert {r.meta_source for r in rows.collect()} == {"=a", "==a", "=", "", "=1", '={"a":1}', "=é"}
    assert "meta_source" not in store.tables.embeddings().columns


def test_old_files_are_asked_by_their_text(spark, store):
    store.insert(batch(spark, FORMS), ALLOWED, "b0")
    store.store_fields([], ALLOWED, ["source"])
    store.insert(batch(spark, FORMS, start=100), ALLOWED, "b1")
    kinds = {r.old: r.n for r in store.tables.embeddings(fields=["source"]).groupBy(F.col("meta_source").isNull().alias("old")).agg(F.count(F.lit(1)).alias("n")).collect()}
    assert kinds[False] >= len(FORMS)
    mixed = answers(store)
    assert [len(a) for a in mixed] == [2, 2, 2, 0, 2, 2, 2, 0, 2, 2, 0, 0]
    store.store_fields(["one"], ALLOWED, [])
    assert answers(store) == mixed
    assert store.tables.embeddings(fields=["source"]).where("meta_source is null").count() == 0


def test_changes_keep_the_columns(spark, store):
    store.insert(batch(spark, [{"source": "a"}, {"source": "b"}]), ALLOWED, "b0")
    store.store_fields(["one"], ALLOWED, ["source"])
    (a, _), = found(store, source="a")
    update = spark.createDataFrame([(0, 1, a, None, '{"source":"c"}', None)], "pos long, collection_id long, embedding_id string, embedding array<double>, metadata string, authz string")
    assert store.update(update, ALLOWED) == 1
    assert found(store, source="a") == [] and [i for i, _ in found(store, source="c")] == [a] and len(found(store, source="b")) == 1
    # A generation read before the change still gives the old row.
    assert store.tables.fields(store.tables.generation()) == ["source"] and store.tables.fields(1) == []


def test_the_index_filters_by_column(spark, store):
    store.insert(batch(spark, [{"source": f"s{i % 4}"} for i in range(40)]), ALLOWED, "b0")
    store.store_fields(["one"], ALLOWED)
    store.index_collection("one", ALLOWED, cell_rows=10)
    hits = store.search_index("one", [1.0, 2.0, 3.0, 4.0], ALLOWED, probes=None, filters={"source": "s2"}, top_k=50)
    assert sorted(r.embedding_id for r in hits.collect()) == sorted(i for i, _ in found(store, source="s2")) and hits.count() == 10


def test_the_reader_skips_row_groups(spark, store, monkeypatch):
    monkeypatch.setattr(tables, "ROW_GROUP_BYTES", 16 * 1024)
    vector = F.transform(F.sequence(F.lit(1), F.lit(4)), lambda i: (F.xxhash64("id", i) % 100_000).cast("double"))
    metadata = F.concat(F.lit('{"source":"s'), F.col("id") % 50, F.lit('"}'))
    many = spark.range(20_000).select(F.col("id").alias("pos"), F.lit(1).cast("long").alias("collection_id"), vector.alias("embedding"), F.lit(None).cast("string").alias("authz"), metadata.alias("metadata"))
    store.insert(many, ALLOWED, "b0")
    monkeypatch.setattr(tables, "FEW_BUCKETS", 1)

    def read():
        hits = store.search("one", [1.0, 2.0, 3.0, 4.0], ALLOWED, filters={"source": "s7"}, top_k=1_000, metric="l2_distance")
        plan = hits._jdf.queryExecution().executedPlan()
        ids = [r.embedding_id for r in hits.collect()]
        return ids, plan.collectLeaves().apply(0).metrics().apply("numOutputRows").value(), plan.toString()

    ids, rows, plan = read()
    assert len(ids) == 400 and rows == 20_000 and "meta_source" not in plan
    assert store.store_fields(["one"], ALLOWED) == ["source"]
    again, fewer, plan = read()
    assert again == ids and fewer < 8_000 and "EqualTo(meta_source,=s7)" in plan.split("PushedFilters")[1]


def test_which_fields_are_taken(spark):
    rows = [{"source": "x", "Long": "y" * 100, "a.b": "1", "none": None}] * 6 + [{"Source": "x", "rare": "1", "page": 2}] * 4 + [{"source": "z", "page": 1}] * 2
    frame = spark.createDataFrame([(json.dumps(r),) for r in rows], "metadata string")
    assert fields.frequent_fields(frame) == ["source", "page"]
    assert fields.frequent_fields(frame, most=1) == ["source"]
    assert fields.frequent_fields(frame.limit(0)) == []


@pytest.mark.parametrize("names", [["a.b"], [""], ["é"], ["source", "Source"], [f"f{i}" for i in range(17)]])
def test_fields_that_can_have_no_column(names):
    with pytest.raises(fields.BadField):
        fields.checked(names)
