import math

import pytest
from pyspark.sql import functions as F

from vecfold.operators import search
from vecfold.schemas import Metric
from vecfold.sources import fixtures

ROWS = [
    (1, "vector", "a", [1.0, 0.0], "/p", '{"kind":"x","n":1,"a.b":"dot"}'),
    (1, "vector", "b", [0.0, 1.0], "/p", '{"kind":"y","n":1.5}'),
    (1, "vector", "c", [0.0, 0.0], "/p", '{"kind":null}'),
    (1, "vector", "d", [1.0, 0.0], "/p", '{"other":true}'),
    (1, "vector", "e", [2.0, 0.0], "/hidden", '{"kind":"x"}'),
    (2, "vector", "f", [1.0, 1.0], "/p", '{"kind":"x","n":{"m":2}}'),
    (3, "halfvec", "g", [1.0, 0.5], "/p", "{}"),
]


@pytest.fixture(scope="module")
def rows(spark):
    schema = "collection_id long, vector_type string, embedding_id string, embedding array<float>, authz string, metadata string"
    return spark.createDataFrame(ROWS, schema)


@pytest.fixture(scope="module")
def catalog(spark):
    rows = [(1, "one", 2, "vector", "m"), (2, "two", 2, "vector", "n"), (3, "three", 2, "halfvec", "m")]
    return spark.createDataFrame(
        rows, "id long, collection_name string, dimensions int, vector_type string, ai_model_name string"
    )


def ids(hits):
    return [r.embedding_id for r in hits.collect()]


def in_one(rows, catalog, query=(1.0, 0.0), **options):
    options.setdefault("allowed", ["/p"])
    return search.search_collection(rows, catalog.where("id = 1").first(), list(query), **options)


def test_ties_go_to_the_smaller_id_and_policy_hides(rows, catalog):
    assert ids(in_one(rows, catalog, metric="l2_distance"))[:2] == ["a", "d"]
    assert "e" not in ids(in_one(rows, catalog, metric="l2_distance", top_k=100))
    assert ids(in_one(rows, catalog, metric="l2_distance", allowed=[])) == []
    assert ids(in_one(rows, catalog, metric="inner_product", allowed=["/p", "/hidden"]))[0] == "e"


def test_inner_product_is_negated_and_bounded_as_such(rows, catalog):
    hits = in_one(rows, catalog, metric=Metric.inner_product, max_value=-0.5).collect()
    assert [(r.embedding_id, r.value) for r in hits] == [("a", -1.0), ("d", -1.0)]


def test_undefined_similarity_ranks_first_and_distance_last(rows, catalog):
    similar = in_one(rows, catalog).collect()
    assert similar[0].embedding_id == "c" and math.isnan(similar[0].value)
    distant = in_one(rows, catalog, metric="cosine_distance").collect()
    assert distant[-1].embedding_id == "c" and math.isnan(distant[-1].value)


def test_bounds_are_inclusive_and_may_be_empty(rows, catalog):
    assert ids(in_one(rows, catalog, metric="l2_distance", min_value=0.0, max_value=0.0)) == ["a", "d"]
    assert ids(in_one(rows, catalog, metric="l2_distance", min_value=2.0, max_value=1.0)) == []


@pytest.mark.parametrize(
    "filters,expected",
    [
        ({"kind": "x"}, ["a"]),
        ({"kind": "null"}, []),
        ({"missing": "x"}, []),
        ({"n": "1"}, ["a"]),
        ({"n": "1.5"}, ["b"]),
        ({"other": "true"}, ["d"]),
        ({"a.b": "dot"}, ["a"]),
        ({"kind": "x", "n": "1"}, ["a"]),
        ({"kind": "x", "n": "2"}, []),
    ],
)
def test_metadata_compares_as_text(rows, catalog, filters, expected):
    assert ids(in_one(rows, catalog, metric="l2_distance", filters=filters)) == expected


def test_bad_requests(rows, catalog):
    for query in ("text", [], [1.0], [1.0, "x"], [1.0, float("nan")], [float("inf"), 1.0]):
        with pytest.raises(search.BadRequest):
            search.search_collection(rows, catalog.where("id = 1").first(), query, allowed=["/p"])
    with pytest.raises(search.BadRequest):
        in_one(rows, catalog, top_k=-1)
    assert ids(in_one(rows, catalog, top_k=0)) == []
    with pytest.raises(search.BadRequest, match="half range"):
        search.search_across(rows, catalog, [70_000.0, 1.0], vector_type="halfvec", allowed=["/p"])


def test_across_is_the_union_of_collections(rows, catalog):
    hits = search.search_across(rows, catalog, [1.0, 0.2], allowed=["/p"], metric="l2_distance", top_k=4)
    union = search.search_rows(
        rows.where("collection_id in (1, 2)"), [1.0, 0.2], allowed=["/p"], metric="l2_distance", top_k=4
    )
    assert ids(hits) == ids(union)
    assert {r.collection_name for r in hits.collect()} == {"one", "two"}
    half = search.search_across(rows, catalog, [1.0, 0.2], vector_type="halfvec", allowed=["/p"])
    assert ids(half) == ["g"]
    with pytest.raises(search.BadRequest):
        search.check_eligible(catalog, "halfvec", 3)


def test_model_conflicts(spark, catalog):
    assert search.model_conflicts(catalog).count() == 1
    same = catalog.where("ai_model_name = 'm'")
    assert search.model_conflicts(same).count() == 0
    assert search.model_conflicts(same, (), F.lit("m")).count() == 0
    assert search.model_conflicts(same, (), F.lit("n")).count() == 1


def test_documents(rows, catalog):
    hits = search.search_across(
        rows, catalog, [1.0, 0.2], allowed=["/p"], top_k=2, metric="l2_distance", columns=["authz", "metadata", "embedding"]
    )
    # Metadata goes into the document as the text that is stored.
    full = search.search_documents(hits, "l2_distance").select(search.info_json(F.col("embedding.info")).alias("info"), "embedding.info.metadata").collect()
    assert full[0].metadata == '{"kind":"x","n":1,"a.b":"dot"}'
    assert full[0].info == (
        '{"collection_id":1,"authz":"/p","metadata":{"kind":"x","n":1,"a.b":"dot"},'
        '"self":"/vectorstore/collections/one/embeddings/a"}'
    )
    bare = search.search_documents(hits, "l2_distance", exclude_info=True)
    assert bare.schema["embedding"].dataType.names == ["vector", "embedding_id"]


def plan(frame):
    return frame._jdf.queryExecution().executedPlan().toString()


def test_plans(spark, sf_dir, rows, catalog):
    known = fixtures.collections(spark, sf_dir)
    across = search.search_across(
        fixtures.embeddings(spark, sf_dir), known, fixtures.query_vector(spark, sf_dir), allowed=fixtures.CALLER
    )
    text = plan(across)
    assert "TakeOrderedAndProject" in text and "BroadcastHashJoin" in text
    assert "Exchange hashpartitioning" not in text and "Sort [" not in text
    assert "TakeOrderedAndProject" in plan(in_one(rows, catalog))
