import pytest
from pyspark.sql import functions as F

from vecfold.functions.content import canonical_json
from vecfold.operators import ingest, search
from vecfold.operators.access import NotAllowed
from vecfold.operators.catalog import classify_new_collections
from vecfold.plans.store import NotFound, VectorStore
from vecfold.session import scratch_path
from vecfold.sources.tables import StaleWrite

ALLOWED = ["/vectorstore/collections/one", "/vectorstore/collections/half", "/programs/p"]
BATCH = "pos long, collection_id long, embedding array<double>, authz string, metadata string, embedding_id string"


@pytest.fixture()
def store(spark):
    store = VectorStore(spark, scratch_path(spark, "test-store"))
    requested = spark.createDataFrame(
        [(0, " One ", "first", None, 2, None), (1, "half", None, "m", 2, "halfvec")],
        "pos long, requested_name string, description string, ai_model_name string, dimensions int, vector_type string",
    )
    store.create_collections(requested, ALLOWED)
    return store


def batch(spark, *rows):
    full = [(i, *(list(row) + [None] * (5 - len(row)))) for i, row in enumerate(rows)]
    return spark.createDataFrame(full, BATCH)


def content(store):
    rows = store.tables.embeddings().collect()
    return sorted((r.collection_id, r.embedding_id, tuple(r.embedding), r.authz, r.metadata) for r in rows)


def ids_by_position(result):
    key = "pos" if "pos" in result.columns else "input_index"
    return [r.embedding_id for r in result.orderBy(key).collect()]


def test_create_normalises_and_numbers(store):
    rows = store.collections(ALLOWED).orderBy("id").collect()
    assert [(r.collection_name, r.vector_type) for r in rows] == [("one", "vector"), ("half", "halfvec")]
    assert len({r.id for r in rows}) == 2 and rows[0].id == 1


def test_create_refusals(spark, store):
    requested = spark.createDataFrame(
        [(0, "one"), (1, "new"), (2, "NEW"), (3, "secret"), (4, "no good")], "pos long, requested_name string"
    )
    allowed = ALLOWED + ["/vectorstore/collections/new"]
    outcomes = classify_new_collections(requested, store.tables.collections(), allowed)
    got = {r.pos: r.outcome for r in outcomes.collect()}
    assert got == {0: "conflict", 1: "created", 2: "conflict", 3: "forbidden", 4: "invalid"}


def test_insert_fans_out_and_conflicts_change_nothing(spark, store):
    rows = [(1, [1.0, 2.0], None, '{"b":1,"a":2}'), (1, [1.0, 2.0], " ", '{"a": 2, "b": 1}'), (1, [1.0, 2.0], "/programs/p", None)]
    ids = ids_by_position(store.insert(batch(spark, *rows), ALLOWED, "b1"))
    assert ids[0] == ids[1] != ids[2]
    before = content(store)
    assert [(r[3], r[4]) for r in sorted(before, key=lambda r: r[3])] == [
        ("/programs/p", "{}"),
        ("/vectorstore/collections/one", '{"a":2,"b":1}'),
    ]
    generation = store.tables.generation()
    with pytest.raises(ingest.Conflict):
        store.insert(batch(spark, (1, [9.0, 9.0]), (1, [1.0, 2.0], "/programs/p")), ALLOWED, "b2")
    assert content(store) == before and store.tables.generation() == generation


@pytest.mark.parametrize(
    "row,error",
    [
        ((1, [1.0]), search.BadRequest),
        ((9, [1.0, 2.0]), search.BadRequest),
        ((1, [1.0, None]), search.BadRequest),
        ((1, [1.0, 2.0], "programs"), search.BadRequest),
        ((2, [1.0, 70000.0]), search.BadRequest),
        ((1, [1.0, 2.0], None, "{broken"), search.BadRequest),
        ((1, [1.0, 2.0], None, '{"a":1,"a":2}'), search.BadRequest),
        ((1, [1.0, 2.0], "/not/mine"), NotAllowed),
    ],
)
def test_bad_rows_reject_the_batch(spark, store, row, error):
    with pytest.raises(error):
        store.put(batch(spark, (1, [5.0, 5.0]), row), ALLOWED, "b")
    assert content(store) == []


def test_upsert_twice_is_upsert_once(spark, store):
    rows = [(1, [1.0, 2.0]), (1, [3.0, 4.0]), (2, [0.1, 0.2]), (1, [1.0, 2.0])]
    first = ids_by_position(store.put(batch(spark, *rows), ALLOWED, "b1"))
    state = content(store)
    created = {r.embedding_id: r.created_at for r in store.tables.embeddings().collect()}
    again = store.put(batch(spark, *rows), ALLOWED, "b2")
    assert ids_by_position(again) == first and {r.action for r in again.collect()} == {"touched"}
    assert content(store) == state
    for r in store.tables.embeddings().collect():
        assert r.created_at == created[r.embedding_id] and r.updated_at > r.created_at


def test_rounding_does_not_merge_different_inputs(spark, store):
    """The key comes from the input: two inputs that store the same half vector stay two rows."""
    ids = ids_by_position(store.put(batch(spark, (2, [0.1, 0.2]), (2, [0.100001, 0.2])), ALLOWED, "b"))
    assert ids[0] != ids[1]
    stored = [tuple(r.embedding) for r in store.tables.embeddings().collect()]
    assert stored[0] == stored[1]


def test_mixed_put(spark, store):
    one, two = ids_by_position(store.put(batch(spark, (1, [1.0, 2.0]), (1, [3.0, 4.0])), ALLOWED, "b1"))
    mixed = batch(
        spark, (1, [3.0, 4.0]), (1, [7.0, 8.0], None, '{"v":1}', one), (1, [5.0, 6.0]), (1, [7.0, 9.0], None, '{"v":2}', one)
    )
    result = store.put(mixed, ALLOWED, "b2")
    assert [(r.input_index, r.action) for r in result.collect()] == [
        (0, "touched"), (1, "updated"), (2, "inserted"), (3, "updated"),
    ]
    assert ids_by_position(result)[:2] == [two, one]
    rows = {r.embedding_id: r for r in store.tables.embeddings().collect()}
    assert len(rows) == 3
    assert (list(rows[one].embedding), rows[one].metadata) == ([7.0, 9.0], '{"v":2}')
    before = content(store)
    with pytest.raises(search.BadRequest):
        store.put(batch(spark, (1, [0.0, 0.0], None, None, "00000000-0000-0000-0000-000000000000")), ALLOWED, "b3")
    with pytest.raises(ingest.Conflict):
        store.put(batch(spark, (1, [3.0, 4.0], None, None, one)), ALLOWED, "b4")
    assert content(store) == before


def test_old_content_gets_a_new_id_after_an_update(spark, store):
    (one,) = ids_by_position(store.put(batch(spark, (1, [1.0, 2.0])), ALLOWED, "b1"))
    store.put(batch(spark, (1, [5.0, 5.0], None, None, one)), ALLOWED, "b2")
    (again,) = ids_by_position(store.put(batch(spark, (1, [1.0, 2.0])), ALLOWED, "b3"))
    assert again != one and len(content(store)) == 2


def test_partial_update_changes_only_visible_rows(spark, store):
    now = F.lit("2030-01-01").cast("timestamp")
    a, b = ids_by_position(store.put(batch(spark, (1, [1.0, 2.0]), (1, [1.0, 2.0], "/programs/p")), ALLOWED, "b"))
    updates = spark.createDataFrame(
        [(0, 1, a, None, '{"x":1}', None), (1, 1, a, [9.0, 9.0], None, None), (2, 1, b, [8.0, 8.0], None, None)],
        "pos long, collection_id long, embedding_id string, embedding array<double>, metadata string, authz string",
    )
    updated = ingest.update_by_id(store.tables.embeddings(), updates, ALLOWED[:1], now)
    rows = {r.embedding_id: r for r in updated.collect()}
    assert (list(rows[a].embedding), rows[a].metadata, rows[a].changed) == ([9.0, 9.0], '{"x":1}', True)
    assert (list(rows[b].embedding), rows[b].changed) == ([1.0, 2.0], False)
    assert rows[a].updated_at.year == 2030 and rows[b].updated_at.year != 2030
    reads = spark.createDataFrame([(0, 1, a, None, None, None)], updates.schema)
    unchanged = ingest.update_by_id(store.tables.embeddings(), reads, ALLOWED, now)
    assert not any(r.changed for r in unchanged.collect())


UPDATE = "pos long, collection_id long, embedding_id string, embedding array<double>, metadata string, authz string"


def test_update_by_id_in_the_store(spark, store):
    a, b = ids_by_position(store.put(batch(spark, (1, [1.0, 2.0]), (1, [3.0, 4.0], "/programs/p")), ALLOWED, "b"))

    def update(*row):
        return spark.createDataFrame([(0, *row)], UPDATE)

    before = content(store)
    with pytest.raises(NotFound):
        store.update(update(1, "unknown", [1.0, 1.0], None, None), ALLOWED)
    with pytest.raises(NotFound):
        store.update(update(1, b, [1.0, 1.0], None, None), ALLOWED[:1])
    with pytest.raises(search.BadRequest):
        store.update(update(1, a, [1.0], None, None), ALLOWED)
    with pytest.raises(search.BadRequest):
        store.update(update(1, a, None, "{broken", None), ALLOWED)
    with pytest.raises(NotAllowed):
        store.update(update(1, a, None, None, "/not/mine"), ALLOWED)
    with pytest.raises(ingest.Conflict):
        store.update(update(1, a, [3.0, 4.0], None, "/programs/p"), ALLOWED)
    assert content(store) == before
    assert store.update(update(1, a, None, '{"b":1, "a":2}', " /programs/p "), ALLOWED) == 1
    rows = {r.embedding_id: r for r in store.tables.embeddings().collect()}
    assert (rows[a].authz, rows[a].metadata, list(rows[a].embedding)) == ("/programs/p", '{"a":2,"b":1}', [1.0, 2.0])
    assert store.update(update(1, a, None, None, None), ALLOWED) == 0


def test_delete(spark, store):
    a, b = ids_by_position(store.put(batch(spark, (1, [1.0, 2.0]), (1, [3.0, 2.0], "/programs/p")), ALLOWED, "b"))
    targets = spark.createDataFrame([(1, a), (1, b), (1, "unknown"), (1, a)], "collection_id long, embedding_id string")
    assert store.delete_embeddings(targets, ALLOWED[:1]) == 1
    assert [r[1] for r in content(store)] == [b]
    assert store.delete_embeddings(targets, ALLOWED[:1]) == 0
    assert store.delete_embeddings(targets, ALLOWED) == 1
    assert content(store) == []


def test_delete_collection_takes_every_row(spark, store):
    store.put(batch(spark, (1, [1.0, 2.0]), (1, [3.0, 2.0], "/programs/p"), (2, [1.0, 1.0])), ALLOWED, "b")
    assert store.delete_collections(["one"], ["/vectorstore/collections/half"]) == 0
    assert store.delete_collections(["one", "unknown"], ALLOWED) == 1
    assert [r[0] for r in content(store)] == [2]
    with pytest.raises(NotFound):
        store.collection("one", ALLOWED)
    assert store.delete_collections(["half"], ALLOWED) == 1
    assert content(store) == [] and store.collections(ALLOWED).count() == 0


def test_update_collection_description(spark, store):
    changes = spark.createDataFrame(
        [(0, "one", "old text"), (1, "one", "new text"), (2, "one", None), (3, "half", None)],
        "pos long, collection_name string, description string",
    )
    store.update_collections(changes, ALLOWED)
    rows = {r.collection_name: r for r in store.collections(ALLOWED).collect()}
    assert rows["one"].description == "new text" and rows["one"].updated_at > rows["one"].created_at
    assert rows["half"].description is None and rows["half"].updated_at == rows["half"].created_at
    store.update_collections(changes.withColumn("description", F.lit("x")), [])
    assert store.collection("one", ALLOWED).description == "new text"


def test_a_stale_commit_is_refused(store):
    with pytest.raises(StaleWrite):
        store.tables.commit(store.tables.collections(), expect=0)


def test_search_and_ordered_read_prune_partitions(spark, store):
    a, b = ids_by_position(store.put(batch(spark, (1, [1.0, 2.0]), (1, [3.0, 2.0])), ALLOWED, "b"))
    store.put(batch(spark, (2, [1.0, 2.0])), ALLOWED, "c")
    hits = store.search("ONE", [3.0, 2.0], ALLOWED, metric="l2_distance")
    assert [r.embedding_id for r in hits.collect()] == [b, a]
    text = hits._jdf.queryExecution().executedPlan().toString()
    assert "vector_type#" in text.split("PartitionFilters: [")[1].split("]")[0]
    assert "collection_id#" in text.split("PartitionFilters: [")[1].split("]")[0]
    assert "EqualTo(authz" in text or "In(authz" in text
    found = store.read_ordered("one", [b, "unknown", a, b], ALLOWED).collect()
    assert [(r.input_index, r.embedding_id, r.precision) for r in found] == [(0, b, "float32"), (2, a, "float32"), (3, b, "float32")]
    across = store.search_all([3.0, 2.0], ALLOWED, names=" One ,", metric="l2_distance").collect()
    assert [r.embedding_id for r in across] == [b, a]
    assert store.search_all([3.0, 2.0], ALLOWED, vector_type="halfvec").count() == 1
    with pytest.raises(search.BadRequest):
        store.search_all([3.0, 2.0], ALLOWED, names="one,nope")
    with pytest.raises(search.BadRequest):
        store.search_all([3.0, 2.0], ALLOWED, names="one,half", ai_model="m")
    with pytest.raises(search.BadRequest):
        store.search_all([3.0, 2.0, 1.0], ALLOWED)


def test_canonical_json_loses_nothing(spark):
    cases = {
        '{"b": [1, {"z": 1, "a": null}], "a": 1.50}': '{"a":1.50,"b":[1,{"a":null,"z":1}]}',
        None: "{}",
        '{"n": 123456789012345678901234567890123456789012345, "e": 1e-400, "f": -0.0, "g": 1E5}':
            '{"e":1e-400,"f":-0.0,"g":1E5,"n":123456789012345678901234567890123456789012345}',
        '{"é": "\\u00e9\\n", "a": {"d": true, "c": "x"}}': '{"a":{"c":"x","d":true},"é":"é\\n"}',
        "[1,2]": None, "1": None, "null": None, "{": None, '{"a":1,"a":2}': None, '{"a":NaN}': None,
    }
    rows = spark.createDataFrame([(m,) for m in cases], "m string")
    assert [r[0] for r in rows.select(canonical_json(F.col("m"))).collect()] == list(cases.values())


def test_numbers_written_differently_stay_two_rows(spark, store):
    result = store.insert(batch(spark, (1, [1.0, 2.0], None, '{"a": 1.0}'), (1, [1.0, 2.0], None, '{"a":1}'), (1, [1.0, 2.0], None, '{ "a" : 1 }')), ALLOWED, "b")
    assert len({r.embedding_id for r in result.collect()}) == 2
    assert sorted(r[4] for r in content(store)) == ['{"a":1.0}', '{"a":1}']


@pytest.mark.parametrize("vector", [[float("nan"), 1.0], [float("inf"), 1.0], [1e300, 1.0]])
def test_values_that_cannot_be_stored_are_refused(spark, store, vector):
    with pytest.raises(search.BadRequest, match="cannot be stored"):
        store.insert(batch(spark, (1, vector)), ALLOWED, "b")


def test_metadata_must_be_an_object(spark, store):
    with pytest.raises(search.BadRequest, match="not a JSON object"):
        store.insert(batch(spark, (1, [1.0, 2.0], None, "[1,2]")), ALLOWED, "b")


def test_writes_stop_at_hidden_collections(spark, store):
    row = batch(spark, (1, [1.0, 2.0], "/programs/p"))
    hidden = ["/programs/p", "/vectorstore/collections/half"]
    for write in (store.insert, store.put):
        with pytest.raises(NotFound):
            write(row, hidden, "b")
    with pytest.raises(NotFound):
        store.put(row, ALLOWED, "b", create_allowed=hidden)
    with pytest.raises(NotAllowed):
        store.put(row, ALLOWED, "b", create_allowed=["/vectorstore/collections/one"])
    with pytest.raises(NotFound):
        store.delete_embeddings(spark.createDataFrame([(1, "x")], "collection_id long, embedding_id string"), hidden)
    assert content(store) == []


def test_nothing_visible_is_an_empty_result(store):
    assert store.search_all([1.0, 2.0], ["/programs/p"]).count() == 0


def test_a_failed_write_leaves_no_trace_and_one_of_two_wins(spark, store):
    tables = store.tables
    before = tables.generation()
    broken = tables.collections().withColumn("dimensions", F.raise_error(F.lit("lost")).cast("int"))
    with pytest.raises(Exception, match="lost"):
        tables.commit(broken)
    assert tables.generation() == before
    catalog = tables.collections()
    assert tables.commit(catalog, expect=before) == before + 1
    with pytest.raises(StaleWrite):
        tables.commit(catalog, expect=before)
    with pytest.raises(StaleWrite):
        tables._publish(before, {"collections": "late"})
    assert tables.generation() == before + 1 and tables.collections().count() == catalog.count()


def test_json_sources(spark, tmp_path):
    from vecfold.sources.json_batch import read_json_documents, read_json_lines

    (tmp_path / "a.json").write_text(
        '[{"collection_id": 1, "embedding": [1, 2.5], "metadata": {"k": [1]}},\n {"collection_id": 1, "embedding": [0.0, 1e-3]}]'
    )
    rows = read_json_documents(spark, str(tmp_path)).orderBy("pos").collect()
    assert [(r.pos, r.embedding, r.metadata) for r in rows] == [(0, [1.0, 2.5], '{"k":[1]}'), (1, [0.0, 0.001], None)]
    (tmp_path / "lines").mkdir()
    (tmp_path / "lines" / "b.json").write_text('{"collection_id": 2, "embedding": [1.0], "authz": "/a"}\n')
    line = read_json_lines(spark, str(tmp_path / "lines")).first()
    assert (line.collection_id, line.embedding, line.authz) == (2, [1.0], "/a")
