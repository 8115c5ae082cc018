"""The write path: rows written in proportion to a change, no exchange of stored vectors, replays."""

import os

import pytest
from pyspark.sql import functions as F

from vecfold.operators import changes
from vecfold.plans.store import VectorStore
from vecfold.session import scratch_path
from vecfold.sources import tables
from vecfold.sources.tables import bucket_count, bucket_of

ALLOWED = ["/vectorstore/collections/one", "/vectorstore/collections/two"]
ROWS = 4_000


def numbers(spark, n, collection=1, metadata="{}", start=0):
    """Rows with vectors that follow from their position."""
    vector = F.transform(F.sequence(F.lit(1), F.lit(16)), lambda i: (F.xxhash64("id", i) % 1000).cast("double"))
    return spark.range(start, start + n).select(
        F.col("id").alias("pos"), F.lit(collection).cast("long").alias("collection_id"), vector.alias("embedding"), F.lit(None).cast("string").alias("authz"), F.lit(metadata).alias("metadata")
    )


@pytest.fixture()
def store(spark, monkeypatch):
    monkeypatch.setattr(tables, "BUCKET_ROWS", 4)
    store = VectorStore(spark, scratch_path(spark, "buckets"))
    requested = [(0, "one", None, None, 16, "vector"), (1, "two", None, None, 16, "vector")]
    kinds = "pos long, requested_name string, description string, ai_model_name string, dimensions int, vector_type string"
    store.create_collections(spark.createDataFrame(requested, kinds), ALLOWED)
    return store


def size(store):
    folder = store.tables.root + "/embeddings"
    return sum(os.path.getsize(os.path.join(d, f)) for d, _, files in os.walk(folder) for f in files if f.endswith(".parquet"))


def content(store):
    return sorted((r.collection_id, tuple(r.embedding), r.metadata, r.embedding_id, r.created_at, r.updated_at) for r in store.tables.embeddings().collect())


def test_buckets_follow_the_size():
    assert [bucket_count(n, 64) for n in (0, 100, 1024, 500_000)] == [1, 1, 2, 512]
    assert bucket_count(10**9, 64) * tables.BUCKET_BYTES > 10**9 * 456 and bucket_count(10**9, 64) & (bucket_count(10**9, 64) - 1) == 0


def test_a_small_put_writes_little(spark, store):
    store.insert(numbers(spark, ROWS), ALLOWED, "b0")
    before, whole = {r[3]: r for r in content(store)}, size(store)
    assert store.tables.catalog().where("id = 1").first().buckets == 512
    ids = {r.pos: r.embedding_id for r in store.insert(numbers(spark, 3, collection=2), ALLOWED, "b1").collect()}
    assert len(ids) == 3
    # Five stored rows move, one is updated by id, four are new: as many buckets at most as rows.
    named = sorted(before)[0]
    batch = numbers(spark, 5).withColumn("embedding_id", F.lit(None).cast("string")).unionByName(
        numbers(spark, 1, start=ROWS + 50).withColumn("embedding_id", F.lit(named))
    ).unionByName(numbers(spark, 4, start=ROWS + 100).withColumn("embedding_id", F.lit(None).cast("string")))
    grown = size(store)
    result = {r.input_index: (r.action, r.embedding_id) for r in store.put(batch, ALLOWED, "b2").collect()}
    assert (size(store) - grown) / whole < 0.05
    assert sorted(a for a, _ in result.values()) == ["inserted"] * 4 + ["touched"] * 5 + ["updated"]
    after = {r[3]: r for r in content(store) if r[0] == 1}
    moved = {i for _, i in result.values()}
    assert set(after) == set(before) | moved and len(after) == ROWS + 4
    for i, row in before.items():
        if i not in moved:
            assert after[i] == row
        elif i != named:
            assert after[i][:5] == row[:5] and after[i][5] > row[5]
    assert after[named][1] != before[named][1] and after[named][4] == before[named][4]
    # Every row lies in its bucket, once.
    wrong = store.tables.bucketed(collections=[1]).where(F.col("bucket") != bucket_of(F.lit(512)))
    assert wrong.count() == 0 and store.tables.pieces().where("id = 1").agg(F.sum("rows")).first()[0] == ROWS + 4


def exchanged(frame):
    """Names of the columns that exchanges of a plan carry."""
    names, waiting = set(), [frame._jdf.queryExecution().sparkPlan(), frame._jdf.queryExecution().executedPlan()]
    while waiting:
        node = waiting.pop()
        if node.nodeName() == "AdaptiveSparkPlan":
            waiting.append(node.initialPlan())
        if "Exchange" in node.nodeName() and "Broadcast" not in node.nodeName():
            names |= {node.output().apply(i).name() for i in range(node.output().size())}
        waiting += [node.children().apply(i) for i in range(node.children().size())]
    return names


def test_no_exchange_carries_stored_vectors(spark, store):
    store.insert(numbers(spark, 500), ALLOWED, "b0")
    generation = store.tables.generation()
    batch = numbers(spark, 20).withColumn("embedding_id", F.lit(None).cast("string"))
    _, known, prepared, keys, touched, named = store._start(batch)
    assert "embedding" not in keys.columns and not named and touched == [1]
    change = changes.put(keys, prepared, known, ALLOWED, "b1", F.current_timestamp())
    marked = change.changes
    whole = store.tables.bucketed(generation, [1])
    for size_limit in (changes.BROADCAST_BYTES, 2_000):  # in one block, in several
        kept = changes.rewritten(whole, marked, F.current_timestamp(), size_limit)
        assert "embedding" not in exchanged(kept) and kept.count() == 500
    assert "embedding" in exchanged(whole.repartition(3, "embedding_id"))
    assert "embedding" not in exchanged(change.changes)


def test_blocks_and_shuffle_give_the_same(spark, store, monkeypatch):
    store.insert(numbers(spark, 300), ALLOWED, "b0")
    rows, now = store.tables.bucketed(), F.lit("2030-01-01").cast("timestamp")
    ids = rows.select("collection_id", "embedding_id", "bucket").orderBy("embedding_id").limit(40)
    marked = changes._blank(ids, gone=False).withColumn("gone", F.col("embedding_id") > "8").withColumn("new_metadata", F.when(F.col("embedding_id") < "4", F.lit('{"n":1}')))
    whole = sorted(map(str, changes.rewritten(rows, marked, now).collect()))
    blocks = sorted(map(str, changes.rewritten(rows, marked, now, 1_000).collect()))
    monkeypatch.setattr(changes, "MAX_BLOCKS", 1)
    shuffled = sorted(map(str, changes.rewritten(rows, marked, now, 1_000).collect()))
    assert whole == blocks == shuffled and len(whole) == 300 - marked.where("gone").count()


def test_a_replayed_batch_changes_nothing(spark, store):
    batch = numbers(spark, 30).withColumn("embedding_id", F.lit(None).cast("string"))
    first = store.put(batch, ALLOWED, "feed-0", stream=("feed", 0)).collect()
    before, generation = content(store), store.tables.generation()
    again = store.put(batch, ALLOWED, "feed-0", stream=("feed", 0)).collect()
    assert content(store) == before and store.tables.generation() == generation
    assert [r.embedding_id for r in again] == [r.embedding_id for r in first]
    # Another stream's batch of the same number, and the next batch, count.
    store.put(batch, ALLOWED, "other-0", stream=("other", 0))
    store.put(batch, ALLOWED, "feed-1", stream=("feed", 1))
    assert store.tables.generation() == generation + 2 and content(store) != before
    assert (store.tables.last_batch("feed"), store.tables.last_batch("other"), store.tables.last_batch("none")) == (1, 0, None)


def test_collections_grow_and_pieces_merge(spark, store, monkeypatch):
    monkeypatch.setattr(tables, "MERGED_PIECES", 3)
    held = []
    for i, n in enumerate((1, 3, 40, 2, 2, 2)):
        store.insert(numbers(spark, n, start=1000 * i), ALLOWED, f"b{i}")
        held.append(store.tables.catalog().where("id = 1").first().buckets)
    assert held == [1, 1, 16, 16, 16, 16]
    assert len(content(store)) == 50 == len({r[3] for r in content(store)})
    pieces = store.tables.pieces()
    assert pieces.agg(F.sum("rows")).first()[0] == 50
    assert pieces.groupBy("id", "bucket").count().agg(F.max("count")).first()[0] <= 3
    # A collection that is not asked for is not listed, and deletes leave the others alone.
    one = sorted(r[3] for r in content(store))[0]
    assert store.delete_embeddings(spark.createDataFrame([(1, one)], "collection_id long, embedding_id string"), ALLOWED) == 1
    assert len(content(store)) == 49 and store.tables.embeddings(collections=[2]).count() == 0
    assert store.tables.embeddings(collections=store.tables.collections().where("id = 1")).count() == 49
