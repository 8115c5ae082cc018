"""Reply streams and streaming jobs: any cut of the input gives what the batch job gives."""

import hashlib
from urllib.parse import unquote

from pyspark.sql import functions as F

from vecfold.operators import deltas
from vecfold.plans.registry import QUERIES
from vecfold.plans.store import VectorStore
from vecfold.session import scratch_path
from vecfold.sources import fixtures, manifest
from vecfold.streaming import counter, put
from vecfold.streaming import deltas as delta_stream
from vecfold.streaming.files import read_table_stream, run_available, to_table

CHUNK = "response_id string, seq long, delta string"


def test_a_long_response_is_one_text(spark):
    n = 30_000
    chunks = spark.range(0, n, 1, 7).select(
        F.when(F.col("id") % 3 == 0, F.lit("hot")).otherwise(F.concat(F.lit("r"), F.col("id"))).alias("response_id"),
        F.when(F.col("id") % 3 == 0, F.col("id") / 3).otherwise(F.lit(0)).cast("long").alias("seq"),
        F.concat(F.col("id").cast("string"), F.lit(",")).alias("delta"),
    )
    want = "".join(f"{i}," for i in range(0, n, 3))
    hot = deltas.assemble_deltas(chunks).where("response_id = 'hot'").collect()
    assert [(r.chunks, r.text) for r in hot] == [(10_000, want)]
    events = deltas.stream_events(chunks).where("response_id = 'hot'")
    numbers = [r.sequence_number for r in events.select("sequence_number").orderBy("sequence_number").collect()]
    assert numbers == list(range(10_000 + 4))
    done = events.where(F.col("type") == deltas.TEXT_DONE).collect()
    assert [(d.sequence_number, d.text) for d in done] == [(10_002, want)]


def test_stored_chunks_equal_the_batch(spark, tmp_path):
    schema = CHUNK + ", is_last boolean"
    batches = [
        [("a", 1, "B", False), ("a", 0, "A", False), ("b", 2, "!", True), ("open", 0, "x", False)],
        [("a", 0, "A", False), ("a", 3, "D", True), ("b", 0, "x", False), ("gap", 5, "end", True)],
        [("a", 2, "C", False), ("b", 1, None, False), ("a", 4, "after", False)],
    ]
    path = str(tmp_path / "stored")
    run_available(delta_stream.append_stream(write_batches(spark, tmp_path, batches, schema), path), str(tmp_path / "progress"))
    got = {r.response_id: (r.chunks, r.text) for r in delta_stream.assemble_closed(spark.read.parquet(path)).collect()}
    assert got == {"a": (4, "ABCD"), "b": (3, "x!")}


def test_a_chunk_without_text_is_empty(spark):
    chunks = spark.createDataFrame([("a", 0, "x"), ("a", 1, None), ("a", 2, "y")], CHUNK)
    assert deltas.assemble_deltas(chunks).first().text == "xy"


def test_gaps_are_closed(spark):
    chunks = spark.createDataFrame([("a", s, str(s)) for s in (3, 10, 11, 500, 20)] + [("b", 7, "7")], CHUNK)
    got = deltas.number_chunks(chunks, bucket=10).orderBy("response_id", "seq").collect()
    assert [(r.response_id, r.seq, r.delta) for r in got] == [
        ("a", 0, "3"), ("a", 1, "10"), ("a", 2, "11"), ("a", 3, "20"), ("a", 4, "500"), ("b", 0, "7"),
    ]


def write_batches(spark, tmp_path, batches, schema):
    """One file per batch, in the order they are to arrive."""
    for number, rows in enumerate(batches):
        spark.createDataFrame(rows, schema).coalesce(1).write.parquet(str(tmp_path / f"in/{number}"))
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in/*"))


def test_stream_puts_late_and_repeated_chunks_in_order(spark, tmp_path):
    schema = CHUNK + ", is_last boolean"
    batches = [
        [("a", 1, "B", False), ("a", 0, "A", False), ("b", 2, "!", True)],
        [("a", 0, "A", False), ("a", 3, "D", True), ("b", 0, "x", False)],
        [("a", 2, "C", False), ("b", 1, None, False), ("c", 1, "lost", True)],
    ]
    pieces = to_table(delta_stream.assemble_stream(write_batches(spark, tmp_path, batches, schema)), "pieces")
    rows = sorted((r.response_id, r.seq, r.delta, r.is_last) for r in pieces.collect())
    assert rows == [("a", 0, "AB", False), ("a", 2, "CD", True), ("b", 0, "x", False), ("b", 1, "!", True)]
    texts = {r.response_id: r.text for r in deltas.assemble_deltas(pieces).collect()}
    assert texts == {"a": "ABCD", "b": "x!"}


def test_abandoned_responses_leave_the_state(spark, tmp_path):
    schema = CHUNK + ", is_last boolean, at timestamp_ntz"
    batches = [
        [("gone", 0, "A", False, _time(0)), ("gone", 2, "C", False, _time(0))],
        [("other", 0, "x", True, _time(120))],
        [("other2", 0, "x", True, _time(121))],
        [("gone", 1, "B", True, _time(122))],
    ]
    stream = write_batches(spark, tmp_path, batches, schema).withColumn("ts", F.col("at").cast("timestamp"))
    watched = stream.withWatermark("ts", "1 minute")
    pieces = to_table(delta_stream.assemble_stream(watched, abandoned_after_ms=60_000), "pieces").collect()
    assert ("gone", 0, "A") in {(r.response_id, r.seq, r.delta) for r in pieces}
    assert not any(r.response_id == "gone" and "B" in r.delta for r in pieces)


def _time(minutes):
    import datetime

    return datetime.datetime(2024, 1, 1) + datetime.timedelta(minutes=minutes)


def test_streamed_puts_equal_one_put_and_replays_change_nothing(spark, sf_dir, tmp_path):
    batch = fixtures.incoming_batch(spark, sf_dir)
    allowed = fixtures.OWNER
    catalog = fixtures.collections(spark, sf_dir)

    def content(store):
        return sorted(
            (r.collection_id, r.authz, r.metadata, tuple(r.embedding)) for r in store.tables.embeddings().collect()
        )

    one = VectorStore(spark, scratch_path(spark, "one"))
    one.tables.commit(catalog)
    one.put(batch, allowed, "b")
    for part in range(3):
        batch.where(F.col("pos") % 3 == part).coalesce(1).write.parquet(str(tmp_path / f"in/{part}"))
    stream = spark.readStream.schema(batch.schema).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in/*"))
    many = VectorStore(spark, scratch_path(spark, "many"))
    many.tables.commit(catalog)
    run_available(put.put_stream(many, stream, allowed, "feed"), scratch_path(spark, "progress"))
    assert content(many) == content(one)
    ids = {r.embedding_id for r in many.tables.embeddings().collect()}
    run_available(put.put_stream(many, stream, allowed, "feed"), scratch_path(spark, "progress"))
    assert {r.embedding_id for r in many.tables.embeddings().collect()} == ids


def test_all_minutes_come_out(spark, sf_dir, tmp_path):
    stream = read_table_stream(spark, sf_dir, "events.parquet", fixtures.SCHEMAS["events"])
    path = str(tmp_path / "minutes")
    run_available(counter.minute_counts_stream(fixtures.request_log_of(stream), path), str(tmp_path / "progress"))
    counted = counter.requests_by_minute(spark.read.parquet(path)).agg(F.sum("requests")).first()[0]
    assert counted == fixtures.request_log(spark, sf_dir).where("path <> '/docs/'").count()


def test_file_manifest(spark, tmp_path):
    (tmp_path / "sub/more/and more").mkdir(parents=True)
    (tmp_path / "hollow").mkdir()
    contents = {"a.bin": b"abc", "sub/b.bin": b"x" * 5000, "sub/empty": b"", "with space%.bin": b"y" * 300, ".hidden": b"h", "sub/more/and more/ü#?": b"z"}
    for name, data in contents.items():
        (tmp_path / name).write_bytes(data)
    for limit in (100, 10**6):
        rows = {unquote(r.path.split(f"{tmp_path.name}/")[1]): r for r in manifest.file_manifest(spark, str(tmp_path), limit).collect()}
        assert set(rows) == set(contents)
        for name, data in contents.items():
            assert rows[name].size == len(data)
            assert rows[name].commit_id == hashlib.sha256(data).hexdigest()
            assert rows[name].etag == hashlib.md5(data).hexdigest()
    assert manifest.file_manifest(spark, str(tmp_path / "hollow")).count() == 0
    listed = {unquote(r.path.split(f"{tmp_path.name}/")[1]): r.size for r in manifest.list_files(spark, str(tmp_path)).collect()}
    assert listed == {name: len(data) for name, data in contents.items()}


def test_blocks_give_the_digest_of_the_whole(spark, tmp_path, monkeypatch):
    data = bytes(range(256)) * 1000
    (tmp_path / "big").write_bytes(data)
    monkeypatch.setattr(manifest, "BLOCK_BYTES", 1000)
    row = manifest.file_manifest(spark, str(tmp_path)).first()
    assert (row.size, row.commit_id) == (len(data), hashlib.sha256(data).hexdigest())


def test_tables_of_several_files_are_streamed_whole(spark, sf_dir, tmp_path):
    """A table may be one file or a folder of files."""
    for name in ("conversations", "embeddings"):
        rows = fixtures.table(spark, sf_dir, name)
        rows.limit(40).repartition(3).write.parquet(f"{tmp_path}/{name}.parquet")
        whole = read_table_stream(spark, str(tmp_path), f"{name}.parquet", fixtures.SCHEMAS[name])
        assert to_table(whole, f"whole-{name}").count() == 40
    want = fixtures.table(spark, str(tmp_path), "conversations").selectExpr("concat_ws('-', 'r', conv_id, turn)", "text").collect()
    assert sorted(map(tuple, QUERIES["stream_deltas"](spark, str(tmp_path)).collect())) == sorted(map(tuple, want))
