"""Replies closed in rounds: closed chunks are not read again, and any cut into rounds gives the batch result."""

import pytest
from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from vecfold.operators import deltas
from vecfold.streaming import replies
from vecfold.streaming.deltas import assemble_closed
from vecfold.streaming.files import run_available

BATCHES = [
    [("a", 1, "B", False), ("a", 0, "A", False), ("b", 0, "whole", True), ("open", 0, "x", False), (None, 0, "?", True), ("n", None, "?", True)],
    [("a", 0, "again", False), ("a", 3, "D", True), ("b", 0, "late", True), ("b", 1, "after", False), ("c", 0, None, None), ("c", 1, "!", True)],
    [("a", 2, "C", False), ("a", 4, "after", False), ("gap", 5, "end", True), ("a", 4, "after", True)],
]


def arrive(spark, log, folder, number, rows):
    """One more file, brought by the stream as one micro-batch."""
    spark.createDataFrame(rows, replies.CHUNKS).coalesce(1).write.parquet(f"{folder}/in/part={number}")
    stream = spark.readStream.schema(replies.CHUNKS).parquet(f"{folder}/in/part=*")
    run_available(log.append(stream), f"{folder}/progress")


def texts(frame):
    return {r.response_id: (r.chunks, r.text) for r in frame.collect()}


def test_rounds_read_new_and_open_chunks_only(spark, tmp_path):
    log, folder = replies.ReplyLog(spark, str(tmp_path / "log")), str(tmp_path)
    assert log.close().count() == 0 and log.closed().count() == 0
    want = [{"b": (1, "whole")}, {"c": (2, "!")}, {"a": (4, "ABCD")}]
    for number, rows in enumerate(BATCHES):
        arrive(spark, log, folder, number, rows)
        files = log.pending().inputFiles()
        assert {f.split("/batch=")[1].split("/")[0] for f in files if "/batch=" in f} == {str(number)}
        assert texts(log.close()) == want[number]
        # No chunk of a closed reply waits for the next round.
        still = {r.response_id for r in log.pending().select("response_id").distinct().collect()}
        assert not still & {"b", "c"}
    assert log.close().count() == 0
    assert {r.response_id: r["round"] for r in log.closed().collect()} == {"b": 1, "c": 2, "a": 3}
    assert {r.response_id for r in log.pending().collect()} == {"open", "gap"}


def test_of_two_rounds_one_wins(spark, tmp_path, monkeypatch):
    log, folder = replies.ReplyLog(spark, str(tmp_path / "log")), str(tmp_path)
    arrive(spark, log, folder, 0, BATCHES[0])
    other, publish = replies.ReplyLog(spark, log.root), log._publish

    def late(number, lines):
        other.close()
        publish(number, lines)

    monkeypatch.setattr(log, "_publish", late)
    with pytest.raises(replies.StaleRound):
        log.close()
    assert texts(other.closed()) == {"b": (1, "whole")}


def test_a_hot_reply_is_closed_as_any_other(spark, tmp_path, monkeypatch):
    monkeypatch.setattr("vecfold.operators.skew.HOT_ROWS", 1000)
    n, log = 12_000, replies.ReplyLog(spark, str(tmp_path / "log"))
    rows = spark.range(n).select(
        F.when(F.col("id") % 3 == 0, "hot").otherwise(F.concat(F.lit("r"), "id")).alias("response_id"),
        F.when(F.col("id") % 3 == 0, F.col("id") / 3).otherwise(0).cast("long").alias("seq"),
        F.concat("id", F.lit(",")).alias("delta"),
        ((F.col("id") % 3 != 0) | (F.col("id") == n - 3)).alias("is_last"),
    )
    rows.write.parquet(str(tmp_path / "in"))
    run_available(log.append(spark.readStream.schema(replies.CHUNKS).parquet(str(tmp_path / "in"))), str(tmp_path / "progress"))
    closed = log.close()
    assert closed.count() == 1 + n * 2 // 3
    assert closed.where("response_id = 'hot'").first().text == "".join(f"{i}," for i in range(0, n, 3))


chunk = st.tuples(st.sampled_from("abc"), st.integers(0, 3), st.booleans())


@settings(max_examples=3, deadline=None, suppress_health_check=[HealthCheck.function_scoped_fixture])
@given(rounds=st.lists(st.lists(chunk, min_size=1, max_size=8), min_size=1, max_size=3))
def test_what_closes_is_what_a_plain_replay_closes(spark, tmp_path_factory, rounds):
    folder = str(tmp_path_factory.mktemp("rounds"))
    log = replies.ReplyLog(spark, folder + "/log")
    seen, want = {}, {}
    for number, rows in enumerate(rounds):
        rows = [(reply, seq, f"{seq}{reply}", last) for reply, seq, last in rows]
        arrive(spark, log, folder, number, rows)
        log.close()
        for reply, seq, text, last in rows:
            if reply not in want:
                held = seen.setdefault(reply, {})
                held[seq] = (text, last or held.get(seq, ("", False))[1])
        for reply, held in seen.items():
            end = min((s for s, (_, last) in held.items() if last), default=None)
            if reply not in want and end is not None and all(s in held for s in range(end + 1)):
                want[reply] = (end + 1, "".join(held[s][0] for s in range(end + 1)))
    assert texts(log.closed()) == want


def test_one_round_equals_the_batch(spark, sf_dir, tmp_path):
    from vecfold.sources import fixtures

    chunks = fixtures.chunks_of(fixtures.conversations(spark, sf_dir))
    chunks.write.parquet(str(tmp_path / "in"))
    log = replies.ReplyLog(spark, str(tmp_path / "log"))
    run_available(log.append(spark.readStream.schema(chunks.schema).parquet(str(tmp_path / "in"))), str(tmp_path / "progress"))
    assert texts(log.close()) == texts(assemble_closed(chunks)) == texts(deltas.assemble_deltas(chunks))
