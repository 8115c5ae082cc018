"""Reply streams put together as they arrive.

``append_stream`` stores chunks as they come and ``assemble_closed`` puts closed responses together:
no state, no order of arrival, and no response passes through one task. ``assemble_stream`` gives text
out with less delay: the state of a response is its next chunk number and the chunks that came early. Text is given
out as soon as it is in order, so the state does not grow with the response.
"""

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import DataStreamWriter
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from vecfold.operators.deltas import assemble_deltas

def append_stream(chunks: DataFrame, path: str) -> DataStreamWriter:
    """Raw chunks ``response_id, seq, delta, is_last`` of every micro-batch, in a folder of its number."""

    def write(batch: DataFrame, number: int) -> None:
        batch.select("response_id", "seq", "delta", "is_last").write.mode("overwrite").parquet(f"{path}/batch={number}")

    return chunks.writeStream.foreachBatch(write)


def assemble_closed(stored: DataFrame) -> DataFrame:
    """Texts of the responses whose chunks are all there up to the last one.

    Repeated chunks count once. Responses still open stay stored and come with a later call; chunks
    after the last one are ignored.
    """
    chunks = stored.groupBy("response_id", "seq").agg(F.first("delta").alias("delta"), F.max("is_last").alias("is_last"))
    ends = chunks.where("is_last").groupBy("response_id").agg(F.min("seq").alias("end"))
    within = chunks.join(ends, "response_id").where(F.col("seq") <= F.col("end"))
    closed = assemble_deltas(within).join(ends, "response_id")
    return closed.where(F.col("chunks") == F.col("end") + 1).select("response_id", "chunks", "text")


PIECES = "response_id string, seq long, delta string, is_last boolean"
STATE = "next_seq long, early_seq array<long>, early_delta array<string>, early_last array<boolean>"


def _in_order(key: tuple, frames: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
    next_seq, early = 0, {}
    if state.exists:
        next_seq, seqs, texts, lasts = state.get
        early = {s: (t, end) for s, t, end in zip(seqs, texts, lasts)}
    for frame in frames:
        deltas = frame["delta"].where(frame["delta"].notna(), "")
        # A chunk that was given out before is a repeat.
        early.update({s: (t, end) for s, t, end in zip(frame["seq"], deltas, frame["is_last"]) if s >= next_seq})
        first, texts, is_last = next_seq, [], False
        while next_seq in early and not is_last:
            text, is_last = early.pop(next_seq)
            texts.append(text)
            next_seq += 1
        if texts:
            yield pd.DataFrame(
                {"response_id": key[0], "seq": [first], "delta": ["".join(texts)], "is_last": [bool(is_last)]}
            )
        if is_last:
            state.remove()
            return
    waiting = sorted(early)
    state.update(
        (
            int(next_seq),
            [int(s) for s in waiting],
            [early[s][0] for s in waiting],
            [bool(early[s][1]) for s in waiting],
        )
    )


def _in_order_or_abandoned(wait_ms: int):
    """As above; a response whose event time stands still for ``wait_ms`` loses its state."""

    def handle(key: tuple, frames: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        if state.hasTimedOut:
            state.remove()
            return
        yield from _in_order(key, frames, state)
        if state.exists:
            state.setTimeoutTimestamp(state.getCurrentWatermarkMs() + wait_ms)

    return handle


def assemble_stream(chunks: DataFrame, abandoned_after_ms: int | None = None) -> DataFrame:
    """Pieces of text in order from chunks ``response_id, seq, delta, is_last``.

    A piece carries the number of its first chunk, so the batch assembly puts pieces together as
    it does chunks. With ``abandoned_after_ms`` the chunks need a watermark, and the state of a
    response that stays unfinished that long is dropped.
    """
    grouped = chunks.groupBy("response_id")
    if abandoned_after_ms is None:
        return grouped.applyInPandasWithState(_in_order, PIECES, STATE, "append", GroupStateTimeout.NoTimeout)
    handle = _in_order_or_abandoned(abandoned_after_ms)
    return grouped.applyInPandasWithState(handle, PIECES, STATE, "append", GroupStateTimeout.EventTimeTimeout)
