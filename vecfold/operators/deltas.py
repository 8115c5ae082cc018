"""Reply streams logged as chunks (``response_id, seq, delta``): final texts and event lists.

Chunks of one response count from 0. Texts are joined in parts first, so a response that makes up a
large share of all chunks is spread over tasks like any other data; the parts give one text.
"""

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

# Event types of the reply stream protocol.
ITEM_ADDED = "response.output_item.added"
PART_ADDED = "response.content_part.added"
TEXT_DELTA = "response.output_text.delta"
TEXT_DONE = "response.output_text.done"
ITEM_DONE = "response.output_item.done"

# Chunks joined at a time, before the parts of a response are.
CHUNKS_PER_PART = 4096


def number_chunks(chunks: DataFrame, bucket: int = CHUNKS_PER_PART) -> DataFrame:
    """Chunks with gaps in ``seq`` renumbered densely from 0 in order.

    Counts per bucket of ``seq`` give each bucket its offset, and rows are ranked within their
    bucket: no response has to be sorted in one task.
    """
    slotted = chunks.withColumn("slot", F.floor(F.col("seq") / bucket))
    counts = slotted.groupBy("response_id", "slot").agg(F.count(F.lit(1)).alias("n"))
    before = Window.partitionBy("response_id").orderBy("slot").rowsBetween(Window.unboundedPreceding, -1)
    offsets = counts.select("response_id", "slot", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("offset"))
    rank = F.row_number().over(Window.partitionBy("response_id", "slot").orderBy("seq"))
    ranked = slotted.withColumn("rank", rank).join(offsets, ["response_id", "slot"])
    return ranked.select(
        *[(F.col("offset") + F.col("rank") - 1).alias("seq") if c == "seq" else F.col(c) for c in chunks.columns]
    )


def assemble_deltas(chunks: DataFrame, part_size: int = CHUNKS_PER_PART) -> DataFrame:
    """The whole text of each response, one row whatever its number of chunks.

    Texts are joined in parts of ``part_size`` chunk numbers first, which spreads a long response over
    tasks; its parts then meet in a row that holds no more than the text itself. A text that does not
    fit into a cell (2 GB) fails the job. A chunk without text counts as empty.
    """
    rows = chunks.select(
        "response_id",
        F.floor(F.col("seq") / part_size).alias("part"),
        F.struct("seq", F.coalesce("delta", F.lit("")).alias("delta")).alias("chunk"),
    )
    parts = rows.groupBy("response_id", "part").agg(F.sort_array(F.collect_list("chunk")).alias("ordered"))
    parts = parts.select(
        "response_id",
        F.size("ordered").cast("long").alias("chunks"),
        F.struct("part", F.array_join(F.transform("ordered", lambda c: c["delta"]), "").alias("text")).alias("part"),
    )
    whole = parts.groupBy("response_id").agg(
        F.sum("chunks").cast("int").alias("chunks"), F.sort_array(F.collect_list("part")).alias("parts")
    )
    return whole.select("response_id", "chunks", F.array_join(F.transform("parts", lambda p: p["text"]), "").alias("text"))


def stream_events(chunks: DataFrame, part_size: int = CHUNKS_PER_PART) -> DataFrame:
    """The event list of each response: item added, part added, deltas, text done, item done.

    Positions follow from the chunk numbers, so only the texts are grouped, once.
    """
    nothing = F.lit(None).cast("string")
    deltas = chunks.select(
        "response_id",
        (F.col("seq") + 2).cast("long").alias("sequence_number"),
        F.lit(TEXT_DELTA).alias("type"),
        F.coalesce("delta", F.lit("")).alias("text"),
    )

    def event(number: Column, kind: str, text: Column = nothing) -> Column:
        return F.struct(number.cast("long").alias("sequence_number"), F.lit(kind).alias("type"), text.alias("text"))

    n = F.col("chunks")
    around = F.array(
        event(F.lit(0), ITEM_ADDED), event(F.lit(1), PART_ADDED), event(n + 2, TEXT_DONE, F.col("text")), event(n + 3, ITEM_DONE)
    )
    return deltas.unionByName(assemble_deltas(chunks, part_size).select("response_id", F.inline(around)))


def stream_usage(chunks: DataFrame) -> DataFrame:
    """Per response the usage of the last chunk that carries one."""
    seq = F.when(F.col("usage").isNotNull(), F.col("seq"))
    return chunks.groupBy("response_id").agg(F.max_by("usage", seq).alias("usage"))
