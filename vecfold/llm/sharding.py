"""Uniform shuffle into shards of exact sizes by a hypergeometric communication matrix.

Rows are dealt to blocks by a hash. How many rows of each block go to each shard is drawn exactly
(multivariate hypergeometric, shard sizes at most one apart), on counts alone. The matrix is drawn by
halving: the rows of the first half of the blocks are a draw without replacement from all, and so on
down to a block, so every task draws the lines of its own blocks and nobody holds the matrix. Within a
block rows are permuted locally and cut by those numbers, exchanged, and permuted again within their
shard, in parts that keep every task small. All draws depend on a seed and the counts, all permutations
on hashes of the rows, so a lost executor repeats the same result. Only keys and numbers of rows take
part in this; whole rows move once, to their key's shard and slot.

Size is the bytes of the text plus 1; a null text has none. Rows that repeat (same id and text) stay
separate rows: they are numbered first, and each number is dealt and placed by draws of its own. An empty table gives no shards' rows. Law is ``rows``.
"""

from collections.abc import Iterator
from functools import lru_cache
from math import ceil

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from vecfold.llm.tables import numbered, small, stored, uniform, with_key

BLOCK_ROWS = 250_000
MIN_BLOCKS = 4096


def draw_hypergeometric(good: int, bad: int, draws: int, rng: np.random.Generator) -> int:
    """How many of ``draws`` rows out of good + bad are good, by inverting the distribution.

    Looks at 40 standard deviations around the mean, so any size of population takes a small window.
    """
    total = good + bad
    low, high = max(0, draws - bad), min(draws, good)
    if low == high:
        return low
    mean = draws * good / total
    spread = 20 * np.sqrt(max(mean * (bad / total) * (total - draws) / max(1, total - 1), 1.0)) + 20
    first, last = max(low, int(mean - spread)), min(high, int(mean + spread))
    k = np.arange(first, last, dtype=float)
    # Ratio of neighbouring probabilities, summed from the one at ``first``.
    steps = np.log(good - k) + np.log(draws - k) - np.log(k + 1) - np.log(bad - draws + k + 1)
    logs = np.concatenate([[0.0], np.cumsum(steps)])
    weights = np.exp(logs - logs.max())
    return first + int(np.searchsorted(np.cumsum(weights), rng.random() * weights.sum(), "right"))


class Matrix:
    """The communication matrix: rows of each block for each shard, drawn line by line where they are needed.

    ``before`` holds the rows before each block and, at its end, all rows.
    """

    def __init__(self, before: np.ndarray, shards: int, seed: int):
        total = int(before[-1])
        self.before, self.seed = before, seed
        self.sizes = tuple(total // shards + (s < total % shards) for s in range(shards))
        self.first_half = lru_cache(maxsize=4096)(self._first_half)

    def _first_half(self, first: int, end: int, sizes: tuple[int, ...]) -> tuple[int, ...]:
        """How many rows of each shard the first half of the blocks takes, if all of them take ``sizes``."""
        rng = np.random.default_rng([self.seed, first, end])
        draws, rest, drawn = int(self.before[(first + end) // 2] - self.before[first]), sum(sizes), []
        for size in sizes:
            rest -= size
            drawn.append(draw_hypergeometric(size, rest, draws, rng))
            draws -= drawn[-1]
        return tuple(drawn)

    def line(self, block: int) -> tuple[int, ...]:
        first, end, sizes = 0, len(self.before) - 1, self.sizes
        while end - first > 1:
            middle, taken = (first + end) // 2, self.first_half(first, end, sizes)
            if block < middle:
                end, sizes = middle, taken
            else:
                first, sizes = middle, tuple(a - b for a, b in zip(sizes, taken))
        return sizes


def communication_matrix(block_rows: list[int], shards: int, seed: int) -> tuple[list[list[int]], list[int]]:
    """Rows of each block for each shard, and the shards' sizes."""
    matrix = Matrix(np.concatenate([[0], np.cumsum(block_rows, dtype=np.int64)]), shards, seed)
    return [list(matrix.line(b)) for b in range(len(block_rows))], list(matrix.sizes)


def shard_rows(docs: DataFrame, shards: int = 8, seed: int = 1) -> DataFrame:
    """``docs`` (doc_id, text and any other columns) with size, text_crc32, law, shard, slot and grown_shard.

    Columns of ``docs`` that have one of these names give way to the new ones.
    """
    given = with_key(docs, "shard-rows")
    placed = stored(place(measured(given, F.col("_row")), shards, seed), "placed")
    placed = placed.select(F.col("_row").alias("_key"), F.struct("size", "text_crc32", "law", "shard", "slot", "grown_shard").alias("_place"))
    own = [c for c in docs.columns if c not in ("size", "text_crc32", "law", "shard", "slot", "grown_shard")]
    # Whole rows travel as one column, so their names cannot clash with those of this module.
    return given.select("_row", F.struct(*own).alias("_whole")).join(placed, F.col("_row") == F.col("_key")).select(*[F.col("_whole")[c].alias(c) for c in own], "_place.*")


def keyed_places(docs: DataFrame, shards: int, seed: int) -> DataFrame:
    """Size, checksum, shard and slot of every row, without its text."""
    return place(measured(with_key(docs, "shard-rows"), F.col("_row")), shards, seed)


def measured(docs: DataFrame, *more: Column) -> DataFrame:
    text = F.coalesce("text", F.lit(""))
    return docs.select("doc_id", (F.octet_length(text).cast("long") + 1).alias("size"), F.crc32(text.cast("binary")).cast("long").alias("text_crc32"), *more)


def place(rows: DataFrame, shards: int, seed: int) -> DataFrame:
    """Rows with doc_id, size, text_crc32 and the key ``_row``, placed in shards and slots."""
    rows = stored(rows, "shard-keys")
    spark, count = rows.sparkSession, rows.count()
    blocks = max(MIN_BLOCKS, ceil(count / BLOCK_ROWS))
    draw = lambda what: uniform(F.lit(f"{what} {seed}"), "doc_id", "text_crc32", "size", "_copy")
    in_block = lambda c, n: F.floor(c * n).cast("int")
    dealt = numbered(rows, "doc_id", "text_crc32", "size").withColumn("_block", in_block(draw("deal"), blocks))
    dealt = dealt.withColumns({"_first": draw("first"), "_second": draw("second")}).drop("_copy")
    counts = dealt.groupBy("_block").count().collect()  # a number a block of some BLOCK_ROWS rows
    held = np.zeros(blocks + 1, np.int64)
    held[[r["_block"] + 1 for r in counts]] = [r["count"] for r in counts]
    before = np.cumsum(held)

    def drawn(batch_iter: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        matrix = Matrix(before, shards, seed)
        for batch in batch_iter:
            ends = [np.cumsum(matrix.line(b)) for b in batch.column("id").to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column("id").cast(pa.int32()), pa.array(ends, pa.list_(pa.int64()))], ["_block", "_ends"])

    cuts = small(stored(spark.range(blocks).mapInArrow(drawn, "_block int, _ends array<long>"), "matrix"))
    local = Window.partitionBy("_block").orderBy("_first", "_row")
    ranked = dealt.withColumn("_rank", F.row_number().over(local))
    shard = F.size(F.filter("_ends", lambda e: e < F.col("_rank")))
    chosen = ranked.join(cuts, "_block").withColumn("shard", shard.cast("int"))
    # The exchange: rows meet in their shard, which is cut into parts of hash values.
    parts = max(1, blocks // shards)
    chosen = stored(chosen.select("doc_id", "size", "text_crc32", "_row", "shard", in_block(F.col("_second"), parts).alias("_part"), "_second"), "sharded")
    sizes = chosen.groupBy("shard", "_part").agg(F.count(F.lit(1)).alias("_held"))
    earlier = Window.partitionBy("shard").orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    offsets = sizes.select("shard", "_part", F.coalesce(F.sum("_held").over(earlier), F.lit(0)).alias("_offset"))
    within = Window.partitionBy("shard", "_part").orderBy("_second", "_row")
    slotted = chosen.withColumn("_rank", F.row_number().over(within)).join(small(stored(offsets, "offsets")), ["shard", "_part"])
    return slotted.select(
        "doc_id", "size", "text_crc32", "_row", F.lit("rows").alias("law"), "shard", (F.col("_offset") + F.col("_rank") - 1).alias("slot"), F.lit(None).cast("int").alias("grown_shard")
    )
