"""Exact nearest neighbours for a table of queries that skips cells of vectors which cannot win.

Vectors and queries are put into cells around centroids. A query first meets its own cell; the k-th best
there, or a given bound on the value, limits how far a better vector can be. By the triangle inequality a
cell whose vectors all lie further away is never compared with the query. Queries are cut into blocks of
bounded size, each of cells that lie together. A block gets the cells that one of its queries must meet,
and each of its queries is compared with its own cells of these only. In a task the vectors stream past a
block, so what it holds grows neither with the vectors nor with the cells, and no row is ever made for a
query and a cell. Neither a cell with a third of all vectors nor one that all queries ask for is gathered
in a task. Results are those of :func:`knn.knn_batch`, ties included.

Vectors of length zero have no cosine: they rank by id alone, first as a similarity and last as a
distance, so the ``top_k`` of them with the smallest ids are compared with every query, and queries of
length zero with the ``top_k`` smallest ids of all.
"""

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from vecfold.functions.vectors import as_matrix
from vecfold.operators import knn
from vecfold.operators.search import BadRequest
from vecfold.operators.spaces import COSINE, Space, distances, in_cells, longest_vector, trained_centroids
from vecfold.schemas import DEFAULT_TOP_K, Metric
from vecfold.session import materialize

CELL_ROWS = 1_000
MAX_CELLS = 4_096
SAMPLE_ROWS = 20_000
# Vectors that a task compares with a block of queries, and queries of a block, in rows and in bytes as doubles.
PART_ROWS = 500_000
QUERY_ROWS = 20_000
QUERY_BYTES = 16 * 1024 * 1024
# Smaller tables are cut for about so many tasks, and so many partitions at most hold those of larger ones.
TASKS = 24
MAX_PARTITIONS = 2_000


def _limits(space: Space, values: np.ndarray, queries: np.ndarray, bounds: tuple) -> np.ndarray:
    """How far from its query a vector can be that is no worse than the k-th best and within bounds."""
    limit = space.reach(values, queries)
    worst = bounds[1] if space.metric.ascending else bounds[0]
    if worst is not None:
        limit = np.minimum(limit, space.reach(np.full(len(queries), float(worst)), queries))
    return limit


@dataclass(frozen=True)
class Cells:
    """Centroids with the number of vectors in each cell and their least and largest distance to it."""

    space: Space
    centroids: np.ndarray
    counts: np.ndarray
    least: np.ndarray
    most: np.ndarray
    bounds: tuple

    def open(self, queries: pa.Table | pa.RecordBatch, matrix: np.ndarray, cells: np.ndarray) -> np.ndarray:
        """Which of these cells, other than its own, each query (known, cell) must still meet."""
        known = queries.column("known").to_numpy(zero_copy_only=False).astype(np.float64)
        far = distances(self.space.queries(matrix), self.centroids[cells])
        least = np.maximum(np.maximum(far - self.most[None, cells], self.least[None, cells] - far), 0.0)
        limit = _limits(self.space, known, matrix, self.bounds)
        return (least <= limit[:, None]) & (cells[None, :] != _numbers(queries, "cell")[:, None])


def _numbers(rows: pa.Table | pa.RecordBatch, name: str) -> np.ndarray:
    return rows.column(name).to_numpy(zero_copy_only=False)


def _open_cells(requests: DataFrame, cells: Cells) -> DataFrame:
    """(block, cell, asked): the cells that queries of a block must still meet, and how many of them."""
    held = np.flatnonzero(cells.counts)

    def route(batch_iter: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        asked: dict[int, np.ndarray] = {}
        for batch in batch_iter:
            for at in range(0, batch.num_rows, 512):
                part = batch.slice(at, 512)
                open_ = cells.open(part, as_matrix(part.column("embedding")), held)
                blocks = _numbers(part, "block")
                for block in np.unique(blocks):
                    asked[block] = asked.get(block, 0) + open_[blocks == block].sum(axis=0)
        for block, count in asked.items():
            some = count > 0
            columns = [np.full(some.sum(), block, np.int32), held[some].astype(np.int32), count[some].astype(np.int64)]
            yield pa.RecordBatch.from_arrays([pa.array(c) for c in columns], ["block", "cell", "asked"])

    found = requests.select("block", "embedding", "known", "cell").mapInArrow(route, "block int, cell int, asked long")
    return found.groupBy("block", "cell").agg(F.sum("asked").alias("asked"))


def _together(centroids: np.ndarray, cells: np.ndarray) -> np.ndarray:
    """The cells in an order in which neighbours lie together: halved again and again along the widest dimension."""
    if len(cells) <= 2:
        return cells
    points = centroids[cells]
    order = np.argsort(points[:, np.ptp(points, axis=0).argmax()], kind="stable")
    half = len(cells) // 2
    return np.concatenate([_together(centroids, cells[order[:half]]), _together(centroids, cells[order[half:]])])


def _query_blocks(asked: dict[int, int], cells: Cells, rows: int) -> list[tuple[int, int, int]]:
    """(cell, first block, blocks) for the cells of queries: several cells in a block, or several blocks for a large cell."""
    dealt, block, held = [], 0, 0
    for cell in _together(cells.centroids, np.array(sorted(asked))).tolist():
        n = asked[cell]
        if held and held + n > rows:
            block, held = block + 1, 0
        blocks = -(-n // rows)
        dealt.append((cell, block, blocks))
        block, held = (block + blocks, 0) if blocks > 1 else (block, held + n)
    return dealt


class _Asking:
    """Queries (query_id, embedding, known, cell) that vectors stream past."""

    def __init__(self, queries: pa.Table, cells: Cells, k: int, own: bool):
        self.queries, self.cells, self.own = queries, cells, own
        self.matrix = as_matrix(queries.column("embedding").combine_chunks())
        known = _numbers(queries, "known").astype(np.float64)
        self.best = knn.BestPerQuery(cells.space.metric, k, _numbers(queries, "query_id"), self.matrix, *cells.bounds, known)

    def meet(self, ids: np.ndarray, vectors: np.ndarray, cell: np.ndarray) -> None:
        """Compares each query with the vectors, sorted by cell, of its own cell or of the open others."""
        numbers, starts, sizes = np.unique(cell, return_index=True, return_counts=True)
        if self.own:
            wanted = _numbers(self.queries, "cell")[:, None] == numbers[None, :]
        else:
            wanted = self.cells.open(self.queries, self.matrix, numbers)
        asked = wanted.sum(axis=0)
        # Cells that all queries must meet are compared at once.
        everyone = np.repeat(asked == len(wanted), sizes)
        if everyone.all():
            self.best.meet(ids, vectors)
        elif everyone.any():
            self.best.meet(ids[everyone], vectors[everyone])
        for i in np.flatnonzero((asked > 0) & (asked < len(wanted))):
            here = slice(starts[i], starts[i] + sizes[i])
            self.best.meet(ids[here], vectors[here], np.flatnonzero(wanted[:, i]))


def _meet(placed: DataFrame, requests: DataFrame, meets: DataFrame, cells: Cells, k: int, part_rows: int, own: bool = False) -> DataFrame:
    """Neighbour lists of the requests (query_id, embedding, known, cell, block), whose blocks meet the cells of ``meets`` (block, cell).

    A job is a block and a part of its vectors, which follow the queries in the order of their cells.
    """
    spark = placed.sparkSession
    counts = spark.createDataFrame([(int(c), int(cells.counts[c])) for c in np.flatnonzero(cells.counts)], "cell int, count long")
    sizes = meets.join(F.broadcast(counts), "cell").groupBy("block").agg(F.sum("count").alias("count")).orderBy("block").collect()  # a row a block
    jobs, first = [], 0
    for block, count in sizes:
        jobs.append((block, first, -(-count // part_rows)))
        first += jobs[-1][-1]
    jobs = F.broadcast(spark.createDataFrame(jobs, "block int, first int, parts int"))
    # Four bytes for a cell and a block.
    blocks_of = F.broadcast(meets.groupBy("cell").agg(F.collect_list("block").alias("blocks")))
    left = placed.join(blocks_of, "cell").withColumn("block", F.explode("blocks")).join(jobs, "block")
    left = left.select(
        (F.col("first") + F.pmod(F.xxhash64("embedding_id"), F.col("parts")).cast("int")).alias("job"),
        F.lit(True).alias("is_vector"),
        "cell",
        "embedding",
        "embedding_id",
        F.lit(None).cast("long").alias("query_id"),
        F.lit(None).cast("double").alias("known"),
    )
    right = requests.join(jobs, "block").select(
        F.explode(F.sequence("first", F.col("first") + F.col("parts") - 1)).alias("job"),
        F.lit(False).alias("is_vector"),
        "cell",
        "embedding",
        F.lit(None).cast("string").alias("embedding_id"),
        "query_id",
        "known",
    )

    def compare(batch_iter: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        job, queries, asking = None, [], []
        for batch in batch_iter:
            numbers, of_vectors = _numbers(batch, "job"), _numbers(batch, "is_vector").astype(bool)
            cuts = np.flatnonzero((numbers[1:] != numbers[:-1]) | (of_vectors[1:] != of_vectors[:-1])) + 1
            for start, end in zip([0, *cuts.tolist()], [*cuts.tolist(), batch.num_rows]):
                if start == end:
                    continue
                part = batch.slice(start, end - start)
                if numbers[start] != job:
                    yield from (some.best.batch() for some in asking)
                    job, queries, asking = numbers[start], [], []
                if not of_vectors[start]:
                    queries.append(part.select(["query_id", "embedding", "known", "cell"]))
                    continue
                if queries:
                    every, queries = pa.Table.from_batches(queries), []
                    asking = [_Asking(every.slice(at, knn.QUERIES_AT_ONCE), cells, k, own) for at in range(0, every.num_rows, knn.QUERIES_AT_ONCE)]
                ids, vectors, cell = knn._ids(part.column("embedding_id")), as_matrix(part.column("embedding")), _numbers(part, "cell")
                for some in asking:
                    some.meet(ids, vectors, cell)
        yield from (some.best.batch() for some in asking)

    dealt = left.unionByName(right).repartitionById(max(1, min(first, MAX_PARTITIONS)), "job").sortWithinPartitions("job", "is_vector", "cell")
    return dealt.mapInArrow(compare, knn.NEIGHBOURS)


def knn_pruned(vectors: DataFrame, queries: DataFrame, **options) -> DataFrame:
    """The ``top_k`` rows of ``vectors`` nearest to each of ``queries (query_id, embedding)``, as ``knn_batch``."""
    return knn_counted(vectors, queries, **options)[0]


def knn_counted(
    vectors: DataFrame,
    queries: DataFrame,
    *,
    metric: Metric | str = Metric.cosine_similarity,
    top_k: int = DEFAULT_TOP_K,
    min_value: float | None = None,
    max_value: float | None = None,
    cell_rows: int = CELL_ROWS,
    seed: int = 0,
) -> tuple[DataFrame, int, int]:
    """The neighbours, the pairs of a query and a vector that were compared, and all such pairs."""
    metric, bounds = Metric(metric), (min_value, max_value)
    if top_k < 1:
        raise BadRequest("top_k must be at least 1")
    vectors = vectors.select("embedding_id", "embedding")
    # Vectors and queries share a column: in single precision if both are, which halves what is moved.
    single = all(rows.schema["embedding"].dataType.elementType == T.FloatType() for rows in (vectors, queries))
    queries = queries.select("query_id", F.col("embedding").cast("array<float>" if single else "array<double>").alias("embedding"))
    whole, asking, more = vectors, queries, []
    options = {"metric": metric, "top_k": top_k, "min_value": min_value, "max_value": max_value}
    if metric in COSINE:
        nonzero = F.exists("embedding", lambda v: v != 0)
        of_zero, whole, asking = queries.where(~nonzero), vectors.where(nonzero), queries.where(nonzero)
        first = lambda rows: rows.orderBy("embedding_id").limit(top_k)
        zeros = materialize(first(vectors.where(~nonzero)), "zeros")
        if not zeros.isEmpty():
            more.append(knn.knn_batch(zeros, asking, **options).drop("rank"))
        if not of_zero.isEmpty():
            more.append(knn.knn_batch(first(vectors), of_zero, **options).drop("rank"))
    space = Space(metric, longest_vector(whole))
    count = whole.count()
    centroids = trained_centroids(whole, space, min(MAX_CELLS, -(-count // cell_rows)), SAMPLE_ROWS, seed)
    pairs = 0
    if len(centroids):
        placed = materialize(in_cells(whole, space, centroids), "placed")
        at_home = materialize(in_cells(asking, space, centroids, of_queries=True).drop("radius"), "queries")
        cells = _held(placed, space, centroids, bounds)
        asked = {r.cell: r["count"] for r in at_home.groupBy("cell").count().collect()}  # a row a cell
        block_rows, part_rows = _cut(count, sum(asked.values()), max(1, centroids.shape[1]))
        dealt = _query_blocks(asked, cells, block_rows)
        spark = vectors.sparkSession
        blocks = F.broadcast(spark.createDataFrame(dealt, "cell int, first int, blocks int"))
        number = F.col("first") + F.pmod(F.xxhash64("query_id", "embedding"), F.col("blocks")).cast("int")
        at_home = at_home.join(blocks, "cell").select("query_id", "embedding", "cell", number.alias("block"))
        own = [(first + i, cell) for cell, first, n in dealt if cells.counts[cell] for i in range(n)]
        own = spark.createDataFrame(own, "block int, cell int")
        early = materialize(_meet(placed, at_home.withColumn("known", F.lit(float("nan"))), own, cells, top_k, part_rows, own=True), "early")
        kth = knn._ranked(early, metric).where(F.col("rank") == top_k).select("query_id", F.col("value").alias("known"))
        found = at_home.join(kth, "query_id", "left").withColumn("known", F.coalesce("known", F.lit(float("nan"))))
        # A file a block, so that a task counts the cells of few blocks.
        files = max((first + n for _, first, n in dealt), default=1)
        found = materialize(found.repartitionById(min(files, MAX_PARTITIONS), "block"), "later")
        open_ = materialize(_open_cells(found, cells), "open")
        late = _meet(placed, found, open_.select("block", "cell"), cells, top_k, part_rows)
        more = [early, late, *more]
        asked_late = {r.cell: r["asked"] for r in open_.groupBy("cell").agg(F.sum("asked").alias("asked")).collect()}  # a row a cell
        pairs = sum(int(cells.counts[cell]) * n for found in (asked, asked_late) for cell, n in found.items())
    if not more:
        return placed_nothing(queries), 0, 0
    lists = more[0]
    for part in more[1:]:
        lists = lists.unionByName(part)
    return knn._ranked(lists, metric).where(F.col("rank") <= top_k), pairs, count * asking.count()


def _held(placed: DataFrame, space: Space, centroids: np.ndarray, bounds: tuple) -> Cells:
    stats = placed.groupBy("cell").agg(F.count(F.lit(1)).alias("count"), F.min("radius").alias("least"), F.max("radius").alias("most"))
    counts, least, most = np.zeros(len(centroids), np.int64), np.zeros(len(centroids)), np.zeros(len(centroids))
    for r in stats.collect():  # a row a cell
        counts[r.cell], least[r.cell], most[r.cell] = r["count"], r.least, r.most
    return Cells(space, centroids, counts, least, most, bounds)


def _cut(vectors: int, queries: int, dimensions: int) -> tuple[int, int]:
    """Rows of a block of queries and of a part of the vectors.

    Few rows are cut on both sides, so that about TASKS tasks have work and little is moved: a vector moves
    once for each block, a query for each part, with a list of neighbours that weighs about two queries more.
    """
    rows = max(1, min(QUERY_ROWS, QUERY_BYTES // (8 * dimensions)))
    blocks = max(-(-queries // rows), min(TASKS, -int(-((3 * TASKS * queries / max(1, vectors)) ** 0.5) // 1)))
    rows = max(1, min(rows, -(-queries // max(1, blocks))))
    return rows, max(1, min(PART_ROWS, -(-vectors * blocks // TASKS)))


def placed_nothing(queries: DataFrame) -> DataFrame:
    return queries.sparkSession.createDataFrame([], f"{knn.NEIGHBOURS}, rank int")
