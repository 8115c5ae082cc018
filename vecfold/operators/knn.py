"""Exact nearest neighbours for a table of queries in one job.

Tasks compare their vectors with a whole block of queries as one matrix product and hand on only
the best k per query; a window then merges these short lists. Query tables up to a checked size
are broadcast. Larger ones, and the vectors, are cut in blocks of bounded size that meet in a
grid of tasks, so neither side is ever held whole anywhere.
"""

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from vecfold.functions.vectors import as_matrix, row_distances
from vecfold.operators.search import BadRequest
from vecfold.schemas import DEFAULT_TOP_K, Metric

MAX_BROADCAST_BYTES = 64 * 1024 * 1024
VECTOR_BLOCK_BYTES = 128 * 1024 * 1024
QUERY_BLOCK_BYTES = 32 * 1024 * 1024

# Vectors compared first, in so many tasks, where a table has so many times as many.
SEED_ROWS = 20_000
SEED_TASKS = 32
SEEDED_FROM = 1_000

# Vectors, query-vector pairs, and numbers of vectors, worked on at once: small enough for the CPU cache.
VECTORS_AT_ONCE = 4_096
PAIRS_AT_ONCE = 400_000
NUMBERS_AT_ONCE = 65_536
# Queries whose neighbour lists are merged at once: what a merge holds does not grow with the queries.
QUERIES_AT_ONCE = 4_096
# Rows of a block of vectors turned into double precision at once.
ROWS_AT_ONCE = 32_768

# Unit roundoff of float32, in which pairs are preselected.
SINGLE = 2.0**-24

NEIGHBOURS = "query_id long, embedding_id string, value double"


def _norms(matrix: np.ndarray) -> np.ndarray:
    return np.sqrt(np.sum(matrix * matrix, axis=1))


def _scaled(matrix: np.ndarray, norms: np.ndarray) -> np.ndarray:
    """Rows at unit length; rows of zeros stay."""
    return matrix / np.where(norms == 0, 1.0, norms)[:, None]


def _fit_single(*norms: np.ndarray) -> bool:
    """Whether products of vectors of these lengths stay well inside the range of float32."""
    lengths = np.concatenate(norms)
    lengths = lengths[lengths > 0]
    return lengths.size == 0 or bool(lengths.min() > 1e-15 and lengths.max() < 1e15)


class BestPerQuery:
    """The best k neighbours per query among the vectors seen so far.

    Pairs are preselected by a key that grows with rank and comes from a single-precision matrix
    product; a pair passes unless its key is worse than the k-th best by more than the product can
    err. Pairs that pass are compared exactly.
    """

    def __init__(self, metric, k, query_ids, queries, min_value, max_value, known_values=None):
        queries = queries.astype(np.float64, copy=False)
        self.metric, self.k = metric, k
        self.query_ids, self.queries = query_ids, queries
        self.lo = -np.inf if min_value is None else min_value
        self.hi = np.inf if max_value is None else max_value
        self.bounded = min_value is not None or max_value is not None
        self.is_cosine = metric in (Metric.cosine_distance, Metric.cosine_similarity)
        self.query_norms = _norms(queries) if len(queries) else np.empty(0)
        self.operand = _scaled(queries, self.query_norms) if self.is_cosine and len(queries) else queries
        # Key of the k-th best neighbour so far, here or among vectors compared before.
        self.cut = np.full(len(queries), np.inf)
        if known_values is not None:
            self.cut = np.where(np.isnan(known_values), self.cut, self._key(known_values))
        self.which = np.empty(0, np.int64)
        self.values = np.empty(0, np.float64)
        self.ids = np.empty(0, object)
        # Pairs that passed and are not merged yet, and the queries in single precision once they are needed so.
        self.waiting, self.waiting_pairs = [], 0
        self.single = None

    def _key(self, values: np.ndarray) -> np.ndarray:
        """Metric values as ascending keys; NaN counts as larger than any number, as in Spark."""
        if self.metric is Metric.l2_distance:
            return values * values
        if self.metric is Metric.cosine_similarity:
            return np.where(np.isnan(values), -np.inf, -values)
        if self.metric is Metric.cosine_distance:
            return np.where(np.isnan(values), np.inf, values - 1.0)
        return values

    def _key_bounds(self) -> tuple[float, float]:
        if self.metric is Metric.l2_distance:
            return max(self.lo, 0.0) ** 2, self.hi**2 if self.hi >= 0 else -np.inf
        if self.metric is Metric.cosine_similarity:
            return -self.hi, -self.lo
        if self.metric is Metric.cosine_distance:
            return self.lo - 1.0, self.hi - 1.0
        return self.lo, self.hi

    def add(self, ids: np.ndarray, vectors: np.ndarray) -> None:
        self.meet(ids, vectors)
        self.settle()

    def meet(self, ids: np.ndarray, vectors: np.ndarray, only: np.ndarray | None = None) -> None:
        """Compares the vectors with all queries, or with those of the numbers ``only``; call ``settle`` after the last."""
        if len(self.queries) == 0:
            return
        for at in range(0, len(ids), VECTORS_AT_ONCE):
            self._meet(ids[at : at + VECTORS_AT_ONCE], vectors[at : at + VECTORS_AT_ONCE], only)

    def _meet(self, ids: np.ndarray, vectors: np.ndarray, only: np.ndarray | None) -> None:
        norms = _norms(vectors)
        operand = _scaled(vectors, norms) if self.is_cosine else vectors
        kind = np.float32 if self.is_cosine or _fit_single(norms, self.query_norms) else np.float64
        pair = (self._operand(kind), operand.astype(kind, copy=False))
        count = len(self.queries) if only is None else len(only)
        step = max(1, PAIRS_AT_ONCE // len(ids))
        for start in range(0, count, step):
            block = slice(start, min(start + step, count)) if only is None else only[start : start + step]
            keys, margin = self._keys(block, vectors, pair, norms)
            rows, columns = self._preselect(block, keys, margin)
            rows = rows + start if only is None else block[rows]
            values = self._exact(rows, columns, vectors)
            # NaN passes a lower bound and fails an upper one, as in Spark.
            inside = np.where(np.isnan(values), np.isinf(self.hi), (values >= self.lo) & (values <= self.hi))
            self.waiting.append((rows[inside], values[inside], ids[columns[inside]]))
            self.waiting_pairs += len(self.waiting[-1][0])
            # Merged as soon as they are as many as the lists are long: equal vectors all pass.
            if self.waiting_pairs >= self.k * len(self.queries):
                self.settle()

    def settle(self) -> None:
        """Merges what waits into the lists."""
        if self.waiting:
            waiting, self.waiting, self.waiting_pairs = self.waiting, [], 0
            self._keep_best(*(np.concatenate(part) for part in zip(*waiting)))

    def _operand(self, kind: type) -> np.ndarray:
        if kind is not np.float32:
            return self.operand
        if self.single is None:
            self.single = self.operand.astype(np.float32)
        return self.single

    def _keys(self, block: slice | np.ndarray, vectors: np.ndarray, operands: tuple, norms: np.ndarray):
        """Keys of all pairs of a block of queries, and per query how far they may be off."""
        queries = self.queries[block]
        dimensions = vectors.shape[1]
        if self.metric is Metric.l1_distance:
            keys = np.empty((len(queries), len(vectors)))
            step = max(1, NUMBERS_AT_ONCE // dimensions)
            for at in range(0, len(vectors), step):
                part = vectors[at : at + step]
                for i, q in enumerate(queries):
                    keys[i, at : at + step] = np.abs(part - q).sum(axis=1)
            scale = np.abs(queries).sum(axis=1) + np.abs(vectors).sum(axis=1).max()
            return keys, 1e-12 * scale
        products = operands[0][block] @ operands[1].T
        error = 4 * (dimensions + 8) * SINGLE
        if self.is_cosine:
            keys = np.negative(products, out=products)
            undefined = -np.inf if self.metric is Metric.cosine_similarity else np.inf
            keys[self.query_norms[block] == 0, :] = undefined
            keys[:, norms == 0] = undefined
            return keys, np.full(len(queries), error)
        size = self.query_norms[block]
        if self.metric is Metric.inner_product:
            return np.negative(products, out=products), error * size * norms.max()
        products *= -2
        products += (norms**2).astype(products.dtype)[None, :]
        products += (size**2).astype(products.dtype)[:, None]
        return products, error * (size + norms.max()) ** 2

    def _preselect(self, block: slice | np.ndarray, keys: np.ndarray, margin: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Row and column of the pairs that may be among the best."""
        loosely = None
        considered = keys
        if self.bounded:
            lo, hi = self._key_bounds()
            slack = margin[:, None]
            undefined = np.isinf(keys) & np.isinf(self.hi)
            loosely = ((keys >= lo - slack) & (keys <= hi + slack)) | undefined
            surely = ((keys >= lo + slack) & (keys <= hi - slack)) | undefined
            considered = np.where(surely, keys, np.inf)
        cut = self.cut[block]
        if keys.shape[1] >= self.k and np.isinf(cut).any():
            cut = np.minimum(cut, np.partition(considered, self.k - 1, axis=1)[:, self.k - 1] + margin)
        passed = keys <= (cut + margin)[:, None]
        if loosely is not None:
            passed &= loosely
        # Much faster than ``nonzero`` of two dimensions where few pass.
        return np.divmod(np.flatnonzero(passed), keys.shape[1])

    def _exact(self, rows: np.ndarray, columns: np.ndarray, vectors: np.ndarray) -> np.ndarray:
        values = np.empty(len(rows))
        step = max(1, NUMBERS_AT_ONCE // vectors.shape[1])
        for at in range(0, len(rows), step):
            pairs = slice(at, at + step)
            values[pairs] = row_distances(self.metric, vectors[columns[pairs]], self.queries[rows[pairs]])
        return values

    def _keep_best(self, which: np.ndarray, values: np.ndarray, ids: np.ndarray) -> None:
        if len(which) == 0:
            return
        which = np.concatenate([self.which, which])
        values = np.concatenate([self.values, values])
        ids = np.concatenate([self.ids, ids])
        keys = self._key(values)
        order = np.lexsort((ids.astype(str), keys, which))
        which = which[order]
        starts = np.flatnonzero(np.r_[True, which[1:] != which[:-1]])
        place = np.arange(len(which)) - np.repeat(starts, np.diff(np.r_[starts, len(which)]))
        kept = order[place < self.k]
        self.which, self.values, self.ids = which[place < self.k], values[kept], ids[kept]
        last = place == self.k - 1
        found = which[last]
        self.cut[found] = np.minimum(self.cut[found], keys[order[last]])

    def batch(self) -> pa.RecordBatch:
        self.settle()
        return pa.RecordBatch.from_arrays(
            [
                pa.array(self.query_ids[self.which], pa.int64()),
                pa.array(self.ids, pa.string()),
                pa.array(self.values, pa.float64()),
            ],
            names=["query_id", "embedding_id", "value"],
        )


class BestInBlocks:
    """The same for many queries, block by block; queries of single precision stay so but for one block."""

    def __init__(self, metric, k, query_ids, queries, min_value, max_value, known_values=None):
        self.options = (metric, k)
        self.bounds = (min_value, max_value)
        self.query_ids, self.queries, self.known = query_ids, queries, known_values
        self.kept = {}

    def add(self, ids: np.ndarray, vectors: np.ndarray) -> None:
        if not len(ids):
            return
        for start in range(0, len(self.queries), QUERIES_AT_ONCE):
            best = self._block(start)
            best.add(ids, vectors)
            self.kept[start] = (best.cut, best.which.astype(np.int32), best.values, best.ids)

    def _block(self, start: int) -> BestPerQuery:
        block = slice(start, start + QUERIES_AT_ONCE)
        known = None if self.known is None else self.known[block]
        best = BestPerQuery(*self.options, self.query_ids[block], self.queries[block], *self.bounds, known)
        if start in self.kept:
            best.cut, which, best.values, best.ids = self.kept[start]
            best.which = which.astype(np.int64)
        return best

    def batches(self) -> Iterator[pa.RecordBatch]:
        for start in range(0, max(1, len(self.queries)), QUERIES_AT_ONCE):
            yield self._block(start).batch()


def _ids(column: pa.Array | pa.ChunkedArray) -> np.ndarray:
    return np.array(column.to_pylist(), dtype=object)


def _as_stored(vectors: pa.Array) -> np.ndarray:
    """As ``as_matrix``, in single precision where the numbers are."""
    matrix = as_matrix(vectors)
    return matrix.astype(np.float32) if pa.types.is_float32(vectors.type.value_type) else matrix


def _compare_with_all(
    vectors: DataFrame, query_table: pa.Table, metric: Metric, k: int, bounds: tuple, known_values=None
) -> DataFrame:
    """Neighbour lists per task, the queries broadcast. Only for query tables of checked size."""
    shared = vectors.sparkSession.sparkContext.broadcast(
        (
            query_table.column("query_id").to_numpy(),
            _as_stored(query_table.column("embedding").combine_chunks()),
            known_values,
        )
    )

    def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        query_ids, queries, known = shared.value
        best = BestInBlocks(metric, k, query_ids, queries, *bounds, known)
        for batch in batches:
            best.add(_ids(batch.column("embedding_id")), as_matrix(batch.column("embedding")))
        yield from best.batches()

    return vectors.select("embedding_id", "embedding").mapInArrow(compare, NEIGHBOURS)


def _values_to_beat(lists: DataFrame, query_table: pa.Table, metric: Metric, k: int) -> np.ndarray:
    """Per query the value of its k-th neighbour in the lists, NaN where there are fewer.

    One number per query of a broadcast query table.
    """
    last = _ranked(lists, metric).where(F.col("rank") == k).select("query_id", "value").toArrow()
    place = {query_id: i for i, query_id in enumerate(query_table.column("query_id").to_pylist())}
    values = np.full(query_table.num_rows, np.nan)
    for query_id, value in zip(last.column("query_id").to_pylist(), last.column("value").to_pylist()):
        values[place[query_id]] = value
    return values


def _ranked(lists: DataFrame, metric: Metric) -> DataFrame:
    value = F.col("value").asc() if metric.ascending else F.col("value").desc()
    rank = F.row_number().over(Window.partitionBy("query_id").orderBy(value, "embedding_id"))
    return lists.withColumn("rank", rank)


def _compare_in_grid(
    vectors: DataFrame, queries: DataFrame, metric: Metric, k: int, bounds: tuple, vector_blocks: int, query_blocks: int
) -> DataFrame:
    """Neighbour lists per pair of a vector block and a query block."""

    def compare(left: pa.Table, right: pa.Table) -> pa.Table:
        query_ids = right.column("query_id").to_numpy()
        best = BestInBlocks(metric, k, query_ids, _as_stored(right.column("embedding").combine_chunks()), *bounds)
        if right.num_rows:
            for at in range(0, left.num_rows, ROWS_AT_ONCE):
                part = left.slice(at, ROWS_AT_ONCE)
                best.add(_ids(part.column("embedding_id")), as_matrix(part.column("embedding").combine_chunks()))
        return pa.Table.from_batches(best.batches())

    def block(column: str, blocks: int):
        return F.pmod(F.xxhash64(column), F.lit(blocks)).cast("int")

    def every(blocks: int):
        return F.explode(F.sequence(F.lit(0), F.lit(blocks - 1)))

    left = vectors.select(
        "embedding_id", "embedding", block("embedding_id", vector_blocks).alias("v"), every(query_blocks).alias("q")
    )
    right = queries.select(
        "query_id", "embedding", block("query_id", query_blocks).alias("q"), every(vector_blocks).alias("v")
    )
    return left.groupBy("v", "q").cogroup(right.groupBy("v", "q")).applyInArrow(compare, NEIGHBOURS)


def _bytes(frame: DataFrame) -> int:
    """Size of a vector column as doubles."""
    total = frame.agg(F.sum(F.size("embedding").cast("long"))).first()[0]
    return 8 * (total or 0)


def knn_batch(
    vectors: DataFrame,
    queries: DataFrame,
    *,
    metric: Metric | str = Metric.cosine_similarity,
    top_k: int = DEFAULT_TOP_K,
    min_value: float | None = None,
    max_value: float | None = None,
    max_broadcast_bytes: int = MAX_BROADCAST_BYTES,
    vector_block_bytes: int = VECTOR_BLOCK_BYTES,
    query_block_bytes: int = QUERY_BLOCK_BYTES,
    seed_rows: int = SEED_ROWS,
) -> DataFrame:
    """The ``top_k`` rows of ``vectors`` nearest to each of ``queries (query_id, embedding)``.

    All vectors and queries have one length. Gives ``query_id, embedding_id, value, rank``; the
    same as one search per query, ties going to the smaller embedding id.
    """
    metric = Metric(metric)
    if top_k < 1:
        raise BadRequest("top_k must be at least 1")
    bounds = (min_value, max_value)
    query_bytes = _bytes(queries)
    if query_bytes <= max_broadcast_bytes:
        table = queries.select("query_id", "embedding").toArrow()
        known = None
        count = vectors.count()
        if count > SEEDED_FROM * seed_rows:
            # What some vectors reach bounds the k-th place for all: tasks then hand on few pairs.
            # Rows chosen by a hash lie in all files; how many they are does not matter for the result.
            chosen = F.pmod(F.xxhash64("embedding_id"), F.lit(max(1, count // seed_rows))) == 0
            seeds = vectors.select("embedding_id", "embedding").where(chosen).repartition(SEED_TASKS)
            known = _values_to_beat(_compare_with_all(seeds, table, metric, top_k, bounds), table, metric, top_k)
        lists = _compare_with_all(vectors, table, metric, top_k, bounds, known)
    else:
        query_blocks = -(-query_bytes // query_block_bytes)
        vector_blocks = max(1, -(-_bytes(vectors) // vector_block_bytes))
        lists = _compare_in_grid(vectors, queries, metric, top_k, bounds, vector_blocks, query_blocks)
    return _ranked(lists, metric).where(F.col("rank") <= top_k)
