"""Metrics as Euclidean distances, so that distance bounds on cells of vectors hold for all of them.

Cosine: points of unit length, whose squared distance is 2 - 2 cosine. Inner product: one more dimension
makes all vectors as long as the longest, then the nearest is the one with the largest product. Manhattan
distances are at least as large as Euclidean ones, which bounds them from below.
"""

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.ml.clustering import KMeans
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.ml.stat import Summarizer
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from vecfold.functions.vectors import as_matrix
from vecfold.schemas import Metric
from vecfold.session import materialize

# Spark's KMeans sends the distances of all pairs of many centroids to the driver in every round.
KMEANS_CELLS = 100
ROUNDS = 10
SAMPLE_PARTS = 32

COSINE = (Metric.cosine_distance, Metric.cosine_similarity)


def lengths(matrix: np.ndarray) -> np.ndarray:
    return np.sqrt(np.sum(matrix * matrix, axis=1))


@dataclass(frozen=True)
class Space:
    """Points of vectors and queries under a metric; ``longest`` is the length of the longest vector."""

    metric: Metric
    longest: float

    def _unit(self, matrix: np.ndarray) -> np.ndarray:
        size = lengths(matrix)
        return matrix / np.where(size == 0, 1.0, size)[:, None]

    def vectors(self, matrix: np.ndarray) -> np.ndarray:
        if self.metric in COSINE:
            return self._unit(matrix)
        if self.metric is Metric.inner_product:
            rest = np.sqrt(np.maximum(self.longest**2 - np.sum(matrix * matrix, axis=1), 0.0))
            return np.concatenate([matrix, rest[:, None]], axis=1)
        return matrix

    def queries(self, matrix: np.ndarray) -> np.ndarray:
        if self.metric in COSINE:
            return self._unit(matrix)
        if self.metric is Metric.inner_product:
            return np.concatenate([matrix, np.zeros((len(matrix), 1))], axis=1)
        return matrix

    def reach(self, values: np.ndarray, queries: np.ndarray) -> np.ndarray:
        """The distance of points within which all vectors of this metric value or a better one lie.

        Wide enough for rounding; infinite where the value is not a number.
        """
        size = lengths(queries)
        with np.errstate(invalid="ignore"):
            if self.metric is Metric.cosine_similarity:
                far = np.sqrt(np.maximum(2 - 2 * values, 0.0))
            elif self.metric is Metric.cosine_distance:
                far = np.sqrt(np.maximum(2 * values, 0.0))
            elif self.metric is Metric.inner_product:
                far = np.sqrt(np.maximum(self.longest**2 + size**2 + 2 * values, 0.0))
            else:
                far = np.maximum(values, 0.0)
        scale = np.ones(len(queries)) if self.metric in COSINE else self.longest + size
        return np.where(np.isnan(values), np.inf, far + 1e-6 * scale)


def distances(points: np.ndarray, centroids: np.ndarray) -> np.ndarray:
    """Distances of all points to all centroids."""
    squares = np.sum(points * points, axis=1)[:, None] - 2 * points @ centroids.T + np.sum(centroids * centroids, axis=1)[None, :]
    return np.sqrt(np.maximum(squares, 0.0))


def longest_vector(rows: DataFrame) -> float:
    """Length of the longest of the rows' vectors, one number a task merged in Spark."""

    def largest(batch_iter: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        most = 0.0
        for batch in batch_iter:
            if batch.num_rows:
                most = max(most, float(lengths(as_matrix(batch.column("embedding"))).max(initial=0.0)))
        yield pa.RecordBatch.from_arrays([pa.array([most])], ["most"])

    return rows.select("embedding").mapInArrow(largest, "most double").agg(F.max("most")).first()[0] or 0.0


def trained_centroids(rows: DataFrame, space: Space, cells: int, sample_rows: int, seed: int = 0) -> np.ndarray:
    """Centroids of the rows' points, from a sample of about ``sample_rows`` rows chosen by a hash of their id.

    Which centroids there are changes how much is skipped and never a result.
    """
    count = rows.count()
    chosen = F.pmod(F.xxhash64("embedding_id", F.lit(seed)), F.lit(max(1, count // sample_rows))) == 0
    sample = rows.where(chosen).select("embedding").limit(2 * sample_rows)
    if cells <= 1 or count < 2:
        first = sample.limit(1).toArrow()
        return space.vectors(as_matrix(first.column("embedding").combine_chunks())) if first.num_rows else np.zeros((0, 0))

    def to_points(batch_iter: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batch_iter:
            if batch.num_rows:
                yield pa.RecordBatch.from_arrays([pa.array(list(space.vectors(as_matrix(batch.column("embedding")))), pa.list_(pa.float64()))], ["point"])

    points = sample.mapInArrow(to_points, "point array<double>")
    if cells > KMEANS_CELLS:
        return _moved_centroids(materialize(points.repartition(SAMPLE_PARTS), "points"), cells, seed)
    points = points.select(array_to_vector("point").alias("features"))
    return np.array(KMeans(k=cells, seed=seed, maxIter=ROUNDS).fit(points).clusterCenters(), dtype=np.float64)


def _moved_centroids(points: DataFrame, cells: int, seed: int) -> np.ndarray:
    """Centroids of stored points (``point``) from different ones chosen by a hash, moved to the means of theirs in each round.

    Means are taken in Spark; the driver gets a row a cell and round.
    """
    first = points.distinct().orderBy(F.xxhash64("point", F.lit(seed)), "point").limit(cells).toArrow()
    centroids = as_matrix(first.column("point").combine_chunks())
    for _ in range(ROUNDS):
        placed = points.mapInArrow(_nearest(centroids), "cell int, point array<double>").select("cell", array_to_vector("point").alias("features"))
        means = placed.groupBy("cell").agg(vector_to_array(Summarizer.mean(F.col("features"))).alias("mean")).toArrow()  # a row a cell
        centroids = centroids.copy()
        centroids[means.column("cell").to_numpy()] = as_matrix(means.column("mean").combine_chunks())
    return centroids


def _nearest(centroids: np.ndarray):
    def assign(batch_iter: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batch_iter:
            for at in range(0, batch.num_rows, 1024):
                part = batch.column("point").slice(at, 1024)
                cell = distances(as_matrix(part), centroids).argmin(axis=1).astype(np.int32)
                yield pa.RecordBatch.from_arrays([pa.array(cell), part], ["cell", "point"])

    return assign


def in_cells(rows: DataFrame, space: Space, centroids: np.ndarray, of_queries: bool = False) -> DataFrame:
    """The rows with ``cell``, the number of the nearest centroid, and ``radius``, the distance to it."""
    to_points = space.queries if of_queries else space.vectors

    def assign(batch_iter: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batch_iter:
            if not batch.num_rows:
                continue
            points = to_points(as_matrix(batch.column("embedding")))
            cell, radius = np.empty(len(points), np.int32), np.empty(len(points))
            for at in range(0, len(points), 1024):
                far = distances(points[at : at + 1024], centroids)
                cell[at : at + 1024] = far.argmin(axis=1)
                near = points[at : at + 1024] - centroids[cell[at : at + 1024]]
                radius[at : at + 1024] = lengths(near)
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(cell), pa.array(radius)], [*batch.schema.names, "cell", "radius"])

    kinds = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in rows.schema.fields)
    return rows.mapInArrow(assign, f"{kinds}, cell int, radius double")
