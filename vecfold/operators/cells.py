"""Search through cells: rows grouped around centroids, so a query reads only near cells.

With a fixed number of probed cells the search is approximate. The exact search uses the first
probe's k-th distance as a bound: by the triangle inequality a row can only be nearer if its
distance to its centroid differs from the query's by no more, which prunes cells and row groups.
"""

from collections.abc import Sequence
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.ml.clustering import KMeans
from pyspark.ml.functions import array_to_vector
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from vecfold.functions.vectors import as_matrix, vector_literal
from vecfold.operators.access import Allowed
from vecfold.operators.search import search_rows
from vecfold.schemas import DEFAULT_TOP_K, Metric

@dataclass(frozen=True)
class Cells:
    """Centroids with the largest distance of a row to each (-1 for an empty cell)."""

    centroids: np.ndarray
    radii: np.ndarray
    path: str

    def rows(self, spark: SparkSession) -> DataFrame:
        return spark.read.parquet(self.path)

    def distances(self, query: Sequence[float]) -> np.ndarray:
        return np.sqrt(np.sum((self.centroids - np.asarray(query, np.float64)) ** 2, axis=1))


def train_centroids(rows: DataFrame, cells: int, seed: int = 0) -> np.ndarray:
    """Centroids of all rows; the clustering runs distributed."""
    training = rows.select(array_to_vector(F.col("embedding").cast("array<double>")).alias("features"))
    model = KMeans(k=cells, seed=seed, maxIter=10).fit(training)
    return np.array(model.clusterCenters(), dtype=np.float64)


def nearest_cell(centroids: np.ndarray):
    """An Arrow UDF giving the nearest centroid's number and the distance to it."""

    @F.arrow_udf("struct<cell:int,radius:double>")
    def assign(vectors: pa.Array) -> pa.Array:
        x = as_matrix(vectors)
        if len(x) == 0:
            return pa.array([], pa.struct([("cell", pa.int32()), ("radius", pa.float64())]))
        squares = np.sum(centroids * centroids, axis=1)[None, :] - 2 * x @ centroids.T
        cell = np.argmin(squares, axis=1)
        radius = np.sqrt(np.sum((x - centroids[cell]) ** 2, axis=1))
        return pa.StructArray.from_arrays(
            [pa.array(cell.astype(np.int32)), pa.array(radius)], names=["cell", "radius"]
        )

    return assign


def build_cells(rows: DataFrame, cells: int, path: str, seed: int = 0) -> Cells:
    """Assign every row to a cell and store them by cell under ``path``.

    Rebalancing splits a cell that holds a large share of the rows over several files.
    """
    centroids = train_centroids(rows, cells, seed)
    assigned = rows.withColumn("at", nearest_cell(centroids)(F.col("embedding"))).select(*rows.columns, "at.*")
    (
        assigned.hint("rebalance", F.col("cell"))
        .sortWithinPartitions("cell", "radius")
        .write.mode("errorifexists")
        .partitionBy("cell")
        .parquet(path)
    )
    radii = np.full(len(centroids), -1.0)
    stored = rows.sparkSession.read.parquet(path)
    for row in stored.groupBy("cell").agg(F.max("radius").alias("radius")).collect():
        radii[row.cell] = row.radius
    return Cells(centroids, radii, path)


def search_cells(
    spark: SparkSession,
    cells: Cells,
    query: Sequence[float],
    *,
    allowed: Allowed,
    probes: int,
    metric: Metric | str = Metric.l2_distance,
    top_k: int = DEFAULT_TOP_K,
    **options,
) -> DataFrame:
    """Approximate search: only the ``probes`` nearest cells are read, ranking within is exact."""
    nearest = np.argsort(cells.distances(query), kind="stable")[:probes]
    rows = cells.rows(spark).where(F.col("cell").isin([int(c) for c in nearest]))
    return search_rows(rows, query, allowed=allowed, metric=metric, top_k=top_k, **options)


def search_cells_exact(
    spark: SparkSession,
    cells: Cells,
    query: Sequence[float],
    *,
    allowed: Allowed,
    top_k: int = DEFAULT_TOP_K,
    probes: int = 1,
    **options,
) -> DataFrame:
    """The exact Euclidean top-k, reading only what the bound from the first probe leaves open."""
    probe = search_cells(spark, cells, query, allowed=allowed, probes=probes, top_k=top_k, **options)
    found = probe.agg(F.count("value").alias("n"), F.max("value").alias("worst")).first()
    rows = cells.rows(spark)
    if found.n == top_k and top_k > 0:
        bound = found.worst * (1 + 1e-9) + 1e-9
        to_centroid = cells.distances(query)
        open_cells = np.flatnonzero((cells.radii >= 0) & (to_centroid - cells.radii <= bound))
        lengths = vector_literal(to_centroid)
        near = F.abs(F.get(lengths, F.col("cell")) - F.col("radius")) <= F.lit(bound)
        rows = rows.where(F.col("cell").isin([int(c) for c in open_cells])).where(near)
        # The widest of these bounds reaches the scan, where row groups (sorted by radius) drop out.
        reach = to_centroid[open_cells]
        rows = rows.where(F.col("radius").between(float(reach.min() - bound), float(reach.max() + bound)))
    return search_rows(rows, query, allowed=allowed, metric=Metric.l2_distance, top_k=top_k, **options)
