"""Cells of one collection as its buckets: built, kept up by puts, split, and searched.

The rows of an indexed collection lie in the bucket of the cell whose centroid is nearest, so a search
reads the buckets of near cells and the table's own commits, generations and files serve the index. A
cell's radius bounds the distance of its rows to the centroid; it only grows until the cell is split.
Cells hold for the Euclidean distance and, on unit vectors, for the two cosine metrics, in which a row of
length zero has no value and makes its cell's radius infinite.
"""

from collections.abc import Callable, Sequence
from dataclasses import dataclass

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from vecfold.operators.search import BadRequest
from vecfold.operators.spaces import COSINE, Space, distances, in_cells, trained_centroids
from vecfold.schemas import EMBEDDINGS, Metric
from vecfold.session import materialize

CELL_ROWS = 1_000
SPLIT_ROWS = 4 * CELL_ROWS
MAX_CELLS = 4_096
SAMPLE_ROWS = 20_000
PROBES = 8
METRICS = (Metric.l2_distance, *COSINE)


@dataclass(frozen=True)
class CollectionCells:
    """The cells of a collection: bucket numbers, centroids and radii in the same order."""

    space: Space
    numbers: np.ndarray
    centroids: np.ndarray
    radii: np.ndarray


def read_cells(cells: DataFrame) -> dict[int, CollectionCells]:
    """Cells by collection; at most about MAX_CELLS rows a collection come to the driver."""
    found: dict[int, list] = {}
    for row in cells.orderBy("id", "bucket").collect():
        found.setdefault(row.id, []).append(row)
    return {
        i: CollectionCells(
            Space(Metric(rows[0].metric), 0.0), np.array([r.bucket for r in rows], np.int32), np.array([r.centroid for r in rows]), np.array([r.radius for r in rows])
        )
        for i, rows in found.items()
    }


def _assigned(rows: DataFrame, cells: CollectionCells) -> DataFrame:
    """Rows with the ``bucket`` of their cell and their ``radius`` in it."""
    numbers = F.array(*[F.lit(int(n)) for n in cells.numbers])
    radius = F.col("radius")
    if cells.space.metric in COSINE:
        radius = F.when(F.exists("embedding", lambda v: v != 0), radius).otherwise(F.lit(float("inf")))
    found = in_cells(rows.select(*EMBEDDINGS.names), cells.space, cells.centroids)
    return found.select(*EMBEDDINGS.names, F.get(numbers, F.col("cell")).alias("bucket"), radius.alias("radius"))


def placed(rows: DataFrame, indexed: dict[int, CollectionCells]) -> DataFrame:
    """Rows of indexed collections in their cells."""
    out = None
    for i, cells in indexed.items():  # collections of one request
        part = _assigned(rows.where(F.col("collection_id") == i), cells)
        out = part if out is None else out.unionByName(part)
    return out


def widened(cells: DataFrame, rows: DataFrame) -> DataFrame:
    """The cells with radii that also hold the placed ``rows``."""
    reach = rows.groupBy(F.col("collection_id").alias("id"), "bucket").agg(F.max("radius").alias("reach"))
    return cells.join(reach, ["id", "bucket"], "left").select("id", "bucket", "metric", "centroid", F.greatest("radius", F.coalesce("reach", "radius")).alias("radius"))


def _table(rows: DataFrame, collection: int, metric: Metric, numbers: Sequence[int], centroids: np.ndarray) -> DataFrame:
    """The cells of the given numbers, with the radii of the placed ``rows``; one without rows has 0."""
    kinds = "id long, bucket int, metric string, centroid array<double>"
    known = rows.sparkSession.createDataFrame([(collection, int(n), str(metric), c.tolist()) for n, c in zip(numbers, centroids)], kinds)
    radii = rows.where(F.col("collection_id") == collection).groupBy("bucket").agg(F.max("radius").alias("radius"))
    return known.join(radii, "bucket", "left").select("id", "bucket", "metric", "centroid", F.coalesce("radius", F.lit(0.0)).alias("radius"))


def build(rows: DataFrame, collection: int, metric: Metric | str, centroids: np.ndarray | None, cell_rows: int) -> tuple[DataFrame, DataFrame] | None:
    """All rows of a collection in cells, and the cells; None without rows."""
    metric = Metric(metric)
    if metric not in METRICS:
        raise BadRequest(f"cells hold for {', '.join(METRICS)}")
    space = Space(metric, 0.0)
    if centroids is None:
        centroids = trained_centroids(rows, space, min(MAX_CELLS, -(-rows.count() // cell_rows)), SAMPLE_ROWS)
    if not len(centroids):
        return None
    cells = CollectionCells(space, np.arange(len(centroids), dtype=np.int32), centroids, np.zeros(len(centroids)))
    whole = materialize(_assigned(rows, cells), "in-cells")
    return whole, _table(whole, collection, metric, cells.numbers, centroids)


def split(rows: DataFrame, cells: DataFrame, pairs: Sequence[tuple[int, int]]) -> tuple[DataFrame, DataFrame]:
    """The rows of the (collection, bucket) pairs in two cells each, and all cells of these collections.

    The first of the two keeps the number, the other gets a new one. Rows are placed where they are read.
    """
    known, parts, table = read_cells(cells), [], None
    last = {i: int(of.numbers.max()) for i, of in known.items()}
    numbers: dict[int, list] = {}
    for i, bucket in pairs:
        own = rows.where((F.col("collection_id") == i) & (F.col("bucket") == bucket))
        two = trained_centroids(own, known[i].space, 2, SAMPLE_ROWS)
        if len(two) < 2:
            two = np.concatenate([two, known[i].centroids[known[i].numbers == bucket]])
        last[i] += 1
        halves = CollectionCells(known[i].space, np.array([bucket, last[i]], np.int32), two, np.zeros(2))
        parts.append(_assigned(own, halves))
        numbers.setdefault(i, []).append(halves)
    kept = parts[0]
    for part in parts[1:]:
        kept = kept.unionByName(part)
    table = cells.join(rows.sparkSession.createDataFrame(list(pairs), "id long, bucket int"), ["id", "bucket"], "left_anti").select("id", "bucket", "metric", "centroid", "radius")
    for i, halves in numbers.items():
        new = [(n, c) for half in halves for n, c in zip(half.numbers, half.centroids)]
        table = table.unionByName(_table(kept, i, known[i].space.metric, [n for n, _ in new], np.array([c for _, c in new])))
    return kept, table


def search(cells: CollectionCells, query: Sequence[float], read: Callable[[Sequence[int]], DataFrame], probes: int | None, top_k: int) -> DataFrame:
    """Search by reading cells with ``read``: the nearest ``probes``, or, exactly, all that may hold a better row."""
    vector = np.asarray(query, np.float64)[None, :]
    far = distances(cells.space.queries(vector), cells.centroids)[0]
    nearest = np.argsort(far, kind="stable")
    if probes is not None:
        return read(cells.numbers[nearest[:probes]])
    metric = cells.space.metric
    found = read(cells.numbers[nearest[:1]])
    worst = (F.max if metric.ascending else F.min)("value")
    first = found.agg(F.count("value").alias("n"), worst.alias("worst")).first()
    limit = np.inf
    if first.n == top_k and top_k > 0:
        limit = cells.space.reach(np.array([first.worst]), vector)[0] + 1e-6 * (far.max() + 1)
    return read(cells.numbers[far - cells.radii <= limit])
