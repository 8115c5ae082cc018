"""Centroid clustering with an incremental distance matrix, exact in integers.

Every vector keeps its integer dot products with all centroids in a stored table. A round sends only
the components in which a centroid changed (clusters * dimensions numbers at most); a task adds
change * component to the dot products concerned and nothing else, and takes the argmin of
|x|^2 - 2 dot + |c|^2 again. The start is the same step from centroids of zeros. Each round is one
pass without a shuffle of vectors, a stored table that lost executors read again, and partial sums of
one row a task and cluster.

Null vectors, vectors of another length and vectors with null, NaN or infinite components take no
part. Rows that repeat are vectors of their own. Rows without vec_id take part but never start a
centroid; of equal vec_ids the vector that sorts first comes first. With fewer vectors than clusters
there are as many centroids as start; without any, cluster and distance are null. An empty table gives
no rows. Other columns are not read. Components beyond ``integers.LIMIT`` after scaling are refused.
"""

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from vecfold.llm import integers
from vecfold.llm.tables import stored


def first_centroids(vectors: DataFrame, dimensions: int, clusters: int, seed: str) -> np.ndarray:
    """The vectors whose sha256 of ``seed`` and vec_id sorts first; ``clusters`` rows come to the driver."""
    drawn = F.sha2(F.concat(F.lit(seed), F.col("vec_id").cast("string")), 256)
    chosen = vectors.where("vec_id is not null").orderBy(drawn, "x").select("x").limit(clusters).collect()
    return np.array([r.x for r in chosen], np.int64).reshape(len(chosen), dimensions)


def changed_products(x: np.ndarray, dots: np.ndarray, changes: np.ndarray) -> np.ndarray:
    """Dot products after the centroids moved by ``changes``; only nonzero components are looked at."""
    for c in np.flatnonzero(changes.any(axis=1)):
        at = np.flatnonzero(changes[c])
        dots[:, c] += x[:, at] @ changes[c, at]
    return dots


def assigned(table: DataFrame, changes: np.ndarray, centroids: np.ndarray) -> DataFrame:
    """The table with dot products brought up to date, ``cluster`` and ``distance`` (squared)."""
    clusters, dimensions = centroids.shape
    lengths = np.sum(centroids * centroids, axis=1)

    def per_batch(batch_iter: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batch_iter:
            x = integers.matrix(batch.column("x"), dimensions)
            dots = changed_products(x, integers.matrix(batch.column("dots"), clusters).copy(), changes)
            squares = np.sum(x * x, axis=1)[:, None] - 2 * dots + lengths[None, :]
            cluster = np.argmin(squares, axis=1)  # the first, so the smaller number, of equal ones
            distance = squares[np.arange(len(x)), cluster]
            yield pa.RecordBatch.from_arrays(
                [batch.column("vec_id"), batch.column("x"), integers.lists(dots), pa.array(cluster.astype(np.int32)), pa.array(distance)],
                ["vec_id", "x", "dots", "cluster", "distance"],
            )

    kind = table.schema["vec_id"].dataType.simpleString()
    return table.mapInArrow(per_batch, f"vec_id {kind}, x array<int>, dots array<bigint>, cluster int, distance bigint")


def moved(table: DataFrame, centroids: np.ndarray) -> np.ndarray:
    """Centroids at the rounded-down means of their vectors; those without vectors stay."""
    clusters, dimensions = centroids.shape

    def partial(batch_iter: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts, sums = np.zeros(clusters, np.int64), np.zeros((clusters, dimensions), np.int64)
        for batch in batch_iter:
            x, cluster = integers.matrix(batch.column("x"), dimensions), batch.column("cluster").to_numpy()
            counts += np.bincount(cluster, minlength=clusters)
            order = np.argsort(cluster, kind="stable")
            held, starts = np.unique(cluster[order], return_index=True)
            if len(held):
                sums[held] += np.add.reduceat(x[order], starts, axis=0)
        yield pa.RecordBatch.from_arrays([pa.array(np.arange(clusters, dtype=np.int32)), pa.array(counts), integers.lists(sums)], ["cluster", "n", "sums"])

    parts = table.select("x", "cluster").mapInArrow(partial, "cluster int, n bigint, sums array<bigint>").where("n > 0")
    totals = parts.groupBy("cluster").agg(F.sum("n").alias("n"), F.array(*[F.sum(F.col("sums")[d]) for d in range(dimensions)]).alias("sums"))
    new = centroids.copy()
    for row in totals.collect():  # a row a cluster
        new[row.cluster] = [s // row.n for s in row.sums]
    return new


def clustered(
    embeddings: DataFrame, dimensions: int = 64, scale: int = 64, clusters: int = 16, rounds: int = 3, seed: str = "1:"
) -> tuple[DataFrame, np.ndarray]:
    """(vec_id, x, dots, cluster, distance) of every vector after ``rounds`` rounds, and the centroids."""
    kept = embeddings.where(integers.usable("embedding", dimensions))
    vectors = stored(integers.scaled(kept, "embedding", scale, {"vec_id": F.col("vec_id")}), "vectors")
    centroids = first_centroids(vectors, dimensions, clusters, seed)
    if not len(centroids):
        nothing = {"dots": F.array().cast("array<bigint>"), "cluster": F.lit(None).cast("int"), "distance": F.lit(None).cast("bigint")}
        return vectors.withColumns(nothing), centroids
    zero = F.array_repeat(F.lit(0).cast("bigint"), len(centroids))
    table, old = vectors.withColumn("dots", zero), np.zeros_like(centroids)
    for _ in range(rounds):
        table = stored(assigned(table.select("vec_id", "x", "dots"), centroids - old, centroids), "products")
        old, centroids = centroids, moved(table, centroids)
    return stored(assigned(table.select("vec_id", "x", "dots"), centroids - old, centroids), "products"), centroids


SUMMARY = "cluster int, cluster_inertia bigint, inertia bigint, centroid_sha256 string"


def summarised(table: DataFrame, centroids: np.ndarray) -> DataFrame:
    """vec_id, cluster, distance, cluster_inertia, inertia and centroid_sha256 of every vector.

    The sums are exact; one that fits no long is null.
    """
    sums = table.where("cluster is not null").groupBy("cluster").agg(F.sum(F.col("distance").cast("decimal(38,0)")).alias("sum"))
    inertia = {r.cluster: int(r.sum) for r in sums.collect()}  # at most a row a cluster
    fits = lambda n: n if n < 1 << 63 else None
    digest = lambda row: hashlib.sha256(",".join(map(str, row.tolist())).encode()).hexdigest()
    known = [(c, fits(n), fits(sum(inertia.values())), digest(centroids[c])) for c, n in inertia.items()]
    summary = F.broadcast(table.sparkSession.createDataFrame(known, SUMMARY))
    return table.select("vec_id", "cluster", "distance").join(summary, "cluster", "left").select(
        "vec_id", "cluster", "distance", "cluster_inertia", "inertia", "centroid_sha256"
    )


def sql(clusters: int = 16, rounds: int = 3) -> str:
    """The same result as SQL over the table ``embeddings``; components in rows."""
    parts = [
        "kept AS MATERIALIZED (SELECT row_number() OVER () AS rid, vec_id, [floor(64 * e::DOUBLE)::BIGINT for e in embedding] AS x FROM embeddings "
        "WHERE len(embedding) = 64 AND len([e for e in embedding if isfinite(e)]) = 64)",
        "parts AS MATERIALIZED (SELECT rid, d, x[d] AS v FROM kept, range(1, 65) t(d))",
        "start AS (SELECT row_number() OVER (ORDER BY sha256('1:' || vec_id), x) - 1 AS c, x FROM kept WHERE vec_id IS NOT NULL)",
        f"c0 AS MATERIALIZED (SELECT c, d, x[d] AS m FROM start, range(1, 65) t(d) WHERE c < {clusters})",
    ]
    for r in range(rounds + 1):
        parts.append(
            f"far{r} AS (SELECT rid, c, sum((v - m) * (v - m))::BIGINT AS distance FROM parts JOIN c{r} USING (d) GROUP BY rid, c), "
            f"a{r} AS MATERIALIZED (SELECT rid, c, distance FROM far{r} QUALIFY row_number() OVER (PARTITION BY rid ORDER BY distance, c) = 1)"
        )
        if r < rounds:
            parts.append(
                f"s{r} AS (SELECT c, d, sum(v)::BIGINT AS s, count(*) AS n FROM parts JOIN a{r} USING (rid) GROUP BY c, d), "
                f"c{r + 1} AS MATERIALIZED (SELECT c, d, coalesce((s - ((s % n) + n) % n) // n, m) AS m FROM c{r} LEFT JOIN s{r} USING (c, d))"
            )
    return f"""
        WITH {", ".join(parts)}, named AS (SELECT c, sha256(string_agg(m::VARCHAR, ',' ORDER BY d)) AS centroid_sha256 FROM c{rounds} GROUP BY c)
        SELECT vec_id, c::INTEGER AS cluster, distance, (sum(distance) OVER (PARTITION BY c))::BIGINT AS cluster_inertia,
            (sum(distance) OVER ())::BIGINT AS inertia, centroid_sha256
        FROM kept JOIN a{rounds} USING (rid) JOIN named USING (c)
    """
