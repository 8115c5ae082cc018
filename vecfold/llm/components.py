"""Connected components of a table of edges by alternating large and small stars."""

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from vecfold.llm.tables import stored


def _star(edges: DataFrame, larger: bool) -> DataFrame:
    """Links the neighbours of each vertex (only larger ones, or only smaller ones) to the least of them."""
    both = edges.select("a", "b").union(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
    if not larger:
        both = both.where(F.col("b") < F.col("a"))
    least = both.groupBy("a").agg(F.least(F.min("b"), F.col("a")).alias("least"))
    linked = both.where(F.col("b") > F.col("a")) if larger else both
    new = linked.join(least, "a").select(F.col("b").alias("a"), F.col("least").alias("b"))
    if not larger:
        new = new.union(least.select("a", F.col("least").alias("b")))
    return new.where(F.col("a") != F.col("b")).distinct()


def _state(edges: DataFrame) -> tuple:
    return tuple(edges.agg(F.count(F.lit(1)), F.sum(F.xxhash64("a", "b") % 1_000_003), F.sum(F.hash("a", "b").cast("long"))).first())


def components(edges: DataFrame) -> DataFrame:
    """(a, b) rows to (vertex, root): every vertex with an edge, and the least vertex it can reach.

    Each round is two joins of the edges; a component of diameter d takes about log d rounds, and
    no vertex's neighbours are gathered.
    """
    now = stored(edges.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).where("a <> b").distinct(), "edges")
    state = _state(now)
    while state[0]:
        now = stored(_star(_star(now, True), False), "edges")
        before, state = state, _state(now)
        if state == before:
            break
    roots = now.select(F.col("b").alias("vertex")).distinct().withColumn("root", F.col("vertex"))
    return now.select(F.col("a").alias("vertex"), F.col("b").alias("root")).union(roots)
