"""Joins whose left side may repeat a key very often.

Spark splits skewed partitions by their compressed size, which misses a key repeated in rows that
compress well. Here hot keys are counted (with copies merged before the shuffle) and their rows
join by broadcast where they are; all other rows join by shuffle.
"""

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

# A key with at least this many rows is hot. At most HOT_KEYS of them, the most frequent ones, are
# broadcast; any beyond take the ordinary join, so the result is whole either way.
HOT_ROWS = 1_000_000
HOT_KEYS = 1_000


def hot_keys(rows: DataFrame, on: Sequence[str], hot_rows: int = HOT_ROWS) -> DataFrame:
    counts = rows.groupBy(*on).agg(F.count(F.lit(1)).alias("rows_of_key")).where(F.col("rows_of_key") >= hot_rows)
    return counts.orderBy(F.desc("rows_of_key"), *on).limit(HOT_KEYS).select(*on)


def lookup_join(
    left: DataFrame, right: DataFrame, on: Sequence[str], how: str = "inner", hot_rows: int | None = None
) -> DataFrame:
    """``left`` joined (inner, left, left_semi or left_anti) to a right side with one row per key."""
    on = list(on)
    keys = hot_keys(left.where(F.col(on[0]).isNotNull()), on, HOT_ROWS if hot_rows is None else hot_rows)
    found = keys.collect()
    if not found:
        return left.join(right, on, how)
    hot = F.broadcast(left.sparkSession.createDataFrame(found, keys.schema))
    # One row per key: no more rows than there are hot keys.
    hot_right = F.broadcast(right.join(hot, on, "left_semi"))
    of_hot = left.join(hot, on, "left_semi").join(hot_right, on, how)
    of_others = left.join(hot, on, "left_anti").join(right, on, how)
    return of_hot.unionByName(of_others)
