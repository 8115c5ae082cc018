"""Small helpers of the operators: scratch tables, joins of checked size, decisions on rows."""

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from vecfold.session import materialize

# Rows of a narrow key table that may be broadcast: at most some 50 MB in a task's hash table.
BROADCAST_ROWS = 500_000
# Parts in which rows of equal values are numbered, so that no task holds all of a large group.
GROUP_PARTS = 1024


def stored(frame: DataFrame, name: str) -> DataFrame:
    """The frame written once below the shared folder, so that lost executors repeat no more than a read."""
    return materialize(frame, f"llm-{name}")


def small(frame: DataFrame, rows: int = BROADCAST_ROWS) -> DataFrame:
    """A stored key table, broadcast if its counted rows allow it; else joins shuffle."""
    return F.broadcast(frame) if frame.count() <= rows else frame


def uniform(*values: Column | str) -> Column:
    """A number in [0, 1) with 52 bits that depends on the values alone; null has its own."""
    parts = [F.coalesce(F.col(v).cast("string") if isinstance(v, str) else v.cast("string"), F.lit("\u0000")) for v in values]
    digest = F.md5(F.concat_ws("\u0001", *parts))
    return F.conv(F.substring(digest, 1, 13), 16, 10).cast("long") / F.lit(float(1 << 52))


def with_row(frame: DataFrame, name: str) -> DataFrame:
    """The frame stored with ``_row``, a number of each row that later reads and retries repeat."""
    return stored(frame.withColumn("_row", F.monotonically_increasing_id()), name)


def with_key(frame: DataFrame, name: str) -> DataFrame:
    """The frame with ``_row``, a key of each row that later reads repeat.

    Rows of files have one, the file and the row's place in it; any other frame is stored with a number first.
    """
    try:
        place = F.struct(F.xxhash64("_metadata.file_path").alias("file"), F.col("_metadata.row_index").alias("index"))
        return frame.withColumn("_row", place)
    except AnalysisException:
        return with_row(frame, name)


def numbered(rows: DataFrame, *values: str) -> DataFrame:
    """Rows of ``with_row`` or ``with_key`` with ``_copy``: each row's number among those of equal ``values``.

    The numbers are 0 to n - 1 however the rows are partitioned; only which of n equal rows has which is not
    fixed by them. A group is numbered in GROUP_PARTS parts, from the counts of the parts before.
    """
    keyed = rows.withColumns({"_key": F.xxhash64(*values), "_share": F.pmod(F.xxhash64("_row"), F.lit(GROUP_PARTS))})
    held = keyed.groupBy("_key", "_share").agg(F.count(F.lit(1)).alias("held"))
    earlier = Window.partitionBy("_key").orderBy("_share").rowsBetween(Window.unboundedPreceding, -1)
    before = held.withColumn("_before", F.sum("held").over(earlier)).where("_before > 0").select("_key", "_share", "_before")
    ranked = keyed.withColumn("_rank", F.row_number().over(Window.partitionBy("_key", "_share").orderBy("_row")))
    copy = F.col("_rank") - 1 + F.coalesce("_before", F.lit(0).cast("long"))
    return ranked.join(before, ["_key", "_share"], "left").withColumn("_copy", copy).drop("_key", "_share", "_rank", "_before")


def in_learning_folds(doc_id: Column) -> Column:
    """True for documents models may learn from: crc32 of the id as text is not 0 modulo 5."""
    return F.coalesce(F.crc32(doc_id.cast("string")) % 5 != 0, F.lit(False))


def row_key(*more: Column) -> Column:
    """128 bits that stand for a row's doc_id and text (and ``more``), null being a value of its own."""
    parts = [F.coalesce(c.cast("string"), F.lit("\u0000")) for c in (F.col("doc_id"), F.col("text"), *more)]
    return F.unhex(F.md5(F.concat_ws("\u0001", *parts)))


def without_rows(docs: DataFrame, keys: DataFrame) -> DataFrame:
    """Rows of ``docs`` whose ``row_key`` is not in the one column of the stored table ``keys``."""
    gone = small(keys)
    return docs.join(gone, row_key() == gone[keys.columns[0]], "left_anti")


def without(docs: DataFrame, ids: DataFrame) -> DataFrame:
    """Rows of ``docs`` whose doc_id (null included) is not in the one column of the stored table ``ids``."""
    gone = small(ids)
    return docs.join(gone, docs["doc_id"].eqNullSafe(gone[ids.columns[0]]), "left_anti")


def within(docs: DataFrame, ids: DataFrame) -> DataFrame:
    """Rows of ``docs`` whose doc_id (null included) is in the one column of the stored table ``ids``."""
    wanted = small(ids)
    return docs.join(wanted, docs["doc_id"].eqNullSafe(wanted[ids.columns[0]]), "left_semi")
