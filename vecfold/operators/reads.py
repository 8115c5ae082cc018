"""Reads by id, pages, counts and result documents."""

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from vecfold.functions.content import json_with
from vecfold.functions.names import embedding_path
from vecfold.functions.vectors import vector_bytes
from vecfold.operators.access import Allowed, visible, visible_collections
from vecfold.operators.search import info_json, info_struct
from vecfold.operators.skew import lookup_join
from vecfold.schemas import DEFAULT_PAGE_SIZE, MAX_PAGE_SIZE


def embedding_by_id(embeddings: DataFrame, collection_id: int, embedding_id: str, allowed: Allowed) -> DataFrame:
    """The visible row with this id in this collection, or nothing."""
    at = (F.col("collection_id") == collection_id) & (F.col("embedding_id") == embedding_id)
    return visible(embeddings.where(at), allowed)


def embeddings_by_ids(
    embeddings: DataFrame, ids: Sequence[str] | DataFrame, allowed: Allowed, collection_id: int | None = None
) -> DataFrame:
    """Visible rows of either precision whose id is in the set, each once."""
    rows = visible(embeddings, allowed)
    if collection_id is not None:
        rows = rows.where(F.col("collection_id") == collection_id)
    if isinstance(ids, DataFrame):
        return rows.join(ids.select("embedding_id"), "embedding_id", "left_semi")
    return rows.where(F.col("embedding_id").isin(list(ids)))


def id_positions(spark, ids: Sequence[str]) -> DataFrame:
    """A request list as rows ``pos, embedding_id``."""
    listed = spark.range(1).select(F.posexplode(F.lit(list(ids)).cast("array<string>")).alias("pos", "embedding_id"))
    return listed.select(F.col("pos").cast("long").alias("pos"), "embedding_id")


def requested_rows(embeddings: DataFrame, requests: DataFrame, allowed: Allowed) -> DataFrame:
    """Visible rows of the requested ids (``pos, embedding_id``), repeated where an id repeats.

    Ids that do not exist or are hidden vanish. ``input_index`` is the zero-based position.
    """
    joined = lookup_join(requests, visible(embeddings, allowed), ["embedding_id"])
    return joined.withColumnRenamed("pos", "input_index")


def bulk_read_ordered(
    embeddings: DataFrame, requests: DataFrame, allowed: Allowed, collection_id: int | None = None
) -> DataFrame:
    """Requested rows of one collection in request order."""
    rows = embeddings if collection_id is None else embeddings.where(F.col("collection_id") == collection_id)
    return requested_rows(rows, requests, allowed).orderBy("input_index")


def bulk_read_any(embeddings: DataFrame, requests: DataFrame, catalog: DataFrame, allowed: Allowed) -> DataFrame:
    """Requested rows of any visible collection and either precision, in request order."""
    known = visible_collections(catalog, allowed).select(F.col("id").alias("collection_id"), "collection_name")
    rows = requested_rows(embeddings, requests, allowed).join(known, "collection_id")
    return rows.withColumn("precision", precision(F.col("vector_type"))).orderBy("input_index")


def precision(vector_type: Column) -> Column:
    return F.when(vector_type == "halfvec", F.lit("float16")).otherwise(F.lit("float32"))


def binary_vectors(rows: DataFrame) -> DataFrame:
    """Rows with their vector as base64 of its raw bytes at stored precision."""
    raw = vector_bytes(F.col("embedding"), F.col("vector_type") == "halfvec")
    return rows.withColumn("precision", precision(F.col("vector_type"))).withColumn(
        # Without the line breaks that base64 puts in.
        "vector_base64",
        F.translate(F.base64(raw), "\r\n", ""),
    )


def embedding_documents(rows: DataFrame, exclude_info: bool = False) -> DataFrame:
    """Rows (with ``collection_name``, optionally ``input_index``) as nested result documents."""
    parts = [F.col("embedding").alias("vector"), F.col("embedding_id")]
    if "input_index" in rows.columns:
        parts.append(F.col("input_index"))
    if not exclude_info:
        parts.append(info_struct(F.col("collection_name")).alias("info"))
    return rows.select("embedding_id", F.struct(*parts).alias("document"))


def binary_documents(rows: DataFrame, exclude_info: bool = False) -> DataFrame:
    """Rows (with ``collection_name`` and ``input_index``) as nested documents whose vector is base64 text."""
    parts = [F.col("vector_base64"), F.col("precision"), F.col("embedding_id"), F.col("input_index")]
    if not exclude_info:
        parts.append(info_struct(F.col("collection_name")).alias("info"))
    return binary_vectors(rows).select("input_index", "embedding_id", "collection_id", F.struct(*parts).alias("document"))


def document_json(documents: DataFrame) -> DataFrame:
    """Documents as JSON text, null fields dropped and metadata as it was written."""
    if "info" not in documents.schema["document"].dataType.names:
        return documents.withColumn("document", F.to_json("document"))
    info = info_json(F.col("document.info"))
    return documents.withColumn("document", json_with(F.col("document").dropFields("info"), "info", info))


# Pages that start so far in are found by counted ranges of keys, PREFIX_STEP letters at a time.
RANGE_ROWS = 10_000
PREFIX_STEP = 2


def self_links(rows: DataFrame) -> DataFrame:
    return rows.withColumn("self", embedding_path(F.col("collection_name"), F.col("embedding_id")))


def page_of(rows: DataFrame, order: str, page: int, page_size: int) -> DataFrame:
    """Page ``page`` (from 1) in ``order``, with the numbers of the pages around it.

    A full page points on even when it is the last one.
    """
    if page < 1 or not 1 <= page_size <= MAX_PAGE_SIZE:
        raise ValueError(f"page must be at least 1 and page_size between 1 and {MAX_PAGE_SIZE}")
    offset = (page - 1) * page_size
    if offset >= RANGE_ROWS:
        rows, before = page_ranges(rows, order, offset, page_size)
        offset -= before
    shown = rows.orderBy(order).offset(offset).limit(page_size)
    # The window covers one page, so at most MAX_PAGE_SIZE rows.
    shown = shown.withColumn("on_page", F.count(F.lit(1)).over(Window.partitionBy()))
    return shown.select(
        *rows.columns,
        F.lit(page).alias("page"),
        F.when(F.col("on_page") == page_size, F.lit(page + 1)).alias("next_page"),
        F.lit(page - 1 if page > 1 else None).cast("int").alias("prev_page"),
    )


def page_ranges(rows: DataFrame, order: str, offset: int, size: int, range_rows: int | None = None) -> tuple[DataFrame, int]:
    """The rows of the few ranges of ``order`` that hold the rows from ``offset`` on, and the rows before them.

    A histogram of the first letters of the keys, counted in Spark, tells which prefixes a page lies in;
    a prefix that still holds many rows is counted by further letters. So no task sorts what lies before
    the page: ranges of about ``range_rows`` rows meet, or the rows of one key.
    """
    limit = RANGE_ROWS if range_rows is None else range_rows
    prefixes, exact, before = [], [], None

    def descend(prefix: str, start: int, first: int, end: int) -> None:
        """Ranges of keys with ``prefix``, which begin at row ``start``, that overlap rows first to end."""
        nonlocal before
        longer = len(prefix) + PREFIX_STEP
        head = F.substring(order, 1, longer)
        counts = rows.where(F.col(order).startswith(prefix)).groupBy(head.alias("head")).agg(F.count(F.lit(1)).alias("n")).orderBy("head")
        for head_text, n in [(r["head"], r.n) for r in counts.collect()]:  # a number a prefix
            if start < end and start + n > first:
                whole_key = len(head_text) < longer
                if n > limit and not whole_key and (start < first or start + n > end):
                    descend(head_text, start, first, end)
                else:
                    before = start if before is None else before
                    (exact if whole_key else prefixes).append(head_text)
            start += n

    descend("", 0, offset, offset + size)
    if before is None:
        return rows.where(F.lit(False)), offset
    chosen = F.lit(False)
    for prefix in prefixes:
        chosen = chosen | F.col(order).startswith(prefix)
    if exact:
        chosen = chosen | F.col(order).isin(exact)
    return rows.where(chosen), before


def page_collections(
    catalog: DataFrame, allowed: Allowed, page: int = 1, page_size: int = DEFAULT_PAGE_SIZE
) -> DataFrame:
    return page_of(visible_collections(catalog, allowed), "collection_name", page, page_size)


def page_embeddings(
    embeddings: DataFrame, collection_id: int, allowed: Allowed, page: int = 1, page_size: int = DEFAULT_PAGE_SIZE
) -> DataFrame:
    rows = visible(embeddings.where(F.col("collection_id") == collection_id), allowed)
    return page_of(rows, "embedding_id", page, page_size)


def embeddings_after(
    embeddings: DataFrame, collection_id: int, allowed: Allowed, last_id: str | None, page_size: int
) -> DataFrame:
    """The page that follows ``last_id``: deep paging without sorting the pages before it."""
    rows = visible(embeddings.where(F.col("collection_id") == collection_id), allowed)
    if last_id is not None:
        rows = rows.where(F.col("embedding_id") > last_id)
    return rows.orderBy("embedding_id").limit(page_size)


def count_visible(embeddings: DataFrame, collection_id: int, allowed: Allowed) -> DataFrame:
    """How many rows of a collection the caller sees; 0 if none."""
    rows = visible(embeddings.where(F.col("collection_id") == collection_id), allowed)
    return rows.agg(F.count(F.lit(1)).alias("available_embeddings_count"))


def collections_with_counts(catalog: DataFrame, embeddings: DataFrame, allowed: Allowed) -> DataFrame:
    """Visible collections with their visible row counts, from one grouped count."""
    counts = (
        visible(embeddings, allowed).groupBy("collection_id").agg(F.count(F.lit(1)).alias("n"))
    )
    listed = visible_collections(catalog, allowed)
    return listed.join(counts, listed.id == counts.collection_id, "left").select(
        *listed.columns, F.coalesce("n", F.lit(0)).alias("available_embeddings_count")
    )
