"""Exact similarity search: one query against one collection or across collections.

The plan is a pruned scan, a projection of ``value`` and one top-k: every task keeps k rows,
so no vector is shuffled.
"""

import math
import operator
from collections.abc import Mapping, Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from vecfold.functions.content import json_with, metadata_fields
from vecfold.functions.names import collection_path, embedding_path, normalize_name, split_names
from vecfold.functions.vectors import distance_to, half_query
from vecfold.operators.access import Allowed, visible
from vecfold.operators.fields import column_matches
from vecfold.operators.skew import lookup_join
from vecfold.schemas import DEFAULT_TOP_K, Metric, VectorType


class BadRequest(Exception):
    """The request is rejected as a whole."""


def _half_query(query: Sequence[float]) -> list[float]:
    rounded = half_query(query)
    if not all(math.isfinite(v) for v in rounded):
        raise BadRequest("input is out of half range")
    return rounded


def check_query(query: Sequence[float], dimensions: int | None = None) -> list[float]:
    if isinstance(query, str):
        raise BadRequest("search by text is not supported, pass a vector")
    if not query or not all(isinstance(v, (int, float)) and not isinstance(v, bool) for v in query):
        raise BadRequest("input must be a numeric vector")
    if not all(math.isfinite(v) for v in query):
        raise BadRequest("input must be finite numbers")
    if dimensions is not None and len(query) != dimensions:
        raise BadRequest(f"input vector has {len(query)} dimensions, expected {dimensions}")
    return [float(v) for v in query]


def metadata_filter(filters: Mapping[str, str] | None, stored_fields: Sequence[str] = ()) -> Column:
    """All fields equal as text; a missing field or JSON null never matches.

    ``stored_fields`` have a column of their own in the rows, which the reader can filter by.
    """
    filters = dict(filters or {})
    by_column = [column_matches(key, filters.pop(key)) for key in list(filters) if key in stored_fields and isinstance(filters[key], str)]
    if not filters:
        return reduce(operator.and_, by_column, F.lit(True))

    def matches(fields: Column) -> Column:
        conditions = [F.element_at(fields, F.lit(key)) == F.lit(wanted) for key, wanted in filters.items()]
        return reduce(operator.and_, conditions)

    # As the element of an array the metadata is parsed once for all fields.
    return reduce(operator.and_, by_column, F.exists(F.array(metadata_fields(F.col("metadata"))), matches))


def value_bounds(min_value: float | None, max_value: float | None) -> Column:
    """Inclusive bounds on the metric value itself (so on the negated inner product)."""
    condition = F.lit(True)
    if min_value is not None:
        condition = condition & (F.col("value") >= F.lit(float(min_value)))
    if max_value is not None:
        condition = condition & (F.col("value") <= F.lit(float(max_value)))
    return condition


def ranked(hits: DataFrame, metric: Metric | str, top_k: int) -> DataFrame:
    if top_k < 0:
        raise BadRequest("top_k must not be negative")
    value = F.col("value")
    order = value.asc() if Metric(metric).ascending else value.desc()
    return hits.orderBy(order, F.col("embedding_id")).limit(top_k)


def search_rows(
    rows: DataFrame,
    query: Sequence[float],
    *,
    allowed: Allowed,
    metric: Metric | str = Metric.cosine_similarity,
    top_k: int = DEFAULT_TOP_K,
    filters: Mapping[str, str] | None = None,
    min_value: float | None = None,
    max_value: float | None = None,
    columns: Sequence[str] = (),
    kernel: str = "auto",
    stored_fields: Sequence[str] = (),
) -> DataFrame:
    """The best ``top_k`` visible rows as ``collection_id, embedding_id, value`` and ``columns``.

    ``rows`` must hold vectors of the query's length; ties go to the smaller embedding id.
    ``stored_fields`` are the metadata fields that have a column in ``rows``.
    """
    scored = (
        visible(rows, allowed)
        .where(metadata_filter(filters, stored_fields))
        .select(
            "collection_id",
            "embedding_id",
            *columns,
            distance_to(metric, F.col("embedding"), check_query(query), kernel).alias("value"),
        )
        .where(value_bounds(min_value, max_value))
    )
    return ranked(scored, metric, top_k)


def search_collection(embeddings: DataFrame, collection, query: Sequence[float], **options) -> DataFrame:
    """Search one collection, given as its catalog row."""
    query = check_query(query, collection.dimensions)
    if collection.vector_type == VectorType.halfvec:
        query = _half_query(query)
    rows = embeddings.where(
        (F.col("vector_type") == collection.vector_type) & (F.col("collection_id") == collection.id)
    )
    return search_rows(rows, query, **options)


def eligible_collections(catalog: DataFrame, vector_type: VectorType | str, dimensions: int) -> DataFrame:
    """Collections a query of this precision and length can be compared with."""
    return catalog.where((F.col("vector_type") == str(vector_type)) & (F.col("dimensions") == dimensions))


def model_conflicts(catalog: DataFrame, request: Sequence[str] = (), requested: Column | None = None) -> DataFrame:
    """Requests whose collections do not all carry one model (and the requested one, if given)."""
    grouped = catalog.groupBy(*request).agg(
        F.min("ai_model_name").alias("first_model"),
        F.max("ai_model_name").alias("last_model"),
        F.max(F.col("ai_model_name").isNull()).alias("has_unset"),
    )
    conflict = (F.col("first_model") != F.col("last_model")) | (
        F.col("has_unset") & F.col("last_model").isNotNull()
    )
    if requested is not None:
        conflict = conflict | ~F.col("last_model").eqNullSafe(requested)
    return grouped.where(conflict)


def search_across(
    embeddings: DataFrame,
    catalog: DataFrame,
    query: Sequence[float],
    *,
    vector_type: VectorType | str = VectorType.vector,
    **options,
) -> DataFrame:
    """One ranking over every eligible collection of ``catalog``, each hit with its collection.

    The catalog joins the scan, small catalogs by broadcast as Spark's size check decides.
    """
    query = check_query(query)
    if vector_type == VectorType.halfvec:
        query = _half_query(query)
    eligible = eligible_collections(catalog, vector_type, len(query)).select(
        F.col("id").alias("collection_id"), "collection_name"
    )
    rows = embeddings.where(F.col("vector_type") == str(vector_type)).join(eligible, "collection_id")
    columns = ["collection_name", *options.pop("columns", ())]
    return search_rows(rows, query, columns=columns, **options)


def check_eligible(catalog: DataFrame, vector_type: VectorType | str, dimensions: int) -> None:
    if eligible_collections(catalog, vector_type, dimensions).first() is None:
        raise BadRequest(f"no collection of type {vector_type} with {dimensions} dimensions")


def hit_collections(hits: DataFrame, catalog: DataFrame) -> DataFrame:
    """Collections that have at least one hit."""
    return catalog.join(hits.select(F.col("collection_id").alias("id")), "id", "left_semi")


def resolve_names(requests: DataFrame, catalog: DataFrame) -> DataFrame:
    """Requested comma lists (``request_id, collections``) as one row per entry.

    ``collection_id`` is null where the entry is malformed, unknown or hidden; any such entry
    rejects its whole request.
    """
    entries = requests.select("request_id", F.posexplode(split_names(F.col("collections"))).alias("pos", "entry"))
    entries = entries.withColumn("collection_name", normalize_name(F.col("entry")))
    known = catalog.select(F.col("id").alias("collection_id"), "collection_name")
    # Malformed entries have no name and meet nothing; a name that very many requests ask for is looked up where they are.
    named = lookup_join(entries.where("collection_name is not null"), known, ["collection_name"], "left")
    unnamed = entries.where("collection_name is null").withColumn("collection_id", F.lit(None).cast("long"))
    return named.unionByName(unnamed).select("request_id", "pos", "entry", "collection_id")


def rejected_requests(resolved: DataFrame) -> DataFrame:
    return resolved.where("collection_id is null").select("request_id").distinct()


def info_struct(collection_name: Column) -> Column:
    """What a document says about its row; metadata is its JSON text as stored, see :func:`info_json`."""
    return F.struct(
        "collection_id",
        "authz",
        "metadata",
        embedding_path(collection_name, F.col("embedding_id")).alias("self"),
    )


def info_json(info: Column) -> Column:
    """An info struct as JSON, its metadata put in unparsed, so that every number is as it was written."""
    first = json_with(F.struct(info["collection_id"].alias("collection_id"), info["authz"].alias("authz")), "metadata", info["metadata"])
    end = F.to_json(F.struct(info["self"].alias("self")))
    joined = F.concat(F.substring(first, F.lit(1), F.length(first) - 1), F.lit(","), F.substring(end, F.lit(2), F.length(end)))
    return F.when(info.isNotNull(), F.when(info["self"].isNull(), first).otherwise(joined))


def search_documents(hits: DataFrame, metric: Metric | str, exclude_info: bool = False) -> DataFrame:
    """Hits (with ``collection_name, authz, metadata, embedding``) in the nested result shape."""
    parts = [F.col("embedding").alias("vector"), F.col("embedding_id")]
    if not exclude_info:
        parts.append(info_struct(F.col("collection_name")).alias("info"))
    return hits.select(
        F.col("embedding_id").alias("id"),
        F.lit(str(Metric(metric))).alias("distance_metric"),
        "value",
        F.struct(*parts).alias("embedding"),
    )


def collection_documents(catalog: DataFrame) -> DataFrame:
    """Catalog rows with their self link, ready for a response."""
    return catalog.withColumn("self", collection_path(F.col("collection_name")))
