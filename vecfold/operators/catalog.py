"""Changes of the collection catalog as pure functions."""

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from vecfold.functions.names import normalize_name
from vecfold.operators.access import Allowed, NotAllowed, allowed_collections, collection_names
from vecfold.operators.search import BadRequest
from vecfold.operators.skew import lookup_join
from vecfold.schemas import COLLECTIONS


def allowed_names(frame: DataFrame, allowed: Allowed) -> DataFrame:
    """Rows of ``frame`` whose collection name the caller holds."""
    if isinstance(allowed, DataFrame):
        return frame.join(allowed_collections(allowed), "collection_name", "left_semi")
    names = collection_names(allowed)
    return frame.where(F.col("collection_name").isin(names)) if names else frame.where(F.lit(False))


def classify_new_collections(requested: DataFrame, catalog: DataFrame, allowed: Allowed) -> DataFrame:
    """Requested collections with ``outcome``: invalid name, forbidden, conflict or created.

    Of several requests for one name the first (by ``pos``) is created, the others conflict.
    """
    named = requested.withColumn("collection_name", normalize_name(F.col("requested_name")))
    valid = named.where("collection_name is not null")
    names = valid.groupBy("collection_name").agg(F.min("pos").alias("first_pos"))
    permitted = allowed_names(names, allowed).select("collection_name", F.lit(True).alias("permitted"))
    taken = catalog.select("collection_name", F.lit(True).alias("taken"))
    facts = names.join(permitted, "collection_name", "left").join(taken, "collection_name", "left")
    outcome = (
        F.when(F.col("permitted").isNull(), F.lit("forbidden"))
        .when(F.col("taken").isNotNull() | (F.col("pos") != F.col("first_pos")), F.lit("conflict"))
        .otherwise(F.lit("created"))
    )
    judged = lookup_join(valid, facts, ["collection_name"]).withColumn("outcome", outcome)
    invalid = named.where("collection_name is null").withColumn("outcome", F.lit("invalid"))
    return judged.select(*invalid.columns).unionByName(invalid)


def create_collections(requested: DataFrame, catalog: DataFrame, allowed: Allowed, now: Column) -> DataFrame:
    """The catalog with the requested collections appended; any refusal rejects all of them."""
    classified = classify_new_collections(requested, catalog, allowed)
    refused = classified.where("outcome <> 'created'").select("requested_name", "outcome").first()
    if refused is not None:
        error = NotAllowed if refused.outcome == "forbidden" else BadRequest
        raise error(f"collection {refused.requested_name}: {refused.outcome}")
    return catalog.unionByName(new_collections(classified, catalog, now))


def new_collections(classified: DataFrame, catalog: DataFrame, now: Column) -> DataFrame:
    """Catalog rows of the created collections.

    Ids follow the highest stored one by position in the request; like any identity column they
    may have gaps, and no row has to be counted in one place.
    """
    last = catalog.agg(F.coalesce(F.max("id"), F.lit(0))).first()[0]
    return classified.where("outcome = 'created'").select(
        (F.col("pos") + F.lit(last + 1)).cast("long").alias("id"),
        "collection_name",
        "description",
        "ai_model_name",
        "dimensions",
        F.coalesce("vector_type", F.lit("vector")).alias("vector_type"),
        now.alias("created_at"),
        now.alias("updated_at"),
    ).select(*COLLECTIONS.names)


def update_collections(catalog: DataFrame, updates: DataFrame, allowed: Allowed, now: Column) -> DataFrame:
    """The catalog with new descriptions (``pos, collection_name, description``).

    Null changes nothing; of several texts for one name the last counts.
    """
    place = F.when(F.col("description").isNotNull(), F.col("pos"))
    changes = allowed_names(updates, allowed).groupBy("collection_name").agg(
        F.max_by("description", place).alias("new_description")
    )
    joined = catalog.join(changes, "collection_name", "left")
    changed = F.col("new_description").isNotNull()
    return joined.select(
        *[
            F.coalesce("new_description", "description").alias(c)
            if c == "description"
            else F.when(changed, now).otherwise(F.col(c)).alias(c)
            if c == "updated_at"
            else F.col(c)
            for c in COLLECTIONS.names
        ]
    )


def delete_collections(
    catalog: DataFrame, embeddings: DataFrame, names: DataFrame, allowed: Allowed
) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(catalog left, embeddings left, collections deleted).

    Rows of a deleted collection go with it whatever their own ``authz``.
    """
    deleted = allowed_names(catalog, allowed).join(names.select("collection_name"), "collection_name", "left_semi")
    left = catalog.join(deleted.select("id"), "id", "left_anti")
    rows = embeddings.join(deleted.select(F.col("id").alias("collection_id")), "collection_id", "left_anti")
    return left, rows, deleted
