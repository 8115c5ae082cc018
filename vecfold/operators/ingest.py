"""Bulk changes of the embeddings table as pure functions: (state, input) -> new rows.

A batch is a frame with ``pos`` (input position), ``collection_id``, ``embedding`` (double
array), ``authz`` and ``metadata`` (JSON text). Nothing here writes; a failed check raises
before any commit.
"""

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from vecfold.functions.content import canonical_json, derived_id, hash_uuid, metadata_texts, vector_text
from vecfold.functions.names import authz_is_valid, default_authz
from vecfold.functions.vectors import half_overflows, stored_vector
from vecfold.operators.access import Allowed, visible, with_visibility
from vecfold.operators.search import BadRequest
from vecfold.operators.skew import lookup_join
from vecfold.schemas import CONTENT_KEY, EMBEDDINGS, JSON_BATCH_ROW


class Conflict(Exception):
    """A row with the same content key is already stored."""


def parse_json_batch(documents: DataFrame, column: str = "document") -> DataFrame:
    """Rows of JSON array documents, each with its ``pos`` in its document.

    Metadata is cut out of the document as text, so its numbers stay as they were written.
    """
    kind = T.StructType([f for f in JSON_BATCH_ROW.fields if f.name != "metadata"])
    parsed = F.from_json(F.col(column), f"array<{kind.simpleString()}>")
    others = [c for c in documents.columns if c != column]
    texts = documents.select(*others, parsed.alias("parsed"), metadata_texts(F.col(column)).alias("texts"))
    rows = texts.select(*others, "texts", F.posexplode("parsed").alias("pos", "row"))
    metadata = F.get("texts", F.col("pos")).alias("metadata")
    fields = [metadata if f.name == "metadata" else F.col(f"row.{f.name}") for f in JSON_BATCH_ROW.fields]
    return rows.select(*others, F.col("pos").cast("long").alias("pos"), *fields)


def with_collection(batch: DataFrame, catalog: DataFrame) -> DataFrame:
    known = catalog.select(F.col("id").alias("collection_id"), "collection_name", "dimensions", "vector_type")
    return batch.join(known, "collection_id")


def dimension_violations(batch: DataFrame, catalog: DataFrame) -> DataFrame:
    """Incoming rows whose vector has not the length its collection asks for."""
    return with_collection(batch, catalog).where(F.size("embedding") != F.col("dimensions"))


def _problem() -> Column:
    """What is wrong with an incoming row joined to its collection, null if nothing.

    ``canonical`` holds its metadata in canonical form.
    """
    return (
        F.when(F.col("dimensions").isNull(), F.lit("unknown collection"))
        .when(F.size("embedding") != F.col("dimensions"), F.lit("embedding dimension mismatch"))
        .when(F.exists("embedding", lambda v: v.isNull()), F.lit("embedding has a null element"))
        .when(~authz_is_valid(F.col("authz")), F.lit("authz must start with a slash (/)"))
        .when(F.exists("embedding", lambda v: F.isnan(v) | (F.abs(v.cast("float")) == float("inf"))), F.lit("embedding has a value that cannot be stored"))
        .when((F.col("vector_type") == "halfvec") & half_overflows(F.col("embedding")), F.lit("out of half range"))
        .when(F.col("canonical").isNull(), F.lit("metadata is not a JSON object"))
    )


def prepare_batch(batch: DataFrame, catalog: DataFrame) -> DataFrame:
    """The batch with defaults, canonical metadata and content keys, and a ``problem`` where a row
    is not acceptable.

    The vector's key is taken from the input values, before rounding to stored precision.
    """
    known = catalog.select(F.col("id").alias("collection_id"), "collection_name", "dimensions", "vector_type")
    rows = batch.withColumn("canonical", canonical_json(F.col("metadata"))).join(known, "collection_id", "left")
    rows = rows.withColumn("problem", _problem())
    metadata = F.when(F.col("problem").isNull(), F.col("canonical"))
    return rows.withColumn("metadata", metadata).select(
        "pos",
        "collection_id",
        "vector_type",
        "embedding",
        hash_uuid(vector_text(F.col("embedding"))).alias("embedding_hash"),
        default_authz(F.col("authz"), F.col("collection_name")).alias("authz"),
        "metadata",
        hash_uuid(F.col("metadata")).alias("metadata_hash"),
        *[c for c in batch.columns if c == "embedding_id"],
        "problem",
    )


def check_updates(updates: DataFrame, catalog: DataFrame) -> None:
    """Reject updates of which any given field is not acceptable."""
    known = catalog.select(F.col("id").alias("collection_id"), "dimensions", "vector_type")
    updates = updates.withColumn("canonical", canonical_json(F.col("metadata")))
    check_batch(updates.join(known, "collection_id", "left").withColumn("problem", _problem()))


def batch_collections(prepared: DataFrame) -> tuple[list[int], bool]:
    """The collections of a stored batch and whether any item names an id; refuses a batch with a problem.

    One row per collection, which is control data.
    """
    problem = F.min(F.when(F.col("problem").isNotNull(), F.struct("pos", "problem"))).alias("bad")
    named = F.max(F.col("embedding_id").isNotNull()) if "embedding_id" in prepared.columns else F.lit(False)
    rows = prepared.groupBy("collection_id").agg(problem, named.alias("named")).collect()
    for row in sorted((r for r in rows if r.bad), key=lambda r: r.bad.pos):
        raise BadRequest(f"item {row.bad.pos} of collection {row.collection_id}: {row.bad.problem}")
    return [r.collection_id for r in rows], any(r.named for r in rows)


def check_batch(prepared: DataFrame) -> None:
    """Reject a batch that has any row with a problem."""
    bad = prepared.where("problem is not null").select("pos", "collection_id", "problem").first()
    if bad is not None:
        raise BadRequest(f"item {bad.pos} of collection {bad.collection_id}: {bad.problem}")


def dedup_batch(prepared: DataFrame) -> DataFrame:
    """One row per content key with ``first_pos`` and ``copies``.

    A grouped minimum: copies merge before the shuffle, however often a row repeats.
    """
    return prepared.groupBy(*CONTENT_KEY, "vector_type", "embedding", "metadata").agg(
        F.min("pos").alias("first_pos"), F.count(F.lit(1)).alias("copies")
    )


def unique_keys(prepared: DataFrame) -> DataFrame:
    """The content keys of a batch with ``first_pos`` and ``copies``, without the vectors."""
    return prepared.groupBy(*CONTENT_KEY).agg(F.min("pos").alias("first_pos"), F.count(F.lit(1)).alias("copies"))


def fan_out(prepared: DataFrame, unique: DataFrame, columns: list[str]) -> DataFrame:
    """Every input position with ``columns`` of its unique row."""
    return lookup_join(prepared.select("pos", *CONTENT_KEY), unique.select(*CONTENT_KEY, *columns), CONTENT_KEY)


def insert_conflicts(unique: DataFrame, state: DataFrame) -> DataFrame:
    """Unique incoming rows whose content key is already stored."""
    return unique.join(state.select(*CONTENT_KEY), CONTENT_KEY, "left_semi")


def new_rows(unique: DataFrame, batch_id: str, now: Column) -> DataFrame:
    """Unique incoming rows in table form with derived ids."""
    rows = unique.withColumn("embedding_id", derived_id(batch_id, *[F.col(c) for c in CONTENT_KEY]))
    return rows.select(
        "collection_id",
        "vector_type",
        "embedding_id",
        stored_vector(F.col("embedding"), F.col("vector_type")).alias("embedding"),
        "embedding_hash",
        "authz",
        "metadata",
        "metadata_hash",
        now.alias("created_at"),
        now.alias("updated_at"),
    )


def insert(state: DataFrame, prepared: DataFrame, batch_id: str, now: Column) -> DataFrame:
    """The rows an all-or-nothing insert adds; raises when any key is stored already."""
    if insert_conflicts(unique_keys(prepared), state).first() is not None:
        raise Conflict("one or more embeddings already exist, nothing was inserted")
    return new_rows(dedup_batch(prepared), batch_id, now)


def insert_result(prepared: DataFrame, batch_id: str) -> DataFrame:
    """Every input position of an insert with the id of its row, which its key and batch fix."""
    new_id = derived_id(batch_id, *[F.col(c) for c in CONTENT_KEY])
    return prepared.select("pos", *CONTENT_KEY, new_id.alias("embedding_id"))


def match_stored(unique: DataFrame, state: DataFrame) -> DataFrame:
    """Unique incoming rows with the ``stored_id`` of the row that has their key, null if new."""
    stored = state.select(*CONTENT_KEY, F.col("embedding_id").alias("stored_id"))
    return unique.join(stored, CONTENT_KEY, "left")


def resolve_ids(matched: DataFrame, batch_id: str) -> DataFrame:
    """Matched rows with ``embedding_id`` (kept or derived) and ``action``."""
    new_id = derived_id(batch_id, *[F.col(c) for c in CONTENT_KEY])
    return matched.withColumn("embedding_id", F.coalesce("stored_id", new_id)).withColumn(
        "action", F.when(F.col("stored_id").isNull(), F.lit("inserted")).otherwise(F.lit("touched"))
    )


def upsert_state(state: DataFrame, unique: DataFrame, batch_id: str, now: Column) -> DataFrame:
    """The table after an upsert: stored rows keep everything but ``updated_at``, new keys append.

    Both sides hold a key once, so one full outer join on the key gives the new state.
    """
    incoming = new_rows(unique, batch_id, now).select([F.col(c).alias(f"new_{c}") for c in EMBEDDINGS.names])
    old = state.select([F.col(c).alias(f"old_{c}") for c in EMBEDDINGS.names])
    same_key = [F.col(f"old_{c}") == F.col(f"new_{c}") for c in CONTENT_KEY]
    newest = {"updated_at": ("new_updated_at", "old_updated_at")}
    return old.join(incoming, same_key, "full_outer").select(
        *[F.coalesce(*newest.get(c, (f"old_{c}", f"new_{c}"))).alias(c) for c in EMBEDDINGS.names]
    )


def upsert_result(prepared: DataFrame, state: DataFrame, batch_id: str) -> DataFrame:
    """Per input position: the id of its row, whether it was new, and its representative.

    Only keys and positions move, never vectors.
    """
    resolved = resolve_ids(match_stored(unique_keys(prepared), state), batch_id)
    return fan_out(prepared, resolved, ["first_pos", "embedding_id", "stored_id", "action"])


def last_given(column: str) -> Column:
    """The last non-null value of a field by input position."""
    value = F.col(column)
    return F.max_by(value, F.when(value.isNotNull(), F.col("pos"))).alias(f"new_{column}")


def update_by_id(state: DataFrame, updates: DataFrame, allowed: Allowed, now: Column) -> DataFrame:
    """The table after partial updates ``pos, collection_id, embedding_id, embedding, metadata, authz``.

    Null fields stay as they are, hashes follow the changed parts. Only visible rows change. Of
    several updates of one id the last given value of each field counts. The result carries
    ``changed``; call :func:`update_conflicts` before committing it.
    """
    fields = ["embedding", "metadata", "authz"]
    merged = updates.groupBy("collection_id", "embedding_id").agg(*[last_given(c) for c in fields])
    merged = merged.withColumn("new_canonical", canonical_json(F.col("new_metadata")))
    joined = with_visibility(state, allowed).join(merged, ["collection_id", "embedding_id"], "left")
    given = {c: F.col("visible") & F.col(f"new_{c}").isNotNull() for c in fields}
    new_metadata = F.col("new_canonical")
    changed = given["embedding"] | given["metadata"] | given["authz"]
    return joined.select(
        "collection_id",
        "vector_type",
        "embedding_id",
        F.when(given["embedding"], stored_vector(F.col("new_embedding"), F.col("vector_type")))
        .otherwise(F.col("embedding"))
        .alias("embedding"),
        F.when(given["embedding"], hash_uuid(vector_text(F.col("new_embedding"))))
        .otherwise(F.col("embedding_hash"))
        .alias("embedding_hash"),
        F.when(given["authz"], F.col("new_authz")).otherwise(F.col("authz")).alias("authz"),
        F.when(given["metadata"], new_metadata).otherwise(F.col("metadata")).alias("metadata"),
        F.when(given["metadata"], hash_uuid(new_metadata)).otherwise(F.col("metadata_hash")).alias("metadata_hash"),
        "created_at",
        F.when(changed, now).otherwise(F.col("updated_at")).alias("updated_at"),
        F.coalesce(changed, F.lit(False)).alias("changed"),
    )


def update_conflicts(updated: DataFrame) -> DataFrame:
    """Content keys that more than one row would hold after the update."""
    grouped = updated.groupBy(*CONTENT_KEY).agg(F.count(F.lit(1)).alias("rows"), F.max("changed").alias("changed"))
    return grouped.where("rows > 1 and changed").drop("changed")


def missing_ids(state: DataFrame, updates: DataFrame, allowed: Allowed) -> DataFrame:
    """Updates whose id is not a visible row of their collection."""
    seen = visible(state, allowed).select("collection_id", "embedding_id")
    return updates.join(seen, ["collection_id", "embedding_id"], "left_anti")


def put_mixed(
    state: DataFrame, prepared: DataFrame, allowed: Allowed, batch_id: str, now: Column
) -> tuple[DataFrame, DataFrame]:
    """(new state, result per position): items with an id update it, the others upsert.

    Raises before any commit when an id is missing or an update would duplicate a row.
    """
    with_id = prepared.where("embedding_id is not null")
    without_id = prepared.where("embedding_id is null")
    missing = missing_ids(state, with_id, allowed).select("embedding_id").first()
    if missing is not None:
        raise BadRequest(f"failed to update embedding with id {missing.embedding_id}")
    updated = update_by_id(state, with_id, allowed, now)
    if update_conflicts(updated).first() is not None:
        raise Conflict("an update would duplicate a stored embedding")
    updated = updated.drop("changed")
    by_key = upsert_result(without_id, updated, batch_id).select("pos", "embedding_id", "action")
    by_id = with_id.select("pos", "embedding_id", F.lit("updated").alias("action"))
    result = by_key.unionByName(by_id).withColumnRenamed("pos", "input_index").orderBy("input_index")
    return upsert_state(updated, dedup_batch(without_id), batch_id, now), result


def delete_by_ids(state: DataFrame, targets: DataFrame, allowed: Allowed) -> tuple[DataFrame, DataFrame]:
    """(remaining rows, deleted ids) for visible rows named by ``collection_id, embedding_id``."""
    row_id = ["collection_id", "embedding_id"]
    named = targets.select(*row_id).distinct().withColumn("named", F.lit(True))
    marked = with_visibility(state, allowed).join(named, row_id, "left")
    goes = F.col("visible") & F.col("named").isNotNull()
    return marked.where(~goes).select(*state.columns), marked.where(goes).select(*row_id)
