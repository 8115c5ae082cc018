"""Changes of stored rows that move keys only.

What a put, update or delete does is found on narrow rows (ids, content keys, authz) of the stored
table; the batch's own vectors are the only ones that may be shuffled. Changed rows are then made where
they are read: the changes go to the stored buckets by broadcast, in blocks of checked size, so no
exchange carries a stored vector. Only a change of more than MAX_BLOCKS blocks, which touches most of a
large collection, is joined by shuffle.

A change table has one row per id: collection_id, embedding_id, the new_ fields (null for what stays),
``gone`` for rows that are deleted, and the row's ``bucket``. Of touched rows without new fields only
``updated_at`` moves.
"""

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from vecfold.functions.content import canonical_json, hash_uuid, vector_text
from vecfold.functions.vectors import stored_vector
from vecfold.operators import ingest
from vecfold.operators.access import Allowed, visible
from vecfold.operators.search import BadRequest
from vecfold.schemas import CONTENT_KEY, EMBEDDINGS
from vecfold.session import materialize

ROW_ID = ["collection_id", "embedding_id"]
# What is read of stored rows to find a change.
KEYS = [*ROW_ID, "embedding_hash", "metadata_hash", "authz", "bucket"]
FIELDS = ["embedding", "embedding_hash", "authz", "metadata", "metadata_hash"]
KIND = {f.name: f.dataType for f in EMBEDDINGS.fields}
CHANGES = T.StructType(
    [T.StructField(c, KIND[c]) for c in ROW_ID] + [T.StructField(f"new_{c}", KIND[c]) for c in FIELDS] + [T.StructField("gone", T.BooleanType())]
)

MARKED = T.StructType([*CHANGES.fields, T.StructField("bucket", T.IntegerType())])

BROADCAST_BYTES = 64 * 1024 * 1024
MAX_BLOCKS = 64


@dataclass
class Change:
    """What a request does to the table: a change table, rows to append with their keys, and the result
    per position."""

    changes: DataFrame | None = None
    added: DataFrame | None = None
    added_keys: DataFrame | None = None
    result: DataFrame | None = None


def _blank(row_ids: DataFrame, gone: bool) -> DataFrame:
    """Changes of rows that only move or go."""
    return row_ids.select(*ROW_ID, *[F.lit(None).cast(KIND[c]).alias(f"new_{c}") for c in FIELDS], F.lit(gone).alias("gone"), "bucket")


def merged_updates(updates: DataFrame, catalog: DataFrame) -> DataFrame:
    """Partial updates ``pos, collection_id, embedding_id, embedding, metadata, authz`` as changes: of
    several updates of one id the last given value of each field. Updates without a field are not there."""
    merged = updates.groupBy(*ROW_ID).agg(*[ingest.last_given(c) for c in ("embedding", "metadata", "authz")])
    kinds = catalog.select(F.col("id").alias("collection_id"), "vector_type")
    merged = merged.join(kinds, "collection_id").withColumn("canonical", canonical_json(F.col("new_metadata")))
    given = F.col("new_embedding").isNotNull()
    return merged.where(given | F.col("new_metadata").isNotNull() | F.col("new_authz").isNotNull()).select(
        *ROW_ID,
        F.when(given, stored_vector(F.col("new_embedding"), F.col("vector_type"))).alias("new_embedding"),
        F.when(given, hash_uuid(vector_text(F.col("new_embedding")))).alias("new_embedding_hash"),
        "new_authz",
        F.col("canonical").alias("new_metadata"),
        F.when(F.col("canonical").isNotNull(), hash_uuid(F.col("canonical"))).alias("new_metadata_hash"),
        F.lit(False).alias("gone"),
    )


def found_rows(keys: DataFrame, changes: DataFrame, allowed: Allowed) -> DataFrame:
    """The keys that the visible rows of a change table will have, as a stored narrow table."""
    new = changes.select(*ROW_ID, "new_embedding_hash", "new_metadata_hash", "new_authz")
    found = visible(keys, allowed).join(new, ROW_ID)
    keys_after = [F.coalesce(f"new_{c}", c).alias(c) for c in ("embedding_hash", "metadata_hash", "authz")]
    return materialize(found.select(*ROW_ID, *keys_after, "bucket"), "found")


def refuse_conflicts(keys: DataFrame, found: DataFrame) -> None:
    """Raise when two rows would share a content key after the rows in ``found`` took theirs."""
    twice = found.groupBy(*CONTENT_KEY).agg(F.count(F.lit(1)).alias("rows")).where("rows > 1")
    others = keys.join(found.select(*ROW_ID), ROW_ID, "left_anti").join(found.select(*CONTENT_KEY), CONTENT_KEY, "left_semi")
    if twice.first() is not None or others.first() is not None:
        raise ingest.Conflict("an update would duplicate a stored embedding")


def insert(keys: DataFrame, prepared: DataFrame, batch_id: str, now: Column) -> Change:
    """An all-or-nothing insert: rows are appended, none is read but for its key."""
    unique = materialize(ingest.unique_keys(prepared), "unique")
    if keys.join(unique, CONTENT_KEY, "left_semi").first() is not None:
        raise ingest.Conflict("one or more embeddings already exist, nothing was inserted")
    added = ingest.new_rows(ingest.dedup_batch(prepared), batch_id, now)
    return Change(added=added, added_keys=unique, result=ingest.insert_result(prepared, batch_id).select("pos", "embedding_id"))


def put(keys: DataFrame, prepared: DataFrame, catalog: DataFrame, allowed: Allowed, batch_id: str, now: Column, named: bool = True) -> Change:
    """Items with an id update it, the others upsert: stored keys only move their ``updated_at``.

    ``named`` tells whether any item has an id.
    """
    with_id, without_id = prepared.where("embedding_id is not null"), prepared.where("embedding_id is null")
    unique = materialize(ingest.unique_keys(without_id), "unique")
    of_batch = unique.select(*CONTENT_KEY)
    updates = None
    if named:
        updates = materialize(merged_updates(with_id, catalog), "changes")
        found = found_rows(keys, updates, allowed)
        missing = updates.join(found.select(*ROW_ID), ROW_ID, "left_anti").select("embedding_id").first()
        if missing is not None:
            raise BadRequest(f"failed to update embedding with id {missing.embedding_id}")
        refuse_conflicts(keys, found)
        # Stored keys as they are after the updates.
        keys = keys.join(found.select(*ROW_ID), ROW_ID, "left_anti").unionByName(found)
    held = materialize(keys.join(of_batch, CONTENT_KEY, "left_semi").select(*KEYS), "held")
    resolved = ingest.resolve_ids(ingest.match_stored(unique, held), batch_id)
    result = ingest.fan_out(without_id, resolved, ["embedding_id", "action"]).select("pos", "embedding_id", "action")
    changes = _blank(held, gone=False)
    if updates is not None:
        result = result.unionByName(with_id.select("pos", "embedding_id", F.lit("updated").alias("action")))
        placed = updates.join(found.select(*ROW_ID, "bucket"), ROW_ID)
        changes = placed.union(_blank(held.join(updates.select(*ROW_ID), ROW_ID, "left_anti"), gone=False))
    new_keys = unique.join(held.select(*CONTENT_KEY), CONTENT_KEY, "left_anti")
    added = ingest.new_rows(ingest.dedup_batch(without_id.join(held.select(*CONTENT_KEY), CONTENT_KEY, "left_anti")), batch_id, now)
    return Change(changes, added, new_keys, result.withColumnRenamed("pos", "input_index").orderBy("input_index"))


def update(keys: DataFrame, updates: DataFrame, catalog: DataFrame, allowed: Allowed) -> Change:
    """Partial updates of rows that are all visible."""
    changes = materialize(merged_updates(updates, catalog), "changes")
    found = found_rows(keys, changes, allowed)
    refuse_conflicts(keys, found)
    return Change(changes.join(found.select(*ROW_ID, "bucket"), ROW_ID))


def delete(keys: DataFrame, targets: DataFrame, allowed: Allowed) -> Change:
    """Deletes of the visible ones among ``collection_id, embedding_id``."""
    named = visible(keys, allowed).join(targets.select(*ROW_ID).distinct(), ROW_ID, "left_semi")
    return Change(materialize(_blank(named, gone=True), "changes"))


def applied(rows: DataFrame, changes: DataFrame, now: Column) -> DataFrame:
    """Stored rows joined to a change table, as they are after it."""
    known = changes.withColumn("named", F.lit(True))
    joined = rows.join(known, ROW_ID, "left").where(~F.coalesce("gone", F.lit(False)))
    new = {c: F.coalesce(f"new_{c}", c).alias(c) for c in FIELDS}
    new["updated_at"] = F.when(F.col("named"), now).otherwise(F.col("updated_at")).alias("updated_at")
    return joined.select(*[new.get(c, F.col(c)) for c in rows.columns])


def rewritten(rows: DataFrame, changes: DataFrame, now: Column, broadcast_bytes: int = BROADCAST_BYTES) -> DataFrame:
    """Stored rows with their ``bucket`` after the change table ``changes``, which has buckets too."""
    size = changes.agg(F.sum(F.coalesce(F.size("new_embedding"), F.lit(0)).cast("long") * 4 + F.coalesce(F.octet_length("new_metadata"), F.lit(0)) + 300)).first()[0] or 0
    blocks = -(-size // broadcast_bytes)
    if blocks > MAX_BLOCKS:
        return applied(rows, changes.drop("bucket"), now)
    out = None
    for i in range(max(1, blocks)):
        # Buckets are partitions, so each is read in one of the blocks only.
        of_block = (F.pmod(F.xxhash64("collection_id", "bucket"), F.lit(blocks)) == i) if blocks > 1 else F.lit(True)
        part = applied(rows.where(of_block), F.broadcast(changes.where(of_block).drop("bucket")), now)
        out = part if out is None else out.union(part)
    return out
