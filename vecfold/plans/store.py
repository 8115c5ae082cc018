"""The vector store: every request from checks to commit.

Rights are passed in by action: reads and searches take the caller's read list, puts and updates
the update list, inserts the create list.
"""

from collections.abc import Sequence

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from vecfold.functions.names import normalize_authz
from vecfold.operators import access, catalog, changes, fields, index, ingest, reads, search
from vecfold.operators.access import Allowed
from vecfold.schemas import CONTENT_KEY, DEFAULT_PAGE_SIZE, DEFAULT_TOP_K, EMBEDDINGS, Metric, VectorType
from vecfold.session import materialize
from vecfold.sources.tables import Tables, bucket_count


class NotFound(Exception):
    """The collection does not exist or is hidden from the caller."""


class VectorStore:
    def __init__(self, spark: SparkSession, root: str):
        self.spark = spark
        self.tables = Tables(spark, root)

    def collections(self, allowed: Allowed, generation: int | None = None) -> DataFrame:
        return access.visible_collections(self.tables.collections(generation), allowed)

    def embeddings(self, allowed: Allowed) -> DataFrame:
        return access.visible(self.tables.embeddings(), allowed)

    def collection(self, name: str, allowed: Allowed, generation: int | None = None):
        row = self.collections(allowed, generation).where(F.col("collection_name") == name.strip().lower()).first()
        if row is None:
            raise NotFound(f"collection {name} not found")
        return row

    # Catalog

    def create_collections(self, requested: DataFrame, allowed: Allowed) -> int:
        """``requested`` has ``pos, requested_name, description, ai_model_name, dimensions, vector_type``."""
        generation = self.tables.generation()
        known = self.tables.collections(generation)
        created = catalog.create_collections(requested, known, allowed, F.current_timestamp())
        return self.tables.commit(created, expect=generation)

    def update_collections(self, updates: DataFrame, allowed: Allowed) -> int:
        generation = self.tables.generation()
        known = self.tables.collections(generation)
        updated = catalog.update_collections(known, updates, allowed, F.current_timestamp())
        return self.tables.commit(updated, expect=generation)

    def delete_collections(self, names: Sequence[str], allowed: Allowed) -> int:
        """Number of collections deleted, with all their rows."""
        generation = self.tables.generation()
        known = self.tables.collections(generation)
        doomed = catalog.allowed_names(known.where(F.col("collection_name").isin(list(names))), allowed)
        ids = [row.id for row in doomed.select("id").collect()]
        if ids:
            self.tables.commit(known.where(~F.col("id").isin(ids)), expect=generation)
        return len(ids)

    # Rows

    def _gate(self, ids: Sequence[int], known: DataFrame, *lists: Allowed) -> None:
        """Every collection of a write must be one that each of the caller's lists names."""
        for allowed in lists:
            seen = access.visible_collections(known.where(F.col("id").isin(list(ids))), allowed).select("id").collect()
            hidden = set(ids) - {row.id for row in seen}
            if hidden:
                raise NotFound(f"collection {min(hidden)} not found")

    def _start(self, batch: DataFrame) -> tuple[int, DataFrame, DataFrame, DataFrame, list[int], bool]:
        """Generation, catalog, prepared batch, stored keys and ids of the touched collections, and
        whether any item names an id."""
        generation = self.tables.generation()
        known = self.tables.collections(generation)
        prepared = materialize(ingest.prepare_batch(batch, known), "prepared")
        touched, named = ingest.batch_collections(prepared)
        return generation, known, prepared, self._keys(generation, touched), touched, named

    def _keys(self, generation: int, touched: Sequence[int]) -> DataFrame:
        return self.tables.bucketed(generation, touched).select(*changes.KEYS)

    def _commit(self, generation: int, touched: Sequence[int], change: changes.Change, now: Column, stream: tuple[str, int] | None = None) -> None:
        """Commit a change: appends its new rows and replaces the buckets of changed ones.

        Collections that outgrow their buckets are written whole. Sizes and numbers of buckets come to
        the driver, a row per touched collection or bucket.
        """
        sizes = self.tables.sizes(touched, generation)
        indexed = index.read_cells(self.tables.cells(touched, generation))
        more = {}
        if change.added_keys is not None:
            more = {r.collection_id: r["count"] for r in change.added_keys.groupBy("collection_id").count().collect()}
        wanted = {i: bucket_count(sizes[i].rows + n, sizes[i].dimensions) for i, n in more.items() if i not in indexed}
        grown = [i for i, n in wanted.items() if sizes[i].buckets is None or n >= 4 * sizes[i].buckets]
        held = {i: size.buckets for i, size in sizes.items() if size.buckets is not None}
        marked, pairs = change.changes, set()
        if marked is not None:
            pairs = {(r.collection_id, r.bucket) for r in marked.select("collection_id", "bucket").distinct().collect()}
        if not pairs and not more:
            if stream is not None:
                self.tables.commit(expect=generation, stream=stream)
            return
        marked = self.spark.createDataFrame([], changes.CHANGES) if marked is None else marked
        pairs |= {(i, b) for i, size in sizes.items() for b in size.many or ()}
        pairs = sorted(p for p in pairs if p[0] not in grown)
        of = lambda ids: F.col("collection_id").isin(list(ids))
        whole = kept = added = cells = None
        if grown:
            whole = changes.rewritten(self.tables.bucketed(generation, grown), marked.where(of(grown)), now).select(*EMBEDDINGS.names)
            whole = whole.unionByName(change.added.where(of(grown)))
        new = change.added.where(~of(grown)) if set(more) - set(grown) else None
        if indexed:
            # Rows with a new vector may change their cell: they leave their bucket and come anew.
            moving = of(indexed) & F.col("new_embedding").isNotNull()
            moved = changes.rewritten(self.tables.bucketed(generation, buckets=[p for p in pairs if p[0] in indexed]), marked.where(moving), now)
            moved = moved.join(F.broadcast(marked.where(moving).select(*changes.ROW_ID)), changes.ROW_ID, "left_semi").select(*EMBEDDINGS.names)
            marked = marked.withColumn("gone", F.col("gone") | moving)
            placed = materialize(index.placed(moved if new is None else moved.unionByName(new.where(of(indexed))), indexed), "in-cells")
            cells = index.widened(self.tables.cells(touched, generation), placed)
            new = new.where(~of(indexed)) if set(more) - set(grown) - set(indexed) else None
            added = placed.drop("radius")
        if new is not None:
            hashed = self.tables.with_bucket(new, {i: held[i] for i in more if i not in indexed and i not in grown})
            added = hashed if added is None else added.unionByName(hashed)
        if pairs:
            kept = changes.rewritten(self.tables.bucketed(generation, buckets=pairs), marked, now)
        buckets = {i: wanted[i] for i in grown}
        self.tables.commit(None, whole, grown, generation, buckets=buckets, added=added, replaced=pairs, kept=kept, stream=stream, cells=cells)
        if indexed:
            self._split_cells(list(indexed))

    # Metadata columns

    def store_fields(self, names: Sequence[str], allowed: Allowed, chosen: Sequence[str] | None = None) -> list[str]:
        """Store metadata fields as columns too; gives all that the table now has.

        Without ``chosen`` the frequent fields of the collections in ``names`` are taken, as many as fit. Those collections
        are written anew at once, without an exchange; others get the columns as changes write their
        buckets. Searches give the same rows before and after.
        """
        generation = self.tables.generation()
        ids = sorted({self.collection(name, allowed, generation).id for name in names})
        rows = self.tables.bucketed(generation, ids)
        held = self.tables.fields(generation)
        if chosen is None:
            taken = {field.lower() for field in held}
            chosen = [f for f in fields.frequent_fields(rows) if f.lower() not in taken][: fields.MAX_FIELDS - len(held)]
        every = fields.checked([*held, *chosen])
        buckets = {i: size.buckets for i, size in self.tables.sizes(ids, generation).items() if size.buckets is not None}
        self.tables.commit(None, None, sorted(buckets), generation, buckets=buckets, kept=rows if buckets else None, fields=every)
        return every

    def _fields_asked(self, filters, generation: int) -> list[str]:
        """Those fields of a filter that have a column."""
        return [f for f in self.tables.fields(generation) if f in filters] if filters else []

    # Indexes

    def index_collection(
        self, name: str, allowed: Allowed, metric: Metric | str = Metric.l2_distance, centroids: np.ndarray | None = None, cell_rows: int = index.CELL_ROWS
    ) -> int:
        """Lay a collection out by cells, in one commit; gives the number of cells.

        From then on its rows lie in the bucket of the cell with the nearest centroid: puts place theirs,
        cells that grow too large are split, and searches read the cells of their generation. Centroids are
        trained on a sample unless given.
        """
        generation = self.tables.generation()
        collection = self.collection(name, allowed, generation)
        rows = self.tables.embeddings(generation, [collection.id])
        built = index.build(rows, collection.id, metric, centroids, cell_rows)
        if built is None:
            raise search.BadRequest(f"collection {name} has no rows to index")
        placed, cells = built
        number = cells.count()
        self.tables.commit(None, placed.drop("radius"), [collection.id], generation, buckets={collection.id: number}, cells=cells)
        return number

    def _split_cells(self, ids: Sequence[int]) -> None:
        """Cut cells of too many rows in two, in a commit of its own."""
        generation = self.tables.generation()
        cells = self.tables.cells(ids, generation)
        held = self.tables.pieces(generation).groupBy("id", "bucket").agg(F.sum("rows").alias("rows"))
        full = cells.where("radius > 0").join(held.where(F.col("rows") > index.SPLIT_ROWS), ["id", "bucket"]).select("id", "bucket").collect()
        if full:
            pairs = [(r.id, r.bucket) for r in full]
            placed, cells = index.split(self.tables.bucketed(generation, buckets=pairs), cells, pairs)
            self.tables.commit(expect=generation, replaced=pairs, kept=placed.drop("radius"), cells=cells)

    def search_index(
        self, name: str, query: Sequence[float], allowed: Allowed, *, probes: int | None = index.PROBES, generation: int | None = None, **options
    ) -> DataFrame:
        """Search an indexed collection by the metric of its cells, as of now or of a generation.

        With ``probes`` only so many cells nearest to the query are read, and the result is approximate;
        with None it is exact, and cells that cannot hold a better row are not read.
        """
        generation = self.tables.generation() if generation is None else generation
        collection = self.collection(name, allowed, generation)
        cells = index.read_cells(self.tables.cells([collection.id], generation)).get(collection.id)
        if cells is None:
            raise search.BadRequest(f"collection {name} has no index")
        asked = self._fields_asked(options.get("filters"), generation)
        options = {**options, "allowed": allowed, "metric": cells.space.metric, "stored_fields": asked}

        def read(numbers: Sequence[int]) -> DataFrame:
            rows = self.tables.embeddings(generation, buckets=[(collection.id, int(n)) for n in numbers], fields=asked)
            return search.search_collection(rows, collection, query, **options)

        return index.search(cells, query, read, probes, options.get("top_k", DEFAULT_TOP_K))

    # Rows

    def insert(self, batch: DataFrame, allowed: Allowed, batch_id: str, now: Column | None = None) -> DataFrame:
        """All-or-nothing bulk insert; gives ``pos, embedding_id`` for every input position."""
        now = F.current_timestamp() if now is None else now
        generation, known, prepared, keys, touched, _ = self._start(batch)
        self._gate(touched, known, allowed)
        access.check_writable(prepared, allowed)
        change = changes.insert(keys, prepared, batch_id, now)
        self._commit(generation, touched, change, now)
        return change.result

    def put(
        self,
        batch: DataFrame,
        allowed: Allowed,
        batch_id: str,
        now: Column | None = None,
        create_allowed: Allowed | None = None,
        stream: tuple[str, int] | None = None,
    ) -> DataFrame:
        """Bulk put: items with an id update it, the others upsert, in one commit.

        ``allowed`` is the caller's update list. Collections and rows must be in the create list too,
        which is the same one unless given. ``stream`` is a stream's name and the number of its batch: a
        batch that is part of the table already changes nothing.
        """
        lists = (allowed,) if create_allowed is None else (allowed, create_allowed)
        now = F.current_timestamp() if now is None else now
        if "embedding_id" not in batch.columns:
            batch = batch.withColumn("embedding_id", F.lit(None).cast("string"))
        generation, known, prepared, keys, touched, named = self._start(batch)
        self._gate(touched, known, *lists)
        for held in lists:
            access.check_writable(prepared, held)
        change = changes.put(keys, prepared, known, allowed, batch_id, now, named)
        last = None if stream is None else self.tables.last_batch(stream[0], generation)
        if last is None or stream[1] > last:
            self._commit(generation, touched, change, now, stream)
        return change.result

    def add(self, rows: DataFrame) -> None:
        """Append rows of the table's form, for instance from another store; no caller's rights are asked."""
        generation = self.tables.generation()
        touched = [r.collection_id for r in rows.select("collection_id").distinct().collect()]
        self._commit(generation, touched, changes.Change(added=rows, added_keys=rows.select(*CONTENT_KEY)), F.current_timestamp())

    def update(self, updates: DataFrame, allowed: Allowed, now: Column | None = None) -> int:
        """Partial updates by id (``pos, collection_id, embedding_id, embedding, metadata, authz``, null
        for what stays); gives the number of rows changed. All are made or none."""
        now = F.current_timestamp() if now is None else now
        generation = self.tables.generation()
        known = self.tables.collections(generation)
        updates = updates.withColumn("authz", normalize_authz(F.col("authz")))
        updates = materialize(updates, "updates")
        ingest.check_updates(updates, known)
        access.check_writable(updates.where("authz is not null"), allowed)
        touched = [row[0] for row in updates.select("collection_id").distinct().collect()]
        self._gate(touched, known, allowed)
        keys = self._keys(generation, touched)
        missing = ingest.missing_ids(keys, updates, allowed).first()
        if missing is not None:
            raise NotFound(f"embedding {missing.embedding_id} not found")
        change = changes.update(keys, updates, known, allowed)
        self._commit(generation, touched, change, now)
        return change.changes.count()

    def delete_embeddings(self, targets: DataFrame, allowed: Allowed) -> int:
        """Number of visible rows deleted among ``collection_id, embedding_id``."""
        generation = self.tables.generation()
        known = self.tables.collections(generation)
        touched = [row[0] for row in targets.select("collection_id").distinct().collect()]
        self._gate(touched, known, allowed)
        change = changes.delete(self._keys(generation, touched), targets, allowed)
        self._commit(generation, touched, change, F.current_timestamp())
        return change.changes.count()

    # Reads

    def search(self, name: str, query: Sequence[float], allowed: Allowed, **options) -> DataFrame:
        generation = self.tables.generation()
        collection = self.collection(name, allowed, generation)
        asked = self._fields_asked(options.get("filters"), generation)
        return search.search_collection(
            self.tables.embeddings(generation, [collection.id], fields=asked), collection, query, allowed=allowed, stored_fields=asked, **options
        )

    def search_all(
        self,
        query: Sequence[float],
        allowed: Allowed,
        *,
        names: str | None = None,
        vector_type: VectorType | str = VectorType.vector,
        ai_model: str | None = None,
        **options,
    ) -> DataFrame:
        """Search every visible collection, or those of a comma list; an unknown name rejects it."""
        generation = self.tables.generation()
        known = self.collections(allowed, generation)
        if names:
            request = self.spark.range(1).select(F.lit(0).alias("request_id"), F.lit(names).alias("collections"))
            resolved = search.resolve_names(request, known)
            refused = resolved.where("collection_id is null").first()
            if refused is not None:
                raise search.BadRequest(f"invalid or hidden collection {refused.entry}")
            known = known.join(resolved.select(F.col("collection_id").alias("id")), "id", "left_semi")
            if ai_model is not None and search.model_conflicts(known, (), F.lit(ai_model)).first() is not None:
                raise search.BadRequest("the collections do not share the requested model")
        dimensions = len(search.check_query(query))
        if not known.isEmpty():  # nothing visible is an empty result, nothing comparable an error
            search.check_eligible(known, vector_type, dimensions)
        # The folders of eligible collections only.
        eligible = search.eligible_collections(known, vector_type, dimensions)
        asked = self._fields_asked(options.get("filters"), generation)
        return search.search_across(
            self.tables.embeddings(generation, eligible, fields=asked), known, query, vector_type=vector_type, allowed=allowed, stored_fields=asked, **options
        )

    def read_ordered(self, name: str, ids: Sequence[str] | DataFrame, allowed: Allowed) -> DataFrame:
        """Rows of the requested ids of one collection, in request order, with binary vectors."""
        requested = ids if isinstance(ids, DataFrame) else reads.id_positions(self.spark, ids)
        generation = self.tables.generation()
        collection = self.collection(name, allowed, generation)
        found = reads.bulk_read_ordered(self.tables.embeddings(generation, [collection.id]), requested, allowed, collection.id)
        return reads.binary_vectors(found)

    def read_any(self, ids: Sequence[str] | DataFrame, allowed: Allowed, exclude_info: bool = False) -> tuple[DataFrame, DataFrame]:
        """Nested binary documents of the requested ids in any visible collection, in request order, and
        the collections they lie in (with their self links)."""
        requested = ids if isinstance(ids, DataFrame) else reads.id_positions(self.spark, ids)
        generation = self.tables.generation()
        known = self.collections(allowed, generation)
        found = reads.bulk_read_any(self.tables.embeddings(generation, known), requested, known, allowed)
        documents = reads.binary_documents(found, exclude_info).orderBy("input_index")
        return documents, search.collection_documents(search.hit_collections(found, known))

    def get(self, name: str, embedding_id: str, allowed: Allowed) -> DataFrame:
        """The row with this id of one collection."""
        generation = self.tables.generation()
        collection = self.collection(name, allowed, generation)
        found = reads.embedding_by_id(self.tables.embeddings(generation, [collection.id]), collection.id, embedding_id, allowed)
        if found.isEmpty():
            raise NotFound(f"embedding {embedding_id} not found")
        return found

    def page(self, name: str, allowed: Allowed, page: int = 1, page_size: int = DEFAULT_PAGE_SIZE) -> DataFrame:
        generation = self.tables.generation()
        collection = self.collection(name, allowed, generation)
        return reads.page_embeddings(self.tables.embeddings(generation, [collection.id]), collection.id, allowed, page, page_size)

    def page_collections(self, allowed: Allowed, page: int = 1, page_size: int = DEFAULT_PAGE_SIZE) -> DataFrame:
        return reads.page_collections(self.tables.collections(), allowed, page, page_size)

    def counts(self, allowed: Allowed) -> DataFrame:
        """Visible collections with the number of their rows the caller sees."""
        generation = self.tables.generation()
        known = self.collections(allowed, generation)
        return reads.collections_with_counts(known, self.tables.embeddings(generation, known), allowed)
