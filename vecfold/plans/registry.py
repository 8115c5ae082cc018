"""Every operator as a query over the given tables: name -> (spark, sf_dir) -> DataFrame.

The results hold what can be compared by value: rounded metric values, ids, texts and counts.
"""

from collections.abc import Callable

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from vecfold.functions.content import canonical_json, hash_uuid, metadata_value
from vecfold.functions.names import authz_is_valid, normalize_authz, normalize_name, strip
from vecfold.functions.vectors import half_round
from vecfold.operators import access, catalog, cells, changes, codes, deltas, ingest, knn, models, pruned, reads, requests, responses, search
from vecfold.schemas import EMBEDDINGS, Metric
from vecfold.session import materialize, scratch_path
from vecfold.sources import fixtures, manifest, synthetic
from vecfold.sources.tables import bucket_of
from vecfold.plans.store import VectorStore
from vecfold.streaming import counter, put
from vecfold.streaming import deltas as delta_stream
from vecfold.streaming.replies import ReplyLog
from vecfold.streaming.files import read_table_stream, run_available, to_table

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}

BATCH = "batch-1"
NOW_TEXT = "2024-02-02 00:00:00"


def query(function: Query) -> Query:
    QUERIES[function.__name__] = function
    return function


def _now() -> Column:
    return F.lit(NOW_TEXT).cast("timestamp")


def _rounded(hits: DataFrame) -> DataFrame:
    return hits.withColumn("value", F.round("value", 6))


def _collection(spark: SparkSession, sf_dir: str, name: str):
    return fixtures.collections(spark, sf_dir).where(F.col("collection_name") == name).first()


def _search(spark: SparkSession, sf_dir: str, metric: Metric, name: str = "c0", **options) -> DataFrame:
    hits = search.search_collection(
        fixtures.embeddings(spark, sf_dir),
        _collection(spark, sf_dir, name),
        fixtures.query_vector(spark, sf_dir),
        allowed=fixtures.CALLER,
        metric=metric,
        **options,
    )
    return _rounded(hits)


# Sources and sinks


@query
def collections_scan(spark, sf_dir):
    return fixtures.collections(spark, sf_dir).drop("created_at", "updated_at")


def _scan(spark, sf_dir, vector_type):
    rows = fixtures.embeddings(spark, sf_dir).where(F.col("vector_type") == vector_type)
    total = F.aggregate("embedding", F.lit(0.0), lambda t, v: t + v.cast("double"))
    return rows.select("collection_id", "embedding_id", "authz", "metadata", F.round(total, 6).alias("vector_sum"))


@query
def embeddings_scan(spark, sf_dir):
    return _scan(spark, sf_dir, "vector")


@query
def embeddings_half_scan(spark, sf_dir):
    return _scan(spark, sf_dir, "halfvec")


@query
def ingest_json_rows(spark, sf_dir):
    parsed = ingest.parse_json_batch(fixtures.incoming_documents(spark, sf_dir))
    rows = ingest.prepare_batch(parsed.drop("pos", "embedding_id").withColumnRenamed("vec_id", "pos"),
                                fixtures.collections(spark, sf_dir))
    total = F.aggregate("embedding", F.lit(0.0), lambda t, v: t + v)
    return rows.select("pos", "collection_id", "authz", "metadata", "metadata_hash", F.round(total, 6).alias("vector_sum"))


@query
def synth_vectors(spark, sf_dir):
    rows = synthetic.synthetic_rows(fixtures.table(spark, sf_dir, "part"), "d200vector", 200, "p_partkey")
    total = F.aggregate("embedding", F.lit(0.0), lambda t, v: t + v)
    return rows.select("i", F.size("embedding").alias("dimensions"), total.alias("vector_sum"), "metadata")


@query
def vectors_binary(spark, sf_dir):
    rows = reads.binary_vectors(fixtures.embeddings(spark, sf_dir))
    return rows.select("embedding_id", "precision", "vector_base64")


@query
def embedding_documents(spark, sf_dir):
    rows = fixtures.embeddings(spark, sf_dir)
    known = fixtures.collections(spark, sf_dir).select(F.col("id").alias("collection_id"), "collection_name")
    documents = reads.embedding_documents(rows.join(known, "collection_id"))
    return documents.select(
        "embedding_id",
        F.size("document.vector").alias("dimensions"),
        search.info_json(F.col("document.info")).alias("info"),
    )


@query
def content_manifest(spark, sf_dir):
    return manifest.content_manifest(fixtures.table(spark, sf_dir, "pages"), "url", F.col("html"))


@query
def file_manifest(spark, sf_dir):
    """The pages written to files in folders of folders, and the manifest of these files."""
    root, page = scratch_path(spark, "pages"), F.col("page_id")
    pages = fixtures.table(spark, sf_dir, "pages").select((page % 5).alias("a"), (page % 20).alias("b"), "page_id", F.coalesce("html", F.lit("")).alias("html"))
    lines = pages.repartition("a", "b").sortWithinPartitions("a", "b", "page_id").select("a", "b", "html")
    lines.write.partitionBy("a", "b").option("lineSep", "\n").text(root)
    files = manifest.file_manifest(spark, root).where(~F.col("path").contains("/_") & ~F.col("path").contains("/."))
    return files.select(F.regexp_extract("path", "/(a=[0-9]+/b=[0-9]+)/", 1).alias("folder"), "size", "commit_id", "etag")


# Filters, policy and catalog visibility


@query
def embedding_by_id(spark, sf_dir):
    rows = fixtures.embeddings(spark, sf_dir)
    wanted = rows.where(metadata_value(F.col("metadata"), "i") == "1").first()
    return reads.embedding_by_id(rows, wanted.collection_id, wanted.embedding_id, fixtures.CALLER).select(
        "collection_id", "embedding_id", "authz", "metadata"
    )


@query
def embeddings_by_ids(spark, sf_dir):
    found = reads.embeddings_by_ids(
        fixtures.embeddings(spark, sf_dir), fixtures.id_requests(spark, sf_dir), fixtures.CALLER
    )
    return found.select("embedding_id", "collection_id", "vector_type", "authz")


@query
def visible_embeddings(spark, sf_dir):
    return access.visible(fixtures.embeddings(spark, sf_dir), fixtures.CALLER).select("embedding_id", "authz")


@query
def write_check_violations(spark, sf_dir):
    batch = ingest.prepare_batch(fixtures.incoming_batch(spark, sf_dir), fixtures.collections(spark, sf_dir))
    return access.write_violations(batch, fixtures.CALLER).select("pos", "authz")


def _read_resources(spark, sf_dir):
    return access.allowed_resources(fixtures.grants(spark, sf_dir), "read", fixtures.SERVICE, ["user_id"])


@query
def allowed_authz(spark, sf_dir):
    return _read_resources(spark, sf_dir)


@query
def allowed_collections(spark, sf_dir):
    return access.allowed_collections(_read_resources(spark, sf_dir), ["user_id"])


@query
def visible_collections(spark, sf_dir):
    seen = access.visible_collections_by_principal(
        fixtures.collections(spark, sf_dir), _read_resources(spark, sf_dir), ["user_id"]
    )
    return seen.select("user_id", "id", "collection_name")


@query
def eligible_collections(spark, sf_dir):
    return search.eligible_collections(fixtures.collections(spark, sf_dir), "vector", 64).select("id", "collection_name")


@query
def eligible_by_model(spark, sf_dir):
    known = fixtures.collections(spark, sf_dir)
    resolved = search.resolve_names(fixtures.name_requests(spark, sf_dir), known)
    joined = resolved.join(known.select(F.col("id").alias("collection_id"), "ai_model_name"), "collection_id")
    return search.model_conflicts(joined, ["request_id"]).select("request_id", "first_model", "last_model")


@query
def dimension_violations(spark, sf_dir):
    declared = F.when(F.col("id") % 4 == 0, F.lit(128)).otherwise(F.col("dimensions"))
    known = fixtures.collections(spark, sf_dir).withColumn("dimensions", declared)
    bad = ingest.dimension_violations(fixtures.incoming_batch(spark, sf_dir), known)
    return bad.select("pos", "collection_id", F.size("embedding").alias("given"), "dimensions")


@query
def trusted_models(spark, sf_dir):
    return models.trusted_models(fixtures.model_urls(spark, sf_dir), fixtures.trusted_hosts(spark, sf_dir))


# Search


@query
def search_cosine(spark, sf_dir):
    return _search(spark, sf_dir, Metric.cosine_similarity)


@query
def search_cosine_distance(spark, sf_dir):
    return _search(spark, sf_dir, Metric.cosine_distance)


@query
def search_l2(spark, sf_dir):
    return _search(spark, sf_dir, Metric.l2_distance)


@query
def search_l1(spark, sf_dir):
    return _search(spark, sf_dir, Metric.l1_distance)


@query
def search_inner(spark, sf_dir):
    return _search(spark, sf_dir, Metric.inner_product)


@query
def search_half(spark, sf_dir):
    return _search(spark, sf_dir, Metric.l2_distance, "c2", top_k=20)


@query
def search_range(spark, sf_dir):
    return _search(spark, sf_dir, Metric.inner_product, top_k=1000, min_value=-0.2, max_value=0.1)


@query
def search_filtered(spark, sf_dir):
    return _search(spark, sf_dir, Metric.cosine_similarity, filters={"source": "src3"})


def _across(spark, sf_dir, **options):
    known = access.visible_collections(fixtures.collections(spark, sf_dir), fixtures.CALLER)
    return search.search_across(
        fixtures.embeddings(spark, sf_dir),
        known,
        fixtures.query_vector(spark, sf_dir),
        allowed=fixtures.CALLER,
        **options,
    )


@query
def search_across(spark, sf_dir):
    return _rounded(_across(spark, sf_dir))


@query
def search_across_filtered(spark, sf_dir):
    return _rounded(_across(spark, sf_dir, vector_type="halfvec", metric="l2_distance", filters={"source": "src5"}))


@query
def search_hit_collections(spark, sf_dir):
    hits = _across(spark, sf_dir)
    found = search.hit_collections(hits, fixtures.collections(spark, sf_dir))
    return search.collection_documents(found).select("id", "collection_name", "self")


@query
def search_documents(spark, sf_dir):
    hits = _across(spark, sf_dir, columns=["authz", "metadata", "embedding"])
    documents = search.search_documents(hits, Metric.cosine_similarity)
    return _rounded(documents).select(
        "id",
        "distance_metric",
        "value",
        F.size("embedding.vector").alias("dimensions"),
        search.info_json(F.col("embedding.info")).alias("info"),
    )


@query
def knn_batch_cosine(spark, sf_dir):
    rows = fixtures.embeddings(spark, sf_dir).where("vector_type = 'vector'")
    return _rounded(knn.knn_batch(rows, fixtures.query_vectors(spark, sf_dir)))


@query
def knn_batch_threshold(spark, sf_dir):
    rows = fixtures.embeddings(spark, sf_dir).where("vector_type = 'halfvec'")
    queries = fixtures.query_vectors(spark, sf_dir).withColumn("embedding", half_round(F.col("embedding")))
    return _rounded(knn.knn_batch(rows, queries, top_k=4, min_value=0.5))


def _pruned(spark, sf_dir, metric):
    rows = fixtures.embeddings(spark, sf_dir).where("vector_type = 'vector'")
    return _rounded(pruned.knn_pruned(rows, fixtures.query_vectors(spark, sf_dir), metric=metric, cell_rows=100))


@query
def knn_pruned_cosine(spark, sf_dir):
    return _pruned(spark, sf_dir, Metric.cosine_similarity)


@query
def knn_pruned_l2(spark, sf_dir):
    return _pruned(spark, sf_dir, Metric.l2_distance)


@query
def knn_pruned_inner(spark, sf_dir):
    return _pruned(spark, sf_dir, Metric.inner_product)


_cells_built: dict[tuple[str, str], cells.Cells] = {}


def _cells(spark, sf_dir):
    """The cells of the float32 vectors, built once per application."""
    key = (spark.sparkContext.applicationId, sf_dir)
    if key not in _cells_built:
        rows = fixtures.embeddings(spark, sf_dir).where("vector_type = 'vector'")
        rows = rows.select("collection_id", "embedding_id", "embedding", "authz", "metadata")
        _cells_built[key] = cells.build_cells(rows, 16, scratch_path(spark, "cells"))
    return _cells_built[key]


@query
def search_ivf(spark, sf_dir):
    built = _cells(spark, sf_dir)
    return _rounded(
        cells.search_cells_exact(spark, built, fixtures.query_vector(spark, sf_dir), allowed=fixtures.CALLER)
    )


@query
def search_ivf_probes(spark, sf_dir):
    built = _cells(spark, sf_dir)
    return _rounded(
        cells.search_cells(spark, built, fixtures.query_vector(spark, sf_dir), allowed=fixtures.CALLER, probes=4)
    )


@query
def search_ivf_all_probes(spark, sf_dir):
    """With every cell probed the approximate search is exact."""
    built = _cells(spark, sf_dir)
    query_vector = fixtures.query_vector(spark, sf_dir)
    return _rounded(cells.search_cells(spark, built, query_vector, allowed=fixtures.CALLER, probes=len(built.centroids)))


_coded: dict[tuple[str, str], codes.Codes] = {}


def _codes(spark, sf_dir):
    """The single-precision rows with codes of 16 bytes for 64 numbers."""
    key = (spark.sparkContext.applicationId, sf_dir)
    if key not in _coded:
        rows = fixtures.embeddings(spark, sf_dir).where("vector_type = 'vector'")
        rows = rows.select("collection_id", "embedding_id", "embedding", "authz", "metadata")
        _coded[key] = codes.build_codes(rows, 16, scratch_path(spark, "codes"))
    return _coded[key]


@query
def search_codes(spark, sf_dir):
    """The 200 rows of least estimate, ranked exactly."""
    query_vector = fixtures.query_vector(spark, sf_dir)
    return _rounded(codes.search_codes(spark, _codes(spark, sf_dir), query_vector, allowed=fixtures.CALLER, rerank=200))


@query
def search_codes_exact(spark, sf_dir):
    query_vector = fixtures.query_vector(spark, sf_dir)
    return _rounded(codes.search_codes_exact(spark, _codes(spark, sf_dir), query_vector, allowed=fixtures.CALLER))


@query
def search_codes_all(spark, sf_dir):
    """With all rows re-ranked the approximate search is exact."""
    query_vector = fixtures.query_vector(spark, sf_dir)
    return _rounded(codes.search_codes(spark, _codes(spark, sf_dir), query_vector, allowed=fixtures.CALLER, rerank=None))


_indexed: dict[tuple[str, str], VectorStore] = {}


def _index(spark, sf_dir):
    """A store whose first collection is laid out by cells around eight given vectors, and was put to since."""
    key = (spark.sparkContext.applicationId, sf_dir)
    if key not in _indexed:
        store = VectorStore(spark, scratch_path(spark, "indexed"))
        known, rows = fixtures.collections(spark, sf_dir), fixtures.embeddings(spark, sf_dir).where("collection_id = 1")
        late = F.xxhash64("embedding_id") % 3 == 0
        store.tables.commit(known, rows.where(~late), [1])
        middles = fixtures.table(spark, sf_dir, "embeddings").where("vec_id < 8").orderBy("vec_id").select("embedding").collect()
        store.index_collection("c0", fixtures.CALLER, centroids=np.array([r.embedding for r in middles], np.float64))
        store.add(rows.where(late))
        _indexed[key] = store
    return _indexed[key]


@query
def search_index_probes(spark, sf_dir):
    """The two cells nearest to the query."""
    query_vector = fixtures.query_vector(spark, sf_dir)
    return _rounded(_index(spark, sf_dir).search_index("c0", query_vector, fixtures.CALLER, probes=2))


@query
def search_index_exact(spark, sf_dir):
    query_vector = fixtures.query_vector(spark, sf_dir)
    return _rounded(_index(spark, sf_dir).search_index("c0", query_vector, fixtures.CALLER, probes=None))


@query
def half_round_vectors(spark, sf_dir):
    rows = fixtures.table(spark, sf_dir, "embeddings").select("vec_id", "embedding", half_round(F.col("embedding")).alias("half"))
    pairs = F.zip_with("embedding", "half", lambda a, b: F.abs(a.cast("double") - b.cast("double")))
    total = F.aggregate("half", F.lit(0.0), lambda t, v: t + v.cast("double"))
    return rows.select(
        "vec_id",
        F.round(total, 9).alias("half_sum"),
        F.size(F.filter(pairs, lambda d: d > 0)).alias("changed"),
        F.round(F.array_max(pairs), 9).alias("largest_change"),
    )


# Reads, pages, counts


@query
def bulk_read_ordered(spark, sf_dir):
    found = reads.bulk_read_ordered(
        fixtures.embeddings(spark, sf_dir), fixtures.id_requests(spark, sf_dir), fixtures.CALLER, collection_id=1
    )
    return found.select("input_index", "embedding_id", "collection_id", "authz")


@query
def bulk_read_any(spark, sf_dir):
    found = reads.bulk_read_any(
        fixtures.embeddings(spark, sf_dir),
        fixtures.id_requests(spark, sf_dir),
        fixtures.collections(spark, sf_dir),
        fixtures.CALLER,
    )
    return found.select("input_index", "embedding_id", "collection_name", "precision")


@query
def resolve_names(spark, sf_dir):
    resolved = search.resolve_names(fixtures.name_requests(spark, sf_dir), fixtures.collections(spark, sf_dir))
    return resolved.withColumn("collection_id", F.col("collection_id").cast("string"))


@query
def rejected_requests(spark, sf_dir):
    resolved = search.resolve_names(fixtures.name_requests(spark, sf_dir), fixtures.collections(spark, sf_dir))
    return search.rejected_requests(resolved)


@query
def page_collections(spark, sf_dir):
    return reads.page_collections(fixtures.collections(spark, sf_dir), fixtures.CALLER, 2, 3).select(
        "id", "collection_name", "page", "next_page", "prev_page"
    )


@query
def page_embeddings(spark, sf_dir):
    return reads.page_embeddings(fixtures.embeddings(spark, sf_dir), 1, fixtures.CALLER, 2, 10).select(
        "embedding_id", "page", "next_page", "prev_page"
    )


@query
def count_visible(spark, sf_dir):
    return reads.count_visible(fixtures.embeddings(spark, sf_dir), 1, fixtures.CALLER)


@query
def collections_with_counts(spark, sf_dir):
    counted = reads.collections_with_counts(
        fixtures.collections(spark, sf_dir), fixtures.embeddings(spark, sf_dir), fixtures.CALLER
    )
    return counted.select("id", "collection_name", "available_embeddings_count")


@query
def requests_by_status(spark, sf_dir):
    return requests.requests_by_status(fixtures.request_log(spark, sf_dir))


@query
def request_counter(spark, sf_dir):
    return requests.count_requests(fixtures.request_log(spark, sf_dir))


@query
def page_embeddings_after(spark, sf_dir):
    """The page after a known id, here the id of the first vector."""
    last = fixtures.embeddings(spark, sf_dir).where(metadata_value(F.col("metadata"), "i") == "0").first()
    page = reads.embeddings_after(fixtures.embeddings(spark, sf_dir), 1, fixtures.CALLER, last.embedding_id, 10)
    return page.select("embedding_id", "authz")


@query
def stored_search(spark, sf_dir):
    """A search in the stored tables: only the collection's partition is read."""
    store = VectorStore(spark, fixtures.stored_root(spark, sf_dir))
    hits = store.search("c3", fixtures.query_vector(spark, sf_dir), fixtures.CALLER, columns=["authz", "metadata"])
    return _rounded(hits)


@query
def stored_search_all(spark, sf_dir):
    store = VectorStore(spark, fixtures.stored_root(spark, sf_dir))
    query_vector = fixtures.query_vector(spark, sf_dir)
    hits = store.search_all(query_vector, fixtures.CALLER, names="c5, C2", vector_type="halfvec", metric="l1_distance")
    return _rounded(hits)


_fielded: dict[tuple[str, str], VectorStore] = {}


def _with_fields(spark, sf_dir):
    """A store with frequent metadata fields as columns: all files of c0 have them, of other collections only the later ones."""
    key = (spark.sparkContext.applicationId, sf_dir)
    if key not in _fielded:
        store = VectorStore(spark, scratch_path(spark, "fields"))
        known, rows = fixtures.collections(spark, sf_dir), fixtures.embeddings(spark, sf_dir)
        late = F.xxhash64("embedding_id") % 3 == 0
        store.tables.commit(known, rows.where(~late), [row.id for row in known.select("id").collect()])
        store.store_fields(["c0"], fixtures.CALLER)
        store.add(rows.where(late))
        _fielded[key] = store
    return _fielded[key]


@query
def stored_search_filtered(spark, sf_dir):
    """A metadata filter that the reader gets as a filter on the field's column."""
    query_vector = fixtures.query_vector(spark, sf_dir)
    return _rounded(_with_fields(spark, sf_dir).search("c0", query_vector, fixtures.CALLER, filters={"source": "src3"}))


@query
def stored_search_all_filtered(spark, sf_dir):
    """The same across collections, whose older files have no such column."""
    query_vector = fixtures.query_vector(spark, sf_dir)
    options = {"vector_type": "halfvec", "metric": "l2_distance", "filters": {"source": "src5"}}
    return _rounded(_with_fields(spark, sf_dir).search_all(query_vector, fixtures.CALLER, **options))


@query
def stored_bulk_read(spark, sf_dir):
    """Requested rows of one stored collection in order, with their vectors as bytes."""
    store = VectorStore(spark, fixtures.stored_root(spark, sf_dir))
    found = store.read_ordered("c5", fixtures.id_requests(spark, sf_dir), fixtures.CALLER)
    return found.select("input_index", "embedding_id", "precision", F.length("vector_base64").alias("encoded_length"))


@query
def stored_read_any(spark, sf_dir):
    """Nested binary documents of requested ids in all stored collections."""
    store = VectorStore(spark, fixtures.stored_root(spark, sf_dir))
    documents, _ = store.read_any(fixtures.id_requests(spark, sf_dir), fixtures.CALLER)
    document = F.col("document")
    return documents.select(
        "input_index", "embedding_id", document["precision"].alias("precision"), F.length(document["vector_base64"]).alias("encoded_length"),
        document["info"]["authz"].alias("authz"),
    )


@query
def stored_read_collections(spark, sf_dir):
    """The stored collections that hold any of the requested ids."""
    store = VectorStore(spark, fixtures.stored_root(spark, sf_dir))
    _, found = store.read_any(fixtures.id_requests(spark, sf_dir), fixtures.CALLER, exclude_info=True)
    return found.select("id", "collection_name")


@query
def stored_page(spark, sf_dir):
    store = VectorStore(spark, fixtures.stored_root(spark, sf_dir))
    name = store.collections(fixtures.CALLER).where("id = 1").first().collection_name
    return store.page(name, fixtures.CALLER, 2, 10).select("embedding_id", "page", "next_page", "prev_page")


@query
def stored_counts(spark, sf_dir):
    store = VectorStore(spark, fixtures.stored_root(spark, sf_dir))
    return store.counts(fixtures.CALLER).select("id", "collection_name", "available_embeddings_count")


# Table changes


def _prepared(spark, sf_dir):
    """The prepared batch as a put stores it before it goes on."""
    batch = fixtures.incoming_batch(spark, sf_dir)
    return materialize(ingest.prepare_batch(batch, fixtures.collections(spark, sf_dir)), "prepared")


def _prepared_keys(spark, sf_dir):
    """Positions and content keys only, for results that need no vectors."""
    batch = fixtures.incoming_batch(spark, sf_dir)
    prepared = ingest.prepare_batch(batch, fixtures.collections(spark, sf_dir))
    return materialize(prepared.select("pos", *ingest.CONTENT_KEY), "keys")


@query
def create_collections(spark, sf_dir):
    documents = fixtures.table(spark, sf_dir, "documents")
    wanted = documents.select(
        F.col("doc_id").alias("pos"),
        F.concat(F.lit(" "), F.upper("source"), F.when(F.col("lang") == "de", F.lit(" ")).otherwise(F.lit("_")), "lang")
        .alias("requested_name"),
    )
    allowed = documents.select(
        F.concat(F.lit("/vectorstore/collections/"), "source", F.lit("_en")).alias("authz")
    ).distinct()
    known = fixtures.collections(spark, sf_dir).withColumn(
        "collection_name", F.concat(F.lit("src"), F.col("id").cast("string"), F.lit("_en"))
    )
    return catalog.classify_new_collections(wanted, known, allowed).select("pos", "collection_name", "outcome")


@query
def update_collections(spark, sf_dir):
    known = fixtures.collections(spark, sf_dir)
    text = F.when(F.col("id") % 2 == 0, F.concat(F.lit("new "), "description"))
    changes = known.select(F.col("id").alias("pos"), "collection_name", text.alias("description"))
    updated = catalog.update_collections(known, changes, fixtures.CALLER, _now())
    return updated.select("id", "collection_name", "description", F.date_format("updated_at", "yyyy-MM-dd").alias("updated"))


@query
def delete_collection(spark, sf_dir):
    names = fixtures.collections(spark, sf_dir).where("collection_name in ('c2', 'c9')")
    _, left, _ = catalog.delete_collections(
        fixtures.collections(spark, sf_dir), fixtures.embeddings(spark, sf_dir), names, fixtures.CALLER
    )
    return left.groupBy("collection_id").agg(F.count(F.lit(1)).alias("rows_left"))


@query
def batch_dedup(spark, sf_dir):
    return ingest.dedup_batch(_prepared(spark, sf_dir)).select(
        "first_pos", "copies", "collection_id", "authz", "metadata"
    )


@query
def batch_fanout(spark, sf_dir):
    prepared = _prepared_keys(spark, sf_dir)
    return ingest.fan_out(prepared, ingest.unique_keys(prepared), ["first_pos", "copies"]).select(
        "pos", "first_pos", "copies"
    )


@query
def insert_conflicts(spark, sf_dir):
    unique = ingest.unique_keys(_prepared_keys(spark, sf_dir))
    return ingest.insert_conflicts(unique, fixtures.embeddings(spark, sf_dir)).select("first_pos", "collection_id")


@query
def insert_result(spark, sf_dir):
    revised = F.to_json(F.struct(F.lit(2).alias("rev"), metadata_value(F.col("metadata"), "i").alias("i")))
    batch = fixtures.incoming_batch(spark, sf_dir).withColumn("metadata", revised)
    prepared = materialize(ingest.prepare_batch(batch, fixtures.collections(spark, sf_dir)), "prepared")
    added = ingest.insert(fixtures.embeddings(spark, sf_dir), prepared, BATCH, _now())
    placed = ingest.insert_result(prepared, BATCH).join(
        added.select("embedding_id", F.col("metadata").alias("stored_metadata")), "embedding_id"
    )
    # Every inserted row has an id of its own, and it is the id of all its positions.
    rows_of_id = F.count(F.lit(1)).over(Window.partitionBy("embedding_id"))
    return placed.select("pos", "collection_id", "authz", "stored_metadata", F.length("embedding_id").alias("id_length"), rows_of_id.alias("positions"))


@query
def upsert_result(spark, sf_dir):
    prepared = _prepared_keys(spark, sf_dir)
    result = ingest.upsert_result(prepared, fixtures.embeddings(spark, sf_dir), BATCH)
    return result.select("pos", "first_pos", "stored_id", "action")


def _state_rows(state):
    total = F.aggregate("embedding", F.lit(0.0), lambda t, v: t + v.cast("double"))
    return state.select(
        "collection_id",
        "authz",
        "metadata",
        F.round(total, 6).alias("vector_sum"),
        F.date_format("created_at", "yyyy-MM-dd").alias("created"),
        F.date_format("updated_at", "yyyy-MM-dd").alias("updated"),
    )


@query
def upsert_state(spark, sf_dir):
    unique = ingest.dedup_batch(_prepared(spark, sf_dir))
    return _state_rows(ingest.upsert_state(fixtures.embeddings(spark, sf_dir), unique, BATCH, _now()))


@query
def update_by_id(spark, sf_dir):
    """Two updates for every row, each of some fields."""
    rows = fixtures.table(spark, sf_dir, "embeddings").select("*", F.explode(F.array(F.lit(0), F.lit(1))).alias("copy"))
    vec_id, copy = F.col("vec_id"), F.col("copy")
    updates = rows.select(
        (vec_id * 2 + copy).alias("pos"),
        (F.col("label") + 1).cast("long").alias("collection_id"),
        fixtures.vector_id(vec_id).alias("embedding_id"),
        F.when((vec_id % 3 == 0) & (copy == 0), F.reverse(F.col("embedding").cast("array<double>"))).alias("embedding"),
        F.when(vec_id % 4 < 2, F.to_json(F.struct(vec_id.alias("i"), copy.alias("copy")))).alias("metadata"),
        F.when((vec_id % 7 == 0) & (copy == 1), F.lit("/programs/p0")).alias("authz"),
    )
    updated = ingest.update_by_id(fixtures.embeddings(spark, sf_dir), updates, fixtures.CALLER, _now())
    places = F.sequence(F.lit(1), F.size("embedding"))
    weighted = F.zip_with("embedding", places, lambda v, n: v.cast("double") * n)
    total = F.aggregate(weighted, F.lit(0.0), lambda t, v: t + v)
    return updated.select(
        "embedding_id", "authz", "metadata", "changed", F.round(total, 6).alias("vector_checksum")
    )


def _mixed_batch(spark, sf_dir):
    """The incoming batch, every third item naming the id it updates."""
    named = F.col("pos") % 6 == 1
    vec_id = F.floor(F.col("pos") / 2)
    batch = fixtures.incoming_batch(spark, sf_dir).select(
        "pos",
        "collection_id",
        "embedding",
        "authz",
        F.when(named, F.to_json(F.struct(F.lit(3).alias("rev"), vec_id.alias("i")))).otherwise(F.col("metadata")).alias("metadata"),
        F.when(named, fixtures.vector_id(vec_id)).alias("embedding_id"),
    )
    return materialize(ingest.prepare_batch(batch, fixtures.collections(spark, sf_dir)), "prepared")


@query
def put_mixed(spark, sf_dir):
    prepared = _mixed_batch(spark, sf_dir)
    _, result = ingest.put_mixed(
        fixtures.embeddings(spark, sf_dir), prepared, fixtures.OWNER, BATCH, _now()
    )
    known = F.when(F.col("action") != "inserted", F.col("embedding_id"))
    return result.select("input_index", "action", known.alias("known_id"))


@query
def put_mixed_state(spark, sf_dir):
    """All rows after the mixed put, made from keys and the change table."""
    state, known = fixtures.embeddings(spark, sf_dir), fixtures.collections(spark, sf_dir)
    state = state.withColumn("bucket", bucket_of(F.lit(8)))
    change = changes.put(state.select(*changes.KEYS), _mixed_batch(spark, sf_dir), known, fixtures.OWNER, BATCH, _now())
    after = changes.rewritten(state, change.changes, _now())
    return _state_rows(after.select(*EMBEDDINGS.names).unionByName(change.added))


@query
def delete_by_ids(spark, sf_dir):
    state = fixtures.embeddings(spark, sf_dir)
    targets = fixtures.id_requests(spark, sf_dir).join(state.select("embedding_id", "collection_id"), "embedding_id")
    left, _ = ingest.delete_by_ids(state, targets, fixtures.CALLER)
    return left.select("embedding_id", "collection_id")


# Scalar functions


@query
def hash_uuid_texts(spark, sf_dir):
    return fixtures.table(spark, sf_dir, "documents").select("doc_id", hash_uuid(F.col("text")).alias("text_hash"))


@query
def metadata_values(spark, sf_dir):
    events = fixtures.table(spark, sf_dir, "events")
    return events.select(
        "event_id",
        metadata_value(F.col("props"), "k").alias("k"),
        metadata_value(F.col("props"), "missing").alias("missing"),
        canonical_json(F.col("props")).alias("canonical"),
    )


def _number_texts(spark, sf_dir):
    """Metadata with decimals, exponents and long integers, one for each event."""
    key = F.col("event_id").cast("string")
    text = F.concat(
        F.lit('{ "z" : '), key, F.lit('.50, "a": [1e-400, -0.0, {"y": 1E'), key, F.lit(', "b": null}], "n": 12345678901234567890123456789012345'), key, F.lit("}")
    )
    return fixtures.table(spark, sf_dir, "events").select("event_id", text.alias("metadata"))


@query
def metadata_numbers(spark, sf_dir):
    """Metadata keeps decimals, exponents and long integers as they were written."""
    return _number_texts(spark, sf_dir).select("event_id", canonical_json(F.col("metadata")).alias("canonical"))


@query
def json_batch_numbers(spark, sf_dir):
    """So it does in JSON documents of rows, between fields of any order."""
    row = F.concat(F.lit('{"authz": "a \\"metadata\\": 1.10,", "metadata": '), F.col("metadata"), F.lit(', "embedding": [1.50, 2e0], "collection_id": 1}'))
    document = F.concat(F.lit("[ "), row, F.lit(', {"embedding": [0]},'), row, F.lit("]"))
    parsed = ingest.parse_json_batch(_number_texts(spark, sf_dir).select("event_id", document.alias("document")))
    return parsed.select("event_id", "pos", "collection_id", "authz", F.element_at("embedding", 1).alias("first"), "metadata")


@query
def document_numbers(spark, sf_dir):
    """And in the documents that answer a request."""
    rows = _number_texts(spark, sf_dir).select(
        F.col("event_id").cast("string").alias("embedding_id"), F.lit(1).cast("long").alias("collection_id"), F.lit("c").alias("collection_name"),
        F.lit('/p "x"').alias("authz"), canonical_json(F.col("metadata")).alias("metadata"), F.array(F.lit(1.5)).alias("embedding"),
    )
    return reads.document_json(reads.embedding_documents(rows))


@query
def batch_problems(spark, sf_dir):
    """What is wrong with rows that no collection can store."""
    kind, rest = F.col("pos") % 4, F.slice("embedding", F.lit(2), F.size("embedding") - 1)
    batch = fixtures.incoming_batch(spark, sf_dir)
    batch = batch.withColumns({
        "embedding": F.when(kind == 0, F.concat(F.array(F.lit(float("nan"))), rest)).when(kind == 1, F.concat(F.array(F.lit(1e300)), rest)).otherwise(F.col("embedding")),
        "metadata": F.when(kind == 2, F.lit("[1, 2]")).otherwise(F.col("metadata")),
    })
    return ingest.prepare_batch(batch, fixtures.collections(spark, sf_dir)).select("pos", "problem")


@query
def normalize_names(spark, sf_dir):
    documents = fixtures.table(spark, sf_dir, "documents").select(
        F.concat(F.lit("d"), F.col("doc_id").cast("string")).alias("key"),
        F.concat(F.lit(" \t"), F.upper("source"), F.lit("-"), "lang", F.lit(" ")).alias("name"),
    )
    pages = fixtures.table(spark, sf_dir, "pages").select(
        F.concat(F.lit("p"), F.col("page_id").cast("string")).alias("key"), F.col("url").alias("name")
    )
    return documents.unionByName(pages).select("key", normalize_name(F.col("name")).alias("collection_name"))


@query
def normalize_authz_paths(spark, sf_dir):
    kind = F.col("event_type")
    path = (
        F.when(kind == "view", F.lit("   "))
        .when(kind == "click", F.concat(F.lit(" /programs/"), F.col("user_id").cast("string"), F.lit("\n")))
        .when(kind == "error", F.concat(F.lit("programs/"), F.col("user_id").cast("string")))
    )
    events = fixtures.table(spark, sf_dir, "events").select("event_id", path.alias("given"))
    return events.select(
        "event_id", normalize_authz(F.col("given")).alias("authz"), authz_is_valid(F.col("given")).alias("valid")
    )


@query
def self_links(spark, sf_dir):
    known = fixtures.collections(spark, sf_dir).select(F.col("id").alias("collection_id"), "collection_name")
    odd = F.when(F.col("collection_id") % 2 == 1, F.col("collection_name"))
    rows = fixtures.embeddings(spark, sf_dir).join(known, "collection_id").withColumn("collection_name", odd)
    return reads.self_links(rows).select("embedding_id", "self")


# Response-log jobs


def _joined(messages: str) -> Column:
    return F.array_join(F.transform(messages, lambda m: F.concat(m["role"], F.lit(": "), m["content"])), "\n")


@query
def chat_requests(spark, sf_dir):
    built = responses.chat_requests(fixtures.request_bodies(spark, sf_dir))
    return built.select(
        "request_id", "model", "temperature", "top_p", "max_tokens",
        F.size("messages").alias("message_count"), _joined("messages").alias("messages"),
    )


@query
def assemble_conversations(spark, sf_dir):
    built = responses.assemble_conversations(fixtures.conversations(spark, sf_dir))
    return built.select("conv_id", F.size("messages").alias("message_count"), _joined("messages").alias("messages"))


@query
def normalize_completions(spark, sf_dir):
    built = responses.normalize_completions(fixtures.completions(spark, sf_dir))
    items = built.select("*", F.explode("output").alias("item"))
    return items.select(
        "id", "created_at", "status", "service_tier", "top_p",
        F.col("item.id").alias("item_id"),
        F.get("item.content", F.lit(0))["text"].alias("text"),
        F.array_join(F.transform("tools", lambda t: t["name"]), ",").alias("tools"),
        F.col("usage.input_tokens").cast("double").alias("input_tokens"),
        F.col("usage.output_tokens").cast("double").alias("output_tokens"),
        F.col("usage.cached_tokens").cast("double").alias("cached_tokens"),
        F.col("usage.reasoning_tokens").cast("double").alias("reasoning_tokens"),
    )


@query
def normalize_outputs(spark, sf_dir):
    built = responses.normalize_outputs(fixtures.responses(spark, sf_dir))
    items = built.select("id", F.posexplode("output").alias("pos", "item"))
    return items.select(
        "id", "pos",
        F.col("item.type").alias("type"),
        F.col("item.id").alias("item_id"),
        F.col("item.call_id").alias("call_id"),
        F.col("item.status").alias("status"),
        F.col("item.name").alias("name"),
        F.col("item.arguments").alias("arguments"),
        F.array_join(F.transform("item.content", lambda p: p["text"]), "|").alias("texts"),
        F.array_join("item.summary", "|").alias("summary"),
        F.array_join(F.transform("item.output", lambda p: p["detail"]), "|").alias("details"),
    )


@query
def responses_to_chat(spark, sf_dir):
    normalized = responses.normalize_outputs(fixtures.responses(spark, sf_dir))
    choice = F.get("choices", F.lit(0))
    built = responses.responses_to_chat(normalized).withColumn("choice", choice)
    return built.select(
        "id", "created",
        F.col("choice.finish_reason").alias("finish_reason"),
        F.col("choice.message.content").alias("content"),
        F.col("choice.message.function_call.name").alias("function_name"),
        F.col("choice.message.function_call.arguments").alias("function_arguments"),
        F.get("choice.message.tool_calls", F.lit(0))["id"].alias("tool_call_id"),
        F.col("usage.prompt_tokens").cast("double").alias("prompt_tokens"),
        F.col("usage.total_tokens").cast("double").alias("total_tokens"),
    )


@query
def tool_calls(spark, sf_dir):
    return responses.completion_tool_calls(fixtures.completions(spark, sf_dir))


@query
def request_tools(spark, sf_dir):
    """The function tools of each request and its tool choice, in chat form."""
    requested = fixtures.request_tools(spark, sf_dir)
    built = requested.select(
        "id",
        responses.function_tools(F.col("tools")).alias("tools"),
        responses.chat_tool_choice(F.col("tool_choice")).alias("choice"),
        responses.allowed_function_tools(F.col("tool_choice")).alias("allowed"),
    )
    return built.select(
        "id",
        F.array_join(F.transform("tools", lambda t: t["function"]["name"]), ",").alias("names"),
        F.get("tools", F.lit(0))["function"]["parameters"].alias("parameters"),
        F.get("tools", F.lit(0))["function"]["strict"].alias("strict"),
        F.col("choice.mode").alias("mode"),
        F.col("choice.function_name").alias("chosen"),
        F.array_join("allowed", ",").alias("allowed"),
    )


@query
def response_metadata(spark, sf_dir):
    rows = fixtures.response_metadata(spark, sf_dir)
    merged = responses.merged_metadata(F.col("own"), F.col("extra"))
    return rows.select("id", merged.alias("m")).select(
        "id",
        F.size("m").alias("entries"),
        *[F.element_at("m", F.lit(key)).alias(f"{key}_entry") for key in ("role", "from", "turn")],
    )


@query
def stream_usage(spark, sf_dir):
    return deltas.stream_usage(fixtures.usage_chunks(spark, sf_dir)).select("response_id", "usage.*")


@query
def normalize_settings(spark, sf_dir):
    return responses.normalize_settings(fixtures.settings(spark, sf_dir))


@query
def assemble_deltas(spark, sf_dir):
    return deltas.assemble_deltas(fixtures.reply_chunks(spark, sf_dir))


@query
def stream_events(spark, sf_dir):
    return deltas.stream_events(fixtures.reply_chunks(spark, sf_dir))


@query
def number_chunks(spark, sf_dir):
    """Chunks whose numbers have gaps, numbered anew."""
    gapped = fixtures.reply_chunks(spark, sf_dir).withColumn("seq", F.col("seq") * 3 + F.col("seq") % 2)
    return deltas.number_chunks(gapped)


@query
def resolve_models(spark, sf_dir):
    resolved = models.resolve_models(fixtures.requested_models(spark, sf_dir), fixtures.model_hosts(spark, sf_dir))
    return resolved.select("model", "host", models.protocol(F.col("protocols")).alias("protocol"))


# Streams


def _as_stream(spark, sf_dir, name):
    return read_table_stream(spark, sf_dir, f"{name}.parquet", fixtures.SCHEMAS[name])


@query
def stream_put(spark, sf_dir):
    """The stored vectors put once as a stream, then the incoming batch on top."""
    store = VectorStore(spark, scratch_path(spark, "store"))
    store.tables.commit(fixtures.collections(spark, sf_dir))
    raw = _as_stream(spark, sf_dir, "embeddings")
    writer = put.put_stream(store, fixtures.batch_of(raw), fixtures.OWNER, "feed")
    run_available(writer, scratch_path(spark, "feed-progress"))
    total = F.aggregate("embedding", F.lit(0.0), lambda t, v: t + v.cast("double"))
    return store.tables.embeddings().select("collection_id", "authz", "metadata", F.round(total, 6).alias("vector_sum"))


@query
def stream_deltas(spark, sf_dir):
    turns = _as_stream(spark, sf_dir, "conversations")
    path = scratch_path(spark, "chunks")
    run_available(delta_stream.append_stream(fixtures.chunks_of(turns), path), scratch_path(spark, "chunks-progress"))
    return delta_stream.assemble_closed(spark.read.parquet(path)).select("response_id", "text")


@query
def stream_replies(spark, sf_dir):
    """Replies closed in two rounds; the first chunk of odd turns comes with the second."""
    chunks = fixtures.chunks_of(fixtures.conversations(spark, sf_dir))
    late = F.split("response_id", "-")[2].cast("long") % 2 * F.when(F.col("seq") == 0, 1).otherwise(0)
    folder, progress = scratch_path(spark, "arriving"), scratch_path(spark, "replies-progress")
    log = ReplyLog(spark, scratch_path(spark, "replies"))
    for part in (0, 1):
        chunks.where(late == part).write.parquet(f"{folder}/part={part}")
        arriving = spark.readStream.schema(chunks.schema).parquet(f"{folder}/part=*")
        run_available(log.append(arriving), progress)
        log.close()
    return log.closed().select("response_id", "round", "text")


@query
def stream_requests_by_minute(spark, sf_dir):
    log = fixtures.request_log_of(_as_stream(spark, sf_dir, "events"))
    path = scratch_path(spark, "minutes")
    run_available(counter.minute_counts_stream(log, path), scratch_path(spark, "minutes-progress"))
    minutes = counter.requests_by_minute(spark.read.parquet(path))
    return minutes.withColumn("minute_start", F.col("minute_start").cast("timestamp_ntz"))
