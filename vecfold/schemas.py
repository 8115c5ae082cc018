"""Table schemas and the fixed vocabulary of the vector-collection engine."""

from enum import StrEnum

from pyspark.sql import types as T

# Paths, limits and defaults that callers of the API rely on.
COLLECTIONS_PATH = "/vectorstore/collections"
COLLECTION_NAME_PATTERN = "^[a-z0-9_-]+$"
DEFAULT_TOP_K = 10
DEFAULT_PAGE_SIZE = 100
MAX_PAGE_SIZE = 1000
# Smallest magnitude that no longer rounds to the largest float16, 65504.
HALF_LIMIT = 65520.0


class VectorType(StrEnum):
    """Stored precision of a collection: ``vector`` is float32, ``halfvec`` float16."""

    vector = "vector"
    halfvec = "halfvec"


class Metric(StrEnum):
    """Search metrics. Only ``cosine_similarity`` ranks large values first."""

    l2_distance = "l2_distance"
    inner_product = "inner_product"
    cosine_distance = "cosine_distance"
    l1_distance = "l1_distance"
    cosine_similarity = "cosine_similarity"

    @property
    def ascending(self) -> bool:
        return self is not Metric.cosine_similarity


PRECISION = {"vector": "float32", "halfvec": "float16"}

COLLECTIONS = T.StructType(
    [
        T.StructField("id", T.LongType(), False),
        T.StructField("collection_name", T.StringType(), False),
        T.StructField("description", T.StringType()),
        T.StructField("ai_model_name", T.StringType()),
        T.StructField("dimensions", T.IntegerType(), False),
        T.StructField("vector_type", T.StringType(), False),
        T.StructField("created_at", T.TimestampType()),
        T.StructField("updated_at", T.TimestampType()),
    ]
)

# Both precisions share one table; vector_type and collection_id are partition columns.
EMBEDDINGS = T.StructType(
    [
        T.StructField("collection_id", T.LongType(), False),
        T.StructField("vector_type", T.StringType(), False),
        T.StructField("embedding_id", T.StringType(), False),
        T.StructField("embedding", T.ArrayType(T.FloatType(), False), False),
        T.StructField("embedding_hash", T.StringType(), False),
        T.StructField("authz", T.StringType(), False),
        T.StructField("metadata", T.StringType(), False),
        T.StructField("metadata_hash", T.StringType(), False),
        T.StructField("created_at", T.TimestampType()),
        T.StructField("updated_at", T.TimestampType()),
    ]
)

# Content key of a stored row: unique within the table.
CONTENT_KEY = ["collection_id", "embedding_hash", "metadata_hash", "authz"]

# One array document of rows to ingest, as sent by a client.
JSON_BATCH_ROW = T.StructType(
    [
        T.StructField("collection_id", T.LongType()),
        T.StructField("embedding", T.ArrayType(T.DoubleType())),
        T.StructField("authz", T.StringType()),
        T.StructField("metadata", T.StringType()),
        T.StructField("embedding_id", T.StringType()),
    ]
)
