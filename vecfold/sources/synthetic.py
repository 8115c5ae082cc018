"""Generated vectors for load tests."""

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


def counting_vector(i: Column, dimensions: int) -> Column:
    """``[i, i + 1, ..]`` of the given length."""
    return F.transform(F.sequence(F.lit(0), F.lit(dimensions - 1)), lambda n: (i + n).cast("double"))


def synthetic_rows(ids: DataFrame, collection: str, dimensions: int, id_column: str = "id") -> DataFrame:
    """A vector and metadata ``{"i": .., "name": "<collection>_<i>"}`` for every id."""
    i = F.col(id_column)
    metadata = F.to_json(F.struct(i.alias("i"), F.concat(F.lit(collection + "_"), i).alias("name")))
    return ids.select(i.alias("i"), counting_vector(i, dimensions).alias("embedding"), metadata.alias("metadata"))


def synthetic_vectors(spark: SparkSession, rows: int, collection: str, dimensions: int) -> DataFrame:
    """``rows`` generated vectors, made in parallel from a range."""
    return synthetic_rows(spark.range(1, rows + 1), collection, dimensions)
