"""Batches of rows to ingest as JSON."""

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from vecfold.operators.ingest import parse_json_batch
from vecfold.schemas import JSON_BATCH_ROW


def read_json_lines(spark: SparkSession, path: str) -> DataFrame:
    """One JSON object per line; the schema is given, never inferred, and metadata kept as written."""
    return parse_json_batch(spark.read.text(path).withColumnRenamed("value", "document")).select(*JSON_BATCH_ROW.names)


def read_json_documents(spark: SparkSession, path: str) -> DataFrame:
    """Files that each hold one JSON array, as rows with ``path`` and ``pos`` in the array."""
    files = spark.read.text(path, wholetext=True)
    return parse_json_batch(files.select(F.col("_metadata.file_path").alias("path"), F.col("value").alias("document")))
