"""Parquet files as a stream, and running a stream over what is there."""

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.streaming import DataStreamWriter

from vecfold.session import scratch_path


def read_table_stream(spark: SparkSession, folder: str, name: str, schema: str) -> DataFrame:
    """New files of the table ``name`` in ``folder``: the file of that name, or all files of the folder of that name."""
    # A stream takes one file only by a pattern; this one matches the name alone.
    return spark.readStream.schema(schema).parquet(f"{folder}/{name[:-1]}[{name[-1]}]")


def run_available(writer: DataStreamWriter, checkpoint: str) -> None:
    """Process all input there is, in as many batches as needed, and stop."""
    writer.option("checkpointLocation", checkpoint).trigger(availableNow=True).start().awaitTermination()


def to_table(stream: DataFrame, name: str) -> DataFrame:
    """The rows an append stream gives for the input there is, through a table in the shared folder."""
    spark = stream.sparkSession
    path = scratch_path(spark, name)
    writer = stream.writeStream.outputMode("append").format("parquet").option("path", path)
    run_available(writer, scratch_path(spark, f"{name}-progress"))
    return spark.read.schema(stream.schema).parquet(path)
