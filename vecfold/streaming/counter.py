"""The request counter as a stream."""

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import DataStreamWriter

from vecfold.operators.requests import counted_requests

KEYS = ["minute_start", "status_code"]


def minute_counts_stream(log: DataFrame, path: str) -> DataStreamWriter:
    """Counts per minute and status of every micro-batch, in a folder of the batch's number.

    Nothing waits for a watermark and nothing late is dropped; a batch that is replayed writes its
    own folder again, so each request counts once.
    """

    def write(batch: DataFrame, number: int) -> None:
        minute = F.date_trunc("minute", "ts").alias("minute_start")
        counts = counted_requests(batch).groupBy(minute, "status_code").agg(F.count(F.lit(1)).alias("requests"))
        counts.write.mode("overwrite").parquet(f"{path}/batch={number}")

    return log.writeStream.foreachBatch(write)


def requests_by_minute(counts: DataFrame) -> DataFrame:
    """The stored counts of all batches, merged by minute and status."""
    return counts.groupBy(*KEYS).agg(F.sum("requests").alias("requests"))
