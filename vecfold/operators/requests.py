"""Counters over the request log."""

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

# Label names of the request counter and endpoints it leaves out.
REQUEST_LABELS = ["method", "path", "user_id", "response_time_ms", "status_code"]
HOUSEKEEPING_PATHS = ["/", "/docs", "/openapi.json", "/_status", "/_version", "/favicon.ico", "/metrics"]


def counted_requests(log: DataFrame, excluded: Sequence[str] = HOUSEKEEPING_PATHS) -> DataFrame:
    """The log without housekeeping endpoints (with or without a trailing slash)."""
    paths = sorted({variant for p in excluded for variant in (p, p.rstrip("/") + "/")})
    return log.where(~F.col("path").isin(paths)).withColumn("user_id", F.coalesce("user_id", F.lit("Unknown")))


def count_requests(log: DataFrame, labels: Sequence[str] = REQUEST_LABELS) -> DataFrame:
    """Requests per combination of labels."""
    return counted_requests(log).groupBy(*labels).agg(F.count(F.lit(1)).alias("requests"))


def requests_by_status(log: DataFrame) -> DataFrame:
    """The recommended rollup of the counter: requests per status code."""
    return count_requests(log, ["status_code"])
