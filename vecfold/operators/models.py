"""Which host serves a model, by which protocol, and which models may be used at all."""

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from vecfold.functions.names import url_origin
from vecfold.operators.skew import lookup_join

# Protocol names in order of preference.
PROTOCOLS = ["openresponses", "openai_chat"]


def protocol(supported: Column) -> Column:
    """The preferred protocol among those a model supports, null when none is."""
    return F.coalesce(*[F.when(F.array_contains(supported, p), F.lit(p)) for p in PROTOCOLS])


def resolve_models(requests: DataFrame, availability: DataFrame) -> DataFrame:
    """Each requested ``model`` with the host that serves it, null when no host has it.

    ``availability`` holds ``model, host, is_primary, priority``: the primary registry wins, then
    the hosts in configured order. A grouped minimum, so a model on many hosts is no hot spot.
    """
    primary = F.when(F.col("is_primary"), F.col("priority"))
    best = availability.groupBy("model").agg(
        F.coalesce(F.min_by("host", primary), F.min_by("host", "priority")).alias("host")
    )
    return lookup_join(requests, best, ["model"], "left")


def trusted_models(models: DataFrame, hosts: Sequence[str] | DataFrame) -> DataFrame:
    """Models whose url has the scheme and authority of a trusted host; without url they pass."""
    origin = url_origin(F.col("url"))
    own_url = F.coalesce("url", F.lit("")) != ""
    if isinstance(hosts, DataFrame):
        trusted = hosts.select(url_origin(F.col("host")).alias("origin"), F.lit(True).alias("trusted")).distinct()
        checked = lookup_join(models.withColumn("origin", origin), trusted, ["origin"], "left")
        return checked.where(~own_url | F.col("trusted")).select(*models.columns)
    allowed = [url_origin(F.lit(host)) for host in hosts]
    return models.where(~own_url | origin.isin(allowed)) if allowed else models.where(~own_url)
