"""Row-level authorization: grants to resources, resources to collections, read and write policy."""

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from vecfold.operators.skew import lookup_join
from vecfold.schemas import COLLECTIONS_PATH

# A caller's list: literal paths, or a one-column frame of them when it is long.
Allowed = Sequence[str] | DataFrame


class NotAllowed(Exception):
    """The caller lacks a right that the whole request depends on."""


def allowed_resources(grants: DataFrame, method: str, service: str, principal: Sequence[str] = ()) -> DataFrame:
    """Resources on which each principal may use ``method`` of ``service``.

    ``grants`` has ``resource, service, method`` and the principal columns; ``*`` matches anything.
    """
    matches = F.col("service").isin(service, "*") & F.col("method").isin(method, "*")
    return grants.where(matches).select(*principal, F.col("resource").alias("authz")).distinct()


def explode_grants(mapping: DataFrame, principal: Sequence[str] = ()) -> DataFrame:
    """Grants as rows, from a ``grants map<resource, array<struct<service, method>>>`` column."""
    entries = mapping.select(*principal, F.explode("grants").alias("resource", "entries"))
    return entries.select(*principal, "resource", F.inline("entries"))


def collection_of_resource(resource: Column) -> Column:
    """The collection a resource path names, null for the base path and for deeper paths."""
    parts = F.split(resource, "/")
    is_collection = F.startswith(resource, F.lit(COLLECTIONS_PATH + "/")) & (F.size(parts) == 4)
    return F.when(is_collection, F.nullif(F.get(parts, F.lit(3)), F.lit("")))


def allowed_collections(resources: DataFrame, principal: Sequence[str] = ()) -> DataFrame:
    """Distinct collection names in the callers' resource lists (column ``authz``)."""
    name = collection_of_resource(F.col("authz"))
    return resources.select(*principal, name.alias("collection_name")).where("collection_name is not null").distinct()


def collection_names(allowed: Sequence[str]) -> list[str]:
    """Collection names in one caller's literal list."""
    prefix = COLLECTIONS_PATH + "/"
    tails = [path.removeprefix(prefix) for path in allowed if path.startswith(prefix)]
    return sorted({tail for tail in tails if tail and "/" not in tail})


def _held(allowed: DataFrame) -> DataFrame:
    return allowed.select("authz").distinct()


def visible(rows: DataFrame, allowed: Allowed) -> DataFrame:
    """Rows whose ``authz`` the caller may read; an empty list shows nothing."""
    if isinstance(allowed, DataFrame):
        return lookup_join(rows, _held(allowed), ["authz"], "left_semi")
    return rows.where(F.col("authz").isin(list(allowed))) if allowed else rows.where(F.lit(False))


def with_visibility(rows: DataFrame, allowed: Allowed) -> DataFrame:
    """All rows with a ``visible`` column."""
    if isinstance(allowed, DataFrame):
        held = _held(allowed).withColumn("held", F.lit(True))
        return lookup_join(rows, held, ["authz"], "left").withColumn("visible", F.col("held").isNotNull()).drop("held")
    return rows.withColumn("visible", F.col("authz").isin(list(allowed)) if allowed else F.lit(False))


def write_violations(rows: DataFrame, allowed: Allowed) -> DataFrame:
    """Rows to write whose ``authz`` the caller does not hold; any such row fails the statement."""
    if isinstance(allowed, DataFrame):
        return lookup_join(rows, _held(allowed), ["authz"], "left_anti")
    return rows.where(~F.col("authz").isin(list(allowed))) if allowed else rows


def check_writable(rows: DataFrame, allowed: Allowed) -> None:
    violation = write_violations(rows, allowed).select("authz").first()
    if violation is not None:
        raise NotAllowed(f"not authorized to write rows with authz {violation.authz}")


def visible_collections(catalog: DataFrame, allowed: Allowed) -> DataFrame:
    """Collections the caller may see; the catalog has no policy of its own, names decide."""
    if isinstance(allowed, DataFrame):
        return catalog.join(allowed_collections(allowed), "collection_name", "left_semi")
    names = collection_names(allowed)
    return catalog.where(F.col("collection_name").isin(names)) if names else catalog.where(F.lit(False))


def visible_collections_by_principal(catalog: DataFrame, resources: DataFrame, principal: Sequence[str]) -> DataFrame:
    """The visible catalog of every principal in a resource list."""
    return allowed_collections(resources, principal).join(catalog, "collection_name")
