"""Names, paths and links."""

from pyspark.sql import Column
from pyspark.sql import functions as F

from vecfold.schemas import COLLECTION_NAME_PATTERN, COLLECTIONS_PATH


def strip(text: Column) -> Column:
    """Remove white space of any kind from both ends."""
    return F.regexp_replace(text, r"^\s+|\s+$", "")


def normalize_name(text: Column) -> Column:
    """Trimmed lower-case collection name, null when it has characters that are not allowed."""
    name = F.lower(strip(text))
    return F.when(name.rlike(COLLECTION_NAME_PATTERN), name)


def normalize_authz(text: Column) -> Column:
    """Trimmed authorization path, null when blank."""
    return F.nullif(strip(text), F.lit(""))


def authz_is_valid(text: Column) -> Column:
    """A path is valid when blank or starting with a slash."""
    return F.coalesce(F.startswith(normalize_authz(text), F.lit("/")), F.lit(True))


def collection_path(name: Column) -> Column:
    """Authorization resource and self link of a collection."""
    return F.concat(F.lit(COLLECTIONS_PATH + "/"), name)


def embedding_path(collection_name: Column, embedding_id: Column) -> Column:
    """Self link of an embedding, without a collection part when the collection is unknown."""
    return F.when(
        F.coalesce(collection_name, F.lit("")) != "",
        F.concat(collection_path(collection_name), F.lit("/embeddings/"), embedding_id),
    ).otherwise(F.concat(F.lit("/embeddings/"), embedding_id))


def default_authz(requested: Column, collection_name: Column) -> Column:
    """The row's authorization path: the requested one or the collection's own."""
    return F.coalesce(normalize_authz(requested), collection_path(collection_name))


def split_names(text: Column) -> Column:
    """A comma-separated list as an array of trimmed, non-blank entries."""
    return F.filter(F.transform(F.split(text, ","), strip), lambda name: name != "")


def url_origin(url: Column) -> Column:
    """Scheme and authority of a url."""
    return F.concat(F.try_parse_url(url, F.lit("PROTOCOL")), F.lit("://"), F.try_parse_url(url, F.lit("AUTHORITY")))
