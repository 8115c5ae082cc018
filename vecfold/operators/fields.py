"""Metadata fields that are stored as columns of their own too, so that a filter reaches the Parquet reader.

A field's column holds ``=`` and the field's text, or the empty text where the field is missing or JSON
null. It is null only in files that were written before the field was chosen; of their rows the metadata
text is asked. So a filter gives the same rows whatever files a collection lies in.
"""

import re
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from vecfold.functions.content import metadata_fields, metadata_value

NAME = "[A-Za-z0-9_]+"
# Columns that a table may have for fields.
MAX_FIELDS = 16
# A frequent field is in at least this share of the rows, with values of at most so many bytes on average.
SHARE = 0.5
MEAN_BYTES = 64


class BadField(Exception):
    """The field cannot have a column."""


def column_name(field: str) -> str:
    return f"meta_{field}"


def stored_value(metadata: Column, field: str) -> Column:
    return F.coalesce(F.concat(F.lit("="), metadata_value(metadata, field)), F.lit(""))


def checked(fields: Sequence[str]) -> list[str]:
    """The fields, each once, in the order given; column names know no case, so two fields must not differ in case alone."""
    found = list(dict.fromkeys(fields))
    for field in found:
        if not re.fullmatch(NAME, field):
            raise BadField(f"field {field!r} cannot name a column")
    if len({field.lower() for field in found}) < len(found):
        raise BadField("two fields differ in case alone")
    if len(found) > MAX_FIELDS:
        raise BadField(f"a table has at most {MAX_FIELDS} fields as columns")
    return found


def frequent_fields(rows: DataFrame, most: int = MAX_FIELDS) -> list[str]:
    """Fields that most rows have, with short values, the most frequent first; counted over all rows."""
    entries = rows.select(F.explode(metadata_fields(F.col("metadata"))).alias("field", "value")).where("value is not null")
    counted = entries.groupBy("field").agg(F.count(F.lit(1)).alias("rows"), F.avg(F.octet_length("value")).alias("bytes"))
    fit = counted.where(F.col("field").rlike(f"^{NAME}$") & (F.col("bytes") <= MEAN_BYTES) & (F.col("rows") >= SHARE * rows.count()))
    one = fit.groupBy(F.lower("field")).agg(F.max(F.struct("rows", "field")).alias("best")).select("best.*")
    return [r.field for r in one.orderBy(F.desc("rows"), "field").limit(most).collect()]


def column_matches(field: str, wanted: str) -> Column:
    """Whether a field equals a text, by its column; the first part is what the reader's statistics decide."""
    column = F.col(column_name(field))
    in_text = F.coalesce(metadata_value(F.col("metadata"), field) == F.lit(wanted), F.lit(False))
    return ((column == F.lit(f"={wanted}")) | column.isNull()) & F.when(column.isNull(), in_text).otherwise(F.lit(True))
