"""Content keys and JSON text: hashes in uuid form, canonical JSON, text lookup in metadata."""

import json
import re

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T


def hash_uuid(text: Column) -> Column:
    """md5 of a text laid out as a uuid."""
    return F.regexp_replace(F.md5(text), "^(.{8})(.{4})(.{4})(.{4})(.{12})$", "$1-$2-$3-$4-$5")


class _Number(str):
    """A number as it was written."""


def _object(pairs: list[tuple]) -> dict:
    found = dict(pairs)
    if len(found) < len(pairs):
        raise ValueError("a key repeats")
    return found


def _constant(name: str):
    raise ValueError(f"{name} is no JSON number")


def _write(value) -> str:
    if isinstance(value, _Number):
        return value
    if isinstance(value, dict):
        return "{" + ",".join(f"{json.dumps(k, ensure_ascii=False)}:{_write(value[k])}" for k in sorted(value)) + "}"
    if isinstance(value, list):
        return "[" + ",".join(map(_write, value)) + "]"
    return json.dumps(value, ensure_ascii=False)


def canonical_text(text: str | None) -> str | None:
    """JSON with sorted keys and no blanks; numbers keep their own text. None if it is no object."""
    try:
        value = json.loads("{}" if text is None else text, parse_int=_Number, parse_float=_Number, parse_constant=_constant, object_pairs_hook=_object)
        written = _write(value)
        written.encode()  # a lone surrogate cannot be stored
        return written if isinstance(value, dict) else None
    except (ValueError, RecursionError):
        return None


@F.arrow_udf(T.StringType())
def _canonical(texts: pa.Array) -> pa.Array:
    # Each distinct text of a batch once; most batches repeat few, often the empty object.
    encoded = texts.dictionary_encode()
    written = pa.array([canonical_text(t) for t in encoded.dictionary.to_pylist()], pa.string())
    return pc.if_else(texts.is_null(), "{}", written.take(encoded.indices))


# Strings and brackets: all that has to be seen to find where a value starts and ends.
_COLON = re.compile(r"\s*:")
_MARKS = re.compile(r'"(?:[^"\\]|\\.)*"|[\[\]{}]', re.DOTALL)


def field_texts(document: str | None, field: str) -> list[str | None]:
    """The text of a field's value in every object of a JSON array (or of the one object), cut out unparsed.

    Null where the field is missing. Of a field that repeats the last one counts.
    """
    found, depth = [], 0
    objects = 1 if (document or "").lstrip().startswith("{") else 2
    name, starts = json.dumps(field), None
    for mark in _MARKS.finditer(document or ""):
        token = mark.group()
        if token in "[{":
            depth += 1
            if depth == objects:
                found.append(None)
        elif token in "]}":
            if starts is not None and depth == objects:
                found[-1], starts = document[starts : mark.start()].strip(), None
            depth -= 1
        elif depth == objects and (colon := _COLON.match(document, mark.end())):
            if starts is not None:
                found[-1] = document[starts : mark.start()].rstrip().removesuffix(",").strip()
            starts = colon.end() if token == name else None
    return found


def _stored_text(raw: str | None) -> str | None:
    """A cut-out value as metadata text: null for none, a string's content, else the value with its numbers kept."""
    if raw is None or raw == "null":
        return None
    try:
        if raw.startswith('"'):
            return json.loads(raw)
    except ValueError:
        return raw
    written = canonical_text(raw)
    return raw if written is None else written


@F.arrow_udf(T.ArrayType(T.StringType()))
def _metadata_texts(documents: pa.Array) -> pa.Array:
    return pa.array([[_stored_text(t) for t in field_texts(d, "metadata")] for d in documents.to_pylist()], pa.list_(pa.string()))


def metadata_texts(document: Column) -> Column:
    """The metadata of each row of a JSON document of rows; no digit of a number is lost."""
    return _metadata_texts(document)


def json_with(document: Column, field: str, text: Column) -> Column:
    """JSON text of a struct with one more field, whose JSON text goes in as it is; null leaves it out."""
    rest = F.to_json(document)
    start = F.substring(rest, F.lit(1), F.length(rest) - 1)
    comma = F.when(rest == "{}", F.lit("")).otherwise(F.lit(","))
    return F.when(text.isNull(), rest).otherwise(F.concat(start, comma, F.lit(f"{json.dumps(field)}:"), text, F.lit("}")))


def canonical_json(text: Column) -> Column:
    """The same JSON object with keys sorted at every level and no blanks; null means ``{}``.

    Every number keeps the text it was given as, so ``1.0`` and ``1`` differ and no digit is lost.
    Null for anything that is no object, repeats a key in an object, or is no JSON.
    """
    return _canonical(text)


def metadata_fields(metadata: Column) -> Column:
    """Metadata as a map of texts."""
    return F.from_json(metadata, "map<string,string>")


def metadata_value(metadata: Column, key: str) -> Column:
    """A metadata field as text, null when missing or JSON null. Dots in the key are literal."""
    return F.element_at(metadata_fields(metadata), F.lit(key))


def vector_text(vector: Column) -> Column:
    """The text a vector's content hash is taken from: its input values before any rounding."""
    return F.to_json(vector.cast("array<double>"))


def derived_id(batch_id: str, *key: Column) -> Column:
    """A uuid fixed by content key and batch, so a retried task or replay repeats it."""
    return hash_uuid(F.concat_ws("|", *[k.cast("string") for k in key], F.lit(batch_id)))
