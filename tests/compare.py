"""Comparing a query with its SQL in DuckDB."""

import math

import duckdb

TABLES = (
    "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations"
).split()


def duck(sf_dir: str) -> duckdb.DuckDBPyConnection:
    connection = duckdb.connect()
    for name in TABLES:
        connection.execute(f"CREATE VIEW {name} AS SELECT * FROM '{sf_dir}/{name}.parquet'")
    return connection


def _plain(value):
    if isinstance(value, float):
        return None if math.isnan(value) else round(value, 6) + 0.0
    return value


def rows(columns, records) -> tuple[list[str], list[tuple]]:
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    plain = [tuple(_plain(record[i]) for i in order) for record in records]
    return [columns[i] for i in order], sorted(plain, key=repr)


KINDS = {"tinyint": "int", "smallint": "int", "integer": "int", "varchar": "string", "timestamp": "timestamp_ntz"}


def compare(frame, connection, sql) -> str | None:
    """None when column names, types and all rows agree, else what differs."""
    result = connection.execute(sql)
    types = {d[0]: str(d[1]).lower() for d in result.description}
    want = rows([d[0] for d in result.description], result.fetchall())
    got = rows(frame.columns, [tuple(r) for r in frame.collect()])
    if got[0] != want[0]:
        return f"columns {got[0]} and {want[0]}"
    for name, kind in frame.dtypes:
        sql_kind = KINDS.get(types[name], types[name])
        if kind != sql_kind:
            return f"column {name} is {kind} and {sql_kind}"
    if len(got[1]) != len(want[1]):
        return f"{len(got[1])} and {len(want[1])} rows"
    different = [(a, b) for a, b in zip(got[1], want[1]) if a != b]
    return f"{len(different)} rows differ, first {different[0]}" if different else None
