"""Run a query in Spark and its SQL in DuckDB and compare the two results."""

from __future__ import annotations

import math

import duckdb

TABLES = (
    "region nation customer supplier part orders lineitem events documents embeddings pages "
    "benchmark labels conversations"
).split()


def connect(folder: str) -> duckdb.DuckDBPyConnection:
    con = duckdb.connect()
    for name in TABLES:
        con.execute(f"CREATE VIEW {name} AS SELECT * FROM '{folder}/{name}.parquet'")
    return con


# DuckDB type name for each Spark type the queries return
_SAME_TYPE = {
    "bigint": "BIGINT", "int": "INTEGER", "string": "VARCHAR", "double": "DOUBLE", "boolean": "BOOLEAN",
    "timestamp_ntz": "TIMESTAMP", "date": "DATE", "array<string>": "VARCHAR[]", "array<bigint>": "BIGINT[]",
    "array<int>": "INTEGER[]",
}


def _plain(value):
    if isinstance(value, float) and math.isnan(value):
        return "nan"
    if isinstance(value, (list, tuple)):
        return tuple(_plain(v) for v in value)
    return value


def _rows(names, rows):
    order = sorted(range(len(names)), key=lambda i: names[i])
    plain = [tuple(_plain(row[i]) for i in order) for row in rows]
    return sorted(plain, key=repr)


def differences(df, sql: str, con) -> list[str]:
    """What differs between the two results; empty when they are the same."""
    found = []
    relation = con.sql(sql)
    duck_types = dict(zip(relation.columns, [str(t) for t in relation.types], strict=True))
    spark_types = {f.name: f.dataType.simpleString() for f in df.schema.fields}
    if sorted(duck_types) != sorted(spark_types):
        return [f"columns {sorted(spark_types)} against {sorted(duck_types)}"]
    for name, kind in spark_types.items():
        if _SAME_TYPE.get(kind) != duck_types[name]:
            found.append(f"column {name}: {kind} against {duck_types[name]}")
    left = _rows(df.columns, [tuple(r) for r in df.collect()])
    right = _rows(list(relation.columns), relation.fetchall())
    if len(left) != len(right):
        found.append(f"{len(left)} rows against {len(right)}")
    if left != right:
        in_left, in_right = set(left), set(right)
        only_left = [x for x in left if x not in in_right][:3]
        only_right = [x for x in right if x not in in_left][:3]
        found.append(f"values: {only_left} against {only_right}")
    if not left:
        found.append("no rows")
    return found
