"""Rows of a Spark query against those of its SQL in DuckDB."""

from pathlib import Path

import duckdb
import numpy as np


def plain(value):
    if isinstance(value, (list, tuple, np.ndarray)):
        return tuple(plain(v) for v in value)
    if value is None or value != value:
        return "null"
    if isinstance(value, float):
        return round(value, 6) + 0.0
    return value


def as_rows(names, rows):
    order = sorted(range(len(names)), key=lambda i: names[i])
    return [names[i] for i in order], sorted((tuple(plain(row[i]) for i in order) for row in rows), key=str)


def same_rows(spark, sf_dir, query, sql):
    df = query(spark, sf_dir)
    connection = duckdb.connect()
    connection.execute("SET TimeZone = 'UTC'")
    for path in Path(sf_dir).glob("*.parquet"):
        connection.execute(f"CREATE VIEW {path.stem} AS SELECT * FROM '{path}'")
    found = connection.execute(sql)
    names = [d[0] for d in found.description]
    assert as_rows(df.columns, df.collect()) == as_rows(names, found.fetchall())
