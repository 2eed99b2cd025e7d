"""Running a query in Spark and its SQL in DuckDB, and comparing the two."""

import glob
import math
import os

import duckdb

TYPES = {
    "bigint": "BIGINT", "int": "INTEGER", "double": "DOUBLE", "string": "VARCHAR",
    "boolean": "BOOLEAN",
}


def connect(sf_dir):
    con = duckdb.connect()
    for path in glob.glob(f"{sf_dir}/*.parquet"):
        name = os.path.basename(path).removesuffix(".parquet")
        con.execute(f"CREATE VIEW {name} AS SELECT * FROM '{path}'")
    return con


def _plain(v):
    if isinstance(v, float):
        return "nan" if math.isnan(v) else repr(v)
    return repr(v)


def rows_of(columns, rows):
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    return sorted(tuple(_plain(r[i]) for i in order) for r in rows)


def differences(df, con, sql):
    """What differs between a DataFrame and a DuckDB query, as short lines."""
    result = con.execute(sql)
    columns = [d[0] for d in result.description]
    types = {d[0]: str(d[1]) for d in result.description}
    expected = rows_of(columns, result.fetchall())
    actual = rows_of(df.columns, df.collect())
    found = []
    if sorted(columns) != sorted(df.columns):
        return [f"columns {sorted(df.columns)} but SQL has {sorted(columns)}"]
    for name, spark_type in df.dtypes:
        if TYPES.get(spark_type, spark_type) != types[name]:
            found.append(f"{name} is {spark_type} but SQL has {types[name]}")
    if len(expected) != len(actual):
        found.append(f"{len(actual)} rows but SQL has {len(expected)}")
    wrong = [(a, e) for a, e in zip(actual, expected) if a != e]
    if wrong:
        found.append(f"{len(wrong)} rows differ, first {wrong[0][0]} but SQL has {wrong[0][1]}")
    return found
