"""Comparison of a query with its SQL in DuckDB, order aside."""

import os

import duckdb
import pandas as pd


def connect(sf_dir):
    c = duckdb.connect()
    for f in os.listdir(sf_dir):
        c.sql(f"CREATE VIEW {f.removesuffix('.parquet')} AS SELECT * FROM '{sf_dir}/{f}'")
    return c


def rows(frame):
    frame = frame[sorted(frame.columns)]
    return sorted(repr(tuple(None if pd.isna(x) else x.item() if hasattr(x, "item") else x for x in r)) for r in frame.astype(object).itertuples(index=False))


TYPES = {"BIGINT": "bigint", "INTEGER": "int", "VARCHAR": "string", "BOOLEAN": "boolean", "DOUBLE": "double"}


def compare(df, sql, con):
    got = pd.DataFrame([tuple(r) for r in df.collect()], columns=df.columns)
    rel = con.sql(sql)
    want = pd.DataFrame(rel.fetchall(), columns=rel.columns)
    assert sorted(got.columns) == sorted(want.columns)
    assert {c: TYPES.get(str(t), str(t)) for c, t in zip(rel.columns, rel.types, strict=True)} == dict(df.dtypes)
    assert rows(got) == rows(want)
