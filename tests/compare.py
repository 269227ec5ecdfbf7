"""Rows of a Spark query against those of SQL, whatever their order."""

import math

import duckdb

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def sql_rows(sql: str, folder: str):
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"create view {t} as select * from '{folder}/{t}.parquet'")
    return plain(con.execute(sql).df())


def _value(v):
    if hasattr(v, "tolist") and not isinstance(v, (str, bytes)):
        v = v.tolist()
    if isinstance(v, list):
        return tuple(map(_value, v))
    if v is None or isinstance(v, float) and math.isnan(v):
        return None
    if isinstance(v, (int, float)) and not isinstance(v, bool):
        return round(float(v), 6)
    return None if str(v) in ("<NA>", "NaT") else v


def plain(df):
    cols = sorted(df.columns)
    return cols, sorted((tuple(map(_value, r)) for r in df[cols].itertuples(index=False)), key=repr)
