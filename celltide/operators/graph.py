"""Graphs as edges (row_idx, col_idx, value), and embeddings as (row_idx, vector)."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def edges(df: DataFrame, value: str = "value") -> DataFrame:
    """Edges with a float value; an unset one (a correlation, say) is 0."""
    return df.select("row_idx", "col_idx", F.coalesce(F.col(value).cast("float"), F.lit(0.0).cast("float")).alias("value"))


def degree(df: DataFrame) -> DataFrame:
    return df.groupBy("row_idx").agg(F.count("*").alias("degree"), F.sum(F.col("value").cast("double")).alias("weight"))


def shape(df: DataFrame, n: int | None = None) -> tuple[int, int]:
    """(n, n) if the entity's size is known, else one more than the largest index on either side."""
    if n is not None:
        return n, n
    top = df.agg(F.max(F.greatest("row_idx", "col_idx"))).first()[0]
    return (0, 0) if top is None else (top + 1, top + 1)


def vector_slice(df: DataFrame, rows: tuple[int, int], cols: tuple[int, int]) -> DataFrame:
    kept = df.where((F.col("row_idx") >= rows[0]) & (F.col("row_idx") < rows[1]))
    return kept.select((F.col("row_idx") - rows[0]).alias("row_idx"), F.slice("vector", cols[0] + 1, cols[1] - cols[0]).alias("vector"))


def vector_coo(df: DataFrame) -> DataFrame:
    return df.select("row_idx", F.posexplode("vector").alias("col_idx", "value"))
