"""Union of datasets: cells, feature axes, matrices, fragments, metadata."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .matrix import ordinal, project


def merge_cells(inputs: list[DataFrame], labels: list[str], batch_key: str = "sample_id", columns: str | list[str] = "all") -> DataFrame:
    """Cells of all inputs in their order, renumbered, with the input's label; columns all, shared, or a list."""
    named = {c for df in inputs for c in df.columns} - {"cell_idx"}
    if columns == "shared":
        named = set.intersection(*[set(df.columns) for df in inputs]) - {"cell_idx"}
    elif columns != "all":
        named &= set(columns)
    first = [c for df in inputs for c in df.columns]
    order = [c for c in dict.fromkeys(first) if c in named and c != batch_key]
    parts, at = [], 0
    for df, label in zip(inputs, labels, strict=True):
        numbered = ordinal(df, "cell_idx", "__new")
        parts.append(numbered.select((F.col("__new") + at).alias("cell_idx"), *[c for c in order if c in df.columns], F.lit(label).alias(batch_key)))
        at += df.count()
    return reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), parts).select("cell_idx", *order, batch_key)


def merge_features(inputs: list[DataFrame], name: str, strategy: str = "union") -> DataFrame:
    """(new_col, id) of the union or the intersection of the inputs' ids, in the order of names."""
    ids = [df.select(F.col(name).alias("id")).where("id is not null").distinct() for df in inputs]
    both = reduce(lambda a, b: a.intersect(b), ids) if strategy == "intersection" else reduce(lambda a, b: a.union(b), ids).distinct()
    # an axis has at most the features of a genome, so its names fit one sort
    return both.select((F.row_number().over(Window.orderBy("id")) - 1).cast("long").alias("new_col"), "id")


def same_axis(inputs: list[DataFrame], key: str, name: str) -> bool:
    """All inputs have the same ids in the same order, so matrices need no projection."""
    marks = {tuple(df.agg(F.count("*"), F.sum(F.xxhash64(key, name).cast("decimal(38,0)"))).first()) for df in inputs}
    return len(marks) == 1


def first_seen(inputs: list[DataFrame], key: str, name: str) -> DataFrame:
    """The row of each id from the first input that has it, there the first by key."""
    tagged = [df.withColumn("__input", F.lit(i)) for i, df in enumerate(inputs)]
    rows = reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), tagged)
    first = Window.partitionBy(name).orderBy("__input", key)
    return rows.withColumn("__n", F.row_number().over(first)).where("__n = 1").drop("__n", "__input")


def merge_matrices(inputs: list[tuple[DataFrame | None, DataFrame, int]], merged: DataFrame) -> DataFrame:
    """Matrices (coo or None, own axis (col_idx, id), first new row) on the merged axis (id, new_col), rows shifted.

    An input without the matrix adds no rows, which are zeros.
    """
    parts = [project(coo, own, merged).withColumn("row_idx", F.col("row_idx") + at) for coo, own, at in inputs if coo is not None]
    return reduce(lambda a, b: a.unionByName(b), parts) if parts else merged.sparkSession.createDataFrame([], "row_idx long, col_idx long, value double")


def merge_fragments(inputs: list[tuple[DataFrame, int]]) -> DataFrame:
    return reduce(lambda a, b: a.unionByName(b), [df.withColumn("cell_idx", F.col("cell_idx") + at) for df, at in inputs])


def merge_metadata(inputs: list[DataFrame], labels: list[str]) -> DataFrame:
    return reduce(lambda a, b: a.unionByName(b), [df.withColumn("key", F.concat(F.lit(f"{label}:"), F.col("key"))) for df, label in zip(inputs, labels, strict=True)])
