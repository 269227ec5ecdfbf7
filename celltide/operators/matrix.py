"""Sparse matrices as rows (row_idx, col_idx, value); a position without a row is zero."""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .joins import bounded


def counted(hits: DataFrame, row: str, col: str, binary: bool = False) -> DataFrame:
    """Hits counted by (row, col), or 1 for any if ``binary``."""
    n = F.count("*")
    return hits.groupBy(F.col(row).alias("row_idx"), F.col(col).alias("col_idx")).agg((F.least(n, F.lit(1)) if binary else n).cast("long").alias("value"))


def summed(triples: DataFrame) -> DataFrame:
    """Duplicate positions added up."""
    return triples.groupBy("row_idx", "col_idx").agg(F.sum("value").alias("value"))


def row_slice(coo: DataFrame, start: int | None, stop: int | None, n_rows: int | None = None) -> DataFrame:
    """Rows start to stop, renumbered from 0. A negative start is 0 and a negative stop gives nothing."""
    start = max(start or 0, 0)
    out = coo.where(F.col("row_idx") >= start)
    stop = n_rows if stop is None else stop
    if stop is not None:
        out = out.where(F.col("row_idx") < (stop if stop >= 0 else 0))
    return out.withColumn("row_idx", F.col("row_idx") - start)


def row_set(coo: DataFrame, rows: DataFrame | Iterable[int]) -> DataFrame:
    """The wanted rows under their own numbers; a DataFrame of wanted row_idx, or a few numbers, which reach the scan."""
    if isinstance(rows, DataFrame):
        return coo.join(bounded(rows.select("row_idx").distinct()), "row_idx", "left_semi")
    return coo.where(F.col("row_idx").isin([int(r) for r in rows]))


def one_row(coo: DataFrame, i: int, n_rows: int) -> DataFrame:
    """A single row as row 0; a negative number counts from the end. IndexError out of range."""
    if not -n_rows <= i < n_rows:
        raise IndexError(f"row {i} of {n_rows}")
    return row_slice(coo, i % n_rows, i % n_rows + 1)


def columns(coo: DataFrame, cols: Iterable[int]) -> DataFrame:
    """Columns in the order asked for, renumbered by their place in it; a column may repeat."""
    cols = [int(c) for c in cols]
    if len(set(cols)) < len(cols) or len(cols) > 1000:
        asked = coo.sparkSession.createDataFrame(list(zip(cols, range(len(cols)), strict=True)), "col_idx long, at long")
        return coo.join(bounded(asked), "col_idx").select("row_idx", F.col("at").alias("col_idx"), "value")
    if not cols:
        return coo.limit(0)
    place = F.array_position(F.array(*map(F.lit, cols)), F.col("col_idx").cast("int")) - 1
    return coo.where(F.col("col_idx").isin(cols)).select("row_idx", place.cast("long").alias("col_idx"), "value")


def slice_2d(coo: DataFrame, rows: tuple[int | None, int | None], cols: tuple[int | None, int | None] | list[int], n_rows: int, n_cols: int) -> DataFrame:
    """Rows as in ``row_slice``; columns a list as in ``columns``, or bounds with Python's meaning of negative ones."""
    out = row_slice(coo, *rows, n_rows=n_rows)
    if isinstance(cols, list):
        return columns(out, cols)
    lo, hi, _ = slice(*cols).indices(n_cols)
    return out.where((F.col("col_idx") >= lo) & (F.col("col_idx") < hi)).withColumn("col_idx", F.col("col_idx") - lo)


def chunks(coo: DataFrame, cells: DataFrame | None = None, cols: list[int] | None = None, batch: int = 2048) -> DataFrame:
    """(batch, row_idx, entries): each kept row's entries (idx, value) in order, rows dealt into batches by number."""
    out = coo if cells is None else row_set(coo, cells)
    out = out if cols is None else columns(out, cols)
    by_row = out.groupBy("row_idx").agg(F.array_sort(F.collect_list(F.struct("col_idx", "value"))).alias("entries"))
    return by_row.select(F.floor(F.col("row_idx") / batch).cast("long").alias("batch"), "row_idx", "entries")


def dense_column(cells: DataFrame, coo: DataFrame, col: int) -> DataFrame:
    """(cell_idx, value) for every cell, 0.0 where nothing is stored."""
    one = coo.where(F.col("col_idx") == col).select(F.col("row_idx").alias("cell_idx"), "value")
    return cells.select("cell_idx").join(one, "cell_idx", "left").select("cell_idx", F.coalesce(F.col("value").cast("double"), F.lit(0.0)).alias("value"))


def dense_columns(cells: DataFrame, coo: DataFrame, cols: list[int]) -> DataFrame:
    """(cell_idx, f0, f1, ...) for every cell, in the order asked for, in one pass."""
    each = [F.sum(F.when(F.col("col_idx") == c, F.col("value").cast("double"))).alias(f"f{i}") for i, c in enumerate(cols)]
    found = coo.where(F.col("col_idx").isin(cols)).groupBy(F.col("row_idx").alias("cell_idx")).agg(*each)
    return cells.select("cell_idx").join(found, "cell_idx", "left").fillna(0.0, [f"f{i}" for i in range(len(cols))])


def cell_depth(cells: DataFrame, coo: DataFrame) -> DataFrame:
    """(cell_idx, depth): the sum of each cell's values, 0.0 for a cell without any."""
    sums = coo.groupBy(F.col("row_idx").alias("cell_idx")).agg(F.sum(F.col("value").cast("double")).alias("depth"))
    return cells.select("cell_idx").join(sums, "cell_idx", "left").fillna(0.0, ["depth"])


def feature_totals(coo: DataFrame) -> DataFrame:
    return coo.groupBy("col_idx").agg(F.sum(F.col("value").cast("double")).alias("total"), F.count("*").alias("n_cells"))


def stats(coo: DataFrame) -> DataFrame:
    """Stored entries, explicit zeros among them, and the axes that have any."""
    return coo.agg(F.count("*").alias("nnz"), F.count_if(F.col("value") == 0).alias("zeros"), F.countDistinct("row_idx").alias("rows_used"), F.countDistinct("col_idx").alias("cols_used"))


def feature_index(coo: DataFrame, parts: int) -> DataFrame:
    """The copy that is read by column: ranges of columns in order, so that files skip by their column bounds."""
    return coo.repartitionByRange(parts, "col_idx").sortWithinPartitions("col_idx", "row_idx")


def project(coo: DataFrame, own: DataFrame, merged: DataFrame) -> DataFrame:
    """Columns renumbered from an input's axis ``own`` (col_idx, id) to ``merged`` (id, new_col), equal ones added up."""
    ids = own.join(merged, "id").select("col_idx", "new_col")
    moved = coo.join(bounded(ids), "col_idx").select("row_idx", F.col("new_col").alias("col_idx"), "value")
    return summed(moved)


def chunk_rows(n_rows: int, nnz: int, target_bytes: int = 8192) -> int:
    """Rows of a chunk of about ``target_bytes`` at 8 bytes an entry: 16 to 10,000."""
    each = nnz / n_rows if n_rows else 0
    return int(min(10_000, max(16, target_bytes / (8 * each) if each else 10_000)))


#: Numbers that share a slice when rows are renumbered.
SLICE = 65_536


def ordinal(df: DataFrame, key: str, name: str) -> DataFrame:
    """``df`` with its rows numbered from 0 in the order of an integer key, without a sort in one task.

    Keys are dealt into slices of SLICE values; slices are counted, and rows numbered within theirs.
    """
    sliced = df.withColumn("__slice", F.floor(F.col(key) / SLICE))
    sizes = sliced.groupBy("__slice").count()
    before = sizes.select("__slice", (F.sum("count").over(Window.orderBy("__slice")) - F.col("count")).alias("__before"))
    within = F.row_number().over(Window.partitionBy("__slice").orderBy(key))
    return sliced.join(before, "__slice").withColumn(name, (F.col("__before") + within - 1).cast("long")).drop("__slice", "__before")


def reindexed(kept: DataFrame, key: str) -> DataFrame:
    """(old_idx, new_idx) of kept keys, numbered from 0 in their order."""
    return ordinal(kept.select(F.col(key).alias("old_idx")).distinct(), "old_idx", "new_idx")
