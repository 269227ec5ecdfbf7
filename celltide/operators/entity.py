"""Entity tables: predicates, columns, features."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .. import schema
from ..functions.sqlexpr import predicate
from .joins import bounded


def query(df: DataFrame, expression: str) -> DataFrame:
    """Rows that meet a predicate of the store's SQL dialect."""
    return df.where(predicate(df, expression))


def query_mask(df: DataFrame, expression: str, key: str) -> DataFrame:
    """(key, mask) of all rows; a predicate that is null is false."""
    return df.select(key, F.coalesce(predicate(df, expression), F.lit(False)).alias("mask")).orderBy(key)


def column(df: DataFrame, name: str, key: str) -> DataFrame:
    if name not in df.columns:
        raise KeyError(name)
    return df.select(key, name).orderBy(key)


def with_column(df: DataFrame, key: str, name: str, values: DataFrame) -> DataFrame:
    """A column added or replaced from ``values`` (key, value), which must have each key once; else ValueError."""
    name = schema.fold_columns([name], df.columns)[0]
    n, m, hit = df.count(), values.count(), df.join(values, key, "left_semi").count()
    if not n == m == hit:
        raise ValueError(f"{m} values for {n} rows")
    return df.drop(name).join(values.select(key, F.col("value").alias(name)), key)


def keep(df: DataFrame, key: str, mask: DataFrame) -> DataFrame:
    """Rows whose key is in ``mask`` (key), each once, whatever repeats there. IndexError for a key that isn't there."""
    wanted = mask.select(key).distinct()
    if not wanted.join(df.select(key), key, "left_anti").isEmpty():
        raise IndexError("the mask has keys that the table doesn't")
    return df.join(bounded(wanted), key, "left_semi")


def constraint_errors(df: DataFrame, table: str) -> list[str]:
    """What breaks the table's required and unique columns."""
    _, _, required, unique = schema.ENTITIES[table]
    checks = [F.count_if(F.col(c).isNull()).alias(f"{c} is null") for c in required if c in df.columns]
    found = [k for k, v in (df.agg(*checks).first().asDict().items() if checks else ()) if v]
    return found + [f"{c} repeats" for c in unique if c in df.columns and not df.groupBy(c).count().where(F.col(c).isNotNull() & (F.col("count") > 1)).isEmpty()]


def unique_ids(df: DataFrame, name: str, order: str) -> DataFrame:
    """Repeats of an id, in input order, get -1, -2, ..."""
    n = F.row_number().over(Window.partitionBy(name).orderBy(order)) - 1
    return df.withColumn(name, F.when(n > 0, F.concat(F.col(name), F.lit("-"), n.cast("string"))).otherwise(F.col(name)))


def with_symbol(df: DataFrame) -> DataFrame:
    """``df`` with a column symbol: itself, else the first column that may hold symbols; without any, null."""
    if "symbol" in df.columns:
        return df
    alias = next((c for c in schema.SYMBOLS if c in df.columns), None)
    return df.withColumn("symbol", F.col(alias) if alias else F.lit(None).cast("string"))


def with_metrics(cells: DataFrame, metrics: DataFrame) -> DataFrame:
    """Cells with all columns of per-barcode ``metrics`` that they lack, null where it has none; of a barcode that
    repeats there one row counts."""
    new = [c for c in metrics.columns if c.lower() not in {x.lower() for x in cells.columns}]
    if not new:
        return cells
    return cells.join(metrics.select("barcode", *[F.col(f"`{c}`") for c in new]).dropDuplicates(["barcode"]), "barcode", "left").select(*cells.columns, *[F.col(f"`{c}`") for c in new])


def with_annotation(peaks: DataFrame, table: DataFrame) -> DataFrame:
    """Peaks with nearest_gene, distance_to_tss and annotation of a ``table`` (chrom, start, end, gene, distance,
    peak_type), null where it has none; of a place that repeats there the smallest row counts."""
    found = table.groupBy(F.col("chrom").alias("chr"), F.col("start").cast("long").alias("start"), F.col("end").cast("long").alias("end_")).agg(
        F.min(F.struct(F.col("gene").alias("nearest_gene"), F.col("distance").try_cast("long").alias("distance_to_tss"), F.col("peak_type").alias("annotation"))).alias("x")
    )
    new = ["nearest_gene", "distance_to_tss", "annotation"]
    own = [c for c in peaks.columns if c not in new]
    return peaks.select(*own).join(found, ["chr", "start", "end_"], "left").select(*own, *[F.col(f"x.{c}") for c in new])


def repeated(df: DataFrame, name: str) -> DataFrame:
    return df.groupBy(name).agg(F.count("*").alias("n")).where("n > 1")


def name_column(df: DataFrame, modality: str, asked: str | None = None, sticky: str | None = None) -> str:
    """The column that names features: as asked, else the table's sticky choice, else the first readable one with any
    text, else the first candidate, else the second column."""
    candidates = schema.modality(modality)[3]
    if asked is not None:
        if asked not in df.columns:
            raise ValueError(f"{asked!r} is not a column; there are {df.columns}")
        return asked
    if sticky in df.columns:
        return sticky
    there = [c for c in candidates if c in df.columns]
    readable = [c for c in there if c in schema.READABLE]
    if readable:
        filled = df.agg(*[F.max(F.trim(F.col(c).cast("string")) != "").alias(c) for c in readable]).first().asDict()
        for c in readable:
            if filled[c]:
                return c
    return next((c for c in there if c not in schema.READABLE), there[0] if there else df.columns[min(1, len(df.columns) - 1)])


def has_feature(df: DataFrame, modality: str, name: str) -> tuple[int, str] | None:
    """(key, column) of the first candidate column with the exact name, the smallest key there."""
    _, _, key, candidates = schema.modality(modality)
    there = [c for c in candidates if c in df.columns]
    if not there:
        return None
    row = df.agg(*[F.min(F.when(F.col(c) == name, F.col(key))).alias(c) for c in there]).first()
    return next(((row[c], c) for c in there if row[c] is not None), None)


def stale_categories(df: DataFrame, name: str, order: list[str]) -> DataFrame:
    """Values of a column that its category order lacks."""
    live = df.select(F.col(name).cast("string").alias("value")).where("value is not null").distinct()
    return live.join(F.broadcast(df.sparkSession.createDataFrame([(c,) for c in order], "value string")), "value", "left_anti")
