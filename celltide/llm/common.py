"""Helpers shared by the training-data operators: scratch tables, size-checked joins, text bytes."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Iterator
from contextlib import contextmanager
from functools import reduce
from operator import add

from pyspark.sql import Column, DataFrame, Observation, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: Rows, and bytes of their values, up to which a side of a join is broadcast; beyond either the join shuffles.
BROADCAST_ROWS, BROADCAST_BYTES = 200_000, 32_000_000
#: Rows of text that one Arrow batch hands to a Python worker.
BATCH_ROWS = 256

#: A-Z to a-z on UTF-8 bytes; other characters are left as they are.
LOWER = bytes(c + 32 if 65 <= c <= 90 else c for c in range(256))
#: As LOWER, with every byte that is neither a letter, a digit nor part of a non-ASCII character made a space.
WORDS = bytes(c + 32 if 65 <= c <= 90 else c if 97 <= c <= 122 or 48 <= c <= 57 or c >= 128 else 32 for c in range(256))


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def small_batches(spark: SparkSession) -> None:
    """Bound the rows of an Arrow batch, as whole texts can be long.

    The results are lazy, so the session's setting stays; one that is as low already is left as it is.
    """
    name = "spark.sql.execution.arrow.maxRecordsPerBatch"
    if not 0 < int(spark.conf.get(name)) <= BATCH_ROWS:
        spark.conf.set(name, str(BATCH_ROWS))


def checkpoint_dir(spark: SparkSession) -> str:
    """The shared folder of spark.checkpoint.dir. Where that is unset a local session gets a folder of its own;
    on a cluster, where executors don't see each other's folders, RuntimeError."""
    found = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not found:
        if not spark.sparkContext.master.split("[")[0] == "local":
            raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
        spark.sparkContext.setCheckpointDir(tempfile.mkdtemp(prefix="celltide-"))
        found = spark.sparkContext.getCheckpointDir()
    return found.rstrip("/")


def delete(spark: SparkSession, path: str) -> None:
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    p.getFileSystem(spark._jsc.hadoopConfiguration()).delete(p, True)


#: Lists that gather the paths of kept tables, of blocks of ``gathered`` that are open.
_gathering: list[list[str]] = []


@contextmanager
def gathered() -> Iterator[list[str]]:
    """The paths of tables that operators keep inside the block, for a caller that has written their results elsewhere."""
    paths: list[str] = []
    _gathering.append(paths)
    try:
        yield paths
    finally:
        _gathering.remove(paths)


@contextmanager
def tidy(spark: SparkSession) -> Iterator[None]:
    """Actions inside remove their shuffle files when they end: what they wrote or counted is not read from shuffles again."""
    name = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
    before = spark.conf.get(name, "false")
    spark.conf.set(name, "true")
    try:
        yield
    finally:
        spark.conf.set(name, before)


class Scratch:
    """Tables written to the shared checkpoint folder, which cut lineage and survive lost executors.

    ``with Scratch(spark) as s``: tables of ``s.put`` go when the block ends, a table of ``s.keep`` stays
    for the lazy result that reads it.
    """

    def __init__(self, spark: SparkSession):
        self.spark = spark
        self.root = f"{checkpoint_dir(spark)}/celltide-{uuid.uuid4().hex}"
        self.paths: list[str] = []

    def __enter__(self) -> Scratch:
        return self

    def __exit__(self, *exc) -> None:
        for path in self.paths:
            delete(self.spark, path)

    def _write(self, df: DataFrame) -> tuple[DataFrame, str]:
        path = f"{self.root}/{uuid.uuid4().hex}"
        with tidy(self.spark):
            df.write.option("compression", "zstd").parquet(path)
        return self.spark.read.schema(df.schema).parquet(path), path

    def put(self, df: DataFrame) -> DataFrame:
        out, path = self._write(df)
        self.paths.append(path)
        return out

    def measured(self, df: DataFrame, **aggregates: Column) -> tuple[DataFrame, dict]:
        """As ``put``, with aggregates over its rows that are taken while they are written."""
        seen = Observation()
        out = self.put(df.observe(seen, *[a.alias(name) for name, a in aggregates.items()]))
        return out, seen.get

    def side(self, df: DataFrame, rows: int = BROADCAST_ROWS, size: int = BROADCAST_BYTES) -> DataFrame:
        """As ``put``, marked for broadcast like ``bounded`` by what is measured while it is written."""
        out, found = self.measured(df, n=F.count(F.lit(1)), total=F.sum(row_bytes(df)))
        return F.broadcast(out) if found["n"] <= rows and (found["total"] or 0) <= size else out

    def keep(self, df: DataFrame) -> DataFrame:
        out, path = self._write(df)
        for paths in _gathering:
            paths.append(path)
        return out

    def drop(self, *frames: DataFrame) -> None:
        """Delete tables of ``put`` that are no longer needed."""
        for df in frames:
            for path in [p for p in self.paths if any(p in f for f in df.inputFiles()[:1])]:
                self.paths.remove(path)
                delete(self.spark, path)


def _width(kind: T.DataType, value: Column) -> Column:
    """About the bytes of a value."""
    if isinstance(kind, (T.StringType, T.BinaryType)):
        return F.coalesce(F.octet_length(value), F.lit(0)) + 16
    if isinstance(kind, T.ArrayType):
        return F.coalesce(F.size(value), F.lit(0)) * 16 + 16
    return F.lit(16 * len(kind) if isinstance(kind, T.StructType) else 8)


def row_bytes(df: DataFrame) -> Column:
    """About the bytes of a row."""
    return reduce(add, [_width(f.dataType, F.col(f"`{f.name}`")) for f in df.schema]).cast("long")


def bounded(df: DataFrame, rows: int = BROADCAST_ROWS, size: int = BROADCAST_BYTES) -> DataFrame:
    """``df`` marked for broadcast if it has at most ``rows`` rows and about ``size`` bytes, else unmarked, so that the join shuffles."""
    with tidy(df.sparkSession):
        n, total = df.select(row_bytes(df).alias("w")).limit(rows + 1).agg(F.count("*"), F.coalesce(F.sum("w"), F.lit(0))).first()
    return F.broadcast(df) if n <= rows and total <= size else df


def settled(df: DataFrame, **columns: Column) -> DataFrame:
    """``df`` with columns that are evaluated once for a row: the generator keeps the optimiser from copying them into each use."""
    return df.select("*", F.inline(F.array(F.struct(*[c.alias(name) for name, c in columns.items()]))))


def whole(df: DataFrame) -> Column:
    """All columns as one struct, beside which new columns can have any name."""
    return F.struct(*[df[f"`{c}`"] for c in df.columns])


def as_bytes(text: str | Column = "text") -> Column:
    return F.col(text).cast("binary") if isinstance(text, str) else text.cast("binary")


def uniform(key: Column, seed: str) -> Column:
    """A number in (0, 1) that depends on the key's text and the seed only: 52 bits of an MD5."""
    digest = F.md5(F.concat(F.lit(f"{seed}:"), F.coalesce(key.cast("string"), F.lit("null"))))
    return (F.conv(F.substring(digest, 1, 13), 16, 10).cast("long") + F.lit(0.5)) / F.lit(float(2**52))
