"""Text formats: fragments, annotation, matrix market with its side files, barcodes, metrics, peaks, coverage."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions.regions import safe_name
from ..operators.annotation import parse_gtf


def parse_fragments(lines: DataFrame) -> DataFrame:
    """(chrom, start, end_, barcode, dup_count) of tab-separated lines; comments, blanks and short lines go, a missing
    count is 1."""
    f = F.split("value", "\t")
    good = lines.where(~F.startswith("value", F.lit("#")) & (F.size(f) >= 4))
    return good.select(f[0].alias("chrom"), f[1].try_cast("long").alias("start"), f[2].try_cast("long").alias("end_"), f[3].alias("barcode"), F.coalesce(F.get(f, F.lit(4)).try_cast("int"), F.lit(1)).alias("dup_count"))


def read_fragments(spark: SparkSession, path: str) -> DataFrame:
    return parse_fragments(spark.read.text(path))


def numbered(spark: SparkSession, path: str) -> DataFrame:
    """(line, value) of a text file, lines numbered from 0."""
    lines = spark.read.text(path)
    n = lines.select("value", F.monotonically_increasing_id().alias("at"))
    starts = n.groupBy((F.shiftright("at", 33)).alias("part")).agg(F.count("*").alias("n"))
    before = starts.select("part", (F.sum("n").over(Window.orderBy("part")) - F.col("n")).alias("before"))
    return n.withColumn("part", F.shiftright("at", 33)).join(F.broadcast(before), "part").select((F.col("before") + F.col("at").bitwiseAND(F.lit(2**33 - 1))).alias("line"), "value")


def read_gtf(spark: SparkSession, path: str) -> DataFrame:
    return parse_gtf(numbered(spark, path))


def read_mtx(spark: SparkSession, path: str, transpose: bool = True) -> DataFrame:
    """Matrix market entries as (row_idx, col_idx, value); its rows are features, so they become columns."""
    f = F.split(F.trim("value"), r"\s+")
    lines = numbered(spark, path).where(~F.startswith("value", F.lit("%")) & (F.trim("value") != ""))
    first = lines.agg(F.min("line")).first()[0]
    entries = lines.where(F.col("line") > first).select((f[0].cast("long") - 1).alias("i"), (f[1].cast("long") - 1).alias("j"), F.coalesce(F.get(f, F.lit(2)), F.lit("1")).cast("double").alias("value"))
    return entries.select(F.col("j" if transpose else "i").alias("row_idx"), F.col("i" if transpose else "j").alias("col_idx"), "value")


def read_features(spark: SparkSession, path: str) -> DataFrame:
    """(feature_idx, feature_id, name, feature_type) of a features or genes file."""
    f = F.split("value", "\t")
    return numbered(spark, path).select(F.col("line").alias("feature_idx"), f[0].alias("feature_id"), F.coalesce(F.get(f, F.lit(1)), f[0]).alias("name"), F.coalesce(F.get(f, F.lit(2)), F.lit("Gene Expression")).alias("feature_type"))


def read_barcodes(spark: SparkSession, path: str, distinct: bool = True) -> DataFrame:
    """(line, barcode) of the first column; comments and blanks go, of repeated barcodes the first line stays."""
    lines = numbered(spark, path).where((F.trim("value") != "") & ~F.startswith("value", F.lit("#"))).select("line", F.split("value", r"[\t,]")[0].alias("barcode"))
    return lines.groupBy("barcode").agg(F.min("line").alias("line")).select("line", "barcode") if distinct else lines


def read_bed(spark: SparkSession, path: str) -> DataFrame:
    f = F.split("value", "\t")
    good = numbered(spark, path).where(~F.startswith("value", F.lit("#")) & (F.size(f) >= 3))
    return good.select("line", f[0].alias("chr"), f[1].cast("long").alias("start"), f[2].cast("long").alias("end_"), F.concat(f[0], F.lit(":"), f[1], F.lit("-"), f[2]).alias("peak_id"))


def read_csv(spark: SparkSession, path: str, sep: str = ",") -> DataFrame:
    return spark.read.csv(path, header=True, sep=sep)


def write_fragments(rows: DataFrame, path: str, group: str | None = None) -> None:
    """Gzipped tab-separated text; with ``group``, a folder for each value of that column, named safely."""
    if group is not None:
        rows = rows.where(F.col(group).isNotNull()).withColumn("group", safe_name(F.col(group).cast("string"))).drop(*([group] if group != "group" else []))
        rows.write.partitionBy("group").csv(path, sep="\t", compression="gzip")
    else:
        rows.write.csv(path, sep="\t", compression="gzip")


def write_bedgraph(coverage: DataFrame, path: str, bin_size: int) -> None:
    """Non-zero bins of (group, chrom, bin, value) as text, a folder for each group."""
    rows = coverage.where("value <> 0").select(safe_name(F.col("group")).alias("group"), "chrom", (F.col("bin") * bin_size).alias("start"), ((F.col("bin") + 1) * bin_size).alias("end_"), "value")
    rows.repartition("group", "chrom").sortWithinPartitions("group", "chrom", "start").write.partitionBy("group").csv(path, sep="\t")
