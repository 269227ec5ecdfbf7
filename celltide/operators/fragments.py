"""Fragments (chrom, start, end_, cell_idx, dup_count): counts, tiles and coverage."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.regions import STANDARD, chrom_rank, tile_id
from .joins import bounded
from .matrix import counted


def standard_only(df: DataFrame) -> DataFrame:
    return df.where(F.col("chrom").isin(STANDARD))


def with_cells(parsed: DataFrame, cells: DataFrame) -> DataFrame:
    """Fragments by barcode (chrom, start, end_, barcode, dup_count) with their cell; unknown barcodes go.

    Of cells that share a barcode the last one counts.
    """
    ids = cells.groupBy("barcode").agg(F.max("cell_idx").alias("cell_idx"))
    return parsed.join(bounded(ids), "barcode").select("chrom", "start", "end_", "cell_idx", F.coalesce("dup_count", F.lit(1)).cast("int").alias("dup_count"))


def deduplicated(df: DataFrame) -> DataFrame:
    return df.dropDuplicates(["chrom", "start", "end_", "cell_idx"])


def arranged(df: DataFrame, parts: int, width: int = 10_000_000) -> DataFrame:
    """Ready to be written by chromosome: dealt by stretches of it, in order of start, ties in a fixed order."""
    return df.repartition(parts, "chrom", F.floor(F.col("start") / width)).sortWithinPartitions("chrom", "start", "end_", "cell_idx")


def meta(df: DataFrame) -> DataFrame:
    return df.groupBy("chrom").agg(F.count("*").alias("n_fragments"), F.min("start").alias("min_start"), F.max("end_").alias("max_end"))


def chromosomes(df: DataFrame) -> DataFrame:
    return df.select("chrom").distinct().orderBy("chrom")


def per_cell(cells: DataFrame, df: DataFrame) -> DataFrame:
    """``cells`` with n_fragments, 0 for cells without any."""
    n = df.groupBy("cell_idx").agg(F.count("*").alias("n_fragments"))
    return cells.drop("n_fragments").join(n, "cell_idx", "left").fillna(0, ["n_fragments"])


def hit_tiles(df: DataFrame, size: int) -> DataFrame:
    """A row (cell_idx, chrom, bin) for each tile that each fragment touches."""
    first = F.floor(F.col("start") / size)
    last = F.floor(F.greatest(F.col("end_") - 1, F.col("start")) / size)
    return df.select("cell_idx", "chrom", F.explode(F.sequence(first, last)).alias("bin"))


def tile_counts(df: DataFrame, size: int, binary: bool = False) -> DataFrame:
    n = F.count("*")
    return hit_tiles(df, size).groupBy("cell_idx", "chrom", "bin").agg((F.least(n, F.lit(1)) if binary else n).cast("long").alias("n"))


def tile_axis(df: DataFrame, size: int) -> DataFrame:
    """(tile_idx, tile_id, chr, start, end_): all tiles from the first to the last hit one of each chromosome."""
    spans = df.groupBy("chrom").agg(F.floor(F.min("start") / size).alias("lo"), F.floor(F.max(F.greatest(F.col("end_") - 1, F.col("start"))) / size).alias("hi"))
    order = Window.orderBy(chrom_rank(F.col("chrom")), "chrom")
    spans = spans.withColumn("before", F.sum(F.col("hi") - F.col("lo") + 1).over(order) - (F.col("hi") - F.col("lo") + 1))
    tiles = spans.select("*", F.explode(F.sequence("lo", "hi")).alias("b"))
    return tiles.select((F.col("before") + F.col("b") - F.col("lo")).alias("tile_idx"), tile_id(F.col("chrom"), F.col("b"), size).alias("tile_id"), F.col("chrom").alias("chr"), (F.col("b") * size).alias("start"), ((F.col("b") + 1) * size).alias("end_"))


def tile_matrix(df: DataFrame, axis: DataFrame, size: int, binary: bool = False) -> DataFrame:
    hits = hit_tiles(df, size).withColumn("tile_id", tile_id(F.col("chrom"), F.col("bin"), size))
    return counted(hits.join(bounded(axis.select("tile_id", "tile_idx")), "tile_id"), "cell_idx", "tile_idx", binary)


def coverage(df: DataFrame, cells: DataFrame, group: str, bin_size: int, normalize: str = "cpm", sizes: dict[str, int] | None = None, region: tuple[str, int, int] | None = None) -> DataFrame:
    """(group, chrom, bin, value): insertions of each group's cells, one at each end of a fragment.

    Both ends are clipped to the chromosome's bins; with ``sizes`` other chromosomes don't count, but that of a region
    does, with the region's end as its size. cpm divides by millions of the group's fragments, rpkm also by thousands
    of bases; a region limits the bins shown, not what is divided by (its chromosome's fragments). All groups are done
    in one pass: a fragment is two insertions, so counted bins tell the fragments too.
    """
    if normalize not in ("cpm", "rpkm", "raw", "none", None):
        raise ValueError(f"unknown normalization {normalize!r}")
    of = bounded(cells.where(F.col(group).isNotNull()).select("cell_idx", F.col(group).cast("string").alias("group")))
    f = df.select("chrom", "start", "end_", "cell_idx")
    if region is not None:
        f = f.where(F.col("chrom") == region[0])
        sizes = sizes if sizes is None or region[0] in sizes else sizes | {region[0]: region[2]}
    if sizes is not None:
        last = F.element_at(F.create_map(*[x for k, v in sizes.items() for x in (F.lit(k), F.lit(max(1, -(-v // bin_size)) - 1))]), F.col("chrom"))
        f = f.where(F.col("chrom").isin(list(sizes)))
    f = f.join(of, "cell_idx")
    hits = f.select("group", "chrom", F.explode(F.array("start", "end_")).alias("at")).withColumn("bin", F.greatest(F.floor(F.col("at") / bin_size), F.lit(0)))
    if sizes is not None:
        hits = hits.withColumn("bin", F.least("bin", last))
    every = n = hits.groupBy("group", "chrom", "bin").agg(F.count("*").alias("n"))
    if region is not None:
        n = n.where((F.col("bin") >= region[1] // bin_size) & (F.col("bin") < -(-region[2] // bin_size)))
    if normalize in ("raw", "none", None):
        return n.select("group", "chrom", "bin", F.col("n").cast("double").alias("value"))
    value = F.col("n") / (F.col("total") / F.lit(1e6))
    if normalize == "rpkm":
        value = value / F.lit(bin_size / 1000)
    # the exchange of the bins serves both sides; a row for each group is what adaptive execution broadcasts
    totals = every.groupBy("group").agg((F.sum("n") / 2).alias("total"))
    return n.join(totals, "group").select("group", "chrom", "bin", value.alias("value"))


def export_rows(df: DataFrame, cells: DataFrame) -> DataFrame:
    """(chrom, start, end_, barcode, dup_count) in the order of chromosomes and start; fragments of no cell go."""
    named = df.join(bounded(cells.select("cell_idx", "barcode")), "cell_idx")
    return named.select("chrom", "start", "end_", "barcode", "dup_count").orderBy(chrom_rank(F.col("chrom")), "chrom", "start", "end_", "barcode")
