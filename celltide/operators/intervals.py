"""Half-open intervals (chrom, start, end_): filters, overlap joins, merging."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.regions import overlaps
from .joins import bounded


def in_region(df: DataFrame, chrom: str, start: int, end: int) -> DataFrame:
    """Intervals that overlap one region; the bounds reach the scan. In order of start."""
    return df.where((F.col("chrom") == chrom) & (F.col("start") < end) & (F.col("end_") > start)).orderBy("start", "end_")


def in_regions(df: DataFrame, regions: DataFrame, bin_size: int = 10_000) -> DataFrame:
    """(region, then the interval's columns) of every overlap with ``regions`` (region, chrom, start, end_).

    Few regions are broadcast and compared by chromosome; many go through the binned join.
    """
    r = regions.select("region", F.col("chrom").alias("r_chrom"), F.col("start").alias("r_start"), F.col("end_").alias("r_end"))
    if r.limit(1001).count() <= 1000:
        found = df.join(F.broadcast(r), (F.col("chrom") == F.col("r_chrom")) & overlaps(F.col("start"), F.col("end_"), F.col("r_start"), F.col("r_end")))
        return found.select("region", *df.columns)
    other = r.select("region", F.col("r_chrom").alias("chrom"), F.col("r_start").alias("start"), F.col("r_end").alias("end_"))
    return overlap_join(df, other, bin_size).select("region", *df.columns)


def overlap_join(a: DataFrame, b: DataFrame, bin_size: int) -> DataFrame:
    """Pairs of overlapping intervals, by an equi-join on (chrom, bin) of all bins each one touches.

    A pair counts in the first bin that both touch only, so none comes twice. Columns of ``b`` that ``a`` has too
    get the prefix ``b_``. Choose a bin about as long as a usual interval; adaptive execution splits hot bins.
    """
    last = F.floor(F.greatest(F.col("end_") - 1, F.col("start")) / bin_size)
    bins = F.explode(F.sequence(F.floor(F.col("start") / bin_size), last))
    left = a.withColumn("__bin", bins)
    right = b.withColumn("__bin", bins).select(*[F.col(c).alias(f"b_{c}" if c in a.columns else c) for c in b.columns], F.col("__bin").alias("__bin_b"))
    pairs = left.join(right, (F.col("chrom") == F.col("b_chrom")) & (F.col("__bin") == F.col("__bin_b")))
    first = F.greatest(F.floor(F.col("start") / bin_size), F.floor(F.col("b_start") / bin_size))
    return pairs.where(overlaps(F.col("start"), F.col("end_"), F.col("b_start"), F.col("b_end_")) & (F.col("__bin") == first)).drop("__bin", "__bin_b")


def merged(df: DataFrame, slice_size: int = 10_000_000) -> DataFrame:
    """(chrom, start, end_, n): overlapping or touching intervals coalesced, with how many went into each.

    Islands are formed within slices of the axis. One begins a new interval unless an earlier slice reaches it, which
    the largest end of all earlier slices tells; so intervals can be numbered by slice, and what is summed over a
    chromosome is one row for each slice. No chromosome is ever in one task, however far an interval reaches.
    """
    sliced = df.select("chrom", "start", "end_").withColumn("s", F.floor(F.col("start") / slice_size))
    order = Window.partitionBy("chrom", "s").orderBy("start", "end_")
    upto, earlier = order.rowsBetween(Window.unboundedPreceding, 0), order.rowsBetween(Window.unboundedPreceding, -1)
    before = F.max("end_").over(earlier)
    island = sliced.withColumn("new", (before.isNull() | (F.col("start") > before)).cast("long")).withColumn("island", F.sum("new").over(upto))
    islands = island.groupBy("chrom", "s", "island").agg(F.min("start").alias("start"), F.max("end_").alias("end_"), F.count("*").alias("n"))
    slices = Window.partitionBy("chrom").orderBy("s").rowsBetween(Window.unboundedPreceding, -1)
    reach = islands.groupBy("chrom", "s").agg(F.max("end_").alias("last")).select("chrom", "s", F.max("last").over(slices).alias("reach"))
    marked = islands.join(reach, ["chrom", "s"]).withColumn("new", (F.col("reach").isNull() | (F.col("start") > F.col("reach"))).cast("long"))
    counts = marked.groupBy("chrom", "s").agg(F.sum("new").alias("n_new")).select("chrom", "s", F.coalesce(F.sum("n_new").over(slices), F.lit(0)).alias("base"))
    numbered = marked.join(counts, ["chrom", "s"])
    within = F.sum("new").over(Window.partitionBy("chrom", "s").orderBy("island").rowsBetween(Window.unboundedPreceding, 0))
    numbered = numbered.withColumn("number", F.col("base") + within)
    return numbered.groupBy("chrom", "number").agg(F.min("start").alias("start"), F.max("end_").alias("end_"), F.sum("n").alias("n")).select("chrom", "start", "end_", "n")


def of_cells(df: DataFrame, cells: DataFrame, chrom: str | None = None) -> DataFrame:
    """Intervals of the cells in ``cells`` (cell_idx, which may repeat), in order of chromosome name and start."""
    ids = bounded(cells.select("cell_idx").distinct())
    out = df if chrom is None else df.where(F.col("chrom") == chrom)
    return out.join(ids, "cell_idx", "left_semi").orderBy("chrom", "start")
