"""Subsets of cells and samples of them."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .joins import bounded


def remap(df: DataFrame, ids: DataFrame, key: str) -> DataFrame:
    """Rows of kept cells under their new numbers; ``ids``: (old_idx, new_idx)."""
    out = df.join(bounded(ids), F.col(key) == F.col("old_idx"))
    return out.select(*[F.col("new_idx").alias(key) if c == key else F.col(c) for c in df.columns])


def target_size(total: int, n: int | None = None, fraction: float | None = None) -> int:
    if (n is None) == (fraction is None):
        raise ValueError("give either a number of cells or a fraction")
    return min(total, n if n is not None else max(1, int(total * fraction)))


def stratum_sizes(cells: DataFrame, group: str, target: int) -> DataFrame:
    """(group, size, n): cells of each group (null is one) and its share of the target, rounded half to even, at least 1."""
    sizes = cells.groupBy(F.col(group).alias("group")).agg(F.count("*").alias("size"))
    total = F.sum("size").over(Window.partitionBy())
    share = F.greatest(F.lit(1), F.bround(F.lit(target) * (F.col("size") / total), 0).cast("long"))
    return sizes.select("group", "size", F.least(share, F.col("size")).alias("n"))


def downsample(cells: DataFrame, n: int | None = None, fraction: float | None = None, group: str | None = None, seed: int = 42) -> DataFrame:
    """(cell_idx) of a sample in order: the cells with the smallest random numbers, over all or of each group's share.

    If shares of at least 1 exceed the target, the sample is cut to it, again by random number. A cell's number is an
    MD5 of seed and cell_idx, so the same seed gives the same cells on any cluster. Cells that the numbers rule out
    with near certainty go before anything is ranked, so a task ranks about as many as are wanted.
    """
    total = cells.count()
    target = target_size(total, n, fraction)
    digest = F.md5(F.concat(F.lit(f"{seed}:"), F.col("cell_idx").cast("string")))
    u = F.conv(F.substring(digest, 1, 12), 16, 10).cast("long") / F.lit(float(16**12))
    ranked = cells.withColumn("__h", digest).withColumn("__u", u)
    likely = lambda wanted, size: F.col("__u") <= (wanted + 12 * F.sqrt(wanted + 1) + 40) / size
    if group is None:
        return ranked.where(likely(F.lit(target), F.lit(max(total, 1)))).orderBy("__h").limit(target).select("cell_idx").orderBy("cell_idx")
    ranked = ranked.join(bounded(stratum_sizes(cells, group, target)), F.col(group).eqNullSafe(F.col("group"))).where(likely(F.col("n"), F.col("size")))
    ranked = ranked.withColumn("__n", F.row_number().over(Window.partitionBy("group").orderBy("__h"))).where(F.col("__n") <= F.col("n"))
    return ranked.orderBy("__h").limit(target).select("cell_idx").orderBy("cell_idx")
