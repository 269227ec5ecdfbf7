"""Joins with a side of checked size."""

from __future__ import annotations

from functools import reduce
from operator import add

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Rows, and bytes of texts besides, up to which a side is broadcast; a larger one is shuffled.
BROADCAST_ROWS, BROADCAST_BYTES = 500_000, 32_000_000


def bounded(df: DataFrame, rows: int = BROADCAST_ROWS, size: int = BROADCAST_BYTES) -> DataFrame:
    """``df`` marked for broadcast if it has at most ``rows`` rows and about ``size`` bytes."""
    texts = [F.coalesce(F.octet_length(df[f"`{name}`"]), F.lit(0)) for name, kind in df.dtypes if kind in ("string", "binary")]
    wide = reduce(add, texts, F.lit(8 * len(df.columns))).cast("long")
    n, total = df.select(wide.alias("w")).limit(rows + 1).agg(F.count("*"), F.coalesce(F.sum("w"), F.lit(0))).first()
    return F.broadcast(df) if n <= rows and total <= size else df
