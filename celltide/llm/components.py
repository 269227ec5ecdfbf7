"""Connected components by alternating large-star and small-star steps, on written tables only."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import BROADCAST_BYTES, BROADCAST_ROWS, Scratch, row_bytes


def _side(df: DataFrame, rows: int, size: int, scratch: Scratch) -> DataFrame:
    """``df``, of ``rows`` rows and ``size`` bytes at most: marked for broadcast if those are small, else written."""
    return F.broadcast(df) if rows <= BROADCAST_ROWS and size <= BROADCAST_BYTES else scratch.put(df)


def _star(sym: DataFrame, mins: DataFrame) -> DataFrame:
    return sym.join(mins, "u")


def connected_components(edges: DataFrame, scratch: Scratch, max_rounds: int = 60) -> DataFrame:
    """(node, root) for every node of ``edges`` (u, v of one type); root is the smallest node reachable.

    Loops and repeated edges are allowed, rows with a null end are ignored and an empty input gives an empty
    result. A hub's edges are only ever in aggregates with a partial step and in inner joins with their
    minima: those are broadcast if the measured edges bound them, else written, so that both sides are plain shuffles that
    adaptive execution can split. Raises RuntimeError if it hasn't settled after ``max_rounds``.
    """
    e = edges.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).where(edges["u"].isNotNull() & edges["v"].isNotNull()).distinct()
    size = {"rows": F.count(F.lit(1)), "bytes": F.coalesce(F.sum(row_bytes(e)), F.lit(0))}
    state = {"n": F.count_if(F.col("u") != F.col("v")), "sum": F.sum(F.when(F.col("u") != F.col("v"), F.xxhash64("u", "v").cast("decimal(38,0)")))}
    e, now = scratch.measured(e, **state, **size)
    nodes = e.select(F.col("u").alias("node")).union(e.select(F.col("v").alias("node"))).distinct()
    e = e.where("u <> v")
    before = None
    for _ in range(max_rounds):
        if (now["n"], now["sum"]) == before or not now["n"]:
            break
        before = now["n"], now["sum"]
        sym = e.union(e.select(F.col("v").alias("u"), F.col("u").alias("v")))
        # a row is an edge, turned or not, or one of its ends twice
        mins = _side(sym.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m")), 2 * now["rows"], 4 * now["bytes"], scratch)
        large = _star(sym, mins).where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()
        large, found = scratch.measured(large, **size)
        least = _side(large.groupBy("u").agg(F.min("v").alias("m")), found["rows"], found["bytes"], scratch)
        small = _star(large, least)
        e, now = scratch.measured(small.where("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v")).union(least.select("u", F.col("m").alias("v"))).distinct(), **state, **size)
        scratch.drop(large)
    else:
        raise RuntimeError(f"components have not settled after {max_rounds} rounds")
    return nodes.join(e.groupBy("u").agg(F.min("v").alias("root")), nodes["node"] == F.col("u"), "left").select("node", F.coalesce("root", "node").alias("root"))
