"""Exact top-k inner-product search: tiled matrix products, partial selection in a tile, and a tree of merges.

Queries and all vectors are dealt by a hash of their ids into blocks of bounded size, packed as matrices. A tile is
a block of queries times a block of vectors; each gives its queries' best k. Lists of a query are then merged
FAN_IN at a time until one is left. Only packed blocks and short lists are ever moved, by shuffles; nothing is broadcast.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import Scratch, bounded

#: Vectors of a block, about, on the side of the queries and of all vectors.
QUERY_BLOCK, VECTOR_BLOCK = 2048, 8192
#: Lists of a query that one merge takes.
FAN_IN = 16
#: Different lengths of vectors, at most.
MAX_LENGTHS = 100


def quantised(vector: str | Column, scale: float = 64.0) -> Column:
    """floor(scale * x) of each component, as long; null for a vector that is null or holds null or non-finite components."""
    v = F.col(vector) if isinstance(vector, str) else vector
    bad = F.exists(v, lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == F.lit(float("inf"))))
    return F.when(v.isNotNull() & ~bad, F.transform(v, lambda x: F.floor(F.lit(float(scale)) * x.cast("double")).cast("long")))


def _packed(rows: DataFrame, block: str, names: tuple[str, str]) -> DataFrame:
    """One row for a block: its number, the vectors' ids and their components, as bytes of int64."""

    def run(t: pa.Table) -> pa.Table:
        v = t.column("v").combine_chunks()
        width = len(v.values) // max(len(v), 1)
        m = v.values.to_numpy().reshape(len(v), width)
        ids = t.column("id").to_numpy()
        order = np.lexsort((np.arange(len(ids)), ids))
        return pa.table({block: pa.array([t.column(block)[0].as_py()], pa.int32()), names[0]: pa.array([ids[order].tobytes()], pa.binary()), names[1]: pa.array([np.ascontiguousarray(m[order]).tobytes()], pa.binary())})

    return rows.groupBy(block).applyInArrow(run, f"{block} int, {names[0]} binary, {names[1]} binary")


def best_of(scores: np.ndarray, ids: np.ndarray, query: int, k: int) -> np.ndarray:
    """Places of the k best scores, without the query's own id; ids are ascending, and ties go to the smaller one."""
    own = ids == query
    at = np.flatnonzero(~own) if own.any() else np.arange(len(ids))
    s = scores[at]
    if len(s) > k:
        least = np.partition(s, len(s) - k)[len(s) - k]
        over, tied = np.flatnonzero(s > least), np.flatnonzero(s == least)
        chosen = np.concatenate([over, tied[: k - len(over)]])
    else:
        chosen = np.arange(len(s))
    return at[chosen[np.lexsort((ids[at[chosen]], -s[chosen]))]]


def product(q: np.ndarray, m: np.ndarray) -> np.ndarray:
    """Exact integer products: in float64 where no sum can leave its whole numbers, else in int64 or Python integers."""
    bound = int(np.abs(q).max(initial=0)) * int(np.abs(m).max(initial=0)) * max(q.shape[1], 1)
    if bound < 2**53:
        return (q.astype(np.float64) @ m.astype(np.float64).T).astype(np.int64)
    if bound < 2**63:
        return q @ m.T
    out = q.astype(object) @ m.astype(object).T
    if len(out) and len(out[0]) and max(map(abs, out.ravel())) >= 2**63:
        raise ArithmeticError("an inner product doesn't fit in 64 bits")
    return out.astype(np.int64)


def top_k(vectors: DataFrame, is_query: Column, k: int = 20, query_block: int = QUERY_BLOCK, vector_block: int = VECTOR_BLOCK) -> DataFrame:
    """(query_id, rank, vec_id, score): the k highest inner products of each query with all other rows.

    vectors: (vec_id long, v array<long>); rows with a null id or a null or empty vector take no part, and other
    columns are ignored. A query meets the vectors of its own length only, as there is no product with others; more
    than MAX_LENGTHS lengths raise ValueError. Ties go to the smaller vec_id; a query with fewer than k others gets
    all. Rows that repeat a vec_id are candidates each, but never of a query of that id; query rows that do are one
    query, whose results are the best of all its vectors. An empty input gives an empty result.
    """
    spark = vectors.sparkSession
    with Scratch(spark) as s:
        rows = s.put(vectors.withColumn("q", F.coalesce(is_query, F.lit(False))).select(F.col("vec_id").cast("long").alias("id"), "v", "q").where("id is not null and size(v) > 0").withColumn("w", F.size("v")))
        lengths = rows.groupBy("w").agg(F.count("*").alias("n"), F.sum(F.col("q").cast("long")).alias("n_q")).limit(MAX_LENGTHS + 1).collect()
        if len(lengths) > MAX_LENGTHS:
            raise ValueError(f"vectors have more than {MAX_LENGTHS} lengths")
        # blocks are numbered over all lengths: a length's first block and how many it has, for vectors and queries
        first, n_vb, n_qb = {}, 0, 0
        for r in sorted(lengths):
            first[r["w"]] = (n_vb, int(r["n"] // vector_block) + 1, n_qb, int(r["n_q"] // query_block) + 1)
            n_vb, n_qb = n_vb + first[r["w"]][1], n_qb + first[r["w"]][3]
        at = lambda i: F.element_at(F.create_map(*[F.lit(x) for w, of in first.items() for x in (w, of[i])]), F.col("w"))
        part = lambda i, *more: (at(i) + F.pmod(F.xxhash64("id", "v", *more), at(i + 1))).cast("int")
        if not first:
            return s.keep(spark.createDataFrame([], "query_id long, rank int, vec_id long, score long"))
        # rows that repeat an id and a vector are dealt apart by where they were read
        shards = s.put(_packed(rows.withColumn("vb", part(0, F.spark_partition_id())), "vb", ("ids", "m")))
        queries = _packed(rows.where("q").dropDuplicates(["id", "v"]).withColumn("qb", part(2)), "qb", ("q_ids", "q_m"))
        # every block of queries meets every block of vectors of its length; both sides are shuffled, as both grow
        of_query = spark.createDataFrame([(qb, a, a + n - 1) for a, n, b, m in first.values() for qb in range(b, b + m)], "of_qb int, lo int, hi int")
        queries = s.put(queries.join(bounded(of_query), F.col("qb") == F.col("of_qb")).select("q_ids", "q_m", "lo", "hi"))
        tiles = shards.join(queries.withColumn("t_vb", F.explode(F.sequence("lo", "hi"))).hint("merge"), F.col("vb") == F.col("t_vb"))

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for b in batches:
                for vb, ids, m, q_ids, q_m in zip(*(b.column(i).to_pylist() for i in range(5)), strict=True):
                    ids, q_ids = np.frombuffer(ids, np.int64), np.frombuffer(q_ids, np.int64)
                    m, q = np.frombuffer(m, np.int64).reshape(len(ids), -1), np.frombuffer(q_m, np.int64).reshape(len(q_ids), -1)
                    for i in range(0, len(q), 256):
                        scores, out = product(q[i : i + 256], m), ([], [], [])
                        for query, row in zip(q_ids[i : i + 256], scores, strict=True):
                            at = best_of(row, ids, query, k)
                            out[0].append(np.full(len(at), query))
                            out[1].append(ids[at])
                            out[2].append(row[at])
                        cols = [np.concatenate(x) for x in out]
                        yield pa.RecordBatch.from_arrays([pa.array(np.full(len(cols[0]), vb, np.int32)), *[pa.array(x) for x in cols]], ["g", "query_id", "vec_id", "score"])

        found = tiles.select("vb", "ids", "m", "q_ids", "q_m").mapInArrow(run, "g int, query_id long, vec_id long, score long")
        groups = n_vb
        while True:
            groups = -(-groups // FAN_IN)
            found = found.withColumn("g", F.floor(F.col("g") / FAN_IN).cast("int"))
            best = Window.partitionBy("query_id", "g").orderBy(F.desc("score"), "vec_id")
            found = found.withColumn("rank", F.row_number().over(best)).where(F.col("rank") <= k)
            if groups <= 1:
                break
        return s.keep(found.select("query_id", "rank", "vec_id", "score"))
