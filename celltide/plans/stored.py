"""Queries that go through a dataset on disk: each builds one of the test tables, changes it and reads it back.

The folder is that of spark.checkpoint.dir, which all executors share; a local session without one gets its own.
"""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..dataset import Dataset, merge
from .catalog import _EDGES, _edges, _t, cells, coo, frags, genes, query


def _folder(spark: SparkSession) -> str:
    """A new place for a dataset. RuntimeError on a cluster that names no shared folder."""
    root = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not root:
        if spark.sparkContext.master.split("[")[0] != "local":
            raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
        root = tempfile.mkdtemp(prefix="celltide-")
    return f"{root.rstrip('/')}/stored-{uuid.uuid4().hex}"


def _cells(spark: SparkSession, d: str) -> DataFrame:
    return cells(spark, d).select("cell_idx", "barcode", F.col("sample_id").cast("string").alias("sample_id"), "cell_type", "total")


def _genes(spark: SparkSession, d: str) -> DataFrame:
    return genes(spark, d).select("gene_idx", "gene_id", "symbol", "size")


def _made(spark: SparkSession, d: str, counts: bool = True) -> Dataset:
    """A dataset of all cells and genes, with their counts."""
    ds = Dataset.create(spark, _folder(spark))
    ds.set_entity("cells", _cells(spark, d))
    ds.set_entity("genes", _genes(spark, d))
    ds.flush()
    if counts:
        ds.add_matrix("RNA_counts", coo(spark, d), ds.n_cells, ds.n_genes)
        ds.flush()
    return ds


_ALL = "select row_idx, col_idx, value from coo"


@query(_ALL)
def store_matrix(spark, d):
    path = _made(spark, d).path
    return Dataset.open(spark, path).RNA.counts.df


@query("select row_idx, i as col_idx, value from coo join (values (9, 0), (3, 1)) c(col, i) on col_idx = col")
def store_feature_index(spark, d):
    layer = _made(spark, d).layer("RNA_counts")
    layer.build_feature_index()
    return layer.columns([9, 3])


@query(_ALL)
def store_layer_writer(spark, d):
    ds, c = _made(spark, d, counts=False), coo(spark, d)
    writer = ds.create_layer_writer("RNA_counts", ds.n_cells, ds.n_genes)
    writer.write_chunk(c.where("row_idx < 60"))
    writer.write_chunk(c.where("row_idx >= 60").withColumn("row_idx", F.col("row_idx") - 60), 60)
    writer.finalize()
    return ds.layer("RNA_counts").df


@query(_ALL)
def store_copy_and_compact(spark, d):
    copied = _made(spark, d).copy(_folder(spark))
    copied.compact()
    return copied.layer("RNA_counts").df


@query("select cell_idx, barcode, cell_type, total * 2 as twice from cells")
def store_column(spark, d):
    ds = _made(spark, d, counts=False)
    ds.add_cells_column("twice", _cells(spark, d).select("cell_idx", (F.col("total") * 2).alias("value")))
    return ds.cells.select("cell_idx", "barcode", "cell_type", "twice")


_KEEPS = ", keeps as (select cell_idx, row_number() over (order by cell_idx) - 1 as n from cells where cell_type = 'BUILDING') "


@query(_KEEPS + "select n as row_idx, col_idx, value from coo join keeps on cell_idx = row_idx")
def store_subset(spark, d):
    ds = _made(spark, d)
    return ds.subset(ds.cells.where("cell_type = 'BUILDING'").select("cell_idx"), _folder(spark)).layer("RNA_counts").df


@query(_KEEPS + "select n as cell_idx, barcode, total from cells join keeps using (cell_idx)")
def store_filter_cells(spark, d):
    ds = _made(spark, d)
    ds.filter_cells(ds.cells.where("cell_type = 'BUILDING'").select("cell_idx"))
    return ds.cells.select("cell_idx", "barcode", "total")


@query(""", n as (select count(*) as n from cells) select row_idx + x * n as row_idx, gene_id, value from coo join genes on col_idx = gene_idx, n, (values (0), (1)) v(x) where size > 20""")
def store_merge(spark, d):
    both = _made(spark, d)
    few = Dataset.create(spark, _folder(spark))
    few.set_entity("cells", _cells(spark, d))
    named = _genes(spark, d).where("size > 20").withColumn("old", F.col("gene_idx")).drop("gene_idx")
    few.set_entity("genes", named, order="old")
    few.flush()
    own = few.genes.select(F.col("old").alias("col_idx"), F.col("gene_idx").alias("to"))
    counts = coo(spark, d).join(own, "col_idx").select("row_idx", F.col("to").alias("col_idx"), "value")
    few.add_matrix("RNA_counts", counts, few.n_cells, few.n_genes)
    few.flush()
    out = merge([both, few], _folder(spark), labels=["a", "b"], gene_strategy="intersection")
    return out.layer("RNA_counts").df.join(out.genes.select(F.col("gene_idx").alias("col_idx"), "gene_id"), "col_idx").select("row_idx", "gene_id", "value")


@query("select vec_id as row_idx, len(embedding) as n, embedding[1]::double as first from embeddings")
def store_embedding(spark, d):
    ds = _made(spark, d, counts=False)
    ds.add_embedding("X_pca", _t(spark, d, "embeddings").select(F.col("vec_id").alias("row_idx"), F.col("embedding").alias("vector")))
    return ds.embedding(ds.list_embeddings("x%")[0]).select("row_idx", F.size("vector").alias("n"), F.col("vector")[0].cast("double").alias("first"))


@query(_EDGES + "select row_idx, col_idx, value::double as value from edges")
def store_graph(spark, d):
    ds = _made(spark, d, counts=False)
    ds.add_graph("knn", _edges(spark, d))
    return ds.graph("knn").withColumn("value", F.col("value").cast("double"))


@query("select c.cell_idx, count(event_id) as n_fragments from cells c left join frags f on f.cell_idx = c.cell_idx group by 1")
def store_fragment_counts(spark, d):
    ds = _made(spark, d, counts=False)
    ds.set_fragments(frags(spark, d), deduplicate=False)
    return ds.cells.select("cell_idx", "n_fragments")


@query("select cell_idx, total as x, total * 10 as y from cells where total between 0 and 5000 and total * 10 between 1000 and 40000")
def store_spatial_box(spark, d):
    ds = _made(spark, d, counts=False)
    ds.set_spatial(_cells(spark, d).select("cell_idx", F.col("total").alias("x"), (F.col("total") * 10).alias("y")))
    return ds.spatial((0, 1000, 5000, 40000))


@query("select row_idx, col_idx, value from coo where row_idx in (select cell_idx from cells where cell_idx < (select count(*) // 2 from cells))")
def store_repair(spark, d):
    ds = _made(spark, d)
    ds.set_entity("cells", _cells(spark, d).where(F.col("cell_idx") < ds.n_cells // 2))
    ds.flush()
    ds.repair()
    return ds.layer("RNA_counts").df


@query("select * from (values ('required_tables', true), ('matrix_files:RNA_counts', true), ('matrix_positions:RNA_counts', true), ('matrix_rows:RNA_counts', false), ('matrix_cols:RNA_counts', true), ('axis:cells', true), ('axis:genes', true)) v(name, good)")
def store_validate(spark, d):
    ds = _made(spark, d)
    ds.set_entity("cells", _cells(spark, d).where(F.col("cell_idx") < ds.n_cells // 2))
    ds.flush()
    report = ds.validate()
    return spark.createDataFrame([(x, True) for x in report.passed] + [(x, False) for x in report.failed], "name string, good boolean")
