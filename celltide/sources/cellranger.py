"""Folders of 10x pipelines: matrix, features and barcodes as text, with fragments, metrics and peaks beside them."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .. import dataset
from ..functions.regions import feature_columns
from ..operators import entity, matrix
from ..operators.joins import bounded
from . import text

# Kinds of features in the side file, the modality and the axis they go to.
KINDS = {"Gene Expression": ("RNA", "genes"), "Peaks": ("ATAC", "peaks"), "Antibody Capture": ("protein", "proteins")}
# Names that a file may have.
MATRIX, FEATURES, BARCODES = ("matrix.mtx.gz", "matrix.mtx"), ("features.tsv.gz", "features.tsv", "genes.tsv.gz", "genes.tsv"), ("barcodes.tsv.gz", "barcodes.tsv")
FOLDERS = ("", "filtered_feature_bc_matrix", "outs/filtered_feature_bc_matrix", "filtered_peak_bc_matrix", "outs/filtered_peak_bc_matrix")
FRAGMENTS = ("atac_fragments.tsv.gz", "fragments.tsv.gz", "fragments.tsv")
METRICS, PEAKS, ANNOTATION = ("per_barcode_metrics.csv",), ("atac_peaks.bed", "peaks.bed"), ("atac_peak_annotation.tsv", "peak_annotation.tsv")


def _find(spark: SparkSession, folders: list[str], names: tuple[str, ...]) -> str | None:
    for folder in folders:
        files = dataset.Files(spark, folder)
        for n in names:
            if files.exists(f"{folder}/{n}"):
                return f"{folder}/{n}"
    return None


def features_by_kind(features: DataFrame) -> DataFrame:
    """(kind, feature_idx, new_idx, feature_id, name): features of each kind numbered from 0 in their order."""
    parts = [matrix.ordinal(features.where(F.col("feature_type") == k), "feature_idx", "new_idx").withColumn("kind", F.lit(k)) for k in KINDS]
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out.select("kind", "feature_idx", "new_idx", "feature_id", "name")


def peaks_of(features: DataFrame) -> DataFrame:
    """Peaks (peak_idx, peak_id, chr, start, end_) of features named by their place."""
    return features.select(F.col("new_idx").alias("peak_idx"), F.col("feature_id").alias("peak_id"), *feature_columns(F.col("feature_id"), lenient=True))


def from_cellranger(spark: SparkSession, path: str | list[str], output: str, sample_name: str | list[str] | None = None, import_fragments: bool | None = None, keep_chroms: str = "standard", modalities: list[str] | None = None, force: bool = False) -> dataset.Dataset:
    """A dataset of one folder, or of several merged in their order, features united.

    Each kind of features becomes a modality with its own axis (only those of ``modalities``, if given). Fragments are
    imported if they are there, unless ``import_fragments`` is false. FileNotFoundError for a folder without a matrix.
    """
    if not isinstance(path, str):
        names = list(sample_name) if sample_name is not None else [p.rstrip("/").rsplit("/", 1)[-1] for p in path]
        if len(names) != len(path):
            raise ValueError(f"{len(names)} names for {len(path)} folders")
        parts = [from_cellranger(spark, p, f"{output}__part{k}", n, import_fragments, keep_chroms, modalities, True) for k, (p, n) in enumerate(zip(path, names, strict=True))]
        out = dataset.merge(parts, output, labels=names, force=force)
        for p in parts:
            out.files.delete(p.path)
        return out
    folders = [f"{path.rstrip('/')}/{x}".rstrip("/") for x in FOLDERS]
    matrix_path, features_path, barcodes_path = (_find(spark, folders, n) for n in (MATRIX, FEATURES, BARCODES))
    if not (matrix_path and features_path and barcodes_path):
        raise FileNotFoundError(f"no matrix with features and barcodes in {path}")
    ds = dataset.Dataset.create(spark, output, force)
    barcodes = text.read_barcodes(spark, barcodes_path, distinct=False)
    ds.set_entity("cells", barcodes.select(F.col("line").alias("cell_idx"), "barcode", F.lit(sample_name).cast("string").alias("sample_id")))
    features = features_by_kind(text.read_features(spark, features_path))
    coo, wanted = text.read_mtx(spark, matrix_path), []
    for kind, (modality, table) in KINDS.items():
        own = features.where(F.col("kind") == kind)
        if (modalities is None or modality in modalities) and not own.isEmpty():
            if table == "genes":
                ds.set_entity(table, entity.unique_ids(own.select(F.col("new_idx").alias("gene_idx"), F.col("feature_id").alias("gene_id"), F.col("name").alias("symbol")), "gene_id", "gene_idx"))
            elif table == "peaks":
                ds.set_entity(table, peaks_of(own))
            else:
                ds.set_entity(table, entity.unique_ids(own.select(F.col("new_idx").alias("protein_idx"), F.col("feature_id").alias("protein_id")), "protein_id", "protein_idx"))
            wanted.append((f"{modality}_counts", table, own))
    ds.flush()
    n = ds.n_cells
    for name, table, own in wanted:
        ids = bounded(own.select(F.col("feature_idx").alias("old"), "new_idx"))
        ds.add_matrix(name, coo.join(ids, F.col("col_idx") == F.col("old")).select("row_idx", F.col("new_idx").alias("col_idx"), "value"), n, ds.entity(table).count(), features=table)
    ds.flush()
    found = _find(spark, [path.rstrip("/"), f"{path.rstrip('/')}/outs"], FRAGMENTS)
    if import_fragments and not found:
        raise FileNotFoundError(f"no fragments in {path}")
    if found and import_fragments is not False:
        ds.import_fragments(found, keep_chroms)
    ds.provenance.log("import", "from_cellranger", {"path": path, "matrices": [x[0] for x in wanted]}, outputs=[output])
    return ds


def from_cellranger_arc(spark: SparkSession, path: str, output: str, sample_name: str | None = None, import_fragments: bool = True, keep_chroms: str = "standard", force: bool = False) -> dataset.Dataset:
    """As ``from_cellranger``, with the metrics of barcodes joined to cells, peaks taken from their own file, and their
    annotation joined to them, where these files are there."""
    folders = [path.rstrip("/"), f"{path.rstrip('/')}/outs"]
    ds = from_cellranger(spark, path, output, sample_name, None if import_fragments else False, keep_chroms, force=force)
    metrics, bed, annotation = (_find(spark, folders, n) for n in (METRICS, PEAKS, ANNOTATION))
    if metrics:
        ds._pending["entity/cells"] = entity.with_metrics(ds.cells, text.read_csv(spark, metrics))
    if bed:
        peaks = matrix.ordinal(text.read_bed(spark, bed), "line", "peak_idx").drop("line")
        if ds._has("entity/peaks") and peaks.count() != ds.n_peaks:
            raise ValueError(f"{bed} has not as many peaks as the matrix")
        ds.set_entity("peaks", peaks)
    ds.flush()
    if annotation:
        ds._pending["entity/peaks"] = entity.with_annotation(ds.peaks, text.read_csv(spark, annotation, "\t"))
        ds.flush()
    return ds


def from_10x_group(spark: SparkSession, group, output: str, sample_name: str | None = None, batch: int = 8_000_000, force: bool = False) -> dataset.Dataset:
    """A dataset of a group with data, indices, indptr, shape, barcodes and features, as 10x pipelines keep a matrix of
    features by cells column by column. Only ``batch`` entries are held at a time."""
    import numpy as np
    import pandas as pd

    names = lambda a: [x.decode() if isinstance(x, bytes) else str(x) for x in a[:]]
    of = group["features"] if "features" in group else {"id": group["genes"], "name": group["gene_names"] if "gene_names" in group else group["genes"]}
    ids, symbols = names(of["id"]), names(of["name"])
    kinds = names(of["feature_type"]) if "feature_type" in of else ["Gene Expression"] * len(ids)
    ds = dataset.Dataset.create(spark, output, force)
    barcodes = names(group["barcodes"])
    ds.set_entity("cells", spark.createDataFrame(pd.DataFrame({"cell_idx": range(len(barcodes)), "barcode": barcodes, "sample_id": pd.Series([sample_name] * len(barcodes), dtype=object)}), "cell_idx long, barcode string, sample_id string"))
    indptr, writers = np.asarray(group["indptr"][:], np.int64), []
    for kind, (modality, table) in KINDS.items():
        at = np.array([i for i, k in enumerate(kinds) if k == kind], np.int64)
        if not len(at):
            continue
        own = spark.createDataFrame(pd.DataFrame({"new_idx": range(len(at)), "feature_id": [ids[i] for i in at], "name": [symbols[i] for i in at]}))
        if table == "genes":
            ds.set_entity(table, entity.unique_ids(own.select(F.col("new_idx").alias("gene_idx"), F.col("feature_id").alias("gene_id"), F.col("name").alias("symbol")), "gene_id", "gene_idx"))
        elif table == "peaks":
            ds.set_entity(table, peaks_of(own))
        else:
            ds.set_entity(table, own.select(F.col("new_idx").alias("protein_idx"), F.col("feature_id").alias("protein_id")))
        place = np.full(len(ids), -1, np.int64)
        place[at] = np.arange(len(at))
        writers.append((place, ds.create_layer_writer(f"{modality}_counts", len(barcodes), len(at))))
    first = 0
    while first < len(barcodes):
        last = max(first + 1, int(np.searchsorted(indptr, indptr[first] + batch, "right")) - 1)
        lo, hi = indptr[first], indptr[last]
        cols, values = np.asarray(group["indices"][lo:hi], np.int64), np.asarray(group["data"][lo:hi], np.float64)
        rows = np.repeat(np.arange(first, last), np.diff(indptr[first : last + 1]))
        for place, w in writers:
            keep = place[cols] >= 0
            w.write_chunk(spark.createDataFrame(pd.DataFrame({"row_idx": rows[keep], "col_idx": place[cols][keep], "value": values[keep]}), "row_idx long, col_idx long, value double"))
        first = last
    for _, w in writers:
        w.finalize()
    ds.flush()
    return ds


def from_10x_h5(spark: SparkSession, path: str, output: str, **kw) -> dataset.Dataset:
    """As ``from_10x_group``, of an HDF5 file. ImportError without h5py."""
    import h5py

    with h5py.File(path, "r") as f:
        return from_10x_group(spark, f["matrix"] if "matrix" in f else f[next(iter(f))], output, **kw)
