"""Command line over datasets. Errors end with code 1. Merging intersects genes unless told otherwise, as
people at a terminal mostly want; ``dataset.merge`` unites them, and both unite peaks, tiles and proteins."""

from __future__ import annotations

import argparse
import json
import sys

from pyspark.sql import functions as F

from . import dataset
from .session import session
from .sources import anndata, cellranger, text


def parser() -> argparse.ArgumentParser:
    p = argparse.ArgumentParser(prog="celltide")
    sub = p.add_subparsers(dest="command", required=True)

    def add(name, *args):
        s = sub.add_parser(name)
        for flags, kw in args:
            s.add_argument(*flags.split(), **kw)

    out = ("-o --output", {"required": True})
    add("info", ("path", {}), ("--json", {"action": "store_true"}), ("--provenance", {"action": "store_true"}))
    add("merge", ("inputs", {"nargs": "+"}), out, ("--batch-key", {"default": "sample_id"}), ("--genes", {"default": "intersection"}), ("--no-fragments", {"action": "store_true"}))
    add("subset", ("input", {}), out, ("--query", {}), ("--barcodes", {}), ("--sample", {}))
    add("downsample", ("input", {}), out, ("--n-cells", {"type": int}), ("--fraction", {"type": float}), ("--stratify", {}), ("--seed", {"type": int, "default": 42}))
    add("validate", ("path", {}))
    add("provenance", ("path", {}), ("--methods-text", {"action": "store_true"}))
    add("export-fragments", ("input", {}), out, ("--groupby", {}), ("--region", {}))
    add("export-coverage", ("input", {}), out, ("--groupby", {"required": True}), ("--format", {"default": "bigwig"}), ("--normalize", {"default": "cpm"}), ("--bin-size", {"type": int, "default": 10}), ("--region", {}))
    add("build-csc", ("input", {}), ("--matrix", {}), ("--all", {"action": "store_true"}))
    add("copy", ("input", {}), ("output", {}))
    add("convert", ("input", {}), ("output", {}), ("--modality -m", {"default": "RNA"}), ("--arc", {"action": "store_true"}), ("--no-fragments", {"action": "store_true"}))
    add("init", ("--barcodes", {"required": True}), out, ("--sample-id", {}))
    return p


def run(a: argparse.Namespace, spark) -> None:
    opened = lambda path: dataset.Dataset.open(spark, path)
    match a.command:
        case "info":
            ds = opened(a.path)
            print(json.dumps(ds.info(), default=str) if a.json else repr(ds))
            if a.provenance:
                print(ds.provenance.show())
        case "merge":
            dataset.merge([opened(x) for x in a.inputs], a.output, a.batch_key, gene_strategy=a.genes, include_fragments=not a.no_fragments)
        case "subset":
            ds = opened(a.input)
            if a.query:
                kept = ds.query("cells", a.query)
            elif a.barcodes:
                kept = ds.cells.join(text.read_barcodes(spark, a.barcodes), "barcode", "left_semi")
            elif a.sample:
                kept = ds.cells.where(F.col("sample_id").cast("string").isin(a.sample.split(",")))
            else:
                raise ValueError("give --query, --barcodes or --sample")
            ds.subset(kept.select("cell_idx"), a.output)
        case "downsample":
            opened(a.input).downsample(a.n_cells, a.fraction, a.stratify, a.seed, a.output)
        case "validate":
            report = opened(a.path).validate()
            print("PASSED" if report.ok else "FAILED: " + ", ".join(report.failed))
        case "provenance":
            p = opened(a.path).provenance
            print(p.export_methods_text() if a.methods_text else p.show())
        case "export-fragments":
            opened(a.input).export_fragments(a.output, a.groupby, a.region)
        case "export-coverage":
            opened(a.input).export_coverage(a.groupby, a.output, a.bin_size, a.normalize, a.region, a.format)
        case "build-csc":
            ds = opened(a.input)
            for name in ds.list_matrices() if a.all else [a.matrix]:
                ds.layer(name).build_feature_index()
        case "copy":
            opened(a.input).copy(a.output)
        case "convert":
            convert(spark, a)
        case "init":
            ds = dataset.Dataset.create(spark, a.output, force=True)
            cells = text.read_barcodes(spark, a.barcodes).select("line", "barcode", F.lit(a.sample_id).cast("string").alias("sample_id"))
            ds.set_entity("cells", cells, order="line")
            ds.close()


def convert(spark, a: argparse.Namespace) -> None:
    """A file or folder to a dataset, or a dataset to a file, by the names."""
    if a.output.endswith(".h5ad"):
        anndata.to_anndata(dataset.Dataset.open(spark, a.input), a.modality).write_h5ad(a.output)
    elif a.input.endswith(".h5ad"):
        anndata.from_h5ad(spark, a.input, a.output, a.modality)
    elif a.input.endswith(".h5"):
        cellranger.from_10x_h5(spark, a.input, a.output)
    elif a.arc:
        cellranger.from_cellranger_arc(spark, a.input, a.output, import_fragments=not a.no_fragments)
    else:
        cellranger.from_cellranger(spark, a.input, a.output, import_fragments=False if a.no_fragments else None)


def main(args: list[str] | None = None, spark=None) -> int:
    a = parser().parse_args(args)
    try:
        run(a, spark or session())
    except Exception as e:
        print(f"error: {e}", file=sys.stderr)
        return 1
    return 0


if __name__ == "__main__":
    sys.exit(main())
