from celltide import dataset
from celltide.cli import main


def test_commands(spark, tmp_path, capsys):
    (tmp_path / "b.txt").write_text("A\nB\nC\n")
    p = str(tmp_path)
    assert main(["init", "--barcodes", f"{p}/b.txt", "-o", f"{p}/d", "--sample-id", "s"], spark) == 0
    assert main(["subset", f"{p}/d", "-o", f"{p}/e", "--query", "barcode != 'B'"], spark) == 0
    assert main(["validate", f"{p}/e"], spark) == 0 and "PASSED" in capsys.readouterr().out
    assert main(["subset", f"{p}/d", "-o", f"{p}/f"], spark) == 1
    assert main(["copy", f"{p}/e", f"{p}/g"], spark) == 0 and main(["info", f"{p}/g", "--json"], spark) == 0
    assert '"n_cells": 2' in capsys.readouterr().out


def test_merge_intersects_genes_only(spark, tmp_path):
    p = str(tmp_path)
    for name, shift in (("a", 0), ("b", 1)):
        ds = dataset.Dataset.create(spark, f"{p}/{name}")
        ds.set_entity("cells", spark.createDataFrame([(0, f"{name}0")], "cell_idx long, barcode string"))
        ds.set_entity("genes", spark.createDataFrame([(k, f"g{k + shift}") for k in range(2)], "gene_idx long, gene_id string"))
        ds.set_entity("peaks", spark.createDataFrame([(k, f"p{k + shift}", "chr1", 10 * (k + shift), 10 * (k + shift) + 5) for k in range(2)], "peak_idx long, peak_id string, chr string, start long, end_ long"))
        ds.close()
    assert main(["merge", f"{p}/a", f"{p}/b", "-o", f"{p}/m"], spark) == 0
    m = dataset.Dataset.open(spark, f"{p}/m")
    assert {r["gene_id"] for r in m.entity("genes").collect()} == {"g1"}
    assert {r["peak_id"] for r in m.entity("peaks").collect()} == {"p0", "p1", "p2"}
