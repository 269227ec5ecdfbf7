import json
import struct
import zlib
from types import SimpleNamespace

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from celltide import dataset
from celltide.functions import jsonvalues, regions, sqlexpr
from celltide.operators import entity, intervals, matrix, subset
from celltide.sources import text


def test_regions():
    assert regions.parse_region("chr1:1,000-2,000") == ("chr1", 1000, 2000)
    assert regions.parse_region("chr1:1M-2M") == ("chr1", 1_000_000, 2_000_000)
    for bad in ("chr1", "chr1:5-1", "x:y-z"):
        with pytest.raises(ValueError):
            regions.parse_region(bad)
    assert regions.chrom_to_int("chrX") == 23 and regions.int_to_chrom(25) == "chrM"


@pytest.mark.parametrize("value", [{"a": np.arange(3)}, [1, "x", None], np.array(["a", "b"]), np.float32([1, 2]), b"xy", 3.5, {"b": b"z"}, {"@array": "not one"}, np.array([[1.5, np.nan]])])
def test_json_round_trip(value):
    got = jsonvalues.unpack(json.loads(json.dumps(jsonvalues.pack(value))))
    assert repr(got) == repr(value)


def test_json_frames_and_errors():
    df = pd.DataFrame({"a": [1, 2]})
    assert jsonvalues.unpack(jsonvalues.pack(df)).equals(df) and jsonvalues.kind_of(jsonvalues.pack(df)) == "table"
    column = pd.Series([1.0, 2.0], index=["x", "y"], name="c")
    assert jsonvalues.unpack(jsonvalues.pack({"s": column}))["s"].equals(column)
    assert jsonvalues.unpack(jsonvalues.pack({"n": np.int64(3), "s": {2}})) == {"n": 3, "s": [2]}
    with pytest.raises(TypeError):
        jsonvalues.pack(object())


def test_dialect():
    t = sqlexpr.translate
    assert t("name LIKE 'a%'") == "name ILIKE 'a%'"
    assert t('"my col" == 3 / n', {"n"}) == "`my col` = 3 div n"
    assert t("a IS b AND c IS NOT NULL") == "a <=> b AND c IS NOT NULL"
    assert t("txt > 9", texts={"txt"}) == "txt > '9'"
    assert t("a IS NOT 3 AND b IS NOT NULL") == "a IS DISTINCT FROM 3 AND b IS NOT NULL"
    assert t('"a" == "it\'s"', columns={"a"}) == "`a` = 'it\\'s'"


def test_intervals(spark):
    f = spark.createDataFrame([("1", 100, 150), ("1", 160, 220), ("1", 300, 350), ("2", 5, 8)], "chrom string, start long, end_ long")
    assert intervals.in_region(f, "1", 140, 170).count() == 2
    assert intervals.in_region(f, "1", 150, 160).count() == 0
    m = spark.createDataFrame([("1", 10, 20), ("1", 15, 30), ("1", 30, 31), ("2", 5, 8), ("1", 90, 250)], "chrom string, start long, end_ long")
    assert sorted(map(tuple, intervals.merged(m, 100).collect())) == [("1", 10, 31, 3), ("1", 90, 250, 1), ("2", 5, 8, 1)]
    # one interval over all slices, and ends that touch a later slice
    rng = np.random.default_rng(3)
    rows = [("c", int(x), int(x + w)) for x, w in zip(rng.integers(0, 5000, 300), rng.integers(0, 12, 300), strict=True)] + [("c", 1500, 2600), ("d", 7, 9)]
    want, last = [], None
    for c, x, y in sorted(rows):
        if last and last[0] == c and x <= last[2]:
            last[2], last[3] = max(last[2], y), last[3] + 1
        else:
            last = [c, x, y, 1]
            want.append(last)
    m = spark.createDataFrame(rows, "chrom string, start long, end_ long")
    for size in (50, 10_000):
        assert sorted(map(list, intervals.merged(m, size).collect())) == sorted(want)
    a, b = (spark.range(60).select(F.lit("c").alias("chrom"), (F.col("id") * k % 101).alias("start"), (F.col("id") * k % 101 + F.col("id") % 7).alias("end_")) for k in (37, 53))
    x, y = a.collect(), b.collect()
    assert intervals.overlap_join(a, b, 5).count() == sum(p.start < q.end_ and p.end_ > q.start for p in x for q in y)


def test_matrix_against_dense(spark):
    rng = np.random.default_rng(1)
    m = rng.poisson(0.3, (40, 12))
    i, j = np.nonzero(m)
    coo = spark.createDataFrame(pd.DataFrame({"row_idx": i, "col_idx": j, "value": m[i, j].astype(float)}))

    def dense(df, n, k):
        out = np.zeros((n, k))
        for r in df.collect():
            out[r["row_idx"], r["col_idx"]] += r["value"]
        return out

    assert (dense(matrix.row_slice(coo, 5, 20), 15, 12) == m[5:20]).all()
    assert matrix.row_slice(coo, 0, -1).count() == 0
    assert (dense(matrix.columns(coo, [3, 1, 3]), 40, 3) == m[:, [3, 1, 3]]).all()
    assert (dense(matrix.slice_2d(coo, (2, 9), (-4, None), 40, 12), 7, 4) == m[2:9, -4:]).all()
    with pytest.raises(IndexError):
        matrix.one_row(coo, 40, 40)
    cells = spark.range(41).withColumnRenamed("id", "cell_idx")
    depth = dict(map(tuple, matrix.cell_depth(cells, coo).collect()))
    assert depth[40] == 0 and [depth[k] for k in range(40)] == m.sum(1).tolist()


def test_entity_and_sample(spark):
    c = spark.createDataFrame([(k, f"b{k % 3}", "A" if k % 4 else None) for k in range(40)], "cell_idx long, barcode string, g string")
    assert entity.keep(c, "cell_idx", spark.createDataFrame([(1,), (1,), (5,)], "cell_idx long")).count() == 2
    with pytest.raises(IndexError):
        entity.keep(c, "cell_idx", spark.createDataFrame([(99,)], "cell_idx long"))
    with pytest.raises(ValueError):
        entity.with_column(c, "cell_idx", "x", spark.createDataFrame([(0, 1)], "cell_idx long, value long"))
    one = [r[0] for r in subset.downsample(c, n=8, group="g").collect()]
    assert len(one) == 8 and one == sorted(one) and one == [r[0] for r in subset.downsample(c, n=8, group="g").collect()]


def test_text_sources(spark, tmp_path):
    (tmp_path / "m.mtx").write_text("%%MatrixMarket\n%\n3 2 3\n1 1 5\n3 1 2\n2 2 7\n")
    assert sorted(map(tuple, text.read_mtx(spark, f"{tmp_path}/m.mtx").collect())) == [(0, 0, 5.0), (0, 2, 2.0), (1, 1, 7.0)]
    (tmp_path / "f.tsv").write_text("# c\nchr1\t1\t5\tA\t2\nchr1\t3\t9\tB\n\nchrZ\t1\t2\tA\n")
    assert sorted(map(tuple, text.read_fragments(spark, f"{tmp_path}/f.tsv").collect())) == [("chr1", 1, 5, "A", 2), ("chr1", 3, 9, "B", 1), ("chrZ", 1, 2, "A", 1)]
    (tmp_path / "b.txt").write_text("A\nB\nA\n")
    assert text.read_barcodes(spark, f"{tmp_path}/b.txt").count() == 2


def make(spark, path, shift=0):
    ds = dataset.Dataset.create(spark, path)
    ds.set_entity("cells", spark.createDataFrame([(k, f"b{k}", "A" if k % 2 else "B") for k in range(6)], "cell_idx long, barcode string, kind string"))
    ds.set_entity("genes", spark.createDataFrame([(k, f"g{k + shift}") for k in range(3)], "gene_idx long, gene_id string"))
    ds.flush()
    ds.add_matrix("RNA_counts", spark.createDataFrame([(k, k % 3, float(k + 1)) for k in range(6)], "row_idx long, col_idx long, value double"), 6, 3)
    ds.flush()
    ds.metadata["x"] = {"a": 1}
    return ds


def test_dataset(spark, tmp_path):
    a = make(spark, f"{tmp_path}/a")
    with pytest.raises(FileExistsError):
        dataset.Dataset.create(spark, f"{tmp_path}/a")
    assert a.validate().ok and a.modalities == ["RNA"] and a.RNA.counts.shape == (6, 3)
    assert a.RNA.counts[1:3].count() == 2 and a.query("cells", "kind = 'A'").count() == 3
    kept = a.cells.where("kind = 'A'").select("cell_idx")
    s = a.subset(kept, f"{tmp_path}/s")
    assert s.n_cells == 3 and s.validate().ok
    assert sorted(map(tuple, s.layer("RNA_counts").df.collect())) == [(0, 1, 2.0), (1, 0, 4.0), (2, 2, 6.0)]
    b = make(spark, f"{tmp_path}/b", 1)
    m = dataset.merge([a, b], f"{tmp_path}/m")
    assert m.n_cells == 12 and m.n_genes == 4 and m.matrix_meta("RNA_counts")["n_cols"] == 4 and m.metadata.keys() == ["a:x", "b:x"]
    assert {r[1] for r in m.layer("RNA_counts").df.where("row_idx = 8").collect()} == {3}
    assert a.filter_cells(kept) == 3 and a.n_cells == 3
    assert dataset.Dataset.open(spark, f"{tmp_path}/a").n_cells == 3
    assert a.delete_matrix("rna%", like=True) == ["RNA_counts"]
    a.close()
    with pytest.raises(dataset.ClosedError):
        a.cells  # noqa: B018


def fragments_of(spark):
    return spark.createDataFrame([("chr1", 5, 25, 0, 1), ("chr1", 5, 25, 0, 1), ("chr1", 30, 41, 1, 1), ("chrU", 100, 130, 2, 1), ("chr2", 3, 9, 99, 1)], "chrom string, start long, end_ long, cell_idx long, dup_count int")


def test_flush_is_seen_whole(spark, tmp_path):
    a = make(spark, f"{tmp_path}/a")
    before = dataset.Dataset.open(spark, f"{tmp_path}/a")
    a._pending["entity/genes"] = a.genes.where("gene_idx < 1")
    a._pending["entity/cells"] = a.cells.withColumn("bad", F.raise_error(F.lit("stop")))
    with pytest.raises(Exception, match="stop"):
        a.flush()
    # one table was written before the other failed: nobody sees it
    again = dataset.Dataset.open(spark, f"{tmp_path}/a")
    assert before.genes.count() == again.genes.count() == 3 and again.n_cells == 6 and again.metadata["x"] == {"a": 1}
    with pytest.raises(ValueError):
        again.genome = "hg2"
    again.genome = "mm10"
    assert dataset.Dataset.open(spark, f"{tmp_path}/a").genome == "mm10"


def test_coverage_on_any_contig_and_bigwig(spark, tmp_path):
    a = make(spark, f"{tmp_path}/a")
    assert a.set_fragments(fragments_of(spark)) == {"chr1": 2, "chrU": 1, "chr2": 1}
    raw = {(r["group"], r["bin"]): r["value"] for r in a.coverage("kind", 10, "raw", "chrU:95-140").collect()}
    assert raw == {("B", 10): 1.0, ("B", 13): 1.0} and a.coverage("kind", 10, "raw", "chrU:95-125").count() == 2
    for _ in range(2):
        a.cache_coverage("kind", 10, "raw")
    assert a.get_cached_coverage("B", "chr1", 10, "raw", "kind").agg(F.sum("value")).first()[0] == 2
    a.export_coverage("kind", f"{tmp_path}/bw", 10, "raw", format="bigwig")
    data = (tmp_path / "bw/B.bw").read_bytes()
    magic, version, _, tree, full, index = struct.unpack("<IHHQQQ", data[:32])
    assert (magic, version) == (0x888FFC26, 4) and struct.unpack("<I", data[-4:])[0] == magic
    assert struct.unpack("<IIII", data[tree : tree + 16])[0] == 0x78CA8C91 and struct.unpack("<I", data[index : index + 4])[0] == 0x2468ACE0
    # the tree's leaves lead to the blocks
    is_leaf, _, n = struct.unpack("<BBH", data[index + 48 : index + 52])
    found = []
    for k in range(n):
        *_, at, size = struct.unpack("<IIIIQQ", data[index + 52 + 32 * k : index + 84 + 32 * k])
        block = zlib.decompress(data[at : at + size])
        found += [struct.unpack("<IIf", block[24 + 12 * i : 36 + 12 * i]) for i in range(struct.unpack("<H", block[22:24])[0])]
    assert is_leaf == 1 and struct.unpack("<Q", data[full : full + 8])[0] == n and sorted(found) == [(0, 10, 1.0), (20, 30, 1.0)]
    assert not a.validate().ok and "removed fragments of no cell" in a.repair() and a.validate().ok
    assert [(c, lo, df.count()) for c, lo, df in a.iter_fragments(20)] == [("chr1", 0, 1), ("chr1", 20, 1), ("chrU", 100, 1)]
    a.build_fragment_index(20)
    assert a.query_region("chr1:20-31").count() == 2


def test_bigwig_tree_of_several_levels(tmp_path, monkeypatch):
    from celltide.sources import bigwig

    monkeypatch.setattr(bigwig, "FAN", 3)
    rows = [("a", 2 * k, float(k + 1)) for k in range(20)] + [("z", 1, 2.0), ("q", 1, 2.0)]
    assert bigwig.write_bigwig(f"{tmp_path}/x.bw", rows, 10, {"a": 395, "q": 100}) == 21
    data = (tmp_path / "x.bw").read_bytes()
    index = struct.unpack("<Q", data[24:32])[0]

    def walk(at):
        leaf, _, n = struct.unpack("<BBH", data[at : at + 4])
        for k in range(n):
            if leaf:
                chrom, start, _, end, place, size = struct.unpack("<IIIIQQ", data[at + 4 + 32 * k : at + 36 + 32 * k])
                yield chrom, start, end, zlib.decompress(data[place : place + size])
            else:
                yield from walk(struct.unpack("<IIIIQ", data[at + 4 + 24 * k : at + 28 + 24 * k])[4])

    got = [(c, s, e, struct.unpack("<IIf", x[24:36])[2]) for c, s, e, x in walk(index + 48)]
    assert got == [(0, 20 * k, min(20 * k + 10, 395), k + 1.0) for k in range(20)] + [(1, 10, 20, 2.0)]


def folder_of(path, peaks=True, first="A"):
    path.mkdir()
    (path / "matrix.mtx").write_text("%%MatrixMarket matrix coordinate integer general\n%\n4 2 4\n1 1 5\n2 2 7\n3 1 1\n4 2 2\n")
    (path / "features.tsv").write_text("g1\tS1\tGene Expression\ng1\tS2\tGene Expression\nchr1:10-20\tchr1:10-20\tPeaks\nodd\todd\tPeaks\n")
    (path / "barcodes.tsv").write_text(f"{first}-1\nB-1\n")
    (path / "fragments.tsv").write_text("# x\nchr1\t1\t5\tB-1\t2\nchrU\t1\t5\tB-1\t2\nchr1\t3\t9\tnone\t1\n")


def test_folders_of_10x(spark, tmp_path):
    from celltide.sources import cellranger

    folder_of(tmp_path / "x")
    (tmp_path / "x/per_barcode_metrics.csv").write_text("barcode,is_cell,n\nA-1,1,30\n")
    (tmp_path / "x/atac_peaks.bed").write_text("# a\nchr1\t10\t20\nchr2\t1\t2\n")
    (tmp_path / "x/atac_peak_annotation.tsv").write_text("chrom\tstart\tend\tgene\tdistance\tpeak_type\nchr2\t1\t2\tS9\t-5\tdistal\n")
    ds = cellranger.from_cellranger_arc(spark, f"{tmp_path}/x", f"{tmp_path}/d", "s")
    assert ds.modalities == ["RNA", "ATAC"] and [r["gene_id"] for r in ds.genes.orderBy("gene_idx").collect()] == ["g1", "g1-1"]
    assert sorted(map(tuple, ds.layer("ATAC_counts").df.collect())) == [(0, 0, 1.0), (1, 1, 2.0)]
    assert [(r["peak_id"], r["nearest_gene"], r["distance_to_tss"]) for r in ds.peaks.orderBy("peak_idx").collect()] == [("chr1:10-20", None, None), ("chr2:1-2", "S9", -5)]
    assert [(r["n"], r["n_fragments"]) for r in ds.cells.orderBy("cell_idx").collect()] == [("30", 0), (None, 1)]
    folder_of(tmp_path / "y", first="C")
    two = cellranger.from_cellranger(spark, [f"{tmp_path}/x", f"{tmp_path}/y"], f"{tmp_path}/m", modalities=["RNA"], import_fragments=False)
    assert two.n_cells == 4 and two.modalities == ["RNA"] and sorted(r[0] for r in two.layer("RNA_counts").df.select("row_idx").collect()) == [0, 1, 2, 3]
    with pytest.raises(FileNotFoundError):
        cellranger.from_cellranger(spark, f"{tmp_path}/none", f"{tmp_path}/n")


def test_group_of_a_10x_file(spark, tmp_path):
    from celltide.sources import cellranger

    rng = np.random.default_rng(0)
    dense = rng.poisson(0.7, (7, 5))  # cells by features
    i, j = np.nonzero(dense)
    text = lambda xs: np.array([x.encode() for x in xs])
    group = {
        "data": dense[i, j], "indices": j, "indptr": np.concatenate([[0], np.cumsum((dense > 0).sum(1))]), "shape": np.array([5, 7]), "barcodes": text([f"b{k}" for k in range(7)]),
        "features": {"id": text(["g0", "g1", "chr1:1-2", "g2", "chr1:5-9"]), "name": text(["a", "b", "p", "c", "q"]), "feature_type": text(["Gene Expression", "Gene Expression", "Peaks", "Gene Expression", "Peaks"])},
    }
    ds = cellranger.from_10x_group(spark, group, f"{tmp_path}/d", batch=6)
    for name, cols in (("RNA_counts", [0, 1, 3]), ("ATAC_counts", [2, 4])):
        got = np.zeros((7, len(cols)))
        for r in ds.layer(name).df.collect():
            got[r["row_idx"], r["col_idx"]] += r["value"]
        assert (got == dense[:, cols]).all() and ds.layer(name).shape == got.shape
    assert ds.peaks.where("start = 5 and end_ = 9").count() == 1


def test_annotated_matrix_and_back(spark, tmp_path):
    from celltide.sources import anndata

    x = np.array([[1.0, 0, 2], [0, 0, 3], [4, 5, 0], [0, 0, 0]], np.float32)
    obs = pd.DataFrame({"kind": pd.Categorical(["b", "a", None, "b"], ["b", "a"]), "n": [1, 2, 3, 4]}, index=["c0", "c1", "c2", "c3"])
    var = pd.DataFrame({"gene_name": ["s", "t", "u"]}, index=["g", "g", "h"])
    adata = SimpleNamespace(obs=obs, var=var, X=x, layers={"log": x * 2}, obsm={"X_pca": np.arange(8.0).reshape(4, 2)}, varm={}, obsp={"near": np.eye(4)}, varp={}, uns={"k": {"a": np.arange(2)}, "f": print})
    with pytest.warns(UserWarning, match="f isn't kept"):
        ds = anndata.from_anndata(spark, adata, f"{tmp_path}/d")
    assert ds.get_categories("kind")["categories"] == ["b", "a"] and [r["symbol"] for r in ds.genes.orderBy("gene_idx").collect()] == ["s", "t", "u"]
    assert ds.list_embeddings() == ["X_pca"] and ds.graph("near").count() == 4 and ds.validate().ok and (ds.metadata["k"]["a"] == np.arange(2)).all()
    got = anndata.collected(ds, cells=ds.cells.where("n > 1").select("cell_idx"))
    dense = np.zeros(got["shape"])
    dense[got["X"][0], got["X"][1]] = got["X"][2]
    assert (dense == x[1:]).all() and got["X"][2].dtype == np.float32 and list(got["obs"].index) == ["c1", "c2", "c3"] and (got["obsm"]["X_pca"] == np.arange(8.0).reshape(4, 2)[1:]).all() and set(got["layers"]) == {"log"}
    adata.obs["extra"] = [1.0, 2.0, 3.0, 4.0]
    adata.layers, adata.obsm = {"more": x + 1}, {}
    anndata.update_from_anndata(ds, adata)
    assert ds.cells.where("extra = 4").count() == 1 and ds.layer("RNA_more").df.count() == 12
    rows = list(ds.batches(obs_columns=["n"], batch_size=3))
    assert [len(b["row_idx"]) for b in rows] == [3, 1] and (np.concatenate([b["X"] for b in rows]) == x).all() and rows[1]["n"] == [4]
    both = SimpleNamespace(obs=pd.DataFrame(index=obs.index), mod={"rna": adata, "atac": SimpleNamespace(obs=obs, var=pd.DataFrame(index=["chr1:1-5", "chr1:7-9"]), X=x[:, :2], obsm={"X_lsi": np.ones((4, 2))})})
    with pytest.warns(UserWarning):
        two = anndata.from_mudata(spark, both, f"{tmp_path}/m")
    assert two.modalities == ["RNA", "ATAC"] and two.list_embeddings() == ["lsi"] and two.peaks.where("start = 7").count() == 1
    with pytest.warns(UserWarning, match="graphs"):
        s = ds.subset(ds.cells.where("n > 2").select("cell_idx"), f"{tmp_path}/s")
    assert s.n_cells == 2 and s.embedding("X_pca").count() == 2


def test_stream_import(spark, tmp_path):
    from celltide.streaming.fragments import import_stream

    (tmp_path / "in").mkdir()
    cells = spark.createDataFrame([(0, "A"), (1, "B")], "cell_idx long, barcode string")
    for k in range(2):
        (tmp_path / f"in/{k}.tsv").write_text(f"chr1\t{k}\t9\tA\t1\nchr2\t{k}\t9\tB\t1\nchr2\t{k}\t9\tnone\t1\n")
        import_stream(spark, f"{tmp_path}/in", cells, f"{tmp_path}/out", f"{tmp_path}/at").awaitTermination()
        assert spark.read.parquet(f"{tmp_path}/out").count() == 2 * (k + 1)
