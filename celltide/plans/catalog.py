"""One query for each operator over the test tables, mapped to cells, features, counts and fragments, and its SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import regions as R
from ..operators import annotation, entity, fragments, graph, intervals, matrix, setops, subset, validation

QUERIES: dict = {}
SQL: dict[str, str] = {}


def query(sql: str | None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql is not None:
            SQL[f.__name__] = _VIEWS + sql
        return f

    return add


#: The same mapping as SQL views.
_VIEWS = """with cells as (select c_custkey as cell_idx, c_name as barcode, c_nationkey as sample_id, c_mktsegment as cell_type, c_acctbal as total from customer),
genes as (select p_partkey as gene_idx, 'G' || p_partkey as gene_id, p_name as symbol, p_type as biotype, p_size as size from part),
hits as (select o_custkey as row_idx, l_partkey as col_idx, l_quantity as value, l_returnflag as flag from lineitem join orders on l_orderkey = o_orderkey),
coo as (select row_idx, col_idx, sum(value) as value from hits group by 1, 2),
f0 as (select event_type as chrom, (epoch_us(ts) - epoch_us(timestamp '2024-01-01')) // 1000000 as start, user_id as cell_idx, value, event_id from events),
frags as (select chrom, start, start + 1 + floor(value)::bigint as end_, cell_idx, 1 as dup_count, event_id from f0),
wide as (select row_number() over (order by event_id) as region, chrom, start, start + 7200 as end_ from frags)
"""


def _t(spark: SparkSession, d: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{d}/{name}.parquet")


def cells(spark, d):
    return _t(spark, d, "customer").select(F.col("c_custkey").alias("cell_idx"), F.col("c_name").alias("barcode"), F.col("c_nationkey").alias("sample_id"), F.col("c_mktsegment").alias("cell_type"), F.col("c_acctbal").alias("total"))


def genes(spark, d):
    return _t(spark, d, "part").select(F.col("p_partkey").alias("gene_idx"), F.concat(F.lit("G"), F.col("p_partkey")).alias("gene_id"), F.col("p_name").alias("symbol"), F.col("p_type").alias("biotype"), F.col("p_size").alias("size"))


def hits(spark, d):
    line = _t(spark, d, "lineitem").select("l_orderkey", F.col("l_partkey").alias("col_idx"), F.col("l_quantity").alias("value"), F.col("l_returnflag").alias("flag"))
    orders = _t(spark, d, "orders").select(F.col("o_orderkey").alias("l_orderkey"), F.col("o_custkey").alias("row_idx"))
    return line.join(orders, "l_orderkey").select("row_idx", "col_idx", "value", "flag")


def coo(spark, d):
    return matrix.summed(hits(spark, d))


def frags(spark, d):
    start = F.expr("(unix_micros(cast(ts as timestamp)) - 1704067200000000) div 1000000")
    e = _t(spark, d, "events").select(F.col("event_type").alias("chrom"), start.alias("start"), F.floor("value").alias("len"), F.col("user_id").alias("cell_idx"), "event_id")
    return e.select("chrom", "start", (F.col("start") + 1 + F.col("len")).alias("end_"), "cell_idx", F.lit(1).alias("dup_count"), "event_id")


def wide(spark, d):
    """A region of a fixed width at every fragment; its number is the place of the fragment's event."""
    f = matrix.ordinal(frags(spark, d), "event_id", "n")
    return f.select((F.col("n") + 1).alias("region"), "chrom", "start", (F.col("start") + 7200).alias("end_"))


@query("select * from cells where cell_type ilike 'build%' and sample_id in (1, 2, 3) and total > 0")
def entity_query(spark, d):
    return entity.query(cells(spark, d), "cell_type LIKE 'build%' AND sample_id IN (1, 2, 3) AND \"total\" > 0")


@query("select cell_idx, coalesce(total > 5000 and sample_id // 2 = 3, false) as mask from cells")
def entity_query_mask(spark, d):
    return entity.query_mask(cells(spark, d), "total > 5000 AND sample_id / 2 == 3", "cell_idx")


@query("select cell_idx, cell_type from cells")
def entity_column(spark, d):
    return entity.column(cells(spark, d), "cell_type", "cell_idx")


@query("select row_idx - 100 as row_idx, col_idx, value from coo where row_idx >= 100 and row_idx < 140")
def matrix_row_slice(spark, d):
    return matrix.row_slice(coo(spark, d), 100, 140)


@query("select row_idx, col_idx, value from coo where row_idx in (select cell_idx from cells where cell_type = 'BUILDING')")
def matrix_row_set(spark, d):
    return matrix.row_set(coo(spark, d), cells(spark, d).where("cell_type = 'BUILDING'").select(F.col("cell_idx").alias("row_idx")))


@query("select row_idx, col_idx, value from coo where col_idx = 7")
def matrix_column(spark, d):
    return matrix.columns(coo(spark, d), [7]).withColumn("col_idx", F.lit(7))


@query("select row_idx, i as col_idx, value from coo join (values (9, 0), (3, 1), (9, 2)) c(col, i) on col_idx = col")
def matrix_columns(spark, d):
    return matrix.columns(coo(spark, d), [9, 3, 9])


@query("select row_idx - 10 as row_idx, col_idx - 20 as col_idx, value from coo where row_idx between 10 and 49 and col_idx between 20 and 119")
def matrix_2d_slice(spark, d):
    return matrix.slice_2d(coo(spark, d), (10, 50), (20, 120), 10**9, 10**9)


@query("select cell_idx, coalesce(s.value, 0.0)::double as value from cells left join (select * from coo where col_idx = 5) s on row_idx = cell_idx")
def matrix_dense_column(spark, d):
    return matrix.dense_column(cells(spark, d), coo(spark, d), 5)


@query("select cell_idx, coalesce(sum(case when col_idx = 5 then value end), 0.0)::double as f0, coalesce(sum(case when col_idx = 2 then value end), 0.0)::double as f1 from cells left join coo on row_idx = cell_idx group by cell_idx")
def matrix_dense_columns(spark, d):
    return matrix.dense_columns(cells(spark, d), coo(spark, d), [5, 2])


@query("select row_idx, col_idx, value from coo")
def matrix_to_coo_sum(spark, d):
    return coo(spark, d)


@query("select row_idx, col_idx, count(*)::bigint as value from hits group by 1, 2")
def matrix_hit_counts(spark, d):
    return matrix.counted(hits(spark, d), "row_idx", "col_idx")


@query("select row_idx, col_idx, 1::bigint as value from hits group by 1, 2")
def matrix_binary(spark, d):
    return matrix.counted(hits(spark, d), "row_idx", "col_idx", binary=True)


@query("select cell_idx, coalesce(s.depth, 0.0)::double as depth from cells left join (select row_idx, sum(value) as depth from coo group by 1) s on row_idx = cell_idx")
def cell_depth(spark, d):
    return matrix.cell_depth(cells(spark, d), coo(spark, d))


@query("select col_idx, sum(value)::double as total, count(*) as n_cells from coo group by 1")
def gene_totals(spark, d):
    return matrix.feature_totals(coo(spark, d))


@query("select count(*) as nnz, count(*) filter (value = 0) as zeros, count(distinct row_idx) as rows_used, count(distinct col_idx) as cols_used from coo")
def nnz_stats(spark, d):
    return matrix.stats(coo(spark, d))


@query("select col_idx, count(*) as n, sum(value)::double as total, max(row_idx) as last_row from coo group by 1")
def csc_feature_scan(spark, d):
    return matrix.feature_index(coo(spark, d), 8).groupBy("col_idx").agg(F.count("*").alias("n"), F.sum("value").alias("total"), F.max("row_idx").alias("last_row"))


@query("select row_idx // 256 as batch, row_idx, count(*) as n, sum(value)::double as total from coo group by 1, 2")
def chunk_batches(spark, d):
    c = matrix.chunks(coo(spark, d), batch=256)
    return c.select("batch", "row_idx", F.size("entries").cast("long").alias("n"), F.aggregate("entries", F.lit(0.0), lambda a, x: a + x["value"]).alias("total"))


@query("select vec_id - 10 as row_idx, list_transform(embedding[3:10], lambda x: round(x::double, 5)) as vector from embeddings where vec_id >= 10 and vec_id < 60")
def embedding_slice(spark, d):
    e = _t(spark, d, "embeddings").select(F.col("vec_id").alias("row_idx"), F.col("embedding").alias("vector"))
    return graph.vector_slice(e, (10, 60), (2, 10)).withColumn("vector", F.transform("vector", lambda x: F.round(x.cast("double"), 5)))


@query("select vec_id as row_idx, label from embeddings where vec_id in (3, 5, 8)")
def embedding_rows(spark, d):
    return matrix.row_set(_t(spark, d, "embeddings").withColumnRenamed("vec_id", "row_idx"), [3, 5, 8]).select("row_idx", "label")


@query("select vec_id as row_idx, generate_subscripts(embedding, 1) - 1 as col_idx, round(unnest(embedding)::double, 5) as value from embeddings")
def embedding_coo(spark, d):
    e = _t(spark, d, "embeddings").select(F.col("vec_id").alias("row_idx"), F.col("embedding").alias("vector"))
    return graph.vector_coo(e).withColumn("value", F.round(F.col("value").cast("double"), 5))


@query("select chrom, start, end_, cell_idx from frags where chrom = 'click' and start < 90000 and end_ > 50000")
def frag_region(spark, d):
    return intervals.in_region(frags(spark, d), "click", 50_000, 90_000).select("chrom", "start", "end_", "cell_idx")


@query("select region, f.chrom, f.start, f.end_, f.cell_idx from frags f join wide r on f.chrom = r.chrom and f.start < r.end_ and f.end_ > r.start")
def frag_regions_join(spark, d):
    return intervals.in_regions(frags(spark, d), wide(spark, d)).select("region", "chrom", "start", "end_", "cell_idx")


@query("select f.event_id, f.chrom, r.region from frags f join wide r on f.chrom = r.chrom and f.start < r.end_ and f.end_ > r.start")
def frag_overlap_binned(spark, d):
    return intervals.overlap_join(frags(spark, d), wide(spark, d), 3600).select("event_id", "chrom", "region")


@query("select chrom, start, end_, cell_idx from frags where cell_idx in (select cell_idx from cells where cell_type = 'MACHINERY')")
def frag_cells_semi(spark, d):
    return intervals.of_cells(frags(spark, d), cells(spark, d).where("cell_type = 'MACHINERY'")).select("chrom", "start", "end_", "cell_idx")


@query("select event_id, cell_idx from frags where cell_idx not in (select cell_idx from cells where sample_id < 20)")
def frag_cells_anti(spark, d):
    return validation.orphans(frags(spark, d), cells(spark, d).where("sample_id < 20"), "cell_idx").select("event_id", "cell_idx")


@query("select distinct chrom, (start // 600) * 600 as start, cell_idx from frags")
def frag_dedup(spark, d):
    f = frags(spark, d).withColumn("start", F.expr("(start div 600) * 600")).withColumn("end_", F.col("start") + 600)
    return fragments.deduplicated(f).select("chrom", "start", "cell_idx")


@query("select chrom, count(*) as n_fragments, min(start) as min_start, max(end_) as max_end from frags group by 1")
def frag_meta(spark, d):
    return fragments.meta(frags(spark, d))


@query("select c.cell_idx, barcode, coalesce(n, 0) as n_fragments from cells c left join (select cell_idx, count(*) as n from frags group by 1) using (cell_idx)")
def frag_per_cell(spark, d):
    return fragments.per_cell(cells(spark, d), frags(spark, d)).select("cell_idx", "barcode", "n_fragments")


@query("select distinct chrom from frags")
def chrom_list(spark, d):
    return fragments.chromosomes(frags(spark, d))


_TILES = ", tiles as (select cell_idx, chrom, unnest(generate_series(start // 500, greatest(end_ - 1, start) // 500)) as bin from frags) "


@query(_TILES + "select cell_idx, chrom, bin, count(*)::bigint as n from tiles group by all")
def tile_counts(spark, d):
    return fragments.tile_counts(frags(spark, d), 500)


@query(_TILES + "select cell_idx, chrom, bin, 1::bigint as n from tiles group by all")
def tile_binary(spark, d):
    return fragments.tile_counts(frags(spark, d), 500, binary=True)


@query(""", s as (select chrom, min(start) // 5000 as lo, max(greatest(end_ - 1, start)) // 5000 as hi from frags group by 1),
b as (select *, sum(hi - lo + 1) over (order by chrom) - (hi - lo + 1) as before from s), x as (select *, unnest(generate_series(lo, hi)) as k from b)
select (before + k - lo)::bigint as tile_idx, chrom || ':' || (k * 5000 + 1) || '-' || ((k + 1) * 5000) as tile_id, chrom as chr, k * 5000 as start, (k + 1) * 5000 as end_ from x""")
def tile_axis(spark, d):
    return fragments.tile_axis(frags(spark, d), 5000)


_COVER = """, p as (select cell_type as g, chrom, unnest([start, end_]) as pos from frags join cells using (cell_idx)),
n as (select g, chrom, greatest(pos // 3600, 0) as bin, count(*) as n from p group by all), tot as (select cell_type as g, count(*) as total from frags join cells using (cell_idx) group by 1) """


def _coverage(spark, d, normalize, **kw):
    out = fragments.coverage(frags(spark, d), cells(spark, d), "cell_type", 3600, normalize, **kw)
    return out.withColumn("value", F.round("value", 4))


@query(_COVER + 'select g as "group", chrom, bin, n::double as value from n')
def coverage_raw(spark, d):
    return _coverage(spark, d, "raw")


@query(_COVER + 'select n.g as "group", chrom, bin, round(n / (total / 1e6), 4) as value from n join tot on n.g = tot.g')
def coverage_cpm(spark, d):
    return _coverage(spark, d, "cpm")


@query(_COVER + 'select n.g as "group", chrom, bin, round(n / (total / 1e6) / 3.6, 4) as value from n join tot on n.g = tot.g')
def coverage_rpkm(spark, d):
    return _coverage(spark, d, "rpkm")


@query(_COVER + ", tc as (select cell_type as g, count(*) as total from frags join cells using (cell_idx) where chrom = 'view' group by 1) "
       "select n.g as \"group\", chrom, bin, round(n / (total / 1e6), 4) as value from n join tc on n.g = tc.g where chrom = 'view' and bin >= 100000 // 3600 and bin < 56")  # fmt: skip
def coverage_region(spark, d):
    return _coverage(spark, d, "cpm", region=("view", 100_000, 200_000))


@query(""", a as (select *, max(end_) over (partition by chrom order by start, end_ rows between unbounded preceding and 1 preceding) as pm from frags),
b as (select *, sum(case when pm is null or start > pm then 1 else 0 end) over (partition by chrom order by start, end_ rows unbounded preceding) as g from a)
select chrom, min(start) as start, max(end_) as end_, count(*) as n from b group by chrom, g""")
def merge_regions(spark, d):
    return intervals.merged(frags(spark, d), slice_size=86_400).withColumn("n", F.col("n").cast("long"))


@query("select region, chrom, greatest(start - 1000, 0) as start, end_ + 500 as end_ from wide")
def extend_regions(spark, d):
    return wide(spark, d).select("region", "chrom", *R.extended(F.col("start"), F.col("end_"), 1000, 500))


@query("select a.region as a, b.region as b from wide a join wide b on a.chrom = b.chrom and a.start < b.end_ and a.end_ > b.start and a.region < b.region")
def regions_overlap_pairs(spark, d):
    a = wide(spark, d)
    return intervals.overlap_join(a, a, 7200).where("region < b_region").select(F.col("region").alias("a"), F.col("b_region").alias("b"))


@query("select region, chrom, start, end_ from wide")
def parse_region(spark, d):
    text = F.concat("chrom", F.lit(":"), F.format_number("start", 0), F.lit("-"), F.col("end_").cast("string"))
    return wide(spark, d).select("region", text.alias("text")).select("region", *R.region_columns(F.col("text")))


@query("select gene_idx, case when gene_idx % 3 = 0 then null else 'chr' || (gene_idx % 5) end as chr, case when gene_idx % 3 = 0 then null else gene_idx * 100 end as start, case when gene_idx % 3 = 0 then null else gene_idx * 100 + 50 end as end_ from genes")
def parse_peak_id(spark, d):
    g = genes(spark, d)
    i = F.col("gene_idx")
    name = F.when(i % 3 == 0, F.col("gene_id")).otherwise(F.concat(F.lit("chr"), (i % 5).cast("string"), F.lit(":"), (i * 100).cast("string"), F.lit("-"), (i * 100 + 50).cast("string")))
    return g.select("gene_idx", *R.feature_columns(name))


@query("select gene_idx, regexp_replace(biotype, '[^A-Za-z0-9_-]', '_', 'g') as name from genes")
def safe_names(spark, d):
    return genes(spark, d).select("gene_idx", R.safe_name(F.col("biotype")).alias("name"))


def _halves(spark, d):
    c = cells(spark, d)
    return [c.where("sample_id % 2 = 0").drop("total"), c.where("sample_id % 2 = 1")]


@query("""select row_number() over (order by sample_id % 2, cell_idx) - 1 as cell_idx, barcode, sample_id, cell_type, case when sample_id % 2 = 1 then total end as total, 's' || (sample_id % 2) as batch from cells""")
def merge_cells_union(spark, d):
    return setops.merge_cells(_halves(spark, d), ["s0", "s1"], "batch")


@query("""select row_number() over (order by sample_id % 2, cell_idx) - 1 as cell_idx, barcode, sample_id, cell_type, 's' || (sample_id % 2) as batch from cells""")
def merge_obs_shared(spark, d):
    return setops.merge_cells(_halves(spark, d), ["s0", "s1"], "batch", "shared")


def _axes(spark, d):
    g = genes(spark, d)
    return [g.where("size <= 30"), g.where("size >= 20")]


@query("select row_number() over (order by gene_id) - 1 as new_col, gene_id as id from genes")
def feature_union(spark, d):
    return setops.merge_features(_axes(spark, d), "gene_id")


@query("select row_number() over (order by gene_id) - 1 as new_col, gene_id as id from genes where size between 20 and 30")
def feature_intersection(spark, d):
    return setops.merge_features(_axes(spark, d), "gene_id", "intersection")


def _projected(spark, d, strategy):
    own = genes(spark, d).select(F.col("gene_idx").alias("col_idx"), F.col("symbol").alias("id"), "size")
    sides = [own.where("size <= 30"), own.where("size >= 20")]
    axis = setops.merge_features([x.withColumnRenamed("id", "name") for x in sides], "name", strategy)
    return setops.merge_matrices([(coo(spark, d), x.select("col_idx", "id"), at) for x, at in zip(sides, (0, 1_000_000), strict=True)], axis)


_PROJECT = """, axis as (select row_number() over (order by symbol) - 1 as new_col, symbol from (select distinct symbol from genes where {})),
two as (select row_idx, col_idx, value, symbol from coo join genes on gene_idx = col_idx where size <= 30 union all select row_idx + 1000000, col_idx, value, symbol from coo join genes on gene_idx = col_idx where size >= 20)
select row_idx, new_col as col_idx, sum(value)::double as value from two join axis using (symbol) group by 1, 2"""


@query(_PROJECT.format("true"))
def project_union(spark, d):
    return _projected(spark, d, "union")


@query(_PROJECT.format("symbol in (select symbol from genes where size <= 30) and symbol in (select symbol from genes where size >= 20)"))
def project_intersection(spark, d):
    return _projected(spark, d, "intersection")


@query("select chrom, start, end_, cell_idx from frags where cell_idx < 50 union all select chrom, start, end_, cell_idx + 5000 from frags where cell_idx >= 50")
def merge_fragments_offset(spark, d):
    f = frags(spark, d).select("chrom", "start", "end_", "cell_idx")
    return setops.merge_fragments([(f.where("cell_idx < 50"), 0), (f.where("cell_idx >= 50"), 5000)])


@query("select 'a:' || gene_id as key, symbol as value from genes union all select 'b:' || gene_id, symbol from genes")
def merge_metadata_prefix(spark, d):
    m = genes(spark, d).select(F.col("gene_id").alias("key"), F.col("symbol").alias("value"))
    return setops.merge_metadata([m, m], ["a", "b"])


@query("select symbol, gene_idx from (select *, row_number() over (partition by symbol order by size > 30, gene_idx) as n from genes where size <= 30 or size >= 20) where n = 1")
def first_seen_features(spark, d):
    return setops.first_seen([g.select("gene_idx", "symbol") for g in _axes(spark, d)], "gene_idx", "symbol").select("symbol", "gene_idx")


@query("select gene_idx, case when n > 0 then symbol || '-' || n else symbol end as symbol from (select *, row_number() over (partition by symbol order by gene_idx) - 1 as n from genes)")
def make_unique_ids(spark, d):
    return entity.unique_ids(genes(spark, d).select("gene_idx", "symbol"), "symbol", "gene_idx")


@query("select symbol, count(*) as n from genes group by 1 having count(*) > 1")
def duplicate_symbols(spark, d):
    return entity.repeated(genes(spark, d), "symbol")


def _kept(spark, d):
    return matrix.reindexed(cells(spark, d).where("cell_type = 'BUILDING'"), "cell_idx")


_KEPT = ", kept as (select cell_idx as old_idx, row_number() over (order by cell_idx) - 1 as new_idx from cells where cell_type = 'BUILDING') "


@query(_KEPT + "select old_idx, new_idx from kept")
def subset_cells_reindex(spark, d):
    return _kept(spark, d)


@query(_KEPT + "select new_idx as row_idx, col_idx, value from coo join kept on row_idx = old_idx")
def subset_matrix(spark, d):
    return subset.remap(coo(spark, d), _kept(spark, d), "row_idx")


@query(_KEPT + "select chrom, start, end_, new_idx as cell_idx from frags join kept on cell_idx = old_idx")
def subset_fragments(spark, d):
    return subset.remap(frags(spark, d).select("chrom", "start", "end_", "cell_idx"), _kept(spark, d), "cell_idx")


@query(_KEPT + "select new_idx as cell_idx, total as x, total * 10 as y from cells join kept on cell_idx = old_idx")
def subset_spatial(spark, d):
    return subset.remap(cells(spark, d).select("cell_idx", F.col("total").alias("x"), (F.col("total") * 10).alias("y")), _kept(spark, d), "cell_idx")


@query('select cell_type as "group", count(*) as size, least(greatest(1, round_even(100 * (count(*)::double / (select count(*) from cells)), 0)::bigint), count(*)) as n from cells group by 1')
def downsample_stratified_sizes(spark, d):
    return subset.stratum_sizes(cells(spark, d), "cell_type", 100)


@query(""", st as (select cell_type, least(greatest(1, round_even(50 * (count(*)::double / (select count(*) from cells)), 0)::bigint), count(*)) as n from cells group by 1),
r as (select cell_idx, cell_type, md5('42:' || cell_idx) as h, row_number() over (partition by cell_type order by md5('42:' || cell_idx)) as k from cells)
select cell_idx from (select cell_idx, h from r join st using (cell_type) where k <= n order by h limit 50)""")
def downsample_stratified(spark, d):
    return subset.downsample(cells(spark, d), n=50, group="cell_type")


_EDGES = ", edges as (select o_custkey as row_idx, l_suppkey as col_idx, sum(l_quantity) as value from lineitem join orders on l_orderkey = o_orderkey group by 1, 2) "


def _edges(spark, d):
    line, orders = _t(spark, d, "lineitem"), _t(spark, d, "orders")
    x = line.join(orders, line["l_orderkey"] == orders["o_orderkey"]).groupBy(F.col("o_custkey").alias("row_idx"), F.col("l_suppkey").alias("col_idx"))
    return graph.edges(x.agg(F.sum("l_quantity").alias("value")))


@query(_EDGES + "select row_idx, col_idx, value::double as value from edges")
def graph_edges(spark, d):
    return _edges(spark, d).withColumn("value", F.col("value").cast("double"))


@query(_EDGES + "select row_idx, count(*) as degree, sum(value)::double as weight from edges group by 1")
def graph_degree(spark, d):
    return graph.degree(_edges(spark, d))


@query("select event_id, json_extract(props, '$.k')::bigint as k from events")
def metadata_json_get(spark, d):
    return _t(spark, d, "events").select("event_id", F.get_json_object("props", "$.k").try_cast("long").alias("k"))


def _gtf(spark, d):
    """Annotation lines built of the features: a gene, a transcript and an exon of each."""
    g = genes(spark, d).select("gene_idx", "gene_id", "symbol", "biotype", "size", F.explode(F.array(F.lit("gene"), F.lit("transcript"), F.lit("exon"))).alias("feature"))
    start, i = F.col("gene_idx") * 1000 + 1, F.col("gene_idx")
    attr = F.concat(F.lit('gene_id "'), "gene_id", F.lit('"; gene_name "'), "symbol", F.lit('"; gene_type "'), "biotype", F.lit('"; transcript_id "T'), i.cast("string"), F.lit('"; tag "t'), (F.col("size") % 3).cast("string"), F.lit('";'))
    value = F.concat_ws("\t", F.concat(F.lit("chr"), (i % 4).cast("string")), F.lit("made"), "feature", start.cast("string"), (start + 499).cast("string"), F.lit("."), F.lit("+"), F.lit("."), attr)
    rank = F.when(F.col("feature") == "gene", 0).when(F.col("feature") == "transcript", 1).otherwise(2)
    return annotation.parse_gtf(g.select((i * 3 + rank).alias("line"), value.alias("value")))


_GTF = ", g as (select *, 'chr' || (gene_idx % 4) as chrom, gene_idx * 1000 as start, gene_idx * 1000 + 500 as \"end\" from genes) "


@query(_GTF + "select gene_id, chrom, start, \"end\", '+' as strand, symbol as gene_name, biotype as gene_type, 'made' as source from g")
def gtf_parse(spark, d):
    return annotation.genes(_gtf(spark, d))


@query(_GTF + "select gene_id, start from g where chrom = 'chr1' and start < 500000 and \"end\" > 100000")
def gtf_query_genes(spark, d):
    return annotation.query_genes(annotation.genes(_gtf(spark, d)), "chr1", 100_000, 500_000).select("gene_id", "start")


@query(_GTF + "select gene_id, feature from g, (values ('transcript'), ('exon')) x(feature) where biotype like 'PROMO%'")
def gtf_biotype_cascade(spark, d):
    p = _gtf(spark, d)
    return annotation.children(p, ["gene", "transcript", "exon"], annotation.genes(p).where("gene_type like 'PROMO%'")).select("gene_id", "feature")


@query(_GTF + "select gene_id, feature from g, (values ('transcript'), ('exon')) x(feature) where size % 3 = 1")
def gtf_tag_cascade(spark, d):
    return annotation.children(_gtf(spark, d), ["transcript", "exon"], tags=["t1"]).select("gene_id", "feature")


@query("select cell_idx, barcode, m.n as n_orders from cells left join (select o_custkey, count(*) as n from orders where o_orderstatus = 'P' group by 1) m on o_custkey = cell_idx")
def arc_left_join_metrics(spark, d):
    m = _t(spark, d, "orders").where("o_orderstatus = 'P'").groupBy(F.col("o_custkey").alias("cell_idx")).agg(F.count("*").alias("n_orders"))
    return entity.with_metrics(cells(spark, d).select("cell_idx", "barcode"), cells(spark, d).join(m, "cell_idx").select("barcode", "n_orders"))


@query("select gene_idx as peak_idx, 'chr' || (gene_idx % 5) as chr, gene_idx * 100 as start, s_name as nearest_gene, s_suppkey % 7 as distance_to_tss, case when s_suppkey is not null then 'near' end as annotation from genes left join supplier on s_suppkey = gene_idx")
def peak_annotation_left_join(spark, d):
    place = lambda i: [F.concat(F.lit("chr"), (i % 5).cast("string")), i * 100, i * 100 + 50]
    named = lambda cols, names: [c.alias(n) for c, n in zip(cols, names, strict=True)]
    peaks = genes(spark, d).select(F.col("gene_idx").alias("peak_idx"), *named(place(F.col("gene_idx")), ("chr", "start", "end_")))
    i = F.col("s_suppkey")
    table = _t(spark, d, "supplier").select(*named(place(i), ("chrom", "start", "end")), F.col("s_name").alias("gene"), (i % 7).cast("string").alias("distance"), F.lit("near").alias("peak_type"))
    return entity.with_annotation(peaks, table).drop("end_")


@query("select chrom, n, case when chrom = 'chrX' then 23 when chrom = 'chrY' then 24 when chrom = 'chrM' then 25 when chrom = 'chr0' or chrom = 'chr23' then 1000 else substr(chrom, 4)::int end as rank from (select case when gene_idx % 27 = 24 then 'chrX' when gene_idx % 27 = 25 then 'chrY' when gene_idx % 27 = 26 then 'chrM' else 'chr' || (gene_idx % 27) end as chrom, count(*) as n from genes group by 1)")
def chrom_order_export(spark, d):
    k = F.col("gene_idx") % 27
    chrom = F.when(k == 24, "chrX").when(k == 25, "chrY").when(k == 26, "chrM").otherwise(F.concat(F.lit("chr"), k.cast("string")))
    return genes(spark, d).groupBy(chrom.alias("chrom")).agg(F.count("*").alias("n")).withColumn("rank", R.chrom_rank(F.col("chrom"))).orderBy("rank")


@query("select chrom, start, end_, barcode, dup_count from frags join cells using (cell_idx)")
def export_fragments(spark, d):
    return fragments.export_rows(frags(spark, d), cells(spark, d))


@query("select distinct cell_type as value from cells where cell_type not in ('BUILDING', 'MACHINERY')")
def categories_stale(spark, d):
    return entity.stale_categories(cells(spark, d), "cell_type", ["BUILDING", "MACHINERY", "UNUSED"])


@query("select 'symbol' as name")
def feature_name_col(spark, d):
    return spark.createDataFrame([(entity.name_column(genes(spark, d), "RNA"),)], "name string")


@query("select min(gene_idx) as idx, 'symbol' as col from genes where symbol = (select symbol from genes where gene_idx = 3)")
def has_feature(spark, d):
    name = genes(spark, d).where("gene_idx = 3").first()["symbol"]
    return spark.createDataFrame([entity.has_feature(genes(spark, d), "RNA", name)], "idx long, col string")


@query("select 'rows' as name, max(row_idx) + 1 as used from coo union all select 'cols', max(col_idx) + 1 from coo union all select 'nnz', count(*) from coo")
def validate_report(spark, d):
    b = validation.matrix_bounds(coo(spark, d))
    return b.select(F.explode(F.map_from_arrays(F.array(F.lit("rows"), F.lit("cols"), F.lit("nnz")), F.array("rows", "cols", "nnz"))).alias("name", "used"))


@query("select row_idx, col_idx, value from coo where row_idx < 80 and col_idx < 100")
def repair_truncate(spark, d):
    return validation.truncated(coo(spark, d), 80, 100)


@query("select cell_idx, barcode from cells where cell_type is distinct from 'BUILDING' and sample_id is distinct from 3")
def entity_query_is_not(spark, d):
    return entity.query(cells(spark, d), "cell_type IS NOT \"BUILDING\" AND \"sample_id\" IS NOT 3").select("cell_idx", "barcode")


@query("select cell_idx, barcode, cell_idx % 3 as extra from cells")
def entity_with_column(spark, d):
    c = cells(spark, d)
    return entity.with_column(c.select("cell_idx", "barcode"), "cell_idx", "extra", c.select("cell_idx", (F.col("cell_idx") % 3).alias("value")))


@query("select cell_idx, barcode from cells where cell_idx in (select o_custkey from orders where o_orderstatus = 'P')")
def entity_keep(spark, d):
    mask = _t(spark, d, "orders").where("o_orderstatus = 'P'").select(F.col("o_custkey").alias("cell_idx"))
    return entity.keep(cells(spark, d).select("cell_idx", "barcode"), "cell_idx", mask)


@query(", r as (select *, row_number() over (partition by barcode order by cell_idx desc) as k from cells) select chrom, start, end_, r.cell_idx, 2 as dup_count from frags f join r on 'Customer#' || lpad(f.cell_idx::varchar, 9, '0') = r.barcode and k = 1")
def barcode_to_cell(spark, d):
    f = frags(spark, d).withColumn("barcode", F.concat(F.lit("Customer#"), F.lpad(F.col("cell_idx").cast("string"), 9, "0")))
    return fragments.with_cells(f.withColumn("dup_count", F.lit(2)).drop("cell_idx"), cells(spark, d))


@query("select gene_idx, start, end_ from (select gene_idx, 'chr' || (gene_idx % 4) as chrom, gene_idx * 1000 as start, gene_idx * 1000 + 500 as end_ from genes) where chrom = 'chr2' and start < 700000 and end_ > 200000")
def peaks_in_region(spark, d):
    g = genes(spark, d).select("gene_idx", F.concat(F.lit("chr"), (F.col("gene_idx") % 4).cast("string")).alias("chrom"), (F.col("gene_idx") * 1000).alias("start"), (F.col("gene_idx") * 1000 + 500).alias("end_"))
    return intervals.in_region(g, "chr2", 200_000, 700_000).select("gene_idx", "start", "end_")


@query(_GTF + "select gene_id, feature, start from g, (values ('transcript'), ('exon')) x(feature) where chrom = 'chr3' and feature = 'exon'")
def gtf_query_exons(spark, d):
    e = annotation.children(_gtf(spark, d), ["transcript", "exon"])
    return annotation.query_exons(e, "chr3", features=["exon"]).select("gene_id", "feature", "start")


@query("select 'chr' || (cell_idx % 30) as chrom, start, end_, cell_idx from frags where cell_idx % 30 between 1 and 22")
def standard_chromosomes(spark, d):
    f = frags(spark, d).withColumn("chrom", F.concat(F.lit("chr"), (F.col("cell_idx") % 30).cast("string")))
    return fragments.standard_only(f).select("chrom", "start", "end_", "cell_idx")


@query("select cell_idx, row_number() over (partition by cell_type order by cell_idx) - 1 as n, cell_type from cells where cell_type = 'MACHINERY'")
def rows_numbered(spark, d):
    return matrix.ordinal(cells(spark, d).where("cell_type = 'MACHINERY'").select("cell_idx", "cell_type"), "cell_idx", "n")


@query("select row_idx, col_idx, value from coo where row_idx in (select cell_idx from cells where sample_id < 20)")
def orphans_removed(spark, d):
    return validation.without_orphans(coo(spark, d), cells(spark, d).where("sample_id < 20").select(F.col("cell_idx").alias("row_idx")), "row_idx").select("row_idx", "col_idx", "value")


@query("select 'length' as what, count(*)::bigint as n, bool_and(h) as same from (select gene_id = gene_id as h from genes)")
def identical_axes(spark, d):
    g = genes(spark, d).select("gene_idx", "gene_id")
    same = setops.same_axis([g, g.repartition(3)], "gene_idx", "gene_id")
    return g.agg(F.lit("length").alias("what"), F.count("*").alias("n")).withColumn("same", F.lit(same))


@query("select name, rows_, cols_ from (select 'RNA_counts' as name, (select max(row_idx) + 1 from coo) as rows_, (select max(col_idx) + 1 from coo) as cols_) where rows_ <= (select max(cell_idx) + 1 from cells)")
def validate_matrix(spark, d):
    b = validation.matrix_bounds(coo(spark, d)).first()
    report = validation.Report()
    n = cells(spark, d).agg(F.max("cell_idx") + 1).first()[0]
    validation.check_matrix(report, "RNA_counts", coo(spark, d), n, b["cols"], n, b["cols"])
    return spark.createDataFrame([(x.split(":")[1], b["rows"], b["cols"]) for x in report.passed if x.startswith("matrix_rows")], "name string, rows_ long, cols_ long")


@query("select user_id as cell_idx, count(*) as n_fragments from events group by 1")
def stream_cell_counts(spark, d):
    from ..streaming.fragments import counts_of

    return counts_of(spark, _t(spark, d, "events").schema, f"{d}/events.parquet")
