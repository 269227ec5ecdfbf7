"""Gene models: parsing of annotation lines, cascades, and queries."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.regions import attribute_keys, attribute_values, one_based


def parse_gtf(lines: DataFrame) -> DataFrame:
    """(line, chrom, source, feature, start, end, strand, and attributes) of annotation lines (line, value).

    Blank lines, comments and lines of fewer than 9 fields go. Coordinates become 0-based and half-open.
    """
    f = F.split("value", "\t")
    good = lines.where(~F.startswith("value", F.lit("#")) & (F.size(f) >= 9))
    # keys and values are found once for a line; the generator keeps the optimiser from copying that into each use
    pairs = F.struct(f.alias("f"), attribute_keys(f[8]).alias("keys"), attribute_values(f[8]).alias("vals"))
    good = good.select("line", F.inline(F.array(pairs)))
    f, places = F.col("f"), F.transform("keys", lambda k, i: F.struct(k.alias("k"), F.get("vals", i).alias("v")))
    tags = F.transform(F.filter(places, lambda x: x["k"] == "tag"), lambda x: x["v"])
    # the last of a key counts
    value = lambda key: F.get(F.col("vals"), F.size("keys") - F.array_position(F.reverse("keys"), F.lit(key)).cast("int"))
    of = lambda *keys: F.coalesce(*[F.when(F.array_contains("keys", key), value(key)) for key in keys])
    return good.select(
        "line", f[0].alias("chrom"), f[1].alias("source"), f[2].alias("feature"), one_based(f[3].cast("long")).alias("start"), f[4].cast("long").alias("end"), f[6].alias("strand"),
        of("gene_id").alias("gene_id"), of("gene_name").alias("gene_name"), of("gene_type", "gene_biotype").alias("gene_type"), of("transcript_id").alias("transcript_id"),
        of("transcript_type", "transcript_biotype").alias("transcript_type"), of("exon_number").try_cast("int").alias("exon_number"), tags.alias("tags"),
    )


def genes(parsed: DataFrame, biotypes: list[str] | None = None) -> DataFrame:
    """One row for each gene_id, of its last gene line; only those of ``biotypes`` if given."""
    g = parsed.where((F.col("feature") == "gene") & F.col("gene_id").isNotNull())
    if biotypes is not None:
        g = g.where(F.col("gene_type").isin(biotypes))
    kept = ["chrom", "start", "end", "strand", "gene_name", "gene_type", "source"]
    return g.groupBy("gene_id").agg(F.max_by(F.struct(*kept), "line").alias("x")).select("gene_id", *[F.col(f"x.{c}") for c in kept])


def children(parsed: DataFrame, features: list[str], kept_genes: DataFrame | None = None, transcript_pattern: str | None = None, transcript_prefixes: list[str] | None = None, tags: list[str] | None = None) -> DataFrame:
    """Rows below genes (exons and the like) of kept genes and kept transcripts.

    Transcripts are kept by pattern, prefixes and tags; tags are read from transcript lines, so that without
    ``transcript`` among ``features`` a tag filter leaves nothing.
    """
    c = parsed.where(F.col("feature").isin([f for f in features if f != "gene"]))
    if kept_genes is not None:
        c = c.join(kept_genes.select("gene_id").distinct(), "gene_id", "left_semi")
    if transcript_pattern:
        c = c.where(F.col("transcript_id").rlike(transcript_pattern))
    if transcript_prefixes:
        c = c.where(_any([F.startswith("transcript_id", F.lit(p)) for p in transcript_prefixes]))
    if tags:
        good = parsed.where((F.col("feature") == "transcript") & F.lit("transcript" in features) & F.arrays_overlap("tags", F.array(*map(F.lit, tags)))).select("transcript_id").distinct()
        c = c.join(good, "transcript_id", "left_semi")
    return c.select("gene_id", "transcript_id", "exon_number", "chrom", "start", "end", "strand", "feature", "transcript_type")


def _any(tests: list[Column]) -> Column:
    out = F.lit(False)
    for t in tests:
        out = out | t
    return out


def query_genes(df: DataFrame, chrom: str | None = None, start: int | None = None, end: int | None = None, names: list[str] | None = None) -> DataFrame:
    """Genes that meet all that is given; an interval counts only with both ends, and no names means none."""
    return _located(df, chrom, start, end, {"gene_name": names})


def query_exons(df: DataFrame, chrom: str | None = None, start: int | None = None, end: int | None = None, gene_ids: list[str] | None = None, features: list[str] | None = None) -> DataFrame:
    return _located(df, chrom, start, end, {"gene_id": gene_ids, "feature": features})


def _located(df: DataFrame, chrom, start, end, among: dict) -> DataFrame:
    if chrom is not None:
        df = df.where(F.col("chrom") == chrom)
    if start is not None and end is not None:
        df = df.where((F.col("start") < end) & (F.col("end") > start))
    for c, values in among.items():
        if values is not None:
            df = df.where(F.col(c).isin(values) if values else F.lit(False))
    return df.orderBy("chrom", "start")


def info(gene_table: DataFrame, exon_table: DataFrame) -> dict | None:
    row = gene_table.agg(F.count("*").alias("n"), F.array_sort(F.collect_set("source")).alias("s")).first()
    if not row["n"]:
        return None
    return {"source": row["s"][0] if len(row["s"]) == 1 else row["s"], "n_genes": row["n"], "n_exons": exon_table.count()}
