"""Genomic regions: parsing, formatting, comparing and binning, as columns and as plain Python."""

from __future__ import annotations

import re

from pyspark.sql import Column
from pyspark.sql import functions as F

REGION = r"^([^:\s]+):([\d,.]+)([KkMmGg]?)-([\d,.]+)([KkMmGg]?)$"
FEATURE = r"^([^:\s]+):(\d+)-(\d+)$"
_UNITS = {"": 1, "K": 10**3, "M": 10**6, "G": 10**9}

# Lengths of the chromosomes of two assemblies.
HG38 = {
    "chr1": 248956422, "chr2": 242193529, "chr3": 198295559, "chr4": 190214555, "chr5": 181538259, "chr6": 170805979, "chr7": 159345973, "chr8": 145138636,
    "chr9": 138394717, "chr10": 133797422, "chr11": 135086622, "chr12": 133275309, "chr13": 114364328, "chr14": 107043718, "chr15": 101991189, "chr16": 90338345,
    "chr17": 83257441, "chr18": 80373285, "chr19": 58617616, "chr20": 64444167, "chr21": 46709983, "chr22": 50818468, "chrX": 156040895, "chrY": 57227415, "chrM": 16569,
}
MM10 = {
    "chr1": 195471971, "chr2": 182113224, "chr3": 160039680, "chr4": 156508116, "chr5": 151834684, "chr6": 149736546, "chr7": 145441459, "chr8": 129401213,
    "chr9": 124595110, "chr10": 130694993, "chr11": 122082543, "chr12": 120129022, "chr13": 120421639, "chr14": 124902244, "chr15": 104043685, "chr16": 98207768,
    "chr17": 94987271, "chr18": 90702639, "chr19": 61431566, "chrX": 171031299, "chrY": 91744698, "chrM": 16299,
}
STANDARD = [*(f"chr{i}" for i in range(1, 23)), "chrX", "chrY", "chrM"]


def chrom_sizes(genome: str = "hg38") -> dict[str, int]:
    try:
        return dict({"hg38": HG38, "mm10": MM10}[genome.lower()])
    except KeyError:
        raise ValueError(f"unsupported genome {genome!r}; expected hg38 or mm10") from None


def chrom_to_int(name: str) -> int:
    if name not in STANDARD:
        raise ValueError(f"unsupported chromosome {name!r}")
    return STANDARD.index(name) + 1


def int_to_chrom(i: int) -> str:
    if not 1 <= i <= len(STANDARD):
        raise ValueError(f"unsupported chromosome number {i}")
    return STANDARD[i - 1]


def chrom_rank(chrom: Column) -> Column:
    """1 to 22, X 23, Y 24, M 25, others 1000."""
    return F.coalesce(F.nullif(F.array_position(F.array(*map(F.lit, STANDARD)), chrom), F.lit(0)), F.lit(1000)).cast("int")


def parse_region(text: str) -> tuple[str, int, int]:
    """``chr1:1,000-2M`` to (chrom, start, end). ValueError if it isn't a region or ends before it starts."""
    found = re.match(REGION, text.strip())
    if not found:
        raise ValueError(f"not a region: {text!r}")
    number = lambda x, unit: int(float(x.replace(",", "")) * _UNITS[unit.upper()])
    chrom, a, ua, b, ub = found.groups()
    start, end = number(a, ua), number(b, ub)
    if end < start:
        raise ValueError(f"the region ends before it starts: {text!r}")
    return chrom, start, end


def region_columns(text: Column) -> list[Column]:
    """chrom, start and end of a region column; null where ``parse_region`` raises."""
    text = F.trim(text)
    number = lambda i: F.regexp_replace(F.regexp_extract(text, REGION, i), ",", "").try_cast("double")
    unit = lambda i: F.pow(F.lit(1000), F.instr(F.lit("KMG"), F.upper(F.regexp_extract(text, REGION, i))) * F.length(F.regexp_extract(text, REGION, i)))
    start, end = (F.floor(number(i) * unit(i + 1)).cast("long") for i in (2, 4))
    good = text.rlike(REGION) & (end >= start)
    return [F.when(good, x).alias(n) for x, n in ((F.regexp_extract(text, REGION, 1), "chrom"), (start, "start"), (end, "end_"))]


def feature_columns(name: Column, lenient: bool = False) -> list[Column]:
    """chr, start and end_ of ``chr:start-end`` names; where it doesn't fit null, or ("", 0, 0) if ``lenient``."""
    fits = name.rlike(FEATURE)
    part = lambda i: F.regexp_extract(name, FEATURE, i)
    other = (F.lit(""), F.lit(0).cast("long"), F.lit(0).cast("long")) if lenient else (F.lit(None),) * 3
    return [F.when(fits, x).otherwise(o).alias(n) for x, o, n in zip((part(1), part(2).try_cast("long"), part(3).try_cast("long")), other, ("chr", "start", "end_"), strict=True)]


def extended(start: Column, end: Column, up: int, down: int) -> list[Column]:
    return [F.greatest(start - up, F.lit(0)).alias("start"), (end + down).alias("end_")]


def overlaps(a_start: Column, a_end: Column, b_start: Column, b_end: Column) -> Column:
    """Half-open intervals that share a position; touching ones do not."""
    return (a_start < b_end) & (a_end > b_start)


def tile_id(chrom: Column, b: Column, size: int) -> Column:
    return F.concat(chrom, F.lit(":"), (b * size + 1).cast("string"), F.lit("-"), ((b + 1) * size).cast("string"))


def safe_name(name: Column) -> Column:
    return F.regexp_replace(name, r"[^\p{L}\p{N}_-]", "_")


def one_based(start: Column) -> Column:
    """0-based start of a 1-based closed one."""
    return start - 1


ATTRIBUTE = r'(?<!\w)(\w+)\s+"([^"]*)"'


def attribute_keys(text: Column) -> Column:
    """The keys of annotation attributes ``key "value"``, in their order."""
    return F.regexp_extract_all(text, F.lit(ATTRIBUTE), F.lit(1))


def attribute_values(text: Column) -> Column:
    """Their values."""
    return F.regexp_extract_all(text, F.lit(ATTRIBUTE), F.lit(2))
