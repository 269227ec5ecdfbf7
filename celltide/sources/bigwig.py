"""A writer of BigWig files: sections of fixed steps, each compressed, under a chromosome tree and an R-tree."""

from __future__ import annotations

import os
import re
import struct
import zlib
from collections.abc import Iterable, Iterator
from itertools import groupby

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

# Fixed values of the format.
MAGIC, TREE_MAGIC, INDEX_MAGIC, VERSION = 0x888FFC26, 0x78CA8C91, 0x2468ACE0, 4
#: Values of a section, and children of a node of the R-tree.
SECTION, FAN = 1024, 256


def _sections(rows: Iterable[tuple[str, int, float]], bin_size: int, ids: dict[str, int], sizes: dict[str, int]) -> Iterator[tuple[int, int, int, bytes, list[float]]]:
    """(chromosome, start, end, compressed block, values) of runs of adjacent bins; rows: (chrom, bin, value) in order."""
    run: list[tuple[int, float]] = []

    def block(chrom: str):
        first, n = run[0][0] * bin_size, len(run)
        end = min((run[-1][0] + 1) * bin_size, sizes[chrom])
        # type 1: each value with its start and end, as a chromosome's last bin may be shorter
        head = struct.pack("<IIIIIBBH", ids[chrom], first, end, 0, 0, 1, 0, n)
        body = b"".join(struct.pack("<IIf", b * bin_size, min((b + 1) * bin_size, sizes[chrom]), v) for b, v in run)
        return ids[chrom], first, end, zlib.compress(head + body), [v for _, v in run]

    for chrom, items in groupby(rows, key=lambda r: r[0]):
        run = []
        for _, b, v in items:
            if run and (b != run[-1][0] + 1 or len(run) == SECTION):
                yield block(chrom)
                run = []
            run.append((b, v))
        if run:
            yield block(chrom)


def _levels(leaves: list[tuple]) -> list[list[tuple]]:
    """Levels of the R-tree from the leaves up; a node is (first chrom, start, last chrom, end, children)."""
    level = [leaves[i : i + FAN] for i in range(0, len(leaves), FAN)]
    out = []
    while True:
        nodes = [(c[0][0], c[0][1], *max((x[2], x[3]) for x in c), c) for c in level]
        out.append(nodes)
        if len(nodes) == 1:
            return out
        level = [nodes[i : i + FAN] for i in range(0, len(nodes), FAN)]


def write_bigwig(path: str, rows: Iterable[tuple[str, int, float]], bin_size: int, sizes: dict[str, int]) -> int:
    """Write (chrom, bin, value) in order of chromosome name and bin; returns how many bins were written.

    Chromosomes without a size and bins beyond it are left out. No zoom levels are written.
    """
    names = sorted(sizes)
    ids = {n: i for i, n in enumerate(names)}
    kept = ((c, b, v) for c, b, v in rows if c in sizes and b * bin_size < sizes[c])
    width = max(map(len, names))
    tree_at, n, low, high, total, squares, covered, largest = 64, 0, float("inf"), float("-inf"), 0.0, 0.0, 0, 0
    with open(path, "wb") as f:
        f.write(bytes(tree_at))
        f.write(struct.pack("<IIIIQQ", TREE_MAGIC, len(names), width, 8, len(names), 0))
        f.write(struct.pack("<BBH", 1, 0, len(names)))
        for name in names:
            f.write(name.encode().ljust(width, b"\0") + struct.pack("<II", ids[name], sizes[name]))
        summary_at = f.tell()
        f.write(bytes(40))
        data_at = f.tell()
        f.write(bytes(8))
        leaves = []
        for chrom, start, end, block, values in _sections(kept, bin_size, ids, sizes):
            leaves.append((chrom, start, chrom, end, f.tell(), len(block)))
            f.write(block)
            largest, n = max(largest, 32 + 12 * len(values)), n + len(values)
            low, high = min(low, *values, low), max(high, *values, high)
            total, squares, covered = total + sum(values) * bin_size, squares + sum(v * v for v in values) * bin_size, covered + end - start
        index_at = f.tell()
        bounds = (leaves[0][0], leaves[0][1], *max((x[2], x[3]) for x in leaves)) if leaves else (0, 0, 0, 0)
        f.write(struct.pack("<IIQIIIIQII", INDEX_MAGIC, FAN, len(leaves), *bounds, index_at, 1, 0))
        levels = _levels(leaves) if leaves else []
        at, places = f.tell(), []
        for depth in range(len(levels) - 1, -1, -1):
            places.append(at)
            at += sum(4 + (32 if depth == 0 else 24) * len(x[4]) for x in levels[depth])
        for k, depth in enumerate(range(len(levels) - 1, -1, -1)):
            child = places[k + 1] if depth else 0
            for node in levels[depth]:
                f.write(struct.pack("<BBH", depth == 0, 0, len(node[4])))
                for x in node[4]:
                    if depth == 0:
                        f.write(struct.pack("<IIIIQQ", *x))
                    else:
                        f.write(struct.pack("<IIIIQ", *x[:4], child))
                        child += 4 + (32 if depth == 1 else 24) * len(x[4])
        if not leaves:
            f.write(struct.pack("<BBH", 1, 0, 0))
        f.write(struct.pack("<I", MAGIC))
        f.seek(data_at)
        f.write(struct.pack("<Q", len(leaves)))
        f.seek(summary_at)
        f.write(struct.pack("<Qdddd", covered, low if n else 0.0, high if n else 0.0, total, squares))
        f.seek(0)
        f.write(struct.pack("<IHHQQQHHQQIQ", MAGIC, VERSION, 0, tree_at, data_at, index_at, 0, 0, 0, summary_at, largest, 0))
    return n


def write_bigwigs(coverage: DataFrame, folder: str, bin_size: int, sizes: dict[str, int]) -> list[str]:
    """A file for each group of (group, chrom, bin, value), of its bins that aren't 0, in a folder of this machine.

    A file is one sequence, so groups are written one after the other, and only one partition is ever fetched.
    """
    os.makedirs(folder, exist_ok=True)
    rows = coverage.where("value <> 0").orderBy("group", "chrom", "bin").select("group", "chrom", "bin", "value").toLocalIterator()
    out = []
    for group, items in groupby(rows, key=lambda r: r["group"]):
        out.append(f"{folder}/{re.sub(r'[^A-Za-z0-9_-]', '_', str(group))}.bw")
        write_bigwig(out[-1], ((r["chrom"], r["bin"], r["value"]) for r in items), bin_size, sizes)
    return out
