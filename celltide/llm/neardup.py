"""Near duplicates on word shingles with SetSketch registers.

A register holds the exponentially spaced, truncated minimum of one hash over a document's shingles
(``floor(1 - log_b(min))``): registers of a union are the maxima of registers, and they agree more often the more
two sets share. Bands of registers bring candidates together; registers and set sizes then give a likelihood whose
maximum estimates the Jaccard similarity, and pairs that it doesn't rule out are verified on their full sets.

Links are looked for in this order, so that large groups cost no pairs:

1. Documents with equal sets become one node.
2. In each bucket of a band, every member is compared with the bucket's most central member, the one that meets
   the most others over all bands.
3. Members that this doesn't connect are compared with all other members of the bucket: as pairs in a small
   bucket, as tiles in a large one, of which only links come out.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import LOWER, Scratch, as_bytes, small_batches
from .components import connected_components

#: Words kept with their hash by a Python worker, at most.
WORD_CACHE = 400_000
#: Members up to which a bucket's remaining pairs are formed by a join; a larger one is compared in tiles.
SMALL_BUCKET = 24
#: Shingles on a side of a tile, about; and as how many a row counts besides its own, so that rows are bounded too.
TILE, ROW = 1_000_000, 1000
_MIX = np.uint64(0x9E3779B97F4A7C15)


@dataclass(frozen=True)
class Config:
    """Shingle words, least similarity in hundredths, and the sketch: bands x rows registers of base ``base``.

    A pair at 85 % misses all bands with probability 8e-5, one at 80 %, the pipeline's least, with 2.1e-3 at 20 x 6:
    registers agree with 0.8018 there, and (1 - 0.8018^6)^20 = 2.1e-3. ``sigmas`` standard
    errors below the least similarity the estimate rules a pair out.
    """

    words: int = 5
    percent: int = 80
    bands: int = 20
    rows: int = 6
    base: float = 1.02
    top: int = 4000
    sigmas: float = 3.5

    @property
    def registers(self) -> int:
        return self.bands * self.rows


class _Words(dict):
    def __missing__(self, word: bytes) -> int:
        if len(self) >= WORD_CACHE:
            self.clear()
        self[word] = h = xxhash.xxh64_intdigest(word)
        return h


def shingle_hashes(text: bytes | None, words: _Words, k: int) -> np.ndarray:
    """Sorted distinct 64-bit hashes of the k-word shingles; of the whole sequence if it has fewer words."""
    found = text.translate(LOWER).split() if text else []
    if not found:
        return np.empty(0, np.uint64)
    w = np.fromiter(map(words.__getitem__, found), np.uint64, len(found))
    k = min(k, len(w))
    n = len(w) - k + 1
    h = np.full(n, k, np.uint64)
    for i in range(k):
        h = (h ^ w[i : i + n]) * _MIX
        h ^= h >> np.uint64(29)
    return np.unique(h)


def multipliers(m: int) -> np.ndarray:
    return np.random.Generator(np.random.PCG64(12_345)).integers(0, 2**64, m, np.uint64) | np.uint64(1)


def registers(hashes: np.ndarray, a: np.ndarray, base: float, top: int) -> np.ndarray:
    """The registers of a set. The least hash is the least exponential variable, as that grows with the hash."""
    least = np.full(len(a), np.iinfo(np.uint64).max, np.uint64)
    for i in range(0, len(hashes), 1024):
        np.minimum(least, np.multiply.outer(a, hashes[i : i + 1024]).min(axis=1), out=least)
    x = -np.log1p(-(least.astype(np.float64) + 0.5) * 2.0**-64)
    # 1e3 moves sets of one shingle well into the range that isn't truncated
    return np.clip(np.floor(1 - np.log(np.maximum(x, 1e-300) / 1e3) / np.log(base)), 0, top).astype(np.uint16)


def estimate(ra: np.ndarray, rb: np.ndarray, na: np.ndarray, nb: np.ndarray, base: float) -> np.ndarray:
    """Jaccard similarities by maximum likelihood, from the registers (pairs x m) and the exact set sizes."""
    up, down = (ra > rb).sum(1), (ra < rb).sum(1)
    same = ra.shape[1] - up - down
    return likeliest(up, down, same, na, nb, base)


def likeliest(up, down, same, na, nb, base: float) -> np.ndarray:
    na, nb = np.asarray(na, np.float64), np.asarray(nb, np.float64)
    u, v = na / (na + nb), nb / (na + nb)

    def p(x):
        return -np.log1p(-np.clip(x, 0, 1) * (base - 1) / base) / np.log(base)

    def loss(j):
        over, under = np.maximum(p(u - v * j), 1e-12), np.maximum(p(v - u * j), 1e-12)
        return -(up * np.log(over) + down * np.log(under) + same * np.log(np.maximum(1 - over - under, 1e-12)))

    lo, hi = np.zeros_like(u), np.minimum(u / v, v / u)
    for _ in range(30):  # the likelihood is concave
        a, b = lo + (hi - lo) * 0.382, lo + (hi - lo) * 0.618
        left = loss(a) < loss(b)
        hi, lo = np.where(left, b, hi), np.where(left, lo, a)
    return (lo + hi) / 2


def _margin(c: Config) -> float:
    t = c.percent / 100
    return t - c.sigmas * float(np.sqrt(t * (1 - t) / c.registers))


def sketch(docs: DataFrame, c: Config) -> DataFrame:
    """(doc_id, text_hash, n, node, sig): the set's size, a 128-bit digest of the set, and its registers; node is null for an empty set."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words, a = _Words(), multipliers(c.registers)
        for b in batches:
            n, node, sig = [], [], []
            for t in b.column(2):
                h = shingle_hashes(t.as_py(), words, c.words)
                n.append(len(h))
                node.append(xxhash.xxh3_128_digest(h.tobytes()) if len(h) else None)
                sig.append(registers(h, a, c.base, c.top).astype(">u2").tobytes() if len(h) else None)
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(n, pa.int64()), pa.array(node, pa.binary()), pa.array(sig, pa.binary())], ["doc_id", "text_hash", "n", "node", "sig"])

    return docs.select("doc_id", F.xxhash64("text").alias("text_hash"), as_bytes()).mapInArrow(run, "doc_id long, text_hash long, n long, node binary, sig binary")


def _sets(docs: DataFrame, c: Config) -> DataFrame:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words = _Words()
        for b in batches:
            found = [shingle_hashes(t.as_py(), words, c.words) for t in b.column(0)]
            found = [h for h in found if len(h)]
            node = pa.array([xxhash.xxh3_128_digest(h.tobytes()) for h in found], pa.binary())
            ends = np.cumsum([0, *map(len, found)]).astype(np.int32)
            flat = np.concatenate(found) if found else np.empty(0, np.uint64)
            yield pa.RecordBatch.from_arrays([node, pa.ListArray.from_arrays(pa.array(ends), pa.array(flat.view(np.int64)))], ["node", "hashes"])

    return docs.select(as_bytes()).mapInArrow(run, "node binary, hashes array<long>")


def _close(na: str, nb: str, c: Config):
    """The sizes alone don't rule the pair out."""
    return F.lit(100) * F.least(na, nb) >= F.lit(c.percent) * F.greatest(na, nb)


def _likely(pairs: DataFrame, c: Config) -> DataFrame:
    """Of pairs (a, b, n_a, n_b, sig_a, sig_b) those that the likelihood doesn't rule out."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            if b.num_rows:
                ra, rb = (np.frombuffer(b"".join(b.column(i).to_pylist()), ">u2").reshape(b.num_rows, -1) for i in (4, 5))
                na, nb = (b.column(i).to_numpy() for i in (2, 3))
                keep = estimate(ra, rb, na, nb, c.base) >= _margin(c)
                yield b.select([0, 1]).filter(pa.array(keep))

    return pairs.select("a", "b", "n_a", "n_b", "sig_a", "sig_b").mapInArrow(run, "a binary, b binary")


def _with_sigs(pairs: DataFrame, nodes: DataFrame) -> DataFrame:
    for x in "ab":
        pairs = pairs.join(nodes.select(F.col("node").alias(x), F.col("n").alias(f"n_{x}"), F.col("sig").alias(f"sig_{x}")), x)
    return pairs


def _tiles(members: DataFrame, c: Config) -> DataFrame:
    """Links (a, b) in large buckets, of a member to do (todo) to one of another component.

    members: (key, node, n, sig, hashes, root, todo, mass, todo_mass), the masses being the shingles of the bucket's
    members and of those to do, and ROW for each member. Both sides are dealt into parts of about TILE of that mass,
    so of TILE / ROW rows or fewer, and a task compares a part with a part: neither a bucket nor its pairs are ever in one place. Pairs that the registers don't rule out are
    verified on their sets at once; of the links of one member to one component the first is enough.
    """
    parts = lambda n: F.greatest(F.ceil(F.col(n) / TILE), F.lit(1)).cast("int")
    part = lambda n: F.pmod(F.xxhash64("node", F.lit(n)), parts(n)).cast("int")
    every = lambda n: F.explode(F.sequence(F.lit(0), parts(n) - 1))
    left = members.where("todo").withColumn("side", F.lit(0)).withColumn("p", part("todo_mass")).withColumn("q", every("mass"))
    right = members.withColumn("side", F.lit(1)).withColumn("q", part("mass")).withColumn("p", every("todo_mass"))
    tiles = left.unionByName(right).select("key", "p", "q", "side", "node", "n", "sig", "hashes", "root")

    def run(t: pa.Table) -> pa.Table:
        def side(k):
            s = t.filter(pa.compute.equal(t["side"], k))
            reg = np.frombuffer(b"".join(s["sig"].to_pylist()), ">u2").astype(np.uint16).reshape(s.num_rows, -1) if s.num_rows else np.empty((0, c.registers), np.uint16)
            sets = [x.values.to_numpy(zero_copy_only=False) for x in s["hashes"]]
            return s["node"].to_pylist(), s["n"].to_numpy(), reg, s["root"].to_pylist(), sets

        (ids, n, reg, roots, sets), (ids2, n2, reg2, roots2, sets2) = side(0), side(1)
        names = {r: i for i, r in enumerate({*roots, *roots2})}
        root2, a, b = np.array([names[r] for r in roots2], np.int64), [], []
        for i in range(len(ids)):
            near = (root2 != names[roots[i]]) & (100 * np.minimum(n[i], n2) >= c.percent * np.maximum(n[i], n2))
            at = np.flatnonzero(near)
            if len(at):
                other = reg2[at]
                up, down = (other < reg[i]).sum(1), (other > reg[i]).sum(1)
                j = likeliest(up, down, c.registers - up - down, np.full(len(at), n[i]), n2[at], c.base)
                done = set()
                for k in at[j >= _margin(c)]:
                    if root2[k] not in done:
                        both = len(np.intersect1d(sets[i], sets2[k], assume_unique=True))
                        if 100 * both >= c.percent * (n[i] + n2[k] - both):
                            done.add(root2[k])
                            a.append(min(ids[i], ids2[k]))
                            b.append(max(ids[i], ids2[k]))
        return pa.table({"a": pa.array(a, pa.binary()), "b": pa.array(b, pa.binary())})

    return tiles.groupBy("key", "p", "q").applyInArrow(run, "a binary, b binary").distinct()


def _sets_of(needed: DataFrame, docs: DataFrame, ids: DataFrame, c: Config, s: Scratch) -> DataFrame:
    """(node, hashes) of the nodes in ``needed``, a side of ``s``; ids: (node, doc_id), one document of each node."""
    wanted = s.side(ids.join(needed, "node", "left_semi").select(F.col("doc_id").alias("__id")).distinct())
    texts = docs.select("doc_id", "text").join(wanted, F.col("doc_id").eqNullSafe(F.col("__id")), "left_semi")
    return s.put(_sets(texts, c).join(needed, "node", "left_semi").dropDuplicates(["node"]))


def _verified(likely: DataFrame, docs: DataFrame, ids: DataFrame, c: Config, s: Scratch) -> DataFrame:
    """Of the pairs (a, b) of nodes those whose full sets are similar enough."""
    needed = s.side(likely.select(F.col("a").alias("node")).union(likely.select(F.col("b").alias("node"))).distinct())
    sets = _sets_of(needed, docs, ids, c, s)
    pairs = likely
    for x in "ab":
        pairs = pairs.join(sets.select(F.col("node").alias(x), F.col("hashes").alias(f"h_{x}")), x)
    shared, both = F.size(F.array_intersect("h_a", "h_b")), F.size("h_a") + F.size("h_b")
    # shared / union >= percent / 100
    out = s.put(pairs.where(F.lit(100) * shared >= F.lit(c.percent) * (both - shared)).select("a", "b"))
    s.drop(sets)
    return out


def near_duplicates(docs: DataFrame, c: Config = Config(), by_row: bool = False) -> DataFrame:  # noqa: B008
    """(doc_id, n_shingles, component_id, kept) for each row of ``docs`` (doc_id, text; other columns are ignored).

    Two documents are linked if the distinct ``c.words``-word shingles of their texts (ASCII lower-cased; a shorter
    text is one shingle) have a Jaccard similarity of ``c.percent`` hundredths or more; component_id is the
    smallest doc_id reachable over links and kept says that it is the document's own. Null and empty texts have no
    shingles and no links. Rows that repeat a doc_id are documents of their own, which may all be kept; a row with
    a null doc_id gets the smallest id of its component, null if there is none. An empty input gives an empty result.
    ``by_row`` adds text_hash (xxhash64 of the text) and root, which is equal just for rows of one component whatever
    their ids, null for rows without shingles.
    """
    small_batches(docs.sparkSession)
    spark: SparkSession = docs.sparkSession
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    with Scratch(spark) as s:
        base = s.put(sketch(docs, c))
        rows = s.put(base.select("doc_id", "text_hash", "n", "node"))
        nodes = s.put(base.where("node is not null").groupBy("node").agg(F.min("doc_id").alias("doc_id"), F.first("n").alias("n"), F.first("sig").alias("sig"), F.count("*").alias("copies")))
        s.drop(base)
        band = F.posexplode(F.array(*[F.xxhash64(F.lit(i), F.substring("sig", 2 * i * c.rows + 1, 2 * c.rows)) for i in range(c.bands)])).alias("band", "key")
        banded = nodes.select("node", "n", band).select("key", "node", "n")
        full = s.side(banded.groupBy("key").agg(F.count("*").alias("size")).where("size > 1"))
        met = s.put(banded.join(full, "key"))
        # the most central member of each bucket, and each other member's pair with it
        central = s.side(met.groupBy("node").agg(F.sum("size").alias("meets")))
        centres = met.join(central, "node").groupBy("key").agg(F.max(F.struct("meets", "node", "n")).alias("x"))
        centres = s.side(centres.select("key", F.col("x.node").alias("centre"), F.col("x.n").alias("n_c")))
        stars = met.join(centres, "key").where((F.col("node") != F.col("centre")) & _close("n", "n_c", c))
        stars = s.put(stars.select(F.least("node", "centre").alias("a"), F.greatest("node", "centre").alias("b")).distinct())
        sigs = s.put(nodes.join(central.select("node"), "node", "left_semi").select("node", "n", "sig"))
        ids = nodes.select("node", "doc_id")
        links = _verified(s.put(_likely(_with_sigs(stars, sigs), c)), docs, ids, c, s)
        roots = s.side(connected_components(links.select(F.col("a").alias("u"), F.col("b").alias("v")), s))
        # members of a bucket that are not in its centre's component
        r = roots.select(F.col("node").alias("r_node"), "root")
        of = lambda df, node, name: df.join(r, F.col(node) == F.col("r_node"), "left").withColumn(name, F.coalesce("root", node)).drop("r_node", "root")
        state = of(met, "node", "own").join(s.side(of(centres, "centre", "main")), "key").withColumn("todo", F.col("own") != F.col("main"))
        open_keys = s.side(state.groupBy("key").agg(F.sum(F.col("n") + ROW).alias("mass"), F.sum(F.when(F.col("todo"), F.col("n") + ROW)).alias("todo_mass")).where("todo_mass > 0"))
        state = s.put(state.join(open_keys, "key").select("key", "node", "n", F.col("own").alias("root"), "todo", "size", "mass", "todo_mass"))
        s.drop(met, full)
        few = state.where(F.col("size") <= SMALL_BUCKET)
        x = few.where("todo").select("key", F.col("node").alias("x"), F.col("n").alias("n_x"), F.col("root").alias("r_x"))
        pairs = few.join(x, "key").where((F.col("root") != F.col("r_x")) & _close("n", "n_x", c))
        pairs = pairs.select(F.least("node", "x").alias("a"), F.greatest("node", "x").alias("b")).distinct().join(stars, ["a", "b"], "left_anti")
        more = _verified(s.put(_likely(_with_sigs(pairs, sigs), c)), docs, ids, c, s)
        many = state.where(F.col("size") > SMALL_BUCKET)
        in_many = s.side(many.select("node").distinct())
        if not in_many.isEmpty():
            sets = _sets_of(in_many, docs, ids, c, s)
            more = s.put(more.union(_tiles(many.join(sigs.select("node", "sig"), "node").join(sets, "node"), c)))
        # the components so far stand for their links
        if not more.isEmpty():
            roots = connected_components(roots.select(F.col("node").alias("u"), F.col("root").alias("v")).union(more.select("a", "b")), s)
        named = s.put(roots.join(ids, "node"))
        first = s.side(named.groupBy("root").agg(F.min("doc_id").alias("component_id")))
        named = named.join(first, "root").select("node", "component_id", "root")
        # copies that are in no link have their own smallest id
        copied = nodes.where("copies > 1").select("node", F.col("doc_id").alias("least"))
        known = copied.join(named, "node", "full").select("node", F.coalesce("component_id", "least").alias("component_id"), F.coalesce("root", "node").alias("root"))
        known = s.side(known).withColumnRenamed("node", "k_node")
        out = rows.join(known, F.col("node") == F.col("k_node"), "left")
        component = F.coalesce("component_id", "doc_id")
        return s.keep(out.select("doc_id", F.col("n").alias("n_shingles"), component.alias("component_id"), F.coalesce(F.col("doc_id") == component, F.lit(False)).alias("kept"), *([F.col("text_hash"), F.coalesce("root", "node").alias("root")] if by_row else [])))

