"""Benchmark decontamination with a generalised suffix automaton of normalised test items.

The automaton holds every word sequence of every item. A document's words are streamed through it while the length
of the longest match that ends at each word is tracked; where it reaches a window (``window`` words, or a whole
shorter item) those words are hit. ``clean`` removes hit spans and drops documents of which they cover too much.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark import Broadcast
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import WORDS, Scratch, as_bytes, bounded, settled, small_batches, whole

#: Words of a normalised text: runs of ASCII letters, digits and non-ASCII characters.
WORD = "[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+"
#: Benchmark words in one automaton, at most; a larger benchmark is dealt into several, each streamed on its own.
MAX_WORDS = 200_000


def words_of(text: bytes | None) -> list[bytes]:
    return text.translate(WORDS).split() if text else []


@dataclass
class Automaton:
    """next, link and length of each state; items: per state of a whole window, the items that hold it."""

    window: int
    ids: dict[bytes, int] = field(default_factory=dict)
    next: list[dict[int, int]] = field(default_factory=lambda: [{}])
    link: list[int] = field(default_factory=lambda: [-1])
    length: list[int] = field(default_factory=lambda: [0])
    least: int = 1
    pairs: np.ndarray | None = None
    full: dict[int, tuple] = field(default_factory=dict)
    short: dict[int, tuple[int, tuple]] = field(default_factory=dict)
    above: list[int] = field(default_factory=list)

    @classmethod
    def build(cls, items: list[tuple[object, bytes | None]], window: int) -> Automaton:
        a = cls(window)
        found = [(i, w) for i, t in items if (w := words_of(t))]
        coded = [(i, [a.ids.setdefault(x, len(a.ids) + 1) for x in w]) for i, w in found]
        ends: dict[int, set] = {}
        short: dict[int, set] = {}
        for _, w in coded:
            last = 0
            for c in w:
                last = a._extend(last, c)
        for i, w in coded:
            n, state, size = min(window, len(w)), 0, 0
            for c in w:
                state = a.next[state][c]
                size += 1
                # the state of the last n words: the first whose shorter suffixes are fewer than n
                while a.link[state] >= 0 and a.length[a.link[state]] >= n:
                    state = a.link[state]
                    size = a.length[state]
                size = min(size, a.length[state])
                if size >= n:
                    (ends if len(w) >= window else short).setdefault(state, set()).add(i)
                    if len(w) < window:
                        a.short[state] = (len(w), ())
        a.full = {s: tuple(x) for s, x in ends.items()}
        a.short = {s: (a.short[s][0], tuple(x)) for s, x in short.items()}
        a.least = min((min(window, len(w)) for _, w in coded), default=1)
        codes = {c * (len(a.ids) + 1) + d for _, w in coded for c, d in zip(w, w[1:], strict=False)}
        a.pairs = np.array(sorted(codes), np.int64)
        # above: the nearest state up the links, itself included, that is a whole short item
        a.above = [-1] * len(a.link)
        for s in sorted(range(len(a.link)), key=a.length.__getitem__):
            a.above[s] = s if s in a.short else a.above[a.link[s]] if a.link[s] >= 0 else -1
        return a

    def _extend(self, last: int, c: int) -> int:
        """Append a word, as in a suffix automaton of several strings; returns the new last state."""
        nxt, link, length = self.next, self.link, self.length
        if c in nxt[last]:
            q = nxt[last][c]
            return q if length[q] == length[last] + 1 else self._split(last, c, q)
        cur = len(link)
        nxt.append({})
        link.append(0)
        length.append(length[last] + 1)
        p = last
        while p >= 0 and c not in nxt[p]:
            nxt[p][c] = cur
            p = link[p]
        if p >= 0:
            q = nxt[p][c]
            link[cur] = q if length[q] == length[p] + 1 else self._split(p, c, q)
        return cur

    def _split(self, p: int, c: int, q: int) -> int:
        clone = len(self.link)
        self.next.append(dict(self.next[q]))
        self.link.append(self.link[q])
        self.length.append(self.length[p] + 1)
        self.link[q] = clone
        while p >= 0 and self.next[p].get(c) == q:
            self.next[p][c] = clone
            p = self.link[p]
        return clone

    def runs(self, codes: np.ndarray) -> list[tuple[int, int]]:
        """Stretches of words in which each adjacent pair is in the benchmark, long enough for a window."""
        if self.least < 2:
            good = codes > 0
            grow = 0
        else:
            pair = codes[:-1] * (len(self.ids) + 1) + codes[1:]
            at = np.minimum(np.searchsorted(self.pairs, pair), len(self.pairs) - 1)
            good = (self.pairs[at] == pair) & (codes[:-1] > 0) & (codes[1:] > 0)
            grow = 1
        edge = np.flatnonzero(np.diff(np.concatenate(([0], good.view(np.int8), [0]))))
        begin, end = edge[::2], edge[1::2] + grow
        long = end - begin >= self.least
        return list(zip(begin[long].tolist(), end[long].tolist(), strict=True))

    def match(self, codes: np.ndarray) -> tuple[list[tuple[int, int]], set]:
        """The hit spans [begin, end) of the words, merged and in order, and the items with a window there."""
        spans: list[tuple[int, int]] = []
        items: set = set()
        if len(codes) < self.least or not self.ids:
            return spans, items
        nxt, link, length, w = self.next, self.link, self.length, self.window
        for begin, end in self.runs(codes):
            state = size = 0
            for i, c in enumerate(codes[begin:end].tolist(), begin):
                while state and c not in nxt[state]:
                    state = link[state]
                    size = length[state]
                if c in nxt[state]:
                    state = nxt[state][c]
                    size += 1
                most = 0
                if size >= w:
                    at = state
                    while length[link[at]] >= w:
                        at = link[at]
                    if at in self.full:
                        most = w
                        items.update(self.full[at])
                at = self.above[state]
                while at > 0:
                    n, own = self.short[at]
                    if n <= size:
                        most = max(most, n)
                        items.update(own)
                    at = self.above[link[at]]
                if most:
                    lo = i + 1 - most
                    while spans and spans[-1][1] >= lo:
                        lo = min(lo, spans.pop()[0])
                    spans.append((lo, i + 1))
        return spans, items


def automata(benchmark: DataFrame, window: int, max_words: int = MAX_WORDS) -> tuple[int, Iterator[Automaton]]:
    """How many automata there are, and one after the other, each of a part of the items whose words are counted before they are fetched."""
    items = benchmark.select(F.col("item_id"), as_bytes().alias("text"), F.coalesce(F.regexp_count(F.lower("text"), F.lit(WORD)), F.lit(0)).alias("n"))
    total = items.agg(F.sum("n")).first()[0] or 0
    parts = int(total // max_words) + 1

    def each() -> Iterator[Automaton]:
        for k in range(parts):
            part = items if parts == 1 else items.where(F.pmod(F.xxhash64("item_id", "text"), F.lit(parts)) == k)
            yield Automaton.build([(r[0], bytes(r[1]) if r[1] is not None else None) for r in part.select("item_id", "text").toLocalIterator()], window)

    return parts, each()


def _spans(docs: DataFrame, a: Automaton, ids: bool) -> tuple[DataFrame, Broadcast]:
    """(doc_id, row, spans, items) of the rows of ``docs`` (doc_id, row, text) with a hit, and what was broadcast."""
    shared = docs.sparkSession.sparkContext.broadcast(a)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        match = _matcher(shared.value)
        for b in batches:
            found = [match(t.as_py()) for t in b.column(2)]
            hit = [i for i, x in enumerate(found) if x[1]]
            flat = pa.array([[x for span in found[i][1] for x in span] for i in hit], pa.list_(pa.int32()))
            items = pa.array([_named(found[i][2]) if ids else [] for i in hit], pa.list_(pa.string()))
            at = pa.array(hit, pa.int32())
            yield pa.RecordBatch.from_arrays([b.column(0).take(at), b.column(1).take(at), flat, items], ["doc_id", "row", "spans", "items"])

    return docs.select("doc_id", "row", as_bytes().alias("text")).mapInArrow(run, "doc_id long, row long, spans array<int>, items array<string>"), shared


def _matcher(a: Automaton):
    """text -> (its words, hit spans, items)."""
    code = a.ids.get

    def match(text: bytes | None) -> tuple[list[bytes], list[tuple[int, int]], set]:
        w = words_of(text)
        return w, *a.match(np.fromiter((code(x, 0) for x in w), np.int64, len(w)))

    return match


def _named(items: set) -> list[str]:
    """Item ids as sorted texts; an item without an id hits words but isn't told."""
    return sorted(str(i) for i in items if i is not None)


def _in_parts(docs: DataFrame, parts: Iterator[Automaton], s: Scratch, ids: bool) -> DataFrame:
    """(h_id, h_row, spans, items) of rows with a hit, of all automata: one is held at a time, and its pass is written
    before the next one is built. Rows that repeat are one."""
    found = None
    for a in parts:
        x, shared = _spans(docs, a, ids)
        x = s.put(x)
        shared.destroy()
        found = x if found is None else found.union(x)
    flat = lambda c: F.array_sort(F.array_distinct(F.flatten(F.collect_set(c))))
    every = found.groupBy(F.col("doc_id").alias("h_id"), F.col("row").alias("h_row")).agg(F.flatten(F.collect_set("spans")).alias("spans"), flat("items").alias("items"))
    return s.put(every)


def _joined(docs: DataFrame, hits: DataFrame) -> DataFrame:
    return docs.join(bounded(hits), F.col("doc_id").eqNullSafe(F.col("h_id")) & (F.col("row") == F.col("h_row")), "left").drop("h_id", "h_row")


def find(docs: DataFrame, benchmark: DataFrame, window: int = 10, max_words: int = MAX_WORDS) -> DataFrame:
    """(doc_id, n_words, n_hit, n_items, items_sha256, contaminated, spans) for each row of ``docs`` (doc_id, text).

    spans are the hit stretches as arrays [begin, end) of word numbers. A window is ``window`` consecutive words of
    an item (item_id, text), or all words of a shorter one; equal items and equal windows all count. Items without an
    id hit words but aren't among the items. Null and empty texts have no words; items without words, or an empty
    benchmark, hit nothing. Rows that repeat have a result each. Other columns are ignored.
    """
    small_batches(docs.sparkSession)
    docs = docs.select("doc_id", "text", F.xxhash64("text").alias("row"))
    n, parts = automata(benchmark, window, max_words)
    names = ["doc_id", "n_words", "n_hit", "n_items", "items_sha256", "contaminated", "spans"]
    if n == 1:
        shared = docs.sparkSession.sparkContext.broadcast(next(parts))
        kinds = [pa.int64(), pa.int64(), pa.int64(), pa.string(), pa.bool_(), pa.list_(pa.list_(pa.int32()))]

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            match = _matcher(shared.value)
            for b in batches:
                out = []
                for t in b.column(1):
                    w, spans, items = match(t.as_py())
                    hit, told = sum(e - b for b, e in spans), _named(items)
                    out.append((len(w), hit, len(told), hashlib.sha256(",".join(told).encode()).hexdigest(), hit > 0, [list(x) for x in spans]))
                yield pa.RecordBatch.from_arrays([b.column(0), *[pa.array([r[i] for r in out], k) for i, k in enumerate(kinds)]], names)

        return docs.select("doc_id", as_bytes()).mapInArrow(run, "doc_id long, n_words long, n_hit long, n_items long, items_sha256 string, contaminated boolean, spans array<array<int>>")
    with Scratch(docs.sparkSession) as s:
        hits = s.keep(_in_parts(docs, parts, s, True))
    # the words of a text, counted as the automata see them
    n_words = F.coalesce(F.regexp_count(F.lower("text"), F.lit(WORD)), F.lit(0)).cast("long")
    out = _joined(docs.select("doc_id", "row", n_words.alias("n_words")), hits)
    out = settled(out, pairs=F.coalesce(_united_column(F.col("spans")), F.array().cast("array<array<int>>")), told=F.coalesce("items", F.array().cast("array<string>")))
    n_hit = F.aggregate("pairs", F.lit(0).cast("long"), lambda acc, x: acc + x[1] - x[0])
    return out.select("doc_id", "n_words", n_hit.alias("n_hit"), F.size("told").cast("long").alias("n_items"), F.sha2(F.array_join("told", ","), 256).alias("items_sha256"), (F.size("pairs") > 0).alias("contaminated"), F.col("pairs").alias("spans"))


def _united_column(flat: Column) -> Column:
    """Spans [begin, end, begin, end, ...] as sorted pairs, those that touch made one."""
    pairs = F.transform(F.sequence(F.lit(0), F.floor(F.size(flat) / 2).cast("int") - 1), lambda i: F.array(F.get(flat, 2 * i), F.get(flat, 2 * i + 1)))
    last = lambda acc: F.element_at(acc, -1)
    more = lambda acc, x: F.concat(F.slice(acc, F.lit(1), F.size(acc) - 1), F.array(F.array(last(acc)[0], F.greatest(last(acc)[1], x[1]))))
    step = lambda acc, x: F.when((F.size(acc) > 0) & (F.get(F.get(acc, F.size(acc) - 1), F.lit(1)) >= x[0]), more(acc, x)).otherwise(F.concat(acc, F.array(x)))
    return F.when(F.size(flat) > 0, F.aggregate(F.array_sort(pairs), F.array().cast("array<array<int>>"), step))


def clean(docs: DataFrame, benchmark: DataFrame, window: int = 10, max_coverage: float = 0.5, max_words: int = MAX_WORDS) -> DataFrame:
    """``docs`` with hit spans cut out of ``text``, without the documents of which they cover over ``max_coverage``.

    All columns stay; n_chars, if there, becomes the length of a text that was cut. A span is cut from its first word's first byte
    to its last word's last byte, so what stands around it stays. Documents without a hit, null and empty texts
    are unchanged. Words of a document shorter than a window can only be hit by items as short. Columns may have any
    names besides doc_id and text, rows may repeat, and an empty table stays empty.
    """
    small_batches(docs.sparkSession)
    names = docs.columns
    rows = docs.select("doc_id", "text", F.xxhash64("text").alias("row"), whole(docs).alias("doc"))
    n, parts = automata(benchmark, window, max_words)
    if n == 1:
        shared, spans = docs.sparkSession.sparkContext.broadcast(next(parts)), F.lit(None).cast("array<int>")
    else:
        shared = None
        with Scratch(docs.sparkSession) as s:
            hits = s.keep(_in_parts(rows.select("doc_id", "row", "text"), parts, s, False))
        rows, spans = _joined(rows, hits), F.col("spans")

    @F.arrow_udf("struct<text: binary, gone: boolean>")
    def cut(batches: Iterator[tuple[pa.Array, pa.Array]]) -> Iterator[pa.Array]:
        match = _matcher(shared.value) if shared is not None else None
        for texts, known in batches:
            out = []
            for t, flat in zip(texts, known.to_pylist(), strict=True):
                raw = t.as_py()
                if match is not None:
                    w, found, _ = match(raw)
                else:
                    w, found = (words_of(raw), _united(list(zip(flat[::2], flat[1::2], strict=True)))) if flat else ([], [])
                # null says that the text stays as it is
                gone = bool(found) and sum(e - b for b, e in found) > max_coverage * len(w)
                out.append({"text": _cut(raw, w, found) if found and not gone else None, "gone": gone})
            yield pa.array(out, pa.struct([("text", pa.binary()), ("gone", pa.bool_())]))

    # said to be nondeterministic, so that a filter on the result doesn't evaluate it twice
    done = rows.select("doc", cut.asNondeterministic()(as_bytes(), spans).alias("x")).where(~F.col("x.gone"))
    text = F.coalesce(F.col("x.text").cast("string"), F.col("doc.text"))
    field = lambda c: F.col("doc").getField(c)
    put = {"text": text, "n_chars": F.when(F.col("x.text").isNotNull(), F.length(text).cast(docs.schema["n_chars"].dataType)).otherwise(field("n_chars")) if "n_chars" in names else None}
    return done.select(*[put.get(c, field(c) if c not in put else None).alias(c) for c in names])


def _united(spans: list[tuple[int, int]]) -> list[tuple[int, int]]:
    out: list[tuple[int, int]] = []
    for b, e in sorted(spans):
        if out and out[-1][1] >= b:
            out[-1] = (out[-1][0], max(e, out[-1][1]))
        else:
            out.append((b, e))
    return out


def _cut(raw: bytes, words: list[bytes], spans: list[tuple[int, int]]) -> bytes:
    flat, at, marks = raw.translate(WORDS), 0, []
    for w in words:
        at = flat.index(w, at)
        marks.append((at, at + len(w)))
        at += len(w)
    out, done = [], 0
    for b, e in spans:
        out.append(raw[done : marks[b][0]])
        done = marks[e - 1][1]
    return b"".join([*out, raw[done:]])
