"""Edit-aware token counts: a segment tree over pre-token segments of each document, kept from edit to edit.

A text is cut where the pre-tokenizer always cuts, whatever stands around it: before white space that follows
something else, and where letters, digits and signs of ASCII meet (but not after an apostrophe, which may begin a
contraction). Segments are runs of about SEGMENT characters between such cuts, so their token counts add up to the
text's. The tree's leaves hold characters and tokens of a segment, its nodes their sums. An edit finds its first
and last leaf by descending the tree, re-encodes these with the boundary context that keeps cuts valid, and updates
the sums above them; everything else keeps its count. The leaves are what is kept of a tree, with a digest of the
text they belong to.
"""

from __future__ import annotations

import base64
import re
from collections.abc import Callable, Iterator
from itertools import accumulate, pairwise

import pyarrow as pa
import xxhash
from pyspark import Broadcast
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import small_batches

#: Place of the vocabulary (token ranks) and the pattern of its pre-tokenizer: fixed values of that vocabulary.
VOCABULARY = "/opt/tokenizers/byte_bpe_50k.tiktoken"
PATTERN = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""
#: Characters of a segment, at least, if the text allows a cut.
SEGMENT = 512
#: Where a text may be cut.
CUT = re.compile(r"(?<=\S)(?=[ \t\n\r])|(?<=[A-Za-z])(?=[!-@\[-`{-~])|(?<=[0-9])(?=[!-/:-~])|(?<=[!-&(-/:-@\[-`{-~])(?=[A-Za-z0-9])")
#: What is kept of a document's tree.
TREE = "struct<digest: bigint, leaves: array<struct<chars: int, tokens: int>>>"
_TREE = pa.struct([("digest", pa.int64()), ("leaves", pa.list_(pa.struct([("chars", pa.int32()), ("tokens", pa.int32())])))])

_encoders: dict[int, object] = {}


def encoder(ranks: bytes):
    """The tokenizer of a file of token ranks, made once in a process."""
    key = xxhash.xxh64_intdigest(ranks)
    if key not in _encoders:
        import tiktoken

        table = {base64.b64decode(a): int(b) for a, b in map(bytes.split, ranks.splitlines())}
        _encoders[key] = tiktoken.Encoding("own", pat_str=PATTERN, mergeable_ranks=table, special_tokens={})
    return _encoders[key]


def _ranks(path: str) -> bytes:
    with open(path, "rb") as f:
        return f.read()


def _shipped(spark: SparkSession, path: str) -> Broadcast:
    """The vocabulary's file, read by the driver and sent to the executors, which need no copy of their own."""
    return spark.sparkContext.broadcast(_ranks(path))


def counter(ranks: bytes) -> Callable[[str], int]:
    enc = encoder(ranks)
    return lambda text: len(enc.encode_ordinary(text)) if text else 0


def count_with(path: str = VOCABULARY) -> Callable[[str], int]:
    return counter(_ranks(path))


def segments(text: str, size: int = SEGMENT) -> list[str]:
    """The text cut at the first cut that is ``size`` characters or more behind the last one."""
    out, begin = [], 0
    while len(text) - begin > size:
        found = CUT.search(text, begin + size)
        if not found:
            break
        out.append(text[begin : found.start()])
        begin = found.start()
    return [*out, text[begin:]]


def _parted(left: str, right: str) -> bool:
    """A cut stands between two texts."""
    return bool(left and right and CUT.match(left[-1] + right[0], 1))


def digest(text: str) -> int:
    return xxhash.xxh64_intdigest(text.encode("utf-8", "surrogatepass")) - 2**63


class Tree:
    """Sums over the leaves of a document; ``reencoded`` counts the characters that were encoded so far.

    ``kept``: the dict of an earlier ``keep``. If it isn't of this text, the text is encoded and ``rebuilt`` is true.
    """

    def __init__(self, text: str, count: Callable[[str], int], size: int = SEGMENT, kept: dict | None = None):
        self.count, self.size, self.reencoded = count, size, 0
        fits = kept is not None and kept["digest"] == digest(text) and sum(x["chars"] for x in kept["leaves"]) == len(text)
        self.rebuilt = not fits
        if fits:
            ends = [0, *accumulate(x["chars"] for x in kept["leaves"])]
            self.texts = [text[a:b] for a, b in pairwise(ends)]
            self.tokens_of = [x["tokens"] for x in kept["leaves"]]
        else:
            self.texts = segments(text, size)
            self.tokens_of = [self._encode(t) for t in self.texts]
        self._build()

    def keep(self) -> dict:
        """The leaves, without empty ones, and the digest of the text."""
        leaves = [{"chars": len(t), "tokens": n} for t, n in zip(self.texts, self.tokens_of, strict=True) if t]
        return {"digest": digest(self.text()), "leaves": leaves or [{"chars": 0, "tokens": 0}]}

    def _encode(self, text: str) -> int:
        self.reencoded += len(text)
        return self.count(text)

    def _build(self) -> None:
        self.width = 1 << max(0, (len(self.texts) - 1).bit_length())
        self.chars, self.tokens = [0] * (2 * self.width), [0] * (2 * self.width)
        for i, t in enumerate(self.texts):
            self.chars[self.width + i], self.tokens[self.width + i] = len(t), self.tokens_of[i]
        for i in range(self.width - 1, 0, -1):
            self._sum(i)

    def _sum(self, i: int) -> None:
        self.chars[i] = self.chars[2 * i] + self.chars[2 * i + 1]
        self.tokens[i] = self.tokens[2 * i] + self.tokens[2 * i + 1]

    @property
    def total(self) -> int:
        return self.tokens[1]

    def text(self) -> str:
        return "".join(self.texts)

    def leaf_at(self, at: int) -> tuple[int, int]:
        """The leaf that holds character ``at`` (the last one, at the end), and the characters before that leaf."""
        i, before = 1, 0
        while i < self.width:
            i *= 2
            if at >= before + self.chars[i] and self.chars[i + 1]:
                before += self.chars[i]
                i += 1
        return min(i - self.width, len(self.texts) - 1), before

    def edit(self, at: int, delete: int, insert: str) -> None:
        """Replace ``delete`` characters from ``at`` by ``insert``; both are clipped to the text."""
        at = max(0, min(at, self.chars[1]))
        delete = max(0, min(delete, self.chars[1] - at))
        first, before = self.leaf_at(at)
        last, before_last = self.leaf_at(at + delete)
        text = "".join(self.texts[first : last + 1])
        text = text[: at - before] + insert + text[at - before + delete :]
        # boundary context: neighbours from which no cut parts the new text belong to it
        while first > 0 and not _parted(self.texts[first - 1], text):
            first -= 1
            text = self.texts[first] + text
        end = len(self.texts)
        while last + 1 < end and not _parted(text, self.texts[last + 1]):
            last += 1
            text += self.texts[last]
        # all new text goes to the first leaf, so that no leaf moves; a leaf that has grown too long has the tree rebuilt
        self.texts[first : last + 1] = [text] + [""] * (last - first)
        self.tokens_of[first : last + 1] = [self._encode(text)] + [0] * (last - first)
        if len(text) > 8 * self.size and len(segments(text, self.size)) > 1:
            kept = [(t, n) for t, n in zip(self.texts, self.tokens_of, strict=True) if t]
            at_leaf = next(i for i, (t, _) in enumerate(kept) if t is text or t == text)
            parts = segments(text, self.size)
            kept[at_leaf : at_leaf + 1] = [(t, self._encode(t)) for t in parts]
            self.texts, self.tokens_of = [t for t, _ in kept], [n for _, n in kept]
            self._build()
            return
        touched = set()
        for i in range(first, last + 1):
            self.chars[self.width + i], self.tokens[self.width + i] = len(self.texts[i]), self.tokens_of[i]
            touched.add((self.width + i) // 2)
        while touched and max(touched):
            for i in touched:
                self._sum(i)
            touched = {i // 2 for i in touched} - {0}


def token_counts(docs: DataFrame, vocabulary: str = VOCABULARY, size: int = SEGMENT) -> DataFrame:
    """(doc_id, text, n_tokens, tree) for each row of ``docs`` (doc_id, text): the count, and the tree to keep.

    An empty text has no tokens and a tree of one empty leaf; a null text has no tokens and a null tree. Rows that
    repeat have a tree each. Other columns are ignored.
    """
    small_batches(docs.sparkSession)
    ranks = _shipped(docs.sparkSession, vocabulary)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        count = counter(ranks.value)
        for b in batches:
            trees = [None if t is None else Tree(t, count, size) for t in b.column(1).to_pylist()]
            kept = pa.array([t and t.keep() for t in trees], _TREE)
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array([t.total if t else 0 for t in trees], pa.int64()), kept], ["doc_id", "text", "n_tokens", "tree"])

    return docs.select("doc_id", "text").mapInArrow(run, f"doc_id long, text string, n_tokens long, tree {TREE}")


def edited_counts(docs: DataFrame, vocabulary: str = VOCABULARY, size: int = SEGMENT, passed: list[str] = ()) -> DataFrame:
    """(doc_id, text, n_tokens, n_tokens_before, n_reencoded, rebuilt, tree) of ``docs`` (doc_id, text, edits, and tree or not).

    edits is array<struct<at int, remove int, put string>>, applied in order to characters of the text as it is then,
    and clipped to it; null edits, or a null in one, leave the text, and a null text stays null whatever its edits.
    tree is what ``token_counts`` or an earlier call returned; where it is null or isn't of the text (its digest or
    length differ) the text is encoded first, and ``rebuilt`` is true. n_tokens and tree are of the edited text, which
    ``text`` is. n_reencoded counts the characters that the edits had encoded. Columns of ``passed`` go along, others
    are ignored.
    """
    small_batches(docs.sparkSession)
    ranks = _shipped(docs.sparkSession, vocabulary)
    kept = F.col("tree") if "tree" in docs.columns else F.lit(None).cast(TREE)
    kinds = [pa.string(), pa.int64(), pa.int64(), pa.int64(), pa.bool_(), _TREE]
    names = ["doc_id", "text", "n_tokens", "n_tokens_before", "n_reencoded", "rebuilt", "tree"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        count = counter(ranks.value)
        for b in batches:
            out = []
            for text, edits, known in zip(*(b.column(i).to_pylist() for i in (1, 2, 3)), strict=True):
                if text is None:
                    out.append((None, 0, 0, 0, False, None))
                    continue
                tree = Tree(text, count, size, known)
                before, done = tree.total, tree.reencoded
                for e in edits or []:
                    if e is not None and None not in e.values():
                        tree.edit(e["at"], e["remove"], e["put"])
                out.append((tree.text(), tree.total, before, tree.reencoded - done, tree.rebuilt, tree.keep()))
            yield pa.RecordBatch.from_arrays([b.column(0), *[pa.array([r[i] for r in out], k) for i, k in enumerate(kinds)], *b.columns[4:]], [*names, *passed])

    schema = f"doc_id long, text string, n_tokens long, n_tokens_before long, n_reencoded long, rebuilt boolean, tree {TREE}"
    more = "".join(f", `{c}` {docs.schema[c].dataType.simpleString()}" for c in passed)
    return docs.select("doc_id", "text", "edits", kept.alias("tree"), *[F.col(f"`{c}`") for c in passed]).mapInArrow(run, schema + more)
