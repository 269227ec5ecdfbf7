"""Language ID by segmentation-marginalised unigrams.

A language is a probability for each piece of a fixed public vocabulary. A word's probability is the sum over all
its segmentations into pieces, by a forward algorithm; a text's is the product over its words. The piece
probabilities of each language are learned by expectation maximisation over all segmentations of its sample.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import small_batches, uniform

#: Place of the vocabulary, a parameter of ``train``.
VOCABULARY = "/opt/tokenizers/piece_bpe_32k.model"
#: Documents of a language that are learned from, at most about; and characters of such a document at most.
SAMPLE_DOCS, SAMPLE_CHARS = 400, 40_000
#: Languages that are learned, at most: the most frequent.
MAX_LANGUAGES = 200
#: Tokens whose scores a Python worker keeps, at most about.
WORD_CACHE = 500_000
#: Characters up to which words are scored together; longer ones one by one.
SHORT = 48
_LETTERS = re.compile(r"[^\W\d_]+")


def _letters(word: str) -> bool:
    return any(map(str.isalpha, word))


class Pieces:
    """The vocabulary's pieces by text; a word starts with the mark ▁. Piece 0 is any character without a piece."""

    def __init__(self, texts: list[str]):
        self.ids = {t: i + 1 for i, t in enumerate(t for t in texts if t and not re.fullmatch(r"<.*>", t))}
        self.n = len(self.ids) + 1
        self.longest = max(map(len, self.ids), default=1)

    @classmethod
    def load(cls, path: str) -> Pieces:
        import sentencepiece

        sp = sentencepiece.SentencePieceProcessor(model_file=path)
        return cls([sp.id_to_piece(i) for i in range(sp.get_piece_size())])

    def table(self) -> tuple[np.ndarray, np.ndarray]:
        """Keys and ids of an open hash table of the pieces."""
        if not hasattr(self, "_table"):
            keys, ids = np.zeros(1 << _BITS, np.uint64), np.full(1 << _BITS, self.n, np.int32)
            for text, i in self.ids.items():
                h = np.uint64(0)
                for c in text:
                    h = _add(h, np.uint64(ord(c)))
                at = int(_slot(h))
                while keys[at]:
                    at = (at + 1) % (1 << _BITS)
                keys[at], ids[at] = h, i
            self._table = keys, ids
        return self._table

    def find(self, h: np.ndarray) -> np.ndarray:
        """The pieces of hashes, n for none."""
        keys, ids = self.table()
        at = _slot(h)
        there = keys[at]
        out = np.where(there == h, ids[at], self.n)
        todo = np.flatnonzero((there != h) & (there != 0))
        at = (at[todo] + 1) & ((1 << _BITS) - 1)
        while len(todo):
            there, want = keys[at], h[todo]
            hit = there == want
            out[todo[hit]] = ids[at[hit]]
            go = ~hit & (there != 0)
            todo, at = todo[go], (at[go] + 1) & ((1 << _BITS) - 1)
        return out


_BITS = 18


def _add(h, code):
    with np.errstate(over="ignore"):
        return (h + code + np.uint64(1)) * np.uint64(0x9E3779B97F4A7C15) ^ (code << np.uint64(17))


def _slot(h):
    with np.errstate(over="ignore"):
        return ((h ^ (h >> np.uint64(31))) * np.uint64(0xD6E8FEB86659FD93) >> np.uint64(64 - _BITS)).astype(np.int64)


class Grid:
    """All pieces in words of one length: ids[l - 1][word, begin] is the piece of l characters there."""

    def __init__(self, pieces: Pieces, words: list[str]):
        self.n, self.size = len(words), len(words[0]) + 1
        codes = np.array(["▁" + w for w in words], f"U{self.size}").view(np.uint32).reshape(self.n, self.size).astype(np.uint64)
        h, self.ids = np.zeros_like(codes), []
        for length in range(1, min(self.size, pieces.longest) + 1):
            h = _add(h[:, : self.size - length + 1], codes[:, length - 1 :])
            found = pieces.find(h.ravel()).reshape(h.shape)
            if length == 1:
                found[found == pieces.n] = 0
            self.ids.append(found if (found < pieces.n).any() else None)

    def forward(self, prob: np.ndarray) -> np.ndarray:
        """alpha[end, word, language] of probabilities prob[piece, language], whose last row is 0 for no piece."""
        alpha = np.zeros((self.size + 1, self.n, prob.shape[1]))
        alpha[0] = 1
        for e in range(1, self.size + 1):
            for length in range(1, min(e, len(self.ids)) + 1):
                if self.ids[length - 1] is not None:
                    alpha[e] += alpha[e - length] * prob[self.ids[length - 1][:, e - length]]
        return alpha

    def expected(self, prob: np.ndarray, weight: np.ndarray) -> np.ndarray:
        """Expected piece counts of one language over all segmentations, words counted by weight."""
        alpha = self.forward(prob[:, None])[:, :, 0]
        beta, counts = np.zeros_like(alpha), np.zeros(len(prob))
        beta[-1] = weight / np.maximum(alpha[-1], 1e-300)
        for e in range(self.size, 0, -1):
            for length in range(1, min(e, len(self.ids)) + 1):
                if self.ids[length - 1] is not None:
                    p = self.ids[length - 1][:, e - length]
                    flow = prob[p] * beta[e]
                    beta[e - length] += flow
                    counts += np.bincount(p, alpha[e - length] * flow, len(prob))
        return counts


def grids(pieces: Pieces, words: list[str], most: int = 8192) -> Iterator[tuple[list[int], Grid]]:
    """Grids of the words by length, with the numbers of their words."""
    by: dict[int, list[int]] = {}
    for i, w in enumerate(words):
        by.setdefault(len(w), []).append(i)
    for at in by.values():
        for i in range(0, len(at), most):
            yield at[i : i + most], Grid(pieces, [words[j] for j in at[i : i + most]])


class _Numbered(dict):
    """Gives each new token the next number, and notes it in ``new``."""

    def __missing__(self, token: str) -> int:
        self[token] = n = len(self)
        self.new.append(token)
        return n


class Model:
    """Languages, their piece log-probabilities, and the score of words and texts."""

    def __init__(self, pieces: Pieces, langs: list[str], prob: np.ndarray):
        self.pieces, self.langs, self.prob = pieces, langs, prob

    def word_scores(self, words: list[str]) -> np.ndarray:
        """Log-probabilities (words x languages); zeros for a word without a letter."""
        out = np.zeros((len(words), len(self.langs)))
        short = [i for i, w in enumerate(words) if len(w) < SHORT and _letters(w)]
        for at, grid in grids(self.pieces, [words[i] for i in short]):
            out[[short[i] for i in at]] = np.log(np.maximum(grid.forward(self.prob)[-1], 1e-300))
        for i, w in enumerate(words):
            if len(w) >= SHORT and _letters(w):
                out[i] = self._long(w)
        return out

    def _long(self, word: str) -> np.ndarray:
        """The forward algorithm with a scale at each position, for words of any length."""
        w, get, longest = "▁" + word, self.pieces.ids.get, self.pieces.longest
        recent = [np.ones(len(self.langs))]  # of the last positions, latest first
        scale = np.zeros(len(self.langs))
        for e in range(1, len(w) + 1):
            total = np.zeros(len(self.langs))
            for length, before in enumerate(recent, 1):
                p = get(w[e - length : e], 0 if length == 1 else None)
                if p is not None:
                    total += before * self.prob[p]
            recent = [total, *recent[: longest - 1]]
            if e % 16 == 0:
                top = np.maximum(np.max(recent, axis=0), 1e-300)
                recent = [x / top for x in recent]
                scale += np.log(top)
        return scale + np.log(np.maximum(recent[0], 1e-300))

    def token_scores(self, tokens: list[str]) -> np.ndarray:
        """As word_scores, for what stands between white space: the sums over its runs of letters."""
        runs = [(i, w) for i, t in enumerate(tokens) for w in ([t] if t.isalpha() else _LETTERS.findall(t))]
        words = sorted({w for _, w in runs})
        number = {w: i for i, w in enumerate(words)}
        out = np.zeros((len(tokens), len(self.langs)))
        if runs:
            np.add.at(out, [i for i, _ in runs], self.word_scores(words)[[number[w] for _, w in runs]])
        return out

    def scorer(self):
        """texts -> (language or "und", probability of it) with a bounded cache of word scores."""
        cache, new = _Numbered(), []
        cache.new = new
        table = np.zeros((1024, len(self.langs)))

        def score(texts: list[str | None]) -> tuple[list[str], list[float]]:
            nonlocal table
            if len(cache) > WORD_CACHE:
                cache.clear()
            start = len(cache)
            found = [np.fromiter(map(cache.__getitem__, ws), np.int64, len(ws)) if (ws := t.lower().split() if t else []) else None for t in texts]
            if new:
                end = len(cache)
                if end > len(table):
                    table = np.concatenate([table, np.zeros((end - len(table) // 2, len(self.langs)))])
                table[start:end] = self.token_scores(new)
                new.clear()
            langs, probs = [], []
            for at in found:
                total = table[at].sum(0) if at is not None else None
                if total is None or not len(self.langs) or not total.any():
                    langs.append("und")
                    probs.append(0.0)
                    continue
                best = int(total.argmax())
                langs.append(self.langs[best])
                probs.append(float(1 / np.exp(total - total[best]).sum()))
            return langs, probs

        return score


def fit(counts: dict[str, Counter], pieces: Pieces, rounds: int = 3, smooth: float = 0.05) -> Model:
    """Piece probabilities of each language from its word counts, by rounds of expectation maximisation."""
    langs, columns = sorted(counts), []
    for lang in langs:
        words = [w for w in counts[lang] if len(w) < SHORT]
        weight = np.array([counts[lang][w] for w in words], float)
        parts = [(grid, weight[at]) for at, grid in grids(pieces, words)]
        prob = np.append(np.full(pieces.n, 1 / pieces.n), 0.0)
        for _ in range(rounds):
            got = sum((grid.expected(prob, w) for grid, w in parts), np.zeros(pieces.n + 1))[:-1] + smooth
            prob = np.append(got / got.sum(), 0.0)
        columns.append(prob[:, None])
    return Model(pieces, langs, np.concatenate(columns, axis=1) if columns else np.zeros((pieces.n + 1, 0)))


def train(docs: DataFrame, where: Column | None = None, vocabulary: str = VOCABULARY, sample_docs: int = SAMPLE_DOCS, sample_chars: int = SAMPLE_CHARS, max_languages: int = MAX_LANGUAGES) -> Model:
    """Learn from a bounded sample of the labelled rows (text, lang) of ``docs`` that meet ``where``.

    Of each of the ``max_languages`` most frequent labels at most ``sample_docs`` distinct texts are learned from, those
    of the smallest hashes, each once and up to ``sample_chars`` characters. Null labels and texts are left out, and
    texts without letters if there are others.
    """
    known = docs.where(F.col("lang").isNotNull() & F.col("text").isNotNull())
    if where is not None:
        known = known.where(where)
    known = known.select("lang", F.substring("text", 1, sample_chars).alias("text"))
    known = known.select("lang", "text", F.xxhash64("text").alias("h"), F.col("text").rlike("\\p{L}").alias("letters"))
    about = [F.approx_count_distinct(F.when(F.col("letters"), F.col("h"))).alias("n"), F.approx_count_distinct("h").alias("n_all")]
    sizes = known.groupBy("lang").agg(F.count("*").alias("count"), *about).orderBy(F.desc("count"), "lang").limit(max_languages).collect()
    counts: dict[str, Counter] = {r["lang"]: Counter() for r in sizes}
    if counts:
        # four times the sample of each label by random numbers of its texts, before anything is moved; then the smallest
        rate = F.create_map(*[F.lit(x) for r in sizes for x in (r["lang"], min(1.0, 4.0 * sample_docs / max(r["n"] or r["n_all"], 1)))])
        worded = [r["lang"] for r in sizes if r["n"]]
        some = known.where(F.col("lang").isin(list(counts)) & (uniform(F.col("h"), "langid") < rate[F.col("lang")]))
        texts = some.where(F.col("letters") | ~F.col("lang").isin(worded)).groupBy("lang", "h").count()
        place = F.row_number().over(Window.partitionBy("lang").orderBy(uniform(F.col("h"), "langid"), "h"))
        # at most sample_docs rows of each of max_languages labels
        chosen = texts.withColumn("n", place).where(F.col("n") <= sample_docs).select("lang", "h")
        sample = some.join(F.broadcast(chosen), ["lang", "h"]).groupBy("lang", "h").agg(F.max("text").alias("text"))
        for lang, _, text in sample.toLocalIterator():
            counts[lang].update(w for w in _LETTERS.findall(text.lower()) if _letters(w))
    return fit({k: v for k, v in counts.items() if v}, Pieces.load(vocabulary))


def predict(docs: DataFrame, model: Model, text: str = "text") -> Column:
    """A struct (lang_pred, score) of a text column: the likeliest language, and its share of all languages' likelihood.

    Null texts and texts without letters, and all texts if no language was learned, get (und, 0). Whole texts count;
    rows that repeat are judged alike, and other columns take no part.
    """
    small_batches(docs.sparkSession)
    shared = docs.sparkSession.sparkContext.broadcast(model)

    @F.pandas_udf("lang_pred string, score double")
    def run(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        score = shared.value.scorer()
        for b in batches:
            langs, probs = score(b.tolist())
            yield pd.DataFrame({"lang_pred": langs, "score": probs})

    # said to be nondeterministic, as a filter on the result would otherwise be pushed down with a second evaluation
    return run.asNondeterministic()(F.col(text))

