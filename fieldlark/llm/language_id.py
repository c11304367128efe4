"""Language identification by segmentation-marginalised unigram models.

Each language has probabilities for the pieces of one fixed public vocabulary. The
probability of a word is the sum over all its segmentations into pieces, by the
forward algorithm; the log-probabilities of a text's words add up, and the
posterior over languages at equal priors is the score. The piece probabilities
come from expectation-maximisation over all segmentations, as Spark jobs on word
counts of a bounded sample of labelled rows.

Only letters (Unicode category L) count: a text is lower-cased and cut into runs of
letters, each with the vocabulary's word mark in front. A run over 48 letters is
scored in stretches of 48. A letter that is no piece has the probability ``least`` in
each language, and no piece has less, so a stretch has at least ``least`` to the 49th
power and no probability underflows.

Edge cases. A text that is null or has no letter gets ``und`` and score 0; so do
all where nothing could be learned. A language none of whose texts has a letter
is not learned. Ties go to the first language in alphabetical
order. Rows are independent: one row out for each row in.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterable, Iterator
from dataclasses import dataclass, field

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from fieldlark.llm.common import cut, text_batches, with_columns

_RUN = re.compile(r"[^\W\d_]+")
_MARK, _LONGEST, _BASE = "▁", 48, 0x9E3779B97F4A7C15
_CACHE = 300_000
_LOADED: dict[str, Vocabulary] = {}


def default_vocabulary() -> str:
    import public_tokenizers

    return public_tokenizers.path("piece_bpe_32k.model")


@dataclass(frozen=True)
class LanguageId:
    """``per_language`` bounds the distinct labelled texts of a language that are learned from (about as many are taken).

    The labels are a small set by nature: the model holds a row of the vocabulary's size for each language.
    """

    per_language: int = 1_000
    rounds: int = 2
    least: float = 1e-6
    smoothing: float = 0.05
    vocabulary: str = field(default_factory=default_vocabulary)


class Vocabulary:
    """Finds the pieces in many words at once, by rolling hashes of code points."""

    def __init__(self, path: str):
        import sentencepiece

        sp = sentencepiece.SentencePieceProcessor(model_file=path)
        names = [sp.id_to_piece(i) for i in range(sp.get_piece_size()) if not (sp.is_control(i) or sp.is_unknown(i) or sp.is_byte(i))]
        names = [n for n in names if n.removeprefix(_MARK).isalpha() or n == _MARK]
        keys = np.array([self._hash(n) for n in names], np.uint64)
        self.keys, at = np.unique(keys, return_index=True)
        self.size, self.longest = len(self.keys), max(len(names[i]) for i in at)
        self.filled = np.zeros(1 << 18, bool)
        self.filled[self._slot(self.keys)] = True

    @staticmethod
    def _hash(piece: str) -> int:
        h, power = 0, 1
        for c in reversed(piece):
            h, power = (h + ord(c) * power) % 2**64, power * _BASE % 2**64
        return h

    @staticmethod
    def _slot(h: np.ndarray) -> np.ndarray:
        return ((h ^ (h >> np.uint64(29))) * np.uint64(0xBF58476D1CE4E5B9)) >> np.uint64(46)

    def lattice(self, words: list[str]) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
        """(start, end, rows, piece ids) for words of one length; an unknown letter is piece ``size``."""
        chars = np.array([list(map(ord, w)) for w in words], np.uint64)
        for end in range(1, chars.shape[1] + 1):
            h, power = np.zeros(len(words), np.uint64), 1
            for start in range(end - 1, max(-1, end - 1 - self.longest), -1):
                h = h + chars[:, start] * np.uint64(power)
                power = power * _BASE % 2**64
                rows = np.flatnonzero(self.filled[self._slot(h)])
                at = np.minimum(np.searchsorted(self.keys, h[rows]), self.size - 1)
                ok = self.keys[at] == h[rows]
                rows, ids = rows[ok], at[ok]
                if start == end - 1 and len(rows) < len(words):
                    known = np.full(len(words), self.size)
                    known[rows] = ids
                    rows, ids = np.arange(len(words)), known
                if len(rows):
                    yield start, end, rows, ids


def vocabulary(path: str) -> Vocabulary:
    if path not in _LOADED:
        _LOADED[path] = Vocabulary(path)
    return _LOADED[path]


def words_of(text: str | None) -> list[str]:
    found = _RUN.findall(text.lower()) if text else []
    if not all(map(str.isalpha, found)):
        # Numerals that the pattern takes for letters, such as those in rings or Roman ones.
        found = [w for f in found for w in "".join(c if c.isalpha() else " " for c in f).split()]
    if any(len(w) > _LONGEST for w in found):
        found = [w[i : i + _LONGEST] for w in found for i in range(0, len(w), _LONGEST)]
    return found


def by_length(words: list[str], most: int = 20_000) -> Iterator[tuple[np.ndarray, list[str]]]:
    size = np.fromiter(map(len, words), np.int64, len(words))
    for n in np.unique(size):
        rows = np.flatnonzero(size == n)
        for i in range(0, len(rows), most):
            yield rows[i : i + most], [_MARK + words[k] for k in rows[i : i + most]]


def log_probabilities(words: list[str], v: Vocabulary, p: np.ndarray) -> np.ndarray:
    """Words by languages; ``p`` is languages by pieces, with the unknown piece last. The forward algorithm."""
    out, p = np.empty((len(words), len(p))), np.ascontiguousarray(p.T)
    # As many words at a time as four languages have room for.
    for rows, some in by_length(words, max(1, 80_000 // max(1, p.shape[1]))):
        alpha = np.zeros((len(some[0]) + 1, len(some), p.shape[1]))
        alpha[0] = 1
        for start, end, at, ids in v.lattice(some):
            alpha[end, at] += alpha[start, at] * p[ids]
        out[rows] = np.log(alpha[-1])
    return out


def expected_pieces(words: list[str], counts: np.ndarray, v: Vocabulary, p: np.ndarray) -> np.ndarray:
    """Expected uses of each piece over all segmentations of the words: forward and backward."""
    out = np.zeros(v.size + 1)
    for rows, some in by_length(words):
        edges = list(v.lattice(some))
        alpha, beta = (np.zeros((len(some[0]) + 1, len(some))) for _ in range(2))
        alpha[0], beta[-1] = 1, 1
        for start, end, at, ids in edges:
            alpha[end, at] += alpha[start, at] * p[ids]
        for start, end, at, ids in sorted(edges, key=lambda e: -e[1]):
            beta[start, at] += beta[end, at] * p[ids]
        weight = counts[rows] / alpha[-1]
        for start, end, at, ids in edges:
            out += np.bincount(ids, alpha[start, at] * p[ids] * beta[end, at] * weight[at], v.size + 1)
    return out


def _smoothed(uses: np.ndarray, smoothing: float, least: float) -> np.ndarray:
    """Probabilities of the pieces, none under ``least``; the unknown letter's behind them."""
    p = uses[:-1] + smoothing
    return np.append(least + (1 - least * len(p)) * p / p.sum(), least)


@dataclass(frozen=True)
class Model:
    languages: list[str]
    pieces: np.ndarray
    vocabulary: str


def held_out(doc_id: Column) -> Column:
    return F.coalesce(F.pmod(F.crc32(doc_id.cast("string").cast("binary")), F.lit(4)) == 2, F.lit(False))


def learn(labelled: DataFrame, o: LanguageId | None = None, text: str = "text", lang: str = "lang") -> Model:
    """Piece probabilities of each language, from a bounded sample of the distinct texts that have a language.

    Texts are drawn by their hash and each counts once, however often it is copied; a language of few texts is taken whole.
    """
    o = o or LanguageId()
    rows = labelled.select(F.col(lang).cast("string").alias("lang"), F.col(text).cast("string").alias("text")).where("lang is not null and text is not null")
    rows = rows.withColumn("h", F.xxhash64("text"))
    # A row for each language comes to the driver here.
    sizes = rows.groupBy("lang").agg(F.approx_count_distinct("h", 0.02).alias("texts")).collect()
    if not sizes:
        return Model([], np.zeros((0, 1)), o.vocabulary)
    share = F.create_map(*[F.lit(x) for r in sizes for x in (r["lang"], min(1.0, o.per_language / r["texts"]))])
    sample = rows.where(F.pmod("h", F.lit(1_000_003)) < F.try_element_at(share, F.col("lang")) * 1_000_003)
    sample = sample.dropDuplicates(["lang", "h"]).select("lang", "text")

    def count(frames: Iterable[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for f in frames:
            for name, g in f.groupby("lang"):
                n = Counter(w for t in g.text for w in words_of(t))
                if n:
                    yield pd.DataFrame({"lang": name, "word": list(n), "n": list(n.values())})

    counts = sample.mapInPandas(count, "lang string, word string, n long").groupBy("lang", "word").agg(F.sum("n").alias("n"))
    counts = cut(counts)
    # A row for each language comes to the driver, and the vocabulary for each below.
    names = sorted(r["lang"] for r in counts.select("lang").distinct().collect())
    if not names:
        return Model([], np.zeros((0, 1)), o.vocabulary)
    v = vocabulary(o.vocabulary)
    pieces = {n: _smoothed(np.ones(v.size + 1), 0, o.least) for n in names}
    for _ in range(o.rounds):

        def expect(frames: Iterable[pd.DataFrame], pieces: dict = pieces) -> Iterator[pd.DataFrame]:
            v, uses = vocabulary(o.vocabulary), {}
            for f in frames:
                for name, g in f.groupby("lang"):
                    new = expected_pieces(g.word.tolist(), g.n.to_numpy(), v, pieces[name])
                    uses[name] = uses.get(name, 0) + new
            for name, u in uses.items():
                at = np.flatnonzero(u)
                yield pd.DataFrame({"lang": name, "piece": at, "uses": u[at]})

        got = counts.mapInPandas(expect, "lang string, piece int, uses double").groupBy("lang", "piece").agg(F.sum("uses").alias("uses")).toPandas()
        pieces = {n: np.zeros(v.size + 1) for n in names}
        for name, g in got.groupby("lang"):
            pieces[name][g.piece] = g.uses
        pieces = {n: _smoothed(u, o.smoothing, o.least) for n, u in pieces.items()}
    return Model(names, np.stack([pieces[n] for n in names]), o.vocabulary)


class _Scores:
    """Log-probabilities of words seen in this task, forgotten when there are too many."""

    def __init__(self, model: Model):
        self.v, self.p = vocabulary(model.vocabulary), model.pieces
        self.at: dict[str, int] = {}
        self.found = np.empty((0, len(model.languages)))

    def of(self, words: list[str]) -> np.ndarray:
        new = [w for w in dict.fromkeys(words) if w not in self.at]
        if len(self.at) + len(new) > 4 * _CACHE // max(4, len(self.p)):
            self.at.clear()
            self.found, new = self.found[:0], list(dict.fromkeys(words))
        self.at.update(zip(new, range(len(self.at), len(self.at) + len(new)), strict=True))
        self.found = np.concatenate([self.found, log_probabilities(new, self.v, self.p)])
        return self.found[np.fromiter(map(self.at.__getitem__, words), np.int64, len(words))]


def identify(docs: DataFrame, model: Model, text: str = "text", names: tuple[str, str] = ("lang_pred", "score")) -> DataFrame:
    """``docs`` with the language and its posterior in columns of these names; others of the same names are replaced."""
    kept = [c for c in docs.columns if c not in names]
    schema = docs.select(*kept).schema.add(names[0], "string").add(names[1], "double")

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scores = _Scores(model)
        for b in text_batches(batches, text, 2_000_000):
            words = [words_of(t) for t in b.column(text).to_pylist()]
            size = np.fromiter(map(len, words), np.int64, len(words))
            name, top = np.full(len(words), "und", object), np.zeros(len(words))
            some = np.flatnonzero(size) if model.languages else np.zeros(0, np.int64)
            if len(some):
                each = scores.of([w for ws in words for w in ws])
                total = np.add.reduceat(each, np.concatenate(([0], np.cumsum(size[some])[:-1])), axis=0)
                odds = np.exp(total - total.max(axis=1, keepdims=True))
                name[some] = np.array(model.languages, object)[odds.argmax(axis=1)]
                top[some] = 1 / odds.sum(axis=1)
            yield with_columns(b, {names[0]: pa.array(name, pa.string()), names[1]: pa.array(top)})

    return docs.select(*kept).mapInArrow(run, schema)


def predict(docs: DataFrame, o: LanguageId | None = None) -> DataFrame:
    """doc_id, held_out, lang_pred, score: learns from rows that are not held out, and predicts all."""
    model = learn(docs.where(~held_out(F.col("doc_id")) & F.col("doc_id").isNotNull()), o)
    return identify(docs.select("doc_id", F.col("text").cast("string").alias("text")), model).select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "lang_pred", "score")
