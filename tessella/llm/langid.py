"""Operator 1: language identification by segmentation-marginalised unigrams.

Each language has a probability for each piece of a fixed public vocabulary.
The probability of a word is the sum, over all its segmentations into pieces,
of the products of their probabilities, by the forward algorithm; a text's is
the product over its words.  The piece probabilities are fitted by expectation
maximisation: forward and backward sums give the expected number of uses of
each piece in the training words.

Words are letters only, in lower case.  A letter that no piece spells has the
same small probability in all languages.  A word of 64 letters or more (text
without spaces is one) is predicted whole, and learned from in consecutive
spans of 64 with the mark of its start.  Languages are equally likely before
the text is read.

Training words come from at most about ``max_docs`` labelled documents of each
language, those whose ids hash lowest: a bounded sample to fit a classifier.
What the driver gathers is a number for each language and piece.  Every
document is predicted from its whole text: a task scores each different word
it meets once and keeps up to ``CACHE_WORDS`` of them.

Defined cases: null and letterless texts are ``und`` with score 0; without any
labelled document everything is ``und``; ties go to the first language in
order; repeated rows are predicted each; null languages aren't learned.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass
from functools import cached_property

import numpy as np
import pyarrow as pa
import sentencepiece
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from . import common

CACHE_WORDS = 200_000
START = "▁"  # the vocabulary's mark of a word's start
#: Probability of a letter that no piece spells.
UNKNOWN = 1e-7
#: Letters of a span, with the mark of a word's start, in which longer words are learned from.
SPAN = 64
#: Base of the hashes of spellings (any odd number of 64 bits).
HASH_BASE = np.uint64(0x9E3779B97F4A7C15)


@dataclass(frozen=True)
class LanguageModel:
    """Languages in order, and the probability of each piece (rows) in each of them."""

    languages: list[str]
    pieces: dict[str, int]
    probabilities: np.ndarray

    @cached_property
    def spellings(self) -> _Pieces:
        return _Pieces(self.pieces)


def vocabulary(path: str) -> dict[str, int]:
    """Pieces of lower-case letters, with or without the mark of a start."""
    model = sentencepiece.SentencePieceProcessor(model_file=path)
    texts = (model.id_to_piece(i) for i in range(model.get_piece_size()))
    kept = sorted({t for t in texts if t == START or (b := t.removeprefix(START)).isalpha() and b == b.lower()})
    return {t: i for i, t in enumerate(kept)}


def letters(word: str) -> str:
    return word.lower() if word.isalpha() else "".join(filter(str.isalpha, word)).lower()


def _codes(texts: list[str]) -> np.ndarray:
    """Code points, a row for each text, with zeros after its end."""
    return np.array(texts).view(np.uint32).reshape(len(texts), -1)


def _spelling_hashes(codes: np.ndarray, longest: int) -> Iterator[np.ndarray]:
    """For each length, hashes of the letters that end at each place; those of a length start at its first possible end."""
    hashes = np.ones(codes.shape, np.uint64)
    for k in range(1, min(longest, codes.shape[1]) + 1):
        hashes = (hashes if k == 1 else hashes[:, :-1]) * HASH_BASE + codes[:, k - 1 :]
        yield hashes


class _Pieces:
    """Finds pieces by 64-bit hashes of their letters; a table of bits turns most other spellings away."""

    def __init__(self, pieces: dict[str, int]):
        self.longest = max(map(len, pieces), default=1)
        own = np.zeros(len(pieces), np.uint64)
        if pieces:
            sizes = np.array([len(x) for x in pieces])
            for k, hashes in enumerate(_spelling_hashes(_codes(list(pieces)), self.longest), 1):
                own[sizes == k] = hashes[sizes == k, 0]
        order = np.argsort(own)
        self.hashes, self.ids = own[order], np.fromiter(pieces.values(), np.int32, len(pieces))[order]
        self.known = np.zeros(1 << 20, bool)
        self.known[own >> np.uint64(44)] = True

    def lattice(self, words: list[str], unknown: int) -> np.ndarray:
        """Piece that ends at each place with each length (words x places x lengths), or -1."""
        codes = _codes(words)
        found = np.full((*codes.shape, self.longest), -1, np.int32)
        for k, hashes in enumerate(_spelling_hashes(codes, self.longest), 1):
            row, end = np.nonzero(self.known[hashes >> np.uint64(44)])
            wanted = hashes[row, end]
            at = np.minimum(np.searchsorted(self.hashes, wanted), max(len(self.hashes) - 1, 0))
            same = self.hashes[at] == wanted
            found[row[same], end[same] + k - 1, k - 1] = self.ids[at[same]]
        found[..., 0][(found[..., 0] < 0) & (codes > 0)] = unknown
        return found


def _forward(found: np.ndarray, sizes: np.ndarray, table: np.ndarray) -> np.ndarray:
    """Log-probabilities of words in each language.

    ``table``: probabilities with rows for the unknown letter and, last, for no piece (0).
    """
    words, n, longest = found.shape
    languages = table.shape[1]
    alpha = np.zeros((n + 1, words, languages))
    alpha[0] = 1
    scale = np.zeros((n + 1, words, languages))
    for j in range(1, n + 1):
        total = np.zeros((words, languages))
        for k in range(1, min(longest, j) + 1):
            total += alpha[j - k] * table[found[:, j - 1, k - 1]]
        scale[j] = scale[j - 1]
        if j % 8 == 0:  # rescale the window, so that long words don't underflow
            most = np.where(total > 0, total, 1.0)
            alpha[max(0, j - longest) : j] /= most
            total /= most
            scale[j] += np.log(most)
        alpha[j] = total
    rows = np.arange(words)
    with np.errstate(divide="ignore"):
        return np.log(alpha[sizes, rows]) + scale[sizes, rows]


def word_log_probabilities(words: list[str], model: LanguageModel) -> np.ndarray:
    """log P(word) in each language, summed over all segmentations."""
    table = np.vstack([model.probabilities, np.full((1, len(model.languages)), UNKNOWN), np.zeros((1, len(model.languages)))])
    out = np.zeros((len(words), len(model.languages)))
    for rows, found, sizes in _lattices([START + w for w in words], model.spellings, len(model.pieces)):
        out[rows] = _forward(found, sizes, table)
    return out


def _lattices(marked: list[str], pieces: _Pieces, unknown: int) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """Marked words of similar length together."""
    order = sorted(range(len(marked)), key=lambda i: len(marked[i]))
    at = 0
    while at < len(order):
        to = at + 1
        while to < len(order) and (to - at) * len(marked[order[to]]) * pieces.longest < 1 << 19 and len(marked[order[to]]) <= len(marked[order[at]]) + 2:
            to += 1
        own = order[at:to]
        texts = [marked[i] for i in own]
        yield np.array(own), pieces.lattice(texts, unknown), np.array([len(t) for t in texts])
        at = to


def _spans(words: list[str]) -> tuple[list[str], np.ndarray]:
    """Marked words, those of more than SPAN letters cut into consecutive spans, and the word of each."""
    spans = [(i, m[a : a + SPAN]) for i, m in enumerate(START + w for w in words) for a in range(0, len(m), SPAN)]
    return [t for _, t in spans], np.array([i for i, _ in spans], np.int64)


def _expected(words: list[str], counts: np.ndarray, model: LanguageModel) -> np.ndarray:
    """Expected uses of the pieces, for words with counts in each language."""
    longest = model.spellings.longest
    unknown, nothing = len(model.pieces), len(model.pieces) + 1
    table = np.vstack([model.probabilities, np.full((1, len(model.languages)), UNKNOWN), np.zeros((1, len(model.languages)))])
    uses = np.zeros((len(model.pieces) + 2, len(model.languages)))
    texts, of = _spans(words)
    for rows, found, sizes in _lattices(texts, model.spellings, unknown):
        w, n, _ = found.shape
        found = np.where(found < 0, nothing, found)

        def sums(tilt: np.ndarray, found: np.ndarray = found, sizes: np.ndarray = sizes, w: int = w, n: int = n) -> tuple[np.ndarray, np.ndarray]:
            alpha = np.zeros((n + 1, w, table.shape[1]))
            beta = np.zeros_like(alpha)
            alpha[0], beta[sizes, np.arange(w)] = 1, 1
            for j in range(1, n + 1):
                for k in range(1, min(longest, j) + 1):
                    alpha[j] += alpha[j - k] * (table[found[:, j - 1, k - 1]] * tilt[k])
            for j in range(n, 0, -1):
                for k in range(1, min(longest, j) + 1):
                    beta[j - k] += beta[j] * (table[found[:, j - 1, k - 1]] * tilt[k])
            return alpha, beta

        tilt = np.ones((longest + 1, 1, 1))
        alpha, beta = sums(tilt)
        if (beta[0] < 1e-250).any():  # a factor for each letter, which cancels, brings the whole to 1
            with np.errstate(over="ignore"):
                factor = np.exp(-_forward(found, sizes, table) / sizes[:, None])
            tilt = np.where(np.isfinite(factor), factor, 1.0)[None] ** np.arange(longest + 1)[:, None, None]
            alpha, beta = sums(tilt)
        weight = counts[of[rows]] / np.maximum(beta[0], 1e-300)
        for j in range(1, n + 1):
            for k in range(1, min(longest, j) + 1):
                at = found[:, j - 1, k - 1]
                np.add.at(uses, at, alpha[j - k] * (table[at] * tilt[k]) * beta[j] * weight)
    return uses[:-2]


_SPACES = re.compile(r"[\x20\x09-\x0D]+")


def _count_words(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    counts: Counter = Counter()

    def out() -> pa.RecordBatch:
        rows = list(counts.items())
        return pa.RecordBatch.from_pydict({"lang": [k[0] for k, _ in rows], "word": [k[1] for k, _ in rows], "n": [n for _, n in rows]}, schema=pa.schema([("lang", pa.string()), ("word", pa.string()), ("n", pa.int64())]))

    for batch in common.slices(batches):
        for lang, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
            counts.update((lang, w) for w in map(letters, _SPACES.split(text or "")) if w)  # words as in prediction
            if len(counts) > CACHE_WORDS:
                yield out()
                counts.clear()
    yield out()


def fit(docs: DataFrame, train: Column, vocabulary_path: str, *, max_docs: int = 1000, rounds: int = 3, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang") -> LanguageModel:
    """Fit piece probabilities to the training documents (those where ``train`` holds)."""
    pieces = vocabulary(vocabulary_path)
    labelled = docs.where(train & F.col(lang_col).isNotNull() & F.col(text_col).isNotNull())
    labelled = labelled.select(F.col(lang_col).cast("string").alias("lang"), F.col(text_col).alias("text"), F.pmod(F.xxhash64(F.col(id_col).cast("string")), F.lit(1 << 30)).alias("place"))
    shares = labelled.groupBy("lang").count().select(F.col("lang").alias("l"), (F.lit(float(max_docs << 30)) / F.col("count")).alias("below"))
    sample = labelled.join(F.broadcast(shares), F.col("lang") == F.col("l")).where("place < below")  # a row for each language
    words = sample.select("lang", "text").mapInArrow(_count_words, "lang string, word string, n long").groupBy("lang", "word").agg(F.sum("n").alias("n"))
    words = common.checkpoint(words)
    languages = sorted(r[0] for r in words.select("lang").distinct().collect())
    model = LanguageModel(languages, pieces, np.full((len(pieces), len(languages)), 1.0 / max(len(pieces), 1)))
    for _ in range(rounds if languages else 0):

        def expect(batches: Iterator[pa.RecordBatch], model: LanguageModel = model) -> Iterator[pa.RecordBatch]:
            at = {x: i for i, x in enumerate(model.languages)}
            uses = np.zeros((len(model.pieces), len(model.languages)))
            for batch in batches:
                texts, n = batch.column(1).to_pylist(), batch.column(2).to_numpy()
                counts = np.zeros((len(texts), len(model.languages)))
                counts[np.arange(len(texts)), [at[x] for x in batch.column(0).to_pylist()]] = n
                uses += _expected(texts, counts, model)
            piece, lang = np.nonzero(uses)
            yield pa.RecordBatch.from_arrays([pa.array(piece), pa.array(lang), pa.array(uses[piece, lang])], names=["piece", "lang", "uses"])

        got = words.mapInArrow(expect, "piece long, lang long, uses double").groupBy("piece", "lang").agg(F.sum("uses").alias("uses")).toPandas()
        uses = np.full((len(pieces), len(languages)), 0.05)
        uses[got["piece"], got["lang"]] += got["uses"]
        model = LanguageModel(languages, pieces, uses / uses.sum(0))
    return model


class _Scorer:
    """Sums of word log-probabilities, by document, for columns of texts."""

    def __init__(self, model: LanguageModel):
        self.model = model
        self.rows: dict[int, int] = {}
        self.of_letters: dict[str, int] = {}
        self.table = np.zeros((0, len(model.languages) + 1))

    def _learn(self, hashes: list[int], words: list[str]) -> None:
        if len(self.rows) > CACHE_WORDS:
            self.rows.clear()
            self.of_letters.clear()
            self.table = self.table[:0]
        plain = [letters(w) for w in words]
        new = sorted({w for w in plain if w and w not in self.of_letters})
        got = np.zeros((len(new) + 1, self.table.shape[1]))  # the last column counts lettered words
        if new:
            got[:-1, :-1], got[:-1, -1] = word_log_probabilities(new, self.model), 1
        first = len(self.table)
        self.table = np.vstack([self.table, got])
        self.of_letters |= {w: first + i for i, w in enumerate(new)} | {"": first + len(new)}
        self.rows |= {h: self.of_letters[w] for h, w in zip(hashes, plain, strict=True)}

    def sums(self, column: pa.Array) -> np.ndarray:
        out = []
        for _, _, data, offsets in common.text_chunks(column):
            starts, ends, words = common.word_spans(data, offsets)
            unique, first, back = np.unique(common.span_hashes(data, starts, ends), return_index=True, return_inverse=True)
            keys = unique.tolist()
            missing = [k for k, h in enumerate(keys) if h not in self.rows]
            if missing:
                if len(self.rows) > CACHE_WORDS:
                    missing = range(len(keys))
                self._learn([keys[k] for k in missing], [data[starts[first[k]] : ends[first[k]]].tobytes().decode("utf-8", "replace") for k in missing])
            values = self.table[np.fromiter((self.rows[h] for h in keys), np.int64, len(keys))]
            doc = np.repeat(np.arange(len(words)), words)
            out.append(np.stack([np.bincount(doc, values[back, c], len(words)) for c in range(values.shape[1])], axis=1) if len(keys) else np.zeros((len(words), self.table.shape[1])))
        return np.concatenate(out) if out else np.zeros((0, self.table.shape[1]))


def predict(docs: DataFrame, model: LanguageModel, *, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, lang_pred and score, the share of the predicted language in the sum of all languages' probabilities."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scorer = _Scorer(model)
        names = np.array([*model.languages, "und"], object)
        for batch in common.slices(batches):
            sums = scorer.sums(batch.column(1))
            logs, known = sums[:, :-1], sums[:, -1] > 0
            if logs.shape[1]:
                best = logs.argmax(1)
                share = 1 / np.exp(logs - logs.max(1, keepdims=True)).sum(1)
            else:
                best, share, known = np.zeros(len(sums), int), np.zeros(len(sums)), known & False
            best = np.where(known, best, len(model.languages))
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(names[best], pa.string()), pa.array(np.where(known, share, 0.0))], names=["doc_id", "lang_pred", "score"])

    schema = T.StructType([T.StructField("doc_id", docs.schema[id_col].dataType), T.StructField("lang_pred", T.StringType()), T.StructField("score", T.DoubleType())])
    return docs.select(id_col, text_col).mapInArrow(run, schema)
