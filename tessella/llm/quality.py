"""Operator 10: quality rules with a hashed n-gram likelihood ratio.

Words and word pairs of a text are hashed to buckets.  Two multinomials over
the buckets are counted: one from all documents of the corpus, one from
trusted documents.  A document's score is the mean, over its features, of
log(trusted / raw), in whole millionths, so that it doesn't depend on the
order of summation; it is kept if the score reaches a threshold and no plain
rule fails it.

A few toxic words vanish in a mean over a long text, so a second ratio is taken
word by word: of the documents labelled toxic and those trusted, how many have
a word.  Words that clearly belong to the toxic ones, by 64-bit hashes, have a
weight, a document's ``worst`` is the least of its words (0 without such a
word), and it is kept only if that reaches a threshold of its own.

Labels: ``quality`` 1 and ``toxic`` 0 is trusted, anything else isn't.  At most
``max_labels`` labelled rows are used, those whose ids hash lowest.  Half of
them train the trusted multinomial; the other half, which it hasn't seen, fix
the threshold: of the scores that reject at most ``max_loss`` of the trusted
half, the one that best tells the two kinds apart; likewise for ``worst``, with
the toxic rows as the other kind.  The corpus is counted
whole.  The trusted multinomial is smoothed by ``prior`` features dealt as in
the raw corpus.

What a task sends on is a count for each bucket, whatever it has read.

Defined cases: a null or wordless text has no words and fails the word rule;
without trusted or without other labels, or with no label table, every document
that passes the plain rules is kept; repeated rows are judged each; null ids
are kept; labels that repeat an id count as trusted only if all agree.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass, field, replace

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from . import common

#: Buckets are 2 ** BITS.
BITS = 16
_SYMBOLS = np.zeros(256, np.int64)
_SYMBOLS[np.frombuffer(b"#*$%&|<>", np.uint8)] = 1
_A, _B = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xC2B2AE3D27D4EB4F)


@dataclass(frozen=True)
class Rules:
    """A text fails with fewer words, or with a greater share (percent) of words in repeated windows."""

    min_words: int = 50
    max_repeat_percent: int = 50


@dataclass(frozen=True)
class QualityModel:
    """Millionths of log(trusted / raw) by bucket, and the least mean that is kept (None: no verdict).

    ``words`` (ascending hashes) and ``weights``: the words of toxic documents
    with their log ratios; ``floor``: the least of them that is kept.
    """

    ratios: np.ndarray
    threshold: float | None
    rules: Rules
    words: np.ndarray = field(default_factory=lambda: np.zeros(0, np.uint64))
    weights: np.ndarray = field(default_factory=lambda: np.zeros(0))
    floor: float | None = None


#: Documents labelled toxic that have a word at least, the ratio from which on it counts, and documents of either kind that a word is taken to have besides.
TOXIC_DOCS, TOXIC_RATIO, EVEN_DOCS = 5, -2.0, 5.0


def _worst(model: QualityModel, h: np.ndarray, words: np.ndarray) -> np.ndarray:
    """The least weight of each document's words."""
    out = np.zeros(len(words))
    if len(model.words) and len(h):
        at = np.minimum(np.searchsorted(model.words, h), len(model.words) - 1)
        hit = np.flatnonzero(model.words[at] == h)
        np.minimum.at(out, np.repeat(np.arange(len(words)), words)[hit], model.weights[at[hit]])
    return out


def _features(data: np.ndarray, starts: np.ndarray, ends: np.ndarray, words: np.ndarray, h: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray]:
    """Buckets of words and of word pairs, in document order, and their number in each document; ``h``: the words' hashes, if known."""
    h = common.span_hashes(common.lower(data), starts, ends) if h is None else h
    shift = np.uint64(64 - BITS)
    if not len(h):
        return np.zeros(0, np.int64), np.zeros(len(words), np.int64)
    pairs = np.zeros(len(h), np.uint64)
    with np.errstate(over="ignore"):
        pairs[1:] = common.mix(h[:-1] * _A + h[1:])
    out = np.empty(2 * len(h), np.int64)
    out[0::2], out[1::2] = h >> shift, pairs >> shift
    first = np.cumsum(words) - words
    real = np.ones(2 * len(h), bool)
    real[2 * first[words > 0] + 1] = False  # a first word ends no pair
    return out[real], np.maximum(2 * words - 1, 0)


def _statistics(data: np.ndarray, offsets: np.ndarray, starts: np.ndarray, ends: np.ndarray, words: np.ndarray) -> dict[str, np.ndarray]:
    n, sizes = len(words), np.diff(offsets)
    space = common.is_space(data)
    doc = np.repeat(np.arange(n, dtype=np.uint64), words)
    out = {"n_words": words.astype(np.int64)}
    out["word_chars"] = common.sums_by(((data & 0xC0) != 0x80) & ~space, sizes)
    out["n_symbols"] = common.sums_by(_SYMBOLS[data], sizes)
    # lines
    line = np.unique(np.concatenate([offsets[:-1][sizes > 0], np.flatnonzero(data == 10) + 1]))
    line = line[line < len(data)]
    after = np.append(line[1:], len(data)) if len(line) else line
    end = after - (data[after - 1] == 10) if len(line) else line
    filled = np.concatenate([[0], np.cumsum(~space)])
    worded = filled[end] > filled[line] if len(line) else np.zeros(0, bool)
    line, end = line[worded], end[worded]
    of = np.searchsorted(offsets, line, "right") - 1
    with np.errstate(over="ignore"):
        keys = common.mix(common.span_hashes(data, line, end) + of.astype(np.uint64) * _B)
        _, first = np.unique(keys, return_index=True)
        out["n_dup_lines"] = np.bincount(of, minlength=n) - np.bincount(of[first], minlength=n)
        # windows of three words
        h = common.span_hashes(data, starts, ends)
        inside = np.flatnonzero(doc[2:] == doc[:-2]) if len(h) > 2 else np.zeros(0, np.int64)
        keys = common.mix((h[inside] * _A + h[inside + 1]) * _B + common.mix(h[inside + 2] + doc[inside] * _A)) if len(inside) else np.zeros(0, np.uint64)
    order = np.argsort(keys)
    same = keys[order][1:] == keys[order][:-1] if len(keys) else np.zeros(0, bool)
    twice = np.zeros(len(keys), bool)
    twice[order[1:][same]] = True
    twice[order[:-1][same]] = True
    covered = np.zeros(len(h), bool)
    for k in range(3):
        covered[inside[twice] + k] = True
    out["n_repeat_words"] = common.sums_by(covered, words)
    return out


def _labelled(labels: DataFrame, max_labels: int) -> DataFrame:
    """At most max_labels rows: _id, _trusted, _toxic, _fold."""
    rows = labels.where(F.col("doc_id").isNotNull()).groupBy(F.col("doc_id").alias("_id"))
    rows = rows.agg(F.max((F.coalesce(F.col("toxic"), F.lit(0)) == 1).cast("int")).alias("_toxic"), F.min((F.coalesce(F.col("quality"), F.lit(0)) == 1).cast("int") * (F.coalesce(F.col("toxic"), F.lit(0)) == 0).cast("int")).alias("_trusted"))
    rows = rows.withColumn("_fold", F.pmod(F.xxhash64("_id", F.lit(1)), F.lit(2)).cast("int"))
    return rows.orderBy(F.xxhash64("_id"), "_id").limit(max_labels)


def fit(docs: DataFrame, labels: DataFrame | None, *, rules: Rules | None = None, max_labels: int = 20_000, max_loss: float = 0.005, prior: float = 50_000.0, id_col: str = "doc_id", text_col: str = "text") -> QualityModel:
    """Count the two multinomials and fix the threshold."""
    rules = rules or Rules()
    plain = QualityModel(np.zeros(1 << BITS, np.int64), None, rules)
    if labels is None:
        return plain
    sample = common.checkpoint(_labelled(labels, max_labels))
    # a bounded number of rows, so it may be broadcast
    texts = docs.select(F.col(id_col).alias("_id"), F.col(text_col).alias("_text"))
    marked = texts.join(F.broadcast(sample), "_id", "left").select("_text", ((F.col("_trusted") == 1) & (F.col("_fold") == 0)).alias("_fit"))

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        raw, trusted = (np.zeros(1 << BITS, np.int64) for _ in range(2))
        for batch in common.slices(batches):
            fit_rows = np.array(batch.column(1).fill_null(False).to_pylist(), bool)
            for a, b, data, offsets in common.text_chunks(batch.column(0)):
                found, n = _features(data, *common.word_spans(data, offsets))
                raw += np.bincount(found, minlength=1 << BITS)
                trusted += np.bincount(found[np.repeat(fit_rows[a:b], n)], minlength=1 << BITS)
        used = np.flatnonzero(raw)
        yield pa.RecordBatch.from_arrays([pa.array(x) for x in (used, raw[used], trusted[used])], names=["bucket", "raw", "trusted"])

    counted = marked.mapInArrow(count, "bucket long, raw long, trusted long").groupBy("bucket").agg(F.sum("raw").alias("raw"), F.sum("trusted").alias("trusted")).toPandas()
    raw, trusted = np.zeros(1 << BITS), np.zeros(1 << BITS)
    raw[counted["bucket"]], trusted[counted["bucket"]] = counted["raw"], counted["trusted"]
    if not trusted.sum():
        return plain
    p_raw = (raw + 0.5) / (raw.sum() + 0.5 * len(raw))
    p_trusted = (trusted + prior * p_raw) / (trusted.sum() + prior)
    words, weights = _toxic_words(texts.join(F.broadcast(sample.where("_fold = 0 AND (_trusted = 1 OR _toxic = 1)")), "_id").select("_text", "_toxic"))
    model = QualityModel(np.rint(1e6 * np.log(p_trusted / p_raw)).astype(np.int64), None, rules, words, weights)
    held = texts.join(F.broadcast(sample.where("_fold = 1")), "_id").select("_text", "_id", "_trusted", "_toxic")
    shape = T.StructType([held.schema[c] for c in ("_id", "_trusted", "_toxic")] + [T.StructField(c, T.DoubleType()) for c in ("score", "worst")] + [T.StructField("base_failed", T.BooleanType())])
    held = held.mapInArrow(_scored(model, text_at=0, keep=["_id", "_trusted", "_toxic"]), shape).where("not base_failed")
    held = held.groupBy("_id", "_trusted", "_toxic").agg(F.min("score").alias("score"), F.min("worst").alias("worst")).toPandas()  # at most max_labels rows
    good = held["_trusted"] == 1
    if not good.any() or good.all():
        return plain
    threshold = _cut(held["score"][good], held["score"][~good], max_loss)
    return replace(model, threshold=threshold, floor=_cut(held["worst"][good], held["worst"][held["_toxic"] == 1], max_loss))


def _cut(good: np.ndarray, bad: np.ndarray, max_loss: float) -> float | None:
    """Of the thresholds that reject at most a share of the good, the one that best tells the kinds apart; None if none does."""
    good, bad = np.sort(good), np.sort(bad)
    if not len(good) or not len(bad):
        return None
    allowed = good[int(max_loss * len(good))]
    tried = np.unique(np.concatenate([bad[bad <= allowed] + 1e-9, [allowed]]))
    tried = tried[np.searchsorted(good, tried) <= max_loss * len(good)]
    if not len(tried):
        return None
    gain = np.searchsorted(bad, tried) / len(bad) - np.searchsorted(good, tried) / len(good)
    return float(tried[np.argmax(gain)]) if gain.max() > 0 else None


def _toxic_words(labelled: DataFrame) -> tuple[np.ndarray, np.ndarray]:
    """Hashes, ascending, and log ratios of the words of toxic documents, from rows (text, toxic) of which all others are trusted."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in common.slices(batches):
            toxic = batch.column(1).to_numpy(zero_copy_only=False).astype(bool)
            for a, b, data, offsets in common.text_chunks(batch.column(0)):
                starts, ends, n = common.word_spans(data, offsets)
                h, doc = common.span_hashes(common.lower(data), starts, ends), np.repeat(np.arange(a, b), n)
                order = np.lexsort((h, doc))
                h, doc = h[order], doc[order]
                new = np.ones(len(h), bool)
                new[1:] = (h[1:] != h[:-1]) | (doc[1:] != doc[:-1])
                one, own = np.unique(h[new], return_inverse=True)
                bad = np.bincount(own, weights=toxic[doc[new]], minlength=len(one)).astype(np.int64)
                good = np.bincount(own, minlength=len(one)) - bad
                yield pa.RecordBatch.from_arrays([pa.array(one.view(np.int64)), pa.array(bad), pa.array(good)], names=["word", "bad", "good"])

    n = {r["_toxic"]: r["count"] for r in labelled.groupBy("_toxic").count().collect()}
    bad, good = n.get(1, 0), n.get(0, 0)
    if not bad or not good:
        return np.zeros(0, np.uint64), np.zeros(0)
    words = labelled.mapInArrow(count, "word long, bad long, good long").groupBy("word").agg(F.sum("bad").alias("bad"), F.sum("good").alias("good"))
    even = EVEN_DOCS / (bad + good)  # of either kind, in proportion
    ratio = F.log((F.col("good") + even * good) / good) - F.log((F.col("bad") + even * bad) / bad)
    # words of several labelled documents each, of which there is a bounded number
    found = words.where(F.col("bad") >= TOXIC_DOCS).select("word", F.round(ratio, 6).alias("ratio")).where(F.col("ratio") <= TOXIC_RATIO).toPandas()
    own = found["word"].to_numpy(np.int64).view(np.uint64)
    order = np.argsort(own)
    return own[order], found["ratio"].to_numpy(float)[order]


def _judge(model: QualityModel, column: pa.Array) -> dict[str, np.ndarray]:
    """Statistics, score and verdicts for a column of texts."""
    parts: dict[str, list[np.ndarray]] = {}
    for _, _, data, offsets in common.text_chunks(column):
        starts, ends, words = common.word_spans(data, offsets)
        h = common.span_hashes(common.lower(data), starts, ends)
        found, n = _features(data, starts, ends, words, h)
        out = _statistics(data, offsets, starts, ends, words)
        out["score"] = common.sums_by(model.ratios[found], n) / np.maximum(n, 1) / 1e6
        out["worst"] = _worst(model, h, words)
        out["base_failed"] = (words < model.rules.min_words) | (100 * out["n_repeat_words"] > model.rules.max_repeat_percent * words)
        out["kept"] = ~out["base_failed"] & (True if model.threshold is None else out["score"] >= model.threshold) & (True if model.floor is None else out["worst"] >= model.floor)
        for k, v in out.items():
            parts.setdefault(k, []).append(v)
    return {k: np.concatenate(v) for k, v in parts.items()}


def _scored(model: QualityModel, text_at: int, keep: list[str]):
    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in common.slices(batches):
            out = _judge(model, batch.column(text_at))
            yield pa.RecordBatch.from_arrays([*(batch.column(batch.schema.get_field_index(c)) for c in keep), *(pa.array(out[c]) for c in ("score", "worst", "base_failed"))], names=[*keep, "score", "worst", "base_failed"])

    return score


def judge(docs: DataFrame, model: QualityModel, *, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """A row for each document: its id, the statistics, score, base_failed, kept and worst."""
    names = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words"]
    schema = T.StructType([T.StructField("doc_id", docs.schema[id_col].dataType), *(T.StructField(c, T.LongType()) for c in names), T.StructField("score", T.DoubleType()), T.StructField("base_failed", T.BooleanType()), T.StructField("kept", T.BooleanType()), T.StructField("worst", T.DoubleType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in common.slices(batches):
            out = _judge(model, batch.column(1))
            yield pa.RecordBatch.from_arrays([batch.column(0), *(pa.array(out[c]) for c in schema.names[1:])], names=schema.names)

    return docs.select(id_col, text_col).mapInArrow(run, schema)


def keep_good(docs: DataFrame, model: QualityModel, *, text_col: str = "text") -> DataFrame:
    """The documents that are kept, with all their columns."""
    at = docs.columns.index(text_col)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in common.slices(batches):
            yield batch.filter(pa.array(_judge(model, batch.column(at))["kept"]))

    return docs.mapInArrow(run, docs.schema)
