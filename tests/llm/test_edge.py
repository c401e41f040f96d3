"""Cases that need a worker in which nothing has run yet."""

import itertools
import re
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from tessella.llm import common, langid, lines, lm, mixing, packing, quality, queries, secrets, simhash, token_files, topk


def test_spans_of_no_bytes_in_a_fresh_worker():
    common._POWERS.clear()
    none = np.zeros(0, np.int64)
    assert len(common.span_hashes(np.zeros(0, np.uint8), none, none)) == 0


LONG = " ".join(f"word{i}" for i in range(60))
ROWS = [(1, LONG, "en", "a", 1, "x", "y"), (1, LONG, "en", "a", 1, "x", "y"), (2, None, None, None, None, None, None), (3, "", "en", "a", 0, "", ""), (None, "one two", "fr", None, 7, "z", "z"), (4, LONG + "\n" + LONG, "fr", "b", 2, None, None), (5, "é" * 30_000, "fr", "b", 3, None, None)]
COLUMNS = "doc_id long, text string, lang string, source string, n_chars long, _k1 string, _words string"


@pytest.fixture(scope="module")
def odd(spark):
    return spark.createDataFrame(ROWS, COLUMNS).repartition(3)


def _by_id(df, *columns):
    return sorted(((r.doc_id, *(r[c] for c in columns)) for r in df.collect()), key=repr)


def _want(*functions):
    return sorted(((r[0], *(f(r[1] or "") for f in functions)) for r in ROWS), key=repr)


def _words(text):
    return re.findall(r"[^\x20\x09-\x0D]+", text)


def test_odd_rows_of_ids(odd):
    """Null, empty and long texts, repeated rows and null ids: lengths and checksums as the library gives them."""
    lib = Tokenizer.from_file(queries._tokenizer())
    ids = lambda t, end: [*lib.encode(t, add_special_tokens=False).ids, end]
    crc = lambda x: zlib.crc32(np.array(x, "<u4").tobytes())
    pieces = packing.pack_documents(odd, queries._tokenizer()).collect()
    got = {}
    for r in pieces:
        got.setdefault((r.doc_id, r.piece), []).append((r.start, r.length, r.ids_crc32))
    for i, text in {(r[0], r[1] or "") for r in ROWS}:
        every, copies = ids(text, 0), sum(r[0] == i for r in ROWS)
        first = (len(every) - 1) % 2048 + 1
        cuts = [0, *range(first, len(every) + 1, 2048)]
        for k, (a, b) in enumerate(itertools.pairwise(cuts)):
            assert got[i, k] == [(a, b - a, crc(every[a:b]))] * copies
    spaces = sorted((r.sequence_id, r.offset, r.length) for r in pieces)
    assert all(a[0] != b[0] and b[1] == 0 or a[1] + a[2] == b[1] for a, b in itertools.pairwise(spaces))
    files = token_files.read_token_files(token_files.write_token_files(odd, common.scratch(odd.sparkSession, "t"), queries._tokenizer(), end_id=2))
    assert _by_id(files, "n_tokens", "ids_crc32") == _want(lambda t: len(ids(t, 2)), lambda t: crc(ids(t, 2)))


def test_odd_rows_of_counts(odd):
    scored = lm.score_documents(odd, F.lit(True))
    assert _by_id(scored, "n_tokens") == _want(lambda t: len(_words(t)) + 1)
    assert len({r.score for r in scored.collect() if r.doc_id == 1}) == 1
    judged = quality.judge(odd, quality.fit(odd, None))
    assert _by_id(judged, "n_words", "base_failed", "kept") == _want(lambda t: len(_words(t)), lambda t: len(_words(t)) < 50 or t.count("word0 ") > 1, lambda t: not (len(_words(t)) < 50 or t.count("word0 ") > 1))
    found = secrets.digest(secrets.scan(odd))
    assert _by_id(found, "n_assign", "spans") == _want(lambda t: 0, lambda t: "")
    classes = simhash.near_duplicate_classes(odd)
    fp = lambda t: simhash.majority_bits(simhash.shingle_hashes(t, 3))
    assert _by_id(classes, "fp") == _want(lambda t: int(np.array([fp(t)], np.uint64).view(np.int64)[0]))
    assert {r.doc_id: r.component_id for r in classes.collect()}[3] == 2
    model = langid.fit(odd, F.lit(True), "/opt/tokenizers/piece_bpe_32k.model")
    said = langid.predict(odd, model).collect()
    assert {r.lang_pred for r in said if r.doc_id in (2, 3)} == {"und"} and len(said) == len(ROWS)
    assert len({(r.lang_pred, r.score) for r in said if r.doc_id == 1}) == 1 and all(0 <= r.score <= 1 for r in said)


def test_odd_rows_keep_their_columns(odd):
    """Columns with the operators' own names come through; a mixture keeps to its budget with repeated rows."""
    others = lambda df: sorted((tuple(r)[:1] + tuple(r)[2:7] for r in df.collect()), key=repr)
    rows = sorted((r[:1] + r[2:] for r in ROWS), key=repr)
    assert others(lines.dedup_lines(odd)) == rows
    mixed = mixing.mix_sources(odd, repetition_limit=None)
    assert others(mixed.where(f"`{mixed.columns[-3]}` = 0")) == rows
    kept = simhash.keep_one(odd).collect()
    assert sorted((tuple(r) for r in kept), key=repr) == sorted((r for k, r in enumerate(ROWS) if k in (0, 2, 4, 6)), key=repr)
    half = mixing.mix_sources(odd.where("doc_id = 1"), repetition_limit=None, budget=150)
    assert half.count() == 2  # two whole passes would be 240 words, 150 are one pass and no further document


def test_op4_on_an_empty_table(spark):
    df = spark.createDataFrame([], "vec_id long, embedding array<float>")
    assert topk.exact_top_k(df, F.col("vec_id") % 20 == 0).count() == 0
