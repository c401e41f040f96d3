"""The ten operators against SQL or brute force on small tables, and their edge cases."""

import collections
import math
import re
import zlib

import duckdb
import numpy as np
import pytest
import xxhash
from pyspark.sql import functions as F

import corpus_pipeline
from tessella.llm import langid, lines, lm, mixing, packing, quality, queries, secrets, simhash, token_files, topk

DATA = "/root/testdata/sf0.001"
WORD = re.compile(rb"[^\x20\x09-\x0D]+")
COLUMNS = "doc_id long, text string, lang string, source string, n_chars long, _k1 string, _words string"


@pytest.fixture(scope="module")
def docs():
    return duckdb.sql(f"SELECT doc_id, text, lang, source FROM '{DATA}/documents.parquet' ORDER BY 1").fetchall()


@pytest.fixture(scope="module")
def odd(spark):
    """Nulls, empty and long texts, repeated rows, other columns with clashing names."""
    long = " ".join(f"word{i}" for i in range(60))
    rows = [(1, long, "en", "a", 1, "x", "y"), (1, long, "en", "a", 1, "x", "y"), (2, None, None, None, None, None, None), (3, "", "en", "a", 0, "", ""), (None, "one two", "fr", None, 7, "z", "z"), (4, long + "\n" + long, "fr", "b", 2, None, None), (5, "é" * 30_000, "fr", "b", 3, None, None)]
    return spark.createDataFrame(rows, COLUMNS).repartition(2)


@pytest.fixture(scope="module")
def nothing(spark):
    return spark.createDataFrame([], COLUMNS)


@pytest.mark.parametrize("name", sorted(queries.ORACLE_SQL))
def test_equals_sql(spark, name):
    con = duckdb.connect()
    for t in ("documents", "embeddings"):
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{DATA}/{t}.parquet'")
    df = queries.QUERIES[name](spark, DATA)
    got = con.execute(queries.ORACLE_SQL[name])
    names = [x[0] for x in got.description]
    want = sorted((tuple(r[names.index(c)] for c in df.columns) for r in got.fetchall()), key=repr)
    assert sorted(map(tuple, df.collect()), key=repr) == want


def test_op1_predicts_held_out_documents(spark, docs):
    lang = {d[0]: d[2] for d in docs}
    held = [r for r in queries.op1_language_id(spark, DATA).collect() if r.held_out]
    assert all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 4 == 2) for r in held)
    assert np.mean([r.lang_pred == lang[r.doc_id] for r in held]) > 0.9


def test_op1_sums_all_segmentations():
    model = langid.LanguageModel(["x"], {"▁": 0, "a": 1, "▁a": 2, "b": 3, "ab": 4, "▁ab": 5}, np.array([[0.1], [0.2], [0.3], [0.05], [0.15], [0.2]]))
    ways = 0.2 + 0.3 * 0.05 + 0.1 * 0.15 + 0.1 * 0.2 * 0.05
    assert math.isclose(langid.word_log_probabilities(["ab"], model)[0, 0], math.log(ways))


def test_op2_packs_whole_and_gapless(spark, docs):
    rows = queries.op2_best_fit_packing(spark, DATA).collect()
    by = collections.defaultdict(list)
    for r in rows:
        by[r.sequence_id].append((r.offset, r.length))
    for parts in by.values():
        at = 0
        for offset, length in sorted(parts):
            assert offset == at
            at += length
        assert at <= 2048
    assert {r.doc_id for r in rows} == {d[0] for d in docs}
    assert len(by) <= 1.02 * math.ceil(sum(r.length for r in rows) / 2048) + 1


def test_op2_and_op9_ids(spark, docs):
    from tokenizers import Tokenizer

    code = Tokenizer.from_file(queries._tokenizer())
    ids = {d[0]: code.encode(d[1] or "", add_special_tokens=False).ids for d in docs}
    for r in queries.op2_best_fit_packing(spark, DATA).collect():
        own = np.array([*ids[r.doc_id], 0], "<u4")[r.start : r.start + r.length]
        assert zlib.crc32(own.tobytes()) == r.ids_crc32
    start = 0
    for r in sorted(queries.op9_token_files(spark, DATA).collect(), key=lambda r: r.doc_id):
        own = np.array([*ids[r.doc_id], 2], "<u4")
        assert (r.start, r.n_tokens, r.ids_crc32) == (start, len(own), zlib.crc32(own.tobytes()))
        start += len(own)


def test_token_ids_equal_the_library():
    import random

    import pyarrow as pa

    from tessella.llm import tokens

    code, rng = tokens.Encoder(queries._tokenizer()), random.Random(4)
    alphabet = [*"ab Zé.,'!\n\t —…9ñ×÷ßsS日本\u3000\u2003\u00a0\x1c\x7f<|>", "'s", "'ll", "<|endoftext|>", " \n", "  ", "word", " word"]
    texts = ["".join(rng.choices(alphabet, k=rng.randint(0, 30))) for _ in range(4000)] + [None, "", "a <|endoftext|> b", "x" * 5000, " y" * 5000]
    texts += ["".join(chr(rng.choice([rng.randint(1, 0x2FF), rng.randint(0x2000, 0x3100), 32, 10])) for _ in range(20)) for _ in range(4000)]
    got = [own.tolist() for a in range(0, len(texts), 500) for ids, sizes in code.chunks(pa.array(texts[a : a + 500])) for own in np.split(ids, np.cumsum(sizes)[:-1])]
    assert got == [code.tokenizer.encode(t or "", add_special_tokens=False).ids for t in texts]
    assert code.encode("a <|endoftext|> b").tolist() == [64, 220, 50256, 275]


def test_token_ids_under_another_kind_of_tokenizer(tmp_path):
    from tokenizers import Tokenizer, models, pre_tokenizers

    from tessella.llm import tokens

    own = Tokenizer(models.WordLevel({"a": 0, "b.": 1, "?": 2}, unk_token="?"))
    own.pre_tokenizer = pre_tokenizers.WhitespaceSplit()
    own.save(str(tmp_path / "t.json"))
    code = tokens.Encoder(str(tmp_path / "t.json"))
    assert not code.by_piece and code.encode("a b. c").tolist() == [0, 1, 2]


def test_op3_base_counts_and_better_scores(spark, docs):
    tokens = {d[0]: [*WORD.findall((d[1] or "").encode().lower()), None] for d in docs}
    held = {d[0] for d in docs if zlib.crc32(str(d[0]).encode()) % 5 == 1}
    c = collections.Counter(t for i, own in tokens.items() if i not in held for t in own)
    n, v = sum(c.values()), len(c)
    rows = queries.op3_lm_scoring(spark, DATA).collect()
    assert len(rows) == len(docs)
    for r in rows:
        own = tokens[r.doc_id]
        assert (r.n_tokens, r.n_known, r.train_tokens, r.held_out) == (len(own), sum(t in c for t in own), n, r.doc_id in held)
        assert math.isclose(r.base_score, sum(math.log10((c[t] + 0.5) / (n + 0.5 * (v + 1))) for t in own), abs_tol=1e-6)
    assert sum(r.score for r in rows if r.held_out) > sum(r.base_score for r in rows if r.held_out)


def test_op3_tables_follow_the_full_conditional():
    n, d, s, p = 4, 0.6, 1.5, 0.2
    rng = np.random.default_rng(1)
    c, t = np.full(40_000, n), np.ones(40_000, np.int64)
    t = lm.sample_tables(c, t, np.zeros_like(c), np.full(len(c), math.log(p)), d, s, rng)
    t = lm.sample_tables(c, t, np.zeros_like(c), np.full(len(c), math.log(p)), d, s, rng)
    stirling = np.exp(lm._log_stirling(d)[n, 1 : n + 1])
    weights = np.array([stirling[k] * math.prod((s + d * j) * p for j in range(k + 1)) for k in range(n)])
    seen = np.bincount(t, minlength=n + 1)[1:] / len(t)
    assert np.abs(seen[1:] / seen[1:].sum() - weights[1:] / weights[1:].sum()).max() < 0.03  # some dishes are never chosen, and stay at one


def test_op5_classes(spark, docs):
    def fingerprint(text):
        w = WORD.findall((text or "").encode().lower())
        grams = [b" ".join(w[k : k + 3]) for k in range(max(1, len(w) - 2))] if w else []
        h = [xxhash.xxh64_intdigest(g, 42) for g in grams]
        return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))

    fps = [fingerprint(d[1]) for d in docs]
    root = list(range(len(docs)))
    for i in range(len(docs)):
        for j in range(i):
            if (fps[i] ^ fps[j]).bit_count() <= 2 and root[i] != root[j]:
                a, b = sorted((root[i], root[j]))
                root = [a if x == b else x for x in root]
    least = {k: min(docs[i][0] for i in range(len(docs)) if root[i] == k) for k in set(root)}
    want = {docs[i][0]: (f"{fps[i]:016x}", least[root[i]]) for i in range(len(docs))}
    assert {r.doc_id: (r.fingerprint, r.component_id) for r in queries.op5_simhash_near_dedup(spark, DATA).collect()} == want


def test_op5_links_random_neighbours(spark):
    rng = np.random.default_rng(3)
    base = rng.integers(0, 1 << 63, 300, dtype=np.uint64)
    near = base ^ (np.uint64(1) << rng.integers(0, 64, 300).astype(np.uint64)) ^ (np.uint64(1) << rng.integers(0, 64, 300).astype(np.uint64))
    fps = np.unique(np.concatenate([base, near]))
    df = spark.createDataFrame([(int(x),) for x in fps.view(np.int64)], "fp long")
    for split in (512, 1):  # with and without a third segment
        links = {frozenset((r.u, r.v)) for r in simhash.link_fingerprints(df, split).collect()}
        for a, b in zip(base.view(np.int64).tolist(), near.view(np.int64).tolist(), strict=True):
            assert a == b or frozenset((a, b)) in links


def _planted(n=120):
    """Texts that hold a random token, a long identifier, or a line of dashes."""
    import random
    import string

    rng = random.Random(5)
    names = ["".join(rng.choices(["ta", "re", "mon", "li", "ver", "sto", "pen", "dar"], k=3)) for _ in range(200)]
    rows, tokens = [], {}
    for i in range(n):
        text = " ".join(rng.choices(names, k=80))
        if i % 3 == 0:
            tokens[i] = "".join(rng.choices(string.ascii_letters + string.digits, k=32))
            text = f"é {tokens[i]} {text} 4845168114407329 00491701234567890123"
        elif i % 3 == 1:
            text = f"{'_'.join(rng.choices(names, k=4))} {''.join(x.title() for x in rng.choices(names, k=4))} {'-' * 30} {text}"
        rows.append((i, text))
    return rows, tokens


def test_op7_finds_planted_tokens_and_leaves_identifiers(spark):
    rows, tokens = _planted()
    found = {r.doc_id: [x.hit for x in r.spans] for r in secrets.scan(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    caught = sum(t in found[i] for i, t in tokens.items())
    every = sum(map(len, found.values()))
    assert caught >= 0.9 * len(tokens) and caught >= 0.9 * every


@pytest.mark.parametrize("every", [4, 1])
def test_op7_recall_by_kind(spark, every):
    """Random strings of several kinds in each fourth document and in each one, beside long ordinary words."""
    import random
    import string
    import uuid

    rng = random.Random(11)
    parts = ["ta", "re", "mon", "li", "ver", "sto", "pen", "dar", "ung", "keit", "schaft", "tion"]
    names = ["".join(rng.choices(parts, k=rng.choice([1, 2, 2, 3, 3, 6]))) for _ in range(800)]
    draw = lambda letters, n: "".join(rng.choices(letters, k=n))
    kinds = {"alnum32": lambda: draw(string.ascii_letters + string.digits, 32), "alnum16": lambda: draw(string.ascii_letters + string.digits, 16), "lower24": lambda: draw(string.ascii_lowercase, 24), "upper20": lambda: draw(string.ascii_uppercase + string.digits, 20), "uuid": lambda: str(uuid.UUID(int=rng.getrandbits(128)))}
    rows, planted = [], {}
    for i in range(400):
        words = rng.choices(names, k=150)
        if i % every == 0:
            kind = list(kinds)[i // every % len(kinds)]
            planted[i] = (kind, kinds[kind]())
            words.insert(rng.randrange(150), planted[i][1])
        rows.append((i, " ".join(words)))
    found = {r.doc_id: [x.hit for x in r.spans] for r in secrets.scan(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    caught = collections.Counter(k for i, (k, t) in planted.items() if t in found[i])
    wanted = collections.Counter(k for k, _ in planted.values())
    assert all(caught[k] >= 0.9 * wanted[k] for k in wanted), (caught, wanted)
    false = sum(h not in (planted.get(i) or ((), ""))[1] for i, hits in found.items() for h in hits)
    assert false <= 0.1 * len(planted)


def test_op7_added_spans_by_brute_force(spark):
    rows, _ = _planted(30)
    rows.append((99, "password=abcdefghijklmnopqrstuvw x " + "q7" * 12))
    rng = np.random.default_rng(2)
    evenness = [round(float(x), 6) for x in rng.normal(0, 0.1, len(secrets.CLASSES))]
    model = secrets.SecretModel([round(float(x), 6) for x in rng.normal(0, 1, 96 * 96)], evenness, [0.3, 0.05, 0.02, -0.1], 0.0, 0.0)
    code = lambda c: min(max(ord(c) - 32, 0), 95)
    for r in secrets.scan(spark.createDataFrame(rows, "doc_id long, text string"), model=model).collect():
        text = next(t for i, t in rows if i == r.doc_id)
        base = [(x.start, x.end) for x in r.spans if x.kind < 3]
        want = []
        for m in re.finditer(r"[A-Za-z0-9+/=_-]{16,}", text):
            own = next(k for k, c in enumerate(secrets.CLASSES) if re.fullmatch(c, re.sub("[+/=_-]", "", m[0])))
            mean = np.mean([model.costs[code(a) * 96 + code(b)] for a, b in zip(m[0], m[0][1:])]) + model.evenness[own]
            if mean >= model.thresholds[sum(len(m[0]) >= n for n in (20, 24, 32))] and not any(a < m.end() and m.start() < b for a, b in base):
                want.append(m.span())
        assert [(x.start, x.end) for x in r.spans if x.kind == 3] == want


def test_op7_base_spans(spark, docs):
    assign = re.compile(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.I)
    for r in queries.op7_secret_scan(spark, DATA).collect():
        text = next(d[1] for d in docs if d[0] == r.doc_id) or ""
        want = [("assign", m.span()) for m in assign.finditer(text) if len(m[2]) >= 6]
        want += [("access", m.span()) for m in re.finditer(r"AKIA[A-Z0-9]+", text) if len(m[0]) >= 20]
        want += [("hex", m.span()) for m in re.finditer(r"[0-9a-f]+", text) if len(m[0]) >= 24]
        got = [x.split(":") for x in r.spans.split(",") if x]
        assert sorted((k, (int(a), int(b))) for k, a, b in got if k != "markov") == sorted(want)


def test_op8_keeps_all_and_limits_repetition(spark, docs):
    rows = queries.op8_source_mixing(spark, DATA).collect()
    assert {r.doc_id for r in rows} == {d[0] for d in docs}
    assert max(collections.Counter(r.doc_id for r in rows).values()) <= 3


def test_op10_statistics(spark, docs):
    for r in queries.op10_quality_rules(spark, DATA).collect():
        text = next(d[1] for d in docs if d[0] == r.doc_id) or ""
        w = re.findall(r"[^\x20\x09-\x0D]+", text)
        grams = [tuple(w[k : k + 3]) for k in range(len(w) - 2)]
        n = collections.Counter(grams)
        repeated = len({k + j for k, g in enumerate(grams) if n[g] > 1 for j in range(3)})
        full = [x for x in text.split("\n") if re.search(r"[^\x20\x09-\x0D]", x)]
        assert (r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words) == (len(w), sum(map(len, w)), len(re.findall(r"[#*$%&|<>]", text)), len(full) - len(set(full)), repeated)
        assert r.base_failed == (len(w) < 50 or 100 * repeated > 50 * len(w))


def test_op10_verdicts_by_formula(spark):
    """score, worst and kept from the formulas, on texts with planted trusted, junk and toxic words."""
    import random

    rng = random.Random(9)
    names = [f"w{i}" for i in range(400)]
    rows, labels = [], []
    for i in range(600):
        words = rng.choices(names, k=rng.randrange(60, 200))
        if i % 6 == 0:
            words[5] = rng.choice(["vile", "foul", "rotten"])
        if i % 6 == 1:
            words = [w + "#" if rng.random() < 0.5 else w for w in words]
        rows.append((i, " ".join(words)))
        labels.append((i, 0 if i % 6 == 1 else 1, 1 if i % 6 == 0 else 0))
    docs, marks = spark.createDataFrame(rows, "doc_id long, text string"), spark.createDataFrame(labels, "doc_id long, quality int, toxic int")
    model = quality.fit(docs, marks)
    assert len(model.words) == 3 and model.floor is not None and model.threshold is not None
    got = {r.doc_id: r for r in quality.judge(docs, model).collect()}
    import pyarrow as pa

    word_hash = lambda w: int(quality.common.span_hashes(np.frombuffer(w.encode(), np.uint8), np.array([0]), np.array([len(w)]))[0])
    weights = dict(zip(model.words.tolist(), model.weights.tolist(), strict=True))
    for i, text in rows:
        data, offsets = quality.common.utf8(pa.array([text]))
        buckets, n = quality._features(data, *quality.common.word_spans(data, offsets))
        assert got[i].score == pytest.approx(sum(int(model.ratios[b]) for b in buckets) / n[0] / 1e6)
        assert got[i].worst == min([0.0, *(weights.get(word_hash(w), 0.0) for w in text.split())])
        assert got[i].kept == (not got[i].base_failed and got[i].score >= model.threshold and got[i].worst >= model.floor)
    kept = collections.Counter(i % 6 for i, r in got.items() if r.kept)
    assert kept[0] == 0 and kept[1] <= 3 and all(kept[k] >= 97 for k in (2, 3, 4, 5))


def test_line_dedup_keeps_the_first_copy(odd):
    got = {r.doc_id: r.text for r in lines.dedup_lines(odd).collect()}
    assert len(got[1].split()) == 60 and got[4] == "" and got[2] is None and got[3] == ""


def _exact_classes(rows, similarity=0.8, words=5):
    """The least id of each class over links at an exact Jaccard similarity of shingles."""
    sets = {}
    for i, text in rows:
        w = WORD.findall((text or "").encode().lower())
        sets[i] = {tuple(w[k : k + words]) for k in range(max(1, len(w) - words + 1))} if w else set()
    root = {i: i for i in sets}
    for i in sorted(sets):
        for j in sorted(sets):
            a, b = sets[i], sets[j]
            if j < i and root[i] != root[j] and len(a & b) >= similarity * len(a | b):
                low, high = sorted((root[i], root[j]))
                root = {k: low if r == high else r for k, r in root.items()}
    return set(root.values())


def test_keep_one_equals_exact_similarity(spark, docs):
    kept = simhash.keep_one(spark.read.parquet(f"{DATA}/documents.parquet")).select("doc_id").collect()
    assert {r.doc_id for r in kept} == _exact_classes([(d[0], d[1]) for d in docs])


@pytest.mark.parametrize("split", [4, 512])
def test_keep_one_in_a_large_graded_group(spark, split):
    """Variants of one text at similarities around the threshold: in one place, or in blocks of a group."""
    rng = np.random.default_rng(8)
    base, rows = [f"w{i}" for i in range(200)], []
    for i in range(60):
        own = list(base)
        for k in rng.choice(200, int(rng.integers(0, 8)), replace=False):
            own[k] = f"x{i}-{k}"
        rows.append((i, " ".join(own)))
    rows += [(100 + i, " ".join(f"y{i}-{k}" for k in range(80))) for i in range(10)]
    kept = {r.doc_id for r in simhash.keep_one(spark.createDataFrame(rows, "doc_id long, text string"), split=split).collect()}
    want = _exact_classes(rows)
    assert want <= kept and len(kept - want) <= 1  # a pair at the threshold shares no key with a small probability


def test_training_learns_from_long_words():
    """Each known letter is in one expected piece, however long the word and its unknown letters."""
    pieces = langid.vocabulary("/opt/tokenizers/piece_bpe_32k.model")
    model = langid.LanguageModel(["a"], pieces, np.full((len(pieces), 1), 1.0 / len(pieces)))
    sizes = np.array([len(p) for p in pieces])
    for word in ("therefore" * 50, "\ua66e" * 60 + "there" * 20, "the" * 10 + "\ua66e" * 33):
        known = len(word.replace("\ua66e", "")) + 1
        assert sizes @ langid._expected([word], np.array([[3.0]]), model)[:, 0] == pytest.approx(3 * known)


def test_keep_one(odd):
    assert sorted(r.doc_id or 0 for r in simhash.keep_one(odd).collect()) == [0, 1, 2, 5]  # 3 is empty like 2; 4 repeats 1


OPERATORS = {
    "op1": lambda d: langid.predict(d, langid.fit(d, F.lit(True), "/opt/tokenizers/piece_bpe_32k.model")),
    "op2": lambda d: packing.pack_documents(d, queries._tokenizer()),
    "op3": lambda d: lm.score_documents(d, F.lit(True)),
    "op5": lambda d: simhash.near_duplicate_classes(d),
    "op6": lambda d: lines.dedup_lines(d),
    "op7": lambda d: secrets.digest(secrets.scan(d)),
    "op8": lambda d: mixing.mix_sources(d),
    "op9": lambda d: token_files.read_token_files(token_files.write_token_files(d, queries.common.scratch(d.sparkSession, "t"), queries._tokenizer())),
    "op10": lambda d: quality.judge(d, quality.fit(d, None)),
}


@pytest.mark.parametrize("name", OPERATORS)
def test_odd_and_empty_tables(odd, nothing, name):
    assert OPERATORS[name](odd).count() >= odd.count()
    assert OPERATORS[name](nothing).count() == 0


def test_op4_leaves_out_bad_vectors(spark):
    df = spark.createDataFrame([(0, [1.0, 0.5]), (20, None), (1, [1.0, None]), (2, [float("nan"), 1.0]), (3, [1.0, 0.5]), (4, [1.0, 0.5])], "vec_id long, embedding array<float>")
    got = topk.exact_top_k(df, F.col("vec_id") % 20 == 0, k=20, scale=64.0).collect()
    assert [(r.query_id, r["rank"], r.vec_id, r.score) for r in sorted(got, key=lambda r: r["rank"])] == [(0, 1, 3, 5120), (0, 2, 4, 5120)]


def test_pipeline(spark):
    assert 4 <= len(corpus_pipeline.STAGES) <= 5
    rows = corpus_pipeline.run(spark, DATA).collect()
    assert rows and all(r.length <= 2048 for r in rows)
