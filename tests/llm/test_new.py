"""The operators on vectors, manifests and pages against SQL or brute force."""

import random
import re
from hashlib import sha256
from html import unescape

import duckdb
import numpy as np
import pytest
from pyspark.sql import functions as F

from tessella.llm import hard_negatives, merkle, pages, queries

DATA = "/root/testdata/sf0.001"


def _h(*parts):
    return sha256("".join(parts).encode()).hexdigest()


def _tree(leaves, fanout):
    """Root and, for each leaf, its siblings before and after it level by level."""
    ways, at, nodes = [[] for _ in leaves], list(range(len(leaves))), list(leaves)
    while len(nodes) > 1:
        for w, a in zip(ways, range(len(leaves)), strict=True):
            run = at[a] // fanout * fanout
            w.append(("".join(nodes[run : at[a]]), "".join(nodes[at[a] + 1 : run + fanout])))
        nodes = [_h(*nodes[k : k + fanout]) for k in range(0, len(nodes), fanout)]
        at = [a // fanout for a in at]
    return nodes[0], ways


@pytest.mark.parametrize("fanout", [2, 3])
def test_op12_equals_one_process(spark, fanout, monkeypatch):
    """Sizes around block and range borders, with few levels to a block so that ways are joined in several steps."""
    monkeypatch.setattr(merkle, "BLOCK_BITS", 2)
    monkeypatch.setattr(merkle, "RANGE_BITS", 3)
    rng, rows = random.Random(5), []
    for lang, n in ((None, 1), ("", 2), ("a", 33), ("b", 128), ("é", 7), ("z", 65)):
        rows += [(rng.randrange(50), lang, rng.choice([None, "", "x" * 3])) for _ in range(n)]
    df = spark.createDataFrame(rows, "id int, lang string, text string").repartition(5)
    got = merkle.manifest(df, ["id", "text"], id_col="id", fanout=fanout, tampered=F.when(F.col("id") == 7, F.lit("00"))).collect()
    enc = lambda v: "-" if v is None else f"{len(str(v).encode())}:{v}"
    groups = {}
    for i, lang, text in rows:
        groups.setdefault(b"" if lang is None else b"=" + lang.encode(), []).append((i, _h(enc(i), enc(text))))
    trees = {g: (_tree([x for _, x in sorted(v)], fanout), sorted(v)) for g, v in groups.items()}
    root, tops = _tree([trees[g][0][0] for g in sorted(trees)], fanout)
    want = []
    for g, top in zip(sorted(trees), tops, strict=True):
        (subroot, ways), leaves = trees[g]
        for (i, own), way in zip(leaves, ways, strict=True):
            folded = "00" if i == 7 else own
            for before, after in way + top:
                folded = _h(before, folded, after)
            want.append((i, own, subroot, root, _h(*(a + b for a, b in way + top)), folded, folded == root))
    assert sorted(map(tuple, got)) == sorted(want) and {r.verified for r in got} == {True, False}
    assert merkle.manifest(df.limit(0), ["id"], id_col="id").count() == 0


def _mined(rows, positives, negatives, scale):
    """Brute force in whole numbers: rows (id, label, vector), anchors of ids divisible by 5."""
    good = [(i, lab, [int(np.floor(x * scale)) for x in v]) for i, lab, v in rows if None not in (i, lab, v) and all(x is not None and np.isfinite(x) for x in v)]
    out = []
    for a in sorted({(i, lab, tuple(v)) for i, lab, v in good if i % 5 == 0}):
        scored = sorted((-sum(x * y for x, y in zip(a[2], v)), i, lab) for i, lab, v in good if i != a[0])  # noqa: B905
        for p, pid, _ in [r for r in scored if r[2] == a[1]][:positives]:
            fit = [r for r in scored if r[2] != a[1] and 50 * -p <= 100 * -r[0] <= 95 * -p][:negatives]
            out += [(a[0], pid, k + 1, n, -p, -s) for k, (s, n, _) in enumerate(fit)]
    return sorted(out)


@pytest.mark.parametrize("scale", [256.0, 1e9])
def test_op11_equals_brute_force(spark, scale, monkeypatch):
    """Small tiles and chunks, unequal lengths, ties, repeated rows, bad rows; sums within and beyond 2 ** 53."""
    for name, size in (("BLOCK_ROWS", 3), ("TILE_ROWS", 7), ("CHUNK_DIMS", 4)):
        monkeypatch.setattr(hard_negatives, name, size)
    rng = np.random.default_rng(3)
    rows = [(int(i), int(rng.integers(3)), [float(x) for x in np.round(rng.random(int(rng.choice([5, 9]))), 1)]) for i in rng.permutation(60)]
    rows += [rows[0], rows[1], (101, None, [1.0]), (102, 1, None), (103, 1, [1.0, None]), (104, 1, [float("nan")]), (105, 1, [float("inf")]), (None, 1, [1.0]), (110, 9, [1.0, 1.0])]
    rows += [next((i, lab, v) for i, lab, v in rows if i == 5)]
    df = spark.createDataFrame(rows, "id long, kind int, v array<double>").withColumn("mark", F.lit("x")).repartition(3)
    how = {"scale": scale, "id_col": "id", "vector_col": "v"}
    got = hard_negatives.hard_negatives(df, F.col("kind"), F.col("id") % 5 == 0, **how).collect()
    want = _mined(rows, 5, 3, scale)
    assert sorted(map(tuple, got)) == want and len(want) > 50
    assert hard_negatives.hard_negatives(df.limit(0), F.col("kind"), F.col("id") % 5 == 0, **how).count() == 0


def test_scores_on_the_wire():
    rng = np.random.default_rng(1)
    for s in (rng.integers(-(1 << 40), 1 << 40, (3, 5)), np.zeros((2, 2), np.int64), np.array([[-(1 << 63), (1 << 63) - 1]]), np.array([[1 << 70, -5]], object)):
        assert (hard_negatives.from_wire(*hard_negatives.to_wire(s), s.shape) == s).all()


#: Pages and the text of their content.
PAGES = {
    "semantic": (
        """<!doctype html><HTML><head><title>Site</title><script>var a = "<article>no</article>";</script></head><body class="has-sidebar"><header><h1>Site name</h1></header>
        <nav><a href="/">Home</a></nav><div class="cookie-notice">We use cookies <button>ok</button></div><main><article class="post"><header><h1>Title</h1></header>
        <p>First &amp; <b>bold</b>&nbsp;text,\n two   lines<br>and more &lt;b&gt;.</p><div class="ad-slot">Buy now</div><ul><li>one<li>two</ul>
        <table><tr><td>a</td><td>b</td></tr></table><figure><img src="x" alt="y>z"><figcaption>A caption</figcaption></figure><form><label>Mail</label></form>
        <p>End</p><section id="comments"><article class="comment"><p>Nice post, I really like it a lot</p></article></section></article>
        <aside>Other stories you may want to read today</aside></main><footer>&copy; all rights</footer></body></html>""",
        "Title\nFirst & bold text, two lines and more <b>.\none\ntwo\na\nb\nA caption\nEnd",
    ),
    "divisions": (
        """<body><div id="header">My site</div><div class="menu"><ul><li><a href=1>one link</a></li></ul></div><div class="wrap with-sidebar"><div class="text"><h2>Head</h2>
        <p>Some words that make a paragraph of the article, enough of them.</p><p>More words with <a href="/x">a link</a> inside of the paragraph.</p></div>
        <div><ul><li><a href=a>link one</a></li><li><a href=b>link two</a></li></ul></div><div class="sideBar">Side words are here</div></div>
        <div id=comments><p>I have a long opinion about this text and tell it here</p></div></body>""",
        "Head\nSome words that make a paragraph of the article, enough of them.\nMore words with a link inside of the paragraph.",
    ),
    "unclosed": ("<nav><ul><li>a b c<article><h1>One</h1><p>two three<p class='ad'>buy this<p>four</article><p>after the end of it", "One\ntwo three\nfour"),
    "hidden parts": (
        '<article><svg width="1"/><p>one <span style="color:red; display: none">gone</span>two</p><ins class="adsbygoogle">buy</ins><p hidden>gone</p><p>three</p></article>',
        "one two\nthree",
    ),
    "all named": ('<body class="x"><div class="modal-page"><h2>Title</h2><p>the only words</p></div><nav>menu</nav></body>', "Title\nthe only words"),
    "no tags": ("just  some\twords", "just some words"),
    "quotes": ("<article><p title='it\">s'>in > \"quotes\" 1 < 2</p></article>", 'in > "quotes" 1 < 2'),
    "only comments": ("<!-- a b c --><![CDATA[ x ]]><script>x</script", ""),
    "empty": ("", ""),
    "null": (None, ""),
}


@pytest.fixture(scope="module")
def weights(spark):
    return pages.fit(spark.read.parquet(f"{DATA}/pages.parquet"))


@pytest.mark.parametrize("name", sorted(PAGES))
def test_op13_pages(weights, name):
    html, text = PAGES[name]
    assert pages.main_text(html or "", weights) == text
    assert pages.main_text(html or "", {}) == text


def test_op13_takes_the_article_of_every_page(spark):
    rows = duckdb.sql(f"SELECT page_id, url, html FROM '{DATA}/pages.parquet'").fetchall()
    want = {}
    for i, url, html in rows:
        inner = re.search("<article>(.*)</article>", html, re.S)[1].replace("<br>", " ")
        blocks = (" ".join(unescape(re.sub("<[^>]*>", "", b)).split()) for b in re.split("</?(?:p|h1)>", inner))
        want[i] = (url, "\n".join(b for b in blocks if b))
    got = queries.op13_html_extraction(spark, DATA).collect()
    assert {r.page_id: (r.url, r.text) for r in got} == want and all(r.n_chars == len(r.text) for r in got)


def test_op13_odd_tables(spark):
    rows = [(1, "u", "<p>one two three</p>", "x"), (1, "u", "<p>one two three</p>", "x"), (None, None, None, None), (3, "v", "<p>" + "w " * 300_000, "")]
    df = spark.createDataFrame(rows, "page_id int, url string, html string, text string")
    got = [(r.page_id, r.url, r.text[:13], r.n_chars) for r in pages.extract(df, pages.fit(df)).collect()]
    assert sorted(got, key=repr) == sorted([(1, "u", "one two three", 13), (1, "u", "one two three", 13), (None, None, "", 0), (3, "v", "w w w w w w w", 599_999)], key=repr)
    assert pages.extract(df.limit(0), pages.fit(df.limit(0))).count() == 0


def test_best_region_by_brute_force():
    rng = random.Random(2)
    for _ in range(300):
        s = [rng.choice([-2, -1, 0, 1]) for _ in range(rng.randrange(9))]
        every = [(sum(s[a:b]), b - a, -a) for a in range(len(s)) for b in range(a + 1, len(s) + 1)]
        a, b = pages.best_region(s)
        assert (sum(s[a:b]), b - a) == (max(every)[:2] if every and max(every)[0] > 0 else (0, 0))


@pytest.mark.parametrize("n", [1, 8, 64 * 8, 64 * 8 + 3, 3 * 64 * 8, 3 * 64 * 8 + 9])
def test_token_files_spend_no_bytes_on_masks(tmp_path, n):
    """Any sequence and its mask come back from the file, which grows by the ids alone, and masks are no copies."""
    import pyarrow as pa

    from tessella.llm import token_files

    ids, path = np.arange(n, dtype=np.uint16), str(tmp_path / "t.arrow")
    with pa.OSFile(path, "wb") as sink:
        out = token_files._Writer(sink, ids.dtype, 8)
        for at in range(0, n, 5):
            out.add(ids[at : at + 5])
        out.close()
    file = token_files.TokenFile(path)
    sequences = [file.sequence(i) for i in range(-(-n // 8))]
    assert np.concatenate([s for s, _ in sequences])[:n].tolist() == ids.tolist() == file.ids(0, n).tolist()
    assert np.concatenate([m for _, m in sequences]).tolist() == [1] * n + [0] * (-n % 8)
    assert all(len(s) == len(m) == 8 and s.dtype == np.uint16 and m.dtype == np.uint8 for s, m in sequences)
    batches = [file.reader.get_batch(k) for k in range(file.reader.num_record_batches)]
    assert sum(b.column(1).indices.nbytes for b in batches) == len(sequences) and all(len(b.column(1).dictionary) <= 2 for b in batches)


def test_keys_of_the_same_nodes_are_one(spark):
    """Of keys that have the same nodes, in whatever segments, one stays; no pair with a common key is without one."""
    import itertools

    import pyarrow as pa

    from tessella.llm import simhash

    rng = random.Random(5)
    texts = []
    for _ in range(8):
        words = [rng.choice("abcdefghij") + str(rng.randrange(50)) for _ in range(200)]
        texts += [" ".join(words[: 200 - k]) for k in range(4)]
    bits, extremes, _ = simhash.sketches(pa.array(texts), 5)
    columns = [np.arange(len(texts)), *bits.view(np.int64).T, *extremes.view(np.int64).T]
    names = ["node", *simhash._SKETCH, *simhash._EXTREMES]
    raw, kept = {}, {}
    for b in simhash._sketch_keys(iter([pa.RecordBatch.from_arrays([pa.array(c) for c in columns], names=names)])):
        for r in b.to_pylist():
            raw.setdefault(r["key"], set()).add(r["node"])
    nodes = spark.createDataFrame([tuple(int(c[i]) for c in columns) for i in range(len(texts))], ", ".join(f"{n} long" for n in names))
    for r in simhash.shared_keys(nodes).collect():
        kept.setdefault(r.key, set()).add(r.node)
    pairs = lambda keys: {p for own in keys.values() for p in itertools.combinations(sorted(own), 2)}
    assert pairs(kept) == pairs(raw) and pairs(raw)
    assert len({frozenset(own) for own in kept.values()}) == len(kept) == len({frozenset(own) for own in raw.values() if len(own) > 1})



def _near_copies(n=60, words=200, seed=8):
    rng, base, rows = np.random.default_rng(seed), [f"w{i}" for i in range(words)], []
    for i in range(n):
        own = list(base)
        for k in rng.choice(words, int(rng.integers(0, 8)), replace=False):
            own[k] = f"x{i}-{k}"
        rows.append((i, " ".join(own)))
    return rows


@pytest.mark.parametrize("blocks", [1, 3])
def test_candidates_go_on_with_open_members_only(blocks):
    """Over the rounds each close pair is given by the first of its keys, though members without further pairs are left out."""
    import itertools

    import pyarrow as pa

    from tessella.llm import simhash

    bits, extremes, _ = simhash.sketches(pa.array([t for _, t in _near_copies()]), 5)
    n, most = len(bits), simhash.most_bits(0.8) - 10
    names = ["node", *simhash._SKETCH, *simhash._EXTREMES]
    columns = [np.arange(n) * 7 % 61, *bits.view(np.int64).T, *extremes.view(np.int64).T]
    keys = {}
    for b in simhash._sketch_keys(iter([pa.RecordBatch.from_arrays([pa.array(c) for c in columns], names=names)])):
        for r in b.to_pylist():
            keys.setdefault(r["key"], []).append(r["node"])
    at = {int(v): k for k, v in enumerate(columns[0])}
    marks = simhash._marks(extremes)
    apart = lambda a, b: int(np.bitwise_count(bits[at[a]] ^ bits[at[b]]).sum())
    order, first = lambda key: (key & 15, key >> 4 & 4095), {}
    for key in sorted(keys, key=order):
        for a, b in itertools.combinations(sorted(keys[key]), 2):
            if apart(a, b) <= most:
                first.setdefault((a, b), key)
    rows = [0] * 5
    for key, nodes in keys.items():
        state, got, nearest, round_ = {v: (-1, 0) for v in nodes}, set(), 1, 0
        while state:
            rows[round_] += len(state)
            own = sorted(state)
            parts = [[v for v in own if v % blocks == i] for i in range(blocks)]
            side = lambda vs: simhash._side([np.array(vs, np.int64), np.array(vs, np.int64), *np.array([state[v] for v in vs], np.int64).reshape(-1, 2).T, *bits.view(np.int64)[[at[v] for v in vs]].T, *marks[[at[v] for v in vs]].T])  # noqa: E731, B023
            after = {}
            for i in range(blocks):
                for j in range(i, blocks):
                    if parts[i] and parts[j]:
                        pairs, still = simhash.candidates(side(parts[i]), None if i == j else side(parts[j]), most, nearest, round_ == 0, key)
                        got |= {tuple(p) for p in pairs.tolist()}
                        for v, last, mark in still.tolist():
                            after[v] = min(after.get(v, (1 << 60, 0)), (mark, last))
            state, nearest, round_ = after, 4 * nearest, round_ + 1
        assert got == {p for p, k in first.items() if k == key}
    assert len(first) > 500 and rows[1] < rows[0] / 2


def test_near_dedup_unfolds_most_keys_once(spark, monkeypatch):
    """After the first round of a key only the nodes with pairs that are left go on, not all nodes of the key."""
    from tessella.llm import common, simhash

    stored, rows = common.stored, {"keys": [], "keys-of-nodes": []}

    def counted(df, name):
        out = stored(df, name)
        if name in rows:
            rows[name].append(out.count() if name == "keys" else out.selectExpr("coalesce(sum(size(keys)), 0)").first()[0])
        return out

    monkeypatch.setattr(common, "stored", counted)
    simhash.keep_one(spark.createDataFrame(_near_copies(120, 60), "doc_id long, text string"), similarity=0.8).count()
    assert 0 < sum(rows["keys-of-nodes"]) < 1.1 * rows["keys"][0]
