"""Operator 3: scoring by a hierarchical Pitman-Yor language model.

Each word that precedes a token has a restaurant whose customers are the
tokens that follow it; the tables of all these restaurants are the customers
of one shared parent restaurant, and that one's tables come from a uniform
base.  Given its ``c`` customers, the number of tables of a dish is sampled by
Gibbs from its full conditional: generalised Stirling numbers up to
``EXACT`` customers, and beyond that all the dish's customers leave and are
seated anew, in blocks of a sixteenth of those seated.  Predictive
probabilities are averaged over samples and multiplied along a text.

Words are 64-bit hashes.  One lazy plan does it all:

1. A task turns its documents into blocks of (context, token, document), one
   for each bucket of contexts, and blocks are grouped by bucket.
2. A bucket seats its restaurants, with a parent of its own as a start, and
   tells the owners of its words how many customers and tables they have.
3. An owner seats the parent's dishes and answers with the parent's masses.
4. The bucket, read again from the same shuffle, seats its restaurants below
   the shared parent, averages, and sends sums by document back.

Counts cover all training documents.  A context with more than a share of the
tokens (seen in a sample that only decides the layout) is dealt over all
buckets by token; its totals pass through the owners.  Buckets are twice as
many as input partitions, so each holds about half the tokens of one.
All random numbers are seeded by bucket: a task that runs again gives the same.

Defined cases: a null or empty text is the end token alone; repeated rows are
counted and scored each; a null id is kept; without training documents every
token has the base's probability; an empty table gives no rows.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from . import common

#: Customers of a dish up to which table numbers are drawn from the exact conditional.
EXACT = 48
#: Tokens of a block.
BLOCK_TOKENS = 2_000_000
#: Sweeps below a bucket's own parent, then below the shared one: left out and averaged.
START_SWEEPS, BURN_SWEEPS, SAMPLES = 2, 2, 3
#: Strengths of the context restaurants and of the parent.
STRENGTH, PARENT_STRENGTH = 0.5, 10.0
_BEGIN, _END = np.uint64(0x51ED270B8F1BBCDD), np.uint64(0xA24BAED4963EE407)
_SALT = np.uint64(0xD1342543DE82EF95)

_BLOCK = "bucket int, flush long, us binary, runs binary, ws binary, wi binary, docs binary, meta binary"
_ASK = "owner int, bucket int, words binary, counts binary, tables binary, totals binary, hot binary"
_ANSWER = "bucket int, owner int, counts binary, mass binary, totals binary, hot binary"
_SUMS = "flush long, docs binary, sums binary, meta binary"


# --- tokens ------------------------------------------------------------------


def _tokens(column: pa.Array) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """(contexts, tokens, tokens of each document) of chunks of texts; every document ends with an end token."""
    for _, _, data, offsets in common.text_chunks(column):
        starts, ends, words = common.word_spans(data, offsets)
        h = common.span_hashes(common.lower(data), starts, ends)
        sizes = words + 1
        last = np.cumsum(sizes) - 1
        token = np.empty(len(h) + len(words), np.uint64)
        inner = np.ones(len(token), bool)
        inner[last] = False
        token[inner], token[last] = h, _END
        context = np.empty_like(token)
        context[1:] = token[:-1]
        context[last - words] = _BEGIN
        yield context, token, sizes


def _small(values: np.ndarray) -> np.ndarray:
    """Whole numbers in 16 bits where they fit, else 32."""
    return values.astype("<u2" if not len(values) or values.max() < 1 << 16 else "<u4")


def _ints(raw: bytes, n: int) -> np.ndarray:
    return np.frombuffer(raw, "<u2" if len(raw) == 2 * n else "<u4").astype(np.int64)


def _bucket(u: np.ndarray, w: np.ndarray, hot: np.ndarray, buckets: int) -> np.ndarray:
    with np.errstate(over="ignore"):
        own = common.mix(u ^ _SALT)
        if len(hot):
            at = np.minimum(np.searchsorted(hot, u), len(hot) - 1)
            own = np.where(hot[at] == u, common.mix(own + w * _SALT), own)
    return ((own >> np.uint64(32)) % np.uint64(buckets)).astype(np.int64)


def _owner_edges(words: np.ndarray, owners: int) -> np.ndarray:
    """Places in sorted words where each owner's range begins, and the end."""
    firsts = np.array([(k << 64) // owners for k in range(owners)], np.uint64)
    return np.append(np.searchsorted(words, firsts), len(words))


def _blocks(buckets: int, hot: np.ndarray):
    def flush(number: int, parts: list, ids: list, n_docs: int) -> Iterator[pa.RecordBatch]:
        u, w, code = (np.concatenate([p[k] for p in parts]) for k in range(3))
        sizes = np.concatenate([p[3] for p in parts]).astype("<i8")
        parts.clear()
        known = np.unique(np.concatenate([w, [_BEGIN]]))
        bucket = _bucket(u, w, hot, buckets)
        ui, wi = np.searchsorted(known, u), np.searchsorted(known, w)
        n = len(known)
        del u, w
        order = np.argsort((bucket * n + ui) * n + wi)
        bucket, ui, wi, code = bucket[order], ui[order], wi[order], code[order]
        edges = np.searchsorted(bucket, np.arange(buckets + 1))
        sink = pa.BufferOutputStream()
        table = pa.table({"id": pa.chunked_array(ids), "size": sizes})
        with pa.ipc.new_stream(sink, table.schema) as out:
            out.write_table(table)
        meta = sink.getvalue().to_pybytes()
        for b in range(buckets):
            x, y = edges[b], edges[b + 1]
            if x == y and b != number % buckets:
                continue
            own_u, first = np.unique(ui[x:y], return_index=True)
            own_w, at = np.unique(wi[x:y], return_inverse=True)
            row = {"bucket": b, "flush": number, "us": known[own_u].tobytes(), "runs": np.diff(np.append(first, y - x)).astype("<u4").tobytes(), "ws": known[own_w].tobytes(), "wi": _small(at).tobytes(), "docs": _small(code[x:y]).tobytes(), "meta": meta if b == number % buckets else None}
            yield pa.RecordBatch.from_pylist([row], schema=_arrow(_BLOCK))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        number = TaskContext.get().partitionId() << 24
        parts, ids, docs, tokens = [], [], 0, 0
        for batch in common.slices(batches):
            train = np.array(batch.column(2).fill_null(False).to_pylist(), np.int64)
            at = 0
            for u, w, sizes in _tokens(batch.column(1)):
                k = np.arange(at, at + len(sizes))
                parts.append((u, w, np.repeat(((docs + k) * 2 + train[k]).astype(np.int32), sizes), sizes))
                at += len(sizes)
                tokens += len(u)
            ids.append(batch.column(0))
            docs += batch.num_rows
            if tokens >= BLOCK_TOKENS:
                yield from flush(number, parts, ids, docs)
                parts, ids, docs, tokens, number = [], [], 0, 0, number + 1
        if docs:
            yield from flush(number, parts, ids, docs)

    return run


@lru_cache
def _arrow(ddl: str) -> pa.Schema:
    kinds = {"int": pa.int32(), "long": pa.int64(), "binary": pa.binary(), "double": pa.float64(), "boolean": pa.bool_()}
    return pa.schema([(name, kinds[kind]) for name, kind in (field.split() for field in ddl.split(", "))])


# --- seating -----------------------------------------------------------------


@lru_cache
def _log_stirling(discount: float) -> np.ndarray:
    """Logarithms of the generalised Stirling numbers of c customers at t tables, to EXACT."""
    s = np.full((EXACT + 1, EXACT + 2), -np.inf)
    s[0, 0] = 0.0
    for c in range(EXACT):
        for t in range(1, c + 2):
            kept = s[c, t] + np.log(c - t * discount) if t <= c else -np.inf
            s[c + 1, t] = np.logaddexp(s[c, t - 1], kept)
    return s


def sample_tables(c: np.ndarray, tables: np.ndarray, others: np.ndarray, log_base: np.ndarray, discount: float, strength: float, rng: np.random.Generator) -> np.ndarray:
    """Tables of each dish, given its customers, the other dishes' tables in its restaurant and its base probability.

    Half of the dishes, chosen at random, are seated anew.
    """
    out = tables.copy()
    chosen = np.flatnonzero((c > 1) & (rng.random(len(c)) < 0.5))
    of = c[chosen]
    stirling = _log_stirling(discount)
    order = np.argsort(of, kind="stable")
    chosen, of = chosen[order], of[order]
    small = int(np.searchsorted(of, EXACT, "right"))
    edges = np.flatnonzero(np.diff(of[:small])) + 1
    for rows in np.split(chosen[:small], edges) if small else []:
        n = int(c[rows[0]])
        for at in range(0, len(rows), 1 << 16):
            own = rows[at : at + (1 << 16)]
            steps = np.log(strength + discount * (others[own, None] + np.arange(n))) + log_base[own, None]
            logs = np.cumsum(steps, axis=1) + stirling[n, 1 : n + 1]
            weights = np.cumsum(np.exp(logs - logs.max(1, keepdims=True)), axis=1)
            out[own] = 1 + (weights < rng.random((len(own), 1)) * weights[:, -1:]).sum(1)
    big = chosen[small:]
    if len(big):
        of, rest, p = c[big], others[big], np.exp(log_base[big])
        t, seated = np.ones(len(big), np.int64), np.ones(len(big), np.int64)
        while (left := of - seated).any():
            step = np.minimum(left, np.maximum(1, seated >> 4))
            new = (strength + discount * (rest + t)) * p
            t += rng.binomial(step, new / (new + seated - discount * t))
            seated += step
        out[big] = t
    return out


def _discount(ones: float, twos: float) -> float:
    return round(min(0.95, max(0.05, ones / (ones + 2 * twos))), 3) if ones else 0.5


class _Bucket:
    """The blocks of a bucket, merged: occurrences sorted by pair, and pairs."""

    def __init__(self, rows: list[dict]):
        self.flush, self.meta = [r["flush"] for r in rows], [r["meta"] for r in rows]
        us = [np.frombuffer(r["us"], "<u8") for r in rows]
        ws = [np.frombuffer(r["ws"], "<u8") for r in rows]
        self.u, self.w = np.unique(np.concatenate(us)), np.unique(np.concatenate(ws))
        keys, codes, n = [], [], max(1, len(self.w))
        self.base = [0]
        for r, u, w in zip(rows, us, ws, strict=True):
            runs = np.frombuffer(r["runs"], "<u4").astype(np.int64)
            size = int(runs.sum())
            wi = _ints(r["wi"], size)
            keys.append(np.repeat(np.searchsorted(self.u, u), runs) * n + (np.searchsorted(self.w, w)[wi] if size else wi))
            code = _ints(r["docs"], size)
            codes.append(code + 2 * self.base[-1])
            self.base.append(self.base[-1] + (int(code.max()) // 2 + 1 if size else 0))
        key = np.concatenate(keys)
        order = np.argsort(key, kind="stable")  # the blocks are sorted runs
        key, code = key[order], np.concatenate(codes).astype(np.int32)[order]
        del keys, codes, order
        self.doc, train = code >> 1, code & 1
        first = np.append(True, key[1:] != key[:-1])[: len(key)]
        self.pair = np.cumsum(first, dtype=np.int32) - 1
        of = key[first]
        del key, code
        self.pair_u, self.pair_w = of // n, of % n
        self.c = np.bincount(self.pair, train, len(of)).astype(np.int64)
        self.seen = np.flatnonzero(self.c)
        self.su, self.sw, self.sc = self.pair_u[self.seen], self.pair_w[self.seen], self.c[self.seen]
        self.cu = np.bincount(self.su, self.sc, len(self.u))

    def start(self, seed: int) -> tuple[np.ndarray, float]:
        """Tables after some sweeps below a parent of the bucket's own, and the discount."""
        t = np.ones(len(self.sc), np.int64)
        d = _discount(float((self.sc == 1).sum()), float((self.sc == 2).sum()))
        rng = np.random.default_rng([3, seed])
        for _ in range(START_SWEEPS):
            parent = np.bincount(self.sw, t, len(self.w))
            log_base = np.log((parent[self.sw] + 0.5) / (t.sum() + 0.5 * (len(self.w) + 1)))
            others = np.bincount(self.su, t, len(self.u))[self.su] - t
            t = sample_tables(self.sc, t, others, log_base, d, STRENGTH, rng)
        return t, d


def _hot_rows(bucket: _Bucket, hot: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Hot contexts of a bucket, and their places among its contexts."""
    at = np.flatnonzero(np.isin(bucket.u, hot))
    return bucket.u[at], at


def _ask(owners: int, hot: np.ndarray):
    def run(table: pa.Table) -> pa.Table:
        number = table["bucket"][0].as_py()
        bucket = _Bucket(table.to_pylist())
        t, _ = bucket.start(number)
        counts = np.bincount(bucket.sw, bucket.sc, len(bucket.w)).astype(np.int64)
        tables = np.bincount(bucket.sw, t, len(bucket.w)).astype(np.int64)
        totals = np.array([bucket.sc.sum(), t.sum(), (bucket.sc == 1).sum(), (bucket.sc == 2).sum()], "<i8").tobytes()
        edges = _owner_edges(bucket.w, owners)
        hu, at = _hot_rows(bucket, hot)
        tu = np.bincount(bucket.su, t, len(bucket.u))
        hot_edges = _owner_edges(hu, owners)
        rows = []
        for k in range(owners):
            a, b, x, y = edges[k], edges[k + 1], hot_edges[k], hot_edges[k + 1]
            parts = np.stack([hu[x:y].view("<i8"), bucket.cu[at[x:y]].astype("<i8"), tu[at[x:y]].astype("<i8")], axis=1)
            rows.append({"owner": k, "bucket": number, "words": bucket.w[a:b].tobytes(), "counts": counts[a:b].astype("<u4").tobytes(), "tables": tables[a:b].astype("<u4").tobytes(), "totals": totals, "hot": parts.tobytes()})
        return pa.Table.from_pylist(rows, schema=_arrow(_ASK))

    return run


def _answer(table: pa.Table) -> pa.Table:
    number, rows = table["owner"][0].as_py(), table.to_pylist()
    words = [np.frombuffer(r["words"], "<u8") for r in rows]
    w, at = np.unique(np.concatenate(words), return_inverse=True)
    counts = np.bincount(at, np.concatenate([np.frombuffer(r["counts"], "<u4") for r in rows]), len(w)).astype(np.int64)
    c = np.bincount(at, np.concatenate([np.frombuffer(r["tables"], "<u4") for r in rows]), len(w)).astype(np.int64)
    totals = np.sum([np.frombuffer(r["totals"], "<i8") for r in rows], axis=0)
    # the parent's dishes: its base is even over about all words, of which this owner has a part
    seen = np.flatnonzero(c)
    sc, t = c[seen], np.ones(len(seen), np.int64)
    d = _discount(float((sc == 1).sum()), float((sc == 2).sum()))
    share = sc.sum() / max(1, totals[1])
    log_base = np.full(len(seen), np.log(share / (len(seen) + 1)) if len(seen) else 0.0)
    rng, mass, every = np.random.default_rng([5, number]), np.zeros(len(w)), 0.0
    for k in range(BURN_SWEEPS + SAMPLES):
        t = sample_tables(sc, t, t.sum() / max(share, 1e-9) - t, log_base, d, PARENT_STRENGTH, rng)
        if k >= BURN_SWEEPS:
            mass[seen] += (sc - d * t) / SAMPLES
            every += d * t.sum() / SAMPLES
    hot = [np.frombuffer(r["hot"], "<i8").reshape(-1, 3) for r in rows]
    hu, place = np.unique(np.concatenate(hot)[:, 0], return_inverse=True)
    sums = np.stack([np.bincount(place, np.concatenate(hot)[:, k], len(hu)) for k in (1, 2)], axis=1)
    own = np.array([*totals, (counts > 0).sum(), every], "<f8").tobytes()
    out, a, x = [], 0, 0
    for r, v, h in zip(rows, words, hot, strict=True):
        rows_at, hot_at = at[a : a + len(v)], place[x : x + len(h)]
        out.append({"bucket": r["bucket"], "owner": number, "counts": counts[rows_at].astype("<u4").tobytes(), "mass": mass[rows_at].astype("<f4").tobytes(), "totals": own, "hot": sums[hot_at].astype("<f8").tobytes()})
        a, x = a + len(v), x + len(h)
    return pa.Table.from_pylist(out, schema=_arrow(_ANSWER))


def _score(hot: np.ndarray):
    def run(blocks: pa.Table, answers: pa.Table) -> pa.Table:
        number = blocks["bucket"][0].as_py()
        bucket, rows = _Bucket(blocks.to_pylist()), sorted(answers.to_pylist(), key=lambda r: r["owner"])
        totals = np.array([np.frombuffer(r["totals"], "<f8") for r in rows])
        n_train, tables, ones, twos = totals[0, :4]
        types, parent_discounted = totals[:, 4].sum(), totals[:, 5].sum()
        counts = np.concatenate([np.frombuffer(r["counts"], "<u4") for r in rows]).astype(np.int64)
        mass = np.concatenate([np.frombuffer(r["mass"], "<f4") for r in rows]).astype(float)
        p_parent = (mass + (PARENT_STRENGTH + parent_discounted) / (types + 1)) / (tables + PARENT_STRENGTH)
        d = _discount(ones, twos)
        t, _ = bucket.start(number)
        cu, elsewhere = bucket.cu.copy(), np.zeros(len(bucket.u))
        _, at = _hot_rows(bucket, hot)
        if len(at):
            whole = np.concatenate([np.frombuffer(r["hot"], "<f8").reshape(-1, 2) for r in rows])
            elsewhere[at] = whole[:, 1] - np.bincount(bucket.su, t, len(bucket.u))[at]
            cu[at] = whole[:, 0]
        rng, log_base, p = np.random.default_rng([7, number]), np.log(p_parent)[bucket.sw], np.zeros(len(bucket.c))
        of_parent = p_parent[bucket.pair_w]
        for k in range(BURN_SWEEPS + SAMPLES):
            others = (np.bincount(bucket.su, t, len(bucket.u)) + elsewhere)[bucket.su] - t
            t = sample_tables(bucket.sc, t, others, log_base, d, STRENGTH, rng)
            if k >= BURN_SWEEPS:
                tu = np.bincount(bucket.su, t, len(bucket.u)) + elsewhere
                own = (STRENGTH + d * tu)[bucket.pair_u] * of_parent
                own[bucket.seen] += bucket.sc - d * t
                p += own / (cu[bucket.pair_u] + STRENGTH) / SAMPLES
        c = counts[bucket.pair_w]
        n = bucket.base[-1]
        sums = np.stack([np.bincount(bucket.doc, x[bucket.pair], n) for x in (np.log10(c + 0.5), (c > 0).astype(float), np.log10(p))], axis=1)
        used = np.bincount(bucket.doc, minlength=n) > 0
        out = []
        for k, (a, b) in enumerate(zip(bucket.base[:-1], bucket.base[1:], strict=True)):
            docs = np.flatnonzero(used[a:b])
            out.append({"flush": bucket.flush[k], "docs": docs.astype("<u4").tobytes(), "sums": sums[a:b][docs].astype("<f8").tobytes(), "meta": None if bucket.meta[k] is None else np.array([n_train, types], "<f8").tobytes() + bucket.meta[k]})
        return pa.Table.from_pylist(out, schema=_arrow(_SUMS))

    return run


def _gather(schema: pa.Schema):
    def run(table: pa.Table) -> pa.Table:
        rows = table.to_pylist()
        meta = next(r["meta"] for r in rows if r["meta"] is not None)
        n_train, types = np.frombuffer(meta[:16], "<f8")
        own = pa.ipc.open_stream(pa.py_buffer(meta[16:])).read_all()
        n = own["size"].to_numpy()
        sums = np.zeros((len(n), 3))
        for r in sorted(rows, key=lambda r: (len(r["docs"]), r["docs"], r["sums"])):  # in a fixed order
            sums[np.frombuffer(r["docs"], "<u4")] += np.frombuffer(r["sums"], "<f8").reshape(-1, 3)
        base = sums[:, 0] - n * np.log10(n_train + 0.5 * (types + 1))
        columns = [own["id"], pa.array(n), pa.array(np.rint(sums[:, 1]).astype(np.int64)), pa.array(np.full(len(n), int(n_train))), pa.array(base), pa.array(sums[:, 2])]
        return pa.Table.from_arrays([x.cast(f.type) for x, f in zip(columns, schema, strict=True)], schema=schema)

    return run


# --- operator ----------------------------------------------------------------


def _frequent(docs: DataFrame, share: float, sample: int) -> np.ndarray:
    """Contexts with at least a share of the tokens of about every ``sample``-th document: at most 1 / share of them."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for u, _, _ in _tokens(batch.column(0)):
                own, n = np.unique(u, return_counts=True)
                much = n >= max(2, len(u) * share / 2)
                yield pa.RecordBatch.from_arrays([pa.array(np.append(own[much], np.uint64(0)).view(np.int64)), pa.array(np.append(n[much], len(u)))], names=["u", "n"])

    picked = docs.where(F.pmod(F.xxhash64("_text"), F.lit(sample)) == 0).select("_text")
    counts = picked.mapInArrow(run, "u long, n long").groupBy("u").agg(F.sum("n").alias("n"))
    total = (counts.where("u = 0").first() or {"n": 0})["n"]
    rows = counts.where((F.col("u") != 0) & (F.col("n") >= F.lit(share * total))).collect() if total else []
    return np.sort(np.array([r["u"] for r in rows], np.int64).view(np.uint64))


def score_documents(docs: DataFrame, train: Column, *, buckets: int | None = None, layout_sample: int = 16, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, n_tokens, n_known, train_tokens, base_score and score of every document.

    ``train``: the documents that the model learns from.  ``base_score`` is the
    smoothed unigram log10 probability, ``score`` the model's.
    """
    rows = docs.select(F.col(id_col).alias("_id"), F.col(text_col).alias("_text"), F.coalesce(train, F.lit(False)).alias("_train"))
    buckets = buckets or max(8, 2 * rows.rdd.getNumPartitions())
    hot = _frequent(rows, 1 / (8 * buckets), layout_sample)
    blocks = rows.mapInArrow(_blocks(buckets, hot), _BLOCK)
    asked = blocks.groupBy("bucket").applyInArrow(_ask(buckets, hot), _ASK)
    answers = asked.groupBy("owner").applyInArrow(_answer, _ANSWER)
    sums = blocks.groupBy("bucket").cogroup(answers.groupBy("bucket")).applyInArrow(_score(hot), _SUMS)
    fields = [T.StructField("doc_id", docs.schema[id_col].dataType), *(T.StructField(c, T.LongType()) for c in ("n_tokens", "n_known", "train_tokens")), T.StructField("base_score", T.DoubleType()), T.StructField("score", T.DoubleType())]
    from pyspark.sql.pandas.types import to_arrow_schema

    return sums.groupBy("flush").applyInArrow(_gather(to_arrow_schema(T.StructType(fields))), T.StructType(fields))
