"""Operator 5: near-duplicates by SimHash and Golay-code fuzzy hashing.

A fingerprint is cut into segments of up to 23 bits.  The binary Golay code of
length 23 is perfect: each word lies within 3 bits of one codeword.  A segment
is decoded to all codewords within 4 bits, 1 or 6 of them.  Two segments that
differ in at most 2 bits always share one: the codeword within 3 bits of a word
between them is within 4 of both.

``link_fingerprints`` links 64-bit fingerprints at 2 or fewer differing bits.
They have three segments, so of two errors at least one segment has none
(pigeonhole) and every other has at most two.  A key is an unchanged segment
with a codeword of the next one; where more than ``SPLIT`` fingerprints share a
key, a codeword of the third segment is added, and at most 11,000 ** 2
different fingerprints (those within 4 bits of two codewords) can share that.
Members of a key are verified bit by bit and leave only a tree of links for
each cluster, not a row for each pair.  Equal fingerprints are one row
throughout.
"""

from __future__ import annotations

import itertools
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from . import common
from .graph import components

SEGMENT = 23
#: Members of a key above which a codeword is added.
SPLIT = 512
#: The generator polynomial of the binary Golay code (fixed value).
GENERATOR = 0b110001110101
_TABLES: dict[str, np.ndarray] = {}


# --- Golay code --------------------------------------------------------------


def _syndrome(word: int) -> int:
    for bit in range(SEGMENT - 1, 10, -1):
        if word >> bit & 1:
            word ^= GENERATOR << (bit - 11)
    return word


def _tables() -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Syndromes of the low 12 and the high 11 bits; error patterns of each syndrome (0-3 bits first, then 4)."""
    if not _TABLES:
        unit = [_syndrome(1 << b) for b in range(SEGMENT)]
        for name, first, bits in (("low", 0, 12), ("high", 12, 11)):
            table = np.zeros(1 << bits, np.int64)
            for b in range(bits):
                table[1 << b : 2 << b] = table[: 1 << b] ^ unit[first + b]
            _TABLES[name] = table
        patterns = np.full((1 << 11, 6), -1, np.int64)
        filled = np.zeros(1 << 11, int)
        for weight in range(5):
            for bits in itertools.combinations(range(SEGMENT), weight):
                s = 0
                for b in bits:
                    s ^= unit[b]
                if weight < 4 or patterns[s, 0] >= 0 and int(patterns[s, 0]).bit_count() == 3:
                    patterns[s, filled[s]] = sum(1 << b for b in bits)
                    filled[s] += 1
        _TABLES["patterns"] = patterns
    return _TABLES["low"], _TABLES["high"], _TABLES["patterns"]


def codeword_indices(segments: np.ndarray) -> np.ndarray:
    """Indices (12 bits) of the codewords within 4 bits of each 23-bit word: six more places for each, -1 where there is only one."""
    low, high, patterns = _tables()
    found = patterns[low[segments & 0xFFF] ^ high[segments >> 12]]
    return np.where(found >= 0, (segments[..., None] ^ found) >> 11, -1)


# --- fingerprints ------------------------------------------------------------


def shingle_hashes(text: str | None, words: int) -> np.ndarray:
    """XXH64 (seed 42) of the shingles of a text, A-Z lower-cased, repeats included; one for a shorter text, none for an empty one."""
    found = (text or "").encode("utf-8", "surrogatepass").lower().split()
    if not found:
        return np.zeros(0, np.uint64)
    joined, hashed = b" ".join(found), xxhash.xxh64_intdigest
    ends = np.cumsum([len(w) + 1 for w in found]) - 1
    starts = np.concatenate([[0], ends[:-1] + 1])
    k = max(1, len(found) - words + 1)
    return np.array([hashed(joined[a:b], 42) for a, b in zip(starts[:k].tolist(), ends[-k:].tolist(), strict=True)], np.uint64)


def majority_bits(hashes: np.ndarray) -> int:
    """The 64-bit number whose bits are set in over half the hashes."""
    if not len(hashes):
        return 0
    ones = np.zeros(64, np.int64)
    for at in range(0, len(hashes), 1 << 14):
        ones += np.unpackbits(hashes[at : at + (1 << 14)].astype("<u8").view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(0, dtype=np.int64)
    return int(np.packbits(2 * ones > len(hashes), bitorder="little").view("<u8")[0])


def fingerprints(docs: DataFrame, *, words: int = 3, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id and fp (64 bits as a signed long) of each document."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in common.slices(batches):
            fps = np.array([majority_bits(shingle_hashes(t, words)) for t in batch.column(1).to_pylist()], np.uint64)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(fps.view(np.int64))], names=["doc_id", "fp"])

    schema = T.StructType([T.StructField("doc_id", docs.schema[id_col].dataType), T.StructField("fp", T.LongType())])
    return docs.select(id_col, text_col).mapInArrow(run, schema)


# --- links -------------------------------------------------------------------


def _segments(fps: np.ndarray) -> list[np.ndarray]:
    u = fps.view(np.uint64)
    mask = np.uint64((1 << SEGMENT) - 1)
    return [(u & mask).astype(np.int64), (u >> np.uint64(23) & mask).astype(np.int64), (u >> np.uint64(46)).astype(np.int64)]


def _first_keys(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        fps = batch.column(0).to_numpy()
        parts = _segments(fps)
        for i in range(3):
            codes = codeword_indices(parts[(i + 1) % 3])
            row, col = np.nonzero(codes >= 0)
            yield pa.RecordBatch.from_arrays([pa.array((i << 35) + (parts[i][row] << 12) + codes[row, col]), pa.array(fps[row])], names=["key", "fp"])


def _second_keys(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        keys, fps = batch.column(0).to_numpy(), batch.column(1).to_numpy()
        parts, which = _segments(fps), keys >> 35
        third = np.choose((which + 2) % 3, parts) if len(fps) else np.zeros(0, np.int64)
        codes = codeword_indices(third)
        row, col = np.nonzero(codes >= 0)
        yield pa.RecordBatch.from_arrays([pa.array((keys[row] << 12) + codes[row, col] + (1 << 60)), pa.array(fps[row])], names=["key", "fp"])


def close_links(fps: np.ndarray, most: int) -> list[tuple[int, int]]:
    """A tree of links for each cluster of 64-bit numbers within ``most`` bits of each other, step by step."""
    u = np.unique(fps).view(np.uint64)
    n, root = len(u), np.arange(len(u))
    step = max(1, (1 << 22) // max(n, 1))
    changed = True
    while changed:
        changed = False
        for a in range(0, n, step):
            near = np.bitwise_count(u[a : a + step, None] ^ u[None, :]) <= most
            least = np.where(near, root[None, :], n).min(1)
            if (least < root[a : a + step]).any():
                root[a : a + step] = np.minimum(root[a : a + step], least)
                changed = True
        while (root[root] != root).any():
            root = root[root]
    signed = u.view(np.int64)
    return [(int(signed[k]), int(signed[root[k]])) for k in np.flatnonzero(root != np.arange(n))]


def _links(most: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = set()
            for fps in batch.column(0):
                found.update(close_links(np.array(fps.values.to_numpy(zero_copy_only=False)), most))
            yield pa.RecordBatch.from_pydict({"u": [a for a, _ in found], "v": [b for _, b in found]}, schema=pa.schema([("u", pa.int64()), ("v", pa.int64())]))

    return run


def link_fingerprints(fps: DataFrame, split: int = SPLIT) -> DataFrame:
    """Links (u, v) between different fingerprints that make all clusters at 2 or fewer differing bits.

    ``fps``: one column fp of different 64-bit fingerprints.
    """
    keys = fps.mapInArrow(_first_keys, "key long, fp long")
    shared = keys.groupBy("key").agg(F.count("*").alias("n")).where("n > 1")
    keys = keys.join(shared, "key")
    few = keys.where(F.col("n") <= split).select("key", "fp")
    more = keys.where(F.col("n") > split).select("key", "fp").mapInArrow(_second_keys, "key long, fp long")
    groups = few.unionByName(more).groupBy("key").agg(F.collect_list("fp").alias("fps")).where(F.size("fps") > 1)
    return groups.select("fps").mapInArrow(_links(2), "u long, v long").distinct()


def near_duplicate_classes(docs: DataFrame, *, words: int = 3, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, fp and component_id, the least doc_id of those reachable over links of at most 2 bits.

    Defined cases: null, empty and wordless texts have fingerprint 0, which
    links like any other; fewer words than a shingle make one shingle; repeated
    rows get a row each; a null id gets a row and is never the least; an empty
    table gives no rows.
    """
    rows = common.checkpoint(fingerprints(docs, words=words, id_col=id_col, text_col=text_col))
    least = common.checkpoint(rows.groupBy("fp").agg(F.min("doc_id").alias("least")))
    roots = components(link_fingerprints(least.select("fp")))
    linked = least.join(roots, least["fp"] == roots["node"], "left").select("fp", "least", F.coalesce("root", "fp").alias("root"))
    by_root = linked.groupBy("root").agg(F.min("least").alias("component_id"))
    classes = linked.join(by_root, "root").select("fp", "component_id")
    return rows.join(classes, "fp").select("doc_id", "fp", "component_id")


# --- classes at a shingle similarity -----------------------------------------

#: 64-bit words of a sketch, and bits by which two sketches may differ beyond the mean of their similarity, in standard deviations.
SKETCH_WORDS, DEVIATIONS = 8, 3
#: Words of a sketch that are cut to segments, and the segments, each of which gives keys with an extreme of the shingles' hashes.
KEY_WORDS = 4
SEGMENTS = 64 * KEY_WORDS // SEGMENT
#: Hash functions whose least and greatest values are the extremes; the first are those of the sketch.
FUNCTIONS = -(-SEGMENTS // 2)
#: Further candidates of a node in a group: in the first round of all keys, and how many times as many in each further round.
NEAREST, MORE = 2, 16
_SKETCH = [f"_s{k}" for k in range(SKETCH_WORDS)]
_EXTREMES = [f"_m{k}" for k in range(SEGMENTS)]
#: The low 32 bits of the extremes, two to a long.
_MARKS = [f"_e{k}" for k in range(-(-SEGMENTS // 2))]


def bit_sums(hashes: np.ndarray, counts: np.ndarray) -> np.ndarray:
    """How many of each document's hashes have each bit: documents x 64.

    Bytes are added eight at a time, in runs of at most 255.
    """
    ends = np.cumsum(counts)
    runs = -(-counts // 255)
    doc = np.repeat(np.arange(len(counts)), runs)
    within = np.arange(len(doc)) - np.repeat(np.cumsum(runs) - runs, runs)
    starts = (ends - counts)[doc] + 255 * within
    out = np.zeros((len(counts), 64), np.int64)
    if len(hashes):
        lanes = np.unpackbits(hashes.astype("<u8").view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").view("<u8")
        parts = np.add.reduceat(lanes, starts, axis=0).view(np.uint8).astype(np.int64)
        filled = np.flatnonzero(runs)
        out[filled] = np.add.reduceat(parts, (np.cumsum(runs) - runs)[filled], axis=0)
    return out


def shingle_sets(column: pa.Array, words: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """For chunks of texts: the different 64-bit shingle hashes of each text, ascending, and their number.

    A text of fewer words is one shingle, one without words has none.
    """
    for _, _, data, offsets in common.text_chunks(column):
        data = common.lower(data)
        starts, ends, n = common.word_spans(data, offsets)
        h = common.span_hashes(data, starts, ends)
        first, k = np.cumsum(n) - n, np.where(n > 0, np.maximum(n - words + 1, 1), 0)
        at = np.repeat(first, k) + np.arange(k.sum()) - np.repeat(np.cumsum(k) - k, k)
        last = np.repeat(first + n, k)
        own = np.zeros(len(at), np.uint64)
        with np.errstate(over="ignore"):
            for j in range(words if len(h) else 0):
                own = common.mix(own * np.uint64(0x9E3779B97F4A7C15) + np.where(at + j < last, h[np.minimum(at + j, len(h) - 1)], np.uint64(0)))
        doc = np.repeat(np.arange(len(n)), k)
        order = np.lexsort((own, doc))
        own, doc = own[order], doc[order]
        new = np.ones(len(own), bool)
        new[1:] = (own[1:] != own[:-1]) | (doc[1:] != doc[:-1])
        yield own[new], np.bincount(doc[new], minlength=len(n))


def sketches(column: pa.Array, words: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Documents x SKETCH_WORDS: majority bits over the different shingles, each hashed anew for each word of the sketch.

    And the least and greatest hashes (documents x SEGMENTS), and a hash of the whole set; all 0 without shingles.
    """
    out, extremes, names = [np.zeros((0, SKETCH_WORDS), np.uint64)], [np.zeros((0, 2 * FUNCTIONS), np.uint64)], [np.zeros(0, np.uint64)]
    for own, k in shingle_sets(column, words):
        bits, ends_of, name = np.zeros((len(k), SKETCH_WORDS), np.uint64), np.zeros((len(k), 2 * FUNCTIONS), np.uint64), np.zeros(len(k), np.uint64)
        filled = np.flatnonzero(k)
        runs = (np.cumsum(k) - k)[filled]
        for w in range(max(FUNCTIONS, SKETCH_WORDS)):
            with np.errstate(over="ignore"):
                hashed = common.mix(own + np.uint64(w + 1) * np.uint64(0xC2B2AE3D27D4EB4F))
                if w == 0 and len(filled):
                    name[filled] = common.mix(np.add.reduceat(hashed, runs) + k[filled].astype(np.uint64))
            if w < SKETCH_WORDS:
                bits[:, w] = np.packbits(2 * bit_sums(hashed, k) > k[:, None], axis=1, bitorder="little").view("<u8")[:, 0]
            if w < FUNCTIONS and len(filled):
                ends_of[filled, 2 * w], ends_of[filled, 2 * w + 1] = np.minimum.reduceat(hashed, runs), np.maximum.reduceat(hashed, runs)
        out.append(bits)
        extremes.append(ends_of)
        names.append(name)
    return np.concatenate(out), np.concatenate(extremes)[:, :SEGMENTS], np.concatenate(names)


def _sketch_segments(words: np.ndarray) -> np.ndarray:
    """The 23-bit segments of sketches: documents x SEGMENTS."""
    bits = np.unpackbits(words[:, :KEY_WORDS].astype("<u8").view(np.uint8).reshape(len(words), -1), axis=1, bitorder="little")[:, : SEGMENTS * SEGMENT]
    return bits.reshape(len(words), SEGMENTS, SEGMENT) @ (1 << np.arange(SEGMENT, dtype=np.int64))


def _sketch_keys(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Each segment gives a key for every codeword within 4 bits of it, with an extreme hash.

    The low 4 bits of a key tell the segment, the next 12 the codeword.
    """
    for batch in common.slices(batches):
        columns = [c.to_numpy() for c in batch.columns]
        node, segments = columns[0], _sketch_segments(np.stack([c.view(np.uint64) for c in columns[1 : 1 + SKETCH_WORDS]], axis=1))
        for j in range(SEGMENTS):
            codes = codeword_indices(segments[:, j])
            row, col = np.nonzero(codes >= 0)
            extreme = columns[1 + SKETCH_WORDS + j].view(np.uint64)
            low = ((codes[row, col] << 4) + j).astype(np.uint64)
            keys = common.mix(extreme[row] + low) >> np.uint64(16) << np.uint64(16) | low
            yield pa.RecordBatch.from_arrays([pa.array(keys.view(np.int64)), pa.array(node[row])], names=["key", "node"])


def most_bits(similarity: float) -> int:
    """Differing bits of two sketches at a Jaccard similarity of their shingles, with DEVIATIONS standard deviations more."""
    p = float(np.arccos(2 * similarity / (1 + similarity)) / np.pi)
    n = 64 * SKETCH_WORDS
    return round(n * p + DEVIATIONS * (n * p * (1 - p)) ** 0.5)


def _marks(extremes: np.ndarray) -> np.ndarray:
    """The low 32 bits of extremes (documents x SEGMENTS, 64 bits), two to a long."""
    low = np.zeros((len(extremes), 2 * len(_MARKS)), "<u4")
    low[:, :SEGMENTS] = extremes & np.uint64(0xFFFFFFFF)
    return low.view("<i8")


def _side(members: list[np.ndarray]) -> tuple[np.ndarray, ...]:
    """By node: node, class, bits and last of the mark, words of the sketch, codewords (members x SEGMENTS x 6) and marks of the extremes (members x SEGMENTS)."""
    order = np.argsort(members[0], kind="stable")
    members = [m[order] for m in members]
    words = np.stack([w.view(np.uint64) for w in members[4 : 4 + SKETCH_WORDS]], axis=1)
    marks = np.stack(members[4 + SKETCH_WORDS :], axis=1).view("<u4")[:, :SEGMENTS]
    return *members[:4], words, codeword_indices(_sketch_segments(words)), marks


def _first_shared(codes: tuple[np.ndarray, np.ndarray], marks: tuple[np.ndarray, np.ndarray], i: np.ndarray, j: np.ndarray, key: int) -> np.ndarray:
    """Of pairs of members i and j of a key: those that have no key of an earlier segment, or of a lesser codeword, in common."""
    segment, code, own = key & 15, key >> 4 & 4095, np.ones(len(i), bool)
    for s in range(segment + 1):
        at = np.flatnonzero(own & (marks[0][i, s] == marks[1][j, s])) if s < segment else np.flatnonzero(own)
        a, b = codes[0][i[at], s], codes[1][j[at], s]
        both = (a[:, :, None] == b[:, None, :]) & (a[:, :, None] >= 0)
        own[at] = ~(both if s < segment else both & (a[:, :, None] < code)).any((1, 2))
    return own


def _beyond(bits: np.ndarray, mark: tuple[np.ndarray, np.ndarray], nodes: np.ndarray) -> np.ndarray:
    """Which nodes (columns) come after the mark (bits, last) of a member (rows) in its order, by bits and node."""
    return (bits > mark[0][:, None]) | (bits == mark[0][:, None]) & (nodes[None, :] > mark[1][:, None])


def _next_mark(bits: np.ndarray, near: np.ndarray, mark: tuple[np.ndarray, np.ndarray], nodes: np.ndarray, nearest: int) -> tuple[np.ndarray, np.ndarray]:
    """The marks after ``nearest`` more of the near nodes (columns, ascending)."""
    place = np.where(near & _beyond(bits, mark, nodes), bits.astype(np.int64) * len(nodes) + np.arange(len(nodes)), 1 << 40)
    kept = min(nearest, len(nodes))
    last = np.partition(place, kept - 1, axis=1)[:, :kept]
    last = np.where(last < 1 << 40, last, -1).max(1)
    return np.where(last >= 0, last // len(nodes), mark[0]), np.where(last >= 0, nodes[last % len(nodes)], mark[1])


def candidates(left: tuple[np.ndarray, ...], right: tuple[np.ndarray, ...] | None, most: int, nearest: int, least: bool, key: int) -> tuple[np.ndarray, np.ndarray]:
    """Pairs (u, v) of nodes of unlike classes whose sketches differ in at most ``most`` bits, and open members (node, last, bits).

    Without a right side the left one meets itself.  The close nodes of the
    other side have a fixed order for each member, by bits and node, whatever
    their classes.  The next ``nearest`` after its mark are taken, and with
    ``least`` the one with the least number; the last that is taken is its new
    mark.  A member is open as long as a pair of it comes after the marks of
    both; the others need not meet again.  A pair that has several keys in
    common is left to the first of them.
    """
    other = left if right is None else right
    bits = np.zeros((len(left[0]), len(other[0])), np.int16)
    for k in range(SKETCH_WORDS):
        bits += np.bitwise_count(left[4][:, None, k] ^ other[4][None, :, k])
    near = (bits <= most) & (left[0][:, None] != other[0][None, :])
    after = near & (left[1][:, None] != other[1][None, :])
    marks = [left[2:4], other[2:4]]
    after &= _beyond(bits, marks[0], other[0]) & _beyond(bits.T, marks[1], left[0]).T
    marks[0] = _next_mark(bits, near, marks[0], other[0], nearest)
    marks[1] = marks[0] if right is None else _next_mark(bits.T, near.T, marks[1], left[0], nearest)
    now = after & ~(_beyond(bits, marks[0], other[0]) & _beyond(bits.T, marks[1], left[0]).T)
    if least and after.size:  # argmax: the first of them
        rows, cols = np.flatnonzero(after.any(1)), np.flatnonzero(after.any(0))
        now[rows, after[rows].argmax(1)] = True
        now[after[:, cols].argmax(0), cols] = True
    i, j = np.nonzero(np.triu(after) if right is None else after)
    for at in range(0, len(i), 1 << 16):
        a, b = i[at : at + (1 << 16)], j[at : at + (1 << 16)]
        after[a, b] = _first_shared((left[5], other[5]), (left[6], other[6]), a, b, key)
    if right is None:
        after = np.triu(after)
        now |= now.T
    i, j = np.nonzero(after & now)
    pairs = np.stack([np.minimum(left[0][i], other[0][j]), np.maximum(left[0][i], other[0][j])], axis=1)
    after &= ~now
    still = [after.any(1) | after.any(0), np.zeros(len(other[0]), bool)] if right is None else [after.any(1), after.any(0)]
    members = [np.stack([side[0][on], last[on], of_bits[on]], axis=1) for side, on, (of_bits, last) in zip((left, other), still, marks, strict=True)]
    return pairs, np.concatenate(members)


def _pairs(most: int, nearest: int, least: bool):
    """Candidate pairs of groups: rows (key, left, right) of members, right null for a group met with itself.

    Out come rows (null, u, v, null), and (key, node, last, bits) of the open members with their marks.
    """
    schema = pa.schema([("key", pa.int64()), ("u", pa.int64()), ("v", pa.int64()), ("bits", pa.int64())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found, still, keys = [np.zeros((0, 2), np.int64)], [np.zeros((0, 3), np.int64)], [np.zeros(0, np.int64)]
            for r, key in enumerate(batch.column(0).to_pylist()):
                left, right = (_side([f.to_numpy() for f in batch.column(c)[r].values.flatten()]) if batch.column(c)[r].is_valid else None for c in (1, 2))
                pairs, members = candidates(left, right, most, nearest, least, key)
                found.append(pairs)
                still.append(members)
                keys.append(np.full(len(members), key))
            pairs, members = np.unique(np.concatenate(found), axis=0), np.concatenate(still)
            none = pa.nulls(len(pairs), pa.int64())
            yield pa.RecordBatch.from_arrays([none, pa.array(pairs[:, 0]), pa.array(pairs[:, 1]), none], schema=schema)
            yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(keys)), *(pa.array(members[:, k]) for k in range(3))], schema=schema)
        common.give_back()

    return run


def _similar(similarity: float):
    """Pairs (u, v, left, right) whose sets of shingle hashes reach the Jaccard similarity."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keep = np.zeros(batch.num_rows, bool)
            for r in range(batch.num_rows):
                a, b = (np.frombuffer(batch.column(c)[r].as_buffer(), "<u8") for c in (2, 3))
                both = len(a) + len(b) - len(np.union1d(a, b))
                keep[r] = both >= similarity * (len(a) + len(b) - both) - 1e-9
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1)], names=["u", "v"]).filter(pa.array(keep))
        common.give_back()

    return run


def verified(pairs: DataFrame, sets: DataFrame, similarity: float, share: int = 256) -> DataFrame:
    """The pairs (u, v) whose sets (node, shingles) reach the similarity.

    A node with many pairs is dealt with its set to one place for each ``share`` of them.
    """
    many = pairs.groupBy("u").agg(F.ceil(F.count("*") / share).cast("int").alias("parts"))
    dealt = pairs.join(many, "u").select("u", "v", F.pmod(F.hash("v"), F.col("parts")).alias("part"))
    of_u = sets.join(many, sets["node"] == many["u"]).select("u", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)).alias("part"), F.col("shingles").alias("left"))
    of_v = sets.select(F.col("node").alias("v"), F.col("shingles").alias("right"))
    return dealt.join(of_u, ["u", "part"]).join(of_v, "v").select("u", "v", "left", "right").mapInArrow(_similar(similarity), "u long, v long")


def shared_keys(nodes: DataFrame) -> DataFrame:
    """key, node, n: the keys that n > 1 nodes (node, sketch, extremes) have.

    A key is a codeword of a segment with the least or greatest hash of the
    shingles, which similar texts share with the probability of their
    similarity; without it, random documents would share keys as the square of
    their number.  Of keys that have the same nodes, whatever their segments,
    only the first stays, as a pair is left to the first of its keys.
    """
    keys = nodes.select("node", *_SKETCH, *_EXTREMES).mapInArrow(_sketch_keys, "key long, node long")
    shared = keys.groupBy("key").agg(F.count("*").alias("n"), F.bit_xor(F.xxhash64("node")).alias("a"), F.sum(F.xxhash64(F.lit(1), "node").bitwiseAND(F.lit(0xFFFFFFFF))).alias("b")).where("n > 1")
    segment, codeword = F.col("key").bitwiseAND(F.lit(15)), F.shiftright("key", 4).bitwiseAND(F.lit(4095))
    shared = shared.groupBy("n", "a", "b").agg(F.min_by("key", F.struct(segment, codeword)).alias("key")).select("key", "n")
    return common.stored(keys.join(shared, "key").select("key", "node", "n"), "keys")


def similar_roots(nodes: DataFrame, keys: DataFrame, sets: DataFrame, similarity: float, split: int = SPLIT) -> DataFrame:
    """node, root of the classes that links at a similarity make.

    In each round the nodes of a key that aren't in one class yet give
    candidates: for each node the nearest ones by their sketches, and the least,
    as far as they are of other classes.  Candidates are verified by their whole sets of
    shingles, and classes are joined along those that pass.  The first round
    takes the keys of one segment only, which joins most of a large group of
    copies, so that the keys of the others have few unlike nodes.  Rounds go on
    with more candidates over the nodes of keys that are open, each with a mark of
    how far it came, until no node of a key has
    a candidate that wasn't tested, so every pair with a common key and close
    sketches is either in one class or tested.  A key with up to ``split`` nodes is one row of the work, one with
    more is cut to blocks of which each pair is a row.
    """
    most, nearest, shape = most_bits(similarity), 1, "key long, u long, v long, bits long"
    member = F.collect_list(F.struct("node", "class", "bits", "last", *_SKETCH, *_MARKS))
    tested = roots = None

    def of_nodes(keys: DataFrame) -> DataFrame:
        """A row for each node with its keys, of which it has a bounded number, so that sketches meet nodes and not keys."""
        return common.stored(keys.groupBy("node").agg(F.collect_list(F.struct("key", "n", "bits", "last")).alias("keys")), "keys-of-nodes")

    keys = keys.select("key", "node", "n", F.lit(-1).cast("long").alias("bits"), F.lit(0).cast("long").alias("last"))
    one_segment = F.col("key").bitwiseAND(F.lit(15)) == 0
    by_node = of_nodes(keys.where(one_segment))
    while True:
        first = roots is None
        sketch = nodes.select("node", F.col("node").alias("class"), *_SKETCH, *_MARKS)
        if not first:
            sketch = nodes.select("node", *_SKETCH, *_MARKS).join(roots, "node", "left").select("node", F.coalesce("root", "node").alias("class"), *_SKETCH, *_MARKS)

        def members(fits, sketch: DataFrame = sketch, by_node: DataFrame = by_node) -> DataFrame:
            """key, n and a member of it, for the keys of this round that fit."""
            some = by_node.select("node", F.filter("keys", lambda k: fits(k["n"])).alias("keys")).where(F.size("keys") > 0)
            return some.join(sketch, "node").select("node", "class", *_SKETCH, *_MARKS, F.explode("keys").alias("k")).select("k.*", "node", "class", *_SKETCH, *_MARKS)

        unlike = F.min("class") < F.max("class")
        whole = members(lambda n: n <= split).groupBy("key").agg(member.alias("left"), unlike.alias("unlike")).where("unlike")
        whole = whole.select("key", "left", F.lit(None).cast(whole.schema["left"].dataType).alias("right"))
        many = members(lambda n: n > split).withColumn("blocks", F.ceil(F.col("n") / (2 * split))).withColumn("i", F.pmod(F.xxhash64("node"), "blocks"))
        blocks = many.groupBy("key", "i", "blocks").agg(member.alias("members"), F.min("class").alias("least"), F.max("class").alias("most"))
        blocks = common.stored(blocks, "blocks")
        written = blocks
        open_keys = blocks.groupBy("key").agg((F.min("least") < F.max("most")).alias("unlike")).where("unlike").select("key")
        blocks = blocks.join(open_keys, "key", "left_semi")
        one = blocks.select("key", "i", F.col("members").alias("left"), F.explode(F.sequence("i", F.col("blocks") - 1)).alias("j"))
        other = blocks.select("key", F.col("i").alias("j"), F.col("members").alias("right"))
        between = one.join(other, ["key", "j"]).select("key", "left", F.when(F.col("i") != F.col("j"), F.col("right")).alias("right"))
        step = _pairs(most, nearest, nearest <= NEAREST)
        found = common.stored(whole.mapInArrow(step, shape).unionByName(between.mapInArrow(step, shape)).distinct(), "candidates")
        common.remove(written)
        pairs = found.where("key IS NULL").select("u", "v")
        new = common.stored(pairs if tested is None else pairs.join(tested, ["u", "v"], "left_anti"), "new")
        # a node of several blocks goes on from the least of its marks
        left = found.where("key IS NOT NULL").groupBy("key", F.col("u").alias("node")).agg(F.min(F.struct("bits", F.col("v").alias("last"))).alias("mark"))
        left = common.stored(left.select("key", "node", "mark.*"), "open")
        common.remove(found)
        passed = common.stored(verified(new, sets, similarity), "similar")
        # what is linked already goes on as a star of each class
        links = passed if first else roots.select(F.col("node").alias("u"), F.col("root").alias("v")).unionByName(passed)
        tested = new if tested is None else tested.unionByName(new)
        roots = components(links)
        common.remove(passed)
        if not first and left.isEmpty():
            return roots
        still = left.join(left.groupBy("key").agg(F.count("*").alias("n")), "key").select("key", "node", "n", "bits", "last")
        before, by_node = by_node, of_nodes(still.unionByName(keys.where(~one_segment)) if first else still)
        common.remove(before)
        nearest = NEAREST if first else nearest * MORE


def keep_one(docs: DataFrame, *, words: int = 5, similarity: float = 0.8, split: int = SPLIT, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One document of each class of near duplicates, the one with the least id, with all its columns.

    Classes are reached over links between documents whose sets of shingles
    have at least the Jaccard similarity.  Defined cases: null, empty and
    wordless texts are one class; null ids come last; of rows with the same id
    the text that hashes lowest stays; of equal rows one stays; columns may
    have any names.
    """
    parts = [F.col(id_col).cast("string"), F.col(text_col)]
    keyed = docs.select(F.struct(*(F.col(f"`{c}`") for c in docs.columns)).alias("row"), F.col(id_col).alias("id"), F.col(text_col).alias("text"), F.xxhash64(*parts).alias("k1"), F.xxhash64(F.lit(1), *parts).alias("k2"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in common.slices(batches):
            bits, extremes, name = sketches(batch.column(3), words)
            s = np.concatenate([name[:, None].view(np.int64), bits.view(np.int64), extremes.view(np.int64), _marks(extremes)], axis=1)
            yield pa.RecordBatch.from_arrays([*batch.columns[:3], *(pa.array(s[:, k]) for k in range(s.shape[1]))], names=["id", "k1", "k2", "node", *_SKETCH, *_EXTREMES, *_MARKS])

    def whole_sets(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in common.slices(batches):
            at = 0
            for own, k in shingle_sets(batch.column(1), words):
                ends = np.concatenate([[0], np.cumsum(k)]) * 8
                sets = pa.Array.from_buffers(pa.binary(), len(k), [None, pa.py_buffer(ends.astype(np.int32)), pa.py_buffer(own.astype("<u8"))])
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(at, len(k)), sets], names=["node", "shingles"])
                at += len(k)

    schema = T.StructType([T.StructField("id", docs.schema[id_col].dataType), *(T.StructField(c, T.LongType()) for c in ("k1", "k2", "node", *_SKETCH, *_EXTREMES, *_MARKS))])
    rows = common.stored(keyed.select("id", "k1", "k2", "text").mapInArrow(run, schema), "sketches")
    order = F.struct(F.col("id").isNull().alias("none"), "id", "k1", "k2")
    nodes = rows.groupBy("node").agg(F.min(order).alias("least"), F.first(F.struct(*_SKETCH, *_EXTREMES, *_MARKS)).alias("s"))
    nodes = common.stored(nodes.select("node", "least", "s.*"), "nodes")
    common.remove(rows)
    keys = shared_keys(nodes)
    # the texts travel once: one of each set that shares a key
    chosen = nodes.join(keys.select("node").distinct(), "node", "left_semi").select("node", "least.k1", "least.k2")
    texts = keyed.select("k1", "k2", "text").join(chosen, ["k1", "k2"]).select("node", "text")
    sets = common.stored(texts.mapInArrow(whole_sets, "node long, shingles binary").dropDuplicates(["node"]), "shingles")
    roots = similar_roots(nodes, keys, sets, similarity, split)
    classed = nodes.join(roots, "node", "left").withColumn("root", F.coalesce("root", "node"))
    kept = classed.groupBy("root").agg(F.min("least").alias("least")).select("least.k1", "least.k2")
    stay = keyed.join(kept, ["k1", "k2"], "left_semi").dropDuplicates(["k1", "k2"])
    return stay.select("row.*")
