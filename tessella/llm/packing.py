"""Operator 2: best-fit packing by large-item matching.

Documents become runs of token ids; only those longer than a sequence are cut.
Pieces above a third of the capacity share a sequence with at most one other
such piece: taken from the largest down, each is matched with the largest that
still fits beside it.  Smaller pieces, again from the largest down, go to the
sequence with the smallest gap that holds them.

A plan needs only how many pieces there are of each length (at most
``capacity`` numbers), so the driver works on that histogram, whatever the
size of the corpus: runs of equal pieces are placed at once, and the plan is a
short list of (length, ranks, sequences, offset).  The executors give each
piece its rank among pieces of its length and look its place up.  Ranks are
counted in buckets of about the square root of all pieces, so a length that a
third of the pieces have isn't one task's work.

Defined cases: a null text is empty (only the separator); repeated rows are
packed each; a null ``doc_id`` is kept; an empty table gives no rows; columns
other than the id and the text are ignored.
"""

from __future__ import annotations

import bisect
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from . import common
from .tokens import encoder, with_end


class _Plan:
    def __init__(self, capacity: int):
        self.capacity, self.bins = capacity, 0
        self.rows: list[tuple[int, int, int, int, int]] = []  # length, first rank, first sequence, pieces in each, offset
        self.used: dict[int, int] = {}
        self.gaps: dict[int, list[tuple[int, int]]] = {}  # gap -> (first sequence, how many)
        self.order: list[int] = []

    def place(self, length: int, sequence: int, sequences: int, each: int, offset: int) -> None:
        rank = self.used.get(length, 0)
        self.rows.append((length, rank, sequence, each, offset))
        self.used[length] = rank + sequences * each

    def open(self, sequences: int) -> int:
        self.bins += sequences
        return self.bins - sequences

    def leave(self, gap: int, sequence: int, sequences: int) -> None:
        if gap and sequences:
            if gap not in self.gaps:
                self.gaps[gap] = []
                bisect.insort(self.order, gap)
            self.gaps[gap].append((sequence, sequences))

    def take(self, length: int) -> tuple[int, int, int] | None:
        """The smallest gap that holds the length, with sequences that have it."""
        k = bisect.bisect_left(self.order, length)
        if k == len(self.order):
            return None
        gap = self.order[k]
        sequence, sequences = self.gaps[gap].pop()
        if not self.gaps[gap]:
            del self.gaps[gap], self.order[k]
        return gap, sequence, sequences


def plan_packing(counts: dict[int, int], capacity: int) -> tuple[np.ndarray, int]:
    """Where the pieces of each length go.

    Returns rows (length, first rank, first sequence, pieces in each sequence,
    offset of the first), sorted, and the number of sequences.
    """
    plan, left = _Plan(capacity), {s: n for s, n in counts.items() if n > 0}
    large = sorted(s for s in left if 3 * s > capacity)
    while large:
        a = large[-1]
        k = bisect.bisect_right(large, capacity - a) - 1
        if k >= 0 and large[k] == a and left[a] == 1:
            k -= 1
        if k < 0:
            n, b = left[a], 0
        else:
            b = large[k]
            n = left[a] // 2 if a == b else min(left[a], left[b])
        first = plan.open(n)
        plan.place(a, first, n, 1, 0)
        if b:
            plan.place(b, first, n, 1, a)
        plan.leave(capacity - a - b, first, n)
        for s, gone in ((a, n + n if a == b else n), (b, 0 if a == b else n)):
            if s and gone:
                left[s] -= gone
                if not left[s]:
                    large.remove(s)
    for s in sorted((s for s in left if 3 * s <= capacity), reverse=True):
        n = left[s]
        while n:
            gap, first, sequences = plan.take(s) or (capacity, -1, 0)
            each = gap // s
            if first < 0:
                sequences = -(-n // each)
                first = plan.open(sequences)
            full = min(sequences, n // each)
            if full:
                plan.place(s, first, full, each, capacity - gap)
                plan.leave(gap - each * s, first, full)
                n -= full * each
            rest = sequences - full
            if rest and n:
                plan.place(s, first + full, 1, n, capacity - gap)
                plan.leave(gap - n * s, first + full, 1)
                full, rest, n = full + 1, rest - 1, 0
            plan.leave(gap, first + full, rest)
    rows = np.array(sorted(plan.rows), np.int64).reshape(-1, 5)
    return rows, plan.bins


def token_pieces(docs: DataFrame, tokenizer: str, *, capacity: int = 2048, separator: int = 0, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Each document's ids and the separator, cut into pieces of ``capacity`` ids, of which the first may be shorter."""
    fields = [T.StructField("doc_id", docs.schema[id_col].dataType), T.StructField("piece", T.IntegerType())]
    fields += [T.StructField(c, T.LongType()) for c in ("start", "length", "ids_crc32")]

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        code = encoder(tokenizer)
        for batch in common.slices(batches):
            at = 0
            for ids, sizes in code.chunks(batch.column(1)):
                ids, sizes = with_end(ids, sizes, separator)
                n = -(-sizes // capacity)
                row = np.repeat(np.arange(len(sizes)), n)
                piece = np.arange(len(row)) - np.repeat(np.cumsum(n) - n, n)
                first = (sizes - 1) % capacity + 1
                end = first[row] + capacity * piece
                start = np.maximum(end - capacity, 0)
                before = (np.cumsum(sizes) - sizes)[row]
                raw = memoryview(ids.astype("<u4")).cast("B")
                crc = [zlib.crc32(raw[4 * a : 4 * b]) for a, b in zip((before + start).tolist(), (before + end).tolist(), strict=True)]
                arrays = [batch.column(0).take(pa.array(at + row)), pa.array(piece.astype(np.int32)), *(pa.array(x, pa.int64()) for x in (start, end - start, crc))]
                yield pa.RecordBatch.from_arrays(arrays, names=["doc_id", "piece", "start", "length", "ids_crc32"])
                at += len(sizes)

    return docs.select(id_col, text_col).mapInArrow(cut, T.StructType(fields))


def best_fit_pack(pieces: DataFrame, capacity: int = 2048, length_col: str = "length") -> DataFrame:
    """Adds ``sequence_id`` and ``offset`` to pieces, whose lengths are from 1 to the capacity."""
    kept = pieces.columns
    pieces = common.checkpoint(pieces.withColumn("_salt", F.xxhash64(F.monotonically_increasing_id())))
    counts = {r[0]: r[1] for r in pieces.groupBy(length_col).count().collect()}  # a row for each length: at most capacity
    plan, _ = plan_packing(counts, capacity)
    buckets = 16
    while buckets * buckets < sum(counts.values()):
        buckets *= 2
    pieces = pieces.withColumn("_bucket", F.pmod("_salt", F.lit(buckets)))
    before = pieces.groupBy(length_col, "_bucket").agg(F.count("*").alias("_n"))
    running = Window.partitionBy(length_col).orderBy("_bucket").rowsBetween(Window.unboundedPreceding, -1)
    before = before.select(length_col, "_bucket", F.coalesce(F.sum("_n").over(running), F.lit(0)).alias("_before"))
    ranked = pieces.withColumn("_row", F.row_number().over(Window.partitionBy(length_col, "_bucket").orderBy("_salt")))
    ranked = ranked.join(before, [length_col, "_bucket"]).select(*kept, (F.col("_before") + F.col("_row") - 1).alias("_rank"))
    schema = T.StructType([*pieces.select(*kept).schema.fields, T.StructField("sequence_id", T.LongType()), T.StructField("offset", T.LongType())])
    at = kept.index(length_col)

    def assign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        keys = (plan[:, 0] << 44) + plan[:, 1]
        for batch in batches:
            if not batch.num_rows:
                continue
            length, rank = batch.column(at).to_numpy().astype(np.int64), batch.column(len(kept)).to_numpy().astype(np.int64)
            row = plan[np.searchsorted(keys, (length << 44) + rank, "right") - 1]
            bins, place = np.divmod(rank - row[:, 1], row[:, 3])
            yield pa.RecordBatch.from_arrays([*batch.columns[: len(kept)], pa.array(row[:, 2] + bins), pa.array(row[:, 4] + place * length)], names=schema.names)

    return ranked.mapInArrow(assign, schema)


def pack_documents(docs: DataFrame, tokenizer: str, *, capacity: int = 2048, separator: int = 0, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Pieces of the documents with their places: doc_id, piece, start, length, ids_crc32, sequence_id, offset."""
    return best_fit_pack(token_pieces(docs, tokenizer, capacity=capacity, separator=separator, id_col=id_col, text_col=text_col), capacity)
