"""Operator 4: exact top-k search by tiled matrix products.

Vectors are cut into tiles and the query rows into blocks; each block meets
each tile once.  A matrix product scores them, a partial selection keeps k of
each query's row, a task merges what it has selected for a block of queries,
and a window over each query's partial lists merges those.  Only the stated
queries are scored, block by block; a tile never meets another tile.

Components are floored after scaling, so scores are whole numbers and exact:
single or double precision is used where every partial sum is exact in it, and
Python integers beyond (clipped to 64 bits at the end).

Defined cases: vectors that are null or hold a null or a non-finite component,
and rows with a null id, take no part; vectors of unequal length are padded
with zeros; ties go to the smaller id; rows with the query's id are its own and
not candidates; a repeated query counts once, a repeated candidate as often as
it is there; an empty table gives no rows.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from . import common

#: Rows of a tile and of a block; query rows scored at once; blocks whose lists a task holds before it sends them on.
TILE_ROWS, BLOCK_ROWS, STEP_ROWS, HELD_BLOCKS = 8192, 4096, 128, 64
#: Tiles are dealt to a group for each tile of rows, at least and at most so many, each of which gets every block once.
GROUPS = (64, 1024)


def _pack(size: int, scale: float):
    """Rows (id, vector) to rows (at, ids, values, dim) of up to ``size`` vectors, sorted by id."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, seq, ids, rows = TaskContext.get().partitionId(), 0, [], []

        def out() -> pa.RecordBatch:
            nonlocal seq
            dim = max(map(len, rows))
            values = np.zeros((len(rows), dim))
            for k, r in enumerate(rows):
                values[k, : len(r)] = np.floor(r * scale)
            order = np.argsort(np.array(ids, np.int64), kind="stable")
            seq += 1
            batch = {"at": [(part << 24) + seq], "ids": [np.array(ids, np.int64)[order].tobytes()], "data": [values[order].tobytes()], "dim": [dim]}
            return pa.RecordBatch.from_pydict(batch, schema=pa.schema([("at", pa.int64()), ("ids", pa.binary()), ("data", pa.binary()), ("dim", pa.int32())]))

        for batch in batches:
            lists = batch.column(1).cast(pa.list_(pa.float64()))
            flat, offsets = lists.values.to_numpy(zero_copy_only=False), lists.offsets.to_numpy()
            for k, i in enumerate(batch.column(0).to_pylist()):
                ids.append(i)
                rows.append(flat[offsets[k] : offsets[k + 1]])
                if len(rows) == size:
                    yield out()
                    ids, rows = [], []
        if rows:
            yield out()

    return run


def _scores(q: np.ndarray, x: np.ndarray) -> np.ndarray:
    """Exact inner products; int64, or Python integers where a sum may pass 2 ** 50."""
    bound = (np.abs(q).max(initial=0) * np.abs(x).max(initial=0)) * q.shape[1]
    if bound < 1 << 24:
        return (q.astype(np.float32) @ x.astype(np.float32).T).astype(np.int64)
    if bound < 1 << 50:
        return (q @ x.T).astype(np.int64)
    return np.vectorize(int, otypes=[object])(q) @ np.vectorize(int, otypes=[object])(x).T


def _select(q_ids: np.ndarray, q: np.ndarray, ids: np.ndarray, x: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Per query, the k best of a tile: (query row, id, score).  Tile rows are sorted by id."""
    dim = max(q.shape[1], x.shape[1])
    q, x = (np.pad(m, ((0, 0), (0, dim - m.shape[1]))) if m.shape[1] < dim else m for m in (q, x))
    rows, cols, found = [], [], []
    place = np.arange(len(ids) - 1, -1, -1)
    for at in range(0, len(q), STEP_ROWS):
        s = _scores(q[at : at + STEP_ROWS], x)
        key = s * len(ids) + place  # a smaller id is a greater key at the same score
        own = q_ids[at : at + STEP_ROWS, None] == ids[None, :]
        most = min(k + int(own.sum(1).max(initial=0)), len(ids))
        best = np.argpartition(key, len(ids) - most, axis=1)[:, len(ids) - most :]
        row = np.repeat(np.arange(len(s)), most)
        col = best.ravel()
        keep = ~own[row, col]
        row, col = row[keep], col[keep]
        order = np.lexsort((-key[row, col], row)) if key.dtype != object else np.array(sorted(range(len(row)), key=lambda i: (row[i], -key[row[i], col[i]])), np.int64)
        row, col = row[order], col[order]
        nth = np.arange(len(row)) - np.searchsorted(row, row)
        row, col = row[nth < k], col[nth < k]
        rows.append(row + at)
        cols.append(col)
        value = s[row, col]
        found.append(value if value.dtype != object else np.array([max(-(1 << 63), min((1 << 63) - 1, int(v))) for v in value], np.int64))
    return np.concatenate(rows), ids[np.concatenate(cols)], np.concatenate(found)


def _best(row: np.ndarray, ids: np.ndarray, score: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    order = np.lexsort((ids, -score, row))
    row, ids, score = row[order], ids[order], score[order]
    keep = np.arange(len(row)) - np.searchsorted(row, row) < k
    return row[keep], ids[keep], score[keep]


def exact_top_k(vectors: DataFrame, queries: Column, *, k: int = 20, scale: float = 1.0, id_col: str = "vec_id", vector_col: str = "embedding") -> DataFrame:
    """The k highest integer inner products of each query row with all other rows: query_id, rank, vec_id, score."""
    vector = F.col(vector_col).cast("array<double>")
    odd = F.exists(vector, lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))
    usable = vectors.where(F.col(id_col).isNotNull() & F.col(vector_col).isNotNull() & ~odd)
    shape = "at long, ids binary, data binary, dim int"
    rows = usable.select(F.col(id_col).cast("long").alias("id"), vector.alias("v"))
    asked = usable.where(queries).select(F.col(id_col).cast("long").alias("id"), vector.alias("v")).distinct()
    groups = max(GROUPS[0], min(GROUPS[1], -(-vectors.count() // TILE_ROWS)))  # a count of rows reads no vector
    tiles = rows.mapInArrow(_pack(TILE_ROWS, scale), shape).withColumn("group", F.pmod(F.xxhash64("at"), F.lit(groups)))
    blocks = asked.mapInArrow(_pack(BLOCK_ROWS, scale), shape).withColumn("group", F.explode(F.sequence(F.lit(0), F.lit(groups - 1)))).withColumn("group", F.col("group").cast("long"))
    met = tiles.alias("t").join(blocks.alias("b"), "group").select(*(F.col(f"{s}.{c}").alias(f"{s}_{c}") for s in "bt" for c in ("at", "ids", "data", "dim")))

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[int, tuple] = {}

        def out(lists: tuple) -> pa.RecordBatch:
            q_ids, marks, row, ids, found = lists
            return pa.RecordBatch.from_arrays([pa.array(q_ids[row]), pa.array(marks[row]), pa.array(ids), pa.array(found)], names=["query_id", "mark", "vec_id", "score"])

        for batch in batches:
            for r in range(batch.num_rows):
                block, b_ids, b_data, b_dim, _, t_ids, t_data, t_dim = (batch.column(c)[r].as_py() for c in range(8))
                q_ids, ids = np.frombuffer(b_ids, np.int64), np.frombuffer(t_ids, np.int64)
                q, x = np.frombuffer(b_data).reshape(len(q_ids), b_dim), np.frombuffer(t_data).reshape(len(ids), t_dim)
                row, got, found = _select(q_ids, q, ids, x, k)
                if block in held:
                    _, _, *old = held.pop(block)
                    row, got, found = _best(*(np.concatenate(p) for p in zip(old, (row, got, found), strict=True)), k)
                marks = (block << 16) + np.arange(len(q_ids))
                held[block] = (q_ids, marks, row, got, found)
                if len(held) > HELD_BLOCKS:
                    yield out(held.pop(next(iter(held))))
        for lists in held.values():
            yield out(lists)

    partial = met.mapInArrow(score, "query_id long, mark long, vec_id long, score long")
    rank = F.row_number().over(Window.partitionBy("query_id", "mark").orderBy(F.desc("score"), "vec_id"))
    return partial.withColumn("rank", rank).where(F.col("rank") <= k).select("query_id", F.col("rank").cast("int"), "vec_id", "score")
