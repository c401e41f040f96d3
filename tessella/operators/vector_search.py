"""Exact nearest vectors by cosine, dot product or Euclidean distance."""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.vectors import METRICS


def _scores(metric: str, m: np.ndarray, q: np.ndarray) -> np.ndarray:
    """Scores of the rows of a matrix; sums run in the same order in each row, so equal rows have equal scores."""
    if metric == "euclidean":
        return np.sqrt(np.square(m - q).sum(1))
    dots = (m * q).sum(1)
    if metric == "dot_product":
        return dots
    with np.errstate(divide="ignore", invalid="ignore"):
        return dots / (np.sqrt(np.square(m).sum(1)) * np.sqrt(np.square(q).sum()))


def top_k(vectors: DataFrame, query: Sequence[float], *, k: int = 10, threshold: float | None = None, metric: str = "cosine", where: Column | None = None, id_col: str = "id", vector_col: str = "vector", keep: Sequence[str] = ()) -> DataFrame:
    """The k best rows: id, score and the columns kept.

    A threshold is strict.  Ties go to the smaller id.  A vector of norm 0 has no cosine; neither it nor one that is null, of
    another length or holds a null, NaN or infinity is returned.  Vectors are scored as matrices, a batch of rows at a time,
    of which those that reach the batch's k-th best score go on.
    """
    if not 1 <= k <= 100:
        raise ValueError("1 <= k <= 100")
    more, q = METRICS[metric][1], np.array([float(x) for x in query])
    rows = vectors if where is None else vectors.where(where)
    rows = rows.select(id_col, F.col(vector_col).cast("array<double>").alias("_v"), *keep).where(F.size("_v") == len(q))

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            m = batch.column(1).flatten().to_numpy(zero_copy_only=False).reshape(batch.num_rows, len(q))  # a null is NaN
            with np.errstate(invalid="ignore", over="ignore"):
                s = _scores(metric, m, q)
            ok = np.isfinite(m).all(1) & np.isfinite(s)
            if threshold is not None:
                ok &= s > threshold if more else s < threshold
            at = np.flatnonzero(ok)
            if len(at) > k:
                worth = -s[at] if more else s[at]
                at = at[worth <= np.partition(worth, k - 1)[k - 1]]
            yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(at)), pa.array(s[at]), *(c.take(pa.array(at)) for c in batch.columns[2:])], names=[id_col, "score", *keep])

    shape = T.StructType([rows.schema[id_col], T.StructField("score", T.DoubleType()), *(rows.schema[c] for c in keep)])
    found = rows.mapInArrow(score, shape)
    return found.orderBy(F.col("score").desc() if more else F.col("score").asc(), id_col).limit(k)


#: Rows of a block of queries or a tile of vectors, queries scored at once, and the least and most groups of tiles that get every block once.
BLOCK_ROWS, STEP_ROWS, GROUPS = 4096, 256, (16, 1024)


def _pack(rows: DataFrame, id_col: str, vector_col: str) -> DataFrame:
    """Rows (dim, ids, flat) of up to BLOCK_ROWS vectors of one length, of finite numbers and none of norm 0."""

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in frames:
            for dim, same in pdf.groupby(pdf[vector_col].map(len)):
                flat = np.stack(same[vector_col].to_numpy()).astype(float)
                some = np.isfinite(flat).all(1) & (np.abs(flat).max(1, initial=0) > 0)
                ids, flat = same[id_col].to_numpy()[some], flat[some]
                for a in range(0, len(ids), BLOCK_ROWS):
                    yield pd.DataFrame({"dim": [dim], "ids": [ids[a : a + BLOCK_ROWS]], "flat": [flat[a : a + BLOCK_ROWS].ravel()]})

    kind = rows.schema[id_col].dataType.simpleString()
    return rows.where(F.col(vector_col).isNotNull()).select(id_col, F.col(vector_col).cast("array<double>").alias(vector_col)).mapInPandas(run, f"dim int, ids array<{kind}>, flat array<double>")


def k_best(unit: np.ndarray, v: np.ndarray, ids: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(query row, vector row, score) of the k best vectors for each query, both of norm 1; scores to nine digits, ties to the smaller id."""
    place, found = np.argsort(np.argsort(ids, kind="stable"), kind="stable"), []
    for a in range(0, len(unit), STEP_ROWS):
        scores, kept = np.round(unit[a : a + STEP_ROWS] @ v.T, 9), min(k, len(ids))
        # the k-th best score, then the smaller ids among those that reach it
        least = -np.partition(-scores, kept - 1, axis=1)[:, kept - 1 : kept]
        rank = np.where(scores > least, 0, np.where(scores == least, 1, 2)) * len(ids) + place
        order = np.argpartition(rank, kept - 1, axis=1)[:, :kept]
        found.append((np.repeat(np.arange(a, a + len(scores)), kept), order.ravel(), np.take_along_axis(scores, order, 1).ravel()))
    return tuple(np.concatenate(x) for x in zip(*found, strict=True))


def batch_top_k(vectors: DataFrame, queries: DataFrame, *, k: int = 10, max_queries: int | None = None, id_col: str = "id", vector_col: str = "vector") -> DataFrame:
    """query_id, rank, id, score (cosine) for any number of queries; more than ``max_queries``, if given, are an error.

    Vectors that are null, of norm 0 or hold a null, NaN or infinity take no part, and a query meets vectors of its length only.
    Blocks of queries meet tiles of vectors in the cluster; each tile keeps its k best by query, and a window merges those.
    """
    if max_queries is not None and queries.limit(max_queries + 1).count() > max_queries:
        raise ValueError(f"more than {max_queries} queries: search them in parts")
    groups = max(GROUPS[0], min(GROUPS[1], -(-vectors.count() // BLOCK_ROWS)))  # a count of rows reads no vector
    tiles = _pack(vectors, id_col, vector_col).withColumn("group", F.pmod(F.xxhash64("ids"), F.lit(groups)))
    blocks = _pack(queries, id_col, vector_col).select("dim", F.col("ids").alias("q_ids"), F.col("flat").alias("q_flat"), F.explode(F.sequence(F.lit(0).cast("long"), F.lit(groups - 1).cast("long"))).alias("group"))

    def best(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in frames:
            for q_ids, q_flat, own, flat in pdf.itertuples(index=False):
                unit, v = q_flat.reshape(len(q_ids), -1), flat.reshape(len(own), -1)
                unit, v = (x / np.abs(x).max(1, keepdims=True) for x in (unit, v))  # so that no square is lost or overflows
                unit, v = (x / np.linalg.norm(x, axis=1, keepdims=True) for x in (unit, v))
                row, col, score = k_best(unit, v, own, k)
                yield pd.DataFrame({"query_id": q_ids[row], "id": own[col], "score": score})

    kind = vectors.schema[id_col].dataType.simpleString()
    found = blocks.join(tiles, ["group", "dim"]).select("q_ids", "q_flat", "ids", "flat").mapInPandas(best, f"query_id {kind}, id {kind}, score double")
    rank = F.row_number().over(Window.partitionBy("query_id").orderBy(F.round("score", 9).desc(), "id"))
    return found.withColumn("rank", rank.cast("long")).where(F.col("rank") <= k).select("query_id", "rank", "id", "score")
