"""Exact nearest vectors by cosine with an index that leaves tiles out.

``build`` deals vectors to pivots (centres of a bounded sample) and, in the
order of their angle to the pivot, to tiles; a tile knows its pivot and its
least and greatest angle.  By the triangle inequality on the sphere, a query at
angle t to the pivot is at least max(t - greatest, least - t) away from every
vector of the tile.  ``search`` first scores the tiles with the best bounds of
each query, whose k-th score is a threshold, and then only the tiles that may
hold a better one.  The result is that of a full scan; how much is left out
depends on how the vectors cluster.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.vectors import is_finite
from ..sources.tables import checkpointed
from .vector_search import k_best

#: Vectors of a tile, queries of a block, tiles of which the bounds are held at once, and tiles that a query scores first.
TILE_ROWS, BLOCK_ROWS, META_ROWS, FIRST = 2048, 1024, 4096, 2
#: Pivots, and vectors of the sample they are fitted to, for each of them.
PIVOTS, SAMPLE = 64, 32
#: Room for rounding in a bound; scores are rounded to nine digits.
SLACK = 1e-8


@dataclass(frozen=True)
class VectorIndex:
    """Tiles (tile, pivot, low, high, ids, flat) of unit vectors, and the pivots."""

    tiles: DataFrame
    pivots: np.ndarray
    id_type: str


def _units(vectors: pd.Series) -> np.ndarray:
    m = np.stack(vectors.to_numpy()).astype(float)
    m = m / np.abs(m).max(1, keepdims=True)
    return m / np.linalg.norm(m, axis=1, keepdims=True)


def _usable(df: DataFrame, id_col: str, vector_col: str, dim: int | None = None) -> DataFrame:
    v = F.col(vector_col).cast("array<double>")
    ok = is_finite(v) & F.exists(v, lambda x: x != 0)
    return df.select(F.col(id_col).alias("id"), v.alias("v")).where(ok if dim is None else ok & (F.size(v) == dim))


def _fit(rows: DataFrame, pivots: int, sample: int) -> np.ndarray:
    """Centres of at most pivots x sample vectors, those with the least hashes; a bounded set for the driver."""
    some = rows.orderBy(F.xxhash64("id"), "id").limit(pivots * sample).select("v").toPandas()["v"]
    if not len(some):
        return np.zeros((0, 1))
    m = _units(some)
    centres = m[np.linspace(0, len(m) - 1, min(pivots, len(m))).astype(int)]
    for _ in range(8):
        own = (m @ centres.T).argmax(1)
        sums = np.zeros_like(centres)
        np.add.at(sums, own, m)
        size = np.linalg.norm(sums, axis=1, keepdims=True)
        centres = np.where(size > 0, sums / np.maximum(size, 1e-300), centres)
    return centres


def build(vectors: DataFrame, *, id_col: str = "id", vector_col: str = "vector", dim: int, pivots: int = PIVOTS, sample: int = SAMPLE) -> VectorIndex:
    """The index of all vectors of a length that aren't of norm 0 and hold finite numbers only."""
    rows = _usable(vectors, id_col, vector_col, dim)
    centres, kind = _fit(rows, pivots, sample), rows.schema["id"].dataType.simpleString()

    def assign(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in frames:
            if len(pdf):
                near = _units(pdf["v"]) @ centres.T
                pivot = near.argmax(1)
                yield pdf.assign(pivot=pivot.astype(np.int32), angle=np.arccos(np.clip(near[np.arange(len(pdf)), pivot], -1, 1)))

    def pack(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        part, seq, held = TaskContext.get().partitionId(), 0, []

        def tiles(every: pd.DataFrame, last: bool) -> Iterator[pd.DataFrame]:
            nonlocal seq, held
            held = []
            for pivot, same in every.groupby("pivot"):
                whole = len(same) // TILE_ROWS * TILE_ROWS if not last and pivot == every["pivot"].iloc[-1] else len(same)
                for a in range(0, whole, TILE_ROWS):
                    tile, seq = same.iloc[a : min(a + TILE_ROWS, whole)], seq + 1
                    yield pd.DataFrame({"tile": [(part << 32) + seq], "pivot": [pivot], "low": [tile["angle"].min()], "high": [tile["angle"].max()], "ids": [tile["id"].to_numpy()], "flat": [_units(tile["v"]).ravel()]})
                held = [same.iloc[whole:]] if whole < len(same) else []

        for pdf in frames:
            if len(pdf):
                yield from tiles(pd.concat([*held, pdf]), False)
        if held:
            yield from tiles(held[0], True)

    placed = rows.mapInPandas(assign, f"id {kind}, v array<double>, pivot int, angle double")
    ordered = placed.repartitionByRange("pivot", "angle").sortWithinPartitions("pivot", "angle")
    shape = f"tile long, pivot int, low double, high double, ids array<{kind}>, flat array<double>"
    return VectorIndex(checkpointed(ordered.mapInPandas(pack, shape)), centres, kind)


def _bounds(queries: np.ndarray, pivots: np.ndarray, pivot: np.ndarray, low: np.ndarray, high: np.ndarray) -> np.ndarray:
    """The greatest cosine that a vector of each tile can have with each query."""
    t = np.arccos(np.clip(queries @ pivots.T, -1, 1))[:, pivot]
    return np.cos(np.maximum(0, np.maximum(t - high, low - t)))


def search(index: VectorIndex, queries: DataFrame, *, k: int = 10, id_col: str = "id", vector_col: str = "vector") -> tuple[DataFrame, DataFrame]:
    """(query_id, rank, id, score) for all queries, and the (block, tile) pairs that were scored, with how many queries each."""
    dim, pivots, kind = index.pivots.shape[1], index.pivots, index.id_type
    asked = _usable(queries, id_col, vector_col, dim)
    q_kind = asked.schema["id"].dataType.simpleString()

    def blocks_of(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        part, seq = TaskContext.get().partitionId(), 0
        for pdf in frames:
            for a in range(0, len(pdf), BLOCK_ROWS):
                some, seq = pdf.iloc[a : a + BLOCK_ROWS], seq + 1
                yield pd.DataFrame({"block": [(part << 32) + seq], "q_ids": [some["id"].to_numpy()], "q_flat": [_units(some["v"]).ravel()]})

    blocks = checkpointed(asked.mapInPandas(blocks_of, f"block long, q_ids array<{q_kind}>, q_flat array<double>"))
    about = F.struct("tile", "pivot", "low", "high", F.size("ids").alias("n"))
    slices = index.tiles.agg(F.ceil(F.count("*") / META_ROWS)).first()[0] or 1
    meta = index.tiles.select(F.pmod(F.xxhash64("tile"), F.lit(int(slices))).cast("int").alias("slice"), about.alias("about")).groupBy("slice").agg(F.collect_list("about").alias("abouts"))
    spread = F.explode(F.sequence(F.lit(0), F.lit(int(slices) - 1))).alias("slice")

    def near(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        """The tiles with the best bounds of each query, in a slice of the tiles."""
        for pdf in frames:
            for r in pdf.itertuples():
                q, abouts = np.array(r.q_flat).reshape(-1, dim), pd.DataFrame([x if isinstance(x, dict) else x.asDict() for x in r.abouts])
                bounds = _bounds(q, pivots, *(abouts[c].to_numpy() for c in ("pivot", "low", "high")))
                some = min(FIRST, bounds.shape[1])
                best = np.argpartition(-bounds, some - 1, axis=1)[:, :some]
                rows = np.repeat(np.arange(len(q)), some)
                yield pd.DataFrame({"block": r.block, "row": rows, "tile": abouts["tile"].to_numpy()[best.ravel()], "bound": bounds[rows, best.ravel()]})

    def scored(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        """The k best of a tile for those queries of a block that ask for it."""
        for pdf in frames:
            for r in pdf.itertuples():
                rows = np.array(r.rows)
                q, v, ids = np.array(r.q_flat).reshape(-1, dim)[rows], np.array(r.flat).reshape(-1, dim), np.array(r.ids)
                row, col, score = k_best(q, v, ids, k)
                yield pd.DataFrame({"block": r.block, "row": rows[row], "query_id": np.array(r.q_ids)[rows[row]], "id": ids[col], "score": score})

    def score(pairs: DataFrame) -> DataFrame:
        """Of (block, tile, rows)."""
        met = pairs.join(blocks, "block").join(index.tiles.select("tile", "ids", "flat"), "tile")
        return met.select("block", "rows", "q_ids", "q_flat", "ids", "flat").mapInPandas(scored, f"block long, row long, query_id {q_kind}, id {kind}, score double")

    first = blocks.select("block", "q_flat", spread).join(meta, "slice").mapInPandas(near, "block long, row long, tile long, bound double")
    nth = F.row_number().over(Window.partitionBy("block", "row").orderBy(F.desc("bound"), "tile"))
    first = checkpointed(first.withColumn("nth", nth).where(F.col("nth") <= FIRST).groupBy("block", "tile").agg(F.array_sort(F.collect_list("row")).alias("rows")))
    found = checkpointed(score(first))
    rank = F.row_number().over(Window.partitionBy("block", "row").orderBy(F.desc("score"), "id"))
    least = found.withColumn("rank", rank).where(F.col("rank") == k).select("block", "row", F.col("score").alias("least"))
    thresholds = least.groupBy("block").agg(F.collect_list(F.struct("row", "least")).alias("least"))

    def left(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        """The tiles of a slice that may hold a better one, with the queries that ask for them."""
        for pdf in frames:
            for r in pdf.itertuples():
                q, abouts = np.array(r.q_flat).reshape(-1, dim), pd.DataFrame([x if isinstance(x, dict) else x.asDict() for x in r.abouts])
                least = np.full(len(q), -2.0)
                for x in r.least if r.least is not None else ():
                    least[x["row"]] = x["least"]
                ask = _bounds(q, pivots, *(abouts[c].to_numpy() for c in ("pivot", "low", "high"))) >= least[:, None] - SLACK
                some = np.flatnonzero(ask.any(0))
                if not len(some):
                    continue
                yield pd.DataFrame({"block": r.block, "tile": abouts["tile"].to_numpy()[some], "rows": [np.flatnonzero(ask[:, c]) for c in some]})

    rest = blocks.join(thresholds, "block", "left").select("block", "q_flat", "least", spread).join(meta, "slice").mapInPandas(left, "block long, tile long, rows array<long>")
    rest = rest.join(first.select("block", "tile", F.col("rows").alias("had")), ["block", "tile"], "left")
    rest = checkpointed(rest.select("block", "tile", F.array_except("rows", F.coalesce("had", F.array().cast("array<long>"))).alias("rows")).where(F.size("rows") > 0))
    every = found.unionByName(score(rest)).withColumn("rank", rank).where(F.col("rank") <= k)
    pairs = first.unionByName(rest).select("block", "tile", F.size("rows").alias("queries"))
    return every.select("query_id", F.col("rank").cast("long").alias("rank"), "id", "score"), pairs
