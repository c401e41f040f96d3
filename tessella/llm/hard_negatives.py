"""Operator 11: hard negatives by a two-dimensional block matrix product.

Anchors are cut into blocks and all rows into tiles, and both into chunks of
dimensions.  A block meets a tile chunk by chunk (as in SUMMA, each block goes
along the row of tiles and each tile along the column of blocks); the product
of two chunks is a partial tile of scores, and partial tiles of one block and
tile are shuffled together and added as 64-bit integers.  Each added tile keeps
a few rows for each anchor or window, and a window function merges those.

The first product finds the positives: rows are numbered by label, so a block
meets only the tiles that hold a label of its own.  The second meets all tiles,
carries each anchor's windows of scores with its block and keeps the best
different-label rows in every window.  Only the stated anchors are scored.

Components are floored after scaling, so scores are exact.  Partial tiles whose
sums could pass 2 ** 53 are added as Python integers; what passes 64 bits is
clipped, a positive's score before its window is made.  Partial tiles travel in as many bytes a score as their
largest one needs.

Defined cases: rows with a null id, label or vector, or a null or non-finite
component take no part; vectors of unequal length are padded with zeros; ties
go to the smaller id; rows with the anchor's id are its own; a repeated anchor
counts once, another row as often as it is there; an anchor without another
row of its label, or without a row in a window, gives no row; an empty table
gives none.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from . import common
from .topk import _scores

#: Anchors of a block, rows of a tile, dimensions of a chunk.
BLOCK_ROWS, TILE_ROWS, CHUNK_DIMS = 512, 2048, 32
_PART = "at long, chunk int, rows int, dims int, marks binary, ids binary, labels binary, data binary"


def _cut(chunk: int, scale: float):
    """A group's rows (at, idx, id, label, v) to a row for each chunk of dimensions; the first has the ids and labels."""

    def run(table: pa.Table) -> pa.Table:
        order = np.argsort(table["idx"].to_numpy())
        lists = table["v"].combine_chunks()
        flat, offsets = lists.values.to_numpy(zero_copy_only=False), lists.offsets.to_numpy()
        dim = max(int(np.diff(offsets).max(initial=0)), 1)
        values = np.zeros((len(order), -(-dim // chunk) * chunk))
        for k, row in enumerate(order.tolist()):
            own = flat[offsets[row] : offsets[row + 1]]
            values[k, : len(own)] = np.floor(own * scale)
        with np.errstate(over="ignore"):
            values = np.clip(values, -np.finfo(float).max, np.finfo(float).max)
        small = np.abs(values).max(initial=0) < 1 << 15
        parts = [values[:, c : c + chunk].astype("<i2" if small else "<f8").tobytes() for c in range(0, values.shape[1], chunk)]
        names = [table[c].to_numpy()[order].astype("<i8").tobytes() for c in ("idx", "id", "label")]
        n, at = len(parts), table["at"][0].as_py()
        columns = [[at] * n, range(n), [len(order)] * n, [chunk if small else -chunk] * n, *([x] + [None] * (n - 1) for x in names), parts]
        return pa.Table.from_arrays([pa.array(c, k) for c, k in zip(columns, (pa.int64(), pa.int32(), pa.int32(), pa.int32(), *[pa.binary()] * 4), strict=True)], names=["at", "chunk", "rows", "dims", "marks", "ids", "labels", "data"])

    return run


def _matrix(rows: int, dims: int, data: bytes) -> np.ndarray:
    return np.frombuffer(data, "<i2" if dims > 0 else "<f8").reshape(rows, abs(dims)).astype(float)


def to_wire(s: np.ndarray) -> tuple[int, bytes]:
    """Scores by bytes, the lowest of all first, as many as the largest needs; Python integers one after another, with a negative width."""
    if s.dtype == object:
        width = max((int(v).bit_length() for v in s.ravel()), default=0) // 8 + 1
        return -width, b"".join(int(v).to_bytes(width, "little", signed=True) for v in s.ravel())
    z = ((s << 1) ^ (s >> 63)).astype("<u8")
    width = max(1, (int(z.max(initial=0)).bit_length() + 7) // 8)
    return width, z.view(np.uint8).reshape(-1, 8)[:, :width].T.tobytes()


def from_wire(width: int, data: bytes, shape: tuple[int, int]) -> np.ndarray:
    if width < 0:
        return np.array([int.from_bytes(data[a : a - width], "little", signed=True) for a in range(0, len(data), -width)] or [0], object)[: shape[0] * shape[1]].reshape(shape)
    z = np.zeros((shape[0] * shape[1], 8), np.uint8)
    z[:, :width] = np.frombuffer(data, np.uint8).reshape(width, -1).T
    z = z.view("<u8")[:, 0]
    return ((z >> np.uint64(1)).astype(np.int64) ^ -(z & np.uint64(1)).astype(np.int64)).reshape(shape)


def _multiply(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows of a block's chunk with a tile's, to partial tiles."""
    for batch in batches:
        for r in range(batch.num_rows):
            block, tile, chunk, rows, dims, data, t_rows, t_dims, t_data = (batch.column(c)[r].as_py() for c in range(9))
            width, wire = to_wire(_scores(_matrix(rows, dims, data), _matrix(t_rows, t_dims, t_data)))
            columns = [[block], [tile], [chunk], [rows], [t_rows], [width], [wire]]
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, (*[pa.int64()] * 2, *[pa.int32()] * 4, pa.binary()), strict=True)], names=["block", "tile", "chunk", "rows", "t_rows", "width", "wire"])


def best(s: np.ndarray, ok: np.ndarray, ids: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """(row, column) of the k highest scores of each row among those that are ok, ties to the smaller id."""
    rows = np.flatnonzero(ok.any(1))
    if not len(rows):
        return rows, rows
    s, ok, n = s[rows], ok[rows], len(ids)
    place = np.argsort(np.argsort(-ids, kind="stable"), kind="stable")  # the smallest id is the greatest
    if s.dtype == object or np.abs(s).max(initial=0) >= 1 << 50:
        row, col = np.nonzero(ok)
        order = sorted(range(len(row)), key=lambda i: (row[i], -s[row[i], col[i]], ids[col[i]]))
        row, col = row[order], col[order]
    else:
        key = np.where(ok, s * n + place, np.iinfo(np.int64).min)
        most = min(k, n)
        col = np.argpartition(key, n - most, axis=1)[:, n - most :]
        row = np.repeat(np.arange(len(s)), most)
        col = col.ravel()
        keep = ok[row, col]
        row, col = row[keep], col[keep]
        order = np.lexsort((-key[row, col], row))
        row, col = row[order], col[order]
    nth = np.arange(len(row)) - np.searchsorted(row, row)
    return rows[row[nth < k]], col[nth < k]


def _add(select, schema: pa.Schema):
    """Partial tiles, sorted by block, tile and chunk, to what is selected of each added tile."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        current, total, about = None, None, None

        def out() -> pa.RecordBatch:
            found = select(total, *about)
            return pa.RecordBatch.from_arrays([pa.array(np.asarray(c).astype(np.int64)) for c in found], schema=schema)

        for batch in batches:
            for r in range(batch.num_rows):
                block, tile, _, rows, t_rows, width, wire, *names = (batch.column(c)[r].as_py() for c in range(batch.num_columns))
                part = from_wire(width, wire, (rows, t_rows))
                if (block, tile) != current:
                    if current is not None:
                        yield out()
                    current, total = (block, tile), part
                    about = [np.frombuffer(x, "<i8") if x else np.zeros(0, np.int64) for x in names]
                elif total.dtype == part.dtype == np.int64 and max(np.abs(total).max(initial=0), np.abs(part).max(initial=0)) < 1 << 61:
                    total = total + part
                else:
                    total = total.astype(object) + part.astype(object)
        if current is not None:
            yield out()

    return run


def _clipped(values: np.ndarray) -> np.ndarray:
    return values if values.dtype != object else np.array([max(-(1 << 63), min((1 << 63) - 1, int(v))) for v in values], np.int64)


def _positives(k: int):
    def select(s, marks, ids, labels, _windows, t_ids, t_labels):
        row, col = best(s, (labels[:, None] == t_labels) & (ids[:, None] != t_ids), t_ids, k)
        return marks[row], ids[row], t_ids[col], _clipped(s[row, col])

    return select


def _negatives(k: int, low: int, high: int):
    def select(s, marks, ids, labels, windows, t_ids, t_labels):
        # windows: rows (place of the anchor in its block, number, positive's id, its score)
        place, number, positive, score = windows.reshape(-1, 4).T
        out, unlike = [], labels[:, None] != t_labels
        for w in np.unique(number).tolist():
            own = np.flatnonzero(number == w)
            p = score[own].astype(object)
            least, most = (np.array([max(-(1 << 62), min(1 << 62, x)) for x in bound], np.int64) for bound in (-(-low * p // 100), high * p // 100))
            at = s[place[own]]
            row, col = best(at, unlike[place[own]] & (at >= least[:, None]) & (at <= most[:, None]), t_ids, k)
            own = own[row]
            out.append((marks[place[own]], np.full(len(own), w), ids[place[own]], positive[own], score[own], t_ids[col], _clipped(at[row, col])))
        return [np.concatenate(c) for c in zip(*out, strict=True)] if out else [np.zeros(0, np.int64)] * 7

    return select


def _windows(size: int):
    """The positives of a block to one binary."""

    def run(table: pa.Table) -> pa.Table:
        block = table["block"][0].as_py()
        rows = np.stack([table["mark"].to_numpy() - block * size, table["number"].to_numpy(), table["positive_id"].to_numpy(), table["score"].to_numpy()], axis=1)
        return pa.table({"block": pa.array([block], pa.int64()), "windows": pa.array([rows.astype("<i8").tobytes()], pa.binary())})

    return run


def hard_negatives(vectors: DataFrame, label: Column, anchors: Column, *, positives: int = 5, negatives: int = 3, low: int = 50, high: int = 95, scale: float = 1.0, id_col: str = "vec_id", vector_col: str = "embedding") -> DataFrame:
    """anchor_id, positive_id, rank, negative_id, positive_score and negative_score.

    The positives of an anchor are the best other rows of its ``label`` (a whole
    number); its negatives, for each of them, the best rows of another label
    with low * positive_score <= 100 * negative_score <= high * positive_score.
    """
    vector = F.col(f"`{vector_col}`").cast("array<double>")
    odd = F.exists(vector, lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))
    rows = vectors.select(F.lit("").alias("g"), F.col(f"`{id_col}`").cast("long").alias("id"), label.cast("long").alias("label"), vector.alias("v"), F.coalesce(anchors, F.lit(False)).alias("anchor"), F.coalesce(odd, F.lit(False)).alias("odd"))
    rows = rows.where("id IS NOT NULL AND label IS NOT NULL AND v IS NOT NULL AND NOT odd").drop("odd")
    every = common.indexed(rows, "g", ["label", "id"], "vectors").withColumn("at", F.call_function("div", "idx", F.lit(TILE_ROWS).cast("long")))
    asked = rows.where("anchor").select("g", "id", "label", "v").distinct()
    asked = common.indexed(asked, "g", ["label", "id"], "anchors").withColumn("at", F.call_function("div", "idx", F.lit(BLOCK_ROWS).cast("long")))
    cut = _cut(CHUNK_DIMS, scale)
    tiles, blocks = (common.stored(df.select("at", "idx", "id", "label", "v").groupBy("at").applyInArrow(cut, _PART), name) for df, name in ((every, "tiles"), (asked, "blocks")))
    blocks = blocks.withColumnRenamed("at", "block")

    def added(pairs: DataFrame, windows: DataFrame, select, names: list[str]) -> DataFrame:
        """What is selected of the tiles of all pairs (block, tile)."""
        left = pairs.join(blocks, "block").select("block", "tile", "chunk", "rows", "dims", "data")
        right = tiles.select(F.col("at").alias("tile"), "chunk", F.col("rows").alias("t_rows"), F.col("dims").alias("t_dims"), F.col("data").alias("t_data"))
        met = left.join(right, ["tile", "chunk"]).select("block", "tile", "chunk", "rows", "dims", "data", "t_rows", "t_dims", "t_data")
        parts = met.mapInArrow(_multiply, "block long, tile long, chunk int, rows int, t_rows int, width int, wire binary")
        # the names go with the first chunk of each pair
        first = F.lit(0).alias("chunk")
        about = pairs.join(blocks.where("chunk = 0").select("block", "marks", "ids", "labels"), "block").join(windows, "block", "left")
        about = about.join(tiles.where("chunk = 0").select(F.col("at").alias("tile"), F.col("ids").alias("t_ids"), F.col("labels").alias("t_labels")), "tile").select("block", "tile", first, "marks", "ids", "labels", "windows", "t_ids", "t_labels")
        full = parts.join(about, ["block", "tile", "chunk"], "left").repartition("block", "tile").sortWithinPartitions("block", "tile", "chunk")
        full = full.select("block", "tile", "chunk", "rows", "t_rows", "width", "wire", "marks", "ids", "labels", "windows", "t_ids", "t_labels")
        schema = pa.schema([(c, pa.int64()) for c in names])
        return full.mapInArrow(_add(select, schema), ", ".join(f"{c} long" for c in names))

    ranges = every.groupBy("label").agg(F.min("at").alias("least"), F.max("at").alias("most"))
    same = asked.select("label", F.col("at").alias("block")).distinct().join(ranges, "label")
    same = same.select("block", F.explode(F.sequence("least", "most")).alias("tile")).distinct()
    none = blocks.sparkSession.createDataFrame([], T.StructType([T.StructField("block", T.LongType()), T.StructField("windows", T.BinaryType())]))
    found = added(same, none, _positives(positives), ["mark", "anchor_id", "positive_id", "score"])
    number = F.row_number().over(Window.partitionBy("mark").orderBy(F.desc("score"), "positive_id")).cast("long")
    chosen = common.stored(found.withColumn("number", number).where(F.col("number") <= positives), "positives")
    grouped = chosen.withColumn("block", F.call_function("div", "mark", F.lit(BLOCK_ROWS).cast("long"))).select("block", "mark", "number", "positive_id", "score")
    windows = common.stored(grouped.groupBy("block").applyInArrow(_windows(BLOCK_ROWS), "block long, windows binary"), "windows")
    last = every.agg(F.max("at")).first()[0] or 0
    pairs = windows.select("block", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(last).cast("long"))).alias("tile"))
    names = ["mark", "number", "anchor_id", "positive_id", "positive_score", "negative_id", "negative_score"]
    kept = added(pairs, windows, _negatives(negatives, low, high), names)
    rank = F.row_number().over(Window.partitionBy("mark", "number").orderBy(F.desc("negative_score"), "negative_id"))
    return kept.withColumn("rank", rank.cast("int")).where(F.col("rank") <= negatives).select("anchor_id", "positive_id", "rank", "negative_id", "positive_score", "negative_score")
