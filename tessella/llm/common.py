"""Helpers shared by the operators of this subpackage.

Text helpers work on whole Arrow string columns with numpy: no Python object
is made for a word.  A word is a maximal run of bytes other than ASCII white
space (``\\x20``, ``\\x09``-``\\x0D``); a null text is an empty text.
"""

from __future__ import annotations

import ctypes
import tempfile
import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

#: A chunk of documents handled at once; one longer document is a chunk alone.
CHUNK_BYTES = 1 << 19

_SPACE = np.zeros(256, bool)
_SPACE[[0x20, *range(0x09, 0x0E)]] = True
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
#: Bytes from which texts are known that give a polynomial modulo 2 ** 64 the same value, whatever its base, are far longer.
LONG_SPAN = 256
_P = 0x9E3779B97F4A7C15 | 1
_PINV = pow(_P, -1, 1 << 64)
_POWERS: dict[int, np.ndarray] = {}


# --- session -----------------------------------------------------------------


def shared_dir(spark: SparkSession) -> str:
    """The folder all executors share: ``spark.checkpoint.dir`` or the context's checkpoint folder.

    A local master may go without and gets a temporary folder; on a cluster that is an error.
    """
    base = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not base:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        base = "file://" + tempfile.mkdtemp(prefix="tessella-")
    if spark.sparkContext.getCheckpointDir() is None:
        spark.sparkContext.setCheckpointDir(base)
    return base


def scratch(spark: SparkSession, name: str) -> str:
    """A new path in the shared folder."""
    return f"{shared_dir(spark).rstrip('/')}/{name}-{uuid.uuid4().hex}"


def checkpoint(df: DataFrame) -> DataFrame:
    """Cut lineage with a reliable checkpoint in the shared folder."""
    shared_dir(df.sparkSession)
    return df.checkpoint(eager=True)


def stored(df: DataFrame, name: str) -> DataFrame:
    """Cut lineage with a Parquet table in the shared folder, for wide rows of which later steps read few columns."""
    path = scratch(df.sparkSession, name)
    df.write.option("compression", "zstd").parquet(path)
    out = df.sparkSession.read.parquet(path)
    out.stored_at = path
    return out


def remove(*tables: DataFrame) -> None:
    """Delete what ``stored`` wrote, once no later step reads it."""
    for df in tables:
        at = df.sparkSession._jvm.org.apache.hadoop.fs.Path(df.stored_at)
        at.getFileSystem(df.sparkSession._jsc.hadoopConfiguration()).delete(at, True)


def indexed(df: DataFrame, group: str, order: list[str], name: str) -> DataFrame:
    """The rows of each group (not null) numbered from 0 in an order: adds part, idx and n (rows of the group).

    Rows are dealt by ranges of (group, order), so a large group spans many
    partitions; a row's number is its place in its partition (part) after the
    rows that the partitions before hold of its group.  The sorted rows are a
    table in the shared folder, so numbers don't change if a task runs again.
    """
    tie = unused("_tie", df.columns)
    dealt = df.withColumn(tie, F.monotonically_increasing_id())
    dealt = dealt.repartitionByRange(group, *order, tie).sortWithinPartitions(group, *order, tie).drop(tie).withColumn("idx", F.monotonically_increasing_id())
    rows = stored(dealt, name).withColumn("part", F.shiftright("idx", 33))
    runs = rows.groupBy("part", group).agg(F.min("idx").alias("first"), F.count("*").alias("run"))
    before = Window.partitionBy(group).orderBy("part")
    runs = runs.withColumns({"n": F.sum("run").over(Window.partitionBy(group)), "shift": F.sum("run").over(before) - F.col("run") - F.col("first")})
    runs = runs.select("part", group, "n", "shift")
    return rows.join(runs, ["part", group]).withColumn("idx", F.col("idx") + F.col("shift")).drop("shift")


def give_back() -> None:
    """Return free memory of Arrow's pool and, where the C library can, of the process to the system."""
    pa.default_memory_pool().release_unused()
    trim = getattr(ctypes.CDLL(None), "malloc_trim", None)
    if trim is not None:
        trim(0)


def slices(batches: Iterator[pa.RecordBatch], rows: int = 500) -> Iterator[pa.RecordBatch]:
    """Batches of whole texts in parts of at most ``rows`` rows, so that what is made of them fits a Python worker; none is empty.

    At the end the worker, which Spark keeps for later tasks, gives back the memory that it no longer uses.
    """
    for batch in batches:
        for at in range(0, batch.num_rows, rows):
            yield batch.slice(at, rows)
    give_back()


def packed(df: DataFrame, columns: list[str] | None = None) -> F.Column:
    """All columns of a row in one, so that columns that an operator adds clash with none of them."""
    return F.struct(*(F.col(f"`{c}`") for c in columns or df.columns))


def unused(name: str, columns: list[str]) -> str:
    """The name, with more underscores before it where a column has it."""
    while name.lower() in {c.lower() for c in columns}:
        name = "_" + name
    return name


def crc_of_id(column: str) -> F.Column:
    """crc32 of an id as text; a null id counts as an empty text."""
    return F.crc32(F.coalesce(F.col(column).cast("string"), F.lit("")).cast("binary"))


# --- texts as bytes ----------------------------------------------------------


def utf8(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Bytes and offsets (n + 1) of a string column; nulls are empty."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    column = pc.fill_null(column, "").cast(pa.large_string())
    offsets = np.frombuffer(column.buffers()[1], np.int64)[column.offset : column.offset + len(column) + 1]
    data = column.buffers()[2]
    if data is None or not len(offsets):
        return np.zeros(0, np.uint8), np.zeros(len(column) + 1, np.int64)
    return np.frombuffer(data, np.uint8)[offsets[0] : offsets[-1]], offsets - offsets[0]


def chunks(offsets: np.ndarray, limit: int = CHUNK_BYTES) -> Iterator[tuple[int, int]]:
    """Ranges of documents with at most ``limit`` bytes, or of one document."""
    at, n = 0, len(offsets) - 1
    while at < n:
        to = max(at + 1, int(np.searchsorted(offsets, offsets[at] + limit, "right")) - 1)
        yield at, min(to, n)
        at = min(to, n)


def text_chunks(column: pa.Array, limit: int = CHUNK_BYTES) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """(first document, end, bytes, offsets) of each chunk of a string column."""
    data, offsets = utf8(column)
    for a, b in chunks(offsets, limit):
        yield a, b, data[offsets[a] : offsets[b]], offsets[a : b + 1] - offsets[a]


def lower(data: np.ndarray) -> np.ndarray:
    """A-Z to a-z, other bytes as they are."""
    return _LOWER[data]


def is_space(data: np.ndarray) -> np.ndarray:
    return _SPACE[data]


def word_spans(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Starts and ends of the words, and the number of words of each document."""
    inside = ~_SPACE[data]
    first, last = inside.copy(), inside.copy()
    first[1:] &= ~inside[:-1]
    last[:-1] &= ~inside[1:]
    edges = offsets[1:-1]
    edges = edges[(edges > 0) & (edges < len(data))]
    first[edges] = inside[edges]
    last[edges - 1] = inside[edges - 1]
    starts, ends = np.flatnonzero(first), np.flatnonzero(last) + 1
    return starts, ends, np.diff(np.searchsorted(starts, offsets))


def mix(h: np.ndarray) -> np.ndarray:
    """A bijective scrambling of 64-bit values."""
    with np.errstate(over="ignore"):
        h = (h ^ (h >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
        h = (h ^ (h >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
        return h ^ (h >> np.uint64(31))


def _powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """Powers of the base for n bytes, and of its inverse; made on first use, also for no bytes at all."""
    if len(_POWERS.get(0, ())) < max(n, 1):
        size = max(n, CHUNK_BYTES + 1)
        for k, p in ((0, _P), (1, _PINV)):
            run = np.full(size, p, np.uint64)
            run[:1] = 1
            _POWERS[k] = np.cumprod(run)
    return _POWERS[0][:n], _POWERS[1]


def span_hashes(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """64-bit hashes of byte spans: a polynomial in an odd base, scrambled with the length; XXH64 for spans of LONG_SPAN bytes or more."""
    power, inverse = _powers(len(data))
    with np.errstate(over="ignore"):
        sums = np.zeros(len(data) + 1, np.uint64)
        np.cumsum((data.astype(np.uint64) + np.uint64(1)) * power, out=sums[1:])
        h = (sums[ends] - sums[starts]) * inverse[np.minimum(starts, max(len(data) - 1, 0))]
        h = mix(h + (ends - starts).astype(np.uint64) * np.uint64(0xD6E8FEB86659FD93))
    for k in np.flatnonzero(ends - starts >= LONG_SPAN).tolist():
        h[k] = xxhash.xxh64_intdigest(data[starts[k] : ends[k]].tobytes(), LONG_SPAN)
    return h


def sums_by(values: np.ndarray, counts: np.ndarray) -> np.ndarray:
    """Sums of consecutive runs of values of the given lengths."""
    ends = np.cumsum(counts)
    total = np.concatenate([[0], np.cumsum(values, dtype=np.float64 if values.dtype.kind == "f" else np.int64)])
    return total[ends] - total[ends - counts]
