"""Substring search with an index of trigrams.

Rows are dealt to blocks by the hash of their id, each a folder of the table.
The index has, for each block, the different trigrams of its lower-cased texts.
A search asks for the blocks that have all trigrams of what is searched, reads
only those, and tests their rows exactly, so it finds what a scan finds.  A
text of fewer than three characters has no trigram and every block is read.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.predicates import search

#: Rows of a block, of which there are 16 at least.
BLOCK_ROWS = 100_000
#: Columns that the index adds.
BLOCK, _GRAM = "_block", "_gram"
#: Characters whose trigrams are told at once, tables (of 16 MB) that a task holds, and the bits of a trigram's number that no character below 256 has.
CHUNK, TABLES = 1 << 20, 8
HIGH = ~(255 << 42 | 255 << 21 | 255)


def trigrams(text: Column) -> Column:
    """The different trigrams of a lower-cased text; an empty array for a short or null one."""
    letters, n = F.split(F.lower(text), ""), F.length(F.lower(text))
    joined = lambda a, b: F.concat(a, b)
    found = F.when(n >= 3, F.zip_with(F.zip_with(letters, F.slice(letters, F.lit(2), n), joined), F.slice(letters, F.lit(3), n), joined))
    return F.coalesce(F.array_distinct(F.filter(found, lambda x: x.isNotNull())), F.array().cast("array<string>"))


def _pieces(texts: pa.Array) -> Iterator[list[np.ndarray]]:
    """The characters of texts in lists of about CHUNK together; of a longer text in pieces that have all its trigrams."""
    waiting, n = [], 0
    for at in range(0, len(texts), 256):
        for text in texts.slice(at, 256).to_pylist():
            chars = np.frombuffer((text or "").encode("utf-32-le"), "<u4")
            for k in range(0, max(1, len(chars) - 2), CHUNK):
                waiting.append(chars[k : k + CHUNK + 2])
                n += len(waiting[-1])
                if n >= CHUNK:
                    yield waiting
                    waiting, n = [], 0
    if waiting:
        yield waiting


def _codes(texts: pa.Array) -> Iterator[np.ndarray]:
    """The trigrams of texts, 21 bits a character, repeats included."""
    for pieces in _pieces(texts):
        flat, ends = np.concatenate(pieces).astype(np.int64), np.cumsum([len(c) for c in pieces])
        if len(flat) > 2:
            whole = np.ones(len(flat) - 2, bool)
            for back in (1, 2):  # those that go over the end of a piece
                over = ends - back
                whole[over[(over >= 0) & (over < len(whole))]] = False
            yield ((flat[:-2] << 42) | (flat[1:-1] << 21) | flat[2:])[whole]


def _grams(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The different trigrams of a task's rows (block, lower-cased texts), by block and column.

    Those of characters below 256 are marks in a table; the others are gathered by sorting.
    """
    seen: dict[tuple[int, int], tuple[np.ndarray, list[np.ndarray]]] = {}

    def out(of: tuple[int, int]) -> Iterator[pa.RecordBatch]:
        table, others = seen.pop(of)
        low = np.flatnonzero(table)
        codes = np.concatenate([(low >> 16) << 42 | (low >> 8 & 255) << 21 | low & 255, *others])
        for at in range(0, len(codes), 1 << 16):
            part = codes[at : at + (1 << 16)]
            text = np.stack([part >> 42, part >> 21 & 0x1FFFFF, part & 0x1FFFFF], axis=1).astype("<u4").tobytes().decode("utf-32-le")
            grams = [text[k : k + 3] for k in range(0, len(text), 3)]
            yield pa.RecordBatch.from_pydict({BLOCK: pa.array([of[0]] * len(grams), pa.int32()), "_column": pa.array([of[1]] * len(grams), pa.int32()), _GRAM: pa.array(grams, pa.string())})

    for batch in batches:
        blocks = batch.column(0).to_numpy()
        for block in np.unique(blocks).tolist():
            of_block = batch if (blocks == block).all() else batch.filter(pa.array(blocks == block))
            for k in range(1, batch.num_columns):
                if (block, k - 1) not in seen:
                    while len(seen) >= TABLES:
                        yield from out(next(iter(seen)))
                    seen[block, k - 1] = np.zeros(1 << 24, bool), []
                table, others = seen[block, k - 1]
                for codes in _codes(of_block.column(k)):
                    high = codes & HIGH != 0
                    low = codes[~high]
                    table[(low >> 42) << 16 | (low >> 21 & 255) << 8 | low & 255] = True
                    if high.any():
                        others[:] = [np.unique(np.concatenate([*others, np.unique(codes[high])]))]
    for of in list(seen):
        yield from out(of)


def build(rows: DataFrame, path: str, columns: list[str], *, id_col: str = "id", blocks: int | None = None) -> None:
    """Write the table by blocks, by default of about BLOCK_ROWS rows, and its index of the columns; a path that exists is an error."""
    blocks = blocks or max(16, -(-rows.count() // BLOCK_ROWS))
    dealt = rows.withColumn(BLOCK, F.pmod(F.xxhash64(id_col), F.lit(blocks)).cast("int"))
    dealt.repartition(blocks, BLOCK).write.mode("errorifexists").partitionBy(BLOCK).parquet(f"{path}/rows")
    stored = rows.sparkSession.read.parquet(f"{path}/rows")
    grams = stored.select(F.col(BLOCK).cast("int").alias(BLOCK), *(F.lower(F.col(c).cast("string")).alias(f"_c{k}") for k, c in enumerate(columns))).mapInArrow(_grams, f"{BLOCK} int, _column int, {_GRAM} string")
    grams.distinct().repartitionByRange(_GRAM).sortWithinPartitions(_GRAM, "_column").write.mode("errorifexists").parquet(f"{path}/grams")


def blocks_of(spark: SparkSession, path: str, text: str, columns: dict[str, int]) -> list[int] | None:
    """Blocks that may hold the text in one of the columns (name -> place in the index); None for all, as it has no trigram.

    At most the number of blocks comes to the driver.
    """
    wanted = spark.sql("SELECT 1").select(trigrams(F.lit(text))).first()[0]
    if not wanted:
        return None
    grams = spark.read.parquet(f"{path}/grams").where(F.col(_GRAM).isin(wanted) & F.col("_column").isin(list(columns.values())))
    found = grams.groupBy(BLOCK, "_column").agg(F.count("*").alias("n")).where(F.col("n") == len(wanted))
    return sorted(r[0] for r in found.select(BLOCK).distinct().collect())


def find(spark: SparkSession, path: str, text: str, *columns: str, indexed: list[str]) -> DataFrame:
    """Rows that have the text, whatever its case, in one of the columns; ``indexed`` are the columns the index was built on, in order."""
    places = {c: indexed.index(c) for c in columns}
    rows = spark.read.parquet(f"{path}/rows")
    some = blocks_of(spark, path, text, places)
    if some is not None:
        rows = rows.where(F.col(BLOCK).isin(some)) if some else rows.where("false")
    return rows.where(search(text, *columns)).drop(BLOCK)
