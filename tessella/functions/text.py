"""Chunks of texts."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def chunk_fixed(docs: DataFrame, *, size: int = 1000, overlap: int = 200, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, chunk_index, content): windows of ``size`` characters, each ``overlap`` back into the one before; none for an empty or null text."""
    if not 0 <= overlap < size:
        raise ValueError("0 <= overlap < size")
    step, n = size - overlap, F.length(text_col)
    last = F.when(n <= size, F.lit(0)).otherwise(F.ceil((n - size) / step).cast("int"))
    # cut once to pieces of a step, of which a chunk takes a few: linear in the text
    pieces = F.regexp_extract_all(F.col(text_col), F.lit(f"(?s).{{1,{step}}}"), F.lit(0))
    rows = docs.where(n > 0).select(F.col(id_col), pieces.alias("_pieces"), last.alias("_last"))
    content = F.substr(F.array_join(F.slice("_pieces", F.col("_k") + 1, -(-size // step)), ""), F.lit(1), F.lit(size))
    chunks = F.transform(F.sequence(F.lit(0), F.col("_last")), lambda k: k)
    return rows.select(id_col, "_pieces", F.explode(chunks).alias("_k")).select(id_col, F.col("_k").alias("chunk_index"), content.alias("content"))


def chunk_separated(docs: DataFrame, *, separator: str = ". ", id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, chunk_index, content): the parts between a literal separator that hold more than spaces."""
    quoted = rf"\Q{separator}\E"
    parts = docs.select(F.col(id_col), F.posexplode(F.filter(F.split(F.col(text_col), quoted, -1), lambda x: F.trim(x) != "")).alias("chunk_index", "content"))
    return parts.select(id_col, "chunk_index", "content")


def chunk_semantic(docs: DataFrame, *, window: int = 3, least: float = 0.05, separator: str = ". ", id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, chunk_index, content): runs of parts between a separator that stay with their subject.

    A chunk ends where the different words of the ``window`` parts before and
    after a place, whatever their case, have fewer than the share ``least`` in
    common (lexical cohesion); parts that hold nothing but spaces are dropped.
    """
    parts = F.filter(F.split(F.col(text_col), rf"\Q{separator}\E", -1), lambda x: F.trim(x) != "")
    rows = docs.select(F.col(id_col), parts.alias("_parts")).where(F.size("_parts") > 0)
    words = F.transform("_parts", lambda s: F.array_distinct(F.filter(F.split(F.lower(s), " "), lambda x: x != "")))
    rows = rows.withColumn("_words", words)

    def apart(i: Column) -> Column:
        before = F.flatten(F.slice("_words", F.greatest(i - window, F.lit(0)) + 1, F.least(i, F.lit(window))))
        after = F.flatten(F.slice("_words", i + 1, F.lit(window)))
        return F.size(F.array_intersect(before, after)) < least * F.size(F.array_union(before, after))

    starts = F.filter(F.sequence(F.lit(0), F.size("_parts") - 1), lambda i: (i == 0) | apart(i))
    rows = rows.withColumn("_starts", starts)
    ends = F.concat(F.slice("_starts", F.lit(2), F.size("_starts")), F.array(F.size("_parts")))
    spans = rows.select(id_col, "_parts", F.posexplode(F.arrays_zip(F.col("_starts").alias("a"), ends.alias("b"))).alias("chunk_index", "_x"))
    return spans.select(id_col, "chunk_index", F.array_join(F.slice("_parts", F.col("_x.a") + 1, F.col("_x.b") - F.col("_x.a")), separator).alias("content"))
