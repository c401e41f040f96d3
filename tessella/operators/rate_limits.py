"""Sliding-window counts per key over a table of requests.

Time is cut into ``PARTS`` buckets a window.  A request's window covers the
rest of its own bucket, the end of the bucket one window back, and whole
buckets between; so each bucket of a key is a partition of its own that gets,
besides its requests, those of the bucket one window back (as its halo) and one
row with the sum of the buckets between.  A key of any size runs in as many
tasks as it has buckets, and a running sum over each gives the counts.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..sources.tables import micros

#: Buckets of a window at most; their width divides the window.
PARTS = 64


def _in_window(rows: DataFrame, keys: list[str], at: str, width: int, name: str, parts: int = PARTS) -> DataFrame:
    """Adds how many rows of the key have ``at`` in (at - width, at], those of the same instant included."""
    parts = next(m for m in range(min(parts, width), 0, -1) if width % m == 0)
    bucket = F.call_function("div", F.col(at) - F.pmod(F.col(at), F.lit(width // parts)), F.lit(width // parts).cast("long"))
    own = rows.select(F.struct(*(F.col(f"`{c}`") for c in rows.columns)).alias("_row"), *keys, bucket.alias("_bucket"), F.col(at).alias("_pos"), F.lit(1).cast("long").alias("_n"))
    halo = own.where("_pos IS NOT NULL").select(F.lit(None).cast(own.schema["_row"].dataType).alias("_row"), *keys, (F.col("_bucket") + parts).alias("_bucket"), (F.col("_pos") + width).alias("_pos"), F.lit(-1).cast("long").alias("_n"))
    before = F.sum("_total").over(Window.partitionBy(*keys).orderBy("_bucket").rangeBetween(-parts, -1))
    totals = own.where("_pos IS NOT NULL").groupBy(*keys, "_bucket").agg(F.count("*").alias("_total")).withColumn("_n", before).where("_n > 0")
    base = totals.select(F.lit(None).cast(own.schema["_row"].dataType).alias("_row"), *keys, "_bucket", F.lit(None).cast("long").alias("_pos"), "_n")
    running = Window.partitionBy(*keys, "_bucket").orderBy(F.col("_pos").asc_nulls_first()).rangeBetween(Window.unboundedPreceding, Window.currentRow)
    counted = own.unionByName(halo).unionByName(base).withColumn("_count", F.sum("_n").over(running)).where("_row IS NOT NULL")
    return counted.select("_row.*", F.col("_count").alias(name))


def sliding_count(requests: DataFrame, window_seconds: int, *, key: str = "key", ts: str = "ts", parts: int = PARTS) -> DataFrame:
    """Adds ``in_window``: requests of the key in (ts - window, ts], itself and others of that instant included.

    A request without a time counts those without a time.
    """
    rows = requests.withColumn("_at", micros(ts))
    counted = _in_window(rows, [key], "_at", window_seconds * 1_000_000, "in_window", parts)
    return counted.drop("_at")


def distinct_second_limit(requests: DataFrame, limit: int, window_seconds: int, *, key: str = "key", ts: str = "ts", id_col: str = "id", parts: int = PARTS) -> DataFrame:
    """The limiter that records every request under its second: adds ``seconds`` (distinct ones in the window before this request) and ``allowed``.

    A second counts once, so the different seconds of a key are counted, and the
    second of a request only if an earlier request, by time and id, has it.
    """
    rows = requests.withColumn("_at", micros(ts)).withColumn("_second", F.call_function("div", F.col("_at") - F.pmod(F.col("_at"), F.lit(1_000_000)), F.lit(1_000_000).cast("long")))
    seconds = rows.groupBy(F.col(key).alias("_key"), F.col("_second").alias("_s")).agg(F.min(F.struct("_at", F.col(id_col).alias("id"))).alias("_first"))
    counted = _in_window(seconds, ["_key"], "_s", window_seconds, "_seen", parts)
    joined = rows.join(counted, rows[key].eqNullSafe(counted["_key"]) & rows["_second"].eqNullSafe(counted["_s"]))
    first = (F.struct("_at", F.col(id_col).alias("id")) == F.col("_first")).cast("long")
    out = joined.withColumn("seconds", F.col("_seen") - first)
    return out.withColumn("allowed", F.col("seconds") < limit).select(*requests.columns, "seconds", "allowed")
