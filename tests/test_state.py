"""Streams that go on where they ended, against one run and SQL."""

import json
import os
import time

import duckdb
from pyspark.sql import functions as F

from tessella.plans import contracts  # noqa: F401  registers its queries in the catalog
from tessella.plans.catalog import QUERIES
from tessella.streaming import latency, limiters, refresh

DATA = "/root/testdata/sf0.001"


def _halves(spark, table, tmp_path):
    """A folder to which the two halves of a table are written one after the other."""
    rows = spark.read.parquet(f"{DATA}/{table}.parquet")
    folder = str(tmp_path / table)

    def put(where):
        rows.where(where).coalesce(1).write.mode("append").parquet(folder)

    return rows.schema, folder, put


def _source(spark, folder, schema):
    rows = spark.readStream.schema(schema).parquet(folder)
    return rows.select(F.col("label").cast("long").alias("vector_store_id"), F.expr("vec_id div 3").alias("document_id"))


def test_statistics_resume(spark, tmp_path):
    """Two runs over two halves equal one run, a batch reads its own rows, and the second run starts from the first one's state."""
    schema, folder, put = _halves(spark, "embeddings", tmp_path)
    stores = spark.range(12).select("id", F.lit("{}").alias("statistics"))
    sql = f"SELECT label, count(*), count(DISTINCT vec_id // 3) FROM '{DATA}/embeddings.parquet' WHERE %s GROUP BY 1"
    state, counted = str(tmp_path / "state"), []
    for where, so_far in (("vec_id % 2 = 0", "vec_id % 2 = 0"), ("vec_id % 2 = 1", "true")):
        put(where)
        got = refresh.keep_statistics(_source(spark, folder, schema), stores, state, buckets=4).collect()
        stats = {r.id: json.loads(r.statistics) for r in got}
        want = {i: {"total_vectors": n, "total_documents": m} for i, n, m in duckdb.sql(sql % so_far).fetchall()}
        assert {i: s for i, s in stats.items() if s} == want
        counted.append(spark.read.parquet(f"{state}/totals").groupBy("batch").count().count())
    assert counted == [1, 2]
    offsets = sorted(p for p in os.listdir(f"{state}/checkpoint/offsets") if p.isdigit())
    assert offsets == ["0", "1"]


def test_late_requests_are_left_out(spark, tmp_path):
    """A request of a window that the watermark of the batch before has passed isn't counted; one within the delay is."""
    folder = str(tmp_path / "requests")
    batches = [[("a", "2026-01-01 00:10:00", 1.0), ("a", "2026-01-01 05:00:00", 2.0)], [("a", "2026-01-01 04:30:00", 4.0)], [("a", "2026-01-01 00:20:00", 9.0)], [("b", "2026-01-01 09:00:00", 7.0)]]
    for rows in batches:
        spark.createDataFrame(rows, "route string, t string, ms double").select("route", F.col("t").cast("timestamp_ntz").alias("ts"), "ms").coalesce(1).write.mode("append").parquet(folder)
        time.sleep(1.1)
    source = spark.readStream.schema("route string, ts timestamp_ntz, ms double").option("maxFilesPerTrigger", 1).parquet(folder)
    out = latency.latency_windows(source, ["route"], F.col("ms"), F.col("ms") > 3, width="1 hour", delay="1 hour", shares=(0.5,))
    got = limiters.run_once(out, "update", ["window_start", "route"]).collect()
    assert sorted((r.route, r.window_start.hour, r.n, r.failures, r.p50) for r in got) == [("a", 0, 1, 0, 1.0), ("a", 4, 1, 1, 4.0), ("a", 5, 1, 0, 2.0), ("b", 9, 1, 1, 7.0)]


def test_a_session_keeps_its_end():
    step = limiters.session_step
    ok, s = step(None, "create", 0, "d", 10, 3600)
    assert step(s, "replace", 5_000_000, "e", None, 3600) == (True, ("e", 10_000_000))
    assert step(s, "update", 5_000_000, "e", None, 3600) == (True, ("e", 3_605_000_000))
    assert step(s, "replace", 10_000_000, "e", 7, 3600) == (True, ("e", 17_000_000))


def test_limiter_with_its_defaults(spark):
    """100 requests a minute: of 150 in one second the last 50 are refused, one a minute later is let in."""
    folder_rows = [(k, "u", "2026-01-01 00:00:00.%06d" % k) for k in range(150)] + [(150, "u", "2026-01-01 00:01:00.000099")]
    from tessella.sources.tables import scratch

    path = scratch(spark, "burst")
    spark.createDataFrame(folder_rows, "event_id long, user_id string, t string").select("event_id", "user_id", F.col("t").cast("timestamp_ntz").alias("ts")).coalesce(1).write.parquet(path)
    source = spark.readStream.schema("event_id long, user_id string, ts timestamp_ntz").parquet(path)
    got = {r.id: (r.allowed, r.remaining) for r in limiters.run_once(limiters.sliding_limit(source)).collect()}
    assert sorted(k for k, v in got.items() if not v[0]) == list(range(100, 150))
    assert got[150] == (True, 99)


def _as_folders(spark, folder, *names, rows=None):
    """Tables of the test data, or of the rows, as folders of files."""
    for name in names:
        df = spark.read.parquet(f"{DATA}/{name}.parquet") if rows is None else rows
        df.repartition(3).write.parquet(f"{folder}/{name}.parquet")


def test_streams_read_tables_of_several_files(spark, tmp_path):
    _as_folders(spark, tmp_path, "embeddings", "events")
    for name in ("store_stats_stream", "latency_stream", "limiter_a_stream", "session_state_stream"):
        one, many = (sorted(map(tuple, QUERIES[name](spark, d).collect()), key=repr) for d in (DATA, str(tmp_path)))
        assert one == many and one


def test_streams_of_empty_tables(spark, tmp_path):
    for name in ("embeddings", "events"):
        _as_folders(spark, tmp_path, name, rows=spark.read.parquet(f"{DATA}/{name}.parquet").limit(0))
    for name in ("store_stats_stream", "latency_stream", "limiter_a_stream"):
        assert QUERIES[name](spark, str(tmp_path)).collect() == []


def test_percentiles_of_large_windows_are_exact(spark, tmp_path):
    """More different durations than a sketch holds, ties, routes without durations, values dealt to many ranges."""
    path, shares = str(tmp_path / "requests"), (0.5, 0.95, 0.99)
    rows = spark.range(30_000).select(F.when(F.col("id") % 10 > 0, "a").when(F.col("id") % 20 > 0, "b").alias("route"), F.expr("timestamp_ntz'2026-01-01' + make_interval(0, 0, 0, 0, 0, 0, id % 7000)").alias("ts"), F.expr("if(id % 20 = 10, null, id * 7919 % 20011 / 8)").alias("ms"))
    rows.write.parquet(path)
    source = spark.readStream.schema(rows.schema).parquet(path)
    got = latency.exact_latency(source, ["route"], F.col("ms"), F.col("ms") > 100, width="1 hour", shares=shares).drop("mean", "failure_rate").collect()
    want = duckdb.sql(f"SELECT date_trunc('hour', ts), route, count(*), count(*) FILTER (ms > 100), {', '.join(f'quantile_disc(ms, {s})' for s in shares)} FROM '{path}/*.parquet' GROUP BY 1, 2").fetchall()
    assert sorted(((r[0].replace(tzinfo=None), *r[1:]) for r in got), key=repr) == sorted(want, key=repr)
    counts = spark.range(1000).select(F.lit(1).alias("window_start"), F.col("id").cast("double").alias("_value"), F.lit(3).alias("n"), F.lit(0).alias("failures"))
    spark.conf.set("spark.sql.adaptive.enabled", "false")
    try:
        assert latency.latency_of_counts(counts, [], shares).drop("mean").first()[1:] == (3000, 0, 0.0, 499.0, 949.0, 989.0)
    finally:
        spark.conf.unset("spark.sql.adaptive.enabled")
