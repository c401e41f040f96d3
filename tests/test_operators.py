"""Edge cases and plans."""

import pytest
from pyspark.sql import functions as F

from tessella.functions import predicates as P
from tessella.functions import text, vectors
from tessella.operators import paging, rate_limits, relations, retention, stats, vector_search, workflows
from tessella.streaming.limiters import decide


def test_page_bounds():
    for bad in ((0, 20), (1, 101), (1, 0)):
        with pytest.raises(ValueError):
            paging.Page(*bad)
    assert paging.Page() == paging.Page(1, 20)


def test_pages(spark):
    df = spark.createDataFrame([(i, 1) for i in range(5)], "id int, created_at int")
    assert [r.id for r in paging.page(df, paging.Page(1, 2)).collect()] == [0, 1]
    assert [r.id for r in paging.page(df, None).collect()] == list(range(5))
    assert paging.page(df, paging.Page(99, 2)).count() == 0
    assert tuple(paging.envelope(df, paging.Page(1, 2)).first()) == (1, 2, 5, 3, True, False)
    assert "TakeOrderedAndProject" in paging.page(df, paging.Page(1, 2))._jdf.queryExecution().toString()


def test_search_is_literal_and_keeps_rows_with_nulls(spark):
    df = spark.createDataFrame([("Search Test Agent", None), ("Another", "100% sure"), ("x_y", "")], "name string, description string")
    found = lambda q: [r.name for r in df.where(P.search(q, "name", "description")).collect()]
    assert (found("search"), found("%"), found("_")) == (["Search Test Agent"], ["Another"], ["x_y"])


def test_where(spark):
    df = spark.range(6)
    assert [r.id for r in df.where(P.where({"id": {"gte": 2, "lt": 4}})).collect()] == [2, 3]
    assert df.where(P.where({})).count() == 6
    with pytest.raises(ValueError):
        P.where({"id": {"like": 1}})


def test_equality_is_pushed_down(spark):
    plan = paging.by_id(spark.read.parquet("/root/testdata/sf0.001/orders.parquet"), 7, "o_orderkey")._jdf.queryExecution().toString()
    assert "EqualTo(o_orderkey,7)" in plan


def test_nest_and_newest(spark):
    parents = spark.createDataFrame([(1,), (2,)], "id int")
    children = spark.createDataFrame([(1, 10, 5), (1, 11, 5), (1, 12, 4)], "pid int, cid int, at int")
    got = {r.id: [c.cid for c in r.kids] for r in relations.nest(parents, children, "id", "pid", ["cid"], "kids").collect()}
    assert got == {1: [10, 11, 12], 2: []}
    assert [r.cid for r in relations.newest(children, "pid", [F.desc("at"), "cid"], 2).orderBy("rn").collect()] == [10, 11]


def test_empty_statistics(spark):
    assert stats.invocation_stats(spark.createDataFrame([], "tool_id int, status string, duration int")).count() == 0
    r = stats.invocation_stats(spark.createDataFrame([(1, "pending", None)], "tool_id int, status string, duration int")).first()
    assert (r.success_rate, r.avg_duration) == (0.0, 0.0)


def test_vectors(spark):
    df = spark.createDataFrame([(1, [0.0, 0.0]), (2, [1.0, 0.0]), (3, [2.0, 0.0]), (4, [0.6, 0.8])], "id int, vector array<double>")
    assert [r.id for r in vector_search.top_k(df, [1.0, 0.0]).collect()] == [2, 3, 4]
    assert [r.id for r in vector_search.top_k(df, [1.0, 0.0], threshold=0.6).collect()] == [2, 3]
    assert df.select(vectors.cosine(F.col("vector"), vectors.literal([1.0, 0.0]))).first()[0] is None
    with pytest.raises(ValueError):
        vector_search.top_k(df, [1.0], k=101)
    with pytest.raises(ValueError):
        vector_search.batch_top_k(df, df, max_queries=3)


def test_batch_search_has_no_cap(spark):
    rows = spark.range(10_100).select(F.col("id"), F.array(F.cos(F.col("id") / 3.0), F.sin(F.col("id") / 3.0)).alias("vector"))
    got = vector_search.batch_top_k(rows.where("id < 19"), rows, k=2).where("rank = 1").collect()
    assert len(got) == 10_100 and all(r.score > 0.98 for r in got)
    assert all(r.id == r.query_id for r in got if r.query_id < 19)


def test_chunk_numbers(spark):
    df = spark.createDataFrame([(n, "x" * n) for n in (0, 1, 1000, 1001, 1800, 1801)], "doc_id int, text string")
    got = {r.doc_id: r.n for r in text.chunk_fixed(df).groupBy("doc_id").agg(F.count("*").alias("n")).collect()}
    assert [got.get(n, 0) for n in (0, 1, 1000, 1001, 1800, 1801)] == [0, 1, 1, 2, 2, 3]


def test_archive_is_strict(spark):
    df = spark.createDataFrame([(1, 5, "ACTIVE"), (2, 4, "ACTIVE"), (3, 4, "ARCHIVED"), (4, None, "ACTIVE")], "id int, last_activity int, status string")
    assert [r.id for r in retention.archive_old(df, F.lit(5)).where("changed").collect()] == [2]


def test_keep_newest_with_fewer(spark):
    df = spark.createDataFrame([(1, 1), (1, 2)], "k int, at int")
    stay, go = retention.split_newest(df, "k", "at", "at", 100)
    assert (stay.count(), go.count()) == (2, 0)


def test_window_boundary_and_burst(spark):
    df = spark.createDataFrame([(1, "2026-01-01 00:00:00"), (2, "2026-01-01 00:01:00"), (3, "2026-01-01 00:01:00")], "id int, t string").select("id", F.lit("k").alias("key"), F.col("t").cast("timestamp").alias("ts"))
    assert [r.in_window for r in rate_limits.sliding_count(df, 60).orderBy("id").collect()] == [1, 2, 2]
    assert [r.seconds for r in rate_limits.distinct_second_limit(df, 5, 60).orderBy("id").collect()] == [0, 0, 1]
    allowed, remaining, accepted = decide([7] * 150, [], 100, 60)
    assert (sum(allowed), remaining[-1], len(accepted)) == (100, 0, 100)
    assert decide([5], [1, 2, 3, 4, 4], 10, 60)[1] == [4]


def test_cycle_has_no_level(spark):
    steps = spark.createDataFrame([(1, "a", ["b"]), (1, "b", ["a"]), (1, "c", [])], "workflow_id int, step_id string, dependencies array<string>")
    assert {r.step_id: r.level for r in workflows.levels(steps).collect()} == {"a": None, "b": None, "c": 0}


def test_repeated_changes_keep_one_row(spark):
    rows = spark.createDataFrame([(1, "a"), (2, "b")], "id int, status string")
    changes = spark.createDataFrame([(1, "c", 1), (1, "b", 2), (3, "x", 1)], "id int, status string, at int")
    got = retention.apply_changes(rows, changes, ["status"], order="at")
    assert sorted(map(tuple, got.collect())) == [(1, "b"), (2, "b")]
    assert sorted(map(tuple, retention.apply_changes(rows, changes, ["status"]).collect())) == [(1, "c"), (2, "b")]
    open_ = spark.createDataFrame([(1, None, "running", 5, None)], "id int, result string, status string, duration int, completed_at timestamp")
    results = spark.createDataFrame([(1, "{}", None, 7), (1, "{1}", "failed", None)], "id int, result string, status string, duration int")
    assert retention.complete_invocations(open_, results, F.current_timestamp()).count() == 1


def test_batch_top_k_leaves_out_nulls_and_breaks_ties_by_id(spark):
    rows = [(0, [1.0, 0.0]), (1, None), (2, [1.0, None]), (3, [float("nan"), 1.0]), (7, [2.0, 0.0]), (5, [1.0, 0.0]), (9, [0.0, 1.0]), (8, [0.0, 0.0])]
    df = spark.createDataFrame(rows, "id long, vector array<double>")
    got = vector_search.batch_top_k(df, df.where("id in (0, 1)"), k=2).orderBy("rank").collect()
    assert [(r.query_id, r["rank"], r.id) for r in got] == [(0, 1, 0), (0, 2, 5)]
    assert vector_search.batch_top_k(df.limit(0), df).count() == 0


def test_globs_and_json_keys(spark):
    df = spark.createDataFrame([("cls:a\\E.b:id7", '{"a.b": 1, "a": {"b": 2}}'), ("cls:x", "{}")], "k string, j string")
    assert [r.k for r in df.where(P.glob(F.col("k"), "cls:*\\E.*:id*")).collect()] == ["cls:a\\E.b:id7"]
    assert df.where(P.glob(F.col("k"), "*")).count() == 2 and df.where(P.glob(F.col("k"), "ls*")).count() == 0
    r = df.select(P.json_value("j", "a.b", "int").alias("dotted"), P.json_value("j", ["a", "b"], "int").alias("nested")).first()
    assert (r.dotted, r.nested) == (1, 2)


def test_times_without_zone_are_utc(spark):
    from tessella.sources.tables import utc

    df = spark.sql("SELECT TIMESTAMP_NTZ '2024-03-31 02:30:00.25' AS ts")
    try:
        spark.conf.set("spark.sql.session.timeZone", "Europe/Berlin")
        assert df.select(F.unix_micros(utc("ts"))).first()[0] == 1711852200250000
    finally:
        spark.conf.set("spark.sql.session.timeZone", "UTC")


def test_memory_window_with_a_null_text(spark):
    df = spark.createDataFrame([("s", 1, 1, "abc"), ("s", 2, 2, None)], "session_id string, created_at int, id int, content string")
    assert workflows.memory_window(df, context_window=3).count() == 2


def test_activity_never_moves_back_and_json_is_replaced(spark):
    sessions = spark.createDataFrame([(1, 5, "{}"), (2, 9, "{}")], "id int, last_activity int, statistics string")
    activity = spark.createDataFrame([(1, 7), (2, 3), (1, 6)], "id int, at int")
    assert sorted((r.id, r.last_activity) for r in retention.touch(sessions, activity).collect()) == [(1, 7), (2, 9)]
    new = spark.createDataFrame([(1, 3, None)], "id int, n int, at int")
    assert {r.id: r.statistics for r in retention.replace_json(sessions, new, "statistics").collect()} == {1: '{"n":3,"at":null}', 2: "{}"}


def test_sessions_expire():
    from tessella.streaming.limiters import session_step

    ok, s = session_step(None, "create", 0, "d", 10, 3600)
    assert ok and s == ("d", 10_000_000)
    assert session_step(s, "get", 9_999_999, None, None, 3600) == (True, s)
    assert session_step(s, "get", 10_000_000, None, None, 3600) == (False, None)
    assert session_step(s, "extend", 5_000_000, None, None, 3600) == (True, ("d", 3_605_000_000))
    assert session_step(s, "delete", 1, None, None, 3600) == (True, None)
    assert session_step(None, "extend", 1, None, None, 3600) == (False, None)


def test_reading_and_inserting_with_children(spark, tmp_path):
    from tessella.sources import tables

    parent, child = (spark.createDataFrame([(1,)], "id int") for _ in range(2))
    tables.insert_with_children(parent, str(tmp_path / "p"), [(child, str(tmp_path / "c"))])
    assert spark.read.parquet(str(tmp_path / "p")).count() == spark.read.parquet(str(tmp_path / "c")).count() == 1
    (tmp_path / "t.txt").write_text("one\ntwo\n")
    assert [r.text for r in tables.read_source(spark, "text", str(tmp_path / "t.txt")).collect()] == ["one", "two"]
    with pytest.raises(ValueError):
        tables.read_source(spark, "tape", "x")
