"""Operators that split hot keys, prune or commit, against brute force."""

import random
import statistics

import numpy as np
import pytest
from pyspark.sql import functions as F

from tessella.operators import paging, rate_limits, retention, search_index, stats, vector_index, vector_search, workflows
from tessella.sources import commits, tables


@pytest.mark.parametrize("parts", [1, 4, 64])
def test_sliding_windows_by_brute_force(spark, parts):
    """One hot key and few others, ties, borders a window apart, null times."""
    rng = random.Random(parts)
    rows = [(i, rng.choice("aaab"), rng.choice([None] + [rng.randrange(600) * 250_000 for _ in range(20)])) for i in range(400)]
    df = spark.createDataFrame(rows, "id long, key string, us long").withColumn("ts", F.timestamp_micros("us"))
    got = {r.id: r.in_window for r in rate_limits.sliding_count(df, 8, parts=parts).collect()}
    assert got == {i: sum(k2 == k and (t2 is t is None or None not in (t, t2) and t - 8_000_000 < t2 <= t) for _, k2, t2 in rows) for i, k, t in rows}
    timed = [r for r in rows if r[2] is not None]
    seen = {r.id: (r.seconds, r.allowed) for r in rate_limits.distinct_second_limit(df.where("us is not null"), 3, 8, parts=parts).collect()}
    for i, k, t in timed:
        before = {t2 // 10**6 for j, k2, t2 in timed if k2 == k and (t2, j) < (t, i) and t2 // 10**6 > t // 10**6 - 8}
        # a later request of the same second isn't before, and seconds are whole
        assert seen[i] == (len(before), len(before) < 3)


def test_a_hot_key_runs_in_many_tasks(spark):
    df = spark.range(20_000).select("id", F.lit("k").alias("key"), F.timestamp_micros(F.col("id") * 1_000_000).alias("ts"))
    out = rate_limits.sliding_count(df, 640)
    assert out.where("in_window = 640").count() == 20_000 - 639
    plan = out._jdf.queryExecution().executedPlan().toString()
    assert "hashpartitioning(key" in plan and "_bucket" in plan


@pytest.mark.parametrize("bracket", [2, 10**6])
def test_percentiles_equal_sorting(spark, bracket):
    """Small brackets force several cuts; ties, negative, huge and null values, one value, null keys."""
    rng = random.Random(4)
    groups = {"a": [rng.gauss(0, 1) for _ in range(500)], "b": [5.0], "c": [1e300, -1e300] + [rng.choice([1.0, 2.0]) for _ in range(99)], None: [1.0, 2.0, 4.0], "d": [float(k) for k in range(2000)]}
    rows = [(k, v) for k, vs in groups.items() for v in vs] + [("a", None)]
    rng.shuffle(rows)
    df = spark.createDataFrame(rows, "k string, v double").repartition(4)
    got = {r.k: (r.p0, r.p25, r.p50, r.p99, r.p100) for r in stats.percentiles(df, ["k"], F.col("v"), (0.0, 0.25, 0.5, 0.99, 1.0), bracket).collect()}
    for k, vs in groups.items():
        assert got[k] == pytest.approx(tuple(np.quantile(vs, q) for q in (0, 0.25, 0.5, 0.99, 1)), rel=1e-12)
    assert stats.percentiles(df.limit(0), ["k"], F.col("v"), (0.5,)).count() == 0


def test_latency_without_durations(spark):
    df = spark.createDataFrame([("a", 1.0), ("a", 3.0), ("b", None), (None, 2.0)], "k string, ms double")
    got = {r.k: (r.n, r.p50) for r in stats.latency(df, ["k"], F.col("ms"), F.col("ms") > 2, (0.5,)).collect()}
    assert got == {"a": (2, 2.0), "b": (1, None), None: (1, 2.0)}
    assert statistics.median([1.0, 3.0]) == got["a"][1]


def test_split_newest(spark):
    rng = random.Random(1)
    rows = [(rng.choice([1, 1, 1, 2, None]), rng.choice([None, 1, 2, 3]), i) for i in range(200)]
    df = spark.createDataFrame(rows, "k int, at int, id int")
    stay, go = retention.split_newest(df, "k", "at", "id", 7)
    kept = set()
    for k in {r[0] for r in rows}:
        own = sorted((r for r in rows if r[0] == k), key=lambda r: (r[1] is None, r[1] or 0, r[2]), reverse=True)
        kept |= {r[2] for r in own[:7]}
    assert {r.id for r in stay.collect()} == kept
    assert {r.id for r in go.collect()} == set(range(200)) - kept
    assert retention.delete_listed(df, go, ["id"]).count() == len(kept)
    assert "WindowGroupLimit" in go._jdf.queryExecution().executedPlan().toString()


def test_deep_pages(spark):
    rows = [(i, (i * 7919) % 101, None if i % 13 == 0 else i % 5) for i in range(3000)]
    df = spark.createDataFrame(rows, "id int, a int, b int").repartition(5)
    order = {"b": "desc", "a": "asc"}
    index = paging.page_index(df, {"a": {"gte": 3}}, order)
    want = [r.id for r in paging.page(df, None, {"a": {"gte": 3}}, order).collect()]
    for at in (paging.Page(1, 10), paging.Page(77, 13), paging.Page(292, 10), paging.Page(999, 100)):
        assert [r.id for r in paging.deep_page(df, index, at).collect()] == want[(at.page - 1) * at.size : at.page * at.size]
    assert paging.deep_page(df, paging.page_index(df.limit(0), None, order), paging.Page()).count() == 0


def test_levels_by_brute_force(spark):
    rng = random.Random(3)
    rows, want = [], {}
    for w in range(4):
        for s in range(30):
            deps = rng.sample(range(s), min(s, rng.choice([0, 1, 2, 3])))
            if (w, s) == (1, 20):
                deps.append(99)  # isn't there
            if (w, s) in ((2, 5), (2, 6)):
                deps = [11 - s]  # a cycle
            rows.append((w, s, deps))
            levels = [want[w, d] if (w, d) in want else None for d in deps]
            want[w, s] = None if None in levels else 1 + max(levels, default=-1)
    for s in range(30):  # what is behind the cycle
        deps = next(d for w, t, d in rows if (w, t) == (2, s))
        want[2, s] = None if s in (5, 6) or any(want[2, d] is None for d in deps) else want[2, s]
    df = spark.createDataFrame(rows, "workflow_id int, step_id int, dependencies array<int>")
    assert {(r.workflow_id, r.step_id): r.level for r in workflows.levels(df).collect()} == want


def test_changes_one_after_another(spark):
    """Partial changes merged at once equal those made one by one."""
    rng = random.Random(8)
    table = {i: ["x", 0] for i in range(20)}
    changes = [(rng.randrange(22), rng.choice([None, "a", "b"]), rng.choice([None, 1, 2]), at) for at in range(60)]
    rows = spark.createDataFrame([(i, s, n) for i, (s, n) in table.items()], "id int, s string, n int")
    got = retention.apply_changes(rows, spark.createDataFrame(changes, "id int, s string, n int, at int"), ["s", "n"], order="at").collect()
    for i, s, n, _ in changes:
        if i in table:
            table[i] = [s if s is not None else table[i][0], n if n is not None else table[i][1]]
    assert {r.id: [r.s, r.n] for r in got} == table
    open_ = spark.createDataFrame([(1, None, "running", 5, None), (2, None, "running", 3, None)], "id int, result string, status string, duration int, completed_at timestamp")
    results = spark.createDataFrame([(1, "r1", "failed", 7, 1), (1, "r2", None, None, 2), (2, "r3", "failed", None, 1)], "id int, result string, status string, duration int, at int")
    done = retention.complete_invocations(open_, results, F.current_timestamp(), order="at").collect()
    assert {r.id: (r.result, r.status, r.duration) for r in done} == {1: ("r2", "completed", 7), 2: ("r3", "failed", 3)}


def test_commits_show_all_tables_or_none(spark, tmp_path):
    root = str(tmp_path / "store")
    parent, child = (spark.createDataFrame([(i,)], "id int") for i in (1, 2))
    assert commits.commit(spark, root, append={"parent": parent, "child": child}) == 1

    def broken():
        raise RuntimeError

    bad = spark.range(1).select(F.raise_error(F.lit("dies")).cast("int").alias("id"))
    with pytest.raises(Exception, match="dies"):  # after the parent's files are written
        commits.commit(spark, root, append={"parent": parent, "child": bad})
    assert commits.latest(spark, root) == 1 and commits.read(spark, root, "parent").count() == 1
    assert commits.commit(spark, root, append={"parent": parent}, base=1) == 2
    with pytest.raises(FileExistsError):  # another writer was first
        commits.commit(spark, root, append={"parent": parent}, base=1)
    assert commits.read(spark, root, "parent").count() == 2 and commits.read(spark, root, "parent", version=1).count() == 1
    late = iter([True, False])

    def add(held):
        if next(late):
            commits.commit(spark, root, append={"child": child})  # comes between reading and writing
        return {"parent": held["parent"].limit(1), "child": held["child"]}

    assert commits.change(spark, root, add) == 4
    assert commits.read(spark, root, "child").count() == 2
    assert commits.commit(spark, root, remove=("child",)) == 5
    with pytest.raises(ValueError):
        commits.read(spark, root, "child")


def test_a_database_is_read_in_parts(spark, tmp_path):
    url = f"jdbc:derby:{tmp_path}/db;create=true"
    rows = spark.range(1, 1001).select(F.col("id").alias("ID"), (F.col("id") % 7).alias("KIND")).unionByName(spark.sql("SELECT CAST(NULL AS BIGINT) AS ID, 5L AS KIND"))
    rows.write.jdbc(url, "ROWS_", mode="overwrite", properties={"driver": "org.apache.derby.jdbc.EmbeddedDriver"})
    df = tables.read_source(spark, "jdbc", url, dbtable="ROWS_", key="ID", rows=100, driver="org.apache.derby.jdbc.EmbeddedDriver")
    assert df.rdd.getNumPartitions() == 11 and df.count() == 1001 and df.where("ID IS NULL").count() == 1
    assert sorted(r.ID for r in df.where("ID is not null").select("ID").collect()) == list(range(1, 1001))
    found = df.where("KIND = 3").select("ID")
    assert found.count() == 143 and "EqualTo(KIND,3)" in found._jdf.queryExecution().executedPlan().toString()
    none = spark.range(0).select(F.col("id").alias("ID"))
    none.write.jdbc(url, "NONE_", mode="overwrite", properties={"driver": "org.apache.derby.jdbc.EmbeddedDriver"})
    assert tables.read_database(spark, url, "NONE_", "ID", driver="org.apache.derby.jdbc.EmbeddedDriver").count() == 0


def test_indexed_search_equals_a_scan(spark, tmp_path):
    rng = random.Random(6)
    rows = [(i, None if i % 17 == 0 else "".join(rng.choice("abÄé %_") for _ in range(rng.randrange(12))), rng.choice(["", "X" * i, None])) for i in range(300)]
    df = spark.createDataFrame(rows, "id int, t string, u string")
    path = str(tmp_path / "index")
    search_index.build(df, path, ["t", "u"], blocks=40)
    from tessella.functions.predicates import search

    for text in ("aba", "ÄÉ ", "% a", "a", "", "zzz", "bÄéa", "xxxx" * 40, "B_%"):
        for columns in (("t",), ("t", "u")):
            got = search_index.find(spark, path, text, *columns, indexed=["t", "u"])
            assert sorted(r.id for r in got.collect()) == sorted(r.id for r in df.where(search(text, *columns)).collect())
    assert search_index.blocks_of(spark, path, "ab", {"t": 0}) is None
    assert len(search_index.blocks_of(spark, path, "bÄéa", {"t": 0})) < 20
    plan = search_index.find(spark, path, "bÄéa", "t", indexed=["t", "u"])._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters: [isnotnull(_block" in plan or "PartitionFilters: [_block" in plan


def test_pruned_search_equals_all_pairs(spark, monkeypatch):
    """Clusters, copies, bad vectors; most tiles are left out."""
    for name, size in (("TILE_ROWS", 16), ("BLOCK_ROWS", 8), ("META_ROWS", 10)):
        monkeypatch.setattr(vector_index, name, size)
    rng = np.random.default_rng(2)
    centres = rng.normal(size=(12, 6))
    rows = [(i, [float(x) for x in centres[i % 12] + rng.normal(size=6) * 0.05]) for i in range(900)]
    rows += [(900, None), (901, [0.0] * 6), (902, [float("nan")] * 6), (903, [1.0, 2.0]), (904, [float("inf")] * 6), (905, rows[0][1]), (906, rows[0][1])]
    df = spark.createDataFrame(rows, "id long, vector array<double>").repartition(3)
    asked = df.where("id % 9 = 0 or id > 898")
    found, pairs = vector_index.search(vector_index.build(df, dim=6, pivots=12), asked, k=5)
    want = vector_search.batch_top_k(df, asked.where("id <> 903"), k=5)
    key = lambda r: (r.query_id, r["rank"])
    assert [tuple(r) for r in sorted(found.collect(), key=key)] == [tuple(r) for r in sorted(want.collect(), key=key)]
    n_tiles = vector_index.build(df, dim=6, pivots=12).tiles.count()
    assert pairs.agg(F.sum("queries")).first()[0] < 0.5 * n_tiles * found.select("query_id").distinct().count()


def test_top_k_without_bad_vectors(spark):
    inf, nan = float("inf"), float("nan")
    rows = [(1, [1.0, 0.0]), (2, [inf, 1.0]), (3, [nan, 1.0]), (4, [1.0]), (5, [1.0, None]), (6, None), (7, [0.0, 0.0]), (8, [0.5, 0.5])]
    df = spark.createDataFrame(rows, "id long, vector array<double>")
    for metric, ids in (("cosine", [1, 8]), ("dot_product", [1, 8, 7]), ("euclidean", [1, 8, 7])):
        assert [r.id for r in vector_search.top_k(df, [1.0, 0.0], metric=metric).collect()] == ids
    assert [r.id for r in vector_search.top_k(df, [1.0, 0.0], threshold=0.9).collect()] == [1]
    got = vector_search.batch_top_k(df, df, k=9).collect()
    assert sorted((r.query_id, r.id) for r in got) == [(1, 1), (1, 8), (4, 4), (8, 1), (8, 8)]


@pytest.mark.parametrize("chunk", [1, 3, 1 << 20])
def test_tasks_tell_all_trigrams(monkeypatch, spark, chunk):
    """A task's different trigrams, whatever the alphabet, are those of the column function; there is a row for each, not one for each text."""
    rng = random.Random(chunk)
    alphabet = "aaabB \x00\n%éßÄıİ\u00ff\u0100日本語😀"
    rows = [(i, i % 3, rng.choice([None, "", "a", "ab", "日本"] + ["".join(rng.choices(alphabet, k=rng.randint(0, 12))) for _ in range(9)]), "".join(rng.choices(alphabet, k=4))) for i in range(600)]
    df = spark.createDataFrame(rows, "id long, block int, t string, u string")
    want = {(r.block, k, g) for k, c in enumerate("tu") for r in df.select("block", search_index.trigrams(F.col(c)).alias("g")).collect() for g in r.g}
    low = df.select("block", F.lower("t").alias("t"), F.lower("u").alias("u")).toArrow().combine_chunks().to_batches()[0]
    monkeypatch.setattr(search_index, "CHUNK", chunk)
    for tables in (1, 8):
        monkeypatch.setattr(search_index, "TABLES", tables)
        found = [tuple(r.values()) for b in search_index._grams(iter([low.slice(0, 250), low.slice(250)])) for r in b.to_pylist()]
        assert set(found) == want
    assert len(found) == len(want)
