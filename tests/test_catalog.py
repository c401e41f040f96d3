"""Every registered query of the catalog against DuckDB, on the smallest tables."""

import math
from pathlib import Path

import duckdb
import pytest

from tessella.plans import contracts
from tessella.plans.catalog import ORACLE_SQL, QUERIES

DATA = "/root/testdata/sf0.001"


def _plain(v):
    if isinstance(v, float):
        return "nan" if math.isnan(v) else round(v, 6)
    return v.isoformat() if hasattr(v, "isoformat") else v


@pytest.fixture(scope="module")
def con():
    con = duckdb.connect()
    for p in Path(DATA).glob("*.parquet"):
        con.execute(f"CREATE VIEW {p.stem} AS SELECT * FROM '{p}'")
    return con


@pytest.mark.parametrize("name", sorted(ORACLE_SQL))
def test_equals_sql(spark, con, name):
    df = QUERIES[name](spark, DATA)
    got = con.execute(ORACLE_SQL[name])
    names = [x[0] for x in got.description]
    assert sorted(names) == sorted(df.columns)
    want = sorted((tuple(_plain(row[names.index(c)]) for c in df.columns) for row in got.fetchall()), key=repr)
    assert sorted((tuple(map(_plain, row)) for row in df.collect()), key=repr) == want


def test_limiter_stream_equals_a_sequential_run(spark):
    from tessella.streaming.limiters import decide

    rows = spark.read.parquet(f"{DATA}/events.parquet").selectExpr("event_id", "user_id", "unix_micros(cast(ts as timestamp)) at").collect()
    want = {}
    for user in {r["user_id"] for r in rows}:
        own = sorted((r["at"], r["event_id"]) for r in rows if r["user_id"] == user)
        allowed, _, _ = decide([t for t, _ in own], [], 2, 86400 * 10**6)
        want |= {e: a for (_, e), a in zip(own, allowed, strict=True)}
    assert {r["id"]: r["allowed"] for r in QUERIES["limiter_a_stream"](spark, DATA).collect()} == want


def test_sessions_equal_a_sequential_run(spark):
    from tessella.streaming.limiters import session_step

    rows = spark.read.parquet(f"{DATA}/events.parquet").selectExpr("event_id", "user_id", "event_type", "props", "unix_micros(cast(ts as timestamp)) at").collect()
    want, sessions = {}, {}
    for r in sorted(rows, key=lambda r: (r["at"], r["event_id"])):
        op = contracts.SESSION_OPS[r["event_type"]]
        op = "replace" if op == "update" and r["event_id"] % 2 else op
        ok, sessions[r["user_id"]] = session_step(sessions.get(r["user_id"]), op, r["at"], r["props"], None, 86400)
        want[r["event_id"]] = (ok, r["props"] and sessions[r["user_id"]][0] if ok and op == "get" else None)
    got = {r["id"]: (r["ok"], r["data"]) for r in QUERIES["session_state_stream"](spark, DATA).collect()}
    assert got == want and any(ok for ok, _ in want.values()) and not all(ok for ok, _ in want.values())
