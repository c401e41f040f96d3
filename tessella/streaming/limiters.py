"""Streams of requests and messages with state by key."""

from __future__ import annotations

from collections import deque
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from ..sources.tables import scratch, utc


def decide(times: list[int], accepted: list[int], limit: int, window: int) -> tuple[list[bool], list[int], list[int]]:
    """Decisions, remaining requests, and the accepted times that are still in the window; times ascend."""
    allowed, remaining, held = [], [], deque(accepted)
    for t in times:
        while held and held[0] <= t - window:
            held.popleft()
        ok = len(held) < limit
        if ok:
            held.append(t)
        allowed.append(ok)
        remaining.append(limit - len(held))
    return allowed, remaining, list(held)


def _keep(state: GroupState, value: tuple, until_ms: int) -> None:
    """Update the state and let it time out; what is over already goes at once."""
    if until_ms <= state.getCurrentWatermarkMs():
        if state.exists:
            state.remove()
    else:
        state.update(value)
        state.setTimeoutTimestamp(until_ms)


def sliding_limit(requests: DataFrame, limit: int = 100, window_seconds: int = 60, *, key: str = "user_id", ts: str = "ts", id_col: str = "event_id", delay: str = "10 minutes") -> DataFrame:
    """A stream of decisions: id, key, allowed, remaining.  A rejected request isn't recorded.

    State is at most ``limit`` times for each key, and a key that is idle for a
    window has none.  Requests are taken in the order of their times within a
    micro-batch; one that comes later than its successors' batch is judged as
    it comes, one that comes more than ``delay`` late isn't judged.
    """
    rows = requests.select(F.col(key).alias("key"), F.col(id_col).alias("id"), utc(ts).alias("time")).withWatermark("time", delay)
    rows = rows.withColumn("at", F.unix_micros("time"))
    out = T.StructType([T.StructField("id", rows.schema["id"].dataType), T.StructField("key", rows.schema["key"].dataType), T.StructField("allowed", T.BooleanType()), T.StructField("remaining", T.LongType())])
    window = window_seconds * 1_000_000

    def run(name: tuple, frames: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        if state.hasTimedOut:
            state.remove()
            return
        pdf = pd.concat(list(frames)).sort_values(["at", "id"])
        accepted = list(state.get[0]) if state.exists else []
        allowed, remaining, accepted = decide(pdf["at"].tolist(), accepted, limit, window)
        _keep(state, (accepted,), (max(accepted, default=0) + window) // 1000 + 1)
        yield pd.DataFrame({"id": pdf["id"].to_numpy(), "key": name[0], "allowed": allowed, "remaining": remaining})

    return rows.groupBy("key").applyInPandasWithState(run, out, "accepted array<long>", "append", GroupStateTimeout.EventTimeTimeout)


def session_step(session: tuple[str, int] | None, op: str, at: int, data: str | None, ttl: int | None, default_ttl: int) -> tuple[bool, tuple[str, int] | None]:
    """Whether a command succeeds, and the session (data, end in microseconds) after it.

    create and update set the data and its time to live, extend only that;
    without ``ttl`` they take the default.  replace sets the data and keeps the
    end of a session that is there (another gets the default).  get and delete
    succeed on a session that is there; one whose end has come isn't.
    """
    if session is not None and session[1] <= at:
        session = None
    end = at + 1_000_000 * (ttl or default_ttl)
    if op in ("create", "update", "replace"):
        return True, (data, session[1] if op == "replace" and session is not None else end)
    if session is None:
        return False, None
    return True, {"get": session, "extend": (session[0], end), "delete": None}[op]


def session_state(commands: DataFrame, default_ttl: int = 3600, *, delay: str = "10 minutes") -> DataFrame:
    """A stream of commands (key, id, ts, op, data, ttl in seconds) to sessions: id, key, ok, data (of a get), ends_at.

    Commands are taken in the order of their times within a micro-batch; the
    state of a session is dropped when the watermark passes its end.
    """
    rows = commands.select("key", "id", "op", "data", "ttl", utc("ts").alias("time")).withWatermark("time", delay)
    rows = rows.withColumn("at", F.unix_micros("time"))
    out = T.StructType([T.StructField("id", rows.schema["id"].dataType), T.StructField("key", rows.schema["key"].dataType), T.StructField("ok", T.BooleanType()), T.StructField("data", T.StringType()), T.StructField("ends_at", T.LongType())])

    def run(name: tuple, frames: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        if state.hasTimedOut:
            state.remove()
            return
        pdf = pd.concat(list(frames)).sort_values(["at", "id"])
        session, said = tuple(state.get) if state.exists else None, []
        for id_, op, data, ttl, at in zip(pdf["id"], pdf["op"], pdf["data"], pdf["ttl"], pdf["at"], strict=True):
            ok, session = session_step(session, op, int(at), data, None if pd.isna(ttl) else int(ttl), default_ttl)
            said.append((id_, name[0], ok, session[0] if ok and op == "get" else None, session[1] if session else None))
        if session is not None:
            _keep(state, session, session[1] // 1000 + 1)
        elif state.exists:
            state.remove()
        yield pd.DataFrame(said, columns=out.names).astype({"ends_at": "Int64"})

    return rows.groupBy("key").applyInPandasWithState(run, out, "data string, ends_at long", "append", GroupStateTimeout.EventTimeTimeout)


def last_activity(messages: DataFrame, *, key: str = "user_id", ts: str = "ts") -> DataFrame:
    """A stream of the latest time by key and of how many messages there are.

    A key's state is two numbers and stays, as a key may come back at any time;
    in update mode a micro-batch writes only the keys that it has.
    """
    return messages.withColumn("_at", utc(ts)).groupBy(key).agg(F.max("_at").alias("last_activity"), F.count("*").alias("n"))


def file_stream(spark: SparkSession, folder: str, name: str, schema: T.StructType) -> DataFrame:
    """A stream of a Parquet table in a folder, be it one file or a folder of files."""
    return spark.readStream.schema(schema).parquet(f"{folder}/{{{name}}}")  # a stream's path can't be a single file, but a pattern that one file fits


def run_once(stream: DataFrame, mode: str = "append", key: str | list[str] | None = None) -> DataFrame:
    """Run a stream over all that is there, into files, and read the result back; of an update-mode stream, the last row of each key."""
    spark = stream.sparkSession
    path = scratch(spark, "stream")

    def write(df: DataFrame, batch: int) -> None:
        df.write.mode("overwrite").parquet(f"{path}/out/batch={batch}")  # a repeated batch replaces itself

    write(spark.createDataFrame([], stream.schema), -1)  # a stream without rows runs no batch
    query = stream.writeStream.outputMode(mode).option("checkpointLocation", f"{path}/state").trigger(availableNow=True).foreachBatch(write).start()
    query.awaitTermination()
    rows = spark.read.option("basePath", f"{path}/out").parquet(f"{path}/out")
    if mode != "update":
        return rows.drop("batch")
    keys = [key] if isinstance(key, str) else key
    return rows.groupBy(*keys).agg(F.max_by(F.struct(*(c for c in rows.columns if c not in (*keys, "batch"))), "batch").alias("_last")).select(*keys, "_last.*")
