"""The agent-platform tables: their columns, reading, and changes written as new files.

A change is a DataFrame of the whole changed table; ``replace`` writes it to a
new path, which is how Parquet tables without transactions are updated.
"""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

_S, _I, _TS = T.StringType(), T.IntegerType(), T.TimestampType()


def _table(required: str, optional: str = "", **others: T.DataType) -> T.StructType:
    fields = [T.StructField(c, _S, False) for c in required.split()] + [T.StructField(c, _S) for c in optional.split()]
    return T.StructType(fields + [T.StructField(c, kind) for c, kind in others.items()])


#: Column types of the tables; JSON columns are strings.
SCHEMAS: dict[str, T.StructType] = {
    "agents": _table("id name model_id role orchestration_type status", "description configuration deployment_info metadata", created_at=_TS, updated_at=_TS),
    "workflows": _table("id agent_id name type status", "description definition", created_at=_TS, updated_at=_TS),
    "workflow_executions": _table("id workflow_id status", "parameters results", current_step=_I, start_time=_TS, end_time=_TS, created_at=_TS, updated_at=_TS),
    "tools": _table("id agent_id name status", "description function_signature connection_details security_policy mcp_server_id", created_at=_TS, updated_at=_TS),
    "tool_invocations": _table("id tool_id status", "parameters context result", duration=_I, created_at=_TS, completed_at=_TS),
    "conversation_sessions": _table("id agent_id user_id status", "context metadata", created_at=_TS, last_activity=_TS),
    "messages": _table("id session_id role content", "metadata tool_calls", created_at=_TS),
    "vector_stores": _table("id name type status", "configuration statistics", created_at=_TS, updated_at=_TS),
    "embeddings": _table("id vector_store_id document_id content", "metadata", chunk_index=_I, vector=T.ArrayType(T.DoubleType()), created_at=_TS),
    "mcp_servers": _table("id name endpoint_url status", "authentication_details capabilities security_policy", created_at=_TS, updated_at=_TS),
    "evaluations": _table("id agent_id name status", "description test_dataset_id metrics results", start_time=_TS, end_time=_TS, created_at=_TS, updated_at=_TS),
    "users": _table("id email username hashed_password", "metadata", is_active=T.BooleanType(), is_admin=T.BooleanType(), created_at=_TS, updated_at=_TS),
    "system_config": _table("id key", "value", created_at=_TS, updated_at=_TS),
    "audit_log": _table("id action entity_type entity_id", "old_data new_data user_id", created_at=_TS),
}

#: Children of each table: (child, its foreign key). Deletes follow these.
CHILDREN: dict[str, list[tuple[str, str]]] = {
    "agents": [("workflows", "agent_id"), ("tools", "agent_id"), ("conversation_sessions", "agent_id"), ("evaluations", "agent_id")],
    "workflows": [("workflow_executions", "workflow_id")],
    "tools": [("tool_invocations", "tool_id")],
    "conversation_sessions": [("messages", "session_id")],
    "vector_stores": [("embeddings", "vector_store_id")],
}


def read(spark: SparkSession, path: str, table: str | None = None) -> DataFrame:
    """A Parquet table, with its declared schema if it is one of SCHEMAS."""
    reader = spark.read.schema(SCHEMAS[table]) if table in SCHEMAS else spark.read
    return reader.parquet(path)


def read_source(spark: SparkSession, kind: str, path: str, **options: str) -> DataFrame:
    """Rows to embed from a source: ``text`` (a column text with a row for each line, or each file with wholetext), ``parquet``, ``json``, ``csv``, or ``jdbc`` with the database's URL as the path: a ``query`` or a ``dbtable``, and with a ``key`` the table in parts (``read_database``)."""
    if kind == "text":
        return spark.read.options(**options).text(path).withColumnRenamed("value", "text")
    if kind in ("parquet", "json", "csv"):
        return spark.read.format(kind).options(**options).load(path)
    if kind == "jdbc" and "key" in options:
        return read_database(spark, path, options.pop("dbtable"), options.pop("key"), **options)
    if kind == "jdbc":
        return spark.read.format("jdbc").options(url=path, **options).load()
    raise ValueError(f"unknown source {kind!r}; known: text, parquet, json, csv, jdbc")


def read_database(spark: SparkSession, url: str, table: str, key: str, *, rows: int = 1_000_000, most: int = 1000, **options: str) -> DataFrame:
    """A database table read in parts of about ``rows`` rows by ranges of a numeric key, at most ``most`` of them at once.

    One aggregate in the database has the bounds and the number of rows; the
    ranges are predicates, so the database sees them with the filters and
    columns that a query needs.  Rows without a key come with the first part.
    """
    reader = spark.read.format("jdbc").options(url=url, **options)
    bounds = reader.option("query", f"SELECT MIN({key}) AS least, MAX({key}) AS largest, COUNT(*) AS n FROM {table}").load().first()
    least, largest, n = (None if x is None else int(x) for x in bounds)
    parts = max(1, min(most, -(-n // rows), 1 if least is None else largest - least + 1))
    edges = [] if least is None else [least + (largest - least + 1) * k // parts for k in range(1, parts)]
    ranges = [" AND ".join(([f"{key} >= {a}"] if a is not None else []) + ([f"{key} < {b}"] if b is not None else [])) for a, b in zip([None, *edges], [*edges, None], strict=True)]
    ranges[0] = f"({ranges[0]}) OR {key} IS NULL" if ranges[0] else "1 = 1"
    return spark.read.jdbc(url, table, predicates=ranges, properties=options)


def micros(column: str) -> Column:
    """A time as microseconds since 1970; one without zone is taken as UTC, whatever the session's zone."""
    c = F.col(column)
    plain = c.cast("timestamp_ntz") - F.lit("1970-01-01 00:00:00").cast("timestamp_ntz")
    return F.when(F.typeof(c) == "timestamp_ntz", (plain.cast("decimal(20,6)") * 1_000_000).cast("bigint")).otherwise(F.unix_micros(c.cast("timestamp")))


def utc(column: str) -> Column:
    """A time as a timestamp, which watermarks need; one without zone is taken as UTC, whatever the session's zone."""
    c = F.col(column)
    return F.when(F.typeof(c) == "timestamp_ntz", F.timestamp_micros(micros(column))).otherwise(c.cast("timestamp"))


def append(df: DataFrame, path: str) -> None:
    """Insert rows."""
    df.write.mode("append").parquet(path)


def replace(df: DataFrame, path: str) -> None:
    """Write a changed table to a new path; a path that exists is an error, since its readers may still be running."""
    df.write.mode("errorifexists").parquet(path)


def with_defaults(rows: DataFrame, table: str, as_of: Column, **defaults: Column) -> DataFrame:
    """Rows with all columns of a declared table: given defaults where a value is missing, a new id, and the times of now."""
    schema = SCHEMAS[table]
    times = {c: as_of for c in ("created_at", "updated_at", "last_activity") if c in schema.names}
    filled = {"id": F.expr("uuid()"), **times, **defaults}
    have = lambda c: F.col(c) if c in rows.columns else F.lit(None)
    return rows.select(*((F.coalesce(have(f.name), filled[f.name]) if f.name in filled else have(f.name)).cast(f.dataType).alias(f.name) for f in schema))


def insert_with_children(parent: DataFrame, path: str, children: list[tuple[DataFrame, str]]) -> None:
    """Append a parent table's rows and then those of its children, so that no reader sees a child without its parent."""
    append(parent, path)
    for rows, at in children:
        append(rows, at)


def insert_missing(table: DataFrame, rows: DataFrame, key: str) -> DataFrame:
    """Rows whose key isn't in the table yet: what to append."""
    return rows.join(table.select(key), key, "left_anti")


def audit(changes: DataFrame, action: str, entity_type: str, as_of: Column, *, id_col: str = "id", old: Column | None = None, new: Column | None = None, user: str | None = None) -> DataFrame:
    """A log row for each changed row; its id follows from what happened, so writing twice can be noticed."""
    text = lambda c: F.lit(None).cast("string") if c is None else F.to_json(c)
    row = changes.select(F.lit(action).alias("action"), F.lit(entity_type).alias("entity_type"), F.col(id_col).cast("string").alias("entity_id"), text(old).alias("old_data"), text(new).alias("new_data"), F.lit(user).cast("string").alias("user_id"), as_of.alias("created_at"))
    return row.select(F.sha2(F.concat_ws("|", "action", "entity_type", "entity_id", F.col("created_at").cast("string")), 256).alias("id"), *row.columns)


def scratch(spark: SparkSession, name: str) -> str:
    """A new path in the folder that all executors share; a local master may go without and gets a temporary one."""
    base = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not base:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        base = "file://" + tempfile.mkdtemp(prefix="tessella-")
    return f"{base.rstrip('/')}/{name}-{uuid.uuid4().hex}"


def checkpointed(df: DataFrame) -> DataFrame:
    """Cut lineage through a table in the shared folder."""
    path = scratch(df.sparkSession, "step")
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)
