"""Parents and children: semi and anti joins, nests, the newest children, delete guards and cascades."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..sources.tables import CHILDREN


def with_children(parents: DataFrame, children: DataFrame, key: str, fk: str) -> DataFrame:
    """Parents that have a child."""
    return parents.join(children.select(F.col(fk).alias(key)), key, "left_semi")


def orphans(children: DataFrame, parents: DataFrame, fk: str, key: str) -> DataFrame:
    """Children whose parent is missing."""
    return children.join(parents.select(F.col(key).alias(fk)), fk, "left_anti")


def nest(parents: DataFrame, children: DataFrame, key: str, fk: str, columns: list[str], name: str, *, order: list[Column] | None = None, limit: int | None = None) -> DataFrame:
    """Parents with an array of their children's columns; empty, not null, without children.

    The array is sorted by its columns, or holds the first ``limit`` children in the ``order``.
    Children are grouped before the join, so several nests of one parent don't multiply rows.
    """
    if limit is None:
        member = F.array_sort(F.collect_list(F.struct(*columns)))
    else:
        children = newest(children, fk, order or [F.col(c) for c in columns], limit)
        member = F.transform(F.array_sort(F.collect_list(F.struct("rn", *columns))), lambda x: F.struct(*(x[c].alias(c) for c in columns)))
    grouped = children.groupBy(F.col(fk).alias(key)).agg(member.alias(name))
    joined = parents.join(grouped, key, "left")
    return joined.withColumn(name, F.coalesce(name, F.array().cast(joined.schema[name].dataType)))


def newest(children: DataFrame, fk: str, order: list[Column], n: int) -> DataFrame:
    """The first n children of each parent in the order, with their number."""
    return children.withColumn("rn", F.row_number().over(Window.partitionBy(fk).orderBy(*order)).cast("long")).where(F.col("rn") <= n)


def delete_guard(agents: DataFrame, workflows: DataFrame, executions: DataFrame, sessions: DataFrame) -> DataFrame:
    """Per agent id: running_executions, active_sessions, can_delete and the reason if not."""
    running = executions.where(F.col("status").isin("RUNNING", "PENDING")).join(workflows.select(F.col("id").alias("workflow_id"), "agent_id"), "workflow_id")
    running = running.groupBy(F.col("agent_id").alias("id")).agg(F.count("*").alias("running_executions"))
    active = sessions.where(F.col("status") == "ACTIVE").groupBy(F.col("agent_id").alias("id")).agg(F.count("*").alias("active_sessions"))
    out = agents.select("id").join(running, "id", "left").join(active, "id", "left").fillna(0, ["running_executions", "active_sessions"])
    reason = F.when(F.col("running_executions") > 0, F.format_string("Agent has %d active workflow(s)", "running_executions")).when(F.col("active_sessions") > 0, F.format_string("Agent has %d active conversation(s)", "active_sessions"))
    return out.withColumn("reason", reason).withColumn("can_delete", F.col("reason").isNull())


def cascade(tables: dict[str, DataFrame], table: str, removed: DataFrame) -> dict[str, DataFrame]:
    """What stays of each table if the rows with ids ``removed`` (one column id) go, and their children with them."""
    out = {table: tables[table].join(removed, "id", "left_anti")}
    for child, fk in CHILDREN.get(table, []):
        if child in tables:
            gone = tables[child].join(removed.select(F.col("id").alias(fk)), fk, "left_semi").select("id")
            out |= cascade(tables, child, gone)
    return out


#: The JSON of a session's context, as far as it is searched.
CONTEXT = "user_preferences map<string,string>, conversation_summary string, key_entities array<string>, topics array<string>, sentiment string, language string, timezone string"


def context_values(sessions: DataFrame, context: str = "context") -> DataFrame:
    """kind (topic, entity, language), name and how many sessions' contexts have it; a context without a language is in en."""
    c = F.from_json(context, CONTEXT)
    pairs = lambda kind, names: F.transform(F.array_distinct(F.coalesce(names, F.array().cast("array<string>"))), lambda x: F.struct(F.lit(kind).alias("kind"), x.alias("name")))
    every = F.concat(pairs("topic", c["topics"]), pairs("entity", c["key_entities"]), pairs("language", F.array(F.coalesce(c["language"], F.lit("en")))))
    return sessions.select(F.explode(every).alias("x")).select("x.*").groupBy("kind", "name").agg(F.count("*").alias("sessions"))
