"""Workflow steps as a graph: edges, levels, cycles, steps that are ready."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.predicates import ratio
from ..sources.tables import checkpointed


def edges(steps: DataFrame) -> DataFrame:
    """workflow_id, step_id, depends_on, from an array column ``dependencies``."""
    return steps.select("workflow_id", "step_id", F.explode("dependencies").alias("depends_on"))


def levels(steps: DataFrame) -> DataFrame:
    """workflow_id, step_id and level: 0 without dependencies, else one more than the greatest of theirs.

    All workflows advance a level in each round, so the rounds are the depth of
    the deepest.  A table has how many dependencies each step has; the links
    that leave a round's steps are counted off, so over all rounds each link is
    joined once, and links that were counted leave the table.  A step is of the
    next level when its last dependency is counted.  Steps in or behind a cycle,
    or behind a step that isn't there, have a null level.
    """
    key = ["workflow_id", "step_id"]
    every = checkpointed(steps.select(*key).distinct())
    links = checkpointed(edges(steps).distinct())
    degrees = checkpointed(links.groupBy(*key).agg(F.count("*").alias("wanted")))
    fresh = checkpointed(every.join(degrees, key, "left_anti").withColumn("level", F.lit(0).cast("long")))
    waiting, done, level = None, [], 0
    while not fresh.isEmpty():
        done.append(fresh)
        counted = links.join(fresh.select("workflow_id", F.col("step_id").alias("depends_on")), ["workflow_id", "depends_on"], "left_semi").groupBy(*key).agg(F.count("*").alias("met"))
        links = checkpointed(links.join(fresh.select("workflow_id", F.col("step_id").alias("depends_on")), ["workflow_id", "depends_on"], "left_anti"))
        met = counted if waiting is None else counted.unionByName(waiting).groupBy(*key).agg(F.sum("met").alias("met"))
        met, level = checkpointed(met.join(degrees, key)), level + 1
        fresh = checkpointed(met.where("met = wanted").select(*key, F.lit(level).cast("long").alias("level")))
        waiting = met.where("met < wanted").select(*key, "met")
    found = reduce(DataFrame.unionByName, done) if done else every.where("false").withColumn("level", F.lit(0).cast("long"))
    return every.join(found, key, "left")


def ready_steps(steps: DataFrame, results: DataFrame) -> DataFrame:
    """Steps not completed whose dependencies all are; results: workflow_id, step_id, status."""
    done = results.where(F.col("status") == "COMPLETED").select("workflow_id", "step_id").distinct()
    open_ = steps.join(done, ["workflow_id", "step_id"], "left_anti")
    waiting = edges(open_).join(done.withColumnRenamed("step_id", "depends_on"), ["workflow_id", "depends_on"], "left_anti")
    return open_.join(waiting, ["workflow_id", "step_id"], "left_anti")


def retryable(results: DataFrame, attempts: int = 3) -> DataFrame:
    """Failed steps with attempts left."""
    return results.where((F.col("status") == "FAILED") & (F.col("attempts") < attempts))


def memory_window(messages: DataFrame, *, max_history: int = 100, context_window: int = 4000, key: str = "session_id", order: str = "created_at", id_col: str = "id", text_col: str = "content") -> DataFrame:
    """The newest messages of each session, at most ``max_history`` and at most ``context_window`` characters in all; a null text has none."""
    newest = Window.partitionBy(key).orderBy(F.col(order).desc(), F.col(id_col).desc())
    rows = messages.withColumn("_rn", F.row_number().over(newest)).where(F.col("_rn") <= max_history)
    rows = rows.withColumn("_chars", F.sum(F.coalesce(F.length(text_col), F.lit(0))).over(newest.rowsBetween(Window.unboundedPreceding, 0)))
    return rows.where(F.col("_chars") <= context_window).drop("_rn", "_chars")


def with_fallback(steps: DataFrame, results: DataFrame, attempts: int = 3) -> DataFrame:
    """workflow_id, step_id, next: 'retry' for a failed step with attempts left, then its fallback step, or 'give up' without one."""
    failed = results.where(F.col("status") == "FAILED").join(steps.select("workflow_id", "step_id", "fallback"), ["workflow_id", "step_id"])
    following = F.when(F.col("attempts") < attempts, "retry").otherwise(F.coalesce(F.col("fallback").cast("string"), F.lit("give up")))
    return failed.select("workflow_id", "step_id", following.alias("next"))


def run_progress(results: DataFrame) -> DataFrame:
    """workflow_id, total, completed, percent and duration_ms (of the completed steps) from results with start and end in milliseconds."""
    done = F.col("status") == "COMPLETED"
    out = results.groupBy("workflow_id").agg(F.count("*").alias("total"), F.count_if(done).alias("completed"), F.coalesce(F.sum(F.when(done, F.col("end_ms") - F.col("start_ms"))), F.lit(0)).cast("long").alias("duration_ms"))
    return out.withColumn("percent", ratio(F.col("completed") * 100, F.col("total")))


def assign_roles(steps: DataFrame, mapping: DataFrame) -> DataFrame:
    """Steps with the agent that plays their role; null where no agent does."""
    return steps.join(mapping.select("role", "agent_id").distinct(), "role", "left")
