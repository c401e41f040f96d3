"""Retention and status changes as DataFrames; nothing is written here."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def archive_old(sessions: DataFrame, cutoff: Column, *, activity: str = "last_activity", status: str = "status") -> DataFrame:
    """Sessions with those last active before the cutoff (strictly) archived, and whether each was changed now."""
    old = (F.col(activity) < cutoff) & (F.col(status) != "ARCHIVED")
    old = F.coalesce(old, F.lit(False))
    return sessions.withColumn("changed", old).withColumn(status, F.when(F.col("changed"), "ARCHIVED").otherwise(F.col(status)))


def split_newest(rows: DataFrame, key: str, at: str, id_col: str, keep: int = 100) -> tuple[DataFrame, DataFrame]:
    """(what stays, what goes): the ``keep`` newest rows of each key by time and then id, and the others.

    The last row that stays is the cut of its key.  Each task passes on at most
    ``keep`` rows of a key to find it, and the others are compared with the cut
    where they are, so a key of any size isn't ranked in one task.  A null time
    is the newest; rows equal to the cut stay; rows without a key are one key.
    """
    place = F.struct(F.col(at).isNull().alias("none"), F.col(at).alias("at"), F.col(id_col).alias("id"))
    nth = F.row_number().over(Window.partitionBy("_key").orderBy(F.desc("_place")))
    cut = rows.select(F.col(key).alias("_key"), place.alias("_place")).withColumn("_nth", nth).where(F.col("_nth") <= keep).where(F.col("_nth") == keep)
    cut = cut.select(F.struct("_key").alias("_of"), F.col("_place").alias("_cut"))
    placed = rows.withColumn("_of", F.struct(F.col(key).alias("_key"))).join(cut, "_of", "left")
    gone = F.coalesce(place < F.col("_cut"), F.lit(False))
    return placed.where(~gone).select(*rows.columns), placed.where(gone).select(*rows.columns)


def delete_listed(rows: DataFrame, gone: DataFrame, ids: list[str]) -> DataFrame:
    """What stays after deleting the rows that a list names by their ids."""
    return rows.join(gone.select(*ids).distinct(), ids, "left_anti").select(*rows.columns)


def delete_where(rows: DataFrame, predicate: Column) -> tuple[DataFrame, DataFrame]:
    """(what stays, what goes); a null predicate keeps the row."""
    gone = F.coalesce(predicate, F.lit(False))
    return rows.where(~gone), rows.where(gone)


def set_where(rows: DataFrame, predicate: Column, values: dict[str, Column]) -> DataFrame:
    """The table with columns set where a predicate holds; the new values see the old ones."""
    hit = F.coalesce(predicate, F.lit(False))
    return rows.withColumns({c: F.when(hit, v).otherwise(F.col(c)) for c, v in values.items()})


def last_by_id(changes: DataFrame, columns: list[str], id_col: str = "id", order: str | None = None) -> DataFrame:
    """One row for each id: the one with the greatest ``order``, and among equals (or without an order) the greatest in its columns."""
    row = F.struct(*columns)
    by = row if order is None else F.struct(order, *columns)
    return changes.groupBy(id_col).agg(F.max_by(row, by).alias("_last")).select(id_col, *(F.col(f"_last.{c}").alias(c) for c in columns))


def _last_value(column: str, order: str | None) -> Column:
    """The value that is there with the greatest order, and among equals (or without an order) the greatest one."""
    by = F.struct(*(F.col(c) for c in (order, column) if c is not None))
    return F.max_by(column, F.when(F.col(column).isNotNull(), by)).alias(column)


def merged_by_id(changes: DataFrame, columns: list[str], id_col: str = "id", order: str | None = None) -> DataFrame:
    """One row for each id: of each column the last value that isn't null, as if the changes were made one after another."""
    return changes.groupBy(id_col).agg(*(_last_value(c, order) for c in columns))


def apply_changes(rows: DataFrame, changes: DataFrame, columns: list[str], id_col: str = "id", order: str | None = None) -> DataFrame:
    """The table with a DataFrame of changes by id; a null in a change keeps the old value.

    Several changes of one id are merged column by column in the ``order``, so each may name other columns and no row is repeated.
    """
    new = merged_by_id(changes, columns, id_col, order).select(F.col(id_col), *(F.col(c).alias(f"_new_{c}") for c in columns))
    joined = rows.join(new, id_col, "left")
    return joined.select(*(F.coalesce(f"_new_{c}", c).alias(c) if c in columns else c for c in rows.columns))


def complete_invocations(invocations: DataFrame, results: DataFrame, as_of: Column, order: str | None = None) -> DataFrame:
    """Invocations with results (id, result, status, duration): a missing status is 'completed', a missing duration the one before it; of several results of one id the last by ``order`` counts."""
    last, whole = last_by_id(results, ["result", "status", "duration"], order=order), merged_by_id(results, ["duration"], order=order)
    done = last.drop("duration").join(whole, "id")
    done = done.select("id", F.col("result").alias("_result"), F.coalesce("status", F.lit("completed")).alias("_status"), F.col("duration").alias("_duration"), F.lit(True).alias("_done"))
    joined = invocations.join(done, "id", "left")
    new = {"result": F.col("_result"), "status": F.col("_status"), "duration": F.coalesce("_duration", "duration"), "completed_at": as_of}
    return set_where(joined, F.col("_done"), new).select(*invocations.columns)


def touch(sessions: DataFrame, activity: DataFrame, *, id_col: str = "id", at: str = "at", column: str = "last_activity") -> DataFrame:
    """Sessions with their last activity moved up to the greatest time of theirs; it never moves back."""
    latest = activity.groupBy(F.col(id_col)).agg(F.max(at).alias("_at"))
    return sessions.join(latest, id_col, "left").withColumn(column, F.greatest(column, "_at")).select(*sessions.columns)


def days_before(as_of: Column, days: int) -> Column:
    """The time so many days earlier."""
    return as_of - F.make_dt_interval(F.lit(days))


def replace_json(rows: DataFrame, changes: DataFrame, column: str, id_col: str = "id", order: str | None = None) -> DataFrame:
    """The table with a JSON column replaced, by id, by the other columns of the changes as one JSON object."""
    values = [c for c in changes.columns if c not in (id_col, order)]
    new = last_by_id(changes, values, id_col, order).select(id_col, F.to_json(F.struct(*values), {"ignoreNullFields": "false"}).alias(column))
    return apply_changes(rows, new, [column], id_col)
