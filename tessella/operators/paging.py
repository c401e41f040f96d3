"""Sorted pages, top-k and point lookups; every order ends in the id, so pages are stable."""

from __future__ import annotations

from dataclasses import dataclass
from typing import Any

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.predicates import where
from ..sources.tables import checkpointed


@dataclass(frozen=True)
class Page:
    """A page from 1, of 1 to 100 rows."""

    page: int = 1
    size: int = 20

    def __post_init__(self) -> None:
        if self.page < 1 or not 1 <= self.size <= 100:
            raise ValueError("page >= 1 and 1 <= size <= 100")


def order_by(order: dict[str, str] | None = None, id_col: str = "id") -> list[Column]:
    """Sort columns, by default the newest first; nulls are where PostgreSQL has them: last ascending, first descending."""
    order = order or {"created_at": "desc"}
    columns = [F.col(c).desc_nulls_first() if d.lower() == "desc" else F.col(c).asc_nulls_last() for c, d in order.items()]
    return columns if id_col in order else [*columns, F.col(id_col).asc()]


def page(df: DataFrame, at: Page | None, filters: dict[str, Any] | None = None, order: dict[str, str] | None = None, id_col: str = "id") -> DataFrame:
    """The rows of a page; without a page, all rows in order."""
    found = df.where(where(filters)).orderBy(*order_by(order, id_col))
    return found if at is None else found.offset((at.page - 1) * at.size).limit(at.size)


def page_index(df: DataFrame, filters: dict[str, Any] | None = None, order: dict[str, str] | None = None, id_col: str = "id") -> DataFrame:
    """The place (from 0) of every id in an order, as a table for any number of deep pages; ids are taken to be different.

    Rows are dealt by ranges of the order, and a row's place is its place in its
    range after the rows of the ranges before, so no task sorts more than a
    range.  Files hold consecutive places, so a page reads few of them.
    """
    columns = order_by(order, id_col)
    names = dict.fromkeys([*(order or {"created_at": ""}), id_col])
    dealt = df.where(where(filters)).select(*names).repartitionByRange(*columns).sortWithinPartitions(*columns)
    rows = checkpointed(dealt.select(F.col(id_col).alias("_id"), F.monotonically_increasing_id().alias("_at")))
    part = F.shiftright("_at", 33)
    counts = rows.groupBy(part.alias("_part")).agg(F.count("*").alias("_n"), F.min("_at").alias("_first"))
    counts = counts.select("_part", (F.sum("_n").over(Window.orderBy("_part")) - F.col("_n") - F.col("_first")).alias("_shift"))
    return rows.withColumn("_part", part).join(counts, "_part").select("_id", (F.col("_at") + F.col("_shift")).alias("_place"))


def deep_page(df: DataFrame, index: DataFrame, at: Page, id_col: str = "id") -> DataFrame:
    """The rows of a page, however deep, in their order: the ids at its places, at most a page of them, meet the table."""
    first = (at.page - 1) * at.size
    ids = index.where(F.col("_place").between(first, first + at.size - 1)).limit(at.size)
    return df.join(F.broadcast(ids), F.col(id_col) == F.col("_id")).orderBy("_place").drop("_id", "_place")


def envelope(df: DataFrame, at: Page, filters: dict[str, Any] | None = None) -> DataFrame:
    """One row: page, size, total, total_pages, has_next, has_prev."""
    total = df.where(where(filters)).agg(F.count("*").alias("total"))
    pages = F.ceil(F.col("total") / at.size).cast("long")
    out = total.select(F.lit(at.page).cast("long").alias("page"), F.lit(at.size).cast("long").alias("size"), "total", pages.alias("total_pages"))
    return out.withColumns({"has_next": F.col("page") < F.col("total_pages"), "has_prev": F.col("page") > 1})


def by_id(df: DataFrame, value: Any, id_col: str = "id") -> DataFrame:
    """At most one row; the equality reaches the Parquet scan."""
    return df.where(F.col(id_col) == value).limit(1)


def exists(df: DataFrame, value: Any, id_col: str = "id") -> DataFrame:
    """One row, one column: exists. Only the id is read."""
    return df.where(F.col(id_col) == value).select(id_col).limit(1).agg((F.count("*") > 0).alias("exists"))


def first(df: DataFrame, filters: dict[str, Any], id_col: str = "id") -> DataFrame:
    """The first match by id."""
    return df.where(where(filters)).orderBy(id_col).limit(1)
