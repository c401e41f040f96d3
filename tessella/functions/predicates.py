"""Filters as Columns: dictionaries of conditions, searches, JSON paths, validation."""

from __future__ import annotations

import re
from functools import reduce
from typing import Any

from pyspark.sql import Column
from pyspark.sql import functions as F

_COMPARE = {
    "eq": lambda c, v: c == v, "ne": lambda c, v: c != v, "gt": lambda c, v: c > v, "lt": lambda c, v: c < v,
    "gte": lambda c, v: c >= v, "lte": lambda c, v: c <= v, "in": lambda c, v: c.isin(v), "nin": lambda c, v: ~c.isin(v),
    "contains": lambda c, v: contains(c, v), "null": lambda c, v: c.isNull() if v else c.isNotNull(),
}


def compare(column: Column, operator: str, value: Any) -> Column:
    """One comparison; an unknown operator is an error."""
    if operator not in _COMPARE:
        raise ValueError(f"unknown operator {operator!r}; known: {', '.join(_COMPARE)}")
    return _COMPARE[operator](column, value)


def where(filters: dict[str, Any] | None) -> Column:
    """All conditions together: a scalar is equality, a list membership, a dict comparisons; none is always true."""
    parts = []
    for name, value in (filters or {}).items():
        c = F.col(name)
        if isinstance(value, dict):
            parts += [compare(c, op, v) for op, v in value.items()]
        else:
            parts.append(c.isin(list(value)) if isinstance(value, (list, tuple, set)) else c == value)
    return reduce(lambda a, b: a & b, parts, F.lit(True))


def contains(column: Column, text: str) -> Column:
    """Case-insensitive substring; % and _ stand for themselves."""
    return F.contains(F.lower(column), F.lower(F.lit(text)))


def search(text: str, *columns: str) -> Column:
    """The text in any of the columns."""
    return reduce(lambda a, b: a | b, (contains(F.col(c), text) for c in columns))


def json_value(column: str, path: str | list[str], kind: str = "string") -> Column:
    """A typed value of a JSON column at a key (dots are part of it) or a list of keys; a missing one or a bad value is null."""
    keys = [path] if isinstance(path, str) else path
    return F.get_json_object(F.col(column), "$" + "".join(f"['{k}']" for k in keys)).try_cast(kind)


def json_filter(column: str, field: str, operator: str, value: Any) -> Column:
    """A metadata filter with the value's own type."""
    one = value[0] if isinstance(value, (list, tuple)) and value else value
    kind = "boolean" if isinstance(one, bool) else "bigint" if isinstance(one, int) else "double" if isinstance(one, float) else "string"
    return compare(json_value(column, field, kind), operator, list(value) if isinstance(value, (tuple, set)) else value)


def json_present(column: str) -> Column:
    """Neither null nor the JSON literal null."""
    return F.col(column).isNotNull() & (F.trim(F.col(column)) != "null")


def glob(column: Column, pattern: str) -> Column:
    """Whole-string match where * stands for anything."""
    return column.rlike("(?s)^" + ".*".join(re.sub(r"([^\w])", r"\\\1", part, flags=re.ASCII) for part in pattern.split("*")) + r"\z")


def length_between(column: str, low: int, high: int) -> Column:
    return F.length(column).between(low, high)


def missing_scopes(required: Column, granted: Column) -> Column:
    """Scopes that are required and not granted; empty if all are."""
    return F.array_except(required, granted)


def ratio(part: Column, whole: Column, default: float = 0.0) -> Column:
    """part / whole, or the default where whole is 0 or null."""
    return F.coalesce(F.try_divide(part.cast("double"), whole), F.lit(default))


def millis_between(start: str, end: str) -> Column:
    return ((F.unix_micros(F.col(end).cast("timestamp")) - F.unix_micros(F.col(start).cast("timestamp"))) / 1000).cast("long")


#: The shape of a UUID.
UUID = "^[0-9a-fA-F]{8}(-[0-9a-fA-F]{4}){3}-[0-9a-fA-F]{12}$"


def is_uuid(column: Column) -> Column:
    return F.coalesce(column.rlike(UUID), F.lit(False))


def has_prefix(column: Column, prefixes: list[str]) -> Column:
    """Whether a text starts with one of the prefixes."""
    return reduce(lambda a, b: a | b, (F.startswith(column, F.lit(p)) for p in prefixes), F.lit(False))


def contains_any(column: Column, parts: list[str]) -> Column:
    """Whether a text contains one of the parts, whatever the case."""
    return F.exists(F.array(*map(F.lit, parts)), lambda p: F.contains(F.lower(column), F.lower(p)))


def violations(rules: dict[str, Column]) -> Column:
    """Names of the rules that a row breaks (false or null), in their order."""
    return F.filter(F.array(*(F.when(~F.coalesce(ok, F.lit(False)), F.lit(name)) for name, ok in rules.items())), lambda x: x.isNotNull())
