"""Filters on results that are already there: by a field's value, or any field's (``*``), stacked."""

from __future__ import annotations

import re
from collections.abc import Callable
from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def _over(field: str, test: Callable[[Column], Column], fields: Column) -> Column:
    """Whether the field, or with ``*`` any field, passes. An absent one doesn't."""
    found = F.exists(F.map_values(fields), test) if field == "*" else test(fields[field])
    return F.coalesce(found, F.lit(False))


def _fields() -> Column:
    return F.col("fields")


def equals(field: str, value: str, fields: Column | None = None) -> Column:
    return _over(field, lambda v: v == value, _fields() if fields is None else fields)


def matches(field: str, pattern: str, fields: Column | None = None) -> Column:
    """A regular expression (Java's) found anywhere in the value."""
    return _over(field, lambda v: v.rlike(pattern), _fields() if fields is None else fields)


def contains(field: str, part: str, fields: Column | None = None) -> Column:
    return _over(field, lambda v: v.contains(part), _fields() if fields is None else fields)


def _number(value: str) -> tuple[str, float | int]:
    """Fractions are compared as double, whole numbers as bigint."""
    return ("double", float(value)) if "." in value else ("bigint", int(value))


def _castable(v: Column, kind: str) -> Column:
    """The number a value stands for; a value with a fraction is no whole number."""
    good = v.rlike(r"^\s*[+-]?\d+\s*$") if kind == "bigint" else v.rlike(r"^\s*[+-]?(\d+\.?\d*|\.\d+)([eE][+-]?\d+)?\s*$")
    return F.when(good, F.trim(v).try_cast(kind))


def greater(field: str, value: str, fields: Column | None = None) -> Column:
    kind, n = _number(value)
    return _over(field, lambda v: _castable(v, kind) > F.lit(n), _fields() if fields is None else fields)


def less(field: str, value: str, fields: Column | None = None) -> Column:
    kind, n = _number(value)
    return _over(field, lambda v: _castable(v, kind) < F.lit(n), _fields() if fields is None else fields)


KINDS = {"is": equals, "matches": matches, "contains": contains, "gt": greater, "lt": less}


@dataclass(frozen=True)
class Stack:
    """Filters that must all pass; pushing and popping give a new stack."""

    filters: tuple[tuple[str, str, str], ...] = ()

    def push(self, field: str, kind: str, value: str) -> Stack:
        if kind not in KINDS:
            raise ValueError(f"no filter {kind!r}")
        if kind in ("gt", "lt"):
            _number(value)
        elif kind == "matches":
            re.compile(value)
        return Stack((*self.filters, (field, kind, value)))

    def pop(self, n: int = 1) -> Stack:
        return Stack(self.filters[: max(0, len(self.filters) - n)])

    def condition(self, fields: Column | None = None) -> Column:
        return reduce(lambda a, b: a & b, (KINDS[k](f, v, fields) for f, k, v in self.filters), F.lit(True))

    def apply(self, rows: DataFrame) -> DataFrame:
        return rows.filter(self.condition())


def find(rows: DataFrame, pattern: str) -> DataFrame:
    """Rows with ``found``: whether the pattern is in the default value or in a field. Jumping forth and back (``/`` and ``?``) is
    taking the next found row beyond an id, in either order."""
    hit = F.coalesce(F.col("default_value").rlike(pattern), F.lit(False)) | matches("*", pattern)
    return rows.withColumn("found", hit)
