"""Field types: how a type reads a query's value, its index terms, and its predicates. New ones are added with ``register``."""

from __future__ import annotations

import datetime as dt
from collections.abc import Callable
from dataclasses import dataclass, field

from pyspark.sql import Column
from pyspark.sql import functions as F

from ..errors import QueryExecutionError
from . import text, times

INT_MIN, INT_MAX = -(2**63), 2**63 - 1


@dataclass(frozen=True)
class Ref:
    """A physical column of an index, with its type, and its tokens where the index stores them."""

    column: str
    kind: str = "string"
    tokens: str | None = None

    @property
    def col(self) -> Column:
        return F.col(self.column)


@dataclass(frozen=True)
class Predicate:
    """A compiled leaf. ``cost`` orders conjuncts: cheap ones come first, as Catalyst keeps their order."""

    column: Column
    cost: int


@dataclass
class FieldType:
    name: str
    default: str | None
    storage: str
    terms: Callable[[Ref], Column]
    functions: dict[str, Callable[[Ref, str], Predicate | None]] = field(default_factory=dict)

    def predicate(self, ref: Ref, func: str | None, value: str) -> Predicate | None:
        """The named function, or the type's default one. None: the leaf vanishes (a text without tokens)."""
        name = func or self.default
        if name is None:
            raise QueryExecutionError(f"type {self.name} has no default function")
        if name not in self.functions:
            raise QueryExecutionError(f"type {self.name} has no function {name!r}")
        return self.functions[name](ref, value)


TYPES: dict[str, FieldType] = {}


def register(t: FieldType) -> FieldType:
    TYPES[t.name] = t
    return t


def _literal_is(ref: Ref, value: str) -> Predicate:
    return Predicate(ref.col == F.lit(value), 2)


def _text_in(ref: Ref, value: str) -> Predicate | None:
    terms = text.tokenize(value)
    toks = F.col(ref.tokens) if ref.tokens else None
    if not terms:
        return None
    if len(terms) == 1:
        return Predicate(text.has_term(ref.col, terms[0], toks), 5)
    return Predicate(text.has_phrase(ref.col, terms, toks), 6)


def parse_int(value: str) -> int:
    """Decimal, 0x hex, or octal with a leading 0."""
    v = value.strip()
    sign, digits = (-1, v[1:]) if v[:1] == "-" else (1, v)
    try:
        if digits.lower().startswith("0x"):
            n = int(digits, 16)
        elif digits.startswith("0") and len(digits) > 1:
            n = int(digits, 8)
        else:
            n = int(digits, 10)
    except ValueError:
        raise QueryExecutionError(f"{value!r} is not an integer") from None
    n *= sign
    if not INT_MIN <= n <= INT_MAX:
        raise QueryExecutionError(f"{value} is beyond 64 bits")
    return n


def parse_datetime(value: str) -> dt.datetime:
    try:
        return dt.datetime.strptime(value.strip(), "%Y/%m/%dT%H:%M:%S")
    except ValueError:
        raise QueryExecutionError(f"{value!r} is not a date like 2012/01/31T12:00:00") from None


def _compare(op: Callable[[Column, Column], Column]):
    return lambda ref, value: Predicate(op(ref.col, F.lit(parse_int(value))), 1)


def _datetime_is(ref: Ref, value: str) -> Predicate:
    at = parse_datetime(value)
    return Predicate((ref.col >= times.literal(at, ref.kind)) & (ref.col < times.literal(at + dt.timedelta(seconds=1), ref.kind)), 1)


register(FieldType("literal", "is", "string", lambda r: F.array(r.col), {"is": _literal_is}))
register(FieldType("text", "in", "string", lambda r: F.col(r.tokens) if r.tokens else text.tokens(r.col), {"in": _text_in}))
register(
    FieldType(
        "int", "is", "bigint", lambda r: F.array(r.col.cast("string")),
        {"is": _compare(lambda a, b: a == b), "gt": _compare(lambda a, b: a > b), "ge": _compare(lambda a, b: a >= b), "lt": _compare(lambda a, b: a < b), "le": _compare(lambda a, b: a <= b)},
    )
)
register(FieldType("datetime", None, "timestamp_ntz", lambda r: F.array(times.seconds(r.col, r.kind).cast("string")), {"is": _datetime_is}))
