"""Indexes: named DataFrames of events with typed fields."""

from __future__ import annotations

import re
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..errors import BadRequest, QueryExecutionError
from ..functions import times
from ..functions.fieldtypes import TYPES, Predicate, Ref
from .ast import Term

REQUIRED = {("input", "literal"): "input", ("hostname", "literal"): "hostname", ("message", "text"): "message"}
DEFAULT_FIELD = "message"


def check_name(name: str) -> str:
    """Field names have two characters or more, begin with a letter or underscore, and not with two underscores."""
    if len(name) < 2 or name.startswith("__") or not re.match(r"[A-Za-z_]", name):
        raise ValueError(f"{name!r} is not a field name")
    return name


@dataclass
class Index:
    """``df`` has the columns ts (timestamp or timestamp_ntz in UTC), evid_offset (bigint), input, hostname, message, and one for each field.

    ``fields`` maps (name, type) to a column; one name may have several types. ``tokens`` names array columns with the
    tokens of text columns, where they are stored."""

    name: str
    df: DataFrame
    fields: dict[tuple[str, str], str] = field(default_factory=dict)
    tokens: dict[str, str] = field(default_factory=dict)
    ts: str = "ts"
    offset: str = "evid_offset"

    def __post_init__(self):
        self.fields = REQUIRED | self.fields
        for name, kind in self.fields:
            check_name(name)
            if kind not in TYPES:
                raise ValueError(f"unknown field type {kind!r}")
        self.kinds = dict(self.df.dtypes)

    @property
    def ts_kind(self) -> str:
        return self.kinds[self.ts]

    def ts_sec(self) -> Column:
        return times.seconds(F.col(self.ts), self.ts_kind).alias("ts_sec")

    def ref(self, column: str) -> Ref:
        return Ref(column, self.kinds[column], self.tokens.get(column))

    def types_of(self, name: str) -> list[str]:
        return sorted(t for n, t in self.fields if n == name)

    def term(self, t: Term) -> Predicate | None:
        """A leaf's predicate, null where the field is absent; None if the index lacks the field or nothing of the value is left. A name with
        several types is tried as each of them."""
        name, kind = t.field, t.type
        if name is None:
            name, kind = DEFAULT_FIELD, "text"
        kinds = [kind] if kind else self.types_of(name)
        kinds = [k for k in kinds if (name, k) in self.fields]
        found, errors = [], []
        for k in kinds:
            try:
                p = TYPES[k].predicate(self.ref(self.fields[name, k]), t.func, t.value)
            except QueryExecutionError as e:
                errors.append(e)
                continue
            if p is not None:
                found.append(p)
        if errors and not found:
            raise errors[0]
        if not found:
            return None
        out = found[0]
        for p in found[1:]:
            out = Predicate(out.column | p.column, max(out.cost, p.cost))
        return out

    def value_columns(self) -> dict[str, Column]:
        """Each field but the default one as a string; of several types, the first that is present."""
        names: dict[str, list[str]] = {}
        for (name, _), column in sorted(self.fields.items()):
            if name != DEFAULT_FIELD and column not in names.setdefault(name, []):
                names[name].append(column)
        return {n: F.coalesce(*(F.col(c).cast("string") for c in cs)) for n, cs in names.items()}

    def field_map(self, wanted: list[str] | None = None) -> Column:
        """Present fields but the default one, by name; fields that are not wanted aren't read."""
        pairs = {n: c for n, c in self.value_columns().items() if wanted is None or n in wanted}
        if not pairs:
            return F.expr("map()").cast("map<string,string>")
        m = F.create_map(*(x for n, c in pairs.items() for x in (F.lit(n), c)))
        return F.map_filter(m, lambda _, v: v.isNotNull())


class Catalog:
    """The indexes that can be searched."""

    def __init__(self, *indexes: Index):
        self.indexes = {i.name: i for i in indexes}

    def add(self, index: Index) -> Index:
        self.indexes[index.name] = index
        return index

    def names(self) -> list[str]:
        return sorted(self.indexes)

    def select(self, names: list[str] | None) -> list[Index]:
        """The named indexes, or all; an unknown name is an error."""
        wanted = self.names() if names is None else list(dict.fromkeys(names))
        unknown = [n for n in wanted if n not in self.indexes]
        if unknown:
            raise BadRequest(f"unknown index {unknown[0]!r}")
        return [self.indexes[n] for n in wanted]

    def field_rows(self) -> list[tuple[str, str, str, str]]:
        return sorted((i.name, n, t, c) for i in self.indexes.values() for (n, t), c in i.fields.items())
