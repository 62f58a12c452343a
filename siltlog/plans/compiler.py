"""From a parsed query to one Column for each index."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

from ..functions.fieldtypes import Predicate
from .ast import All, And, Node, Not, Or, Term
from .catalog import Index


def _and(parts: list[Predicate]) -> Predicate:
    parts = sorted(parts, key=lambda p: p.cost)
    return Predicate(reduce(lambda a, b: a & b, (p.column for p in parts)), max(p.cost for p in parts))


def _or(parts: list[Predicate]) -> Predicate:
    parts = sorted(parts, key=lambda p: p.cost)
    return Predicate(reduce(lambda a, b: a | b, (p.column for p in parts)), max(p.cost for p in parts))


def _not(p: Predicate) -> Predicate:
    """The complement: an absent field doesn't match, so its negation does. Elsewhere null is as good as false, and plain comparisons
    reach the scan."""
    return Predicate(~F.coalesce(p.column, F.lit(False)), p.cost)


def _flat(node: And | Or) -> list[Node]:
    """Children, with those of children of the same kind."""
    out: list[Node] = []
    for c in node.children:
        out += _flat(c) if type(c) is type(node) else [c]
    return out


def resolve(node: Node, index: Index, compat: bool = False) -> Predicate | None:
    """None: nothing is left of the query for this index, so it has no result.

    Leaves whose field the index lacks vanish: a conjunction or disjunction is that of its other parts. NOT is the
    complement: it matches events without the field. With ``compat``, negations that stand directly in a
    conjunction or disjunction are taken from its other parts instead: ``a OR NOT b`` is ``a AND NOT b``, and without other
    parts there is no result."""
    if isinstance(node, All):
        return Predicate(F.lit(True), 0)
    if isinstance(node, Term):
        return index.term(node)
    if isinstance(node, Not):
        p = resolve(node.child, index, compat)
        return p if p is None else _not(p)
    join = _and if isinstance(node, And) else _or
    if not compat:
        parts = [p for c in _flat(node) if (p := resolve(c, index, compat)) is not None]
        return join(parts) if parts else None
    plain, excluded = [], []
    for c in node.children:
        if isinstance(c, Not):
            excluded.append(c.child)
        else:
            plain += list(c.children) if type(c) is type(node) else [c]
    parts = [p for c in plain if (p := resolve(c, index, compat)) is not None]
    if not parts:
        return None
    out = join(parts)
    gone = [p for c in excluded if (p := resolve(c, index, compat)) is not None]
    return _and([out, _not(_or(gone))]) if gone else out


def compile_query(node: Node, index: Index, compat: bool = False) -> Column | None:
    """The predicate for an index; a lone NOT of something that vanished matches everything."""
    p = resolve(node, index, compat)
    if p is None and isinstance(node, Not):
        return F.lit(True)
    return None if p is None else p.column
