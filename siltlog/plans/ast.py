"""What a query is parsed to."""

from __future__ import annotations

from dataclasses import dataclass


class Node:
    pass


@dataclass(frozen=True)
class All(Node):
    pass


@dataclass(frozen=True)
class Term(Node):
    field: str | None
    type: str | None
    func: str | None
    value: str


@dataclass(frozen=True)
class Not(Node):
    child: Node


@dataclass(frozen=True)
class And(Node):
    children: tuple[Node, ...]


@dataclass(frozen=True)
class Or(Node):
    children: tuple[Node, ...]
