"""Registry of components by kind and name: filters, sources, sinks and protocols. Field types have their own (functions.fieldtypes)."""

from __future__ import annotations

from collections.abc import Callable
from importlib.metadata import entry_points

KINDS = ("filter", "source", "sink", "protocol")
_REGISTRY: dict[tuple[str, str], Callable] = {}


def register(kind: str, name: str) -> Callable[[Callable], Callable]:
    """Decorator: ``@register("filter", "regex")`` on a factory that takes a section of settings as keywords."""
    if kind not in KINDS:
        raise ValueError(f"unknown kind of component {kind!r}")

    def add(factory: Callable) -> Callable:
        _REGISTRY[kind, name] = factory
        return factory

    return add


def get(kind: str, name: str) -> Callable:
    if (kind, name) not in _REGISTRY:
        raise KeyError(f"no {kind} named {name!r}")
    return _REGISTRY[kind, name]


def make(kind: str, name: str, **settings):
    return get(kind, name)(**settings)


def names(kind: str) -> list[str]:
    return sorted(n for k, n in _REGISTRY if k == kind)


def load_installed(group: str = "siltlog.plugins") -> list[str]:
    """Import the modules that installed packages name in this entry-point group; importing registers their components."""
    found = []
    for point in entry_points(group=group):
        point.load()
        found.append(point.name)
    return found
