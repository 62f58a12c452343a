"""Access lists: ``[-]PERM::SUB;type=name,type=name``, tested in order; the first entry that covers a permission decides."""

from __future__ import annotations

from dataclasses import dataclass, field
from enum import Enum


class Action(Enum):
    ALLOW = "allow"
    DENY = "deny"
    PASS = "pass"


def _parts(name: str) -> tuple[str, ...]:
    out = tuple(p.upper() for p in name.split("::"))
    if not all(p.isalnum() for p in out):
        raise ValueError(f"{name!r} is not a permission")
    return out


@dataclass(frozen=True)
class Permission:
    """``objects``: by type the names it holds for, None for all; a type that isn't there is not restricted."""

    parts: tuple[str, ...]
    action: Action = Action.ALLOW
    objects: dict[str, tuple[str, ...] | None] = field(default_factory=dict)

    ALLOW, DENY, PASS = Action.ALLOW, Action.DENY, Action.PASS

    @classmethod
    def parse(cls, spec: str) -> Permission:
        action = Action.DENY if spec.startswith("-") else Action.ALLOW
        name, _, rest = spec.removeprefix("-").partition(";")
        objects: dict[str, tuple[str, ...] | None] = {}
        for item in filter(None, rest.split(",")):
            kind, _, obj = item.partition("=")
            held = objects.get(kind, ())
            objects[kind] = None if held is None or not obj else (*held, obj)
        return cls(_parts(name), action, objects)

    def covers(self, name: str, **objects: str) -> bool:
        """Whether this entry is a prefix of the permission, and holds for these objects."""
        if _parts(name)[: len(self.parts)] != self.parts:
            return False
        return all((allowed := self.objects.get(kind)) is None or obj in allowed for kind, obj in objects.items())


class ACL:
    def __init__(self, *entries: Permission | str):
        self.entries = [Permission.parse(e) if isinstance(e, str) else e for e in entries]

    def append(self, entry: Permission | str) -> None:
        self.entries.append(Permission.parse(entry) if isinstance(entry, str) else entry)

    def test(self, name: str, **objects: str) -> Action:
        """ALLOW or DENY by the first entry that covers it, else PASS, which callers take as no."""
        return next((e.action for e in self.entries if e.covers(name, **objects)), Action.PASS)
