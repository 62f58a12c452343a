"""INI settings: typed getters, and sections by prefix. Values given on a command line come before those of the file."""

from __future__ import annotations

import configparser


class Section:
    def __init__(self, name: str, values: dict[str, str]):
        self.name, self.values = name, values

    def text(self, key: str, default: str | None = None) -> str | None:
        return self.values.get(key.lower(), default)

    def integer(self, key: str, default: int | None = None) -> int | None:
        v = self.values.get(key.lower())
        return default if v is None else int(v)

    def number(self, key: str, default: float | None = None) -> float | None:
        v = self.values.get(key.lower())
        return default if v is None else float(v)

    def flag(self, key: str, default: bool = False) -> bool:
        v = self.values.get(key.lower())
        if v is None:
            return default
        if v.lower() not in configparser.ConfigParser.BOOLEAN_STATES:
            raise ValueError(f"[{self.name}] {key}: {v!r} is neither true nor false")
        return configparser.ConfigParser.BOOLEAN_STATES[v.lower()]

    def items(self, key: str, separator: str = ",") -> list[str]:
        return [x.strip() for x in (self.text(key) or "").split(separator) if x.strip()]


class Settings:
    def __init__(self, text: str = "", overrides: dict[str, dict[str, str]] | None = None):
        parser = configparser.ConfigParser(interpolation=None, delimiters=("=",))
        parser.read_string(text)
        parser.read_dict(overrides or {})
        self.sections = {n: Section(n, dict(parser[n])) for n in parser.sections()}

    @classmethod
    def read(cls, path: str, overrides: dict[str, dict[str, str]] | None = None) -> Settings:
        with open(path, encoding="utf-8") as f:
            return cls(f.read(), overrides)

    def section(self, name: str) -> Section:
        return self.sections.get(name, Section(name, {}))

    def like(self, kind: str) -> dict[str, Section]:
        """Sections ``[kind:name]`` by name."""
        return {n.partition(":")[2]: s for n, s in self.sections.items() if n.partition(":")[0] == kind}
