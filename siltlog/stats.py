"""Named counters of the server: shown singly or with all below a name, and kept in a file if persistent."""

from __future__ import annotations

import json
import threading
import time
from contextlib import contextmanager
from pathlib import Path


class Stats:
    def __init__(self, path: str | None = None):
        self.path, self.values, self.lasting, self._lock = path, {}, set(), threading.Lock()
        if path and Path(path).exists():
            self.values = json.loads(Path(path).read_text())
            self.lasting = set(self.values)

    def get(self, name: str, default: int | float = 0) -> int | float:
        return self.values.get(name, default)

    def set(self, name: str, value: int | float, persistent: bool = False) -> None:
        if not name or not all(name.split(".")):
            raise ValueError(f"{name!r} is not the name of a counter")
        with self._lock:
            self.values[name] = value
            (self.lasting.add if persistent else self.lasting.discard)(name)

    def add(self, name: str, by: int | float = 1) -> None:
        with self._lock:
            self.values[name] = self.values.get(name, 0) + by

    @contextmanager
    def tracked(self, name: str):
        """Count a call under ``name.calls`` and its seconds under ``name.time``, also one that fails."""
        began = time.time()
        try:
            yield
        finally:
            self.add(f"{name}.calls")
            self.add(f"{name}.time", time.time() - began)

    def flush(self, every: bool = False) -> None:
        """Set counters back to 0; those that are kept in the file only with ``every``."""
        with self._lock:
            self.values = {k: 0 if every or k not in self.lasting else v for k, v in self.values.items()}

    def show(self, name: str, recursive: bool = False) -> list[tuple[str, int | float]]:
        """The counter of that name; recursively also those below it. An empty name with ``recursive`` shows all."""
        return sorted((k, v) for k, v in self.values.items() if k == name or recursive and (not name or k.startswith(name + ".")))

    def save(self) -> None:
        if self.path:
            Path(self.path).write_text(json.dumps({k: v for k, v in self.values.items() if k in self.lasting}))
