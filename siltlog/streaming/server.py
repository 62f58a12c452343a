"""The server: inputs, routes and outputs of an INI file, each route a streaming query, with searches over the stores that they fill."""

from __future__ import annotations

import inspect
import logging
from dataclasses import dataclass, field

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.streaming import StreamingQuery

from .. import plugins
from ..acl import ACL
from ..engine import Engine
from ..errors import ConfigurationError
from ..plans.catalog import Catalog
from ..settings import Section, Settings
from ..sources import files as _files  # noqa: F401 (registers sources)
from ..sources import syslog as _syslog  # noqa: F401
from ..sources.store import Store, forward
from ..stats import Stats
from .routes import Route, routes_of

log = logging.getLogger(__name__)


def _component(kind: str, name: str, section: Section, **more):
    values = {k.replace(" ", "_"): v for k, v in section.values.items() if k != "type"}
    what = section.text("type")
    if not what:
        raise ConfigurationError(f"[{section.name}] needs a type")
    try:
        factory = plugins.get(kind, what)
    except KeyError as e:
        raise ConfigurationError(f"[{section.name}] {e.args[0]}") from None
    known = inspect.signature(factory).parameters
    if not any(p.kind is p.VAR_KEYWORD for p in known.values()) and (odd := set(values) - set(known)):
        raise ConfigurationError(f"[{section.name}] {what} has no setting {sorted(odd)[0]!r}")
    typed = {k: type(known[k].default)(v) if k in known and isinstance(known[k].default, (int, float)) and not isinstance(known[k].default, bool) else v for k, v in values.items()}
    return factory(**({"name": name} if "name" in known else {}) | typed | more)


@dataclass
class Server:
    """``[input:name]`` and ``[output:name]`` with a ``type`` and the settings of its factory; ``[route:name]`` with ``input``, ``filter = a | b`` and ``output = x, y``;
    ``[server]`` with ``checkpoints`` (a folder all executors see), ``interval`` in seconds, ``statistics`` (a file) and ``access``. A wrong input
    or output is an error; a route that can't be made is left out with a warning, and the others go on."""

    spark: SparkSession
    settings: Settings
    queries: list[StreamingQuery] = field(default_factory=list)

    def __post_init__(self):
        own = self.settings.section("server")
        self.checkpoints, self.interval = own.text("checkpoints"), own.number("interval", 3.0)
        self.stats = Stats(own.text("statistics"))
        self.acl = ACL(*own.text("access").split()) if own.text("access") else None
        self.stores: dict[str, Store] = {}
        self.peers: dict[str, dict] = {}
        for name, section in self.settings.like("output").items():
            if section.text("type") == "forward":
                if not section.text("path"):
                    raise ConfigurationError(f"[output:{name}] needs a path")
                self.peers[name] = {"path": section.text("path"), "tries": section.integer("tries", 5), "backoff": section.number("backoff", 1.0)}
            else:
                self.stores[name] = _component("sink", name, section, spark=self.spark)
        self.routes: dict[str, tuple[str, Route, list[str]]] = {}
        inputs = self.settings.like("input")
        for name, (source, route, sinks) in routes_of(self.settings).items():
            missing = [f"input {source}"] * (source not in inputs) + [f"output {s}" for s in sinks if s not in self.stores and s not in self.peers]
            if missing:
                log.warning("route %s is left out: there is no %s", name, missing[0])
            else:
                self.routes[name] = (source, route, sinks)

    def events(self, name: str) -> DataFrame:
        """The stream of an input."""
        return _component("source", name, self.settings.like("input")[name], spark=self.spark)

    def start(self, **trigger) -> list[StreamingQuery]:
        """Start a query for each route, and one for each peer that it forwards to. Their checkpoints are named by route, so a server that is started again goes on where it
        stopped."""
        if self.routes and not self.checkpoints:
            raise ConfigurationError("[server] needs checkpoints")
        trigger = trigger or {"processingTime": f"{self.interval} seconds"}
        for name, (source, route, sinks) in self.routes.items():
            events = self.events(source)
            if stores := [self.stores[s] for s in sinks if s in self.stores]:
                self.queries.append(route.store(events, *stores, checkpoint=f"{self.checkpoints}/{name}", **trigger))
            for s in sinks:
                if s in self.peers:
                    self.queries.append(forward(route.accepted(events), checkpoint=f"{self.checkpoints}/{name}-{s}", stats=self.stats, name=f"output.{s}", **self.peers[s], **trigger))
        return self.queries

    def wait(self, seconds: float | None = None) -> None:
        """Until a query ends, or so many seconds; the error of one that failed is raised."""
        if self.queries:
            self.spark.streams.awaitAnyTermination(seconds) if seconds else self.spark.streams.awaitAnyTermination()

    def stop(self) -> None:
        for q in self.queries:
            q.stop()
        self.queries.clear()
        self.stats.save()

    def engine(self) -> Engine:
        """Searches over what the stores hold now."""
        return Engine(self.spark, Catalog(*(s.index() for s in self.stores.values())), self.acl, self.stats)
