"""Command line: ``python -m siltlog COMMAND``.

search, tail, indices (list-indices) and show (show-index) work on stores, ``--store NAME=PATH`` or those of ``--config FILE``; serve runs the routes of a configuration;
show-stats and flush-stats read and reset the counters in its statistics file."""

from __future__ import annotations

import argparse
import time

from pyspark.sql import SparkSession

from .engine import Engine
from .operators.project import display
from .plans.catalog import Catalog
from .runtime import configure
from .settings import Settings
from .sources.store import Store
from .stats import Stats
from .streaming.server import Server
from .streaming.tail import REFRESH

COMMANDS = ["search", "tail", "indices", "list-indices", "show", "show-index", "serve", "show-stats", "flush-stats"]


def main(args: list[str] | None = None) -> None:
    p = argparse.ArgumentParser(prog="siltlog")
    p.add_argument("command", choices=COMMANDS)
    p.add_argument("query", nargs="*")
    p.add_argument("--store", action="append", default=[], metavar="NAME=PATH")
    p.add_argument("--config", metavar="FILE")
    p.add_argument("--limit", type=int, default=100)
    p.add_argument("--reverse", action="store_true")
    p.add_argument("--recursive", action="store_true")
    p.add_argument("--all", action="store_true")
    p.add_argument("--fields")
    p.add_argument("--verbose", action="store_true")
    p.add_argument("--timezone", default="UTC")
    p.add_argument("--refresh", type=float, default=REFRESH)
    p.add_argument("--seconds", type=float, help="let serve end after so long")
    a = p.parse_args(args)
    settings, text = Settings.read(a.config) if a.config else Settings(), " ".join(a.query)
    if a.command in ("show-stats", "flush-stats"):
        stats = Stats(settings.section("server").text("statistics"))
        if a.command == "flush-stats":
            stats.flush(a.all)
            stats.save()
        else:
            print(*(f"{k}: {v}" for k, v in stats.show(text, a.recursive)), sep="\n")
        return
    spark = configure(SparkSession.builder.appName("siltlog").getOrCreate())
    if a.command == "serve":
        server = Server(spark, settings)
        server.start()
        try:
            server.wait(a.seconds)
        finally:
            server.stop()
        return
    stores = [(name, path) for name, _, path in (s.partition("=") for s in a.store)]
    stores += [(n, s.text("path")) for n, s in settings.like("output").items() if s.text("type") == "store"]

    def opened() -> Engine:
        """The stores as they are now: an index reads the files that it found when it was made."""
        return Engine(spark, Catalog(*(Store(spark, path, name).index() for name, path in stores)))

    engine = opened()
    fields = a.fields.split(",") if a.fields else None

    def show(data) -> int:
        lines = [r.line for r in display(data, a.timezone, a.verbose, fields).collect()]
        print(*lines, sep="\n")
        return len(lines)

    if a.command in ("indices", "list-indices"):
        print(*engine.list_indices(), sep="\n")
    elif a.command in ("show", "show-index"):
        for k, v in engine.show_index(text).items():
            print(f"{k}: {', '.join(f'{n}:{t}' for n, t in v) if k == 'fields' else v}")
    elif a.command == "search":
        began = time.time()
        n = show(engine.iter_events(text, limit=a.limit, reverse=a.reverse).data)
        print(f"{n} matches in {time.time() - began:.2f} seconds")
    else:
        last, _ = engine.tail_events(text)
        while True:
            time.sleep(a.refresh)
            last, found = opened().tail_events(text, last)
            show(found.data)


if __name__ == "__main__":
    main()
