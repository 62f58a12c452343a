"""Syslog: names of facilities and severities, selectors, and packets received by UDP."""

from __future__ import annotations

import re
import socket
import time

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, SimpleDataSourceStreamReader

from ..errors import BadRequest
from ..plugins import register

SEVERITIES = {n: i for i, n in enumerate("emerg alert crit err warning notice info debug".split())}
#: Some names stand for several facilities.
FACILITIES: dict[str, tuple[int, ...]] = {n: (i,) for i, n in enumerate("kern user mail daemon auth syslog lpr news uucp cron authpriv ftp ntp".split())}
FACILITIES["auth"] += (13, 14)
FACILITIES["cron"] += (15,)
FACILITIES |= {f"local{i}": (16 + i,) for i in range(8)}

_SELECTOR = re.compile(r"(?P<who>[^.]+)\.(?P<sign>!=|=|!|)(?P<what>\*|\w+)")


def selected(selectors: str) -> set[int]:
    """Priorities (facility * 8 + severity) that selectors choose. They are separated by semicolons and taken in order:
    ``fac,fac.sev`` adds that severity and all graver ones, ``=sev`` it alone, ``*`` all; ``!sev``, ``!=sev`` and ``none`` take away."""
    chosen: set[int] = set()
    for one in filter(None, (s.strip() for s in selectors.split(";"))):
        m = _SELECTOR.fullmatch(one)
        if not m:
            raise BadRequest(f"{one!r} is not a selector")
        names = FACILITIES if m["who"] == "*" else [n for n in m["who"].split(",") if n]
        if unknown := [n for n in names if n not in FACILITIES]:
            raise BadRequest(f"{one!r}: no facility {unknown[0]!r}")
        if m["what"] in ("*", "none"):
            levels = range(8)
        elif m["what"] not in SEVERITIES:
            raise BadRequest(f"{one!r}: no severity {m['what']!r}")
        else:
            top = SEVERITIES[m["what"]]
            levels = (top,) if m["sign"].endswith("=") else range(top + 1)
        priorities = {f * 8 + s for n in names for f in FACILITIES[n] for s in levels}
        away = m["sign"].startswith("!") or m["what"] == "none"
        chosen = chosen - priorities if away else chosen | priorities
    return chosen


def facility_name(pri: Column) -> Column:
    table = F.create_map(*(F.lit(x) for n, fs in FACILITIES.items() for f in fs for x in (f, n)))
    return table[F.floor(pri / 8).cast("int")]


def severity_name(pri: Column) -> Column:
    return F.create_map(*(F.lit(x) for n, s in SEVERITIES.items() for x in (s, n)))[(pri % 8).cast("int")]


class UdpReader(SimpleDataSourceStreamReader):
    """Packets that have arrived since the last batch. UDP can't be asked again, so packets are kept until their batch is committed."""

    def __init__(self, options):
        self.address, self.port = options.get("address", "0.0.0.0"), int(options.get("port", 514))
        self.wait, self.most = float(options.get("wait", 0.2)), int(options.get("batch", 10_000))
        self.socket, self.kept, self.count = None, {}, 0

    def initialOffset(self):
        return {"n": 0}

    def _open(self):
        if self.socket is None:
            self.socket = socket.socket(socket.AF_INET, socket.SOCK_DGRAM)
            self.socket.setsockopt(socket.SOL_SOCKET, socket.SO_REUSEADDR, 1)
            self.socket.bind((self.address, self.port))
        return self.socket

    def read(self, start):
        s, begin, at = self._open(), start["n"], time.monotonic()
        n = begin
        while n - begin < self.most and (left := self.wait - (time.monotonic() - at)) > 0:
            s.settimeout(left)
            try:
                data, (host, _) = s.recvfrom(65535)
            except TimeoutError:
                break
            self.kept[n] = (data.decode("utf-8", "replace").rstrip("\n"), host)
            n += 1
        return iter([self.kept[i] for i in range(begin, n)]), {"n": n}

    def readBetweenOffsets(self, start, end):
        return iter([self.kept[i] for i in range(start["n"], end["n"]) if i in self.kept])

    def commit(self, end):
        self.kept = {i: x for i, x in self.kept.items() if i >= end["n"]}


class SyslogUdp(DataSource):
    """``spark.readStream.format("syslog_udp").option("port", 514)``: (message, sender)."""

    @classmethod
    def name(cls):
        return "syslog_udp"

    def schema(self):
        return "message string, sender string"

    def simpleStreamReader(self, schema):
        return UdpReader(self.options)


@register("source", "syslog")
def syslog_stream(spark: SparkSession, name: str = "syslog", address: str = "0.0.0.0", port: int = 514) -> DataFrame:
    """Events of packets; parse them with filter syslog_packet."""
    spark.dataSource.register(SyslogUdp)
    rows = spark.readStream.format("syslog_udp").option("address", address).option("port", str(port)).load()
    return rows.select(F.localtimestamp().alias("ts"), F.lit(name).alias("input"), F.col("sender").alias("hostname"), "message")
