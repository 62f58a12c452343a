"""Filters: log formats as transforms of a DataFrame of events, built from column functions only.

A filter takes and returns events (ts timestamp_ntz in UTC, input, hostname, message and fields) with a column ``error``. A
row that it can't parse gets a message there; a row that it is to drop gets ``DROPPED``. Routes separate both from the rest."""

from __future__ import annotations

import re
from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import times
from ..plans.period import utcnow
from ..plugins import register
from ..streaming.contracts import Assertion, Contract

DROPPED = "dropped"
_MESSAGE = "message"


@dataclass(frozen=True)
class Filter:
    """``transform`` takes the events and gives the new fields and the error of each. With ``parse``, that column is worked out once for each row, and
    ``transform`` gets it as its second argument."""

    name: str
    contract: Contract
    transform: Callable[..., tuple[dict[str, Column], Column]]
    parse: Column | None = None

    def apply(self, df: DataFrame) -> DataFrame:
        """Rows that carry an error already are left alone; a row that fails keeps what it had."""
        if "error" not in df.columns:
            df = df.withColumn("error", F.lit(None).cast("string"))
        have = df.columns
        if self.parse is None:
            values, error = self.transform(df)
        else:
            df = _once(df, "_parsed", self.parse)
            values, error = self.transform(df, F.col("_parsed"))
        df = _once(df, "_made", F.struct(F.coalesce(F.col("error"), error).alias("error"), *(v.alias(k) for k, v in values.items())))
        made, good = F.col("_made"), F.col("_made.error").isNull()
        new = {k: F.when(good, made[k]).otherwise(F.col(k)) if k in have else F.when(good, made[k]) for k in values}
        return df.withColumns(new | {"error": made["error"]}).drop("_made", "_parsed")


def _once(df: DataFrame, name: str, c: Column) -> DataFrame:
    """``c`` as a column that the optimizer can't copy to the places where it is used: as what a generator makes, it is worked out once for a row."""
    return df.select("*", F.explode(F.array(c)).alias(name))


def _matched(c: Column, pattern: str, groups: int) -> Column:
    """The groups of a pattern as an array, from one match; null where it isn't found. No group may match a line feed."""
    parts = F.regexp_replace(c, f"{pattern}[\\s\\S]*$", "\n".join(f"${k}" for k in range(1, groups + 1)))
    return F.when(c.rlike(pattern), F.split(parts, "\n", -1))


def _contract(*fields: tuple[str, str], guarantees: bool = True) -> Contract:
    return Contract(*(Assertion(n, t, guarantees=guarantees) for n, t in fields), sign=True)


def _unless(ok: Column, message: str) -> Column:
    return F.when(~F.coalesce(ok, F.lit(False)), F.lit(message))


def _utc(c: Column) -> Column:
    """timestamp to timestamp_ntz in UTC, whatever the session's zone."""
    return F.convert_timezone(F.expr("current_timezone()"), F.lit("UTC"), c.cast("timestamp_ntz"))


_ACCESS = r'^([\d.]+) (\S+) (\S+) \[(\d{1,2}/\w{3}/\d{4}:\d\d:\d\d:\d\d [-+]\d{4})\] "(.+?)" (\d{3}) (\d+)'
_COMBINED = _ACCESS + r' "(.*?)" "(.*?)"'


def _access(name: str, pattern: str, fields: list[tuple[str, str]]) -> Filter:
    def transform(df: DataFrame, p: Column):
        date = F.try_to_timestamp(F.get(p, F.lit(3)), F.lit("d/MMM/yyyy:HH:mm:ss Z"))
        groups = [F.get(p, F.lit(i + (i > 2))) for i in range(len(fields))]  # the date comes after the third
        values = {n: g.try_cast("bigint") if t == "int" else g for (n, t), g in zip(fields, groups)}
        error = F.when(p.isNull(), F.lit(f"{name}: the line has another format")).when(date.isNull(), F.lit(f"{name}: no such date"))
        return {"ts": _utc(date), **values}, error

    return Filter(name, _contract(*fields), transform, _matched(F.col(_MESSAGE), pattern, len(fields) + 1))


@register("filter", "apache_common")
def apache_common() -> Filter:
    """Common log format. A size of ``-`` is an error."""
    return _access("apache_common", _ACCESS, [("remotehost", "text"), ("remotelog", "text"), ("remoteuser", "literal"), ("request", "literal"), ("status", "int"), ("byteswritten", "int")])


@register("filter", "apache_combined")
def apache_combined() -> Filter:
    """Combined log format: with referrer and user agent."""
    fields = [("remotehost", "text"), ("remotelog", "literal"), ("remoteuser", "literal"), ("request", "text"), ("status", "int"), ("byteswritten", "int"), ("referrer", "text"), ("useragent", "text")]
    return _access("apache_combined", _COMBINED, fields)


_BSD = r"^(\p{Alpha}{3} +\d{1,2} \d\d:\d\d:\d\d) (\S*) (\S+) (.*)$"
_TAG = r"^(\S+?)(?:\[(\d+)\])?:$"


def _bsd_parsed(line: Column) -> Column:
    """date, host, tag with its signs, message"""
    return _matched(line, _BSD, 4)


def _bsd(p: Column, year: int, name: str) -> tuple[dict[str, Column], Column]:
    at = lambda n: F.get(p, F.lit(n))
    ts, tag = times.syslog_date(at(0), year), at(2)
    # "name[12]:" is cut at the last bracket, if what follows is a number
    body = F.substring(tag, F.lit(1), F.length(tag) - 1)
    pid = F.substring_index(F.substring(body, F.lit(1), F.length(body) - 1), "[", -1)
    has = body.endswith("]") & (pid != "") & (F.translate(pid, "0123456789", "") == "") & (F.length(body) > F.length(pid) + 2)
    values = {"ts": ts.cast("timestamp_ntz"), "hostname": at(1), "syslog_tag": F.when(has, F.substring(body, F.lit(1), F.length(body) - F.length(pid) - 2)).otherwise(body), "syslog_pid": F.when(has, pid.try_cast("bigint")), _MESSAGE: at(3)}
    error = F.when(p.isNull(), F.lit(f"{name}: the line has another format")).when(~tag.endswith(":") | (F.length(tag) < 2), F.lit(f"{name}: the tag has another format")).when(ts.isNull(), F.lit(f"{name}: no such date"))
    return values, error


def _syslog_contract(*more: Assertion) -> Contract:
    return Contract(*more, Assertion("syslog_pid", "int", guarantees=False), Assertion("syslog_tag", "text", guarantees=False), sign=True)


@register("filter", "syslog")
def syslog(year: int | None = None) -> Filter:
    """A line of a syslog file: date without a year (the current one is taken), host, ``tag[pid]:`` or ``tag:``, and the message."""
    return Filter("syslog", _syslog_contract(), lambda df, p: _bsd(p, int(year or utcnow().year), "syslog"), _bsd_parsed(F.col(_MESSAGE)))


_PRI = r"^<(0|[1-9]\d{0,2})>"


@register("filter", "syslog_packet")
def syslog_packet(selectors: str = "", year: int | None = None) -> Filter:
    """A packet of the syslog protocol, ``<PRI>`` and a line: facility and severity as numbers in text. Priorities that no selector
    names are dropped; without selectors all pass. A packet of the newer protocol (a version after PRI) is an error."""
    from ..sources.syslog import selected

    chosen = selected(selectors) if selectors else None

    text = F.regexp_replace(F.col(_MESSAGE), _PRI, "")
    head = F.regexp_extract(F.col(_MESSAGE), _PRI, 1).try_cast("int")

    def transform(df: DataFrame, p: Column):
        pri, line = p["pri"], p["line"]
        values, error = _bsd(line, int(year or utcnow().year), "syslog")
        errors = [_unless(pri.isNotNull() & (pri <= 191), "syslog: the packet has no valid priority")]
        if chosen is not None:
            errors.append(F.when(~pri.isin(sorted(chosen)), F.lit(DROPPED)))
        errors += [F.when(p["newer"], F.lit("syslog: only the older protocol is read")), error]
        return {**values, "syslog_facility": F.floor(pri / 8).cast("string"), "syslog_severity": (pri % 8).cast("string")}, F.coalesce(*errors)

    parsed = F.struct(head.alias("pri"), text.rlike(r"^\d").alias("newer"), _bsd_parsed(text).alias("line"))
    return Filter("syslog_packet", _syslog_contract(Assertion("syslog_facility", "literal"), Assertion("syslog_severity", "literal")), transform, parsed)


@register("filter", "dt_rfc2822")
def dt_rfc2822() -> Filter:
    """The time of the event from field rfc2822_date, which ends with the route."""
    contract = Contract(Assertion("rfc2822_date", "literal", expects=True, guarantees=False, ephemeral=True), sign=True)

    def transform(df: DataFrame):
        ts = times.rfc2822(F.col("rfc2822_date"))
        return {"ts": _utc(ts)}, _unless(ts.isNotNull(), "dt_rfc2822: no such date")

    return Filter("dt_rfc2822", contract, transform)


@register("filter", "dt_syslog")
def dt_syslog(year: int | None = None) -> Filter:
    """The time of the event from field syslog_date, in the current year; the field ends with the route."""
    contract = Contract(Assertion("syslog_date", "literal", expects=True, guarantees=False, ephemeral=True), sign=True)

    def transform(df: DataFrame):
        ts = times.syslog_date(F.col("syslog_date"), int(year or utcnow().year))
        return {"ts": ts.cast("timestamp_ntz")}, _unless(ts.isNotNull(), "dt_syslog: no such date")

    return Filter("dt_syslog", contract, transform)


@register("filter", "dt_expander")
def dt_expander() -> Filter:
    """The parts of the event's time as fields."""
    parts = times.expand(F.col("ts"))
    return Filter("dt_expander", _contract(*((n, "int") for n in parts)), lambda df: ({n: c.cast("bigint") for n, c in parts.items()}, F.lit(None).cast("string")))


_MYSQL = r"^(\d{6}) +(\d{1,2}:\d\d:\d\d)\s+(.*)$"


@register("filter", "mysql_server")
def mysql_server() -> Filter:
    """``YYMMDD HH:MM:SS text``: the time is the event's, the text its message. Other lines pass as they are."""

    def transform(df: DataFrame, p: Column):
        date = F.concat_ws(" ", F.get(p, F.lit(0)), F.lpad(F.get(p, F.lit(1)), 8, "0"))
        ts, dated = F.try_to_timestamp(date, F.lit("yyMMdd HH:mm:ss")).cast("timestamp_ntz"), p.isNotNull()
        return {"ts": F.when(dated, ts).otherwise(F.col("ts")), _MESSAGE: F.when(dated, F.get(p, F.lit(2))).otherwise(F.col(_MESSAGE))}, F.when(dated & ts.isNull(), F.lit("mysql_server: no such date"))

    return Filter("mysql_server", _contract(), transform, _matched(F.col(_MESSAGE), _MYSQL, 3))


@register("filter", "nagios")
def nagios() -> Filter:
    """``[seconds] TYPE: a;b;...``: alerts of hosts and services, errors and warnings; other types are dropped."""
    fields = [("nagios_host", "text"), ("nagios_service", "text"), ("nagios_status", "text"), ("nagios_state", "text"), ("nagios_attempt", "int")]
    contract = Contract(Assertion("nagios_evtype", "literal"), *(Assertion(n, t, guarantees=False) for n, t in fields), sign=True)

    message = F.col(_MESSAGE)
    close = F.locate("]", message)
    inside = F.when(message.startswith("[") & (close > 0), F.substring(message, F.lit(2), close - 2))
    after = F.substr(message, close + 1)
    colon = F.locate(":", after)
    rest = F.trim(F.substr(after, colon + 1))
    parsed = F.struct(inside.try_cast("double").alias("seconds"), F.when(inside.isNotNull() & (colon > 0), F.trim(F.substring(after, F.lit(1), colon - 1))).alias("evtype"), rest.alias("rest"), F.split(rest, ";", 6).alias("parts"))

    def transform(df: DataFrame, p: Column):
        evtype, parts = p["evtype"], p["parts"]
        host, service, plain = evtype == "HOST ALERT", evtype == "SERVICE ALERT", evtype.isin("Error", "Warning")
        part = lambda i: F.get(parts, F.lit(i))
        at = lambda i, j: F.when(host, part(i)).when(service, part(j))
        attempt = at(3, 4).try_cast("bigint")
        # a host's text may hold semicolons: the fifth part and what was cut off it
        text = F.when(host, F.concat_ws(";", part(4), part(5))).when(service, part(5))
        complete = F.when(host, F.size(parts) >= 5).otherwise(F.size(parts) == 6)
        error = F.coalesce(
            _unless(p["seconds"].isNotNull(), "nagios: the line doesn't begin with a time"),
            _unless(host | service | plain, DROPPED),
            F.when((host | service) & ~(complete & attempt.isNotNull()), F.lit("nagios: the alert has another format")),
        )
        values = {
            "ts": _utc(F.timestamp_micros((p["seconds"] * 1_000_000).try_cast("bigint"))),
            "nagios_evtype": evtype, "nagios_host": at(0, 0), "nagios_service": F.when(service, part(1)), "nagios_status": at(1, 2), "nagios_state": at(2, 3), "nagios_attempt": attempt,
            _MESSAGE: F.when(plain, p["rest"]).otherwise(text),
        }
        return values, error

    return Filter("nagios", contract, transform, parsed)


@register("filter", "regex")
def regex(pattern: str, field: str = _MESSAGE) -> Filter:
    """Named groups, ``(?P<name>...)``, of a pattern found in a field become text fields; a row without a match is dropped. A group
    that takes no part in the match leaves its field absent."""
    compiled = re.compile(pattern)
    names = sorted(compiled.groupindex, key=compiled.groupindex.get)
    java = re.sub(r"\(\?P<(\w+)>", r"(", pattern)

    def transform(df: DataFrame):
        found = F.col(field).rlike(java)
        values = {n: F.when(F.regexp_extract(F.col(field), java, compiled.groupindex[n]) != "", F.regexp_extract(F.col(field), java, compiled.groupindex[n])) for n in names}
        return values, F.when(~F.coalesce(found, F.lit(False)), F.lit(DROPPED))

    return Filter("regex", _contract(*((n, "text") for n in names), guarantees=False), transform)


def accepted(df: DataFrame) -> DataFrame:
    return df.filter(F.col("error").isNull()).drop("error")


def rejected(df: DataFrame) -> DataFrame:
    """Rows with an error, without those that are dropped on purpose."""
    return df.filter(F.col("error") != DROPPED)
