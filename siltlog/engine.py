"""The engine: searches, tailing and what is known of indexes, for callers with or without an access list."""

from __future__ import annotations

import datetime as dt
import time
from dataclasses import dataclass
from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .acl import ACL, Permission
from .errors import BadRequest, NotAuthorized
from .functions.evid import EVID_MIN, Evid, beyond
from .operators import indexstats, paging
from .plans.catalog import DEFAULT_FIELD, Catalog, Index
from .plans.compiler import compile_query
from .plans.parser import parse_query, parse_tail
from .stats import Stats

DEFAULT_LIMIT = 100
RESULT = ["evid", "default_field", "default_value", "fields"]


@dataclass
class QueryResult:
    """``data``: evid struct<ts, offset>, default_field, default_value, fields map<string, string>, in the order asked for. Nothing runs
    until an action does."""

    data: DataFrame
    seen: DataFrame
    started: float

    def field_names(self) -> list[str]:
        """Names of the fields that the events of the result have, before projection, sorted."""
        names = self.seen.select(F.explode(F.map_keys("fields")).alias("n")).distinct()
        return sorted(r.n for r in names.collect())

    @property
    def meta(self) -> dict:
        return {"fields": self.field_names(), "runtime": time.time() - self.started}


class Engine:
    def __init__(self, spark: SparkSession, catalog: Catalog, acl: ACL | None = None, stats: Stats | None = None):
        self.spark, self.catalog, self.acl, self.stats = spark, catalog, acl, stats or Stats()

    # --- who may see what

    def _allowed(self, permission: str, indexes: list[Index]) -> list[Index]:
        """Indexes that the caller may search; without an access list all. None left is an error."""
        if self.acl is None:
            return indexes
        left = [i for i in indexes if self.acl.test(permission, index=i.name) == Permission.ALLOW]
        if not left:
            raise NotAuthorized(f"{permission} is not allowed on any of these indexes")
        return left

    # --- searches

    def _matches(self, node, index: Index, period, after: Evid | None, reverse: bool, compat: bool) -> DataFrame | None:
        p = compile_query(node, index, compat)
        if p is None:
            return None
        df = index.df
        if period is not None:
            df = df.filter(period.condition(F.col(index.ts), index.ts_kind))
        if after is not None:
            from .functions.times import literal  # the scan can use whole seconds of the cursor

            at = literal(dt.datetime(1970, 1, 1) + dt.timedelta(seconds=after.ts + int(reverse)), index.ts_kind)
            df = df.filter(F.col(index.ts) < at if reverse else F.col(index.ts) >= at)
        df = df.filter(p).withColumns({"ts_sec": index.ts_sec(), "evid_offset": F.col(index.offset).cast("long")})
        return df if after is None else df.filter(beyond(after, reverse))

    def _run(self, parts: list[tuple[Index, DataFrame]], limit: int | None, reverse: bool, fields: list[str] | None) -> tuple[DataFrame, DataFrame]:
        """Events of some indexes in the order of their ids, each id once (of equal ids, that of the first index). Each index
        gives its first ``limit`` only, so what is merged is small."""
        rows = []
        for rank, (index, df) in enumerate(parts):
            first = paging.in_order(df, reverse)
            if limit is not None:
                first = first.limit(limit)
            rows.append(first.select("ts_sec", "evid_offset", F.lit(rank).alias("rank"), F.col(index.fields[DEFAULT_FIELD, "text"]).alias("default_value"), index.field_map().alias("fields")))
        if not rows:
            empty = self.spark.createDataFrame([], "ts_sec long, evid_offset long, default_value string, fields map<string,string>")
            every = empty
        elif len(rows) == 1:
            every = rows[0].drop("rank")
        else:
            body = F.struct("default_value", "fields")
            merged = reduce(DataFrame.unionByName, rows).groupBy("ts_sec", "evid_offset").agg(F.min_by(body, "rank").alias("body"))
            every = merged.select("ts_sec", "evid_offset", "body.default_value", "body.fields")
        every = paging.in_order(every, reverse)
        if limit is not None:
            every = every.limit(limit)
        shown = F.col("fields") if fields is None else F.map_filter("fields", lambda k, _: k.isin(list(fields)))
        evid = F.struct(F.col("ts_sec").alias("ts"), F.col("evid_offset").alias("offset"))
        return every.select(evid.alias("evid"), F.lit(DEFAULT_FIELD).alias("default_field"), "default_value", shown.alias("fields")), every

    def iter_events(
        self, query: str, last=None, indices: list[str] | None = None, limit: int | None = DEFAULT_LIMIT, reverse: bool = False, fields: list[str] | None = None, compat: bool = False, now: dt.datetime | None = None,
    ) -> QueryResult:
        """Events that match a query, by id. ``last``: only those beyond this id, which must lie in the query's period. ``fields``: names
        of fields to return; the default field always is. ``limit`` None returns all."""
        with self.stats.tracked("rpc.iter"):
            return self._iter(query, last, indices, limit, reverse, fields, compat, now)

    def _iter(self, query, last, indices, limit, reverse, fields, compat, now) -> QueryResult:
        started = time.time()
        if limit is not None and limit < 1:
            raise BadRequest("limit must be 1 or more")
        indexes = self._allowed("RPC::ITER", self.catalog.select(indices))
        node, period = parse_query(query, now)
        after = None
        if last is not None:
            after = _evid(last)
            if not period.contains_second(after.ts):
                raise BadRequest(f"{after} is not in the period of the query")
        found = [(i, df) for i in indexes if (df := self._matches(node, i, period, after, reverse, compat)) is not None]
        data, seen = self._run(found, limit, reverse, fields)
        return QueryResult(data, seen, started)

    def tail_events(self, query: str, last=None, indices: list[str] | None = None, limit: int | None = DEFAULT_LIMIT, fields: list[str] | None = None, compat: bool = False) -> tuple[str, QueryResult | None]:
        """Events newer than ``last``, oldest first, and the id to go on from. Without ``last`` only that id: the greatest there is."""
        with self.stats.tracked("rpc.tail"):
            return self._tail(query, last, indices, limit, fields, compat)

    def _tail(self, query, last, indices, limit, fields, compat) -> tuple[str, QueryResult | None]:
        started = time.time()
        if limit is not None and limit < 1:
            raise BadRequest("limit must be 1 or more")
        indexes = self._allowed("RPC::TAIL", self.catalog.select(indices))
        node = parse_tail(query)
        if last is None:
            newest = [r for i in indexes if (r := indexstats.last_event(i))]
            return str(max(newest, default=EVID_MIN)), None
        after = _evid(last)
        found = [(i, df) for i in indexes if (df := self._matches(node, i, None, after, False, compat)) is not None]
        data, seen = self._run(found, limit, False, fields)
        top = data.agg(F.max("evid").alias("e")).first().e
        return str(after if top is None else Evid(top.ts, top.offset)), QueryResult(data, seen, started)

    # --- what there is

    def list_indices(self) -> list[str]:
        return [i.name for i in self._allowed("RPC::LIST", self.catalog.select(None))]

    def show_index(self, name: str) -> dict:
        """Fields with their types, and statistics, of one index."""
        index = self._allowed("RPC::SHOW", self.catalog.select([name]))[0]
        row = indexstats.index_stats(index).first()
        return {"name": name, "fields": sorted(index.fields), **row.asDict()}

    def show_stats(self, name: str, recursive: bool = False) -> list[tuple[str, int | float]]:
        return self.stats.show(name, recursive)

    def flush_stats(self, every: bool = False) -> None:
        """Counters go back to 0; those that last only with ``every``."""
        self.stats.flush(every)


def _evid(last) -> Evid:
    try:
        return Evid.parse(last)
    except (ValueError, TypeError):
        raise BadRequest(f"{last!r} is not an event id") from None
