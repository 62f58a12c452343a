"""The store: an index as Parquet in segments, partitioned by day, with its fields in a small table beside it."""

from __future__ import annotations

import json
import threading
import time
import uuid

from py4j.protocol import Py4JJavaError
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import text
from ..functions.fieldtypes import TYPES
from ..operators.segments import number_events
from ..plans.catalog import REQUIRED, Index
from ..plugins import register
from ..runtime import cut_lineage
from ..stats import Stats

FIELDS = "field_name string, field_type string, column_name string"
#: Log entries, and entries of a stream's batches, that are kept; older ones are never asked for again.
KEPT = 50
_LOCK = threading.Lock()


class Store:
    """``path/events/segment=N/batch=B/day=D/*.parquet``, ``path/fields`` and ``path/log``. Tokens of text fields are stored with the events, so
    that searches don't split texts again.

    The log's last entry says which segment is written, how many events it has and the greatest offset, so a batch costs the same
    however large the store is (numbered events are looked for in the folders of their days). Each batch claims the next entry, by creating a file that must not exist yet, and with it a range of offsets of its own;
    then it writes a folder that nobody else writes. A batch of a stream remembers its claim under the stream's id and its number: tried again, it replaces its own
    events and nothing else. A claim that is never used leaves a gap in the offsets."""

    def __init__(self, spark: SparkSession, path: str, name: str, rotation: int = 0, retention: int = 0):
        self.spark, self.path, self.name, self.rotation, self.retention = spark, path.rstrip("/"), name, rotation, retention

    @property
    def events_path(self) -> str:
        return f"{self.path}/events"

    # --- files

    def _fs(self, path: str):
        p = self.spark._jvm.org.apache.hadoop.fs.Path(path)
        return p.getFileSystem(self.spark._jsc.hadoopConfiguration()), p

    def _exists(self, path: str) -> bool:
        fs, p = self._fs(path)
        return fs.exists(p)

    def _names(self, path: str) -> list[str]:
        fs, p = self._fs(path)
        return sorted(s.getPath().getName() for s in fs.listStatus(p)) if fs.exists(p) else []

    def _read(self, path: str) -> dict:
        fs, p = self._fs(path)
        stream = fs.open(p)
        try:
            return json.loads(bytes(stream.readAllBytes()))
        finally:
            stream.close()

    def _create(self, path: str, value: dict) -> bool:
        """Write a file that must not exist; False if it does."""
        fs, p = self._fs(path)
        try:
            stream = fs.create(p, False)
        except Py4JJavaError as e:
            if fs.exists(p):
                return False
            raise e
        stream.write(bytearray(json.dumps(value).encode()))
        stream.close()
        return True

    def _drop(self, path: str) -> None:
        fs, p = self._fs(path)
        fs.delete(p, True)

    # --- fields

    def fields(self) -> dict[tuple[str, str], str]:
        if not self._exists(f"{self.path}/fields"):
            return {}
        return {(r.field_name, r.field_type): r.column_name for r in self.spark.read.schema(FIELDS).parquet(f"{self.path}/fields").distinct().collect()}

    def add_fields(self, types: dict[str, str]) -> dict[tuple[str, str], str]:
        """Register fields on their first write. A name that comes with a second type gets a second column, ``name__type``."""
        known = self.fields()
        new = {}
        for name, kind in types.items():
            if (name, kind) in REQUIRED or (name, kind) in known or (name, kind) in new:
                continue
            taken = any(n == name for n, _ in {**REQUIRED, **known, **new})
            new[name, kind] = f"{name}__{kind}" if taken else name
        if new:
            self.spark.createDataFrame([(n, t, c) for (n, t), c in new.items()], FIELDS).coalesce(1).write.mode("append").parquet(f"{self.path}/fields")
        return {**REQUIRED, **known, **new}

    # --- segments and the log

    def segments(self) -> list[int]:
        """Segments that hold events. A batch without events leaves a folder without days, which is none."""
        fs, p = self._fs(f"{self.events_path}/segment=*/batch=*/day=*")
        days = fs.globStatus(p) if self._exists(self.events_path) else None
        return sorted({int(s.getPath().getParent().getParent().getName().partition("=")[2]) for s in days or []})

    def head(self) -> dict:
        """The log's last entry: version, segment, events in it, greatest offset given."""
        names = [n for n in self._names(f"{self.path}/log") if n.isdigit()]
        return self._read(f"{self.path}/log/{names[-1]}") if names else {"version": 0, "segment": 0, "count": 0, "offset": 0}

    def _claim(self, rows: int, top: int | None) -> dict:
        """The next entry of the log, for a batch of so many events: its segment, and the offset after which its own begin."""
        while True:
            with _LOCK:
                h = self.head()
                full = self.rotation and rows and h["count"] >= self.rotation  # so each segment but the first has events
                base = h["offset"]
                new = {"version": h["version"] + 1, "segment": h["segment"] + bool(full), "count": (0 if full else h["count"]) + rows, "offset": max(base, top) if top is not None else base + rows, "base": base}
                if self._create(f"{self.path}/log/{new['version']:020d}", new):
                    self._drop(f"{self.path}/log/{new['version'] - KEPT:020d}")
                    return new

    def _shaped(self, df: DataFrame, types: dict[str, str]) -> DataFrame:
        columns = self.add_fields(types)
        out = [F.col("ts").cast("timestamp_ntz").alias("ts"), F.col("evid_offset").cast("long").alias("evid_offset")]
        for (name, kind), column in columns.items():
            if types.get(name, dict(REQUIRED.keys()).get(name)) == kind and name in df.columns:
                out.append(F.col(name).cast(TYPES[kind].storage).alias(column))
                if kind == "text":
                    out.append(text.tokens(F.col(name)).alias(f"{column}__tokens"))
        return df.select(*out, F.current_timestamp().alias("modified"), F.to_date("ts").alias("day"))

    def append(self, df: DataFrame, types: dict[str, str] | None = None, stream: str | None = None, batch: int | None = None, numbered: bool = False) -> None:
        """Add events (ts, input, hostname, message and the fields in ``types``), with their offsets in ``evid_offset`` if ``numbered``; else
        offsets go on from the greatest one. Of numbered events those whose id is there already are left out; only the days of the batch are
        looked at. ``stream`` and ``batch`` name a batch that may be tried again: it stays one batch. Several writers may append at once;
        of two that bring the same numbered ids at the same time, both may be stored."""
        types = types or {}
        place = f"{self.path}/streams/{stream}/{batch}" if stream is not None else None
        before = self._read(place) if place and self._exists(place) else None
        if numbered:
            rows = df.dropDuplicates(["ts", "evid_offset"])
            days = [r[0] for r in rows.select(F.to_date("ts")).distinct().collect()]
            if self.head()["version"] and self.segments():
                known = self.spark.read.parquet(self.events_path).filter(F.col("day").isin(days))
                if before:
                    known = known.filter(F.col("batch") != before["key"])
                rows = rows.join(known.select(F.col("ts").alias("_ts"), F.col("evid_offset").alias("_n")), (F.col("ts").cast("timestamp_ntz") == F.col("_ts")) & (F.col("evid_offset") == F.col("_n")), "left_anti")
            rows = cut_lineage(rows)
            size, top = rows.agg(F.count("*"), F.max("evid_offset")).first()
            top = top or 0
        else:
            rows = number_events(df, ["ts"], "_n")
            size, top = rows.count(), None
        if before is None:
            before = self._claim(size, top) | {"key": f"{stream}-{batch}" if place else uuid.uuid4().hex}
            if place:
                self._create(place, before)
                self._drop(f"{self.path}/streams/{stream}/{batch - KEPT}")
        if not numbered:
            rows = rows.withColumn("evid_offset", F.col("_n") + 1 + before["base"]).drop("_n")
        self._shaped(rows, types).write.mode("overwrite").partitionBy("day").parquet(f"{self.events_path}/segment={before['segment']}/batch={before['key']}")
        self.expire()

    def expire(self) -> list[int]:
        """Delete the oldest segments beyond ``retention``; which ones is returned."""
        if not self.retention:
            return []
        old = sorted(int(n.partition("=")[2]) for n in self._names(self.events_path) if n.startswith("segment="))[: -self.retention]
        for s in old:
            self._drop(f"{self.events_path}/segment={s}")
        return old

    def index(self) -> Index:
        """The stored events as an index to search."""
        if not self.segments():
            empty = self.spark.createDataFrame([], "ts timestamp_ntz, evid_offset long, input string, hostname string, message string")
            return Index(self.name, empty)
        df = self.spark.read.option("mergeSchema", True).parquet(self.events_path)
        fields = {k: c for k, c in {**REQUIRED, **self.fields()}.items() if c in df.columns}
        tokens = {c: f"{c}__tokens" for (_, t), c in fields.items() if t == "text" and f"{c}__tokens" in df.columns}
        return Index(self.name, df, fields, tokens)

    def write_stream(self, events: DataFrame, types: dict[str, str], checkpoint: str, **trigger):
        """A query that stores a stream. A batch that is tried again replaces itself, so each event is stored once; other streams, and the same
        one begun anew with another checkpoint, have batches of their own."""
        writer = events.writeStream.foreachBatch(lambda df, batch: self.append(df, types, stream_id(self.spark, checkpoint), batch)).option("checkpointLocation", checkpoint)
        return (writer.trigger(**trigger) if trigger else writer).start()


def stream_id(spark: SparkSession, checkpoint: str) -> str:
    """The id that a running query wrote to its checkpoint folder; a new folder has a new one."""
    p = spark._jvm.org.apache.hadoop.fs.Path(f"{checkpoint.rstrip('/')}/metadata")
    stream = p.getFileSystem(spark._jsc.hadoopConfiguration()).open(p)
    try:
        return json.loads(bytes(stream.readAllBytes()))["id"]
    finally:
        stream.close()


@register("sink", "store")
def store(spark: SparkSession, path: str, name: str, rotation: int = 0, retention: int = 0) -> Store:
    return Store(spark, path, name, int(rotation), int(retention))


#: Tries to send a batch, and the seconds before the second one; they double each time.
TRIES, BACKOFF = 5, 1.0


def _tried(send, tries: int, backoff: float, stats: Stats | None, name: str) -> None:
    for k in range(1, tries + 1):
        try:
            n = send()
            break
        except Exception:
            if stats:
                stats.add(f"{name}.retries")
            if k == tries:
                raise
            time.sleep(backoff * 2 ** (k - 1))
    if stats:
        stats.add(f"{name}.forwardedevents", n)


@register("sink", "forward")
def forward(events: DataFrame, path: str, checkpoint: str | None = None, tries: int = TRIES, backoff: float = BACKOFF, stats: Stats | None = None, name: str = "forward", **trigger):
    """Send events to another server's folder (its ``collect`` source), again after a while if that fails, at last with the error. A batch of a stream has a folder of its own,
    which a second try replaces, so each event arrives once. ``stats`` counts events sent and tries that failed."""
    if not events.isStreaming:

        def send() -> int:
            events.write.mode("append").parquet(path)
            return events.count() if stats else 0

        return _tried(send, tries, backoff, stats, name)
    checkpoint = checkpoint or f"{path}-checkpoint-{uuid.uuid4().hex}"

    def sent(df: DataFrame, batch: int) -> None:
        folder = f"{path}/{stream_id(df.sparkSession, checkpoint)}-{batch}"

        def send() -> int:
            df.write.mode("overwrite").parquet(folder)
            return df.count() if stats else 0

        _tried(send, tries, backoff, stats, name)

    writer = events.writeStream.foreachBatch(sent).option("checkpointLocation", checkpoint)
    return (writer.trigger(**trigger) if trigger else writer).start()
