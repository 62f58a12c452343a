"""Lines of files: whole files as they land, files that grow (with rotation and truncation), and saved results."""

from __future__ import annotations

import os
import socket

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, SimpleDataSourceStreamReader

from ..functions.evid import evid_string
from ..plugins import register

MAX_LINE, CHUNK = 1 << 20, 1 << 20


class TailReader(SimpleDataSourceStreamReader):
    """Complete lines appended to one file. Offsets are (device, inode, position).

    The first start is at the file's end unless ``from`` is ``start``. Blank lines and lines over ``maxLine`` bytes are left out; a last
    line without its newline waits for the next batch. A file that was replaced is read from its start after the rest of the old one, if
    that is still open; one that became shorter is read from its start."""

    def __init__(self, options):
        self.path = options["path"]
        self.max_line, self.chunk = int(options.get("maxLine", MAX_LINE)), int(options.get("chunk", CHUNK))
        self.at_start = options.get("from", "end") == "start"
        self.file, self.sent = None, {}

    def _stat(self):
        try:
            s = os.stat(self.path)
            return s.st_dev, s.st_ino, s.st_size
        except FileNotFoundError:
            return None

    def initialOffset(self):
        s = self._stat()
        if s is None:
            return {"dev": -1, "ino": -1, "pos": 0}
        if self.file is None:
            self.file = open(self.path, "rb")
        return {"dev": s[0], "ino": s[1], "pos": 0 if self.at_start else s[2]}

    def _lines(self, f, pos: int) -> tuple[list[str], int]:
        """Lines from ``pos`` on of about a chunk, and where the next one begins."""
        f.seek(pos)
        data = f.read(max(self.chunk, self.max_line + 1))
        end = data.rfind(b"\n") + 1
        if not end:
            # no newline: a line that is too long already is skipped as far as it has come, marked by a negative place
            return [], pos
        good = [x for x in data[:end].split(b"\n") if x.strip() and len(x) <= self.max_line]
        return [x.decode("utf-8", "replace").rstrip("\r") for x in good], pos + end

    def _skip_long(self, f, pos: int) -> int:
        """The place after a line over the limit, or ``pos`` if its end isn't there yet."""
        f.seek(pos)
        at = pos
        while data := f.read(self.chunk):
            cut = data.find(b"\n")
            if cut >= 0:
                return at + cut + 1
            at += len(data)
        return pos

    def read(self, start):
        now = self._stat()
        dev, ino, pos = start["dev"], start["ino"], start["pos"]
        rows: list[str] = []
        if self.file is not None and os.fstat(self.file.fileno()).st_ino != ino:
            self.file.close()
            self.file = None
        if now and (now[0], now[1]) == (dev, ino):
            if self.file is None:
                self.file = open(self.path, "rb")
            if now[2] < pos:
                pos = 0
            rows, end = self._lines(self.file, pos)
            if end == pos and now[2] - pos > self.max_line:
                end = self._skip_long(self.file, pos)
            pos = end
        else:
            if self.file is not None:
                rows, end = self._lines(self.file, pos)
                if end > pos:
                    return self._out(start, rows, {"dev": dev, "ino": ino, "pos": end})
                self.file.close()
                self.file = None
            if now:
                self.file = open(self.path, "rb")
                dev, ino = now[0], now[1]
                rows, pos = self._lines(self.file, 0)
        return self._out(start, rows, {"dev": dev, "ino": ino, "pos": pos})

    def _out(self, start, rows, end):
        self.sent[str(start), str(end)] = rows
        return iter([(x,) for x in rows]), end

    def readBetweenOffsets(self, start, end):
        if (str(start), str(end)) in self.sent:
            return iter([(x,) for x in self.sent[str(start), str(end)]])
        same = (start["dev"], start["ino"]) == (end["dev"], end["ino"])
        begin = start["pos"] if same and start["pos"] <= end["pos"] else 0
        with open(self.path, "rb") as f:
            f.seek(begin)
            data = f.read(end["pos"] - begin)
        return iter([(x.decode("utf-8", "replace").rstrip("\r"),) for x in data.split(b"\n") if x.strip() and len(x) <= self.max_line])

    def commit(self, end):
        self.sent.clear()


class FileTail(DataSource):
    """``spark.readStream.format("file_tail").option("path", ...)``: (message)."""

    @classmethod
    def name(cls):
        return "file_tail"

    def schema(self):
        return "message string"

    def simpleStreamReader(self, schema):
        return TailReader(self.options)


def _events(rows: DataFrame, name: str, hostname: str | None) -> DataFrame:
    return rows.select(F.localtimestamp().alias("ts"), F.lit(name).alias("input"), F.lit(hostname or socket.gethostname()).alias("hostname"), "message")


@register("source", "file")
def tail_file(spark: SparkSession, path: str, name: str = "file", hostname: str | None = None, **options) -> DataFrame:
    """A stream of events from a file that grows on the driver's machine."""
    spark.dataSource.register(FileTail)
    return _events(spark.readStream.format("file_tail").options(path=path, **{k: str(v) for k, v in options.items()}).load(), name, hostname)


@register("source", "folder")
def landing_folder(spark: SparkSession, path: str, name: str = "folder", hostname: str | None = None, stream: bool = True, files_per_batch: int = 1000) -> DataFrame:
    """Lines of whole files in a folder that all executors see, as a stream or as they are now. This is how many hosts' logs come in."""
    reader = spark.readStream.option("maxFilesPerTrigger", files_per_batch) if stream else spark.read
    rows = reader.format("text").load(path).select(F.col("value").alias("message")).filter(F.trim("message") != "")
    return _events(rows, name, hostname)


@register("source", "collect")
def collect(spark: SparkSession, path: str, schema: str, stream: bool = True, format: str = "parquet") -> DataFrame:
    """Events that other servers forward into a shared folder (see sources.store.forward)."""
    reader = spark.readStream if stream else spark.read
    return reader.format(format).schema(schema).option("recursiveFileLookup", True).load(path)


CSV = ["ts", "input", "hostname", "id", "default"]


def save_csv(rows: DataFrame, path: str, names: list[str]) -> None:
    """Results as CSV with a header: time, input, host, id, default value, then the other fields by name. ``names``: those to write."""
    f = F.col("fields")
    others = [n for n in sorted(names) if n not in ("input", "hostname")]
    rows = rows.select(
        F.date_format(F.timestamp_seconds("evid.ts"), "yyyy-MM-dd'T'HH:mm:ss'Z'").alias("ts"), f["input"].alias("input"), f["hostname"].alias("hostname"), evid_string("evid.ts", "evid.offset").alias("id"), F.col("default_value").alias("default"), *(f[n].alias(n) for n in others),
    )
    rows.write.option("header", True).option("escape", '"').option("nullValue", "\\N").mode("overwrite").csv(path)


def load_csv(spark: SparkSession, path: str) -> DataFrame:
    """What save_csv wrote, as results again."""
    from ..functions.evid import from_string

    rows = spark.read.option("header", True).option("escape", '"').option("nullValue", "\\N").option("multiLine", True).csv(path)
    names = [c for c in rows.columns if c not in ("ts", "id", "default")]
    m = F.map_filter(F.create_map(*(x for n in names for x in (F.lit(n), F.col(n)))), lambda _, v: v.isNotNull())
    return rows.select(from_string(F.col("id")).alias("evid"), F.lit("message").alias("default_field"), F.col("default").alias("default_value"), m.alias("fields"))
