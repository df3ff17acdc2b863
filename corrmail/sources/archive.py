"""Message archives (mbox files) as a data source: byte ranges in parallel, filters that choose ranges, exact bytes.

A message is known by its file and the place of its first byte: ``uid`` is that place plus one, so a growing archive
gives growing uids and ``uid > n`` reads only what follows.  Files that this source wrote (or ``index_archive`` read)
have a list of ranges beside them with the least and largest date of each, so a filter on ``sent_at`` opens only
ranges that can hold such messages; without a list all ranges are read.  Spark applies all filters again.
"""

from __future__ import annotations

import email.parser
import email.utils
import json
import time
import uuid
import zlib
from collections.abc import Callable, Iterator
from dataclasses import dataclass
from datetime import datetime, timezone

import pyarrow as pa
from pyarrow import fs as arrow_fs
from pyspark.sql import DataFrame, Row, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, DataSourceWriter, Filter, InputPartition, WriterCommitMessage
from pyspark.sql.types import StructType

SCHEMA = "file string, epoch long, uid long, sent_at timestamp, content binary"
#: Bytes of a range, of one read, and of messages handed on together.
RANGE, READ, BATCH = 64 << 20, 1 << 20, 8 << 20
#: Tries for a range that cannot be read, and seconds between them.
TRIES, DELAY = 3, 5.0
FROM = b"From "
_EPOCH = datetime(1970, 1, 1, tzinfo=timezone.utc)


def open_place(path: str) -> tuple[arrow_fs.FileSystem, str]:
    """The file system of a path or address, and the path in it."""
    if "://" in path or path.startswith("file:"):
        return arrow_fs.FileSystem.from_uri("file://" + path[5:] if path.startswith("file:/") and not path.startswith("file://") else path)
    return arrow_fs.LocalFileSystem(), path


def unquoted(body: bytes) -> bytes:
    """``>From `` at a line's start loses one mark."""
    if b">From " not in body:
        return body
    lines = body.split(b"\n")
    return b"\n".join([x[1:] if x.startswith(b">") and x.lstrip(b">").startswith(FROM) else x for x in lines])


def quoted(body: bytes) -> bytes:
    if FROM not in body:
        return body
    return b"\n".join([b">" + x if x.lstrip(b">").startswith(FROM) else x for x in body.split(b"\n")])


def sent_at(content: bytes) -> datetime | None:
    """The date header in UTC; none if it is missing or no date."""
    head = content[: 64 << 10].split(b"\r\n\r\n" if b"\r\n\r\n" in content[: 64 << 10] else b"\n\n", 1)[0]
    try:
        value = email.parser.BytesHeaderParser().parsebytes(head + b"\n\n").get("Date")
        when = email.utils.parsedate_to_datetime(str(value))
        return (when if when.tzinfo else when.replace(tzinfo=timezone.utc)).astimezone(timezone.utc)
    except (TypeError, ValueError, OverflowError):
        return None


def split_messages(read: Callable[[int, int], bytes], start: int, end: int) -> Iterator[tuple[int, bytes]]:
    """(place, bytes) of the messages that begin in [start, end); ``read(at, n)`` gives bytes of the file.

    The last one may go on beyond ``end``.  The line that begins a message and the blank line after it are not part of it.
    """
    at = max(0, start - 1)  # a From line begins after a line feed, or the file
    held = b"\n" if start == 0 else b""
    base = at - len(held)  # place of held[0]
    begun, search = None, 0
    while True:
        found = held.find(b"\n" + FROM, search)
        if found >= 0:
            if begun is not None:
                yield begun, _message(held[begun - base : found], False)
            begun = base + found + 1
            if begun >= end:
                return
            held, base, search = held[begun - base :], begun, 1
            continue
        if begun is None and at >= end + len(FROM):  # nothing begins in this range
            return
        search = max(0, len(held) - len(FROM))
        if begun is None and search:
            held, base, search = held[search:], base + search, 0
        more = read(at, READ)
        if not more:
            if begun is not None:
                yield begun, _message(held[begun - base :], True)
            return
        at += len(more)
        held += more


def _message(raw: bytes, last: bool) -> bytes:
    line = raw.find(b"\n")
    body = raw[line + 1 :] if line >= 0 else b""
    if last and body.endswith(b"\n\n"):
        body = body[:-1]
    elif last and body.endswith(b"\r\n\r\n"):
        body = body[:-2]
    elif not last and body.endswith(b"\r\n\r"):
        body = body[:-1]
    return unquoted(body)


@dataclass
class Range(InputPartition):
    file: str
    epoch: int
    start: int
    end: int

    def __post_init__(self) -> None:
        super().__init__(None)


class RangeFile:
    """Reads of a file, each tried a bounded number of times; the file is opened anew after a failure."""

    def __init__(self, path: str, tries: int, delay: float, opened: Callable[[str], object] | None = None):
        self.path, self.tries, self.delay, self.file = path, max(tries, 1), delay, None
        self._open = opened or self._input

    @staticmethod
    def _input(path: str) -> object:
        system, place = open_place(path)
        return system.open_input_file(place)

    def read(self, at: int, n: int) -> bytes:
        for left in range(self.tries - 1, -1, -1):
            try:
                if self.file is None:
                    self.file = self._open(self.path)
                self.file.seek(at)
                return self.file.read(n)
            except FileNotFoundError:
                raise
            except OSError:
                self.close()
                if not left:
                    raise
                time.sleep(self.delay)
        return b""

    def close(self) -> None:
        if self.file is not None:
            self.file.close()
        self.file = None


class ArchiveReader(DataSourceReader):
    def __init__(self, options: dict[str, str]):
        self.path = options["path"]
        self.size = int(options.get("rangeBytes", RANGE))
        self.tries, self.delay = int(options.get("tries", TRIES)), float(options.get("delay", DELAY))
        #: Bounds that filters give: [least, most] uid, [least, most] microseconds, and the files asked for.
        self.uids, self.dates, self.files = [1, None], [None, None], None

    def pushFilters(self, filters: list[Filter]) -> Iterator[Filter]:  # noqa: N802
        for f in filters:
            self._take(f)
            yield f  # ranges hold other rows too, so Spark filters again

    def _take(self, f: Filter) -> None:
        kind, column = type(f).__name__, tuple(getattr(f, "attribute", ()))
        value = getattr(f, "value", None)
        if column == ("file",) and kind in ("EqualTo", "In"):
            wanted = {value} if kind == "EqualTo" else set(value)
            self.files = wanted if self.files is None else self.files & wanted
        if column == ("uid",) and isinstance(value, int):
            step, bounds = 1, self.uids
        elif column == ("sent_at",) and isinstance(value, datetime):
            step, bounds = 0, self.dates  # a date bound may stay one wider
            value = _micros(value)
        else:
            return
        if kind in ("GreaterThan", "GreaterThanOrEqual", "EqualTo"):
            least = value + (step if kind == "GreaterThan" else 0)
            bounds[0] = least if bounds[0] is None else max(bounds[0], least)
        if kind in ("LessThan", "LessThanOrEqual", "EqualTo"):
            most = value - (step if kind == "LessThan" else 0)
            bounds[1] = most if bounds[1] is None else min(bounds[1], most)

    def partitions(self) -> list[Range]:
        out = []
        for path, size in _files(self.path):
            if self.files is not None and path not in self.files:
                continue
            epoch = archive_epoch(path)
            for start, end, dates in self._ranges(path, size):
                least, most = self.uids
                if end > least - 1 and (most is None or start <= most - 1) and self._within(dates):
                    out.append(Range(path, epoch, max(start, least - 1), end if most is None else min(end, most)))
        return out or [Range("", 0, 0, 0)]

    def _ranges(self, path: str, size: int) -> Iterator[tuple[int, int, list | None]]:
        """Listed ranges, each cut to the size asked for, then what has been added since."""
        at = 0
        for start, end, least, most in read_index(path):
            if end > size:
                break
            yield start, end, [least, most]
            at = end
        while at < size:
            yield at, min(size, at + self.size), None
            at += self.size

    def _within(self, dates: list | None) -> bool:
        low, high = self.dates
        if dates is None or (low is None and high is None):
            return True
        if dates[0] is None:  # no message of the range has a date
            return False
        return (low is None or dates[1] >= low) and (high is None or dates[0] <= high)

    def read(self, partition: Range) -> Iterator[pa.RecordBatch]:
        if partition.start >= partition.end:
            return
        file = RangeFile(partition.file, self.tries, self.delay)
        rows: list[tuple] = []
        size = 0
        try:
            for place, content in split_messages(file.read, partition.start, partition.end):
                rows.append((place + 1, sent_at(content), content))
                size += len(content)
                if size >= BATCH:
                    yield _batch(partition, rows)
                    rows, size = [], 0
        finally:
            file.close()
        if rows:
            yield _batch(partition, rows)


def _batch(partition: Range, rows: list[tuple]) -> pa.RecordBatch:
    uid, when, content = zip(*rows)
    columns = [pa.array([partition.file] * len(rows)), pa.array([partition.epoch] * len(rows), pa.int64()), pa.array(uid, pa.int64())]
    columns += [pa.array(when, pa.timestamp("us", "UTC")), pa.array(content, pa.binary())]
    return pa.RecordBatch.from_arrays(columns, names=["file", "epoch", "uid", "sent_at", "content"])


def _micros(when: datetime) -> int:
    when = when if when.tzinfo else when.astimezone()
    d = when - _EPOCH
    return (d.days * 86400 + d.seconds) * 1_000_000 + d.microseconds


def _files(path: str) -> list[tuple[str, int]]:
    """(path, size) of an mbox file, or of all below a folder; names that begin with ``_`` or ``.`` are not data."""
    system, place = open_place(path)
    info = system.get_file_info(place)
    if info.type == arrow_fs.FileType.NotFound:
        raise FileNotFoundError(path)
    found = [info] if info.type == arrow_fs.FileType.File else system.get_file_info(arrow_fs.FileSelector(place, recursive=True))
    prefix = path[: len(path) - len(place)] if path.endswith(place) else ""
    hidden = lambda p: any(x.startswith(("_", ".")) for x in p[len(place) :].split("/") if x)
    return sorted((prefix + f.path, f.size) for f in found if f.type == arrow_fs.FileType.File and not f.path.endswith(".ranges") and (f is info or not hidden(f.path)))


def archive_epoch(path: str) -> int:
    """A number that stays while an archive only grows: a check sum of its first line."""
    file = RangeFile(path, 1, 0)
    try:
        return zlib.crc32(file.read(0, 256).split(b"\n", 1)[0]) or 1
    finally:
        file.close()


def read_index(path: str) -> list[tuple]:
    """(start, end, least date, largest date in microseconds) of the listed ranges of an archive, none without a list."""
    system, place = open_place(path)
    if system.get_file_info(place + ".ranges").type == arrow_fs.FileType.NotFound:
        return []
    with system.open_input_stream(place + ".ranges") as file:
        return [tuple(json.loads(line)) for line in file.read().splitlines()]


def _write(path: str, data: bytes) -> None:
    system, place = open_place(path)
    with system.open_output_stream(place) as file:
        file.write(data)


class _Ranges:
    """The list of ranges of a file whose messages come in order."""

    def __init__(self, size: int):
        self.size, self.rows, self.start, self.dates = size, [], 0, []

    def add(self, when: datetime | None, end: int) -> None:
        if when is not None:
            self.dates = [min([_micros(when), *self.dates[:1]]), max([_micros(when), *self.dates[1:]])]
        if end - self.start >= self.size:
            self.close(end)

    def close(self, end: int) -> None:
        if end > self.start:
            self.rows.append([self.start, end, *(self.dates or [None, None])])
        self.start, self.dates = end, []

    def dump(self) -> bytes:
        return "".join(json.dumps(r) + "\n" for r in self.rows).encode()


@dataclass
class Written(WriterCommitMessage):
    name: str
    rows: int


class ArchiveWriter(DataSourceWriter):
    """Each task writes one file and its list of ranges; they get their names only when all tasks have ended."""

    def __init__(self, options: dict[str, str], overwrite: bool):
        self.path, self.size, self.overwrite = options["path"].rstrip("/"), int(options.get("rangeBytes", RANGE)), overwrite
        self.staging = f"{self.path}/_staging-{uuid.uuid4().hex}"

    def write(self, iterator: Iterator[Row]) -> Written:
        system, place = open_place(self.staging)
        system.create_dir(place, recursive=True)
        name, at, rows, ranges = f"part-{uuid.uuid4().hex}.mbox", 0, 0, _Ranges(self.size)
        with system.open_output_stream(f"{place}/{name}") as file:
            for row in iterator:
                content = bytes(row["content"] or b"")
                when = sent_at(content)
                line = FROM + b"- " + time.asctime((when or _EPOCH).timetuple()).encode() + b"\n"
                body = quoted(content)
                data = line + body + (b"\n" if body.endswith(b"\n") else b"\n\n")
                file.write(data)
                at, rows = at + len(data), rows + 1
                ranges.add(when, at)
        ranges.close(at)
        _write(f"{self.staging}/{name}.ranges", ranges.dump())
        return Written(name, rows)

    def commit(self, messages: list[Written | None]) -> None:
        system, place = open_place(self.path)
        old = _files(self.path) if self.overwrite else []
        for m in messages:
            for end in ("", ".ranges"):
                if m is not None and m.rows:
                    system.move(f"{place}/{self.staging.rsplit('/', 1)[1]}/{m.name}{end}", f"{place}/{m.name}{end}")
        for path, _ in old:
            for end in ("", ".ranges"):
                if system.get_file_info(open_place(path)[1] + end).type == arrow_fs.FileType.File:
                    system.delete_file(open_place(path)[1] + end)
        self._drop()

    def abort(self, messages: list[Written | None]) -> None:
        self._drop()

    def _drop(self) -> None:
        system, place = open_place(self.staging)
        if system.get_file_info(place).type == arrow_fs.FileType.Directory:
            system.delete_dir(place)


class MailArchive(DataSource):
    """``spark.read.format("mail_archive").load(path)``; options rangeBytes, tries, delay."""

    @classmethod
    def name(cls) -> str:
        return "mail_archive"

    def schema(self) -> str:
        return SCHEMA

    def reader(self, schema: StructType) -> ArchiveReader:
        return ArchiveReader(self.options)

    def writer(self, schema: StructType, overwrite: bool) -> ArchiveWriter:
        return ArchiveWriter(self.options, overwrite)


def _registered(spark: SparkSession) -> SparkSession:
    spark.conf.set("spark.sql.python.filterPushdown.enabled", "true")
    spark.dataSource.register(MailArchive)
    return spark


def read_archive(spark: SparkSession, path: str, **options: object) -> DataFrame:
    """(file, epoch, uid, sent_at, content) of all messages; options rangeBytes, tries, delay."""
    return _registered(spark).read.format("mail_archive").options(**options).load(path)


def write_archive(messages: DataFrame, path: str, mode: str = "append", **options: object) -> None:
    """Write the bytes in ``content`` as mbox files, one a partition, in the order of its rows."""
    _registered(messages.sparkSession)
    # the schema of a written frame is the source's; only the content is stored
    rows = messages.select(F.lit("").alias("file"), F.lit(0).cast("long").alias("epoch"), F.lit(0).cast("long").alias("uid"), F.lit(None).cast("timestamp").alias("sent_at"), F.col("content").cast("binary").alias("content"))
    rows.write.format("mail_archive").options(**options).mode(mode).save(path)


def index_archive(spark: SparkSession, path: str, range_bytes: int = RANGE) -> DataFrame:
    """List the ranges of archives that other programs wrote; (file, ranges).  Each range is read where it is.

    One row a range is shuffled; the list of a file has one line for each 64 MB of it.
    """
    rows = read_archive(spark, path, rangeBytes=range_bytes).select("file", (F.col("uid") - 1).alias("place"), "sent_at")
    cut = rows.withColumn("n", F.floor(F.col("place") / range_bytes))
    some = cut.groupBy("file", "n").agg(F.min(F.unix_micros("sent_at")).alias("least"), F.max(F.unix_micros("sent_at")).alias("most"))

    def run(found):
        import pandas as pd

        path, at = found["file"].iloc[0], 0
        lines = []
        size = dict(_files(path))[path]
        number = lambda x: None if pd.isna(x) else int(x)
        for n, least, most in sorted(zip(found["n"], found["least"], found["most"])):
            start, end = int(n) * range_bytes, min(size, (int(n) + 1) * range_bytes)
            if start > at:  # inside one large message nothing begins
                lines.append([at, start, None, None])
            lines.append([start, end, number(least), number(most)])
            at = end
        if at < size:
            lines.append([at, size, None, None])
        _write(path + ".ranges", "".join(json.dumps(x) + "\n" for x in lines).encode())
        return pd.DataFrame({"file": [path], "ranges": [len(lines)]})

    return some.groupBy("file").applyInPandas(run, "file string, ranges long")
