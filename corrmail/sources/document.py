"""Single files that tasks write in parts: one CSV with one byte order mark, one JSON document.

Each task writes the lines of its partition to a part of its own.  When all have ended, the parts are joined in order
behind a head and before a tail, in blocks, and the file gets its name last: readers see no half of it.  The rows never
are in the driver's memory; the bytes pass it once, as they must to become one file.
"""

from __future__ import annotations

import json
import uuid
from collections.abc import Iterator
from dataclasses import dataclass
from datetime import datetime

from pyarrow import fs as arrow_fs
from pyspark import TaskContext
from pyspark.sql import DataFrame, Row
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceWriter, WriterCommitMessage
from pyspark.sql.types import StructType

from corrmail.sources.archive import open_place

BLOCK = 4 << 20


@dataclass
class Part(WriterCommitMessage):
    number: int
    name: str
    rows: int


class DocumentWriter(DataSourceWriter):
    def __init__(self, options: dict[str, str], overwrite: bool):
        self.path, self.overwrite = options["path"], overwrite
        self.head, self.separator, self.tail = (options.get(k, "").encode() for k in ("head", "separator", "tail"))
        self.parts = f"{self.path}._parts-{uuid.uuid4().hex}"

    def write(self, iterator: Iterator[Row]) -> Part:
        system, place = open_place(self.parts)
        system.create_dir(place, recursive=True)
        name, rows = uuid.uuid4().hex, 0  # another try of the same task writes another part
        with system.open_output_stream(f"{place}/{name}") as file:
            for row in iterator:
                file.write((self.separator if rows else b"") + (row["value"] or "").encode())
                rows += 1
        return Part(TaskContext.get().partitionId(), name, rows)

    def commit(self, messages: list[Part | None]) -> None:
        system, place = open_place(self.parts)
        _, target = open_place(self.path)
        if not self.overwrite and system.get_file_info(target).type != arrow_fs.FileType.NotFound:
            self.abort(messages)
            raise FileExistsError(self.path)
        system.create_dir(place, recursive=True)
        with system.open_output_stream(f"{place}/whole") as out:
            out.write(self.head)
            first = True
            for m in sorted((m for m in messages if m is not None and m.rows), key=lambda m: m.number):
                if not first:
                    out.write(self.separator)
                first = False
                with system.open_input_stream(f"{place}/{m.name}") as part:
                    while block := part.read(BLOCK):
                        out.write(block)
            out.write(self.tail)
        system.move(f"{place}/whole", target)
        system.delete_dir(place)

    def abort(self, messages: list[Part | None]) -> None:
        system, place = open_place(self.parts)
        if system.get_file_info(place).type == arrow_fs.FileType.Directory:
            system.delete_dir(place)


class SingleDocument(DataSource):
    """Rows (value string) as one file; options head, separator, tail."""

    @classmethod
    def name(cls) -> str:
        return "single_document"

    def schema(self) -> str:
        return "value string"

    def writer(self, schema: StructType, overwrite: bool) -> DocumentWriter:
        return DocumentWriter(self.options, overwrite)


def write_document(lines: DataFrame, path: str, head: str = "", separator: str = "\n", tail: str = "") -> None:
    """The rows of ``lines`` (value), in the order of their partitions, as one file."""
    lines.sparkSession.dataSource.register(SingleDocument)
    lines.select("value").write.format("single_document").options(head=head, separator=separator, tail=tail).mode("overwrite").save(path)


def write_csv_file(frame: DataFrame, path: str, order: str | None = None) -> None:
    """One CSV file with a byte order mark and a header; ``order`` names the column that gives the order of the rows."""
    rows = frame.repartitionByRange(F.col(order).cast("long")).sortWithinPartitions(F.col(order).cast("long")) if order else frame
    cells = [F.coalesce(F.col(f"`{c}`").cast("string"), F.lit("")) for c in frame.columns]
    # a cell is quoted where it holds a separator, a quote or a line end
    quoted = [F.when(c.rlike('[",\r\n]'), F.concat(F.lit('"'), F.replace(c, F.lit('"'), F.lit('""')), F.lit('"'))).otherwise(c) for c in cells]
    names = ",".join(f'"{c.replace(chr(34), chr(34) * 2)}"' if any(x in c for x in '",\r\n') else c for c in frame.columns)
    write_document(rows.select(F.concat_ws(",", *quoted).alias("value")), path, head=f"﻿{names}\n", tail="\n")


def write_json_file(merged: DataFrame, stats: DataFrame, path: str, when: datetime | None = None) -> None:
    """One JSON document: ``export_time``, ``stats`` (one row of counters), ``teachers`` in the order of ``index``."""
    counters = json.loads(stats.select(F.to_json(F.struct(*stats.columns), {"ignoreNullFields": "false"})).first()[0])
    head = json.dumps({"export_time": (when or datetime.now()).isoformat(), "stats": counters}, ensure_ascii=False, indent=2)
    rows = merged.repartitionByRange("index").sortWithinPartitions("index") if "index" in merged.columns else merged
    lines = rows.select(F.to_json(F.struct(*merged.columns), {"ignoreNullFields": "false"}).alias("value"))
    write_document(lines, path, head=head[:-2] + ',\n  "teachers": [\n    ', separator=",\n    ", tail="\n  ]\n}\n")
