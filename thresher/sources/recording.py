"""Recorded responses as a data source: folders of JSON lines.

    register(spark)
    spark.read.format("recording").option("target", "1048576").load("file:///shared/recorded")
    responses.write.format("recording").mode("append").save("file:///shared/recorded")

Files are read by ranges of bytes, a task each, so one large file is read by many tasks.
Filters on url are pushed down, which register() allows for the session: lines of other
URLs are passed over before they are parsed. Tasks write to a folder of their own
run; only the commit moves their files to where readers look, and an abort deletes them. The
folder must be one that driver and executors see, in any file system that pyarrow knows.
"""

from __future__ import annotations

import base64
import io
import json
import uuid
from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyarrow import fs
from pyspark.sql import SparkSession
from pyspark.sql.datasource import DataSource, DataSourceReader, DataSourceWriter, EqualTo, Filter, In, InputPartition, WriterCommitMessage
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import Row, StructType

SCHEMA = (
    "url string, status_code int, headers map<string, array<string>>, body binary, final_url string, redirects array<string>, error_code string, error_message string"
)
TARGET, BATCH_ROWS, BATCH_BYTES = 64 << 20, 1000, 4 << 20
_RUNS = "_runs"


def register(spark: SparkSession) -> None:
    """Makes the format known, and lets filters reach Python data sources."""
    spark.conf.set("spark.sql.python.filterPushdown.enabled", "true")
    spark.dataSource.register(Recording)


@dataclass
class Range(InputPartition):
    """The lines of a file that start in [first, stop)."""

    path: str
    first: int
    stop: int


@dataclass
class Written(WriterCommitMessage):
    files: list[str]


class Recording(DataSource):
    """Options: path, and target, the bytes of a range."""

    @classmethod
    def name(cls) -> str:
        return "recording"

    def schema(self) -> str:
        return SCHEMA

    def reader(self, schema: StructType) -> RecordingReader:
        return RecordingReader(self.options["path"], int(self.options.get("target", TARGET)), schema)

    def writer(self, schema: StructType, overwrite: bool) -> RecordingWriter:
        if overwrite:
            raise ValueError("a recording is only appended to")
        return RecordingWriter(self.options["path"], schema)


class RecordingReader(DataSourceReader):
    def __init__(self, folder: str, target: int, schema: StructType):
        self.folder, self.target, self.schema, self.urls = folder, target, schema, None

    def pushFilters(self, filters: list[Filter]) -> Iterator[Filter]:
        """Equality with one or several URLs is taken over; Spark keeps the rest."""
        for f in filters:
            wanted = {f.value} if isinstance(f, EqualTo) else set(f.value) if isinstance(f, In) else None
            if wanted is None or f.attribute != ("url",):
                yield f
            else:
                self.urls = wanted if self.urls is None else self.urls & wanted

    def partitions(self) -> list[Range]:
        system, root = fs.FileSystem.from_uri(self.folder)
        files = [f for f in system.get_file_info(fs.FileSelector(root, allow_not_found=True)) if f.is_file and f.base_name.endswith(".jsonl") and f.size]
        return [Range(f.path, at, min(at + self.target, f.size)) for f in sorted(files, key=lambda f: f.path) for at in range(0, f.size, self.target)] or [Range("", 0, 0)]

    def read(self, partition: Range) -> Iterator[pa.RecordBatch]:
        arrow, rows, size = to_arrow_schema(self.schema), [], 0
        marks = None if self.urls is None else [json.dumps(u, ensure_ascii=False).encode() for u in self.urls]
        for line in _lines(self.folder, partition):
            if marks is not None and not any(m in line for m in marks):
                continue
            row = json.loads(line)
            if self.urls is not None and row["url"] not in self.urls:
                continue
            row["body"] = None if row.get("body") is None else base64.b64decode(row["body"])
            row["headers"] = None if row.get("headers") is None else list(row["headers"].items())
            rows.append({name: row.get(name) for name in arrow.names})
            size += len(line)
            if len(rows) >= BATCH_ROWS or size >= BATCH_BYTES:
                yield pa.RecordBatch.from_pylist(rows, arrow)
                rows, size = [], 0
        if rows:
            yield pa.RecordBatch.from_pylist(rows, arrow)


def _lines(folder: str, part: Range) -> Iterator[bytes]:
    if part.stop <= part.first:
        return
    system, _ = fs.FileSystem.from_uri(folder)
    with io.BufferedReader(system.open_input_file(part.path), 1 << 20) as raw:
        at = part.first
        if at:  # a line that began before belongs to the range before
            raw.seek(at - 1)
            at += len(raw.readline()) - 1
        raw.seek(at)
        while at < part.stop and (line := raw.readline()):
            at += len(line)
            yield line


class RecordingWriter(DataSourceWriter):
    def __init__(self, folder: str, schema: StructType):
        self.folder, self.names, self.run = folder, schema.fieldNames(), uuid.uuid4().hex
        if missing := {"url"} - set(self.names):
            raise ValueError(f"a recording needs {sorted(missing)}")

    def _at(self, *more: str) -> tuple[fs.FileSystem, str]:
        system, root = fs.FileSystem.from_uri(self.folder)
        return system, "/".join([root, *more])

    def write(self, iterator: Iterator[Row]) -> Written:
        system, run = self._at(_RUNS, self.run)
        system.create_dir(run, recursive=True)
        path = f"{run}/{uuid.uuid4().hex}.jsonl"
        n = 0
        with system.open_output_stream(path) as out:
            for row in iterator:
                one = row.asDict(recursive=True)
                one["body"] = None if one.get("body") is None else base64.b64encode(bytes(one["body"])).decode()
                out.write(json.dumps(one, ensure_ascii=False).encode() + b"\n")
                n += 1
        return Written([path] if n else [])

    def commit(self, messages: list[Written | None]) -> None:
        """What tasks reported is moved to where readers look; files of lost or repeated attempts go with the run's folder."""
        system, root = self._at()
        for path in (f for m in messages if m is not None for f in m.files):
            system.move(path, f"{root}/{path.rsplit('/', 1)[1]}")
        self.abort(messages)

    def abort(self, messages: list[Written | None]) -> None:
        system, run = self._at(_RUNS, self.run)
        if system.get_file_info(run).type == fs.FileType.Directory:
            system.delete_dir(run)
