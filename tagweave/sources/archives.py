"""Repository archives as a data source: a partition for each archive in a batch, new archives in a stream."""

from __future__ import annotations

import io
import tarfile
from collections.abc import Iterator

import pyarrow as pa
import pyarrow.fs as pafs
from pyspark.sql import SparkSession
from pyspark.sql.datasource import DataSource, DataSourceReader, DataSourceStreamReader, InputPartition

from tagweave.plans.scratch import ship

SCHEMA = "archive string, path string, size long, modified timestamp, content string"
#: Endings of archives.
ENDINGS = (".tar.gz", ".tgz", ".tar")
#: Bytes of content that a batch of rows holds, about.
HELD = 8 << 20


class _Archive(InputPartition):
    def __init__(self, path: str, changed: int) -> None:
        self.path, self.changed = path, changed


def _system(path: str) -> tuple[pafs.FileSystem, str]:
    return pafs.FileSystem.from_uri(path if "://" in path else f"file://{path.removeprefix('file:')}")


def _listed(path: str) -> list[_Archive]:
    """The archives at a path, a file or a folder, by the time of their change (nanoseconds) and then by name."""
    system, base = _system(path)
    info = system.get_file_info(base)
    found = system.get_file_info(pafs.FileSelector(base, recursive=True)) if info.type == pafs.FileType.Directory else [info] if info.type == pafs.FileType.File else []
    made = [_Archive(f.path, int(f.mtime_ns or 0)) for f in found if f.type == pafs.FileType.File and f.path.endswith(ENDINGS)]
    return sorted(made, key=lambda a: (a.changed, a.path))


def _rows(path: str, base: str) -> Iterator[pa.RecordBatch]:
    """The text files of one archive, without their top folder, read as a stream; other members are passed over."""
    system, _ = _system(base)
    columns: list[list] = [[], [], [], [], []]
    held = 0

    def batch() -> pa.RecordBatch:
        kinds = [pa.string(), pa.string(), pa.int64(), pa.timestamp("us", "UTC"), pa.string()]
        return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds, strict=True)], names=["archive", "path", "size", "modified", "content"])

    with system.open_input_stream(path, compression=None) as raw, tarfile.open(fileobj=io.BufferedReader(_Stream(raw)), mode="r|*") as tar:
        for member in tar:
            name = member.name.partition("/")[2]
            if member.isfile() and name:
                content = tar.extractfile(member).read().decode("utf-8", "replace")
                for column, value in zip(columns, (path, name, member.size, member.mtime * 1_000_000, content), strict=True):
                    column.append(value)
                held += member.size
                if held > HELD:
                    yield batch()
                    columns, held = [[], [], [], [], []], 0
    if columns[0]:
        yield batch()


class _Stream(io.RawIOBase):
    """An Arrow input stream as Python has them."""

    def __init__(self, raw: pa.NativeFile) -> None:
        self.raw = raw

    def readable(self) -> bool:
        return True

    def readinto(self, into: memoryview) -> int:
        got = self.raw.read(len(into))
        into[: len(got)] = got
        return len(got)


class _Batch(DataSourceReader):
    def __init__(self, path: str) -> None:
        self.path = path

    def partitions(self) -> list[InputPartition]:
        return _listed(self.path)

    def read(self, partition: _Archive) -> Iterator[pa.RecordBatch]:
        if partition is not None and partition.path:
            yield from _rows(partition.path, self.path)


class _Following(DataSourceStreamReader):
    """Archives by the time of their change: an offset is the last time and the names that had it."""

    def __init__(self, path: str) -> None:
        self.path = path

    def initialOffset(self) -> dict:
        return {"changed": -1, "names": []}

    def latestOffset(self) -> dict:
        found = _listed(self.path)
        if not found:
            return self.initialOffset()
        last = found[-1].changed
        return {"changed": last, "names": [a.path for a in found if a.changed == last]}

    def partitions(self, start: dict, end: dict) -> list[InputPartition]:
        after = lambda a, o: a.changed > o["changed"] or a.changed == o["changed"] and a.path not in o["names"]
        return [a for a in _listed(self.path) if after(a, start) and not after(a, end)]

    def read(self, partition: _Archive) -> Iterator[pa.RecordBatch]:
        yield from _rows(partition.path, self.path)


class Archives(DataSource):
    """Format `repository_archives`: SCHEMA rows of the tar archives at a path.

    An archive is one task, read as a stream, member by member. A stream gives an archive again when it has changed, so
    that who replaces a repository's sources with each archive keeps what is there.
    """

    @classmethod
    def name(cls) -> str:
        return "repository_archives"

    def schema(self) -> str:
        return SCHEMA

    def reader(self, schema) -> DataSourceReader:
        return _Batch(self.options["path"])

    def streamReader(self, schema) -> DataSourceStreamReader:
        return _Following(self.options["path"])


def register(spark: SparkSession) -> None:
    """Makes the format known to the session."""
    ship(spark)
    spark.dataSource.register(Archives)
