"""A data source that writes files and reads them: a row is a file, with a text twin beside it.

Rows of (file string, content binary, text string) are written below the path: file names it, with its folders. Where text is not
null it goes to a twin of the same stem that ends in .txt. Tasks write into a folder of their attempt in a staging folder. When the
job commits, the attempts that Spark took are moved into place, and the staging folder goes; when it aborts nothing stays but what
was there before. The path must be a folder that the driver and all executors have mounted, since Python writes the files.

Defined cases: a null content writes the twin alone; a row with a null file, one that leads out of the path, or one that stands
twice in a task fails the job; of one that stands in two tasks the later move stays. Mode overwrite replaces files of the same
name and leaves others.

Read, the rows are (file string, content binary), twins among them, of all files below the path but those of the staging folders. The
driver counts the files of each folder and keeps no names; a task goes through its folder's names and reads its slice of them, so
neither the driver nor a task grows with the files. Empty files are rows as well.
"""

from __future__ import annotations

import os
import shutil
import uuid
import zlib
from collections.abc import Iterator
from dataclasses import dataclass

from pyspark.sql.datasource import DataSource, DataSourceReader, DataSourceWriter, InputPartition, WriterCommitMessage
from pyspark.sql.types import Row, StructType

SCHEMA = "file string, content binary, text string"
READ_SCHEMA = "file string, content binary"
STAGING = "_staging-"
#: About so many files are read by a task, and at most so many, or so many bytes and one file, are handed on at once.
FILES_A_TASK, FILES_AT_ONCE, BYTES_AT_ONCE = 10_000, 1_000, 1 << 24


@dataclass
class Attempt(WriterCommitMessage):
    folder: str
    files: int


def local(path: str) -> str:
    if "://" in path and not path.startswith("file://"):
        raise ValueError(f"{path} is no mounted folder")
    return os.path.abspath(path.removeprefix("file://").removeprefix("file:"))


class FileLayoutWriter(DataSourceWriter):
    def __init__(self, path: str):
        self.path = local(path)
        self.staging = f"{self.path}/{STAGING}{uuid.uuid4().hex}"

    def write(self, iterator: Iterator[Row]) -> Attempt:
        folder, n = f"{self.staging}/{uuid.uuid4().hex}", 0
        os.makedirs(folder)
        for row in iterator:
            at = os.path.normpath(f"{folder}/{row['file']}")
            if row["file"] is None or not at.startswith(f"{folder}/"):
                raise ValueError(f"no name for a file below the folder: {row['file']!r}")
            os.makedirs(os.path.dirname(at), exist_ok=True)
            if row["content"] is not None:
                with open(at, "xb") as f:
                    f.write(row["content"])
            if row["text"] is not None:
                with open(f"{os.path.splitext(at)[0]}.txt", "x", encoding="utf-8", newline="") as f:
                    f.write(row["text"])
            n += 1
        return Attempt(folder, n)

    def commit(self, messages: list[Attempt | None]) -> None:
        for message in messages:
            for folder, _, names in os.walk(message.folder) if message else ():
                to = os.path.join(self.path, os.path.relpath(folder, message.folder))
                os.makedirs(to, exist_ok=True)
                for name in names:
                    os.replace(os.path.join(folder, name), os.path.join(to, name))
        shutil.rmtree(self.staging, ignore_errors=True)

    def abort(self, messages: list[Attempt | None]) -> None:
        shutil.rmtree(self.staging, ignore_errors=True)
        if os.path.isdir(self.path) and not os.listdir(self.path):
            os.rmdir(self.path)


@dataclass
class Slices(InputPartition):
    """Folders below the path, each with the slice of its names that is read and the number of slices."""

    folders: list[tuple[str, int, int]]


class FileLayoutReader(DataSourceReader):
    def __init__(self, path: str, columns: list[str]):
        if not set(columns) <= {"file", "content"}:
            raise ValueError(f"read as {READ_SCHEMA}, not {columns}")
        self.path, self.columns = local(path), columns

    def partitions(self) -> list[Slices]:
        found, held, files, left = [], [], 0, [""]
        while left:
            folder, n = left.pop(), 0
            with os.scandir(os.path.join(self.path, folder)) as entries:
                for entry in entries:
                    if not entry.is_dir():
                        n += 1
                    elif folder or not entry.name.startswith(STAGING):
                        left.append(os.path.join(folder, entry.name))
            of = -(-n // FILES_A_TASK)
            if of > 1:
                found += [Slices([(folder, i, of)]) for i in range(of)]
            elif n:
                held.append((folder, 0, 1))
                files += n
            if files >= FILES_A_TASK or held and not left:
                found.append(Slices(held))
                held, files = [], 0
        return found or [Slices([])]

    def read(self, partition: Slices) -> Iterator:
        import pyarrow as pa

        types = {"file": pa.string(), "content": pa.binary()}
        batch = lambda rows: pa.RecordBatch.from_arrays([pa.array([r[c] for r in rows], types[c]) for c in self.columns], names=self.columns)
        rows, size = [], 0
        for folder, i, of in partition.folders:
            with os.scandir(os.path.join(self.path, folder)) as entries:
                for entry in entries:
                    if zlib.crc32(os.fsencode(entry.name)) % of != i or entry.is_dir():
                        continue
                    content = b""
                    if "content" in self.columns:
                        with open(entry.path, "rb") as f:
                            content = f.read()
                    rows.append({"file": os.path.join(folder, entry.name), "content": content})
                    size += len(content)
                    if len(rows) >= FILES_AT_ONCE or size >= BYTES_AT_ONCE:
                        yield batch(rows)
                        rows, size = [], 0
        if rows:
            yield batch(rows)


class FileLayout(DataSource):
    @classmethod
    def name(cls) -> str:
        return "file_layout"

    def schema(self) -> str:
        return SCHEMA

    def reader(self, schema: StructType) -> DataSourceReader:
        return FileLayoutReader(self.options["path"], schema.names)

    def writer(self, schema: StructType, overwrite: bool) -> DataSourceWriter:
        return FileLayoutWriter(self.options["path"])
