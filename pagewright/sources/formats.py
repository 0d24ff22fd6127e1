"""Document files as a Spark data source: ``document_objects`` reads the relation of objects, ``document_files`` writes files.

``register`` makes both known to a session. Paths are folders that the driver and the executors see alike: local or mounted
ones, or what pyarrow's file systems reach. A store that only Spark's own readers reach is read by ``pdf.files`` instead.
"""

from __future__ import annotations

import hashlib
import os
import posixpath
import uuid
from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyarrow import fs
from pyspark.sql import Row, SparkSession
from pyspark.sql.datasource import DataSource, DataSourceReader, DataSourceWriter, InputPartition, WriterCommitMessage
from pyspark.sql.types import StructType

from . import pdf
from .table import ObjectTable

#: Bytes of files in a partition; a larger file is a partition of its own.
PARTITION_BYTES = 128 << 20
#: Files for a partition at most, as a small file costs time too.
PARTITION_FILES = 2_000
#: Files that are written before they are brought to disk together.
TOGETHER = 256

_WRITTEN = {"file", "content"}


def _opened(path: str) -> tuple[fs.FileSystem, str]:
    return fs.FileSystem.from_uri(path) if "://" in path or path.startswith("file:") else (fs.LocalFileSystem(), os.path.abspath(path))


@dataclass
class Files(InputPartition):
    """Some files of a store, read one after the other."""

    store: str
    paths: list[str]


class ObjectReader(DataSourceReader):
    def __init__(self, options: dict[str, str]):
        self.path = options["path"]
        self.most = int(options.get("partitionbytes", PARTITION_BYTES))
        self.parts = frozenset(options["parts"].split(",")) if "parts" in options else pdf.PARTS
        if unknown := self.parts - pdf.PARTS - {""}:
            raise ValueError(f"parts {sorted(unknown)} are unknown")

    def partitions(self) -> list[Files]:
        """Files by path, in partitions of about equal size."""
        store, base = _opened(self.path)
        found = store.get_file_info(fs.FileSelector(base, recursive=True)) if store.get_file_info(base).type == fs.FileType.Directory else [store.get_file_info(base)]
        out, size = [], self.most
        for info in sorted((x for x in found if x.type == fs.FileType.File and x.path.lower().endswith(".pdf") and not posixpath.basename(x.path).startswith((".", "_"))), key=lambda x: x.path):
            if size + info.size > self.most or len(out[-1].paths) >= PARTITION_FILES:
                out.append(Files(self.path, []))
                size = 0
            out[-1].paths.append(info.path)
            size += info.size
        return out

    def read(self, partition: Files | None) -> Iterator[pa.RecordBatch]:
        if partition is None:  # no file, so no partition was planned
            return
        yield from pdf.parsed(self._files(partition), parts=self.parts)

    def _files(self, partition: Files) -> Iterator[tuple[str, bytes]]:
        store, _ = _opened(partition.store)
        for path in partition.paths:
            with store.open_input_stream(path) as f:
                data = f.read()
            if data[:5] == b"%PDF-":
                yield path, data


class DocumentObjects(DataSource):
    """The rows of ``pdf.objects`` for the files under a path; options partitionBytes, and parts, the dear columns that are wanted (all if not given), with commas."""

    @classmethod
    def name(cls) -> str:
        return "document_objects"

    def schema(self) -> str:
        return pdf._OBJECTS

    def reader(self, schema: StructType) -> ObjectReader:
        return ObjectReader({k.lower(): v for k, v in self.options.items()})


@dataclass
class Staged(WriterCommitMessage):
    """What one task has staged: (staged path, final path)."""

    moves: list[tuple[str, str]]


def _sha256(path: str) -> str:
    with open(path, "rb") as f:
        return hashlib.file_digest(f, "sha256").hexdigest()


class FileWriter(DataSourceWriter):
    """Stages files beside their place, looks at each again, and puts all in place at the end, over none that is there."""

    def __init__(self, path: str, columns: list[str]):
        self.path = os.path.abspath(path.removeprefix("file://").removeprefix("file:"))
        self.staging = f"{self.path}/.staging-{uuid.uuid4().hex}"
        self.columns = columns

    def write(self, rows: Iterator[Row]) -> Staged:
        moves: dict[str, str] = {}
        fresh: list[str] = []
        for row in rows:
            name, content = row["file"], bytes(row["content"] or b"")
            if not name or name != os.path.basename(name) or name.startswith("."):
                raise ValueError(f"{name!r} isn't a file name")
            if name in moves:
                raise FileExistsError(f"{name} comes twice")
            self._check(row, name, content)
            os.makedirs(self.staging, exist_ok=True)
            staged = f"{self.staging}/{uuid.uuid4().hex}.pdf"
            with open(staged, "wb") as f:
                f.write(content)
            moves[name] = staged
            fresh.append(name)
            if len(fresh) == TOGETHER:
                self._settle(fresh, moves)
                fresh = []
        self._settle(fresh, moves)
        return Staged([(staged, f"{self.path}/{name}") for name, staged in moves.items()])

    def _settle(self, fresh: list[str], moves: dict[str, str]) -> None:
        """Each file is on disk, and has objects when it is read again; what the first one waits for has the others' share in it."""
        for name in fresh:
            with open(moves[name], "rb") as f:
                os.fsync(f.fileno())
        for name in fresh:
            with open(moves[name], "rb") as f:
                if not ObjectTable(f.read()).objects:
                    raise ValueError(f"{name} has no objects when read again")

    def _check(self, row: Row, name: str, content: bytes) -> None:
        """A file isn't empty; a changed one is smaller than its source; the source is as it was, and another file."""
        size = row["source_bytes"] if "source_bytes" in self.columns else None
        if not content or (size is not None and len(content) >= size):
            raise ValueError(f"{name} has {len(content)} bytes, its source {size}")
        source = row["source"] if "source" in self.columns else None
        if source and os.path.realpath(source) == os.path.realpath(f"{self.path}/{name}"):
            raise FileExistsError(f"{name} is its own source")
        if source and "source_sha256" in self.columns and row["source_sha256"] and _sha256(source) != row["source_sha256"]:
            raise ValueError(f"the source of {name} has changed")

    def commit(self, messages: list[Staged | None]) -> None:
        """Link every file into place; one that is there already stops it, and what was put in place before goes again."""
        done: list[str] = []
        try:
            for staged, final in (move for m in messages if m for move in m.moves):
                os.link(staged, final)  # fails where the name is taken
                done.append(final)
        except OSError:
            for final in done:
                os.unlink(final)
            raise
        finally:
            self._clear()

    def abort(self, messages: list[Staged | None]) -> None:
        self._clear()

    def _clear(self) -> None:
        if os.path.isdir(self.staging):
            for name in os.listdir(self.staging):
                os.unlink(f"{self.staging}/{name}")
            os.rmdir(self.staging)


class DocumentFiles(DataSource):
    """Writes rows of file (a name) and content as files in the folder of option path, in mode append.

    Optional columns: source (a path) and source_sha256, checked before a file is staged; source_bytes, that the file must stay under.
    """

    @classmethod
    def name(cls) -> str:
        return "document_files"

    def writer(self, schema: StructType, overwrite: bool) -> FileWriter:
        if overwrite:
            raise ValueError("files aren't overwritten; use mode append")
        if missing := _WRITTEN - set(schema.names):
            raise ValueError(f"columns {sorted(missing)} are missing")
        path = self.options["path"]
        os.makedirs(path.removeprefix("file://").removeprefix("file:"), exist_ok=True)
        return FileWriter(path, schema.names)


def register(spark: SparkSession) -> None:
    """Make both formats known to a session."""
    spark.dataSource.register(DocumentObjects)
    spark.dataSource.register(DocumentFiles)
