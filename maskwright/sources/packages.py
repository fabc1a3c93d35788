"""A data source of packaged documents: spark.read.format("docx") gives paragraphs, df.write.format("docx") puts files."""

from __future__ import annotations

import posixpath
import re
import time
import uuid
from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyarrow import fs
from pyspark.sql import Row, SparkSession
from pyspark.sql.datasource import DataSource, DataSourceReader, DataSourceWriter, InputPartition, WriterCommitMessage
from pyspark.sql.types import BinaryType, StringType, StructType

from maskwright.sources import docx

#: Files are read together up to a size between these, so that there are a thousand partitions or more where there can be;
#: a larger file is a partition of its own. Packages are compressed: a megabyte holds a dozen of text.
BYTES_PER_PARTITION = (1 << 18, 64 << 20)
_STAGING = "_staging-"


def opened(path: str) -> tuple[fs.FileSystem, str]:
    """The file system of a path or URI, and the path in it."""
    local = re.sub(r"^file:/+", "/", path)
    if "://" in local:
        return fs.FileSystem.from_uri(local)
    return fs.LocalFileSystem(), posixpath.abspath(local)


class Documents(DataSource):
    """Reading: a row for each paragraph (docx.PARAGRAPHS), doc_id being the file's path below the folder, or its name.

    path: a file or a folder, with all that is in it; files that don't end in .docx, and those whose names or folders begin
    with . or _, don't count. Option bytesPerPartition: how many bytes of files a task reads at most, if they are several.
    A file that isn't a package stops the query, with its path, or is left out with the option skipBroken true.

    Writing: rows (path string, content binary) become files below the folder, by their paths. A task writes aside; the
    files get their names when all tasks are done, and none does if a task fails for good; where a file system has no folders
    of its own, as object stores, what a stopped task writes last may stay in a folder _staging-..., which isn't read. mode "append" refuses names that
    are there already, "overwrite" takes the place of all documents of the folder. Two rows of one path, null paths and
    contents, and paths that lead out of the folder are refused.
    """

    @classmethod
    def name(cls) -> str:
        return "docx"

    def schema(self) -> str:
        return docx.PARAGRAPHS

    def reader(self, schema: StructType) -> DataSourceReader:
        return Reader(dict(self.options))

    def writer(self, schema: StructType, overwrite: bool) -> DataSourceWriter:
        kinds = {f.name: f.dataType for f in schema.fields}
        if not isinstance(kinds.get("path"), StringType) or not isinstance(kinds.get("content"), BinaryType):
            raise ValueError("rows to write have path (string) and content (binary)")
        return Writer(self.options["path"], overwrite)


@dataclass
class Files(InputPartition):
    names: tuple[str, ...]


def listed(system: fs.FileSystem, root: str) -> list[tuple[str, int]]:
    """(path below root, size) of the documents, in order; of a root that is a file, itself."""
    info = system.get_file_info(root)
    if info.type == fs.FileType.NotFound:
        raise FileNotFoundError(root)
    if info.type == fs.FileType.File:
        return [(posixpath.basename(root), info.size)]
    found = []
    for x in system.get_file_info(fs.FileSelector(root, recursive=True)):
        name = posixpath.relpath(x.path, root)
        if x.type == fs.FileType.File and name.endswith(".docx") and not any(p[0] in "._" for p in name.split("/")):
            found.append((name, x.size))
    return sorted(found)


class Reader(DataSourceReader):
    def __init__(self, options: dict[str, str]):
        options = {k.lower(): v for k, v in options.items()}
        self.path = options["path"]
        self.most = int(options["bytesperpartition"]) if "bytesperpartition" in options else None
        self.skip_broken = options.get("skipbroken", "false").lower() == "true"

    def partitions(self) -> list[Files]:
        groups: list[list[str]] = []
        held = 0
        files = listed(*opened(self.path))
        least, most = BYTES_PER_PARTITION
        most = self.most or min(most, max(least, sum(size for _, size in files) // 1000))
        for name, size in files:
            if not groups or held + size > most:
                groups.append([])
                held = 0
            groups[-1].append(name)
            held += size
        return [Files(tuple(g)) for g in groups] or [Files(())]

    def read(self, partition: Files) -> Iterator[pa.RecordBatch]:
        system, root = opened(self.path)
        alone = bool(partition.names) and system.get_file_info(root).type == fs.FileType.File
        for name in partition.names:
            with system.open_input_stream(root if alone else f"{root}/{name}") as f:
                content = f.read()
            try:
                batches = docx.batches_of(name, content)
            except Exception as e:
                if self.skip_broken:
                    continue
                raise ValueError(f"{name} can't be read as a packaged document: {e}") from e
            yield from batches


@dataclass
class Written(WriterCommitMessage):
    folder: str
    names: tuple[str, ...]


class Writer(DataSourceWriter):
    def __init__(self, path: str, overwrite: bool):
        self.path, self.overwrite = path, overwrite
        self.staging = f"{_STAGING}{uuid.uuid4().hex}"
        system, root = opened(path)
        system.create_dir(f"{root}/{self.staging}", recursive=True)

    def write(self, iterator: Iterator[Row]) -> Written:
        """Into a folder of this attempt's own, so that a repeated or lost task is in nobody's way.

        A task that goes on after the write was given up finds no folder, and makes none.
        """
        system, root = opened(self.path)
        folder, names = f"{self.staging}/{uuid.uuid4().hex}", []
        system.create_dir(f"{root}/{folder}", recursive=False)
        for row in iterator:
            if row.path is None or row.content is None:
                raise ValueError("a document's path or content is null")
            name = posixpath.normpath(re.sub(r"^[a-z]+:/+|^/+", "", row.path))
            if name.startswith("..") or not name.endswith(".docx"):
                raise ValueError(f"{row.path} isn't the name of a document below the folder")
            with system.open_output_stream(f"{root}/{folder}/{len(names)}") as f:
                f.write(bytes(row.content))
            names.append(name)
        return Written(folder, tuple(names))

    def commit(self, messages: list[Written | None]) -> None:
        system, root = opened(self.path)
        try:
            moves = [(f"{root}/{m.folder}/{i}", name) for m in messages if m is not None for i, name in enumerate(m.names)]
            new = {name for _, name in moves}
            if len(new) < len(moves):
                raise ValueError("several rows have one path")
            there = {name for name, _ in listed(system, root)}
            if not self.overwrite and new & there:
                raise FileExistsError(f"{min(new & there)} is there already")
            for name in (there - new) if self.overwrite else ():
                system.delete_file(f"{root}/{name}")
            for folder in {posixpath.dirname(f"{root}/{name}") for name in new}:
                system.create_dir(folder, recursive=True)
            for source, name in moves:
                system.move(source, f"{root}/{name}")
        finally:
            self._clear()

    def abort(self, messages: list[Written | None]) -> None:
        self._clear()

    def _clear(self) -> None:
        system, root = opened(self.path)
        for left in range(9, -1, -1):
            if system.get_file_info(f"{root}/{self.staging}").type != fs.FileType.Directory:
                return
            try:
                system.delete_dir(f"{root}/{self.staging}")
            except OSError:  # a task that hasn't been stopped yet has just written there
                if not left:
                    raise
                time.sleep(0.1)


def register(spark: SparkSession) -> None:
    spark.dataSource.register(Documents)
