"""Folders of small files as a data source that goes by their names.

    spark.read.format("tidelog_folder").options(path=..., names="object/log/patch").load()

gives a row a file: its names and its address, not its content. Folders of the
first name are listed by tasks of their own, few large ones by several, each
for a share of the names below; a condition on the first name keeps the others
from being listed. contents() then opens just the files that
are left. Writing gives each row's text the place that its names say: a task
writes beside it and moves it there, so a file is there whole or not at all,
and what a task has done is one commit message.

Names are kept as they are told, whatever their letters: what a file system
might take amiss is spelled as % and two hexadecimal digits of each byte.
"""

from __future__ import annotations

import contextlib
import re
import time
import uuid
import zlib
from collections.abc import Iterable, Iterator
from dataclasses import dataclass
from urllib.parse import unquote

import pyarrow as pa
from pyarrow import fs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, DataSourceStreamReader, DataSourceWriter, EqualTo, Filter, In, InputPartition, WriterCommitMessage
from pyspark.sql.types import BinaryType, StringType, StructField, StructType

#: Folders that a task lists; tasks that share what is below few folders.
TOGETHER, SHARES = 64, 64
FORMAT = "tidelog_folder"


def spelled(name: str) -> str:
    """A name as a file's: letters, digits, minus, tilde and inner dots as they are; a first dot or underline would hide it."""
    return re.sub(r"[^A-Za-z0-9_.~-]|^[._]", lambda m: "".join(f"%{b:02X}" for b in m.group().encode()), name)


def read_name(file: str) -> str:
    """The name that spelled() gave a file; others' files keep theirs."""
    return unquote(file, errors="surrogateescape") if re.search("%[0-9A-F]{2}", file) else file


def opened(path: str) -> tuple[fs.FileSystem, str]:
    """File system and path of an address; without a scheme it is local."""
    if re.match("[a-z0-9]+:/", path) is None:
        return fs.LocalFileSystem(), path.rstrip("/")
    at, base = fs.FileSystem.from_uri(re.sub("^file:/+", "file:///", path))
    return at, base.rstrip("/")


@dataclass
class Folders(InputPartition):
    names: list[str]
    share: int = 0
    shares: int = 1


@dataclass
class Written(WriterCommitMessage):
    files: int


def _below(at: fs.FileSystem, path: str) -> list[fs.FileInfo]:
    """What is right below a folder, without hidden entries; nothing where there is no folder."""
    with contextlib.suppress(FileNotFoundError, NotADirectoryError):
        return sorted((x for x in at.get_file_info(fs.FileSelector(path, allow_not_found=True)) if not x.base_name.startswith((".", "_"))), key=lambda x: x.base_name)
    return []


class FolderReader(DataSourceReader):
    def __init__(self, path: str, names: list[str]):
        self.path, self.names, self.only = path, names, None

    def pushFilters(self, filters: list[Filter]) -> Iterable[Filter]:
        for f in filters:
            if isinstance(f, (EqualTo, In)) and f.attribute == (self.names[0],):
                wanted = {f.value} if isinstance(f, EqualTo) else set(f.value)
                self.only = wanted if self.only is None else self.only & wanted
            yield f  # other spellings of a name are told apart by Spark

    def partitions(self) -> list[InputPartition]:
        at, base = opened(self.path)
        found = [x.base_name for x in _below(at, base) if x.type == fs.FileType.Directory and (self.only is None or read_name(x.base_name) in self.only)]
        groups = [found[i : i + TOGETHER] for i in range(0, len(found), TOGETHER)]
        shares = 1
        if len(groups) == 1:  # how many entries are below tells how many tasks share them
            below = sum(len(_below(at, f"{base}/{x}/log" if self.names[1] == "log" else f"{base}/{x}")) for x in found)
            shares = min(SHARES, max(1, -(-below // TOGETHER)))
        return [Folders(g, k, shares) for g in groups for k in range(shares)] or [Folders([])]

    def read(self, partition: InputPartition) -> Iterator[tuple]:
        at, base = opened(self.path)
        for name in partition.names:
            yield from _walk(at, f"{base}/{name}", (read_name(name),), self.names[1:], partition, 1)


def _walk(at: fs.FileSystem, path: str, told: tuple, left: list[str], part: Folders, shared: int) -> Iterator[tuple]:
    """Names and address of each file below a folder, whose own names are told; of the names after so many only a part's share."""
    if left[0] == "log":
        yield from _walk(at, f"{path}/log", told, left[1:], part, shared)
        return
    for x in _below(at, path):
        if len(told) == shared and zlib.crc32(x.base_name.encode(errors="surrogateescape")) % part.shares != part.share:
            continue
        if (x.type == fs.FileType.File) == (len(left) == 1):
            said = (*told, read_name(x.base_name))
            yield from [(*said, f"{path}/{x.base_name}")] if len(left) == 1 else _walk(at, f"{path}/{x.base_name}", said, left[1:], part, shared)


class FolderStream(DataSourceStreamReader):
    """Every turn tells all files that are there; who reads it drops those of earlier turns. The driver knows a turn's time and shares alone, no name: tasks list the first folders, each for its share of them."""

    def __init__(self, path: str, names: list[str], shares: int):
        self.path, self.names, self.shares = path, names, shares

    def initialOffset(self) -> dict:
        return {"at": 0}

    def latestOffset(self) -> dict:
        return {"at": time.time_ns()}

    def partitions(self, start: dict, end: dict) -> list[InputPartition]:
        return [Folders([], k, self.shares) for k in range(self.shares)]

    def read(self, partition: InputPartition) -> Iterator[tuple]:
        at, base = opened(self.path)
        return _walk(at, base, (), self.names, partition, 0)


class FolderWriter(DataSourceWriter):
    def __init__(self, path: str, names: list[str]):
        self.path, self.names = path, names

    def write(self, iterator: Iterator) -> WriterCommitMessage:
        at, base = opened(self.path)
        made, n = set(), 0
        for row in iterator:
            parts = [base, *[x if x == "log" else spelled(row[x]) for x in self.names]]
            folder = "/".join(parts[:-1])
            if folder not in made:
                at.create_dir(folder, recursive=True)
                made.add(folder)
            place(at, f"{folder}/{parts[-1]}", row["text"].encode())
            n += 1
        return Written(n)


def place(at: fs.FileSystem, path: str, content: bytes) -> None:
    """Write a file beside its place and move it there."""
    folder, _, name = path.rpartition("/")
    aside = f"{folder}/.{name[:40]}-{uuid.uuid4().hex}"
    try:
        with at.open_output_stream(aside) as f:
            f.write(content)
        try:
            at.move(aside, path)
        except OSError:  # a file system that does not replace
            at.delete_file(path)
            at.move(aside, path)
    except BaseException:
        with contextlib.suppress(OSError):
            at.delete_file(aside)
        raise


class FolderSource(DataSource):
    """Options path and names, the folders' and the file's names parted by slashes; log is a folder of that name. shares: tasks of a stream's turn."""

    @classmethod
    def name(cls) -> str:
        return FORMAT

    def _names(self) -> list[str]:
        return self.options["names"].split("/")

    def schema(self) -> StructType:
        return StructType([StructField(n, StringType()) for n in [*(n for n in self._names() if n != "log"), "file"]])

    def reader(self, schema: StructType) -> DataSourceReader:
        return FolderReader(self.options["path"], self._names())

    def streamReader(self, schema: StructType) -> DataSourceStreamReader:
        return FolderStream(self.options["path"], self._names(), int(self.options.get("shares", SHARES)))

    def writer(self, schema: StructType, overwrite: bool) -> DataSourceWriter:
        return FolderWriter(self.options["path"], self._names())


def listed(spark: SparkSession, path: str, names: tuple[str, ...]) -> DataFrame:
    """(names, file) of the files at so many folders below path; no file is opened. A folder that is not there has none."""
    _register(spark)
    return spark.read.format(FORMAT).options(path=path, names="/".join(names)).load()


def arriving(spark: SparkSession, path: str, names: tuple[str, ...]) -> DataFrame:
    """A stream of (names) of the files at so many folders below path, each told once; the stream's state in its checkpoint holds which have been told."""
    _register(spark)
    x = spark.readStream.format(FORMAT).options(path=path, names="/".join(names), shares=str(2 * spark.sparkContext.defaultParallelism)).load()
    return x.drop("file").dropDuplicates([n for n in names if n != "log"])


def saved(texts: DataFrame, path: str, names: tuple[str, ...]) -> None:
    """Write each row's text as the file that its names say, whole or not at all; files of those names are replaced. Rows without a name or text have no file."""
    by = [n for n in names if n != "log"]
    _register(texts.sparkSession)
    told = texts.where(" AND ".join(f"`{c}` IS NOT NULL" for c in [*by, "text"])).select(*[F.col(c).cast("string").alias(c) for c in [*by, "text"]])
    told.write.format(FORMAT).options(path=path, names="/".join(names)).mode("append").save()


def _register(spark: SparkSession) -> None:
    spark.conf.set("spark.sql.python.filterPushdown.enabled", "true")
    spark.dataSource.register(FolderSource)


def contents(files: DataFrame, path: str, file: str = "file") -> DataFrame:
    """files with content: each file opened by the task that has its row. A file that has gone since it was listed has no row."""
    schema = StructType([*files.schema.fields, StructField("content", BinaryType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at, _ = opened(path)
        for b in batches:
            for i in range(0, b.num_rows, 256):
                part, stay, read = b.slice(i, 256), [], []
                for k, name in enumerate(part.column(file).to_pylist()):
                    with contextlib.suppress(FileNotFoundError), at.open_input_stream(name) as f:
                        read.append(f.read())
                        stay.append(k)
                part = part.take(pa.array(stay, pa.int64()))
                yield pa.RecordBatch.from_arrays([*part.columns, pa.array(read, pa.binary())], [*part.schema.names, "content"])

    return files.mapInArrow(run, schema)
