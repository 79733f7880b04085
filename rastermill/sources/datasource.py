"""Files of one kind as a data source: `format("rim")` and `format("png")`, rows (name, data).

Reading deals files out by size. Tasks write below a hidden folder of the job, each attempt into one of its own; only the
files of attempts that count are moved to their place, when all tasks are done. A job that fails leaves none; a task that
outlives its job's end may leave the hidden folder, which readers never see.
"""

from __future__ import annotations

import uuid
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

from pyarrow import fs
from pyspark.sql import Row, SparkSession
from pyspark.sql.datasource import DataSource, DataSourceReader, DataSourceWriter, InputPartition, WriterCommitMessage

PART_BYTES, PART_FILES = 64 << 20, 1_000


@dataclass
class Files(InputPartition):
    paths: list[str]


@dataclass
class Written(WriterCommitMessage):
    attempt: str
    names: list[str]


def opened(options: dict) -> tuple[fs.FileSystem, str]:
    """The file system of option `path`, and the folder there."""
    path = options.get("path")
    if not path:
        raise ValueError("a path is needed")
    if "://" in path or path.startswith("file:"):
        found, folder = fs.FileSystem.from_uri(path if "://" in path else path.replace("file:", "file://", 1))
        return found, folder.rstrip("/")
    return fs.LocalFileSystem(), path.rstrip("/")


class Reader(DataSourceReader):
    def __init__(self, options: dict, suffix: str):
        self.options, self.suffix = options, suffix

    def partitions(self) -> list[InputPartition]:
        store, folder = opened(self.options)
        parts, size = [Files([])], 0
        for info in sorted(store.get_file_info(fs.FileSelector(folder)), key=lambda f: f.path):
            if info.type != fs.FileType.File or not info.path.endswith(self.suffix):
                continue
            if parts[-1].paths and (size + info.size > PART_BYTES or len(parts[-1].paths) == PART_FILES):
                parts.append(Files([]))
                size = 0
            parts[-1].paths.append(info.path)
            size += info.size
        return parts

    def read(self, partition: Files) -> Iterator[tuple]:
        store, _ = opened(self.options)
        for path in partition.paths:
            with store.open_input_stream(path, compression=None) as file:
                yield path.rsplit("/", 1)[-1].removesuffix(self.suffix), file.read()


class Writer(DataSourceWriter):
    def __init__(self, options: dict, suffix: str, overwrite: bool):
        self.options, self.suffix, self.overwrite, self.job = options, suffix, overwrite, f".writing-{uuid.uuid4().hex}"

    def write(self, iterator: Iterator[Row]) -> WriterCommitMessage:
        store, folder = opened(self.options)
        attempt, names = uuid.uuid4().hex, []
        store.create_dir(f"{folder}/{self.job}/{attempt}", recursive=True)
        try:
            for row in iterator:
                if not row.name or "/" in row.name or row.data is None:
                    raise ValueError(f"{row.name}: a file needs a name and data")
                if row.name in names[-1:]:
                    raise ValueError(f"{row.name}: the name repeats")
                with store.open_output_stream(f"{folder}/{self.job}/{attempt}/{row.name}{self.suffix}", compression=None) as file:
                    file.write(bytes(row.data))
                names.append(row.name)
        except BaseException:
            store.delete_dir(f"{folder}/{self.job}/{attempt}")
            raise
        return Written(attempt, names)

    def commit(self, messages: list[WriterCommitMessage | None]) -> None:
        store, folder = opened(self.options)
        done = [m for m in messages if m is not None]
        repeated = [n for n, k in Counter(n for m in done for n in m.names).items() if k > 1]
        if repeated:
            raise ValueError(f"{repeated[0]}: the name repeats")
        if self.overwrite:
            for info in store.get_file_info(fs.FileSelector(folder)):
                if info.type == fs.FileType.File and info.path.endswith(self.suffix):
                    store.delete_file(info.path)
        for message in done:
            for name in message.names:
                store.move(f"{folder}/{self.job}/{message.attempt}/{name}{self.suffix}", f"{folder}/{name}{self.suffix}")
        self.clear(store, folder)

    def abort(self, messages: list[WriterCommitMessage | None]) -> None:
        self.clear(*opened(self.options))

    def clear(self, store: fs.FileSystem, folder: str) -> None:
        if store.get_file_info(f"{folder}/{self.job}").type == fs.FileType.Directory:
            store.delete_dir(f"{folder}/{self.job}")


class RimSource(DataSource):
    """Coded streams as files `name`.rim."""

    SUFFIX = ".rim"

    @classmethod
    def name(cls) -> str:
        return cls.SUFFIX[1:]

    def schema(self) -> str:
        return "name string, data binary"

    def reader(self, schema) -> DataSourceReader:
        return Reader(dict(self.options), self.SUFFIX)

    def writer(self, schema, overwrite: bool) -> DataSourceWriter:
        return Writer(dict(self.options), self.SUFFIX, overwrite)


class PngSource(RimSource):
    """Images as files `name`.png."""

    SUFFIX = ".png"


def register(spark: SparkSession) -> None:
    for source in (RimSource, PngSource):
        spark.dataSource.register(source)
