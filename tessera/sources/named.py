"""Files by name: a sink that writes rows as files of their own names, and a tar source that reads member by member.

Both are Python data sources over ``pyarrow.fs``: local and mounted folders, and the stores that it knows (``s3://``,
``gs://``, ``hdfs://`` where its library is there).
"""

from __future__ import annotations

import json
import posixpath
import tarfile
import uuid
from collections.abc import Iterator
from dataclasses import dataclass

from pyarrow import fs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.datasource import DataSource, DataSourceReader, DataSourceWriter, InputPartition, WriterCommitMessage


def store_of(path: str) -> tuple[fs.FileSystem, str]:
    """The store of a path and the path in it; a path without a scheme is local."""
    if path.startswith("file:"):
        path = "/" + path[len("file:") :].lstrip("/")
    return fs.FileSystem.from_uri(path) if "://" in path else (fs.LocalFileSystem(), posixpath.abspath(path))


@dataclass
class Written(WriterCommitMessage):
    """What a task has written: a folder of its own, and the names of the files in it."""

    folder: str
    names: list[str]


class NamedWriter(DataSourceWriter):
    """Every task writes its files to a folder of its own under ``_temporary``; only when all are done do they get their places.

    So a task that is run again or lost leaves nothing behind, and a job that fails leaves what was there.
    """

    def __init__(self, options, overwrite: bool):
        self.path, self.overwrite = options["path"], overwrite
        self.run = f"_temporary/{uuid.uuid4().hex}"

    def _at(self, *parts: str) -> tuple[fs.FileSystem, str]:
        store, root = store_of(self.path)
        return store, posixpath.join(root, *parts)

    def write(self, iterator: Iterator) -> Written:
        store, folder = self._at(self.run, uuid.uuid4().hex)
        store.create_dir(folder, recursive=True)
        names = []
        for r in iterator:
            name, content = r["filename"], r["content"]
            if not name or "/" in name or name in (".", "..") or name.startswith("_temporary"):
                raise ValueError(f"not a file's name: {name!r}")
            names.append(name)
            if len(set(names)) != len(names):
                raise ValueError(f"two rows are named {name!r}")
            with store.open_output_stream(posixpath.join(folder, name)) as out:
                out.write((content or "").encode())
        return Written(folder, names)

    def commit(self, messages: list[Written | None]) -> None:
        done = [m for m in messages if m is not None]
        names = [n for m in done for n in m.names]
        if len(set(names)) != len(names):
            self.abort(messages)
            raise ValueError(f"two rows are named {next(n for n in names if names.count(n) > 1)!r}")
        store, root = self._at()
        store.create_dir(root, recursive=True)
        if self.overwrite:
            for info in store.get_file_info(fs.FileSelector(root)):
                if info.type == fs.FileType.File and info.base_name not in names:
                    store.delete_file(info.path)
        for m in done:
            for n in m.names:
                store.move(posixpath.join(m.folder, n), posixpath.join(root, n))
        self.abort(messages)

    def abort(self, messages: list[Written | None]) -> None:
        store, folder = self._at(self.run)
        if store.get_file_info(folder).type == fs.FileType.Directory:
            store.delete_dir(folder)
        store, above = self._at("_temporary")
        if store.get_file_info(above).type == fs.FileType.Directory and not store.get_file_info(fs.FileSelector(above)):
            store.delete_dir(above)


class NamedFiles(DataSource):
    """``df.write.format("tessera_named").save(folder)``: each row (filename, content) is a file of that name in the folder.

    ``append`` replaces files of the same names, ``overwrite`` also deletes the others; two rows of one name are an error.
    """

    @classmethod
    def name(cls) -> str:
        return "tessera_named"

    def schema(self) -> str:
        return "filename string, content string"

    def writer(self, schema, overwrite: bool) -> NamedWriter:
        return NamedWriter(self.options, overwrite)


def save_named(rows: DataFrame, folder: str, mode: str = "append") -> None:
    """Rows (filename, content) as files, written where the rows are."""
    rows.sparkSession.dataSource.register(NamedFiles)
    rows.select("filename", "content").write.format(NamedFiles.name()).mode(mode).save(folder)


@dataclass
class Archive(InputPartition):
    path: str


class TarReader(DataSourceReader):
    def __init__(self, options):
        self.archives, self.ending, self.limit = json.loads(options["archives"]), options.get("ending", ".tex"), int(options.get("limit", 1 << 28))

    def partitions(self) -> list[Archive]:
        return [Archive(a) for a in self.archives]

    def read(self, partition: Archive) -> Iterator[tuple]:
        store, path = store_of(partition.path)
        with store.open_input_stream(path, compression=None) as raw, tarfile.open(fileobj=raw, mode="r|*") as tar:
            pos = 0
            for m in tar:  # as a stream: a member is gone when the next is asked for
                if m.isfile() and m.name.endswith(self.ending):
                    if m.size > self.limit:
                        raise ValueError(f"{m.name} has {m.size} bytes, more than {self.limit}")
                    yield partition.path, pos, m.name, tar.extractfile(m).read().decode("utf-8", "replace")
                    pos += 1


class TarSource(DataSource):
    """``spark.read.format("tessera_tar").option("archives", '["..."]')``: a partition for each archive, a row for each member
    of ``ending``, in constant memory however large the archive."""

    @classmethod
    def name(cls) -> str:
        return "tessera_tar"

    def schema(self) -> str:
        return "archive string, pos int, path string, content string"

    def reader(self, schema) -> TarReader:
        return TarReader(self.options)


def read_tars(spark: SparkSession, archives: list[str], ending: str = ".tex", limit: int = 1 << 28) -> DataFrame:
    """Rows (archive, pos, path, content) of the members of these archives."""
    spark.dataSource.register(TarSource)
    return spark.read.format(TarSource.name()).option("archives", json.dumps(archives)).option("ending", ending).option("limit", str(limit)).load()
