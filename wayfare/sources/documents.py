"""A sink of documents: one file for each plan, all of them or none.

Tasks write files of names of their own below ``_staged``; when all tasks have ended the driver moves each to
``<plan_id>.json``, over an older one.  If a task fails, what was staged is removed and the old documents stay.
"""

from __future__ import annotations

import os
import uuid
from collections.abc import Iterator
from dataclasses import dataclass

from pyarrow import fs
from pyspark.sql import DataFrame
from pyspark.sql.datasource import DataSource, DataSourceWriter, WriterCommitMessage
from pyspark.sql.types import Row, StructType


def open_fs(uri: str) -> tuple[fs.FileSystem, str]:
    """The file system and the path in it of a URI (file, hdfs, s3, gs) or a plain path."""
    if uri.startswith("file:") and "://" not in uri:
        uri = "file://" + uri[5:]
    return fs.FileSystem.from_uri(uri) if "://" in uri else (fs.LocalFileSystem(), os.path.abspath(uri))


@dataclass
class Staged(WriterCommitMessage):
    files: list[tuple[int, str]]


class Writer(DataSourceWriter):
    def __init__(self, path: str):
        self.path, self.job = path, uuid.uuid4().hex
        system, path = open_fs(path)
        system.create_dir(f"{path}/_staged/{self.job}", recursive=True)

    def write(self, rows: Iterator[Row]) -> Staged:
        system, path = open_fs(self.path)
        folder, files = f"{path}/_staged/{self.job}", []
        for row in rows:
            if system.get_file_info(folder).type == fs.FileType.NotFound:
                raise RuntimeError("the job has been aborted")  # a task that outlives it leaves nothing
            name = f"{folder}/{uuid.uuid4().hex}"
            with system.open_output_stream(name) as out:
                out.write(row["document"].encode())
            files.append((row["plan_id"], name))
        return Staged(files)

    def commit(self, messages: list[Staged | None]) -> None:
        system, path = open_fs(self.path)
        files = [f for m in messages if m for f in m.files]
        if len({plan for plan, _ in files}) < len(files):
            self.abort(messages)
            raise ValueError("a plan has more than one document")
        for plan, name in files:
            target = f"{path}/{plan}.json"
            if isinstance(system, fs.LocalFileSystem):
                os.replace(name, target)
            else:
                if system.get_file_info(target).type != fs.FileType.NotFound:
                    system.delete_file(target)
                system.move(name, target)
        self._clear(system, path)

    def abort(self, messages: list[Staged | None]) -> None:
        self._clear(*open_fs(self.path))

    def _clear(self, system: fs.FileSystem, path: str) -> None:
        staged = f"{path}/_staged"
        if system.get_file_info(f"{staged}/{self.job}").type != fs.FileType.NotFound:
            system.delete_dir(f"{staged}/{self.job}")
        if system.get_file_info(staged).type != fs.FileType.NotFound and not system.get_file_info(fs.FileSelector(staged)):
            system.delete_dir(staged)


class Documents(DataSource):
    """``df.write.format("documents")``: rows (plan_id, document)."""

    @classmethod
    def name(cls) -> str:
        return "documents"

    def schema(self) -> str:
        return "plan_id long, document string"

    def writer(self, schema: StructType, overwrite: bool) -> Writer:
        return Writer(self.options["path"])


def write_documents(bundles: DataFrame, path: str, column: str = "bundle") -> None:
    """Write each plan's document (plan_id and a text column) as a file of its own; plans without a row keep theirs."""
    bundles.sparkSession.dataSource.register(Documents)
    bundles.selectExpr("cast(plan_id as long) as plan_id", f"`{column}` as document").write.format("documents").mode("append").save(path)
