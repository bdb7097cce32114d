"""Files of other formats than Spark's, written and read by tasks in the shared folder through Arrow's file systems."""

from __future__ import annotations

import os
import uuid

from pyarrow import fs


def open_fs(uri: str) -> tuple[fs.FileSystem, str]:
    """The file system and the path in it of a URI (file, hdfs, s3, gs) or a plain path."""
    if "://" not in uri and uri.startswith("file:"):
        uri = "file://" + uri[5:]
    return fs.FileSystem.from_uri(uri) if "://" in uri else (fs.LocalFileSystem(), os.path.abspath(uri))


def put(folder: str, name: str, data: bytes) -> str:
    """Write a new file; its name is its own in each attempt of a task, so that only the files of tasks that ended count."""
    system, path = open_fs(folder)
    system.create_dir(path, recursive=True)
    file = f"{name}-{uuid.uuid4().hex}"
    with system.open_output_stream(f"{path}/{file}") as out:
        out.write(data)
    return f"{folder}/{file}"


def get(uri: str, start: int = 0, length: int | None = None) -> bytes:
    """The bytes of a file, or ``length`` of them from ``start`` on."""
    system, path = open_fs(uri)
    with system.open_input_file(path) as f:
        return f.read_at(f.size() - start if length is None else max(0, min(length, f.size() - start)), start)
