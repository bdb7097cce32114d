"""Small files in the shared folder that exist once: claims of numbers, by which drivers agree without a server."""

from __future__ import annotations

import os
from urllib.parse import urlparse

from pyspark.sql import SparkSession


def _hadoop(spark: SparkSession, path: str):
    jvm = spark.sparkContext._jvm
    p = jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()), p


def create_once(spark: SparkSession, path: str, text: str) -> bool:
    """Write a file that must not be there yet; False if it is.  Of drivers that try at the same time one succeeds, where the
    file system creates files exclusively, as local ones and HDFS do."""
    where = urlparse(path)
    if where.scheme in ("", "file"):
        os.makedirs(os.path.dirname(where.path), exist_ok=True)
        part = f"{where.path}.{os.urandom(8).hex()}"
        with open(part, "w", encoding="utf-8") as out:
            out.write(text)
        try:
            os.link(part, where.path)  # the whole text appears at once, or not
            return True
        except FileExistsError:
            return False
        finally:
            os.unlink(part)
    fs, p = _hadoop(spark, path)
    try:
        out = fs.create(p, False)
    except Exception as e:
        if "FileAlreadyExists" in str(e):
            return False
        raise
    out.write(bytearray(text.encode()))
    out.close()
    return True


def read_text(spark: SparkSession, path: str) -> str | None:
    """A small file's text; None if there is none."""
    fs, p = _hadoop(spark, path)
    if not fs.exists(p):
        return None
    source = fs.open(p)
    try:
        return spark.sparkContext._jvm.org.apache.commons.io.IOUtils.toString(source, "UTF-8")
    finally:
        source.close()


def names(spark: SparkSession, folder: str) -> list[str]:
    """The names of a folder's files in order; none if there is no folder."""
    fs, p = _hadoop(spark, folder)
    return sorted(f.getPath().getName() for f in fs.listStatus(p)) if fs.exists(p) else []


def replace(spark: SparkSession, path: str, text: str) -> None:
    """Write a small file, over what is there."""
    fs, p = _hadoop(spark, path)
    out = fs.create(p, True)
    out.write(bytearray(text.encode()))
    out.close()
