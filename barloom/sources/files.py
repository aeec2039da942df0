"""Small files beside tables, in whatever file system their path names: read, written whole, or created by exactly one of several writers."""

from __future__ import annotations

import uuid
from typing import Any

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def _at(path: str) -> tuple[Any, Any, Any]:
    spark = SparkSession.getActiveSession() or SparkSession.builder.getOrCreate()
    jvm = spark.sparkContext._jvm
    p = jvm.org.apache.hadoop.fs.Path(path)
    return jvm, p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()), p


def exists(path: str) -> bool:
    _, fs, p = _at(path)
    return fs.exists(p)


def read(path: str) -> str:
    jvm, fs, p = _at(path)
    with_stream = fs.open(p)
    try:
        return jvm.org.apache.commons.io.IOUtils.toString(with_stream, "UTF-8")
    finally:
        with_stream.close()


def write(path: str, text: str) -> None:
    """Whole or not at all: under a name of its own first, then renamed; what stood there goes."""
    _, fs, p = _at(path)
    part = p.suffix(f".{uuid.uuid4().hex}.part")
    out = fs.create(part, True)
    out.write(bytearray(text.encode()))
    out.close()
    if fs.exists(p):
        fs.delete(p, False)
    if not fs.rename(part, p):
        raise OSError(f"{path} cannot be written")


def create(path: str, text: str) -> bool:
    """Write a file that is not there yet; False, and nothing changes, if another writer was first."""
    jvm, fs, p = _at(path)
    if p.getParent() is not None:
        fs.mkdirs(p.getParent())
    try:
        out = fs.create(p, False)
    except Exception as e:  # noqa: BLE001  Py4J wraps the file system's own exception
        if "FileAlreadyExists" in str(e) or "already exists" in str(e):
            return False
        raise
    out.write(bytearray(text.encode()))
    out.close()
    return True


def delete(path: str) -> None:
    """A file, or a folder and all that is in it."""
    _, fs, p = _at(path)
    fs.delete(p, True)


def names(path: str, ending: str = "") -> list[str]:
    """The files of a folder, in order; none if it is not there."""
    _, fs, p = _at(path)
    return sorted(s.getPath().getName() for s in fs.listStatus(p) if s.isFile() and s.getPath().getName().endswith(ending)) if fs.exists(p) else []


def digests(spark: SparkSession, folder: str) -> dict[str, str]:
    """sha256 of every file under a folder, but for hidden ones; a run's files are few, their contents stay on the executors."""
    _, fs, p = _at(folder)
    root = fs.makeQualified(p).toString().rstrip("/")
    found: DataFrame = spark.read.format("binaryFile").option("recursiveFileLookup", True).load(folder)
    strip = lambda x: x.split(":", 1)[-1].lstrip("/")  # noqa: E731  file:///a and file:/a are one
    return {strip(r.path)[len(strip(root)) + 1 :]: r.sha for r in found.select("path", F.sha2("content", 256).alias("sha")).collect()}
