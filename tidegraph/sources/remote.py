"""Small files on any file system Spark knows: local folders, shared mounts and object stores alike."""

from __future__ import annotations

import uuid

from py4j.protocol import Py4JJavaError
from pyspark.sql import SparkSession


def _at(path: str, spark: SparkSession | None = None):
    """The file system of a path and the path in it."""
    s = spark or SparkSession.getActiveSession()
    if s is None:
        raise RuntimeError("no Spark session is active")
    p = s._jvm.org.apache.hadoop.fs.Path(str(path))
    return p.getFileSystem(s._jsc.hadoopConfiguration()), p, s


def exists(path: str) -> bool:
    fs, p, _ = _at(path)
    return bool(fs.exists(p))


def read_text(path: str) -> str:
    """A file's text; OSError if it is not there or not what was written."""
    fs, p, s = _at(path)
    try:
        stream = fs.open(p)
        try:
            return s._jvm.org.apache.commons.io.IOUtils.toString(stream, "UTF-8")
        finally:
            stream.close()
    except Py4JJavaError as e:
        raise OSError(f"{path} cannot be read") from e


def write_text(path: str, text: str) -> None:
    """A file that is complete or not there: written beside its place, then moved."""
    fs, p, s = _at(path)
    part = s._jvm.org.apache.hadoop.fs.Path(f"{path}.{uuid.uuid4().hex}.part")
    stream = fs.create(part, True)
    try:
        stream.write(bytearray(text.encode()))
    finally:
        stream.close()
    if fs.exists(p):
        fs.delete(p, False)
    if not fs.rename(part, p):
        raise OSError(f"{path} could not be put in place")


def children(path: str) -> list[str]:
    """The names in a folder, in order; [] if it is not there."""
    fs, p, _ = _at(path)
    return sorted(x.getPath().getName() for x in fs.listStatus(p)) if fs.exists(p) else []


def move(path: str, to: str) -> None:
    fs, p, s = _at(path)
    target = s._jvm.org.apache.hadoop.fs.Path(str(to))
    fs.mkdirs(target.getParent())
    if not fs.rename(p, target):
        raise OSError(f"{path} could not be moved")
