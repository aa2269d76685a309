"""Small files next to a table (logs, manifests) on the file systems that Spark reads.

Uses Hadoop's FileSystem, so local folders, HDFS and object stores work alike.  An entry is
created only if it is absent and counts only if it is whole (it ends with a newline after its
JSON), so a writer that dies halfway leaves nothing that a reader would take for an entry.
"""

from __future__ import annotations

import json
import uuid
from typing import Any

from py4j.protocol import Py4JJavaError
from pyspark.sql import SparkSession


class EntryExists(RuntimeError):
    """Someone else has written this entry."""


def _fs(spark: SparkSession, path: str):
    jvm = spark.sparkContext._jvm
    p = jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()), p


def names(spark: SparkSession, folder: str) -> list[str]:
    """Names in a folder; a folder that does not exist is empty, any other failure is raised."""
    fs, p = _fs(spark, folder)
    return [s.getPath().getName() for s in fs.listStatus(p)] if fs.exists(p) else []


def exists(spark: SparkSession, path: str) -> bool:
    fs, p = _fs(spark, path)
    return bool(fs.exists(p))


def read_entry(spark: SparkSession, path: str) -> dict[str, Any] | None:
    """The entry, or None if it is absent or not whole."""
    fs, p = _fs(spark, path)
    if not fs.exists(p):
        return None
    stream = fs.open(p)
    try:
        text = spark.sparkContext._jvm.org.apache.commons.io.IOUtils.toString(stream, "UTF-8")
    finally:
        stream.close()
    return json.loads(text) if text.endswith("}\n") else None


def write_entry(spark: SparkSession, path: str, entry: dict[str, Any]) -> None:
    """Creates the entry; raises :class:`EntryExists` if there is a whole one already.

    What is there and not whole (a writer's that died) is named aside first, so an entry is only
    ever created where none is, and of two writers one fails.
    """
    if read_entry(spark, path) is not None:
        raise EntryExists(path)
    fs, p = _fs(spark, path)
    if fs.exists(p):
        fs.rename(p, p.suffix(f".broken-{uuid.uuid4().hex[:8]}"))
    try:
        stream = fs.create(p, False)
    except Py4JJavaError as e:
        if "AlreadyExists" in str(e):
            raise EntryExists(path) from e
        raise
    try:
        stream.write((json.dumps(entry) + "\n").encode())
    finally:
        stream.close()


#: Whole entries by path, with the file's time and length: entries do not change, so each is read once.
_READ: dict[str, tuple[int, int, dict[str, Any]]] = {}


def entries(spark: SparkSession, folder: str) -> dict[int, dict[str, Any]]:
    """All whole entries ``<number>.json`` of a folder, by number."""
    fs, p = _fs(spark, folder)
    found: dict[int, dict[str, Any]] = {}
    for status in fs.listStatus(p) if fs.exists(p) else []:
        name, stamp = status.getPath().getName(), (status.getModificationTime(), status.getLen())
        if not name.endswith(".json") or not name[:-5].isdigit():
            continue
        path = f"{folder}/{name}"
        known = _READ.get(path)
        if known is None or known[:2] != stamp:
            entry = read_entry(spark, path)
            if entry is None:
                continue
            known = _READ[path] = (*stamp, entry)
        found[int(name[:-5])] = known[2]
    return {k: found[k] for k in sorted(found)}


def remove_entry(spark: SparkSession, path: str) -> None:
    _READ.pop(path, None)
    fs, p = _fs(spark, path)
    if fs.exists(p) and not fs.delete(p, False):
        raise OSError(f"{path} could not be removed")


def move(spark: SparkSession, source: str, target: str) -> None:
    """A folder moved in place of another."""
    fs, p = _fs(spark, target)
    if fs.exists(p) and not fs.delete(p, True):
        raise OSError(f"{target} could not be removed")
    if not fs.rename(_fs(spark, source)[1], p):
        raise OSError(f"{source} could not be moved to {target}")
