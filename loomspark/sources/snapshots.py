"""Tables of named parts that readers see whole or not at all.

A part is written aside, to a folder of its own under `<root>/data`. Then a manifest that names all
parts is written under a temporary name and renamed to the next number in `<root>/manifest`. A
rename is atomic, and readers take the manifest of the highest number: a writer that dies at any
point before it leaves the table as it was. One writer at a time; readers are not limited.
"""

from __future__ import annotations

import json
import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession


def _fs(spark: SparkSession, path: str):
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    return at.getFileSystem(spark._jsc.hadoopConfiguration()), at


def _manifests(spark: SparkSession, root: str) -> list[str]:
    fs, folder = _fs(spark, f"{root}/manifest")
    if not fs.exists(folder):
        return []
    return sorted(name for s in fs.listStatus(folder) if (name := s.getPath().getName()).endswith(".json") and not name.startswith("."))


def _read(spark: SparkSession, path: str) -> str:
    fs, at = _fs(spark, path)
    stream = fs.open(at)
    try:
        return spark._jvm.org.apache.commons.io.IOUtils.toString(stream, "UTF-8")
    finally:
        stream.close()


def parts(spark: SparkSession, root: str) -> dict[str, str]:
    """The names of the table's parts and their folders; none where nothing has been committed."""
    found = _manifests(spark, root)
    return json.loads(_read(spark, f"{root}/manifest/{found[-1]}")) if found else {}


def publish(spark: SparkSession, root: str, change: Callable[[dict[str, str]], dict[str, str]]) -> None:
    """Make the parts that change gives of the present ones the table, in one step."""
    found = _manifests(spark, root)
    number = int(found[-1].removesuffix(".json")) + 1 if found else 1
    fs, temporary = _fs(spark, f"{root}/manifest/.{uuid.uuid4().hex}.json")
    out = fs.create(temporary, False)
    out.write(bytearray(json.dumps(change(parts(spark, root)), sort_keys=True).encode()))
    out.close()
    _, target = _fs(spark, f"{root}/manifest/{number:012d}.json")
    if fs.exists(target) or not fs.rename(temporary, target):
        fs.delete(temporary, False)
        raise RuntimeError(f"another writer committed number {number} of {root}")


def commit(rows: DataFrame, root: str, name: str, alone: bool = False) -> None:
    """Write rows as the part of that name, in place of an earlier one; alone: in place of all parts."""
    path = f"data/{uuid.uuid4().hex}"
    rows.write.parquet(f"{root}/{path}")
    publish(rows.sparkSession, root, lambda now: ({} if alone else now) | {name: path})


def read(spark: SparkSession, root: str, name: str | None = None, upto: str | None = None) -> DataFrame | None:
    """The rows of all committed parts, of one, or of those named before upto; None where there are none."""
    found = {n: p for n, p in parts(spark, root).items() if (name is None or n == name) and (upto is None or n < upto)}
    return spark.read.parquet(*[f"{root}/{p}" for p in found.values()]) if found else None


def clean(spark: SparkSession, root: str) -> int:
    """Delete the folders and manifests that the newest manifest does not name; how many folders. Run it when no reader is on an old one."""
    found = _manifests(spark, root)
    named = set(parts(spark, root).values())
    fs, folder = _fs(spark, f"{root}/data")
    gone = [s.getPath() for s in fs.listStatus(folder) if f"data/{s.getPath().getName()}" not in named] if fs.exists(folder) else []
    for path in gone:
        fs.delete(path, True)
    for old in found[:-1]:
        fs.delete(_fs(spark, f"{root}/manifest/{old}")[1], False)
    return len(gone)
