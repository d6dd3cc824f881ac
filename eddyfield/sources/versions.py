"""Versions of a table that several writers may add to at the same time.

A writer stores the rows in a folder of its own, ``<root>/data/<name>``. Only then it claims the next number by
creating the marker ``<root>/claims/<number>``, which holds that name, and fails to if the marker exists. So each
number belongs to one writer, nobody sees half a version, and a lost claim costs a marker and not a write. A marker
without a name, of a writer that died between the two, is a number that readers pass over.
"""

from __future__ import annotations

import os
import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession


class Conflict(Exception):
    """Another writer took the number."""


def _hadoop(spark: SparkSession, path: str):
    hadoop_path = spark._jvm.org.apache.hadoop.fs.Path(path)
    return hadoop_path.getFileSystem(spark._jsc.hadoopConfiguration()), hadoop_path


def _local(spark: SparkSession, path: str) -> str | None:
    """The path on the local or a mounted file system, where the operating system creates a file exclusively."""
    files, hadoop_path = _hadoop(spark, path)
    whole = files.makeQualified(hadoop_path).toUri()
    return whole.getPath() if whole.getScheme() == "file" else None


def claim(spark: SparkSession, root: str, number: int, name: str) -> bool:
    """Take a number for the folder ``name``; False if it is taken."""
    path = f"{root}/claims/{number:09d}"
    local = _local(spark, path)
    if local is not None:
        os.makedirs(os.path.dirname(local), exist_ok=True)
        try:
            marker = os.open(local, os.O_CREAT | os.O_EXCL | os.O_WRONLY)
        except FileExistsError:
            return False
        with os.fdopen(marker, "w") as out:
            out.write(name)
        return True
    files, hadoop_path = _hadoop(spark, path)
    if files.exists(hadoop_path):
        return False
    try:
        stream = files.create(hadoop_path, False)  # exclusive
    except Exception:
        if files.exists(hadoop_path):
            return False
        raise
    stream.write(bytearray(name.encode()))
    stream.close()
    return True


def taken(spark: SparkSession, root: str) -> int:
    """The highest number that anybody claimed; -1 without any."""
    files, folder = _hadoop(spark, f"{root}/claims")
    if not files.exists(folder):
        return -1
    names = [s.getPath().getName() for s in files.listStatus(folder)]
    return max((int(n) for n in names if n.isdigit()), default=-1)


def name_of(spark: SparkSession, root: str, number: int) -> str:
    """The folder of a version; empty for a number without one."""
    rows = spark.read.text(f"{root}/claims/{number:09d}", wholetext=True).collect()
    return rows[0][0] if rows else ""


def newest(spark: SparkSession, root: str, upto: int | None = None) -> tuple[int, str] | None:
    """Number and folder of the newest version, or of the newest up to a number."""
    number = taken(spark, root) if upto is None else upto
    while number >= 0:
        name = name_of(spark, root, number)
        if name:
            return number, name
        number -= 1
    return None


def read_version(spark: SparkSession, root: str, upto: int | None = None) -> DataFrame:
    """The newest version of a table, or the newest one up to a number."""
    found = newest(spark, root, upto)
    if found is None:
        raise FileNotFoundError(f"{root} has no version")
    return spark.read.parquet(f"{root}/data/{found[1]}")


def _stored(table: DataFrame, root: str) -> str:
    name = uuid.uuid4().hex
    table.write.parquet(f"{root}/data/{name}")
    return name


def _dropped(spark: SparkSession, root: str, name: str) -> None:
    files, path = _hadoop(spark, f"{root}/data/{name}")
    files.delete(path, True)


def append_version(table: DataFrame, root: str) -> int:
    """Store a table as the newest version, whatever others do meanwhile."""
    spark = table.sparkSession
    name = _stored(table, root)
    number = taken(spark, root) + 1
    while not claim(spark, root, number, name):
        number += 1
    return number


def update_version(spark: SparkSession, root: str, change: Callable[[DataFrame | None], DataFrame | None], attempts: int = 20) -> int:
    """Make a version from the newest one (None where there is none). The new number follows the one that was read; if
    another writer takes it first, the change is made again on what that one wrote, so that no update is
    lost. Returns the number; ``change`` may return None to leave the table as it is."""
    for _ in range(attempts):
        last = taken(spark, root)
        before = newest(spark, root, last) if last >= 0 else None
        changed = change(None if before is None else spark.read.parquet(f"{root}/data/{before[1]}"))
        if changed is None:
            return -1 if before is None else before[0]
        name = _stored(changed, root)
        if claim(spark, root, last + 1, name):
            return last + 1
        _dropped(spark, root, name)
    raise Conflict(f"{root}: other writers came first {attempts} times")


def write_once(table: DataFrame, root: str) -> bool:
    """Store a table unless somebody has; of writers at the same time one succeeds. True for that one."""
    spark = table.sparkSession
    if newest(spark, root) is not None:
        return False
    name = _stored(table, root)
    if claim(spark, root, 0, name):
        return True
    _dropped(spark, root, name)
    return False
